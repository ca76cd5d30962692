"""Patterns, scans and closures on hand-made graphs."""

from __future__ import annotations

import itertools
import random

import pytest

from weftgraph.model import HRT, Graph
from weftgraph.operators import closure, patterns, sets
from weftgraph.plans import scan


def trip(spark, *rows):
    return spark.createDataFrame(list(rows), "h string, r string, t string")


def kv(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v string")


def k(spark, *rows):
    return spark.createDataFrame([(x,) for x in rows], "k string")


def got(df, *cols):
    return {tuple(r[c] for c in (cols or HRT)) for r in df.collect()}


def empty_types(spark):
    return spark.createDataFrame([], "ent string, cls string")


def graph(spark, rows, new, types=(), **pats):
    t = trip(spark, *rows, *new)
    ty = spark.createDataFrame(list(types), "ent string, cls string") if types else empty_types(spark)
    return Graph(t, ty, trip(spark, *rows), pats)


def test_functional_flags_new_rows_only(spark):
    g = graph(spark, [("a", "r", "b")], [("a", "r", "c")], functional=k(spark, "r"))
    assert got(scan.scan_relations(g).where("NOT is_valid")) == {("a", "r", "c")}


def test_asymmetric(spark):
    g = graph(spark, [("a", "r", "b")], [("b", "r", "a"), ("c", "r", "d")], asymmetric=k(spark, "r"))
    assert got(scan.scan_relations(g).where("NOT is_valid")) == {("b", "r", "a")}


def test_relation_without_positive_pattern_is_incorrect(spark):
    rows = trip(spark, ("a", "r", "b"), ("a", "q", "b"))
    types = spark.createDataFrame([("a", "C")], "ent string, cls string")
    assert got(patterns.outside_domain(rows, kv(spark, ("r", "C")), types)) == {("a", "q", "b")}


def _reference(rows, new, types, pats):
    """The scan by nested loops."""
    valid, out = set(rows) | set(new), {}
    fresh = set(new) - set(rows)
    ty = lambda e: {c for x, c in types if x == e}
    meet = {"domain_domain": (0, 0), "domain_range": (0, 2), "range_domain": (2, 0), "range_range": (2, 2)}
    for name in scan.ORDER:
        bad = set()
        for p in pats.get(name, []):
            if name in ("neg_domain", "neg_range"):
                bad |= {x for x in valid if x[1] == p[0] and p[1] in ty(x[0 if name == "neg_domain" else 2])}
            elif name in meet:
                i, j = meet[name]
                bad |= {x for x in valid & fresh if x[1] == p[0] and any(y[1] == p[1] and y[j] == x[i] for y in valid)}
            elif name == "functional":
                bad |= {x for x in valid & fresh if x[1] == p and sum(y[1] == p and y[0] == x[0] for y in valid) > 1}
            elif name in ("functional_sub", "functional_inverse"):
                e, o = (0, 2) if name == "functional_sub" else (2, 0)
                if any(y[1] == p[0] for y in valid):
                    bad |= {x for x in valid & fresh if x[1] == p[1] and (sum(y[1] == p[1] and y[e] == x[e] for y in valid) > 1 or any(y[1] == p[0] and y[0] == x[e] and y[2] != x[o] for y in valid))}
            elif name == "irreflexive":
                bad |= {x for x in valid if x[1] == p and x[0] == x[2]}
            else:
                bad |= {x for x in valid & fresh if x[1] == p and (x[2], p, x[0]) in valid}
        for x in bad:
            out[x] = name
        valid -= bad
    return out


@pytest.mark.parametrize("seed", range(3))
def test_strict_scan_against_nested_loops(spark, seed):
    rnd = random.Random(seed)
    every = list(itertools.product("abcde", "pqr", "abcde"))
    rows = rnd.sample(every, 14)
    new = [x for x in rnd.sample(every, 22) if x not in rows]
    types = [(e, c) for e in "abcde" for c in "XY" if rnd.random() < 0.3]
    pats = {"neg_domain": [("p", "X")], "neg_range": [("q", "Y")], "domain_range": [("q", "r")], "range_range": [("r", "p")], "functional": ["p"], "functional_sub": [("p", "q")], "functional_inverse": [("q", "r")], "irreflexive": ["r"], "asymmetric": ["q", "r"]}
    tables = {n: k(spark, *v) if isinstance(v[0], str) else kv(spark, *v) for n, v in pats.items()}
    g = graph(spark, rows, new, types, **tables)
    res = {(r.h, r.r, r.t): r.pattern for r in scan.scan_relations(g).collect()}
    want = _reference(rows, new, types, pats)
    assert {x for x, p in res.items() if p} == set(want)
    assert all(res[x] == want[x] for x in want)
    assert set(res) == set(rows) | set(new)
    loose = {(r.h, r.r, r.t) for r in scan.scan_relations(g, strict=False).where("NOT is_valid").collect()}
    assert set(want) <= loose


def test_scan_of_its_valid_rows_rejects_nothing_when_nothing_is_new(spark):
    g = graph(spark, [("a", "r", "b"), ("b", "r", "a"), ("a", "f", "b"), ("a", "f", "c")], [], functional=k(spark, "f"), asymmetric=k(spark, "r"))
    assert scan.scan_relations(g).where("NOT is_valid").count() == 0


def test_empty_graph_and_no_patterns(spark):
    g = graph(spark, [], [("a", "r", "b")])
    assert [r.is_valid for r in scan.scan_relations(g).collect()] == [True]
    e = Graph(trip(spark, ("a", "r", "b")).limit(0), empty_types(spark), None, {"functional": k(spark, "r")})
    assert scan.scan_relations(e).count() == 0


def axioms(spark, *rows):
    return spark.createDataFrame(list(rows), "kind string, s string, o string")


def test_disjointness_is_inherited(spark):
    neg = got(closure.negative_inclusions(axioms(spark, ("subclass", "Woman", "Person"), ("disjoint", "Person", "Work"))), "s", "o")
    assert neg == {("Person", "Work"), ("Work", "Person"), ("Woman", "Work"), ("Work", "Woman")}


def test_sub_relation_implies_existential_inclusions(spark):
    pos = closure.positive_inclusions(axioms(spark, ("subrel", "hasMother", "hasParent")))
    assert got(pos, "s", "o") == {("some:hasMother", "some:hasParent"), ("some_inv:hasMother", "some_inv:hasParent")}
    assert ("not:some:hasParent", "not:some:hasMother") in got(closure.contrapositives(pos), "s", "o")


def test_pattern_tables_from_domain_and_range(spark):
    ax = axioms(spark, ("domain", "work_for", "Person"), ("range", "work_for", "Work"), ("disjoint", "Person", "Work"), ("domain", "hasParent", "Person"), ("range", "hasParent", "Person"), ("inverse", "hasChild", "hasParent"))
    t = {n: got(d, "k", "v") if "v" in d.columns else got(d, "k") for n, d in closure.pattern_tables(ax).items()}
    assert ("work_for", "Work") in t["neg_domain"] and ("work_for", "Person") in t["neg_range"] and ("hasParent", "Work") in t["neg_domain"]
    assert ("hasChild", "Work") in t["neg_range"]
    assert ("hasParent", "work_for") in t["domain_range"]


def test_functional_inverse_pattern(spark):
    t = closure.pattern_tables(axioms(spark, ("functional", "hasWife", None), ("inverse", "hasWife", "wifeOf")))
    assert got(t["functional_inverse"], "k", "v") == {("hasWife", "wifeOf")}


def test_closures_reach_a_fix_point_on_cycles(spark):
    c = closure.transitive_closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "s int, o int"))
    want = {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)}
    assert got(c, "s", "o") == want and got(closure.transitive_closure(c), "s", "o") == want


def test_materialisation(spark):
    ax = axioms(spark, ("subrel", "mother", "parent"), ("inverse", "parent", "child"), ("transitive", "anc", None), ("subrel", "parent", "anc"), ("domain", "parent", "Person"), ("subclass", "Person", "Thing"))
    t = trip(spark, ("a", "mother", "b"), ("b", "mother", "c"))
    full = got(closure.triple_closure(t, ax))
    assert {("a", "anc", "c"), ("b", "child", "a"), ("c", "child", "b"), ("a", "parent", "b")} <= full and ("c", "anc", "a") not in full
    ty = got(closure.type_closure(empty_types(spark), t, ax), "ent", "cls")
    assert {("a", "Person"), ("b", "Thing")} <= ty and ("c", "Person") not in ty


def test_dictionary_is_dense_and_ordered(spark):
    v = spark.createDataFrame([(f"e{i:04d}",) for i in range(500)] * 2, "ent string").repartition(7)
    rows = sorted((r.ent, r.id) for r in sets.dictionary(v, "ent", 5).collect())
    assert rows == [(f"e{i:04d}", i + 5) for i in range(500)]
