"""Rules, rankings, metrics, sampling, scores and preparation on small inputs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import kge
from weftgraph.model import HRT, Graph
from weftgraph.operators import etl, metrics, ranking, rules, sampling, scoring, sets
from weftgraph.plans import queries, rounds


def trip(spark, *rows):
    return spark.createDataFrame(list(rows), "h string, r string, t string")


def test_two_atom_rule_counts_distinct_bindings_with_object_identity(spark):
    t = trip(spark, ("a", "p", "b"), ("b", "q", "c"), ("a", "s", "c"), ("d", "p", "e"), ("e", "q", "f"), ("d", "s", "f"), ("g", "p", "h"), ("h", "q", "i"), ("a", "p", "z"), ("z", "q", "c"), ("x", "p", "y"), ("y", "q", "x"))
    m = {(r["head"], r.r1, r.d1, r.r2, r.d2): (r.predicted, r.correct) for r in rules.mine_cyclic2(t).collect()}
    assert m["s", "p", 1, "q", 1] == (3, 2)


def test_two_atom_rules_of_all_bodies_against_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    graph = sorted({(f"e{rnd.randrange(9)}", rnd.choice("pqs"), f"e{rnd.randrange(9)}") for _ in range(45)})
    steps = [(r, 1, h, t) for h, r, t in graph] + [(r, 0, t, h) for h, r, t in graph]
    found = {}
    for r1, d1, x, z in steps:
        for r2, d2, a, y in steps:
            if a == z and len({x, y, z}) == 3:
                found.setdefault((r1, d1, r2, d2), set()).add((x, y))
    want = {}
    for shape, xy in found.items():
        for head in "pqs":
            n = len(xy & {(h, t) for h, r, t in graph if r == head})
            if n >= 2:
                want[head, *shape] = (len(xy), n)
    monkeypatch.setattr(queries, "triples", lambda s, d: trip(s, *graph, graph[0]))
    got = {(r["head"], r.r1, r.d1, r.r2, r.d2): (r.predicted, r.correct) for r in queries.QUERIES["rule_cyclic2_whole"](spark, "").collect()}
    assert got == want and len({k[1:] for k in got}) > 20


def test_constant_rules_and_exclusive_pairs_of_all_relations_against_brute_force(spark, monkeypatch):
    rnd = random.Random(6)
    graph = sorted({(f"o{rnd.randrange(60)}", r, f"{k}{rnd.randrange(4)}") for _ in range(110) for r, k in (("contains", "p"), ("shippedBy", "s"), ("placedBy", "c"))} | {(f"p{i}", "suppliedBy", f"s{rnd.randrange(4)}") for i in range(4)})
    monkeypatch.setattr(queries, "triples", lambda s, d: trip(s, *graph, graph[0]))
    steps = [(r, 1, h, t) for h, r, t in graph] + [(r, 0, t, h) for h, r, t in graph]
    heads = {}
    for h, r, t in graph:
        heads.setdefault((r, t), set()).add(h)
    keyed, loose = {}, {}
    for r, d, x, y in steps:
        keyed.setdefault((r, d, y), set()).add(x)
        loose.setdefault((r, d), set()).add(x)
    one = {(*a, *b): (len(xs), len(xs & hs)) for a, hs in heads.items() for b, xs in keyed.items() if len(xs) >= 5 and len(xs & hs) >= 2 and (a[0], 1) != b[:2]}
    two = {(*a, *b): (len(xs), len(xs & hs)) for a, hs in heads.items() for b, xs in loose.items() if len(xs & hs) >= 2}
    got1 = {(r["head"], r.const, r.body, r.d, r.key): (r.predicted, r.correct) for r in queries.QUERIES["rule_acyclic1_whole"](spark, "").collect()}
    got2 = {(r["head"], r.const, r.body, r.d): (r.predicted, r.correct) for r in queries.QUERIES["rule_acyclic2_whole"](spark, "").collect()}
    assert got1 == one and got2 == two and {"contains", "shippedBy"} <= {k[2] for k in got1}
    often = {a: hs for a, hs in heads.items() if len(hs) >= 10}
    both = lambda a, b: sum(any(x in hs for (r, _), hs in often.items() if r == a) and any(x in hs for (r, _), hs in often.items() if r == b) for x in {h for h, _, _ in graph})
    want = {(*a, *b): (len(often[a]), len(often[b])) for a in often for b in often if a[0] < b[0] and both(a[0], b[0]) >= 10 and not often[a] & often[b]}
    assert {(r.r1, r.c1, r.r2, r.c2): (r.n1, r.n2) for r in queries.QUERIES["negative_pairs_whole"](spark, "").collect()} == want


def test_one_atom_and_constant_rules(spark):
    t = trip(spark, *[(f"a{i}", "p", f"b{i}") for i in range(4)], *[(f"b{i}", "q", f"a{i}") for i in range(3)], *[(f"a{i}", "in", "x") for i in range(4)], *[(f"a{i}", "at", "y") for i in range(3)])
    one = {(r["head"], r.body, r.d): (r.predicted, r.correct) for r in rules.mine_cyclic1(t).collect()}
    assert one["q", "p", 0] == (4, 3) and one["p", "q", 0] == (3, 3)
    zero = {(r["head"], r.const): r.confidence for r in rules.mine_zero(t).collect()}
    assert zero["in", "x"] == 1.0
    ac = {(r["head"], r.const, r.body, r.key): r.confidence for r in rules.mine_acyclic1(t, 2).collect()}
    assert ac["at", "y", "in", "x"] == 0.75


def test_pattern_matching_and_negative_rule(spark):
    t = trip(spark, ("a", "born", "x"), ("b", "born", "x"), ("a", "knows", "b"), ("c", "knows", "a"))
    b = rules.match(t, [("?p", "born", "?x"), ("?q", "born", "?x")], ["p < q"])
    assert [(r.p, r.q) for r in b.collect()] == [("a", "b")]
    bad = rules.violates(t, t, "knows", [("?subject", "born", "?x"), ("?object", "born", "?x")])
    assert [(r.h, r.t) for r in bad.collect()] == [("a", "b")]


def test_paths(spark):
    t = trip(spark, ("a", "p", "b"), ("c", "p", "b"), ("d", "p", "e"))
    pairs = spark.createDataFrame([("a", "c"), ("a", "b"), ("a", "d")], "h string, t string")
    assert [(r.h, r.t) for r in rules.connected(pairs, t, 1).collect()] == [("a", "b")]
    assert [(r.h, r.t) for r in rules.connected(pairs, t, 2).collect()] == [("a", "c")]


def test_forward_chain_takes_the_best_relation(spark):
    t = trip(spark, ("a", "son", "b"), ("b", "son", "c"))
    r = spark.createDataFrame([(1, "grandson", "son", 1, "son", 1, 0.9), (2, "nephew", "son", 1, "son", 1, 0.2)], "rule_id int, head string, r1 string, d1 int, r2 string, d2 int, confidence double")
    out = {(x.h, x.r, x.t): x["round"] for x in rules.forward_chain(t, r).collect()}
    assert out["a", "grandson", "c"] == 1 and ("a", "nephew", "c") not in out


def test_forward_chain_reaches_the_fix_point(spark):
    t = trip(spark, *[(f"a{i}", k, f"a{i + 1}") for i in range(13) for k in ("parent", "ancestor")])
    r = spark.createDataFrame([(1, "ancestor", "ancestor", 1, "parent", 1, 0.9)], "rule_id int, head string, r1 string, d1 int, r2 string, d2 int, confidence double")
    out = {(x.h, x.t) for x in rules.forward_chain(t, r).where("r = 'ancestor'").collect()}
    assert out == {(f"a{i}", f"a{j}") for i in range(14) for j in range(i + 1, 14)}
    with pytest.raises(RuntimeError):
        rules.forward_chain(t, r, 2)


def test_rule_lines_round_trip():
    line = "10\t7\t0.7\tp(X,Y) <= q(X,A), s(A,Y)"
    r = rules.parse_rule(line)
    assert r["kind"] == "cyclic" and r["body"] == [("q", "X", "A"), ("s", "A", "Y")] and rules.write_rule(r) == line
    assert rules.parse_rule("5\t2\t0.4\tp(X,c) <= q(X,d)")["kind"] == "acyclic1"
    assert rules.parse_rule("5\t2\t0.4\tp(X,c) <= q(X,A)")["kind"] == "acyclic2"
    assert rules.parse_rule("5\t2\t0.4\tp(X,c) <= ")["kind"] == "zero" and rules.parse_rule("junk") is None


def test_aggregations(spark):
    p = spark.createDataFrame([("t", "x", 1, 0.5), ("t", "x", 2, 0.5), ("t", "y", 1, 0.6)], "task string, candidate string, rule_id int, confidence double")
    no = {r.candidate: r.score for r in ranking.noisy_or(p, ["task"]).collect()}
    assert no["x"] == pytest.approx(0.75) and no["y"] == pytest.approx(0.6)
    mp = [r.candidate for r in ranking.top(ranking.max_plus(p, ["task"]), ["task"], 2, by="confs").orderBy("rank").collect()]
    assert mp == ["y", "x"]


def test_hits_and_mrr(spark):
    ranks = spark.createDataFrame([(1,), (3,)], "rank long")
    s = metrics.summary(ranks, (1, 3)).first()
    assert (s.hits_1, s.hits_3) == (0.5, 1.0) and s.mrr == pytest.approx((1 + 1 / 3) / 2, abs=1e-6)
    top = spark.createDataFrame([("q1", "a", 1), ("q2", "x", 1), ("q2", "y", 2), ("q2", "b", 3), ("q3", "z", 1)], "q string, candidate string, rank int")
    gold = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "c")], "q string, candidate string")
    none = gold.limit(0)
    r = metrics.list_hits(top, gold, none, ["q"], (1, 3)).first()
    assert r.hits_1 == pytest.approx(1 / 3, abs=1e-6) and r.hits_3 == pytest.approx(2 / 3, abs=1e-6) and r.mrr == pytest.approx((1 + 1 / 3) / 3, abs=1e-6)


def test_filtered_rank(spark):
    sc = spark.createDataFrame([("h", "r", c, s) for c, s in (("a", 0.9), ("b", 0.8), ("c", 0.7))], "h string, r string, candidate string, score double")
    gold = spark.createDataFrame([("h", "r", "c")], "h string, r string, candidate string")
    known = spark.createDataFrame([("h", "r", "a")], "h string, r string, candidate string")
    assert metrics.ranks(sc, gold, None, ["h", "r"]).first()["rank"] == 3
    assert metrics.ranks(sc, gold, known, ["h", "r"]).first()["rank"] == 2


def test_grouped_map(spark):
    t = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (4, 1, 3), (0, 2, 5)], "h int, r int, t int")
    assert {(r.r, r.h): r.tails for r in sets.grouped_tails(t).collect()} == {(1, 0): [2, 3], (1, 4): [3], (2, 0): [5]}


def test_splits_keep_their_invariants(spark):
    t = trip(spark, *[(f"e{i % 17}", f"r{i % 3}", f"e{(i * 7 + 1) % 23}") for i in range(200)]).distinct()
    s = sampling.dev_split(t, 20).collect()
    train = [x for x in s if not x.dev]
    ents, rels = {x.h for x in train} | {x.t for x in train}, {x.r for x in train}
    assert any(x.dev for x in s) and all(x.h in ents and x.t in ents and x.r in rels for x in s if x.dev)
    c = sampling.corrupt(t, sets.entities(t), 3).collect()
    known = {tuple(x) for x in t.collect()}
    assert c and all((x.ch, x.r, x.ct) not in known and (x.ch == x.h) != (x.side == "h") or (x.ch, x.ct) == (x.h, x.t) or x.ch == x.h or x.ct == x.t for x in c)
    out = {x.ent for x in sampling.inductive_drop(t, 0.2, min_triples=5).collect()}
    left = [x for x in known if x[0] not in out and x[2] not in out]
    lone = {x[0] for x in known if x[0] != x[2]} | {x[2] for x in known if x[0] != x[2]}
    assert all(any(e in (x[0], x[2]) for x in left) for e in lone - out)
    w = spark.createDataFrame([("a", "r", "b", f"c{i}", float(i % 3)) for i in range(9)], "h string, r string, t string, candidate string, weight double")
    got = sampling.weighted_negatives(w, 4).collect()
    assert len(got) == 4 and all(x.weight > 0 for x in got)


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(1)
    h, r, t = rng.normal(size=(3, 8))
    df = spark.createDataFrame([(h.tolist(), r.tolist(), t.tolist())], "h array<double>, r array<double>, t array<double>")
    cols = [F.col(c) for c in HRT]
    hole = r @ np.array([sum(h[i] * t[(i + k) % 8] for i in range(8)) for k in range(8)])
    hc, rc, tc = (x[:4] + 1j * x[4:] for x in (h, r, t))
    rot = -np.abs(hc * np.exp(1j * r[:4]) - tc).sum()
    row = df.select(kge.transe(*cols).alias("a"), kge.distmult(*cols).alias("b"), kge.complex_(*cols).alias("c"), kge.hole(*cols).alias("d"), kge.rotate(cols[0], F.slice(cols[1], 1, 4), cols[2]).alias("e")).first()
    assert list(row) == pytest.approx([-np.abs(h + r - t).sum(), (h * r * t).sum(), (hc * rc * tc.conj()).sum().real, hole, rot])
    assert scoring.losses(np.array([1.0]), np.array([[0.5, 3.0]])) == pytest.approx((0.5 + 3.0) / 2)


def test_transe_training_lowers_the_loss(spark):
    n = 20
    t = spark.createDataFrame([(i, 0, (i + 1) % n) for i in range(n)] * 5, "head int, rel int, tail int")

    def gap(e, r):
        d = lambda k: np.abs(e + r[0] - np.roll(e, -k, axis=0)).sum(1).mean()
        return d(1) - np.mean([d(k) for k in range(2, n)])

    assert gap(*scoring.train_transe(t, n, 1, dim=8, epochs=6)) < gap(*scoring.train_transe(t, n, 1, dim=8, epochs=0)) - 0.1


def test_bag_of_words(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vec array<double>")
    x = spark.createDataFrame([(1, "A a b"), (2, "zz")], "id int, text string")
    out = {r.id: r.vec for r in scoring.bag_of_words(x, v).collect()}
    assert out[1] == pytest.approx([2 / 3, 1 / 3]) and out[2] == pytest.approx([0.5, 0.5])


def test_producer_rounds(spark):
    t = trip(spark, ("a", "p", "b"), ("b", "q", "c"), ("a", "s", "c"), ("d", "p", "e"), ("e", "q", "f"), ("d", "s", "f"), ("g", "p", "h"), ("h", "q", "i"))
    types = spark.createDataFrame([("i", "Bad")], "ent string, cls string")
    pat = {"neg_range": spark.createDataFrame([("s", "Bad")], "k string, v string")}
    g, rep = rounds.run(Graph(t, types), {"rules": rounds.by_rules(0.2)}, 1)
    assert ("g", "s", "i") in {tuple(x) for x in g.triples.select(*HRT).collect()} and rep[0].new >= 1
    g, rep = rounds.run(Graph(t, types, None, pat), {"rules": rounds.by_rules(0.2)}, 1)
    assert ("g", "s", "i") not in {tuple(x) for x in g.triples.select(*HRT).collect()} and rep[0].valid < rep[0].new
    ax = spark.createDataFrame([("subrel", "p", "up")], "kind string, s string, o string")
    g, rep = rounds.run(Graph(t, types), {"onto": rounds.by_ontology(ax)}, 3, {"onto": False})
    assert [(x.new, x.valid) for x in rep] == [(3, 3), (0, 0)]


def test_preparation(spark):
    s = spark.createDataFrame([("a", "r", "b", "short one", 0.5), ("a", "r", "b", "better one", 0.9), ("a", "r", "b", " ".join("x" * 99), 1.0)], "h string, r string, t string, sentence string, score double")
    best = etl.best_sentence(s)
    assert best.first().sentence == "better one" and {r.ent for r in etl.entity_text(best).collect()} == {"a", "b"}
    e = spark.createDataFrame([("concept_city_new_york",), ("x",)], "ent string")
    assert {(r.cls, r.text) for r in etl.split_names(e).collect()} == {("city", "new york"), ("thing", "x")}
    rep = spark.createDataFrame([(1, "1. Paris: 0.2\nLyon = 0.7\nnoise")], "id int, reply string")
    assert {(r.candidate, r.score) for r in etl.parse_reply(rep).collect()} == {("Paris", 0.2), ("Lyon", 0.7)}
