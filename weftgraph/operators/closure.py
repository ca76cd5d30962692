"""Closures: derived triples, class hierarchies, saturation of disjointness, pattern generation.

Axioms are rows (kind, s, o). Class expressions are strings: a class name, ``some:R`` (has
an R-successor), ``some_inv:R`` (has an R-predecessor). Ontologies are small beside the data,
but loops below only ever join and deduplicate, and checkpoint each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import HRT
from ..plans.checkpoints import cut
from .sets import difference


def by_inverse(t: DataFrame, pairs: DataFrame) -> DataFrame:
    """(t, v, h) for every (h, k, t) with pairs (k, v), minus the triples there are."""
    new = t.join(pairs.select(F.col("k").alias("r"), "v").distinct(), "r").select(F.col("t").alias("h"), F.col("v").alias("r"), F.col("h").alias("t")).distinct()
    return difference(new, t)


def by_sub_relation(t: DataFrame, pairs: DataFrame) -> DataFrame:
    """(h, v, t) for every (h, k, t) where k is a sub-relation of v (every v, not only one)."""
    new = t.join(pairs.select(F.col("k").alias("r"), "v").distinct(), "r").select("h", F.col("v").alias("r"), "t").distinct()
    return difference(new, t)


def by_symmetry(t: DataFrame, rels: DataFrame) -> DataFrame:
    own = t.join(rels.select(F.col("k").alias("r")).distinct(), "r", "left_semi")
    return difference(own.select(F.col("t").alias("h"), "r", F.col("h").alias("t")).distinct(), t)


def by_reflexivity(ents: DataFrame, rels: DataFrame, t: DataFrame) -> DataFrame:
    """(e, r, e) of every entity for the (few) reflexive relations, minus the triples there are."""
    r = F.explode(F.array(*[F.lit(x[0]) for x in rels.select("k").distinct().collect()]))  # relations of an ontology
    return difference(ents.select(F.col("ent").alias("h"), r.alias("r"), F.col("ent").alias("t")), t)


def by_transitivity(t: DataFrame, rels: DataFrame) -> DataFrame:
    """One hop: (x, r, z) for (x, r, y), (y, r, z), minus the triples there are."""
    own = t.join(rels.select(F.col("k").alias("r")).distinct(), "r", "left_semi").select(*HRT)
    a, b = own.alias("a"), own.alias("b")
    hop = a.join(b, (F.col("a.r") == F.col("b.r")) & (F.col("a.t") == F.col("b.h"))).select(F.col("a.h").alias("h"), F.col("a.r").alias("r"), F.col("b.t").alias("t"))
    return difference(hop.distinct(), t)


def transitive_closure(pairs: DataFrame) -> DataFrame:
    """All (s, o) reachable over ``pairs``; each round doubles the path length. Cycles are fine."""
    done = cut(pairs.select("s", "o").distinct())
    n = done.count()
    while True:
        a, b = done.alias("a"), done.alias("b")
        hop = a.join(b, F.col("a.o") == F.col("b.s")).select(F.col("a.s").alias("s"), F.col("b.o").alias("o"))
        done = cut(done.unionByName(hop).distinct())
        m = done.count()
        if m == n:
            return done
        n = m


def relation_closure(axioms: DataFrame) -> DataFrame:
    """(s, s_inv, o): relation s (inverted if s_inv) is a sub-relation of o, closed.

    Inverse and symmetric axioms are rewritten as sub-relation axioms first.
    """
    sub = axioms.where("kind = 'subrel'").select("s", F.lit(0).alias("i"), "o")
    inv = axioms.where("kind = 'inverse'")
    sym = axioms.where("kind = 'symmetric'")
    base = sub.unionByName(inv.select("s", F.lit(1).alias("i"), "o")).unionByName(inv.select(F.col("o").alias("s"), F.lit(1).alias("i"), F.col("s").alias("o"))).unionByName(sym.select("s", F.lit(1).alias("i"), F.col("s").alias("o")))
    # nodes r and r^-: an axiom holds for both directions
    plus = lambda c: F.concat(F.lit("+"), c)
    minus = lambda c: F.concat(F.lit("-"), c)
    edges = base.select(F.when(F.col("i") == 0, plus("s")).otherwise(minus("s")).alias("s"), plus("o").alias("o")).unionByName(base.select(F.when(F.col("i") == 0, minus("s")).otherwise(plus("s")).alias("s"), minus("o").alias("o")))
    c = transitive_closure(edges).where("o LIKE '+%'")
    return c.select(F.expr("substring(s, 2)").alias("s"), F.col("s").startswith("-").alias("s_inv"), F.expr("substring(o, 2)").alias("o")).distinct()


def positive_inclusions(axioms: DataFrame) -> DataFrame:
    """Closed (s, o) between class expressions: subclass, domain, range, and what relations imply."""
    rel = relation_closure(axioms)
    some, inv = (lambda c: F.concat(F.lit("some:"), c)), (lambda c: F.concat(F.lit("some_inv:"), c))
    direct = [
        axioms.where("kind = 'subclass'").select("s", "o"),
        axioms.where("kind = 'domain'").select(some(F.col("s")).alias("s"), "o"),
        axioms.where("kind = 'range'").select(inv(F.col("s")).alias("s"), "o"),
        rel.select(F.when(F.col("s_inv"), inv(F.col("s"))).otherwise(some(F.col("s"))).alias("s"), some(F.col("o")).alias("o")),
        rel.select(F.when(F.col("s_inv"), some(F.col("s"))).otherwise(inv(F.col("s"))).alias("s"), inv(F.col("o")).alias("o")),
    ]
    out = direct[0]
    for d in direct[1:]:
        out = out.unionByName(d)
    return transitive_closure(out.where("s <> o"))


def negative_inclusions(axioms: DataFrame) -> DataFrame:
    """Closed (s, o) meaning s and o share nothing: A below B, B apart from C, so A apart from C and C from A."""
    pos = positive_inclusions(axioms)
    apart = axioms.where("kind = 'disjoint'").select("s", "o")
    apart = apart.unionByName(apart.select(F.col("o").alias("s"), F.col("s").alias("o"))).distinct()
    nodes = apart.select("s").unionByName(pos.select("s")).unionByName(pos.select(F.col("o").alias("s"))).distinct()
    below = pos.unionByName(nodes.select("s", F.col("s").alias("o"))).distinct()
    left = below.join(apart.select(F.col("s").alias("o"), F.col("o").alias("c")), "o").select("s", "c").distinct()
    return left.join(below.select(F.col("s").alias("x"), F.col("o").alias("c")), "c").select("s", F.col("x").alias("o")).distinct()


def contrapositives(pos: DataFrame) -> DataFrame:
    """not:o below not:s for every inclusion s below o."""
    return pos.select(F.concat(F.lit("not:"), "o").alias("s"), F.concat(F.lit("not:"), "s").alias("o"))


def pattern_tables(axioms: DataFrame) -> dict[str, DataFrame]:
    """The pattern tables (k, v) that an ontology implies, by pattern name."""
    neg = negative_inclusions(axioms)
    kind = lambda c: F.when(F.col(c).startswith("some:"), "some").when(F.col(c).startswith("some_inv:"), "inv").otherwise("class")
    bare = lambda c: F.regexp_replace(F.col(c), "^some(_inv)?:", "")
    rows = cut(neg.select(kind("s").alias("ks"), bare("s").alias("k"), kind("o").alias("ko"), bare("o").alias("v")).distinct())
    of = lambda a, b: rows.where((F.col("ks") == a) & (F.col("ko") == b)).select("k", "v")
    functional = axioms.where("kind = 'functional'").select(F.col("s").alias("k"))
    rel = axioms.where("kind = 'subrel'").select(F.col("o").alias("k"), F.col("s").alias("v")).join(functional, "k", "left_semi")
    inv = axioms.where("kind = 'inverse'")
    both = inv.select(F.col("s").alias("k"), F.col("o").alias("v")).unionByName(inv.select(F.col("o").alias("k"), F.col("s").alias("v"))).join(functional, "k", "left_semi")
    return {
        "neg_domain": of("some", "class"), "neg_range": of("inv", "class"),
        "domain_domain": of("some", "some").where("k <> v"), "domain_range": of("some", "inv").where("k <> v"),
        "range_domain": of("inv", "some").where("k <> v"), "range_range": of("inv", "inv").where("k <> v"),
        "type_disjoint_class": of("class", "class"), "type_disjoint_domain": of("class", "some"), "type_disjoint_range": of("class", "inv"),
        "functional": functional, "functional_sub": rel, "functional_inverse": both.distinct(),
        "irreflexive": axioms.where("kind = 'irreflexive'").select(F.col("s").alias("k")),
        "asymmetric": axioms.where("kind = 'asymmetric'").select(F.col("s").alias("k")),
    }


def positive_tables(axioms: DataFrame) -> dict[str, DataFrame]:
    """Domains and ranges with all their subclasses: (k relation, v class)."""
    sub = transitive_closure(axioms.where("kind = 'subclass'").select("s", "o"))
    out = {}
    for name in ("domain", "range"):
        d = axioms.where(F.col("kind") == name).select(F.col("s").alias("k"), F.col("o").alias("v"))
        low = d.join(sub.select(F.col("o").alias("v"), F.col("s").alias("w")), "v").select("k", F.col("w").alias("v"))
        out[name] = d.unionByName(low).distinct()
    return out


def redundant(axioms: DataFrame) -> DataFrame:
    """Subclass axioms (s, o) that follow from the others through a third class."""
    direct = axioms.where("kind = 'subclass'").select("s", "o").where("s <> o").distinct()
    c = transitive_closure(direct)
    first = direct.select("s", F.col("o").alias("m"))
    over = first.join(c.select(F.col("s").alias("m"), "o"), "m").where("m <> o AND m <> s").select("s", "o").distinct()
    return direct.join(over, ["s", "o"], "left_semi")


def type_closure(types: DataFrame, triples: DataFrame, axioms: DataFrame) -> DataFrame:
    """Realised types: asserted, by domain and range (with sub-relations), and all their superclasses.

    Rows meet the inclusions before anything is shuffled; an entity's classes are deduplicated once.
    """
    pos = positive_inclusions(axioms).where("NOT o LIKE 'some%'")
    some = triples.select(F.col("h").alias("ent"), F.concat(F.lit("some:"), "r").alias("s"))
    inv = triples.select(F.col("t").alias("ent"), F.concat(F.lit("some_inv:"), "r").alias("s"))
    up = [x.join(pos, "s").select("ent", F.col("o").alias("cls")) for x in (types.select("ent", F.col("cls").alias("s")), some, inv)]
    return types.select("ent", "cls").unionByName(up[0]).unionByName(up[1]).unionByName(up[2]).distinct()


def triple_closure(triples: DataFrame, axioms: DataFrame) -> DataFrame:
    """Realised triples: sub-relations, inverses, symmetry and transitivity to a fix-point.

    ``rel`` is closed, so it is applied once to what is given. Only transitive relations need rounds: each joins the new
    triples of these relations with all of them, and keeps what is new alone.
    """
    rel = cut(relation_closure(axioms).withColumnRenamed("s", "r"))
    trans = [x[0] for x in axioms.where("kind = 'transitive'").select("s").distinct().collect()]  # relations of an ontology

    def implied(t: DataFrame) -> DataFrame:
        j = t.join(rel, "r")
        return j.select(F.when(F.col("s_inv"), F.col("t")).otherwise(F.col("h")).alias("h"), F.col("o").alias("r"), F.when(F.col("s_inv"), F.col("h")).otherwise(F.col("t")).alias("t"))

    done = triples.select(*HRT).unionByName(implied(triples.select(*HRT))).distinct()
    if not trans:
        return done
    fed = sorted({*trans, *(x[0] for x in rel.where(F.col("r").isin(trans)).select("o").distinct().collect())})  # relations that rounds can add to
    into = rel.where(F.col("o").isin(fed))
    sources = sorted({*fed, *(x[0] for x in into.select("r").distinct().collect())})
    given = triples.select(*HRT).where(F.col("r").isin(sources))
    known = delta = cut(given.unionByName(implied(given)).where(F.col("r").isin(fed)).distinct())
    added = None
    while True:
        x, d = known.where(F.col("r").isin(trans)), delta.where(F.col("r").isin(trans))
        hop = _hop(d, x) if delta is known else _hop(d, x).unionByName(_hop(x, d))
        delta = cut(difference(hop.unionByName(implied(hop)).distinct(), known))
        if delta.isEmpty():
            break
        known = known.unionByName(delta)
        added = delta if added is None else added.unionByName(delta)
    return done if added is None else done.unionByName(added)


def _hop(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, r, z) for (x, r, y) of ``a`` and (y, r, z) of ``b``."""
    n = b.select(F.col("h").alias("t"), "r", F.col("t").alias("z"))
    return a.join(n, ["r", "t"]).select("h", "r", F.col("z").alias("t"))
