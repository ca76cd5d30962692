"""Registered scoring queries over the ``embeddings`` table, each beside its SQL.

Relation vectors are those of the first seven ids; extra vectors (normals, transfers,
matrices) are slices of other ids, so that the SQL needs nothing but the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kge
from ..operators import scoring
from .queries import QUERIES, SQL
from .starkg import read

N = 16
_V = "ev AS (SELECT vec_id AS id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS vec FROM embeddings)"
_T = f"WITH {_V}, n AS (SELECT count(*) AS c FROM ev), tr AS (SELECT id AS head, id % 7 AS rel, (id * 7 + 1) % c AS tail FROM ev, n), j AS (SELECT tr.*, a.vec AS h, b.vec AS r, c.vec AS t FROM tr JOIN ev a ON a.id = head JOIN ev b ON b.id = rel JOIN ev c ON c.id = tail)"


def _lists(s, d):
    e = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice(F.col("embedding").cast("array<double>"), 1, N).alias("vec"))
    n = e.count()
    t = e.select(F.col("id").alias("head"), (F.col("id") % 7).alias("rel"), ((F.col("id") * 7 + 1) % n).alias("tail"))
    return t, e, F.broadcast(e.where("id < 7"))  # seven relations


def _sum(x: str, n: int = N) -> str:
    return f"list_sum([{x} FOR i IN range(1, {n + 1})])"


_COMPLEX = " + ".join(_sum(x, 8) for x in ("h[i]*r[i]*t[i]", "h[i+8]*r[i]*t[i+8]", "h[i]*r[i+8]*t[i+8]", "-h[i+8]*r[i+8]*t[i]"))
_HH, _RR = "h[1:8]", "r[1:8]"
MODELS = {
    "transe": (lambda h, r, t: kge.transe(h, r, t), f"-{_sum('abs(h[i]+r[i]-t[i])')}"),
    "transe_l2": (lambda h, r, t: kge.transe(h, r, t, 2), f"-sqrt({_sum('(h[i]+r[i]-t[i])*(h[i]+r[i]-t[i])')})"),
    "distmult": (kge.distmult, _sum("h[i]*r[i]*t[i]")),
    "complex": (kge.complex_, _COMPLEX),
    "simple": (kge.simple, f"({_sum('h[i]*r[i]*t[i+8]', 8)} + {_sum('t[i]*r[i+8]*h[i+8]', 8)}) / 2"),
    "rotate": (lambda h, r, t: kge.rotate(h, F.slice(r, 1, 8), t), f"-{_sum('sqrt((h[i]*cos(r[i])-h[i+8]*sin(r[i])-t[i])*(h[i]*cos(r[i])-h[i+8]*sin(r[i])-t[i])+(h[i]*sin(r[i])+h[i+8]*cos(r[i])-t[i+8])*(h[i]*sin(r[i])+h[i+8]*cos(r[i])-t[i+8]))', 8)}"),
    # the normal is the relation vector itself; its own length is left as it is
    "transh": (lambda h, r, t: kge.transh(h, r, t, r), f"-{_sum('abs(h[i]-' + _sum('h[j]*r[j]').replace('FOR i', 'FOR j') + '*r[i]+r[i]-t[i]+' + _sum('t[j]*r[j]').replace('FOR i', 'FOR j') + '*r[i])')}"),
    # each entity is its own transfer vector, and so is the relation
    "transd": (lambda h, r, t: kge.transd(h, r, t, h, r, t), f"-{_sum('abs(h[i]+' + _sum('h[j]*h[j]').replace('FOR i', 'FOR j') + '*r[i]+r[i]-t[i]-' + _sum('t[j]*t[j]').replace('FOR i', 'FOR j') + '*r[i])')}"),
    # 4 by 4 matrices from the relation vector
    "transr": (lambda h, r, t: kge.transr(F.slice(h, 1, 4), F.slice(r, 1, 4), F.slice(t, 1, 4), r), "-" + _sum("abs(" + "+".join(f"r[4*i-4+{j}]*h[{j}]" for j in range(1, 5)) + "+r[i]-(" + "+".join(f"r[4*i-4+{j}]*t[{j}]" for j in range(1, 5)) + "))", 4)),
    "rescal": (lambda h, r, t: kge.rescal(F.slice(h, 1, 4), r, F.slice(t, 1, 4)), _sum("h[i]*(" + "+".join(f"r[4*i-4+{j}]*t[{j}]" for j in range(1, 5)) + ")", 4)),
    "hole": (kge.hole, _sum("r[k]*list_sum([h[i]*t[((i-1+k-1) % 16)+1] FOR i IN range(1, 17)])").replace("FOR i IN range(1, 17)])", "FOR k IN range(1, 17)])").replace("FOR k IN range(1, 17)])", "FOR i IN range(1, 17)])", 1)),
    "analogy": (lambda h, r, t: kge.analogy(h, r, t, h, r, t), f"{_COMPLEX} + {_sum('h[i]*r[i]*t[i]')}"),
}


def _model(name):
    def run(s, d):
        t, e, r = _lists(s, d)
        return scoring.score(t, e, r, MODELS[name][0]).withColumn("score", F.round("score", 5))

    return run


for _n, (_, _x) in MODELS.items():
    QUERIES[f"kge_{_n}"] = _model(_n)
    SQL[f"kge_{_n}"] = f"{_T} SELECT head, rel, tail, round({_x}, 5) AS score FROM j"


def kge_topk(s, d):
    t, e, r = _lists(s, d)
    best = scoring.complete(t.where("head % 25 = 0").select("head", "rel"), e, r, lambda h, r, t: F.round(kge.distmult(h, r, t), 5), 10, product=kge.mul)
    return best.select("head", "rel", "candidate", "score", "rank")


QUERIES["kge_topk"] = kge_topk
SQL["kge_topk"] = f"{_T} SELECT head, rel, candidate, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY head, rel ORDER BY score DESC, candidate) AS rank FROM (SELECT j.head, j.rel, e.id AS candidate, round({_sum('j.h[i]*j.r[i]*e.vec[i]')}, 5) AS score FROM j, ev e WHERE j.head % 25 = 0)) WHERE rank <= 10"


def kge_rerank(s, d):
    t, e, _ = _lists(s, d)
    run = t.where("head % 10 = 0").select(F.col("head").alias("qid"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k")).select("qid", ((F.col("qid") * 31 + F.col("k") * 17) % 500).alias("doc"), (1.0 / F.col("k")).alias("score"))
    return scoring.rerank(run, e, e, 0.5).select("qid", "doc", F.round("score", 5).alias("score"), "rank")


QUERIES["kge_rerank"] = kge_rerank
SQL["kge_rerank"] = f"{_T}, rn AS (SELECT head AS qid, (head * 31 + k * 17) % 500 AS doc, 1.0 / k AS score FROM tr, (SELECT unnest(range(1, 13)) AS k) WHERE head % 10 = 0), sc AS (SELECT rn.qid, rn.doc, 0.5 * {_sum('q.vec[i]*e.vec[i]')} / (sqrt({_sum('q.vec[i]*q.vec[i]')}) * sqrt({_sum('e.vec[i]*e.vec[i]')})) + 0.5 * rn.score AS score FROM rn JOIN ev q ON q.id = rn.qid JOIN ev e ON e.id = rn.doc) SELECT qid, doc, round(score, 5) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM sc"


# --- whole vectors: no SQL, which is too slow on 64 values ---


def _whole(s, d):
    e = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    n = e.count()
    t = e.select(F.col("id").alias("head"), (F.col("id") % 7).alias("rel"), ((F.col("id") * 7 + 1) % n).alias("tail"))
    return t, e, e.where("id < 7"), n


#: As ``MODELS``, for whole vectors: phases are half of the relation vector, matrices map whole vectors to whole vectors.
WHOLE = {k: f for k, (f, _) in MODELS.items()} | {
    "rotate": lambda h, r, t: kge.rotate(h, kge.halves(r)[0], t),
    "transr": lambda h, r, t: kge.transe(kge.rows_by(r["m"], h), r["v"], kge.rows_by(r["m"], t)),
    "rescal": lambda h, r, t: kge.dot(h, kge.rows_by(r["m"], t)),
}
MATRIX = ("transr", "rescal")


def _with_matrices(r, e, n):
    """Relation vectors ``v``, each with the rows ``m`` of its matrix: row i of relation k is the vector of id k * length + i, modulo the rows."""
    rows = r.select(F.col("id").alias("k"), F.size("vec").alias("dim"), F.posexplode("vec").alias("i", "x")).select("k", "i", ((F.col("k") * F.col("dim") + F.col("i")) % n).alias("id"))
    m = rows.join(e, "id").groupBy(F.col("k").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "vec"))), lambda s: s["vec"]).alias("m"))
    return r.join(m, "id").select("id", F.struct(F.col("vec").alias("v"), "m").alias("vec"))


def _whole_model(name):
    def run(s, d):
        t, e, r, n = _whole(s, d)
        return scoring.score(t, e, F.broadcast(_with_matrices(r, e, n) if name in MATRIX else r), WHOLE[name]).withColumn("score", F.round("score", 5))

    return run


for _n in WHOLE:
    QUERIES[f"kge_{_n}_whole"] = _whole_model(_n)


def kge_topk_whole(s, d):
    """The search queries are the heads with id % 20 = 0; all entities are candidates."""
    t, e, r, _ = _whole(s, d)
    best = scoring.complete(t.where("head % 20 = 0").select("head", "rel"), e, r, lambda h, r, t: F.round(kge.distmult(h, r, t), 5), 10, product=kge.mul)
    return best.select("head", "rel", "candidate", "score", "rank")


QUERIES["kge_topk_whole"] = kge_topk_whole


def kge_rerank_whole(s, d):
    """Every id is a query, candidates are drawn from all rows."""
    t, e, _, n = _whole(s, d)
    run = t.select(F.col("head").alias("qid"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k")).select("qid", ((F.col("qid") * 31 + F.col("k") * 17) % n).alias("doc"), (1.0 / F.col("k")).alias("score"))
    return scoring.rerank(run, e, e, 0.5).select("qid", "doc", F.round("score", 5).alias("score"), "rank")


QUERIES["kge_rerank_whole"] = kge_rerank_whole


def kge_classify(s, d):
    """Node classification has no SQL; tests check its accuracy."""
    e = read(s, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return scoring.classify_nodes(v, e.select(F.col("vec_id").alias("id"), "label"), F.col("id") % 5 == 0)


QUERIES["kge_classify"] = kge_classify
