"""Embedding scores as column expressions over array columns (evaluated in the JVM).

Higher is more plausible for all. Vectors are array<double>; complex ones hold the real half
first. Matrices are row-major arrays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column


def fsum(a: C) -> C:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def dot(a: C, b: C) -> C:
    return fsum(F.zip_with(a, b, lambda x, y: x * y))


def add(a: C, b: C) -> C:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: C, b: C) -> C:
    return F.zip_with(a, b, lambda x, y: x - y)


def mul(a: C, b: C) -> C:
    return F.zip_with(a, b, lambda x, y: x * y)


def scale(a: C, k: C) -> C:
    return F.transform(a, lambda x: x * k)


def norm(a: C, p: int = 2) -> C:
    return fsum(F.transform(a, F.abs)) if p == 1 else F.sqrt(dot(a, a))


def unit(a: C) -> C:
    return F.transform(a, lambda x: x / F.sqrt(dot(a, a)))


def cosine(a: C, b: C) -> C:
    return dot(a, b) / (norm(a) * norm(b))


def halves(a: C) -> tuple[C, C]:
    n = (F.size(a) / 2).cast("int")
    return F.slice(a, F.lit(1), n), F.slice(a, n + 1, n)


def transe(h: C, r: C, t: C, p: int = 1) -> C:
    return -norm(sub(add(h, r), t), p)


def distmult(h: C, r: C, t: C) -> C:
    return dot(mul(h, r), t)


def complex_(h: C, r: C, t: C) -> C:
    (hr, hi), (rr, ri), (tr, ti) = halves(h), halves(r), halves(t)
    return dot(mul(hr, rr), tr) + dot(mul(hi, rr), ti) + dot(mul(hr, ri), ti) - dot(mul(hi, ri), tr)


def simple(h: C, r: C, t: C) -> C:
    (h1, h2), (r1, r2), (t1, t2) = halves(h), halves(r), halves(t)
    return (dot(mul(h1, r1), t2) + dot(mul(t1, r2), h2)) / 2.0


def rotate(h: C, r: C, t: C, span: float = math.pi) -> C:
    """Distance after the rotation of ``h`` by the phases ``r`` (half as long), as a negative sum of moduli."""
    (hr, hi), (tr, ti) = halves(h), halves(t)
    cos, sin = F.transform(r, lambda x: F.cos(x * (math.pi / span))), F.transform(r, lambda x: F.sin(x * (math.pi / span)))
    re = sub(sub(mul(hr, cos), mul(hi, sin)), tr)
    im = sub(add(mul(hr, sin), mul(hi, cos)), ti)
    return -fsum(F.zip_with(re, im, lambda x, y: F.sqrt(x * x + y * y)))


def project(e: C, n: C) -> C:
    """``e`` without its part along the unit vector ``n``."""
    k = dot(e, n)
    return F.zip_with(e, n, lambda x, y: x - k * y)


def transh(h: C, r: C, t: C, n: C, p: int = 1) -> C:
    return transe(project(h, n), r, project(t, n), p)


def matvec(m: C, v: C) -> C:
    """Rows of the row-major ``m`` times ``v``."""
    n = F.size(v)
    return F.transform(F.sequence(F.lit(0), (F.size(m) / n).cast("int") - 1), lambda i: dot(F.slice(m, i * n + 1, n), v))


def rows_by(rows: C, v: C) -> C:
    """As ``matvec``, for a matrix that is an array of its rows: no row is cut out of a long array for each triple."""
    return F.transform(rows, lambda x: dot(x, v))


def transr(h: C, r: C, t: C, m: C, p: int = 1) -> C:
    return transe(matvec(m, h), r, matvec(m, t), p)


def transd(h: C, r: C, t: C, hp: C, rp: C, tp: C, p: int = 1) -> C:
    """Projection by transfer vectors of the entity and of the relation."""
    k, q = dot(h, hp), dot(t, tp)
    return transe(F.zip_with(h, rp, lambda x, y: x + k * y), r, F.zip_with(t, rp, lambda x, y: x + q * y), p)


def rescal(h: C, m: C, t: C) -> C:
    return dot(h, matvec(m, t))


def hole(h: C, r: C, t: C) -> C:
    """Relation times the circular correlation of head and tail."""
    n = F.size(h)
    corr = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + F.get(h, i) * F.get(t, (i + k) % n)))
    return dot(r, corr)


def analogy(h: C, r: C, t: C, hd: C, rd: C, td: C) -> C:
    return complex_(h, r, t) + distmult(hd, rd, td)
