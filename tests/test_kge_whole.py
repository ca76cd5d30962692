"""The embedding queries over whole vectors against numpy."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def vectors():
    e = pd.read_parquet(DATA / "embeddings.parquet").sort_values("vec_id")
    assert list(e.vec_id) == list(range(len(e)))
    return np.array(e.embedding.tolist(), dtype=np.float64)


def plain(name, h, r, t, m):
    half = len(h) // 2
    c = lambda v: v[:half] + 1j * v[half:]
    return {
        "transe": lambda: -np.abs(h + r - t).sum(),
        "transe_l2": lambda: -np.sqrt(((h + r - t) ** 2).sum()),
        "distmult": lambda: (h * r * t).sum(),
        "complex": lambda: (c(h) * c(r) * c(t).conj()).real.sum(),
        "simple": lambda: ((h[:half] * r[:half] * t[half:]).sum() + (t[:half] * r[half:] * h[half:]).sum()) / 2,
        "rotate": lambda: -np.abs(c(h) * np.exp(1j * r[:half]) - c(t)).sum(),
        "transh": lambda: -np.abs(h - h @ r * r + r - t + t @ r * r).sum(),
        "transd": lambda: -np.abs(h + h @ t * r + r - t - t @ h * r).sum(),
        "transr": lambda: -np.abs(m @ h + r - m @ t).sum(),
        "rescal": lambda: h @ m @ t,
        "hole": lambda: sum(r[k] * (h * np.roll(t, -k)).sum() for k in range(len(h))),
        "analogy": lambda: (c(h) * c(r) * c(t).conj()).real.sum() + (h * r * t).sum(),
    }[name]()


@pytest.mark.parametrize("name", "transe transe_l2 distmult complex simple rotate transh transd transr rescal hole analogy".split())
def test_scores_use_whole_vectors(spark, vectors, name):
    n = len(vectors)
    got = {(r["head"], r.rel, r.tail): r.score for r in __spark_entry__.queries()[f"kge_{name}_whole"](spark, str(DATA)).collect()}
    assert set(got) == {(i, i % 7, (7 * i + 1) % n) for i in range(n)}
    for h, r, t in list(got)[::9]:
        m = vectors[(r * 64 + np.arange(64)) % n]
        assert got[h, r, t] == pytest.approx(plain(name, vectors[h], vectors[r], vectors[t], m), abs=2e-5)


def test_topk_and_rerank_take_all_queries_and_candidates(spark, vectors):
    n = len(vectors)
    heads = set(range(0, n, 20))
    top = {}
    for r in __spark_entry__.queries()["kge_topk_whole"](spark, str(DATA)).collect():
        top.setdefault(r["head"], []).append((r["rank"], r.candidate))
    assert set(top) == heads
    for h, xs in top.items():
        s = np.round((vectors[h] * vectors[h % 7]) @ vectors.T, 5)
        assert [s[c] for _, c in sorted(xs)] == pytest.approx(sorted(s, reverse=True)[:10], abs=2e-5)
    runs = {(r.qid, r.doc): r.score for r in __spark_entry__.queries()["kge_rerank_whole"](spark, str(DATA)).collect()}
    want = {(q, (q * 31 + k * 17) % n): k for q in range(n) for k in range(1, 13)}
    assert set(runs) == set(want)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert all(runs[q, c] == pytest.approx(0.5 * unit[q] @ unit[c] + 0.5 / k, abs=2e-5) for (q, c), k in want.items())


def test_candidates_come_from_all_rows(spark, tmp_path):
    v = np.random.default_rng(0).normal(size=(700, 64))
    pd.DataFrame({"vec_id": range(700), "embedding": list(v.astype(np.float32)), "label": 0}).to_parquet(tmp_path / "embeddings.parquet")
    docs = {r.doc for r in __spark_entry__.queries()["kge_rerank_whole"](spark, str(tmp_path)).select("doc").collect()}
    assert max(docs) >= 500
