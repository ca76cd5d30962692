"""Readers and writers, and the stream scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.model import Graph
from weftgraph.sources import files
from weftgraph.streaming import incremental


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_triples_types_and_patterns(spark, tmp_path):
    t = files.read_triples(spark, put(tmp_path, "t", " a \tr\tb\n\tr\tx\nc\tr\td \n"))
    assert rows(t) == [("a", "r", "b"), ("c", "r", "d")]
    files.write_triples(t, str(tmp_path / "o"))
    assert rows(files.read_triples(spark, str(tmp_path / "o"))) == rows(t)
    assert rows(files.read_ids(spark, str(tmp_path / "none"))) == []
    assert rows(files.read_ids(spark, put(tmp_path, "i", "1\t2\t3\n1\t2\t3\n"))) == [(1, 2, 3)]
    ty = files.read_types(spark, put(tmp_path, "e", "a\tX;Y\nb\nc\tX\n"), spark.createDataFrame([("X",)], "k string"))
    assert rows(ty) == [("a", "X"), ("c", "X")]
    assert rows(files.read_pattern_set(spark, put(tmp_path, "s", "<r>\n<q>\n<r>\n"))) == [("q",), ("r",)]
    assert rows(files.read_pattern_map(spark, put(tmp_path, "m", "<r>\t<a>@@<b>\n"))) == [("r", "a"), ("r", "b")]
    p = put(tmp_path, "p", '<r>\tC"D"\n<r>\tD"E"\n')
    assert rows(files.read_positive_patterns(spark, p)) == [("r", "D")]
    assert rows(files.read_positive_patterns(spark, p, last=True)) == [("r", "D"), ("r", "E")]


def test_loose_triples(spark, tmp_path):
    t = files.read_loose_triples(spark, put(tmp_path, "l", "a r b\na\tr\tb c\t.\nx r y 0.5\nq r one two three\nz\tr\tz\n"))
    assert rows(t) == sorted([("a", "r", "b", 1.0), ("a", "r", "b c", 1.0), ("x", "r", "y", 0.5), ("q", "r", "one_two_three", 1.0), ("z", "r", files.SELF, 1.0), (files.SELF, "r", "z", 1.0)])


def test_rules_and_rankings(spark, tmp_path):
    p = put(tmp_path, "rules", "10\t7\t0.7\tp(X,Y) <= q(X,A), s(A,Y)\n9\t1\t0.1\tp(X,Y) <= q(X,Y)\n5\t4\t0.8\tp(X,c) <= q(X,d)\n")
    r = files.read_rules(spark, p)
    assert rows(r, "predicted", "kind") == [(5, "acyclic1"), (10, "cyclic")] and files.read_refinable(spark, p).count() == 1
    files.write_rules(r, str(tmp_path / "out"))
    assert rows(files.read_rules(spark, str(tmp_path / "out"))) == rows(r)
    k = files.read_rankings(spark, put(tmp_path, "rank", "a r b\nHeads: x\t0.5\ty\t0.4\t\nTails: b\t0.9\t\nc r d\nHeads: \nTails: e\t0.1\t\n"), "Heads")
    assert rows(k, "h", "candidate", "score", "rank") == [("a", "x", 0.5, 1), ("a", "y", 0.4, 2)]
    assert rows(files.ranked_triples(k)) == [("x", "r", "b", 0.5), ("y", "r", "b", 0.4)]


def test_other_formats(spark, tmp_path):
    t = spark.createDataFrame([("a", "r", "b"), ("c", "q", "d")], "h string, r string, t string")
    files.write_bracketed(t, str(tmp_path / "b"))
    assert rows(files.read_bracketed(spark, str(tmp_path / "b"))) == rows(t)
    ids = spark.createDataFrame([(1, 2, 3)], "head long, rel long, tail long")
    files.write_counted_ids(ids, str(tmp_path / "c"))
    assert rows(files.read_counted_ids(spark, str(tmp_path / "c"))) == [(1, 2, 3)]
    types = spark.createDataFrame([("a", "X")], "ent string, cls string")
    files.write_ntriples(t, types, str(tmp_path / "n"))
    nt = files.read_ntriples(spark, str(tmp_path / "n"))
    assert rows(files.ntriples_types(nt, spark.createDataFrame([("X",)], "k string"))) == [("a", "X")]
    assert rows(files.ntriples_relations(nt, spark.createDataFrame([("r",), ("q",)], "k string"), ["q"])) == [("a", "r", "b")]
    lit = files.read_literals(spark, put(tmp_path, "s1", "a\tshort\nb\tonly\n"), put(tmp_path, "s2", "a\tlong\n"))
    assert rows(lit) == [("a", "long"), ("b", "only")]
    assert rows(files.read_word_vectors(spark, put(tmp_path, "w", "2 3\nx 1.0 2.0\n"))) == [("x", [1.0, 2.0])]
    j = put(tmp_path, "j.json", '[{"ruleId": "1", "predicate": "p", "premise_triples": [{"subject": "s", "predicate": "q", "object": "o"}], "human_confidence": 0.1, "computed_confidence": 0.9}]')
    assert files.read_negative_rules(spark, j, ["p"], confidence=0.5).count() == 1 and files.read_negative_rules(spark, j, ["z"]).count() == 0
    files.write_types(types, str(tmp_path / "ty"))
    assert rows(files.read_types(spark, str(tmp_path / "ty"))) == [("a", "X")]


def test_stream_scan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "1.tsv", "a\tf\tc\nx\tf\ty\n")
    acc = spark.createDataFrame([("a", "f", "b")], "h string, r string, t string")
    g = Graph(acc, spark.createDataFrame([], "ent string, cls string"), None, {"functional": spark.createDataFrame([("f",)], "k string")})
    seen = []
    stream = spark.readStream.schema("h string, r string, t string").csv(str(tmp_path / "in"), sep="\t")
    incremental.scan_stream(stream, lambda: g, lambda df, n: seen.extend(rows(df, "h", "t", "is_valid")), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [("a", "c", False), ("x", "y", True)]
    ev = spark.readStream.schema("r string, at timestamp").csv(str(tmp_path / "in"), sep="\t")
    assert incremental.relation_rates(ev, "at").isStreaming and F is not None
