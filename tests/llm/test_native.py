"""Native operators against plain Python, with nulls, empties, ties, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import license_scan, line_dedup, pii, quality_rules
from weftgraph.llm.common import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    d = spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)
    return d.withColumn("drop", F.lit("x")).withColumn("kept_", F.lit(1)) if extra else d


def texts(seed, n=60):
    rnd = random.Random(seed)
    lines = [" ".join(rnd.choice("alpha Beta gamma* É delta #x 42".split()) for _ in range(rnd.randint(0, 12))) for _ in range(12)]
    out = [None, "", " \t\n ", "\n\n", "x" * 50_000, "a " * 30_000, " ".join(f"w{i}" for i in range(20_000))]
    return out + ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 9))) for _ in range(n)]


def rows(seed):
    return [(i, t, [None, "en", "de"][i % 3], [None, "hot", "hot", "s"][i % 4]) for i, t in enumerate(texts(seed))]


def test_line_dedup_against_plain_python(spark):
    data = rows(1) + rows(1)[-5:]  # repeated rows
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t, *_ in data:
        for x in (t or "").split("\n"):
            if len(low(x)) >= 40:
                held[low(x)].add(i)
    gone = lambda i, x: len(held[low(x)]) >= 5 and max(held[low(x)]) != i if low(x) in held else False
    got = Counter((r.doc_id, r.kept_text, r.n_lines, r.n_dropped, r["drop"]) for r in line_dedup.dedup_lines(docs(spark, data, True)).collect())
    want = Counter()
    for i, t, *_ in data:
        x = (t or "").split("\n")
        keep = [y for y in x if not gone(i, y)]
        want[i, "\n".join(keep), len(x), len(x) - len(keep), "x"] += 1
    assert got == want and sum(k[3] for k in got) > 0


def test_quality_signals_against_plain_python(spark):
    data = rows(2)
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, data, True)).collect()}
    assert len(got) == len(data)
    for i, t, *_ in data:
        w = WORD.findall(t or "")
        win = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cov = {j for k in range(len(w) - 4) if win[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cov))
        assert r.base_failed == (len(w) < 10 or 100 * len(cov) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_quality_thresholds_adapt_to_the_group(spark):
    clean = " ".join(f"word{i}" for i in range(30))
    table = " | ".join(f"cell{i}" for i in range(30))
    data = [(i, clean, "en", "news") for i in range(120)] + [(200, table, "en", "news")] + [(300 + i, table, "en", "tables") for i in range(120)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs(spark, data)).collect()}
    assert all(kept[i] for i in range(120)) and not kept[200] and all(kept[300 + i] for i in range(120))


def test_quality_fences_differ_by_group_and_follow_its_quantiles(spark):
    """Fences come from the data alone: they differ between groups, and match quantiles taken by sorting."""
    rnd = random.Random(12)
    prose = lambda k: " ".join("x" * max(1, int(rnd.gauss(k, 1))) + rnd.choice(["", "", "", ","]) for _ in range(rnd.randint(40, 90)))
    data = [(i, prose(4 + (i % 3) * 2), "en", f"s{i % 3}") for i in range(600)] + [(1000 + i, " | ".join(["x" * 12] * 3 + [f"y{i}{j}" for j in range(20)]), "en", "s0") for i in range(5)]
    rows = cut(quality_rules._shares(quality_rules.signals(docs(spark, data)))).where("NOT base_failed")
    got = {r.source: r for r in quality_rules.thresholds(rows, prior=0).collect()}
    assert len({(round(r.lo_word_len, 6), round(r.hi_word_len, 6)) for r in got.values()}) == 3
    for r in got.values():
        own = sorted(x.word_len for x in rows.where(F.col("source") == r.source).collect())
        q1, q3 = own[len(own) // 4], own[3 * len(own) // 4]
        assert abs((r.hi_word_len + r.lo_word_len) - (q1 + q3)) < 0.1 and r.hi_word_len - q3 >= 4.5 * (q3 - q1)
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs(spark, data)).collect()}
    assert sum(kept[i] for i in range(600)) > 590 and not any(kept[1000 + i] for i in range(5))


def test_quality_of_a_source_that_is_mostly_copies(spark):
    rnd = random.Random(13)
    prose = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(60)) + "."
    one = prose()
    data = [(i, prose(), "en", f"s{i % 4}") for i in range(200)] + [(1000 + i, one, "en", "hot") for i in range(300)] + [(2000 + i, prose(), "en", "hot") for i in range(20)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs(spark, data)).collect()}
    assert all(kept[1000 + i] for i in range(300)) and sum(kept[2000 + i] for i in range(20)) >= 19


def test_license_base_and_templates(spark):
    data = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, "CC-BY and all rights reserved, ALL RIGHTS RESERVED"), (3, None), (4, "the apache license"), (5, "GNU General Public License v3"), (6, "éall rights reserved"), (7, "the GNU\nGeneral Public License, version 3"), (8, "Licensed under Apache License, Version 2.0 (the)")]
    d = spark.createDataFrame(data, "doc_id long, text string").withColumn("w", F.lit(1))
    r = {x.doc_id: x for x in license_scan.scan(d).collect()}
    assert r[1].labels == "apache-2.0" and r[1].n_base == 0 and r[1].score == 1.0 and r[1].first_word is None
    assert (r[2].n_base, r[2].first_word, r[2].last_word, r[2].base_labels) == (3, 0, 6, "cc-by,reserved")
    assert (r[3].n_words, r[3].labels, r[3].score) == (0, "", 0.0)
    assert r[4].labels == "" and r[5].base_labels == "gpl" and r[6].n_base == 0 and r[8].labels == "apache-2.0"
    assert "gpl" in r[7].labels


def test_license_join_is_exact(spark):
    """Every block that reaches the threshold is met; labels leave out templates that a better one explains."""
    rnd = random.Random(3)
    vocab = [f"v{i}" for i in range(12)]
    temps = {f"t{k}": " ".join(rnd.sample(vocab, 5 + k)) for k in range(4)}
    data = [(i, "\n".join(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 14))) for _ in range(3))) for i in range(80)]
    d = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_row", "w", "label", "blocks")})
    held = {(i, n, k): set(v.split()) & set(b.split()) for i, t in data for n, b in enumerate(t.split("\n")) for k, v in temps.items() if len(set(v.split()) & set(b.split())) >= 0.75 * len(set(v.split()))}
    size = {k: len(v.split()) for k, v in temps.items()}
    found = {(r.doc_id, r.line, r.label): (r.overlap, r.containment) for r in license_scan.matches(d, temps, 0.75).collect()}
    assert found == {x: (len(w), len(w) / size[x[2]]) for x, w in held.items()} and len(found) > 40
    rank = lambda x: (len(held[x]) / size[x[2]], size[x[2]], tuple(-ord(c) for c in x[2]))
    own = [x for x in held if not any(y[:2] == x[:2] and y != x and held[x] <= held[y] and rank(y) > rank(x) for y in held)]
    got = {x.doc_id: set(filter(None, x.labels.split(","))) for x in license_scan.scan(d, temps, 0.75).collect()}
    assert got == {i: {k for j, _, k in own if j == i} for i, _ in data}


def test_license_names_one_creative_commons_template(spark):
    data = [(1, "Licensed under CC BY 4.0."), (2, "x\nLicensed under CC BY-SA 4.0"), (3, "Licensed under CC BY-NC 4.0"), (4, "Copyright 2020, all rights reserved. Released under the MIT License")]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(data, "doc_id long, text string"), wrapped=True).collect()}
    assert got == {1: "cc-by,cc-by-4.0", 2: "cc-by,cc-by-sa-4.0", 3: "cc-by,cc-by-nc-4.0", 4: "copyright,mit-short,reserved"}
    assert {r.labels for r in license_scan.scan(spark.createDataFrame(data, "doc_id long, text string"), {}).collect()} == {"cc-by", "reserved"}


def test_license_of_wrapped_templates(spark, tmp_path):
    from weftgraph.llm import queries_native

    temps = license_scan.TEMPLATES
    words = {k: v.split() for k, v in temps.items()}
    data = [(f"{k} {n}", k, "Some title here\n\n" + "\n".join(" ".join(w[j : j + n]) for j in range(0, len(w), n)) + "\n\nthe end") for k, w in words.items() for n in (1, 2, 5, 12)]
    data += [("far", None, "Released today\n\nunder the\n\nLicense MIT"), ("long", None, "Released\n" + "other words again and again\n" * 9 + "under the MIT"), ("none", None, None)]
    spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(data)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.labels.split(",") for r in queries_native.op8_license_scan(spark, str(tmp_path)).collect()}
    for i, (name, k, _) in enumerate(data):
        assert k in got[i] if k else "mit-short" not in got[i], name


def plain_pii(x):
    out = []
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"), ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for i, (k, p) in enumerate(kinds):
        for m in re.finditer(p, x):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(q) > 255 for q in m[0].split(".")):
                continue
            if k == "phone" and not 10 <= len(d) <= 15:
                continue
            if k == "card":
                t = sum((2 * int(c) - 9 * (int(c) > 4)) if j % 2 else int(c) for j, c in enumerate(reversed(d)))
                if not 14 <= len(d) <= 19 or t % 10:
                    continue
            out.append((m.start(), i, m.end(), k))
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(out))


CASES = [None, "", "a@b.c_d@e.f", "x@y", "a.b+c@d-e.co.uk.", "é a@b.cé 1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.255 0.0.0.0", "4111 1111 1111 1111", "4111-1111-1111-1111 5500005555555559", "2024 4111111111111111", "+1 (017) 555-7713 +1+2 (((( +49 30 1234567 8", "+1 555", "1" * 40_000, "1." * 20_000, "a" * 60_000, "a@" * 20_000, "a@b" + ".c" * 20_000, "+1" + " (" * 20_000, "1 " * 20_000, "9" * 15 + "-" + "1" * 4]


def test_pii_base_spans(spark):
    rnd = random.Random(4)
    bits = ["a@b.co", "1.2.3.4", "4111111111111111", "+1 555 123 4567", " ", "-", ".", "é", "x", "0", "@", "+"]
    data = [(i, t) for i, t in enumerate(CASES + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 12))) for _ in range(300)])]
    d = spark.createDataFrame(data, "doc_id long, text string").withColumn("base", F.lit(0))
    got = {r.doc_id: r.b for r in pii.extract(d).select("doc_id", pii.written(F.col("base")).alias("b")).collect()}
    for i, t in data:
        assert got[i] == plain_pii(t or ""), t[:80]


def test_pii_bootstrap_finds_identifiers_in_learned_contexts(spark):
    rows = [(i, f"please call me at phone number: +1 555 {100 + i} {4000 + i} tomorrow") for i in range(30)] + [(100 + i, f"the order code {70000 + i} was sent") for i in range(30)]
    rows += [(200, "please call me at phone number: 0555-812-9911 tomorrow"), (201, "version 2024123 is out")]
    out = {r.doc_id: r.s for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert out[200].startswith("phone:") and out[201] == "" and all(out[100 + i] == "" for i in range(30))
    a, b = map(int, out[200].split(":")[1:])
    assert rows[60][1][a:b] == "0555-812-9911"


def test_pii_bootstrap_recall_of_unseen_identifiers(spark):
    """Identifiers that no base pattern takes, of each kind, in contexts that seeds of the kind have; and none elsewhere."""
    say = {"email": "write to {} for details", "ip": "from host {} port open", "card": "charged card {} on file", "phone": "call us: {} any time"}
    seed = {"email": "user{0}@site{0}.org", "ip": "10.0.{0}.7", "card": "4111 1111 1111 1111", "phone": "+49 30 1234{0:03d}5"}
    unseen = {"email": ["jane.doe@intranet", "j@host", "bob" * 30 + "@corp"], "ip": ["300.1.2.3", "10.1.2", "1.2"], "card": ["4111 1111 1111 1112", "1234 5678", "99-88-77"], "phone": ["0555 812 9911", "(030) 12 34", "12-34"]}
    luhn = lambda i: next(x for x in range(4111111111110000 + 20 * i, 4111111111110000 + 20 * i + 20) if sum((2 * int(c) - 9 * (int(c) > 4)) if j % 2 else int(c) for j, c in enumerate(reversed(str(x)))) % 10 == 0)
    texts_ = [say[k].format(luhn(i) if k == "card" else seed[k].format(i)) for k in say for i in range(12)]
    planted = [(k, x, say[k].format(x)) for k in say for x in unseen[k]]
    other = [f"the order {70000 + i} was sent, see {w}@x" for i, w in enumerate("abcdefgh")]
    rows = list(enumerate([*texts_, *(t for *_, t in planted), *other]))
    out = {r.doc_id: r.s for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    hit = {k: 0 for k in say}
    for n, (k, x, t) in enumerate(planted):
        hit[k] += f"{k}:{t.index(x)}:{t.index(x) + len(x)}" in out[len(texts_) + n].split(",")
    assert hit == {k: len(v) for k, v in unseen.items()}
    assert all(out[len(texts_) + len(planted) + n] == "" for n in range(len(other)))


def test_pii_running_folds(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        xs = [(7 * i) % 11 for i in range(n)]
        r = spark.createDataFrame([(xs,)], "x array<int>").select(pii._before(F.col("x"), 0, lambda a, b: a + b).alias("s"), pii._before(F.col("x"), 0, lambda a, b: F.greatest(a, b)).alias("m")).first()
        assert r.s == [sum(xs[:i]) for i in range(n)] and r.m == [max([0, *xs[:i]]) for i in range(n)]


@pytest.mark.parametrize("f", [lambda d: line_dedup.dedup_lines(d), lambda d: quality_rules.judge(d), lambda d: license_scan.scan(d), lambda d: pii.extract(d)])
def test_empty_tables(spark, f):
    assert f(docs(spark, [])).count() == 0


def test_line_dedup_digest(spark):
    r = line_dedup.dedup_lines(docs(spark, [(1, None, None, None)])).select(F.sha2("kept_text", 256).alias("s"), "n_lines").first()
    assert r.s == hashlib.sha256(b"").hexdigest() and r.n_lines == 1
