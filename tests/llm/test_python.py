"""Operators over Arrow batches, against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, decontam, graph, html_extract, ngram_join, packing, textops, toxicity
from weftgraph.llm.queries_python import TOKENIZER

EDGE = [None, "", "a", "A a", " \t\n", "b b b b", "x" * 70_000, " ".join(f"w{i % 50}" for i in range(30_000)), "É é", "a\x00b c", "a b"]


def test_word_hashes_tell_words_apart():
    table = bytes(range(256)).lower()
    col = pa.array([*EDGE, "y" * 3_000_000 + " z", "w " * 1_500_000])
    seen = {}
    for i, j, buf, offs in textops.blocks(col, 1 << 20):
        h, first = textops.word_hashes(buf, offs)
        for r in range(j - i):
            w = (col[i + r].as_py() or "").encode().translate(table).split()
            assert len(w) == first[r + 1] - first[r]
            for a, b in zip(w, h[first[r] : first[r + 1]].tolist()):
                assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def shingles(t):
    w = (t or "").encode().translate(bytes(range(256)).lower()).split()
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def brute(rows):
    s = {i: shingles(t) for i, t in rows}
    adj = {i: {j for j in s if j != i and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 60 * len(s[i] | s[j])} for i in s}
    comp = {}
    for i in sorted(s):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += adj[x]
    return {i: (len(s[i]), len(adj[i]), comp[i]) for i in s}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefghij") + str(rnd.randint(0, 9)) for _ in range(rnd.randint(2, 40))] for _ in range(20)]
    rows = list(enumerate(EDGE))
    for b in base:
        for _ in range(rnd.randint(1, 6)):
            c = list(b)
            for _ in range(rnd.randint(0, 6)):
                c[rnd.randrange(len(c))] = rnd.choice(["q", "z", "a1"])
            rows.append((len(rows), " ".join(c[: rnd.randint(1, len(c))] if rnd.random() < 0.3 else c)))
    d = spark.createDataFrame(rows + rows[-3:], "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("digest", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in ngram_join.similar(d).collect()}
    assert got == brute(rows)


def test_ngram_join_with_groups_over_the_block_limit(spark):
    rnd = random.Random(5)
    b = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(["x", "y"]) if rnd.random() < 0.08 else w for w in b)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = ngram_join.shingle_sets(d).where("chunk IS NULL")
    cls = sets.groupBy("digest", "key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("bits").alias("bits"))
    pairs = cls.select(F.col("key").alias("a")).join(cls.select(F.col("key").alias("b"))).where("a < b").withColumn("cell", F.pmod("b", F.lit(3)))
    want = {(i, j) for i, s in rows for j, t in rows if i < j and 100 * len(shingles(s) & shingles(t)) >= 60 * len(shingles(s) | shingles(t))}
    reps = {r.key: r.rep for r in cls.collect()}
    want = {(i, j) for i, j in want if {i, j} <= set(reps.values())}
    for given in (pairs, ngram_join.likely(pairs, cls, 4)):
        got = {tuple(sorted((reps[r.a], reps[r.b]))) for r in ngram_join.verified(d, given, cls, 4, block=200).collect()}
        assert got == want


@pytest.mark.parametrize("hot", [3, 7, 1000])
def test_ngram_join_candidates_lose_no_link(spark, hot):
    rnd = random.Random(hot)
    b = [[f"{k}w{i}" for i in range(40)] for k in range(3)]
    rows = [(i, " ".join(rnd.choice(["x", "y", "z"]) if rnd.random() < 0.1 else w for w in rnd.choice(b)[: rnd.randint(25, 40)])) for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    scan = ngram_join.shingle_sets(d)
    rank = spark.sparkContext.broadcast(ngram_join.rarity(scan.where("chunk IS NOT NULL").select("chunk", "counts"), ngram_join.LEAST_BUCKETS))
    keys = {r.doc_id: r.key for r in scan.where("chunk IS NULL").collect()}
    got = {(r.a, r.b) for r in ngram_join.candidates(d, rank, 3, hot=hot).collect()}
    s = {i: shingles(t) for i, t in rows}
    links = {tuple(sorted((keys[i], keys[j]))) for i in s for j in s if keys[i] != keys[j] and 100 * len(s[i] & s[j]) >= 60 * len(s[i] | s[j])}
    assert links and links <= got


def test_ngram_join_of_null_and_shared_ids(spark):
    rows = [(1, "a b c d"), (None, "a b c d"), (None, "a b c d"), (None, None), (2, "a b c d"), (3, "x y"), (3, "a b c d")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_gone": F.lit(1), "component_id": F.lit("x"), "node": F.lit(0)})
    out = sorted((r.doc_id or -1, r.n_shingles, r.n_similar, r.component_id) for r in ngram_join.similar(d).collect())
    assert out[:3] == [(-1, 0, 0, None), (-1, 3, 0, None), (-1, 3, 0, None)] and len(out) == 6
    kept = ngram_join.keep_one(d)
    assert kept.columns == d.columns and sum(r.doc_id is None for r in kept.collect()) == 3


def test_keep_one_and_components(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, "x y z"), (4, None), (5, None)]
    kept = {r.doc_id for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1, 3, 4, 5}
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 100)], "a long, b long")
    c = {r.node: r.component for r in graph.components(e).collect()}
    assert all(c[i] == 0 for i in range(41)) and {c[90], c[95], c[100]} == {90}


def test_ngram_join_plans_stay_small_for_the_driver(spark, monkeypatch):
    """The driver holds the shuffles of one plan and the metrics of its tasks at once: no plan has many."""
    exchanges, cut = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange "), ngram_join.cut
    seen = []
    for m in (ngram_join, graph):
        monkeypatch.setattr(m, "cut", lambda df: seen.append(exchanges(df)) or cut(df))
    rows = [(i, f"a b c d e f {i // 3} g h {i % 2}") for i in range(30)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert max(seen) <= 8 and exchanges(kept) <= 3
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, _, c) in brute(rows).items() if i == c}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert ngram_join.similar(d).count() == 0 and decontam.matches(d, b).count() == 0 and packing.pack_documents(d, TOKENIZER).count() == 0
    assert toxicity.score(d, toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.digests(chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyz")
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 5, 8, 20, 40, 12, 15])] + [(98, None), (99, "!!")]
    rows = list(enumerate(EDGE))
    for k in range(60):
        w = [word() for _ in range(rnd.randint(0, 80))]
        it = (rnd.choice(items)[1] or "").split()
        a = rnd.randint(0, len(it) // 2)
        at = rnd.randint(0, len(w))
        rows.append((len(rows), " ".join(w[:at] + [x.upper() + rnd.choice(["", ",", "."]) for x in it[a:]] + w[at:])))
    norm = lambda t: "".join(c.lower() if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in t or "").split()
    win = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for k, t in items:
        w = norm(t)
        if w:
            n = min(5, len(w))
            s = win(w, n)
            want |= {(i, k) for i, x in rows if 2 * len(s & win(norm(x), n)) >= len(s)}
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(7))
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.matches(d, b).collect()} == want
    assert {(r.doc_id, r.item_id) for r in decontam.matches(d, b, block=40).collect()} == want  # several blocks
    assert {r.doc_id for r in decontam.drop_contaminated(d, b).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_toxicity_learns_words_stems_and_disguises(spark):
    rnd = random.Random(7)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("ran", "tos", "lim")]
    bad = ["gruntle", "snarkle", "vexomat"]
    rows, labels = [], []
    for i in range(600):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(5, 60))]
        toxic = i % 5 == 0
        for _ in range(rnd.randint(1, 3) if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice([bad[0], bad[1], bad[2] + rnd.choice(["ic", "oid", "ers"])]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.train_fold(d, y)
    out = {r.doc_id: r for r in toxicity.score(d, m).withColumn("h", toxicity.held_out()).collect()}
    for i in out:
        assert out[i].h == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert np.mean([(out[i].score >= 0.5) == bool(t) for i, t in labels if out[i].h]) > 0.95
    hit = m.score("a gruntle here")
    assert hit >= 0.5 and m.score("a GRUNTLE! here") >= 0.5 and m.score("a grυntle here") >= 0.5 and m.score("a grunt1e snark1e here") >= 0.0
    assert m.score(None) == m.score("") == m.score("bara ran") < 0.5 and m.score("xgruntle") < 0.5
    m.exceptions |= {"gruntle park"}
    m._auto = None
    assert m.score("a gruntle park") < 0.5
    kept = {r.doc_id for r in toxicity.keep_clean(d.withColumn("score", F.lit(3)), m).collect()}
    assert kept == {i for i in out if out[i].score < 0.5 or i in kept}


def test_toxicity_of_long_and_repeated_texts(spark):
    import time

    m = toxicity.Model({"gruntle": 5.0, "snark*": 4.0}, slope=1.0, offset=-2.0)
    began = time.perf_counter()
    for x in ("1", "!", "a", "a1", "1 ", "!!a ", "g", "gruntle", "é"):
        toxicity.fold(x * (1_000_000 // len(x)))
    assert time.perf_counter() - began < 5.0
    assert toxicity.fold("h3ll0 2024 a1! 1a 3" + "!" * 9) == "hell0 2024 a1! ia 3" + "!" * 9
    texts = ["1" * 100_000, "!" * 100_000, "a " * 50_000, None, "", "gruntle " * 20_000, "x" * 100_000 + " gruntle"]
    rows = [(i % 7, texts[i % 7]) for i in range(14)]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit(1)), m).collect()
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add(r.score)
    assert len(out) == 14 and all(len(v) == 1 and v == {m.score(texts[i])} for i, v in by.items())
    assert m.score(texts[5]) > 0.5 > m.score(texts[0]) == m.score(None)


def test_toxicity_learns_exceptions_of_every_word(spark):
    """Pairs with clean documents only are exceptions whatever the alphabet says, for word beginnings too."""
    w = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows, labels = [], []
    for i in range(400):
        rows.append((i, f"{w(i)}p zzgruntler q{w(i)}" if i % 2 else f"{w(i)}k {w(7 * i)}m {w(11 * i)}n"))
        labels.append((i, i % 2))
    for k in range(8):
        rows.append((1000 + k, f"old{'abcdefgh'[k]} zzgruntler gate"))
        labels.append((1000 + k, 0))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.train(d, y)
    assert {f"old{c} zzgruntler" for c in "abcdefgh"} <= m.exceptions and "zzgru*" in m.weights
    assert m.raw("olda zzgruntler") == 0 < m.raw("some zzgruntler")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="nav-open"><nav><ul><li><a href="/a">Home</a></li><li>Plain</li></ul></nav>
<div class="cookie-notice">We use cookies on this site.</div><article><h1>Head &amp; line</h1><p><b>First   para &lt;x&gt;<br>more<p>Second <a href="/x">link</a> here.</p><aside>Side words</aside><form><label>Name</label><input></form>
<p>One.</p></article><section id="comments"><p>Nice article, thank you all very much indeed for it.</p></section><!-- <p>gone</p> --><footer>&copy; x</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "word " * 30_000), (5, "u", "a < b & c &am"), (6, "u", "<article><p>cut <b>off <i"), (7, "u", '<article><p title="a > b">ok</p><p title="x>fine</p></article>'), (8, "u", "<" * 20_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {r.page_id: r for r in html_extract.extract(d).collect()}
    assert out[1].text == "Head & line\nFirst para <x> more\nSecond link here.\nOne." and out[1].n_chars == len(out[1].text)
    assert out[2].text == out[3].text == "" and out[6].text == "cut off" and out[7].text == "ok\nfine"
    assert out[4].n_chars == 5 * 30_000 - 1
    assert all(html_extract.classify(x) == y for x, y in html_extract.LABELLED)


def test_html_tree_reads_the_neighbours():
    def used(t):
        return {t[0]} | used(t[2]) | used(t[3]) if isinstance(t, tuple) else set()

    assert used(html_extract.tree()) & {2, 3, 4, 5}
    short = lambda before, after: html_extract.classify((4, 0.0, *before, *after, 0, 0, 0))
    assert short((50, 0.0), (40, 0.0)) == 1 and short((2, 1.0), (3, 1.0)) == short((50, 0.0), (2, 1.0)) == 0


def test_html_of_labelled_pages():
    """Whole pages with and without an article: (html, main text)."""
    long = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    menu = '<div><a href="/a">Home</a></div><div><a href="/b">About</a></div>'
    pages = [
        (f'<body class="layout has-sidebar"><div class="layout has-sidebar"><article><p>Short one.</p><p>{long("a")}</p></article></div></body>', f"Short one.\n{long('a')}"),
        (f'<article><div class="entry-header"><h1>Title here</h1></div><p>{long("a")}</p><div class="post-comments"><p>Great post!</p></div></article>', f"Title here\n{long('a')}"),
        (f'{menu}<div><p>{long("a")}</p><p>And so.</p><p>{long("b")}</p></div>{menu}<div>All rights kept.</div>{menu}', f"{long('a')}\nAnd so.\n{long('b')}"),
        (f'{menu}<p>Read this short notice about our new opening hours now</p>{menu}<div id="sidebar"><p>{long("s")}</p></div><p>{long("a")}</p>', long("a")),
        (f'<div class="content"><div class="ad">Buy {long("x")}</div><p>{long("a")}</p></div><aside>{long("y")}</aside><footer>{long("z")}</footer>', long("a")),
    ]
    for html, want in pages:
        assert html_extract.main_text(html) == want, html[:60]


def _best_fit(lengths, capacity):
    free = []
    for x in sorted(lengths, reverse=True):
        k = min((f, i) for i, f in enumerate([*free, capacity]) if f >= x)[1]
        if k == len(free):
            free.append(capacity)
        free[k] -= x
    return len(free)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(8)
    rows = list(enumerate([*EDGE, "don't 'sfoo <|endoftext|> x", "İ H̱ ẖ ÀÇ ß", "1<|startoftext|> 22"])) + [(100 + i, " ".join(rnd.choice(["Alpha,", "beta", "Größe", "42", "it's"]) for _ in range(rnd.randint(0, 3000)))) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(1))
    t, by, seqs = Tokenizer.from_file(TOKENIZER), defaultdict(list), defaultdict(list)
    got = packing.pack_documents(d, TOKENIZER).collect()
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted((p.piece, p.start, p.length, p.ids_crc32) for p in by[i]) == want
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) <= _best_fit([r.length for r in got], 2048)


def test_packing_covers_any_histogram():
    rnd = random.Random(9)
    for _ in range(5):
        h = {rnd.randint(1, 200): rnd.randint(1, 50) for _ in range(40)}
        plan = packing.solve(h, 200)
        got = Counter()
        for n, c in plan:
            assert n > 0 and sum(k * m for k, m in c.items()) <= 200
            for k, m in c.items():
                got[k] += m * n
        assert got == Counter(h) and packing.lower_bound(h, 200) <= sum(n for n, _ in plan) <= _best_fit(list(Counter(h).elements()), 200)


def test_packing_weights_move_with_many_lengths():
    """Prices learn what lags however many lengths there are: the fractional solution is well below that of the first prices."""
    rnd = random.Random(10)
    h = Counter(rnd.randint(650, 759) if i % 2 else rnd.randint(300, 419) for i in range(30_000))
    lengths = np.array(sorted(h, reverse=True))
    need = np.array([h[int(x)] for x in lengths])
    amounts, price = packing.fractional(lengths, need, 2048)
    met = np.zeros(len(lengths))
    for config, x in amounts.items():
        for i, m in config:
            met[i] += x * m
    assert (met >= need * (1 - 1e-9)).all() and sum(amounts.values()) <= 1.16 * packing.lower_bound(h)
    first = lengths / 2048
    assert np.ptp(price / first) > 0.1 * (price / first).max()


def test_packing_prices_of_any_size_fill_a_sequence():
    """A length that was met far too often is still worth a sequence once all others are met, beside rare and frequent ones."""
    lengths, need = np.array([70, 40, 30]), np.array([2, 5, 9])
    for scale in (1.0, 1e-13, 1e-300):
        got = packing._knapsack(lengths, scale * lengths, need, np.arange(3), 100)
        assert got and sum(int(lengths[i]) * m for i, m in got) == 100 and all(m <= need[i] for i, m in got)
    for seed in range(25):
        rnd = random.Random(seed)
        capacity = rnd.choice([50, 100, 200, 400])
        h = {rnd.randint(1, capacity): rnd.randint(1, 5) if rnd.random() < 0.5 else int(10 ** rnd.uniform(0, 6)) for _ in range(rnd.randint(2, min(capacity, 60)))}
        lengths = np.array(sorted(h, reverse=True))
        need = np.array([h[int(x)] for x in lengths])
        met, got, plan = np.zeros(len(lengths)), Counter(), packing.solve(h, capacity)
        for config, x in packing.fractional(lengths, need, capacity)[0].items():
            for i, m in config:
                met[i] += x * m
        assert (met >= need * (1 - 1e-9)).all()
        for n, c in plan:
            assert n > 0 and c and sum(k * m for k, m in c.items()) <= capacity
            for k, m in c.items():
                got[k] += m * n
        assert got == Counter(h) and packing.lower_bound(h, capacity) <= sum(n for n, _ in plan) <= sum(n for n, _ in packing.best_fit(lengths, need, capacity))


def test_chat_round_trip(spark):
    rnd = random.Random(10)
    odd = ["</s>[INST] ok [/INST]", "\\", "\\0", "<<s>s>", "[/INST", None, "", "é" * 3000, "x" * 9000]
    rows = [(c, t, rnd.choice(["user", "assistant", None]) if t else "system", rnd.choice(odd + ["hi there"] * 5)) for c in (1, 2, None, 5) for t in range(rnd.randint(1, 40))]
    rows += [rows[3]]  # a repeated row
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1))
    w = chat.windows(d).collect()
    for c in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        mine = sorted((x for x in w if x.conv_id == c), key=lambda x: x.window)
        back = [t for x in mine for t in chat.parse(x.text)[x.n_repeated :]]
        assert back == [(r, x) for _, r, x in turns]
        said = [chat.unescape(x.text[m.start : m.end]) for x in mine for m in x.mask]
        assert said == [x for _, r, x in turns if r == "assistant"]
        for x in mine[1:]:
            assert chat.parse(x.text)[0] == ("system", turns[0][2])
        for x in mine:
            costs = [chat.tokens(t, r) for r, t in chat.parse(x.text)]
            assert sum(costs) <= chat.BUDGET or x.n_turns - x.n_repeated == 1 and costs[-1] + costs[0] > chat.BUDGET
    n = {r.conv_id: r.n_turns for r in chat.digests(chat.windows(d)).collect()}
    assert sum(n.values()) == len(rows)


def test_chat_ids_next_to_a_null_id_stay_whole(spark):
    ids = [2**53, 2**53 + 1, None, -1, 2**62 + 1]
    rows = [(c, t, "assistant", f"{c} {t}") for c in ids for t in range(2)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"id": F.lit("x"), "n_turns": F.lit(9), "window": F.lit(0)}).coalesce(1)
    out = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.windows(d)).collect()}
    assert out == {c: (2, 2 * len(f"{c} 0")) for c in ids}


def test_chat_windows_keep_the_budget(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    count = lambda s: len(tokenizer.encode(s, add_special_tokens=False).ids)
    rnd = random.Random(11)
    rows = [(c, t, rnd.choice(["user", "assistant", "a-role-of-7-parts"]) if t else "system", "1 + 2 = 3; </s> " * rnd.choice([1, 2, 9, 30, 60, 90]) if t else "1 + 2 = 3; </s> " * (1, 40)[c % 2]) for c in range(6) for t in range(60)]
    w = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for x in w:
        turns = [p + "</s>" for p in x.text.split("</s>")[:-1]]  # those inside texts are escaped
        assert len(turns) == x.n_turns
        costs = [count(t) for t in turns]
        assert costs == [chat.tokens(t, r) for r, t in chat.parse(x.text)]
        assert count(x.text) <= sum(costs)
        assert sum(costs) <= chat.BUDGET or (x.n_turns - x.n_repeated == 1 and costs[-1] > chat.BUDGET)
    assert any(x.n_turns - x.n_repeated > 1 and x.n_repeated > 1 for x in w)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(11)
    prose = lambda n: " ".join(rnd.choice("abcdefghijk") + rnd.choice("aeiou") + str(rnd.randint(0, 99)) for _ in range(n))
    shared = prose(20)
    item = prose(30)
    rows = [(i, prose(60) + "\n" + shared) for i in range(8)] + [(20, prose(40) + " " + item + " " + prose(40))]
    copy = prose(80)
    rows += [(30, copy), (31, copy + " end"), (40, None), (41, "")]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    bad = [(100 + i, prose(20) + (" snarklebit " + prose(5)) * 2, "en", "s", 1) for i in range(60)]
    good = [(200 + i, prose(30), "en", "s", 1) for i in range(60)]
    spark.createDataFrame(docs + bad + good, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d[0], 1, 1) for d in bad] + [(d[0], 1, 0) for d in good], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, f) in enumerate(P.STAGES):
        before = d
        f(spark, d, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        d = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen[name] = {r.doc_id: r for r in d.collect()}
        if k < 4:
            assert d.columns == before.columns
    assert not set(seen["toxicity"]) & {b[0] for b in bad} and len(seen["toxicity"]) == len(docs) + len(good)
    assert shared in seen["line_dedup"][7].text and shared not in seen["line_dedup"][0].text and seen["line_dedup"][0].n_chars == len(seen["line_dedup"][0].text)
    assert 30 in seen["ngram_join"] and 31 not in seen["ngram_join"] and 20 in seen["ngram_join"] and 20 not in seen["decontamination"]
    assert set(seen["packing"]) == set(seen["decontamination"]) >= {40, 41}
    assert P.run(spark, str(tmp_path)).count() >= len(seen["packing"])


def test_pipeline_packs_rare_lengths_beside_frequent_ones(spark, tmp_path):
    import corpus_pipeline as P

    h = {310: 2, 503: 1, 89: 1, 6: 1, 160: 2, 115: 165, 78: 1, 92: 1, 291: 58, 348: 81, 543: 2, 201: 1}
    rows = [(i, "a " * (n - 1)) for i, n in enumerate(Counter(h).elements())]
    seqs = defaultdict(list)
    for r in P.pack(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect():
        seqs[r.sequence_id].append((r.offset, r.length))
    assert Counter(n for v in seqs.values() for _, n in v) == Counter(h)
    for v in seqs.values():
        assert all(o + n == p for (o, n), (p, _) in zip(sorted(v), [*sorted(v)[1:], (sum(n for _, n in v), 0)])) and sum(n for _, n in v) <= 2048
    assert len(seqs) == packing.lower_bound(h)


def test_filters_keep_clashing_columns_null_ids_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    line = "a line that is long enough to be counted by all of them"
    rows = [(None, line), (None, None)] + [(i, f"{line}\nown text {i} " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    extra = {c: F.lit("x") for c in ("_drop", "_gone", "_id", "_kept", "_all", "kept_text", "n_lines", "component_id", "k", "n")}
    d = d.withColumns(extra)
    for _, stage in P.STAGES[:4]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns and sum(r["doc_id"] is None for r in out.select("doc_id").collect()) == 2
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
    got = {r["doc_id"]: r["text"] for r in P.drop_repeated_lines(spark, d, str(tmp_path)).select("doc_id", "text").collect()}
    assert line in got[5] and all(line not in got[i] for i in range(5))


def test_decontamination_keeps_ids_of_any_type(spark):
    items = [("q1", "one two three four five six seven"), (None, "aa bb cc dd ee ff gg"), ("", "x")]
    d = spark.createDataFrame([("d1", "so one two three four five six seven it is"), (None, "AA bb cc dd ee ff gg"), ("d3", "nothing")], "doc_id string, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(d, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got == {("d1", "q1"), (None, None)}
