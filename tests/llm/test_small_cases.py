"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arborq.llm import bpe, common, html_text, licenses, mixing, near_dedup, quality, sharding, topk, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and other things. " * 20_000


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a plain text of some words", "en", "s", 1), (2, None, "en", None, None), (3, "", None, "s", 0), (4, LONG, "en", "s", 1), (5, "a plain text of some words", "en", "t", 1)]
    return docs(spark, [*rows, rows[0], (None, "no id at all here today", "en", "s", 1)])


@pytest.fixture(scope="module")
def clashing(odd):
    names = ("score", "row", "key", "rows", "id", "label", "shard", "slot", "rank", "_pool", "_kept", "pool", "phase", "digest", "bands", "decoded", "ids", "quality", "toxic")
    return odd.withColumns({n: F.lit(7) for n in names})


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_matches_the_published_loop(spark):
    keys = [*range(200), -1, -5, 2**63 - 1, -(2**63), 123456789012345]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 40):
        got = df.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()
        assert all(r["s"] == jump(r["k"], n) for r in got)


def test_sharding(spark, clashing):
    rows = sharding.shard_documents(clashing).collect()
    assert len(rows) == 7
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["size"] == by[3]["size"] == 1 and by[2]["text_crc32"] == 0
    assert by[1]["text_crc32"] == zlib.crc32(b"a plain text of some words") and by[1]["size"] == 27
    assert by[None]["shard"] == jump(0, 16)
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    assert sharding.shard_documents(docs(spark, [])).isEmpty()
    same = sharding.shard_documents(docs(spark, [(9, "x", None, None, 1)] * 500))
    assert sorted(r["slot"] for r in same.collect()) == list(range(500))


def test_licenses(spark, clashing):
    mit = licenses.LICENSES[1][1]
    rows = [
        (1, "Copyright (c) 2001 Someone\n\n" + mit.upper().replace(",", " ,"), None, None, 1), (2, "text\nReleased under the MIT Licence!\nmore\nlicensed under cc by-nc 4.0", None, None, 1),
        (3, "text " + mit, None, None, 1), (4, None, None, None, 1), (5, mit.replace("\n\n", "\r\n \r\n"), None, None, 1), (6, "intro\n\n" + licenses.LICENSES[0][1].replace("\n\n", "\n"), None, None, 1),
    ]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, rows), licenses.digest_table(spark)).collect()}
    assert found[1]["whole"] and found[1]["licenses"] == ["MIT"] and found[5]["whole"]
    assert found[2]["licenses"] == ["CC-BY-NC-4.0", "MIT"] and not found[2]["whole"] and found[2]["n_units"] == 2
    assert found[3]["licenses"] == ["MIT"] and not found[3]["whole"] and found[4]["licenses"] == [] and found[6]["licenses"] == ["MIT"] and not found[6]["whole"]
    assert licenses.scan_licenses(clashing, licenses.digest_table(spark)).count() == 6
    assert licenses.scan_licenses(docs(spark, []), licenses.digest_table(spark)).isEmpty()


def test_bpe(spark, clashing):
    import public_tokenizers
    import tiktoken

    path = bpe.vocabulary()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    coded = bpe.decode(bpe.encode(clashing, path), path).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in clashing.collect()}
    assert len(coded) == 7
    for r in coded:
        assert r["ids"] == own.encode_ordinary(texts[r["doc_id"]]) and bytes(r["decoded"]).decode() == texts[r["doc_id"]]
        assert all(bytes(r["decoded"])[o:].startswith(own.decode_single_token_bytes(i)) for o, i in zip(r["offsets"][:50], r["ids"][:50], strict=True))
    assert bpe.digests(docs(spark, []), path).isEmpty()


def test_token_starts_and_windows_match_the_library(monkeypatch):
    import random

    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(bpe.vocabulary())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    texts = ["".join(r.choice(list(" \n\t'sdmtrvel12éß!. 　x中")) for _ in range(r.randrange(60))) for _ in range(2000)]
    want = [own.encode_ordinary(t) for t in texts]
    assert [x.tolist() for part in bpe.encode_texts(texts, ranks) for x in part] == want
    monkeypatch.setattr(bpe, "WINDOW", 25)
    assert [x.tolist() for part in bpe.encode_texts(texts, ranks) for x in part] == want
    piece = "ab" * 300 + "é" * 200
    assert bpe.merge_pairs(piece.encode(), ranks) == tuple(own.encode_ordinary(piece)[:0]) + bpe._merge_short(piece.encode(), ranks.get)


def test_topk(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(230)]
    rows += [(300, rows[5][1]), (301, rows[5][1]), (400, None), (500, [1.0, None, 2.0, 3.0]), (600, [float("nan")] * 4), (700, []), (800, [1.0, 2.0]), (200, rows[200][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("id", F.lit(2))
    got = {}
    for x in topk.top_k(df, query_block=2, candidate_block=40).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    fine = [(i, np.floor(1024 * np.array(v))) for i, v in rows if v and len(v) == 4 and None not in v and not np.isnan(v).any()]
    want = {}
    for q, v in fine:
        if q % 100 == 0:
            want[q] = sorted(((i, int(v @ w)) for i, w in fine if i != q), key=lambda p: (-p[1], p[0]))[:10]
    assert got == want
    assert topk.top_k(df.where("vec_id < 0")).isEmpty()
    assert topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")).collect()[0]["score"] == 2048 * 1024
    huge = spark.createDataFrame([(0, [1e30]), (1, [2e30])], "vec_id long, embedding array<double>")
    assert topk.top_k(huge).collect()[0]["score"] == 2**63 - 1


def test_toxicity(spark, clashing):
    import random

    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijkmnopqrstuvw") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        body = [r.choice(words) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            body[r.randrange(40)] = r.choice(["zorgle", "blafin" + r.choice("abcdef") + "x"])
        if i % 48 == 1:
            body[3:5] = ["nice", "zorgle"]
        rows.append((i, " ".join(body), "en", "s", 1))
        labels.append((i, int(not toxic), int(toxic)))
    train = docs(spark, rows)
    model = toxicity.train(spark, train, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scored = {x["doc_id"]: x["score"] for x in toxicity.score(train, model).collect()}
    right = sum((scored[i] >= 0.5) == bool(t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0)
    assert right >= 0.97 * sum(zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in labels)
    assert toxicity.fold("nice zorgle") in model.exceptions
    got = toxicity.score_texts(["you z0rgle", "you zоrgle", "you", "", None, "xzorgle", "nice zorgle"], model)
    assert got[0] == got[1] > 0.5 and max(got[2:]) < 0.5
    assert toxicity.score(clashing, model).count() == 7 and toxicity.score(docs(spark, []), model).isEmpty()
    blank = toxicity.fit(spark.createDataFrame([], "text string, label int"))
    assert toxicity.score_texts(["you utter idiot"], blank)[0] > 0.5 > toxicity.score_texts(["you"], blank)[0]


def test_quality(spark, clashing):
    import random

    r = random.Random(2)
    good = lambda: " ".join(r.choice(["one", "thing", "leads", "to", "another."]) for _ in range(r.randrange(5, 60)))
    bad = lambda: r.choice([good().upper().replace(" ", "!! "), good().replace(" ", " | "), good().replace(" ", "$$$ ")])
    rows = [(i, good() if i % 3 else bad(), "en", "s", 1) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(900)], "doc_id long, quality int, toxic int")
    model = quality.train(docs(spark, rows), labels)
    scored = {x["doc_id"]: x["score"] for x in quality.score(docs(spark, rows), model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((scored[i] >= 0.7) == (i % 3 > 0) for i in held) >= 0.97 * len(held)
    assert quality.score(clashing, model).count() == 7 and quality.score(docs(spark, []), model).isEmpty()
    assert len(quality.features("")) == len(quality.FEATURES)
    flat = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    assert flat.score(np.zeros((1, len(quality.FEATURES))))[0] == pytest.approx(0.5)


def test_minimum_cut_matches_brute_force():
    import itertools
    import random

    r = random.Random(3)
    for _ in range(300):
        n = r.randrange(1, 8)
        pull = [r.choice([-3, -2, -1, 0, 1, 2, 3]) * r.random() for _ in range(n)]
        edges = {(a, b): r.random() * 2 for a in range(n) for b in range(a + 1, n) if r.random() < 0.5}

        def cost(s, pull=pull, edges=edges):
            return sum(-p if p < 0 and x else p if p > 0 and not x else 0 for p, x in zip(pull, s, strict=True)) + sum(w for (a, b), w in edges.items() if s[a] != s[b])

        assert cost(html_text.minimum_cut(pull, edges)) == pytest.approx(min(map(cost, itertools.product([0, 1], repeat=n))))


PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body><header class=top><a href=/>Home</a></header><div id="cookie-notice">We use cookies. Accept them please, now.</div>'
    '<nav><ul><li><a href="/a">a</a></li></ul></nav><div class=content><h1>Title here</h1><p>Long paragraph of text, with many words &amp; a period that ends it properly.'
    '<p>Short.</p><div class="ad">Buy now! Great offer of the day, really good.</div><p>Another long\n paragraph,&nbsp;with <b>plenty</b> of words<script>x("<p>")</script> in it.</p>'
    "<form><p>Sign up for us.</p></form><!-- <p>gone</p> --></div><aside><p>Related stuff long text, that goes on and on and on for a while.</p></aside>"
    '<section class="comments"><p>I like this article very much, thank you for writing it.</p></section><footer>&copy; 2020</footer></body></html>'
)


def test_html(spark):
    want = "Title here\nLong paragraph of text, with many words & a period that ends it properly.\nShort.\nAnother long paragraph, with plenty of words in it."
    long = "<article>" + "<p>Some words of a long page, and more of them.</p>" * 3000 + "</article><nav>menu</nav>"
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (1, "u", PAGE), (4, "u", long), (5, "u", "<p <b")], "page_id long, url string, html string")
    got = html_text.extract(pages.withColumn("text", F.lit(3))).orderBy("page_id").collect()
    assert [r["text"] for r in got[:4]] == [want, want, "", ""] and got[4]["text"].count("\n") == 2999 and "menu" not in got[4]["text"]
    assert html_text.extract(pages.limit(0)).isEmpty()


def test_vectors(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 32))
    rows, n = [], 0
    for c in range(12):
        for _ in range(12):
            rows.append((n, [float(x) for x in centres[c] + r.normal(size=32) * r.choice([0.05, 0.2, 0.3])], c % 3))
            n += 1
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(40)] + [(2000, rows[0][1], None), (2001, None, 0), (2002, [0.0] * 32, 0), (2003, [float("nan")] * 32, 0), (2004, [1.0, 2.0], 0), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1)).withColumn("n", F.lit(1))
    got = {x["vec_id"]: x for x in vectors.near_duplicates(df, block=16).collect()}
    fine = {i: (np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if v and lab is not None and len(v) == 32 and not np.isnan(v).any() and any(v)}
    links = {(a, b) for a in fine for b in fine if a != b and fine[a][1] == fine[b][1] and fine[a][0] @ fine[b][0] >= 0.93}
    assert len(all_rows := vectors.near_duplicates(df.unionByName(df.limit(1).withColumn("vec_id", F.lit(None).cast("long"))), block=16).collect()) == len(rows) + 1
    assert [(x["n_links"], x["component_id"], x["kept"]) for x in all_rows if x["vec_id"] is None] == [(0, None, True)]
    found = sum(x["n_links"] for x in got.values())
    assert 0.9 * len(links) <= found <= len(links)
    for i, x in got.items():
        assert x["n_links"] <= sum(a == i for a, _ in links) and x["kept"] == (i == x["component_id"])
    assert len(got) == len({i for i, *_ in rows}) and all(got[i]["n_links"] == 0 for i in range(2000, 2005))
    assert vectors.near_duplicates(df.limit(0)).isEmpty()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 102), (102, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[100] == got[101] == got[102] == 100 and 200 not in got


def near_copies():
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper().replace(" ", ", "))]
    for i in range(3, 30):
        copy = list(base)
        for _ in range(4):
            copy[r.randrange(300)] = word()
        rows.append((i, " ".join(copy)))
    shared = [word() for _ in range(60)]
    rows += [(100 + i, " ".join([word() for _ in range(240)] + shared)) for i in range(30)]
    rows += [(200, "***"), (201, "***"), (202, "* *"), (203, None), (204, ""), (205, "  "), (206, "one two"), (207, "One, two!"), (208, "one three"), (1, " ".join(base))]
    return rows


def test_near_dedup(spark):
    rows = spark.createDataFrame(near_copies(), "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("rows", F.lit(1)).withColumn("key", F.lit(1))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(rows).collect()}
    assert all(got[i] == 1 for i in range(1, 30)) and all(got[100 + i] == 100 + i for i in range(30))
    assert got[201] == 200 and got[207] == 206 and all(got[i] == i for i in (202, 203, 204, 205, 208))
    kept = near_dedup.keep_one(rows.unionByName(rows.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == rows.columns and ids.count(1) == 1 and ids.count(None) == 1 and len(ids) == len(set(ids)) == 1 + len(set(got.values()))
    assert near_dedup.classes(rows.limit(0)).isEmpty()


def test_alignment_matches_the_textbook():
    import random

    def full(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j - 1] + (x != y), p[j] + 1, q[-1] + 1))
            p = q
        return p[-1]

    r = random.Random(2)
    for _ in range(800):
        a = [r.randrange(4) for _ in range(r.randrange(0, 14))]
        b = list(a)
        for _ in range(r.randrange(0, 6)):
            if b and r.random() < 0.5:
                b.pop(r.randrange(len(b)))
            else:
                b.insert(r.randrange(len(b) + 1), r.randrange(4))
        limit, d = r.randrange(0, 12), full(a, b)
        assert near_dedup.edits(a, b, limit) == d if d <= limit else limit < near_dedup.edits(a, b, limit) <= d
        k = r.randrange(1, 12)
        long, short = (a, b) if len(a) >= len(b) else (b, a)
        assert near_dedup._banded(long, short, k) == min(d, k + 1)


def test_mixing(spark, clashing):
    for weights in ({"a": 500, "b": 300, "c": 200}, {"a": 3, "b": 1, "c": 7, "d": 1}, {"x": 997, "y": 1, "z": 2}):
        (plan,), seen, total = mixing.ideals({s: Fraction(w) for s, w in weights.items()}, weights), dict.fromkeys(weights, 0), sum(weights.values())
        for t, (s, *_) in enumerate(plan.served(), 1):
            seen[s] += 1
            assert all(abs(seen[k] - w * t / total) < 1 for k, w in weights.items())
    got = mixing.mix(clashing, {"s": 3, "t": 1}).collect()
    assert len(got) == 7 and sorted(r["slot"] for r in got) == list(range(7)) and {r["row"]["score"] for r in got} == {7}
    assert {r["pool"] for r in got if r["row"]["source"] is None} == {"*"}
    rows = docs(spark, [(i, str(i), None, "abcde"[min(i % 10, 4)], 1) for i in range(3000)])
    targets = {"a": 5, "b": 1, "c": 1, "d": 2, "e": 1}
    mixed = sorted(mixing.mix(rows, targets).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in mixed] == list(range(3000))
    assert all(r["release"] <= r["turn"] == r["slot"] < r["deadline"] for r in mixed)
    assert abs(sum(r["row"]["source"] == "a" for r in mixed[:600]) - 300) <= 1
    coarse = sorted(mixing.mix(rows, targets, max_blocks=100).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in coarse] == list(range(3000)) and all(r["release"] <= r["turn"] < r["deadline"] for r in coarse)
    assert {(r["pool"], r["rank"]) for r in coarse} == {(r["pool"], r["rank"]) for r in mixed}
    assert mixing.in_order(mixing.mix(rows, targets)).columns == rows.columns
    assert mixing.mix(docs(spark, []), targets).isEmpty() and mixing.tempered_weights(docs(spark, [])) == {}


def test_pipeline_on_odd_rows(spark, clashing, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start, name in ((clashing, "odd"), (clashing.limit(0), "none")):
        now = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == start.columns
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            now = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
