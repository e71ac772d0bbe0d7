"""Personal data, Orchard clustering and fill-in-middle against plain versions, and on odd rows."""

import hashlib
import os
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborq.llm import fim, html_text, orchard, pii, topk, vectors

TABLES = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables are not here")
LONG = "word é and 😀 things, 10.1.2.3. " * 3_000


def luhn(digits):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def base_spans(text):
    """The base rules of personal data, with Python's regular expressions."""
    out = []
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t, d: all(int(x) <= 255 for x in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t, d: 14 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t, d: 10 <= len(d) <= 15),
    ]
    for place, (kind, pattern, good) in enumerate(rules):
        out += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text or "") if good(m[0], re.sub("[^0-9]", "", m[0]))]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def found(spark, texts, **names):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r for r in pii.find(rows).orderBy("doc_id").collect()]


@here
def test_pii_of_the_documents(spark):
    got = {r["doc_id"]: r for r in pii.op11_pii(spark, TABLES).collect()}
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        want = base_spans(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [got[r["doc_id"]][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [want.count(f"{k}:") for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, want.split(","))) <= set(got[r["doc_id"]]["spans"].split(","))


def test_pii_base_on_odd_texts(spark):
    rng = np.random.default_rng(5)
    fuzz = ["".join(rng.choice(list("ab1249.@+-() _%é😀\n"), 120)) for _ in range(150)]
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111 4111111111111111", "1.2.3.4.5.6.7.8", "000001.2.3.0255", "1.2.3.256"]
    mails = ["a@b.c.@d.e", "a@b@c.d", "@a.b", "x" * 5000 + "@y.z", "a@b." + "c." * 4000, "a@b.c_d@e.f", "\x01a@b.c\x02 \x031.1.1.1\x01"]
    phones = ["+1 (017) 555-7713", "+1234567890123456", "++1 234 567 8901", "+1" + " " * 5000 + "2", "+49 30 123456.", "é+1 234 567 8901😀"]
    texts = [*fuzz, *cards, *mails, *phones, None, "", LONG, "1" * 5000]
    for r, t in zip(found(spark, texts), texts, strict=True):
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii"] if s["base"]) == base_spans(t), t


def test_pii_adds_confirmed_spans(spark):
    texts = ["cards 4111111111111111 4111111111111111 end", "IBAN DE89 3704 0044 0532 0130 00 and", "BE71 0961 2345 6769 AND", "DE88 3704 0044 0532 0130 00", "please call (017) 555-7713 now", "section 017-555-7713", "+1 (017) 555-7713"]
    added = [[(s["kind"], t[s["start"] : s["end"]]) for s in r["pii"] if not s["base"]] for r, t in zip(found(spark, texts), texts, strict=True)]
    assert added == [
        [("card", "4111111111111111")] * 2, [("iban", "DE89 3704 0044 0532 0130 00")], [("iban", "BE71 0961 2345 6769")], [], [("phone", "(017) 555-7713")], [], [],
    ]
    near, far = found(spark, ["my phone +1 234 567 8901", "order +1 234 567 8901"])
    assert near["pii"][0]["score"] > pii.ACCEPT > far["pii"][0]["score"] and far["pii"][0]["base"]


def test_pii_columns_and_empty(spark):
    rows = spark.createDataFrame([(1, "a@b.cd", 7, 8)] * 2 + [(None, None, 7, None)], "doc_id int, text string, pii int, row int")
    got = pii.find(rows.withColumns({c: F.lit(1) for c in ("clean", "part0", "each", "lead0", "kind")})).collect()
    assert len(got) == 3 and {len(r["pii"]) for r in got} == {0, 1} and got[0]["row"] in (8, None)
    assert pii.find(rows.where("false")).count() == 0


def plain_clusters(x, ids, k=8, rounds=10):
    first = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"3:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), x[i]))[:k]
    centroids = [list(x[i]) for i in first]
    away = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for step in range(rounds + 1):
        given = [min((away(v, c), n) for n, c in enumerate(centroids)) for v in x]
        if step < rounds:
            for n in range(len(centroids)):
                mine = [v for v, g in zip(x, given, strict=True) if g[1] == n]
                if mine:
                    centroids[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return given, centroids


def test_orchard_equals_plain_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(90, 4)), 1).tolist()
    x[40:60] = [x[3]] * 20  # many equal vectors
    ids = [*range(88), 7, None]
    bad = [(100, None), (101, [1.0]), (102, [1.0, 2.0, 3.0, float("nan")]), (103, [1.0, float("inf"), 0.0, 0.0]), (104, [1.0, None, 0.0, 0.0]), (105, [])]
    rows = spark.createDataFrame([*zip(ids, x, strict=True), *bad], "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "row": F.lit(1), "v": F.lit(2)})
    for big in (1.0, 1e14):
        got = orchard.cluster(rows.withColumn("embedding", F.transform("embedding", lambda v: v * big)), dimensions=4).collect()
        whole = [[int(np.floor(np.float64(v) * big * 1024)) for v in row] for row in x]
        given, centroids = plain_clusters(whole, ids)
        top = (1 << 63) - 1
        want = sorted((str(i), n, min(d, top), min(sum(min(e, top) for e, m in given if m == n), top), tuple(centroids[n])) for i, (d, n) in zip(ids, given, strict=True))
        assert sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], tuple(r["centroid"])) for r in got) == want
        assert {r["inertia"] for r in got} == {min(sum(min(d, top) for d, _ in given), top)}
    assert orchard.cluster(rows.where("false"), dimensions=4).count() == 0 and orchard.cluster(rows, dimensions=9).count() == 0
    assert {r["cluster"] for r in orchard.cluster(rows.where("vec_id < 3"), dimensions=4).collect()} == {0, 1, 2}


def test_orchard_search_is_exact_and_measures_less():
    rng = np.random.default_rng(2)
    centres = rng.integers(-5000, 5000, (200, 6))
    model = orchard.Orchard.of(centres.tolist())
    x = (centres[rng.integers(0, 200, 3000)] + rng.integers(-300, 300, (3000, 6))).astype(float)
    best, least, measured = model.nearest(x)
    all_ = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    assert (best == all_.argmin(1)).all() and (least == all_.min(1)).all() and measured < 0.5 * all_.size
    ties = orchard.Orchard.of([[4, 0], [0, 4], [-4, 0], [0, -4], [4, 0]])
    assert ties.nearest(np.array([[0.0, 0.0], [2.0, 2.0], [4.0, 0.0], [-2.0, -2.0]]))[0].tolist() == [0, 0, 0, 2]


def plain_fim(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab é€😀\n<PSM"), rng.integers(0, 60))) for _ in range(300)]
    texts += [None, "", "x<P>y", "<S>", "a<M", LONG, "é" * 70_000, "😀", "plain ascii"]
    keys = [*range(len(texts) - 1), None]
    rows = spark.createDataFrame([*zip(keys, texts, strict=True), (5, texts[5])], "doc_id int, text string").withColumns({c: F.lit(1) for c in ("N", "output", "row", "h1", "form_")})
    got = fim.fill_in_middle(rows).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [(k, *plain_fim(k, t), t or "") for k, t in [*zip(keys, texts, strict=True), (5, texts[5])]]
    shape = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(shape, want), key=str) == sorted((shape((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"])) for r in got), key=str)
    assert {"plain", "psm", "spm"} == {r["form"] for r in got} and got[0]["row"] == 1
    assert fim.fill_in_middle(rows.where("false")).count() == 0


def test_sparse_index():
    text = "aé€😀b" * 50
    data = np.frombuffer(text.encode(), np.uint8)
    index = fim.SparseIndex.of(data)
    chars = np.arange(len(text) + 1)
    places = np.array([len(text[:i].encode()) for i in chars])
    assert (index.bytes_at(chars) == places).all() and (index.chars_at(places) == chars).all() and len(index.chars) == 150
    none = fim.SparseIndex.of(np.frombuffer(b"only ascii", np.uint8))
    assert len(none.chars) == 0 and none.bytes_at(np.array([3]))[0] == 3


def test_tiny_and_huge_vectors_link(spark):
    rows = [(1, [1e-200, 0.0]), (2, [1e-200, 1e-202]), (3, [1e200, 1.0]), (4, [0.0, 1e200]), (5, [5e-324, 0.0]), (6, [0.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1), 6: (0, 6)}


@here
def test_pipeline_judges_each_document_once(spark, monkeypatch):
    import corpus_pipeline

    met = {"toxicity": spark.sparkContext.accumulator(0), "quality": spark.sparkContext.accumulator(0)}
    for name, module in (("toxicity", corpus_pipeline.toxicity), ("quality", corpus_pipeline.quality)):

        def counted(docs, model, out, plain=module.score, seen=met[name]):
            @F.pandas_udf("double")
            def count(s: pd.Series) -> pd.Series:
                seen.add(len(s))
                return s

            return plain(docs, model, out=out).withColumn(out, count.asNondeterministic()(F.col(out)))

        monkeypatch.setattr(module, "score", counted)
    rows = corpus_pipeline.run(spark, TABLES).collect()
    n = spark.read.parquet(f"{TABLES}/documents.parquet").count()
    assert met["toxicity"].value == n and len(rows) < met["quality"].value <= n
    assert len({r["slot"] for r in rows}) == len(rows)


def test_topk_reads_in_order_and_stops(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(3000, 24))
    x[1000:2000] = x[7]  # a third of all rows are copies of one vector
    x[2000:2400] = x[8] + 1e-4 * r.normal(size=(400, 24))  # as near as cells can't tell
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    read, left = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = {}
    for row in topk.top_k(df, candidate_block=500, met=read).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    v = np.floor(1024 * x).astype(np.int64)
    for q in range(0, len(x), 100):
        s = v @ v[q]
        want = sorted(((i, int(s[i])) for i in range(len(x)) if i != q), key=lambda p: (-p[1], p[0]))[:10]
        assert got[q] == want
    near = spark.createDataFrame([(0, i, 1000.0 - i) for i in range(2000)], "query_id long, id long, upper double")
    rows = spark.createDataFrame([(i, [1000.0 - i], 1) for i in range(2000)], "id long, v array<double>, d int")
    asked = spark.createDataFrame([(0, [1.0], 1)], "id long, v array<double>, d int")
    best = topk.read_in_order(near, rows, asked, 10, met=left).collect()
    assert sorted(b["vec_id"] for b in best) == list(range(10)) and left.value == 40
    assert read.value < len(got) * len(x) / 10


def test_least_of_equal_vectors():
    x = np.array([[1.0], [2.0], [1.0], [1.0], [1.0], [2.0]])
    ids = np.array([9, 4, 3, 5, 3, 1])
    kept = topk.least_of_equals(ids, x, 2)
    assert sorted((x[i, 0], ids[i]) for i in kept) == [(1.0, 3), (1.0, 5), (2.0, 1), (2.0, 4)]


def test_topk_ties_beyond_long(spark):
    rows = spark.createDataFrame([(0, [1e10, 0.0]), (3, [3e30, 0.0]), (2, [2e20, 1.0]), (1, [-1e30, 5.0]), (4, [-1e20, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(rows, k=3).orderBy("rank").collect()]
    assert got == [(2, 2**63 - 1), (3, 2**63 - 1), (1, -(2**63))]


LINE = "A sentence with quite a few words that goes on for a while, as text does."


def bare(page):
    """A page without classes, ids and roles, its meaningful elements as div."""
    page = re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*')", "", page)
    return re.sub(r"<(/?)(article|main|nav|footer|aside|header|form|menu|section|dialog)\b[^>]*>", r"<\1div>", page)


@here
def test_fitted_looks_label_pages_without_marks(spark):
    pages = spark.read.parquet(f"{TABLES}/pages.parquet")
    weights = html_text.fit(pages.where("page_id % 2 = 0"))
    assert weights != html_text.PLAIN and max(map(abs, weights)) < 20
    right = always = n = 0
    for r in pages.where("page_id % 2 = 1").collect():
        want, got = ([keep for _, keep in html_text.labels_of(p, weights)] for p in (r["html"], bare(r["html"] or "")))
        assert len(want) == len(got)
        n, right, always = n + len(want), right + sum(a == b for a, b in zip(want, got, strict=True)), always + sum(want)
    assert right >= 0.95 * n > max(always, n - always)
    kept = html_text.main_text(f"<p>{LINE}</p><ul><li>one</li><li>two</li></ul><p>{LINE}</p>", weights)
    assert kept == f"{LINE}\none\ntwo\n{LINE}"


def test_ambiguous_names_leave_it_to_the_cut():
    keep = "The board of the village holds all that people want to say."
    assert html_text.main_text(f"<main><p>{LINE}</p><p class='notice-board'>{keep}</p></main>") == f"{LINE}\n{keep}"
    for name in ("notice", "site-notice", "notice-bar", "ad-slot", "comment-thread", "notice-2"):
        assert html_text.main_text(f"<main><p>{LINE}</p><div class='{name}'>{keep}</div></main>") == LINE


def test_looks_without_both_kinds_of_marks_stay_plain(spark):
    pages = spark.createDataFrame([(1, f"<main><p>{LINE}</p></main>"), (2, None), (3, "")], "page_id long, html string")
    assert html_text.fit(pages) == html_text.PLAIN == html_text.fit(pages.limit(0))
    n, x = np.array([30.0, 30.0]), np.tile(np.array(html_text.PLAIN) * 0 + 1, (2, 1))
    same = html_text.weights_of(n, 30 * x, 30 * x[:, :, None] * x[:, None, :])
    assert same[1:] == html_text.PLAIN[1:]  # nothing varies
