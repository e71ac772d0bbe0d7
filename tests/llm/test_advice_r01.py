"""Cases of the first round's advice."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from arborq.llm import bpe, html_text, near_dedup


def sketched(words):
    return near_dedup.sketch(near_dedup.labelled_kmers(near_dedup.hashes_of(words)))


def one_band_pair():
    """(a, b, hub): a and b align and share exactly one band; hub, a part of a too short to link, has a's key of that band."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    for _ in range(5000):
        a = [word() for _ in range(200)]
        b = [word() if r.random() < 0.16 else w for w in a]
        same = np.flatnonzero(sketched(a) == sketched(b))
        if len(same) != 1 or not near_dedup.alike(near_dedup.Words(" ".join(a)), near_dedup.Words(" ".join(b))):
            continue
        for hub in (a[:150], a[50:], a[25:175]):
            if sketched(hub)[same[0]] == sketched(a)[same[0]]:
                return " ".join(a), " ".join(b), " ".join(hub)
    raise AssertionError("no such pair")


def test_near_dedup_aligns_a_pair_of_one_band_behind_a_strange_hub(spark):
    a, b, hub = one_band_pair()
    rows = spark.createDataFrame([(1, hub), (2, a), (3, b)], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(rows).collect()} == {1: 1, 2: 2, 3: 2}


def behind_other_hubs():
    """Texts of which the last two, a and b, align and meet in one bucket alone, of 101 more texts; those least in a's other large buckets aren't in it."""
    a, b, hub = (t.split() for t in one_band_pair())
    own = sketched(a)
    band = np.flatnonzero(own == sketched(b))[0]
    parts = [(a[i:j], sketched(a[i:j]) == own) for i in range(0, 100, 3) for j in range(i + 60, min(i + 158, 201), 3)]
    inside = random.Random(6).sample([p for p in parts if p[1][band]], 100)
    large = sum(same.astype(int) for _, same in inside) >= 65
    outside = [p for p in parts if not p[1][band] and (p[1] & large).any()]
    x, same = outside[0]
    y = next(p for p, other in outside if (other & ~same & large).any())
    return [" ".join(t) for t in (x, y, hub, *(p for p, _ in inside), a, b)]


def test_near_dedup_pairs_a_bucket_of_many_texts_whole(spark):
    rows = spark.createDataFrame(list(enumerate(behind_other_hubs())), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(rows).collect()}
    assert got[103] == got[104] == 103


def test_near_dedup_meets_a_hot_bucket_in_bounded_groups(spark, monkeypatch):
    """64 texts of one bucket: each pair is tried once, in groups of a few."""
    monkeypatch.setattr(near_dedup, "PER_BLOCK", 8)
    tried = []
    monkeypatch.setattr(near_dedup, "alike", lambda a, b: tried.append((a.list[-1], b.list[-1])) or False)
    rows = [(-1, 0, 7, i, 5, i, 0, [7] * near_dedup.BANDS, f"one two three four t{i}", 64, 320) for i in range(64)]
    opened = spark.createDataFrame(rows, "place long, band int, key long, rep long, n long, c long, split long, bands array<int>, text string, size long, words long")
    groups = near_dedup._blocked(opened)
    assert groups.groupBy(*near_dedup.GROUP).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] < 40
    arrow = groups.orderBy(*near_dedup.GROUP).toArrow()
    assert sum(batch.num_rows for batch in near_dedup._met(iter(arrow.to_batches()))) == 0
    assert sorted(tuple(sorted((int(a[1:]), int(b[1:])))) for a, b in tried) == [(a, b) for a in range(64) for b in range(a + 1, 64)]


def test_near_dedup_copies_a_quoted_passage_once_for_all_bands(spark, monkeypatch):
    """A passage in 300 unlike texts opens a bucket in most bands; the texts go to blocks about once, not once for each band, and the alike are found."""
    word, copied = itertools.count(), []
    own = [[f"w{next(word)}" for _ in range(60 + i % 40)] for i in range(300)]
    passage = [f"p{i}" for i in range(100)]
    rows = [(i, " ".join(passage + w)) for i, w in enumerate(own)]
    rows.append((300, " ".join(passage + own[200][:-5] + [f"w{next(word)}" for _ in range(5)])))
    blocked = near_dedup._blocked
    monkeypatch.setattr(near_dedup, "_blocked", lambda opened: copied.append(blocked(opened)) or copied[-1])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 200 if i == 300 else i for i in range(301)} and copied[-1].count() <= 3 * len(rows)


def test_near_dedup_blocks_hold_every_pair_that_may_link_once(spark, monkeypatch):
    """Places of one and of many blocks, with and without a component of half a block or more: each pair of fitting lengths meets in one group."""
    monkeypatch.setattr(near_dedup, "PER_BLOCK", 8)
    r = random.Random(4)
    rows = [(place, i, r.choice([1, 2, 4, 5, r.randrange(1, 400), 80, 100]), i if r.random() < share else -1) for place, size, share in ((1, 5, 1), (2, 20, 0.5), (3, 150, 1), (4, 150, 0.6)) for i in range(size)]
    placed = spark.createDataFrame(rows, "place long, rep long, n long, c long")
    sizes = placed.groupBy("place").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("words"))
    met = {}
    for x in near_dedup._blocked(placed.join(sizes, "place")).collect():
        met.setdefault((x["place"], x["lo"], x["hi"]), []).append(x)
    pairs = [
        (place, *sorted((a["rep"], b["rep"])))
        for (place, lo, hi), group in met.items()
        for a in group if a["block"] == lo
        for b in group if b["block"] == hi and (lo != hi or a["rep"] < b["rep"])
    ]
    fit = {(p, i, j) for p, i, n, c in rows for q, j, m, d in rows if p == q and i < j and min(n, m) >= 0.8 * max(n, m) and (c, d) != (-1, -1)}
    assert len(pairs) == len(set(pairs)) and fit <= set(pairs)


def test_near_dedup_puts_places_together_where_they_hold_the_same_texts(spark):
    """Place 20 lies nearly in place 10, which holds its hub; place 30, whose hub it holds too, has other texts and would make many more pairs."""
    rows = [(10, i) for i in range(11, 61)] + [(20, i) for i in range(21, 62)]
    assert {r["place"] for r in near_dedup._put_together(spark.createDataFrame([(*x, 9, x[1]) for x in rows], "place long, rep long, n long, c long")).collect()} == {10}
    rows = [(10, i) for i in range(11, 61)] + [(h, i) for h in range(20, 60) for i in range(1000 * h, 1000 * h + 20)]
    kept = near_dedup._put_together(spark.createDataFrame([(*x, 9, x[1]) for x in rows], "place long, rep long, n long, c long"))
    assert sorted((r["place"], r["rep"]) for r in kept.collect()) == sorted(rows)


def test_pipeline_shows_the_mix_after_a_parquet_reread(spark, tmp_path, monkeypatch):
    rows = [(i, f"text number {i}", "en", "a" if i % 4 else "b", 1) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    same = lambda spark, docs, sf_dir: docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("none", same), *corpus_pipeline.STAGES[-2:]])

    def first_of_b(weights):
        monkeypatch.setattr(corpus_pipeline.mixing, "tempered_weights", lambda docs: weights)
        corpus_pipeline.run(spark, str(tmp_path)).write.mode("overwrite").parquet(str(tmp_path / "out"))
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted(r["slot"] for r in got) == list(range(200)) and {r["doc_id"] for r in got} == set(range(200))
        return sum(r["pool"] == "b" for r in got if r["slot"] < 50)

    assert abs(first_of_b({"a": 1, "b": 1}) - 25) <= 1 and abs(first_of_b({"a": 4, "b": 1}) - 10) <= 1


def test_html_with_missing_end_tags():
    line = "A long paragraph of the main text, with many words and a period at its end."
    texts = lambda html: [x[0] for x in html_text.blocks_of(html)[0]]
    for page in (f"<html><head><title>T</title><body><p>{line}</p></body>", f"<head><meta charset=utf-8><p>{line}", f"<head><title>T</title>{line}", f"<head><link rel=x><b>{line}</b>", f"<head><noscript><style>x</style></noscript><body><p>{line}"):
        assert html_text.main_text(page) == line
    for tag in ("noscript", "button", "select", "iframe", "object", "svg"):
        assert texts(f"<body><div><p>one</p><{tag}>gone</div><p>two</p></body>") == ["one", "two"]
        assert texts(f"<body><div><{tag}><div>gone</div>gone</{tag}>one</div></body>") == ["one"]
    assert [x[2] for x in html_text.blocks_of(f"<p><a name=top>{line}</p><p>{line}</p>")[0]] == [0, 0]
    assert [x[2] for x in html_text.blocks_of('<p><a href="/x">link</a></p>')[0]] == [1.0]


def test_short_pieces_merge_alike_from_the_table_of_two_bytes():
    ranks = bpe.read_ranks(bpe.vocabulary())
    table, r = bpe._two_bytes(ranks), random.Random(8)
    for _ in range(2000):
        piece = bytes(r.choice(b" aeinorst\xc3\xa9\xff") for _ in range(r.randrange(1, 40)))
        assert bpe._merge_short(piece, ranks.get, table) == bpe._merge_short(piece, ranks.get) == bpe._merge_long(piece, ranks)
