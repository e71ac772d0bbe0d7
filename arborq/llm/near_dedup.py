"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's words give five-word k-mers, each labelled with its occurrence number in the document. For
each of several hash functions the two least labelled k-mers are taken and kept in text order: one band.
Two texts agree in a band about as often as the square of their k-mers' Jaccard similarity, so that texts
whose words align in 0.8 still share one of the bands. Exact copies are one class from the start. In each
bucket of a band every text is first aligned with one hub. All pairs of a bucket, whatever its size, that
are then still in different components are candidates too. Buckets of one hub, and those whose hub lies in a
larger one and that hold mostly its texts, are one place, so that texts which meet in many bands are paired
once. A place's pairs meet in blocks of bounded size and of lengths that may link, so that a passage that many
texts quote is work for many tasks. Bounds of lengths, words and word pairs part most.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import checkpointed, components, release, table

K, SAME, BANDS = 5, 0.8, 62
PER_HUB = 64  # members for which a hub's text is sent once
PER_BLOCK, BLOCK_WORDS = 512, 100_000
TIER = 1 / SAME + 0.001  # texts of lengths two tiers apart can't link
BINS, LEVELS = 1024, 4
_WORD = re.compile(r"\w+")
_CELLS = 500_000


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


STEP = _odd(K + 1, 11)
SCALE, SHIFT = _odd(BANDS, 12), _odd(BANDS, 13)
FOLD = _odd(3, 14)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def hashes_of(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def labelled_kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of the K-word runs with their occurrence numbers; a shorter text is one run."""
    n = max(1, len(words) - K + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(K, len(words))):
        out = out * STEP[K] + words[i : i + n] * STEP[i]
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    if not new.all():
        place = np.arange(n)
        seen = place - np.maximum.accumulate(np.where(new, place, 0))
        out[order] = ranked + seen.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return _mixed(out)


def sketch(kmers: np.ndarray) -> np.ndarray:
    """One key for each band: the two least of some labelled k-mers (one at least) by its hash function, in text order."""
    n = len(kmers)
    pairs = np.empty((BANDS, 2), np.uint64)
    rows = max(1, _CELLS // n)
    for a in range(0, BANDS, rows):
        h = kmers[None, :] * SCALE[a : a + rows, None] + SHIFT[a : a + rows, None]
        h ^= h >> np.uint64(32)
        each = np.arange(len(h))
        first = h.argmin(1)
        if n > 1:
            h[each, first] = np.uint64(0xFFFFFFFFFFFFFFFF)
            second = h.argmin(1)
        else:
            second = first
        pairs[a : a + rows, 0] = kmers[np.minimum(first, second)]
        pairs[a : a + rows, 1] = kmers[np.maximum(first, second)]
    return _mixed(pairs[:, 0] * FOLD[0] + pairs[:, 1] * FOLD[1] + np.arange(BANDS, dtype=np.uint64) * FOLD[2])


def _banded(a: list, b: list, k: int) -> int:
    """Edit distance of a and b (no longer than a) if it is at most k, else k + 1.

    Only the 2k + 1 cells around the diagonal are worked out, all of one column at once: they are the bits of
    whole numbers that tell where the distance rises or falls by one down the column. What lies outside the
    band counts as far away. Words' places are gathered for some columns at a time.
    """
    n, m = len(a), len(b)
    if n - m > k:
        return k + 1
    band = (1 << (2 * k + 1)) - 1
    bottom, diagonal = 1 << (2 * k), 1 << k
    rises, falls = band ^ ((1 << (k + 1)) - 1), 0
    far, most, columns = 0, k + n - m, max(2048, 4 * k)
    for base in range(0, m, columns):
        places: dict = {}
        for i in range(max(1, base + 1 - k), min(n, base + columns + k) + 1):
            places[a[i - 1]] = places.get(a[i - 1], 0) | 1 << (i + k - base)
        for j in range(1, min(columns, m - base) + 1):
            equal = places.get(b[base + j - 1], 0) >> j & band
            rises = rises >> 1 | bottom
            falls >>= 1
            level = ((((equal & rises) + rises) ^ rises) | equal | falls) & band  # no farther than the cell up and left
            right_up = ((falls | ((level | rises) ^ band)) << 1 | 1) & band
            right_down = (level & rises) << 1 & band
            rises = right_down | ((level | right_up) ^ band)
            falls = right_up & level
            if not level & diagonal:
                far += 1
                if far > most:  # a diagonal never falls again
                    return k + 1
    tail = ((1 << (n - m)) - 1) << (k + 1)
    far += (rises & tail).bit_count() - (falls & tail).bit_count()
    return min(far, k + 1)


class Words:
    """A text's words, their counts and what bounds of shared words and word pairs are taken from, worked out when asked for."""

    def __init__(self, text: str):
        self.list = words_of(text)

    @cached_property
    def bag(self) -> Counter:
        return Counter(self.list)

    @cached_property
    def profiles(self) -> tuple[tuple[np.ndarray, int], tuple[np.ndarray, int]]:
        h = hashes_of(self.list)
        return _profile(h), _profile(_mixed(h[:-1] * STEP[0] + h[1:] * STEP[1]))


def edits(a: list, b: list, limit: int) -> int:
    """Edit distance of two word lists if at most limit, else a lower bound of it above the limit. The band is widened until it is certain."""
    if len(a) < len(b):
        a, b = b, a
    head, n = 0, len(b)
    while head < n and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : n - tail]
    if not b or len(a) - len(b) > limit:
        return len(a) - len(b)
    k = min(max(15, 2 * (len(a) - len(b))), limit)
    while True:
        found = _banded(a, b, k)
        if found <= k or k >= limit:
            return found
        k = min(4 * k, limit)


def most_edits(longest: int, same: float = SAME) -> int:
    """Edits at which two texts, the longer of `longest` words, still agree in a share of `same`."""
    return int(longest * (1 - same) + 1e-9)


def alike(a: Words, b: Words, same: float = SAME) -> bool:
    """Do two texts' words agree in a share of at least `same` of the longer one, by alignment?"""
    longest = max(len(a.list), len(b.list))
    limit = most_edits(longest, same)
    if not longest or longest - min(len(a.list), len(b.list)) > limit or longest - (a.bag & b.bag).total() > limit:
        return False
    return edits(a.list, b.list, limit) <= limit


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, bands, sizes = [], [], []
        for text in batch.column(2):
            text = text.as_py()
            words = words_of(text) if text else []
            sizes.append(len(words))
            if words:
                digests.append(hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).digest()[:16])
                bands.append(sketch(labelled_kmers(hashes_of(words))).view(np.int64))
            else:
                rest = text.strip() if text else ""
                digests.append(hashlib.sha256(b"\0" + rest.encode("utf-8", "surrogatepass")).digest()[:16] if rest else None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())],
            ["id", "tie", "digest", "bands", "n"],
        )


def _tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (a, b, hub, other) of which hub and other link, as (a, b)."""
    last, hub = None, None
    for batch in batches:
        a = batch.column(0).to_pylist()
        linked = []
        for i in range(len(a)):
            if a[i] != last:
                last, hub = a[i], Words(batch.column(2)[i].as_py())
            linked.append(alike(hub, Words(batch.column(3)[i].as_py())))
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _with_hubs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked ones of pairs (hub a, member b, size of their largest bucket). A hub's text is sent once for about PER_HUB members."""
    asked = pairs.withColumn("copy", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / PER_HUB)).cast("int"))
    hubs = texts.join(asked.select(F.col("a").alias("id"), "copy").distinct().hint("merge"), "id").select(F.col("id").alias("a"), "copy", F.col("text").alias("hub"))
    others = texts.select(F.col("id").alias("b"), F.col("text").alias("other"))
    both = asked.join(others.hint("merge"), "b").join(hubs.hint("merge"), ["a", "copy"]).select("a", "b", "hub", "other")
    return checkpointed(both.mapInArrow(_tried, "a long, b long"))


def _blocked(opened: DataFrame) -> DataFrame:
    """Rows of places (with their size and words) copied to the groups (place, lo, hi) in which block lo meets block hi.

    A block has about PER_BLOCK rows and BLOCK_WORDS words (a text at least), whatever the place's size. A place of several blocks has blocks
    for each tier of lengths, which meet those of the same and the next tiers. A component that fills half a block or more and is the place's
    largest has blocks of its own, which don't meet each other, as their texts are joined already.
    """
    blocks = lambda rows, words: F.ceil(F.greatest(rows / PER_BLOCK, words / BLOCK_WORDS)).cast("int")
    of_place = blocks(F.col("size"), F.col("words"))
    tier = F.when(of_place > 3, F.floor(F.log("n") / math.log(TIER))).otherwise(0).cast("long")
    large = opened.where(of_place > 1)
    parts = large.groupBy(*PLACE, "c").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("within"))
    core = parts.where((F.col("rows") >= PER_BLOCK / 2) | (F.col("within") >= BLOCK_WORDS / 2)).groupBy(*PLACE).agg(F.max(F.struct("rows", "c"))["c"].alias("core"))
    inner = F.coalesce(F.col("c") == F.col("core"), F.lit(False))
    kinds = opened.join(core.hint("merge"), PLACE, "left").withColumn("kind", 2 * tier + inner.cast("long"))  # odd ones are of the largest component
    cuts = kinds.where(of_place > 1).groupBy(*PLACE, "kind").agg(blocks(F.count(F.lit(1)), F.sum("n")).alias("cut"))
    cuts = cuts.groupBy(*PLACE).agg(F.map_from_entries(F.collect_list(F.struct("kind", "cut"))).alias("cuts"))
    at = lambda kind, i: F.shiftleft(kind, 32) + i.cast("long")
    base = F.col("kind") - F.pmod("kind", F.lit(2))
    near = F.filter(F.sequence(base - 2, base + 3), lambda k: F.map_contains_key("cuts", k) & ((F.pmod("kind", F.lit(2)) == 0) | (F.pmod(k, F.lit(2)) == 0)))
    met = F.flatten(F.transform(near, lambda k: F.transform(F.sequence(F.lit(0), F.element_at("cuts", k) - 1), lambda i: at(k, i))))
    dealt = kinds.join(cuts.hint("merge"), PLACE, "left")
    whole, own = F.col("cuts").isNull(), F.pmod(F.xxhash64("rep"), F.element_at("cuts", F.col("kind")))
    cut = dealt.withColumn("block", F.when(whole, F.lit(0)).otherwise(at(F.col("kind"), own)))
    cut = cut.withColumn("other", F.explode(F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(met)))
    return cut.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "size", "words", "core", "kind", "cuts")


def _profile(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """Counts of hashes in BINS bins as bits, LEVELS for each bin, and what the counts have beyond these."""
    counts = np.bincount((hashes % np.uint64(BINS)).astype(np.int64), minlength=BINS)
    bits = np.packbits(counts[None, :] > np.arange(LEVELS)[:, None]).view(np.uint64)
    return bits, int(np.maximum(counts - LEVELS, 0).sum())


def _most_shared(profiles: list[tuple[np.ndarray, int]]):
    """Function (i, j) that bounds from above how many items row i shares with each row of j."""
    bits, beyond = np.stack([p[0] for p in profiles]), np.array([p[1] for p in profiles])
    return lambda i, j: np.bitwise_count(bits[j] & bits[i]).sum(1, dtype=np.int64) + np.minimum(beyond[j], beyond[i])


def _meeting(group: pa.Table) -> list[tuple[int, int]]:
    """Links (a, b) found among the pairs of one group whose components differ, the links found before among them.

    An edit changes one word and two word pairs, which bounds the edit distance by the words and word pairs that are not shared.
    """
    rep, n, block, top = (group[x].to_numpy().copy() for x in ("rep", "n", "block", "c"))
    lo, hi = (group[x][0].as_py() for x in ("lo", "hi"))
    left = np.flatnonzero(block == lo)
    right = left if lo == hi else np.flatnonzero(block == hi)
    if not len(left) or not len(right) or (top == top[0]).all():
        return []
    first: list[tuple[int, np.ndarray]] = []  # pairs of lengths that may link
    for i in left:
        j = right[(top[right] != top[i]) & ((rep[right] > rep[i]) | (lo != hi))]
        j = j[np.minimum(n[j], n[i]) >= SAME * np.maximum(n[j], n[i])]
        if len(j):
            first.append((i, j))
    if not first:
        return []
    used = np.unique(np.concatenate([np.append(j, i) for i, j in first]))
    place = np.zeros(len(group), np.int64)
    place[used] = np.arange(len(used))
    texts = [Words(group["text"][int(i)].as_py()) for i in used]
    words_shared, pairs_shared = (_most_shared([t.profiles[x] for t in texts]) for x in (0, 1))
    found = []
    for i, j in first:
        j = j[top[j] != top[i]]
        for shared, by_edit in ((words_shared, 1), (pairs_shared, 2)):
            longest = np.maximum(n[j], n[i])
            most = np.floor(longest * (1 - SAME) + 1e-9)
            j = j[longest - (by_edit - 1) - shared(place[i], place[j]) <= by_edit * most]
        for x in j:
            if top[x] != top[i] and alike(texts[place[i]], texts[place[x]]):
                top[top == top[x]] = top[i]
                found.append((int(rep[i]), int(rep[x])))
    return found


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each group of rows that are sorted by group; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        keys = list(zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in GROUP), strict=True))
        found, start = [], 0
        for i, k in enumerate(keys):
            if k != last:
                held += [batch.slice(start, i - start)] if i > start else []
                found += _meeting(pa.Table.from_batches(held)) if held else []
                held, start, last = [], i, k
        held.append(batch.slice(start))
        yield out(found)
    if held:
        yield out(_meeting(pa.Table.from_batches(held)))


def _joined_further(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links: the links' ends are taken by their components first."""
    of = lambda end: joined.select(F.col("node").alias(f"{end}_node"), F.col("component").alias(f"{end}_c"))
    between = links.join(of("a"), F.col("a") == F.col("a_node"), "left").join(of("b"), F.col("b") == F.col("b_node"), "left")
    more = components(between.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")))
    known = joined.join(more.select(F.col("node").alias("was"), F.col("component").alias("now")), F.col("component") == F.col("was"), "left")
    old = known.select("node", F.coalesce("now", "component").alias("component"))
    return checkpointed(old.unionByName(more.join(joined, "node", "left_anti").select("node", "component")))


BUCKET, PLACE = ["band", "key"], ["place"]
GROUP = [*PLACE, "lo", "hi"]


def _members(sketches: DataFrame) -> DataFrame:
    """Rows (band, key, hub, hub_n, size, rep, n) of the texts beside the hub in buckets of two or more, from (rep, n, bands).

    The rows are dealt by bucket once, for counting and for joining the counts.
    """
    filed = sketches.select("rep", "n", F.posexplode("bands").alias("band", "key")).repartition(*BUCKET)
    shared = filed.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("hub"), F.min_by("n", "rep").alias("hub_n")).where("size > 1")
    return checkpointed(filed.join(shared.hint("merge"), BUCKET).where("rep <> hub"))


def _hubs_tried(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of texts with their hubs."""
    near = members.where(F.least("n", "hub_n") >= SAME * F.greatest("n", "hub_n"))  # texts of more unequal lengths can't link
    return _with_hubs(near.groupBy(F.col("hub").alias("a"), F.col("rep").alias("b")).agg(F.max("size").alias("size")), texts)


def _opened(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Texts (place, rep, n, c) of buckets that beside the hub hold different components (c); buckets of one hub are one place, named by it."""
    inside = members.join(joined.hint("merge"), members["rep"] == joined["node"], "left").select(*BUCKET, "hub", "rep", "n", F.coalesce("component", "rep").alias("c"))
    apart = inside.groupBy(*BUCKET).agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most")
    return checkpointed(inside.join(apart.select(*BUCKET).hint("merge"), BUCKET).select(F.col("hub").alias("place"), "rep", "n", "c").distinct())


def _put_together(opened: DataFrame) -> DataFrame:
    """Opened texts (place, rep, n, c), with places that hold mostly the same texts put together, which only adds pairs to those that meet.

    A place goes over whole to the largest place that holds its hub and is no smaller. What goes to one place stays apart
    where all pairs of the whole would be more than twice those of its parts.
    """
    sizes = checkpointed(opened.groupBy("place").agg(F.count(F.lit(1)).alias("size")))
    own = sizes.select(F.col("place").alias("rep"), F.col("size").alias("own"))
    holding = opened.select("place", "rep").join(own.hint("merge"), "rep").join(sizes.hint("merge"), "place").where("size >= own")
    into = holding.groupBy(F.col("rep").alias("place")).agg((-F.max(F.struct("size", (-F.col("place")).alias("at")))["at"]).alias("into"))
    going = checkpointed(sizes.join(into.hint("merge"), "place", "left").select("place", "size", F.coalesce("into", "place").alias("into")))
    apart = going.groupBy("into").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("apart"))
    moved = opened.join(going.select("place", "into").hint("merge"), "place")
    whole = moved.select("into", "rep").distinct().groupBy("into").agg(F.count(F.lit(1)).cast("double").alias("whole"))
    worth = apart.join(whole.hint("merge"), "into").where(F.col("whole") * F.col("whole") <= 2 * F.col("apart")).select(F.col("into").alias("taken"))
    placed = moved.join(worth.hint("merge"), F.col("into") == F.col("taken"), "left")
    return checkpointed(placed.select(F.coalesce("taken", "place").alias("place"), "rep", "n", "c").distinct())


def _paired(opened: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between texts of the same places, where every pair is tried."""
    placed = _put_together(opened)
    sizes = placed.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("words"))
    groups = _blocked(placed.join(sizes.hint("merge"), PLACE)).join(texts.withColumnRenamed("id", "rep").hint("merge"), "rep")
    groups = groups.select(*GROUP, "block", "rep", "n", "c", "text")
    return checkpointed(groups.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_met, "a long, b long"))


def _tie(text: str) -> F.Column:
    """Which row stands for a repeated key: the one with the least hash of its text."""
    return F.xxhash64(text)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, rows, tie): one row for each key; class_id is the least key of its near-duplicate class.

    Texts link if their words (lower case, without punctuation) align in at least 0.8 of the longer one, or
    are equal; classes are closed under links. Texts without
    words link only if they are equal apart from outer white space; null and blank texts link with nothing.
    `rows` counts rows with the key: these are one document, the row with the least hash of its text, `tie`.
    Null keys are left out. Very long texts are aligned whole, in a band as wide as their edits ask for. An
    empty table gives an empty result.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), _tie(text).alias("tie"), F.col(text).alias("text"))
    sketched = checkpointed(rows.mapInArrow(_sketched, "id long, tie long, digest binary, bands array<long>, n long"))
    keys = checkpointed(sketched.groupBy("id").agg(F.min(F.struct("tie", "digest")).alias("s"), F.count(F.lit(1)).alias("rows")).select("id", "s.*", "rows"))
    copies = checkpointed(keys.where("digest is not null").groupBy("digest").agg(F.min(F.struct("id", "tie")).alias("s")).select("digest", "s.*"))
    own = sketched.where("bands is not null").select("id", "tie", "bands", "n").join(copies.select("id", "tie").hint("merge"), ["id", "tie"]).dropDuplicates(["id", "tie"])
    sketches = checkpointed(own.select(F.col("id").alias("rep"), "n", "bands"))
    del sketched, own  # what nothing refers to any more is released
    release(docs.sparkSession)
    members = _members(sketches)
    del sketches
    release(docs.sparkSession)
    involved = members.select(F.explode(F.array("rep", "hub")).alias("id")).distinct()
    wanted = involved.join(copies.select("id", "tie").hint("merge"), "id")
    texts = checkpointed(rows.join(wanted.hint("merge"), ["id", "tie"]).dropDuplicates(["id", "tie"]).select("id", "text"))
    del involved, wanted
    release(docs.sparkSession)
    linked = _hubs_tried(members, texts)
    release(docs.sparkSession)
    joined = components(linked)
    release(docs.sparkSession)
    opened = _opened(members, joined)
    del members, linked
    release(docs.sparkSession)
    links = _paired(opened, texts)
    del opened, texts
    release(docs.sparkSession)
    joined = _joined_further(joined, links)
    of_copy = copies.join(joined, copies["id"] == joined["node"], "left").select("digest", F.coalesce("component", "id").alias("class_id"))
    return keys.join(of_copy.hint("merge"), "digest", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), "rows", "tie")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of one document of each class, with their columns as they are; rows with null keys stay.

    Of rows that repeat a key the one that was judged stays. Null, blank and unlike texts stay; an empty table stays empty.
    """
    found = classes(docs, key, text)
    kept = checkpointed(found.where("doc_id = class_id").select("doc_id", "rows", "tie"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("key"), _tie(text).alias("at"))
    rows = packed.join(kept, F.col("key") == F.col("doc_id"))
    single = rows.where("rows = 1").select("row")
    repeated = rows.where("rows > 1 and at = tie").dropDuplicates(["key"]).select("row")
    return single.unionByName(repeated).unionByName(packed.where(F.col("key").isNull()).select("row")).select("row.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
