"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs on arrays: every code point becomes a symbol, a symbol and its successor select a
transition function over nine scanner states, and these functions, whose composition is associative, are
scanned over blocks of the text. The state before each code point tells whether a token starts there.
No regular expression is used. The slices go through a cache to pair merging.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import table

# Symbols of code points and states of the scanner.
OTHER, APOSTROPHE, LETTER, STMD, RV, E, L, NUMBER, WHITE, SPACE, END = range(11)
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_WHITE, AFTER_SPACE, AFTER_APOSTROPHE, AFTER_SUFFIX, IN_SUFFIX = range(9)
SYMBOLS, STATES = 11, 9
BLOCK = 128
WINDOW = 1 << 17  # code points scanned, or ids decoded, at a time
CACHED_BYTES, CACHED_LENGTH = 30_000_000, 48
ENTRY_BYTES = 230  # about what an entry of the cache takes beside its text


def _step(state: int, a: int, b: int) -> tuple[bool, int]:
    """Does a token start at symbol a, seen in a state before symbol b, and the state after it."""
    letters, whites = (LETTER, STMD, RV, E, L), (WHITE, SPACE)
    if a == END:
        return True, BEGIN
    if a in whites:
        in_run = state in (AFTER_WHITE, AFTER_SPACE)
        last = b not in whites and b != END
        return not in_run or last, AFTER_SPACE if a == SPACE and last else AFTER_WHITE
    if a in letters:
        if state == IN_SUFFIX:
            return False, AFTER_SUFFIX
        if state == AFTER_APOSTROPHE:
            if a == STMD:
                return False, AFTER_SUFFIX
            if (a == RV and b == E) or (a == L and b == L):
                return False, IN_SUFFIX
            return True, IN_LETTERS
        return state not in (IN_LETTERS, AFTER_SPACE), IN_LETTERS
    if a == NUMBER:
        return state not in (IN_NUMBERS, AFTER_SPACE), IN_NUMBERS
    starts = state not in (IN_OTHERS, AFTER_SPACE, AFTER_APOSTROPHE)
    return starts, AFTER_APOSTROPHE if a == APOSTROPHE and starts else IN_OTHERS


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol of each code point; next state and start flag by (symbol pair, state)."""
    symbol = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, every):
            symbol[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
    for text, kind in (("'", APOSTROPHE), ("stmd", STMD), ("rv", RV), ("e", E), ("l", L), (" ", SPACE)):
        for c in text:
            symbol[ord(c)] = kind
    moves = np.zeros((SYMBOLS * SYMBOLS, STATES), np.uint8)
    starts = np.zeros((SYMBOLS * SYMBOLS, STATES), bool)
    for a in range(SYMBOLS):
        for b in range(SYMBOLS):
            for s in range(STATES):
                starts[a * SYMBOLS + b, s], moves[a * SYMBOLS + b, s] = _step(s, a, b)
    return symbol, moves, starts


def token_starts(points: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Positions in an array of code points where a token starts; positions in `ends` are ends of texts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    symbol, moves, starts = _tables()
    pairs = symbol[points]
    if ends is not None:
        pairs[ends] = END
    after = np.append(pairs[1:], np.uint8(END))
    pairs = pairs * np.uint8(SYMBOLS) + after
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, END * SYMBOLS + END, np.uint8)
    grid[:n] = pairs
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat = moves.reshape(-1)
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))  # each block's function on states
    for column in grid:
        whole = flat[column.astype(np.int32)[:, None] * STATES + whole]
    step = 1
    while step < rows:  # prefix compositions of the blocks' functions, by doubling
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.int64), 1)
        step *= 2
    state = np.full(rows, BEGIN, np.uint8)
    state[1:] = whole[:-1, BEGIN]
    flags = np.empty((BLOCK, rows), bool)
    flat_starts = starts.reshape(-1)
    for j, column in enumerate(grid):
        at = column.astype(np.int32) * STATES + state
        flags[j] = flat_starts[at]
        state = flat[at]
    return np.flatnonzero(flags.T.reshape(-1)[:n])


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file, a file installed on every machine."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


NO_RANK = 1 << 40
SHORT = 100


def _two_bytes(ranks: dict[bytes, int]) -> list[int]:
    """The rank of each pair of bytes, at 256 times the first one plus the second."""
    return [ranks.get(bytes((a, b)), NO_RANK) for a in range(256) for b in range(256)]


def merge_pairs(piece: bytes, ranks: dict[bytes, int], two_bytes: list[int] | None = None) -> tuple[int, ...]:
    """Ids of one piece: the adjacent pair of the least rank (the leftmost of equals) is joined until none is left.

    Short pieces keep the pairs' ranks in a list; long ones a heap with a linked list, for n log n.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    if len(piece) > SHORT:
        return _merge_long(piece, ranks)
    return _merge_short(piece, ranks.get, two_bytes)


def _merge_short(piece: bytes, rank, two_bytes: list[int] | None = None) -> tuple[int, ...]:
    cut = list(range(len(piece) + 1))
    if two_bytes is None:
        pair = [rank(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
    else:
        pair = [two_bytes[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
    while pair:
        least = min(pair)
        if least == NO_RANK:
            break
        i = pair.index(least)
        del cut[i + 1], pair[i]
        start, stop = cut[i], cut[i + 1]
        if i < len(pair):
            pair[i] = rank(piece[start : cut[i + 2]], NO_RANK)
        if i:
            pair[i - 1] = rank(piece[cut[i - 1] : stop], NO_RANK)
    return tuple([rank(piece[a:b]) for a, b in zip(cut, cut[1:], strict=False)])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    n = len(piece)
    stop = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n - 1))
    live = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 1, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, middle, end = heapq.heappop(heap)
        if not live[i] or stop[i] != middle or middle >= n or not live[middle] or stop[middle] != end:
            continue
        live[middle] = False
        stop[i] = end
        if end < n:
            before[end] = i
            r = ranks.get(piece[i : stop[end]])
            if r is not None:
                heapq.heappush(heap, (r, i, end, stop[end]))
        p = before[i]
        if p >= 0:
            r = ranks.get(piece[p:end])
            if r is not None:
                heapq.heappush(heap, (r, p, i, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return tuple(ids)


class _Cache(dict):
    """Packed ids by piece, in two generations of at most CACHED_BYTES each, as pieces are without end: a full one becomes the old one."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.two_bytes = ranks, _two_bytes(ranks)
        self.old: dict[str, bytes] = {}
        self.size = 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", merge_pairs(piece.encode("utf-8", "surrogatepass"), self.ranks, self.two_bytes)).tobytes()
        if len(piece) <= CACHED_LENGTH:
            if self.size >= CACHED_BYTES:
                self.old = dict(self)
                self.clear()
                self.size = 0
            self[piece] = ids
            self.size += ENTRY_BYTES + len(piece)
        return ids


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _ids(cache: _Cache, pieces: Iterable[str]) -> np.ndarray:
    return np.frombuffer(b"".join(map(cache.__getitem__, pieces)), np.int32)


def _encode_long(text: str, cache: _Cache) -> np.ndarray:
    """One text in windows. Scanning may begin afresh at any token start, so each window ends at a certain one."""
    ids: list[np.ndarray] = []
    at, window = 0, WINDOW
    while at < len(text):
        part = text[at : at + window]
        starts = token_starts(_points(part)).tolist()
        if at + window < len(text):
            while starts and starts[-1] > len(part) - 4:  # these may hang on what follows
                starts.pop()
            if len(starts) < 2:
                window *= 2
                continue
        else:
            starts.append(len(part))
        ids.append(_ids(cache, [part[a:b] for a, b in zip(starts, starts[1:], strict=False)]))
        at, window = at + starts[-1], WINDOW
    return np.concatenate(ids) if ids else np.zeros(0, np.int32)


def encode_texts(texts: list[str], ranks: dict[bytes, int], cache: _Cache | None = None) -> Iterator[list[np.ndarray]]:
    """Ids of each text, in lists for some of the texts at a time, in order."""
    cache = _Cache(ranks) if cache is None else cache
    i = 0
    while i < len(texts):
        if len(texts[i]) > WINDOW:
            yield [_encode_long(texts[i], cache)]
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= WINDOW):
            size += len(texts[j]) + 1
            j += 1
        text = "\n".join(texts[i:j]) + "\n"
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]]) - 1
        starts = token_starts(_points(text), ends)
        bounds = np.append(starts, len(text))
        of_text = np.searchsorted(starts, ends)  # the token that is the end of each text
        at = bounds.tolist()
        pieces = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
        found, done = [], 0
        for stop in of_text.tolist():
            found.append(_ids(cache, pieces[done:stop]))
            done = stop + 1
        yield found
        i = j


class _Bytes:
    """The bytes of each id, in one array with their places."""

    def __init__(self, ranks: dict[bytes, int]):
        size = np.zeros(max(ranks.values(), default=-1) + 2, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        self.size, self.first = size[:-1], np.cumsum(size) - size
        self.blob = np.zeros(int(size.sum()), np.uint8)
        for token, i in ranks.items():
            self.blob[self.first[i] : self.first[i] + len(token)] = np.frombuffer(token, np.uint8)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each id's bytes begin."""
        length = self.size[ids]
        return np.cumsum(length) - length

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of the ids, each token's put at its offset; a token ends where the next one begins."""
        parts = []
        for a in range(0, len(ids), WINDOW):
            b = min(len(ids), a + WINDOW)
            stop = offsets[b] if b < len(ids) else offsets[-1] + self.size[ids[-1]]
            begin = offsets[a:b]
            source = np.repeat(self.first[ids[a:b]] - begin, np.diff(begin, append=stop))
            source += np.arange(begin[0], stop)
            parts.append(self.blob[source].tobytes())
        return b"".join(parts)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most about WINDOW bytes of a text column, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + WINDOW, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _coded(docs: DataFrame, path: str, key: str, text: str, outputs: dict[str, str]) -> DataFrame:
    """The key as doc_id and some of ids, offsets and decoded of each whole text; one pass, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        tokens, cache = _Bytes(ranks), _Cache(ranks)
        for batch in batches:
            for part in _slices(batch, 1):
                done = 0
                for ids in encode_texts([t or "" for t in part.column(1).to_pylist()], ranks, cache):
                    out = {"doc_id": part.column(0).slice(done, len(ids)), "ids": _lists(ids, pa.int32())}
                    done += len(ids)
                    offsets = [tokens.offsets(x) for x in ids]
                    if "offsets" in outputs:
                        out["offsets"] = _lists(offsets, pa.int64())
                    if "decoded" in outputs:
                        out["decoded"] = pa.array([tokens.decoded(x, at) for x, at in zip(ids, offsets, strict=True)], pa.binary())
                    yield pa.RecordBatch.from_pydict({name: out[name] for name in ("doc_id", *outputs)})

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{name} {kind}" for name, kind in outputs.items()))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, offsets): the ids of each whole text and the byte at which each id's bytes begin.

    Null texts count as empty, which have no ids. Each row is encoded on its own, so repeated rows and keys
    stay; an empty table gives an empty result. Nothing is shuffled. A worker holds a slice of a batch, the
    vocabulary and a cache bounded in bytes, however many pieces it meets; a very long text is scanned in windows.
    """
    return _coded(docs, path, key, text, {"ids": "array<int>", "offsets": "array<bigint>"})


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): as `encode`, and each text's bytes decoded again from its ids and retained offsets, in the same pass."""
    return _coded(docs, path, key, text, {"ids": "array<int>", "decoded": "binary"})


def decode(encoded: DataFrame, path: str, ids: str = "ids", offsets: str = "offsets", out: str = "decoded") -> DataFrame:
    """Add a binary column with the bytes of the ids, each token's bytes put at its offset. Null ids give no bytes."""
    encoded = encoded.drop(out)
    columns, at, begin = encoded.columns, encoded.columns.index(ids), encoded.columns.index(offsets)
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Bytes(read_ranks(path))
        for batch in batches:
            decoded = []
            for x, o in zip(batch.column(at), batch.column(begin), strict=True):
                these, places = (v.values.to_numpy(zero_copy_only=False) if v.is_valid else none for v in (x, o))
                decoded.append(tokens.decoded(these, places))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*columns, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, `{out}` binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs, its ids decoded again."""
    return round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())
