"""Fill-in-middle: each text is cut at two code points and put together anew around marks.

Texts stay UTF-8 bytes. A sparse index holds only the multibyte characters of a batch, each with its place and the
bytes that it and those before take beyond one; a search in it turns code-point cuts into byte cuts and back, while
spans of ASCII are plain arithmetic. One index and one search serve all texts of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import fresh_name, table

# The marks before a prefix, a suffix and a middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WINDOW = 16 << 20  # bytes of text for which one index is held


@dataclass(frozen=True)
class SparseIndex:
    """The multibyte characters of some UTF-8 bytes: their code-point numbers, their first bytes, and `excess[i]`, the bytes
    beyond one for each character that the first i of them take. Nothing is held for ASCII."""

    chars: np.ndarray
    starts: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> SparseIndex:
        starts = np.flatnonzero(data >= 0xC0)
        lead = data[starts]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        excess = np.concatenate([[0], np.cumsum(more)])
        return cls(starts - excess[:-1], starts, excess)

    def bytes_at(self, chars: np.ndarray) -> np.ndarray:
        """The byte at which each code point begins."""
        return chars + self.excess[np.searchsorted(self.chars, chars, "left")]

    def chars_at(self, places: np.ndarray) -> np.ndarray:
        """The code point that begins at each byte (a first byte, or the end)."""
        return places - self.excess[np.searchsorted(self.starts, places, "left")]


def rearranged(column: pa.Array, first: np.ndarray, second: np.ndarray, plain: np.ndarray, spm: np.ndarray) -> dict[str, pa.Array]:
    """n, prefix_chars, middle_chars and output of a string array; first and second are the draws for the two cuts."""
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = memoryview(buffers[2] or b"")[ends[0] : ends[-1]]
    index, ends = SparseIndex.of(np.frombuffer(whole, np.uint8)), ends - ends[0]
    at = index.chars_at(ends)
    n = np.diff(at)
    one, two = first % (n + 1), second % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    cut_low, cut_high = index.bytes_at(at[:-1] + low), index.bytes_at(at[:-1] + high)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    out = []
    for a, b, c, d, as_is, other in zip(ends[:-1], cut_low, cut_high, ends[1:], plain, spm, strict=True):
        if as_is:
            out.append(bytes(whole[a:d]))
        elif other:
            out.append(b"".join((s, whole[c:d], p, whole[a:b], m, whole[b:c])))
        else:
            out.append(b"".join((p, whole[a:b], s, whole[c:d], m, whole[b:c])))
    return {
        "n": pa.array(n), "prefix_chars": pa.array(low, mask=plain), "middle_chars": pa.array(high - low, mask=plain),
        "output": pa.array(out, pa.binary()).cast(pa.string()),
    }


def _windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most about WINDOW bytes of its column `text`, a row at least."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WINDOW, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of a key, from the SHA-256 of `seed:key` (a null key is written as nothing)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, rate: int = 90, spm_rate: int = 20, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output in place of columns of these names.

    n is the text's number of code points. `rate` of 100 texts are rearranged, `spm_rate` of 100 of these with the
    suffix first; the draws are a hash of the key alone, so repeated rows and keys come out alike and a rerun of a
    lost task gives the same rows. An empty or null text (null counts as empty), and one that contains a mark, stays
    plain, with null prefix_chars and middle_chars. Two equal cuts give an empty middle. Each row is worked on alone,
    whatever its length, and nothing is shuffled; other columns, of any name, are handed on. An empty table stays empty.
    """
    made = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output": "string"}
    kept = docs.drop(*(c for c in docs.columns if c.lower() in made))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(f"`{key}`"), seed)
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    plain = (body == "") | marked | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    row = fresh_name(kept, "row")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias(row), body.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _windows(batch):
                forms = part.column("form")
                plain, spm = (pc.equal(forms, f).to_numpy(zero_copy_only=False) for f in ("plain", "spm"))
                h = [part.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2")]
                done = rearranged(part.column("text"), *h, plain, spm)
                yield pa.RecordBatch.from_pydict({"row": part.column(0), "form": forms, **done})

    schema = f"row {packed.schema[row].dataType.simpleString()}, form string, n bigint, prefix_chars bigint, middle_chars bigint, output string"
    return packed.mapInArrow(run, schema).select("row.*", *made)


def restored(output: Column, form: Column) -> Column:
    """The exact text that was rearranged. Marks stand in no rearranged text and can't arise across a cut, so the first of each is the one put in."""
    after = lambda x, mark: F.split_part(x, F.lit(mark), F.lit(2))
    before = lambda x, mark: F.split_part(x, F.lit(mark), F.lit(1))
    rest = F.substring(output, len(PREFIX) + 1, (1 << 31) - 1)
    psm = F.concat(before(rest, SUFFIX), after(rest, MIDDLE), before(after(rest, SUFFIX), MIDDLE))
    spm = F.concat(before(after(rest, PREFIX), MIDDLE), after(rest, MIDDLE), before(rest, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP13_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
numbers AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
parts AS (
  SELECT *, substring(t, 1, least(a, b)) AS prefix, substring(t, least(a, b) + 1, abs(a - b)) AS middle, substring(t, greatest(a, b) + 1) AS suffix FROM numbers
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(a - b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
