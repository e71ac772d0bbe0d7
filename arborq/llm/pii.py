"""Personal data in whole texts, in Spark expressions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and ranges confirm them, and words nearby move their scores.
A pattern's matches are put between two marks; the text is split at the first, and the lengths of the parts give
every match's place. Running sums over the parts are taken in blocks, so a text of very many matches stays cheap.

The patterns are written so that matching is linear in the text: a match begins only where a run of its characters does (or
right after the last match), and runs are taken whole (possessive quantifiers, which also don't recurse).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import fresh_name, table

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
BLOCK = 2048  # matches in a block of running sums
NEAR = 40  # characters on each side in which words are looked for
ACCEPT = 0.5

# The classes of characters of addresses.
_LOCAL, _DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"

#: Words that speak for a kind, and words that speak for another number than it, in the languages of the corpus.
FOR = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|address|server|host|adresse|dirección",
    "card": "card|visa|master|amex|credit|karte|tarjeta|carte|payment",
    "phone": "phone|tel|call|fax|mobile|mobil|anruf|rufnummer|llame|móvil|appel",
    "iban": "iban|account|konto|cuenta|compte|bank",
}
AGAINST = {
    "ip": "version|release|section|kapitel|chapter|versión",
    "card": r"isbn|order|invoice|tracking|serial|\bid\b",
    "phone": r"isbn|order|invoice|serial|\bid\b|page|version",
    "iban": "serial|token|key",
}


def _digits(text: Column) -> Column:
    return F.translate(text, " ().+-", "")


def luhn(digits: Column) -> Column:
    """Is the check digit of a text of digits right?"""
    doubled = F.translate(digits, "0123456789", "0246813579")
    n = F.length(digits)
    at = lambda t, i: F.substring(t, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, at(doubled, i)).otherwise(at(digits, i)))
    return total % 10 == 0


def mod_97(text: Column) -> Column:
    """The remainder by 97 of capital letters and digits with the first four moved to the end, letters being 10 to 35."""
    moved = F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise((s * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97))


def _is_ip(hit: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 3) & (F.coalesce(F.substring(bare, 1, 3).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(hit, r"\."), small)


def _is_card(hit: Column) -> Column:
    digits = _digits(hit)
    return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))


def _is_phone(hit: Column) -> Column:
    return F.length(_digits(hit)).between(10, 15)


def _is_iban(hit: Column) -> Column:
    bare = F.translate(hit, " ", "")
    return F.length(bare).between(15, 34) & (mod_97(F.substring(bare, 1, 34)) == 1)


@dataclass(frozen=True)
class Proposal:
    """A pattern and what confirms its matches; `score` is that of a confirmed match before words nearby are weighed.

    Base proposals are kept whatever their score. The others look only at text that no confirmed base match of their kind
    covers. `shorter` gives the part of a match to try where the whole is not confirmed.
    """

    kind: str
    pattern: str
    confirmed: Callable[[Column], Column]
    score: float
    base: bool = True
    shorter: Callable[[Column], Column] | None = None


KINDS = ["email", "ip", "card", "phone", "iban"]
BASE = [
    Proposal("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_DOMAIN}]++(?:\.[{_DOMAIN}]++)++", lambda hit: F.lit(True), 0.8),
    Proposal("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _is_ip, 0.7),
    Proposal("card", r"[0-9](?:[\x20-]?[0-9])++", _is_card, 0.8),
    Proposal("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _is_phone, 0.7),
]
MORE = [
    # several card numbers in a row, which the base pattern takes for one
    Proposal("card", r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{14,19})(?![0-9])", _is_card, 0.6, False),
    # numbers without a country's code, which need a word nearby
    Proposal("phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)[ -]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9A-Za-z])", lambda hit: F.length(F.translate(hit, " ().-", "")).between(9, 12), 0.3, False),
    Proposal(
        "iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])", _is_iban, 0.8, False,
        lambda hit: F.regexp_replace(hit, " [A-Z0-9]{1,4}$", ""),
    ),
]
_SPAN = "array<struct<start:bigint,place:int,end:bigint,score:double,base:boolean>>"


def _parts(text: Column, pattern: str) -> Column:
    """The text before the first match, and each match with CLOSE and what follows up to the next."""
    return F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN)


def _hit(part: Column) -> Column:
    return F.substring_index(part, CLOSE, 1)


def _masked(parts: Column, confirmed: Callable[[Column], Column]) -> Column:
    """The text again, each confirmed match covered by as many OTHER."""
    rest = lambda p: F.substring_index(p, CLOSE, -1)
    cover = lambda p: F.when(confirmed(_hit(p)), F.rpad(F.lit(""), F.length(_hit(p)), OTHER)).otherwise(_hit(p))
    return F.when(F.size(parts) < 2, parts[0]).otherwise(
        F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(cover(p), rest(p)))), "")
    )


def _weighed(parts: Column, p: Proposal) -> Column:
    """(whole, own, ok, score) of each match in order: the lengths up to the next match and of its own, is it confirmed, its score."""
    n = F.size(parts) - 1
    tail = lambda x: F.substring_index(x, CLOSE, -1)

    def weigh(before: Column, part: Column) -> Column:
        hit = _hit(part)
        if p.shorter is not None:
            less = p.shorter(hit)
            hit = F.when(~p.confirmed(hit) & p.confirmed(less), less).otherwise(hit)
        words = F.lower(F.concat(F.right(tail(before), F.lit(NEAR)), F.lit(" "), F.left(tail(part), F.lit(NEAR))))
        score = F.lit(p.score) + F.when(words.rlike(FOR[p.kind]), 0.2).otherwise(0.0)
        if p.kind in AGAINST:
            score = score - F.when(words.rlike(AGAINST[p.kind]), 0.3).otherwise(0.0)
        return F.struct((F.length(part) - 1).cast("long").alias("whole"), F.length(hit).cast("long").alias("own"), p.confirmed(hit).alias("ok"), F.round(score, 3).alias("score"))

    return F.zip_with(F.slice(parts, F.lit(1), n), F.slice(parts, F.lit(2), n), weigh)


def _placed(lead: Column, each: Column, p: Proposal) -> Column:
    """The spans to keep: (start, place of the kind, end, score, base), in code points. `lead` is the length before the first match; `each`, which
    the blocks slice, has to be a column, or it would be worked out for each block."""
    n = F.size(each)
    none = F.array().cast(_SPAN)

    def add(a: Column, x: Column) -> Column:
        keep = x["ok"] if p.base else x["ok"] & (x["score"] >= ACCEPT)
        one = F.struct(a["at"].alias("start"), F.lit(KINDS.index(p.kind)).alias("place"), (a["at"] + x["own"]).alias("end"), x["score"].alias("score"), F.lit(p.base).alias("base"))
        return F.struct((a["at"] + x["whole"]).alias("at"), F.when(keep, F.concat(a["found"], F.array(one))).otherwise(a["found"]).alias("found"))

    def moved(s: Column, by: Column) -> Column:
        return F.struct((s["start"] + by).alias("start"), s["place"].alias("place"), (s["end"] + by).alias("end"), s["score"].alias("score"), s["base"].alias("base"))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))
    blocks = F.transform(F.sequence(F.lit(1), n, F.lit(BLOCK)), lambda i: F.aggregate(F.slice(each, i, F.lit(BLOCK)), start, add))
    first = F.struct(lead.cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("found"))
    placed = F.aggregate(
        blocks, first,
        lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["found"], F.array(F.transform(b["found"], lambda s: moved(s, a["at"])))).alias("found")),
        lambda a: F.flatten(a["found"]),
    )
    return F.when(n < 1, none).otherwise(placed)


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with `out`, in place of a column of this name: an array of (kind, start, end, score, base) by start, then by kind as in KINDS.

    Places are code points, the end exclusive. Base spans are the leftmost matches of each kind's pattern that don't
    overlap, without those that fail their check; the others are confirmed matches with a score of ACCEPT or more, and
    spans of different kinds may overlap. A null text counts as empty and has no spans. Each row is worked on alone and
    whole, whatever its length and number of spans; nothing is shuffled. Repeated rows are treated alike, other columns of
    any name stay as they are, and an empty table stays empty.
    """
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    row, clean, part, each, lead = (fresh_name(docs, x) for x in ("row", "clean", "part", "each", "lead"))
    body = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), OPEN + CLOSE, OTHER * 2)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias(row), body.alias(clean))
    rows = rows.select(row, clean, *(_parts(F.col(clean), p.pattern).alias(f"{part}{i}") for i, p in enumerate(BASE)))
    seen = {p.kind: _masked(F.col(f"{part}{i}"), p.confirmed) for i, p in enumerate(BASE)}
    every = list(enumerate([*BASE, *MORE]))
    rows = rows.select("*", *(_parts(seen.get(p.kind, F.col(clean)), p.pattern).alias(f"{part}{i}") for i, p in every[len(BASE) :])).drop(clean)
    rows = rows.select(row, *(_weighed(F.col(f"{part}{i}"), p).alias(f"{each}{i}") for i, p in every), *(F.length(F.col(f"{part}{i}")[0]).alias(f"{lead}{i}") for i, _ in every))
    rows = rows.select(row, F.array_sort(F.concat(*(_placed(F.col(f"{lead}{i}"), F.col(f"{each}{i}"), p) for i, p in every))).alias(each))
    kinds = F.array(*(F.lit(k) for k in KINDS))
    named = lambda s: F.struct(F.element_at(kinds, s["place"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["base"].alias("base"))
    return rows.select(f"{row}.*", F.transform(each, named).alias(out))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest are of the base spans, `spans` and n_added of all and of what the method adds."""
    rows = find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii", F.filter("pii", lambda s: s["base"]).alias("base"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(p.kind) for p in BASE]
    return rows.select(
        "doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"),
        (F.size("pii") - F.size("base")).cast("long").alias("n_added"),
    )
