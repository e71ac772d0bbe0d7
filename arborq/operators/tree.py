"""Work on result trees held as rows with keys: filtering with promotion, sorting, display, merging, clustering, inversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborq.functions import values as V
from arborq.functions.expr import Expr, Row
from arborq.operators.common import checkpointed, ranked
from arborq.operators.traverse import ROW


def prefixes(key: Column, above: Column) -> Column:
    """Keys of all places from the top down to `above`, the row's parent; empty at the top."""
    return F.when(above.isNull(), F.array().cast("array<array<bigint>>")).otherwise(F.transform(F.sequence(F.lit(2), F.greatest(F.size(above), F.lit(2))), lambda n: F.slice(above, F.lit(1), n)))


def promote(rows: DataFrame, ok: str) -> DataFrame:
    """Drop rows whose column `ok` is false; what is left below them hangs on the nearest row above that is left.

    Adds has_filtered_ancestor: the row right above was dropped. Depth, parent and path stay as they were.
    """
    kept = rows.where(F.col(ok)).drop(ok)
    present = kept.select("root", F.col("key").alias("_above"))
    climbed = (
        kept.where(F.col("parent_key").isNotNull())
        .select("root", "key", F.explode(prefixes(F.col("key"), F.col("parent_key"))).alias("_above"))
        .join(present, ["root", "_above"])
        .groupBy("root", "key")
        .agg(F.max(F.struct(F.size("_above").alias("n"), F.col("_above"))).alias("_up"))
    )
    joined = kept.join(climbed, ["root", "key"], "left")
    up = F.col("_up._above")
    lost = F.col("parent_key").isNotNull() & ~up.eqNullSafe(F.col("parent_key"))
    return joined.withColumn("has_filtered_ancestor", lost).withColumn("parent_key", up).drop("_up")


def basename(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def sort_siblings(rows: DataFrame, row: Row, keys: list[tuple[Expr, str]], out: str = "sibling_rank") -> DataFrame:
    """Rank each set of siblings from 1: by the keys (asc: nulls last, desc: nulls first), then file name, then the walk."""
    order: list[Column] = []
    for expr, way in keys:
        key = V.sort_key(expr.value(row))
        order.append(key.desc_nulls_first() if way == "desc" else key.asc_nulls_last())
    return ranked(rows, ["root", "parent_key"], [*order, V.ordered(basename(F.col("path"))).asc(), F.col("key").asc()], out)


def chained(rows: DataFrame, links: DataFrame, before: list[Column], rank: str = "sibling_rank") -> DataFrame:
    """Rank siblings anew so that chains of them stay together, each at its head's place: rows with `rank` from 1 in each set.

    `links` (src, dst, ord) are the edges that make chains, of which those between siblings count whose `before` columns are equal. A note that
    leads to several goes on with the least (ord, rank); where several lead to one, the first by rank does. Of a ring the first by
    rank is the head. A path that a set holds twice is linked at its first row. Heads and places come by doubling: each round a row's
    pointer skips as far again, so a chain of n rows takes about log2(n) joins, and no task holds a set.
    """
    group = ["root", "parent_key"]
    same = [c.alias(f"_b{i}") for i, c in enumerate(before)]
    at = checkpointed(rows.select("root", "parent_key", "key", "path", F.col(rank).alias("n"), *same))
    mine = at.groupBy(*group, "path").agg(F.min_by(F.struct("n", *(f"_b{i}" for i in range(len(same)))), "n").alias("x")).select(*group, "path", "x.*")
    a = mine.select(*group, F.col("path").alias("src"), F.col("n").alias("a"), *(F.col(f"_b{i}").alias(f"_x{i}") for i in range(len(same))))
    b = mine.select(F.col("root").alias("_r"), F.col("parent_key").alias("_p"), F.col("path").alias("dst"), F.col("n").alias("b"), *(f"_b{i}" for i in range(len(same))))
    on = (F.col("root") == F.col("_r")) & F.col("parent_key").eqNullSafe(F.col("_p")) & (F.col("dst") == F.col("_d"))
    led = a.join(links.select("src", F.col("dst").alias("_d"), "ord"), "src").join(b, on).where("a <> b")
    for i in range(len(same)):
        led = led.where(F.col(f"_x{i}").eqNullSafe(F.col(f"_b{i}")))
    onward = led.groupBy(*group, "a").agg(F.min(F.struct("ord", "b")).alias("to")).select(*group, "a", F.col("to.b").alias("b"))
    above = checkpointed(onward.groupBy(*group, "b").agg(F.min("a").alias("up")))  # each row's one row before it
    heads = _heads(above, group)
    h = heads.select(F.col("root").alias("_r"), F.col("parent_key").alias("_p"), F.col("b").alias("_n"), "head", "steps")
    on = (F.col("root") == F.col("_r")) & F.col("parent_key").eqNullSafe(F.col("_p")) & (F.col(rank) == F.col("_n"))
    full = rows.join(h, on, "left").drop("_r", "_p", "_n")
    full = full.withColumn("_head", F.coalesce("head", rank)).withColumn("_steps", F.coalesce("steps", F.lit(0))).drop("head", "steps")
    return ranked(full, group, [F.col("_head").asc(), F.col("_steps").asc()], "_rank").withColumn(rank, F.col("_rank")).select(*rows.columns)


def _heads(above: DataFrame, group: list[str]) -> DataFrame:
    """(group, b, head, steps) of rows b with one row `up` before them: the start of the chain and the steps from it.

    `low` is the least row that a pointer has skipped over: once pointers are longer than any chain, those still there go round a ring, and the ring
    is cut before its least row.
    """
    most = above.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    for _ in range(2):
        now = above.select(*group, "b", F.col("up").alias("to"), F.lit(1).cast("long").alias("steps"), F.least("b", "up").alias("low"))
        reach, moved = 1, True
        while moved and reach <= 2 * most + 2:
            up = now.select(F.col("root").alias("_r"), F.col("parent_key").alias("_p"), F.col("b").alias("_b"), F.col("to").alias("_to"), F.col("steps").alias("_s"), F.col("low").alias("_low"))
            on = (F.col("root") == F.col("_r")) & F.col("parent_key").eqNullSafe(F.col("_p")) & (F.col("to") == F.col("_b"))
            now = checkpointed(
                now.join(up, on, "left").select(
                    *group, "b", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"), F.least("low", F.coalesce("_low", "low")).alias("low"),
                    F.col("_to").isNotNull().alias("moved"),
                )
            )
            reach *= 2
            moved = not now.where("moved").isEmpty()
            turning, now = now.where("moved and low = b"), now.drop("moved")
        if not moved:
            return now.select(*group, "b", F.col("to").alias("head"), "steps")
        cut = turning.select(F.col("root").alias("_r"), F.col("parent_key").alias("_p"), F.col("b").alias("_b"))
        on = (F.col("root") == F.col("_r")) & F.col("parent_key").eqNullSafe(F.col("_p")) & (F.col("b") == F.col("_b"))
        above = checkpointed(above.join(cut, on, "left_anti"))
    raise RuntimeError("chains did not come apart")


def display(rows: DataFrame, row: Row, shown: list[tuple[str, Expr]], every: Column | None = None) -> DataFrame:
    """Add `display`: an array of (key, value) texts, null where the value is null.

    `every` is a VARIANT of properties with any keys: each of its keys is a badge, by name, before the others, which then leave out keys that it has.
    """
    pairs = [F.struct(F.lit(k).alias("key"), F.when(e.value(row).col.isNotNull(), badge(e, row)).alias("value")) for k, e in shown]
    named = F.array(*pairs) if pairs else F.array().cast("array<struct<key:string,value:string>>")
    if every is None:
        return rows.withColumn("display", named)
    found = F.coalesce(F.map_entries(F.try_variant_get(every, "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    own = F.transform(
        F.filter(found, lambda x: ~x["key"].startswith("file.") & ~x["key"].startswith("traversal.")), lambda x: F.struct(x["key"].alias("key"), open_badge(x["value"]).alias("value"))
    )
    wide = rows.withColumn("_own", F.array_sort(own))
    keys = F.transform("_own", lambda x: x["key"])
    return wide.withColumn("display", F.concat("_own", F.filter(named, lambda x: ~F.array_contains(keys, x["key"])))).drop("_own")


def open_badge(value: Column) -> Column:
    """The text of a VARIANT value: numbers in their shortest form, lists joined, objects as JSON; null for null."""
    kind = F.schema_of_variant(value)
    as_ = lambda t: F.try_variant_get(value, "$", t)
    number = V.text_of_number(as_("double"))
    return (
        F.when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number)
        .when(kind.startswith("ARRAY"), F.coalesce(F.array_join(as_("array<string>"), ", "), F.to_json(value)))
        .when(kind.startswith("OBJECT"), F.to_json(value))
        .otherwise(as_("string"))
    )


def badge(e: Expr, row: Row) -> Column:
    v = e.value(row)
    return F.array_join(v.col, ", ") if v.kind == "arr" else V.text(v)


def chains(rows: DataFrame, what: str = "path", out: str = "chain") -> DataFrame:
    """Add the values of a column from the top of the tree down to the row, as an array."""
    up = rows.select("root", F.col("key").alias("_above"), F.col(what).alias("_v"))
    above = (
        rows.where(F.col("parent_key").isNotNull())
        .select("root", "key", F.explode(prefixes(F.col("key"), F.col("parent_key"))).alias("_above"))
        .join(up, ["root", "_above"])
        .groupBy("root", "key")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.size("_above").alias("n"), F.col("_v")))), lambda x: x["_v"]).alias("_up"))
    )
    joined = rows.join(above, ["root", "key"], "left")
    none = F.array().cast(f"array<{rows.schema[what].dataType.simpleString()}>")
    return joined.withColumn(out, F.concat(F.coalesce("_up", none), F.array(what))).drop("_up")


def merge_by_path(rows: DataFrame) -> DataFrame:
    """Siblings of one path become one row, and their children one set: (root, chain, path, relations, implied, implied_from, first, kept).

    Merged rows are told apart by the chain of paths that leads to them. relations are the sorted distinct
    relation[.label]; implied only if all are, and only then with the implied_from of the first; first is the least key.
    kept has the first one's display and the columns of its note, where rows have any.
    """
    extra = [c for c in rows.columns if c not in (*ROW, "has_filtered_ancestor", "sibling_rank")]
    named = chains(rows).withColumn("name", F.when(F.col("label").isNotNull(), F.concat_ws(".", "relation", "label")).otherwise(F.col("relation")))
    return named.groupBy("root", "chain").agg(
        F.element_at(F.min("chain"), -1).alias("path"),
        F.array_sort(F.collect_set("name")).alias("relations"),
        F.bool_and("implied").alias("implied"),
        F.when(F.bool_and("implied"), F.min_by("implied_from", "key")).alias("implied_from"),
        F.min("key").alias("first"),
        *([F.min_by(F.struct(*(F.col(f"`{c}`") for c in extra)), "key").alias("kept")] if extra else []),
    )


def signatures(merged: DataFrame) -> DataFrame:
    """Add `signature`: equal for rows whose subtrees hold the same chains of paths, in any order.

    Each row adds a hash of its way down to every row above it; sums and exclusive ors are combined before the shuffle.
    """
    below = merged.where(F.size("chain") > 1).select(
        "root", F.explode(F.sequence(F.lit(1), F.size("chain") - 1)).alias("n"), "chain"
    )
    hashed = below.select(
        "root", F.slice("chain", F.lit(1), F.col("n")).alias("above"),
        F.slice("chain", F.col("n") + 1, F.size("chain") - F.col("n")).alias("way"),
    )
    summed = hashed.groupBy(F.col("root").alias("_r"), F.col("above").alias("_a")).agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("way")).alias("_x"), F.bit_xor(F.xxhash64(F.lit("second"), "way")).alias("_y")
    )
    joined = merged.join(summed, (F.col("root") == F.col("_r")) & (F.col("chain") == F.col("_a")), "left")
    return joined.withColumn("signature", F.concat_ws(":", *(F.coalesce(c, F.lit(0)) for c in ("_n", "_x", "_y")))).drop("_r", "_a", "_n", "_x", "_y")


def cluster(merged: DataFrame) -> DataFrame:
    """Siblings of equal relations and equal subtrees are one group: adds group_first, the least key of its members."""
    signed = signatures(merged).withColumn("up", F.slice("chain", F.lit(1), F.size("chain") - 1))
    groups = signed.groupBy("root", "up", "relations", "signature").agg(F.min("first").alias("group_first"), F.count(F.lit(1)).alias("members"))
    return signed.join(groups, ["root", "up", "relations", "signature"]).drop("up")


def subgroups(clustered: DataFrame) -> DataFrame:
    """What is shown below each group: the groups of its first member's children, as all members have equal ones.

    Of clustered rows those stay whose chain leads through first members only: (root, chain, path, relations, group_first, members).
    """
    led = clustered.where(F.col("first") == F.col("group_first")).select("root", F.col("chain").alias("_above"))
    inner = clustered.where(F.size("chain") > 1)
    each = inner.select("root", "chain", F.explode(F.transform(F.sequence(F.lit(1), F.size("chain") - 1), lambda n: F.slice("chain", F.lit(1), n))).alias("_above"))
    lost = each.join(led, ["root", "_above"], "left_anti").select("root", "chain").distinct()
    return clustered.join(lost, ["root", "chain"], "left_anti").select("root", "chain", "path", "relations", "group_first", "members")


def as_shown(rows: DataFrame, directions: dict[str, str]) -> DataFrame:
    """(root, tip, place, path): each root's tree from the top down, or inverted where its first top row's relation ascends.

    directions gives a relation's way, `descending` where it has none.
    """
    top = rows.where(F.col("parent_key").isNull()).groupBy("root").agg(F.min_by("relation", "key").alias("relation"))
    ways = F.create_map(*(F.lit(x) for pair in directions.items() for x in pair)) if directions else F.create_map().cast("map<string,string>")
    rising = top.where(F.coalesce(F.element_at(ways, F.col("relation")), F.lit("descending")) == "ascending").select("root")
    merged = merge_by_path(rows)
    up = invert(merged.join(rising, "root", "left_semi"))
    down = invert(merged.join(rising, "root", "left_anti"))
    return up.unionByName(down.withColumn("place", F.size("tip") - 1 - F.col("place")))


def invert(merged: DataFrame) -> DataFrame:
    """Ascending view: one chain for each leaf, from the leaf (place 0) up to its top."""
    inner = merged.where(F.size("chain") > 1).select("root", F.slice("chain", F.lit(1), F.size("chain") - 1).alias("chain")).distinct()
    tips = merged.join(inner, ["root", "chain"], "left_anti").select("root", F.col("chain").alias("tip"))
    return tips.select("root", "tip", F.posexplode(F.reverse("tip")).alias("place", "path"))
