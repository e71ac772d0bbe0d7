"""A folder of notes as a graph: scan, parse, resolve links and names to edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.operators.common import anew, ranked
from arborq.operators.edges import backlinks
from arborq.operators.implied import Rule, renumbered, with_implied
from arborq.plans.query import Graph
from arborq.sources.frontmatter import Relation, parse_front_matter
from arborq.sources.inline import parse_inline

#: The relations and rules that a graph has unless told otherwise.
DEFAULT_RELATIONS = [Relation("up", ("up", "parent")), Relation("down", ("down", "child")), Relation("next", ("next",)), Relation("prev", ("prev",))]
DEFAULT_RULES = [Rule("up", "down", "reverse"), Rule("down", "up", "reverse"), Rule("next", "prev", "reverse"), Rule("prev", "next", "reverse")]
_FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)"


def scan(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """(path, content, modified, size) of every note file, paths relative to the folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    relative = F.regexp_replace(F.col("path"), "^.*?" + quoted(folder.rstrip("/")) + "/", "")
    return files.select(relative.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def front_block(content: Column) -> Column:
    """The block between --- lines at the start of a note; null without one."""
    block = F.regexp_extract(content, _FRONT, 1)
    return F.when(block != "", block)


def resolved(parsed: DataFrame, paths: DataFrame) -> DataFrame:
    """(note, link) to path: the exact path, path + .md, or the shortest note of that base name. Unresolved links are dropped.

    Candidates come from equi joins; the best is a min over each link's candidates.
    """
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    index = paths.select("path", F.explode(F.array_distinct(F.array(F.col("path"), F.regexp_replace("path", r"\.md$", ""), base))).alias("name"))
    exact = (F.col("path") == F.col("link")) | (F.col("path") == F.concat("link", F.lit(".md")))
    hits = parsed.select("link").distinct().join(index, F.col("link") == F.col("name"))
    best = hits.groupBy("link").agg(F.min(F.struct((~exact).alias("far"), F.length("path").alias("n"), F.col("path"))).alias("b"))
    return best.select("link", F.col("b.path").alias("resolved"))


def edges_of(notes: DataFrame, relations: list[Relation] | None = None) -> DataFrame:
    """Explicit edges of notes (path, content, front_matter): inline relations first, then front-matter, in text order.

    Notes are dealt to all tasks, as a file of few megabytes holds many, and each is parsed once: what was found is kept.
    """
    relations = relations if relations is not None else DEFAULT_RELATIONS
    names = notes.sparkSession.createDataFrame([(k.lower(), r.name.lower()) for r in relations for k in dict.fromkeys((r.name, *r.keys))], "name string, uid string").dropDuplicates(["name"])
    dealt = notes.select("path", "content", "front_matter").repartition(int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parsed = parse_front_matter(parse_inline(dealt), relations)
    each = parsed.select("path", F.explode(F.concat("relations", F.transform("front_relations", lambda r: r.withField("pos", r["pos"] + F.lit(1 << 20))))).alias("r"))
    each = anew(each.select("path", "r.source", "r.relation", "r.label", "r.target", "r.pos"))
    ends = each.select(F.explode(F.array("source", "target")).alias("link")).where("link is not null")
    known = resolved(ends, notes.select("path"))
    a = known.select(F.col("link").alias("source"), F.col("resolved").alias("src"))
    b = known.select(F.col("link").alias("target"), F.col("resolved").alias("dst"))
    full = each.join(a, "source", "left").join(b, "target", "left").join(F.broadcast(names), F.col("relation") == F.col("name"))
    full = full.withColumn("from", F.when(F.col("source").isNull(), F.col("path")).otherwise(F.col("src")))
    full = full.withColumn("to", F.when(F.col("target").isNull(), F.col("path")).otherwise(F.col("dst"))).where("`from` is not null and `to` is not null")
    placed = ranked(full, ["from"], [F.col("path").asc(), F.col("pos").asc()], "place")
    return placed.select(
        F.col("from").alias("src"), F.col("to").alias("dst"), F.col("uid").alias("relation"), "label", F.lit(False).alias("implied"),
        F.lit(None).cast("string").alias("implied_from"), F.col("place").alias("ord"),
    )


def build(files: DataFrame, relations: list[Relation] | None = None, rules: list[Rule] | None = None) -> Graph:
    """Graph of scanned files: notes with VARIANT properties, links and backlinks; explicit and implied edges."""
    relations = relations if relations is not None else DEFAULT_RELATIONS
    raw = files.withColumn("front_matter", front_block(F.col("content")))
    links = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: F.trim(F.substring_index(F.substring_index(x, "|", 1), "#", 1))))
    tags = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(r"(?:^|\s)#([A-Za-z][\w/-]*)"), F.lit(1)), lambda t: F.concat(F.lit("#"), t)))
    parsed = parse_front_matter(raw, relations)
    notes = parsed.select(
        "path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "").alias("name"),
        F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("/")).alias("folder"),
        F.col("modified").alias("created"), "modified", "size", tags.alias("tags"), links.alias("links"), F.try_parse_json("properties_json").alias("properties"),
    )
    pairs = notes.select("path", F.explode("links").alias("link"))
    known = resolved(pairs, notes.select("path"))
    found = pairs.join(known, "link").groupBy("path").agg(F.array_sort(F.collect_set("resolved")).alias("_l"))
    notes = notes.join(found, "path", "left").withColumn("links", F.coalesce("_l", F.array().cast("array<string>"))).drop("_l")
    notes = notes.join(backlinks(notes), "path", "left").withColumn("backlinks", F.coalesce("backlinks", F.array().cast("array<string>")))
    return Graph(notes, renumbered(with_implied(edges_of(raw, relations), rules if rules is not None else DEFAULT_RULES)))
