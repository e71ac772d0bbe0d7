"""The relational tables as a graph: rows are notes `kind/key.md`, foreign keys are `up` edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.operators.implied import Rule, with_implied
from arborq.plans.query import Graph

LEVELS = ("region", "nation", "customer", "supplier", "orders")
RULES = [Rule("up", "down", "reverse")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}/"), key.cast("string"), F.lit(".md"))


def _note(df: DataFrame, kind: str, key: str, props: dict[str, Column], created: Column | None = None, tags: Column | None = None, link: Column | None = None) -> DataFrame:
    return df.select(
        path(kind, F.col(key)).alias("path"),
        F.col(key).cast("string").alias("name"),
        F.lit(kind).alias("folder"),
        (created if created is not None else F.lit(None)).cast("timestamp").alias("created"),
        (created if created is not None else F.lit(None)).cast("timestamp").alias("modified"),
        (F.lit(100) + F.col(key)).cast("long").alias("size"),
        (F.array(tags) if tags is not None else F.array().cast("array<string>")).alias("tags"),
        (F.array(link) if link is not None else F.array().cast("array<string>")).alias("links"),
        *(c.alias(n) for n, c in props.items()),
    )


def notes(spark: SparkSession, sf_dir: str, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    made = {
        "region": lambda: _note(t("region"), "region", "r_regionkey", {"title": F.col("r_name")}),
        "nation": lambda: _note(t("nation"), "nation", "n_nationkey", {"title": F.col("n_name")}, link=path("region", F.col("n_regionkey"))),
        "customer": lambda: _note(
            t("customer"), "customer", "c_custkey",
            {"title": F.col("c_name"), "acctbal": F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")), "segment": F.col("c_mktsegment")},
            tags=F.concat(F.lit("#"), F.lower("c_mktsegment")), link=path("nation", F.col("c_nationkey")),
        ),
        "supplier": lambda: _note(
            t("supplier"), "supplier", "s_suppkey", {"title": F.col("s_name"), "acctbal": F.col("s_acctbal")}, link=path("nation", F.col("s_nationkey")),
        ),
        "orders": lambda: _note(
            t("orders"), "orders", "o_orderkey", {"status": F.col("o_orderstatus"), "price": F.col("o_totalprice"), "priority": F.col("o_orderpriority")},
            created=F.col("o_orderdate"), tags=F.lower("o_orderstatus"), link=path("customer", F.col("o_custkey")),
        ),
    }
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [made[n]() for n in levels])


def label_of(priority: Column) -> Column:
    return F.lower(F.regexp_replace(priority, "[^A-Za-z0-9_-]+", "_"))


def _edge(df: DataFrame, a: Column, b: Column, key: Column, label: Column | None = None, relation: str = "up") -> DataFrame:
    return df.select(
        a.alias("src"), b.alias("dst"), F.lit(relation).alias("relation"), (label if label is not None else F.lit(None)).cast("string").alias("label"),
        F.lit(False).alias("implied"), F.lit(None).cast("string").alias("implied_from"), key.cast("long").alias("ord"),
    )


def up_edges(spark: SparkSession, sf_dir: str, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """`up` edges; ord is the lower note's key (suppliers after customers), so that the reverse edges of a note have distinct ones."""
    t = lambda n: read(spark, sf_dir, n)
    made = {
        "nation": lambda: _edge(t("nation"), path("nation", F.col("n_nationkey")), path("region", F.col("n_regionkey")), F.col("n_nationkey")),
        "customer": lambda: _edge(t("customer"), path("customer", F.col("c_custkey")), path("nation", F.col("c_nationkey")), F.col("c_custkey") * 2),
        "supplier": lambda: _edge(t("supplier"), path("supplier", F.col("s_suppkey")), path("nation", F.col("s_nationkey")), F.col("s_suppkey") * 2 + 1),
        "orders": lambda: _edge(
            t("orders"), path("orders", F.col("o_orderkey")), path("customer", F.col("o_custkey")), F.col("o_orderkey"), label_of(F.col("o_orderpriority"))
        ),
    }
    return reduce(DataFrame.unionByName, [made[n]() for n in levels if n in made])


def hierarchy(spark: SparkSession, sf_dir: str, levels: tuple[str, ...] = LEVELS) -> Graph:
    """Region, nation, customer, supplier and orders with `up` and the implied `down`."""
    return Graph(notes(spark, sf_dir, levels), with_implied(up_edges(spark, sf_dir, levels), RULES))


def sequences(spark: SparkSession, sf_dir: str) -> Graph:
    """Events of each user in time order: `next` to the following one (its type as label), `prev` back."""
    from pyspark.sql.window import Window

    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    after = e.withColumn("n", F.lead("event_id").over(w)).where("n is not null")
    own = e.select(
        path("events", F.col("event_id")).alias("path"), F.col("event_id").cast("string").alias("name"), F.lit("events").alias("folder"),
        F.col("ts").cast("timestamp").alias("created"), F.col("event_type").alias("type"), "value",
    )
    forward = _edge(after, path("events", F.col("event_id")), path("events", F.col("n")), F.lit(1), F.col("event_type"), "next")
    return Graph(own, with_implied(forward, [Rule("next", "prev", "reverse")]))
