"""Where results go: files, and a text tree for small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write(rows: DataFrame, folder: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write to a new folder; text formats get arrays and structs as JSON texts."""
    if kind == "csv":
        rows = rows.select(*(F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in rows.schema.fields))
    rows.write.format(kind).partitionBy(*(partition_by or [])).save(folder)


def outline(rows: DataFrame, limit: int = 200) -> str:
    """The first rows in the order of the walk, indented by their place, for reading."""
    some = rows.orderBy("root", "key").limit(limit).select("root", "path", "relation", F.size("key").alias("n")).collect()
    return "\n".join("  " * (r["n"] - 2) + f"{r['path']} ({r['relation']})" for r in some)
