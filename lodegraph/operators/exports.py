"""Graphs and logs as files: CSV by the usual quoting, JSON lines, and the counts beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of nodes and of edges, in the order of the files.
NODES, EDGES = ("id", "label", "type", "description", "confidence"), ("id", "source", "target", "label")


def _shaped(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast("double" if c == "confidence" else "string").alias(c) for c in names])


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, form: str = "csv") -> None:
    """Write nodes and edges under path/nodes and path/edges as csv (with a header, quotes doubled) or json lines, and path/metadata.

    Missing columns are null; nulls are empty fields in CSV, where an empty text reads as a null too, and left out in JSON. Files are as many as tasks.
    """
    for name, rows, columns in (("nodes", nodes, NODES), ("edges", edges, EDGES)):
        shaped = _shaped(rows, columns)
        if form == "csv":
            shaped.write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/{name}")
        elif form == "json":
            shaped.write.json(f"{path}/{name}")
        else:
            raise ValueError(f"unknown form {form}")
    spark = nodes.sparkSession
    told = [(form, nodes.count(), edges.count())]
    spark.createDataFrame(told, "form string, node_count long, edge_count long").withColumn("exported_at", F.current_timestamp()).coalesce(1).write.json(f"{path}/metadata")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges under path, as they were written."""
    form = spark.read.json(f"{path}/metadata").first().form
    kinds = lambda names: ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in names)
    out = []
    for name, columns in (("nodes", NODES), ("edges", EDGES)):
        reader = spark.read.schema(kinds(columns))
        out.append(reader.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(f"{path}/{name}") if form == "csv" else reader.json(f"{path}/{name}"))
    return out[0], out[1]


def json_line(columns: list[str]) -> Column:
    """A row's columns as a line of JSON, in order, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_log(rows: DataFrame, path: str, form: str, columns: list[str]) -> None:
    """Write columns of a log as csv, json lines, or json (an array in each file's stead: one line a row, as Spark reads both alike)."""
    kept = rows.select(*columns)
    if form == "csv":
        kept.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif form in ("json", "ndjson"):
        kept.write.option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"unknown form {form}")
