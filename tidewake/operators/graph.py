"""Traces and summaries of a call graph of nodes and edges."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 200
TOOLS = ("query_graph", "trace_path", "get_architecture", "manage_adr")


def enriched_arguments(tool: str, arguments: dict[str, Any], project: str) -> dict[str, Any]:
    """The arguments of a graph tool with its project; an unknown tool is an error."""
    if tool not in TOOLS:
        raise ValueError(f"not a graph tool: {tool}")
    return arguments | {"project": project}


def query(view_sql: str, nodes: DataFrame, edges: DataFrame, limit: int = ROWS) -> DataFrame:
    """SQL over the views nodes and edges, at most limit rows."""
    return nodes.sparkSession.sql(view_sql, nodes=nodes, edges=edges).limit(limit)


def trace(edges: DataFrame, start: DataFrame, direction: str = "outbound", depth: int = 3) -> DataFrame:
    """(node, depth) of what is reached from the start nodes in at most depth steps, each at its least depth."""
    if direction not in ("inbound", "outbound", "both"):
        raise ValueError(f"not a direction: {direction}")
    out, back = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))
    steps = {"outbound": out, "inbound": back, "both": out.unionByName(back)}[direction].distinct()
    front = start.select("node").distinct()
    found = front.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        front = front.join(steps, "node").select(F.col("next").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        found = found.unionByName(front.withColumn("depth", F.lit(d)))
    return found


def architecture(nodes: DataFrame, edges: DataFrame, prefix: str = "") -> DataFrame:
    """(directory, nodes, calls_out, calls_in) of the directories below prefix; nodes: (node, path)."""
    inside = nodes if not prefix else nodes.where(F.startswith("path", F.lit(prefix.rstrip("/") + "/")))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_in"))
    rows = inside.withColumn("directory", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).join(out, "node", "left").join(into, "node", "left")
    return rows.groupBy("directory").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("_out"), F.lit(0)).alias("calls_out"), F.coalesce(F.sum("_in"), F.lit(0)).alias("calls_in"))


class Records:
    """Decision records by name: read, written as a whole, listed by section."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def get(self, name: str) -> DataFrame:
        return self.rows.where(F.col("name") == name)

    def update(self, name: str, section: str, text: str) -> Records:
        new = self.rows.sparkSession.createDataFrame([(name, section, text)], "name string, section string, text string")
        return Records(self.rows.where((F.col("name") != name) | (F.col("section") != section)).unionByName(new))

    def sections(self, name: str) -> DataFrame:
        return self.get(name).select("section").distinct().orderBy("section")
