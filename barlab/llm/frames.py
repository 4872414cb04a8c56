"""Spark helpers of the training-data operators: written intermediate tables and connected components."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.session import ensure_checkpoint_dir


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder: survives lost executors, cuts the lineage, and
    later joins of it get plain shuffles on both sides, which adaptive execution can split where a key is hot. ``by`` are
    columns whose values get folders of their own, so that reading some of them skips the others."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it (in whatever case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an edge list: (id, component), the component named by its smallest id.

    Every round hooks each vertex to its smallest neighbour, follows hooks by doubling to their ends and goes on with the
    graph of the ends: at most half of the vertices, and only edges between different ends, each once. So an edge is joined in
    the rounds in which it still tells something, not in all of them. Ends when no edge is left. A vertex with many edges is
    reduced by partial aggregation before its shuffle.
    """
    edge = written(_edges(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))))
    name = None
    while True:
        hooks = edge.groupBy("hi").agg(F.min("lo").alias("label")).select(F.col("hi").alias("id"), "label")
        ends = edge.select(F.col("lo").alias("id"), F.col("lo").alias("label")).distinct()
        label = written(hooks.unionByName(ends).groupBy("id").agg(F.min("label").alias("label")))
        while True:
            up = label.select(F.col("id").alias("label"), F.col("label").alias("next"))
            moved = written(label.join(up, "label").select("id", "label", "next"))
            label = moved.select("id", F.col("next").alias("label"))
            if moved.where("label <> next").isEmpty():
                break
        if name is None:
            name = label.select("id", F.col("label").alias("component"))
        else:
            name = written(name.join(label.select(F.col("id").alias("component"), "label"), "component", "left").select("id", F.coalesce("label", "component").alias("component")))
        x, y = (label.select(F.col("id").alias(s), F.col("label").alias(t)) for s, t in (("hi", "x"), ("lo", "y")))
        edge = written(_edges(edge.join(x, "hi").join(y, "lo").select("x", "y")))
        if edge.isEmpty():
            return name


def _edges(pairs: DataFrame) -> DataFrame:
    """(hi, lo): each edge between different vertices once."""
    return pairs.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct()
