"""Rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard with the highest score for its key. The score of a shard depends on the key, the shard's
number and its weight alone, so one more shard takes records only into itself (a share of its weight), and a removed
one gives up only its own. Slots number a shard's records without gaps and without sorting a shard in one task: each
shard is cut into blocks by a hash of the key, block counts give each block's first slot, and rows are numbered inside
their block.

Columns and SQL functions only. Defined cases: a null key hashes like an empty string; equal keys go to one shard and
are numbered by their text's checksum; a null text has no bytes; an empty table gives an empty result; columns of the
input other than key and text are not read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks per shard for numbering: with a billion rows in a shard a block has 15,000.
BLOCKS = 65_536


def unit(key: Column, salt: Column | str) -> Column:
    """A number in (0, 1) from the md5 of key and salt: 48 of its bits."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), salt if isinstance(salt, Column) else F.lit(salt))), 1, 12), 16, 10).cast("bigint")
    return (bits + 0.5) / float(2**48)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that ``key`` belongs to; a shard of weight 0 gets nothing, equal scores go to the lower number."""
    scores = [F.struct((-F.log(unit(key, str(s))) / float(w)).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("no shard has a positive weight")
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; ``grown`` are the weights after growth."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
                       rendezvous(F.col(id_col), weights).cast("int").alias("shard"),
                       (rendezvous(F.col(id_col), grown) if grown else F.lit(None)).cast("int").alias("grown_shard"))
    # rows of one id (null ids above all) are spread over blocks by their texts
    rows = rows.withColumn("block", F.floor(unit(F.col(id_col), F.concat(F.lit("block:"), F.col("text_crc32").cast("string"))) * blocks).cast("int"))
    counts = rows.groupBy("shard", "block").count()
    # a shard has at most ``blocks`` rows here
    first = counts.select("shard", "block", (F.sum("count").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    inside = rows.withColumn("at", F.row_number().over(Window.partitionBy("shard", "block").orderBy(F.col(id_col), "text_crc32", "size")))
    return inside.join(first, ["shard", "block"]).select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.coalesce("before", F.lit(0)) + F.col("at") - 1).alias("slot"), "grown_shard")
