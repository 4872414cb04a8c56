"""A vector table that grows by batches, and exact top-k search for any number of queries.

Vectors are scaled to length one and stored in blocks: one row holds the ids and the matrix of up to ``rows`` vectors that lie
in a similar direction (they have the same signs on a few fixed projections), with the block's centre and radius. A batch is
one folder of blocks. A vector that is written again stays in its old block, but a tombstone (batch, block, place) hides it,
so no old file is rewritten; ``compact`` writes what is visible as one new batch.

A search deals corpus blocks to G groups and query blocks to H groups and lets each pair of groups meet once, in one task: both
sides are tables, nothing passes through the driver, and the corpus is read once for however many queries. In a task, blocks
are taken nearest first, and a block is skipped for the queries that cannot find anything better in it: no vector of the block is
closer than the distance to its centre less its radius. What leaves a task are k rows per query; a window merges the G lists.

Defined cases: a null vector or id is left out; a vector of zeros is as far from everything as unit vectors at right angles; of an
id that a batch holds twice the row of the smallest hash counts; ties go to the smaller id; an empty table or no queries give an
empty result; a batch that was written completely is not written again.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.session import ensure_checkpoint_dir, has_files

#: Signs that tell directions apart: blocks of one direction have small radii.
SIGNS = 6
#: Slack of the skipping rule against rounding.
SLACK = 1e-9


def _units(column: pa.Array) -> np.ndarray:
    """Rows of length one from a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(n, len(flat) // n) if n else np.zeros((0, 0))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _units(batch.column("vector"))
        planes = np.random.default_rng(7).standard_normal((x.shape[1], SIGNS))
        code = ((x @ planes > 0) @ (1 << np.arange(SIGNS))).astype(np.int32) if len(x) else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([row.tobytes() for row in x], pa.binary()), pa.array(code)], ["id", "unit", "code"])


def _pack(group: pa.Table) -> pa.Table:
    """One block from the rows of a group."""
    x = np.frombuffer(b"".join(group.column("unit").to_pylist())).reshape(group.num_rows, -1)
    centre = x.mean(axis=0)
    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
    ids = group.column("id").combine_chunks()
    return pa.table({"code": group.column("code").slice(0, 1), "salt": group.column("salt").slice(0, 1), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "n": pa.array([len(ids)], pa.int32()),
                     "matrix": pa.array([x.tobytes()], pa.binary()), "centre": pa.array([centre.tobytes()], pa.binary()), "radius": pa.array([radius])})


def blocks_of(vectors: DataFrame, rows: int = 4096, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(block, ids, n, matrix, centre, radius) of at most about ``rows`` vectors each."""
    kind = dict(vectors.dtypes)[id_col]
    some = vectors.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).alias("vector"))
    coded = some.mapInArrow(_directions, f"id {kind}, unit binary, code int")
    held = coded.groupBy("code").count().select("code", F.ceil(F.col("count") / rows).cast("int").alias("parts"))  # at most 2 ** SIGNS rows
    salted = coded.join(F.broadcast(held), "code").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    packed = salted.select("id", "unit", "code", "salt").groupBy("code", "salt").applyInArrow(_pack, f"code int, salt int, ids array<{kind}>, n int, matrix binary, centre binary, radius double")
    return packed.select(F.concat_ws("-", "code", "salt").alias("block"), "ids", "n", "matrix", "centre", "radius")


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int, ids: np.ndarray):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), ids[:0]

    def offer(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores (queries ``at`` x ids) of a block."""
        least = self.least[at]
        if score.shape[1] >= self.k:
            least = np.maximum(least, np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k])
        row, col = np.nonzero(score >= least[:, None])
        query, value, name = np.concatenate([self.query, at[row]]), np.concatenate([self.score, score[row, col]]), np.concatenate([self.id, ids[col]])
        order = np.lexsort((name, -value, query))
        query, value, name = query[order], value[order], name[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.query, self.score, self.id = query[keep], value[keep], name[keep]
        full = rank[keep] == self.k - 1
        self.least[self.query[full]] = self.score[full]


def best_in_blocks(queries: np.ndarray, blocks: list[tuple], k: int) -> Best | None:
    """Best vectors of (ids, matrix, centre, radius, hidden places) blocks for each row of ``queries``."""
    if not blocks:
        return None
    gap = np.stack([np.linalg.norm(queries - centre, axis=1) - radius for _, _, centre, radius, _ in blocks], axis=1)
    best = Best(len(queries), k, blocks[0][0])
    for b in np.argsort(gap.min(axis=0)):
        ids, matrix, _, _, hidden = blocks[b]
        # a score is 1 - distance squared
        at = np.flatnonzero(1 - np.maximum(gap[:, b], 0) ** 2 >= best.least - SLACK)
        if len(at):
            score = np.round(1 - (2 - 2 * (queries[at] @ matrix.T)), 12)  # equal vectors get equal scores
            if len(hidden):
                score, ids = np.delete(score, hidden, axis=1), np.delete(ids, hidden)
            if len(ids):
                best.offer(at, score, ids)
    return best


def grid_search(blocks: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id", vec: str = "embedding", id_col: str = "vec_id", group_bytes: int = 64_000_000) -> DataFrame:
    """(query_id, vec_id, score, rank): the exact k nearest of ``blocks`` (with optional array ``hidden``) for all queries."""
    spark = blocks.sparkSession
    asked = blocks_of(queries, 1024, query_id, vec).select(F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("matrix").alias("qmatrix"))
    if "hidden" not in blocks.columns:
        blocks = blocks.withColumn("hidden", F.array().cast("array<int>"))
    folder = f"{ensure_checkpoint_dir(spark)}/queries-{uuid4().hex}"
    asked.write.parquet(folder)
    asked = spark.read.parquet(folder)
    sizes = lambda df, c: df.agg(F.sum(F.octet_length(c))).first()[0] or 0
    tall, wide = (max(1, -(-sizes(df, c) // group_bytes)) for df, c in ((blocks, "matrix"), (asked, "qmatrix")))
    tall = max(tall, min(spark.sparkContext.defaultParallelism, blocks.count()))
    left = blocks.withColumn("g", F.pmod(F.xxhash64("block", F.col("ids")[0]), F.lit(tall)).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(wide - 1)))).select("g", "h", "ids", "matrix", "centre", "radius", "hidden")
    right = asked.withColumn("h", F.pmod(F.xxhash64("qblock"), F.lit(wide)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(tall - 1)))).select("g", "h", "qids", "qmatrix")
    id_type, query_type = dict(blocks.dtypes)["ids"][6:-1], dict(queries.dtypes)[query_id]

    def meet(corpus: pa.Table, block: pa.Table) -> pa.Table:
        rows = list(zip(corpus.column("ids").to_pylist(), corpus.column("matrix").to_pylist(), corpus.column("centre").to_pylist(), corpus.column("radius").to_pylist(), corpus.column("hidden").to_pylist()))
        held = [(np.array(ids), np.frombuffer(m).reshape(len(ids), -1), np.frombuffer(c), r, np.array(h or [], dtype=np.int64)) for ids, m, c, r, h in rows]
        names, ids, scores = [], [], []
        for qids, matrix in zip(block.column("qids").to_pylist(), block.column("qmatrix").to_pylist()):
            best = best_in_blocks(np.frombuffer(matrix).reshape(len(qids), -1), held, k)
            if best is not None:
                names += [qids[i] for i in best.query.tolist()]
                ids += best.id.tolist()
                scores += best.score.tolist()
        return pa.table({query_id: pa.array(names, block.schema.field("qids").type.value_type), id_col: pa.array(ids, corpus.schema.field("ids").type.value_type), "score": pa.array(scores, pa.float64())})

    lists = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(meet, f"{query_id} {query_type}, {id_col} {id_type}, score double")
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), id_col)  # G lists of k
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class VectorTable:
    """Vectors with their metadata in a folder of Parquet batches."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint"):
        self.spark, self.folder, self.id_type = spark, folder.rstrip("/"), id_type

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not has_files(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _blocks(self) -> DataFrame:
        return self._read("blocks", f"block string, ids array<{self.id_type}>, n int, matrix binary, centre binary, radius double, batch bigint")

    def _hidden(self) -> DataFrame:
        return self._read("hidden", "of bigint, block string, place int, batch bigint")

    def _metadata(self) -> DataFrame:
        return self._read("metadata", f"vec_id {self.id_type}, content string, metadata string, batch bigint")

    def _done(self, name: str, batch: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/batch={batch}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def write(self, batch: int, rows: DataFrame, rows_per_block: int = 4096) -> None:
        """Add or replace the vectors of ``rows`` (vec_id, embedding, content, metadata) as batch number ``batch``.

        Each part is written by Spark's committer and skipped if it is complete, so a retry after a failure at any point ends
        with the same table. Batches are numbered in the order in which they count.
        """
        other = ["embedding", "content", "metadata"]
        one = rows.where("vec_id is not null and embedding is not null").groupBy("vec_id").agg(F.min_by(F.struct(*other), F.xxhash64(*other)).alias("r")).select("vec_id", "r.*")
        if not self._done("metadata", batch):
            one.select("vec_id", "content", "metadata").write.mode("overwrite").parquet(f"{self.folder}/metadata/batch={batch}")
        if not self._done("hidden", batch):
            places = self._blocks().where(F.col("batch") < batch).select(F.col("batch").alias("of"), "block", F.posexplode("ids").alias("place", "vec_id"))
            places.join(one.select("vec_id"), "vec_id", "left_semi").select("of", "block", "place").write.mode("overwrite").parquet(f"{self.folder}/hidden/batch={batch}")
        if not self._done("blocks", batch):
            blocks_of(one, rows_per_block).write.mode("overwrite").parquet(f"{self.folder}/blocks/batch={batch}")

    def visible(self) -> DataFrame:
        """Blocks with the places that later batches hide; a batch counts once its blocks are written."""
        blocks = self._blocks()
        counted = self._hidden().join(blocks.select("batch").distinct(), "batch", "left_semi")
        gone = counted.groupBy("of", "block").agg(F.collect_set("place").alias("hidden"))  # of one block
        b = gone.select("of", F.col("block").alias("in_block"), "hidden")
        return blocks.join(b, (F.col("batch") == F.col("of")) & (F.col("block") == F.col("in_block")), "left").drop("of", "in_block").withColumn("hidden", F.coalesce("hidden", F.array().cast("array<int>")))

    def rows(self) -> DataFrame:
        """(vec_id, batch, content, metadata) of every visible vector."""
        seen = self.visible().select("batch", "hidden", F.posexplode("ids").alias("place", "vec_id")).where(~F.array_contains("hidden", F.col("place"))).select("batch", "vec_id")
        return seen.join(self._metadata(), ["vec_id", "batch"]).select("vec_id", "batch", "content", "metadata")

    def search(self, queries: DataFrame, k: int = 5, query_id: str = "query_id", vec: str = "embedding", **options) -> DataFrame:
        """(query_id, vec_id, score, rank, content, metadata): the k nearest visible vectors of each query."""
        hits = grid_search(self.visible(), queries, k, query_id, vec, **options)
        return hits.join(self.rows().drop("batch"), "vec_id").select(query_id, "vec_id", "score", "rank", "content", "metadata")

    def compact(self, batch: int, keep_from: int = 0, rows_per_block: int = 4096) -> VectorTable:
        """A new table of one batch, beside this one, of what is visible and was written in batch ``keep_from`` or later."""
        out = VectorTable(self.spark, f"{self.folder}-{batch}", self.id_type)

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, matrix, hidden in zip(b.column("ids"), b.column("matrix").to_pylist(), b.column("hidden").to_pylist()):
                    x = np.frombuffer(matrix).reshape(len(ids), -1)
                    keep = np.setdiff1d(np.arange(len(ids)), np.array(hidden, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(keep)), pa.array(list(x[keep]), pa.list_(pa.float64()))], ["vec_id", "embedding"])

        vectors = self.visible().where(F.col("batch") >= keep_from).select("ids", "matrix", "hidden").mapInArrow(unpack, f"vec_id {self.id_type}, embedding array<double>")
        out.write(batch, vectors.join(self.rows().where(F.col("batch") >= keep_from).drop("batch"), "vec_id"), rows_per_block)
        return out
