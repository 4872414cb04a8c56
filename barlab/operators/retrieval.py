"""Document chunking, exact vector search, bounded context."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.text import tokens
from barlab.operators.vectors import blocks_of, grid_search

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 150
SEPARATORS = ("\n\n", "\n", " ", "")
#: Most queries that are broadcast; more meet the corpus block by block.
QUERY_SLICE = 4096


def clean_lines(text: str) -> str:
    return "\n".join(line for line in (raw.strip() for raw in (text or "").splitlines()) if line)


def _pieces(text: str, separators: tuple[str, ...], size: int) -> Iterator[list[str]]:
    """Runs of pieces shorter than ``size``; a longer piece is split by the next separator."""
    sep = next((s for s in separators if not s or s in text), "")
    rest = separators[separators.index(sep) + 1:]
    parts = re.split(f"(?={re.escape(sep)})", text) if sep else list(text)
    run: list[str] = []
    for part in filter(None, parts):
        if len(part) < size or not rest:
            run.append(part)
            continue
        if run:
            yield run
            run = []
        yield from _pieces(part, rest, size)
    if run:
        yield run


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Chunks of at most ``size`` characters, cut at paragraph, line, word or character, that share up to
    ``overlap`` characters with their predecessor."""
    chunks: list[str] = []
    for run in _pieces(text or "", SEPARATORS, size):
        held: list[str] = []
        length = 0
        for piece in run:
            if held and length + len(piece) > size:
                chunks.append("".join(held).strip())
                while held and (length > overlap or length + len(piece) > size):
                    length -= len(held.pop(0))
            held.append(piece)
            length += len(piece)
        chunks.append("".join(held).strip())
    return [c for c in map(clean_lines, chunks) if c]


def split_long(text: str, limit: int) -> list[str]:
    """Paragraph groups up to ``limit``; longer paragraphs by sentence, longer sentences by length."""
    if len(text) <= limit:
        return [text] if text else []
    out: list[str] = []

    def gather(parts: list[str], glue: str) -> None:
        held = ""
        for part in parts:
            if len(held) + len(part) + len(glue) > limit:
                out.append(held.strip())
                held = ""
            held += part + glue
        out.append(held.strip())

    short: list[str] = []
    for para in re.split(r"\n{2,}", text):
        if len(para) + 2 > limit:
            gather(short, "\n\n") if short else None
            short = []
            gather(re.split(r"(?<=[.!?])\s+", para), " ")
        else:
            short.append(para)
    gather(short, "\n\n") if short else None
    return [c[i:i + limit] for c in out if c for i in range(0, len(c), limit)]


def _exploded(docs: DataFrame, text: str, fn, out: str) -> DataFrame:
    keep = [f for f in docs.schema if f.name != text]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + f", chunk_no int, {out} string"
    names = [f.name for f in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [(n, c, t) for n, body in enumerate(pdf[text]) for c, t in enumerate(fn(body or ""))]
            rows = pdf[names].iloc[[n for n, _, _ in parts]].reset_index(drop=True)
            yield rows.assign(chunk_no=[c for _, c, _ in parts], **{out: [t for _, _, t in parts]})

    return docs.mapInPandas(run, schema)


def chunk_documents(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk with the document's other columns and ``chunk_no``. Narrow: no shuffle."""
    return _exploded(docs, text, lambda t: split_text(t, size, overlap), "content")


def split_long_texts(docs: DataFrame, limit: int, text: str = "text") -> DataFrame:
    return _exploded(docs, text, lambda t: split_long(t, limit), "content")


# ---------------------------------------------------------------- vectors


def unit(col: Column) -> Column:
    """Vector scaled to length one, in double."""
    as_double = F.transform(col, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(as_double, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(as_double, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def label_centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per label: dimensions are averaged separately, so a hot label is combined map-side."""
    dims = vectors.select(label, F.posexplode(vec).alias("d", "x"))
    means = dims.groupBy(label, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s.m).alias(vec))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec: str = "embedding", query_col: str = "query_id") -> DataFrame:
    """Exact k nearest stored vectors per query by squared distance of unit vectors; score = 1 - d².

    Up to ``QUERY_SLICE`` queries are one broadcast matrix: each task compares its batches with it and keeps k rows
    per query. More queries are a table of blocks that meets the vectors' blocks in a grid (``vectors.grid_search``), so the
    corpus is read once for any number of them and none passes through the driver.
    """
    spark = vectors.sparkSession
    rows = queries.select(query_col, unit(F.col(vec)).alias("_q")).limit(QUERY_SLICE + 1).collect()
    if len(rows) > QUERY_SLICE:
        return grid_search(blocks_of(vectors, id_col=id_col, vec=vec), queries, k, query_col, vec, id_col)
    query_type = queries.schema[query_col].dataType.simpleString()
    if not rows:
        return spark.createDataFrame([], f"{query_col} {query_type}, {id_col} {vectors.schema[id_col].dataType.simpleString()}, score double, rank int")
    best = _search(spark, vectors, rows, k, id_col, vec, query_col, query_type)
    w = Window.partitionBy(query_col).orderBy(F.col("score").desc(), id_col)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _search(spark, vectors, rows, k, id_col, vec, query_col, query_type) -> DataFrame:
    shared = spark.sparkContext.broadcast((np.array([r[query_col] for r in rows]), np.array([r["_q"] for r in rows], dtype=float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        held_ids = held = None
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf[vec].to_numpy()).astype(float)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            score = 1 - (2 - 2 * (matrix @ x.T))  # queries x rows
            names = np.broadcast_to(pdf[id_col].to_numpy(), score.shape)
            if held is not None:
                score, names = np.hstack([held, score]), np.hstack([held_ids, names])
            order = np.lexsort((names, -score), axis=1)[:, :k]
            held, held_ids = np.take_along_axis(score, order, 1), np.take_along_axis(names, order, 1)
        if held is not None:
            n = held.shape[1]
            yield pd.DataFrame({query_col: np.repeat(ids, n), id_col: held_ids.ravel(), "score": held.ravel()})

    id_type = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vec).mapInPandas(run, f"{query_col} {query_type}, {id_col} {id_type}, score double")


def bounded_context(hits: DataFrame, budget: int, per_snippet: int | None = None, query_col: str = "query_id", rank: str = "rank", content: str = "content") -> DataFrame:
    """Numbered snippets per query that fit the token budget; the one on the boundary is cut. The hits of one
    query are its k results."""
    snippet = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.trim(F.substring(content, 1, per_snippet) if per_snippet else F.col(content)), F.lit("\n"))
    upto = Window.partitionBy(query_col).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    df = hits.withColumn("_s", snippet).withColumn("_t", tokens(F.col("_s"))).withColumn("_cum", F.sum("_t").over(upto))
    left = budget - (F.col("_cum") - F.col("_t"))
    df = df.filter(F.col("_cum") - F.col("_t") < budget).withColumn("_s", F.when(F.col("_cum") <= budget, F.col("_s")).otherwise(F.substring(F.col("_s"), F.lit(1), (left * 4).cast("int"))))
    df = df.filter((F.col("_cum") <= budget) | (left > 0))
    return df.groupBy(query_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rank, "_s"))), lambda x: x["_s"]), "").alias("context"), F.count(F.lit(1)).alias("snippets"))
