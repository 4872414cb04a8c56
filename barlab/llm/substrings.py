"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else in the table. Plain prefix doubling
would sort one row per byte and round; here the positions that are ranked are sampled so that no repeat is missed. Every
window of ``length`` bytes has an anchor: the position in it whose next ``seed`` bytes hash lowest (the first of equals).
Equal windows have equal anchors at equal places, so windows need to be ranked only against those of the same anchor text.

A rank is the hash of the bytes from a position over some length; ranks of longer strings come from prefix sums of ranks of
shorter ones. Each round groups positions by (rank of the part that all windows of a node share, rank of all bytes that
they cover), as prefix doubling groups by pairs of ranks:

* round 1: a node is a run of windows with one anchor; the shared part is the anchor's seed. Nodes with a seed of its
  own are unique and leave. Nodes whose covered bytes occur twice are repeats as a whole.
* later rounds: what is left is cut into narrower nodes (``widths``), down to single windows, whose rank is that of
  ``length`` bytes: past the threshold, nothing is left to decide.

Of equal nodes one goes on as a witness for others, so big groups of copies shrink to one row in the first round. Sizes of
all tables are linear in the text; a key held by many rows is reduced by partial aggregation, and joins have written
tables on both sides, which adaptive execution splits.

Defined cases: null is an empty text; texts shorter than ``length`` are kept; equal texts and repeated rows are repeats of
each other; ids may be null or repeated (rows are told apart by id and text); matches never cross texts; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm import arrays as A
from barlab.llm.frames import written

_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
KEY = ["id", "th", "p"]


def runs(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor, seed rank, rank of all covered bytes) of every run of windows."""
    total = len(data)
    none = np.zeros(0, dtype=np.int64)
    if total < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = A.prefix_hash(data)
    at = np.arange(total - seed + 1)
    seeds = A.range_hash(prefix, at, at + seed)
    best = (seeds & _HIGH) | at.astype(np.uint64)
    reach, width = 1, length - seed + 1
    while 2 * reach <= width:
        best = np.minimum(best[:-reach], best[reach:]) if reach < len(best) else best
        reach *= 2
    if reach < width:
        best = np.minimum(best[: len(best) - (width - reach)], best[width - reach :])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: total - length + 1]
    start = np.flatnonzero(np.arange(total - length + 1) + length <= offsets[doc + 1])
    anchor, doc = (best[start] & _LOW).astype(np.int64), doc[start]
    if not len(start):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    s, n, p, d = start[first], start[last] - start[first] + 1, anchor[first], doc[first]
    return d, s, n, p, seeds[p], A.range_hash(prefix, s, s + n - 1 + length)


def _anchor_rows(batches, length: int, seed: int):
    for batch in batches:
        for part in A.chunks(batch):
            data, offsets = A.texts_of(part.column("text"))
            d, s, n, p, shared, whole = runs(data, offsets, length, seed)
            rows, base = pa.array(d), offsets[d]
            yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("th").take(rows), pa.array((p - base).astype(np.int32)), pa.array((s - base).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(shared.view(np.int64)), pa.array(whole.view(np.int64))],
                                             [*KEY, "s", "n", "shared", "whole"])


def _context_rows(batches, length: int):
    """The bytes that the windows of each asked run cover."""
    names = ["p", "s", "n", "open"]
    for batch in batches:
        for part in A.chunks(batch):
            data, offsets = A.texts_of(part.column("text"))
            asked = part.column("asked")
            of = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
            flat = asked.flatten()
            p, s, n, open_ = (flat.field(k) for k in names)
            lo = offsets[of] + s.to_numpy()
            hi = lo + n.to_numpy() - 1 + length
            raw = data.tobytes()
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("th").take(rows), p, s, n, open_, pa.array([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())], pa.binary())], [*KEY, *names[1:], "data"])


def _node_rows(batches, length: int, width: int):
    """Nodes of ``width`` windows (aligned to the anchor) of each row's windows [s, s + n); ``begin`` is where its bytes start."""
    for batch in batches:
        for part in A.chunks(batch, "data"):
            data, offsets = A.texts_of(part.column("data"))
            prefix = A.prefix_hash(data)
            p, s, n, begin = (part.column(k).to_numpy().astype(np.int64) for k in ("p", "s", "n", "begin"))
            lo, hi = p - (s + n - 1), p - s  # distances of the anchor from the windows' starts
            first, count = lo // width, hi // width - lo // width + 1
            of = np.repeat(np.arange(len(p)), count)
            block = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
            near, far = np.maximum(lo[of], block * width), np.minimum(hi[of], block * width + width - 1)
            home = offsets[of] - begin[of] + p[of]  # the anchor's place in ``data``
            whole = A.range_hash(prefix, home - far, home - near + length)
            if width > 1:
                shared = A.range_hash(prefix, home - block * width, home - block * width - width + 1 + length)
            else:  # a second, independent rank of the window
                shared = A.range_hash(prefix, home - near, home - near + length // 2)
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in KEY), pa.array((p[of] - far).astype(np.int32)), pa.array((far - near + 1).astype(np.int32)), part.column("open").take(rows), pa.array(shared.view(np.int64)), pa.array(whole.view(np.int64))],
                                             [*KEY, "s", "n", "open", "shared", "whole"])




def settle(nodes: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(windows found repeated, nodes to cut further) from nodes with shared and whole rank.

    Open nodes whose whole rank occurs twice are repeated. Where an open node is alone with its bytes but others share
    its common part, one node of each distinct text goes on.
    """
    texts = written(nodes.groupBy("shared", "whole").agg(F.count("*").alias("times"), F.max("open").alias("asked"), F.min(F.struct("id", "th", "p", "s", "n")).alias("one")))
    twice = texts.where("times > 1 and asked").select("shared", "whole")
    found = written(nodes.where("open").join(twice, ["shared", "whole"], "left_semi").select("id", "th", "s", "n"))
    if last:
        return found, None
    alone = (F.col("times") == 1) & F.col("asked")
    mixed = written(texts.groupBy("shared").agg(F.count("*").alias("texts"), F.max(alone).alias("left")).where("texts > 1 and left").select("shared"))
    return found, texts.join(mixed, "shared", "left_semi").select("one.*", alone.alias("open"))


def repeated_windows(rows: DataFrame, length: int, seed: int, widths: tuple[int, ...]) -> DataFrame:
    """(id, th, s, n): windows s to s + n - 1 of a text occur elsewhere as well. ``rows`` has id, th and text."""
    kind = dict(rows.dtypes)["id"]
    shape = f"id {kind}, th bigint, p int, s int, n int, shared bigint, whole bigint"
    anchors = written(rows.mapInArrow(lambda b: _anchor_rows(b, length, seed), shape))
    common = written(anchors.groupBy("shared").count().where("count > 1").select("shared"))
    nodes = written(anchors.join(common, "shared", "left_semi").select(*KEY, "s", "n", F.lit(True).alias("open"), "shared", "whole"))
    found, left = settle(nodes, last=False)

    asked = left.groupBy("id", "th").agg(F.collect_list(F.struct("p", "s", "n", "open")).alias("asked"))
    a = asked.withColumnRenamed("id", "aid").withColumnRenamed("th", "ath")
    met = rows.join(a, rows["id"].eqNullSafe(a["aid"]) & (rows["th"] == a["ath"])).select("id", "th", "text", "asked")
    context = written(met.mapInArrow(lambda b: _context_rows(b, length), f"id {kind}, th bigint, p int, s int, n int, open boolean, data binary").dropDuplicates(KEY))
    todo = context.withColumn("begin", F.col("s"))
    for width in widths:
        nodes = written(todo.mapInArrow(lambda b, w=width: _node_rows(b, length, w), f"id {kind}, th bigint, p int, s int, n int, open boolean, shared bigint, whole bigint"))
        more, left = settle(nodes, last=width == 1)
        found = found.unionByName(more)
        if left is not None:
            c = context.select(F.col("id").alias("cid"), F.col("th").alias("cth"), F.col("p").alias("cp"), F.col("s").alias("begin"), "data")
            todo = left.join(c, left["id"].eqNullSafe(c["cid"]) & (left["th"] == c["cth"]) & (left["p"] == c["cp"])).drop("cid", "cth", "cp")
    return found


def _cut_rows(batches, length: int):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            raw = (text.as_py() or "").encode()
            removed = merge(spans or [], length)
            kept, at = [], 0
            for a, b in removed:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            left = b"".join(kept)
            out.append((len(raw), sum(b - a for a, b in removed), len(removed), hashlib.sha256(left).hexdigest(), left.decode(errors="ignore"), bool(removed)))
        cols = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.bool_())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "changed"])


def merge(spans: list, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the windows of (s, n) spans."""
    out: list[list[int]] = []
    for a, b in sorted((x["s"], x["s"] + x["n"] - 1 + length) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 400, seed: int | None = None, widths: tuple[int, ...] = (16, 1), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, changed) of every row; ``text`` is what is left, without the
    bytes of characters that were cut in two, ``changed`` whether anything was removed."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = repeated_windows(rows.select("id", "th", "text"), length, seed or length // 2, widths)
    spans = found.groupBy("id", "th").agg(F.collect_list(F.struct("s", "n")).alias("spans")).withColumnRenamed("id", "sid").withColumnRenamed("th", "sth")
    met = rows.join(spans, rows["id"].eqNullSafe(spans["sid"]) & (rows["th"] == spans["sth"]), "left").select("id", "text", "spans")
    kind = dict(rows.dtypes)["id"]
    out = met.mapInArrow(lambda b: _cut_rows(b, length), f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string, changed boolean")
    return out.withColumnRenamed("id", id_col)
