"""Quality rules: rule statistics of whole texts, judged by an isolation forest.

The forest isolates points by random splits; an unusual document is cut off after few of them. Trees grow on
documents labelled good; the threshold on the anomaly score is set on labelled rows of both kinds. The forest (a few
hundred kilobytes at most) is the only thing that passes through the driver; statistics and scores are computed per
Arrow batch in one pass over the table, without a shuffle.

Defined cases: a null or empty text has no words and fails the base rules; a table without usable labels keeps what
passes the base rules; rows with a null id are judged like others; repeated rows get the same verdict each; of several
texts under one labelled id the one of the smallest md5 trains, whatever the order of rows; columns of the input are passed on
untouched: a result column whose name an input column has gets an underscore at its end (``judge``), ``passing`` adds none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm import arrays as A
from barlab.llm.frames import fresh

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rule statistics that the forest sees, with the least width of a split's range beyond the values seen.
RATIOS = {"symbols_per_word": 0.05, "repeat_share": 0.1, "dup_line_share": 0.1, "word_length": 0.5, "capitals_share": 0.1}

_IS = {name: bytes(int(b in chars) for b in range(256)) for name, chars in {"symbol": SYMBOLS, "capital": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}.items()}


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts and ratios of each text; words are runs of anything but ASCII white space."""
    data, offsets = A.texts_of(column)
    n = len(offsets) - 1
    start, end, doc = A.word_spans(data, offsets)
    words, inside = np.bincount(doc, minlength=n), A.in_word(data)
    first = A.per_doc(A.running(inside & ((data & 0xC0) != 0x80)), offsets)
    count = {name: A.per_doc(A.running(A.marks(data, table)), offsets) for name, table in _IS.items()}
    prefix = A.prefix_hash(data)
    hashed = A.range_hash(prefix, start, end)
    salt = A.mix(np.arange(1, n + 1, dtype=np.uint64))

    # words inside three-word windows that occur twice or more in their text
    repeated = np.zeros(len(start), dtype=bool)
    windows = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, dtype=np.int64)
    if len(windows):
        m = np.uint64(0xD1342543DE82EF95)
        key = A.mix((hashed[windows] * m + hashed[windows + 1]) * m + hashed[windows + 2]) ^ salt[doc[windows]]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = windows[twice]
        repeated[at] = repeated[at + 1] = repeated[at + 2] = True
    repeat_words = np.bincount(doc[repeated], minlength=n)

    # lines that hold a word and equal an earlier line of their text
    lo, hi, line_doc = A.line_spans(data, offsets)
    held = A.running(inside)
    filled = held[hi] > held[lo]
    lo, hi, line_doc = lo[filled], hi[filled], line_doc[filled]
    line = A.range_hash(prefix, lo, hi) ^ salt[line_doc]
    lines = np.bincount(line_doc, minlength=n)
    kept = np.unique(line, return_index=True)[1]
    dup_lines = lines - np.bincount(line_doc[kept], minlength=n)

    some, letters = np.maximum(words, 1), np.maximum(first, 1)
    out = {"n_words": words, "word_chars": first, "n_symbols": count["symbol"], "n_dup_lines": dup_lines, "n_repeat_words": repeat_words}
    out = {k: v.astype(np.int64) for k, v in out.items()}
    return out | {
        "symbols_per_word": count["symbol"] / some, "repeat_share": repeat_words / some, "dup_line_share": dup_lines / np.maximum(lines, 1),
        "word_length": first / some, "capitals_share": count["capital"] / letters,
    }


def base_failed(stats: dict[str, np.ndarray], min_words: int = 50, max_repeat_percent: int = 50) -> np.ndarray:
    return (stats["n_words"] < min_words) | (100 * stats["n_repeat_words"] > max_repeat_percent * stats["n_words"])


@dataclass
class Forest:
    """Isolation trees as flat arrays: feature (-1: leaf), split value, left child (right is the next), path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    sample: int
    threshold: float = np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 to the minus mean path length over the mean of a random search tree."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (open_ := self.feature[node] >= 0).any():
                at = rows[open_]
                here = node[at]
                node[at] = self.left[here] + (x[at, self.feature[here]] >= self.value[here])
            total += self.depth[node]
        return 2.0 ** (-total / (len(self.roots) * mean_path(self.sample)))


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a random search tree of ``n`` points."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow_forest(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7) -> Forest:
    """Random isolation trees on ``x`` (rows, features). A split is drawn uniformly a little beyond the node's range,
    so that a value outside all that the tree has seen is cut off early as well."""
    rng = np.random.default_rng(seed)
    feature, value, left, depth, roots = [], [], [], [], []
    size = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2)))) + 2
    margin = np.maximum(x.std(axis=0), list(RATIOS.values()))

    def node() -> int:
        for part, empty in ((feature, -1), (value, 0.0), (left, 0), (depth, 0.0)):
            part.append(empty)
        return len(feature) - 1

    for _ in range(trees):
        root = node()
        roots.append(root)
        todo = [(root, x[rng.choice(len(x), size, replace=False)], 0)]
        while todo:
            at, points, level = todo.pop()
            spread = np.ptp(points, axis=0) if len(points) > 1 else np.zeros(x.shape[1])
            usable = np.flatnonzero((spread > 0) | (margin > 0)) if len(points) > 1 else []
            if level >= limit or not len(usable):
                depth[at] = level + mean_path(len(points))
                continue
            f = int(rng.choice(usable))
            cut = rng.uniform(points[:, f].min() - margin[f], points[:, f].max() + margin[f])
            feature[at], value[at] = f, cut
            low = node()
            high = node()
            left[at] = low
            side = points[:, f] >= cut
            todo += [(low, points[~side], level + 1), (high, points[side], level + 1)]
    return Forest(np.array(feature), np.array(value), np.array(left), np.array(depth), np.array(roots), max(size, 2))


def calibrate(score: np.ndarray, good: np.ndarray) -> float:
    """Score threshold with the best mean of both hit rates; the middle of the widest gap among equals."""
    if good.all() or not good.any():
        return np.inf
    cuts = np.unique(score)
    middle = np.append((cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1e-9)
    kept = np.searchsorted(np.sort(score[good]), middle, side="right") / good.sum()
    caught = 1 - np.searchsorted(np.sort(score[~good]), middle, side="right") / (~good).sum()
    best = kept + caught
    ties = np.flatnonzero(best >= best.max() - 1e-12)
    gap = np.append(np.diff(cuts), 0)
    return float(middle[ties[np.argmax(gap[ties])]])


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([np.asarray(stats[k], dtype=float) for k in RATIOS], axis=1) if len(stats["n_words"]) else np.zeros((0, len(RATIOS)))


def _measure(batches, text):
    for batch in batches:
        for part in A.chunks(batch, text):
            stats = statistics(part.column(text))
            yield pa.RecordBatch.from_pydict({"quality": part.column("quality")} | {"failed": pa.array(base_failed(stats))} | {k: pa.array(np.asarray(stats[k], dtype=float)) for k in RATIOS})


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, trees: int = 100, sample: int = 256, id_col: str = "doc_id", text_col: str = "text") -> Forest | None:
    """Forest and threshold from at most ``max_rows`` labelled documents (those first by a hash of the id).

    This bound keeps the model's training on the driver at a few megabytes; all else covers every row. Half of the good
    rows grow the trees; the other half and the bad rows, which no tree has seen, set the threshold. Documents failing the base
    rules are left out: they are rejected anyway. None if fewer than two good rows are labelled.
    """
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").cast("int").alias("quality"))
              .orderBy(F.md5(F.concat(F.lit("fit|"), F.col(id_col).cast("string"))), id_col).limit(max_rows))
    met = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen.withColumnRenamed(id_col, "id")), "id")
    rows = met.groupBy("id", "quality").agg(F.min(F.struct(F.md5("text").alias("copy"), "text")).alias("one")).select("one.text", "quality")
    schema = "quality int, failed boolean, " + ", ".join(f"{k} double" for k in RATIOS)
    table = rows.mapInArrow(lambda b: _measure(b, "text"), schema).toPandas().sort_values(["quality", *RATIOS], ignore_index=True)
    table = table[~table["failed"]]
    x, good = table[list(RATIOS)].to_numpy(float), table["quality"].to_numpy() == 1
    if good.sum() < 2:
        return None
    grown = np.zeros(len(good), dtype=bool)
    grown[np.flatnonzero(good)[::2]] = True
    forest = grow_forest(x[grown], trees, sample)
    forest.threshold = calibrate(forest.score(x[~grown]), good[~grown])
    return forest


def judge(docs: DataFrame, forest: Forest | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with counts, base_failed, anomaly (score) and kept."""
    fields = [f for f in docs.schema.fields if keep is None or f.name in keep]
    names = [f.name for f in fields]
    own = docs.select(*[F.col(f"`{c}`") for c in names])
    added = fresh(own, *COUNTS, "base_failed", "anomaly", "kept")
    text_name = fresh(docs, "text_")[0]
    needed = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).cast("string").alias(text_name))

    def run(batches):
        for batch in batches:
            for part in A.chunks(batch, text_name):
                stats = statistics(part.column(text_name))
                failed = base_failed(stats)
                score = forest.score(features(stats)) if forest else np.zeros(len(failed))
                kept = ~failed & (score <= forest.threshold if forest else True)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(names))), *(pa.array(stats[k]) for k in COUNTS), pa.array(failed), pa.array(score), pa.array(kept)], [*names, *added])

    from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in fields), *(StructField(k, LongType()) for k in added[: len(COUNTS)]), StructField(added[-3], BooleanType()), StructField(added[-2], DoubleType()), StructField(added[-1], BooleanType())])
    return needed.mapInArrow(run, schema)


def passing(docs: DataFrame, forest: Forest | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    out = judge(docs, forest, text_col)
    return out.where(F.col(f"`{out.columns[-1]}`")).select(*[F.col(f"`{c}`") for c in docs.columns])
