"""Benchmark decontamination: SimHash of item-sized windows, Hamming multi-index, exact weighted-shingle check.

Words are runs of letters and digits in lower case. A window of a document has as many words as a benchmark item; window
and item are compared by their multisets of five-word shingles (an item of fewer words is one shingle of all its words).
Windows are laid where a shingle shared with an item puts that item: a window as similar as asked for shares shingles
with it, and with words put in or left out an aligned window is as good as any between. So every document is searched, but
only where something can be found.

Each window and item gets a 64-bit SimHash (every shingle votes with its count). Cut into radius + 1 blocks, two
fingerprints within the radius agree in at least one block, so a join on (item size, block, value) misses none of them.
The survivors are verified by the exact weighted Jaccard similarity: the sum of smaller counts over the sum of larger
ones. At similarity 0.8 two fingerprints differ in 10 bits on average; radius 20 is 3.6 standard deviations above.

Columns and SQL functions only. The shingles of the benchmark are broadcast if there are at most ``broadcast_rows`` of
them, otherwise both sides are shuffled by shingle. Defined cases: null and empty texts and items without words match
nothing; repeated rows and null ids are kept apart by the text's hash and give the same result; an empty documents or
benchmark table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.frames import fresh, written


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def run_hash(hashes: Column, i: Column, m: int) -> Column:
    """Hash of the ``m`` entries from position ``i`` (1-based); starts from ``m``, so runs of other lengths differ."""
    return F.xxhash64(F.lit(m), *[F.element_at(hashes, i + j) for j in range(m)])


def shingles(hashes: Column, k: int) -> Column:
    """Hashes of every ``k`` consecutive entries; fewer than ``k`` entries give one hash of all."""
    n = F.size(hashes)
    many = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: run_hash(hashes, i, k))
    short = F.array().cast("array<bigint>")
    for m in range(1, k):
        short = F.when(n == m, F.array(run_hash(hashes, F.lit(1), m))).otherwise(short)
    return F.when(n >= k, many).otherwise(short)


def simhash(values: Column) -> Column:
    """64 bits: bit b is set if more than half of the values have it set."""
    votes = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(values, F.lit(0), lambda acc, v: acc + F.call_function("getbit", v, b).cast("int")))
    half = F.size(values)
    return F.aggregate(F.transform(votes, lambda c: (2 * c > half).cast("bigint")), F.lit(0).cast("bigint"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit))


def blocks(print_: Column, radius: int) -> Column:
    """(block number, its bits) for radius + 1 blocks of 64 bits, as evenly long as can be."""
    n = radius + 1
    edges = [round(i * 64 / n) for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(print_, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("bigint")).alias("bits")) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two multisets given as arrays: sum of smaller counts over sum of larger counts."""
    count = lambda arr, v: F.size(F.filter(arr, lambda x: x == v))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v)))
    return common / (F.size(a) + F.size(b) - common)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, radius: int = 20, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, text_hash, item_id, start, n_words, hamming, similarity): the most similar window of each document and item."""
    items = benchmark.select(F.col("item_id"), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") > 0)
    items = written(items.select("item_id", F.size("w").alias("n"), F.least(F.size("w"), F.lit(k)).alias("k"), shingles(F.col("w"), k).alias("item_shingles")))
    spots = written(items.select("item_id", "n", "k", F.posexplode("item_shingles").alias("j", "shingle")))
    lengths = [r["k"] for r in spots.select("k").distinct().collect()]  # at most k values
    known = spots.select("shingle", "n", "j").distinct()
    small = spots.count() <= broadcast_rows
    side = F.broadcast if small else (lambda df: df)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hashed = rows.select("id", F.xxhash64("text").alias("text_hash"), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    here = F.flatten(F.array(*[F.when(F.size("w") >= m, _exact(F.col("w"), m)).otherwise(F.array().cast("array<struct<i:int,shingle:bigint>>")) for m in sorted(lengths)])) if lengths else F.array().cast("array<struct<i:int,shingle:bigint>>")
    hits = hashed.select("id", "text_hash", F.size("w").alias("len"), F.explode(here).alias("h")).select("id", "text_hash", "len", F.col("h.i").alias("i"), F.col("h.shingle").alias("shingle"))
    start = F.greatest(F.lit(0), F.least(F.col("i") - F.col("j"), F.col("len") - F.col("n")))
    laid = hits.join(side(known), "shingle").select("id", "text_hash", "n", start.alias("start")).distinct()
    per_doc = laid.groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("windows"))

    # the windows' words: only documents with windows are cut into words again
    p = per_doc.select(F.col("id").alias("pid"), F.col("text_hash").alias("ph"), "windows")
    keyed = rows.withColumn("text_hash", F.xxhash64("text"))
    found = p.join(keyed, F.col("id").eqNullSafe(F.col("pid")) & (F.col("text_hash") == F.col("ph")))
    found = found.select("id", "text_hash", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w"), "windows")
    cut = found.select("id", "text_hash", "w", F.explode("windows").alias("win")).select("id", "text_hash", F.col("win.start").alias("start"), F.col("win.n").alias("n"), shingles(F.slice("w", F.col("win.start") + 1, F.col("win.n")), k).alias("s"))
    prints = written(cut.withColumn("print", simhash(F.col("s"))))

    probe = prints.select("id", "text_hash", "start", "n", "print", "s", F.explode(blocks(F.col("print"), radius)).alias("b")).select("*", "b.block", "b.bits").drop("b")
    index = items.withColumn("item_print", simhash(F.col("item_shingles"))).select("item_id", "n", "item_print", "item_shingles", F.explode(blocks(F.col("item_print"), radius)).alias("b")).select("*", "b.block", "b.bits").drop("b")
    near = probe.join(side(written(index)), ["n", "block", "bits"]).withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
    # a pair that agrees in several blocks counts where it agrees first
    both = F.col("print").bitwiseXOR(F.col("item_print"))
    first = F.array_min(F.transform(F.filter(blocks(both, radius), lambda b: b["bits"] == 0), lambda b: b["block"]))
    near = near.where((F.col("hamming") <= radius) & (F.col("block") == first))
    checked = near.withColumn("similarity", weighted_jaccard(F.col("s"), F.col("item_shingles"))).where(F.col("similarity") >= least)
    best = checked.groupBy("id", "text_hash", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), "n", "hamming")).alias("m"))
    return best.select(F.col("id").alias(id_col), "text_hash", "item_id", (-F.col("m.col2")).alias("start"), F.col("m.n").alias("n_words"), F.col("m.hamming").alias("hamming"), F.col("m.similarity").alias("similarity"))


def _exact(hashes: Column, m: int) -> Column:
    """(position, shingle) of every run of ``m`` entries, hashed as an item's shingle of ``m`` words is."""
    n = F.size(hashes)
    def one(i):
        return F.struct((i - 1).alias("i"), run_hash(hashes, i, m).alias("shingle"))
    return F.transform(F.sequence(F.lit(1), n - (m - 1)), one)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a window like any item."""
    of, text_hash = fresh(docs, "of", "text_hash")
    bad = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col(id_col).alias(of), F.col("text_hash").alias(text_hash)).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == F.col(text_hash)), "left_anti")
