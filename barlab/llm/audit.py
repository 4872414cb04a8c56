"""Which filter of a chain removes what, for every order of the chain: Lehmer-rank difference arrays.

A document is reduced to the set of filters that it fails (its mask), so a table is one count per (part, mask). In
lexicographic order the permutations with a common beginning are one interval of ranks (the digits of a rank in the
factorial number system are its Lehmer code). A document of mask M is removed at step s by filter f in exactly the orders
that begin with s - 1 filters outside M and then f: one interval for each such beginning. Every (part, mask) count is
added where such an interval begins and taken off where it ends; a running sum over the ranks then gives what each step
removes in each of the k! orders, and all other totals follow from it.

Columns and SQL functions only. After the per-document flags nothing is larger than parts x k! x k rows. Copies are told
by the md5 of the text: rows are first counted by (text, part, labels, id), so a text that a third of all rows share is a
few rows before the smallest id of its copies is joined to it.

Defined cases: a null text is empty; a null source is the part of the empty string; a null id is neither smaller nor
larger than any other, so such rows neither fail ``E`` nor make others fail; repeated rows (one id, one text) count each
and do not fail for each other; a document is good or toxic if any of its label rows says so; label rows of unknown or
null ids change nothing; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.frames import written

WORD = "[^\\x20\\x09-\\x0D]+"
LETTERS = "ABCDE"


def text_flags(text: Column) -> dict[str, Column]:
    """Failure conditions that the text alone decides."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)) * 100 < n * 65,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents per part, set of failed filters (bit 0: the first) and labels."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    flags = text_flags(F.col("text"))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = sum((F.when(flags[f], 1 << i).otherwise(0) for i, f in enumerate("ABCD")), F.lit(0))
    slim = slim.select("id", "part", F.unhex(F.md5("text")).alias("copy"), bits.alias("mask"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("of")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    no = F.lit(False)
    rows = slim.join(told, F.col("id") == F.col("of"), "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    group = ["copy", "part", "mask", "good", "toxic"]
    ids = written(rows.groupBy(*group, "id").agg(F.count("*").alias("n")))
    # of each text in each part: all rows, rows of known id, and the rows that hold the smallest id
    cells = written(ids.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("known"), F.min("id").alias("least"), F.min_by("n", "id").alias("heads")))
    first = cells.groupBy("copy").agg(F.min("least").alias("first"))
    met = cells.join(first.withColumnRenamed("copy", "text_copy"), F.col("copy") == F.col("text_copy"))
    copies = F.col("known") - F.when(F.col("least") == F.col("first"), F.col("heads")).otherwise(0)
    both = met.select("part", "good", "toxic", F.explode(F.array(
        F.struct((F.col("mask") + 16).alias("mask"), copies.alias("n")), F.struct(F.col("mask").alias("mask"), (F.col("n") - copies).alias("n")))).alias("x"))
    return both.select("part", "x.mask", "good", "toxic", "x.n").where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def removal_intervals(k: int) -> list[tuple[int, int, int, int, int]]:
    """(mask, step, filter, first rank, rank behind the last) of all intervals of orders in which ``filter`` removes ``mask`` at ``step``."""
    out = []
    for mask in range(1, 1 << k):
        inside = [f for f in range(k) if mask >> f & 1]
        outside = [f for f in range(k) if not mask >> f & 1]
        for before in range(len(outside) + 1):
            for head in permutations(outside, before):
                for f in inside:
                    begin = lehmer_rank([*head, f], k)
                    out.append((mask, before + 1, f, begin, begin + factorial(k - before - 1)))
    return out


def lehmer_rank(head: list[int], k: int) -> int:
    """Rank of the first permutation of 0 to k - 1 that begins with ``head``."""
    rest, rank = list(range(k)), 0
    for i, f in enumerate(head):
        at = rest.index(f)
        rank += at * factorial(k - 1 - i)
        del rest[at]
    return rank


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from ``failures``' rows."""
    spark, k = cells.sparkSession, len(letters)
    cells = written(cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")))
    sums = ["n", "good", "toxic"]
    # fixed tables of the number of filters alone: a few hundred intervals, k! orders
    spans = spark.createDataFrame(removal_intervals(k), "of int, step int, filter int, begin int, end int")
    orders = spark.createDataFrame([(r, "".join(p), i + 1, letters.index(p[i])) for r, p in enumerate(permutations(letters)) for i in range(k)], "rank int, filter_order string, step int, filter int")
    ends = F.explode(F.array(F.struct(F.col("begin").alias("rank"), *[F.col(c).alias(c) for c in sums]), F.struct(F.col("end").alias("rank"), *[(-F.col(c)).alias(c) for c in sums])))
    steps = cells.join(F.broadcast(spans), F.col("mask") == F.col("of")).select("part", "step", ends.alias("x")).select("part", "step", "x.*").where(F.col("rank") < factorial(k))
    every = cells.select("part").distinct().withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(k) - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    zero = every.select("part", "step", "rank", *[F.lit(0).cast("bigint").alias(c) for c in sums])
    change = steps.unionByName(zero).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in sums])
    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # k! rows
    removed = change.select("part", "step", "rank", *[F.sum(c).over(upto).alias(f"{c}_lost") for c in sums])

    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col("n")).otherwise(0)) for i in range(k)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(k)]
    totals = cells.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    rows = removed.join(F.broadcast(orders), ["step", "rank"]).join(totals, "part")
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # k rows
    of_filter = Window.partitionBy("part", "filter")  # k! rows
    at = F.col("filter") + 1
    return rows.select("part", "filter_order", "step", (F.col("total") - F.sum("n_lost").over(so_far)).alias("kept"), F.col("n_lost").alias("removed"),
                       (F.element_at("fails", at) - F.col("n_lost")).alias("redundant"), F.element_at("alone", at).alias("unique_fails"),
                       "good_lost", "toxic_lost", F.sum("n_lost").over(of_filter).alias("shapley"))
