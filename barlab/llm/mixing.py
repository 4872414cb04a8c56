"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks.

Targets: source weights share the total size; no target exceeds ``most`` times its source (the excess goes to the others
by weight, until none is above). A source is cut into blocks by a hash of the document; a pass over a source takes all
its blocks in a fresh order, the last pass takes blocks, then documents of one block, until the target is reached.

Every block instance taken goes to one output shard. How many of each source's instances a shard gets is decided by a
tree over the shards: a node splits its quotas between its two halves by drawing without replacement (each instance in
turn goes left with the chance that the room left there gives it), so each shard gets its exact number of instances and
each source's spread follows the multivariate hypergeometric law. The shards then take disjoint runs of the source's
permuted instances, and order their documents by a hash.

Columns and SQL functions only. Tables that pass through windows without many keys have one row per source, per tree
node or per (source, block), at most ``max_blocks`` of a source. Defined cases: null text has size 0; the null source is a source (last);
a source of size 0 has target 0; documents of size 0 take 0; repeated rows are separate rows; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.frames import fresh, written

WORD = "[^\\x20\\x09-\\x0D]+"


def hashed(*parts: Column | str) -> Column:
    """Hex md5 of the parts joined by ':'."""
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def unit(hexed: Column) -> Column:
    return (F.conv(F.substring(hexed, 1, 12), 16, 10).cast("bigint") + 0.5) / float(2**48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, docs, target) from (source, source_size, docs).

    With the sources in ascending order of cap / weight, the capped ones are a prefix; the share per unit of weight of the
    rest follows from the caps before and the weights after each source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    t = t.withColumn("share", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source whose cap is not reached at its share: that share holds for it and all after it
    t = t.withColumn("position", F.row_number().over(by))
    level = F.min(F.when(F.col("ratio") >= F.col("share"), F.struct("position", "share"))).over(everything)["share"]
    return t.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))).select("source", "source_size", "docs", "target")


def split_tree(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """(shard, source, n): block instances of each source per shard, from (source, quota).

    A node is one row with the quotas of all sources; a split walks over its instances in one aggregate.
    """
    node = quotas.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("name"), F.col("source").alias("source"), F.col("quota").alias("n")))).alias("parts")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "parts")
    for depth in range(max(shards - 1, 0).bit_length()):
        total = F.aggregate("parts", F.lit(0).cast("bigint"), lambda acc, p: acc + p["n"])
        mid = F.floor((F.col("lo") + F.col("hi") + 1) / 2).cast("int")
        wide = node.withColumn("mid", mid).withColumn("total", total)
        # instances are dealt as evenly as whole numbers allow: the left half gets its shards' part of the total
        room = F.floor(F.col("total") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("bigint")
        wide = wide.withColumn("room", room)

        def draw(acc, p):
            def one(a, i):
                u = unit(hashed(F.lit(f"{seed}:{depth}"), F.col("lo").cast("string"), p["name"], i.cast("string")))
                left = u * a["rest"] < a["room"]
                return F.struct((a["rest"] - 1).alias("rest"), (a["room"] - left.cast("bigint")).alias("room"), (a["got"] + left.cast("bigint")).alias("got"))
            inner = F.aggregate(F.when(p["n"] > 0, F.sequence(F.lit(1).cast("bigint"), p["n"])).otherwise(F.array().cast("array<bigint>")),
                                F.struct(acc["rest"].alias("rest"), acc["room"].alias("room"), F.lit(0).cast("bigint").alias("got")), one)
            return F.struct(inner["rest"].alias("rest"), inner["room"].alias("room"), F.array_append(acc["got"], inner["got"]).alias("got"))

        got = F.aggregate("parts", F.struct(F.col("total").alias("rest"), F.col("room").alias("room"), F.array().cast("array<bigint>").alias("got")), draw)["got"]
        wide = wide.withColumn("got", got)
        side = lambda n: F.zip_with("parts", "got", lambda p, g: F.struct(p["name"].alias("name"), p["source"].alias("source"), n(p, g).alias("n")))
        halves = wide.select(F.explode(F.array(
            F.struct(F.col("lo").alias("lo"), F.when(F.col("hi") - F.col("lo") > 1, F.col("mid")).otherwise(F.col("hi")).alias("hi"), F.when(F.col("hi") - F.col("lo") > 1, side(lambda p, g: g)).otherwise(F.col("parts")).alias("parts")),
            F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), side(lambda p, g: p["n"] - g).alias("parts")))).alias("h")).select("h.*")
        node = halves.where("hi > lo")
    return node.select(F.col("lo").alias("shard"), F.explode("parts").alias("p")).select("shard", F.col("p.source").alias("source"), F.col("p.n").alias("n"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, shards: int = 16, block_docs: int = 200, max_blocks: int = 4096, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", known_by: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken, placements): ``placements`` lists (shard, pass, order) of each copy.

    ``known_by`` adds source and text_hash, by which (with the id) rows of ``docs`` are found again."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th")))
    rows = rows.withColumn("h", hashed(seed, F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("th").cast("string")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = written(source_targets(sizes, weights, most).withColumn("n_blocks", F.least(F.lit(max_blocks), F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs)).cast("int"))))
    t = targets.withColumnRenamed("source", "of")
    cut = rows.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("block", F.floor(unit(F.col("h")) * F.col("n_blocks")).cast("int"))

    # words before each block in its source's order; the last pass takes whole blocks below the remaining words
    blocks = cut.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    order = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    goal = F.round("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("int")
    blocks = (blocks.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0))).withColumn("passes", passes).withColumn("left", goal - F.col("passes") * F.col("source_size"))
              .withColumn("state", F.when(F.col("left") <= 0, 0).when(F.col("before") + F.col("words") <= F.col("left"), 2).when(F.col("before") < F.col("left"), 1).otherwise(0)))
    blocks = written(blocks.select("source", "block", "before", "left", "passes", "state"))

    # instances of a source: all passes' blocks one after the other; the tree says how many each shard gets
    count = blocks.groupBy("source").agg(F.sum(F.col("passes") + (F.col("state") > 0).cast("int")).cast("bigint").alias("quota"))
    dealt = written(split_tree(count, shards, seed))
    ends = Window.partitionBy("source").orderBy("shard")
    dealt = dealt.withColumn("to", F.sum("n").over(ends)).withColumn("from", F.col("to") - F.col("n")).where("n > 0")
    instance = blocks.select("source", "block", F.explode(F.expr("filter(sequence(0, passes), p -> p < passes or state > 0)")).alias("pass"))
    permuted = instance.withColumn("at", F.row_number().over(Window.partitionBy("source").orderBy("pass", hashed(seed, F.col("pass").cast("string"), F.col("block").cast("string")), "block")) - 1)
    d = dealt.select(F.col("source").alias("of"), "from", "to", "shard")
    homes = permuted.join(d, F.col("source").eqNullSafe(F.col("of")) & (F.col("at") >= F.col("from")) & (F.col("at") < F.col("to")))
    homes = homes.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("homes"))  # at most ``most`` + 1 each
    b = blocks.join(homes.select(F.col("source").alias("of"), F.col("block").alias("blk"), "homes"), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("blk")), "left").drop("of", "blk")
    b = written(b)

    bb = b.select(F.col("source").alias("of"), F.col("block").alias("blk"), "before", "left", "passes", "state", "homes")
    placed = cut.join(bb, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("blk"))).drop("of", "blk")
    # the one block per source that is taken in part is cut once more: parts of some ``block_docs`` documents, whole ones first
    partly = placed.where("state = 1").withColumn("room", F.col("left") - F.col("before"))
    many = partly.groupBy("source", "block").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block_docs)).cast("int").alias("parts")).select(F.col("source").alias("of"), F.col("block").alias("blk"), "parts")
    partly = partly.join(many, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("blk"))).drop("of", "blk").withColumn("part", F.floor(unit(hashed("part", F.col("h"))) * F.col("parts")).cast("int"))
    partly = written(partly)
    parts = partly.groupBy("source", "block", "part").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
    upto = Window.partitionBy("source", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("gone", F.coalesce(F.sum("words").over(upto), F.lit(0))).select(F.col("source").alias("of"), F.col("block").alias("blk"), F.col("part").alias("nr"), (F.col("room") - F.col("gone")).alias("open"), (F.col("gone") + F.col("words") <= F.col("room")).alias("whole"))
    partly = partly.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("blk")) & (F.col("part") == F.col("nr"))).drop("of", "blk", "nr")
    taken_whole = partly.where(F.col("whole") | (F.col("open") <= 0)).withColumn("extra", F.col("whole").cast("int"))
    # in the part that is taken in part: the largest documents first, each if it still fits
    edge = written(partly.where(~F.col("whole") & (F.col("open") > 0)).withColumn("at", F.row_number().over(Window.partitionBy("source", "block").orderBy(F.desc("size"), "h", "id"))))
    lists = edge.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("at", "size"))).alias("items"), F.first("open").alias("room"))
    fits = F.aggregate("items", F.struct(F.col("room").alias("room"), F.array().cast("array<int>").alias("got")), lambda acc, p: F.struct(
        (acc["room"] - F.when(p["size"] <= acc["room"], p["size"]).otherwise(0)).alias("room"),
        F.when(p["size"] <= acc["room"], F.array_append(acc["got"], p["at"])).otherwise(acc["got"]).alias("got")))["got"]
    chosen = lists.select(F.col("source").alias("of"), F.col("block").alias("blk"), F.explode(fits).alias("nr"))
    edge = edge.join(chosen, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("blk")) & (F.col("at") == F.col("nr")), "left").withColumn("extra", F.col("nr").isNotNull().cast("int")).drop("of", "blk", "nr", "at")
    rest = placed.where("state <> 1").withColumn("extra", (F.col("state") / 2).cast("int")).unionByName(taken_whole.select(*placed.columns, "extra")).unionByName(edge.select(*placed.columns, "extra"))
    who = [F.col("source").alias("source"), F.col("th").alias("text_hash")] if known_by else []
    times = F.col("passes") + F.col("extra")
    spots = F.transform(F.filter("homes", lambda p: (p["pass"] < F.col("passes")) | (F.col("extra") > 0)), lambda p: F.struct(p["shard"].alias("shard"), p["pass"].alias("pass"), hashed(p["shard"].cast("string"), p["pass"].cast("string"), F.col("h")).alias("order")))
    return rest.select(F.col("id").alias(id_col), *who, "size", "source_size", "target", (F.col("size") * times).cast("bigint").alias("taken"), F.coalesce(spots, F.array().cast("array<struct<shard:int,pass:int,order:string>>")).alias("placements"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them.

    Rows are found again by id, source and text. Rows that agree in all three are numbered by their other columns, and the
    first of them are those taken more often, so reruns agree whatever the order of the rows."""
    parts = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, known_by=True, **options)
    word, text, at, pid, psource, ptext, pat, times, copy = fresh(docs, "source_key", "text_key", "at", "p_id", "p_source", "p_text", "p_at", "times", "copy")
    taken = parts.select(F.col(id_col).alias(pid), F.col("source").alias(psource), F.col("text_hash").alias(ptext), F.size("placements").alias(times))
    taken = taken.withColumn(pat, F.row_number().over(Window.partitionBy(pid, psource, ptext).orderBy(F.desc(times)))).where(F.col(times) > 0)
    rows = docs.withColumns({word: F.col(source_col).cast("string"), text: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    rows = rows.withColumn(at, F.row_number().over(Window.partitionBy(id_col, word, text).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))))
    met = rows.join(taken, F.col(id_col).eqNullSafe(F.col(pid)) & F.col(word).eqNullSafe(F.col(psource)) & (F.col(text) == F.col(ptext)) & (F.col(at) == F.col(pat)))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)
