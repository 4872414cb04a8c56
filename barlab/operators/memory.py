"""Experience store and conversation helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.core.blocks import running
from barlab.functions.scalars import MESSAGE_FORMATS, parse_timestamp
from barlab.functions.text import guess_language, tokens, trim_to_tokens


def experience_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows ready to append; results are kept whole unless a field length is given."""
    return df.withColumn("result", F.substring("result", 1, limit)) if limit else df


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def upsert(existing: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last write per key; of equal times the larger row, so reruns agree. One aggregation with a map-side combine."""
    both = existing.unionByName(new)
    others = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(order, *others)).alias("_r")).select(*key, "_r.*")


def store_stats(experiences: DataFrame, discoveries: DataFrame, strategies: DataFrame) -> DataFrame:
    """Counts of the three tables and the success rate; three one-row aggregates side by side."""
    e = experiences.agg(F.count(F.lit(1)).alias("experiences"), F.count_if(F.col("success") == 1).alias("_s")).withColumn(
        "success_rate", F.bround(F.col("_s") / F.greatest(F.col("experiences"), F.lit(1)) * 100, 1)).drop("_s").withColumn("_k", F.lit(0))
    d = discoveries.agg(F.count(F.lit(1)).alias("discoveries")).withColumn("_k", F.lit(0))
    s = strategies.agg(F.count(F.lit(1)).alias("strategies")).withColumn("_k", F.lit(0))
    return e.join(d, "_k").join(s, "_k").drop("_k")


def context_summary(experiences: DataFrame, discoveries: DataFrame, strategies: DataFrame, n: int = 5, width: int | None = None) -> DataFrame:
    """Summary lines (section, rank, line) of recent experiences, failures, discoveries and best strategies; texts are whole unless a display ``width`` is given."""
    def lines(section: int, df: DataFrame, k: int, order: list[Column], text: Column) -> DataFrame:
        picked = df.orderBy(*order).limit(k)
        return picked.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("rank"), text.alias("line"))

    short = lambda c: F.substring(c, 1, width) if width else F.col(c)
    newest = [F.col("timestamp").desc(), F.col("id").desc()]
    done = F.when(F.col("success") == 1, "✅").otherwise("❌")
    parts = [
        lines(1, experiences, n, newest, F.format_string("%s [%s] %s → %s", done, F.col("action"), short("objective"), short("result"))),
        lines(2, experiences.filter("success = 0"), 3, newest, F.format_string("❌ %s: %s", F.col("action"), short("result"))),
        lines(3, discoveries, n, newest, F.format_string("[%s] %s: %s", F.col("category"), F.col("key"), short("value"))),
        lines(4, strategies, 3, [F.col("score").desc(), F.col("id")], F.format_string("%s (%s) score=%s", F.col("name"), F.col("symbol"), F.col("score").cast("string"))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# ---------------------------------------------------------------- conversations


def chronological(messages: DataFrame, ts: str = "timestamp", pos: str = "pos") -> DataFrame:
    """Old to new; messages without a readable time come last in their given order."""
    return messages.withColumn("parsed_ts", parse_timestamp(F.replace(F.trim(ts), F.lit("Z"), F.lit("")), MESSAGE_FORMATS + ("yyyy-MM-dd",))).orderBy(F.col("parsed_ts").asc_nulls_last(), pos)


def fit_history(messages: DataFrame, budget: int, per_message: int = 8, least: int = 32) -> DataFrame:
    """Newest user/assistant messages of each conversation that fit the token budget, oldest first; the message
    on the boundary is shortened when more than ``least`` tokens are left. The running cost is summed in two levels,
    so a very long conversation is not one task."""
    m = messages.filter(F.col("role").isin("user", "assistant") & F.col("text").isNotNull())
    m = m.withColumns({"_cost": tokens(F.col("text")) + per_message, "_neg": -F.col("turn"), "_nb": F.floor(-F.col("turn") / 4096)})
    m = running(m, ["conv_id"], "_nb", ["_neg"], {"_cum": ("sum", F.col("_cost"))})
    left = F.lit(max(1, budget)) - (F.col("_cum") - F.col("_cost"))
    whole, edge = F.col("_cum") <= budget, (F.col("_cum") > budget) & (F.col("_cum") - F.col("_cost") <= budget)
    cut = F.when((left > least) & (F.trim(trim_to_tokens(F.col("text"), left - per_message)) != ""), trim_to_tokens(F.col("text"), left - per_message))
    newest = F.col("_cum") == F.col("_cost")  # kept whole when nothing else fits
    content = F.when(whole, F.col("text")).when(edge, F.coalesce(cut, F.when(newest, F.col("text"))))
    return m.withColumn("content", content).filter(F.col("content").isNotNull()).select("conv_id", "turn", "role", "content")


def conversation_language(messages: DataFrame, last: int = 6, user_turns: int = 3) -> DataFrame:
    """Language of the last user turns among the last messages. Both limits are cut before the shuffle."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    tail = messages.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= last).filter("role = 'user'")
    tail = tail.withColumn("_un", F.row_number().over(newest)).filter(F.col("_un") <= user_turns)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), " \n")
    said = tail.groupBy("conv_id").agg(text.alias("_t"))
    all_ids = messages.select("conv_id").distinct()
    return all_ids.join(said, "conv_id", "left").select("conv_id", guess_language(F.col("_t")).alias("lang"))


def training_pairs(feedback: DataFrame) -> DataFrame:
    """Prompt/completion rows: a correction when there is one, else an up-rated answer."""
    fixed = F.nullif(F.trim("corrected_answer"), F.lit(""))
    completion = F.coalesce(fixed, F.when(F.col("rating") == "up", F.col("ia_answer")))
    return feedback.withColumn("completion", completion).filter(F.col("completion").isNotNull()).select(F.col("user_question").alias("prompt"), "completion")
