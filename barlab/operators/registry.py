"""Entity registry: filters, source joins, proposals, score updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.functions.scalars import clamp01

#: Marks of trusted sources (fixed values).
TRUSTED_MARKS = (".gov", ".mil", "reuters.com", "bloomberg.com", "ft.com")


def list_entities(entities: DataFrame, min_importance: float = 0.0, entity_type: str | None = None, topics: list[str] | None = None) -> DataFrame:
    df = entities.filter(F.col("importance_score") >= min_importance)
    if entity_type:
        df = df.filter(F.col("entity_type") == entity_type)
    if topics:
        df = df.filter(F.arrays_overlap("topics", F.array(*[F.lit(t) for t in topics])))
    return df.orderBy(F.col("importance_score").desc(), "entity_id")


def critical_entities(entities: DataFrame, threshold: float = 0.7) -> DataFrame:
    return entities.filter(F.col("importance_score") >= threshold)


def search_text(df: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Rows with the words in any of the columns, ignoring case."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(words.lower()))
    return df.filter(cond)


def find_by_alias(entities: DataFrame, words: str) -> DataFrame:
    return search_text(entities.withColumn("_al", F.array_join("aliases", "\n")), words, ["name", "_al"]).drop("_al")


def active_sources(sources: DataFrame, entities: DataFrame) -> DataFrame:
    """Active sources with their entity, most important first. The join strategy is left to the optimiser."""
    return (sources.filter("is_active = 1").join(entities.select("entity_id", F.col("name").alias("entity_name"), "importance_score"), "entity_id")
            .orderBy(F.col("importance_score").desc(), F.col("trust_score").desc(), "source_id"))


def insertable_sources(new: DataFrame, entities: DataFrame, existing: DataFrame) -> DataFrame:
    """New sources of known entities that are not stored yet."""
    known = new.join(entities.select("entity_id"), "entity_id", "left_semi")
    return known.join(existing.select("entity_id", "source_type", "url"), ["entity_id", "source_type", "url"], "left_anti")


def review_proposals(proposals: DataFrame, entities: DataFrame) -> DataFrame:
    """Status of proposed entities from (name, entity_type, url) rows: rejected when known, approved with two
    sources of which one is trusted, else pending. Counting, not collecting, keeps a hot name cheap."""
    trusted = F.col("url").rlike("(?i)" + "|".join(m.replace(".", r"\.") for m in TRUSTED_MARKS))
    agg = proposals.groupBy("name", "entity_type").agg(F.count("url").alias("sources"), F.count_if(trusted).alias("trusted"))
    agg = agg.withColumn("entity_id", F.replace(F.lower("name"), F.lit(" "), F.lit("_"))).join(entities.select("entity_id", F.lit(1).alias("_known")), "entity_id", "left")
    status = F.when(F.col("_known") == 1, "rejected").when((F.col("sources") >= 2) & (F.col("trusted") > 0), "auto_approved").otherwise("pending_validation")
    return agg.withColumns({"status": status, "importance_score": F.when(status == "auto_approved", 0.6)}).drop("_known")


def proposed_source_trust(url: Column) -> Column:
    return F.when(url.rlike("(?i)" + "|".join(m.replace(".", r"\.") for m in TRUSTED_MARKS)), 0.7).otherwise(0.5)


def update_scores(table: DataFrame, updates: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """Latest update per key wins and is clamped to [0, 1]; other rows keep their score."""
    last = updates.groupBy(key).agg(F.max_by(column, order).alias("_new"))
    return table.join(last, key, "left").withColumn(column, F.coalesce(clamp01(F.col("_new")), F.col(column))).drop("_new")


def first_distinct(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """First row per key in ``order``."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r")).select(*key, "_r.*")
