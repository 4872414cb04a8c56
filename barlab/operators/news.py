"""Feed items to raw events to typed event cards; deduplication, retention, routing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.functions.text import content_hash, fold, host, json_field, strip, strip_tags

#: Keywords per event type in rule order (fixed values). A keyword may hit inside a word.
EVENT_RULES = (
    ("person_death", ("decede", "decedee", "decedés", "mort", "morte", "meurt", "deces", "died", "dies", "dead", "death", "passed away", "rip")),
    ("central_bank_signal", ("ecb", "bce", "fomc", "federal reserve", "fed", "interest rate", "rate hike", "rate cut", "policy rate", "hausse de taux", "baisse de taux",
                             "taux directeur", "banque centrale", "monetary policy")),
    ("sanctions", ("sanction", "embargo", "export ban", "export controls", "blacklist", "asset freeze", "ofac", "swift")),
    ("military_escalation", ("attack", "strike", "airstrike", "missile", "drone", "bomb", "shelling", "invasion", "troops", "ceasefire", "mobilization", "attaque", "frappe",
                             "bombard", "troupes", "guerre", "conflit", "escalade", "tensions", "hostilites", "war")),
    ("shipping_accident", ("ship", "boat", "vessel", "tanker", "cargo", "capsize", "sank", "maritime", "navire", "bateau", "petrolier", "naufrage", "echoue")),
    ("commodity_supply", ("opec", "opec+", "oil output", "production cut", "barrel", "brent", "wti", "petrole", "baril", "production", "quota")),
    ("macro_data", ("cpi", "inflation", "gdp", "unemployment", "pmi", "jobs report", "nfp", "indice des prix", "croissance", "chomage", "pib")),
    ("market_move", ("stocks", "shares", "bond yields", "treasury", "sell-off", "rally", "bourse", "actions", "obligations", "rendements", "chute", "hausse")),
    ("odd_news", ("kangaroo", "zoo", "escaped", "animal", "kangourou", "evade", "s'evade")),
)

#: Scores (fixed values).
SEVERITY = {"military_escalation": 0.90, "sanctions": 0.75, "central_bank_signal": 0.70, "commodity_supply": 0.65, "macro_data": 0.55, "market_move": 0.45,
            "shipping_accident": 0.35, "person_death": 0.20, "odd_news": 0.10, "unknown": 0.25}
EVIDENCE = {"official_doc": 0.85, "rss": 0.65, "website": 0.55, "social": 0.40}
TRUSTED_HOSTS = ("ecb.europa.eu", "www.ecb.europa.eu", "federalreserve.gov", "www.federalreserve.gov", "imf.org", "www.imf.org", "bis.org", "www.bis.org", "opec.org", "www.opec.org")

#: Names recognised in texts (fixed values).
DETECTED = (
    ("Iran", ("iran", "iranian", "teheran", "tehran")), ("Israel", ("israel", "israeli", "tel aviv", "gaza")),
    ("Russia", ("russia", "russian", "moscow", "ukraine", "ukrainian", "kyiv", "kiev")), ("China", ("china", "chinese", "beijing", "taiwan", "taipei")),
    ("United States", ("united states", "u.s.", "usa", "washington")), ("Oil", ("oil", "brent", "wti", "barrel", "petrole", "baril")),
    ("Rates", ("interest rate", "policy rate", "taux", "rate hike", "rate cut", "hausse de taux", "baisse de taux")),
)


def _any(text: Column, words, word_boundary: bool = False) -> Column:
    """Any of the words in a text column; plain substring search unless whole words are asked for."""
    if word_boundary:
        return text.rlike(r"(?<![a-z])(?:" + "|".join(re.escape(w) for w in words) + r")(?![a-z])")
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def make_events(items: DataFrame) -> DataFrame:
    """Items (entity_id, entity_name, source_id, source_type, source_url, title, content, published_at, fetched_at,
    item_url) to raw events with content hash and JSON metadata."""
    c = {n: strip(F.coalesce(F.col(n), F.lit(""))) for n in ("title", "content", "item_url")}
    df = items.withColumns(c)
    where = F.coalesce(F.nullif(F.col("item_url"), F.lit("")), F.col("source_url"))
    meta = F.to_json(F.struct(F.col("entity_name"), host(where).alias("domain")))
    return df.select(
        content_hash(F.col("entity_id"), F.col("source_id"), F.col("source_type"), F.col("item_url"), F.col("title"), F.col("content")).alias("content_hash"),
        "source_id", "entity_id", "source_url", "source_type", "title", "content", "published_at", "fetched_at", where.alias("url"),
        F.lit(None).cast("string").alias("event_type"), meta.alias("metadata"), F.lit(0).alias("is_processed"))


def classify(text: Column, entity_name: Column, url: Column, word_boundary: bool = False) -> Column:
    """Event type of folded text; then of the entity, then of the host. ``text`` is read once per keyword, so it
    should be a stored column, not an expression."""
    out = F.when(F.lower(entity_name).isin("european central bank", "ecb", "banque centrale européenne"), "central_bank_signal")
    out = out.when(F.lower(entity_name).contains("opec"), "commodity_supply")
    out = out.when(host(url).rlike(r"(ecb\.europa\.eu|federalreserve\.gov)$"), "central_bank_signal").otherwise("unknown")
    return reduce(lambda rest, rule: F.when(_any(text, rule[1], word_boundary), rule[0]).otherwise(rest), reversed(EVENT_RULES), out)


def _score(values: dict[str, float], key: Column, default: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def evidence(source_type: Column, url: Column, trust: Column | None = None) -> Column:
    base = _score(EVIDENCE, F.coalesce(F.nullif(source_type, F.lit("")), F.lit("rss")), 0.55)
    base = F.when(host(url).isin(*TRUSTED_HOSTS), F.greatest(base, F.lit(0.80))).otherwise(base)
    if trust is not None:
        base = F.greatest(base, F.least(F.lit(1.0), F.coalesce(trust, F.lit(0.0))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base))


def to_cards(events: DataFrame, word_boundary: bool = False) -> DataFrame:
    """Raw events to event cards; a pure projection, so it runs unchanged on streams."""
    df = events.withColumns({"_title": strip(F.coalesce("title", F.lit(""))), "_body": strip_tags(F.col("content")),
                             "_url": strip(F.coalesce(F.nullif("url", F.lit("")), F.col("source_url"), F.lit(""))),
                             "_name": strip(F.coalesce(json_field(F.col("metadata"), "entity_name"), F.lit("")))})
    df = df.withColumn("_text", fold(F.concat(F.col("_title"), F.lit("\n"), F.col("_body"))))
    primary = F.when((F.coalesce("entity_id", F.lit("")) != "") | (F.col("_name") != ""), F.struct(
        F.nullif(F.col("entity_id"), F.lit("")).alias("entity_id"), F.nullif(F.col("_name"), F.lit("")).alias("name"), F.lit("primary").alias("role")))
    # one entry per entity: a primary without an id is the same entity as a detected one of its name
    own = F.when(F.coalesce("entity_id", F.lit("")) == "", F.lower("_name")).otherwise(F.lit(""))
    found = [F.when(_any(F.col("_text"), words, word_boundary) & (own != n.lower()), F.struct(F.lit(None).cast("string").alias("entity_id"), F.lit(n).alias("name"), F.lit("detected").alias("role"))) for n, words in DETECTED]
    excerpt = F.coalesce(F.nullif(strip(F.col("_body")), F.lit("")), F.col("_title"))
    repeated = (excerpt == "") | F.lower("_title").contains(F.lower(excerpt))
    claim = F.when(repeated, F.col("_title")).otherwise(strip(F.concat(F.col("_title"), F.lit(" — "), excerpt)))
    speaker = F.coalesce(F.nullif("_name", F.lit("")), F.nullif(host(F.col("_url")), F.lit("")), F.lit("source"))
    df = df.withColumn("event_type", classify(F.col("_text"), F.col("_name"), F.col("_url"), word_boundary))
    return df.select(
        F.col("content_hash").alias("raw_event_hash"), F.col("fetched_at").alias("first_seen_at"), F.lower("source_type").alias("source_type"),
        F.filter(F.array("_url"), lambda u: u != "").alias("urls"), F.array_distinct(F.array_compact(F.array(primary, *found))).alias("entities"),
        "event_type", F.array(F.struct(speaker.alias("speaker"), claim.alias("text"), F.col("_url").alias("url"))).alias("claims"),
        F.lit(1.0).alias("novelty_score"), _score(SEVERITY, F.col("event_type"), 0.25).alias("severity_score"),
        evidence(F.lower("source_type"), F.col("_url")).alias("evidence_score"))


# ---------------------------------------------------------------- store operations


def insert_if_new(new: DataFrame, existing: DataFrame, key: str = "content_hash", order: str = "fetched_at") -> DataFrame:
    """Rows to append: first occurrence per key in the batch, not yet stored. A hot key is reduced map-side."""
    others = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(F.col(order), F.xxhash64(*[F.col(c) for c in others]))).alias("_r"))
    return first.select(key, "_r.*").select(*new.columns).join(existing.select(key), key, "left_anti")


def purge(df: DataFrame, now: Column, days: int, ts: str) -> DataFrame:
    """Rows of the last ``days`` days; a plain range on the time column, so old folders and row groups are skipped."""
    return df.filter(F.col(ts) >= now - F.make_dt_interval(days=F.lit(days)))


def recent_for_display(events: DataFrame, now: Column, days: int = 7, limit: int | None = None) -> DataFrame:
    """Newest items with default site, title and type; all of them unless a limit is given."""
    url = F.trim(F.coalesce(F.nullif("url", F.lit("")), F.col("source_url"), F.lit("")))
    site = F.coalesce(F.nullif(json_field(F.col("metadata"), "domain"), F.lit("")), F.nullif(host(url), F.lit("")), F.nullif(host(F.col("source_url")), F.lit("")), F.lit("unknown"))
    text = lambda c, default: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))
    newest = purge(events, now, days, "fetched_at")
    newest = newest.orderBy(F.col("fetched_at").desc(), "content_hash").limit(limit) if limit else newest
    return (newest.select(F.col("fetched_at").alias("read_at"), site.alias("site"), text("title", "(sans titre)").alias("title"), url.alias("url"), text("event_type", "unknown").alias("event_type"), "content_hash"))


def route(items: DataFrame, preferences: DataFrame) -> DataFrame:
    """retained or blocked by the category preference (-1, 0, 1); unknown categories are neutral."""
    prefs = preferences.select("event_type", F.col("pref").alias("_p"))
    pref = F.when(F.col("_p").isin(-1, 0, 1), F.col("_p")).otherwise(0)
    out = items.withColumn("event_type", F.coalesce(F.nullif(F.trim("event_type"), F.lit("")), F.lit("unknown"))).join(prefs, "event_type", "left")
    return out.withColumn("pref", pref).withColumn("tray", F.when(F.col("pref") == -1, "blocked").otherwise("retained")).drop("_p")


def watcher_status(events: DataFrame, now: Column) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_processed") == 0).alias("unprocessed"),
                      F.count_if(F.col("fetched_at") >= now - F.expr("INTERVAL 1 HOUR")).alias("last_hour"))


def recent_urls(items: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Distinct URLs published within ``days``; undated items are dropped, the first position of a URL is kept."""
    stamp = F.try_to_timestamp(F.regexp_replace(F.regexp_replace("published_at", "Z", ""), r"\..*$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    fresh = items.withColumn("_t", stamp).filter((F.col("_t") >= now - F.make_dt_interval(days=F.lit(days))) & (F.coalesce("url", F.lit("")) != ""))
    return fresh.groupBy("url").agg(F.min("pos").alias("pos"))


def ordered_union(parts: list[DataFrame], key: str = "source") -> DataFrame:
    """Union that keeps the first occurrence of each key in (part, pos) order."""
    stacked = reduce(lambda a, b: a.unionByName(b), [p.select(key, F.lit(n).alias("part"), "pos") for n, p in enumerate(parts)])
    return stacked.groupBy(key).agg(F.min(F.struct("part", "pos")).alias("_o")).select(key, "_o.*")


def translated(items: DataFrame, cache: DataFrame, lang: str, title: str = "title") -> DataFrame:
    """Title from the translation cache (key ``lang::sha1``), else the title itself."""
    key = F.concat(F.lit(f"{lang}::"), F.sha1(F.trim(title)))
    return (items.withColumn("_k", key).join(cache.select(F.col("cache_key").alias("_k"), "translation"), "_k", "left")
            .withColumn("shown_title", F.coalesce(F.nullif("translation", F.lit("")), F.col(title))).drop("_k", "translation"))


def article_fields(articles: DataFrame, limit: int | None = None) -> DataFrame:
    """Display fields of articles given as JSON text; one row per URL, the first position wins."""
    schema = "title string, description string, content string, url string, publishedAt string, source struct<name:string>"
    a = articles.select("pos", F.from_json("article", schema).alias("a")).filter("a.url is not null and a.url <> ''")
    first = a.groupBy(F.col("a.url").alias("url")).agg(F.min_by("a", "pos").alias("a"), F.min("pos").alias("pos"))
    out = first.select("pos", "url", F.coalesce("a.title", F.lit("Sans titre")).alias("title"), F.coalesce("a.source.name", F.lit("Inconnu")).alias("source"),
                       F.substring("a.publishedAt", 1, 10).alias("published"), F.coalesce("a.description", F.lit("Pas de description")).alias("description"),
                       F.coalesce("a.content", F.lit("")).alias("preview"))
    return out.orderBy("pos").limit(limit) if limit else out


def headline_sentiment(titles: DataFrame, lexicon: dict[str, float], key: str = "currency", text: str = "title") -> DataFrame:
    """Mean valence per key: a title scores the mean of its known words (0 without any)."""
    table = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in kv])
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.map_contains_key(table, w))
    total = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.element_at(table, w))
    scored = titles.filter(F.trim(text) != "").withColumn("_s", F.when(F.size(words) > 0, total / F.size(words)).otherwise(0.0))
    return scored.groupBy(key).agg(F.avg("_s").alias("sentiment"), F.count(F.lit(1)).alias("titles"))
