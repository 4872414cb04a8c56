"""Schemas of the stored tables and the registry's seed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, tick_volume bigint"
RAW_EVENTS = ("content_hash string, source_id bigint, entity_id string, source_url string, source_type string, title string, content string, "
              "published_at string, fetched_at timestamp, url string, event_type string, metadata string, is_processed int")
EVENT_CARDS = ("raw_event_hash string, first_seen_at timestamp, source_type string, urls array<string>, entities array<struct<entity_id:string,name:string,role:string>>, "
               "event_type string, claims array<struct<speaker:string,text:string,url:string>>, novelty_score double, severity_score double, evidence_score double")
ENTITIES = "entity_id string, name string, entity_type string, importance_score double, aliases array<string>, topics array<string>"
SOURCES = "entity_id string, source_type string, url string, trust_score double, is_active int"
EXPERIENCES = "id bigint, timestamp timestamp, objective string, action string, params string, result string, success int, score double, tags string"
DISCOVERIES = "category string, key string, value string, confidence double, timestamp timestamp"
STRATEGIES = "id bigint, timestamp timestamp, name string, symbol string, config string, profit double, drawdown double, sharpe double, winrate double, trades int, score double, status string"
FEEDBACK = "timestamp timestamp, rating string, user_question string, ia_answer string, corrected_answer string"

#: Default entities and sources of the registry (fixed values).
SEED_ENTITIES = (
    ("federal_reserve", "Federal Reserve", "institution", 1.0, ["Fed", "US Federal Reserve", "FOMC"], ["rates", "monetary_policy", "fx", "bonds"]),
    ("iran", "Iran", "country", 0.85, ["Islamic Republic of Iran", "Tehran"], ["geo", "oil", "sanctions", "middle_east"]),
    ("opec", "OPEC", "institution", 0.9, ["Organization of Petroleum Exporting Countries"], ["oil", "energy", "commodities"]),
    ("ecb", "European Central Bank", "institution", 0.95, ["ECB", "BCE"], ["rates", "monetary_policy", "fx", "eur"]),
    ("banque_de_france", "Banque de France", "institution", 0.8, ["BdF", "Banque France"], ["rates", "monetary_policy", "eur", "french_economy"]),
    ("news_portfolio", "News Portfolio (RSS Radar)", "institution", 0.85, ["news_portfolio", "rss_radar"], ["news", "world", "fr", "markets", "rates", "oil"]),
)
_SITE_FEED = "https://news.google.com/rss/search?q=site%3A{}&hl=fr&gl=FR&ceid=FR:fr"
SEED_SOURCES = (
    ("federal_reserve", "official_doc", "https://www.federalreserve.gov/monetarypolicy/fomccalendars.htm", 1.0),
    ("federal_reserve", "rss", "https://www.federalreserve.gov/feeds/press_all.xml", 0.95),
    ("iran", "website", "https://en.irna.ir/", 0.7),
    ("iran", "rss", "https://www.aljazeera.com/xml/rss/all.xml", 0.75),
    ("opec", "official_doc", "https://www.opec.org/opec_web/en/press_room/", 0.95),
    ("ecb", "official_doc", "https://www.ecb.europa.eu/press/calendars/html/index.en.html", 1.0),
    ("ecb", "rss", "https://www.ecb.europa.eu/rss/press.html", 0.95),
    ("banque_de_france", "website", "https://www.banque-france.fr/communiques-de-presse", 0.9),
    ("banque_de_france", "official_doc", "https://www.banque-france.fr/statistiques", 0.85),
    ("news_portfolio", "rss", "https://www.lemonde.fr/rss/en_continu.xml", 0.80),
    ("news_portfolio", "rss", "https://www.lemonde.fr/economie/rss_full.xml", 0.75),
    ("news_portfolio", "rss", "https://www.lemonde.fr/international/rss_full.xml", 0.75),
    ("news_portfolio", "rss", "http://feeds.bbci.co.uk/news/world/rss.xml", 0.75),
    ("news_portfolio", "rss", "https://www.aljazeera.com/xml/rss/all.xml", 0.70),
    ("news_portfolio", "rss", "http://www.diplomatie.gouv.fr/spip.php?page=backend-fd", 0.80),
    ("news_portfolio", "rss", "https://www.ecb.europa.eu/rss/press.html", 0.90),
    ("news_portfolio", "rss", "https://www.ecb.europa.eu/rss/blog.html", 0.80),
    ("news_portfolio", "rss", "https://www.bis.org/doclist/all_pressrels.rss", 0.85),
    ("news_portfolio", "rss", "https://www.bankofengland.co.uk/rss/news", 0.80),
    ("news_portfolio", "rss", "https://www.rba.gov.au/rss/rss-cb-media-releases.xml", 0.75),
    ("news_portfolio", "rss", _SITE_FEED.format("boursier.com"), 0.60),
    ("news_portfolio", "rss", _SITE_FEED.format("lefigaro.fr"), 0.55),
    ("news_portfolio", "rss", _SITE_FEED.format("lesechos.fr"), 0.60),
)


def seed_entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_ENTITIES, ENTITIES)


def seed_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*s, 1) for s in SEED_SOURCES], SOURCES)


def missing_seeds(spark: SparkSession, stored: DataFrame) -> DataFrame:
    """Seed sources not stored yet; running it again after an append gives nothing."""
    return seed_sources(spark).join(stored.select("entity_id", "source_type", "url"), ["entity_id", "source_type", "url"], "left_anti")
