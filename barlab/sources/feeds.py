"""Feed, page and file sources: RSS/Atom items, HTML main text, text folders, lock files, request files."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions.text import HIDDEN, TEXT_EXTENSIONS, strip
from barlab.operators.retrieval import clean_lines

_RSS = ("channel struct<item:array<struct<title:string,link:string,pubDate:string,updated:string,description:string,"
        "`content:encoded`:string>>>")
_ATOM = "entry array<struct<title:string,link:array<struct<_href:string>>,published:string,updated:string,summary:string,content:string>>"


def feed_items(feeds: DataFrame, xml: str = "xml", limit: int | None = None) -> DataFrame:
    """Items (position, title, item_url, published_at, content) of RSS or Atom documents held in a column.

    The first body with text wins over the summary; items without any text are dropped. ``limit`` keeps the first items of
    each document.
    """
    options = {"valueTag": "_text", "mode": "PERMISSIVE"}
    text = lambda *cols: F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cols])
    keep = [c for c in feeds.columns if c != xml]
    rss = feeds.select(*keep, F.posexplode(F.from_xml(xml, _RSS, options)["channel"]["item"]).alias("pos", "i")).select(
        *keep, "pos", text(F.col("i.title")).alias("title"), text(F.col("i.link")).alias("item_url"), text(F.col("i.pubDate"), F.col("i.updated")).alias("published_at"),
        text(F.col("i")["content:encoded"], F.col("i.description")).alias("content"))
    atom = feeds.filter(F.col(xml).contains("<entry")).select(*keep, F.posexplode(F.from_xml(xml, _ATOM, options)["entry"]).alias("pos", "i")).select(
        *keep, "pos", text(F.col("i.title")).alias("title"), text(F.get(F.col("i.link"), F.lit(0))["_href"]).alias("item_url"), text(F.col("i.published"), F.col("i.updated")).alias("published_at"),
        text(F.col("i.content"), F.col("i.summary")).alias("content"))
    both = rss.unionByName(atom).filter(F.col("content").isNotNull())
    both = both.filter(F.col("pos") < limit) if limit is not None else both
    return both.fillna("", ["title", "item_url", "published_at"])


_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}
#: Marks of consent banners (fixed values).
_CONSENT = ("cookie", "consent", "didomi", "gdpr", "privacy", "banner")


class _MainText(HTMLParser):
    """Collects text outside hidden elements, consent banners and dialogs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.hidden: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        named = dict(attrs)
        marks = f"{named.get('id') or ''} {named.get('class') or ''}".lower()
        if self.hidden:
            self.hidden.append(tag)
        elif tag in HIDDEN or named.get("role") == "dialog" or any(w in marks for w in _CONSENT):
            self.hidden = [tag]
        elif tag == "title":
            self.in_title = True

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.hidden:  # also closes unclosed elements inside
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if self.hidden:
            return
        (self.title if self.in_title else self.parts).append(data)


def html_text(html: str) -> tuple[str, str]:
    """(title, main text) of a page; text runs become lines."""
    parser = _MainText()
    parser.feed(html or "")
    parser.close()
    return clean_lines(" ".join(parser.title)), clean_lines("\n".join(parser.parts))


def page_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with title and main text instead of HTML. Narrow: no shuffle."""
    keep = [f for f in pages.schema if f.name != html]
    names = [f.name for f in keep]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", title string, content string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [html_text(h) for h in pdf[html]]
            yield pdf[names].assign(title=[t for t, _ in found], content=[c for _, c in found])

    return pages.mapInPandas(run, schema)


def text_documents(spark: SparkSession, path: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS) -> DataFrame:
    """Whole text files under a folder with an allowed extension: (source, content)."""
    glob = "*{" + ",".join(extensions) + "}"
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


def lock_lines(lines: DataFrame, line: str = "value", no: str = "line_no") -> DataFrame:
    """Daily locks from lines that are JSON objects or ``SYMBOL;DATE;FLAG``; the last line per symbol and day wins."""
    j = F.from_json(line, "symbol string, pair string, date string, day string, lock boolean")
    parts = F.split(line, ";")
    part = lambda i: F.trim(F.get(parts, F.lit(i)))
    is_json = F.trim(line).startswith("{")
    flag = F.when(F.size(parts) < 3, True).otherwise(F.lower(part(2)).isin("1", "true", "yes", "y", "lock"))
    df = lines.withColumn("_j", j).select(
        F.upper(F.when(is_json, F.coalesce("_j.symbol", "_j.pair")).otherwise(part(0))).alias("symbol"),
        F.when(is_json, F.coalesce("_j.date", "_j.day")).otherwise(part(1)).alias("date"),
        F.when(is_json, F.coalesce(F.col("_j.lock"), F.lit(True))).otherwise(flag).alias("locked"), F.col(no).alias("_no"))
    df = df.filter((F.coalesce("symbol", F.lit("")) != "") & (F.coalesce("date", F.lit("")) != ""))
    return df.groupBy("symbol", "date").agg(F.max_by("locked", "_no").alias("locked"))


def parse_requests(lines: DataFrame, line: str = "value") -> DataFrame:
    """``SYMBOL;bar text`` requests."""
    parts = F.split(line, ";", 2)
    return lines.select(*[c for c in lines.columns if c != line], F.trim(F.get(parts, F.lit(0))).alias("symbol"), F.get(parts, F.lit(1)).alias("data")).filter("symbol <> '' and data is not null")


def format_responses(df: DataFrame) -> DataFrame:
    """``signal;lot;take_profit;stop_loss`` lines."""
    return df.select(*[c for c in df.columns if c not in ("signal", "lot", "take_profit", "stop_loss")],
                     F.concat_ws(";", "signal", *[F.col(c).cast("string") for c in ("lot", "take_profit", "stop_loss")]).alias("value"))
