"""Queries for feeds, text functions, news, registry, retrieval and memory (survey groups 2.1, 2.2, 2.3, 2.7 to 2.9, 2.14)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from barlab.catalog.data import event_bars, fixed, hash_int, show, table
from barlab.catalog.registry import query
from barlab.catalog.sql import cols, rnd
from barlab.functions import scalars as sc, text as tx
from barlab.operators import memory as mem, news, ranking, registry as reg, retrieval as rag, vectors
from barlab.session import ensure_checkpoint_dir
from barlab.sources import feeds, tables

DOC = "doc_id::BIGINT AS doc_id"
def now():
    return F.lit("2024-01-08 00:00:00").cast("timestamp")


NOW_SQL = "TIMESTAMP '2024-01-08 00:00:00'"

# ---------------------------------------------------------------- raw events from documents

KINDS = ("rss", "website", "official_doc", "social")
NAMES = ("European Central Bank", "OPEC Secretariat", "Market Desk", "")
HOSTS = ("www.ecb.europa.eu", "news.example.com", "www.opec.org", "Blog.Example.ORG")


def items(spark, sf, documents=None):
    """Feed items from documents (a batch or a stream): entity, source kind and host rotate with the document number."""
    d = table(spark, sf, "documents") if documents is None else documents
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values)).cast("int"))
    return d.select("doc_id", F.col("lang").alias("entity_id"), pick(NAMES).alias("entity_name"), F.regexp_extract("source", r"(\d+)", 1).cast("bigint").alias("source_id"), pick(KINDS).alias("source_type"),
                    F.concat(F.lit("https://"), pick(HOSTS), F.lit("/feed")).alias("source_url"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"),
                    F.lit("2024-01-01").alias("published_at"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("doc_id") % 20000).cast("int"))).alias("fetched_at"),
                    F.concat(F.lit("https://"), pick(HOSTS), F.lit("/a/"), (F.col("doc_id") % 700).cast("string")).alias("item_url"))


def events(spark, sf):
    return news.make_events(items(spark, sf))


def _pick(values):
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[(doc_id % {len(values)})+1]"


TRIM = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
ITEMS = f"""it AS (SELECT doc_id, lang AS entity_id, {_pick(NAMES)} AS entity_name, regexp_extract(source, '(\\d+)', 1)::BIGINT AS source_id, {_pick(KINDS)} AS source_type, 'https://'||{_pick(HOSTS)}||'/feed' AS source_url,
  {TRIM('substring(text,1,60)')} AS title, {TRIM('text')} AS content, TIMESTAMP '2024-01-01' + (doc_id % 20000) * INTERVAL 1 MINUTE AS fetched_at, 'https://'||{_pick(HOSTS)}||'/a/'||(doc_id % 700) AS url FROM documents),
ev AS (SELECT *, sha256(entity_id||'|'||source_id||'|'||source_type||'|'||url||'|'||title||'|'||content) AS content_hash, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) AS host FROM it)"""
HASHED = "substr(content_hash, 1, 12) AS hash"


@query("make_events", "N1 F13 F16", f"WITH {ITEMS} SELECT {HASHED}, host, source_type, count(*)::BIGINT AS n, min(length(title))::BIGINT AS title_length FROM ev GROUP BY ALL")
def _(spark, sf):
    e = events(spark, sf).withColumns({"hash": F.substring("content_hash", 1, 12), "host": tx.json_field(F.col("metadata"), "domain")})
    return e.groupBy("hash", "host", "source_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("title")).cast("bigint").alias("title_length"))


FOLD = f"translate(lower(title||chr(10)||body), '{tx.ACCENTED}', '{tx.PLAIN}')"


def _any_sql(col, words):
    return "(" + " OR ".join(f"contains({col}, '" + w.replace("'", "''") + "')" for w in words) + ")"


CARDS = (f"""{ITEMS}, bd AS (SELECT *, trim(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM ev), ft AS (SELECT *, {FOLD} AS t FROM bd),
ca AS (SELECT *, CASE """ + " ".join(f"WHEN {_any_sql('t', words)} THEN '{name}'" for name, words in news.EVENT_RULES)
         + " WHEN lower(entity_name) IN ('european central bank','ecb','banque centrale européenne') THEN 'central_bank_signal' WHEN contains(lower(entity_name),'opec') THEN 'commodity_supply'"
           " WHEN regexp_matches(host, '(ecb\\.europa\\.eu|federalreserve\\.gov)$') THEN 'central_bank_signal' ELSE 'unknown' END AS event_type FROM ft),"
           " cs AS (SELECT *, CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in news.SEVERITY.items()) + " END::DOUBLE AS severity,"
           " CASE WHEN host IN (" + ", ".join(f"'{h}'" for h in news.TRUSTED_HOSTS) + ") THEN greatest(ev0, 0.8) ELSE ev0 END AS evidence FROM (SELECT *, CASE source_type "
         + " ".join(f"WHEN '{k}' THEN {v}" for k, v in news.EVIDENCE.items()) + " END::DOUBLE AS ev0 FROM ca))")


@query("event_cards", "N2 N4 N5 N8 J14", f"WITH {CARDS} SELECT {HASHED}, event_type, {cols('severity evidence')}, 1.0::DOUBLE AS novelty FROM cs")
def _(spark, sf):
    c = news.to_cards(events(spark, sf))
    return c.select(F.substring("raw_event_hash", 1, 12).alias("hash"), "event_type", fixed("severity_score").alias("severity"), fixed("evidence_score").alias("evidence"), F.col("novelty_score").alias("novelty"))


DET = " || ".join(f"CASE WHEN {_any_sql('t', words)} THEN '|{n}' ELSE '' END" for n, words in news.DETECTED)
EXC = f"CASE WHEN {TRIM('body')}<>'' THEN {TRIM('body')} ELSE title END"


@query("card_entities_and_claims", "N6 N7 U5", f"""WITH {CARDS} SELECT {HASHED}, entity_name || {DET} AS names,
  CASE WHEN entity_name<>'' THEN entity_name ELSE host END AS speaker, CASE WHEN ({EXC})='' OR contains(lower(title), lower({EXC})) THEN title ELSE {TRIM(f"(title || ' — ' || {EXC})")} END AS claim FROM cs""")
def _(spark, sf):
    c = news.to_cards(events(spark, sf))
    names = F.array_join(F.transform("entities", lambda e: F.coalesce(e["name"], F.lit(""))), "|")
    return c.select(F.substring("raw_event_hash", 1, 12).alias("hash"), names.alias("names"), F.col("claims")[0]["speaker"].alias("speaker"), F.col("claims")[0]["text"].alias("claim"))


@query("insert_if_new", "S16 J8", f"""WITH {ITEMS}, new AS (SELECT content_hash, min(fetched_at) AS f FROM ev WHERE fetched_at >= TIMESTAMP '2024-01-01 06:00:00' GROUP BY 1), old AS (SELECT DISTINCT content_hash FROM ev WHERE fetched_at < TIMESTAMP '2024-01-01 06:00:00')
  SELECT {HASHED}, strftime(f, '%Y-%m-%d %H:%M:%S') AS first_seen FROM new WHERE content_hash NOT IN (SELECT content_hash FROM old)""")
def _(spark, sf):
    e = events(spark, sf)
    border = F.lit("2024-01-01 06:00:00").cast("timestamp")
    fresh = news.insert_if_new(e.filter(F.col("fetched_at") >= border), e.filter(F.col("fetched_at") < border))
    return fresh.select(F.substring("content_hash", 1, 12).alias("hash"), F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query("retention_purge", "N9", f"WITH {ITEMS} SELECT {HASHED}, {DOC} FROM ev WHERE fetched_at >= {NOW_SQL} - INTERVAL 7 DAY")
def _(spark, sf):
    raw = items(spark, sf)
    kept = news.purge(raw, now(), 7, "fetched_at")
    h = tx.content_hash(F.col("entity_id"), F.col("source_id"), F.col("source_type"), F.col("item_url"), tx.strip(F.col("title")), tx.strip(F.col("content")))
    return kept.select(F.substring(h, 1, 12).alias("hash"), F.col("doc_id").cast("bigint").alias("doc_id"))


@query("recent_items", "K4 ST3", f"""WITH {ITEMS} SELECT {HASHED}, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS read_at, host AS site, CASE WHEN title='' THEN '(sans titre)' ELSE title END AS title, url, 'unknown' AS event_type FROM ev
  WHERE fetched_at >= {NOW_SQL} - INTERVAL 7 DAY ORDER BY ev.fetched_at DESC, content_hash""")
def _(spark, sf):
    r = news.recent_for_display(events(spark, sf), now())
    return r.select(F.substring("content_hash", 1, 12).alias("hash"), F.date_format("read_at", "yyyy-MM-dd HH:mm:ss").alias("read_at"), "site", "title", "url", "event_type")


@query("category_routing", "P12", f"WITH {CARDS}, pf AS (SELECT label, CASE WHEN avg(x)<0 THEN -1 ELSE 1 END AS pref FROM (SELECT event_type AS label, (doc_id%3)-1 AS x FROM cs) GROUP BY 1) SELECT event_type, pref::BIGINT AS pref, CASE WHEN pref=-1 THEN 'blocked' ELSE 'retained' END AS tray, count(*)::BIGINT AS n FROM cs JOIN pf ON label=event_type GROUP BY ALL")
def _(spark, sf):
    raw = items(spark, sf)
    body = tx.fold(F.concat(tx.strip(F.col("title")), F.lit("\n"), tx.strip_tags(tx.strip(F.col("content")))))
    typed = raw.withColumn("_text", body).select("doc_id", news.classify(F.col("_text"), F.col("entity_name"), F.col("item_url")).alias("event_type"))
    prefs = typed.groupBy("event_type").agg(F.when(F.avg(F.col("doc_id") % 3 - 1) < 0, -1).otherwise(1).alias("pref"))
    return news.route(typed, prefs).groupBy("event_type", F.col("pref").cast("bigint").alias("pref"), "tray").agg(F.count(F.lit(1)).alias("n"))


@query("watcher_status", "G12", f"WITH {ITEMS} SELECT count(*)::BIGINT AS total, count(*)::BIGINT AS unprocessed, sum((fetched_at >= TIMESTAMP '2024-01-01 16:00:00' - INTERVAL 1 HOUR)::INT)::BIGINT AS last_hour FROM ev")
def _(spark, sf):
    return show(news.watcher_status(events(spark, sf), F.lit("2024-01-01 16:00:00").cast("timestamp")), "total unprocessed last_hour")


@query("recent_urls", "P10", """WITH p AS (SELECT page_id, url, CASE WHEN page_id%7=0 THEN 'soon' ELSE strftime(TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS ts FROM pages)
  SELECT url, min(page_id)::BIGINT AS pos FROM p WHERE try_strptime(replace(ts,'Z',''), '%Y-%m-%dT%H:%M:%S') >= TIMESTAMP '2024-02-03' - INTERVAL 30 DAY AND url<>'' GROUP BY url""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    stamp = F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("page_id").cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    it = p.select(F.col("page_id").alias("pos"), "url", F.when(F.col("page_id") % 7 == 0, "soon").otherwise(stamp).alias("published_at"))
    return show(news.recent_urls(it, F.lit("2024-02-03").cast("timestamp")), "pos", "", "url")


@query("ordered_source_union", "U2", """WITH a AS (SELECT url AS source, 0 AS part, page_id AS pos FROM pages UNION ALL SELECT 'https://'||source||'.example.com', 1, doc_id FROM documents UNION ALL SELECT url, 2, page_id+1000000 FROM pages)
  SELECT source, part::BIGINT AS part, pos::BIGINT AS pos FROM a QUALIFY row_number() OVER (PARTITION BY source ORDER BY part, pos)=1""")
def _(spark, sf):
    pages, docs = table(spark, sf, "pages"), table(spark, sf, "documents")
    parts = [pages.select(F.col("url").alias("source"), F.col("page_id").alias("pos")), docs.select(F.concat(F.lit("https://"), "source", F.lit(".example.com")).alias("source"), F.col("doc_id").alias("pos")),
             pages.select(F.col("url").alias("source"), (F.col("page_id") + 1000000).alias("pos"))]
    return show(news.ordered_union(parts), "part pos", "", "source")


@query("translated_titles", "J15", f"""WITH t AS (SELECT doc_id, {TRIM('text')} AS title, lang FROM documents), c AS (SELECT DISTINCT 'en::'||sha1(title) AS k, upper(title) AS tr FROM t WHERE lang='fr')
  SELECT {DOC}, coalesce(c.tr, title) AS shown_title FROM t LEFT JOIN c ON c.k='en::'||sha1(trim(title))""")
def _(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", tx.strip(F.col("text")).alias("title"), "lang")
    cache = t.filter("lang = 'fr'").select(F.concat(F.lit("en::"), F.sha1(F.col("title"))).alias("cache_key"), tx.capitals(F.col("title")).alias("translation")).distinct()
    return show(news.translated(t, cache, "en"), "doc_id", "", "shown_title")


@query("article_fields", "N21", f"""WITH a AS (SELECT doc_id, 'https://x.example/'||(doc_id%600) AS url, text, source FROM documents), f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id)=1)
  SELECT doc_id::BIGINT AS pos, url, substring(text,1,30) AS title, CASE WHEN doc_id%2=0 THEN source ELSE 'Inconnu' END AS source, '2024-05-01' AS published, text AS description, text AS preview FROM f""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    body = F.struct(F.substring("text", 1, 30).alias("title"), F.col("text").alias("description"), F.col("text").alias("content"), F.concat(F.lit("https://x.example/"), (F.col("doc_id") % 600).cast("string")).alias("url"),
                    F.lit("2024-05-01T10:00:00Z").alias("publishedAt"), F.when(F.col("doc_id") % 2 == 0, F.struct(F.col("source").alias("name"))).alias("source"))
    return show(news.article_fields(d.select(F.col("doc_id").alias("pos"), F.to_json(body).alias("article"))), "pos", "", "url title source published description preview")


LEX = {"the": 0.5, "and": -0.25, "le": 0.75, "la": -0.5, "und": 1.0, "de": -1.0, "is": 0.1}
LEX_SQL = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in LEX.items()) + "}"


@query("headline_sentiment", "N20 G14", f"""WITH t AS (SELECT lang AS currency, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda w: map_contains({LEX_SQL}, w)) AS w FROM documents WHERE trim(text)<>''),
  s AS (SELECT currency, CASE WHEN len(w)>0 THEN list_sum(list_transform(w, lambda x: {LEX_SQL}[x]))/len(w) ELSE 0 END AS s FROM t) SELECT currency, {rnd('avg(s)')} AS sentiment, count(*)::BIGINT AS titles FROM s GROUP BY 1""")
def _(spark, sf):
    t = table(spark, sf, "documents").select(F.col("lang").alias("currency"), F.col("text").alias("title"))
    return show(news.headline_sentiment(t, LEX), "titles", "sentiment", "currency")


# ---------------------------------------------------------------- feeds, pages, locks


@query("feed_items", "S12", f"""SELECT {DOC}, 0::BIGINT AS pos, 'Doc '||doc_id AS title, 'https://f.example/'||doc_id AS item_url, '2024-01-01' AS published_at, length({TRIM('text')})::BIGINT AS length FROM documents WHERE {TRIM('text')}<>''
  UNION ALL SELECT {DOC}, 2, 'Entry '||doc_id, '', '', length('kept body') FROM documents""")
def _(spark, sf):
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    n = F.col("doc_id").cast("string")
    xml = F.concat(F.lit("<rss><channel><title>t</title><item><title>Doc "), n, F.lit("</title><link>https://f.example/"), n, F.lit("</link><pubDate>2024-01-01</pubDate><description>"), esc,
                   F.lit("</description></item><item><title>empty</title><description> </description></item><item><title>Entry "), n,
                   F.lit("</title><description>short</description><content:encoded>kept body</content:encoded></item></channel></rss>"))
    out = feeds.feed_items(table(spark, sf, "documents").select("doc_id", xml.alias("xml")))
    return show(out.withColumn("length", F.length("content")), "doc_id pos length", "", "title item_url published_at")


@query("page_main_text", "S13 N3")
def _(spark, sf):
    return feeds.page_texts(table(spark, sf, "pages").select("page_id", "html")).select("page_id", "title", F.length("content").alias("length"))


_VIS = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
for _tag in tx.HIDDEN:
    _VIS = f"regexp_replace({_VIS}, '<{_tag}(\\s[^>]*)?>.*?</{_tag}>', ' ', 'gis')"
_VIS = f"regexp_replace({_VIS}, '<[^>]+>', ' ', 'gs')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _VIS = f"replace({_VIS}, '{_a}', '{_b}')"
_VIS = TRIM(f"regexp_replace({_VIS}, '\\s+', ' ', 'g')")


@query("page_visible_text", "N3 F14 F13", f"SELECT page_id::BIGINT AS page_id, {_VIS} AS content, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) AS host FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").cast("bigint").alias("page_id"), tx.visible_text(F.col("html")).alias("content"), tx.host(F.col("url")).alias("host"))


@query("daily_locks", "S8", """WITH l AS (SELECT c_custkey AS no, 'SYM'||(c_custkey%50) AS s, '2024-01-0'||(1+c_custkey%3) AS d, c_custkey%5<>0 AS lk FROM customer) SELECT s AS symbol, d AS date, arg_max(lk, no)::BIGINT AS locked FROM l GROUP BY ALL""")
def _(spark, sf):
    c = F.col("c_custkey")
    sym, day, lock = F.concat(F.lit("sym"), (c % 50).cast("string")), F.concat(F.lit("2024-01-0"), (1 + c % 3).cast("string")), c % 5 != 0
    line = F.when(c % 2 == 0, F.to_json(F.struct(sym.alias("symbol"), day.alias("date"), lock.alias("lock")))).otherwise(F.concat_ws(";", F.upper(sym), day, F.when(lock, "1").otherwise("0")))
    lines = table(spark, sf, "customer").select(line.alias("value"), c.alias("line_no"))
    return feeds.lock_lines(lines).select("symbol", "date", F.col("locked").cast("bigint").alias("locked"))


@query("request_parsing", "S7", "SELECT 'SYM'||(o_custkey%9) AS symbol, '1,2,3;'||o_orderkey AS data, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    lines = table(spark, sf, "orders").select(F.concat(F.lit("SYM"), (F.col("o_custkey") % 9).cast("string"), F.lit(";1,2,3;"), F.col("o_orderkey").cast("string")).alias("value"))
    return feeds.parse_requests(lines).groupBy("symbol", "data").agg(F.count(F.lit(1)).alias("n"))


@query("missing_seed_sources", "S19", "WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages), s(entity_id, source_type, url, trust_score) AS (VALUES " + ", ".join(f"('{e}','{t}','{u}',{w}::DOUBLE)" for e, t, u, w in tables.SEED_SOURCES)
       + ") SELECT entity_id, source_type, s.url, trust_score FROM s WHERE NOT EXISTS (SELECT 1 FROM h WHERE contains(s.url, h.host)) ")
def _(spark, sf):
    # the stored table holds the seeds whose host occurs among the pages
    hosts = table(spark, sf, "pages").select(tx.host(F.col("url")).alias("host")).distinct()
    seeds = tables.seed_sources(spark)
    stored = seeds.withColumn("host", tx.host(F.col("url"))).join(hosts, "host", "left_semi")
    return tables.missing_seeds(spark, stored).select("entity_id", "source_type", "url", "trust_score")


# ---------------------------------------------------------------- scalar functions


@query("timestamp_parsing", "F1", """SELECT o_orderkey::BIGINT AS o_orderkey, strftime(CASE WHEN o_orderkey%5=4 THEN NULL ELSE date_trunc('day', o_orderdate) END, '%Y-%m-%d') AS day FROM orders""")
def _(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 5 == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k % 5 == 1, F.date_format(d, "yyyy.MM.dd")).when(k % 5 == 2, F.date_format(d, "dd/MM/yyyy")).when(k % 5 == 3, F.date_format(d, "yyyy-MM-dd")).otherwise("n/a")
    return table(spark, sf, "orders").select(k.cast("bigint").alias("o_orderkey"), F.date_format(sc.parse_timestamp(text), "yyyy-MM-dd").alias("day"))


@query("timeframe_arithmetic", "F2", """WITH t AS (SELECT o_orderkey, ['M1','M5','M15','M30','H1','H4','D1','W1','MN1','X'][(o_orderkey%10)+1] AS tf, o_orderdate FROM orders)
  SELECT o_orderkey::BIGINT AS o_orderkey, CASE tf WHEN 'M1' THEN 1 WHEN 'M5' THEN 5 WHEN 'M15' THEN 15 WHEN 'M30' THEN 30 WHEN 'H4' THEN 240 WHEN 'D1' THEN 1440 WHEN 'W1' THEN 10080 WHEN 'MN1' THEN 43200 ELSE 60 END::BIGINT AS minutes,
  CASE tf WHEN 'H1' THEN 1 WHEN 'H4' THEN 4 WHEN 'D1' THEN 24 WHEN 'W1' THEN 120 WHEN 'MN1' THEN 504 ELSE 4 END::BIGINT AS h1_bars, ((o_orderkey%8)*6240)::BIGINT AS year_bars, ((o_orderkey%6)*504)::BIGINT AS month_bars FROM t""")
def _(spark, sf):
    tf = F.get(F.array(*[F.lit(x) for x in ("M1", "M5", "M15", "M30", "H1", "H4", "D1", "W1", "MN1", "X")]), (F.col("o_orderkey") % 10).cast("int"))
    return table(spark, sf, "orders").select(*[c.cast("bigint").alias(n) for n, c in (("o_orderkey", F.col("o_orderkey")), ("minutes", sc.timeframe_minutes(tf)), ("h1_bars", sc.timeframe_to_h1_bars(tf)),
                                               ("year_bars", sc.years_to_h1_bars(F.col("o_orderkey") % 8)), ("month_bars", sc.months_to_h1_bars(F.col("o_orderkey") % 6)))])


@query("pips_and_levels", "F3 F4 F10 F11", f"""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey%2=0 THEN 'USDJPY' ELSE 'EURUSD' END AS s, o_totalprice/1000 AS price, CASE WHEN o_orderkey%2=0 THEN 0.01::DOUBLE ELSE 0.0001::DOUBLE END AS pip, o_custkey%50+5 AS sl FROM orders)
  SELECT o_orderkey::BIGINT AS o_orderkey, {rnd('pip', 5)} AS pip, CASE WHEN o_orderkey%2=0 THEN 3 ELSE 5 END::BIGINT AS digits, {rnd('least(abs(price/pip - round_even(price/pip/50,0)*50), abs(price/pip - round_even(price/pip/100,0)*100))', 2)} AS round_dist,
  {rnd('round_even(greatest(0.01::DOUBLE, round_even(10000*1.0::DOUBLE/100/(sl*10.0::DOUBLE)/0.01::DOUBLE,0)*0.01::DOUBLE),2)')} AS lot, {rnd('CASE WHEN o_orderkey%3=0 THEN price-2.5*1.5 ELSE price+2.5*1.5 END', 3)} AS stop, {rnd('CASE WHEN o_orderkey%3=0 THEN price+2.5*2 ELSE price-2.5*2 END', 3)} AS target FROM p""")
def _(spark, sf):
    k = F.col("o_orderkey")
    p = table(spark, sf, "orders").select("o_orderkey", F.when(k % 2 == 0, "USDJPY").otherwise("EURUSD").alias("s"), (F.col("o_totalprice") / 1000).alias("price"), (F.col("o_custkey") % 50 + 5).alias("sl"))
    pip, side = sc.pip_size(F.col("s")), F.when(k % 3 == 0, "BUY").otherwise("SELL")
    lit = lambda x: F.lit(float(x))
    lot = sc.lot_size(lit(10000), lit(1.0), F.col("sl"), lit(0.0001), lit(0.00001), lit(1), lit(0.01), lit(0.01))
    return p.select(k.cast("bigint").alias("o_orderkey"), fixed(pip, 5).alias("pip"), sc.price_digits(F.col("s")).cast("bigint").alias("digits"), fixed(sc.round_level_distance(F.col("price"), pip), 2).alias("round_dist"),
                    fixed(lot).alias("lot"), fixed(sc.stop_price(side, F.col("price"), lit(2.5), 1.5, 8), 3).alias("stop"), fixed(sc.target_price(side, F.col("price"), lit(2.5), 2.0, 8), 3).alias("target"))


@query("numeric_cleaning", "P3 F23 P2", """SELECT event_id::BIGINT AS event_id, coalesce(CASE WHEN event_id%4=0 THEN 0 ELSE value END, 0)::DOUBLE AS cleaned, CASE WHEN event_id%4=0 THEN 0.0 ELSE greatest(0, least(1, value-1)) END::DOUBLE AS clamped, 0.0::DOUBLE AS missing FROM events""")
def _(spark, sf):
    from barlab.operators.features import align

    k = F.col("event_id")
    raw = F.when(k % 8 == 0, F.lit("n/a")).when(k % 8 == 4, F.lit("Infinity")).otherwise(F.col("value").cast("string"))
    df = table(spark, sf, "events").select("event_id", raw.alias("cleaned"), sc.clamp01(sc.finite_or_zero(raw) - 1).alias("clamped"))
    out = align(df, ["cleaned", "clamped", "missing"], ["event_id"])
    return out.select(k.cast("bigint").alias("event_id"), "cleaned", "clamped", "missing")


@query("feature_projection", "P1 U1 U4", "WITH b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2) SELECT symbol, (row_number() OVER (PARTITION BY symbol ORDER BY h)-1)::BIGINT AS bar_idx, n::DOUBLE AS tick_volume, 0.0::DOUBLE AS rsi, 0.0::DOUBLE AS hour, 47::BIGINT AS features FROM b")
def _(spark, sf):
    from barlab.operators.features import active_features, align

    wanted = active_features(["rsi", "stochastic", "bollinger", "tick_volume", "correlation", "divergences", "moving_averages"])
    df = align(event_bars(spark, sf), wanted)
    found = len(set(df.columns) & set(wanted))
    return df.select("symbol", F.col("bar_idx").cast("bigint").alias("bar_idx"), "tick_volume", "rsi", "hour", F.lit(found).cast("bigint").alias("features"))


@query("accent_folding", "F15", f"SELECT {DOC}, translate(lower(text), '{tx.ACCENTED}', '{tx.PLAIN}') AS folded FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), tx.fold(F.col("text")).alias("folded"))


@query("url_extraction", "F17", """SELECT page_id::BIGINT AS page_id, array_to_string(list_distinct_ordered, ' ') AS urls FROM (SELECT page_id, list_filter(u, lambda x, i: list_position(u, x)=i) AS list_distinct_ordered FROM (SELECT page_id, regexp_extract_all(html||' '||url||' '||url, '(?i)(https?://[^\\s<>"'']+)', 1) AS u FROM pages))""")
def _(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").cast("bigint").alias("page_id"), F.array_join(tx.extract_urls(F.concat_ws(" ", "html", "url", "url")), " ").alias("urls"))


@query("source_rewrite_and_filter", "F18 P11", """WITH s AS (SELECT page_id, CASE page_id%4 WHEN 0 THEN 'https://truthsocial.com/@realDonaldTrump' WHEN 1 THEN 'http://www.opec.org/opec_web/en/press_room/'||page_id WHEN 2 THEN 'notes/'||page_id||'.MD' ELSE url END AS u FROM pages)
  SELECT page_id::BIGINT AS page_id, CASE page_id%4 WHEN 0 THEN 'rss' WHEN 1 THEN 'rss' ELSE 'website' END AS kind, CASE page_id%4 WHEN 0 THEN 'https://trumpstruth.org/feed' WHEN 1 THEN 'https://news.google.com/rss/search?q=site%3Aopec.org%20press%20releases&hl=en-US&gl=US&ceid=US:en' ELSE u END AS url, 1::BIGINT AS allowed FROM s""")
def _(spark, sf):
    k = F.col("page_id")
    u = F.when(k % 4 == 0, "https://truthsocial.com/@realDonaldTrump").when(k % 4 == 1, F.concat(F.lit("http://www.opec.org/opec_web/en/press_room/"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("notes/"), k.cast("string"), F.lit(".MD"))).otherwise(F.col("url"))
    s = table(spark, sf, "pages").select("page_id", u.alias("u"))
    kind, url = tx.rewrite_source(F.lit("website"), F.col("u"))
    return s.select(k.cast("bigint").alias("page_id"), kind.alias("kind"), url.alias("url"), tx.allowed_source(F.col("u")).cast("bigint").alias("allowed"))


@query("token_budget", "F19", """WITH c AS (SELECT doc_id, text, CASE WHEN length(text)=0 THEN 0 ELSE greatest(1, length(text)//4) END AS tok, substring(text,1,200) AS cut FROM documents)
  SELECT doc_id::BIGINT AS doc_id, tok::BIGINT AS tokens, CASE WHEN length(text)<=200 THEN text ELSE CASE WHEN contains(cut,' ') THEN regexp_replace(cut, ' [^ ]*$', '') ELSE cut END||'…' END AS trimmed FROM c""")
def _(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), tx.tokens(F.col("text")).cast("bigint").alias("tokens"), tx.trim_to_tokens(F.col("text"), F.lit(50)).alias("trimmed"))


def _lang_sql(text):
    hits = {l: "+".join(f"contains(s,' {w} ')::INT" for w in ws) for l, ws in tx.STOP_WORDS.items()}
    best = f"greatest({', '.join(hits.values())})"
    return f"CASE WHEN {best}=0 THEN 'fr' " + " ".join(f"WHEN {h}={best} THEN '{l}'" for l, h in hits.items()) + " END", f"' '||lower({TRIM(text)})||' '"


_LANG, _PAD = _lang_sql("text")


@query("language_guess", "F20", f"WITH p AS (SELECT doc_id, {_PAD} AS s FROM documents) SELECT {DOC}, {_LANG} AS lang FROM p")
def _(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), tx.guess_language(F.col("text")).alias("lang"))


_TAIL = TRIM("text||chr(10)||'Sources: a [1]'")
_BODY = TRIM("regexp_replace(regexp_replace(" + _TAIL + r", '\n\s*(?:sources?|références?)\s*:.*$', '', 'is'), '\s*\[\d+\]', '', 'g')")
_QUOTED = "translate(text||' ```x = 1``` see https://a.b/c *', chr(160)||'’“”«»', ' ''\"\"\"\"')"
_SPOKEN = TRIM("regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _QUOTED + r", '```.*?```', ' ', 'gs'), 'https?://\S+', ' ', 'g'), '[*•★☆✱✳✴﹡∗＊]', ' ', 'g'), '\s+', ' ', 'g')")
_HEAD = "CASE WHEN len(string_split(text, chr(10)))<=2 THEN text ELSE array_to_string(string_split(text, chr(10))[1:2], chr(10))||chr(10)||'… [tronqué à 2 lignes]' END"


@query("text_cleanup", "F21 F27", "SELECT " + DOC + ", " + _BODY + " AS body, " + _HEAD + " AS head, " + _SPOKEN + " AS spoken FROM documents")
def _(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), tx.drop_sources_tail(F.concat(t, F.lit("\nSources: a [1]"))).alias("body"), tx.first_lines(t, 2).alias("head"),
                                                tx.speakable(F.concat(t, F.lit(" ```x = 1``` see https://a.b/c *"))).alias("spoken"))


@query("json_metadata", "F22", "SELECT event_id::BIGINT AS event_id, CASE WHEN event_id%3=0 THEN '' ELSE json_extract_string(props, '$.k') END AS k FROM events")
def _(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return table(spark, sf, "events").select(F.col("event_id").cast("bigint").alias("event_id"), F.coalesce(tx.json_field(text, "k"), F.lit("")).alias("k"))


@query("event_labels", "F24", f"WITH {CARDS} SELECT event_type, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.EVENT_LABELS["fr"].items()) + " END AS label, count(*)::BIGINT AS n FROM cs GROUP BY ALL")
def _(spark, sf):
    raw = items(spark, sf)
    body = tx.fold(F.concat(tx.strip(F.col("title")), F.lit("\n"), tx.strip_tags(tx.strip(F.col("content")))))
    return raw.withColumn("_text", body).select(news.classify(F.col("_text"), F.col("entity_name"), F.col("item_url")).alias("event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", tx.event_label(F.col("event_type")).alias("label"), "n")


@query("display_formats", "F25", """SELECT o_orderkey::BIGINT AS o_orderkey, CASE WHEN o_orderkey<60 THEN o_orderkey||' secondes' WHEN o_orderkey<3600 THEN (o_orderkey//60)||'min '||(o_orderkey%60)||'s' ELSE (o_orderkey//3600)||'h '||((o_orderkey%3600)//60)||'min' END AS duration,
  CASE WHEN o_orderkey<1024 THEN o_orderkey||' B' WHEN o_orderkey<1048576 THEN printf('%.1f KB', floor(o_orderkey/1024.0::DOUBLE*10+0.5)/10) ELSE printf('%.1f MB', floor(o_orderkey/1048576.0::DOUBLE*10+0.5)/10) END AS size FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.cast("bigint").alias("o_orderkey"), sc.duration_text(k).alias("duration"), sc.size_text(k).alias("size"))


@query("problem_domains", "F28", "WITH s AS (SELECT doc_id, lower(text) AS t FROM documents), h AS (SELECT doc_id, " + ", ".join("(" + "+".join("contains(t, '" + w.replace("'", "''") + "')::INT" for w in ws) + f") AS {d}" for d, ws in tx.DOMAIN_KEYWORDS.items())
       + " FROM s), b AS (SELECT *, greatest(" + ", ".join(tx.DOMAIN_KEYWORDS) + f") AS m FROM h) SELECT {DOC}, CASE WHEN m=0 THEN 'generic' " + " ".join(f"WHEN {d}=m THEN '{d}'" for d in tx.DOMAIN_KEYWORDS) + " END AS domain FROM b")
def _(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), tx.problem_domain(F.col("text")).alias("domain"))


# ---------------------------------------------------------------- registry

ENT = "en AS (SELECT n_nationkey, lower(n_name) AS entity_id, n_name AS name, CASE WHEN n_nationkey%2=0 THEN 'country' ELSE 'institution' END AS entity_type, (n_nationkey%10)/10.0::DOUBLE AS importance FROM nation), so AS (SELECT s_suppkey AS source_id, lower(n_name) AS entity_id, 'https://'||s_name AS url, least(1, greatest(0, s_acctbal/10000)) AS trust, (s_suppkey%4<>0)::INT AS act FROM supplier JOIN nation ON n_nationkey=s_nationkey)"


def entities(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(F.lower("n_name").alias("entity_id"), F.col("n_name").alias("name"), F.when(k % 2 == 0, "country").otherwise("institution").alias("entity_type"), ((k % 10) / 10.0).alias("importance_score"),
                                             F.array(F.concat(F.lit("alias"), k.cast("string"))).alias("aliases"), F.array(F.concat(F.lit("topic"), (k % 5).cast("string")), F.concat(F.lit("topic"), (k % 3).cast("string"))).alias("topics"))


def registry_sources(spark, sf):
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("source_id"), F.lower("n_name").alias("entity_id"), F.lit("rss").alias("source_type"), F.concat(F.lit("https://"), "s_name").alias("url"), sc.clamp01(F.col("s_acctbal") / 10000).alias("trust_score"), (F.col("s_suppkey") % 4 != 0).cast("int").alias("is_active"))


@query("list_entities", "P8 U4 N12", f"WITH {ENT} SELECT entity_id, {cols('importance')} FROM en WHERE importance>=0.3 AND entity_type='country' AND (n_nationkey%5 IN (1,2) OR n_nationkey%3 IN (1,2))")
def _(spark, sf):
    return reg.list_entities(entities(spark, sf), 0.3, "country", ["topic1", "topic2"]).select("entity_id", fixed("importance_score").alias("importance"))


@query("critical_entities", "N12", f"WITH {ENT} SELECT entity_id FROM en WHERE importance>=0.7")
def _(spark, sf):
    return reg.critical_entities(entities(spark, sf)).select("entity_id")


@query("text_search", "P9", "SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn FROM conversations WHERE contains(lower(text), 'tion la') OR contains(lower(role), 'tion la')")
def _(spark, sf):
    return show(reg.search_text(table(spark, sf, "conversations"), "TION la", ["text", "role"]), "conv_id turn")


@query("alias_search", "P9", f"WITH {ENT} SELECT entity_id FROM en WHERE contains('alias'||n_nationkey, 'alias1') OR contains(lower(name), 'alias1')")
def _(spark, sf):
    return reg.find_by_alias(entities(spark, sf), "Alias1").select("entity_id")


@query("active_sources", "J7", f"WITH {ENT} SELECT source_id::BIGINT AS source_id, name AS entity_name, {cols('importance trust')} FROM so JOIN en USING (entity_id) WHERE act=1")
def _(spark, sf):
    d = reg.active_sources(registry_sources(spark, sf), entities(spark, sf))
    return d.select(F.col("source_id").cast("bigint").alias("source_id"), "entity_name", fixed("importance_score").alias("importance"), fixed("trust_score").alias("trust"))


@query("insertable_sources", "J8 J9", """WITH n AS (SELECT c_custkey, 'nation_'||(c_nationkey+5) AS e, 'https://'||CASE WHEN c_custkey%2=0 THEN 'Supplier#'||lpad((c_custkey%200)::VARCHAR, 9, '0') ELSE c_name END AS url FROM customer)
  SELECT c_custkey::BIGINT AS source_id FROM n WHERE e IN (SELECT lower(n_name) FROM nation) AND NOT EXISTS (SELECT 1 FROM supplier JOIN nation ON n_nationkey=s_nationkey WHERE lower(n_name)=e AND 'https://'||s_name=url)""")
def _(spark, sf):
    k = F.col("c_custkey")
    new = table(spark, sf, "customer").select(k.alias("source_id"), F.concat(F.lit("nation_"), (F.col("c_nationkey") + 5).cast("string")).alias("entity_id"), F.lit("rss").alias("source_type"),
                                              F.concat(F.lit("https://"), F.when(k % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad((k % 200).cast("string"), 9, "0"))).otherwise(F.col("c_name"))).alias("url"))
    return show(reg.insertable_sources(new, entities(spark, sf), registry_sources(spark, sf)), "source_id")


@query("entity_proposals", "N10", """WITH p AS (SELECT CASE WHEN c_custkey%3=0 THEN 'NATION_'||c_nationkey ELSE c_mktsegment||' '||(c_custkey%400) END AS name, 'https://'||CASE WHEN c_custkey%7=0 THEN 'www.reuters.com/' ELSE 'blog.example/' END||c_custkey AS url FROM customer),
  a AS (SELECT name, count(*) AS n, sum(contains(url,'reuters.com')::INT) AS t FROM p GROUP BY 1) SELECT name, n::BIGINT AS sources, CASE WHEN replace(lower(name),' ','_') IN (SELECT lower(n_name) FROM nation) THEN 'rejected' WHEN n>=2 AND t>0 THEN 'auto_approved' ELSE 'pending_validation' END AS status FROM a""")
def _(spark, sf):
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(F.when(k % 3 == 0, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).otherwise(F.concat_ws(" ", "c_mktsegment", (k % 400).cast("string"))).alias("name"), F.lit("institution").alias("entity_type"),
                                            F.concat(F.lit("https://"), F.when(k % 7 == 0, "www.reuters.com/").otherwise("blog.example/"), k.cast("string")).alias("url"))
    return show(reg.review_proposals(p, entities(spark, sf)), "sources", "", "name status")


@query("score_updates", "N11", f"WITH {ENT}, u AS (SELECT l_suppkey AS source_id, arg_max(l_discount*20-0.3, l_orderkey*10000+l_partkey) AS t FROM (SELECT l_suppkey, l_orderkey, l_partkey, max(l_discount) AS l_discount FROM lineitem GROUP BY ALL) GROUP BY 1) SELECT source_id::BIGINT AS source_id, {rnd('coalesce(greatest(0, least(1, t)), trust)')} AS trust FROM so LEFT JOIN u USING (source_id)")
def _(spark, sf):
    u = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_partkey").agg(F.max("l_discount").alias("d")).select(F.col("l_suppkey").alias("source_id"), (F.col("d") * 20 - 0.3).alias("trust_score"), (F.col("l_orderkey") * 10000 + F.col("l_partkey")).alias("at"))
    return reg.update_scores(registry_sources(spark, sf), u, "source_id", "trust_score", "at").select(F.col("source_id").cast("bigint").alias("source_id"), fixed("trust_score").alias("trust"))


# ---------------------------------------------------------------- retrieval


@query("chunk_documents", "R1 S14 S17")
def _(spark, sf):
    return rag.chunk_documents(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "chunk_no", F.length("content").alias("length"))


@query("split_long_texts", "R2")
def _(spark, sf):
    return rag.split_long_texts(table(spark, sf, "documents").select("doc_id", "text"), 2000).select("doc_id", "chunk_no", F.length("content").alias("length"))


CENT = """un AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), nv AS (SELECT vec_id, list_transform(e, lambda x: x/sqrt(list_dot_product(e,e))) AS v FROM un),
d AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM d GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS q FROM m GROUP BY 1),
qn AS (SELECT label, list_transform(q, lambda x: x/sqrt(list_dot_product(q,q))) AS q FROM c),
hits AS (SELECT label AS query_id, vec_id, 2*list_dot_product(v, q)-1 AS score FROM nv, qn), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM hits QUALIFY rank<=5)"""


def _nearest(spark, sf):
    e = table(spark, sf, "embeddings")
    return rag.nearest(e, rag.label_centroids(e).withColumnRenamed("label", "query_id"), 5)


@query("nearest_vectors", "R3 R5", f"WITH {CENT} SELECT query_id::BIGINT AS query_id, vec_id::BIGINT AS vec_id, rank::BIGINT AS rank, {cols('score')} FROM top")
def _(spark, sf):
    return show(_nearest(spark, sf), "query_id vec_id rank", "score")


@query("bulk_nearest", "R5", f"""WITH {CENT.split(',\n')[0]}, hits AS (SELECT q.vec_id AS query_id, nv.vec_id, round(2*list_dot_product(nv.v, q.v)-1, 12) AS score FROM nv, nv q WHERE q.vec_id % 20 = 0)
  SELECT query_id::BIGINT AS query_id, vec_id::BIGINT AS vec_id, rank::BIGINT AS rank, {cols('score')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM hits) WHERE rank <= 5""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return show(vectors.grid_search(vectors.blocks_of(e), asked, 5), "query_id vec_id rank", "score")


@query("vector_upsert", "R4 R7", f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding, CASE WHEN vec_id % 7 = 0 THEN 2 ELSE 1 END AS batch FROM embeddings),
  un AS (SELECT vec_id, batch, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM e), nv AS (SELECT vec_id, batch, list_transform(e, lambda x: x/sqrt(list_dot_product(e,e))) AS v FROM un),
  hits AS (SELECT q.vec_id AS query_id, nv.vec_id, nv.batch, round(2*list_dot_product(nv.v, q.v)-1, 12) AS score FROM nv, nv q WHERE q.vec_id % 20 = 0)
  SELECT query_id::BIGINT AS query_id, vec_id::BIGINT AS vec_id, rank::BIGINT AS rank, 'text ' || vec_id || ' of ' || batch AS content, {cols('score')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM hits) WHERE rank <= 3""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    store = vectors.VectorTable(spark, f"{ensure_checkpoint_dir(spark)}/vectors-{uuid4().hex}")
    rows = lambda df, batch: df.select("vec_id", "embedding", F.format_string(f"text %d of {batch}", "vec_id").alias("content"), F.lit("{}").alias("metadata"))
    turned = e.where("vec_id % 7 = 0").withColumn("embedding", F.reverse("embedding"))
    store.write(1, rows(e, 1))
    store.write(2, rows(turned, 2))
    store.write(2, rows(turned, 2))  # a retry changes nothing
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 7 == 0, F.reverse("embedding")).otherwise(F.col("embedding")).alias("embedding"))
    return show(store.search(asked, 3), "query_id vec_id rank", "score", "content")


@query("bounded_context", "R6", f"""WITH {CENT}, sn AS (SELECT query_id, rank, '['||rank||'] '||trim(substring(d.text,1,240))||chr(10) AS s FROM top JOIN documents d ON d.doc_id=top.vec_id),
  tk AS (SELECT *, greatest(1, length(s)//4) AS t, sum(greatest(1, length(s)//4)) OVER (PARTITION BY query_id ORDER BY rank) AS cum FROM sn), ct AS (SELECT query_id, rank, CASE WHEN cum<=150 THEN s ELSE substring(s, 1, ((150-(cum-t))*4)::INT) END AS s FROM tk WHERE cum-t<150)
  SELECT query_id::BIGINT AS query_id, string_agg(s, '' ORDER BY rank) AS context, count(*)::BIGINT AS snippets FROM ct GROUP BY 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    return show(rag.bounded_context(_nearest(spark, sf).join(docs, "vec_id"), 150, 240), "query_id snippets", "", "context")


@query("index_compaction", "K5 R7", "SELECT event_id::BIGINT AS event_id FROM events QUALIFY count(*) OVER () <= 5000 OR row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 3000")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return show(ranking.compact(e, F.floor(F.unix_timestamp("ts") / 3600), ["ts", "event_id"]), "event_id")


@query("ingested_difference", "U3", "SELECT doc_id::BIGINT AS doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return show(table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti"), "doc_id")


# ---------------------------------------------------------------- conversations and memory


@query("fitted_history", "N22", """WITH m AS (SELECT *, CASE WHEN length(text)=0 THEN 0 ELSE greatest(1, length(text)//4) END + 8 AS cost FROM conversations WHERE role IN ('user','assistant')),
  c AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS cum FROM m), l AS (SELECT *, 300-(cum-cost) AS rem FROM c),
  x AS (SELECT *, CASE WHEN cum<=300 THEN text WHEN cum-cost<=300 THEN CASE WHEN rem>32 THEN CASE WHEN length(text)<=(rem-8)*4 THEN text ELSE regexp_replace(substring(text,1,((rem-8)*4)::INT), ' [^ ]*$', '')||'…' END WHEN cum=cost THEN text END END AS content FROM l)
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, content FROM x WHERE content IS NOT NULL""")
def _(spark, sf):
    return show(mem.fit_history(table(spark, sf, "conversations"), 300), "conv_id turn", "", "content")


_LANG2, _PAD2 = _lang_sql("t")


@query("conversation_language", "N23", f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations), u AS (SELECT * FROM a WHERE rn<=6 AND role='user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)<=3),
  g AS (SELECT conv_id, string_agg(text, ' '||chr(10) ORDER BY turn) AS t FROM u GROUP BY 1), p AS (SELECT conv_id, {_PAD2} AS s FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN g USING (conv_id)) SELECT conv_id::BIGINT AS conv_id, CASE WHEN s IS NULL THEN 'fr' ELSE {_LANG2} END AS lang FROM p""")
def _(spark, sf):
    return show(mem.conversation_language(table(spark, sf, "conversations")), "conv_id", "", "lang")


@query("message_order", "K7", """WITH m AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey%4=0 THEN NULL ELSE o_orderdate END AS t FROM orders) SELECT pos::BIGINT AS pos, strftime(t, '%Y-%m-%d') AS day FROM m ORDER BY t NULLS LAST, pos""")
def _(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 4 == 0, "?").when(k % 4 == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 4 == 2, F.date_format(d, "yyyy/MM/dd HH:mm:ss")).otherwise(F.date_format(d, "yyyy-MM-dd HH:mm"))
    m = mem.chronological(table(spark, sf, "orders").select(k.alias("pos"), text.alias("timestamp")))
    return m.select(F.col("pos").cast("bigint").alias("pos"), F.date_format("parsed_ts", "yyyy-MM-dd").alias("day"))


def feedback(spark, sf):
    t = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return t.select("doc_id", F.when(F.col("quality") == 1, "up").otherwise("down").alias("rating"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("user_question"), F.expr("substring(text, length(split_part(text, '\n', 1)) + 2)").alias("ia_answer"),
                    F.when(F.col("toxic") == 1, F.concat(F.lit("fixed "), F.col("doc_id").cast("string"))).alias("corrected_answer"))


FB = "fb AS (SELECT l.doc_id, quality, split_part(text, chr(10), 1) AS q, substring(text, length(split_part(text, chr(10), 1)) + 2) AS a, CASE WHEN toxic=1 THEN 'fixed '||l.doc_id END AS c FROM labels l JOIN documents d ON d.doc_id=l.doc_id)"


@query("training_pairs", "N24", f"WITH {FB} SELECT q AS prompt, coalesce(c, CASE WHEN quality=1 THEN a END) AS completion FROM fb WHERE coalesce(c, CASE WHEN quality=1 THEN a END) IS NOT NULL")
def _(spark, sf):
    return mem.training_pairs(feedback(spark, sf)).select("prompt", "completion")


@query("feedback_counts", "G15", f"WITH {FB} SELECT count(*)::BIGINT AS feedbacks, sum((quality=1)::INT)::BIGINT AS up, sum((c IS NOT NULL OR quality=1)::INT)::BIGINT AS pairs FROM fb")
def _(spark, sf):
    f = feedback(spark, sf)
    return f.agg(F.count(F.lit(1)).alias("feedbacks"), F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("corrected_answer").isNotNull() | (F.col("rating") == "up")).alias("pairs"))


def experiences(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.concat(F.lit("goal "), F.col("user_id").cast("string")).alias("objective"), F.col("event_type").alias("action"), F.col("props").alias("result"),
                    (F.col("event_id") % 3 != 0).cast("int").alias("success"), F.col("value").alias("score"))


def discoveries(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.struct("ts", "event_id").alias("at"), F.col("ts").alias("timestamp"))


def stored_strategies(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("SYM"), (F.col("s_nationkey") % 4).cast("string")).alias("symbol"), F.round(F.col("s_acctbal") / 100, 1).alias("score"), F.when(F.col("s_suppkey") % 2 == 0, "active").otherwise("tested").alias("status"))


@query("upserted_discoveries", "M2", "SELECT event_type AS category, user_id::VARCHAR AS key, arg_max(value, (ts, event_id)) AS value, count(*)::BIGINT AS writes FROM events GROUP BY ALL")
def _(spark, sf):
    d = discoveries(spark, sf)
    border = F.lit("2024-01-15").cast("timestamp")
    up = mem.upsert(d.filter(F.col("timestamp") < border), d.filter(F.col("timestamp") >= border), ["category", "key"], "at")
    n = d.groupBy("category", "key").agg(F.count(F.lit(1)).alias("writes"))
    return up.join(n, ["category", "key"]).select("category", "key", F.col("value").cast("double").alias("value"), "writes")


@query("store_stats", "G11", f"SELECT (SELECT count(*) FROM events)::BIGINT AS experiences, {rnd('(SELECT round_even(sum((event_id%3<>0)::INT)/count(*)*100, 1) FROM events)')} AS success_rate, (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM events))::BIGINT AS discoveries, (SELECT count(*) FROM supplier)::BIGINT AS strategies")
def _(spark, sf):
    d = discoveries(spark, sf).select("category", "key").distinct()
    return show(mem.store_stats(experiences(spark, sf), d, stored_strategies(spark, sf)), "experiences discoveries strategies", "success_rate")


@query("recent_experiences", "K3", "SELECT event_id::BIGINT AS id, 'recent' AS list FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 20) UNION ALL SELECT event_id, 'failed' FROM (SELECT * FROM events WHERE event_id%3=0 ORDER BY ts DESC, event_id DESC LIMIT 10) UNION ALL SELECT event_id, 'click' FROM (SELECT * FROM events WHERE event_type='click' ORDER BY ts DESC, event_id DESC LIMIT 10)")
def _(spark, sf):
    e = experiences(spark, sf)
    order = [F.col("timestamp").desc(), F.col("id").desc()]
    part = lambda df, n, name: mem.top_rows(df, n, *order).select(F.col("id").cast("bigint").alias("id"), F.lit(name).alias("list"))
    return part(e, 20, "recent").unionByName(part(e.filter("success = 0"), 10, "failed")).unionByName(part(e.filter("action = 'click'"), 10, "click"))


@query("best_stored_strategies", "K3", f"WITH s AS (SELECT s_suppkey AS id, 'SYM'||(s_nationkey%4) AS symbol, round(s_acctbal/100,1) AS score, CASE WHEN s_suppkey%2=0 THEN 'active' ELSE 'tested' END AS status FROM supplier) SELECT id::BIGINT AS id, symbol, {cols('score')} FROM s WHERE status='active' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, id)<=3")
def _(spark, sf):
    s = stored_strategies(spark, sf).filter("status = 'active'")
    return show(ranking.best_per(s, ["symbol"], [F.col("score").desc(), F.col("id")], 3), "id", "score", "symbol")


@query("context_summary", "M3 M1")
def _(spark, sf):
    return mem.context_summary(mem.experience_rows(experiences(spark, sf)), discoveries(spark, sf).withColumn("id", F.lit(0)), stored_strategies(spark, sf))
