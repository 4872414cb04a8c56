import numpy as np
from datetime import datetime

from pyspark.sql import functions as F

from barlab.functions import text as tx
from barlab.operators import memory as mem, news, registry as reg, retrieval as rag
from barlab.sources import feeds, sinks, tables


def test_chunks_are_bounded_and_overlap():
    text = "\n\n".join(" ".join(f"w{p}x{n}" for n in range(60)) for p in range(12))
    chunks = rag.split_text(text, 200, 50)
    assert all(len(c) <= 200 for c in chunks) and len(chunks) > 10
    words = [w for c in chunks for w in c.split()]
    assert set(words) == set(text.split())
    assert any(a.split()[-1] in b.split() for a, b in zip(chunks, chunks[1:]))
    assert rag.split_text("", 100, 10) == [] and rag.split_text("short", 100, 10) == ["short"]
    assert max(len(c) for c in rag.split_text("x" * 950, 100, 10)) == 100


def test_long_split_keeps_all_words():
    text = "One two. Three four! Five?\n\nSix seven.\n\n" + "longword" * 20
    parts = rag.split_long(text, 30)
    assert all(len(p) <= 30 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_html_main_text():
    title, body = feeds.html_text("<html><head><title>T &amp; U</title><script>x()</script></head><body><nav>menu</nav><div class='cookie-bar'>accept<p>x</p></div><p>One<br>two</p><!-- c --><form>f</form><div role=dialog>d</div><p>Three</p></body></html>")
    assert title == "T & U" and body.split("\n") == ["One", "two", "Three"]


def test_atom_and_rss(spark):
    atom = "<feed><entry><title>A</title><link href='https://x/1'/><updated>2024</updated><summary>s</summary><content>full</content></entry><entry><title>none</title></entry></feed>"
    rss = "<rss><channel><item><title>R</title><link>https://y</link><pubDate>d</pubDate><description>t</description></item></channel></rss>"
    out = {r["title"]: r for r in feeds.feed_items(spark.createDataFrame([(1, atom), (2, rss), (3, "<broken")], "id int, xml string")).collect()}
    assert set(out) == {"A", "R"} and out["A"]["content"] == "full" and out["A"]["item_url"] == "https://x/1" and out["R"]["published_at"] == "d"


def test_lock_lines(spark):
    lines = ['{"symbol":"eurusd","date":"2024-01-02","lock":true}', "GBPUSD;2024-01-02;1", "gbpusd;2024-01-02;0", "USDJPY;2024-01-02", "junk", '{"pair":"AUDUSD","day":"2024-01-03"}']
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    assert {(r["symbol"], r["locked"]) for r in feeds.lock_lines(df).collect()} == {("EURUSD", True), ("GBPUSD", False), ("USDJPY", True), ("AUDUSD", True)}


def test_rules_hit_inside_words_unless_told_otherwise(spark):
    df = spark.createDataFrame([("the federation moves forward",), ("rate hike by the fed",), ("nothing",)], "t string")
    loose = [r[0] for r in df.select(news.classify(F.col("t"), F.lit(""), F.lit(""))).collect()]
    strict = [r[0] for r in df.select(news.classify(F.col("t"), F.lit(""), F.lit(""), True)).collect()]
    assert loose == ["central_bank_signal", "central_bank_signal", "unknown"] and strict == ["unknown", "central_bank_signal", "unknown"]
    by_host = df.select(news.classify(F.lit("x"), F.lit(""), F.lit("https://www.ecb.europa.eu/p"))).first()[0]
    assert by_host == "central_bank_signal"


def test_insert_twice_adds_nothing(spark, tmp_path):
    rows = [("h1", "2024-01-02 00:00:00", "b"), ("h1", "2024-01-01 00:00:00", "a"), ("h2", "2024-01-01 00:00:00", "c")]
    df = spark.createDataFrame(rows, "content_hash string, fetched_at string, title string")
    path = str(tmp_path / "events")
    sinks.append_new(df, path)
    sinks.append_new(df, path)
    stored = spark.read.parquet(path).collect()
    assert sorted((r["content_hash"], r["title"]) for r in stored) == [("h1", "a"), ("h2", "c")]


def test_seeds_are_idempotent(spark):
    seeds = tables.seed_sources(spark)
    assert tables.missing_seeds(spark, seeds.limit(0)).count() == seeds.count() == 23
    assert tables.missing_seeds(spark, seeds).count() == 0
    assert reg.critical_entities(tables.seed_entities(spark)).count() == 6
    assert [r["entity_id"] for r in reg.list_entities(tables.seed_entities(spark), 0.9, topics=["oil"]).collect()] == ["opec"]


def test_sinks(spark, tmp_path):
    sig = spark.createDataFrame([("A", "H1", "2024-01-01 05:00:00", "BUY", 55.5)], "symbol string, timeframe string, ts string, direction string, confidence double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = sinks.signal_rows(sig, 100, 200)
    sinks.write_signals(rows, str(tmp_path / "s"))
    back = spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "s"))
    assert set(back.columns) == {*sinks.SPLIT_LAYOUT, "symbol", "timeframe"} and back.first()["date"] == "2024.01.01"
    sinks.write_signals(sinks.signal_rows(sig.limit(0), 1, 2, split_time=False), str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).first()[0] == "time;dir;sl;tp;comment"
    sinks.append_json_lines(sig, str(tmp_path / "j"))
    sinks.append_json_lines(sig, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert sinks.decimal_comma(spark.createDataFrame([(1.5, "x.y")], "a double, b string")).first() == ("1,5", "x.y")


def test_text_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "sub" / "b.md").write_text("three")
    (tmp_path / "c.bin").write_text("no")
    docs = feeds.text_documents(spark, str(tmp_path))
    assert sorted(r["content"] for r in docs.collect()) == ["one\ntwo", "three"]


def test_nearest_matches_brute_force_in_slices(spark, monkeypatch):
    monkeypatch.setattr(rag, "QUERY_SLICE", 2)
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(60, 8)), rng.normal(size=(7, 8))
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>").repartition(5)
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id bigint, embedding array<float>")
    got = {}
    for r in rag.nearest(vec, qs, 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(unit(q) @ unit(v).T), axis=1)[:, :4]
    assert {k: [x for _, x in sorted(d.items())] for k, d in got.items()} == {i: list(b) for i, b in enumerate(best)}


def test_history_fit_shortens_the_boundary(spark):
    rows = [("c", 0, "user", "a" * 400), ("c", 1, "assistant", "word " * 80), ("c", 2, "user", "b" * 100), ("d", 0, "user", "z" * 4000)]
    out = {(r["conv_id"], r["turn"]): r["content"] for r in mem.fit_history(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"), 100).collect()}
    assert out[("c", 2)] == "b" * 100 and out[("c", 1)].endswith("…") and ("c", 0) not in out
    assert out[("d", 0)].endswith("…") and len(out[("d", 0)]) == 369


def test_upsert_keeps_the_last_write(spark):
    s = "category string, key string, value string, timestamp int"
    old = spark.createDataFrame([("a", "k", "1", 1), ("a", "l", "1", 5)], s)
    new = spark.createDataFrame([("a", "k", "2", 2), ("a", "l", "0", 4)], s)
    assert {(r["key"], r["value"]) for r in mem.upsert(old, new, ["category", "key"], "timestamp").collect()} == {("k", "2"), ("l", "1")}


def test_small_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.fold(F.lit("Décédée ÎLE"))) == "decedee ile"
    assert one(tx.trim_to_tokens(F.lit("hello world again"), F.lit(3))) == "hello world…"
    assert one(tx.guess_language(F.lit("der Hund und die Katze"))) == "de" and one(tx.guess_language(F.lit(""))) == "fr"
    assert one(tx.host(F.lit("HTTPS://Www.X.org:80/a?b"))) == "www.x.org:80" and one(tx.host(F.lit("none"))) == ""
    assert one(tx.problem_domain(F.lit("Backtest ma stratégie forex"))) == "trading_strategy"
    assert one(tx.extract_urls(F.lit("a http://x.y b https://z http://x.y"))) == ["http://x.y", "https://z"]


def test_primary_without_id_is_not_detected_again(spark):
    from barlab.operators.news import make_events, to_cards

    schema = "entity_id string, entity_name string, source_id bigint, source_type string, source_url string, title string, content string, published_at string, fetched_at timestamp, item_url string"
    at = datetime(2024, 1, 1)
    rows = [("", "Iran", 1, "rss", "https://a.org/f", "Iran talks", "about Iran", "x", at, "https://a.org/1"), ("7", "Iran", 1, "rss", "https://a.org/f", "Iran talks", "about Iran", "x", at, "https://a.org/2")]
    cards = to_cards(make_events(spark.createDataFrame(rows, schema))).collect()
    got = {c["urls"][0]: [(e["entity_id"], e["name"]) for e in c["entities"]] for c in cards}
    assert [n for _, n in got["https://a.org/1"]].count("Iran") == 1
    assert got["https://a.org/2"][0] == ("7", "Iran")


def test_capitals_are_one_letter_each(spark):
    words = ["straße", "ŉ ﬁn ᾳ\u1fc6\n", "ɤ été", "", None, "plain"]
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(tx.capitals(F.col("w"))).collect()]
    assert got == ["STRAẞE", "ŉ ﬁN ᾼ\u1fc6\n", "ɤ ÉTÉ", "", None, "PLAIN"]
