"""Registered queries of this subpackage: one per operator, each over its whole table, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm import audit, chat, decontaminate, licenses, mixing, near_dups, pages, private_data, quality, sharding, spelling, substrings, wavelet
from barlab.llm.audit_sql import AUDIT_SQL
from barlab.llm.frames import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Arrow batches are handled whole by a Python worker: bound the rows, long texts are cut in the task
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register()
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and rule counts of every document."""
    docs = table(spark, sf_dir, "documents")
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, forest, keep=["doc_id"])


@register()
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dups.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_texts")


def _nibble_table() -> list[int]:
    """CRC-32 remainders of the 16 half bytes, for SQL that goes through a text's hex digits."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


_BITS = lambda salt: f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || {salt}), 1, 12))::BIGINT"
_TOP = lambda n: f"list_aggregate(list_transform(range(0, {n}), lambda s: {{'b': {_BITS('s')}, 's': -s}}), 'max').s * -1"
SHARDING_SQL = f"""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, length(h) AS l, list_transform(string_split(h, ''), lambda v: (strpos('0123456789ABCDEF', v) - 1)::BIGINT) AS x FROM h),
o AS (SELECT doc_id, l // 2 + 8 AS size, list_prepend(4294967295::BIGINT, list_transform(range(0, l), lambda i: x[(i // 2) * 2 + 2 - i % 2])) AS y FROM n),
c AS (SELECT doc_id, size::BIGINT AS size, xor(4294967295::BIGINT, list_reduce(y, lambda c, v: xor(c >> 4, {_nibble_table()}[(xor(c, v) & 15) + 1]::BIGINT))) AS text_crc32,
  ({_TOP(24)})::INTEGER AS shard, ({_TOP(25)})::INTEGER AS grown_shard FROM o), b AS (SELECT *, {_BITS("'block:' || text_crc32")} >> 32 AS block FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM b"""


@register(SHARDING_SQL)
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among 24 equal shards, and its shard among 25."""
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * 24, [1.0] * 25)


@register()
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document, and where its copies go."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@register()
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it holds a passage."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "hamming", "similarity").distinct()


@register()
def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's token ids, read back from the wavelet files."""
    import public_tokenizers

    files = wavelet.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return wavelet.read_files(files)


CHAT_SQL = r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) AS q(t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars FROM r GROUP BY conv_id"""


@register(CHAT_SQL)
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one that quotes the control strings, read back from the formatted texts."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoted = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(quoted).alias("text"))
    return chat.read_back(written(chat.format_records(chat.records_of(rows.unionByName(own)))))


@register()
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document."""
    return licenses.license_matches(table(spark, sf_dir, "documents"))


@register()
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 400-byte strings that occur elsewhere."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=400)


@register()
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages"))


@register(AUDIT_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every filter removes at its step in each of the 120 orders, for every source."""
    return audit.audit(audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SPELLING_SQL = f"""WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
k AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS h FROM r WHERE length(run) >= 5 GROUP BY id, run),
x AS (SELECT run, c, length(h) AS l, list_transform(string_split(h, ''), lambda v: (strpos('0123456789ABCDEF', v) - 1)::BIGINT) AS x FROM k),
y AS (SELECT run, c, list_prepend(4294967295::BIGINT, list_transform(range(0, l), lambda i: x[(i // 2) * 2 + 2 - i % 2])) AS y FROM x),
z AS (SELECT run, c, xor(4294967295::BIGINT, list_reduce(y, lambda a, v: xor(a >> 4, {_nibble_table()}[(xor(a, v) & 15) + 1]::BIGINT))) AS h FROM y),
e AS (SELECT CASE WHEN h % 97 = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, c FROM z),
w AS (SELECT word, sum(c)::BIGINT AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w), d AS (SELECT word, n, p, word[:p - 1] || word[p + 1:] AS cut FROM p),
near AS (SELECT d.word, w.word AS other FROM d JOIN w ON d.cut = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.cut = w.word
  UNION SELECT a.word, b.word FROM d a JOIN d b ON a.cut = b.cut AND a.p = b.p AND a.word <> b.word),
b AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-w.n, other)) AS best, max(w.n) AS best_n FROM near JOIN w ON near.other = w.word GROUP BY near.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)),
t AS (SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL),
m AS (SELECT t.word, t.root FROM t JOIN f ON t.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, m.root FROM f JOIN m USING (word)"""


@register(SPELLING_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word, the words one edit away, and the form and root that it is a variant of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@register()
def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: by form, and by contexts learnt from what has a form."""
    return private_data.find(table(spark, sf_dir, "documents"))
