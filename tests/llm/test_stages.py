"""The pipeline against a plain version of its stages, and stages on rows with clashing columns and repeated ids."""

import hashlib
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barlab.llm import decontaminate, mixing, near_dups, quality, substrings, wavelet
from tests.llm.test_filters import WORD, brute_items, changed, classes_by_hand, rule_counts


def prose(rng, n):
    return " ".join(f"w{rng.randint(0, 4000)}" for _ in range(n))


def test_mix_stage_keeps_sources_apart(spark):
    """Two sources of equal ids and sizes: each gets its own target, however the rows are dealt."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 1 + i % 3), s) for s in "xy" for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = {r.source: r.t for r in mixing.mix(df, known_by=True).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    seen = set()
    for parts in (1, 7):
        got = mixing.mixed(df.repartition(parts)).collect()
        words = Counter()
        for r in got:
            words[r.source] += len(r.text.split())
        assert words == want and abs(words["y"] - 2 * words["x"]) <= 6
        seen.add(hashlib.md5(repr(sorted(got)).encode()).hexdigest())
    assert len(seen) == 1


def test_mix_spreads_null_ids_and_cuts_the_edge_block_again(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(None, prose(rng, rng.randint(1, 9)), "a") for _ in range(900)] + [(1, "b " * 4000, "b")], "doc_id bigint, text string, source string")
    out = mixing.mix(df, weights=(1, 3), block_docs=10, max_blocks=2, known_by=True)
    got = {r.source: (r.t, r.target) for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()}
    assert abs(got["a"][0] - got["a"][1]) <= 9
    assert out.where("source = 'a' and taken > 0").count() > 1 and out.count() == 901


def test_clashing_columns_pass_untouched(spark):
    rng = random.Random(9)
    names = ["kept", "n_words", "text_", "copy", "head", "name", "source_key", "times", "of", "text_hash", "Base_Failed"]
    rows = [(i, prose(rng, 60), "s", *[f"{n}{i}" for n in names]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(1, rows[0][1])], "item_id bigint, text string")
    own = lambda out: {(r[0], *r[3:14]) for r in out.collect()}
    every = {(r[0], *r[3:]) for r in rows}
    for out, want in ((quality.passing(df, None), every), (near_dups.keep_one(df), every), (decontaminate.clean(df, items), {r for r in every if r[0]}), (mixing.mixed(df), every)):
        assert out.columns == df.columns and own(out) == want
    judged = quality.judge(df, None)
    assert judged.columns[:14] == df.columns and own(judged) == every


def test_forest_does_not_depend_on_the_order_of_repeated_ids(spark):
    rng = random.Random(11)
    junk = lambda: " ".join(rng.choice(["##", "$$$", "&&a"]) + prose(rng, 1) for _ in range(80))
    rows = [(i % 70, junk() if i % 3 == 0 else prose(rng, 90)) for i in range(210)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(70)], "doc_id bigint, quality int")
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len({quality.fit(df.repartition(p), labels).threshold for p in (1, 4, 9)}) == 1


def test_verdict_is_the_mean_path_length_over_all_trees(spark):
    """Scores of a grown forest, each tree walked down by hand."""
    rng = random.Random(13)
    texts = [prose(rng, 80) if i % 2 else " ".join(rng.choice(["#$", "a", "a"]) for _ in range(80)) for i in range(80)] + [prose(rng, 20_000), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    forest = quality.fit(df, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, quality int"), trees=20)
    got = {r.doc_id: r for r in quality.judge(df, forest).collect()}
    for i, text in enumerate(texts):
        stats = quality.statistics(pa.array([text]))
        x = quality.features(stats)[0]
        total = 0.0
        for root in forest.roots:
            node = root
            while forest.feature[node] >= 0:
                node = forest.left[node] + int(x[forest.feature[node]] >= forest.value[node])
            total += forest.depth[node]
        score = 2.0 ** (-total / len(forest.roots) / quality.mean_path(forest.sample))
        n, _, _, _, repeats = rule_counts(text)
        failed = n < 50 or 100 * repeats > 50 * n
        assert got[i].anomaly == pytest.approx(score) and got[i].base_failed == failed and got[i].kept == (not failed and score <= forest.threshold)


def test_token_files_of_another_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello world, it's  two\tspaces", None, "été\n\n" * 40, "x " * 20_000, "same", "same"]
    df = spark.createDataFrame([(None if t == "same" else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    tok = Tokenizer.from_file(path)
    got = Counter((r.doc_id, r.n_tokens) for r in wavelet.read_files(wavelet.write_files(df, path, 2)).collect())
    assert got == Counter((None if t == "same" else i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in enumerate(texts))
    with pytest.raises(ValueError, match="levels"):
        wavelet.write_files(df, path, 2, levels=8)


def test_what_is_left_of_texts(spark):
    shared = "é" * 30
    df = spark.createDataFrame([(1, "ab " + shared), (2, shared + " cd"), (3, "alone"), (4, None)], "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.changed) for r in substrings.remove_repeats(df, length=20).collect()}
    assert got == {1: ("ab ", True), 2: (" cd", True), 3: ("alone", False), 4: ("", False)}


def shard_by_hand(doc_id, shards):
    unit = lambda s: (int(hashlib.md5(f"{'' if doc_id is None else doc_id}:{s}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    return min(range(shards), key=lambda s: (-math.log(unit(s)), s))


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    rng = random.Random(15)
    items = [(i, prose(rng, 30)) for i in range(4)]
    docs = []
    for i in range(90):
        words = prose(rng, rng.randint(55, 120)).split()
        docs.append((3 * i, " ".join(words)))
        if i % 3 == 0:
            docs.append((3 * i + 1, " ".join(changed(rng, words, 0.02))))
        if i % 7 == 0:
            docs.append((3 * i + 2, " ".join(words)))
    docs += [(1000 + i, prose(rng, 40) + " " + items[i % 4][1] + " " + prose(rng, 40)) for i in range(8)]
    docs += [(2000 + i, t) for i, t in enumerate([None, "", "short text", "again and again " * 60, "\n" * 500])]
    rows = [(d, t, "en", f"s{i % 3}" if i % 10 else None, len(t or "")) for i, (d, t) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    good = []
    for d, t in docs:
        n, _, _, _, repeats = rule_counts(t)
        if not (n < 50 or 100 * repeats > 50 * n):
            good.append((d, t))
    heads = sorted({c for _, c in classes_by_hand(good)})
    single = [(d, t) for d, t in good if d in heads]
    bad = {d for d, _ in brute_items(single, items)}
    clean = {d: t for d, t in single if d not in bad}
    source = {r[0]: r[3] for r in rows}

    stages, frame = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        stages[name] = frame.collect()
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        frame = spark.createDataFrame(stages[name], frame.schema)
    assert sorted(r.doc_id for r in stages["quality_rules"]) == sorted(d for d, _ in good)
    assert sorted(r.doc_id for r in stages["near_dedup"]) == heads
    assert sorted(r.doc_id for r in stages["decontamination"]) == sorted(clean)
    taken = Counter(r.doc_id for r in stages["mix_sources"])
    assert taken.keys() <= clean.keys() and max(taken.values()) <= 3
    size, words = Counter(), Counter()
    for d, t in clean.items():
        size[source[d]] += len(WORD.findall(t))
        words[source[d]] += taken[d] * len(WORD.findall(t))
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    level, capped = 0.0, set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and level * weight[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert abs(words[s] - (3 * size[s] if s in capped else level * weight[s])) <= 120

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == taken
    assert all(r.shard == shard_by_hand(r.doc_id, 24) and r.grown_shard == shard_by_hand(r.doc_id, 25) for r in out)
    assert Counter((r.shard, r.slot) for r in out) == Counter((s, i) for s, n in Counter(r.shard for r in out).items() for i in range(n))
