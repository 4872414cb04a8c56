"""Quality rules, license scan, decontamination and near duplicates against brute force and on odd input."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barlab.llm import arrays as A
from barlab.llm import decontaminate, frames, licenses, near_dups, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "a b c d", "x " * 3000, "\n\n#|# éß\n", "same text here for all of us", "same text here for all of us"]


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def prose(rng, n):
    return " ".join(rng.choice(["ba", "ko", "li", "mu", "ne", "po", "ri", "sa", "tu", "vo"]) + rng.choice(["la", "n", "st", "re"]) for _ in range(n))


def rule_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(hit)


def test_rule_statistics_match_a_plain_count():
    rng = random.Random(1)
    texts = ODD + ["\n".join(prose(rng, rng.randint(0, 9)) for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["längst # da\nlängst # da\nno"]
    got = quality.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in quality.COUNTS) == rule_counts(t)


def test_forest_tells_held_out_junk(spark):
    rng = random.Random(2)
    good = [prose(rng, rng.randint(60, 200)) for _ in range(300)]
    bad = [" ".join(w + "***" for w in prose(rng, 80).split()) for _ in range(60)]
    rows = [(i, t, i) for i, t in enumerate(good + bad)] + [(900 + i, t, 0) for i, t in enumerate(ODD)] + [(None, good[0], 1)]
    docs = frame(spark, rows, "doc_id bigint, text string, kept int")  # a column of the input has a result's name
    labels = frame(spark, [(i, int(i < 300), 5) for i in range(0, 360, 2)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    forest = quality.fit(docs, labels)
    out = quality.judge(docs, forest, keep=["doc_id"]).toPandas()
    held = out[(out.doc_id < 360) & (out.doc_id % 2 == 1)]
    assert held[held.doc_id < 300].kept.mean() > 0.97 and held[held.doc_id >= 300].kept.mean() < 0.03
    assert out[out.doc_id >= 900].base_failed.all() and len(out) == len(rows)
    assert quality.judge(docs, None).where("kept").count() > 0
    assert quality.judge(docs.where("false"), quality.fit(docs.where("false"), labels.where("false"))).count() == 0


def test_license_spans(spark):
    rng = random.Random(3)
    name, notice = next(t for t in licenses.TEMPLATES if t[0] == "MIT text")
    words = notice.split()
    del words[10], words[30]
    texts = [prose(rng, 40) + "é. " + notice.upper() + " " + prose(rng, 30), "Released under the MIT License. x Released under the MIT License.", " ".join(words), prose(rng, 200), *ODD]
    out = licenses.license_matches(frame(spark, [(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, template string")).toPandas()
    assert {(r.doc_id, r.template) for r in out.itertuples()} == {(0, name), (1, "MIT notice"), (2, name)}
    whole = out[out.doc_id == 0].iloc[0]
    assert texts[0][whole.span_start : whole.span_end] == notice.upper().rstrip(".") and whole.coverage == 1
    assert len(out[out.doc_id == 1]) == 2 and 0.9 < out[out.doc_id == 2].coverage.iloc[0] < 1


def test_every_template_is_told_from_the_others(spark):
    rng = random.Random(14)
    docs, want = [], {}
    for i, (name, text) in enumerate(t for t in licenses.TEMPLATES if t[0] != "Unlicense opening"):
        words = text.split()
        docs.append((2 * i, f"{prose(rng, 30)}\n{text}\n{prose(rng, 30)}"))
        want[2 * i] = name
        if len(words) >= 12:
            del words[len(words) // 3]
            docs.append((2 * i + 1, prose(rng, 5) + " " + " ".join(words)))
            want[2 * i + 1] = name
    docs += [(900, "SPDX-License-Identifier: MIT-Modern-Variant"), (901, "SPDX-License-Identifier: GPL-2.0+"), (902, "SPDX-License-Identifier: MIT."), (903, "This is free and unencumbered software released into the public domain.")]
    out = licenses.license_matches(frame(spark, docs)).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r.template)
    assert got == {i: [n] for i, n in want.items()} | {902: ["SPDX MIT"], 903: ["Unlicense opening"]}
    long = prose(rng, 20_000) + " Licensed under CC BY-NC 4.0. " + prose(rng, 3)
    assert [(r.template, long[r.span_start : r.span_end]) for r in licenses.license_matches(frame(spark, [(1, long)])).collect()] == [("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0")]


def test_banded_alignment_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(30):
        a = [rng.randint(0, 5) for _ in range(rng.randint(1, 25))]
        b = [rng.randint(0, 5) for _ in range(rng.randint(1, 25))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        pairs = licenses.banded(np.array(a), np.array(b), 0, 40)
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)


def test_winnowing_keeps_a_fingerprint_in_every_window():
    rng = random.Random(5)
    value = np.array([rng.randint(0, 9) for _ in range(200)], dtype=np.uint64)
    doc = np.sort(np.array([rng.randint(0, 5) for _ in range(200)]))
    for window in (1, 2, 5):
        got = set(licenses.winnow(value, doc, window).tolist())
        want = set()
        for d in range(6):
            at = np.flatnonzero(doc == d)
            for i in range(max(1, len(at) - window + 1)):
                part = at[i : i + window]
                if len(part):
                    want.add(int(part[np.argmin(value[part])]))
        assert got == want


def brute_items(docs, items, k=5):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])
    out = {}
    for d, t in docs:
        w = cut(t)
        for i, q in items:
            q = cut(q)
            if not q or not w:
                continue
            a, best = grams(q), 0.0
            for s in range(max(1, len(w) - len(q) + 1)):
                b = grams(w[s : s + len(q)])
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= 0.8:
                out[d, i] = best
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(12, 60))) for i in range(12)] + [(50, "two words"), (51, None), (52, ""), (53, items_text := "ba ba ba ba ba ba ba ba")]
    docs = []
    for i in range(40):
        words = items[i % 12][1].split()
        for _ in range(i // 12):
            words[rng.randrange(len(words))] = "zz"
        if i % 5 == 0:
            words.insert(len(words) // 2, "extra")
        docs.append((i, prose(rng, rng.randint(0, 80)) + ". " + " ".join(words).title() + ", " + prose(rng, rng.randint(0, 50))))
    docs += [(100 + i, t) for i, t in enumerate(ODD)] + [(200, "Two, words"), (None, items[0][1]), (201, items_text + " ba ba")]
    found = decontaminate.contaminated(frame(spark, [(*r, 1) for r in docs], "doc_id bigint, text string, item_id int"), frame(spark, items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    want = brute_items(docs, items)
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)
    clean = decontaminate.clean(frame(spark, docs), frame(spark, items, "item_id bigint, text string"))
    assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(str(d) for d, _ in docs if not any(p[0] == d for p in want))
    assert decontaminate.contaminated(frame(spark, docs), frame(spark, [], "item_id bigint, text string")).count() == 0
    assert decontaminate.contaminated(frame(spark, []), frame(spark, items, "item_id bigint, text string")).count() == 0


def test_simhash_blocks_cover_every_bit(spark):
    bits = spark.range(1).select(F.lit(-1).cast("bigint").alias("x")).select(decontaminate.blocks(F.col("x"), 20).alias("b")).first()["b"]
    assert len(bits) == 21 and sum(int(b["bits"]).bit_count() for b in bits) == 64


def edit_distance(a, b, most):
    """By rows of the whole matrix; stops where no cell of a row can lead to ``most`` or less."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
        if min(row) > most:
            return most + 1
    return row[-1]


def linked(a, b, least=0.8):
    most = int(max(len(a), len(b)) * (1 - least) + 1e-9)
    if not a or not b or max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values()) > most:
        return False
    return edit_distance(a, b, most) <= most


def classes_by_hand(docs, least=0.8):
    first = {}
    for d, t in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    words = {d: WORD.findall(t) for t, d in first.items()}
    parent = {d: d for d in words}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(words)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = root(a), root(b)
            if x != y and linked(words[a], words[b], least):
                parent[max(x, y)] = min(x, y)
    return Counter((d, root(first[t or ""]) if (t or "") in first else None) for d, t in docs)


def test_banded_edit_distance_matches_the_whole_matrix():
    rng = random.Random(1)
    for _ in range(4000):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))] if rng.random() < 0.4 else [x for x in a if rng.random() < 0.8]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.randint(0, 3))
        most, true = rng.randint(0, 8), edit_distance(a, b, 99)
        got = near_dups.edits(a, b, most)
        assert got == true if true <= most else got > most


def changed(rng, words, rate):
    """Words substituted, deleted and inserted at a rate."""
    out = []
    for w in words:
        kind = rng.random()
        if kind >= rate:
            out.append(w)
        elif kind < rate * 0.6:
            out.append(f"n{rng.randint(0, 10**6)}")
        elif kind < rate * 0.8:
            out += [w, f"n{rng.randint(0, 10**6)}"]
    return out


@pytest.mark.parametrize("rate,least", [(0.01, 0.99), (0.03, 0.97), (0.05, 0.95), (0.1, 0.9)])
def test_recall_of_pairs_by_edit_rate(spark, rate, least):
    """Pairs of a text and one edited copy: no third text helps a missed pair."""
    rng, docs = random.Random(int(1000 * rate)), []
    for i in range(150):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 400))]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed(rng, words, rate)))]
    got = {r.doc_id: r.class_id for r in near_dups.near_classes(frame(spark, docs)).collect()}
    assert all(got[2 * i] == 2 * i for i in range(150))  # and no text of another pair
    assert np.mean([got[2 * i + 1] == 2 * i for i in range(150)]) >= least


def test_a_big_group_of_half_alike_texts_is_split(spark):
    """Texts that share half of their words in one order are candidates everywhere, yet only edited copies link."""
    rng = random.Random(12)
    frame_words, docs = [f"w{i}" for i in range(150)], []
    for i in range(120):
        own = [w if rng.random() < 0.62 else f"o{rng.randint(0, 10**6)}" for w in frame_words]
        docs.append((2 * i, " ".join(own)))
        docs.append((2 * i + 1, " ".join(changed(rng, own, 0.02))))
    df = frame(spark, docs).repartition(3)
    assert Counter((r.doc_id, r.class_id) for r in near_dups.near_classes(df, small=3, rounds=1).collect()) == classes_by_hand(docs)


def test_near_classes_match_brute_force(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(120)] for _ in range(12)]
    docs = [(i, t) for i, t in enumerate(ODD)]
    for i in range(90):
        words = list(base[rng.randrange(12)] if i > 40 else base[0])
        for _ in range(rng.choice([0, 1, 1, 2, 12, 20])):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
        if rng.random() < 0.2:
            words = words[: rng.randint(2, 118)]
        docs.append((1000 + i, " ".join(words)))
    docs += [(None, docs[20][1]), (None, "alone"), (None, "alone"), (1005, docs[14][1])]
    df = frame(spark, [(*d, 3) for d in docs], "doc_id bigint, text string, copy int").repartition(4)
    got = near_dups.near_classes(df, sketches=100).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == classes_by_hand(docs)
    kept = near_dups.keep_one(df, sketches=100)
    assert kept.columns == ["doc_id", "text", "copy"]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in classes_by_hand(docs) if c is not None}) and ids.count(None) == 1
    assert near_dups.near_classes(df.where("false")).count() == 0


def test_links_between_texts_that_are_not_the_first_pivots(spark):
    rng = random.Random(5)  # two stars of texts half alike, joined by one pair of texts on their rims
    a = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    b = a[:10] + [f"v{rng.randint(0, 10**6)}" for _ in range(90)] + a[100:]
    change = lambda w, i, x: w[:i] + [x] + w[i + 1 :]
    star = [a, change(a, 150, "x"), change(b[:42] + a[42:], 100, "y"), b, change(b, 150, "z"), change(b[:58] + a[58:], 110, "u")]
    docs = [(i, " ".join(w)) for i, w in enumerate(star)]
    assert {c for _, c in classes_by_hand(docs)} == {0} and {c for _, c in classes_by_hand(docs[:2] + docs[3:5])} == {0, 3}
    assert Counter((r.doc_id, r.class_id) for r in near_dups.near_classes(frame(spark, docs), sketches=60).collect()) == classes_by_hand(docs)


def test_texts_are_searched_whatever_their_ids(spark):
    rng = random.Random(20)
    text = [[f"w{rng.randint(0, 10**6)}" for _ in range(100)] for _ in range(4)]
    near = lambda i, n=1: " ".join(text[i][:50] + [f"n{n}"] + text[i][51:])
    whole = [" ".join(t) for t in text]
    docs = [(1, whole[0]), (1, whole[1]), (2, near(0)), (3, near(1)), (None, whole[2]), (None, near(2)), (None, near(2)), (None, whole[3]), (4, near(3)), (None, near(3, 2))]
    got = near_dups.near_classes(frame(spark, docs)).collect()
    family = {t: i for i in range(4) for t in (whole[i], near(i), near(i, 2))}
    copies = {hashlib.md5(t.encode()).digest(): i for t, i in family.items()}
    assert Counter((r.doc_id, r.class_id, copies[bytes(r.copy)]) for r in got) == Counter((d, {0: 1, 1: 1, 2: None, 3: 4}[family[t]], family[t]) for d, t in docs)
    assert len({(copies[bytes(r.copy)], bytes(r.class_copy)) for r in got}) == len({bytes(r.class_copy) for r in got}) == 4
    kept = near_dups.keep_one(frame(spark, docs)).collect()
    assert sorted((family[r.text], r.doc_id) for r in kept) == sorted([(0, 1), (1, 1), (2, None), (3, 4)])


def test_chains_of_revisions_are_one_class(spark):
    rng = random.Random(19)
    words, docs = [f"w{rng.randint(0, 10**6)}" for _ in range(150)], []
    for i in range(40):
        at = rng.randrange(145)
        words = words[:at] + [f"c{i}x{j}" for j in range(5)] + words[at + 5 :]
        docs.append((i, " ".join(words)))
    assert Counter((r.doc_id, r.class_id) for r in near_dups.near_classes(frame(spark, docs)).collect()) == classes_by_hand(docs)


def test_copied_passages_inside_a_text_count(spark):
    a = " ".join(f"p{i}" for i in range(60))
    docs = [(1, a), (2, a + " " + a)]
    assert {r.class_id for r in near_dups.near_classes(frame(spark, docs)).collect()} == {1, 2}


def test_words_do_not_cross_documents():
    data, offsets = A.texts_of(pa.array(["ab", "cd e", None, "f"]))
    start, end, doc = A.word_spans(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(start, end)] == [b"ab", b"cd", b"e", b"f"] and doc.tolist() == [0, 1, 1, 3]


def test_short_texts_that_share_no_run_of_three_words_link(spark):
    rng, docs = random.Random(31), []  # one edit in the middle of few words: no k-mer stays
    for i in range(60):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 9))]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: len(words) // 2] + ["x"] + words[len(words) // 2 + 1 :]))]
    docs += [(900, "a b c d"), (901, "a b c d e"), (902, "a b c"), (903, "q r s t u v w x y z"), (904, "q r 1 t u v w 2 y z")]
    want = classes_by_hand(docs)
    assert (901, 900) in want and (904, 903) in want and (902, 902) in want
    assert Counter((r.doc_id, r.class_id) for r in near_dups.near_classes(frame(spark, docs)).collect()) == want


def test_every_pair_of_a_big_bucket_is_compared(spark):
    """Texts with one passage and openings of their own share all buckets; few of the pairs link, and no pivot is one of them."""
    rng = random.Random(32)
    passage, docs = [f"p{i}" for i in range(150)], [(0, " ".join(f"p{i}" for i in range(150)))]
    for i in range(70):
        own = [f"o{rng.randint(0, 10**6)}" for _ in range(60)]
        near = [w if rng.random() < 0.5 else f"e{rng.randint(0, 10**6)}" for w in own]
        docs += [(2 * i + 2, " ".join(own + passage)), (2 * i + 3, " ".join(near + passage))]
    want = classes_by_hand(docs)
    assert len({c for _, c in want}) == 71
    df = frame(spark, docs).repartition(3)
    for options in ({}, {"small": 10}):
        got = near_dups.near_classes(df, **options).collect()
        assert Counter((r.doc_id, r.class_id) for r in got) == want and {r.n_texts for r in got} == {1, 2}


def test_an_edit_changes_two_parities_and_repeated_words_do_not_cancel():
    rng = random.Random(41)
    bits = lambda *texts: near_dups.parities(*near_dups.words_of(pa.array([" ".join(t) for t in texts])))
    for _ in range(300):
        words = [rng.choice("abcde") for _ in range(rng.randint(1, 60))]
        at = rng.randrange(len(words))
        one = words[:at] + rng.choice([[], ["z"], [words[at], "a"]]) + words[at + 1 :]
        if one:
            a, b = bits(words, one)
            assert (a != b).sum() <= 2
    a, b = bits(["a"] * 60 + ["x", "y"], ["b"] * 60 + ["x", "y"])
    assert (a != b).sum() > 100


def test_components_do_not_join_all_edges_in_every_round(spark, monkeypatch):
    rng = random.Random(42)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(6000)] + [(1000 + i, 1001 + i) for i in range(200)]
    edges += [(2000 + rng.randrange(100), 2100 + rng.randrange(100)) for _ in range(60)] + [(5, 5), (3, 9), (9, 3)]
    parent = {v: v for e in edges for v in e if e[0] != e[1]}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x, y in edges:
        if x != y and root(x) != root(y):
            parent[max(root(x), root(y))] = min(root(x), root(y))
    df = frame(spark, edges, "a bigint, b bigint")
    joined, join = [], type(df).join

    def counted(self, *args, **kwargs):
        out = join(self, *args, **kwargs)
        joined.append(out.count())
        return out

    monkeypatch.setattr(type(df), "join", counted)
    got = {r.id: r.component for r in frames.components(df, "a", "b").collect()}
    assert got == {v: root(v) for v in parent}
    pairs = len({(min(e), max(e)) for e in edges if e[0] != e[1]})
    assert sum(joined) <= 2 * pairs + 20 * len(parent)
    assert frames.components(df.where("a < 0"), "a", "b").count() == 0
