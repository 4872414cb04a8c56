"""Spelling variants and the filter audit against plain Python."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from barlab.llm import audit, spelling

ODD = [None, "", " \n\t ", "a", "ABCDE abcde", "x" * 3000 + " " + "x" * 2999, "éèêëà ÉÈÊËÀ éèêëa"]


def plain_vocabulary(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain_forms(vocab):
    near = {w: [v for v in vocab if one_edit(w, v)] for w in vocab}
    form = {}
    for w in vocab:
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * vocab[w] else None
    root = {}
    for w in vocab:
        r = w
        while form[r] is not None:
            r = form[r]
        root[w] = r
    return sorted((w, vocab[w], len(near[w]), str(form[w]), str(form[w] and vocab[form[w]]), root[w]) for w in vocab)


def word_rows(rng, n=40):
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 7))) for _ in range(30)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "abababab"]

    def vary(w):
        k, i, c = rng.randint(0, 5), rng.randrange(len(w)), rng.choice("abcé")
        return [w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]][k] if k < 3 else w
    return [(i, " ".join(vary(rng.choice(base)) for _ in range(rng.randint(0, 120)))) for i in range(n)]


@pytest.mark.parametrize("shard_words", [20_000, 7])
def test_variants_match_plain_python(spark, shard_words):
    rows = word_rows(random.Random(5)) + [(100 + i, t) for i, t in enumerate(ODD * 3)] + [(None, "abcde abcde abcde"), (3, "caféé " * 5), (3, "caféé " * 5)]
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string"), shard_words=shard_words).collect()
    want = plain_forms(plain_vocabulary(rows))
    assert sorted((r.word, r.n, r.n_near, str(r.form), str(r.form_n), r.root) for r in got) == want


def test_variants_of_an_empty_table_and_of_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.spelling_variants(none).count() == 0
    wide = spark.createDataFrame([(1, "abcde abcde abcde abcdf", 4, "x")], "doc_id bigint, text string, n int, word string")
    assert [r.asDict() for r in spelling.spelling_variants(wide).collect()] == [{"word": "abcde", "n": 3, "n_near": 0, "form": None, "form_n": None, "root": "abcde"}]


def test_a_half_that_most_words_share(spark):
    """Wide intervals: letters are tried, not read off."""
    rng = random.Random(6)
    words = sorted({"abcdef" + "".join(rng.choice("ghij") for _ in range(6)) for _ in range(600)})
    q, w = spelling.search_shard(words, words, np.full(len(words), 6))
    got = {(words[a], words[b]) for a, b in zip(q, w)}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    cells = Counter()
    for i, text, part in rows:
        text = text or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
                 "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > first[text]}
        cells[(part or "", frozenset(f for f in fails if fails[f]), i in good, i in toxic)] += 1
    out, shapley = {}, Counter()
    for part in {c[0] for c in cells}:
        own = {c[1:]: n for c, n in cells.items() if c[0] == part}
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                before = set(order[:s])
                cut = [(g, t, n) for (m, g, t), n in own.items() if f in m and not m & before]
                removed = sum(n for *_, n in cut)
                shapley[part, f] += removed
                out[part, "".join(order), s + 1] = (sum(n for (m, *_), n in own.items() if not m & (before | {f})), removed, sum(n for (m, *_), n in own.items() if f in m and m & before),
                                                   sum(n for (m, *_), n in own.items() if m == {f}), sum(n for g, _, n in cut if g), sum(n for _, t, n in cut if t))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_matches_every_order_walked(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["aa", "Bb", "c#", "dd", "ee", "ff", "XYZ", "ü"]) + str(rng.randint(0, 60))
    texts = [" ".join(word() for _ in range(rng.randint(0, 110))) for _ in range(25)] + [None, "", " \t\n", "one", "y " * 20_000]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for _ in range(150)]
    rows += [(5, "same same", "s1"), (5, "same same", "s1"), (4, "same same", "s2"), (None, "same same", "s1")]
    labels = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    want = plain_audit(rows, labels)
    for parts in (1, 6):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumnRenamed("x", "y").repartition(parts)
        docs = docs.selectExpr("*", "1 AS n", "'z' AS part", "2 AS good", "3 AS quality")
        got = audit.audit(audit.failures(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))).collect()
        assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == want


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.audit(audit.failures(none, labels)).count() == 0
    some = spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, source string")
    got = audit.audit(audit.failures(some, labels)).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and {r.kept for r in got if r.filter_order.startswith("A")} == {0}


def test_intervals_hold_every_order_once():
    spans = audit.removal_intervals(5)
    for mask in range(1, 32):
        hits = Counter(r for m, _, _, a, b in spans if m == mask for r in range(a, b))
        assert hits == Counter(range(120))
