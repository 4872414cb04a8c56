"""Personal data: base forms against plain Python, contexts on planted identifiers, odd input."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from barlab.llm import private_data

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [None, "", " \n\t ", "a", "a@b.c@d.e.f_x@y.zz", "1.2.3.4.5.6.7.8 256.1.1.1.1 001.02.3.0004", "+1 (743) 555-3824, +12345678 +1 2", "4539 1488-0343 6467 x 4539148803436467123",
       "ü a@b.de é 10.0.0.1 +49 (30) 1234567 😀 z@y.io", "same 1.1.1.1", "same 1.1.1.1", "9" * 5000 + " " + "a.b-c@d.e" * 300, "@ .@. +( +)", "x" * 30000 + "@y.z"]


def luhn(digits):
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def plain_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def checked(spark, rows, **options):
    got = private_data.find(spark.createDataFrame(rows, "doc_id bigint, text string"), **options).collect()
    want = sorted((str(i), digest(plain_spans(t)), *[sum(s[0] == k for s in plain_spans(t)) for k in FORMS]) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    return got


def test_base_forms_match_plain_python_on_odd_texts(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("a1.@-+ (4)5_") for _ in range(rng.randint(5, 400))) for _ in range(150)]
    texts += [" ".join(rng.choice(["ab", "1.2.3.4", "4111 1111 1111 1111", "x@y.zz", "+1 555 555 5555"]) for _ in range(20_000))]
    got = checked(spark, list(enumerate(texts)))
    assert all(r.n_added == 0 or r.spans for r in got)


def test_repeated_rows_null_ids_and_other_columns(spark):
    rows = [(None, "a@b.cc"), (None, "a@b.cc"), (None, "1.1.1.1"), (7, "a@b.cc"), (7, None)]
    checked(spark, rows)
    wide = spark.createDataFrame([(1, "a@b.cc", "x", 2)], "doc_id bigint, text string, masked string, th int")
    assert private_data.find(wide).first().spans == "email:0:6"
    assert private_data.find(wide.where("false")).count() == 0


def planted(rng, n=60):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    rows, hidden = [], {}
    for i in range(n):
        lead = prose(rng.randint(3, 12)) + " "
        if i % 5 == 4:
            name = f"user{i:03d}x"
            rows.append((i, f"{lead}write to mailbox: {name} any time {prose(6)}"))
            hidden[i] = (len(lead) + len("write to mailbox: "), len(lead) + len("write to mailbox: ") + len(name))
        else:
            rows.append((i, f"{lead}write to mailbox: p{i}@host{i}.org any time {prose(6)}"))
    # a context in which seeds, but mostly ordinary words stand, and numbers that stand in no context of seeds
    rows += [(100 + i, f"{prose(4)} talk about {word() if i % 6 else f'q{i}@r.org'} now {prose(4)} talk about item{i:04d} then {prose(3)} in the year 2{i:04d} we {prose(3)}") for i in range(60)]
    return rows, hidden


@pytest.mark.parametrize("parts", [1, 5])
def test_contexts_of_seeds_find_identifiers_without_a_form(spark, parts):
    rows, hidden = planted(random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    got = {r.doc_id: r for r in private_data.find(docs).collect()}
    for i, text in rows:
        spans = [s.split(":") for s in got[i].spans.split(",") if s]
        added = [(k, int(a), int(b)) for k, a, b in spans if (k, int(a), int(b)) not in plain_spans(text)]
        assert added == ([("email", *hidden[i])] if i in hidden else []), (i, text)


def test_found_values_speak_for_further_contexts(spark):
    """Identifiers found in one context are evidence for another one, in which too few seeds stand by themselves."""
    rows = [(i, f"lorem{'x' * (i % 7)} ipsum send to box: p{i}@q{i}.org at once dolor") for i in range(12)]
    rows += [(20 + i, f"amet send to box: k{i}0000 at once elit") for i in range(8)]
    rows += [(40 + i, f"sed do known under code {x} with us magna") for i, x in enumerate([f"k{i}0000" for i in range(8)] + ["a@b.org", "c@d.org", "e@f.org", "z90909"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one = {r.doc_id: r.n_added for r in private_data.find(docs, rounds=1).collect()}
    more = {r.doc_id: r.n_added for r in private_data.find(docs, rounds=4).collect()}
    assert all(one[20 + i] == 1 for i in range(8)) and one[51] == 0
    assert all(more[20 + i] == 1 for i in range(8)) and more[51] == 1


def test_prefix_sums_of_long_arrays(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(1000)).alias("a"))
    got = df.select(private_data.before_each(F.transform("a", lambda x: x.cast("int"))).alias("s")).first().s
    assert got == [sum(range(1, i)) for i in range(1, 1001)]


def test_texts_are_not_searched_for_contexts_that_cannot_be_accepted(spark, monkeypatch):
    """As many numbers as seeds in a context speak against it whatever else stands there; every place of the limits counts."""
    asked, real = [], private_data.bit_map
    monkeypatch.setattr(private_data, "bit_map", lambda *a: asked.append(1) or real(*a))
    even = [(i, f"lorem send to box: {f'p{i}@q{i}.org' if i % 2 else f'k{i}00000'} at once dolor") for i in range(8)]
    assert sum(r.n_added for r in private_data.find(spark.createDataFrame(even, "doc_id bigint, text string")).collect()) == 0 and not asked
    edges = [(s, v, "email" if v < e else "ip" if v < e + i else None) for s, (e, i, o) in enumerate((e, i, o) for e in range(1, 6) for i in range(3) for o in range(4)) for v in range(e + i + o)]
    got = {r.pattern: r for r in private_data.limits(spark.createDataFrame(edges, "pattern int, value int, kind string"), 0.6, 0.5).collect()}
    for s, (e, i, o) in enumerate((e, i, o) for e in range(1, 6) for i in range(3) for o in range(4)):
        share = lambda words, gain: (max(e, i) + gain) / (e + i + words + max(gain, 0.5 * o) + 1)
        most, first = (sum(share(w, g) >= 0.6 - 1e-9 for w in range(99)) - 1 for g in (o, 0))
        assert (s in got) == (most >= 0) and (s not in got or got[s].most == most and max(got[s]["first"], -1) == first)
