"""Substring removal, chat formatting, page extraction, sharding, mixing and token files against brute force."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.llm import chat, mixing, pages, sharding, substrings, wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats_by_hand(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length,widths", [(40, (16, 1)), (24, (4, 1)), (50, (1,))])
def test_removed_substrings_match_brute_force(spark, length, widths):
    rng = random.Random(length)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 160))) for _ in range(20)]
    texts = []
    for _ in range(80):
        t = "".join(rng.choice(base)[rng.randint(0, 20) : rng.randint(20, 160)] for _ in range(rng.randint(0, 5)))
        texts.append(rng.choice(["", "a" * rng.randint(0, 90), "ab" * rng.randint(0, 60)]) + t)
    texts += [None, "", texts[3], texts[3]]
    ids = [i if i % 17 else None for i in range(len(texts))]
    ids[-1] = ids[-2]
    df = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id bigint, text string, spans string").repartition(3)
    got = Counter(tuple(r) for r in substrings.remove_repeats(df, length, widths=widths).collect())
    assert got == Counter((i, *b) for i, b in zip(ids, repeats_by_hand([(t or "").encode() for t in texts], length)))


def test_removal_of_nothing(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_start|>", "<", "|", "<\\\\|x", "\n", "", "a<|b<\\|c", "\U0001F600<|im_end|>"]


def test_chat_round_trip_of_control_strings():
    turns = [(r, t) for r in ("user", "assistant", "a\nb\\n", "<|x|>") for t in NASTY]
    marked, spans = chat.render(turns)
    assert chat.parse(marked) == turns
    assert [chat.unescape(marked[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_layouts_map_to_the_same_turns(spark):
    records = [{"prompt": "hi", "response": "yo"}, {"instruction": "hi", "output": "yo"}, {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
               {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}], "id": 3}, {"question": "hi", "answer": "yo"}, {"prompt": "hi", "completion": "yo"}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, json.dumps({"weird": [1]})), (91, None), (92, "not json")]
    out = {r.conv_id: r for r in chat.format_records(spark.createDataFrame(rows, "conv_id bigint, record string")).collect()}
    assert len({out[i].formatted for i in range(len(records))}) == 1 and chat.parse(out[0].formatted) == [("user", "hi"), ("assistant", "yo")]
    assert len({out[i].fingerprint for i in range(len(records))}) == len(records)
    assert all(out[i].formatted is None and out[i].layout is None for i in (90, 91, 92))


def test_conversations_read_back(spark):
    rng = random.Random(1)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None]), rng.choice([*NASTY, None, "text"])))
    rows += [(500, 0, "system", "s"), (500, 1, "user", "u"), (500, 2, "assistant", "a<|"), (501, 0, "user", "u"), (501, 1, "assistant", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, record int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_records(chat.records_of(df))).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_records(chat.records_of(df.where("false")))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header>Site</header><nav><ul><li><a href=/a>A</a></ul></nav><div class="ad-box">Buy</div><div id='cookie-notice'>We use</div>
<article><header><h1>Head &amp; shoulders</h1></header><p>One <b>two</b>three<br>four&nbsp; five<p>six <!-- no --> seven
<form><input value="x">send</form><aside>side</aside><div class=comments><p>nice post</div><ul><li>a<li>b</ul></article>
<footer>&copy; me</footer></body></html>"""


def test_marked_article():
    found, decided = pages.main_blocks(PAGE)
    assert decided and " ".join(found) == "Head & shoulders One twothree four five six seven a b"
    assert pages.main_blocks(PAGE[: PAGE.index("seven") + 3])[0][-1].endswith("sev")


def test_wrappers_named_like_boilerplate_keep_their_article():
    page = '<body><div class="{}"><nav>menu</nav><{}><p>one two three four five</p></{}><div class="comments"><article>nice</article></div></div><footer>f</footer></body>'
    for name in ("no-sidebar", "has-nav", "with-comments", "layout without_ads", "sidebar", "page-widget", "sidebar-layout banner"):
        assert pages.main_blocks(page.format(name, "article", "article")) == (["one two three four five"], True), name
        assert pages.main_blocks(page.format(name, "div", "div")) == (["one two three four five"], False), name
    for name in ("ad", "comments", "related"):
        assert pages.main_blocks(f'<div class="{name}"><article>a b c d</article></div><div>own</div>') == (["own"], False), name
    assert pages.main_blocks('<div class="sidebar">a b</div><div>own text</div>') == (["own text"], False)


def test_repeats_on_a_host_go_where_markup_is_silent(spark):
    bar = "<div>welcome to our lovely little site where all of the news is free</div>"
    own = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(6)]
    rows = [(i, f"http://h.example/{i}", f"<html><body>{bar}<div>{own[i]}</div>{bar}", 1) for i in range(4)]
    rows += [(8, "http://other.example/", f"<body>{bar}<p>{own[4]}", 1), (9, None, None, 1), (10, "x", "", 1), (10, "x", PAGE, 1)]
    rows += [(20, "http://h.example/c", f"<body>{own[5]}", 1), (21, "http://h.example/d", f"<body>{own[5]}", 1)]
    got = Counter((r.page_id, r.text, r.n_chars) for r in pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect())
    text = {i: own[i] for i in range(4)} | {8: re.sub("<.*?>", "", bar) + " " + own[4], 9: "", 20: own[5], 21: own[5]}
    want = Counter((i, t, len(t)) for i, t in text.items()) + Counter([(10, "", 0), (10, "Head & shoulders One twothree four five six seven a b", 53)])
    assert got == want
    assert pages.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def words(name, n):
    return " ".join(f"{name}x{j}" for j in range(n))


def test_marked_pages_tell_what_repeats_on_unmarked_ones(spark):
    bar, menu, quoted, copied = words("bar", 12), words("menu", 100), words("quoted", 30), words("copied", 90)
    marked = "<body><div>{}</div><article><p>{}</p></article><footer>" + words("foot", 9) + "</footer>"
    rows = [(i, f"http://a.example/{i}", marked.format(bar, words(f"m{i}", 20) + " " + quoted)) for i in range(3)]
    rows += [(3, "http://a.example/3", f"<body><div>{bar}</div><div>{words('own', 20)}</div><div>{quoted}</div>")]
    rows += [(i, f"http://b.example/{i}", f"<body><div>{menu}</div><div>{words(f'o{i}', 40)}</div><div>{bar}</div>") for i in range(4, 8)]
    rows += [(i, f"http://c.example/{i}", f"<body><div>{words(f'd{i}', 9)}</div><div>{copied}</div>") for i in (8, 9)]
    rows += [(10, "http://d.example/", f"<body><div>{bar}</div>"), (11, "http://e.example/", marked.format(bar, quoted))]
    want = {i: words(f"m{i}", 20) + " " + quoted for i in range(3)} | {3: words("own", 20) + " " + quoted} | {i: words(f"o{i}", 40) for i in range(4, 8)}
    want |= {i: words(f"d{i}", 9) + " " + copied for i in (8, 9)} | {10: bar, 11: quoted}
    for parts in (1, 5):
        assert {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(parts)).collect()} == want


def cut_by_hand(rows, run):
    """(id, host, text left open or None, text outside of the article, article) of pages to {id: text}."""
    runs = lambda t: [tuple(w[i : i + run]) for w in [t.split()] for i in range(len(w) - run + 1)]
    out = {}
    for host in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == host]
        loose = {i: text for i, _, text, _, _ in own if text is not None}
        inside, outside = ({x for r in own if r[2] is None for x in runs(r[k])} for k in (4, 3))
        pages_of = Counter(x for t in loose.values() for x in set(runs(t)))

        def under(text, which):
            flags = [False] * len(text.split())
            for i, x in enumerate(runs(text)):
                if x in which:
                    flags[i : i + run] = [True] * run
            return flags

        repeated = {x for x, n in pages_of.items() if n > 1 or x in inside or x in outside}
        has_own = [i for i, t in loose.items() if "0" * run in "".join("01"[f] for f in under(t, repeated))]
        n = Counter(x for i in has_own for x in set(runs(loose[i])))
        many = {x for x in repeated - inside if x in outside or n[x] > 2}
        pair = {x for x in repeated - inside - many if n[x] == 2}
        for i, _, text, _, article in own:
            if text is None:
                out[i] = article
                continue
            sure, both = under(text, many), under(text, many | pair)
            gone = sure if sum(both) - sum(sure) > len(both) - sum(both) else both
            out[i] = " ".join(w for w, g in zip(text.split(), gone) if not g)
    return out


def test_repeats_match_brute_force(spark):
    rng = random.Random(12)
    seen = Counter()
    for run in (3, 5):
        shared = [words(f"s{i}", rng.randint(1, 20)) for i in range(12)]
        text = lambda i: " ".join(rng.choice([words(f"u{i}.{rng.random()}", rng.randint(0, 12)), *rng.sample(shared, 2)]) for _ in range(rng.randint(0, 5)))
        rows = []
        for i in range(160):
            host = f"h{min(rng.randint(0, 25), rng.randint(0, 25))}.example"
            if rng.random() < 0.3:
                rows.append((i, host, None, *(" ".join(text(i).split()) for _ in range(2))))
            else:
                base = rng.choice(rows)[2] if i > 20 and rng.random() < 0.2 else None
                rows.append((i, host, " ".join((base or text(i)).split()), "", ""))
        html = [(i, f"http://{h}/{i}", f"<body><div>{t}</div>" if t is not None else f"<body><div>{o}</div><main>{a or '<p>x</p>'}</main>") for i, h, t, o, a in rows]
        rows = [(i, h, t, o, a or "x") for i, h, t, o, a in rows]
        want = cut_by_hand(rows, run)
        got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(html, "page_id bigint, url string, html string").repartition(3), run=run).collect()}
        assert got == want
        seen.update("cut" if want[i] != t else "whole" for i, _, t, _, _ in rows if t)
    assert min(seen["cut"], seen["whole"]) > 30, seen


def docs_for_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), f"s{min(i % 11, 3)}") for i in range(900)] + [(2000 + i, "a b c", None) for i in range(20)] + [(3000, None, "empty"), (None, "x y", ""), (4000, "again here", "s0"), (4000, "again here", "s0")]
    return rows, spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, source string, target int")


def test_mix_meets_its_targets(spark):
    rows, df = docs_for_mix(spark)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * size[s] if s in capped else left * weight[s] / share for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    out = mixing.mix(df, block_docs=20, shards=6).join(df.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and len(r.placements) * r.size == r.taken
        if r.doc_id is not None:
            taken[r.source] += r.taken
            assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
    assert all(abs(taken[s] - target[s]) <= 45 for s in order if s != "")
    again = mixing.mix(df.repartition(7), block_docs=20, shards=6)
    assert Counter((r.doc_id, r.taken, str(r.placements)) for r in again.collect()) == Counter((r.doc_id, r.taken, str(r.placements)) for r in out)
    assert mixing.mix(df.where("false")).count() == 0
    mixed = mixing.mixed(df, block_docs=20, shards=6)
    assert mixed.columns == df.columns and sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(r.taken for r in out)


def test_tree_splits_exactly(spark):
    quotas = spark.createDataFrame([("a", 70), ("b", 5), (None, 31)], "source string, quota bigint")
    got = mixing.split_tree(quotas, 5, "seed").collect()
    per = Counter()
    for r in got:
        per[r.shard] += r.n
    assert {s: sum(r.n for r in got if r.source == s) for s in ("a", "b", None)} == {"a": 70, "b": 5, None: 31}
    assert set(per.values()) <= {21, 22} and sum(per.values()) == 106


def test_shards(spark):
    rows = [(i, None if i % 50 == 0 else f"t{i % 90}", 1) for i in range(3000)] + [(None, "n", 1), (7, "t7", 1), (7, "t7", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int").repartition(5)
    out = sharding.assign(df, [1.0] * 24, [1.0] * 25, blocks=64).toPandas()
    assert len(out) == len(rows) and set(out["shard"]) == set(range(24))
    moved = out[out["shard"] != out.grown_shard]
    assert (moved.grown_shard == 24).all() and 60 < len(moved) < 200
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard").slot)
    text = {(d, (t or "").encode()) for d, t, _ in rows if d is not None}
    assert {(int(r.doc_id), int(r.size), int(r.text_crc32)) for r in out.dropna(subset=["doc_id"]).itertuples()} == {(d, len(t) + 8, zlib.crc32(t)) for d, t in text}
    heavy = sharding.assign(df, [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    count = {r["shard"]: r["count"] for r in heavy}
    assert set(count) == {0, 1} and 2 < count[1] / count[0] < 4.5
    assert sharding.assign(df.where("false"), [1.0]).count() == 0


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 511, 512, 513, 2500):
        ids = (rng.integers(0, 50, n) * 900).astype(np.uint32)
        docs, lengths, m = wavelet.unpack(wavelet.pack([None, 5], np.array([n, 0]), ids, 16))
        assert docs == [None, 5] and lengths.tolist() == [n, 0] and (m.ids() == ids).all()
        for i in range(0, n, 41):
            assert m.access(i) == ids[i] and m.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
        for v in (0, 900, 1800, 7):
            assert m.occurrences(v) == np.flatnonzero(ids == v).tolist() and m.count(v) == (ids == v).sum()
        with pytest.raises(IndexError):
            m.select(7, 0)


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer
    public = pytest.importorskip("public_tokenizers")
    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = [None, "", "Hello, World. don't İstanbul ΣΟΣ é 12 x.y <|endoftext|>", "a b\tc\x1cd e  f\n\n", "ABC. abc, Abc", "ÄÖÜ. straße, 'Tis"] + ["".join(rng.choice("ab C.,'é́\n1") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    rows = [(i if i != 3 else None, t, 1) for i, t in enumerate(texts)] + [(10, "twice", 1), (10, "twice", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int").repartition(4)
    out = wavelet.read_files(wavelet.write_files(df, public.path("word_bpe_49k.json"), 2, file_tokens=200, partition_bytes=300)).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    assert len(out) == len(rows)
    for (doc, text, _), got in zip(ordered, out):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(got) == (doc, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert wavelet.read_files(wavelet.write_files(df.where("false"), public.path("word_bpe_49k.json"), 2)).count() == 0
