"""Spelling variants: words one edit apart, found by search schemes over FM-indexes of the vocabulary.

Of two words that differ by one inserted, deleted or replaced letter, either the first or the second half of the one
stands unchanged at the same end of the other. So every word is searched twice: its first half is matched exactly from the
word's beginning and the other half is matched on with one error; and the same backwards, from the word's end. Together these
two schemes miss no pair.

The search runs on FM-indexes of delimited words. A suffix array over the words (prefix doubling on rank pairs, delimiters
ordered by word) gives the Burrows-Wheeler string; a string is an interval of suffix ranks, and one more letter maps an
interval to another by two rank look-ups. The index over the words read backwards extends matches to the right, the index over
the words as they are extends them to the left. All words of a shard are searched at once as NumPy arrays, one letter a round;
where an interval is narrow, the letters that can follow are read off the Burrows-Wheeler string, where it is wide, each
letter of the alphabet is tried, so a half that very many words share costs no more than the alphabet.

Only words with a half in common can meet, so Spark deals the vocabulary by halves: an index row for each half a partner might
have, a query row for each half of the word. A shard holds about ``shard_words`` index words; a half that more words have is
cut into several shards, each of which gets all of its queries. No index holds the whole vocabulary, and no pairs but the
links found are made.

Forms then point from rare to frequent words, and roots follow by pointer doubling: a chain of forms at least doubles the count
at each link, so few rounds suffice.

Defined cases: a null or empty text has no words; a null id counts as the empty string in the checksum; repeated rows count
each; a run that loses its only letter is no word; texts and words may have any length; ties go to the smaller word; an empty
table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.frames import written

#: Letters of words after lower-casing A to Z.
RUN = "[a-zÀ-ÿ]+"
#: Widest interval whose next letters are read off one by one.
NARROW = 64


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts. A run whose checksum with its document's id is divisible by ``every`` loses a letter."""
    text = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least_length)
    hashed = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class BackwardIndex:
    """FM-index of words: starting from their ends, strings grow to the left letter by letter."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, letters: int):
        """``codes`` are the words' letters (1 to ``letters``) one word after the other."""
        words, n = len(lengths), int(lengths.sum()) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[ends] = False
        text[inside] = codes
        rank = text + words - 1
        rank[ends] = np.arange(words)  # delimiters are smaller than letters and differ
        width = 1
        while True:
            nxt = np.full(n, -1, dtype=np.int64)
            nxt[: n - width] = rank[width:] if width < n else rank[:0]
            key = rank * (n + words + letters + 1) + nxt + 1
            order = np.argsort(key, kind="stable")
            new = np.ones(n, dtype=np.int64)
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new) - 1
            if rank[order[-1]] == n - 1:
                break
            width *= 2
        before = np.concatenate([[0], text[:-1]])[order]  # of a word's first letter: the delimiter before it
        self.n, self.words, self.letters = n, words, letters
        self.before = before
        places = np.argsort(before, kind="stable")
        self.keys = before[places] * n + places
        self.first = np.searchsorted(self.keys, np.arange(letters + 2) * n)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters + 1))])
        owner = np.repeat(np.arange(words), lengths + 1)
        self.whole = owner[order[places[: self.first[1]]]]  # words by the rank of their whole suffix

    def grow(self, lo: np.ndarray, hi: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the strings with ``letter`` in front."""
        shift = self.smaller[letter] - self.first[letter]
        return np.searchsorted(self.keys, letter * self.n + lo) + shift, np.searchsorted(self.keys, letter * self.n + hi) + shift

    def letters_before(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, letter) of all letters that stand before a string of the interval."""
        size = hi - lo
        few = np.flatnonzero(size <= NARROW)
        row = np.repeat(few, size[few])
        at = np.arange(len(row)) - np.repeat(np.cumsum(size[few]) - size[few], size[few]) + lo[row]
        pair = np.unique(row * (self.letters + 1) + self.before[at])
        many = np.flatnonzero(size > NARROW)
        if len(many):
            pair = np.concatenate([pair, (many[:, None] * (self.letters + 1) + np.arange(1, self.letters + 1)).ravel()])
        row, letter = pair // (self.letters + 1), pair % (self.letters + 1)
        return row[letter > 0], letter[letter > 0]

    def complete(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) of the words that are the string itself, delimiter to delimiter."""
        a, b = np.searchsorted(self.keys[: self.first[1]], lo), np.searchsorted(self.keys[: self.first[1]], hi)
        row = np.repeat(np.arange(len(lo)), b - a)
        at = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[row]
        return row, self.whole[at]


def one_error(index: BackwardIndex, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) for index words that differ from a query by one edit behind its first ``exact`` letters.

    Queries are read from their first letter on; letters that the index does not know have code 0 and match nothing.
    """
    q = np.arange(len(begin))
    lo, hi = np.zeros(len(q), dtype=np.int64), np.full(len(q), index.words, dtype=np.int64)
    for j in range(int(exact.max(initial=0))):
        go = exact[q] > j
        c = codes[begin[q[go]] + j]
        lo[go], hi[go] = index.grow(lo[go], hi[go], c)
        hi[go] = np.where(c > 0, hi[go], lo[go])
        some = hi > lo
        q, lo, hi = q[some], lo[some], hi[some]
    found_q, found_w = [], []
    at, bad = exact[q].astype(np.int64), np.zeros(len(q), dtype=bool)
    while len(q):
        over = at == length[q]
        done = over & bad
        row, word = index.complete(lo[done], hi[done])
        found_q.append(q[done][row])
        found_w.append(word)
        keep = ~done
        q, at, bad, lo, hi, over = q[keep], at[keep], bad[keep], lo[keep], hi[keep], over[keep]
        nxt = []
        go = ~over  # the next letter as it is
        c = codes[begin[q[go]] + at[go]]
        a, b = index.grow(lo[go], hi[go], c)
        nxt.append((q[go], at[go] + 1, bad[go], a, np.where(c > 0, b, a)))
        free = np.flatnonzero(~bad)
        if len(free):
            left = free[~over[free]]  # the index word lacks the letter
            nxt.append((q[left], at[left] + 1, np.ones(len(left), dtype=bool), lo[left], hi[left]))
            row, letter = index.letters_before(lo[free], hi[free])
            row = free[row]
            a, b = index.grow(lo[row], hi[row], letter)
            nxt.append((q[row], at[row], np.ones(len(row), dtype=bool), a, b))  # the index word has one letter more
            swap = ~over[row]
            swap[swap] = codes[begin[q[row[swap]]] + at[row[swap]]] != letter[swap]
            nxt.append((q[row[swap]], at[row[swap]] + 1, np.ones(int(swap.sum()), dtype=bool), a[swap], b[swap]))
        q, at, bad, lo, hi = (np.concatenate(x) for x in zip(*nxt))
        some = hi > lo
        q, at, bad, lo, hi = q[some], at[some], bad[some], lo[some], hi[some]
    return (np.concatenate(found_q), np.concatenate(found_w)) if found_q else (q, q)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after the other, and the words' lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


def search_shard(indexed: list[str], asked: list[str], exact: np.ndarray, batch: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(query, index word) positions of one-edit partners that keep the first ``exact`` letters. The index is that of the
    words read backwards, so that growing to its left reads words forwards."""
    points, length = _letters([w[::-1] for w in indexed])
    alphabet = np.unique(points)
    index = BackwardIndex(np.searchsorted(alphabet, points) + 1, length, len(alphabet))
    out = []
    for i in range(0, len(asked), batch):
        points, length = _letters(asked[i : i + batch])
        code = np.searchsorted(alphabet, points)
        known = alphabet[np.minimum(code, len(alphabet) - 1)] == points
        q, w = one_error(index, np.where(known, code + 1, 0), np.cumsum(length) - length, length, exact[i : i + batch])
        out.append((q + i, w))
    return np.concatenate([q for q, _ in out]), np.concatenate([w for _, w in out])


def _search_group(group: pa.Table) -> pa.Table:
    asked = group.filter(group.column("asked"))
    indexed = sorted(set(group.filter(pc.invert(group.column("asked"))).column("word").to_pylist()))
    names = asked.column("word").to_pylist()
    if not indexed or not names:
        return pa.table({"word": pa.array([], pa.string()), "other": pa.array([], pa.string())})
    q, w = search_shard(indexed, names, asked.column("half").to_numpy().astype(np.int64))
    pair = np.unique(q * len(indexed) + w)
    word, other = pa.array(names).take(pa.array(pair // len(indexed))), pa.array(indexed).take(pa.array(pair % len(indexed)))
    if group.column("side")[0].as_py():
        word, other = (pa.array([x[::-1] for x in c.to_pylist()], pa.string()) for c in (word, other))
    return pa.table({"word": word, "other": other})


def near_words(words: DataFrame, shard_words: int = 20_000) -> DataFrame:
    """(word, other): all ordered pairs of words (distinct, in column ``word``) that are one edit apart."""
    n = F.length("word")
    both = words.select(n.alias("n"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("word")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("word")))).alias("x")).select("x.side", "x.word", "n")
    # a word of n letters is searched with its first half as it is: n / 2 letters from the front, the rest from the back
    half = lambda m: F.floor((m + F.col("side")) / 2).cast("int")
    asked = both.select("side", "word", half(F.col("n")).alias("half"), F.lit(True).alias("asked"))
    indexed = both.select("side", "word", F.explode(F.array_distinct(F.array(half(F.col("n") - 1), half(F.col("n")), half(F.col("n") + 1)))).alias("half"), F.lit(False).alias("asked"))
    rows = indexed.unionByName(asked).withColumn("key", F.xxhash64("side", F.substring("word", F.lit(1), F.col("half"))))
    rows = written(rows)
    held = written(rows.groupBy("key").agg(F.count_if(~F.col("asked")).alias("held")).where("held > 1"))  # alone, a word meets itself only
    total = held.agg(F.sum("held")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    salts = F.ceil(F.col("held") / shard_words).cast("int")
    salt = F.when(F.col("asked"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), salts).cast("int")))
    dealt = rows.join(held, "key").withColumn("salt", F.explode(salt)).withColumn("shard", F.pmod(F.xxhash64("key", "salt"), F.lit(shards)))
    return dealt.select("side", "shard", "word", "half", "asked").groupBy("side", "shard").applyInArrow(_search_group, "word string, other string").distinct()


def forms(vocab: DataFrame, **options) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row (word, n) of ``vocab``."""
    pairs = written(near_words(vocab.select("word"), **options))
    theirs = vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = pairs.join(theirs, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    taken = -F.col("best.minus") >= 2 * F.col("n")
    rows = written(vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n")))
    chain = written(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # each round doubles how far a word has followed its forms
        ahead = chain.select(F.col("word").alias("at"), F.col("root").alias("ahead"))
        step = written(chain.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        chain = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return rows.join(chain, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts."""
    return forms(written(vocabulary(docs, id_col=id_col, text_col=text_col)), **options)
