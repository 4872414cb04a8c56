"""Near-duplicate classes by order MinHash, verified by banded alignment.

A text is the sequence of its words. Sketches see it as labelled k-mers of ``k`` words: each k-mer carries its occurrence number
(the second "a b c" of a text differs from the first). A sketch takes the ``ell`` labelled k-mers with the smallest hashes and
keeps them in text order: two texts agree on a sketch only if they share these k-mers in the same order. With a share e of the
words changed, about p = (1 - e) ** k of the k-mers stay, J = p / (2 - p) of both texts' k-mers are shared, and a sketch agrees
with a chance of about J ** ell. Texts that agree on any of ``sketches`` sketches are candidates; with the defaults (k = 3,
ell = 3, 20 sketches) a pair is missed with a chance of 2e-5 at e = 0.05, 0.015 at 0.1 and 0.18 at 0.15.

A text of at most ``short`` words has too few k-mers for sketches (one edit may leave none), so it gets further keys that miss nothing:
where one text is t edits from another, one of t + 1 equal parts of the longer one stands in the shorter one, at a place that the
edits left and right of it allow. The longer text's parts and the shorter one's runs at such places are keys.

Candidates are verified by word-level alignment: a bit-parallel edit distance inside the band that the asked similarity leaves
(``least``: 1 - edits / words of the longer text). Before texts are aligned, an exact bound throws out hopeless pairs: each word,
labelled with its occurrence number, flips one of 2048 parity bits, an edit changes two at most.

Every pair of a bucket (texts with the same key) is compared, or known to be of one class, or beyond the bound:

* Each bucket sends one text, the shortest, to all its other texts: one pair per row of a bucket. Numbers are in order of length,
  so all buckets of a family tend to take the same text, which is the closest one where texts have a passage in common.
* Buckets that then hold several classes are joined to families where they share texts. A family is cut into blocks of about
  ``small`` texts of similar length, a class of more texts into blocks of its own, and two blocks meet in one task unless they are
  of one class or their lengths are too far apart. A task holds two blocks, their pairs are never rows. This part grows with the
  square of a family of texts that are alike but not of one class.

Texts are known by their md5 throughout, so neither null ids nor ids that several texts share keep a text from the search.

Defined cases: null and empty texts (and texts without words) are copies of each other only if equal, and near
nothing; a text of fewer than k words is one k-mer; equal texts and repeated rows share a class; a class without any id has
a null name, and classes of different texts under one id may have the same name (``class_copy`` tells them apart); an empty
table gives an empty result; only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm import arrays as A
from barlab.llm.frames import components, fresh, written

_M = np.uint64(0x9FB21C651E98DF25)


def labelled_kmers(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of occurrence-labelled k-mers in text order, and offsets (n + 1) of each text's."""
    data, offsets = A.texts_of(column)
    n = len(offsets) - 1
    start, end, doc = A.word_spans(data, offsets)
    value, where, _ = A.shingles(A.range_hash(A.prefix_hash(data), start, end), doc, n, k)
    times = A.occurrence(value ^ A.mix(where.astype(np.uint64) + np.uint64(1)))
    again = times > 0
    value[again] = A.mix(value[again] + times[again].astype(np.uint64) * _M)
    return value, np.concatenate([[0], np.cumsum(np.bincount(where, minlength=n))])


def sketch(value: np.ndarray, offsets: np.ndarray, sketches: int, ell: int) -> np.ndarray:
    """(texts with k-mers, sketches) keys: the ``ell`` smallest k-mers under each hash, combined in text order."""
    counts = np.diff(offsets)
    full = np.flatnonzero(counts)
    begin, size = offsets[full], counts[full]
    out = np.empty((len(full), sketches), dtype=np.uint64)
    if not len(full):
        return out
    top = np.uint64(2**64 - 1)
    for s in range(sketches):
        odd = np.uint64((0xA0761D6478BD642F * (2 * s + 1) * (2 * s + 3)) % 2**64 | 1)
        h = value * odd
        h ^= h >> np.uint64(32)
        where = np.empty((ell, len(full)), dtype=np.int64)
        for j in range(ell):
            least = np.minimum.reduceat(h, begin)
            hit = np.flatnonzero(h == np.repeat(least, size))
            owner = np.searchsorted(begin, hit, side="right") - 1
            where[j, owner[::-1]] = hit[::-1]  # the first position of each text
            h[where[j]] = top
        where.sort(axis=0)
        key = np.full(len(full), s + 1, dtype=np.uint64)
        for j in range(ell):
            key = A.mix(key * _M + value[where[j]])
        out[:, s] = key
    return out


def short_keys(words: np.ndarray, short: int, least: float) -> list[int]:
    """Keys of a text of few words: two texts of ``least`` similarity, the shorter one of at most ``short`` words, share one."""
    n, out = len(words), set()
    most = lambda longer: int(longer * (1 - least) + 1e-9)
    parts = lambda longer: [longer * i // (most(longer) + 1) for i in range(most(longer) + 2)]
    runs: dict[tuple[int, int], int] = {}

    def key(longer: int, i: int, start: int, size: int) -> int:
        if (start, size) not in runs:
            runs[start, size] = hash(tuple(words[start : start + size].tolist()))
        return hash((longer, i, runs[start, size]))

    if n - most(n) <= short:  # as the longer text
        cuts = parts(n)
        out |= {key(n, i, p, q - p) for i, (p, q) in enumerate(zip(cuts, cuts[1:])) if most(n)}
    if n <= short:
        longer = n
        while longer - n <= most(longer) or not most(longer):
            t, cuts = most(longer), parts(longer)
            for i, (p, q) in enumerate(zip(cuts, cuts[1:])) if t else ():
                lo, hi = max(p - i, p + n - longer - (t - i)), min(p + i, p + n - longer + (t - i))
                out |= {key(longer, i, at, q - p) for at in range(max(lo, 0), min(hi, n - (q - p)) + 1)}
            longer += 1
            if longer > 2 * n + 8:
                break
    return sorted(out)


def _sketch_rows(batches, k: int, sketches: int, ell: int, short: int, least: float):
    for batch in batches:
        for part in A.chunks(batch):
            value, offsets = labelled_kmers(part.column("text"), k)
            full = np.flatnonzero(np.diff(offsets))
            keys = list(sketch(value, offsets, sketches, ell).view(np.int64))
            words, begin = words_of(part.column("text"))
            for i, d in enumerate(full):
                if begin[d + 1] - begin[d] <= 2 * short:
                    more = short_keys(words[begin[d] : begin[d + 1]], short, least)
                    keys[i] = np.concatenate([keys[i], np.array(more, dtype=np.int64)])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(full)), flat], ["id", "keys"])


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words in text order, and offsets (n + 1) of each text's."""
    data, offsets = A.texts_of(column)
    start, end, doc = A.word_spans(data, offsets)
    return A.range_hash(A.prefix_hash(data), start, end), np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))])


def edits(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else something above.

    Columns of the alignment matrix are bit vectors of vertical steps (up or down by one), cut to the 2 * most + 1 diagonals
    of the band; the vector slides down one row with each column. The value is followed down the band's lowest diagonal to
    the last row and then along it.
    """
    n, m = len(b), len(a)
    if abs(n - m) > most:
        return most + 1
    if not n or not m:
        return max(n, m)
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i + most
    full = (1 << 2 * most + 1) - 1
    up, down, value = full >> most << most, 0, min(most, m)
    for j, x in enumerate(b, 1):
        same = where.get(x, 0) >> j - 1 & full
        diagonal = ((same & up) + up ^ up | same | down) & full
        right_up, right_down = (down | full & ~(diagonal | up)) & full, diagonal & up
        if j + most <= m:
            value += not diagonal >> 2 * most & 1
        else:
            row = m - j + most
            value += (right_up >> row & 1) - (right_down >> row & 1)
            if value > most + n - j:
                return most + 1
        slid = diagonal >> 1
        up, down = (right_down | full & ~(slid | right_up)) & full, slid & right_up
    return value


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """1 - edits / words of the longer; what cannot reach ``least`` may come out lower."""
    n, m = len(a), len(b)
    longer = max(n, m)
    if not n or not m:
        return 0.0
    most = int(longer * (1 - least) + 1e-9)
    if longer - min(n, m) > most:
        return 0.0
    same = a[: min(n, m)] == b[: min(n, m)]
    front = len(same) if same.all() else int(np.argmin(same))
    a, b = a[front:], b[front:]
    back = a[len(a) - min(len(a), len(b)) :] == b[len(b) - min(len(a), len(b)) :]
    tail = len(back) if back.all() else int(np.argmin(back[::-1]))
    return 1 - edits(a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist(), most) / longer


def _verify(batches, least: float):
    for batch in batches:
        for part in A.chunks(batch, "text_b"):
            both = pa.concat_arrays([part.column("text_a").cast(pa.large_string()), part.column("text_b").cast(pa.large_string())])
            value, offsets = words_of(both)
            n = part.num_rows
            seq = [value[offsets[i] : offsets[i + 1]] for i in range(2 * n)]
            ok = [similarity(seq[i], seq[n + i], least) >= least - 1e-9 for i in range(n)]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


#: Parity bits per text.
PARITY = 2048


def parities(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, PARITY) bits: whether an odd number of a text's words falls to a bit. The second "a" of a text is another word
    than the first, so that repeated words do not cancel; one word more or less still changes one bit."""
    n = len(offsets) - 1
    where = np.repeat(np.arange(n), np.diff(offsets))
    times = A.occurrence(value ^ A.mix(where.astype(np.uint64) + np.uint64(1)))
    labelled = A.mix(value + times.astype(np.uint64) * _M)
    place = where * PARITY + (labelled % np.uint64(PARITY)).astype(np.int64)
    return (np.bincount(place, minlength=n * PARITY) & 1).astype(bool).reshape(n, PARITY)


def _numbered(batches):
    """Texts with a number, their words and parities. Numbers: 17 bits of the number of words, 18 of the partition, 28 of the row."""
    at = TaskContext.get().partitionId() << 28
    for batch in batches:
        for part in A.chunks(batch):
            value, offsets = words_of(part.column("text"))
            n = np.diff(offsets)
            flat = np.packbits(parities(value, offsets)).view(np.int64)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, PARITY // 64, dtype=np.int32)), pa.array(flat))
            no = (np.minimum(n, 2**17 - 1) << 46) + at + np.arange(len(n))
            at += len(n)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(no), pa.array(n.astype(np.int32)), bits, part.column("text")], ["id", "no", "n", "bits", "text"])


def _meet(table: pa.Table, least: float) -> pa.Table:
    """Links between the texts of two blocks, or inside of one; pairs that a link has put into one class are left out."""
    table = table.combine_chunks().sort_by("no")
    value, offsets = words_of(table.column("text").combine_chunks())
    n, side = np.diff(offsets), table.column("side").to_numpy()
    sign = 1 - 2 * parities(value, offsets).astype(np.float32)
    group = table.column("class").to_pylist()
    left, right = (np.flatnonzero(side == x) for x in (0, 1)) if side.any() else (np.arange(len(n)),) * 2
    longer = np.maximum(n[left][:, None], n[right][None])
    most = longer * (1 - least) + 1e-6
    apart = (PARITY - sign[left] @ sign[right].T) / 2
    likely = (np.abs(n[left][:, None] - n[right][None]) <= most) & (apart <= 2 * most)
    if not side.any():
        likely &= left[:, None] < right[None]
    i, j = np.nonzero(likely)
    order = np.argsort(apart[i, j] / longer[i, j], kind="stable")
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    out = []
    for p, q in zip(left[i[order]].tolist(), right[j[order]].tolist()):
        x, y = root(group[p]), root(group[q])
        if x != y and similarity(value[offsets[p] : offsets[p + 1]], value[offsets[q] : offsets[q + 1]], least) >= least - 1e-9:
            up[max(x, y)] = min(x, y)
            out.append((group[p], group[q]))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def sketched(rows: DataFrame, k: int, sketches: int, ell: int, short: int, least: float) -> DataFrame:
    """(key, id): the keys of each text that another text has as well, from (id, text)."""
    keys = rows.mapInArrow(lambda b: _sketch_rows(b, k, sketches, ell, short, least), "id binary, keys array<bigint>")
    exploded = written(keys.select("id", F.explode("keys").alias("key")).distinct())
    shared = written(exploded.groupBy("key").count().where("count > 1").select("key"))
    return written(exploded.join(shared, "key", "left_semi"))


def compared(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs of texts that link."""
    side = lambda s: texts.select(F.col("no").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    most = (1 - least) * F.greatest("n_a", "n_b") + 1e-6
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(PARITY // 64)])
    likely = written(pairs.join(side("a"), "a").join(side("b"), "b").where((F.abs(F.col("n_a") - F.col("n_b")) <= most) & (apart <= 2 * most)).select("a", "b"))
    left = likely.join(texts.select(F.col("no").alias("b"), F.col("text").alias("text_b")), "b")
    full = left.join(texts.select(F.col("no").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return written(full.mapInArrow(lambda b: _verify(b, least), "a bigint, b bigint"))


def blocks_met(rest: DataFrame, texts: DataFrame, least: float, small: int) -> DataFrame:
    """(a, b): links between the classes of the texts (no, class, family) of each family."""
    wide = -math.log(max(least, 0.01)) * 1.001  # lengths of texts that link are at most so far apart
    rows = written(rest.join(texts.select("no", "n", F.octet_length("text").alias("long")), "no").withColumn("size", F.floor(F.log("n") / wide)))
    at = ["family", "size", "part"]
    own = rows.groupBy("family", "size", "class").agg(F.count("*").alias("count")).where(F.col("count") > small).select("family", "size", "class", F.col("class").alias("part"))
    rows = rows.join(own, ["family", "size", "class"], "left").withColumn("part", F.coalesce("part", F.lit(-1)))
    counts = rows.groupBy(*at).agg(F.ceil(F.greatest(F.count("*") / small, F.sum("long") / BLOCK_BYTES)).cast("int").alias("blocks"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    counts = written(counts)
    block = counts.select(*at, "lo", "hi", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    x, y = (block.select("family", F.struct("size", "part", "block").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}")) for s in "xy")
    several = (F.col("lo_x") != F.col("hi_x")) | (F.col("lo_y") != F.col("hi_y")) | (F.col("lo_x") != F.col("lo_y"))
    tiles = x.join(y, "family").where(several & (F.col("x") <= F.col("y")) & (F.col("y.size") - F.col("x.size") <= 1))
    tiles = written(tiles.select("family", "x", "y").withColumn("tile", F.monotonically_increasing_id()))
    ends = F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))
    sides = tiles.select("family", "tile", F.posexplode(ends).alias("side", "of")).select("family", "tile", "side", "of.*")
    dealt = rows.join(counts.select(*at, "blocks"), at).withColumn("block", F.pmod(F.xxhash64("no"), "blocks").cast("int"))
    met = dealt.select("no", "class", *at, "block").join(texts.select("no", "text"), "no").join(sides, [*at, "block"]).select("tile", "side", "no", "class", "text")
    return written(met.groupBy("tile").applyInArrow(lambda t: _meet(t, least), "a bigint, b bigint").distinct())


#: Bytes of text in a block, about.
BLOCK_BYTES = 1 << 23


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, least: float = 0.8, sketches: int = 20, ell: int = 3,
                 rounds: int = 1, small: int = 128, short: int = 20) -> DataFrame:
    """(doc_id, class_id, n_texts, copy, class_copy): one row per input row, ``copy`` being its text's md5; the class is named by
    its smallest id and told apart by ``class_copy``, the smallest md5 of its texts. ``n_texts`` counts the different texts of
    the class."""
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("id", F.unhex(F.md5("text")))
    copies = written(rows.select("doc", "id"))
    active = sketched(rows.select("id", "text"), k, sketches, ell, short, least)
    found = rows.select("id", "text").dropDuplicates(["id"]).join(active.select("id").distinct(), "id", "left_semi")
    texts = written(found.mapInArrow(_numbered, "id binary, no bigint, n int, bits array<bigint>, text string"))
    bucket = written(active.join(texts.select("id", "no"), "id").select("key", "no"))
    label = links = None
    for _ in range(rounds):
        state = written(bucket.join(written(bucket.groupBy("key").agg(F.min("no").alias("pivot"))), "key").where("no <> pivot"))
        new = compared(state.select(F.col("pivot").alias("a"), F.col("no").alias("b")).distinct(), texts, least)
        links = new if links is None else links.unionByName(new)
        label = written(components(links, "a", "b").select(F.col("id").alias("no"), F.col("component").alias("class")))
        bucket = state.select("key", "no")
    own = bucket if label is None else bucket.join(label, "no", "left")
    state = written(own.select("key", "no", (F.lit(None).cast("bigint") if label is None else F.col("class")).alias("class")).withColumn("class", F.coalesce("class", "no")))
    mixed = state.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.min("no").alias("lead")).where("lo <> hi").select("key", "lead")
    mixed = written(state.join(mixed, "key").select("no", "class", "lead").distinct())
    members = texts.select("id", "no") if label is None else texts.select("id", "no").join(label, "no", "left")
    members = members.withColumn("class", F.coalesce("class", "no") if label is not None else F.col("no"))
    if not mixed.isEmpty():
        family = components(mixed, "lead", "no").select(F.col("id").alias("no"), F.col("component").alias("family"))
        met = blocks_met(mixed.select("no", "class").distinct().join(family, "no"), texts, least, small)
        now = components(met, "a", "b").select(F.col("id").alias("class"), F.col("component").alias("now"))
        members = members.join(now, "class", "left").select("id", "no", F.coalesce("now", "class").alias("class"))

    first = written(copies.groupBy("id").agg(F.min("doc").alias("doc")).join(members, "id", "left").select("id", "doc", "no", "class"))
    # a text outside the search is a class of its own; others are told apart by the numbers of their classes
    alone = first.where("no is null").select("id", F.col("doc").alias("class_id"), F.lit(1).cast("bigint").alias("n_texts"), F.col("id").alias("class_copy"))
    names = written(first.where("no is not null").groupBy("class").agg(F.min("doc").alias("class_id"), F.count("*").alias("n_texts"), F.min("id").alias("class_copy")))
    named = first.where("no is not null").join(names, "class").select("id", "class_id", "n_texts", "class_copy")
    return copies.join(written(named.unionByName(alone)), "id").select(F.col("doc").alias(id_col), "class_id", "n_texts", F.col("id").alias("copy"), "class_copy")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per class: one whose id names it, and of different texts with that id the one of the smallest md5."""
    classes = written(near_classes(docs, id_col, text_col, **options))
    copy, head, name = fresh(docs, "copy", "head", "name")
    heads = written(classes.where(F.col(id_col).eqNullSafe(F.col("class_id"))).groupBy("class_copy", "class_id").agg(F.min("copy").alias(head)).select(head, F.col("class_id").alias(name)))
    own = docs.withColumn(copy, F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    kept = own.join(heads, (F.col(copy) == F.col(head)) & F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
    return kept.dropDuplicates([copy]).drop(copy)
