"""Token-id output as wavelet matrices: one succinct file per run of documents.

A wavelet matrix keeps a sequence of ids as bit planes, highest bit first; after each plane the ids with bit 0 move
before those with bit 1, in order. Every plane has counts of ones per 512 bits, so one id (``access``), the number of an
id before a position (``rank``), the position of its k-th occurrence (``select``) and all its occurrences come from the
file without decoding it. Planes that compress are stored compressed (zstd), each on its own.

Documents are ranged by id, so each partition writes files of consecutive documents; a file is closed after
``file_tokens`` ids, so memory does not depend on partition size (a single longer document makes one longer file). The
files are binary rows of a Parquet table in the shared folder, written by Spark's committer: a lost executor's task is
run again and leaves no half file. Reading back decodes each file in one task.

Defined cases: a null or empty text is the end id alone; null ids come first; repeated rows are separate documents of
equal id; an empty table gives no file; only the id and text columns are read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm import arrays as A
from barlab.llm.frames import written

MAGIC = b"WMX1"
BLOCK = 512
#: Distinct words whose ids a task remembers before it starts anew (some 40 bytes each).
MEMO_WORDS = 3_000_000
#: Code points of a text that tell ranges of equal ids apart; samples of them go through the driver.
HEAD_CHARS = 256


class WaveletMatrix:
    """A sequence of unsigned ids as bit planes with rank counts."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes = n, planes
        pad = -n % BLOCK
        self.ones = []
        for p in planes:
            per = np.bitwise_count(np.concatenate([p, np.zeros(-len(p) % (BLOCK // 8), dtype=np.uint8)]).reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64) if n + pad else np.zeros(0, np.int64)
            self.ones.append(np.concatenate([[0], np.cumsum(per)]))
        self.zeros = [n - int(o[-1]) for o in self.ones]

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        kind = np.uint16 if levels <= 16 else np.uint32
        planes, now = [], ids.astype(kind)
        for b in range(levels - 1, -1, -1):
            bit = now & kind(1 << b) != 0
            planes.append(np.packbits(bit))
            now = np.concatenate([now[~bit], now[bit]])
        return cls(len(ids), planes)

    def ids(self) -> np.ndarray:
        """The whole sequence, from the last plane back to the first."""
        levels = len(self.planes)
        kind = np.uint16 if levels <= 16 else np.uint32
        out = np.zeros(self.n, dtype=kind)
        for level in range(levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            before = np.empty(self.n, dtype=kind)
            before[~bit] = out[: self.zeros[level]]
            before[bit] = out[self.zeros[level] :] | kind(1 << (levels - 1 - level))
            out = before
        return out

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // BLOCK
        tail = np.unpackbits(self.planes[level][block * (BLOCK // 8) : (i + 7) // 8], count=i - block * BLOCK)
        return int(self.ones[level][block]) + int(tail.sum())

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the first ``i`` positions' occurrences of ``value`` lie after the last plane."""
        levels, lo, hi = len(self.planes), 0, i
        for level in range(levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` among the first ``i`` ids."""
        lo, hi = self._range(value, i)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        ones = self.ones[level]
        upto = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(upto, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(upto[block])])

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``value``."""
        lo, hi = self._range(value, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at, levels = lo + k, len(self.planes)
        for level in range(levels - 1, -1, -1):
            bit = value >> (levels - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, levels: int) -> bytes:
    """One file: header, document ids (nulls flagged) and lengths, then the planes, each raw or compressed."""
    import zstandard
    squeeze = zstandard.ZstdCompressor(level=1).compress
    matrix = WaveletMatrix.build(ids, levels)
    head = struct.pack("<4sBQI", MAGIC, levels, len(ids), len(doc_ids))
    nulls = np.packbits(np.array([d is None for d in doc_ids], dtype=bool))
    docs = squeeze(np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes())
    sizes = squeeze(lengths.astype("<u4").tobytes())
    parts = [head, struct.pack("<II", len(docs), len(sizes)), nulls.tobytes(), docs, sizes]
    for plane in matrix.planes:
        raw = plane.tobytes()
        small = squeeze(raw)
        parts += [struct.pack("<BI", 1, len(small)), small] if len(small) < 0.95 * len(raw) else [struct.pack("<BI", 0, len(raw)), raw]
    return b"".join(parts)


def unpack(data: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """Document ids, their lengths and the matrix of a file."""
    import zstandard
    expand = zstandard.ZstdDecompressor().decompress
    magic, levels, n, docs = struct.unpack_from("<4sBQI", data)
    if magic != MAGIC:
        raise ValueError("not a wavelet file")
    at = struct.calcsize("<4sBQI")
    a, b = struct.unpack_from("<II", data, at)
    at += 8
    flags = np.unpackbits(np.frombuffer(data, np.uint8, (docs + 7) // 8, at), count=docs)
    at += (docs + 7) // 8
    names = np.frombuffer(expand(data[at : at + a]), "<i8")
    lengths = np.frombuffer(expand(data[at + a : at + a + b]), "<u4")
    at += a + b
    planes = []
    for _ in range(levels):
        kind, size = struct.unpack_from("<BI", data, at)
        at += 5
        raw = data[at : at + size]
        planes.append(np.frombuffer(expand(raw) if kind else raw, np.uint8))
        at += size
    return [None if f else int(x) for f, x in zip(flags, names)], lengths, WaveletMatrix(n, planes)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all elements of runs, one run after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


#: A second, independent view of bytes for check hashes.
_TWIST = bytes(pow(5, i, 257) % 256 ^ 0x5A for i in range(256))


class Memo:
    """Ids of words, found by two 64-bit hashes of a word; arrays only, so millions of words stay small."""

    def __init__(self):
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Place of each word, -1 for an unknown one."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Remember words that are not known yet; of words with the same first hash one is kept, others stay unknown."""
        start = np.cumsum(size) - size + len(self.ids)
        key, check, start, size = (np.concatenate([x, y]) for x, y in ((self.key, key), (self.check, check), (self.start, start), (self.size, size.astype(np.int32))))
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.key, first = np.unique(key, return_index=True)
        self.check, self.start, self.size = check[first], start[first], size[first]


def wordwise(spec: dict) -> bool:
    """Whether a tokenizer's ids of a text are those of its words one after the other, a word's letters and its last mark apart."""
    normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    space = [n for n in (spec.get("normalizer") or {}).get("normalizers", []) if n.get("type") == "Replace"]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    shape = [c.get("type") for c in cuts] == ["Split", "ByteLevel"] and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
    pattern = (cuts[0].get("pattern") or {}).get("Regex", "") if shape else ""
    apart = pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex", True) if shape else False
    plain = all(t["content"].strip() and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() or c.isalpha() and t["content"].isalpha() for c in t["content"])) for t in spec.get("added_tokens") or [])
    return normal == ["NFC", "Replace", "Lowercase"] and space[0].get("content") == " " and (space[0].get("pattern") or {}).get("Regex") == r"\s+" and apart and plain and spec.get("model", {}).get("type") == "BPE" and not spec["model"].get("dropout")


def encoder(path: str, end_id: int):
    """Function from a column of texts to the ids of all of them, each text's followed by ``end_id``, and their lengths.

    If the tokenizer lowers case, drops white space and merges letters and marks apart (``wordwise``), a word (between
    spaces or line feeds) has the same ids wherever it stands: each distinct word is encoded once and remembered, and a batch
    looks up its distinct words only. A word of letters with a full stop or comma behind is put together from both; words
    of small letters skip the normaliser and the splitting expression, and ASCII ones the mapping of bytes, all of which
    would leave them as they are. Any other tokenizer encodes whole texts.
    """
    import json
    import os
    from unicodedata import is_normalized

    import pyarrow.compute as pc

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel
    full = Tokenizer.from_file(path)

    def encode_all(tok: Tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum())), size

    def whole_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, size = encode_all(full, pc.fill_null(column.cast(pa.large_string()), "").to_pylist())
        out = np.full(len(ids) + len(size), end_id, dtype=np.uint32)
        out[_runs(np.cumsum(size + 1) - size - 1, size)] = ids
        return out, size + 1

    with open(path, encoding="utf-8") as file:
        if not wordwise(json.load(file)):
            return whole_texts
    ascii_letters, letters = Tokenizer(full.model), Tokenizer(full.model)
    letters.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
    memo = Memo()

    def hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = A.texts_of(words)
        key = A.range_hash(A.prefix_hash(data), offsets[:-1], offsets[1:])
        twisted = A.range_hash(A.prefix_hash(A.marks(data, _TWIST)), offsets[:-1], offsets[1:])
        return key, twisted

    def learn(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by the tokenizer, the shortest way that is right for each."""
        names = words.to_pylist()
        small = [w.isalpha() and w == w.lower() and is_normalized("NFC", w) for w in names]
        kind = np.fromiter(((1 if w.isascii() else 2) if s else 0 for w, s in zip(names, small)), np.int8, len(names))
        ids, size, order = [], [], []
        for k, tok in enumerate((full, ascii_letters, letters)):
            at = np.flatnonzero(kind == k)
            i, s = encode_all(tok, [names[j] for j in at])
            ids.append(i)
            size.append(s)
            order.append(at)
        size_of = np.concatenate(size)
        start = np.cumsum(size_of) - size_of
        back = np.argsort(np.concatenate(order))
        return np.concatenate(ids)[_runs(start[back], size_of[back])], size_of[back]

    def composed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words from those of letters and marks where they have this shape."""
        mark = pc.if_else(pc.ends_with(words, "."), ".", pc.if_else(pc.ends_with(words, ","), ",", ""))
        marked = pc.not_equal(mark, "")
        core = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words)
        plain = pc.string_is_ascii(core)
        lowered = pc.if_else(plain, pc.utf8_lower(core), core)
        made = pc.and_(pc.utf8_is_alpha(core), pc.or_(marked, pc.and_(plain, pc.not_equal(core, lowered)))).to_numpy(zero_copy_only=False)
        rows = pa.array(np.flatnonzero(made))
        coded = pa.concat_arrays([lowered.take(rows), words.filter(pa.array(~made)), pa.array([".", ",", ""], words.type)]).dictionary_encode()
        ids, size = look_up(coded.dictionary, learn)
        start, place = np.cumsum(size) - size, coded.indices.to_numpy()
        marks = {".": place[-3], ",": place[-2], "": place[-1]}
        none = marks[""]
        first, second = np.full(len(words), none), np.full(len(words), none)
        first[made], first[~made] = place[: len(rows)], place[len(rows) : -3]
        second[made] = np.fromiter((marks[m] for m in mark.take(rows).to_pylist()), np.int64, len(rows))
        both = np.stack([first, second], axis=1).ravel()
        return ids[_runs(start[both], size[both])], size[first] + size[second]

    def look_up(words: pa.Array, otherwise) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one word after the other, and how many each has."""
        key, check = hashes(words)
        new = np.flatnonzero(memo.find(key, check) < 0)
        ids, size = otherwise(words.take(pa.array(new))) if len(new) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        at = memo.find(key, check)  # what was new may be known by now as a part of others
        at[new] = -1
        start, sizes = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        old = at >= 0
        start[old], sizes[old] = memo.start[at[old]], memo.size[at[old]]
        start[new], sizes[new] = len(memo.ids) + np.cumsum(size) - size, size
        out = np.concatenate([memo.ids, ids])[_runs(start, sizes)]
        memo.add(key[new], check[new], ids, size)
        return out, sizes

    def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        nonlocal memo
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        if len(memo.key) + 2 * len(coded.dictionary) > MEMO_WORDS:
            memo = Memo()
        known, size = look_up(coded.dictionary, composed)
        n = size[at]  # ids of every word in the texts, in order
        upto = np.concatenate([[0], np.cumsum(n)])
        count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        edges = upto[np.concatenate([[0], np.cumsum(count)])]
        lengths = np.diff(edges) + 1
        ids = np.full(upto[-1] + len(count), end_id, dtype=np.uint32)
        doc = np.repeat(np.arange(len(count)), count)
        step = np.arange(upto[-1])
        ids[step + np.repeat(doc, n)] = known[_runs((np.cumsum(size) - size)[at], n)]
        return ids, lengths

    return encode


def _pack_partition(batches, path: str, end_id: int, levels: int, file_tokens: int):
    from pyspark import TaskContext
    encode, part, number = encoder(path, end_id), TaskContext.get().partitionId(), 0
    held: list[np.ndarray] = []
    docs: list = []
    sizes: list[np.ndarray] = []
    tokens = 0

    def file():
        nonlocal held, docs, sizes, tokens, number
        payload = pack(docs, np.concatenate(sizes), np.concatenate(held), levels)
        row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([tokens], pa.int64()), pa.array([payload], pa.binary())], ["part", "number", "n_tokens", "payload"])
        held, docs, sizes, tokens, number = [], [], [], 0, number + 1
        return row

    for batch in batches:
        for cut in A.chunks(batch, limit=4 * A.CHUNK_BYTES):
            ids, lengths = encode(cut.column("text"))
            names, ends, at = cut.column("id").to_pylist(), np.cumsum(lengths), 0
            while at < len(names):  # up to the document with which the file is full
                start = int(ends[at] - lengths[at])
                to = min(int(np.searchsorted(ends, start + file_tokens - tokens)) + 1, len(names))
                held.append(ids[start : int(ends[to - 1])])
                sizes.append(lengths[at:to])
                docs += names[at:to]
                tokens += int(ends[to - 1]) - start
                at = to
                if tokens >= file_tokens:
                    yield file()
    if docs:
        yield file()


def write_files(docs: DataFrame, tokenizer: str, end_id: int, levels: int | None = None, file_tokens: int = 2_000_000, partition_bytes: int = 64_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Table (part, number, n_tokens, payload) of files in ascending (id, text) order. ``levels`` bits hold every id
    (by default as many as the vocabulary needs)."""
    from tokenizers import Tokenizer
    need = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id, 1).bit_length()
    if levels is not None and levels < need:
        raise ValueError(f"{levels} levels cannot hold ids of {need} bits")
    levels = levels or need
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # rows of one id (null ids above all) are dealt by the heads of their texts as well, in the order of the texts
    ranged = rows.repartitionByRange(max(1, -(-total // partition_bytes)), "id", F.substring("text", 1, HEAD_CHARS)).sortWithinPartitions("id", "text")
    return written(ranged.mapInArrow(lambda b: _pack_partition(b, tokenizer, end_id, levels, file_tokens), "part int, number int, n_tokens bigint, payload binary"))


def _unpack_rows(batches):
    for batch in batches:
        for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload")):
            docs, lengths, matrix = unpack(payload.as_py())
            ids = matrix.ids().astype("<u4")
            ends = np.cumsum(lengths, dtype=np.int64)
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_files(files: DataFrame, broadcast_files: int = 1_000_000) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    The files' first positions are broadcast up to ``broadcast_files`` files; beyond, files are shuffled to theirs."""
    side = F.broadcast if files.count() <= broadcast_files else (lambda df: df)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the writer
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "number", "n_tokens").join(parts, "part").select("part", "number", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"))
    return files.select("part", "number", "payload").join(side(starts), ["part", "number"]).select("start", "payload").mapInArrow(_unpack_rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
