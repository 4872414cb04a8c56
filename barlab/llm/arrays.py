"""Vectorised text helpers used inside Arrow tasks: word and line spans, hashes of byte ranges, grouping.

A batch of texts is one byte array with document offsets, as Arrow stores it. All hashes are 64-bit, the same in
every run and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1_000_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x



def in_word(data: np.ndarray) -> np.ndarray:
    """True for bytes of words: all but space and tab to carriage return."""
    return (data != 0x20) & ((data - np.uint8(9)) > 4)


def marks(data: np.ndarray, table: bytes) -> np.ndarray:
    """Each byte's entry in a table of 256 bytes."""
    return np.frombuffer(data.tobytes().translate(table), dtype=np.uint8)


_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the hash base (or of its inverse), kept between calls."""
    name = "inverse" if inverse else "base"
    got = _powers.get(name)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, _INVERSE if inverse else _BASE, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size <= 2 * CHUNK_BYTES:
            _powers[name] = got
    return got[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte values (plus 1) times powers of the base; ``range_hash`` turns them into hashes of ranges."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    value = data.astype(np.uint64)
    value += _U(1)
    value *= powers(len(data))
    np.cumsum(value, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end): depends on these bytes alone, not on where they are."""
    inv = powers(len(prefix), inverse=True)
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (n + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` text bytes."""
    _, offsets = texts_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; no word crosses a document's end."""
    inside = in_word(data)
    change = np.empty(len(data) + 1, dtype=bool)
    if len(data):
        change[0], change[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    else:
        change[:] = False
    edges = np.flatnonzero(change)
    start, end = edges[0::2], edges[1::2]
    cuts = offsets[1:-1]
    if len(cuts) and len(data):  # a document that ends inside a run of word bytes splits it
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
        cuts = cuts[inside[cuts] & inside[cuts - 1]]
        if len(cuts):
            start = np.sort(np.concatenate([start, cuts]))
            end = np.sort(np.concatenate([end, cuts]))
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every line (split at line feeds)."""
    feeds = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    # the k-th end closes the k-th start because a document has one more line than line feeds
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(feeds, offsets)) + 1)
    return start, end, doc


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words, their document and their first word's index.

    A document of fewer than ``k`` words but at least one has a single shingle of all its words.
    """
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(counts)])
    n = len(words)
    value = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        value[: n - j] = value[: n - j] * _U(0xD1342543DE82EF95) + words[j:] if j < n else value[: n - j]
    ok = np.arange(n) + k <= first[1:][doc] if n else np.zeros(0, dtype=bool)
    at = np.flatnonzero(ok)
    value, where = mix(value[at]), doc[at]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.empty(len(short), dtype=np.uint64)
        for i, d in enumerate(short):
            h = 0
            for w in words[first[d] : first[d + 1]].tolist():
                h = (h * 0xD1342543DE82EF95 + w) % 2**64
            extra[i] = h ^ 0x5DEECE66D
        value, where, at = np.concatenate([value, mix(extra)]), np.concatenate([where, short]), np.concatenate([at, first[short]])
        order = np.argsort(at, kind="stable")
        value, where, at = value[order], where[order], at[order]
    return value, where, at


def occurrence(key: np.ndarray) -> np.ndarray:
    """0 for the first row with a key, 1 for the second, and so on."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    begin = np.flatnonzero(new)
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    return out


def per_doc(prefix: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum per document of a flag array's prefix sums (length + 1)."""
    return prefix[offsets[1:]] - prefix[offsets[:-1]]


def running(flags: np.ndarray) -> np.ndarray:
    """Prefix sums (length + 1) of a flag array."""
    out = np.zeros(len(flags) + 1, dtype=np.int32 if len(flags) < 2**31 else np.int64)
    np.cumsum(flags, dtype=out.dtype, out=out[1:])
    return out
