"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Words are runs of ASCII letters and digits (in lower case) and bytes beyond ASCII. Every ``k`` consecutive words have a
hash; of every ``window`` consecutive hashes the smallest (the first of equals) is a fingerprint, so texts that share
k + window - 1 words share a fingerprint. An inverted index from fingerprint to (template, position) yields candidates:
hits of one template whose offsets lie within the band form a group, and the template is aligned to the words there by the
longest common subsequence inside a band around the group's diagonal. Reported are the share of the template's words
matched, and the span from the first to the last matched word. Templates may be alike (a license and its short notice, two
versions): of matches that overlap the one with most words matched over words missed is reported. Identifiers ("SPDX ...")
match whole, and not as the beginning of a longer identifier. A notice is found if three of its words in a row are left.

The templates are a parameter (a list, a few hundred kilobytes); documents are read once, without a shuffle, and a
text is scanned whole. Defined cases: null and empty texts match nothing; repeated rows are reported each; null ids stay
null; an empty table or no template gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm import arrays as A
from barlab.llm.license_texts import TEMPLATES

#: Templates of fewer words keep all their fingerprints: too few would be left where a word is missing.
SHORT = 12

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and document of every word."""
    plain = A.marks(data, _WORDS)
    start, end, doc = A.word_spans(plain, offsets)
    return A.range_hash(A.prefix_hash(plain), start, end), start, end, doc


def winnow(value: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Positions of the fingerprints: the first smallest hash of every ``window`` in a document, all in shorter ones."""
    n = len(value)
    if not n:
        return np.zeros(0, dtype=np.int64)
    best = np.arange(n)
    for step in range(1, window):  # best[i]: position of the smallest of value[i : i + step + 1] inside the document
        other = np.minimum(np.arange(n) + step, n - 1)
        take = (doc[other] == doc) & (value[other] < value[best])
        best[take] = other[take]
    begin = np.searchsorted(doc, doc, side="left")
    end = np.searchsorted(doc, doc, side="right")
    whole = (np.arange(n) + window <= end) | (np.arange(n) == begin)
    return np.unique(best[whole])


def banded(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> list[tuple[int, int]]:
    """Matched (template, text) positions of a longest common subsequence with |text - template - shift| <= band."""
    m, n, width = len(template), len(text), 2 * band + 1
    score = np.zeros((m + 1, width + 2), dtype=np.int32)  # column c of row i: text position i + shift - band + c - 1
    t, x = template.tolist(), text.tolist()
    for i in range(1, m + 1):
        row, above = score[i], score[i - 1]
        low = i - 1 + shift - band
        run = 0
        for c in range(1, width + 1):
            j = low + c - 1
            here = above[c + 1] if above[c + 1] > run else run
            if 0 <= j < n and x[j] == t[i - 1] and above[c] + 1 > here:
                here = above[c] + 1
            row[c] = run = here
    pairs, i, c = [], m, width
    while i > 0 and c > 0:
        now, j = score[i, c], i - 1 + shift - band + c - 1
        if now == score[i, c - 1]:
            c -= 1
        elif now == score[i - 1, c + 1]:
            i, c = i - 1, c + 1
        else:
            pairs.append((i - 1, j))
            i -= 1
        if c > width:
            c = width
    return pairs[::-1]


class Index:
    """Fingerprints of the templates: sorted hashes with the (template, position) pairs of each."""

    def __init__(self, templates: list[tuple[str, str]], k: int, window: int):
        self.names, self.k, self.window = [n for n, _ in templates], k, window
        raw = [t.encode() for _, t in templates]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        value, _, _, doc = words(data, offsets)
        self.words = [value[doc == i] for i in range(len(raw))]
        shingle, where, at = A.shingles(value, doc, len(raw), k)
        first = np.searchsorted(doc, np.arange(len(raw)))
        spots = defaultdict(list)
        size = np.bincount(doc, minlength=len(raw))
        every = np.flatnonzero(size[where] < SHORT)
        for p in np.union1d(winnow(shingle, where, window), every).tolist():
            spots[int(shingle[p])].append((int(where[p]), int(at[p] - first[where[p]])))
        self.spots = dict(spots)
        self.hashes = np.array(sorted(spots), dtype=np.uint64)


def scan(column: pa.Array, index: Index, least: float, band: int) -> list[tuple[int, str, float, int, int, int]]:
    """(row, template, coverage, matched words, start, end in characters) of every match."""
    data, offsets = A.texts_of(column)
    value, start, end, doc = words(data, offsets)
    shingle, where, at = A.shingles(value, doc, len(offsets) - 1, index.k)
    marks = np.arange(len(shingle))
    if not len(marks) or not len(index.hashes):
        return []
    near = index.hashes[np.minimum(np.searchsorted(index.hashes, shingle[marks]), len(index.hashes) - 1)]
    hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for p in marks[near == shingle[marks]].tolist():
        for template, position in index.spots[int(shingle[p])]:
            hits[int(where[p]), template].append((int(at[p]) - position, int(at[p])))
    chars = A.running((data & 0xC0) != 0x80)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    out = []
    for (d, template), found in sorted(hits.items()):
        wanted, upto = index.words[template], -1
        room = min(band, max(1, len(wanted) // 4))  # a short notice may stand again a few words on
        lo, hi = first[d], first[d + 1]
        found.sort()
        groups: list[list[int]] = []
        for diagonal, _ in found:  # diagonals within the room are one occurrence
            if groups and diagonal - groups[-1][0] <= room:
                groups[-1].append(diagonal)
            else:
                groups.append([diagonal])
        for g in groups:
            begin = max(lo, g[0] - room)
            part = value[begin : min(hi, g[-1] + len(wanted) + room)]
            pairs = banded(wanted, part, (g[0] + g[-1]) // 2 - begin, room)
            coverage = len(pairs) / len(wanted)
            if not pairs or coverage < (1 if index.names[template].startswith("SPDX ") else least):
                continue
            a, b = begin + pairs[0][1], begin + pairs[-1][1]
            if a <= upto or index.names[template].startswith("SPDX ") and not _ends_there(data, int(end[b]), int(offsets[d + 1])):
                continue
            upto = b
            base = chars[offsets[d]]
            out.append((d, index.names[template], coverage, len(pairs), int(chars[start[a]] - base), int(chars[end[b]] - base)))
    return best_apart(out)


def _ends_there(data: np.ndarray, end: int, stop: int) -> bool:
    """Whether an identifier that ends at byte ``end`` is not carried on by a hyphen, dot or plus and a letter or digit."""
    nxt = bytes(data[end : min(end + 2, stop)])
    return not (nxt[:1] == b"+" or nxt[:1] in (b"-", b".") and nxt[1:].isalnum())


def best_apart(found: list[tuple]) -> list[tuple]:
    """Of matches of a text that overlap, those with most words matched over words missed, best first."""
    out: dict[int, list[tuple]] = {}
    missed = lambda m: round(m[3] / m[2]) - m[3]
    for m in sorted(found, key=lambda m: (m[0], missed(m) - m[3], m[1], m[4])):
        kept = out.setdefault(m[0], [])
        if all(m[5] <= k[4] or m[4] >= k[5] for k in kept):
            kept.append(m)
    return sorted((m for kept in out.values() for m in kept), key=lambda m: (m[0], m[4]))


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = 3, window: int = 2, least: float = 0.8, band: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, template, coverage, n_matched, span_start, span_end): spans are code points of the text."""
    index = Index(templates, k, window)

    def run(batches):
        for batch in batches:
            for part in A.chunks(batch):
                rows = scan(part.column("text"), index, least, band)
                cols = list(zip(*rows)) if rows else [[] for _ in range(6)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())],
                                                 ["id", "template", "coverage", "n_matched", "span_start", "span_end"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, template string, coverage double, n_matched bigint, span_start bigint, span_end bigint")
    return out.withColumnRenamed("id", id_col)
