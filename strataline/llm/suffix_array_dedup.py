"""Removal of repeated byte strings by a hash-compared suffix sort.

Bytes covered by a 50-byte string that also starts in a document with a smaller id are removed.  `passages` finds the
runs of windows that can repeat and brings their contexts together; here the suffixes of contexts that differ are
sorted: prefix polynomial hashes give the hash of any stretch, binary search over hashes gives the common extension of
two suffixes, so a comparison costs log2(length) hash look-ups whatever the texts.  A bottom-up mergesort (ranks in the
other run by binary search, all suffixes at once) orders them within their anchor; neighbours with a common extension
of the whole length form one string, and each such pair is verified byte by byte; a class of strings that hashes took for
one although bytes differ is split by its bytes.

Defined results: null texts count as empty; texts shorter than the length keep everything; rows that share a doc_id are
not removed for each other's sake; null ids come before all others; repeated rows give repeated results; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import mix64
from .passages import Removals, Rule, Symbols, find, finished, powers, prefix_hashes

LENGTH, GRAM = 50, 20
_CODE = mix64(np.arange(1, 257, dtype=np.uint64))


def _read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = texts.cast(pa.binary()) if not len(texts) else pc.fill_null(texts, "").cast(pa.binary())
    if not len(rows):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset: rows.offset + len(rows) + 1].astype(np.int64)
    data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
    return _CODE[data], offsets - offsets[0]


def _cut(text: str):
    raw = text.encode()
    return lambda a, b: raw[a:b]


BYTES = Symbols(_read, lambda t: (len(r := t.encode()), r), _cut, slice_bytes=768 << 10)  # a symbol takes 8 bytes, in some ten arrays


class Suffixes:
    """Comparison of suffixes of one buffer, cut at `length`, through prefix hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.n = data, length, len(data)
        self.pw = powers(self.n)
        self.p = prefix_hashes(_CODE[data], self.pw)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, up to `length`, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length, np.int64)
        wa, wb, pa_, pb = self.pw[self.n - a], self.pw[self.n - b], self.p[a], self.p[b]
        while True:
            todo = low < high
            if not todo.any():
                return low
            mid = (low + high + 1) >> 1
            same = (self.p[a + mid] - pa_) * wa == (self.p[b + mid] - pb) * wb
            low, high = np.where(todo & same, mid, low), np.where(todo & ~same, mid - 1, high)

    def less(self, a: np.ndarray, b: np.ndarray, equal: bool) -> np.ndarray:
        """Whether suffix a sorts before b (with `equal`: or alongside)."""
        n = self.common(a, b)
        whole = n >= self.length
        at = np.minimum(n, self.length - 1)
        return np.where(whole, equal, self.data[a + at] < self.data[b + at])

    def sort(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Order of the suffixes within segments (given sorted): bottom-up mergesort, ranks by binary search."""
        n = len(at)
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1]))) if n else np.empty(0, np.int64)
        size = np.diff(np.append(first, n))
        begin, stop = np.repeat(first, size), np.repeat(first + size, size)
        now, width, index = at.copy(), 1, np.arange(n)
        perm = np.arange(n)
        while size.max(initial=0) > width:
            live = np.flatnonzero(stop - begin > width)
            inside = index[live] - begin[live]
            block = inside // width
            left = block % 2 == 0
            lo = begin[live] + np.where(left, block + 1, block - 1) * width
            hi = np.minimum(lo + width, stop[live])
            lo = np.minimum(lo, hi)
            base, own = lo.copy(), now[live]
            home = begin[live] + (block - block % 2) * width
            while True:
                todo = np.flatnonzero(lo < hi)
                if not len(todo):
                    break
                mid = (lo[todo] + hi[todo]) >> 1
                other, mine = now[mid], own[todo]
                # a left element counts smaller ones of the right run, a right one also equal ones of the left run
                before = np.empty(len(todo), bool)
                on = left[todo]
                before[on] = self.less(other[on], mine[on], False)
                before[~on] = self.less(other[~on], mine[~on], True)
                lo[todo] = np.where(before, mid + 1, lo[todo])
                hi[todo] = np.where(before, hi[todo], mid)
            target = home + inside % width + (lo - base)
            fresh, order = now.copy(), perm.copy()
            fresh[target], order[target] = own, perm[live]
            now, perm, width = fresh, order, width * 2
        return perm


def match(contexts: list[bytes], group: np.ndarray, ids: np.ndarray, lo: np.ndarray, span: np.ndarray, length: int = LENGTH, chunk: int = 400_000) -> np.ndarray:
    """Per window of every context: whether the same bytes start in a document with a smaller id."""
    begin = np.cumsum(span) - span
    flags = np.zeros(int(span.sum()), bool)
    order = np.argsort(group, kind="stable")
    g = group[order]
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.empty(0, np.int64)
    size = np.diff(np.append(starts, len(g)))
    smallest, largest = (np.minimum.reduceat(ids[order], starts), np.maximum.reduceat(ids[order], starts)) if len(g) else (ids, ids)
    asked = order[np.repeat((size > 1) & (smallest < largest), size)]
    # whole groups at a time, so that the buffers stay bounded
    cost = np.cumsum(span[asked])
    piece = cost // chunk
    piece = np.maximum.accumulate(np.where(np.concatenate(([True], group[asked][1:] != group[asked][:-1])), piece, 0)) if len(asked) else piece
    for part in np.split(asked, np.flatnonzero(np.diff(piece)) + 1) if len(asked) else []:
        data = np.frombuffer(b"".join([contexts[i] for i in part]), np.uint8)
        lens = np.array([len(contexts[i]) for i in part])
        at = np.cumsum(lens) - lens
        times = span[part]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pos = np.repeat(at, times) + step
        window = np.repeat(begin[part], times) + step
        owner, anchor = np.repeat(ids[part], times), np.repeat(group[part], times)
        head = np.zeros(len(pos), np.uint64)
        for j in range(8):  # segments: the anchor and the first eight bytes
            head = (head << np.uint64(8)) | data[pos + j].astype(np.uint64)
        by = np.lexsort((owner, head, anchor))
        pos, window, owner, head, anchor = pos[by], window[by], owner[by], head[by], anchor[by]
        new = np.ones(len(pos), bool)
        new[1:] = (head[1:] != head[:-1]) | (anchor[1:] != anchor[:-1])
        tree = Suffixes(data, length)
        perm = tree.sort(pos, np.cumsum(new))
        pos, window, owner = pos[perm], window[perm], owner[perm]
        segment = np.cumsum(new)  # the sort stays within segments
        same = np.zeros(len(pos), bool)
        if len(pos) > 1:
            near = np.flatnonzero(segment[1:] == segment[:-1])
            near = near[tree.common(pos[near], pos[near + 1]) >= length]
            ok = np.ones(len(near), bool)
            for i in range(0, len(near), 20_000):
                a, b = near[i: i + 20_000], near[i: i + 20_000] + 1
                span_ = np.arange(length)
                ok[i: i + 20_000] = (data[pos[a][:, None] + span_] == data[pos[b][:, None] + span_]).all(1)
            same[near + 1] = True
            number = np.cumsum(~same) - 1
            for wrong in np.unique(number[near[~ok]]).tolist():  # different strings of one hash: bytes tell them apart
                members = np.flatnonzero(number == wrong)
                _, by_bytes = np.unique(data[pos[members][:, None] + np.arange(length)], axis=0, return_inverse=True)
                number[members] = np.where(by_bytes.ravel() > 0, number.max() + by_bytes.ravel(), wrong)
        else:
            number = np.zeros(len(pos), np.int64)
        least = np.full(int(number.max()) + 1, np.iinfo(np.int64).max, np.int64)
        np.minimum.at(least, number, owner)
        flags[window[owner > least[number]]] = True
    return flags


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Removals:
    return find(docs, id_col, text_col, BYTES, Rule(same_document=False), LENGTH, GRAM, match)


def _rest(text: str, cut: list[tuple[int, int]]) -> bytes:
    raw, at, parts = text.encode(), 0, []
    for a, b in cut:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n (bytes), n_removed, n_spans, kept_sha256, kept (remaining bytes where some were removed, else null)."""
    return finished(find_repeats(docs, id_col, text_col), _rest)
