"""Removal of repeated word windows by prefix-partitioned suffix trees.

Words covered by a window of 20 words whose sequence also starts earlier (smaller id, or the same document further up)
are removed.  `passages` finds the runs of windows that can repeat and deals them to tasks by a short stretch of words that
they share (eight words), or, where that has too many suffixes for one task, by all their words; here the suffixes of an
owner's contexts are split by their first words, prefix by prefix: a group too large for memory is split by one more word,
a group with a single suffix is a leaf edge and done.  Each memory-sized group becomes a subtree, built level by level down
to depth 20; its internal nodes at that depth are the repeats, and all leaves but the earliest are removed.

Defined results: null texts have no words; documents of fewer words keep everything; null ids come before all others;
equal rows (same id and text) are in the same place, neither is earlier; repeated rows give repeated results; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import hash_bytes, mix64, word_arrays
from .passages import Removals, Rule, Symbols, find, finished

LENGTH, GRAM = 20, 8
#: Suffixes of one subtree group; larger ones are split by a longer prefix.
GROUP = 1_000_000


def _read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, codes, words = word_arrays(texts, lower=False)
    hashed = mix64(hash_bytes(words.to_pylist())) if len(words) else np.empty(0, np.uint64)
    return hashed[codes], offsets


def _cut(text: str):
    words = text.encode().split()
    return lambda a, b: b" ".join(words[a:b])


def _whole(text: str) -> tuple[int, bytes]:
    words = text.encode().split()
    return len(words), b" ".join(words)


WORDS = Symbols(_read, _whole, _cut)


def deep_nodes(codes: np.ndarray, at: np.ndarray, depth: int, length: int, limit: int, node: np.ndarray | None = None):
    """Yield (suffixes, node numbers) of the internal nodes at depth `length` over the suffixes at[...].

    Suffixes share their first `depth` words within a node.  Going one word deeper splits nodes; single leaves go.
    """
    index = np.arange(len(at))
    node = np.zeros(len(at), np.int64) if node is None else node
    vocabulary = int(codes.max(initial=0)) + 1
    while True:
        if not len(index):
            return
        if depth == length:
            yield index, node
            return
        if len(index) > limit and depth and node.max(initial=0) > 0:
            # pieces of whole nodes of about `limit` suffixes, each with its own, longer prefixes
            order = np.argsort(node, kind="stable")
            index, node = index[order], node[order]
            ends = np.flatnonzero(np.append(node[1:] != node[:-1], True)) + 1
            cuts = np.unique(np.concatenate((ends[np.searchsorted(ends, np.arange(limit, len(index), limit))], [len(index)])))
            if len(cuts) > 1:
                for lo, hi in zip(np.concatenate(([0], cuts[:-1])), cuts):
                    part, sub = index[lo:hi], node[lo:hi] - node[lo]
                    for found, number in deep_nodes(codes, at[part], depth, length, limit, sub):
                        yield part[found], number
                return
        key = node * vocabulary + codes[at[index] + depth]
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1
        index, number = index[order][keep], number[keep]
        node = np.cumsum(np.concatenate(([False], number[1:] != number[:-1]))) if len(number) else number
        depth += 1


def match(contexts: list[bytes], group: np.ndarray, ids: np.ndarray, lo: np.ndarray, span: np.ndarray, length: int = LENGTH, limit: int = GROUP) -> np.ndarray:
    """Per window of every context: whether the same words start earlier."""
    offsets, codes, _ = word_arrays(pa.array(contexts, pa.binary()).cast(pa.string()), lower=False)
    step = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
    at = np.repeat(offsets[:-1], span) + step
    owner, place = np.repeat(ids, span), np.repeat(lo, span) + step
    flags = np.zeros(len(at), bool)
    for found, node in deep_nodes(codes, at, 0, length, limit):
        order = np.lexsort((place[found], owner[found], node))
        f, n = found[order], node[order]
        new = np.ones(len(n), bool)
        new[1:] = n[1:] != n[:-1]
        head = f[np.flatnonzero(new)[np.cumsum(new) - 1]]
        flags[f[(owner[f] != owner[head]) | (place[f] != place[head])]] = True
    return flags


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Removals:
    return find(docs, id_col, text_col, WORDS, Rule(same_document=True), LENGTH, GRAM, match)


def _rest(text: str, cut: list[tuple[int, int]]) -> bytes:
    words, at, parts = text.encode().split(), 0, []
    for a, b in cut:
        parts += words[at:a]
        at = b
    return b" ".join(parts + words[at:])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n (words), n_removed, n_spans, kept_sha256, kept (remaining words where some were removed, else null)."""
    return finished(find_repeats(docs, id_col, text_col), _rest)
