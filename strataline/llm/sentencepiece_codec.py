"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the vocabulary holds a white-space marker after another character, no merge can cross the border
before a marked word, so a text falls into chunks ("marker run + word") that are segmented independently.  Each batch
builds the table of its distinct chunks, segments each chunk once with the library and joins the ids back by position.
A worker keeps the table over its batches up to TABLE_ROWS chunks.  There is no shuffle; memory is bounded by a slice
of text plus the table.  With a vocabulary whose pieces do cross markers (or a normaliser that rewrites text), whole
texts go to the library instead.

Defined results: null text counts as empty; an empty text has the end id alone and decodes to the empty string;
a table that holds a chunk longer than TABLE_CHARS is dropped after its slice; repeated rows give repeated results; an empty table gives an
empty table; input columns named like an output are replaced.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_append

TABLE_ROWS, TABLE_CHARS = 120_000, 4096
MARK = "▁"
_RUNS = re.compile(" +[^ ]*")


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker; markers are written as spaces."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [c[1:] for c in _RUNS.findall(" " + text)]
    return text.split(" ")


class Codec:
    """Encoder and decoder over one model file; `splits` tells whether chunks are independent under that model."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.sp.id_to_piece(i) for i in range(len(self.sp))]
        self.marker = self.sp.piece_to_id(MARK)
        plain = [not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i)) for i in range(len(pieces))]
        self.piece = [p.replace(MARK, " ") if ok else "\0" for p, ok in zip(pieces, plain)]
        self.splits = (
            not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
            and [self.sp.encode(t, out_type=str) for t in ("  ", "ﬁ a", " a")]
            == [["▁" * 3] if "▁" * 3 in pieces else self.sp.encode("  ", out_type=str), ["▁", "ﬁ", "▁a"], ["▁", "▁a"]]
        )
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.decoded: list[str] = []
        self.flat, self.size = np.empty(0, np.int32), np.empty(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Segment each of the chunks once and add it to the table."""
        rows = [ids or [self.marker] for ids in self.sp.encode(new, num_threads=1)]  # the library drops the bare marker
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(chain.from_iterable(rows), np.int32, int(size.sum()))
        self.code.update(zip(new, range(len(self.decoded), len(self.decoded) + len(new))))
        piece = self.piece
        for ids in rows:
            text = "".join([piece[i] for i in ids])
            # a piece that is no plain text (a byte of a character, a control) decodes only with its neighbours
            self.decoded.append(text if "\0" not in text else " " + self.sp.decode(ids))
        self.flat, self.size = np.concatenate((self.flat, flat)), np.concatenate((self.size, size))

    def run(self, texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
        """Ids (with the end id) and decoded text of each text."""
        end = self.sp.eos_id()
        if not self.splits:
            rows = [self.sp.encode(t or "") + [end] for t in texts]
            return pa.array(rows, pa.list_(pa.int32())), pa.array([self.sp.decode(r) for r in rows], pa.string())
        split = [chunks(t or "") for t in texts]
        new = set(chain.from_iterable(split)).difference(self.code)
        if new:
            self.learn(sorted(new))
        code, decoded = self.code, self.decoded
        n = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter(map(code.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        words, ends = list(map(decoded.__getitem__, codes.tolist())), np.cumsum(n).tolist()
        out = ["".join(words[lo:hi])[1:] for lo, hi in zip([0, *ends], ends)]
        # one end id after the chunks of each text
        table, size = np.append(self.flat, np.int32(end)), np.append(self.size, 1)
        at = np.cumsum(size) - size
        codes = np.insert(codes, np.cumsum(n), len(size) - 1)
        lens = size[codes]
        stop = np.cumsum(lens)
        flat = table[np.arange(stop[-1]) + np.repeat(at[codes] - (stop - lens), lens)]
        rows = np.concatenate(([0], stop[np.cumsum(n + 1) - 1]))
        if len(decoded) > TABLE_ROWS or (new and max(map(len, new)) > TABLE_CHARS):
            self.clear()
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(flat, pa.int32())), pa.array(out, pa.string())


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """docs with `ids` (array of int, end id last) and `decoded` (the ids decoded again)."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), True)), T.StructField("decoded", T.StringType())]
    state: list[Codec] = []

    def fn(batch):
        if not state:
            state.append(Codec(model_path))
        return list(state[0].run(batch.column(text_col).to_pylist()))

    return arrow_append(docs, fields, text_col, fn, done=state.clear)
