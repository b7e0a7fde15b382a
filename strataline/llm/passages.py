"""Finding repeated passages: the distributed part that the two substring operators share.

A passage is a window of `length` symbols (bytes, or words).  Windows are never shuffled one by one:

A. Every window is assigned the smallest hash among its k-grams (its anchor); equal
   windows have equal anchors, so runs of windows with one anchor stay together.  Each slice of text sends every distinct
   anchor once, packed, to the anchor's owner (owners hold ranges of anchor hashes); anchors that repeat within the
   slice are known to be shared already and send one entry, whatever their number.  Owners answer which runs are shared,
   and which anchors have more than HOT_CONTEXTS different contexts.
B. Shared runs send their context (the symbols of the run's windows) to owners, again once per distinct context and
   slice; copies within the slice are settled on the spot.  Where an anchor is hot, no owner gets all of its contexts: each
   window goes by itself, to the owner of the hash of all its symbols.  Owners settle equal contexts, and hand the
   remaining distinct ones to the operator's own matcher, which decides window by window on the symbols themselves.
C. Spans come back per document and are merged.

An owner keeps its messages packed and goes through them in passes over parts of its hashes, so that what it has unpacked
at a time is bounded (PASS_RUNS, PASS_WINDOWS), whatever the size of its partition.

Rows travel as (id, rid); rid is a hash of id and text, so rows that share a doc_id keep apart unless they are equal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL_TABLE, discard, hash_bytes, materialize, mix64, release, slices, small_batches, spread

#: Runs that a task gathers before it sends them to their owners.
MESSAGE_RUNS = 500_000
#: Distinct contexts that a task gathers before it sends them.
MESSAGE_CONTEXTS = 150_000
#: Different contexts (added up over messages) from which an anchor's windows are dealt one by one.
HOT_CONTEXTS = 5_000
#: Runs, and windows of contexts, that an owner unpacks at a time.
PASS_RUNS, PASS_WINDOWS = 4_000_000, 1_500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes, compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    head = np.array([len(arrays[0]), *[ord(a.dtype.kind) * 16 + a.itemsize for a in arrays]], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(head)).tobytes() + head.tobytes() + b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    size = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, size, 8)
    n, at, out = int(head[0]), 8 + 8 * size, []
    for code in head[1:].tolist():
        width = code % 16
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(np.dtype(f"{chr(code // 16)}{width}")).reshape(n))
        at += n * width
    return out


def packed_rows(blob: bytes) -> int:
    """Length of the packed arrays."""
    with zstandard.ZstdDecompressor().stream_reader(blob) as data:
        return int(np.frombuffer(data.read(16), np.int64)[1])


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def prefix_hashes(symbols: np.ndarray, pw: np.ndarray) -> np.ndarray:
    """P with (P[j] - P[i]) * INVERSE ** i a polynomial hash of symbols[i:j], wherever it stands."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * pw[: len(symbols)], dtype=np.uint64)))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    m, s = x, 1
    while 2 * s <= w:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    n = len(x) - w + 1
    return np.minimum(m[:n], m[w - s: w - s + n]) if s < w else m


def runs(symbols: np.ndarray, offsets: np.ndarray, length: int, k: int, inner: bool) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (anchor hash, row, first start in the row, windows, holds an anchor twice, context hash)."""
    none = np.empty(0, np.int64)
    n, width = len(symbols), length - k + 1
    if n < length:
        return none.astype(np.uint64), none, none, none, none.astype(bool), none.astype(np.uint64)
    p, back = prefix_hashes(symbols, powers(n)), powers(n - k, INVERSE)
    grams = mix64((p[k:] - p[: n - k + 1]) * back)
    low = sliding_min(grams, width)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    last = len(low)
    ok = row[:last] == row[length - 1:]
    cut = np.ones(last, bool)
    cut[1:] = (low[1:] != low[:-1]) | ~ok[:-1] | (row[1:last] != row[: last - 1])
    # a run also ends after 2 * width windows, which only texts that repeat at short distance reach
    start = np.flatnonzero(cut)
    since = np.arange(last) - np.repeat(start, np.diff(np.append(start, last)))
    start = np.flatnonzero(ok & (since % (2 * width) == 0))
    stops = np.flatnonzero((since % (2 * width) == 0) | ~ok)
    end = np.append(stops, last)[np.searchsorted(stops, start, "right")]
    # anchors that occur twice within a run: same gram again at a short distance
    twice = np.zeros(len(start), bool)
    context = (p[end - 1 + length] - p[start]) * back[start] + (end - start).astype(np.uint64)
    if not inner:
        return mix64(low[start]), row[start], start - offsets[row[start]], end - start, twice, context
    order = np.argsort(grams, kind="stable")
    again = order[1:][(grams[order[1:]] == grams[order[:-1]]) & (order[1:] - order[:-1] < 3 * width)]
    if len(again):
        for before in range(width + 2):  # the runs that can cover such a position
            at = np.searchsorted(start, again, "right") - 1 - before
            good = at >= 0
            hit = at[good]
            twice[hit[low[start[hit]] == grams[again[good]]]] = True
    # smallest hashes crowd near zero: mixed again, they spread evenly over the owners
    return mix64(low[start]), row[start], start - offsets[row[start]], end - start, twice, context


@dataclass(frozen=True)
class Symbols:
    """How texts are read: symbols and offsets of a column, the digest input of a whole text, and context bytes."""

    read: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    whole: Callable[[str], tuple[int, bytes]]
    cut: Callable[[str], Callable[[int, int], bytes]]
    slice_bytes: int = 2 << 20


@dataclass(frozen=True)
class Rule:
    """What counts as earlier: any earlier place (by id, then position), or only a smaller id."""

    same_document: bool


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n hash partitions an int that Spark deals to it."""
    rows = spark.range(0, 40 * n + 200).select(F.col("id").cast("int").alias("k")).select(
        "k", F.pmod(F.hash("k"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("k")).collect()
    found = dict((r[0], r[1]) for r in rows)
    return [found.get(p, p) for p in range(n)]


def _owner(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


RUN = "key int, blob binary, id long, rid long, n long, sha string, h long, lo int, span int"


def _rows(count: int, schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)


RUN_SCHEMA = pa.schema([("key", pa.int32()), ("blob", pa.binary()), ("id", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("sha", pa.string()), ("h", pa.int64()), ("lo", pa.int32()), ("span", pa.int32())])


def shared_runs(docs: DataFrame, symbols: Symbols, rule: Rule, length: int, k: int) -> DataFrame:
    """Step A: light rows (id, rid, n, sha) of all documents, (id, rid, h, lo, span) of shared runs, (h, n) of hot anchors."""
    import hashlib

    spark = docs.sparkSession
    parts = spread(spark)
    keys = np.array(partition_keys(spark, parts), np.int32)

    def emit(ids, rids, h, row, lo, span, twice, context):
        """Known shared runs as rows, and one packed message per owner, from the runs of some slices."""
        order = np.lexsort((row, h))
        h, row, lo, span, twice, context = (x[order] for x in (h, row, lo, span, twice, context))
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        number = np.cumsum(first) - 1
        if rule.same_document:
            known = (np.bincount(number)[number] > 1) | twice
        else:  # in more than one document
            known = np.zeros(len(h), bool)
            known[1:] = ~first[1:] & (row[1:] != row[:-1])
        # a group with any known run is known as a whole
        some = np.zeros(number[-1] + 1, bool)
        some[number[known]] = True
        known = some[number]
        at = np.flatnonzero(known)
        for i in range(0, len(at), 100_000):
            k = at[i: i + 100_000]
            yield _rows(len(k), RUN_SCHEMA, key=keys[rids[row[k]] % parts], id=ids[row[k]], rid=rids[row[k]],
                        h=(h[k] >> np.uint64(16) << np.uint64(16)).view(np.int64), lo=lo[k].astype(np.int32), span=span[k].astype(np.int32))
        # different contexts of the anchors that send one entry for all their runs
        pairs = at[np.lexsort((context[at], number[at]))]
        new = np.ones(len(pairs), bool)
        new[1:] = (number[pairs[1:]] != number[pairs[:-1]]) | (context[pairs[1:]] != context[pairs[:-1]])
        several = np.bincount(number[pairs[new]], minlength=number[-1] + 1).astype(np.uint32)
        sent = ~known | first
        times = np.where(known, several[number], 1).astype(np.uint32)[sent]
        h, row, lo, span, known = (x[sent] for x in (h, row, lo, span, known))
        edges = np.searchsorted(_owner(h, parts), np.arange(parts + 1))
        blobs, to = [], []
        for p in range(parts):
            a, b = edges[p], edges[p + 1]
            if a < b:
                used, place = np.unique(row[a:b], return_inverse=True)
                delta = np.diff(h[a:b] >> np.uint64(16), prepend=np.uint64(0))  # 48 bits choose runs; contexts decide
                run = pack(delta, place.astype(np.uint16 if len(used) < 65536 else np.uint32), lo[a:b].astype(np.uint32), span[a:b].astype(np.uint8), known[a:b], times[a:b])
                blobs.append(len(run).to_bytes(4, "little") + run + pack(ids[used], rids[used]))
                to.append(int(keys[p]))
        for i in range(0, len(blobs), 256):
            yield _rows(len(blobs[i: i + 256]), RUN_SCHEMA, key=to[i: i + 256], blob=blobs[i: i + 256])

    def send(batches):
        held, docs_held, rows, size = [], [], 0, 0

        def flush():
            if held:
                ids, rids = (np.concatenate(x) for x in zip(*docs_held))
                columns = [np.concatenate(x) for x in zip(*held)]
                held.clear(), docs_held.clear()
                yield from emit(ids, rids, *columns)

        for whole in batches:
            for batch in slices(whole, "text", symbols.slice_bytes):
                texts = batch.column("text")
                ids, rids = (np.asarray(batch.column(c)) for c in ("id", "rid"))
                digest = [(n, hashlib.sha256(b).hexdigest()) for n, b in map(symbols.whole, texts.to_pylist())]
                yield _rows(len(ids), RUN_SCHEMA, key=keys[rids % parts], id=ids, rid=rids, n=[n for n, _ in digest], sha=[d for _, d in digest])
                flat, offsets = symbols.read(texts)
                h, row, lo, span, twice, context = runs(flat, offsets, length, k, rule.same_document)
                del flat
                docs_held.append((ids.copy(), rids.copy()))
                if len(h):
                    held.append((h, (row + rows).astype(np.int32), lo.astype(np.int32), span.astype(np.uint8), twice, context))
                rows, size = rows + len(ids), size + len(h)
                if size >= MESSAGE_RUNS:
                    yield from flush()
                    rows = size = 0
        yield from flush()
        release()

    def own(batches):
        held: list[bytes] = []
        for batch in batches:
            blob = batch.column("blob")
            held += [b for b in blob.to_pylist() if b is not None]
            rest = batch.filter(blob.is_null())
            if rest.num_rows:
                yield rest
        if not held:
            return
        tables, total = [], 0
        for i, blob in enumerate(held):
            size = int.from_bytes(blob[:4], "little")
            tables.append(unpack(blob[4 + size:]))
            held[i] = blob[4: 4 + size]
            total += packed_rows(held[i])
        start = np.cumsum([0] + [len(t[0]) for t in tables])
        ids, rids = np.concatenate([t[0] for t in tables]), np.concatenate([t[1] for t in tables])
        del tables
        passes = -(-total // PASS_RUNS)
        for turn in range(passes):
            yield from answer(held, start, ids, rids, turn, passes)
        release()

    def answer(held, start, ids, rids, turn, passes):
        """What an owner says to a part of its anchors."""
        columns = []
        for i, blob in enumerate(held):
            delta, place, lo, span, known, times = unpack(blob)
            h = np.cumsum(delta, dtype=np.uint64)
            some = slice(None) if passes == 1 else mix64(h) % np.uint64(passes) == turn
            columns.append((h[some], np.full(len(h), i, np.uint32)[some], *(x[some] for x in (place.astype(np.uint32), lo, span, known, times))))
        h, which, place, lo, span, known, times = (np.concatenate(x) for x in zip(*columns))
        del columns
        if not len(h):
            return
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        number = np.cumsum(new) - 1
        flag = known[order]
        shared = np.zeros(number[-1] + 1, bool)
        shared[number[flag]] = True
        if rule.same_document:
            shared |= np.bincount(number) > 1
        else:  # in more than one document
            w, p = which[order], place[order]
            other = np.zeros(len(s), bool)
            other[1:] = ~new[1:] & ((w[1:] != w[:-1]) | (p[1:] != p[:-1]))
            shared[number[other]] = True
        contexts = np.bincount(number, weights=times[order]).astype(np.int64)
        hot = np.flatnonzero(contexts > HOT_CONTEXTS)
        if len(hot):
            yield _rows(len(hot), RUN_SCHEMA, h=(s[new][hot] << np.uint64(16)).view(np.int64), n=contexts[hot])
        take = order[shared[number] & ~flag]
        at = start[which[take]] + place[take]
        for i in range(0, len(take), 100_000):
            part, here = take[i: i + 100_000], at[i: i + 100_000]
            yield _rows(len(part), RUN_SCHEMA, id=ids[here], rid=rids[here], h=(h[part] << np.uint64(16)).view(np.int64), lo=lo[part].astype(np.int32), span=span[part].astype(np.int32))

    sent = docs.select("id", "rid", "text").mapInArrow(send, RUN)
    owned = sent.repartition(parts, "key").mapInArrow(own, RUN)
    return materialize(owned.select("id", "rid", "n", "sha", "h", "lo", "span"), "runs")


SPAN = "key int, blob binary, id long, rid long, a int, b int"
SPAN_SCHEMA = pa.schema([("key", pa.int32()), ("blob", pa.binary()), ("id", pa.int64()), ("rid", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def settle(context: np.ndarray, ids: np.ndarray, lo: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(repeats, representative) of runs whose contexts are numbered: repeats are covered as a whole by an earlier one."""
    order = np.lexsort((lo, ids, context))
    c, i, p = context[order], ids[order], lo[order]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = i > i[head]
    if rule.same_document:
        later |= (i == i[head]) & (p > p[head])
    repeats, keep = np.empty(len(c), bool), np.empty(len(c), bool)
    repeats[order] = later
    # those not later are alike (same document, or same place): all of them are asked on behalf of themselves
    keep[order] = ~later
    return repeats, keep


def spans(touched: DataFrame, symbols: Symbols, rule: Rule, length: int, match: Callable, hot: np.ndarray) -> DataFrame:
    """Step B: (id, rid, a, b) symbol spans to remove.  touched: id, rid, text, runs (array of h, lo, span).  hot: sorted anchors.

    match(contexts, group, ids, lo, span) gives for every context the flags of its windows, as one flat array.
    """
    spark = touched.sparkSession
    parts = spread(spark)
    keys = np.array(partition_keys(spark, parts), np.int32)

    def emit(contexts, number, h, ids, rids, row, lo, span):
        """Spans settled here, and the contexts that others must see, from some slices."""
        repeats, keep = settle(number, ids, lo, rule)
        if repeats.any():
            r = np.flatnonzero(repeats)
            r = r[np.lexsort((lo[r], row[r]))]
            a, b = lo[r], lo[r] + span[r] - 1 + length
            top = np.maximum.accumulate(b + row[r] * (1 << 40))  # spans that touch within a row become one
            new = np.ones(len(r), bool)
            new[1:] = (a + row[r] * (1 << 40))[1:] > top[:-1]
            head = np.flatnonzero(new)
            ends = np.append(head[1:], len(r)) - 1
            yield _rows(len(head), SPAN_SCHEMA, key=keys[rids[r[head]] % parts], id=ids[r[head]], rid=rids[r[head]], a=a[head].astype(np.int32), b=(top[ends] - row[r[ends]] * (1 << 40)).astype(np.int32))
        k = np.flatnonzero(keep)
        k = k[np.lexsort((number[k], h[k]))]
        edges = np.searchsorted(_owner(h[k], parts), np.arange(parts + 1))
        blobs, to = [], []
        for p in range(parts):
            mine = k[edges[p]: edges[p + 1]]
            if len(mine):
                # a context that several runs of one document share is written once: the length 0 repeats the one before
                again = np.zeros(len(mine), bool)
                again[1:] = number[mine[1:]] == number[mine[:-1]]
                own_contexts = [contexts[i] for i in number[mine[~again]]]
                lens = np.zeros(len(mine), np.uint32)
                lens[~again] = [len(c) for c in own_contexts]
                head = pack(h[mine], ids[mine], rids[mine], lo[mine].astype(np.uint32), span[mine].astype(np.uint16), lens)
                body = zstandard.ZstdCompressor(level=1).compress(b"".join(own_contexts))
                blobs.append(len(head).to_bytes(4, "little") + head + body)
                to.append(int(keys[p]))
        for i in range(0, len(blobs), 64):
            yield _rows(len(blobs[i: i + 64]), SPAN_SCHEMA, key=to[i: i + 64], blob=blobs[i: i + 64])

    def send(batches):
        numbers: dict[bytes, int] = {}
        held, rows = [], 0

        def flush():
            nonlocal numbers
            if held:
                columns = [np.concatenate(x) for x in zip(*held)]
                held.clear()
                yield from emit(list(numbers), *columns)
            numbers = {}

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                column = batch.column("runs")
                sizes = np.diff(np.asarray(column.offsets))
                flat = column.flatten()
                h = np.asarray(flat.field("h")).view(np.uint64)
                lo, span = (np.asarray(flat.field(c)).astype(np.int64) for c in ("lo", "span"))
                row = np.repeat(np.arange(len(sizes)), sizes)
                alone = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
                if alone.any():  # the windows of a hot anchor's runs, one by one
                    times = np.where(alone, span, 1)
                    from_run = np.repeat(np.arange(len(h)), times)
                    step = np.arange(len(from_run)) - np.repeat(np.cumsum(times) - times, times)
                    alone, h, row = alone[from_run], h[from_run], row[from_run]
                    lo, span = lo[from_run] + np.where(alone, step, 0), np.where(alone, 1, span[from_run])
                    sizes = np.bincount(row, minlength=len(sizes))
                ids, rids = (np.asarray(batch.column(c))[row] for c in ("id", "rid"))
                number, by_itself, at = [], [], 0
                for text, n in zip(batch.column("text").to_pylist(), sizes.tolist()):
                    cut = symbols.cut(text)
                    for a, s, w in zip(lo[at: at + n].tolist(), span[at: at + n].tolist(), alone[at: at + n].tolist()):
                        context = cut(a, a + s - 1 + length)
                        number.append(numbers.setdefault(context, len(numbers)))
                        if w:
                            by_itself.append(context)
                    at += n
                if by_itself:
                    h = h.copy()
                    h[alone] = mix64(hash_bytes(by_itself))
                if number:
                    held.append((np.array(number, np.int64), h, ids, rids, row + rows, lo, span))
                rows += len(sizes)
                if len(numbers) >= MESSAGE_CONTEXTS:
                    yield from flush()
        yield from flush()
        release()

    def own(batches):
        held: list[bytes] = []
        for batch in batches:
            blob = batch.column("blob")
            held += [b for b in blob.to_pylist() if b is not None]
            rest = batch.filter(blob.is_null())
            if rest.num_rows:
                yield rest
        if not held:
            return
        heads, windows = [], 0
        for i, blob in enumerate(held):
            size = int.from_bytes(blob[:4], "little")
            heads.append(blob[4: 4 + size])
            held[i] = blob[4 + size:]
            columns = unpack(heads[-1])
            windows += int(columns[4].astype(np.int64).sum())
        passes = max(1, -(-windows // PASS_WINDOWS))
        for turn in range(passes):
            yield from decide(heads, held, turn, passes)
        release()

    def decide(packed, bodies, turn, passes):
        """The spans that an owner finds in a part of its contexts."""
        heads, numbers, contexts, number = [], {}, [], []
        for head, blob in zip(packed, bodies):
            columns = unpack(head)
            mine = np.ones(len(columns[0]), bool) if passes == 1 else mix64(columns[0]) % np.uint64(passes) == turn
            if not mine.any():
                continue
            heads.append([x[mine] for x in columns])
            body = zstandard.ZstdDecompressor().decompress(blob)
            ends = np.cumsum(columns[5].astype(np.int64)).tolist()
            for a, b, on in zip([0, *ends], ends, mine.tolist()):
                if not on:  # runs of one context have one anchor, so a repeat never follows a context that is left out
                    continue
                if a == b:
                    number.append(number[-1])
                    continue
                c = body[a:b]
                i = numbers.setdefault(c, len(contexts))
                if i == len(contexts):
                    contexts.append(c)
                number.append(i)
        if not heads:
            return
        del numbers
        h, ids, rids, lo, span, _ = (np.concatenate(x) for x in zip(*heads))
        lo, span, number = lo.astype(np.int64), span.astype(np.int64), np.array(number, np.int64)
        repeats, keep = settle(number, ids, lo, rule)
        # distinct contexts are matched once, for their first place; other runs alike (same document) get its flags
        order = np.lexsort((lo, ids, number))
        first = order[np.searchsorted(number[order], np.arange(len(contexts)))]
        flags = match(contexts, h[first], ids[first], lo[first], span[first])
        begin = np.cumsum(span[first]) - span[first]
        r = np.flatnonzero(repeats)
        out = [(r, lo[r], lo[r] + span[r] - 1 + length)]
        on = np.concatenate(([False], flags, [False]))
        # runs of flagged windows, cut at the borders of contexts
        edge = np.zeros(len(flags) + 1, bool)
        edge[begin] = True
        up = np.flatnonzero(flags & (~on[:-2] | edge[:-1]))
        down = np.flatnonzero(flags & (~on[2:] | edge[1:]))
        owner_context = np.searchsorted(begin, up, "right") - 1
        k = np.flatnonzero(keep)
        per = np.bincount(owner_context, minlength=len(contexts))
        at = np.cumsum(per) - per
        times = per[number[k]]
        who = np.repeat(k, times)
        piece = np.repeat(at[number[k]], times) + np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
        shift = lo[who] - begin[number[who]]
        out.append((who, up[piece] + shift, down[piece] + shift + length))
        for who, a, b in out:
            for i in range(0, len(who), 100_000):
                w = who[i: i + 100_000]
                yield _rows(len(w), SPAN_SCHEMA, id=ids[w], rid=rids[w], a=a[i: i + 100_000].astype(np.int32), b=b[i: i + 100_000].astype(np.int32))

    return touched.mapInArrow(send, SPAN).repartition(parts, "key").mapInArrow(own, SPAN).select("id", "rid", "a", "b")


def merged(rows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(rows):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@dataclass(frozen=True)
class Removals:
    """light: id, rid, n, sha of every row; touched: id, rid, text, spans (array of a, b) of rows that lose symbols."""

    light: DataFrame
    touched: DataFrame


def find(docs: DataFrame, id_col: str, text_col: str, symbols: Symbols, rule: Rule, length: int, k: int, match: Callable) -> Removals:
    """All three steps.  Null texts count as empty; null ids come before all others."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = small_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), text.alias("text")).withColumn("rid", F.xxhash64("id", "text"))
    found = shared_runs(keyed, symbols, rule, length, k)
    light = materialize(found.where("sha IS NOT NULL").select("id", "rid", "n", "sha"), "whole-texts")
    # at most SMALL_TABLE of them: the largest, should there be more
    hot = np.array([r["h"] for r in found.where("h IS NOT NULL AND span IS NULL").orderBy(F.desc("n"), "h").limit(SMALL_TABLE).collect()], np.int64).view(np.uint64)
    hot.sort()
    lists = found.where("span IS NOT NULL").groupBy("rid", "id").agg(F.collect_set(F.struct("h", "lo", "span")).alias("runs"))
    touched = materialize(keyed.join(lists, ["rid", "id"]).select("id", "rid", "text", "runs"), "touched")
    discard(found)
    # written first: the contexts' shuffle is gone before texts move again
    pieces = materialize(spans(touched, symbols, rule, length, match, hot), "spans")
    cut = pieces.groupBy("rid", "id").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return Removals(light, touched.select("id", "rid", "text").join(cut, ["rid", "id"]).select("id", "rid", "text", "spans"))


def finished(removals: Removals, rest: Callable[[str, list[tuple[int, int]]], tuple[int, bytes]]) -> DataFrame:
    """id, n, n_removed, n_spans, kept_sha256, kept (the remaining text of rows that lost symbols, else null) per row."""
    import hashlib

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                cut = [merged([(s["a"], s["b"]) for s in x]) for x in batch.column("spans").to_pylist()]
                kept = [rest(t, c) for t, c in zip(batch.column("text").to_pylist(), cut)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"), batch.column("rid"), pa.array([sum(b - a for a, b in c) for c in cut], pa.int64()),
                    pa.array([len(c) for c in cut], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in kept]), pa.array(kept, pa.binary())],
                    names=["id", "rid", "n_removed", "n_spans", "new_sha", "kept"])

    changed = removals.touched.mapInArrow(run, "id long, rid long, n_removed long, n_spans long, new_sha string, kept binary").dropDuplicates(["rid", "id"])
    none = F.lit(0).cast("long")
    return removals.light.join(changed, ["rid", "id"], "left").select(
        F.when(F.col("id") != F.lit(-(2**63)), F.col("id")).alias("id"), "n", F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("new_sha", "sha").alias("kept_sha256"), "kept")
