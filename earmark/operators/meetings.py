"""Alignment of many sequences with many: all pairs that reach a score, without a row for each two equal items.

Two steps. Hashes that differ in at most two bits agree in one of three chunks of their 32 bits, so the distinct hashes of a task are
dealt by chunk, packed in a few rows, and the neighbours of those asked are looked up in a table of the hashes that share the chunk: 529 look-ups
for each distinct hash asked, however many references there are. Then the items asked, written out by the
hashes they meet and packed in blocks of queries, meet packed blocks of references. A task holds one block of
each, counts offsets in it, and only the pairs that reach ``least`` leave it, so nothing that grows with
the equal items of two sides is shuffled or written.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store
from .fingerprint import THREE

#: Items a block of queries holds, written out by the hashes they meet; items of a block of references; item pairs counted at once.
QUERY_ITEMS, REFERENCE_ITEMS, PAIRS = 2_000_000, 4_000_000, 4_000_000
#: First bits of a hash that a table of a block's hashes is read by.
FIRST_BITS = 25
#: Values of a chunk that one group holds, as bits.
GROUP_BITS = 5


def _flips(chunk: int, max_bits: int) -> np.ndarray:
    """Numbers of few bits outside a chunk that touch each chunk before it: a pair is found by the first chunk it shares."""
    masks = [((1 << n) - 1) << at for at, n in THREE]
    free = [b for b in range(32) if not masks[chunk] >> b & 1]
    all_ = (sum(1 << b for b in some) for n in range(max_bits + 1) for some in combinations(free, n))
    return np.array([x for x in all_ if all(x & m for m in masks[:chunk])], np.uint32)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _rest(h: np.ndarray, chunk: int) -> np.ndarray:
    """Hashes (unsigned) without the bits of a chunk."""
    at, n = THREE[chunk]
    h = h.astype(np.int64)
    return h & ((1 << at) - 1) | h >> (at + n) << at


def _united(h: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and which of them are asked at all."""
    all_ = np.unique(h)
    flags = np.zeros(len(all_), bool)
    flags[np.searchsorted(all_, np.unique(h[asked]))] = True
    return all_, flags


def _near(df: DataFrame, values: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], max_bits: int) -> DataFrame:
    """``neighbours`` of what values(batch) reads of df: hashes (unsigned) and which are asked. They are shuffled as a few packed rows a task."""
    if max_bits > 2:
        raise ValueError("hashes that differ in more than two bits need more chunks")
    dealt = pa.schema([("part", pa.int32()), ("h", pa.binary()), ("asked", pa.binary())])
    schema = pa.schema([("asked", pa.int32()), ("h", pa.int32())])

    def pack(held):
        h, asked = _united(*(np.concatenate(x) for x in zip(*held)))
        for c, (at, n) in enumerate(THREE):
            part = (h >> np.uint32(at) & np.uint32((1 << n) - 1)) >> np.uint32(GROUP_BITS)
            order = np.argsort(part, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
            own = np.split(order, first[1:])
            rows = [part[order[first]].astype(np.int32) + (c << 16), [h[x].tobytes() for x in own], [asked[x].tobytes() for x in own]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, dealt.types)], schema=dealt)

    def deal(batches):
        held, size = [], 0
        for batch in batches:
            held.append(values(batch))
            size += len(held[-1][0])
            if size > QUERY_ITEMS:
                yield from pack(held)
                held, size = [], 0
        if size:
            yield from pack(held)

    def run(table: pa.Table) -> pa.Table:
        c = table.column("part")[0].as_py() >> 16
        at, n = THREE[c]
        h, asked = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(name)]) for name, t in (("h", np.uint32), ("asked", bool)))
        h, asked = _united(h, asked)
        flips = _flips(c, max_bits)
        # flips leave the chunk alone, so they can be made on what is left of a hash
        short = _rest(flips, c)
        value = h >> np.uint32(at) & np.uint32((1 << n) - 1)
        order = np.argsort(value, kind="stable")
        h, asked, value = h[order], asked[order], value[order]
        there = np.zeros(1 << (32 - n), bool)
        left, right = [], []
        for own in np.split(np.arange(len(h)), np.flatnonzero(value[1:] != value[:-1]) + 1):
            q = h[own][asked[own]]
            if not len(q):
                continue
            held = _rest(h[own], c)
            there[held] = True
            for i in range(0, len(q), 512):
                some = q[i : i + 512]
                x, y = np.nonzero(there[_rest(some, c)[:, None] ^ short[None, :]])
                left.append(some[x])
                right.append(some[x] ^ flips[y])
            there[held] = False
        both = [np.concatenate(x).view(np.int32) if x else np.empty(0, np.int32) for x in (left, right)]
        return pa.Table.from_arrays([pa.array(x) for x in both], schema=schema)

    # few packed rows are much work, which tasks joined by their size would not share
    return df.mapInArrow(deal, "part int, h binary, asked binary").repartition(_parts(df), "part").groupBy("part").applyInArrow(run, "asked int, h int")


def neighbours(hashes: DataFrame, max_bits: int = 2) -> DataFrame:
    """(asked, h): hashes asked and all hashes within so many bits; hashes: (h int, asked boolean)."""
    read = lambda batch: (batch.column("h").to_numpy().view(np.uint32), batch.column("asked").to_numpy(zero_copy_only=False))
    return _near(hashes.select("h", "asked"), read, max_bits)


def _hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a batch of sequences, and which are of those asked."""
    items, asked = batch.column("items"), batch.column("asked").to_numpy(zero_copy_only=False)
    lengths = np.diff(items.offsets.to_numpy())
    return items.flatten().to_numpy().view(np.uint32), np.repeat(asked, lengths)


def _query_blocks(items: DataFrame) -> DataFrame:
    """items (query_id, n, pos, h) packed by block of queries, by ascending h."""
    blocks = max(1, -(-items.count() // QUERY_ITEMS))
    schema = pa.schema([("queries", pa.binary()), ("sizes", pa.binary()), ("h", pa.binary()), ("query", pa.binary()), ("pos", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        ids, n, pos, h = (table.column(c).to_numpy() for c in ("query_id", "n", "pos", "h"))
        queries, first, query = np.unique(ids, return_index=True, return_inverse=True)
        order = np.argsort(h, kind="stable")
        packed = (queries, n[first], h[order], query[order].astype(np.int32), pos[order])
        return pa.Table.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], schema=schema)

    dealt = items.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    return dealt.repartition(_parts(items), "block").groupBy("block").applyInArrow(run, "queries binary, sizes binary, h binary, query binary, pos binary")


def _reference_blocks(sequences: DataFrame) -> DataFrame:
    """sequences (doc_id, items) packed as they stand in their partitions, the items of a block in ascending order with their places."""
    schema = pa.schema([("docs", pa.binary()), ("lengths", pa.binary()), ("items", pa.binary()), ("places", pa.binary())])

    def pack(ids, lengths, items):
        all_ = np.concatenate(items)
        order = np.argsort(all_, kind="stable")
        x = (np.array(ids, np.int64), np.array(lengths, np.int64), all_[order], order.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in x], schema=schema)

    def run(batches):
        ids, lengths, items, held = [], [], [], 0
        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("items")):
                if ids and held + len(x) > REFERENCE_ITEMS:
                    yield pack(ids, lengths, items)
                    ids, lengths, items, held = [], [], [], 0
                ids.append(doc_id)
                lengths.append(len(x))
                items.append(x.values.to_numpy())
                held += len(x)
        if ids:
            yield pack(ids, lengths, items)

    return sequences.select("doc_id", "items").mapInArrow(run, "docs binary, lengths binary, items binary, places binary")


def _counts(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each occurs."""
    if times is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(times, first)


def met(q: tuple[np.ndarray, ...], r: tuple[np.ndarray, ...], least: float) -> list[tuple[np.ndarray, ...]]:
    """(query, doc, best, n) of the pairs of two blocks whose best offset reaches ``least`` of the shorter, as lists of arrays."""
    (queries, sizes, h, query, pos), (docs, lengths, items, places) = q, r
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    hashes = h[start]
    count = np.diff(np.r_[start, len(h)])
    # most items meet nothing, which a table of the first bits tells; items ascend, so it is read in order
    there = np.zeros(1 << FIRST_BITS, bool)
    there[hashes.view(np.uint32) >> np.uint32(32 - FIRST_BITS)] = True
    some = np.flatnonzero(there[items.view(np.uint32) >> np.uint32(32 - FIRST_BITS)])
    at = np.minimum(np.searchsorted(hashes, items[some]), len(hashes) - 1)
    same = np.flatnonzero(hashes[at] == items[some])
    hit, at = places[some[same]], at[same]
    order = np.argsort(hit)
    hit, at = hit[order], at[order]
    ends = np.cumsum(lengths)
    doc = np.searchsorted(ends, hit, side="right")
    j = hit - (ends - lengths)[doc]
    many = count[at]
    span = int(sizes.max() + lengths.max() + 1)

    def keys(lo: int, hi: int) -> np.ndarray:
        m = many[lo:hi]
        each = np.repeat(np.arange(lo, hi), m)
        row = np.arange(len(each)) - np.repeat(np.cumsum(m) - m, m) + start[at[each]]
        return (doc[each] * len(queries) + query[row]) * span + (pos[row] - j[each] + lengths.max())

    out = []
    total = np.r_[0, np.cumsum(many)]
    firsts = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)] if len(doc) else np.zeros(1, np.int64)
    d = 0
    while d < len(firsts) - 1:
        # whole references up to so many pairs, or a single one in pieces
        e = max(d + 1, int(np.searchsorted(total[firsts], total[firsts[d]] + PAIRS, side="right")) - 1)
        lo, hi = int(firsts[d]), int(firsts[e])
        found = None
        while lo < hi:
            to = min(hi, max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, side="right")) - 1))
            new = _counts(keys(lo, to))
            found = new if found is None else _counts(np.r_[found[0], new[0]], np.r_[found[1], new[1]])
            lo = to
        pair = found[0] // span
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        best, pair = np.maximum.reduceat(found[1], first), pair[first]
        a, b = pair % len(queries), pair // len(queries)
        n = np.minimum(sizes[a], lengths[b])
        # scores are rounded to six places after this
        kept = best >= (least - 1e-6) * n
        out.append((queries[a[kept]], docs[b[kept]], best[kept], n[kept]))
        d = e
    return out


def close(sequences: DataFrame, least: float, max_bits: int = 2) -> DataFrame:
    """(query_id, doc_id, score) of all pairs that reach ``least``, a query among them: as ``fingerprint.alignment`` scores them.

    sequences: (doc_id, asked, items), asked marking those that are queries too; items are numbers of 32 bits, as longs or as signed integers.
    """
    signed = F.transform("items", lambda x: (x - (1 << 31)).cast("int")) if sequences.schema["items"].dataType.elementType.typeName() == "long" else F.col("items")
    seq = store.cut(sequences.select("doc_id", "asked", signed.alias("items")))
    near = store.cut(_near(seq.select("items", "asked"), _hashes, max_bits))
    mine = seq.filter("asked").select(F.col("doc_id").alias("query_id"), F.size("items").cast("long").alias("n"), F.posexplode("items").alias("pos", "asked"))
    items = store.cut(mine.join(near, "asked").select("query_id", "n", "pos", "h"))
    queries = store.cut(_query_blocks(items))
    both = store.cut(_reference_blocks(seq)).repartition(_parts(seq)).crossJoin(queries)
    kinds = (("queries", np.int64), ("sizes", np.int64), ("h", np.int32), ("query", np.int32), ("pos", np.int32)), (("docs", np.int64), ("lengths", np.int64), ("items", np.int32), ("places", np.int32))
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("best", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, r = (tuple(np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in side) for side in kinds)
                for rows in met(q, r, least):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], schema=schema)

    found = both.mapInArrow(run, "query_id long, doc_id long, best long, n long")
    score = F.round(F.col("best") / F.col("n"), 6)
    return found.select("query_id", "doc_id", score.alias("score")).filter(F.col("score") >= least)
