"""Hierarchical Pitman-Yor language model: words after the word before them.

Each word that stands before another is a restaurant whose customers are the tokens
that follow it in the training texts; a text's first token follows a start mark. All
these restaurants share one parent, whose customers are their tables and whose base
is uniform over the training words and one class of unknown words. So the order of
words counts, and a word never seen after its neighbour falls back to its share of
all neighbours' tables.

Gibbs sampling: in each sweep every dish of every restaurant is seated anew given the
last state of all others (blocked over dishes, so that restaurants of any size are
sampled in parallel). Given c customers of a dish and new-table weight a, the number
of tables is drawn from its exact conditional, proportional to S(c, t) a^t with the
generalised Stirling numbers S of the discount, up to ``EXACT`` customers; beyond,
from an approximation of that law whose error the tests measure. After ``burn`` sweeps, predictive
probabilities are averaged over ``keep`` samples.

At scale: texts are read once and never shuffled by document. A task cuts its
documents into batches of about ``batch_tokens`` tokens and writes each as one row of
word hashes and compressed word numbers. Batches then ask for what they hold, once for each
distinct word and pair, in sorted arrays dealt by hash range: so a hot word or
context is one entry a batch, ranges are even, and entries never outnumber the pairs.
Counts, and from sweep to sweep tables, are summed by range and told back in
the order asked. One of the batches that hold a pair owns it and draws its tables; a
draw depends on the pair's hash, the sweep and the state of its two words alone. Words are told apart by 64 bits, pairs by 48. Nothing but a few
totals reaches the driver.

Null texts count as empty (the end token alone); very long texts are one batch of
their own and read whole; repeated rows, and ties of every kind, are scored alike and
all count in training; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, drop, give_back

#: Up to so many customers a dish's tables are drawn from their exact law; beyond, from an
#: approximation, by a scaled curve if there are few tables, else by a normal law.
EXACT, FEW_TABLES = 512, 1024
#: Keys of the end token and of the mark before a first word, which no word hashes to in practice.
END, START = np.uint64(1), np.uint64(2)
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _unit(key: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend on key and salt alone."""
    x = key.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


@functools.cache
def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log S(c, t) for c, t up to ``most``: S(c + 1, t) = S(c, t - 1) + (c - discount t) S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, most):
            stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)) + out[c, 1:], -np.inf)
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def _drawn(logs: np.ndarray, weight: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One draw a row of t from 1, with log odds logs[.., t - 1] + t log weight."""
    z = logs + np.arange(1, logs.shape[-1] + 1) * np.log(np.maximum(weight, 1e-300))[:, None]
    z = np.exp(z - z.max(1, keepdims=True)).cumsum(1)
    return np.minimum((z < u[:, None] * z[:, -1:]).sum(1) + 1, logs.shape[-1])


def _middle(count: np.ndarray, weight: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mode and deviation of the number of tables, from the saddle point of its generating function.

    sum_c S(c, t) x^c / c! = f(x)^t / t! with f(x) = (1 - (1 - x)^d) / d; at the mode, weight x f'(x) = c.
    """
    low, high = np.full(len(count), -40.0), np.full(len(count), -1e-12)
    for _ in range(60):  # y = log(1 - x)
        y = (low + high) / 2
        small = np.log(weight) + np.log(-np.expm1(y)) + (d - 1) * y < np.log(count)
        low, high = np.where(small, low, y), np.where(small, y, high)
    u, whole = np.exp(y), -np.expm1(d * y)
    t = weight * whole / d
    n, n1, w1 = d * (1 - u) * u ** (d - 1), d * u ** (d - 1) + d * (1 - d) * (1 - u) * u ** (d - 2), d * u ** (d - 1)
    slope = (n1 * whole - n * w1) / whole**2
    return t, 1 / np.sqrt(1 / t + count**2 / (t**3 * (1 - u) * slope))


def seat(count: np.ndarray, weight: np.ndarray, key: np.ndarray, salt: int, discount: float) -> np.ndarray:
    """Tables of each dish, from its customers and new-table weight (the parent's share of strength + discount tables)."""
    tables = np.minimum(count, 1).astype(np.int64)
    logs, u = stirling(discount), _unit(key, salt)
    few = np.flatnonzero((count > 1) & (count <= EXACT))
    few = few[np.argsort(count[few], kind="stable")]
    for rows in np.split(few, np.flatnonzero(np.diff(count[few])) + 1) if len(few) else ():
        c = int(count[rows[0]])
        for r in np.split(rows, range(0, len(rows), 1 + 1_000_000 // c)):
            tables[r] = _drawn(logs[c, 1 : c + 1][None, :], weight[r], u[r])
    many = np.flatnonzero(count > EXACT)
    if len(many):
        n, w = count[many].astype(np.float64), np.maximum(weight[many], 1e-300)
        mode, spread = _middle(n, w, discount)
        normal = np.sqrt(-2 * np.log(u[many])) * np.cos(2 * np.pi * _unit(key[many], salt + 100_000))
        tables[many] = np.clip(np.round(mode + spread * normal), 1, n)
        # few tables: with t scaled by c^discount, log (S(c, t) discount^t (t - 1)!) is the same curve for all large c
        t = np.arange(1, FEW_TABLES + 1.0)
        curve = logs[EXACT, 1:] + np.arange(1, EXACT + 1) * np.log(discount) + _log_factorials(EXACT)
        small = np.flatnonzero(mode < FEW_TABLES / 4)
        for r in np.split(small, range(0, len(small), 1000)):
            at = 1 + (t[None, :] - 1) * ((EXACT / n[r]) ** discount)[:, None]
            law = np.interp(at, np.arange(1, EXACT + 1), curve) - t * np.log(discount) - _log_factorials(FEW_TABLES)
            tables[many[r]] = _drawn(law, w[r], u[many[r]])
    return tables


def _log_factorials(most: int) -> np.ndarray:
    """log (t - 1)! for t from 1."""
    return np.r_[0.0, np.cumsum(np.log(np.arange(1, most)))]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(7)) == 2


def _press(x: np.ndarray) -> bytes:
    """Compressed with like bytes of all numbers side by side."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _open(b: bytes, kind=np.uint32) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).view(kind).ravel()


def _deltas(x: np.ndarray) -> bytes:
    return _press(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def _undelta(b: bytes) -> np.ndarray:
    return np.cumsum(_open(b, np.uint64), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _ranges(high: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the slices of sorted 32-bit numbers that fall to each of ``parts`` ranges."""
    at = (high.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(at, np.arange(parts + 1, dtype=np.uint64))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """48 bits for each pair of word keys."""
    return _mix(_mix(before) + word * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)


def pairs_of(keys: np.ndarray, refs: np.ndarray, sizes: np.ndarray):
    """Distinct pairs of a batch by pair key: keys, numbers of the first and second word, and each token's pair."""
    start = np.searchsorted(keys, START)
    before = np.empty_like(refs)
    before[1:] = refs[:-1]
    before[np.cumsum(sizes) - sizes] = start
    code, at = np.unique(before.astype(np.uint64) * np.uint64(len(keys)) + refs, return_inverse=True)
    v, w = (code // np.uint64(len(keys))).astype(np.int64), (code % np.uint64(len(keys))).astype(np.int64)
    h = pair_keys(keys[v], keys[w])
    order = np.argsort(h, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return h[order], v[order], w[order], rank[at]


def _row(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(1, f.type) for f in schema], schema=schema)


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    return pa.table([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _schema(ints: str, blobs: str) -> pa.Schema:
    return pa.schema([(c, pa.int64()) for c in ints.split()] + [(c, pa.binary()) for c in blobs.split()])


BATCH = pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("keys", pa.binary()), ("refs", pa.binary()), ("sizes", pa.binary()), ("train", pa.binary())])
ASK = _schema("part batch", "words n pairs c")
TOLD = _schema("batch part total kinds once twice", "n place c own spot")
STATE = _schema("batch", "bounds place spot v w c h own tables customers")
REPORT = _schema("part batch", "place tables customers spot own t")
SEATED = _schema("batch part customers0 tables0 once twice", "tables customers seats t")


def deal(docs: DataFrame, batch_tokens: int) -> DataFrame:
    """Batches of (doc_id, text, train): hashes of the words, sorted, and each token as a number of one."""

    def run(frames):
        import xxhash

        known: dict[bytes, int] = {}
        task, number, ids, learn, texts, room = 0, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, texts), np.uint32, len(texts))
            keys, at = np.unique(np.concatenate([np.array([START]), *texts]), return_inverse=True)
            return _row(
                BATCH, batch=[(task << 32) + number], ids=[ids], keys=[keys.tobytes()], refs=[_press(at[1:].astype(np.uint32))],
                sizes=[_press(sizes)], train=[_press(np.array(learn, np.uint8))],
            )

        for frame in frames:
            for part, i, text, told in zip(*(frame.column(c) for c in ("task", "doc_id", "text", "train"))):
                task, tokens = part.as_py(), text.as_py().encode().translate(_TO_LOWER).split()
                try:
                    x = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
                except KeyError:
                    if len(known) > 200_000:
                        known.clear()
                    for t in tokens:
                        if t not in known:
                            known[t] = max(xxhash.xxh64_intdigest(t), 3)
                    x = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
                ids.append(i.as_py())
                learn.append(told.as_py())
                texts.append(np.append(x, END))
                room += len(tokens) + 1
                if room >= batch_tokens:
                    yield flush()
                    number, ids, learn, texts, room = number + 1, [], [], [], 0
        if ids:
            yield flush()
        known.clear()
        give_back()

    return docs.select(F.spark_partition_id().cast("long").alias("task"), "doc_id", "text", "train").mapInArrow(run, _ddl(BATCH))


def _batch(row: dict):
    keys, refs, sizes = np.frombuffer(row["keys"], np.uint64), _open(row["refs"]), _open(row["sizes"])
    return keys, refs, sizes, np.repeat(_open(row["train"], np.uint8).astype(bool), sizes)


def _each(frames):
    """Rows of Arrow batches, one at a time."""
    for frame in frames:
        for i in range(frame.num_rows):
            yield {c: frame.column(c)[i].as_py() for c in frame.schema.names}
    give_back()


def _ask(parts: int):
    """For each batch and range: its words and pairs, and how often they stand in training texts."""

    def run(frames):
        for row in _each(frames):
            keys, refs, sizes, told = _batch(row)
            h, v, w, at = pairs_of(keys, refs, sizes)
            n, c = np.bincount(refs[told], minlength=len(keys)), np.bincount(at[told], minlength=len(h))
            words, pairs = _ranges(keys >> np.uint64(32), parts), _ranges(h >> np.uint64(16), parts)
            for p in range(parts):
                x, y = slice(*words[p : p + 2]), slice(*pairs[p : p + 2])
                if x.start < x.stop or y.start < y.stop:
                    yield _row(
                        ASK, part=[p], batch=[row["batch"]], words=[keys[x].tobytes()], n=[_press(n[x].astype(np.uint32))],
                        pairs=[_deltas(h[y])], c=[_press(c[y].astype(np.uint32))],
                    )

    return run


def _sum(key, got):
    """Sums of a range; each batch is told those of its entries, their places in the range, and the pairs it owns."""
    got = got.sort_by("batch").to_pydict()
    words = [np.frombuffer(x, np.uint64) for x in got["words"]]
    pairs = [_undelta(x) for x in got["pairs"]]
    uniq, at = np.unique(np.concatenate(words), return_inverse=True)
    n = np.bincount(at, np.concatenate([_open(x) for x in got["n"]]), len(uniq)).astype(np.int64)
    mixed, first, of = np.unique(np.concatenate(pairs), return_index=True, return_inverse=True)
    c = np.bincount(of, np.concatenate([_open(x) for x in got["c"]]), len(mixed)).astype(np.int64)
    own = np.zeros(len(of), bool)
    own[first] = True
    own &= c[of] > 0
    rows, i, j = [], 0, 0
    for batch, x, y in zip(got["batch"], words, pairs):
        mine, theirs = at[i : i + len(x)], of[j : j + len(y)]
        rows.append({
            "batch": batch, "part": key[0].as_py(), "n": _press(n[mine].astype(np.uint32)), "place": _deltas(mine),
            "c": _press(c[theirs].astype(np.uint32)), "own": _press(own[j : j + len(y)].astype(np.uint8)), "spot": _deltas(theirs),
        })
        i, j = i + len(x), j + len(y)
    give_back()
    rows.append({"batch": -1, "part": key[0].as_py(), "total": int(n.sum()), "kinds": int((n > 0).sum()), "once": int((c == 1).sum()), "twice": int((c == 2).sum())})
    return _rows(TOLD, rows)


def _gathered(told: DataFrame, name: str, *fields: str) -> DataFrame:
    """The answers to each batch, in the order of the ranges."""
    one = F.struct("part", *fields)
    return told.filter("batch >= 0").groupBy("batch").agg(F.sort_array(F.collect_list(one)).alias(name))


def _joined(answers: list[dict], field: str, kind=np.uint32) -> np.ndarray:
    return np.concatenate([_open(x[field], kind) for x in answers])


def _start(frames):
    """What the sweeps need of a batch: places of its words, pairs of two customers or more that it owns, and sums over those of one."""
    for row in _each(frames):
        keys, refs, sizes, _ = _batch(row)
        h, v, w, _ = pairs_of(keys, refs, sizes)
        c, own = _joined(row["told"], "c"), _joined(row["told"], "own", np.uint8).astype(bool)
        one, more = own & (c == 1), own & (c > 1)
        places, spots = ([_undelta(x[k]) for x in row["told"]] for k in ("place", "spot"))
        ends = np.cumsum([0, *map(len, spots)])
        bounds = [(x["part"], len(p), len(s), int(more[i:j].sum())) for x, p, s, i, j in zip(row["told"], places, spots, ends, ends[1:])]
        yield _row(
            STATE, batch=[row["batch"]], bounds=[np.array(bounds, np.int64).tobytes()], place=[_deltas(np.concatenate(places))], spot=[_deltas(np.concatenate(spots))],
            v=[_press(v[more].astype(np.uint32))], w=[_press(w[more].astype(np.uint32))], c=[_press(c[more])], h=[_press(h[more].astype(np.uint32))], own=[_deltas(np.concatenate(spots)[more])],
            tables=[_press(np.bincount(v[one], minlength=len(keys)).astype(np.uint32))], customers=[_press(np.bincount(w[one], minlength=len(keys)).astype(np.uint32))],
        )


class Facts:
    """Totals of the model and, by sweep, of the parent restaurant."""

    def __init__(self, total: int, kinds: int, discount: float, strength: float):
        self.total, self.kinds, self.discount, self.strength = total, kinds, discount, strength
        self.parent_discount, self.customers0, self.tables0 = 0.5, [], []

    def parent(self, sweep: int, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Tables of each word's restaurant, and the parent's predictive probability of each word, after a sweep."""
        tables, c, t = (_joined(answers, x).astype(np.float64) for x in ("tables", "customers", "seats"))
        rest = (self.strength + self.parent_discount * self.tables0[sweep]) / (self.kinds + 1)
        return tables, (c - self.parent_discount * t + rest) / (self.strength + self.customers0[sweep])

    def draw(self, c, v, w, h, sweep: int, before: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Tables of pairs in a sweep, given the state before it."""
        weight = (self.strength + self.discount * before[0][v]) * before[1][w]
        return seat(c.astype(np.int64), weight, h.astype(np.uint32).astype(np.uint64), sweep, self.discount)


def _reseat(sweep: int, facts: Facts, keep: bool):
    """Each batch's report of tables: by first word, and, as customers of the parent, by second word; keep: of its pairs too."""

    def run(frames):
        for row in _each(frames):
            v, w, c, h = (_open(row[x]) for x in "vwch")
            t = np.ones(len(c), np.int64) if not sweep else facts.draw(c, v, w, h, sweep, facts.parent(sweep - 1, row["state"]))
            place, spot, own = (_undelta(row[x]) for x in ("place", "spot", "own"))
            tables, customers = _open(row["tables"]), _open(row["customers"])
            tables = tables + np.bincount(v, t, len(place)).astype(np.uint32)
            customers = customers + np.bincount(w, t, len(place)).astype(np.uint32)
            i = j = k = 0
            for part, n, pairs, mine in np.frombuffer(row["bounds"], np.int64).reshape(-1, 4).tolist():
                x, y, z = slice(i, i + n), slice(j, j + pairs), slice(k, k + mine)
                more = {"spot": [_deltas(spot[y])], "own": [_deltas(own[z])], "t": [_press(t[z].astype(np.uint32))]} if keep else {}
                yield _row(REPORT, part=[part], batch=[row["batch"]], place=[_deltas(place[x])], tables=[_press(tables[x])], customers=[_press(customers[x])], **more)
                i, j, k = i + n, j + pairs, k + mine

    return run


def _parent(sweep: int, facts: Facts):
    """Sums of a range's reports, and the parent's tables drawn from them."""

    def run(key, got):
        part, got = key[0].as_py(), got.sort_by("batch").to_pydict()
        places = [_undelta(x).astype(np.int64) for x in got["place"]]
        at = np.concatenate(places)
        tables, c = (np.bincount(at, np.concatenate([_open(x) for x in got[f]])).astype(np.int64) for f in ("tables", "customers"))
        t = np.minimum(c, 1)
        if sweep:
            weight = np.full(len(c), (facts.strength + facts.parent_discount * facts.tables0[sweep - 1]) / (facts.kinds + 1))
            t = seat(c, weight, np.arange(len(c), dtype=np.uint64) + np.uint64(part << 32), 500 + sweep, facts.parent_discount)
        rows = [
            {"batch": b, "part": part, **{k: _press(x[mine].astype(np.uint32)) for k, x in (("tables", tables), ("customers", c), ("seats", t))}}
            for b, mine in zip(got["batch"], places)
        ]
        if got["spot"][0] is not None:  # tables of pairs: one of those of one customer, as reported of the others
            spots = [_undelta(x).astype(np.int64) for x in got["spot"]]
            drawn = np.ones(max((int(x[-1]) for x in spots if len(x)), default=-1) + 1, np.uint32)
            for own, x in zip(got["own"], got["t"]):
                drawn[_undelta(own).astype(np.int64)] = _open(x)
            for r, x in zip(rows, spots):
                r["t"] = _press(drawn[x])
        rows.append({"batch": -1, "part": part, "customers0": int(c.sum()), "tables0": int(t.sum()), "once": int((c == 1).sum()), "twice": int((c == 2).sum())})
        give_back()
        return _rows(SEATED, rows)

    return run


def _read(facts: Facts, kept: list[int]):
    """Scores of each document from the averaged predictive probability of each pair of the batch."""
    out = pa.schema([
        ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def run(frames):
        for row in _each(frames):
            keys, refs, sizes, _ = _batch(row)
            h, v, w, at = pairs_of(keys, refs, sizes)
            told = {k: [x for x in row["told"] if x["sweep"] == k] for k in (-1, *kept)}
            n, c = _joined(told[-1], "n").astype(np.int64), _joined(told[-1], "c").astype(np.int64)
            follow = n.copy()  # each token of a word is followed by one, each text begins once
            follow[np.searchsorted(keys, START)] = n[np.searchsorted(keys, END)]
            p = np.zeros(len(h))
            for sweep in kept:
                t = np.where(c > 0, _joined(told[sweep], "t"), 0)
                tables, parent = facts.parent(sweep, told[sweep])
                p += (c - facts.discount * t + (facts.strength + facts.discount * tables[v]) * parent[w]) / (facts.strength + follow[v])
            logp = np.log10(p / len(kept))[at]
            base = np.log10((n + 1) / (facts.total + facts.kinds + 1))[refs]
            ends = np.cumsum(sizes, dtype=np.int64) - sizes
            score, plain, seen = (np.add.reduceat(x, ends) for x in (logp, base, (n > 0).astype(np.int64)[refs]))
            train = _open(row["train"], np.uint8).astype(bool)
            cols = (row["ids"], train, sizes.astype(np.int64), seen, plain, score)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, out)], schema=out)

    return run


def score(
    docs: DataFrame, train: Column, *, batch_tokens: int = 700_000, part_chars: int = 6_000_000, burn: int = 2, keep: int = 2, strength: float = 1.0
) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score for each row of (doc_id, text)."""
    mine = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    size = mine.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    parts = max(1, -(-size // part_chars))
    batches = cut(deal(mine, batch_tokens))
    told = cut(batches.mapInArrow(_ask(parts), _ddl(ASK)).groupBy("part").applyInArrow(_sum, _ddl(TOLD)))
    x = told.filter("batch = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "kinds", "once", "twice")]).first()
    discount = lambda r: min(max((r["once"] + 0.5) / (r["once"] + 2 * r["twice"] + 1), 0.05), 0.95)
    facts = Facts(x["total"], x["kinds"], discount(x), strength)
    answers = _gathered(told, "told", "place", "c", "own", "spot")
    state = cut(batches.join(answers, "batch").mapInArrow(_start, _ddl(STATE)))
    seats: list[DataFrame] = []
    kept = list(range(burn + 1, burn + keep + 1))
    for sweep in range(burn + keep + 1):
        ready = state.join(_gathered(seats[-1], "state", "tables", "customers", "seats"), "batch") if seats else state
        reports = ready.mapInArrow(_reseat(sweep, facts, sweep in kept), _ddl(REPORT))
        seats.append(cut(reports.groupBy("part").applyInArrow(_parent(sweep, facts), _ddl(SEATED))))
        if 0 < sweep <= burn + 1:
            drop(seats[sweep - 1])
        x = seats[-1].filter("batch = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("customers0", "tables0", "once", "twice")]).first()
        facts.customers0.append(x["customers0"])
        facts.tables0.append(x["tables0"])
        if not sweep:
            facts.parent_discount = discount(x)
    drop(state)
    none = F.lit(None).cast("binary")
    every = told.select("batch", F.lit(-1).alias("sweep"), "part", "n", "c", *[none.alias(x) for x in ("tables", "customers", "seats", "t")])
    for sweep in kept:
        every = every.union(seats[sweep].select("batch", F.lit(sweep), "part", none, none, "tables", "customers", "seats", "t"))
    one = F.struct("sweep", "part", "n", "c", "tables", "customers", "seats", "t")
    answers = every.filter("batch >= 0").groupBy("batch").agg(F.sort_array(F.collect_list(one)).alias("told"))
    scored = batches.join(answers, "batch").mapInArrow(_read(facts, kept), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(facts.total).cast("long"))


def query(docs: DataFrame) -> DataFrame:
    return score(docs, ~held_out(F.col("doc_id"))).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
