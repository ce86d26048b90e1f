"""The registry that learns: which entry a sighting belongs to, and what of it is worth keeping.

Sightings are dealt to buckets that are folded apart from each other, each in the order of time. ``Bucket`` folds one; the batch
below streams sorted sightings through it, and ``streaming.ordered`` keeps it as state of a stream. Both hold the entries of one
bucket at a time. A stream can only deal by a locality hash of the features it sees, and bounds its state by ``Caps``. A batch
knows all sightings: ``linked`` deals together whatever could ever match, so that folding buckets gives what folding
all sightings in one would give, and needs no caps.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, NOISE_FLOOR, NOISE_MARGIN, Thresholds
from . import vectors
from .vectors import correlated, spectrum

# Features an entry keeps, and entries a sighting is compared with, where the state is that of a stream.
MOST_SEGMENTS, MOST_COVERS, MOST_ENTRIES = 48, 8, 500

#: Columns of a sighting; any feature may be null.
SIGHTING = "bucket long, sighting_id long, seen_at long, items array<long>, duration double, mert array<array<double>>, cover array<double>, hint long"
FOUND = "bucket long, sighting_id long, unknown_id long, is_new boolean, method string, score double, learned int, sighting_count long"


def locality(v: Column, width: int, bits: int = 6) -> Column:
    """A bucket number: the signs of a vector against ``bits`` Walsh functions. Near vectors mostly share it."""
    rows = [[1.0 if bin(i & (p + 1)).count("1") % 2 == 0 else -1.0 for i in range(width)] for p in range(bits)]
    out = F.lit(0)
    for p, row in enumerate(rows):
        dot = F.aggregate(F.zip_with(v, F.array(*[F.lit(x) for x in row]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        out = out + F.when(dot >= 0, 1 << p).otherwise(0)
    return F.coalesce(out, F.lit(-1)).cast("long")


def least_score(seconds: float, t: Thresholds = DEFAULT) -> float:
    """Acceptance threshold of two sequences, the shorter of which lasts so long."""
    if seconds <= 0:
        return t.fingerprint
    x, y = zip(*NOISE_FLOOR)
    return max(t.fingerprint, float(np.interp(seconds, x, y)) * NOISE_MARGIN)


def aligned(a: np.ndarray, b: np.ndarray, bits: int) -> float:
    """Share of the shorter sequence that agrees at the best offset, hashes differing in at most ``bits``."""
    if not len(a) or not len(b):
        return 0.0
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= bits)
    return 0.0 if not len(i) else round(int(np.bincount(i - j + len(b)).max()) / min(len(a), len(b)), 6)


@dataclass(frozen=True)
class Caps:
    """Features an entry keeps, and entries, those seen last, a sighting is compared with; None is all."""

    segments: int | None = None
    covers: int | None = None
    entries: int | None = None


def fixed() -> Caps:
    return Caps(MOST_SEGMENTS, MOST_COVERS, MOST_ENTRIES)


@dataclass
class Entry:
    last_seen: int
    count: int = 0
    hint: int | None = None
    items: list[int] | None = None
    duration: float | None = None
    mert: list[list[float]] = field(default_factory=list)
    cover: list[list[float]] = field(default_factory=list)


@dataclass
class Bucket:
    """Entries of one bucket; ``forget`` microseconds after it was last seen an entry is gone.

    Entries stand in the order in which they were last seen, so a sighting looks at those it may match and those it drops
    only, however many there are; their features are kept as arrays."""

    entries: dict[int, Entry]
    forget: int
    pitches: int
    t: Thresholds = DEFAULT
    caps: Caps = field(default_factory=fixed)

    def __post_init__(self) -> None:
        self.arrays: dict[int, tuple] = {}
        self._order()

    def _order(self) -> None:
        self.entries = OrderedDict(sorted(self.entries.items(), key=lambda x: x[1].last_seen))

    def _touch(self, key: int, seen_at: int) -> None:
        """The entry was seen; it goes to the end, unless the sighting is late."""
        e = self.entries.pop(key)
        late = bool(self.entries) and self.entries[next(reversed(self.entries))].last_seen > max(e.last_seen, seen_at)
        e.last_seen, e.count = max(e.last_seen, seen_at), e.count + 1
        self.entries[key] = e
        if late:
            self._order()

    def prune(self, now: int) -> list[int]:
        gone = []
        for k, e in self.entries.items():
            if e.last_seen + self.forget > now:
                break
            gone.append(k)
        for k in gone:
            del self.entries[k]
            self.arrays.pop(k, None)
        return gone

    def _recent(self) -> list[tuple[int, Entry]]:
        out: list[tuple[int, Entry]] = []
        for k in reversed(self.entries):
            e = self.entries[k]
            if self.caps.entries is not None and len(out) >= self.caps.entries and e.last_seen < out[-1][1].last_seen:
                break
            out.append((k, e))
        return sorted(out, key=lambda x: (-x[1].last_seen, x[0]))[: self.caps.entries]

    def _arrays(self, key: int, e: Entry) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Segments (rows), and spectra of covers (frequencies, rows, frames), of an entry."""
        held = self.arrays.setdefault(key, [[0, None], [0, None]])
        for side, (own, kept, axis) in enumerate(((e.mert, held[0], 0), (e.cover, held[1], 1))):
            if len(own) > kept[0]:
                new = np.array(own[kept[0] :])
                new = self._spectrum(new) if side else new
                # room for as many again, so that an entry that grows is copied now and then only
                if kept[1] is None or len(own) > kept[1].shape[axis]:
                    shape = list(new.shape)
                    shape[axis] = len(own) + kept[0]
                    room = np.empty(shape, new.dtype)
                    if kept[0]:
                        room[(slice(None),) * axis + (slice(kept[0]),)] = kept[1][(slice(None),) * axis + (slice(kept[0]),)]
                    kept[1] = room
                kept[1][(slice(None),) * axis + (slice(kept[0], len(own)),)] = new
                kept[0] = len(own)
        return tuple(None if x is None else x[(slice(None),) * axis + (slice(n),)] for axis, (n, x) in enumerate(held))

    def _spectrum(self, rows: np.ndarray) -> np.ndarray:
        return spectrum(rows, self.pitches, rows.shape[1] // self.pitches)

    def _covers(self, a: np.ndarray, kept: np.ndarray) -> np.ndarray:
        return correlated(self._spectrum(a[None]), kept, self.pitches).max(0)[0].round(4)

    def match(self, s) -> tuple[int, float, str] | None:
        """By fingerprint, else by segment, else by cover; of equal scores the entry seen last."""
        recent = self._recent()
        if s.items is not None and len(s.items):
            best = None
            for k, e in recent:
                if e.items:
                    score = aligned(np.array(s.items, np.int64), np.array(e.items, np.int64), self.t.max_bit_error)
                    lengths = [d for d in (s.duration, e.duration) if d and d == d]
                    if score >= least_score(min(lengths, default=0.0), self.t) and (best is None or score > best[1]):
                        best = (k, score, "FINGERPRINT")
            if best:
                return best
        for side, own, name, least in ((0, s.mert, "EMBEDDING", self.t.embedding), (1, s.cover, "COVER", self.t.cover)):
            if own is None or not len(own):
                continue
            owners = [(k, x) for k, e in recent if (x := self._arrays(k, e)[side]) is not None]
            if not owners:
                continue
            kept = np.concatenate([x for _, x in owners], axis=side)
            scores = self._covers(np.array(own), kept) if side else (np.array([list(x) for x in own]) @ kept.T).max(0).round(6)
            at = int(scores.argmax())
            if scores[at] >= least:
                ends = np.cumsum([x.shape[side] for _, x in owners])
                return owners[int(np.searchsorted(ends, at, side="right"))][0], float(scores[at]), name
        return None

    def learn(self, key: int, e: Entry, s) -> int:
        """Keep what the entry couldn't be recognised by so far, while there is room."""
        n = 0
        room = lambda kept, most: most is None or len(kept) < most
        for v in s.mert if s.mert is not None else ():
            v = np.array(v, np.float64)
            if room(e.mert, self.caps.segments) and (not e.mert or (self._arrays(key, e)[0] @ v).max().round(6) < self.t.embedding):
                e.mert.append(v.tolist())
                n += 1
        if s.cover is not None and len(s.cover) and room(e.cover, self.caps.covers) and (not e.cover or self._covers(np.array(s.cover), self._arrays(key, e)[1]).max() < self.t.cover):
            e.cover.append([float(x) for x in s.cover])
            n += 1
        return n

    def fold(self, s) -> tuple:
        """The row of FOUND for one sighting; without a match it becomes an entry that later ones can match."""
        self.prune(s.seen_at)
        found = self.match(s)
        key = found[0] if found else s.sighting_id
        e = self.entries.get(key)
        if e is None:
            items = [int(x) for x in s.items] if s.items is not None else None
            e = self.entries[key] = Entry(s.seen_at, items=items, duration=float(s.duration) if s.duration == s.duration and s.duration is not None else None)
        self._touch(key, s.seen_at)
        if s.hint is not None and s.hint == s.hint:
            e.hint = int(s.hint)
        learned = self.learn(key, e, s)
        return s.bucket, s.sighting_id, key, found is None, found[2] if found else None, round(found[1], 4) if found else None, learned, e.count


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")]).astype({"score": "float64", "is_new": "bool"})


def learned(sightings: DataFrame, pitches: int, *, forget_seconds: int = 90 * 86400, t: Thresholds = DEFAULT, caps: Caps | None = None) -> DataFrame:
    """The entry of each sighting (columns of SIGHTING) and what it learned of it, in the order of time; caps: those of a stream if not given.

    Sorted sightings stream through the buckets of a partition one after the other: a bucket is one stretch of rows, and only its
    entries are held, never its sightings.
    """

    caps = caps or fixed()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = None
        for pdf in frames:
            rows = []
            for s in pdf.itertuples(index=False):
                if bucket is None or s.bucket != at:
                    at, bucket = s.bucket, Bucket({}, forget_seconds * 1_000_000, pitches, t, caps)
                rows.append(bucket.fold(s))
            if rows:
                yield frame(rows)

    names = [c.split()[0] for c in SIGHTING.split(", ")]
    return sightings.select(*names).repartition("bucket").sortWithinPartitions("bucket", "seen_at", "sighting_id").mapInPandas(run, FOUND)


#: What is linked may score so much less than it needs to match: a link too many joins two buckets, a link too few would part two sightings.
SLACK = 2e-4
#: Edges a task holds before it makes a forest of them.
EDGES = 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its component) of the ids of edges, the least ones left out."""
    ids, at = np.unique(np.r_[a, b], return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(u):
        low, least = root.copy(), np.minimum(root[u], root[v])
        for side in (root[u], root[v], u, v):
            np.minimum.at(low, side, least)
        while (low != (up := low[low])).any():
            low = up
        root = low
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    below = root != np.arange(len(ids))
    return ids[below], ids[root[below]]


def _reduced(edges: DataFrame) -> DataFrame:
    """The edges (a, b) of a partition as a forest: at most one row an id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, new, held = (np.empty(0, np.int64),) * 2, [], 0
        for pdf in frames:
            new.append((pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64)))
            held += len(pdf)
            if held >= EDGES + len(kept[0]):
                kept, new, held = forest(*(np.concatenate(x) for x in zip(kept, *new))), [], 0
        a, b = forest(*(np.concatenate(x) for x in zip(kept, *new)))
        yield pd.DataFrame({"a": a, "b": b})

    return edges.mapInPandas(run, "a long, b long")


def linked(features: DataFrame, pitches: int, t: Thresholds = DEFAULT) -> DataFrame:
    """(id, bucket): ids whose segments or covers could match, directly or by others, have one bucket; features: (id, mert, cover).

    All segments, and all covers in all rotations, meet in blocks, and a forest leaves a pair of blocks: at most a row an id. Most covers are told apart
    without their rotations, by the products of the sizes of their frequencies, which no rotation can pass. The last forest has 16 bytes an id that has a partner.
    """

    def slices(x: pd.DataFrame, y: pd.DataFrame, made, least: float, sure=None) -> pd.DataFrame:
        u, v = (made(np.stack(df["v"].to_numpy()).astype(np.float64)).astype(np.float32) for df in (x, y))
        a, b = x["vec_id"].to_numpy(), y["vec_id"].to_numpy()
        # single precision may be off by a little more for long vectors
        slack = SLACK * max(1.0, float(np.sqrt((u * u).sum(1).max() * (v * v).sum(1).max())))
        step = max(1, vectors.HELD // len(y))
        kept = (np.empty(0, np.int64),) * 2
        for i in range(0, len(x), step):
            p = np.flatnonzero((u[i : i + step] @ v.T).ravel() >= np.float32(least - slack))
            i_, j = i + p // len(y), p % len(y)
            some = a[i_] != b[j]
            i_, j = i_[some], j[some]
            if sure is not None and len(i_):
                fine = sure(x["v"].to_numpy(), y["v"].to_numpy(), i_, j) >= least - slack
                i_, j = i_[fine], j[fine]
            if len(i_):
                kept = forest(np.r_[kept[0], a[i_]], np.r_[kept[1], b[j]])
        return pd.DataFrame({"a": kept[0], "b": kept[1]})

    def sizes(rows: np.ndarray) -> np.ndarray:
        s = np.abs(spectrum(rows, pitches, rows.shape[1] // pitches))
        twice = np.full(len(s), 2.0)
        twice[0] = 1
        twice[-1] = 1 if pitches % 2 == 0 else 2
        return (s * np.sqrt(twice / pitches)[:, None, None]).transpose(1, 0, 2).reshape(len(rows), -1)

    def rotations(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for k in range(0, len(i), 10_000):
            q, r = (spectrum(np.stack(z[w[k : k + 10_000]]).astype(np.float64), pitches, len(z[0]) // pitches) for z, w in ((x, i), (y, j)))
            out[k : k + 10_000] = np.fft.irfft((q.conj() * r).sum(2), n=pitches, axis=0).max(0)
        return out

    def met(rows: DataFrame, keep) -> DataFrame:
        n = rows.count()
        return vectors.block_products(rows, rows, lambda _, x, y: keep(x, y), "a long, b long", left_rows=n, right_rows=n, upper=True, multiply=False)

    segments = features.select(F.col("id").alias("vec_id"), F.explode("mert").alias("v"))
    covers = features.filter("cover is not null and size(cover) > 0").select(F.col("id").alias("vec_id"), F.col("cover").alias("v"))
    near = met(segments, lambda x, y: slices(x, y, lambda z: z, t.embedding)).union(met(covers, lambda x, y: slices(x, y, sizes, t.cover, rotations)))
    roots = _reduced(_reduced(near).repartition(1)).select(F.col("a").alias("id"), "b")
    return features.select("id").join(roots, "id", "left").select("id", F.coalesce("b", "id").alias("bucket"))
