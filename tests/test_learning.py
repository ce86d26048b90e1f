"""The registry that learns and admission that forgets: streams on shuffled batches equal a sequential run."""

import random
from datetime import datetime, timezone
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.operators import learning, registry
from earmark.plans import catalogue
from earmark.streaming import ordered

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
US = int(START.timestamp()) * 1_000_000


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ordered.PROVIDER)
    yield
    spark.conf.set(key, before)


def row(names, values):
    return SimpleNamespace(**dict(zip(names, values)))


def unit(v):
    return (v / np.linalg.norm(v)).tolist()


def sightings(n=160, seed=2):
    """Songs that come back whole, as another part, moved in pitch, or by fingerprint only; some after they are forgotten."""
    r, rnd = np.random.default_rng(seed), random.Random(seed)
    songs = [([unit(r.normal(size=8)) for _ in range(4)], unit(r.normal(size=24)), [rnd.randrange(1 << 32) for _ in range(12)]) for _ in range(25)]
    rows = []
    for i in range(n):
        k = rnd.randrange(25)
        mert, cover, items = songs[k]
        at = US + i * 3_600_000_000 + rnd.randrange(1000)
        if i > n - 20:
            at += 40 * 86_400_000_000
        kind = rnd.randrange(5)
        rows.append((
            k % 3, i, at, items if kind in (0, 4) else None, [12.0, 3.0, None][rnd.randrange(3)] if kind in (0, 4) else None,
            rnd.sample(mert, 2) if kind in (1, 4) else None, np.roll(np.array(cover).reshape(12, 2), rnd.randrange(12), axis=0).ravel().tolist() if kind in (2, 4) else None,
            i if kind == 3 else None))
    return rows


def test_batch_in_order(spark):
    rows = sightings()
    buckets, want = {}, []
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        s = row([c.split()[0] for c in learning.SIGHTING.split(", ")], r)
        want.append(buckets.setdefault(r[0], learning.Bucket({}, 30 * 86_400_000_000, 12)).fold(s))
    got = learning.learned(spark.createDataFrame(rows, learning.SIGHTING).repartition(5), 12, forget_seconds=30 * 86400).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    methods = {m: sum(x[4] == m for x in want) for m in ("FINGERPRINT", "EMBEDDING", "COVER", None)}
    assert min(methods.values()) >= 5 and max(x[7] for x in want) >= 4
    late = [x for x in want if x[1] > 140]
    assert sum(x[3] for x in late) >= 8  # all was forgotten by then


def test_thresholds_by_the_shorter_of_the_pair():
    items = list(range(100, 140))
    part = items[:12] + [7] * 28  # 0.3 of the items agree

    def method(a, b):
        bucket = learning.Bucket({}, 10**15, 12)
        for i, (x, d) in enumerate(((items, a), (part, b))):
            got = bucket.fold(row(["bucket", "sighting_id", "seen_at", "items", "duration", "mert", "cover", "hint"], (0, i, i, x, d, None, None, None)))
        return got[4]

    assert method(30.0, 30.0) == "FINGERPRINT" and method(30.0, 5.0) is None and method(5.0, 30.0) is None and method(None, None) == "FINGERPRINT"
    assert learning.least_score(5.0) == pytest.approx(0.3684 * 1.15) and learning.least_score(0) == 0.30


def test_caps():
    r = np.random.default_rng(1)
    bucket = learning.Bucket({}, 10**15, 12)
    names = ["bucket", "sighting_id", "seen_at", "items", "duration", "mert", "cover", "hint"]
    items = list(range(50))
    for i in range(30):
        bucket.fold(row(names, (0, i, i, items, 30.0, [unit(r.normal(size=16)) for _ in range(4)], unit(r.normal(size=24)), None)))
    (entry,) = bucket.entries.values()
    assert (entry.count, len(entry.mert), len(entry.cover)) == (30, learning.MOST_SEGMENTS, learning.MOST_COVERS)


def streamed(spark, df, tmp_path, key, processor, batches, late="3 hours"):
    """Rows in files of their time, each shuffled and one batch; the last row closes the time."""
    first = df.agg(F.min("time")).first()[0]
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = ordered.folded(stream, key, processor, time="time", late=late)
    name = f"s{abs(hash(str(tmp_path)))}"
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240) and first is not None
    return spark.table(name), q


def test_stream_equals_batch(spark, rocks, tmp_path):
    rows = sightings(90)
    names = learning.SIGHTING.replace("sighting_id", "id").replace("seen_at", "at")
    df = spark.createDataFrame(rows, names).withColumn("time", F.timestamp_micros("at")).drop("at")
    end = spark.createDataFrame([(0, 10**6, US + 200 * 86_400_000_000, None, None, None, None, None)], names).withColumn("time", F.timestamp_micros("at")).drop("at")
    # each batch holds hours out of order, and reaches an hour into the next one
    batches = [df.filter(F.floor((F.col("id") + F.col("id") % 2) / 30) == i).orderBy(F.rand(i)) for i in range(4)]
    got, _ = streamed(spark, df, tmp_path, "bucket", ordered.Learning(12, 30 * 86400), [*batches, end])
    want = learning.learned(spark.createDataFrame(rows, learning.SIGHTING), 12, forget_seconds=30 * 86400)
    cols = [c.split()[0] for c in learning.FOUND.split(", ")]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_admission_stream_equals_batch_and_ends_empty(spark, rocks, tmp_path):
    r = random.Random(4)
    t, rows = US, []
    for i in range(600):
        t += r.choice([1, 2, 5, 5, 90]) * 1_000_000
        rows.append((i, r.randrange(3), t))
    df = spark.createDataFrame(rows, "id long, key long, at long").withColumn("time", F.timestamp_micros("at")).drop("at")
    far = spark.createDataFrame([(10**6, 0, t + 10**12), (10**6 + 1, 1, t + 10**12 + 10**11)], "id long, key long, at long").withColumn("time", F.timestamp_micros("at")).drop("at")
    batches = [df.filter(F.floor((F.col("id") + F.col("id") % 3) / 200) == i).orderBy(F.rand(i)) for i in range(4)]
    got, q = streamed(spark, df, tmp_path, "key", ordered.Admission(3, 60), [*batches, far], late="10 minutes")
    want = registry.admitted(df.select(F.col("id").alias("event_id"), "key", F.col("time").alias("ts")), 3, 60)
    rows_of = lambda x: sorted(map(tuple, x.collect()))
    assert rows_of(got.filter("id < 1000000").select("id", "key", "admitted", "retry_after")) == rows_of(want)
    # what is left is what the closing rows brought
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 6


def test_one_dense_key(spark):
    """A key of 200,000 events without a gap, in batches that hold a part of it at a time."""
    df = spark.range(200_000).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("key"), F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"))
    got = registry.admitted(df, 10, 60)
    assert got.filter("admitted").count() == 33_340 and "MapInPandas" in got._jdf.queryExecution().executedPlan().toString()


def test_query(spark, sf):
    rows = catalogue.QUERIES["registry_learned"](spark, sf).collect()
    again = [r for r in rows if not r.is_new]
    assert {r.method for r in again} >= {"EMBEDDING", "COVER"} and len(again) >= 100


class _Whole(learning.Bucket):
    """Looks at all entries for each sighting."""

    def prune(self, now):
        gone = [k for k, e in self.entries.items() if e.last_seen + self.forget <= now]
        for k in gone:
            del self.entries[k]
        return gone

    def _recent(self):
        return sorted(self.entries.items(), key=lambda x: (-x[1].last_seen, x[0]))[: learning.MOST_ENTRIES]

    def _arrays(self, key, e):
        self.arrays.clear()
        return super()._arrays(key, e)


def test_bucket_keeps_its_order(monkeypatch):
    """Entries stay in the order last seen, late sightings and equal times included, and give what a look at all of them gives."""
    import random
    from types import SimpleNamespace

    monkeypatch.setattr(learning, "MOST_ENTRIES", 4)
    r, g = random.Random(2), np.random.default_rng(2)
    base = [x / np.linalg.norm(x) for x in g.normal(size=(12, 8))]
    a, b = learning.Bucket({}, 40, 12), _Whole({}, 40, 12)
    same = 0
    for i in range(600):
        v, c = base[r.randrange(12)], np.resize(base[r.randrange(12)], 72) / 3
        at = i // 3 - (r.randrange(9) if r.random() < 0.2 else 0)
        s = SimpleNamespace(bucket=0, sighting_id=i, seen_at=at, items=None, duration=None, mert=[v] if i % 3 else None, cover=c if i % 2 else None, hint=None)
        x, y = a.fold(s), b.fold(s)
        assert x == y
        assert sorted(a.entries) == sorted(b.entries)
        seen = [e.last_seen for e in a.entries.values()]
        assert seen == sorted(seen) and set(a.arrays) <= set(a.entries)
        same += not x[3]
    assert 100 < same < 590


def test_whole_compares_all_and_keeps_all():
    """Without caps an entry seen long ago is still matched, and an entry keeps all it could not be recognised by."""
    names = [c.split()[0] for c in learning.SIGHTING.split(", ")]
    eye = np.eye(700)
    bucket = learning.Bucket({}, 10**15, 12, caps=learning.Caps())
    for i in range(600):
        assert bucket.fold(row(names, (0, i, i, None, None, [eye[i]], None, None)))[3]
    assert bucket.fold(row(names, (0, 1000, 1000, None, None, [eye[0]], None, None)))[2:5] == (0, False, "EMBEDDING")
    for i in range(100):
        got = bucket.fold(row(names, (0, 2000 + i, 2000 + i, None, None, [eye[0], eye[600 + i]], None, None)))
        assert got[2] == 0 and got[6] == 1
    assert len(bucket.entries[0].mert) == 101
    assert bucket.fold(row(names, (0, 3000, 3000, None, None, [eye[699]], None, None)))[2] == 0


def test_query_equals_one_registry(spark, tmp_path):
    """Buckets of links give what a registry of all sightings gives, partners on two sides of a locality hash included."""
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 64))
    v = [base[k + side] + 0.05 * r.normal(size=64) for k in r.integers(0, 30, 200) for side in (0, 30)]
    spark.createDataFrame([(i, x.tolist(), i % 10) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = catalogue.QUERIES["registry_learned"](spark, str(tmp_path)).collect()
    assert len({x.bucket for x in rows}) > 20
    got = sorted(tuple(x)[1:] for x in rows)
    x = np.array(v, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cover = lambda i: np.r_[x[2 * i], np.zeros(8)]
    rows = []
    for i in range(200):
        rows.append((i * 60_000_000, i, [x[2 * i], x[2 * i + 1]], cover(i)))
        again = i * 60_000_000 + 86_400_000_000, i + 200
        if i % 3 == 0:
            rows.append((*again, [x[2 * i]], None))
        if i % 3 == 1:
            rows.append((*again, None, np.roll(cover(i).reshape(12, 6), 4, axis=0).ravel()))
    one = learning.Bucket({}, 90 * 86_400_000_000, 12, caps=learning.Caps())
    names = [c.split()[0] for c in learning.SIGHTING.split(", ")]
    want = sorted(one.fold(row(names, (0, i, at, None, None, m, c, None)))[1:] for at, i, m, c in sorted(rows, key=lambda y: y[:2]))
    assert [y[:4] + y[5:] for y in got] == [y[:4] + y[5:] for y in want]
    assert sum(not y[2] for y in want) > 200 and len({y[1] for y in want}) > 20


def test_forest():
    r = np.random.default_rng(4)
    for n in (5, 40, 300):
        a, b = r.integers(0, 200, (2, n))
        boss = {i: i for i in range(200)}
        for _ in range(200):
            for u, v in zip(a.tolist(), b.tolist()):
                boss[u] = boss[v] = min(boss[u], boss[v])
        got = dict(zip(*(z.tolist() for z in learning.forest(a, b))))
        assert all(got.get(i, i) == boss[i] for i in range(200))
