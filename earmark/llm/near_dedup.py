"""Near-duplicate classes by order MinHash with verified banded alignment.

Texts are split into words; equal word sequences form a class at once. Of each
class, one text is sketched: its five-word shingles are labelled by occurrence, each
of ``sketches`` hash orders picks its ``take`` smallest, and these, kept in text
order, make one bucket key, so texts collide when they share shingles in the same
order, which follows edit similarity rather than set overlap. Candidates are
verified: 1 - edit distance / longer length, over words, must reach ``least``.

Classes are found in two passes, and neither emits the pairs of a bucket. The first
compares each text with two others, which lead its first buckets, and so joins a
group of copies of any size with two pairs a text. The second takes the buckets that
then still hold two components: their members, in blocks drawn by hash, meet block by
block, and word counts folded to ``FOLD`` numbers, which bound the edit distance from
below, leave few pairs to read and align. (Before, the roots of two components of each such bucket
meet, which settles most of them.) Two blocks first give the two likeliest pairs of each
component, so that a group of which every text is still its own component gives pairs in
proportion to its size; of the components left, they give the two likeliest pairs of each two; then,
where links don't join those, all others. So no candidate is lost: two members of a bucket are compared unless links
join them or their counts rule it out.

Verified links are joined to components by alternating large-star and small-star
rounds, each cut to a table; tables go as soon as they have been read for the last
time. Bucket counts and minima are partial aggregates, the joins on hot keys are
shuffle joins that Spark may split, and no window or list holds a whole bucket.

Rows are told apart by a number of their own and texts by their words, so ids may
repeat: rows of one id and different texts each get the class of their own text.
Null texts count as empty; empty texts are equal to each other; texts of fewer than
five words match only exactly; repeated rows stay rows of their own with the same
class; a row without an id gets the class of its text, null if no text of the class
has an id; ties between ids go to the smaller one. Very long texts are compared whole:
words that both hold once are aligned first, and only if that bound is too high the
exact distance is taken, in time that grows with the product of lengths over 30. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEP, cut, drop, give_back, spare

SHINGLE = 5
#: Word counts of a text are folded to this many numbers of up to 15, two in a byte.
FOLD = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _labelled(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles, unlike for each occurrence of the same shingle."""
    n = len(words) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        h = _mix(h + words[j : j + n])
    order = np.argsort(h, kind="stable")
    same = np.r_[False, h[order][1:] == h[order][:-1]]
    if same.any():
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(same, 0, at))
        count = np.empty(n, np.uint64)
        count[order] = (at - first).astype(np.uint64)
        h = np.where(count > 0, _mix(h + count * np.uint64(0x9E3779B97F4A7C15)), h)
    return h


def order_minhash(words: np.ndarray, sketches: int, take: int) -> np.ndarray:
    """One bucket key for each hash order; none for texts shorter than a shingle."""
    if len(words) < SHINGLE:
        return np.empty(0, np.int64)
    h = _labelled(words)
    low = (h >> np.uint64(32)).astype(np.uint32)
    seeds = _mix(np.arange(1, sketches + 1, dtype=np.uint64))
    mul = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = seeds.astype(np.uint32)
    picks = np.empty((sketches, min(take, len(h))), np.int64)
    step = max(1, 60_000 // len(low))
    for s in range(0, sketches, step):
        x = (low[None, :] ^ add[s : s + step, None]) * mul[s : s + step, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        rows = np.arange(len(x))
        for t in range(picks.shape[1]):
            at = x.argmin(1)
            picks[s : s + step, t] = at
            x[rows, at] = np.uint32(0xFFFFFFFF)
    picks.sort(1)
    key = seeds.copy()
    for t in range(picks.shape[1]):
        key = _mix(key + h[picks[:, t]])
    return key.astype(np.int64)


def _distance(a: list[int], b: list[int], limit: int) -> int:
    """Edit distance by bit-parallel columns; more than limit if it must exceed it."""
    if not a or not b:
        return max(len(a), len(b))
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    up, down, score, left = full, 0, len(a), len(b)
    for x in b:
        eq = masks.get(x, 0)
        flat = eq | down
        run = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(run | up)), up & run
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        left -= 1
        if score - left > limit:
            return limit + 1
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(flat | more)) & full, more & flat & full
    return score


def _anchored(a: np.ndarray, b: np.ndarray, limit: int, most: int = 1000) -> int:
    """An upper bound of the edit distance: words that each text holds once, in a longest common order, are aligned."""
    ua, ia, ca = np.unique(a, return_index=True, return_counts=True)
    ub, ib, cb = np.unique(b, return_index=True, return_counts=True)
    _, x, y = np.intersect1d(ua[ca == 1], ub[cb == 1], assume_unique=True, return_indices=True)
    pa, pb = ia[ca == 1][x], ib[cb == 1][y]
    order = np.argsort(pa)
    pa, pb = pa[order].tolist(), pb[order].tolist()
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(pb)
    for i, p in enumerate(pb):
        k = bisect.bisect_left(ends, p)
        back[i] = at[k - 1] if k else -1
        ends[k : k + 1] = [p]
        at[k : k + 1] = [i]
    chain, i = [(len(a), len(b))], at[-1] if at else -1
    while i >= 0:
        chain.append((pa[i], pb[i]))
        i = back[i]
    total, i, j = 0, 0, 0
    for p, q in reversed(chain):
        if p > i or q > j:
            total += _distance(a[i:p].tolist(), b[j:q].tolist(), limit) if max(p - i, q - j) <= most else max(p - i, q - j)
            if total > limit:
                break
        i, j = p + 1, q + 1
    return total


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether 1 - edit distance / longer length reaches least."""
    longer = max(len(a), len(b))
    limit = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    short = min(len(a), len(b))
    diff = np.flatnonzero(a[:short] != b[:short])
    if not len(diff) or len(diff) + abs(len(a) - len(b)) <= limit:
        return True
    head = diff[0]
    back = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = min(back[0] if len(back) else short, short - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if max(len(a), len(b)) <= limit:
        return True
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if max(len(a), len(b)) - np.minimum(ca[ia], cb[ib]).sum() > limit:
        return False
    if min(len(a), len(b)) > 1000 and _anchored(a, b, limit) <= limit:
        return True
    if len(a) > len(b):
        a, b = b, a
    return _distance(a.tolist(), b.tolist(), limit) <= limit


def folded(words: np.ndarray) -> bytes:
    """Word counts by hash cell, up to 15 each."""
    cells = np.minimum(np.bincount((words % np.uint64(FOLD)).astype(np.int64), minlength=FOLD), 15).astype(np.uint8)
    return (cells[0::2] | cells[1::2] << 4).tobytes()


def unfolded(rows: list[bytes]) -> np.ndarray:
    """Counts of each row; cells of one half, then of the other."""
    x = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return np.concatenate([x & 15, x >> 4], 1)


def unlike_by_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For folded counts a (one text) and b (rows, a text each): a lower bound of each edit distance.

    An edit adds a word, takes one or does both, so the edit distance is no less than
    the words one text has more in all cells together; cutting counts off at 15 lowers that.
    """
    both = np.maximum(b, a).sum(1, dtype=np.int32)
    return both - np.minimum(b.sum(1, dtype=np.int32), a.sum(dtype=np.int32))


def fingerprint(text: Column) -> Column:
    """16 bytes that equal word sequences share."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WORD_SEP, " "))))


def sketch(docs: DataFrame, sketches: int, take: int) -> DataFrame:
    """rid (a number for each row), doc_id, fp, words (32 bits each, compressed), n_words, folded counts and keys."""
    schema = pa.schema([
        ("rid", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.binary()), ("words", pa.binary()), ("n_words", pa.int32()), ("folded", pa.binary()), ("keys", pa.list_(pa.int64())),
    ])

    def run(batches):
        import xxhash
        import zstandard

        known: dict[bytes, int] = {}
        press = zstandard.ZstdCompressor(level=3)

        def table(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            rids, ids, fps, texts = batch.columns
            out, room = [], 0
            for i in range(batch.num_rows):
                parts = (texts[i].as_py() or "").encode().split()
                try:
                    w = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
                except KeyError:
                    if len(known) > 200_000:
                        known.clear()
                    for p in parts:
                        if p not in known:
                            known[p] = xxhash.xxh64_intdigest(p)
                    w = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
                packed = press.compress(w.astype(np.uint32).tobytes())
                out.append((rids[i].as_py(), ids[i].as_py(), fps[i].as_py(), packed, len(parts), folded(w), order_minhash(w, sketches, take)))
                room += len(parts)
                if room > 2_000_000:
                    yield table(out)
                    out, room = [], 0
            if out:
                yield table(out)
        known.clear()
        give_back()

    mine = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), fingerprint(F.col("text")).alias("fp"), "text")
    return mine.mapInArrow(run, "rid long, doc_id long, fp binary, words binary, n_words int, folded binary, keys array<long>")


def verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) with ok; words: (node, words), one row for each text in pairs."""
    left = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ok", pa.bool_())])

    def run(batches):
        import zstandard

        press = zstandard.ZstdDecompressor()
        text = lambda x: np.frombuffer(press.decompress(x.as_py()), np.uint32)
        for batch in batches:
            ok = [alike(text(x), text(y), least) for x, y in zip(batch.column("wa"), batch.column("wb"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], schema=schema)
        give_back()

    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long, ok boolean")


def _places(groups: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The place of each pair among those of its group; order: pairs by group, then likelihood."""
    by = groups[order]
    at = np.arange(len(by))
    out = np.empty(len(by), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(np.r_[True, by[1:] != by[:-1]], at, 0))
    return out


def met(open_: DataFrame, marks: DataFrame, block: int, most: int | None, least: float, each: bool = False) -> DataFrame:
    """Pairs (a, b), a > b, of one bucket and two components that folded counts leave open.

    open_: (key, n, node, comp), n being the members of the bucket; marks: (node, n_words,
    folded, keys). Members stand in blocks of about ``block``, drawn by hash, and blocks
    meet as wholes: one row for each two blocks of a bucket. A pair comes from the first
    bucket it shares, by 32 bits of the keys. If ``most`` is given, two blocks give that
    many of the likeliest pairs of each two components, or with ``each`` of each component, as the larger and as the smaller; key names the bucket if there were more.
    """
    blocks = -F.floor(-F.col("n") / block)
    one = F.struct("node", "comp", "n_words", "folded", "keys")
    placed = open_.withColumn("part", F.pmod(F.xxhash64("node"), blocks)).join(marks, "node")
    full = cut(placed.groupBy("key", "part").agg(F.collect_list(one).alias("x")))
    two = full.select("key", F.col("part").alias("part2"), F.col("x").alias("y"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])

    def side(column, i):
        rows = column[i].values
        cells = unfolded(rows.field("folded").to_pylist())
        keys = rows.field("keys").flatten().to_numpy().reshape(len(rows), -1)
        return (*(rows.field(c).to_numpy() for c in ("node", "comp", "n_words")), cells, keys)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (node, comp, size, cells, keys), (node2, comp2, size2, cells2, keys2) = side(batch.column("x"), i), side(batch.column("y"), i)
                mark, found = batch.column("mark")[i].as_py(), []
                for k in range(len(node)):
                    limit = ((1 - least) * np.maximum(size[k], size2) + 1e-9).astype(np.int64)
                    near = np.flatnonzero((comp2 != comp[k]) & (abs(size2 - size[k]) <= limit))
                    if len(near):
                        bound = unlike_by_counts(cells[k], cells2[near])
                        near, bound = near[bound <= limit[near]], bound[bound <= limit[near]]
                        first = keys[k][(keys2[near] == keys[k]).argmax(1)] == mark
                        near, bound = near[first], bound[first]
                        found.append((np.full(len(near), node[k]), node2[near], np.full(len(near), comp[k]), comp2[near], bound))
                if not found:
                    continue
                a, b, ca, cb, bound = map(np.concatenate, zip(*found))
                pair = np.stack([np.maximum(a, b), np.minimum(a, b), np.maximum(ca, cb), np.minimum(ca, cb)])
                if batch.column("same")[i].as_py():  # a block that meets itself shows each pair twice
                    pair, at = np.unique(pair, axis=1, return_index=True)
                    bound = bound[at]
                short = None
                if most is not None and pair.shape[1] > most:
                    if each:
                        kept = np.logical_or(*(_places(c, np.lexsort((*pair[1::-1], bound, c))) < most for c in pair[2:]))
                    else:
                        order = np.lexsort((*pair[1::-1], bound, *pair[:1:-1]))
                        pair = pair[:, order]
                        at = np.arange(len(order))
                        new = np.r_[True, (pair[2:, 1:] != pair[2:, :-1]).any(0)][: len(order)]
                        kept = at - np.maximum.accumulate(np.where(new, at, 0)) < most
                    pair, short = pair[:, kept], None if kept.all() else batch.column("key")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array([short] * pair.shape[1], pa.int64())], schema=schema)
        give_back()

    both = full.join(two, "key").filter("part <= part2")
    return both.select("key", F.hash("key").alias("mark"), (F.col("part") == F.col("part2")).alias("same"), "x", "y").mapInArrow(run, "a long, b long, key long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; root: the smallest node of its component."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), narrow=True)
    parts = max(8, edges.count() // 250_000)
    while True:
        # done when all edges lead straight from a node to a root
        ends = edges.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        if ends.filter("n > 1").isEmpty() and edges.select(F.col("v").alias("u")).join(edges, "u", "left_semi").isEmpty():
            break
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = cut(large.distinct(), parts, narrow=True)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), parts, narrow=True)
        drop(before, large)
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._cut_at = edges._cut_at
    return out


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after further links (a, b): only the components that links join are worked on."""
    x, y = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    over = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    new = components(over.filter("a <> b"))
    to = new.select(F.col("node").alias("root"), F.col("root").alias("to"))
    out = cut(roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")).union(new.select("node", "root")), narrow=True)
    drop(roots, new)
    return out


def _links(reps: DataFrame, table: DataFrame, least: float, first: int, block: int) -> DataFrame:
    """(node, root) of the texts that are linked; reps: (node, n_words, folded, keys)."""
    # two pairs a text: with the text that leads most of its first buckets, and with the smallest that leads one
    some = reps.select("node", F.explode(F.slice("keys", 1, first)).alias("key"))
    leads = some.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b <> last").select("key", "b")
    led = some.join(leads, "key").filter("node <> b").groupBy("node").agg(F.mode("b", True).alias("most"), F.min("b").alias("b"))
    pairs = cut(led.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("most", "b"))).alias("b")))
    only = lambda rows, ids: cut(rows.join(cut(ids.distinct()).filter("node >= 0"), "node", "left_semi"), bloom=True)
    texts = lambda ids: only(table.select(F.col("rid").alias("node"), "words"), ids)
    nodes = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    words = texts(nodes(pairs))
    done = cut(verified(pairs, words, least))
    drop(pairs, words)
    roots = components(done.filter("ok"))
    # buckets that hold two components: the roots of two of them meet, then the buckets that still hold two are opened
    split = lambda m: m.groupBy("key").agg(F.min("comp").alias("b"), F.max("comp").alias("a"), F.count("*").alias("n")).filter("a <> b")
    for last in (False, True):
        keyed = cut(reps.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("comp"), "keys"))
        member = keyed.select("node", "comp", F.explode("keys").alias("key"))
        mixed = cut(split(member))
        if last:
            open_ = cut(member.join(mixed.select("key", "n").hint("merge"), "key").select("key", "n", "node", "comp"))
        else:
            pairs = cut(mixed.select("a", "b").distinct().join(done, ["a", "b"], "left_anti"))
            words = texts(nodes(pairs))
            found = cut(verified(pairs, words, least))
            before, done = done, cut(done.union(found))
            roots = joined(roots, found.filter("ok"))
            drop(before, pairs, words, found)
        drop(keyed, mixed)
    packed = reps.select("node", "n_words", "folded", F.transform("keys", lambda k: F.hash(k)).alias("keys"))
    marks = only(packed, open_.select("node"))
    for most, each in ((2, True), (2, False), (None, False)):
        pairs = cut(met(open_, marks, block, most, least, each).join(done, ["a", "b"], "left_anti"))
        words = texts(nodes(pairs))
        found = cut(verified(pairs.select("a", "b"), words, least))
        roots = joined(roots, found.filter("ok"))
        if most is None or pairs.filter("key is not null").isEmpty():
            break
        before = open_
        open_ = open_.join(pairs.select("key").distinct(), "key", "left_semi").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
        open_ = cut(open_.join(split(open_).select("key", "n"), "key").select("key", "n", "node", "comp"))
        last, done = done, cut(done.union(found))
        drop(before, pairs, words, found, last)
    drop(done, marks, open_, pairs, words, found)
    return roots


def _grouped(docs: DataFrame, least: float, sketches: int, take: int, first: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, doc_id, fp) and texts (fp, text_id, class_id, root)."""
    if least < 0.8:
        raise ValueError("least must be 0.8 or more")
    table = cut(sketch(docs, sketches, take))
    texts = cut(table.groupBy("fp").agg(F.min("rid").alias("node"), F.min("doc_id").alias("text_id")))
    reps = table.select(F.col("rid").alias("node"), "n_words", "folded", "keys").join(texts.hint("merge"), "node", "left_semi")
    reps = cut(reps.filter(F.size("keys") > 0))
    roots = _links(reps, table, least, first, block)
    rows = cut(table.select("rid", "doc_id", "fp"))
    drop(reps, table)
    linked = texts.join(roots, "node", "left").select("fp", "text_id", F.coalesce("root", "node").alias("root"))
    least_id = linked.groupBy("root").agg(F.min("text_id").alias("class_id"))
    final = cut(linked.join(least_id, "root"))
    drop(texts, roots)
    return rows, final


def classes(docs: DataFrame, *, least: float = 0.8, sketches: int = 64, take: int = 2, first: int = 16, block: int = 256) -> DataFrame:
    """doc_id, text_id (smallest id of equal texts) and class_id (smallest id of the near-duplicate class)."""
    rows, final = _grouped(docs, least, sketches, take, first, block)
    return rows.join(final, "fp").select("doc_id", "text_id", "class_id")


def keep_one(docs: DataFrame, *, least: float = 0.8, sketches: int = 64, take: int = 2, first: int = 16, block: int = 256) -> DataFrame:
    """One row of each class, with the columns of docs: a row of the class's id, or of no id where no row has one."""
    rows, final = _grouped(docs, least, sketches, take, first, block)
    # of texts that share the smallest id of a class, the one of the smallest fingerprint
    kept = final.filter(F.col("text_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(
        F.min(F.struct(F.hex("fp").alias("fp"), F.col("text_id").alias("id"))).alias("x")
    )
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    by = [spare(docs, "__id"), spare(docs, "__fp")]
    kept = cut(kept.select(F.coalesce(F.col("x.id").cast("string"), F.lit("")).alias(by[0]), F.unhex("x.fp").alias(by[1])))
    twice = rows.select(name.alias(by[0]), F.col("fp").alias(by[1])).join(kept, by, "left_semi").groupBy(*by).count()
    repeats = not twice.filter("count > 1").isEmpty()
    drop(rows, final)
    out = docs.withColumns({by[0]: name, by[1]: fingerprint(F.col("text"))}).join(kept, by, "left_semi")
    if repeats:
        out = out.dropDuplicates(by)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
