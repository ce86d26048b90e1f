"""Removal of passages that repeat across documents, down to windows of ``window`` words.

A word goes if a window of consecutive words covers it whose word sequence also starts
in a document of smaller id. Nothing is sampled; the steps only avoid a row for each window.

1. Phrases. Each window is filed under its *phrase*: the least of its 8-word hashes, the
   leftmost if equal. Neighbouring windows share phrases, so a document is a chain of *blocks*, the
   stretches of windows filed under one phrase. Equal windows have equal phrases, so only blocks
   of phrases that occur in two documents matter.
2. Confirmed passages. Equal blocks are one; the least document that holds it is its owner.
   If all blocks of a phrase are equal, the block is a passage. Otherwise the windows of the
   different blocks are compared by hash; windows that stand in the same set of blocks form a passage, owned by
   the least document. The owner's text gives the wording.
3. Automata. Documents are dealt into shards; a passage is sent to the shards where its blocks
   occur after its owner's. Each shard compiles its passages to one Aho-Corasick automaton over words and
   streams its documents, whole, through it. What an automaton finds is compared word by
   word, so a clash of hashes can't remove anything.

Work grows with the text: blocks are about one in 22 words; a group of copies, however
large, is one block before anything is joined; a window compared is a row, never a pair. Shards
have a bounded size, so automata have one too, and partitions take shards in turn.

Null texts have no words. Documents without id are returned whole: they are before and after none.
Rows of one id never remove words of each other; equal windows of the owning document all stay.
Texts below ``window`` words are kept. Long texts are hashed in overlapping stretches. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, give_back

PHRASE = 8
STRETCH = 1 << 20
SHARD_BYTES = 1_000_000
_AT = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_UNKNOWN = "\x01\x01"


class WordHashes(dict):
    """Hash of each word; common words are hashed once."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Sequences:
    """Hashes of any run of words, by prefix sums modulo 2**64."""

    def __init__(self, hashes: np.ndarray):
        n = 1 << max(10, int(len(hashes)).bit_length())
        power, self.inverse = _powers(n)
        self.prefix = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * power[: len(hashes)], out=self.prefix[1:])

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        return _mix((self.prefix[start + length] - self.prefix[start]) * self.inverse[start] + np.asarray(length).astype(np.uint64))


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """Least key of each run of ``span`` keys."""
    out, have = keys, 1
    while have * 2 <= span:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    more = span - have
    return np.minimum(out[:-more], out[more:]) if more else out


def blocks(hashes: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(phrase, block, start, windows) of each block; texts end at ``ends`` and no window crosses an end."""
    none = np.empty(0, np.int64)
    n = len(hashes) - window + 1
    if n <= 0:
        return none, none, none, none
    seq = Sequences(hashes)
    phrase = seq.hash(np.arange(len(hashes) - PHRASE + 1), PHRASE)
    at = _least((phrase & ~_AT) | np.arange(len(phrase), dtype=np.uint64), window - PHRASE + 1)[:n] & _AT
    end_of = np.repeat(ends, np.diff(np.r_[0, ends]))
    valid = np.flatnonzero(np.arange(n) + window <= end_of[:n])
    if not len(valid):
        return none, none, none, none
    at = at[valid].astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    start, count = valid[first], np.diff(np.r_[first, len(at)])
    return phrase[at[first]].view(np.int64), seq.hash(start, count + window - 1).view(np.int64), start, count


def _stretches(n: int, window: int) -> Iterator[tuple[int, int]]:
    """Pieces of a long text that share window - 1 words with the next, so that each window lies in one."""
    s = 0
    while True:
        e = min(n, s + STRETCH)
        yield s, e
        if e == n:
            return
        s = e - window + 1


def _block_rows(window: int):
    schema = pa.schema([("phrase", pa.int64()), ("block", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("windows", pa.int32())])

    def run(batches):
        known = WordHashes()

        def close(ids, offsets, parts):
            ends = np.cumsum([len(p) for p in parts])
            phrase, block, start, count = blocks(np.concatenate(parts), ends, window)
            which = np.searchsorted(ends, start, side="right")
            begins = np.r_[0, ends[:-1]]
            columns = phrase, block, np.array(ids)[which], start - begins[which] + np.array(offsets)[which], count.astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            ids, offsets, parts, held = [], [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = (text.as_py() or "").encode().split()
                if len(words) < window:
                    continue
                doc_id = doc_id.as_py()
                for s, e in _stretches(len(words), window):
                    ids.append(doc_id)
                    offsets.append(s)
                    parts.append(known.of(words[s:e]))
                    held += e - s
                    if held >= STRETCH:
                        yield close(ids, offsets, parts)
                        ids, offsets, parts, held = [], [], [], 0
            if parts:
                yield close(ids, offsets, parts)
        known.clear()
        give_back()

    return run, "phrase long, block long, doc_id long, start long, windows int"


def _wording(window: int):
    """Words of the blocks a document owns, and the hashes of their windows where blocks of their phrase differ."""
    schema = pa.schema([("phrase", pa.int64()), ("block", pa.int64()), ("owner", pa.int64()), ("last", pa.int64()), ("words", pa.string()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        known = WordHashes()
        for batch in batches:
            rows, size = [], 0
            for doc_id, text, wanted in zip(*batch.columns):
                words, doc_id = text.as_py().encode().split(), doc_id.as_py()
                for w in wanted.as_py():
                    part = words[w["start"] : w["start"] + w["windows"] + window - 1]
                    hashes = known.of(part)
                    seq = Sequences(hashes)
                    # another text of the same id may lack the block
                    if len(part) != w["windows"] + window - 1 or seq.hash(np.array([0]), len(part)).view(np.int64)[0] != w["block"]:
                        continue
                    each = seq.hash(np.arange(w["windows"]), window).view(np.int64) if w["mixed"] else None
                    rows.append((w["phrase"], w["block"], doc_id, w["last"], b" ".join(part).decode(), each))
                    size += 1
                    if size >= 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        known.clear()
        give_back()

    return run, "phrase long, block long, owner long, last long, words string, hashes array<long>"


class Automaton:
    """Passages as an Aho-Corasick automaton over words; each word is two letters of separate alphabets, so nodes have few children."""

    def __init__(self, passages: list[tuple[bytes, int]]):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        self.tree = ahocorasick.Automaton()
        for text, owner in passages:
            words = text.split()
            for w in words:
                if w not in self.letters:
                    high, low = divmod(len(self.letters), 128)
                    self.letters[w] = chr(0x100 + low) + chr(0x10000 + high)
            key = "".join(map(self.letters.__getitem__, words))
            before = self.tree.get(key, None)
            if before is None or before[0] > owner:
                self.tree.add_word(key, (owner, len(words)))
        if passages:
            self.tree.make_automaton()

    def covered(self, words: list[bytes], doc_id: int) -> np.ndarray | None:
        """Which words lie in a passage of a smaller document; None if none does."""
        if not self.letters:
            return None
        edges = None
        for end, (owner, n) in self.tree.iter("".join(map(self.letters.get, words, repeat(_UNKNOWN)))):
            if owner < doc_id:
                if edges is None:
                    edges = np.zeros(len(words) + 1, np.int32)
                end = (end + 1) // 2
                edges[end - n] += 1
                edges[end] -= 1
        return None if edges is None else np.cumsum(edges[:-1]) > 0


def _strip(batches):
    """Rows of a shard come passages first, then documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("gone", pa.bool_())])
    shard, passages, automaton = None, [], None
    for batch in batches:
        rows, size = [], 0
        for at, is_doc, doc_id, text in zip(*(c for c in batch.columns)):
            if at.as_py() != shard:
                shard, passages, automaton = at.as_py(), [], None
            doc_id, text = doc_id.as_py(), (text.as_py() or "").encode()
            if not is_doc.as_py():
                passages.append((text, doc_id))
                continue
            if automaton is None:
                automaton, passages = Automaton(passages), []
            words = text.split()
            gone = None if doc_id is None else automaton.covered(words, doc_id)
            kept = words if gone is None else [words[i] for i in np.flatnonzero(~gone)]
            rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode(), gone is not None))
            size += len(text)
            if size >= 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    automaton = None
    give_back()


def _digests(batches):
    for batch in _strip(batches):
        sums = pa.array([hashlib.sha256(k.as_py().encode()).hexdigest() for k in batch.column("kept")], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_removed"), sums], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _shard(id_column: str, n: int):
    return F.pmod(F.xxhash64(id_column), F.lit(n)).cast("int")


def passages(docs: DataFrame, n_shards: int, window: int = 50) -> DataFrame:
    """(shard, owner, words): wording of confirmed passages, for each shard with documents after the owner that hold it."""
    found = cut(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(*_block_rows(window)))
    twice = found.groupBy("phrase").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("phrase")
    twice = cut(twice)  # by itself, so that Spark can split a hot phrase in the join
    again = cut(found.join(twice, "phrase", "left_semi"), bloom=True)
    drop(found, twice)
    distinct = again.groupBy("phrase", "block").agg(F.min(F.struct("doc_id", "start", "windows")).alias("home"), F.max("doc_id").alias("last"))
    distinct = cut(distinct.select("phrase", "block", "home.*", "last"))
    several = distinct.groupBy("phrase").agg((F.count("*") > 1).alias("mixed"))
    distinct = distinct.join(several, "phrase")
    wanted = distinct.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "phrase", "block", "last", "mixed")).alias("wanted"))
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "wanted")
    worded = cut(texts.mapInArrow(*_wording(window)), bloom=True)

    # windows of phrases with several blocks: those that stand in the same blocks make one passage
    windows = worded.filter("hashes IS NOT NULL").select("phrase", "block", "owner", "last", F.posexplode("hashes").alias("at", "window"))
    same = windows.groupBy("phrase", "window").agg(
        F.min(F.struct("owner", "block")).alias("home"), F.max("last").alias("last"),
        F.bit_xor(F.xxhash64("block", "phrase")).alias("set"), F.count("*").alias("of"),
    ).filter("home.owner < last").select("phrase", "window", "home", "set", "of")
    members = windows.join(same, ["phrase", "window"]).groupBy("phrase", "set", "of", "block", "home").agg(F.min("at").alias("first"), F.max("at").alias("final"))
    members = cut(members)
    whole = worded.filter("hashes IS NULL")
    holders = members.select("phrase", "block", "set", "of", F.col("home.owner").alias("owner")).unionByName(
        whole.select("phrase", "block", F.col("block").alias("set"), F.lit(0).cast("long").alias("of"), "owner"))
    sent = again.join(holders, ["phrase", "block"]).filter("doc_id > owner").select("phrase", "set", "of", _shard("doc_id", n_shards).alias("shard")).distinct()

    of_part = members.filter("block = home.block").join(worded.select("phrase", "block", "owner", "words"), ["phrase", "block"])
    part = F.array_join(F.slice(F.split("words", " "), F.col("first") + 1, F.col("final") - F.col("first") + window), " ")
    wording = of_part.select("phrase", "set", "of", "owner", part.alias("words")).unionByName(
        whole.select("phrase", F.col("block").alias("set"), F.lit(0).cast("long").alias("of"), "owner", "words"))
    return sent.join(wording, ["phrase", "set", "of"]).select("shard", "owner", "words")


def _apply(docs: DataFrame, window: int, run, schema: str) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(8, size // SHARD_BYTES)
    found = cut(passages(docs, n, window))
    key = F.coalesce("doc_id", F.xxhash64("text"))
    rows = docs.select(_shard(key, n).alias("shard"), F.lit(True).alias("is_doc"), "doc_id", "text").unionByName(
        found.select("shard", F.lit(False).alias("is_doc"), F.col("owner").alias("doc_id"), F.col("words").alias("text")))
    return rows.repartition("shard").sortWithinPartitions("shard", "is_doc").mapInArrow(run, schema)


def strip(docs: DataFrame, *, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, gone): the words each document keeps, joined by a blank, and whether any went."""
    return _apply(docs, window, _strip, "doc_id long, n_words long, n_removed long, kept string, gone boolean")


def query(docs: DataFrame) -> DataFrame:
    return _apply(docs, 50, _digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 49)) t(i) WHERE len(w) >= 50),
own AS (SELECT h, min(doc_id) AS o FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN own USING (h), unnest(generate_series(0, 49)) t(k) WHERE o < doc_id),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS n
    FROM (SELECT doc_id, p, w[p] AS word FROM d, unnest(generate_series(1, len(w))) t(p)) x ANTI JOIN gone USING (doc_id, p) GROUP BY x.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
