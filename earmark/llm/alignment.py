"""Alignment of two tokenizers: groups of tokens that cover the same bytes, links within them, and how common each link is.

Texts are tokenised in Arrow batches, blank-separated chunks once and from a bounded
table after. Both tokenizers end a token where a chunk ends, so groups never pass a chunk: end offsets that both share cut the
tokens of a new chunk into groups, and the table keeps how these are spelled and which links they hold. A text joins
what its chunks hold, and counts each distinct link; a text whose chunks a tokenizer changes, but not the whole, is cut whole.

A link's count is the number of documents that hold it. Documents are dealt by hash into chunks of
bounded size; each keeps its distinct links with their numbers. Links are counted by chunk,
then over the corpus, and the counts of a chunk's own links come back to the chunk, where its documents look
them up. So what shuffles is one row a chunk and link, not one a document and link, and no
table of links is broadcast.

Null and empty texts, and texts that one tokenizer changes, have no tokens and zero counts.
Each row is a document of its own, so repeated rows and ids, and null ids, are counted one by one.
Links whose count equals the highest of their first id all count as best. Long texts are one row each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _settings, cut, drop, give_back

CHUNK_BYTES = 16_000_000
GROUP_CHARS = 1_000_000
KEEP_TOKENS = 1_200_000
#: One blank between two characters that are no white space: neither tokenizer joins what stands on its two sides.
SEAM = re.compile(r"(?<=\S) (?=\S)")
#: Where it is certain that each blank is a seam.
_NO_SEAM = re.compile(r"^ | $| \s|\s ")
PLAIN = re.compile(r"[^\s▁]+")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes the 256 bytes: printable ones as they are, the others in turn from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, the bytes of their tokens, and a bounded table of chunks met before."""

    GROUP = 128

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        letters = _byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.names = [self.a_bytes, self.b_bytes]
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in self.names]
        self.radix = len(self.b_bytes)
        self.numbers = [str(i).encode() for i in range(max(map(len, self.names)))]
        self.begins = [np.array([x.startswith(b" ") for x in side], bool) for side in self.names]
        self.clear()

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = _BYTE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.same = np.zeros(1 << 14, bool)
        # ids of both sides, and links; groups are as many as chunks whose spelling is kept
        self.ids = [np.empty(1 << 16, np.int64 if side == 2 else np.int32) for side in range(3)]
        self.used = [0, 0, 0]
        self.start, self.count = ([np.zeros(1 << 14, np.int64) for _ in range(3)] for _ in range(2))
        self.groups = np.zeros(1 << 14, np.int64)
        self.spelled: list[bytes] = []

    def _learn(self, chunks: list[str]) -> None:
        """Chunks without white space are encoded many at a time: each begins at a token that begins with the blank before it."""
        plain = list(filter(PLAIN.fullmatch, chunks))
        groups = [plain[i : i + self.GROUP] for i in range(0, len(plain), self.GROUP)]
        texts = [" ".join(g) for g in groups]
        for group, text, *both in zip(groups, texts, *(self._encode(texts, side) for side in (0, 1)) if texts else ()):
            want = (" " + text).encode()
            if all(b"".join(map(names.__getitem__, ids)) == want for names, ids in zip(self.names, both)):
                both = [np.array(ids, np.int32) for ids in both]
                first = [np.flatnonzero(begins[ids]) for begins, ids in zip(self.begins, both)]
                if len(group) == len(first[0]) == len(first[1]):
                    self._store(group, both, [np.diff(np.append(f, len(ids))) for f, ids in zip(first, both)], True)
        rest = [c for c in chunks if c not in self.place]
        if rest:
            lists = [self._encode(rest, side) for side in (0, 1)]
            same = [all(b"".join([names[x] for x in ids[i]]) == (" " + c).encode() for names, ids in zip(self.names, lists)) for i, c in enumerate(rest)]
            self._store(rest, [np.fromiter(chain.from_iterable(ids), np.int32) for ids in lists], [np.fromiter(map(len, ids), np.int64, len(rest)) for ids in lists], same)

    def _encode(self, texts: list[str], side: int) -> list[list[int]]:
        if side:
            return self.b.encode(texts, num_threads=1)
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def _store(self, chunks: list[str], ids: list[np.ndarray], counts: list[np.ndarray], same: bool | list[bool]) -> None:
        at, n = len(self.place), len(chunks)
        while at + n > len(self.same):
            self.same = np.r_[self.same, self.same]
        self.same[at : at + n] = same
        good = np.flatnonzero(self.same[at : at + n])
        spelled, groups, links, each = self.grouped(ids, counts, good)
        while at + n > len(self.groups):
            self.groups = np.r_[self.groups, self.groups]
        self.groups[at : at + n] = groups
        self.spelled += spelled
        ids, counts = [*ids, links], [*counts, each]
        for side in range(3):
            while at + n > len(self.start[side]):
                self.start[side], self.count[side] = np.r_[self.start[side], self.start[side]], np.r_[self.count[side], self.count[side]]
            total = len(ids[side])
            while self.used[side] + total > len(self.ids[side]):
                self.ids[side] = np.r_[self.ids[side], self.ids[side]]
            self.ids[side][self.used[side] : self.used[side] + total] = ids[side]
            self.start[side][at : at + n] = self.used[side] + np.cumsum(counts[side]) - counts[side]
            self.count[side][at : at + n] = counts[side]
            self.used[side] += total
        self.place.update(zip(chunks, range(at, at + n)))

    def grouped(self, ids: list[np.ndarray], counts: list[np.ndarray], good: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """For stretches with so many ids on both sides: how their groups are spelled, how many these are, all links, and how many of
        them each stretch has. Only ``good`` stretches, whose bytes are the same on both sides, have any."""
        n = len(counts[0])
        if len(good) < n:
            keep = np.zeros(n, bool)
            keep[good] = True
            ids = [x[np.repeat(keep, c)] for x, c in zip(ids, counts)]
        ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, ids)]
        shared = np.intersect1d(*ends)
        upto = [np.searchsorted(e, shared, side="right") for e in ends]
        first = [np.r_[0, u[:-1]] if len(u) else u for u in upto]
        size = [u - f for u, f in zip(upto, first)]
        of = good[np.searchsorted(np.cumsum(counts[0][good]), upto[0], side="left")]
        groups = np.bincount(of, minlength=n)
        total = size[0] * size[1]
        group = np.repeat(np.arange(len(shared)), total)
        k = np.arange(len(group)) - np.repeat(np.cumsum(total) - total, total)
        links = ids[0][first[0][group] + k // size[1][group]].astype(np.int64) * self.radix + ids[1][first[1][group] + k % size[1][group]]
        written = [[self.numbers[i] for i in x.tolist()] for x in ids]
        words = [x[0] + b"|" + y[0] if len(x) == len(y) == 1 else b",".join(x) + b"|" + b",".join(y)
                 for x, y in zip(*([w[i:j] for i, j in zip(f.tolist(), u.tolist())] for w, f, u in zip(written, first, upto)))]
        last = np.cumsum(groups).tolist()
        spelled = [b";".join(words[i:j]) for i, j in zip([0, *last[:-1]], last)]
        return spelled, groups, links, np.bincount(of[group], minlength=n)

    def _unchanged(self, chunks: np.ndarray, text: str) -> bool:
        """Whether both tokenizers give back the text; chunk by chunk, and as a whole if a chunk differs."""
        if self.same[chunks].all():
            return True
        want = (" " + text).encode()
        return all(b"".join([names[i] for c in chunks for i in self.ids[s][self.start[s][c] : self.start[s][c] + self.count[s][c]]]) == want
                   for s, names in enumerate(self.names))

    def _placed(self, texts: list[str]) -> list[np.ndarray]:
        """The chunks of each text as places in the table."""
        if max(self.used) > KEEP_TOKENS:
            self.clear()
        parts = [(SEAM.split(t) if _NO_SEAM.search(t) else t.split(" ")) if t else [] for t in texts]
        missing = set(chain.from_iterable(parts)).difference(self.place)
        if missing:
            self._learn(list(missing))
        return [np.fromiter(map(self.place.__getitem__, p), np.int64, len(p)) for p in parts]

    def _held(self, at: np.ndarray, side: int) -> np.ndarray:
        """Ids of one side, or links, of chunks one after the other."""
        n = self.count[side][at]
        ends = np.cumsum(n)
        return self.ids[side][np.arange(ends[-1]) + np.repeat(self.start[side][at] - ends + n, n)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, ...] | None]:
        """(ids, ends) of both sides for each text, or None where a tokenizer changes the text."""
        out: list = []
        for text, at in zip(texts, self._placed(texts)):
            if not len(at) or not self._unchanged(at, text):
                out.append(None)
                continue
            found = []
            for s in (0, 1):
                ids = self._held(at, s)
                found += [ids, np.cumsum(self.sizes[s][ids])]
            out.append(tuple(found))
        return out

    def describe(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Counts (n_a, n_b, n_groups) and digest of the groups of each text; keys (text << 32 | link) of distinct links, and their times."""
        counts, digests, keys = np.zeros((3, len(texts)), np.int64), [""] * len(texts), []
        whole: list[tuple[int, np.ndarray]] = []
        for i, (text, at) in enumerate(zip(texts, self._placed(texts))):
            if not len(at):
                continue
            if self.same[at].all():
                counts[:, i] = self.count[0][at].sum(), self.count[1][at].sum(), self.groups[at].sum()
                digests[i] = hashlib.sha256(b";".join(map(self.spelled.__getitem__, at.tolist()))).hexdigest()
                whole.append((i, at))
            elif self._unchanged(at, text):
                ids = [self._held(at, s) for s in (0, 1)]
                (spelled,), groups, links, _ = self.grouped(ids, [np.array([len(x)]) for x in ids], np.zeros(1, np.int64))
                counts[:, i] = len(ids[0]), len(ids[1]), groups[0]
                digests[i] = hashlib.sha256(spelled).hexdigest()
                keys.append(links | i << 32)
        if whole:
            at = np.concatenate([x for _, x in whole])
            text = np.repeat(np.array([i for i, _ in whole], np.int64), [len(x) for _, x in whole])
            keys.append(self._held(at, 2) | np.repeat(text, self.count[2][at]) << 32)
        return counts, digests, *np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)


FACTS = "chunk int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"


def tokenise(rows: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """rows (chunk, doc_id, text) as (*FACTS, a, b, times): counts and digest of the groups, and the distinct links (a, b) of
    a document with the times each stands there; no links and zeros where there are no tokens."""
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *(pa.list_(t) for t in (pa.int32(), pa.int32(), pa.int64()))]
    schema = pa.schema(list(zip([*(c.split()[0] for c in FACTS.split(", ")), "a", "b", "times"], types)))

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pair = Pair(bytes_path, pieces_path)

        def close(group):
            chunks, ids, texts = zip(*group)
            counts, digests, keys, times = pair.describe(list(texts))
            offsets = pa.array(np.searchsorted(keys, np.arange(len(texts) + 1) << 32).astype(np.int32))
            a, b = np.divmod(keys & 0xFFFFFFFF, pair.radix)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t.value_type)) for x, t in zip((a.astype(np.int32), b.astype(np.int32), times), types[6:])]
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(ids, pa.int64()), *(pa.array(c) for c in counts), pa.array(digests), *lists], schema=schema)

        for batch in batches:
            group, size = [], 0
            for chunk, doc_id, text in zip(*batch.columns):
                group.append((chunk.as_py(), doc_id.as_py(), text.as_py() or ""))
                size += len(group[-1][2])
                if size >= GROUP_CHARS:
                    yield close(group)
                    group, size = [], 0
            if group:
                yield close(group)
        pair = None
        give_back()

    return rows.mapInArrow(run, FACTS + ", a array<int>, b array<int>, times array<long>")


def aligned(tokens: DataFrame, radix: int) -> DataFrame:
    """The links of ``tokenise`` as one number each (a * radix + b)."""
    pairs = F.zip_with("a", "b", lambda x, y: x.cast("long") * radix + y)
    return tokens.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", pairs.alias("pairs"), "times")


def align(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """One row a document: tokens, groups, links, best links and the sum of the links' counts."""
    import sentencepiece

    spark, radix = docs.sparkSession, sentencepiece.SentencePieceProcessor(model_file=pieces_path).get_piece_size()
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, size // CHUNK_BYTES))).cast("int")
    rows = aligned(tokenise(docs.select(chunk.alias("chunk"), "doc_id", "text"), bytes_path, pieces_path), radix)
    rows = cut(rows.repartition("chunk"))
    by_chunk = cut(rows.select("chunk", F.explode("pairs").alias("pair")).groupBy("chunk", "pair").agg(F.count("*").alias("docs")))
    counts = by_chunk.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.call_function("div", "pair", F.lit(radix).cast("long")))
    counts = cut(counts)
    best = counts.groupBy("a").agg(F.max("docs").alias("most"))
    counts = counts.join(best, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    known = cut(by_chunk.drop("docs").join(counts, "pair").select("chunk", "pair", "docs", "best"))

    facts = ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    dealt = rows.filter("n_a > 0").repartition("chunk").withColumn("row", F.monotonically_increasing_id())
    links = dealt.select("chunk", "row", *facts, F.inline(F.arrays_zip(F.col("pairs").alias("pair"), "times")))
    # chunks are whole in a partition, so neither the join nor the sums shuffle links
    with _settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        sums = links.join(known.hint("shuffle_hash"), ["chunk", "pair"]).groupBy("chunk", "row", *facts).agg(
            F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
        zero = F.lit(0).cast("long")
        out = sums.select(*facts, "n_links", "n_best", "count_sum").unionByName(
            rows.filter("n_a = 0").select(*facts, zero.alias("n_links"), zero.alias("n_best"), zero.alias("count_sum")))
        out = cut(out)
    drop(rows, by_chunk, known)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
