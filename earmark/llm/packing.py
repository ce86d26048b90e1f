"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to the shortest context tier that holds them; what is longer
than the longest tier is first cut into full windows. Tiers are packed from the
longest down: a window opens with the longest waiting segment, its gap takes the
best-fitting segments of shorter tiers, and one cut fills what is left, so every
window of a tier is exactly full. What stays open at the end of a partition is
closed into windows of halving powers of two, so nothing is padded. Full windows of one
tier that a partition flushes together are dealt into step groups of about
``step_tokens`` each, whose attention cost (sum of squared segment lengths) is balanced
by a snake order; groups of different flushes are not weighed against each other.

Each partition packs its own documents: no shuffle, no collected state, and a
buffer bounded by ``flush_tokens``; the table of chunks met before is bounded in bytes. A task that is run again makes the same
windows. Null texts count as empty; an empty document is its closing id alone; very
long texts are encoded in runs and cut into full windows; repeated rows are packed once
each; of segments of one length the one read first goes first; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import chain, repeat
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import give_back

SCHEMA = (
    "doc_id long, start long, length long, ids_le binary, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)
TIERS = (256, 512, 1024, 2048, 4096)
#: Texts are encoded together up to so many characters; a longer one goes in runs of so many.
READ_CHARS = 400_000
#: What an entry of a table takes besides its letters and ids.
ENTRY_BYTES = 220


#: A full stop and a comma: the forms in which a word is kept besides itself.
_MARKS = {46: 1, 44: 2}
_BLANK = re.compile(r"[ \t\n\x0b\x0c\r]")


def _latin(word: str) -> bool:
    """Letters of which every version of the character tables says the same."""
    return word.isalpha() and max(word) < "\u0250" and word.lower().isalpha()


class ChunkTokenizer:
    """Encodes blank-separated chunks once and keeps their ids.

    The vocabulary's pre-tokeniser never joins characters across ASCII blanks, nor
    letters and marks, so the ids of a text are the ids of its chunks in turn, and a
    word with a full stop or comma is the word's ids and the mark's. A word of letters
    ends at its first token that ends a word, so many are encoded in one call.
    """

    GROUP = 64

    def __init__(self, path: str, keep_bytes: int = 128_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        # one thread a task: a pool of its own in each worker costs memory and no task gains by it
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.keep_bytes = Tokenizer.from_file(path), keep_bytes
        # for words of letters, lower-cased and composed already
        self.lean = Tokenizer(self.tokenizer.model)
        self.lean.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marks = [self._encode([m])[0] for m in (".", ",")]
        self.clear()

    def forget_chunks(self) -> None:
        """Chunks go, the words they are made of stay, so that common chunks are back soon."""
        self.place: dict[bytes, int] = {}
        self.letters = 0

    def clear(self) -> None:
        self.forget_chunks()
        self.words: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.word_start = np.zeros(1 << 16, np.int64)
        self.word_size = np.zeros(1 << 16, np.int64)
        self.used = 0

    def held_bytes(self) -> tuple[int, int]:
        """Of chunks, and of words with all ids."""
        return len(self.place) * ENTRY_BYTES + self.letters, len(self.words) * ENTRY_BYTES + 4 * self.used

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _learn_words(self, words: list[bytes]) -> None:
        """Each word is kept as word + stop + word + comma, so that all three forms are slices."""
        groups = [b" ".join(words[i : i + self.GROUP]).decode() for i in range(0, len(words), self.GROUP)]
        groups = [g if g.isascii() else normalize("NFC", g).lower() for g in groups]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.lean.encode_batch_fast(groups, add_special_tokens=False)])
        last = np.flatnonzero(self.ends[flat])
        assert len(last) == len(words), "a word of letters is one pre-token"
        sizes = np.diff(np.r_[-1, last])
        at, n = len(self.words), len(words)
        while at + n > len(self.word_start):
            self.word_start = np.concatenate([self.word_start, np.zeros_like(self.word_start)])
            self.word_size = np.concatenate([self.word_size, np.zeros_like(self.word_size)])
        room = 2 * sizes + 2
        base = np.cumsum(room) - room
        out = np.empty(room.sum(), np.uint32)
        inner = np.arange(len(flat)) + np.repeat(base - (np.cumsum(sizes) - sizes), sizes)
        out[inner] = flat
        out[inner + np.repeat(sizes + 1, sizes)] = flat
        out[base + sizes], out[base + room - 1] = self.marks[0][0], self.marks[1][0]
        self.word_start[at : at + n] = base + self._store(out)
        self.word_size[at : at + n] = sizes
        self.words.update(zip(words, range(at, at + n)))

    def _learn(self, chunks: list[bytes]) -> None:
        n, at = len(chunks), len(self.place)
        while at + n > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        cores, kinds, others, words = [], [], [], self.words
        for i, c in enumerate(chunks):
            kind = _MARKS.get(c[-1], 0)
            core = (c[:-1] if kind else c).lower()
            if core in words or core.isalpha() or (not core.isascii() and _latin(core.decode())):
                cores.append(core)
                kinds.append(kind)
            else:
                others.append(i)
                kinds.append(-1)
        form = np.array(kinds, np.int64)
        new = list(dict.fromkeys(w for w in cores if w not in self.words))
        if new:
            self._learn_words(new)
        plain = np.flatnonzero(form >= 0)
        which = np.fromiter(map(self.words.__getitem__, cores), np.int64, len(cores))
        start, size, kind = self.word_start[which], self.word_size[which], form[plain]
        self.start[at + plain] = np.where(kind == 2, start + size + 1, start)
        self.size[at + plain] = size + (kind > 0)
        for i, ids in zip(others, self._encode([chunks[i].decode() for i in others])):
            self.start[at + i], self.size[at + i] = self._store(ids), len(ids)
        self.place.update(zip(chunks, range(at, at + n)))
        self.letters += sum(map(len, chunks))

    def encode_long(self, text: str) -> np.ndarray:
        """Ids of a text of any length, in runs that end at a blank."""
        out, start = [], 0
        while start < len(text):
            blank = _BLANK.search(text, start + READ_CHARS)
            end = blank.start() if blank else len(text)
            out += self.encode([text[start:end]])
            start = end
        return np.concatenate(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; unknown chunks of all the texts are encoded together."""
        chunks, words = self.held_bytes()
        if words > self.keep_bytes // 2:
            self.clear()
        elif chunks > self.keep_bytes // 2:
            self.forget_chunks()
        parts = [t.encode().split() for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = list(chain.from_iterable(parts))
        if not flat:
            return [np.empty(0, np.uint32)] * len(texts)
        at = np.fromiter(map(self.place.get, flat, repeat(-1)), np.int64, len(flat))
        gaps = np.flatnonzero(at < 0)
        if len(gaps):
            missing = [flat[i] for i in gaps]
            self._learn(list(dict.fromkeys(missing)))
            at[gaps] = np.fromiter(map(self.place.__getitem__, missing), np.int64, len(gaps))
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.start[at] - ends + sizes, sizes)]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


class Packer:
    """Packs segments (length, key, start) into windows that are exactly full."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tuple(sorted(tiers))
        self.pool: list[tuple[int, int, int]] = []

    def add(self, key: int, n: int) -> Iterator[tuple[int, list]]:
        top = self.tiers[-1]
        full = n // top * top
        for s in range(0, full, top):
            yield top, [(top, key, s)]
        if n > full:
            self.pool.append((n - full, key, full))

    def drain(self, last: bool) -> Iterator[tuple[int, list]]:
        pool = self.pool
        pool.sort()
        while pool:
            seg = pool.pop()
            tier = self.tiers[bisect_right(self.tiers, seg[0] - 1)]
            window, gap = [seg], tier - seg[0]
            while gap and pool:
                i = bisect_right(pool, (gap, float("inf"), 0)) - 1
                if i >= 0:
                    seg = pool.pop(i)
                else:
                    n, key, start = pool.pop(0)
                    seg = (gap, key, start)
                    insort(pool, (n - gap, key, start + gap))
                window.append(seg)
                gap -= seg[0]
            if not gap:
                yield tier, window
            elif last:
                yield from self._close(window)
            else:
                pool.extend(window)
                return

    @staticmethod
    def _close(window: list) -> Iterator[tuple[int, list]]:
        left, window = sum(s[0] for s in window), window[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            left, part, room = left - size, [], size
            while room:
                n, key, start = window.pop()
                if n > room:
                    window.append((n - room, key, start + room))
                    n = room
                part.append((n, key, start))
                room -= n
            yield size, part


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    closing_id: int = 2,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = 65536,
    flush_tokens: int = 4_000_000,
    keep_bytes: int = 128_000_000,
) -> DataFrame:
    """One row per piece of a document (doc_id, text) in a window, with its ids as little-endian uint32."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_le", pa.binary()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()),
    ])

    def run(batches):
        base = TaskContext.get().partitionId() << 36
        tok, packer = ChunkTokenizer(tokenizer_path, keep_bytes), Packer(tiers)
        held: dict[int, tuple] = {}
        windows: list[tuple[int, list]] = []
        count, groups, tokens, key = 0, 0, 0, 0

        def flush(last: bool):
            nonlocal count, groups
            windows.extend(packer.drain(last))
            by_tier: dict[int, list] = {}
            for tier, w in windows:
                by_tier.setdefault(tier, []).append(w)
            windows.clear()
            rows: list[tuple] = []
            room = 0
            for tier, ws in sorted(by_tier.items(), reverse=True):
                n_groups = -(-len(ws) * tier // step_tokens)
                ws.sort(key=lambda w: -sum(s[0] * s[0] for s in w))
                for i, w in enumerate(ws):
                    lap, spot = divmod(i, n_groups)
                    group = base + groups + (spot if lap % 2 == 0 else n_groups - 1 - spot)
                    at = 0
                    for n, k, start in w:
                        doc_id, ids = held[k]
                        rows.append((doc_id, start, n, ids[start : start + n].tobytes(), len(ids), base + count, at, tier, group))
                        at += n
                    count += 1
                    room += tier
                    if room >= 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, room = [], 0
                groups += n_groups
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            waiting = {k for _, k, _ in packer.pool}
            for k in [k for k in held if k not in waiting]:
                del held[k]

        def encoded(batches):
            """(doc_id, ids) of each row; few characters are held as words at a time."""
            for batch in batches:
                ids, texts, size = [], [], 0
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    text = text.as_py() or ""
                    if len(text) > READ_CHARS:
                        yield doc_id.as_py(), tok.encode_long(text)
                        continue
                    ids.append(doc_id.as_py())
                    texts.append(text)
                    size += len(text)
                    if size >= READ_CHARS:
                        yield from zip(ids, tok.encode(texts))
                        ids, texts, size = [], [], 0
                if texts:
                    yield from zip(ids, tok.encode(texts))

        ids = None
        for doc_id, ids in encoded(batches):
            ids = np.append(ids, np.uint32(closing_id)).astype("<u4", copy=False)
            held[key] = (doc_id, ids)
            windows.extend(packer.add(key, len(ids)))
            key, tokens = key + 1, tokens + len(ids)
            if tokens >= flush_tokens:
                yield from flush(False)
                tokens = 0
        yield from flush(True)
        held.clear()
        tok.clear()
        tok = packer = ids = None  # with the vocabulary, its cache and the last texts
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
