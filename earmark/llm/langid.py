"""Language identification: averaged hashed subword embeddings and a linear softmax.

Training is stochastic gradient descent in numpy on a bounded sample of labelled
texts (``sample_rows`` over all languages, runs of at most ``sample_chars``, the
commonest ``most_langs`` languages), cut into at most ``most_pieces`` examples of a size,
spread over the text so that short texts are learned too. Part of the sample is held
back: it sets the softmax temperature, and the rejection bound below which
predictions are not to be trusted (the lowest score at which accepted predictions
are right with ``precision``).

Prediction reads whole texts. The model is linear, so a chunk of letters has one
score vector however often it occurs; each task keeps them in a bounded table and a
document is a sum of rows. Only ``text`` is an input of a prediction.

Null texts and texts without a letter give ``und`` with score 0, as do all texts when
there is nothing to learn from. Very long texts are read whole in prediction. Repeated
rows are predicted alike; of languages with one score the first by name is given; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)


def _letters() -> np.ndarray:
    """Lower-cased code point of each letter of the basic plane, else 0."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the texts, and the text each belongs to.

    Subwords are runs of 1 to 4 letters, and runs that begin or end with the edge of
    a word; they never cross a gap.
    """
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    x = np.where(code < 1 << 16, letters[np.minimum(code, (1 << 16) - 1)], 0)
    for c in np.unique(code[code >= 1 << 16]):
        if chr(c).isalpha():
            x[code == c] = c
    x, owner = np.r_[np.uint32(0), x], np.r_[owner[:1], owner]
    is_letter = x > 0
    found, owners = [], []
    for n in GRAMS:
        m = len(x) - n + 1
        if m <= 0:
            break
        ok = np.ones(m, bool)
        for j in range(1 if n > 1 else 0, n - 1 if n > 1 else n):
            ok &= is_letter[j : j + m]
        if n == 2:
            ok &= is_letter[:m] | is_letter[1:]
        at = np.flatnonzero(ok)
        h = np.full(len(at), 0x811C9DC5 + n, np.uint32)
        for j in range(n):
            h = (h ^ x[at + j]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        found.append((h * np.uint32(0x9E3779B1) >> np.uint32(17)).astype(np.int64))
        owners.append(owner[at + n // 2])
    return np.concatenate(found), np.concatenate(owners)


def train(
    texts: list[str], langs: list[str], *, width: int = 16, rounds: int = 3, batch: int = 128,
    rate: float = 0.5, precision: float = 0.99, seed: int = 7, most_pieces: int = 10,
) -> tuple[list[str], np.ndarray, float, float]:
    """(languages, score of each bucket by language, temperature, rejection bound)."""
    names = sorted(set(langs))
    place = {v: i for i, v in enumerate(names)}
    letters = _letters()
    held = np.array([zlib.crc32(t.encode()) % 5 == 0 for t in texts], bool)
    pieces, labels, test = [], [], []
    for t, v, h in zip(texts, langs, held):
        words = t.split()
        for n in (2, 8, 40):  # runs of n words, at most most_pieces of them, spread over the whole text
            starts = range(0, len(words), n)
            for i in starts[:: -(-len(starts) // most_pieces)] if words else ():
                pieces.append(" ".join(words[i : i + n]))
                labels.append(place[v])
                test.append(h)
    rng = np.random.default_rng(seed)
    bucket, owner = grams(pieces, letters)
    order = np.argsort(owner, kind="stable")
    bucket, owner = bucket[order], owner[order]
    ends = np.searchsorted(owner, np.arange(len(pieces) + 1))
    labels, test = np.array(labels, np.int64), np.array(test, bool)
    some = np.diff(ends) > 0
    learn, check = np.flatnonzero(~test & some), np.flatnonzero(test & some)
    if not len(learn):
        learn = check
    emb = rng.normal(0, 0.1, (BUCKETS, width)).astype(np.float32)
    out = np.zeros((width, len(names)), np.float32)
    # each language weighs the same
    weight = 1 / np.maximum(np.bincount(labels[learn], minlength=len(names)), 1)
    weight = weight / weight[labels[learn]].mean() if len(learn) else weight

    def bags(rows: np.ndarray):
        sizes = ends[rows + 1] - ends[rows]
        flat = np.concatenate([bucket[ends[r] : ends[r + 1]] for r in rows])
        return flat, np.repeat(np.arange(len(rows)), sizes), sizes

    for r in range(rounds):
        step = rate * (1 - r / rounds)
        rng.shuffle(learn)
        for s in range(0, len(learn), batch):
            rows = learn[s : s + batch]
            flat, who, sizes = bags(rows)
            uniq, inv = np.unique(flat, return_inverse=True)
            mass = np.bincount(who * len(uniq) + inv, minlength=len(rows) * len(uniq)).reshape(len(rows), -1)
            mass = (mass / sizes[:, None]).astype(np.float32)
            hidden = mass @ emb[uniq]
            logits = hidden @ out
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= weight[labels[rows]][:, None] / len(rows)
            emb[uniq] -= step * 20 * (mass.T @ (p @ out.T))
            out -= step * (hidden.T @ p)
    table = emb @ out
    heat, bound = 1.0, 0.0
    if len(check):
        flat, who, sizes = bags(check)
        logits = np.stack([np.bincount(who, table[flat, k], minlength=len(check)) for k in range(len(names))], 1)
        logits /= sizes[:, None]
        best = np.inf
        for t in np.geomspace(0.05, 4, 40):
            z = logits / t
            z -= z.max(1, keepdims=True)
            loss = (np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), labels[check]]).mean()
            if loss < best:
                best, heat = loss, float(t)
        z = np.exp(logits / heat - (logits / heat).max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        top, right = z.max(1), z.argmax(1) == labels[check]
        order = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1))
        bound = float(top[order][good[-1]]) if len(good) else 1.0
    return names, table.astype(np.float32), heat, bound


def sample(docs: DataFrame, rows: int, chars: int, most_langs: int = 1000) -> tuple[list[str], list[str]]:
    """Texts and languages of about rows labelled documents, the same number of each language, at most twice as many.

    Of a text of more than ``chars`` characters a run of that length is taken, at a place drawn by hash. Beyond
    ``most_langs`` languages the commonest are learned, ties by name.
    """
    known = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not counts:
        return [], []
    each = max(1, rows // len(counts))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, each / n))])
    place = F.crc32(F.concat(F.lit("lang:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) / float(1 << 32)
    spare = F.length("text") - chars
    piece = F.when(spare > 0, F.substring("text", F.pmod(F.crc32(F.col("text")), F.greatest(spare, F.lit(1))).cast("int") + 1, F.lit(chars))).otherwise(F.col("text"))
    some = known.select("doc_id", "lang", place.alias("place"), piece.alias("text")).filter(F.col("place") < share[F.col("lang")])
    some = some.orderBy("place", "doc_id", "lang", "text").limit(2 * rows).collect()
    some.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))
    return [r["text"] for r in some], [r["lang"] for r in some]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, float, float]) -> DataFrame:
    """doc_id, lang_pred, score and accepted for each row of (doc_id, text)."""
    names, table, heat, bound = model
    shared = docs.sparkSession.sparkContext.broadcast((names, table, heat, bound))  # buckets x languages
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    def run(batches):
        names, table, heat, bound = shared.value
        letters = _letters()
        known: dict[str, int] = {}
        sums = np.zeros((1 << 12, len(names) + 1))

        def learn(chunks: list[str]) -> None:
            nonlocal sums
            at, n = len(known), len(chunks)
            while at + n > len(sums):
                sums = np.concatenate([sums, np.zeros_like(sums)])
            bucket, owner = grams(chunks, letters)
            for k in range(len(names)):
                sums[at : at + n, k] = np.bincount(owner, table[bucket, k], minlength=n)
            sums[at : at + n, -1] = np.bincount(owner, minlength=n)
            known.update(zip(chunks, range(at, at + n)))

        for batch in batches:
            texts = batch.column(1)
            got: list[tuple[str, float, bool]] = []
            for i in range(batch.num_rows):
                parts = (texts[i].as_py() or "").split()
                try:
                    at = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
                except KeyError:
                    if len(known) > 1_000_000:
                        known.clear()
                    learn([p for p in dict.fromkeys(parts) if p not in known])
                    at = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
                total = sums[at].sum(0)
                if not names or not total[-1]:
                    got.append(("und", 0.0, False))
                    continue
                z = total[:-1] / total[-1] / heat
                p = np.exp(z - z.max())
                p /= p.sum()
                k = int(p.argmax())
                got.append((names[k], float(p[k]), bool(p[k] >= bound)))
            lang, score, accepted = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                schema=schema,
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def query(docs: DataFrame, *, sample_rows: int = 2000, sample_chars: int = 20_000) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1
    model = train(*sample(docs.filter(~held), sample_rows, sample_chars))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
