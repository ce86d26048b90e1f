"""Production features of sample arrays, descriptor building from chroma frames, pooling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-10


def _db(x: np.ndarray) -> np.ndarray:
    return 20 * np.log10(np.maximum(x, FLOOR))


FEATURES = ("peak_dbfs", "rms_dbfs", "crest_factor_db", "dynamic_range_db", "clipping_ratio", "duration_s")
#: Loudness of reference, and the labels of polish from the best down.
LOUD_RMS = -14.0
LABELS = ((0.66, "co_dau_vet_mastering_thuong_mai"), (0.40, "khong_ket_luan_duoc"), (None, "giong_ban_thu_moc_hoac_nghiep_du"))
CLIPPING_HIGH = 0.001


def production(df: DataFrame, samples: str, rate: int) -> DataFrame:
    """Peak, RMS and crest in dB, p95 - p10 of 50 ms frames less than 40 dB below the loudest, clip ratio, seconds.

    All null below one second of samples."""

    def measured(x: np.ndarray) -> tuple:
        peak, rms = float(_db(np.abs(x).max())), float(_db(np.sqrt((x * x).mean())))
        n = max(int(0.05 * rate), 1)
        loud = _db(np.sqrt((x[: len(x) - len(x) % n].reshape(-1, n) ** 2).mean(1)))
        loud = loud[loud > loud.max() - 40.0]
        spread = float(np.percentile(loud, 95) - np.percentile(loud, 10))
        clipped = float((np.abs(x) >= 0.999).mean())
        return round(peak, 2), round(rms, 2), round(peak - rms, 2), round(spread, 2), round(clipped, 6), round(len(x) / rate, 2)

    def run(frames):
        for pdf in frames:
            found = [(None,) * 6 if x is None or len(x) < rate else measured(np.asarray(x, np.float64)) for x in pdf["x"]]
            yield pd.concat([pdf[["id"]].reset_index(drop=True), pd.DataFrame(found, columns=list(FEATURES), dtype="float64")], axis=1)

    return df.select("id", F.col(samples).alias("x")).mapInPandas(run, "id long, " + ", ".join(f"{c} double" for c in FEATURES))


def polish(crest: Column, rms: Column, dynamics: Column) -> tuple[Column, Column]:
    """Mean of three clipped linear maps, and its label."""
    part = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    score = (part((rms - (LOUD_RMS - 12.0)) / 12.0) + part((20.0 - crest) / 12.0) + part((18.0 - dynamics) / 14.0)) / 3
    label = F.when(score.isNotNull(), F.lit(LABELS[-1][1]))
    for least, name in reversed(LABELS[:-1]):
        label = F.when(score >= least, name).otherwise(label)
    known = crest.isNotNull() & rms.isNotNull() & dynamics.isNotNull()
    return F.when(known, F.round(score, 3)), F.when(known, label)


def resampled(chroma: np.ndarray, frames: int) -> np.ndarray:
    """Time axis to ``frames``: means of bins that hold a frame at least, or the nearest frame where there are fewer."""
    n = chroma.shape[1]
    if n < frames:
        return chroma[:, np.linspace(0, n - 1, frames).round().astype(int)]
    edges = np.linspace(0, n, frames + 1).round().astype(int)
    sums = np.concatenate([np.zeros((len(chroma), 1)), np.cumsum(chroma, 1)], 1)
    last = np.maximum(edges[1:], edges[:-1] + 1)
    return (sums[:, last] - sums[:, edges[:-1]]) / (last - edges[:-1])


def descriptor(chroma: np.ndarray, frames: int, eps: float = 1e-8) -> np.ndarray:
    """Frames centred and scaled, flattened pitch by pitch, scaled as a whole; flat frames become zero."""
    x = resampled(chroma, frames)
    x = x - x.mean(0, keepdims=True)
    norm = np.sqrt((x * x).sum(0, keepdims=True))
    x = np.where(norm > eps, x / np.maximum(norm, eps), 0.0).ravel()
    whole = np.sqrt((x * x).sum())
    return x / whole if whole > eps else x


def descriptors(df: DataFrame, pitches: int, frames: int) -> DataFrame:
    """(id, v) of (id, chroma): chroma flattened pitch by pitch, of any number of frames."""

    def run(parts):
        for pdf in parts:
            v = [descriptor(np.asarray(c, np.float64).reshape(pitches, -1), frames).tolist() for c in pdf["chroma"]]
            yield pd.DataFrame({"id": pdf["id"], "v": v})

    return df.select("id", "chroma").mapInPandas(run, "id long, v array<double>")


def pooled(frames: DataFrame, key: str) -> DataFrame:
    """Mean, and mean with sample deviation, of frame vectors by position."""
    parts = frames.select(key, F.posexplode("v").alias("i", "x"))
    stats = parts.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.coalesce(F.stddev_samp(F.col("x").cast("double")), F.lit(0.0)).alias("s"))
    rows = stats.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("r"))
    mean, dev = F.transform("r", lambda x: x["m"]), F.transform("r", lambda x: x["s"])
    return rows.select(key, mean.alias("mean"), F.concat(mean, dev).alias("mean_std"))
