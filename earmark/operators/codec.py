"""Chromaprint strings: base64url, a four-byte header, three-bit deltas with five-bit exceptions."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bits(data: np.ndarray, width: int) -> np.ndarray:
    """Little-endian groups of ``width`` bits; an incomplete last group is dropped."""
    bits = np.unpackbits(data, bitorder="little")
    whole = bits[: len(bits) // width * width].reshape(-1, width)
    return whole @ (1 << np.arange(width))


def decode(text: str) -> list[int] | None:
    """Items of a fingerprint, or null if the string is none."""
    try:
        raw = np.frombuffer(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)), np.uint8)
    except (ValueError, TypeError):
        return None
    if len(raw) < 4:
        return None
    n = int.from_bytes(raw[1:4].tobytes(), "big")
    small = _bits(raw[4:], 3)
    stops = np.flatnonzero(small == 0)
    if len(stops) < n:
        return None
    if n == 0:
        return []
    small = small[: stops[n - 1] + 1]
    wide = np.flatnonzero(small == 7)
    used = 4 + (len(small) * 3 + 7) // 8
    extra = _bits(raw[used:], 5)
    if len(extra) < len(wide):
        return None
    steps = small.astype(np.int64)
    steps[wide] += extra[: len(wide)]
    item = np.repeat(np.arange(n), np.diff(np.r_[-1, stops[:n]]))
    real = small > 0
    reach = np.cumsum(steps)
    start = np.r_[0, reach[stops[: n - 1]]] if n > 1 else np.array([0])
    place = reach - start[item]
    if (place[real] > 32).any():
        return None
    delta = np.zeros(n, np.int64)
    np.bitwise_xor.at(delta, item[real], 1 << (place[real] - 1))
    return np.bitwise_xor.accumulate(delta).tolist()


def encode(items: list[int], algorithm: int = 1) -> str:
    """The string of a list of 32-bit items; the inverse of ``decode``."""
    small, extra, last = [], [], 0
    for x in items:
        delta, prior = x ^ last, 0
        for b in range(1, 33):
            if delta >> (b - 1) & 1:
                step, prior = b - prior, b
                small.append(min(step, 7))
                if step >= 7:
                    extra.append(step - 7)
        small.append(0)
        last = x

    def packed(values: list[int], width: int) -> bytes:
        bits = np.array([v >> i & 1 for v in values for i in range(width)], np.uint8)
        return np.packbits(bits, bitorder="little").tobytes()

    raw = bytes([algorithm]) + len(items).to_bytes(3, "big") + packed(small, 3) + packed(extra, 5)
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decoded(c: Column) -> Column:
    """ARRAY<BIGINT> of a fingerprint column; null where it cannot be read."""

    @F.pandas_udf("array<bigint>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else decode(x))

    return run(c)


def encoded(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: encode([int(i) for i in x]))

    return run(c)


def vector_of_bytes(c: Column, width: int) -> Column:
    """Little-endian float32 bytes to a vector; another width gives null."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: np.frombuffer(b, "<f4").tolist() if b is not None and len(b) == 4 * width else None)

    return run(c)


def bytes_of_vector(c: Column) -> Column:
    """A vector as little-endian float32 bytes; null stays null."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(c)


def readable(fingerprints: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their decoded ``items``, those that cannot be read left out, and how many were read and how many skipped."""
    rows = fingerprints.withColumn("items", decoded(F.col(text)))
    return rows.filter("items is not null"), rows.agg(F.count("items").alias("read"), F.count_if(F.col("items").isNull()).alias("skipped"))
