"""Cleaning, labels and small projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(c: Column, most: int = 255) -> Column:
    """Without control characters, trimmed, at most ``most`` long; empty is null."""
    return F.nullif(F.left(F.trim(F.regexp_replace(c, "[\\x00-\\x1f\\x7f-\\x9f]", "")), F.lit(most)), F.lit(""))


def found(needle: Column, *columns: Column) -> Column:
    """Case-insensitive substring of any column; the characters % and _ mean themselves."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lower(needle)), F.lit(False))
    return out


def display_label(review: Column, title: Column, artist: Column, filename: Column) -> Column:
    """The reviewer's name, else the catalogue's title and artist, else the file name."""
    return F.coalesce(review, F.when(title.isNotNull(), F.concat_ws(" — ", title, artist)), filename)


def as_boolean(c: Column) -> Column:
    """Text true or false to a boolean; blank is null; other text is null."""
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low == "true", True).when(low == "false", False)


def comparable(c: Column) -> Column:
    """Text as rules compare it: trimmed, lower-cased, blank is null."""
    return F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))


def composer(title: Column, artist: Column, unknown: str = "Unknown Composer") -> Column:
    named = F.nullif(F.trim(F.regexp_extract(title, r"\(([^)]+)\)", 1)), F.lit(""))
    return F.coalesce(named, F.nullif(F.trim(artist), F.lit("")), F.lit(unknown))


def year(c: Column, default: int = 2020) -> Column:
    text = c.cast("string")
    return F.when(text.rlike(r"^\d{4}"), F.substring(text, 1, 4).try_cast("int")).otherwise(default)


def seconds(milliseconds: Column) -> Column:
    """Milliseconds as seconds, two digits; missing counts as 0."""
    return F.round(F.coalesce(milliseconds.cast("string").try_cast("double"), F.lit(0.0)) / 1000.0, 2)


def track_number(path: Column) -> Column:
    """000002.mp3 gives 2; null if the name is no number."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)0*(\d+)\.[A-Za-z0-9]+$", 1), F.lit(""))


def uuid5(name: Column, namespace: str) -> Column:
    """Name-based version 5 UUID, as a composition of SHA-1 and bit edits; a UUID stays itself, null and blank give null."""
    hexed = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    high = F.hex(F.conv(F.substring(hexed, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80)))
    made = F.lower(F.concat_ws(
        "-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.concat(F.lit("5"), F.substring(hexed, 14, 3)),
        F.concat(high, F.substring(hexed, 19, 2)), F.substring(hexed, 21, 12),
    ))
    is_uuid = F.lower(name).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return F.when(name.isNull() | (F.trim(name) == ""), None).when(is_uuid, F.lower(name)).otherwise(made)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def rounded_struct(c: Column, kind: T.DataType, hidden: frozenset[str] = frozenset({"threshold", "thresholds"})) -> Column:
    """A public projection: hidden fields leave, floats keep two digits, all the way down."""
    if isinstance(kind, T.StructType):
        return F.struct(*[rounded_struct(c[f.name], f.dataType, hidden).alias(f.name) for f in kind.fields if f.name not in hidden])
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: rounded_struct(x, kind.elementType, hidden))
    return F.round(c, 2) if isinstance(kind, (T.DoubleType, T.FloatType)) else c


def public(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, rounded_struct(F.col(column), df.schema[column].dataType))


def client_ip(forwarded: Column, peer: Column, hops: int) -> Column:
    """The hops-th address from the right of a forwarding header, else the peer's."""
    parts = F.split(F.coalesce(forwarded, F.lit("")), r"\s*,\s*")
    return F.when((hops > 0) & (F.size(parts) >= hops) & (F.coalesce(forwarded, F.lit("")) != ""), F.trim(F.element_at(parts, -max(hops, 1)))).otherwise(peer)
