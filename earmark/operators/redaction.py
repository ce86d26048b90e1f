"""Public form of JSON documents of unknown shape.

Documents are walked as VARIANT, one level a step: ``variant_explode`` opens the objects and arrays of a level, hidden
fields leave there, and what is neither object nor array is written out. Then levels close again from the
deepest up. There are as many steps as the deepest document has levels; a level holds
a row for each value, so a document is never in one task as a whole until its own parts close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import store

# Fields that state how a decision was made.
HIDDEN = ("threshold", "thresholds", "threshold_base", "threshold_raised_for_short_query", "min_identity_confidence", "min_rights_confidence")


def _kind(v: Column) -> Column:
    shape = F.schema_of_variant(v)
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape.rlike(r"^(DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))$"), "fraction").otherwise("plain")


def _written(v: Column, kind: Column, digits: int) -> Column:
    """JSON text of a value that holds no others."""
    return F.when(kind == "fraction", F.round(F.try_variant_get(v, "$", "double"), digits).cast("string")).when(kind == "plain", F.to_json(v))


def _level(rows: DataFrame, digits: int) -> DataFrame:
    """rows (doc, parent, at, pos, name, v) with the kind of each value, and its public text if it holds no others."""
    rows = rows.withColumn("kind", _kind(F.col("v")))
    return rows.withColumn("json", _written(F.col("v"), F.col("kind"), digits)).select("doc", "parent", "at", "pos", "name", "kind", "v", "json")


def public(docs: DataFrame, key: str, column: str, *, hidden: tuple[str, ...] = HIDDEN, digits: int = 2) -> DataFrame:
    """(key, column): hidden fields gone at all depths, fractions at ``digits`` digits, fields in the order of their names.

    Keys must be unique. Text that is no JSON gives null, as null does; a document that is one plain value is itself.
    """
    spark = docs.sparkSession
    start = docs.select(F.col(key).alias("doc"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("at"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("name"),
                        F.try_parse_json(column).alias("v"))
    whole = store.cut(start)
    levels = [store.cut(_level(whole.filter("v IS NOT NULL"), digits))]
    while True:
        open_ = levels[-1].filter("kind IN ('object', 'array')")
        if open_.isEmpty():
            break
        inner = spark.sql(
            "SELECT o.doc, o.at AS parent, concat(o.at, '.', x.pos) AS at, x.pos AS pos, x.key AS name, x.value AS v, o.kind AS of "
            "FROM {opened} AS o, LATERAL variant_explode(o.v) AS x", opened=open_)  # fmt: skip
        inner = inner.filter((F.col("of") == "array") | ~F.col("name").isin(*hidden)).drop("of")
        levels.append(store.cut(_level(inner, digits)))
    done = levels[-1].select("doc", "parent", "at", "pos", "name", "json")
    for level in reversed(levels[:-1]):
        parts = done.groupBy("doc", F.col("parent").alias("at")).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "json"))).alias("parts"))
        field = F.transform("parts", lambda p: F.concat(F.to_json(F.struct(p["name"].alias("n"))).substr(F.lit(6), F.length(F.to_json(F.struct(p["name"].alias("n")))) - 6), F.lit(":"), p["json"]))
        item = F.transform("parts", lambda p: p["json"])
        joined = level.join(parts, ["doc", "at"], "left")
        text = F.when(F.col("kind") == "object", F.concat(F.lit("{"), F.coalesce(F.array_join(field, ","), F.lit("")), F.lit("}"))).when(
            F.col("kind") == "array", F.concat(F.lit("["), F.coalesce(F.array_join(item, ","), F.lit("")), F.lit("]"))).otherwise(F.col("json"))
        done = joined.select("doc", "parent", "at", "pos", "name", text.alias("json"))
    return whole.select("doc").join(done.select("doc", "json"), "doc", "left").select(F.col("doc").alias(key), F.col("json").alias(column))
