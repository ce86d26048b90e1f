"""Corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

``STAGES`` lists (name, function); each takes (spark, docs, sf_dir) and returns the
rows the next stage reads. All but the last keep the columns of ``documents``. Each
decision takes effect: rejected documents go, one document of a near-duplicate class
stays, secrets are replaced in the text, documents are repeated, cut or left out as
the mix says, and what is left is packed.

``run`` deletes the work tables of a stage once its result has been written, and each
result once the next stage has been; tables of other results of the session stay.

Nulls: a null text has no words and goes in the first stage; a null doc_id is kept
through all stages as it is, copies of a text without any id count as one document.
Repeated rows of one document become one row in the second stage; very long texts are
read whole in every stage; ties go as each operator says. Empty tables stay empty.
Columns beyond those of ``documents``, of any name, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.llm import mixing, near_dedup, packing, quality_rules, secret_scan
from earmark.llm.common import cut, drop, scratch, spare, words_of
from earmark.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality reaches the bound and that don't repeat themselves; short ones are judged alike."""
    return quality_rules.keep(docs, least_words=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate class."""
    return near_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a label; n_chars follows the text."""
    return _recounted(secret_scan.redact(docs))


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix takes them; a part taken is the text's first words."""
    columns, names, cut_to = tuple(docs.columns), (spare(docs, "__size"), spare(docs, "__taken")), spare(docs, "__part")
    rows, _ = mixing.mix(docs, F.size(words_of(F.col("text"))), F.col("source"), carry=columns, names=names)
    size, taken = map(F.col, names)
    whole = F.floor(taken / F.greatest(size, F.lit(1)))
    part = taken - whole * size
    wanted = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    cutting = F.array_join(F.slice(words_of(F.col("text")), F.lit(1), F.col(cut_to).cast("int")), " ")
    text = F.when(F.col(cut_to) < 0, F.col("text")).otherwise(cutting)
    out = rows.select(*[F.col(f"`{c}`") for c in columns], F.explode(wanted).alias(cut_to))
    return _recounted(out.withColumn("text", text).select(*[F.col(f"`{c}`") for c in columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full windows of token ids."""
    return packing.pack(docs, TOKENIZER, keep_bytes=96_000_000).select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids_le"
    )


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: Posterior quality and near-duplicate classes are beyond SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = kept(cut(stage(spark, docs, sf_dir)))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
