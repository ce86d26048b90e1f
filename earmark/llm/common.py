"""What the training-data operators share: words, reading, lineage cuts, let-bindings."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
WORD_SEP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Shuffle files behind a table go as soon as the table is written.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: From this size of the other side on, a join with a filtered table first tests its rows against a Bloom filter of that table.
BLOOM_FROM = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
WHOLE_STAGE = "spark.sql.codegen.wholeStage"

_own_roots: dict[str, str] = {}
_folders: dict[str, str] = {}
_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def spare(docs: DataFrame, name: str) -> str:
    """The name, longer by as many underscores as it takes to be no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SEP), lambda w: w != "")


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="earmark-")
    return _own_roots[app]


def _remover(spark: SparkSession):
    """A function that deletes a path, also after the session has ended."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove(path: str) -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # scratch space whose session or store has gone
            pass

    return remove


def _folder(spark: SparkSession) -> str:
    """One folder for the tables of this session, deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_root(spark)}/earmark-{app}-{uuid.uuid4().hex}"
        atexit.register(_remover(spark), _own_roots.get(app, _folders[app]))
    return _folders[app]


def give_back() -> None:
    """Return freed memory of this Python worker to the system; idle workers keep what they hold while other stages run."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, parts: int | None = None, *, bloom: bool = False, narrow: bool = False) -> DataFrame:
    """Write df to the shared folder, in at most ``parts`` files, and read it back: lineage ends in files all executors see.

    bloom: joins with a filtered table may drop rows by a Bloom filter of it, whose size
    Spark bounds, before they shuffle. narrow: a few numbers a row, joined by their keys, where compiling whole stages
    costs executors more time and memory than it saves.

    The table lives until ``drop`` is called on it, the ``scratch`` block it was made
    in ends, or the driver ends, whichever comes first.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    with _settings(spark, {FILE_CLEANUP: "true", **({BLOOM_FROM: "0"} if bloom else {}), **({WHOLE_STAGE: "false"} if narrow else {})}):
        (df if parts is None else df.coalesce(parts)).write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        _remover(df.sparkSession)(df._cut_at)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are cut inside the block are deleted at its end, but for those handed to the function it gives."""
    paths: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        paths.remove(df._cut_at)
        return df

    _scopes.append(paths)
    try:
        yield kept
    finally:
        _scopes.pop()
        remove = _remover(spark)
        for path in paths:
            remove(path)
