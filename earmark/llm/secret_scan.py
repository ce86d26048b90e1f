"""Secret scan with multipart credential linking.

Base kinds are found by pattern. Weak candidates (long mixed tokens no pattern
names) are reported only when the other parts of a credential stand near: an
interval join within a text links weak secrets to access identifiers at most
``reach`` code points away, and endpoints to the secrets so linked.

Main path, built-in functions only: a replacement wraps matches in a control
character, splitting at it gives matches and gaps, and running lengths give code
point places, block by block, so that a text of many matches takes time in
proportion. Parts are exploded to (row, bin of ``reach`` code points), one row
for each bin from start to end; the other part is filed under both neighbouring bins
too, so parts within reach share a bin whichever stands first and however long they
are. Semi-joins with the exact distance find linked secrets, and an anti-join drops
weak candidates that overlap a base span or an identifier, without emitting pairs; a set
drops parts found in several bins. Only rows that hold an identifier and a weak
candidate are shuffled, without their texts.

Null texts count as empty; very long texts are scanned whole; rows keep to themselves
even if they repeat or share an id (joins use a row number); of parts that start at
one place the kind listed first comes first; an empty table gives no rows; other
columns are not read (``redact`` hands them on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, spare

#: Fixed patterns of the base kinds, and the characters a match needs (in group 2 for assign).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that are long enough
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Parts of credentials that mean nothing alone.
IDENT = r"""(?i:client_?id|account_?id|access_?key_?id|key_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""
ENDPOINT = r"""[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~%:@-]+(?:/[A-Za-z0-9._~%/-]*)?"""
WEAK = r"""(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"""

KINDS = ("assign", "access", "hex", "ident", "endpoint", "weak")
MARK = "\x01"
SPAN = "array<struct<s:int,k:int,e:int>>"
#: Parts of a split text that are walked together; an even number, as matches stand at odd places.
BLOCK = 128


def _spans(text: Column, kind: int, pattern: str, least: Column | None = None) -> Column:
    """Spans (s, k, e) of the pattern's matches that pass ``least`` (a function of the match)."""

    none = F.array().cast(SPAN)

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.struct(acc["at"].alias("s"), F.lit(kind).alias("k"), end.alias("e"))
        good = acc["hit"] if least is None else acc["hit"] & least(part)
        got = F.when(good, F.concat(acc["got"], F.array(span))).otherwise(acc["got"])
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), got.alias("got"))

    def inside(parts: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.lit(False).alias("hit"), none.alias("got"))
        return F.aggregate(parts, start, step, lambda acc: acc["got"])

    def blocks(parts: Column) -> Column:
        # arrays grow by copying, so long lists of parts go in blocks that know where they begin
        def placed(cuts: Column) -> Column:
            sizes = F.transform(cuts, lambda c: F.length(F.array_join(c, "")))
            begins = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
            return let(begins, lambda at: F.flatten(F.transform(cuts, lambda c, i: inside(c, F.get(at, i)))))

        steps = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int"))
        return let(F.transform(steps, lambda i: F.slice(parts, i * BLOCK + 1, BLOCK)), placed)

    def walk(parts: Column) -> Column:
        return F.when(F.size(parts) == 1, none).when(F.size(parts) <= BLOCK, inside(parts, F.lit(0))).otherwise(blocks(parts))

    return let(F.split(F.regexp_replace(text, pattern, MARK + "$0" + MARK), MARK), walk)


def find(docs: DataFrame, *, reach: int = 200, carry: tuple[str, ...] = ("doc_id",), name: str = "spans") -> DataFrame:
    """The carried columns and, under ``name``, their spans: sorted array of (s, k, e), k numbering KINDS; ends exclusive."""
    none = F.array().cast(SPAN)
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, "\x02")
    kept = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__row")
    rows = docs.select(kept, text.alias("__t")).select(
        "__row",
        "__t",
        F.concat(
            _spans(F.col("__t"), 0, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_ASSIGN),
            _spans(F.col("__t"), 1, ACCESS, lambda m: F.length(m) >= LEAST_ACCESS),
            _spans(F.col("__t"), 2, HEX),
        ).alias("__base"),
        _spans(F.col("__t"), 3, IDENT).alias("__ident"),
    )
    access = F.filter("__base", lambda x: x["k"] == 1)
    rows = rows.withColumn("__ids", F.concat("__ident", access))
    some = F.size("__ids") > 0
    rows = cut(
        rows.withColumn("__ends", F.when(some, _spans(F.col("__t"), 4, ENDPOINT)).otherwise(none))
        .withColumn("__weak", F.when(some, _spans(F.col("__t"), 5, WEAK)).otherwise(none))
        .select("__row", "__base", "__ids", "__ends", "__weak", F.monotonically_increasing_id().alias("__rid"))
    )
    alone = rows.filter(F.size("__weak") == 0).select("__row", F.array_sort("__base").alias("spans"))
    parted = rows.filter(F.size("__weak") > 0)

    def meet(left: DataFrame, right: DataFrame, most: int, how: str) -> DataFrame:
        """Rows of left that have (left_semi) or lack (left_anti) a row of right with a gap of at most ``most``, same text.

        An interval join over bins. Parts that overlap have a gap below 0.
        """
        bin_ = lambda place: F.floor(F.col(place) / reach)
        filed = F.explode(F.sequence(bin_("y.s") - 1, bin_("y.e") + 1))
        r = right.select(F.col("__rid").alias("__rid2"), "y", filed.alias("__bin2"))
        gap = F.greatest(F.col("y.s") - F.col("x.e"), F.col("x.s") - F.col("y.e"))
        b = left.withColumn("__bin", F.explode(F.sequence(bin_("x.s"), bin_("x.e"))))
        found = b.join(r, (F.col("__rid") == F.col("__rid2")) & (F.col("__bin") == F.col("__bin2")) & (gap <= most), "left_semi").drop("__bin")
        return found if how == "left_semi" else left.join(found.distinct(), ["__rid", "x"], "left_anti")

    parts = lambda c, name: parted.select("__rid", F.explode(c).alias(name))
    named = F.explode(F.concat("__base", F.filter("__ids", lambda x: x["k"] == 3)))
    weak = meet(parts("__weak", "x"), parted.select("__rid", named.alias("y")), -1, "left_anti")
    secrets = cut(meet(weak, parts("__ids", "y"), reach, "left_semi").distinct())
    linked_to = secrets.withColumnRenamed("x", "y")
    ends = meet(meet(parts("__ends", "x"), linked_to, reach, "left_semi"), parts("__base", "y"), -1, "left_anti")
    plain = F.explode(F.filter("__ids", lambda x: x["k"] == 3))
    idents = meet(parted.select("__rid", plain.alias("x")), linked_to, reach, "left_semi")
    added = secrets.union(ends).union(idents).groupBy("__rid").agg(F.collect_set("x").alias("__more"))
    linked = parted.join(added, "__rid", "left").select(
        "__row", F.array_sort(F.concat("__base", F.coalesce("__more", none))).alias("spans")
    )
    return alone.union(linked).select("__row.*", F.col("spans").alias(name))


def written(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def query(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["k"] <= 2)
    n = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return find(docs).select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, label: str = "[SECRET]") -> DataFrame:
    """docs with every span of ``text`` replaced by the label; columns and rows stay as they are."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        out = F.when(x["e"] <= acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(label)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    name = spare(docs, "__spans")
    clean = F.aggregate(
        name, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    )
    found = find(docs, carry=tuple(docs.columns), name=name)
    return found.select(
        *[F.when(F.size(name) > 0, clean).otherwise(F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    )
