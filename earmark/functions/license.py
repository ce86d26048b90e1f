"""License names and addresses to rights flags, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code, license type, copyright status, attribution, commercial, modification, monetisation, public-domain recording.
LICENSES = (
    ("by", "CC_BY", "PROTECTED", True, True, True, True, False),
    ("by-sa", "CC_BY_SA", "PROTECTED", True, True, True, True, False),
    ("by-nc", "CC_BY_NC", "PROTECTED", True, False, True, False, False),
    ("by-nd", "CC_BY_ND", "PROTECTED", True, True, False, True, False),
    ("by-nc-sa", "CC_BY_NC_SA", "PROTECTED", True, False, True, False, False),
    ("by-nc-nd", "CC_BY_NC_ND", "PROTECTED", True, False, False, False, False),
    ("cc0", "CC0", "PUBLIC_DOMAIN", False, True, True, True, True),
    ("pdm", "PUBLIC_DOMAIN", "PUBLIC_DOMAIN", False, True, True, True, True),
)
FLAGS = ("license_type", "copyright_status", "attribution_required", "commercial_use_allowed", "modification_allowed", "monetization_allowed", "recording_public_domain")


def canonical(has: dict[str, Column], by: Column) -> Column:
    """by-nc-sa-nd in this order; null without ``by`` or with both sa and nd."""
    code = F.concat_ws("-", F.lit("by"), *[F.when(has[f], f) for f in ("nc", "sa", "nd")])
    return F.when(by & ~(has["sa"] & has["nd"]), code)


def code_from_url(url: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    parts = F.split(F.regexp_extract(u, r"creativecommons\.org/licenses/([a-z][a-z-]*)", 1), "-")
    has = {f: F.array_contains(parts, f) for f in ("nc", "sa", "nd")}
    return (
        F.when(u.contains("creativecommons.org/publicdomain/zero"), "cc0")
        .when(u.contains("creativecommons.org/publicdomain/mark"), "pdm")
        .otherwise(canonical(has, F.array_contains(parts, "by")))
    )


def code_from_text(text: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")
    any_of = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    has = {"nc": any_of("noncommercial", "non commercial"), "sa": any_of("sharealike", "share alike"), "nd": any_of("noderiv", "no deriv")}
    return (
        F.when(any_of("cc0", "zero") | (any_of("public domain") & any_of("dedication")), "cc0")
        .when(any_of("public domain"), "pdm")
        .otherwise(canonical(has, any_of("attribution")))
    )


def flag(code: Column, name: str) -> Column:
    """One of the flags of a license code; null for an unknown code."""
    i = FLAGS.index(name) + 1
    out = F.lit(None)
    for row in LICENSES:
        out = F.when(code == row[0], F.lit(row[i])).otherwise(out)
    return out


def normalised(text: Column, url: Column) -> list[Column]:
    """license_code, where it was read, and all flags; the address goes before the text."""
    from_url, from_text = code_from_url(url), code_from_text(text)
    code = F.coalesce(from_url, from_text)
    where = F.when(from_url.isNotNull(), "url").when(from_text.isNotNull(), "text")
    return [code.alias("license_code"), where.alias("matched_on"), *[flag(code, f).alias(f) for f in FLAGS]]


def code_of_type(license_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for row in LICENSES:
        out = F.when(license_type == row[1], row[0]).otherwise(out)
    return out


def label_to_url(label: Column) -> Column:
    """A dataset's license label to its address."""
    l = F.lower(F.trim(label))  # noqa: E741
    code = F.regexp_replace(F.regexp_extract(l, r"^cc[ -]?(by(?:[ -](?:nc|nd|sa))*)", 1), " ", "-")
    return F.when(l.startswith("cc0"), "https://creativecommons.org/publicdomain/zero/1.0/").when(
        code != "", F.concat(F.lit("https://creativecommons.org/licenses/"), code, F.lit("/4.0/"))
    )
