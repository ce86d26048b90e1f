"""The ordered rule engine, compiled to columns.

Facts are columns of one wide row. Gates come first, then five groups in order; the
first group that matches decides, by its first matching rule or its default. Values
compare without regard to type or case, and null equals null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.text import comparable

#: Fixed values of the identity gate.
LICENSE_PREDICTED_FLOOR, OTHER_FLOOR = 0.0, 0.97
REVIEW = ("UNKNOWN", "HUMAN_REVIEW_REQUIRED")

CC_TYPES = ("CREATIVE_COMMONS", "CC_BY", "CC_BY_SA", "CC_BY_NC", "CC_BY_ND", "CC_BY_NC_SA", "CC_BY_NC_ND", "CC0")

#: Fixed rules: group, match fields (any of them), rules as (conditions, risk, condition), default.
GROUPS = (
    ("AUDIO_LIBRARY", {"license_type": ("AUDIO_LIBRARY",)}, (
        ({"attribution_required": (False,)}, "LOW", "FREE_TO_USE"),
        ({"attribution_required": (True,)}, "CONDITIONAL", "ATTRIBUTION_REQUIRED"),
    )),
    ("CREATOR_MUSIC", {"license_type": ("CREATOR_MUSIC",)}, (
        ({"license_purchased": (True,), "license_valid": (True,)}, "LOW", "FULL_REVENUE_RETAINED"),
        ({"license_purchased": (True,), "license_valid": (False,)}, *REVIEW),
        ({"revenue_share_agreed": (True,)}, "CONDITIONAL", "REVENUE_SHARE_APPLIED"),
        ({"license_purchased": (False,), "revenue_share_agreed": (False,)}, "HIGH", "LICENSE_REQUIRED"),
    )),
    ("COMMERCIAL_CONTENT_ID", {"license_type": ("CONTENT_ID", "COMMERCIAL")}, (
        ({"policy_action": ("MONETIZE_CLAIM",)}, "CONDITIONAL", "REVENUE_REDIRECTED"),
        ({"policy_action": ("BLOCK_OR_TAKEDOWN",)}, "HIGH", "VIDEO_BLOCKED_OR_STRIKE"),
        ({"policy_action": (None, "NONE")}, *REVIEW),
    )),
    ("CREATIVE_COMMONS", {"license_type": CC_TYPES}, (
        ({"commercial_use_allowed": (False,), "ctx_commercial": (True,)}, "HIGH", "NON_COMMERCIAL_VIOLATION"),
        ({"monetization_allowed": (False,), "ctx_monetization": (True,)}, "HIGH", "MONETIZATION_NOT_PERMITTED"),
        ({"license_type": ("CC0",)}, "LOW", "FREE_TO_USE"),
        ({"attribution_required": (True,)}, "CONDITIONAL", "ATTRIBUTION_REQUIRED"),
        ({"attribution_required": (False,)}, "LOW", "FREE_TO_USE"),
    )),
    ("PUBLIC_DOMAIN", {"license_type": ("PUBLIC_DOMAIN",), "copyright_status": ("PUBLIC_DOMAIN",)}, (
        ({"composition_pd": ("verified",), "recording_public_domain": (True,)}, "LOW", "FREE_TO_USE"),
        ({"composition_pd": ("verified",), "recording_public_domain": (False,), "ctx_commercial": (True,)}, "HIGH", "RECORDING_PERMISSION_REQUIRED"),
        ({"composition_pd": ("verified",), "recording_public_domain": (False,)}, "CONDITIONAL", "RECORDING_PERMISSION_REQUIRED"),
        ({"composition_pd": ("possible", "unknown", None)}, *REVIEW),
        ({"composition_pd": ("no",), "recording_public_domain": (True,)}, "CONDITIONAL", "COMPOSITION_PERMISSION_REQUIRED"),
    )),
)

#: Fixed penalties of rights confidence.
PENALTIES = {
    "missing_license_type": 0.40, "missing_copyright_status": 0.20, "simulated_source": 0.30, "predicted_source": 0.60,
    "unverified": 0.20, "simulated_unverified": 0.10, "stale_penalty": 0.10, "license_expired": 0.30,
}
STALE_DAYS = 365

RECOMMENDATIONS = {
    "ATTRIBUTION_REQUIRED": "Credit the author in the description.",
    "REVENUE_SHARE_APPLIED": "Revenue is shared as agreed.",
    "REVENUE_REDIRECTED": "Revenue goes to the rights holder.",
    "VIDEO_BLOCKED_OR_STRIKE": "Use another track.",
    "NON_COMMERCIAL_VIOLATION": "Use it non-commercially or change the track.",
    "MONETIZATION_NOT_PERMITTED": "Turn monetisation off or change the track.",
    "RECORDING_PERMISSION_REQUIRED": "Ask the owner of the recording, or use a free recording.",
    "COMPOSITION_PERMISSION_REQUIRED": "Clear the rights in the composition.",
    "LICENSE_REQUIRED": "Buy a license before use.",
    "HUMAN_REVIEW_REQUIRED": "A person must check before publication.",
    "MONETIZABLE_UNTIL_RETROACTIVE_CLAIM": "May be monetised until someone claims it.",
    "FREE_TO_USE": "Free to use.",
    "FULL_REVENUE_RETAINED": "You keep all revenue.",
}


def equals_any(field: str, values: tuple) -> Column:
    c = comparable(F.col(field))
    return reduce(Column.__or__, [c.eqNullSafe(F.lit(None if v is None else str(v).lower())) for v in values])


def all_hold(when: dict[str, tuple]) -> Column:
    return reduce(Column.__and__, [equals_any(f, v) for f, v in when.items()])


def license_valid(start: Column, end: Column, as_of: Column) -> Column:
    """Inside the interval, both ends included; a bound that is missing or no date is ignored."""
    a, b = (F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd") for c in (start, end))
    return (a.isNull() | (as_of >= a)) & (b.isNull() | (as_of <= b))


def penalties(as_of: Column) -> dict[str, Column]:
    """When each penalty applies."""
    source = F.upper(F.coalesce("rights_source", F.lit("")))
    simulated, unverified = source.startswith("SIMULATED"), F.col("verified_at").isNull()
    return {
        "missing_license_type": F.coalesce(F.col("license_type"), F.lit("UNKNOWN")).isin("UNKNOWN", ""),
        "missing_copyright_status": F.coalesce(F.col("copyright_status"), F.lit("")) == "",
        "predicted_source": source.startswith("PREDICTED"),
        "simulated_source": simulated,
        "unverified": unverified,
        "simulated_unverified": unverified & simulated,
        "stale_penalty": F.datediff(as_of, "verified_at") > STALE_DAYS,
        "license_expired": ~license_valid(F.col("valid_from"), F.col("valid_until"), as_of),
    }


def rights_confidence(as_of: Column) -> Column:
    """1 minus penalties, within 0 and 1, 4 digits; 0 without rights (``has_rights``)."""
    total = reduce(Column.__add__, [F.when(c, PENALTIES[k]).otherwise(0.0) for k, c in penalties(as_of).items()])
    return F.when(F.col("has_rights"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - total)), 4)).otherwise(0.0)


def confidence_breakdown(as_of: Column) -> Column:
    """struct(base, penalties: codes and amounts in order, final, formula) of rights confidence."""
    row = "struct<code:string,amount:double>"
    said = [F.when(c, F.struct(F.lit(k).alias("code"), F.lit(PENALTIES[k]).alias("amount"))) for k, c in penalties(as_of).items()]
    listed = F.when(F.col("has_rights"), F.array_compact(F.array(*said))).otherwise(F.array().cast(f"array<{row}>"))
    final = rights_confidence(as_of)
    digits = lambda x: F.format_string("%.2f", x)
    terms = F.array_join(F.transform(listed, lambda p: F.concat(F.lit(" − "), digits(p["amount"]), F.lit(" ("), p["code"], F.lit(")"))), "")
    raw = 1.0 - F.aggregate(listed, F.lit(0.0), lambda a, p: a + p["amount"])
    held = F.when((raw < -1e-9) | (raw > 1 + 1e-9), " (kẹp về khoảng [0, 1])").otherwise("")
    formula = F.when(F.col("has_rights"), F.concat(F.lit("1.00"), terms, F.lit(" = "), digits(final), held)).otherwise("không có dữ liệu quyền -> 0.00")
    return F.struct(F.lit(1.0).alias("base"), listed.alias("penalties"), final.alias("final"), formula.alias("formula"))


def identity_floor(t: Thresholds = DEFAULT) -> Column:
    kind = F.col("match_type")
    return (
        F.when(kind == "EXACT_MATCH", t.fingerprint)
        .when(kind == "NEAR_MATCH", t.embedding)
        .when(kind == "COVER_MATCH", t.cover)
        .when(kind == "LICENSE_PREDICTED", LICENSE_PREDICTED_FLOOR)
        .otherwise(OTHER_FLOOR)
    )


OUTCOME = ("category", "risk", "condition", "rule_id")


def outcomes() -> list[tuple[str, str, str, str]]:
    """Everything that can be decided: gates, then rules and the default of each group, then no group."""
    out = [
        ("USER_GENERATED_CONTENT", "LOW", "MONETIZABLE_UNTIL_RETROACTIVE_CLAIM", "gate.no_match"),
        ("UNCATEGORIZED", *REVIEW, "gate.low_confidence"), ("UNCATEGORIZED", *REVIEW, "gate.missing_rights"),
    ]
    for name, _, rules in GROUPS:
        out += [(name, risk, condition, f"{name}.rule[{i}]") for i, (_, risk, condition) in enumerate(rules)]
        out.append((name, *REVIEW, f"{name}.default"))
    return [*out, ("UNCATEGORIZED", "UNKNOWN", "UNCATEGORIZED", "uncategorized")]


def decide(confidence: Column, t: Thresholds = DEFAULT) -> Column:
    """struct(category, risk, condition, rule_id, provisional, decision_confidence) of a row of facts.

    Rules give the number of an outcome, which is looked up once, so the generated code stays small.
    """
    table = outcomes()
    number = {row[3]: i for i, row in enumerate(table)}
    chosen = F.lit(number["uncategorized"])
    for name, match, rules in reversed(GROUPS):
        inner = F.lit(number[f"{name}.default"])
        for i, (when, _, _) in reversed(list(enumerate(rules))):
            inner = F.when(all_hold(when), number[f"{name}.rule[{i}]"]).otherwise(inner)
        chosen = F.when(reduce(Column.__or__, [equals_any(f, v) for f, v in match.items()]), inner).otherwise(chosen)
    none = F.col("match_type").isNull() | (F.col("match_type") == "NO_MATCH")
    identity = F.coalesce("identity_confidence", F.lit(0.0))
    weak = (F.col("match_type") == "UNKNOWN") | (identity < identity_floor(t))
    has = F.col("has_rights")
    pick = F.when(none & ~has, number["gate.no_match"]).when(weak, number["gate.low_confidence"]).when(~has, number["gate.missing_rights"]).otherwise(chosen)
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(row, OUTCOME)]) for row in table])

    def told(first: Column) -> Column:
        gated = (first["risk"] != "UNKNOWN") & has & (confidence < t.rights_gate)
        risk = F.when(gated, "UNKNOWN").otherwise(first["risk"])
        sure = F.when(risk == "UNKNOWN", 0.0).when(has, F.least(identity, confidence)).otherwise(identity)
        return F.struct(
            first["category"].alias("category"), risk.alias("risk"),
            F.when(gated, "HUMAN_REVIEW_REQUIRED").otherwise(first["condition"]).alias("condition"),
            first["rule_id"].alias("rule_id"), F.when(gated, first["risk"]).alias("provisional"), F.round(sure, 4).alias("decision_confidence"),
        )

    return F.transform(F.array(F.get(rows, pick)), told)[0]


def load_groups(path: str) -> tuple:
    """Rule groups from a JSON or YAML file, by their ``order``; the shape of ``GROUPS``.

    The file holds ``groups``, each with order, name, match and rules, and each rule with
    when, risk and condition; a missing key is an error.
    """
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            import json

            told = json.load(f)
        else:
            import yaml

            told = yaml.safe_load(f)
    listed = lambda v: tuple(v) if isinstance(v, list) else (v,)
    fields = lambda d: {k: listed(v) for k, v in d.items()}
    groups = sorted(told["groups"], key=lambda g: g["order"])
    return tuple((g["name"], fields(g["match"]), tuple((fields(r["when"]), r["risk"], r["condition"]) for r in g["rules"])) for g in groups)


def recommendation(condition: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RECOMMENDATIONS.items() for x in kv])
    return table[condition]
