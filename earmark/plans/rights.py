"""Queries of rights lookup, rules, licenses and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import license as L
from ..functions import text as T
from ..operators import postings, rights, rules, windows
from ..sources import adapters as A

VERIFIED = "1998-01-01 00:00:00"


def _rights(spark, d) -> DataFrame:
    """Simulated rights; some rows count for a composition only, some lack a type, a status or a check."""
    r = rights.simulated(A.recordings(spark, d), VERIFIED)
    b = A.bucket(F.col("recording_id"), "hole", 20)
    return r.withColumn("b", b).select(
        "rights_id", F.when(F.col("b") == 0, None).otherwise(F.col("recording_id")).alias("recording_id"), "composition_id",
        F.when(F.col("b") == 1, None).otherwise(F.col("license_type")).alias("license_type"),
        F.when(F.col("b") == 2, None).otherwise(F.col("copyright_status")).alias("copyright_status"),
        *[c for c in r.columns if c.endswith("_required") or c.endswith("_allowed")],
        "policy_action", "license_purchased", "revenue_share_agreed", "recording_public_domain", "valid_from",
        F.when(F.col("b") == 4, "1997-12-31").otherwise(F.col("valid_until")).alias("valid_until"),
        F.when(F.col("b") < 12, "Jamendo").otherwise(F.col("rights_source")).alias("rights_source"),
        F.when(F.col("b") == 3, None).when(F.col("b") == 5, F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))).otherwise(F.col("verified_at")).alias("verified_at"),
    )


def _facts(spark, d) -> DataFrame:
    """One decision a recording: match type and confidence by bucket, context by bucket."""
    rec, r = A.recordings(spark, d), _rights(spark, d)
    gone = A.bucket(F.col("recording_id"), "gone", 15) == 0
    found = rights.lookup(rec, r.filter(F.col("recording_id").isNull() | (A.bucket(F.col("recording_id"), "gone", 15) != 0)))
    m = A.bucket(F.col("recording_id"), "match", 6)
    return found.withColumn("has_rights", F.col("scope").isNotNull()).select(
        "*",
        F.get(F.array(*[F.lit(x) for x in ("EXACT_MATCH", "NEAR_MATCH", "COVER_MATCH", "UNKNOWN", "NO_MATCH", "LICENSE_PREDICTED")]), m).alias("match_type"),
        (A.bucket(F.col("recording_id"), "conf", 101) / 100.0).alias("identity_confidence"),
        (A.bucket(F.col("recording_id"), "com", 2) == 0).alias("ctx_commercial"), (A.bucket(F.col("recording_id"), "mon", 2) == 0).alias("ctx_monetization"),
        F.when(rules.license_valid(F.col("valid_from"), F.col("valid_until"), _as_of()), True).otherwise(False).alias("license_valid"),
        A.pd_status(F.col("composition_id")).alias("composition_pd"), gone.alias("gone"),
    )


def _as_of():
    return F.lit(A.AS_OF).cast("date")


def rights_lookup_fallback(spark, d):
    found = rights.lookup(A.recordings(spark, d), _rights(spark, d))
    return found.select("recording_id", "scope", "rights_id", "license_type")


def rights_simulated(spark, d):
    r = rights.simulated(A.recordings(spark, d), VERIFIED)
    return r.drop("verified_at", "valid_from", "valid_until", "composition_id")


def rights_confidence(spark, d):
    return _facts(spark, d).select("recording_id", "has_rights", rules.rights_confidence(_as_of()).alias("rights_confidence"))


def rule_engine_decisions(spark, d):
    x = _facts(spark, d).withColumn("rights_confidence", rules.rights_confidence(_as_of()))
    return x.select("recording_id", "match_type", "rights_confidence", rules.decide(F.col("rights_confidence")).alias("d")).select(
        "recording_id", "match_type", "rights_confidence", "d.*"
    )


def rule_engine_worst_case(spark, d):
    """Decisions that change when the use is commercial and monetised."""
    x = _facts(spark, d).withColumn("rights_confidence", rules.rights_confidence(_as_of()))
    x = x.withColumn("d", rules.decide(F.col("rights_confidence"))).withColumn("ctx_commercial", F.lit(True)).withColumn("ctx_monetization", F.lit(True))
    x = x.withColumn("w", rules.decide(F.col("rights_confidence")))
    changed = ~(F.col("d.risk").eqNullSafe(F.col("w.risk")) & F.col("d.condition").eqNullSafe(F.col("w.condition")))
    return x.filter(changed).select("recording_id", F.col("d.risk").alias("risk"), F.col("w.risk").alias("worst_risk"), F.col("w.condition").alias("worst_condition"))


def recommendation_text(spark, d):
    x = rule_engine_decisions(spark, d)
    return x.select("recording_id", "condition", rules.recommendation(F.col("condition")).alias("action"))


STRINGS = (
    (1, "Attribution-NonCommercial-ShareAlike 3.0 International", None), (2, None, "http://creativecommons.org/licenses/by-nd-nc/3.0/"),
    (3, "Attribution", "https://creativecommons.org/publicdomain/zero/1.0/"), (4, "Public Domain Mark", None), (5, "CC0 1.0 Universal", None),
    (6, "All rights reserved", None), (7, "Attribution-ShareAlike-NoDerivs", None), (8, None, "https://creativecommons.org/licenses/nc/1.0/"),
    (9, "Attribution-NoDerivatives 4.0", "https://example.com/"), (10, "", ""), (11, None, None), (12, "Public domain dedication", None),
    (13, "attribution non commercial", None), (14, None, "HTTPS://CREATIVECOMMONS.ORG/licenses/BY-SA/4.0"), (15, "Attribution-Share Alike", None),
)


def _strings(spark, d):
    fixed = spark.createDataFrame(list(STRINGS), "id long, license_text string, license_url string")
    pages = A.table(spark, d, "pages").select((F.col("page_id") + 1000).alias("id"), F.regexp_extract("html", r"(?i)(licensed? [^<.]{0,60})", 1).alias("license_text"), F.col("url").alias("license_url"))
    return fixed.union(pages)


def license_flags(spark, d):
    return _strings(spark, d).select("id", *L.normalised(F.col("license_text"), F.col("license_url")))


def license_inverse(spark, d):
    r = rights.simulated(A.recordings(spark, d), VERIFIED).select("recording_id", "license_type", "commercial_use_allowed")
    code = L.code_of_type(F.col("license_type"))
    want = L.flag(code, "commercial_use_allowed")
    return r.select("recording_id", code.alias("code"), want.alias("commercial"), L.label_to_url(F.concat(F.lit("CC "), F.upper(code))).alias("url"), (want.eqNullSafe(F.col("commercial_use_allowed")) | want.isNull()).alias("agrees"))


# --- windows


def window_plan(spark, d):
    x = A.table(spark, d, "orders").select("o_orderkey", windows.cents(F.col("o_totalprice") / 1000).alias("duration"))
    w = x.select("o_orderkey", "duration", F.posexplode(windows.plan_windows(F.col("duration"))).alias("idx", "start"))
    return w.select("o_orderkey", "duration", "idx", "start")


def segment_plan(spark, d):
    x = A.table(spark, d, "orders").select("o_orderkey", windows.cents(F.col("o_totalprice") / 2000).alias("duration"))
    return x.select("o_orderkey", F.posexplode(windows.plan_segments(F.col("duration"))).alias("idx", "s")).select("o_orderkey", "idx", "s.start", F.round("s.end", 2).alias("end"))


def evaluation_windows(spark, d):
    x = A.table(spark, d, "orders").select("o_orderkey", windows.cents(F.col("o_totalprice") / 2000).alias("duration"))
    return x.select("o_orderkey", F.explode(windows.evaluation_windows(F.col("duration"))).alias("w")).select("o_orderkey", "w.start", "w.end")


def window_best_pick(spark, d):
    li = A.table(spark, d, "lineitem")
    kind = F.when(F.col("l_quantity") >= 48, "EXACT_MATCH").when(F.col("l_returnflag") == "R", "NEAR_MATCH").when(F.col("l_returnflag") == "A", "COVER_MATCH").otherwise("UNKNOWN")
    w = li.groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("window_idx")).agg(F.max(F.struct("l_quantity", "l_returnflag")).alias("m"))
    w = w.select("job", "window_idx", F.col("m.l_quantity").alias("l_quantity"), F.col("m.l_returnflag").alias("l_returnflag"))
    w = w.select("job", "window_idx", kind.alias("match_type"), (F.col("l_quantity") / 50).alias("score"))
    return windows.best_window(w, "job").select("job", "window_idx", "match_type", F.round("score", 6).alias("score"), "scanned")


def interval_overlap_labels(spark, d):
    """Spans of the same order that overlap by at least half of the shorter."""
    li = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("q"), F.col("l_quantity").alias("s"), (F.col("l_quantity") + 5 + F.col("l_linenumber")).alias("e"))
    return windows.overlapping(li, li.withColumnRenamed("q", "r")).filter("q < r")


def text_projections(spark, d):
    p = A.table(spark, d, "part")
    return p.select(
        "p_partkey", T.clean(F.concat(F.lit("  "), F.col("p_name"), F.lit("\x07 "))).alias("name"), T.year(F.concat(F.col("p_size") + 1950, F.lit("-05-01"))).alias("year"),
        T.composer(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")), F.col("p_brand")).alias("composer"),
        T.track_number(F.concat(F.lit("audio/000"), F.col("p_partkey").cast("string"), F.lit(".mp3"))).alias("track"),
        T.display_label(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.col("p_brand"), F.lit("file.mp3")).alias("label"),
    )


def match_and_decide(spark, d):
    """For each passage: the reference it comes from, its verdict, and what may be done with it commercially."""
    q = A.query_items(spark, d)
    got = postings.search(q, A.index_of(spark, d), q.groupBy("query_id").agg(F.count("*").cast("double").alias("duration")))
    n = A.table(spark, d, "part").count()
    m = got.select(
        "query_id", F.col("doc_id").alias("matched"), F.col("score").alias("identity_confidence"),
        F.when(F.col("match_type") == "EXACT_MATCH", "EXACT_MATCH").otherwise("UNKNOWN").alias("match_type"), (F.pmod("doc_id", F.lit(n)) + 1).alias("rec"),
    )
    found = rights.lookup(A.recordings(spark, d), _rights(spark, d)).withColumnRenamed("recording_id", "rec")
    x = m.join(found, "rec", "left").withColumn("has_rights", F.col("scope").isNotNull()).withColumn("ctx_commercial", F.lit(True)).withColumn("ctx_monetization", F.lit(True))
    x = x.withColumn("license_valid", rules.license_valid(F.col("valid_from"), F.col("valid_until"), _as_of())).withColumn("composition_pd", A.pd_status(F.col("composition_id")))
    x = x.withColumn("rights_confidence", rules.rights_confidence(_as_of()))
    return x.select("query_id", "matched", "match_type", "identity_confidence", "rights_confidence", rules.decide(F.col("rights_confidence")).alias("d")).select(
        "query_id", "matched", "match_type", "identity_confidence", "rights_confidence", "d.*"
    )


# --- SQL

_B = A.sql_bucket
_DATA = "['" + "', '".join(rights.DATASETS) + "'][src + 1]"
_SIM = f"""
b0 as (select *, {_DATA} as ds, {_B("recording_id", "ytal", 100)} as b_ytal, {_B("recording_id", "cm", 100)} as b_cm, {_B("recording_id", "jamendo", 100)} as b_ja,
    {_B("recording_id", "fma", 100)} as b_fma, {_B("recording_id", "fma_cc", 100)} as b_cc, {_B("recording_id", "fma_policy", 100)} as b_pol, {_B("recording_id", "pd", 100)} as b_pd from rec),
b1 as (select *, case when src = 2 then case when b_ja < 40 then 'CC_BY' when b_ja < 60 then 'CC_BY_SA' when b_ja < 85 then 'CC_BY_NC' else 'CC_BY_NC_ND' end
    when src = 3 and b_fma < 50 then case when b_cc < 60 then 'CC_BY' else 'CC_BY_NC' end end as variant from b0),
sim as (select 'r' || recording_id as rights_id, recording_id, composition_id,
    coalesce(variant, ['AUDIO_LIBRARY', 'CREATOR_MUSIC', '', 'CONTENT_ID', 'PUBLIC_DOMAIN'][src + 1]) as license_type,
    case when src = 0 then 'LICENSED' when src = 4 and b_pd < 60 then 'PUBLIC_DOMAIN' else 'PROTECTED' end as copyright_status,
    case when variant is not null then true when src = 0 then b_ytal < 40 else false end as attribution_required,
    case when variant is not null then not contains(variant, 'NC') when src in (0, 1) then true when src = 4 then b_pd < 60 else false end as commercial_use_allowed,
    case when variant is not null then not contains(variant, 'ND') when src = 0 then true when src = 4 then b_pd < 60 else false end as modification_allowed,
    case when variant is not null then not contains(variant, 'NC') when src in (0, 1) then true when src = 4 then b_pd < 60 else false end as monetization_allowed,
    case when src = 1 then b_cm >= 50 when src = 3 and variant is null then b_pol >= 30 else false end as revenue_share_required,
    case when src = 3 and variant is null then case when b_pol < 30 then 'BLOCK_OR_TAKEDOWN' else 'MONETIZE_CLAIM' end else 'NONE' end as policy_action,
    src = 1 and b_cm < 50 as license_purchased, src = 1 and b_cm >= 50 as revenue_share_agreed, src = 4 and b_pd < 60 as recording_public_domain,
    'SIMULATED (' || ds || ')' as rights_source from b1),
holes as (select *, {_B("recording_id", "hole", 20)} as b from sim),
rights as (select rights_id, case when b = 0 then null else recording_id end as recording_id, composition_id, case when b = 1 then null else license_type end as license_type,
    case when b = 2 then null else copyright_status end as copyright_status, attribution_required, commercial_use_allowed, modification_allowed, monetization_allowed, revenue_share_required,
    policy_action, license_purchased, revenue_share_agreed, recording_public_domain, case when b = 4 then date '1997-12-31' else date '2030-12-31' end as valid_until, date '2020-01-01' as valid_from,
    case when b < 12 then 'Jamendo' else rights_source end as rights_source, case when b = 3 then null when b = 5 then date '1996-01-01' else date '1998-01-01' end as verified_at from holes)"""
_LOOK = """
own as (select * from {r} where recording_id is not null qualify row_number() over (partition by recording_id order by verified_at desc nulls last, rights_id) = 1),
shared as (select * from {r} where recording_id is null and composition_id is not null qualify row_number() over (partition by composition_id order by verified_at desc nulls last, rights_id) = 1),
pick as (select rec.recording_id, rec.composition_id, case when o.rights_id is not null then 'recording' when s.rights_id is not null then 'composition' end as scope, coalesce(o.rights_id, s.rights_id) as rid
    from rec left join own o on o.recording_id = rec.recording_id left join shared s on s.composition_id = rec.composition_id),
look as (select p.recording_id, p.composition_id, p.scope, r.* exclude (recording_id, composition_id) from pick p left join rights r on r.rights_id = p.rid)"""
_HEAD = f"with {A.SQL_REC}, {_SIM}, {_LOOK.format(r='rights')}"
_HEADG = f"with {A.SQL_REC}, {_SIM}, kept as (select * from rights where recording_id is null or {_B('recording_id', 'gone', 15)} <> 0), {_LOOK.format(r='kept')}"
_P = rules.PENALTIES
_CONF = f"""case when scope is null then 0::double else round(greatest(0, least(1, 1 - (
    case when license_type is null or license_type in ('UNKNOWN', '') then {_P["missing_license_type"]}::double else 0 end + case when copyright_status is null then {_P["missing_copyright_status"]}::double else 0 end
    + case when starts_with(rights_source, 'SIMULATED') then {_P["simulated_source"]}::double else 0 end + 0::double + case when verified_at is null then {_P["unverified"]}::double else 0 end
    + case when verified_at is null and starts_with(rights_source, 'SIMULATED') then {_P["simulated_unverified"]}::double else 0 end
    + case when date '{A.AS_OF}' - verified_at > 365 then {_P["stale_penalty"]}::double else 0 end + case when not (date '{A.AS_OF}' >= valid_from and date '{A.AS_OF}' <= valid_until) then {_P["license_expired"]}::double else 0 end))), 4) end"""
_FACT = f"""
f0 as (select *, scope is not null as has, ['EXACT_MATCH', 'NEAR_MATCH', 'COVER_MATCH', 'UNKNOWN', 'NO_MATCH', 'LICENSE_PREDICTED'][{_B("recording_id", "match", 6)} + 1] as match_type,
    {_B("recording_id", "conf", 101)} / 100.0::double as ic, {_B("recording_id", "com", 2)} = 0 as com, {_B("recording_id", "mon", 2)} = 0 as mon,
    coalesce(date '{A.AS_OF}' >= valid_from and date '{A.AS_OF}' <= valid_until, true) as valid, {A.sql_pd("composition_id")} as pd from look),
facts as (select *, {_CONF} as rc from f0)"""


def _decide_sql(facts: str, com: str, mon: str) -> str:
    cc = "('" + "', '".join(rules.CC_TYPES) + "')"
    rule = f"""case when license_type = 'AUDIO_LIBRARY' then case attribution_required when false then 'AUDIO_LIBRARY.rule[0]|LOW|FREE_TO_USE' when true then 'AUDIO_LIBRARY.rule[1]|CONDITIONAL|ATTRIBUTION_REQUIRED' else 'AUDIO_LIBRARY.default|UNKNOWN|HUMAN_REVIEW_REQUIRED' end
  when license_type = 'CREATOR_MUSIC' then case when license_purchased and valid then 'CREATOR_MUSIC.rule[0]|LOW|FULL_REVENUE_RETAINED' when license_purchased then 'CREATOR_MUSIC.rule[1]|UNKNOWN|HUMAN_REVIEW_REQUIRED'
    when revenue_share_agreed then 'CREATOR_MUSIC.rule[2]|CONDITIONAL|REVENUE_SHARE_APPLIED' when not license_purchased and not revenue_share_agreed then 'CREATOR_MUSIC.rule[3]|HIGH|LICENSE_REQUIRED' else 'CREATOR_MUSIC.default|UNKNOWN|HUMAN_REVIEW_REQUIRED' end
  when license_type in ('CONTENT_ID', 'COMMERCIAL') then case when policy_action = 'MONETIZE_CLAIM' then 'COMMERCIAL_CONTENT_ID.rule[0]|CONDITIONAL|REVENUE_REDIRECTED' when policy_action = 'BLOCK_OR_TAKEDOWN' then 'COMMERCIAL_CONTENT_ID.rule[1]|HIGH|VIDEO_BLOCKED_OR_STRIKE'
    when policy_action is null or policy_action = 'NONE' then 'COMMERCIAL_CONTENT_ID.rule[2]|UNKNOWN|HUMAN_REVIEW_REQUIRED' else 'COMMERCIAL_CONTENT_ID.default|UNKNOWN|HUMAN_REVIEW_REQUIRED' end
  when license_type in {cc} then case when not commercial_use_allowed and {com} then 'CREATIVE_COMMONS.rule[0]|HIGH|NON_COMMERCIAL_VIOLATION' when not monetization_allowed and {mon} then 'CREATIVE_COMMONS.rule[1]|HIGH|MONETIZATION_NOT_PERMITTED'
    when license_type = 'CC0' then 'CREATIVE_COMMONS.rule[2]|LOW|FREE_TO_USE' when attribution_required then 'CREATIVE_COMMONS.rule[3]|CONDITIONAL|ATTRIBUTION_REQUIRED' when not attribution_required then 'CREATIVE_COMMONS.rule[4]|LOW|FREE_TO_USE' else 'CREATIVE_COMMONS.default|UNKNOWN|HUMAN_REVIEW_REQUIRED' end
  when license_type = 'PUBLIC_DOMAIN' or copyright_status = 'PUBLIC_DOMAIN' then case when pd = 'verified' and recording_public_domain then 'PUBLIC_DOMAIN.rule[0]|LOW|FREE_TO_USE' when pd = 'verified' and {com} then 'PUBLIC_DOMAIN.rule[1]|HIGH|RECORDING_PERMISSION_REQUIRED'
    when pd = 'verified' then 'PUBLIC_DOMAIN.rule[2]|CONDITIONAL|RECORDING_PERMISSION_REQUIRED' when pd is null or pd in ('possible', 'unknown') then 'PUBLIC_DOMAIN.rule[3]|UNKNOWN|HUMAN_REVIEW_REQUIRED'
    when pd = 'no' and recording_public_domain then 'PUBLIC_DOMAIN.rule[4]|CONDITIONAL|COMPOSITION_PERMISSION_REQUIRED' else 'PUBLIC_DOMAIN.default|UNKNOWN|HUMAN_REVIEW_REQUIRED' end
  else 'uncategorized|UNKNOWN|UNCATEGORIZED' end"""
    floor = "case match_type when 'EXACT_MATCH' then 0.3 when 'NEAR_MATCH' then 0.98 when 'COVER_MATCH' then 0.9 when 'LICENSE_PREDICTED' then 0 else 0.97 end"
    return f"""select *, case when (match_type is null or match_type = 'NO_MATCH') and not has then 'gate.no_match|LOW|MONETIZABLE_UNTIL_RETROACTIVE_CLAIM'
  when match_type = 'UNKNOWN' or coalesce(ic, 0) < {floor} then 'gate.low_confidence|UNKNOWN|HUMAN_REVIEW_REQUIRED' when not has then 'gate.missing_rights|UNKNOWN|HUMAN_REVIEW_REQUIRED' else {rule} end as hit from {facts}"""


_OUT = """
out_ as (select *, string_split(hit, '|')[1] as rule_id, string_split(hit, '|')[2] as r0, string_split(hit, '|')[3] as c0 from dec),
fin as (select *, has and r0 <> 'UNKNOWN' and rc < 0.5 as gated, case when has and r0 <> 'UNKNOWN' and rc < 0.5 then 'UNKNOWN' else r0 end as risk from out_),
result as (select *, case when gated then 'HUMAN_REVIEW_REQUIRED' else c0 end as condition, case when gated then r0 end as provisional,
    case when rule_id = 'gate.no_match' then 'USER_GENERATED_CONTENT' when rule_id = 'uncategorized' or starts_with(rule_id, 'gate.') then 'UNCATEGORIZED' else string_split(rule_id, '.')[1] end as category,
    round(case when risk = 'UNKNOWN' then 0::double when has then least(coalesce(ic, 0), rc) else coalesce(ic, 0) end, 4) as decision_confidence from fin)"""
_DEC = f"{_HEADG}, {_FACT}, dec as ({_decide_sql('facts', 'com', 'mon')}), {_OUT}"
_STR = "(values " + ", ".join("(" + ", ".join("null" if x is None else repr(x) for x in row) + ")" for row in STRINGS) + ") t(id, license_text, license_url)"
_CODE = """
src as (select id, lower(coalesce(license_text::varchar, '')) as t, lower(coalesce(license_url::varchar, '')) as u from {s} union all
    select page_id + 1000, lower(regexp_extract(html, '(?i)(licensed? [^<.]{{0,60}})', 1)), lower(url) from pages),
p as (select *, regexp_replace(t, '[^a-z0-9]+', ' ', 'g') as low, string_split(regexp_extract(u, 'creativecommons\\.org/licenses/([a-z][a-z-]*)', 1), '-') as parts from src),
flags as (select *, list_contains(parts, 'by') as ub, list_contains(parts, 'nc') as un, list_contains(parts, 'sa') as us, list_contains(parts, 'nd') as ud,
    contains(low, 'attribution') as tb, contains(low, 'noncommercial') or contains(low, 'non commercial') as tn, contains(low, 'sharealike') or contains(low, 'share alike') as ts, contains(low, 'noderiv') or contains(low, 'no deriv') as td from p),
codes as (select *, case when contains(u, 'creativecommons.org/publicdomain/zero') then 'cc0' when contains(u, 'creativecommons.org/publicdomain/mark') then 'pdm'
    when ub and not (us and ud) then 'by' || case when un then '-nc' else '' end || case when us then '-sa' else '' end || case when ud then '-nd' else '' end end as cu,
  case when contains(low, 'cc0') or contains(low, 'zero') or (contains(low, 'public domain') and contains(low, 'dedication')) then 'cc0' when contains(low, 'public domain') then 'pdm'
    when tb and not (ts and td) then 'by' || case when tn then '-nc' else '' end || case when ts then '-sa' else '' end || case when td then '-nd' else '' end end as ct from flags),
lic(code, license_type, copyright_status, attribution_required, commercial_use_allowed, modification_allowed, monetization_allowed, recording_public_domain) as (values {rows})"""
_LIC = ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in L.LICENSES)
_RECS = "case condition " + " ".join(f"when '{k}' then '{v}'" for k, v in rules.RECOMMENDATIONS.items()) + " end"
_RCOLS = "recording_id, match_type, rc as rights_confidence, category, risk, condition, rule_id, provisional, decision_confidence"

from .similarity import _search_sql  # noqa: E402

QUERIES = {f.__name__: f for f in (
    match_and_decide, rights_lookup_fallback, rights_simulated, rights_confidence, rule_engine_decisions, rule_engine_worst_case, recommendation_text,
    license_flags, license_inverse, window_plan, segment_plan, evaluation_windows, window_best_pick, interval_overlap_labels, text_projections,
)}
ORACLE = {
    "match_and_decide": _search_sql(1.0) + f""", {A.SQL_REC}, {_SIM}, {_LOOK.format(r="rights")},
m as (select v.query_id, v.doc_id as matched, v.score as ic, v.match_type, v.doc_id % (select count(*) from part) + 1 as rid from verdict v),
f0 as (select m.query_id, matched, ic, match_type, look.*, scope is not null as has, coalesce(date '{A.AS_OF}' >= valid_from and date '{A.AS_OF}' <= valid_until, true) as valid, {A.sql_pd("composition_id")} as pd from m left join look on look.recording_id = m.rid),
facts as (select *, {_CONF} as rc from f0), dec as ({_decide_sql("facts", "true", "true")}), {_OUT}
select query_id, matched, match_type, ic as identity_confidence, rc as rights_confidence, category, risk, condition, rule_id, provisional, decision_confidence from result""",
    "rights_lookup_fallback": f"{_HEAD} select recording_id, scope, rights_id, license_type from look",
    "rights_simulated": f"with {A.SQL_REC}, {_SIM} select * exclude (composition_id) from sim",
    "rights_confidence": f"{_HEADG}, {_FACT} select recording_id, has as has_rights, rc as rights_confidence from facts",
    "rule_engine_decisions": f"{_DEC} select {_RCOLS} from result",
    "rule_engine_worst_case": f"{_DEC}, base as (select recording_id, risk, condition from result), {_OUT.replace('dec)', 'dec2)').replace('out_', 'out2').replace('fin ', 'fin2 ').replace('from fin)', 'from fin2)').replace('result as', 'result2 as')}"
    .replace("out2 as", f"dec2 as ({_decide_sql('facts', 'true', 'true')}), out2 as", 1)
    + " select recording_id, base.risk, w.risk as worst_risk, w.condition as worst_condition from base join result2 w using (recording_id) where base.risk <> w.risk or base.condition <> w.condition",
    "recommendation_text": f"{_DEC} select recording_id, condition, {_RECS} as action from result",
    "license_flags": f"with {_CODE.format(s=_STR, rows=_LIC)} select id, coalesce(cu, ct) as license_code, case when cu is not null then 'url' when ct is not null then 'text' end as matched_on, {', '.join(L.FLAGS)} from codes left join lic on code = coalesce(cu, ct)",
    "license_inverse": f"""with {A.SQL_REC}, {_SIM}, lic(code, license_type, copyright_status, attribution_required, commercial, m, n, p) as (values {_LIC})
select recording_id, code, commercial, case when starts_with(code, 'by') then 'https://creativecommons.org/licenses/' || code || '/4.0/' end as url, commercial is null or commercial = commercial_use_allowed as agrees from sim left join lic using (license_type)""",
    "window_plan": """with x as (select o_orderkey, floor(o_totalprice / 1000 * 100 + 0.5) / 100 as duration from orders), n as (select *, case when duration <= 30 then 1 else least(8, greatest(2, ceil(duration / 30)::int)) end as n from x)
select o_orderkey, duration, idx::int as idx, case when n = 1 then 0::double else floor(idx * (duration - 30) / (n - 1) * 100 + 0.5) / 100 end as start from n, unnest(generate_series(0, n - 1)) t(idx)""",
    "segment_plan": """with x as (select o_orderkey, floor(o_totalprice / 2000 * 100 + 0.5) / 100 as duration from orders), g as (select *, floor((duration - 15) / 10 + 1e-9)::int + 1 as g from x where duration >= 1),
n as (select *, case when duration <= 15 then 1 when g <= 12 then g else 12 end as n from g),
s as (select o_orderkey, duration, idx::int as idx, case when duration <= 15 then 0::double when g <= 12 then idx * 10::double else floor(idx * (duration - 15) / 11 * 100 + 0.5) / 100 end as start from n, unnest(generate_series(0, n - 1)) t(idx))
select o_orderkey, idx, start, round(least(start + 15, duration), 2) as "end" from s""",
    "evaluation_windows": """with x as (select o_orderkey, floor(o_totalprice / 2000 * 100 + 0.5) / 100 as duration from orders) select o_orderkey, i * 10::double as start, i * 10::double + 15 as "end" from x, unnest(generate_series(0, floor((duration - 15) / 10)::int)) t(i) where duration >= 15""",
    "window_best_pick": """with g as (select l_orderkey as job, l_linenumber as window_idx, max((l_quantity, l_returnflag)) as m from lineitem group by all),
w as (select job, window_idx, m[1] as q, case when m[1] >= 48 then 'EXACT_MATCH' when m[2] = 'R' then 'NEAR_MATCH' when m[2] = 'A' then 'COVER_MATCH' else 'UNKNOWN' end as match_type from g),
s as (select *, min(case when match_type = 'EXACT_MATCH' then window_idx end) over (partition by job) as stop from w), v as (select *, q / 50 as score, case match_type when 'EXACT_MATCH' then 3 when 'COVER_MATCH' then 2 when 'NEAR_MATCH' then 1 else 0 end as k from s where stop is null or window_idx <= stop)
select job, window_idx, match_type, round(score, 6) as score, count(*) over (partition by job) as scanned from v qualify row_number() over (partition by job order by k > 0 desc, score desc, k desc, window_idx) = 1""",
    "interval_overlap_labels": """with x as (select l_orderkey, l_linenumber, l_quantity as s, l_quantity + 5 + l_linenumber as e from lineitem)
select a.l_orderkey as source, a.l_linenumber as q, b.l_linenumber as r, round(greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s), 6) as share
from x a join x b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.s < b.e and b.s < a.e where round(greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s), 6) >= 0.5""",
    "text_projections": """select p_partkey, p_name as name, p_size + 1950 as year, p_brand as composer, p_partkey::varchar as track,
case when p_size % 3 = 0 then p_brand when p_size % 2 = 0 then p_name || ' — ' || p_brand else 'file.mp3' end as label from part""",
}
