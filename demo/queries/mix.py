from __future__ import annotations

from pyspark.sql import functions as F

from bookdq.operators import deep_dive as dd
from bookdq.operators.mix import MixConfig, Thresholds, mix_findings, mix_measures, segment_mix
from demo.book import demo_book
from demo.registry import query

CFG = MixConfig(thresholds=Thresholds(large_share=0.05, material_share=0.005, z_target=0.9))


def _mix_cte(dims: str, where: str = "TRUE", z: float = 0.9) -> str:
    return f"""mix AS (SELECT *, CASE WHEN premium_share > 0.05 THEN 'large' WHEN premium_share >= 0.005 AND z_claims < {z} THEN 'thin' ELSE '' END AS flag FROM (
SELECT *, premium / SUM(premium) OVER () AS premium_share, CAST(records AS DOUBLE) / SUM(records) OVER () AS records_share, CAST(claims AS DOUBLE) / SUM(claims) OVER () AS claims_share,
SUM(premium) OVER (ORDER BY premium DESC, {dims} ROWS UNBOUNDED PRECEDING) / SUM(premium) OVER () AS cum_premium_share,
LEAST(1.0::DOUBLE, sqrt(CAST(claims AS DOUBLE) / 1082.0)) AS z_claims, LEAST(1.0::DOUBLE, sqrt(CAST(records AS DOUBLE) / 1082.0)) AS z_records FROM (
SELECT {dims}, COUNT(*) AS records, CAST(SUM(premium_amt) AS DOUBLE) AS premium, CAST(SUM(claim_cnt) AS BIGINT) AS claims FROM book WHERE {where} GROUP BY {dims})))"""


_COLUMNS = """records, premium, claims, ROUND(premium_share, 6) AS premium_share, ROUND(records_share, 6) AS records_share, ROUND(claims_share, 6) AS claims_share,
ROUND(cum_premium_share, 6) AS cum_premium_share, ROUND(z_claims, 6) AS z_claims, ROUND(z_records, 6) AS z_records, flag"""


@query("segment_mix", f"SELECT class_cd, 'class_cd=' || class_cd AS segment, {_COLUMNS} FROM mix", with_=_mix_cte("class_cd"))
def mix(spark, sf):
    return segment_mix(demo_book(spark, sf, "class_cd"), ["class_cd"], CFG)


@query("segment_mix_3d", f"SELECT src, coverage, pol_yr, 'src=' || src || '|coverage=' || coverage || '|pol_yr=' || CAST(pol_yr AS VARCHAR) AS segment, {_COLUMNS} FROM mix",
       with_=_mix_cte("src, coverage, pol_yr"))
def mix_3d(spark, sf):
    return segment_mix(demo_book(spark, sf, "coverage pol_yr"), ["src", "coverage", "pol_yr"], CFG)


@query("mix_measures", """SELECT COUNT(*) AS n_segments, ROUND(SUM(premium_share * premium_share), 6) AS hhi, COUNT(*) FILTER (cum_premium_share < 0.5) + 1 AS n_for_half,
'class_cd=' || arg_max(class_cd, premium) AS top_segment, ROUND(MAX(premium_share), 6) AS top_share,
ROUND(COALESCE(SUM(premium_share) FILTER (z_claims < 0.9), 0), 6) AS below, COUNT(*) FILTER (flag = 'thin') AS n_thin FROM mix""", with_=_mix_cte("class_cd"))
def measures(spark, sf):
    out = mix_measures(segment_mix(demo_book(spark, sf, "class_cd"), ["class_cd"], CFG), ["class_cd"], CFG.thresholds)
    return out.select("n_segments", "hhi", "n_for_half", F.col("top.segment").alias("top_segment"), F.col("top.premium_share").alias("top_share"), "below", "n_thin")


@query("mix_findings", """SELECT 'n_segments' AS metric, 'ALL' AS segment, CAST(COUNT(*) AS DOUBLE) AS value, 'info' AS status FROM mix
UNION ALL SELECT 'top_segment_share', 'class_cd=' || arg_max(class_cd, premium), ROUND(MAX(premium_share), 6), CASE WHEN MAX(premium_share) > 0.05 THEN 'warn' ELSE 'pass' END FROM mix
UNION ALL SELECT 'pct_premium_below_credibility', 'ALL', ROUND(COALESCE(SUM(premium_share) FILTER (z_claims < 0.9), 0), 6),
CASE WHEN COALESCE(SUM(premium_share) FILTER (z_claims < 0.9), 0) > 0.4 THEN 'fail' WHEN COALESCE(SUM(premium_share) FILTER (z_claims < 0.9), 0) > 0.2 THEN 'warn' ELSE 'pass' END FROM mix
UNION ALL SELECT 'n_thin_material_segments', 'ALL', COUNT(*) FILTER (flag = 'thin'), CASE WHEN COUNT(*) FILTER (flag = 'thin') > 0 THEN 'warn' ELSE 'pass' END FROM mix""", with_=_mix_cte("class_cd"))
def findings(spark, sf):
    found = mix_findings(segment_mix(demo_book(spark, sf, "class_cd"), ["class_cd"], CFG), ["class_cd"], CFG.thresholds)
    return found.select("metric", "segment", "value", "status")


# ---- deep dive -----------------------------------------------------------------------
SCOPE = dd.Scope("coverage = 'PROMO' AND location_id > 3", base="F", per=100.0)
NEED = "policy_no eff_date exp_date coverage location_id"
GRAIN = """scoped AS (SELECT *, CASE WHEN coverage = 'PROMO' AND location_id > 3 THEN 'this segment' ELSE 'rest of book' END AS scope FROM book),
p AS (SELECT scope, CAST(SUM(premium_amt) AS DOUBLE) AS premium, CAST(SUM(loss_amt) AS DOUBLE) AS loss, CAST(SUM(claim_cnt) AS DOUBLE) AS claims,
SUM(CASE WHEN expo_base = 'F' THEN expo_amt END) AS exposure FROM scoped GROUP BY policy_no, eff_date, exp_date, scope),
m AS (SELECT *, CASE WHEN premium > 0 THEN loss / premium END AS loss_ratio, CASE WHEN claims > 0 THEN loss / claims END AS severity, CASE WHEN exposure > 0 THEN claims / exposure * 100 END AS frequency FROM p),
long AS (SELECT scope, UNNEST(['premium', 'exposure', 'severity', 'frequency', 'loss', 'claims', 'loss_ratio']) AS metric, UNNEST([premium, exposure, severity, frequency, loss, claims, loss_ratio]) AS v FROM m)"""
_GRID = ", ".join(map(str, dd.GRID))
STATS = f"""stats AS (SELECT metric, scope, COUNT(*) AS n_policies, COUNT(v) AS n_nonnull, COUNT(*) FILTER (v > 0) AS n_positive, MIN(v) AS vmin, MAX(v) AS vmax, AVG(v) AS vmean, SUM(v) AS vsum,
quantile_cont(v, [{_GRID}]) AS pcts, quantile_cont(v, [{_GRID}]) FILTER (v > 0) AS pcts_pos FROM long GROUP BY metric, scope)"""
_LETTERS = [f"p{round(p * 100):02d}" for p in dd.GRID]


@query("policy_stats", f"""SELECT metric, scope, n_policies, n_nonnull, n_positive, ROUND(vmin, 6) AS vmin, ROUND(vmax, 6) AS vmax, ROUND(vmean, 6) AS vmean, ROUND(vsum, 2) AS vsum,
{", ".join(f"ROUND(pcts[{i + 1}], 6) AS {n}, ROUND(pcts_pos[{i + 1}], 6) AS pos_{n}" for i, n in enumerate(_LETTERS))} FROM stats""", with_=f"{GRAIN}, {STATS}")
def policy_stats(spark, sf):
    stats = dd.policy_stats(dd.stored_grain(demo_book(spark, sf, NEED), SCOPE))
    arrays = [c for i, n in enumerate(_LETTERS) for c in (F.col("pcts")[i].alias(n), F.col("pcts_pos")[i].alias(f"pos_{n}"))]
    return stats.select("metric", "scope", "n_policies", "n_nonnull", "n_positive", "vmin", "vmax", "vmean", F.round("vsum", 2).alias("vsum"), *arrays)


def _hist_sql(metrics: tuple[str, ...], grid: str, scale: str, inverse: str, bins: int, keep: str = "v IS NOT NULL") -> str:
    names = ", ".join(f"'{m}'" for m in metrics)
    return f"""SELECT metric, scope, bucket, n, ROUND(lo + bucket * w, 6) AS "left", ROUND(lo + bucket * w + w, 6) AS "right", ROUND(lo + bucket * w + w / 2, 6) AS center,
ROUND({inverse.format(v="(lo + bucket * w)")}, 4) AS "from", ROUND({inverse.format(v="(lo + bucket * w + w)")}, 4) AS "to", ROUND(CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY metric, scope), 6) AS share FROM (
SELECT l.metric, scope, CAST(LEAST(GREATEST(FLOOR((GREATEST(LEAST({scale.format(v="v")}, hi), lo) - lo) / w), 0), {bins - 1}) AS INTEGER) AS bucket, COUNT(*) AS n, lo, w
FROM long l JOIN (SELECT metric, lo, hi, (hi - lo) / {bins} AS w FROM (SELECT metric, {scale.format(v=f"MIN({grid}[1])")} AS lo, {scale.format(v=f"MAX({grid}[9])")} AS hi FROM stats
WHERE metric IN ({names}) GROUP BY metric)) b ON l.metric = b.metric WHERE {keep} GROUP BY ALL)"""


@query("policy_hist", _hist_sql(("premium", "severity", "loss_ratio"), "pcts", "{v}", "{v}", 20), with_=f"{GRAIN}, {STATS}")
def policy_hist(spark, sf):
    grain = dd.stored_grain(demo_book(spark, sf, NEED), SCOPE)
    out = dd.policy_histogram(grain, None, ("premium", "severity", "loss_ratio"), "none", 20)
    return out.withColumns({"from": F.round("from", 4), "to": F.round("to", 4)})


@query("policy_hist_log10", _hist_sql(("premium", "loss"), "pcts_pos", "log10({v})", "pow(10.0, {v})", 15, "v > 0"), with_=f"{GRAIN}, {STATS}")
def policy_hist_log10(spark, sf):
    grain = dd.stored_grain(demo_book(spark, sf, NEED), SCOPE)
    out = dd.policy_histogram(grain, None, ("premium", "loss"), "log10", 15)
    return out.withColumns({"from": F.round("from", 4), "to": F.round("to", 4)})


@query("policy_trend", """SELECT pol_yr, scope, premium, loss, claims, exposure, CASE WHEN premium > 0 THEN ROUND(loss / premium, 6) END AS loss_ratio,
CASE WHEN claims > 0 THEN ROUND(loss / claims, 6) END AS severity, CASE WHEN exposure > 0 THEN ROUND(claims / exposure * 100, 6) END AS frequency FROM (
SELECT pol_yr, scope, CAST(SUM(premium_amt) AS DOUBLE) AS premium, CAST(SUM(loss_amt) AS DOUBLE) AS loss, CAST(SUM(claim_cnt) AS DOUBLE) AS claims,
COALESCE(SUM(CASE WHEN expo_base = 'F' THEN expo_amt END), 0) AS exposure FROM scoped GROUP BY pol_yr, scope)""", with_=GRAIN)
def policy_trend(spark, sf):
    return dd.policy_trend(demo_book(spark, sf, NEED + " pol_yr"), SCOPE, "pol_yr")


@query("largest_policy_share", """SELECT MAX(loss) AS largest_loss, ROUND(SUM(loss), 4) AS segment_loss, ROUND(MAX(loss) / SUM(loss), 6) AS largest_share, MAX(loss) / SUM(loss) > 0.25 AS concentrated
FROM m WHERE scope = 'this segment'""", with_=GRAIN)
def largest_policy(spark, sf):
    out = dd.largest_policy_share(dd.policy_grain(demo_book(spark, sf, NEED), SCOPE))
    return out.withColumn("segment_loss", F.round("segment_loss", 4))


@query("segment_composition", f"SELECT src, 'src=' || src AS segment, {_COLUMNS}, premium_share > 0.8 AS dominant FROM mix", with_=_mix_cte("src", "coverage = 'PROMO' AND location_id > 3"))
def composition(spark, sf):
    return dd.composition(demo_book(spark, sf, "coverage location_id"), SCOPE, "src", CFG)


@query("credibility_gap", """SELECT claims, ROUND(LEAST(1.0::DOUBLE, sqrt(claims / 1082.0)), 6) AS z, ROUND(0.8 * 0.8 * 1082.0, 6)::DOUBLE AS claims_needed,
ROUND(GREATEST(0.8 * 0.8 * 1082.0 - claims, 0.0), 6)::DOUBLE AS claims_missing FROM (SELECT CAST(COALESCE(SUM(claim_cnt), 0) AS BIGINT) AS claims FROM book WHERE coverage = 'PROMO' AND location_id > 3)""")
def credibility_gap(spark, sf):
    return dd.credibility_gap(demo_book(spark, sf, "coverage location_id"), SCOPE, z_target=0.8)
