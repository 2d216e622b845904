from __future__ import annotations

from pyspark.sql import functions as F

from bookdq.functions.labels import distinct_list, label_of, natural_order, split_segments
from bookdq.functions.running import running_total
from bookdq.operators.filters import view_filter
from bookdq.operators.mix import segment_mix
from bookdq.operators.summary import crosstab, distinct_values, largest_series, summarize, sums_by
from demo.book import demo_book
from demo.registry import query

MEASURES = """COUNT(*) AS records, COUNT(DISTINCT ROW(policy_no, eff_date, exp_date)) AS policies,
CAST(SUM(premium_amt) AS DOUBLE) AS premium, CAST(SUM(loss_amt) AS DOUBLE) AS loss, CAST(SUM(claim_cnt) AS BIGINT) AS claims"""
RATIOS = """CASE WHEN policies > 0 THEN ROUND(premium / policies, 6) END AS premium_per_policy,
CASE WHEN policies > 0 THEN ROUND(records / policies, 6) END AS records_per_policy,
CASE WHEN premium > 0 THEN ROUND(loss / premium, 6) END AS loss_ratio,
CASE WHEN claims > 0 THEN ROUND(loss / claims, 6) END AS severity"""
KEY = "policy_no eff_date exp_date"


@query("summary_total", f"SELECT *, {RATIOS} FROM (SELECT {MEASURES} FROM book)")
def summary_total(spark, sf):
    return summarize(demo_book(spark, sf, KEY))


@query("summary_by_src", f"SELECT *, {RATIOS}, ROUND(premium / SUM(premium) OVER (), 6) AS premium_share "
                         f"FROM (SELECT src, {MEASURES} FROM book GROUP BY src)")
def summary_by_src(spark, sf):
    return summarize(demo_book(spark, sf, KEY), ["src"])


@query("summary_by_src_coverage", f"SELECT *, {RATIOS}, ROUND(premium / SUM(premium) OVER (), 6) AS premium_share "
                                  f"FROM (SELECT src, coverage, {MEASURES} FROM book GROUP BY src, coverage)")
def summary_by_src_coverage(spark, sf):
    return summarize(demo_book(spark, sf, f"{KEY} coverage"), ["src", "coverage"])


@query("summary_by_location_filtered",
       f"SELECT *, {RATIOS}, ROUND(premium / SUM(premium) OVER (), 6) AS premium_share FROM (SELECT location_id, {MEASURES} "
       "FROM book WHERE (location_id IN (2, 3) OR location_id IS NULL) AND segment_cd IN ('BUILDING', 'MACHINERY') GROUP BY location_id)")
def summary_by_location_filtered(spark, sf):
    book = demo_book(spark, sf, f"{KEY} location_id segment_cd")
    chosen = view_filter(book, {"location_id": ["2", "3", "<null>"], "segment_cd": ["BUILDING", "MACHINERY"], "src": []})
    return summarize(book, ["location_id"], chosen)


@query("sums_by_year", "SELECT pol_yr, CAST(SUM(premium_amt) AS DOUBLE) AS premium, SUM(expo_amt) AS exposure FROM book "
                       "WHERE expo_base = 'F' GROUP BY pol_yr")
def sums_by_year(spark, sf):
    df = demo_book(spark, sf, "pol_yr").population("expo_base = 'F'")
    return sums_by(df, ["pol_yr"], {"premium": F.col("premium_amt"), "exposure": F.col("expo_amt")}).withColumn(
        "premium", F.col("premium").cast("double"))


@query("summary_crosstab", """SELECT CASE WHEN GROUPING(coverage) = 1 THEN 'Total' ELSE coverage END AS coverage, CAST(SUM(premium_amt) FILTER (src = 'A') AS DOUBLE) AS "A",
CAST(SUM(premium_amt) FILTER (src = 'N') AS DOUBLE) AS "N", CAST(COALESCE(SUM(premium_amt) FILTER (src NOT IN ('A', 'N')), 0) AS DOUBLE) AS "(other)", CAST(SUM(premium_amt) AS DOUBLE) AS "(total)",
CAST(GROUPING(coverage) AS TINYINT) AS is_total FROM book GROUP BY ROLLUP (coverage)""")
def summary_crosstab(spark, sf):
    """One source is not named: it is summed apart, and the rows still add up."""
    return crosstab(demo_book(spark, sf, "coverage"), "coverage", "src", ["A", "N"])


@query("distinct_values", "SELECT DISTINCT COALESCE(CAST(location_id AS VARCHAR), '<null>') AS value FROM book")
def distinct_location(spark, sf):
    return distinct_values(demo_book(spark, sf, "location_id"), "location_id")


@query("distinct_values_first", "SELECT DISTINCT zip_cd AS value FROM book ORDER BY value LIMIT 20")
def distinct_zip(spark, sf):
    return distinct_values(demo_book(spark, sf, "zip_cd"), "zip_cd", limit=20)


@query("natural_segment_order", """SELECT label, n, CAST(ROW_NUMBER() OVER (ORDER BY CASE WHEN label = '<null>' THEN 2
WHEN TRY_CAST(label AS DOUBLE) IS NULL THEN 1 ELSE 0 END, TRY_CAST(label AS DOUBLE), label) AS BIGINT) AS position FROM (
SELECT label, COUNT(*) AS n FROM (SELECT COALESCE(CAST(CAST(deductible_amt AS BIGINT) AS VARCHAR), '<null>') AS label FROM book
UNION ALL SELECT coverage FROM book UNION ALL SELECT CAST(pol_yr AS VARCHAR) FROM book) GROUP BY label)""")
def natural_segment_order(spark, sf):
    df = demo_book(spark, sf, "deductible_amt coverage pol_yr").population()
    labels = df.select(F.explode(F.array(*[label_of(df, c) for c in ("deductible_amt", "coverage", "pol_yr")])).alias("label"))
    counted = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1).cast("bigint"))
    return running_total(counted, natural_order(F.col("label")), "_one", "position").drop("_one")


@query("split_segments", """SELECT src, CAST(pol_yr AS VARCHAR) AS pol_yr, COUNT(*) AS records FROM book GROUP BY ALL
UNION ALL SELECT src, '', COUNT(*) FROM book GROUP BY src UNION ALL SELECT '(all)', '(all)', COUNT(*) FROM book""")
def split_labels(spark, sf):
    from bookdq.functions.labels import segment_label
    df = demo_book(spark, sf, "pol_yr").population()
    grains = [df.groupBy(*dims).agg(F.count(F.lit(1)).alias("records")) for dims in (["src", "pol_yr"], ["src"], [])]
    labelled = [g.select(segment_label(g, [c for c in g.columns if c != "records"]).alias("segment"), "records") for g in grains]
    return split_segments(labelled[0].unionByName(labelled[1]).unionByName(labelled[2]))


@query("top_series", """SELECT b.class_cd, pol_yr, CAST(SUM(premium_amt) AS DOUBLE) AS premium FROM book b JOIN (SELECT class_cd
FROM book GROUP BY class_cd ORDER BY SUM(premium_amt) DESC, class_cd LIMIT 8) t ON b.class_cd = t.class_cd GROUP BY ALL""")
def top_series(spark, sf):
    df = demo_book(spark, sf, "class_cd pol_yr").population()
    series = df.groupBy("class_cd", "pol_yr").agg(F.sum("premium_amt").alias("premium"))
    kept, _ = largest_series(series, "class_cd", "premium", keep=8)
    return kept.withColumn("premium", F.col("premium").cast("double"))


@query("dropped_series", "SELECT class_cd FROM (SELECT class_cd, ROW_NUMBER() OVER (ORDER BY SUM(premium_amt) DESC, class_cd) AS r "
                         "FROM book GROUP BY class_cd) WHERE r > 8")
def dropped_series(spark, sf):
    df = demo_book(spark, sf, "class_cd").population()
    return largest_series(df.groupBy("class_cd").agg(F.sum("premium_amt").alias("premium")), "class_cd", "premium", keep=8)[1]


@query("mix_labels", """SELECT 'src=' || src || '|location_id=' || COALESCE(CAST(location_id AS VARCHAR), '<null>') AS segment,
COUNT(*) AS records FROM book GROUP BY src, location_id""")
def mix_labels(spark, sf):
    return segment_mix(demo_book(spark, sf, "location_id"), ["src", "location_id"]).select("segment", "records")


@query("distinct_list", "SELECT coverage, string_agg(src, ', ' ORDER BY src) AS sources FROM (SELECT DISTINCT coverage, src FROM book) GROUP BY coverage")
def sources_of_coverage(spark, sf):
    return demo_book(spark, sf, "coverage").population().groupBy("coverage").agg(distinct_list(F.col("src")).alias("sources"))
