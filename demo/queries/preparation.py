from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookdq.operators import keys, missing, rules
from bookdq.operators.binning import Binning, resolve
from bookdq.operators.filters import Rule, RuleSet
from bookdq.operators.targets import TargetConfig
from bookdq.operators.transforms import ColumnTransform, TransformSet, apply_transforms, transform_effect
from bookdq.plans.preprocessing import Step, agreed_steps, review_spec, run_pipeline
from demo.book import demo_book
from demo.registry import query
from demo.queries.tracker import STEP_LOG, state_of, steps_of



def rows() -> Column:
    return F.count(F.lit(1)).alias("n")


def _titled(x: str) -> str:
    """Title case of blank-separated words, ASCII."""
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"


# ---- transforms ----------------------------------------------------------------------
@query("transform_standardize", f"""SELECT zip_cd, segment_cd, tx_type, line_txt, COUNT(*) AS n FROM (
SELECT trim(upper(zip_cd)) AS zip_cd, {_titled("segment_cd")} AS segment_cd, lower(tx_type) AS tx_type, lpad(CAST(line_no AS VARCHAR), 3, '0') AS line_txt FROM book) GROUP BY ALL""")
def standardize(spark, sf):
    transforms = TransformSet((ColumnTransform("zip_cd", trim=True, case="upper"), ColumnTransform("segment_cd", case="title"),
                               ColumnTransform("tx_type", case="lower"), ColumnTransform("line_no", zero_pad=3)), applied=True)
    book = demo_book(spark, sf, "zip_cd segment_cd tx_type line_no", transforms=transforms)
    return book.population().withColumnRenamed("line_no", "line_txt").groupBy("zip_cd", "segment_cd", "tx_type", "line_txt").agg(rows())


@query("transform_pad_whole_values", """SELECT policy_txt, COUNT(*) AS n FROM (SELECT CASE WHEN length(CAST(policy_no AS VARCHAR)) >= 4 THEN CAST(policy_no AS VARCHAR)
ELSE lpad(CAST(policy_no AS VARCHAR), 4, '0') END AS policy_txt FROM book) GROUP BY policy_txt""")
def pad(spark, sf):
    """A value longer than the width stays whole."""
    df = demo_book(spark, sf, "policy_no").population()
    return apply_transforms(df, [ColumnTransform("policy_no", zero_pad=4)]).groupBy(F.col("policy_no").alias("policy_txt")).agg(rows())


MAPPING = {"PROMO": "Promotional", "SMALL": "Standard", "MEDIUM": "Standard", "LARGE": None}
_MAP_SQL = "CASE coverage WHEN 'PROMO' THEN 'Promotional' WHEN 'SMALL' THEN 'Standard' WHEN 'MEDIUM' THEN 'Standard' WHEN 'LARGE' THEN NULL ELSE {rest} END"


@query("transform_map_unmapped", " UNION ALL ".join(
    f"SELECT '{policy}' AS unmapped, coverage, COUNT(*) AS n FROM (SELECT {_MAP_SQL.format(rest=rest)} AS coverage FROM book) GROUP BY coverage"
    for policy, rest in (("keep", "coverage"), ("null", "NULL"), ("other", "'<other>'"))))
def map_unmapped(spark, sf):
    df = demo_book(spark, sf, "coverage").population()
    parts = [apply_transforms(df, [ColumnTransform("coverage", mapping=MAPPING, unmapped=u)]).groupBy(F.lit(u).alias("unmapped"), "coverage").agg(rows())
             for u in ("keep", "null", "other")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("transform_long_mapping", """SELECT CASE WHEN TRY_CAST(zip_cd AS INTEGER) BETWEEN 1 AND 150 THEN 'zone ' || CAST(TRY_CAST(zip_cd AS INTEGER) // 25 AS VARCHAR) ELSE '<other>' END AS zip_cd, COUNT(*) AS n
FROM book GROUP BY ALL""")
def long_mapping(spark, sf):
    """Above a hundred entries the mapping is joined as a table."""
    mapping = {f"{i:05d}": f"zone {i // 25}" for i in range(1, 151)}
    df = demo_book(spark, sf, "zip_cd").population()
    return apply_transforms(df, [ColumnTransform("zip_cd", trim=True, mapping=mapping, unmapped="other")]).groupBy("zip_cd").agg(rows())


@query("transform_preview", """SELECT COUNT(DISTINCT zip_cd) AS values_before, COUNT(DISTINCT after) AS values_after, COUNT(zip_cd) AS n_rows,
COUNT(*) FILTER (after IS DISTINCT FROM zip_cd) AS rows_changed FROM (SELECT zip_cd, CASE trim(zip_cd) WHEN 'UNK' THEN NULL WHEN '' THEN NULL WHEN '00007' THEN '00008' ELSE trim(zip_cd) END AS after FROM book)""")
def preview(spark, sf):
    t = ColumnTransform("zip_cd", trim=True, mapping={"UNK": None, "": None, "00007": "00008"})
    return transform_effect(demo_book(spark, sf, "zip_cd").population(), t)


@query("transform_cast", """SELECT zip_int, deductible_int, tax_txt, COUNT(*) AS n FROM (SELECT TRY_CAST(trim(zip_cd) AS BIGINT) AS zip_int, CAST(round_even(premium_amt / 1000, 0) AS BIGINT) AS deductible_int,
CAST(line_no AS VARCHAR) AS tax_txt FROM book) GROUP BY ALL""")
def cast(spark, sf):
    df = demo_book(spark, sf, "zip_cd line_no").population().select("zip_cd", (F.col("premium_amt") / 1000).cast("double").alias("deductible_int"), "line_no")
    out = apply_transforms(df, [ColumnTransform("zip_cd", trim=True, cast="int"), ColumnTransform("deductible_int", cast="int"), ColumnTransform("line_no", cast="string")])
    return out.groupBy(F.col("zip_cd").alias("zip_int"), "deductible_int", F.col("line_no").alias("tax_txt")).agg(rows())


@query("transform_then_filter", """SELECT coverage, COUNT(*) AS n FROM (SELECT CASE coverage WHEN 'PROMO' THEN 'P' ELSE coverage END AS coverage FROM book) WHERE coverage = 'P' GROUP BY coverage""")
def transform_then_filter(spark, sf):
    """Rules see the transformed values."""
    rules_ = RuleSet((Rule("promo", enabled=True, column="coverage", op="eq", values=("P",)),))
    book = demo_book(spark, sf, "coverage", rules_, TransformSet((ColumnTransform("coverage", mapping={"PROMO": "P"}),), applied=True))
    return book.population().groupBy("coverage").agg(rows())


# ---- pipeline steps ------------------------------------------------------------------
@query("prep_impute", """SELECT src, location_id, ded_missing, ROUND(ded, 6) AS ded, COUNT(*) AS n FROM (SELECT src, COALESCE(location_id, loc_mode) AS location_id, CASE WHEN deductible_amt IS NULL THEN 1 ELSE 0 END AS ded_missing,
COALESCE(deductible_amt, med) AS ded FROM book JOIN (SELECT coverage AS c, quantile_cont(deductible_amt, 0.5) AS med FROM book GROUP BY coverage) ON coverage = c,
(SELECT arg_min(location_id, (-n, location_id)) AS loc_mode FROM (SELECT location_id, COUNT(*) AS n FROM book WHERE location_id IS NOT NULL GROUP BY location_id))) GROUP BY ALL""")
def impute(spark, sf):
    df = demo_book(spark, sf, "location_id deductible_amt coverage").population()
    out = run_pipeline(df, [Step("deductible_amt", "impute", {"strategy": "median", "group_by": ["coverage"]}),
                            Step("location_id", "impute", {"strategy": "mode", "add_indicator": False})])
    return out.groupBy("src", "location_id", F.col("deductible_amt_missing").alias("ded_missing"), F.round("deductible_amt", 6).alias("ded")).agg(rows())


@query("prep_impute_mean_constant", """SELECT ROUND(a, 6) AS mean_filled, b AS zero_filled, c AS constant_filled, COUNT(*) AS n FROM (SELECT COALESCE(deductible_amt, (SELECT AVG(deductible_amt) FROM book WHERE src = 'A')) AS a,
COALESCE(location_id, 0) AS b, COALESCE(zip_cd, 'none') AS c, src FROM book WHERE src = 'A'
UNION ALL SELECT deductible_amt, COALESCE(location_id, 0), COALESCE(zip_cd, 'none'), src FROM book WHERE src <> 'A') GROUP BY ALL""")
def impute_mean(spark, sf):
    df = demo_book(spark, sf, "location_id deductible_amt zip_cd").population()
    plain = {"add_indicator": False}
    out = run_pipeline(df, [Step("deductible_amt", "impute", {"strategy": "mean", **plain}, sources=("A",)), Step("location_id", "impute", {"strategy": "zero", **plain}),
                            Step("zip_cd", "impute", {"strategy": "constant", "value": "none", **plain})], source="src")
    return out.groupBy(F.round("deductible_amt", 6).alias("mean_filled"), F.col("location_id").alias("zero_filled"), F.col("zip_cd").alias("constant_filled")).agg(rows())


@query("prep_map", """SELECT src, CASE WHEN src = 'A' AND coverage = 'PROMO' THEN NULL WHEN src = 'A' AND coverage = 'SMALL' THEN 'S' ELSE coverage END AS coverage, COUNT(*) AS n FROM book GROUP BY ALL""")
def map_step(spark, sf):
    df = demo_book(spark, sf, "coverage").population()
    return run_pipeline(df, [Step("coverage", "map_values", {"mapping": "PROMO=null, SMALL=S"}, sources=("A",))], source="src").groupBy("src", "coverage").agg(rows())


@query("prep_cap", """SELECT src, ROUND(SUM(LEAST(GREATEST(x, lo), hi)), 2) AS total, ROUND(MIN(LEAST(GREATEST(x, lo), hi)), 6) AS low, ROUND(MAX(LEAST(GREATEST(x, lo), hi)), 6) AS high FROM (SELECT src, CAST(premium_amt AS DOUBLE) AS x FROM book)
JOIN (SELECT src AS s, quantile_cont(CAST(premium_amt AS DOUBLE), 0.01) AS lo, quantile_cont(CAST(premium_amt AS DOUBLE), 0.95) AS hi FROM book GROUP BY src) ON s = src GROUP BY src""")
def cap(spark, sf):
    out = run_pipeline(demo_book(spark, sf).population(), [Step("premium_amt", "cap", {"lower_pct": 0.01, "upper_pct": 0.95, "by": ["src"]})])
    return out.groupBy("src").agg(F.round(F.sum("premium_amt"), 2).alias("total"), F.min("premium_amt").alias("low"), F.max("premium_amt").alias("high"))


@query("prep_cap_overall", """SELECT COUNT(*) FILTER (x > hi) AS n_capped, ROUND(MAX(LEAST(x, hi)), 6) AS high, ROUND(MIN(x), 6) AS low FROM (SELECT CAST(premium_amt AS DOUBLE) AS x FROM book),
(SELECT quantile_cont(CAST(premium_amt AS DOUBLE), 0.99) AS hi FROM book)""")
def cap_overall(spark, sf):
    df = demo_book(spark, sf).population().withColumn("before", F.col("premium_amt").cast("double"))
    out = run_pipeline(df, [Step("premium_amt", "cap", {})])
    return out.agg(F.count_if(F.col("before") > F.col("premium_amt")).alias("n_capped"), F.max("premium_amt").alias("high"), F.min("premium_amt").alias("low"))


@query("prep_scale_fix", "SELECT src, pol_yr, ROUND(SUM(CASE WHEN src = 'N' AND pol_yr = 1998 THEN x * 0.01 ELSE x END), 2) AS total FROM (SELECT src, pol_yr, CAST(premium_amt AS DOUBLE) AS x FROM book) GROUP BY ALL")
def scale_fix(spark, sf):
    out = run_pipeline(demo_book(spark, sf, "pol_yr").population(), [Step("premium_amt", "scale_fix", {"multiply_by": 0.01, "condition": "src = 'N' AND pol_yr = 1998"})])
    return out.groupBy("src", "pol_yr").agg(F.round(F.sum("premium_amt"), 2).alias("total"))


@query("prep_log", """SELECT src, ROUND(SUM(sign(x) * ln(1 + abs(x))), 4) AS signed, ROUND(SUM(CASE WHEN l > 0 THEN log10(l) END), 4) AS logged, COUNT(*) FILTER (l > 0) AS n_logged,
ROUND(SUM(ln(1 + e)), 4) AS log1p FROM (SELECT src, CAST(premium_amt AS DOUBLE) AS x, CAST(loss_amt AS DOUBLE) AS l, expo_amt AS e FROM book) GROUP BY src""")
def log(spark, sf):
    out = run_pipeline(demo_book(spark, sf).population(), [Step("premium_amt", "log_transform", {"method": "signed_log"}), Step("loss_amt", "log_transform", {"method": "log10"}),
                                                           Step("expo_amt", "log_transform")])
    return out.groupBy("src").agg(F.round(F.sum("premium_amt"), 4).alias("signed"), F.round(F.sum("loss_amt"), 4).alias("logged"), F.count("loss_amt").alias("n_logged"),
                                  F.round(F.sum("expo_amt"), 4).alias("log1p"))


@query("prep_group_rare", """SELECT COALESCE(kept, 'RARE') AS class_cd, COUNT(*) AS n FROM book LEFT JOIN (SELECT class_cd AS kept FROM book GROUP BY class_cd HAVING CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM book) >= 0.04) ON class_cd = kept GROUP BY ALL""")
def group_rare(spark, sf):
    out = run_pipeline(demo_book(spark, sf, "class_cd").population(), [Step("class_cd", "group_rare", {"min_share": 0.04, "other_label": "RARE"})])
    return out.groupBy("class_cd").agg(rows())


@query("prep_bin", """SELECT CASE WHEN deductible_amt IS NULL THEN '<null>' WHEN deductible_amt < 750 THEN '01. < 750' WHEN deductible_amt < 1500 THEN '02. 750 to 1.5K' ELSE '03. >= 1.5K' END AS deductible_amt,
CASE WHEN expo_amt < q[1] THEN '01' WHEN expo_amt < q[2] THEN '02' WHEN expo_amt < q[3] THEN '03' ELSE '04' END AS expo_bin, COUNT(*) AS n FROM book, (SELECT quantile_cont(expo_amt, [0.25, 0.5, 0.75]) AS q FROM book) GROUP BY ALL""")
def bin_step(spark, sf):
    out = run_pipeline(demo_book(spark, sf, "deductible_amt").population(), [Step("deductible_amt", "bin", {"method": "fixed_edges", "edges": [750, 1500]}), Step("expo_amt", "bin", {"n_bins": 4})])
    return out.groupBy("deductible_amt", F.substring("expo_amt", 1, 2).alias("expo_bin")).agg(rows())


@query("prep_exclude", "SELECT src, COUNT(*) AS n FROM book WHERE NOT COALESCE(location_id > 5, FALSE) AND NOT (src = 'R' AND expo_amt <= 10) GROUP BY src")
def exclude(spark, sf):
    df = demo_book(spark, sf, "location_id").population()
    return run_pipeline(df, [Step("location_id", "exclude_rows", {"condition": "location_id > 5"}), Step("expo_amt", "exclude_rows", {"condition": "expo_amt <= 10"}, sources=("R",))], source="src").groupBy("src").agg(rows())


@query("prep_derive", "SELECT src, ROUND(SUM(rate), 4) AS rate, COUNT(rate) AS n FROM (SELECT src, CASE WHEN src IN ('A', 'N') THEN CAST(premium_amt AS DOUBLE) / NULLIF(expo_amt, 0) END AS rate FROM book) GROUP BY src")
def derive(spark, sf):
    step = Step("premium_amt", "derive", {"new_column": "rate", "expression": "CAST(premium_amt AS DOUBLE) / NULLIF(expo_amt, 0)"}, sources=("A", "N"))
    return run_pipeline(demo_book(spark, sf).population(), [step], source="src").groupBy("src").agg(F.round(F.sum("rate"), 4).alias("rate"), F.count("rate").alias("n"))


@query("prep_whole", """SELECT coverage, ROUND(SUM(ln(1 + LEAST(d, hi))), 4) AS logged, COUNT(*) AS n FROM (SELECT CASE coverage WHEN 'PROMO' THEN 'P' ELSE coverage END AS coverage, COALESCE(deductible_amt, med) AS d, hi FROM book,
(SELECT quantile_cont(deductible_amt, 0.5) AS med FROM book WHERE line_no < 7),
(SELECT quantile_cont(COALESCE(deductible_amt, (SELECT quantile_cont(deductible_amt, 0.5) FROM book WHERE line_no < 7)), 0.9) AS hi FROM book WHERE line_no < 7) WHERE line_no < 7) GROUP BY coverage""")
def whole(spark, sf):
    """Steps of several columns in the fixed order, given in another: excluded rows count for no statistic."""
    df = demo_book(spark, sf, "coverage deductible_amt line_no").population()
    out = run_pipeline(df, [Step("deductible_amt", "log_transform"), Step("deductible_amt", "cap", {"upper_pct": 0.9}), Step("deductible_amt", "impute"),
                            Step("line_no", "exclude_rows", {"condition": "line_no >= 7"}), Step("coverage", "map_values", {"mapping": {"PROMO": "P"}})])
    return out.groupBy("coverage").agg(F.round(F.sum("deductible_amt"), 4).alias("logged"), rows())


@query("prep_many", """SELECT src, COALESCE(kept, 'RARE') AS class_cd, CASE WHEN expo_amt < q[1] THEN '01' WHEN expo_amt < q[2] THEN '02' WHEN expo_amt < q[3] THEN '03' ELSE '04' END AS expo_bin,
ROUND(SUM(LEAST(COALESCE(deductible_amt, med), ded_hi)), 4) AS deductible, ROUND(SUM(LEAST(GREATEST(prem, lo), hi)), 4) AS premium, ROUND(SUM(LEAST(loss, loss_hi)), 4) AS loss, SUM(COALESCE(location_id, loc_mode)) AS locations, COUNT(*) AS n
FROM (SELECT *, CAST(premium_amt AS DOUBLE) AS prem, CAST(loss_amt AS DOUBLE) AS loss FROM book)
JOIN (SELECT coverage AS c, quantile_cont(deductible_amt, 0.5) AS med FROM book GROUP BY coverage) ON coverage = c
JOIN (SELECT src AS s2, quantile_cont(COALESCE(deductible_amt, med), 0.9) AS ded_hi FROM book JOIN (SELECT coverage AS c, quantile_cont(deductible_amt, 0.5) AS med FROM book GROUP BY coverage) ON coverage = c GROUP BY src) ON s2 = src
JOIN (SELECT src AS s, quantile_cont(CAST(premium_amt AS DOUBLE), 0.01) AS lo, quantile_cont(CAST(premium_amt AS DOUBLE), 0.95) AS hi FROM book GROUP BY src) ON s = src
LEFT JOIN (SELECT class_cd AS kept FROM book GROUP BY class_cd HAVING CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM book) >= 0.04) ON class_cd = kept,
(SELECT quantile_cont(CAST(loss_amt AS DOUBLE), 0.98) AS loss_hi, quantile_cont(expo_amt, [0.25, 0.5, 0.75]) AS q FROM book),
(SELECT arg_min(location_id, (-n, location_id)) AS loc_mode FROM (SELECT location_id, COUNT(*) AS n FROM book WHERE location_id IS NOT NULL GROUP BY location_id)) GROUP BY ALL""")
def many(spark, sf):
    """Seven statistics of six columns in two ranks: one copy of the columns for all of them, and one pass over the book for the result."""
    df = demo_book(spark, sf, "location_id deductible_amt coverage class_cd").population()
    out = run_pipeline(df, [Step("deductible_amt", "impute", {"group_by": ["coverage"], "add_indicator": False}), Step("location_id", "impute", {"strategy": "mode", "add_indicator": False}),
                            Step("deductible_amt", "cap", {"upper_pct": 0.9, "by": ["src"]}), Step("premium_amt", "cap", {"lower_pct": 0.01, "upper_pct": 0.95, "by": ["src"]}),
                            Step("loss_amt", "cap", {"upper_pct": 0.98}), Step("class_cd", "group_rare", {"min_share": 0.04, "other_label": "RARE"}), Step("expo_amt", "bin", {"n_bins": 4})])
    return out.groupBy("src", "class_cd", F.substring("expo_amt", 1, 2).alias("expo_bin")).agg(F.round(F.sum("deductible_amt"), 4).alias("deductible"), F.round(F.sum("premium_amt"), 4).alias("premium"),
                                                                                               F.round(F.sum("loss_amt"), 4).alias("loss"), F.sum("location_id").alias("locations"), rows())


# ---- specifications ------------------------------------------------------------------
@query("agreed_steps", """SELECT "column", op, COUNT(*) AS n, MIN(position) AS first, MAX(position) AS last FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY rank_no) AS position FROM (
SELECT variable AS "column", op, 9 AS rank_no FROM steps JOIN (SELECT variable, arg_max(value, ("at", event_id)) AS status FROM log WHERE field = 'status' GROUP BY variable) s USING (variable) WHERE status = 'preprocess_in_modeling'
UNION ALL SELECT 'premium_amt', 'bin', 12 UNION ALL SELECT 'zip_cd', UNNEST(['trim', 'zero_pad', 'map_values']), UNNEST([1, 3, 4]))) GROUP BY ALL""", book=False, with_=STEP_LOG)
def spec(spark, sf):
    """The handover: transforms, bins cut at the book's own quartiles, and reviewed steps, per column in order."""
    transforms = TransformSet((ColumnTransform("zip_cd", trim=True, zero_pad=5, mapping={"UNK": None}, description="agreed spelling"),))
    book = demo_book(spark, sf, "zip_cd deductible_amt coverage", transforms=transforms)
    bins = [resolve(book, Binning("premium_amt", "quarters", "quantile", bins=4))]
    reviewed = steps_of(spark, sf).join(state_of(spark, sf).select("variable", "status"), "variable")
    steps = agreed_steps(book, bins, reviewed)
    return steps.groupBy("column", "op").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.max("position").alias("last"))


@query("review_spec", """SELECT variable, status, CAST(ROW_NUMBER() OVER (PARTITION BY variable ORDER BY added_at, op) AS BIGINT) AS step_no, op, params, sources, rationale, author FROM steps JOIN (
SELECT variable, arg_max(value, ("at", event_id)) AS status FROM log WHERE field = 'status' GROUP BY variable) s USING (variable) WHERE status = 'preprocess_in_modeling'""", book=False, with_=STEP_LOG)
def review(spark, sf):
    return review_spec(steps_of(spark, sf), state_of(spark, sf)).drop("added_at")


