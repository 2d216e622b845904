from __future__ import annotations

from pyspark.sql import functions as F

from bookdq.functions.labels import level_label
from bookdq.operators import keys, missing, rules, values
from demo.book import DOCS_SQL, demo_book, docs_book
from demo.registry import query

# ---- keys ----------------------------------------------------------------------------
KEYS = {"A": ("policy_no", "line_no"), "N": ("policy_no", "line_no", "exp_date"), "_all": ("src", "policy_no", "line_no", "location_id")}


def _key_sql(source: str, key: tuple[str, ...]) -> str:
    where = "" if source == "_all" else f"WHERE src = '{source}'"
    nulls = " || ', ' || ".join(f"CASE WHEN SUM(CASE WHEN {k} IS NULL THEN n ELSE 0 END) > 0 THEN '{k} (' || format('{{:,}}', "
                                f"CAST(SUM(CASE WHEN {k} IS NULL THEN n ELSE 0 END) AS BIGINT)) || ')' ELSE '' END" for k in key)
    return f"""SELECT '{source}' AS source, '{", ".join(key)}' AS key, CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) AS n_distinct_keys,
CAST(COALESCE(SUM(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS n_dup_rows, COUNT(*) FILTER (n > 1) AS n_dup_groups,
ROUND(CAST(COALESCE(SUM(CASE WHEN n > 1 THEN n END), 0) AS DOUBLE) / SUM(n), 6) AS dup_rate, MAX(n) AS max_rows_per_key,
CASE WHEN SUM(CASE WHEN n > 1 THEN n ELSE 0 END) / SUM(n) > 0.001 THEN 'fail' WHEN SUM(CASE WHEN n > 1 THEN n ELSE 0 END) > 0 THEN 'warn' ELSE 'pass' END AS status,
COALESCE(NULLIF(trim({nulls}, ', '), ''), 'none') AS key_cols_with_nulls
FROM (SELECT {", ".join(key)}, COUNT(*) AS n FROM book {where} GROUP BY {", ".join(key)})"""


@query("key_uniqueness", " UNION ALL ".join(_key_sql(s, k) for s, k in KEYS.items()))
def key_uniqueness(spark, sf):
    book = demo_book(spark, sf, "policy_no line_no exp_date location_id")
    return keys.run(book, keys.KeyConfig(candidate_keys=KEYS)).tables["summary"]


@query("key_findings", f"""SELECT '_key' AS variable, key AS item, CASE WHEN source = '_all' THEN 'ALL' ELSE 'src=' || source END AS segment,
'dup_rate' AS metric, dup_rate AS value, status FROM ({" UNION ALL ".join(_key_sql(s, k) for s, k in KEYS.items())})
UNION ALL SELECT 'location_id', 'key column', 'ALL', 'key_null_rows', COUNT(*), 'info' FROM book WHERE location_id IS NULL HAVING COUNT(*) > 0""")
def key_findings(spark, sf):
    book = demo_book(spark, sf, "policy_no line_no exp_date location_id")
    return keys.run(book, keys.KeyConfig(candidate_keys=KEYS)).findings.select("variable", "item", "segment", "metric", "value", "status")


@query("key_duplicates_topk", "SELECT policy_no, line_no, COUNT(*) AS n_rows FROM book WHERE src = 'A' GROUP BY policy_no, line_no "
                              "HAVING COUNT(*) > 1 ORDER BY n_rows DESC, policy_no, line_no LIMIT 50")
def key_duplicates(spark, sf):
    return keys.duplicate_sample(demo_book(spark, sf, "policy_no line_no"), "A", ["policy_no", "line_no"])


CANDIDATES = ("policy_no", "line_no", "exp_date", "class_cd")
_MASKS = range(1, 1 << len(CANDIDATES))


def _mask_key(mask: int) -> str:
    return ", ".join(c for i, c in enumerate(CANDIDATES) if mask >> i & 1)


@query("key_suggest", f"""SELECT step, added, key, distinct_keys, n_rows, ROUND(CAST(distinct_keys AS DOUBLE) / n_rows, 6) AS coverage, distinct_keys = n_rows AS is_unique FROM walk WHERE step > 0""",
       with_=f"""counts AS (SELECT mask, d, (SELECT COUNT(*) FROM book) AS n FROM ({" UNION ALL ".join(
           f"SELECT {m} AS mask, COUNT(DISTINCT ROW({_mask_key(m)})) AS d FROM book" for m in _MASKS)})),
cols AS (SELECT UNNEST({list(CANDIDATES)}) AS c, UNNEST([{", ".join(str(1 << i) for i in range(len(CANDIDATES)))}]) AS bit),
s1 AS (SELECT c, bit AS mask, d, n FROM cols JOIN counts ON mask = bit ORDER BY d DESC, bit LIMIT 1),
s2 AS (SELECT cols.c, bit + s1.mask AS mask, counts.d, counts.n FROM s1 JOIN cols ON bit & s1.mask = 0 JOIN counts ON counts.mask = bit + s1.mask WHERE s1.d < s1.n ORDER BY counts.d DESC, bit LIMIT 1),
s3 AS (SELECT cols.c, bit + s2.mask AS mask, counts.d, counts.n FROM s2 JOIN cols ON bit & s2.mask = 0 JOIN counts ON counts.mask = bit + s2.mask WHERE s2.d < s2.n ORDER BY counts.d DESC, bit LIMIT 1),
s4 AS (SELECT cols.c, bit + s3.mask AS mask, counts.d, counts.n FROM s3 JOIN cols ON bit & s3.mask = 0 JOIN counts ON counts.mask = bit + s3.mask WHERE s3.d < s3.n ORDER BY counts.d DESC, bit LIMIT 1),
walk AS (SELECT 1 AS step, c AS added, c AS key, d AS distinct_keys, n AS n_rows FROM s1
UNION ALL SELECT 2, s2.c, s1.c || ', ' || s2.c, s2.d, s2.n FROM s1, s2 UNION ALL SELECT 3, s3.c, s1.c || ', ' || s2.c || ', ' || s3.c, s3.d, s3.n FROM s1, s2, s3
UNION ALL SELECT 4, s4.c, s1.c || ', ' || s2.c || ', ' || s3.c || ', ' || s4.c, s4.d, s4.n FROM s1, s2, s3, s4)""")
def key_suggest(spark, sf):
    return keys.suggest_key(demo_book(spark, sf, " ".join(CANDIDATES)), "_all", CANDIDATES)


# ---- missing and rules ---------------------------------------------------------------
GRADE = "CASE WHEN {v} > {fail} THEN 'fail' WHEN {v} > {warn} THEN 'warn' ELSE 'pass' END"


@query("missing_rate", f"""SELECT variable, segment, n_missing, n_applicable, ROUND(CAST(n_missing AS DOUBLE) / n_applicable, 6) AS missing_rate,
{GRADE.format(v="CAST(n_missing AS DOUBLE) / n_applicable", warn="0.05", fail="0.2")} AS status FROM (
SELECT 'lang' AS variable, 'src=' || src AS segment, COUNT(*) FILTER (lang IS NULL OR trim(lang) IN ('', 'xx')) AS n_missing, COUNT(*) AS n_applicable FROM docs GROUP BY src
UNION ALL SELECT 'quality', 'src=' || src || '|lang=' || lang, COUNT(*) FILTER (quality IS NULL), COUNT(*) FROM docs GROUP BY src, lang
UNION ALL SELECT 'toxic', 'src=' || src, COUNT(*) FILTER (quality IS NOT NULL AND (toxic IS NULL OR toxic = 1)), COUNT(*) FILTER (quality IS NOT NULL) FROM docs GROUP BY src
UNION ALL SELECT 'n_chars', 'src=' || src, COUNT(*) FILTER (n_chars IS NULL), COUNT(*) FROM docs GROUP BY src) WHERE n_applicable > 0""", book=False, with_=DOCS_SQL)
def missing_rate(spark, sf):
    cfg = missing.MissingConfig(
        include=("lang", "quality", "toxic", "n_chars"),
        variables={"lang": missing.MissingRule(treat_as_missing=("xx",)), "quality": missing.MissingRule(group_by=("src", "lang")),
                   "toxic": missing.MissingRule(treat_as_missing=("1",), applies_when="quality IS NOT NULL")})
    parts = [df.select("variable", "segment", "n_missing", "n_applicable", "missing_rate", "status")
             for _, df in missing.missing_rates(docs_book(spark, sf), cfg)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


BOOK_MISSING = missing.MissingConfig(
    include=("zip_cd", "location_id", "deductible_amt", "class_cd"),
    variables={"zip_cd": missing.MissingRule(treat_as_missing=("UNK",), warn=0.01, fail=0.05),
               "location_id": missing.MissingRule(applies_when="src <> 'R'"), "deductible_amt": missing.MissingRule(group_by=())})


@query("missing_rate_book", f"""SELECT variable, segment, n_missing, n_applicable, ROUND(CAST(n_missing AS DOUBLE) / n_applicable, 6) AS missing_rate,
{GRADE.format(v="CAST(n_missing AS DOUBLE) / n_applicable", warn="warn", fail="fail")} AS status FROM (
SELECT 'zip_cd' AS variable, 'src=' || src AS segment, COUNT(*) FILTER (zip_cd IS NULL OR trim(zip_cd) IN ('', 'UNK')) AS n_missing, COUNT(*) AS n_applicable, 0.01 AS warn, 0.05 AS fail FROM book GROUP BY src
UNION ALL SELECT 'location_id', 'src=' || src, COUNT(*) FILTER (src <> 'R' AND location_id IS NULL), COUNT(*) FILTER (src <> 'R'), 0.05, 0.2 FROM book GROUP BY src
UNION ALL SELECT 'class_cd', 'src=' || src, COUNT(*) FILTER (class_cd IS NULL OR trim(class_cd) = ''), COUNT(*), 0.05, 0.2 FROM book GROUP BY src
UNION ALL SELECT 'deductible_amt', 'ALL', COUNT(*) FILTER (deductible_amt IS NULL), COUNT(*), 0.05, 0.2 FROM book) WHERE n_applicable > 0""")
def missing_rate_book(spark, sf):
    book = demo_book(spark, sf, "zip_cd location_id deductible_amt class_cd")
    found = missing.run(book, BOOK_MISSING)
    parts = [t.select("variable", "segment", "n_missing", "n_applicable", "missing_rate", "status") for t in found.tables.values()]
    return parts[0].unionByName(parts[1])


@query("missing_matrix", """SELECT segment, ROUND(MAX(r) FILTER (v = 'class_cd'), 6) AS class_cd, ROUND(MAX(r) FILTER (v = 'zip_cd'), 6) AS zip_cd FROM (
SELECT 'src=' || src AS segment, 'class_cd' AS v, CAST(COUNT(*) FILTER (class_cd IS NULL OR trim(class_cd) = '') AS DOUBLE) / COUNT(*) AS r FROM book GROUP BY src
UNION ALL SELECT 'src=' || src, 'zip_cd', CAST(COUNT(*) FILTER (zip_cd IS NULL OR trim(zip_cd) IN ('', 'UNK')) AS DOUBLE) / COUNT(*) FROM book GROUP BY src) GROUP BY segment""")
def missing_matrix(spark, sf):
    cfg = missing.MissingConfig(include=("zip_cd", "class_cd"), variables=BOOK_MISSING.variables)
    ((_, detail),) = missing.missing_rates(demo_book(spark, sf, "zip_cd class_cd"), cfg)
    return missing.missing_matrix(detail, ["class_cd", "zip_cd"])


RULES = rules.RulesConfig(group_by=("src",), rules=(
    rules.BusinessRule("exp_after_eff", "exp_date < eff_date", variables=("exp_date", "eff_date"), fail=0.0005),
    rules.BusinessRule("loss_without_claim", "coalesce(claim_cnt, 0) = 0", "loss_amt > 0", ("loss_amt", "claim_cnt")),
    rules.BusinessRule("deductible_of_first_line", "deductible_amt > 1500", "line_no = 1", ("deductible_amt",), warn=0.3, fail=0.5),
    rules.BusinessRule("placed", "location_id > 6", "src <> 'R'"),
    rules.BusinessRule("negative_premium", "premium_amt < 0", variables=("premium_amt",), warn=0.001, fail=0.5),
    rules.BusinessRule("late_start", "eff_date >= DATE '2000-01-01'", variables=("eff_date",), fail=0.9),
    rules.BusinessRule("early_start", "eff_date < DATE '1997-01-01'", variables=("eff_date",), warn=0.4, fail=0.9)))
RULES_NEED = "exp_date eff_date line_no deductible_amt location_id"


RULES_CTE = f"""violations AS (SELECT *, {GRADE.format(v="CAST(n_violations AS DOUBLE) / n_applicable", warn="warn", fail="fail")} AS status,
CAST(n_violations AS DOUBLE) / n_applicable AS violation_rate, 'src=' || src AS segment FROM (
SELECT 'exp_after_eff' AS rule, 'exp_date' AS variable, src, COUNT(*) AS n_applicable, COUNT(*) FILTER (exp_date < eff_date) AS n_violations, 0.0 AS warn, 0.0005 AS fail FROM book GROUP BY src
UNION ALL SELECT 'loss_without_claim', 'loss_amt', src, COUNT(*) FILTER (loss_amt > 0), COUNT(*) FILTER (loss_amt > 0 AND COALESCE(claim_cnt, 0) = 0), 0.0, 0.001 FROM book GROUP BY src
UNION ALL SELECT 'deductible_of_first_line', 'deductible_amt', src, COUNT(*) FILTER (line_no = 1), COUNT(*) FILTER (line_no = 1 AND deductible_amt > 1500), 0.3, 0.5 FROM book GROUP BY src
UNION ALL SELECT 'placed', 'placed', src, COUNT(*) FILTER (src <> 'R'), COUNT(*) FILTER (src <> 'R' AND location_id > 6), 0.0, 0.001 FROM book GROUP BY src
UNION ALL SELECT 'negative_premium', 'premium_amt', src, COUNT(*), COUNT(*) FILTER (premium_amt < 0), 0.001, 0.5 FROM book GROUP BY src
UNION ALL SELECT 'late_start', 'eff_date', src, COUNT(*), COUNT(*) FILTER (eff_date >= DATE '2000-01-01'), 0.0, 0.9 FROM book GROUP BY src
UNION ALL SELECT 'early_start', 'eff_date', src, COUNT(*), COUNT(*) FILTER (eff_date < DATE '1997-01-01'), 0.4, 0.9 FROM book GROUP BY src) WHERE n_applicable > 0)"""


@query("business_rules", "SELECT rule, variable, segment, n_applicable, n_violations, ROUND(violation_rate, 6) AS violation_rate, status FROM violations", with_=RULES_CTE)
def business_rules(spark, sf):
    return rules.rule_violations(demo_book(spark, sf, RULES_NEED), RULES).select(
        "rule", "variable", "segment", "n_applicable", "n_violations", "violation_rate", "status")


@query("rule_matrix", """SELECT rule, ROUND(MAX(violation_rate) FILTER (src = 'A'), 6) AS "src=A", ROUND(MAX(violation_rate) FILTER (src = 'N'), 6) AS "src=N",
ROUND(MAX(violation_rate) FILTER (src = 'R'), 6) AS "src=R" FROM violations GROUP BY rule""", with_=RULES_CTE)
def rule_matrix(spark, sf):
    detail = rules.rule_violations(demo_book(spark, sf, RULES_NEED), RULES)
    return rules.violation_matrix(detail, ["src=A", "src=N", "src=R"])


# ---- values --------------------------------------------------------------------------
@query("value_matrix", """SELECT class_cd AS value, COUNT(*) FILTER (src = 'A') AS "A", COUNT(*) FILTER (src = 'N') AS "N", COUNT(*) FILTER (src NOT IN ('A', 'N')) AS "(other sources)"
FROM book WHERE class_cd IS NOT NULL GROUP BY class_cd""")
def value_matrix(spark, sf):
    """One source is not named: its rows are counted all the same."""
    return values.value_matrix(demo_book(spark, sf, "class_cd"), "class_cd", ["A", "N"])


VC = "vc AS (SELECT class_cd AS value, src, COUNT(*) AS n FROM book WHERE class_cd IS NOT NULL GROUP BY ALL)"


@query("value_share_matrix", "SELECT value, src, n, ROUND(CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY src), 6) AS share, "
                             "COUNT(*) OVER (PARTITION BY value) AS used_by FROM vc", with_=VC)
def value_shares(spark, sf):
    return values.value_shares(demo_book(spark, sf, "class_cd"), "class_cd")


@query("used_by_one_source", "SELECT value, MIN(src) AS src, CAST(SUM(n) AS BIGINT) AS n_rows FROM vc GROUP BY value HAVING COUNT(*) = 1", with_=VC)
def used_by_one(spark, sf):
    return values.used_by_one(demo_book(spark, sf, "class_cd"), "class_cd")


@query("source_unique_values", """SELECT src, COUNT(*) FILTER (k = 1) AS source_unique_values, CAST(COALESCE(SUM(n) FILTER (k = 1), 0) AS BIGINT) AS n_rows_unique,
CAST(SUM(n) AS BIGINT) AS n_rows, ROUND(COALESCE(SUM(n) FILTER (k = 1), 0) / SUM(n), 6) AS pct_rows_source_unique,
COALESCE(string_agg(value, ', ' ORDER BY value) FILTER (k = 1), '') AS first_values FROM (SELECT *, COUNT(*) OVER (PARTITION BY value) AS k FROM vc) GROUP BY src""", with_=VC)
def source_unique(spark, sf):
    return values.source_unique(demo_book(spark, sf, "class_cd"), "class_cd")


@query("numeric_plausibility", """SELECT src, COUNT(*) AS n_rows, COUNT(deductible_amt) AS n_nonnull, COUNT(*) FILTER (deductible_amt < 0) AS n_negative,
COUNT(*) FILTER (deductible_amt = 0) AS n_zero, COUNT(*) FILTER (deductible_amt < 500) AS n_below, COUNT(*) FILTER (deductible_amt > 1750) AS n_above,
MIN(deductible_amt) AS min, MAX(deductible_amt) AS max, ROUND(CAST(COUNT(*) FILTER (deductible_amt < 500 OR deductible_amt > 1750) AS DOUBLE) / COUNT(deductible_amt), 6) AS pct_out_of_bounds,
0.0::DOUBLE AS pct_negative, 0.0::DOUBLE AS pct_zero FROM book GROUP BY src""")
def numeric_plausibility(spark, sf):
    return values.numeric_plausibility(demo_book(spark, sf, "deductible_amt"), "deductible_amt", values.NumericRule(min=500, max=1750))


@query("numeric_signs", """SELECT src, ROUND(CAST(COUNT(*) FILTER (premium_amt < 0) AS DOUBLE) / COUNT(premium_amt), 6) AS pct_negative,
ROUND(CAST(COUNT(*) FILTER (loss_amt = 0) AS DOUBLE) / COUNT(loss_amt), 6) AS pct_zero FROM book GROUP BY src""")
def numeric_signs(spark, sf):
    book = demo_book(spark, sf)
    negative = values.numeric_plausibility(book, "premium_amt").select("src", "pct_negative")
    return negative.join(values.numeric_plausibility(book, "loss_amt").select("src", "pct_zero"), "src")


@query("top_value_share", """SELECT src, top_value, n_top, n_values, ROUND(CAST(n_top AS DOUBLE) / n_values, 6) AS top_value_share FROM (
SELECT src, CAST(SUM(n) AS BIGINT) AS n_values, MAX(n) AS n_top, arg_min(value, (-n, value)) AS top_value FROM (
SELECT src, CAST(CAST(deductible_amt AS BIGINT) AS VARCHAR) AS value, COUNT(*) AS n FROM book WHERE deductible_amt IS NOT NULL GROUP BY ALL) GROUP BY src)""")
def top_value_share(spark, sf):
    return values.top_value_share(demo_book(spark, sf, "deductible_amt"), "deductible_amt")


@query("medians_by_source", "SELECT src, ROUND(quantile_cont(CAST(premium_amt AS DOUBLE), 0.5), 6) AS median FROM book GROUP BY src")
def medians(spark, sf):
    return values.medians_by_source(demo_book(spark, sf), "premium_amt")


@query("median_ratio", """SELECT COUNT(*) AS n_sources, ROUND(MIN(m), 6) AS min_median, ROUND(MAX(m), 6) AS max_median, ROUND(MAX(m) / MIN(m), 6) AS median_ratio
FROM (SELECT quantile_cont(CAST(premium_amt AS DOUBLE), 0.5) AS m FROM book GROUP BY src)""")
def median_ratio(spark, sf):
    return values.median_ratio(demo_book(spark, sf), "premium_amt")


@query("value_findings", """SELECT variable, metric, segment, value, status FROM (
SELECT 'class_cd' AS variable, 'n_values' AS metric, 'ALL' AS segment, CAST(COUNT(DISTINCT value) AS DOUBLE) AS value, 'info' AS status FROM vc
UNION ALL SELECT 'class_cd', 'source_unique_values', 'src=' || src, COUNT(*) FILTER (k = 1), CASE WHEN COUNT(*) FILTER (k = 1) > 0 THEN 'warn' ELSE 'pass' END
FROM (SELECT *, COUNT(*) OVER (PARTITION BY value) AS k FROM vc) GROUP BY src
UNION ALL SELECT 'class_cd', 'pct_rows_source_unique', 'src=' || src, ROUND(COALESCE(SUM(n) FILTER (k = 1), 0) / SUM(n), 6),
CASE WHEN COALESCE(SUM(n) FILTER (k = 1), 0) / SUM(n) > 0.05 THEN 'fail' WHEN COALESCE(SUM(n) FILTER (k = 1), 0) / SUM(n) > 0.005 THEN 'warn' ELSE 'pass' END
FROM (SELECT *, COUNT(*) OVER (PARTITION BY value) AS k FROM vc) GROUP BY src
UNION ALL SELECT 'premium_amt', 'pct_negative', 'src=' || src, ROUND(CAST(COUNT(*) FILTER (premium_amt < 0) AS DOUBLE) / COUNT(premium_amt), 6),
CASE WHEN CAST(COUNT(*) FILTER (premium_amt < 0) AS DOUBLE) / COUNT(premium_amt) > 0.01 THEN 'fail' WHEN COUNT(*) FILTER (premium_amt < 0) > 0 THEN 'warn' ELSE 'pass' END FROM book GROUP BY src
UNION ALL SELECT 'premium_amt', 'median_ratio_across_src', 'ALL', ROUND(MAX(m) / MIN(m), 6), 'pass'
FROM (SELECT quantile_cont(CAST(premium_amt AS DOUBLE), 0.5) AS m FROM book GROUP BY src))""", with_=VC)
def value_findings(spark, sf):
    cfg = values.ValuesConfig(categorical={"class_cd": values.CategoricalRule()}, numeric={"premium_amt": values.NumericRule(allow_negative=False)})
    return values.run(demo_book(spark, sf, "class_cd"), cfg).findings.select("variable", "metric", "segment", "value", "status")


@query("level_labels", """SELECT COALESCE(CAST(CAST(deductible_amt AS BIGINT) AS VARCHAR), '<null>') AS label, COUNT(*) AS n FROM book GROUP BY ALL
UNION ALL SELECT COALESCE(CAST(location_id AS VARCHAR), '<null>'), COUNT(*) FROM book GROUP BY ALL UNION ALL SELECT CAST(exp_date AS VARCHAR), COUNT(*) FROM book GROUP BY ALL""")
def level_labels(spark, sf):
    df = demo_book(spark, sf, "deductible_amt location_id exp_date").population()
    parts = [df.groupBy(level_label(F.col(c), df.schema[c].dataType).alias("label")).agg(F.count(F.lit(1)).alias("n"))
             for c in ("deductible_amt", "location_id", "exp_date")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
