from __future__ import annotations

from pyspark.sql import functions as F

from bookdq.operators.filters import Listed, Rule, RuleSet, rule_impact, segment_condition
from bookdq.sources.sinks import is_stale
from demo.book import demo_book, table
from demo.registry import query

COUNTED = "COUNT(*) AS n, COALESCE(CAST(SUM(premium_amt) AS DOUBLE), 0) AS premium"


def measured(book):
    return book.population().groupBy("src").agg(F.count(F.lit(1)).alias("n"),
                                                F.coalesce(F.sum("premium_amt").cast("double"), F.lit(0.0)).alias("premium"))


def on(**kw) -> Rule:
    return Rule(enabled=True, **kw)


@query("filter_structured", f"""SELECT src, {COUNTED} FROM book WHERE expo_amt > 10 AND tx_type <> '5-LOW' AND coverage NOT IN ('SMALL')
AND pol_yr >= 1996 AND exp_date < DATE '2001-01-01' AND deductible_amt IN (500, 750, 1250) AND line_no <= 6 AND location_id IS NOT NULL GROUP BY src""")
def filter_structured(spark, sf):
    rules = RuleSet((on(key="exposed", column="expo_amt", op="gt", values=("10",)), on(key="no_low", column="tx_type", op="ne", values=("5-LOW",)),
                     on(key="coverages", column="coverage", op="not_in", values=("SMALL",)), on(key="recent", column="pol_yr", op="gte", values=("1996",)),
                     on(key="ended", column="exp_date", op="lt", values=("2001-01-01",)),
                     on(key="deductibles", column="deductible_amt", op="in", values=("500", "750.0", "1250")),
                     on(key="lines", column="line_no", op="lte", values=("6",)), on(key="placed", column="location_id", op="not_null")))
    return measured(demo_book(spark, sf, "tx_type coverage pol_yr exp_date deductible_amt line_no location_id", rules))


@query("filter_in_null", f"SELECT src, {COUNTED} FROM book WHERE deductible_amt = 250 OR deductible_amt IS NULL GROUP BY src")
def filter_in_null(spark, sf):
    return measured(demo_book(spark, sf, "deductible_amt", RuleSet((on(key="d", column="deductible_amt", values=("250", "<null>")),))))


@query("filter_not_in_null", f"SELECT src, {COUNTED} FROM book WHERE location_id NOT IN (1, 2) AND location_id IS NOT NULL GROUP BY src")
def filter_not_in_null(spark, sf):
    return measured(demo_book(spark, sf, "location_id", RuleSet((on(key="l", column="location_id", op="not_in", values=("1", "2", "<null>")),))))


@query("filter_is_null", f"SELECT src, {COUNTED} FROM book WHERE location_id IS NULL GROUP BY src")
def filter_is_null(spark, sf):
    return measured(demo_book(spark, sf, "location_id", RuleSet((on(key="l", column="location_id", op="is_null"),))))


@query("filter_exclude_when", f"SELECT src, {COUNTED} FROM book WHERE NOT COALESCE(coverage = 'PROMO' AND location_id > 2, FALSE) GROUP BY src")
def filter_exclude_when(spark, sf):
    return measured(demo_book(spark, sf, "coverage location_id", RuleSet((on(key="e", exclude_when="coverage = 'PROMO' AND location_id > 2"),))))


@query("filter_keep_trap", f"SELECT src, {COUNTED} FROM book WHERE COALESCE(NOT (coverage = 'PROMO' AND location_id > 2), FALSE) GROUP BY src")
def filter_keep_trap(spark, sf):
    return measured(demo_book(spark, sf, "coverage location_id", RuleSet((on(key="k", expr="NOT (coverage = 'PROMO' AND location_id > 2)"),))))


def listed_parts(spark, sf) -> dict[str, str]:
    """A reference list: the classes of large parts."""
    (table(spark, sf, "part").where("p_size > 45 AND p_retailprice > 1000").select(F.col("p_brand").alias("class_cd"))
     .createOrReplaceTempView("listed_classes"))
    return {"class_list": "listed_classes"}


LISTED = "SELECT p_brand FROM part WHERE p_size > 45 AND p_retailprice > 1000 AND p_brand IS NOT NULL"
SEMI = Rule("listed", enabled=True, exclude_when="coverage = 'PROMO' AND is_listed",
            lists={"is_listed": Listed("class_cd", "{{ class_list }}", "class_cd", "class_cd IS NOT NULL")})
SELF = Rule("unpaid", enabled=True, exclude_when="coverage = 'PROMO' AND NOT has_large_premium",
            lists={"has_large_premium": Listed("policy_no", "{{ raw_table }}", "policy_no", "coverage = 'PROMO' AND premium_amt > 60000")})


@query("filter_semi_list", f"SELECT src, {COUNTED} FROM book WHERE NOT COALESCE(coverage = 'PROMO' AND class_cd IN ({LISTED}), FALSE) GROUP BY src")
def filter_semi_list(spark, sf):
    return measured(demo_book(spark, sf, "coverage class_cd", RuleSet((SEMI,)), sql_vars=listed_parts(spark, sf)))


@query("filter_semi_subquery", f"SELECT src, {COUNTED} FROM book WHERE NOT COALESCE(coverage = 'PROMO' AND class_cd IN ({LISTED}), FALSE) GROUP BY src")
def filter_semi_subquery(spark, sf):
    """The same rule written as a subquery by hand."""
    rule = on(key="listed", exclude_when="coverage = 'PROMO' AND class_cd IN (SELECT class_cd FROM {{ class_list }} WHERE class_cd IS NOT NULL)")
    return measured(demo_book(spark, sf, "coverage class_cd", RuleSet((rule,)), sql_vars=listed_parts(spark, sf)))


@query("filter_not_in_self", f"""SELECT src, {COUNTED} FROM book WHERE NOT COALESCE(coverage = 'PROMO' AND policy_no NOT IN
(SELECT policy_no FROM book WHERE coverage = 'PROMO' AND premium_amt > 60000 AND policy_no IS NOT NULL), FALSE) GROUP BY src""")
def filter_not_in_self(spark, sf):
    return measured(demo_book(spark, sf, "coverage policy_no", RuleSet((SELF,))))


LARGE = "coverage = 'PROMO' AND COALESCE(premium_amt, 0) > 60000"
TEXTS = {"self": f"coverage = 'PROMO' AND policy_no IS NOT NULL AND policy_no NOT IN (SELECT policy_no FROM {{book}} WHERE {LARGE} AND policy_no IS NOT NULL)",
         "null keys": "coverage = 'PROMO' AND location_id NOT IN (SELECT location_id FROM {book} WHERE location_id IN (1, 2))",
         "null in the list": "coverage = 'PROMO' AND location_id NOT IN (SELECT location_id FROM {book} WHERE location_id = 3 OR location_id IS NULL)",
         "both": "(location_id IN (SELECT location_id FROM {book} WHERE line_no = 4) OR tx_type = '5-LOW') AND CAST(policy_no AS STRING) NOT IN (SELECT CAST(policy_no AS STRING) FROM {book} WHERE line_no = 5)",
         "empty list": "coverage = 'PROMO' AND location_id NOT IN (SELECT location_id FROM {book} WHERE line_no > 99)"}


@query("filter_membership_text", " UNION ALL ".join(
    f"SELECT '{form}' AS form, '{kind}' AS kind, src, {COUNTED} FROM book WHERE {shape.format(text.format(book='book').replace('STRING', 'VARCHAR'))} GROUP BY src"
    for form, text in TEXTS.items() for kind, shape in (("drop", "NOT COALESCE({}, FALSE)"), ("keep", "COALESCE({}, FALSE)"))))
def filter_membership_text(spark, sf):
    """Memberships as users write them, with nulls on both sides, as rules that drop and as rules that keep."""
    book, parts = demo_book(spark, sf, "coverage policy_no location_id line_no tx_type"), []
    for form, text in TEXTS.items():
        for kind, name in (("drop", "exclude_when"), ("keep", "expr")):
            rule = on(key="text", **{name: text.format(book="{{ raw_table }}")})
            parts.append(measured(book.with_rules(RuleSet((rule,)))).select(F.lit(form).alias("form"), F.lit(kind).alias("kind"), "src", "n", "premium"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query("filter_impact", f"""SELECT key, label, enabled, rows_removed, ROUND(rows_removed / n, 6) AS pct_rows,
CAST(premium_removed AS DOUBLE) AS premium_removed, ROUND(CAST(premium_removed AS DOUBLE) / CAST(p AS DOUBLE), 6) AS pct_premium FROM (
SELECT UNNEST([{{'key': 'exposed', 'label': 'Exposed', 'enabled': TRUE, 'rows_removed': COUNT(*) FILTER (NOT a), 'premium_removed': COALESCE(SUM(premium_amt) FILTER (NOT a), 0)}},
{{'key': 'placed', 'label': 'placed', 'enabled': FALSE, 'rows_removed': COUNT(*) FILTER (NOT b), 'premium_removed': COALESCE(SUM(premium_amt) FILTER (NOT b), 0)}},
{{'key': 'unpaid', 'label': 'unpaid', 'enabled': TRUE, 'rows_removed': COUNT(*) FILTER (NOT c), 'premium_removed': COALESCE(SUM(premium_amt) FILTER (NOT c), 0)}},
{{'key': 'TOTAL', 'label': 'All 2 active rule(s) together', 'enabled': TRUE, 'rows_removed': COUNT(*) FILTER (NOT (a AND c)), 'premium_removed': COALESCE(SUM(premium_amt) FILTER (NOT (a AND c)), 0)}}],
recursive := true), COUNT(*) AS n, SUM(premium_amt) AS p FROM (SELECT premium_amt, COALESCE(expo_amt > 10, FALSE) AS a, COALESCE(location_id < 5, FALSE) AS b,
NOT COALESCE(coverage = 'PROMO' AND policy_no NOT IN (SELECT policy_no FROM book WHERE coverage = 'PROMO' AND premium_amt > 60000), FALSE) AS c FROM book))""")
def filter_impact(spark, sf):
    rules = RuleSet((on(key="exposed", label="Exposed", column="expo_amt", op="gt", values=("10",)), Rule("placed", column="location_id", op="lt", values=("5",)),
                     SELF, Rule("elsewhere", column="src", op="is_null", enabled=True, profiles=("prod",))))
    return rule_impact(demo_book(spark, sf, "coverage policy_no location_id", rules))


@query("filter_scope_segment", "SELECT COUNT(*) AS n, CAST(SUM(premium_amt) AS DOUBLE) AS premium FROM book WHERE coverage = 'PROMO' AND location_id IS NULL")
def filter_scope_segment(spark, sf):
    book = demo_book(spark, sf, "coverage location_id")
    df = book.population(segment_condition(book, {"coverage": "PROMO", "location_id": None}))
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("premium_amt").cast("double").alias("premium"))


@query("filter_stale", """SELECT 'run of ' || CAST(MAX(pol_yr) AS VARCHAR) AS run_filters, '' AS current_filters, TRUE AS stale FROM book""")
def filter_stale(spark, sf):
    """The latest stored run against the rules in force: one run per year of the book stands in for the history."""
    book = demo_book(spark, sf, "pol_yr")
    runs = book.population().groupBy("pol_yr").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("pol_yr").cast("string").alias("run_id"), F.col("pol_yr").cast("string").alias("run_ts"),
        F.concat(F.lit("run of "), F.col("pol_yr").cast("string")).alias("filters"))
    return is_stale(runs, book.rules.fingerprint("default"))
