from __future__ import annotations

from pyspark.sql import functions as F

from bookdq import Book, BookSpec, Measures
from bookdq.operators import distribution as ds
from bookdq.operators.distribution import LogScale, Profile, PsiRule
from demo.book import demo_book, table
from demo.registry import query

PREMIUM = Profile("premium_amt", group_by=("src", "pol_yr"), log_scale=LogScale("signed_log"), hist_bins=30, allow_negative=False,
                  outlier_ratio=1.1, psi=PsiRule("pol_yr", bins=10))
GRID = (0.1, 0.5, 0.9, 0.95, 0.995)


def events_book(spark, sf) -> Book:
    """The event stream as a book: what a single amount column by type and day looks like."""
    raw = table(spark, sf, "events").select("event_id", F.col("event_type").alias("src"), "value", F.to_date("ts").alias("day"), "user_id")
    return Book(BookSpec("events", "src", (), Measures("value", "value", "event_id", "value", "src"), ("event_id",)), raw)


@query("dist_stats", """SELECT src, pol_yr, COUNT(*) AS n_rows, COUNT(x) AS n_nonnull, COUNT(*) FILTER (x = 0) AS n_zero, COUNT(*) FILTER (x < 0) AS n_negative,
MIN(x) AS min, ROUND(AVG(x), 4) AS mean, MAX(x) AS max, ROUND(stddev_samp(x), 4) AS std, ROUND(quantile_cont(x, 0.5), 6) AS p50, ROUND(quantile_cont(x, 0.99), 6) AS p99,
ROUND(CAST(COUNT(*) FILTER (x = 0) AS DOUBLE) / COUNT(x), 6) AS pct_zero, ROUND(CAST(COUNT(*) FILTER (x < 0) AS DOUBLE) / COUNT(x), 6) AS pct_negative,
ROUND(MAX(x) / quantile_cont(x, 0.99), 6) AS max_to_p99 FROM (SELECT src, pol_yr, CAST(premium_amt AS DOUBLE) AS x FROM book) GROUP BY src, pol_yr""")
def dist_stats(spark, sf):
    out = ds.numeric_stats(demo_book(spark, sf, "pol_yr"), PREMIUM)
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("dist_stats_null_segment", """SELECT src, COUNT(*) AS n_rows, COUNT(location_id) AS n_nonnull, CAST(MIN(location_id) AS DOUBLE) AS min,
ROUND(AVG(location_id), 6) AS mean, CAST(MAX(location_id) AS DOUBLE) AS max, quantile_cont(CAST(location_id AS DOUBLE), 0.99) AS p99 FROM book GROUP BY src""")
def dist_null_segment(spark, sf):
    out = ds.numeric_stats(demo_book(spark, sf, "location_id"), Profile("location_id", type="numeric"))
    return out.select("src", "n_rows", "n_nonnull", "min", "mean", "max", "p99")


@query("dist_percentiles", f"""SELECT src, percentile, ROUND(value, 6) AS value FROM (SELECT src, UNNEST([0.0, {", ".join(map(str, GRID[:4]))}, 0.99, 0.995, 1.0]::DOUBLE[]) AS percentile,
UNNEST(quantile_cont(CAST(premium_amt AS DOUBLE), [0.0, {", ".join(map(str, GRID[:4]))}, 0.99, 0.995, 1.0])) AS value FROM book GROUP BY src)""")
def dist_percentiles(spark, sf):
    return ds.percentile_table(demo_book(spark, sf), Profile("premium_amt", percentile_bins=GRID))


@query("dist_percentiles_by_null_level", """SELECT location_id, percentile, ROUND(value, 6) AS value FROM (SELECT location_id, UNNEST([0.0, 0.25, 0.5, 0.75, 0.99, 1.0]::DOUBLE[]) AS percentile,
UNNEST(quantile_cont(expo_amt, [0.0, 0.25, 0.5, 0.75, 0.99, 1.0])) AS value FROM book GROUP BY location_id)""")
def dist_percentiles_null(spark, sf):
    return ds.percentile_table(demo_book(spark, sf, "location_id"), Profile("expo_amt", group_by=("location_id",), percentile_bins=4))


@query("dist_percentiles_approx", """SELECT src, percentile, TRUE AS close FROM (SELECT DISTINCT src FROM book), (SELECT UNNEST([0.0, 0.25, 0.5, 0.75, 0.99, 1.0]::DOUBLE[]) AS percentile)""")
def dist_percentiles_approx(spark, sf):
    """Sketch percentiles against the exact ones: within half a percent of the value range."""
    book, p = demo_book(spark, sf).stored(["src", "premium_amt"]), Profile("premium_amt", percentile_bins=4)
    exact, approx = ds.percentile_table(book, p), ds.percentile_table(book, p, exact=False)
    both = exact.join(approx.withColumnRenamed("value", "approx"), ["src", "percentile"])
    return both.select("src", "percentile", (F.abs(F.col("value") - F.col("approx")) <= 0.005 * 210000).alias("close"))


def _hist(table_sql: str, v: str, inverse: str, bins: int) -> str:
    return f"""SELECT src, segment, bucket, n, ROUND(lo + bucket * w, 6) AS "left", ROUND(lo + bucket * w + w, 6) AS "right", ROUND(lo + bucket * w + w / 2, 6) AS center,
ROUND({inverse.format(v="(lo + bucket * w)")}, 4) AS "from", ROUND({inverse.format(v="(lo + bucket * w + w)")}, 4) AS "to",
ROUND(CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY src), 6) AS share FROM (
SELECT src, 'src=' || src AS segment, CAST(LEAST(GREATEST(FLOOR((GREATEST(LEAST(v, hi), lo) - lo) / w), 0), {bins - 1}) AS INTEGER) AS bucket, COUNT(*) AS n, lo, w FROM
(SELECT src, {v} AS v FROM {table_sql}), (SELECT lo, hi, (hi - lo) / {bins} AS w FROM (SELECT quantile_cont({v}, 0.001) AS lo, quantile_cont({v}, 0.999) AS hi FROM {table_sql}))
GROUP BY src, bucket, lo, w)"""


@query("dist_histogram_log1p", _hist("(SELECT event_type AS src, value AS x FROM events WHERE value IS NOT NULL AND value > -1)", "ln(1 + x)", "exp({v}) - 1", 40), book=False)
def hist_log1p(spark, sf):
    out = ds.histogram(events_book(spark, sf), Profile("value", log_scale=LogScale("log1p")))
    return out.withColumns({"from": F.round("from", 4), "to": F.round("to", 4)})


@query("dist_histogram_signed", _hist("(SELECT src, CAST(premium_amt AS DOUBLE) AS x FROM book)", "sign(x) * ln(1 + abs(x))", "sign({v}) * (exp(abs({v})) - 1)", 30))
def hist_signed(spark, sf):
    out = ds.histogram(demo_book(spark, sf), Profile("premium_amt", log_scale=LogScale("signed_log"), hist_bins=30))
    return out.withColumns({"from": F.round("from", 4), "to": F.round("to", 4)})


@query("dist_histogram_log10", _hist("(SELECT src, CAST(loss_amt AS DOUBLE) AS x FROM book WHERE loss_amt > 0)", "log10(x)", "pow(10.0, {v})", 20))
def hist_log10(spark, sf):
    out = ds.histogram(demo_book(spark, sf), Profile("loss_amt", log_scale=LogScale("log10"), hist_bins=20))
    return out.withColumns({"from": F.round("from", 4), "to": F.round("to", 4)})


@query("dist_outside_scale", "SELECT COUNT(*) FILTER (loss_amt IS NOT NULL AND NOT loss_amt > 0) AS excluded FROM book")
def outside(spark, sf):
    return ds.outside_scale(demo_book(spark, sf), Profile("loss_amt", log_scale=LogScale("log10")))


CATEGORIES = Profile("class_cd", group_by=("src", "pol_yr"), max_categories=10, top_n=5, psi=PsiRule("pol_yr"))
CATS = """top AS (SELECT class_cd AS kept FROM book WHERE class_cd IS NOT NULL GROUP BY class_cd ORDER BY COUNT(*) DESC, class_cd LIMIT 10),
cats AS (SELECT *, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY src, pol_yr) AS share FROM (SELECT src, pol_yr, CASE WHEN class_cd IS NULL THEN '<null>' ELSE COALESCE(kept, '<other>') END AS category,
COUNT(*) AS n FROM book LEFT JOIN top ON class_cd = kept GROUP BY ALL))"""


@query("dist_categories", "SELECT src, pol_yr, category, n, ROUND(share, 6) AS share FROM cats", with_=CATS)
def categories(spark, sf):
    return ds.category_counts(demo_book(spark, sf, "class_cd pol_yr"), CATEGORIES)


@query("dist_top_categories", """SELECT src, pol_yr, category, n, ROUND(share, 6) AS share FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY src, pol_yr ORDER BY n DESC, category) AS r FROM cats)
WHERE r <= 5""", with_=CATS)
def top_categories(spark, sf):
    return ds.top_categories(ds.category_counts(demo_book(spark, sf, "class_cd pol_yr"), CATEGORIES), ["src", "pol_yr"], 5)


@query("dist_category_summary", "SELECT src, pol_yr, CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) FILTER (category NOT IN ('<null>', '<other>')) AS n_categories FROM cats GROUP BY ALL", with_=CATS)
def category_summary(spark, sf):
    return ds.category_summary(ds.category_counts(demo_book(spark, sf, "class_cd pol_yr"), CATEGORIES), ["src", "pol_yr"])


@query("new_categories", """SELECT src, pol_yr, category, n, ROUND(share, 6) AS share FROM (SELECT *, DENSE_RANK() OVER (PARTITION BY src ORDER BY pol_yr) AS lvl,
MIN(pol_yr) OVER (PARTITION BY src, category) AS first FROM (SELECT *, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY src, pol_yr) AS share
FROM (SELECT src, pol_yr, program_cd AS category, COUNT(*) AS n FROM book GROUP BY ALL))) WHERE pol_yr = first AND lvl > 1 AND share >= 0.005""")
def new_categories(spark, sf):
    p = Profile("program_cd", group_by=("src", "pol_yr"), psi=PsiRule("pol_yr"))
    counts = ds.every_category(demo_book(spark, sf, "program_cd pol_yr"), [p]).drop("variable")
    return ds.new_categories(counts, p.group_by, "pol_yr", p.new_category_min_share)[0]


@query("new_categories_by_day", """SELECT exp_date, category, n, ROUND(share, 6) AS share FROM (SELECT *, MIN(exp_date) OVER () AS day0, MIN(exp_date) OVER (PARTITION BY category) AS first FROM (
SELECT *, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY exp_date) AS share FROM (SELECT exp_date, zip_cd AS category, COUNT(*) AS n FROM book GROUP BY ALL))) WHERE exp_date = first AND exp_date > day0 AND share >= 0.005""")
def new_categories_by_day(spark, sf):
    """Thousands of levels in one partition."""
    p = Profile("zip_cd", group_by=("exp_date",), psi=PsiRule("exp_date"))
    counts = ds.every_category(demo_book(spark, sf, "zip_cd exp_date"), [p]).drop("variable")
    return ds.new_categories(counts, p.group_by, "exp_date", p.new_category_min_share)[0]


def _psi(counts: str, dims: tuple[str, ...], across: str) -> str:
    others = [d for d in dims if d != across]
    same = " AND ".join([f"a.{across} <> b.{across}", *[f"a.{d} = b.{d}" for d in others]])
    a_dims = ", ".join(f"a.{d}" for d in dims)
    b_keys = ", ".join(f"b.{d}" for d in dims)
    cols = ", ".join(dims)
    return f"""SELECT {cols}, ROUND(median(psi), 6) AS psi, ROUND(MAX(psi), 6) AS max_pairwise_psi, COUNT(*) AS n_peers, MAX(n) AS n FROM (
SELECT {a_dims}, MAX(a.total) AS n, SUM((a.p - b.p) * ln(a.p / b.p)) AS psi FROM grid a JOIN grid b ON a.key = b.key AND {same} GROUP BY {a_dims}, {b_keys}) GROUP BY {cols}"""


def _grid(counts: str, dims: tuple[str, ...]) -> str:
    cols = ", ".join(dims)
    join = " AND ".join(f"s.{d} = c.{d}" for d in dims)
    return f"""c AS ({counts}), grid AS (SELECT *, floored / SUM(floored) OVER (PARTITION BY {cols}) AS p FROM (
SELECT {", ".join("s." + d for d in dims)}, s.total, k.key, GREATEST(COALESCE(CAST(c.n AS DOUBLE), 0), 1e-4) AS floored
FROM (SELECT {cols}, CAST(SUM(n) AS BIGINT) AS total FROM c GROUP BY {cols}) s CROSS JOIN (SELECT DISTINCT key FROM c) k LEFT JOIN c ON {join} AND c.key = k.key))"""


_EDGES = "edges AS (SELECT list_sort(list_distinct(quantile_cont(CAST(premium_amt AS DOUBLE), [{p}]))) AS e FROM book)".format(p=", ".join(str(i / 10) for i in range(1, 10)))
_PREMIUM_COUNTS = "SELECT src, pol_yr, len(list_filter(e, lambda t: t < CAST(premium_amt AS DOUBLE))) AS key, COUNT(*) AS n FROM book, edges WHERE premium_amt IS NOT NULL GROUP BY ALL"


@query("psi_numeric", _psi("", ("src", "pol_yr"), "pol_yr"), with_=f"{_EDGES}, {_grid(_PREMIUM_COUNTS, ('src', 'pol_yr'))}")
def psi_numeric(spark, sf):
    return ds.psi_numeric(demo_book(spark, sf, "pol_yr"), PREMIUM)


@query("psi_events_by_type", _psi("", ("src",), "src"), book=False,
       with_="edges AS (SELECT list_sort(list_distinct(quantile_cont(value, [0.2, 0.4, 0.6, 0.8]))) AS e FROM events), "
             + _grid("SELECT event_type AS src, len(list_filter(e, lambda t: t < value)) AS key, COUNT(*) AS n FROM events, edges GROUP BY ALL", ("src",)))
def psi_events(spark, sf):
    return ds.psi_numeric(events_book(spark, sf), Profile("value", psi=PsiRule("src", bins=5)))


_DAY_EDGES = "edges AS (SELECT list_sort(list_distinct(quantile_cont(expo_amt, [0.25, 0.5, 0.75]))) AS e FROM book)"


@query("psi_by_day", _psi("", ("exp_date",), "exp_date"), with_=f"{_DAY_EDGES}, {_grid('SELECT exp_date, len(list_filter(e, lambda t: t < expo_amt)) AS key, COUNT(*) AS n FROM book, edges WHERE expo_amt IS NOT NULL GROUP BY ALL', ('exp_date',))}")
def psi_by_day(spark, sf):
    """Thousands of segments, each against all others: in tiles, no row for a pair."""
    return ds.psi_numeric(demo_book(spark, sf, "exp_date"), Profile("expo_amt", group_by=("exp_date",), psi=PsiRule("exp_date", bins=4)))


@query("psi_categorical", _psi("", ("src", "pol_yr"), "pol_yr"), with_=f"{CATS}, {_grid('SELECT src, pol_yr, category AS key, n FROM cats', ('src', 'pol_yr'))}")
def psi_categorical(spark, sf):
    return ds.psi_categorical(demo_book(spark, sf, "class_cd pol_yr"), CATEGORIES)


@query("distribution_findings", f"""SELECT variable, metric, segment, value, status FROM (
SELECT 'premium_amt' AS variable, 'pct_negative' AS metric, 'src=' || src AS segment, ROUND(r, 6) AS value, CASE WHEN r > 0.001 THEN 'fail' WHEN r > 0 THEN 'warn' ELSE 'pass' END AS status
FROM (SELECT src, CAST(COUNT(*) FILTER (premium_amt < 0) AS DOUBLE) / COUNT(premium_amt) AS r FROM book GROUP BY src)
UNION ALL SELECT 'premium_amt', 'max_to_p99', 'src=' || src, ROUND(r, 6), CASE WHEN r > 11 THEN 'fail' WHEN r > 1.1 THEN 'warn' ELSE 'pass' END
FROM (SELECT src, CAST(MAX(premium_amt) AS DOUBLE) / quantile_cont(CAST(premium_amt AS DOUBLE), 0.99) AS r FROM book GROUP BY src)
UNION ALL SELECT 'class_cd', 'psi', 'src=' || src || '|pol_yr=' || CAST(pol_yr AS VARCHAR), psi, CASE WHEN psi > 0.25 THEN 'fail' WHEN psi > 0.1 THEN 'warn' ELSE 'pass' END
FROM ({_psi("", ("src", "pol_yr"), "pol_yr")})
UNION ALL SELECT 'class_cd', 'new_categories', 'src=' || src || '|pol_yr=' || CAST(pol_yr AS VARCHAR), CAST(COUNT(*) FILTER (new) AS DOUBLE), CASE WHEN COUNT(*) FILTER (new) > 0 THEN 'warn' ELSE 'pass' END
FROM (SELECT *, category NOT IN ('<null>', '<other>') AND pol_yr = MIN(pol_yr) OVER (PARTITION BY src, category) AND share >= 0.005 AS new, MIN(pol_yr) OVER (PARTITION BY src) AS y0 FROM cats)
WHERE pol_yr > y0 GROUP BY src, pol_yr)""", with_=f"{CATS}, {_grid('SELECT src, pol_yr, category AS key, n FROM cats', ('src', 'pol_yr'))}")
def distribution_findings(spark, sf):
    cfg = ds.DistributionConfig(variables=(Profile("premium_amt", allow_negative=False, outlier_ratio=1.1), CATEGORIES))
    found = ds.run(demo_book(spark, sf, "class_cd pol_yr"), cfg).findings
    return found.select("variable", "metric", "segment", "value", "status")
