from __future__ import annotations

from pyspark.sql import functions as F

from bookdq.operators import targets as tg
from bookdq.operators.binning import Binning, resolve
from bookdq.operators.targets import TargetConfig
from demo.book import demo_book
from demo.registry import query

CFG = TargetConfig(max_levels=6, min_claims=10, spread_warn=1.02, interaction_warn=0.01)
VARS = {"src": "src", "coverage": "coverage", "class_cd": "class_cd", "location_id": "COALESCE(CAST(location_id AS VARCHAR), '<null>')"}
SPECS = {"frequency": ("claims", "exposure"), "severity": ("loss", "claims"), "loss_cost": ("loss", "exposure"), "loss_ratio": ("loss", "premium")}
_SUMS = """COUNT(*) AS records, CAST(SUM(premium_amt) AS DOUBLE) AS premium, CAST(SUM(loss_amt) AS DOUBLE) AS loss, CAST(SUM(claim_cnt) AS DOUBLE) AS claims, SUM(expo_amt) AS exposure"""
_ADD = "SUM(records) AS records, SUM(premium) AS premium, SUM(loss) AS loss, SUM(claims) AS claims, SUM(exposure) AS exposure"


def ctes(target: str, levels: dict[str, str], base: str | None = None, max_levels: int = 6) -> str:
    """total, oneway, pairs and strength of a target in plain SQL."""
    num, den = SPECS[target]
    where = f"WHERE expo_base = '{base}'" if base else ""
    names = list(levels)
    ones = " UNION ALL ".join(f"SELECT '{n}' AS var_a, {e} AS level_a, {_SUMS} FROM book {where} GROUP BY ALL" for n, e in levels.items())
    twos = " UNION ALL ".join(f"SELECT '{a}' AS var_a, {levels[a]} AS level_a, '{b}' AS var_b, {levels[b]} AS level_b, {_SUMS} FROM book {where} GROUP BY ALL"
                              for i, a in enumerate(names) for b in names[i + 1:])
    twos = twos or f"SELECT '' AS var_a, '' AS level_a, '' AS var_b, '' AS level_b, {_SUMS} FROM book WHERE FALSE GROUP BY ALL"
    ratios = f"""{den} AS weight, CASE WHEN {den} > 0 THEN {num} / {den} END AS value, CASE WHEN {den} > 0 THEN {num} / {den} END / (SELECT value FROM total) AS relativity,
LEAST(1.0::DOUBLE, sqrt(claims / 1082.0)) AS z"""
    return f"""total AS (SELECT *, CASE WHEN {den} > 0 THEN {num} / {den} END AS value FROM (SELECT {_SUMS} FROM book {where})), ones AS ({ones}),
keep AS (SELECT var_a AS v, level_a AS l FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY var_a ORDER BY {den} DESC, level_a) AS r FROM ones) WHERE r <= {max_levels}),
oneway AS (SELECT *, weight / SUM(weight) OVER (PARTITION BY var_a) AS weight_share FROM (SELECT *, {ratios} FROM (SELECT var_a, COALESCE(l, '<other>') AS level_a, {_ADD}
FROM ones LEFT JOIN keep ON v = var_a AND l = level_a GROUP BY var_a, COALESCE(l, '<other>')))),
pairs AS (SELECT c.*, (SELECT value FROM total) * ra.relativity * rb.relativity AS expected,
c.value / NULLIF((SELECT value FROM total) * ra.relativity * rb.relativity, 0) AS lift FROM (SELECT *, {ratios} FROM (SELECT var_a, COALESCE(ka.l, '<other>') AS level_a, var_b, COALESCE(kb.l, '<other>') AS level_b, {_ADD}
FROM ({twos}) t LEFT JOIN keep ka ON ka.v = var_a AND ka.l = level_a LEFT JOIN keep kb ON kb.v = var_b AND kb.l = level_b GROUP BY var_a, COALESCE(ka.l, '<other>'), var_b, COALESCE(kb.l, '<other>'))) c
LEFT JOIN oneway ra ON ra.var_a = c.var_a AND ra.level_a = c.level_a LEFT JOIN oneway rb ON rb.var_a = c.var_b AND rb.level_a = c.level_b),
strength AS (SELECT var_a, var_b, var_a || ' × ' || var_b AS pair, sqrt(SUM(weight * ln(lift) * ln(lift)) FILTER (claims >= 10 AND lift > 0 AND weight > 0) / SUM(weight) FILTER (claims >= 10 AND lift > 0 AND weight > 0)) AS strength,
COUNT(*) AS n_cells, COUNT(*) FILTER (claims >= 10) AS n_credible, COALESCE(SUM(weight) FILTER (claims >= 10), 0) / SUM(weight) AS weight_credible FROM pairs GROUP BY var_a, var_b)"""


_MEASURES = "records, ROUND(premium, 4) AS premium, ROUND(loss, 4) AS loss, claims, exposure, weight, ROUND(value, 6) AS value, ROUND(relativity, 6) AS relativity, ROUND(z, 6) AS z"
ONEWAY = f"SELECT var_a, level_a, CAST({_MEASURES.replace('records,', 'records AS DOUBLE) AS records,', 1).replace('weight,', 'ROUND(weight, 4) AS weight,', 1)}, ROUND(weight_share, 6) AS weight_share FROM oneway"
NEED = "coverage class_cd location_id"


def _oneway(spark, sf, target: str, base: str | None = None):
    out = tg.profile(demo_book(spark, sf, NEED), list(VARS), target, CFG, base).oneway
    return out.withColumns({c: F.round(c, 4) for c in ("premium", "loss", "weight")})


@query("target_loss_ratio", ONEWAY, with_=ctes("loss_ratio", VARS))
def loss_ratio(spark, sf):
    return _oneway(spark, sf, "loss_ratio")


@query("target_severity", ONEWAY, with_=ctes("severity", VARS))
def severity(spark, sf):
    return _oneway(spark, sf, "severity")


BASE = "base AS (SELECT arg_max(expo_base, p) AS b FROM (SELECT expo_base, SUM(premium_amt) AS p FROM book WHERE expo_base IS NOT NULL GROUP BY expo_base))"


@query("target_frequency", ONEWAY, with_=f"{BASE}, " + ctes("frequency", VARS).replace("FROM book ", "FROM book WHERE expo_base = (SELECT b FROM base) "))
def frequency(spark, sf):
    return _oneway(spark, sf, "frequency", tg.default_base(demo_book(spark, sf)))


@query("target_loss_cost", ONEWAY, with_=ctes("loss_cost", VARS, base="O"))
def loss_cost(spark, sf):
    return _oneway(spark, sf, "loss_cost", "O")


@query("target_total", "SELECT CAST(records AS DOUBLE) AS records, premium, ROUND(loss, 4) AS loss, claims, exposure, ROUND(value, 6) AS value, 'Loss ratio (loss per premium)' AS target FROM total", with_=ctes("loss_ratio", VARS))
def total(spark, sf):
    out = tg.profile(demo_book(spark, sf, NEED), list(VARS), "loss_ratio", CFG).total
    return out.withColumn("loss", F.round("loss", 4))


@query("target_pairs", "SELECT var_a, level_a, var_b, level_b, ROUND(premium, 2) AS premium, claims, ROUND(value, 6) AS value, ROUND(relativity, 6) AS relativity, ROUND(z, 6) AS z, "
                       "ROUND(expected, 6) AS expected, ROUND(lift, 6) AS lift FROM pairs", with_=ctes("loss_ratio", VARS))
def pairs(spark, sf):
    out = tg.profile(demo_book(spark, sf, NEED), list(VARS), "loss_ratio", CFG).pairs
    return out.select("var_a", "level_a", "var_b", "level_b", F.round("premium", 2).alias("premium"), "claims", "value", "relativity", "z", "expected", "lift")


@query("interaction_strength", "SELECT var_a, var_b, pair, ROUND(strength, 6) AS strength, n_cells, n_credible, ROUND(weight_credible, 6) AS weight_credible, ROUND(exp(strength) - 1, 6) AS typical_error FROM strength",
       with_=ctes("severity", VARS))
def strength(spark, sf):
    return tg.profile(demo_book(spark, sf, NEED), list(VARS), "severity", CFG).strength


@query("target_findings", """SELECT variable, metric, item, ROUND(value, 6) AS value, status FROM (
SELECT var_a AS variable, 'target_spread' AS metric, 'loss_ratio' AS item, s AS value, CASE WHEN s IS NULL THEN 'info' WHEN s > 1.02 THEN 'warn' ELSE 'pass' END AS status
FROM (SELECT var_a, CASE WHEN COUNT(*) FILTER (claims >= 10 AND relativity > 0) > 1 THEN MAX(relativity) FILTER (claims >= 10 AND relativity > 0) / MIN(relativity) FILTER (claims >= 10 AND relativity > 0) END AS s FROM oneway GROUP BY var_a)
UNION ALL SELECT var_a, 'pct_weight_low_credibility', 'loss_ratio', t, CASE WHEN t > 0.25 THEN 'fail' WHEN t > 0.1 THEN 'warn' ELSE 'pass' END
FROM (SELECT var_a, COALESCE(SUM(weight) FILTER (claims < 10), 0) / SUM(weight) AS t FROM oneway GROUP BY var_a)
UNION ALL SELECT var_a, 'interaction_strength', 'loss_ratio: ' || pair, strength, CASE WHEN strength > 0.01 THEN 'warn' ELSE 'pass' END FROM strength WHERE strength IS NOT NULL)""", with_=ctes("loss_ratio", VARS))
def target_findings(spark, sf):
    t = tg.profile(demo_book(spark, sf, NEED), list(VARS), "loss_ratio", CFG)
    return tg.target_findings("loss_ratio", t, CFG).select("variable", "metric", "item", "value", "status")


_LINES = """SELECT level_a AS x, level_b AS line, ROUND(value, 6) AS value, claims, ROUND(weight, 4) AS weight, ROUND(expected, 6) AS expected, ROUND(lift, 6) AS lift FROM pairs
WHERE var_a = 'coverage' AND var_b = 'class_cd' AND claims >= 10 AND level_b IN (SELECT level_b FROM pairs WHERE var_a = 'coverage' AND var_b = 'class_cd' AND claims >= 10 GROUP BY level_b ORDER BY SUM(weight) DESC, level_b LIMIT 4)"""


@query("interaction_lines", _LINES, with_=ctes("loss_ratio", VARS))
def lines(spark, sf):
    t = tg.profile(demo_book(spark, sf, NEED), list(VARS), "loss_ratio", CFG)
    return tg.interaction_lines(t, "coverage", "class_cd", CFG, max_lines=4).withColumn("weight", F.round("weight", 4))


@query("lift_matrix", """SELECT level_b AS line, ROUND(AVG(lift) FILTER (level_a = 'A'), 6) AS "A", ROUND(AVG(lift) FILTER (level_a = 'N'), 6) AS "N", ROUND(AVG(lift) FILTER (level_a = 'R'), 6) AS "R"
FROM pairs WHERE var_a = 'src' AND var_b = 'coverage' AND claims >= 10 GROUP BY level_b""", with_=ctes("loss_ratio", VARS))
def lift_matrix(spark, sf):
    t = tg.profile(demo_book(spark, sf, NEED), list(VARS), "loss_ratio", CFG)
    return tg.lift_matrix(tg.interaction_lines(t, "src", "coverage", CFG, max_lines=8), ["A", "N", "R"])


@query("pair_guard", """SELECT COUNT(*) AS n_pairs, COUNT(DISTINCT var_a || var_b) AS n_crossed FROM pairs""", with_=ctes("loss_ratio", {k: VARS[k] for k in ("src", "coverage")}))
def pair_guard(spark, sf):
    """The end date has thousands of levels: it gets a one-way and is crossed with nothing."""
    t = tg.profile(demo_book(spark, sf, "coverage exp_date"), ["src", "coverage", "exp_date"], "loss_ratio", CFG)
    return t.pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct(F.concat("var_a", "var_b")).alias("n_crossed"))


# ---- binning -------------------------------------------------------------------------
CUSTOM = Binning("premium_amt", "bands", "custom", cuts=(0, 25000, 50000, 75000.5))
CUSTOM_SQL = """CASE WHEN premium_amt IS NULL THEN '<null>' WHEN premium_amt < 0 THEN '01. < 0' WHEN premium_amt < 25000 THEN '02. 0 to 25K'
WHEN premium_amt < 50000 THEN '03. 25K to 50K' WHEN premium_amt < 75000.5 THEN '04. 50K to 75K' ELSE '05. >= 75K' END"""


@query("binned_oneway", ONEWAY, with_=ctes("severity", {"premium_amt": CUSTOM_SQL, "src": "src"}))
def binned(spark, sf):
    out = tg.profile(demo_book(spark, sf), ["premium_amt", "src"], "severity", CFG, binnings=[CUSTOM]).oneway
    return out.withColumns({c: F.round(c, 4) for c in ("premium", "loss", "weight")})


def _position_oneway(cut_sql: str, n: int) -> str:
    return f"""SELECT position, COUNT(*) AS records, CAST(SUM(claim_cnt) AS BIGINT) AS claims FROM (SELECT CAST(CASE WHEN x IS NULL THEN 0 ELSE 1 + len(list_filter(cuts, lambda c: c <= x)) END AS INTEGER) AS position, claim_cnt
FROM (SELECT {{x}} AS x, claim_cnt FROM book), (SELECT list_distinct({cut_sql}) AS cuts FROM book)) GROUP BY position"""


def _by_position(book, binning: Binning):
    """Rows and claims by bin number (the two digits a label starts with; 0 = null)."""
    label = binning.label(F.col(binning.variable))
    position = F.when(label == "<null>", F.lit(0)).otherwise(F.substring(label, 1, 2).cast("int"))
    return book.population().groupBy(position.alias("position")).agg(F.count(F.lit(1)).alias("records"), F.sum("claim_cnt").alias("claims"))


@query("quantile_oneway", _position_oneway("quantile_cont(CAST(premium_amt AS DOUBLE), [0.2, 0.4, 0.6, 0.8])", 5).format(x="CAST(premium_amt AS DOUBLE)"))
def quantile(spark, sf):
    book = demo_book(spark, sf).stored(["premium_amt", "claim_cnt"])
    return _by_position(book, resolve(book, Binning("premium_amt", "fifths", "quantile", bins=5)))


@query("quantile_oneway_discrete", _position_oneway("quantile_cont(deductible_amt, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])", 10).format(x="deductible_amt"))
def quantile_discrete(spark, sf):
    """A column of few values: repeated quantiles are one cut, and nulls have their own bin."""
    book = demo_book(spark, sf, "deductible_amt").stored(["deductible_amt", "claim_cnt"])
    return _by_position(book, resolve(book, Binning("deductible_amt", "tenths", "quantile", bins=10)))


@query("equal_width_oneway", _position_oneway("[MIN(expo_amt) + (MAX(expo_amt) - MIN(expo_amt)) / 4 * 1, MIN(expo_amt) + (MAX(expo_amt) - MIN(expo_amt)) / 4 * 2, MIN(expo_amt) + (MAX(expo_amt) - MIN(expo_amt)) / 4 * 3]", 4).format(x="expo_amt"))
def equal_width(spark, sf):
    book = demo_book(spark, sf).stored(["expo_amt", "claim_cnt"])
    return _by_position(book, resolve(book, Binning("expo_amt", "quarters", "equal_width", bins=4)))


_TWO_SQL = "CASE WHEN premium_amt IS NULL THEN '<null>' WHEN premium_amt < 40000 THEN '01. < 40K' ELSE '02. >= 40K' END"
_RAW_SQL = "COALESCE(CAST(CAST(deductible_amt AS BIGINT) AS VARCHAR), '<null>')"
_D_BANDS = "CASE WHEN deductible_amt IS NULL THEN '<null>' WHEN deductible_amt < 750 THEN '01. < 750' WHEN deductible_amt < 1500 THEN '02. 750 to 1.5K' ELSE '03. >= 1.5K' END"
_D_HALF = "CASE WHEN deductible_amt IS NULL THEN '<null>' WHEN deductible_amt < 1000 THEN '01. < 1K' ELSE '02. >= 1K' END"


@query("binning_scores", """SELECT var_a AS scheme, COUNT(*) AS n_bins, COUNT(*) FILTER (claims >= 10) AS n_credible,
ROUND(sqrt(SUM(weight * ln(relativity) * ln(relativity)) FILTER (claims >= 10 AND relativity > 0) / SUM(weight) FILTER (claims >= 10 AND relativity > 0)), 6) AS signal,
ROUND(MAX(relativity) FILTER (claims >= 10 AND relativity > 0) / MIN(relativity) FILTER (claims >= 10 AND relativity > 0), 6) AS spread, ROUND(SUM(weight) FILTER (claims >= 10) / SUM(weight), 6) AS credible_weight,
CASE var_a WHEN 'bands' THEN 'custom, 3 bins [750, 1.5K]' WHEN 'half' THEN 'custom, 2 bins [1K]' ELSE 'raw levels' END AS cuts FROM oneway GROUP BY var_a""",
       with_=ctes("loss_ratio", {"(raw levels)": _RAW_SQL, "bands": _D_BANDS, "half": _D_HALF}, max_levels=200))
def binning_scores(spark, sf):
    schemes = [Binning("deductible_amt", "bands", "custom", cuts=(750, 1500)), Binning("deductible_amt", "half", "custom", cuts=(1000,))]
    return tg.score_binnings(demo_book(spark, sf, "deductible_amt"), "deductible_amt", schemes, "loss_ratio", CFG)


@query("level_counts", "SELECT variable, TRUE AS close FROM (SELECT UNNEST(['src', 'coverage', 'class_cd', 'policy_no', 'exp_date', 'pol_yr']) AS variable) WHERE EXISTS (SELECT 1 FROM book)")
def level_counts(spark, sf):
    """Sketch counts against exact ones: within 10% (the sketch's standard error is 5%)."""
    book, names = demo_book(spark, sf, "coverage class_cd policy_no exp_date pol_yr"), ["src", "coverage", "class_cd", "policy_no", "exp_date", "pol_yr"]
    approx = tg.level_counts(book, names).unpivot([], names, "variable", "approx")
    exact = book.population().agg(*[F.count_distinct(n).alias(n) for n in names]).unpivot([], names, "variable", "exact")
    return approx.join(exact, "variable").select("variable", (F.abs(F.col("approx") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))


@query("default_base", "SELECT b AS expo_base FROM base", with_=BASE)
def default_base(spark, sf):
    book = demo_book(spark, sf)
    return book.population().where(F.col("expo_base") == tg.default_base(book)).select("expo_base").distinct()
