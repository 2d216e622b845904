from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookdq.operators import missing, rules
from bookdq.operators import tracker as tk
from bookdq.operators.findings import concat
from bookdq.plans.registry import CheckResult, checks
from bookdq.plans.refresh import run_checks
from bookdq.plans.sizing import materialize, shared_folder
from bookdq.sources.sinks import FindingsStore, latest_run, run_history, run_trend
from demo.book import demo_book, table
from demo.queries.keys_values import BOOK_MISSING, RULES, RULES_CTE, RULES_NEED
from demo.registry import query

NEED = RULES_NEED + " zip_cd class_cd"
CHECKS = ("business_rules", "missing_rate")
RUNS = (("run1", "2024-01-10T00:00:00Z", "eff_date < DATE '1999-01-01'"), ("run2", "2024-02-10T00:00:00Z", "true"))


def stored_runs(spark, sf) -> DataFrame:
    """Two runs of two checks: policies before 1999, then the whole book."""
    book = demo_book(spark, sf, NEED).stored(["src", "premium_amt", "loss_amt", "claim_cnt", *NEED.split()])  # the checks of both runs read it
    parts = []
    for run_id, run_ts, where in RUNS:
        from bookdq import Book
        scoped = Book(book.spec, book.raw.where(F.expr(where)))
        found = concat([rules.run(scoped, RULES).findings, missing.run(scoped, BOOK_MISSING).findings], spark)
        parts.append(found.withColumns({"run_id": F.lit(run_id), "run_ts": F.lit(run_ts), "profile": F.lit("default"), "filters": F.lit("" if run_id == "run1" else "all#1")}))
    return materialize(reduce(DataFrame.unionByName, parts), "runs")


def _findings_sql(run: int) -> str:
    where = f"WHERE {RUNS[run][2]}"
    part = RULES_CTE.replace("violations AS (", "", 1)[:-1].replace("FROM book", f"FROM (SELECT * FROM book {where})")
    grade = "CASE WHEN r > fail THEN 'fail' WHEN r > warn THEN 'warn' ELSE 'pass' END"
    blank = "COUNT(*) FILTER ({c} IS NULL OR trim({c}) IN ('', 'UNK'))"
    src = f"(SELECT * FROM book {where})"
    return f"""SELECT '{RUNS[run][0]}' AS run_id, '{RUNS[run][1]}' AS run_ts, 'business_rules' AS "check", variable, rule AS item, segment, 'violation_rate' AS metric, violation_rate AS value, status, src AS source FROM ({part})
UNION ALL SELECT '{RUNS[run][0]}', '{RUNS[run][1]}', 'missing_rate', variable, item, segment, 'missing_rate', r, {grade}, source FROM (
SELECT 'zip_cd' AS variable, NULL AS item, 'src=' || src AS segment, CAST({blank.format(c="zip_cd")} AS DOUBLE) / COUNT(*) AS r, 0.01 AS warn, 0.05 AS fail, src AS source FROM {src} GROUP BY src
UNION ALL SELECT 'class_cd', NULL, 'src=' || src, CAST(COUNT(*) FILTER (class_cd IS NULL OR trim(class_cd) = '') AS DOUBLE) / COUNT(*), 0.05, 0.2, src FROM {src} GROUP BY src
UNION ALL SELECT 'location_id', 'src <> ''R''', 'src=' || src, CAST(COUNT(*) FILTER (location_id IS NULL) AS DOUBLE) / COUNT(*), 0.05, 0.2, src FROM {src} WHERE src <> 'R' GROUP BY src
UNION ALL SELECT 'deductible_amt', NULL, 'ALL', CAST(COUNT(*) FILTER (deductible_amt IS NULL) AS DOUBLE) / COUNT(*), 0.05, 0.2, NULL FROM {src})"""


FINDINGS = f"run1 AS ({_findings_sql(0)}), run2 AS ({_findings_sql(1)}), runs AS (SELECT * FROM run1 UNION ALL SELECT * FROM run2)"
_RANK = "CASE status WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"


def _status_cte(name: str, run: str) -> str:
    return f"""{name} AS (SELECT variable, "check", arg_max(status, {_RANK}) AS data_status, (arg_max(abs(value), ({_RANK}, abs(value))) FILTER (value IS NOT NULL)) AS worst_value,
COUNT(*) FILTER (status IN ('warn', 'fail')) AS n_flagged FROM {run} GROUP BY variable, "check")"""


# ---- the review log: the event stream read as reviewers' actions ---------------------
STAGE_KEYS = [s.key for s in tk.DEFAULT_STAGES]
VARIABLES = ["exp_date", "loss_amt", "deductible_amt", "zip_cd", "class_cd", "premium_amt", "location_id", "coverage"]
_PICK_VARIABLE = "[" + ", ".join(f"'{v}'" for v in VARIABLES) + "]"
_PICK_STAGE = "[" + ", ".join(f"'{s}'" for s in STAGE_KEYS) + "]"


def review_log(spark, sf) -> DataFrame:
    events = table(spark, sf, "events")
    pick = lambda names, i: F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    field = F.create_map(*[F.lit(x) for x in ("purchase", "status", "signup", "assignee", "view", "label", "click", "note", "error", "step")])[F.col("event_type")]
    value = (F.when(field == "status", pick(STAGE_KEYS, F.floor(F.col("value")) % 10))
             .when(field == "assignee", F.when(F.col("value") < 10, F.lit("")).otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"))))
             .otherwise(F.concat(F.lit("text "), F.col("event_id").cast("string"))))
    return events.select(pick(VARIABLES, F.col("user_id") % 8).alias("variable"), field.alias("field"), value.alias("value"),
                         F.when(field == "assignee", pick(["ds", "actuary", "de"], F.col("event_id") % 3)).alias("role"),
                         F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"), F.col("ts").alias("at"), "event_id")


LOG = f"""log AS (SELECT ({_PICK_VARIABLE})[user_id % 8 + 1] AS variable, field, CASE field WHEN 'status' THEN ({_PICK_STAGE})[CAST(floor(value) AS BIGINT) % 10 + 1]
WHEN 'assignee' THEN CASE WHEN value < 10 THEN '' ELSE 'user' || user_id END ELSE 'text ' || event_id END AS value, CASE WHEN field = 'assignee' THEN (['ds', 'actuary', 'de'])[event_id % 3 + 1] END AS role,
'user' || user_id AS author, ts AS "at", event_id FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'status' WHEN 'signup' THEN 'assignee' WHEN 'view' THEN 'label' WHEN 'click' THEN 'note' ELSE 'step' END AS field FROM events))"""
STEP_LOG = LOG + """, steps AS (SELECT variable, 'cap' AS op, '{"upper_pct":"0.99"}' AS params, CASE WHEN event_id % 2 = 0 THEN 'A, N' ELSE 'all' END AS sources, value AS rationale, author, "at" AS added_at FROM log WHERE field = 'step')"""
STATE = LOG + """, changes AS (SELECT * FROM (SELECT *, LAG(value) OVER (PARTITION BY variable ORDER BY "at", event_id) AS from_status FROM log WHERE field = 'status') WHERE from_status IS DISTINCT FROM value),
who AS (SELECT * FROM (SELECT variable, role, arg_max(value, ("at", event_id)) AS person FROM log WHERE field = 'assignee' GROUP BY variable, role) WHERE person <> ''),
state AS (SELECT variable, arg_max(value, ("at", event_id)) FILTER (field = 'label') AS label, arg_max(value, ("at", event_id)) FILTER (field = 'status') AS status,
COUNT(*) FILTER (field = 'note') AS n_notes, COUNT(*) FILTER (field = 'step') AS n_steps, arg_max(value, ("at", event_id)) FILTER (field = 'note') AS last_note, MAX("at") AS updated_at, arg_max(author, ("at", event_id)) AS updated_by
FROM log GROUP BY variable),
since AS (SELECT variable, MAX("at") AS status_since FROM changes GROUP BY variable)"""


def state_of(spark, sf) -> DataFrame:
    return tk.review_state(review_log(spark, sf))


def steps_of(spark, sf) -> DataFrame:
    step = review_log(spark, sf).where("field = 'step'")
    return step.select("variable", F.lit("cap").alias("op"), F.create_map(F.lit("upper_pct"), F.lit("0.99")).alias("params"),
                       F.when(F.col("event_id") % 2 == 0, F.array(F.lit("A"), F.lit("N"))).otherwise(F.array().cast("array<string>")).alias("sources"),
                       F.col("value").alias("rationale"), "author", F.col("at").alias("added_at"))


STATE_ROWS = """SELECT s.variable, label, status, status_since, n_notes, n_steps, last_note, updated_at, updated_by, MAX(person) FILTER (role = 'ds') AS ds, MAX(person) FILTER (role = 'actuary') AS actuary,
MAX(person) FILTER (role = 'de') AS de FROM state s JOIN since USING (variable) LEFT JOIN who USING (variable) GROUP BY ALL"""


def with_people(state: DataFrame) -> DataFrame:
    people = [F.try_element_at("assignees", F.lit(r)).alias(r) for r in ("ds", "actuary", "de")]
    return state.select("*", *people).drop("assignees")


@query("review_state", STATE_ROWS, book=False, with_=STATE)
def review_state(spark, sf):
    return with_people(state_of(spark, sf))


@query("review_state_increment", STATE_ROWS, book=False, with_=STATE)
def review_state_increment(spark, sf):
    """The first half of the period is folded and stored; the state comes from that and the events after it."""
    log = review_log(spark, sf)
    half = log.agg((F.unix_micros(F.min("at").cast("timestamp")) / 2 + F.unix_micros(F.max("at").cast("timestamp")) / 2).cast("long").alias("at")).first()["at"]
    early = materialize(tk.fold_log(log.where(F.unix_micros(F.col("at").cast("timestamp")) <= F.lit(half))), "review-log")
    return with_people(tk.state_of_fold(tk.fold_later(early, log)))


@query("review_status_log", 'SELECT variable, from_status, value AS to_status, author AS "by", "at" FROM changes', book=False, with_=STATE)
def status_log(spark, sf):
    return tk.status_changes(review_log(spark, sf))


# ---- findings over runs --------------------------------------------------------------
@query("data_status", f'SELECT variable, "check", data_status, ROUND(worst_value, 6) AS worst_value, n_flagged FROM ds', with_=f"{FINDINGS}, {_status_cte('ds', 'run2')}")
def data_status(spark, sf):
    return tk.data_status(latest_run(stored_runs(spark, sf)))


@query("run_history", """SELECT run_id, run_ts, COUNT(*) AS n_findings, COUNT(*) FILTER (status = 'warn') AS n_warn, COUNT(*) FILTER (status = 'fail') AS n_fail,
CASE run_id WHEN 'run1' THEN '' ELSE 'all#1' END AS filters FROM runs GROUP BY run_id, run_ts""", with_=FINDINGS)
def history(spark, sf):
    return run_history(stored_runs(spark, sf))


@query("run_trend", """SELECT run_ts, 'n_warn' AS variable, COUNT(*) FILTER (status = 'warn') AS value FROM runs GROUP BY run_ts UNION ALL SELECT run_ts, 'n_fail', COUNT(*) FILTER (status = 'fail') FROM runs GROUP BY run_ts""", with_=FINDINGS)
def trend(spark, sf):
    return run_trend(run_history(stored_runs(spark, sf)))


@query("latest_run", 'SELECT run_id, "check", variable, item, segment, ROUND(value, 6) AS value, status FROM run1', with_=FINDINGS)
def previous_run(spark, sf):
    return latest_run(stored_runs(spark, sf), offset=1).select("run_id", "check", "variable", "item", "segment", "value", "status")


_FLAGGED = "status IN ('warn', 'fail')"
_SAME = " AND ".join(f'a."{k}" IS NOT DISTINCT FROM b."{k}"' for k in ("check", "variable", "item", "segment", "metric"))


@query("run_diff", f"""SELECT 'newly flagged' AS change, "check", variable, item, segment, metric FROM run2 a WHERE {_FLAGGED} AND NOT EXISTS (SELECT 1 FROM run1 b WHERE b.{_FLAGGED} AND {_SAME})
UNION ALL SELECT 'no longer flagged', "check", variable, item, segment, metric FROM run1 a WHERE {_FLAGGED} AND NOT EXISTS (SELECT 1 FROM run2 b WHERE b.{_FLAGGED} AND {_SAME})""", with_=FINDINGS)
def run_diff(spark, sf):
    runs = stored_runs(spark, sf)
    return tk.run_changes(latest_run(runs), latest_run(runs, 1))


@query("flagged_by_source", f"""SELECT "check", COALESCE(source, 'ALL / cross-source') AS source, COUNT(*) AS n_flagged FROM run2 WHERE {_FLAGGED} GROUP BY ALL""", with_=FINDINGS)
def flagged(spark, sf):
    return tk.flagged_by_source(latest_run(stored_runs(spark, sf)), "src")


@query("flagged_matrix", f"""SELECT "check", COUNT(*) FILTER (source = 'A') AS "A", COUNT(*) FILTER (source = 'N') AS "N", COUNT(*) FILTER (source NOT IN ('A', 'N')) AS "(other sources)",
COUNT(*) FILTER (source IS NULL) AS "ALL / cross-source" FROM run2 WHERE {_FLAGGED} GROUP BY "check" """, with_=FINDINGS)
def flagged_matrix(spark, sf):
    return tk.flagged_matrix(latest_run(stored_runs(spark, sf)), "src", ("A", "N"))


# ---- tracker -------------------------------------------------------------------------
AS_OF = "2024-02-15 00:00:00"
_CLOSED = "('resolved', 'no_issue', 'preprocess_in_modeling', 'wont_fix')"
TRACK = f"""{FINDINGS}, {STATE}, {_status_cte("ds", "run2")}, {_status_cte("before", "run1")}, judged AS (SELECT b.* FROM before b JOIN state s ON s.variable = b.variable WHERE s.status IN {_CLOSED}),
long AS (SELECT variable, "check", data_status, worst_value, COALESCE(n_flagged, 0) AS n_flagged, status, status IN {_CLOSED} AS done, COALESCE(status IN {_CLOSED} AND data_status IN ('warn', 'fail') AND js IS NOT NULL
AND (COALESCE(list_position(['pass', 'info', 'warn', 'fail'], data_status) > list_position(['pass', 'info', 'warn', 'fail'], js), FALSE) OR COALESCE(abs(worst_value - jv) / GREATEST(abs(jv), 1e-12) > 0.1, FALSE)), FALSE) AS reopened
FROM (SELECT COALESCE(ds.variable, j.variable) AS variable, COALESCE(ds."check", j."check") AS "check", ds.data_status, ds.worst_value, ds.n_flagged, j.data_status AS js, j.worst_value AS jv
FROM ds FULL JOIN judged j ON ds.variable = j.variable AND ds."check" = j."check") d LEFT JOIN (SELECT variable AS v, status FROM state) s ON s.v = d.variable),
long2 AS (SELECT * REPLACE (COALESCE(status, 'not_started') AS status, COALESCE(done, FALSE) AS done) FROM long),
stages AS (SELECT UNNEST({STAGE_KEYS}) AS status, UNNEST({[s.label.replace("'", "’") for s in tk.DEFAULT_STAGES]}) AS stage, UNNEST({[s.role or "" for s in tk.DEFAULT_STAGES]}) AS role,
UNNEST({[(tk.DEFAULT_ROLES[s.role] if s.role and not s.done else "") for s in tk.DEFAULT_STAGES]}) AS waiting_on),
board AS (SELECT c.variable, st.label, COALESCE(st.status, 'not_started') AS status, replace(g.stage, '’', '''') AS stage, NULLIF(g.waiting_on, '') AS waiting_on, w.person AS assignee, d.data_status, COALESCE(d.n_flagged, 0) AS n_flagged,
COALESCE(d.reopened, FALSE) AS reopened, COALESCE(st.status, 'not_started') IN {_CLOSED} AND NOT COALESCE(d.reopened, FALSE) AS done, ROUND((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(status_since))) / 86400, 1) AS days_in_status,
COALESCE(n_steps, 0) AS n_steps, COALESCE(n_notes, 0) AS n_notes, last_note, updated_by
FROM (SELECT UNNEST(['src', 'premium_amt', 'exp_date', 'coverage']) AS variable UNION SELECT variable FROM long2 UNION SELECT variable FROM state) c
LEFT JOIN state st ON st.variable = c.variable LEFT JOIN since si ON si.variable = c.variable
LEFT JOIN stages g ON g.status = COALESCE(st.status, 'not_started') LEFT JOIN who w ON w.variable = c.variable AND w.role = g.role
LEFT JOIN (SELECT variable, arg_max(data_status, list_position(['pass', 'info', 'warn', 'fail'], data_status)) AS data_status, CAST(SUM(n_flagged) AS BIGINT) AS n_flagged, bool_or(reopened) AS reopened FROM long2 GROUP BY variable) d ON d.variable = c.variable)"""


def by_check_of(spark, sf) -> tuple[DataFrame, DataFrame]:
    runs, state = stored_runs(spark, sf), state_of(spark, sf)
    closed = state.join(tk.Workflow().table(spark).where("is_closed"), "status", "left_semi")
    judged = tk.snapshots(latest_run(runs, 1), closed, RUNS[0][1])
    return tk.tracker_by_check(latest_run(runs), state, judged, CHECKS), state


def board_of(spark, sf) -> DataFrame:
    by_check, state = by_check_of(spark, sf)
    columns = spark.createDataFrame([(c,) for c in ("src", "premium_amt", "exp_date", "coverage")], "variable string")
    return tk.tracker(columns, by_check, state, AS_OF)


@query("snapshots", """SELECT variable, "check", data_status AS judged_status, ROUND(worst_value, 6) AS judged_value FROM judged""", with_=TRACK)
def snapshots(spark, sf):
    closed = state_of(spark, sf).join(tk.Workflow().table(spark).where("is_closed"), "status", "left_semi")
    return tk.snapshots(latest_run(stored_runs(spark, sf), 1), closed, RUNS[0][1]).drop("judged_at")


@query("tracker_by_check", """SELECT variable, "check", data_status, ROUND(worst_value, 6) AS worst_value, n_flagged, status, done, reopened FROM long2""", with_=TRACK)
def tracker_by_check(spark, sf):
    return by_check_of(spark, sf)[0]


@query("tracker", "SELECT * FROM board", with_=TRACK)
def tracker(spark, sf):
    return board_of(spark, sf).drop("ds_assignee", "actuary_assignee", "de_assignee", "updated_at")


@query("tracker_kpis", """SELECT COUNT(*) AS columns, COUNT(*) FILTER (done) AS closed, COUNT(*) FILTER (status = 'not_started' AND n_flagged > 0) AS flagged_not_started, COUNT(*) FILTER (reopened) AS reopened,
COUNT(*) FILTER (waiting_on = 'Data scientist') AS with_ds, COUNT(*) FILTER (waiting_on = 'Actuary') AS with_actuary, COUNT(*) FILTER (waiting_on = 'Data engineer') AS with_de FROM board""", with_=TRACK)
def kpis(spark, sf):
    return tk.tracker_kpis(board_of(spark, sf))


@query("tracker_progress", """SELECT "check", COUNT(*) AS in_scope, COUNT(*) FILTER (done AND NOT reopened) AS closed, COUNT(*) FILTER (data_status IN ('warn', 'fail')) AS flagged FROM long2 GROUP BY "check" """, with_=TRACK)
def progress(spark, sf):
    return tk.progress_by_check(by_check_of(spark, sf)[0])


@query("tracker_stages", "SELECT b.status, b.stage, CAST(list_position(" + str(STAGE_KEYS) + ", b.status) - 1 AS INTEGER) AS stage_order, COUNT(*) AS columns, COUNT(*) FILTER (n_flagged > 0) AS flagged, CAST(SUM(n_steps) AS BIGINT) AS n_steps FROM board b GROUP BY ALL", with_=TRACK)
def stages(spark, sf):
    return tk.stage_counts(board_of(spark, sf))


@query("tracker_grid", """SELECT variable, MAX(data_status) FILTER ("check" = 'business_rules') AS business_rules, MAX(data_status) FILTER ("check" = 'missing_rate') AS missing_rate FROM long2 GROUP BY variable""", with_=TRACK)
def grid(spark, sf):
    return tk.status_grid(by_check_of(spark, sf)[0], CHECKS)


# ---- refresh -------------------------------------------------------------------------
@query("refresh_findings", 'SELECT "check", variable, item, segment, metric, ROUND(value, 6) AS value, status FROM run2', with_=FINDINGS)
def refresh_findings(spark, sf):
    found, errors = run_checks(demo_book(spark, sf, NEED), {"business_rules": RULES, "missing_rate": BOOK_MISSING})
    assert not errors, errors
    return found.select("check", "variable", "item", "segment", "metric", "value", "status")


@query("refresh_with_error", """SELECT "check", variable, metric, status, COUNT(*) AS n FROM (SELECT "check", variable, metric, status FROM run2 WHERE "check" = 'business_rules'
UNION ALL SELECT 'broken_rules', '_check', 'error', 'fail') GROUP BY ALL""", with_=FINDINGS)
def refresh_with_error(spark, sf):
    """A check that cannot run leaves one failed finding; the others are complete."""
    registered = checks()
    if "broken_rules" not in registered:
        from bookdq.plans.registry import check

        @check("broken_rules", rules.RulesConfig, "Broken", order=26)
        def broken(book, cfg) -> CheckResult:
            return rules.run(book, cfg)

    bad = rules.RulesConfig(rules=(rules.BusinessRule("x", "no_such_column > 0"),))
    found, _ = run_checks(demo_book(spark, sf, NEED), {"business_rules": RULES, "broken_rules": bad})
    return found.groupBy("check", "variable", "metric", "status").agg(F.count(F.lit(1)).alias("n"))


@query("findings_store", """SELECT run_id, COUNT(*) AS n_findings, COUNT(*) FILTER (status IN ('warn', 'fail')) AS n_flagged FROM runs GROUP BY run_id""", with_=FINDINGS)
def store(spark, sf):
    """Runs written to and read from the history; the second is written twice, as a retried job would."""
    import uuid
    runs = stored_runs(spark, sf)
    history_ = FindingsStore(spark, path=f"{shared_folder(spark)}/bookdq/history-{uuid.uuid4().hex}")
    for run_id, run_ts in (("run1", RUNS[0][1]), ("run2", RUNS[1][1]), ("run2", RUNS[1][1])):
        one = runs.where(F.col("run_id") == run_id).drop("run_id", "run_ts", "profile", "filters")
        history_.append(one, run_id, run_ts, "default")
    return history_.load().groupBy("run_id").agg(F.count(F.lit(1)).alias("n_findings"), F.count_if(F.col("status").isin("warn", "fail")).alias("n_flagged"))


@query("findings_table", """SELECT run_id, COUNT(*) AS n_findings, COUNT(*) FILTER (status IN ('warn', 'fail')) AS n_flagged FROM runs WHERE run_id IN ('run1', 'run2') GROUP BY run_id""", with_=FINDINGS)
def findings_table(spark, sf):
    """Runs in a catalog table: a first attempt at the second run that failed half way, its retry, and a third run without a commit."""
    import uuid
    runs, name = stored_runs(spark, sf), f"history_{uuid.uuid4().hex}"
    history_ = FindingsStore(spark, table=name, location=f"{shared_folder(spark)}/bookdq/{name}")

    def of(run_id):
        return runs.where(F.col("run_id") == run_id).drop("run_id", "run_ts", "profile", "filters")

    history_.append(of("run1"), "run1", RUNS[0][1], "default")
    tags = {"run_id": F.lit("run2"), "run_ts": F.lit(RUNS[1][1]), "profile": F.lit("default"), "filters": F.lit("")}
    history_.stage(of("run2").where("status = 'warn'").withColumns(tags))
    history_.append(of("run2"), "run2", RUNS[1][1], "default")
    history_.append(of("run2"), "run2", RUNS[1][1], "default")
    history_.stage(of("run1").withColumns(tags | {"run_id": F.lit("run3")}))
    return history_.load().groupBy("run_id").agg(F.count(F.lit(1)).alias("n_findings"), F.count_if(F.col("status").isin("warn", "fail")).alias("n_flagged"))
