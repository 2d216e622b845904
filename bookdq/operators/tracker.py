"""Review tracker: what the data says about each column next to where its review stands."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookdq.functions.grading import is_flagged, severity, worst
from bookdq.functions.running import previous_value
from bookdq.operators.findings import FINDING_KEY

REOPEN_CHANGE = 0.10  # fixed value: relative change of a judged value that re-opens a column
LEGACY_STATUS = {"in_review": "actuary_review", "accepted_as_is": "no_issue"}  # fixed values
NOTE_LENGTH = 120


@dataclass(frozen=True)
class Stage:
    key: str
    label: str
    role: str | None = None
    done: bool = False
    in_flow: bool = True
    optional: bool = False
    requires_preprocessing: bool = False


# fixed values: the default review stages and roles
DEFAULT_ROLES = {"ds": "Data scientist", "actuary": "Actuary", "de": "Data engineer"}
DEFAULT_STAGES = (
    Stage("not_started", "Not started"),
    Stage("investigating", "DS investigating", "ds"),
    Stage("actuary_review", "Confirming with actuary", "actuary"),
    Stage("with_de", "With DE for fix", "de"),
    Stage("ds_validation", "DS validating fix", "ds"),
    Stage("actuary_signoff", "Actuary sign-off", "actuary", optional=True),
    Stage("resolved", "Resolved", done=True),
    Stage("no_issue", "No issue / accepted as is", done=True, in_flow=False),
    Stage("preprocess_in_modeling", "Preprocess in modeling", done=True, in_flow=False, requires_preprocessing=True),
    Stage("wont_fix", "Won't fix", done=True, in_flow=False),
)


@dataclass(frozen=True)
class Workflow:
    stages: tuple[Stage, ...] = DEFAULT_STAGES
    roles: tuple[tuple[str, str], ...] = tuple(DEFAULT_ROLES.items())

    def __post_init__(self):
        keys = [s.key for s in self.stages]
        roles = dict(self.roles)
        if len(keys) != len(set(keys)):
            raise ValueError("stage keys must be unique")
        if not keys or self.stages[0].done:
            raise ValueError("the first stage is where a column starts, so it cannot be a closed one")
        unknown = {s.role for s in self.stages if s.role} - set(roles)
        if unknown:
            raise ValueError(f"unknown role(s) {', '.join(sorted(unknown))}")

    @property
    def initial(self) -> str:
        return self.stages[0].key

    def table(self, spark: SparkSession) -> DataFrame:
        """The stages as a table: a row per configured stage, so joins broadcast it."""
        roles = dict(self.roles)
        rows = [(i, s.key, s.label, s.role, None if s.done or not s.role else roles[s.role], s.done, s.requires_preprocessing)
                for i, s in enumerate(self.stages)]
        return F.broadcast(spark.createDataFrame(
            rows, "stage_order int, status string, stage string, role string, waiting_on string, is_closed boolean, "
                  "requires_preprocessing boolean"))


# ---- data status ---------------------------------------------------------------------
def data_status(findings: DataFrame) -> DataFrame:
    """Worst status per (variable, check), the largest |value| at the highest rank that has one, and flagged rows."""
    rank = F.coalesce(severity(F.col("status")), F.lit(-1))
    size = F.abs("value")
    return (findings.groupBy("variable", "check")
            .agg(F.max(F.struct(rank, F.col("status"))).alias("_worst"),
                 F.max(F.when(size.isNotNull(), F.struct(rank.alias("r"), size.alias("v")))).alias("_value"),
                 F.count_if(is_flagged(F.col("status"))).alias("n_flagged"))
            .select("variable", "check", F.col("_worst.status").alias("data_status"),
                    F.col("_value.v").alias("worst_value"), "n_flagged"))


def snapshots(findings: DataFrame, closed: DataFrame, at: str) -> DataFrame:
    """Data status of the columns being closed (a frame with `variable`), as judged at that moment."""
    ds = data_status(findings).join(closed.select("variable").distinct(), "variable", "left_semi")
    return ds.select("variable", "check", F.col("data_status").alias("judged_status"),
                     F.col("worst_value").alias("judged_value"), F.lit(at).alias("judged_at"))


def reopened(is_done: Column, judged_status: Column, judged_value: Column, status: Column, value: Column) -> Column:
    """A closed column whose data is flagged and got more severe, or whose value moved by more than a tenth."""
    worse = severity(status) > F.coalesce(severity(judged_status), F.lit(0))
    moved = F.abs(value - judged_value) / F.greatest(F.abs(judged_value), F.lit(1e-12)) > REOPEN_CHANGE
    return F.coalesce(is_done & is_flagged(status) & judged_status.isNotNull(), F.lit(False)) & (
        F.coalesce(worse, F.lit(False)) | F.coalesce(moved, F.lit(False)))


# ---- review state --------------------------------------------------------------------
BEGIN = "status_begin"  # field of a folded row: the event that began the current run of one status


def fold_log(events: DataFrame) -> DataFrame:
    """The log (variable, field, value, role, author, at, event_id) folded to the rows its state needs, as a log again, with `n` = events behind a row.

    Kept per variable: the last event of each status, the event that began the current run of one status (field `status_begin`), the
    last assignee event of each role, and the last event of every other field. Folding a fold together with later events gives the
    fold of all events, so a stored fold stands for the log read so far. Each row is a map-side aggregate; a variable with a
    long history is gathered nowhere, and the log meets only a table of one row a variable. A null status is a status like others.
    """
    legacy = F.create_map(*[F.lit(x) for kv in LEGACY_STATUS.items() for x in kv])
    n = F.col("n") if "n" in events.columns else F.lit(1)
    is_status = F.col("field").isin("status", BEGIN)
    log = events.select(
        "variable", F.when(is_status, F.lit("status")).otherwise(F.col("field")).alias("field"),
        F.when(is_status, F.coalesce(legacy[F.col("value")], F.col("value"))).otherwise(F.col("value")).alias("value"),
        F.when(F.col("field") == "assignee", F.col("role")).alias("role"), "author", "at", "event_id",
        F.when(F.col("field") == BEGIN, 0).otherwise(n).cast("long").alias("n"))
    event = F.struct("at", "event_id", "value", "author")
    last = (log.groupBy("variable", "field", "role", F.when(F.col("field") == "status", F.col("value")).alias("_kind"))
            .agg(F.max(event).alias("_e"), F.sum("n").alias("n")))
    newest = Window.partitionBy("variable").orderBy(F.col("_e").desc())  # a row a status; Spark keeps two of them
    two = last.where("field = 'status'").withColumn("_rank", F.row_number().over(newest)).where("_rank <= 2")
    edge = two.groupBy("variable").agg(F.max(F.when(F.col("_rank") == 1, F.struct("_kind"))).alias("_now"),
                                       F.max(F.when(F.col("_rank") == 2, F.struct("_e.at", "_e.event_id"))).alias("_other"))
    run = (F.col("value").eqNullSafe(F.col("_now._kind"))
           & (F.col("_other").isNull() | (F.struct("at", "event_id") > F.col("_other"))))
    begin = (log.where("field = 'status'").join(edge, "variable").where(run).groupBy("variable").agg(F.min(event).alias("_e"))
             .select("variable", F.lit(BEGIN).alias("field"), F.lit(None).cast("string").alias("role"), "_e", F.lit(0).cast("long").alias("n")))
    return last.drop("_kind").unionByName(begin).select("variable", "field", "_e.value", "role", "_e.author", "_e.at", "_e.event_id", "n")


def fold_later(folded: DataFrame, events: DataFrame) -> DataFrame:
    """The fold of a stored fold and of the events after its newest one; only those are read (the filter on `at` reaches the scan).

    The log is appended in the order (at, event_id): an event older than the newest one of the fold counts as folded.
    """
    mark = folded.agg(F.max(F.struct("at", "event_id")).alias("m")).first()["m"]
    if mark is None:
        return fold_log(events)
    at, event_id = F.lit(mark["at"]), F.lit(mark["event_id"])
    later = events.where((F.col("at") >= at) & ((F.col("at") > at) | (F.col("event_id") > event_id)))
    return fold_log(later.withColumn("n", F.lit(1).cast("long")).select(*folded.columns).unionByName(folded))


def review_state(events: DataFrame) -> DataFrame:
    """Current state per variable from an append-only log (variable, field, value, role, author, at, event_id)."""
    return state_of_fold(fold_log(events))


def state_of_fold(folded: DataFrame) -> DataFrame:
    """Current state per variable from a folded log. Fields: `status`, `assignee` (with a role; an empty value clears it), `label`, `note`, `step`.

    A status repeated by a later event does not restart the clock: `status_since` is the begin of its run.
    """
    when = F.struct("at", "event_id")

    def latest(field: str) -> Column:
        return F.max_by("value", F.when(F.col("field") == field, when))

    def number(field: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("field") == field, F.col("n"))), F.lit(0))

    who = F.when((F.col("field") == "assignee") & (F.col("value") != "") & F.col("role").isNotNull(), F.struct("role", "value"))
    people = F.map_from_entries(F.collect_list(who))  # a row a role
    return folded.groupBy("variable").agg(
        latest("label").alias("label"), latest("status").alias("status"),
        F.max(F.when(F.col("field") == BEGIN, F.col("at"))).alias("status_since"),
        F.when(F.count(who) > 0, people).alias("assignees"), number("note").alias("n_notes"), number("step").alias("n_steps"),
        F.substring(latest("note"), 1, NOTE_LENGTH).alias("last_note"), F.max("at").alias("updated_at"), F.max_by("author", when).alias("updated_by"))


def status_changes(events: DataFrame) -> DataFrame:
    """The status log as rows: every change with the status before it (repeats of the same status are no change)."""
    log = events.where(F.col("field") == "status").select("variable", "value", "author", "at", "event_id")
    log = previous_value(log, ["variable"], ["at", "event_id"], "value", "from_status")
    return (log.where(~F.col("from_status").eqNullSafe(F.col("value")))
            .select("variable", "from_status", F.col("value").alias("to_status"), F.col("author").alias("by"), "at"))


# ---- tracker -------------------------------------------------------------------------
def tracker_by_check(findings: DataFrame, state: DataFrame, judged: DataFrame, checks: Sequence[str],
                     workflow: Workflow = Workflow()) -> DataFrame:
    """One row per column and check that has data or a snapshot."""
    spark = findings.sparkSession
    ds = data_status(findings.where((F.col("variable") != "_check") & F.col("check").isin(*checks)))
    both = ds.join(judged.where(F.col("check").isin(*checks)), ["variable", "check"], "full")
    df = (both.join(state.select("variable", "status"), "variable", "left")
          .withColumn("status", F.coalesce("status", F.lit(workflow.initial)))
          .join(workflow.table(spark).select("status", "is_closed"), "status", "left"))
    closed = F.coalesce("is_closed", F.lit(False))
    return df.select("variable", "check", "data_status", "worst_value", F.coalesce("n_flagged", F.lit(0)).alias("n_flagged"),
                     "status", closed.alias("done"),
                     reopened(closed, F.col("judged_status"), F.col("judged_value"), F.col("data_status"),
                              F.col("worst_value")).alias("reopened"))


def tracker(columns: DataFrame, by_check: DataFrame, state: DataFrame, as_of: str, workflow: Workflow = Workflow()) -> DataFrame:
    """One row per column: stage, who holds it, data status, re-opened or closed, time in status.

    `columns` (variable) are the book's columns; columns only known from findings or reviews are added.
    """
    spark = by_check.sparkSession
    everything = (columns.select("variable").unionByName(by_check.select("variable")).unionByName(state.select("variable"))
                  .where(F.col("variable") != "_check").distinct())
    data = by_check.groupBy("variable").agg(worst(F.col("data_status")).alias("data_status"),
                                            F.sum("n_flagged").alias("n_flagged"), F.bool_or("reopened").alias("reopened"))
    df = everything.join(data, "variable", "left").join(state, "variable", "left")
    df = df.withColumn("status", F.coalesce("status", F.lit(workflow.initial))).join(workflow.table(spark), "status", "left")
    again = F.coalesce("reopened", F.lit(False))
    days = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("status_since").cast("timestamp"))) / 86400
    return df.select(
        "variable", "label", "status", F.coalesce("stage", F.concat("status", F.lit(" (unknown)"))).alias("stage"), "waiting_on",
        F.try_element_at("assignees", F.col("role")).alias("assignee"),
        *[F.try_element_at("assignees", F.lit(r)).alias(f"{r}_assignee") for r, _ in workflow.roles],
        "data_status", F.coalesce("n_flagged", F.lit(0)).alias("n_flagged"), again.alias("reopened"),
        (F.coalesce("is_closed", F.lit(False)) & ~again).alias("done"), F.round(days, 1).alias("days_in_status"),
        F.coalesce("n_steps", F.lit(0)).alias("n_steps"), F.coalesce("n_notes", F.lit(0)).alias("n_notes"), "last_note",
        "updated_at", "updated_by")


def tracker_kpis(board: DataFrame, workflow: Workflow = Workflow()) -> DataFrame:
    """One row: columns, closed, flagged but not started, re-opened, and how many wait on each role."""
    return board.agg(
        F.count(F.lit(1)).alias("columns"), F.count_if("done").alias("closed"),
        F.count_if((F.col("status") == workflow.initial) & (F.col("n_flagged") > 0)).alias("flagged_not_started"),
        F.count_if("reopened").alias("reopened"),
        *[F.count_if(F.col("waiting_on") == label).alias(f"with_{role}") for role, label in workflow.roles])


def progress_by_check(by_check: DataFrame) -> DataFrame:
    return by_check.groupBy("check").agg(F.count(F.lit(1)).alias("in_scope"),
                                         F.count_if(F.col("done") & ~F.col("reopened")).alias("closed"),
                                         F.count_if(is_flagged(F.col("data_status"))).alias("flagged"))


def stage_counts(board: DataFrame, workflow: Workflow = Workflow()) -> DataFrame:
    """Columns per stage, in hand-off order."""
    counted = board.groupBy("status").agg(F.count(F.lit(1)).alias("columns"), F.count_if(F.col("n_flagged") > 0).alias("flagged"),
                                          F.sum("n_steps").alias("n_steps"))
    return (counted.join(workflow.table(board.sparkSession), "status", "left")
            .select("status", F.coalesce("stage", "status").alias("stage"), "stage_order", "columns", "flagged", "n_steps")
            .orderBy(F.col("stage_order").asc_nulls_last(), "status"))


def status_grid(by_check: DataFrame, checks: Sequence[str]) -> DataFrame:
    """Column x check grid of data statuses."""
    return by_check.groupBy("variable").pivot("check", list(checks)).agg(F.first("data_status"))


def flagged_by_source(findings: DataFrame, source: str) -> DataFrame:
    """Flagged findings per check and source; findings of no single source count as cross-source."""
    where = F.coalesce(F.try_element_at("dims", F.lit(source)), F.lit("ALL / cross-source"))
    return (findings.where(is_flagged(F.col("status"))).groupBy("check", where.alias("source"))
            .agg(F.count(F.lit(1)).alias("n_flagged")))


def flagged_matrix(findings: DataFrame, source: str, sources: Sequence[str]) -> DataFrame:
    """Check x source counts of flagged findings; sources that are not named are summed in `(other sources)`."""
    names = [*sources, "ALL / cross-source"]
    counts = [F.coalesce(F.sum(F.when(F.col("source") == n, F.col("n_flagged"))), F.lit(0)).alias(n) for n in names]
    rest = F.coalesce(F.sum(F.when(~F.col("source").isin(*names), F.col("n_flagged"))), F.lit(0)).alias("(other sources)")
    return flagged_by_source(findings, source).groupBy("check").agg(*counts, rest)


def run_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Findings newly flagged and no longer flagged between two runs, by their five key columns (null-safe)."""
    key = list(FINDING_KEY)
    now, before = (f.where(is_flagged(F.col("status"))).select(*key) for f in (current, previous))

    def only(a: DataFrame, b: DataFrame, change: str) -> DataFrame:
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
        return a.alias("a").join(b.alias("b"), on, "left_anti").select(F.lit(change).alias("change"), *key)

    return only(now, before, "newly flagged").unionByName(only(before, now, "no longer flagged"))
