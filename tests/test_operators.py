"""Rules, transforms, binning, keys, configuration, sources, sinks, tracker and preparation on small inputs."""
from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from bookdq import Book, BookSpec, Measures, UnknownColumnError
from bookdq.functions.running import running_total
from bookdq.operators import distribution, keys, preflight, targets, tracker, values
from bookdq.operators.binning import Binning, edge_text, resolve
from bookdq.operators.filters import Listed, Rule, RuleSet, rule_impact
from bookdq.operators.summary import crosstab, summarize
from bookdq.operators.transforms import ColumnTransform, TransformSet, apply_transforms, transform_effect
from bookdq.plans.preprocessing import Step, agreed_steps, parse_mapping, run_pipeline
from bookdq.plans.registry import check, check_config, checks, deep_merge, from_dict
from bookdq.plans.sizing import collect_if_small, materialize, shared_folder
from bookdq.sources import FindingsStore, Sources, export_table, load_to_table, read_source, write_extract
from tests.fixture_book import settings


def tiny_book(spark, rows, schema, rules=None, transforms=None, sql_vars=None, **spec):
    base = dict(name="tiny", source="src", sources=("A", "B"), measures=Measures("premium", "premium", "premium", "premium", "src"), policy_key=("src",))
    return Book(BookSpec(**{**base, **spec}), spark.createDataFrame(rows, schema), rules, transforms, sql_vars)


# ---- three-valued logic --------------------------------------------------------------
# every pairing of a known and an unknown coverage with a listed, an unlisted and an unknown id; powers of two tell which rows are kept
STORE = [("store", "hit", 1), ("store", "miss", 2), ("store", None, 4), ("depot", "hit", 8), (None, "hit", 16), (None, "miss", 32), ("depot", None, 64)]
CONDITION = "covg = 'store' AND id IN (SELECT id FROM {{ listed }})"


def store_book(spark, rule):
    spark.createDataFrame([("hit",), (None,)], "id string").createOrReplaceTempView("store_list")
    return tiny_book(spark, STORE, "covg string, id string, premium long", RuleSet((rule,)), sql_vars={"listed": "store_list"}, source="covg")


def total(book):
    return book.population().agg(F.sum("premium")).first()[0]


def test_exclude_when_keeps_what_it_cannot_judge(spark):
    drop = dict(key="r", enabled=True)
    listed = {"is_listed": Listed("id", "{{ listed }}", "id")}
    assert total(store_book(spark, Rule(exclude_when="covg = 'store' AND is_listed", lists=listed, **drop))) == 127 - 1
    assert total(store_book(spark, Rule(exclude_when=CONDITION.replace("FROM {{ listed }}", "FROM {{ listed }} WHERE id IS NOT NULL"), **drop))) == 127 - 1
    # the keep form drops every row whose condition is unknown; a list without its null leaves these
    assert total(store_book(spark, Rule(expr="NOT (covg = 'store' AND is_listed)", lists=listed, **drop))) == 2 + 8 + 32 + 64


def test_rule_impact_counts_overlaps_once(spark):
    rules = RuleSet((Rule("a", enabled=True, exclude_when="id = 'hit'"), Rule("b", enabled=True, column="covg", op="eq", values=("store",)), Rule("c", exclude_when="premium > 20")))
    book = tiny_book(spark, STORE, "covg string, id string, premium long", rules, source="covg")
    got = {r["key"]: (r["rows_removed"], r["premium_removed"]) for r in rule_impact(book).collect()}
    assert got == {"a": (3, 25.0), "b": (4, 120.0), "c": (2, 96.0), "TOTAL": (5, 121.0)}
    assert total(book) == 127 - 121


def test_rules_are_strict(spark):
    for bad in (dict(key="Bad", column="x", values=("1",)), dict(key="x"), dict(key="x", column="c", expr="1=1"), dict(key="x", column="c", op="gt", values=("1", "2")),
                dict(key="x", column="c", op="in"), dict(key="x", column="c", op="like", values=("1",))):
        with pytest.raises(ValueError):
            Rule(**bad)
    with pytest.raises(ValueError):
        RuleSet((Rule("a", expr="true"), Rule("a", expr="false")))
    book = tiny_book(spark, [("A", 1.0)], "src string, premium double")
    for rule in (Rule("a", column="nope", op="is_null"), Rule("a", expr="src IN (SELECT x FROM {{ no_var }})")):
        with pytest.raises(ValueError):
            book.rules.validate(book, rule)


def test_numbers_compare_as_numbers(spark):
    rows = [("A", 1_000_000.0), ("A", 9.0), ("B", None)]
    for values, op, n in ((("1000000",), "in", 1), (("1000000.0",), "in", 1), (("10",), "gt", 1), (("9", "<null>"), "in", 2), (("9",), "not_in", 1), (("x",), "in", 0), (("<null>",), "not_in", 2)):
        book = tiny_book(spark, rows, "src string, premium double", RuleSet((Rule("r", enabled=True, column="premium", op=op, values=values),)))
        assert book.population().count() == n, (values, op)


def test_rules_fingerprint_ignores_order_and_profile_scopes():
    a, b = Rule("a", enabled=True, expr="x > 1"), Rule("b", enabled=True, expr="y > 1", profiles=("prod",))
    assert RuleSet((a, b)).fingerprint("prod") == RuleSet((b, a)).fingerprint("prod") != RuleSet((a,)).fingerprint("prod")
    assert RuleSet((a, b)).fingerprint("dev") == RuleSet((a,)).fingerprint("dev")
    assert RuleSet((a, b)).all_disabled().fingerprint("prod") == ""


# ---- transforms ----------------------------------------------------------------------
def transformed(spark, values, **kw):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in apply_transforms(df, [ColumnTransform("x", **kw)]).collect()]


@pytest.mark.parametrize("rest", ["keep", "null", "other"])
def test_steps_compose_as_written_out(spark, rest):
    """All spellings put together from blanks, a stem and blanks, against the four steps in plain Python."""
    spellings = ["".join(p) for p in itertools.product(("", "  ", "\t"), ("q", "é", "0q", "-3.5", "ninety"), ("", " "))]
    seen = {"000Q": "queue", "-3.5": None}

    def plain(v):
        x = v.strip(" ").upper().rjust(4, "0")
        return seen[x] if x in seen else {"keep": x, "null": None, "other": "<other>"}[rest]

    assert transformed(spark, spellings, trim=True, case="upper", zero_pad=4, mapping=seen, unmapped=rest) == [plain(v) for v in spellings]


def test_casts_round_half_to_even_and_null_text(spark):
    halves = [f"{n}.5" for n in range(-4, 5)]
    assert transformed(spark, halves, cast="int") == [round(float(h)) for h in halves]
    assert transformed(spark, ["1e3", "-0", "12 monkeys", "", None], cast="int") == [1000, 0, None, None, None]
    assert transformed(spark, ["-.25", "1e-2", "pi", None], cast="float") == [-0.25, 0.01, None, None]


@pytest.mark.parametrize("unmapped", ["keep", "null", "other"])
def test_long_mapping_equals_short_one(spark, unmapped):
    mapping = {f"k{i}": f"v{i % 7}" if i % 11 else None for i in range(250)}
    values = [f"k{i}" for i in range(0, 300, 3)] + [None]
    short = [mapping.get(v, {"keep": v, "null": None, "other": "<other>"}[unmapped]) if v in mapping or v is not None or unmapped == "other" else v for v in values]
    assert sorted(map(str, transformed(spark, values, mapping=mapping, unmapped=unmapped))) == sorted(map(str, short))


def test_transform_effect(spark):
    df = spark.createDataFrame([("a",), ("a ",), ("b",), (None,)], "x string")
    assert tuple(transform_effect(df, ColumnTransform("x", trim=True)).first()) == (3, 2, 3, 1)


def test_rules_see_transformed_values(spark):
    book = tiny_book(spark, [(" A", 1.0), ("B", 2.0)], "src string, premium double", RuleSet((Rule("r", enabled=True, column="src", op="eq", values=("A",)),)), TransformSet((ColumnTransform("src", trim=True),), applied=True))
    assert total(book) == 1.0
    assert total(book.with_transforms(TransformSet((ColumnTransform("src", trim=True),)))) is None  # not applied
    with pytest.raises(ValueError):
        apply_transforms(book.raw, [ColumnTransform("nope", trim=True)])


# ---- binning -------------------------------------------------------------------------
def test_bin_labels():
    b = Binning("x", method="custom", cuts=(5, -40, 1_250, 5))
    assert b.labels() == ["01. < -40", "02. -40 to 5", "03. 5 to 1.25K", "04. >= 1.25K"] and b.summary() == "custom, 4 bins [-40, 5, 1.25K]"
    assert [edge_text(x) for x in (0.125, -775_000, 3e6, 2e9)] == ["0.125", "-775K", "3M", "2B"]
    for bad in (dict(method="custom"), dict(method="quantile", bins=1), dict(method="odd")):
        with pytest.raises(ValueError):
            Binning("x", **bad)


def test_bins_are_left_closed_and_resolve_once(spark):
    book = tiny_book(spark, [("A", float(v)) for v in (1, 1, 1, 1, 1, 1, 2, 3, 4, 5)] + [("A", None)], "src string, premium double")
    b = resolve(book, Binning("premium", method="quantile", bins=5))
    assert b.cuts == pytest.approx((1.0, 1.4, 3.2))  # positions 1.8, 3.6, 5.4 and 7.2 of the ten values, equal cuts once
    labels = [r[0] for r in book.raw.select(Binning("premium", method="custom", cuts=(2,)).label(F.col("premium"))).distinct().collect()]
    assert sorted(labels) == ["01. < 2", "02. >= 2", "<null>"]
    assert resolve(book, Binning("premium", method="equal_width", bins=4)).cuts == (2.0, 3.0, 4.0)
    flat = tiny_book(spark, [("A", 3.0), ("A", 3.0)], "src string, premium double")
    assert resolve(flat, Binning("premium", method="equal_width")).cuts == ()


# ---- keys ----------------------------------------------------------------------------
def test_suggest_key_equals_brute_force(spark):
    rows = [("A", i % 4, i % 6, i // 7, i % 2, 1.0) for i in range(60)]
    book = tiny_book(spark, rows, "src string, a int, b int, c int, d int, premium double")
    names, chosen = ["a", "b", "c", "d"], []
    got = keys.suggest_key(book, "_all", names, batch=1).collect()
    for step in got:
        options = [n for n in names if n not in chosen]
        size = {n: len({tuple(r[1 + names.index(c)] for c in [*chosen, n]) for r in rows}) for n in options}
        best = max(options, key=lambda n: size[n])
        assert (step["added"], step["distinct_keys"]) == (best, size[best])
        chosen.append(best)
    assert got[-1]["coverage"] == 1.0 or len(chosen) == 4
    assert keys.suggest_key(book, "A", names, start=["d"], max_cols=2).first()["step"] == 2


def test_key_nulls_and_empty_source(spark):
    book = tiny_book(spark, [("A", 1, 1.0), ("A", 1, 1.0), ("A", None, 1.0)], "src string, k int, premium double")
    one = keys.key_summary(book, "A", ["k"]).first()
    assert (one["n_rows"], one["n_distinct_keys"], one["n_dup_rows"], one["n_dup_groups"], one["max_rows_per_key"]) == (3, 2, 2, 1, 2)
    assert one["key_cols_with_nulls"] == "k (1)" and one["status"] == "fail"
    none = keys.key_summary(book, "B", ["k"]).first()
    assert (none["n_rows"], none["dup_rate"], none["status"]) == (0, 0.0, "pass")


def test_policy_count_keeps_nulls_in_the_key(spark):
    book = tiny_book(spark, [("A", 1, 1.0), ("A", None, 1.0), (None, None, 1.0)], "src string, k int, premium double", policy_key=("src", "k"))
    assert summarize(book).first()["policies"] == 3


# ---- configuration -------------------------------------------------------------------
def test_configs_are_strict_and_merge():
    entries = checks()
    assert list(entries)[:7] == ["key_uniqueness", "missing_rate", "business_rules", "value_checks", "distribution", "segment_mix", "target_analysis"]
    with pytest.raises(ValueError):
        from_dict(entries["segment_mix"].config, {"dimension": ["a"]})
    with pytest.raises(ValueError):
        from_dict(entries["segment_mix"].config, {"thresholds": {"large": 1}})
    assert deep_merge({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}, "b": 1}
    cfg = check_config(entries["segment_mix"], {"dimensions": ["a"], "thresholds": {"z_target": 0.6}}, {"thresholds": {"large_share": 0.1}})
    assert (cfg.dimensions, cfg.thresholds.z_target, cfg.thresholds.large_share) == (("a",), 0.6, 0.1)
    with pytest.raises(ValueError):
        check("segment_mix", entries["segment_mix"].config, "again", 1)(lambda book, cfg: None)


def test_candidates_leave_out_measures_and_key(books):
    book = books[0]
    names = targets.candidate_variables(book)
    assert names[:3] == ["src", "pol_yr", "covg_type_desc"] and "tot_wrtn_prm_amt" not in names and "pol_num" not in names and "expn_bs_std" in names
    cfg = targets.TargetConfig(variables=("claim_cnt",), exclude_variables=("src",))
    forced = targets.candidate_variables(book, cfg)
    assert "claim_cnt" in forced and "src" not in forced
    assert targets.candidate_variables(book, targets.TargetConfig(offer_all_columns=False)) == ["src", "pol_yr", "covg_type_desc", "expn_bs_std", "class_cd_std"]


def test_kinds_and_unknown_columns(books):
    assert [books[0].kind(c) for c in ("tot_wrtn_prm_amt", "rsk_loc_id", "pol_yr", "claim_cnt", "src")] == ["numeric", "numeric", "categorical", "numeric", "categorical"]
    with pytest.raises(UnknownColumnError):
        summarize(books[0], ["no_such"])


# ---- sources, sinks, materialization -------------------------------------------------
def test_sources(spark, tmp_path):
    spark.range(5).withColumn("d_dt", F.lit("2024-01-02")).coalesce(1).write.parquet(str(tmp_path / "p"))
    (tmp_path / "list.csv").write_text("id,name\n1,a\n2,b\n")
    src = Sources(spark, {"whole": str(tmp_path / "p"), "globbed": str(tmp_path / "p" / "*.parquet"), "ids": str(tmp_path / "list.csv"), "later": str(tmp_path / "none.parquet")}, optional=["later"])
    assert src.table("whole").count() == src.table("globbed").count() == 5 and dict(src.table("ids").dtypes) == {"id": "int", "name": "string"}
    with pytest.raises(FileNotFoundError):
        src.table("later")
    with pytest.raises(ValueError):
        Sources(spark, {"bad name": "x"})
    with pytest.raises(Exception):
        Sources(spark, {"gone": str(tmp_path / "none.parquet")})
    load_to_table(spark, str(tmp_path / "p"), "loaded")
    assert dict(read_source(spark, "loaded").dtypes)["d_dt"] == "date"
    spark.sql("DROP TABLE loaded")


def test_extract_and_exports(spark, tmp_path):
    book = tiny_book(spark, [("A", 1.0), ("B", 2.0)], "src string, premium double", RuleSet((Rule("r", enabled=True, column="src", op="eq", values=("A",)),)))
    for kw, n in ((dict(), 2), (dict(filtered=True), 1), (dict(rows=1), 1)):
        write_extract(book, str(tmp_path / "x"), **kw)
        assert spark.read.parquet(str(tmp_path / "x")).count() == n
    export_table(book.raw, str(tmp_path / "csv"))
    export_table(book.raw, str(tmp_path / "json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["src", "premium"] and spark.read.json(str(tmp_path / "json")).count() == 2


def test_broadcast_is_size_checked(spark):
    df = spark.range(100)
    assert collect_if_small(df, 50) is None and len(collect_if_small(df, 100)) == 100
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir") and f"{shared_folder(spark)}/bookdq/{spark.sparkContext.applicationId}/t-" in materialize(df, "t").inputFiles()[0]


# ---- tracker -------------------------------------------------------------------------
def test_data_status_takes_the_largest_value_of_the_worst_rank(spark):
    rows = [("c", "v", "warn", -3.0), ("c", "v", "warn", 2.0), ("c", "v", "pass", 9.0), ("c", "w", "fail", None), ("c", "w", "pass", 4.0)]
    got = {r["variable"]: tuple(r)[2:] for r in tracker.data_status(spark.createDataFrame(rows, "check string, variable string, status string, value double")).collect()}
    assert got == {"v": ("warn", 3.0, 2), "w": ("fail", 4.0, 1)}


@pytest.mark.parametrize("done,judged,jv,now,value,expected", [
    (True, "warn", 0.1, "fail", 0.1, True), (True, "warn", 0.1, "warn", 0.105, False), (True, "warn", 0.1, "warn", 0.12, True), (True, "warn", 0.1, "warn", 0.08, True),
    (True, "fail", 0.1, "pass", 9.0, False), (False, "pass", 0.0, "fail", 1.0, False), (True, None, None, "fail", 1.0, False), (True, "fail", None, "fail", 1.0, False)])
def test_reopened(spark, done, judged, jv, now, value, expected):
    df = spark.createDataFrame([(done, judged, jv, now, value)], "d boolean, js string, jv double, s string, v double")
    assert df.select(tracker.reopened(F.col("d"), F.col("js"), F.col("jv"), F.col("s"), F.col("v"))).first()[0] is expected


EVENTS = [("v", "status", "in_review", None, "ann", "2024-01-01", 1), ("v", "status", "resolved", None, "bob", "2024-01-03", 2), ("v", "status", "resolved", None, "bob", "2024-01-04", 3),
          ("v", "assignee", "ann", "ds", "ann", "2024-01-01", 4), ("v", "assignee", "", "ds", "ann", "2024-01-02", 5), ("v", "assignee", "cy", "de", "ann", "2024-01-02", 6),
          ("v", "note", "x" * 200, None, "cy", "2024-01-05", 7), ("w", "note", "hello", None, "cy", "2024-01-05", 8)]


def test_review_state_and_tracker(spark):
    events = spark.createDataFrame(EVENTS, "variable string, field string, value string, role string, author string, at string, event_id int").withColumn("at", F.col("at").cast("timestamp"))
    state = tracker.review_state(events)
    v = state.where("variable = 'v'").first()
    assert v["status"] == "resolved" and str(v["status_since"]).startswith("2024-01-03") and v["assignees"] == {"de": "cy"} and len(v["last_note"]) == 120 and v["updated_by"] == "cy"
    changes = [(r["from_status"], r["to_status"]) for r in tracker.status_changes(events).orderBy("at").collect()]
    assert changes == [(None, "in_review"), ("in_review", "resolved")]
    schema = "check string, variable string, item string, segment string, metric string, value double, status string"
    before = spark.createDataFrame([("c", "v", None, "ALL", "m", 0.1, "warn")], schema)
    now = spark.createDataFrame([("c", "v", None, "ALL", "m", 0.3, "fail"), ("c", "_check", None, "ALL", "error", None, "fail")], schema)
    judged = tracker.snapshots(before, state.where("status = 'resolved'"), "2024-01-03")
    by_check = tracker.tracker_by_check(now, state, judged, ["c"])
    board = {r["variable"]: r for r in tracker.tracker(spark.createDataFrame([("u",)], "variable string"), by_check, state, "2024-01-06 00:00:00").collect()}
    assert set(board) == {"u", "v", "w"} and board["v"]["reopened"] and not board["v"]["done"] and board["v"]["days_in_status"] == 3.0
    assert board["u"]["status"] == "not_started" and board["u"]["data_status"] is None and board["v"]["de_assignee"] == "cy"
    quiet = {r["variable"]: r for r in tracker.tracker(spark.createDataFrame([("u",)], "variable string"), tracker.tracker_by_check(before, state, judged, ["c"]), state, "2024-01-06").collect()}
    assert quiet["v"]["done"] and not quiet["v"]["reopened"]
    assert {(r["change"], r["variable"]) for r in tracker.run_changes(now, before).collect()} == {("newly flagged", "_check")}


def plain_state(events):
    """Review state written out: the log walked in order, one variable at a time."""
    out = {}
    for variable, field, value, role, author, at, number in sorted(events, key=lambda e: (e[5], e[6])):
        s = out.setdefault(variable, {"status": None, "status_since": None, "label": None, "assignees": {}, "n_notes": 0, "n_steps": 0, "last_note": None, "begun": False})
        if field == "status":
            value = {"in_review": "actuary_review"}.get(value, value)
            if not s["begun"] or value != s["status"]:
                s["status_since"] = at
            s["status"], s["begun"] = value, True
        elif field == "assignee":
            s["assignees"][role] = value
        elif field == "note":
            s["n_notes"], s["last_note"] = s["n_notes"] + 1, value
        elif field == "step":
            s["n_steps"] += 1
        else:
            s["label"] = value
        s["updated_at"], s["updated_by"] = at, author
    for s in out.values():
        s["assignees"] = {r: v for r, v in s["assignees"].items() if v} or None
        del s["begun"]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_state_of_increments_is_the_state_of_the_log(spark, seed):
    """Times with ties, repeated statuses, a null and a legacy status, a hot variable; folded at once, and in four increments, one of them empty."""
    rng = random.Random(seed)
    events = []
    for i in range(300):
        field = rng.choice(["status", "status", "assignee", "note", "step", "label"])
        value = {"status": rng.choice(["in_review", "actuary_review", "resolved", "resolved", None]), "assignee": rng.choice(["", "ann", "bob"])}.get(field, f"text {i}")
        events.append((rng.choice("vvvvwxy"), field, value, rng.choice(["ds", "de"]) if field == "assignee" else None, rng.choice(["ann", "bob"]), f"2024-01-{1 + i // 20:02d}", i))
    schema = "variable string, field string, value string, role string, author string, at string, event_id int"
    want = plain_state(events)
    frames = [spark.createDataFrame(events[:k], schema) for k in (0, 90, 90, 210, 300)]
    folded = tracker.fold_log(frames[0])
    for frame in frames[1:]:
        folded = spark.createDataFrame(tracker.fold_later(folded, frame).collect(), folded.schema)
    for state in (tracker.review_state(frames[-1]), tracker.state_of_fold(folded)):
        got = {r["variable"]: r.asDict() for r in state.collect()}
        assert {v: {k: got[v][k] for k in want[v]} for v in got} == want


@pytest.mark.parametrize("fields,said", [
    (dict(key="No blanks", column="x", values=("1",)), ["a key is made of"]), (dict(key="r"), ["found none"]), (dict(key="r", column="x", expr="x > 1"), ["found column, expr", "found 0"]),
    (dict(key="r", column="x", op="like", values=("1",)), ["no operator is called 'like'"]), (dict(key="r", column="x", op="lte", values=("1", "2")), ["one value, found 2"])])
def test_rules_name_all_their_faults(fields, said):
    with pytest.raises(ValueError) as caught:
        Rule(**fields)
    assert all(text in str(caught.value) for text in said)


def test_null_tests_take_any_values_and_forms_ignore_the_operator():
    assert not Rule("r", column="x", op="is_null").faults() and not Rule("r", column="x", op="not_null", values=("1",)).faults() and not Rule("r", expr="x > 1", op="eq").faults()


# ---- preparation and preflight -------------------------------------------------------
def test_agreed_steps_order_and_precedence(spark):
    book = tiny_book(spark, [("A", 1.0)], "src string, premium double", transforms=TransformSet((ColumnTransform("src", trim=True, case="upper", description="why"),)))
    reviewed = spark.createDataFrame([("premium", s, op, None, ["A"], "r") for s, op in [("preprocess_in_modeling", o) for o in ("bin", "impute", "odd")]] + [("src", "investigating", "cap", None, [], None)],
                                     "variable string, status string, op string, params map<string,string>, sources array<string>, rationale string")
    got = agreed_steps(book, [Binning("premium", "b", "custom", cuts=(5,)), Binning("src", "raw")], reviewed).orderBy("column", "position").collect()
    assert [(r["column"], r["op"]) for r in got] == [("premium", "impute"), ("premium", "bin"), ("premium", "odd"), ("src", "trim"), ("src", "case")]
    assert '"scheme": "b"' in got[1]["step"] and [r["position"] for r in got] == [1, 2, 3, 1, 2]
    assert parse_mapping("UNK=null, Y=1,, x = ") == {"UNK": None, "Y": "1", "x": None}


def test_crosstab_tells_margins_from_levels(spark):
    book = tiny_book(spark, [("A", "Total", 1.0), ("B", "Total", 2.0), ("C", "x", 4.0), ("A", "x", 8.0)], "src string, covg string, premium double")
    got = {(r["covg"], r["is_total"]): (r["A"], r["B"], r["(other)"], r["(total)"]) for r in crosstab(book, "covg", "src", ["A", "B"]).collect()}
    assert got == {("Total", 0): (1.0, 2.0, 0.0, 3.0), ("x", 0): (8.0, 0.0, 4.0, 12.0), ("Total", 1): (9.0, 2.0, 4.0, 15.0)}
    assert set(crosstab(book, "covg", "src").columns) == {"covg", "A", "B", "C", "(other)", "(total)", "is_total"}


def test_store_raises_on_what_it_cannot_read(spark, tmp_path):
    assert FindingsStore(spark, path=str(tmp_path / "none")).load().count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        FindingsStore(spark, path=str(tmp_path / "bad")).load().count()


def test_running_total_counts_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, v long")
    got = {(r["k"], r["v"]): r["t"] for r in running_total(rows, [F.col("v")], "v", "t", ["k"]).collect()}
    assert got == {(None, 1): 1, (None, 2): 3, ("a", 3): 3, ("a", 4): 7}


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[:4])
def test_pipeline_order_does_not_depend_on_input_order(spark, order):
    df = spark.createDataFrame([("A", 1.0), ("A", None), ("B", 100.0), ("B", 3.0)], "src string, x double")
    steps = [Step("x", "exclude_rows", {"condition": "x > 50"}), Step("x", "impute", {"strategy": "mean", "add_indicator": True}), Step("x", "log_transform", {"method": "log10"})]
    got = run_pipeline(df, [steps[i] for i in order]).orderBy("x").collect()
    assert [(r["x"] and round(r["x"], 6), r["x_missing"]) for r in got] == [(0.0, 0), (0.30103, 1), (0.477121, 0)]


def test_pipeline_refuses_what_it_cannot_run(spark):
    df = spark.createDataFrame([("A", 1.0)], "src string, x double")
    for step in (Step("x", "custom", {"instructions": "ask"}), Step("x", "cap", {}, sources=("A",))):
        with pytest.raises(ValueError):
            run_pipeline(df, [step])


def test_preflight(books):
    good = {r["check"]: r["ok"] for r in preflight.preflight(books[0], settings()).collect()}
    assert all(good.values()), good
    bad = books[0].with_rules(RuleSet((Rule("broken", enabled=True, expr="no_such > 1"),)))
    report = {r["check"]: r for r in preflight.preflight(bad, {"segment_mix": from_dict(checks()["segment_mix"].config, {"dimensions": ["gone"]})}).collect()}
    assert not report["rule broken"]["ok"] and not report["segment_mix"]["ok"] and "gone" in report["segment_mix"]["detail"] and report["sources"]["ok"]


# ---- nothing is cut by a number of levels --------------------------------------------
def test_source_values_beyond_any_cap(spark):
    book = tiny_book(spark, [("A", f"v{i}", 1) for i in range(700)] + [("B", f"v{i}", 1) for i in range(1, 701)], "src string, code string, premium long")
    got = {r["src"]: (r["source_unique_values"], r["first_values"]) for r in values.source_unique(book, "code").collect()}
    assert got == {"A": (1, "v0"), "B": (1, "v700")}
    found = values.run(book, values.ValuesConfig(categorical={"code": values.CategoricalRule()})).findings
    assert found.where("metric = 'source_unique_values' AND value = 1").count() == 2


def test_binning_scores_every_raw_level(spark):
    rows = [("A", i, 100.0, float(i % 7 + 1), 20, 1.0) for i in range(300)]
    book = tiny_book(spark, rows, "src string, x int, premium double, loss double, claims int, exposure double", measures=Measures("premium", "loss", "claims", "exposure", "src"))
    got = targets.score_binnings(book, "x", [], "loss_ratio").first()
    assert (got["n_bins"], got["n_credible"]) == (300, 300) and got["spread"] == pytest.approx(7)


def test_new_category_of_a_small_segment(spark):
    """New in a small segment, but ranked below the cap overall."""
    rows = [("A", y, f"c{i}", 1) for y in (1, 2) for i in range(4) for _ in range(50)] + [("B", y, "c0", 1) for y in (1, 2) for _ in range(9)] + [("B", 2, "rare", 1)]
    book = tiny_book(spark, rows, "src string, yr int, code string, premium long")
    p = distribution.Profile("code", type="categorical", group_by=("src", "yr"), max_categories=4, psi=distribution.PsiRule("yr"))
    out = distribution.run(book, distribution.DistributionConfig(variables=(p,)))
    assert [(r["src"], r["yr"], r["category"], r["n"], r["share"]) for r in out.tables["new_categories::code"].collect()] == [("B", 2, "rare", 1, 0.1)]
    assert out.findings.where("metric = 'new_categories' AND value = 1").count() == 1


def test_pair_guard_counts_exactly_and_says_so(spark):
    """At 200 levels a variable is crossed, at 201 it is not and a note says so; named in pair_variables it is."""
    def rows(n):
        return [("A" if i % 2 else "B", f"l{i % n}", 100.0, 1.0, 20, 1.0) for i in range(2 * n)]

    measures = Measures("premium", "loss", "claims", "exposure", "src")
    for n in (*range(190, 201), 201):
        book = tiny_book(spark, rows(n), "src string, x string, premium double, loss double, claims int, exposure double", measures=measures)
        assert targets.exact_levels(book.population(), ["x"]) == {"x": n}
        assert len(targets.not_crossed(book, ["src", "x"], targets.TargetConfig())) == (n > 200)
    assert targets.profile(book, ["src", "x"], "loss_ratio").pairs.isEmpty()
    folded = targets.profile(book, ["src", "x"], "loss_ratio", pair_variables=["src", "x"]).pairs
    assert folded.agg(F.sum("records")).first()[0] == 402 and folded.select("level_b").distinct().count() == 13
    assert any("201" in note for note in targets.run(book, targets.TargetConfig(variables=("src", "x"))).notes)
