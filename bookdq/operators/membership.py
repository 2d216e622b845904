"""`x IN (SELECT ...)` and `x NOT IN (SELECT ...)` in rule text as hash-joined flags.

Spark plans a NOT IN inside AND, OR or COALESCE as a nested loop over a broadcast list, since a null on either side makes the
answer unknown. Here each such term is replaced by a boolean column that has the three values SQL asks for:

    list empty                          false, whatever x is
    x null                              null
    x in the list                       true
    x not in it, but the list has null  null
    otherwise                           false

The list is reduced to its distinct keys and joined on equality, so a list of any size shuffles, and a small one is
broadcast by Spark itself. Rows whose x is null match nothing; they get a number besides their key, so that they do not meet in one task.
"""
from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TERM = re.compile(r"\b(?:(not)\s+)?in\s*\(\s*select\b", re.IGNORECASE)
_NAME = re.compile(r"[\w.`]+$")
_BEFORE = re.compile(r"(^|[(,]|\b(and|or|not|when|then|else|case|where))\s*$", re.IGNORECASE)
NULL_PLACES = 4096


def _outside(text: str) -> tuple[list[bool], dict[int, int]]:
    """(whether each character stands outside quotes, for each parenthesis its partner)"""
    free, partner, open_, quote = [], {}, [], ""
    for i, c in enumerate(text):
        free.append(not quote and c not in "'\"`")
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            open_.append(i)
        elif c == ")" and open_:
            j = open_.pop()
            partner[i], partner[j] = j, i
    return free, partner


def _operand(text: str, end: int, partner: dict[int, int]) -> int | None:
    """Where the operand that ends at `end` begins: a name, or parentheses with or without a function before. None when it is part of
    a larger expression, which is left to Spark."""
    begin = end
    if begin and text[begin - 1] == ")":
        if begin - 1 not in partner:
            return None
        begin = partner[begin - 1]
    name = _NAME.search(text[:begin])
    begin = name.start() if name else begin
    return begin if begin < end and _BEFORE.search(text[:begin]) else None


def with_memberships(df: DataFrame, text: str) -> tuple[DataFrame, str]:
    """The frame with a flag for each membership term of the text, and the text on those flags. Terms whose list depends on the row
    (correlated), has several columns, or whose left side is more than a name or a call stay as they are."""
    done = 0
    while True:
        free, partner = _outside(text)
        term = next((m for m in _TERM.finditer(text, done) if free[m.start()]), None)
        if term is None:
            return df, text
        done = term.end()
        bracket = text.index("(", term.start())
        begin = _operand(text, len(text[:term.start()].rstrip()), partner)
        if begin is None or bracket not in partner:
            continue
        try:
            listed = df.sparkSession.sql(text[bracket + 1:partner[bracket]])
            if len(listed.columns) != 1:
                continue
        except (AnalysisException, ParseException):
            continue
        flag = next(f"_member{i}" for i in range(len(df.columns) + 1) if f"_member{i}" not in df.columns)
        df = _flagged(df, text[begin:term.start()].strip(), listed, flag)
        text = f"{text[:begin]}({'NOT ' if term.group(1) else ''}{flag}){text[partner[bracket] + 1:]}"
        done = begin


def _flagged(df: DataFrame, operand: str, listed: DataFrame, flag: str) -> DataFrame:
    columns = df.columns
    listed = listed.toDF("_key")
    facts = listed.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count("_key").alias("known")).alias("_facts")).scalar()
    keys = listed.where(F.col("_key").isNotNull()).distinct().select("_key", F.lit(0).cast("long").alias("_place"))
    rows = df.withColumn("_x", F.expr(operand)).withColumn("_apart", F.when(F.col("_x").isNull(), 1 + F.monotonically_increasing_id() % NULL_PLACES).otherwise(F.lit(0).cast("long")))
    joined = rows.join(keys, (F.col("_x") == F.col("_key")) & (F.col("_apart") == F.col("_place")), "left").withColumn("_facts", facts)
    value = (F.when(F.col("_facts.n") == 0, F.lit(False)).when(F.col("_x").isNull(), F.lit(None).cast("boolean")).when(F.col("_key").isNotNull(), F.lit(True))
             .when(F.col("_facts.known") < F.col("_facts.n"), F.lit(None).cast("boolean")).otherwise(F.lit(False)))
    return joined.select(*columns, value.alias(flag))
