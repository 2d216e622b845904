"""The demo book: lineitem with its order, customer and part, in the roles of an insurance fact table."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookdq import Book, BookSpec, Measures
from bookdq.operators.filters import RuleSet
from bookdq.operators.transforms import TransformSet

# column -> expression, valid in Spark and in the oracle
COLUMNS = {
    "src": "l_returnflag",
    "policy_no": "l_orderkey",
    "eff_date": "CAST(o_orderdate AS DATE)",
    "exp_date": "CAST(l_shipdate AS DATE)",
    "line_no": "l_linenumber",
    "coverage": "p_type",
    "class_cd": "CASE WHEN l_returnflag = 'N' AND p_brand = 'Brand#7' THEN 'Brand#7N' ELSE p_brand END",
    "program_cd": "CASE WHEN year(o_orderdate) >= 1999 AND p_brand = 'Brand#3' THEN 'P-NEW' ELSE p_type END",
    "segment_cd": "c_mktsegment",
    "tx_type": "o_orderpriority",
    "expo_base": "l_linestatus",
    "expo_amt": "l_quantity",
    "premium_amt": "CASE WHEN l_linenumber = 1 AND l_tax = 0.01 THEN -CAST(l_extendedprice AS DECIMAL(12,2)) "
                   "ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END",
    "loss_amt": "CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))",
    "claim_cnt": "CAST(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS BIGINT)",
    "location_id": "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linenumber END",
    "zip_cd": "CASE WHEN l_suppkey % 33 = 0 THEN '' WHEN l_suppkey % 47 = 0 THEN ' UNK ' "
              "ELSE lpad(CAST(l_suppkey AS VARCHAR(20)), 5, '0') END",
    "deductible_amt": "CASE WHEN l_tax = 0 THEN NULL ELSE round(l_tax * 100) * 250 END",
}

BOOK_SQL = ("book AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items())
            + ", CAST(year(o_orderdate) AS INTEGER) AS pol_yr FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
              "JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)")

SPEC = BookSpec(
    name="demo", source="src", sources=("A", "N", "R"),
    measures=Measures("premium_amt", "loss_amt", "claim_cnt", "expo_amt", "expo_base"),
    policy_key=("policy_no", "eff_date", "exp_date"),
    segment_candidates=("src", "pol_yr", "coverage", "expo_base", "segment_cd", "class_cd", "tx_type"),
    derived={"pol_yr": "year(eff_date)"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book_frame(spark: SparkSession, sf_dir: str, need: Iterable[str]) -> DataFrame:
    """The book of the SQL: rows of lineitem that have all their parents, whichever columns are wanted."""
    need = set(need)
    orders, customer, part = (table(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))  # among orders: where customers are many, the lines are not moved for them
    df = (table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
          .join(placed, F.col("l_orderkey") == F.col("o_orderkey")))
    return df.select(*[F.expr(COLUMNS[n]).alias(n) for n in COLUMNS if n in need])


def demo_book(spark: SparkSession, sf_dir: str, need: str = "", rules: RuleSet | None = None,
              transforms: TransformSet | None = None, sql_vars: dict[str, str] | None = None) -> Book:
    """The book with its measures, source and the named columns (`*` = all). `pol_yr` brings the effective date."""
    wanted = set(COLUMNS) if need == "*" else {"src", "premium_amt", "loss_amt", "claim_cnt", "expo_amt", "expo_base", *need.split()}
    derived = dict(SPEC.derived) if "pol_yr" in wanted or "eff_date" in wanted else {}
    if derived:
        wanted.add("eff_date")
    spec = BookSpec(SPEC.name, SPEC.source, SPEC.sources, SPEC.measures, SPEC.policy_key, SPEC.segment_candidates, derived)
    return Book(spec, book_frame(spark, sf_dir, wanted), rules, transforms, sql_vars)


# documents with their labels: the table with real nulls
DOCS_SQL = ("docs AS (SELECT d.doc_id, d.lang, d.source AS src, d.n_chars, l.quality, l.toxic FROM documents d "
            "LEFT JOIN labels l ON d.doc_id = l.doc_id)")


def docs_book(spark: SparkSession, sf_dir: str) -> Book:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    raw = (docs.join(labels, "doc_id", "left")
           .select("doc_id", "lang", F.col("source").alias("src"), "n_chars", "quality", "toxic"))
    spec = BookSpec("docs", "src", (), Measures("n_chars", "n_chars", "quality", "n_chars", "lang"), ("doc_id",), ("src", "lang"))
    return Book(spec, raw)
