"""Quality rules whose cutoffs come from the corpus: quantile sketches per language and source, then a joined filter.

Each document has five shares in thousandths: symbols, repeated words, repeated lines, capitals, exclamation and question
marks. The sketch of a share is the number of documents in each bucket of the logarithmic scale gamma**i (a relative
error of 1 % at any quantile); zeros have a bucket of their own. Such sketches merge by adding counts, so one aggregation
by (language, source, share, bucket) gives them all, partly on the map side, and those of a language, and of all, are sums
of its sources'. It depends on nothing but the rows, unlike sampling sketches, so a task that runs again changes nothing.

A document is rejected if a share is above its group's fence: upper quartile + 3 x (upper - lower quartile) + the
share's resolution. A group with under `LEAST_GROUP` documents uses its language's sketch, a small language that of all.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookdq.llm.common import Shelf, map_arrow, slices
from bookdq.plans.sizing import broadcast_rows, collect_if_small

SYMBOLS, CAPITALS, MARKS = b"#*$%&|<>", bytes(range(65, 91)), b"!?"
GAMMA, WIDTH, LEAST_GROUP, SPREAD = 1.02, 5, 200, 3
#: Share -> (count, of what, resolution in thousandths: what one stray sign or line may add in a short text).
SHARES = {"symbols": ("n_symbols", "word_chars", 30), "repeats": ("n_repeat_words", "n_words", 200), "lines": ("n_dup_lines", "n_lines", 300),
          "capitals": ("n_capitals", "word_chars", 150), "marks": ("n_marks", "word_chars", 30)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def repeated_words(words: list[bytes], width: int = WIDTH) -> int:
    """Words in windows of `width` words that are found twice or more, the first included."""
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    window, size = ids, len(number)
    for k in range(1, width):  # a window's number, kept below n by renumbering wherever it would not fit
        if size * len(number) >= 1 << 62:
            window, size = np.unique(window, return_inverse=True)[1], n
        window, size = window[:n - k] * len(number) + ids[k:], size * len(number)
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - width + 1, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + 1, dtype=np.int64)
    start = np.flatnonzero(twice)
    change[start] += 1
    change[start + width] -= 1
    return int((np.cumsum(change) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS for one text; a null text has none."""
    text = text or ""
    raw = text.encode(errors="surrogatepass")
    words = raw.split()  # of bytes: ASCII white space only
    seen: set[bytes] = set()
    lines = repeated = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            repeated += line in seen
            seen.add(line)
    without = [len(raw) - len(raw.translate(None, drop)) for drop in (b" \t\n\v\f\r", SYMBOLS, CAPITALS, MARKS)]
    return len(words), len(text) - without[0], without[1], repeated, repeated_words(words), lines, without[2], without[3]


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, lang, source, the counts) of every row, in a narrow pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            columns = zip(*map(counts_of, batch.column("_t").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_k", "_l", "_s")), *(pa.array(c, pa.int64()) for c in columns)], names=["_k", "_l", "_s", *COUNTS])

    rows = docs.select(F.col(key).alias("_k"), F.col(lang).alias("_l"), F.col(source).alias("_s"), F.col(text).alias("_t"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("_k", "_l", "_s"))
    return map_arrow(rows, run, f"{kinds}, " + ", ".join(f"{c} long" for c in COUNTS))


def share(name: str) -> Column:
    count, whole, _ = SHARES[name]
    return F.expr(f"1000 * {count} div greatest({whole}, 1)")


def bucket(value: Column) -> Column:
    """0 for 0, else 1 + the least i with gamma**i >= value."""
    return F.when(value > 0, 1 + F.ceil(F.log(value.cast("double")) / math.log(GAMMA))).otherwise(0).cast("int")


def sketches(measured: DataFrame) -> DataFrame:
    """(_l, _s, share, bucket, n): mergeable sketches, a row for each bucket in use."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("share"), bucket(share(name)).alias("bucket")) for name in SHARES])).alias("x")
    return measured.select("_l", "_s", each).groupBy("_l", "_s", "x.share", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartile(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, share, total, q1, q3) of merged sketches; windows run over the buckets of one sketch, some hundreds at most."""
    merged = counts.groupBy(*keys, "share", "bucket").agg(F.sum("n").alias("n"))
    one = Window.partitionBy(*keys, "share")
    upto = merged.withColumn("upto", F.sum("n").over(one.orderBy("bucket"))).withColumn("total", F.sum("n").over(one))
    value = F.when(F.col("bucket") > 0, 2 * F.pow(F.lit(GAMMA), F.col("bucket") - 1) / (GAMMA + 1)).otherwise(0.0)
    quantile = [F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, value)).alias(f"q{q}") for q in (1, 3)]
    return upto.groupBy(*keys, "share").agg(F.max("total").alias("total"), *quantile)


def fences(counts: DataFrame) -> DataFrame:
    """(_l, _s, a fence for each share): whole thousandths up to which a group's documents pass."""
    groups = quartile(counts, ["_l", "_s"])
    langs = quartile(counts, ["_l"]).select(F.col("_l").alias("_l2"), F.col("share").alias("_share2"), *[F.col(c).alias(f"l_{c}") for c in ("total", "q1", "q3")])
    all_ = quartile(counts, []).select(F.col("share").alias("_share3"), F.col("q1").alias("a_q1"), F.col("q3").alias("a_q3"))  # a row a share
    one = groups.join(langs, groups["_l"].eqNullSafe(langs["_l2"]) & (groups["share"] == langs["_share2"])).join(F.broadcast(all_), F.col("share") == F.col("_share3"))
    q1, q3 = (F.when(F.col("total") >= LEAST_GROUP, F.col(q)).when(F.col("l_total") >= LEAST_GROUP, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}")) for q in ("q1", "q3"))
    resolution = F.coalesce(*[F.when(F.col("share") == name, F.lit(x)) for name, (_, _, x) in SHARES.items()])
    fence = F.floor(F.round(q3 + SPREAD * (q3 - q1) + resolution, 6)).cast("long")
    return one.groupBy("_l", "_s").agg(*[F.max(F.when(F.col("share") == name, fence)).alias(f"fence_{name}") for name in SHARES])


def rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, counts, base_failed, failed array<string>, kept) of every row. base_failed: under 10 words, or over a fifth
    of the words repeated in windows; it rejects whatever the fences. failed: the shares above their fence. A null text
    counts as one without words. Null languages and sources are groups like others; repeated rows count each."""
    shelf = Shelf(docs.sparkSession, "quality")
    measured = shelf.save(measure(docs, key, text, lang, source), "measured")
    limits = shelf.save(fences(sketches(measured)), "fences")
    small = collect_if_small(limits)
    side = (limits if small is None else broadcast_rows(docs.sparkSession, small, limits.schema)).withColumnsRenamed({"_l": "_fl", "_s": "_fs"})
    joined = measured.join(side, measured["_l"].eqNullSafe(side["_fl"]) & measured["_s"].eqNullSafe(side["_fs"]))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(share(name) > F.col(f"fence_{name}"), F.lit(name)) for name in SHARES]), lambda x: x.isNotNull())
    return joined.select(F.col("_k").alias(key), *COUNTS[:5], base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"))


def _oracle() -> str:
    share_sql = {n: f"1000 * {c} // greatest({w}, 1)" for n, (c, w, _) in SHARES.items()}
    long = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{n}' AS share, {e} AS v FROM counts" for n, e in share_sql.items())
    resolution = " ".join(f"WHEN '{n}' THEN {x}" for n, (_, _, x) in SHARES.items())

    def quartiles(keys: str) -> str:
        by = keys + ", " if keys else ""
        value = f"CASE WHEN bucket > 0 THEN 2 * pow({GAMMA}, bucket - 1) / ({GAMMA} + 1) ELSE 0 END"
        return (f"SELECT {by}share, max(total) AS total, min(CASE WHEN upto * 4 >= total THEN {value} END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN {value} END) AS q3 FROM ("
                f"SELECT {by}share, bucket, sum(n) OVER (PARTITION BY {by}share ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}share) AS total FROM ("
                f"SELECT {by}share, bucket, sum(n) AS n FROM sketch GROUP BY {by}share, bucket)) GROUP BY {by}share")

    return f"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM docs),
positions AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - {WIDTH - 1})) AS p FROM split WHERE len(words) >= {WIDTH}),
windows AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p:p + {WIDTH - 1}]) AS times FROM positions),
repeats AS (SELECT doc_id, count(DISTINCT w) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(p, p + {WIDTH - 1})) AS w FROM windows WHERE times > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(lines) AS line FROM split) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counts AS (SELECT d.doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks
  FROM docs d JOIN split USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)),
long AS ({long}),
sketch AS (SELECT lang, source, share, CASE WHEN v > 0 THEN 1 + ceil(ln(v) / {math.log(GAMMA)!r})::INT ELSE 0 END AS bucket, count(*) AS n FROM long GROUP BY ALL),
of_group AS ({quartiles('lang, source')}), of_lang AS ({quartiles('lang')}), of_all AS ({quartiles('')}),
chosen AS (SELECT g.lang, g.source, g.share, CASE WHEN g.total >= {LEAST_GROUP} THEN g.q1 WHEN l.total >= {LEAST_GROUP} THEN l.q1 ELSE a.q1 END AS q1,
  CASE WHEN g.total >= {LEAST_GROUP} THEN g.q3 WHEN l.total >= {LEAST_GROUP} THEN l.q3 ELSE a.q3 END AS q3
  FROM of_group g JOIN of_lang l ON g.lang IS NOT DISTINCT FROM l.lang AND g.share = l.share JOIN of_all a ON g.share = a.share),
fence AS (SELECT lang, source, share, floor(round(q3 + {SPREAD} * (q3 - q1) + CASE share {resolution} END, 6)) AS fence FROM chosen),
failed AS (SELECT l.doc_id FROM long l JOIN fence f ON l.lang IS NOT DISTINCT FROM f.lang AND l.source IS NOT DISTINCT FROM f.source AND l.share = f.share WHERE v > fence GROUP BY l.doc_id)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND failed.doc_id IS NULL AS kept FROM counts c LEFT JOIN failed ON c.doc_id = failed.doc_id"""


ORACLE = _oracle()
