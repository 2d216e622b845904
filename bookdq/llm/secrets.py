"""Secrets in texts: known forms by pattern, and random strings by a battery of tests with false-discovery control.

DataFrame functions only. Known forms (assign, access, hex) are matches of fixed patterns. A candidate for the fourth
kind is a run of 20 or more symbols of the common encodings, and each part of 20 or more between its '/', '-' and '_', since
a path or a prefix widens the alphabet of the key behind it. Its encoding is inferred from the symbols it uses, and it
must pass as random in that encoding: chi-squared of uniform symbols, runs above and below the middle symbol, serial
correlation of neighbours, each by its normal score, at a level of 0.001 shared by the three.

Short strings pass such tests by chance, and so do words. So each candidate also needs evidence against being text: the
likelihood ratio of uniform symbols against letters as frequent as in the corpus's own words. Under the hypothesis
"text" a ratio above x has a probability below 1/x, at any length, so 1/ratio is a p-value that knows the length. Within
each band of lengths, the Benjamini-Hochberg rule over all candidates of the corpus turns them into accepted ones with a
rate of false discoveries of at most `rate`. It runs on counts by rounded score: bands x bins, whatever the corpus.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookdq.llm.common import Shelf, packed, text_or_empty, unpacked

#: Fixed patterns of the known forms.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more characters: a run either has them from its first AKIA or not at all
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
RANDOM = r"[A-Za-z0-9+/_-]{20,}"
LONG_PART = r"[A-Za-z0-9+]{20,}"
LEAST_SECRET = 6

LOWERS, UPPERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings in the order they are tried: name, symbols.
ENCODINGS = (("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("lower", LOWERS), ("upper", UPPERS), ("base32", UPPERS + "234567"), ("base36", DIGITS + LOWERS),
             ("BASE36", DIGITS + UPPERS), ("base62", UPPERS + LOWERS + DIGITS), ("base64", UPPERS + LOWERS + DIGITS + "+/"), ("base64url", UPPERS + LOWERS + DIGITS + "-_"),
             ("mixed", UPPERS + LOWERS + DIGITS + "+/-_"))
#: How often text has a digit or a sign among letters, and how a word's letters are cased.
DIGIT_SHARE, SIGN_SHARE, CASE_SHARE = 0.02, 0.01, 0.3
BANDS = (32, 48, 64, 128)  # lengths at which a new band begins
LEVEL_SCORE = 3.5  # normal score of 0.001 / 3, two-sided: 3.59; the chi-squared one is one-sided: 3.40
RATE, BINS, BIN = 0.01, 400, 0.25  # false discoveries; bins of the score and their width in nats


def located(rows: DataFrame, kind: str) -> DataFrame:
    """(row, i, piece, length, size) of a kind's matches: the length of the text before it since the last match, its own
    length, and what decides (group 2 or the match)."""
    return rows.where(F.size(kind) > 0).select("row", F.posexplode(F.arrays_zip(F.slice(f"{kind}_gaps", 1, F.size(kind)).alias("gap"), F.col(kind).alias("match"))).alias("i", "m")).select(
        "row", F.lit(KINDS.index(kind)).alias("kind"), "i", F.col("m.gap").alias("gap"), F.col("m.match.whole").alias("whole"), F.col("m.match.part").alias("part"))


def extract(docs: DataFrame, text: str) -> DataFrame:
    """Adds the matches of each kind and the lengths of the pieces between them, in one narrow pass over the texts."""
    whole = text_or_empty(text)
    out = docs.withColumn("_text", whole)
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, RANDOM)):
        out = out.withColumn(kind, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, RANDOM)):
        pieces = F.when(F.size(kind) > 0, F.transform(F.split("_text", pattern, -1), F.length)).otherwise(F.array().cast("array<int>"))
        part = F.when(F.size(kind) > 0, F.regexp_extract_all("_text", F.lit(pattern), F.lit(2))) if kind == "assign" else F.col(kind)
        out = out.withColumn(f"{kind}_gaps", pieces).withColumn(f"{kind}_part", part)
    for kind in KINDS:
        out = out.withColumn(kind, F.when(F.size(kind) > 0, F.zip_with(kind, f"{kind}_part", lambda a, b: F.struct(a.alias("whole"), b.alias("part"))))
                             .otherwise(F.array().cast("array<struct<whole:string,part:string>>"))).drop(f"{kind}_part")
    return out.drop("_text")


def count_of(text: Column, symbol: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(symbol)))


def letter_shares(candidates: DataFrame) -> list[float]:
    """Shares of a-z (case folded) among the letters-only candidates, the corpus's own long words, each different one once;
    the reciprocal of rank in the order below stands in with a weight of 1000 letters."""
    usual = "etaoinsrhldcumfpgwybvkxjqz"  # fixed values: letters by how often English has them
    words = candidates.select(F.lower("whole").alias("w")).where(~F.col("w").rlike("[^a-z]")).distinct()
    row = words.agg(*[F.coalesce(F.sum(count_of(F.col("w"), c)), F.lit(0)).alias(c) for c in LOWERS]).first()
    prior = {c: 1 / (i + 2) for i, c in enumerate(usual)}
    scale = 1000 / sum(prior.values())
    total = sum(row[c] for c in LOWERS) + 1000
    return [(row[c] + scale * prior[c]) / total for c in LOWERS]


def tested(candidates: DataFrame) -> DataFrame:
    """Adds to (whole) its encoding, n, the scores of the battery, `passes`, and `score`: log of the likelihood ratio."""
    w = F.col("whole")
    inferred = F.coalesce(*[F.when(~w.rlike(f"[^{symbols.replace('-', chr(92) + '-')}]"), F.lit(i)) for i, (_, symbols) in enumerate(ENCODINGS)])
    symbols = F.element_at(F.array(*[F.lit(s) for _, s in ENCODINGS]), F.col("code") + 1)
    out = (candidates.withColumn("code", inferred).withColumn("symbols", symbols).withColumn("k", F.length("symbols")).withColumn("n", F.length(w))
           .withColumn("chars", F.split(w, "")).withColumn("at", F.expr("transform(chars, c -> locate(c, symbols))")))
    squares = F.expr("aggregate(array_distinct(chars), 0L, (s, c) -> s + cast(pow(n - length(replace(whole, c)), 2) as bigint))")
    out = out.withColumn("chi2", F.col("k") * squares / F.col("n") - F.col("n")).withColumn("high", F.expr("transform(at, x -> cast(x > k / 2 as int))"))
    out = out.withColumn("n1", F.expr("aggregate(high, 0, (s, x) -> s + x)")).withColumn("n0", F.col("n") - F.col("n1"))
    out = out.withColumn("runs", F.expr("1 + aggregate(sequence(2, n), 0, (s, i) -> s + cast(element_at(high, i) <> element_at(high, i - 1) as int))"))
    out = out.withColumn("mean", F.expr("aggregate(at, 0D, (s, x) -> s + x) / n"))
    out = out.withColumn("spread", F.expr("aggregate(at, 0D, (s, x) -> s + (x - mean) * (x - mean))"))
    out = out.withColumn("lagged", F.expr("aggregate(sequence(2, n), 0D, (s, i) -> s + (element_at(at, i) - mean) * (element_at(at, i - 1) - mean))"))
    df = F.col("k") - 1
    z_chi = (F.pow(F.greatest("chi2", F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))  # Wilson and Hilferty's normal score
    product, n = 2.0 * F.col("n0") * F.col("n1"), F.col("n").cast("double")
    variance = product * (product - n) / (n * n * (n - 1))
    z_runs = F.when(variance > 0, (F.col("runs") - (product / n + 1)) / F.sqrt(variance)).otherwise(F.lit(99.0))
    z_serial = F.when(F.col("spread") > 0, (F.col("lagged") / F.col("spread") + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
    out = out.withColumn("z_chi", z_chi).withColumn("z_runs", z_runs).withColumn("z_serial", z_serial)
    return out.withColumn("passes", (F.col("z_chi") <= LEVEL_SCORE) & (F.abs("z_runs") <= LEVEL_SCORE) & (F.abs("z_serial") <= LEVEL_SCORE))


def with_score(candidates: DataFrame, shares: list[float]) -> DataFrame:
    w = F.col("whole")
    letters = F.regexp_count(w, F.lit("[A-Za-z]"))
    text = sum((count_of(F.lower(w), c) * math.log(p * (1 - DIGIT_SHARE - SIGN_SHARE)) for c, p in zip(LOWERS, shares)), F.lit(0.0))
    text = text + F.regexp_count(w, F.lit("[0-9]")) * math.log(DIGIT_SHARE / 10) + F.regexp_count(w, F.lit("[+/_-]")) * math.log(SIGN_SHARE / 4)
    plain = ~w.rlike("[A-Z]") | ~w.rlike("[a-z]") | ~w.rlike("[^A-Za-z]?[a-z0-9+/_-][A-Z]")
    text = text + F.when(plain, F.lit(math.log(CASE_SHARE))).otherwise(math.log(1 - 3 * CASE_SHARE) - letters * math.log(2))
    band = sum((F.when(F.col("n") >= b, 1).otherwise(0) for b in BANDS), F.lit(0))
    return candidates.withColumn("score", -F.col("n") * F.log(F.col("k").cast("double")) - text).withColumn("band", band)


def thresholds(scored: DataFrame, rate: float) -> dict[int, float]:
    """Band -> least score that is accepted. Candidates that fail the battery count as tests, never as discoveries."""
    rounded = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(0)), F.lit(BINS)).cast("int")
    counts: dict[int, dict[int, tuple[int, int]]] = {}
    for r in scored.groupBy("band", rounded.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if("passes").alias("good")).collect():  # bands x bins rows at most
        counts.setdefault(r["band"], {})[r["bin"]] = (r["n"], r["good"])
    out = {}
    for band, bins in counts.items():
        tests, found, best = sum(n for n, _ in bins.values()), 0, None
        for b in sorted(bins, reverse=True):
            found += bins[b][1]
            if tests * math.exp(-b * BIN) <= rate * found:
                best = b * BIN
        if best is not None:
            out[band] = best
    return out


def with_parts(runs: DataFrame) -> DataFrame:
    """(row, kind, start, end, whole, run, part) of runs (row, kind, start, end, whole) and of their long parts between '/', '-'
    and '_'; run: where the run starts. The window holds the parts of one run."""
    runs = runs.withColumn("run", F.col("start"))
    pieces = runs.where(F.col("whole").rlike("[/_-]") & F.col("whole").rlike(LONG_PART)).select("row", "kind", "run", F.posexplode(F.split("whole", "[/_-]", -1)).alias("i", "whole"))
    earlier = Window.partitionBy("row", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.col("run") + F.coalesce(F.sum(F.length("whole") + 1).over(earlier), F.lit(0))).where(F.col("whole").rlike(LONG_PART))
    parts = pieces.withColumn("end", F.col("start") + F.length("whole")).withColumn("part", F.lit(True))
    return runs.withColumn("part", F.lit(False)).unionByName(parts.drop("i"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """(row, key, found array<struct<start, kind, end>>, chash) of every row, found in order of start, then kind; start
    and end in code points, end exclusive. chash tells texts of one key apart. Null texts count as empty and have no span.
    Every row is treated for itself, so repeated rows have the same spans."""
    spark = docs.sparkSession
    shelf = Shelf(spark, "secrets")
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.xxhash64(text_or_empty(text)).alias("chash"), F.col(text).alias("_t"))
    rows = shelf.save(extract(plain, "_t").drop("_t"), "matches")
    every = located(rows, KINDS[0])
    for kind in KINDS[1:]:
        every = every.unionByName(located(rows, kind))
    before = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("whole")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    every = shelf.save(every.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("whole")), "spans")
    candidates = with_parts(every.where(F.col("kind") == 3).select("row", "kind", "start", "end", "whole")).where(F.col("whole").rlike("[A-Za-z]"))
    scored = shelf.save(with_score(tested(candidates), letter_shares(candidates)).select("row", "kind", "start", "end", "run", "part", "n", "band", "passes", "score"), "scored")
    least = thresholds(scored, rate)
    level = F.coalesce(*[F.when(F.col("band") == b, F.lit(x)) for b, x in least.items()], F.lit(float("inf")))
    accepted = scored.where(F.col("passes") & (F.col("score") >= level))
    alone = accepted.where("part").join(accepted.where("not part").select("row", "run"), ["row", "run"], "left_anti")  # an accepted run covers its parts
    random = accepted.where("not part").unionByName(alone.select(accepted.columns)).select("row", "kind", "start", "end")
    base = every.where((F.col("kind") < 3) & ((F.col("kind") > 0) | (F.length("part") >= LEAST_SECRET))).select("row", "kind", "start", "end")
    spans = base.union(random).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    empty = F.array().cast(spans.schema["found"].dataType)
    return rows.select("row", "id", "chash").join(spans, "row", "left").select("row", F.col("id").alias(key), "chash", F.coalesce("found", empty).alias("found"))


def joined(found: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the known forms, the digest of their spans, and all spans as text."""
    base = F.filter("found", lambda s: s["kind"] < 3)

    def of_kind(i: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")

    return scanned.select(key, *[of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
                          F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """docs with every span replaced by [kind] (of overlapping spans: what they cover together, named by the first).
    All rows and columns stay; a text without a span is unchanged, a null text stays null."""
    found = scan(docs, key, text, rate).where(F.size("found") > 0).select(F.col(key).alias("_i"), F.col("chash").alias("_h"), "found").groupBy("_i", "_h").agg(F.first("found").alias("_found"))
    rows = packed(docs, c=F.xxhash64(text_or_empty(text)), k=key, t=text)
    placed = rows.join(found, rows["k"].eqNullSafe(F.col("_i")) & (F.col("c") == F.col("_h")), "left")
    names = "array(" + ", ".join(f"'[{k}]'" for k in KINDS) + ")"
    built = F.expr(f"""aggregate(_found, named_struct('at', 0L, 'out', ''), (s, x) -> named_struct('at', greatest(s.at, x.`end`), 'out',
        if(x.start >= s.at, concat(s.out, substring(t, int(s.at) + 1, int(x.start - s.at)), element_at({names}, x.kind + 1)), s.out)),
        s -> concat(s.out, substring(t, int(s.at) + 1)))""")
    return unpacked(placed, docs, **{text: F.when(F.col("_found").isNull(), F.col("t")).otherwise(built)})
