from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bookdq.llm import bpe, factorization, mixing, neardup, queries, secrets, sharding, tokenfiles
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row long, size string"
ODD = ["", " ", "  x  ", None, "a", "a b", "A  B", "it's we'll", "\n\n x\ny", "word " * 3000, "x" * 2000, "日本 語🎉", "a\xa0b\x85c", "tail ", "<|endoftext|> a", "password=abcdef12 token: 'abc'"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, odd and long texts, repeated rows, extra columns whose names the operators use inside."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else f"s{i % 2}", None, "k", i, "z") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[9], rows[9], (None, "a b c d e f", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    found = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()
    rng = random.Random(3)
    letters = "ab c\n'.é漢\xa0\x85\x1c1"
    return [t for _, t in found[:60]] + [t for t in ODD if t is not None] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]


def test_bpe_is_the_librarys(texts):
    import tiktoken

    tool = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tool.ranks, special_tokens={})
    for text, ids in zip(texts, tool.encode(texts)):
        assert ids.tolist() == want.encode_ordinary(text), repr(text[:80])
        assert tool.decode(ids) == text.encode()


@pytest.mark.parametrize("limit", [300_000, 7])
def test_chunk_memory_forgets_and_learns_again(limit):
    """Ids are those of the library, whatever the memory holds: signs, line breaks, white space of all kinds, added tokens."""
    rng, pieces = random.Random(5), ["word", "word,", "It's", "don't.", "\t", "a\tb", "!!", "x9,", "", "#1", "日本,", "<|endoftext|>", "A--", "1234567", " ", "q\x1cz", "(hi"]
    tool = tokenfiles.Library(public_tokenizers.path(queries.FILE_BPE))
    tool.memory.limit = limit
    for _ in range(20):
        texts = ["".join(rng.choice([" ", "\n", " ", ""]) + rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(50)] + ["", " ", "\n", "a\n", "\na"]
        assert [x.tobytes() for x in tool.encode(texts)] == tool._each(texts)


def test_bpe_frames(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(odd, path, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, path, public_tokenizers.PATTERN)
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in odd.collect())
    got = bpe.digests(odd, path, public_tokenizers.PATTERN).collect()
    assert len(got) == odd.count()
    assert all(r["decoded_sha256"] == hashlib.sha256((ODD[r["doc_id"]] or "").encode()).hexdigest() for r in got if r["doc_id"] is not None)
    assert bpe.digests(empty, path, public_tokenizers.PATTERN).count() == 0


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 2**32, n) >> rng.choice([0, 8, 16, 24], n)).astype(np.uint32)
        control, data = tokenfiles.pack(ranks)
        assert len(control) == -(-n // 4)
        assert tokenfiles.unpack(control, data, n).tolist() == ranks.tolist()


def test_token_files(spark, odd, empty, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    texts = [*texts, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y z"]
    library = tokenfiles.library(path)
    assert all(np.frombuffer(ids, "<u4").tolist() == tool.encode(t, add_special_tokens=False).ids for t, ids in zip(texts, library.encode(texts)))
    got = sorted(tokenfiles.write_and_read(odd, path, 2, file_tokens=1000).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, *range(10), 9, 9, *range(10, len(ODD))]
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        if r["doc_id"] is not None:
            assert r["ids"] == [*tool.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        start += r["n_tokens"]
    assert tokenfiles.write_and_read(empty, path, 2).count() == 0


def test_toxicity_learns_pairs(spark, odd, empty):
    """Two terms that are harmless alone and toxic together: their factors attract each other."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        rows.append(np.unique([1] * int(a) + [2] * int(b) + rng.integers(10, 200, 8).tolist()))
        labels.append(int(a and b))
    rows += [np.array([1, 9]), np.array([2, 9])]
    model = factorization.fit(rows[:3000], np.array(labels[:3000]))
    got = model.score(rows[3000:4000]) >= 0.5
    assert (got == np.array(labels[3000:4000], dtype=bool)).mean() > 0.97
    assert model.factor[np.searchsorted(model.places, 1)] @ model.factor[np.searchsorted(model.places, 2)] > 0


def test_toxicity_frames(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 1), (None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    model = factorization.learn(odd, labels)
    got = factorization.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert factorization.score(odd, model, keep=True).drop("_toxicity").columns == odd.columns
    assert factorization.score(empty, factorization.learn(empty, labels.limit(0))).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = factorization.score(docs, factorization.learn(docs, labels)).where(factorization.held_out()).join(labels, "doc_id")
    r = scored.agg(F.avg(F.when(F.col("toxic") == 1, (F.col("score") >= 0.7).cast("int"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, (F.col("score") >= 0.7).cast("int"))).alias("wrong")).first()
    assert r["recall"] > 0.8 and r["wrong"] < 0.01


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute.near_duplicates([(r["doc_id"], r["text"]) for r in docs.collect()], width, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.components(docs, width=width).collect()}
    assert got == want


def test_near_duplicate_groups(spark, odd, empty, monkeypatch):
    """A chain, a large group of edited copies, and many texts around the threshold, with one pivot a bucket and round."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4])):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        docs.append((i * 3, " ".join(words)))
    chain = [f"c{i}" for i in range(200)]
    docs += [(1000 + i, " ".join(chain[i * 4:i * 4 + 80])) for i in range(30)]
    monkeypatch.setattr(neardup, "FIRST_PIVOTS", 1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.components(spark.createDataFrame(docs, "doc_id long, text string"), width=2).collect()}
    assert got == brute.near_duplicates(docs, 2, 80)
    rows = neardup.components(odd, width=2).collect()
    assert len(rows) == odd.count() and all(r["kept"] for r in rows if r["n_shingles"] == 0)
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    assert neardup.components(empty).count() == 0


def test_known_secrets(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(odd.where("doc_id is not null").select(F.col("doc_id") + 10**6, "text").distinct())
    more = [(-1, "Secret = \"token:abcdef\" passwd: 12345, API_KEY='a.b-c=d/' apikey=zzzzzz"), (-2, "AKIA" * 30 + " " + "0123456789abcdef" * 40), (-3, "é🎉 token=xyzxyz " * 300)]
    docs = docs.union(spark.createDataFrame(more, "doc_id long, text string")).cache()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in secrets.report(secrets.scan(docs)).collect():
        want = brute.base_secrets(texts[r["doc_id"]])
        line = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), r
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == [s for s in line.split(",") if s]
    assert secrets.scan(empty).count() == 0


def test_random_strings(spark):
    """Random strings of five encodings are found, words and repetitive strings are not."""
    rng = random.Random(4)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    keys = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (32, 40, 64) for _ in range(20)]
    words = ["".join(rng.choice(["tion", "ment", "ver", "keit", "schaft", "heit", "ing", "ed"]) for _ in range(8)) for _ in range(200)]
    dull = ["abcabcabcabcabcabcabcabc", "a" * 40, "0101010101010101010101ab", "foo-bar-baz-foo-bar-baz", "path/to/some/file/of/mine", "ERINGSTATONNTHEENTHREND", "2023-01-01-2023-01-02-a"]
    docs = [(i, f"the key {w} is here") for i, w in enumerate(keys + words + dull)]
    got = {r["doc_id"]: "random" in r["spans"] for r in secrets.report(secrets.scan(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert sum(got[i] for i in range(len(keys))) >= 0.97 * len(keys)
    assert sum(got[i] for i in range(len(keys), len(docs))) <= 1


def test_redaction(spark, odd):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
    docs = spark.createDataFrame([(1, f"é password={key} end", 5), (1, f"é password={key} end", 5), (2, "clean", 6), (3, None, 7), (None, "secret: 123456", 8)], "doc_id long, text string, start long")
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"], r["start"]) for r in got.collect()) == [("1", "é [assign] end", 5), ("1", "é [assign] end", 5), ("2", "clean", 6), ("3", None, 7), ("None", "[assign]", 8)]
    assert secrets.redact(odd).count() == odd.count()


def test_mix(spark, odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) <= sum(r["size"] for r in got)
    again = {(r["doc_id"], r["row"]): r["taken"] for r in mixing.mix(odd).collect()}
    assert again == {(r["doc_id"], r["row"]): r["taken"] for r in got}
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix(empty).count() == 0


def test_targets(spark):
    rows = spark.createDataFrame([("b", 100), ("a", 1000), (None, 10), ("c", 5000), ("d", 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    # a: weight 5 stops at 3000; b: 2, stops at 300; d: 5, stops at 0; none: 2, stops at 30; c has the rest
    assert got == {"a": 1000 * 3.0, "b": 300.0, "c": 6110 - 3330.0, "d": 0.0, None: 30.0} or abs(sum(got.values()) - 6110) < 1e-6 and all(got[k] <= 3 * s + 1e-9 for k, s in (("a", 1000), ("b", 100), ("c", 5000), ("d", 0), (None, 10)))


def test_hot_group_is_gathered(spark):
    """A group of a third of all bytes, larger than three of ten shards, beside pairs and unlinked texts."""
    hot = [(i, "hot text " * 12) for i in range(400)]
    pairs = [(1000 + i, f"{'pair ' * 20}{i % 120}") for i in range(240)]
    docs = hot + pairs + [(2000 + i, f"{'single ' * 15}{i}") for i in range(560)]
    assigned = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string"), shards=10).cache()
    got = {r["doc_id"]: (r["shard"], r["size"]) for r in assigned.collect()}
    load = Counter()
    for shard, size in got.values():
        load[shard] += size
    average = sum(load.values()) / 10
    assert len(got) == len(docs) and all(abs(load[s] - average) <= 0.005 * average + 150 for s in range(10))
    cells = Counter(got[i][0] for i, _ in hot)
    assert len(cells) <= 6 and sum(cells.values()) == 400, cells  # four would do if nothing else were linked
    cut = sum(got[1000 + i][0] != got[1120 + i][0] for i in range(120))
    report = sharding.cut(assigned).first()
    assert cut <= 12 and report["linked"] - report["together"] == 400 - max(cells.values()) + cut


def test_keys_behind_prefixes(spark):
    """Upper-case hex and base32 keys in paths and behind prefixes; paths and names of words are not found."""
    rng = random.Random(9)
    hexes, base32 = "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    keys = [(p, "".join(rng.choice(a) for _ in range(n))) for p, a, n in (("keys/", hexes, 64), ("keys/", hexes, 40), ("prod_", hexes, 40), ("key-", hexes, 32), ("keys/", base32, 64)) for _ in range(30)]
    words = ["/".join(rng.choice(["information", "administration", "responsibilities", "internationalization", "gesellschaftsvertrag"]) for _ in range(4)) for _ in range(150)]
    docs = [(i, f"the key {w} is here") for i, w in enumerate([p + k for p, k in keys] + words)]
    got = {r["doc_id"]: r["found"] for r in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    covered = [any(s["kind"] == 3 and s["start"] <= 8 + len(p) and s["end"] == 8 + len(p) + len(k) for s in got[i]) for i, (p, k) in enumerate(keys)]
    assert all(sum(covered[i:i + 30]) >= 28 for i in range(0, len(keys), 30)), [sum(covered[i:i + 30]) for i in range(0, len(keys), 30)]
    assert sum(bool(got[i]) for i in range(len(keys), len(docs))) <= 1
