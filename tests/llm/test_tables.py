"""The operators that return tables of whole inputs: quality rules, archives, shards, neighbours."""
from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from bookdq.llm import curves, quality, sharding, warc
from tests.llm.test_operators import ODD, empty, odd  # noqa: F401 - fixtures


def plain_counts(text):
    text = text or ""
    words = [w for w in text.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.translate(str.maketrans("\t\v\f\r", "    ")).strip(" ")]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(monkeypatch):
    rng = random.Random(1)
    texts = [*ODD, "a b c d e " * 3, "#* | <x>\nz\n\nz\n \t\nz", *(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + "\n" * rng.randint(0, 2) for _ in range(300)),
             " ".join(str(i % 7000) for i in range(20_000))]
    for t in texts:
        assert quality.counts_of(t)[:5] == plain_counts(t), repr((t or "")[:80])


def test_quality_rules(spark, odd, empty):  # noqa: F811
    got = quality.rules(odd).collect()
    assert len(got) == odd.count() and not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.rules(empty).count() == 0
    normal = [(i, f"some plain words number {i} of a text that is like all the others and says little {i * 7}", "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join(f"w{j}###***" for j in range(20)), "en", "s") for i in range(20)]
    loud = [(2000 + i, " ".join(f"w{i}x{j}***" for j in range(20)), "xx", "loud") for i in range(300)]  # as loud as its whole group
    kept = {r["doc_id"]: r["kept"] for r in quality.rules(spark.createDataFrame(normal + junk + loud, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[d] for d, *_ in normal + loud) and not any(kept[d] for d, *_ in junk)


def test_sketches_merge(spark):
    """Quantiles of merged sketches are within a hundredth of the exact ones."""
    rng = np.random.default_rng(2)
    rows = [(i, "en" if i % 2 else None, f"s{i % 3}", 1000, 1000, int(x), 0, 0, 1, 0, 0) for i, x in enumerate(rng.lognormal(4, 1, 3000))]
    names = ["_k", "_l", "_s", *quality.COUNTS]
    frame = spark.createDataFrame(rows, "_k long, _l string, _s string, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    assert frame.columns == names
    r = quality.quartile(quality.sketches(frame), []).where("share = 'symbols'").first()
    exact = np.quantile([x[5] for x in rows], [0.25, 0.75])
    assert abs(r["q1"] / exact[0] - 1) < 0.03 and abs(r["q3"] / exact[1] - 1) < 0.03 and r["total"] == 3000


def test_archive_round_trip():
    records = [warc.record(i, f"http://x/{i}\r\n y", f"<html><body><p>page {i} of many</p></body></html>".encode() * (i % 7), None) for i in range(2000)]
    raw = warc.archive(records)
    assert raw[:4] == warc.SKIPPABLE and list(warc.records_of(raw)) == records
    assert len(raw) < 0.8 * sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    for few in ([], records[:1]):
        assert list(warc.records_of(warc.archive(few))) == few
    with pytest.raises(ValueError):
        list(warc.records_of(raw[:-3]))
    for i in (0, 1, -1, 2**63 - 1, -2**63, None, 123456789012):
        assert warc.page_of(warc.urn(i)) == i
    fields, http, payload = warc.parse(warc.record(5, None, b"\r\n\r\nx", (None,)))
    assert fields["warc-type"] == "revisit" and http["content-length"] == "5" and payload == b"" and warc.page_of(fields["warc-refers-to"]) is None


def test_archives(spark):
    pages = [(i, f"http://h/{i}", f"<p>{i % 5}</p>" * (i % 3), "extra", "sha") for i in range(60)] + [(None, None, None, None, None), (7, "http://h/7", "<p>2</p>", None, None), (99, "u", "é" * 200_000, None, None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, row string, sha string")
    got = warc.write_and_read(frame, payloads=True, archive_bytes=2000).collect()
    assert Counter(r["page_id"] for r in got) == Counter(p[0] for p in pages)
    groups = defaultdict(list)
    for p in pages:
        groups[p[2] or ""].append(p[0])
    of_page = {p[0]: p[2] or "" for p in pages}
    for text, ids in groups.items():
        top = max(i for i in ids if i is not None)
        assert sum(r["record_type"] == "response" for r in got if of_page[r["page_id"]] == text) == 1
        for r in got:
            if of_page[r["page_id"]] == text:
                assert r["payload_bytes"] == len(text.encode()) and r["payload_digest"] == warc.digest(text.encode())
                assert r["refers_to"] == (top if r["record_type"] == "revisit" else None)
                assert r["record_type"] == "revisit" or (r["page_id"] == top and r["payload"] == text.encode())
    assert warc.write_and_read(frame.limit(0)).count() == 0


def shard_facts(rows, shards):
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) <= set(range(shards))
    return [load[s] for s in range(shards)]


def test_shards(spark, odd, empty):  # noqa: F811
    rng = random.Random(6)
    texts = [f"text {i} " + "x" * rng.randint(10, 900) for i in range(1500)]
    texts += [t for i, t in enumerate(texts[:300]) for _ in range(i % 4)] + ["hot " * 50] * 900 + [None, ""]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    assigned = sharding.assign(docs, 8)
    rows = assigned.collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    load = shard_facts(rows, 8)
    average = sum(load) / 8
    assert max(load) < 1.02 * average and min(load) > 0.98 * average, load
    groups = defaultdict(Counter)
    for r in rows:
        if texts[r["doc_id"]] is not None:
            groups[texts[r["doc_id"]]][r["shard"]] += 1
    small = [g for t, g in groups.items() if 1 < sum(g.values()) < 100]
    assert sum(len(g) == 1 for g in small) > 0.8 * len(small)  # hashing alone would leave about one in eight whole
    assert shard_facts(sharding.assign(odd, 4).collect(), 4)
    assert sharding.assign(empty).count() == 0


def test_shards_of_copies_only(spark):
    docs = spark.createDataFrame([(i, f"copy {i // 50} " * 10) for i in range(1000)], "doc_id long, text string")
    load = shard_facts(sharding.assign(docs, 4).collect(), 4)
    assert max(load) < 1.05 * sum(load) / 4 and min(load) > 0.95 * sum(load) / 4


def test_quotas_keep_the_limits():
    rng = random.Random(3)
    for _ in range(20):
        load = [100 + rng.uniform(-3, 3) for _ in range(6)]
        wanted = {(a, b): rng.uniform(0, 30) for a in range(6) for b in range(6) if a != b and rng.random() < 0.5}
        flow = sharding.quotas(wanted, load, 95, 105)
        after = [load[s] + sum(v for (_, b), v in flow.items() if b == s) - sum(v for (a, _), v in flow.items() if a == s) for s in range(6)]
        assert all(94.9 < x < 105.1 for x in after) and all(v <= wanted[k] + 1e-9 for k, v in flow.items())


def neighbours(rows, every, k):
    """Brute force over usable rows."""
    rows = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            near = sorted((-(v @ w) / (np.sqrt(v @ v) * np.sqrt(w @ w)), i) for i, w in rows.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_neighbours_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)] + [(200 + i, [1.0] * 8) for i in range(30)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] + [1.0] * 7), (None, [1.0] * 8), (304, [float("inf")] * 8), (350, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 0, 0.5) for i, v in rows], "vec_id long, embedding array<double>, query long, score double")
    got = defaultdict(list)
    for r in curves.search(frame, windows=1, task_rows=40, task_queries=2).orderBy("query_id", "rank").collect():  # one window: exact
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = neighbours([r for r in rows if r[0] != 350], 50, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-12 for q in got for (_, a), (_, b) in zip(got[q], want[q]))
    assert curves.search(frame.limit(0)).count() == 0
    assert curves.search(spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")).count() == 1


def test_neighbour_recall(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    want = neighbours([tuple(r) for r in frame.collect()], 50, 5)
    got = {(r["query_id"], r["vec_id"]) for r in curves.search(frame).collect()}
    assert sum((q, i) in got for q, v in want.items() for i, _ in v) >= 0.9 * sum(map(len, want.values()))


def test_hilbert_curve_is_one():
    """Each cell once, neighbours on the curve one step apart."""
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        key = curves.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


