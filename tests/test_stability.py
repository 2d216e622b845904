"""PSI in tiles against the plain sum over pairs."""
from __future__ import annotations

import numpy as np
import pytest

from bookdq.functions.stability import psi_between_peers
from tests.test_functions import reference_psi


@pytest.mark.parametrize("tile", [3, 7, 1000])
def test_tiles_give_the_medians_of_all_pairs(spark, tile):
    rng = np.random.default_rng(8)
    counts = {}
    for part, many in (("p", 23), ("q", 10), ("r", 1), ("s", 2)):
        for a in range(many):
            counts[part, a] = [0 if rng.random() < 0.4 else int(x) for x in rng.integers(1, 40, 6)]
            counts[part, a][rng.integers(6)] += 1
        counts[part, 1 if many > 1 else 0] = counts[part, 0]  # equal distributions
    rows = [(p, a, f"k{k}", n) for (p, a), ns in counts.items() for k, n in enumerate(ns) if n]
    df = spark.createDataFrame(rows, "p string, a int, k string, n long")
    got = {(r["p"], r["a"]): r for r in psi_between_peers(df, ["p", "a"], "a", "k", tile=tile).collect()}
    want = {s: [reference_psi(ns, counts[o]) for o in counts if o[0] == s[0] and o != s] for s, ns in counts.items()}
    assert set(got) == {s for s, v in want.items() if v}
    for s, r in got.items():
        assert r["psi"] == pytest.approx(float(np.median(want[s])), abs=1e-9) and r["max_pairwise_psi"] == pytest.approx(max(want[s]), abs=1e-9)
        assert r["n_peers"] == len(want[s]) and r["n"] == sum(counts[s])


def test_no_segments(spark):
    assert psi_between_peers(spark.createDataFrame([], "a int, k string, n long"), ["a"], "a", "k").count() == 0
