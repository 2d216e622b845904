"""A small seeded insurance book, clean and with planted problems, and the check settings that must find them."""
from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

from bookdq import Book, BookSpec, Measures
from bookdq.plans.registry import checks, from_dict
from bookdq.sources import read_source

COVERAGES = ["Premises", "Products", "Liquor", "Personal", "Medical"]
BASES = ["Sales", "Payroll", "Area", "Units", "Admissions"]
LIMITS = [100_000.0, 300_000.0, 500_000.0, 1_000_000.0, 2_000_000.0]
DEDUCTIBLES = [0.0, 250.0, 500.0, 1_000.0, 5_000.0]
STATES = ["CA", "TX", "NY", "FL", "IL", "PA", "OH", "GA", "NC", "MI"]


def clean_table(n: int = 14_000, seed: int = 7) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    src = rng.choice(["BOP", "BMQ", "CMQ"], n, p=[0.5, 0.3, 0.2])
    eff = np.array("2018-01-01", "datetime64[D]") + rng.integers(0, 7 * 365, n)
    policy = pd.DataFrame({
        "src": src, "pol_num": [f"{s}{i:07d}" for i, s in enumerate(src)], "pol_eff_dt": eff, "pol_exp_dt": eff + 365,
        "n_loc": np.where(src == "CMQ", 1, rng.integers(1, 4, n)), "n_cov": rng.integers(1, 4, n),
        "first_cov": rng.integers(0, 5, n), "mm_seg_cd": rng.choice(["SMALL", "MIDDLE", "LARGE"], n, p=[0.5, 0.3, 0.2]),
        "each_occ_lmt_amt": rng.choice(LIMITS, n), "split": rng.random(n) < 0.8, "bi": rng.choice(DEDUCTIBLES, n),
        "pd": rng.choice(DEDUCTIBLES, n), "csl": rng.choice(DEDUCTIBLES, n)})
    policy = policy.loc[policy.index.repeat(policy["n_loc"])].reset_index(drop=True)
    policy["loc"] = policy.groupby("pol_num").cumcount() + 1
    policy["loc_st_abbr"] = rng.choice(STATES, len(policy))
    policy["loc_zipcd"] = [f"{z:05d}" for z in rng.integers(10_000, 99_999, len(policy))]
    policy["trr_cd"] = [f"{STATES.index(s):02d}{t:02d}" for s, t in zip(policy["loc_st_abbr"], rng.integers(1, 4, len(policy)))]
    rows = policy.loc[policy.index.repeat(policy["n_cov"])].reset_index(drop=True)
    m = len(rows)
    rows["k"] = rows.groupby(["pol_num", "loc"]).cumcount()
    weight = 1 / np.arange(3, 23)
    cls = rng.choice([f"1{c:04d}" for c in range(20)], m, p=weight / weight.sum())
    expo = np.round(rng.lognormal(6, 1, m), 2)
    claims = rng.poisson(0.15, m)
    bmq = rows["src"] == "BMQ"
    cmq = rows["src"] == "CMQ"
    return pd.DataFrame({
        "src": rows["src"], "pol_num": rows["pol_num"], "pol_eff_dt": rows["pol_eff_dt"], "pol_exp_dt": rows["pol_exp_dt"],
        "covg_type_desc": [COVERAGES[(a + b) % 5] for a, b in zip(rows["first_cov"], rows["k"])], "class_cd_std": cls,
        "expo_amt": expo, "expn_bs_std": rng.choice(BASES, m), "rsk_loc_id": rows["loc"].astype("float").where(~cmq),
        "rsk_itm_id": rng.integers(1, 4, m).astype("float") * np.where(bmq, 1, np.nan), "loc_st_abbr": rows["loc_st_abbr"],
        "loc_zipcd": rows["loc_zipcd"], "trr_cd": rows["trr_cd"], "mm_seg_cd": rows["mm_seg_cd"],
        "each_occ_lmt_amt": rows["each_occ_lmt_amt"], "tot_wrtn_prm_amt": np.round(expo * rng.lognormal(0, 0.3, m), 2),
        "bi_ded_amt": rows["bi"].where(rows["split"]), "pd_ded_amt": rows["pd"].where(rows["split"]),
        "csl_ded_amt": rows["csl"].where(~rows["split"]), "tx_type_nm": rng.choice(["New Business", "Renewal"], m),
        "allocation": np.where(claims > 0, np.round(claims * rng.lognormal(7, 1, m), 2), 0.0), "claim_cnt": claims.astype("int64"),
    }).assign(pol_eff_dt=lambda d: d["pol_eff_dt"].dt.date, pol_exp_dt=lambda d: d["pol_exp_dt"].dt.date)


def planted_table(clean: pd.DataFrame, seed: int = 11) -> pd.DataFrame:
    """One problem per entry of `EXPECTED`."""
    rng = np.random.default_rng(seed)
    t = clean.copy()
    year = np.array([d.year for d in t["pol_eff_dt"]])
    src = t["src"].to_numpy()

    def some(mask: np.ndarray, share: float) -> np.ndarray:
        return mask & (rng.random(len(t)) < share)

    t.loc[some(src == "CMQ", 0.12), "class_cd_std"] = None
    t.loc[some(src == "BOP", 0.03), "loc_zipcd"] = ""
    t.loc[some(src == "BMQ", 0.02), "expn_bs_std"] = "UNK"
    t.loc[(src == "BMQ") & (year == 2019), "tot_wrtn_prm_amt"] *= 100
    t.loc[rng.choice(np.flatnonzero(src == "BOP"), 200, replace=False), "expo_amt"] *= -1
    t.loc[rng.choice(np.flatnonzero(src == "CMQ"), 10, replace=False), "tot_wrtn_prm_amt"] = 9e7
    t.loc[some(year == 2023, 0.02), "class_cd_std"] = "99999"
    t.loc[some(src == "BMQ", 0.01), "each_occ_lmt_amt"] = 10_000_000.0
    t.loc[some(src == "BOP", 0.015), "bi_ded_amt"] = 99_999.0
    for i in rng.choice(len(t), 60, replace=False):
        t.at[i, "pol_exp_dt"] = t.at[i, "pol_eff_dt"] - dt.timedelta(days=10)
    copies = t[(src == "BMQ")].sample(frac=0.005, random_state=seed)
    cmq_copies = t[(src == "CMQ")].sample(frac=0.01, random_state=seed).assign(class_cd_std=None)
    return pd.concat([t, copies, cmq_copies, cmq_copies], ignore_index=True)


# check, variable, metric, what the segment must contain
EXPECTED = [
    ("key_uniqueness", "_key", "dup_rate", "src=BMQ"), ("key_uniqueness", "_key", "dup_rate", "src=CMQ"),
    ("missing_rate", "class_cd_std", "missing_rate", "src=CMQ"), ("missing_rate", "loc_zipcd", "missing_rate", "src=BOP"),
    ("missing_rate", "expn_bs_std", "missing_rate", "src=BMQ"), ("distribution", "tot_wrtn_prm_amt", "psi", "src=BMQ|pol_yr=2019"),
    ("distribution", "expo_amt", "pct_negative", "src=BOP"), ("distribution", "tot_wrtn_prm_amt", "max_to_p99", "src=CMQ"),
    ("distribution", "class_cd_std", "new_categories", "pol_yr=2023"), ("value_checks", "each_occ_lmt_amt", "source_unique_values", "src=BMQ"),
    ("value_checks", "bi_ded_amt", "pct_out_of_bounds", "src=BOP"), ("business_rules", "pol_exp_dt", "violation_rate", "src="),
]

SETTINGS = {
    "key_uniqueness": {"candidate_keys": {
        "BOP": ["pol_num", "pol_eff_dt", "rsk_loc_id", "covg_type_desc"], "BMQ": ["pol_num", "pol_eff_dt", "rsk_loc_id", "covg_type_desc"],
        "CMQ": ["pol_num", "pol_eff_dt", "covg_type_desc"], "_all": ["src", "pol_num", "pol_eff_dt", "rsk_loc_id", "covg_type_desc"]}},
    "missing_rate": {"default": {"warn": 0.05, "fail": 0.2, "group_by": ["src"]}, "variables": {
        "tot_wrtn_prm_amt": {"warn": 0.0, "fail": 0.001}, "class_cd_std": {"warn": 0.01, "fail": 0.05},
        "loc_zipcd": {"warn": 0.01, "fail": 0.05}, "expn_bs_std": {"warn": 0.0, "fail": 0.01, "treat_as_missing": ["UNK"]},
        "rsk_loc_id": {"applies_when": "src <> 'CMQ'"}, "rsk_itm_id": {"applies_when": "src = 'BMQ'"},
        "bi_ded_amt": {"applies_when": "csl_ded_amt IS NULL"}, "pd_ded_amt": {"applies_when": "csl_ded_amt IS NULL"},
        "csl_ded_amt": {"applies_when": "bi_ded_amt IS NULL AND pd_ded_amt IS NULL"}}},
    "business_rules": {"group_by": ["src"], "rules": [
        {"id": "exp_after_eff", "violation": "pol_exp_dt < pol_eff_dt", "variables": ["pol_exp_dt", "pol_eff_dt"], "fail": 0.0005},
        {"id": "one_deductible", "variables": ["csl_ded_amt"], "violation": "csl_ded_amt IS NOT NULL AND (bi_ded_amt IS NOT NULL OR pd_ded_amt IS NOT NULL)"},
        {"id": "loss_without_claim", "variables": ["allocation"], "applies_when": "allocation > 0", "violation": "COALESCE(claim_cnt, 0) = 0"}]},
    "value_checks": {"categorical": {"covg_type_desc": {}, "mm_seg_cd": {}, "each_occ_lmt_amt": {}, "trr_cd": {"max_values": 4000}}, "numeric": {
        "expo_amt": {"min": -1e6, "max": 1e8, "compare_medians": False}, "claim_cnt": {"min": 0, "max": 500, "allow_negative": False},
        "each_occ_lmt_amt": {"min": 25000, "max": 2e7, "discrete": True, "top_value_warn": 0.8}, "bi_ded_amt": {"min": 0, "max": 25000}}},
    "distribution": {"variables": [
        {"name": "tot_wrtn_prm_amt", "type": "numeric", "group_by": ["src", "pol_yr"], "outlier_ratio": 50, "psi": {"across": "pol_yr"}},
        {"name": "expo_amt", "type": "numeric", "allow_negative": False}, {"name": "class_cd_std", "group_by": ["pol_yr"], "psi": {"across": "pol_yr"}},
        {"name": "rsk_itm_id", "type": "numeric"}]},
    "segment_mix": {"dimensions": ["class_cd_std", "trr_cd"]},
    "target_analysis": {"variables": ["src", "covg_type_desc", "expn_bs_std"], "min_claims": 5},
}


def settings() -> dict:
    entries = checks()
    return {name: from_dict(entries[name].config, data) for name, data in SETTINGS.items()}


def to_book(spark, path: str) -> Book:
    spec = BookSpec("book", "src", ("BMQ", "BOP", "CMQ"), Measures("tot_wrtn_prm_amt", "allocation", "claim_cnt", "expo_amt", "expn_bs_std"),
                    ("pol_num", "pol_eff_dt", "pol_exp_dt"), ("src", "pol_yr", "covg_type_desc", "expn_bs_std", "class_cd_std"), {"pol_yr": "year(pol_eff_dt)"})
    return Book(spec, read_source(spark, path))
