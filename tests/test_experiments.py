"""Experiments take every clause and the survey's sizes, and run to their end on the smallest tables."""

from __future__ import annotations

from clausespark.catalog import models
from clausespark.catalog.inputs import CLAUSE_NAMES
from clausespark.operators import vocabulary as V
from clausespark.plans import experiments as X

SF_DIR = "/root/testdata/sf0.001"


def test_settings():
    assert models.WHOLE == (CLAUSE_NAMES, V.BIGRAMS_20K)
    assert models.SIZES == [5_000, 10_000, 20_000, 50_000, 100_000]
    arms = X.ablation_arms()
    assert arms["champion"][0] == V.BIGRAMS_20K and arms["char_only"][0] == V.CHARACTERS_20K
    assert arms["fewer_features"][0].max_features == 5_000 and {s.trees for _, s in arms.values()} == {50}


def test_sweep_runs_whole(spark):
    rows = {r["arm"]: r for r in models.experiment_regularisation_sweep(spark, SF_DIR).collect()}
    assert set(rows) == {f"C={c}" for c in X.C_VALUES}
    assert sum(r["best_macro_f1"] for r in rows.values()) == 1 and sum(r["best_hr_f1"] for r in rows.values()) == 1
    best = max(r["macro_f1"] for r in rows.values())
    assert next(r for r in rows.values() if r["best_macro_f1"])["macro_f1"] == best
