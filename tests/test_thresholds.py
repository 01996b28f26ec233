"""Threshold policies, metrics and ordered totals against brute force."""

import math

import pytest
from pyspark.sql import functions as F

from clausespark.operators import ensembles as E
from clausespark.operators import metrics as M
from clausespark.operators import thresholds as T
from clausespark.operators.ordering import exact_percentiles, global_rank, running_totals


def by_clause(scores):
    table = {}
    for r in scores.collect():
        table.setdefault(r["clause"], []).append((r["doc_id"], r["prob"], r["y"]))
    return {c: sorted(rows) for c, rows in table.items()}


def f1(rows, t):
    tp = sum(y for _, p, y in rows if p >= t)
    fp = sum(1 - y for _, p, y in rows if p >= t)
    fn = sum(y for _, p, y in rows if p < t)
    return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0


def found(df):
    return {r["clause"]: r["thr"] for r in df.collect()}


def test_scut_and_best(scores_tiny):
    got, best = found(T.scut(scores_tiny)), found(T.best_threshold(scores_tiny))
    for c, rows in by_clause(scores_tiny).items():
        t_best, top = 0.5, f1(rows, 0.5)
        for t in T.SCUT_GRID:
            if f1(rows, t) > top:
                t_best, top = t, f1(rows, t)
        assert got[c] == pytest.approx(t_best), c
        t_best, top = 0.5, 0.0
        for t in T.SCUT_GRID:
            if f1(rows, t) > top:
                t_best, top = t, f1(rows, t)
        assert best[c] == pytest.approx(t_best), c


def test_pcut_breaks_ties_by_id(scores_tiny, spark):
    rates = spark.createDataFrame([("Insurance", 0.25), ("Audit Rights", 0.01), ("Non-Compete", 0.0)], "clause string, thr double")
    preds = T.pcut(scores_tiny, rates)
    chosen = {}
    for r in preds.where("pred = 1").collect():
        chosen.setdefault(r["clause"], set()).add(r["doc_id"])
    assert chosen == {"Insurance": {0, 1}, "Audit Rights": {0}, "Non-Compete": {9}}
    assert preds.count() == scores_tiny.count()


def test_adaptive_uses_share_only_for_rare_clauses(scores_tiny, spark):
    rates = spark.createDataFrame([("Insurance", 0.4), ("Audit Rights", 0.05)], "clause string, thr double")
    frequent = spark.createDataFrame([("Insurance", 0.8)], "clause string, thr double")
    preds = T.adaptive(scores_tiny, rates, frequent)
    counts = {r["clause"]: r["n"] for r in preds.groupBy("clause").agg(F.sum("pred").alias("n")).collect()}
    assert counts["Insurance"] == 4 and counts["Audit Rights"] == 1


def test_curve_policies(scores_tiny):
    points = T.curve(scores_tiny)
    roc, pr = found(T.roc_youden(points)), found(T.pr_youden(points))
    floor = found(T.recall_floor(points))
    for c, rows in by_clause(scores_tiny).items():
        pos, neg = sum(y for *_, y in rows), sum(1 - y for *_, y in rows)
        levels = sorted({p for _, p, _ in rows}, reverse=True)
        if pos == 0 or neg == 0:
            assert roc[c] == 0.5
        else:
            gains = [(sum(y for _, p, y in rows if p >= t) / pos - sum(1 - y for _, p, y in rows if p >= t) / neg, t) for t in levels]
            top = max(g for g, _ in gains)
            assert roc[c] == (next(t for g, t in gains if g == top) if top > 0 else math.inf)
        if pos:
            quality = []
            for t in sorted(levels):
                tp, flagged = sum(y for _, p, y in rows if p >= t), sum(p >= t for _, p, _ in rows)
                quality.append((tp / flagged + tp / pos - 1, t))
            top = max(q for q, _ in quality)
            assert pr[c] == next(t for q, t in quality if q == top)
        else:
            assert c not in pr
    assert set(floor) == {"Change Of Control"}


def test_auc_is_the_share_of_ordered_pairs(scores_tiny):
    got = {r["clause"]: r["auc"] for r in M.auc(T.curve(scores_tiny)).collect()}
    for c, rows in by_clause(scores_tiny).items():
        pos, neg = [p for _, p, y in rows if y], [p for _, p, y in rows if not y]
        if pos and neg:
            want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
            assert got.pop(c) == pytest.approx(want)
    assert not got


def test_metrics_by_hand(scores_tiny):
    preds = T.fixed_threshold(scores_tiny)
    rows = {r["clause"]: r for r in M.per_clause(preds, active_only=False).collect()}
    assert (rows["Insurance"]["tp"], rows["Insurance"]["fp"], rows["Insurance"]["fn"]) == (3, 1, 1)
    assert rows["Insurance"]["f1"] == 0.75 and rows["Non-Compete"]["f1"] == 0.0 and rows["Change Of Control"]["f1"] == 1.0
    one = M.summary(M.per_clause(preds)).first()
    assert one["macro_f1"] == pytest.approx((0.75 + 1.0 + 0.0) / 3) and one["n_clauses"] == 3
    assert one["hr_f1"] == 1.0
    assert M.evaluate(preds).first()["macro_auc"] is not None


def test_scaled_prior(scores_tiny, spark):
    rates = spark.createDataFrame([(c, 0.4) for c in by_clause(scores_tiny)], "clause string, thr double")
    sweep = {r["scale"]: r["macro_f1"] for r in T.scale_sweep(scores_tiny, rates, T.VALIDATION_SCALES).collect()}
    for scale in T.VALIDATION_SCALES:
        values = [f1(rows, scale * 0.4) for rows in by_clause(scores_tiny).values() if any(y for *_, y in rows)]
        assert sweep[scale] == pytest.approx(sum(values) / len(values))
    best = max(sweep.values())
    assert T.pick_scale(T.scale_sweep(scores_tiny, rates, T.VALIDATION_SCALES)).first()["scale"] == min(s for s, v in sweep.items() if round(v, 9) == round(best, 9))


def test_blend_bounds_and_missing_models(scores_tiny):
    other = scores_tiny.where("clause <> 'Insurance'").withColumn("prob", 1 - F.col("prob"))
    mixed = E.blend(scores_tiny, other, 0.3)
    assert mixed.count() == scores_tiny.count()
    assert mixed.where("prob < 0 OR prob > 1").count() == 0
    same = mixed.where("clause = 'Insurance'").join(scores_tiny.withColumnRenamed("prob", "own"), ["doc_id", "clause"])
    assert same.where("prob <> own").count() == 0


def test_router_takes_the_default_with_few_positives(scores_tiny):
    routes = {r["clause"]: r for r in E.route({"a": scores_tiny, "b": scores_tiny}, default="a", preferred="b").collect()}
    assert routes["Audit Rights"]["config"] == "a" and routes["Audit Rights"]["thr"] == 0.5
    assert routes["Insurance"]["config"] == "b"


def test_running_totals_with_one_hot_key(spark):
    """One key holds nearly all rows; its slices still add up in order."""
    rows = spark.range(2000).select(
        F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("k"), ((F.col("id") * 7919) % 2000).alias("v"), F.lit(2).alias("w")
    )
    got = running_totals(rows, ["k"], [F.col("v").desc()], {"total": "w"}, slices=7)
    table = {}
    for r in got.collect():
        table.setdefault(r["k"], []).append((r["v"], r["total"]))
    for values in table.values():
        for i, (_, total) in enumerate(sorted(values, reverse=True)):
            assert total == 2 * (i + 1)
    ranks = [r["rank"] for r in global_rank(rows, [], [F.col("v")]).orderBy("v").collect()]
    assert ranks == list(range(1, 2001))


def test_exact_percentiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 8)] + [("b", 3.0)], "k string, v double")
    got = {r["k"]: (r["q1"], r["mid"]) for r in exact_percentiles(df, ["k"], "v", {"q1": 0.25, "mid": 0.5}).collect()}
    assert got == {"a": (1.75, 3.0), "b": (3.0, 3.0)}
