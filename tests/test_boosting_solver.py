"""Histogram boosting and the block solver against plain versions, and small real runs of the experiments."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausespark.operators import boosting as B
from clausespark.operators import linear
from clausespark.operators import solver as S
from clausespark.plans import experiments as X

CLAUSES = ["Insurance", "Non-Compete", "Audit Rights"]
TERMS, DOCS = 12, 90


def sample():
    draw = random.Random(4)
    entries = [(d, t, round(draw.random(), 3)) for d in range(DOCS) for t in range(TERMS) if draw.random() < 0.4]
    has = {(d, t): w for d, t, w in entries}
    labels = []
    for d in range(DOCS):
        labels.append((d, "Insurance", int(has.get((d, 3), 0) > 0.4 or draw.random() < 0.05)))
        labels.append((d, "Non-Compete", int((d, 5) in has and (d, 7) not in has)))
        labels.append((d, "Audit Rights", 0))
    return entries, labels


@pytest.fixture(scope="module")
def data(spark):
    entries, labels = sample()
    weights = spark.createDataFrame(entries, "doc_id long, term_id int, weight double").repartition(3)
    label_rows = spark.createDataFrame(labels, "doc_id long, clause string, y int")
    docs = spark.range(DOCS).withColumnRenamed("id", "doc_id")
    rows = B.packed(weights, docs).join(linear.label_table(label_rows, CLAUSES), "doc_id").cache()
    return weights, label_rows, rows, linear.positives_and_negatives(label_rows, CLAUSES)


def plain_bins(entries, bins, min_rows):
    """Per term the smallest cell of each bin."""
    out = {}
    for t in range(TERMS):
        cells = sorted(min(int(w * B.CELLS), B.CELLS - 1) for _, u, w in entries if u == t)
        steps = min(bins, max(1, len(cells) // max(min_rows, 3)))
        lows = {}
        for c in sorted(set(cells)):
            lows.setdefault(steps * sum(x < c for x in cells) // len(cells), c)
        if len(cells) >= min_rows:
            out[t] = [lows[k] for k in sorted(lows)]
    return out


def plain_tree(x, g, h, used, settings, lows):
    """Nodes (term, bin) and leaf values of one tree by trying every split, in heap order."""
    nodes, values = {}, {}

    def grow(i, rows, depth):
        total = (g[rows].sum(), h[rows].sum())
        values[i] = -settings.rate * total[0] / (total[1] + settings.l2)
        if depth == settings.depth:
            return
        best = None
        for t in used:
            for b in range(1, len(lows[t]) + 1):
                if not (x[rows, t] == b).any():
                    continue  # parts the rows as the next bin does
                right = rows[x[rows, t] >= b]
                left = rows[x[rows, t] < b]
                if min(len(left), len(right)) < settings.min_rows or min(h[left].sum(), h[right].sum()) < settings.min_hessian:
                    continue
                part = lambda r: g[r].sum() ** 2 / (h[r].sum() + settings.l2)
                gain = float(B.digits(np.array(part(left) + part(right) - part(rows))))
                if gain > 0 and (best is None or (-gain, t, b) < best[:3]):
                    best = (-gain, t, b, left, right)
        if best:
            nodes[i] = best[1:3]
            grow(2 * i + 1, best[3], depth + 1)
            grow(2 * i + 2, best[4], depth + 1)

    grow(0, np.arange(len(x)), 0)
    return nodes, values


@pytest.mark.parametrize(
    "settings",
    [B.Boosting(trees=4, depth=3, columns=1.0, min_rows=5), B.Boosting(trees=3, depth=4, columns=0.6, min_rows=1, min_hessian=1.0, l2=1.0, weighted=False)],
)
def test_trees_are_those_of_a_plain_search(data, settings):
    weights, _, rows, counts = data
    bins = B.Bins.of(B.bin_edges(weights, bins=8, min_rows=settings.min_rows))
    lows = plain_bins(sample()[0], 8, settings.min_rows)
    assert bins.terms.tolist() == sorted(lows)
    assert [(e // B.CELLS, e % B.CELLS) for e in bins.edges.tolist()] == [(k, c) for k, t in enumerate(sorted(lows)) for c in lows[t]]
    model = B.fit(B.binned_blocks(rows, bins, len(CLAUSES)), bins, counts, CLAUSES, settings)
    x = np.zeros((DOCS, TERMS), int)
    for d, t, w in sample()[0]:
        if t in lows:
            x[d, t] = sum(low <= min(int(w * B.CELLS), B.CELLS - 1) for low in lows[t])
    y = {c: np.zeros(DOCS) for c in CLAUSES}
    for d, c, v in sample()[1]:
        y[c][d] = v
    assert model.constants == {"Audit Rights": 0.0} and len(model.trees) == settings.trees
    margins = {}
    for k, column in enumerate(model.columns):
        own = y[CLAUSES[column.clause]]
        weight = max(1.0, (own == 0).sum() / own.sum()) if settings.weighted else 1.0
        margin = np.full(DOCS, math.log(own.sum() * weight / (own == 0).sum()))
        for number, tree in enumerate(model.trees):
            p = 1 / (1 + np.exp(-margin))
            w = np.where(own == 1, weight, 1.0)
            used = [t for t, ok in zip(sorted(lows), B.chosen_terms(settings, number, len(lows))) if ok]
            nodes, values = plain_tree(x, (p - own) * w, p * (1 - p) * w, used, settings, lows)
            found = {i: (sorted(lows)[tree.term[k, i]], int(tree.low[k, i])) for i in np.flatnonzero(tree.term[k] >= 0)}
            assert found == nodes
            for d in range(DOCS):
                i = 0
                while i in nodes:
                    i = 2 * i + 1 + (x[d, nodes[i][0]] >= nodes[i][1])
                if nodes:
                    margin[d] += values[i]
        margins[CLAUSES[column.clause]] = margin
    for r in B.score(model, rows.select("doc_id", "i", "w")).collect():
        want = 0.0 if r["clause"] == "Audit Rights" else 1 / (1 + math.exp(-margins[r["clause"]][r["doc_id"]]))
        assert r["prob"] == pytest.approx(want, rel=1e-9)
    vocabulary = rows.sparkSession.range(TERMS).select(F.col("id").cast("int").alias("term_id"), F.concat(F.lit("t"), "id").alias("term"))
    shares = B.importances(model, vocabulary).groupBy("clause").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(1.0) for r in shares)


def test_state_is_written_and_leaves_are_bounded(data, monkeypatch):
    weights, _, rows, counts = data
    bins = B.Bins.of(B.bin_edges(weights, min_rows=2))
    blocks = B.binned_blocks(rows, bins, len(CLAUSES))
    settings = B.Boosting(trees=5, depth=4, columns=1.0, min_rows=2, leaves=3)
    whole = B.fit(blocks, bins, counts, CLAUSES, settings)
    monkeypatch.setattr(B, "CUT", 2)
    again = B.fit(blocks, bins, counts, CLAUSES, settings)
    for a, b in zip(whole.trees, again.trees):
        assert (a.term == b.term).all() and np.allclose(a.value, b.value)
        assert ((a.term >= 0).sum(axis=1) <= 2).all()


def test_search_halves_its_trials(data):
    weights, _, rows, counts = data
    bins = B.Bins.of(B.bin_edges(weights, min_rows=2))
    blocks = B.binned_blocks(rows, bins, len(CLAUSES), held=F.col("doc_id") % 4 == 0)
    trials = [B.Boosting(trees=3 + 2 * k, depth=2, rate=0.1 * (k + 1), columns=1.0, min_rows=2) for k in range(4)]
    found = X.search(blocks, bins, counts, CLAUSES, trials, rungs=(2, 4))
    assert [t for t, _, _ in found] == [0, 1, 2, 3] and all(0 <= s <= 1 for _, _, s in found)
    assert sum(grown == 2 for _, grown, _ in found) == 2 and max(grown for _, grown, _ in found) > 4
    # a trial on its own grows the same trees: learning leaves out the held rows
    alone = B.fit_columns(blocks, bins, *zip(*[B.column_of(i, *counts[i], trials[3]) for i in (0, 1)]), 2)
    both = B.fit_columns(blocks, bins, *zip(*[B.column_of(i, *counts[i], t) for t in trials for i in (0, 1)]), 2)
    assert (both.trees[1].term[-2:] == alone.trees[1].term).all()


def test_drawn_trials_keep_to_their_ranges():
    trials = X.draw_trials()
    assert len(trials) == 20 and trials == X.draw_trials()
    assert all(30 <= t.trees <= 120 and 3 <= t.depth <= 8 and 0.04 <= t.rate <= 0.3 and 0.3 <= t.columns <= 0.9 for t in trials)
    assert all(5 <= t.min_rows <= 30 and 0.5 <= t.pos_weight_mult <= 3 and 0.5 <= t.rows <= 1 and 1e-3 <= t.l2 <= 10 for t in trials)


def dense():
    x = np.zeros((DOCS, TERMS))
    for d, t, w in sample()[0]:
        x[d, t] = w
    return x


def test_columns_are_stationary(data):
    """Each column's gradient, worked out from the dense matrix, is nil: penalties, folds, sizes, hinge and masks alike."""
    _, _, rows, counts = data
    folds = rows.withColumn("fold", (F.col("doc_id") % 3).cast("int"))
    columns = [
        S.balanced(0, counts[0]), S.balanced(1, counts[1], c=5.0), S.balanced(0, counts[0], terms=6),
        S.balanced(1, counts[1], without_fold=2, loss="squared hinge"), S.balanced(0, counts[0], c=0.1),
    ]
    mask = np.ones((TERMS, len(columns)))
    mask[:4, 4] = 0
    weights, bias, largest = S.minimise(S.row_blocks(folds, len(CLAUSES), "fold"), TERMS, columns, mask, tolerance=1e-7)
    assert (largest <= 1e-6).all() and (weights[6:, 2] == 0).all() and (weights[:4, 4] == 0).all()
    labels = {(d, c): v for d, c, v in sample()[1]}
    for k, column in enumerate(columns):
        x = dense()
        if column.terms is not None:
            x[:, column.terms :] = 0
            x /= np.maximum(np.sqrt((x**2).sum(axis=1)), 1e-300)[:, None]
        y = np.array([labels[d, CLAUSES[column.clause]] for d in range(DOCS)])
        sign, w = 2 * y - 1, np.where(y == 1, column.weight_pos, column.weight_neg) / column.n
        if column.without_fold is not None:
            w = w * (np.arange(DOCS) % 3 != column.without_fold)
        z = (x @ weights[:, k] + bias[k]) * sign
        slope = -sign / (1 + np.exp(z)) if column.loss == "logistic" else -2 * sign * np.maximum(0, 1 - z)
        gradient = x.T @ (w * slope) * mask[:, k] + weights[:, k] / (column.c * column.n)
        assert np.abs(gradient).max() < 1e-6 and abs((w * slope).sum()) < 1e-6
    got = S.margins(rows, weights, bias, [c.terms for c in columns]).collect()
    assert len(got) == DOCS * len(columns)
    for r in got:
        x = dense()[r["doc_id"]]
        if r["column"] == 2:
            x[6:] = 0
            x = x / max(np.sqrt((x**2).sum()), 1e-300)
        assert r["margin"] == pytest.approx(x @ weights[:, r["column"]] + bias[r["column"]], abs=1e-9)


def test_sigmoid_fit_is_stationary():
    margin = np.array([-2.0, -1.0, -0.25, 0.5, 1.0, 3.0])
    n, n1 = np.array([9.0, 7, 5, 5, 6, 8]), np.array([0.0, 1, 2, 3, 5, 8])
    a, b = S.sigmoid_fit(margin, n1, n)
    high, low = (n1.sum() + 1) / (n1.sum() + 2), 1 / ((n - n1).sum() + 2)
    gap = n / (1 + np.exp(-(a * margin + b))) - (n1 * high + (n - n1) * low)
    assert a > 0 and abs(gap.sum()) < 1e-6 and abs((gap * margin).sum()) < 1e-6
    assert all(map(math.isfinite, S.sigmoid_fit(np.array([-1.0, 1.0]), np.array([0.0, 4]), np.array([4.0, 4]))))


def test_arms_share_their_jobs(spark):
    """Arms over vocabularies side by side score as each would alone."""
    from clausespark.operators import vocabulary as V

    draw = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    texts = [(d, " ".join(draw.choices(words, k=25)) + (" insured" if d % 3 == 0 else "")) for d in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(d, "Insurance", int(d % 3 == 0)) for d in range(60)], "doc_id long, clause string, y int")
    settings = B.Boosting(trees=3, depth=2, columns=1.0, min_rows=3)
    arms = {"words": (V.TermSpec(hi=1, max_features=40), settings), "pairs": (V.TermSpec(hi=2, max_features=300), settings)}
    together = {(r["arm"], r["doc_id"]): r["prob"] for r in X.grow_arms(arms, docs, labels, docs, ["Insurance"]).collect()}
    assert len(together) == 120
    for name, arm in arms.items():
        alone = X.grow_arms({name: arm}, docs, labels, docs, ["Insurance"]).collect()
        assert all(together[name, r["doc_id"]] == pytest.approx(r["prob"]) for r in alone)
    judged = {r["arm"]: r for r in X.judge_arms(X.grow_arms(arms, docs, labels, docs, ["Insurance"]), labels).collect()}
    assert judged["words"]["macro_f1"] > 0.9


def test_boosted_bundle_is_saved_and_loaded(data, spark, tmp_path):
    from clausespark.plans import production

    rows = [(d, f"alpha{d % 5} beta{d % 3} gamma" + (" insured party" if d % 4 == 0 else "")) for d in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, "Insurance", int(d % 4 == 0)) for d in range(80)], "doc_id long, clause string, y int")
    from clausespark.operators import vocabulary as V

    bundle = production.train_boosted(docs, labels, ["Insurance"], V.TermSpec(max_features=50), B.Boosting(trees=5, depth=2, columns=1.0, min_rows=3))
    production.save(bundle, str(tmp_path / "bundle"))
    loaded = production.load(spark, str(tmp_path / "bundle"))
    first, second = (sorted(map(tuple, production.score(b, docs).collect())) for b in (bundle, loaded))
    assert first == second and len(first) == 80
    assert production.evaluate(loaded, docs, labels).first()["macro_f1"] == pytest.approx(1.0)


def test_singular_vectors_are_those_of_the_dense_matrix(data):
    """The first singular values and the subspace agree with a whole decomposition; projections and explained variance too."""
    from clausespark.operators import blocks

    weights, _, rows, _ = data
    basis, values = S.singular_vectors(S.row_blocks(rows, len(CLAUSES)), TERMS, 4, rounds=12)
    _, want, right = np.linalg.svd(dense(), full_matrices=False)
    assert values == pytest.approx(want[:4], rel=1e-4)
    assert basis.T @ basis == pytest.approx(np.eye(4), abs=1e-9)
    for k in range(4):
        assert abs(basis[:, k] @ right[k]) == pytest.approx(1.0, abs=1e-3)
    found = S.projected(rows, basis)
    for r in found.collect():
        assert r["lsa"] == pytest.approx(dense()[r["doc_id"]] @ basis, abs=1e-9)
    share = blocks.explained_variance(found, weights, 4).first()["explained_variance"]
    assert share == pytest.approx((dense() @ basis).var(axis=0).sum() / dense().var(axis=0).sum())
    again, _ = S.singular_vectors(S.row_blocks(rows, len(CLAUSES)), TERMS, TERMS)
    assert abs(again @ again.T) == pytest.approx(np.eye(TERMS), abs=1e-9)


def test_feature_space_numbers_every_block(spark):
    from clausespark.operators import blocks

    names = {"b": ["y", "x"], "a": ["z"], "c": ["x", "w"]}
    space = blocks.feature_space({k: spark.createDataFrame([(n,) for n in v], "feature string") for k, v in names.items()})
    assert {(r["block"], r["feature"]): r["position"] for r in space.collect()} == {
        ("b", "x"): 0, ("b", "y"): 1, ("a", "z"): 2, ("c", "w"): 3, ("c", "x"): 4,
    }
    stacked = spark.createDataFrame([(1, "b", "x", 2.0), (1, "c", "x", 4.0)], "doc_id long, block string, feature string, weight double")
    scales = spark.createDataFrame([("c", "x", 0.25)], "block string, feature string, scale double")
    got = {r["position"]: r["weight"] for r in blocks.positioned(stacked, space, scales).collect()}
    assert got == {0: 2.0, 4: 1.0}
