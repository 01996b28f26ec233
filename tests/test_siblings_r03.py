"""Sums of a level of boosted trees: one child of a node is summed, the other one follows; blocks of a task are joined."""

import numpy as np
import pytest

from clausespark.operators import boosting as B

WIDTH, TERMS, ROWS = 4, 40, 60
COLUMNS = [B.Column(0, B.Boosting(columns=1.0, min_rows=1), 2.0), B.Column(1, B.Boosting(columns=0.6, rows=0.8, min_rows=1), 1.0)]


def blocks(n=5):
    draw = np.random.default_rng(2)
    found = []
    for b in range(n):
        met = draw.random((TERMS, ROWS)) < 0.3
        row = np.nonzero(met)[1].astype(np.int32)
        held = draw.random(ROWS) < 0.1
        found.append(B.Block(list(range(b * ROWS, (b + 1) * ROWS)), np.append(0, np.cumsum(met.sum(axis=1))), row, draw.integers(1, WIDTH, len(row)).astype(np.uint8),
                             draw.integers(0, 2, (ROWS, 2)).astype(np.uint8), draw.integers(0, 2**60, ROWS).astype(np.uint64), held))
    return found


def parts():
    draw = np.random.default_rng(3)
    return [(b.prepared(WIDTH), draw.standard_normal((2, ROWS))) for b in blocks()]


def split_twice():
    tree = B.Trees.empty(2, 2)
    tree.term[:, 0], tree.low[:, 0] = (3, 5), (2, 1)
    tree.term[:, 1], tree.low[:, 1] = (7, 9), (1, 2)
    tree.term[1, 2], tree.low[1, 2] = 11, 1
    return tree


@pytest.mark.parametrize("dense", [1, B.DENSE])
def test_the_other_child_is_what_the_parent_has_more(monkeypatch, dense):
    monkeypatch.setattr(B, "DENSE", dense)  # sums of one node at a time, and of all
    tree, once = split_twice(), split_twice()
    once.term[:, 1:] = -1
    before = list(B.histograms(parts(), COLUMNS, once, 0, 1, WIDTH))
    want = dict(B.histograms(parts(), COLUMNS, tree, 0, 2, WIDTH))
    going = np.zeros((2, 4), bool)
    going[0, :2], going[1, :] = True, True
    small = going & (np.arange(4) % 2 == 1)
    now = list(B.histograms(parts(), COLUMNS, tree, 0, 2, WIDTH, small))
    assert 0 < sum(len(x[0]) for _, x in now) < 0.6 * sum(len(x[0]) for x in want.values())
    kept = [(at, (*x, 1)) for at, x in before]
    found = dict(B.level_sums([*now, *kept], small, going))
    assert sorted(found) == sorted(want)
    for at, (key, sums, totals, level) in found.items():
        nodes = np.flatnonzero(going[at // B.ranges_of(2)])
        assert level == 2 and (key == want[at][0]).all() and np.allclose(sums, want[at][1]) and (sums[2] == want[at][1][2]).all()
        assert np.allclose(totals[:, nodes], want[at][2][:, nodes])


def test_joined_blocks_have_the_same_sums(monkeypatch):
    tree, margins = split_twice(), np.concatenate([m for _, m in parts()], axis=1)
    one = list(B.joined(iter(blocks())))
    assert len(one) == 1 and one[0].ids == list(range(5 * ROWS))
    joined = dict(B.histograms([(one[0].prepared(WIDTH), margins)], COLUMNS, tree, 0, 2, WIDTH))
    for at, (key, sums, totals) in B.histograms(parts(), COLUMNS, tree, 0, 2, WIDTH):
        assert (key == joined[at][0]).all() and np.allclose(sums, joined[at][1]) and np.allclose(totals, joined[at][2])
    monkeypatch.setattr(B, "JOINED", 2 * len(one[0].row) // 5)
    assert 1 < len(list(B.joined(iter(blocks())))) < 5


def test_nodes_of_one_class_are_not_split_by_rounding():
    """Every part of a node of one class has the same mean, so a gain is what rounding leaves."""
    draw = np.random.default_rng(4)
    n = draw.integers(20, 900, 500).astype(float)
    sums = np.stack([n * (1 / 3), n * (2 / 9), n])
    totals = np.array([[4e6 / 3], [8e6 / 9], [4e6]])
    slots = np.arange(500, dtype=np.int64) * WIDTH + 1
    assert B.best_splits((slots, sums, totals, 0), 0, B.Boosting(), WIDTH) == []
    sums[0, 17] *= 1.5
    assert [s[2] for s in B.best_splits((slots, sums, totals, 0), 0, B.Boosting(), WIDTH)] == [17]


def test_entries_that_come_twice_hide_no_rows(spark):
    """The right side's sums count doubled entries twice; the left side still has its 36 rows and is split."""
    rows = []
    for d in range(60):
        i = [0, 0] if d < 24 else [1] if d < 42 else []
        rows.append((d, i, [0.5] * len(i), int(d < 24 or (d < 42 and d % 4 != 0))))
    table = spark.createDataFrame(rows, "doc_id long, i array<int>, w array<double>, y0 int")
    settings = B.Boosting(trees=1, depth=2, columns=1.0, min_rows=10, weighted=False)
    bins = B.Bins(np.array([0, 1]), np.array([0, B.CELLS]), np.array([0, 1]), 1)
    column, start = B.column_of(0, 38.0, 22.0, settings)
    tree = B.fit_columns(B.binned_blocks(table, bins, 1), bins, [column], [start], 1).trees[0]
    assert tree.term[0, :3].tolist() == [0, 1, -1]
