import datetime as dt

import numpy as np
import pytest

from tidemark.operators import folds, nested
from tidemark.operators.learners import elastic_net_of

LEARNERS = {
    "ridge": nested.Learner(("a", "b")),
    "one": nested.Learner(("b",), options={"penalty": 3.0}),
    "net": nested.Learner(("a", "b"), elastic_net_of, {"l1": 0.01, "l2": 0.1}),
}


def data(spark, n=700, seed=1, late=90):
    rng = np.random.default_rng(seed)
    day = [dt.date(2020, 1, 1) + dt.timedelta(int(x)) for x in np.sort(rng.integers(0, 140, n))]
    lag = np.where(rng.random(n) < 0.05, late, rng.integers(0, 6, n))
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = a - 2 * b + rng.normal(size=n)
    rows = [(i, s, s + dt.timedelta(int(k)) if i % 41 else None, float(p), float(q), float(v) if i % 29 else None) for i, (s, k, p, q, v) in enumerate(zip(day, lag, a, b, y))]
    return rows, spark.createDataFrame(rows, "i long, s date, e date, a double, b double, y double").repartition(6)


def both_folds(df):
    outer = folds.session_folds(df, "s", "e", min_train=30, max_train=50, test=10, step=20, embargo=2, partial=True)
    return outer, folds.inner_folds(df, outer, "s", "e", 15, 5, 10)


def test_forecasts_equal_refitting_each_fold(spark, tmp_path):
    rows, df = data(spark)
    outer, inner = both_folds(df)
    got, made = nested.nested_forecasts(df, outer, inner, LEARNERS, "s", "e", "y", f"file://{tmp_path}/cache")
    got = {(r.outer_id, r.inner, r.learner, r.i): r for r in got.collect()}
    windows = {r.fold_id: r for r in outer.collect()}
    tasks = [(o, 0, w.train_start, w.train_end, w.test_start, w.test_end, None) for o, w in windows.items()]
    tasks += [(r.outer_id, r.inner, windows[r.outer_id].train_start, r.train_end, r.test_start, r.test_end, windows[r.outer_id].train_end) for r in inner.collect()]
    assert len(windows) > 2 and len(tasks) > 2 * len(windows)
    want, some_late = {}, False
    for o, k, start, end, first, last, seen in tasks:
        train = [r for r in rows if r[2] and r[5] is not None and start <= r[1] and max(r[1], r[2]) <= end]
        some_late |= any(r[2] and r[1] < start and max(r[1], r[2]) > end for r in rows)
        x, y = np.array([[1, r[3], r[4]] for r in train]), np.array([r[5] for r in train])
        for name, use in LEARNERS.items():
            at = [0] + [1 + "ab".index(f) for f in use.features]
            m = np.column_stack([x[:, at], y])
            coef = use.solve(m.T @ m, **use.options)
            for r in rows:
                if first <= r[1] <= last and (seen is None or (r[2] and max(r[1], r[2]) <= seen)):
                    want[o, k, name, r[0]] = (len(train), float(np.array([1, r[3], r[4]])[at] @ coef))
    assert some_late and set(got) == set(want)
    for key, (n, f) in want.items():
        assert got[key].train_rows == n and abs(got[key].forecast - f) < 1e-7
    assert 0 < made <= len(tasks) * len(LEARNERS)


def test_second_run_makes_no_fit_and_changes_make_some(spark, tmp_path):
    rows, df = data(spark, 400)
    outer, inner = both_folds(df)
    cache = f"file://{tmp_path}/cache"
    run = lambda d, ls: nested.nested_forecasts(d, outer, inner, ls, "s", "e", "y", cache)
    first, made = run(df, LEARNERS)
    again, none = run(df.repartition(3), LEARNERS)
    assert made > 0 and none == 0
    assert sorted(first.collect(), key=str) == sorted(again.collect(), key=str)
    # options are part of the key: one of three learners is fitted anew
    _, some = run(df, LEARNERS | {"one": nested.Learner(("b",), options={"penalty": 4.0})})
    assert some * 3 == made
    # and so are the rows: a changed value changes the fits whose window holds it
    changed = [(*r[:5], r[5] + 1) if r[0] == 150 else r for r in rows]
    _, some = run(spark.createDataFrame(changed, df.schema), LEARNERS)
    assert 0 < some < made


def test_a_task_without_a_fit_fails(spark, tmp_path):
    _, df = data(spark, 300)
    outer, inner = both_folds(df)
    tasks = nested.task_table(outer, inner, LEARNERS)
    tasks = nested.keyed(tasks, nested.window_sums(df, tasks, "s", "e", ["a", "b"], "y"), LEARNERS)
    fits, _ = nested.fit_tasks(tasks, LEARNERS, ["a", "b"], f"file://{tmp_path}/cache")
    lost = fits.orderBy("fit_key").limit(1)
    with pytest.raises(ValueError, match="without a fit"):
        nested.forecasts(df, tasks, fits.join(lost, "fit_key", "left_anti"), "s", "e", ["a", "b"])
