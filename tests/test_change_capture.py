"""Change capture against a loop over runs, under failures, and with saves that land late."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tenetry.streaming.change_capture import _LOG, ChangeCapture, Interrupted, changed

SAVES = "save_id bigint, id string, updated_at timestamp_ntz, arrived_at timestamp_ntz, part int, batch string"
RUNS = "run_id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, status string"
T0 = dt.datetime(2024, 1, 1)


def at(m):
    return T0 + dt.timedelta(minutes=m)


def saves_of(rng, n, keys=12):
    """Rows with clashing extra columns (part, batch), a hot key, late, repeated and null rows."""
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(keys)}"
        up = rng.randrange(400)
        rows.append((i, key, at(up), at(up + rng.choice([0, 0, 5, 90])), 1, "x"))
    rows += [(n + i, r[1], r[2], r[3] + dt.timedelta(minutes=30), 1, "x") for i, r in enumerate(rng.sample(rows, n // 5))]
    rows += [(9001, None, at(1), at(2), 1, "x"), (9002, "k1", None, at(2), 1, "x"), (9003, "k1", at(399), None, 1, "x")]
    return rows


def expected(saves, runs):
    out, before = set(), {}
    for run, start, _, status in sorted((r for r in runs if r[1] is not None), key=lambda r: (r[1], r[0])):
        if status != "succeeded":
            continue
        now = {}
        for _, k, up, arr, *_ in saves:
            if k is not None and up is not None and arr is not None and arr <= start:
                now[k] = max(now.get(k, up), up)
        out |= {(run, k) for k, up in now.items() if k not in before or up > before[k]}
        before = now
    return out


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_a_table(spark, tmp_path, seed):
    rng = random.Random(seed)
    saves = saves_of(rng, 150)
    runs = [(i, at(rng.randrange(500)) if i else None, None, rng.choice(["succeeded", "failed", "killed"])) for i in range(12)]
    got = changed(spark.createDataFrame(saves, SAVES), spark.createDataFrame(runs, RUNS), str(tmp_path), rows_per_partition=7).collect()
    assert len(got) == len({(r["run_id"], r["id"]) for r in got})
    assert {(r["run_id"], r["id"]) for r in got} == expected(saves, runs)


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SAVES)
    runs = spark.createDataFrame([(1, at(1), None, "succeeded")], RUNS)
    assert changed(none, runs, str(tmp_path / "a")).count() == 0
    assert changed(spark.createDataFrame(saves_of(random.Random(1), 20), SAVES), spark.createDataFrame([], RUNS), str(tmp_path / "b")).count() == 0


def test_failures_neither_skip_nor_repeat(spark, tmp_path):
    saves = saves_of(random.Random(7), 120)
    df = spark.createDataFrame(saves, SAVES).cache()
    cap = ChangeCapture(spark, str(tmp_path / "state"), rows_per_partition=20)
    got = {r["id"] for r in cap.run(df, at(100)).collect()}
    for stop in ("plan", "sink"):
        with pytest.raises(Interrupted):
            cap.run(df, at(180 if stop == "plan" else 220), fail_after=stop)
    second = {r["id"] for r in cap.run(df, at(300)).collect()}
    runs = [(1, at(100), None, "succeeded"), (2, at(180), None, "failed"), (3, at(220), None, "killed"), (4, at(300), None, "succeeded")]
    want = expected(saves, runs)
    assert got == {k for r, k in want if r == 1}
    assert second == {k for r, k in want if r == 4}
    assert cap.run(df, at(300)).count() == 0


def test_late_saves_are_not_lost(spark, tmp_path):
    """Saves that land after a run, with its stamps and smaller numbers, stand behind what was there and come out once."""
    cap = ChangeCapture(spark, str(tmp_path / "state"))
    row = lambda n, k, up, arr: (n, k, at(up), at(arr), 1, "x")
    rows = [row(50, "x", 10, 10)]
    steps = [([], {"x"}), ([row(7, "y", 10, 10)], {"y"}), ([], set()), ([row(3, "z", 1, 2), row(4, "x", 5, 3)], {"z"}), ([row(2, "x", 11, 3), row(2, "x", 11, 3)], {"x"})]
    for more, want in steps:
        rows += more
        assert {r["id"] for r in cap.run(spark.createDataFrame(rows, SAVES), at(20)).collect()} == want
    held = cap.log().collect()
    assert len(held) == 5 and len({(r["part"], r["pos"]) for r in held}) == 5


def test_saves_that_are_not_visible_yet_wait(spark, tmp_path):
    cap = ChangeCapture(spark, str(tmp_path / "state"), rows_per_partition=1)
    rows = [(i, f"k{i}", at(i), at(i), 1, "x") for i in range(40)]
    df = spark.createDataFrame(rows, SAVES)
    seen = [sorted(r["id"] for r in cap.run(df, at(m)).collect()) for m in (9.5, 9.5, 25.5, 60)]
    assert [len(s) for s in seen] == [10, 0, 16, 14] and len(set().union(*map(set, seen))) == 40


def test_a_broken_append_is_made_anew(spark, tmp_path):
    cap = ChangeCapture(spark, str(tmp_path / "state"))
    df = spark.createDataFrame([(1, "a", at(1), at(1), 1, "x"), (None, "b", at(1), at(1), 1, "x")], SAVES)
    cap._write(df.select(F.lit("9").alias("save"), "id", "updated_at", "arrived_at", F.lit(0).alias("part"), F.lit(1).alias("pos")), "log", 0, _LOG)
    assert {r["id"] for r in cap.run(df, at(5)).collect()} == {"a", "b"}
    assert cap.log().count() == 2 and cap.run(df, at(9)).count() == 0 and cap.log().count() == 2
