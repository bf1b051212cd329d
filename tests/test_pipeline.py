"""Change capture, snapshot differences and orphans, against plain Python on small random histories."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from treeline.operators.capture import LogCapture, capture_changes
from treeline.operators.orphans import orphan_groups, orphan_rows
from treeline.operators.snapshot_diff import snapshot_changes

LOG = "part string, offset bigint, key string, version bigint, value string, extra string"
RUNS = "part string, run bigint, to_offset bigint, succeeded boolean"


def expected_changes(log, runs):
    out = set()
    for part in {r[0] for r in runs}:
        before = {}
        for _, run, end, ok in sorted((r for r in runs if r[0] == part and r[3]), key=lambda r: (r[2], r[1])):
            seen = {}
            for p, off, key, ver, val, _ in log:
                if p == part and off is not None and off <= end and key is not None and val is not None:
                    seen[key] = max(seen.get(key, (ver, val)), (ver, val))
            out |= {(part, run, k) for k, s in seen.items() if k not in before or before[k][1] != s[1]}
            before = seen
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_capture_against_plain_python(spark, seed):
    r = random.Random(seed)
    hour = 3_600_000_000
    log = [(r.choice("ab"), r.randrange(0, 8 * hour, hour // 4), r.choice("xyzw"), r.randrange(20), r.choice("12"), "e") for _ in range(60)]
    log += log[:10]  # sent twice
    log += [("a", None, "x", 1, "1", "e"), ("a", 5, None, 1, "1", "e"), ("a", 5, "x", 1, None, "e"), (None, 5, "x", 1, "1", "e")]
    runs = [(p, i + 10 * (p == "b"), r.randrange(0, 9 * hour, hour // 2), r.random() < 0.7) for p in "abc" for i in range(6)]
    got = capture_changes(spark.createDataFrame(log, LOG), spark.createDataFrame(runs, RUNS)).collect()
    assert len(got) == len({tuple(x) for x in got})
    assert {tuple(x) for x in got} == expected_changes(log, runs)


def test_capture_of_empty_tables(spark):
    assert capture_changes(spark.createDataFrame([], LOG), spark.createDataFrame([("a", 1, 5, True)], RUNS)).count() == 0
    assert capture_changes(spark.createDataFrame([("a", 1, "k", 1, "v", "")], LOG), spark.createDataFrame([], RUNS)).count() == 0


def test_log_capture_survives_a_failure_between_plan_and_commit(spark, tmp_path):
    cap = LogCapture(spark, str(tmp_path))
    first = [("a", 1, "x", 1, "1", ""), ("a", 2, "y", 2, "1", "")]
    assert {r.key for r in cap.run(spark.createDataFrame(first, LOG)).collect()} == {"x", "y"}
    second = [*first, ("a", 3, "x", 3, "2", ""), ("b", 1, "z", 1, "1", "")]
    n = cap.plan(spark.createDataFrame(second, LOG))
    cap.apply(spark.createDataFrame(second, LOG), n).count()  # output written, then the process dies
    again = LogCapture(spark, str(tmp_path))
    third = [*second, ("a", 4, "w", 4, "1", ""), ("a", 5, "x", 2, "9", "")]  # arrives after the plan was written
    assert again.plan(spark.createDataFrame(third, LOG)) == n
    assert {r.key for r in again.run(spark.createDataFrame(third, LOG)).collect()} == {"x", "z"}
    # The rest comes with the next batch; an older version of x that arrived late is no change.
    assert {r.key for r in again.run(spark.createDataFrame(third, LOG)).collect()} == {"w"}
    assert again.run(spark.createDataFrame(third, LOG)).count() == 0


ROWS = "snapshot bigint, path string, size bigint, hash string, mtime bigint"
META = "snapshot bigint, series string, seq bigint, row_count bigint"


@pytest.mark.parametrize("n", [5, 700])
def test_snapshot_changes_against_plain_python(spark, n):
    r = random.Random(n)
    state, rows, meta, tables = {}, [], [], []
    for snap in range(5):
        state = {k: v for k, v in state.items() if r.random() > 0.1}
        for _ in range(n):
            state[f"p{r.randrange(2 * n)}"] = (r.choice([None, 1, 2]), r.choice([None, "a", "b"]))
        tables.append(dict(state))
        rows += [(snap, k, *v, r.randrange(9)) for k, v in state.items()] + [(snap, k, *v, 0) for k, v in list(state.items())[:3]]
        meta.append((snap, "w", snap, len(state)))
    meta[2] = (2, "w", 2, 1)  # incomplete
    meta += [(9, "w", 9, 0), meta[0]]  # an empty snapshot; a repeated row
    rows += [(None, "x", 1, "a", 1), (3, None, 1, "a", 1), (77, "x", 1, "a", 1)]
    want, full = set(), [0, 1, 3, 4, 9]
    tables += [{}] * 5
    for a, b in zip(full, full[1:], strict=False):
        o, m = tables[a], tables[b]
        want |= {(b, k, "added") for k in m.keys() - o.keys()} | {(b, k, "removed") for k in o.keys() - m.keys()} | {(b, k, "changed") for k in m.keys() & o.keys() if m[k] != o[k]}
    got = snapshot_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(meta, META), "path", ["size", "hash"]).collect()
    assert len(got) == len(want)
    assert {tuple(x) for x in got} == want


def test_snapshots_of_empty_tables(spark):
    assert snapshot_changes(spark.createDataFrame([], ROWS), spark.createDataFrame([(1, "w", 1, 0)], META), "path", ["size"]).count() == 0
    assert snapshot_changes(spark.createDataFrame([], ROWS), spark.createDataFrame([], META), "path", ["size"]).count() == 0


def test_orphans_by_period(spark):
    parents = spark.createDataFrame([(0, "a", 3, None), (0, "b", 3, 5), (0, "b", 7, None), (0, "b", 7, None), (0, "c", 4, 4), (0, None, 1, None)], "target int, key string, live_from int, live_until int")
    refs = [(0, "a", 2, 1), (0, "a", 3, 2), (0, "b", 4, 3), (0, "b", 5, 4), (0, "b", 7, 5), (0, "c", 4, 6), (0, "d", 4, 7), (0, None, 4, 8), (1, "a", 5, 9), (0, "d", None, 10), (0, "d", 4, 7)]
    children = spark.createDataFrame(refs, "target int, key string, period int, row int")
    assert sorted(r.row for r in orphan_rows(children, parents, ["row"]).collect()) == [1, 4, 6, 7, 9]
    assert {(r.key, r.period, r.refs) for r in orphan_groups(children, parents).collect() if r.target == 0} == {("a", 2, 1), ("b", 5, 1), ("c", 4, 1), ("d", 4, 2)}
    assert orphan_rows(children.limit(0), parents, ["row"]).count() == 0
    assert orphan_rows(children, parents.limit(0), ["row"]).count() == 8


def test_log_capture_takes_records_that_tie_with_the_end_of_a_range(spark, tmp_path):
    cap = LogCapture(spark, str(tmp_path), merge=2)
    log = [("p", 10, "a", 1, "1", "")]
    assert [r.key for r in cap.run(spark.createDataFrame(log, LOG)).collect()] == ["a"]
    log += [("p", 10, "b", 1, "1", "")]  # same offset, came later
    assert [r.key for r in cap.run(spark.createDataFrame(log, LOG)).collect()] == ["b"]
    assert cap.run(spark.createDataFrame(log, LOG)).count() == 0
    log += [("p", 12, "a", 2, "2", ""), ("q", 12, "a", 1, "1", "")]
    assert {(r.part, r.key) for r in cap.run(spark.createDataFrame(log, LOG)).collect()} == {("p", "a"), ("q", "a")}


@pytest.mark.parametrize("seed", [1, 2])
def test_log_capture_with_crashes_delivers_every_change_once(spark, tmp_path, seed):
    """A growing log, a crash at a random point of some batches; what is delivered in the end is what a run without crashes delivers."""
    r = random.Random(seed)
    log, offset, seen, state = [], 0, [], {}
    for _ in range(6):
        for _ in range(r.randrange(1, 6)):
            offset += r.randrange(0, 2)
            log.append((r.choice("pq"), offset, r.choice("xyz"), offset, r.choice("12"), ""))
        df = spark.createDataFrame(log, LOG)
        cap = LogCapture(spark, str(tmp_path), merge=3, common=True)
        crash = r.choice(["no", "plan", "apply"])
        n = cap.plan(df)
        if crash == "no" or crash == "apply":
            cap.apply(df, n)
        if crash != "no":
            continue
        cap.commit(n)
        seen += [(x.part, x.key, x.version, x.value) for x in spark.read.parquet(f"{tmp_path}/out/{n}").collect()]
    df = spark.createDataFrame(log, LOG)
    for _ in range(2):  # a waiting plan, then the rest
        seen += [(x.part, x.key, x.version, x.value) for x in LogCapture(spark, str(tmp_path), merge=3).run(df).collect()]
    for part, _, key, version, value, _ in log:
        state[part, key] = max(state.get((part, key), (version, value)), (version, value))
    assert len(seen) == len(set(seen))
    last = {}
    for part, key, version, value in seen:
        assert (part, key) not in last or last[part, key][1] != value
        last[part, key] = (version, value)
    assert {k: v[1] for k, v in last.items()} == {k: v[1] for k, v in state.items()}


def test_snapshots_of_any_size_have_leaves_of_one_size(spark, monkeypatch):
    """With leaves of two rows a few hundred keys make a deep tree; the result is that of the flat one."""
    import treeline.operators.snapshot_diff as D

    r = random.Random(5)
    rows, keys = [], [f"k{i}" for i in range(700)]
    state = {k: "1" for k in keys}
    for snap in (1, 2, 3):
        for k in r.sample(keys, 9):
            state[k] = str(r.randrange(5)) if k in state and r.random() < 0.7 else state.pop(k, None) or "9"
        rows += [(snap, k, v) for k, v in state.items()]
    df = spark.createDataFrame(rows, "snapshot bigint, k string, v string")
    meta = spark.createDataFrame([(s, "w", s, sum(x[0] == s for x in rows)) for s in (1, 2, 3)], "snapshot bigint, series string, seq bigint, row_count bigint")
    flat = {tuple(x) for x in snapshot_changes(df, meta, "k", ["v"]).collect()}
    monkeypatch.setattr(D, "ROWS_PER_LEAF", 2 ** -18)
    assert spark.range(1).select(D.leaf_level(F.lit(700))).first()[0] == 4
    assert {tuple(x) for x in snapshot_changes(df, meta, "k", ["v"]).collect()} == flat and flat


def test_small_scans_are_spread_and_other_plans_left_alone(spark, tmp_path):
    from treeline.sources.tables import spread

    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert spread(df, "id").rdd.getNumPartitions() == 4 and {r.id for r in spread(df).collect()} == set(range(10))
    grouped = df.groupBy("id").count()
    assert spread(grouped) is grouped
