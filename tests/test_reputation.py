import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from sequential import fold
from trustloom.functions.constants import SOURCE, VEHICLE
from trustloom.operators.reputation import latest, read_scores, trust_fold, with_account
from trustloom.session import materialise

SCHEMA = "entity string, ts timestamp_ntz, seq bigint, good boolean"


def events(n, hot_share=0.4, keys=20, seed=1):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < hot_share else f"k{rng.randrange(keys)}"
        rows.append((key, base + dt.timedelta(minutes=rng.randrange(n // 3)), i, rng.random() < 0.7))
    return rows


def folded(spark, rows, params, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return trust_fold(df, key="entity", ts="ts", seq="seq", good=F.col("good"), **params, **more)


@pytest.mark.parametrize("params,seconds", [(VEHICLE, 3600), (SOURCE, 86400)])
@pytest.mark.parametrize("slice_rows", [10**6, 100, 13])
def test_fold_equals_the_loop(spark, params, seconds, slice_rows):
    rows = events(800)
    want = fold(rows, unit_seconds=seconds, rate=params["rate"], reward=params["reward"], keep=params["keep"])
    got = folded(spark, rows, params, slice_rows=slice_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.trust == pytest.approx(want[(r.entity, r.seq)], abs=1e-9)
        assert 0 <= r.trust <= 100


def test_gap_and_decay_do_not_depend_on_slicing(spark):
    rows = events(500)
    whole = {r.seq: r for r in folded(spark, rows, VEHICLE).collect()}
    cut = {r.seq: r for r in folded(spark, rows, VEHICLE, slice_rows=11).collect()}
    for seq, r in whole.items():
        assert cut[seq].gap == pytest.approx(r.gap)
        assert cut[seq].decay == pytest.approx(r.decay)
    assert sum(r.gap is None for r in cut.values()) == len({r[0] for r in rows})


@pytest.mark.parametrize("slice_rows", [10**6, 40])
def test_state_continues_the_fold(spark, slice_rows):
    rows = sorted(events(1000), key=lambda r: (r[1], r[2]))
    want = fold(rows, unit_seconds=3600, rate=0.1, reward=0.1, keep=0.5)
    first = folded(spark, rows[:500], VEHICLE, slice_rows=slice_rows)
    state = latest(first, key="entity", order=("ts", "seq"), values=("trust", "ts"))
    second = folded(spark, rows[500:], VEHICLE, state=state, slice_rows=slice_rows)
    got = first.select("entity", "seq", "trust").unionByName(second.select("entity", "seq", "trust")).collect()
    assert {(r.entity, r.seq) for r in got} == set(want)
    for r in got:
        assert r.trust == pytest.approx(want[(r.entity, r.seq)], abs=1e-9)


def test_source_golden_rows(spark):
    base = dt.datetime(2025, 1, 1)
    steps = [(0, 0, 55.0, 55), (1, 1, 41.854095, 42), (3, 0, 44.084036, 44), (3.5, 1, 34.396478, 34),
             (13.5, 0, 28.776266, 29)]
    rows = [("s", base + dt.timedelta(days=d), i, p == 0) for i, (d, p, _, _) in enumerate(steps)]
    got = folded(spark, rows, SOURCE).orderBy("seq").collect()
    assert [round(r.trust, 6) for r in got] == [s[2] for s in steps]
    assert [r.score for r in got] == [s[3] for s in steps]


def test_rounding_is_half_to_even_and_defaults_apply(spark):
    base = dt.datetime(2025, 1, 1)
    rows = [("a", base, i, False) for i in range(2)]
    scores = folded(spark, rows, VEHICLE)
    assert [r.score for r in scores.orderBy("seq").collect()] == [25, 12]
    newest = latest(scores, key="entity", order=("ts", "seq"), values=("trust",))
    keys = spark.createDataFrame([("a",), ("zz",)], "entity string")
    for default in (0, 50):
        got = {r.entity: r.score for r in read_scores(keys, newest, key="entity", default=default).collect()}
        assert got == {"a": 12, "zz": default}


def test_bad_parameters_are_refused(spark):
    with pytest.raises(ValueError):
        folded(spark, events(9), {"unit": "hour", "rate": -1.0, "reward": 0.1, "keep": 0.5})




@pytest.mark.parametrize("slice_rows", [1_000_000, 3])
def test_null_keys_and_missing_times(spark, slice_rows):
    at = dt.datetime(2025, 1, 1)
    rows = [(None, at + dt.timedelta(hours=i), i, True) for i in range(8)] + [("a", at, 20, True), ("a", None, 21, True)]
    events = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long, good boolean")
    now = F.lit("2025-01-01 02:00:00").cast("timestamp_ntz")
    folded = trust_fold(events, key="k", ts="ts", seq="seq", good=F.col("good"), slice_rows=slice_rows, now=now)
    filled = [("" if k is None else k, t or at + dt.timedelta(hours=2), s, g) for k, t, s, g in rows]
    want = fold(filled, unit_seconds=3600, rate=0.1, reward=0.1, keep=0.5)
    assert {(r.k or "", r.seq): r.trust for r in folded.collect()} == pytest.approx(want)


def test_newest_rows_by_hash_aggregate(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at, 5, True), ("a", at, -7, False), ("a", None, 9, False), ("b", None, None, True), ("b", None, 3, False),
            ("c", dt.datetime(9999, 12, 31), -(2**63), True), ("c", dt.datetime(9999, 12, 31), 2**63 - 1, False),
            ("d", dt.datetime(1, 1, 1), 1, True), (None, at, 1, True), (None, at, 2, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    newest = latest(df, key="entity", order=("ts", "seq"), values=("good", "seq", "ts"))
    assert {(r.entity, r.seq, r.good) for r in newest.collect()} == {
        ("a", 5, True), ("b", 3, False), ("c", 2**63 - 1, False), ("d", 1, True), (None, 2, False)}
    assert "SortAggregate" not in newest._jdf.queryExecution().executedPlan().toString()
    named = latest(df.withColumn("name", F.col("seq").cast("string")), key="entity", order=("ts", "seq"), values=("name",))
    assert {(r.entity, r.name) for r in named.collect()} == {
        ("a", "5"), ("b", "3"), ("c", str(2**63 - 1)), ("d", "1"), (None, "2")}


def test_accounts_stand_beside_events(spark):
    events = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "entity string, n int")
    registry = spark.createDataFrame([("a", "0x1"), ("a", "0x0"), ("z", "0x9")], "vehicle string, account string")
    got = with_account(events, registry, key="entity", registry_key="vehicle", account="account")
    assert {(r.entity, r.n, r.account) for r in got.collect()} == {
        ("a", 1, "0x0"), ("a", 2, "0x0"), ("b", 3, None), (None, 4, None)}


def test_a_fold_that_goes_on_shuffles_events_once(spark):
    rows = events(300)
    first = folded(spark, rows[:150], VEHICLE)
    state = materialise(latest(first, key="entity", order=("ts", "seq"), values=("trust", "ts", "seq")), "state")
    both = materialise(spark.createDataFrame(rows[150:], SCHEMA), "events")
    fold_on = trust_fold(both, key="entity", ts="ts", seq="seq", good=F.col("good"), state=state, strict=True, **VEHICLE)
    assert fold_on._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("slice_rows", [10**6, 6])
def test_strict_folds_mark_late_events_and_take_repeated_ones_once(spark, slice_rows):
    hour = dt.timedelta(hours=1)
    base = dt.datetime(2024, 1, 1)
    state = spark.createDataFrame([("a", 40.0, base + 5 * hour, 9), ("z", 70.0, base, 1)],
                                  "entity string, trust double, ts timestamp_ntz, seq long")
    late = [("a", base + hour, 3, True), ("a", base + 5 * hour, 9, True), ("a", base + 5 * hour, 8, False)]
    new = [("a", base + 5 * hour, 10, False), ("a", base + 7 * hour, 11, True), ("b", base, 1, True), ("a", base + 8 * hour, 12, True)]
    rows = late + new + [new[1]] * 3 + [new[2], late[0]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = trust_fold(df, key="entity", ts="ts", seq="seq", good=F.col("good"), state=state, strict=True,
                     slice_rows=slice_rows, **VEHICLE).collect()
    assert sorted((r.entity, r.seq) for r in got if not r.late) == [("a", 10), ("a", 11), ("a", 12), ("b", 1)]
    assert {(r.entity, r.seq) for r in got if r.late} == {("a", 3), ("a", 8), ("a", 9)}
    x = 40.0 * 0.5
    want = {10: x}
    for n, gap in ((11, 2), (12, 1)):
        x *= math.exp(-0.1 * gap)
        x += 0.1 * (100 - x)
        want[n] = x
    assert {r.seq: r.trust for r in got if r.entity == "a" and not r.late} == pytest.approx(want)
    assert {r.seq: r.gap for r in got if r.entity == "a" and not r.late} == {10: 0.0, 11: 2.0, 12: 1.0}
