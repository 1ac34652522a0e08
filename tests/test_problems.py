"""The operators of problems 1 to 7 against brute force, on small tables with nulls, ties, repeated rows and clashing column names."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.timeparse import instant_us, ntz_us, utc_us
from tidegauge.operators import dedup, hierarchy, intervals, latedata, lookup, outliers, regrid, timestamps
from tidegauge.session import ship


def covered(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


@pytest.mark.parametrize("bucket", [7, 50, 1_000_000])
def test_intervals_against_brute_force(spark, bucket):
    rng = random.Random(bucket)
    rows = [(rng.choice("abc"), s := rng.randrange(0, 400), s + rng.randrange(-3, 25)) for _ in range(120)]
    rows += [("a", None, 5), ("a", 5, None), (None, 1, 2), ("d", 5, 5), ("e", 10, 20), ("e", 20, 30), ("e", 31, 32)] + rows[:10]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "k string, s long, e long, bucket string, n int")
    merged = intervals.merge_periods(df, "k", "s", "e", bucket_us=bucket)
    want = {k: covered([(s, e) for key, s, e in rows if key == k and s is not None and e is not None and e > s]) for k in "abcde"}
    got = sorted((r.k, r.period_start, r.period_end) for r in intervals.busy_periods(merged, "k").collect())
    assert got == sorted((k, *p) for k, ps in want.items() for p in ps)
    gaps = sorted(tuple(r) for r in intervals.gaps(merged, "k").collect())
    assert gaps == sorted((k, a[1], b[0]) for k, ps in want.items() for a, b in zip(ps[:-1], ps[1:], strict=True))


def test_intervals_of_an_empty_table_and_units(spark):
    none = spark.createDataFrame([], "k string, s long, e long")
    assert intervals.gaps(intervals.merge_periods(none, "k", "s", "e"), "k").count() == 0
    same = spark.createDataFrame([(1609460744,), (1609460744014,), (1609460744014638,), (1609460744014638999,), (None,)], "t long")
    got = [r[0] for r in same.select(intervals.to_us(F.col("t"))).collect()]
    assert got == [1609460744000000, 1609460744014000, 1609460744014638, 1609460744014638, None]


def brute_tree(rows):
    parent = {}
    for g, n, p in rows:
        if g is None or n is None:
            continue
        p = (p or "").strip().lower()
        p = p if p.strip("0") else None
        key = (g, n.strip().lower())
        old = parent.get(key)
        parent[key] = min(x for x in (old, p) if x is not None) if (old or p) else None
    out = {}
    for (g, n), p in parent.items():
        seen, path, at = set(), [n], n
        while True:
            up = parent[(g, at)]
            if up is None or (g, up) not in parent:
                out[(g, n)] = (p, path[-1], len(path) - 1, "/".join(reversed(path)))
                break
            if up in seen:
                out[(g, n)] = (p, None, -1, "")
                break
            seen.add(up)
            path.append(up)
            at = up
    return out


def tree_rows(seed):
    rng = random.Random(seed)
    rows = []
    for g in ("t1", "t2", "t3"):
        names = [f"{i:04x}" for i in range(60)]
        for i, n in enumerate(names):
            up = rng.choice([names[max(0, i - 1)], names[rng.randrange(0, max(1, i))], "ffff", None, "", "0000"]) if i else None
            rows.append((g, n.upper() if i % 7 == 0 else n, up))
    chain = [f"{i:04x}" for i in range(80)]
    rows += [("deep", a, b) for a, b in zip(chain[1:], chain[:-1], strict=True)] + [("deep", chain[0], None)]
    rows += [("ring", "a1", "a2"), ("ring", "a2", "a3"), ("ring", "a3", "a1"), ("ring", "b1", "a1"), ("ring", "b2", "b1"), ("ring", "c1", "c1"), ("ring", "d1", None), ("ring", "d2", "d1")]
    rows += [("star", f"{i:04x}", "00aa") for i in range(1, 50)] + [("star", "00aa", " 0000 ")]
    rows += [(None, "a", "b"), ("t1", None, "b"), *rows[::5]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [10**6, 55, 1])
def test_hierarchy_both_ways_against_brute_force(spark, limit):
    rows = tree_rows(3)
    df = spark.createDataFrame([(*r, "x") for r in rows], "t string, n string, p string, depth string")
    tree = hierarchy.hierarchy(df, "t", "n", "p", limit=limit)
    want = brute_tree(rows)
    got = {(r.grp, r.node): r for r in hierarchy.paths(tree).collect()}
    assert got.keys() == want.keys()
    assert {(r.grp, r.node): r.path for r in hierarchy.paths(tree, bucket=7).collect()} == {k: r.path for k, r in got.items()}
    for key, (parent, root, depth, path) in want.items():
        r = got[key]
        assert (r.parent, r.root, r.depth, "/".join(r.path)) == (parent, root, depth, path), key
    below = defaultdict(set)
    for (g, n), (_, root, depth, path) in want.items():
        if depth >= 0:
            for a in path.split("/")[:-1]:
                below[(g, a)].add(n)
    for (g, n), r in got.items():
        if r.depth >= 0:
            inside = {m for (h, m), d in got.items() if h == g and d.depth >= 0 and r.first < d.first <= r.last}
            assert inside == below[(g, n)]
    some = spark.createDataFrame([("deep", "0005"), ("star", "00aa"), ("ring", "a1")], "grp string, node string")
    assert hierarchy.descendants(tree, some).count() == 74 + 49


def test_hierarchy_of_an_empty_table(spark):
    assert hierarchy.hierarchy(spark.createDataFrame([], "t string, n string, p string"), "t", "n", "p").count() == 0


INSTANTS = [
    ("2021-03-04 05:06:07", "8", 1614805567000000), ("2021-03-04T05:06:07.1234569Z", "8", 1614834367123456), ("2021/03/04 05:06:07,123", "UTC", 1614834367123000),
    ("20210304050607", "+0530", 1614814567000000), ("20210304T050607Z", None, 1614834367000000), ("2021年03月04日 05:06:07", "0", 1614834367000000),
    ("04.03.2021 05:06:07", "GMT+05:45", 1614813667000000), ("03/04/2021 12:06:07 AM", "-5", 1614834367000000), ("03/04/2021 12:06:07 PM", "UTC", 1614859567000000),
    ("04/Mar/2021:05:06:07 +0100", None, 1614830767000000), ("Thu, 04 Mar 2021 05:06:07 +0000", "99", 1614834367000000), ("4-Mar-2021 05:06:07", "Etc/GMT-2", 1614827167000000),
    ("Thu Mar  4 05:06:07 2021", "America/New_York", 1614852367000000), ("2021-07-04 05:06:07 EDT", None, 1625389567000000), ("  1614834367 ", None, 1614834367000000),
    ("1614834367.5", None, 1614834367500000), ("1614834367123", None, 1614834367123000), ("1614834367123456", None, 1614834367123456), ("1614834367123456789", None, 1614834367123456),
    ("2021-10-31 02:30:00", "Europe/Berlin", 1635640200000000), ("2021-03-28 02:30:00", "Europe/Berlin", 1616895000000000), ("2021-02-30 05:06:07", "UTC", None),
    ("0000-00-00 00:00:00", "UTC", None), ("2021-03-04 05:06:07", "99", None), ("2021-03-04 05:06:07", "local", None), ("2021-03-04 05:06:07", "", None), ("N/A", "8", None), (None, "8", None),
    ("13/04/2021 01:02:03 PM", "UTC", None), ("03/04/2021 13:02:03 PM", "UTC", None), ("2021-03-04 05:06:07", "5.5", 1614814567000000), ("123456", "UTC", None),
]


def test_instants_of_all_notations(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in INSTANTS], "s string, z string")
    got = [r[0] for r in df.select(instant_us(spark, F.col("s"), F.col("z"))).collect()]
    assert got == [x for *_, x in INSTANTS]
    ts = spark.sql("select timestamp_ntz'2021-03-04 05:06:07.000009' t, ' 2021-03-04 05:06:07 ' u, '2021-03-04 05:06:07' v")
    assert tuple(ts.select(ntz_us(F.col("t")), utc_us(spark, F.col("u")), utc_us(spark, F.col("v"))).first()) == (1614834367000009, 1614834367000000, 1614834367000000)


def test_dictionary_grows_and_parses_once(spark):
    rows = [(i, None if i % 3 else a, a, z) for i, (a, z, _) in enumerate(INSTANTS * 2)]
    df = spark.createDataFrame(rows, "id long, utc string, loc string, zone string").withColumn("raw", F.lit(1))
    dictionary = timestamps.InstantDictionary(spark)
    first = {r.id: r.utc_us for r in timestamps.normalise(df, "id", "utc", "loc", "zone", dictionary).collect()}
    size = dictionary.table().count()
    again = {r.id: r.utc_us for r in timestamps.normalise(df, "id", "utc", "loc", "zone", dictionary).collect()}
    assert first == again and dictionary.table().count() == size == dictionary.table().select(*timestamps.KEYS).distinct().count()
    told = {i: t for i, (_, _, t) in enumerate(INSTANTS * 2) if i % 3 and t is not None}
    assert {k: v for k, v in first.items() if k % 3} == told
    assert timestamps.normalise(df.limit(0), "id", "utc", "loc", "zone").count() == 0


def test_lookup_with_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HEAVY_SHARE", 10)
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(40)] + [(99, None)], "id long, k string")
    entries = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.upper("k"))
    got = sorted((r.id, r.v) for r in lookup.lookup(left, entries, ["k"], "n", 41).collect())
    assert got == sorted((i, "HOT" if i % 2 else f"K{i}") for i in range(40))


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_one_copy_of_each_message(spark, batches, monkeypatch):
    monkeypatch.setattr(dedup, "ARRAY_IDS", 8)
    rng = random.Random(batches)
    rows = [(i, rng.choice([1, 2]), rng.choice(["ab", "AB ", "cd", None]), rng.choice([*range(12), None]), rng.choice([*range(50), None])) for i in range(300)]
    df = spark.createDataFrame(rows, "rec_id long, d int, a string, g long, sec long").withColumn("at", F.timestamp_seconds("sec").cast("timestamp_ntz")).withColumn("hi", F.lit("x"))
    key = dedup.message_key(F.col("d"), dedup.folded(F.col("a")), F.col("g"))
    groups = defaultdict(list)
    for i, d, a, g, s in rows:
        if a is not None and g is not None:
            groups[(d, a.strip().lower(), g)].append((10**9 if s is None else s, i))
    want = sorted(i for v in groups.values() for _, i in sorted(v)[1:])
    assert sorted(r[0] for r in dedup.repeated_deliveries(df, key, "at", "rec_id", batches).collect()) == want
    assert dedup.deduplicated(df, key, "at", "rec_id", batches).count() == 300 - len(want)
    assert dedup.repeated_deliveries(df.limit(0), key, "at", "rec_id", batches).count() == 0


def test_identifier_index_survives_compaction(spark):
    ids = spark.range(500).select(F.xxhash64("id").alias("hi"), F.xxhash64(F.lit(1), "id").alias("lo"), "id")
    index = dedup.IdentifierIndex(spark, 500)
    for part in range(3):
        index.add(index.novel(ids.where(F.col("id") % 4 == part)))
    index.compact()
    assert len(index.runs) == 1
    assert sorted(r.id for r in index.novel(ids).collect()) == list(range(3, 500, 4))


def readings_of(spark):
    rng = np.random.RandomState(5)
    rows, want = [], {}
    rid = 0

    def add(source, values, flags, step=60):
        nonlocal rid
        for k, (v, f) in enumerate(zip(values, flags, strict=True)):
            rows.append((source, rid, f"m{k}", k * step * 1_000_000, k * step * 1_000_000 + 5, float(v), bool(0 <= v <= 100)))
            if f:
                want[rid] = f
            rid += 1
            if k % 9 == 0:  # delivered again
                rows.append((source, rid, f"m{k}", k * step * 1_000_000 + 3_000_000, k * step * 1_000_000 + 9_000_000, float(v), bool(0 <= v <= 100)))
                if f:
                    want[rid] = f
                rid += 1

    v = 30 + rng.randn(400)
    f = [None] * 400
    for i in (50, 51, 200):
        v[i], f[i] = 80, "spike"
    v[300:309], f[300:309] = 31.25, ["stuck"] * 9
    v[20:27] = 30.5  # seven equal readings are no run
    v[350] = 400  # impossible: judged elsewhere
    add("steady", v, f)
    add("level", np.r_[10 + rng.randn(300), 60 + rng.randn(60), 10 + rng.randn(100)], [None] * 460)
    z, g = np.zeros(200), [None] * 200
    z[77], g[77] = 50, "spike"
    add("zero", z, g)
    add("switching", [(12 if (i // 4) % 2 else 55) + rng.rand() for i in range(200)], [None] * 200)
    df = spark.createDataFrame(rows, "source string, id long, message string, at long, received long, value double, possible boolean").withColumn("least", F.lit(0.1)).withColumn("n_source", F.lit(0)).drop("n_source")
    return df, want


@pytest.mark.parametrize("bucket_s", [60, 600, 6 * 3600, 10**7])
def test_implausible_readings_whatever_the_buckets(spark, bucket_s, monkeypatch):
    monkeypatch.setattr(outliers, "BUCKET_US", bucket_s * 1_000_000)
    df, want = readings_of(spark)
    assert {r.id: r.reason for r in outliers.implausible(df).collect()} == want
    assert outliers.implausible(df.limit(0)).count() == 0


def test_slow_excursions_are_no_spikes(spark):
    """The same height reached by jumps and by plausible steps: only the jump is a spike."""
    rng = np.random.RandomState(3)
    v = 50 + np.cumsum(rng.choice([-1.0, 1.0], 600))
    v = 50 + (v - v.mean()) / np.abs(v - v.mean()).max() * 4
    jump, slow = v.copy(), v.copy()
    jump[300:303] = 90
    slow[297:306] += np.array([4, 8, 12, 16, 20, 16, 12, 8, 4.0])
    rows = [(s, k + off, f"m{k}", k * 60_000_000, k * 60_000_000, float(x), True) for s, off, y in (("jump", 0, jump), ("slow", 1000, slow)) for k, x in enumerate(y)]
    df = spark.createDataFrame(rows, "source string, id long, message string, at long, received long, value double, possible boolean").withColumn("least", F.lit(0.1))
    got = {r.id for r in outliers.implausible(df).collect() if r.reason == "spike"}
    assert {300, 301, 302} <= got and not any(i < 300 or 302 < i < 1000 for i in got)


@pytest.mark.parametrize("batch", [7, 10_000])
def test_even_grid(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rng = random.Random(7)
    have = {1: sorted(rng.sample(range(100), 40)), 2: [5], 3: [0, 1, 2, 400, 403]}
    rows = [(h, (s * 300 + rng.randrange(300)) * 1_000_000, float(10 + s % 12)) for h, ss in have.items() for s in ss for _ in range(2)]
    rows += [(None, 1, 1.0), (1, None, 1.0), (1, 5, None), (1, 5, float("nan"))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "h long, t long, v double, slot int")
    got = regrid.regular_series(df, "h", "t", "v").collect()
    filled = sorted((r.source, r.slot // 300) for r in got if r.filled)
    assert filled == sorted([(1, s) for s in range(have[1][0], have[1][-1]) if s not in have[1]] + [(3, 401), (3, 402)])
    assert sorted((r.source, r.slot // 300) for r in got if not r.filled) == sorted((h, s) for h, ss in have.items() for s in ss)
    assert all(np.isfinite(r.value) for r in got)
    assert regrid.regular_series(df.limit(0), "h", "t", "v").count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_imputation_follows_the_period():
    t = np.arange(400)
    x = 50 + 10 * np.sin(2 * np.pi * t / 24)
    missing = np.random.RandomState(1).rand(400) < 0.2
    missing[[0, -1]] = False
    missing[100:108] = True
    y = regrid.ssa_impute(np.where(missing, np.nan, x), missing)
    linear = np.interp(t, t[~missing], x[~missing])
    assert np.abs(y - x)[missing].mean() < 0.25 * np.abs(linear - x)[missing].mean()
    assert np.array_equal(y[~missing], x[~missing]) or np.allclose(y[~missing], x[~missing])
    assert regrid.ssa_impute(np.array([1.0, np.nan, 3.0]), np.array([False, True, False])).tolist() == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("runs", [1, 4])
def test_late_records_correct_their_periods(spark, runs):
    rng = random.Random(runs)
    rows = []
    for _ in range(600):
        event = rng.randrange(0, 200_000)
        late = rng.choice([rng.randrange(0, 200), rng.randrange(0, 30_000), rng.randrange(0, 250_000)])
        rows.append((rng.choice([1, 1, 1, 2, 3]), event * 1_000_000, (event + late) * 1_000_000))
    want = defaultdict(lambda: [0, 0, 0])
    for s, e, r in rows:
        p = e // 3_600_000_000 * 3600
        late = r - (p + 3600) * 1_000_000
        w = want[(s, p)]
        w[0] += late <= 120_000_000
        w[1] += late <= 21_600_000_000
        w[2] += late > 21_600_000_000
    extra = [(None, 1, 1), (1, None, 1), (1, 1, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows + extra], "source long, event_us long, received_us long, n_first string")
    got = {(r.source, r.period_start): [r.n_first, r.n_final, r.n_dropped] for r in latedata.corrected_periods(df, runs=runs).collect()}
    assert got == dict(want)
    assert latedata.corrected_periods(df.limit(0), runs=runs).count() == 0


def test_shipped_things_arrive(spark):
    get = ship(spark, {"a": 1})
    assert spark.range(3).select("id").mapInPandas(lambda it: (p.assign(id=get()["a"]) for p in it), "id long").distinct().collect()[0][0] == 1


@pytest.mark.parametrize("gap", [24, 60, 150])
def test_imputation_settles_over_long_gaps(gap, monkeypatch):
    place = np.arange(2000)
    true = 30 + 8 * np.sin(2 * np.pi * place / 72)
    x = true + np.random.RandomState(gap).randn(2000)
    missing = (place % (gap + 150) >= 150) & (place < 1900)
    x[missing] = np.nan
    y = regrid.ssa_impute(x, missing)
    start = np.interp(place, place[~missing], x[~missing])
    z = y - start.mean()
    trajectory = np.lib.stride_tricks.sliding_window_view(z, regrid.WINDOW)
    leading = np.linalg.svd(trajectory, full_matrices=False)[2][: regrid.RANK]
    low_rank = trajectory @ leading.T @ leading
    again = np.array([low_rank[::-1].diagonal(k - len(low_rank) + 1).mean() for k in range(2000)])
    assert np.abs(again - z)[missing].max() < regrid.TOLERANCE * start.std() and np.allclose(y[~missing], x[~missing])
    if gap == 24:
        assert np.sqrt(((y - true)[missing] ** 2).mean()) < 0.8
    monkeypatch.setattr(regrid, "MOST_ROUNDS", 3)
    with pytest.warns(RuntimeWarning, match="source 5"):
        regrid.ssa_impute(x, missing, "source 5")
