"""Profiles by mergeable sketches, skill tables from one scan, ranks that carry missing members."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarncast.plans import evaluation, scoring
from tarncast.sources import scan


def scans(df, word="Scan"):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count(word)


def test_sketches(spark, tmp_path):
    pick = random.Random(3)
    rows = [("hot" if pick.random() < 0.4 else f"s{i % 7}", pick.gauss(0, 5), i % 12, f"t{i % 5000}") for i in range(40_000)]
    rows += [("hot", None, None, None), ("hot", math.nan, 1, "t1"), ("empty", None, None, None), ("empty", None, None, None)]
    df = spark.createDataFrame(rows, "site_id string, v double, k int, label string").repartition(16)
    for by, groups in (([], [None]), (["site_id"], ["hot", "s3", "empty"])):
        table = {(r.site_id if by else None, r["column"]): r for r in scan.summary(df, ["v", "k", "label"], by).collect()}
        for group in groups:
            own = [r for r in rows if not by or r[0] == group]
            values = sorted(r[1] for r in own if r[1] is not None and not math.isnan(r[1]))
            got = table[group, "v"]
            assert (got.rows, got.missing) == (len(own), len(own) - len(values))
            if not values:
                assert [got[c] for c in ("mean", "low", "q25", "median", "q75", "high")] == [None] * 6 and got.distinct_values == 0
                continue
            for name, p in scan.QUARTILES.items():
                below = sum(x <= got[name] for x in values) / len(values)
                assert abs(below - p) < 0.03
            assert (got.low, got.high) == (values[0], values[-1]) and got["mean"] == pytest.approx(sum(values) / len(values))
            assert got.distinct_values == pytest.approx(len(values), rel=0.06)
            assert table[group, "k"].distinct_values == 12 and table[group, "label"].median is None
            assert table[group, "label"].distinct_values == pytest.approx(len({r[3] for r in own} - {None}), rel=0.06)
    # Stored sketches of parts give the whole's; the source is not read again.
    path = str(tmp_path / "sketches")
    scan.sketch(df, ["v", "k"], ["site_id"]).write.parquet(path)
    merged = {r["column"]: r for r in scan.read_sketches(scan.merge_sketches(spark.read.parquet(path))).collect()}
    whole = {r["column"]: r for r in scan.summary(df, ["v", "k"]).collect()}
    assert merged["k"].distinct_values == 12 and merged["v"].rows == whole["v"].rows
    assert merged["v"].median == pytest.approx(whole["v"].median, abs=0.3)
    assert {r["column"]: r.rows for r in scan.summary(df.limit(0), ["v"]).collect()} == {"v": 0}
    assert [r.v for r in scan.preview(df.filter("v is not null and not isnan(v)").select("v"), ["v"], 2).collect()] == sorted(r[1] for r in rows if r[1] is not None and not math.isnan(r[1]))[:2]
    df.write.parquet(str(tmp_path / "source"))
    assert scans(scan.summary(spark.read.parquet(str(tmp_path / "source")), ["v", "k"]), "Relation") == 1


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    pick = random.Random(4)
    rows = []
    for day in range(1, 11):
        for horizon in (1, 2):
            for site in ("a", "b"):
                for model in ("M", "N", "P", "D"):
                    if pick.random() < 0.15:
                        continue
                    seen = None if pick.random() < 0.1 else pick.gauss(0, 1)
                    rows.append((f"2020-01-{day:02d}", f"2020-02-{day:02d}", horizon, site, model, pick.gauss(0, 1), seen, None if seen is None else abs(pick.gauss(0, 1))))
    df = spark.createDataFrame(rows, "reference_datetime string, datetime string, horizon int, site_id string, model_id string, mean double, observation double, crps double")
    path = str(tmp_path_factory.mktemp("scored") / "rows")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("digits", [None, 2])
def test_skill_table_is_one_scan(scored, digits):
    baselines = {"per": "P", "doy": "D"}
    table = evaluation.skill_table(scored, ["M", "N"], baselines, digits)
    assert scans(table, "Relation") == 1
    got = {(r.site_id, r.horizon, r.model_id, r.metric, r.null_model): r.skill for r in table.collect()}
    want = {}
    for baseline in baselines.values():
        for metric, part in (("crps", evaluation.crps_skill(scored, ["M", "N"], baseline)), ("rmse", evaluation.rmse_skill(scored, ["M", "N"], baseline, digits))):
            want |= {(r.site_id, r.horizon, r.model_id, metric, baseline): r.skill for r in part.collect()}
    assert set(got) == set(want)
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or got[k] == pytest.approx(want[k], abs=1e-9)) for k in want)


def test_unbounded_ensembles_read_their_rows_once(spark, tmp_path):
    pick = random.Random(5)
    rows = [(f"g{i % 3}" if i % 2 else "hot", None if i == 40 else float(round(pick.gauss(0, 2), 2)), 0.5) for i in range(600)]
    rows += [(None, 1.0, 0.5), (None, 2.0, 0.5), ("none", None, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, prediction double, observation double")
    wide = {r.g: r for r in scoring.score_samples(df, ["g"]).collect()}
    packed = {r.g: r for r in scoring.score_samples(df, ["g"], bounded=True).collect()}
    assert set(wide) == set(packed) == {"g0", "g1", "g2", "hot", None, "none"} and wide["hot"].crps is None
    for g, row in packed.items():
        for c in ("observation", "crps", "logs", "mean", "sd", "median", "q95"):
            assert wide[g][c] == (row[c] if row[c] is None else pytest.approx(row[c], rel=1e-9)), (g, c)
    df.write.parquet(str(tmp_path / "rows"))
    plan = scoring.score_samples(spark.read.parquet(str(tmp_path / "rows")), ["g"])
    assert scans(plan, "Relation") == 0  # everything comes from the one cut of the rows
