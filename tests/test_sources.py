import pytest
from pyspark.sql import functions as F

from sparkrisk.functions import scalar
from sparkrisk.operators import aggregates, joins, sets, windows
from sparkrisk.plans import serving
from sparkrisk.schemas import EVENTS, feature_columns, from_message, no_labels, split_valid, to_message
from sparkrisk.sources import datagen, quality, tables

CFG = datagen.SimConfig(accounts=150, merchants=40, days=30, velocity=5, ato=5, card_testing=2, rings=2, sprees=8)


@pytest.fixture(scope="module")
def made(spark):
    return {n: f.cache() for n, f in datagen.build(spark, CFG).items()}


def test_generated_data(made):
    checks = quality.schema_checks(made) + quality.volume_checks(made, high=0.3) + quality.pattern_checks(made) + quality.hard_negative_checks(made)
    assert [c for c in checks if not c["passed"]] == []


def test_generation_is_deterministic(spark):
    assert quality.determinism(lambda: {"legit": datagen.legit(spark, CFG)})["passed"]


def test_helpers_of_the_generator(spark):
    places = spark.createDataFrame([(1, 10.0, 70.0), (2, 33.0, 91.0)], "id int, lat double, lon double")
    towns = spark.createDataFrame([("S", 9.0, 71.0), ("N", 34.0, 90.0)], "city string, lat double, lon double")
    assert {r["id"]: r["near_city"] for r in datagen.nearest_city(places, towns, "id").collect()} == {1: "S", 2: "N"}
    events = spark.createDataFrame([("a", t) for t in (0, 5, 12, 14, 30)], "account_id string, ms long")
    assert sorted(r["ms"] for r in datagen.enforce_gaps(events, 10).collect()) == [0, 12, 30]


def valid_event(spark):
    from datetime import datetime

    row = ("T1", datetime(2026, 1, 1, 0, 0, 0, 5), "A1", "M1", "fuel", 10.5, "POS", "D1", "1.2.3.4", 1.0, 2.0, "C", "IN", "APPROVED")
    return spark.createDataFrame([row], EVENTS)


def test_messages_round_trip(spark):
    e = valid_event(spark)
    m = to_message(e, F.lit(7))
    assert all(t == "string" for _, t in m.dtypes)
    assert from_message(m).select(*EVENTS.names).collect() == e.collect()
    bad = e.withColumn("amount", F.lit(-1.0)).withColumn("ip", F.lit("300.1.1.1"))
    good, rejected = split_valid(e.union(bad))
    assert good.count() == 1 and rejected.first()["problem"] == "amount,ip"
    with pytest.raises(ValueError):
        no_labels(e.withColumn("is_fraud", F.lit(1)))
    with pytest.raises(ValueError):
        feature_columns(e)


def test_scored_view(spark, tmp_path):
    root = str(tmp_path / "scored")
    assert tables.scored_view(spark, root).count() == 0
    spark.createDataFrame([("a", 1, 5), ("a", 1, 9)], "txn_id string, x int, scored_ts long").write.parquet(f"{root}/date=2026-01-01")
    spark.createDataFrame([("b", 1, 5, 1)], "txn_id string, x int, scored_ts long, more int").write.parquet(f"{root}/date=2026-01-02")
    assert sorted((r["txn_id"], r["scored_ts"], r["more"]) for r in tables.scored_view(spark, root).collect()) == [("a", 5, None), ("b", 5, 1)]


def test_snapshots_checkpoints_and_logs(spark, tmp_path):
    rows = spark.createDataFrame([(5, "A", 1.0)], "snapshot_ms long, account_id string, graph_degree double")
    tables.publish_snapshot(rows, rows.select("snapshot_ms"), str(tmp_path / "s"), str(tmp_path / "c"))
    frame, times = tables.read_snapshots(spark, str(tmp_path / "s"), str(tmp_path / "c"))
    assert times == [5] and frame.count() == 1
    tables.write_checkpoint(rows, str(tmp_path / "k"))
    assert tables.read_checkpoint(spark, str(tmp_path / "k"), rows.schema).collect() == rows.collect()
    tables.write_checkpoint(rows, str(tmp_path / "k"), spec="fs0")
    with pytest.raises(ValueError):
        tables.read_checkpoint(spark, str(tmp_path / "k"), rows.schema)
    runs = []
    assert tables.once(spark, str(tmp_path / "m"), lambda: runs.append(1)) and not tables.once(spark, str(tmp_path / "m"), lambda: runs.append(1)) and runs == [1]
    tables.append_log(spark, str(tmp_path / "l"), {"a": 1})
    tables.append_log(spark, str(tmp_path / "l"), {"a": 2})
    assert spark.read.text(str(tmp_path / "l")).count() == 2
    with pytest.raises(tables.HistoryLeak):
        tables.history(spark.createDataFrame([(5,)], "ms long"), 5, cut=False)


def test_small_operators(spark):
    f = spark.createDataFrame([(k, float(k % 7)) for k in range(100)], "id long, v double")
    assert [r["position"] for r in sets.numbered(f, "v", "id").orderBy("v", "id").collect()] == list(range(100))
    assert aggregates.nearest_rank(f, "id", 0.5).first()[0] == 50  # 49.5 rounds to even
    assert spark.range(1).select(scalar.interpolate(F.lit(15.0), [0.0, 10.0, 20.0])).first()[0] == pytest.approx(0.75)
    u = spark.range(20_000).select(scalar.poisson(scalar.uniform("id", "t"), F.lit(0.8)).alias("n")).agg(F.avg("n")).first()[0]
    assert abs(u - 0.8) < 0.03
    with pytest.raises(ValueError):
        joins.one_to_one(f.union(f), f, "id")
    assert joins.one_to_one(f, f.withColumnRenamed("v", "w"), "id").count() == 100
    assert "| v |" in tables.report(aggregates.profile(f, ["v"])) or "v" in tables.report(aggregates.profile(f, ["v"]))
    deltas = aggregates.counter_deltas(spark.createDataFrame([("a", 5), ("b", 2)], "name string, total long"), spark.createDataFrame([("a", 3), ("b", 2)], "name string, total long"))
    assert [(r["name"], r["delta"]) for r in deltas.collect()] == [("a", 2)]


def test_what_if(spark, made):
    e, score = made["events"], lambda f: f.withColumns({"risk": F.lit(0.1), "decision": F.lit("ALLOW")})
    snaps = spark.createDataFrame([], "snapshot_ms long, account_id string, graph_degree double, graph_clustering double, community_size double, community_shared_devices double, community_young_share double, ppr_risk double")
    full = windows.hot_features(e, made["accounts"])
    ask = e.orderBy(F.desc("ms"), F.desc("txn_id")).limit(2)
    stored = ask.limit(1).select("txn_id", F.lit(0.9).alias("risk"), F.lit("HOLD").alias("decision"))
    got = {r["txn_id"]: r for r in serving.what_if(ask, e, made["accounts"], snaps, [], stored, score).collect()}
    names = ["acct_cnt_24h", "acct_history_cnt", "ip_accts_30d", "mer_accts_30d", "new_device", "account_age_days"]
    want = {r["txn_id"]: r for r in full.join(ask.select("txn_id"), "txn_id").collect()}
    last = max(got, key=lambda k: (want[k]["ms"], k))
    assert all(got[last][n] == pytest.approx(want[last][n]) for n in names if n not in ("ip_accts_30d", "mer_accts_30d"))
    assert sorted(r["already_processed"] for r in got.values()) == [False, True] and not any(r["state_updated"] for r in got.values())
    with pytest.raises(ValueError):
        serving.recent_alerts(stored, limit=0)
    assert serving.health(spark, None, [], 3.0)["status"] == "degraded" and serving.health(spark, "v1", [1], 3.0)["status"] == "ok"
