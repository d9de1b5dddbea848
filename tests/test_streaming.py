import pytest
from pyspark.sql import functions as F

from sparkrisk.operators import predicates, windows
from sparkrisk.sources import driver
from sparkrisk.streaming import scoring, source, state

from .conftest import SMALL


@pytest.fixture(scope="module")
def fed(spark, tmp_path_factory):
    """A week of events as messages in a folder, with a broken one, and the features that the batch engine gives them."""
    folder = str(tmp_path_factory.mktemp("in"))
    text = {c: F.col(c).cast("string") for c in ("account_id", "device_id", "merchant_id")}
    e = driver.events(spark, SMALL).withColumns(text | {"txn_id": F.lpad(F.col("txn_id").cast("string"), 7, "0"), "ip": F.concat(F.lit("10.0.0."), "ip")}).where("ms < 1704450000000")
    accounts = driver.accounts(spark, SMALL).withColumn("account_id", F.col("account_id").cast("string"))
    assert source.publish(e, folder, size=60) == -(-e.count() // 60)
    with open(f"{folder}/broken.json", "w") as out:
        out.write('{"txn_id":"x","amount":"-"}\n')
    return folder, accounts, windows.hot_features(e, accounts).cache()


def largest_gaps(got, want, names):
    joined = got.join(want.select("txn_id", *[F.col(n).alias(f"w_{n}") for n in names]), "txn_id")
    row = joined.agg(F.count("*").alias("n"), *[F.max(F.abs(F.col(n) - F.col(f"w_{n}"))).alias(n) for n in names]).first()
    return row["n"], max(row[n] for n in names)


def test_state_processor_equals_batch(spark, fed, tmp_path):
    folder, accounts, want = fed
    stream = source.typed(source.messages(spark, folder)).where("ms is not null").join(accounts.select("account_id", "home_city"), "account_id", "left")
    columns = ["account_id", "txn_id", "ms", "amount", "merchant_id", "device_id", "lat", "lon", "city", "status", "home_city"]
    query = state.account_stream(stream.select(*columns)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    n, gap = largest_gaps(spark.read.parquet(str(tmp_path / "out")), want, state.NAMES[3:])
    assert n == want.count() and gap < 1e-6


EMPTY = "snapshot_ms long, account_id string, graph_degree double, graph_clustering double, community_size double, community_shared_devices double, community_young_share double, ppr_risk double"


@pytest.mark.parametrize("point", ["features", "written"])
def test_live_job_survives_a_crash(spark, fed, tmp_path, point):
    folder, accounts, want = fed
    crashes = {point}

    def at(here, batch):
        if here in crashes and batch == 1:
            crashes.clear()
            raise RuntimeError("crash")

    score = lambda f: f.withColumns({"risk": F.col("amount") / 400, "latency_ms": F.lit(1)}).withColumn("decision", predicates.decide("risk", 0.3, 0.5))
    job = scoring.LiveJob(str(tmp_path / "live"), accounts, lambda: (spark.createDataFrame([], EMPTY), [1_704_153_600_000]), score, at=at)
    with pytest.raises(Exception, match="crash"):
        job.start(source.messages(spark, folder, 2)).awaitTermination()
    job.start(source.messages(spark, folder, 2)).awaitTermination()
    out = scoring.scored_rows(spark, job.root)
    n, gap = largest_gaps(out, want, ["acct_cnt_24h", "acct_amt_24h", "ip_accts_30d", "mer_accts_30d", "acct_history_cnt", "geo_speed_kmh"])
    assert out.count() == n == want.count() and gap < 1e-6
    assert spark.read.parquet(f"{job.root}/rejected").count() == 1
    assert {r["graph_snapshot_ms"] for r in out.where("ms >= 1704153600000").select("graph_snapshot_ms").distinct().collect()} == {1_704_153_600_000}


def test_pace_and_backpressure():
    now = [0.0]
    pace = source.Pace(speedup=10.0, clock=lambda: now[0])
    assert pace.wait(0) == 0 and pace.wait(5_000) == pytest.approx(0.5)
    rate = source.Pace(rate=2.0, clock=lambda: now[0])
    assert rate.wait(0, 4) == 0 and rate.wait(0) == pytest.approx(2.0)
    with pytest.raises(ValueError):
        source.Pace(1.0, 1.0)
    gate = source.Backpressure()
    assert [gate.blocks(x) for x in (20_000, 20_001, 6_000, None, 4_999, 10_000)] == [False, True, True, True, False, False]


def test_once_and_foreign_state(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "txn_id string, k int").withColumn("ts", F.current_timestamp())
    rows.write.parquet(str(tmp_path / "in"))
    stream = source.once(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2
    job = scoring.LiveJob(str(tmp_path / "live"), rows, lambda: None, lambda f: f)
    spark.createDataFrame([("fs0",)], "spec string").write.parquet(f"{job.root}/spec")
    with pytest.raises(ValueError):
        job.check_version(spark)


def test_refresh_publishes_what_is_due_and_survives_a_crash(spark, tmp_path):
    from sparkrisk.config import DAY
    from sparkrisk.sources import tables
    from sparkrisk.streaming.refresh import LiveRefresh

    root, calendar = str(tmp_path / "snapshots"), str(tmp_path / "calendar")
    built, watermark = [], [None]

    def build(at):
        built.append(at)
        rows = spark.createDataFrame([(at, "A", float(len(built))), (at, "B", 0.0)], "snapshot_ms long, account_id string, graph_degree double")
        return rows, rows.groupBy("snapshot_ms").count().withColumnRenamed("count", "n_nodes")

    refresh = LiveRefresh(spark, root, calendar, lambda: watermark[0], build, start_ms=10 * DAY)
    assert refresh.catch_up() == []
    watermark[0] = 12 * DAY + 5
    assert refresh.catch_up() == [11 * DAY, 12 * DAY] and refresh.step() is None
    # a crash after the rows and before the calendar: the rows are there already, and are replaced
    rows, row = build(13 * DAY)
    tables.write(rows, root, ["snapshot_ms"], mode="append")
    watermark[0] = 13 * DAY
    assert refresh.step() == 13 * DAY
    tables.publish_snapshot(*build(13 * DAY), root, calendar)
    frame, times = tables.read_snapshots(spark, root, calendar)
    assert times == [11 * DAY, 12 * DAY, 13 * DAY] and frame.count() == 6 and spark.read.parquet(calendar).count() == 3
