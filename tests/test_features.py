"""Feature windows: hand-worked cases, traps, and an independent replay of ties and long gaps."""

import random

import pytest

from sparkrisk.config import DAY, HOUR
from sparkrisk.operators import fanout, windows
from sparkrisk.streaming.state import replay

START = 1_772_323_200_000  # 2026-03-01
MINUTE = 60_000


def event(k, ms, **more):
    base = {
        "txn_id": k, "ms": START + ms, "account_id": "A1", "merchant_id": "M1", "merchant_category": "grocery", "amount": 100.0, "channel": "POS", "device_id": "D1", "ip": "49.1.1.1",
        "lat": 19.076, "lon": 72.8777, "city": "Mumbai", "country": "IN", "status": "APPROVED",
    }
    return base | more


def features(spark, events, known=True):
    rows = [("A1", START - 59 * DAY, "Mumbai", 19.076, 72.8777)] if known else []
    accounts = spark.createDataFrame(rows, "account_id string, created_ms long, home_city string, home_lat double, home_lon double")
    out = windows.hot_features(spark.createDataFrame(events), accounts).orderBy("ms", "txn_id").collect()
    return [r.asDict() for r in out]


def test_half_open_windows(spark):
    f = features(spark, [event(1, 0), event(2, 299_000), event(3, 300_000)])
    assert [r["acct_cnt_5m"] for r in f] == [0, 1, 2]
    f = features(spark, [event(1, -1_000), event(2, 0), event(3, 299_000), event(4, 300_000)])
    assert (f[-1]["acct_cnt_5m"], f[-1]["acct_cnt_1h"]) == (2, 3)


@pytest.mark.parametrize(
    "amounts,z,to_mean",
    [([100, 200, 1_000_000], 0.0, 100.0), ([100, 200, 300, 500], 3.0, 2.5), ([100, 100, 100, 100, 150], 1.0, 1.5), ([100] * 4 + [10_000_000], 50.0, 100.0)],
)
def test_amount_deviation(spark, amounts, z, to_mean):
    last = features(spark, [event(k, k * HOUR, amount=float(a)) for k, a in enumerate(amounts)])[-1]
    assert last["amount_zscore"] == pytest.approx(z) and last["amount_to_mean"] == pytest.approx(to_mean)


def test_declined_amounts_do_not_count(spark):
    f = features(spark, [event(1, 0), event(2, HOUR, amount=200.0), event(3, 2 * HOUR, amount=300.0), event(4, 3 * HOUR - MINUTE, amount=999_999.0, status="DECLINED"), event(5, 3 * HOUR, amount=500.0)])[-1]
    assert (round(f["amount_zscore"], 9), f["amount_to_mean"], f["acct_history_cnt"], f["acct_declines_1h"]) == (3.0, 2.5, 4, 1)


def test_last_use_not_any_use(spark):
    # A at 0 and 10, B at 10 on one device: A's last use moved out of the window that ends before 10
    rows = [event(1, 0, account_id="A"), event(2, 10, account_id="A"), event(3, 10, account_id="B"), event(4, 11, account_id="C")]
    got = {r["txn_id"]: r["dev_accts_1h"] for r in features(spark, rows)}
    assert got == {1: 0, 2: 1, 3: 0, 4: 2}


def test_unknown_account_and_first_event(spark):
    f = features(spark, [event(1, 0)], known=False)[0]
    assert (f["secs_since_last"], f["account_age_days"], f["km_from_home"], f["geo_speed_kmh"], f["new_device"], f["new_city"]) == (2_592_000.0, 0.0, 0.0, 0.0, 1, 1)
    assert features(spark, [event(1, 0)])[0]["new_city"] == 0


def test_devices_are_forgotten(spark):
    f = features(spark, [event(1, 0), event(2, 91 * DAY, device_id="D2"), event(3, 91 * DAY + 1), event(4, 91 * DAY + 2)])
    assert [r["new_device"] for r in f] == [1, 1, 1, 0]  # event 2 drops D1
    f = features(spark, [event(1, 0), event(2, 91 * DAY, device_id="D2"), event(3, 92 * DAY, device_id="D2"), event(4, 93 * DAY)])
    assert f[-1]["new_device"] == 1


def random_events(n, seed):
    rng, out, now = random.Random(seed), [], 0
    for k in range(n):
        if rng.random() > 0.35:
            now += rng.choice([1, 1_000, 200_000, HOUR, 5 * HOUR, DAY, 20 * DAY if rng.random() < 0.3 else 1, 95 * DAY if rng.random() < 0.02 else 1])
        out.append(event(k, now, account_id=f"A{rng.randrange(4)}", device_id=f"D{rng.randrange(5)}", merchant_id=f"M{rng.randrange(5)}", city=rng.choice(["Mumbai", "Delhi", "Pune"]), amount=round(rng.uniform(1, 400), 2), status=rng.choice(["APPROVED", "APPROVED", "DECLINED"]), lat=rng.uniform(10, 30), lon=rng.uniform(70, 90), ip=f"1.1.1.{rng.randrange(3)}"))
    return out


def test_windows_equal_a_replay(spark):
    """Ties of a third of all rows, gaps beyond the retention, an account without facts."""
    events = random_events(600, 7)
    home = {"A1": "Mumbai"}
    want = {r["txn_id"]: r for r in replay(events, home)}
    for got in features(spark, events):
        for name, value in want[got["txn_id"]].items():
            assert got[name] == pytest.approx(value, abs=1e-6), (name, got["txn_id"])


def test_fanout_equals_a_loop(spark):
    events = random_events(500, 11)
    count = [fanout.Count("n", "device_id", "account_id", HOUR), fanout.Count("m", "account_id", "device_id", 30 * DAY)]
    got = {r["txn_id"]: (r["n"], r["m"]) for r in fanout.last_use_counts(spark.createDataFrame(events), count).collect()}
    last: dict = {}
    for e in sorted(events, key=lambda e: (e["ms"], e["txn_id"])):
        here = [sum(e["ms"] - w <= t < e["ms"] for (k, _), t in last.items() if k == (kind, e[kind])) for kind, w in (("device_id", HOUR), ("account_id", 30 * DAY))]
        assert got[e["txn_id"]] == tuple(here)
        last[("device_id", e["device_id"]), e["account_id"]] = e["ms"]
        last[("account_id", e["account_id"]), e["device_id"]] = e["ms"]


def test_haversine(spark):
    from pyspark.sql import functions as F

    from sparkrisk.functions.scalar import haversine_km

    got = spark.range(1).select(haversine_km(F.lit(19.076), F.lit(72.8777), F.lit(28.6139), F.lit(77.209))).first()[0]
    assert abs(got - 1150) < 15


def test_order_violations_at_one_position(spark):
    """Rows of one position count as lying in order, however the table is dealt; those across positions are compared as ever."""
    from sparkrisk.operators import predicates

    rows = [(p, (7 * k + 3 * p) % 10, k) for p in range(40) for k in range(10)]
    lined = [r[1:] for r in sorted(rows)]
    expected = sum(b < a for a, b in zip(lined, lined[1:]))
    for parts in (1, 3, 7):
        frame = spark.createDataFrame(rows[::-1], "position long, ms long, txn_id long").repartition(parts)
        assert predicates.order_violations(frame, "ms", "txn_id").first()[0] == expected == 39
