"""Account state of a stream: features from the state before an event, then the event is folded in.

The rules are those of the batch windows, one event at a time; the tests hold both against each other. State lives in the stream's
state store: scalars and the last day's events as one value; devices, merchants and cities as maps, so that an event reads and writes
only its own entries.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DAY, FEATURES, HOUR, FeatureConfig
from ..functions.scalar import EARTH_KM

OUT = (
    "txn_id string, account_id string, ms bigint, acct_cnt_5m bigint, acct_cnt_1h bigint, acct_cnt_24h bigint, acct_amt_24h double, acct_merchants_1h bigint,"
    " acct_declines_1h bigint, acct_small_1h bigint, secs_since_last double, amount_zscore double, amount_to_mean double, hour_unusualness double,"
    " acct_history_cnt bigint, new_device int, acct_devices_30d bigint, new_merchant int, new_city int, geo_speed_kmh double"
)
NAMES = [f.split()[0] for f in OUT.split(", ")]


def km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b, c, d = map(math.radians, (lat1, lon1, lat2, lon2))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, max(0.0, h))))


@dataclass
class Account:
    """What is known of an account. recent: (ms, amount, merchant, declined) of the last day."""

    recent: list = field(default_factory=list)
    last: list | None = None  # ms, lat, lon
    n: int = 0
    ok: list = field(default_factory=lambda: [0, 0.0, 0.0])  # approved: count, sum, sum of squares
    hours: list = field(default_factory=lambda: [0] * FEATURES.buckets)

    def text(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True, separators=(",", ":"))

    @classmethod
    def of(cls, text: str | None) -> Account:
        return cls(**json.loads(text)) if text else cls()


def features(a: Account, e: dict, devices: dict, knows_merchant: bool, knows_city: bool, cfg: FeatureConfig = FEATURES) -> dict:
    """Of an event, from the state before it. devices: last use of each of the account's devices."""
    now, out = e["ms"], {}
    within = lambda w: [r for r in a.recent if now - w <= r[0] < now]
    day, hour = within(cfg.day), within(cfg.hour)
    out |= {"acct_cnt_5m": len(within(cfg.short)), "acct_cnt_1h": len(hour), "acct_cnt_24h": len(day), "acct_amt_24h": float(sum(r[1] for r in day))}
    out |= {"acct_merchants_1h": len({r[2] for r in hour}), "acct_declines_1h": sum(r[3] for r in hour), "acct_small_1h": sum(r[1] < cfg.small_amount for r in hour)}
    out["secs_since_last"] = cfg.gap_default if a.last is None else min((now - a.last[0]) / 1000.0, cfg.gap_default)
    n, s, ss = a.ok
    mean = s / n if n else None
    out["amount_to_mean"] = min(e["amount"] / mean, cfg.to_mean_clip) if mean and mean > 0 else cfg.to_mean_default
    out["amount_zscore"] = 0.0
    if n >= cfg.z_least_prior:
        spread = math.sqrt(max((ss - s * s / n) / (n - 1), 0.0))
        z = (e["amount"] - mean) / max(spread, cfg.z_floor_ratio * mean, cfg.z_floor)
        out["amount_zscore"] = min(max(z, cfg.z_clip[0]), cfg.z_clip[1])
    bucket = now % DAY // HOUR // cfg.bucket_hours
    out["hour_unusualness"] = 1.0 - (a.hours[bucket] + 1) / (a.n + cfg.buckets)
    out["acct_history_cnt"] = a.n
    out["new_device"] = int(e["device_id"] not in devices)
    out["acct_devices_30d"] = sum(now - cfg.month <= last < now for last in devices.values())
    out |= {"new_merchant": int(not knows_merchant), "new_city": int(not knows_city), "geo_speed_kmh": cfg.speed_default}
    if a.last is not None:
        hours = max((now - a.last[0]) / 1000.0, cfg.least_elapsed) / 3600.0
        out["geo_speed_kmh"] = min(km(a.last[1], a.last[2], e["lat"], e["lon"]) / hours, cfg.speed_cap)
    return out


def fold(a: Account, e: dict, cfg: FeatureConfig = FEATURES) -> None:
    """The event becomes part of the account's state."""
    approved = e["status"] == "APPROVED"
    a.recent = [r for r in a.recent if r[0] >= e["ms"] - cfg.day] + [[e["ms"], e["amount"], e["merchant_id"], int(not approved)]]
    a.last, a.n = [e["ms"], e["lat"], e["lon"]], a.n + 1
    a.hours[e["ms"] % DAY // HOUR // cfg.bucket_hours] += 1
    if approved:
        a.ok = [a.ok[0] + 1, a.ok[1] + e["amount"], a.ok[2] + e["amount"] ** 2]


class AccountProcessor(StatefulProcessor):
    """Keyed by account. Events of a batch are taken in total order; an id that was processed within the record's life is not again."""

    def __init__(self, record_ttl: int, cfg: FeatureConfig = FEATURES):
        self.record_ttl, self.cfg = record_ttl, cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.account = handle.getValueState("account", "text string")
        self.devices = handle.getMapState("devices", "device string", "last long")
        self.merchants = handle.getMapState("merchants", "merchant string", "ms long")
        self.cities = handle.getMapState("cities", "city string", "ms long")
        self.records = handle.getMapState("records", "txn string", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = sorted((e for frame in rows for e in frame.to_dict("records")), key=lambda e: (e["ms"], e["txn_id"]))
        a = Account.of(self.account.get()[0] if self.account.exists() else None)
        devices = {k[0]: v[0] for k, v in self.devices.iterator()} if self.devices.exists() else {}
        out = []
        for e in events:
            if self.records.containsKey((e["txn_id"],)):
                continue
            knows_city = self.cities.containsKey((e["city"],)) or e["city"] == e.get("home_city")
            out.append({"txn_id": e["txn_id"], "account_id": key[0], "ms": e["ms"]} | features(a, e, devices, self.merchants.containsKey((e["merchant_id"],)), knows_city, self.cfg))
            for gone in [d for d, last in devices.items() if last < e["ms"] - self.cfg.device_retention]:
                del devices[gone]
                self.devices.removeKey((gone,))
            devices[e["device_id"]] = max(devices.get(e["device_id"], e["ms"]), e["ms"])
            self.devices.updateValue((e["device_id"],), (devices[e["device_id"]],))
            self.merchants.updateValue((e["merchant_id"],), (e["ms"],))
            self.cities.updateValue((e["city"],), (e["ms"],))
            self.records.updateValue((e["txn_id"],), (e["ms"],))
            fold(a, e, self.cfg)
        if events:
            for txn, seen in [(k[0], v[0]) for k, v in self.records.iterator()]:
                if seen < events[-1]["ms"] - self.record_ttl:
                    self.records.removeKey((txn,))
            self.account.update((a.text(),))
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def account_stream(events: DataFrame, record_ttl: int = 2 * DAY, cfg: FeatureConfig = FEATURES) -> DataFrame:
    """Account features of a stream of events (with home_city if known), exactly once per id. Needs the RocksDB state store."""
    return events.groupBy("account_id").transformWithStateInPandas(AccountProcessor(record_ttl, cfg), outputStructType=OUT, outputMode="Append", timeMode="None")


def replay(events: list[dict], home: dict | None = None, cfg: FeatureConfig = FEATURES) -> list[dict]:
    """The same rules over a list of one or more accounts' events, without Spark."""
    accounts, devices, merchants, cities, out = {}, {}, {}, {}, []
    for e in sorted(events, key=lambda e: (e["ms"], e["txn_id"])):
        k = e["account_id"]
        a, own = accounts.setdefault(k, Account()), devices.setdefault(k, {})
        seen_m, seen_c = merchants.setdefault(k, set()), cities.setdefault(k, set())
        out.append({"txn_id": e["txn_id"]} | features(a, e, own, e["merchant_id"] in seen_m, e["city"] in seen_c or e["city"] == (home or {}).get(k), cfg))
        for gone in [d for d, last in own.items() if last < e["ms"] - cfg.device_retention]:
            del own[gone]
        own[e["device_id"]] = max(own.get(e["device_id"], e["ms"]), e["ms"])
        seen_m.add(e["merchant_id"])
        seen_c.add(e["city"])
        fold(a, e, cfg)
    return out
