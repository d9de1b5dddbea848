"""Windows, thresholds, caps and grids: fixed values. All durations are milliseconds, as event times are compared as epoch milliseconds."""

from __future__ import annotations

from dataclasses import dataclass, field

SECOND, HOUR, DAY = 1_000, 3_600_000, 86_400_000


@dataclass(frozen=True)
class FeatureConfig:
    short: int = 300 * SECOND
    hour: int = HOUR
    day: int = DAY
    month: int = 30 * DAY
    small_amount: float = 100.0
    night: tuple[int, int] = (0, 5)
    gap_default: float = 2_592_000.0
    to_mean_default: float = 1.0
    to_mean_clip: float = 100.0
    speed_default: float = 0.0
    speed_cap: float = 5_000.0
    least_elapsed: float = 60.0
    z_least_prior: int = 3
    z_floor_ratio: float = 0.25
    z_floor: float = 50.0
    z_clip: tuple[float, float] = (-10.0, 50.0)
    bucket_hours: int = 4
    buckets: int = 6
    device_retention: int = 90 * DAY
    home_country: str = "IN"


@dataclass(frozen=True)
class GraphConfig:
    cadence: int = DAY
    lookback: int = 30 * DAY
    caps: tuple[tuple[str, int], ...] = (("device_id", 16), ("ip", 18))
    least_accounts: int = 2
    alpha: float = 0.85
    seed: int = 42
    label_delay: int = 14 * DAY
    young: int = 30 * DAY
    defaults: tuple[tuple[str, float], ...] = (
        ("graph_degree", 0.0), ("graph_clustering", 0.0), ("community_size", 1.0),
        ("community_shared_devices", 0.0), ("community_young_share", 0.0), ("ppr_risk", 0.0),
    )


@dataclass(frozen=True)
class RuleConfig:
    r1_cnt_5m: int = 5
    r2_speed: float = 900.0
    r2_new_device: int = 1
    r3_dev_accts_1h: int = 5
    r3_small_1h: int = 3
    r3_declines_1h: int = 2
    r4_dev_accts_30d: int = 3
    r4_age_days: float = 30.0


@dataclass(frozen=True)
class DecisionConfig:
    review_budget: float = 0.02
    hold_precision: float = 0.95
    hold_alerts: int = 50
    candidates: int = 512


@dataclass(frozen=True)
class SplitConfig:
    """Half-open intervals of dates as ISO strings, and the burn-in inside the first one."""

    splits: tuple[tuple[str, str, str], ...] = (
        ("train", "2026-01-01", "2026-02-23"), ("early_stop", "2026-02-23", "2026-03-02"),
        ("valid", "2026-03-02", "2026-03-14"), ("test", "2026-03-14", "2026-04-01"),
    )
    burn_in: tuple[str, str] = ("2026-01-01", "2026-01-15")
    locked: tuple[str, ...] = ("test",)


@dataclass(frozen=True)
class StreamConfig:
    batch: int = 200
    flush_rows: int = 2_000
    flush_seconds: float = 2.0
    most_deliveries: int = 3
    lag_pause: int = 20_000
    lag_resume: int = 5_000
    hold_ttl: int = 7 * DAY
    record_ttl: int = 2 * DAY
    alerts_kept: int = 500
    latencies_kept: int = 1_000


@dataclass(frozen=True)
class ModelConfig:
    rounds: int = 2_000
    patience: int = 100
    trials: int = 20
    seed: int = 42
    grid: dict = field(
        default_factory=lambda: {
            "max_depth": [4, 6, 8], "learning_rate": [0.03, 0.05, 0.1], "min_child_weight": [1, 5, 10],
            "subsample": [0.7, 0.9], "colsample_bytree": [0.6, 0.9], "reg_lambda": [1, 5],
        }
    )
    forest_trees: int = 200
    forest_sample: int = 512
    quantile_points: int = 1_001
    blend_weights: tuple[float, ...] = (1.0, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5)
    patterns: tuple[str, ...] = ("VELOCITY", "ATO", "CARD_TESTING", "RING")
    anomaly_reason_at: float = 0.99
    reasons: int = 3


FEATURES, GRAPH, RULES, DECISIONS, SPLITS, STREAM, MODEL = FeatureConfig(), GraphConfig(), RuleConfig(), DecisionConfig(), SplitConfig(), StreamConfig(), ModelConfig()
