"""Scalar functions that features, scores and reports share. Each takes and returns columns and stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; the haversine is clamped to [0, 1] before its arc sine is taken."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    half = lambda a, b: F.sin((F.radians(b) - F.radians(a)) / 2)
    h = half(lat1, lat2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) ** 2
    return F.when(h.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))))


def clip(x, low, high) -> Column:
    """x within [low, high]; null stays null."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def millis(moment) -> Column:
    """Epoch milliseconds of a naive time, rounded down; the session's zone is UTC."""
    return F.floor(F.unix_micros(col(moment).cast("timestamp")) / 1000).cast("long")


def seconds(moment) -> Column:
    return F.unix_seconds(col(moment).cast("timestamp"))


def from_seconds(x) -> Column:
    return F.timestamp_seconds(col(x)).cast("timestamp_ntz")


def from_millis(x) -> Column:
    return F.timestamp_millis(col(x)).cast("timestamp_ntz")


def hour_of(ms) -> Column:
    """Hour of the day, from epoch milliseconds."""
    return F.floor(F.pmod(col(ms), F.lit(86_400_000)) / 3_600_000).cast("int")


def iso(moment) -> Column:
    return F.date_format(col(moment), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def from_iso(text) -> Column:
    return F.expr("try_cast({} as timestamp_ntz)".format(text if isinstance(text, str) else text._jc.toString()))


def age_days(ms, created_ms) -> Column:
    return (col(ms) - col(created_ms)) / 86_400_000.0


def logistic(x) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def blend(p, anomaly, weight: float) -> Column:
    """weight * p + (1 - weight) * anomaly."""
    if not 0.0 <= weight <= 1.0:
        raise ValueError("a blend weight lies in [0, 1]")
    return F.lit(weight) * col(p) + F.lit(1.0 - weight) * col(anomaly)


def deviations(values: Column, medians: list[float], spreads: list[float]) -> Column:
    """|x - median| / spread for each place of an array."""
    m, s = (F.array(*[F.lit(float(v)) for v in x]) for x in (medians, spreads))
    return F.transform(F.arrays_zip(values.alias("x"), m.alias("m"), s.alias("s")), lambda z: F.abs(z["x"] - z["m"]) / z["s"])


def interpolate(x, points: list[float]) -> Column:
    """Share of the way through ascending points, linear between neighbours, clamped to [0, 1]. Equal neighbours count as one."""
    x, n = col(x), len(points) - 1
    table = F.array(*[F.lit(float(p)) for p in points])
    below = F.size(F.filter(table, lambda p: p <= x))
    low, high = F.element_at(table, F.greatest(below, F.lit(1))), F.element_at(table, F.least(below + 1, F.lit(n + 1)))
    part = F.when(high > low, (x - low) / (high - low)).otherwise(0.0)
    return F.when(x.isNull(), None).when(below == 0, 0.0).when(below > n, 1.0).otherwise((below - 1 + part) / n)


def top_entries(names: list[str], values: list, k: int, positive: bool = True) -> Column:
    """The k largest (value, name) of named columns as an array of structs, ties to the earlier name."""
    entries = F.array(*[F.struct(col(v).cast("double").alias("value"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, (n, v) in enumerate(zip(names, values, strict=True))])
    kept = F.filter(entries, lambda e: e["value"] > 0) if positive else entries
    return F.transform(F.slice(F.sort_array(kept, asc=False), 1, k), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value")))


def template(text: str, value) -> Column:
    """A template with one {value:...} of .0f, .1f, .2f, ,.0f or .0% filled."""
    head, _, rest = text.partition("{value")
    if not rest:
        return F.lit(text)
    spec, _, tail = rest.partition("}")
    x, spec = col(value), spec.removeprefix(":")
    if spec == "":
        shown = x.cast("string")
    elif spec == ".0%":
        shown = F.concat(F.format_string("%.0f", F.bround(x.cast("double") * 100, 0)), F.lit("%"))
    elif spec.startswith(","):
        shown = F.format_number(F.bround(x.cast("double"), int(spec[2:-1])), int(spec[2:-1]))
    else:
        shown = F.format_string(f"%{spec}", F.bround(x.cast("double"), int(spec[1:-1])))
    return F.concat(F.lit(head), shown, F.lit(tail))


def padded_id(prefix: str, number, width: int = 7) -> Column:
    return F.concat(F.lit(prefix), F.lpad(col(number).cast("string"), width, "0"))


def heartbeat(age_seconds) -> Column:
    """What an age says of a process: live under 10 s, late under 60 s, else down; unknown if null."""
    x = col(age_seconds)
    return F.when(x.isNull(), "unknown").when(x < 10, "live").when(x < 60, "late").otherwise("down")


def rounded(x, places: int) -> Column:
    """A double rounded as in binary arithmetic: x * 10^places to the nearest whole number, halves away from zero, over 10^places. Spark's
    round goes by the shortest decimal that names x, which parts from this where x is next to a half."""
    scaled, power = col(x) * float(10**places), float(10**places)
    whole = F.floor(F.abs(scaled))
    nearest = F.signum(scaled) * (whole + F.when(F.abs(scaled) - whole >= 0.5, 1).otherwise(0))
    return F.when(F.abs(scaled) < float(1 << 52), nearest).otherwise(scaled) / power  # from 2^52 on all doubles are whole


def ratio(a, b) -> Column:
    """a / b, or 0 where b is 0 or null."""
    return F.coalesce(col(a) / F.nullif(col(b).cast("double"), F.lit(0.0)), F.lit(0.0))


def uniform(key, stream: str, seed: int = 42) -> Column:
    """A number in [0, 1) for each key, of an independent named stream: the same wherever and whenever it is evaluated."""
    return F.pmod(F.xxhash64(col(key), F.lit(stream), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def normal(key, stream: str, seed: int = 42) -> Column:
    """A standard normal number for each key (Box-Muller)."""
    u = F.greatest(uniform(key, f"{stream}/u", seed), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * uniform(key, f"{stream}/v", seed))


def poisson(u, mean, most: int = 20) -> Column:
    """Inverse of the Poisson distribution function at u, by the sums of its first terms."""
    u, mean = col(u), col(mean)
    term = total = F.exp(-mean)
    count = F.when(u >= total, 1).otherwise(0)
    for k in range(1, most):
        term = term * mean / k
        total = total + term
        count = count + F.when(u >= total, 1).otherwise(0)
    return count


def pareto(u, alpha: float, low: float) -> Column:
    return F.lit(low) / F.pow(1 - col(u), F.lit(1.0 / alpha))


def weighted_choice(u, values: list, weights: list[float]) -> Column:
    """The value in whose share of the summed weights u falls."""
    total, ends, so_far = sum(weights), [], 0.0
    for w in weights:
        so_far += w / total
        ends.append(so_far)
    out = F.lit(values[-1])
    for v, end in reversed(list(zip(values[:-1], ends[:-1], strict=True))):
        out = F.when(col(u) < end, F.lit(v)).otherwise(out)
    return out


def time_of_day_profile(peaks: list[tuple[float, float, float]], shift: float = 0.0, bins: int = 24) -> list[float]:
    """Density over the hours of the day of weighted bell curves (hour, width, weight) on a circle; sums to one."""
    import math

    around = lambda h, c: min(abs(h - c) % 24, 24 - abs(h - c) % 24)
    raw = [sum(w * math.exp(-0.5 * (around((k + 0.5) * 24 / bins, (c + shift) % 24) / s) ** 2) for c, s, w in peaks) for k in range(bins)]
    return [x / sum(raw) for x in raw]


def fingerprint(frame: DataFrame) -> DataFrame:
    """One row: the number of rows and an order-free digest of them."""
    h = F.xxhash64(*[F.col(c) for c in frame.columns])
    return frame.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("digest"))


def sha256(text) -> Column:
    return F.sha2(col(text).cast("string"), 256)
