"""A synthetic population and its card transactions, as expressions over spark.range: every draw is a hash of an id, a named stream
and the seed, so any part of it can be made anywhere, alone, and again.

Four fraud patterns and three kinds of honest look-alikes are injected beside the ordinary stream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DAY, HOUR, SECOND
from ..functions.scalar import normal, padded_id, pareto, poisson, time_of_day_profile, uniform, weighted_choice
from ..operators.sets import united, with_ids
from ..schemas import CATEGORIES

MINUTE = 60 * SECOND


@dataclass(frozen=True)
class SimConfig:
    accounts: int = 2_000
    merchants: int = 200
    cities: int = 40
    days: int = 60
    start_ms: int = 1_767_225_600_000  # 2026-01-01
    per_day: float = 0.8
    young_share: float = 0.1
    decline_rate: float = 0.03
    loyal_share: float = 0.7
    online_share: float = 0.35
    velocity: int = 12
    ato: int = 12
    card_testing: int = 4
    rings: int = 3
    ring_size: int = 8
    sprees: int = 20
    seed: int = 42


SIM = SimConfig()
# Weight and typical amount of the categories, in their order.
WEIGHTS = [22.0, 12.0, 16.0, 7.0, 8.0, 14.0, 5.0, 5.0, 7.0, 4.0]
AMOUNTS = [600.0, 1_500.0, 450.0, 350.0, 1_200.0, 900.0, 8_000.0, 6_000.0, 300.0, 1_000.0]
HOURS = time_of_day_profile([(9.0, 2.0, 0.8), (13.0, 1.8, 1.0), (19.5, 2.5, 1.4)])


def city_place(city: Column, stream: str, low: float, high: float, seed: int) -> Column:
    return F.round(low + (high - low) * uniform(city, f"city/{stream}", seed), 4)


def cities(spark: SparkSession, cfg: SimConfig = SIM) -> DataFrame:
    base = spark.range(cfg.cities).select(padded_id("C", "id", 3).alias("city"))
    return base.select("city", city_place(F.col("city"), "lat", 8.0, 34.0, cfg.seed).alias("lat"), city_place(F.col("city"), "lon", 70.0, 92.0, cfg.seed).alias("lon"))


def skewed(u: Column, n: int, alpha: float = 1.2) -> Column:
    """A rank below n that small ranks hold more often (a truncated Pareto draw)."""
    return F.least(F.floor(pareto(u * (1 - 1 / float(n) ** alpha), alpha, 1.0)) - 1, F.lit(n - 1)).cast("long")


def accounts(spark: SparkSession, cfg: SimConfig = SIM) -> DataFrame:
    """A share of the accounts is created inside the window; the others in the three years before."""
    a = spark.range(cfg.accounts).select(padded_id("A", "id").alias("account_id"))
    u = lambda s: uniform("account_id", f"account/{s}", cfg.seed)
    age = F.when(u("young") < cfg.young_share, -u("age") * cfg.days).otherwise(u("age") * 1_000 + 30)
    city = padded_id("C", skewed(u("city"), cfg.cities), 3)
    out = a.select("account_id", (F.lit(cfg.start_ms) - F.floor(age * DAY)).cast("long").alias("created_ms"), city.alias("home_city"), F.exp(normal("account_id", "account/spend", cfg.seed) * 0.5).alias("spend_level"))
    return out.withColumns({"home_lat": city_place(F.col("home_city"), "lat", 8.0, 34.0, cfg.seed), "home_lon": city_place(F.col("home_city"), "lon", 70.0, 92.0, cfg.seed)})


def merchants(spark: SparkSession, cfg: SimConfig = SIM) -> DataFrame:
    m = spark.range(cfg.merchants).select(padded_id("M", "id", 5).alias("merchant_id"), "id")
    u = lambda s: uniform("merchant_id", f"merchant/{s}", cfg.seed)
    out = m.select("merchant_id", F.concat(F.lit("Merchant "), F.col("id")).alias("name"), weighted_choice(u("category"), CATEGORIES, WEIGHTS).alias("category"), padded_id("C", skewed(u("city"), cfg.cities), 3).alias("city"), F.lit("IN").alias("country"), (u("online") < cfg.online_share).alias("is_online"), (F.lit(cfg.start_ms) - F.floor(u("age") * 1_500 * DAY)).cast("long").alias("created_ms"), (1.0 / F.pow(F.col("id") + 1, F.lit(0.9))).alias("popularity"))
    return out.withColumns({"lat": city_place(F.col("city"), "lat", 8.0, 34.0, cfg.seed), "lon": city_place(F.col("city"), "lon", 70.0, 92.0, cfg.seed)})


def devices(owners: DataFrame, cfg: SimConfig = SIM) -> DataFrame:
    """One or two devices per account with the time in which each is used; one account in twelve shares the first one's with the
    account next to it, as families do."""
    u = lambda s: uniform("account_id", f"device/{s}", cfg.seed)
    number = F.substring("account_id", 2, 10).cast("long")
    shared = u("family") < 1 / 12
    first = F.struct(padded_id("D", F.when(shared, F.floor(number / 2) * 2 * 10).otherwise(number * 10)).alias("device_id"), F.lit(0).cast("long").alias("from_ms"), F.when(u("two") < 0.3, F.lit(cfg.start_ms) + F.floor(u("change") * cfg.days * DAY)).otherwise(F.lit(2**62)).cast("long").alias("to_ms"))
    second = F.when(u("two") < 0.3, F.struct(padded_id("D", number * 10 + 1).alias("device_id"), first["to_ms"].alias("from_ms"), F.lit(2**62).cast("long").alias("to_ms")))
    return owners.select("account_id", F.explode(F.filter(F.array(first, second), lambda d: d.isNotNull())).alias("d")).select("account_id", "d.*")


def ip_pool(owners: DataFrame, cfg: SimConfig = SIM) -> DataFrame:
    """Per account: a home address, its city's shared one, an office's, and a proxy that few use."""
    number = F.substring("account_id", 2, 10).cast("long")
    dotted = lambda a, n: F.concat(F.lit(f"{a}."), F.pmod(F.floor(n / 65_536), F.lit(256)), F.lit("."), F.pmod(F.floor(n / 256), F.lit(256)), F.lit("."), F.pmod(n, F.lit(256)))
    city, office = F.substring("home_city", 2, 5).cast("long"), F.floor(uniform("account_id", "ip/office", cfg.seed) * 50)
    return owners.select("account_id", dotted(49, number).alias("home_ip"), dotted(100, city).alias("mobile_ip"), dotted(103, office).alias("office_ip"), F.when(uniform("account_id", "ip/vpn", cfg.seed) < 0.02, F.lit("185.1.1.1")).alias("vpn_ip"))


def legit(spark: SparkSession, cfg: SimConfig = SIM) -> DataFrame:
    """The ordinary stream: a Poisson number of events per account and day, at hours of the day's profile, mostly at merchants to
    which the account is loyal, on its devices and addresses, and sometimes on a trip."""
    people = accounts(spark, cfg)
    days = people.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(cfg.days - 1))))
    key = F.concat_ws("/", "account_id", "day")
    count = poisson(uniform(key, "legit/count", cfg.seed), F.lit(cfg.per_day))
    slots = days.withColumn("slot", F.explode(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))))
    e = slots.withColumn("key", F.concat_ws("/", "account_id", "day", "slot"))
    u = lambda s: uniform("key", f"legit/{s}", cfg.seed)
    hour = weighted_choice(u("hour"), list(range(24)), HOURS)
    e = e.withColumn("ms", (F.lit(cfg.start_ms) + F.col("day").cast("long") * DAY + hour * HOUR + F.floor(u("in_hour") * HOUR)).cast("long")).where("ms >= created_ms")
    # loyal choices come from five ranks of the account's own, the others from all
    favourite = F.floor(uniform(F.concat_ws("/", "account_id", F.floor(u("which") * 5)), "legit/loyal", cfg.seed) * cfg.merchants)
    rank = F.when(u("loyal") < cfg.loyal_share, favourite).otherwise(skewed(u("explore"), cfg.merchants))
    e = e.withColumn("merchant_id", padded_id("M", rank.cast("long"), 5))
    shops = merchants(spark, cfg).select("merchant_id", F.col("category").alias("merchant_category"), F.col("city").alias("shop_city"), F.col("lat").alias("shop_lat"), F.col("lon").alias("shop_lon"), "is_online")
    e = e.join(shops, "merchant_id").join(ip_pool(people, cfg), "account_id")
    travelling = (uniform(F.concat_ws("/", "account_id", F.floor(F.col("day") / 7)), "legit/trip", cfg.seed) < 0.05) & ~F.col("is_online")
    here = lambda home, shop: F.when(travelling, F.col(shop)).otherwise(F.col(home))
    typical = F.element_at(F.create_map(*[x for c, a in zip(CATEGORIES, AMOUNTS, strict=True) for x in (F.lit(c), F.lit(a))]), F.col("merchant_category"))
    clock = F.floor(F.pmod("ms", F.lit(DAY)) / HOUR)
    ip = F.when(F.col("vpn_ip").isNotNull() & (u("vpn") < 0.3), F.col("vpn_ip")).when(clock.between(9, 17) & (u("office") < 0.5), F.col("office_ip")).when(F.col("is_online"), F.col("home_ip")).otherwise(F.col("mobile_ip"))
    e = e.select(
        "key", "ms", "account_id", "merchant_id", "merchant_category", F.greatest(F.lit(1.0), F.round(typical * F.col("spend_level") * F.exp(normal("key", "legit/amount", cfg.seed) * 0.6), 2)).alias("amount"),
        F.when(F.col("is_online"), "ONLINE").otherwise("POS").alias("channel"), ip.alias("ip"), here("home_lat", "shop_lat").alias("lat"), here("home_lon", "shop_lon").alias("lon"), here("home_city", "shop_city").alias("city"),
        F.lit("IN").alias("country"), F.when(u("declined") < cfg.decline_rate, "DECLINED").otherwise("APPROVED").alias("status"),
    )
    owned = e.join(devices(people, cfg), "account_id").where("ms >= from_ms and ms < to_ms").drop("from_ms", "to_ms")
    return owned.withColumns({"fraud_type": F.lit("NONE"), "attack_id": F.lit(None).cast("string"), "ring_id": F.lit(None).cast("string")})


def victims(spark: SparkSession, kind: str, attacks: int, cfg: SimConfig) -> DataFrame:
    """Attacks of a kind with a start and an account that is old by then."""
    a = spark.range(attacks).select(F.concat(F.lit(f"{kind}-"), "id").alias("attack_id"))
    u = lambda s: uniform("attack_id", f"{kind}/{s}", cfg.seed)
    return a.select("attack_id", padded_id("A", F.floor(u("account") * cfg.accounts)).alias("account_id"), (F.lit(cfg.start_ms) + F.floor((0.2 + 0.75 * u("start")) * cfg.days * DAY)).cast("long").alias("start_ms")).join(accounts(spark, cfg), "account_id").where("start_ms > created_ms")


def burst(attacks: DataFrame, kind: str, number: Column, gap_ms: int, amount: Column, declined: float, cfg: SimConfig, **columns: Column) -> DataFrame:
    """`number` events per attack, about gap_ms apart, as columns of the stream. Column expressions may use `key` and `n`."""
    e = attacks.withColumn("n", F.explode(F.sequence(F.lit(0), number - 1))).withColumn("key", F.concat_ws("/", "attack_id", "account_id", "n"))
    u = lambda s: uniform("key", f"{kind}/{s}", cfg.seed)
    common = {
        "ms": (F.col("start_ms") + F.col("n").cast("long") * gap_ms + F.floor(u("jitter") * gap_ms / 2)).cast("long"), "amount": F.round(amount, 2), "merchant_id": padded_id("M", F.floor(u("merchant") * cfg.merchants), 5),
        "merchant_category": weighted_choice(u("category"), ["electronics", "digital_goods", "gift_cards_wallet", "ecommerce"], [3.0, 3.0, 3.0, 1.0]), "channel": F.lit("ONLINE"), "device_id": F.concat(F.lit("X"), "attack_id"), "ip": F.lit("45.9.0.1"),
        "lat": F.col("home_lat"), "lon": F.col("home_lon"), "city": F.col("home_city"), "country": F.lit("IN"), "status": F.when(u("declined") < declined, "DECLINED").otherwise("APPROVED"), "fraud_type": F.lit(kind), "ring_id": F.lit(None).cast("string"),
    } | columns
    return e.select("key", "account_id", "attack_id", *[c.alias(n) for n, c in common.items()])


def velocity(spark: SparkSession, cfg: SimConfig = SIM) -> DataFrame:
    """Eight to fifteen payments within minutes."""
    a = victims(spark, "VELOCITY", cfg.velocity, cfg)
    return burst(a, "VELOCITY", (8 + F.floor(uniform("attack_id", "n", cfg.seed) * 8)).cast("int"), 20 * SECOND, 500 + 4_000 * uniform("key", "amount", cfg.seed), 0.15, cfg)


def ato(spark: SparkSession, cfg: SimConfig = SIM) -> DataFrame:
    """A far place and an unseen device soon after an honest payment of the account: two to four large payments."""
    a = victims(spark, "ATO", cfg.ato, cfg)
    anchors = legit(spark, cfg).where("channel = 'POS'").select("account_id", F.col("ms").alias("anchor_ms"))
    last = a.join(anchors, "account_id").where("anchor_ms <= start_ms").groupBy("attack_id").agg(F.max("anchor_ms").alias("anchor_ms"))
    a = a.join(last, "attack_id").withColumn("start_ms", F.col("anchor_ms") + 30 * MINUTE)
    far = {"lat": F.lit(51.5), "lon": F.lit(-0.1), "city": F.lit("LON"), "country": F.lit("GB")}
    return burst(a, "ATO", (2 + F.floor(uniform("attack_id", "n", cfg.seed) * 3)).cast("int"), 4 * MINUTE, 8_000 + 30_000 * uniform("key", "amount", cfg.seed), 0.1, cfg, **far)


def card_testing(spark: SparkSession, cfg: SimConfig = SIM) -> DataFrame:
    """One device tries many cards with small amounts, most of them declined."""
    a = spark.range(cfg.card_testing).select(F.concat(F.lit("CARD_TESTING-"), "id").alias("attack_id"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k"))
    pick = F.concat_ws("/", "attack_id", "k")
    start = F.lit(cfg.start_ms) + F.floor((0.2 + 0.75 * uniform("attack_id", "CARD_TESTING/start", cfg.seed)) * cfg.days * DAY)
    a = a.select("attack_id", padded_id("A", F.floor(uniform(pick, "CARD_TESTING/account", cfg.seed) * cfg.accounts)).alias("account_id"), (start + F.col("k") * 90 * SECOND).cast("long").alias("start_ms")).join(accounts(spark, cfg), "account_id").where("start_ms > created_ms")
    return burst(a, "CARD_TESTING", F.lit(2), 30 * SECOND, 5 + 60 * uniform("key", "amount", cfg.seed), 0.6, cfg)


def rings(spark: SparkSession, cfg: SimConfig = SIM) -> DataFrame:
    """Young accounts that share two devices over weeks; a later ring takes over one device of the ring before it."""
    r = spark.range(cfg.rings).select("id", F.concat(F.lit("RING-"), "id").alias("attack_id"), F.explode(F.sequence(F.lit(0), F.lit(cfg.ring_size - 1))).alias("k"))
    start = F.lit(cfg.start_ms) + F.floor((F.col("id") + 1) * cfg.days * DAY / (cfg.rings + 2))
    r = r.select("id", "attack_id", "k", padded_id("R", F.col("id") * 100 + F.col("k")).alias("account_id"), start.cast("long").alias("start_ms"), padded_id("C", F.col("id") % cfg.cities, 3).alias("home_city"))
    r = r.withColumns({"home_lat": city_place(F.col("home_city"), "lat", 8.0, 34.0, cfg.seed), "home_lon": city_place(F.col("home_city"), "lon", 70.0, 92.0, cfg.seed)})
    device = F.concat(F.lit("XRING-"), F.when(F.col("n") % 2 == 0, F.col("id")).otherwise(F.greatest(F.col("id") - 1, F.lit(0))), F.lit("-0"))
    return burst(r, "RING", F.lit(10), 30 * HOUR, 900 + 2_500 * uniform("key", "amount", cfg.seed), 0.05, cfg, device_id=device, ring_id=F.col("attack_id"))


def sprees(spark: SparkSession, cfg: SimConfig = SIM) -> DataFrame:
    """Honest look-alikes: five to eight payments on one's own device within an hour."""
    a = victims(spark, "SPREE", cfg.sprees, cfg)
    own = padded_id("D", F.substring("account_id", 2, 10).cast("long") * 10)
    honest = {"fraud_type": F.lit("NONE"), "attack_id": F.lit(None).cast("string"), "device_id": own, "channel": F.lit("POS")}
    out = burst(a, "SPREE", (5 + F.floor(uniform("attack_id", "n", cfg.seed) * 4)).cast("int"), 8 * MINUTE, 700 + 1_500 * uniform("key", "amount", cfg.seed), 0.03, cfg, **{k: v for k, v in honest.items() if k != "attack_id"})
    return out.withColumn("attack_id", F.lit(None).cast("string"))


def micro_bursts(spark: SparkSession, cfg: SimConfig = SIM) -> DataFrame:
    """Honest look-alikes: runs of small payments, as on a ticket machine."""
    a = victims(spark, "MICRO", cfg.sprees, cfg)
    own = padded_id("D", F.substring("account_id", 2, 10).cast("long") * 10)
    return burst(a, "MICRO", F.lit(4), 3 * MINUTE, 10 + 60 * uniform("key", "amount", cfg.seed), 0.02, cfg, fraud_type=F.lit("NONE"), device_id=own).withColumn("attack_id", F.lit(None).cast("string"))


def build(spark: SparkSession, cfg: SimConfig = SIM) -> dict[str, DataFrame]:
    """accounts, merchants, events in total order with ids by position, and labels with the label delay."""
    stream = united(legit(spark, cfg), velocity(spark, cfg), ato(spark, cfg), card_testing(spark, cfg), rings(spark, cfg), sprees(spark, cfg), micro_bursts(spark, cfg))
    stream = with_ids(stream.where(F.col("ms") < cfg.start_ms + cfg.days * DAY), "ms", "key")
    is_fraud = (F.col("fraud_type") != "NONE").cast("tinyint")
    labels = stream.select("txn_id", is_fraud.alias("is_fraud"), "fraud_type", "attack_id", "ring_id", (F.col("ms") + 14 * DAY).alias("label_ms"))
    ringed = stream.where("fraud_type = 'RING'").groupBy("account_id").agg((F.min("ms") - 5 * DAY).alias("created_ms"), F.first("city").alias("home_city"), F.first("lat").alias("home_lat"), F.first("lon").alias("home_lon"))
    everyone = accounts(spark, cfg).unionByName(ringed.withColumn("spend_level", F.lit(1.0)))
    return {"accounts": everyone, "merchants": merchants(spark, cfg), "events": stream.drop("key", "fraud_type", "attack_id", "ring_id"), "labels": labels}


def nearest_city(places: DataFrame, towns: DataFrame, key: str) -> DataFrame:
    """Each place's nearest city. Towns are a bounded list and are broadcast."""
    from ..functions.scalar import haversine_km

    t = F.broadcast(towns.select(F.col("city").alias("near_city"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")))
    far = places.join(t, F.abs(F.col("lat") - F.col("t_lat")) <= 180).withColumn("km", haversine_km("lat", "lon", "t_lat", "t_lon"))
    return far.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("km", "near_city"))).where("_n = 1").select(key, "near_city", "km")


def enforce_gaps(events: DataFrame, least_ms: int, key: str = "account_id") -> DataFrame:
    """Events of which each is at least least_ms after the one kept before it, per key: a choice that depends on itself, so it folds
    over the key's sorted times."""
    times = events.groupBy(key).agg(F.array_sort(F.collect_list("ms")).alias("t"))
    folded = F.aggregate("t", F.array().cast("array<bigint>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) >= least_ms), F.concat(a, F.array(x))).otherwise(a))
    return events.join(times.select(key, F.explode(folded).alias("ms")).distinct(), [key, "ms"], "left_semi")
