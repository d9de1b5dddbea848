"""Reasons: which features an alert names, and how they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MODEL
from ..functions.scalar import template
from ..schemas import FEATURES

# Label and text of each feature, in the order of the features.
TEXTS = {
    "log_amount": ("payment amount", "Payment of ₹{value:,.0f}"),
    "hour_of_day": ("time of day", "Payment at {value:.0f}:00"),
    "is_night": ("overnight payment", "Payment made overnight"),
    "is_online": ("online payment", "Card-not-present (online) payment"),
    "is_international": ("international payment", "Payment in a foreign country"),
    "merchant_category": ("merchant category", "Merchant category: {value}"),
    "acct_cnt_5m": ("payments in 5 minutes", "{value:.0f} payments in the previous 5 minutes"),
    "acct_cnt_1h": ("payments in an hour", "{value:.0f} payments in the previous hour"),
    "acct_cnt_24h": ("payments in a day", "{value:.0f} payments in the previous 24 hours"),
    "acct_amt_24h": ("spend in a day", "₹{value:,.0f} spent in the previous 24 hours"),
    "acct_merchants_1h": ("merchants in an hour", "{value:.0f} different merchants in the previous hour"),
    "acct_declines_1h": ("declines in an hour", "{value:.0f} declined payments in the previous hour"),
    "acct_small_1h": ("small payments in an hour", "{value:.0f} small-value payments in the previous hour"),
    "secs_since_last": ("gap since the last payment", "{value:,.0f} seconds since this account's previous payment"),
    "amount_zscore": ("amount vs this account's norm", "Amount is {value:.1f} standard deviations from this account's usual"),
    "amount_to_mean": ("amount vs this account's average", "Amount is {value:.1f}x this account's average payment"),
    "hour_unusualness": ("unusual hour for this account", "Unusual hour for this account (unusualness {value:.2f})"),
    "account_age_days": ("account age", "Account is {value:.0f} days old"),
    "acct_history_cnt": ("payment history", "Account has {value:.0f} earlier payments on record"),
    "new_device": ("unseen device", "First payment from this device"),
    "acct_devices_30d": ("devices per account", "{value:.0f} devices used by this account in 30 days"),
    "new_merchant": ("unseen merchant", "First payment at this merchant"),
    "new_city": ("unseen city", "First payment from this city"),
    "km_from_home": ("distance from home", "{value:,.0f} km from this account's home city"),
    "geo_speed_kmh": ("implied travel speed", "Implied travel speed of {value:,.0f} km/h since the last payment"),
    "dev_accts_1h": ("accounts sharing the device in an hour", "Device used by {value:.0f} accounts in the last hour"),
    "dev_accts_30d": ("accounts sharing the device in 30 days", "Device used by {value:.0f} accounts in 30 days"),
    "ip_accts_1h": ("accounts sharing the IP in an hour", "IP address used by {value:.0f} accounts in the last hour"),
    "ip_accts_30d": ("accounts sharing the IP in 30 days", "IP address used by {value:.0f} accounts in 30 days"),
    "mer_accts_30d": ("accounts using the merchant", "Merchant seen by {value:.0f} accounts in 30 days"),
    "graph_degree": ("linked accounts", "Linked to {value:.0f} other accounts by a shared device or IP"),
    "graph_clustering": ("density of the linked group", "Linked accounts are densely interconnected (clustering {value:.2f})"),
    "community_size": ("size of the linked cluster", "Belongs to a linked cluster of {value:.0f} accounts"),
    "community_shared_devices": ("devices shared in the cluster", "{value:.0f} devices are shared inside this cluster"),
    "community_young_share": ("young accounts in the cluster", "{value:.0%} of linked accounts are under 30 days old"),
    "ppr_risk": ("proximity to confirmed fraud", "Closely linked to accounts with confirmed fraud"),
}
ANOMALY = "Unusual combination: {first} and {second} far outside typical values"

if list(TEXTS) != FEATURES:
    raise ValueError("texts and features differ")


def sentence(feature: str, value: Column) -> Column:
    """The text of one feature; the amount is shown as it was before its logarithm."""
    return template(TEXTS[feature][1], F.expm1(value) if feature == "log_amount" else value)


def rendered(name: Column) -> Column:
    """The text of the feature that a column names, with that feature's value in the row."""
    out = F.lit(None).cast("string")
    for f in FEATURES:
        out = F.when(name == f, sentence(f, F.col(f))).otherwise(out)
    return out


def label_of(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for f, (label, _) in TEXTS.items() for x in (F.lit(f), F.lit(label))]), name)


def top(contributions: str = "contributions", k: int = MODEL.reasons) -> Column:
    """The k largest positive contributions, ties to the earlier feature."""
    placed = F.transform(F.col(contributions), lambda c, i: F.struct(c["value"].alias("value"), (-i).alias("place"), c["name"].alias("name")))
    return F.slice(F.sort_array(F.filter(placed, lambda c: c["value"] > 0), asc=False), 1, k)


def with_reasons(alerts: DataFrame, k: int = MODEL.reasons, anomaly_at: float = MODEL.anomaly_reason_at) -> DataFrame:
    """Alerts with features, contributions, anomaly_pct and strangest get `reasons`, a JSON array of feature, value, contribution and
    text; a very strange row has one reason more."""
    values = F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f).cast("string"))])
    texts = F.create_map(*[x for f in FEATURES for x in (F.lit(f), sentence(f, F.col(f)))])
    picked = F.transform(top(k=k), lambda c: F.struct(c["name"].alias("feature"), F.try_element_at(values, c["name"]).alias("value"), c["value"].alias("contribution"), F.try_element_at(texts, c["name"]).alias("text")))
    first, second = (label_of(F.try_element_at("strangest", F.lit(i))) for i in (1, 2))
    head, middle, tail = ANOMALY.replace("{second}", "{first}").split("{first}")
    extra = F.struct(F.lit("anomaly").alias("feature"), F.col("anomaly_pct").cast("string").alias("value"), F.lit(0.0).alias("contribution"), F.concat(F.lit(head), first, F.lit(middle), second, F.lit(tail)).alias("text"))
    return alerts.withColumn("reasons", F.to_json(F.when(F.col("anomaly_pct") >= anomaly_at, F.concat(picked, F.array(extra))).otherwise(picked)))
