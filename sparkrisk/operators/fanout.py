"""How many members last used an entity within a trailing window.

A member counts for an event at t if its last use of the entity before the event, in the total order (ms, txn_id), lies in
[t - w, t). Each use opens an interval that its member's next use, or the window's end, closes; the count is the running sum of
openings less closings. This takes sorting, not sets, so entities with many members cost n log n. The entities of all counts are
swept together: one shuffle to find next uses, one for the sums, one to bring an event's counts together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Count:
    name: str
    entity: str
    member: str
    width: int


def last_use_counts(events: DataFrame, counts: list[Count], at: str = "ms", order: str = "txn_id") -> DataFrame:
    """txn_id (or the order column) and a count per name."""
    kinds = list(dict.fromkeys((c.entity, c.member) for c in counts))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(e).cast("string").alias("entity"), F.col(m).cast("string").alias("member")) for k, (e, m) in enumerate(kinds)]))
    uses = events.select(F.col(at).alias("ms"), F.col(order).alias("id"), each.alias("use")).select("ms", "id", "use.*")
    follow = Window.partitionBy("kind", "entity", "member").orderBy("ms", "id")
    uses = uses.withColumn("next_ms", F.lead("ms").over(follow)).withColumn("next_id", F.lead("id").over(follow))
    widths = sorted({c.width for c in counts})
    # phases within a millisecond: 0 window edges, 1 events; an event is counted (0) before the use that it replaces closes (1)
    mark = lambda ms, phase, i, step, by: F.struct(ms.alias("ms"), F.lit(phase).alias("phase"), i.alias("id"), F.lit(step).alias("step"), *[F.lit(b).alias(f"w{w}") for w, b in zip(widths, by, strict=True)])
    none = F.lit(None).cast(uses.schema["id"].dataType)
    opens = F.when(F.col("next_ms").isNull() | (F.col("next_ms") > F.col("ms")), mark(F.col("ms") + 1, 0, none, 0, [1] * len(widths)))
    closes = []
    for w in widths:
        by = [-1 if x == w else 0 for x in widths]
        replaced = F.col("next_ms").isNotNull() & (F.col("next_ms") <= F.col("ms") + w)
        closes.append(F.when(opens.isNotNull(), F.when(replaced, mark(F.col("next_ms"), 1, F.col("next_id"), 1, by)).otherwise(mark(F.col("ms") + w + 1, 0, none, 0, by))))
    asks = mark(F.col("ms"), 1, F.col("id"), 0, [0] * len(widths))
    marks = uses.select("kind", "entity", F.explode(F.filter(F.array(opens, *closes, asks), lambda m: m.isNotNull())).alias("m")).select("kind", "entity", "m.*")
    sweep = Window.partitionBy("kind", "entity").orderBy("ms", "phase", "id", "step").rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.select("kind", "phase", "id", "step", *[F.sum(f"w{w}").over(sweep).alias(f"w{w}") for w in widths]).where("phase = 1 and step = 0")
    out = [F.max(F.when(F.col("kind") == kinds.index((c.entity, c.member)), F.col(f"w{c.width}"))).cast("long").alias(c.name) for c in counts]
    return swept.groupBy(F.col("id").alias(order)).agg(*out)
