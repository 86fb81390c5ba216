"""As-of joins and the compact projection of an append-only history.

Nothing here loops over events: the state at an event is a running sum over changes, and an as-of
join is the last value of a window over the union of both sides, so every step shuffles by user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, order: str, value: list[str]) -> DataFrame:
    """left with the values of the last right row of the same key at or before each row."""
    both = left.select("*", F.lit(None).cast(right.select(F.struct(*value).alias("r")).schema["r"].dataType).alias("_r"), F.lit(1).alias("_side"))
    names = [c for c in left.columns if c not in (by, order)]
    other = right.select(by, order, F.struct(*value).alias("_r"), F.lit(0).alias("_side"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names))
    w = Window.partitionBy(by).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.unionByName(other).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return rows.select(*left.columns, *(F.col("_r")[v].alias(v) for v in value))


def deltas_since(events: DataFrame, bases: DataFrame, deltas: DataFrame) -> DataFrame:
    """(user_id, replay_order, base_order, delta_order): the changes after each event's base and up to
    the event. The base is strictly before: what happened at its own place belongs to the past."""
    keyed = bases.select("user_id", "replay_order", F.col("replay_order").alias("base_order"))
    base = as_of(events.select("user_id", "replay_order"), keyed, "user_id", "replay_order", ["base_order"])
    # a change belongs to the last base at or before it: only events and changes of one base meet
    own = as_of(deltas.select("user_id", "replay_order"), keyed, "user_id", "replay_order", ["base_order"])
    d = own.select("user_id", F.coalesce("base_order", F.lit(-1)).alias("_base"), F.col("replay_order").alias("delta_order"))
    met = base.withColumn("_base", F.coalesce("base_order", F.lit(-1))).join(d, ["user_id", "_base"])
    return met.where((F.col("delta_order") > F.col("_base")) & (F.col("delta_order") <= F.col("replay_order"))).select("user_id", "replay_order", "base_order", "delta_order")


def point_intervals(members: DataFrame, changes: DataFrame) -> DataFrame:
    """(user_id, epoch, raw_id, kind, label, from_order, to_order): the spells of every drawn point.

    members: base points of an epoch (user_id, epoch, raw_id, label), noise as -1. changes: (user_id,
    epoch, raw_id, order, change, label) with change 'projection' or 'inactivate'. At one place an
    inactivation comes before a projection. A removed point has no spell until it is drawn again.
    """
    base = members.select("user_id", "epoch", "raw_id", F.col("epoch").alias("order"), F.lit(-1).alias("_n"), F.lit("base").alias("kind"), "label")
    later = changes.select("user_id", "epoch", "raw_id", "order", F.when(F.col("change") == "inactivate", 0).otherwise(1).alias("_n"), F.when(F.col("change") == "inactivate", "removed").otherwise("assigned").alias("kind"), "label")
    return spells_of(base.unionByName(later))


def spells_of(rows: DataFrame) -> DataFrame:
    """The spells of points from rows (user_id, epoch, raw_id, order, _n, kind, label) of what they become; 'removed' ends one."""
    w = Window.partitionBy("user_id", "epoch", "raw_id").orderBy("order", "_n")
    spells = rows.withColumn("to_order", F.lead("order").over(w))
    # of two changes at one place the last counts
    return spells.where((F.col("kind") != "removed") & (F.col("to_order").isNull() | (F.col("to_order") > F.col("order")))).select("user_id", "epoch", "raw_id", "kind", "label", F.col("order").alias("from_order"), "to_order")


def timeline(events: DataFrame, spells: DataFrame) -> DataFrame:
    """(user_id, event_id, replay_order, epoch, k_count, noise, assigned): the state at each event.

    events carry the epoch they belong to. A spell adds one at its start and takes it away at its
    end; running sums of these, by cluster and then over clusters, give the counts. A cluster counts
    in k_count while it owns a point.
    """
    edges = spells.select("user_id", "epoch", "kind", "label", F.explode(F.array(F.struct(F.col("from_order").alias("order"), F.lit(1).alias("d")), F.struct(F.col("to_order").alias("order"), F.lit(-1).alias("d")))).alias("e")).select("user_id", "epoch", "kind", "label", "e.*").where("order is not null")
    one = F.col("d")
    steps = edges.groupBy("user_id", "epoch", "label", "order").agg(F.sum(one).alias("d"), F.sum(F.when(F.col("kind") == "assigned", one).otherwise(0)).alias("da"))
    size = F.sum("d").over(Window.partitionBy("user_id", "epoch", "label").orderBy("order"))
    steps = steps.withColumn("size", size)
    owned = F.when((F.col("size") > 0) & (F.col("size") - F.col("d") <= 0), 1).when((F.col("size") <= 0) & (F.col("size") - F.col("d") > 0), -1).otherwise(0)
    moves = steps.withColumn("dk", F.when(F.col("label") >= 0, owned).otherwise(0)).groupBy("user_id", "epoch", "order").agg(F.sum("dk").alias("k"), F.sum(F.when(F.col("label") < 0, F.col("d")).otherwise(0)).alias("n"), F.sum("da").alias("a"))
    w = Window.partitionBy("user_id", "epoch").orderBy("order")
    states = moves.select("user_id", "epoch", F.col("order").alias("replay_order"), *(F.sum(c).over(w).alias(name) for c, name in (("k", "k_count"), ("n", "noise"), ("a", "assigned"))))
    keyed = lambda df: df.withColumn("_key", F.concat_ws(":", F.col("user_id").cast("string"), F.col("epoch").cast("string")))
    out = as_of(keyed(events.select("user_id", "event_id", "replay_order", "epoch")), keyed(states).select("_key", "replay_order", "k_count", "noise", "assigned"), "_key", "replay_order", ["k_count", "noise", "assigned"])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("user_id", "event_id", "replay_order", "epoch", zero("k_count"), zero("noise"), zero("assigned"))


def cluster_sizes(events: DataFrame, spells: DataFrame) -> DataFrame:
    """(user_id, event_id, label, base, assigned): sizes of each cluster at chosen events.

    A sweep: the starts and ends of spells in order give each cluster's sizes between two changes by running sums,
    and the events that lie between them are found by their numbers, so the work is that of the spells, the events and the result.
    """
    e = events.select("user_id", "epoch", "event_id", "replay_order")
    ends = F.array(F.struct(F.col("from_order").alias("order"), F.lit(1).alias("d")), F.struct(F.col("to_order").alias("order"), F.lit(-1).alias("d")))
    edges = spells.select("user_id", "epoch", "kind", "label", F.explode(ends).alias("e")).select("user_id", "epoch", "kind", "label", "e.*").where("order is not null")
    moves = edges.groupBy("user_id", "epoch", "label", "order").agg(*(F.sum(F.when(F.col("kind") == kind, F.col("d")).otherwise(0)).alias(f"_{kind}") for kind in ("base", "assigned")))
    w = Window.partitionBy("user_id", "epoch", "label").orderBy("order")
    sizes = moves.select("user_id", "epoch", "label", "order", F.sum("_base").over(w).alias("base"), F.sum("_assigned").over(w).alias("assigned"), F.lead("order").over(w).alias("until"))
    sizes = sizes.where(F.col("base") + F.col("assigned") > 0)
    # how many events of the epoch come before each change; an event comes after what happens at its own place
    place = Window.partitionBy("user_id", "epoch").orderBy("replay_order")
    numbered = e.withColumn("_n", F.row_number().over(place))
    changes = sizes.select("user_id", "epoch", F.explode(F.array_distinct(F.array_compact(F.array("order", "until")))).alias("order")).distinct()
    both = numbered.select("user_id", "epoch", F.col("replay_order").alias("order"), F.lit(1).alias("_event")).unionByName(changes.select("user_id", "epoch", "order", F.lit(0).alias("_event")))
    before = Window.partitionBy("user_id", "epoch").orderBy("order", "_event").rowsBetween(Window.unboundedPreceding, 0)
    counts = both.withColumn("_before", F.sum("_event").over(before)).where("_event = 0").select("user_id", "epoch", "order", "_before")
    until = counts.select("user_id", "epoch", F.col("order").alias("until"), F.col("_before").alias("_last"))
    met = sizes.join(counts, ["user_id", "epoch", "order"]).join(until, ["user_id", "epoch", "until"], "left")
    totals = numbered.groupBy("user_id", "epoch").agg(F.max("_n").alias("_all"))
    met = met.join(totals, ["user_id", "epoch"]).withColumn("_last", F.coalesce("_last", "_all")).where(F.col("_last") > F.col("_before"))
    each = met.select("user_id", "epoch", "label", "base", "assigned", F.explode(F.sequence((F.col("_before") + 1).cast("int"), F.col("_last").cast("int"))).alias("_n"))
    return each.join(numbered.select("user_id", "epoch", "_n", "event_id"), ["user_id", "epoch", "_n"]).select("user_id", "event_id", "label", "base", "assigned")


def checkpoints(frames: DataFrame, is_refit: Column) -> DataFrame:
    """frames (user_id, event_id, replay_order, ...) with is_checkpoint (the first, and each refit) and checkpoint_id."""
    w = Window.partitionBy("user_id").orderBy("replay_order")
    mark = is_refit | (F.row_number().over(w) == 1)
    out = frames.withColumn("is_checkpoint", mark)
    return out.withColumn("checkpoint_id", F.last(F.when(F.col("is_checkpoint"), F.col("event_id")), ignorenulls=True).over(w))


def positional_delta(frames: DataFrame) -> DataFrame:
    """frames with stored: all points at a checkpoint, else those beyond the length of the frame before.

    Points inserted in the middle are lost in this form; keyed_delta keeps them.
    """
    w = Window.partitionBy("user_id").orderBy("replay_order")
    before = F.coalesce(F.lag(F.size("points")).over(w), F.lit(0))
    tail = F.when(before < F.size("points"), F.slice("points", before + 1, F.size("points"))).otherwise(F.slice("points", 1, 0))
    return frames.withColumn("stored", F.when(F.col("is_checkpoint"), F.col("points")).otherwise(tail))


def keyed_delta(frames: DataFrame) -> DataFrame:
    """frames with added and removed points against the frame before; everything at a checkpoint."""
    w = Window.partitionBy("user_id").orderBy("replay_order")
    before = F.when(F.col("is_checkpoint"), F.slice("points", 1, 0)).otherwise(F.coalesce(F.lag("points").over(w), F.slice("points", 1, 0)))
    return frames.withColumn("_before", before).withColumns({"added": F.array_except("points", "_before"), "removed": F.array_except("_before", "points")}).drop("_before")


def rebuilt(frames: DataFrame) -> DataFrame:
    """frames with the points rebuilt from the stored parts since the checkpoint."""
    w = Window.partitionBy("user_id", "checkpoint_id").orderBy("replay_order")
    return frames.withColumn("rebuilt", F.flatten(F.collect_list("stored").over(w)))
