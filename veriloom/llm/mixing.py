"""Mixing sources to target weights under a time-varying curriculum.

`allocate` gives every source its share of the word budget (water-filling under a cap of `cap` passes), lays each source's
documents end to end in a hash order, and lets a document have one more copy while its middle lies within what is left
over whole passes.  Every copy thus has an interval of its source's cumulative demand; the integral of the source's weight
schedule, inverted at the interval's middle, is its training position in [0, 1].  `curriculum` range-sorts by position.

A source is never gathered: its prefix sums are built from sums of hash buckets of about BUCKET_ROWS documents.  The only single
partitions hold one row for each source.  Schedules are piecewise linear, given by knots (progress, weight).

Defined results: null texts have size 0; null sources form one source, ranked last; documents of size 0 get no copy;
repeated rows are placed each on their own; an empty table gives an empty plan; other columns pass through unless named
like the added ones.  The order depends on (seed, id) only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm import shared

BUCKET_ROWS = 2048
#: Weights repeat over the sources' ranks; so do the schedules: constant, rising, falling then level.
WEIGHTS = (1, 2, 3)
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (1.0, 1.75)), ((0.0, 1.5), (0.5, 0.75), (1.0, 0.75)))


def _cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(rank - 1, F.lit(len(values))).cast("int") + 1)


def segments(schedule: tuple) -> list[dict[str, float]]:
    """Of each segment of a schedule: start t, length n, weights a and b at its ends, and the share of the whole area before (lo) and up to its end (hi)."""
    pieces = [(a[0], b[0] - a[0], a[1], b[1], (b[0] - a[0]) * (a[1] + b[1]) / 2) for a, b in zip(schedule, schedule[1:], strict=False)]
    total, before, out = sum(p[4] for p in pieces), 0.0, []
    for start, length, wa, wb, area in pieces:
        out.append({"t": start, "n": length, "a": wa / total, "b": wb / total, "lo": before, "hi": before + area / total})
        before += area / total
    return out


def _knots(schedule: tuple) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in segments(schedule)])


def position(share: Column, knots: Column) -> Column:
    """The progress at which `share` of a source's demand is met: the schedule's integral inverted (a quadratic in each segment)."""

    def solve(s: Column) -> Column:
        rest = F.least(F.greatest(share - s["lo"], F.lit(0.0)), s["hi"] - s["lo"])
        slope = (s["b"] - s["a"]) / s["n"]
        root = F.sqrt(F.greatest(s["a"] * s["a"] + 2 * slope * rest, F.lit(0.0)))
        return s["t"] + F.when(s["a"] + root > 0, 2 * rest / (s["a"] + root)).otherwise(F.lit(0.0))

    into = F.filter(knots, lambda s: (share <= s["hi"]) | (s["t"] + s["n"] >= 1.0))
    return F.least(solve(F.element_at(into, 1)), F.lit(1.0))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, cap: int = 3) -> DataFrame:
    """source, source_size, docs -> with rank, weight and target: water-filling of all sizes by weight under cap * size.

    In order of cap over weight the capped sources come first; the level is set by the first source that isn't capped.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", _cycle(weights, F.col("rank")))
    limit = F.col("source_size") * cap
    order = Window.orderBy((limit / F.col("weight")).asc(), F.col("rank"))
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.sum(limit).over(order) + limit) / F.sum("weight").over(rest)
    out = ranked.withColumn("level", level)
    free = F.min(F.when(F.col("level") * F.col("weight") <= limit, F.struct((limit / F.col("weight")).alias("by"), "rank", "level"))).over(every)
    out = out.withColumn("at", free["level"])
    return out.withColumn("target", F.least(limit.cast("double"), F.col("at") * F.col("weight"))).drop("level", "at")


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def allocate(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, cap: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, positions (array<double>, one for each copy)."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_in_words(F.col(text)).alias("size"))
    sized = sized.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    sized = shared.cut(sized)  # narrow rows, read three times below; the texts are read once
    stats = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), weights, cap)
    knots = F.array(*[_knots(s) for s in schedules])
    stats = stats.withColumn("segments", F.element_at(knots, F.pmod(F.col("rank") - 1, F.lit(len(schedules))) + 1)).withColumn("buckets", F.ceil(F.col("docs") / BUCKET_ROWS))
    same = lambda a, b, *more: [a[c].eqNullSafe(b[c]) for c in ("source", *more)]
    rows = sized.join(stats, same(sized, stats)).select(sized["*"], "source_size", "target", "segments", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") * F.col("buckets") / 4294967296.0).alias("bucket"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = sums.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket"))
    rows = rows.join(before, same(rows, before, "bucket")).select(rows["*"], "before")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    more = F.col("start") + F.col("size") / 2.0 <= F.col("target") - passes * F.col("source_size")
    copies = F.when(F.col("size") > 0, passes + F.when(more & (passes < cap), 1).otherwise(0)).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("copies", copies)
    middle = lambda k: (k.cast("double") * F.col("source_size") + F.col("start") + F.col("size") / 2.0) / F.col("target")
    places = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: position(F.least(middle(k), F.lit(1.0)), F.col("segments")))).otherwise(F.array().cast("array<double>"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), places.alias("positions"))


def curriculum(plan: DataFrame) -> DataFrame:
    """One row for each copy, range-sorted by position (ties by doc_id): doc_id, copy, source, size, position."""
    rows = plan.select("doc_id", "source", "size", F.posexplode("positions").alias("copy", "position"))
    n = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def in_training_order(plan: DataFrame) -> DataFrame:
    """The plan with first_position (where a document's first copy stands; null: not taken), range-sorted by it, those not taken last."""
    rows = plan.withColumn("first_position", F.array_min("positions"))
    order = [F.col("first_position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    n = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
