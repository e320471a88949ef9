"""Per-entity features from dated records.

Records are first reduced to (entity, day) or (entity, month) cells on the map side. A cell
count per entity is bounded by the calendar, so the second step may use exact medians and
ordered windows even for an entity that owns a third of all records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalars import mentions, piece_count
from panelforge.operators.aggregates import correlation, statistic_columns
from panelforge.session import pin


def cell_sums(
    df: DataFrame, entity: str, bucket: str, measures: Mapping[str, Column] | Sequence[str]
) -> DataFrame:
    """Null-skipping sums per (entity, bucket); a cell with only nulls sums to 0."""
    if not isinstance(measures, Mapping):
        measures = {c: F.col(c) for c in measures}
    return (
        df.filter(F.col(entity).isNotNull() & F.col(bucket).isNotNull())
        .groupBy(entity, bucket)
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in measures.items()])
    )


def bucket_statistics(
    df: DataFrame,
    entity: str,
    bucket: str,
    measures: Mapping[str, Column] | Sequence[str],
    stats: Sequence[str] = ("std", "mean", "max", "median"),
    pattern: str = "{column}_{stat}_byday",
    cells_name: str | None = None,
) -> DataFrame:
    """Sums per (entity, bucket), then statistics of those sums per entity.

    ``cells_name`` adds the number of active buckets.
    """
    names = list(measures)
    extra = [F.count(F.lit(1)).alias(cells_name)] if cells_name else []
    return (
        cell_sums(df, entity, bucket, measures)
        .groupBy(entity)
        .agg(*statistic_columns(names, stats, pattern), *extra)
    )


def text_flags(text: str, special: str, registration: str) -> dict[str, Column]:
    """0/1 marks of two keywords; the second counts only without the first."""
    return {
        "special": mentions(text, special).cast("int"),
        "registration": mentions(text, registration, without=special).cast("int"),
    }


def flag_statistics(
    df: DataFrame,
    entity: str,
    bucket: str,
    text: str,
    special: str,
    registration: str,
    suffix: str,
    stats: Sequence[str] = ("max", "median", "mean", "std"),
) -> DataFrame:
    """Keyword marks summed per (entity, bucket), then statistics per entity.

    Rows without text take no part; entities with none are absent from the result.
    """
    present = df.dropna(subset=[entity, bucket, text])
    return bucket_statistics(
        present,
        entity,
        bucket,
        text_flags(text, special, registration),
        stats,
        pattern="{column}_{stat}_" + suffix,
    )


def venue_statistics(
    df: DataFrame, entity: str, bucket: str, venue: str, stats: Sequence[str], prefix: str
) -> DataFrame:
    """Distinct venues per (entity, bucket), then statistics per entity."""
    cells = df.groupBy(entity, bucket).agg(F.count_distinct(venue).alias("_venues"))
    return cells.groupBy(entity).agg(
        *statistic_columns(["_venues"], stats, prefix + "_{stat}")
    )


def record_counts(df: DataFrame, entity: str, name: str = "records_num") -> DataFrame:
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias(name))


def diagnosis_pieces(df: DataFrame, entity: str, text: str, name: str) -> DataFrame:
    return df.groupBy(entity).agg(F.sum(piece_count(text)).alias(name))


def days_since_first(cells: DataFrame, entity: str, day: str, name: str = "days") -> DataFrame:
    """Days since the entity's first day. ``cells`` has one row per (entity, day)."""
    first = F.min(day).over(Window.partitionBy(entity))
    return cells.withColumn(name, F.datediff(F.col(day), first))


def first_per_entity(df: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """The entity's first row in a total order, by a map-side combined minimum."""
    return _edge_row(df, entity, order, F.min)


def last_per_entity(df: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """The entity's last row in a total order, by a map-side combined maximum."""
    return _edge_row(df, entity, order, F.max)


def _edge_row(df: DataFrame, entity: str, order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c != entity and c not in order]
    edge = df.groupBy(entity).agg(pick(F.struct(*order, *rest)).alias("_row"))
    return edge.select(entity, *[F.col("_row")[c].alias(c) for c in [*order, *rest]])


def day_correlation(
    df: DataFrame,
    entity: str,
    day: str,
    measures: Mapping[str, Column] | Sequence[str],
    suffix: str = "corrwithday",
) -> DataFrame:
    """Correlation of daily sums with elapsed days, per entity; null if either is constant.

    Elapsed days differ from the day number by a constant, which a correlation ignores, so no
    ordering is needed.
    """
    cells = cell_sums(df, entity, day, measures)
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("double")
    aggregates = [
        correlation(F.col("_day"), F.col(c).cast("double")).alias(f"{c}_{suffix}")
        for c in measures
    ]
    return cells.withColumn("_day", number).groupBy(entity).agg(*aggregates)


def distinct_days(df: DataFrame, entity: str, day: str) -> DataFrame:
    return df.select(entity, day).dropna().distinct()


def day_gaps(df: DataFrame, entity: str, day: str, order: int = 1, name: str = "gap") -> DataFrame:
    """Differences of the given order between an entity's consecutive distinct days.

    An entity with a single day has the one gap −1; one with days but too few for the order
    has none.
    """
    ordered = Window.partitionBy(entity).orderBy(day)
    days = distinct_days(df, entity, day)
    value = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    gaps = days.withColumn("_d0", value)
    for n in range(1, order + 1):
        previous = F.lag(f"_d{n - 1}").over(ordered)
        gaps = gaps.withColumn(f"_d{n}", F.col(f"_d{n - 1}") - previous)
    alone = F.count(F.lit(1)).over(Window.partitionBy(entity)) == 1
    gaps = gaps.withColumn(name, F.when(alone, F.lit(-1)).otherwise(F.col(f"_d{order}")))
    return gaps.filter(F.col(name).isNotNull()).select(entity, day, name)


def gap_statistics(
    df: DataFrame, entity: str, day: str, mean_name: str = "gap_mean", std_name: str = "gap_std"
) -> DataFrame:
    """Mean and population deviation of the gaps between an entity's days; (−1, 0) for one day."""
    gaps = day_gaps(df, entity, day)
    return gaps.groupBy(entity).agg(
        F.avg("gap").alias(mean_name), F.stddev_pop("gap").alias(std_name)
    )


def venue_risk(
    records: DataFrame, labels: DataFrame, entity: str, venue: str, label: str, name: str = "weight"
) -> DataFrame:
    """Number of distinct positive-label entities seen at each venue.

    The positive ones are written first: where their measured size lets them be broadcast, only their records are shuffled.
    """
    positive = pin(labels.filter(F.col(label) == 1).select(entity).distinct(), "positive")
    seen = records.select(entity, venue).distinct().join(positive, on=entity, how="left_semi")
    return seen.groupBy(venue).agg(F.count(F.lit(1)).alias(name))


def entity_risk(
    records: DataFrame,
    risk: DataFrame,
    entity: str,
    venue: str,
    prefix: str = "venue_risk",
    weight: str = "weight",
    count: str | None = None,
) -> DataFrame:
    """Per entity: risky venues, records at risky venues, weight summed over its venues.

    ``count`` names the number of records a row stands for, if the records are grouped already.
    """
    held = F.count(F.lit(1)) if count is None else F.sum(count)
    visited = records.groupBy(entity, venue).agg(held.alias("_n"))
    rated = visited.join(risk.select(venue, weight), on=venue, how="left")
    risky = F.col(weight).isNotNull()
    return rated.groupBy(entity).agg(
        F.count(F.when(risky, 1)).alias(f"{prefix}_kinds"),
        F.sum(F.when(risky, F.col("_n")).otherwise(0)).alias(f"{prefix}_records"),
        F.sum(F.coalesce(F.col(weight), F.lit(0))).alias(f"{prefix}_weights"),
    )


def repeat_rate(df: DataFrame, entity: str, kind: str, prefix: str) -> DataFrame:
    """Per entity: non-null kinds, distinct kinds and the repeated share."""
    counts = (
        df.dropna(subset=[entity, kind])
        .groupBy(entity, kind)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(entity)
        .agg(
            F.sum("_n").alias(f"{prefix}_total"),
            F.count(F.lit(1)).alias(f"{prefix}_nunique"),
        )
    )
    total, distinct = F.col(f"{prefix}_total"), F.col(f"{prefix}_nunique")
    return counts.withColumn(f"{prefix}_rep_rate", (total - distinct) / total)
