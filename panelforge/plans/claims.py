"""Claims: one feature row per person from visits and fee lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.ratios import null_as_zero_sum, safe_ratio, share
from panelforge.functions.scalars import parse_day, piece_count
from panelforge.operators.aggregates import STATISTICS, correlation, statistic_columns
from panelforge.operators.columns import common_columns, drop_ranges, nonzero_columns
from panelforge.operators.entity import repeat_rate, text_flags, venue_risk
from panelforge.operators.joins import align, attach_groups, union_keys
from panelforge.plans import presets
from panelforge.session import pin


@dataclass(frozen=True)
class VisitRoles:
    """Column roles of the visits.

    ``ratios``  name -> (numerator, denominator), taken over the sums per person
    ``shares``  name -> numerator, divided by the total of ``total_of``
    """

    person: str
    venue: str
    day: str
    text: str
    special: str
    registration: str
    amounts: Sequence[str]
    cell_measures: Sequence[str]
    ratios: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    total: str = "total"
    total_of: Sequence[str] = ()
    shares: Mapping[str, str] = field(default_factory=dict)
    fund: str | None = None
    account: str | None = None
    off_account: str | None = None
    paid: str = "paid_total"
    off_fund: str = "off_fund_rate"
    gap_mean: str = "gap_mean"
    gap_std: str = "gap_std"


@dataclass(frozen=True)
class FeeRoles:
    """Column roles of the fee lines."""

    person: str
    venue: str
    day: str
    price: str
    quantity: str
    code: str
    form: str


def person_block(visits: DataFrame, roles: VisitRoles) -> DataFrame:
    """Everything grouped by person alone: wide statistics, text pieces, record count."""
    return visits.groupBy(roles.person).agg(
        *statistic_columns(roles.amounts, ["sum", "mean", "std"]),
        F.sum(piece_count(roles.text)).alias("diseases_kinds"),
        F.count(F.lit(1)).alias("records_num"),
    )


def venue_block(visits: DataFrame, risk: DataFrame, roles: VisitRoles) -> DataFrame:
    """Everything grouped by (person, venue): distinct venues and their risk."""
    visited = visits.groupBy(roles.person, roles.venue).agg(F.count(F.lit(1)).alias("_n"))
    rated = attach_groups(visited, risk.select(roles.venue, "weight"), on=roles.venue)
    risky = F.col("weight").isNotNull()
    return rated.groupBy(roles.person).agg(
        F.count(F.when(F.col(roles.venue).isNotNull(), 1)).alias("hospital_kinds"),
        F.count(F.when(risky, 1)).alias("hospital_cheat_kinds"),
        F.sum(F.when(risky, F.col("_n")).otherwise(0)).alias("hospital_cheat_records"),
        F.sum(F.coalesce("weight", F.lit(0))).alias("hospital_cheat_weights"),
    )


_FLAGS = ["special", "registration"]


def day_cells(visits: DataFrame, roles: VisitRoles) -> DataFrame:
    """One row per (person, day): amount sums, keyword marks and rows with text.

    The calendar bounds the cells of a person, so they are dealt by person, once for all that is made of them.
    """
    marks = text_flags(roles.text, roles.special, roles.registration)
    return (
        visits.dropna(subset=[roles.person, roles.day])
        .groupBy(roles.person, roles.day)
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in roles.cell_measures],
            *[F.sum(mark).alias(name) for name, mark in marks.items()],
            F.count(roles.text).alias("_texts"),
        )
        .repartition(roles.person)
    )


def _cell_statistics(roles: VisitRoles, suffix: str, cells_name: str):
    stats = statistic_columns(
        roles.cell_measures, ["std", "mean", "max", "median"], "{column}_{stat}_" + suffix
    )
    noted = F.col("_texts") > 0
    stats += [
        STATISTICS[s](F.when(noted, F.col(flag))).alias(f"{flag}_{s}_{suffix}")
        for flag in _FLAGS
        for s in ("max", "median", "mean", "std")
    ]
    return [*stats, F.count(F.lit(1)).alias(cells_name)]


def day_block(cells: DataFrame, roles: VisitRoles) -> DataFrame:
    """Statistics over the days of a person, and over the gaps between them."""
    ordered = Window.partitionBy(roles.person).orderBy(roles.day)
    gap = F.datediff(F.col(roles.day), F.lag(roles.day).over(ordered))
    single = F.count(F.lit(1)) == 1
    return (
        cells.withColumn("_gap", gap)
        .groupBy(roles.person)
        .agg(
            *_cell_statistics(roles, "byday", "day_records_num"),
            F.when(single, F.lit(-1.0)).otherwise(F.avg("_gap")).alias(roles.gap_mean),
            F.when(single, F.lit(0.0)).otherwise(F.stddev_pop("_gap")).alias(roles.gap_std),
        )
    )


def month_block(cells: DataFrame, roles: VisitRoles) -> DataFrame:
    """Statistics over the months of the year, built from the day cells."""
    months = cells.groupBy(roles.person, F.month(roles.day).alias("_month")).agg(
        *[F.sum(c).alias(c) for c in [*roles.cell_measures, *_FLAGS, "_texts"]]
    )
    return months.groupBy(roles.person).agg(
        *_cell_statistics(roles, "bymonth", "month_records_num")
    )


def add_ratios(features: DataFrame, roles: VisitRoles) -> DataFrame:
    """Ratios of sums, shares of the total and the split of the payments."""
    f = {
        name: safe_ratio(f"{num}_sum", f"{den}_sum")
        for name, (num, den) in roles.ratios.items()
    }
    total = null_as_zero_sum(*[f"{c}_sum" for c in roles.total_of])
    f[roles.total] = total
    f |= {name: share(F.col(f"{num}_sum"), total) for name, num in roles.shares.items()}
    if roles.fund:
        for s in ("mean", "std"):
            parts = [F.col(f"{c}_{s}") for c in (roles.fund, roles.account, roles.off_account)]
            f[f"{roles.paid}_{s}"] = parts[0] + parts[1] + parts[2]
            if s == "mean":
                outside = parts[1] + parts[2]
                f[f"{roles.off_fund}_{s}"] = share(outside, parts[0] + outside)
    return features.withColumns(f)


def visit_features(visits: DataFrame, risk: DataFrame, roles: VisitRoles) -> DataFrame:
    """All visit features of a person; what stays undefined is 0.

    Four groupings read the visits or each other: by person, by (person, venue), by (person,
    day), and by (person, month) from the day cells. Their results share the person as
    partitioning key, so the joins between them move nothing.
    """
    cells = day_cells(visits, roles)
    blocks = [
        add_ratios(person_block(visits, roles), roles),
        venue_block(visits, risk, roles),
        day_block(cells, roles),
        month_block(cells, roles),
    ]
    return align(blocks, roles.person).fillna(0)


#: Fee lines of one person that may meet in one task; a person who has more is dealt by month and venue first.
BUSY_LINES = 100_000


def fee_cells(fees: DataFrame, roles: FeeRoles, deal: Sequence[str] | None = None) -> DataFrame:
    """One row per (person, day, venue): quantity, amount and item code totals.

    Lines are dealt by (person, month, venue), which spreads a person over venues and keeps the days of a venue's month
    together: ``_first`` marks one of them. ``deal`` names fewer of these keys.
    """
    amount = F.col(roles.price) * F.col(roles.quantity)
    keys = [roles.person, "_month", roles.venue]
    cells = (
        fees.dropna(subset=[roles.person, roles.day])
        .withColumn("_month", F.month(roles.day))
        .repartition(*(deal or keys))
        .groupBy(*keys, roles.day)
        .agg(
            F.coalesce(F.sum(amount), F.lit(0)).alias("drug_fee"),
            F.coalesce(F.sum(roles.quantity), F.lit(0)).alias("drug_counts"),
            F.coalesce(F.sum(roles.code), F.lit(0)).alias("cata3"),
        )
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(roles.day))
    return cells.withColumn("_first", (place == 1) & F.col(roles.venue).isNotNull())


def fee_days(cells: DataFrame, roles: FeeRoles) -> DataFrame:
    """One row per (person, day): the totals, its venues and those that the month has not had before."""
    return cells.groupBy(roles.person, roles.day).agg(
        *[F.sum(c).alias(c) for c in _FEE_SUMS],
        F.count(roles.venue).alias("hospitals"),
        F.sum(F.col("_first").cast("int")).alias("_venues"),
    )


def busy_persons(fees: DataFrame, roles: FeeRoles) -> DataFrame:
    """The persons of more than ``BUSY_LINES`` lines: at most one for each so many lines, written."""
    counts = fees.groupBy(roles.person).agg(F.count(F.lit(1)).alias("_n"))
    busy = counts.where((F.col("_n") > BUSY_LINES) & F.col(roles.person).isNotNull())
    return pin(busy.select(F.col(roles.person).alias("_busy")), "busy-persons")


_FEE_SUMS = ["drug_fee", "drug_counts", "cata3"]
# the two families without the full set of statistics
_FEE_STATISTICS = {"hospitals_perday": ["max", "median"], "drug_counts_perday": ["max", "mean"]}


def fee_features(fees: DataFrame, roles: FeeRoles) -> DataFrame:
    """Daily and monthly statistics, correlation with elapsed days, repeated dosage forms.

    The lines of a person meet once and stay for all that is made of them. Of those with more than ``BUSY_LINES`` only the days
    meet, which the calendar bounds. The months are sums over the days, so no statistic's buffers are shuffled; a month's
    venues are the marks of their first days in it.
    """
    busy = busy_persons(fees, roles)
    if busy.isEmpty():
        table = _fee_statistics(fee_days(fee_cells(fees, roles, [roles.person]), roles), roles)
    else:
        is_busy = F.col(roles.person) == F.col("_busy")
        few, many = (fees.join(busy, is_busy, how) for how in ("left_anti", "left_semi"))
        days = fee_days(fee_cells(many, roles), roles).repartition(roles.person)
        table = _fee_statistics(fee_days(fee_cells(few, roles, [roles.person]), roles), roles)
        table = table.unionByName(_fee_statistics(days, roles))
    forms = repeat_rate(fees, roles.person, roles.form, "med_kinds")
    return table.join(forms, on=roles.person, how="left")


def _fee_statistics(days: DataFrame, roles: FeeRoles) -> DataFrame:
    """Statistics of the days of a person, who are dealt by person, and of the months."""
    names = ["hospitals", *_FEE_SUMS]
    ordered = Window.partitionBy(roles.person, F.month(roles.day)).orderBy(roles.day)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.lead(roles.day).over(ordered).isNull()
    sources = ["_venues", *_FEE_SUMS]
    months = {f"_month_{c}": F.when(last, F.sum(source).over(so_far)) for c, source in zip(names, sources, strict=True)}
    number = F.datediff(F.col(roles.day), F.lit("1970-01-01").cast("date")).cast("double")

    def statistics(column: str, per: str, source: str):
        stats = _FEE_STATISTICS.get(f"{column}_{per}", ["max", "mean", "std"])
        return [STATISTICS[s](F.col(source)).alias(f"{column}_{per}_{s}") for s in stats]

    def with_day(c: str, name: str):
        return correlation(F.col("_number"), F.col(c).cast("double")).alias(f"{name}_corrwithday")

    return days.withColumns({**months, "_number": number}).groupBy(roles.person).agg(
        *[a for c in names for a in statistics(c, "perday", c)],
        with_day("drug_counts", roles.quantity),
        with_day("drug_fee", "drug_fee"),
        with_day("cata3", roles.code),
        *[a for c in names for a in statistics(c, "permonth", f"_month_{c}")],
    )


def claims_table(
    visits: DataFrame,
    risk: DataFrame,
    fee_table: DataFrame,
    visit_roles: VisitRoles,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Visit and fee features of the persons who have both, with the label if given."""
    blocks = [visit_features(visits, risk, visit_roles), fee_table]
    return align(blocks if labels is None else [*blocks, labels], visit_roles.person)


# ------------------------------------------------------------------ the medical claims files


def medical_visits(raw: DataFrame) -> DataFrame:
    """Raw transactions without the unused columns and with a real date."""
    dropped = drop_ranges(raw, presets.CLAIMS_DROP_RANGES).drop(*presets.CLAIMS_DROP_COLUMNS)
    return dropped.withColumn(presets.CLAIMS_DAY, parse_day(presets.CLAIMS_DAY, "/"))


def medical_fees(fees: DataFrame, transactions: Sequence[DataFrame]) -> DataFrame:
    """Fee lines with their person and a real date."""
    keys = union_keys(transactions, [presets.CLAIMS_VISIT, presets.CLAIMS_PERSON])
    dated = fees.withColumn(presets.FEE_DAY, parse_day(presets.FEE_DAY, "-"))
    return dated.join(keys, on=presets.CLAIMS_VISIT)


def medical_visit_roles(train: DataFrame, test: DataFrame) -> VisitRoles:
    """Roles of the medical columns; amounts are those not all zero in both tables."""
    keys = {
        presets.CLAIMS_VISIT,
        presets.CLAIMS_PERSON,
        presets.CLAIMS_VENUE,
        presets.CLAIMS_DAY,
        presets.CLAIMS_TEXT,
    }
    common = common_columns(nonzero_columns(train), nonzero_columns(test))
    numeric = {f.name for f in train.schema if f.dataType.typeName() != "string"}
    return VisitRoles(
        person=presets.CLAIMS_PERSON,
        venue=presets.CLAIMS_VENUE,
        day=presets.CLAIMS_DAY,
        text=presets.CLAIMS_TEXT,
        special=presets.CLAIMS_SPECIAL,
        registration=presets.CLAIMS_REGISTRATION,
        amounts=[c for c in common if c not in keys and c in numeric],
        cell_measures=presets.CLAIMS_CELL_MEASURES,
        ratios=presets.CLAIMS_RATIOS,
        total=presets.CLAIMS_TOTAL,
        total_of=presets.CLAIMS_TOTAL_OF,
        shares=presets.CLAIMS_SHARES,
        fund=presets.CLAIMS_FUND,
        account=presets.CLAIMS_ACCOUNT,
        off_account=presets.CLAIMS_OFF_ACCOUNT,
        paid=presets.CLAIMS_PAID,
        off_fund=presets.CLAIMS_OFF_FUND,
        gap_mean=presets.CLAIMS_GAP_MEAN,
        gap_std=presets.CLAIMS_GAP_STD,
    )


def medical_fee_roles() -> FeeRoles:
    return FeeRoles(
        person=presets.CLAIMS_PERSON,
        venue=presets.CLAIMS_VENUE,
        day=presets.FEE_DAY,
        price=presets.FEE_PRICE,
        quantity=presets.FEE_QUANTITY,
        code=presets.FEE_CODE,
        form=presets.FEE_FORM,
    )


def medical_features(
    train: DataFrame, test: DataFrame, labels: DataFrame, fees: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Feature tables of the train (labelled) and test persons of the medical files.

    ``labels`` has the columns person and ``label``.
    """
    raw = [train, test]
    train, test = medical_visits(train), medical_visits(test)
    roles = medical_visit_roles(train, test)
    fee_table = fee_features(medical_fees(fees, raw), medical_fee_roles())
    risk = venue_risk(train, labels, roles.person, roles.venue, "label")
    return (
        claims_table(train, risk, fee_table, roles, labels),
        claims_table(test, risk, fee_table, roles),
    )
