"""Portfolio measures over the cleaned loans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import (
    default_flag,
    dti_bucket,
    number_or_error,
    percent,
    whole_years,
    yes_no,
)

PREVIOUS_DEFAULT = "previous_loan_defaults_on_file"
BREAKDOWNS = ["person_education", "emp_exp_years", "dti_bucket", PREVIOUS_DEFAULT]


def _cells_of(**keys: T.DataType) -> T.StructType:
    counts = {"d": T.LongType(), "n": T.LongType()}
    return T.StructType([T.StructField(k, t) for k, t in {**keys, **counts}.items()])


#: Tables of cells: keys, defaults `d` and loans `n`. Those of several sets of loans add up.
CELLS = {
    "breakdown_cells": _cells_of(
        person_education=T.StringType(), emp_exp_years=T.IntegerType(),
        dti_bucket=T.StringType(), previous_loan_defaults_on_file=T.StringType(),
    ),
    "age_cells": _cells_of(person_gender=T.StringType(), person_age=T.IntegerType()),
}


def with_measures(loans: DataFrame) -> DataFrame:
    """Adds the derived columns the measures group and sum by."""
    numbers = dict(loans.dtypes)
    read = {
        c: F.col(c) if numbers[c] != "string" else number_or_error(F.col(c))
        for c in ("loan_percent_income", "person_emp_exp", "person_age")
    }
    return loans.withColumns(
        {
            **read,
            "dti_bucket": dti_bucket(read["loan_percent_income"]),
            "is_default": default_flag(F.col("loan_status")),
            "emp_exp_years": whole_years(read["person_emp_exp"]),
        }
    )


def _totals() -> list[Column]:
    return [
        F.sum("is_default").alias("total_default"),
        F.count(F.lit(1)).alias("total_loans"),
    ]


def _rate() -> Column:
    return percent(F.col("total_default"), F.col("total_loans")).alias("pct_default")


def kpis(loans: DataFrame) -> DataFrame:
    """Loan count, default count and default rate; the rate is null without loans."""
    totals = with_measures(loans).agg(
        F.count(F.lit(1)).alias("total_loans"),
        F.coalesce(F.sum("is_default"), F.lit(0)).alias("total_defaults"),
    )
    rate = percent(F.col("total_defaults"), F.col("total_loans"))
    return totals.withColumn("default_rate", rate)


def default_breakdown(loans: DataFrame, key: str) -> DataFrame:
    """Defaults, loans and default rate per value of `key`, in key order, null keys left out."""
    return (
        with_measures(loans)
        .where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*_totals())
        .withColumn("pct_default", _rate())
        .orderBy(key)
    )


def previous_default_breakdown(loans: DataFrame) -> DataFrame | None:
    """As `default_breakdown`, or nothing when the table lacks the column."""
    if PREVIOUS_DEFAULT not in loans.columns:
        return None
    return default_breakdown(loans, PREVIOUS_DEFAULT)


def defaults_by_gender(loans: DataFrame) -> DataFrame:
    return (
        loans.where((F.col("loan_status") == 1) & F.col("person_gender").isNotNull())
        .groupBy("person_gender")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("person_gender")
    )


def gender_share(loans: DataFrame) -> DataFrame:
    """Share of all defaults per gender, in percent."""
    return _shares(defaults_by_gender(loans))


def _shares(counts: DataFrame) -> DataFrame:
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("share", percent(F.col("count"), total)).orderBy("person_gender")


def age_by_gender(loans: DataFrame) -> DataFrame:
    return (
        with_measures(loans)
        .where(F.col("person_gender").isNotNull())
        .groupBy("person_gender", yes_no(F.col("is_default")).alias("default"))
        .agg(
            F.min("person_age").alias("min"),
            F.max("person_age").alias("max"),
            F.avg("person_age").alias("mean"),
        )
        .orderBy("person_gender", "default")
    )


def bin_width(low: Column, high: Column, bins: int) -> Column:
    """Smallest of 1, 2, 5 times a power of ten, at least 1, by which `bins` bins hold all."""
    # No smaller power than that of a bin's even share can do, and ten times it always does.
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest((high - low) / bins, F.lit(1.0)))))
    steps = [power * m for m in (1.0, 2.0, 5.0, 10.0, 20.0, 50.0)]
    fits = (F.when(F.floor(high / w) - F.floor(low / w) < bins, w) for w in steps)
    return F.coalesce(*fits)


def age_histogram(loans: DataFrame, bins: int = 30) -> DataFrame:
    """Loans per age bin, bins named by their lower edge. One scan: the loans are brought
    down to one row per age, on which the width is found."""
    ages = (
        with_measures(loans)
        .where("person_age IS NOT NULL")
        .groupBy("person_age")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _binned(ages, bins)


def _binned(ages: DataFrame, bins: int) -> DataFrame:
    every = Window.partitionBy()
    low, high = F.min("person_age").over(every), F.max("person_age").over(every)
    return (
        ages.withColumn("width", bin_width(low, high, bins))
        .groupBy((F.floor(F.col("person_age") / F.col("width")) * F.col("width")).alias("bin_start"))
        .agg(F.sum("n").alias("count"))
        .orderBy("bin_start")
    )


def overview(loans: DataFrame) -> DataFrame:
    """Totals and all four breakdowns from one scan.

    The loans are first brought down to one row per combination of the four keys, so the
    five groupings expand that small table and not the loans.
    """
    return overview_of(_breakdown_cells(loans))


def _breakdown_cells(loans: DataFrame) -> DataFrame:
    counts = F.sum("is_default").alias("d"), F.count(F.lit(1)).alias("n")
    return with_measures(loans).groupBy(*BREAKDOWNS).agg(*counts)


def overview_of(cells: DataFrame) -> DataFrame:
    """`overview` from breakdown cells."""
    keys = BREAKDOWNS
    groupings = [[], *([F.col(k)] for k in keys)]
    named = F.coalesce(*(F.when(F.grouping(k) == 0, F.lit(k)) for k in keys), F.lit("all"))
    value = F.coalesce(*(F.when(F.grouping(k) == 0, F.col(k).cast("string")) for k in keys))
    return (
        cells.groupingSets(groupings, *(F.col(k) for k in keys))
        .agg(
            F.sum("d").alias("total_default"),
            F.sum("n").alias("total_loans"),
            named.alias("breakdown"),
            value.alias("key"),
        )
        .where("breakdown = 'all' OR key IS NOT NULL")
        .select("breakdown", "key", "total_default", "total_loans", _rate())
    )


# --- kept up to date: every measure from cells ---------------------------------


def cells(loans: DataFrame) -> dict[str, DataFrame]:
    """The cells of some loans, as `CELLS` has them."""
    counts = F.sum("is_default").alias("d"), F.count(F.lit(1)).alias("n")
    ages = with_measures(loans).groupBy("person_gender", "person_age").agg(*counts)
    made = {"breakdown_cells": _breakdown_cells(loans), "age_cells": ages}
    return {
        name: table.select(*(F.col(f.name).cast(f.dataType) for f in CELLS[name]))
        for name, table in made.items()
    }


def merged(cells: DataFrame) -> DataFrame:
    """One row per cell."""
    keys = [c for c in cells.columns if c not in ("d", "n")]
    return cells.groupBy(*keys).agg(F.sum("d").alias("d"), F.sum("n").alias("n"))


def kpis_of(cells: DataFrame) -> DataFrame:
    """`kpis` from any cells."""
    total = {"total_loans": "n", "total_defaults": "d"}
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in total.items()]
    return cells.agg(*sums).withColumn(
        "default_rate", percent(F.col("total_defaults"), F.col("total_loans"))
    )


def default_breakdown_of(cells: DataFrame, key: str) -> DataFrame:
    """`default_breakdown` from breakdown cells."""
    sums = F.sum("d").alias("total_default"), F.sum("n").alias("total_loans")
    groups = cells.where(F.col(key).isNotNull()).groupBy(key).agg(*sums)
    return groups.withColumn("pct_default", _rate()).orderBy(key)


def gender_share_of(cells: DataFrame) -> DataFrame:
    """`gender_share` from age cells; its first two columns are `defaults_by_gender`."""
    held = cells.where("d > 0 AND person_gender IS NOT NULL")
    return _shares(held.groupBy("person_gender").agg(F.sum("d").alias("count")))


def age_by_gender_of(cells: DataFrame) -> DataFrame:
    """`age_by_gender` from age cells."""
    split = F.array(
        F.struct(yes_no(F.lit(1)).alias("default"), F.col("d").alias("n")),
        F.struct(yes_no(F.lit(0)).alias("default"), (F.col("n") - F.col("d")).alias("n")),
    )
    aged = F.when(F.col("person_age").isNotNull(), F.col("n"))
    return (
        cells.where("person_gender IS NOT NULL")
        .select("person_gender", "person_age", F.inline(split))
        .where("n > 0")
        .groupBy("person_gender", "default")
        .agg(
            F.min("person_age").alias("min"),
            F.max("person_age").alias("max"),
            (F.sum(F.col("person_age") * F.col("n")) / F.sum(aged)).alias("mean"),
        )
        .orderBy("person_gender", "default")
    )


def age_histogram_of(cells: DataFrame, bins: int = 30) -> DataFrame:
    """`age_histogram` from age cells."""
    known = cells.where("person_age IS NOT NULL")
    return _binned(known.groupBy("person_age").agg(F.sum("n").alias("n")), bins)
