"""Irregular readings as one row per period of a regular grid.

Method: harmonic seasonal regression with trend.  For each item the normal
equations of a linear trend and of harmonics of two seasons are sums over its
periods, so they are aggregated like any other sums (partly before the
shuffle) and only a small matrix per item remains to be solved.  A missing
period gets the model's prediction plus the residual, which is carried in a
straight line from the last observed period before the gap to the first one
after it; the filled series so meets the observed values at both ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.neighbours import with_next
from ..functions.normal import floor_div, instant_us, ntz_us
from ..shared import Scratch

ITEM = ["collection_name", "item_name"]
DAY = 86_400
#: Seasons in seconds with their numbers of harmonics, for steps below a day and from a day on.
SEASONS_FINE, SEASONS_COARSE = [(DAY, 2), (7 * DAY, 1)], [(7 * DAY, 2), (31_557_600, 1)]
#: 1, trend, and a sine and a cosine for each harmonic.
TERMS = 2 + 2 * sum(n for _, n in SEASONS_FINE)
#: Weight of the penalty on all terms but the constant, as a share of their own weight: it decides where readings can't.
RIDGE = 1e-6
#: Periods that are made at once, and the width of the groups in which the next period is looked up.
BLOCK = 4096
#: Integer index units: how many of them are a second.  Fixed values.
UNITS = {"ns": 1_000_000_000, "us": 1_000_000, "ms": 1_000, "s": 1}


def usable(readings: DataFrame, info: DataFrame) -> DataFrame:
    """``collection_name, item_name, period_no, step_s, value`` of each reading whose index can be read and whose
    ``value1`` is neither null nor NaN.

    Of the index columns the one that fits the collection's ``index_dtype``
    is used.  Collections that aren't listed, or have no positive step, and
    integer indexes without a known unit have no usable readings.
    """
    kind = F.lower(F.trim("index_dtype"))
    unit = F.coalesce(*(F.when(F.col("index_unit") == name, F.lit(n)) for name, n in UNITS.items()))
    step = F.col("step_s").cast("bigint")
    micros = F.when(kind.startswith("datetime"), ntz_us(F.col("idx_ts"))).when(kind == "object", instant_us(F.col("idx_text")))
    period = F.when(kind == "int64", floor_div(F.col("idx_int"), step * unit)).otherwise(floor_div(micros, step * 1_000_000))
    known = info.where("step_s > 0").dropDuplicates(["collection_name"]).select("collection_name", "index_dtype", "index_unit", "step_s")
    read = readings.select(*ITEM, "idx_ts", "idx_int", "idx_text", F.col("value1").alias("value")).where("value is not null and not isnan(value)")
    return read.join(known, "collection_name").select(*ITEM, period.alias("period_no"), step.alias("step_s"), "value").where("period_no is not null and item_name is not null")


def _terms(period: Column, step: Column, first: Column, span: Column) -> list[Column]:
    """The regressors at a period: the trend runs from 0 to 1 over the item's span."""
    fine = step < DAY
    seconds = (period * step).cast("double")
    made = [F.lit(1.0), (period - first) / F.greatest(span, F.lit(1))]
    for (a, n), (b, _) in zip(SEASONS_FINE, SEASONS_COARSE):
        season = F.when(fine, F.lit(float(a))).otherwise(F.lit(float(b)))
        # the phase is reduced first: sines of large arguments are slow and inexact
        phase = seconds / season
        phase = (phase - F.floor(phase)) * (2 * np.pi)
        made += [f(phase * k) for k in range(1, n + 1) for f in (F.sin, F.cos)]
    return made


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    upper = np.triu_indices(TERMS)
    for batch in batches:
        sums = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, batch.num_columns)], 1)
        n = len(sums)
        left, right = np.zeros((n, TERMS, TERMS)), sums[:, len(upper[0]) :]
        left[:, upper[0], upper[1]] = left[:, upper[1], upper[0]] = sums[:, : len(upper[0])]
        weight = left[:, 0, 0]
        penalty = np.full(TERMS, RIDGE)
        penalty[0] = 0
        left[:, range(TERMS), range(TERMS)] += penalty * weight[:, None] + (weight == 0)[:, None]
        found = np.linalg.solve(left, right[..., None])[..., 0]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), TERMS).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], [*ITEM, "_model"])


def fit(periods: DataFrame, bounds: DataFrame) -> DataFrame:
    """``collection_name, item_name, _model``: the coefficients of each item, from its periods' mean values."""
    finite = F.abs("value") < F.lit(float("inf"))
    terms = [f"_x{k}" for k in range(TERMS)]
    span = F.col("last_no") - F.col("first_no")
    wide = periods.where(finite).join(bounds, ITEM).select(
        *ITEM, "value", *(x.alias(t) for x, t in zip(_terms(F.col("period_no"), F.col("step_s"), F.col("first_no"), span), terms))
    )
    # infinite readings stand in the grid but fit no model
    products = [F.sum(F.col(a) * F.col(b)) for k, a in enumerate(terms) for b in terms[k:]] + [F.sum(F.col(a) * F.col("value")) for a in terms]
    sums = wide.groupBy(*ITEM).agg(*(p.alias(f"_s{k}") for k, p in enumerate(products)))
    return sums.mapInArrow(_solve, "collection_name string, item_name string, _model array<double>")


def regular_grid(readings: DataFrame, info: DataFrame) -> DataFrame:
    """``collection_name, item_name, period_no, step_s, value, n_readings, origin``: a row for each period of each
    item from its first to its last usable reading.

    ``value`` is the mean of a period's usable readings (``origin`` is
    "observed"), or the estimate for a period without one ("filled").  Items
    without a usable reading have no rows; items with one have one.  Repeated
    and late readings count like any others.  See :func:`usable` for what is
    left out.  No item is gathered in one task, and a gap of any length is
    written in blocks that are spread over all tasks.
    """
    spark = readings.sparkSession
    scratch = Scratch(spark, "grid")
    means = usable(readings, info).groupBy(*ITEM, "period_no", "step_s").agg(F.avg("value").alias("value"), F.count("*").alias("n_readings"))
    # read three times from here on: for the bounds, the model and the gaps
    periods = scratch.write(means, "periods")
    bounds = periods.groupBy(*ITEM).agg(F.min("period_no").alias("first_no"), F.max("period_no").alias("last_no"))
    # the bounds and the models are one row for each item
    bounds = scratch.write(bounds, "bounds")
    models = scratch.write(fit(periods, bounds), "models")

    span = F.col("last_no") - F.col("first_no")
    # at most a million buckets for an item, and at most a millionth of its span in a bucket, if that's more
    width = F.greatest(F.lit(BLOCK), F.ceil(span / 1_000_000))
    steps = with_next(periods.join(bounds, ITEM), ITEM, "period_no", ["value"], width)
    gaps = steps.where("next_period_no - period_no > 1").select(*ITEM, "period_no", "next_period_no", "step_s", "value", "next_value", "first_no", "last_no").join(models, ITEM, "left")

    def model(at: Column) -> Column:
        parts = [F.coalesce(F.col("_model")[k], F.lit(0.0)) * x for k, x in enumerate(_terms(at, F.col("step_s"), F.col("first_no"), span))]
        return sum(parts[1:], parts[0])

    a, b, at = F.col("period_no"), F.col("next_period_no"), F.col("_at")
    ends = gaps.select(*ITEM, "period_no", "next_period_no", "step_s", "first_no", "last_no", "_model", (F.col("value") - model(a)).alias("_left"), (F.col("next_value") - model(b)).alias("_right"))
    blocks = ends.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), floor_div(b - a - 2, F.lit(BLOCK).cast("bigint")))))
    # the number is given, so that few small rows that become many stay spread
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *ITEM, "period_no", "_block")
    start = a + 1 + F.col("_block") * BLOCK
    each = blocks.withColumn("_at", F.explode(F.sequence(start, F.least(start + BLOCK - 1, b - 1))))
    bridged = F.col("_left") + (F.col("_right") - F.col("_left")) * ((at - a) / (b - a))
    filled = each.select(*ITEM, at.alias("period_no"), "step_s", (model(at) + bridged).alias("value"), F.lit(0).cast("bigint").alias("n_readings"), F.lit("filled").alias("origin"))
    observed = periods.select(*ITEM, "period_no", "step_s", "value", "n_readings", F.lit("observed").alias("origin"))
    return observed.unionByName(filled)
