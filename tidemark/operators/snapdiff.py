"""What changed between consecutive full snapshots of a table.

Method: a full outer join on the primary key of each snapshot with the one
before it, comparing canonical row hashes.  A missing side is an addition or
a removal.  Equal hashes mean equal rows; unequal ones are compared exactly,
because numbers that differ by float noise can lie on two sides of a step of
the canonical form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import ntz_us

KEY = ["collection_name", "item_name", "category", "idx_us"]
TOLERANCE = 1e-9


def _value(x: Column) -> Column:
    """Null and NaN are the same no-value."""
    return F.when(~F.isnan(x), x)


def _canonical(x: Column) -> Column:
    """A step of the tolerance, where a double can tell steps apart; else the number itself."""
    return F.when(F.abs(x) < 1e6, F.floor(x / TOLERANCE).cast("double")).otherwise(x + F.lit(0.0))


def _row_hash(values: list[str], texts: list[str]) -> Column:
    # a null leaves a hash as it was, so each value is told apart from its absence by a flag
    parts = [p for c in values for p in (F.col(c).isNull(), F.coalesce(_canonical(F.col(c)), F.lit(0.0)))]
    parts += [p for c in texts for p in (F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))]
    return F.xxhash64(*parts)


def _differ(a: Column, b: Column) -> Column:
    """Whether two numbers differ by more than the tolerance; a no-value differs from every number."""
    return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise((a != b) & ~(F.abs(a - b) <= TOLERANCE))


def changes(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``collection_name, snapshot_name, item_name, category, idx_us, change_kind`` and the values before and after
    (``old_value1, new_value1, ...``) of each key that differs from the collection's snapshot before by ``taken_at``.

    Snapshots taken at the same time follow by name; a snapshot without a time
    or not listed is left out.  A snapshot without rows removes everything.
    Of several rows of one key in a snapshot the one with the least ``row_id``
    holds.  Nulls in the key are values like others; further columns are left
    unread.  Keys are joined one by one, so no item or collection is gathered.
    """
    listed = snapshots.where("taken_at is not null").groupBy("collection_name", "snapshot_name").agg(F.min("taken_at").alias("taken_at"))
    ordered = Window.partitionBy("collection_name").orderBy("taken_at", "snapshot_name")
    order = listed.select("collection_name", "snapshot_name", F.row_number().over(ordered).alias("_no"), F.lead("snapshot_name").over(ordered).alias("_next_name"))

    values, texts = ["value1", "value2"], ["remark"]
    # keys without nulls, so that they're equal by themselves: each side's rows are distributed once, by these and the
    # snapshot, for the reduction of repeated rows and for the join alike
    plain = [F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(f"_{c}") for c in KEY[:3]]
    instant = ntz_us(F.col("idx"))
    read = rows.select(*plain, F.coalesce(instant, F.lit(0)).alias("_us"), instant.isNull().alias("_none"), "snapshot_name", "collection_name", "row_id", *(_value(F.col(c)).alias(c) for c in values), *texts)
    read = read.join(order, ["collection_name", "snapshot_name"])
    keys = ["_collection_name", "_item_name", "_category", "_us", "_none"]

    def side(which: str, no: Column, name: str) -> DataFrame:
        """The one row of each key and snapshot, under the number of the later snapshot; repeated rows shrink to one
        before they are shuffled."""
        own = read.withColumn("_at", no).where(F.col(name).isNotNull() & (F.col("_at") > 1))
        row = F.struct(*values, *texts, F.col(name).alias("name"))
        one = own.groupBy("_at", *keys).agg(F.min_by(row, F.col("row_id")).alias("_row")).select("_at", *keys, "_row.*").withColumn("hash", _row_hash(values, texts))
        return one.select("_at", *keys, *(F.col(c).alias(f"{which}_{c}") for c in (*values, *texts, "name", "hash")))

    new, old = side("new", F.col("_no"), "snapshot_name"), side("old", F.col("_no") + 1, "_next_name")
    both = new.join(old, ["_at", *keys], "full_outer")

    exact = F.lit(False)
    for c in values:
        exact = exact | _differ(F.col(f"old_{c}"), F.col(f"new_{c}"))
    for c in texts:
        exact = exact | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when((F.col("new_hash") != F.col("old_hash")) & exact, "changed")
    text = lambda c: F.when(F.col(f"_{c}") != "", F.substring(f"_{c}", 2, 1 << 30)).alias(c)
    return both.withColumn("change_kind", kind).where("change_kind is not null").select(
        text("collection_name"),
        F.coalesce("new_name", "old_name").alias("snapshot_name"),
        text("item_name"),
        text("category"),
        F.when(~F.col("_none"), F.col("_us")).alias("idx_us"),
        "change_kind",
        *(f"{which}_{c}" for c in values + texts for which in ("old", "new")),
    )
