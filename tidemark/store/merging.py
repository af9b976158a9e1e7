"""What an item's columns become when rows of other types are appended: nothing is lost without being told."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SchemaError, ValidationError
from .evolution import WIDER

#: Integers up to which a double tells every two apart.
EXACT = 1 << 53
_INTEGERS = ["tinyint", "smallint", "int", "bigint"]


def common_type(old: T.DataType, new: T.DataType) -> T.DataType | None:
    """The type that takes in the values of both, None if there's none.  Integers and doubles meet in double."""
    a, b = old.simpleString(), new.simpleString()
    if a == b or b == "void":
        return old
    if a == "void":
        return new
    if a in _INTEGERS and b in _INTEGERS:
        return old if _INTEGERS.index(a) > _INTEGERS.index(b) else new
    if {a, b} <= {*_INTEGERS, "float", "double"}:
        return T.DoubleType()
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        scale = max(old.scale, new.scale)
        whole = max(old.precision - old.scale, new.precision - new.scale)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else None
    if {a, b} == {"date", "timestamp_ntz"}:
        return T.TimestampNTZType()
    return None


def _values(df: DataFrame, column: str) -> bool:
    """Whether a column has any value."""
    return not df.where(F.col(f"`{column}`").isNotNull()).select(F.lit(1)).isEmpty()


def agreed_types(have: T.StructType, new: T.StructType, held: DataFrame, rows: DataFrame, evolution) -> tuple[T.StructType, dict[str, int]]:
    """The item's schema from now on, and how many new values of each column become null in it.

    Where types differ, the column takes the common one, or under evolution
    one that ``WIDER`` allows; a column without a value takes the other's
    type.  Integers that double can't tell apart, and types without a common
    one, raise ValidationError (SchemaError under evolution).  Only under
    FLEXIBLE are values that the old type can't take made null; they're
    counted, and a warning tells.
    """
    flexible = evolution is not None and evolution.strategy.name == "FLEXIBLE"
    refusal = ValidationError if evolution is None else SchemaError
    fields, nulled = [], {}
    for f in have.fields:
        if f.name not in new.names or new[f.name].dataType == f.dataType:
            fields.append(T.StructField(f.name, f.dataType))
            continue
        a, b = f.dataType, new[f.name].dataType
        wide = b if evolution is not None and b.simpleString() in WIDER.get(a.simpleString(), ()) else common_type(a, b)
        if wide is None:
            wide = a if not _values(rows, f.name) else b if not _values(held, f.name) else None
        if wide is None and not flexible:
            raise refusal(f"Schema mismatch detected: column '{f.name}' is {a.simpleString()}, the new rows have {b.simpleString()}")
        if wide is None:
            c = F.col(f"`{f.name}`")
            try:
                cast = rows.select(c, c.try_cast(a).alias("~cast"))
            except AnalysisException as e:
                raise refusal(f"Schema mismatch detected: there's no way from {b.simpleString()} to {a.simpleString()} for column '{f.name}'") from e
            lost = cast.where(c.isNotNull() & F.col("`~cast`").isNull()).count()
            if lost:
                nulled[f.name] = lost
                warnings.warn(f"{lost} values of column '{f.name}' can't be read as {a.simpleString()}; they're null now", stacklevel=4)
            wide = a
        if isinstance(wide, T.DoubleType):
            for side, kind, df in (("the item", a, held), ("the new rows", b, rows)):
                if kind.simpleString() == "bigint" and not df.where(F.abs(f"`{f.name}`") > EXACT).isEmpty():
                    raise refusal(f"Schema mismatch detected: column '{f.name}' of {side} has integers that double can't tell apart")
        fields.append(T.StructField(f.name, wide))
    added = [T.StructField(f.name, f.dataType) for f in new.fields if f.name not in have.names]
    return T.StructType([*fields, *added]), nulled


#: Kinds of tags whose stored form means nothing without the tag.
_CODED = {"json", "period", "interval", "duration", "duration_ns", "instant_ns"}


def merged_tags(old: dict, new: dict, have: T.StructType, made: T.StructType, target: T.StructType, tagged: bool) -> dict:
    """The item's tags after an append.  ``tagged``: the new rows came from pandas, so a missing tag means something.

    Categories are united; ordered ones must be known, and a column that is
    a category only on one side is plain from now on.  Periods, intervals and
    the like must agree.
    """
    tags = {}
    for f in target.fields:
        name, a, b = f.name, old.get(f.name), new.get(f.name)
        if name not in have.names or name not in made.names:
            tag = a if name in have.names else b
        elif not tagged and (a or {}).get("kind") != "category":
            tag = a
        else:
            tag = merged_tag(name, a, b, have[name].dataType == f.dataType)
        if tag:
            tags[name] = tag
    return tags


def merged_tag(name: str, a: dict | None, b: dict | None, kept: bool) -> dict | None:
    """The tag of a column that has two; ``kept``: it keeps the type that the first one belongs to."""
    kinds = {(a or {}).get("kind"), (b or {}).get("kind")}
    if kinds == {"category"}:
        unknown = [x for x in b["categories"] if x not in a["categories"]]
        if unknown and (a["ordered"] or b["ordered"]):
            raise ValidationError(f"column '{name}' is an ordered category without {unknown}")
        return dict(a, categories=a["categories"] + unknown, ordered=a["ordered"] and b["ordered"])
    if "category" in kinds:
        return None
    if kinds & _CODED and (len(kinds) > 1 or any(a.get(k) != b.get(k) for k in ("freq", "closed"))):
        if kinds <= {"instant", "instant_ns"} or kinds <= {"duration", "duration_ns"} or None in kinds and "json" not in kinds:
            return a or b
        raise ValidationError(f"column '{name}' is of kind {(a or {}).get('kind')}, the new rows have {(b or {}).get('kind')}")
    # where the type has changed, the tag of the side that has the new type holds
    return a if kept else b if b and b.get("kind") == (a or b).get("kind") and not kept else None
