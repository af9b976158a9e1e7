"""Rules that data must satisfy; all of a validator's rules are counted in one pass."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ValidationError
from .types import SEQ


def _spark(df, keys: list[str] | None = None) -> tuple[DataFrame, list[str], DataFrame]:
    """A frame as a Spark one without and with the order column, and its keys."""
    if not isinstance(df, pd.DataFrame):
        return df, list(keys or []), df
    import pyarrow as pa

    from .catalog import get_client
    from .types import encode_frame

    made = encode_frame(df)
    table = made.table.append_column(SEQ, pa.array(range(made.table.num_rows), pa.int64()))
    both = get_client().createDataFrame(table, T.StructType([*made.schema.fields, T.StructField(SEQ, T.LongType())]))
    return both.drop(SEQ), made.keys, both


def _missing(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    return c.isNull() | F.isnan(c) if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)) else c.isNull()


class ValidationRule:
    """A rule has ``counts``: aggregates of violations by name, all of which must be 0.

    A rule of one's own overrides that, or ``validate(df) -> bool``.
    """

    def __init__(self, name: str, error_message: str | None = None):
        self.name, self.error_message = name, error_message or f"Validation failed: {name}"

    def schema_problem(self, df: DataFrame) -> str | None:
        """What the schema alone tells; no job is run for it."""
        return None

    def counts(self, df: DataFrame) -> dict[str, Column]:
        return {}

    def extra_problem(self, df: DataFrame, keys: list[str], order: DataFrame) -> str | None:
        """What needs more than one pass of aggregates."""
        return None

    def problem(self, df, keys: list[str] | None = None, order: DataFrame | None = None) -> str | None:
        df, own, ordered = _spark(df, keys)
        order = ordered if order is None else order
        if (found := self.schema_problem(df)) is not None:
            return found
        if counts := self.counts(df):
            row = df.agg(*(c.alias(f"c{k}") for k, c in enumerate(counts.values()))).first()
            if any(row):
                return ", ".join(f"{n} {what}" for n, what in zip(row, counts) if n)
        return self.extra_problem(df, own, order)

    def validate(self, df) -> bool:
        return self.problem(df) is None

    def get_details(self, df) -> str:
        return self.problem(df) or ""


class ColumnExistsRule(ValidationRule):
    def __init__(self, columns: list[str], name: str = "column_exists"):
        super().__init__(name, f"Required columns missing: {list(columns)}")
        self.columns = list(columns)

    def schema_problem(self, df: DataFrame) -> str | None:
        lacking = sorted(set(self.columns) - set(df.columns))
        return f"Missing columns: {lacking}" if lacking else None


_KINDS = {float: (T.FractionalType,), int: (T.IntegralType,), str: (T.StringType,), bool: (T.BooleanType,), pd.Timestamp: (T.TimestampType, T.TimestampNTZType)}


class DataTypeRule(ValidationRule):
    """Columns that are absent, and types other than float, int, str, bool and Timestamp, are passed over."""

    def __init__(self, type_map: dict[str, type], name: str = "data_type"):
        super().__init__(name, "Columns have unexpected types")
        self.type_map = dict(type_map)

    def schema_problem(self, df: DataFrame) -> str | None:
        wrong = [f"{c} is {df.schema[c].dataType.simpleString()}, not {t.__name__}" for c, t in self.type_map.items() if c in df.columns and t in _KINDS and not isinstance(df.schema[c].dataType, _KINDS[t])]
        return "; ".join(wrong) or None


class RangeRule(ValidationRule):
    """Nulls and an absent column pass."""

    def __init__(self, column: str, min_val=None, max_val=None, name: str | None = None, *, min_value=None, max_value=None):
        low, high = min_val if min_val is not None else min_value, max_val if max_val is not None else max_value
        super().__init__(name or f"range_{column}", f"Column '{column}' has values out of range [{low}, {high}]")
        self.column, self.min_val, self.max_val = column, low, high

    def counts(self, df: DataFrame) -> dict[str, Column]:
        if self.column not in df.columns:
            return {}
        c, there = F.col(f"`{self.column}`"), ~_missing(df, self.column)
        made = {}
        if self.min_val is not None:
            made[f"values below {self.min_val}"] = F.count_if(there & (c < F.lit(self.min_val)))
        if self.max_val is not None:
            made[f"values above {self.max_val}"] = F.count_if(there & (c > F.lit(self.max_val)))
        return made


class NoNullRule(ValidationRule):
    def __init__(self, columns: list[str], name: str = "no_null"):
        super().__init__(name, f"Columns have nulls: {list(columns)}")
        self.columns = list(columns)

    def counts(self, df: DataFrame) -> dict[str, Column]:
        return {f"nulls in {c}": F.count_if(_missing(df, c)) for c in self.columns if c in df.columns}


class UniqueRule(ValidationRule):
    """Each column by itself; nulls repeat each other."""

    def __init__(self, columns: list[str], name: str = "unique"):
        super().__init__(name, f"Columns have repeated values: {list(columns)}")
        self.columns = list(columns)

    def extra_problem(self, df: DataFrame, keys: list[str], order: DataFrame) -> str | None:
        found = []
        for c in self.columns:
            if c in df.columns:
                # one group for each value, made partly before the shuffle: distinct counts of several columns would expand the rows
                n = df.groupBy(F.col(f"`{c}`")).count().agg(F.sum(F.col("count") - 1).alias("n")).first().n
                if n:
                    found.append(f"{n} repeats in {c}")
        return ", ".join(found) or None


class CustomRule(ValidationRule):
    """``validate_func`` takes a Spark frame and returns a bool, or a column that must be true in every row (null
    counts as true).  An exception is a failure."""

    def __init__(self, validate_func: Callable, name: str, error_message: str | None = None):
        super().__init__(name, error_message)
        self.validate_func = validate_func

    def extra_problem(self, df: DataFrame, keys: list[str], order: DataFrame) -> str | None:
        try:
            got = self.validate_func(df)
            if isinstance(got, Column):
                n = df.agg(F.count_if(~got)).first()[0]
                return f"{n} rows" if n else None
            return None if got else "the function returned false"
        except Exception as e:
            return f"{type(e).__name__}: {e}"


class SortedKeyRule(ValidationRule):
    """The first key never falls from row to row, as given.  Rows are compared within runs of their order, and the
    runs' ends with each other, so all rows need not be in one task."""

    RUN = 1 << 20

    def __init__(self, name: str = "sorted_index"):
        super().__init__(name, "Index is not sorted")

    def extra_problem(self, df: DataFrame, keys: list[str], order: DataFrame) -> str | None:
        if not keys or SEQ not in order.columns:
            return None
        n = self.falls(order, keys[0]).first()["falls"]
        return f"{n} falls" if n else None

    def falls(self, order: DataFrame, key: str) -> DataFrame:
        """``falls``: how often the key is less than in the row before, by the order column."""
        runs = order.select(F.col(f"`{key}`").alias("k"), F.col(SEQ).alias("s"), F.floor(F.col(SEQ) / self.RUN).alias("r"))
        inner = runs.withColumn("p", F.lag("k").over(Window.partitionBy("r").orderBy("s"))).where("k < p")
        ends = runs.groupBy("r").agg(F.min_by("k", "s").alias("a"), F.max_by("k", "s").alias("b")).withColumn("p", F.lag("b").over(Window.orderBy("r"))).where("a < p")
        return inner.select("p").unionByName(ends.select("p")).agg(F.count("*").alias("falls"))


class DataValidator:
    """Rules that are checked together: all failures are reported in one ValidationError."""

    def __init__(self, rules: list[ValidationRule] = ()):
        self.rules, self.enabled = list(rules), True

    def add_rule(self, rule: ValidationRule) -> DataValidator:
        self.rules.append(rule)
        return self

    def remove_rule(self, name: str) -> None:
        self.rules = [r for r in self.rules if r.name != name]

    def enable(self) -> None:
        self.enabled = True

    def disable(self) -> None:
        self.enabled = False

    def validate(self, df, raise_on_error: bool = True, keys: list[str] | None = None, order: DataFrame | None = None) -> bool:
        if not self.enabled:
            return True
        df, own, ordered = _spark(df, keys)
        order = ordered if order is None else order
        problems: dict[int, str] = {}
        counted: list[tuple[int, str, Column]] = []
        for k, rule in enumerate(self.rules):
            if type(rule).validate is not ValidationRule.validate:
                try:
                    problems |= {} if rule.validate(df) else {k: ""}
                except Exception as e:
                    problems[k] = str(e)
            elif (found := rule.schema_problem(df)) is not None:
                problems[k] = found
            else:
                counted += [(k, what, c) for what, c in rule.counts(df).items()]
        if counted:
            row = df.agg(*(c.alias(f"c{i}") for i, (_, _, c) in enumerate(counted))).first()
            for n, (k, what, _) in zip(row, counted):
                if n:
                    problems[k] = ", ".join(filter(None, [problems.get(k), f"{n} {what}"]))
        for k, rule in enumerate(self.rules):
            if k not in problems and type(rule).validate is ValidationRule.validate and (found := rule.extra_problem(df, own, order)) is not None:
                problems[k] = found
        if problems and raise_on_error:
            texts = [f"{self.rules[k].error_message}" + (f" ({text})" if text else "") for k, text in sorted(problems.items())]
            raise ValidationError("Data validation failed: " + "; ".join(texts))
        return not problems


def create_validator(rules: list[ValidationRule] = ()) -> DataValidator:
    return DataValidator(rules)


def with_validation(validator: DataValidator) -> Callable:
    """A decorator: the first frame among the arguments is validated before the call."""

    def decorate(func: Callable) -> Callable:
        @functools.wraps(func)
        def run(*args, **kw):
            frame = next((x for x in [*args, *kw.values()] if isinstance(x, (pd.DataFrame, DataFrame))), None)
            if frame is not None:
                validator.validate(frame)
            return func(*args, **kw)

        return run

    return decorate


def create_timeseries_validator(value_columns: list[str], allow_nulls: bool = False) -> DataValidator:
    rules: list[ValidationRule] = [ColumnExistsRule(value_columns), DataTypeRule(dict.fromkeys(value_columns, float)), SortedKeyRule()]
    return DataValidator(rules if allow_nulls else [*rules, NoNullRule(value_columns)])


def create_financial_validator(price_columns: list[str] | None = None, volume_column: str | None = "volume") -> DataValidator:
    prices = list(price_columns or ["open", "high", "low", "close"])
    every = prices + ([volume_column] if volume_column else [])
    rules: list[ValidationRule] = [ColumnExistsRule(every), NoNullRule(every), *(RangeRule(c, min_val=0) for c in every)]

    def ohlc(df: DataFrame):
        names = {c.lower(): c for c in prices}
        if not {"open", "high", "low", "close"} <= set(names):
            return True
        o, h, low, c = (F.col(f"`{names[x]}`") for x in ("open", "high", "low", "close"))
        return (h >= low) & (h >= o) & (h >= c) & (low <= o) & (low <= c)

    return DataValidator([*rules, CustomRule(ohlc, "ohlc_relationship", "OHLC relationship violated")])
