"""Facets, filters and browsing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

# The date formats that are tried, in order.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy", "MM/dd/yyyy", "yyyyMMdd", "yyyy年MM月dd日"]


def parse_date(value: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(value.cast("string"), F.lit(f)) for f in DATE_FORMATS])


def term_facet(rows: DataFrame, column: str, most: int = 20) -> DataFrame:
    """``value, count`` of a column, arrays by element, most frequent first."""
    value = F.explode(column) if isinstance(rows.schema[column].dataType, ArrayType) else F.col(column)
    counts = rows.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(most)


def date_facet(rows: DataFrame, column: str, form: str = "yyyy-MM") -> DataFrame:
    """``value, count`` by date bucket, newest first, dates that can't be read as ``unknown`` at the end."""
    kind = dict(rows.dtypes)[column]
    moment = F.col(column).cast("timestamp") if kind.startswith(("timestamp", "date")) else parse_date(F.col(column))
    counts = rows.groupBy(F.coalesce(F.date_format(moment, form), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("value") == "unknown", F.desc("value"))


def numeric_facet(rows: DataFrame, column: str, buckets: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """``value, count`` of half-open ranges (label, low, high), in their order; empty ones are left out."""
    x, chain = F.col(column).cast("double"), None
    for i, (_, low, high) in enumerate(buckets):
        test = (x >= low if low is not None else F.lit(True)) & (x < high if high is not None else F.lit(True))
        chain = F.when(test, i) if chain is None else chain.when(test, i)
    counts = rows.where(x.isNotNull()).groupBy(chain.alias("i")).agg(F.count(F.lit(1)).alias("count")).where("i is not null")
    label = F.get(F.array(*[F.lit(b[0]) for b in buckets]), F.col("i"))
    return counts.orderBy("i").select(label.alias("value"), "count")


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``field, value, count`` of several columns in one pass (grouping sets)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))


def field_quality(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``field, present, coverage, status`` of each column; 0.95 is good, 0.75 is worth watching."""
    total = F.count(F.lit(1))
    one = rows.agg(*[F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in columns], total.alias("_n"))
    out = one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in columns])).alias("p")).select("p.field", "p.present", F.round(F.col("p.present") / F.col("_n"), 6).alias("coverage"))
    return out.withColumn("status", F.when(F.col("coverage") >= 0.95, "good").when(F.col("coverage") >= 0.75, "watch").otherwise("poor"))


@dataclass(frozen=True)
class Condition:
    """``equals in range gt lt gte lte contains startswith`` on a field; null never matches."""

    field: str
    operator: str
    value: object
    lexical: bool = False

    def column(self, rows: DataFrame) -> Column:
        c, v = F.col(self.field), self.value
        is_list = isinstance(rows.schema[self.field].dataType, ArrayType)
        text = c.cast("string")
        if self.operator in ("equals", "in"):
            values = [str(x) for x in v] if self.operator == "in" else [str(v)]
            test = F.exists(c, lambda x: x.cast("string").isin(values)) if is_list else text.isin(values)
        elif self.operator == "range":
            low, high = v
            numbers = F.expr(f"try_cast(`{self.field}` as double)")
            as_text = text.between(str(low), str(high))
            numeric = not self.lexical and all(_number(x) is not None for x in (low, high))
            test = F.coalesce(numbers.between(_number(low), _number(high)), as_text) if numeric else as_text
        elif self.operator in ("gt", "lt", "gte", "lte"):
            compare = {"gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "gte": lambda a, b: a >= b, "lte": lambda a, b: a <= b}[self.operator]
            as_text = compare(text, F.lit(str(v)))
            test = as_text if _number(v) is None else F.coalesce(compare(F.expr(f"try_cast(`{self.field}` as double)"), F.lit(_number(v))), as_text)
        else:
            test = text.contains(str(v)) if self.operator == "contains" else text.startswith(str(v))
        return F.coalesce(test, F.lit(False))

    def to_dict(self) -> dict:
        return {"field": self.field, "operator": self.operator, "value": self.value, "lexical": self.lexical}


def _number(x: object) -> float | None:
    try:
        return float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


class FilterSet:
    """Conditions that must all hold."""

    def __init__(self, conditions: list[Condition] = ()):
        self.conditions = list(conditions)

    def add(self, field: str, operator: str, value: object) -> FilterSet:
        return FilterSet([*self.conditions, Condition(field, operator, value)])

    def remove(self, field: str, operator: str | None = None) -> FilterSet:
        return FilterSet([c for c in self.conditions if c.field != field or operator not in (None, c.operator)])

    def has(self, field: str) -> bool:
        return any(c.field == field for c in self.conditions)

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.where(reduce(and_, [c.column(rows) for c in self.conditions])) if self.conditions else rows

    def to_list(self) -> list[dict]:
        return [c.to_dict() for c in self.conditions]

    @classmethod
    def from_list(cls, items: list[dict]) -> FilterSet:
        return cls([Condition(**i) for i in items])


def term_filter(field: str, values: list | object) -> Condition:
    return Condition(field, "in", values) if isinstance(values, (list, tuple, set)) else Condition(field, "equals", values)


def browse(rows: DataFrame, by: str = "date_desc", date: str = "date", key: str = "doc_id", k: int = 20, filters: FilterSet | None = None) -> DataFrame:
    """Filtered rows in order, at most 100."""
    order = {"date_desc": [F.desc(date), F.desc(key)], "id_asc": [F.asc(key)], "id_desc": [F.desc(key)]}[by]
    return (filters or FilterSet()).apply(rows).orderBy(*order).limit(min(k, 100))


def audit(rows: DataFrame, column: str) -> DataFrame:
    """Count, minimum, maximum, mean and median of a numeric column, and distinct texts."""
    x = F.col(column)
    return rows.agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.avg(x), 6).alias("mean"), F.median(x).alias("median"), F.countDistinct("text").alias("texts"))
