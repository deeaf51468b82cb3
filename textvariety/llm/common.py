"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
# Elements summed one by one inside a block of a running total.
_BLOCK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str, **types: str) -> DataFrame:
    """Exactly these columns, cast to `types`; a missing one is an error.

    Columns are found by position, so others whose names differ only in case,
    or are repeated, do no harm.
    """
    inner = df.toDF(*(f"__c{i}" for i in range(len(df.columns))))
    lower = [c.lower() for c in df.columns]
    chosen = []
    for name in names:
        where = (df.columns if name in df.columns else lower).index(name)
        column = F.col(f"__c{where}")
        column = column.cast(types[name]) if name in types else column
        chosen.append(column.alias(name))
    return inner.select(*chosen)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indices(count: Column) -> Column:
    """0, 1, … count - 1; empty for none."""
    up = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)).cast("int"))
    return F.slice(up, 1, F.greatest(count, F.lit(0)).cast("int"))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)


def running(numbers: Column) -> Column:
    """Inclusive running totals of an array of longs, in time near its length."""

    def with_totals(state: Column) -> Column:
        def total(i: Column) -> Column:
            block = (i / _BLOCK).cast("int")
            part = F.slice(state["x"], block * _BLOCK + 1, i % _BLOCK + 1)
            return F.get(state["before"], block) + _total(part)

        return F.transform(indices(F.size(state["x"])), total)

    def with_blocks(state: Column) -> Column:
        before = F.transform(
            indices(F.size(state["sums"])),
            lambda b: _total(F.slice(state["sums"], F.lit(1), b)),
        )
        return let(F.struct(state["x"].alias("x"), before.alias("before")), with_totals)

    def start(x: Column) -> Column:
        blocks = F.ceil(F.size(x) / _BLOCK)
        sums = F.transform(
            indices(blocks), lambda b: _total(F.slice(x, b * _BLOCK + 1, _BLOCK))
        )
        return let(F.struct(x.alias("x"), sums.alias("sums")), with_blocks)

    return let(numbers, start)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, of sorted (start, rank, end, kind) structs."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
        ),
        ",",
    )


def n_of(spans: Column, kind: str) -> Column:
    found = F.filter(spans, lambda s: s["kind"] == kind)
    return F.size(found).cast("bigint")
