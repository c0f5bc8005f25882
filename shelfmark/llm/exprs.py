"""Column expressions that several native operators use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUP = 64


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` has it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda total, x: total + x)


def sums_before(numbers: Column) -> Column:
    """For each element the sum of all before it, in two levels so that long arrays stay cheap."""

    def within(all_: Column, before: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            group = F.floor(i / _GROUP).cast("int")
            return F.get(before, group) + _total(F.slice(all_, group * _GROUP + 1, i % _GROUP))

        return F.transform(all_, at)

    def grouped(all_: Column) -> Column:
        groups = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _GROUP).cast("int")),
            lambda g: _total(F.slice(all_, g * _GROUP + 1, F.lit(_GROUP))),
        )
        before = bind(groups, lambda sums: F.transform(sums, lambda _, g: _total(F.slice(sums, F.lit(1), g))))
        return bind(before, lambda sums: within(all_, sums))

    return bind(
        numbers,
        lambda all_: F.when(F.size(all_) > 0, grouped(all_)).otherwise(F.array().cast("array<int>")),
    )


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern with their code-point positions and the text around them.

    ``array<struct<value, start, stop, before, after>>``: ``before`` and ``after`` is the text
    between a match and its neighbours. The text is searched once if nothing is found.
    """

    def positions(found: Column) -> Column:
        def between(gaps: Column) -> Column:
            steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(g) + F.length(m))
            return bind(
                sums_before(steps),
                lambda starts: F.transform(
                    found,
                    lambda m, i: F.struct(
                        m.alias("value"),
                        (F.get(starts, i) + F.length(F.get(gaps, i))).alias("start"),
                        (F.get(starts, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("stop"),
                        F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after"),
                    ),
                ),
            )

        return F.when(F.size(found) > 0, bind(F.split(text, pattern, -1), between))

    none = F.array().cast("array<struct<value:string,start:int,stop:int,before:string,after:string>>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.coalesce(bind(matches, positions), none)
