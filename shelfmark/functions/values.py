"""Expressions over JSON values, timestamps, identifiers and limits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.schemas import SIZE_CLASSES, SIZE_LABELS

# ISO 8601 forms of a listing time. The plain one casts as it is; the
# others lack dashes, colons or seconds, or have a comma before the fraction.
_PLAIN = r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?)?$"
_LOOSE = (
    r"^(\d{4})-?(\d\d)-?(\d\d)(?:[T ](\d\d)(?::?(\d\d))?(?::?(\d\d))?(?:[.,](\d+))?"
    r"(Z|[+-]\d\d(?::?\d\d)?)?)?$"
)
_ZONED = r"(Z|[T ].*[+-]\d\d:\d\d)$"


def at(as_of: datetime) -> Column:
    """A moment as a zone-free UTC timestamp literal."""
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def variant_at(json: Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")


def json_bigint(json: Column, key: str) -> Column:
    """A member of a JSON object as BIGINT, by the type it has in the JSON text.

    Fractions round half to even, booleans count 1 or 0, text must be a whole number.
    """
    value = variant_at(json, key)
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint"))
        .when(kind == "STRING", text.try_cast("bigint"))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint"))
        .when(
            kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"),
            F.rint(F.try_variant_get(value, "$", "double")).try_cast("bigint"),
        )
    )


def parse_lm(value: Column) -> Column:
    """ISO 8601 text to a zone-free UTC timestamp; no zone means UTC, bad text NULL."""
    def part(i: int) -> Column:
        return F.regexp_extract(value, _LOOSE, i)

    def or_else(text: Column, default: str) -> Column:
        return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))

    offset = F.regexp_replace(
        F.regexp_replace(or_else(part(8), "Z"), r"^([+-]\d\d):?(\d\d)$", "$1:$2"),
        r"^([+-]\d\d)$", "$1:00",
    )
    expanded = F.concat(
        part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), or_else(part(4), "00"),
        F.lit(":"), or_else(part(5), "00"), F.lit(":"), or_else(part(6), "00"),
        F.lit("."), or_else(part(7), "0"), offset,
    )
    date_only = F.length(value) == 10
    utc_text = F.concat(value, F.when(date_only, "T00:00:00Z").otherwise("Z"))
    text = (
        F.when(value.rlike(_PLAIN), F.when(value.rlike(_ZONED), value).otherwise(utc_text))
        .when(value.rlike(_LOOSE), expanded)
    )
    return utc(text.try_cast("timestamp"))


def utc(moment: Column) -> Column:
    """An instant as a zone-free UTC timestamp, whatever the session zone is."""
    local = moment.cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)


def instant(ts: Column) -> Column:
    """A zone-free UTC timestamp as an instant, whatever the session zone is."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def iso_format(ts: Column) -> Column:
    """ISO text with ``+00:00``; microseconds appear only when they are not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        whole,
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )


def ns_local_id(dataset_id: Column) -> Column:
    """What follows the first slash, or the whole id."""
    slash = F.instr(dataset_id, "/")
    return F.when(
        slash > 0, F.substring(dataset_id, slash + 1, F.length(dataset_id))
    ).otherwise(dataset_id)


def size_rank(size_class: Column) -> Column:
    """Position in the rising size classes; -1 when unknown."""
    classes = F.array(*[F.lit(c) for c in SIZE_CLASSES])
    found = F.nullif(F.array_position(classes, size_class), F.lit(0).cast("bigint"))
    return F.coalesce(found - 1, F.lit(-1).cast("bigint")).cast("int")


def size_label(size_class: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in SIZE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, size_class), size_class)


def truncate_detail(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def budget_flags(budget: Column, cap: Column, elapsed: Column) -> Column:
    """``struct(row_cap_applied, budget_ms_requested, budget_exhausted)``."""
    asked = F.greatest(F.coalesce(budget, F.lit(0)), F.lit(0))
    rows = F.nullif(F.greatest(F.coalesce(cap, F.lit(0)), F.lit(0)), F.lit(0))
    return F.struct(
        F.coalesce(rows, F.lit(200)).cast("int").alias("row_cap_applied"),
        asked.cast("int").alias("budget_ms_requested"),
        F.coalesce((asked > 0) & (elapsed > asked), F.lit(False)).alias("budget_exhausted"),
    )


def access_class(private: Column) -> Column:
    return F.when(F.coalesce(private, F.lit(False)), "private").otherwise("public")


def effective_budget(value: Column, default: int) -> Column:
    """A request value, or the default when it is NULL or 0."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default)).cast("int")


def since(ts: Column, as_of: datetime, days: int, strict: bool = False) -> Column:
    """Within the last ``days`` days before ``as_of``; ``strict`` leaves the edge out."""
    edge = at(as_of) - F.make_dt_interval(F.lit(days))
    return ts > edge if strict else ts >= edge


def is_thin(tokens: Column, score: Column) -> Column:
    """A readme that is missing, short or low-scored (three-valued, like SQL ``OR``)."""
    return tokens.isNull() | (tokens < 50) | (score < 0.35)
