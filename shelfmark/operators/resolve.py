"""Schema inference from sample rows, declared features, and job outcomes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import values
from shelfmark.schemas import ARTIFACTS, EVENTS, JOBS
from shelfmark.session import materialize
from shelfmark.sources.conform import conform

# The inferred types, in an order used only to keep them as numbers.
DTYPES = ("null", "bool", "int64", "float64", "string", "array", "struct", "unknown")
EXAMPLES = 3  # fixed value: examples kept per field
_MAP = "map<string,variant>"


def _dtype_code(value: Column) -> Column:
    """Position in ``DTYPES`` of the type a JSON value has.

    Whole numbers beyond 64 bits are stored as wide decimals; they still count as int64.
    """
    kind = F.schema_of_variant(value)
    wide_int = kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    names = (
        F.when(value.isNull() | F.is_variant_null(value), "null")
        .when(kind == "BOOLEAN", "bool")
        .when((kind == "BIGINT") | wide_int, "int64")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float64")
        .when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "struct")
        .otherwise("unknown")
    )
    known = F.array(*[F.lit(n) for n in DTYPES])
    return (F.array_position(known, names) - 1).cast("int")


def _example_text(value: Column) -> Column:
    """A value as JSON text; a float that is whole keeps its ``.0``."""
    plain = F.coalesce(F.to_json(value), F.lit("null"))
    whole_float = F.schema_of_variant(value).rlike(r"^DECIMAL\((\d|1[0-8]),0\)$")
    return F.when(whole_float, F.concat(plain, F.lit(".0"))).otherwise(plain)


def first_rows(rows: DataFrame, cap: int, by: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """The first ``cap`` rows of each dataset by ``row_idx``, which becomes 0, 1, 2, ….

    The stored numbers only tell the order: they may start anywhere, repeat and have gaps.
    Every map task passes on ``cap`` rows of a dataset at most.
    """
    order = Window.partitionBy(*by).orderBy("row_idx", "row_json")
    numbered = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap)
    return numbered.withColumn("row_idx", F.col("_n").cast("bigint") - 1).drop("_n")


def sample_fields(rows: DataFrame, by: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """``(*by, row_idx, pos, name, value)``: every field of every sample row.

    A row ``{"row": {…}}`` stands for its inner object; what is no object is left out.
    """
    parsed = rows.select(*by, "row_idx", "row_json", F.from_json("row_json", _MAP).alias("outer"))
    inner = F.from_json(F.get_json_object("row_json", "$.row"), _MAP)
    fields = parsed.select(
        *by, "row_idx",
        F.posexplode(
            F.map_entries(
                F.when(F.map_contains_key("outer", "row"), inner).otherwise(F.col("outer"))
            )
        ).alias("pos", "field"),
    )
    return fields.select(
        *by, "row_idx", "pos",
        F.col("field.key").alias("name"), F.col("field.value").alias("value"),
    )


def infer_schema(
    rows: DataFrame, row_cap: int | None = None, by: tuple[str, ...] = ("dataset_id",)
) -> DataFrame:
    """``(*by, pos, name, dtype, nullable, examples)`` of ``(*by, row_idx, row_json)``.

    The first value of a field decides its dtype, an explicit null makes it nullable, the
    first three values are its examples; ``pos`` is the order in which fields first appear.

    A dataset may hold a large share of all rows. The limit of three values per field is
    applied in every map task before the shuffle, so what meets in one task is three rows
    per field and map task. Nullability is looked for only in rows that contain the text
    ``null``, and is reduced to distinct field names before the shuffle as well.
    """
    if row_cap is not None:
        rows = first_rows(rows, row_cap, by)
    first = Window.partitionBy(*by, "name").orderBy("row_idx")
    kept = (
        sample_fields(rows, by)
        .withColumn("rn", F.row_number().over(first))
        .filter(F.col("rn") <= EXAMPLES)
        .withColumns({"code": _dtype_code(F.col("value")), "example": _example_text(F.col("value"))})
    )
    shape = kept.groupBy(*by, "name").agg(
        F.min("row_idx").alias("first_row"),
        F.min_by("pos", "row_idx").alias("first_pos"),
        F.min_by("code", "row_idx").alias("code"),
        F.sort_array(F.collect_list(F.struct("rn", "example"))).alias("kept"),
    )
    nullable = (
        sample_fields(rows.filter(F.contains("row_json", F.lit("null"))), by)
        .filter(F.col("value").isNull() | F.is_variant_null("value"))
        .select(*by, "name")
        .distinct()
        .withColumn("nullable", F.lit(True))
    )
    names = F.array(*[F.lit(n) for n in DTYPES])
    order = Window.partitionBy(*by).orderBy("first_row", "first_pos")
    return shape.join(nullable, [*by, "name"], "left").select(
        *by,
        (F.row_number().over(order) - 1).alias("pos"),
        "name",
        F.get(names, F.col("code")).alias("dtype"),
        F.coalesce("nullable", F.lit(False)).alias("nullable"),
        F.transform("kept", lambda e: e["example"]).alias("examples"),
    )


# Declared features stay JSON text, which keeps the order of their members.
INFO = (
    "dataset_id string, splits array<struct<config string, split string, features string>>, "
    "default_config string, default_split string, features string"
)


def _filled(value: Column) -> Column:
    """A declared feature list or map that is there and not empty."""
    return value.isNotNull() & ~value.isin("", "null", "[]", "{}", "0", "false")


def features_from_info(info: DataFrame) -> DataFrame:
    """``(dataset_id, features, config, split)`` of dataset info records.

    The first split with declared features wins and names its own config and split;
    otherwise the features of the record itself count. Gaps in the names are filled from
    the defaults, then from the first split.
    """
    def name(column: Column) -> Column:
        return F.nullif(column, F.lit(""))

    splits = F.col("splits")
    head = F.get(splits, F.lit(0))
    config = F.coalesce(name(F.col("default_config")), head["config"])
    split = F.coalesce(name(F.col("default_split")), head["split"])
    chosen = F.get(F.filter(splits, lambda s: _filled(s["features"])), F.lit(0))
    has_split = chosen.isNotNull()
    own = F.when(_filled(F.col("features")), F.col("features"))
    return info.select(
        "dataset_id",
        F.when(has_split, chosen["features"]).otherwise(own).alias("features"),
        F.when(has_split, F.coalesce(name(chosen["config"]), config)).otherwise(config).alias("config"),
        F.when(has_split, F.coalesce(name(chosen["split"]), split)).otherwise(split).alias("split"),
    )


def features_from_card(cards: DataFrame) -> DataFrame:
    """``(dataset_id, features)`` of cards ``(dataset_id, card_json)``.

    A map of names to types becomes a list of ``{name, dtype}``; a list stays as it is.
    """
    raw = F.get_json_object("card_json", "$.dataset_info.features")
    listed = F.transform(
        F.map_entries(F.from_json(raw, _MAP)),
        lambda e: F.struct(
            e["key"].alias("name"),
            F.when(
                F.schema_of_variant(e["value"]).startswith("OBJECT"),
                F.try_variant_get(e["value"], "$.dtype", "string"),
            )
            .otherwise(F.try_variant_get(e["value"], "$", "string"))
            .alias("dtype"),
        ),
    )
    is_list = F.ltrim(raw).startswith("[")
    return cards.select(
        "dataset_id",
        F.when(is_list, raw)
        .otherwise(F.to_json(listed, {"ignoreNullFields": "false"}))
        .alias("features"),
    )


def features_from_rows(
    rows: DataFrame, row_cap: int | None = None, by: tuple[str, ...] = ("dataset_id",)
) -> DataFrame:
    """``(*by, features)``: the inferred fields of each dataset as a JSON list.

    Example values are JSON already, so they are put into the text as they are.
    """
    fields = infer_schema(rows, row_cap, by)
    item = F.concat(
        F.lit('{"name":'), _json_string(F.col("name")),
        F.lit(',"dtype":'), _json_string(F.col("dtype")),
        F.lit(',"nullable":'), F.col("nullable").cast("string"),
        F.lit(',"examples":['), F.array_join("examples", ","), F.lit("]}"),
    )
    packed = fields.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("pos", item.alias("item")))).alias("items")
    )
    body = F.array_join(F.transform("items", lambda i: i["item"]), ",")
    return packed.select(*by, F.concat(F.lit("["), body, F.lit("]")).alias("features"))


def _json_string(value: Column) -> Column:
    one = F.to_json(F.array(value))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def classify_error(kind: Column, status: Column) -> Column:
    """Error class of a failed fetch by kind of failure and HTTP status.

    Kinds: ``timeout``, ``http_status``, ``connection``, ``value``; all else is unknown.
    """
    return (
        F.when(kind == "timeout", "timeout")
        .when((kind == "http_status") & (status == 429), "rate_limited")
        .when((kind == "http_status") & status.between(500, 599), "network")
        .when(kind == "connection", "network")
        .when(kind == "value", "parse_error")
        .otherwise("unknown")
    )


def apply_outcomes(
    jobs: DataFrame, outcomes: DataFrame, as_of: datetime
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(jobs, artifacts, events)`` after ``outcomes(job_id, ok, payload, error_class,
    error_detail)``, one row per finished job.

    A success yields an artifact dated by the start of its job; a failure counts as an
    attempt and keeps its class and the first 2,000 characters of its detail.
    """
    now = values.at(as_of)
    o = outcomes.select(
        F.col("job_id").alias("id"), "ok", "payload",
        F.col("error_class").alias("new_class"), F.col("error_detail").alias("new_detail"),
    )
    # Joined once and stored; the three results are read from that.
    joined = materialize(jobs.join(o, "id", "left"), "outcomes")
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    ended = F.col("ok").isNotNull()
    updated = joined.withColumns(
        {
            "state": F.when(failed, "error").when(ended, "done").otherwise(F.col("state")),
            "attempts": F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "error_class": F.when(failed, F.col("new_class")).otherwise(F.col("error_class")),
            "error_detail": F.when(
                failed, values.truncate_detail(F.col("new_detail"), 2000)
            ).otherwise(F.col("error_detail")),
            "finished_at": F.when(ended, now).otherwise(F.col("finished_at")),
        }
    )
    finished = joined.filter(ended)
    artifacts = finished.filter("ok").select(
        "dataset_id", "kind", "payload",
        F.coalesce("started_at", "enqueued_at").alias("created_at"),
        F.lit(False).alias("stale"),
    )
    keep_nulls = {"ignoreNullFields": "false"}
    job_id = F.col("id").alias("job_id")
    detail = values.truncate_detail(F.col("new_detail"), 500).alias("error_detail")
    payload = F.when(
        failed,
        F.to_json(
            F.struct(job_id, "kind", F.col("new_class").alias("error_class"), detail), keep_nulls
        ),
    ).otherwise(F.to_json(F.struct(job_id, "kind"), keep_nulls))
    kind = F.when(failed, "dataset.resolved_err").otherwise("dataset.resolved_ok")
    events = finished.select(
        F.sha2(F.concat_ws("|", kind, "id", values.iso_format(now)), 256).alias("id"),
        kind.alias("type"), "dataset_id", payload.alias("payload"), now.alias("created_at"),
    )
    return conform(updated, JOBS), conform(artifacts, ARTIFACTS), conform(events, EVENTS)
