import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text, values


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value,want",
    [
        ("A b  A\tc\n", ["a", "b", "a", "c"]), ("", []), ("   ", []), (None, None),
        ("x\u001cy\u00a0z\u3000w\u2003v", ["x", "y", "z", "w", "v"]), ("Éa % _ \\", ["éa", "%", "_", "\\"]),
    ],
)
def test_query_tokens_follow_python_split(spark, value, want):
    assert one(spark, value, text.query_tokens) == want
    if value is not None:
        assert want == value.lower().split()


def test_token_count_and_scores(spark):
    for value in (None, "", " ", "one", "a b\nc", "w " * 49, "w " * 50, "w " * 900):
        n = len((value or "").split())
        assert one(spark, value, text.token_count) == n
        linear = one(spark, value, lambda v: text.score_linear(text.token_count(v)))
        assert linear == pytest.approx(min(n / 50, 1.0) if n > 0 else 0.0)
        log = one(spark, value, lambda v: text.score_log(text.token_count(v)))
        assert log == pytest.approx(min(1.0, math.log1p(n) / math.log1p(400)))


def walk(readme):
    """The heading rule in plain Python, written from its description."""
    title = description = None
    for line in (readme or "").splitlines():
        line = line.strip()
        if not line:
            continue
        if line[0] == "#":
            title = line.lstrip("#").strip() or None
        else:
            description = description or line
            if title is not None:
                break
    return title, description


def test_readme_headings(spark):
    rng = random.Random(7)
    pieces = ["# A", "## B c ", "#", "###  ", "text", " more text ", "", "  ", "x # y", "#\u00a0"]
    ends = ["\n", "\r\n", "\r", "\u2028", "\x0b"]
    samples = ["", None, "# only", "text", "# T\ntext\n# U", "#\ntext\n# U\nlast"]
    samples += [
        "".join(rng.choice(pieces) + rng.choice(ends) for _ in range(rng.randint(1, 7)))
        for _ in range(400)
    ]
    df = spark.createDataFrame(list(enumerate(samples)), "i int, v string")
    got = df.select("i", text.readme_headings(F.col("v")).alias("h")).collect()
    assert {r["i"]: (r["h"]["title"], r["h"]["description"]) if r["h"] else (None, None) for r in got} == {
        i: walk(v) for i, v in enumerate(samples)
    }


def test_fingerprint_keeps_empty_places(spark):
    df = spark.createDataFrame([("hf", "x", None, "t", None, "mit")], "a string,b string,c string,d string,e string,f string")
    got = df.select(text.fingerprint(*[F.col(c) for c in "abcdef"]).alias("r")).first()["r"]
    assert got == hashlib.sha256(b"hf|x||t||mit").hexdigest()


@pytest.mark.parametrize(
    "value,want",
    [
        (["a", "b"], '["a", "b"]'), ([], "[]"), (None, None), (['q"', "é", "a/b", "\t"], '["q\\"", "é", "a/b", "\\t"]'),
        (["a", None], '["a", null]'),
    ],
)
def test_json_lists(spark, value, want):
    assert one(spark, value, text.json_text_list, "array<string>") == want
    if want:
        assert one(spark, want, text.json_parse_list) == value


def test_bad_json_lists(spark):
    for bad in ("", "junk", "[1,", None):
        assert one(spark, bad, text.json_parse_list) is None


@pytest.mark.parametrize(
    "json,want",
    [
        ("12", 12), ('"12"', 12), ("12.2", 12), ("12.5", 12), ("12.7", 13), ("13.5", 14), ('"12.7"', None),
        ("true", 1), ("false", 0), ('"true"', None), ("null", None), ("[1]", None), ("1e3", 1000), ("-3", -3),
        ('"x"', None), ("12345678901234567890123", None),
    ],
)
def test_json_bigint(spark, json, want):
    value = '{"downloads":%s}' % json
    assert one(spark, value, lambda v: values.json_bigint(v, "downloads")) == want


def test_json_bigint_without_value(spark):
    for value in (None, "junk", "{}", "[]"):
        assert one(spark, value, lambda v: values.json_bigint(v, "downloads")) is None


@pytest.mark.parametrize(
    "value,want",
    [
        ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05.250Z", "2024-01-02 03:04:05.250000"),
        ("2024-01-02T03:04:05+02:00", "2024-01-02 01:04:05"), ("2024-01-02T03:04:05", "2024-01-02 03:04:05"),
        ("2024-01-02", "2024-01-02 00:00:00"), ("2024-01-02 03:04", "2024-01-02 03:04:00"),
        ("20240102T030405", "2024-01-02 03:04:05"), ("2024-01-02T03+0130", "2024-01-02 01:30:00"),
        ("20240102", "2024-01-02 00:00:00"), ("2024-01-02T03:04:05,5Z", "2024-01-02 03:04:05.500000"),
        ("2024", None), ("2024-01", None), ("junk", None), ("", None), (None, None), ("2024-13-01", None),
        ("12:00:00", None),
    ],
)
def test_parse_lm(spark, value, want):
    got = one(spark, value, values.parse_lm)
    assert (str(got) if got else None) == want


def test_parse_lm_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert str(one(spark, "2024-01-02T03:04:05", values.parse_lm)) == "2024-01-02 03:04:05"
        assert str(one(spark, "2024-01-02T03:04:05+02:00", values.parse_lm)) == "2024-01-02 01:04:05"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_small_rules(spark):
    iso = lambda v: values.iso_format(v.cast("timestamp_ntz"))
    assert one(spark, "2024-01-02 03:04:05", iso) == "2024-01-02T03:04:05+00:00"
    assert one(spark, "2024-01-02 03:04:05.00012", iso) == "2024-01-02T03:04:05.000120+00:00"
    assert [one(spark, v, values.ns_local_id) for v in ("a/b/c", "abc", "/x", "a/")] == ["b/c", "abc", "x", ""]
    ranks = [one(spark, v, values.size_rank) for v in ("n<1K", "n>100M", "huge", "", None)]
    assert ranks == [0, 6, -1, -1, -1]
    assert one(spark, "1K<n<10K", values.size_label) == "1K–10K rows"
    assert one(spark, "odd", values.size_label) == "odd"
    assert [one(spark, v, values.access_class, "boolean") for v in (True, False, None)] == ["private", "public", "public"]
    budgets = [one(spark, v, lambda c: values.effective_budget(c, 1500), "int") for v in (None, 0, 7, 9000)]
    assert budgets == [1500, 1500, 7, 9000]


@pytest.mark.parametrize(
    "budget,cap,elapsed,want",
    [
        (1500, 50, 12, (50, 1500, False)), (10, None, 12, (200, 10, True)), (None, 0, 12, (200, 0, False)),
        (-5, -5, 12, (200, 0, False)), (12, 3, 12, (3, 12, False)),
    ],
)
def test_budget_flags(spark, budget, cap, elapsed, want):
    df = spark.createDataFrame([(budget, cap, elapsed)], "b int, c int, e int")
    assert tuple(df.select(values.budget_flags(F.col("b"), F.col("c"), F.col("e")).alias("f")).first()["f"]) == want


def test_thin_is_three_valued(spark):
    rows = [(None, None), (49, 1.0), (50, None), (50, 0.34), (50, 0.35)]
    df = spark.createDataFrame(rows, "t int, s double")
    got = [r[0] for r in df.select(values.is_thin(F.col("t"), F.col("s"))).collect()]
    assert got == [True, True, None, True, False]
