import json
import random
from datetime import timedelta

from catalog_rows import NOW

from shelfmark.operators import resolve as ops
from shelfmark.plans import resolve as plan
from pyspark.sql import functions as F


def kind_of(value):
    for kind, name in ((type(None), "null"), (bool, "bool"), (int, "int64"), (float, "float64"), (str, "string"), (list, "array"), (dict, "struct")):
        if isinstance(value, kind):
            return name


def fields_of(rows):
    """The inference rule in plain Python, written from its description."""
    seen = {}
    for text in rows:
        try:
            row = json.loads(text)
        except ValueError:
            continue
        if isinstance(row, dict) and "row" in row:
            row = row["row"]
        if not isinstance(row, dict):
            continue
        for name, value in row.items():
            field = seen.setdefault(name, [name, kind_of(value), False, []])
            field[2] = field[2] or value is None
            if len(field[3]) < 3:
                field[3].append(value)
    return [tuple(f) for f in seen.values()]


def rows_frame(spark, data):
    flat = [(d, i, r) for d, rows in data.items() for i, r in enumerate(rows)]
    return spark.createDataFrame(flat, "dataset_id string, row_idx long, row_json string").repartition(5)


def inferred(spark, data, **kw):
    got = {}
    for r in ops.infer_schema(rows_frame(spark, data), **kw).orderBy("dataset_id", "pos").collect():
        values = [json.loads(e) for e in r["examples"]]
        got.setdefault(r["dataset_id"], []).append((r["name"], r["dtype"], r["nullable"], values))
    return got


EDGES = {
    "wrapped": ['{"row":{"b":1,"a":"x"},"row_idx":0}', '{"row":[1]}', '{"row":null}', '{"b":null,"c":true}'],
    "odd": ["[1]", "7", "null", '"text"', "junk", '{"k":"null"}'],
    "first_null": ['{"a":null}', '{"a":1}', '{"a":2.5}', '{"a":"z"}'],
    "numbers": ['{"a":1.0,"b":100000.0,"c":9223372036854775807,"d":12345678901234567890,"e":0.5,"f":-3}'],
    "nested": ['{"o":{"x":null},"l":[null,1],"e":{},"s":""}', '{"o":null}'],
    "unicode": ['{"größe":"é","a b":1,"q\\"":2}'],
}


def test_edges(spark):
    want = {d: fields_of(rows) for d, rows in EDGES.items()}
    assert inferred(spark, EDGES) == {d: f for d, f in want.items() if f}
    # A whole float keeps its kind in the example text.
    texts = ops.infer_schema(rows_frame(spark, {"n": ['{"a":1.0}']})).first()
    assert texts["examples"] == ["1.0"] and texts["dtype"] == "float64"


def test_random_rows_with_one_hot_dataset(spark):
    rng = random.Random(11)
    pool = [None, True, False, 3, -4, 2.5, 7.0, "s", "", [], [1], {"z": 1}]
    def row():
        body = {n: rng.choice(pool) for n in rng.sample("abcdefg", rng.randint(0, 5))}
        return json.dumps({"row": body} if rng.random() < 0.3 else body)
    data = {f"d{i}": [row() for _ in range(rng.randint(1, 30))] for i in range(12)}
    data["hot"] = [row() for _ in range(800)]
    want = {d: f for d, f in ((d, fields_of(rows)) for d, rows in data.items()) if f}
    assert inferred(spark, data) == want
    capped = {d: f for d, f in ((d, fields_of(rows[:5])) for d, rows in data.items()) if f}
    assert inferred(spark, data, row_cap=5) == capped


def test_row_cap_counts_rows_not_numbers(spark):
    rows = [("d", 7, '{"a":1}'), ("d", 1_000_007, '{"a":null,"b":2}'), ("d", 1_000_007, '{"c":3}'), ("d", 2_000_000, '{"z":0}')]
    df = spark.createDataFrame(rows, "dataset_id string, row_idx long, row_json string")
    got = [(r["name"], r["dtype"], r["nullable"]) for r in ops.infer_schema(df, 2).orderBy("pos").collect()]
    assert got == [("a", "int64", True), ("b", "int64", False)]
    assert [r["name"] for r in ops.infer_schema(df, 4).orderBy("pos").collect()] == ["a", "b", "c", "z"]


def info_of(spark, records):
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "j string")
    return df.select(F.from_json("j", ops.INFO).alias("i")).select("i.*")


def test_features_from_info(spark):
    feats = [{"name": "t", "dtype": "string"}]
    records = [
        {"dataset_id": "a", "splits": [{"config": "c0", "split": "train", "features": []}, {"config": "c1", "features": feats}]},
        {"dataset_id": "b", "splits": [{"config": "c0", "split": "s0"}], "features": feats, "default_split": "test"},
        {"dataset_id": "c", "splits": [], "default_config": "d"},
        {"dataset_id": "d", "splits": [{"features": {}}, {"split": "x", "features": {"z": 1, "a": 2}}]},
    ]
    got = {r["dataset_id"]: (r["features"], r["config"], r["split"]) for r in ops.features_from_info(info_of(spark, records)).collect()}
    assert json.loads(got["a"][0]) == feats and got["a"][1:] == ("c1", "train")
    assert json.loads(got["b"][0]) == feats and got["b"][1:] == ("c0", "test")
    assert got["c"] == (None, "d", None)
    assert got["d"] == ('{"z":1,"a":2}', None, "x")


def cards_of(spark, cards):
    return spark.createDataFrame(list(cards.items()), "dataset_id string, card_json string")


def test_features_from_card(spark):
    cards = {
        "map": '{"dataset_info":{"features":{"b":{"dtype":"int64"},"a":"string","n":{"x":1}}}}',
        "list": '{"dataset_info":{"features":[{"name":"z"}]}}', "none": "{}", "text": '{"dataset_info":{"features":"x"}}',
    }
    got = {r["dataset_id"]: r["features"] for r in ops.features_from_card(cards_of(spark, cards)).collect()}
    assert json.loads(got["map"]) == [{"name": "b", "dtype": "int64"}, {"name": "a", "dtype": "string"}, {"name": "n", "dtype": None}]
    assert json.loads(got["list"]) == [{"name": "z"}] and got["none"] is None and got["text"] is None


def test_cascade(spark, make):
    feats = [{"name": "t", "dtype": "string"}]
    split = {"config": "c", "split": "s"}
    info = info_of(spark, [
        {"dataset_id": "declared", "splits": [{**split, "features": feats}]}, {"dataset_id": "sampled", "splits": [split]},
        {"dataset_id": "carded", "splits": [split]}, {"dataset_id": "nosplit", "splits": [{"config": "c"}]},
    ])
    rows = rows_frame(spark, {"sampled": ['{"a":1}', '{"a":null,"b":"x"}', '{"c":1}'], "nosplit": ['{"a":1}'], "unknown": ['{"a":1}']})
    cards = cards_of(spark, {"carded": '{"dataset_info":{"features":{"k":"int64"}}}', "nosplit": '{"dataset_info":{"features":[]}}'})
    jobs = make("jobs", [
        dict(id="1", dataset_id="declared", kind="schema", budget_ms=10, row_cap=50), dict(id="2", dataset_id="sampled", kind="schema", row_cap=2),
        dict(id="3", dataset_id="sampled", kind="schema", row_cap=1), dict(id="4", dataset_id="carded", kind="schema"),
        dict(id="5", dataset_id="nosplit", kind="schema"), dict(id="6", dataset_id="unknown", kind="snips"),
    ]).withColumn("elapsed_ms", F.lit(12))
    got = {r["job_id"]: json.loads(r["payload"]) for r in plan.resolve_schemas(jobs, info, rows, cards).collect()}
    assert got["1"] == {
        "dataset_id": "declared", "kind": "schema", "row_cap_applied": 50, "fetched_ms": 12, "budget_ms_requested": 10,
        "budget_exhausted": True, "source": "hf_connector", "schema": feats, "config": "c", "split": "s",
    }
    assert got["2"]["schema"] == [
        {"name": "a", "dtype": "int64", "nullable": True, "examples": [1, None]},
        {"name": "b", "dtype": "string", "nullable": False, "examples": ["x"]},
    ]
    assert got["3"]["schema"] == [{"name": "a", "dtype": "int64", "nullable": False, "examples": [1]}]
    assert got["4"]["schema"] == [{"name": "k", "dtype": "int64"}] and got["4"]["row_cap_applied"] == 200
    for job in ("5", "6"):
        assert got[job]["schema"] == [] and got[job]["note"] == "schema_not_available" and "config" not in got[job]


def test_error_classes(spark):
    rows = [("timeout", None, "timeout"), ("http_status", 429, "rate_limited"), ("http_status", 500, "network"), ("http_status", 599, "network"),
            ("http_status", 600, "unknown"), ("http_status", 404, "unknown"), ("http_status", None, "unknown"), ("connection", None, "network"),
            ("value", None, "parse_error"), (None, 500, "unknown")]
    df = spark.createDataFrame(rows, "kind string, status int, want string")
    for r in df.withColumn("got", ops.classify_error(F.col("kind"), F.col("status"))).collect():
        assert r["got"] == r["want"]


def test_outcomes(spark, make):
    jobs = make("jobs", [
        dict(id="ok", dataset_id="d", kind="schema", state="running", attempts=1, enqueued_at=NOW, started_at=NOW + timedelta(1), error_class="old"),
        dict(id="okq", dataset_id="e", kind="schema", state="running", attempts=0, enqueued_at=NOW),
        dict(id="bad", dataset_id="f", kind="snips", state="running", attempts=1), dict(id="rest", state="queued", attempts=0),
    ])
    out = spark.createDataFrame(
        [("ok", True, "{}", None, None), ("okq", True, "{1}", None, None), ("bad", False, None, "network", "x" * 3000)],
        "job_id string, ok boolean, payload string, error_class string, error_detail string",
    )
    updated, artifacts, events = ops.apply_outcomes(jobs, out, NOW)
    rows = {r["id"]: r for r in updated.collect()}
    assert (rows["ok"]["state"], rows["ok"]["attempts"], rows["ok"]["error_class"], rows["ok"]["finished_at"]) == ("done", 1, "old", NOW)
    assert (rows["bad"]["state"], rows["bad"]["attempts"], len(rows["bad"]["error_detail"])) == ("error", 2, 2000)
    assert rows["rest"]["state"] == "queued" and rows["rest"]["finished_at"] is None
    made = {r["dataset_id"]: r for r in artifacts.collect()}
    assert made["d"]["created_at"] == NOW + timedelta(1) and made["e"]["created_at"] == NOW and made["d"]["stale"] is False
    logged = {json.loads(r["payload"])["job_id"]: (r["type"], json.loads(r["payload"])) for r in events.collect()}
    assert logged["ok"][0] == "dataset.resolved_ok" and len(logged["bad"][1]["error_detail"]) == 500 and len(logged) == 3
