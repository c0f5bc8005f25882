import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from catalog_rows import NOW
from pyspark.sql import functions as F

from shelfmark.plans import tables
from shelfmark.schemas import DATASETS, EVENTS, SIGNALS
from shelfmark.session import materialize, shared_dir
from shelfmark.sources import catalog as catalog_source
from shelfmark.sources import logs, snapshots
from shelfmark.sources.conform import conform
from shelfmark.streaming import streams
from shelfmark.operators import upsert

CATALOG = {
    "datasets": [
        {"id": "lab/tides", "title": "Tide tables", "readme_text": "one two three", "tags": ["t"],
         "quality_signals": {"likes": 2, "downloads": 7}, "extra": 1},
        {"id": "tiny", "source": "web", "ns_local_id": "t", "access_class": "private"},
    ],
    "artifacts": [{"dataset_id": "lab/tides", "kind": "schema", "payload": {"schema": [{"name": "h", "dtype": "float64"}]}}],
}


def test_load_catalog(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(CATALOG, indent=2))
    datasets, artifacts = catalog_source.load_catalog(spark, str(path), NOW)
    rows = {r["id"]: r for r in datasets.collect()}
    assert datasets.schema.names == DATASETS.names
    tides, tiny = rows["lab/tides"], rows["tiny"]
    assert (tides["source"], tides["ns_local_id"], tides["access_class"]) == ("hf", "lab/tides", "public")
    assert (tides["fingerprint"], tides["readme_tokens"], tides["indexed_at"]) == ("fixture:lab/tides", 3, NOW)
    assert tides["readme_score"] == pytest.approx(0.06) and json.loads(tides["quality_signals"]) == {"likes": 2, "downloads": 7}
    assert (tiny["source"], tiny["ns_local_id"], tiny["access_class"], tiny["readme_tokens"]) == ("web", "t", "private", 0)
    stored = artifacts.first()
    assert json.loads(stored["payload"])["schema"][0]["name"] == "h" and stored["stale"] is False


def test_conform(spark):
    df = spark.createDataFrame([("7", 1, "x")], "attempts string, id int, extra string")
    row = conform(df, DATASETS).first()
    assert row["id"] == "1" and row["title"] is None and len(row) == len(DATASETS)


def test_event_defaults(spark):
    new = spark.createDataFrame([("e1", "t", "d", None, 5, None), (None, None, None, NOW, None, "é"), (None, None, None, None, None, None)],
                                "id string, type string, dataset_id string, created_at timestamp_ntz, n int, s string")
    rows = logs.append_events(spark.createDataFrame([], EVENTS), new, datetime(2024, 1, 1)).collect()
    by_payload = {r["payload"]: r for r in rows}
    assert by_payload['{"n":5,"s":null}']["created_at"] == datetime(2024, 1, 1)
    assert by_payload['{"n":null,"s":"é"}']["type"] == "unknown" and by_payload['{"n":null,"s":"é"}']["created_at"] == NOW
    assert len({r["id"] for r in rows}) == 3 and all(r["id"] for r in rows)


def test_signals_keep_ids_unique(spark):
    old = conform(spark.createDataFrame([("a",)], "id string"), SIGNALS)
    new = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x"), (None, "x"), (None, "x")], "id string, event string")
    rows = logs.append_signals(old, new, NOW).collect()
    assert len(rows) == 4 and len({r["id"] for r in rows}) == 4 and sum(r["id"] == "a" for r in rows) == 1


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    df = conform(spark.createDataFrame([("a",)], "id string"), DATASETS)
    assert snapshots.read_snapshot(spark, path, DATASETS).count() == 0
    snapshots.write_snapshot(df, path)
    merged = upsert.upsert_datasets(snapshots.read_snapshot(spark, path, DATASETS), conform(spark.createDataFrame([("b",)], "id string"), DATASETS))
    assert snapshots.write_snapshot(merged, path).endswith("v00000002")
    assert snapshots.read_snapshot(spark, path, DATASETS).count() == 2
    assert snapshots.read_snapshot(spark, path, DATASETS, version=1).count() == 1
    (tmp_path / "t" / "v00000003").mkdir()  # a write that never finished
    assert snapshots.latest_version(spark, path) == 2 and snapshots.latest_version(spark, path, below=2) == 1
    snapshots.write_snapshot(df, path, version=2)  # already complete: kept
    assert snapshots.read_snapshot(spark, path, DATASETS).count() == 2


def test_materialize_uses_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_dir(spark, "x")
    assert path.startswith(base or spark.conf.get("spark.checkpoint.dir"))
    df = materialize(spark.range(10).withColumn("s", F.lit("é")), "x")
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_release_deletes_what_was_materialized(spark, tmp_path, monkeypatch):
    from shelfmark import session

    monkeypatch.setattr(session, "_MATERIALIZED", [])
    path = materialize(spark.range(3), "gone").inputFiles()[0].split("/part-")[0].removeprefix("file:")
    assert len(session._MATERIALIZED) == 1 and list(Path(path).iterdir())
    session.release()
    assert not Path(path).exists() and not session._MATERIALIZED


def files(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_stream_signals_keeps_late_rows_and_equals_the_batch(spark, tmp_path):
    def signal(rows):
        return conform(spark.createDataFrame(rows, "id string, dataset_id string, created_at timestamp_ntz"), SIGNALS)

    folder, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    day = datetime(2024, 1, 1)
    files(signal([("a", "d", day), ("a", "d", day), ("b", "d", day)]), folder)
    streams.stream_signals(streams.read_folder(spark, folder), out, ckpt, NOW).awaitTermination()
    files(signal([("a", "d", day + timedelta(hours=1)), ("c", "d", day + timedelta(days=9))]), folder)
    streams.stream_signals(streams.read_folder(spark, folder), out, ckpt, NOW).awaitTermination()
    files(signal([("late", "d", day), ("a", "d", day + timedelta(days=9))]), folder)
    streams.stream_signals(streams.read_folder(spark, folder), out, ckpt, NOW).awaitTermination()
    once = logs.append_signals(spark.createDataFrame([], SIGNALS), spark.read.parquet(folder), NOW)
    got = sorted(r["id"] for r in streams.read_log(spark, out, SIGNALS).collect())
    assert got == sorted(r["id"] for r in once.collect()) == ["a", "b", "c", "late"]
    # With a lost checkpoint everything is read again, and nothing is logged twice.
    streams.stream_signals(streams.read_folder(spark, folder, 1), out, ckpt + "2", NOW).awaitTermination()
    assert sorted(r["id"] for r in streams.read_log(spark, out, SIGNALS).collect()) == got


def test_stream_popularity_emits_closed_windows_once(spark, tmp_path):
    folder, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    day = datetime(2024, 1, 10)
    def rows(*items):
        return spark.createDataFrame(list(items), "dataset_id string, created_at timestamp_ntz")

    files(rows(("d", day), ("d", day + timedelta(hours=5)), ("e", day)), folder)
    streams.stream_popularity(streams.read_folder(spark, folder), out, ckpt).awaitTermination()
    files(rows(("d", day + timedelta(days=3))), folder)
    streams.stream_popularity(streams.read_folder(spark, folder), out, ckpt).awaitTermination()
    got = {(r["window_end"], r["dataset_id"]): r["sig_score"] for r in spark.read.parquet(out).collect()}
    assert got == {(day + timedelta(days=n), d): c for n in (1, 2) for d, c in (("d", 2), ("e", 1))}


def test_stream_upsert_equals_batch_and_survives_a_rerun(spark, catalog, tmp_path):
    datasets, artifacts = catalog
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    def batch(pos, *rows):
        df = spark.createDataFrame([(pos + i, *r) for i, r in enumerate(rows)], "batch_pos long, id string, fingerprint string")
        return conform(df, DATASETS).drop("fingerprint").join(df, "id").select(*DATASETS.names, "batch_pos")

    first = batch(0, ("lab/river-levels", "new"), ("x", "1"))
    second = batch(2, ("x", "2"),)
    snapshots.write_snapshot(datasets, f"{state}/datasets")
    snapshots.write_snapshot(artifacts, f"{state}/artifacts")
    files(first, folder)
    streams.stream_upsert_datasets(streams.read_folder(spark, folder), state, str(tmp_path / "c1"), NOW).awaitTermination()
    files(second, folder)
    streams.stream_upsert_datasets(streams.read_folder(spark, folder), state, str(tmp_path / "c1"), NOW).awaitTermination()
    want = upsert.upsert_datasets(upsert.upsert_datasets(datasets, first), second)
    got = streams.current(spark, state, "datasets")
    assert sorted(got.select("id", "fingerprint").collect(), key=str) == sorted(want.select("id", "fingerprint").collect(), key=str)
    stale = streams.current(spark, state, "artifacts").filter("stale").select("dataset_id", "kind").collect()
    assert {tuple(r) for r in stale} == {("lab/river-levels", "schema"), ("lab/river-levels", "snips")}
    log = streams.read_log(spark, f"{state}/events", EVENTS).collect()
    assert sorted((r["type"], r["dataset_id"]) for r in log) == [
        ("dataset.changed", "lab/river-levels"), ("dataset.changed", "x"), ("dataset.discovered", "x"),
    ]
    # The same batches again, as after a lost checkpoint: their versions are complete.
    streams.stream_upsert_datasets(streams.read_folder(spark, folder, 1), state, str(tmp_path / "c2"), NOW).awaitTermination()
    assert sorted(streams.current(spark, state, "datasets").select("id", "fingerprint").collect(), key=str) == sorted(
        got.select("id", "fingerprint").collect(), key=str)
    assert streams.read_log(spark, f"{state}/events", EVENTS).count() == 3
    # Folding the deltas into a snapshot changes nothing either.
    snapshots.compact(spark, f"{state}/datasets", DATASETS, ["id"])
    assert snapshots.latest_version(spark, f"{state}/datasets") == 3
    assert streams.current(spark, state, "datasets").count() == got.count() == 5


def test_stream_job_state_keeps_the_latest(spark, tmp_path):
    folder, state, ckpt = (str(tmp_path / n) for n in ("in", "state", "ckpt"))
    t = datetime(2024, 1, 1)
    def records(*rows):
        return spark.createDataFrame(list(rows), streams.JOB_STATE)

    files(records(("j", "queued", t, 1), ("j", "running", t, 2), ("k", "done", t, 3)), folder)
    streams.stream_job_state(streams.read_folder(spark, folder), state, ckpt).awaitTermination()
    files(records(("j", "done", t - timedelta(1), 9), ("k", "error", t + timedelta(1), 4)), folder)
    streams.stream_job_state(streams.read_folder(spark, folder), state, ckpt).awaitTermination()
    got = {r["id"]: r["state"] for r in streams.current_job_state(spark, state).collect()}
    assert got == {"j": "running", "k": "error"}


@pytest.mark.parametrize("batches", [1, 7])
def test_job_state_is_folded_and_reading_stays_bounded(spark, tmp_path, batches):
    folder, state, ckpt = (str(tmp_path / n) for n in ("in", "state", "ckpt"))
    start = datetime(2024, 1, 1)
    last = {}
    for n in range(batches):
        rows = [(f"j{i}", f"s{n}", start + timedelta(hours=(n * 5 + i) % 7), n * 10 + i) for i in range(n, n + 4)]
        for job, now, at, seq in rows:
            last[job] = max(last.get(job, (start - timedelta(1),)), (at, seq, now))
        files(spark.createDataFrame(rows, streams.JOB_STATE), folder)
        source = streams.read_folder(spark, folder, 1)
        streams.stream_job_state(source, state, ckpt, compact_every=2).awaitTermination()
        kept = [p.name for p in Path(state).iterdir()]
        assert sum(k.startswith("v") for k in kept) <= 2 and sum(k.startswith("d") for k in kept) <= 4
    got = {r["id"]: (r["at"], r["seq"], r["state"]) for r in streams.current_job_state(spark, state).collect()}
    assert got == last


def test_a_broken_fold_leaves_the_state_before_it(spark, tmp_path):
    state = str(tmp_path / "state")
    t = datetime(2024, 1, 1)
    snapshots.write_delta(spark.createDataFrame([("j", "queued", t, 1)], streams.JOB_STATE), state, 1)
    snapshots.write_delta(spark.createDataFrame([("j", "done", t, 2)], streams.JOB_STATE), state, 2)
    whole = Path(snapshots.write_snapshot(streams.current_job_state(spark, state), state, 2))
    (whole / "_SUCCESS").unlink()
    next(whole.glob("*.parquet")).unlink()
    assert [r["state"] for r in streams.current_job_state(spark, state).collect()] == ["done"]
    snapshots.write_snapshot(streams.current_job_state(spark, state), state, 2)
    snapshots.drop_folded(spark, state)
    assert snapshots.latest_version(spark, state) == 2
    assert [r["state"] for r in streams.current_job_state(spark, state).collect()] == ["done"]


def test_derived_texts_are_stored_where_they_are_read(spark, tmp_path, monkeypatch):
    rows = [(i, f"title {i}\nmore words", "en", "web", 20) for i in range(30)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    made.repartition(12).write.parquet(str(tmp_path / "documents.parquet"))
    plans, write = [], tables.snapshots.write_snapshot

    def seen(df, path, **how):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, path, **how)

    monkeypatch.setattr(tables.snapshots, "write_snapshot", seen)
    assert tables.docs(spark, str(tmp_path)).count() == 30
    assert len(plans) == 2 and not [p for p in plans if "rangepartitioning" in p or "Sort" in p]
