"""Discovery runs and updates of the stored index against full rebuilds."""

from datetime import datetime

import pytest
from catalog_rows import NOW
from pyspark.sql import functions as F

from shelfmark.operators import search as search_ops
from shelfmark.operators import upsert
from shelfmark.plans import ingest as plan
from shelfmark.schemas import CONNECTORS, LISTING
from shelfmark.sources import stored_index


def listing_of(spark, rows):
    df = spark.createDataFrame([(i, lm, [t]) for i, lm, t in rows], "id string, last_modified string, tags array<string>")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in LISTING if f.name not in df.columns]
    return df.select("*", *empty)


LISTED = [("n/1", "2024-01-01T00:00:00Z", "river"), ("lab/bird-calls", "2024-01-02T00:00:00Z", "owl"),
          ("n/2", "2024-01-02T00:00:00Z", "sea"), ("n/1", "2024-01-03T00:00:00Z", "lake"), ("bad", "no time", "x")]


@pytest.fixture()
def now(spark, catalog):
    datasets, artifacts = catalog
    return plan.Catalog(
        datasets, artifacts, spark.createDataFrame([], CONNECTORS), search_ops.build_search_docs(datasets)
    )


@pytest.mark.parametrize("limit", [None, 1, 2])
def test_runs_end_in_the_same_catalog_as_a_rebuild(spark, now, limit):
    listing, touched = listing_of(spark, LISTED), set()
    for _ in range(5):
        run = plan.discover(now, listing, NOW, limit)
        now, ids = run.catalog, {r["id"] for r in run.ids.collect()}
        if not ids:
            break
        touched |= ids
    assert touched == {"n/1", "n/2", "lab/bird-calls"}
    rebuilt = search_ops.build_search_docs(now.datasets)
    assert sorted(map(tuple, now.docs.collect())) == sorted(map(tuple, rebuilt.collect()))
    assert now.datasets.count() == 6
    assert {r["id"]: r["tags"] for r in now.datasets.collect()}["n/1"] == ["lake"]
    stale = {r["dataset_id"] for r in now.artifacts.filter("stale").collect()}
    assert "lab/bird-calls" not in stale  # it had no fingerprint, so it counts as discovered
    seen = now.connectors.select("source", "cursor.max_seen.*").first()
    assert (seen["source"], seen["lm"], seen["id"]) == ("hf", datetime(2024, 1, 3), "n/1")


def effective(index):
    postings = sorted(tuple(r) for r in index.postings.select("term", "dataset_id", "tf", "dl").collect())
    terms = sorted(tuple(r) for r in index.terms.select("term", "df").collect())
    return postings, terms, tuple(index.corpus.first())


def test_index_updates_equal_a_rebuild(spark, tmp_path):
    def docs(*rows):
        return spark.createDataFrame(list(rows), "dataset_id string, content string")

    path = str(tmp_path / "index")
    one = docs(("a", "x y x"), ("b", "y z"), ("c", "q"))
    stored_index.write_inverted_index(one, path, 4)
    for _ in range(2):  # an update that is run again changes nothing
        stored_index.update_inverted_index(docs(("b", "y z"), ("c", "q")), docs(("b", "x w"), ("d", "z z z")), path, 1, 4)
    want = docs(("a", "x y x"), ("b", "x w"), ("d", "z z z"))
    assert effective(stored_index.read_inverted_index(spark, path, 4)) == effective(search_ops.build_inverted_index(want))
    stored_index.update_inverted_index(docs(("b", "x w")), docs(("b", "")), path, 2, 4)
    want = docs(("a", "x y x"), ("b", ""), ("d", "z z z"))
    index = stored_index.read_inverted_index(spark, path, 4)
    assert effective(index) == effective(search_ops.build_inverted_index(want))
    assert [r["dataset_id"] for r in search_ops.postings_of(index, ["x"]).collect()] == ["a"]


@pytest.fixture()
def small_index(spark, tmp_path):
    """An index of four documents, and a function that updates it and says what it should hold."""
    path, held = str(tmp_path / "index"), {f"d{i}": f"w{i} common" for i in range(4)}

    def docs(some):
        return spark.createDataFrame(list(some.items()), "dataset_id string, content string")

    def update(version, changed):
        before = {k: v for k, v in held.items() if k in changed}
        after = {k: v for k, v in changed.items() if v is not None}
        stored_index.update_inverted_index(docs(before), docs(after), path, version, 2, fanout=2)
        for k in changed:
            held.pop(k, None)
        held.update(after)

    stored_index.write_inverted_index(docs(held), path, 2)
    return path, held, docs, update


def test_many_updates_leave_few_segments_and_equal_a_rebuild(spark, small_index):
    path, held, docs, update = small_index
    for version in range(1, 6):
        update(version, {f"d{version % 4}": f"w{version} again common", f"n{version}": "new", f"n{version - 3}": None})
    found = stored_index.segments(spark, path)
    assert [s.version for s in found] == [0, 4, 5] and [s.level for s in found[1:]] == [2, 0]
    index = stored_index.read_inverted_index(spark, path, 2)
    assert effective(index) == effective(search_ops.build_inverted_index(docs(held)))


@pytest.mark.parametrize("breaks", ["terms", "masks", "_commit"])
def test_readers_see_no_broken_update_and_it_can_be_run_again(spark, small_index, monkeypatch, breaks):
    path, held, docs, update = small_index
    want = effective(search_ops.build_inverted_index(docs(held)))
    write, commit = stored_index._write, stored_index._commit

    def broken(rows, path, kind, segment):
        if kind == breaks:
            raise RuntimeError("lost")
        return write(rows, path, kind, segment)

    monkeypatch.setattr(stored_index, "_write", broken)
    if breaks == "_commit":
        monkeypatch.setattr(stored_index, "_commit", lambda *a: broken(None, None, breaks, None))
    with pytest.raises(RuntimeError):
        update(1, {"d0": "other words"})
    monkeypatch.setattr(stored_index, "_write", write)
    monkeypatch.setattr(stored_index, "_commit", commit)
    assert effective(stored_index.read_inverted_index(spark, path, 2)) == want
    for _ in range(2):  # an update that is committed changes nothing
        update(1, {"d0": "other words"})
    assert effective(stored_index.read_inverted_index(spark, path, 2)) == effective(
        search_ops.build_inverted_index(docs(held))
    )


def test_a_merge_that_breaks_off_changes_nothing(spark, small_index, monkeypatch):
    path, held, docs, update = small_index
    monkeypatch.setattr(stored_index, "compact_index", lambda *a: None)
    for version in (1, 2):
        update(version, {"d1": f"version {version}", "d2": None})
    monkeypatch.undo()
    write = stored_index._write
    monkeypatch.setattr(stored_index, "_write", lambda rows, path, kind, s: 1 / 0 if kind == "masks" else write(rows, path, kind, s))
    want = effective(search_ops.build_inverted_index(docs(held)))
    with pytest.raises(ZeroDivisionError):
        stored_index.compact_index(spark, path, 2)
    assert len(stored_index.segments(spark, path)) == 3
    assert effective(stored_index.read_inverted_index(spark, path, 2)) == want
    monkeypatch.undo()
    stored_index.compact_index(spark, path, 2)
    assert len(stored_index.segments(spark, path)) == 2
    assert effective(stored_index.read_inverted_index(spark, path, 2)) == want


def test_a_backfill_takes_its_window_only(spark, now):
    listing = listing_of(spark, [("n/1", "2024-02-28T00:00:00Z", "a"), ("n/2", "2024-02-20T00:00:00Z", "b")])
    run = plan.discover(now, listing, NOW, window_days=3)
    assert [r["id"] for r in run.ids.collect()] == ["n/1"]
    assert run.catalog.connectors.select("cursor.max_seen.id").first()["id"] == "n/1"
    with pytest.raises(ValueError):
        plan.discover(now, listing, NOW, window_days=2)


def test_a_small_batch_does_not_move_the_stored_rows(spark, tmp_path):
    rows = spark.range(200_000).select(F.concat(F.lit("ds/"), F.col("id")).alias("id"), F.md5(F.col("id").cast("string")).alias("fingerprint"))
    rows.write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    batch = spark.createDataFrame([("ds/5", "new"), ("ds/x", "f"), ("ds/6", None)], "id string, fingerprint string")
    cut = upsert.cut_to(stored, batch.select("id"))
    plan_text = cut._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan_text and "hashpartitioning" not in plan_text
    events = {r["dataset_id"]: r["type"] for r in upsert.detect_changes(stored, batch, NOW).collect()}
    assert events == {"ds/5": "dataset.changed", "ds/x": "dataset.discovered", "ds/6": "dataset.changed"}
    assert {r["id"] for r in upsert.changed_ids(stored, batch).collect()} == {"ds/5", "ds/6"}


def test_parts_of_an_index_follow_its_size(spark, tmp_path, monkeypatch):
    """No task sorts more than its part, and no bucket's postings lie in one task only."""
    docs = spark.range(4_000).select(
        F.concat(F.lit("d"), F.col("id")).alias("dataset_id"),
        F.concat(F.lit("common word "), F.col("id"), F.lit(" "), F.md5(F.col("id").cast("string"))).alias("content"),
    )
    monkeypatch.setattr(stored_index, "PART_ROWS", 1_000)
    sizes = {}
    for share in (0, 1):
        path = str(tmp_path / f"index{share}")
        stored_index.write_inverted_index(docs.limit(1_000) if share == 0 else docs, path, 2)
        files = spark.read.parquet(f"{path}/postings").groupBy(F.col("_metadata.file_path")).count().collect()
        sizes[share] = [r["count"] for r in files]
    assert len(sizes[1]) >= 3 * len(sizes[0]) and max(sizes[1]) < 2_500
    index = stored_index.read_inverted_index(spark, path, 2)
    assert effective(index) == effective(search_ops.build_inverted_index(docs))
    for term in range(2):
        stored_index.update_inverted_index(docs.limit(0), docs.limit(0), path, term + 1, 2, fanout=2)
    assert effective(stored_index.read_inverted_index(spark, path, 2)) == effective(search_ops.build_inverted_index(docs))
