"""Keyed tables: pruned writes, one commit for several tables, repeatable appends."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuesheet.sources import sinks
from cuesheet.sources.store import Change, Conflict, Store

DECK = "video_id string, generator_version string, deck_id string, lang string, v2_fingerprint string, slide_count int, status string, error string, user_id string"
SLIDE = "video_id string, generator_version string, slide_id string, position int"


def decks(spark, *names, lang="ko", fingerprint="f"):
    return spark.createDataFrame([(v, "g", f"id-{v}-{lang}", lang, fingerprint, 3, None, None, "u") for v in names], DECK)


def slides(spark, *rows):
    return spark.createDataFrame([(v, "g", s, i) for i, (v, s) in enumerate(rows)], SLIDE)


def files(store):
    return {str(p): p.stat().st_mtime_ns for p in Path(store.root, "data").rglob("*.parquet")}


def test_a_build_shows_all_tables_at_once_and_twice_is_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 8)
    names = [f"v{i}" for i in range(40)]
    first = sinks.save_decks(store, decks(spark, *names), slides(spark, *[(n, f"{n}-old") for n in names]), slides(spark, *[(n, f"{n}-fig") for n in names]))
    assert first == 1
    before = files(store)
    for _ in range(2):
        sinks.save_decks(store, decks(spark, "v1", "new", lang="en"), slides(spark, ("v1", "v1-a"), ("v1", "v1-b")), slides(spark, ("new", "n-fig")))
    got = {r.video_id: (r.deck_id, r.lang, r.status) for r in store.read("decks").collect()}
    assert len(got) == 41 and got["v1"] == ("id-v1-ko", "en", "building") and got["new"][0] == "id-new-en" and got["v2"][1] == "ko"
    on = {(r.deck_id, r.slide_id) for r in store.read("slides").collect()}
    assert {s for d, s in on if d == "id-v1-ko"} == {"v1-a", "v1-b"} and len(on) == 41
    figures = {(r.deck_id, r.slide_id) for r in store.read("figures").collect()}
    assert ("id-new-en", "n-fig") in figures and not [f for f in figures if f[0] == "id-v1-ko"] and len(figures) == 40
    # Old files stay as they are, and most buckets still point at them.
    after = files(store)
    assert all(after[p] == t for p, t in before.items())
    lists = store.record()["tables"]["slides"]["buckets"]
    origin = store.record(1)["tables"]["slides"]["buckets"]
    assert sum(lists[b] == origin[b] for b in origin) >= len(origin) - 2
    # The old version is still readable as a whole until it is vacuumed.
    assert store.record(1)["tables"]["decks"]["buckets"]
    assert store.vacuum(hours=0) > 0 and store.read("slides").count() == 41 and store.versions() == [3]


def test_figures_lose_their_slide_when_only_slides_are_rebuilt(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    sinks.save_decks(store, decks(spark, "a", "b"), slides(spark, ("a", "s1"), ("b", "s2")), slides(spark, ("a", "s1"), ("b", "s2")))
    sinks.save_decks(store, decks(spark, "a"), slides(spark, ("a", "s9")))
    assert {(r.deck_id, r.slide_id) for r in store.read("figures").collect()} == {("id-a-ko", None), ("id-b-ko", "s2")}
    assert {r.slide_id for r in store.read("slides").collect()} == {"s9", "s2"}


def test_new_rows_count_without_fingerprint_and_once_a_key(spark):
    new = decks(spark, "a", lang="en", fingerprint=None).union(decks(spark, "a", lang="fr", fingerprint=None))
    got = sinks.upsert_decks(decks(spark, "a"), new).collect()
    assert [(r.status, r.lang, r.created, r.v2_fingerprint) for r in got] == [("building", "en", False, None)]


def test_unfinished_and_conflicting_writes_stay_unseen(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    rows = spark.range(20)
    store.commit([Change("t", rows, ["id"])])
    store.write_files("t", rows, ["id"])  # a writer that died before its commit
    assert store.read("t").count() == 20
    with pytest.raises(Conflict):
        store.commit([Change("t", rows, ["id"])], since=0)
    assert store.read("t").count() == 20 and store.vacuum() == 0 and store.vacuum(hours=0) == 1
    with pytest.raises(KeyError):
        store.read("other")
    assert Store(spark, store.root, 99).buckets == 4


SEGMENT = "video_id string, from_sec double, to_sec double, ord long"


def test_appends_are_repeatable(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    first = spark.createDataFrame([("v", 0.1 + 0.2, 1.0, 0), ("v", 0.3, 1.0, 1), ("v", 1.0, 2.0, 2), ("v", None, 2.0, 3)], SEGMENT)
    second = spark.createDataFrame([("v", 1.0000000001, 2.0, 9), ("w", 1.0, 2.0, 5), ("v", None, 2.0, 7)], SEGMENT)
    versions = [sinks.append_unseen(store, "s", rows, sinks.SEGMENT_KEY, ("src", batch)) for rows, batch in ((first, 1), (first, 1), (first, "again"), (second, 2), (second, 2))]
    # One committed batch named twice is one version; under another name its rows are found.
    assert versions == [1, 1, 2, 3, 3]
    got = sorted((r.video_id, r.ord) for r in store.read("s").collect())
    assert got == [("v", 0), ("v", 2), ("v", 3), ("w", 5)]
    store.compact("s")
    assert store.read("s").count() == 4


def test_key_filter_passes_all_keys_and_few_others(spark):
    df = spark.range(20_000).withColumn("t", F.col("id") * 7)
    keys = df.where("id % 100 = 0")
    passed = df.where(sinks.key_filter(keys, ["id", "t"]))
    assert passed.where("id % 100 = 0").count() == 200 and passed.count() < 1_000
    assert df.where(sinks.key_filter(keys.limit(0), ["id", "t"])).isEmpty()
    assert spark.createDataFrame([(None, 1)], "id long, t long").where(sinks.key_filter(spark.createDataFrame([(None, 1)], "id long, t long"), ["id", "t"])).count() == 1


def test_compaction_rewrites_long_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 8)
    for batch in range(3):
        store.commit([Change("t", spark.range(batch * 3, batch * 3 + 2), ["id"])], ("b", batch))
    lists = store.record()["tables"]["t"]["buckets"]
    long = [int(b) for b, f in lists.items() if len(f) > 1]
    assert sorted(store.compact("t")) == sorted(long)
    after = json.loads(json.dumps(store.record()))["tables"]["t"]["buckets"]
    assert all(len(f) == 1 for f in after.values()) and all(after[b] == f for b, f in lists.items() if len(f) == 1)
    assert store.read("t").count() == 6


def test_rows_are_written_where_they_lie(spark, tmp_path):
    # Without a shuffle each of four tasks writes its own file of every bucket.
    store = Store(spark, str(tmp_path / "s"), 2)
    folder, buckets = store.write_files("t", spark.range(0, 1000, 1, 4), ["id"])
    assert sorted(buckets) == ["0", "1"]
    for b in buckets:
        assert len(list((tmp_path / "s" / "data" / "t" / folder / f"_bucket={b}").glob("part-*.parquet"))) == 4
