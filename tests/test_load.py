import uuid

import pytest
import ringing
from pyspark.sql import functions as F

from docweave.functions.keys import NAMESPACE
from docweave.plans.mapping import MappingError, parse_mapping
from docweave.sources.collections import Collections
from docweave.sources.store import PublishConflict, Store
from docweave.streaming.load import LoadError, load, stream_load


def key(oid, ns=NAMESPACE):
    return str(uuid.uuid5(uuid.UUID(ns), oid))


def test_station_end_to_end(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), ringing.catalog())
    summary = load(ringing.mapping(), ringing.collections(spark), store, "truncate")
    assert {t: summary.total(t) for t in ("species", "ringers", "nets", "sessions", "session_catches", "session_nets")} == {"species": 3, "ringers": 2, "nets": 2, "sessions": 2, "session_catches": 3, "session_nets": 3}
    dawn = key(ringing.DAWN)
    caught = {(r.session_id, r.species_id, r.ring, r.wing, str(r.grams)) for r in store.read("session_catches").collect()}
    assert caught == {(dawn, key(ringing.WREN), "A001", 48, "9.25"), (dawn, key(ringing.TIT), "A002", None, "11.00"), (dawn, key(ringing.WREN), "A003", 50, "8.90")}
    assert sorted(r.id for r in store.read("session_catches").collect()) == [1, 2, 3]
    assert {r.weather: r.ringer_id for r in store.read("sessions").collect()} == {"mist": key(ringing.IDA), "calm": key(ringing.OLE)}
    assert {(r.family_name, r.grade) for r in store.read("ringers").collect()} == {("Lund", 3), ("Berg", None)}
    again = load(ringing.mapping(), ringing.collections(spark), store, "append")
    assert {r.status for r in again.entities.values()} == {"already_done"}
    assert store.read("sessions").count() == 2


def test_done_entity_takes_new_documents_and_upsert_keeps_others(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), ringing.catalog())
    m = ringing.mapping()
    load(m, ringing.collections(spark), store, "truncate")
    rows = [tuple(r) for r in ringing.collections(spark).read("sessions").collect()]
    noon = (f"{0xFF:024x}", ringing.OLE, ringing.opened(12), "rain", [ringing.LOW_NET], [(ringing.ROBIN, "A004", 72, 17.5)])
    out = load(m, ringing.collections(spark, [*rows, noon]), store, "append")
    assert out.total("sessions") == 1 and store.read("sessions").count() == 3
    assert sorted(r.id for r in store.read("session_catches").collect()) == [1, 2, 3, 4]
    state = store.begin()
    state.state["checkpoints"].clear()
    state.publish()
    corrected = ringing.collections(spark, [(ringing.DUSK, ringing.IDA, ringing.opened(20), "storm", [ringing.LOW_NET, ringing.HIGH_NET], [(ringing.TIT, "A009", 60, 10.0)])])
    load(m, corrected, store, "upsert")
    assert {r.id: r.weather for r in store.read("sessions").collect()}[key(ringing.DUSK)] == "storm"
    assert store.read("sessions").count() == 3
    assert store.read("session_nets").count() == 5  # a known pair isn't repeated, a new one is added
    assert store.read("session_catches").count() == 5  # exploded rows are added, as upsert has no key for them


def test_append_conflict_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), ringing.catalog())
    load(ringing.mapping(), ringing.collections(spark), store, "truncate")
    state = store.begin()
    state.state["checkpoints"].clear()
    state.publish()
    with pytest.raises(LoadError, match="upsert"):
        load(ringing.mapping(), ringing.collections(spark), store, "append", only=["nets"])


def test_dangling_reference_stops_and_leaves_the_state(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), ringing.catalog())
    load(ringing.mapping(), ringing.collections(spark), store, "truncate", only=["species", "ringers", "nets"])
    version = store.manifest()["version"]
    bad = ringing.collections(spark, [(ringing.DAWN, "f" * 24, ringing.opened(4), "mist", [], [])])
    with pytest.raises(LoadError, match="ringerId"):
        load(ringing.mapping(), bad, store, "append", only=["sessions"])
    assert store.manifest()["version"] == version
    assert "sessions" not in store.manifest()["tables"] or store.read("sessions").count() == 0


def test_batches_resume_after_a_kill(spark, tmp_path):
    m = parse_mapping({"entities": {"n": {"source": "n", "target": "n", "id_strategy": ringing.UUID, "fields": {"value": "value"}}}})
    docs = spark.range(50).select(F.lpad(F.hex("id"), 24, "0").alias("_id"), F.col("id").cast("int").alias("value"))
    store = Store(spark, str(tmp_path / "t"))

    class Stop(Exception):
        pass

    def die(message):
        if "13" in message:
            raise Stop

    from docweave.streaming.load import Progress

    with pytest.raises(Stop):
        load(m, Collections(spark, {"n": docs}), store, "append", batch_size=10, progress=Progress(die, 0))
    assert store.read("n").count() == 20
    load(m, Collections(spark, {"n": docs}), store, "append", batch_size=10)
    got = store.read("n").collect()
    assert len(got) == 50 == len({r.id for r in got}) and {r.value for r in got} == set(range(50))
    assert store.manifest()["checkpoints"]["n"]["rows_loaded"] == 50


def test_truncate_only_touches_the_chosen(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), ringing.catalog())
    load(ringing.mapping(), ringing.collections(spark), store, "truncate")
    with pytest.raises(MappingError, match="unknown entities"):
        load(ringing.mapping(), ringing.collections(spark), store, "truncate", only=["nobody"])
    load(ringing.mapping(), ringing.collections(spark), store, "truncate", only=["nets"])
    assert store.read("ringers").count() == 2 and store.read("nets").count() == 2
    assert store.manifest()["checkpoints"]["ringers"]["status"] == "done"


def test_namespace_change_is_refused(spark, tmp_path):
    m = parse_mapping({"entities": {"n": {"source": "n", "target": "n", "id_strategy": ringing.UUID, "fields": {}}}})
    store = Store(spark, str(tmp_path / "t"))
    rows = lambda n: Collections(spark, {"n": spark.range(n).select(F.lpad(F.hex("id"), 24, "0").alias("_id"))})
    load(m, rows(2), store, "append")
    with pytest.raises(LoadError, match="namespace"):
        load(m, rows(3), store, "append", namespace="11111111-2222-4333-8444-555555555555")


def test_a_second_publisher_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    a, b = store.begin(), store.begin()
    a.publish()
    with pytest.raises(PublishConflict):
        b.publish()


def test_int_ids_compare_as_numbers_and_sequences_are_dense(spark, tmp_path):
    m = parse_mapping({"entities": {"n": {"source": "n", "target": "n", "id_strategy": {"type": "int_sequence", "source_field": "_id"}, "fields": {"value": "value"}}}})
    docs = lambda n: Collections(spark, {"n": spark.range(1, n).select(F.col("id").alias("_id"), F.col("id").alias("value"))})
    store = Store(spark, str(tmp_path / "t"))
    load(m, docs(10), store, "append")
    load(m, docs(13), store, "append")
    assert sorted((int(r.id), r.value) for r in store.read("n").collect()) == [(i, i) for i in range(1, 13)]


def test_stream_of_files(spark, tmp_path):
    m = parse_mapping({"entities": {"n": {"source": "n", "target": "n", "id_strategy": ringing.UUID, "fields": {"value": "value"}}}})
    store = Store(spark, str(tmp_path / "t"))
    for k in range(2):
        spark.range(k * 3, k * 3 + 3).select(F.lpad(F.hex("id"), 24, "0").alias("_id"), F.col("id").alias("value")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("_id string, value long").parquet(str(tmp_path / "in"))
        stream_load(m, "n", stream, store, str(tmp_path / "c")).awaitTermination()
        assert store.read("n").count() == 3 * k + 3


def test_a_batch_that_is_replayed_is_loaded_once(spark, tmp_path):
    m = parse_mapping({"entities": {"n": {"source": "n", "target": "n", "id_strategy": ringing.UUID, "fields": {}, "explode": {"xs": {"target": "x", "id_strategy": {"type": "serial"}, "parent_fk": {"target_field": "n_id", "references": "n.id"}, "fields": {"v": "v"}}}}}})
    spark.createDataFrame([("a", [(1,), (2,)])], "_id string, xs array<struct<v:int>>").write.json(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "t"))
    feed = lambda: spark.readStream.schema("_id string, xs array<struct<v:int>>").json(str(tmp_path / "in"))
    stream_load(m, "n", feed(), store, str(tmp_path / "c")).awaitTermination()
    # Published, but the stream's own commit was lost.
    for f in (tmp_path / "c" / "commits").iterdir():
        f.unlink()
    stream_load(m, "n", feed(), store, str(tmp_path / "c")).awaitTermination()
    assert sorted(r.v for r in store.read("x").collect()) == [1, 2]


def test_publishing_leaves_the_work_of_other_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    mine, other = store.begin(), store.begin()
    kept = mine.keep(spark.range(3))
    other.replace("t", spark.range(1))
    other.publish()
    assert kept.count() == 3
