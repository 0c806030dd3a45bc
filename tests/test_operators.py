import pytest
import ringing
from pyspark.sql import functions as F

from docweave.cli import main
from docweave.functions.keys import with_sequence
from docweave.operators import fanin, merge, profile, reconcile
from docweave.operators.compile import compile_entity
from docweave.operators.dryrun import dry_run, fast_pass
from docweave.operators.lookup import LookupError_, empty_id_map, latest, require_loaded
from docweave.plans.mapping import parse_mapping
from docweave.sources.collections import Collections, redacted
from docweave.sources.store import Store
from docweave.streaming.load import load

#: Reserves with ponds, and what was found in each sample of a pond.
RESERVES = {
    "r": {
        "source": "r",
        "target": "reserves",
        "id_strategy": ringing.UUID,
        "explode": {
            "ponds": {
                "target": "ponds",
                "id_strategy": {"type": "objectid_to_uuid", "source_field": "pond"},
                "parent_fk": {"target_field": "reserve_id", "references": "reserves.id"},
                "fields": {"depth": "depth_cm"},
                "explode": {"samples": {"target": "samples", "id_strategy": {"type": "serial"}, "parent_fk": {"target_field": "pond_id", "references": "ponds.id"}, "fields": {"taxon": "taxon", "n": "found"}}},
            }
        },
    }
}


def variants(spark, docs):
    return spark.createDataFrame(docs, "_id string, j string").select("_id", F.parse_json("j").alias("doc"))


def test_nested_variant_documents(spark):
    docs = variants(
        spark,
        [
            ("moor", '{"_id": "moor", "ponds": [{"pond": "m1", "depth": 80, "samples": [{"taxon": "newt", "n": 2}, {"taxon": "frog", "n": 9}, {"taxon": "newt", "n": 1}]}, {"pond": "m2", "depth": 35, "samples": []}]}'),
            ("dune", '{"_id": "dune", "ponds": []}'),
            ("cliff", '{"_id": "cliff"}'),
            ("bog", '{"_id": "bog", "ponds": {"pond": "b1"}}'),
            ("fen", '{"_id": "fen", "ponds": [{"pond": "f1", "depth": 120, "samples": "many"}, {"pond": "f2", "samples": [{"taxon": "toad"}]}]}'),
        ],
    )
    made = compile_entity("r", parse_mapping({"entities": RESERVES}).entities["r"], docs, empty_id_map(spark))
    # Documents with an error are out, and so is all that hangs from them.
    assert made.main[1].count() == 4
    assert sorted(str(r.depth_cm) for r in made.children["ponds"].collect()) == ["35", "80", "None"]
    samples = made.children["samples"].collect()
    assert sorted((r.taxon, str(r.found)) for r in samples) == [("frog", "9"), ("newt", "1"), ("newt", "2"), ("toad", "None")]
    assert sorted(int(r.id) for r in samples) == [1, 2, 3, 4]
    wrong = {(r.source_id, r.field) for r in made.events.filter("kind = 'E'").collect()}
    assert wrong == {("bog", "ponds"), ("fen", "ponds.samples")}


def test_arrays_that_feed_one_table_share_its_numbers(spark):
    array = lambda: {"target": "x", "id_strategy": {"type": "serial"}, "parent_fk": {"target_field": "n_id", "references": "n.id"}, "fields": {"v": "v"}}
    m = parse_mapping({"entities": {"n": {"source": "n", "target": "n", "id_strategy": ringing.UUID, "fields": {}, "explode": {"xs": array(), "ys": array(), "zs": array()}}}})
    docs = spark.createDataFrame([("a", [(1,), (2,)], [(3,)], []), ("b", [(4,)], [(5,), (6,)], [(7,)])], "_id string, xs array<struct<v:int>>, ys array<struct<v:int>>, zs array<struct<v:int>>")
    rows = compile_entity("n", m.entities["n"], docs, empty_id_map(spark), sequences={"x": 11}).children["x"].collect()
    assert sorted(int(r.id) for r in rows) == list(range(11, 18)) and sorted(r.v for r in rows) == list(range(1, 8))


def test_first_event_wins_and_skips_hide_later_errors(spark):
    m = parse_mapping(
        {
            "entities": {"e": {"source": "e", "target": "e", "id_strategy": ringing.UUID, "fields": {"n": {"target": "n", "transform": "cast_int"}, "ref": {"target": "r", "lookup": "x", "on_missing": "skip_row"}, "m": {"target": "m", "transform": "cast_int"}}}},
            "external_entities": ["x"],
        }
    ).entities["e"]
    rows = [("1", "bad", "gone", "1"), ("2", "1", "gone", "bad"), ("3", "1", "k", "bad"), ("4", "1", "k", "2"), ("5", None, None, None)]
    ids = spark.createDataFrame([("x", "k", "K")], "entity string, source_id string, target_id string").withColumn("loaded_at", F.current_timestamp())
    made = compile_entity("e", m, spark.createDataFrame(rows, "_id string, n string, ref string, m string"), ids)
    assert {(r.source_id, r.field, r.kind) for r in made.events.collect()} == {("1", "n", "E"), ("2", "ref", "S"), ("3", "m", "E")}
    assert {r.n for r in made.main[1].collect()} == {1, None}
    every = compile_entity("e", m, spark.createDataFrame(rows, "_id string, n string, ref string, m string"), ids, every_error=True)
    assert every.events.count() == 5


def test_null_identity(spark):
    docs = spark.createDataFrame([("1", None), ("2", "k")], "_id string, ref string")
    base = {"source": "e", "target": "e", "id_strategy": {"type": "objectid_to_uuid", "source_field": "ref"}}
    hard = parse_mapping({"entities": {"e": base}}).entities["e"]
    assert [(r.source_id, r.kind) for r in compile_entity("e", hard, docs, empty_id_map(spark)).events.collect()] == [("1", "E")]
    soft = parse_mapping({"entities": {"e": {**base, "fields": {"ref": {"target": "r", "lookup": "x", "on_missing": "skip_row"}}}}, "external_entities": ["x"]}).entities["e"]
    kinds = {(r.source_id, r.kind) for r in compile_entity("e", soft, docs, empty_id_map(spark)).events.collect()}
    assert ("1", "S") in kinds and ("1", "E") not in kinds


def test_scalar_items_residual_json_and_nulls_in_junctions(spark):
    m = parse_mapping(
        {
            "entities": {
                "o": {
                    "source": "o",
                    "target": "o",
                    "id_strategy": ringing.UUID,
                    "explode": {"items": {"target": "i", "id_strategy": {"type": "serial"}, "parent_fk": {"target_field": "o_id", "references": "o.id"}, "fields": {"qty": "qty"}, "unmapped": {"jsonb": ["note", "discount"], "jsonb_column": "extra"}}},
                    "junction": {"tags": {"target": "t", "parent_fk": {"target_field": "o_id", "references": "o.id"}, "child_fk": {"target_field": "t_id", "references": "t.id"}}},
                }
            }
        }
    ).entities["o"]
    docs = spark.createDataFrame([("1", [(1, 0.1, "gift wrap")], ["x", "x", None])], "_id string, items array<struct<qty:int,discount:double,note:string>>, tags array<string>")
    made = compile_entity("o", m, docs, empty_id_map(spark))
    assert made.children["i"].first().extra == '{"discount":0.1,"note":"gift wrap"}'
    assert [r.t_id for r in made.junctions["t"].collect()] == ["x", "x"]
    assert [r.kind for r in made.events.collect()] == ["E"]


def test_never_loaded_guard_and_last_write(spark):
    missed = spark.range(1)
    with pytest.raises(LookupError_):
        require_loaded(empty_id_map(spark), {"x": missed})
    require_loaded(empty_id_map(spark), {"x": missed.filter("id > 5")})
    ids = spark.sql("select 'e' entity, '1' source_id, t target_id, timestamp_seconds(n) loaded_at from values ('a', 1), ('b', 2) v(t, n)")
    assert latest(ids).first().target_id == "b"


def test_sequences_are_dense_over_any_partitions(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k")).repartition(6)
    got = {r.k: r.n for r in with_sequence(df, ["k"], "n", 10).collect()}
    assert got == {k: k + 10 for k in range(500)}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {tuple(r) for r in merge.upsert(old, new, ["k"]).collect()} == {(1, "a", "x"), (2, None, "y"), (3, "c", None)}
    assert {tuple(r) for r in merge.upsert(old, new, ["k"], []).collect()} == {(1, "a", "x"), (2, "b", "y"), (3, "c", None)}
    pairs = spark.createDataFrame([(2, "z"), (4, "d"), (4, "d")], "k int, v string")
    assert merge.insert_missing(old.select("k", "v"), pairs, ["k"]).count() == 3
    assert {tuple(r) for r in merge.replaced(old, new.withColumn("w", F.lit("n")), ["k"]).collect()} == {(1, "a", "x"), (2, None, "n"), (3, "c", "n")}
    found = merge.violations({"ringers": spark.createDataFrame([("1", "P", None), ("2", "P", "n")], "id string, permit string, family_name string")}, ringing.catalog())
    assert {(r.constraint, r.n) for r in found.collect()} == {("not null family_name", 1), ("unique permit", 2)}


def test_pick_one_puts_nulls_first_and_breaks_ties(spark):
    df = spark.createDataFrame([("1", "g", None), ("2", "g", 5), ("3", "g", 5), ("4", "h", None)], "_id string, g string, o int")
    assert {r._id for r in fanin.pick_one(df, ["g"], "o").collect()} == {"3", "4"}
    assert {r._id for r in fanin.pick_one(df, ["g"], "o", latest=False).collect()} == {"1", "4"}


def test_profile_of_mixed_documents(spark):
    docs = spark.range(20).select(F.parse_json(F.when(F.col("id") % 2 == 0, '{"type": "card", "last4": "1", "n": 1}').otherwise('{"type": "bank", "routing": "2", "n": "x", "l": [{"q": 1.5}, null]}')).alias("doc"))
    p = profile.profile("payments", docs)
    assert p.polymorphic and p.discriminator == "type" and p.doc_count == 20
    fields = {f["path"]: f for f in p.fields}
    assert fields["n"]["types"] == ["int", "string"] and fields["l"]["item_kind"] == "object" and fields["l[].q"]["types"] == ["double"]
    assert p.top_level() == ["l", "last4", "n", "routing", "type"]
    assert [profile.sample_size(n) for n in (10, 5000, 6000, 100_000, 10**8)] == [10, 5000, 1000, 2000, 50_000]


def test_profile_of_deep_documents(spark):
    n = 18
    text = '{"a": [' * 2 + '{"a": ' * (n - 2) + "1" + "}" * (n - 2) + "]}" * 2
    found = {r.path: r for r in profile.field_stats(spark.range(3).select(F.parse_json(F.lit(text)).alias("doc"))).collect()}
    deepest = "a[].a[]" + ".a" * (n - 2)
    assert len(found) == n and found[deepest].types == ["int"] and found[deepest].present_count == 3


def test_reconciliation_names_what_differs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), ringing.catalog())
    load(ringing.mapping(), ringing.collections(spark), store, "truncate")
    assert reconcile.reconcile(ringing.mapping(), ringing.collections(spark), store, sample=None).ok
    state = store.begin()
    state.replace("ringers", store.read("ringers").withColumn("grade", F.when(F.col("permit") == "P-7", 4).otherwise(F.col("grade")).cast("int")))
    state.replace("session_nets", store.read("session_nets").limit(1))
    state.publish()
    report = reconcile.reconcile(ringing.mapping(), ringing.collections(spark), store, sample=None)
    assert [(v.entity, v.source_id, v.field) for v in report.values] == [("ringers", ringing.IDA, "grade")]
    assert [c.table for c in report.counts if not c.matches] == ["session_nets"]


def test_differences_beyond_the_listed_are_counted(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "t"), ringing.catalog())
    load(ringing.mapping(), ringing.collections(spark), store, "truncate")
    state = store.begin()
    state.replace("species", store.read("species").withColumn("latin", F.lit("?")).withColumn("code", F.concat("code", F.when(F.col("code") == "ERIRUB", "!").otherwise(""))))
    state.publish()
    every = reconcile.reconcile(ringing.mapping(), ringing.collections(spark), store, sample=None)
    monkeypatch.setattr(reconcile, "SAMPLE", 1)
    some = reconcile.reconcile(ringing.mapping(), ringing.collections(spark), store, sample=None)
    assert len(every.values) == 4 and some.values == every.values[:1] and not some.ok
    for report, truncated in ((every, False), (some, True)):
        assert [(d.entity, d.field, d.n, d.truncated) for d in report.fields] == [("species", "code", 1, truncated), ("species", "latin", 3, truncated)]


def test_canonical_values(spark):
    row = spark.sql("select 1.50D d, cast(1.500 as decimal(9,3)) n, 1L i, timestamp'2026-01-01 00:00:00' t").select(*(reconcile.canonical(F.col(c), k) for c, k in (("d", reconcile.T.DoubleType()), ("n", reconcile.T.DecimalType(9, 3)), ("i", reconcile.T.LongType()), ("t", reconcile.T.TimestampType())))).first()
    assert tuple(row) == ("1.5", "1.5", "1", "2026-01-01T00:00:00.000000")


def test_dry_run_layers(spark, tmp_path):
    mine = tmp_path / "s" / "mine.txt"
    mine.parent.mkdir()
    mine.write_text("kept")
    clean = dry_run(ringing.mapping(), ringing.collections(spark), ringing.catalog(), str(tmp_path / "s"))
    assert clean.ok and clean.layers == "AB" and [p.name for p in (tmp_path / "s").iterdir()] == ["mine.txt"]
    stranger, unknown = "f" * 24, "e" * 24
    bad = ringing.collections(spark, [(ringing.DAWN, stranger, ringing.opened(4), None, [ringing.LOW_NET], [(unknown, "A1", 1, 1.0)])])
    report = fast_pass(ringing.mapping(), bad, ringing.catalog())
    assert {v.field for v in report.violations} == {"ringerId", "weather", "catches.speciesId"} and not report.ok
    twice = ringing.collections(spark)
    twice.given["nets"] = spark.createDataFrame([(ringing.LOW_NET, "same", 1.0), (ringing.HIGH_NET, "same", 2.0)], "_id string, label string, metres double")
    found = dry_run(ringing.mapping(), twice, ringing.catalog(), str(tmp_path / "s"))
    assert [(v.entity, v.field) for v in found.violations] == [("nets", "unique label")]
    many = ringing.collections(spark, [(f"{i:024x}", stranger, ringing.opened(9), "x", [], []) for i in range(5)])
    cut = fast_pass(ringing.mapping(), many, ringing.catalog(), cap=3)
    assert cut.truncated and not cut.ok


def test_polymorphic_collection_fills_one_table(spark, tmp_path):
    part = lambda k: {"source": "p", "target": "pay", "id_strategy": ringing.UUID, "filter": {"field": "type", "equals": k}, "fields": {"type": "type"}}
    m = parse_mapping({"entities": {"card": part("card"), "bank": part("bank")}})
    docs = Collections(spark, {"p": spark.range(10).select(F.lpad(F.hex("id"), 24, "0").alias("_id"), F.when(F.col("id") < 4, "card").otherwise("bank").alias("type"))})
    store = Store(spark, str(tmp_path / "t"))
    load(m, docs, store, "append")
    assert {(c.entity, c.target) for c in reconcile.reconcile(m, docs, store, sample=None).counts} == {("card", 4), ("bank", 6)}


def test_command_line(spark, tmp_path, capsys):
    import yaml

    (tmp_path / "m.yaml").write_text(yaml.safe_dump({**ringing.MAPPING}))
    (tmp_path / "t.sql").write_text(ringing.DDL)
    c = ringing.collections(spark)
    for n in c.names():
        c.read(n).write.parquet(str(tmp_path / "in" / f"{n}.parquet"))
    common = ["--source", str(tmp_path / "in"), "--ddl", str(tmp_path / "t.sql"), "--mapping", str(tmp_path / "m.yaml")]
    assert main(["validate-mapping", "--source", str(tmp_path / "in"), "--mapping", str(tmp_path / "m.yaml")]) == 0
    assert main(["migrate", *common, "--target", str(tmp_path / "out"), "--mode", "truncate", "--yes"]) == 0
    assert main(["validate", *common, "--target", str(tmp_path / "out")]) == 0
    assert main(["migrate", *common, "--target", str(tmp_path / "out"), "--mode", "append", "--only", "nobody"]) == 2
    assert main(["propose", "--source", str(tmp_path / "in"), "--ddl", str(tmp_path / "t.sql"), "--out", str(tmp_path / "p.yaml")]) == 0
    assert "session_catches" in (tmp_path / "p.yaml").read_text()
    assert main(["reshape", "--source", str(tmp_path / "in"), "--collection", "sessions", "--by", "ringerId", "--order", "openedAt", "--dest", str(tmp_path / "one.parquet")]) == 0
    assert spark.read.parquet(str(tmp_path / "one.parquet")).count() == 2
    assert redacted("db://a:secret@h/x password=hunter2") == "db://a:***@h/x password=***"
