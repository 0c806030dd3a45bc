import json

import pytest
import ringing

from docweave.plans.catalog import CatalogError, parse_ddl
from docweave.plans.mapping import CycleError, MappingError, as_plain, collection_issues, dump_mapping, field_issues, load_mapping, parse_mapping, structure_issues
from docweave.plans.propose import Suggestion, apply_suggestions, likeness, normalized, payload, propose, singular

PARENT = {"target_field": "p", "references": "t.id"}


def entity(**more):
    return {"source": "s", "target": "t", "id_strategy": ringing.UUID, **more}


@pytest.mark.parametrize(
    "bad",
    [
        {"e": entity(id_strategy={"type": "passthrough"})},
        {"e": entity(id_strategy={"type": "nothing", "source_field": "_id"})},
        {"e": entity(fields={"a": {"target": "a", "on_missing": "null"}})},
        {"e": entity(fields={"a": {"target": "a", "lookup": "e", "on_missing": "maybe"}})},
        {"e": entity(fields={"a": {"target": "a", "colour": "red"}})},
        {"e": entity(unmapped={"drop": ["a"], "jsonb": ["a"], "jsonb_column": "x"})},
        {"e": entity(unmapped={"jsonb": ["a"]})},
        {"e": entity(unmapped=["a"])},
        {"e": entity(junction={"j": {"target": "j", "parent_fk": PARENT, "child_fk": {"target_field": "c", "references": "c.id"}, "on_missing": "skip_row"}})},
        {"e": entity(junction={"j": {"target": "j", "parent_fk": PARENT, "child_fk": {"target_field": "c", "references": "c.id", "lookup": "e"}, "on_missing": "null"}})},
        {"e": entity(unpivot={"u": {"target": "u", "parent_fk": PARENT, "code_column": "c", "value_column": "v", "items": [{"source_field": "a", "code": "A"}, {"source_field": "b", "code": "A"}]}})},
        {"e": entity(explode={"x": {"target": "x", "id_strategy": {"type": "serial"}, "parent_fk": PARENT, "explode": {"y": {"target": "y", "id_strategy": {"type": "serial"}, "parent_fk": PARENT}}}})},
        {"e": entity(explode={"x": {"target": "x", "id_strategy": {"type": "serial"}, "parent_fk": {"target_field": "p", "references": "t"}}})},
    ],
)
def test_what_cannot_be_meant_is_refused(bad):
    with pytest.raises(MappingError):
        parse_mapping({"entities": bad})


def test_external_databases_belong_to_external_entities():
    with pytest.raises(MappingError):
        parse_mapping({"entities": {"e": entity()}, "external_databases": {"x": "VAR"}})


def test_yaml_round_trip_null_policy_and_repeated_keys(tmp_path):
    path = tmp_path / "m.yaml"
    path.write_text("entities:\n  e:\n    source: s\n    target: t\n    id_strategy: {type: passthrough, source_field: _id}\n    fields:\n      a: {target: b, lookup: e2, on_missing: null}\n    unmapped_fields: []\nexternal_entities: [e2]\n")
    m = load_mapping(path)
    assert m.entities["e"].fields["a"].on_missing == "null"
    dump_mapping(m, tmp_path / "n.yaml")
    assert load_mapping(tmp_path / "n.yaml") == m
    path.write_text("entities:\n  e: {}\n  e: {}\n")
    with pytest.raises(MappingError, match="twice"):
        load_mapping(path)


def test_order_follows_lookups_at_any_depth_and_depends_on():
    deep = {"x": {"target": "x", "id_strategy": {"type": "passthrough", "source_field": "k"}, "parent_fk": PARENT, "explode": {"y": {"target": "y", "id_strategy": {"type": "serial"}, "parent_fk": PARENT, "fields": {"f": {"target": "f", "lookup": "zz"}}}}}}
    m = parse_mapping({"entities": {"a": entity(explode=deep), "b": entity(depends_on=["a"]), "zz": entity()}})
    assert m.load_order() == ["zz", "a", "b"]
    with pytest.raises(CycleError):
        parse_mapping({"entities": {"a": entity(depends_on=["b"]), "b": entity(depends_on=["a"])}}).load_order()
    issues = structure_issues(parse_mapping({"entities": {"a": entity(depends_on=["a", "q"], fields={"f": {"target": "f", "lookup": "nobody"}})}}))
    assert {i.where for i in issues} >= {"a"} and len(issues) >= 3


def test_every_field_needs_a_disposition():
    m = ringing.mapping().entities["sessions"]
    seen = ["_id", "weather", "openedAt", "ringerId", "catches", "catches[].speciesId", "catches[].ring", "catches[].wing", "catches[].grams", "catches[].age", "netIds", "moon", "moon.phase"]
    assert {i.message.split("'")[1] for i in field_issues("sessions", m, seen)} == {"age", "moon"}
    assert [i.where for i in collection_issues(ringing.mapping(), ["nets", "diary"])] == ["diary"]


def test_ddl_and_its_order():
    c = ringing.catalog()
    assert c.load_order() == [["nets", "ringers", "species"], ["sessions"], ["session_catches", "session_nets"]]
    assert c["session_nets"].primary_key == ("session_id", "net_id") and not c["session_nets"].columns["net_id"].nullable
    assert c["session_catches"].columns["grams"].spark.simpleString() == "decimal(7,2)" and c["session_catches"].columns["wing"].nullable
    loop = "create table a (id int primary key, b int references b(id){0}); create table b (id int primary key, a int references a(id){0});"
    with pytest.raises(CatalogError):
        parse_ddl(loop.format("")).load_order()
    assert parse_ddl(loop.format(" deferrable initially deferred")).load_order() == [["a", "b"]]
    with pytest.raises(CatalogError, match="no table"):
        c["nothing"]


class Profile:
    def __init__(self, name, fields, polymorphic=False, discriminator=None):
        self.name, self.polymorphic, self.discriminator = name, polymorphic, discriminator
        self.fields = [{"path": p, "types": t.split("/"), "is_array": "array" in t, "item_kind": k} for p, t, k in fields]


def profiles():
    return [
        Profile("species", [("_id", "objectid", None), ("code", "string", None), ("latin", "string", None)]),
        Profile("ringers", [("_id", "objectid", None), ("familyName", "string", None), ("permit", "string", None), ("grade", "int", None)]),
        Profile("nets", [("_id", "objectid", None), ("label", "string", None), ("metres", "double", None)]),
        Profile("sessions", [("_id", "objectid", None), ("weather", "string", None), ("openedAt", "date", None), ("ringerId", "objectid", None), ("netIds", "array", "scalar"), ("catches", "array", "object"), ("catches[].speciesId", "objectid", None), ("catches[].ring", "string", None), ("catches[].wing", "int", None), ("catches[].grams", "double", None), ("moon", "int/string", None)]),
        Profile("Xylophone", [("_id", "objectid", None)]),
    ]


def test_proposal_for_the_station():
    made = propose(profiles(), ringing.catalog())
    e = made.mapping.entities
    assert {n: x.target for n, x in e.items()} == {n: n for n in ("species", "ringers", "nets", "sessions")}
    assert e["ringers"].fields["familyName"].target == "family_name" and e["sessions"].id_strategy.type == "objectid_to_uuid"
    assert e["sessions"].fields["ringerId"].lookup == "ringers" and e["sessions"].fields["openedAt"].target == "opened_at"
    catches, nets = e["sessions"].explode["catches"], e["sessions"].junction["netIds"]
    assert catches.target == "session_catches" and catches.fields["speciesId"].lookup == "species" and nets.target == "session_nets" and nets.child_fk.lookup == "nets"
    assert e["sessions"].unmapped.drop == ("moon",) and made.mapping.excluded_collections == ("Xylophone",)
    assert any("several types" in n.message for n in made.notes)
    json.dumps(as_plain(made.mapping))
    assert not [i for i in structure_issues(made.mapping) if i.severity == "error"]


def test_suggestions_are_checked():
    ddl = ringing.DDL.replace("weather TEXT NOT NULL", "weather TEXT NOT NULL, remark TEXT")
    made, table = propose(profiles(), parse_ddl(ddl)), parse_ddl(ddl)["sessions"]
    e = made.mapping.entities["sessions"]
    assert "remark" in payload(profiles()[3], table, e)
    new, notes = apply_suggestions(e, table, [Suggestion("moon", "remark"), Suggestion("moon", "weather"), Suggestion("nope", "remark")])
    assert new.fields["moon"].target == "remark" and new.unmapped.drop == () and len(notes) == 3


def test_names():
    assert normalized("userIDs2 x") == "user_ids2_x" and singular("categories") == "category" and singular("class") == "class"
    assert likeness("createdAt", "created_at") == 1.0
