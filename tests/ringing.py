"""A bird-ringing station: what its staff note down as documents, the tables they become rows of, and the mapping between them."""

import datetime

from docweave.plans.catalog import parse_ddl
from docweave.plans.mapping import parse_mapping
from docweave.sources.collections import Collections

WREN, ROBIN, TIT, LOW_NET, HIGH_NET, IDA, OLE, DAWN, DUSK = (f"{i:024x}" for i in range(0xA1, 0xAA))
DDL = """
CREATE TABLE nets (id UUID PRIMARY KEY, label TEXT NOT NULL UNIQUE, metres NUMERIC(5,1));
CREATE TABLE ringers (id UUID PRIMARY KEY, family_name TEXT NOT NULL, permit TEXT NOT NULL UNIQUE, grade INT);
CREATE TABLE species (id UUID PRIMARY KEY, code VARCHAR(8) NOT NULL UNIQUE, latin TEXT NOT NULL);
CREATE TABLE sessions (id UUID PRIMARY KEY, opened_at TIMESTAMPTZ NOT NULL, ringer_id UUID NOT NULL REFERENCES ringers(id), weather TEXT NOT NULL);
CREATE TABLE session_catches (id SERIAL PRIMARY KEY, session_id UUID NOT NULL REFERENCES sessions(id), species_id UUID NOT NULL REFERENCES species(id), ring TEXT NOT NULL, wing INT, grams NUMERIC(7,2) NOT NULL);
CREATE TABLE session_nets (session_id UUID NOT NULL REFERENCES sessions(id), net_id UUID NOT NULL REFERENCES nets(id), PRIMARY KEY (session_id, net_id));
"""
UUID = {"type": "objectid_to_uuid", "source_field": "_id"}


def flat(name, **fields):
    return {"source": name, "target": name, "id_strategy": UUID, "fields": fields}


IN_SESSION = {"target_field": "session_id", "references": "sessions.id"}
MAPPING = {
    "entities": {
        "species": flat("species", code={"target": "code", "transform": "trim"}, latin="latin"),
        "ringers": flat("ringers", surname="family_name", permit="permit", grade={"target": "grade", "transform": "cast_int"}),
        "nets": flat("nets", label="label", metres="metres"),
        "sessions": {
            **flat("sessions", ringerId={"target": "ringer_id", "lookup": "ringers"}, openedAt={"target": "opened_at", "transform": "cast_timestamptz"}, weather="weather"),
            "junction": {"netIds": {"target": "session_nets", "parent_fk": IN_SESSION, "child_fk": {"target_field": "net_id", "references": "nets.id", "lookup": "nets"}}},
            "explode": {
                "catches": {
                    "target": "session_catches",
                    "parent_fk": IN_SESSION,
                    "id_strategy": {"type": "serial"},
                    "fields": {"ring": "ring", "wing": "wing", "grams": "grams", "speciesId": {"target": "species_id", "lookup": "species"}},
                }
            },
        },
    }
}


def mapping():
    return parse_mapping(MAPPING)


def catalog():
    return parse_ddl(DDL)


def opened(hour):
    return datetime.datetime(2025, 5, 17, hour, 30)


def collections(spark, sessions=None):
    """The station's collections; sessions are (_id, ringerId, openedAt, weather, netIds, catches of (speciesId, ring, wing, grams))."""
    usual = [
        (DAWN, IDA, opened(4), "mist", [LOW_NET, HIGH_NET], [(WREN, "A001", 48, 9.25), (TIT, "A002", None, 11.0), (WREN, "A003", 50, 8.9)]),
        (DUSK, OLE, opened(20), "calm", [HIGH_NET], None),
    ]
    return Collections(
        spark,
        {
            "species": spark.createDataFrame([(WREN, " TROTRO", "Troglodytes troglodytes"), (ROBIN, "ERIRUB", "Erithacus rubecula"), (TIT, "CYACAE", "Cyanistes caeruleus")], "_id string, code string, latin string"),
            "ringers": spark.createDataFrame([(IDA, "Lund", "P-7", "3"), (OLE, "Berg", "P-9", None)], "_id string, surname string, permit string, grade string"),
            "nets": spark.createDataFrame([(LOW_NET, "low", 6.0), (HIGH_NET, "high", 12.0)], "_id string, label string, metres double"),
            "sessions": spark.createDataFrame(sessions or usual, "_id string, ringerId string, openedAt timestamp, weather string, netIds array<string>, catches array<struct<speciesId:string,ring:string,wing:int,grams:double>>"),
        },
    )
