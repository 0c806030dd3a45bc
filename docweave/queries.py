"""A query for each operator over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.keys import NAMESPACE, new_id, settled, shared_folder, with_sequence
from docweave.functions.paths import get_array, get_path, packed
from docweave.functions.transforms import compile_transform, value
from docweave.operators import fanin, merge, profile, reconcile
from docweave.operators.compile import as_document, compile_entity, matches
from docweave.operators.lookup import LookupError_, dangling, lookup, require_loaded, upsert_id_map
from docweave.plans.mapping import parse_mapping
from docweave.sources.collections import Collections
from docweave.sources.store import Store
from docweave.streaming.load import load

OTHER_NAMESPACE = "11111111-2222-4333-8444-555555555555"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Shared inputs


def sql_uuid(expr: str, namespace: str = NAMESPACE) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({expr}))"
    return f"list_transform([{h}], lambda h: concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)))[1]"


def customer_ids(spark: SparkSession, d: str, where: str = "true", entity: str = "customers") -> DataFrame:
    """The map that loading customers leaves; restricted, so that references to the others dangle."""
    return id_map(t(spark, d, "customer").filter(where), "c_custkey", entity)


def id_map(df: DataFrame, key: str, entity: str) -> DataFrame:
    return df.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("source_id"), new_id("objectid_to_uuid", F.col(key)).alias("target_id"), F.lit(0).cast("timestamp").alias("loaded_at"))


def orders_doc(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents with their line items and suppliers embedded; orders without items have no array."""
    items = F.struct(F.col("l_partkey").alias("partId"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"))
    inside = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(items).alias("items"), F.collect_set("l_suppkey").alias("supplierIds"))
    heads = t(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("userId"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("createdAt"), F.col("o_orderpriority").alias("priority"))
    return heads.join(inside, F.col("_id") == F.col("l_orderkey"), "left").drop("l_orderkey")


UUID = {"type": "objectid_to_uuid", "source_field": "_id"}


def order_load(on_missing: str = "skip_row", item_policy: str = "skip_row", junction_policy: str = "skip_row"):
    return parse_mapping(
        {
            "entities": {
                "orders": {
                    "source": "orders",
                    "target": "orders",
                    "id_strategy": UUID,
                    "fields": {"status": "status", "createdAt": {"target": "created_at", "transform": "cast_timestamptz"}, "userId": {"target": "user_id", "lookup": "customers", "on_missing": on_missing}},
                    "explode": {"items": {"target": "order_items", "id_strategy": {"type": "serial"}, "parent_fk": {"target_field": "order_id", "references": "orders.id"}, "fields": {"partId": {"target": "part_id", "lookup": "parts", "on_missing": item_policy}, "line": "line", "qty": "qty"}, "unmapped": {"drop": ["price", "discount", "flag"]}}},
                    "junction": {"supplierIds": {"target": "order_suppliers", "parent_fk": {"target_field": "order_id", "references": "orders.id"}, "child_fk": {"target_field": "supplier_id", "references": "suppliers.id", "lookup": "suppliers"}, "on_missing": junction_policy}},
                    "unmapped": {"drop": ["total", "priority"]},
                }
            },
            "external_entities": ["customers", "parts", "suppliers"],
        }
    )


def order_id_maps(spark: SparkSession, d: str, customers: str = "c_mktsegment <> 'BUILDING'", parts: str = "p_size <= 40", suppliers: str = "s_nationkey < 20") -> dict[str, DataFrame]:
    return {"customers": customer_ids(spark, d, customers), "parts": id_map(t(spark, d, "part").filter(parts), "p_partkey", "parts"), "suppliers": id_map(t(spark, d, "supplier").filter(suppliers), "s_suppkey", "suppliers")}


def order_ids(spark: SparkSession, d: str, **where: str) -> DataFrame:
    customers, parts, suppliers = order_id_maps(spark, d, **where).values()
    return customers.unionByName(parts).unionByName(suppliers)


def scratch_store(spark: SparkSession) -> Store:
    """An empty target in a folder of its own, below the one for checkpoints, which all machines share."""
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def compiled(spark: SparkSession, d: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df, **policies: str):
    return compile_entity("orders", order_load(**policies).entities["orders"], orders_doc(spark, d), order_ids(spark, d), keep=keep)


LIVE = "orders JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'BUILDING'"

# Projection and paths


@query("SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def q_rename_project(spark, d):
    m = parse_mapping({"entities": {"c": {"source": "c", "target": "c", "id_strategy": {"type": "passthrough", "source_field": "c_custkey"}, "fields": {"c_name": "full_name", "c_mktsegment": "segment", "c_acctbal": "balance"}}}})
    made = compile_entity("c", m.entities["c"], t(spark, d, "customer").withColumn("_id", F.col("c_custkey")), customer_ids(spark, d))
    return made.main[1].withColumn("id", F.col("id").cast("long"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def q_path_variant(spark, d):
    docs = t(spark, d, "events").select("event_id", F.parse_json("props").alias("doc"))
    k = compile_transform("cast_int", get_path(F.col("doc"), T.VariantType(), "k"))
    absent = compile_transform("cast_text", get_path(F.col("doc"), T.VariantType(), "no.where"))
    return docs.select("event_id", k.column.alias("k"), absent.column.alias("missing"))


@query("SELECT o_orderkey, json_object('o_orderpriority', o_orderpriority, 'o_orderstatus', nullif(o_orderstatus, 'P'), 'o_shippriority', NULL)::VARCHAR AS extra FROM orders")
def q_residual_jsonb(spark, d):
    docs = as_document(t(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))), "o_orderkey")
    return docs.select(F.col("_oid").alias("o_orderkey"), packed(F.col("_doc"), docs.schema["_doc"].dataType, ["o_orderstatus", "o_orderpriority", "o_shippriority"]).alias("extra"))


# Filters


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def q_filter_discriminator(spark, d):
    docs = as_document(t(spark, d, "orders"), "o_orderkey")
    kept = docs.filter(matches(F.col("_doc"), docs.schema["_doc"].dataType, "o_orderstatus", "F"))
    return kept.select(F.col("_oid").alias("o_orderkey"), F.col("_doc.o_totalprice").alias("o_totalprice"))


@query("SELECT o_orderstatus AS entity, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def q_poly_split_union(spark, d):
    docs, out = t(spark, d, "orders").withColumn("_id", F.col("o_orderkey")), None
    for s in "FOP":
        m = parse_mapping({"entities": {s: {"source": "orders", "target": "all_orders", "id_strategy": {"type": "passthrough", "source_field": "_id"}, "filter": {"field": "o_orderstatus", "equals": s}}}})
        part = compile_entity(s, m.entities[s], docs, customer_ids(spark, d)).id_map
        out = part if out is None else out.unionByName(part)
    return out.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("source_id").cast("long")).alias("first_key"))


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderkey > 9000")
def q_resume_range(spark, d):
    m = parse_mapping({"entities": {"o": {"source": "o", "target": "o", "id_strategy": {"type": "passthrough", "source_field": "_id", "target_field": "o_orderkey"}, "fields": {"o_orderstatus": "status"}}}})
    made = compile_entity("o", m.entities["o"], t(spark, d, "orders").withColumn("_id", F.col("o_orderkey")), customer_ids(spark, d), after=9000)
    return made.main[1].withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 25")
def q_collection_diff(spark, d):
    return t(spark, d, "part").select("p_partkey").join(t(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").distinct()


@query("SELECT count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_existence_semijoin(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


# Transforms. Inputs are built from keys so that every kind of text occurs.


def texts(spark: SparkSession, d: str, forms: list[str]) -> DataFrame:
    """(k, s): order keys with texts made from them by the forms in turn; {} stands for the key."""
    parts = F.array(*map(F.lit, forms))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.replace(F.get(parts, (F.col("o_orderkey") % len(forms)).cast("int")), F.lit("{}"), F.col("o_orderkey").cast("string")).alias("s"))


def sql_texts(forms: list[str]) -> str:
    listed = ", ".join("'" + f.replace("'", "''") + "'" for f in forms)
    return f"(SELECT o_orderkey AS k, replace(([{listed}])[(o_orderkey % {len(forms)} + 1)::INT], '{{}}', o_orderkey::VARCHAR) AS s FROM orders)"


def transformed(df: DataFrame, spec: str, column: str = "s", into: T.DataType | None = None) -> DataFrame:
    made = compile_transform(spec, value(F.col(column), df.schema[column].dataType), into)
    return df.select("k", made.column.alias("v"), made.error.isNotNull().alias("failed"))


INTS = ["{}", " {} ", "+{}", "-{}", "{}.5", "1_{}", "x{}", "{}e2", "", "_{}"]
TRIMMED = "regexp_replace(s, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT k, CASE WHEN ok THEN replace(b, '_', '')::BIGINT END AS v, NOT ok AS failed FROM (SELECT k, {TRIMMED} AS b, regexp_matches({TRIMMED}, '^[+-]?[0-9]+(_[0-9]+)*$') AS ok FROM {sql_texts(INTS)})")
def q_cast_int(spark, d):
    return transformed(texts(spark, d, INTS), "cast_int")


@query("SELECT k, trunc(v)::BIGINT AS v, false AS failed FROM (SELECT o_orderkey AS k, o_totalprice * (CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END) AS v FROM orders)")
def q_cast_int_double(spark, d):
    return transformed(t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1)).alias("s")), "cast_int")


FLOATS = ["{}", "{}.25", "-{}e-2", " .5", "{}d", "1_000.{}", "inf{}", "", "{}.", "nan x"]


@query(f"SELECT k, CASE WHEN ok THEN replace(b, '_', '')::DOUBLE END AS v, NOT ok AS failed FROM (SELECT k, {TRIMMED} AS b, regexp_matches({TRIMMED}, '^[+-]?([0-9]+(_[0-9]+)*\\.?([0-9]+(_[0-9]+)*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$') AS ok FROM {sql_texts(FLOATS)})")
def q_cast_float(spark, d):
    return transformed(texts(spark, d, FLOATS), "cast_float")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS b, o_orderkey::VARCHAR AS i, (o_orderkey / 4.0)::DOUBLE::VARCHAR AS f, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '+00:00' AS ts FROM orders")
def q_cast_text(spark, d):
    cols = {"b": F.col("o_orderkey") % 2 == 0, "i": F.col("o_orderkey"), "f": F.col("o_orderkey").cast("double") / 4, "ts": F.col("o_orderdate").cast("timestamp")}
    df = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), *(c.alias(n) for n, c in cols.items()))
    return df.select("k", *(compile_transform("cast_text", value(F.col(n), df.schema[n].dataType)).column.alias(n) for n in cols))


@query(f"SELECT k, length(s) > 0 AS v, false AS failed FROM {sql_texts(['false', '', '0', '{}'])}")
def q_cast_bool(spark, d):
    return transformed(texts(spark, d, ["false", "", "0", "{}"]), "cast_bool")


STAMPS = ["2026-01-04", "2026-01-04T10:20:30", "2026-01-04 10:20:30.5", "2026-01-04T10:20Z", "2026-01-04T10:20:30+02:00", "2026-1-4", "2026", "12:30", "epoch", "2026-13-04", " 2026-01-04"]
STAMP_VALUES = ["2026-01-04 00:00:00", "2026-01-04 10:20:30", "2026-01-04 10:20:30.5", "2026-01-04 10:20:00", "2026-01-04 08:20:30"]


@query(f"SELECT k, TRY_CAST(([{', '.join(repr(x) for x in STAMP_VALUES)}])[(k % 11 + 1)::INT] AS TIMESTAMP) AS v, k % 11 >= 5 AS failed FROM {sql_texts(STAMPS)}")
def q_cast_ts(spark, d):
    return transformed(texts(spark, d, STAMPS), "cast_timestamptz").withColumn("v", F.col("v").cast("timestamp_ntz"))


@query("SELECT o_orderkey AS k, coalesce(nullif(o_orderstatus, 'P'), 'unknown') AS v, false AS failed FROM orders")
def q_default(spark, d):
    return transformed(t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.nullif("o_orderstatus", F.lit("P")).alias("s")), "default:unknown")


@query("SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS v, o_orderstatus = 'P' AS failed FROM orders")
def q_enum(spark, d):
    return transformed(t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")), 'enum:{"F": "finished", "O": "open"}')


@query("SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN NULL ELSE 'other' END AS v, false AS failed FROM orders")
def q_enum_wildcard(spark, d):
    return transformed(t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")), 'enum:{"F": null, "*": "other"}')


@query("SELECT p_partkey AS k, len(string_split(p_name, '#')) AS n, string_split(p_name, '#')[1] AS first, string_split(p_type, '|')[-1] AS last FROM part")
def q_split(spark, d):
    df = t(spark, d, "part")
    name, kind = (compile_transform(s, value(F.col(c), T.StringType())).column for s, c in (("split:#", "p_name"), ("split:|", "p_type")))
    return df.select(F.col("p_partkey").alias("k"), F.size(name).cast("long").alias("n"), F.get(name, F.lit(0)).alias("first"), F.element_at(kind, -1).alias("last"))


@query("SELECT doc_id AS k, substr(text, 1, 40) AS v, false AS failed FROM documents")
def q_truncate(spark, d):
    return transformed(t(spark, d, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("s")), "truncate:40")


PADDED = ["  {}", "{}\t\n", "　{} ", "{}", "\x0b {} x "]


@query(f"SELECT k, k::VARCHAR || CASE k % 5 WHEN 4 THEN ' x' ELSE '' END AS v, false AS failed FROM (SELECT o_orderkey AS k FROM orders)")
def q_trim(spark, d):
    return transformed(texts(spark, d, PADDED), "trim")


@query(f"SELECT k, coalesce(substr(trim(s), 1, 4), 'none') AS v, false AS failed FROM (SELECT k, nullif(s, '') AS s FROM {sql_texts(['  {} x', '', '{}'])})")
def q_pipeline(spark, d):
    return transformed(texts(spark, d, ["  {} x", "", "{}"]).withColumn("s", F.nullif("s", F.lit(""))), "trim|default:none|truncate:4")


# Keys


@query(f"SELECT c_custkey, {sql_uuid('c_custkey::VARCHAR')} AS id FROM customer")
def q_key_uuid5(spark, d):
    return t(spark, d, "customer").select("c_custkey", new_id("objectid_to_uuid", F.col("c_custkey")).alias("id"))


@query(f"SELECT c_custkey, {sql_uuid('c_custkey::VARCHAR', OTHER_NAMESPACE)} AS id FROM customer")
def q_key_uuid5_ns(spark, d):
    return t(spark, d, "customer").select("c_custkey", new_id("objectid_to_uuid", F.col("c_custkey"), OTHER_NAMESPACE).alias("id"))


@query("SELECT c_custkey, c_custkey::VARCHAR AS id FROM customer")
def q_key_passthrough(spark, d):
    return t(spark, d, "customer").select("c_custkey", new_id("passthrough", F.col("c_custkey")).alias("id"))


@query("SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderkey) AS id FROM orders")
def q_key_sequence(spark, d):
    return with_sequence(t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "id", 1001)


@query("SELECT count(*) AS n, count(*) AS n_ids FROM customer")
def q_uuid_generate(spark, d):
    return t(spark, d, "customer").select(new_id("uuid_generate", F.col("c_custkey")).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


# Lookups


@query("SELECT o_orderkey::VARCHAR AS source_id, 'E' AS kind, 'userId' AS field, 'customers has no ' || o_custkey AS message FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def q_lookup_error_events(spark, d):
    return compiled(spark, d, on_missing="error").events.filter("table = 'orders'").select("source_id", "kind", "field", "message")


@query(f"SELECT o_orderkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN {sql_uuid('o_custkey::VARCHAR')} END AS user_id, c_mktsegment = 'BUILDING' AS missed FROM orders JOIN customer ON o_custkey = c_custkey")
def q_lookup_null(spark, d):
    found = lookup(t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey"), customer_ids(spark, d, "c_mktsegment <> 'BUILDING'"), "customers", "user_id")
    return found.select("o_orderkey", "user_id", F.col("user_id_missed").alias("missed"))


@query(f"SELECT {sql_uuid('o_orderkey::VARCHAR')} AS id, CASE WHEN c_mktsegment <> 'BUILDING' THEN {sql_uuid('o_custkey::VARCHAR')} ELSE 'nobody' END AS user_id FROM orders JOIN customer ON o_custkey = c_custkey")
def q_lookup_null_default(spark, d):
    m = parse_mapping({"entities": {"o": {"source": "o", "target": "o", "id_strategy": UUID, "fields": {"o_custkey": {"target": "user_id", "lookup": "customers", "on_missing": None, "transform": "default:nobody"}}}}, "external_entities": ["customers"]})
    return compile_entity("o", m.entities["o"], t(spark, d, "orders").withColumn("_id", F.col("o_orderkey")), customer_ids(spark, d, "c_mktsegment <> 'BUILDING'")).main[1]


@query(f"SELECT {sql_uuid('o_orderkey::VARCHAR')} AS id, o_orderstatus AS status, {sql_uuid('o_custkey::VARCHAR')} AS user_id FROM {LIVE}")
def q_lookup_skip(spark, d):
    return compiled(spark, d).main[1].select("id", "status", "user_id")


@query(
    f"""
SELECT 'userId' AS field, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'items.partId', count(*) FROM lineitem JOIN {LIVE} ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size > 40
UNION ALL SELECT 'supplierIds', count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN {LIVE} ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey >= 20"""
)
def q_lookup_counts(spark, d):
    found = compiled(spark, d).events.filter("kind = 'S'")
    return found.groupBy(F.when(F.col("table") == "order_suppliers", "supplierIds").otherwise(F.col("field")).alias("field")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id, l.doc_id::VARCHAR AS label_id, l.doc_id IS NULL AS missed FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_lookup_external(spark, d):
    ids = t(spark, d, "labels").select(F.lit("labels").alias("entity"), F.col("doc_id").cast("string").alias("source_id"), F.col("doc_id").cast("string").alias("target_id"), F.lit(0).cast("timestamp").alias("loaded_at"))
    found = lookup(t(spark, d, "documents").select("doc_id"), F.col("doc_id"), ids, "labels", "label_id")
    return found.select("doc_id", "label_id", F.col("label_id_missed").alias("missed"))


@query("SELECT true AS never_loaded, (SELECT count(*) FROM orders) AS n_missed")
def q_never_loaded(spark, d):
    ids = customer_ids(spark, d)
    found = lookup(t(spark, d, "orders").select("o_custkey"), F.col("o_custkey"), ids, "nobody", "x")
    try:
        require_loaded(ids, {"nobody": found.filter("x_missed")})
        never = False
    except LookupError_:
        never = True
    return found.agg(F.lit(never).alias("never_loaded"), F.count_if(F.expr("x_missed")).alias("n_missed"))


@query("SELECT 'orders' AS entity, o_custkey::VARCHAR AS source_id, max(o_orderkey)::VARCHAR AS target_id FROM orders GROUP BY o_custkey UNION ALL SELECT 'orders', 'old', 'kept'")
def q_idmap_dedup(spark, d):
    old = spark.createDataFrame([("orders", "old", "kept"), ("orders", "1", "gone")], "entity string, source_id string, target_id string").withColumn("loaded_at", F.lit(0).cast("timestamp"))
    new = t(spark, d, "orders").select(F.lit("orders").alias("entity"), F.col("o_custkey").cast("string").alias("source_id"), F.col("o_orderkey").cast("string").alias("target_id"), F.timestamp_seconds(F.col("o_orderkey")).alias("loaded_at"))
    known = t(spark, d, "orders").filter("o_custkey = 1").limit(1).select(F.lit("1").alias("source_id"))
    old = old.filter("source_id = 'old'").unionByName(old.filter("source_id = '1'").join(known, "source_id", "left_semi").select(*old.columns))
    return upsert_id_map(old, new).select("entity", "source_id", "target_id")


# Fan-out


@query(f"SELECT {sql_uuid('l_orderkey::VARCHAR')} AS order_id, {sql_uuid('l_partkey::VARCHAR')} AS part_id, l_linenumber AS line, l_quantity AS qty FROM lineitem JOIN {LIVE} ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey AND p_size <= 40")
def q_explode(spark, d):
    return compiled(spark, d).children["order_items"].select("order_id", "part_id", "line", "qty")


@query("SELECT count(*) AS n_orders, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS n_empty, (SELECT count(*) FROM lineitem) AS n_items, (SELECT count(*) FROM lineitem) AS n_rows FROM orders")
def q_explode_empty(spark, d):
    docs = orders_doc(spark, d)
    rows = docs.select(F.explode("items")).agg(F.count(F.lit(1)).alias("n_rows"))
    return docs.agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.expr("items is null")).alias("n_empty"), reconcile.array_rows(docs, "items").alias("n_items")).crossJoin(F.broadcast(rows))


@query(f"SELECT o_orderkey::VARCHAR AS source_id, count(*) AS n FROM lineitem JOIN {LIVE} ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey AND p_size > 40 GROUP BY 1")
def q_explode_item_skip(spark, d):
    return compiled(spark, d).events.filter("table = 'order_items' and kind = 'S'").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def customer_mapping(item_policy: str = "error"):
    """Customers with orders with line items: two levels below the document, ids threaded down."""
    lines = {"target": "lines", "id_strategy": {"type": "serial"}, "parent_fk": {"target_field": "order_id", "references": "orders.id"}, "fields": {"line": "line", "qty": "qty"}}
    level = {"target": "orders", "id_strategy": {"type": "objectid_to_uuid", "source_field": "orderId"}, "parent_fk": {"target_field": "customer_id", "references": "customers.id"}, "fields": {"orderId": {"target": "order_ref", "lookup": "order_refs", "on_missing": item_policy}}, "explode": {"items": lines}}
    return parse_mapping({"entities": {"customers": {"source": "c", "target": "customers", "id_strategy": UUID, "fields": {"name": "name"}, "explode": {"orders": level}}}, "external_entities": ["order_refs"]}).entities["customers"]


def customer_docs(spark: SparkSession, d: str) -> DataFrame:
    items = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"))).alias("items"))
    orders = t(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("orderId"), "items")).alias("orders"))
    return t(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"), "orders")


@query(f"SELECT {sql_uuid('l_orderkey::VARCHAR')} AS order_id, l_linenumber AS line, l_quantity AS qty FROM lineitem")
def q_explode_nested(spark, d):
    ids = id_map(t(spark, d, "orders"), "o_orderkey", "order_refs")
    return compile_entity("customers", customer_mapping(), customer_docs(spark, d), ids).children["lines"].select("order_id", "line", "qty")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS n_orders, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'")
def q_explode_nested_skip(spark, d):
    ids = id_map(t(spark, d, "orders").filter("o_orderstatus <> 'F'"), "o_orderkey", "order_refs")
    made = compile_entity("customers", customer_mapping("skip_row"), customer_docs(spark, d), ids)
    return made.children["orders"].agg(F.count(F.lit(1)).alias("n_orders")).crossJoin(F.broadcast(made.children["lines"].agg(F.count(F.lit(1)).alias("n_lines"))))


@query("SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def q_explode_skip_parent(spark, d):
    gone = compiled(spark, d).documents.filter("_end = 'S'")
    return gone.agg(reconcile.array_rows(gone, "_items_items").alias("n"))


@query(f"SELECT {sql_uuid('l_orderkey::VARCHAR')} AS order_id, {sql_uuid('l_suppkey::VARCHAR')} AS supplier_id FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN {LIVE} ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey < 20")
def q_junction_skip(spark, d):
    return compiled(spark, d).junctions["order_suppliers"]


@query(f"SELECT {sql_uuid('l_orderkey::VARCHAR')} AS order_id, {sql_uuid('l_suppkey::VARCHAR')} AS supplier_id FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)")
def q_junction(spark, d):
    return compile_entity("orders", order_load().entities["orders"], orders_doc(spark, d), order_ids(spark, d, customers="true", parts="true", suppliers="true")).junctions["order_suppliers"]


def amounts(spark: SparkSession, d: str, skip_null: bool) -> DataFrame:
    docs = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_discount").alias("l_discount"), F.max("l_tax").alias("l_tax"), F.max("l_quantity").alias("l_quantity"))
    docs = docs.select(F.col("l_orderkey").alias("_id"), F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.nullif("l_tax", F.lit(0.08)).alias("tax"), F.col("l_quantity").alias("quantity"))
    items = [{"source_field": f, "code": f.upper()} for f in ("discount", "tax", "quantity")]
    m = parse_mapping({"entities": {"l": {"source": "l", "target": "l", "id_strategy": {"type": "passthrough", "source_field": "_id"}, "unpivot": {"a": {"target": "amounts", "parent_fk": {"target_field": "line_id", "references": "l.id"}, "code_column": "code", "value_column": "amount", "items": items, "skip_null": skip_null}}}}})
    return compile_entity("l", m.entities["l"], docs, customer_ids(spark, d)).unpivots["amounts"]


AMOUNTS = "(SELECT l_orderkey::VARCHAR AS line_id, nullif(min(l_discount), 0) AS \"DISCOUNT\", nullif(max(l_tax), 0.08) AS \"TAX\", max(l_quantity) AS \"QUANTITY\" FROM lineitem GROUP BY l_orderkey)"


@query(f"UNPIVOT {AMOUNTS} ON \"DISCOUNT\", \"TAX\", \"QUANTITY\" INTO NAME code VALUE amount")
def q_unpivot(spark, d):
    return amounts(spark, d, True)


@query(f"SELECT * FROM {AMOUNTS} UNPIVOT INCLUDE NULLS (amount FOR code IN (\"DISCOUNT\", \"TAX\", \"QUANTITY\"))")
def q_unpivot_keepnull(spark, d):
    return amounts(spark, d, False)


@query("SELECT event_id, event_id % 4 = 0 AS wrong, CASE event_id % 4 WHEN 1 THEN 2 ELSE 0 END::BIGINT AS n FROM events")
def q_array_shape_violations(spark, d):
    form = F.get(F.array(F.lit('{"a": 7}'), F.lit('{"a": [1, "x"]}'), F.lit('{"a": null}'), F.lit("{}")), (F.col("event_id") % 4).cast("int"))
    docs = t(spark, d, "events").select("event_id", F.parse_json(form).alias("doc"))
    items, _, wrong = get_array(F.col("doc"), T.VariantType(), "a")
    return docs.select("event_id", wrong.isNotNull().alias("wrong"), F.size(items).cast("long").alias("n"))


# Writes


def old_and_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = t(spark, d, "customer").filter("c_custkey % 4 <> 0").select("c_custkey", "c_name", "c_acctbal", F.lit("kept").alias("note"))
    new = t(spark, d, "customer").filter("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") * 2).alias("c_acctbal"))
    return old, new


OLD = "(SELECT c_custkey, c_name, c_acctbal, 'kept' AS note FROM customer WHERE c_custkey % 4 <> 0)"
NEW = "(SELECT c_custkey, upper(c_name) AS c_name, c_acctbal * 2 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0)"


@query(f"SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, o.note FROM {OLD} o FULL JOIN {NEW} n USING (c_custkey)")
def q_upsert_main(spark, d):
    return merge.upsert(*old_and_new(spark, d), ["c_custkey"])


@query("SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey % 3 <> 1")
def q_upsert_junction(spark, d):
    pairs = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return merge.insert_missing(pairs.filter("l_orderkey % 3 = 0").distinct(), pairs.filter("l_orderkey % 3 = 2 or l_orderkey % 6 = 0"), ["l_orderkey", "l_suppkey"])


@query(f"SELECT line_id, code, CASE WHEN code = 'TAX' THEN amount + 1 ELSE amount END AS amount FROM (UNPIVOT {AMOUNTS} ON \"DISCOUNT\", \"TAX\", \"QUANTITY\" INTO NAME code VALUE amount)")
def q_upsert_unpivot(spark, d):
    old = amounts(spark, d, True)
    return merge.upsert(old, old.filter("code = 'TAX'").withColumn("amount", F.col("amount") + 1), ["line_id", "code"])


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 3 = 0")
def q_append_conflict(spark, d):
    return merge.conflicts(*old_and_new(spark, d), ["c_custkey"])


@query("SELECT c_custkey, upper(c_name) AS c_name, c_acctbal * 2 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0")
def q_truncate_load(spark, d):
    """A load of the old rows, and one of the new with mode truncate: what the target's table holds then."""
    old, new = old_and_new(spark, d)
    fields = {"c_custkey": "c_custkey", "c_name": "c_name", "c_acctbal": "c_acctbal"}
    made = {"source": "customer", "target": "customer", "id_strategy": {"type": "objectid_to_uuid", "source_field": "c_custkey"}, "fields": fields}
    m, store = parse_mapping({"entities": {"customer": made}}), scratch_store(spark)
    for rows in (old, new):
        load(m, Collections(spark, {"customer": rows.drop("note").withColumn("_id", F.col("c_custkey"))}), store, "truncate")
    return store.read("customer").select("c_custkey", "c_name", "c_acctbal")


# Fan-in


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q_fanin_latest(spark, d):
    return fanin.pick_one(t(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value"), ["user_id"], "ts", tie="event_id").drop("ts")


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def q_fanin_earliest(spark, d):
    return fanin.pick_one(t(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value"), ["user_id"], "ts", latest=False, tie="event_id").drop("ts")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def q_fanin_multikey(spark, d):
    return fanin.pick_one(t(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", tie="event_id").drop("ts")


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def q_fanin_filter(spark, d):
    return fanin.pick_one(t(spark, d, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], "turn", where="role = 'assistant'").drop("role")


SIGNED = "CASE WHEN user_id % 2 = 0 THEN user_id ELSE -user_id END"


@query(f"WITH e AS (SELECT {SIGNED} AS user_id, value FROM events) SELECT user_id, max(value) AS value FROM e GROUP BY user_id UNION ALL SELECT c_custkey, -1.0 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM e WHERE user_id IS NOT NULL)")
def q_fanin_merge(spark, d):
    """All events into all customers. Odd users' ids are negated, so that some keys are on one side only."""
    target = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(-1.0).alias("value"))
    source = t(spark, d, "events").select(F.expr(SIGNED).alias("user_id"), "value")
    return fanin.reshape(source, lambda x: fanin.pick_one(x, ["user_id"], "value"), target, "merge", ["user_id"])


# Profiling


def event_docs(spark: SparkSession, d: str) -> DataFrame:
    """Events as schemaless documents: what a document has depends on its type, and one field changes its own."""
    kind, props = F.col("event_type"), F.col("props")
    body = F.concat(
        F.lit('{"type": "'), kind, F.lit('", "props": '), props, F.lit(', "user": '), F.col("user_id").cast("string"),
        F.when(F.col("event_id") % 2 == 0, F.lit(', "tags": [1, "a", {"b": 2}]')).otherwise(""),
        F.when(F.col("event_id") % 5 == 0, F.lit(', "n": "many"')).otherwise(F.concat(F.lit(', "n": '), (F.col("event_id") % 7).cast("string"))),
        F.when(F.col("event_id") % 3 == 0, F.lit(', "gone": null')).otherwise(""), F.lit("}"),
    )
    return t(spark, d, "events").select(F.col("event_id").alias("_id"), F.parse_json(body).alias("doc"))


@query(
    """
WITH e AS (SELECT event_id AS i FROM events), h AS (SELECT count(*) AS n, count(*) FILTER (i % 2 = 0) AS n2, count(*) FILTER (i % 3 = 0) AS n3 FROM e)
SELECT p AS path, c AS present_count, z AS null_count, ts AS types, a AS is_array, ik AS item_kind, its AS item_types FROM h, LATERAL (VALUES
 ('type', n, 0::BIGINT, 'string', false, NULL, ''), ('props', n, 0, 'object', false, NULL, ''), ('props.k', n, 0, 'int', false, NULL, ''), ('user', n, 0, 'int', false, NULL, ''),
 ('tags', n2, 0, 'array', true, 'object', 'int,object,string'), ('tags[].b', n2, 0, 'int', false, NULL, ''), ('n', n, 0, 'int,string', false, NULL, ''), ('gone', n3, n3, '', false, NULL, '')) v(p, c, z, ts, a, ik, its)"""
)
def q_profile_fields(spark, d):
    found = profile.field_stats(event_docs(spark, d))
    return found.select("path", "present_count", "null_count", F.concat_ws(",", "types").alias("types"), "is_array", "item_kind", F.concat_ws(",", "item_types").alias("item_types"))


@query("SELECT 'n' AS path, 'int,string' AS types")
def q_profile_variance(spark, d):
    return profile.type_variance(profile.field_stats(event_docs(spark, d))).select("path", F.concat_ws(",", "types").alias("types"))


@query("SELECT concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'gone' END, 'n', 'props', CASE WHEN event_id % 2 = 0 THEN 'tags' END, 'type', 'user') AS signature, count(*) AS n_docs FROM events GROUP BY 1")
def q_shape_signatures(spark, d):
    return profile.shapes(event_docs(spark, d)).select(F.concat_ws(",", "signature").alias("signature"), "n_docs")


@query("SELECT 'o_orderstatus' AS field, 3::BIGINT AS n_values, 1.0::DOUBLE AS purity")
def q_discriminator(spark, d):
    s = F.col("o_orderstatus")
    docs = t(spark, d, "orders").select(F.struct(s.alias("o_orderstatus"), F.when(s == "F", F.col("o_totalprice")).alias("paid"), F.when(s == "O", F.col("o_custkey")).alias("owed_by"), F.col("o_orderpriority").alias("p")).alias("doc"))
    return profile.discriminators(docs).filter("purity = 1.0")


# Reconciliation


@query(
    f"""
SELECT 'orders' AS "table", (SELECT count(*) FROM orders) AS source, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') AS expected_skip, (SELECT count(*) FROM {LIVE}) AS target
UNION ALL SELECT 'order_items', (SELECT count(*) FROM lineitem JOIN {LIVE} ON l_orderkey = o_orderkey), (SELECT count(*) FROM lineitem JOIN {LIVE} ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size > 40), (SELECT count(*) FROM lineitem JOIN {LIVE} ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size <= 40)"""
)
def q_count_diff(spark, d):
    """A load into a store of its own, and the counts that reconcile finds between its tables and the source."""
    store, sources = scratch_store(spark), Collections(spark, {"orders": settled(orders_doc(spark, d))})
    staged = store.begin()
    for entity, ids in order_id_maps(spark, d).items():
        staged.add_ids(entity, ids)
    staged.publish()
    m = order_load()
    load(m, sources, store, "truncate")
    counts = [(c.table, c.source, c.expected_skip, c.target) for c in reconcile.reconcile(m, sources, store).counts]
    return spark.createDataFrame(counts, "`table` string, source bigint, expected_skip bigint, target bigint").filter("`table` <> 'order_suppliers'")


@query("SELECT (SELECT count(*) FROM lineitem) AS nested_rows, (SELECT count(*) FROM orders) AS items")
def q_count_diff_nested(spark, d):
    docs = customer_docs(spark, d)
    nested = docs.select(F.explode("orders").alias("o")).select(F.col("o.items").alias("items"))
    return nested.agg(reconcile.array_rows(nested, "items").alias("nested_rows")).crossJoin(F.broadcast(docs.agg(reconcile.array_rows(docs, "orders").alias("items"))))


@query("SELECT count(*) FILTER (NOT (nobody OR gone)) AS kept, count(*) FILTER (nobody OR gone) AS skipped FROM (SELECT c_mktsegment = 'BUILDING' AS gone, o_orderkey % 10 = 0 AS nobody FROM orders JOIN customer ON o_custkey = c_custkey)")
def q_expected_skip(spark, d):
    docs = t(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey")).alias("ref"), F.col("o_custkey").alias("userId"))
    fields = {"ref": {"target": "ref", "lookup": "orders_seen", "on_missing": "skip_row"}, "userId": {"target": "user_id", "lookup": "customers", "on_missing": "skip_row"}}
    m = parse_mapping({"entities": {"o": {"source": "o", "target": "o", "id_strategy": {"type": "objectid_to_uuid", "source_field": "ref"}, "fields": fields}}, "external_entities": ["customers", "orders_seen"]})
    ids = customer_ids(spark, d, "c_mktsegment <> 'BUILDING'").unionByName(id_map(t(spark, d, "orders"), "o_orderkey", "orders_seen"))
    return compile_entity("o", m.entities["o"], docs, ids).documents.agg(F.count_if(F.expr("_end is null")).alias("kept"), F.count_if(F.expr("_end = 'S'")).alias("skipped"))


@query("SELECT o_custkey::VARCHAR AS source_id, count(*) AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def q_value_occurrences(spark, d):
    return dangling(t(spark, d, "orders"), F.col("o_custkey"), customer_ids(spark, d, "c_mktsegment <> 'BUILDING'"), "customers")


@query("SELECT 'userId' AS field, count(DISTINCT o_custkey) AS n_values, count(*) AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def q_dangling_report(spark, d):
    return dangling(t(spark, d, "orders"), F.col("o_custkey"), customer_ids(spark, d, "c_mktsegment <> 'BUILDING'"), "customers").agg(F.lit("userId").alias("field"), F.count(F.lit(1)).alias("n_values"), F.sum("n_rows").alias("n_rows"))


@query("SELECT c_custkey::VARCHAR AS k, sha256(replace(c_name, '|', '\\|') || '|' || coalesce(nullif(c_mktsegment, 'BUILDING'), '\\N') || '|' || c_nationkey) AS h FROM customer")
def q_row_hash(spark, d):
    df = t(spark, d, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return reconcile.hashed(df, "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"]).select(F.col("_key").alias("k"), F.col("_hash").alias("h"))


@query("SELECT p_partkey, (round((p_retailprice::DECIMAL(20, 6)) / 8, 2))::DECIMAL(12, 2) AS stored FROM part")
def q_scale_match(spark, d):
    return t(spark, d, "part").select("p_partkey", reconcile.at_scale(F.col("p_retailprice").cast("decimal(20,6)") / 8, 12, 2).alias("stored"))


@query(
    """
SELECT c_custkey::VARCHAR AS key, 'c_name' AS field, c_name AS expected, c_name || '!' AS actual FROM customer WHERE c_custkey % 50 = 0
UNION ALL SELECT c_custkey::VARCHAR, '<row missing>', NULL, NULL FROM customer WHERE c_custkey % 77 = 1 AND c_custkey % 50 <> 0
UNION ALL SELECT c_custkey::VARCHAR, 'c_nationkey', c_nationkey::VARCHAR, (c_nationkey + 1)::VARCHAR FROM customer WHERE c_custkey % 60 = 0 AND (c_custkey % 77 <> 1 OR c_custkey % 50 = 0)"""
)
def q_field_blame(spark, d):
    good = t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    k = F.col("c_custkey")
    bad = good.filter((k % 77 != 1) | (k % 50 == 0)).withColumn("c_name", F.when(k % 50 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))).withColumn("c_nationkey", F.when(k % 60 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    return reconcile.value_diffs(good, bad, "c_custkey", ["c_name", "c_nationkey"])


# Checks


@query("SELECT 'status' AS field, 'error' AS severity, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'userId', 'info', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def q_dryrun_violations(spark, d):
    from docweave.operators.dryrun import entity_violations

    m = parse_mapping({"entities": {"o": {"source": "o", "target": "o", "id_strategy": UUID, "fields": {"status": {"target": "status", "transform": 'enum:{"F": "f", "O": "o"}'}, "userId": {"target": "user_id", "lookup": "customers", "on_missing": "null"}}}}, "external_entities": ["customers"]})
    return entity_violations("o", m.entities["o"], orders_doc(spark, d), customer_ids(spark, d, "c_mktsegment <> 'BUILDING'"), None).groupBy("field", "severity").agg(F.count(F.lit(1)).alias("n"))


def found_in(df: DataFrame) -> DataFrame:
    return df.select("table", "constraint", "value", "n")


@query("SELECT 'orders' AS \"table\", 'not null status' AS \"constraint\", 'null' AS value, count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
def q_notnull(spark, d):
    return found_in(merge.not_null(t(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("status")), "orders", "status"))


@query("SELECT 'lineitem' AS \"table\", 'l_partkey references part.p_partkey' AS \"constraint\", l_partkey::VARCHAR AS value, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45 GROUP BY l_partkey")
def q_fk_check(spark, d):
    return found_in(merge.references(t(spark, d, "lineitem"), "lineitem", "l_partkey", t(spark, d, "part").filter("p_size <= 45"), "p_partkey", "part.p_partkey"))


@query("SELECT 'lineitem' AS \"table\", 'unique l_orderkey, l_linenumber' AS \"constraint\", l_orderkey || ',' || l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def q_unique_check(spark, d):
    return found_in(merge.unique(t(spark, d, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"]))


@query("SELECT 'part' AS \"table\", 'p_type of at most 12 characters' AS \"constraint\", p_type AS value, count(*) AS n FROM part WHERE length(p_type) > 12 GROUP BY p_type")
def q_varchar_check(spark, d):
    return found_in(merge.too_long(t(spark, d, "part"), "part", "p_type", 12))


@query()
def q_sample(spark, d):
    df = t(spark, d, "customer").select("c_custkey")
    return profile.sampled(df, 100, df.count(), 7)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Orders with embedded items, loaded under a skip policy: rows of each table, and what was left out, by field."""
    made = compiled(spark, d, keep=settled)
    rows = None
    for table, df in made.tables().items():
        part = df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("table"), F.lit("rows").alias("what"), "n")
        rows = part if rows is None else rows.unionByName(part)
    left = made.events.groupBy("table", F.concat(F.lit("skipped by "), "field").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(left)


@query(
    f"""
SELECT 'orders' AS "table", 'rows' AS what, count(*) AS n FROM {LIVE}
UNION ALL SELECT 'order_items', 'rows', count(*) FROM lineitem JOIN {LIVE} ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey AND p_size <= 40
UNION ALL SELECT 'order_suppliers', 'rows', count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN {LIVE} ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey < 20
UNION ALL SELECT 'orders', 'skipped by userId', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'order_items', 'skipped by items.partId', count(*) FROM lineitem JOIN {LIVE} ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey AND p_size > 40
UNION ALL SELECT 'order_suppliers', 'skipped by supplierIds', count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN {LIVE} ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey >= 20"""
)
def q_load_report(spark, d):
    return flagship(spark, d)
