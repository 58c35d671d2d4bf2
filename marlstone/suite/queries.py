"""A program for each operator of the language, over the driver's tables, with the
SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import frames, identity
from ..catalog.model import OWN
from ..functions.scalar import is_v7
from ..session import Engine
from ..streaming.run import StreamEngine, start, working_folder
from .models import WAREHOUSE

Query = Callable[[SparkSession, str], DataFrame]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, WAREHOUSE, sf_dir)


PROGRAMS: dict[str, tuple[str, dict, str]] = {}


def _add(name: str, program: str, sql: str, **params) -> None:
    PROGRAMS[name] = (program, params, sql)


_add("table_scan", "Supplier", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
_add("filter_ne", 'Customer.filter(c => c.c_mktsegment != "BUILDING")', "SELECT * FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'")
_add("filter_eq", 'Orders.filter(o => o.o_orderstatus == "F").map(o => o.{ o_orderkey, o_totalprice })', "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM 'F'")
_add("filter_not", 'Customer.filter(c => !(c.c_acctbal > 0)).map(c => c.{ c_custkey, c_acctbal })', "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal > 0)")
_add("filter_and", 'Lineitem.filter(l => l.l_returnflag == "R" && l.l_quantity < 10).map(l => l.{ l_orderkey, l_linenumber, l_quantity, l_extendedprice })', "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10")
_add("filter_or", 'Part.filter(p => p.p_size <= 2 || p.p_size >= 49).map(p => p.{ p_partkey, p_size })', "SELECT p_partkey, p_size FROM part WHERE p_size <= 2 OR p_size >= 49")
_add("filter_cmp", "Events.filter(e => e.value > 50).map(e => e.{ event_id, value })", "SELECT event_id, value FROM events WHERE value > 50")
_add("filter_bool_field", "Part.map(p => p.{ p_partkey, large: p_size > 25 }).filter(p => p.large)", "SELECT p_partkey, p_size > 25 AS large FROM part WHERE p_size > 25")
_add("project_shorthand", "Nation.map(n => n.{ n_nationkey, n_name })", "SELECT n_nationkey, n_name FROM nation")
_add("project_named", "Customer.map(c => c.{ id: c_custkey, name: c_name.lower(), rich: c_acctbal > 5000 })", "SELECT c_custkey AS id, lower(c_name) AS name, c_acctbal > 5000 AS rich FROM customer")
_add("project_spread", "Region.map(r => r.{ *, display_name: r_name.lower() })", "SELECT *, lower(r_name) AS display_name FROM region")
_add("project_member", "Nation.map(n => n.n_name)", "SELECT n_name FROM nation")
_add("project_null_check", "Events.map(e => e.{ event_id, has_user: user_id != null })", "SELECT event_id, user_id IS NOT NULL AS has_user FROM events")
_add("expr_arithmetic", "Lineitem.map(l => l.{ l_orderkey, l_linenumber, l_partkey, more: l_linenumber + 1, less: l_quantity - 1, twice: l_quantity * 2, part: l_quantity / 4, rest: l_linenumber % 3 })", "SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber + 1 AS more, l_quantity - 1 AS less, l_quantity * 2 AS twice, l_quantity / 4 AS part, l_linenumber % 3 AS rest FROM lineitem")
_add("fn_lower", "Part.map(p => p.{ p_partkey, brand: p_brand.lower() })", "SELECT p_partkey, lower(p_brand) AS brand FROM part")
_add("fn_trim", 'Supplier.map(s => s.{ s_suppkey, name: s_name.trim() })', "SELECT s_suppkey, trim(s_name) AS name FROM supplier")
_add("micro_inline", 'micro clean(value: utf8) -> utf8 { let t = value.trim() t.lower() } Customer.filter(c => clean(c.c_mktsegment) == "machinery").map(c => c.{ c_custkey, segment: clean(c_mktsegment) })', "SELECT c_custkey, lower(trim(c_mktsegment)) AS segment FROM customer WHERE lower(trim(c_mktsegment)) = 'machinery'")
_add("macro_durable", "Nation.map(n => n.{ n_nationkey, name: spoken(n_name) })", "SELECT n_nationkey, lower(trim(n_name)) AS name FROM nation")
_add("udf_durable", "Lineitem.map(l => l.{ l_orderkey, l_linenumber, l_partkey, net: net(l_extendedprice, l_discount) })", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
_add("const_value", "Part.filter(p => p.p_retailprice > floor_price).map(p => p.{ p_partkey, p_retailprice })", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 1500.0")
_add("free_params", "Orders.filter(o => o.o_totalprice > least).map(o => o.{ o_orderkey, o_totalprice })", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000", least=200000.0)
_add("static_path", "Customer::filter(c => c.c_acctbal > 9000).map(c => c.{ c_custkey, c_acctbal })", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000")
_add("sort_take", "Orders.sort_by(o => o.o_totalprice).take(25)", "SELECT * FROM orders ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 25")
_add("sort_map", "Supplier.sort_by(s => s.s_acctbal).map(s => s.{ s_suppkey, s_acctbal }).collect()", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal NULLS LAST, s_suppkey")
_add("get_by_key", "Customer.get(7)?", "SELECT * FROM customer WHERE c_custkey = 7")
_add("ref_one_hop", "Customer.map(c => c.{ c_custkey, nation: c_nationkey.n_name })", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
_add("ref_two_hop", 'Supplier.filter(s => s.s_nationkey.n_regionkey.r_name == "ASIA").map(s => s.{ s_suppkey, nation: s_nationkey.n_name, region: s_nationkey.n_regionkey.r_name })', "SELECT s_suppkey, n_name AS nation, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_add("ref_three_hop", "Lineitem.filter(l => l.l_quantity > 45).map(l => l.{ l_orderkey, l_linenumber, l_partkey, customer: l_orderkey.o_custkey.c_name, nation: l_orderkey.o_custkey.c_nationkey.n_name, part: l_partkey.p_name })", "SELECT l_orderkey, l_linenumber, l_partkey, c_name AS customer, n_name AS nation, p_name AS part FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45")
_add("ref_optional", "Events.map(e => e.{ event_id, who: user_id.c_name })", "SELECT event_id, c_name AS who FROM events LEFT JOIN customer ON user_id = c_custkey")
_add("ref_load", "Orders.load(o => o.o_custkey).filter(o => o.o_custkey.c_acctbal < 0).map(o => o.{ o_orderkey, balance: o_custkey.c_acctbal })", "SELECT o_orderkey, c_acctbal AS balance FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")
_add("ref_projection", "Nation.map(n => n.n_regionkey.{ r_regionkey, r_name })", "SELECT r_regionkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
_add("sort_ref_take", 'let rich = Customer.filter(c => c.c_mktsegment != "BUILDING").sort_by(c => c.c_acctbal).take(20).map(c => c.{ c_custkey, name: c_name.lower(), nation: c_nationkey.n_name })\nrich', "SELECT c_custkey, lower(c_name) AS name, n_name AS nation FROM (SELECT * FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING' ORDER BY c_acctbal NULLS LAST, c_custkey LIMIT 20) LEFT JOIN nation ON c_nationkey = n_nationkey")
_add("construct_list", 'let rs = [Region { r_regionkey: 90, r_name: "NORTH" }, Region { r_regionkey: 91, r_name: "SOUTH" }]\nrs', "SELECT * FROM (VALUES (90, 'NORTH'), (91, 'SOUTH')) t(r_regionkey, r_name)")
_add("insert_one", 'Region { r_regionkey: 77, r_name: "WEST" }.insert()', "SELECT 77 AS r_regionkey, 'WEST' AS r_name")
_add("insert_list", '[Nation { n_nationkey: 100, n_name: "A", n_regionkey: 0 }, Nation { n_nationkey: 101, n_name: "B", n_regionkey: 1 }].insert()', "SELECT * FROM (VALUES (100, 'A', 0), (101, 'B', 1)) t(n_nationkey, n_name, n_regionkey)")
_add("update_object", 'Customer.filter(c => c.c_acctbal < 0).update({ c_mktsegment: "WATCH" })', "SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'WATCH' AS c_mktsegment FROM customer WHERE c_acctbal < 0")
_add("update_lambda", "Part.filter(p => p.p_size > 40).update(p => { p_size: p.p_size + 1, p_name: p.p_brand })", "SELECT p_partkey, p_brand AS p_name, p_brand, p_type, p_size + 1 AS p_size, p_retailprice FROM part WHERE p_size > 40")
_add("update_entity", 'let c = Customer.get(3)?\nc.update { c_name: "renamed" }', "SELECT c_custkey, 'renamed' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 3")
_add("delete_where", "Supplier.filter(s => s.s_acctbal < 0).delete()", "SELECT * FROM supplier WHERE s_acctbal < 0")
_add("delete_entity", "let n = Nation.get(4)?\nn.delete()", "SELECT * FROM nation WHERE n_nationkey = 4")
_add("list_field", "Customer.map(c => c.{ c_custkey, both: [c_name, c_mktsegment] })", "SELECT c_custkey, [c_name, c_mktsegment] AS both FROM customer")
_add("enum_compare", "Labels.filter(l => l.quality == Quality.Good).map(l => l.{ doc_id, quality })", "SELECT doc_id, quality FROM labels WHERE quality = 1")
_add("let_chain", "let a = Orders.filter(o => o.o_totalprice > 100000)\nlet b = a.filter(o => o.o_orderstatus == \"O\")\nlet c = b.map(o => o.{ o_orderkey, o_custkey })\nc", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
_add("change_then_read", 'let gone = Supplier.filter(s => s.s_acctbal < 0).delete()\nSupplier.map(s => s.{ s_suppkey, s_acctbal })', "SELECT s_suppkey, s_acctbal FROM supplier WHERE NOT coalesce(s_acctbal < 0, false)")

_add("insert_mapped", "Region.map(r => Nation { n_nationkey: r.r_regionkey + 100, n_name: r.r_name.lower(), n_regionkey: r.r_regionkey }).insert()", "SELECT CAST(r_regionkey + 100 AS INTEGER) AS n_nationkey, lower(r_name) AS n_name, r_regionkey AS n_regionkey FROM region")
_add("take_param", "Orders.sort_by(o => o.o_totalprice).take(n).map(o => o.{ o_orderkey, o_totalprice })", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 30", n=30)
_add("sort_after_map", "Orders.map(o => o.{ o_orderpriority, o_totalprice }).sort_by(o => o.o_orderpriority).take(40)", "SELECT o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority NULLS LAST, o_orderkey LIMIT 40")
_add("entity_read", "let c = Customer.get(4)?\nOrders.filter(o => o.o_totalprice < c.c_acctbal).map(o => o.{ o_orderkey, name: c.c_name, nation: c.c_nationkey.n_name })", "SELECT o_orderkey, c_name AS name, n_name AS nation FROM orders, customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 4 AND o_totalprice < c_acctbal")
_add("entity_projection", "let o = Orders.get(5)?\no.{ o_orderkey, who: o_custkey.c_name }", "SELECT o_orderkey, c_name AS who FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 5")
_add("enum_name", "Labels.map(l => l.{ doc_id, name: Quality.name(quality) })", "SELECT doc_id, CASE quality WHEN 0 THEN 'Poor' WHEN 1 THEN 'Good' END AS name FROM labels")
_add("flag_has", "Part.filter(p => p.p_size.has(SizeBit.Four) && p.p_size.has(8)).map(p => p.{ p_partkey, p_size, even: !p.p_size.has(SizeBit.One) })", "SELECT p_partkey, p_size, (p_size & 1) = 0 AS even FROM part WHERE (p_size & 12) = 12")

STATES: dict[str, tuple[str, str, str]] = {
    "state_after_insert": ("Region", 'Region { r_regionkey: 77, r_name: "WEST" }.insert()', "SELECT * FROM region UNION ALL SELECT 77, 'WEST'"),
    "state_after_update": ("Orders", 'Orders.filter(o => o.o_orderstatus == "P").update(o => { o_totalprice: o.o_totalprice + 1 })', "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders"),
    "state_after_delete": ("Customer", 'Customer.filter(c => c.c_acctbal < 0).delete()', "SELECT * FROM customer WHERE NOT coalesce(c_acctbal < 0, false)"),
}

_OLD = "table User { @@user_id: uuid, user_name: utf8, old: i32 } class Extra { note: utf8 }"
_NEW = "table Person { @@user_id: uuid, name: utf8?, extra: i64 }"


def _manifest(types: list[tuple[list[str], int, str, list[tuple[str, int, int]]]]) -> dict:
    return {"formatVersion": OWN.manifest, "types": [{"canonicalPath": p, "typeId": i, "kind": k, "fields": [{"canonicalName": n, "fieldId": f, "virtualFieldIndex": s} for n, f, s in fs]} for p, i, k, fs in types]}


def evolution() -> tuple[dict, dict]:
    """Two bound snapshots of a small model: renamed, changed, removed, added."""
    from ..catalog import projection

    old = _manifest([(["User"], 1, "table", [("user_id", 10, 0), ("user_name", 11, 1), ("old", 12, 2)]), (["Extra"], 2, "class", [("note", 20, 0)])])
    new = _manifest([(["Person"], 1, "table", [("user_id", 10, 0), ("name", 11, 1), ("extra", 13, 3)])])
    return identity.bind(projection.project_schema(projection.parse(_OLD)), old), identity.bind(projection.project_schema(projection.parse(_NEW)), new)


def _affected_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).change("Orders.filter(o => o.o_totalprice < 50000).delete()").count()


def _query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query("customers_of", segment="AUTOMOBILE", least=1000.0)


_NOTES = """
table Note { @@note_id: i64, @title: utf8, kind: utf8 = "plain", weight: f64 = 1.5, level: u8 = 3, parent: &Note? = null, more: utf8? }
class Entry { key: i64, label: utf8, price: f64 }
"""


def _insert_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after rows made from a table were inserted: defaults, and keys and
    unique fields that are checked against what there was."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS key", "concat('order ', o_orderkey) AS label", "o_totalprice AS price")
    old = spark.range(5).selectExpr("-1 - id AS note_id", "concat('old ', id) AS title", "'x' AS kind", "0D AS weight", "1 AS level", "cast(null AS bigint) AS parent", "cast(null AS string) AS more")
    e = Engine(spark, _NOTES, frames={"Entry": orders, "Note": old})
    return e.states("Entry.filter(s => s.price > 200000).map(s => Note { note_id: s.key, title: s.label }).insert()")["Note"]


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a stream of events and a table that stands still give, run to its end."""
    e = StreamEngine(spark, WAREHOUSE, sf_dir, {"Events": f"{sf_dir}/event[s].parquet"})  # a pattern: a stream takes no single file by its name
    df, at = e.run("Events.filter(e => e.value > 20).map(e => e.{ event_id, kind: event_type.lower(), who: user_id.c_name })"), working_folder(spark)
    start(df, f"{at}/checkpoint", f"{at}/out").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def _catalog_warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's fields as a bound catalog has them."""
    from ..catalog import projection

    types = projection.project_schema(projection.parse(WAREHOUSE))
    ids = _manifest([(t["canonicalPath"], i, t["kind"], [(f["canonicalName"], 100 * i + k, k) for k, f in enumerate(t["fields"])]) for i, t in enumerate(types, 1)])
    df = frames.fields(spark, identity.bind(types, ids))
    return df.where("type_path <> 'warehouse::Embeddings'").select(F.lower(F.element_at(F.split("type_path", "::"), -1)).alias("type"), "field_name", F.col("slot").alias("slot"))


_OLD_FIELDS = "SELECT CAST(p_size AS BIGINT) AS type_id, concat('T', p_size) AS type_path, 'table' AS kind, CAST(p_partkey AS BIGINT) AS field_id, p_name AS field_name, p_brand AS content FROM {part}"
_NEW_FIELDS = "SELECT type_id, CASE WHEN type_id % 4 = 0 THEN concat(type_path, 'x') ELSE type_path END AS type_path, CASE WHEN type_id % 9 = 0 THEN 'class' ELSE kind END AS kind, field_id, CASE WHEN field_id % 5 = 0 THEN concat(field_name, '2') ELSE field_name END AS field_name, CASE WHEN field_id % 3 = 0 THEN 'other' ELSE content END AS content FROM {old} WHERE field_id % 7 <> 0 AND type_id <> 13 UNION ALL SELECT CASE WHEN field_id % 2 = 0 THEN type_id ELSE 1000 + type_id END, CASE WHEN field_id % 2 = 0 THEN CASE WHEN type_id % 4 = 0 THEN concat(type_path, 'x') ELSE type_path END ELSE concat('N', type_id) END, CASE WHEN field_id % 2 = 0 AND type_id % 9 = 0 THEN 'class' ELSE kind END, 10000000 + field_id, field_name, content FROM {old} WHERE field_id % 11 = 0 AND type_id <> 13"


def _catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two large snapshots, made from a table, compared."""
    old = spark.sql(_OLD_FIELDS.format(part="{part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return frames.difference(old, spark.sql(_NEW_FIELDS, old=old))


_CATALOG_DIFF_SQL = f"""
WITH o AS ({_OLD_FIELDS.format(part='part')}), n AS ({_NEW_FIELDS.format(old='o')}),
f AS (SELECT coalesce(o.type_id, n.type_id) AS type_id, coalesce(o.field_id, n.field_id) AS field_id, o.field_id AS a, n.field_id AS b, o.field_name AS na, n.field_name AS nb, o.content AS ca, n.content AS cb
      FROM o FULL JOIN n ON o.type_id = n.type_id AND o.field_id = n.field_id),
kept AS (SELECT * FROM f WHERE type_id IN (SELECT type_id FROM o)),
t AS (SELECT coalesce(x.type_id, y.type_id) AS type_id, x.type_id AS a, y.type_id AS b, x.type_path AS pa, y.type_path AS pb, x.kind AS ka, y.kind AS kb
      FROM (SELECT DISTINCT type_id, type_path, kind FROM o) x FULL JOIN (SELECT DISTINCT type_id, type_path, kind FROM n) y ON x.type_id = y.type_id)
SELECT 'fieldRemoved' AS change, type_id, field_id FROM kept WHERE b IS NULL UNION ALL
SELECT 'fieldAdded', type_id, field_id FROM kept WHERE a IS NULL UNION ALL
SELECT 'fieldRenamed', type_id, field_id FROM kept WHERE na <> nb UNION ALL
SELECT 'fieldChanged', type_id, field_id FROM kept WHERE ca <> cb UNION ALL
SELECT 'typeRemoved', type_id, NULL FROM t WHERE b IS NULL UNION ALL
SELECT 'typeAdded', type_id, NULL FROM t WHERE a IS NULL UNION ALL
SELECT 'typeRenamed', type_id, NULL FROM t WHERE pa <> pb UNION ALL
SELECT 'typeKindChanged', type_id, NULL FROM t WHERE ka <> kb
"""


def _catalog_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.fields(spark, evolution()[0]).select("type_path", "field_id", "field_name", "type", "slot")


def _identity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = evolution()
    return frames.difference(frames.fields(spark, old), frames.fields(spark, new))


def _tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = evolution()
    return frames.tombstones(spark, identity.evolve(identity.begin(old), new))


def _uuid_v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = engine(spark, sf_dir).run("Nation.map(n => n.{ n_nationkey, id: uuid() })")
    return df.select("n_nationkey", is_v7(F.col("id")).alias("ok"))


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run("Nation.map(n => n.{ n_nationkey, past: now() > now() })")


OTHERS: dict[str, tuple[Query, str]] = {
    "affected_count": (_affected_count, "SELECT count(*) AS affected FROM orders WHERE o_totalprice < 50000"),
    "query_params": (_query_params, "SELECT * FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND c_acctbal > 1000"),
    "insert_defaults": (_insert_defaults, "SELECT o_orderkey AS note_id, 'order ' || o_orderkey AS title, 'plain' AS kind, 1.5::DOUBLE AS weight, 3 AS level, NULL::BIGINT AS parent, NULL::VARCHAR AS more FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT -1 - i, 'old ' || i, 'x', 0, 1, NULL, NULL FROM range(5) r(i)"),
    "stream_map": (_stream, "SELECT event_id, lower(event_type) AS kind, c_name AS who FROM events LEFT JOIN customer ON user_id = c_custkey WHERE value > 20"),
    "catalog_warehouse": (_catalog_warehouse, "SELECT DISTINCT table_name AS type, column_name AS field_name, CAST(ordinal_position - 1 AS BIGINT) AS slot FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'supplier', 'customer', 'part', 'orders', 'lineitem', 'events', 'documents', 'labels')"),
    "catalog_diff": (_catalog_diff, _CATALOG_DIFF_SQL),
    "catalog_fields": (_catalog_fields, "SELECT type_path, CAST(field_id AS BIGINT) AS field_id, field_name, type, CAST(slot AS BIGINT) AS slot FROM (VALUES ('User', 10, 'user_id', 'uuid', 0), ('User', 11, 'user_name', 'utf8', 1), ('User', 12, 'old', 'i32', 2), ('Extra', 20, 'note', 'utf8', 0)) t(type_path, field_id, field_name, type, slot)"),
    "identity_diff": (_identity_diff, "SELECT change, CAST(type_id AS BIGINT) AS type_id, CAST(field_id AS BIGINT) AS field_id FROM (VALUES ('fieldRenamed', 1, 11), ('fieldChanged', 1, 11), ('fieldRemoved', 1, 12), ('fieldAdded', 1, 13), ('fieldRemoved', 2, 20), ('typeRenamed', 1, NULL), ('typeRemoved', 2, NULL)) t(change, type_id, field_id)"),
    "identity_tombstones": (_tombstones, "SELECT what, CAST(type_id AS BIGINT) AS type_id, CAST(field_id AS BIGINT) AS field_id, CAST(retired_at AS BIGINT) AS retired_at FROM (VALUES ('type', 2, NULL, 1), ('field', 1, 12, 1), ('field', 2, 20, 1)) t(what, type_id, field_id, retired_at)"),
    "uuid_v7": (_uuid_v7, "SELECT n_nationkey, true AS ok FROM nation"),
    "now_constant": (_now, "SELECT n_nationkey, false AS past FROM nation"),
}


def _program(name: str) -> Query:
    program, params, _ = PROGRAMS[name]
    return lambda spark, sf_dir: engine(spark, sf_dir).run(program, **params)


def _state(name: str) -> Query:
    table, program, _ = STATES[name]
    return lambda spark, sf_dir: engine(spark, sf_dir).states(program)[table]


def queries() -> dict[str, Query]:
    return {n: _program(n) for n in PROGRAMS} | {n: _state(n) for n in STATES} | {n: f for n, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, _, sql) in PROGRAMS.items()} | {n: sql for n, (_, _, sql) in STATES.items()} | {n: sql for n, (_, sql) in OTHERS.items()}
