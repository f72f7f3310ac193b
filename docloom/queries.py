"""Queries over the test tables, one for each operator, with the SQL that must agree with them.

Arrays are shown as joined text, sums are rounded; nothing else is done for the comparison's sake.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import scalars
from docloom.functions.predicate import Predicate
from docloom.functions.templates import Template, first_rendered, index_name, key_id, matches
from docloom.functions.transforms import Transform, iso_date
from docloom.operators import changes as ch
from docloom.operators import children as rel
from docloom.operators import merge, shape
from docloom.operators.store import Store, point_id
from docloom.plans import admin
from docloom.plans.changes import ChangePlan, document_type
from docloom.plans.config import ChildRule, CountRule, JoinRule, View, as_json, documents, from_toml, related_ids, with_index
from docloom.sources import readers
from docloom.sources.changelog import log_rows
from docloom.streaming import apply, polls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keeps(df: DataFrame, where: str) -> DataFrame:
    return df.where(Predicate(where).column(df.schema))


def joined(items: Column, *fields: str) -> Column:
    """An array of structs as text: fields by ``:``, elements by ``|``."""
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", *(x[f].cast("string") for f in fields))), "|")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share; a folder of this machine only in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = f"file://{tempfile.gettempdir()}"
    return f"{named.rstrip('/')}/docloom-{name}-{os.urandom(8).hex()}"


# -- the flagship: customers with capped orders, a count, a filter and a hidden column -------------------


CUSTOMER_VIEW = View(
    table="customer", index="customers", key=["c_custkey"], where="c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0", exclude=["c_nationkey"],
    transform={"c_name": Transform("hash")}, rename={"c_mktsegment": "segment"}, constants={"source": "{schema}.{table}"},
    children=[ChildRule("orders", "orders", "o_custkey", order=["o_orderkey"], columns=["o_orderkey", "o_orderstatus"], max_rows=3)],
    counts=[CountRule("open_orders", "orders", "o_custkey", "o_orderstatus = 'O'")],
)


@query("""
    WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn, count(*) OVER (PARTITION BY o_custkey) n FROM orders),
    a AS (SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, '|' ORDER BY rn) FILTER (rn <= 3) items, max(n) n FROM o GROUP BY 1),
    c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') k FROM orders GROUP BY 1)
    SELECT c_custkey::VARCHAR AS id, substr(sha256('"' || c_name || '"'), 1, 16) AS c_name, c_mktsegment AS segment, 'public.customer' AS source, coalesce(items, '') AS orders,
      CASE WHEN n > 3 THEN true END AS orders_truncated, CASE WHEN n > 3 THEN n END AS orders_total, coalesce(k, 0) AS open_orders
    FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0""")
def customer_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(CUSTOMER_VIEW, {t: table(spark, sf_dir, t) for t in ("customer", "orders")})
    return docs.select(F.col("_id").alias("id"), "c_name", "segment", "source", joined(F.col("orders"), "o_orderkey", "o_orderstatus").alias("orders"), "orders_truncated", "orders_total", "open_orders")


# -- projection and shaping ------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer")
def proj_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.project(table(spark, sf_dir, "customer"), ["c_custkey", "c_name"])


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def proj_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.project(table(spark, sf_dir, "customer"), exclude=["c_acctbal"])


@query("SELECT n_nationkey AS n_regionkey, n_regionkey AS n_nationkey, n_name FROM nation")
def rename_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.rename(table(spark, sf_dir, "nation"), {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey"})


@query("SELECT r_regionkey, r_name, 'public.region' AS origin, 7 AS shard FROM region")
def constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.constants(table(spark, sf_dir, "region"), {"origin": "{schema}.{table}", "shard": 7}, "public", "region")


@query("SELECT o_orderkey, o_custkey::VARCHAR AS routing FROM orders")
def routing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", shape.routing("o_custkey").alias("routing"))


@query("SELECT 'events-' || event_type AS index, count(*) AS n FROM events GROUP BY 1")
def index_template_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select(index_name("events-{event_type}", df.schema).alias("index")).groupBy("index").agg(F.count("*").alias("n"))


@query("SELECT 'events-' || event_type AS index, ('events-' || event_type) LIKE 'events-c%' AS matched, count(*) AS n FROM events GROUP BY ALL")
def index_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("events-"), "event_type")
    return table(spark, sf_dir, "events").groupBy(name.alias("index"), matches("events-c*", name).alias("matched")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey || '-' || l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1")
def id_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.groupBy(Template.parse("{l_orderkey}-{l_linenumber}").render(df.schema).alias("id")).agg(F.count("*").alias("n"))


@query("SELECT 'l_linenumber=' || l_linenumber || ',l_orderkey=' || l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1")
def composite_pk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(key_id(["l_orderkey", "l_linenumber"]).alias("id")).agg(F.count("*").alias("n"))


@query("""SELECT substr(sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 32) AS id, count(*) AS n FROM events GROUP BY 1""")
def content_id_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", "event_type")
    return df.groupBy(scalars.content_id(df.schema).alias("id")).agg(F.count("*").alias("n"))


# -- predicates ------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice >= 1000.5 AND o_orderstatus <> 'F') OR (o_orderkey < 100 AND NOT o_orderpriority = '1-URGENT')")
def filter_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keeps(table(spark, sf_dir, "orders"), "o_totalprice >= 1000.5 AND o_orderstatus <> 'F' OR o_orderkey < 100 AND NOT o_orderpriority = '1-URGENT'").select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT *, nullif(o_orderstatus, 'P') AS s FROM orders) WHERE NOT (s = 'O') OR (s IS NULL AND o_orderkey > 500)")
def filter_3vl(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P")))
    return keeps(df, "NOT s = 'O' OR (s IS NULL AND o_orderkey > 500)").select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT *, nullif(o_orderstatus, 'P') AS s FROM orders) WHERE s NOT IN ('O') AND o_orderkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def filter_in_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P")))
    return keeps(df, "s NOT IN ('O') AND o_orderkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)").select("o_orderkey")


@query("SELECT p_partkey FROM (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE p_size::VARCHAR || '.0' END AS t FROM part) WHERE TRY_CAST(t AS DOUBLE) > 25 OR (TRY_CAST(t AS DOUBLE) = 3)")
def filter_numeric_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0")))
    return keeps(table(spark, sf_dir, "part").withColumn("t", t), "t > 25 OR t = 3").select("p_partkey")


# -- transforms ------------------------------------------------------------------------------------------


def transformed(df: DataFrame, column: str, rule: Transform) -> DataFrame:
    return shape.transform(df, {column: rule}, "public", "t")


@query("""SELECT c_custkey, substr(sha256('"' || c_name || '"'), 1, 16) AS c_name FROM customer""")
def xf_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transformed(table(spark, sf_dir, "customer"), "c_name", Transform("hash")).select("c_custkey", "c_name")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN '***' END AS s FROM orders")
def xf_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P")))
    return transformed(df, "s", Transform("redact")).select("o_orderkey", "s")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus, (o_orderstatus NOT IN ('O', 'F'))::INT AS missed FROM orders")
def xf_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transformed(table(spark, sf_dir, "orders"), "o_orderstatus", Transform("lookup", map={"O": "open", "F": "done"})).select("o_orderkey", "o_orderstatus", F.size("_unconverted").alias("missed"))


@query("SELECT c_custkey, CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'other' END AS c_nationkey FROM customer")
def xf_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transformed(table(spark, sf_dir, "customer"), "c_nationkey", Transform("lookup", map={"1": "one", "2": "two"}, default="other")).select("c_custkey", "c_nationkey")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def xf_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transformed(table(spark, sf_dir, "events"), "props", Transform("json")).select("event_id", F.try_variant_get("props", "$.k", "bigint").alias("k"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> ''), '|') AS p_name FROM part")
def xf_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transformed(table(spark, sf_dir, "part"), "p_name", Transform("split", by=" ")).select("p_partkey", F.array_join("p_name", "|").alias("p_name"))


@query("""
    WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'bad' WHEN 1 THEN ' ' || p_size || ' ' WHEN 2 THEN p_size || '.5' ELSE '1e400' END AS v FROM part)
    SELECT p_partkey, TRY_CAST(CASE WHEN regexp_full_match(trim(v), '[0-9]+') THEN trim(v) END AS BIGINT) AS whole, CASE WHEN p_partkey % 4 IN (1, 2) THEN TRY_CAST(trim(v) AS DOUBLE) END AS number, (p_partkey % 4 IN (0, 3))::INT AS missed FROM t""")
def xf_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    v = F.when(n == 0, "bad").when(n == 1, F.concat(F.lit(" "), size, F.lit(" "))).when(n == 2, F.concat(size, F.lit(".5"))).otherwise("1e400")
    out = transformed(table(spark, sf_dir, "part").withColumn("v", v), "v", Transform("number"))
    return out.select("p_partkey", F.col("v.integer").alias("whole"), F.col("v.number").alias("number"), F.size("_unconverted").alias("missed"))


@query("""
    WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS d FROM orders)
    SELECT o_orderkey, CASE WHEN d = 'soon' THEN d ELSE strftime(strptime(d, '%d/%m/%Y'), '%Y-%m-%d') END AS d, strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:00' AS z FROM t JOIN orders o USING (o_orderkey)""")
def xf_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    z = F.concat(F.date_format("o_orderdate", "dd.MM.yyyy HH:mm:ss"), F.lit(" +0200"))
    df = table(spark, sf_dir, "orders").withColumns({"d": d, "z": z})
    return transformed(df, "d", Transform("date", from_="%d/%m/%Y")).select("o_orderkey", "d", iso_date(F.col("z"), "%d.%m.%Y %H:%M:%S %z").alias("z"))


# Tokens of the regions' names under the example key.
@query("""SELECT r_regionkey, t AS r_name FROM region JOIN (VALUES ('AFRICA', '6k-RJlsCzdEzGlxorcfX16T8e_j2dQ'), ('AMERICA', 'i6BnxMQtASl4jiPOVZvSlfyQKpK_Cy0'), ('ASIA', 'XTlLMaerGQ-6ZOnVgOKWBs5aMRQ'), ('EUROPE', 'xumzgWTxFM9PGyX2D29-PfL2gTIq1w'), ('MIDDLE EAST', 'KXWQp315amfQT5oZf6if7VVgV6MCLz1g4Rem')) AS k(n, t) ON n = r_name""")
def xf_pseudonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    os.environ.setdefault("DOCLOOM_EXAMPLE_KEY", bytes(range(64)).hex())
    return transformed(table(spark, sf_dir, "region"), "r_name", Transform("pseudonym", key_env="DOCLOOM_EXAMPLE_KEY", scope="public.region.r_name")).select("r_regionkey", "r_name")


# -- related rows ----------------------------------------------------------------------------------------


@query("SELECT c_custkey, coalesce((SELECT string_agg(o_orderkey, '|' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'), '') AS items FROM customer")
def children_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = rel.Child("orders", table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], where="o_orderstatus = 'P'")
    return rel.attach(table(spark, sf_dir, "customer"), "c_custkey", child).select("c_custkey", joined(F.col("orders"), "o_orderkey").alias("items"))


@query("""
    WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn, count(*) OVER (PARTITION BY o_custkey) n FROM orders)
    SELECT c_custkey, coalesce(string_agg(o_orderkey, '|' ORDER BY rn) FILTER (rn <= 5), '') AS items, CASE WHEN max(n) > 5 THEN true END AS cut, CASE WHEN max(n) > 5 THEN max(n) END AS total
    FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY c_custkey""")
def children_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = rel.Child("orders", table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], max_rows=5)
    out = rel.attach(table(spark, sf_dir, "customer"), "c_custkey", child)
    return out.select("c_custkey", joined(F.col("orders"), "o_orderkey").alias("items"), F.col("orders_truncated").alias("cut"), F.col("orders_total").alias("total"))


@query("SELECT o_orderkey, coalesce((SELECT string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS items FROM orders")
def children_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = rel.Child("lines", table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], columns=["l_linenumber", "l_partkey", "l_suppkey"])
    return rel.attach(table(spark, sf_dir, "orders"), "o_orderkey", child).select("o_orderkey", joined(F.col("lines"), *child.columns).alias("items"))


@query("SELECT n_nationkey, coalesce((SELECT string_agg(s_suppkey || ':' || s_name, '|' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS items FROM nation")
def nested_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = rel.Child("suppliers", table(spark, sf_dir, "supplier"), "s_nationkey", ["s_suppkey"], exclude=["s_acctbal"])
    out = shape.rename_nested(rel.attach(table(spark, sf_dir, "nation"), "n_nationkey", child), "suppliers", {"s_suppkey": "id", "s_name": "name"})
    return out.select("n_nationkey", joined(F.col("suppliers"), "id", "name").alias("items"))


@query("SELECT d.doc_id, l.quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def child_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = rel.Child("label", table(spark, sf_dir, "labels"), "doc_id", ["doc_id"], single=True)
    out = rel.attach(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", child)
    return out.select("doc_id", F.col("label.quality").alias("quality"), F.col("label").isNull().alias("missing"))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def child_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = rel.Child("label", table(spark, sf_dir, "labels"), "doc_id", ["doc_id"], columns=["quality", "toxic"], single=True)
    return shape.flatten(rel.attach(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", child), "label")


@query("""
    WITH j AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
    SELECT p_partkey, coalesce(string_agg(s_name, '|' ORDER BY s_suppkey), '') AS suppliers FROM part LEFT JOIN j ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def children_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = rel.Child("suppliers", table(spark, sf_dir, "supplier"), "s_suppkey", ["s_suppkey"], through=rel.Through(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey"))
    return rel.attach(table(spark, sf_dir, "part"), "p_partkey", child).select("p_partkey", joined(F.col("suppliers"), "s_name").alias("suppliers"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def aggregate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.attach_count(table(spark, sf_dir, "customer"), "c_custkey", "n", table(spark, sf_dir, "orders"), "o_custkey").select("c_custkey", "n")


@query("SELECT c_custkey, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 100000) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def aggregate_count_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.attach_count(table(spark, sf_dir, "customer"), "c_custkey", "n", table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus = 'O' AND o_totalprice > 100000").select("c_custkey", "n")


@query("SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS n FROM nation")
def aggregate_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.attach_count(table(spark, sf_dir, "nation"), "n_nationkey", "n", table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal < 0").select("n_nationkey", "n")


@query("SELECT count(*) FILTER (n > 15) AS cut_parents, max_by(o_custkey, n * 1000000000 + o_custkey) AS largest, max(n) AS largest_total FROM (SELECT o_custkey, count(*) n FROM orders GROUP BY 1)")
def truncated_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.collection_report(rel.Child("orders", table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], max_rows=15))


@query("SELECT DISTINCT c_custkey, c_name FROM customer JOIN (SELECT o_custkey k FROM orders UNION SELECT o_custkey + 1 FROM orders) ON k = c_custkey WHERE c_acctbal >= 0")
def affected_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order moved to its customer from the next one; customers in debt changed themselves."""
    changed = table(spark, sf_dir, "orders").withColumn("old_custkey", F.col("o_custkey") + 1)
    customers = table(spark, sf_dir, "customer")
    present = customers.where("c_acctbal < 0").select(F.col("c_custkey").alias("key"))
    return rel.refetch(customers, "c_custkey", rel.affected(changed, "o_custkey", "old_custkey", present=present)).select("c_custkey", "c_name")


@query("SELECT DISTINCT l_partkey AS p_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0")
def affected_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that suppliers in debt supply: changed children named by a junction."""
    junction = rel.Through(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    changed = table(spark, sf_dir, "supplier").where("s_acctbal < 0")
    return rel.affected(changed, "s_suppkey", through=junction).select(F.col("key").alias("p_partkey"))


# -- fan-out ---------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_partkey || '/' || word AS id, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)")
def fanout_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("word"))
    return shape.fan_out(df, "word", Template.parse("{p_partkey}/{word}"), key_id(["p_partkey"])).select("p_partkey", F.col("_id").alias("id"), "word")


@query("SELECT p_partkey, p_partkey || '/' || word AS id, word FROM (SELECT p_partkey, unnest(list_filter(list_transform(string_split(p_type, ' '), lambda x: trim(x)), lambda x: x <> '')) AS word FROM part)")
def fanout_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("word"))
    return shape.fan_out(df, "word", Template.parse("{p_partkey}/{word}"), key_id(["p_partkey"]), by=" ").select("p_partkey", F.col("_id").alias("id"), "word")


@query("""
    SELECT c_custkey, c_custkey::VARCHAR AS id, c_name AS name, NULL::BIGINT AS o FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, c_custkey || '-' || o_orderkey, o_orderpriority, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 = 1""")
def fanout_null_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = rel.Child("items", table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("name")), "o_custkey", ["o"], columns=["o", "name"])
    df = rel.attach(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name")), "c_custkey", items)
    n = F.col("c_custkey") % 3
    df = df.withColumn("items", F.when(n == 1, F.col("items")).when(n == 2, F.filter("items", lambda x: F.lit(False))))
    return shape.fan_out(df, "items", Template.parse("{c_custkey}-{o}"), key_id(["c_custkey"])).select("c_custkey", F.col("_id").alias("id"), "name", "o")


@query("""
    WITH b AS (SELECT DISTINCT event_type AS index, user_id::VARCHAR AS id FROM events), a AS (SELECT event_type, user_id::VARCHAR FROM events WHERE event_type <> 'view' AND value > 60)
    SELECT * FROM b EXCEPT SELECT * FROM a""")
def fanout_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' documents by event type, less those that the events of a large value still give."""
    df = table(spark, sf_dir, "events").select(F.col("event_type").alias("index"), F.col("user_id").cast("string").alias("id"), F.lit(None).cast("string").alias("routing"), "value")
    before, after = df.drop("value").distinct(), df.where("index <> 'view' AND value > 60")
    return ch.fan_out_diff(before, after).select("index", "id").distinct()


# -- changes and merging ---------------------------------------------------------------------------------

CHANGES = """chg AS (SELECT user_id::VARCHAR AS id, event_id + 1 AS version, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS action, value, event_type FROM events)"""


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic change log: events by user; an error deletes."""
    doc = F.struct("value", "event_type")
    action = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return table(spark, sf_dir, "events").select(F.lit("users").alias("index"), F.col("user_id").cast("string").alias("id"), F.lit(None).cast("string").alias("routing"), action.alias("action"), F.when(action == "upsert", doc).alias("doc"), (F.col("event_id") + 1).alias("version"), F.col("event_id").alias("seq"))


def shown(winning: DataFrame) -> DataFrame:
    return merge.documents(winning).select("id", F.col("doc.value").alias("value"), F.col("doc.event_type").alias("event_type"), "version")


LAST = f"WITH {CHANGES}, w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, seq DESC) rn FROM chg) SELECT id, value, event_type, version FROM w WHERE rn = 1 AND action = 'upsert'"


@query(LAST)
def lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(merge.versioned_winners(ops(spark, sf_dir)))


@query(LAST)
def lww_shuffled_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops(spark, sf_dir)
    odd, even = rows.where("version % 3 <> 0"), rows.where("version % 3 <> 1")
    first = merge.winners(even.repartition(7, F.xxhash64("seq")))
    return shown(merge.merge(merge.merge(first, odd), even))


@query(f"WITH {CHANGES}, w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version // 100 DESC, seq DESC) rn FROM chg) SELECT id, value, event_type, version // 100 + 1 AS version FROM w WHERE rn = 1 AND action = 'upsert'")
def equal_version_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(merge.versioned_winners(ops(spark, sf_dir).withColumn("version", F.floor(F.col("version") / 100) + 1)))


@query(f"""
    WITH {CHANGES}, v AS (SELECT *, CASE WHEN version % 50 = 0 THEN NULL ELSE version END AS ver FROM chg),
    f AS (SELECT id, max(seq) FILTER (ver IS NULL) AS floor FROM v GROUP BY 1),
    w AS (SELECT v.*, row_number() OVER (PARTITION BY v.id ORDER BY coalesce(ver, -1) DESC, seq DESC) rn FROM v JOIN f USING (id) WHERE floor IS NULL OR seq >= floor)
    SELECT id, value, event_type, ver AS version FROM w WHERE rn = 1 AND action = 'upsert'""")
def unversioned_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(merge.winners(ops(spark, sf_dir).withColumn("version", F.when(F.col("version") % 50 != 0, F.col("version")))))


@query(f"WITH {CHANGES}, w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) rn FROM chg) SELECT id, value FROM w WHERE rn = 1 AND value > 50 AND action = 'upsert'")
def row_leaves_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops(spark, sf_dir).select("index", "id", "routing", F.when(F.col("action") == "delete", "delete").otherwise("update").alias("op"), F.col("doc").alias("after"), "version", "seq")
    kept = ch.after_filter(rows, "value > 50").withColumn("action", F.when(F.col("op") == "delete", "delete").otherwise("upsert")).withColumnRenamed("after", "doc")
    return shown(merge.versioned_winners(kept.drop("op"))).select("id", "value")


@query("""
    WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'purchase' THEN 'm' || user_id ELSE 'u' || user_id END AS id, lag(CASE WHEN event_type = 'purchase' THEN 'm' || user_id ELSE 'u' || user_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events),
    o AS (SELECT id, event_id, 1 AS up FROM c UNION ALL SELECT old, event_id, 0 FROM c WHERE old IS NOT NULL AND old <> id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id DESC) rn FROM o)
    SELECT id, event_id + 1 AS version FROM r WHERE rn = 1 AND up = 1""")
def pk_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    name = F.concat(F.when(F.col("event_type") == "purchase", "m").otherwise("u"), F.col("user_id").cast("string"))
    old = F.lag(name).over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = df.withColumn("old", old).select(F.when(F.col("old").isNull(), "insert").otherwise("update").alias("op"), F.struct(name.alias("id"), "value").alias("after"), F.struct(F.col("old").alias("id")).alias("before"), (F.col("event_id") + 1).alias("version"), F.col("event_id").alias("seq"))
    made = ch.operations(rows, F.lit("users"), F.col("after.id"), F.lit("users"), F.col("before.id"))
    return merge.documents(merge.versioned_winners(made)).select("id", "version")


@query("SELECT event_id, user_id, CASE WHEN e.event_id % 2 = 0 THEN s.s_acctbal ELSE e.value END AS value, event_type FROM events e LEFT JOIN supplier s ON s_suppkey = user_id")
def toast_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.struct(F.col("s_acctbal").alias("value")).alias("doc"))
    left_out = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("value"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", left_out.alias("unchanged"), F.struct(F.when(F.col("event_id") % 2 == 1, F.col("value")).alias("value"), "event_type").alias("after"))
    return ch.complete(rows, stored, ["user_id"]).select("event_id", "user_id", "after.value", "after.event_type")


@query(LAST + " AND version > 9000")
def truncate_at_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(merge.truncate(merge.versioned_winners(ops(spark, sf_dir)), "use*", 9000))


@query(f"""
    WITH {CHANGES}, l AS (SELECT id, 8000 AS version, -1 AS seq, 'upsert' AS action, 0.0 AS value, 'load' AS event_type FROM (SELECT DISTINCT id FROM chg)),
    d AS (SELECT id, max(version) AS gone_at FROM chg WHERE action = 'delete' GROUP BY 1),
    a AS (SELECT * FROM chg UNION ALL SELECT l.* FROM l LEFT JOIN d USING (id) WHERE gone_at IS NULL OR gone_at <= l.version),
    w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, seq DESC) rn FROM a) SELECT id, event_type, version FROM w WHERE rn = 1 AND action = 'upsert'""")
def load_stream_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops(spark, sf_dir)
    loaded = rows.select("index", "id", "routing").distinct().select("*", F.lit("upsert").alias("action"), F.struct(F.lit(0.0).alias("value"), F.lit("load").alias("event_type")).alias("doc"), F.lit(8000).cast("long").alias("version"), F.lit(-1).cast("long").alias("seq"))
    kept = merge.without_deleted(loaded.drop("routing"), rows.where("action = 'delete'"), ["index", "id"]).withColumn("routing", F.lit(None).cast("string"))
    return shown(merge.versioned_winners(rows.unionByName(kept))).drop("value")


@query(f"WITH {CHANGES}, m AS (SELECT max(seq // 100) AS open FROM chg), w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) rn FROM chg, m WHERE seq // 100 < open) SELECT id, value, event_type, version FROM w WHERE rn = 1 AND action = 'upsert'")
def txn_commit_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops(spark, sf_dir).withColumn("txn_id", F.floor(F.col("seq") / 100))
    ends = rows.groupBy("txn_id").agg(F.max("version").alias("commit_lsn"))
    last = ends.agg(F.max("txn_id").alias("open"))
    commits = ends.join(F.broadcast(last), ends["txn_id"] < last["open"])  # one row
    return shown(merge.versioned_winners(ch.committed(rows, commits).drop("txn_id", "commit_lsn")))


@query("SELECT c_custkey::VARCHAR AS id, 'customer' AS name, NULL AS parent FROM customer UNION ALL SELECT 'o' || o_orderkey, 'order', o_custkey::VARCHAR FROM orders")
def join_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "customer").select(key_id(["c_custkey"]).alias("id"), "c_name", shape.join_field("customer").alias("j"))
    children = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), "o_orderstatus", shape.join_field("order", F.col("o_custkey").cast("string")).alias("j"))
    return ch.relation(parents, children, "shop").select("id", "j.name", "j.parent")


@query("SELECT o_orderkey::VARCHAR AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0 AND o_orderkey <= 5000")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").select(F.lit("shop").alias("index"), key_id(["o_orderkey"]).alias("id"), F.col("o_custkey").cast("string").alias("routing"), F.lit("upsert").alias("action"), F.col("o_custkey").cast("string").alias("parent_id"), F.col("o_orderkey").alias("version"))
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.lit("shop").alias("index"), key_id(["c_custkey"]).alias("id"), F.lit(5000).alias("version"))
    return merge.cascade(stored, gone).select("id")


@query("SELECT s_suppkey AS id, s_name AS name, 'supplier' AS kind, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, 'customer', c_mktsegment FROM customer")
def multi_table_one_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = shape.constants(shape.rename(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), {"s_suppkey": "id", "s_name": "name"}), {"kind": "{table}"}, "public", "supplier")
    b = shape.constants(shape.rename(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"c_custkey": "id", "c_name": "name", "c_mktsegment": "segment"}), {"kind": "{table}"}, "public", "customer")
    return ch.relation(a, b, "parties").drop("index")


# -- sources ---------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS op FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 700")
def soft_delete_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = readers.poll(table(spark, sf_dir, "events"), "event_id", 500, 700, "event_type = 'error'")
    return page.select(F.coalesce("after.event_id", "before.event_id").alias("event_id"), "op")


@query("SELECT max(event_id) AS watermark FROM (SELECT event_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 250)")
def poll_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.next_watermark(readers.poll(table(spark, sf_dir, "events"), "event_id", 100, 250))


@query("""SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderstatus = 'P' THEN 2 * o_totalprice ELSE o_totalprice END AS price FROM orders
    WHERE o_orderstatus <> 'F' AND CASE WHEN o_orderstatus = 'P' THEN 2 * o_totalprice ELSE o_totalprice END < 300000""")
def poll_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders polled into a store; then, in pages, those that were changed meanwhile: finished ones are flagged, pending ones cost twice as much, which takes some out of the view."""
    orders = table(spark, sf_dir, "orders").withColumn("gone", F.lit(False))
    status, later = F.col("o_orderstatus"), F.col("o_orderdate") + F.expr("INTERVAL 20 YEARS")
    moved = status.isin("F", "P")
    changed = orders.withColumns({"gone": status == "F", "o_totalprice": F.when(status == "P", 2 * F.col("o_totalprice")).otherwise(F.col("o_totalprice")), "o_orderdate": F.when(moved, later).otherwise(F.col("o_orderdate"))})
    view = View("orders", "orders", key=["o_orderkey"], where="o_totalprice < 300000", columns=["o_totalprice"], rename={"o_totalprice": "price"}, soft_delete="gone", poll_column="o_orderdate")
    store = Store(spark, work_dir(spark, "polled"), document_type([view], {"orders": orders}), buckets=4)
    for now, page in ((orders, None), (changed, orders.count() // 3 + 1)):
        tables = {"orders": now}
        plan = ChangePlan([view], {"orders": now.schema}, lambda tables=tables: tables, store.doc, store.lookup)
        polls.follow([view], lambda tables=tables: tables, store, lambda plan=plan: plan, page)
    return store.documents("orders").select("id", "doc.price")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (10, 700) ORDER BY o_custkey, o_orderkey LIMIT 40")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.key_page(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], [10, 700], 40).select("o_custkey", "o_orderkey")


@query("SELECT CASE WHEN o_orderkey < 100 THEN 0 WHEN o_orderkey < 5000 THEN 1 ELSE 2 END AS part, count(*) AS n FROM orders GROUP BY 1")
def range_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    part = F.coalesce(*(F.when(readers.in_range("o_orderkey", a, b), i) for i, (a, b) in enumerate(readers.ranges_of([100, 5000]))))
    return df.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT unnest(quantile_disc(o_orderkey, [0.25, 0.5, 0.75])) AS b FROM orders) SELECT (SELECT count(*) FROM b WHERE b <= o_orderkey)::INT AS part, count(*) AS n FROM orders GROUP BY 1")
def sampled_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    ranges = readers.ranges_of(readers.bounds(df, "o_orderkey", 4, share=1.0))
    part = F.coalesce(*(F.when(readers.in_range("o_orderkey", a, b), i) for i, (a, b) in enumerate(ranges)))
    return df.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("""
    WITH a AS (SELECT substr(column_name, 3) AS n, column_type AS t FROM (DESCRIBE customer)), b AS (SELECT substr(column_name, 3) AS n, column_type AS t FROM (DESCRIBE part))
    SELECT n AS column_name, CASE WHEN a.t IS NULL THEN 'added' WHEN b.t IS NULL THEN 'removed' ELSE 'retyped' END AS drift FROM a FULL JOIN b USING (n) WHERE a.t IS DISTINCT FROM b.t""")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would change if customers' rows became parts'."""
    bare = lambda t: T.StructType([T.StructField(f.name[2:], f.dataType) for f in table(spark, sf_dir, t).schema.fields])
    return spark.createDataFrame(readers.schema_drift(bare("customer"), bare("part")), "column_name string, drift string")


@query("SELECT event_id, upper(printf('%x', event_id * 1234567 // 4294967296)) || '/' || upper(printf('%x', event_id * 1234567 % 4294967296)) AS text, event_id * 1234567 AS back FROM events")
def lsn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = scalars.position_text(F.col("event_id") * 1234567)
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"), scalars.position_of(text).alias("back"))


@query("SELECT event_id, (event_id % 9 + 1) * 4294967296 + event_id * 13 AS token, 'binlog.' || lpad((event_id % 9 + 1)::VARCHAR, 6, '0') || ':' || event_id * 13 AS text FROM events")
def binlog_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = scalars.file_token(F.col("event_id") % 9 + 1, F.col("event_id") * 13)
    return table(spark, sf_dir, "events").select("event_id", token.alias("token"), scalars.file_token_text(token).alias("text"))


@query("""
    WITH i AS (SELECT o_orderstatus AS uuid, o_orderkey AS first, o_orderkey + o_custkey % 3 AS last FROM orders),
    m AS (SELECT *, max(last) OVER (PARTITION BY uuid ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    g AS (SELECT *, sum((reach IS NULL OR first > reach + 1)::INT) OVER (PARTITION BY uuid ORDER BY first, last) AS g FROM m)
    SELECT uuid, min(first) AS first, max(last) AS last FROM g GROUP BY uuid, g""")
def gtid_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("uuid"), F.col("o_orderkey").alias("first"), (F.col("o_orderkey") + F.col("o_custkey") % 3).alias("last"))
    return readers.coalesced_intervals(rows, block=64)


@query("""
    WITH g AS (SELECT o_orderstatus AS uuid, o_orderkey AS k, o_orderkey - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS g FROM orders),
    i AS (SELECT uuid, min(k) AS a, max(k) AS b FROM g GROUP BY uuid, g)
    SELECT uuid, uuid || ':' || string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ':' ORDER BY a) AS text FROM i GROUP BY 1""")
def gtid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets as text, parsed into intervals, coalesced and written again."""
    text = F.concat("o_orderstatus", F.lit(":"), F.col("o_orderkey").cast("string"), F.lit(", "), "o_orderstatus", F.lit(":"), F.col("o_orderkey").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.explode(readers.interval_set(text)).alias("i")).select("i.*")
    return readers.interval_texts(rows)


@query("SELECT c_custkey, ['a', 'b', 'c'][c_custkey % 3 + 1] AS label, array_to_string(list_filter(['a', 'b', 'c'], lambda x, i: (c_custkey >> (i - 1)) % 2 = 1), '|') AS labels FROM customer")
def enum_set_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ["a", "b", "c"]
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.enum_label(labels, F.col("c_custkey") % 3 + 1).alias("label"), F.array_join(scalars.set_labels(labels, F.col("c_custkey")), "|").alias("labels"))


# -- targets and administration --------------------------------------------------------------------------


@query("SELECT vec_id, label, CASE WHEN vec_id % 9 = 0 THEN 'vector of 64 expected, found 10' END AS reject, vec_id % 9 <> 0 AS stored FROM embeddings")
def quarantine_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a wrong size are put aside with their reason, within a budget, and all others are stored; the batch comes twice."""
    e = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    rows = shape.vector_document(table(spark, sf_dir, "embeddings").withColumn("embedding", e), "embedding", 64)
    made = rows.select(F.lit("vectors").alias("index"), key_id(["vec_id"]).alias("id"), F.lit(None).cast("string").alias("routing"), F.lit("upsert").alias("action"), F.struct("vec_id", "label").alias("doc"), F.lit(1).cast("long").alias("version"), F.col("vec_id").alias("seq"), F.col("_reject").alias("reject"))
    store = Store(spark, work_dir(spark, "rejects"), made.schema["doc"].dataType, buckets=4)
    for _ in range(2):
        store.apply(made, max_rejects=made.count())
    kept = store.documents().select("doc.*", F.lit(None).cast("string").alias("reject"), F.lit(True).alias("stored"))
    return kept.unionByName(store.rejected().select("doc.*", "reject", F.lit(False).alias("stored")))


@query("SELECT vec_id, CASE WHEN len(e) <> 64 THEN 'vector of 64 expected, found ' || len(e) END AS reject FROM (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN embedding[:10] ELSE embedding END AS e FROM embeddings)")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    return shape.vector_document(table(spark, sf_dir, "embeddings").withColumn("embedding", e), "embedding", 64).select("vec_id", F.col("_reject").alias("reject"))


@query("SELECT vec_id, label, len(embedding) AS size FROM embeddings WHERE len(embedding) = 64")
def vector_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shape.vector_document(table(spark, sf_dir, "embeddings"), "embedding", 64)
    return out.where("_reject IS NULL").select("vec_id", "label", F.size("embedding").alias("size"))


@query("""
    SELECT n_nationkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lower(printf('%02x', (('0x' || h[17:18])::INT & 63) | 128)) || h[19:20] || '-' || h[21:32] AS point
    FROM (SELECT n_nationkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || n_name::BLOB) AS h FROM nation)""")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", point_id("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("n_name")).alias("point"))


@query("SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 50000")
def reconcile_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    live = keeps(df.where("o_totalprice >= 50000"), "o_orderstatus <> 'P'")
    return admin.orphans(df.select(key_id(["o_orderkey"]).alias("id")), live.select(key_id(["o_orderkey"]).alias("id")))


@query("SELECT 'exact' AS verdict, 'suppliers' AS alias, s_suppkey, s_name FROM supplier WHERE s_acctbal >= 0")
def reindex_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild under a fresh name, its verdict, the alias switched, the old index gone: what the alias then shows."""
    tables = {"supplier": table(spark, sf_dir, "supplier")}
    view = View("supplier", "suppliers-old", key=["s_suppkey"], where="s_acctbal >= 0", columns=["s_suppkey", "s_name"])
    store = Store(spark, work_dir(spark, "reindex"), document_type([view], tables), buckets=4)
    admin.load(with_index(view, "suppliers-old"), {"supplier": tables["supplier"].where("s_suppkey < 5")}, store)
    store.name("suppliers", "suppliers-old")
    told = admin.reindex(view, tables, store, "suppliers", drop_old=True)
    return store.documents().where(F.col("index") == store.named("suppliers")).select(F.lit(told).alias("verdict"), F.lit("suppliers").alias("alias"), "doc.*")


@query("SELECT c_custkey AS n, 'missing' AS kind, NULL AS c_name, NULL::BIGINT AS version FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'found', c_name, 7 FROM customer WHERE c_acctbal >= 0")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded documents asked for by key: in the order asked, with holes."""
    tables = {"customer": table(spark, sf_dir, "customer")}
    view = View("customer", "customers", key=["c_custkey"], columns=["c_name"], where="c_acctbal >= 0")
    store = Store(spark, work_dir(spark, "lookup"), document_type([view], tables), buckets=4)
    admin.load_ranges(view, tables, store, [40, 90], 7)
    keys = tables["customer"].select(F.col("c_custkey").alias("n"), F.lit("customers").alias("index"), key_id(["c_custkey"]).alias("id"), F.lit(None).cast("string").alias("routing"))
    return store.lookup(keys).select("n", F.when(F.col("doc").isNull(), "missing").otherwise("found").alias("kind"), "doc.c_name", "version")


@query("SELECT p_partkey::VARCHAR AS id, (SELECT count(*) FROM part) AS total FROM part WHERE p_partkey::VARCHAR > '15' ORDER BY 1 LIMIT 20")
def store_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of ids after one, with the index's total beside it."""
    tables = {"part": table(spark, sf_dir, "part")}
    view = View("part", "parts", key=["p_partkey"], columns=["p_partkey"])
    store = Store(spark, work_dir(spark, "page"), document_type([view], tables), buckets=4)
    admin.load(view, tables, store, 1)
    return store.page("parts", "15", 20).withColumn("total", F.lit(store.size("parts")).cast("long"))


@query("""SELECT p_partkey::VARCHAR AS id, '{"brand":"' || p_brand || '","note":null,"p_partkey":' || p_partkey || ',"price":"' || p_retailprice::DECIMAL(12, 2) || '","sizes":[' || p_size || ',null]}' AS json FROM part""")
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents at the JSON edge: nulls shown, decimals as text, sorted names."""
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand"), F.lit(None).cast("string").alias("note"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"), F.array("p_size", F.lit(None)).alias("sizes"))
    return as_json(documents(View("part", "parts", key=["p_partkey"], rename={"p_brand": "brand"}), {"part": df})).select(F.col("_id").alias("id"), "json")


@query("SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 1000")
def soft_delete_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = View("orders", "orders", key=["o_orderkey"], where="o_totalprice > 1000", soft_delete="o_orderstatus = 'P'")
    return documents(view, {"orders": table(spark, sf_dir, "orders")}).select(F.col("_id").alias("id"))


@query("SELECT 'c' || c_custkey AS id, NULL AS routing, 'customer' AS name, NULL AS parent FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'order', 'c' || o_custkey FROM orders")
def join_parent_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of a relation under their parent's id, written by the parent's own rule."""
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "orders")}
    views = [View("customer", "shop", key=["c_custkey"], id="c{c_custkey}", columns=[], join=JoinRule("customer")), View("orders", "shop", key=["o_orderkey"], id="o{o_orderkey}", columns=[], join=JoinRule("order", parent_key="o_custkey"))]
    made = [documents(related_ids(v, views), tables).select(F.col("_id").alias("id"), F.col("_routing").alias("routing"), "join.name", "join.parent") for v in views]
    return made[0].unionByName(made[1])


# -- scalar edges ----------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_size || '|' || p_name || '|-' AS items FROM part")
def array_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("{"), F.col("p_size").cast("string"), F.lit(',"'), "p_name", F.lit('",NULL}'))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(scalars.array_items(text), "|", "-").alias("items"))


@query("""
    SELECT c_custkey, base64(c_name::BLOB) AS b64, ('0x' || substr(hex(c_name), 1, 12))::BIGINT::DECIMAL(20, 0) AS bits, CASE WHEN c_nationkey > 0 THEN c_nationkey END AS version,
      'a-b_' || c_custkey AS reject, CASE WHEN c_nationkey > 0 THEN c_nationkey * 1099511627776 ELSE 0 END AS base, 5000000 AS latency, 41 + length(c_name) + length(c_custkey::VARCHAR) AS bytes
    FROM customer""")
def scalar_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions at the edges: hex bytes, bits, versions, reject ids, failover bases, latencies, sizes."""
    df = table(spark, sf_dir, "customer")
    hexed = F.concat(F.lit("\\x"), F.lower(F.hex(F.col("c_name").cast("binary"))))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey"))
    committed = (F.lit(1_700_000_000 - scalars.EPOCH_2000 - 5) + F.col("c_custkey")) * 1_000_000
    size = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("nothing", T.StringType())])
    return df.withColumn("nothing", F.lit("12")).select(
        "c_custkey", scalars.base64_of_hex(hexed).alias("b64"), scalars.bit_number(F.substring("c_name", 1, 6).cast("binary")).alias("bits"), scalars.external_version(F.col("c_nationkey")).alias("version"),
        scalars.reject_id(F.lit("a"), F.concat(F.lit("b/"), F.col("c_custkey").cast("string"))).alias("reject"), scalars.generation_base(F.col("c_nationkey")).alias("base"),
        scalars.commit_latency_us(committed, at).alias("latency"), scalars.document_bytes(size).alias("bytes"),
    )


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'shop.' || n_name WHEN 2 THEN n_name END AS emptied FROM nation")
def emptied_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that a logged statement empties, if it does."""
    n = F.col("n_nationkey") % 4
    text = F.when(n == 0, F.concat(F.lit("truncate table `"), "n_name", F.lit("`;"))).when(n == 1, F.concat(F.lit(" TRUNCATE `shop`.`"), "n_name", F.lit("`"))).when(n == 2, F.concat(F.lit("Drop Table If Exists `"), "n_name", F.lit("`"))).otherwise(F.concat(F.lit("DELETE FROM "), "n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.truncated_table(text).alias("emptied"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey > 0 THEN n_name END AS n_name FROM nation")
def dump_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump in tab-separated form, written and read."""
    path = work_dir(spark, "dump")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit("\t"), F.when(F.col("n_regionkey") > 0, F.col("n_name")).otherwise("\\N")).alias("value"))
    rows.write.text(path)
    return readers.copy_text(spark, path, "n_nationkey int, n_name string")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'o' || o_orderkey || o_orderstatus WHEN 1 THEN 'o' || o_orderkey || 'F' ELSE 'none' END AS id FROM orders")
def id_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of a changed row: from the row, else the row before; none where neither tells."""
    n = F.col("o_orderkey") % 3
    rows = table(spark, sf_dir, "orders").withColumns({"after": F.when(n == 0, F.struct("o_orderkey", "o_orderstatus")), "before": F.when(n < 2, F.struct("o_orderkey", F.lit("F").alias("o_orderstatus"))), "pk": F.struct("o_orderkey")})
    return rows.select("o_orderkey", F.coalesce(first_rendered(Template.parse("o{o_orderkey}{o_orderstatus}"), rows.schema, ["o_orderkey"]), F.lit("none")).alias("id"))


def streamed(spark: SparkSession, name: str, log: DataFrame, plan, doc, cuts: list[int]) -> Store:
    """A store after a log, cut into files at places of it, has run through rules as a file stream, a file a batch, and all of it once more."""
    root = work_dir(spark, name)
    place = F.array_size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("seq")))
    for i in range(len(cuts) + 1):
        log.where(place == i).repartition(1, F.xxhash64("seq", "kind")).write.mode("append").parquet(f"{root}/changes")
    store = Store(spark, f"{root}/store", doc, buckets=16)
    store.prepare()
    for again in range(2):  # the second time from the start, as after a lost checkpoint
        stream = apply.read_changes(spark, f"{root}/changes", log.schema, files_per_batch=1)
        apply.run(stream, store, lambda: plan(store), f"log-{again}", f"{root}/checkpoint-{again}").awaitTermination()
    return store


@query(LAST)
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic change log through a file stream and compiled rules: the same as one batch merge."""
    view = View("users", "users", key=["id"])
    kind = T.StructType([T.StructField("id", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("event_type", T.StringType())])
    rows = ops(spark, sf_dir).select(F.when(F.col("action") == "delete", "delete").otherwise("update").alias("op"), F.struct("id").alias("key"), F.when(F.col("action") == "upsert", F.struct("id", "doc.value", "doc.event_type")).alias("after"), "version", "seq")
    plan = lambda store: ChangePlan([view], {"users": kind}, lambda: {"users": spark.createDataFrame([], kind)}, kind)
    return shown(streamed(spark, "stream", log_rows(rows, "public", "users"), plan, kind, [300, 5000]).winners())


STREAM_VIEWS = """
[[sync.tables]]
table = "customer"
index = "customers-{c_mktsegment}"
key = ["c_custkey"]
where = "c_acctbal > 0"
columns = ["c_custkey", "c_name", "c_acctbal"]
rename = {c_name = "name", c_acctbal = "balance"}
constants = {origin = "{schema}.{table}"}
[sync.tables.transform]
c_name = {op = "hash"}
[[sync.tables.children]]
field = "orders"
table = "orders"
key = "o_custkey"
order = ["o_orderkey"]
columns = ["o_orderkey", "o_orderstatus"]
max_rows = 3
[[sync.tables.counts]]
field = "open"
table = "orders"
key = "o_custkey"
where = "o_orderstatus = 'O'"

[[sync.tables]]
table = "part"
index = "parts"
key = ["p_partkey"]
columns = ["p_partkey", "p_type"]
[sync.tables.fan_out]
field = "p_type"
id = "{p_partkey}/{p_type}"
by = " "
"""


def customer_log(customer: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """A history that ends in the given tables: in transactions of a hundred rows, from a truncate on.

    Each customer is inserted under another segment, name and balance, then updated (its name left out of the log where it
    didn't change); one in five is also deleted and comes back. Orders arrive under another customer and status first. Each
    part begins with other types. Customers, orders and parts that aren't in the tables come and go.
    """
    none = F.lit(None)
    segment = F.when(F.col("c_custkey") % 2 == 0, "OLD").otherwise(F.col("c_mktsegment"))
    old_name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("before")
    now = F.struct(*customer.columns)
    old = F.struct("c_custkey", old_name.alias("c_name"), "c_nationkey", (-F.col("c_acctbal")).alias("c_acctbal"), segment.alias("c_mktsegment"))
    left_out = F.struct("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name"), "c_nationkey", "c_acctbal", "c_mktsegment")
    unchanged = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("c_name"))).otherwise(F.array().cast("array<string>"))
    at = lambda step, key: (F.lit(step * 10**9) + F.col(key)).alias("seq")
    rows = lambda df, table: log_rows(df, "public", table)
    stale = customer.select(F.lit("insert").alias("op"), F.struct(*(F.lit("stale").alias("c_name") if c == "c_name" else F.col(c) for c in customer.columns)).alias("after"), at(1, "c_custkey"))
    first = customer.select(F.lit("insert").alias("op"), old.alias("after"), at(3, "c_custkey"))
    # the whole row, then once more with what the log leaves out of a row that didn't change there
    whole = customer.select(F.lit("update").alias("op"), old.alias("before"), now.alias("after"), at(4, "c_custkey"))
    again = customer.select(F.lit("update").alias("op"), now.alias("before"), left_out.alias("after"), unchanged.alias("unchanged"), at(5, "c_custkey"))
    lost = customer.where("c_custkey % 5 = 0").select(F.lit("delete").alias("op"), now.alias("before"), at(6, "c_custkey"))
    back = customer.where("c_custkey % 5 = 0").select(F.lit("insert").alias("op"), now.alias("after"), at(7, "c_custkey"))
    extra = customer.withColumns({"c_custkey": F.col("c_custkey") + 10**8, "c_acctbal": F.lit(5.0)})
    come = extra.select(F.lit("insert").alias("op"), now.alias("after"), at(3, "c_custkey"))
    go = extra.select(F.lit("delete").alias("op"), now.alias("before"), at(6, "c_custkey"))
    order = F.struct(*orders.columns)
    other = F.struct("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("N").alias("o_orderstatus"), *orders.columns[3:])
    ordered = orders.select(F.lit("insert").alias("op"), other.alias("after"), at(3, "o_orderkey"))
    moved = orders.select(F.lit("update").alias("op"), other.alias("before"), order.alias("after"), at(8, "o_orderkey"))
    typed = F.struct(*part.columns)
    before = F.struct(*(F.concat(F.lit("GONE "), F.substring_index("p_type", " ", 1)).alias(c) if c == "p_type" else F.col(c) for c in part.columns))
    parts = part.select(F.lit("insert").alias("op"), before.alias("after"), at(3, "p_partkey"))
    retyped = part.select(F.lit("update").alias("op"), before.alias("before"), typed.alias("after"), at(4, "p_partkey"))
    dropped = part.withColumn("p_partkey", F.col("p_partkey") + 10**8)
    parts_come = dropped.select(F.lit("insert").alias("op"), typed.alias("after"), at(3, "p_partkey"))
    parts_go = dropped.select(F.lit("delete").alias("op"), typed.alias("before"), at(5, "p_partkey"))
    made = [rows(x, "customer") for x in (stale, first, whole, again, lost, back, come, go)] + [rows(x, "orders") for x in (ordered, moved)] + [rows(x, "part") for x in (parts, retyped, parts_come, parts_go)]
    log = made[0]
    for m in made[1:]:
        log = log.unionByName(m)
    log = log.withColumns({"txn_id": F.floor(F.col("seq") / 100), "version": F.col("seq") + 1})
    commits = log.groupBy("txn_id").agg(F.max("version").alias("version"), F.max("seq").alias("seq")).withColumn("kind", F.lit("commit"))
    # a transaction that never ends: its rows must not be seen
    open_ = rows(customer.select(F.lit("delete").alias("op"), now.alias("before"), at(9, "c_custkey")), "customer").withColumns({"version": F.col("seq") + 1, "txn_id": F.lit(10**12)})
    cut = spark_row(customer, kind="truncate", schema="public", table="customer", version=2 * 10**9, seq=2 * 10**9)
    return log.unionByName(commits, allowMissingColumns=True).unionByName(open_).unionByName(cut, allowMissingColumns=True)


def spark_row(df: DataFrame, **values) -> DataFrame:
    return df.sparkSession.range(1).select(*((F.lit(v).cast("long") if isinstance(v, int) else F.lit(v)).alias(k) for k, v in values.items()))


@query("""
    WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn, count(*) OVER (PARTITION BY o_custkey) n FROM orders),
    a AS (SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, '|' ORDER BY rn) FILTER (rn <= 3) items, max(n) n, count(*) FILTER (o_orderstatus = 'O') k FROM o GROUP BY 1)
    SELECT 'customers-' || lower(c_mktsegment) AS index, c_custkey::VARCHAR AS id, substr(sha256('"' || c_name || '"'), 1, 16) AS name, c_acctbal AS balance, 'public.customer' AS origin,
      coalesce(items, '') AS orders, CASE WHEN n > 3 THEN n END AS orders_total, coalesce(k, 0) AS open, NULL AS type
    FROM customer LEFT JOIN a ON a.o_custkey = c_custkey WHERE c_acctbal > 0
    UNION ALL SELECT DISTINCT 'parts', p_partkey || '/' || word, NULL, NULL, NULL, NULL, NULL, NULL, word FROM (SELECT p_partkey, unnest(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS word FROM part)""")
def view_stream_equals_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with a filter, an index template, transforms, renames, a capped collection, a count and a fan-out, kept by a shuffled and replayed change log."""
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "orders", "part")}
    tables["customer"] = tables["customer"].withColumn("c_mktsegment", F.lower("c_mktsegment"))
    views = from_toml(STREAM_VIEWS)
    doc = document_type(views, tables)
    log = customer_log(tables["customer"].withColumn("c_mktsegment", F.lower("c_mktsegment")), tables["orders"], tables["part"])
    log = log.withColumns({n: F.regexp_replace(n, '"OLD"', '"old"') for n in ("before", "after")})
    plan = lambda store: ChangePlan(views, {t: df.schema for t, df in tables.items()}, lambda: tables, doc, store.lookup)
    docs = streamed(spark, "views", log, plan, doc, [3 * 10**9 + 50, 4 * 10**9 + 50, 6 * 10**9 + 50]).documents()
    return docs.select("index", "id", "doc.name", "doc.balance", "doc.origin", joined(F.col("doc.orders"), "o_orderkey", "o_orderstatus").alias("orders"), "doc.orders_total", "doc.open", F.col("doc.p_type").alias("type"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

