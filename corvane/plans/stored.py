"""Queries over the driver's tables for keys that cascade, indexes, views and partitions that are stored, and their SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import containment, fulltext, registry, stemmer
from corvane.operators import cascade, intervals
from corvane.operators import predicate as P
from corvane.operators.lineage import cut, shared_folder, shared_path
from corvane.operators.materialized import Stored
from corvane.operators.reader import Reader
from corvane.operators.ranges import RangeTable
from corvane.plans.catalog import database, query, table
from corvane.sources import databases, indexes
from corvane.sources.schema import ForeignKey, Index
from corvane.streaming import stateful

# Foreign keys ---------------------------------------------------------------------------------

#: References of the test tables: name, child, its columns, parent, its columns.
REFERENCES = (
    ("nation_region", "nation", ("n_regionkey",), "region", ("r_regionkey",)),
    ("customer_nation", "customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    ("supplier_nation", "supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    ("orders_customer", "orders", ("o_custkey",), "customer", ("c_custkey",)),
    ("lineitem_orders", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
)
KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "supplier": ("s_suppkey",), "customer": ("c_custkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")}


def entities(spark: SparkSession, d: str, actions: dict[str, str], defaults: dict[str, dict[str, str]] | None = None) -> dict[str, cascade.Entity]:
    """The tables, with what a delete (and a change) of what each reference points at does; CASCADE where not given."""
    keys = lambda t: tuple(ForeignKey(n, c, p, x, actions.get(n, "CASCADE"), actions.get(n, "CASCADE")) for n, child, c, p, x in REFERENCES if child == t)
    return {t: cascade.Entity(table(spark, d, t), k, keys(t), (defaults or {}).get(t, {})) for t, k in KEYS.items()}


@query(
    "fk_cascade_delete",
    """WITH r AS (SELECT r_regionkey AS k FROM region WHERE r_name IN ('ASIA', 'EUROPE')), n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey IN (SELECT k FROM r)),
            s AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey IN (SELECT k FROM n)), c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT k FROM n)),
            o AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT k FROM c))
       SELECT 'region' AS tab, CAST(k AS BIGINT) AS key, 0 AS line FROM r UNION ALL SELECT 'nation', k, 0 FROM n UNION ALL SELECT 'supplier', k, 0 FROM s UNION ALL SELECT 'customer', k, 0 FROM c
       UNION ALL SELECT 'orders', k, 0 FROM o UNION ALL SELECT DISTINCT 'lineitem', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT k FROM o)""",
)
def fk_cascade_delete(spark, d):
    """Keys of all rows that go with two regions."""
    es = entities(spark, d, {})
    gone = cascade.delete(es, {"region": es["region"].rows.where("r_name IN ('ASIA', 'EUROPE')")}).deleted
    parts = [cascade.once(x.select(F.lit(t).alias("tab"), F.col(KEYS[t][0]).cast("long").alias("key"), (F.col("l_linenumber") if t == "lineitem" else F.lit(0)).alias("line")), es[t].rows) for t, x in gone.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


GONE_NATIONS = "SELECT n_nationkey FROM nation WHERE n_nationkey % 7 = 3"


@query("fk_set_null", f"SELECT c_custkey, CASE WHEN c_nationkey IN ({GONE_NATIONS}) THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer")
def fk_set_null(spark, d):
    es = entities(spark, d, {"customer_nation": "SET_NULL", "supplier_nation": "SET_DEFAULT"}, {"supplier": {"s_nationkey": "0"}})
    return cascade.delete(es, {"nation": es["nation"].rows.where("n_nationkey % 7 = 3")}).result()["customer"].select("c_custkey", "c_nationkey")


@query("fk_set_default", f"SELECT s_suppkey, CASE WHEN s_nationkey IN ({GONE_NATIONS}) THEN 0 ELSE s_nationkey END AS s_nationkey FROM supplier")
def fk_set_default(spark, d):
    es = entities(spark, d, {"customer_nation": "SET_NULL", "supplier_nation": "SET_DEFAULT"}, {"supplier": {"s_nationkey": "0"}})
    return cascade.delete(es, {"nation": es["nation"].rows.where("n_nationkey % 7 = 3")}).result()["supplier"].select("s_suppkey", "s_nationkey")


@query(
    "fk_restrict",
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
       SELECT 'lineitem_orders' AS "constraint", l_orderkey AS key, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) GROUP BY l_orderkey
       UNION ALL SELECT 'supplier_nation', s_suppkey, 1 FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""",
)
def fk_restrict(spark, d):
    """What refuses the delete of a region: lines at its customers' orders, suppliers of its nations."""
    es = entities(spark, d, {"lineitem_orders": "NO_ACTION", "supplier_nation": "RESTRICT"})
    refused = cascade.delete(es, {"region": es["region"].rows.where("r_regionkey = 2")}).refused
    key = F.coalesce(F.get_json_object("key", "$.l_orderkey"), F.get_json_object("key", "$.s_suppkey")).cast("long")
    return refused.groupBy("constraint", key.alias("key")).agg(F.count("*").alias("n"))


@query(
    "fk_self_reference",
    """WITH RECURSIVE t AS (SELECT c_custkey AS k, CASE WHEN c_custkey > 0 THEN c_custkey // 3 END AS up FROM customer),
            gone AS (SELECT k FROM t WHERE k % 97 = 5 UNION SELECT t.k FROM t JOIN gone ON t.up = gone.k)
       SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT k FROM gone)""",
)
def fk_self_reference(spark, d):
    """Orders left when customers go with all those below them in a tree of customers."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") > 0, F.floor(F.col("c_custkey") / 3)).alias("c_above"))
    es = {
        "customer": cascade.Entity(c, ("c_custkey",), (ForeignKey("above", ("c_above",), "customer", ("c_custkey",), "CASCADE"),)),
        "orders": cascade.Entity(table(spark, d, "orders"), ("o_orderkey",), (ForeignKey("of", ("o_custkey",), "customer", ("c_custkey",), "CASCADE"),)),
    }
    return cascade.delete(es, {"customer": c.where("c_custkey % 97 = 5")}).result()["orders"].select("o_orderkey")


@query(
    "fk_cascade_update",
    """SELECT l_orderkey + CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') THEN 100000000 ELSE 0 END AS l_orderkey, l_linenumber, count(*) AS n
       FROM lineitem GROUP BY ALL""",
)
def fk_cascade_update(spark, d):
    """Lines after the orders of one status took other keys."""
    es = entities(spark, d, {})
    new = es["orders"].rows.where("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_orderkey") + 100_000_000).alias("new_o_orderkey"))
    return cascade.update(es, {"orders": new}).result()["lineitem"].groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


# Indexes --------------------------------------------------------------------------------------


def place(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors see."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def ordered_orders(spark: SparkSession, d: str) -> indexes.Summaries:
    """The orders as documents, in ranges of their key."""
    folder = place(spark, "orders")
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct("o_custkey", "o_orderstatus")).alias("data"))
    indexes.write_ordered(x, folder, Index("pk", ("id",), unique=True), file_rows=2_000)
    return indexes.Summaries(spark, folder, ("id",)).create()


ORDER_JSON = """'{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS data"""


@query("index_load", f"SELECT o_orderkey AS id, {ORDER_JSON} FROM orders WHERE o_orderkey = 1234")
def index_load(spark, d):
    return Reader.over(ordered_orders(spark, d)).load(1234)


@query("index_load_many", f"SELECT o_orderkey AS id, {ORDER_JSON} FROM orders WHERE o_orderkey IN (7, 8, 1400, 14999, 99999999)")
def index_load_many(spark, d):
    return Reader.over(ordered_orders(spark, d)).load_many([7, 8, 1400, 14999, 99999999])


@query("index_unique_partial", "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2 HAVING count(*) > 1")
def index_unique_partial(spark, d):
    """Keys that a unique index over a part of the lines refuses."""
    return indexes.repeated(table(spark, d, "lineitem"), Index("u", ("l_orderkey", "l_linenumber"), unique=True, predicate="l_returnflag = 'R'"))


@query(
    "index_block_ranges",
    "SELECT event_id, ts, value FROM events WHERE (ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-04 12:00:00' AND value > 10) OR event_id IN (3, 4)",
)
def index_block_ranges(spark, d):
    """Events of a time, from a table in the order of its arrival whose files are summarised; half of them arrived later."""
    folder = place(spark, "events")
    x = table(spark, d, "events").select("event_id", "ts", "value")
    kept = indexes.Summaries(spark, folder, ("event_id", "ts"))
    x.where("event_id % 2 = 0").repartitionByRange(8, "event_id").write.parquet(folder)
    kept.create()
    x.where("event_id % 2 = 1").repartitionByRange(8, "event_id").write.mode("append").parquet(folder)
    kept.refresh()
    some = P.And(P.compare("ts", ">=", dt.datetime(2024, 1, 3)), P.compare("ts", "<", dt.datetime(2024, 1, 4, 12)), P.compare("value", ">", 10.0))
    return kept.rows(P.Or(some, P.in_array("event_id", [3, 4])))


# Full text ------------------------------------------------------------------------------------


def text_sql(where: str, terms: str) -> str:
    """SQL over ``p`` (a stem's places, scanned from all texts) for a condition on a document; ``terms`` count as hits."""
    stops = ", ".join(f"'{w}'" for w in fulltext.STOPS)
    words = f"(SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS word FROM (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '{fulltext.SPLIT}') AS x FROM documents))"
    return f"""WITH w AS (SELECT * FROM {words} WHERE word <> '' AND word NOT IN ({stops})), s AS ({stemmer.stems_sql('w')}), p AS (SELECT doc_id, pos, stem FROM w JOIN s USING (word))
        SELECT doc_id AS id, count(*) AS hits FROM p d WHERE stem IN ({terms}) AND {where} GROUP BY doc_id"""


def has(term: str) -> str:
    return f"EXISTS (SELECT 1 FROM p x WHERE x.doc_id = d.doc_id AND x.stem = '{term}')"


def indexed(spark: SparkSession, d: str) -> fulltext.FullText:
    return fulltext.FullText.build(table(spark, d, "documents"), "doc_id", "text", place(spark, "text"))


@query("text_every_word", text_sql(f"{has('erer')} AND {has('onat')}", "'erer', 'onat'"))
def text_every_word(spark, d):
    return indexed(spark, d).search(fulltext.every("erering", "onates"))


@query("text_phrase", text_sql("EXISTS (SELECT 1 FROM p x JOIN p y ON y.doc_id = x.doc_id AND y.pos = x.pos + 1 WHERE x.doc_id = d.doc_id AND x.stem = 'anea' AND y.stem = 'erin')", "'anea', 'erin'"))
def text_phrase(spark, d):
    return indexed(spark, d).search(fulltext.phrase("anea erining"))


@query("text_any_without", text_sql(f"({has('erer')} OR {has('keit')}) AND NOT {has('tion')}", "'erer', 'keit', 'tion'"))
def text_any_without(spark, d):
    return indexed(spark, d).search((fulltext.every("erer") | fulltext.every("keit")) - fulltext.every("tion"))


# Containment of JSON --------------------------------------------------------------------------


def order_documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines, as JSON."""
    line = F.struct(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.struct(F.col("l_partkey").alias("key")).alias("part"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("lines"))
    x = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    return x.select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("priority")).alias("by"), "lines")).alias("data"))


@query(
    "json_contains",
    """SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 7)
       AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')""",
)
def json_contains(spark, d):
    """Orders of a status and priority with a returned line of seven pieces and one of another flag."""
    index = containment.JsonIndex.build(order_documents(spark, d), "id", "data", place(spark, "json"))
    return index.search('{"status": "F", "by": {"priority": "2-HIGH"}, "lines": [{"flag": "R", "quantity": 7}, {"flag": "N"}]}').select("id")


@query("json_contains_path", "SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = 77")
def json_contains_path(spark, d):
    index = containment.JsonIndex.build(order_documents(spark, d), "id", "data", place(spark, "json"))
    return index.search('{"lines": [{"part": {"key": 77.0}}]}').select("id")


# Views that are refreshed by what changed -----------------------------------------------------


@query(
    "view_refresh_changes",
    """SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(38, 6))) AS DOUBLE) AS total, min(o_orderdate) AS first, max(o_orderdate) AS last, max(o_totalprice) AS most
       FROM (SELECT o_custkey, CASE WHEN o_orderkey % 10 = 5 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 10 <> 3 AND o_custkey % 50 <> 8)
       GROUP BY 1""",
)
def view_refresh_changes(spark, d):
    """Orders by customer, after inserts, deletes (of some customers' last orders too), updates and a batch given twice."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    k = F.col("o_orderkey") % 10
    view = Stored(spark, place(spark, "view"), ("o_custkey",), ("o_totalprice",), ("o_orderdate", "o_totalprice"), buckets=8)
    view.create(orders.where(k != 7))
    view.refresh(1, orders.where(k == 7), None, orders)
    gone = (k == 3) | (F.col("o_custkey") % 50 == 8)
    left = orders.where(~gone)
    view.refresh(2, None, orders.where(gone), left)
    view.refresh(2, None, orders.where(gone), left)
    double = F.when(k == 5, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))
    view.refresh(3, left.where(k == 5).withColumn("o_totalprice", double), left.where(k == 5), left.withColumn("o_totalprice", double))
    return view.read().select("o_custkey", "n", F.col("sum_o_totalprice").cast("double").alias("total"), F.col("min_o_orderdate").alias("first"), F.col("max_o_orderdate").alias("last"), F.col("max_o_totalprice").alias("most"))


# Ranges that are split and merged -------------------------------------------------------------


@query(
    "part_split_merge",
    """SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 0 WHEN o_orderdate < TIMESTAMP '1999-07-01' THEN 1 ELSE 2 END AS place FROM orders""",
)
def part_split_merge(spark, d):
    """Orders by the range they lie in, after a split and a merge."""
    day = lambda y, m=1: dt.datetime(y, m, 1)
    with database(spark) as db:
        t = RangeTable.create(spark, f"{db}.orders", "o_orderkey BIGINT, o_orderdate TIMESTAMP", "o_orderdate", [day(1996), day(1998)])
        t.insert(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp")))
        t.split(day(1999, 7))
        t.merge(day(1998))
        out = None
        for i, r in enumerate(t.ranges()):
            x = t.rows([r]).select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), F.lit(i).alias("place"))
            out = x if out is None else out.unionByName(x)
        return cut(out)


# Appends as a stateful stream -----------------------------------------------------------------


@query(
    "event_append_stateful",
    """SELECT event_id AS op_seq, CAST(user_id AS VARCHAR) AS stream_id,
              CASE WHEN event_id % 10 <> 4 THEN (CASE WHEN user_id % 3 = 0 THEN user_id % 5 + 1 ELSE 0 END) + count(*) FILTER (WHERE event_id % 10 <> 4) OVER (PARTITION BY user_id ORDER BY event_id) END AS version,
              CASE WHEN event_id % 10 = 4 THEN 'wrong version' END AS reason
       FROM events""",
)
def event_append_stateful(spark, d):
    """Versions of all events in two runs of one stream, from streams that exist; a tenth of them expect what can't be."""
    home = place(spark, "appends")
    x = table(spark, d, "events").select(
        F.lit("*DEFAULT*").alias("tenant_id"), F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("op_seq"),
        F.col("event_id").cast("string").alias("id"), F.col("props").alias("data"), F.when(F.col("event_id") % 10 == 4, F.lit(-1)).cast("long").alias("expected"),
    )
    streams = table(spark, d, "events").where("user_id % 3 = 0").select(F.lit("*DEFAULT*").alias("tenant_id"), F.col("user_id").cast("string").alias("stream_id"), (F.col("user_id") % 5 + 1).alias("version")).distinct()
    half = x.agg(F.expr("percentile_approx(op_seq, 0.5)")).first()[0]
    for part in (x.where(F.col("op_seq") <= half), x.where(F.col("op_seq") > half)):
        part.write.mode("append").parquet(f"{home}/in")
        source = spark.readStream.schema(x.schema).parquet(f"{home}/in")
        out = stateful.judged(source, streams).writeStream.format("parquet").option("path", f"{home}/out")
        out.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/out").select("op_seq", "stream_id", "version", "reason")


# Intervals, and folds of Python ---------------------------------------------------------------


@query(
    "index_overlaps",
    """WITH i AS (SELECT o_orderkey AS id, o_custkey, o_orderdate AS a, o_orderdate + to_days(CAST(power(2, o_orderkey % 9) AS INTEGER)) AS b FROM orders)
       SELECT l.id AS one, r.id AS other FROM i l JOIN i r ON l.o_custkey = r.o_custkey AND l.id < r.id AND l.a < r.b AND r.a < l.b""",
)
def index_overlaps(spark, d):
    """Pairs of a customer's orders that were open at one time, from a day to most of a year."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderdate").alias("a"), F.expr("o_orderdate + make_dt_interval(CAST(power(2, o_orderkey % 9) AS INT))").alias("b"))
    return intervals.self_overlaps(x, ("a", "b"), "id", ("o_custkey",)).select(F.col("l.id").alias("one"), F.col("r.id").alias("other"))


@query("udf_fold_python", "SELECT l_returnflag, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // count(*) AS mean_cents FROM lineitem GROUP BY 1")
def udf_fold_python(spark, d):
    """A mean in whole cents over three groups that hold all lines."""
    mean = registry.PythonFold("mean_cents", "long", (0, 0), lambda s, x: (s[0] + 1, s[1] + round(x * 100)), lambda s: s[1] // s[0], lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return mean.over(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "mean_cents")


# Many databases -------------------------------------------------------------------------------


@query("source_tenant_databases", "SELECT n_name AS tenant_id, c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_3', 'NATION_11') AND c_acctbal > 100")
def source_tenant_databases(spark, d):
    """Customers of two tenants, of a database for each nation."""
    x = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey", "c_name", "c_acctbal")
    folder = shared_path(spark, "databases")
    databases.write(x, folder, "customer", "n_name")
    some = P.And(P.in_array("tenant_id", ["NATION_3", "NATION_11"]), P.compare("c_acctbal", ">", 100.0))
    return databases.rows(spark, "customer", some, folder=folder).select("tenant_id", "c_custkey", "c_acctbal")
