"""Queries over the driver's tables, one or more per operator, and the SQL that gives the same rows."""

from __future__ import annotations

import contextlib
import datetime as dt
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import registry, scalar
from corvane.operators import batch, ordering, partition, reader, tenancy, writes
from corvane.operators import predicate as P
from corvane.operators.lineage import cut, shared_path
from corvane.operators.session import Session
from corvane.operators.writes import BulkMode, Mode, Op
from corvane.sources import admin, names, schema
from corvane.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    if name in QUERIES:
        raise ValueError(f"{name} is registered")

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


@contextlib.contextmanager
def database(spark: SparkSession) -> Iterator[str]:
    """A database of the catalog for the time of a query; what is read from it is collected (columns and some rows)."""
    name = f"corvane_q_{uuid.uuid4().hex[:12]}"
    try:
        schema.ensure_schema(spark, name)
        yield name
    finally:
        schema.drop_schema(spark, name)


def declared(df: DataFrame, db: str, name: str) -> schema.Table:
    """A table with the columns of a frame."""
    return schema.Table(db, name, tuple(schema.Column(f.name, f.dataType.simpleString()) for f in df.schema))


# Predicates -----------------------------------------------------------------------------------

LINE = "l_orderkey, l_linenumber, l_quantity"


def filtered(name: str, source: str, columns: str, p: P.Predicate) -> None:
    """A query and its SQL from one predicate."""
    where = f" WHERE {s}" if (s := p.to_sql()) else ""
    cols = [c.strip() for c in columns.split(",")]
    query(name, f"SELECT {columns} FROM {source}{where}")(lambda spark, d: P.apply(table(spark, d, source), p).select(*cols))


for _name, _op in (("eq", "="), ("ne", "!="), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    filtered(f"pred_compare_{_name}", "lineitem", LINE, P.compare("l_quantity", _op, 25.0))
filtered("pred_negate", "lineitem", LINE, P.negated(P.compare("l_quantity", ">", 25.0)))
filtered("pred_swap", "lineitem", LINE, P.compare("l_quantity", "<", 10.0).swap())
filtered("pred_custom_operator", "part", "p_partkey, p_name", P.compare("p_name", "LIKE", "%a%"))
filtered("pred_compound", "events", "event_id, event_type, value", P.And(P.in_array("event_type", ["purchase", "signup"]), P.compare("value", ">", 50.0)))
filtered("pred_or_nested", "orders", "o_orderkey, o_orderstatus", P.Or(P.And(P.compare("o_orderstatus", "=", "F"), P.compare("o_totalprice", ">", 100000.0)), P.Or(P.compare("o_orderpriority", "=", "1-URGENT"), P.compare("o_orderstatus", "=", "P"))))
filtered("pred_empty_compound", "nation", "n_nationkey", P.And())
filtered("pred_combine_and", "orders", "o_orderkey", P.combine_and(P.compare("o_orderstatus", "=", "O"), P.compare("o_totalprice", "<", 50000.0), P.compare("o_orderkey", ">", 10)))
filtered("pred_not", "customer", "c_custkey", P.Not(P.And(P.compare("c_mktsegment", "=", "BUILDING"), P.compare("c_acctbal", ">", 0.0))))
filtered("pred_in_array", "customer", "c_custkey, c_mktsegment", P.in_array("c_mktsegment", ["BUILDING", "MACHINERY"]))
filtered("pred_literal", "part", "p_partkey", P.Or(P.FALSE, P.And(P.TRUE, P.compare("p_size", ">", 10))))
filtered("pred_literal_reversed", "region", "r_regionkey", P.TRUE.negate())
filtered("pred_raw_params", "part", "p_partkey, p_size", P.Raw("p_size between ? and ?", (5, 15)))
filtered("pred_token_params", "part", "p_partkey, p_size", P.Raw("p_size between ^ and ^", (5, 15), "^"))
filtered("pred_named_params", "part", "p_partkey", P.Raw("p_size > :low and p_brand <> :brand", {"low": 20, "brand": "Brand#11"}))
filtered("pred_by_id", "orders", "o_orderkey, o_totalprice", P.by_id(7, "o_orderkey"))
filtered("pred_starts_with", "part", "p_partkey", P.compare("p_type", "LIKE", "S%"))


#: Values with what parsers take for quotes, escapes and names.
ODD = ("purchase\\'", "it's :b", "${x} \\' OR true --")


@query("pred_odd_values", "SELECT event_id FROM events WHERE event_type = 'purchase'")
def pred_odd_values(spark, d):
    x = table(spark, d, "events").withColumn("t", F.concat("event_type", F.lit("\\'")))
    p = P.And(P.Raw("t = ?", (ODD[0],)), P.Raw("t <> :a and t <> :b", {"a": ODD[1], "b": ODD[2]}), P.compare("t", "<=>", ODD[0]))
    return P.apply(x, p).select("event_id")


@query("pred_long_list", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT unnest(range(0, 4000, 2)))")
def pred_long_list(spark, d):
    return P.apply(table(spark, d, "orders"), P.in_array("o_custkey", range(0, 4000, 2))).select("o_orderkey")


@query("pred_in_subquery", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def pred_in_subquery(spark, d):
    rich = P.apply(table(spark, d, "customer"), P.compare("c_acctbal", ">", 5000.0))
    return P.apply(table(spark, d, "orders"), P.InSubQuery("o_custkey", rich, "c_custkey")).select("o_orderkey", "o_custkey")


@query("pred_not_in_subquery", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR NOT o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def pred_not_in_subquery(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 5000")
    p = P.Or(P.compare("o_orderstatus", "=", "F"), P.Not(P.InSubQuery("o_custkey", rich, "c_custkey")))
    return P.apply(table(spark, d, "orders"), p).select("o_orderkey")


LABELLED = "(SELECT documents.doc_id, quality FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)"
for _name, _p in (
    ("one_of", P.EnumIsOneOf((1,), "quality")),
    ("one_of_null", P.EnumIsOneOf((1, None), "quality")),
    ("only_null", P.EnumIsOneOf((None,), "quality")),
    ("not_one_of", P.EnumIsNotOneOf((1,), "quality")),
):

    @query(f"pred_enum_{_name}", f"SELECT doc_id, quality FROM {LABELLED} WHERE {_p.to_sql()}")
    def _enum(spark, d, p=_p):
        x = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
        return P.apply(x, p)


# Reads ----------------------------------------------------------------------------------------


def documents_of(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("data"), F.col("lang").alias("doc_type"), F.col("source").alias("tenant_id"), (F.col("lang") == "es").alias("deleted"))


@query("read_load", "SELECT doc_id AS id FROM documents WHERE doc_id = 1 AND lang <> 'es'")
def read_load(spark, d):
    return reader.Reader(documents_of(spark, d)).load(1).select("id")


@query("read_load_many", "SELECT doc_id AS id, length(text) AS n FROM documents WHERE doc_id IN (1, 5, 13, 99999999) AND lang <> 'es'")
def read_load_many(spark, d):
    return reader.Reader(documents_of(spark, d)).load_many([1, 5, 13, 99999999]).select("id", F.length("data").cast("long").alias("n"))


@query("read_default_filters", "SELECT doc_id AS id FROM documents WHERE source = 'src3' AND lang <> 'es'")
def read_default_filters(spark, d):
    return reader.Reader(documents_of(spark, d), tenant="src3").query().select("id")


@query("read_identity_map", "SELECT user_id AS id, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS data FROM events GROUP BY user_id")
def read_identity_map(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("data"), "event_id")
    return reader.Reader(x, tracking="identity", order=("event_id",)).query().select("id", "event_id", "data")


@query("read_dirty_tracking", "SELECT event_id AS id, 'upsert' AS op FROM events WHERE event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INTEGER) <> 7")
def read_dirty_tracking(spark, d):
    x = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("data"), F.col("event_type").alias("doc_type"))
    read = reader.Reader(x, tracking="dirty", order=("doc_type",)).query(P.compare("doc_type", "=", "purchase"))
    after = read.select("id", F.to_json(F.struct(F.lit(7).alias("k"))).alias("data"))  # as the caller left them
    return writes.changes(read.select("id", F.col("as_read").alias("data")), after).select("id", "op")


@query("read_hierarchical", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'purchase'")
def read_hierarchical(spark, d):
    x = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("data"), F.col("event_type").alias("doc_type"))
    r = reader.Reader(x, tracking="identity", order=("doc_type",), subtypes={"purchase": T.StructType().add("k", T.IntegerType())})
    return r.of_type("purchase").select("id", F.col("data.k").alias("k"))


@query("read_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def read_json_path(spark, d):
    return table(spark, d, "events").select("event_id", scalar.json_at(F.col("props"), "$.k").cast("int").alias("k"))


@query("read_project", "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def read_project(spark, d):
    declared = T.StructType().add("C_CustKey", T.IntegerType()).add("c_nationkey", "string").add("nothing_like_it", "string")
    return reader.project(table(spark, d, "customer"), declared).withColumnRenamed("C_CustKey", "c_custkey")


@query("read_metadata", "SELECT doc_id, source AS tenant_id, 'doc' AS doc_type, 'job' AS last_modified_by, true AS stamped, false AS deleted FROM (SELECT doc_id, source FROM documents)")
def read_metadata(spark, d):
    x = reader.metadata(table(spark, d, "documents").select("doc_id", F.col("source").alias("tenant_id")), doc_type="doc", by="job")
    return x.select("doc_id", "tenant_id", "doc_type", "last_modified_by", F.col("last_modified").isNotNull().alias("stamped"), "deleted")


@query("session_save", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS data FROM customer WHERE c_custkey % 7 <> 0")
def session_save(spark, d):
    now = current_of(spark, d, Mode.OPTIMISTIC, "true")
    s = Session(reader.Reader(now), Mode.OPTIMISTIC)
    s.load_many(now.where("id % 3 = 0").select("id"))
    s.queue(Op.UPSERT, now.where("id % 3 = 0").selectExpr("id", "'new' AS data", "'n' || id AS new_version"))
    s.queue(Op.UPSERT, now.where("id % 3 = 1").selectExpr("id", "'not read' AS data", "'n' || id AS new_version"))  # refused: the session doesn't know their versions
    s.delete(now.where("id % 7 = 0"))
    return s.save(now)[0].select("id", "data")


@query("read_many_results", "SELECT 'region' AS result, r_name AS name FROM region UNION ALL SELECT 'nation', n_name FROM nation")
def read_many_results(spark, d):
    results = admin.MultiReader([table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name")])
    rows = [("region", r[0]) for r in results.rows()]
    results.next_result()
    return spark.createDataFrame(rows + [("nation", r[0]) for r in results.rows()], "result string, name string")


# Batches and commands -------------------------------------------------------------------------


@query(
    "batch_list_single_scalar",
    "SELECT 'list' AS tag, CAST(r_regionkey AS BIGINT) AS n FROM region UNION ALL SELECT 'single', min(o_orderkey) FROM orders UNION ALL SELECT 'scalar', count(*) FROM lineitem",
)
def batch_list_single_scalar(spark, d):
    b = batch.Batch()
    rows = b.query(table(spark, d, "region").select(F.col("r_regionkey").cast("long")))
    one = b.single(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    n = b.scalar(table(spark, d, "lineitem").agg(F.count("*")))
    b.execute()
    out = [("list", r[0]) for r in rows.result()] + [("single", one.result()[0]), ("scalar", n.result())]
    return spark.createDataFrame(out, "tag string, n long")


@query("command_parameters", "SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AND c_nationkey <> 3")
def command_parameters(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("corvane_customer")
    c = batch.Command().append("SELECT c_custkey FROM corvane_customer WHERE c_acctbal > ").parameter(1000).append(" AND c_mktsegment IN (")
    c.group(["BUILDING", "AUTOMOBILE"]).append(")").named("n", 3).named("n", 4).append(" AND c_nationkey <> :n")
    return c.run(spark)


@query("command_script", "SELECT r_regionkey, r_name || ';' AS name FROM region WHERE r_name <> 'a;b'")
def command_script(spark, d):
    table(spark, d, "region").createOrReplaceTempView("corvane_region")
    batch.run_script(spark, "-- one; two\nCREATE OR REPLACE TEMPORARY VIEW corvane_r AS SELECT * FROM corvane_region WHERE r_name <> 'a;b';\nCREATE OR REPLACE TEMPORARY VIEW corvane_r2 AS SELECT r_regionkey, r_name || ';' AS name FROM corvane_r;")
    return spark.table("corvane_r2")


@query("command_array_parameter", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2)")
def command_array_parameter(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("corvane_nation")
    return batch.Command().with_values("SELECT n_nationkey FROM corvane_nation WHERE array_contains(?, n_regionkey)", [[1, 2]]).run(spark)


# Order and aggregates -------------------------------------------------------------------------


NUMBERED = "row_number() OVER (ORDER BY {}) AS place"


def placed(df: DataFrame, n: int | None = None) -> DataFrame:
    """The rows (or the first n) of a sorted frame with their place in it."""
    if n is None:
        return ordering.numbered(df, "place").withColumn("place", F.col("place") + 1)
    return df.limit(n).withColumn("place", F.monotonically_increasing_id() + 1)


@query("sort_nulls_first_last", f"SELECT doc_id, quality, {NUMBERED.format('quality DESC NULLS FIRST, doc_id')} FROM {LABELLED}")
def sort_nulls_first_last(spark, d):
    x = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return placed(ordering.ordered(x, ("quality", True, True), ("doc_id", False, None)))


@query("sort_nulls_default", f"SELECT doc_id, quality, {NUMBERED.format('quality ASC NULLS LAST, doc_id DESC')} FROM {LABELLED}")
def sort_nulls_default(spark, d):
    x = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return placed(ordering.ordered(x, ("quality", False, None), ("doc_id", True, None)))


@query("sort_top", f"SELECT * FROM (SELECT o_orderkey, o_totalprice, {NUMBERED.format('o_totalprice DESC NULLS LAST, o_orderkey')} FROM orders) WHERE place <= 20")
def sort_top(spark, d):
    return placed(ordering.ordered(table(spark, d, "orders"), ("o_totalprice", True, False), ("o_orderkey", False, None)).select("o_orderkey", "o_totalprice"), 20)


@query("keep_newest_n", "SELECT o_orderkey, o_orderdate FROM (SELECT *, rank() OVER (ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r <= 25")
def keep_newest_n(spark, d):
    return ordering.newest(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 25)


@query("agg_ordered_array", "SELECT user_id, list(event_type ORDER BY ts, event_id) AS types FROM events GROUP BY user_id")
def agg_ordered_array(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(ordering.ordered_array("event_type", "ts", "event_id").alias("types"))


@query("agg_ordered_string", "SELECT user_id, string_agg(event_type, ', ' ORDER BY ts, event_id) AS types FROM events GROUP BY user_id")
def agg_ordered_string(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(ordering.ordered_string("event_type", ", ", "ts", "event_id").alias("types"))


@query("agg_argmin", "SELECT n_regionkey, arg_min(n_name, n) AS database_id FROM (SELECT n_regionkey, n_name, count(c_custkey) * 100 + n_nationkey AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 1 GROUP BY n_regionkey, n_name, n_nationkey) GROUP BY 1")
def agg_argmin(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name", "n_regionkey").agg(F.count("c_custkey").alias("tenant_count"))
    pool = n.select("n_regionkey", F.col("n_name").alias("database_id"), "tenant_count", (F.col("n_nationkey") % 5 == 1).alias("is_full"), F.col("n_nationkey").alias("position"))
    return tenancy.smallest_in(pool, "n_regionkey")


@query("agg_scalar", "SELECT count(*) AS n, max(o_totalprice) AS most FROM orders")
def agg_scalar(spark, d):
    b, o = batch.Batch(), table(spark, d, "orders")
    n, most = b.scalar(o.agg(F.count("*"))), b.scalar(o.agg(F.max("o_totalprice")))
    b.execute()
    return spark.createDataFrame([(n.result(), most.result())], f"n long, most {dict(o.dtypes)['o_totalprice']}")


@query("agg_ignore_case", "SELECT lower(c_mktsegment) AS bucket, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1")
def agg_ignore_case(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("value"), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("suffix")).distinct()
    return partition.list_registry(c).select(F.col("suffix").alias("bucket"), F.size("values").cast("long").alias("n"))


@query("agg_distinct_schemas", "SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_mktsegment <> 'BUILDING'")
def agg_distinct_schemas(spark, d):
    segments = [r[0] for r in table(spark, d, "customer").select("c_mktsegment").distinct().collect()]
    tables = [schema.Table("public" if s == "BUILDING" else s, n) for s in segments for n in ("a", "b")]
    return spark.createDataFrame([(x,) for x in schema.Migration(tuple(schema.diff(t, None) for t in tables)).schemas], "name string")


# Joins ----------------------------------------------------------------------------------------


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_semi(spark, d):
    o = P.apply(table(spark, d, "orders"), P.compare("o_orderstatus", "=", "F"))
    return P.apply(table(spark, d, "customer"), P.InSubQuery("c_custkey", o, "o_custkey")).select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    return P.apply(table(spark, d, "customer"), P.Not(P.InSubQuery("c_custkey", table(spark, d, "orders"), "o_custkey"))).select("c_custkey")


TO_NATION = schema.ForeignKey("fk_nation", ("c_nationkey",), "nation", ("n_nationkey",))
TO_REGION = schema.ForeignKey("fk_region", ("n_regionkey",), "region", ("r_regionkey",))


@query("join_chain", "SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def join_chain(spark, d):
    parents = {t: table(spark, d, t) for t in ("nation", "region")}
    return schema.follow(table(spark, d, "customer"), parents, TO_NATION, TO_REGION).groupBy("r_name", "n_name").agg(F.count("*").alias("n"))


@query("join_self", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(spark, d):
    a, b = (table(spark, d, "nation").select(F.col("n_nationkey").alias(x), F.col("n_regionkey").alias(f"r{x}")) for x in "ab")
    return schema.follow(a, {"b": b}, schema.ForeignKey("same", ("ra",), "b", ("rb",))).where("a < b").select("a", "b")


@query("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 40")
def join_multi_key(spark, d):
    x = table(spark, d, "lineitem")
    key = schema.ForeignKey("line", ("l_orderkey", "l_linenumber"), "lines", ("k", "n"))
    return schema.follow(x.where("l_quantity > 40").select("l_orderkey", "l_linenumber"), {"lines": x.selectExpr("l_orderkey AS k", "l_linenumber AS n", "l_quantity")}, key).select("l_orderkey", "l_linenumber", "l_quantity")


@query("join_left", f"SELECT doc_id, quality FROM {LABELLED}")
def join_left(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("tenant_id"))
    given = table(spark, d, "labels").select(F.col("doc_id").alias("tenant_id"), F.col("quality").alias("database_id"))
    return tenancy.assigned(rows, given).select(F.col("tenant_id").alias("doc_id"), F.col("database_id").alias("quality"))


@query("join_unnest_ordinality", "SELECT doc_id, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)")
def join_unnest_ordinality(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", scalar.with_ordinality(F.split("text", "\n", -1)).alias("e")).select("doc_id", F.col("e.pos").cast("long").alias("pos"), "e.value")


@query(
    "diff_full_outer",
    """SELECT coalesce(e.c_name, a.c_name) AS c_name, CASE WHEN a.c_name IS NULL THEN 'missing' WHEN e.c_name IS NULL THEN 'extra' WHEN e.v = a.v THEN 'matched' ELSE 'different' END AS state
       FROM (SELECT c_name, c_acctbal AS v FROM customer WHERE c_mktsegment <> 'BUILDING') e FULL JOIN (SELECT c_name, c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS v FROM customer WHERE c_acctbal > 0) a ON e.c_name = a.c_name""",
)
def diff_full_outer(spark, d):
    c = table(spark, d, "customer")
    e = c.where("c_mktsegment <> 'BUILDING'").select("c_name", F.col("c_acctbal").alias("v"))
    a = c.where("c_acctbal > 0").select(F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0)).alias("v"))
    names = c.select("c_name", F.upper("c_name").alias("u"))
    found = ordering.matched(e, a, "c_name", "v").withColumn("u", F.upper("c_name")).drop("c_name")
    return found.join(names, "u").select("c_name", "state")


# Writes ---------------------------------------------------------------------------------------

CURRENT = {"off": "NULL", "optimistic": "'v' || c_custkey", "numeric": "c_custkey % 5 + 1"}
CUR_SQL = "(SELECT c_custkey AS id, c_name AS data, {v} AS version FROM customer WHERE c_mktsegment <> 'BUILDING')"
INC_SQL = """(SELECT id, data, CASE WHEN id % 4 = 1 THEN NULL WHEN id % 4 = 2 THEN 'stale' ELSE 'v' || id END AS expected, 'n' || id AS new_version, id % 4 AS revision
              FROM (SELECT CASE WHEN c_custkey % 6 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS id, 'new ' || c_name AS data FROM customer WHERE c_acctbal > 4000 OR c_mktsegment = 'BUILDING'))"""


def current_of(spark, d, mode: Mode, where: str = "c_mktsegment <> 'BUILDING'") -> DataFrame:
    kind = "bigint" if mode is Mode.NUMERIC else "string"
    return table(spark, d, "customer").where(where).selectExpr("c_custkey AS id", "c_name AS data", f"CAST({CURRENT[mode.value]} AS {kind}) AS version")


def incoming_of(spark, d) -> DataFrame:
    x = table(spark, d, "customer").where("c_acctbal > 4000 OR c_mktsegment = 'BUILDING'")
    x = x.selectExpr("CASE WHEN c_custkey % 6 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS id", "'new ' || c_name AS data")
    return x.selectExpr("id", "data", "CASE WHEN id % 4 = 1 THEN NULL WHEN id % 4 = 2 THEN 'stale' ELSE 'v' || id END AS expected", "'n' || id AS new_version", "id % 4 AS revision", "id AS op_seq")


def write_sql(op: Op, mode: Mode) -> tuple[str, str, str]:
    """FROM clause, why an operation is refused, and the version it gives."""
    there = "cur.id IS NOT NULL"
    fails = {"off": "false", "optimistic": "NOT coalesce(cur.version = inc.expected, false)", "numeric": "NOT (inc.revision = 0 OR cur.version < inc.revision)"}[mode.value]
    why = {
        Op.INSERT: f"CASE WHEN {there} THEN 'exists' END",
        Op.UPDATE: f"CASE WHEN cur.id IS NULL THEN '{'conflict' if mode is Mode.OPTIMISTIC else 'missing'}' WHEN {fails} THEN 'conflict' END",
        Op.UPSERT: f"CASE WHEN {there} AND {fails} THEN 'conflict' END",
        Op.OVERWRITE: "CAST(NULL AS VARCHAR)",
    }[op]
    version = {"off": "NULL", "optimistic": "inc.new_version", "numeric": f"CASE WHEN inc.revision <> 0 THEN inc.revision WHEN {there} THEN cur.version + 1 ELSE 1 END"}[mode.value]
    return f"{CUR_SQL.format(v=CURRENT[mode.value])} cur FULL JOIN {INC_SQL} inc ON cur.id = inc.id", why, version


def _write(op: Op, mode: Mode) -> None:
    source, why, version = write_sql(op, mode)
    ok = f"(inc.id IS NOT NULL AND ({why}) IS NULL)"
    kind = "BIGINT" if mode is Mode.NUMERIC else "VARCHAR"
    plan = lambda spark, d: writes.plan_write(current_of(spark, d, mode), incoming_of(spark, d), op, mode)
    query(
        f"write_{op.value}_{mode.value}",
        f"SELECT coalesce(cur.id, inc.id) AS id, CASE WHEN {ok} THEN inc.data ELSE cur.data END AS data, CAST(CASE WHEN {ok} THEN {version} ELSE cur.version END AS {kind}) AS version FROM {source} WHERE cur.id IS NOT NULL OR {ok}",
    )(lambda spark, d: writes.next_state(plan(spark, d)))
    query(f"write_rejections_{op.value}_{mode.value}", f"SELECT inc.id, inc.id AS op_seq, {why} AS reason FROM {source} WHERE inc.id IS NOT NULL AND ({why}) IS NOT NULL")(lambda spark, d: writes.rejections(plan(spark, d)))


for _op in Op:
    for _mode in Mode:
        _write(_op, _mode)


@query("write_repeated_in_batch", "SELECT o_custkey AS id, CAST(count(*) AS BIGINT) AS version, arg_max(CAST(o_orderkey AS VARCHAR), o_orderkey) AS data FROM orders GROUP BY o_custkey")
def write_repeated_in_batch(spark, d):
    x = table(spark, d, "orders").selectExpr("o_custkey AS id", "CAST(o_orderkey AS STRING) AS data", "o_orderkey AS op_seq", "0L AS revision")
    return writes.next_state(writes.plan_write(spark.createDataFrame([], "id long, data string, version long"), x, Op.UPSERT, Mode.NUMERIC)).select("id", "version", "data")


@query("write_bulk_inserts_only", "SELECT c_custkey AS id, c_name AS data FROM customer WHERE c_acctbal > 4000 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_acctbal <= 4000")
def write_bulk_inserts_only(spark, d):
    c = table(spark, d, "customer")
    return writes.bulk(c.where("c_acctbal > 4000").selectExpr("c_custkey AS id", "c_name AS data"), c.where("c_acctbal <= 4000").selectExpr("c_custkey AS id", "'new' AS data"), BulkMode.INSERTS_ONLY)


BULK_CUR = "(SELECT c_custkey AS id, c_name AS data, 'v' || c_custkey AS version FROM customer WHERE c_mktsegment <> 'BUILDING')"
BULK_INC = "(SELECT c_custkey AS id, 'new' AS data, 'w' || c_custkey AS version, CASE WHEN c_custkey % 4 = 0 THEN 'v' || c_custkey END AS expected FROM customer WHERE c_acctbal > 4000)"
for _mode, _wins in ((BulkMode.IGNORE_DUPLICATES, "cur.id IS NULL"), (BulkMode.OVERWRITE_EXISTING, "inc.id IS NOT NULL"), (BulkMode.OVERWRITE_IF_VERSION_MATCHES, "inc.id IS NOT NULL AND (cur.id IS NULL OR cur.version = inc.expected)")):

    @query(
        f"write_bulk_{_mode.name.lower()}",
        f"SELECT coalesce(cur.id, inc.id) AS id, CASE WHEN {_wins} THEN inc.data ELSE cur.data END AS data, CASE WHEN {_wins} THEN inc.version ELSE cur.version END AS version FROM {BULK_CUR} cur FULL JOIN {BULK_INC} inc ON cur.id = inc.id",
    )
    def _bulk(spark, d, mode=_mode):
        c = table(spark, d, "customer")
        cur = c.where("c_mktsegment <> 'BUILDING'").selectExpr("c_custkey AS id", "c_name AS data", "'v' || c_custkey AS version")
        inc = c.where("c_acctbal > 4000").selectExpr("c_custkey AS id", "'new' AS data", "'w' || c_custkey AS version", "CASE WHEN c_custkey % 4 = 0 THEN 'v' || c_custkey END AS expected")
        return writes.bulk(cur, inc, mode)


@query("write_upsert_columns", "SELECT coalesce(c.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.a ELSE c.a END AS a, CASE WHEN c.k IS NULL THEN n.b ELSE c.b END AS b FROM (SELECT c_custkey AS k, c_name AS a, c_mktsegment AS b FROM customer WHERE c_mktsegment <> 'BUILDING') c FULL JOIN (SELECT c_custkey AS k, 'x' AS a, 'y' AS b FROM customer WHERE c_acctbal > 4000) n ON c.k = n.k")
def write_upsert_columns(spark, d):
    c = table(spark, d, "customer")
    cur = c.where("c_mktsegment <> 'BUILDING'").selectExpr("c_custkey AS k", "c_name AS a", "c_mktsegment AS b")
    return writes.upsert_columns(cur, c.where("c_acctbal > 4000").selectExpr("c_custkey AS k", "'x' AS a", "'y' AS b"), ["k"], ["a"])


@query("write_soft_delete", "SELECT doc_id AS id, lang IN ('es', 'fr') OR source = 'src1' AS deleted, CASE WHEN (lang = 'fr' OR source = 'src1') AND lang <> 'es' THEN TIMESTAMP '2024-01-20 00:00:00' END AS deleted_at FROM documents")
def write_soft_delete(spark, d):
    docs = documents_of(spark, d).select("id", "deleted").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    gone = documents_of(spark, d).where("doc_type = 'fr' OR tenant_id = 'src1'")
    return writes.soft_delete(docs, gone, F.lit(dt.datetime(2024, 1, 20)).cast("timestamp_ntz"))


@query("write_hard_delete", "SELECT doc_id AS id FROM documents WHERE lang <> 'fr'")
def write_hard_delete(spark, d):
    docs = documents_of(spark, d)
    return writes.hard_delete(docs, docs.where("doc_type = 'fr'")).select("id")


@query("write_change_detect", "SELECT event_id AS id, 'upsert' AS op FROM events WHERE event_type = 'purchase'")
def write_change_detect(spark, d):
    x = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit('{"a": 1, "p": '), "props", F.lit("}")).alias("data"), "props", "event_type")
    after = x.select("id", F.when(F.col("event_type") == "purchase", F.lit('{"a": 2}')).otherwise(F.concat(F.lit('{"p":'), "props", F.lit(', "a":1}'))).alias("data"))
    return writes.changes(x.select("id", "data"), after).select("id", "op")


@query("write_insert_absent", "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def write_insert_absent(spark, d):
    known = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "value string")
    return writes.insert_absent(known, table(spark, d, "customer").select(F.col("c_mktsegment").alias("value")), ["value"])


# Events ---------------------------------------------------------------------------------------

STREAM_SQL = "(SELECT 't' AS tenant_id, CAST(user_id AS VARCHAR) AS stream_id, user_id % 5 + 1 AS version FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 70))"


def streams_of(spark, d) -> DataFrame:
    x = table(spark, d, "events").where("event_type = 'error' AND value > 70").select("user_id").distinct()
    return x.selectExpr("'t' AS tenant_id", "CAST(user_id AS STRING) AS stream_id", "user_id % 5 + 1 AS version", "false AS archived")


def events_of(spark, d) -> DataFrame:
    return table(spark, d, "events").selectExpr("props AS data", "event_type AS type", "event_id AS id", "CAST(user_id AS STRING) AS stream_id", "ts AS timestamp", "'t' AS tenant_id", "event_id AS op_seq")


APPENDED_SQL = f"""SELECT id, stream_id, coalesce(v, 0) + n AS version, seq_id FROM (
    SELECT event_id AS id, CAST(user_id AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, 100 + row_number() OVER (ORDER BY event_id) AS seq_id FROM events)
    LEFT JOIN (SELECT stream_id AS s, version AS v FROM {STREAM_SQL}) ON s = stream_id"""


@query("event_append", APPENDED_SQL)
def event_append(spark, d):
    return ev.plan_append(streams_of(spark, d), events_of(spark, d), ev.Append.QUICK, 101).select("id", "stream_id", "version", "seq_id")


@query("event_append_server_time", "SELECT event_id AS id, TIMESTAMP '2024-02-01 00:00:00' AS timestamp FROM events")
def event_append_server_time(spark, d):
    now = F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz")
    return ev.plan_append(streams_of(spark, d), events_of(spark, d), ev.Append.SERVER_TIME, now=now).select("id", "timestamp")


@query("event_stream_versions", f"SELECT coalesce(s.stream_id, e.stream_id) AS stream_id, coalesce(e.top, s.version) AS version FROM {STREAM_SQL} s FULL JOIN (SELECT stream_id, max(version) AS top FROM ({APPENDED_SQL}) GROUP BY 1) e ON s.stream_id = e.stream_id")
def event_stream_versions(spark, d):
    s = streams_of(spark, d)
    return ev.advanced(s, ev.plan_append(s, events_of(spark, d))).select("stream_id", "version")


@query("event_refuse_zero", "SELECT event_id AS id, 'version 0' AS reason FROM events WHERE value > 50")
def event_refuse_zero(spark, d):
    return ev.refused_zero(table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("value") > 50, 0).otherwise(1).alias("version"))).select("id", "reason")


@query("event_start_stream", "SELECT CAST(user_id AS VARCHAR) AS stream_id, bool_or(event_type = 'error' AND value > 70) AS refused FROM events GROUP BY user_id")
def event_start_stream(spark, d):
    new = events_of(spark, d).select("tenant_id", "stream_id").distinct()
    ok, bad = ev.start_streams(streams_of(spark, d), new)
    return ok.select("stream_id", F.lit(False).alias("refused")).unionByName(bad.select("stream_id", F.lit(True).alias("refused")))


EXPECT_SQL = "(SELECT 't' AS tenant_id, CAST(user_id AS VARCHAR) AS stream_id, user_id % 2 AS expected FROM (SELECT DISTINCT user_id FROM events))"


@query("event_assert_version", f"SELECT e.stream_id, e.expected, coalesce(s.version, 0) AS actual FROM {EXPECT_SQL} e LEFT JOIN {STREAM_SQL} s ON e.stream_id = s.stream_id AND e.tenant_id = s.tenant_id WHERE s.version IS NULL OR s.version <> e.expected")
def event_assert_version(spark, d):
    expected = table(spark, d, "events").select("user_id").distinct().selectExpr("'t' AS tenant_id", "CAST(user_id AS STRING) AS stream_id", "user_id % 2 AS expected")
    return ev.wrong_versions(streams_of(spark, d), expected).select("stream_id", "expected", "actual")


@query("event_update_version", f"SELECT s.stream_id, CASE WHEN s.version = e.expected THEN s.version + 10 ELSE s.version END AS version FROM {STREAM_SQL} s LEFT JOIN {EXPECT_SQL} e ON s.stream_id = e.stream_id")
def event_update_version(spark, d):
    s = streams_of(spark, d)
    c = table(spark, d, "events").select("user_id").distinct().selectExpr("'t' AS tenant_id", "CAST(user_id AS STRING) AS stream_id", "user_id % 2 AS expected", "user_id % 2 + 10 AS new")
    return ev.update_versions(s, c)[0].select("stream_id", "version")


@query("event_archive", f"SELECT stream_id, version > 2 AS archived FROM {STREAM_SQL}")
def event_archive(spark, d):
    s = streams_of(spark, d)
    return ev.archive(s, s.where("version > 2")).select("stream_id", "archived")


@query("event_tombstone", "SELECT event_id AS id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 70)")
def event_tombstone(spark, d):
    s = streams_of(spark, d)
    return ev.tombstone(s, events_of(spark, d), s)[1].select("id")


@query("event_metadata", "SELECT event_id AS id, props AS data, CAST(user_id AS VARCHAR) AS stream_id, event_id AS version, 'cause ' || event_type AS causation_id, CAST(NULL AS VARCHAR) AS headers FROM events")
def event_metadata(spark, d):
    x = events_of(spark, d).select("*", F.col("op_seq").alias("version"), F.concat(F.lit("cause "), "type").alias("causation_id"))
    return ev.laid_out(x, ("causation_id", "headers")).select(F.col("id").cast("long").alias("id"), "data", "stream_id", "version", "causation_id", "headers")


@query("event_progress", "SELECT event_type AS shard, greatest(max(event_id), 500) AS last_seq FROM events GROUP BY 1")
def event_progress(spark, d):
    x = table(spark, d, "events").select(F.col("event_type").alias("shard"), F.col("event_id").alias("seq_id"))
    return ev.progress(x.select("shard").distinct().withColumn("last_seq", F.lit(500).cast("long")), x)


# Partitions -----------------------------------------------------------------------------------

NOW = dt.datetime(2024, 1, 20)
DAILY = partition.RollingWindow(partition.Period.DAY, 5, 2)


@query("part_range", "SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-11' THEN 'early' WHEN ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21' THEN 'middle' ELSE 'default' END AS suffix FROM events")
def part_range(spark, d):
    day = lambda n: dt.datetime(2024, 1, n)
    ranges = [("early", day(1), day(11)), ("middle", day(11), day(21))]
    return table(spark, d, "events").select("event_id", partition.by_range(F.col("ts"), ranges).alias("suffix"))


@query("part_ranges_many", "SELECT o_orderkey, CASE WHEN o_totalprice >= 0 AND o_totalprice < 200000 THEN 'b' || CAST(floor(o_totalprice / 1000) AS INTEGER) ELSE 'default' END AS suffix FROM orders")
def part_ranges_many(spark, d):
    ranges = spark.createDataFrame([(f"b{i}", i * 1000.0, (i + 1) * 1000.0) for i in range(200)], "suffix string, start double, end double")
    return partition.by_ranges(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ranges).select("o_orderkey", "suffix")


@query("part_list", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'heavy' WHEN 'MACHINERY' THEN 'heavy' WHEN 'AUTOMOBILE' THEN 'cars' ELSE 'default' END AS suffix FROM customer")
def part_list(spark, d):
    return table(spark, d, "customer").select("c_custkey", partition.by_list(F.col("c_mktsegment"), {"heavy": ["BUILDING", "MACHINERY"], "cars": ["AUTOMOBILE"]}).alias("suffix"))


@query("part_hash", "SELECT c_custkey, ['one', 'two', 'three'][CAST(CAST('0x' || substr(md5(c_name), 1, 8) AS BIGINT) % 3 AS INTEGER) + 1] AS suffix FROM customer")
def part_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", partition.by_hash(F.col("c_name"), ["one", "two", "three"]).alias("suffix"))


_PERIODS = (("hour", "'h' || strftime(date_trunc('hour', ts), '%Y%m%d%H')"), ("day", "'d' || strftime(ts, '%Y%m%d')"), ("week", "'w' || strftime(date_trunc('week', ts), '%Y%m%d')"), ("month", "'m' || strftime(ts, '%Y%m')"), ("year", "'y' || strftime(ts, '%Y')"))
for _name, _sql in _PERIODS:

    @query(f"part_suffix_{_name}", f"SELECT event_id, {_sql} AS suffix, date_trunc('{_name}', ts)::TIMESTAMP AS start FROM events")
    def _suffix(spark, d, p=partition.Period(_name)):
        start = partition.period_start(F.col("ts"), p)
        return table(spark, d, "events").select("event_id", partition.suffix(start, p).alias("suffix"), start.cast("timestamp_ntz").alias("start"))


@query("part_suffix_week_sunday", "SELECT event_id, 'w' || strftime(date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY, '%Y%m%d') AS suffix FROM events")
def part_suffix_week_sunday(spark, d):
    return table(spark, d, "events").select("event_id", partition.suffix(partition.period_start(F.col("ts"), partition.Period.WEEK, 6), partition.Period.WEEK).alias("suffix"))


@query("part_suffix_parse", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts)::TIMESTAMP END AS start FROM events")
def part_suffix_parse(spark, d):
    s = F.when(F.col("event_id") % 3 == 0, partition.suffix(F.col("ts"), partition.Period.DAY)).when(F.col("event_id") % 3 == 1, F.lit("d2024")).otherwise(F.lit("other"))
    return table(spark, d, "events").select("event_id", partition.parse_suffix(s, partition.Period.DAY).alias("start"))


@query("part_window", "SELECT 'd' || strftime(s, '%Y%m%d') AS suffix, s::TIMESTAMP AS start, (s + INTERVAL 1 DAY)::TIMESTAMP AS \"end\" FROM (SELECT date_trunc('day', t) + to_days(CAST(n AS INTEGER)) AS s FROM (SELECT max(ts) AS t FROM events), range(-5, 3) r(n))")
def part_window(spark, d):
    now = table(spark, d, "events").agg(F.max("ts")).first()[0]
    x = DAILY.frame(F.lit(now).cast("timestamp_ntz"), spark)
    return x.select("suffix", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))


@query("part_range_delta", "SELECT 'd' || strftime(s, '%Y%m%d') AS suffix FROM (SELECT date_trunc('day', t) + to_days(CAST(n AS INTEGER)) AS s FROM (SELECT max(ts) AS t FROM events), range(-5, 3) r(n)) WHERE s NOT IN (SELECT date_trunc('day', ts) FROM events)")
def part_range_delta(spark, d):
    x = table(spark, d, "events")
    have = [(r[0],) for r in x.select(partition.suffix(F.col("ts"), partition.Period.DAY)).distinct().collect()]
    want = [(w.suffix, w.start, w.end) for w in DAILY.windows(x.agg(F.max("ts")).first()[0])]
    delta, add = partition.range_delta(want, have, managed=True)
    return spark.createDataFrame([(a[0],) for a in add], "suffix string").where(F.lit(delta is partition.Delta.ADDITIVE))


@query("part_delta_kinds", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'NONE' WHEN n_nationkey % 3 = 1 THEN 'ADDITIVE' ELSE 'REBUILD' END AS delta, n_nationkey % 3 = 0 AS same_hash FROM nation")
def part_delta_kinds(spark, d):
    ranges, out = [("a", 0, 10), ("b", 10, 20)], []
    for (k,) in sorted(table(spark, d, "nation").select("n_nationkey").collect()):
        want = ranges + [("c", 20, 30)] if k % 3 == 1 else [("a", 0, 5)] if k % 3 == 2 else ranges
        out.append((k, partition.range_delta(want, ranges)[0].name, partition.hash_delta([r[0] for r in want], ["a", "b"]) is partition.Delta.NONE))
    return spark.createDataFrame(out, "k long, delta string, same_hash boolean").withColumn("k", F.col("k").cast(dict(table(spark, d, "nation").dtypes)["n_nationkey"]))


@query("part_retention", "SELECT 'd' || strftime(ts, '%Y%m%d') AS suffix, date_trunc('day', ts) < TIMESTAMP '2024-01-15' AS aged FROM events GROUP BY ALL")
def part_retention(spark, d):
    have = [r[0] for r in table(spark, d, "events").select(partition.suffix(F.col("ts"), partition.Period.DAY).alias("s")).distinct().collect()]
    plan = partition.roll(DAILY, have, NOW)
    return spark.createDataFrame([(s, s in plan.drop) for s in have], "suffix string, aged boolean")


@query("part_list_registry", "SELECT lower(regexp_replace(s, '[^A-Za-z0-9_]', '_', 'g')) AS suffix, list(DISTINCT v ORDER BY v) AS \"values\" FROM (SELECT c_mktsegment AS v, substr(c_mktsegment, 1, 1) || '-' AS s FROM customer) GROUP BY 1")
def part_list_registry(spark, d):
    return partition.list_registry(table(spark, d, "customer").select(F.col("c_mktsegment").alias("value"), F.concat(F.substring("c_mktsegment", 1, 1), F.lit("-")).alias("suffix")))


@query("part_drop_value", "SELECT lower(c_mktsegment) AS suffix FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def part_drop_value(spark, d):
    x = table(spark, d, "customer").select(F.col("c_mktsegment").alias("value"), F.col("c_mktsegment").alias("suffix")).distinct()
    return partition.drop_value(x, "BUILDING")[1]


@query("part_rebuild", "SELECT c_custkey AS id, c_name AS title, c_acctbal FROM customer")
def part_rebuild(spark, d):
    return partition.rebuild(table(spark, d, "customer"), {"c_custkey": "id", "c_name": "title"}, ["id", "title", "c_acctbal", "made"], {"made"})


# Tenants and identities -----------------------------------------------------------------------

POOL = ["db0", "db1", "db2"]
FNV_SQL = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(s_name, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


@query("tenant_hash", f"SELECT s_suppkey, CAST({FNV_SQL} AS BIGINT) AS hash, 'db' || CAST({FNV_SQL} % 3 AS INTEGER) AS db FROM supplier")
def tenant_hash(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", tenancy.fnv1a(F.col("s_name")).alias("hash"), tenancy.by_hash(F.col("s_name"), POOL).alias("db"))


@query("tenant_smallest", "SELECT n_name AS database_id, n FROM (SELECT n_nationkey, n_name, n_regionkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, 3) WHERE n_regionkey <> 2 ORDER BY n, n_nationkey LIMIT 1")
def tenant_smallest(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name", "n_regionkey").agg(F.count("c_custkey").alias("tenant_count"))
    pool = n.select(F.col("n_name").alias("database_id"), "tenant_count", (F.col("n_regionkey") == 2).alias("is_full"), F.col("n_nationkey").alias("position"))
    return tenancy.smallest(pool).select("database_id", F.col("tenant_count").alias("n"))


@query("tenant_assignment", "SELECT c_custkey, CASE WHEN n_regionkey < 3 THEN 'db' || c_nationkey % 3 END AS database_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def tenant_assignment(spark, d):
    a = table(spark, d, "nation").where("n_regionkey < 3").selectExpr("n_nationkey AS tenant_id", "'db' || n_nationkey % 3 AS database_id")
    return tenancy.assigned(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("tenant_id")), a).select("c_custkey", "database_id")


@query("tenant_ordinals", "SELECT n_name AS tenant_id, CASE WHEN n_regionkey = 0 THEN 7 ELSE 7 + dense_rank() OVER (PARTITION BY n_regionkey = 0 ORDER BY n_regionkey) END AS ordinal FROM nation WHERE n_nationkey <> 0")
def tenant_ordinals(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("tenant_id"), F.concat(F.lit("R"), "n_regionkey").alias("bucket"), "n_nationkey")
    known = n.where("n_nationkey = 0").select("tenant_id", F.lit("r0").alias("bucket"), F.lit(7).alias("ordinal"))
    return tenancy.ordinals(known, n.drop("n_nationkey")).select("tenant_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("tenant_drop", "SELECT c_custkey FROM customer WHERE c_nationkey <> 3")
def tenant_drop(spark, d):
    data = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("tenant_id"))
    reg = data.select("tenant_id").distinct()
    return tenancy.drop_tenant(reg, data, "3", tenancy.DropTenant.DELETE_DATA)[1].select("c_custkey")


@query("id_hilo", "SELECT o_orderkey, CAST((3 + i // 100) * 100 + 1 + i % 100 AS BIGINT) AS id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)")
def id_hilo(spark, d):
    return tenancy.hilo(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", first_hi=3, max_lo=100)


@query("id_sequence", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders")
def id_sequence(spark, d):
    return ordering.dense_index(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", name="n").select("o_orderkey", "n")


@query("id_assign_missing", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'customer/' || c_custkey ELSE c_name END AS id FROM customer")
def id_assign_missing(spark, d):
    x = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("id"))
    return tenancy.assign_missing(x, "id", tenancy.keyed("customer", F.col("c_custkey")))


@query("id_time_ordered", "SELECT event_id, printf('%012x', epoch_us(ts) // 1000) || '7' AS head, 36 AS n, true AS variant FROM events")
def id_time_ordered(spark, d):
    u = tenancy.time_ordered_uuid(F.col("ts").cast("timestamp"), F.col("event_id"))
    x = table(spark, d, "events").select("event_id", u.alias("u")).dropDuplicates(["u"])  # none is given twice
    return x.select("event_id", F.substring(F.replace("u", F.lit("-")), 1, 13).alias("head"), F.length("u").alias("n"), F.substring("u", 20, 1).isin(*"89ab").alias("variant"))


@query("id_hilo_stored", "SELECT o_orderkey, CASE WHEN i < h THEN i + 1 ELSE ((h + 99) // 100) * 100 + i - h + 1 END AS id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey % 2, o_orderkey) - 1 AS i, count(*) FILTER (WHERE o_orderkey % 2 = 0) OVER () AS h FROM orders)")
def id_hilo_stored(spark, d):
    o, ids = table(spark, d, "orders").select("o_orderkey"), admin.HiLo(shared_path(spark, "hilo"), "orders", 100)
    even, odd = (ids.assign(o.where(F.col("o_orderkey") % 2 == r), "o_orderkey") for r in (0, 1))  # as two drivers would, one after the other
    return even.unionByName(odd)


@query("tenant_explicit", "SELECT n_name AS tenant, CASE WHEN n_regionkey < 2 THEN 'db' || n_regionkey ELSE 'UnknownTenant' END AS found FROM nation")
def tenant_explicit(spark, d):
    rows = table(spark, d, "nation").select("n_name", "n_regionkey").collect()
    given, out = {r[0]: f"db{r[1]}" for r in rows if r[1] < 2}, []
    for name, _ in rows:
        try:
            out.append((name, tenancy.explicit(name, given)))
        except tenancy.UnknownTenant as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "tenant string, found string")


@query("tenant_empty_pool", "SELECT n_regionkey, CASE WHEN max(n_nationkey) > 22 THEN 'EmptyPool' ELSE min(n_name) END AS found FROM nation GROUP BY 1")
def tenant_empty_pool(spark, d):
    n, out = table(spark, d, "nation"), []
    for r, top in sorted(n.groupBy("n_regionkey").agg(F.max("n_nationkey")).collect()):
        pool = n.where(F.col("n_regionkey") == r).select(F.col("n_name").alias("database_id"), F.lit(0).alias("tenant_count"), F.lit(top > 22).alias("is_full"), F.col("n_name").alias("position"))
        try:
            out.append((r, tenancy.smallest_of(pool)))
        except tenancy.EmptyPool as e:
            out.append((r, type(e).__name__))
    return spark.createDataFrame(out, f"n_regionkey {dict(n.dtypes)['n_regionkey']}, found string")


# Functions ------------------------------------------------------------------------------------


@query("udf_scalar", "SELECT p_partkey, p_size * 2 AS twice, p_size * 10 + 1 AS sum FROM part")
def udf_scalar(spark, d):
    r = registry.Registry()
    r.add(registry.Scalar("corvane_double", "int", sql="x * 2", parameters=(("x", "int"),)))
    r.add(registry.Scalar("corvane_sum", "int", lambda x, y: x * 10 + y))
    r.register_all(spark)
    return table(spark, d, "part").select("p_partkey", registry.call("corvane_double", F.col("p_size")).alias("twice"), registry.call("corvane_sum", F.col("p_size"), F.lit(1)).alias("sum"))


@query("udf_aggregate", "SELECT event_type, CAST(sum(event_id % 7) AS BIGINT) AS total FROM events GROUP BY 1")
def udf_aggregate(spark, d):
    total = registry.Fold("my_sum", F.lit(0).cast("long"), lambda a, x: a + x, merge=lambda a, b: a + b)
    return total.over(table(spark, d, "events").select("event_type", "event_id", (F.col("event_id") % 7).alias("v")), ["event_type"], "v", ["event_id"], "total")


@query("udf_aggregate_finish", "SELECT user_id, '#' || count(*) AS text FROM events GROUP BY 1")
def udf_aggregate_finish(spark, d):
    count = registry.Fold("my_count", F.lit(0).cast("long"), lambda a, x: a + 1, lambda a: F.concat(F.lit("#"), a.cast("string")))
    return table(spark, d, "events").groupBy("user_id").agg(count("event_id", "event_id").alias("text"))


@query("udf_stored", "SELECT n_nationkey, n_nationkey + 42 AS answer FROM nation")
def udf_stored(spark, d):
    registry.Registry().add(registry.Scalar("corvane_answer", "int", sql="x + 42", parameters=(("x", "int"),))).register_all(spark)
    return table(spark, d, "nation").selectExpr("n_nationkey", "corvane_answer(n_nationkey) AS answer")


@query("fn_full_text", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])licensed([^a-z0-9_]|$)') AND regexp_matches(lower(text), '(^|[^a-z0-9_])under([^a-z0-9_]|$)')")
def fn_full_text(spark, d):
    return table(spark, d, "documents").where(scalar.matches_words(F.col("text"), "licensed", "under")).select("doc_id")


@query("fn_masked", "SELECT c_custkey, lower(c_mktsegment) AS m FROM customer")
def fn_masked(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalar.masked("lower(?)", "c_mktsegment").alias("m"))


@query("fn_fingerprint", "SELECT n_regionkey, upper(sha256(string_agg(n_name, chr(10) ORDER BY n_name))) AS print FROM nation GROUP BY 1")
def fn_fingerprint(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(scalar.fingerprint(F.collect_list("n_name")).alias("print"))


@query("fn_sanitised", "SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9_]', '_', 'g') AS suffix FROM part")
def fn_sanitised(spark, d):
    return table(spark, d, "part").select("p_partkey", partition.sanitised(F.col("p_brand")).alias("suffix"))


@query("fn_array_containment", "SELECT user_id, list_has_all(list(DISTINCT event_type), ['purchase', 'signup']) AS both FROM events GROUP BY 1")
def fn_array_containment(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(scalar.contains_all(F.collect_set("event_type"), F.array(F.lit("purchase"), F.lit("signup"))).alias("both"))


@query("fn_json_equal", "SELECT event_id, event_id % 2 = 0 AS same FROM events")
def fn_json_equal(spark, d):
    a = F.concat(F.lit('{"x":1,"y":'), F.col("event_id").cast("string"), F.lit("}"))
    b = F.concat(F.lit('{"y": '), (F.col("event_id") + F.col("event_id") % 2).cast("string"), F.lit(', "x": 1}'))
    return table(spark, d, "events").select("event_id", (~writes.json_changed(a, b)).alias("same"))


# Schemas --------------------------------------------------------------------------------------


#: DuckDB's names of the test tables' types as Spark's.
ACTUAL = "(SELECT column_name AS name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE lower(column_type) END AS type FROM (DESCRIBE {}))"
CHANGED = "(SELECT CASE WHEN name = 'c_name' THEN 'c_label' ELSE upper(name) END AS name, CASE WHEN name = 'c_acctbal' THEN 'string' ELSE type END AS type FROM {})"


def changed(t: schema.Table) -> schema.Table:
    """A table whose declaration differs: a column of another name, one of another type, names in capitals."""
    cols = [schema.Column("c_label" if c.name == "c_name" else c.name.upper(), "string" if c.name == "c_acctbal" else c.type) for c in t.columns]
    return schema.Table(t.schema, t.name, tuple(cols))


@query(
    "schema_diff",
    f"""SELECT coalesce(e.name, a.name) AS name, CASE WHEN a.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'extra' WHEN a.type = e.type THEN 'matched' ELSE 'different' END AS state
        FROM {CHANGED.format(ACTUAL.format("customer"))} e FULL JOIN {ACTUAL.format("customer")} a ON lower(e.name) = a.name""",
)
def schema_diff(spark, d):
    with database(spark) as db:
        have = declared(table(spark, d, "customer"), db, "customer")
        schema.Store(spark, [have]).apply()
        x = schema.determine(spark, [changed(have)]).deltas[0].columns
    rows = [(c.name, "missing") for c in x.missing] + [(c.name, "extra") for c in x.extra] + [(p[0].name, s) for s in ("different", "matched") for p in getattr(x, s)]
    return spark.createDataFrame(rows, "name string, state string")


@query("schema_catalog", f"SELECT 'customer' AS tab, name, type FROM {ACTUAL.format('customer')} UNION ALL SELECT 'nation', name, type FROM {ACTUAL.format('nation')}")
def schema_catalog(spark, d):
    with database(spark) as db:
        schema.Store(spark, [declared(table(spark, d, t), db, t) for t in ("nation", "customer")]).apply()
        rows = [(t, c.name, c.type) for t in schema.objects(spark, db)["tables"] for c in schema.read_table(spark, db, t).columns]
    return spark.createDataFrame(rows, "tab string, name string, type string")


def after_changes(spark, d, back: bool) -> DataFrame:
    """The rows of customer after a migration in place and by rebuild, and after its rollback."""
    with database(spark) as db:
        c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
        have = declared(c, db, "customer")
        schema.Store(spark, [have]).apply()
        c.write.insertInto(have.identifier)
        new = schema.Table(db, "customer", (have.columns[0], schema.Column("c_label", "string"), schema.Column("c_acctbal", "string"), schema.Column("made", "int", default="7")), ("c_custkey",))
        m = schema.determine(spark, [new])
        m.run(spark)
        schema.Store(spark, [new]).assert_matches()
        if back:
            m.roll_back(spark)
            schema.Store(spark, [have]).assert_matches()
        return cut(spark.table(have.identifier))


@query("schema_update", "SELECT c_custkey, c_name AS c_label, 7 AS made FROM customer")
def schema_update(spark, d):
    return after_changes(spark, d, False).select("c_custkey", "c_label", "made")


@query("schema_rollback", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def schema_rollback(spark, d):
    return after_changes(spark, d, True)


@query("schema_renames", f"SELECT name AS was, 'c_label' AS becomes FROM {ACTUAL.format('customer')} WHERE name = 'c_name'")
def schema_renames(spark, d):
    have = declared(table(spark, d, "customer"), "x", "customer")
    return spark.createDataFrame(list(schema.renames(schema.diff(changed(have), have)).items()), "was string, becomes string")


KINDS = "['INVALID', 'UPDATE', 'CREATE', 'NONE']"


def states(rows: list) -> dict[int, list[schema.TableDelta]]:
    """Deltas of tables, one for each nation, by region; a nation's key decides its kind."""
    out: dict[int, list[schema.TableDelta]] = {}
    for key, name, region in rows:
        t = schema.Table("x", name, (schema.Column("a", "int"),))
        wider = schema.Table("x", name, (*t.columns, schema.Column("b", "int")))
        parted = schema.Table("x", name, t.columns, partitioned_by=("a",))
        out.setdefault(region, []).append([schema.diff(parted, t), schema.diff(wider, t), schema.diff(t, None), schema.diff(t, t)][key % 4])
    return out


def nations(spark, d) -> list:
    return [tuple(r) for r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


@query("schema_worst_difference", f"SELECT CAST(n_regionkey AS BIGINT) AS region, {KINDS}[min(n_nationkey % 4) + 1] AS worst FROM nation GROUP BY 1")
def schema_worst_difference(spark, d):
    return spark.createDataFrame([(r, schema.Migration(tuple(ds)).difference.name) for r, ds in states(nations(spark, d)).items()], "region long, worst string")


@query(
    "schema_gates",
    """SELECT n_name AS name, g AS gate, (k = 3 OR g = 'ALL' OR (g = 'CREATE_ONLY' AND k = 2) OR (g = 'CREATE_OR_UPDATE' AND k IN (1, 2))) AS allowed
       FROM (SELECT n_name, n_nationkey % 4 AS k FROM nation), (VALUES ('NONE'), ('CREATE_ONLY'), ('CREATE_OR_UPDATE'), ('ALL')) v(g)""",
)
def schema_gates(spark, d):
    def allowed(x: schema.TableDelta, gate: schema.AutoCreate) -> bool:
        try:
            schema.Migration((x,)).check(gate)
        except schema.NotAllowed:
            return False
        return True

    every = [x for ds in states(nations(spark, d)).values() for x in ds]
    return spark.createDataFrame([(x.expected.name, g.name, allowed(x, g)) for x in every for g in schema.AutoCreate], "name string, gate string, allowed boolean")


def related(spark, d) -> list[schema.Table]:
    """A table for each nation, which refers to that of its region."""
    regions = sorted({r for *_, r in nations(spark, d)})
    one = lambda name, keys=(): schema.Table("x", name, (schema.Column("id", "int"), schema.Column("up", "int")), foreign_keys=keys)
    return [one(f"n{k}", (schema.ForeignKey(f"fk{k}", ("up",), f"r{r}", ("id",)),)) for k, _, r in nations(spark, d)] + [one(f"r{r}") for r in regions]


ORDERED = "(SELECT 'r' || n_regionkey AS name, 0 AS level, n_regionkey AS k FROM nation GROUP BY n_regionkey UNION ALL SELECT 'n' || n_nationkey, 1, n_nationkey FROM nation)"


@query("sort_topological", f"SELECT name, row_number() OVER (ORDER BY level, k) AS at FROM {ORDERED}")
def sort_topological(spark, d):
    return spark.createDataFrame([(t.name, i + 1) for i, t in enumerate(schema.Store(spark, related(spark, d)).order())], "name string, at long")


@query("schema_script", f"SELECT row_number() OVER (ORDER BY level, k) AS at, 'CREATE TABLE IF NOT EXISTS `x`.`' || name || '` (`id` int, `up` int) USING parquet' AS statement FROM {ORDERED}")
def schema_script(spark, d):
    made = batch.statements(schema.Store(spark, related(spark, d)).script())
    return spark.createDataFrame([(i + 1, x.split(" TBLPROPERTIES")[0]) for i, x in enumerate(made)], "at long, statement string")


@query("schema_snapshot", "SELECT 'n' || n_nationkey AS name, 'r' || n_regionkey AS refers FROM nation UNION ALL SELECT DISTINCT 'r' || n_regionkey, NULL FROM nation")
def schema_snapshot(spark, d):
    back = schema.from_snapshot(schema.snapshot(related(spark, d)))
    return spark.createDataFrame([(t.name, t.foreign_keys[0].table if t.foreign_keys else None) for t in back], "name string, refers string")


@query("schema_snapshot_changes", "SELECT 'up' AS way, 'create' AS kind, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS n FROM nation UNION ALL SELECT 'up', 'drop', count(*) FILTER (WHERE n_nationkey % 2 = 1) FROM nation UNION ALL SELECT 'down', 'create', count(*) FILTER (WHERE n_nationkey % 2 = 0) FROM nation UNION ALL SELECT 'down', 'drop', count(*) FILTER (WHERE n_nationkey % 2 = 1) FROM nation")
def schema_snapshot_changes(spark, d):
    every = [schema.Table("x", name) for _, name, _ in nations(spark, d)]
    up, down = schema.snapshot_changes(every[1::2], every[::2])
    rows = [(way, a.kind) for way, actions in (("up", up), ("down", down)) for a in actions]
    return spark.createDataFrame(rows, "way string, kind string").groupBy("way", "kind").agg(F.count("*").alias("n"))


@query("schema_text_differs", "SELECT n_name AS name, n_nationkey % 2 = 1 AS differs FROM nation")
def schema_text_differs(spark, d):
    rows = nations(spark, d)
    return spark.createDataFrame([(n, schema.text_differs(f"SELECT '{n}' AS x", f" select '{n.lower()}' as x ;" if k % 2 == 0 else f"select '{n}' as y")) for k, n, _ in rows], "name string, differs boolean")


@query("schema_views", "SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def schema_views(spark, d):
    """A view, a materialized one over it that is refreshed, and a synonym of that."""
    with database(spark) as db:
        for t in ("nation", "customer"):
            table(spark, d, t).createOrReplaceTempView(f"corvane_{t}")
        table(spark, d, "nation").write.saveAsTable(f"{db}.nation")
        schema.create_view(spark, f"{db}.names", f"SELECT n_nationkey, n_name FROM {db}.nation")
        schema.refresh_materialized(spark, db, "counts", f"SELECT *, 0L AS n FROM {db}.names")
        schema.refresh_materialized(spark, db, "counts", f"SELECT n_nationkey, n_name, count(c_custkey) AS n FROM {db}.names LEFT JOIN corvane_customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
        schema.create_synonym(spark, f"{db}.also", f"{db}.counts")
        got = spark.table(f"{db}.also")
        return spark.createDataFrame(got.collect(), got.schema)


@query("schema_user_types", "SELECT c_custkey, 'segment' AS type FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT c_custkey, 'positive' FROM customer WHERE c_acctbal <= 0")
def schema_user_types(spark, d):
    c = table(spark, d, "customer")
    kinds = [(schema.UserType("segment", values=("BUILDING", "MACHINERY")), "c_mktsegment"), (schema.UserType("positive", base="double", check="VALUE > 0"), "c_acctbal")]
    a, b = (k.violations(c, col).select("c_custkey", F.lit(k.name).alias("type")) for k, col in kinds)
    return a.unionByName(b)


@query("store_delete_and_reset", "SELECT 'filled' AS step, count(*) AS n FROM nation UNION ALL SELECT 'emptied', 0 UNION ALL SELECT 'reset', count(*) FROM region")
def store_delete_and_reset(spark, d):
    with database(spark) as db:
        t = declared(table(spark, d, "nation").select("n_nationkey"), db, "keys")
        store = schema.Store(spark, [t])
        store.ensure("keys")
        table(spark, d, "nation").select("n_nationkey").write.insertInto(t.identifier)
        out = [("filled", spark.table(t.identifier).count())]
        store.delete_all()
        out.append(("emptied", spark.table(t.identifier).count()))
        store.reset(lambda s: table(s, d, "region").select("r_regionkey").write.insertInto(t.identifier))
        out.append(("reset", spark.table(t.identifier).count()))
    return spark.createDataFrame(out, "step string, n long")


@query("store_apply_once", "SELECT DISTINCT who, did FROM region, (VALUES ('first', 'CREATE'), ('second', 'NONE'), ('wider', 'UPDATE')) v(who, did)")
def store_apply_once(spark, d):
    with database(spark) as db:
        t = declared(table(spark, d, "region"), db, "region")
        wide = schema.Table(db, "region", (*t.columns, schema.Column("more", "int")))
        folder = shared_path(spark, "stores")
        out = [(who, schema.Store(spark, [x], folder=folder).apply().name) for who, x in (("first", t), ("second", t), ("wider", wide))]
    return spark.createDataFrame(out, "who string, did string")


@query("database_admin", "SELECT 'corvane_' || lower(r_name) AS name, true AS made, false AS after_drop FROM region WHERE r_name NOT LIKE '% %'")
def database_admin(spark, d):
    dbs, out = admin.Databases(spark), []
    for (r,) in table(spark, d, "region").select("r_name").where("r_name NOT LIKE '% %'").collect():
        db = admin.Database(f"corvane_{r.lower()}", comment=f"it's {r}")
        admin.Specification(db).ensure(dbs)
        made = dbs.exists(db.name) and db.name in dbs.names()
        dbs.drop(db.name)
        out.append((db.name, made, dbs.exists(db.name)))
    return spark.createDataFrame(out, "name string, made boolean, after_drop boolean")


@query("names_of_tables", "SELECT n_name AS name, '`' || n_name || '`' AS delimited, substr(n_name, 1, 4) AS shortened, n_name AS back FROM nation")
def names_of_tables(spark, d):
    rows = [n for _, n, _ in nations(spark, d)]
    return spark.createDataFrame([(n, names.delimited(n), names.shortened(n, 4), names.split_qualified(names.qualified("s.t", n))[1]) for n in rows], "name string, delimited string, shortened string, back string")


@query("names_normalised", "SELECT DISTINCT strftime(o_orderdate + INTERVAL 22 HOUR, '%Y-%m-%d %H:%M:%S') AS bound FROM orders")
def names_normalised(spark, d):
    days = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd")).distinct().collect()
    return spark.createDataFrame([(names.normalised(f"'{r[0]} 23:00:00+01:00'"),) for r in days], "bound string").distinct()


@query("schema_fk_check", "SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'MACHINERY')")
def schema_fk_check(spark, d):
    key = schema.ForeignKey("fk", ("o_custkey",), "customer", ("c_custkey",))
    return schema.orphans(table(spark, d, "orders"), table(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'"), key).select("o_orderkey")


@query("schema_check_violations", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT l_discount <= l_tax")
def schema_check_violations(spark, d):
    return schema.violations(table(spark, d, "lineitem"), schema.Check("tax", "l_discount <= l_tax")).select("l_orderkey", "l_linenumber")


@query("schema_repeated_keys", "SELECT l_orderkey, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def schema_repeated_keys(spark, d):
    return schema.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey"])


@query("view_pass_through", "SELECT c_mktsegment, avg(c_acctbal) AS mean FROM customer GROUP BY 1")
def view_pass_through(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("corvane_customer")
    return batch.run(spark, "SELECT c_mktsegment, avg(c_acctbal) AS mean FROM corvane_customer GROUP BY 1")


