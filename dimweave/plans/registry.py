"""Queries of the engine's own operators over the driver's tables, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.types import DataType, coerce
from ..operators import filters as R
from ..operators import transforms as X
from ..operators.dimensions import align, build_dimension, distinct_keys
from ..operators.lookups import Lookup, look_up, look_up_as_of, lookup_index
from ..operators.ordering import SortKey, ordering, rows_equal
from ..operators.sequences import add_sequence
from ..operators.spec import FieldSpec, Role, dimension, fact, versioned
from ..sources.delimited import DelimitedSource, parse_lines, rejected_lines
from .partitioning import merge_bucketed, part_of, write_bucketed, write_parts
from .partitioning import prepartition as prepartitioned
from .planner import Numbered, Plan, Transfer, row_counts, union_rows
from .publish import fan_out as publish_fan_out
from .publish import publish, to_lines
from .scratch import scratch_path

LOAD_DATE = dt.date(2030, 1, 1)
#: Buckets of the stored tables that merge_bigdim makes.
BUCKETS = 8
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _iso(df: DataFrame) -> DataFrame:
    """Dates as text, alike in every client."""
    return df.select(*(F.col(c).cast("string").alias(c) if k == "date" else F.col(c) for c, k in df.dtypes))


def _iso_sql(sql: str) -> str:
    return f"SELECT * REPLACE (validfrom::VARCHAR AS validfrom, validto::VARCHAR AS validto) FROM ({sql})"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _f(name: str, kind: DataType = DataType.STRING, role: Role = Role.OTHER) -> FieldSpec:
    return FieldSpec(name, kind, role)


# --- sources, types, projections ------------------------------------------------


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Customers as tab-separated lines; every seventh is cut short, every eleventh has a bad number."""
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    whole = S.array_text(F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.when(F.col("c_custkey") % 11 == 0, "x1").otherwise(F.col("c_nationkey").cast("string")), F.coalesce("c_mktsegment", F.lit(""))), "\t")
    return c.select(F.when(F.col("c_custkey") % 7 == 0, F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name")).otherwise(whole).alias("value"))


_CUSTOMER_FIELDS = (_f("custkey", DataType.LONG), _f("name"), _f("nation", DataType.INT), _f("segment"))


@query("SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nation, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0")
def scan_delimited(spark, d):
    return parse_lines(_lines(spark, d), _CUSTOMER_FIELDS)


@query("SELECT CASE WHEN c_custkey % 7 = 0 THEN 'too few values' ELSE 'nation is no int' END AS reason, count(*) AS n FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0 GROUP BY 1")
def scan_rejects(spark, d):
    return rejected_lines(_lines(spark, d), _CUSTOMER_FIELDS).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey || chr(9) || s_name || chr(9) || coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END::VARCHAR, '') AS value FROM supplier")
def sink_lines(spark, d):
    return to_lines(_t(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey")).alias("n")))


@query("""SELECT p_partkey, p_size::INTEGER AS i, p_partkey::BIGINT AS l, p_size::SMALLINT AS s, p_retailprice AS d, p_size % 2 = 0 AS b,
CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS t, p_brand[1] AS c, NULL::INTEGER AS bad FROM part""")
def coerce_types(spark, d):
    p = _t(spark, d, "part")
    text = lambda c: F.col(c).cast("string")
    return p.select(
        "p_partkey",
        coerce(text("p_size"), DataType.INT).alias("i"),
        coerce(text("p_partkey"), DataType.LONG).alias("l"),
        coerce(text("p_size"), DataType.SHORT).alias("s"),
        coerce(text("p_retailprice"), DataType.DOUBLE).alias("d"),
        coerce(F.when(F.col("p_size") % 2 == 0, "TRUE").otherwise("yes"), DataType.BOOLEAN).alias("b"),
        coerce(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")), DataType.STRING).alias("t"),
        coerce(F.col("p_brand"), DataType.CHAR).alias("c"),
        coerce(F.concat(F.lit(" "), text("p_size")), DataType.INT).alias("bad"),
    )


@query("SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, 'load' AS origin, 7 AS batch FROM orders")
def add_rename_exclude(spark, d):
    return _t(spark, d, "orders").transform(X.chain(X.exclude_fields("o_orderdate", "unknown"), X.rename_field("O_ORDERKEY", "id"), X.add_field("origin", "load"), X.add_field("batch", 1, DataType.INT), X.add_field("BATCH", 7, DataType.INT)))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 4 > 0 THEN value END, -1.5) AS value FROM events")
def null_to_value(spark, d):
    holes = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("value"))
    return holes.transform(X.null_to_value("value", -1.5))


_HOST = r"^https?://([^/?#]+\.([a-z]+))/([a-z]+)/"


@query(rf"SELECT page_id, regexp_extract(url, '{_HOST}', 1) AS host, regexp_extract(url, '{_HOST}', 2) AS top, regexp_extract(url, '{_HOST}', 3) AS lang FROM pages WHERE regexp_matches(url, '{_HOST}')")
def explode_field(spark, d):
    return _t(spark, d, "pages").select("page_id", "url").transform(X.chain(X.explode_field("url", _HOST, ("host", "top", "lang")), X.exclude_fields("url")))


@query("SELECT s_name AS name, s_suppkey::VARCHAR AS supplier, s_nationkey::BIGINT AS nation, NULL::DOUBLE AS rating FROM supplier")
def project_to_target(spark, d):
    s = _t(spark, d, "supplier").transform(X.chain(X.rename_field("s_name", "name"), X.rename_field("s_suppkey", "supplier"), X.rename_field("s_nationkey", "nation")))
    return s.transform(X.project_to(fact("f", _f("name"), _f("supplier"), _f("nation", DataType.LONG), _f("rating", DataType.DOUBLE))))


@query("SELECT r_name AS a, r_regionkey AS r_regionkey, r_regionkey AS copied FROM region")
def column_operations(spark, d):
    return _t(spark, d, "region").transform(X.chain(X.copy_field("R_regionkey", "copied"), X.move_field("r_name", 0), X.rename_field("r_name", "a"), X.select_fields("a", "r_regionkey", "copied")))


# --- filters -------------------------------------------------------------------


def _events(spark, d):
    return _t(spark, d, "events").select("event_id", "user_id", "value", F.when(F.col("event_id") % 6 > 0, F.col("event_type")).alias("kind"))


_EV = "(SELECT event_id, user_id, value, CASE WHEN event_id % 6 > 0 THEN event_type END AS kind FROM events)"


@query(f"SELECT * FROM {_EV} WHERE kind IS NOT NULL")
def filter_not_null(spark, d):
    return _events(spark, d).transform(R.filter_fields(kind=R.not_null()))


@query(f"SELECT * FROM {_EV} WHERE kind IN ('click', 'view')")
def filter_value_match(spark, d):
    return _events(spark, d).transform(R.filter_fields(kind=R.value_match("click", "view")))


@query(f"SELECT * FROM {_EV} WHERE kind IS NULL OR kind = 'click'")
def filter_value_match_null(spark, d):
    return _events(spark, d).transform(R.filter_fields(kind=R.value_match("click", None)))


@query(f"SELECT * FROM {_EV} WHERE regexp_full_match(kind, '.*i.*')")
def filter_pattern_match(spark, d):
    return _events(spark, d).transform(R.filter_fields(kind=R.pattern_match(".*i.*")))


@query("SELECT p_partkey, p_type FROM part WHERE regexp_full_match(p_type, '(?i)(pro.*|.*steel)')")
def filter_pattern_multi(spark, d):
    import re

    return _t(spark, d, "part").select("p_partkey", "p_type").transform(R.filter_fields(p_type=R.pattern_match("PRO.*", ".*STEEL", flags=re.IGNORECASE)))


@query(f"SELECT * FROM {_EV} WHERE kind IS NULL OR NOT regexp_full_match(kind, '.*i.*')")
def filter_not_rule(spark, d):
    return _events(spark, d).transform(R.filter_fields(kind=R.negate(R.pattern_match(".*i.*"))))


@query("SELECT c_custkey, c_nationkey FROM customer")
def filter_is_type(spark, d):
    return _t(spark, d, "customer").select("c_custkey", "c_nationkey").transform(R.filter_fields(c_nationkey=(R.is_type(DataType.INT), R.negate(R.is_type(DataType.STRING)))))


@query(f"SELECT * FROM {_EV} WHERE kind IS NOT NULL AND kind NOT IN ('click') AND user_id % 2 = 0")
def filter_chain(spark, d):
    return _events(spark, d).transform(R.filter_fields(kind=(R.not_null(), R.negate(R.value_match("click"))), user_id=R.condition(lambda c: c % 2 == 0)))


@query(f"SELECT * FROM {_EV} WHERE NOT coalesce(kind IN ('click'), false)")
def filter_rejects(spark, d):
    return _events(spark, d).transform(R.rejected_by(kind=R.value_match("click")))


# --- sequences -------------------------------------------------------------------


@query("SELECT *, row_number() OVER (ORDER BY o_orderkey) + 99 AS sid FROM orders")
def sequence_dense(spark, d):
    return _t(spark, d, "orders").transform(add_sequence("sid", "o_orderkey", start=100))


@query("SELECT count(*) AS n, count(*) AS distinct_ids, 0::BIGINT AS low, count(*) - 1 AS high FROM orders")
def sequence_by_partition(spark, d):
    ids = _t(spark, d, "orders").transform(add_sequence("sid"))
    return ids.agg(F.count("*").alias("n"), F.countDistinct("sid").alias("distinct_ids"), F.min("sid").alias("low"), F.max("sid").alias("high"))


# --- dimensions ------------------------------------------------------------------

_CUSTOMERS = dimension("customers", _f("sid", DataType.LONG, Role.PRI), _f("custkey", DataType.LONG, Role.LOOKUP), _f("status"), _f("priority"))
_STEPS = X.chain(X.rename_field("o_orderkey", "sid"), X.rename_field("o_custkey", "custkey"), X.rename_field("o_orderstatus", "status"), X.rename_field("o_orderpriority", "priority"), X.project_to(_CUSTOMERS))
_TYPE1 = "SELECT min(o_orderkey) AS sid, o_custkey AS custkey, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey"


@query(_TYPE1)
def dim_type1(spark, d):
    return build_dimension(_t(spark, d, "orders").transform(_STEPS), _CUSTOMERS)


@query(_TYPE1)
def dim_type1_incremental(spark, d):
    """The older half is loaded, then only the newer one on top."""
    orders = _t(spark, d, "orders")
    half = (orders.agg(F.max("o_orderkey")).first()[0] or 0) // 2
    rows = orders.transform(_STEPS)
    return build_dimension(rows.where(F.col("sid") > half), _CUSTOMERS, existing=build_dimension(rows.where(F.col("sid") <= half), _CUSTOMERS))


@query("""SELECT min(n) AS sid, o_custkey AS custkey, arg_max(o_orderstatus, n) AS status, arg_max(o_orderpriority, n) AS priority
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) GROUP BY o_custkey""")
def dim_type1_sequence(spark, d):
    """Surrogate keys drawn from a sequence, loaded and reread."""
    source = _t(spark, d, "orders").transform(X.chain(X.rename_field("o_custkey", "custkey"), X.rename_field("o_orderstatus", "status"), X.rename_field("o_orderpriority", "priority")))
    where = scratch_path(spark)
    Plan(Transfer(source, _CUSTOMERS, numbered=Numbered("sid", ("o_orderkey",)))).load(spark, where)
    return spark.read.parquet(f"{where}/customers")


@query("""SELECT o_orderdate::DATE::VARCHAR AS day_date, min(o_orderkey) AS dateid, extract(day FROM o_orderdate::DATE)::INTEGER AS day, extract(month FROM o_orderdate::DATE)::INTEGER AS month, extract(year FROM o_orderdate::DATE)::INTEGER AS year,
extract(week FROM o_orderdate::DATE)::INTEGER AS week, extract(isoyear FROM o_orderdate::DATE)::INTEGER AS weekyear FROM orders GROUP BY ALL""")
def dim_date(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day_date"), F.col("o_orderkey").alias("dateid"))
    return _iso(distinct_keys(o, ["day_date"], "dateid").transform(X.date_parts("day_date")))


_USERS = versioned("users", _f("sid", DataType.LONG, Role.PRI), _f("user_id", DataType.LONG, Role.LOOKUP), _f("kind"), _f("version", DataType.INT, Role.SCD_VERSION), _f("validfrom", DataType.DATE, Role.SCD_VALIDFROM), _f("validto", DataType.DATE, Role.SCD_VALIDTO))


def _user_rows(spark, d, day="cast(ts as date)", order="event_id") -> DataFrame:
    e = _t(spark, d, "events").selectExpr(f"{order} as sid", "user_id", "event_type as kind", f"{day} as validfrom")
    return e.transform(X.project_to(_USERS))


def _scd_sql(day: str = "ts::DATE", order: str = "event_id", source: str = "events") -> str:
    return f"""SELECT sid, user_id, kind, row_number() OVER w::INTEGER AS version, day AS validfrom, lead(day) OVER w AS validto
FROM (SELECT *, max(day) OVER (PARTITION BY user_id ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM
  (SELECT sid, user_id, kind, coalesce(given, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY sid) = 1 THEN DATE '1900-01-01' ELSE DATE '{LOAD_DATE}' END) AS day
   FROM (SELECT {order} AS sid, user_id, event_type AS kind, {day} AS given FROM {source})))
WHERE pm IS NULL OR day > pm WINDOW w AS (PARTITION BY user_id ORDER BY sid)""".replace("row_number() OVER w::INTEGER", "(row_number() OVER w)::INTEGER")


@query(_iso_sql(_scd_sql()))
def dim_scd2(spark, d):
    return _iso(build_dimension(_user_rows(spark, d), _USERS, LOAD_DATE))


@query(_iso_sql(_scd_sql("CASE WHEN event_id % 9 > 0 THEN ts::DATE END")))
def dim_scd2_null_dates(spark, d):
    return _iso(build_dimension(_user_rows(spark, d, "case when event_id % 9 > 0 then cast(ts as date) end"), _USERS, LOAD_DATE))


@query(_iso_sql(_scd_sql(order="(event_id * 7919 % 1000003)")))
def dim_scd2_late_rows(spark, d):
    return _iso(build_dimension(_user_rows(spark, d, order="event_id * 7919 % 1000003"), _USERS, LOAD_DATE))


@query(_iso_sql(_scd_sql()))
def dim_scd2_incremental(spark, d):
    rows, held = _user_rows(spark, d), None
    last = _t(spark, d, "events").agg(F.max("event_id")).first()[0] or 0
    for part in (F.col("sid") <= last // 3, (F.col("sid") > last // 3) & (F.col("sid") <= 2 * last // 3), F.col("sid") > 2 * last // 3):
        held = build_dimension(rows.where(part), _USERS, LOAD_DATE, held)
    return _iso(held)


@query("""SELECT sid, user_id, kind, (row_number() OVER v)::INTEGER AS version, day::VARCHAR AS validfrom, (lead(day) OVER v)::VARCHAR AS validto FROM
(SELECT *, lag(kind) OVER w AS before, row_number() OVER w AS n FROM
 (SELECT event_id AS sid, user_id, event_type AS kind, ts::DATE AS day, max(ts::DATE) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM events)
 WHERE pm IS NULL OR day > pm WINDOW w AS (PARTITION BY user_id ORDER BY sid))
WHERE n = 1 OR kind IS DISTINCT FROM before WINDOW v AS (PARTITION BY user_id ORDER BY sid)""")
def dim_scd2_changes_only(spark, d):
    """Loaded in three parts, each on top of what was."""
    tracked = versioned("users", *_USERS.fields, _f("seen", DataType.DATE, Role.SCD_LASTSEEN), track=("kind",))
    rows, held = _user_rows(spark, d).withColumn("seen", F.lit(None).cast("date")), None
    last = _t(spark, d, "events").agg(F.max("event_id")).first()[0] or 0
    for part in (F.col("sid") <= last // 3, (F.col("sid") > last // 3) & (F.col("sid") <= 2 * last // 3), F.col("sid") > 2 * last // 3):
        held = build_dimension(rows.where(part), tracked, LOAD_DATE, held)
    return _iso(held.drop("seen"))


@query(_iso_sql(_scd_sql()))
def merge_bigdim(spark, d):
    """A stored dimension and its increment, both bucketed by the business key, merged without a shuffle."""
    rows = _user_rows(spark, d)
    half = (_t(spark, d, "events").agg(F.max("event_id")).first()[0] or 0) // 2
    names = []
    for part in (build_dimension(rows.where(F.col("sid") <= half), _USERS, LOAD_DATE), align(rows.where(F.col("sid") > half), _USERS)):
        path = scratch_path(spark)
        names.append(f"bigdim_{path.rsplit('-', 1)[1]}")
        write_bucketed(part, names[-1], BUCKETS, "user_id", path=path)
    old, new = map(spark.table, names)
    return _iso(merge_bucketed(old, new, _USERS, LOAD_DATE))


# --- stored targets ------------------------------------------------------------


@query(_iso_sql(_scd_sql()))
def stored_dim_swap(spark, d):
    """A versioned dimension, loaded in two parts: the second takes the first one's place by a swap."""
    where, rows = scratch_path(spark), _user_rows(spark, d)
    half = (_t(spark, d, "events").agg(F.max("event_id")).first()[0] or 0) // 2
    for part in (F.col("sid") <= half, F.col("sid") > half):
        Plan(Transfer(rows.where(part), _USERS), load_date=LOAD_DATE).load(spark, where)
    return _iso(spark.read.parquet(f"{where}/users"))


@query("SELECT p_partkey + 1 AS partid, p_brand AS brand, p_size::BIGINT AS size FROM part")
def stored_text_gzip(spark, d):
    """A named target as compressed tab-separated text, and read again."""
    where = scratch_path(spark)
    publish(_t(spark, d, "part").selectExpr("p_partkey + 1 as partid", "p_brand as brand", "p_size as size"), where, format="tsv", compression="gzip")
    return DelimitedSource((where,), (_f("partid", DataType.LONG), _f("brand"), _f("size", DataType.LONG))).read(spark)


@query("SELECT o_orderpriority AS priority, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY ALL")
def stored_by_key(spark, d):
    """One folder of files for each value of a key, read again with the key from the folder's name."""
    where = scratch_path(spark)
    publish(_t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority")), where, partition_by=("priority",))
    return spark.read.parquet(where).groupBy(F.col("priority").cast("string").alias("priority")).agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("SELECT o_custkey AS custid, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY ALL")
def stored_fact_twice(spark, d):
    """Facts that replace what was: loading twice stores them once."""
    where = scratch_path(spark)
    target = fact("orders", _f("custid", DataType.LONG), _f("price", DataType.DOUBLE))
    for _ in range(2):
        Plan(Transfer(_t(spark, d, "orders").selectExpr("o_custkey as custid", "o_totalprice as price"), target)).load(spark, where, facts="overwrite")
    return spark.read.parquet(f"{where}/orders").groupBy("custid").agg(F.count("*").alias("n"), F.max("price").alias("most"))


# --- lookups and facts -------------------------------------------------------------


def _customers(spark, d, where="c_custkey % 3 > 0") -> Lookup:
    return Lookup(_t(spark, d, "customer").where(where).select(F.col("c_custkey").alias("custkey"), (F.col("c_custkey") + 1000).alias("custid")), ("custkey",), "custid")


@query("SELECT o_orderkey, c_custkey + 1000 AS custid FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_equi(spark, d):
    return _t(spark, d, "orders").transform(X.chain(look_up(_customers(spark, d, "true"), "o_custkey", default=None), X.select_fields("o_orderkey", "custid")))


@query("SELECT o_orderkey, coalesce(c_custkey + 1000, -1) AS custid FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 > 0")
def lookup_default(spark, d):
    return _t(spark, d, "orders").transform(X.chain(look_up(_customers(spark, d), "o_custkey"), X.select_fields("o_orderkey", "custid")))


@query("SELECT o_orderkey, coalesce(a.c_custkey + 1000, -1) AS buyer, coalesce(b.c_custkey + 1000, -2) AS seller FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey LEFT JOIN customer b ON o_orderkey % 100 = b.c_custkey")
def lookup_role_playing(spark, d):
    both = _customers(spark, d, "true")
    o = _t(spark, d, "orders").withColumn("other", F.col("o_orderkey") % 100)
    return o.transform(X.chain(look_up(both, "o_custkey", "buyer"), look_up(both, "other", "seller", default=-2), X.select_fields("o_orderkey", "buyer", "seller")))


@query("SELECT o_orderkey, coalesce(c_custkey + 1000, -1) AS custid FROM orders LEFT JOIN customer ON o_custkey::VARCHAR = c_custkey::VARCHAR AND c_custkey % 3 > 0")
def lookup_text_key(spark, d):
    o = _t(spark, d, "orders").withColumn("key", F.col("o_custkey").cast("string"))
    return o.transform(X.chain(look_up(_customers(spark, d), "key"), X.select_fields("o_orderkey", "custid")))


def _users(spark, d) -> Lookup:
    return Lookup(build_dimension(_user_rows(spark, d), _USERS, LOAD_DATE), ("user_id",), "sid", "validfrom", "validto")


def _asof_sql(day: str, last: str) -> str:
    return f"""WITH dim AS ({_scd_sql()}), f AS (SELECT event_id, user_id, {day} AS day FROM events)
SELECT f.event_id, coalesce(dim.sid, -1) AS sid FROM f LEFT JOIN dim ON f.user_id = dim.user_id AND dim.validfrom <= coalesce(f.day, DATE '{last}') AND (dim.validto IS NULL OR coalesce(f.day, DATE '{last}') < dim.validto)"""


@query(_asof_sql("(ts - INTERVAL 3 DAY)::DATE", "9999-12-31"))
def lookup_as_of(spark, d):
    e = _t(spark, d, "events").selectExpr("event_id", "user_id", "cast(ts - interval 3 days as date) as day")
    return e.transform(X.chain(look_up_as_of(_users(spark, d), "user_id", "day"), X.select_fields("event_id", "sid")))


@query(_asof_sql("CASE WHEN event_id % 5 > 0 THEN ts::DATE END", "9999-12-31"))
def lookup_as_of_null_date(spark, d):
    e = _t(spark, d, "events").selectExpr("event_id", "user_id", "case when event_id % 5 > 0 then cast(ts as date) end as day")
    return e.transform(X.chain(look_up_as_of(_users(spark, d), "user_id", "day"), X.select_fields("event_id", "sid")))


@query(f"WITH dim AS ({_scd_sql()}) SELECT user_id, count(*) AS versions, arg_max(sid, validfrom) AS newest, min(sid) AS oldest FROM dim GROUP BY user_id")
def lookup_index_versions(spark, d):
    look = _users(spark, d)
    return lookup_index(look.dimension, look).select("user_id", F.size("versions").cast("long").alias("versions"), F.col("versions")[0]["sid"].alias("newest"), F.element_at("versions", -1)["sid"].alias("oldest"))


@query("SELECT c_custkey AS custid, c_name AS name, n_nationkey + 10 AS nationid, r_regionkey + 20 AS regionid FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def snowflake_dims(spark, d):
    return _snowflake(spark, d)["customers"].join(_snowflake(spark, d)["nations"].select("nationid", "regionid"), "nationid").select("custid", "name", "nationid", "regionid")


def _snowflake(spark, d) -> dict[str, DataFrame]:
    region = dimension("regions", _f("regionid", DataType.INT, Role.PRI), _f("region", DataType.INT, Role.LOOKUP))
    nation = dimension("nations", _f("nationid", DataType.INT, Role.PRI), _f("nation", DataType.INT, Role.LOOKUP), _f("regionid", DataType.INT))
    customer = dimension("customers", _f("custid", DataType.LONG, Role.PRI), _f("name", role=Role.LOOKUP), _f("nationid", DataType.INT))
    return Plan(
        Transfer(_t(spark, d, "customer").selectExpr("c_custkey as custid", "c_name as name", "c_nationkey"), customer, lambda k: [look_up(k["nations"], "c_nationkey")], ("nations",)),
        Transfer(_t(spark, d, "nation").selectExpr("n_nationkey + 10 as nationid", "n_nationkey as nation", "n_regionkey"), nation, lambda k: [look_up(k["regions"], "n_regionkey")], ("regions",)),
        Transfer(_t(spark, d, "region").selectExpr("r_regionkey + 20 as regionid", "r_regionkey as region"), region),
    ).frames(spark)


def _star(spark, d) -> Plan:
    parts = dimension("parts", _f("partid", DataType.LONG, Role.PRI), _f("part", DataType.LONG, Role.LOOKUP), _f("brand"))
    suppliers = dimension("suppliers", _f("suppid", DataType.LONG, Role.PRI), _f("supplier", DataType.LONG, Role.LOOKUP), _f("name"))
    dates = dimension("dates", _f("dateid", DataType.INT, Role.PRI), _f("day", role=Role.LOOKUP))
    lines = fact("lines", _f("partid", DataType.LONG), _f("suppid", DataType.LONG), _f("dateid", DataType.INT), _f("quantity", DataType.DOUBLE), _f("price", DataType.DOUBLE))
    item = _t(spark, d, "lineitem")
    dated = lambda df: df.withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    number = lambda df: df.withColumn("dateid", F.unix_date(F.col("l_shipdate").cast("date")))
    return Plan(
        Transfer(_t(spark, d, "part").where("p_size > 5").selectExpr("p_partkey + 1 as partid", "p_partkey as part", "p_brand as brand"), parts),
        Transfer(_t(spark, d, "supplier").selectExpr("s_suppkey + 2 as suppid", "s_suppkey as supplier", "s_name as name"), suppliers),
        Transfer(item, dates, lambda k: [dated, number]),
        Transfer(
            item,
            lines,
            lambda k: [dated, look_up(k["parts"], "l_partkey"), look_up(k["suppliers"], "l_suppkey"), look_up(k["dates"], "day"), X.rename_field("l_quantity", "quantity"), X.rename_field("l_extendedprice", "price")],
            ("parts", "suppliers", "dates"),
        ),
        load_date=LOAD_DATE,
    )


@query("""SELECT coalesce(p_partkey + 1, -1) AS partid, coalesce(s_suppkey + 2, -1) AS suppid, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::INTEGER AS dateid, l_quantity AS quantity, l_extendedprice AS price
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 5 LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def fact_star(spark, d):
    return _star(spark, d).frames(spark)["lines"]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Events as facts that look up the version of their user, and their date."""
    days = _t(spark, d, "events").selectExpr("cast(ts as date) as day", "unix_date(cast(ts as date)) as dateid")
    dates = Lookup(distinct_keys(days, ["day"], "dateid"), ("day",), "dateid")
    e = _t(spark, d, "events").selectExpr("event_id", "user_id", "value", "cast(ts as date) as day")
    return e.transform(X.chain(look_up_as_of(_users(spark, d), "user_id", "day", "usersid"), look_up(dates, "day"), X.select_fields("event_id", "usersid", "dateid", "value")))


@query(f"""WITH dim AS ({_scd_sql()}) SELECT event_id, coalesce(sid, -1) AS usersid, date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS dateid, value
FROM events LEFT JOIN dim ON events.user_id = dim.user_id AND validfrom <= ts::DATE AND (validto IS NULL OR ts::DATE < validto)""")
def fact_as_of(spark, d):
    return flagship(spark, d)


# --- sets, counts, partitions, orders -----------------------------------------------


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name, NULL::VARCHAR AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region")
def union_inputs(spark, d):
    a = _t(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) as k", "n_name as name")
    return union_rows(a, _t(spark, d, "region").selectExpr("cast(r_regionkey as bigint) as k", "r_name as name", "'region' as extra"))


@query("SELECT 'dates' AS target, count(DISTINCT l_shipdate::DATE) AS n FROM lineitem UNION ALL SELECT 'lines', count(*) FROM lineitem")
def fan_out(spark, d):
    """Two stored targets of one parent, and the counts that were taken while they were written."""
    where, item = scratch_path(spark), _t(spark, d, "lineitem")
    steps = {"dates": lambda df: distinct_keys(df.select(F.col("l_shipdate").cast("date").alias("day")), ["day"]), "lines": lambda df: df.select("l_orderkey", "l_quantity")}
    counts = publish_fan_out(item, steps, lambda name, df: publish(df, f"{where}/{name}"))
    stored_rows = {n: spark.read.parquet(f"{where}/{n}").agg(F.count("*").alias("n")) for n in steps}
    return union_rows(*(stored_rows[n].select(F.lit(n).alias("target"), F.when(F.col("n") == counts[n], F.col("n")).alias("n")) for n in steps))


@query("SELECT 'part' AS name, count(*) AS rows FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'region', count(*) FROM region")
def table_row_counts(spark, d):
    return row_counts(part=_t(spark, d, "part"), orders=_t(spark, d, "orders"), region=_t(spark, d, "region"))


@query("SELECT count(*) AS rows, 0::BIGINT AS split_keys, 0::BIGINT AS unsorted, 0::BIGINT AS strangers FROM orders")
def prepartition(spark, d):
    """Orders dealt to sorted parts by customer, stored and in flight: keys in several parts, rows out of order, rows in another part than their key's."""
    where, orders = scratch_path(spark), _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    write_parts(orders, where, 16, "o_custkey")
    kept = spark.read.parquet(where)
    spread = kept.groupBy("o_custkey").agg(F.countDistinct("part").alias("parts")).agg(F.count(F.when(F.col("parts") > 1, 1)).alias("split_keys"))
    dealt = prepartitioned(orders, 16, "o_custkey").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    # the place in a part is sorted like the key
    sort_check = dealt.withColumn("before", F.lag("o_custkey").over(Window.partitionBy("part").orderBy("at"))).agg(F.count(F.when(F.col("before") > F.col("o_custkey"), 1)).alias("unsorted"))
    strangers = kept.agg(F.count("*").alias("rows"), F.count(F.when(F.col("part") != part_of(16, "o_custkey"), 1)).alias("strangers"))
    return union_rows(strangers, spread, sort_check).agg(*(F.max(c).alias(c) for c in ("rows", "split_keys", "unsorted", "strangers")))


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY kind NULLS FIRST, value DESC NULLS LAST, event_id) AS place FROM (SELECT *, CASE WHEN event_id % 6 > 0 THEN event_type END AS kind FROM events)""")
def sort_multi_key(spark, d):
    e = _events(spark, d)
    w = Window.partitionBy("user_id").orderBy(*ordering(e, "kind", SortKey("value", ascending=False), "event_id"))
    return e.select("event_id", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT n_nationkey, n_regionkey = n_nationkey AS same FROM nation")
def compare_rows(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", rows_equal([F.col("n_regionkey"), F.lit(None)], [F.col("n_nationkey"), F.lit(None)]).alias("same"))


# --- scalar helpers -----------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN length(c_name) >= 20 THEN c_name ELSE lpad(c_name, 20, '*') END AS padded, length(c_name) - length(replace(c_name, '0', '')) AS zeros, split_part(c_name, '#', 2) AS token,
c_custkey % 10 = 0 AS blank, lower(c_mktsegment) = 'building' AS building, CASE WHEN c_nationkey < c_custkey THEN -1 WHEN c_nationkey = c_custkey THEN 0 ELSE 1 END AS cmp, c_custkey % 4 = 0 OR c_custkey % 4 = 3 AS whole, c_name AS utf8
FROM customer""")
def scalars_string(spark, d):
    c = _t(spark, d, "customer")
    return c.select(
        "c_custkey",
        S.pad_left(F.col("c_name"), 20, "*").alias("padded"),
        S.count_char(F.col("c_name"), "0").cast("long").alias("zeros"),
        S.token_at(F.col("c_name"), "#", 1).alias("token"),
        S.is_empty(F.when(F.col("c_custkey") % 10 == 0, " \t").otherwise("x")).alias("blank"),
        S.names_match(F.col("c_mktsegment"), F.lit("Building")).alias("building"),
        S.compare(F.col("c_nationkey"), F.col("c_custkey")).alias("cmp"),
        S.is_integer(F.concat(F.element_at(F.array(*map(F.lit, ("", "+", " ", "-"))), (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_custkey").cast("string"))).alias("whole"),
        S.from_utf8(S.to_utf8(F.col("c_name"))).alias("utf8"),
    )


@query("""SELECT o_orderkey, extract(year FROM o_orderdate)::INTEGER AS y, extract(month FROM o_orderdate)::INTEGER AS m, extract(day FROM o_orderdate)::INTEGER AS dd, o_orderdate::DATE > DATE '1995-06-15' AS after,
o_orderdate::DATE < DATE '1995-06-15' AS before, epoch_ms(o_orderdate::DATE) AS millis, strftime(o_orderdate, '%Y%m%d%H%M%S') AS stamp FROM orders""")
def scalars_date(spark, d):
    o = _t(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    parts = S.date_parts(F.col("o_orderdate").cast("date"))
    return o.select(
        "o_orderkey",
        parts["year"].alias("y"),
        parts["month"].alias("m"),
        parts["day"].alias("dd"),
        S.date_after(F.col("day"), F.lit("1995-06-15")).alias("after"),
        S.date_before(F.col("day"), F.lit("1995-06-15")).alias("before"),
        S.date_to_millis(F.concat("day", F.lit(" +0000")), "yyyy-MM-dd Z").alias("millis"),
        S.timestamp_text(F.col("o_orderdate")).alias("stamp"),
    )


@query("""SELECT p_partkey, p_brand || '|null|' || p_type AS joined, 2::BIGINT AS shorter, p_type AS last, 'b' AS found, len(list_filter(string_split_regex(p_type, '[ ,]'), lambda x: x <> ''))::BIGINT AS words,
CASE WHEN p_partkey < 26 THEN chr((65 + p_partkey)::INTEGER) END AS letter, p_partkey AS back FROM part""")
def scalars_array(spark, d):
    p = _t(spark, d, "part")
    arr = F.array("p_brand", F.lit(None), "p_type")
    return p.select(
        "p_partkey",
        S.array_text(arr, "|").alias("joined"),
        F.size(S.resize_array(arr, -1)).cast("long").alias("shorter"),
        F.element_at(S.merge_arrays(F.array("p_brand"), F.array("p_type")), -1).alias("last"),
        S.key_for_value(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), 2).alias("found"),
        F.size(S.split_any(F.col("p_type"), " ,")).cast("long").alias("words"),
        F.when(F.col("p_partkey") < 26, S.column_name_of(F.col("p_partkey"))).alias("letter"),
        S.column_index_of(S.column_name_of(F.col("p_partkey"))).alias("back"),
    )


@query("SELECT page_id, regexp_replace(replace(url, '/en/', '////en/'), '([^:]/)/{2,}', '\\1/', 'g') AS url FROM pages")
def scalars_url(spark, d):
    return _t(spark, d, "pages").select("page_id", S.normalize_url(F.replace("url", F.lit("/en/"), F.lit("////en/"))).alias("url"))
