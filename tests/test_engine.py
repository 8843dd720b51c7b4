"""Operators on small fixtures, against procedural models, and the shape of plans."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from dimweave.functions import scalars as S
from dimweave.functions.types import DataType, coerce, coerces, parse_date
from dimweave.operators import filters as R
from dimweave.operators import transforms as X
from dimweave.operators.dimensions import build_dimension, latest_by_key, versions_by_key
from dimweave.operators.lookups import Lookup, look_up, look_up_as_of
from dimweave.operators.sequences import SequenceStore, dense_ids, numbered_by
from dimweave.operators.spec import FieldSpec, Role, dimension, fact, versioned
from dimweave.plans.partitioning import merge_bucketed, write_bucketed, write_parts
from dimweave.plans.planner import Numbered, Plan, Transfer
from dimweave.plans.publish import copy_first_lines, count_lines, exists, fan_out, publish, recover, rename
from dimweave.sources.delimited import DelimitedSource, parse_lines, rejected_lines, text_fields

LOAD = dt.date(2030, 1, 1)
USERS = versioned(
    "users",
    FieldSpec("sid", DataType.LONG, Role.PRI),
    FieldSpec("k", DataType.STRING, Role.LOOKUP),
    FieldSpec("v", DataType.STRING),
    FieldSpec("version", DataType.INT, Role.SCD_VERSION),
    FieldSpec("validfrom", DataType.DATE, Role.SCD_VALIDFROM),
    FieldSpec("validto", DataType.DATE, Role.SCD_VALIDTO),
)


def day(text):
    return dt.date.fromisoformat(text) if text else None


def test_lines(spark):
    lines = spark.createDataFrame([("a\tb\t1",), ("a\tb",), ("a\tb\t1\textra",), ("a\t\t1",), ("a\tb\t",), ("a\tb\t 5",), ("a\tb\t5.5",), ("a\tb\tx",), ("",), (None,)], "value string")
    fields = (*text_fields("x", "y"), FieldSpec("n", DataType.INT))
    assert sorted(map(tuple, parse_lines(lines, fields).collect()), key=repr) == sorted([("a", "b", 1), ("a", "b", 1), ("a", None, 1), ("a", "b", None)], key=repr)
    assert rejected_lines(lines.where("value is not null"), fields).count() == 5


def test_source_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b'\"", None)], "x string, n int")
    publish(df, f"{tmp_path}/t", format="tsv", compression="gzip")
    source = DelimitedSource((f"{tmp_path}/t",), (FieldSpec("x"), FieldSpec("n", DataType.INT)))
    assert sorted(source.read(spark).collect()) == sorted(df.collect())
    assert count_lines(spark, f"{tmp_path}/t") == 2 and source.rejects(spark).count() == 0


def test_coercion(spark):
    one = lambda col: spark.range(1).select(col.alias("x")).first()["x"]
    assert [one(coerce(F.lit(t), DataType.BOOLEAN)) for t in ("TRUE", "yes", "1", "")] == [True, False, False, None]
    assert [one(coerce(F.lit(t), DataType.INT)) for t in ("7", " 5", "5.5", "3000000000", "-4")] == [7, None, None, None, -4]
    assert one(coerce(F.lit(3000000000), DataType.INT, spark.range(1).schema["id"].dataType)) == 3000000000 - (1 << 32)
    assert one(coerces(F.lit(""), DataType.INT)) and not one(coerces(F.lit("x"), DataType.DOUBLE))
    assert [str(one(parse_date(F.lit(t), lenient=True))) for t in ("2012-13-45", "2012-1-5", "2012-01-05 10:00", "junk")] == ["2013-02-14", "2012-01-05", "2012-01-05", "None"]
    assert one(parse_date(F.lit("2012-13-45"))) is None


def test_filters_are_two_valued(spark):
    df = spark.createDataFrame([("a",), ("ab",), ("a\n",), (None,)], "x string")
    keep = lambda rule: {r["x"] for r in df.transform(R.filter_fields(x=rule)).collect()}
    assert keep(R.pattern_match("a")) == {"a"}
    assert keep(R.negate(R.pattern_match("a"))) == {"ab", "a\n", None}
    assert keep(R.value_match("a", None)) == {"a", None} and keep(R.value_match()) == set()
    assert keep(R.pattern_match("A", flags=re.IGNORECASE)) == {"a"}
    with pytest.raises(TypeError):
        keep(R.value_match(1))
    with pytest.raises(ValueError):
        df.transform(R.filter_fields(nothing=R.not_null()))


def test_transforms(spark):
    df = spark.createDataFrame([("http://www.domain000.tl0000/page06966.html", "PowerServer/2.0"), ("none", None)], "url string, server string")
    host = df.transform(X.explode_field("url", r"(\w*\.\w*\.(\w*))", ("domain", "top"))).first()
    assert (host["domain"], host["top"]) == ("www.domain000.tl0000", "tl0000")
    assert df.transform(X.explode_field("SERVER", r"^\w*", ("s",))).first()["s"] == "PowerServer"
    with pytest.raises(ValueError):
        df.transform(X.rename_field("x", "y"))
    with pytest.raises(ValueError):
        df.transform(X.rename_field("url", "server"))
    assert df.transform(X.add_field("d", dt.date(2020, 1, 2))).first()["d"] == "2020-01-02"


def test_type_1(spark):
    df = spark.createDataFrame([("k", 5, "A"), ("k", 2, "B"), ("k", 9, None), (None, 1, "x")], "k string, sid long, v string")
    assert [tuple(r) for r in latest_by_key(df, ["k"], "sid", ["v"]).collect()] == [("k", 2, None)]


def model(rows):
    """Versions, row by row."""
    out = {}
    for sid, k, v, d in sorted(rows, key=lambda r: r[0]):
        kept = out.setdefault(k, [])
        d = d or (LOAD if kept else dt.date(1900, 1, 1))
        if not kept or d > kept[-1][3]:
            kept.append((sid, k, v, d))
    return sorted((s, k, v, i + 1, d, kept[i + 1][3] if i + 1 < len(kept) else None) for kept in out.values() for i, (s, k, v, d) in enumerate(kept))


def frame(spark, rows):
    return spark.createDataFrame(rows, "sid long, k string, v string, validfrom date").transform(X.project_to(USERS))


@pytest.mark.parametrize("seed", range(3))
def test_versions_equal_the_model_loaded_at_once_or_in_parts(spark, seed):
    r = random.Random(seed)
    rows = [(i, f"k{r.randrange(40)}", f"v{r.randrange(3)}", None if r.random() < 0.15 else dt.date(2000, 1, 1) + dt.timedelta(r.randrange(60))) for i in range(300)]
    want = [tuple(x) for x in model(rows)]
    got = lambda df: sorted(tuple(x) for x in df.collect())
    # a key's first row has to be the first that is loaded: parts follow the surrogate keys
    assert got(build_dimension(frame(spark, rows), USERS, LOAD)) == sorted(want)
    held = None
    for a in (0, 100, 200):
        held = build_dimension(frame(spark, [x for x in rows if a <= x[0] < a + 100]), USERS, LOAD, held)
    assert got(held) == sorted(want)
    assert got(build_dimension(frame(spark, rows).limit(0), USERS, LOAD, held)) == sorted(want)


def test_versions_need_one_shuffle(spark):
    plan = versions_by_key(frame(spark, [(1, "a", "b", LOAD)]).repartition(3), ["k"], "sid", "validfrom", load_date=LOAD)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lookups(spark):
    dim = spark.createDataFrame([("7", 70), ("8", 80)], "k string, sid int")
    rows = spark.createDataFrame([(7,), (9,), (None,)], "key int")
    assert [r["sid"] for r in rows.transform(look_up(Lookup(dim, ("k",), "sid"), "key")).collect()] == [70, -1, -1]
    versions = spark.createDataFrame([("a", 1, day("2020-01-05"), day("2020-01-09")), ("a", 2, day("2020-01-09"), None)], "k string, sid int, f date, t date")
    look = Lookup(versions, ("k",), "sid", "f", "t")
    dated = spark.createDataFrame([("a", day(d)) for d in ("2020-01-04", "2020-01-05", "2020-01-08", "2020-01-09", None)], "k string, d date")
    assert [r["sid"] for r in dated.transform(look_up_as_of(look, "k", "d")).collect()] == [-1, 1, 1, 2, 2]
    assert dated.transform(look_up_as_of(look, "k", "d", as_of=day("2020-01-06"))).collect()[-1]["sid"] == 1
    with pytest.raises(ValueError):
        look_up(look, "k")
    # frames made here have no size that the optimizer knows
    plan = dated.transform(look_up_as_of(look, "k", "d", broadcast_bytes=1 << 63))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    shuffled = dated.transform(look_up_as_of(look, "k", "d", broadcast_bytes=0))
    assert sorted(r["sid"] for r in shuffled.collect()) == [-1, 1, 1, 2, 2]


def test_numbers_and_store(spark, tmp_path):
    df = spark.range(1000).repartition(5)
    df.write.parquet(f"{tmp_path}/n")
    kept = spark.read.parquet(f"{tmp_path}/n")
    assert sorted(r["sid"] for r in dense_ids(kept, start=7).collect()) == list(range(7, 1007))
    assert all(r["sid"] == r["id"] for r in numbered_by(kept, "id").collect())
    with_others = spark.range(400_000).select((F.col("id") * 7919 % 400_009).alias("k"), F.rand(1).alias("x"), F.lit("y").alias("y"))
    numbered_by(with_others, "k").write.parquet(f"{tmp_path}/numbered")
    back = spark.read.parquet(f"{tmp_path}/numbered")
    low = back.agg(F.count("*"), F.countDistinct("sid"), F.min("sid"), F.max("sid"), F.countDistinct("k")).first()
    assert tuple(low) == (400_000, 400_000, 0, 399_999, 400_000)
    assert back.alias("a").join(back.alias("b"), F.expr("a.sid = b.sid - 1 and a.k >= b.k")).count() == 0
    assert dense_ids(df.limit(0)).count() == 0
    store = SequenceStore(spark, f"{tmp_path}/meta")
    assert store.next_of("a") == 0
    store.commit(a=10, b=3)
    store.commit(a=5)
    store.set_row_counts(t=4)
    assert (store.next_of("a"), store.next_of("b"), store.row_counts()) == (10, 3, {"t": 4})


def test_swap_recovers(spark, tmp_path):
    path = f"{tmp_path}/t"
    publish(spark.range(3), path)
    publish(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    rename(spark, path, f"{path}.old")
    recover(spark, path)
    assert exists(spark, path) and not exists(spark, f"{path}.old")


def test_plan_loads_in_order_and_merges(spark, tmp_path):
    sub = dimension("sub", FieldSpec("subid", DataType.INT, Role.PRI), FieldSpec("name", role=Role.LOOKUP))
    top = dimension("top", FieldSpec("topid", DataType.INT, Role.PRI), FieldSpec("k", role=Role.LOOKUP), FieldSpec("subid", DataType.INT))
    facts = fact("facts", FieldSpec("topid", DataType.INT), FieldSpec("m", DataType.DOUBLE))
    subs, tops = spark.createDataFrame([(1, "x"), (2, None)], "subid int, name string"), spark.createDataFrame([(10, "a", "x"), (11, "b", "z")], "topid int, k string, name string")
    rows = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "k string, m double")
    plan = Plan(
        Transfer(rows, facts, lambda k: [look_up(k["top"], "k")], ("top",)),
        Transfer(tops, top, lambda k: [look_up(k["sub"], "name")], ("sub",)),
        Transfer(subs, sub),
    )
    assert plan.stages() == [["sub"], ["top"], ["facts"]]
    assert plan.load(spark, str(tmp_path)) == {"sub": 1, "top": 2, "facts": 2}
    plan.load(spark, str(tmp_path))
    read = lambda n: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{n}").collect()))
    assert read("top") == [(10, "a", 1), (11, "b", -1)]
    assert read("facts") == [(-1, 2.0), (-1, 2.0), (10, 1.0), (10, 1.0)]
    assert spark.read.parquet(f"{tmp_path}/sub_rejects").count() == 2


def test_plan_draws_and_stores_keys(spark, tmp_path):
    dim = dimension("d", FieldSpec("id", DataType.LONG, Role.PRI), FieldSpec("k", role=Role.LOOKUP), FieldSpec("v"))
    load = lambda rows: Plan(Transfer(spark.createDataFrame(rows, "k string, v string"), dim, numbered=Numbered("id", ("k", "v")))).load(spark, str(tmp_path))
    load([("a", "1"), ("b", "1"), ("b", "2")])
    load([("b", "3"), ("c", "1")])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/d").collect())) == [(0, "a", "1"), (1, "b", "3"), (4, "c", "1")]
    store = SequenceStore(spark, f"{tmp_path}/_sequences")
    assert store.next_of("d") == 5 and store.row_counts() == {"d": 3}


def test_tracked_versions_in_parts(spark):
    fields = (*USERS.fields, FieldSpec("seen", DataType.DATE, Role.SCD_LASTSEEN))
    tracked = versioned("t", *fields, track=("v",))
    rows = [(1, "k", "A", day("2020-01-01")), (2, "k", "A", day("2020-01-05")), (3, "k", "B", day("2020-01-03")), (4, "k", "B", day("2020-01-07"))]
    make = lambda part: spark.createDataFrame(part, "sid long, k string, v string, validfrom date").transform(X.project_to(tracked))
    whole = [tuple(r) for r in build_dimension(make(rows), tracked, LOAD).orderBy("version").collect()]
    held = None
    for row in rows:
        held = build_dimension(make([row]), tracked, LOAD, held)
    assert [tuple(r) for r in held.orderBy("version").collect()] == whole
    assert [(r[0], r[2], str(r[6])) for r in whole] == [(1, "A", "2020-01-05"), (4, "B", "2020-01-07")]
    with pytest.raises(ValueError):
        build_dimension(frame(spark, []), versioned("t", *USERS.fields, track=("v",)), LOAD, frame(spark, []))


def test_first_lines_and_named_outputs(spark, tmp_path):
    spark.createDataFrame([(str(i),) for i in range(2000)], "value string").coalesce(1).write.text(f"{tmp_path}/text")
    copy_first_lines(spark, f"{tmp_path}/text", f"{tmp_path}/head", 7)
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/head").collect()] == [str(i) for i in range(7)]
    counts = fan_out(spark.range(10), {"even": lambda df: df.where("id % 2 = 0"), "all": lambda df: df}, lambda n, df: publish(df, f"{tmp_path}/{n}"))
    assert counts == {"even": 5, "all": 10} and spark.read.parquet(f"{tmp_path}/even").count() == 5


def test_failed_dimension_stops_facts(spark, tmp_path):
    dim = dimension("d", FieldSpec("id", DataType.INT, Role.PRI), FieldSpec("k", role=Role.LOOKUP))
    bad = spark.range(1).select(F.col("id").cast("int"), F.raise_error(F.lit("no")).cast("string").alias("k"))
    with pytest.raises(Exception, match="no"):
        Plan(Transfer(bad, dim), Transfer(spark.range(1), fact("f", FieldSpec("id", DataType.LONG)))).load(spark, str(tmp_path))
    assert not exists(spark, f"{tmp_path}/f")


def test_bucketed_merge_needs_no_shuffle(spark, tmp_path):
    old = build_dimension(frame(spark, [(i, f"k{i % 5}", "o", day("2020-01-01") + dt.timedelta(i)) for i in range(20)]), USERS, LOAD)
    new = frame(spark, [(100 + i, f"k{i}", "n", day("2021-01-01")) for i in range(7)]).withColumn("validfrom", F.col("validfrom").cast("date"))
    write_bucketed(old, "old_users", 4, "k")
    write_bucketed(new, "new_users", 4, "k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = merge_bucketed(spark.table("old_users"), spark.table("new_users"), USERS, LOAD)
        assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, build_dimension(new, USERS, LOAD, old).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    write_parts(new, f"{tmp_path}/parts", 3, "k")
    assert spark.read.parquet(f"{tmp_path}/parts").count() == 7


def test_stream_of_increments(spark, tmp_path):
    from dimweave.streaming.increments import merge_stream

    rows = [(i, f"k{i % 3}", "v", day("2020-01-01") + dt.timedelta(i)) for i in range(12)]
    frame(spark, rows).repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame(spark, rows).schema).parquet(f"{tmp_path}/in")
    merge_stream(stream, USERS, f"{tmp_path}/dw", f"{tmp_path}/cp", LOAD).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/dw/users").count() == 12


def test_scalars(spark):
    one = lambda col: spark.range(1).select(col.alias("x")).first()["x"]
    assert one(S.normalize_url(F.lit("http://a///b"))) == "http://a//b"
    assert [one(S.column_name_of(F.lit(i))) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert [one(S.column_index_of(F.lit(t))) for t in ("A", "AA", "zz")] == [0, 26, 701]
    assert one(S.pad_left(F.lit("abcdef"), 3, "0")) == "abcdef"
    assert one(S.split_any(F.lit("a, b;;c"), ",; ")) == ["a", "b", "c"]
    assert one(S.split_quoted(F.lit('a,"b,c",d'))) == ["a", "b,c", "d"] and one(S.split_quoted(F.lit('a,"b'))) is None
    assert one(S.array_text(F.array(F.lit("a"), F.lit(None)), "-")) == "a-null"
    assert one(S.resize_array(F.array(F.lit(1), F.lit(2)), 1)) == [1, 2, None] and one(S.resize_array(F.array(F.lit(1), F.lit(2)), -1)) == [1]
    assert one(S.date_before(F.lit("2020-01-01"), F.lit(""))) and not one(S.date_before(F.lit(""), F.lit("2020-01-01")))
    assert one(S.is_integer(F.lit("12"))) and not one(S.is_integer(F.lit(" 12"))) and not one(S.is_integer(F.lit("+12"))) and len(one(S.random_text(40, 1))) == 40
    assert one(S.key_for_value(F.create_map(F.lit("a"), F.lit(1)), 2)) is None
    assert one(S.printable_char(F.lit("\x01"))) == "0x01" and one(S.compare(F.lit(None), F.lit("a"))) == -1
