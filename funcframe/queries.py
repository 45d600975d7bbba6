"""One query for each operator over the test tables, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funcframe import operators as ops
from funcframe.dataset import Composite, Dataset
from funcframe.model import Function, Scalar, parse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ORDERS = "o_orderkey: long -> (o_custkey: long, o_orderstatus: string, o_totalprice: double, o_orderdate: string, o_orderpriority: string)"
EVENTS = "event_id: long -> (user_id: long, event_type: string, value: double)"
PARTS = "p_partkey: long -> p_retailprice: double"
LINES = "(l_orderkey: long, l_linenumber: int) -> (n: long, sum_qty: double)"
TURNS = "(conv_id: long, turn: long) -> (role: string, text: string)"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark: SparkSession, d: str) -> Dataset:
    return Dataset.of("orders", ORDERS, read(spark, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")))


def events(spark: SparkSession, d: str) -> Dataset:
    return Dataset.of("events", EVENTS, read(spark, d, "events"))


def parts(spark: SparkSession, d: str) -> Dataset:
    return Dataset.of("parts", PARTS, read(spark, d, "part"))


def lines(spark: SparkSession, d: str) -> Dataset:
    """Lines summed to a valid two-dimensional domain."""
    df = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"))
    return Dataset.of("lines", LINES, df)


def turns(spark: SparkSession, d: str) -> Dataset:
    return Dataset.of("turns", TURNS, read(spark, d, "conversations"))


def event_times(spark: SparkSession, d: str) -> Dataset:
    m = Function(Scalar("event_id", "long"), Scalar("t", "double", {"units": "seconds since 1970-01-01"}, True))
    return Dataset.of("times", m, read(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")))


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority"  # noqa: E741
L = "(SELECT l_orderkey, l_linenumber, count(*) AS n, sum(l_quantity) AS sum_qty FROM lineitem GROUP BY ALL)"
E = "event_id, user_id, event_type, value"


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 ORDER BY o_orderkey LIMIT 10")
def q_expression(s, d):
    return orders(s, d).query("o_orderkey,o_totalprice&o_totalprice>=100000&take(10)").samples()


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def q_project(s, d):
    return orders(s, d).project("o_totalprice", "o_orderpriority", "o_orderkey").samples()


@query("SELECT o_custkey, o_totalprice FROM orders")
def q_project_range(s, d):
    return orders(s, d).project("o_custkey", "o_totalprice").samples()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders")
def q_rename(s, d):
    return orders(s, d).rename("o_totalprice", "price").samples()


@query(f"SELECT {O} FROM orders WHERE o_totalprice < 5000 AND o_orderstatus != 'F'")
def q_select(s, d):
    return orders(s, d).select("o_totalprice<5000").select('o_orderstatus!="F"').samples()


@query(f"SELECT {O} FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'")
def q_select_time(s, d):
    from dataclasses import replace

    from funcframe.model import change

    ds = orders(s, d)
    m = change(ds.source_model, lambda x: Scalar(x.id, "string", {"units": "yyyy-MM-dd"}, True) if x.id == "o_orderdate" else x)
    return replace(ds, source_model=m).select("o_orderdate>=1997-06").samples()


@query("SELECT bin, count FROM (SELECT floor(p_partkey / 10.0) * 10.0 AS bin, count(*) AS count FROM part GROUP BY 1) WHERE bin <= 155 AND 155 < bin + 10")
def q_select_bin(s, d):
    return parts(s, d).group_by_bin_width(10, "count").rename("p_partkey", "bin").select("bin=155").samples()


@query(f"SELECT {O} FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def q_contains(s, d):
    return orders(s, d).contains("o_orderpriority", "1-URGENT", "5-LOW").samples()


@query(f"SELECT {E} FROM events WHERE value > 50 AND user_id < 300")
def q_filter(s, d):
    return events(s, d).filter((F.col("value") > 50) & (F.col("user_id") < 300)).samples()


@query("SELECT event_id, value FROM events")
def q_without(s, d):
    return events(s, d).without("user_id", "event_type").samples()


for _name, _make, _sql in (
    ("head", lambda x: x.head(), "ORDER BY event_id LIMIT 1"),
    ("take", lambda x: x.take(25), "ORDER BY event_id LIMIT 25"),
    ("take_right", lambda x: x.take_right(25), "ORDER BY event_id DESC LIMIT 25"),
    ("last", lambda x: x.last(), "ORDER BY event_id DESC LIMIT 1"),
    ("tail", lambda x: x.tail(), "QUALIFY row_number() OVER (ORDER BY event_id) > 1"),
    ("drop", lambda x: x.drop(100), "QUALIFY row_number() OVER (ORDER BY event_id) > 100"),
    ("drop_last", lambda x: x.drop_last(), "QUALIFY row_number() OVER (ORDER BY event_id DESC) > 1"),
    ("drop_right", lambda x: x.drop_right(100), "QUALIFY row_number() OVER (ORDER BY event_id DESC) > 100"),
    ("stride", lambda x: x.stride(7), "QUALIFY (row_number() OVER (ORDER BY event_id) - 1) % 7 = 0"),
):
    QUERIES[_name] = lambda s, d, make=_make: make(events(s, d)).samples(sort=False)
    ORACLES[_name] = f"SELECT {E} FROM events {_sql}"


@query("SELECT count(*) AS count FROM orders")
def q_count(s, d):
    return orders(s, d).count().samples()


@query("SELECT round(avg(p_retailprice), 6) AS mean, min(p_retailprice) AS min, max(p_retailprice) AS max, count(*) AS count FROM part")
def q_stats(s, d):
    return parts(s, d).stats().samples().withColumn("mean", F.round("mean", 6))


@query("SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(sum_qty), 3) AS sum_qty FROM " + L)
def q_sum(s, d):
    return lines(s, d).sum().samples().withColumn("sum_qty", F.round("sum_qty", 3))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL")
def q_count_by(s, d):
    return orders(s, d).count_by("o_orderstatus", "o_orderpriority").samples()


@query("SELECT event_type, event_id, user_id, value FROM events")
def q_group_by(s, d):
    return events(s, d).group_by("event_type").uncurry().samples()


@query("SELECT p_partkey, mean, min, max, count FROM (SELECT floor(p_partkey / 50.0) * 50.0 AS p_partkey, round(avg(p_retailprice), 6) AS mean, min(p_retailprice) AS min, max(p_retailprice) AS max, count(*) AS count FROM part GROUP BY 1)")
def q_group_by_bin_width(s, d):
    return parts(s, d).group_by_bin_width(50, "stats").samples().withColumn("mean", F.round("mean", 6))


@query("""WITH b AS (SELECT unnest(range((SELECT max(p_partkey) FROM part) // 40 + 1)) AS i)
SELECT CAST(i * 40 AS DOUBLE) AS p_partkey, (SELECT count(*) FROM part WHERE p_partkey // 40 = i) AS count FROM b""")
def q_group_by_bin(s, d):
    """As many bins as the greatest key needs."""
    last = read(s, d, "part").agg(F.max("p_partkey")).first()[0]
    return parts(s, d).group_by_bin(ops.BinSet(0, 40, 0 if last is None else last // 40 + 1), ops.Count()).samples()


@query("SELECT user_id, min_by(value, event_id) AS value FROM events GROUP BY 1")
def q_group_by_first(s, d):
    return events(s, d).without("event_type").group_by("user_id", aggregation=ops.First()).samples()


@query("SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS n, round(sum(sum_qty), 3) AS sum_qty FROM " + L + " GROUP BY 1")
def q_integrate(s, d):
    return lines(s, d).curry(1).integrate("l_linenumber").samples().withColumn("sum_qty", F.round("sum_qty", 3))


@query("SELECT l_orderkey, count(*) AS samples, list(l_linenumber ORDER BY l_linenumber)[1] AS first FROM " + L + " GROUP BY 1")
def q_curry(s, d):
    df = lines(s, d).curry(1).samples(sort=False)
    f = df.columns[1]
    return df.select("l_orderkey", F.size(f).cast("long").alias("samples"), F.col(f)[0]["l_linenumber"].alias("first"))


@query("SELECT conv_id, count(*) AS samples, arg_max(text, turn) AS last FROM conversations GROUP BY 1")
def q_curry_right(s, d):
    df = turns(s, d).curry_right(1).samples(sort=False)
    f = df.columns[1]
    return df.select("conv_id", F.size(f).cast("long").alias("samples"), F.element_at(f, -1)["text"].alias("last"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def q_uncurry(s, d):
    return turns(s, d).curry(1).uncurry().samples()


@query("SELECT conv_id, max(role) FILTER (turn = 0) AS t0_role, max(text) FILTER (turn = 0) AS t0_text, max(role) FILTER (turn = 3) AS t3_role, max(text) FILTER (turn = 3) AS t3_text FROM conversations GROUP BY 1")
def q_pivot(s, d):
    return turns(s, d).curry(1).pivot(("0", "3"), ("t0", "t3")).samples()


@query("SELECT turn, conv_id, role, text FROM conversations")
def q_transpose(s, d):
    return turns(s, d).transpose().samples()


@query("SELECT c.conv_id, t.turn, role, text FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN (SELECT DISTINCT turn FROM conversations) t LEFT JOIN conversations v ON v.conv_id = c.conv_id AND v.turn = t.turn")
def q_make_cartesian(s, d):
    return turns(s, d).make_cartesian().samples(sort=False)


@query("SELECT conv_id, role, text FROM conversations WHERE turn = 1")
def q_evaluation(s, d):
    return turns(s, d).evaluation("turn", "1").samples()


@query("SELECT o_orderkey, o_totalprice FROM orders")
def q_resample(s, d):
    return orders(s, d).project("o_orderkey", "o_totalprice").resample(read(s, d, "orders").select("o_orderkey")).samples()


@query("SELECT o_orderkey, o_totalprice FROM orders")
def q_append(s, d):
    whole = orders(s, d).project("o_orderkey", "o_totalprice")
    return Composite.of_members("both", [whole.select("o_orderkey<1000"), whole.select("o_orderkey>=1000")]).samples(sort=False)


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def q_composition(s, d):
    lookup = Dataset.of("customers", "c_custkey: long -> c_mktsegment: string", read(s, d, "customer")).lookup()
    return orders(s, d).project("o_orderkey", "o_custkey").compose(lookup).samples()


@query("SELECT o_orderkey, c_name, c_acctbal, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def q_substitution(s, d):
    df = read(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    lookup = Dataset.of("customers", "o_custkey: long -> (c_name: string, c_acctbal: double)", df).lookup()
    return orders(s, d).project("o_orderkey", "o_custkey", "o_totalprice").substitute(lookup).samples()


@query("SELECT o_orderkey, o_totalprice * 2 + o_custkey AS score FROM orders")
def q_computed(s, d):
    f = ops.Computed(parse("(o_custkey: long, o_totalprice: double) -> score: double"), lambda c, p: p * 2 + c)
    return orders(s, d).project("o_orderkey", "o_custkey", "o_totalprice").compose(f).samples()


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER w AS was, row_number() OVER w AS r, count(*) OVER () AS n FROM events WINDOW w AS (ORDER BY event_id)) WHERE r = 1 OR r = n OR was != event_type")
def q_on_change(s, d):
    return events(s, d).project("event_id", "event_type").on_change("event_type").samples(sort=False)


@query(
    """WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY event_id) AS r, event_id, value FROM events),
k AS (SELECT r, event_id, value, value AS last, true AS kept FROM e WHERE r = 1
      UNION ALL SELECT e.r, e.event_id, e.value, CASE WHEN abs(e.value - k.last) > 20 THEN k.last ELSE e.value END, NOT abs(e.value - k.last) > 20 FROM k JOIN e ON e.r = k.r + 1)
SELECT event_id, value FROM k WHERE kept"""
)
def q_max_delta(s, d):
    return events(s, d).project("event_id", "value").max_delta("value", 20).samples(sort=False)


_GAP = """WITH e AS (SELECT event_id AS x, value AS v, lead(event_id) OVER w AS nx, lead(value) OVER w AS nv FROM (SELECT event_id + 3 * (event_id // 2) AS event_id, value FROM events) WINDOW w AS (ORDER BY event_id)),
g AS (SELECT *, unnest(range(0, CAST(CASE WHEN nx - x > 1 THEN ceil((nx - x) / 1.0) - 1 ELSE 0 END AS BIGINT) + 1)) AS i, CASE WHEN nx - x > 1 THEN ceil((nx - x) / 1.0) - 1 ELSE 0 END AS extra FROM e)
SELECT x + i AS event_id, {} AS value FROM g"""


def _wide(s, d, how):
    """Every event; the domain is spread so that each second step is a gap."""
    df = read(s, d, "events").withColumn("event_id", F.expr("event_id + 3 * (event_id div 2)"))
    return Dataset.of("events", EVENTS, df).project("event_id", "value").max_gap(1, how)


@query(_GAP.format("v"))
def q_max_gap_floor(s, d):
    return _wide(s, d, "floor").samples(sort=False)


@query(_GAP.format("CASE WHEN i > 0 AND i = extra THEN nv ELSE v END"))
def q_max_gap_nearest(s, d):
    return _wide(s, d, "nearest").samples(sort=False)


@query(_GAP.format("round(CASE WHEN i = 0 THEN v ELSE v + (nv - v) * (CAST(i AS DOUBLE) / (nx - x)) END, 6)"))
def q_max_gap_linear(s, d):
    return _wide(s, d, "linear").samples(sort=False).withColumn("value", F.round("value", 6))


@query("SELECT event_id, round(epoch_us(ts) / 1e6 / 86400 - 10957, 6) AS t FROM events")
def q_convert_time(s, d):
    return event_times(s, d).convert_time("days since 2000-01-01").samples().withColumn("t", F.round("t", 6))


@query("SELECT event_id, strftime(to_timestamp(round(epoch_us(ts) / 1e3) / 1e3) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS t FROM events")
def q_format_time(s, d):
    return event_times(s, d).format_time("yyyy-MM-dd HH:mm:ss").samples()


@query("SELECT o_orderkey, year(o_orderdate) || ' ' || month(o_orderdate) || ' ' || day(o_orderdate) AS time FROM orders")
def q_time_tuple(s, d):
    from funcframe.model import Tuple

    parts_ = Tuple(tuple(Scalar(i, "int", {"units": u}) for i, u in (("y", "yyyy"), ("m", "M"), ("d", "d"))), "time")
    df = read(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.day("o_orderdate").alias("d"))
    return Dataset.of("dates", Function(Scalar("o_orderkey", "long"), parts_), df).time_tuple_to_time().samples()


def _names(s, d):
    return Dataset.of("names", "p_partkey: long -> name: binary", read(s, d, "part").select("p_partkey", F.col("p_name").cast("binary").alias("name")))


@query("SELECT p_partkey, lower(hex(p_name)) AS name FROM part")
def q_to_hex(s, d):
    return _names(s, d).to_hex("name").samples()


@query("SELECT p_partkey, to_base64(encode(p_name)) AS name FROM part")
def q_to_base64(s, d):
    return _names(s, d).to_base64("name").samples()


@query("SELECT p_partkey, list_aggregate(list_transform(range(1, length(p_name) + 1), lambda i: right(bin(ascii(p_name[i]) + 256), 8)), 'string_agg', '') AS name FROM part")
def q_to_binary(s, d):
    return _names(s, d).to_binary("name").samples()


@query("SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS v FROM embeddings")
def q_integrate_array(s, d):
    """Arrays as functions of a position, summed over it."""
    df = read(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("v"))).alias("i_v"))
    m = Function(Scalar("vec_id", "long"), Function(Scalar("i", "int"), Scalar("v", "double")))
    return Dataset.of("vectors", m, df).integrate("i").samples().withColumn("v", F.round("v", 4))
