"""Queries for sources, encoders and operators given in Python: whole tables written out in a form and read back by it.

Files go to the folder that all executors share; each query has its own. The SQL states the table's own rows.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funcframe import encoders
from funcframe import operators as ops
from funcframe.dataset import Dataset, granules
from funcframe.encoders import parallel
from funcframe.model import Function, Scalar, Tuple, col, parse
from funcframe.operators.grouping import Nearest
from funcframe.operators.reading import delimited
from funcframe.queries import EVENTS, ORDERS, E, O, events, lines, orders, parts, query, read, turns
from funcframe.scratch import scratch_dir
from funcframe.sources import fdml, files, text
from funcframe.sources.generate import cartesian, generate
from funcframe.sources.netcdf import Netcdf
from funcframe.sources.netcdf import write as write_netcdf

CUSTOMERS = "c_custkey: long -> (c_name: string, c_nationkey: int, c_acctbal: double)"
C = "c_custkey, c_name, c_nationkey, c_acctbal"


def place(s: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_dir(s).rstrip('/').removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


def customers(s: SparkSession, d: str) -> Dataset:
    return Dataset.of("customers", CUSTOMERS, read(s, d, "customer"))


def _written(s: SparkSession, lines_: DataFrame, name: str) -> str:
    path = place(s, name)
    parallel.write_lines(lines_, path)
    return path


def _one(s: SparkSession, name: str, text_: str) -> DataFrame:
    return s.createDataFrame([(text_,)], f"{name} string")


# Sources


@query(f"SELECT {O} FROM orders")
def q_source_csv(s, d):
    """Encoded as CSV with headers by all tasks, read as delimited text."""
    path = place(s, "csv")
    encoders.write_csv(orders(s, d), path)
    return text.TextAdapter(parse(ORDERS)).read(s, path)


@query(f"SELECT {C} FROM customer")
def q_source_text_records(s, d):
    """A head, a marker, comments, empty lines, two lines for each record, and blanks around them."""
    first, second = F.concat_ws(";", "c_custkey", "c_name"), F.concat_ws(";", "c_nationkey", F.col("c_acctbal").cast("string"))
    body = read(s, d, "customer").select(F.concat(F.lit("# a comment\n\n "), first, F.lit("\n"), second, F.lit(" ")).alias("value"))
    return text.TextAdapter(parse(CUSTOMERS), delimiter=";", lines_per_record=2, comment="#").read(s, _written(s, body, "records"))


@query("SELECT CAST(o_orderkey AS VARCHAR) || ' ' || o_orderstatus AS o_key, o_totalprice FROM orders")
def q_source_columnar(s, d):
    """Columns between blanks of several lengths, two of them joined."""
    body = read(s, d, "orders").select(F.concat(F.lit("  "), F.col("o_orderkey").cast("string"), F.lit("   "), F.col("o_totalprice").cast("string"), F.lit("\t"), "o_orderstatus").alias("value"))
    return text.ColumnarAdapter(parse("o_key: string -> o_totalprice: double"), columns="0,2;1").read(s, _written(s, body, "columns"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def q_source_regex(s, d):
    body = read(s, d, "events").select(F.format_string("[%d] user=%d did %s for %s", "event_id", "user_id", "event_type", F.col("value").cast("string")).alias("value"))
    return text.RegexAdapter(parse(EVENTS), pattern=r"\[(\d+)\] user=(\d+) did (\S+) for (\S+)").read(s, _written(s, body, "pattern"))


@query("SELECT p_partkey, p_name, p_size FROM part")
def q_source_substring(s, d):
    body = read(s, d, "part").select(F.concat(F.lpad(F.col("p_partkey").cast("string"), 12, " "), F.rpad("p_name", 60, " "), F.lpad(F.col("p_size").cast("string"), 6, " ")).alias("value"))
    return text.SubstringAdapter(parse("p_partkey: long -> (p_name: string, p_size: int)"), substring="0,12;12,72;72,78").read(s, _written(s, body, "places"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def q_source_formatted(s, d):
    """Fixed places by a format over two lines for each record."""
    body = read(s, d, "orders").select(F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, " "), F.lpad(F.col("o_custkey").cast("string"), 10, " "), F.lit("\n"), F.lpad(F.format_string("%.2f", "o_totalprice"), 14, " "), "o_orderstatus").alias("value"))
    m = parse("o_orderkey: long -> (o_custkey: long, o_totalprice: double, o_orderstatus: string)")
    return text.FormattedAdapter(m, format="(I12,I10/F14.2,A1)", lines_per_record=2).read(s, _written(s, body, "format"))


@query("SELECT CAST(i AS INT) AS i, j, CAST(CASE j WHEN 0 THEN n_nationkey ELSE n_regionkey END AS DOUBLE) AS v FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation), (VALUES (0), (1)) t(j)")
def q_source_matrix(s, d):
    """A matrix is one file with an order of lines; nations are a fixed number of rows."""
    body = read(s, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.concat_ws(",", "n_nationkey", "n_regionkey").alias("value"))
    return text.MatrixAdapter(parse("(i, j) -> v: double")).read(s, _written(s, body, "matrix"))


_RECORD = Function(Scalar("c_custkey", "long"), Tuple((Scalar("c_name", "string", {"size": 24}), Scalar("c_nationkey", "int"), Scalar("c_acctbal", "double"))))


@query(f"SELECT {C} FROM customer")
def q_source_binary(s, d):
    """Big-endian records of fixed width, packed and unpacked by tasks."""
    return parallel.records_of(parallel.binary_blocks(Dataset.of("customers", _RECORD, read(s, d, "customer"))), _RECORD)


def _by_nation(s: SparkSession, d: str) -> str:
    """The customers in folders by nation, as delimited text."""
    path = place(s, "nations")
    df = read(s, d, "customer").select("c_nationkey", F.concat_ws(",", "c_nationkey", "c_custkey", F.col("c_acctbal").cast("string")).alias("value"))
    df.repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    return path


_FILES = r"c_nationkey=([0-9]+)/part-.*\.txt"
_GRANULE = "(c_nationkey: int, c_custkey: long) -> c_acctbal: double"


@query("SELECT c_nationkey, CAST(sum(length(c_nationkey::VARCHAR) + length(c_custkey::VARCHAR) + length(c_acctbal::VARCHAR) + 3) AS BIGINT) AS size FROM customer GROUP BY 1")
def q_source_file_list(s, d):
    """A folder for each nation; a nation's lines are one file."""
    listed = files.file_list(s, parse("c_nationkey: int -> (uri: string, size: long)"), _by_nation(s, d), _FILES)
    return listed.groupBy("c_nationkey").agg(F.sum("size").alias("size"))


def _listed(s: SparkSession, d: str) -> Dataset:
    m = parse("c_nationkey: int -> uri: string")
    return Dataset.of("list", m, files.file_list(s, m, _by_nation(s, d), _FILES))


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer WHERE c_nationkey >= 12")
def q_granules_read_by_tasks(s, d):
    """The list is pruned by the selection; tasks read the files that are left."""
    m = parse(_GRANULE)
    return granules("customers", _listed(s, d), None, m, each=delimited(m)).query("c_nationkey>=12").samples(sort=False)


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer")
def q_granules_read_by_spark(s, d):
    m = parse(_GRANULE)
    return granules("customers", _listed(s, d), lambda uris: text.TextAdapter(m).read(s, *uris), m).samples(sort=False)


@query("SELECT c_nationkey, c_nationkey AS nation, c_custkey, c_acctbal FROM customer")
def q_with_reader(s, d):
    """Each file becomes a nested dataset, laid out flat again."""
    m = parse("(nation: int, c_custkey: long) -> c_acctbal: double")
    return _listed(s, d).with_reader(delimited(m), m).uncurry().samples(sort=False)


@query("SELECT strftime(t, '%Y-%m-%dT%H:%M:%S.000Z') AS time, 'data/' || strftime(t, '%Y/%j/%H') || '.bin' AS uri FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-03', INTERVAL 6 HOUR)) AS t)")
def q_source_granule_list(s, d):
    return files.granule_list(s, parse("time: string -> uri: string"), "2023-12-30", "PT6H", "data/%1$tY/%1$tj/%1$tH.bin", "2024-01-03")


_FDML = """<?xml version="1.0"?><dataset id="orders" title="All orders"><source uri="{uri}"/><adapter class="x.TextAdapter" delimiter=","/>
<function><scalar id="o_orderkey" type="long"/><tuple><scalar id="o_custkey" type="long"/><scalar id="o_orderstatus" type="string"/><scalar id="o_totalprice" type="double"/><scalar id="o_orderdate" type="string"/><scalar id="o_orderpriority" type="string"/></tuple></function>
<?latis-operation expression="o_totalprice&gt;1000"?></dataset>"""


def _folder(s: SparkSession, d: str) -> str:
    """A folder with a description of the orders, as CSV, and with one that cannot be read."""
    path = place(s, "described")
    encoders.write_csv(orders(s, d), f"{path}-csv")
    os.makedirs(f"{path}/sub")
    for name, body in (("orders.fdml", _FDML.format(uri=f"{path}-csv")), ("bad.fdml", "<dataset"), ("sub/again.fdml", _FDML.format(uri=f"{path}-csv").replace('id="orders"', 'id="again"'))):
        with open(f"{path}/{name}", "w") as f:
            f.write(body)
    return path


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice < 200000")
def q_source_description(s, d):
    """A description in XML, opened by its ending, with an operation of its own and one of the request."""
    return fdml.open_dataset(f"{_folder(s, d)}/orders.fdml", s).query("o_orderkey,o_totalprice&o_totalprice<200000").samples(sort=False)


@query("SELECT 'sub' AS catalog, 'again' AS id, count(*) AS n FROM orders WHERE o_totalprice > 1000 UNION ALL SELECT '', 'orders', count(*) FROM orders WHERE o_totalprice > 1000")
def q_source_catalog(s, d):
    c = fdml.Catalog.of_folder(_folder(s, d), s)
    found = {("", "orders"): c.find("orders"), ("sub", "again"): c.find("sub.again")}
    out = [ds.count().samples().select(F.lit(k).alias("catalog"), F.lit(i).alias("id"), F.col("count").alias("n")) for (k, i), ds in found.items()]
    return out[0].unionByName(out[1])


@query("SELECT * FROM (VALUES (0, 0), (1, 2), (2, 4)) t(x, a)")
def q_source_mock(s, d):
    return fdml.ADAPTERS["MockAdapter"](s, parse("x: int -> a: int"), {}, [])


@query("SELECT x, y, 2 * (3 * x + y) AS a, 2 * (3 * x + y) + 1 AS b, CAST(3 * x + y AS DOUBLE) AS c, chr(CAST(97 + 3 * x + y AS INT)) AS d FROM (SELECT CAST(i // 3 AS INT) AS x, CAST(i % 3 AS INT) AS y FROM range(6) r(i))")
def q_source_generated(s, d):
    return generate(s, "(x, y) -> (a: int, b: int, c: double, d: string)").samples()


@query("SELECT _1, _2, CAST(a AS DOUBLE) AS a FROM (VALUES (1, 'x', 1.5), (1, 'y', 2.5), (2, 'x', 3.5), (2, 'y', 4.5)) t(_1, _2, a)")
def q_source_cartesian(s, d):
    return cartesian(s, [[1, 2], ["x", "y"]], [[1.5, 2.5], [3.5, 4.5]]).samples()


_NC = Function(Scalar("p_partkey", "long"), Tuple((Scalar("p_size", "int"), Scalar("p_retailprice", "double", {"units": "USD"}), Scalar("p_brand", "string", {"size": 16}))))


def _part_file(s: SparkSession, d: str) -> str:
    path = place(s, "part") + ".nc"
    write_netcdf(Dataset.of("parts", _NC, read(s, d, "part")), path)
    return path


@query("SELECT p_partkey, p_size, p_retailprice, p_brand FROM part")
def q_netcdf(s, d):
    """Encoded as one array file and read in slabs."""
    return Netcdf.of_file("parts", _NC, _part_file(s, d), s).samples(sort=False)


@query("SELECT p_partkey, p_size, p_retailprice, p_brand FROM part WHERE p_partkey >= 50 AND p_partkey < 1500")
def q_netcdf_selection(s, d):
    """Selections of the domain narrow the slab."""
    return Netcdf.of_file("parts", _NC, _part_file(s, d), s).query("p_partkey>=50&p_partkey<1500").samples(sort=False)


@query("""WITH g AS (SELECT n_regionkey AS r, status AS st, coalesce(n, 0) AS n FROM (SELECT DISTINCT n_regionkey FROM nation) CROSS JOIN (SELECT DISTINCT CAST(ascii(o_orderstatus) AS INT) AS status FROM orders)
LEFT JOIN (SELECT n_regionkey, CAST(ascii(o_orderstatus) AS INT) AS status, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) USING (n_regionkey, status)) SELECT r, st, n FROM g""")
def q_netcdf_2d(s, d):
    """A grid of two dimensions, counted over all orders."""
    n = read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = n.groupBy(F.col("n_regionkey").alias("r"), F.ascii("o_orderstatus").alias("st")).agg(F.count(F.lit(1)).alias("n"))
    m = Function(Tuple((Scalar("r", "int"), Scalar("st", "int"))), Scalar("n", "long", {"fillValue": "0"}))
    ds = Dataset.of("grid", m, n.join(read(s, d, "nation").select(F.col("n_regionkey").alias("r")).distinct(), "r", "right")).make_cartesian()
    path = place(s, "grid") + ".nc"
    write_netcdf(ds, path)
    return Netcdf.of_file("grid", m, path, s).samples(sort=False)


# Encoders


@query("SELECT concat_ws(',', o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority) AS value FROM orders")
def q_encode_csv(s, d):
    return parallel.csv_lines(orders(s, d))


@query("""SELECT concat('[', conv_id, ',', turn, ',', to_json(role), ',', to_json(text), ']') AS value FROM conversations""")
def q_encode_json_lines(s, d):
    return parallel.json_rows(turns(s, d))


@query("SELECT concat('[', l_orderkey, ',[', string_agg(concat('[', l_linenumber, ',', n, ']'), ',' ORDER BY l_linenumber), ']]') AS value FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def q_encode_json_nested(s, d):
    return parallel.json_rows(lines(s, d).project("l_orderkey", "l_linenumber", "n").curry(1))


@query("SELECT concat(event_id, ' -> (', user_id, ', ', event_type, ', ', CAST(value AS VARCHAR), ')') AS value FROM events")
def q_encode_text(s, d):
    return parallel.text_rows(events(s, d))


@query("SELECT r_name || '.txt' AS name, 'region ' || r_regionkey AS body FROM region")
def q_encode_zip(s, d):
    """An archive of the regions, opened again."""
    import io
    import zipfile

    df = read(s, d, "region").select(F.concat("r_name", F.lit(".txt")).alias("entryName"), F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).cast("binary").alias("bytes"))
    body = b"".join(encoders.archive(Dataset.of("zip", "entryName: string -> bytes: binary", df)))
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        return s.createDataFrame([(n, z.read(n).decode()) for n in z.namelist()], "name string, body string")


@query("""SELECT 'metadata' AS event, CAST(NULL AS BIGINT) AS n_samples UNION ALL SELECT 'data', least(2, (SELECT count(*) FROM region) - 2 * i) FROM range(0, ((SELECT count(*) FROM region) + 1) // 2) t(i)""")
def q_encode_events(s, d):
    """Server-sent events of the regions, two samples each."""
    import json

    ds = Dataset.of("regions", "r_regionkey: int -> r_name: string", read(s, d, "region"))
    out = []
    for e in encoders.events(ds, chunk=2):
        if e.startswith("event"):
            kind, data = (line.split(": ", 1)[1] for line in e.strip().split("\n"))
            out.append((kind, len(json.loads(data)["data"]) if kind == "data" else None))
    return s.createDataFrame(out, "event string, n_samples long")


@query("""SELECT 'Dataset {' || chr(10) || '  Sequence {' || chr(10) || '    Int32 r_regionkey;' || chr(10) || '    String r_name;' || chr(10) || '  } samples;' || chr(10) || '} regions;' || chr(10) AS dds""")
def q_encode_dds(s, d):
    return _one(s, "dds", encoders.dds(Dataset.of("regions", "r_regionkey: int -> r_name: string", read(s, d, "region"))))


@query("""SELECT 'Attributes {' || chr(10) || '  x {' || chr(10) || '    String units "m";' || chr(10) || '  }' || chr(10) || '  a {' || chr(10) || '  }' || chr(10) || '}' || chr(10) AS das""")
def q_encode_das(s, d):
    m = Function(Scalar("x", "int", {"units": "m"}), Scalar("a", "int"))
    return _one(s, "das", encoders.das(Dataset("d", m, lambda: None)))


@query("SELECT 'orders' AS id, 6 AS n_variables, 'o_orderkey -> (o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)' AS model")
def q_encode_metadata(s, d):
    import json

    got = json.loads(encoders.metadata(orders(s, d)))
    return s.createDataFrame([(got["id"], len(got["variable"]), got["model"])], "id string, n_variables int, model string")


@query("SELECT 'orders' AS id UNION ALL SELECT 'again'")
def q_encode_catalog(s, d):
    import re

    page = encoders.html_catalog(fdml.Catalog.of_folder(_folder(s, d), s).listing())
    return s.createDataFrame([(i,) for i in re.findall(r'href="(\w+)\.meta"', page)], "id string")


# Operators given in Python, bound operators and names


@query("SELECT o_orderkey, o_totalprice / (o_custkey - 7) AS rate FROM orders WHERE o_custkey != 7")
def q_map_rows(s, d):
    """Samples for which the function fails are dropped."""
    m = parse("o_orderkey: long -> rate: double")
    return orders(s, d).project("o_orderkey", "o_custkey", "o_totalprice").map_rows(lambda r: {"o_orderkey": r["o_orderkey"], "rate": r["o_totalprice"] / (r["o_custkey"] - 7)}, m).samples(sort=False)


@query(f"SELECT {E} FROM events WHERE user_id != 5 AND value / (user_id - 5) > 1")
def q_filter_rows(s, d):
    def keep(r: dict) -> bool:
        if r["user_id"] == 5:
            raise ZeroDivisionError
        return r["value"] / (r["user_id"] - 5) > 1

    return events(s, d).filter_rows(keep).samples(sort=False)


@query("SELECT p_partkey, 1 - p_retailprice AS p_retailprice FROM part")
def q_map_range(s, d):
    return parts(s, d).with_operation(ops.MapRangeRows(lambda r: r | {"p_retailprice": 1 - r["p_retailprice"]})).samples(sort=False)


@query("SELECT conv_id, turn, word FROM (SELECT conv_id, turn, unnest(string_split(role, 's')) AS word FROM conversations)")
def q_flat_map(s, d):
    m = parse("(conv_id: long, turn: long) -> word: string")
    f = lambda r: [{"conv_id": r["conv_id"], "turn": r["turn"], "word": w} for w in r["role"].split("s")]
    return turns(s, d).with_operation(ops.FlatMapRows(f, m)).samples(sort=False)


@query("SELECT event_type, min_by(value, abs(event_id - 500) * 2 + CASE WHEN event_id > 500 THEN 1 ELSE 0 END) AS value FROM events GROUP BY 1")
def q_nearest(s, d):
    """Within each type, the sample nearest to 500, by the operator on a dataset."""
    return events(s, d).without("user_id").group_by("event_type", aggregation=Nearest(500)).samples()


@query("SELECT o_orderkey, o_totalprice FROM orders")
def q_bound_append(s, d):
    whole = orders(s, d).project("o_orderkey", "o_totalprice")
    left, right = whole.select("o_totalprice<100000"), whole.select("o_totalprice>=100000")
    return right.with_operation(ops.Bound(ops.AppendJoin(), left)).samples(sort=False)


class _Double(ops.Operator):
    def __init__(self, id: str) -> None:
        self.id = id

    def apply(self, df, m):
        return df.withColumn(self.id, col(self.id) * 2)


@query("SELECT p_partkey, p_retailprice * 2 AS p_retailprice FROM part WHERE p_retailprice >= 1000")
def q_registered(s, d):
    """An operator of one's own, named in a request."""
    ops.register("twice", _Double, 1, 1)
    return parts(s, d).query("p_retailprice>=1000&twice(p_retailprice)").samples()


@query("SELECT 'part_' || c_nationkey || '.txt' AS name, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_nationkey")
def q_zip_list(s, d):
    """The files of all nations as entries of an archive; here their lines are counted."""
    df = files.file_list(s, parse("c_nationkey: int -> uri: string"), _by_nation(s, d), _FILES)
    got = Dataset.of("list", "c_nationkey: int -> uri: string", df).with_operation(ops.FileListToZipList()).with_order()
    body = F.col("bytes").cast("string")
    return got.select(F.concat(F.lit("part_"), F.split(body, ",")[0], F.lit(".txt")).alias("name"), F.regexp_count(body, F.lit("\n")).cast("long").alias("n")).groupBy("name").agg(F.sum("n").alias("n"))


_PRICES = "(SELECT p_partkey, p_retailprice AS v, lead(p_retailprice) OVER (ORDER BY p_partkey) AS nv, lead(p_partkey) OVER (ORDER BY p_partkey) AS np FROM part)"


def _at(s: SparkSession, d: str, how: str, share: float) -> DataFrame:
    """The parts' prices at a share of the way from each key to the next one; at the last key itself."""
    df = read(s, d, "part").select(F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").alias("v"))
    last = df.agg(F.max("x").alias("last"))
    points = df.select("x").join(F.broadcast(last)).select(F.least(F.col("x") + share, "last").alias("x"))
    return Dataset.of("prices", "x: double -> v: double", df).interpolate(points, how).samples(sort=False).withColumn("v", F.round("v", 6))


@query("SELECT CAST(p_partkey AS DOUBLE) AS x, round(v, 6) AS v FROM " + _PRICES)
def q_interpolate_none(s, d):
    return _at(s, d, "none", 0)


@query("SELECT CAST(p_partkey AS DOUBLE) + CASE WHEN nv IS NULL THEN 0 ELSE 0.25 END AS x, round(v, 6) AS v FROM " + _PRICES)
def q_interpolate_floor(s, d):
    return _at(s, d, "floor", 0.25)


@query("SELECT CAST(p_partkey AS DOUBLE) + CASE WHEN nv IS NULL THEN 0 ELSE 0.5 END AS x, round(coalesce(nv, v), 6) AS v FROM " + _PRICES)
def q_interpolate_nearest(s, d):
    """Half way the later sample counts."""
    return _at(s, d, "nearest", 0.5)


@query("SELECT CAST(p_partkey AS DOUBLE) + CASE WHEN nv IS NULL THEN 0 ELSE 0.25 END AS x, round(coalesce(v + (nv - v) * 0.25, v), 6) AS v FROM " + _PRICES)
def q_interpolate_linear(s, d):
    return _at(s, d, "linear", 0.25)


@query("SELECT l_orderkey, l_linenumber, n, sum_qty FROM (SELECT l_orderkey, l_linenumber, count(*) AS n, sum(l_quantity) AS sum_qty FROM lineitem GROUP BY ALL)")
def q_curry_samples(s, d):
    """All nested samples, not only their number."""
    return lines(s, d).curry(1).uncurry().samples(sort=False)


@query("SELECT conv_id, turn, role, text FROM conversations")
def q_curry_right_samples(s, d):
    return turns(s, d).curry_right(1).uncurry().samples(sort=False)
