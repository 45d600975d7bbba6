import json
import zipfile

import pytest

from funcframe import encoders, service
from funcframe.dataset import Dataset
from funcframe.model import Function, ModelError, Scalar, Tuple, parse, struct_type
from funcframe.operators import Head, Rename, Selection, Take
from funcframe.sources import fdml, files, text

DATA = "#comment\n0,1,1.1,a\n1,2,2.2,b\n2,4,3.3,c\nbad,1,1,1\n\n3, 5,1.0,d\n"
XML = """<?xml version="1.0"?><dataset id="data" title="T"><source uri="data.txt"/>
<adapter class="x.TextAdapter" skipLines="1"/>
<function><scalar id="time" type="int" class="x.Time" units="days since 2000-01-01"/><tuple><scalar id="b" type="int"/><scalar id="c" type="double"/><scalar id="d" type="string"/></tuple></function>
{}</dataset>"""


def rows(df, sort=None):
    return [tuple(r) for r in (df.orderBy(*sort) if sort else df).collect()]


def adapter(spark, tmp_path, body, make, **args):
    (tmp_path / "in.txt").write_text(body)
    m = parse(args.pop("model"))
    return rows(make(m, **args).read(spark, str(tmp_path / "in.txt")))


def test_text_adapters(spark, tmp_path):
    a = lambda body, make, **k: adapter(spark, tmp_path, body, make, **k)
    assert a(DATA, text.TextAdapter, model="t -> (b: int, c: double, d: string)", comment="#") == [(0, 1, 1.1, "a"), (1, 2, 2.2, "b"), (2, 4, 3.3, "c")]
    assert a("h\nmark\n1,2\n", text.TextAdapter, model="t -> b", data_marker="^mark") == [(1, 2)]
    assert a("1\n2\n3\n4\n5\n", text.TextAdapter, model="t -> b", lines_per_record=2) == [(1, 2), (3, 4)]
    assert a("1  2 3\n4 5\n", text.ColumnarAdapter, model="t: string -> b", columns="0,1;2") == [("1 2", 3)]
    assert a("x=1 y=2\nno\n", text.RegexAdapter, model="t -> b", pattern=r"x=(\d+) y=(\d+)") == [(1, 2)]
    assert a("1970 1.1 A 1\n1970\n", text.SubstringAdapter, model="t -> (b: double, c: string)", substring="0,4;5,8;9,10") == [(1970, 1.1, "A")]
    assert a("19700101 11.1A\n", text.FormattedAdapter, model="(y, m, d) -> (i, f: double, s: string)", format="(I4,2I2,I2,F3.1,A)") == [(1970, 1, 1, 1, 1.1, "A")]
    assert a("5.8e-03,5.4e03\n5.8,-5.4\n", text.MatrixAdapter, model="(row, column) -> v: double") == [(0, 0, 0.0058), (0, 1, 5400.0), (1, 0, 5.8), (1, 1, -5.4)]


def test_lists_and_binary(spark, tmp_path):
    for n in ("2010-a", "2012-c", "other"):
        (tmp_path / n).write_bytes(b"x")
    m = parse("time: string -> (uri: string, size: long)")
    assert rows(files.file_list(spark, m, str(tmp_path), r"(\d{4})-.", base_dir=str(tmp_path))) == [("2010", "2010-a", 1), ("2012", "2012-c", 1)]
    g = rows(files.granule_list(spark, parse("time: string -> uri: string"), "2022-01-01", "P1D", "h/%1$tY/%1$tm/%1$td/f.x", "2022-01-04"))
    assert len(g) == 4 and g[1] == ("2022-01-02T00:00:00.000Z", "h/2022/01/02/f.x")
    m = Function(Scalar("x", "int"), Tuple((Scalar("a", "double"), Scalar("s", "string", {"size": 4}))))
    d = Dataset.of("d", m, spark.createDataFrame([(1, 0.5, "ab"), (2, 1.5, "cdef")], struct_type(m)))
    (tmp_path / "b.bin").write_bytes(b"".join(encoders.binary(d)))
    assert rows(files.binary_records(spark, m, str(tmp_path / "b.bin"))) == [(1, 0.5, "ab"), (2, 1.5, "cdef")]


def test_statements():
    m = parse("(x, y) -> (a, b, c)")
    assert files.select_statement(m, "t", []) == "SELECT x, y, a, b, c FROM t ORDER BY x ASC, y ASC"
    assert files.select_statement(m, "t", [Selection("a", ">", "1"), Rename("b", "q"), Take(3), Head()]) == "SELECT x, y, a, b AS q, c FROM t WHERE a > 1 ORDER BY x ASC, y ASC FETCH FIRST 1 ROWS ONLY"


def test_descriptions_and_service(spark, tmp_path):
    (tmp_path / "data.txt").write_text(DATA)
    (tmp_path / "data.fdml").write_text(XML.format(""))
    (tmp_path / "ops.fdml").write_text(XML.replace('id="data"', 'id="ops"').format('<?x-operation expression="time &gt; 2000-01-01"?><?x-operation expression="rename(d,Istanbul)"?>'))
    (tmp_path / "bad.fdml").write_text("<dataset")
    catalog = fdml.Catalog.of_folder(str(tmp_path), spark)
    assert sorted(catalog.datasets) == ["data", "ops"]
    assert rows(catalog.find("ops").samples()) == [(1, 2, 2.2, "b"), (2, 4, 3.3, "c")] and "Istanbul" in str(catalog.find("ops").model)
    status, media, body = service.respond(catalog, "/data.csv", "time,b&b%3E=2")
    assert (status, media, "".join(body)) == (200, "text/csv", "time,b\r\n1,2\r\n2,4\r\n")
    assert service.respond(catalog, "/data.csv", "nope()")[0] == 400 and service.respond(catalog, "/none.csv")[0] == 404
    assert json.loads(service.respond(catalog, "/", accept="application/json")[2][0])["dataset"][0]["identifier"] == "data"
    assert "Dataset {" in service.respond(catalog, "/data.dds")[2][0] and "units" in service.respond(catalog, "/data.das")[2][0]


@pytest.mark.parametrize("bad", ["<x/>", "<dataset/>", '<dataset id="a"><source uri="u"/></dataset>', XML.format("").replace("x.TextAdapter", "x.NoAdapter"), XML.format("").replace('type="int" class="x.Time"', 'class="x.Time"'), XML.format("").replace("<source", "<other")])
def test_bad_descriptions(spark, bad):
    with pytest.raises(ModelError):
        fdml.parse(bad, spark)


def test_encoders(spark, tmp_path):
    m = Function(Scalar("x", "int"), Tuple((Scalar("a", "int"), Scalar("b", "double", {"precision": 1}), Scalar("c", "string"))))
    d = Dataset.of("d", m, spark.createDataFrame([(0, 0, 0.0, "a,b"), (1, 1, float("nan"), 'q"')], struct_type(m)), title="T")
    assert "".join(encoders.csv(d)) == 'x,a,b,c\r\n0,0,0.0,"a,b"\r\n1,1,NaN,"q"""\r\n'
    assert list(encoders.json_lines(d)) == ['[0,0,0.0,"a,b"]\n', '[1,1,null,"q\\""]\n']
    assert list(encoders.text(d))[:2] == ["d: x -> (a, b, c)\n", "0 -> (0, 0.0, a,b)\n"]
    meta = json.loads(encoders.metadata(d.take(1)))
    assert meta["model"] == "x -> (a, b, c)" and meta["title"] == "T" and len(meta["variable"]) == 4
    assert [e.split("\n")[0] for e in encoders.events(d)] == ["event: metadata", "event: data"]
    nested = Dataset.of("n", "(x, y) -> a", spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "x int, y int, a int")).curry()
    assert list(encoders.text(nested))[1:] == ["0 -> {\n  0 -> 1\n  1 -> 2\n}\n"] and list(encoders.csv(nested))[0] == "x,y,a\r\n"
    z = Function(Scalar("name", "string"), Scalar("bytes", "binary"))
    held = b"".join(encoders.archive(Dataset.of("z", z, spark.createDataFrame([("first", b"1st"), ("second", b"2nd")], struct_type(z)))))
    (tmp_path / "a.zip").write_bytes(held)
    assert zipfile.ZipFile(tmp_path / "a.zip").read("second") == b"2nd"
    encoders.write_csv(d, str(tmp_path / "csv"))
    with pytest.raises(ModelError):
        encoders.dds(Dataset.of("l", "x: long -> a", spark.createDataFrame([], "x long, a int")))


def test_zip_of_files(spark, tmp_path):
    for sub, body in (("p", b"1"), ("q", b"2")):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "f.tar.gz").write_bytes(body)
    m = parse("i -> uri: string")
    d = Dataset.of("l", m, spark.createDataFrame([(0, str(tmp_path / "p/f.tar.gz")), (1, str(tmp_path / "q/f.tar.gz"))], struct_type(m)))
    from funcframe.operators import FileListToZipList

    assert [tuple(r) for r in d.with_operation(FileListToZipList()).samples().collect()] == [("f.tar.gz", b"1"), ("f_001.tar.gz", b"2")]
