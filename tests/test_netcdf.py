"""Array files: round trips over types and shapes, records, and slabs that selections and strides narrow."""

import struct

import numpy as np
import pytest

from funcframe import encoders
from funcframe.dataset import Dataset
from funcframe.model import Function, ModelError, Scalar, Tuple, parse, struct_type
from funcframe.sources import fdml, netcdf
from funcframe.sources.generate import generate


def test_round_trip_of_all_types(spark, tmp_path):
    kinds = [("b", "boolean", True), ("c", "byte", -3), ("s", "short", 300), ("i", "int", 70_000), ("l", "long", 1 << 40), ("f", "float", 0.5), ("d", "double", 0.1), ("t", "string", "é")]
    m = Function(Tuple((Scalar("x", "int"), Scalar("y", "double"))), Tuple(tuple(Scalar(n, k, {"size": 3} if k == "string" else {"units": "m"}) for n, k, _ in kinds)))
    rows = [(x, y, *[v for *_, v in kinds]) for x in (3, 1) for y in (0.5, 0.25, 2.0)]
    path = str(tmp_path / "a.nc")
    netcdf.write(Dataset.of("d", m, spark.createDataFrame(rows, struct_type(m))), path)
    h = netcdf.header(path)
    assert h.dims[:2] == (("x", 2), ("y", 3)) and h.variables["d"].meta == {"units": "m"}
    d = netcdf.Netcdf.of_file("d", m, path, spark)
    got = list(map(tuple, d.samples(sort=False).collect()))
    assert got == sorted(rows)
    assert [r[1] for r in d.query("x>=3&y<1").samples().collect()] == [0.25, 0.5] and d.query("x>=3&y<1").slab.ranges == (range(1, 2), range(0, 3))[:1] + (d.query("x>=3&y<1").slab.ranges[1],)
    assert [tuple(r)[:2] for r in d.stride(1, 2).samples().collect()] == [(1, 0.25), (1, 2.0), (3, 0.25), (3, 2.0)]
    assert b"".join(encoders.netcdf(d)) == open(path, "rb").read()


def test_not_cartesian(spark, tmp_path):
    d = Dataset.of("d", "(x, y) -> a", spark.createDataFrame([(0, 0, 1), (1, 1, 2)], "x int, y int, a int"))
    with pytest.raises(ModelError):
        netcdf.write(d, str(tmp_path / "a.nc"))


def test_records_of_a_small_file(spark, tmp_path):
    """A CDF-1 file with an unlimited dimension and two variables that take turns."""
    name = lambda s: struct.pack(">i", len(s)) + s + b"\0" * (-len(s) % 4)
    n = lambda v: struct.pack(">i", v)
    var = lambda s, kind, size, begin: name(s) + n(1) + n(0) + n(0) + n(0) + n(kind) + n(size) + n(begin)
    head = lambda at: b"CDF\1" + n(3) + n(10) + n(1) + name(b"t") + n(0) + n(0) + n(0) + n(11) + n(2) + var(b"t", 4, 4, at) + var(b"v", 6, 8, at + 4)
    body = b"".join(struct.pack(">id", t, t / 2) for t in (1, 2, 5))
    path = tmp_path / "r.nc"
    path.write_bytes(head(len(head(0))) + body)
    d = netcdf.Netcdf.of_file("r", parse("t -> v: double"), str(path), spark)
    assert [tuple(r) for r in d.samples().collect()] == [(1, 0.5), (2, 1.0), (5, 2.5)]
    assert d.query("t>=2").slab.ranges == (range(1, 3),) and [r.t for r in d.query("t>=2").samples().collect()] == [2, 5]
    (tmp_path / "d.fdml").write_text('<dataset id="r"><source uri="r.nc"/><adapter class="x.NetcdfAdapter"/><function><scalar id="t" type="int"/><scalar id="v" type="double"/></function></dataset>')
    assert [r.t for r in fdml.open_dataset(str(tmp_path / "d.fdml"), spark).query("t>1").samples().collect()] == [2, 5]


def test_generated_and_gone_wrong(spark, tmp_path):
    g = generate(spark, "(x, y: string, z: double) -> (a: boolean, b: boolean)")
    assert g.samples().count() == 24 and np.unique([r.z for r in g.samples().collect()]).tolist() == [0.0, 1.0, 2.0, 3.0]
    for bad in ("x: long -> a", "(a, b, c, d) -> e", "x -> y -> z"):
        with pytest.raises(ModelError):
            generate(spark, bad)
    (tmp_path / "x.nc").write_bytes(b"none")
    with pytest.raises(ModelError):
        netcdf.header(str(tmp_path / "x.nc"))


def test_heartbeat_and_errors(spark):
    import time

    d = Dataset.of("d", "x -> a", spark.createDataFrame([(0, 1)], "x int, a int"))
    slow = Dataset("d", d.source_model, lambda: time.sleep(0.5) or d.source())
    got = list(encoders.events(slow, heartbeat=0.1))
    assert ":\n\n" in got and got[-1] == 'event: data\ndata: {"data":[[0,1]]}\n\n'

    def fails():
        raise OSError("/secret/path")

    assert list(encoders.events(Dataset("d", d.source_model, fails)))[-1] == 'event: error\ndata: {"message": "unspecified error"}\n\n'
