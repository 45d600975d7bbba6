import math

import pytest
from pyspark.sql import functions as F

from funcframe import operators as ops
from funcframe.dataset import Composite, Dataset, granules
from funcframe.model import Function, ModelError, Scalar, Tuple, parse, struct_type
from funcframe.plans import sequence


def ds(spark, model, rows):
    m = parse(model) if isinstance(model, str) else model
    return Dataset.of("d", m, spark.createDataFrame(rows, struct_type(m)))


def got(d, sort=True):
    return [tuple(r) for r in d.samples(sort).collect()]


def flat(d):
    return got(d.uncurry())


def test_series(spark):
    steps = ds(spark, "x -> y", [(i, i // 3) for i in range(6)])
    assert sorted(got(steps.on_change("y"))) == [(0, 0), (3, 1), (5, 1)]
    assert len(got(ds(spark, "x -> y: double", [(0, math.nan), (1, math.nan), (2, math.nan)]).on_change("y"))) == 3
    assert sorted(got(ds(spark, "x -> a", [(0, 0), (1, 5), (2, 1)]).max_delta("a", 2))) == [(0, 0), (2, 1)]
    assert sorted(got(ds(spark, "x -> a: double", [(0, 0.0), (1, math.nan), (2, 9.0)]).max_delta("a", 2))) == [(0, 0.0), (1, pytest.approx(math.nan, nan_ok=True)), (2, 9.0)]
    assert sorted(got(ds(spark, "x -> y", [(0, 0), (3, 3)]).max_gap(2, "floor"))) == [(0, 0), (2, 0), (3, 3)]
    assert sorted(got(ds(spark, "x -> y", [(0, 0), (5, 5)]).max_gap(2, "floor"))) == [(0, 0), (2, 0), (4, 0), (5, 5)]
    assert sorted(got(ds(spark, "x -> y", [(0, 0), (2, 2)]).max_gap(2, "floor"))) == [(0, 0), (2, 2)]
    assert sorted(got(ds(spark, "x -> y", [(0, 0), (3, 3)]).max_gap(2, "near"))) == [(0, 0), (2, 3), (3, 3)]
    assert sorted(got(ds(spark, "x -> y: double", [(0, 0.0), (4, 8.0)]).max_gap(1, "linear"))) == [(i, 2.0 * i) for i in range(5)]
    for op in (ops.OnChange("y"), ops.MaxDelta("y", 1), ops.MaxGap(1, "floor")):
        assert got(ds(spark, "x -> y", []).with_operation(op)) == []


def test_blocks_have_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(sequence, "BLOCK", 4)
    values = [(i * 7919) % 23 for i in range(50)]
    d = ds(spark, "x -> y", list(enumerate(values)))
    want = [(i, v) for i, v in enumerate(values) if i in (0, 49) or v != values[i - 1]]
    assert sorted(got(d.on_change("y"))) == want
    from funcframe.operators import series

    monkeypatch.setattr(series, "BLOCK", 4)
    kept, last = [], None
    for i, v in enumerate(values):
        if last is None or not abs(v - last) > 6:
            kept.append((i, v))
            last = v
    assert sorted(got(d.max_delta("y", 6))) == kept


def test_positions_with_descending_domain(spark):
    m = Function(Scalar("x", "int", {"order": "desc"}), Scalar("a", "int"))
    d = ds(spark, m, [(i, i * i) for i in range(10)])
    assert got(d.take(2)) == [(9, 81), (8, 64)] and got(d.drop(8)) == [(1, 1), (0, 0)] and got(d.take_right(1)) == [(0, 0)]
    assert [x for x, _ in got(d.stride(4))] == [9, 5, 1]
    assert [x for x, _ in got(d.select("x>7"))] == [6, 5, 4, 3, 2, 1, 0]
    assert got(d.take(-1)) == [] and len(got(d.drop_right(3).tail())) == 6


def test_selection_of_nan_and_bins(spark):
    d = ds(spark, "x -> a: double", [(0, math.nan), (1, 1.0), (2, 2.0)])
    count = lambda e: len(got(d.select(e)))
    assert [count(f"a{o}1") for o in (">", ">=", "<", "<=", "=", "!=")] == [1, 2, 0, 1, 1, 2]
    b = ds(spark, Function(Scalar("x", "double", {"binWidth": 1}), Scalar("a", "int")), [(1.0, 0)])
    hit = lambda e: bool(got(b.select(e)))
    assert [hit(f"x={v}") for v in ("1.0", "1.5", "2.0", "0.5")] == [True, True, False, False]
    assert [hit(f"x>{v}") for v in ("1.5", "2.0")] == [True, False] and [hit(f"x<={v}") for v in ("1.0", "0.5")] == [True, False]
    assert got(ds(spark, "x -> a: string", [(0, "a"), (1, "b"), (2, None)]).contains("a", "b", "c")) == [(1, "b")]


def test_groups(spark):
    d = ds(spark, "(x, y) -> a", [(0, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 4), (2, 11, 5), (2, 12, 6)])
    assert got(d.count_by("x")) == [(0, 1), (1, 2), (2, 3)] and [n for _, n in got(d.count_by("y"))] == [2, 2, 2]
    assert flat(d.group_by("y"))[:2] == [(10, 0, 1), (10, 2, 4)]
    assert got(d.group_by("x", "y"))[0] == (0, 10, 1)
    b = ds(spark, "x -> (a, b)", [(x, x + 1, (x + 1) ** 2) for x in range(10)])
    assert got(b.group_by_bin_width(3, "count")) == [(0.0, 3), (3.0, 3), (6.0, 3), (9.0, 1)]
    e = ds(spark, "x -> a", [(1, 5), (2, 6), (9, 7)])
    assert got(e.group_by_bin(ops.BinSet(0, 2, 3), ops.Count())) == [(0.0, 1), (2.0, 1), (4.0, 0)]
    s = got(ds(spark, "x -> a", [(0, 0), (1, 1), (2, 2)]).stats())
    assert s == [(1.0, 0.0, 2.0, 3)]
    n = got(ds(spark, "x -> a: double", [(0, 1.0), (1, math.nan)]).stats())[0]
    assert all(math.isnan(v) for v in n[:3]) and n[3] == 2
    t = got(ds(spark, "x -> (a: int, b: double, c: string)", [(0, 0, 0.0, "a"), (1, 1, 1.0, "b"), (2, 2, 2.0, "c")]).sum())[0]
    assert t[:2] == (3, 3.0) and math.isnan(t[2])
    assert got(ds(spark, "x -> a: long", [(0, 2**63 - 1), (1, 1)]).sum()) == [(-(2**63),)]
    assert got(ds(spark, "x -> (a, b)", [(0, 0, 0), (1, 1, 2), (2, 2, 4)]).integrate("x")) == [(3, 6)]
    with pytest.raises(Exception, match="empty"):
        got(ds(spark, "x -> a", []).sum())


def test_shapes(spark):
    m = Function(Tuple((Scalar("i", "int"), Scalar("e", "string"))), Tuple((Scalar("a", "double"), Scalar("b", "double"))))
    d = ds(spark, m, [(1, "Fe", 1.1, 0.1), (1, "Mg", 1.2, 0.2), (2, "Fe", 2.1, 0.3), (2, "Mg", 2.2, 0.4)])
    assert str(d.curry().model) == "i -> e -> (a, b)"
    assert got(d.curry().pivot(("Fe", "Mg"), ("Fe", "Mg")))[0] == (1, 1.1, 0.1, 1.2, 0.2)
    t = ds(spark, "(t, d) -> f", [(0, 0, 10), (0, 2, 20), (1, 0, 30), (1, 1, 40), (1, 2, 50)])
    assert got(t.curry().pivot(("0", "1", "2"), ("d0", "d1", "d2"))) == [(0, 10, None, 20), (1, 30, 40, 50)]
    g = ds(spark, "(x, y) -> a", [(x, y, 3 * x + y) for x in range(2) for y in range(3)])
    assert [a for *_, a in got(g.transpose())] == [0, 3, 1, 4, 2, 5] and flat(g.curry()) == got(g) and flat(g.curry_right(1)) == got(g)
    c = ds(spark, Function(Tuple((Scalar("x", "int"), Scalar("y", "int"))), Scalar("a", "int", {"fillValue": -999})), [(0, 1, 1), (1, 0, 2)])
    assert got(c.make_cartesian()) == [(0, 0, -999), (0, 1, 1), (1, 0, 2), (1, 1, -999)]
    assert got(ds(spark, "x -> a", [(1, 1), (3, 3)]).evaluation("x", "1")) == [(1,)]
    p = spark.createDataFrame([(3,), (1,)], "x int")
    assert got(ds(spark, "x -> a", [(1, 1), (3, 3), (5, 5)]).resample(p)) == [(1, 1), (3, 3)]
    with pytest.raises(Exception, match="No sample"):
        got(ds(spark, "x -> a", [(1, 1)]).resample(p))


def test_combining(spark):
    a, b = ds(spark, "time -> flux: double", [(1, 1.2), (2, 2.4)]), ds(spark, "time -> flux: double", [(3, 3.6), (4, 4.8)])
    both = Composite.of_members("both", [a, b])
    assert [t for t, _ in got(both)] == [1, 2, 3, 4] and got(both.take(3)) == [(1, 1.2), (2, 2.4), (3, 3.6)] and got(both.take_right(1)) == [(4, 4.8)]
    assert str(both.rename("flux", "f").model) == "time -> f" and got(both.drop(3)) == [(4, 4.8)]
    table = ds(spark, "k -> v: string", [(1, "one"), (2, "two"), (2, "three")]).lookup()
    assert got(ds(spark, "x -> k", [(0, 1)]).compose(table)) == [(0, "one")]
    with pytest.raises(Exception, match="No value"):
        got(ds(spark, "x -> k", [(0, 5)]).compose(table))
    assert got(ds(spark, "x -> (k, a)", [(0, 1, 7), (1, 5, 8)]).substitute(table)) == [(0, "one", 7)]
    n = ds(spark, "(x, k) -> a", [(0, 1, 7), (0, 5, 8), (1, 1, 9)]).curry().substitute(table)
    assert flat(n) == [(0, "one", 7), (1, "one", 9)]
    twice = ops.Computed(parse("k -> v: int"), lambda k: k * 2)
    assert got(ds(spark, "x -> k", [(0, 4)]).compose(twice)) == [(0, 8)]


def test_granules_are_pruned(spark):
    read_paths = []
    m = Function(Scalar("t", "double"), Tuple((Scalar("a", "string"), Scalar("b", "int"))))
    listed = ds(spark, Function(Scalar("t", "double", {"binWidth": 1}), Scalar("uri", "string")), [(0.0, "a"), (1.0, "b"), (2.0, "c")])

    def read(paths):
        read_paths.append(paths)
        return spark.createDataFrame([("abc".index(p) + h, p, 1) for p in paths for h in (0.0, 0.5)], struct_type(m))

    g = granules("g", listed, read, m)
    assert [r[0] for r in got(g)] == [0, 0.5, 1, 1.5, 2, 2.5]
    assert [r[0] for r in got(g.query("t<=1"))] == [0, 0.5, 1] and read_paths[-1] == ["a", "b"]
    assert [r[0] for r in got(g.query("t>1.1"))] == [1.5, 2, 2.5] and read_paths[-1] == ["b", "c"]


def test_times(spark):
    num = Function(Scalar("t", "int", {"units": "days since 2020-01-01"}, True), Scalar("a", "int"))
    txt = Function(Scalar("t", "string", {"units": "yyyy-MM-dd"}, True), Scalar("a", "int"))
    for m, v in ((num, 14), (txt, "2020-01-15")):
        d = ds(spark, m, [(v, 1)])
        assert got(d.convert_time("weeks since 2020-01-08"))[0][0] == pytest.approx(1.0)
        assert got(d.format_time("yyyy-DDD")) == [("2020-015", 1)]
        assert len(got(d.select("t>2020-01-14"))) == 1 and not got(d.select("t>2020-01-15"))
    assert d.convert_time("weeks since 2020-01-08").model.domain.units == "weeks since 2020-01-08T00:00:00.000Z"
    assert got(ds(spark, txt, [("nonsense", 1)]).convert_time("days since 2000-01-01")) == []
    civil = Function(Scalar("t", "double", {"units": "civil seconds since 1981-06-30"}, True), Scalar("a", "int"))
    d = ds(spark, civil, [(367 * 86400.0, 1)])
    assert got(d.convert_time("civil seconds since 1982-06-30"))[0][0] == 2 * 86400
    assert got(d.convert_time("atomic seconds since 1982-06-30"))[0][0] == 2 * 86400 + 1
    tup = Function(Tuple((Scalar("y", "int", {"units": "yyyy"}), Scalar("m", "int", {"units": "MM"}), Scalar("d", "int", {"units": "dd"})), "time"), Scalar("flux", "int"))
    out = ds(spark, tup, [(1945, 1, i, i * 10) for i in range(1, 6)]).time_tuple_to_time()
    assert str(out.model) == "time -> flux" and got(out)[0] == ("1945 1 1", 10)


def test_bytes_and_history(spark):
    m = Function(Scalar("x", "int"), Scalar("b", "binary", {"mediaType": "example"}))
    d = ds(spark, m, [(0, bytes.fromhex("cafebabe")), (1, None)])
    assert got(d.to_base64("b")) == [(0, "yv66vg=="), (1, None)] and got(d.to_hex("b"))[0] == (0, "cafebabe")
    assert got(d.to_binary("b"))[0][1] == f"{0xCAFEBABE:032b}"
    assert d.to_hex("b").model.range.meta["mediaType"] == "example;base16"
    assert d.history == "" and d.take(1).drop(0).history.count("; ") == 1
    with pytest.raises(ModelError):
        d.take(1).query("nope")
    assert got(d.take(1).cache()) == got(d.take(1))
    assert len(got(d.filter(F.col("x") > 0))) == 1
