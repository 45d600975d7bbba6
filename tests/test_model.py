import pytest

from funcframe import model as M
from funcframe import operators as ops
from funcframe.functions import times, units
from funcframe.plans import expressions as X


@pytest.mark.parametrize("text", ["x -> a", "(x, y) -> a", "x -> (a, b)", "x -> y -> a", "a"])
def test_model_text_round_trip(text):
    assert str(M.parse(text)) == text


@pytest.mark.parametrize("text", ["x ->", "(x -> a", "x: what -> a", "1x -> a", ""])
def test_bad_models(text):
    with pytest.raises(M.ModelError):
        M.parse(text)


@pytest.mark.parametrize("meta", [{"fillValue": "null"}, {"order": "up"}, {"binWidth": 0}, {"precision": 2}])
def test_bad_properties(meta):
    with pytest.raises(M.ModelError):
        M.Scalar("x", "int", meta)


@pytest.mark.parametrize(
    ("request_", "model", "want"),
    [
        ("x,y,a", "(x, y) -> (a, b)", "(x, y) -> a"),
        ("b", "x -> (a, b)", "_x -> b"),
        ("a,b", "(x, y) -> (a, b)", "_x_y -> (a, b)"),
        ("curry()", "(x, y) -> a", "x -> y -> a"),
        ("curryRight(1)", "(x, y, z) -> a", "(x, y) -> z -> a"),
        ("transpose()", "(x, y) -> a", "(y, x) -> a"),
        ("groupBy(y)", "(x, y) -> a", "y -> x -> a"),
        ("groupBy(x,y,z)", "t -> (x, y, z, a)", "(x, y, z) -> t -> a"),
        ("countBy(a)", "x -> a", "a -> count"),
        ("rename(a,b)", "x -> a", "x -> b"),
        ("eval(x,1)", "(x, y) -> a", "y -> a"),
        ("eval(x,1)", "x -> a", "a"),
        ("stats()", "x -> a", "a: (mean, min, max, count)"),
        ("pivot((Fe,Mg),(Fe,Mg))", "x -> e: string -> (a, b)", "x -> (Fe_a, Fe_b, Mg_a, Mg_b)"),
    ],
)
def test_models_of_operators(request_, model, want):
    m = M.parse(model)
    for op in ops.from_expression(request_):
        m = op.apply_model(m)
    assert str(m) == want


@pytest.mark.parametrize(
    ("request_", "model"),
    [
        ("c", "x -> a"), ("x", "(x, y) -> a"), ("nope()", "x -> a"), ("take()", "x -> a"), ("take(1,2)", "x -> a"), ("head(1)", "x -> a"), ("groupByBinWidth(0)", "x -> a"),
        ("groupByBinWidth(NaN)", "x -> a"), ("groupByBinWidth(3,what)", "x -> a"), ("groupByBinWidth()", "x -> a"), ("a~1", "x -> a"), ("a=~1", "x -> a"), ("y>1", "x -> y -> a"), ("a>b", "x -> a"),
        ("maxGap(0,floor)", "x -> a"), ("maxGap(1,none)", "x -> a"), ("maxGap(1,linear)", "x -> a"), ("maxGap(0.5,floor)", "x -> a"), ("curry(3)", "(x, y) -> a"), ("curryRight(2)", "(x, y) -> a"), ("stride(0)", "x -> a"),
        ("stats()", "x -> a: string"), ("sum()", "x -> y -> a"), ("convertTime(\"what since 2000\")", "x -> a"), ("toHex(a)", "x -> a"), ("pivot((a,b),(c))", "x -> y -> a"), ("eval(a,1)", "x -> a"),
    ],
)
def test_errors_come_before_any_job(request_, model):
    m = M.parse(model)
    with pytest.raises(M.ModelError):
        for op in ops.from_expression(request_):
            m = op.apply_model(m)


def test_thirty_five_names():
    assert len(ops.REGISTRY) == 35
    ops.register("twice", lambda: ops.Take(2))
    try:
        assert isinstance(ops.from_expression("twice()")[0], ops.Take)
    finally:
        del ops.REGISTRY["twice"]


@pytest.mark.parametrize("text", ["a,b&a>=3&take(10)", "time>=2020-01-01", 'convertTime("days since 2000-01-01")', "pivot((1,2),(a,b))", "&&a=1&&head()", "a!=~x&b=~y"])
def test_expressions_read_back(text):
    got = X.parse(text)
    assert X.parse(X.pretty(got)) == got and got


@pytest.mark.parametrize("text", ["a=1&b,c", "f(", "f(a,)", "a>", "1a,b"])
def test_bad_expressions(text):
    with pytest.raises(M.ModelError):
        X.parse(text)


def test_times():
    assert times.iso_millis("2000") == times.iso_millis("2000-01-01T00:00:00.000Z") == 946684800000
    assert times.iso_millis("2001001") == times.iso_millis("20010101") == times.iso_millis("2001-001")
    assert times.iso_millis("2000-13") is None and times.iso_millis("x") is None
    assert str(times.scale_of("weeks since 2020-01-08")) == "weeks since 2020-01-08T00:00:00.000Z"
    assert times.leap_at(times.iso_millis("1972-01-01")) == 10 and times.leap_at(times.iso_millis("2020-01-01")) == 37 and times.leap_at(0) == 0
    t = M.Scalar("t", "double", {"units": "days since 1970-01-01"}, True)
    assert times.literal(t, "1970-01-03") == 2 and times.literal(t, "2000") == 10957 and times.literal(t, "2.5") == 2.5


def test_units():
    factor, offset = units.converter(units.SCALES["KiloMeter"], units.SCALES["Meter"])
    assert (factor, offset) == (1000, 0)
    f, o = units.converter(units.SCALES["Celcius"], units.SCALES["Kelvin"])
    assert 100 * f - o == pytest.approx(373.15)
