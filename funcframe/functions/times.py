"""Times as Column expressions: numeric scales, text formats, leap seconds."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from funcframe.model import ModelError, Scalar, col

#: Seconds of each unit.
UNITS = {"nanoseconds": 1e-9, "microseconds": 1e-6, "milliseconds": 1e-3, "seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0, "weeks": 604800.0, "years": 31536000.0}
#: Dates from which atomic time was ahead of civil time by one second more, beginning with ten.
LEAPS = (
    "1972-01-01", "1972-07-01", "1973-01-01", "1974-01-01", "1975-01-01", "1976-01-01", "1977-01-01", "1978-01-01", "1979-01-01", "1980-01-01", "1981-07-01", "1982-07-01", "1983-07-01", "1985-07-01",
    "1988-01-01", "1990-01-01", "1991-01-01", "1992-07-01", "1993-07-01", "1994-07-01", "1996-01-01", "1997-07-01", "1999-01-01", "2006-01-01", "2009-01-01", "2012-07-01", "2015-07-01", "2017-01-01",
)
FIRST_LEAP = 10
JULIAN_ZERO_MS = -210866760000000.0  # -4712-01-01T12:00
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)

_DATE = r"(?P<y>\d{4})(?:-?(?P<doy>\d{3})|-(?P<m1>\d\d)(?:-(?P<d1>\d\d))?|(?P<m2>\d\d)(?P<d2>\d\d))?"
_TIME = r"(?P<H>\d\d)(?::?(?P<M>\d\d)(?::?(?P<S>\d\d)(?:\.(?P<f>\d{1,9}))?)?)?"
_ISO = re.compile(rf"{_DATE}(?:T{_TIME})?Z?\Z")


def iso_millis(text: str) -> int | None:
    """Milliseconds of an ISO time, or None: yyyy, yyyy-MM, ordinal and calendar dates, times down to fractions."""
    m = _ISO.match(text.strip())
    if not m:
        return None
    try:
        year = int(m["y"])
        if m["doy"]:
            day = datetime(year, 1, 1, tzinfo=UTC) + timedelta(days=int(m["doy"]) - 1)
            if int(m["doy"]) < 1 or day.year != year:
                return None
        else:
            day = datetime(year, int(m["m1"] or m["m2"] or 1), int(m["d1"] or m["d2"] or 1), tzinfo=UTC)
        t = day.replace(hour=int(m["H"] or 0), minute=int(m["M"] or 0), second=int(m["S"] or 0))
    except ValueError:
        return None
    return (t - EPOCH) // timedelta(milliseconds=1) + int((m["f"] or "0").ljust(3, "0")[:3])


def iso_text(millis: float) -> str:
    t = EPOCH + timedelta(milliseconds=millis)
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


@dataclass(frozen=True)
class TimeScale:
    """Counts of ``unit`` seconds from ``epoch_ms``; atomic scales count leap seconds."""

    unit: float
    epoch_ms: float
    name: str
    atomic: bool = False

    def __str__(self) -> str:
        return "JD" if self.name == "JD" else f"{'atomic ' if self.atomic else ''}{self.name} since {iso_text(self.epoch_ms)}"

    @property
    def zero(self) -> float:
        """Units from the scale's zero to 1970, negated; an epoch counts in whole seconds."""
        return -int(self.epoch_ms / 1000) / self.unit


JAVA = TimeScale(1e-3, 0.0, "milliseconds")


def scale_of(text: str) -> TimeScale:
    """From ``[atomic|civil] <units> since <ISO>``, ``JD``, or a text format, which counts as milliseconds."""
    text = text.strip()
    if text == "JD":
        return TimeScale(86400.0, JULIAN_ZERO_MS, "JD")
    m = re.match(r"(?:(atomic|civil)\s+)?(\w+)\s+since\s+(\S+)\Z", text, re.I)
    if not m:
        if not re.search("[a-zA-Z]", text) or "since" in text:
            raise ModelError(f"Invalid time units: {text}")
        return JAVA
    epoch = iso_millis(m[3])
    if m[2] not in UNITS or epoch is None:
        raise ModelError(f"Invalid time units: {text}")
    return TimeScale(UNITS[m[2]], epoch, m[2], (m[1] or "").lower() == "atomic")


def spark_format(pattern: str) -> str:
    """Spark has no proleptic year letter; all else is the same."""
    return pattern.replace("uuuu", "yyyy").replace("uu", "yy")


#: Formats that ISO values are recognised in, by length; tried before a variable's own format.
def _iso_column(c: Column) -> Column:
    """Milliseconds of an ISO text, or null."""
    body = F.regexp_replace(F.trim(c), "Z$", "")
    date, clock = F.substring_index(body, "T", 1), F.when(F.instr(body, "T") > 0, F.substring_index(body, "T", -1))
    days = (
        F.when(date.rlike(r"^\d{4}$"), F.try_to_date(date, "yyyy"))
        .when(date.rlike(r"^\d{4}-\d\d$"), F.try_to_date(date, "yyyy-MM"))
        .when(date.rlike(r"^\d{7}$"), F.try_to_date(date, "yyyyDDD"))
        .when(date.rlike(r"^\d{4}-\d{3}$"), F.try_to_date(date, "yyyy-DDD"))
        .when(date.rlike(r"^\d{8}$"), F.try_to_date(date, "yyyyMMdd"))
        .when(date.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_date(date, "yyyy-MM-dd"))
    )
    p = r"^(\d\d)(?::?(\d\d)(?::?(\d\d)(?:\.(\d{1,9}))?)?)?$"
    g = lambda i: F.coalesce(F.try_to_number(F.regexp_extract(clock, p, i), F.lit("99")), F.lit(0)).cast("long")
    millis = F.coalesce(F.rpad(F.regexp_extract(clock, p, 4), 3, "0").try_cast("long"), F.lit(0))
    in_day = F.when(clock.isNull(), F.lit(0)).when(clock.rlike(p) & (g(1) < 24) & (g(2) < 60) & (g(3) < 60), ((g(1) * 60 + g(2)) * 60 + g(3)) * 1000 + millis)
    return F.unix_date(days).cast("long") * 86400000 + in_day


def text_millis(c: Column, pattern: str) -> Column:
    """Milliseconds of a text time: ISO first, then its own format; null where neither reads it."""
    own = F.unix_millis(F.try_to_timestamp(c, F.lit(spark_format(pattern))).cast("timestamp"))
    return F.coalesce(_iso_column(c), own)


def is_text(s: Scalar) -> bool:
    return s.kind in ("string", "char")


def _leap(millis: Column) -> Column:
    """Seconds that atomic time is ahead at a civil time."""
    out = F.lit(0.0)
    for i, day in enumerate(LEAPS):
        out = F.when(millis >= float(iso_millis(day)), F.lit(float(FIRST_LEAP + i))).otherwise(out)
    return out


def leap_at(millis: float) -> float:
    return float(max((FIRST_LEAP + i for i, d in enumerate(LEAPS) if millis >= iso_millis(d)), default=0))


def convert(c: Column, source: TimeScale, target: TimeScale) -> Column:
    """A count on one scale as a count on another. Leap seconds matter where either is atomic."""
    factor = source.unit / target.unit
    if not (source.atomic or target.atomic):
        return c.cast("double") * F.lit(factor) - F.lit(source.zero * factor - target.zero)
    millis = c.cast("double") * F.lit(source.unit * 1000) + F.lit(float(source.epoch_ms))
    civil = millis
    if source.atomic:  # from the epoch's atomic seconds back to civil time
        atomic = millis + F.lit(leap_at(source.epoch_ms) * 1000)
        civil = atomic
        for _ in range(2):
            civil = atomic - _leap(civil) * 1000
    out = civil - F.lit(float(target.epoch_ms))
    if target.atomic:
        out = out + _leap(civil) * 1000 - F.lit(leap_at(target.epoch_ms) * 1000)
    return out / F.lit(target.unit * 1000)


def millis_of(s: Scalar) -> Column:
    """Milliseconds since 1970 of a time variable, exact or not."""
    return text_millis(col(s.id), s.units or "yyyy-MM-dd") if is_text(s) else convert(col(s.id), scale_of(s.units), JAVA)


def literal(s: Scalar, text: str) -> float:
    """A value in a request for a time variable, in its own scale (milliseconds for text times): ISO comes first."""
    ms = iso_millis(text)
    if ms is None:
        if is_text(s):
            raise ModelError(f"Invalid time value: {text}")
        try:
            return float(text)
        except ValueError:
            raise ModelError(f"Invalid time value: {text}") from None
    if is_text(s):
        return float(ms)
    scale = scale_of(s.units)
    return ms / 1000 / scale.unit + scale.zero
