"""Dates of requests and documents: formats, partial dates, and date math with rounding by the side of a bound.

Instants are milliseconds since 1970 in UTC.  Everything here runs on the driver
on literals, so that a filter reaches the scan as a constant; `column` reads
stored strings in Spark.
"""

from __future__ import annotations

import calendar
import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.errors import MapperParsing, Parsing

DEFAULT = "strict_date_optional_time||epoch_millis"
DAY, HOUR, MINUTE, SECOND, MILLI = 86_399_999, 3_599_999, 59_999, 999, 0
_NAMED = {
    "date": "yyyy-MM-dd", "year_month_day": "yyyy-MM-dd", "year_month": "yyyy-MM", "year": "yyyy", "basic_date": "yyyyMMdd",
    "date_time": "yyyy-MM-dd'T'HH:mm:ss.SSSZ", "date_time_no_millis": "yyyy-MM-dd'T'HH:mm:ssZ", "basic_date_time_no_millis": "yyyyMMdd'T'HHmmssZ",
    "date_hour_minute_second": "yyyy-MM-dd'T'HH:mm:ss", "date_hour_minute_second_millis": "yyyy-MM-dd'T'HH:mm:ss", "date_hour_minute": "yyyy-MM-dd'T'HH:mm",
    "date_hour": "yyyy-MM-dd'T'HH", "hour_minute_second": "HH:mm:ss", "hour_minute": "HH:mm",
}
_LETTERS = {
    "yyyy": r"(?P<y>\d{4})", "uuuu": r"(?P<y>\d{4})", "yy": r"(?P<yy>\d{2})", "MM": r"(?P<M>\d{2})", "dd": r"(?P<d>\d{2})", "HH": r"(?P<H>\d{2})", "hh": r"(?P<h>\d{2})",
    "mm": r"(?P<m>\d{2})", "ss": r"(?P<s>\d{2})", "SSS": r"(?P<S>\d{3})", "a": r"(?P<a>AM|PM|am|pm)", "Z": r"(?P<z>Z|[+-]\d{2}:?\d{2})", "X": r"(?P<z>Z|[+-]\d{2}(?::?\d{2})?)", "XXX": r"(?P<z>Z|[+-]\d{2}:?\d{2})",
}
_ISO = re.compile(r"(?P<y>\d{4})(?:-(?P<M>\d{2})(?:-(?P<d>\d{2}))?)?(?:T(?P<H>\d{2})(?::(?P<m>\d{2})(?::(?P<s>\d{2})(?:[.](?P<f>\d{1,9}))?)?)?(?P<z>Z|[+-]\d{2}:?\d{2})?)?", re.ASCII)


def to_millis(moment: datetime) -> int:
    return (moment.replace(tzinfo=None) - datetime(1970, 1, 1)) // timedelta(milliseconds=1)


def from_millis(ms: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=ms)


def _offset(z: str | None) -> int:
    """Milliseconds that a zone is ahead."""
    if not z or z == "Z":
        return 0
    digits = z[1:].replace(":", "").ljust(4, "0")
    return (int(digits[:2]) * 60 + int(digits[2:])) * 60_000 * (-1 if z[0] == "-" else 1)


def iso(text: str) -> tuple[int, int] | None:
    """Instant and what is left of the period that the text names; missing parts of the date are the first."""
    m = _ISO.fullmatch(text)
    if not m:
        return None
    part = m.groupdict()
    milli = int((part["f"] or "").ljust(3, "0")[:3])
    try:
        at = datetime(int(part["y"]), int(part["M"] or 1), int(part["d"] or 1), int(part["H"] or 0), int(part["m"] or 0), int(part["s"] or 0))
    except ValueError:
        return None
    left = MILLI if part["f"] else SECOND if part["s"] else MINUTE if part["m"] else HOUR if part["H"] else DAY
    return to_millis(at) + milli - _offset(part["z"]), left


class Pattern:
    """A pattern of Java letters, for reading, for writing, and as Spark's own pattern."""

    def __init__(self, source: str, name: str):
        self.source, tokens, i = source, [], 0
        while i < len(source):
            c = source[i]
            if c == "'":
                end = source.find("'", i + 1)
                if end < 0:
                    raise MapperParsing(f"invalid format [{name}]: unclosed quote")
                tokens.append(("text", source[i + 1 : end] or "'"))
                i = end + 1
            elif c.isascii() and c.isalpha():
                run = re.match(f"{c}+", source[i:]).group()
                if run not in _LETTERS:
                    raise MapperParsing(f"invalid format [{name}]: unknown letter [{run}]")
                tokens.append(("part", run))
                i += len(run)
            else:
                tokens.append(("text", c))
                i += 1
        self.tokens = tokens
        self.regex = re.compile("".join(_LETTERS[t] if k == "part" else re.escape(t) for k, t in tokens), re.ASCII)

    def read(self, text: str) -> tuple[int, int] | None:
        m = self.regex.fullmatch(text)
        if not m:
            return None
        part = m.groupdict()
        hour = int(part.get("H") or 0)
        if part.get("h"):
            hour = int(part["h"]) % 12 + (12 if (part.get("a") or "").lower() == "pm" else 0)
        year = int(part["y"]) if part.get("y") else 2000 + int(part["yy"]) if part.get("yy") else 1970
        try:
            at = datetime(year, int(part.get("M") or 1), int(part.get("d") or 1), hour, int(part.get("m") or 0), int(part.get("s") or 0))
        except ValueError:
            return None
        left = MILLI if part.get("S") else SECOND if part.get("s") else MINUTE if part.get("m") else HOUR if part.get("H") or part.get("h") else DAY
        return to_millis(at) + int(part.get("S") or 0) - _offset(part.get("z")), left

    def write(self, ms: int) -> str:
        d = from_millis(ms)
        values = {
            "yyyy": f"{d.year:04d}", "uuuu": f"{d.year:04d}", "yy": f"{d.year % 100:02d}", "MM": f"{d.month:02d}", "dd": f"{d.day:02d}", "HH": f"{d.hour:02d}", "hh": f"{(d.hour - 1) % 12 + 1:02d}",
            "mm": f"{d.minute:02d}", "ss": f"{d.second:02d}", "SSS": f"{d.microsecond // 1000:03d}", "a": "AM" if d.hour < 12 else "PM", "Z": "+0000", "X": "Z", "XXX": "Z",
        }
        return "".join(values[t] if k == "part" else t for k, t in self.tokens)


class DateFormat:
    """The alternatives of a `format`, tried in turn."""

    def __init__(self, source: str = DEFAULT):
        self.source, self.forms = source, []
        for name in source.split("||"):
            name = name.strip()
            if not name:
                raise MapperParsing(f"[format] has an empty alternative in [{source}]")
            plain = name.removeprefix("strict_")
            if plain in ("date_optional_time", "dateOptionalTime"):
                self.forms.append("iso")
            elif plain in ("epoch_millis", "epoch_second"):
                self.forms.append(plain)
            else:
                self.forms.append(Pattern(_NAMED.get(plain, name), name))

    def read(self, value) -> tuple[int, int]:
        """Instant and the rest of its period."""
        if isinstance(value, bool) or not isinstance(value, (int, float, str)):
            raise MapperParsing(f"failed to parse date [{value}]")
        for form in self.forms:
            if not isinstance(value, str):
                if form == "epoch_second":
                    return int(value * 1000), SECOND
                if form in ("iso", "epoch_millis"):
                    return int(value), MILLI
                continue
            text = value.strip()
            if form == "iso":
                found = iso(text)
            elif isinstance(form, Pattern):
                found = form.read(text)
            elif re.fullmatch(r"-?\d+", text, re.ASCII):
                found = (int(text), MILLI) if form == "epoch_millis" else (int(text) * 1000, SECOND)
            else:
                found = None
            if found:
                return found
        raise MapperParsing(f"failed to parse date field [{value}] with format [{self.source}]")

    def write(self, ms: int) -> str:
        form = self.forms[0]
        if isinstance(form, Pattern):
            return form.write(ms)
        if form == "iso":
            return from_millis(ms).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"
        return str(ms if form == "epoch_millis" else ms // 1000)

    def column(self, c: Column) -> Column:
        """A string column as timestamps, NULL where no alternative reads it."""
        tries = []
        for form in self.forms:
            if isinstance(form, Pattern):
                tries.append(F.try_to_timestamp(c, F.lit(form.source)))
            elif form == "iso":
                shaped = c.rlike(r"^\d{4}(-\d{2}(-\d{2}(T\d{2}(:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?)?)?)?$")
                padded = F.when(F.length(c) == 4, F.concat(c, F.lit("-01-01"))).when(F.length(c) == 7, F.concat(c, F.lit("-01"))).otherwise(c)
                tries.append(F.when(shaped, F.try_to_timestamp(padded)))
            else:
                number = F.when(c.rlike(r"^-?\d+$"), c.try_cast("bigint"))
                tries.append(F.timestamp_millis(number if form == "epoch_millis" else number * 1000))
        return F.coalesce(*tries)


_UNITS = "yMwdhHms"
_OPERATION = re.compile(r"([+-])(\d*)(.)|/(.)", re.S)


def _months(d: datetime, n: int) -> datetime:
    month = d.year * 12 + d.month - 1 + n
    year, month = divmod(month, 12)
    return d.replace(year=year, month=month + 1, day=min(d.day, calendar.monthrange(year, month + 1)[1]))


def _moved(ms: int, n: int, unit: str) -> int:
    d = from_millis(ms)
    if unit in "yM":
        return to_millis(_months(d, n * (12 if unit == "y" else 1)))
    return ms + n * {"w": 604_800_000, "d": 86_400_000, "h": 3_600_000, "H": 3_600_000, "m": 60_000, "s": 1000}[unit]


def _floor(ms: int, unit: str) -> int:
    d = from_millis(ms).replace(microsecond=0)
    if unit in "yMwdhHm":
        d = d.replace(second=0)
    if unit in "yMwdhH":
        d = d.replace(minute=0)
    if unit in "yMwd":
        d = d.replace(hour=0)
    if unit == "w":
        d -= timedelta(days=d.weekday())
    if unit in "yM":
        d = d.replace(day=1)
    if unit == "y":
        d = d.replace(month=1)
    return to_millis(d)


def _operate(ms: int, ops: str, up: bool) -> int:
    i = 0
    while i < len(ops):
        if ops[i] not in "+-/":
            raise Parsing(f"operator not supported for date math [{ops[i:]}]")
        m = _OPERATION.match(ops, i)
        if not m:
            raise Parsing(f"truncated date math [{ops[i:]}]")
        sign, n, unit, rounded = m.groups()
        if (unit or rounded) not in _UNITS:
            raise Parsing(f"unit [{unit or rounded}] not supported for date math [{ops[i:]}]")
        if rounded:
            ms = _floor(ms, rounded)
            if up:
                ms = _moved(ms, 1, rounded) - 1
        else:
            if n and int(n) >= 2**31:
                raise Parsing(f'For input string: "{n}"')
            try:
                ms = _moved(ms, int(n or 1) * (-1 if sign == "-" else 1), unit)
            except (OverflowError, ValueError):
                raise Parsing(f"date math out of range [{ops}]") from None
        i = m.end()
    return ms


def resolve(value, fmt: DateFormat, now: int, up: bool = False) -> int:
    """Instant of a bound: `now` and anchors with operations; `up` takes the last instant of a period."""
    if isinstance(value, str):
        if value.startswith("now"):
            return _operate(now, value[3:], up)
        anchor, found, ops = value.partition("||")
        if found and not _is_alternative(value, fmt):
            if not anchor:
                raise Parsing("cannot parse empty datetime")
            return _operate(fmt.read(anchor)[0], ops, up)
    ms, left = fmt.read(value)
    return ms + left if up else ms


def _is_alternative(value: str, fmt: DateFormat) -> bool:
    try:
        fmt.read(value)
    except MapperParsing:
        return False
    return True
