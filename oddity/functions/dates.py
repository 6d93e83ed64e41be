"""Dates in text: a format from the first value, applied to all values as one Spark expression.

As in pandas, a column of date text has one format, the one its first value shows: month before
day unless the value rules that out, names of months, fractions, offsets and compact digits
included. The format (in strptime letters) becomes a regular expression with a group for each
field, and one replacement puts the fields in the order that the cast to a timestamp reads, so all
rows are parsed by built-in functions. Only where the first value shows no single format is each
value read on its own, in Arrow batches.

Values outside the range of nanosecond timestamps do not parse. Text without an offset is a time
in the session's zone.
"""

from __future__ import annotations

import re
import warnings
from functools import lru_cache

import numpy as np
import pandas as pd
from pandas.tseries.api import guess_datetime_format
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that stands for a missing value (fixed values).
MISSING = ("", "NaT", "nat", "NAT", "nan", "NaN", "NAN")
MONTHS = ("january february march april may june july august september october november december").split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
#: What each strptime letter reads (fixed values).
FIELDS = {
    "Y": r"\d{4}", "m": r"1[0-2]|0[1-9]|[1-9]", "d": r"3[01]|[12]\d|0[1-9]|[1-9]| [1-9]", "H": r"2[0-3]|[01]\d|\d",
    "I": r"1[0-2]|0[1-9]|[1-9]", "M": r"[0-5]\d|\d", "S": r"6[01]|[0-5]\d|\d", "f": r"\d{1,9}", "p": "am|pm",
    "B": "|".join(MONTHS), "b": "|".join(m[:3] for m in MONTHS), "A": "|".join(DAYS), "a": "|".join(d[:3] for d in DAYS),
    "z": r"[+-]\d\d(?::?[0-5]?\d(?::?[0-5]\d)?)?|(?-i:Z)", "Z": "UTC|GMT",
}
#: Range of nanosecond timestamps, in whole microseconds.
EARLIEST, LATEST = "1677-09-21 00:12:43.145225", "2262-04-11 23:47:16.854775"
#: The same with years well within that range, whatever the offset, and with offsets that the cast to a timestamp reads.
COMMON = FIELDS | {"Y": r"1[7-9]\d\d|2[01]\d\d|22[0-5]\d", "z": r"[+-](?:0\d|1[0-7]):?[0-5]\d|(?-i:Z)"}
#: Every ASCII digit as 0, and how many texts of a batch make a shape common.
ZEROS, SHAPE_TEXTS = str.maketrans("123456789", "0" * 9), 8


def infer_format(value: str | None) -> str | None:
    """The strptime format that a value shows, month before day where both fit; None if it shows none."""
    if value is None or value in MISSING:
        return None
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        fmt = guess_datetime_format(value)
    return fmt if fmt and set(re.findall(r"%(.)", fmt)) <= set(FIELDS) else None


def is_date_text(value: Column) -> Column:
    """Whether text can be the first value that shows the format."""
    return value.isNotNull() & ~value.isin(*MISSING)


def pattern_of(fmt: str, fields: dict = FIELDS) -> tuple[str, dict[str, str]]:
    """Regular expression of a strptime format, and by letter the reference to its group ($1, $2, ...)."""
    out, at, n = [], {}, 0
    for letter, blank, other in re.findall(r"%(.)|(\s+)|(.)", fmt, re.DOTALL):
        if letter == "d":  # the blank before a single digit stays outside the groups
            out.append(r"(?:(3[01]|[12]\d|0[1-9]|[1-9])| ([1-9]))")
            at[letter], n = f"${n + 1}${n + 2}", n + 2
        elif letter:
            out.append(f"({fields[letter]})")
            at[letter], n = f"${n + 1}", n + 1
        else:
            out.append(r"\s+" if blank else re.escape(other))
    return r"(?i)\A" + "".join(out) + r"\z", at


def _read(value: Column, pattern: str, at: dict[str, str], common: bool) -> Column:
    """Text that fits the pattern as a timestamp: one replacement makes the text that the cast reads.

    The month of a name, the hour of a half day and, unless it is a ``common`` one, the offset are
    worked out from further parts of that text.
    """
    field = lambda letter, default: at.get(letter, default)
    month = "@" if "B" in at or "b" in at else field("m", "1")
    hour = "#" if "I" in at else field("H", "0")
    # seconds of 60 and 61 fit the pattern and are no time
    text = f"{field('Y', '1900')}-{month}-{field('d', '1')} {hour}:{field('M', '0')}:{field('S', '0')}" + ("." + at["f"] if "f" in at else "")
    if "z" in at or "Z" in at:
        text += at["z"] if common and "z" in at else "Z"
    if not {"B", "b", "I"} & set(at) and (common or "z" not in at):
        return F.regexp_replace(value, pattern, text).try_cast("timestamp")

    def whole(part) -> Column:
        out = part[0]
        if month == "@":
            out = F.replace(out, F.lit("@"), F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.lower(F.substring(part[1], 1, 3))).cast("string"))
        if hour == "#":
            half = F.lower(part[3]) == "pm" if "p" in at else F.lit(False)
            out = F.replace(out, F.lit("#"), (part[2].try_cast("int") % 12 + F.when(half, 12).otherwise(0)).cast("string"))
        if common or "z" not in at:
            return out.try_cast("timestamp")
        zone = F.replace(part[4], F.lit(":"), F.lit(""))
        minutes = (F.substring(zone, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(zone, 4, 2).try_cast("int"), F.lit(0)))
        seconds = minutes * 60 + F.coalesce(F.substring(zone, 6, 2).try_cast("int"), F.lit(0))
        shift = F.when(zone == "Z", F.lit(0)).otherwise(F.when(zone.startswith("-"), -seconds).otherwise(seconds))
        return out.try_cast("timestamp") - F.make_dt_interval(secs=shift.cast("decimal(18,6)"))
    # the lambda holds the parts, so that the text is matched once
    parts = F.split(F.regexp_replace(value, pattern, "~".join([text, field("B", field("b", "")), *[field(x, "") for x in "Ipz"]])), "~")
    return F.get(F.transform(F.array(parts), lambda p: whole([F.get(p, F.lit(k)) for k in range(5)])), F.lit(0))


def parse_with(value: Column, fmt: str) -> Column:
    """Text of one format as a timestamp; null where it does not fit."""
    pattern, at = pattern_of(fmt)
    common = pattern_of(fmt, COMMON)[0]
    whole = F.when(value.rlike(common), _read(value, pattern, at, True))
    if common == pattern:
        return whole
    rest = _read(value, pattern, at, False)
    return whole.when(value.rlike(pattern) & rest.between(F.lit(EARLIEST).cast("timestamp"), F.lit(LATEST).cast("timestamp")), rest)


@lru_cache(4096)
def _format_of_shape(shape: str) -> str | None:
    """The format in which dates of a shape (text with 0 for each digit) read on their own, where one format fits them.

    With a year of four digits, a text that fits the month-first format is read by it, whatever its
    numbers. Texts of the shape that do not fit (a month above 12, an hour of 0 before pm) may still
    read otherwise. None for shapes with other fields.
    """
    small = iter(range(1, 10))
    digits = [len(run) for run in re.findall("0+", shape)]
    if digits.count(4) != 1 or not set(digits) <= {1, 2, 4} or len(digits) > 6:
        return None
    sample = re.sub("0+", lambda m: "2001" if len(m[0]) == 4 else str(next(small)).zfill(len(m[0])), shape)
    fmt = infer_format(re.sub(r"(?i)(?<![a-z])pm(?![a-z])", "AM", sample))  # guesses show no format for afternoons
    letters = sorted(re.findall(r"%(.)", fmt or ""))
    if not set(letters) <= set("YmbBdHIMSp") or len(set(letters)) < len(letters) or not {"Y", "d"} <= set(letters) \
            or len(set("mbB") & set(letters)) != 1 or ("I" in letters) != ("p" in letters):
        return None
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return fmt if pd.to_datetime(sample, format=fmt, errors="coerce") == pd.to_datetime(sample, errors="coerce") else None


def _read_each(values: pd.Series) -> pd.Series:
    codes, texts = pd.factorize(values.to_numpy(dtype=object))
    times = np.full(len(texts) + 1, np.datetime64("NaT"), "datetime64[us]")  # the last is for nulls
    shape_of, shapes = pd.factorize(np.array([t.translate(ZEROS) for t in texts], dtype=object))
    by_format: dict = {}
    for i in np.flatnonzero(np.bincount(shape_of, minlength=len(shapes)) >= SHAPE_TEXTS):
        fmt = _format_of_shape(shapes[i])
        if fmt:
            by_format.setdefault(fmt, []).append(i)
    left = np.ones(len(texts), dtype=bool)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for fmt, ids in by_format.items():
            at = np.flatnonzero(np.isin(shape_of, ids))
            read = pd.to_datetime(texts[at], format=fmt, errors="coerce")
            fits = (read.year >= 1700) & (read.year < 2200)
            if "%S" in fmt:  # strptime reads seconds of 60 and 61
                fits &= ~pd.Series(texts[at]).str.contains(r"(?<!\d)6[01](?!\d)", regex=True).to_numpy(dtype=bool)
            times[at[fits]] = read[fits].to_numpy().astype("datetime64[us]")
            left[at[fits]] = False
        rest = np.flatnonzero(left)
        each = pd.to_datetime(pd.Series(texts[rest], dtype=object), format="mixed", errors="coerce", utc=True)
    times[rest] = each.dt.tz_localize(None).dt.floor("us").to_numpy().astype("datetime64[us]")
    return pd.Series(times[codes])


def parse_each(value: Column) -> Column:
    """Every text read on its own, as a timestamp: the slow way, for columns whose first value shows no format.

    Of the texts of a batch, those of a common shape that has one reading are read together.
    """
    return F.pandas_udf(_read_each, "timestamp_ntz")(value).cast("timestamp")


def to_timestamp(value: Column, first: str | None) -> Column:
    """T3 value conversion for a column whose first value that is not missing is ``first``."""
    s = value.cast("string")
    if first is None:
        return F.lit(None).cast("timestamp")
    fmt = infer_format(first)
    return parse_with(s, fmt) if fmt else parse_each(s)
