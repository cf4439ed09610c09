"""How values are shown, as column expressions: numbers, sizes, text and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The units of sizes that scale by 1000.
UNITS = ("bytes", "kB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")
#: What a size is divided by for a unit that is asked for by name.
DIVISORS = {"kB": 1000.0, "MB": 1000.0**2, "GB": 1000.0**3, "KiB": 1024.0, "MiB": 1024.0**2, "GiB": 1024.0**3}


def rounded(value: Column, places: int) -> Column:
    """Halves go away from zero."""
    by = F.lit(10.0**places)
    return F.signum(value) * F.floor(F.abs(value * by) + 0.5).cast("double") / by


def number(value: Column, least: int = 0, most: int = 2, thousands: bool = True) -> Column:
    """At most ``most`` decimals, of which zeros at the end go as long as ``least`` stay; null for null."""
    text = F.format_number(rounded(value.cast("double"), most), most)
    text = text if thousands else F.replace(text, F.lit(","), F.lit(""))
    if least < most:
        text = F.regexp_replace(text, rf"(\.\d{{{least}}}\d*?)0+$", "$1")
        text = F.regexp_replace(text, r"\.$", "")
    return text


def percent(value: Column, scaled: bool = False) -> Column:
    return F.concat(number(value * 100 if scaled else value), F.lit("%"))


def size(value: Column, unit: str | None = None, decimals: int | None = None) -> Column:
    """Bytes in the unit, or in the largest that leaves one or more."""
    value = value.cast("double")
    if unit:
        places = 2 if decimals is None else decimals
        return F.concat(number(value / DIVISORS[unit], places, places), F.lit(f" {unit}"))
    power = F.when(F.abs(value) < 1, 0).otherwise(F.least(F.floor(F.log10(F.abs(value)) / 3), F.lit(len(UNITS) - 1)))
    of = [F.concat(number(value / 1000.0**k, p := (2 if k else 0) if decimals is None else decimals, p), F.lit(f" {u}")) for k, u in enumerate(UNITS)]
    return F.element_at(F.array(*of), power.cast("int") + 1)


def truth(value: Column) -> Column:
    """False for what truncates to 0, True for 1, else the number."""
    return F.when(value.cast("int") == 0, "False").when(value.cast("int") == 1, "True").otherwise(number(value, 0, 6, False))


def named(value: Column, names: dict[int, str]) -> Column:
    """The name of the nearest whole number, or that number."""
    key = rounded(value, 0).cast("long")
    out = key.cast("string")
    for k, name in names.items():
        out = F.when(key == k, name).otherwise(out)
    return out


#: Fixed text: what stands in place of the middle of a text that is too long, around its length in bytes.
CUT = ("\n" + "^" * 59 + "\n\n...String is too long. Truncated `", "` bytes in the middle...\n\n" + "v" * 59 + "\n")


def truncated(text: Column | str, most: int) -> Column:
    """A text of more than ``most`` bytes without its middle; a character that a cut would part is left out."""
    text = F.col(text) if isinstance(text, str) else text
    data, length, half = F.to_binary(text, F.lit("utf-8")), F.octet_length(text), most // 2
    follows = lambda at: F.conv(F.hex(F.substr(data, at, F.lit(1))), 16, 10).cast("int").between(128, 191)  # noqa: E731 - a byte within a character
    steps = F.array(*map(F.lit, range(4)))
    back = F.element_at(F.filter(steps, lambda k: ~follows(F.lit(half + 1) - k)), 1)
    on = F.element_at(F.filter(steps, lambda k: ~F.coalesce(follows(length - half + 1 + k), F.lit(False))), 1)
    start = F.decode(F.substr(data, F.lit(1), F.lit(half) - back), "utf-8")
    end = F.decode(F.substr(data, length - half + 1 + on, length), "utf-8")
    return F.when(length > most, F.concat(start, F.lit(CUT[0]), length.cast("string"), F.lit(CUT[1]), end)).otherwise(text)


#: Fixed value: how the key of a saved query begins.
QUERY_PREFIX = "gqc_"


def handle(text: Column) -> Column:
    """(kind, timeline_id, graph_id, query_key) of a handle: the key of a saved query, a frame (timeline~number) or a timeline, whose latest frame is meant. Empty and malformed handles raise; null stays null."""
    saved, framed = text.startswith(QUERY_PREFIX), text.contains("~")
    good = saved | F.when(framed, text.rlike(r"(?s)^.+~[+-]?[0-9]+$")).otherwise(text != "")
    of = lambda test, value, kind="string": F.when(test, value).cast(kind)
    parts = F.struct(
        F.when(saved, "query").when(framed, "frame").otherwise("timeline").alias("kind"),
        of(~saved, F.regexp_replace(text, r"~[^~]*$", "")).alias("timeline_id"),
        of(~saved & framed, F.substring_index(text, "~", -1), "long").alias("graph_id"),
        of(saved, text).alias("query_key"),
    )
    return F.when(text.isNull(), F.lit(None)).when(good, parts).otherwise(F.raise_error(F.concat(F.lit("not a handle: "), text)))


def xml(text: Column) -> Column:
    for mark, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = F.replace(text, F.lit(mark), F.lit(f"&{name};"))
    return text


def day_start(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def week_start(ts: Column) -> Column:
    """Monday."""
    return F.date_trunc("week", ts)


def iso_week(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def day_end(ts: Column) -> Column:
    """The last microsecond of the day."""
    return day_start(ts) + F.make_dt_interval(days=F.lit(1)) - F.make_dt_interval(secs=F.lit(0.000001))


def shifted(ts: Column, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    """Later by so much; earlier by negative numbers."""
    return ts + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes))


def difference(a: Column, b: Column, unit: str = "SECOND") -> Column:
    """a - b in whole units, towards zero."""
    return F.timestamp_diff(unit, b, a)


def weekday(ts: Column) -> Column:
    """0 is Monday."""
    return F.weekday(ts)


def comparable(ts: Column) -> Column:
    """RFC 3339 with three decimals and Z: these strings sort as their times do."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_rfc3339(text: Column) -> Column:
    """The time (UTC, as the session's) of a text with an offset."""
    return F.to_timestamp(text)


def plain_datetime(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def unix_seconds(ts: Column) -> Column:
    """Whole seconds since 1970, rounded down."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.date_trunc("second", ts).cast("timestamp_ntz"))
