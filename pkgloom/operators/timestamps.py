"""Mixed timestamp formats and time zones: one UTC instant, in microseconds, for each text that names a date.

All formats are one regular expression with named groups. It is applied once per value, as a replacement that
lays the components out in fixed places; calendar ranges are checked and instants assembled with integer
arithmetic on columns, so everything stays in generated JVM code. Only a local time needs the zone rules.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Offsets of zone abbreviations in minutes.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
NUMBERS = (631_152_000, 4_102_444_800)  # 1990 to 2100
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"

_MON = "(?<{0}>jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\\.?"
_DAY = "(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?"
_ZONE = "(?<z{0}>z|[+-]\\d{{2}}(?::?\\d{{2}})?|(?:gmt|utc)[+-]\\d{{1,2}}(?::?\\d{{2}})?|" + "|".join(sorted((a.lower() for a in ABBREVIATIONS if a != "Z"), key=len, reverse=True)) + "|[a-z]+(?:/[a-z_+\\-0-9]+)+)"
_TIME = "(?<h{0}>\\d{{1,2}}):(?<i{0}>\\d{{2}})(?::(?<s{0}>\\d{{2}})(?:[.,](?<f{0}>\\d{{1,9}}))?)?(?:\\s*(?<p{0}>[ap])\\.?m\\.?)?"
_TAIL = "(?:\\s*" + _ZONE + ")?(?:\\s*\\[(?<b{0}>[a-z0-9_/+\\-]+)\\])?"
_FORMS = (
    "(?<y1>\\d{4})-(?<m1>\\d{1,2})-(?<d1>\\d{1,2})(?:(?:t|\\s+)" + _TIME.format(1) + _TAIL.format(1) + ")?",
    "(?<x2>\\d{1,4})/(?<m2>\\d{1,2})/(?<d2>\\d{1,4})(?:(?:t|,?\\s+)" + _TIME.format(2) + _TAIL.format(2) + ")?",
    "(?<y3>\\d{4})(?<m3>\\d{2})(?<d3>\\d{2})(?:t(?<h3>\\d{2}):?(?<i3>\\d{2})(?::?(?<s3>\\d{2})(?:[.,](?<f3>\\d{1,9}))?)?" + _TAIL.format(3) + ")?",
    "(?:" + _DAY + ",?\\s+)?(?<d4>\\d{1,2})[\\s\\-]+" + _MON.format("n4") + "[\\s\\-,]+(?<y4>\\d{4})(?:(?:t|,?\\s+)" + _TIME.format(4) + _TAIL.format(4) + ")?",
    "(?:" + _DAY + ",?\\s+)?" + _MON.format("n5") + "\\s+(?<d5>\\d{1,2})(?:st|nd|rd|th)?,?\\s+(?<y5>\\d{4})(?:(?:t|,?\\s+)" + _TIME.format(5) + _TAIL.format(5) + ")?",
    "(?:" + _DAY + ",?\\s+)?" + _MON.format("n6") + "\\s+(?<d6>\\d{1,2})\\s+" + _TIME.format(6) + "(?:\\s+" + _ZONE.format(6) + ")?\\s+(?<y6>\\d{4})",
)
PATTERN = "(?i)^\\s*(?:" + "|".join(_FORMS) + ")\\s*$"
_PLACES = {  # component -> the forms that have it
    "y": "13456", "m": "123", "d": "123456", "n": "456", "x": "2", "h": "123456", "i": "123456", "s": "123456", "f": "123456", "p0": "12456", "z": "123456", "b": "12345"}
_LAYOUT = "\u0001" + "\u0001".join("".join(f"${{{k[0]}{n}}}" for n in nums) for k, nums in _PLACES.items())
_AT = {k: i + 1 for i, k in enumerate(_PLACES)}


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date from year 1 on, by integer arithmetic."""
    shifted = y - F.when(m <= 2, 1).otherwise(0)  # years begin in March, so that the leap day ends one
    day_of_year = _div(153 * (m + F.when(m > 2, -3).otherwise(9)) + 2, 5) + d - 1
    return shifted * 365 + _div(shifted, 4) - _div(shifted, 100) + _div(shifted, 400) + day_of_year - 719468


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """withColumns behind a generator of one row: the optimizer can't copy the expressions into later ones."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _in_zone(local: Column, zone: Column) -> Column:
    """Micros of a local time in a zone; the engine's rules take the earlier of two and move ahead over a gap."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))


def utc_micros(df: DataFrame, value: str, zone: str, order: str, default_zone: str | None = "UTC", numbers: tuple[int, int] = NUMBERS, leap_seconds: bool = False) -> DataFrame:
    """``df`` with utc_us: the instant that ``value`` names, or null if it names no date.

    value: text, numbers as text. zone: the zone of a time without one; where it is null or unknown default_zone counts
    (None: such a time is null). A zone that the value itself names and that is unknown gives null.
    order: 'dmy', 'mdy' or 'ymd' for dates with slashes; where the digits contradict it, or it is null, the number with
    four digits is the year and the rest reads 'dmy'.
    numbers: the seconds between which an instant written as a number must lie; beyond them sizes would be ambiguous.
    leap_seconds: whether second 60 is read as the first of the next minute; else such a time is null.
    A local time that occurs twice is the earlier instant; a skipped one is moved ahead by the gap. A date alone
    is its midnight. Numbers are seconds, milli- or microseconds by their size; eight digits are year, month, day.
    Null, empty and blank values, texts of another form and impossible dates or times give null.
    """
    c = F.col
    text = F.trim(c(value))
    counts = text.rlike(r"^[+-]?\d+([.]\d*)?([eE][+-]?\d+)?$") & (F.length(text) != 8)
    df = _once(df, 
        {
            "__ts_number": F.when(counts, text.try_cast("decimal(38,9)")),
            "__ts_p": F.when(~counts, F.split(F.regexp_replace(text, F.lit(PATTERN), F.lit(_LAYOUT)), "\u0001")),
        }
    )
    ok = (F.size("__ts_p") == len(_PLACES) + 1) & (c("__ts_p")[0] == "")
    df = _once(df, {f"__ts_{k}": F.when(ok, F.nullif(F.lower(c("__ts_p")[i]), F.lit(""))) for k, i in _AT.items()})

    first, second, third = (c(f"__ts_{k}").try_cast("long") for k in "xmd")
    slashed = c("__ts_x").isNotNull()
    wish = F.coalesce(F.lower(F.trim(c(order))), F.lit(""))
    form = F.when(~slashed, "").when(F.length("__ts_x") == 4, "ymd").when(F.length("__ts_d") != 4, "none").when(wish == "mdy", "mdy").otherwise("dmy")
    month_name = _div(F.instr(F.lit(MONTHS), F.substring("__ts_n", 1, 3)) + 3, 4)
    hour = F.coalesce(c("__ts_h").try_cast("long"), F.lit(0))
    df = _once(df, 
        {
            "__ts_yy": F.when(form == "", c("__ts_y").try_cast("long")).when(form == "ymd", first).when(form != "none", third),
            "__ts_mm": F.when(form == "mdy", first).otherwise(F.coalesce(second, month_name)),
            "__ts_dd": F.when(form == "mdy", second).when(form == "dmy", first).otherwise(third),
            "__ts_hh": F.when(c("__ts_p0").isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(c("__ts_p0") == "p", 12).otherwise(0)).otherwise(-1),
            "__ts_ii": F.coalesce(c("__ts_i").try_cast("long"), F.lit(0)),
            "__ts_ss": F.coalesce(c("__ts_s").try_cast("long"), F.lit(0)),
            "__ts_us": F.rpad(F.substring(F.coalesce("__ts_f", F.lit("")), 1, 6), 6, "0").cast("long"),
            "__ts_off": F.nullif(F.regexp_extract("__ts_z", r"^(?:gmt|utc)?([+-]\d{1,2}:?(?:\d{2})?)$", 1), F.lit("")),
        }
    )
    y, m, d = c("__ts_yy"), c("__ts_mm"), c("__ts_dd")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    valid = y.between(1, 9999) & m.between(1, 12) & d.between(1, last) & c("__ts_hh").between(0, 23) & c("__ts_ii").between(0, 59) & c("__ts_ss").between(0, 60 if leap_seconds else 59)
    local = ((days_from_civil(y, m, d) * 24 + c("__ts_hh")) * 60 + c("__ts_ii")) * 60_000_000 + c("__ts_ss") * 1_000_000 + c("__ts_us")

    digits = F.regexp_replace(F.substring("__ts_off", 2, 6), ":", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("long"), F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).try_cast("long"), F.lit(0))
    by_offset = F.when((hours <= 18) & (minutes <= 59), F.when(c("__ts_off").startswith("-"), -1).otherwise(1) * (hours * 60 + minutes))
    by_name = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k.lower(), v)])
    known = F.create_map(*[F.lit(x) for z in sorted(available_timezones()) if "/" in z and not z.startswith(("posix", "right")) or z == "UTC" for x in (z.lower(), z)])
    region = c("__ts_z").contains("/")
    named = F.when(region, c("__ts_z")).otherwise(c("__ts_b"))
    df = _once(df, 
        {
            "__ts_local": F.when(valid, local),
            "__ts_shift": F.when(c("__ts_off").isNotNull(), by_offset).when(c("__ts_z").isNotNull() & ~region, by_name[c("__ts_z")]),
            "__ts_fixed": c("__ts_z").isNotNull() & ~region,
        }
    )
    # looked up only where no offset is given
    local_zone = F.when(named.isNotNull(), known[named]).otherwise(F.coalesce(known[F.lower(F.trim(c(zone)))], F.lit(default_zone).cast("string")))
    size = F.abs("__ts_number")
    low, high = numbers
    unit = F.when(size.between(low, high), 1_000_000).when(size.between(low * 1_000, high * 1_000), 1_000).when(size.between(low * 1_000_000, high * 1_000_000), 1)
    counted = F.when(c("__ts_number") > 0, F.floor(c("__ts_number") * unit).cast("long"))
    dated = F.when(F.coalesce("__ts_fixed", F.lit(False)), c("__ts_local") - c("__ts_shift") * 60_000_000).otherwise(_in_zone(c("__ts_local"), local_zone))
    return _once(df, {"utc_us": F.coalesce(counted, dated)}).drop(*[x for x in df.columns if x.startswith("__ts_")])
