"""Date and time functions over ISO-8601 text.

A time value is text such as ``2024-02-30 12:34:56.789+02:00``: the date alone, a time alone
(on 2000-01-01), or both, separated by a space or T. Anything else gives NULL. Days past the
month's end, and hour 24, are printed as written unless an offset moves the time; they count
on into the next month or day in everything that is computed. The expressions are built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIME = r"(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?"
_PATTERN = rf"^\s*(?:(\d{{4}})-(\d{{2}})-(\d{{2}}))?(?:[ T]*{_TIME})?\s*(Z|[+-]\d{{2}}:\d{{2}})?\s*$"
_DAY = 86_400_000_000


def micros(x: Column) -> Column:
    """Microseconds since 1970 of a time text, NULL if it is none."""
    part = lambda i: F.nullif(F.regexp_extract(x, _PATTERN, i), F.lit(""))
    num = lambda i, default: F.coalesce(part(i).try_cast("long"), F.lit(default).cast("long"))
    year, month, day = num(1, 2000), num(2, 1), num(3, 1)
    hour, minute, second = num(4, 0), num(5, 0), num(6, 0)
    fraction = F.rpad(F.coalesce(F.substring(part(7), 1, 6), F.lit("0")), 6, "0").try_cast("long")
    zone = part(8)
    offset = F.when(zone.isNull() | (zone == "Z"), 0).otherwise(F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1) * (F.substring(zone, 2, 2).try_cast("long") * 60 + F.substring(zone, 5, 2).try_cast("long")))
    fits = month.between(1, 12) & day.between(1, 31) & (hour <= 24) & (minute <= 59) & (second <= 59) & x.rlike(_PATTERN) & (part(1).isNotNull() | part(4).isNotNull())
    days = F.unix_date(F.make_date(year.cast("int"), F.when(fits, month).otherwise(1).cast("int"), F.lit(1))) + day - 1
    return F.when(fits, days * F.lit(_DAY) + ((hour * 60 + minute - offset) * 60 + second) * 1_000_000 + fraction)


def _stamp(x: Column) -> Column:
    return F.timestamp_micros(micros(x))


def _written(x: Column) -> Column:
    """Whether no offset moves the time, so that its fields print as written."""
    zone = F.regexp_extract(x, _PATTERN, 8)
    return zone.isin("", "Z", "+00:00", "-00:00")


def date(x: Column) -> Column:
    own = F.regexp_extract(x, r"^\s*(\d{4}-\d{2}-\d{2})", 1)
    return F.when(_written(x) & (own != ""), F.when(micros(x).isNotNull(), own)).otherwise(F.date_format(_stamp(x), "yyyy-MM-dd"))


def time(x: Column) -> Column:
    own = F.regexp_extract(x, r"(24:\d{2}(:\d{2})?)", 1)
    return F.when(_written(x) & (own != ""), F.when(micros(x).isNotNull(), F.rpad(own, 8, ":00"))).otherwise(F.date_format(_stamp(x), "HH:mm:ss"))


def datetime(x: Column) -> Column:
    return F.concat(date(x), F.lit(" "), time(x))


def julianday(x: Column) -> Column:
    return micros(x) / F.lit(86_400_000_000.0) + 2440587.5


def strftime(pattern: str, x: Column) -> Column:
    """The specifiers d e f F G g H I j J k l m M p P R s S T u U V w W Y and %%, taken apart
    when the plan is built; an unknown one gives NULL, as does a bad time."""
    t, us, ymd = _stamp(x), micros(x), date(x)
    fmt = lambda p: F.date_format(t, p)
    pad = lambda v, n, c="0": F.lpad(v.cast("long").cast("string"), n, c)
    day_of_year, weekday = F.dayofyear(t), F.dayofweek(t) - 1
    hour12 = (F.hour(t) + 11) % 12 + 1
    thursday = F.date_add(F.to_date(t), 3 - F.weekday(t))
    made = {
        "d": lambda: F.substring(ymd, 9, 2), "e": lambda: F.lpad(F.ltrim(F.substring(ymd, 9, 2), F.lit("0")), 2, " "), "F": lambda: ymd, "H": lambda: fmt("HH"),
        "f": lambda: F.concat(fmt("ss"), F.lit("."), pad(F.floor(F.pmod(us, F.lit(1_000_000)) / 1000), 3)),
        "G": lambda: pad(F.year(thursday), 4), "g": lambda: F.substring(pad(F.year(thursday), 4), 3, 2),
        "I": lambda: pad(hour12, 2), "j": lambda: pad(day_of_year, 3), "J": lambda: (us / F.lit(86_400_000_000.0) + 2440587.5).cast("string"),
        "k": lambda: pad(F.hour(t), 2, " "), "l": lambda: pad(hour12, 2, " "), "m": lambda: F.substring(ymd, 6, 2), "M": lambda: fmt("mm"),
        "p": lambda: F.when(F.hour(t) < 12, "AM").otherwise("PM"), "P": lambda: F.when(F.hour(t) < 12, "am").otherwise("pm"),
        "R": lambda: fmt("HH:mm"), "s": lambda: F.floor(us / 1_000_000).cast("string"), "S": lambda: fmt("ss"), "T": lambda: fmt("HH:mm:ss"),
        "u": lambda: (F.weekday(t) + 1).cast("string"), "w": lambda: weekday.cast("string"), "V": lambda: pad(F.weekofyear(t), 2),
        "U": lambda: pad(F.floor((day_of_year + 6 - weekday) / 7), 2), "W": lambda: pad(F.floor((day_of_year + 6 - F.weekday(t)) / 7), 2),
        "Y": lambda: F.substring(ymd, 1, 4), "%": lambda: F.lit("%"),
    }
    parts, i = [F.when(us.isNotNull(), "")], 0
    while i < len(pattern):
        if pattern[i] == "%":
            kind = pattern[i + 1 : i + 2]
            if kind not in made:
                return F.lit(None).cast("string")
            parts.append(made[kind]())
            i += 2
        else:
            j = pattern.find("%", i)
            j = len(pattern) if j < 0 else j
            parts.append(F.lit(pattern[i:j]))
            i = j
    return F.concat(*parts)


def now() -> Column:
    """Fixed once a statement."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
