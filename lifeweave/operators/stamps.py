"""Normalising raw time values of many formats and zones to one UTC instant, as Column expressions only.

Method: an ordered cascade of anchored patterns; the first that matches rewrites the value to one line of fields, which
are then checked strictly (calendar, clock, weekday). Values with an offset, abbreviation or zone in the text are fixed by
it; others are wall-clock times of the row's zone (or of its source's default zone, from a lookup). Wall-clock times that a
clock change skips or repeats follow an explicit policy.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English month and weekday abbreviations, and zone abbreviations that stand for one offset, in minutes.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "NPT": 345, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

#: Epoch values are told apart by size; each unit covers the years 1973 to 5138 in seconds.
EPOCH_UNITS = [(1e8, 1e11, 1), (1e11, 1e14, 1_000), (1e14, 1e17, 1_000_000), (1e17, 1e20, 1_000_000_000)]

_DAY = r"(\d{4})-(\d{2})-(\d{2})"
_CLOCK = r"(\d{2}):(\d{2}):(\d{2})(?:[.,](\d{1,9}))?"
_ZONE = r" ?(Z|z|[A-Z]{2,5}|(?:GMT|UTC)?[+-]\d{1,2}(?::?\d{2})?)?(?:\[([A-Za-z0-9_+\-/]+)\])?"
_MON, _WEEK = r"([A-Z][a-z]{2})", r"([A-Z][a-z]{2})"
_EXT = r"\.[A-Za-z0-9]{2,5}"

#: (pattern, fields as 'year|month|day|hour|minute|second|fraction|am or pm|zone text|zone name|weekday', locales or None for any).
CASCADE = [
    (rf"^{_DAY}[T ]{_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9|", None),
    (rf"^(\d{{4}}):(\d{{2}}):(\d{{2}}) {_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9|", None),
    (rf"^{_DAY}[T ](\d{{2}}):(\d{{2}}){_ZONE}$", "$1|$2|$3|$4|$5|0|||$6|$7|", None),
    (rf"^{_WEEK} {_MON} (\d{{1,2}}) {_CLOCK} ([+-]\d{{4}}|[A-Z]{{2,5}}) (\d{{4}})$", "$9|$2|$3|$4|$5|$6|$7||$8||$1", None),
    (rf"^{_WEEK}, (\d{{1,2}}) {_MON} (\d{{4}}) {_CLOCK} ([+-]\d{{4}}|[A-Z]{{2,5}})$", "$4|$3|$2|$5|$6|$7|$8||$9||$1", None),
    (rf"^(\d{{1,2}}) {_MON} (\d{{4}}),? {_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8|$9|", None),
    (rf"^{_MON} (\d{{1,2}}), (\d{{4}}),? (\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))? ([AP]M){_ZONE}$", "$3|$1|$2|$4|$5|$6||$7|$8|$9|", None),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}),? (\d{1,2}):(\d{2})(?::(\d{2}))? ([AP]M)$", "$3|$1|$2|$4|$5|$6||$7|||", ["en_US"]),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}),? (\d{1,2}):(\d{2})(?::(\d{2}))?$", "$3|$1|$2|$4|$5|$6|||||", ["en_US"]),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}),? (\d{1,2}):(\d{2})(?::(\d{2}))?$", "$3|$2|$1|$4|$5|$6|||||", ["en_GB", "en_AU", "en_IE", "en_NZ", "fr_FR", "es_ES", "it_IT", "pt_PT", "pt_BR"]),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2}),? (\d{1,2}):(\d{2})(?::(\d{2}))?$", "$3|$2|$1|$4|$5|$6|||||", ["de_DE", "de_AT", "de_CH", "ru_RU", "pl_PL", "cs_CZ", "fi_FI", "nb_NO", "da_DK", "tr_TR"]),
    (rf"^(?:[A-Za-z]+[_-])?(\d{{4}})(\d{{2}})(\d{{2}})[_-](\d{{2}})(\d{{2}})(\d{{2}})(\d{{3}})?(?:[_~-][A-Za-z0-9_~-]+)?(?:{_EXT})?$", "$1|$2|$3|$4|$5|$6|$7||||", None),
    (rf"^(?:[A-Za-z]+[_-])?(\d{{4}})-(\d{{2}})-(\d{{2}})[-_](\d{{2}})-(\d{{2}})-(\d{{2}})(?:[_-][A-Za-z0-9_-]+)?{_EXT}$", "$1|$2|$3|$4|$5|$6|||||", None),
    (rf"^{_DAY} (\d{{2}})\.(\d{{2}})\.(\d{{2}})(?:[ _-][A-Za-z0-9_-]+)?{_EXT}$", "$1|$2|$3|$4|$5|$6|||||", None),
]

_NUMBER = r"^[+-]?\d+(?:\.\d+)?(?:[eE][+]?\d{1,2})?$"


def _lookup(names: list[str], key: Column, first: int = 1) -> Column:
    return F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i + first)])[key]


def _offset_seconds(text: Column) -> Column:
    """Seconds east of UTC of 'Z', an abbreviation, '+05:45', '-0400', '+02', 'GMT+5:30'; NULL if unknown."""
    signed = F.regexp_replace(text, r"^(?:GMT|UTC)(?=[+-])", "")
    parts = r"^([+-])(\d{1,2}?):?(\d{2})?$"
    hours = F.regexp_extract(signed, parts, 2).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(signed, parts, 3).try_cast("int"), F.lit(0))
    numeric = F.when((hours <= 18) & (minutes <= 59), F.when(F.substring(signed, 1, 1) == "-", -1).otherwise(1) * (hours * 3600 + minutes * 60))
    table = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 60)])
    return F.when(signed.rlike(parts), numeric).otherwise(table[F.upper(text)])


def _barrier(df: DataFrame) -> DataFrame:
    """The same rows, one generated row each: a filter on computed columns stays above and isn't rewritten in terms of the
    raw text, which would repeat each staged expression in every place that uses it."""
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("__row")).select("__row.*")


def _staged(df: DataFrame, raw: Column, zone: Column, locale: Column, ambiguous: str, nonexistent: str, out: str) -> DataFrame:
    """Adds ``out`` in projections that build on one another: each intermediate value is computed once, and no generated
    expression grows with the cascade times its uses."""
    # the text without odd blanks, epochs (exact in decimal), and the line of fields of the first pattern that fits
    df = df.withColumn("__v", F.regexp_replace(F.regexp_replace(raw, r"[\u00a0\u2007\u2009\u202f]", " "), r"^[\s\ufeff]+|[\s\ufeff]+$", "")).withColumns({"__z": zone, "__l": locale})
    v, number = F.col("__v"), F.col("__number")
    df = df.withColumn("__number", F.when(v.rlike(_NUMBER) & (F.length(v) <= 28), v.try_cast("decimal(38,9)")))
    fields = F.lit(None).cast("string")
    for pattern, form, locales in reversed(CASCADE):
        hit = v.rlike(pattern) if locales is None else v.rlike(pattern) & F.col("__l").isin(locales)
        fields = F.when(hit, F.regexp_replace(v, pattern, form)).otherwise(fields)
    df = _barrier(df.withColumn("__f", F.split(F.when(number.isNull(), fields), r"\|", -1)))
    size = F.abs(number).cast("double")
    epoch = F.lit(None).cast("decimal(38,6)")
    for low, high, unit in EPOCH_UNITS:
        millis = number * F.lit(1000) if unit == 1 else number / F.lit(unit // 1000)
        epoch = F.when((size >= low) & (size < high), millis.cast("decimal(38,6)")).otherwise(epoch)
    df = df.withColumn("__epoch", F.floor(epoch).cast("bigint"))
    # fields, checked against calendar and clock
    f = [F.get("__f", F.lit(i)) for i in range(11)]
    df = df.withColumns({f"__{i}": f[i].try_cast("int") for i in (0, 1, 2, 3, 4, 5)} | {"__half": f[7], "__text": f[8], "__week": f[10], "__known": F.when(f[9] != "", f[9]).otherwise(F.col("__z")), "__ms": F.rpad(F.substring(f[6], 1, 3), 3, "0").try_cast("int")})
    year = F.when(F.length(f[0]) == 2, F.col("__0") + 2000).otherwise(F.col("__0"))
    month = F.coalesce(F.col("__1"), _lookup(MONTHS, F.lower(f[1])))
    df = df.withColumn("__day", F.when(year >= 1800, F.format_string("%04d-%02d-%02d", year, month, F.col("__2")).try_cast("date")))
    half, minute, second = F.col("__half"), F.col("__4"), F.coalesce(F.col("__5"), F.lit(0))
    hour = F.when(half == "", F.when(F.col("__3") <= 23, F.col("__3"))).when(F.col("__3").between(1, 12), F.col("__3") % 12 + F.when(half == "PM", 12).otherwise(0))
    right = F.col("__day").isNotNull() & (minute <= 59) & (second <= 59) & ((F.col("__week") == "") | (_lookup(WEEKDAYS, F.lower("__week"), 0) == F.weekday("__day")))
    df = df.withColumn("__local", F.when(right, F.datediff("__day", F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + hour * 3600 + minute * 60 + second))
    # wall-clock times: the zone's offsets a day before and after frame any clock change; an offset counts if it leads
    # back to the same wall-clock time. One such offset: one instant; two: ambiguous; none: nonexistent
    local, known = F.col("__local"), F.col("__known")
    df = df.withColumn("__known", F.when((F.col("__text") == "") & local.isNotNull() & known.isin(sorted(available_timezones())), known))

    def offset(utc: Column) -> Column:
        return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(utc), known)) - utc

    df = df.withColumns({"__o1": offset(local - 86400), "__o2": offset(local + 86400)})
    o1, o2 = F.col("__o1"), F.col("__o2")
    df = df.withColumns({"__ok1": offset(local - o1) == o1, "__ok2": offset(local - o2) == o2})
    nothing = F.lit(None).cast("bigint")
    twice = {"reject": nothing, "earlier": local - F.greatest(o1, o2), "later": local - F.least(o1, o2)}[ambiguous]
    never = {"reject": nothing, "shift_forward": local - o1}[nonexistent]
    wall = F.when(o1 == o2, local - o1).when(F.col("__ok1") & F.col("__ok2"), twice).when(F.col("__ok1"), local - o1).when(F.col("__ok2"), local - o2).when(known.isNotNull(), never)
    seconds = F.when(F.col("__text") != "", local - _offset_seconds(F.col("__text"))).otherwise(wall)
    df = df.withColumn(out, F.coalesce(F.col("__epoch"), seconds * 1000 + F.col("__ms")).cast("bigint"))
    return _barrier(df.drop(*[c for c in df.columns if c.startswith("__")]))


def normalise_stamps(stamps: DataFrame, value: str = "raw_value", zone: str = "zone_name", locale: str = "locale_code", source_zones: DataFrame | None = None, out: str = "utc_ms", ambiguous: str = "reject", nonexistent: str = "reject") -> DataFrame:
    """``stamps`` with ``out``: unix milliseconds (bigint, rounded down) of the value, NULL where it isn't exactly one instant.

    NULL for: null, blank, zero, unparsable or impossible values, a date without a time, a wall-clock time whose zone is
    null or no known zone, numeric day/month forms without a locale; and what the policies reject (``ambiguous``: 'reject',
    'earlier', 'later'; ``nonexistent``: 'reject', 'shift_forward'). ``source_zones`` (source, default_zone; one row a
    source) gives the zone of rows without one, by their column ``source``. No shuffle but for that join; repeated rows
    keep their own results; an empty table gives an empty one. Column names must not begin with two underscores."""
    z = F.col(zone)
    if source_zones is not None:
        lookup = source_zones.select(F.col("source").alias("__source"), F.col("default_zone").alias("__zone")).dropDuplicates(["__source"])
        stamps = stamps.join(lookup, stamps["source"] == lookup["__source"], "left")
        z = F.coalesce(z, F.col("__zone"))
    return _staged(stamps, F.col(value), z, F.col(locale), ambiguous, nonexistent, out)
