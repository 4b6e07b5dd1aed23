"""Scalar functions of the timeline, as Column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from lifeweave.functions.geo import c, valid_latlon

# Fixed values, as results depend on them: file extensions of media, the forms of date and time in file names (year to second,
# with the separators that cameras write), suffixes of edited copies, and titles that mark captures and received media.
IMAGE_EXT = ["jpg", "jpeg", "png", "heic", "heif", "webp", "tif", "tiff", "gif", "bmp"]
VIDEO_EXT = ["mp4", "mov", "m4v", "3gp", "avi", "mkv", "mts", "webm"]
FILE_TIME = r"(?<!\d)((?:19|20)\d{2})[-_.]?(\d{2})[-_.]?(\d{2})[-_ T.]?(\d{2})[-_.:]?(\d{2})[-_.:]?(\d{2})(?!\d{3,})"
EDIT_MARKS = ["edited", "bearbeitet", "modifié", "editado", "modificato", "bewerkt", "redigerad", "muokattu", "edytowane", "upravené", "измененный", "изменено", "отредактировано"]
EDITED = "(?iu)-(" + "|".join(EDIT_MARKS) + ")$"
SKIP = r"(?iu)screenshot|screen[ _-]?shot|screen[ _-]?record|rpreplay|снимок экрана|скриншот|bildschirmfoto|captura"
RECEIVED = r"(?iu)-WA\d+|^received_|telegram|viber|^FB_IMG|^Messenger_"
RECEIVED_ORIGIN = r"(?iu)partner|shared"
EMOJI = "[\U0001f000-\U0001faff☀-➿️‍]"


def extension(name) -> Column:
    return F.lower(F.regexp_extract(c(name), r"\.([A-Za-z0-9]+)$", 1))


def media_kind(name) -> Column:
    return F.when(extension(name).isin(IMAGE_EXT), "image").when(extension(name).isin(VIDEO_EXT), "video")


def basename(path) -> Column:
    return F.element_at(F.split(c(path), "/"), -1)


def dirname(path) -> Column:
    return F.when(c(path).contains("/"), F.regexp_replace(c(path), "/[^/]*$", "")).otherwise("")


def stem(name) -> Column:
    return F.regexp_replace(c(name), r"\.[^.]*$", "")


def without_edit_mark(name_stem) -> Column:
    return F.regexp_replace(c(name_stem), EDITED, "")


def copy_number(name_stem) -> Column:
    """The n of 'name(n)', 0 without."""
    return F.coalesce(F.regexp_extract(c(name_stem), r"\((\d+)\)$", 1).try_cast("int"), F.lit(0))


def without_copy_number(name_stem) -> Column:
    return F.regexp_replace(c(name_stem), r"\(\d+\)$", "")


def parse_time(v) -> Column:
    """Unix seconds (double) of an export's time value: epoch seconds or milliseconds, ISO (without offset: UTC), the form
    of X ('Mon Dec 04 14:41:52 +0000 2017'), EXIF's, or '4 Dec 2017, 14:41:52 UTC'; NULL if it is none of these."""
    v = F.regexp_replace(c(v), r"^\s+|\s+$", "")
    number = F.when(v.rlike(r"^\d+(\.\d+)?$"), v.try_cast("double"))
    epoch = F.when(number > 1e11, number / 1000).otherwise(number)
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.regexp_replace(v, "[Zz]$", "+00:00"))
    exif = F.when(v.rlike(r"^\d{4}:\d{2}:\d{2} "), F.concat(F.translate(F.substring(v, 1, 10), ":", "-"), F.substring(v, 11, 30)))
    text = F.coalesce(iso, exif)
    zoned = F.when(text.rlike(r"[+-]\d{2}:?\d{2}$"), text).otherwise(F.concat(text, F.lit("+00:00")))
    plain = F.unix_micros(zoned.try_cast("timestamp")) / 1e6
    parts = r"^[A-Z][a-z]{2} ([A-Z][a-z]{2}) (\d{2}) (\d{2}:\d{2}:\d{2}) ([+-]\d{4}) (\d{4})$"
    tweet = F.unix_timestamp(F.try_to_timestamp(F.when(v.rlike(parts), F.regexp_replace(v, parts, "$5 $1 $2 $3 $4")), F.lit("yyyy MMM dd HH:mm:ss Z")))
    words = r"^(\d{1,2}) ([A-Z][a-z]{2}) (\d{4}), (\d{2}:\d{2}:\d{2}) UTC$"
    long = F.unix_timestamp(F.try_to_timestamp(F.when(v.rlike(words), F.regexp_replace(v, words, "$3 $2 $1 $4 +0000")), F.lit("yyyy MMM d HH:mm:ss Z")))
    return F.coalesce(epoch, plain, tweet.cast("double"), long.cast("double"))


def parse_latlng(v) -> tuple[Column, Column]:
    """(lat, lon) of '12.34°, 56.78°' or 'geo:12.34,56.78'; NULLs outside the valid range."""
    pattern = r"([-+]?\d+(?:\.\d+)?)\s*°?\s*,\s*([-+]?\d+(?:\.\d+)?)"
    lat, lon = (F.regexp_extract(c(v), pattern, i).try_cast("double") for i in (1, 2))
    ok = valid_latlon(lat, lon)
    return F.when(ok, lat), F.when(ok, lon)


def fix_mojibake(s) -> Column:
    """UTF-8 that was read as Latin-1, put right; any other text as it is."""
    s = c(s)
    again = F.try_validate_utf8(F.encode(s, "ISO-8859-1").cast("string"))
    return F.when(s.rlike(r"^[\x00-\xff]*$"), F.coalesce(again, s)).otherwise(s)


def mend_tree(document: str) -> str:
    """A JSON document with all of its texts and keys put right as ``fix_mojibake`` does; what is no JSON as it is."""
    import json

    def mend(v):
        match v:
            case str():
                try:
                    return v.encode("latin-1").decode()
                except UnicodeError:
                    return v
            case list():
                return list(map(mend, v))
            case dict():
                return {mend(k): mend(x) for k, x in v.items()}
        return v

    try:
        return json.dumps(mend(json.loads(document)), ensure_ascii=False)
    except ValueError:
        return document


def fix_mojibake_tree(documents) -> Column:
    """``mend_tree`` of a column of JSON documents; NULL stays NULL."""
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(mend_tree, na_action="ignore")

    return F.pandas_udf(run, "string")(c(documents))


def share_count(share, n) -> Column:
    """How many items a share of n is: at least two, half to even."""
    return F.greatest(F.lit(2), F.rint(c(share) * c(n))).cast("bigint")


def time_from_filename(name) -> Column:
    """Unix seconds (UTC) of a date and time in a file name; NULL if there is none or it isn't valid."""
    y, mo, d, h, mi, s = (F.regexp_extract(c(name), FILE_TIME, i) for i in range(1, 7))
    text = F.concat(y, F.lit("-"), mo, F.lit("-"), d, F.lit("T"), h, F.lit(":"), mi, F.lit(":"), s, F.lit("+00:00"))
    return F.unix_micros(F.when(y != "", text).try_cast("timestamp")) / 1e6


def degrees_of(d, m, s, ref) -> Column:
    """Degrees, minutes, seconds with a hemisphere letter."""
    v = c(d) + c(m) / 60 + c(s) / 3600
    return F.when(~F.isnan(v), F.when(F.upper(c(ref)).isin("S", "W"), -v).otherwise(v))


def meta_score(favorite="favorite", shared="shared", views="views", description="description", lat="lat", title="title") -> Column:
    """What a record's metadata say for it."""
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return (
        3 * flag(c(favorite)) + 2 * flag(c(shared)) + 0.6 * F.log1p(F.greatest(F.coalesce(c(views), F.lit(0)), F.lit(0)).cast("double"))
        + flag(c(description) != "") + 0.3 * flag(c(lat).isNotNull()) - 1.5 * flag(c(title).rlike(RECEIVED))
    )


def hamming(a, b) -> Column:
    return F.bit_count(c(a).bitwiseXOR(c(b)))


def stamp(ts) -> Column:
    """The instant of unix seconds."""
    return F.timestamp_micros(F.floor(c(ts) * 1e6).cast("bigint"))


def utc_day(ts) -> Column:
    return F.floor(c(ts) / 86400).cast("bigint")


def year_of(ts) -> Column:
    return F.year(F.date_add(F.lit("1970-01-01").cast("date"), utc_day(ts).cast("int")))


def caption_date(ts, lon=None) -> Column:
    """'4 December 2017' in the solar time zone of a longitude (UTC without one)."""
    shift = F.lit(0.0) if lon is None else F.coalesce(F.rint(c(lon) / 15), F.lit(0.0)) * 3600
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((c(ts) + shift) / 86400).cast("int"))
    return F.date_format(day, "d MMMM yyyy")


def strip_links(text) -> Column:
    return F.trim(F.regexp_replace(c(text), r"\s*https://t\.co/\w+", ""))


def strip_emoji(text) -> Column:
    return F.trim(F.regexp_replace(c(text), EMOJI, ""))


def plural(n, word: str) -> Column:
    return F.concat(F.format_number(c(n), 0), F.lit(f" {word}"), F.when(c(n) == 1, "").otherwise("s"))


def span_text(first, last) -> Column:
    return F.when(c(first) == c(last), c(first).cast("string")).otherwise(F.concat(c(first).cast("string"), F.lit(" — "), c(last).cast("string")))


def origin_of(json) -> Column:
    """The first key of an upload origin object, with its device type if it has one."""
    key = F.element_at(F.json_object_keys(c(json)), 1)
    device = F.regexp_extract(c(json), r'"deviceType"\s*:\s*"([^"]+)"', 1)
    return F.when(device != "", F.concat(key, F.lit(":"), device)).otherwise(key)


# ---- options (plain Python)


def date_bound(s: str, end: bool = False) -> float:
    """Unix seconds of 'YYYY', 'YYYY-MM' or 'YYYY-MM-DD'; as an end, the last second of that period."""
    parts = [int(x) for x in s.split("-")]
    y, m, d = (parts + [1, 1])[:3]
    start = dt.datetime(y, m, d, tzinfo=dt.UTC)
    if not end:
        return start.timestamp()
    after = start.replace(year=y + 1) if len(parts) == 1 else start.replace(year=y + m // 12, month=m % 12 + 1) if len(parts) == 2 else start + dt.timedelta(days=1)
    return after.timestamp() - 1


def share_option(s: str) -> float:
    """'15%' as 0.15; only from 0 to 100 percent."""
    v = float(s.rstrip("%")) / (100 if s.endswith("%") else 1)
    if not 0 <= v <= 1:
        raise ValueError(f"not a share: {s}")
    return v


def count_option(s: str) -> int | float:
    """'150' as a number of at least 2, '0.3%' as a share."""
    if s.endswith("%"):
        v = float(s[:-1]) / 100
        if not 0 < v <= 1:
            raise ValueError(f"not a percentage: {s}")
        return v
    n = int(s)
    if n < 2:
        raise ValueError(f"too few: {s}")
    return n
