"""Scalar functions over Spark columns: dates, links, names and texts of a registry. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as the archive shows them.
MONTHS = ["jaanuar", "veebruar", "märts", "aprill", "mai", "juuni", "juuli", "august", "september", "oktoober", "november", "detsember"]


def fold_table() -> tuple[str, str]:
    """Accented Latin letters in lower case and the letters they fold to, derived from their decomposition."""
    pairs = [(chr(o), unicodedata.normalize("NFD", chr(o))[0]) for o in range(0xC0, 0x250) if chr(o).islower() and len(unicodedata.normalize("NFD", chr(o))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case, Latin accents off."""
    a, b = fold_table()
    return F.translate(F.lower(text), a, b)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def julian_day(ts: Column) -> Column:
    """Days since noon of day 0 of the Julian calendar, with the time of day as a fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86400000000.0) + F.lit(2440587.5)


def day_lag(later: Column, earlier: Column) -> Column:
    """Unrounded days between two times; a date counts from its midnight."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86400000000.0)


def lag_shown(later: Column, earlier: Column) -> Column:
    """Whole days as shown in listings, halves away from zero."""
    return F.round(day_lag(later, earlier)).cast("int")


def year_text(day: Column) -> Column:
    return F.date_format(day, "yyyy")


def month_text(day: Column) -> Column:
    return F.date_format(day, "MM")


def month_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(day))


def in_year(day: Column, year: int) -> Column:
    """Half-open range of a year, which reaches the scan as a pushed filter; a function of the column would not."""
    return (day >= F.lit(f"{year:04d}-01-01").cast("date")) & (day < F.lit(f"{year + 1:04d}-01-01").cast("date"))


def in_month(day: Column, year: int, month: int) -> Column:
    nxt = (year + 1, 1) if month == 12 else (year, month + 1)
    return (day >= F.lit(f"{year:04d}-{month:02d}-01").cast("date")) & (day < F.lit(f"{nxt[0]:04d}-{nxt[1]:02d}-01").cast("date"))


def strict_date(text: Column) -> Column:
    """dd.MM.yyyy or null."""
    return F.expr("CAST(NULL AS DATE)") if text is None else F.when(text.rlike(r"^\s*\d{1,2}\.\d{1,2}\.\d{4}\s*$"), F.try_to_date(F.trim(text), "d.M.yyyy"))


def lenient_date(text: Column) -> Column:
    """The date in any of the notations registries use, time of day dropped, months in words read; else null."""
    words = F.regexp_replace(F.lower(F.trim(text)), r"[ t]\d{1,2}:\d{2}(:\d{2})?.*$", "")
    named = r"^(\d{1,2})\.?\s+(\p{L}+)\s+(\d{4})$"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(words, named, 2))
    spelt = F.concat_ws(".", F.regexp_extract(words, named, 1), month.cast("string"), F.regexp_extract(words, named, 3))
    return (
        F.when(words.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(words, "d.M.yyyy")).when(words.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(words, "yyyy-MM-dd"))
        .when(words.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(words, "d/M/yyyy")).when(words.rlike(named), F.try_to_date(spelt, "d.M.yyyy"))
    )


def site(url: Column) -> Column:
    """Scheme and host of a URL."""
    return F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(url, F.lit("HOST")))


def absolute(url: Column, base: Column) -> Column:
    """A link as it stands if it is absolute, else below the site of `base`."""
    return F.when(F.lower(url).rlike("^https?://"), url).otherwise(F.concat(site(base), F.lit("/"), F.ltrim(url, F.lit("/"))))


def encoded_path(path: Column) -> Column:
    """Each segment of a path percent-encoded."""
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.rtrim(F.regexp_replace(url, r"[?#].*$", ""), F.lit("/")), "/"), -1)


def trailing_id(url: Column) -> Column:
    """The number a link ends in, 0 if it ends in none."""
    return F.coalesce(F.regexp_extract(last_segment(url), r"^(\d{1,18})", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def url_uuid(url: Column) -> Column:
    """The UUID in a document link or null."""
    found = F.regexp_extract(url, r"(?i)dokument/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1)
    return F.when(found != "", F.lower(found))


def note_id(number: Column) -> Column:
    """NT and the number in eight hexadecimal digits."""
    return F.concat(F.lit("NT"), F.lpad(F.hex(number), 8, "0"))


def note_number(note: Column) -> Column:
    return F.conv(F.substring(note, 3, 16), 16, 10).cast("bigint")


def file_name(name: Column, fallback: Column) -> Column:
    """A safe file name: no path, no NUL, single spaces, percent signs spelt out; dot-names and empty ones replaced."""
    clean = F.regexp_replace(F.regexp_replace(name, "\\x00", ""), r"^.*[/\\]", "")
    clean = F.replace(F.regexp_replace(F.trim(clean), r"\s+", " "), F.lit("%"), F.lit("_percent"))
    return F.when(clean.isin("", ".", "..") | clean.isNull(), fallback).otherwise(clean)


def header_file_name(header: Column, url: Column) -> Column:
    """The file name of a Content-Disposition header (the extended form first), else the last part of the link, decoded."""
    extended = F.regexp_extract(header, r"(?i)filename\*\s*=\s*[^']*'[^']*'([^;\r\n]+)", 1)
    quoted = F.regexp_extract(header, r"(?i)filename\s*=\s*\"([^\"\r\n]+)\"", 1)
    bare = F.regexp_extract(header, r"(?i)filename\s*=\s*'?([^;'\"\r\n]+)'?", 1)
    name = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in (extended, quoted, bare)])
    return F.coalesce(F.try_url_decode(name), name, F.try_url_decode(last_segment(url)), last_segment(url))


IMAGES = ["jpg", "jpeg", "png", "gif", "bmp", "webp"]  # fixed values


def file_class(name: Column) -> Column:
    """How a file is shown: image, sheet or other, by its extension."""
    return F.when(extension(name).isin(IMAGES), "image").when(extension(name) == "xlsx", "sheet").otherwise("other")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def breaks(text: Column) -> Column:
    """A line break element before each newline."""
    return F.regexp_replace(text, "(\r\n|\n|\r)", "<br />\n")


def slug(text: Column) -> Column:
    """ASCII, lower case, words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def whole_number(text: Column) -> Column:
    """The number a text begins with, 0 if none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d{1,18})", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def bases(text: Column) -> Column:
    """Parts of a comma list of legal bases, empty ones and "0" dropped, in order, each once."""
    return F.array_distinct(F.filter(F.split(text, ", "), lambda s: ~s.isin("", "0")))
