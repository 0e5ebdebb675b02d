"""Paths of entries: sanitising, names, destinations. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_COMPONENTS = 4096
RESERVED = "^(?i)(CON|PRN|AUX|NUL|CONIN\\$|CONOUT\\$|(COM|LPT)[0-9¹²³])$"


def components(raw: Column) -> Column:
    return F.filter(F.split(F.replace(raw, F.lit("\\"), F.lit("/")), "/"), lambda c: ~c.isin("", "."))


def sanitize(raw: Column) -> Column:
    """A safe relative path, or null: no '..', no ':' or NUL, 1 to 4096 components."""
    c = components(raw)
    bad = F.exists(c, lambda x: (x == "..") | F.contains(x, F.lit(":")) | F.contains(x, F.lit("\0")))
    return F.when(~bad & (F.size(c) > 0) & (F.size(c) <= MAX_COMPONENTS), F.array_join(c, "/"))


def mangle_device(component: Column) -> Column:
    """Reserved device names get a leading underscore."""
    stem = F.rtrim(F.split(component, "\\.")[0])
    return F.when(stem.rlike(RESERVED), F.concat(F.lit("_"), component)).otherwise(component)


def join_under(base: Column, safe: Column, mangle: bool = False) -> Column:
    parts = F.split(safe, "/")
    return F.concat_ws("/", base, F.array_join(F.transform(parts, mangle_device) if mangle else parts, "/"))


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(n: Column) -> Column:
    cut = F.regexp_extract(n, "^(.+)\\.[^.]*$", 1)
    return F.when(cut == "", n).otherwise(cut)


def extension(path: Column) -> Column:
    """Lower-case last extension; '' for none and for dot files."""
    return F.lower(F.regexp_extract(name(path), "^.+\\.([^.]*)$", 1))


def looks_like_copy(path: Column) -> Column:
    n = F.lower(name(path))
    return n.rlike("copy|duplicate") | F.rtrim(stem(n)).rlike("\\([0-9]+\\)$")


def in_directory(directory: Column, path: Column) -> Column:
    return (path == directory) | F.startswith(path, F.concat(directory, F.lit("/")))


def quarantine_dest(directory: Column, victim: Column) -> Column:
    parts = F.filter(F.split(victim, "/"), lambda c: ~c.isin("", ".", ".."))
    return F.concat_ws("/", directory, F.array_join(parts, "/"))


def numbered(dest: Column, n: Column) -> Column:
    """The n-th taker of a destination: 'stem (n).ext' from the second on."""
    nm = name(dest)
    parent = F.regexp_extract(dest, "^(.*/)[^/]*$", 1)
    ext = F.regexp_extract(nm, "^.+(\\.[^.]*)$", 1)
    return F.when(n <= 1, dest).otherwise(F.concat(parent, stem(nm), F.lit(" ("), n.cast("string"), F.lit(")"), ext))


def printable(n: Column) -> Column:
    """Control characters as \\u{hhhh}."""
    chars = F.split(n, "")
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike("^\\p{Cc}$"), F.concat(F.lit("\\u{"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"), F.lit("}"))).otherwise(c)), "")


def url_filename(url: Column) -> Column:
    bare = F.regexp_replace(url, "(?s)[?#].*$", "")
    return F.element_at(F.split(F.regexp_replace(bare, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), "/"), -1)


def fold(s: Column) -> Column:
    """Case-folded key for grouping; never a reason to drop a row."""
    return F.lower(s)


def volume(path: Column, dev: Column) -> Column:
    drive = F.upper(F.regexp_extract(path, "^[A-Za-z]:", 0))
    return F.coalesce(dev, F.when(drive != "", drive))


def charset(n: Column) -> Column:
    return F.when(n.rlike("^[\\x00-\\x7F]*$"), "ascii").when(n.rlike("\\p{InCJKUnifiedIdeographs}|\\p{InHiragana}|\\p{InKatakana}|\\p{InHangulSyllables}"), "cjk").when(n.rlike("\\p{InCyrillic}"), "cyrillic").when(n.rlike("\\p{InArabic}"), "arabic").when(n.rlike("^[\\x00-\\x{24F}]*$"), "latin").otherwise("other")


def scrub(message: Column) -> Column:
    """A message without the paths in it."""
    return F.regexp_replace(message, "([A-Za-z]:)?[/\\\\][^ \\n\\t\"']+", "<path>")


def bytes_human(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_number(n / 1024**k, 2), F.lit(f" {unit}"))).otherwise(out)
    return out


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def version_key(tag: Column) -> Column:
    """(major, minor, patch) of 'v1.2.3', else null."""
    part = lambda i: F.regexp_extract(tag, "^v?([0-9]{1,9})\\.([0-9]{1,9})\\.([0-9]{1,9})$", i)
    return F.when(part(1) != "", F.struct(*[F.expr("int(0)") + F.when(part(i) != "", part(i)).cast("int") for i in (1, 2, 3)]))


def safe_tag(tag: Column) -> Column:
    return tag.rlike("^[A-Za-z0-9._-]{1,64}$") & ~F.contains(tag, F.lit(".."))


def safe_repo(repo: Column) -> Column:
    return repo.rlike("^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$")


def content_range_start(value: Column) -> Column:
    n = F.regexp_extract(value, "^bytes ([0-9]{1,18})-", 1)
    return F.when(n != "", n).cast("long")


def default_dest(archive: Column) -> Column:
    return F.regexp_replace(archive, "(?i)(\\.tar)?\\.(tar|tgz|txz|tbz2?|tzst|gz|xz|zst|bz2|lz4|br|zip|7z|iso|pack|rar)$", "")


def zip_mtime(date: Column, time: Column) -> Column:
    """DOS date and time words; null when not a date."""
    bits = lambda c, at, n: F.shiftright(c, at).bitwiseAND((1 << n) - 1)
    return F.try_make_timestamp(bits(date, 9, 7) + 1980, bits(date, 5, 4), bits(date, 0, 5), bits(time, 11, 5), bits(time, 5, 6), (bits(time, 0, 5) * 2).cast("decimal(8,6)"))


def unix_mtime(secs: Column) -> Column:
    """Seconds since 1970; 0 is absent and times after the year 3000 are refused."""
    return F.when((secs > 0) & (secs < 32503680000), F.timestamp_seconds(secs))


def filetime(ticks: Column) -> Column:
    """100 ns since 1601; null before 1970 or after 3000."""
    return unix_mtime(F.expr("0L") + (ticks / 10_000_000).cast("long") - 11644473600)
