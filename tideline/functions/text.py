"""Text and time scalars as Column functions: no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters and digits (a fixed value).
UNICODE_WORD = r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(x: Column | str) -> Column:
    """Tokens between runs of white space; none for a blank text."""
    return F.filter(F.split(F.trim(_c(x)), r"\s+"), lambda w: w != "")


def word_count(x: Column | str) -> Column:
    return F.size(tokens(x)).cast("long")


def unicode_words(x: Column | str) -> Column:
    """Count of words of letters and digits, joined by hyphens or apostrophes."""
    return F.size(F.regexp_extract_all(_c(x), F.lit(UNICODE_WORD), F.lit(0))).cast("long")


def speech_ms(words: Column | str, per_minute: int) -> Column:
    """Planned speaking time of a number of words, rounded up to 100 ms; 0 for none."""
    n = _c(words)
    return F.when(n > 0, (F.floor((n * 60000 / F.lit(float(per_minute)) + 99) / 100) * 100).cast("long")).otherwise(F.lit(0).cast("long"))


def canonical_key(x: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(_c(x), r"\s+", " ")))


def is_unknown_label(x: Column | str) -> Column:
    key = canonical_key(x)
    return (key == "") | (key == "unknown") | key.rlike(r"^speaker[_\- ]?\d+$")


def safe_id(x: Column | str, default: str = "episode") -> Column:
    clean = F.btrim(F.regexp_replace(F.trim(_c(x)), r"[^A-Za-z0-9._-]+", "-"), F.lit("-._"))
    return F.when(clean == "", default).otherwise(clean)


def short_component(x: Column | str, longest: int = 36) -> Column:
    """A file name part: cleaned, or its start and ten digits of its hash if it is too long."""
    clean = F.btrim(F.regexp_replace(F.trim(_c(x)), r"[^A-Za-z0-9._-]+", "-"), F.lit("-._"))
    tail = F.substring(F.sha2(_c(x), 256), 1, 10)
    return F.when((clean != "") & (F.length(clean) <= longest), clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, longest - 11)), F.lit("-"), tail))


def normal_purpose(x: Column | str) -> Column:
    return F.replace(F.upper(F.trim(F.coalesce(_c(x), F.lit("")))), F.lit(" "), F.lit("_"))


def speech_text(x: Column | str, language: str) -> Column:
    """Text as it is spoken: spaces collapsed, season and episode marks and titles read out."""
    season = "series" if language == "en-GB" else "season"
    value = F.trim(F.regexp_replace(F.replace(_c(x), F.lit(" "), F.lit(" ")), r"\s+", " "))
    value = F.regexp_replace(value, r"(?i)\bS0*(\d{1,2})E0*(\d{1,3})\b", f"{season} $1, episode $2")
    if language == "en-US":
        value = F.regexp_replace(F.regexp_replace(value, r"\bMr\.", "Mister"), r"\bDr\.", "Doctor")
    return value


def srt_time(ms: Column | str) -> Column:
    """HH:MM:SS,mmm of whole milliseconds."""
    m = F.greatest(F.lit(0).cast("long"), _c(ms).cast("long"))
    part = lambda value, n: F.lpad(value.cast("string"), n, "0")
    hours = F.floor(m / 3_600_000)
    return F.concat(
        F.when(hours < 100, part(hours, 2)).otherwise(hours.cast("string")), F.lit(":"), part(F.floor(m / 60_000) % 60, 2), F.lit(":"), part(F.floor(m / 1000) % 60, 2), F.lit(","), part(m % 1000, 3)
    )


def srt_seconds(x: Column | str) -> Column:
    """Seconds of a time mark with optional hours and a comma or point."""
    parts = F.split(F.replace(F.trim(_c(x)), F.lit(","), F.lit(".")), ":")
    back = F.reverse(parts)
    hours = F.coalesce(F.get(back, F.lit(2)).cast("double"), F.lit(0.0))
    return hours * 3600 + F.get(back, F.lit(1)).cast("double") * 60 + F.get(back, F.lit(0)).cast("double")


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, a NUL after every one."""
    return F.sha2(F.concat(*[c for p in parts for c in (p, F.lit("\0"))]), 256)


def pair_hash(a: Column, b: Column) -> Column:
    """SHA-256 of two parts with a NUL between them."""
    return F.sha2(F.concat(a, F.lit("\0"), b), 256)


def fingerprint(separator: str, digits: int, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(separator, *parts), 256), 1, digits)


def stable_seed(x: Column) -> Column:
    """The first eight digits of the hash as a number."""
    return F.conv(F.substring(F.sha2(x, 256), 1, 8), 16, 10).cast("long")


def word_distance(a: str, b: str) -> Column:
    """Edit distance of two arrays of words. The words that both have become characters, those that
    only one has become two more (they match nothing), so that the JVM's edit distance of
    strings is that of the words, in its two rows of memory. Characters are code points beyond U+0100
    without the surrogates: enough for 1.1 million distinct shared words, above which it raises."""
    point = lambda n: F.when(n + 256 < 0xD800, n + 256).otherwise(n + 256 + 0x800)

    def coded(words: str, shared: Column, own: int) -> Column:
        number = lambda w: F.coalesce(F.nullif(F.array_position(shared, w), F.lit(0)) + 2, F.lit(own))
        return F.decode(F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(point(number(w))), 8, "0")), "")), "UTF-32")

    shared = F.array(F.array_intersect(a, b))
    return F.transform(shared, lambda s: F.levenshtein(coded(a, s, 1), coded(b, s, 2)))[0].cast("long")


def caption_phrases(x: str, least: int = 3, most: int = 7) -> Column:
    """Short caption phrases: a group ends at most words, or at punctuation once it has
    least; a short last group takes words from the one before, or joins it. x names a column.
    Groups are matches of one pattern, from left to right: the shortest run of least to most
    words whose last has the punctuation, else up to most words."""
    more = r"\s++\S++"
    stops = rf"""\S++(?:{more}){{{least - 2},{most - 2}}}?\s++\S*[,;:.!?]["')\]]*(?!\S)"""
    groups = F.regexp_extract_all(F.col(x), F.lit(rf"{stops}|\S++(?:{more}){{0,{most - 1}}}+"), F.lit(0))
    words = F.transform(groups, lambda g: F.split(g, r"\s+"))

    def settled(g: Column) -> Column:
        last, before = F.element_at(g, -1), F.element_at(g, -2)
        have, others = F.size(last), F.size(before)
        taken = F.least(least - have, F.greatest(F.lit(0), others - least))
        joins = (have + taken < least) & (others + have <= most)
        tail = F.when(joins, F.array(F.concat(before, last))).otherwise(
            F.array(F.slice(before, 1, others - taken), F.concat(F.slice(before, others - taken + 1, taken), last))
        )
        return F.when((F.size(g) < 2) | (have >= least), g).otherwise(F.concat(F.slice(g, 1, F.size(g) - 2), tail))

    return F.transform(F.array(words), settled)[0]


def two_decimals(x: Column | str) -> Column:
    """A non-negative double with two decimals, rounded on its exact binary value (ties to
    even). Where x is the double nearest to a midpoint, the sign of the midpoint's own
    rounding error decides; it is exact in parts of 24 and 29 bits."""
    v = _c(x)
    k = F.floor(v * 100)
    twice = (2 * k + 1).cast("double")
    middle = twice / 200
    high = middle.cast("float").cast("double")
    error = (high * 200 - twice) + (middle - high) * 200
    up = (v > middle) | ((v == middle) & ((error > 0) | ((error == 0) & (k % 2 == 1))))
    n = k + up.cast("long")
    return F.concat((F.floor(n / 100)).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
