"""Scalar functions on text, numbers and dates; all are built-in JVM expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.clean import let

WORD_BLANKS = r"[\s ]+"


def clean(c: Column) -> Column:
    """Blanks collapsed and trimmed; null where nothing is left."""
    return F.nullif(F.btrim(F.regexp_replace(c, WORD_BLANKS, " ")), F.lit(""))


def _bases() -> tuple[str, str]:
    """Latin letters with marks, and their base letters, by rule."""
    pairs = [(chr(k), unicodedata.normalize("NFKD", chr(k))[0]) for k in range(0xC0, 0x250)]
    kept = [(a, b) for a, b in pairs if a != b and b.isalpha()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_bases()), "[̀-ͯ]", "")


def canon_text(c: Column) -> Column:
    """The form under which texts are compared: no accents, case, punctuation and doubled blanks; null where nothing is left."""
    return clean(F.regexp_replace(F.replace(F.lower(strip_accents(c)), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}_]+", " "))


# The date patterns in their order; day before month.
DATE_PATTERNS = ["yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyyMMdd"]


def parse_date(c: Column) -> Column:
    """The ISO date of a text by the first pattern that fits, what follows a T cut off; null if none does."""

    def by_pattern(s: Column) -> Column:
        # a length guard keeps patterns of single digits from taking longer or shorter years
        return F.coalesce(*[F.when(s.rlike(_shape(p)), F.try_to_timestamp(s, F.lit(p)).cast("date")) for p in DATE_PATTERNS]).cast("string")

    return let(F.regexp_extract(clean(c), "^([^T]*)", 1), by_pattern)


def _shape(pattern: str) -> str:
    rx = pattern.replace("yyyy", "Y").replace("MMMM", "L").replace("MMM", "K").replace("MM", "T").replace("dd", "T")
    if pattern == "yyyyMMdd":
        return r"^\d{8}$"
    return "^" + "".join({"Y": r"\d{4}", "L": r"[A-Za-z]{3,}", "K": r"[A-Za-z]{3}", "M": r"\d{1,2}", "d": r"\d{1,2}", "T": r"\d{2}"}.get(ch, ch) for ch in rx) + "$"


def int_prefix(c: Column) -> Column:
    """The first whole number in a text."""
    return F.nullif(F.regexp_extract(c, r"(-?\d+)", 1), F.lit("")).try_cast("bigint")


# Words of file names that are no part of a title.
NOISE = ["1080p", "720p", "480p", "2160p", "4k", "uhd", "hd", "sd", "x264", "x265", "h264", "h265", "hevc", "web", "webrip", "web-dl", "dl", "bluray", "xxx", "mp4", "aac"]


def title_from_filename(c: Column) -> Column:
    """A title out of a file's name: no extension, separators as blanks, no words of format."""
    stem = F.regexp_replace(c, r"\.[^.]{0,4}$", "")
    words = F.split(F.btrim(F.regexp_replace(stem, r"[._\-\[\]()\s]+", " ")), " ")
    kept = F.filter(words, lambda w: ~F.lower(w).isin(NOISE) & ~w.rlike(r"(?i)^\d{1,4}p$") & (w != ""))
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def local_path(url: Column) -> Column:
    """An address without scheme and host."""
    return let(F.regexp_replace(url, "(?i)^https?://[^/]*", ""), lambda p: F.when(p == "", "/").otherwise(p))


def option_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(key), 1, 10))


def redact(c: Column) -> Column:
    """Credentials in a text replaced."""
    s = F.regexp_replace(c, r"(?i)((?:api[_-]?key|apikey|token|password|secret)[\"']?\s*[:=]\s*[\"']?)[^\s\"'&,;]+", "$1<redacted>")
    s = F.regexp_replace(s, r"(?i)(authorization\s*:\s*(?:bearer|basic)\s+)\S+", "$1<redacted>")
    return F.regexp_replace(s, r"(?i)(://[^/:@\s]+:)[^@/\s]+(@)", "$1<redacted>$2")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.btrim(c.cast("string"))).isin("true", "yes", "1", "on"), F.lit(False))


def split_list(c: Column, delimiters: str = ",") -> Column:
    """The trimmed, non-blank parts of a text, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(c, f"[{delimiters}]"), lambda x: F.trim(x)), lambda x: x != ""))


def first_meaningful(*values: Column) -> Column:
    """The first value that is not empty or a word for nothing."""
    return F.coalesce(*[F.when(~F.lower(F.btrim(v)).rlike(r"^(no (data|director|information)|unknown|none|n/?a|-|\?)?$"), v) for v in values])


def gender_word(c: Column) -> Column:
    """A gender as its upper-case word, null if it is none of the known ones."""
    word = F.upper(F.regexp_replace(F.btrim(c), r"[\s\-]+", "_"))
    # The words
    return F.when(word.isin("MALE", "FEMALE", "TRANSGENDER_MALE", "TRANSGENDER_FEMALE", "INTERSEX", "NON_BINARY"), word)
