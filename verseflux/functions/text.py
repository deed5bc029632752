"""String functions. All are built-in Spark expressions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() removes. Spark's one-argument
# trim() removes blanks only.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Regular-expression class of the same characters, for splitting.
WHITE_SPACE_CLASS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing white space of every kind."""
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and all-white-space text; never null."""
    return F.coalesce(strip(c) == "", F.lit(True))


def unify_newlines(c: Column | str) -> Column:
    r"""Turn ``\r\n`` and lone ``\r`` into ``\n``, as a text-mode file read does."""
    c = _col(c)
    unified = F.regexp_replace(c, r"\r\n?", "\n")
    return F.when(F.contains(c, F.lit("\r")), unified).otherwise(c)


def file_title(c: Column | str) -> Column:
    """Title as used in file names: blanks become underscores, then strip. Keeps case.

    The replacement comes first, so outer blanks survive as underscores.
    """
    return strip(F.replace(_col(c), F.lit(" "), F.lit("_")))


def canonical_title(c: Column | str) -> Column:
    """Join key: blanks become underscores, then lower case, then strip (in this order)."""
    return strip(F.lower(F.replace(_col(c), F.lit(" "), F.lit("_"))))


def base_name(path: Column | str) -> Column:
    """Part after the last slash."""
    return F.substring_index(_col(path), "/", -1)


def stem(name: Column | str) -> Column:
    """Name without its final extension."""
    return F.regexp_replace(_col(name), r"\.[^./]*$", "")


def preview(c: Column | str, length: int = 50) -> Column:
    """The first characters of a text, for reports."""
    return F.substring(_col(c), 1, length)


def truncate(c: Column | str, max_chars: int | None) -> Column:
    """The first ``max_chars`` code points; ``None`` keeps the whole text.

    Only for models with a fixed input window; everything else reads whole texts.
    """
    return _col(c) if max_chars is None else F.substring(_col(c), 1, max_chars)


def display_name(c: Column | str) -> Column:
    """``sound_loudness`` -> ``Sound Loudness``."""
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(r"[^ \t\n\r]+"))


def line_count(c: Column | str) -> Column:
    return F.length(_col(c)) - F.length(F.replace(_col(c), F.lit("\n"), F.lit(""))) + 1


def letter_count(c: Column | str) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(_col(c), r"[ \t\n\r]+", ""))


def upper_count(c: Column | str) -> Column:
    """ASCII capitals."""
    return F.regexp_count(_col(c), F.lit("[A-Z]"))
