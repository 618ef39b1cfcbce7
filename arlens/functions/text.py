"""Scalar text expressions (S1-S16, C3, E11), all native Spark SQL.

Regular expressions run in the JVM (``rlike`` / ``regexp_*``), so these stay
inside whole-stage codegen; no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number syntax accepted by the reference's float() test
# (ASCII forms only: digits with optional point, optional exponent, nan, inf,
# infinity; surrounding blanks allowed), and the character sets stripped
# before the test.
NUMBER_RE = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)\s*$"
INTEGER_RE = r"^\s*[+-]?\d+\s*$"
TABLE_NUMBER_STRIP = r"[, $()%]"  # S1: , space $ ( ) %
ROW_NUMBER_STRIP = r"[, ]"  # S2: , and space
# What comes first in a number, blanks and stripped characters aside: texts that
# begin otherwise, most prose, need no stripping.
NUMBER_START = r"^[\s, $()%]*[-+.0-9nNiI]"
# Private-use code points (E11): BMP area and planes 15 and 16.
PRIVATE_USE_RE = "[\\x{E000}-\\x{F8FF}\\x{F0000}-\\x{FFFFD}\\x{100000}-\\x{10FFFD}]"


def is_float_text(c: Column) -> Column:
    """True when Python's float() would accept the text (null -> false)."""
    return F.coalesce(c.rlike(NUMBER_RE), F.lit(False))


def to_number(c: Column) -> Column:
    """Text -> double, anything unparsable -> null, NaN -> null."""
    v = F.when(is_float_text(c), F.trim(c).try_cast("double"))
    return F.when(~F.isnan(v), v)


def is_number_table(c: Column) -> Column:
    """Numeric test of a table cell after removing , space $ ( ) %."""
    return F.when(c.rlike(NUMBER_START), is_float_text(F.regexp_replace(c, TABLE_NUMBER_STRIP, ""))).otherwise(False)


def is_number_row(c: Column) -> Column:
    """Numeric test of a row cell after removing , and space."""
    return F.when(c.rlike(NUMBER_START), is_float_text(F.regexp_replace(c, ROW_NUMBER_STRIP, ""))).otherwise(False)


def not_int(c: Column) -> Column:
    """S3: true unless the text is an integer (page numbers are ignored)."""
    return ~F.coalesce(c.rlike(INTEGER_RE), F.lit(False))


def font_key(font: Column, size: Column, color: Column) -> Column:
    """``font:size:color`` with the size printed as Python prints a float."""
    return F.concat_ws(":", font, py_float_str(size), color.cast("string"))


def py_float_str(x: Column) -> Column:
    """Python ``str(float)`` for the values span sizes take (finite, moderate):
    integral values keep one decimal ('10.0'), others print as Spark does."""
    return F.when(x == F.floor(x), F.concat(F.floor(x).cast("bigint").cast("string"), F.lit(".0"))).otherwise(
        x.cast("string")
    )


def cell_text(c: Column) -> Column:
    """Tabs and newlines removed from a cell."""
    return F.translate(c, "\t\n", "")


def styled(text: Column, font: Column) -> Column:
    """``<b>`` when the font name contains Bold, then ``<i>`` outside when Italic."""
    b = F.when(font.contains("Bold"), F.concat(F.lit("<b>"), text, F.lit("</b>"))).otherwise(text)
    return F.when(font.contains("Italic"), F.concat(F.lit("<i>"), b, F.lit("</i>"))).otherwise(b)


# Continuation marks, removed in this order.
CONTINUED = [" cont", " continued", " forts.", " fortsettelse"]


def heading_key(text: Column) -> Column:
    """Lower, trim, then remove ' cont', ' continued', ' forts.', ' fortsettelse'
    in that order (Z9 kept: ' continued' has already lost ' cont')."""
    k = py_strip(F.lower(text))
    for s in CONTINUED:
        k = F.replace(k, F.lit(s), F.lit(""))
    return k


def clean_newlines(c: Column) -> Column:
    """CR+LF runs -> LF (fixpoint of replacing CRLF), then 3+ LF -> 2 LF."""
    return F.regexp_replace(F.regexp_replace(c, "\r+\n", "\n"), "\n{3,}", "\n\n")


def section_title(html: Column) -> Column:
    """S11 (Z11 fixed): the inner text of the first <h1>..</h1>."""
    return F.regexp_extract(html, "(?s)<h1>(.*?)</h1>", 1)


def ledger_text(c: Column) -> Column:
    """Value as the ledger writes it: str(), None for null, LF -> CR.  A text
    that reads ``None`` gets a backslash, so that it is not taken for a null."""
    text = F.regexp_replace(c.cast("string"), r"^(\\*None)$", r"\\$1")
    return F.replace(F.coalesce(text, F.lit("None")), F.lit("\n"), F.lit("\r"))


def page_title(path: Column) -> Column:
    """Last backslash component of a path."""
    return F.element_at(F.split(path, r"\\"), -1)


def private_use_count(text: Column) -> Column:
    """E11 numerator: code points in the private-use areas (length counts code
    points).  These are removed and not the others, as most texts have none; a
    text of one byte a code point has none for sure and is not searched."""
    n = F.length(text) - F.length(F.regexp_replace(text, f"{PRIVATE_USE_RE}+", ""))
    return F.when(F.octet_length(text) == F.length(text), 0).otherwise(n)


# Fixed value: the characters Python's str.strip() removes (str.isspace()).
PY_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: leading and trailing Unicode whitespace removed."""
    return F.btrim(c, F.lit(PY_SPACE))
