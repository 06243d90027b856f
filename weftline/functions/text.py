"""Text columns: byte-exact truncation, blank lines, hashes, number formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .once import let

MAX_CONTENT = 5000
TRUNCATED = "\n\n... [truncated]"


def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_collapse(text: Column) -> Column:
    """At most one blank line in a row, trimmed."""
    return unicode_trim(F.regexp_replace(text, "\n{3,}", "\n\n"))


def truncated_bytes(text: Column, limit: int = MAX_CONTENT, mark: str = TRUNCATED) -> Column:
    """BINARY: the first ``limit`` bytes and a mark where the text is longer; a character may be cut."""
    data = F.encode(text, "UTF-8")
    return F.when(F.octet_length(text) > limit, F.concat(F.substring(data, 1, limit), F.encode(F.lit(mark), "UTF-8"))).otherwise(data)


def displayed(data: Column) -> Column:
    """Bytes as a string, with the replacement character where they aren't UTF-8."""
    return F.make_valid_utf8(data.cast("string"))


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def two_decimals(x: Column) -> Column:
    """Two decimals of the exact binary value, ties to even; null for null and NaN.

    Built-in formats round the shortest decimal form instead.  The value is split in two halves whose hundredfold is exact, and what
    they leave over the nearest hundredth decides.  From 1e13 on, where no such split is exact, the built-in format is used.
    """

    def cents(v: Column) -> Column:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        n = F.rint(v * 100.0)
        over = lambda half: (high * 100.0 - n - half) + (v - high) * 100.0  # noqa: E731  its sign is exact
        odd = F.pmod(n, F.lit(2.0)) == 1.0
        n = n + F.when((over(0.5) > 0) | ((over(0.5) == 0) & odd), 1.0).when((over(-0.5) < 0) | ((over(-0.5) == 0) & odd), -1.0).otherwise(0.0)
        whole = n.cast("long")
        return F.concat(F.floor(whole / 100).cast("string"), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))

    value = x.cast("double")
    sign = F.when((value < 0) | (F.concat(value.cast("string")) == "-0.0"), "-").otherwise("")
    shown = F.when(F.abs(value) < 1e13, F.concat(sign, let(F.abs(value), cents))).otherwise(F.printf(F.lit("%.2f"), value))
    return F.when(value.isNotNull() & ~F.isnan(value), shown)


def level_name(level: Column) -> Column:
    return F.when(level == 0, "readability").when(level == 1, "cdp").when(level == 2, "cdp_stealth").otherwise("unknown")


def quoted(text: Column) -> Column:
    """A double-quoted string with backslash escapes."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return F.concat(F.lit('"'), out, F.lit('"'))
