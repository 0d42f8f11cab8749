"""Text and number functions of the store, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the prompt normaliser counts it, which is more than a regex engine's ``\s``.
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_JSON_NUMBER = r"^\s*-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$"
_READS_AS_NUMBER = r"^\s*[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?\s*$"


def normalize_prompt(prompt: Column) -> Column:
    """Lower case, runs of white space as one blank, none outside. NULL stays NULL."""
    return F.trim(F.regexp_replace(F.lower(prompt), _BLANK, " "))


def text_as_number(text: Column) -> Column:
    """The double that a text reads as (digits, one sign, point, exponent, single underscores between digits); else NULL."""
    return F.when(text.rlike(_READS_AS_NUMBER), F.regexp_replace(F.trim(text), "_", "").try_cast("double"))


def json_as_number(value: Column) -> Column:
    """The double that a JSON text reads as: a number, or a string that holds one. Else, and for NULL, NULL."""
    return F.coalesce(F.when(value.rlike(_JSON_NUMBER), F.trim(value).try_cast("double")), text_as_number(F.regexp_extract(value, r'^\s*"(.*)"\s*$', 1)))


def number_text(x: Column) -> Column:
    """A double as a store prints it, in the fewest digits that tell it from others: plain decimals between 1e-4 and 1e16 with at least one place, else ``1.5e-07``; ``inf``, ``-inf`` and ``nan``; NULL stays NULL. Of texts of 16 or 17 digits that read as the same double it may not be the nearest one, as Java gives the digits."""
    x = x.cast("double")
    text = x.cast("string")  # of as many digits as Java gives, which older ones make too many
    for digits in (16, 15):
        fewer = F.format_string(f"%.{digits - 1}E", x)
        text = F.when(fewer.try_cast("double") == x, fewer).otherwise(text)
    plain = F.rtrim(text.try_cast("decimal(38,21)").cast("string"), F.lit("0"))  # 17 digits before the point, and all that a double has after it
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    plain = F.when(text.startswith("-") & ~plain.startswith("-"), F.concat(F.lit("-"), plain)).otherwise(plain)  # a negative zero
    power = F.substring_index(text, "E", -1)
    digits = F.ltrim(power, F.lit("+-0"))
    power = F.concat(F.when(power.startswith("-"), "-").otherwise("+"), F.when(F.length(digits) < 2, "0").otherwise(""), digits)
    far = F.concat(F.regexp_replace(F.substring_index(text, "E", 1), r"\.?0+$", ""), F.lit("e"), power)
    size = F.abs(x)
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(odd.isNotNull(), odd).when((x == 0) | ((size >= 1e-4) & (size < 1e16)), plain).when(x.isNotNull(), far)


def json_string(text: Column) -> Column:
    """A text as a JSON string literal, non-ASCII characters as they are; NULL for NULL."""
    wrapped = F.to_json(F.struct(text.alias("a")))
    return F.when(text.isNotNull(), F.substr(wrapped, F.lit(6), F.char_length(wrapped) - 6))


def base64_text(data: Column) -> Column:
    """Base64 of binary data on one line."""
    return F.regexp_replace(F.base64(data), "\r\n", "")


def reply_simple(text: Column) -> Column:
    """Wire reply: a status line."""
    return F.concat(F.lit("+"), text, F.lit("\r\n"))


def reply_error(text: Column) -> Column:
    """Wire reply: an error line."""
    return F.concat(F.lit("-"), text, F.lit("\r\n"))


def reply_integer(x: Column) -> Column:
    """Wire reply: a number, fractions cut off, in all its digits up to 1e28 (beyond, in those that Java gives); an error where it isn't finite, NULL for NULL."""
    x = x.cast("double")
    high = F.floor(F.abs(x) / 2.0**32).try_cast("long")  # exact, as both halves are
    low = (F.abs(x) - high.cast("double") * 2.0**32).try_cast("long")
    wide = F.concat(F.when(x < 0, "-").otherwise(""), (high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low.cast("decimal(10,0)")).cast("string"))
    whole = F.when(F.abs(x) < 9e18, x.try_cast("long").cast("string")).when(F.abs(x) < 1e28, wide).otherwise(F.format_string("%.0f", x))
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, reply_error(F.lit("ERR value is not an integer or out of range"))).when(x.isNotNull(), F.concat(F.lit(":"), whole, F.lit("\r\n")))


def reply_bulk(text: Column) -> Column:
    """Wire reply: a counted text, or nil for NULL."""
    return F.when(text.isNull(), F.lit("$-1\r\n")).otherwise(F.concat(F.lit("$"), F.octet_length(text).cast("string"), F.lit("\r\n"), text, F.lit("\r\n")))


def ttl_seconds(option: Column, amount: Column) -> Column:
    """Seconds from an expiry option: ``EX`` seconds, ``PX`` milliseconds; NULL for any other."""
    n = text_as_number(amount)
    return F.when(F.upper(option) == "EX", n).when(F.upper(option) == "PX", n / 1000)


def bearer_token(header: Column) -> Column:
    """Token of an ``Authorization: Bearer`` header; NULL if it is none."""
    return F.nullif(F.regexp_extract(header, r"(?is)^\s*bearer\s*? \s*(.*?)\s*$", 1), F.lit(""))


def basic_password(header: Column) -> Column:
    """Password of an ``Authorization: Basic`` header: what follows the first colon, or all of it; NULL if there is none."""
    raw = F.nullif(F.regexp_extract(header, r"(?is)^\s*basic\s*? \s*(.*?)\s*$", 1), F.lit(""))
    plain = F.try_to_binary(raw, F.lit("base64")).cast("string")
    return F.when(F.instr(plain, ":") > 0, F.regexp_extract(plain, r"(?s)^[^:]*:(.*)$", 1)).otherwise(F.nullif(plain, F.lit("")))


def role_rank(role: Column) -> Column:
    """Rank of a role: admin above writer above reader; 0 for any other and for NULL."""
    return F.when(role == "admin", 3).when(role == "writer", 2).when(role == "reader", 1).otherwise(0)
