"""Title, identifier and percent-encoding expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegraph.functions import fixed


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` alone removes blanks only)."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def page_title(text: Column) -> Column:
    """Stripped title without leading colons, blanks as underscores; '' for null or blank."""
    return F.coalesce(F.replace(F.ltrim(strip(text), F.lit(":")), F.lit(" "), F.lit("_")), F.lit(""))


def bytes_title(raw: Column) -> Column:
    """Title stored as bytes: invalid UTF-8 becomes the replacement character."""
    return page_title(F.make_valid_utf8(raw.cast("string")))


def qid(text: Column) -> Column:
    """First item id found anywhere in the text, with an upper-case Q, else null."""
    digits = F.nullif(F.regexp_extract(text, fixed.QID_PATTERN, 1), F.lit(""))
    return F.concat(F.lit("Q"), digits)


def quote(text: Column, safe: str = fixed.SAFE_PATH) -> Column:
    """Percent-encode UTF-8 text, leaving unreserved and ``safe`` characters alone."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for char in "*~" + safe:
        code = F.lit("%{:02X}".format(ord(char)))
        if char == "*":
            out = F.replace(out, F.lit("*"), code)
        elif char not in "_-.":
            out = F.replace(out, code, F.lit(char))
    return out


def unquote(text: Column) -> Column:
    """Percent-decode; a plus sign stays a plus sign, a broken escape gives the text back."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def casefold(text: Column) -> Column:
    """Caseless key: lower case with sharp s written out."""
    return F.lower(F.replace(F.replace(text, F.lit("ẞ"), F.lit("ss")), F.lit("ß"), F.lit("ss")))


def user_name(text: Column) -> Column:
    """User name with blanks for underscores; null when blank."""
    return F.nullif(F.replace(strip(text), F.lit("_"), F.lit(" ")), F.lit(""))


def before_slash(text: Column) -> Column:
    return F.substring_index(text, "/", 1)


def after_first(text: Column, mark: str) -> Column:
    """Text after the first ``mark``; null when there is none."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def before_first(text: Column, mark: str) -> Column:
    at = F.locate(mark, text)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1))


def db_title(title: Column, namespace: Column) -> Column:
    """Title as stored in the page table: outside namespace 0 the first prefix is cut."""
    rest = after_first(title, ":")
    return F.when((namespace != 0) & rest.isNotNull(), rest).otherwise(title)


def without_prefix(title: Column, prefix: Column) -> Column:
    """Cut ``prefix:`` from a title when something is left after it."""
    marked = F.concat(prefix, F.lit(":"))
    rest = page_title(F.substring(title, F.length(marked) + 1, F.length(title)))
    hit = (prefix != "") & F.startswith(title, marked) & (rest != "")
    return F.when(F.coalesce(hit, F.lit(False)), rest).otherwise(title)


def integer(text: Column) -> Column:
    """Whole number or null; digit groups joined by single underscores are accepted."""
    clean = strip(text)
    shape = clean.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$")
    return F.when(shape, F.replace(clean, F.lit("_"), F.lit("")).try_cast("bigint"))


def map_value(table: dict[str, str], key: Column) -> Column:
    """Look a key up in a small fixed table; null when absent."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def present(value: Column) -> Column:
    """Generator that keeps the row with ``value`` computed once, and drops it when null."""
    return F.explode(F.array_compact(F.array(value)))


def named(**columns: Column) -> Column:
    """Struct with given field names (safe inside lambda functions)."""
    return F.named_struct(*[part for name, column in columns.items() for part in (F.lit(name), column)])


def signed_zeros(json: Column) -> Column:
    """JSON text whose decimal zeros keep their minus sign when parsed to VARIANT.

    A number without exponent becomes a decimal there, which has no negative zero; one with an exponent
    stays a double. Text inside strings is left alone.
    """
    pieces = F.regexp_extract_all(json, F.lit(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++|"'), F.lit(0))
    marked = F.transform(
        pieces,
        lambda piece: F.when(F.startswith(piece, F.lit('"')), piece).otherwise(
            F.regexp_replace(piece, r"(?<![0-9.eE+-])-0\.0++(?![0-9.eE+-])", "-0.0e0")
        ),
    )
    return F.when(json.rlike(r"-0\.0++(?![0-9eE])"), F.array_join(marked, "")).otherwise(json)


def python_double(number: Column) -> Column:
    """Shortest decimal text of a double: plain from 1e-4 up to 1e16, else with exponent."""
    java = number.cast("double").cast("string")
    return F.when(java.rlike(r"^-?[0-9.]+$"), java).otherwise(let(_shortest(number.cast("double")), _rewritten))


def _rewritten(java: Column) -> Column:
    """Python's text for Java's exponent form and for values that are not finite."""
    sign = F.when(F.startswith(java, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    body = F.ltrim(java, F.lit("-"))
    mantissa = F.regexp_replace(F.substring_index(body, "E", 1), r"\.0$", "")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    exponent = F.substring_index(body, "E", -1).try_cast("int")
    whole = F.substring(F.rpad(digits, F.greatest(exponent + 1, F.length(digits)), F.lit("0")), F.lit(1), exponent + 1)
    rest = F.substring(digits, exponent + 2, F.length(digits))
    plain = F.concat(whole, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
    size = F.abs(exponent).cast("string")
    power = F.concat(
        mantissa,
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0")),
    )
    return (
        F.when(java == "NaN", F.lit("nan"))
        .when(F.endswith(java, F.lit("Infinity")), F.concat(sign, F.lit("inf")))
        .when((exponent >= 7) & (exponent < 16), F.concat(sign, plain))
        .when(exponent == -4, F.concat(sign, F.lit("0.000"), digits))
        .otherwise(F.concat(sign, power))
    )


def _shortest(number: Column) -> Column:
    """Java's text of a double; a long mantissa is cut where fewer digits read back the same."""
    java = number.cast("string")
    long = F.contains(java, F.lit("E")) & (F.length(F.substring_index(java, "E", 1)) >= 17)
    out = java
    for places in (15, 14):
        short = F.format_string("%.{}e".format(places), number)
        mantissa = F.regexp_replace(F.regexp_replace(F.substring_index(short, "e", 1), "0+$", ""), r"\.$", ".0")
        exponent = F.substring_index(short, "e", -1).try_cast("int").cast("string")
        text = F.concat(mantissa, F.lit("E"), exponent)
        out = F.when(long & (text.try_cast("double") == number), text).otherwise(out)
    return out
