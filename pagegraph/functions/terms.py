"""Graph terms: struct<kind, value, datatype, lang>, their text forms and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegraph.functions import fixed
from pagegraph.functions.text import python_double

# --- fixed values: profile type name of each kind and the datatype it is stored with ---
DATATYPE_OF_KIND = {
    "xsd:integer": fixed.XSD_INTEGER,
    "xsd:double": fixed.XSD_DOUBLE,
    "xsd:boolean": fixed.XSD_BOOLEAN,
    "xsd:dateTime": fixed.XSD_DATE_TIME,
}
NUMERIC_DATATYPES = [fixed.XSD_INTEGER, fixed.XSD_DOUBLE, fixed.XSD + "decimal"]


def term(kind: Column | str, value: Column, datatype: Column | None = None, lang: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        value.alias("value"),
        (null if datatype is None else datatype).alias("datatype"),
        (null if lang is None else lang).alias("lang"),
    )


def iri(value: Column | str) -> Column:
    return term("iri", F.lit(value) if isinstance(value, str) else value)


def literal(value: Column | str, datatype: str | None = None, lang: str | None = None) -> Column:
    return term(
        "literal",
        F.lit(value) if isinstance(value, str) else value,
        F.lit(datatype).cast("string"),
        F.lit(lang).cast("string"),
    )


def datatype_of(kind: Column) -> Column:
    """Datatype IRI of a profile type name; null for plain strings and IRIs."""
    out = F.lit(None).cast("string")
    for name, datatype in DATATYPE_OF_KIND.items():
        out = F.when(kind == name, F.lit(datatype)).otherwise(out)
    return out


def escaped(value: Column) -> Column:
    out = value
    for raw, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"')):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def ntriples_term(t: Column) -> Column:
    """``<iri>``, ``_:b`` or a quoted literal with language tag or datatype."""
    value = t["value"]
    text = F.concat(F.lit('"'), escaped(value), F.lit('"'))
    named = F.when(F.startswith(value, F.lit("_:")), value).otherwise(F.concat(F.lit("_:"), value))
    return (
        F.when(t["kind"] == "iri", F.concat(F.lit("<"), value, F.lit(">")))
        .when(t["kind"] == "bnode", named)
        .when(t["lang"].isNotNull(), F.concat(text, F.lit("@"), t["lang"]))
        .when(t["datatype"].isNotNull(), F.concat(text, F.lit("^^<"), t["datatype"], F.lit(">")))
        .otherwise(text)
    )


def json_term(t: Column) -> Column:
    """Struct of one JSON binding; absent parts are null and vanish in ``to_json``."""
    kind = F.when(t["kind"] == "iri", F.lit("uri")).otherwise(t["kind"])
    value = F.when(t["kind"] == "bnode", F.regexp_replace(t["value"], "^_:", "")).otherwise(t["value"])
    is_literal = t["kind"] == "literal"
    plain = t["lang"].isNotNull() | (t["datatype"] == fixed.XSD_STRING)
    binding = F.struct(
        kind.alias("type"),
        value.alias("value"),
        F.when(is_literal, t["lang"]).alias("xml:lang"),
        F.when(is_literal & ~F.coalesce(plain, F.lit(False)), t["datatype"]).alias("datatype"),
    )
    return F.when(t.isNotNull(), binding)


# Scalar functions over terms. A type error is an unbound (null) result.


def str_(t: Column) -> Column:
    return t["value"]


def lang(t: Column) -> Column:
    return F.when(t["kind"] == "literal", F.coalesce(t["lang"], F.lit("")))


def datatype(t: Column) -> Column:
    tagged = F.when(t["lang"].isNotNull(), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"))
    return F.when(t["kind"] == "literal", F.coalesce(tagged, t["datatype"], F.lit(fixed.XSD_STRING)))


def is_iri(t: Column) -> Column:
    return t["kind"] == "iri"


def is_literal(t: Column) -> Column:
    return t["kind"] == "literal"


def is_blank(t: Column) -> Column:
    return t["kind"] == "bnode"


def is_numeric(t: Column) -> Column:
    return F.coalesce(is_literal(t) & t["datatype"].isin(*NUMERIC_DATATYPES), F.lit(False))


#: numeric types by how much they hold
INTEGER, DECIMAL, DOUBLE = 0, 1, 2


def numeric_width(t: Column) -> Column:
    """Place of a number literal's type among the numeric types; null for all that is no number."""
    kind = F.when(t["datatype"] == fixed.XSD_INTEGER, F.when(t["value"].try_cast("decimal(38,0)").isNotNull(), INTEGER))
    kind = kind.when(t["datatype"] == fixed.XSD + "decimal", F.when(t["value"].try_cast("decimal(38,18)").isNotNull(), DECIMAL))
    kind = kind.when(t["datatype"] == fixed.XSD_DOUBLE, F.when(t["value"].try_cast("double").isNotNull(), DOUBLE))
    return F.when(is_literal(t), kind)


def decimal_text(value: Column) -> Column:
    """Decimal without zeros that say nothing: ``2.50`` is ``2.5``, ``2.0`` is ``2``."""
    plain = value.cast("decimal(38,18)").cast("string")
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def number_term(error: Column, width: Column, whole: Column, exact: Column, inexact: Column) -> Column:
    """Number literal of the type ``width`` says; null on error or where the value does not fit."""
    integer = F.when(whole.isNotNull(), term("literal", whole.cast("string"), F.lit(fixed.XSD_INTEGER)))
    decimal = F.when(exact.isNotNull(), term("literal", decimal_text(exact), F.lit(fixed.XSD + "decimal")))
    double = term("literal", python_double(inexact), F.lit(fixed.XSD_DOUBLE))
    return F.when(~error, F.when(width == INTEGER, integer).when(width == DECIMAL, decimal).otherwise(double))


def concat(*parts: Column) -> Column:
    """CONCAT: a common language or the plain string type is kept; unbound parts and addresses are errors."""
    text = parts[0]["value"]
    good, tag = is_literal(parts[0]), parts[0]["lang"]
    for part in parts[1:]:
        text = F.concat(text, part["value"])
        good = good & is_literal(part)
        tag = F.when(tag.eqNullSafe(part["lang"]), tag)
    return F.when(F.coalesce(good, F.lit(False)), term("literal", text, None, tag))


def if_(condition: Column, then: Column, otherwise: Column) -> Column:
    """IF: an error in the condition is an error of the whole."""
    return F.when(condition, then).when(~condition, otherwise)


def coalesce(*options: Column) -> Column:
    """COALESCE: the first that is bound and no error."""
    return F.coalesce(*options)


def to_iri(t: Column) -> Column:
    """IRI of an address or a plain string; relative ones are not resolved, blanks and brackets are errors."""
    plain = is_iri(t) | (is_literal(t) & t["lang"].isNull() & F.coalesce(t["datatype"] == fixed.XSD_STRING, F.lit(True)))
    return F.when(F.coalesce(plain, F.lit(False)) & ~t["value"].rlike(r'[\x00-\x20<>"{}|^`\\]'), iri(t["value"]))


def strdt(t: Column, datatype_iri: str) -> Column:
    """Literal of a plain string's text with a datatype."""
    return F.when(_plain(t), term("literal", t["value"], F.lit(datatype_iri)))


def strlang(t: Column, tag: str) -> Column:
    """Literal of a plain string's text with a language."""
    return F.when(_plain(t), term("literal", t["value"], None, F.lit(tag.lower())))


def _plain(t: Column) -> Column:
    typed = F.coalesce(t["datatype"], F.lit(fixed.XSD_STRING)) != fixed.XSD_STRING
    return F.coalesce(is_literal(t) & t["lang"].isNull() & ~typed, F.lit(False))


def _offset(t: Column) -> Column:
    """Zone part of a dateTime's text, '' without one; null for other terms."""
    return F.when(moment(t).isNotNull(), F.regexp_extract(t["value"], r"(Z|[+-]\d{2}:\d{2})$", 1))


def tz(t: Column) -> Column:
    """TZ: the zone as plain text, empty without one."""
    return F.when(_offset(t).isNotNull(), term("literal", _offset(t)))


def timezone(t: Column) -> Column:
    """TIMEZONE: the zone as a day-time duration; an error without one."""
    zone = _offset(t)
    hours_, minutes_ = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    sign = F.when(F.startswith(zone, F.lit("-")), "-").otherwise("")
    part = lambda n, letter: F.when(n > 0, F.concat(n.cast("string"), F.lit(letter))).otherwise("")
    text = F.concat(sign, F.lit("PT"), part(hours_, "H"), part(minutes_, "M"))
    zero = (zone == "Z") | ((hours_ == 0) & (minutes_ == 0))
    return F.when(zone != "", term("literal", F.when(zero, "PT0S").otherwise(text), F.lit(fixed.XSD + "dayTimeDuration")))


def bound(t: Column) -> Column:
    return t.isNotNull()


def number(t: Column) -> Column:
    """Numeric value of a number literal, else null."""
    return F.when(is_numeric(t), t["value"].try_cast("double"))


def whole(t: Column) -> Column:
    """Exact value of an integer literal of up to 38 digits, else null."""
    return F.when(t["datatype"] == fixed.XSD_INTEGER, t["value"].try_cast("decimal(38,0)"))


def moment(t: Column) -> Column:
    """Zone-free UTC timestamp of a dateTime literal, else null."""
    text = t["value"]
    micros = F.unix_micros(text.try_cast("timestamp")).cast("decimal(24,0)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    zoned = epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1000000).cast("decimal(18,6)"))
    plain = text.try_cast("timestamp_ntz")
    at = F.when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), zoned).otherwise(plain)
    return F.when(t["datatype"] == fixed.XSD_DATE_TIME, at)


def year(t: Column) -> Column:
    return F.year(moment(t))


def month(t: Column) -> Column:
    return F.month(moment(t))


def day(t: Column) -> Column:
    return F.dayofmonth(moment(t))


def hours(t: Column) -> Column:
    return F.hour(moment(t))


def minutes(t: Column) -> Column:
    return F.minute(moment(t))


def seconds(t: Column) -> Column:
    return F.second(moment(t))


def strstarts(t: Column, prefix: str) -> Column:
    return F.startswith(t["value"], F.lit(prefix))


def strends(t: Column, suffix: str) -> Column:
    return F.endswith(t["value"], F.lit(suffix))


def contains(t: Column, part: str) -> Column:
    return F.contains(t["value"], F.lit(part))


def strlen(t: Column) -> Column:
    return F.length(t["value"])


def substr(t: Column, start: int, length: int | None = None) -> Column:
    size = F.length(t["value"]) if length is None else F.lit(length)
    return F.substring(t["value"], F.lit(start), size)


def ucase(t: Column) -> Column:
    return F.upper(t["value"])


def lcase(t: Column) -> Column:
    return F.lower(t["value"])


def strbefore(t: Column, mark: str) -> Column:
    at = F.locate(mark, t["value"])
    return F.when(at > 0, F.substring(t["value"], F.lit(1), at - 1)).otherwise(F.lit(""))


def strafter(t: Column, mark: str) -> Column:
    at = F.locate(mark, t["value"])
    return F.when(at > 0, F.substring(t["value"], at + len(mark), F.length(t["value"]))).otherwise(F.lit(""))


def encode_for_uri(t: Column) -> Column:
    from pagegraph.functions.text import quote

    return quote(t["value"], fixed.SAFE_NONE)


def regex(t: Column, pattern: str, flags: str = "") -> Column:
    return t["value"].rlike("(?{}){}".format(flags, pattern) if flags else pattern)


def replace(t: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(t["value"], pattern, replacement)


def md5(t: Column) -> Column:
    return F.md5(t["value"])


def sha1(t: Column) -> Column:
    return F.sha1(t["value"])


def sha256(t: Column) -> Column:
    return F.sha2(t["value"], 256)


def sha384(t: Column) -> Column:
    return F.sha2(t["value"], 384)


def sha512(t: Column) -> Column:
    return F.sha2(t["value"], 512)


def abs_(t: Column) -> Column:
    return F.abs(number(t))


def ceil(t: Column) -> Column:
    return F.ceil(number(t))


def floor(t: Column) -> Column:
    return F.floor(number(t))


def round_(t: Column) -> Column:
    """Half rounds up, also below zero."""
    return F.floor(number(t) + F.lit(0.5))


def same_term(a: Column, b: Column) -> Column:
    return a == b


def lang_matches(t: Column, wanted: str) -> Column:
    tag = F.lower(F.coalesce(t["lang"], F.lit("")))
    if wanted == "*":
        return tag != ""
    return (tag == wanted.lower()) | F.startswith(tag, F.lit(wanted.lower() + "-"))


def value_equal(a: Column, b: Column) -> Column:
    """FILTER equality: numbers by value, times by moment, everything else by term."""
    return (
        F.when(whole(a).isNotNull() & whole(b).isNotNull(), whole(a) == whole(b))
        .when(is_numeric(a) & is_numeric(b), number(a) == number(b))
        .when(moment(a).isNotNull() & moment(b).isNotNull(), moment(a) == moment(b))
        .otherwise(a == b)
    )


def order_key(t: Column) -> Column:
    """Sortable key of a term: unbound, blank nodes, addresses, literals.

    Among literals numbers come first by value, then times by moment, then the others by text;
    spelling, datatype and language settle what is still equal.
    """
    rank = F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_iri(t), 2).otherwise(3)
    sort = F.when(number(t).isNotNull(), 0).when(moment(t).isNotNull(), 1).otherwise(2)
    return F.struct(
        rank.alias("rank"),
        F.when(rank == 3, sort).alias("sort"),
        number(t).alias("number"),
        whole(t).alias("whole"),
        moment(t).alias("moment"),
        t["value"].alias("value"),
        t["datatype"].alias("datatype"),
        t["lang"].alias("lang"),
    )
