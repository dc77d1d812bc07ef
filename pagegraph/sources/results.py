"""SQL-result payloads (headers plus rows) and values scraped from saved query pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import fixed
from pagegraph.functions.text import blank_to_null, integer, let, named, page_title, signed_zeros, strip
from pagegraph.functions.wiki import article_url
from pagegraph.sources import large


def clean_header(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(text), "[^A-Za-z0-9_]", "_"), "_+", "_")


def unique_headers(names: Column) -> Column:
    """Cleaned column names of one header list, made unique.

    The n-th repeat gets ``_n`` (``n`` after a trailing underscore), raised while it is taken.
    """
    base = F.transform(
        names,
        lambda raw, i: F.coalesce(
            F.nullif(clean_header(F.coalesce(raw, F.lit("None"))), F.lit("")),
            F.concat(F.lit("column_"), (i + 1).cast("string")),
        ),
    )
    return let(base, lambda b: F.when(F.size(F.array_distinct(b)) == F.size(b), b).otherwise(_numbered(b)))


def _numbered(base: Column) -> Column:
    counted = F.transform(
        base,
        lambda name, i: named(name=name, n=F.size(F.filter(F.slice(base, F.lit(1), i + 1), lambda x: x == name))),
    )

    def option(name: Column, n: Column) -> Column:
        tail = F.when(F.endswith(name, F.lit("_")), n.cast("string")).otherwise(F.concat(F.lit("_"), n.cast("string")))
        return F.when(n == 1, name).otherwise(F.concat(name, tail))

    def step(taken: Column, item: Column) -> Column:
        plain = option(item["name"], item["n"])
        options = F.transform(F.sequence(item["n"], item["n"] + F.size(taken)), lambda n: option(item["name"], n))
        free = F.get(F.filter(options, lambda name: ~F.array_contains(taken, name)), 0)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, plain), free).otherwise(plain)))

    return F.aggregate(counted, F.array().cast("array<string>"), step)


def _slots(names: Column, cells: Column) -> Column:
    """Pair names and cells: short rows are padded with null, extra cells get a column name."""
    spare = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(cells), F.lit(1))), lambda i: F.concat(F.lit("column_"), i.cast("string"))
    )
    full = F.when(F.size(cells) > F.size(names), F.concat(names, F.slice(spare, F.size(names) + 1, F.size(cells)))).otherwise(names)
    return F.zip_with(full, cells, lambda k, x: named(key=k, value=x))


def _members(text: Column, v: Column) -> Column:
    """Entries of an object row in document order, under unique names."""
    keys = F.json_object_keys(text)
    values = let(v.try_cast("map<string,variant>"), lambda m: F.transform(keys, lambda k: F.try_element_at(m, k)))
    return F.zip_with(unique_headers(keys), values, lambda k, x: named(key=k, value=x))


def result_rows(
    payloads: DataFrame, keys: list[str], json_column: str, limit: int | None = None, whole: int | None = large.WHOLE, size: int = large.RANGE
) -> DataFrame:
    """(keys, position, fields, row_error): fields is array<struct<key, value VARIANT>> in order.

    Array rows use the header list, object rows their own keys; a scalar row is flagged. Payloads of more
    than ``whole`` bytes are cut in ranges of ``size`` bytes by as many tasks.
    """
    small, long = large.halves(payloads, json_column, whole)
    parsed = small.select(
        *keys,
        F.from_json(F.col(json_column), _RESULT).alias("_raw"),
        F.try_variant_get(F.try_parse_json(signed_zeros(F.col(json_column))), "$.rows", "array<variant>").alias("_v"),
    )
    rows = _paired("_v", "_raw.rows", limit)
    base = parsed.select(
        *keys,
        unique_headers(F.col("_raw.headers")).alias("_names"),
        F.posexplode_outer(F.when(F.size("_raw.headers") > 0, rows)).alias("position", "_row"),
    ).where(F.col("position").isNotNull())
    found = _fields(base, keys)
    return found if long is None else found.union(_fields(_large_rows(long, keys, json_column, limit, size), keys))


_RESULT = "struct<headers:array<string>,rows:array<string>>"


def _paired(values: str, texts: str, limit: int | None) -> Column:
    rows = F.zip_with(values, texts, lambda v, t: named(v=v, text=t))
    return rows if limit is None else F.slice(rows, 1, limit)


def _large_rows(payloads: DataFrame, keys: list[str], json_column: str, limit: int | None, size: int) -> DataFrame:
    """Header names and single rows of payloads that are cut: ``keys, _names, position, _row``."""
    cut = large.shred(payloads, keys, json_column, size)
    top = large.root_members(cut)
    both = F.from_json(F.col("text"), _RESULT)
    inner = top.where("child is null").select("doc", both["headers"].alias("headers"), both["rows"].alias("texts"), F.try_variant_get("v", "$.rows", "array<variant>").alias("values"))
    lists = cut.containers.where("kind = '['")
    one = F.get(F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>"), 0)
    headers = large.whole_elements(cut, lists.where(F.col("names") == F.array(F.lit("headers"))))
    headers = headers.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", one.alias("name")))).alias("_h")).select("doc", F.col("_h.name").alias("headers"))
    headers = headers.union(inner.where("headers is not null").select("doc", "headers")).where(F.size("headers") > 0)
    names = headers.select("doc", unique_headers(F.col("headers")).alias("_names"))
    rows = large.numbered_rows(large.whole_elements(cut, lists.where(F.col("names") == F.array(F.lit("rows")))), "doc", "at")
    rows = rows.select("doc", "position", named(v=F.col("v"), text=F.col("text")).alias("_row"))
    if limit is not None:
        rows = rows.where(F.col("position") < limit)
    few = inner.where("texts is not null").select("doc", F.posexplode(_paired("values", "texts", limit)).alias("position", "_row"))
    rows = large.spread_join(rows.union(few.select("doc", F.col("position").cast("long"), "_row")), names, ["doc"], "position")
    return large.restore_keys(rows, cut, "position", "_names", F.col("position").cast("int").alias("position"), "_row")


def _fields(base: DataFrame, keys: list[str]) -> DataFrame:
    v = F.col("_row.v")
    shape = F.schema_of_variant(v)
    of_object = _members(F.col("_row.text"), v)
    of_list = let(v.try_cast("array<variant>"), lambda cells: _slots(F.col("_names"), cells))
    is_list = F.startswith(shape, F.lit("ARRAY"))
    is_map = F.startswith(shape, F.lit("OBJECT"))
    return base.select(
        *keys,
        F.col("position").cast("bigint").alias("position"),
        F.when(is_list, of_list).when(is_map, of_object).alias("fields"),
        (~(is_list | is_map)).alias("row_error"),
    )


def record(fields: Column) -> Column:
    """The row as one VARIANT object."""
    return F.to_variant_object(F.map_from_entries(fields))


def with_page_uris(rows: DataFrame, siteinfo: DataFrame, namespaces: DataFrame) -> DataFrame:
    """``fields`` with an address for every title field present; one that is there is never touched.

    Rows need ``domain`` and ``fields``. ``siteinfo(domain, article_path)`` and the namespaces of a
    domain, as one map, are looked up once per row, whatever the number of title fields.
    """
    spaces = namespaces.groupBy("domain", F.col("ns_id").cast("bigint").alias("ns_id")).agg(F.min("name").alias("name"))
    names = spaces.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("ns_id", "name"))).alias("_names"))
    dims = siteinfo.select("domain", "article_path").join(names, "domain", "left")
    origin = F.concat(F.lit("https://"), F.col("domain"))

    spaced = [(p + "_title", p + "_uri", p + "_namespace", 0) for p in fixed.TITLE_PREFIXES]
    files = [(title, uri, None, fixed.FILE_NAMESPACE) for title, uri in fixed.FILE_TITLE_COLUMNS.items()]
    categories = [(title, uri, None, fixed.CATEGORY_NAMESPACE) for title, uri in fixed.CATEGORY_TITLE_COLUMNS.items()]
    specs = F.array(
        *[
            named(title=F.lit(t), uri=F.lit(u), space=F.lit(s).cast("string"), number=F.lit(n).cast("bigint"))
            for t, u, s, n in spaced + files + categories
        ]
    )

    def extended(fields: Column) -> Column:
        cell = lambda key: F.get(F.filter(fields, lambda f: f["key"] == key), 0)["value"].try_cast("string")

        def address(spec: Column) -> Column:
            clean = page_title(cell(spec["title"]))
            number = F.coalesce(integer(cell(spec["space"])).cast("bigint"), spec["number"])
            name = strip(F.coalesce(F.try_element_at(F.col("_names"), number), F.lit("")))
            full = F.when(name != "", F.concat(name, F.lit(":"), clean)).otherwise(clean)
            url = F.when(F.col("article_path").isNotNull() & (clean != ""), article_url(origin, F.col("article_path"), full))
            return named(key=spec["uri"], value=url.cast("variant"))

        def wanted(keys: Column) -> Column:
            return F.filter(specs, lambda spec: F.array_contains(keys, spec["title"]) & ~F.array_contains(keys, spec["uri"]))

        found = F.transform(let(F.transform(fields, lambda f: f["key"]), wanted), address)
        return F.concat(fields, F.filter(found, lambda f: f["value"].isNotNull()))

    joined = rows.join(dims, "domain", "left")
    return joined.withColumn("fields", let(F.col("fields"), extended)).select(*rows.columns)


def result_records(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, record VARIANT) of rows with ``fields``; the generator keeps the object from being built per use."""
    # the filter stands behind the generator, since one before it would build the fields a second time
    return rows.select(*keys, F.explode_outer(F.array(record(F.col("fields")))).alias("record")).where(F.col("record").isNotNull())


def run_id(html: Column) -> Column:
    """Run id in the page's ``var vars = {…}`` block, else anywhere in the text; positive or null."""
    block = F.nullif(F.regexp_extract(html, fixed.RUN_VARS_PATTERN, 1), F.lit(""))
    number = F.regexp_extract(F.coalesce(block, html), fixed.RUN_ID_PATTERN, 1).try_cast("bigint")
    return F.when(number > 0, number)


def unescape(text: Column) -> Column:
    """Undo the entities that attribute values are written with."""
    out = text
    for code, char in (
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#34;", '"'),
        ("&#39;", "'"),
        ("&#x27;", "'"),
        ("&apos;", "'"),
        ("&amp;", "&"),
    ):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def input_value(html: Column, id_pattern: str = fixed.INPUT_ID_PATTERN) -> Column:
    """Unescaped ``value`` of the first input tag whose id matches; null when blank or absent."""
    tags = F.regexp_extract_all(html, F.lit(fixed.INPUT_TAG_PATTERN), F.lit(0))
    tag = F.get(F.filter(tags, lambda t: t.rlike(id_pattern)), 0)
    return blank_to_null(unescape(F.regexp_extract(tag, fixed.INPUT_VALUE_PATTERN, 2)))


def first_match(html: Column, pattern: str, group: int = 1) -> Column:
    """First match of any other pattern, with the same extract-or-null rule."""
    return F.nullif(F.regexp_extract(html, pattern, group), F.lit(""))
