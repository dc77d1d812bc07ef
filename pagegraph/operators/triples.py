"""Rows to typed triples: one expression builds a row's fields, one explode emits its triples."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegraph.functions import fixed
from pagegraph.functions.terms import datatype_of
from pagegraph.functions.text import blank_to_null, integer, let, named, python_double, qid, quote, strip
from pagegraph.functions.times import xsd_datetime
from pagegraph.operators.links import link_targets

GRAPH_COLUMNS = ["dataset_id", "s", "p", "o_kind", "o", "o_dt", "o_lang"]


@dataclass(frozen=True)
class Vocabulary:
    """Names a graph is written with. ``ontology`` and ``item_base`` are free to choose."""

    ontology: str = "https://pagegraph.example/ontology/"
    item_base: str = "https://pagegraph.example/list"
    row_base: str = "https://pagegraph.example/result"
    page_class: str = "Page"
    dataset: str = "dataset"
    position: str = "position"
    loaded_at: str = "loadedAt"

    def iri(self, name: str) -> str:
        return self.ontology + name


def field_name(key: Column) -> Column:
    """Predicate name of a field key."""
    renamed = F.when(key == "id", F.lit("page_id")).otherwise(key)
    clean = F.btrim(F.regexp_replace(renamed, "[^0-9A-Za-z_]+", "_"), F.lit("_"))
    clean = F.coalesce(F.nullif(clean, F.lit("")), F.lit("field"))
    clean = F.when(clean.rlike("^[0-9]"), F.concat(F.lit("field_"), clean)).otherwise(clean)
    # most keys are names already
    return F.when(renamed.rlike(r"^[A-Za-z]([0-9A-Za-z_]*[0-9A-Za-z])?\z"), renamed).otherwise(clean)


def field(key: Column | str, kind: Column | str, value: Column) -> Column:
    return named(
        key=F.lit(key) if isinstance(key, str) else key, kind=F.lit(kind) if isinstance(kind, str) else kind, value=value
    )


def emission(f: Column, repeated: Column, same_kind: Column) -> Column:
    """Field with two marks: the row has emitted this key before, and with the same kind."""
    return named(key=f["key"], kind=f["kind"], value=f["value"], repeated=repeated, same_kind=same_kind)


# --- access to a record, typed columns or VARIANT ---------------------------------------------


class TypedRecord:
    """Record whose keys are columns. A column that exists counts as a present key."""

    def __init__(self, schema: T.StructType, keys: Sequence[str]):
        self.types = {f.name: f.dataType for f in schema.fields if f.name in keys}

    def has(self, key: str) -> Column:
        return F.lit(key in self.types)

    def has_prefix(self, prefix: str) -> Column:
        return F.lit(any(key.startswith(prefix) for key in self.types))

    def text(self, key: str) -> Column:
        if key not in self.types or isinstance(self.types[key], (T.StructType, T.MapType)):
            return F.lit(None).cast("string")
        return F.col(key).cast("string")

    def meta(self, key: str) -> Column:
        kind = self.types.get("metadata")
        if isinstance(kind, T.StructType) and key in kind.names:
            return F.col("metadata")[key].cast("string")
        if isinstance(kind, T.MapType):
            return F.try_element_at(F.col("metadata"), F.lit(key)).cast("string")
        return F.lit(None).cast("string")

    def has_meta(self, key: str) -> Column:
        kind = self.types.get("metadata")
        if isinstance(kind, T.StructType):
            return F.lit(key in kind.names)
        if isinstance(kind, T.MapType):
            return F.coalesce(F.map_contains_key(F.col("metadata"), key), F.lit(False))
        return F.lit(False)

    def text_key(self, key: str) -> Column:
        return F.col(key) if isinstance(self.types.get(key), T.StringType) else F.lit(None).cast("string")

    def meta_text(self, key: str) -> Column:
        return self.meta(key)

    def scalars(self) -> list[tuple[str, str, Column]]:
        """(key, kind, value) of every column that can be emitted."""
        out = []
        for key, kind in self.types.items():
            column = F.col("`{}`".format(key))
            if isinstance(kind, T.BooleanType):
                out.append((key, "xsd:boolean", column.cast("string")))
            elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                out.append((key, "xsd:integer", column.cast("string")))
            elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
                out.append((key, "xsd:double", python_double(column)))
            elif isinstance(kind, T.ArrayType):
                out.append((key, "xsd:string", joined_list(column)))
            elif not isinstance(kind, (T.StructType, T.MapType)):
                out.append((key, "xsd:string", column.cast("string")))
        return out


class VariantRecord:
    """Record held as a VARIANT object; keys may differ from row to row."""

    def __init__(self, column: str):
        self.v = F.col(column)

    def _at(self, *keys: str) -> Column:
        return F.try_variant_get(self.v, "$" + "".join("." + key for key in keys), "variant")

    def _string(self, *keys: str) -> Column:
        value = self._at(*keys)
        return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))

    def has(self, key: str) -> Column:
        return self._at(key).isNotNull()

    def has_prefix(self, prefix: str) -> Column:
        keys = F.map_keys(self.v.try_cast("map<string,variant>"))
        return F.exists(keys, lambda k: F.startswith(k, F.lit(prefix)))

    def text(self, key: str) -> Column:
        return F.try_variant_get(self.v, "$." + key, "string")

    def meta(self, key: str) -> Column:
        return F.try_variant_get(self.v, "$.metadata." + key, "string")

    def has_meta(self, key: str) -> Column:
        return self._at("metadata", key).isNotNull()

    def text_key(self, key: str) -> Column:
        return self._string(key)

    def meta_text(self, key: str) -> Column:
        return self._string("metadata", key)


def _is_whole(shape: Column) -> Column:
    # a cast of text that is no number costs an exception, so only the digits of decimals get there
    wide = F.when(shape.rlike(r"^DECIMAL\(\d+,0\)$"), F.regexp_extract(shape, r"\d+", 0).try_cast("int"))
    return (shape == "BIGINT") | (F.coalesce(wide, F.lit(0)) > 18)


def _is_number(shape: Column) -> Column:
    return shape.isin("DOUBLE", "FLOAT", "BIGINT") | F.startswith(shape, F.lit("DECIMAL"))


def _scalar_text(shape: Column, value: Column, boolean: Callable[[Column], Column]) -> Column:
    return (
        F.when(shape == "BOOLEAN", boolean(value.cast("string")))
        .when(_is_whole(shape) | (shape == "STRING"), value.cast("string"))
        .when(_is_number(shape), python_double(value.try_cast("double")))
    )


def variant_text(value: Column) -> Column:
    """Scalar variant as text the way a list member is written out; null for anything else."""
    return let(F.schema_of_variant(value), lambda shape: _scalar_text(shape, value, F.initcap))


def variant_fields(entries: Column) -> Column:
    """array<struct<key, kind, value>> of a record's entries; value null where not emitted."""
    shaped = F.transform(entries, lambda e: named(key=e["key"], v=e["value"], shape=F.schema_of_variant(e["value"])))

    def read(x: Column) -> Column:
        shape = x["shape"]
        kind = (
            F.when(shape == "BOOLEAN", F.lit("xsd:boolean"))
            .when(_is_whole(shape), F.lit("xsd:integer"))
            .when(_is_number(shape), F.lit("xsd:double"))
            .otherwise(F.lit("xsd:string"))
        )
        members = joined_list(F.transform(x["v"].try_cast("array<variant>"), variant_text))
        value = F.when(F.startswith(shape, F.lit("ARRAY")), members).otherwise(_scalar_text(shape, x["v"], lambda t: t))
        return named(key=x["key"], kind=kind, value=value)

    return F.transform(shaped, read)


def joined_list(items: Column) -> Column:
    """Non-blank members, stripped and joined with '; '; null when none is left."""
    clean = F.filter(F.transform(items, lambda x: strip(x.cast("string"))), lambda x: x != "")
    return F.nullif(F.array_join(clean, "; "), F.lit(""))


# --- derived fields ------------------------------------------------------------------------------


def record_qid(record: TypedRecord | VariantRecord) -> Column:
    """First usable item id of the usual keys and the metadata block."""
    return F.coalesce(*[qid(record.text(key)) for key in fixed.QID_KEYS], qid(record.meta("wikidata")))


def thumbnail_url(image: Column, width: int = 320) -> Column:
    name = quote(F.replace(strip(image), F.lit(" "), F.lit("_")), fixed.SAFE_FILE)
    return F.concat(F.lit(fixed.FILE_PATH), name, F.lit("?width={}".format(width)))


def coordinates(text: Column) -> Column:
    """struct<lat, lon> from two numbers separated by slash, comma or semicolon; null out of range."""
    number = r"^[+-]?([0-9]+(_[0-9]+)*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

    def read(part: Column) -> Column:
        clean = strip(part)
        return F.when(clean.rlike(number), F.replace(clean, F.lit("_"), F.lit("")).try_cast("double"))

    def pair(axes: Column) -> Column:
        lat, lon = F.get(axes, 0), F.get(axes, 1)
        return F.when(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), named(lat=lat, lon=lon))

    return let(F.transform(F.slice(F.split(strip(text), r"\s*[/,;]\s*"), 1, 2), read), pair)


DERIVED_KEYS = [
    "qid",
    "wikidata_entity",
    "thumbnail_image",
    "thumbnail_image_file",
    "coordinates",
    "coordinate_lat",
    "coordinate_lon",
    "gil_link_count",
]


def derived_parts(record: TypedRecord | VariantRecord, keys: Sequence[str] = tuple(DERIVED_KEYS)) -> dict[str, Column]:
    """What the derived fields are made of, to be computed once per row as columns of their own."""
    parts: dict[str, Column] = {}
    if "qid" in keys:
        parts["_item"] = record_qid(record)
    if "thumbnail_image" in keys:
        parts["_image"] = blank_to_null(record.meta_text("image"))
    if "coordinates" in keys:
        parts["_place"] = strip(record.meta("coordinates"))
        parts["_pair"] = coordinates(record.meta("coordinates"))
    if "gil_link_count" in keys:
        cell = record.text_key("gil")
        parts["_links"] = F.when(cell.isNotNull(), F.size(link_targets(cell)).cast("string"))
    return parts


def derived_values(keys: Sequence[str] = tuple(DERIVED_KEYS)) -> list[tuple[str, str, Column]]:
    """(key, kind, value) of item, thumbnail, coordinate and link-count fields; null where absent."""
    item, image, place, pair = F.col("_item"), F.col("_image"), F.col("_place"), F.col("_pair")
    out: list[tuple[str, str, Column]] = []
    if "qid" in keys:
        out.append(("qid", "xsd:string", item))
        out.append(("wikidata_entity", "xsd:string", F.concat(F.lit(fixed.ITEM_ENTITY), item)))
    if "thumbnail_image" in keys:
        out.append(("thumbnail_image", "xsd:string", thumbnail_url(image)))
        out.append(("thumbnail_image_file", "xsd:string", image))
    if "coordinates" in keys:
        out.append(("coordinates", "xsd:string", F.when(pair.isNotNull(), place)))
        out.append(("coordinate_lat", "xsd:double", python_double(pair["lat"])))
        out.append(("coordinate_lon", "xsd:double", python_double(pair["lon"])))
    if "gil_link_count" in keys:
        out.append(("gil_link_count", "xsd:integer", F.col("_links")))
    return out


def has_special_keys(record: TypedRecord | VariantRecord) -> Column:
    """Whether a row takes the path with derived fields."""
    out = record.has("gil")
    for key in fixed.QID_KEYS:
        out = out | record.has(key)
    for key in ("wikidata", "image", "coordinates"):
        out = out | record.has_meta(key)
    return out


#: (key, kind, value, hold) to struct<kind, value>; ``hold`` is how a column is used several times
Typing = Callable[..., Column]


def shared(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a column several times where the compiler shares equal expressions, outside of lambdas."""
    return body(value)


def rows_with_fields(
    records: DataFrame, record: TypedRecord | VariantRecord, subject: Column, typing: Typing, carry: Sequence[str] = ()
) -> DataFrame:
    """(dataset_id, position, s, fields, carry…) with everything a row may emit in ``fields``.

    ``fields`` is array<struct<key, kind, value, repeated, same_kind>>; entries with a null value
    are not emitted. A scalar or list ``metadata`` value is emitted only by rows that have special
    keys. Values, types and marks are separate projections, so each is computed once.
    """
    head = [
        F.col("dataset_id").cast("string").alias("dataset_id"),
        F.col("position").cast("bigint").alias("position"),
        subject.alias("s"),
        *[F.col(c) for c in carry],
    ]
    names = ["dataset_id", "position", "s", *carry]
    build = _typed_fields if isinstance(record, TypedRecord) else _variant_fields
    return build(records, record, typing, head, names)


def _typed_fields(records, record: TypedRecord, typing: Typing, head: list[Column], names: list[str]) -> DataFrame:
    """Keys, kinds and possible repeats of typed columns are known before the job runs."""
    no = F.lit(False)
    special = has_special_keys(record)
    wanted = _wanted_derived(record)
    derived = derived_values(wanted)
    own = record.scalars()
    own_values = [
        (F.when(special, value) if key == "metadata" else value).alias("_v{}".format(i)) for i, (key, _, value) in enumerate(own)
    ]
    parts = [part.alias(name) for name, part in derived_parts(record, wanted).items()]
    staged = records.select(*head, special.alias("_special"), *own_values, *parts)
    entries = [(key, kind, F.when(F.col("_special"), value)) for key, kind, value in derived]
    entries += [(key, kind, F.col("_v{}".format(i))) for i, (key, kind, _) in enumerate(own)]
    typed = []
    for i, (key, kind, value) in enumerate(entries):
        new = typing(key, kind, value)
        typed.append(named(key=F.lit(key), kind=new["kind"], value=new["value"]).alias("_t{}".format(i)))
    staged = staged.select(*names, *typed)
    first = {key: F.col("_t{}".format(i)) for i, (key, _, _) in enumerate(derived)}
    marked = []
    for i, (key, _, _) in enumerate(entries):
        f = F.col("_t{}".format(i))
        if i >= len(derived) and key in first:
            before = first[key]["value"].isNotNull()
            marked.append(emission(f, before, before & (first[key]["kind"] == f["kind"])))
        else:
            marked.append(emission(f, no, no))
    return staged.select(*names, F.array(*marked).alias("fields"))


def _variant_fields(records, record: VariantRecord, typing: Typing, head: list[Column], names: list[str]) -> DataFrame:
    entries = F.map_entries(record.v.try_cast("map<string,variant>"))
    special = has_special_keys(record)
    parts = [F.when(special, part).alias(name) for name, part in derived_parts(record).items()]
    staged = records.select(*head, special.alias("_special"), variant_fields(entries).alias("_own"), *parts)
    derived = []
    for key, kind, value in derived_values():
        new = typing(key, kind, value)
        derived.append(named(key=F.lit(key), kind=new["kind"], value=new["value"]))

    def typed(f: Column) -> Column:
        shown = (f["key"] != "metadata") | F.col("_special")
        new = typing(f["key"], f["kind"], f["value"], let)
        return let(new, lambda n: named(key=f["key"], kind=n["kind"], value=F.when(shown, n["value"])))

    # null for rows without special keys, so that these pay for none of it
    present = F.when(F.col("_special"), F.array(*derived)).alias("_derived")
    staged = staged.select(*names, present, F.transform("_own", typed).alias("_own"))

    def mark(f: Column) -> Column:
        def before(test: Callable[[Column], Column]) -> Column:
            hit = F.exists("_derived", lambda d: (d["key"] == f["key"]) & d["value"].isNotNull() & test(d))
            return f["key"].isin(*DERIVED_KEYS) & hit

        return emission(f, before(lambda d: F.lit(True)), before(lambda d: d["kind"] == f["kind"]))

    none = F.lit(False)
    head_part = F.transform("_derived", lambda d: emission(d, none, none))
    own_part = F.transform("_own", lambda f: emission(f, none, none))
    both = F.concat(head_part, F.transform("_own", mark))
    return staged.select(*names, F.when(F.col("_derived").isNull(), own_part).otherwise(both).alias("fields"))


def _wanted_derived(record: TypedRecord) -> list[str]:
    """Derived fields the columns at hand can give at all, by the first key of each kind."""
    kind = record.types.get("metadata")
    meta = kind.names if isinstance(kind, T.StructType) else fixed.META_KEYS if isinstance(kind, T.MapType) else []
    wanted = []
    if "wikidata" in meta or any(key in record.types for key in fixed.QID_KEYS):
        wanted.append("qid")
    if "image" in meta:
        wanted.append("thumbnail_image")
    if "coordinates" in meta:
        wanted.append("coordinates")
    if isinstance(record.types.get("gil"), T.StringType):
        wanted.append("gil_link_count")
    return wanted


# --- typing --------------------------------------------------------------------------------------


def _lit(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def generic_typing(key: Column | str, kind: Column | str, value: Column, hold=shared) -> Column:
    """Date keys become dateTime when readable; everything else keeps its value type."""
    if isinstance(key, str) and key not in fixed.DATE_KEYS:
        return named(kind=_lit(kind), value=value)
    dated = F.when(_lit(key).isin(*fixed.DATE_KEYS), value)

    def result(stamp: Column) -> Column:
        new_kind = F.when(stamp.isNotNull(), F.lit("xsd:dateTime")).otherwise(_lit(kind))
        return named(kind=new_kind, value=F.coalesce(stamp, value))

    return hold(_moment(dated, hold), result)


def inferred_typing(planned: Column | bool = True) -> Typing:
    """Typing of SQL-result values: text may turn into dateTime or into an address.

    ``planned`` rows (without special keys) normalize date keys whatever their value type;
    the others leave numbers alone.
    """
    plan = F.lit(planned) if isinstance(planned, bool) else planned

    def typing(key: Column | str, kind: Column | str, value: Column, hold=shared) -> Column:
        if isinstance(key, str) and key not in fixed.DATE_KEYS and isinstance(kind, str) and kind != "xsd:string":
            return named(kind=F.lit(kind), value=value)
        is_text = _lit(kind) == "xsd:string"

        def found(text: Column) -> Column:
            dated = _lit(key).isin(*fixed.DATE_KEYS) & (plan | is_text)
            web = text.rlike(r"^https?://[^/]") & ~text.rlike(r"(?U)\s")
            item = F.concat(F.lit(fixed.ITEM_ENTITY + "Q"), F.substring(text, F.lit(2), F.length(text)))
            address = (
                F.when(web, text)
                .when(text.rlike(r"^[Qq][0-9]+$"), item)
                .when(text.rlike(r"^M[0-9]+$"), F.concat(F.lit(fixed.MEDIA_ENTITY), text))
            )
            moment = _moment(F.when(dated, value).when(text.rlike(r"^20[0-9]{12}$"), text), hold)
            return hold(named(moment=moment, address=address), result)

        def result(new: Column) -> Column:
            new_kind = F.when(new["moment"].isNotNull(), F.lit("xsd:dateTime")).when(new["address"].isNotNull(), F.lit("iri"))
            return named(kind=new_kind.otherwise(_lit(kind)), value=F.coalesce(new["moment"], new["address"], value))

        return hold(F.when(is_text, strip(value)), found)

    return typing


def _moment(value: Column, hold) -> Column:
    """Canonical dateTime; within a lambda, where each step is evaluated, values that are null take none."""
    if hold is shared:
        return xsd_datetime(value)
    return hold(value, lambda v: F.when(v.isNotNull(), xsd_datetime(v)))


# --- subjects ------------------------------------------------------------------------------------


def identifier(record: TypedRecord | VariantRecord, position: Column) -> Column:
    parts = [F.when(strip(record.text(key)) != "", record.text(key)) for key in fixed.IDENTIFIER_KEYS]
    return F.coalesce(*parts, position.cast("string"))


def is_commons_file(record: TypedRecord | VariantRecord) -> Column:
    """File page that belongs to Commons: named wiki, or image metadata when no wiki is named."""
    lower = lambda key: F.lower(strip(F.coalesce(record.text(key), F.lit(""))))
    wiki = lower("wiki")
    is_file = F.coalesce(integer(record.text("namespace")) == fixed.FILE_NAMESPACE, F.lit(False)) | (lower("nstext") == "file")
    return is_file & F.when(wiki != "", wiki.isin("commonswiki", fixed.COMMONS_DOMAIN)).otherwise(record.has_prefix("img_"))


def item_subject(record: TypedRecord | VariantRecord, vocab: Vocabulary, dataset: Column, position: Column) -> Column:
    """Media entity, else item entity, else an address below the item base."""
    positive = lambda key: F.when(integer(record.text(key)) > 0, integer(record.text(key)))
    page_id = F.coalesce(positive("id"), positive("pageid"))
    item = record_qid(record)
    own = F.concat_ws(
        "/", F.lit(vocab.item_base), dataset.cast("string"), F.lit("item"), quote(identifier(record, position), fixed.SAFE_NONE)
    )
    media = F.when(is_commons_file(record), F.concat(F.lit(fixed.MEDIA_ENTITY + "M"), page_id.cast("string")))
    return F.coalesce(media, F.concat(F.lit(fixed.ITEM_ENTITY), item), own)


def result_subject(vocab: Vocabulary, dataset: Column, position: Column) -> Column:
    return F.concat(F.lit(vocab.row_base + "/"), dataset.cast("string"), F.lit("#"), (position + 1).cast("string"))


# --- rows and triples ----------------------------------------------------------------------------


def list_rows(
    records: DataFrame, record: TypedRecord | VariantRecord, vocab: Vocabulary, carry: Sequence[str] = ()
) -> DataFrame:
    """(dataset_id, position, s, fields) of page-list records; needs dataset_id and position."""
    subject = item_subject(record, vocab, F.col("dataset_id"), F.col("position"))
    return rows_with_fields(records, record, subject, generic_typing, carry)


def result_rows(
    records: DataFrame, record: TypedRecord | VariantRecord, vocab: Vocabulary, carry: Sequence[str] = ()
) -> DataFrame:
    """(dataset_id, position, s, fields) of SQL-result records, with inferred types."""
    subject = result_subject(vocab, F.col("dataset_id"), F.col("position"))
    keys = ["metadata", "gil", *fixed.QID_KEYS]
    if isinstance(record, TypedRecord):
        return rows_with_fields(records, record, subject, inferred_typing(not set(keys) & set(record.types)), carry)
    special = record.has(keys[0])
    for key in keys[1:]:
        special = special | record.has(key)
    marked = records.withColumn("_planned", ~special)
    return rows_with_fields(marked, record, subject, inferred_typing(F.col("_planned")), [*carry, "_planned"]).drop("_planned")


def _graph(rows: DataFrame) -> DataFrame:
    """Graph columns from (dataset_id, s, p, kind, value[, lang])."""
    lang = F.col("lang") if "lang" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        "dataset_id",
        "s",
        "p",
        F.when(F.col("kind") == "iri", F.lit("iri")).otherwise(F.lit("literal")).alias("o_kind"),
        F.col("value").alias("o"),
        datatype_of(F.col("kind")).alias("o_dt"),
        lang.alias("o_lang"),
    )


def row_triples(rows: DataFrame, vocab: Vocabulary, loaded_at: str) -> DataFrame:
    """Graph columns from (dataset_id, position, s, fields): four fixed triples plus one per field.

    Each record is read once; its triples leave one generator.
    """
    no = F.lit(False)
    head = [
        ("#type", "iri", F.lit(vocab.iri(vocab.page_class))),
        ("#" + vocab.dataset, "xsd:integer", F.col("dataset_id")),
        ("#" + vocab.position, "xsd:integer", F.col("position").cast("string")),
        ("#" + vocab.loaded_at, "xsd:dateTime", F.lit(loaded_at)),
    ]
    fixed_part = F.array(*[emission(field(key, kind, value), no, no) for key, kind, value in head])
    long = rows.select("dataset_id", "s", F.explode_outer(F.concat(fixed_part, F.col("fields"))).alias("_f"))
    key = F.col("_f.key")
    p = (
        F.when(key == "#type", F.lit(fixed.RDF_TYPE))
        .when(F.startswith(key, F.lit("#")), F.concat(F.lit(vocab.ontology), F.substring(key, F.lit(2), F.length(key))))
        .otherwise(F.concat(F.lit(vocab.ontology), field_name(key)))
    )
    return _graph(
        long.where(F.col("_f.value").isNotNull()).select(
            "dataset_id", "s", p.alias("p"), F.col("_f.kind").alias("kind"), F.col("_f.value").alias("value")
        )
    )


def field_triples(fields: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Graph columns from long fields (dataset_id, s, key, kind, value)."""
    p = F.concat(F.lit(vocab.ontology), field_name(F.col("key")))
    return _graph(fields.select("dataset_id", "s", p.alias("p"), "kind", "value"))


def graph_set(triples: DataFrame) -> DataFrame:
    """Set semantics: equal triples merge (partial distinct runs before the shuffle)."""
    return triples.select(*GRAPH_COLUMNS).dropDuplicates()


# --- derived page address columns ----------------------------------------------------------------


def page_uri_columns(df: DataFrame, siteinfo: DataFrame, namespaces: DataFrame, interwiki: DataFrame | None = None) -> DataFrame:
    """Add ``…_uri`` columns for the title columns present; an existing column is never touched.

    ``siteinfo(domain, article_path)`` and ``namespaces(domain, ns_id, name)`` join on the row's
    ``domain``; a namespace without a name adds no prefix. No join is hinted: the planner
    broadcasts a dimension only when its measured size allows.
    """
    from pagegraph.functions.text import page_title
    from pagegraph.functions.wiki import article_url, interwiki_uri

    names = set(df.columns)
    specs: list[tuple[str, str, Column]] = []
    for prefix in fixed.TITLE_PREFIXES:
        if prefix + "_title" in names:
            space = prefix + "_namespace"
            number = F.coalesce(integer(F.col(space).cast("string")), F.lit(0)) if space in names else F.lit(0)
            specs.append((prefix + "_title", prefix + "_uri", number.cast("bigint")))
    for column, uri in fixed.FILE_TITLE_COLUMNS.items():
        if column in names:
            specs.append((column, uri, F.lit(fixed.FILE_NAMESPACE).cast("bigint")))
    for column, uri in fixed.CATEGORY_TITLE_COLUMNS.items():
        if column in names:
            specs.append((column, uri, F.lit(fixed.CATEGORY_NAMESPACE).cast("bigint")))
    specs = [spec for spec in specs if spec[1] not in names]
    out = df.join(siteinfo.select("domain", "article_path"), "domain", "left")
    origin = F.concat(F.lit("https://"), F.col("domain"))
    for title, uri, number in specs:
        dim = namespaces.select("domain", F.col("ns_id").alias("_ns"), F.col("name").alias("_name"))
        out = out.withColumn("_ns", number).join(dim, ["domain", "_ns"], "left")
        clean = page_title(F.col(title).cast("string"))
        name = strip(F.coalesce(F.col("_name"), F.lit("")))
        full = F.when(name != "", F.concat(name, F.lit(":"), clean)).otherwise(clean)
        value = F.when(clean != "", article_url(origin, F.col("article_path"), full))
        out = out.withColumn(uri, F.when(F.col("article_path").isNotNull(), value)).drop("_ns", "_name")
    if interwiki is not None and {"iwl_prefix", "iwl_title"} <= names and "iwl_uri" not in names:
        dim = interwiki.select("domain", F.col("prefix").alias("_prefix"), F.col("url").alias("_url"))
        out = (
            out.withColumn("_prefix", strip(F.col("iwl_prefix").cast("string")))
            .join(dim, ["domain", "_prefix"], "left")
            .withColumn("iwl_uri", interwiki_uri(F.col("_url"), F.col("iwl_title").cast("string")))
            .drop("_prefix", "_url")
        )
    return out.select(*df.columns, *[c for c in out.columns if c.endswith("_uri") and c not in names])


# --- sitelink graphs -----------------------------------------------------------------------------

# --- fixed values: column, predicate (None: own ontology) and kind of sitelink records ---
SITELINK_FIELDS = [
    ("page_id", None, "xsd:integer"),
    ("namespace", None, "xsd:integer"),
    ("page_title", None, "xsd:string"),
    ("wiki_domain", None, "xsd:string"),
    ("wiki_dbname", None, "xsd:string"),
    ("wiki_project", None, "xsd:string"),
    ("wikidata_id", None, "xsd:string"),
    ("created_timestamp", None, "xsd:dateTime"),
    ("current_timestamp", None, "xsd:dateTime"),
    ("wikidata_entity", fixed.SCHEMA_ABOUT, "iri"),
    ("lang_code", fixed.SCHEMA_IN_LANGUAGE, "xsd:string"),
    ("page_label", fixed.SCHEMA_NAME, "xsd:string"),
    ("site_url", fixed.SCHEMA_IS_PART_OF, "iri"),
]


def language_tag(lang: Column) -> Column:
    """The tag when it is a valid one, else null."""
    clean = strip(lang)
    return F.when(clean.rlike(fixed.LANGUAGE_TAG_PATTERN), clean)


def sitelink_triples(records: DataFrame, vocab: Vocabulary, subject: str = "page_url") -> DataFrame:
    """Article graph of page records; only the columns present are used.

    Rows without a subject address belong in :func:`missing_subject` and give no triples.
    """
    s = strip(F.col(subject))
    null = F.lit(None).cast("string")

    def part(node: Column, p: str, kind: str, value: Column, lang: Column = null) -> Column:
        return named(s=node, p=F.lit(p), kind=F.lit(kind), value=value, lang=lang)

    parts = [part(s, fixed.RDF_TYPE, "iri", F.lit(fixed.SCHEMA_ARTICLE))]
    for column, predicate, kind in SITELINK_FIELDS:
        if column not in records.columns:
            continue
        text = F.col(column).cast("string")
        if kind == "xsd:integer":
            value = integer(text).cast("string")
        elif kind == "xsd:dateTime":
            value = xsd_datetime(text)
        else:
            value = blank_to_null(text)
        tagged = column == "page_label" and "lang_code" in records.columns
        lang = language_tag(F.col("lang_code")) if tagged else null
        parts.append(part(s, predicate or vocab.ontology + column, kind, value, lang))
    if {"site_url", "wiki_group"} <= set(records.columns):
        group = blank_to_null(F.col("wiki_group"))
        parts.append(part(blank_to_null(F.col("site_url")), fixed.WIKI_GROUP, "xsd:string", group))
    long = records.where(F.coalesce(s, F.lit("")) != "").select(
        F.col("dataset_id").cast("string").alias("dataset_id"), F.explode_outer(F.array(*parts)).alias("_x")
    )
    return _graph(long.where(F.col("_x.s").isNotNull() & F.col("_x.value").isNotNull()).select("dataset_id", "_x.*"))


def missing_subject(records: DataFrame, subject: str = "page_url") -> DataFrame:
    return records.where(F.coalesce(strip(F.col(subject)), F.lit("")) == "")


# --- graphs over tables that are not written out ---------------------------------------------------


def virtual_triples(
    records: DataFrame, fields: dict[str, tuple[str, Column]], vocab: Vocabulary, subject: Column, page_class: bool = True
) -> DataFrame:
    """Graph columns as a union of one projection per predicate.

    ``fields`` maps a key to (kind, value). A pattern with a constant predicate folds every other
    branch away, so only the columns of that predicate are read from the files. Use
    :func:`row_triples` to write a graph out: it scans the records once for all predicates.
    """
    null = F.lit(None).cast("string")

    def branch(p: str, kind: str, value: Column) -> DataFrame:
        return records.select(
            F.col("dataset_id").cast("string").alias("dataset_id"),
            subject.alias("s"),
            F.lit(p).alias("p"),
            F.lit("iri" if kind == "iri" else "literal").alias("o_kind"),
            value.cast("string").alias("o"),
            datatype_of(F.lit(kind)).alias("o_dt"),
            null.alias("o_lang"),
        ).where(F.col("o").isNotNull() & F.col("s").isNotNull())

    parts = [branch(fixed.RDF_TYPE, "iri", F.lit(vocab.iri(vocab.page_class)))] if page_class else []
    parts += [branch(vocab.iri(key), kind, value) for key, (kind, value) in fields.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scanned_triples(
    records: DataFrame, fields: dict[str, tuple[str, Column]], vocab: Vocabulary, subject: Column, page_class: bool = True
) -> DataFrame:
    """The triples of :func:`virtual_triples` from one scan and one generator.

    For uses that want all predicates of a subject, such as a description; a filter on the subject is
    applied to the rows before they are unpivoted.
    """
    head = [(fixed.RDF_TYPE, "iri", F.lit(vocab.iri(vocab.page_class)))] if page_class else []
    parts = head + [(vocab.iri(key), kind, value) for key, (kind, value) in fields.items()]
    cells = F.array(*[named(p=F.lit(p), kind=F.lit(kind), value=value.cast("string")) for p, kind, value in parts])
    rows = records.select(F.col("dataset_id").cast("string").alias("dataset_id"), subject.alias("s"), F.explode_outer(cells).alias("_x"))
    return _graph(rows.where(F.col("s").isNotNull() & F.col("_x.value").isNotNull()).select("dataset_id", "s", "_x.p", "_x.kind", "_x.value"))
