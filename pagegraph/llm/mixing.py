"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagegraph.llm.common import numbered, running_sum, text_key
from pagegraph.session import checkpointed

#: most times a word can be taken; words of a block; slots ranked together
MOST, BLOCK, CHUNK = 3, 512, 65536
#: binary places of the van der Corput points
PLACES = 40


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null and blank texts have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def radical_inverse(slot: Column) -> Column:
    """Van der Corput point of a slot number: its binary digits mirrored at the point, in [0, 1)."""
    digits = F.reverse(F.lpad(F.bin(slot), PLACES, "0"))
    return F.conv(digits, 2, 10).cast("double") / float(1 << PLACES)


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """Target words per source: ``source, source_size, place, target``.

    ``sizes`` has ``source`` and ``source_size`` (long), one row per source. Sources in code-point order,
    null last, weigh 1, 2, 3, repeating, and share all words by weight. A target stops at ``most`` times
    its source's words and the excess is shared anew by weight, until no target is above. Each turn of
    the loop is one aggregate over the sources of which two numbers reach the driver; it ends because
    every turn stops at least one more source.
    """
    placed, _ = numbered(sizes, F.col("source").isNull(), F.col("source"), name="place")
    placed = placed.withColumn("weight", (F.col("place") % 3 + 1).cast("double")).withColumn("most", F.col("source_size") * float(most))
    placed = checkpointed(placed)
    total = float(placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    stopped_words, level = 0.0, None
    while True:
        # a source is stopped when its share at the last level was above its most
        free = F.lit(True) if level is None else F.col("weight") * level <= F.col("most")
        weight, words = placed.agg(F.sum(F.when(free, F.col("weight"))), F.sum(F.when(~free, F.col("most")))).first()
        stopped_words = words or 0.0
        new = (total - stopped_words) / weight if weight else level
        if level is not None and (new is None or new <= level * (1 + 1e-12)):
            break
        level = new
        if level is None:
            break
    share = F.col("weight") * (level or 0.0)
    return placed.select("source", "source_size", "place", F.when(share <= F.col("most"), share).otherwise(F.col("most")).alias("target"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots of the mix: ``place`` (source), ``turn`` (its slots' rank) and ``slot`` (order in the mix).

    Slot t belongs to the source whose share of the cumulative targets holds the van der Corput point of
    t. Shares are cut into cells of the unit interval, so that a slot finds its source by an equality on
    the cell. Slots are ranked per source inside chunks, and chunk counts are added up before. A source
    whose turns do not reach its target gets its last ones after all slots; turns beyond are left out.
    """
    spark = targets.sparkSession
    wanted = targets.withColumn("turns", F.ceil(F.round("target") / block)).where("turns > 0")
    slots, sources = wanted.agg(F.coalesce(F.sum("turns"), F.lit(0)), F.count("*")).first()
    cells = max(64, 2 * sources)
    ended = running_sum(wanted.select("place", "turns"), "turns", "place", name="start")
    span = ended.withColumn("low", F.col("start") / float(slots or 1)).withColumn("high", (F.col("start") + F.col("turns")) / float(slots or 1))
    held = span.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))))
    points = spark.range(slots).withColumn("x", radical_inverse(F.col("id")))
    dealt = points.withColumn("cell", F.floor(F.col("x") * cells)).join(held, "cell").where("low <= x and x < high")
    chunked = dealt.select("id", "place", "turns", F.floor(F.col("id") / CHUNK).alias("chunk"))
    counts = chunked.groupBy("place", "chunk").count()
    before = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("earlier", F.coalesce(F.sum("count").over(before), F.lit(0))).select("place", "chunk", "earlier")
    rank = F.row_number().over(Window.partitionBy("place", "chunk").orderBy("id")) - 1
    ranked = chunked.withColumn("r", rank).join(counts, ["place", "chunk"]).withColumn("turn", F.col("earlier") + F.col("r"))
    ranked = ranked.where("turn < turns").select("place", "turn", F.col("id").alias("slot"))
    reached = dealt.groupBy("place").agg(F.count("*").alias("had"))
    late = ended.join(reached, "place", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < turns")
    late = late.select("place", "start", F.explode(F.sequence("had", F.col("turns") - 1)).alias("turn"))
    return ranked.union(late.select("place", "turn", F.lit(slots) + F.col("start") + F.col("turn")))


def mix_blocks(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, block: int = BLOCK) -> DataFrame:
    """The mix as pieces of documents, one row per (slot, piece).

    Columns: ``slot``, ``source``, ``source_size``, ``target``, the id column, ``text_key`` (tells rows of
    one id apart), ``size``, ``pass_no`` (which run over the source), ``first_word`` and ``words``.

    A source's documents are shuffled by a seeded hash for every pass and laid end to end; its stream of
    words is cut into blocks of ``block`` words, and its r-th slot takes the r-th block. The last block is
    cut so that each source gives its target, rounded to words; so no document is taken more than
    ``MOST`` times. Null and blank texts have no words and are never taken. Identical rows (id, text and
    source) take adjacent, interchangeable places. An empty frame gives an empty mix.
    """
    return _pieces(*_measured(docs, ident, text, source), seed, block).withColumnRenamed("_id", ident)


def _measured(docs: DataFrame, ident: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (id, source, text key, size) and the targets of the sources, both cut from lineage."""
    sized = docs.select(
        F.col(ident).alias("_id"), F.col(source).alias("source"), text_key(F.col(text)).alias("text_key"), word_count(F.col(text)).alias("size")
    )
    sized = checkpointed(sized)
    return sized, checkpointed(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))


def _pieces(sized: DataFrame, targets: DataFrame, seed: int, block: int) -> DataFrame:
    keyed = sized.where("size > 0").join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    keyed = keyed.where("target >= 0.5")
    passes = F.sequence(F.lit(0), F.ceil(F.round("target") / F.col("source_size")) - 1)
    laid = keyed.withColumn("pass_no", F.explode(passes)).withColumn("mark", F.xxhash64("_id", "text_key", "pass_no", F.lit(seed)))
    laid = running_sum(laid, "size", "place", "pass_no", "mark", "_id", name="offset")
    laid = checkpointed(laid)
    starts = laid.groupBy("place").agg(F.min("offset").alias("base"))
    laid = laid.join(starts, "place").withColumn("start", F.col("offset") - F.col("base"))
    laid = laid.withColumn("end", F.least(F.col("start") + F.col("size"), F.round("target").cast("long"))).where("start < end")
    turns = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))
    pieces = laid.withColumn("turn", F.explode(turns))
    low, high = F.greatest("start", F.col("turn") * block), F.least("end", (F.col("turn") + 1) * block)
    pieces = pieces.withColumn("first_word", low - F.col("start")).withColumn("words", high - low)
    slots = schedule(targets, block)
    out = pieces.join(slots, ["place", "turn"])
    return out.select("slot", "source", "source_size", "target", "_id", "text_key", "size", "pass_no", "first_word", "words")


def taken_words(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """Words the mix takes of every document: id, ``size, source_size, target, taken``, one row per input row."""
    sized, targets = _measured(docs, ident, text, source)
    pieces = _pieces(sized, targets, seed, BLOCK)
    taken = pieces.groupBy(F.col("_id").alias("p_id"), F.col("text_key").alias("p_key"), F.col("source").alias("p_source"))
    taken = taken.agg(F.sum("words").alias("words"))
    # identical rows share what is taken of them evenly, the first ones one word more
    same = sized.groupBy("_id", "text_key", "source", "size").agg(F.count("*").alias("rows"))
    same = same.join(targets, same["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    hit = (F.col("_id").eqNullSafe(F.col("p_id"))) & (F.col("text_key") == F.col("p_key")) & F.col("source").eqNullSafe(F.col("p_source"))
    out = same.join(taken, hit, "left").withColumn("words", F.coalesce("words", F.lit(0)))
    out = out.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    share = F.floor(F.col("words") / F.col("rows")) + F.when(F.col("r") < F.col("words") % F.col("rows"), 1).otherwise(0)
    return out.select(F.col("_id").alias(ident), "size", "source_size", "target", share.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", chars: str = "n_chars", seed: int = 0) -> DataFrame:
    """Documents as the mix takes them, with the input's columns: one row per document and pass.

    A document taken whole keeps its text; one cut by its source's target keeps the words up to there.
    Documents without words are not taken. ``chars`` is the number of characters of the new text.
    """
    pieces = mix_blocks(docs, ident, text, source, seed)
    parts = pieces.groupBy(
        F.col(ident).alias("_id"), F.col("text_key").alias("_hash"), F.col("source").alias("_source"), "pass_no", F.col("size").alias("_size")
    ).agg(F.sum("words").alias("_words"))
    parts = parts.drop("pass_no")
    # identical rows: each pass holds all of them, the words are dealt out row by row
    rows = docs.withColumn("_key", text_key(F.col(text)))
    copy = Window.partitionBy(F.col(ident), F.col("_key"), F.col(source)).orderBy(F.lit(0))
    rows = rows.withColumn("_copy", F.row_number().over(copy) - 1)
    hit = (F.col(ident).eqNullSafe(F.col("_id"))) & (F.col("_key") == F.col("_hash")) & F.col(source).eqNullSafe(F.col("_source"))
    left = F.least(F.col("_words") - F.col("_copy") * F.col("_size"), F.col("_size"))
    taken = rows.join(parts, hit).withColumn("_left", left).where("_left > 0")
    words = F.regexp_extract_all(F.col(text), F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("_left").cast("int")), "")
    whole = F.when(F.col("_left") == F.col("_size"), F.col(text)).otherwise(cut)
    out = taken.withColumn(text, whole)
    if chars in docs.columns:
        out = out.withColumn(chars, F.length(text).cast(docs.schema[chars].dataType))
    return out.select(*docs.columns)
