"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

The mix is a row of slots of ``block`` words. Slot k has the point k * golden ratio
(modulo 1), which cumulative target weights map to a source; the slot's rank within
its source names the block it takes. A source's blocks are cut from its documents
in hashed order, once per epoch, at most ``max_epochs`` times. Everything is DataFrame
operations: running totals and ranks are taken over ranges first, so no source, however
large, is ordered in one task.
"""

from __future__ import annotations

import math
from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from particlelake.llm.common import WORD, row_signature, stored

BLOCK_WORDS = 64
MAX_EPOCHS = 3
#: Documents ordered together in one task, about; a range of their hashes.
RANGE_ROWS = 20_000
SLOTS_AT_ONCE = 1 << 16
GRID = 4096

getcontext().prec = 50
GOLDEN = (Decimal(5).sqrt() - 1) / 2
SPLIT = 1 << 20


def golden_point(slot: Column) -> Column:
    """Fractional part of (slot + 1) * golden ratio; split so that large slots stay exact."""
    high = F.floor(slot / SPLIT).cast("long")
    low = slot - high * SPLIT + 1
    step = float(GOLDEN * SPLIT % 1)
    total = high * F.lit(step) + low * F.lit(float(GOLDEN))
    return total - F.floor(total)


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, source_no, target, lo, hi) from (source, source_size).

    Sources in code point order, null last, weigh 1, 2, 3 and again; all sizes together
    are shared by weight, a target stops at ``max_epochs`` times its source, and the
    excess is reshared until none is above. With sources ordered by limit over weight,
    the share per weight unit is the largest of what each prefix of limited sources
    would leave the rest. One row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    numbered = sizes.withColumn("source_no", F.row_number().over(order)).withColumn("weight", (F.col("source_no") - 1) % 3 + 1)
    limit = F.col("source_size") * max_epochs
    by_limit = Window.orderBy(limit / F.col("weight"), "source_no")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shared = numbered.withColumn("unit", rest / weights)
    unit = F.max("unit").over(everything)
    aimed = shared.withColumn("unit", unit).withColumn("target", F.least(F.col("weight") * F.col("unit"), limit.cast("double")))
    whole = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.sum("target").over(upto) / F.sum("target").over(whole)
    laid = aimed.withColumn("hi", F.coalesce(share, F.lit(0.0)))
    last = F.col("source_no") == F.max("source_no").over(whole)
    lo = F.coalesce(F.lag("hi").over(Window.orderBy("source_no")), F.lit(0.0))
    return laid.withColumn("lo", lo).withColumn("hi", F.when(last, F.lit(2.0)).otherwise(F.col("hi"))).select(
        "source", "source_size", "source_no", "target", "lo", "hi"
    )


def placed_documents(docs: DataFrame, seed: int, max_epochs: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's hashed order, and the sources."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = stored(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            F.col(f"`{source_col}`").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)).alias("place"),
            row_signature(F.col(f"`{text_col}`")).alias("signature"),
        ),
        "sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, max_epochs), "targets")
    count = rows.count()
    bits = max(4, math.ceil(math.log2(max(1, count / RANGE_ROWS))))
    ranged = rows.withColumn("range", F.shiftright("place", 64 - bits))
    known = targets.select(F.col("source").alias("of"), "source_no", "source_size", "target")
    numbered = ranged.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    starts = numbered.groupBy("source_no", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("source_no", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("source_no", "range").orderBy("place", "doc_id", "signature", "size")
    inner = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = numbered.withColumn("inner", inner).join(starts, ["source_no", "range"])
    return stored(
        placed.select("doc_id", "signature", "source", "source_no", "size", "source_size", "target", (F.col("before") + F.col("inner")).alias("start")),
        "placed",
    ), targets


def slot_blocks(targets: DataFrame, block: int) -> DataFrame:
    """(slot, source_no, block): every slot's source and the rank of the slot in it."""
    spark = targets.sparkSession
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    slots = spark.range(math.ceil(total / block)).withColumnRenamed("id", "slot")
    pointed = slots.withColumn("point", golden_point(F.col("slot"))).withColumn("cell", F.floor(F.col("point") * GRID).cast("int"))
    last = F.least((F.col("hi") * GRID).cast("int"), F.lit(GRID))
    cells = targets.where("hi > lo").select("source_no", "lo", "hi", F.explode(F.sequence((F.col("lo") * GRID).cast("int"), last)).alias("cell"))
    drawn = (
        pointed.join(cells, "cell").where("point >= lo and point < hi")
        .select("slot", "source_no", F.floor(F.col("slot") / SLOTS_AT_ONCE).cast("long").alias("part"))
    )
    counts = drawn.groupBy("source_no", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("source_no", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source_no", "part").orderBy("slot")) - 1
    ranked = drawn.withColumn("rank", rank).join(before, ["source_no", "part"])
    return ranked.select("slot", "source_no", (F.col("before") + F.col("rank")).cast("long").alias("block"))


def mix_schedule(
    docs: DataFrame,
    block: int = BLOCK_WORDS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The mix, and the documents it draws from.

    Mix: (slot, source_no, start, doc_id, epoch, first_word, words), one row for the part
    of a document that a slot's block holds, words [first_word, first_word + words).
    Documents: (doc_id, signature, source, source_no, size, source_size, target, start);
    ``source_no`` and ``start`` name a document that has words. Null texts and texts
    without words have size 0 and are in no block; null sources are one source, the
    last; repeated rows are documents of their own; an empty table gives empty tables.
    Runs over the same rows agree.
    """
    placed, targets = placed_documents(docs, seed, max_epochs, id_col, text_col, source_col)
    slots = stored(slot_blocks(targets, block), "slots")
    taken = slots.groupBy("source_no").agg(F.count(F.lit(1)).alias("blocks"))
    epochs = (
        placed.where("size > 0").join(taken, "source_no")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
        .withColumn("at", F.col("epoch") * F.col("source_size") + F.col("start"))
        .where(F.col("at") < F.col("blocks") * block)
    )
    first = F.floor(F.col("at") / block).cast("long")
    last = F.floor((F.col("at") + F.col("size") - 1) / block).cast("long")
    cut = epochs.withColumn("block", F.explode(F.sequence(first, F.least(last, F.col("blocks") - 1))))
    begin = F.greatest(F.col("at"), F.col("block") * block)
    until = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    parts = cut.select(
        "source_no", "block", "start", "doc_id", "epoch", (begin - F.col("at")).alias("first_word"), (until - begin).alias("words")
    )
    mix = slots.join(parts, ["source_no", "block"]).select("slot", "source_no", "start", "doc_id", "epoch", "first_word", "words")
    return mix, placed


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document, from the mix itself."""
    mix, placed = mix_schedule(docs, **options)
    taken = mix.groupBy("source_no", F.col("start").alias("from")).agg(F.sum("words").alias("taken"))
    # A document without words starts where the next one does; it is given no place.
    placed = placed.withColumn("from", F.when(F.col("size") > 0, F.col("start")).otherwise(-F.abs(F.hash("doc_id", "signature")) - 1))
    return placed.join(taken, ["source_no", "from"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` as the mix holds them: a row per document and epoch, cut where the mix ends.

    Whole documents keep their text as it is; a document that the source's last block
    cuts keeps its first words, with one space between. Documents the mix does not
    reach, and those without words, are not in it.
    """
    mix, placed = mix_schedule(docs, id_col=id_col, text_col=text_col, **options)
    source_col = options.get("source_col", "source")
    key = F.to_json(F.struct(F.col("doc_id"), F.col("signature"), F.col("source")))
    copy = F.row_number().over(Window.partitionBy("__key").orderBy("start"))
    named = placed.where("size > 0").select("source_no", "start", "size", key.alias("__key")).withColumn("__copy", copy)
    per_epoch = mix.groupBy("source_no", "start", "epoch").agg(F.sum("words").alias("__words"))
    drawn = named.join(per_epoch, ["source_no", "start"]).select(
        F.col("__key").alias("__drawn"), F.col("__copy").alias("__which"), "__words", F.col("size").alias("__size")
    )
    own = F.to_json(F.struct(
        F.col(f"`{id_col}`").alias("doc_id"), row_signature(F.col(f"`{text_col}`")).alias("signature"), F.col(f"`{source_col}`").alias("source")
    ))
    # Rows alike in id, text and source are numbered on both sides, so each is drawn as itself.
    again = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    numbered = docs.withColumn("__key", own).withColumn("__copy", again)
    met = numbered.join(drawn, (F.col("__key") == F.col("__drawn")) & (F.col("__copy") - F.col("__which") == 0))
    begun = F.array_join(F.slice(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("__words").cast("int")), " ")
    text = F.when(F.col("__words") == F.col("__size"), F.col(f"`{text_col}`")).otherwise(begun)
    return met.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])
