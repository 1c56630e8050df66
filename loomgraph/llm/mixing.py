"""Mixing sources to target weights with a low-discrepancy schedule.

1. Targets. Sources share the total of all sizes (words) by weight; a source's target stops at ``MAX_EPOCHS`` times its
   size, and the excess is dealt among the others by weight, until none is above.
2. Schedule. Slot i of the mix stands for a block of ``block`` words. The golden-ratio point ``frac((i + 1/2) / phi)``,
   mapped through the sources' cumulative shares, names the slot's source, so any stretch of slots holds each source in
   proportion. Slots are ranked per source: summed up by chunks of slots first, so no source's slots meet in one task.
3. Blocks. A source's documents are shuffled by a hash of id and text and laid end to end, epoch after epoch, and cut into
   blocks. Rank r of the source takes the words from ``r * block`` on: ranks and blocks are joined by source and number,
   and what a document gives is the sum of its joined pieces. The mix is in the order of the slots. Positions come from
   sums per (source, bucket of the hash), so a source that holds most rows is spread over many tasks.
A block has MIN_BLOCK words, more from SLOTS slots on, and MAX_BLOCK at most; from there the slots grow with the corpus.
Golden-ratio points miss a source's share by some slots, all of them for a small source. So the count of a source's words
comes from its target, not from its slots: every source ends within a word of its target, whatever the block.

Cases: a null text has size 0; null sources form one source, weighed after all others; rows with the same id and text
lie side by side and are counted each; an empty table, or one without words, has targets 0 and takes nothing; other
columns aren't touched. Reruns agree, as order depends on hashes of the rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, narrow

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SLOTS, MIN_BLOCK, MAX_BLOCK = 1 << 20, 8, 256
GOLDEN = 0.6180339887498949
#: Rows of a bucket, the unit within which positions are found by sorting.
BUCKET_ROWS = 4096
CHUNK = 1 << 12


def words(text: Column) -> Column:
    """Number of runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources: (source, source_size, n_rows), a row a source. Adds weight, target.

    A source is capped exactly if its size per weight is below the water level, so sorting by that ratio and summing up
    finds the level in one pass.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    ahead, all_rows = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = sources.withColumn("weight", pick).withColumn("total", F.sum("source_size").over(all_rows))
    level = level.withColumn("capped", MAX_EPOCHS * F.coalesce(F.sum("source_size").over(ahead), F.lit(0))).withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
    level = level.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    # The first source that its cap doesn't bind fixes the level for all.
    level = level.withColumn("at", F.min(F.when(MAX_EPOCHS * F.col("source_size") >= F.col("level") * F.col("weight"), F.struct(F.row_number().over(ratio).alias("r"), "level"))).over(all_rows))
    target = F.least((MAX_EPOCHS * F.col("source_size")).cast("double"), F.col("at.level") * F.col("weight"))
    return level.select("source", "source_size", "n_rows", "weight", F.coalesce(target, F.lit(0.0)).alias("target"), "total")


def schedule(spark, mix: DataFrame, slots: int) -> DataFrame:
    """(slot, source_id, rank) for slots 0 to slots - 1; mix: (source_id, upto), upto being the cumulative share (at most 1)."""
    bounds = mix.select("source_id", F.col("upto"), F.coalesce(F.lag("upto").over(Window.orderBy("upto", "source_id")), F.lit(0.0)).alias("since")).filter("upto > since")
    point = (F.col("slot") + 0.5) * GOLDEN
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point))
    # Bounds are dealt to the cells they touch, so the join is on equality.
    cells = 1 << 12
    last = bounds.agg(F.max("upto")).first()[0]
    ranges = bounds.withColumn("upto", F.when(F.col("upto") >= (last or 1.0), 2.0).otherwise(F.col("upto")))
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("since") * cells), F.least(F.floor(F.col("upto") * cells), F.lit(cells)))))
    placed = points.withColumn("cell", F.floor(F.col("u") * cells)).join(F.broadcast(ranges), "cell").filter("u >= since AND u < upto").select("slot", "source_id")
    placed = materialize(placed.withColumn("chunk", F.floor(F.col("slot") / CHUNK)), "slots")
    sums = placed.groupBy("source_id", "chunk").agg(F.count("*").alias("n"))
    ahead = sums.withColumn("ahead", F.sum("n").over(Window.partitionBy("source_id").orderBy("chunk")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("source_id", "chunk").orderBy("slot")) - 1
    return placed.withColumn("within", within).join(ahead, ["source_id", "chunk"]).select("slot", "source_id", (F.col("ahead") + F.col("within")).alias("rank"))


def placed_ranks(mix: DataFrame, slots: DataFrame, n_slots: int, block: int) -> DataFrame:
    """(source_id, rank, position) of all blocks that sources give; mix: (source_id, source_words).

    A rank's position is its slot. Ranks beyond a source's slots, a few at most, are spread evenly over the mix, and slots
    beyond its words stay empty.
    """
    used = slots.groupBy("source_id").agg(F.count("*").alias("slots"))
    blocks = F.ceil(F.col("source_words") / block).alias("blocks")
    wanted = materialize(mix.join(used, "source_id", "left").select("source_id", blocks, F.coalesce("slots", F.lit(0)).alias("slots")), "wanted")
    dealt = slots.join(narrow(wanted.select("source_id", "blocks")), "source_id").filter("rank < blocks").select("source_id", "rank", F.col("slot").cast("double").alias("position"))
    more = wanted.filter("blocks > slots").select("source_id", "blocks", "slots", F.explode(F.sequence("slots", F.col("blocks") - 1)).alias("rank"))
    position = n_slots * (F.col("rank") - F.col("slots") + 0.5) / (F.col("blocks") - F.col("slots"))
    return dealt.unionByName(more.select("source_id", "rank", position.alias("position")))


def pieces(rows: DataFrame, ranks: DataFrame, block: int) -> DataFrame:
    """(row, epoch, rank, first, words, position): rows (row, size, source_id, source_size, start, source_words) cut into
    blocks and joined with their places; first tells a row's first piece of an epoch."""
    epochs = rows.filter("size > 0 AND start < source_words").select("row", "size", "source_id", "source_words", F.explode(F.array(*map(F.lit, range(MAX_EPOCHS)))).alias("epoch"), (F.col("epoch") * F.col("source_size") + F.col("start")).alias("since"))
    epochs = epochs.filter("since < source_words").withColumn("upto", F.least(F.col("since") + F.col("size"), F.col("source_words")))
    number = lambda c: F.floor(c / block)
    cut = epochs.withColumn("rank", F.explode(F.sequence(number(F.col("since")), number(F.col("upto") - 1))))
    words_of = F.least("upto", (F.col("rank") + 1) * block) - F.greatest("since", F.col("rank") * block)
    return cut.join(ranks, ["source_id", "rank"]).select("row", "epoch", "rank", (F.col("rank") == number(F.col("since"))).alias("first"), words_of.alias("words"), "position")


def _planned(documents: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(rows, pieces, schedule, block); rows is mix_plan's plan with source_id and row, a number, but without taken."""
    spark = documents.sparkSession
    sizes = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("h"), words(F.col(text_col)).alias("size"))
    sizes = materialize(sizes.withColumn("key", F.xxhash64("doc_id", "h", F.lit(seed))), "sizes")
    sources = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), "sources")
    mix = targets(sources).withColumn("source_id", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    upto = F.try_divide(F.sum("target").over(Window.orderBy("source_id")), F.col("total"))
    mix = materialize(mix.withColumn("upto", F.coalesce(upto, F.lit(0.0))), "targets")
    total = mix.agg(F.max("total")).first()[0] or 0
    block = min(MAX_BLOCK, max(MIN_BLOCK, -(-total // SLOTS)))
    n_slots = -(-total // block)
    slots = materialize(schedule(spark, mix.select("source_id", "upto"), n_slots), "schedule")
    # A cap holds for whole words, too: no source gives more than its epochs have. One with a target gives a word at least.
    source_words = F.least(F.ceil("target"), MAX_EPOCHS * F.col("source_size"))
    mix = materialize(mix.select("source", "source_id", "source_size", "n_rows", "target", source_words.alias("source_words")), "mix")
    rows = sizes.join(narrow(mix), sizes.source.eqNullSafe(mix.source)).drop(mix.source)
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("key", 24), F.ceil(F.col("n_rows") / BUCKET_ROWS)))
    sums = rows.groupBy("source_id", "bucket").agg(F.sum("size").alias("n"))
    ahead = sums.withColumn("ahead", F.sum("n").over(Window.partitionBy("source_id").orderBy("bucket")) - F.col("n")).drop("n")
    ahead = narrow(materialize(ahead, "buckets"))
    inner = F.sum("size").over(Window.partitionBy("source_id", "bucket").orderBy("key", "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("inner", inner).join(ahead, ["source_id", "bucket"]).withColumn("start", F.col("ahead") + F.col("inner"))
    rows = materialize(rows.select("doc_id", "h", "size", "source", "source_id", "source_size", "target", "start", "source_words").withColumn("row", F.monotonically_increasing_id()), "rows")
    ranks = placed_ranks(mix, slots, n_slots, block)
    return rows, pieces(rows, ranks, block), slots, block


def mix_plan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """(plan, schedule, block).

    plan has a row for each row of documents: (doc_id, h, size, source, source_size, target, start, source_words, taken).
    start is the document's first word in its source's shuffled stream; the mix takes source_words of the source, words
    ``[0, source_words)`` of its stream and of the stream's repeats; taken is the document's part of them.
    """
    rows, joined, slots, block = _planned(documents, id_col, text_col, source_col, seed)
    taken = joined.groupBy("row").agg(F.sum("words").alias("taken"))
    plan = rows.join(taken, "row", "left").select("doc_id", "h", "size", "source", "source_size", "target", "start", "source_words", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return plan, slots, block


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows of documents with all their columns: a row for each epoch that takes words of the document.

    Rows are in the order of the slots that their first words stand in. Documents stay whole, so the one at the end of a
    source's stretch may add some words more.
    """
    rows, joined, _, _ = _planned(documents, id_col, text_col, source_col, 0)
    # A place for each row of the plan and epoch that takes part of it; documents of the same id and text share theirs evenly.
    firsts = joined.filter("first").groupBy("row").agg(F.collect_list(F.struct("position", "rank", "epoch")).alias("places"))
    held = rows.filter("size > 0").join(firsts, "row", "left").select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), F.col("source").alias("__s"), "start", "places")
    places = F.sort_array(F.flatten(F.collect_list(F.transform(F.coalesce("places", F.array().cast("array<struct<position:double,rank:bigint,epoch:int>>")), lambda x: F.struct(x["epoch"].alias("epoch"), F.col("start").alias("start"), x["position"].alias("position"), x["rank"].alias("rank"))))))
    copies = held.groupBy("__d", "__h", "__s").agg(places.alias("__places"), F.count("*").cast("int").alias("__rows")).filter("size(__places) > 0")
    # Every __rows-th place from the first on: each of the equal rows stands once an epoch.
    mine = F.filter("__places", lambda x, i: i % F.col("__rows") == 0)
    copies = narrow(materialize(copies.select("__d", "__h", "__s", mine.alias("__places")), "copies"))
    held = documents.select(F.struct(*documents.columns).alias("__row"), F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.xxhash64(text_col).alias("__hash"))
    on = F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__hash") == F.col("__h")) & F.col("__source").eqNullSafe(F.col("__s"))
    out = held.join(copies, on).select("__row", F.explode("__places").alias("__place"))
    return out.orderBy("__place.position", "__place.rank", "__place.epoch", "__place.start").select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    plan, _, _ = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")
