"""Exact deduplication behind a two-pass Bloom filter, in DataFrame functions only.

Texts are equal when identical after each run of ASCII white space became one space; a null text counts as empty.

Pass 1 finds what is in a blocked Bloom filter twice: a row's cell is two bits of a 64-bit word, both from one hash of the
text's SHA-256, and cells are counted. A row sends the number of its cell, 8 bytes, and Spark adds counts up before the
shuffle, so a text with millions of copies sends one number a task. The bits of cells that two rows or more have make the
filter. (Bit sets of whole tasks, merged, would send more: a task sees few of all rows, so its set is sparse.)
Pass 2 tests every row: a row whose bits aren't all in the filter is surely unique and passes straight through. Only the
other rows are grouped by their SHA-256, again summed up before the shuffle.

The filter has FILTER_WORDS words at most, which bounds its broadcast; a larger one is folded, words with equal low bits
becoming one. That keeps it right, and lets more unique rows through to the grouping once some hundred million texts are
repeated; sessions with large executors may raise the bound.

Cases: null ids sort after all others, so a null id is kept only in a group without any other; of rows with the same
text and id one stays; a text of any length is hashed whole; an empty table gives an empty result; other columns, whatever their names, aren't touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, narrow

ROWS_PER_WORD = 4
FILTER_WORDS = 1 << 22


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def word_count(rows: int) -> int:
    """A power of two of words, for ROWS_PER_WORD rows each."""
    return 1 << max(6, (rows // ROWS_PER_WORD).bit_length())


def cell(digest: Column, words: int) -> Column:
    """Number of the row's cell: a word below ``words``, then two bits' places of six binary digits each."""
    h = F.xxhash64(digest)
    return F.shiftleft(h.bitwiseAND(F.lit(words - 1)), 12).bitwiseOR(F.shiftrightunsigned(h, 52))


def _word(cell: Column) -> Column:
    return F.shiftright(cell, 12)


def _bits(cell: str) -> Column:
    return F.expr(f"shiftleft(1L, int(({cell} >> 6) & 63)) | shiftleft(1L, int({cell} & 63))")


def repeated_cells(cells: DataFrame, words: int) -> tuple[DataFrame, int]:
    """Pass 1: the filter (w, bits) of the cells that two rows or more have, and its size in words; cells: (cell)."""
    twice = cells.groupBy("cell").agg(F.count("*").alias("c")).filter("c > 1").select(_word(F.col("cell")).alias("w"), _bits("cell").alias("bits"))
    made = materialize(twice.groupBy("w").agg(F.bit_or("bits").alias("bits")), "bloom")
    if words <= FILTER_WORDS or made.count() <= FILTER_WORDS:
        return made, words
    folded = made.groupBy(F.col("w").bitwiseAND(F.lit(FILTER_WORDS - 1)).alias("w")).agg(F.bit_or("bits").alias("bits"))
    return materialize(folded, "bloom"), FILTER_WORDS


def with_flag(df: DataFrame, cell: str, bloom: DataFrame, size: int, flag: str) -> DataFrame:
    """Pass 2: flag is true for rows whose bits are in the filter; false rows are unique for sure."""
    held = F.broadcast(bloom.select(F.col("w").alias("__w"), F.col("bits").alias("__bits")))
    out = df.join(held, _word(F.col(cell)).bitwiseAND(F.lit(size - 1)) == F.col("__w"), "left")
    return out.withColumn(flag, F.coalesce(F.col("__bits").bitwiseAND(_bits(cell)) == _bits(cell), F.lit(False))).drop("__w", "__bits")


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of documents: (doc_id, keep_id, group_size, kept, digest)."""
    keys = materialize(
        documents.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest")).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    words = word_count(keys.count())
    keys = keys.withColumn("cell", cell(F.col("digest"), words))
    tested = with_flag(keys, "cell", *repeated_cells(keys.select("cell"), words), "maybe")
    unique = tested.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    maybe = tested.filter("maybe")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = maybe.groupBy("digest").agg(first, F.count("*").alias("size")).filter("size > 1")
    groups = narrow(materialize(groups, "groups"))
    dealt = maybe.join(groups, "digest", "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept"),
        "digest",
    )
    return unique.unionByName(dealt)


def drop_exact_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Unique rows aren't shuffled, but for those that the filter can't tell."""
    words = word_count(documents.count())
    held = documents.select(F.struct(*documents.columns).alias("__row"), F.col(id_col).alias("__id"), text_digest(F.col(text_col)).alias("__digest")).withColumn("__cell", cell(F.col("__digest"), words))
    tested = with_flag(held, "__cell", *repeated_cells(held.select(F.col("__cell").alias("cell")), words), "__maybe")
    order = F.struct(F.col("__id").isNull(), F.col("__id"), F.xxhash64("__row"))
    best = tested.filter("__maybe").groupBy("__digest").agg(F.min_by("__row", order).alias("__row"))
    return tested.filter("NOT __maybe").select("__row").unionByName(best.select("__row")).select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    rows = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""
