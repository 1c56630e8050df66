"""Shared pieces of the corpus operators."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import delete, gathered, materialize, narrow, release, scratch_dir, scratch_path, stored

__all__ = ["ASCII_UPPER", "SPACE", "ascii_lower", "delete", "gathered", "in_batches", "materialize", "narrow", "release", "scratch_dir", "scratch_path", "stored", "worker_cache"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space as a Java and RE2 class: space and U+0009 to U+000D.
SPACE = "[ \\t-\\r]+"
BATCH_ROWS = 500


def ascii_lower(word: Column) -> Column:
    """A-Z lower-cased, all else as it is; for words, where most are pure ASCII."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, ASCII_UPPER, ASCII_UPPER.lower()))


def in_batches(df: DataFrame) -> DataFrame:
    """df, to be mapped over Arrow batches: lowers the session's batch size if it is above BATCH_ROWS.

    Batches are counted in rows, and a row may hold a long text, so small batches are what bounds a worker's memory.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def worker_cache(name: str, make):
    """An object that lives as long as the Python worker, so later tasks of the worker find it.

    Names are ``group`` or ``group:more``. A worker holds the objects of one group only, so those of operators that ran
    before don't pile up in its memory.
    """
    holder = sys.modules.setdefault("_loomgraph_worker", types.ModuleType("_loomgraph_worker"))
    group = name.split(":")[0]
    if getattr(holder, "group", None) != group:
        holder.group, holder.held = group, {}
    if name not in holder.held:
        holder.held[name] = make()
    return holder.held[name]
