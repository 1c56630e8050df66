"""Language identification by fusing four kinds of evidence in Bayes' rule.

- Text: a multinomial model over hashed byte trigrams, trained on a bounded sample of labelled rows (TRAIN_ROWS a
  language at most, the rows with the least hashes). Its log-likelihood counts in full up to TEXT_WEIGHT trigrams; longer
  texts are scaled down to that, as neighbouring trigrams aren't independent.
- Declared language (markup or metadata): P(declared | language), from grouped sums of the text's posteriors over all rows.
- Host: P(language | host), grouped sums per host, smoothed towards those of the host's address suffix, which are smoothed
  towards those of all rows. A row's own share is taken out of its host's sum first.
- Address suffix: as the middle level of these priors; it decides for hosts that are seen once.

A row is rejected if its text has no trigram of letters, if the text is far less likely under the best language than
trigrams drawn evenly from all known ones (so it isn't a language at all), or if the best posterior is under MIN_POSTERIOR, or if
the best language isn't among those asked for.

Cases: a null or empty text is rejected, with the language that other evidence gives and text_lang null; null declared
languages, hosts and suffixes are no evidence of their own (all null hosts form one host); languages with fewer than
MIN_LABELS labelled rows aren't learned, all others are, whatever their share; if none is learned all rows are rejected with
a null language; of languages that are as likely, the first by name is given; a text of any length is read whole, in pieces;
rows that repeat are judged alike; an empty table gives an empty result; other columns aren't touched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, materialize, narrow
from .urls import host, path

#: Rows of a language that train it at most; rows that a language needs to be learned.
TRAIN_ROWS, MIN_LABELS = 4000, 3
BUCKET_BITS = 16
TEXT_WEIGHT = 120
PRIOR_ROWS, DECLARED_ROWS = 20.0, 5.0
MIN_POSTERIOR = 0.5
ALPHA = 0.05
#: By how much (nats a trigram) a text may be less likely than evenly drawn known trigrams; random letters lie some 8 below.
SLACK = 2.0
PIECE = 1 << 20
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def trigrams(text: str | None):
    """Hashed trigrams of bytes, in pieces; runs of anything but letters count as one space, and words stay apart."""
    data = (text or "").encode().lower().translate(_LETTERS)
    for i in range(0, len(data), PIECE):
        a = np.frombuffer(data[i : i + PIECE + 2], np.uint8)
        if len(a) < 3:
            continue
        b = a.astype(np.uint32)
        g = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
        blank = a == 32
        g = g[~(blank[1:-1] | (blank[:-2] & blank[2:]))]
        yield g * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)


class Model:
    """Log-probabilities of buckets by language: what an unseen bucket has, and what each seen one has above that.

    Only seen pairs of bucket and language are held, so a rare language costs as much as its few rows have trigrams.
    """

    def __init__(self, buckets: np.ndarray, languages: np.ndarray, counts: np.ndarray, n: int):
        order = np.argsort(buckets, kind="stable")
        totals = np.bincount(languages, counts, n) + ALPHA * (1 << BUCKET_BITS)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(buckets, minlength=1 << BUCKET_BITS))))
        self.languages = languages[order].astype(np.int32)
        self.above = np.log1p(counts[order] / ALPHA).astype(np.float32)
        self.unseen = math.log(ALPHA) - np.log(totals)

    def total(self, text: str | None) -> tuple[np.ndarray, int]:
        """(log-likelihoods by language, trigrams) of a text."""
        total, k = np.zeros(len(self.unseen)), 0
        for g in trigrams(text):
            found, times = np.unique(g, return_counts=True)
            sizes = self.starts[found + 1] - self.starts[found]
            at = np.repeat(self.starts[found] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            total += np.bincount(self.languages[at], self.above[at] * np.repeat(times, sizes), len(total))
            k += len(g)
        return total + k * self.unseen, k


def train(rows: DataFrame, label: str, text: str, order: Column) -> tuple[list[str], Model | None, float]:
    """(languages, model, log-likelihood of a trigram that is as good as any known one).

    Spark counts; what comes to the driver are counts per language and bucket that occur.
    """
    labelled = rows.filter(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).alias("label"), F.col(text).alias("text"), order.alias("o"))
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_LABELS).collect()}
    languages = sorted(counts)
    if not languages:
        return [], None, 0.0
    # The hash is even over 64 bits, so a bound on it gives the rows with the least hashes, about TRAIN_ROWS of each.
    bounds = [(i, k, min((1 << 63) - 1, (1 << 64) * min(TRAIN_ROWS, counts[k]) // counts[k] - (1 << 63))) for i, k in enumerate(languages)]
    bounds = narrow(materialize(rows.sparkSession.createDataFrame(bounds, "lang int, known string, bound long").coalesce(1), "bounds"))

    def count(batches):
        for batch in batches:
            # Counted a batch at a time, so a task holds no counts of all languages.
            keys = [np.empty(0, np.int64)]
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys += [g.astype(np.int64) | lang << BUCKET_BITS for g in trigrams(x.as_py())]
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    sample = labelled.join(bounds, F.col("label") == F.col("known")).filter(F.col("o") <= F.col("bound")).select("lang", "text")
    summed = in_batches(sample).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = (np.asarray(summed.column(c)) for c in ("key", "n"))
    bucket = key & ((1 << BUCKET_BITS) - 1)
    return languages, Model(bucket, key >> BUCKET_BITS, n, len(languages)), -math.log(max(len(np.unique(bucket)), 2))


def score(rows: DataFrame, held: Model) -> DataFrame:
    """rows with, in place of text, t (log-likelihoods by language, scaled), p (their posteriors, all 0 without trigrams),
    n (trigrams) and mean (the best language's log-likelihood of a trigram)."""
    model = rows.sparkSession.sparkContext.broadcast(held)
    names = [c for c in rows.columns if c != "text"]
    fields = [rows.schema[c] for c in names]

    def scan(batches):
        for batch in batches:
            out = []
            for x in batch.column("text"):
                total, k = model.value.total(x.as_py())
                t = total * min(1.0, TEXT_WEIGHT / max(k, 1))
                p = np.exp(t - t.max())
                out.append((t.tolist(), (p / p.sum() * (k > 0)).tolist(), k, float(total.max() / max(k, 1))))
            cols = list(zip(*out)) if out else [()] * 4
            types = (pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, t) for c, t in zip(cols, types))], [*names, "t", "p", "n", "mean"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return in_batches(rows).mapInArrow(scan, f"{schema}, t array<double>, p array<double>, n long, mean double")


def identify(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(id, h, text_lang, lang, posterior, kept) of rows (id, h, text, declared, suffix, host); h is a hash of the text."""
    languages, model, even = train(rows, "declared", "text", F.xxhash64("id", "h"))
    if not languages:
        null = F.lit(None).cast("string")
        return rows.select("id", "h", null.alias("text_lang"), null.alias("lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    soft = materialize(score(rows, model), "scores")
    each = range(len(languages))
    read = (F.col("n") > 0).cast("double")
    count, sums = F.sum(read), [F.sum(F.col("p")[i]) for i in each]
    everything = soft.agg(count.alias("n"), *(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
    world = [((everything[f"s{i}"] or 0.0) + 1.0) / ((everything["n"] or 0.0) + len(languages)) for i in each]

    # One row a host, suffix and declared language.
    named = lambda c: [s.alias(f"{c}{i}") for i, s in enumerate(sums)]
    hosts = soft.groupBy(F.col("host").alias("host_"), F.col("suffix").alias("suffix_")).agg(count.alias("hn"), *named("h"))
    suffixes = soft.groupBy(F.col("suffix").alias("suffix__")).agg(count.alias("sn"), *named("s"))
    said = materialize(soft.filter("declared IS NOT NULL").groupBy("declared").agg(count.alias("dn"), *named("d")), "declared")
    spoken = said.agg(F.sum("dn").alias("n"), *(F.sum(f"d{i}").alias(f"a{i}") for i in each)).first()
    guess = DECLARED_ROWS * (F.col("dn") + 1) / ((spoken["n"] or 0.0) + 1)
    logs_said = [F.log((F.col(f"d{i}") + guess) / ((spoken[f"a{i}"] or 0.0) + DECLARED_ROWS)) for i in each]
    said = said.select(F.col("declared").alias("declared_"), F.array(*logs_said).alias("e"))

    out = soft.join(narrow(materialize(hosts, "hosts")), F.col("host").eqNullSafe(F.col("host_")) & F.col("suffix").eqNullSafe(F.col("suffix_")))
    out = out.join(narrow(materialize(suffixes, "suffixes")), F.col("suffix").eqNullSafe(F.col("suffix__")))
    out = out.join(narrow(materialize(said, "declared-logs")), F.col("declared") == F.col("declared_"), "left")
    fused = []
    for i in each:
        by_suffix = (F.col(f"s{i}") + PRIOR_ROWS * world[i]) / (F.col("sn") + PRIOR_ROWS)
        others, n_others = F.greatest(F.lit(0.0), F.col(f"h{i}") - F.col("p")[i]), F.greatest(F.lit(0.0), F.col("hn") - read)
        fused.append(F.col("t")[i] + F.log((others + PRIOR_ROWS * by_suffix) / (n_others + PRIOR_ROWS)) + F.coalesce(F.col("e")[i], F.lit(0.0)))
    # Stored, so that what follows reads one array; in one plan, each use of it would repeat all of the above.
    out = materialize(out.select("id", "h", "n", "mean", "p", F.array(*fused).alias("f")), "fused")
    names = F.array(*map(F.lit, languages))
    best = lambda c: names[F.array_position(c, F.array_max(c)).cast("int") - 1]
    posterior = 1 / F.aggregate("f", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("f")))
    out = out.select("id", "h", "n", "mean", F.when(F.col("n") > 0, best(F.col("p"))).alias("text_lang"), best(F.col("f")).alias("lang"), posterior.alias("posterior"))
    kept = (F.col("n") > 0) & (F.col("mean") >= even - SLACK) & (F.col("posterior") >= MIN_POSTERIOR)
    if keep is not None:
        kept = kept & F.col("lang").isin(keep)
    return out.select("id", "h", "text_lang", "lang", "posterior", kept.alias("kept"))


def document_rows(documents: DataFrame) -> DataFrame:
    """Rows for identify: the lang column is the declared language, the source is the host. The suffix is the source's top
    domain, if it has one, else the source without its number, which groups sources of one family."""
    domain, family = F.regexp_extract("source", r"\.([a-z]{2,})$", 1), F.regexp_replace("source", r"[0-9]+$", "")
    suffix = F.when(domain != "", domain).otherwise(family)
    return documents.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text", F.col("lang").alias("declared"), suffix.alias("suffix"), F.col("source").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows for identify: the lang attribute of the markup; the top domain and a two-letter first folder as suffix."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", " "), r"(?s)<[^<>]*>|&[a-zA-Z#0-9]{1,10};", " ")
    declared = F.lower(F.regexp_extract("html", r"""(?i)<html[^<>]*?\slang\s*=\s*["']?([a-zA-Z]{2,3})""", 1))
    url = F.col("url")
    folder = F.lower(F.regexp_extract(path(url), "^/([A-Za-z]{2})(?:/|$)", 1))
    suffix = F.concat(F.regexp_extract(host(url), "([^.]*)$", 1), F.lit("/"), folder)
    return pages.select(F.col("page_id").alias("id"), F.xxhash64("html").alias("h"), bare.alias("text"), F.when(declared != "", declared).alias("declared"), suffix.alias("suffix"), host(url).alias("host"))


def keep_languages(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """documents, all columns, without those rejected."""
    gone = identify(document_rows(documents), keep).filter("NOT kept").select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct()
    gone = narrow(materialize(gone, "rejected"))
    return documents.join(gone, documents["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(documents["text"]) == gone["__h"]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    found = identify(document_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select(F.col("id").alias("doc_id"), "text_lang", "lang", F.round("posterior", 6).alias("posterior"), "kept")


def query_pages(spark, sf_dir: str) -> DataFrame:
    found = identify(page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.select(F.col("id").alias("page_id"), "text_lang", "lang", F.round("posterior", 6).alias("posterior"), "kept")
