"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` in the text with A-Z lower-cased.

1. ``term_counts`` counts the benchmark's terms in all documents. A phrase with a term that no document has is done.
2. ``build_index`` stores postings (document, position, term) as a table, for the terms that searches start from. Each
   file is the shard of the documents that a task read, sorted by term, so it is built without a shuffle and a frequent
   term is spread over all shards.
3. ``phrase_candidates`` takes the two rarest terms of each phrase, shifts both lists by the terms' offsets and
   intersects them: an equality join on (document, position), where no key is frequent.
4. ``exact_matches`` compares the phrase with the words of the surviving documents.
``proximity_matches`` finds documents where all terms of a phrase lie within a window, in any order.

A document is known by (id, 64-bit hash of its text), so rows that repeat have the same result, computed once.

Cases: a null or wordless text has no words and isn't hit; benchmark items without words or without an id are left out;
repeated items count once; several texts with one item id count as that item; a text of any length is used whole; empty
tables give no hits; other columns aren't touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ASCII_UPPER, ascii_lower, materialize, narrow

WIDTH = 10
#: What separates words while upper-case letters are still there, and after lower-casing.
RAW_SEPARATOR = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: How many of a phrase's rarest terms are intersected before the exact comparison.
RAREST = 2


def raw_words(text: Column) -> Column:
    """Words with their case. A text that starts or ends with a separator has an empty first or last part; it goes."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), RAW_SEPARATOR), lambda w: w != "")


def lower_words(text: Column) -> Column:
    return F.transform(raw_words(text), lambda w: F.translate(w, ASCII_UPPER, ASCII_UPPER.lower()))


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))


def _tokens(keyed: DataFrame, *keys: str) -> DataFrame:
    """A row for each word, 0-based positions. The first part is kept if empty (position -1 then), so positions hold."""
    parts = F.split(F.coalesce(F.col("text"), F.lit("")), RAW_SEPARATOR)
    first = F.when(F.coalesce(F.substring("text", 1, 1), F.lit("")).rlike(f"^({RAW_SEPARATOR})?$"), 1).otherwise(0)
    return keyed.select(*keys, first.alias("shift"), F.posexplode(parts).alias("p", "raw")).select(*keys, (F.col("p") - F.col("shift")).alias("pos"), ascii_lower(F.col("raw")).alias("term"))


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(phrases, owners): phrases (phrase_id, words) are the distinct windows of all items; owners (phrase_id, item)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), lower_words(F.col(text_col)).alias("words")).filter("item IS NOT NULL AND size(words) > 0")
    starts = F.when(F.size("words") <= width, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.size("words") - (width - 1)))
    cut = items.select("item", "words", F.explode(starts).alias("s")).select("item", F.array_join(F.expr(f"slice(words, s, {width})"), " ").alias("phrase"))
    cut = materialize(cut.distinct(), "windows")
    phrases = materialize(cut.select("phrase").distinct().withColumn("phrase_id", F.monotonically_increasing_id()), "phrases")
    owners = materialize(cut.join(phrases, "phrase").select("phrase_id", "item"), "owners")
    return phrases.select("phrase_id", F.split("phrase", " ").alias("words")), owners


def phrase_terms(phrases: DataFrame) -> DataFrame:
    """(phrase_id, offset, term)"""
    return phrases.select("phrase_id", F.posexplode("words").alias("offset", "term"))


def term_counts(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, count) over all documents, for the given terms that occur."""
    wanted = narrow(materialize(terms.select("term").distinct(), "terms"))
    return materialize(_tokens(keyed).join(wanted, "term").groupBy("term").agg(F.count("*").alias("count")), "counts")


def ranked_terms(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase_id, offset, term, rank) with rank 1 for the rarest; phrases with a term that never occurs are left out."""
    known = terms.join(narrow(counts), "term", "left")
    order = Window.partitionBy("phrase_id").orderBy("count", "term", "offset")
    whole = F.min(F.coalesce("count", F.lit(0))).over(Window.partitionBy("phrase_id"))
    return known.withColumn("least", whole).filter("least > 0").withColumn("rank", F.row_number().over(order)).select("phrase_id", "offset", "term", "rank")


def build_index(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """The index (term_id, doc_id, h, pos) of the given (term, term_id)."""
    found = _tokens(keyed, "doc_id", "h").join(narrow(terms), "term").select("term_id", "doc_id", "h", "pos")
    return materialize(found.sortWithinPartitions("term_id", "doc_id", "h", "pos"), "postings")


def phrase_candidates(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc_id, h, phrase_id, start): where the offset-adjusted lists of a phrase's two rarest terms meet."""
    pick = lambda r, *names: ranked.filter(F.col("rank") == r).select("phrase_id", F.col("offset").alias(names[0]), F.col("term_id").alias(names[1]))
    plan = narrow(materialize(pick(1, "offset", "term_id").join(pick(2, "offset2", "term_id2"), "phrase_id", "left"), "plan"))
    first = index.join(plan, "term_id").withColumn("start", F.col("pos") - F.col("offset")).filter("start >= 0")
    first = first.select("doc_id", "h", "phrase_id", "start", "term_id2", (F.col("start") + F.col("offset2")).alias("pos2"))
    single = first.filter("term_id2 IS NULL").select("doc_id", "h", "phrase_id", "start")
    second = index.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("pos").alias("p2"), F.col("term_id").alias("t2"))
    met = first.join(second, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (F.col("pos2") == F.col("p2")) & (F.col("term_id2") == F.col("t2")), "left_semi")
    return met.select("doc_id", "h", "phrase_id", "start").unionByName(single).distinct()


def exact_matches(keyed: DataFrame, candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, h, hits): the candidates that occur word for word, as an array of (start, length, phrase_id) a document."""
    told = candidates.join(narrow(phrases), "phrase_id").select("doc_id", "h", F.struct("start", F.size("words").alias("length"), "phrase_id", F.array_join("words", " ").alias("phrase")).alias("c"))
    told = told.groupBy("doc_id", "h").agg(F.collect_list("c").alias("c"))
    told = narrow(materialize(told, "candidates"), 20_000)
    same = lambda a: a.doc_id.eqNullSafe(told.doc_id) & (a.h == told.h)
    texts = keyed.join(told, same(keyed)).select(keyed.doc_id, keyed.h, "text", "c")
    # The words are bound as a lambda's variable, else Catalyst would put the split inside the filter, once a candidate.
    same_words = lambda words, c: ascii_lower(F.array_join(F.slice(words, c.start + 1, c.length), " ")) == c.phrase
    hits = F.transform(F.array(raw_words(F.col("text"))), lambda words: F.filter("c", lambda c: same_words(words, c)))[0]
    checked = texts.select("doc_id", "h", hits.alias("hits"))
    hits = F.expr("transform(array_distinct(hits), x -> struct(x.start AS start, x.length AS length, x.phrase_id AS phrase_id))")
    return checked.filter("size(hits) > 0").select("doc_id", "h", hits.alias("hits")).dropDuplicates(["doc_id", "h"])


def _start(documents: DataFrame, phrases: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    keyed = _keyed(documents, id_col, text_col)
    terms = materialize(phrase_terms(phrases), "phrase-terms")
    counts = term_counts(keyed, terms).withColumn("term_id", F.xxhash64("term"))
    ranked = materialize(ranked_terms(terms, counts).withColumn("term_id", F.xxhash64("term")), "ranked")
    return keyed, counts, ranked


def phrase_matches(documents: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, hits) of the phrases (phrase_id, words) in documents, exact."""
    keyed, _, ranked = _start(documents, phrases, id_col, text_col)
    anchors = materialize(ranked.filter(F.col("rank") <= RAREST).select("term", "term_id").distinct(), "anchors")
    candidates = phrase_candidates(build_index(keyed, anchors), ranked)
    return exact_matches(keyed, candidates, phrases)


def proximity_matches(documents: DataFrame, phrases: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, phrase_id, pos): positions of the rarest term with every other term of the phrase at most slop words away.

    Lists are met by blocks of slop + 1 words, from the rarest term on.
    """
    keyed, counts, ranked = _start(documents, phrases, id_col, text_col)
    index = build_index(keyed, materialize(ranked.select("term", "term_id").distinct(), "anchors"))
    span = slop + 1
    needed = ranked.groupBy("phrase_id", "term_id").agg(F.min("rank").alias("rank"))
    n_terms = needed.groupBy("phrase_id").agg(F.count("*").alias("n"))
    rarest = needed.filter("rank = 1").join(n_terms, "phrase_id").select("phrase_id", "term_id", "n")
    near = index.join(narrow(materialize(rarest, "plan")), "term_id").select("doc_id", "h", "phrase_id", "pos", "n")
    others = narrow(materialize(needed.filter("rank > 1").select("phrase_id", F.col("term_id").alias("t2")), "others"))
    asked = near.join(others, "phrase_id", "left").select("*", F.explode(F.expr(f"array(pos div {span} - 1, pos div {span}, pos div {span} + 1)")).alias("block"))
    have = index.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("pos").alias("p2"), F.col("term_id").alias("t3"), F.expr(f"pos div {span}").alias("b2"))
    on = F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (F.col("t2") == F.col("t3")) & (F.col("block") == F.col("b2")) & (F.abs(F.col("pos") - F.col("p2")) <= slop)
    met = asked.join(have, on, "left_semi").groupBy("doc_id", "h", "phrase_id", "pos", "n").agg(F.count_distinct("t2").alias("k")).filter("k = n - 1")
    return met.select("doc_id", "h", "phrase_id", "pos").unionByName(near.filter("n = 1").select("doc_id", "h", "phrase_id", "pos")).distinct()


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, h, n_hit, items) of the documents that any window occurs in; items are sorted as strings."""
    phrases, owners = windows(benchmark, item_col, "text", width)
    matches = materialize(phrase_matches(documents, phrases, id_col, text_col), "matches")
    covered = F.expr("""aggregate(array_sort(transform(hits, x -> struct(x.start AS a, x.start + x.length AS b))), struct(0 AS upto, 0L AS n),
        (s, x) -> struct(greatest(s.upto, x.b) AS upto, s.n + greatest(0, x.b - greatest(s.upto, x.a)) AS n), s -> s.n)""")
    found = matches.select("doc_id", "h", F.explode("hits.phrase_id").alias("phrase_id")).distinct().join(narrow(owners), "phrase_id")
    items = found.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumnsRenamed({"doc_id": "d2", "h": "h2"})
    return matches.select("doc_id", "h", covered.alias("n_hit")).join(items, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2"))).select("doc_id", "h", "n_hit", "items")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any window, with all their columns."""
    bad = narrow(materialize(contamination(documents, benchmark, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("__d"), F.col("h").alias("__h")), "contaminated"))
    return documents.join(bad, documents[id_col].eqNullSafe(bad["__d"]) & (F.xxhash64(documents[text_col]) == bad["__h"]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    hit = materialize(contamination(documents, benchmark), "contaminated")
    hit = narrow(hit.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), "n_hit", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("said")))
    sizes = documents.select("doc_id", F.xxhash64("text").alias("h"), F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    out = sizes.join(hit, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.sha2(F.coalesce("said", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(ws[s:s + 9], ' ') AS phrase, len(ws[s:s + 9]) AS n
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') AS phrase
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes WHERE len(ws) >= n)),
m AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS said FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(said, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
