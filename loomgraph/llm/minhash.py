"""Near-duplicate documents by MinHash: many universal hash minima, banding, verification, connected components.

A document's words are the runs without ASCII white space, A-Z lower-cased; its set are the distinct shingles of
``width`` words (the whole sequence if there are fewer words). Two documents are linked if their sets' Jaccard similarity
is at least ``percent`` / 100, confirmed on the full sets.

1. Documents with the same set form a class, known by a 128-bit digest of the sorted set; only one document a class, the
   one with the least id, goes on. So groups of copies cost a row each.
2. PERMS minima of the universal family ``(a x + b mod 2^64) >> 32`` over 32-bit shingle hashes, in BANDS bands. At
   similarity 0.8 a pair misses all bands with probability (1 - 0.8^ROWS)^BANDS, 3e-6 for 5 rows in 32 bands.
3. ``components.bucket_components`` finds the components of links inside buckets: a pair's sizes and the share of
   equal minima (at least MIN_SHARE, five standard deviations below 0.8) come first, then the full sets, rebuilt from the
   texts of the candidates alone.

Cases: a null text, or one without words, has an empty set, is linked with nothing and kept; fewer words than ``width``
make one shingle; a text of any length is used whole, hashed in pieces; ids are meant to be unique, and of rows that share
one each has the component of its own text's class, as links are between rows, not ids; so rows that repeat have the same
component, and all of them are kept if its id is theirs; rows without an id take the component of their class, or null and
kept if the class has no id; similarity of exactly ``percent`` links; an empty table gives an empty result; other columns
aren't touched.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, in_batches, materialize, narrow, release, stored
from .components import bucket_components, shared_buckets
from .hashing import SEQUENCE_BASE, mix, sequences, words

BANDS, ROWS = 32, 5
PERMS = BANDS * ROWS
MIN_SHARE = 0.64
#: Bytes of texts that are hashed at a time.
PIECE_BYTES = 1 << 18
#: Shingles hashed at a time, so that a very long text needs no more memory than others.
PIECE = 4096
#: Parameters of the hash family; any odd multipliers do, and all workers must use the same.
_RANDOM = np.random.default_rng(20240229)
MULTIPLY = _RANDOM.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RANDOM.integers(0, 1 << 63, PERMS, dtype=np.uint64)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles."""
    parts = [(t or "").encode().lower() for t in texts]
    w, starts = words(b"\n".join(parts) + b"\n")
    ends = np.searchsorted(starts, np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))))
    n = max(0, len(w) - width + 1)
    h = w[:n].copy()
    for i in range(1, width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += w[i : i + n]
    h = mix(h)
    out, since = [], 0
    for upto in ends.tolist():
        if upto - since >= width:
            s = np.sort(h[since : upto - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:  # the whole sequence, with its length in the hash
            out.append(sequences(w[since:upto] + np.uint64(upto - since), np.array([0]), np.array([upto - since]), SEQUENCE_BASE) if upto > since else w[:0])
        since = upto
    return out


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return shingle_sets([text], width)[0]


def pieces(texts: pa.Array):
    """Runs of texts of about PIECE_BYTES, as lists."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= PIECE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def signature(shingles: np.ndarray) -> np.ndarray:
    """PERMS minima, each 32 bits."""
    out = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
    x = shingles & np.uint64(0xFFFFFFFF)
    step = np.empty((min(PIECE, len(x)), 1), np.uint64)
    for i in range(0, len(x), PIECE):
        part = x[i : i + PIECE]
        step = part[:, None] * MULTIPLY[None, :] if len(part) * PERMS <= 1 << 16 else None
        if step is not None:
            step += ADD
            np.minimum(out, step.min(axis=0), out=out)
        else:  # a row of the matrix at a time stays in the cache
            for j in range(PERMS):
                y = part * MULTIPLY[j]
                y += ADD[j]
                m = y.min()
                if m < out[j]:
                    out[j] = m
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(sig[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) - (1 << 63) for i in range(BANDS)]


def signed_sets(documents: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, n_shingles, digest, payload, keys), a row for each row of documents; the last three are null for the empty set.

    payload is the number of shingles and a byte of each minimum.
    """

    def scan(batches):
        for batch in batches:
            rows = []
            for s in (s for texts in pieces(batch.column(2)) for s in shingle_sets(texts, width)):
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                sig = signature(s)
                rows.append((len(s), xxhash.xxh3_128_digest(s), len(s).to_bytes(8, "little") + sig.astype(np.uint8).tobytes(), band_keys(sig)))
            cols = zip(*rows) if rows else [()] * 4
            types = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "h", "n_shingles", "digest", "payload", "keys"])

    return in_batches(_keyed(documents, id_col, text_col)).mapInArrow(scan, "doc_id long, h long, n_shingles long, digest binary, payload binary, keys array<long>")


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


#: A payload's number of shingles and minima.
HEAD = 8 + PERMS


def matcher(width: int, percent: int) -> Callable:
    """For payloads that go on with band keys and text: which pairs are linked, each in the first bucket that both share."""
    least = int(PERMS * MIN_SHARE * percent / 80)

    def match(payload: list[bytes], i: np.ndarray, j: np.ndarray, keys: np.ndarray) -> np.ndarray:
        heads = np.frombuffer(b"".join(x[: HEAD + 8 * BANDS] for x in payload), np.uint8).reshape(len(payload), -1)
        sizes = np.ascontiguousarray(heads[:, :8]).view(np.int64)[:, 0]
        bands = np.ascontiguousarray(heads[:, HEAD:]).view(np.int64)
        out, sets = [np.empty(0, np.int64)], {}
        for since in range(0, len(i), PIECE):
            kept = np.arange(since, min(since + PIECE, len(i)))
            kept = kept[100 * np.minimum(sizes[i[kept]], sizes[j[kept]]) >= percent * np.maximum(sizes[i[kept]], sizes[j[kept]])]
            # Bytes of different minima agree by chance in 1 of 256.
            kept = kept[(heads[i[kept], 8:HEAD] == heads[j[kept], 8:HEAD]).sum(axis=1) >= least]
            shared = bands[i[kept]] == bands[j[kept]]
            kept = kept[bands[i[kept], shared.argmax(axis=1)] == keys[kept]]
            good = []
            for k in kept.tolist():
                for x in (i[k], j[k]):
                    if x not in sets:
                        sets[x] = shingle_set(payload[x][HEAD + 8 * BANDS :].decode(), width)
                good.append(linked(sets[i[k]], sets[j[k]], percent))
            out.append(kept[np.array(good, bool)])
        return np.concatenate(out)

    return match


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verifier(texts: Callable[[DataFrame], DataFrame], payloads: DataFrame, width: int, percent: int) -> Callable[[DataFrame], DataFrame]:
    """A function that keeps the linked ones of pairs (a, b). texts gives (id, text) of ids, payloads: (id, payload)."""

    least = int(PERMS * MIN_SHARE * percent / 80)

    def rough(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HEAD) for i in (2, 3))
            nx, ny = (np.ascontiguousarray(z[:, :8]).view(np.uint64)[:, 0].astype(np.int64) for z in (x, y))
            keep = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & ((x[:, 8:] == y[:, 8:]).sum(axis=1) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def full(batches):
        held, at = np.empty(0, np.uint64), None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != at:
                    held, at = shingle_set(x.as_py(), width), a
                keep.append(linked(held, shingle_set(y.as_py(), width), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        asked = narrow(stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked"))
        held = materialize(payloads.join(asked, "id", "left_semi"), "heads")
        heads = gathered(held)
        with_payload = pairs.join(heads.select(F.col("id").alias("a"), F.col("payload").alias("p")), "a").join(heads.select(F.col("id").alias("b"), F.col("payload").alias("q")), "b")
        near = gathered(stored(in_batches(with_payload.select("a", "b", "p", "q")).mapInArrow(rough, "a long, b long"), "near"))
        release(held)
        mine = materialize(texts(near.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "texts")
        both = near.join(mine.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(mine.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
        return in_batches(both.select("a", "b", "x", "y")).mapInArrow(full, "a long, b long")

    return verify


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of documents, and h, the hash of the text, if asked for."""
    base = materialize(signed_sets(documents, width, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sets")
    there = base.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    # A class is known by its first row, so that rows that share an id stay apart.
    reps = materialize(there.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("size")).select("digest", "size", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("id")), "reps")
    # Copies are left out; what stays is a row a class.
    repeated = reps.filter("size > 1").select("digest", "id")
    copies = there.select("digest", "row").join(narrow(materialize(repeated, "repeated")), "digest").filter("row <> id").select("row")
    signed = there.join(narrow(materialize(copies, "copies")), "row", "left_anti").withColumnRenamed("row", "id")
    members = materialize(shared_buckets(signed.select(F.explode("keys").alias("key"), "id")), "members")
    keyed = _keyed(documents, id_col, text_col)
    several = not there.groupBy("doc_id", "h").count().filter("count > 1").isEmpty()

    def texts(asked: DataFrame) -> DataFrame:
        """(id, text) of the asked ids, each once."""
        wanted = signed.select("id", F.col("doc_id").alias("__d"), F.col("h").alias("__h")).join(narrow(stored(asked, "wanted")), "id", "left_semi")
        wanted = narrow(stored(wanted, "wanted-texts"))
        found = keyed.join(wanted, (F.col("doc_id") == F.col("__d")) & (F.col("h") == F.col("__h"))).select("id", "text")
        return found.dropDuplicates(["id"]) if several else found

    def whole(asked: DataFrame) -> DataFrame:
        """Payload, band keys and text of the asked ids."""
        heads = signed.join(narrow(asked), "id", "left_semi").select("id", "payload", "keys")
        both = heads.join(texts(asked), "id").select("id", "payload", "keys", "text")

        def glue(batches):
            for batch in batches:
                rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p + np.array(k, np.int64).tobytes() + t.as_py().encode() for p, k, t in rows], pa.binary())], ["id", "payload"])

        return in_batches(both).mapInArrow(glue, "id long, payload binary")

    found = bucket_components(members, whole, verifier(texts, signed.select("id", "payload"), width, percent), matcher(width, percent), exact_match=True)
    # Components are known by a row so far; they get the least id. Classes of one row without a link need no join back.
    told = materialize(reps.join(narrow(found), "id").select("digest", "rep", "component"), "told")
    least = told.groupBy("component").agg(F.min("rep").alias("least"))
    told = told.join(narrow(materialize(least, "least")), "component").select(F.col("digest").alias("__digest"), "least")
    known = reps.join(narrow(materialize(told, "linked")), F.col("digest") == F.col("__digest"), "left").select("digest", F.coalesce("least", "rep").alias("component"), "rep", "size").filter("size > 1 OR component <> rep")
    known = narrow(materialize(known.select("digest", "component"), "known"))
    out = base.select("doc_id", "h", "n_shingles", "digest").join(known, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", *["h"] * with_hash, "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def drop_near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, all columns. Of rows that share an id, each goes or stays by its own text."""
    gone = near_duplicates(documents, width, percent, id_col, text_col, with_hash=True).filter("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("h").alias("__h")).distinct()
    gone = narrow(materialize(gone, "gone"))
    return documents.join(gone, documents[id_col].cast("long").eqNullSafe(gone["__gone"]) & (F.xxhash64(documents[text_col]) == gone["__h"]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT e.b, min(r.c) FROM r JOIN e ON e.a = r.id JOIN recurring.r k ON k.id = e.b GROUP BY e.b, k.c HAVING min(r.c) < k.c)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM d JOIN r ON r.id = d.doc_id LEFT JOIN n USING (doc_id)
"""
