"""Token ids as length-delimited binary records, with a separate offset index.

File format. A file is a row of records, each framed like this (all numbers little-endian):

    u64 length | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of the payload

The checksum is CRC-32 c, masked as ``((c >> 15 | c << 17) + 0xa282ead8) mod 2^32``. A payload is ``u8 flags | i64 id |
token ids``; flag 1 says that the id is null, flag 2 that token ids are u32 rather than u16. A block of records ends with
an empty record, which readers skip. That record ends with the fixed byte A2, and this is what lets Spark's own text
writer store the blocks: the byte is its line separator. So files go to any Hadoop file system through Spark's commit
protocol, and tasks that are lost or run twice leave no half-written or double files.

Documents are sorted by id over all files (``part-N`` in the order of N). The index (doc_id, file, offset, length,
n_tokens, ...) is made from the committed files, whose checksums are verified on the way.

Vocabularies that drop white space give a text the ids of its words in a row; ``WordEncoder`` therefore remembers words.

Cases: a null text counts as empty and has the end id only; null ids come last; rows with the same id stand side by
side, each as a record; an empty table gives an empty folder; other columns aren't read.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_batches, materialize, narrow, scratch_path, worker_cache

END_ID = 1
#: Characters of text a file is made from, and payload bytes a block has at least.
FILE_CHARS, BLOCK_BYTES = 16_000_000, 1 << 20
SEPARATOR = b"\xa2"
NULL_ID, WIDE_IDS = 1, 2
#: Words that an encoder remembers before it starts afresh.
REMEMBERED = 250_000
#: ASCII characters that are neither letters, digits nor white space, but for the apostrophe, which may start a piece.
PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


END_OF_BLOCK = frame(b"")


def pack(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    return struct.pack("<Bq", (doc_id is None) * NULL_ID | wide * WIDE_IDS, doc_id or 0) + ids


def unpack(payload: bytes) -> tuple[int | None, array]:
    """Id and token ids."""
    flags, doc_id = struct.unpack_from("<Bq", payload)
    ids = array("I" if flags & WIDE_IDS else "H")
    ids.frombytes(payload[9:])
    return None if flags & NULL_ID else doc_id, ids


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of the records that aren't empty; ValueError where a checksum is wrong."""
    at, end = 0, len(content)
    while at < end:
        head = content[at : at + 8]
        (length,) = struct.unpack("<Q", head)
        payload = content[at + 12 : at + 12 + length]
        if struct.unpack_from("<I", content, at + 8)[0] != masked(head) or struct.unpack_from("<I", content, at + 12 + length)[0] != masked(payload):
            raise ValueError(f"wrong checksum in the record at byte {at}")
        if length:
            yield at, payload
        at += length + 16


class WordEncoder(dict):
    """From a word's bytes to its packed ids, for a vocabulary that drops white space and lower-cases.

    A word of Latin letters and a tail of punctuation are two pieces to such a vocabulary, so they are looked up apart; and letters alone need no normalising and splitting, so they go to the model as byte-level characters.
    Whether all this holds is tried out on probes; otherwise texts are encoded whole. Texts with ``<|`` may hold a special
    token, whose letters' case counts; they are encoded whole, too.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = "I" if self.wide else "H"
        probe = "Ab, cd.\n x1's  é-f gh*** i;"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        self.by_word = whole == [i for w in probe.lower().split() for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        latin = [c for c in map(chr, range(0x61, 0x180)) if c.isalpha() and c == c.lower() == unicodedata.normalize("NFC", c)]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in latin}
        self.known = frozenset(latin)
        tried = ["".join(latin[i : i + 7]) for i in range(0, len(latin), 3)] + ["the", "über", "école", "niño"]
        if any([t.id for t in self.tokenizer.model.tokenize(w.translate(self.letters))] != self.tokenizer.encode(w, add_special_tokens=False).ids for w in tried):
            self.known = frozenset()

    def packed(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = word.decode()
        if self.known.issuperset(text):
            out = array(self.kind, [t.id for t in self.tokenizer.model.tokenize(text.translate(self.letters))]).tobytes()
        elif (letters := text.rstrip(PUNCTUATION)) and len(letters) < len(text) and self.known.issuperset(letters):
            out = self[letters.encode()] + self[text[len(letters) :].encode()]
        else:
            out = self.packed(text)
        self[word] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or "<|" in text:
            return self.packed(text)
        return b"".join(map(self.__getitem__, text.encode().lower().split()))


def encoder(path: str) -> WordEncoder:
    return worker_cache(f"words:{path}", lambda: WordEncoder(path))


def write_records(documents: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append end_id to each, and write files in ascending order of ids into the folder path."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(1 + chars // FILE_CHARS, *order).sortWithinPartitions(*order)

    def blocks(batches):
        enc = encoder(vocabulary)
        end = array(enc.kind, [end_id]).tobytes()
        held, size = [], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join([*held, END_OF_BLOCK])[:-1]], pa.binary())], ["value"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(frame(pack(doc_id, enc.encode(text.as_py()) + end, enc.wide)))
                size += len(held[-1])
                if size >= BLOCK_BYTES:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    lines = in_batches(rows).mapInArrow(blocks, "value binary").select(F.col("value").cast("string"))
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: (file, doc_id, offset, length, n_tokens, before, ids_crc32), before being the ids ahead of it in the file.

    offset and length are of the whole frame; ids_crc32 is over the ids as u32.
    """

    def scan(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out, before = [], 0
                for at, payload in frames(content.as_py()):
                    doc_id, ids = unpack(payload)
                    out.append((file, doc_id, at, len(payload) + 16, len(ids), before, zlib.crc32(ids if ids.itemsize == 4 else array("I", ids))))
                    before += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, [pa.string(), *[pa.int64()] * 6])], ["file", "doc_id", "offset", "length", "n_tokens", "before", "ids_crc32"])

    return in_batches(_files(spark, path)).mapInArrow(scan, "file string, doc_id long, offset long, length long, n_tokens long, before long, ids_crc32 long")


def with_starts(index: DataFrame) -> DataFrame:
    """index with start: the ids ahead of the record in all files. Sums up a row a file."""
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.sum("n").over(Window.orderBy(number, "file")).alias("upto"), "n")
    files = narrow(materialize(files.select("file", (F.col("upto") - F.col("n")).alias("ahead")), "files"))
    return index.join(files, "file").withColumn("start", F.col("ahead") + F.col("before")).drop("ahead", "before")


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Verify the files of path, write their index as Parquet, and return it as read, with starts."""
    read_index(spark, path).write.parquet(index_path)
    return with_starts(spark.read.parquet(index_path))


def shuffled_read(spark: SparkSession, path: str, index: DataFrame, seed: int = 0) -> DataFrame:
    """(place, doc_id, ids) in the order that the seed gives; records are cut out of their files by the index."""
    wanted = index.groupBy("file").agg(F.collect_list(F.struct(F.xxhash64("file", "offset", F.lit(seed)).alias("place"), "offset", "length")).alias("wanted"))

    def cut(batches):
        for batch in batches:
            for content, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                content = content.as_py()
                got = [(w["place"], *unpack(next(frames(content[w["offset"] : w["offset"] + w["length"]]))[1])) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([list(g[2]) for g in got], pa.list_(pa.int64()))], ["place", "doc_id", "ids"])

    return in_batches(_files(spark, path).join(wanted, "file").select("content", "wanted")).mapInArrow(cut, "place long, doc_id long, ids array<long>").orderBy("place")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Write documents to files in the shared folder and return what reading them back gives."""
    spark = documents.sparkSession
    path = scratch_path(spark, "records")
    write_records(documents, vocabulary, path)
    index = write_index(spark, path, scratch_path(spark, "records-index"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
