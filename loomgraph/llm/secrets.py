"""Secrets in whole texts: patterns, and strings that a common vocabulary can't compress.

Base spans, leftmost and non-overlapping for each kind, in code points: ``assign`` (a password, secret, token or key that
is given a value of 8 or more characters), ``access`` (AKIA...) and ``hex`` (32 or more hexadecimal digits).

Method: a run of 20 or more characters of the base64 and identifier alphabets is random if the byte-pair vocabulary needs
many tokens for it. Natural words and paths give 3 to 6 characters a token, random base64 gives 1.3 to 2. Known digests
(hexadecimal of a digest's length, with or without its name) and identifiers (UUIDs, plain numbers, dates, three or more
words of one case or numbers between separators) are left out, and so are runs inside base spans. Runs without digits and
numbered names may be long words, so a stricter ratio holds for them: random letters give 2.0 and less in 99 of 100 cases.

Cases: a null or empty text has no spans; each row is judged by itself, so ties, repeats and null ids change nothing;
long texts are searched whole; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, worker_cache

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # as AKIA[A-Z0-9]+ of 16 characters or more: a run has one start that is leftmost
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
#: One of these stands in any text with an assignment.
WORDS = (b"passw", b"secret", b"token", b"api")

MIN_LENGTH = 20
#: Characters a token, below which a string counts as random.
MAX_RATIO = 2.2
#: The same for runs without digits and for numbered names.
PLAIN_RATIO = 2.05
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
DIGEST = re.compile(r"(?:(?:md5|sha1|sha224|sha256|sha384|sha512)[-_=])?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|sha(?:256|384|512)-[A-Za-z0-9+/]+={0,2}", re.I)
_WORD = "(?:[A-Z]?[a-z]{1,16}|[A-Z]{1,16})"
IDENTIFIER = re.compile(rf"(?i:[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})|[0-9+/_=-]+|[-_/]*(?:(?:{_WORD}|[0-9]{{1,8}})[-_/]+){{2,}}(?:{_WORD}[0-9]{{0,6}}|[0-9]{{1,8}})")
NAME = re.compile(r"(?:[A-Za-z]+[-_/=+])*[A-Za-z]+[-_/=+]?[0-9]{1,6}|(?:[A-Za-z]+[-_/]|[0-9]{1,8}[-_/])+(?:[A-Za-z]+|[0-9]{1,8})")


def vocabulary(path: str):
    """The encoding of a rank file, kept by the worker."""

    def load():
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return worker_cache(f"ranks:{path}", load)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    lowered = text.encode().lower()
    if any(w in lowered for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, encoding, base: list[tuple[int, int, int]], max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    out = []
    for m in RUN.finditer(text):
        run, a, b = m[0], m.start(), m.end()
        if not LETTER.search(run) or DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run):
            continue
        if any(s < b and a < e for s, _, e in base):
            continue
        limit = max_ratio if DIGIT.search(run) and not NAME.fullmatch(run) else min(max_ratio, PLAIN_RATIO)
        if len(run) < limit * len(encoding.encode_ordinary(run)):
            out.append((a, 3, b))
    return out


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(documents: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random), a row for each row of documents."""

    def search(batches):
        encoding = vocabulary(rank_file)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = random_spans(text, encoding, base, max_ratio)
                counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*counts, hashlib.sha256(said(base).encode()).hexdigest(), said(sorted(base + more)), len(more)))
            cols = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_batches(rows).mapInArrow(search, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(documents: DataFrame, rank_file: str, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """documents, all columns, with each span (overlapping ones as one) of text_col replaced by mask."""
    schema, at = documents.schema, documents.columns.index(text_col)

    def clean(text: str | None, encoding) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        out, upto = [], 0
        for a, _, b in sorted(base + random_spans(text, encoding, base)):
            if a >= upto:
                out += [text[upto:a], mask]
            upto = max(upto, b)
        return "".join([*out, text[upto:]])

    def rewrite(batches):
        encoding = vocabulary(rank_file)
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at).name, pa.array([clean(t.as_py(), encoding) for t in batch.column(at)], batch.schema.field(at).type))

    return in_batches(documents).mapInArrow(rewrite, schema)


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), rank_path())
