import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import records


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(records.vocabulary_path())


ENCODER = records.WordEncoder(records.vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcAZé'É.,;*#<>|$_ -\n\t12ßŁıİ"), st.characters(codec="utf-8")), max_size=40))
def test_words_give_what_whole_texts_give(text):
    assert ENCODER.encode(text) == ENCODER.packed(text)


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(records, "REMEMBERED", 5)
    enc = records.WordEncoder(records.vocabulary_path())
    text = " ".join(f"word{i}, lé{i} plain." for i in range(50))
    assert enc.encode(text) == enc.packed(text)


def expected(rows, tokenizer):
    out, start = [], 0
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [records.END_ID]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ROWS = [(5, "Hello, world! <|endoftext|> it's"), (-3, None), (7, ""), (2, "lorem ipsum " * 4000), (9, "ünï çödé 漢字"), (9, "ünï çödé 漢字"), (11, "\n\n\t")]


def test_round_trip(docs, tokenizer):
    got = records.encoded(docs(ROWS, clash=True), records.vocabulary_path()).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected(sorted(ROWS, key=lambda r: r[0]), tokenizer)


def test_null_ids_come_last(docs, tokenizer):
    got = records.encoded(docs([(None, "last"), (1, "first")]), records.vocabulary_path()).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == expected([(1, "first"), (None, "last")], tokenizer)


def test_empty_table(docs):
    assert records.encoded(docs([]), records.vocabulary_path()).count() == 0


def test_files_in_order_and_shuffled_reads(spark, docs, tmp_path, monkeypatch, tokenizer):
    monkeypatch.setattr(records, "FILE_CHARS", 2000)
    rows = [(i, f"text number {i} " * (i % 30)) for i in range(200)]
    path = f"{tmp_path}/data"
    records.write_records(docs(rows[::-1]).repartition(5), records.vocabulary_path(), path)
    index = records.write_index(spark, path, f"{tmp_path}/index")
    got = index.orderBy("file", "offset").collect()
    assert len({r.file for r in got}) > 10
    assert [r.doc_id for r in got] == list(range(200))
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected(rows, tokenizer)
    whole = {r.doc_id: tokenizer.encode(rows[r.doc_id][1], add_special_tokens=False).ids + [1] for r in got}
    a, b = (records.shuffled_read(spark, path, index, seed).collect() for seed in (1, 2))
    assert {r.doc_id: list(r.ids) for r in a} == whole and len(a) == 200
    assert [r.doc_id for r in a] != [r.doc_id for r in b] and sorted(r.doc_id for r in a) == sorted(r.doc_id for r in b)


def test_checksums_are_verified():
    data = bytearray(records.frame(records.pack(4, b"\x01\x00\x02\x00", False)) + records.END_OF_BLOCK)
    (at, payload), = records.frames(bytes(data))
    assert at == 0 and records.unpack(payload)[0] == 4 and list(records.unpack(payload)[1]) == [1, 2]
    assert struct.unpack_from("<Q", data)[0] == len(payload)
    for i in (0, 9, 14, len(payload) + 13):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises((ValueError, struct.error)):
            list(records.frames(bytes(bad)))


def test_wide_ids():
    ids = np.array([1, 70000], "<u4").tobytes()
    assert records.unpack(records.pack(None, ids, True)) == (None, records.array("I", [1, 70000]))


def test_separator_ends_an_empty_record():
    assert records.END_OF_BLOCK[-1:] == records.SEPARATOR
