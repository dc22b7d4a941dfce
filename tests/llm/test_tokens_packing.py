"""Encoding against the tokenizer libraries, decoding as a round trip, packing against brute force."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from qualframe.llm import packing, queries, tokens
from qualframe.llm.packing import OpenWindows, best_fit_decreasing, encoder

TEXTS = [None, "", " ", "hello world", "hello  world\n\n it's", "naïve 北京 😀 emoji", "<|endoftext|>", "a" * 5_000, "1234567 8 9", " \t\n" * 500,
         "the cat sat on the mat " * 700]


@pytest.fixture(scope="module")
def plain():
    return encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_ordinary


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


@pytest.mark.parametrize("block_chars", [1, 1_000, tokens.BLOCK_CHARS])
def test_encoding_matches_the_library_and_decodes(spark, plain, block_chars):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string").repartition(3)
    found = tokens.decode(tokens.encode(docs, block_chars=block_chars)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((d is None, d or 0) for d, _, _ in rows)
    for r in found:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.ids == plain(text) and r.n_tokens == len(r.ids) and bytes(r.bytes) == text.encode()


def test_empty_table_has_no_tokens_and_no_pieces(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokens.encode(docs).count() == 0 and packing.pack(docs).count() == 0


def test_null_ids_decode_to_null(spark):
    assert tokens.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).select("bytes").collect() == [(None,), (b"",)]


@given(st.lists(st.integers(0, 1 << 27), max_size=300))
@settings(deadline=None)
def test_numbers_survive_packing(numbers):
    numbers = np.array(numbers, np.int64)
    assert (tokens._unpacked(tokens._packed(numbers)) == numbers).all()


def test_both_tokenizer_files_agree(plain, library):
    for text in TEXTS:
        assert library.encode(text or "", add_special_tokens=False).ids == plain(text or "")


@given(st.lists(st.integers(1, 40), max_size=80))
@settings(deadline=None)
def test_best_fit_takes_the_tightest_window(lengths):
    lengths = np.array(lengths, np.int64)
    places, offsets, opened = best_fit_decreasing(lengths, 40)
    room, expected_windows = [], 0
    for item in np.argsort(-lengths, kind="stable"):
        fitting = [r for r in room if r >= lengths[item]]
        if fitting:
            room.remove(min(fitting))
            room.append(min(fitting) - lengths[item])
        else:
            expected_windows += 1
            room.append(40 - lengths[item])
    assert opened == expected_windows
    fill = defaultdict(list)
    for place, offset, length in zip(places, offsets, lengths):
        fill[place].append((offset, length))
    assert sorted(40 - sum(n for _, n in pieces) for pieces in fill.values()) == sorted(room)
    for pieces in fill.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length


def test_segment_tree_finds_nothing_when_nothing_fits():
    windows = OpenWindows(10)
    assert windows.take(1) is None
    windows.put(0, 4)
    assert windows.take(5) is None and windows.take(4) == (0, 4) and windows.take(1) is None


@pytest.mark.parametrize("lot", [2, packing.LOT])
def test_pieces_cover_every_document_once(spark, plain, lot):
    rows = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(None, "x y", 5), (3, TEXTS[3], 5)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string, start int").repartition(2), lot=lot).collect()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append(p)
    for doc, text, _ in rows:
        ids = np.array([*plain(text or ""), packing.END_MARK], "<u4")
        times = sum(d == doc for d, _, _ in rows)
        wanted = [(s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
        assert sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[doc]) == sorted(wanted * times)
    for window in by_window.values():
        end = 0
        for p in sorted(window, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end <= 2048


MARKED = [*TEXTS, "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n\n x", "end \n <|endoftext|>", "<|endof<|endoftext|>text|>", "word <|endoftext|>" * 900]


def test_registered_packing_takes_the_ids_of_the_library(spark, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    spark.createDataFrame(list(enumerate(MARKED)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = []
    for doc, text in enumerate(MARKED):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, packing.END_MARK], "<u4")
        wanted += [(doc, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for found in (queries.op7_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        assert sorted(map(tuple, found.select(*columns).collect())) == sorted(wanted)


def test_added_tokens_that_are_not_literal_are_refused(tmp_path):
    path = tmp_path / "tokenizer.json"
    path.write_text('{"added_tokens": [{"id": 1, "content": "x", "single_word": false, "lstrip": true, "rstrip": false, "normalized": false}]}')
    with pytest.raises(ValueError):
        packing.added_tokens(str(path))
