"""Token operators against the libraries themselves, and packing against its contract."""

import base64
import hashlib
import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cardloom.llm import bpe_sql, packing, token_counts, token_files
from cardloom.llm.library_ids import LibraryIds
from cardloom.session import shared_dir

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = st.lists(st.sampled_from(["a", "B", "the", "tion", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", "'", "'s", "'re", "'l", "1", "²", "é", "İ", "é", "中", "!", "..", "👍", "<|endoftext|>", "\0", " \0", "﷐"]), max_size=25)
TEXTS = PARTS.map("".join)


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


@pytest.fixture(scope="module")
def rank_encoding():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts_of(documents):
    return sorted(((r.doc_id, r.text or "") for r in documents.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_library_ids(texts):
    for path, words in ((BYTES, False), (WORDS, True)):
        flat, starts = LibraryIds(path, words).encode(texts)
        for k, text in enumerate(texts):
            assert flat[starts[k] : starts[k + 1]].tolist() == _library(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_transducer(text):
    machine = token_counts.transducer(BYTES)
    assert machine.count(text) == len(_library().encode(text, add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_counts_of_pieces(texts):
    assert token_counts.count_texts(BYTES)(texts).tolist() == [len(_library().encode(x, add_special_tokens=False).ids) for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_sql_pieces(rank_encoding, texts):
    found = list(bpe_sql.Pieces(RANKS, public_tokenizers.PATTERN).encode(texts))
    assert found == [(rank_encoding.encode_ordinary(x), x.encode()) for x in texts]


def test_sql_long_matches(rank_encoding, monkeypatch):
    letters = random.Random(5)
    texts = ["".join(letters.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000)), "x" * 6000, "ab" * 2000, "中文字" * 700]
    pieces = bpe_sql.Pieces(RANKS, public_tokenizers.PATTERN)
    assert [x[0] for x in pieces.encode(texts)] == [rank_encoding.encode_ordinary(x) for x in texts]
    # A recursion that is cut after few steps gives the same.
    monkeypatch.setattr(bpe_sql, "STEP_ROWS", 100)
    words = [x.encode() for x in ("internationalization" * 4, "antidisestablishmentarianism", "zzzzzzzzzzzz", "a", "€€€")]
    assert bpe_sql.SqlBpe(RANKS).encode(words)[0] == [rank_encoding.encode_ordinary(x.decode()) for x in words]


@cache
def _library(path=BYTES):
    return Tokenizer.from_file(path)


def test_sql_encoding(documents, clashing, no_documents, rank_encoding):
    texts = texts_of(documents)
    rows = bpe_sql.encode(clashing, RANKS, public_tokenizers.PATTERN).collect()
    expected = sorted((str(d), tuple(rank_encoding.encode_ordinary(t)), t.encode()) for d, t in texts)
    assert sorted((str(r.doc_id), tuple(r.ids), bytes(r.decoded)) for r in rows) == expected
    digests = bpe_sql.encode_digest(documents, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == sorted(
        (d, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t).hexdigest()) for d, i, t in expected
    )
    assert bpe_sql.encode_digest(no_documents, RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_counts(documents, clashing, no_documents, library):
    rows = token_counts.token_counts(clashing, BYTES).collect()
    expected = [(d, len(t.encode()), len(library[BYTES].encode(t, add_special_tokens=False).ids)) for d, t in texts_of(documents)]
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows))) == sorted(str((d, b, n, n > 1024)) for d, b, n in expected)
    assert token_counts.token_counts(no_documents, BYTES).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [1, 2, 3], list(range(70_000)), [2**32 - 1, 0, 5]])
def test_planes_round_trip(ids):
    block = np.array(ids, np.uint32)
    assert token_files.ids_of(token_files.planes(block), len(block)).tolist() == ids


def test_token_files(spark, documents, clashing, no_documents, library):
    rows = token_files.token_file_digest(clashing, WORDS, end_id=1).collect()
    start, expected = 0, []
    for doc, text in texts_of(documents):
        ids = library[WORDS].encode(text, add_special_tokens=False).ids + [1]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda x: x[1])
    assert got == expected
    assert token_files.token_file_digest(no_documents, WORDS, end_id=1).count() == 0


def test_any_document_can_be_read_back(spark, documents, library):
    path = token_files.write_token_files(documents, shared_dir(spark, "test-files"), WORDS, end_id=1)
    row = token_files.read_token_files(spark, path).filter("doc_id = 102").first()
    text = dict(texts_of(documents))[102]
    assert np.frombuffer(row.ids, "<u4").tolist() == library[WORDS].encode(text, add_special_tokens=False).ids + [1]


def check_pieces(rows, expected, capacity=1024):
    """Every id lies in one piece, sequences have no gaps and are not too long; returns the share of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(str(r.doc_id), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length > 0
    copies = {}
    for doc, ids in expected:
        copies.setdefault(str(doc), []).append(ids)
    assert set(by_doc) == set(copies)
    for doc, pieces in by_doc.items():
        assert sorted(x for _, ids, _ in pieces for x in ids) == sorted(x for ids in copies[doc] for x in ids)
        if len(copies[doc]) == 1:
            assert [x for _, ids, _ in sorted(pieces) for x in ids] == copies[doc][0]
            assert all(n == len(copies[doc][0]) for _, _, n in pieces)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, sum(r.length for r in rows))


def test_packing(documents, clashing, no_documents, library):
    rows = packing.pack(clashing, BYTES, end_id=0).collect()
    check_pieces(rows, [(d, library[BYTES].encode(t, add_special_tokens=False).ids + [0]) for d, t in texts_of(documents)])
    assert packing.pack(no_documents, BYTES, end_id=0).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 255), max_size=300), st.integers(1, 30))
def test_plans_place_every_document(lengths, often):
    counts = np.bincount(np.array(lengths, np.int64), minlength=256) * often if lengths else np.zeros(256, np.int64)
    plan, used = packing.make_plan(counts, 256), {}
    for length in np.flatnonzero(counts).tolist():
        for rank in range(int(counts[length])):
            at = 0
            for start, size, sequence, offset in packing.place(plan, length, rank):
                assert start == at
                at += size
                used.setdefault(sequence, []).append((offset, size))
            assert at == length
    for pieces in used.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= 256
    assert len(used) == plan.sequences


def test_patterns_leave_little_padding():
    counts = np.zeros(1024, np.int64)
    counts[1:] = np.random.default_rng(1).integers(0, 200, 1023)
    plan = packing.make_plan(counts, 1024)
    ideal = counts @ np.arange(1024) / 1024
    assert plan.sequences < 1.02 * ideal
    assert plan.left_sequence > 0.9 * plan.sequences  # patterns, not cutting, place most documents
