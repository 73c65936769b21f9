import os
import tracemalloc
import uuid
import zlib

import numpy as np
import pytest
from helpers import edge_docs, edge_texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm.packing import first_fit_decreasing, pack_documents
from millrace.llm.token_files import pack, read_token_files, token_file_digests, unpack, write_token_files
from millrace.llm.tokenizing import Encoder, encoder, public_path

PATH = public_path()


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, (1 << 32) - 1))))
def test_codes_round_trip(ranks):
    control, data = pack(np.array(ranks, np.uint32))
    assert unpack(control, data, len(ranks)).tolist() == ranks
    assert len(control) == -(-len(ranks) // 4)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aAbBzZ0129.,!?'é☃ßİſ𝄞 \t\n\x0b\x0c\r\u00a0-_'s<|>")), st.characters(codec="utf-8")), max_size=60))
def test_words_encode_like_whole_texts(text):
    coder = encoder(PATH)
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode([text.encode()])[0], coder.kind).tolist() == want


def test_letters_that_end_in_a_mark_once_normalised():
    coder = encoder(PATH)
    ends = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalnum()]
    words = [f"{w}{tail}" for w in ["FENERBAHÇELİ", *(f"ab{c}" for c in ends)] for tail in (".", ",!")]
    whole = [e.ids for e in coder.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    got = [np.frombuffer(ids, coder.kind).tolist() for ids in coder.encode([w.encode() for w in words])]
    assert [w for w, a, b in zip(words, got, whole) if a != b] == []


def test_words_of_letters_are_learned_without_the_pattern():
    """Latin-1 letters of both cases take the shorter way, and give the ids of the whole tokenizer."""
    coder = Encoder(PATH)
    assert coder.letters is not None
    letters = [chr(c) for c in range(256) if chr(c).isalpha()]
    words = [f"{a}{b}{tail}" for a in letters for b in "aZ\u00dfÉ" for tail in ("", "the", "the.")]
    whole = [e.ids for e in coder.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    got = [np.frombuffer(ids, coder.kind).tolist() for ids in coder.encode([f" {w}\t".encode() for w in words])]
    assert [w for w, a, b in zip(words, got, whole) if a != b] == []


def test_token_files(spark, tmp_path, encode):
    docs = edge_docs(spark)
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    write_token_files(docs, path, PATH, 2)
    back = read_token_files(spark, path).orderBy("start").collect()
    want = sorted(((d, encode(t)) for d, t in edge_texts()), key=str)
    assert sorted(((r.doc_id, list(r.ids)) for r in back), key=str) == want
    start, before = 0, None
    for r in back:
        assert r.start == start and r.n_tokens == len(r.ids) and (before is None or before <= r.doc_id)
        start, before = start + r.n_tokens, r.doc_id if r.doc_id is not None else before
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in token_file_digests(spark, path).collect()), key=str) == sorted(((d, len(x), crc(x)) for d, x in want), key=str)
    assert os.path.isdir(f"{path.removeprefix('file://')}/ranks")


def test_empty_token_files(spark, tmp_path):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    write_token_files(edge_docs(spark).limit(0), path, PATH, 2)
    assert token_file_digests(spark, path).count() == 0


def slow_first_fit(lengths, capacity):
    free, bins = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if at == len(free):
            free.append(capacity)
        free[at] -= lengths[i]
        bins[i] = at
    return bins


@given(st.lists(st.integers(1, 50), max_size=80))
def test_first_fit_decreasing(lengths):
    bins, offsets = first_fit_decreasing(lengths, 50)
    assert bins.tolist() == slow_first_fit(lengths, 50)
    for b in set(bins.tolist()):
        at = 0
        for o, n in sorted((o, n) for o, n, x in zip(offsets.tolist(), lengths, bins.tolist()) if x == b):
            assert o == at
            at += n
        assert at <= 50


@pytest.mark.parametrize("group_pieces", [4, 2048])
def test_packing(spark, encode, group_pieces):
    docs = edge_docs(spark)
    rows = pack_documents(docs, PATH, length=512, group_pieces=group_pieces).collect()
    want = sorted(len(encode(t)) for _, t in edge_texts())
    assert sum(r.length for r in rows) == sum(want)
    by_id = {d: encode(t) for d, t in edge_texts()}
    sequences = {}
    for r in rows:
        if r.doc_id is not None:
            assert r.doc_tokens == len(by_id[r.doc_id]) and r.ids_crc32 == crc(by_id[r.doc_id][r.start : r.start + r.length])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 512
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_known_words_are_looked_up_once():
    class Counting(dict):
        n = 0

        def get(self, key, default=None):
            self.n += 1
            return dict.get(self, key, default)

        def __getitem__(self, key):
            self.n += 1
            return dict.__getitem__(self, key)

        def __contains__(self, key):
            self.n += 1
            return dict.__contains__(self, key)

    coder = Encoder(public_path())
    text = b"some words of one text, some of them twice"
    first = coder.encode([text])
    coder.words = Counting(coder.words)
    assert coder.encode([text]) == first and coder.words.n == len(set(text.split()))


def test_decoding_takes_few_bytes_for_each_id():
    ranks = np.random.default_rng(1).integers(0, 1 << 18, 200_000)
    control, data = pack(ranks)
    tracemalloc.start()
    got = unpack(control, data, len(ranks))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == ranks).all() and most < 40 * len(ranks)
    assert unpack(b"", b"", 0).tolist() == []
