import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dinelens.llm import token_files, tokens


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.integers(0, token_files.NONE - 1), st.integers(65533, 65537), st.integers(0, 3)), max_size=400), st.integers(1, 70))
def test_any_ids_come_back(ids, block):
    before, token_files.BLOCK = token_files.BLOCK, block
    try:
        v = np.array(ids, np.uint32)
        names, counts, back = token_files.read_segment(token_files.pack_segment([None, 7], [len(ids), 0], v))
    finally:
        token_files.BLOCK = before
    assert back.tolist() == ids and names == [None, 7] and counts.tolist() == [len(ids), 0]


def test_repeats_are_predicted_and_noise_is_stored():
    rng = np.random.default_rng(0)
    same = np.tile(rng.integers(0, 49408, 50), 400).astype(np.uint16)
    noise = rng.integers(0, 65535, 20_000).astype(np.uint16)
    for v, most in ((same, 0.5), (noise, 2.2)):
        data = token_files.pack_segment([1], [len(v)], v)
        assert len(data) <= most * len(v) + 2000
        assert np.array_equal(token_files.read_segment(data)[2], v)


def test_fewer_bits_than_zlib_on_the_same_blocks(documents):
    enc = tokens.encoder(tokens.public_path("word_bpe_49k.json"))
    texts = [r["text"] or "" for r in documents.orderBy("doc_id").select("text").collect()]
    v = np.concatenate([np.frombuffer(ids, "<u4") for ids in enc.encode(texts)])
    data = token_files.pack_segment([1], [len(v)], v)
    n = token_files.BLOCK
    plain = sum(len(zlib.compress(v[i : i + n].astype("<u2").tobytes(), 6)) for i in range(0, len(v), n))
    assert len(data) < 0.9 * plain
    assert np.array_equal(token_files.read_segment(data)[2], v)


def test_no_segment_of_a_task_has_few_lanes(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 8)
    monkeypatch.setattr(token_files, "LANES", 16)
    for sizes in ([10] * n for n in range(60)):
        docs = [(k, np.arange(n, dtype=np.uint32) + k) for k, n in enumerate(sizes)]
        found = list(token_files.segments(iter(docs)))
        assert [d for names, _, _ in found for d in names] == list(range(len(sizes)))
        assert all(counts == [10] * len(names) and len(ids) == 10 * len(names) for names, counts, ids in found)
        assert not docs or np.array_equal(np.concatenate([ids for _, _, ids in found]), np.concatenate([v for _, v in docs]))
        assert len(found) < 2 or all(len(ids) >= 64 for _, _, ids in found)
        assert all(len(ids) < 192 + 10 for _, _, ids in found)
    docs = [(None, np.arange(n, dtype=np.uint32)) for n in (1000, 1, 500, 130, 3)]
    assert [counts for _, counts, _ in token_files.segments(iter(docs))] == [[1000], [1, 500], [130, 3]]


def test_classes_of_very_many_ids_are_cut():
    ids = np.concatenate([np.arange(400_000), np.zeros(30_000_000, np.int64)])
    classes = token_files.Classes.count(ids)
    assert classes.sizes.max() <= token_files.LARGEST and len(classes.starts) < 512
    back = token_files.Classes.from_bytes(classes.to_bytes())
    for name in ("ranked", "starts", "weights", "sizes", "class_of", "place_of"):
        assert np.array_equal(getattr(back, name), getattr(classes, name))


def test_more_classes_than_a_byte_counts_and_much_room(monkeypatch):
    monkeypatch.setattr(token_files, "CLASSES", 400)
    monkeypatch.setattr(token_files, "ROOM_STEPS", 1)
    v = np.random.default_rng(1).permutation(np.arange(60_000) % 20_000).astype(np.uint32) * 50
    assert len(token_files.Classes.count(v).starts) > 256
    assert np.array_equal(token_files.read_segment(token_files.pack_segment([1], [len(v)], v))[2], v)


def test_words_alike_but_for_case_and_marks_are_encoded_once():
    """Each form of a word, and each with marks behind, was remembered and encoded apart."""
    enc = tokens.Encoder(tokens.public_path("word_bpe_49k.json"))
    texts = ["a Straße, straße? a STRASSE", "Straße... Straße), strasse! A Straße;"]
    assert enc.encode(texts) == enc.whole(texts)
    assert set(enc.cache) == {"a", "straße", "strasse"}


def test_the_same_ids_as_the_library_for_letters_of_all_kinds():
    letters = [chr(c) for c in [*range(33, 1500), 0x1E96, 0x1E9E, 0x2126, 0x212A, 0xFB01, 0x10400]]
    texts = ["", " ", "a", "n'\u0303, \u0130. \u01c5x! x\u0308? H\u0331; \u039f\u03a3, \u00b5\u00aa.", "he's HE'LL, it's. don't!"]
    texts += [" ".join(before + c + behind for c in letters) for before in ("", "x", "X") for behind in ("", "y", "Y", ",", "..)")]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = tokens.Encoder(tokens.public_path(name))
        assert enc.encode(texts) == enc.whole(texts)


def test_the_largest_id_is_refused():
    token_files.check_ids(np.array([0, token_files.NONE - 1], np.uint32))
    with pytest.raises(ValueError, match="does not fit"):
        token_files.check_ids(np.array([1, token_files.NONE], np.uint32))


def test_a_changed_byte_is_found():
    v = np.arange(5000, dtype=np.uint16)
    data = bytearray(token_files.pack_segment([1], [len(v)], v))
    data[-700] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.read_segment(bytes(data))


def test_round_trip_through_files(spark, documents, odd_documents, empty_documents, tmp_path):
    from tokenizers import Tokenizer

    path = tokens.public_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    for k, docs in enumerate((documents, odd_documents, empty_documents)):
        to = f"file://{tmp_path}/files{k}"
        token_files.write_token_files(docs, path, to)
        got = sorted(token_files.read_token_files(spark, to).collect(), key=lambda r: r["start"])
        rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        ids = {t: library.encode(t, add_special_tokens=False).ids for _, t in rows}
        # Equal ids are ordered by a hash of the text; starts follow from the order found.
        assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
        want = sorted((str(d), len(ids[t]) + 1, zlib.crc32(np.array([*ids[t], 2], "<u4").tobytes())) for d, t in rows)
        assert sorted((str(r["doc_id"]), r["n_tokens"], zlib.crc32(r["ids"])) for r in got) == want
        at = 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
