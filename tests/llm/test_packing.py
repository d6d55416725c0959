import random
import zlib

import numpy as np
import pytest

from dinelens.llm import packing, tokens


@pytest.fixture(scope="module")
def path():
    return tokens.public_path("byte_bpe_50k.json")


def library_ids(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ODD = ["", " ", "\n", "a\n\nb", " x  y\n z\t", "Hé!  ok.\nno,   x", "日本語 テスト", "it's John's. 12,000.5", "a\x1cb c", "x\x85y z", "İstanbul ΣΑΣ. ΣΑΣ", "<|endoftext|> x", "İİ, İ. ŉabc, ǰx ﬁ. ß, ª. x². Ⅷ,", "wort, , . .. ...", "\na", "a\n", "don't. 's, 's"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_are_the_librarys(documents, name, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CACHED", 500)
    texts = [r["text"] or "" for r in documents.collect()] + ODD
    got = [np.frombuffer(b, "<u4").tolist() for b in tokens.Encoder(tokens.public_path(name)).encode(texts, at_once=16)]
    assert got == library_ids(tokens.public_path(name), texts)


def check(rows, docs, path, capacity=1024):
    want = []
    for (d, _), ids in zip(docs, library_ids(path, [t or "" for _, t in docs]), strict=True):
        ids = [*ids, 2]
        first = len(ids) % capacity or capacity if len(ids) > capacity else len(ids)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want.append((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r["length"] for r in rows)


def test_pack(documents, odd_documents, empty_documents, path, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", 40)  # several salts on a small table
    for docs in (documents, odd_documents):
        rows = packing.pack(docs, path).collect()
        n, total = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], path)
        assert n <= -(-total // 1024) + max(2, n // 50)
    assert packing.pack(empty_documents, path).count() == 0


def test_sequences_hold_the_ids(documents, path):
    placed = packing.pack(documents, path)
    got = {r["sequence_id"]: r["ids"] for r in packing.sequences(documents, placed, path).collect()}
    for r in placed.collect():
        ids = got[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]


def spread(counts, solution):
    used = {}
    for p, m in solution:
        assert sum(n * x for n, x in p) <= 100
        for n, x in p:
            used[n] = used.get(n, 0) + m * x
    return used == {n: c for n, c in counts.items() if c}


def test_crossover_and_mutation_keep_every_document():
    rng = random.Random(4)
    for _ in range(30):
        counts = {n: rng.randint(1, 10**rng.randint(0, 6)) for n in rng.sample(range(1, 101), rng.randint(1, 40))}
        a, b = packing.best_fit([], counts, 100, 0.3, rng), packing.best_fit([], counts, 100)
        assert spread(counts, a) and spread(counts, b)
        child = packing.crossover(a, b, counts, 100, rng)
        assert spread(counts, child) and spread(counts, packing.mutate(child, 100, rng))
        assert packing._unpack(packing._pack(child)) == child
        # Patterns are bounded by the lengths, not by the number of documents.
        assert len(b) <= 4 * 100


def test_evolution_beats_or_equals_best_fit():
    # A classic: best fit decreasing wastes a bin that a whole filled bin saves.
    counts = {44: 3, 24: 6, 23: 3, 22: 3, 33: 3, 17: 5, 16: 4, 51: 4, 27: 4, 26: 4}
    plain = packing.best_fit([], counts, 100)
    found = packing.evolve([], counts, 100, random.Random(1), 20, 10)
    assert packing.fitness(found[0], 100) <= packing.fitness(plain, 100)


def test_slots_number_every_piece():
    s = [(((50, 1), (25, 2)), 3), (((25, 4),), 2)]
    first, seq, each, off = packing.slots(s)[25]
    assert first.tolist() == [0, 6] and seq.tolist() == [0, 3] and each.tolist() == [2, 4] and off.tolist() == [50, 0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_encoded_once_and_outlast_a_full_cache(name, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CACHED", 40)
    rng = random.Random(2)
    words = ["Haus", "naïve", "ŠKODA", "straße***", "İ.%", "the,%%%", "x'", "don't.", "é", "日本.", "éa!", "á.", "≠", "a.b.", "...", "12.", "ΣΑΣ;", "x y", " z", "ª!"]
    words += ["".join(rng.choices("abcdeé", k=6)) + rng.choice(["", ".", "?!"]) for _ in range(60)]
    texts = [rng.choice(["", " ", "\n"]) + rng.choice([" ", "\n", "\t"]).join(rng.choices(words, k=12)) for _ in range(300)]
    enc = tokens.Encoder(tokens.public_path(name))
    assert enc.direct
    asked = []
    monkeypatch.setattr(enc, "tokenize", lambda w, ask=enc.tokenize: asked.append(w) or ask(w))
    got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts * 2, at_once=300)]
    assert got == library_ids(tokens.public_path(name), texts * 2)
    # Those of the last texts are still known, whatever the cache's size.
    n = len(asked)
    assert n and enc.encode(texts) and len(asked) == n
    got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts, at_once=7)]
    assert got == library_ids(tokens.public_path(name), texts)
