"""Token ids of whole texts by the tokenizers library, with a cache of words.

Both kinds of pre-tokenizer in use part a text at white space, and a word from
a full stop or comma behind it. So a batch of texts is cut into words and its
distinct words are found by Arrow; each of them is encoded by the library once
per worker and remembered, and the ids are laid out by their words' numbers. A
word of Latin letters is one pre-token and goes to the library's model as such.
For a byte-level vocabulary a space belongs to the word after it, and runs of
white space are tokens; texts with anything but single spaces and line breaks
between words, and all texts of other kinds of tokenizer, go to the library as
a whole.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import string
from array import array
from itertools import repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_CACHED = 500_000
MARKS = string.punctuation
JOINED = 64
CHARS = 8_000_000  # of texts encoded at once, unless one text is longer
LATIN = "\u0250"  # letters below are composed and have long been letters
SAMPLE = string.ascii_letters + "\u00df\u00e9\u00c0\u0160"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
# How a byte-level vocabulary writes each byte.
BYTES = {b: chr(b) for b in PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTED)}
# The same for bytes of words with line breaks between.
WRITTEN = "".join("\n" if b == 10 else BYTES[b] for b in range(256))
LETTERS = [c for c in map(chr, range(ord(LATIN))) if c.isalpha()]
# Those that lower case, Python's and Arrow's, keeps single letters.
ALONE = "".join(c for c, low in zip(LETTERS, pc.utf8_lower(pa.array(LETTERS)).to_pylist(), strict=True) if c.lower() == low and len(low) == 1 and low.isalpha())
ALL_ALONE = re.compile(f"[{ALONE}]+").fullmatch
ID_OF = attrgetter("id")
_OPEN: dict[str, Encoder] = {}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, most: int | None = None) -> Encoder:
    """The encoder of a vocabulary file, one per Python worker; it remembers ``most`` words, else ``MAX_CACHED``."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    _OPEN[path].most = most
    return _OPEN[path]


def laid(ids: np.ndarray, size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These parts of ``ids`` one after another, and where each begins, with the end."""
    ends = np.concatenate([[0], np.cumsum(size)])
    kind = np.int32 if ends[-1] + len(ids) < 1 << 31 else np.int64
    at = np.repeat((start - ends[:-1]).astype(kind), size)
    at += np.arange(ends[-1], dtype=kind)
    return ids[at], ends


def listed(words: pa.LargeStringArray) -> list[str]:
    """As ``to_pylist``, many times faster."""
    return words.to_numpy(zero_copy_only=False).tolist()


def paired(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.stack([one, two], axis=1).ravel()


class Encoder:
    def __init__(self, path: str):
        self.most: int | None = None
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before, norm = kind.get("pre_tokenizer") or {}, kind.get("normalizer")
        steps = [s.get("type") for s in before.get("pretokenizers", [])]
        self.bytewise = norm is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.wordwise = norm is not None and steps == ["Split", "ByteLevel"] and before["pretokenizers"][0]["behavior"] == "Removed"
        # Ids by word; for a byte-level vocabulary a line's first word has the line break before it.
        self._forget()
        # Whether Latin letters reach the model as one pre-token, at most put in lower case.
        rules = norm.get("normalizers", [norm]) if norm else []
        known = all(r["type"] in ("NFC", "Lowercase") or r["type"] == "Replace" and r["pattern"] == {"Regex": r"\s+"} for r in rules)
        own = all(t["special"] for t in kind.get("added_tokens") or [])  # the others are cut out of a text
        self.lower = any(r["type"] == "Lowercase" for r in rules)
        self.tokenize = self.library.model.tokenize
        self.direct = known and own and (self.bytewise or self.wordwise)
        self.direct = self.direct and len(self.library.pre_tokenizer.pre_tokenize_str(SAMPLE)) == 1
        if self.direct:
            size, ids = self._by_model([SAMPLE, *SAMPLE], "")
            self.direct = [v.tobytes() for v in np.split(ids, np.cumsum(size)[:-1])] == self.whole([SAMPLE, *SAMPLE])
        self.line_break = self.whole(["\n"])[0]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words of letters alone, many to one call of the library: such a word is one pre-token."""
        out: list[bytes] = []
        chunks = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        found = self.library.encode_batch([before + " ".join(c) for c in chunks], add_special_tokens=False)
        for chunk, e in zip(chunks, found, strict=True):
            of = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
            ends = [*(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            if len(ends) == len(chunk) and -1 not in of:
                raw = array("I", e.ids).tobytes()
                out.extend(raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True))
            else:  # a letter that becomes something else
                out.extend(self.whole([before + w for w in chunk]))
        return out

    def _forget(self) -> None:
        # The number of each word; by number, its ids' count and place in ``flat``, and whether it can't be used.
        self.cache: dict[str, int] = {}
        self.size, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.odd, self.flat = np.zeros(0, bool), np.zeros(0, np.uint32)

    def _added(self, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put ids of so many each into ``flat``; how many, and where they begin there."""
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, ids])
        return size, start

    def _bytes_added(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._added(np.array([len(x) // 4 for x in found], np.int64), np.frombuffer(b"".join(found), "<u4"))

    def _pairs_added(self, one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and starts of the ids of each first with those of its second behind."""
        ids, ends = laid(self.flat, *map(paired, one, two))
        return self._added(np.diff(ends[::2]), ids)

    def _by_model(self, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray]:
        """Of words of Latin letters: how many ids each has, and all their ids."""
        text = "\n".join(words)
        if self.lower:
            text = text.lower()
        if not text.isascii():
            text = codecs.charmap_decode(text.encode(), "strict", WRITTEN)[0]
        tokenize, ids, ends, lead = self.tokenize, array("I"), [0], BYTES[32] if before else ""
        for w in text.split("\n"):
            ids.extend(map(ID_OF, tokenize(lead + w)))
            ends.append(len(ids))
        return np.diff(ends), np.frombuffer(ids, np.uint32)

    def _plain(self, words: list[str], before: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words, in another order, with sizes and starts of their ids behind ``before``, a space or nothing."""
        direct, letters, rest = [], [], []
        for w in words:
            if not w.isalpha():
                rest.append(w)
            elif self.direct and (w.isascii() or ALL_ALONE(w)):
                direct.append(w)
            else:
                letters.append(w)
        parts = []
        if direct:
            parts.append(self._added(*self._by_model(direct, before)))
        if before or self.wordwise:
            parts.append(self._bytes_added(self._joined(letters, before)))
        else:
            parts.append(self._bytes_added(self.whole(letters)))
        parts.append(self._bytes_added(self.whole([before + w for w in rest])))
        size, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        return direct + letters + rest, size, start

    def _learn(self, latin: list[str], words: list[str]) -> None:
        """Encode and remember new words; the former are of Latin letters that reach the model as they are."""
        if latin:
            self._remember(latin, *self._added(*self._by_model(latin, " " if self.bytewise else "")), np.zeros(len(latin), bool))
        if not words:
            return
        # Letters with marks behind. The last letter must still be one in lower case, or the two may join.
        marked, stems, tails = [], [], []
        plain: set[str] = set()
        for w in words:
            if not w.isalpha():
                stem = w.rstrip(MARKS)
                if len(stem) < len(w) and stem.lstrip("\n").isalpha() and stem[-1].lower().isalpha():
                    marked.append(w)
                    stems.append(stem)
                    tails.append(w[len(stem) :])
                    continue
            plain.add(w)
        plain.update(s for s in stems if s not in self.cache)
        if self.bytewise:
            first = [w for w in plain if w[:1] == "\n"]
            plain.difference_update(first)
            found, size, start = self._plain([w[1:] for w in first], "")
            n = len(found)
            at = self._bytes_added([self.line_break])
            both = self._pairs_added((np.repeat(at[0], n), np.repeat(at[1], n)), (size, start))
            self._remember(["\n" + w for w in found], *both, self._unsafe(found))
        found, size, start = self._plain(list(plain), " " if self.bytewise else "")
        self._remember(found, size, start, self._unsafe(found))
        if marked:
            number = [self.cache[s] for s in stems]
            kinds = {t: i for i, t in enumerate(dict.fromkeys(tails))}
            size, start = self._bytes_added(self.whole(list(kinds)))
            kind = [kinds[t] for t in tails]
            both = self._pairs_added((self.size[number], self.start[number]), (size[kind], start[kind]))
            self._remember(marked, *both, np.zeros(len(marked), bool))

    def _unsafe(self, words: list[str]) -> np.ndarray:
        """Words of a byte-level vocabulary whose white space at the ends would join other."""
        return np.array([self.bytewise and (not w or w[0].isspace() or w[-1].isspace()) for w in words], bool)

    def _remember(self, words: list[str], size: np.ndarray, start: np.ndarray, odd: np.ndarray) -> None:
        self.cache.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.size, self.start = np.concatenate([self.size, size]), np.concatenate([self.start, start])
        self.odd = np.concatenate([self.odd, odd])

    def _keep(self, words: list[str]) -> None:
        """Forget all words but these."""
        numbers = np.array([self.cache[w] for w in words], np.int64)
        flat, ends = laid(self.flat, self.size[numbers], self.start[numbers])
        self.size, self.odd = self.size[numbers], self.odd[numbers]
        self.start, self.flat = ends[:-1], flat
        self.cache = dict(zip(words, range(len(words)), strict=True))

    def _numbers(self, latin: list[str], rest: list[str]) -> np.ndarray:
        words = latin + rest

        def known(some: list[str]) -> np.ndarray:
            return np.fromiter(map(self.cache.get, some, repeat(-1)), np.int64, len(some))

        found = known(words)
        new = np.flatnonzero(found < 0)
        if not len(new):
            return found
        if len(self.cache) + len(new) > (self.most or MAX_CACHED):  # the words of these texts are likely in the next
            self._keep([words[i] for i in np.flatnonzero(found >= 0).tolist()])
            found = known(words)
        n, first = int(np.searchsorted(new, len(latin))), len(self.size)
        others = [words[i] for i in new[n:].tolist()]
        self._learn([words[i] for i in new[:n].tolist()], others)
        found[new[:n]] = np.arange(first, first + n)  # they are numbered as they come
        found[new[n:]] = known(others)
        return found

    def _distinct(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words one after another, where each word's begin, with the end, and which can't be used.

        Of Latin letters with marks behind, only the letters are remembered, in lower case if the model reads them so.
        """
        if not self.direct:
            number = self._numbers([], listed(words))
            return *laid(self.flat, self.size[number], self.start[number]), self.odd[number]
        stems = pc.utf8_rtrim(words, characters=MARKS)
        latin = pc.match_substring_regex(stems, f"^[{ALONE}]+$")
        known = latin.to_numpy(zero_copy_only=False)
        coded = stems.filter(latin)
        coded = (pc.utf8_lower(coded) if self.lower else coded).dictionary_encode()
        number = self._numbers(listed(coded.dictionary), listed(words.filter(pc.invert(latin))))
        of = np.empty(len(words), np.int64)
        of[known] = number[: len(coded.dictionary)][coded.indices.to_numpy()]
        of[~known] = number[len(coded.dictionary) :]
        marked = pc.and_(latin, pc.not_equal(stems, words))
        tails = [w[n:] for w, n in zip(listed(words.filter(marked)), pc.utf8_length(stems.filter(marked)).to_numpy().tolist(), strict=True)]
        kinds = {t: i for i, t in enumerate(dict.fromkeys(tails))}
        found = self.whole(list(kinds))
        each = np.array([len(x) // 4 for x in found], np.int64)
        kind = np.array([kinds[t] for t in tails], np.int64)
        size, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        size[at], start[at] = each[kind], (len(self.flat) + np.cumsum(each) - each)[kind]
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), "<u4")])
        ids, ends = laid(flat, paired(self.size[of], size), paired(self.start[of], start))
        return ids, ends[::2], self.odd[of]

    def encode(self, texts: list[str], at_once: int = 1024) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        if not (self.bytewise or self.wordwise):
            return self.whole(texts)
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for t in texts:
            if some and (len(some) >= at_once or size + len(t) > CHARS):
                out.extend(self._some(some))
                some, size = [], 0
            some.append(t)
            size += len(t)
        return out + self._some(some) if some else out

    def _some(self, texts: list[str]) -> list[bytes]:
        if self.bytewise:  # each line's first word keeps the line break before it, the text's first is given one
            cut = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        else:  # other white space than ASCII's stays in a word, for the library to part
            cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = cut.flatten().dictionary_encode()
        number = coded.indices.to_numpy()
        ids, ends, odd = self._distinct(coded.dictionary)
        ids, ends = laid(ids, np.diff(ends)[number], ends[number])
        bounds = cut.offsets.to_numpy()
        at = 4 * ends[bounds]
        starts = at[:-1] + 4 * self.bytewise  # without the line break before the text
        raw = memoryview(ids).cast("B")
        out = [bytes(raw[a:b]) for a, b in zip(starts.tolist(), at[1:].tolist(), strict=True)]
        odd = odd[number]
        if odd.any():  # white space that belongs to no word
            rest = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(odd)])[bounds])).tolist()
            for i, whole in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
                out[i] = whole
        return out
