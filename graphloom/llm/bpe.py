"""Byte-level BPE ids, with the vocabulary file of a public tokenizer.

Texts are cut into pre-tokens with array operations over code points, and a
pre-token is encoded once and then looked up.  The ids equal those of the
``tokenizers`` library on the same file (tests compare them); that library is
used itself for a file whose merges aren't in the order of the ids.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np

from graphloom.llm._text import _powers, mix

#: Pre-tokens that are kept encoded, known by 64-bit hashes.
CACHE = 1_500_000
#: Characters that are cut and looked up at once.
RUN = 1_000_000
BOUNDARY = "\x00"
_OTHER, _LETTER, _NUMBER, _SPACE, _BOUNDARY = range(5)
# Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACES = frozenset(WHITE_SPACE)
# Endings that are cut off after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@cache
def _kinds() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            table[c] = _LETTER
        elif major == "N":
            table[c] = _NUMBER
    table[WHITE_SPACE] = _SPACE
    return table


@cache
def _values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def cuts(joined: str, boundaries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where pre-tokens begin, a hash of each) in texts joined by a boundary character.

    ``boundaries`` are the places of those characters; each is a pre-token of
    its own.  A pre-token is a run of letters, of numbers or of other
    characters, with one space before it if there is one; an apostrophe's
    ending; or the rest of a run of white space.
    """
    point = np.frombuffer((BOUNDARY + joined + BOUNDARY).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _kinds()[point]
    kind[boundaries + 1] = _BOUNDARY
    kind[0] = kind[-1] = _BOUNDARY
    now, before, after = kind[1:-1], kind[:-2], kind[2:]
    solid = now < _SPACE
    changed = now != before
    begins = solid & changed & (point[:-2] != 0x20)
    space = now == _SPACE
    begins |= space & (changed | (after < _SPACE))
    begins |= now == _BOUNDARY
    lone = (point[1:-1] == 0x27) & (before != _OTHER) & (after == _LETTER) & (point[:-2] != 0x20)
    for i in np.flatnonzero(lone).tolist():
        for ending in ENDINGS:
            if joined.startswith(ending, i + 1):
                begins[i + 1] = False
                stop = i + 1 + len(ending)
                if stop < len(begins) and now[stop] == _LETTER:
                    begins[stop] = True
                break
    start = np.flatnonzero(begins)
    up, down = _powers(len(now) + 1)
    total = np.zeros(len(now) + 1, dtype=np.uint64)
    np.cumsum(_values()[point[1:-1]] * up[: len(now)], out=total[1:])
    stop = np.append(start[1:], len(now))
    return start, mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def _divided(text: str) -> list[str]:
    """Parts of about ``RUN`` characters that begin with white space after something else."""
    if len(text) <= RUN:
        return [text]
    out, low = [], 0
    while len(text) - low > RUN:
        cut = next((i for i in range(low + RUN, len(text)) if text[i] in " \n" and ord(text[i - 1]) not in _SPACES), None)
        if cut is None:
            break
        out.append(text[low:cut])
        low = cut
    return [*out, text[low:]]


def _byte_of() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of()
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ranked = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(vocab) == 256 + len(merges)
        self.fast = ranked and all(all(c in byte for c in t) for t in vocab)
        if self.fast:
            import tiktoken

            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
            self._tiktoken = tiktoken.Encoding("many", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks, special_tokens={})
            self._single = tiktoken.Encoding("single", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
            self._separator = ranks[BOUNDARY.encode()]
        self._forget()

    def _forget(self) -> None:
        """What is known of pre-tokens: sorted hashes, and for each a range of ``_ids``."""
        self._known = np.zeros(0, np.uint64)
        self._first, self._size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._ids = np.zeros(0, "<u4")

    def _learn(self, value: np.ndarray, pieces: list[str]) -> None:
        """Encode pre-tokens of new hashes (sorted) and merge them in."""
        if len(self._known) + len(value) > CACHE:
            self._forget()
        plain = [p if BOUNDARY not in p else "" for p in pieces]
        # One call encodes all: the separator stands between pre-tokens and is one id.
        ids = np.asarray(self._tiktoken.encode_to_numpy(BOUNDARY.join(plain), disallowed_special=()), dtype="<u4")
        cut = np.concatenate([[-1], np.flatnonzero(ids == self._separator), [len(ids)]])
        first, size = cut[:-1] + 1, np.diff(cut) - 1
        odd = [i for i, p in enumerate(pieces) if BOUNDARY in p]
        for i in odd:
            own = np.array(self._single.encode_ordinary(pieces[i]), dtype="<u4")
            first[i], size[i] = len(ids), len(own)
            ids = np.concatenate([ids, own])
        at = np.searchsorted(self._known, value)
        self._known = np.insert(self._known, at, value)
        self._first = np.insert(self._first, at, first + len(self._ids))
        self._size = np.insert(self._size, at, size)
        self._ids = np.concatenate([self._ids, ids])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without special tokens; a special token's string is ordinary text.

        Texts are taken in runs of about ``RUN`` characters; a longer text is
        divided where a pre-token begins whatever comes before it.
        """
        if not self.fast:
            return self._plain(texts)
        parts: list[str] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            for part in _divided(text):
                parts.append(part)
                owner.append(i)
        out = [b""] * len(texts)
        low = 0
        while low < len(parts):
            high, size = low, 0
            while high < len(parts) and (high == low or size + len(parts[high]) <= RUN):
                size += len(parts[high])
                high += 1
            for i, ids in zip(owner[low:high], self._run(parts[low:high]), strict=True):
                out[i] = out[i] + ids if out[i] else ids
            low = high
        return out

    def _run(self, texts: list[str]) -> list[bytes]:
        joined = BOUNDARY.join(texts)
        if not joined:
            return [b""] * len(texts)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        start, value = cuts(joined, ends[:-1])
        distinct, first, which = np.unique(value, return_index=True, return_inverse=True)
        at = np.searchsorted(self._known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        there = at < len(self._known)
        new[there] = self._known[at[there]] != distinct[there]
        if new.any():
            if len(self._known) + int(new.sum()) > CACHE:
                new[:] = True
            stop = np.append(start, len(joined))[first + 1]
            self._learn(distinct[new], [joined[a:b] for a, b in zip(start[first[new]].tolist(), stop[new].tolist(), strict=True)])
            at = np.searchsorted(self._known, distinct)
        size = self._size[at]
        sizes = size[which]
        sizes[np.searchsorted(start, ends[:-1])] = 0  # the boundaries
        total = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(total[-1]) + np.repeat(self._first[at][which] - total[:-1], sizes)
        data = self._ids[places].tobytes()
        low = total[np.searchsorted(start, np.concatenate([[0], ends[:-1] + 1]))].tolist()
        high = total[np.searchsorted(start, ends)].tolist()
        return [data[4 * a : 4 * b] for a, b in zip(low, high, strict=True)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        from tokenizers import Tokenizer

        if not hasattr(self, "_tokenizer"):
            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.encode_special_tokens = True
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
