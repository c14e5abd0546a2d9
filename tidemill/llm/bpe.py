"""Byte-level BPE by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never end up inside one token, so a text may be cut between
the two bytes, and the fragments are encoded on their own and their ids joined.  The tokenizer first splits a text into
words by a pattern, which must find the same words in the fragments; therefore

* a cut is made only between whole characters, and never after white space (a word may begin with a space, and the
  pattern looks ahead at the end of a run of white space),
* never before an apostrophe (at the beginning of a fragment it could open a contraction that is none in the text),
* before white space that follows another character a word always ends, so a cut before a space there needs no proof by pairs.

Everywhere else the pattern's words are runs of one class of characters, which a cut only shortens.  Fragments repeat a
lot, so each Python worker keeps the ids of the fragments that it has met (a bounded table).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Fragments of up to 24 bytes that a worker remembers (about 40 MB); others are encoded each time.
REMEMBERED, LONGEST = 150_000, 24
#: White space beyond ASCII, as the word pattern or Python knows it.
_WIDE_SPACE = re.compile(r"[^\S\x00-\x7f]")
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[*range(9, 14), *range(28, 33)]] = True


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Fragments(dict):
    """Fragment (bytes) -> its ids as little-endian 32-bit numbers."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, fragment: bytes) -> bytes:
        ids = np.array(self.encode(fragment.decode()), "<u4").tobytes()
        if len(self) < REMEMBERED and len(fragment) <= LONGEST:
            self[fragment] = ids
        return ids


class ForcedBoundaryBPE:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, letters = spec["pre_tokenizer"], byte_letters()
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level vocabularies with the standard word pattern are supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][a + b] for a, b in merges]
        if any(x >= y for x, y in zip(order, order[1:])):
            raise ValueError("ids must follow the order of the merges")
        self.inside = np.zeros((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            self.inside[b[:-1], b[1:]] = True
        #: Pairs between which a text may be cut: never inside a token, or a space after another character.
        self.cut = ~self.inside
        self.cut[:, 32] = True
        self.cut[_ASCII_SPACE] = False
        self.cut[:, ord("'")] = False
        self.cut[:, 128:192] = False  # inside a character
        for ending in ("s", "t", "re", "ve", "m", "ll", "d"):  # nor inside a contraction, whatever the vocabulary
            for x, y in zip("'" + ending, ending):
                self.cut[ord(x), ord(y)] = False
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encode_whole = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known = Fragments(self.encode_whole)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*ranks.values(), *self.special.values()]) + 1
        token_bytes: list[bytes] = [b""] * size
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            token_bytes[i] = token
        self.token_len = np.array([len(t) for t in token_bytes], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])[:-1]
        self.letters = np.frombuffer(b"".join(token_bytes), np.uint8)

    def cuts(self, raw: bytes, text: str) -> np.ndarray:
        """Places in the UTF-8 bytes ``raw`` of ``text`` where it may be cut."""
        b = np.frombuffer(raw, np.uint8)
        forced = self.cut[b[:-1], b[1:]]
        if len(raw) != len(text):
            wide = [space.end() for space in _WIDE_SPACE.finditer(text)]
            if wide:
                begin = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
                after = begin[wide]
                forced[after[after < len(b)] - 1] = False
        return np.flatnonzero(forced) + 1

    def _ordinary(self, text: str) -> bytes:
        raw = text.encode()
        at = [0, *self.cuts(raw, text).tolist(), len(raw)]
        return b"".join([self.known[raw[i:j]] for i, j in zip(at, at[1:])]) if raw else b""

    def encode_bytes(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit numbers."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        return b"".join(
            self.special[p].to_bytes(4, "little") if k % 2 else self._ordinary(p) if p else b"" for k, p in enumerate(self.split_special.split(text))
        )

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens one after the other, gathered in one step."""
        ids = np.asarray(ids, np.int64)
        lengths = self.token_len[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        index = np.arange(ends[-1]) + np.repeat(self.token_at[ids] - (ends - lengths), lengths)
        return self.letters[index].tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBPE:
    """One encoder per vocabulary file and Python worker."""
    return ForcedBoundaryBPE(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
