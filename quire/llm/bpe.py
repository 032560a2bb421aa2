"""Encoding by a byte-level BPE vocabulary in linear time.

A vocabulary's tokens are mapped from bytes to Latin-1 and put into one Aho-Corasick automaton. Of
each piece that the pattern splits off, the automaton finds the longest token at every place. The
merge order's result is the only segmentation whose adjacent tokens are all compatible: merging the
bytes of two neighbours gives the same two tokens. So the longest match is taken, shortened to the
next shorter token while it isn't compatible with its left neighbour, and given back when no shorter
one is left; places from which nothing fits are marked and never tried twice. Compatibility is
memoised, and so are whole pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import regex

#: The pattern that the vocabulary's merges were made with: a fixed value of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Memoised pieces and token pairs are dropped when there are more than this; results don't depend on it.
MEMO = 400_000


def merged(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of ``data`` by the merge order itself: the lowest-ranked adjacent pair first."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], len(ranks)), i) for i in range(len(parts) - 1))
        if rank == len(ranks):
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class ByteBpe:
    """An encoder made of the text of a rank file: lines of base64 token and rank."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.text = {i: t.decode("latin-1") for t, i in self.ranks.items()}
        self.size = {i: len(t) for i, t in self.text.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1 if there is none."""
        found = self._shorter.get(token)
        if found is None:
            t, found = self.text[token].encode("latin-1"), -1
            for n in range(len(t) - 1, 0, -1):
                if (found := self.ranks.get(t[:n], -1)) >= 0:
                    break
            self._shorter[token] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merge order keeps ``a`` and ``b`` apart when they are neighbours."""
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) > MEMO:
                self._pairs.clear()
            found = self._pairs[a, b] = merged((self.text[a] + self.text[b]).encode("latin-1"), self.ranks) == [a, b]
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [0] * n
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # ends grow, so the last for a place is its longest
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            end = at + self.size[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = self.shorter(token)
            while token < 0:  # nothing fits here after this neighbour: give the neighbour back
                dead[at] = 1
                last = out.pop()
                at -= self.size[last]
                token = self.shorter(last)
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text`` without special tokens; null and empty texts have none."""
        if not text:
            return []
        out: list[int] = []
        known = self._pieces
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                data = piece.encode("utf-8", "replace")
                whole = self.ranks.get(data)
                ids = (whole,) if whole is not None else tuple(self.encode_piece(data))
                if len(piece) <= 64:
                    if len(known) > MEMO:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def encode_batch(self, texts: Iterator[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each begins and ends."""
        ids: list[int] = []
        ends = [0]
        for t in texts:
            ids += self.encode(t)
            ends.append(len(ids))
        return np.array(ids, dtype=np.int32), np.array(ends, dtype=np.int32)
