"""Byte-pair encodings of all prefixes of a word by dynamic programming.

A sequence of tokens is what greedy merging makes of a text if and only if each
token is made of itself and each adjacent pair of tokens is made of itself.  So
the encoding of a prefix is the encoding of a shorter prefix plus one last
token, and that token is the only one that fits the last token before it.  One
pass over a word therefore yields the token count and the last token of every
prefix, without merging the word itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from os.path import commonprefix

#: Entries of a memo before it starts anew, and pairs of tokens; both bound a worker's memory.
MEMO, PAIRS = 250_000, 300_000


class Memo(dict):
    """A dict of two generations: the older goes when the younger is full."""

    def __init__(self, size: int = MEMO):
        super().__init__()
        self.size, self.old = size, {}

    def __missing__(self, key):
        value = self.old[key]  # KeyError if unknown
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


class PrefixBpe:
    """Tables of prefixes for one vocabulary.

    ``rank(a, b)`` is the priority of merging two adjacent tokens (least first),
    or None; ``suffix`` is what the last symbol of a word carries.
    """

    def __init__(self, tokens: set[str], rank: Callable[[str, str], float | None], suffix: str = ""):
        self.rank, self.suffix = rank, suffix
        self.made: dict[str, tuple[float, str, str] | None] = {}
        self.inner = {t: t for t in tokens if not suffix or not t.endswith(suffix)}
        self.closing = {t[: -len(suffix)]: t for t in tokens if t.endswith(suffix)} if suffix else self.inner
        self.tails = self._tails(self.inner), self._tails(self.closing)
        self._start()

    @staticmethod
    def _tails(tokens: dict[str, str]) -> dict[str, str | None]:
        """Every ending of a token, with the token that it is itself, if any."""
        out: dict[str, str | None] = {t[k:]: None for t in tokens for k in range(1, len(t))}
        return out | tokens

    def _start(self) -> None:
        """Empties what is remembered between words."""
        self.size = 0
        self.rows: dict[str, tuple[dict, dict]] = {}
        self.barrier = self._follow("")

    def _follow(self, last: str) -> tuple[dict, dict]:
        """Which tokens are known to follow a last token or not, inside and at the end of a word."""
        rows = self.rows.get(last)
        if rows is None:
            self.size += 2
            rows = self.rows[last] = ({}, {}) if self.suffix else ({},) * 2
        return rows

    def _made(self, token: str) -> tuple[float, str, str] | None:
        """Rank and halves of the merge that completes ``token``: rank -1 for one
        symbol, None if greedy merging of its symbols doesn't end in it."""
        try:
            return self.made[token]
        except KeyError:
            tail = len(self.suffix) if self.suffix and token.endswith(self.suffix) and token != self.suffix else 0
            body = token[: len(token) - tail]
            symbols = [*body[:-1], body[-1] + token[len(token) - tail :]]
            last: tuple[float, str, str] | None = (-1.0, "", "")
            while len(symbols) > 1:
                best = min(((r, k) for k in range(len(symbols) - 1) if (r := self.rank(symbols[k], symbols[k + 1])) is not None), default=None)
                if best is None:
                    last = None
                    break
                r, k = best
                last = (r, symbols[k], symbols[k + 1])
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            self.made[token] = last
            return last

    def merges(self, token: str) -> list[tuple[float, int]] | None:
        """Rank and offset of every merge that makes ``token`` (no suffix on it); None
        if merging doesn't make it, or a part of it ranks after the whole."""
        out, parts = [], [(token, 0)]
        while parts:
            part, at = parts.pop()
            made = self._made(part)
            if made is None:
                return None
            rank, left, right = made
            if rank < 0:
                continue
            if any(self.made[x][0] > rank for x in (left, right) if self._made(x) is not None):
                return None
            out.append((rank, at))
            parts += [(left, at), (right, at + len(left))]
        return out

    def paired(self, last: str, token: str) -> bool:
        """Whether two tokens stand side by side after merging; an empty one is a
        barrier, or a symbol outside the vocabulary."""
        if not last or not token:
            return True
        row = self._follow(last)[0]
        fits = row.get(token)
        if fits is None:
            self.size += 1
            fits = row[token] = self._fits(last, token)
        return fits

    def _fits(self, last: str, token: str) -> bool:
        """Whether ``token`` may follow ``last``; an empty ``last`` is a barrier.

        The merges of both are undone from the latest to the earliest.  A merge
        across the border would have come first if it ranks before the merges
        that consumed the symbols beside the border (of equal ranks the left
        one comes first).
        """
        ours = self._made(token)
        if ours is None:
            return False
        if not last:
            return True
        theirs = self._made(last)
        used_left = used_right = float("inf")
        while True:
            r = self.rank(last, token)
            if r is not None and r < used_left and r <= used_right:
                return False
            if theirs[0] < 0 and ours[0] < 0:
                return True
            if theirs[0] > ours[0]:
                used_left, last = theirs[0], theirs[2]
                theirs = self._made(last)
            else:
                used_right, token = ours[0], ours[1]
                ours = self._made(token)

    def _last(self, word: str, end: int, path: list[tuple], closed: bool) -> int:
        """Start of the last token of ``word[:end]``; -1 if its last symbol is outside the vocabulary."""
        tails, side = self.tails[closed], int(closed)
        for start in range(end - 1, -1, -1):
            token = word[start:end]
            made = tails.get(token, "")
            if made == "":  # no token ends so
                return -1
            if made is not None:
                state = path[start]
                row = state[3][side]
                fits = row.get(token)
                if fits is None:
                    fits = row[token] = self._fits(state[2], made)
                    self.size += 1
                if fits:
                    return start
        return -1

    def _extend(self, word: str, path: list[tuple]) -> list[tuple]:
        """``path``, the table of a prefix of ``word``, made that of the whole word."""
        for end in range(len(path), len(word) + 1):
            start = self._last(word, end, path, False)
            if start < 0:
                path.append((path[end - 1][0] + 1, end - 1, "", self.barrier))
            else:
                token = word[start:end]
                path.append((path[start][0] + 1, start, token, self._follow(token)))
        return path

    def table(self, word: str) -> list[tuple]:
        """For all prefixes of ``word``, the empty one first, none of them taken as
        the end of a word: their count, the start of their last token, that token,
        and what may follow it.  A symbol outside the vocabulary is a token of its
        own that nothing merges with."""
        if self.size > PAIRS:
            self._start()
        return self._extend(word, [(0, 0, "", self.barrier)])

    def encode_sorted(self, words: list[str]) -> Iterator[list[tuple[int, int]]]:
        """Token spans of each word.  Words in a row share the table of the prefix that
        they have in common.  For vocabularies without word ends."""
        last, path = "", [(0, 0, "", self.barrier)]
        for word in words:
            if self.size > PAIRS:
                self._start()
                last, path = "", [(0, 0, "", self.barrier)]
            shared = len(commonprefix((last, word)))
            last, path = word, self._extend(word, path[: shared + 1])
            spans, start = [], len(word)
            while start > 0:
                start, end = path[start][1], start
                spans.append((start, end))
            yield spans[::-1]

    def _closed(self, word: str, end: int, path: list[tuple]) -> int:
        """Start of the last token of ``word[:end]`` taken as a word of its own."""
        if not self.suffix:
            return path[end][1]
        start = self._last(word, end, path, True)
        return end - 1 if start < 0 else start

    def encode(self, word: str) -> list[tuple[int, int]]:
        """Token spans of the whole word."""
        if not word:
            return []
        path = self.table(word[:-1] if self.suffix else word)
        end = len(word)
        start = self._closed(word, end, path)
        spans = [(start, end)]
        while start > 0:
            start, end = path[start][1], start
            spans.append((start, end))
        return spans[::-1]

    def count(self, word: str) -> int:
        """Tokens of the whole word."""
        if not word:
            return 0
        path = self.table(word[:-1] if self.suffix else word)
        return path[self._closed(word, len(word), path)][0] + 1

    def prefix_counts(self, word: str) -> list[int]:
        """Tokens of ``word[:k]`` taken as a word of its own, for every k."""
        path = self.table(word)
        return [0, *(path[self._closed(word, k, path)][0] + 1 for k in range(1, len(word) + 1))]
