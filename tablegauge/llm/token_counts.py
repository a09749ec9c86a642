"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and one for
those that continue it. Each state has a failure link to the state that remains after
the longest pieces are popped from its string, and the number of pieces popped, so
greedy longest-match counts come in one pass over a word, without building any piece.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame

from .common import Memory, document_rows, with_computed

CACHE_WORDS = 500_000
_UNKNOWN = 1 << 40


class CountAutomaton:
    """Counts greedy pieces of a word; ``first`` begin words, ``rest`` continue them."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]  # state 0 begins a word, state 1 continues it
        final = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                at = root
                for byte in piece:
                    to = self.next[at].get(byte)
                    if to is None:
                        to = self.next[at][byte] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    at = to
                final[at] |= at > 1
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for byte, v in self.next[u].items():
                if final[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, popped = self.fail[u], self.popped[u]
                    while z >= 0 and byte not in self.next[z]:
                        popped += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][byte], popped
                queue.append(v)
        self.known = Memory(self._count, CACHE_WORDS)

    def _count(self, word: bytes) -> int:
        step, fail, popped = self.next, self.fail, self.popped
        at = count = 0
        for byte in word:
            while (to := step[at].get(byte)) is None:
                count += popped[at]
                at = fail[at]
                if at < 0:
                    return _UNKNOWN + 1
            at = to
        while at != 1:
            count += popped[at]
            at = fail[at]
            if at < 0:
                return _UNKNOWN + 1
        return count

    def count(self, words: list[bytes]) -> tuple[int, int]:
        """Tokens of the words, and how many of the words are unknown (one token each)."""
        total = sum(map(self.known.__getitem__, words))
        return total % _UNKNOWN, total // _UNKNOWN


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary file: those after a space, and those without one."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    pieces = [bytes(byte[c] for c in p) for p in spec["model"]["vocab"] if p not in special]
    return [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1], [p for p in pieces if p[:1] != b" "]


_AUTOMATA: dict[str, CountAutomaton] = {}


def automaton(path: str) -> CountAutomaton:
    """One automaton per worker and vocabulary file."""
    if path not in _AUTOMATA:
        _AUTOMATA[path] = CountAutomaton(*byte_level_pieces(path))
    return _AUTOMATA[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` for every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, of any length; a word the pieces
    cannot spell counts as one unknown token. Null and empty texts count zero. Rows,
    null ids and repeated ids among them, are counted each by itself, other columns are
    ignored, an empty table gives an empty one.
    """

    def compute(texts: list[bytes]) -> dict:
        counts = automaton(vocabulary)
        words = [t.split() for t in texts]
        tokens, unknown = zip(*map(counts.count, words), strict=True)
        return {"n_words": list(map(len, words)), "n_tokens": tokens, "n_unknown": unknown}

    return with_computed(document_rows(docs, id_col, text_col), compute, "n_words long, n_tokens long, n_unknown long")
