"""SentencePiece encoding and decoding by weighted finite-state composition.

A model file compiles to three transducers: the normaliser (dummy prefix, spaces to
``U+2581``, runs of spaces kept or joined as the model says), the piece lexicon (a trie
whose final states emit a piece at its weight and return to the root) and byte fallback (a
character that is no piece emits its UTF-8 bytes). An input composes with them into a
lattice over its characters; the ids are the labels of the tropical-semiring shortest path.

Unigram models weigh a piece by its negative score. A merge (BPE) model's segmentation is
not an additive minimum, but it is the one path in which every two neighbours, merged on
their own, stay apart; so there a lattice state is a position with the piece before it, an
arc costs nothing if it stays apart from that piece and infinity if it would merge with it,
and each position has one finite state. Either way each position is settled once, in time
linear in the text.

No piece of a usable model has a word mark after another character, so the lattice falls
apart before each run of marks, and words are solved once and remembered.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, document_rows, with_computed

MARK = "▁"
#: Words and pairs of pieces a worker remembers.
CACHE_WORDS, CACHE_PAIRS = 200_000, 150_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one serialised protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


class PieceModel:
    """Pieces, scores and normaliser options of a model file's bytes."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the format

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.merges, self.byte_fallback = False, False
        self.dummy_prefix, self.join_spaces = True, True
        for field, value in _fields(data):
            if field == 1:
                part = dict(_fields(value))
                self.pieces.append(part[1].decode())
                self.scores.append(float(np.frombuffer(part.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(part.get(3, self.NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
                self.merges = trainer.get(3, 1) == 2
                self.byte_fallback = bool(trainer.get(35, 0))
                if trainer.get(3, 1) not in (1, 2):
                    raise ValueError("a unigram or merge model is expected")
            elif field == 3:
                norm = dict(_fields(value))
                if norm.get(2):
                    raise ValueError("character maps other than identity are not supported")
                self.dummy_prefix, self.join_spaces = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if self.USER in self.kinds or self.UNUSED in self.kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.unknown = self.kinds.index(self.UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == self.NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == self.BYTE}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a word mark inside")


class Normaliser:
    """The compiled normaliser: for a state and a kind of character, what is emitted and the next state.

    ``{}`` in an output stands for the character itself. From ``GAP`` a space is still owed.
    """

    START, WORD, GAP = 0, 1, 2

    def __init__(self, dummy_prefix: bool, join_spaces: bool):
        first = MARK if dummy_prefix else ""
        self.prefix, self.join = first, join_spaces
        if join_spaces:
            self.arcs = {
                (self.START, True): ("", self.START), (self.START, False): (first + "{}", self.WORD),
                (self.WORD, True): ("", self.GAP), (self.WORD, False): ("{}", self.WORD),
                (self.GAP, True): ("", self.GAP), (self.GAP, False): (MARK + "{}", self.WORD),
            }
        else:
            self.arcs = {(self.START, True): (first + MARK, self.WORD), (self.START, False): (first + "{}", self.WORD), (self.WORD, True): (MARK, self.WORD), (self.WORD, False): ("{}", self.WORD)}

    def run(self, text: str, state: int = START) -> str:
        """The output for ``text`` from a state on."""
        if state == self.WORD and not self.join:  # a state that returns to itself
            return text.replace(" ", MARK)
        out = []
        for c in text:
            emitted, state = self.arcs[state, c in " " + MARK]
            out.append(emitted.replace("{}", c))
        return "".join(out)

    #: A run of marks and spaces with the word after it; the state before each such run is ``WORD``.
    RUN = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")


class PieceTransducer:
    """The compiled model: encodes by shortest path and decodes."""

    def __init__(self, data: bytes):
        self.model = m = PieceModel(data)
        self.normaliser = Normaliser(m.dummy_prefix, m.join_spaces)
        #: Of a piece of a merge model: its rank among merges, and the two parts it is merged from.
        self.rank: dict[str, int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        if m.merges:
            self.rank = {p: k for k, p in enumerate(sorted((p for p in m.ids if len(p) > 1), key=lambda p: -m.scores[m.ids[p]]))}
            self._derive()
        #: Pieces that merging makes of their own characters; others never come up.
        self.usable = {p for p in m.ids if len(p) == 1} | self.halves.keys()
        self.longest = max(map(len, self.usable), default=1)
        self.trie: dict = {}  # state -> character -> state; the key "" holds the weight of a final arc
        for piece, i in m.ids.items() if not m.merges else ():
            state = self.trie
            for c in piece:
                state = state.setdefault(c, {})
            state[""] = -m.scores[i]
        worst = max([-s for s, k in zip(m.scores, m.kinds, strict=True) if k == m.NORMAL], default=0.0)
        self.unknown_cost = worst + 10.0  # fixed value of the format
        self.apart = Memory(lambda pair: self._apart(*pair), CACHE_PAIRS)
        self.words = Memory(lambda w: self._packed(self.normaliser.run(w, Normaliser.WORD)), CACHE_WORDS)
        self.out: list[str | bytes] = []
        for p, k in zip(m.pieces, m.kinds, strict=True):
            text = bytes([int(p[3:5], 16)]) if k == m.BYTE else b"" if k == m.CONTROL else " ⁇ ".encode() if k == m.UNKNOWN else p.replace(MARK, " ").encode()
            self.out.append(text)

    def _derive(self) -> None:
        """Merge every piece's characters, best rank and then leftmost first, and note its last merge."""
        rank = self.rank
        for piece in rank:
            parts = list(piece)
            while len(parts) > 2:
                found = [(r, k) for k in range(len(parts) - 1) if (r := rank.get(parts[k] + parts[k + 1])) is not None]
                if not found:
                    break
                _, k = min(found)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2:
                self.halves[piece] = parts[0], parts[1]
        if any(rank[h] > rank[p] for p, both in self.halves.items() for h in both if h in rank):
            raise ValueError("a piece is merged before its parts")

    def _apart(self, a: str, b: str) -> bool:
        """Whether two neighbouring pieces stay what they are: no merge across them comes before their own.

        Follows the parts of ``a`` at its right end and those of ``b`` at its left end in the
        order in which they come up.
        """
        rank, halves = self.rank, self.halves
        left, right = [a], [b]
        while left[-1] in halves:
            left.append(halves[left[-1]][1])
        while right[-1] in halves:
            right.append(halves[right[-1]][0])
        a, b = left.pop(), right.pop()
        never = len(rank)
        while True:
            across = rank.get(a + b, never)
            next_a = rank[left[-1]] if left else never
            next_b = rank[right[-1]] if right else never
            if next_a <= next_b:  # of equal ranks the left one merges first
                if across < next_a:
                    return False
                if next_a == never:
                    return True
                a = left.pop()
            else:
                if across <= next_b:
                    return False
                b = right.pop()

    def _fallback(self, char: str) -> list[int]:
        m = self.model
        return [m.bytes[b] for b in char.encode()] if m.byte_fallback else [m.unknown]

    def _emit(self, parts: Iterable[str]) -> list[int]:
        """Labels of a path's arcs."""
        out, m, ids = [], self.model, self.model.ids
        for p in parts:
            i = ids.get(p)
            if i is not None:
                out.append(i)
            elif m.byte_fallback or not out or out[-1] != m.unknown:  # neighbouring unknowns are one
                out += self._fallback(p)
        return out

    def path(self, text: str) -> list[int]:
        """Labels of the shortest path through the lattice of a normalised text."""
        last = self._finite(text) if self.model.merges else self._least(text)
        out, n = [], len(text)
        while n:
            out.append(last[n])
            n -= len(last[n])
        return self._emit(out[::-1])

    def _least(self, text: str) -> list[str]:
        """The last arc of the least path to each position, settled in order."""
        n, inf = len(text), float("inf")
        cost, last = [0.0] + [inf] * n, [""] * (n + 1)
        for i in range(n):
            state, j, single = self.trie, i, False
            while j < n and (state := state.get(text[j])) is not None:
                j += 1
                weight = state.get("")
                if weight is not None:
                    single |= j == i + 1
                    if cost[i] + weight < cost[j]:
                        cost[j], last[j] = cost[i] + weight, text[i:j]
            if not single and cost[i] + self.unknown_cost < cost[i + 1]:
                cost[i + 1], last[i + 1] = cost[i] + self.unknown_cost, text[i]
        return last

    def _finite(self, text: str) -> list[str]:
        """The last arc of the one finite path to each position that is asked for.

        All arcs weigh nothing or infinitely much, so the composition is expanded on demand
        from the final position back: an arc into it asks for the path to where it begins,
        whose last arc is the state that weighs it. Each position is settled once; an
        explicit stack serves texts of any length.
        """
        usable, apart, longest = self.usable, self.apart, self.longest
        n = len(text)
        last = [""] * (n + 1)
        stack = [(n, min(n, longest))] if n else []
        while stack:
            j, size = stack.pop()
            while True:
                i = j - size
                arc = text[i:j]
                if size == 1 or arc in usable:
                    if not i:
                        break
                    before = last[i]
                    if not before:
                        stack.append((j, size))
                        stack.append((i, i if i < longest else longest))
                        arc = ""
                        break
                    if apart[before, arc]:
                        break
                size -= 1
            last[j] = arc
        return last

    def _packed(self, text: str) -> bytes:
        return array("I", self.path(text)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        norm, known = self.normaliser, self.words
        if not text.startswith((" ", MARK)) and not text.endswith(" ") and "  " not in text and MARK not in text and text and norm.prefix:
            found = [known[" " + w] for w in text.split(" ")]  # the prefix is as a space before the first word
        else:
            first, *rest = norm.RUN.findall(text) or [""]
            found = [self._packed(norm.run(first)), *[known[w] for w in rest]]
        return np.frombuffer(b"".join(found), np.uint32)

    def decode(self, ids: Iterable[int]) -> bytes:
        """The text of ids, as UTF-8; byte pieces that are not UTF-8 become U+FFFD."""
        out = self.out
        text = b"".join([out[i] for i in ids])
        text = text[1:] if self.model.dummy_prefix and text.startswith(b" ") else text
        return text.decode("utf-8", "replace").encode()


_MODELS: dict[str, PieceTransducer] = {}


def transducer(path: str) -> PieceTransducer:
    """One compiled model per worker and file."""
    if path not in _MODELS:
        with open(path, "rb") as f:
            _MODELS[path] = PieceTransducer(f.read())
    return _MODELS[path]


def encoded(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``doc_id, ids, decoded`` for every row: piece ids, and the text decoded from them.

    ``keep_text`` adds ``text``, the input with null as empty.

    The model file must lie on every executor (a public vocabulary, not part of the
    job's data). Null and empty texts have no ids and decode to an empty text. Texts may
    have any length; rows, null ids and repeated ids among them, are encoded each by itself.
    Other columns are ignored, an empty table gives an empty one.
    """

    def compute(texts: list[bytes]) -> dict:
        fst = transducer(model_file)
        ids = [fst.encode(t.decode()) for t in texts]
        return {"ids": [i.view(np.int32) for i in ids], "decoded": [fst.decode(i.tolist()).decode() for i in ids]}

    rows = document_rows(docs, id_col, text_col)
    out = with_computed(rows, compute, "ids array<int>, decoded string", keep=keep_text)
    return out.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))) if keep_text else out


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pieces, n_bytes, ids_crc32, decoded_sha256, lossless``, without moving ids out of the task.

    ``n_bytes`` counts byte-fallback pieces, ``ids_crc32`` covers the ids as little-endian
    unsigned 32-bit integers, ``lossless`` says whether decoding gave the text back.
    Edge cases are those of ``encoded``.
    """

    def compute(texts: list[bytes]) -> dict:
        fst = transducer(model_file)
        is_byte = np.array([k == PieceModel.BYTE for k in fst.model.kinds])
        out = []
        for text in texts:
            ids = fst.encode(text.decode())
            back = fst.decode(ids.tolist())
            out.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back).hexdigest(), back == text))
        return dict(zip(("n_pieces", "n_bytes", "ids_crc32", "decoded_sha256", "lossless"), zip(*out, strict=True), strict=True))

    return with_computed(document_rows(docs, id_col, text_col), compute, "n_pieces long, n_bytes long, ids_crc32 long, decoded_sha256 string, lossless boolean")
