"""Token-ID files: fixed-width bit packing with block offsets.

File layout (little endian), one file per run of consecutive documents:

====================  ==========================================================
bytes                 content
====================  ==========================================================
4                     magic ``TGP1``
4                     bits per id (the minimum for the vocabulary)
4                     ids per block, a multiple of 8
8, 8                  number of ids, number of blocks
8 x blocks            byte offset of each block, from the start of the payload
payload               ids packed most significant bit first, block after block
====================  ==========================================================

Every block begins on a byte, so any block unpacks without those before it.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memory, document_rows, text_groups, written

MAGIC, HEAD = b"TGP1", struct.Struct("<4sIIQQ")
BLOCK = 4096
END_ID = 0
#: Ids of a file, or as many more as its last document has.
FILE_IDS = 1 << 19
#: Words whose ids a worker keeps; beyond it the table starts anew.
CACHE_WORDS = 400_000


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id of a vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def _pack_eights(ids: np.ndarray, bits: int) -> np.ndarray:
    """Every eight ids fill ``bits`` bytes, most significant bit first."""
    cols = ids.reshape(-1, 8).T.astype(np.uint64)
    out = np.zeros((ids.size // 8, bits), np.uint8)
    for k in range(bits):
        byte = np.zeros(len(out), np.uint64)
        for j in range(8 * k // bits, min(8, (8 * k + 7) // bits + 1)):
            shift = (j + 1) * bits - 8 * (k + 1)
            byte |= cols[j] >> np.uint64(shift) if shift >= 0 else cols[j] << np.uint64(-shift)
        out[:, k] = byte & np.uint64(255)
    return out.reshape(-1)


def _unpack_eights(data: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of ``_pack_eights``."""
    cols = data.reshape(-1, bits).T.astype(np.uint64)
    out = np.zeros((cols.shape[1], 8), np.uint32)
    for j in range(8):
        value = np.zeros(len(out), np.uint64)
        for k in range(j * bits // 8, ((j + 1) * bits - 1) // 8 + 1):
            shift = (j + 1) * bits - 8 * (k + 1)
            value |= cols[k] << np.uint64(shift) if shift >= 0 else cols[k] >> np.uint64(-shift)
        out[:, j] = value & np.uint64((1 << bits) - 1)
    return out.reshape(-1)


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """Pack unsigned ids below ``2**bits``; raises ``ValueError`` for one beyond."""
    ids = np.asarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    count = -(-len(ids) // block)
    offsets = np.arange(count, dtype="<u8") * np.uint64(block * bits // 8)
    parts = [HEAD.pack(MAGIC, bits, block, len(ids), count), offsets.tobytes()]
    for at in range(0, len(ids), 64 * block):  # a group of whole blocks at a time bounds memory
        some = ids[at : at + 64 * block]
        parts.append(_pack_eights(np.pad(some, (0, -len(some) % 8)), bits).tobytes())
    return b"".join(parts)


class PackedFile:
    """Random access to a packed file."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, self.count, blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        self.offsets = np.frombuffer(data, "<u8", blocks, HEAD.size)
        self.payload = np.frombuffer(data, np.uint8, offset=HEAD.size + 8 * blocks)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids ``start .. start + n``, unpacked from the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        if start < 0 or start + n > self.count:
            raise IndexError("beyond the file")
        a, b = start // self.block, (start + n - 1) // self.block + 1
        low = int(self.offsets[a])
        high = int(self.offsets[b]) if b < len(self.offsets) else len(self.payload)
        ids = _unpack_eights(self.payload[low:high], self.bits)
        return ids[start - a * self.block :][:n]


#: Fixed value: the byte-level tokenizer's own pattern of pre-tokens.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class WordEncoder:
    """The tokenizer's ids of a text, remembering those of each space-delimited word.

    A pre-token never reaches from a non-space into a following space, so a text cut
    before each lone inner space encodes piece by piece, with the library's own model
    for every pre-token. A text with other white space beside a space, or with an added
    token, goes to the library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(PRE_TOKENS).findall
        model, letters = self.tokenizer.model, self._letters()

        def ids(pre_token: str) -> bytes:
            if pre_token.isascii() and pre_token.isprintable():  # printable letters stand for themselves
                mapped = pre_token.replace(" ", "\u0120")
            else:
                mapped = pre_token.encode().decode("latin-1").translate(letters)
            return array("I", [t.id for t in model.tokenize(mapped)]).tobytes()

        self.ids, self.marks = ids, {m: ids(m) for m in ".,"}
        self.inner = Memory(self._inner, CACHE_WORDS)

    def _letters(self) -> dict[int, str]:
        """The character that stands for each byte: printable ones for themselves, others from 256 on."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in own]
        return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}

    def _inner(self, word: str) -> bytes | None:
        """Ids of a word after a space."""
        if word.isalpha():  # one pre-token, or one and a mark
            return self.ids(" " + word)
        if word[-1:] in self.marks and word[:-1].isalpha():
            return self.inner[word[:-1]] + self.marks[word[-1]]
        return self._any(" " + word)

    def _any(self, word: str) -> bytes | None:
        """Ids of a word with its space, if it has one; ``None`` if white space touches its ends."""
        body = word[1:] if word[:1] == " " else word
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        return b"".join([self.ids(p) for p in self.find(word)])

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        whole, inner = [], self.inner
        for k, text in enumerate(texts):
            if not text:
                continue
            first, *rest = text.split(" ")
            found = [self._any(first), *[inner[w] for w in rest]]
            if None in found or any(t in text for t in self.added):
                whole.append(k)
            else:
                out[k] = np.frombuffer(b"".join(found), np.uint32)
        if whole:
            got = self.tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)
            for k, e in zip(whole, got, strict=True):
                out[k] = np.array(e.ids, np.uint32)
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_ids(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode documents and write packed files in ascending id order.

    Documents are dealt out by ranges of ``id_col`` and sorted within each, so file
    order is id order; a range's rows go to one file per ``FILE_IDS`` ids. Returns the
    files as a table ``(part, inside, n_ids, doc_ids, lengths, data)``, written in the
    shared folder; ``inside`` counts the ids of the range before. Null and empty texts give
    the end id alone. Null ids come first and stay null; documents of the same id follow
    each other in the order of their texts, which may have any length. Other columns are
    ignored, an empty input gives an empty table.
    """
    rows = document_rows(docs, id_col, text_col)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        bits = bits_for(max(enc.size, end_id + 1))
        tail = np.array([end_id], np.uint32)
        part = TaskContext.get().partitionId()
        held, sizes, doc_ids, before, total = [], [], [], 0, 0

        def file() -> pa.RecordBatch:
            data = pack(np.concatenate(held), bits)
            columns = [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([total], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "inside", "n_ids", "doc_ids", "lengths", "data"])

        for batch in batches:
            for some, texts in text_groups(batch, "text"):
                for doc, ids in zip(some.column("doc_id").to_pylist(), enc.batch([t.decode() for t in texts]), strict=True):
                    held += [ids, tail]
                    sizes.append(len(ids) + 1)
                    doc_ids.append(doc)
                    total += len(ids) + 1
                    if total >= FILE_IDS:
                        yield file()
                        held, sizes, doc_ids, before, total = [], [], [], before + total, 0
        if doc_ids:
            yield file()

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(encode, "part int, inside long, n_ids long, doc_ids array<long>, lengths array<long>, data binary"), "token-files")


def read_ids(files: DataFrame) -> DataFrame:
    """Documents read back from packed files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts all ids of the files and documents before.
    """
    # one row per range, of which there are as many as tasks wrote files, and a running sum over those few
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # a written table's size is known to the planner, which need not shuffle the payload to join few rows
    spread = files.join(written(starts, "token-places"), "part")

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                sizes = row.column("lengths").flatten().to_numpy()
                starts = np.cumsum(sizes) - sizes
                packed = PackedFile(row.column("data")[0].as_py())
                crc = []
                at = 0
                while at < len(sizes):  # about 2**18 ids at a time
                    to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 18))))
                    ids = packed.read(int(starts[at]), int(starts[to - 1] + sizes[to - 1] - starts[at])).astype("<u4").tobytes()
                    for j in range(at, to):
                        low = 4 * int(starts[j] - starts[at])
                        crc.append(zlib.crc32(ids[low : low + 4 * int(sizes[j])]))
                    at = to
                columns = [row.column("doc_ids").flatten(), pa.array(starts + row.column("before")[0].as_py()), pa.array(sizes), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = spread.select("doc_ids", "lengths", "data", (F.col("base") + F.col("inside")).alias("before"))
    return placed.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")
