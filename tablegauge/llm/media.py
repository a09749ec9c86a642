"""Media columns as interleaved document sequences.

A page's HTML is parsed into an ordered array of structs: texts and media references, each
with its position, a reference with its digest and its caption (the ``figcaption`` of its
figure, else its ``alt``). Payloads live once per digest in a table of stored media; a
join on the digest resolves the references, and sequences are put together again in order.

Payload bytes are stored as an 8-bit grey image (PNG): 64 samples a row, losslessly.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_groups, with_computed, with_frequent_apart, written
from .html_blocks import Block, Media, read

WIDTH = 64
#: References of the form ``media:<digest>`` name a stored payload.
SCHEME = "media:"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """Bytes 0 appended up to a positive multiple of ``unit``."""
    return data + bytes(unit - len(data) if len(data) < unit else -len(data) % unit)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """A payload of whole rows as an 8-bit grey image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)  # filter 0 before every line
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Samples of an image that ``to_png`` wrote, ``(height, width)``; checks its checksums."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed = 8, b"", []
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("damaged")
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", head)
    if (depth, colour) != (8, 0):
        raise ValueError("8-bit grey samples are expected")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("an unknown line filter")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation, and an 8 x 8 average hash of an image."""
    height, width = samples.shape
    exact = samples.astype(np.int64)
    total, squares, n = int(exact.sum()), int((exact**2).sum()), samples.size
    mean = total / n
    edges = (np.arange(9) * height) // 8
    rows = np.stack([exact[a : max(b, a + 1)].mean(0) if a < height else np.zeros(width) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    cells = rows.reshape(8, 8, width // 8).mean(2)
    bits = np.packbits(cells.reshape(-1) > cells.mean()).tobytes().hex()
    return f"gray8:{width}x{height}:mean={mean:.3f}:std={max(0.0, squares / n - mean * mean) ** 0.5:.3f}:ahash={bits}"


#: Digests that a task remembers, so as to store a payload once.
STORED = 200_000


def store(payloads: DataFrame, digest_col: str = "digest", data_col: str = "data") -> DataFrame:
    """Write payloads as images: ``digest, n_bytes, media``; read back from the shared folder.

    ``data`` is padded with zeros to whole rows, ``n_bytes`` is its length before; null
    data is empty, rows with a null digest are not stored. A task stores a digest once, so
    one that many rows share costs no more images than there are tasks; what is derived
    from each is the same.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[str] = set()
        for batch in batches:
            for part, data in text_groups(batch, "data"):
                digests, sizes, images = [], [], []
                for digest, payload in zip(part.column("digest").to_pylist(), data, strict=True):
                    if digest not in done:
                        done.add(digest)
                        digests.append(digest)
                        sizes.append(len(payload))
                        images.append(to_png(padded(payload)))
                if len(done) > STORED:
                    done = set()
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], ["digest", "n_bytes", "media"])

    rows = payloads.select(F.col(digest_col).cast("string").alias("digest"), F.col(data_col).cast("binary").alias("data")).where("digest is not null")
    return written(rows.mapInArrow(encode, "digest string, n_bytes long, media binary"), "media")


_DESCRIBED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media: DataFrame) -> DataFrame:
    """One row per digest, from the stored bytes: sizes, digests and features.

    An image that cannot be read fails the job. An empty table gives an empty one.
    """

    def compute(images: list[bytes]) -> dict:
        out = []
        for data in images:
            samples = from_png(data)
            payload = samples.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
        return dict(zip(("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), zip(*out, strict=True), strict=True))

    rows = with_computed(media.select("digest", "n_bytes", "media"), compute, _DESCRIBED, "media")
    return rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in rows.columns if c != "digest"])


def sequences(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """``id_col, items``: the ordered texts and media references of each page.

    ``items`` are structs ``(position, kind, text, digest, caption)``: ``kind`` is ``text``
    or ``media``; ``digest`` is null for a text and for a reference outside ``media:``, whose
    source is then its ``text``. Null and empty pages have no items.
    """

    def items_of(page: str) -> list[dict]:
        found = read(page)
        captions: dict[int, str] = {}
        for x in found:
            if isinstance(x, Block) and any(e.tag == "figcaption" for e in x.path):
                figure = next((e.number for e in reversed(x.path) if e.tag == "figure"), None)
                if figure is not None:
                    captions[figure] = f"{captions[figure]} {x.text}" if figure in captions else x.text
        items: list[dict] = []
        for x in found:
            if isinstance(x, Media):
                figure = next((e.number for e in reversed(x.path) if e.tag == "figure"), None)
                own = x.source.startswith(SCHEME)
                items.append({"position": len(items), "kind": "media", "text": None if own else x.source, "digest": x.source[len(SCHEME) :] if own else None, "caption": captions.get(figure, x.alt)})
            elif not any(e.tag == "figcaption" for e in x.path):
                items.append({"position": len(items), "kind": "text", "text": x.text, "digest": None, "caption": None})
        return items

    # two names that no id column has: the page, and its items until the end
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").cast("binary").alias("html"))
    schema = "items array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
    return with_computed(rows, lambda html: {"items": [items_of(h.decode("utf-8", "replace")) for h in html]}, schema, "html").select(F.col("id").alias(id_col), "items")


def resolved(sequence: DataFrame, media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Items of ``sequences``, one a row, with the columns of ``media`` where the digest is known.

    References that nothing resolves stay, with nulls, as do texts; repeated rows of
    ``media`` count once. Digests that many items share are joined apart from the others.
    Either table may be empty.
    """
    items = written(sequence.select(id_col, F.explode("items").alias("i")).select(id_col, "i.*"), "media-items")
    asked = items.where("digest is not null")
    named = asked.groupBy("digest").agg(F.count("*").alias("times")).join(media.dropDuplicates(["digest"]), "digest", "left")
    found = with_frequent_apart(asked, written(named, "media-asked"), "digest", "times")
    columns = [*items.columns, *[c for c in media.columns if c != "digest"]]
    return found.unionByName(items.where("digest is null"), allowMissingColumns=True).select(*columns)


def page_of(text: DataFrame, id_col: str = "doc_id", digest_col: str = "digest", caption_col: str = "caption") -> DataFrame:
    """Pages ``id_col, html`` that show each row's payload as a figure, its caption below and a heading before."""

    def escaped(name: str):
        value = F.coalesce(F.col(name), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            value = F.replace(value, F.lit(a), F.lit(b))
        return value

    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), F.col(digest_col), F.lit('"><figcaption>'), escaped(caption_col), F.lit("</figcaption></figure>"))
    return text.select(id_col, F.concat(F.lit("<h1>Document</h1>"), figure).alias("html"))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a stored image, read back through its page's media reference.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, position, caption``, a row for every row of ``docs``. Texts are UTF-8 of
    any length, null is empty; equal texts share a digest and have equal values. A null id
    stays null and has an empty caption; repeated ids are rows of their own. Other columns
    are ignored; an empty table gives an empty one.
    """
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data"), F.sha2(data, 256).alias("digest"))
    media = described(store(keyed))
    captioned = keyed.select("doc_id", "digest", F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("caption"))
    rows = resolved(sequences(page_of(captioned)), media)
    return rows.where("kind = 'media'").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
