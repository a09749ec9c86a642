"""Whole results of queries that SQL does not express, on small tables, computed another way."""

import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from tablegauge.llm import queries, token_counts, toxicity

TEXTS = ["", None, "plain words of a text", "  two  spaces\tand\na line ", "naïve café — “quoted” … 漢字かな 한국어 🙂🙃", "x" * 3000, "a b " * 400, "http://example.org/?q=1&r=2#z", "\x00\x01 control", "Wörter, die übrig bleiben: ß ẞ"]


def texts(seed, n=60):
    rnd = random.Random(seed)
    words = ["the", "of", "casa", "perro", "und", "nicht", "été", "où", "data", "1984", "3.14", "(see)", "naïve", "🙂", "zzzqqq", "​", "ﬁn", "Ⅳ"]
    return TEXTS + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 150))) for _ in range(n)]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts(1))] + [(500, "plain words of a text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def collected(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_op1_equals_the_library(spark, folder):
    from sentencepiece import SentencePieceProcessor

    at, rows = folder
    sp = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = collected(queries.op1_sentencepiece(spark, at))
    assert len(got) == len(rows)
    for i, t in rows:
        ids = sp.encode(t or "")
        back = sp.decode(ids)
        r = got[i]
        assert (r["n_pieces"], r["n_bytes"], r["ids_crc32"]) == (len(ids), sum(map(sp.is_byte, ids)), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), t
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest() and r["lossless"] == (back == (t or "")), t


def test_op8_equals_longest_matches(spark, folder):
    """The query's own vocabulary, word by word, longest piece first."""
    at, rows = folder
    first, rest = map(set, token_counts.byte_level_pieces(P.path("byte_bpe_50k.json")))
    longest = max(map(len, first | rest))

    def count(word):
        n = at_ = 0
        while at_ < len(word):
            known = rest if at_ else first
            end = next((e for e in range(min(len(word), at_ + longest), at_, -1) if word[at_:e] in known), None)
            if end is None:
                return 1, 1
            n, at_ = n + 1, end
        return n, 0

    got = collected(queries.op8_token_counts(spark, at))
    for i, t in rows:
        each = [count(w) for w in (t or "").encode().split()]
        assert (got[i]["n_words"], got[i]["n_tokens"], got[i]["n_unknown"]) == (len(each), sum(n for n, _ in each), sum(u for _, u in each)), t


def png(data):
    """Size and samples of a grey image, read by the format's rules."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    source, packed, head = io.BytesIO(data[8:]), b"", None
    while part := source.read(8):
        size, kind = struct.unpack(">I4s", part)
        body = source.read(size)
        assert zlib.crc32(kind + body) == struct.unpack(">I", source.read(4))[0]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        packed += body if kind == b"IDAT" else b""
    width, height = head[:2]
    assert head[2:] == (8, 0, 0, 0, 0)
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    assert not lines[:, 0].any()
    return width, height, lines[:, 1:].tobytes()


def test_op10_equals_the_stored_bytes(spark, folder):
    from tablegauge.llm import media

    at, rows = folder
    got = collected(queries.op10_media_columns(spark, at))
    assert len(got) == len(rows)
    for i, t in rows:
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        image = media.to_png(payload)
        width, height, samples = png(image)
        assert samples == payload
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        x = np.frombuffer(payload, np.uint8).astype(float)
        assert r["feature"].startswith(f"gray8:{width}x{height}:mean={x.mean():.3f}:std={x.std():.3f}:ahash=") and len(r["feature"].rpartition("=")[2]) == 16
    same = [got[i] for i, t in rows if t == "plain words of a text"]
    assert len(same) == 2 and len({tuple(r[c] for c in r.asDict() if c not in ("doc_id", "caption")) for r in same}) == 1


def test_op3_on_a_planted_corpus(spark, tmp_path):
    """Held-out documents with planted words are found, clean ones are left alone; the fold, the range and equal texts hold."""
    rnd = random.Random(6)
    clean, vile = [f"plain{k}" for k in range(400)], ["vilewordly", "nastyterm", "hatefulish"]
    rows, labels = [], []
    for k in range(900):
        words = [rnd.choice(clean) for _ in range(rnd.randrange(5, 120))]
        toxic = k % 5 == 0
        for _ in range(2 if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(vile))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(2000, rows[5][1]), (2001, ""), (2002, None), (2003, " ".join(rnd.choice(clean) for _ in range(6000)) + " nastyterm hatefulish")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = collected(queries.op3_toxicity(spark, str(tmp_path)))
    assert len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held_out"]]
    found = sum(p for p, t in held if t) / sum(t for _, t in held)
    wrong = sum(p for p, t in held if not t) / sum(1 - t for _, t in held)
    assert len(held) > 120 and found >= 0.9 and wrong <= 0.05
    assert got[2000]["score"] == pytest.approx(got[5]["score"], abs=1e-6) and got[2001]["score"] == got[2002]["score"] == 0
    assert got[2003]["predicted"] == 1  # the last window of a long text counts


def test_scores_do_not_depend_on_how_texts_are_grouped():
    model = toxicity.fit([b"good words here now", b"vile words here now"] * 40, [0, 1] * 40)
    some = [t.encode() for t in ("good words", "vile words", "", "words " * 900, "other vile text")]
    one = toxicity.text_scores(model, some)
    each = toxicity.text_scores(model, some, 1)
    assert np.allclose(one[0], each[0], atol=1e-6) and one[1].tolist() == each[1].tolist()


def test_pipeline_stages_on_odd_rows(spark):
    """Null ids and texts, repeated rows, one id with two texts, clashing columns: every stage returns the columns of documents."""
    import corpus_pipeline

    say = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    names = "doc_id long, text string, lang string, source string, n_chars long, tx string, n int, cuts int, content string"
    rows = [(1, say("a", 50)), (1, say("a", 50)), (1, say("b", 50)), (None, say("a", 50)), (None, None), (3, None), (4, ""), (5, say("c", 3000))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), None, 1, None, None) for i, t in rows], names)
    labels = spark.createDataFrame([(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(None, None), (1, "")], "item_id long, text string")
    left = {"toxicity": 8, "near_duplicates": 6, "substring_dedup": 8, "decontamination": 8}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "table", lambda spark, at, name: {"labels": labels, "benchmark": benchmark}[name])
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            none = stage(spark, docs.where("false"), "")
            assert none.count() == 0
            if name == "sentencepiece":
                assert out.count() == 8 and out.where("lossless").count() >= 6
            else:
                assert out.columns == none.columns == docs.columns and out.count() == left[name], name
