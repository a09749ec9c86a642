"""Operators of one text at a time against libraries and plain versions."""

import random
import struct
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from tablegauge.llm import html_extract, media, piece_fst, token_counts, token_output
from tablegauge.llm.common import Words, grams
from tablegauge.llm.fm_index import FMIndex, WaveletMatrix
from tablegauge.llm.html_blocks import Block, Media, read

ALPHABET = " ab ct\nthe▁e\té漢⁇x😀中'.,1"


def texts(n, length, seed=1, alphabet=ALPHABET):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(length))) for _ in range(n)]


# --- 1 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def fst():
    return piece_fst.transducer(P.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(fst):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    cases = texts(3000, 16) + ["", " ", "  a   b ", "the theory of everything", "\x00\x01", "x" * 5000, "ab" * 3000 + " " * 40, *["a" + " " * n + b for n in [*range(1, 70), 1000, 20_000] for b in ("", "b", "▁c")], " " * 20_000]
    for t in cases:
        ids = fst.encode(t).tolist()
        assert ids == library.encode(t), t
        assert fst.decode(ids).decode() == library.decode(ids), t


def model_bytes(pieces, merges=False, byte_fallback=False):
    """A hand-made model file."""

    def field(n, kind, body):
        return bytes([n << 3 | kind]) + (bytes([len(body)]) if kind == 2 else b"") + body

    out = b""
    for p, score, kind in pieces:
        out += field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))
    trainer = field(3, 0, bytes([2 if merges else 1])) + (b"\x98\x02\x01" if byte_fallback else b"")
    return out + field(2, 2, trainer) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00"))


def test_unigram_path_is_the_least_of_all_segmentations():
    rnd = random.Random(5)
    pieces = [("<unk>", 0.0, 2)] + [(p, -rnd.random() * 5, 1) for p in ("▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca")]
    fst = piece_fst.PieceTransducer(model_bytes(pieces))
    score = {p: s for p, s, k in pieces if k == 1}

    def best(word):
        if not word:
            return 0.0
        return max((score[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in score), default=-1e9)

    for t in texts(200, 8, 2, "abc "):
        got = [fst.model.pieces[i] for i in fst.encode(t)]
        assert "".join(got) == (whole := fst.normaliser.run(t)) and abs(sum(score[p] for p in got) - best(whole)) < 1e-4
    assert fst.encode("zz").tolist() == [1, 0]  # neighbouring unknowns are one


# --- 5 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 5003, dtype=np.uint64).astype(np.uint32)
    packed = token_output.PackedFile(token_output.pack(ids, bits, block=64))
    assert (packed.read(0, len(ids)) == ids).all()
    for a, n in ((0, 1), (63, 2), (4999, 4), (100, 1000), (5003, 0)):
        assert (packed.read(a, n) == ids[a : a + n]).all()
    with pytest.raises(IndexError):
        packed.read(5000, 10)


def test_packing_refuses_wide_ids_and_takes_none():
    with pytest.raises(ValueError):
        token_output.pack(np.array([4]), 2)
    assert token_output.PackedFile(token_output.pack(np.array([], int), 7)).count == 0


def test_word_encoder_equals_the_library():
    e = token_output.WordEncoder(P.path("byte_bpe_50k.json"))
    cases = texts(2000, 20) + ["it's 's ok", "a  b", " x ", "a \n b", "a\x1cb c", "<|endoftext|> a", "a <|endoftext|>", "don't 'll 12 3a!", "  a", "naïve café", "", "ı İ ß"]
    want = [x.ids for x in e.tokenizer.encode_batch(cases, add_special_tokens=False)]
    assert [x.tolist() for x in e.batch(cases)] == want


# --- 7 ---------------------------------------------------------------------------------------------


def test_minimum_cut_is_minimal():
    rnd = random.Random(3)
    for _ in range(60):
        n = rnd.randrange(1, 7)
        terminal = [(rnd.randrange(9), rnd.randrange(9)) for _ in range(n)]
        links = [(i, j, rnd.randrange(6)) for i in range(n) for j in range(i) if rnd.random() < 0.6]

        def cost(side):
            return sum(t if s else c for (c, t), s in zip(terminal, side)) + sum(c for i, j, c in links if side[i] != side[j])

        least = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.minimum_cut(terminal, links)) == least


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now.</div>
<div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p>First   line<br>of <b>text</b>.<p>Second, with <a href="x">a link</a> inside.
<ul><li>One point.</li><li>Two</li></ul></article><div id="comments"><p>Reader says a long thing, at length, with commas.</p></div>
<aside>More</aside><form><p>Subscribe</p><input></form><footer>&copy; site</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "A & B\n\nFirst line of text.\n\nSecond, with a link inside.\n\nOne point.\n\nTwo"


@pytest.mark.parametrize("page", ["", "plain text, no markup at all.", "<p>cut off in a ta", "<article><p>One.</p><p>&am", "<<>><a b='", "<!-- open", "<script>x", "<p>" * 500 + "deep. text, here" + "</p>" * 500])
def test_odd_pages_do_not_fail(page):
    assert isinstance(html_extract.main_text(page), str)


@pytest.mark.parametrize("opaque", ["<script>for(i=0;i<n;i++){f(i)}</script>", "<SCRIPT>if (a<b) s = \"it's\"</Script >", "<script>var q = 'a<b\"</script>", "<style>a<b{content:'\"'}</style>", "<script>x</scripts><y</script>"])
def test_scripts_with_comparisons_and_quotes(opaque):
    page = f"<html><head>{opaque}</head><body><article><p>First, with text.</p>{opaque}<p>Second, with text.</p></article></body></html>"
    assert html_extract.main_text(page) == "First, with text.\n\nSecond, with text."


@pytest.mark.parametrize("around", ['<div class="layout has-sidebar">{}</div>', '<div id="content" class="with-sidebar">{}</div>', '<div class="sidebar"><main>{}</main></div>', '<form id="aspnetForm">{}</form>', '<aside>{}</aside>'])
def test_names_and_elements_around_an_article(around):
    words = "A sentence of the article, with some length, goes here. " * 4
    article = f'<article><div class="post-header"><h1>The title</h1></div><p>{words}</p><p>{words}</p><div class="comments"><p>{words}</p></div></article>'
    page = f'<html><body><div class="ad-box"><p>{words}</p></div>{around.format(article)}<nav><p>{words}</p></nav><div class="sidebar left"><p>{words}</p></div></body></html>'
    assert html_extract.main_text(page) == "\n\n".join(["The title", words.strip(), words.strip()])


def test_names_can_be_outvoted_and_are_not_alone():
    words = "A sentence of the text, with some length, goes here. " * 6
    assert html_extract.main_text(f'<body><div class="side"><div class="story-text"><p>{words}</p></div></div></body>') == words.strip()
    assert html_extract.main_text(f'<body><div class="side"><p>{words}</p></div></body>') == ""


def test_reader_keeps_order_and_media():
    found = read('<p>a</p><figure><img src="media:1" alt="x"><figcaption>cap</figcaption></figure><p>b</p>')
    assert [x.text if isinstance(x, Block) else x.source for x in found] == ["a", "media:1", "cap", "b"] and isinstance(found[1], Media)


# --- 8 ---------------------------------------------------------------------------------------------


def test_counts_equal_the_library():
    from tokenizers.models import WordPiece

    first, rest = [b"a", b"ab", b"abc", b"b", b"x"], [b"a", b"b", b"c", b"bc", b"bcd", b"d"]
    automaton = token_counts.CountAutomaton(first, rest)
    vocab = {p.decode(): i for i, p in enumerate(first)} | {"##" + p.decode(): 50 + i for i, p in enumerate(rest)} | {"[UNK]": 99}
    library = WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6)
    for w in {t for t in texts(3000, 10, 4, "abcdx") if t} | {"x", "xd", "d", "a" * 5000}:
        got = library.tokenize(w)
        assert automaton.count([w.encode()]) == (len(got), int(got[0].value == "[UNK]")), w


# --- 9 ---------------------------------------------------------------------------------------------


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 11, 500)
    w = WaveletMatrix(seq, 11)
    c, i = rng.integers(0, 11, 300), rng.integers(0, 501, 300)
    assert w.rank(c, i).tolist() == [int((seq[:b] == a).sum()) for a, b in zip(c, i)]


@pytest.mark.parametrize("window", [3, 5, 6, 7, 12, 20])
def test_backward_search_finds_every_occurrence(window):
    rng = np.random.default_rng(window)
    segments = [rng.integers(1, 3, n) for n in rng.integers(1, 60, 30)] + [np.ones(80, int), np.ones(80, int)]
    index = FMIndex(np.concatenate(segments), np.array([len(s) for s in segments]), window)
    position, found = index.search()
    text = index.text
    spans = {int(p): tuple(text[p : p + window]) for p in position}
    where = {}
    for p in sorted(spans):
        where.setdefault(spans[p], []).append(p)
    assert len(position) == sum(max(0, len(s) - window + 1) for s in segments)
    for p, k in zip(position, found):
        assert index.occurrences[k] == len(where[spans[int(p)]]) and index.earliest[k] == where[spans[int(p)]][0]


# --- 10 and shared ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_images_are_lossless(n):
    data = media.padded(bytes(range(256)) * 4)[:n] if n else b""
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[: len(data)] == data
    samples = media.from_png(media.to_png(payload))
    assert samples.tobytes() == payload and media.feature(samples).startswith("gray8:64x")
    with pytest.raises(ValueError):
        media.from_png(media.to_png(payload)[:-20] + b"x" * 20)


def test_word_splitting_and_hashes():
    cases = [t.encode() for t in texts(300, 30, 7)] + [b"", b" ", "a b\x1cc\x85".encode()]
    w = Words(cases)
    seen = {}
    for t, a, b in zip(cases, w.first, w.last):
        words = t.split()
        assert [w.raw[s:e] for s, e in zip(w.start[a:b], w.end[a:b])] == words
        for word, h in zip(words, w.hash[a:b]):
            assert seen.setdefault(word, h) == h
    assert len(set(map(int, seen.values()))) == len(seen)
    assert len(grams(w.hash, 3)) == len(w.hash) - 2 and len(grams(w.hash[:2], 3)) == 0


def test_crc_of_little_endian_ids():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(struct.pack("<II", 1, 2))


def test_pages_with_fitted_weights(spark):
    """Golden texts through the fitted classifier: what surrounds an article goes, what it holds stays."""
    para = "Sentence one of the article, long enough to count. And another sentence follows here, with marks; and more. " * 3
    para = para.strip()
    title, intro = "<h1>The title of it</h1>", f"<p>{para}</p>"
    items = [f"item number {k} here" for k in range(6)]
    linked = "<ul>" + "".join(f"<li><a href='x'>{t}</a></li>" for t in items) + "</ul>"
    thread = "".join(f"<div class='c'><p>{t}</p></div>" for t in ("Great post, I really liked it. Thanks for sharing this with us all.", "I disagree, since the numbers do not add up at all; look again."))
    shell = "<nav><ul><li><a href='/'>Home page</a></li><li><a href='/b'>Archive of all</a></li></ul></nav>{}<footer><p>All rights reserved by someone, 2020.</p></footer>"
    pages = {
        "thread after the article": (shell.format(f"<article>{title}{intro}</article><section id='discussion'>{thread}</section>"), ["The title of it", para]),
        "links inside the article": (shell.format(f"<article>{title}{intro}{linked}{intro}</article>"), ["The title of it", para, *items, para]),
        "title before the article": (shell.format(f"<div class='content'>{title}<article>{intro}{intro}</article></div>"), ["The title of it", para, para]),
        "no article": (shell.format(f"<div><div>{title}{intro}</div><div>{intro}</div></div>"), ["The title of it", para, para]),
        "main alone": (shell.format(f"<main>{title}{intro}</main>"), ["The title of it", para]),
    }
    rows = [(k, "u", html) for k, (html, _) in enumerate(pages.values())] + [(100 + k, "u", shell.format(f"<article>{title}{intro}<p>{k} more words, and some marks.</p></article>")) for k in range(30)]
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, (name, (_, want)) in enumerate(pages.items()):
        assert got[k].split("\n\n") == want, name
