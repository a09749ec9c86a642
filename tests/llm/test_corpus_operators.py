"""Operators over tables against brute force, with odd rows in every one of them."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from tablegauge.llm import chat, decontaminate, html_extract, media, piece_fst, simhash, substring_dedup, token_counts, token_output, toxicity
from tablegauge.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, words string, component long"


def table(spark, rows):
    """Documents with extra columns whose names operators also use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None, 1, "w", 2) for i, t in rows], SCHEMA)


def corpus(seed=0, n=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    say = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage, rows = say(50), []
    for i in range(n):
        t = say(rnd.randrange(1, 120))
        if i % 4 == 0:
            t = f"{t}\n{passage} {say(5)}"
        if i % 7 == 3:
            t = rows[i // 2][1]
        if i % 11 == 5:
            t = " ".join(rows[i // 2][1].split()[:-1] + ["Changed"])
        rows.append((i, t))
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "is " * 200), (904, "a b " * 90), (905, "one"), (906, say(4000)), (907, rows[0][1]), (907, rows[0][1])]


def empty(spark):
    return table(spark, [(1, "x")]).where("false")


def lowered(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# --- 1, 5, 7, 8, 10: every row comes back -----------------------------------------------------------


def test_per_row_operators_take_odd_rows(spark):
    docs = table(spark, corpus())
    n = docs.count()
    words = P.path("byte_bpe_50k.json")
    for f in (
        lambda d: piece_fst.digests(d, P.path("piece_bpe_32k.model")),
        lambda d: piece_fst.encoded(d, P.path("piece_bpe_32k.model"), keep_text=True),
        lambda d: token_counts.token_counts(d, words),
        lambda d: token_output.read_ids(token_output.write_ids(d, words)),
        media.text_media,
        lambda d: toxicity.score(d, None),
        lambda d: html_extract.extracted(d, "text", ("doc_id", "words")),
    ):
        assert f(docs).count() == n and f(empty(spark)).count() == 0
    with_null = docs.withColumn("doc_id", F.when(F.col("doc_id") != 5, F.col("doc_id")))
    for f in (lambda d: piece_fst.digests(d, P.path("piece_bpe_32k.model")), lambda d: token_counts.token_counts(d, words), lambda d: toxicity.score(d, None)):
        assert f(with_null).where("doc_id is null").count() == 1


def test_piece_round_trip(spark):
    rows = piece_fst.digests(table(spark, corpus()), P.path("piece_bpe_32k.model")).collect()
    assert all(r["lossless"] for r in rows) and {r["n_pieces"] for r in rows if r["doc_id"] in (900, 901)} == {0}


def test_token_files_read_back(spark):
    docs = [r for r in corpus() if r[0] != 907]
    got = {r["doc_id"]: r for r in token_output.read_ids(token_output.write_ids(table(spark, docs).repartition(5), P.path("byte_bpe_50k.json"))).collect()}
    e, start = token_output.WordEncoder(P.path("byte_bpe_50k.json")), 0
    import zlib

    for i, t in sorted(docs):
        ids = e.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_media_values(spark):
    rows = {r["doc_id"]: r for r in media.text_media(table(spark, corpus())).collect()}
    for i, t in corpus():
        data = (t or "").encode()
        payload = media.padded(data)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["position"], r["caption"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), 1, f"text {i}")
    assert rows[0]["media_sha256"] == rows[907]["media_sha256"]


def test_sequences_stay_aligned(spark):
    page = '<p>a</p><figure><img src="media:d1" alt="x"><figcaption>one &amp; two</figcaption></figure><p>b</p><img src="http://x/y.png" alt="far"><figure><img src="media:none"></figure>'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "doc_id long, html string")
    known = spark.createDataFrame([("d1", 7)], "digest string, n_bytes long")
    rows = media.resolved(media.sequences(pages), known).orderBy("position").collect()
    assert [(r["position"], r["kind"], r["text"], r["caption"], r["n_bytes"]) for r in rows] == [(0, "text", "a", None, None), (1, "media", None, "one & two", 7), (2, "text", "b", None, None), (3, "media", "http://x/y.png", "far", None), (4, "media", None, "", None)]


# --- 2 ----------------------------------------------------------------------------------------------


def containment(docs, items):
    out = set()
    for i, t in docs:
        w = lowered(t)
        for k, q in items:
            v = lowered(q)
            n = min(5, len(v))
            if not n:
                continue
            need = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)}
            have = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)}
            if len(need & have) >= 0.8 * len(need):
                out.add((i, k, len(need & have), len(need)))
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_decontamination_equals_brute_force(spark, block):
    docs = corpus(3)
    rnd = random.Random(1)
    items = []
    for k in range(12):
        w = (docs[4 * k][1] or "").split()
        a = rnd.randrange(max(1, len(w) - 30))
        items.append((k, " ".join(w[a : a + rnd.choice([6, 12, 30])]).upper()))
    items += [(20, "one"), (21, "w1 w2"), (22, None), (23, ""), (24, "nothing of this kind is anywhere in here"), (25, " ".join((docs[0][1] or "").split()[:40] + ["other"] * 3))]
    got = decontaminate.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_items=block)
    assert {tuple(r)[:4] for r in got.collect()} == containment(docs, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(table(spark, docs), none).count() == 0 and decontaminate.contaminated(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_clean_drops_just_the_contaminated(spark):
    docs = table(spark, [(1, "x y " + "a b c d e f g h"), (2, "a b c d"), (3, None)])
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    out = decontaminate.clean(docs, items)
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 3] and out.columns == docs.columns


def test_items_of_few_shingles_are_never_missed(spark):
    say = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    docs = [(i, say(i, 60)) for i in range(600)]
    items = [(i, " ".join(docs[i][1].split()[: 5 + i % 4])) for i in range(600)]
    got = decontaminate.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in got.collect()) == [(i, i, 1 + i % 4, 1 + i % 4) for i in range(600)]


# --- 3 ----------------------------------------------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    texts = [b"good day idiot now", b"fine words here and there", b"", b"x"]
    table_ = toxicity.WordTable(texts)
    ids, text = table_.windows()
    model = {k: v.astype(np.float64) for k, v in toxicity.new_model(1).items()}
    y, w = np.array([1.0, 0.0, 0.0, 0.0]), np.ones(4)
    _, g = toxicity._gradients(model, table_, ids, text, y, w, 1.0)
    for name in ("w", "v", "A", "a", "Uf", "Wb", "cb", "ef", "word", "gram"):
        flat = np.argsort(-np.abs(g[name]).reshape(-1))[:2]
        for at in flat:
            old = model[name].reshape(-1)[at]
            loss = []
            for step in (1e-4, -1e-4):
                model[name].reshape(-1)[at] = old + step
                loss.append(toxicity._gradients(model, table_, ids, text, y, w, 1.0)[0])
            model[name].reshape(-1)[at] = old
            slope = (loss[0] - loss[1]) / 2e-4
            # the soft maximum's shares are held fixed in the gradient; with one window a text they are one
            assert abs(slope - g[name].reshape(-1)[at]) < 2e-3 + 0.02 * abs(slope), name
    assert rng is not None


def test_network_learns_inflected_words_and_windows_cover_all():
    rnd = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "pe", "so", "di", "fu", "gel", "har")]
    bad = ["scumlor" + e for e in ("a", "es", "ing", "ed", "um", "is")]

    def say(toxic, end, n=40):
        w = [rnd.choice(vocabulary) for _ in range(n)]
        if toxic:
            w[rnd.randrange(n)] = bad[end]
        return " ".join(w).encode()

    train = [(say(k % 2, rnd.randrange(4)), k % 2) for k in range(1000)]
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    test = [(say(k % 2, rnd.choice([4, 5])), k % 2) for k in range(100)]  # unseen inflections
    scores, _ = toxicity.text_scores(model, [t for t, _ in test])
    assert np.mean((scores >= 0.5) == np.array([y for _, y in test])) >= 0.9
    long = say(0, 0, 5000) + b" scumlora " + say(0, 0, 10)
    (high,), (many,) = toxicity.text_scores(model, [long])
    assert high >= 0.5 and many == len(toxicity.WordTable([long]).windows()[0]) >= 5011 // 16 - 1
    assert toxicity.fit([b"a"], [0]) is None and toxicity.fit([], []) is None
    assert toxicity.text_scores(model, [b"", b"..."])[0].tolist() == [0.0, 0.0]


def test_training_never_sees_the_held_out_fold(spark):
    import zlib

    docs = table(spark, [(i, f"t{i}") for i in range(50)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(50)] + [(3, 1, 1), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    texts, y = toxicity.training_rows(docs, labels, toxic=100, clean=5)
    ids = [int(t[1:]) for t in texts]
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids) and y.count(0) == 5 and len(ids) == len(set(ids))


# --- 4 ----------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    control = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", control), (1, 1, "assistant", control), (1, 2, "user", None), (1, 3, "assistant", "a\\b <s>[user]\n x\n"), (2, 0, "system", ""), (3, 0, "assistant", "\n<s>[a]\n</s>\n"), (3, 0, "assistant", "\n<s>[a]\n</s>\n"), (4, 1, None, "é😀$1"), (5, 1, "a]\n<s>[b]\nc\\", "x]\ny"), (5, 2, "]\n", ""), (5, 3, "assistant", " " * 20_000 + "\\" * 5001), (None, 1, "assistant", "kept"), (None, 2, "user", "]")]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, examples int")
    made = chat.conversations_formatted(turns)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for c in got:
        own = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c))
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    full = chat.full_examples(made).where("conv_id = 1").orderBy("turn").collect()
    text = made.where("conv_id = 1").first()["formatted"]
    assert [r["context"] + r["target"] == text[: len(r["context"]) + len(r["target"])] for r in full] == [True, True] and full[1]["context"].startswith(full[0]["context"] + full[0]["target"])
    assert chat.read_back(chat.conversations_formatted(turns.where("false"))).count() == 0


# --- 6 ----------------------------------------------------------------------------------------------


def fingerprint(text):
    w = lowered(text)
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    docs = corpus(5)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table(spark, docs)).collect()}
    fps = {i: fingerprint(t) for i, t in docs}
    component = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            least = min(component[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3)
            if least < component[i]:
                component[i], changed = least, True
    assert got == {i: (f"{fps[i]:016x}", component[i]) for i in fps}
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("distance,tables", [(3, 2), (3, 3), (3, 4), (2, 2), (5, 2)])
def test_every_close_pair_is_linked(spark, distance, tables):
    rng = random.Random(distance * 10 + tables)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = set(base)
    for b in base:
        for _ in range(6):
            v = b
            for bit in rng.sample(range(64), rng.randrange(1, 7)):
                v ^= 1 << bit
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance, tables).collect()}
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    assert got == want


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(7, 7), (5, 4)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 9 ----------------------------------------------------------------------------------------------


def without_repeats(docs, window=20):
    seen, out = {}, {}
    for i, t in sorted(dict(docs).items()):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.setdefault(k, (i, s))
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("shard_words,seen", [(substring_dedup.SHARD_WORDS, 1 << 23), (60, 1 << 23), (60, 0), (25, 300)])
def test_substring_dedup_equals_brute_force(spark, shard_words, seen, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEEN_BYTES", seen)
    docs = corpus(7)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.deduplicated(table(spark, docs).repartition(4), shard_words=shard_words).collect()}
    assert got == without_repeats(docs)
    assert substring_dedup.deduplicated(empty(spark)).count() == 0


def test_dedup_stage_keeps_columns_and_null_ids(spark):
    docs = table(spark, corpus(8)[:40] + [(None, "x " * 50), (None, None)])
    out = substring_dedup.clean(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and out.where("doc_id is null and text is not null").count() == 1
    assert substring_dedup.deduplicated(docs).where("doc_id is null").count() == 2


# --- pipeline ---------------------------------------------------------------------------------------


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline

    rnd = random.Random(8)
    say = lambda n: " ".join(f"k{rnd.randrange(3000)}" for _ in range(n))
    docs = [(i, say(200)) for i in range(60)]
    for i in range(60, 140):  # copies of the last forty, of which up to four words differ; some groups' originals have larger ids
        words = docs[20 + i % 40][1].split()
        for at in rnd.sample(range(200), rnd.randrange(1, 5)):
            words[at] = "other"
        docs.append((i if i % 3 else -i, " ".join(words)))
    docs += [(500, ""), (501, None), (502, "two words"), (503, "Two  words")]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in docs}
    component = {i: i for i in sets}
    close = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while any(component[a] != component[b] for a, b in close):
        for a, b in close:
            component[a] = component[b] = min(component[a], component[b])
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates_out(spark, table(spark, docs), "").collect()}
    assert left == set(component.values()) and len(left) < 70


@pytest.mark.parametrize("others", [0, 3])
def test_near_duplicate_stage_searches_by_fingerprints(spark, others):
    """Two texts, 0.8 alike, that share no MinHash band meet in operator 6's class; unlike texts of one fingerprint stay."""
    import corpus_pipeline
    from tablegauge.llm import near_copies

    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    many = "x " * 100  # over half of the shingles, so the fingerprint
    a, b = (f"{many} {words('a21365s', 7)} {last}" for last in ("one", "two"))
    x, y = (near_copies.shingles(t.encode()) for t in (a, b))
    assert len(np.intersect1d(x, y)) == 8 and len(np.union1d(x, y)) == 10 and not set(near_copies._bands(x)) & set(near_copies._bands(y))
    docs = [(9, a), (4, b), (5, words("u", 30))] + [(20 + k, f"{many} {words(f'other{k}s', 8)}") for k in range(others)]
    assert len({fingerprint(t) for i, t in docs if i != 5}) == 1
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates_out(spark, table(spark, docs), "").collect()}
    assert left == {i for i, _ in docs} - {9}


def test_stages_over_a_small_corpus(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rnd = random.Random(4)
    vocabulary = [f"k{k}" for k in range(500)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, item = say(60), say(20)
    docs = [(i, say(40) + (" vilewordly" if i % 6 == 0 else "")) for i in range(900)]
    docs += [(1000, docs[1][1]), (1001, f"{say(30)} {passage} {say(30)}"), (1002, f"{say(30)} {passage} {say(30)}"), (1003, f"{say(40)} {item} {say(40)}"), (1004, "vilewordly " + say(50)), (1005, say(70))]
    at = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(900)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    left = {r["doc_id"]: r for r in corpus_pipeline.run(spark, at).collect()}
    assert 1004 not in left and 1000 not in left and 1003 not in left and {1, 1001, 1002, 1005} <= set(left)
    assert len(left) >= 720 and all(r["lossless"] for r in left.values()) and left[1002]["n_pieces"] < left[1001]["n_pieces"]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
