"""Every operator on the same odd rows: ids beyond 2**53 beside null, one id with two texts, long texts, clashing names."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from tablegauge.llm import chat, decontaminate, html_extract, media, near_copies, piece_fst, simhash, substring_dedup, token_counts, token_output, toxicity

BIG = 2**53 + 1
LONG = " ".join(f"w{k % 9973}x{k % 31}" for k in range(22_000))
SPACES = "a" + " " * 20_000 + "b"
ROWS = [(BIG, "one text of id big"), (BIG, "another text of the same id, of other words"), (None, "a text without an id"), (None, None), (BIG + 2, LONG), (BIG + 4, SPACES), (7, ""), (7, ""), (8, None), (9, " \t\n")]
CLASHES = "key long, dk long, tx long, words string, runs string, cuts string, packed string, hot boolean, n int, start int, html string, items string, fp long, content long, component_id long, digest string, data binary, copies long, n_bytes long, score double, n_chars long, __cuts string, toxic int, position int"


def docs(spark, rows=ROWS):
    names = [c.split()[0] for c in CLASHES.split(", ")]
    values = [None] * len(names)
    return spark.createDataFrame([(i, t, *values) for i, t in rows], "doc_id long, text string, " + CLASHES)


MODEL, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"
OPERATORS = {
    "op1": lambda d: piece_fst.digests(d, P.path(MODEL)),
    "op1_encoded": lambda d: piece_fst.encoded(d, P.path(MODEL), keep_text=True),
    "op3": lambda d: toxicity.scored(d, d.select("doc_id", F.lit(None).cast("int").alias("toxic"))),
    "op5": lambda d: token_output.read_ids(token_output.write_ids(d, P.path(BYTES))),
    "op6": simhash.near_duplicates,
    "op7": lambda d: html_extract.extracted(d, "text", ("doc_id", "html")),
    "op8": lambda d: token_counts.token_counts(d, P.path(BYTES)),
    "op9": substring_dedup.deduplicated,
    "op10": media.text_media,
    "near_copies": near_copies.near_copies,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_stay_exact_and_every_row_comes_back(spark, name):
    table = docs(spark)
    got = OPERATORS[name](table)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(i) for i, _ in ROWS)
    assert OPERATORS[name](table.where("false")).count() == 0
    assert OPERATORS[name](docs(spark, [(None, None)])).count() == 1


@pytest.mark.parametrize("stage", ["op2", "op3", "op9"])
def test_filtering_stages_keep_columns_and_ids(spark, stage):
    table = docs(spark)
    none = spark.createDataFrame([], "item_id long, text string, toxic int, doc_id long")
    out = {"op2": lambda: decontaminate.clean(table, none), "op3": lambda: toxicity.clean(table, none), "op9": lambda: substring_dedup.clean(table)}[stage]()
    assert out.schema == table.schema
    assert sorted(map(str, (tuple(r)[:2] for r in out.collect()))) == sorted(map(str, ROWS))
    assert {"op2": decontaminate.clean, "op3": toxicity.clean}.get(stage, lambda d, _: substring_dedup.clean(d))(table.where("false"), none).count() == 0


def test_decontamination_takes_odd_ids(spark):
    items = spark.createDataFrame([(BIG, "one text of id big"), (None, "a text without an id"), (1, None), (2, ""), (3, "a b")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark), items).collect()}
    assert got == {(BIG, BIG), (None, None), (BIG + 4, 3)}


def test_documents_of_one_id_lose_only_what_repeats(spark):
    say = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    rows = [(1, say("x", 60)), (2, say("x", 60)), (2, say("y", 60)), (2, say("y", 60)), (3, say("z", 30) + " " + say("y", 60))]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.deduplicated(docs(spark, rows)).collect())
    assert got == [(1, 60, 0), (2, 60, 0), (2, 60, 0), (2, 60, 60), (3, 90, 60)]


def test_training_takes_one_text_an_id_and_no_conflicting_label(spark):
    rows = [(i, f"t{i}") for i in range(30)] + [(6, "t6 again"), (7, "t7")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(6, 1), (9, 1), (9, 1)], "doc_id long, toxic int")
    texts, y = toxicity.training_rows(docs(spark, rows), labels)
    free = [i for i in range(30) if zlib.crc32(str(i).encode()) % 5 and i != 6]
    assert sorted(texts) == sorted(f"t{i}".encode() for i in free) and len(y) == len(texts)


def test_spaces_and_long_words_are_linear(spark):
    rows = {r["doc_id"]: r for r in piece_fst.digests(docs(spark), P.path(MODEL)).where("doc_id is not null").collect()}
    assert rows[BIG + 4]["lossless"] and rows[BIG + 2]["lossless"]
    assert rows[BIG + 2]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()


def test_roles_and_long_turns_read_back(spark):
    turns = spark.createDataFrame([(BIG, 1, "a]\nb\\", LONG), (None, 1, "assistant", SPACES), (BIG, 2, "assistant", "]\n</s>\n<s>[")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.conversations_formatted(turns)).collect()}
    assert got[None]["loss_chars"] == len(SPACES) and got[BIG]["n_turns"] == 2
    assert got[BIG]["turns_sha256"] == hashlib.sha256(f"a]\nb\\\n{LONG}\nassistant\n]\n</s>\n<s>[\n".encode()).hexdigest()


def test_first_of_each_keeps_texts_that_share_an_id(spark):
    """Rows of one id stand for their own groups; of equal rows one stays; null ids stay."""
    words = lambda tag, n=40: " ".join(f"{tag}{k}" for k in range(n))
    x, u, v = words("x"), words("u"), words("v")
    near = words("v", 41)  # one shingle more than v
    rows = [(1, x), (5, x), (5, u), (6, v), (6, v), (8, near), (None, x), (None, None), (9, None), (10, " ")]
    got = near_copies.first_of_each(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    assert sorted(map(str, (tuple(r)[:2] for r in got.collect()))) == sorted(map(str, [(1, x), (5, u), (6, v), (None, x), (None, None), (9, None)]))
    assert near_copies.first_of_each(docs(spark, [])).count() == 0
    ids = near_copies.near_copies(docs(spark, rows)).collect()
    assert sorted((r[0], r[1]) for r in ids if r[0]) == [(1, 1), (5, 1), (5, 5), (6, 6), (6, 6), (8, 6), (9, 9), (10, 9)]
