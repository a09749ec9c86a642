"""Joins of tables that grow with the input broadcast neither side, however small Spark takes them to be."""

from tablegauge.llm import components, near_copies, simhash

TEXTS = [" ".join(f"w{(7 * k + j) % 90}" for j in range(40)) for k in range(30)]
ROWS = [(k, TEXTS[k % 30] + (" more" if k % 4 == 0 else "")) for k in range(120)] + [(500, None), (501, ""), (None, "w1 w2")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def spied(monkeypatch, *modules):
    """Broadcast joins of every table that the modules write, by its name."""
    seen = []
    for module in modules:
        monkeypatch.setattr(module, "written", lambda df, name, write=module.written: seen.append((name, joins(df))) or write(df, name))
    return seen


def test_links_do_not_broadcast_exploded_fingerprints(spark):
    fps = spark.range(200).selectExpr("xxhash64(id) fp")
    assert joins(simhash.links(fps)) == 0


def test_simhash_broadcasts_frequent_fingerprints_alone(spark, monkeypatch):
    seen = spied(monkeypatch, simhash, components)
    found = simhash.near_duplicates(docs(spark))
    assert {n for n, _ in seen} >= {"fingerprint-groups", "fingerprint-components", "edges"}
    assert [x for x in seen if x[1]] == [] and joins(found) == 2  # the two sides of under a thousand keys


def test_near_copies_broadcast_frequent_components_alone(spark, monkeypatch):
    seen = spied(monkeypatch, near_copies, simhash, components)
    found = near_copies.first_of_each(docs(spark))
    assert {n for n, _ in seen} >= {"near-copy-met", "near-copy-buckets", "near-copy-pairs", "near-copy-texts", "near-copy-links", "near-copy-torn", "near-copy-components"}
    assert [x for x in seen if x[1]] == [("near-copy-components", 2)] and joins(found) == 0
