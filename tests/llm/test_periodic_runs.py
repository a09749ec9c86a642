"""Runs of repeated words against all stretches of all periods."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablegauge.llm import periodic_runs
from tablegauge.llm.queries import op11_periodic_runs


def brute(words):
    """``start, length, period`` of every run, by looking at every period."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in out.items())


def expected(text):
    words = (text or "").replace("\v", " ").replace("\f", " ").split()
    runs = brute(words)
    keep = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(keep)))


def got(texts):
    d = periodic_runs.described([t.encode() for t in texts])
    return list(zip(*(d[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")), strict=True))


def repeated(rng, depth=0):
    """Words with runs inside runs."""
    base = [rng.choice("ab" if rng.random() < 0.6 else "abcdefgh") for _ in range(rng.choice([1, 2, 3, 5, 9, 17, 30]))]
    if depth < 3 and rng.random() < 0.7:
        base = base + repeated(rng, depth + 1)
    return (base * rng.choice([1, 2, 4, 5, 7]))[:1500] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))]


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [" ".join(repeated(rng)[: rng.choice([10, 60, 300, 900])]) for _ in range(25)] + ["", "a", "a a a a a a", "a b " * 3]
    assert got(texts) == [expected(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=120).map(" ".join), min_size=1, max_size=6))
def test_runs_of_two_words(texts):
    assert got(texts) == [expected(t) for t in texts]


def test_long_periods_and_highly_periodic_parts():
    """A period that itself holds long stretches of one word, at every scale."""
    texts = []
    for p in (9, 16, 17, 31, 33, 64, 65, 100, 129, 300):
        texts.append(" ".join((["x"] * (p - 1) + ["y"]) * 4))
        texts.append(" ".join((["x"] * (p // 2) + [f"w{k}" for k in range(p - p // 2)]) * 4 + ["x"] * 3))
        texts.append(" ".join(["u", "v"] * 40 + (["a", "b"] * (p // 2) + ["c"]) * 5))
        texts.append(" ".join((["x"] * (p - 1) + ["y"]) * 4)[:-2])  # one word short of four periods
    assert got(texts) == [expected(t) for t in texts]


def test_planted_texts_and_columns(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(0, 90)))) for k in range(300)] + [(None, "a a a a a a"), (5, None), (6, " \t\v\r\n"), (7, "é é é é é é é"), (7, "é é é é é é é")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_runs int")
    planted = {}
    for i, t in rows:
        words = (t or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and words:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            t = " ".join(words[j] if j < a else words[a + (j - a) % p] for j in range(len(words)))
        planted.setdefault((i, expected(t)), 0)
        planted[i, expected(t)] += 1
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = {}
    out = periodic_runs.runs_of(periodic_runs.with_repeats(docs)).collect()
    for r in out:
        key = (r["doc_id"], tuple(r[c] for c in names))
        found[key] = found.get(key, 0) + 1
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{x['start']},{x['length']},{x['period']}\n" for x in r["runs"]).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(r["collapsed"].encode()).hexdigest()
    assert found == planted
    assert sum(r["n_runs"] > 0 for r in out if r["doc_id"] is not None) > 5
    assert periodic_runs.runs_of(docs.where("false")).count() == 0


def test_query_over_a_table(spark, tmp_path):
    docs = spark.createDataFrame([(k, "one two three " * k) for k in range(12)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == 12 and got[3]["n_runs"] in (0, 1)
    plain = [k for k in got if zlib.crc32(str(k).encode()) % 10]
    assert all((got[k]["start"], got[k]["length"], got[k]["period"]) == (0, 3 * k, 3) for k in plain if k >= 4)


def test_long_text():
    words = [f"w{k % 7001}" for k in range(30_000)]
    assert got([" ".join(words)])[0][1:5] == (0, 30_000, 7001, 4285)
