"""URL filters: rules of hosts and path prefixes, then logistic regression on hashed character n-grams.

A url is cut into host and path by column functions. Rules, where one fits, decide; the rest
is judged by a linear model of the n-grams of host and path, fitted by gradient steps to a
small table of labelled urls. Scoring is map-only and vectorised over each batch of urls.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import mix, written

ALLOW, BLOCK = "allow", "block"
#: Lengths of the n-grams, and hashed features.
SIZES, FEATURES = (3, 4, 5), 1 << 18
#: Labelled urls that a fit takes to the driver at most; a larger table is refused.
MAX_LABELLED = 20_000
#: Rules that one pass holds in each task; more rules take more passes.
RULES_A_PASS = 50_000
RATE, PENALTY, STEPS = 0.05, 1e-4, 400
#: Weight of the unwanted class in a fit; below one half it allows more.
UNWANTED = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words of the labelled examples: sites one would leave out of a corpus, and ordinary ones.
_UNWANTED = (
    "casino poker jackpot slots roulette betting bets bet gamble lottery winbig bigwin casino-games free-spins sportsbook "
    "pills pharmacy viagra cheap-meds no-rx discount-drugs weight-loss steroids "
    "adult xxx xxx-movies xxxclips sexvideos porn sexy camgirls nude escorts hookup adult-dating sex-chat "
    "spam spam-links seo-links linkfarm link-farm content-farm farm-links backlinks "
    "ads adserver ad-track tracking track tracker clicks click-bait popunder banner-ads "
    "warez keygen cracked torrent-free free-download malware phishing payday-loans fast-cash cheap-loans replica-watches cheap-watches free-money win-prizes"
).split()
_WANTED = (
    "news library museum garden weather school university college science history nature travel recipes cooking music theatre "
    "cinema gallery painting poetry books reading writing journal magazine review daily herald tribune gazette chronicle observer "
    "city village council parliament ministry court health clinic hospital nursing sports football cycling running hiking climbing "
    "river mountain forest island harbour station railway airport bridge market bakery farm orchard dairy fishery workshop engineering "
    "software python database network algorithms physics chemistry biology geology astronomy mathematics statistics economics trade "
    "archive records letters maps atlas dictionary encyclopedia forum community volunteers charity foundation research institute "
    "adulteducation tracksandfields addresses additive betterhomes alphabet therapist essex pillow winter windows spanish "
    "freelance freedom cheapside clickteam thornton thistle theory another station nation mention question"
).split()
_ENDS = ("example.com", "example.net", "example.org", "com", "net", "info")
_PATHS = ("/", "/en/17", "/de/204.html", "/fr/9/", "/es/1500", "/index.html", "/2021/05/item", "/page/3", "")


def examples() -> list[tuple[str, bool]]:
    """The labelled urls that come with the filter, made by rule: url, whether it is unwanted.

    Every name stands under several ends, prefixes and paths alike, so that none of these
    tells the classes apart. Names without meaning, built from checksums, are ordinary.
    """
    syllables = [a + b for a in "bcdfghlmnprstvw" for b in ("a", "e", "i", "o", "u", "er", "on", "th")]

    def invented(k: int) -> str:
        h = zlib.crc32(str(k).encode())
        return "".join(syllables[(h >> 7 * i) % len(syllables)] for i in range(2 + h % 3))

    wanted = [*_WANTED, *[invented(k) for k in range(600)]]
    out = []
    for bad, names in ((True, _UNWANTED), (False, wanted)):
        for k, name in enumerate(names):
            for j in range(6 if bad else 3):
                h = zlib.crc32(f"{name}/{j}".encode())
                front = ("", "www.", "m.", "blog.")[h % 4]
                own = name if j % 3 else name + ("-" if h >> 9 & 1 else "") + names[(k * 7 + j + 1) % len(names)]
                out.append((f"http{'s' * (h >> 2 & 1)}://{front}{own}.{_ENDS[(h >> 4) % len(_ENDS)]}{_PATHS[(h >> 12) % len(_PATHS)]}", bad))
    return out


def labelled(spark: SparkSession) -> DataFrame:
    """``url, unwanted``: the examples as a table."""
    return spark.createDataFrame(examples(), "url string, unwanted boolean")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def features(hosts: list[bytes], paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each n-gram of each url, and the url it is of, in order.

    A host stands between ``^`` and ``$``; digits count as one digit.
    """
    found, owner = [], []
    for salt, texts in ((1, [b"^" + h + b"$" for h in hosts]), (2, paths)):
        size = np.array([len(t) for t in texts], np.int64)
        byte = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
        byte[(byte >= 48) & (byte <= 57)] = 48
        own = np.repeat(np.arange(len(texts)), size)
        for n in SIZES:
            m = len(byte) - n + 1
            if m <= 0:
                continue
            acc = np.full(m, salt * 1_000_003 + n, np.uint64)
            for j in range(n):
                acc = acc * np.uint64(0x9E3779B97F4A7C15) + byte[j : m + j]
            whole = own[:m] == own[n - 1 :]
            found.append((mix(acc[whole]) & np.uint64(FEATURES - 1)).astype(np.int64))
            owner.append(own[:m][whole])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    f, o = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    return f[order], o[order]


@dataclass
class Model:
    """Weights of the features, and the intercept."""

    weight: np.ndarray
    bias: float

    def scores(self, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
        """Probability that each url is unwanted."""
        f, o = features(hosts, paths)
        return 1 / (1 + np.exp(-np.clip(np.bincount(o, self.weight[f], len(hosts)) + self.bias, -30, 30)))


def fitted(rows: list[tuple[str, str, bool]]) -> Model:
    """Logistic regression with an L2 penalty on ``host, path, unwanted``; the unwanted class weighs ``UNWANTED``.

    Without rows of both classes the model allows everything.
    """
    model = Model(np.zeros(FEATURES), -2.0)
    y = np.array([bool(r[2]) for r in rows], float)
    if not 0 < y.sum() < len(y):
        return model
    f, o = features([r[0].encode() for r in rows], [r[1].encode() for r in rows])
    used, f = np.unique(f, return_inverse=True)
    share = np.where(y > 0, UNWANTED / y.sum(), (1 - UNWANTED) / (len(y) - y.sum()))
    w, b = np.zeros(len(used)), 0.0
    square, square_b = np.full(len(used), 1e-8), 1e-8
    for _ in range(STEPS):
        z = np.bincount(o, w[f], len(y)) + b
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        step = np.bincount(f, error[o], len(used)) + PENALTY * w
        square, square_b = square + step**2, square_b + error.sum() ** 2
        w, b = w - RATE * step / np.sqrt(square), b - RATE * error.sum() / np.sqrt(square_b)
    model.weight[used] = w
    model.bias = float(b)
    return model


def fit(table: DataFrame, url_col: str = "url", label_col: str = "unwanted", max_rows: int = MAX_LABELLED) -> Model:
    """A model of a small labelled table; rows without a url or a label teach nothing.

    Raises ``ValueError`` if the table has over ``max_rows`` such rows: it is for small tables.
    """
    known = table.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull())
    got = known.select(host(F.col(url_col)), path(F.col(url_col)), F.col(label_col).cast("boolean")).limit(max_rows + 1).collect()
    if len(got) > max_rows:
        raise ValueError(f"over {max_rows} labelled urls")
    return fitted(sorted(map(tuple, got)))


class _Rules:
    """Some rules, asked by host and path."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.paths: dict[str, dict[str, str]] = {}
        for h, p, verdict in rules:
            known = self.paths.setdefault(h, {})
            known[p] = BLOCK if BLOCK in (verdict, known.get(p)) else verdict
        self.sizes = {h: sorted({len(p) for p in known}, reverse=True) for h, known in self.paths.items()}

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its verdict."""
        best = None
        at = 0
        while True:
            suffix = host[at:]
            known = self.paths.get(suffix)
            if known is not None and suffix:
                for n in self.sizes[suffix]:
                    if n <= len(path) and (p := path[:n]) in known:
                        if best is None or len(suffix) + n > len(best[0]):
                            best = (suffix + p, known[p])
                        break
            at = host.find(".", at) + 1
            if not at:
                return best


def _ruled(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rows`` with ``__rule, __verdict`` replaced where one of ``rules`` is longer."""
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Rules(rules)
        for batch in batches:
            made = [[], []]
            for h, p, r, v in zip(*(batch.column(c).to_pylist() for c in ("__host", "__path", "__rule", "__verdict")), strict=True):
                found = held.longest(h, p)
                if found and (r is None or len(found[0]) > len(r)):
                    r, v = found
                made[0].append(r)
                made[1].append(v)
            columns = {c: batch.column(c) for c in names} | {"__rule": pa.array(made[0], pa.string()), "__verdict": pa.array(made[1], pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return rows.mapInArrow(run, rows.schema)


def _with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of each row, by passes over the rules in blocks of a bounded number."""
    rules = rules.where("host is not null and verdict is not null").select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    blocks = -(-rules.count() // RULES_A_PASS)
    for k in range(blocks):
        block = rules if blocks == 1 else rules.where(F.pmod(F.xxhash64("host", "path"), F.lit(2 * blocks)).isin(2 * k, 2 * k + 1))
        rows = _ruled(rows, sorted(map(tuple, block.collect())))
        if k + 1 < blocks:
            rows = written(rows, "urls-ruled")
    return rows


def judged(pages: DataFrame, model: Model, rules: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """``pages`` without ``url_col``, with ``host, path, rule, verdict, score`` (those names are replaced).

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains of it, if the path
    begins with the rule's; of several the longest in characters counts, and of the same rule
    with both verdicts ``block``. ``rule`` is its host and path, null where none fits; then the verdict is
    ``block`` for a score of one half or more. ``score`` is the model's probability that the
    url is unwanted, with or without a rule. A null url, or one without ``://``, has an empty
    host and path. Rules without a host or a verdict are ignored. Rows keep their number and
    their other columns, whatever their names; an empty table gives an empty one.
    """
    made = ("host", "path", "rule", "verdict", "score")
    others = [c for c in pages.columns if c not in (*made, url_col)]
    url = F.col(f"`{url_col}`").cast("string")
    none = F.lit(None).cast("string")
    rows = pages.select(*[F.col(f"`{c}`") for c in others], host(url).alias("__host"), path(url).alias("__path"), none.alias("__rule"), none.alias("__verdict"))
    if rules is not None:
        rows = _with_rules(rows, rules)
    fields = StructType([rows.schema[c] for c in others] + [StructField(c, StringType()) for c in made[:4]] + [StructField("score", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                hosts, paths = ([t.encode() for t in part.column(c).to_pylist()] for c in ("__host", "__path"))
                score = model.scores(hosts, paths)
                verdict = [v or (BLOCK if s >= 0.5 else ALLOW) for v, s in zip(part.column("__verdict").to_pylist(), score.tolist(), strict=True)]
                columns = [part.column(c) for c in [*others, "__host", "__path", "__rule"]] + [pa.array(verdict, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, [*others, *made])

    return rows.mapInArrow(run, fields)


def clean(pages: DataFrame, model: Model, rules: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` whose url is allowed, with all their columns; edge cases as for ``judged``."""
    kept = judged(pages.withColumn("__url", F.col(f"`{url_col}`")).select("__url", F.struct("*").alias("__row")), model, rules, "__url")
    return kept.where(F.col("verdict") == ALLOW).select("__row.*").drop("__url")
