"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own hashed embedding beside the mean embedding of its hashed
character n-grams (three and four bytes, edges marked), so unseen inflections of a known
stem resemble it. Overlapping windows of words run through a forward and a backward
gated recurrent layer, attention pools each window's states, and a document scores as its
most toxic window. Training sees document labels only: the loss reaches the windows
through a soft maximum over each document.

Fitting uses a bounded sample of labelled rows (``TRAIN_TOXIC`` and ``TRAIN_CLEAN``, taken
in the order of a hash of the id); scoring covers every window of every text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, document_rows, filtered, mix, with_computed, word_hashes

WINDOW, STRIDE = 32, 16
TRAIN_TOXIC, TRAIN_CLEAN = 1200, 1800
WORD_BUCKETS, GRAM_BUCKETS = 1 << 13, 1 << 14
WORD_DIM, GRAM_DIM, HIDDEN, ATTEND = 8, 16, 12, 8
#: Windows that training passes over, all rounds together (at least three rounds).
TRAIN_WINDOWS = 120_000
#: Texts of the sample in which a bucket must occur; rarer ones, and unseen ones, stay zero.
LEAST_TEXTS = 3
#: Share of words that a training pass leaves out.
DROP = 0.2

_SOLID = np.zeros(258, bool)  # letters, digits, apostrophes and bytes of longer characters
_SOLID[[*range(48, 58), *range(97, 123), 39, *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordTable:
    """Distinct words of some texts, with their buckets, and each text's word numbers (1 up)."""

    def __init__(self, texts: list[bytes]):
        raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        solid = np.r_[False, _SOLID[raw], False]
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        start, end = edge[::2], edge[1::2]
        limit = np.cumsum([len(t) + 1 for t in texts])
        last = np.searchsorted(start, limit)
        hashes = word_hashes(raw, start, end)
        values, where, ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.ids = ids.astype(np.int32) + 1
        self.last, self.first = last, np.r_[0, last[:-1]]
        self.word_bucket = (mix(values) % np.uint64(WORD_BUCKETS)).astype(np.int32)
        size = (end - start)[where]
        # " word " after " word ", so n-grams see the edges
        to = np.cumsum(size + 2)
        begin = to - size - 2
        flat = np.full(int(to[-1]) if len(to) else 0, 32, np.uint64)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(begin + 1, size) + at] = raw[np.repeat(start[where], size) + at]
        grams, owners = [], []
        for n in (3, 4):
            if len(flat) < n:
                continue
            key = np.zeros(len(flat) - n + 1, np.uint64)
            for j in range(n):
                key = key * np.uint64(257) + flat[j : len(flat) - n + 1 + j]
            count = np.maximum(size + 3 - n, 0)
            inside = np.repeat(begin, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            grams.append((mix(key[inside] * np.uint64(8) + np.uint64(n)) % np.uint64(GRAM_BUCKETS)).astype(np.int32))
            owners.append(np.repeat(np.arange(len(size)), count))
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        self.gram_owner = owner[order]
        self.gram = np.concatenate(grams)[order] if grams else np.zeros(0, np.int32)
        self.gram_count = np.bincount(self.gram_owner, minlength=len(size)).astype(np.float32)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows of word numbers (0 pads the end) and the text of each."""
        n = self.last - self.first
        many = np.where(n > 0, np.maximum(1, -(-(n - STRIDE) // STRIDE)), 0)
        text = np.repeat(np.arange(len(n)), many)
        begin = np.repeat(self.first, many) + STRIDE * (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
        at = begin[:, None] + np.arange(WINDOW)
        inside = at < np.repeat(self.last, many)[:, None]
        padded = np.r_[self.ids, np.zeros(WINDOW, np.int32)]
        return np.where(inside, padded[np.minimum(at, len(self.ids))], 0), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    """Initial weights."""
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + GRAM_DIM, HIDDEN

    def some(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    model = {"word": some(WORD_BUCKETS, WORD_DIM, scale=0.05), "gram": some(GRAM_BUCKETS, GRAM_DIM, scale=0.3)}
    for way in "fb":
        model |= {f"W{way}": some(d, 3 * h, scale=d**-0.5), f"U{way}": some(h, 3 * h, scale=h**-0.5), f"c{way}": np.zeros(3 * h, np.float32), f"e{way}": np.zeros(h, np.float32)}
    return model | {"A": some(2 * h, ATTEND, scale=0.3), "a": np.zeros(ATTEND, np.float32), "v": some(ATTEND, scale=0.3), "w": some(2 * h, scale=0.3), "b": np.full(1, -1.0, np.float32)}


def _inputs(model: dict, table: WordTable) -> np.ndarray:
    """Inputs of the distinct words."""
    n = len(table.word_bucket)
    gram = np.zeros((n, GRAM_DIM), np.float32)
    if len(table.gram):
        has = np.flatnonzero(table.gram_count)
        first = np.searchsorted(table.gram_owner, has)
        gram[has] = np.add.reduceat(model["gram"][table.gram], first, axis=0) / table.gram_count[has, None]
    return np.concatenate([model["word"][table.word_bucket], gram], axis=1)


def _run(model: dict, way: str, projected: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction, time first; ``keep`` collects what its gradient needs."""
    h = HIDDEN
    u, e = model[f"U{way}"], model[f"e{way}"]
    state = np.zeros((len(ids), h), np.float32)
    out = np.empty((WINDOW, len(ids), h), np.float32)
    for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
        x, hu = projected[ids[:, t]], state @ u
        zr = _sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        inner = hu[:, 2 * h :] + e
        new = np.tanh(x[:, 2 * h :] + r * inner)
        m = mask[:, t, None]
        if keep is not None:
            keep.append((t, state, z, r, inner, new, m))
        state = state + m * (1 - z) * (new - state)
        out[t] = state
    return out


def window_logits(model: dict, table: WordTable, ids: np.ndarray, batch: int = 1024) -> np.ndarray:
    """A logit for every window."""
    x = _inputs(model, table)
    project = {w: np.concatenate([np.zeros((1, 3 * HIDDEN), np.float32), x @ model[f"W{w}"] + model[f"c{w}"]]) for w in "fb"}
    out = np.empty(len(ids), np.float32)
    for at in range(0, len(ids), batch):
        some = ids[at : at + batch]
        mask = (some > 0).astype(np.float32)
        states = np.concatenate([_run(model, w, project[w], some, mask) for w in "fb"], axis=2)
        score = np.tanh(states @ model["A"] + model["a"]) @ model["v"] - 1e4 * (1 - mask.T)
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        out[at : at + batch] = np.einsum("tn,tnd,d->n", weight, states, model["w"]) + model["b"][0]
    return out


def _gradients(model: dict, table: WordTable, ids: np.ndarray, text: np.ndarray, label: np.ndarray, doc_weight: np.ndarray, sharp: float) -> tuple[float, dict]:
    """Loss and gradients over the windows of some whole documents."""
    h, n = HIDDEN, len(ids)
    x = _inputs(model, table)
    mask = (ids > 0).astype(np.float32)
    kept: dict[str, list] = {"f": [], "b": []}
    projected = {w: np.concatenate([np.zeros((1, 3 * h), np.float32), x @ model[f"W{w}"] + model[f"c{w}"]]) for w in "fb"}
    states = np.concatenate([_run(model, w, projected[w], ids, mask, kept[w]) for w in "fb"], axis=2)
    inner = np.tanh(states @ model["A"] + model["a"])
    score = inner @ model["v"] - 1e4 * (1 - mask.T)
    weight = np.exp(score - score.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tn,tnd->nd", weight, states)
    logit = pooled @ model["w"] + model["b"][0]
    # soft maximum of each document's windows
    docs, own = np.unique(text, return_inverse=True)
    top = np.full(len(docs), -np.inf, np.float32)
    np.maximum.at(top, own, logit)
    share = np.exp(sharp * (logit - top[own]))
    total = np.bincount(own, share, len(docs)).astype(np.float32)
    share /= total[own]
    doc_logit = np.bincount(own, share * logit, len(docs)).astype(np.float32)
    p = _sigmoid(doc_logit)
    y, dw = label[docs], doc_weight[docs]
    loss = float(-(dw * np.where(y > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7))).sum() / dw.sum())
    d_logit = ((p - y) * dw / dw.sum())[own] * share
    g: dict[str, np.ndarray] = {"w": pooled.T @ d_logit, "b": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * model["w"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = np.einsum("tnd,nd->tn", states, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    g["v"] = np.einsum("tn,tna->a", d_score, inner)
    d_inner = d_score[:, :, None] * model["v"] * (1 - inner**2)
    g["A"], g["a"] = np.einsum("tnd,tna->da", states, d_inner), d_inner.sum((0, 1))
    d_states += d_inner @ model["A"].T
    d_x = np.zeros_like(x)
    flat = ids.T.reshape(-1)
    by_word = np.argsort(flat, kind="stable")
    used, first = np.unique(flat[by_word], return_index=True)
    for k, w in enumerate("fb"):
        u = model[f"U{w}"]
        steps = np.empty((WINDOW, n, 3 * h), np.float32)
        d_u, d_e = np.zeros_like(u), np.zeros_like(model[f"e{w}"])
        d_h = np.zeros((n, h), np.float32)
        for t, before, z, r, hn, new, m in reversed(kept[w]):
            d_h = d_h + d_states[t, :, k * h : (k + 1) * h]
            d_new = d_h * m * (1 - z) * (1 - new**2)
            d_z = d_h * m * (before - new) * z * (1 - z)
            d_r = d_new * hn * r * (1 - r)
            d_hn = d_new * r
            d_gate = np.concatenate([d_z, d_r, d_hn], axis=1)
            d_u += before.T @ d_gate
            d_e += d_hn.sum(0)
            steps[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_h = d_h * (1 - m * (1 - z)) + d_gate @ u.T
        d_proj = np.zeros_like(projected[w])
        d_proj[used] = np.add.reduceat(steps.reshape(-1, 3 * h)[by_word], first, axis=0)
        d_proj = d_proj[1:]
        g |= {f"U{w}": d_u, f"e{w}": d_e, f"W{w}": x.T @ d_proj, f"c{w}": d_proj.sum(0)}
        d_x += d_proj @ model[f"W{w}"].T
    g["word"] = np.zeros_like(model["word"])
    np.add.at(g["word"], table.word_bucket, d_x[:, :WORD_DIM])
    g["gram"] = np.zeros_like(model["gram"])
    if len(table.gram):
        by_gram = np.argsort(table.gram, kind="stable")
        used, first = np.unique(table.gram[by_gram], return_index=True)
        shares = d_x[:, WORD_DIM:] / np.maximum(table.gram_count, 1)[:, None]
        g["gram"][used] = np.add.reduceat(shares[table.gram_owner[by_gram]], first, axis=0)
    return loss, g


def _spread(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts each word bucket and each n-gram bucket occurs."""
    words, grams = np.zeros(WORD_BUCKETS, np.int64), np.zeros(GRAM_BUCKETS, np.int64)
    for group in chunks([(t,) for t in texts]):
        table = WordTable([g[0] for g in group])
        owner = np.repeat(np.arange(len(group)), table.last - table.first)
        pairs = np.unique(owner << 32 | (table.ids - 1))
        pairs = np.stack([pairs >> 32, pairs & 0xFFFFFFFF])
        found = np.unique(pairs[0] * WORD_BUCKETS + table.word_bucket[pairs[1]])
        words += np.bincount(found % WORD_BUCKETS, minlength=WORD_BUCKETS)
        first = np.searchsorted(table.gram_owner, np.arange(len(table.word_bucket) + 1))
        count = (first[1:] - first[:-1])[pairs[1]]
        at = np.repeat(first[pairs[1]], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        found = np.unique(np.repeat(pairs[0], count) * GRAM_BUCKETS + table.gram[at])
        grams += np.bincount(found % GRAM_BUCKETS, minlength=GRAM_BUCKETS)
    return words, grams


def fit(texts: list[bytes], labels: list[int], seed: int = 7) -> dict[str, np.ndarray] | None:
    """Train on whole texts; ``None`` if they do not have both labels."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng, model = np.random.default_rng(seed), new_model(seed)
    known = {name: (n >= LEAST_TEXTS).astype(np.float32)[:, None] for name, n in zip(("word", "gram"), _spread(texts), strict=True)}
    for name, mask in known.items():
        model[name] *= mask
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    sizes = np.array([max(1, len(t) // 90) for t in texts])
    rounds = int(np.clip(TRAIN_WINDOWS // max(1, sizes.sum()), 3, 40))
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    batch = int(np.clip(sizes.sum() // 40, 60, 600))  # windows of a step: few for small samples, which else see few steps
    plan = []
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        cut = np.cumsum(sizes[order]) // batch
        plan += np.split(order, np.flatnonzero(cut[1:] != cut[:-1]) + 1)
    for k, chosen in enumerate(plan):
        table = WordTable([texts[i] for i in chosen])
        ids, text = table.windows()
        if not len(ids):
            continue
        done = k / len(plan)
        left = np.where(rng.random(ids.shape) < DROP, 0, ids)
        left[:, 0] = np.where(left.any(axis=1), left[:, 0], ids[:, 0])  # a window keeps a word, its own first one
        ids = left
        _, g = _gradients(model, table, ids, text, y[chosen], balance[chosen], 0.5 + 3 * done)
        step += 1
        rate = 0.012 * (1 - 0.9 * done)
        scale = 1 / max(1.0, float(np.sqrt(sum((v**2).sum() for v in g.values()))))
        for name, value in g.items():
            value = value * scale * known.get(name, 1)
            first[name] += 0.1 * (value - first[name])
            second[name] += 0.01 * (value**2 - second[name])
            model[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> tuple[list[bytes], list[int]]:
    """A bounded sample of labelled texts outside the held-out fold, by a hash of the id.

    Rows without a label of 0 or 1, and ids with both labels, are left out. Of documents
    that share an id the least text is taken, so there is at most one text a label.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(clean))
    texts = document_rows(docs, "doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = sorted((r["doc_id"], r["toxic"], bytes(r["text"])) for r in texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect())
    return [r[2] for r in rows], [int(r[1]) for r in rows]


def text_scores(model: dict[str, np.ndarray] | None, texts: list[bytes], step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Each text's score, that of its most toxic window, and its number of windows; about ``step`` bytes at a time."""
    parts = [_part_scores(model, [t for (t,) in group]) for group in chunks([(t,) for t in texts], step)]
    if not parts:
        return np.zeros(0), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _part_scores(model: dict[str, np.ndarray] | None, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    top, many = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
    table = WordTable(texts)
    ids, text = table.windows()
    if len(ids):
        many = np.bincount(text, minlength=len(texts))
        if model is not None:
            np.maximum.at(top, text, window_logits(model, table, ids).astype(float))
    return np.where(np.isfinite(top), _sigmoid(top), 0.0), many


def score(docs: DataFrame, model: dict[str, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_windows`` for every row, over all its overlapping windows.

    Texts without words, null ones included, score 0, as does every text when there is
    no model. Rows are scored each by itself, those that repeat an id or have none among
    them; texts may have any length. Other columns are ignored, an empty table gives an
    empty one. A model has about 2 MB and is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[bytes]) -> dict:
        values, many = text_scores(held.value, texts)
        return {"score": values, "n_windows": many}

    return with_computed(document_rows(docs, id_col, text_col), compute, "score double, n_windows long")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_windows``: fit on ``labels``, score all of ``docs``.

    Labels that say nothing (null, other than 0 or 1, both at once, without a document) are
    not learnt from; without both kinds of label every score is 0. A null id is not held
    out (null). Else as in ``score``.
    """
    model = fit(*training_rows(docs, labels))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows")


def clean(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; edge cases as in ``scored``."""
    held = docs.sparkSession.sparkContext.broadcast(fit(*training_rows(docs, labels)))
    return filtered(docs, text_col, lambda texts: text_scores(held.value, texts)[0] < threshold)
