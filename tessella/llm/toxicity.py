"""Toxic spans by a linear-chain conditional random field.

The labels are of documents, so tokens are labelled first: words and word
beginnings that stand in far more different surroundings in toxic than in
clean documents, beyond what chance gives to any of all those tried, mark a
token of a toxic document as toxic; all other tokens are clean. A two-state
chain is trained on windows of these tokens. In a whole text only tokens that
have a known feature differ, so forward-backward runs over these, and the
stretches between them are powers of one matrix: marginals are exact for the
whole chain. A document is scored by the log-odds that any token is toxic and
by the expected number of toxic tokens, calibrated to the share of toxic
documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, whole_rows

#: Labelled documents of each class that the model is fitted on, at most.
SAMPLE = 1500
#: Bytes of text of a class that come to the driver, at most.
SAMPLE_BYTES = 16 << 20
#: Least log-odds of a feature, and the chance that any of all features tried is picked wrongly.
LEAST_ODDS, CHANCE = 2.0, 0.05
FOLDS, HALF = 5, 5
_TOKEN = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned from; a null doc_id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0)) == 0


def features(word: str) -> list[str]:
    """The word itself and its beginnings of 3 to 8 letters."""
    return [word, *(word[:k] + "*" for k in range(3, min(len(word), 9)))]


def tokens(text: str) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text)]


class Chain:
    """The trained chain; clean-to-clean steps and clean tokens weigh 0."""

    def __init__(self, weights: dict[str, float], active: float, idle: float, steps: tuple[float, float, float], calibration: tuple[float, ...]):
        self.weights, self.active, self.idle, self.calibration = weights, active, idle, calibration
        to_toxic, to_clean, stay = steps
        self.step = np.array([[1.0, math.exp(to_toxic)], [math.exp(to_clean), math.exp(stay)]])
        self.quiet = self.step * np.array([1.0, math.exp(idle)])
        self._powers: dict[int, tuple] = {}

    def emission(self, word: str) -> float:
        """Log weight of a toxic token; 0 stands for tokens without a known feature."""
        found = [self.weights[f] for f in features(word) if f in self.weights]
        return (self.active + sum(found)) or 1e-12 if found else 0.0

    def _power(self, n: int):
        """quiet^n scaled, and the log of its scale."""
        if n not in self._powers:
            if len(self._powers) > 50_000:
                self._powers.clear()
            out, log, base, log_base, k = np.eye(2), 0.0, self.quiet, 0.0, n
            while k:
                if k & 1:
                    out, log = out @ base, log + log_base
                    log, out = log + math.log(out.max()), out / out.max()
                base, log_base, k = base @ base, 2 * log_base, k >> 1
                log_base, base = log_base + math.log(base.max()), base / base.max()
            self._powers[n] = tuple(out.ravel().tolist()), log
        return self._powers[n]

    def marginals(self, scores: np.ndarray):
        """(log of the chain's sum, positions of known tokens, their chance to be toxic)."""
        at = np.flatnonzero(scores)
        a, b, log, before, forward = 1.0, 0.0, 0.0, -1, []
        (s00, s01), (s10, s11) = self.step.tolist()
        for p in at.tolist():
            (m00, m01, m10, m11), l = self._power(p - before - 1)
            a, b, log = a * m00 + b * m10, a * m01 + b * m11, log + l
            e = math.exp(min(float(scores[p]), 300.0))
            a, b = a * s00 + b * s10, (a * s01 + b * s11) * e
            scale = a + b
            a, b, log, before = a / scale, b / scale, log + math.log(scale), p
            forward.append((a, b))
        (m00, m01, m10, m11), l = self._power(len(scores) - before - 1)
        x, y = m00 + m01, m10 + m11
        total = log + l + math.log(a * x + b * y)
        chance = [0.0] * len(forward)
        for k in range(len(forward) - 1, -1, -1):
            a, b = forward[k]
            chance[k] = b * y / (a * x + b * y)
            if k:
                e = math.exp(min(float(scores[at[k]]), 300.0))
                x, y = s00 * x + s01 * e * y, s10 * x + s11 * e * y
                (m00, m01, m10, m11), _ = self._power(int(at[k] - at[k - 1]) - 1)
                x, y = m00 * x + m01 * y, m10 * x + m11 * y
                x, y = x / (x + y), y / (x + y)
        return total, at, chance

    def evidence(self, scores: np.ndarray):
        """What a document is scored by: log-odds of any toxic token, and expected toxic tokens."""
        total, at, chance = self.marginals(scores)
        odds = total + math.log(-math.expm1(-total)) if total > 1e-300 else -40.0
        return max(-40.0, min(40.0, odds)), math.log1p(sum(chance)), at, chance

    def score(self, odds: float, count: float) -> float:
        c = self.calibration
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, c[0] + c[1] * odds + c[2] * count))))


def _fit_windows(windows, n_features):
    """Weights by maximum likelihood over windows [(feature lists), (labels)], all of one length."""
    size, length = len(windows), 2 * HALF + 1
    y = np.array([w[1] for w in windows], dtype=float)
    rows, cols, ids = [], [], []
    for i, (feats, _) in enumerate(windows):
        for j, f in enumerate(feats):
            rows += [i] * len(f)
            cols += [j] * len(f)
            ids += f
    ids, cells = np.array(ids, int), np.array(rows, int) * length + np.array(cols, int)
    known = np.zeros(size * length, bool)
    known[cells] = True
    known = known.reshape(size, length)
    w = np.zeros(n_features + 5)
    w[-5:] = -1.0, -3.0, -2.0, 0.0, 0.5  # active, idle; steps to toxic, to clean, staying
    mean, square = np.zeros_like(w), np.zeros_like(w)
    pair = np.stack([((1 - y[:, :-1]) * y[:, 1:]).sum(), (y[:, :-1] * (1 - y[:, 1:])).sum(), (y[:, :-1] * y[:, 1:]).sum()])
    for turn in range(1, 121):
        u = np.where(known, w[-5], w[-4])
        u += np.bincount(cells, weights=w[ids], minlength=size * length).reshape(size, length)
        t = np.array([[0.0, w[-3]], [w[-2], w[-1]]])
        alpha, beta = np.zeros((length, size, 2)), np.zeros((length, size, 2))
        alpha[0, :, 1] = u[:, 0]
        for k in range(1, length):
            alpha[k] = np.logaddexp(alpha[k - 1, :, :1] + t[0], alpha[k - 1, :, 1:] + t[1])
            alpha[k, :, 1] += u[:, k]
        for k in range(length - 2, -1, -1):
            nxt = beta[k + 1].copy()
            nxt[:, 1] += u[:, k + 1]
            beta[k] = np.logaddexp(t[:, 0] + nxt[:, :1], t[:, 1] + nxt[:, 1:])
        z = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
        chance = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z).T
        seen = np.zeros(3)
        for k in range(length - 1):
            nxt = beta[k + 1].copy()
            nxt[:, 1] += u[:, k + 1]
            for n, (a, b) in enumerate(((0, 1), (1, 0), (1, 1))):
                seen[n] += np.exp(alpha[k, :, a] + t[a, b] + nxt[:, b] - z).sum()
        off = y - chance
        g = np.bincount(ids, weights=off.ravel()[cells], minlength=len(w))
        g[-5], g[-4] = off[known].sum(), off[~known].sum()
        g[-3:] = pair - seen
        g = g / size - 1e-5 * w
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w += 0.2 * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    return w


def _contexts(words: list[list[str]], toxic: np.ndarray) -> tuple[Counter, Counter]:
    """By class, in how many different surroundings (the word before, the word after) each feature stands.

    A passage that many documents copy is one surrounding, however often it comes. "" counts them all.
    """
    by_word, seen = (Counter(), Counter()), (set(), set())
    for w, y in zip(words, toxic.tolist()):
        for at in zip(["", *w], w, [*w[1:], ""]):
            key = hash(at)
            if key not in seen[y]:
                seen[y].add(key)
                by_word[y][at[1]] += 1
    counts = (Counter(), Counter())
    for y in (0, 1):
        for word, n in by_word[y].items():
            counts[y][""] += n
            for f in features(word):
                counts[y][f] += n
    return counts


def _surprise(a: int, b: int, share: float) -> float:
    """-log of a bound on the chance that a of a + b trials succeed, or more, where each does with ``share``."""
    rate = a / (a + b)
    if rate <= share:
        return 0.0
    return a * math.log(rate / share) + (b * math.log((1 - rate) / (1 - share)) if b else 0.0)


def fit(texts: list[str], toxic: list[int], share: float) -> Chain | None:
    """The chain from labelled documents; None unless both classes are there."""
    toxic = np.asarray(toxic, dtype=int)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    words = [tokens(t or "") for t in texts]
    counts = _contexts(words, toxic)
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    # so many surroundings are toxic ones at random; a feature must exceed that beyond doubt
    toxic_share = counts[1][""] / max(1, counts[0][""] + counts[1][""])
    tried = [f for f in counts[1] if f]
    doubt = math.log(max(1, len(tried)) / CHANCE)

    def odds(f: str) -> float:
        return math.log((counts[1][f] + 0.5) / (counts[1][""] + 1)) - math.log((counts[0][f] + 0.5) / (counts[0][""] + 1))

    picked = {f: odds(f) for f in tried if _surprise(counts[1][f], counts[0][f], toxic_share) >= doubt}
    picked = sorted(f for f, o in picked.items() if o >= LEAST_ODDS)
    index = {f: i for i, f in enumerate(picked)}
    known = {x: [index[f] for f in features(x) if f in index] for x in set().union(*words)}
    windows, draw = [], np.random.default_rng(0)
    pad = [[]] * HALF
    for w, y in zip(words, toxic):
        feats = pad + [known[x] for x in w] + pad
        # every token with a feature, and one of any kind
        chosen = [p for p in range(HALF, len(feats) - HALF) if feats[p]]
        if w:
            chosen = [*chosen, HALF + int(draw.integers(len(w)))]
        for p in chosen:
            part = feats[p - HALF : p + HALF + 1]
            windows.append((part, [int(y and bool(f)) for f in part]))
    if not windows:
        return None
    w = _fit_windows(windows, len(picked))
    model = Chain(dict(zip(picked, w.tolist())), float(w[-5]), float(w[-4]), tuple(w[-3:].tolist()), (0.0, 1.0, 0.0))
    cache = _Emissions(model)
    got = [model.evidence(np.array([cache[x] for x in d], dtype=float))[:2] for d in words]
    x = np.array([[1.0, o, c] for o, c in got])
    weight = np.where(toxic == 1, share / n1, (1 - share) / n0)
    c = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -40, 40)))
        g = x.T @ (weight * (toxic - p)) - 1e-4 * c
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(3)
        c = c + np.linalg.solve(h, g)
    model.calibration = tuple(c.tolist())
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Chain | None:
    """Fits on at most ``sample`` labelled documents of each class, drawn by hash.

    Labels of held-out rows are dropped before anything is learned. A document
    with several labels is toxic if one of them says so; of rows that repeat
    its doc_id one text is taken, the least. What comes to the driver is bounded
    by bytes too: documents are taken in order of their hash as long as a class
    has at most ``sample_bytes`` of text, but none that has a sixteenth of that alone.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    # at most twice ``sample`` rows of two numbers
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(ids, "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = rows.withColumn("bytes", F.octet_length("text")).where(F.col("bytes") <= sample_bytes // 16)
    so_far = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("bytes").over(so_far)).where(F.col("upto") <= sample_bytes)
    rows = sorted(rows.select("id", "y", "text").collect(), key=lambda r: r["id"])
    return fit([r["text"] for r in rows], [r["y"] for r in rows], sizes[1] / sum(sizes.values()))


class _Emissions(dict):
    def __init__(self, model: Chain):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        e = self[word] = self.model.emission(word)
        return e


OUT = "score double, n_toxic long, spans string"


def scorer(model: Chain | None):
    """A column function of text: its score, and the toxic tokens' number and offsets."""

    @F.pandas_udf(OUT)
    def score(texts: pd.Series) -> pd.DataFrame:
        if model is None:
            return pd.DataFrame({"score": [0.0] * len(texts), "n_toxic": 0, "spans": ""})
        known, rows = _Emissions(model), []
        for text in texts:
            words = tokens(text) if text else []
            scores = np.fromiter(map(known.__getitem__, words), dtype=float, count=len(words))
            odds, count, at, chance = model.evidence(scores)
            bad = [p for p, c in zip(at.tolist(), chance) if c >= 0.5]
            spans = ""
            if bad:
                where, wanted = [], set(bad)
                for p, m in enumerate(_TOKEN.finditer(text)):
                    if p in wanted:
                        where.append(f"{m.start()}:{m.end()}")
                spans = ",".join(where)
            rows.append((model.score(odds, count), len(bad), spans))
        return pd.DataFrame(rows, columns=["score", "n_toxic", "spans"])

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, n_toxic, spans.

    Only the text is scored. Null and empty texts get the score of a text
    without any token. Without labels of both classes the score is 0. Spans
    are code points start:end of tokens that are likelier toxic than not.
    Rows that repeat each get a row, equal texts equal scores. A text is scored
    whole, in time and memory in proportion to it. An empty table gives no
    rows. Other columns, whatever their names, are not looked at.
    """
    score = scorer(train(docs, labels))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("__r"))
    return out.select("doc_id", "held_out", F.col("__r.score").alias("score"), (F.col("__r.score") >= 0.5).cast("int").alias("predicted"), F.col("__r.n_toxic").alias("n_toxic"), F.col("__r.spans").alias("spans"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, with all their columns, whatever their names."""
    score = scorer(train(docs, labels))
    rows = whole_rows(docs)
    return rows.withColumn("score", score(F.col("row.text"))["score"]).where("score < 0.5").select("row.*")


def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
