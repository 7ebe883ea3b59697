"""Quality classifier without hand-made labels: overlapping heuristics, a label model by EM, a hashed linear scorer.

Each heuristic votes good, bad or abstains. Expectation-maximisation over the counts of vote patterns estimates how
often each heuristic is right in either class, which turns a pattern into a posterior label. The posterior labels of a
bounded sample train a linear model on hashed text features, and that model scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import packed, share, shared, unpacked, utf8
from flowloom.llm.lm import release
from flowloom.llm.tokens import forget

GOOD, BAD, NONE = 2, 0, 1
#: Rows that the scorer is fitted on at most (a hash sample of about that size), and the models that are averaged.
FIT_ROWS = 16_000
SHARDS = 8
FEATURES = 4096
THRESHOLD = 0.5

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_PLAIN = _UPPER + _LOWER + bytes(range(48, 58)) + bytes(range(128, 256)) + b" \t\n\r\x0b\x0c"
#: Frequent function words of English, German, French and Spanish (fixed values).
FUNCTION_WORDS = frozenset(
    b"the of and to in a is that for it was on are as with his they at be this from der die das und ist ein eine zu den "
    b"mit von im auf nicht la le les de des et un une en que du dans est pour par au el los las y se del por con una su".split()
)


@dataclass(frozen=True)
class Heuristic:
    """Votes bad at or beyond ``bad``, good at or within ``good``; ``up`` tells whether large values are bad."""

    name: str
    bad: float
    good: float
    up: bool = True
    least: int = 1  # words below which it abstains

    def votes(self, x: float, n: int) -> int:
        if n < self.least:
            return NONE
        if not self.up:
            return BAD if x <= self.bad else GOOD if x >= self.good else NONE
        return BAD if x >= self.bad else GOOD if x <= self.good else NONE


#: Values are in units of what a plain text should not exceed, but for the last.
HEURISTICS = (
    Heuristic("marks", 1.0, 0.5, least=3),
    Heuristic("capitals", 1.0, 0.5, least=3),
    Heuristic("repetition", 1.0, 0.6, least=20),
    Heuristic("repeated_lines", 1.0, 0.6, least=20),
    Heuristic("long_words", 1.0, 0.6, least=3),
    Heuristic("function_words", 0.01, 0.05, up=False, least=30),
)
#: Heuristics that recognise one way of being bad each.
ANCHORS = (0, 1, 2, 3)


def statistics(text: bytes) -> tuple[list[float], int]:
    """Values of the heuristics and the number of words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(HEURISTICS), 0
    size = len(text)
    upper = size - len(text.translate(None, _UPPER))
    lower = size - len(text.translate(None, _LOWER))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    marked = sum(c for w, c in counts.items() if len(w.translate(None, _PLAIN)) > 1)
    common = sum(c for w, c in counts.items() if w.lower() in FUNCTION_WORDS)
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        max(
            len(text.translate(None, _PLAIN)) / size / 0.2,
            text.count(b"!") / n / 0.3,
            text.count(b"|") / n / 0.2,
            marked / n / 0.3,
        ),
        upper / max(1, upper + lower) / 0.5,
        max(max(counts.values()) / n / 0.3, (1 - triples / max(1, n - 2)) / 0.5),
        (1 - len(set(lines)) / len(lines)) / 0.5,
        size / n / 20,
        common / n,
    ], n


def pattern(values: list[float], n: int) -> int:
    """Votes as one number in base 3."""
    out = 0
    for h, x in zip(HEURISTICS, values, strict=True):
        out = 3 * out + h.votes(x, n)
    return out


def votes_of(patterns: np.ndarray) -> np.ndarray:
    """Matrix of votes, a row for each pattern."""
    m = len(HEURISTICS)
    return (np.asarray(patterns)[:, None] // 3 ** np.arange(m - 1, -1, -1)) % 3


@dataclass
class LabelModel:
    """Shares of the latent classes and how likely each heuristic's vote is in each of them.

    Class 0 is good. Bad documents fail in different ways, so each heuristic in ANCHORS has a bad class of its own;
    within a class votes are independent. ``table`` has class x heuristic x vote; bad and good votes sum to one, and no
    vote has weight one, as it says nothing about the class.
    """

    share: np.ndarray
    table: np.ndarray

    def responsibilities(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of each class, a row for each pattern."""
        v = votes_of(patterns)
        logs = np.log(self.table)[:, np.arange(v.shape[1])[None, :], v].sum(axis=2).T + np.log(self.share)
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document with this pattern is good."""
        return self.responsibilities(patterns)[:, 0]

    def accuracies(self) -> dict[str, float]:
        """Of the votes that a heuristic casts, the share that agrees with the class."""
        right = self.share[0] * self.table[0, :, GOOD] + (self.share[1:, None] * self.table[1:, :, BAD]).sum(axis=0)
        return {h.name: float(r) for h, r in zip(HEURISTICS, right, strict=True)}


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """EM over vote patterns. Prior beliefs count as some documents' votes: a heuristic seldom calls a good document
    bad, and the heuristic that names a bad class seldom misses it."""
    v, counts = votes_of(patterns), np.asarray(counts, float)
    total = counts.sum()
    fires = np.stack([v[:, j] == BAD for j in ANCHORS], axis=1)
    p = np.hstack([np.ones((len(v), 1)), np.full(fires.shape, 0.01)])
    p[fires.any(axis=1), 0] = 0.1
    p[:, 1:][fires] = 1.0
    p /= p.sum(axis=1, keepdims=True)
    bad0, good0 = np.ones((p.shape[1], v.shape[1])), np.ones((p.shape[1], v.shape[1]))
    bad0[0], good0[0] = 0.005 * (0.2 * total + 2), 0.995 * (0.2 * total + 2)
    for k, j in enumerate(ANCHORS, 1):
        bad0[k, j], good0[k, j] = 0.95 * (0.01 * total + 2), 0.05 * (0.01 * total + 2)
    for _ in range(rounds):
        w = p * counts[:, None]
        bad, fine = w.T @ (v == BAD) + bad0, w.T @ (v == GOOD) + good0
        table = np.ones((p.shape[1], v.shape[1], 3))
        table[:, :, BAD], table[:, :, GOOD] = bad / (bad + fine), fine / (bad + fine)
        model = LabelModel((w.sum(axis=0) + 1) / (total + p.shape[1]), table)
        new = model.responsibilities(patterns)
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return model


def hashed(text: bytes, values: list[float], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: byte triples by the root of their share, and the fifths of its unit that a statistic reaches. Indices and values."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    tally = np.zeros(FEATURES, np.float32)
    if len(b) > 2:
        h = ((b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]) * np.uint32(2654435761)
        tally += np.sqrt(np.bincount(h >> np.uint32(20), minlength=FEATURES)[:FEATURES] / (len(b) - 2))
    for k, (h, x) in enumerate(zip(HEURISTICS, values, strict=True)):
        reached = range(min(8, int(5 * x)) + 1) if n >= h.least else (11,)
        for step in reached:
            tally[(k * 3571 + step * 271 + 17) % FEATURES] += 1
    at = np.flatnonzero(tally)
    return at, tally[at]


def _train(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by gradient descent with momentum; bias last.

    The rarer class gets more weight, by the root of the ratio.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = y.mean() if len(y) else 0.5
    weight = y / max(share, 1e-3) ** 0.5 + (1 - y) / max(1 - share, 1e-3) ** 0.5
    weight = (weight / max(weight.sum(), 1e-9)).astype(np.float32)
    w, speed = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - rate * (x.T @ (weight * (p - y)) + decay * w)
        w = w + speed
    return w


@dataclass
class Scorer:
    labels: LabelModel
    weights: np.ndarray

    def score(self, text: bytes) -> tuple[int, float]:
        values, n = statistics(text)
        at, x = hashed(text, values, n)
        z = float(self.weights[at] @ x + self.weights[-1])
        return pattern(values, n), 1 / (1 + np.exp(-max(-30.0, min(30.0, z)))) if n else 0.0


def _patterns(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    forget()
    for batch in batches:
        yield pa.array([pattern(*statistics(t.as_py())) for t in batch], pa.int32())
    release()


def pattern_counts(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns of all documents and how often they occur: at most 3 to the number of heuristics rows."""
    votes = F.arrow_udf(_patterns, T.IntegerType()).asNondeterministic()
    rows = docs.select(votes(utf8(F.col(text))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()
    rows.sort()
    return np.array([r["p"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)


def _shard_trainer(labels: LabelModel):
    def train(key: tuple, batch: pa.Table) -> pa.Table:
        forget()
        x = np.zeros((batch.num_rows, FEATURES), np.float32)
        seen = []
        for i, t in enumerate(batch["text"]):
            text = t.as_py()
            values, n = statistics(text)
            at, v = hashed(text, values, n)
            x[i, at] = v
            seen.append(pattern(values, n))
        y = labels.posterior(np.array(seen)).astype(np.float32)
        return pa.table({"n": pa.array([len(y)], pa.int64()), "w": pa.array([_train(x, y).tolist()], pa.list_(pa.float32()))})

    return train


def fit(docs: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS, shards: int = SHARDS) -> Scorer:
    """Label model from the vote patterns of all documents, scorer from a hash sample of about ``fit_rows`` of them.

    The sample is dealt into shards, one model is trained on each, and the models are averaged, so no task and not the
    driver holds more than a shard's sample. Texts are drawn by content, so copies of a text count as one, also in the
    share that is drawn. If no text is drawn (an empty table), all weights are zero and every text with words scores 0.5.
    """
    patterns, counts = pattern_counts(docs, text)
    nothing = np.zeros(FEATURES + 1, np.float32)
    if not counts.sum():
        return Scorer(fit_label_model(np.array([0]), np.array([0])), nothing)
    labels = fit_label_model(patterns, counts)
    content = utf8(F.col(text))
    kept = docs.select(content.alias("text"), F.xxhash64(content).alias("h"))
    texts = kept.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    share = max(1, round(texts / fit_rows))
    sample = kept.filter(F.pmod(F.shiftrightunsigned("h", 8), F.lit(share)) == 0).dropDuplicates(["h"])
    shards = max(1, min(shards, texts // 1000))
    sample = sample.select("text", F.pmod("h", F.lit(shards)).alias("shard"))
    models = sample.groupBy("shard").applyInArrow(_shard_trainer(labels), "n long, w array<float>").collect()
    n = sum(r["n"] for r in models)
    return Scorer(labels, nothing) if not n else Scorer(labels, sum(np.array(r["w"], np.float32) * (r["n"] / n) for r in sorted(models)))


_SCORE = T.StructType([T.StructField("pattern", T.IntegerType()), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType())])


def with_score(docs: DataFrame, scorer: Scorer, text: str = "text", name: str = "_quality") -> DataFrame:
    """``docs`` with a struct ``name``: vote pattern, posterior of the label model, score of the scorer."""
    model = share(docs.sparkSession, scorer)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        known: Scorer = shared(model)
        for batch in batches:
            found = [known.score(t.as_py()) for t in batch]
            p = np.array([f[0] for f in found], np.int32)
            yield pa.StructArray.from_arrays(
                [pa.array(p), pa.array(known.labels.posterior(p)), pa.array([f[1] for f in found], pa.float64())],
                ["pattern", "posterior", "score"],
            )
        release()

    return docs.withColumn(name, F.arrow_udf(score, _SCORE).asNondeterministic()(utf8(F.col(text))))


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **kw) -> DataFrame:
    """One row per document: ``doc_id, votes, posterior, score, keep``.

    ``votes`` has a letter for each heuristic (b bad, - none, g good). Texts without words (null, empty, blank) get
    score 0 and aren't kept. Repeated rows are scored singly and alike. An empty table gives an empty result. Other
    columns aren't read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    scored = with_score(rows, fit(rows, "_text", **kw), "_text")
    m = len(HEURISTICS)
    letters = F.translate(F.lpad(F.conv(F.col("_quality.pattern").cast("string"), 10, 3), m, "0"), "012", "b-g")
    return scored.select(
        "doc_id",
        letters.alias("votes"),
        F.col("_quality.posterior").alias("posterior"),
        F.col("_quality.score").alias("score"),
        (F.col("_quality.score") >= threshold).alias("keep"),
    )


def keep_good(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, **kw) -> DataFrame:
    """``docs`` without the documents whose score is below the threshold; columns stay as they are."""
    scored = with_score(packed(docs, _text=F.col(text)), fit(docs, text, **kw), "_text")
    return unpacked(scored.filter(F.col("_quality.score") >= threshold), docs)
