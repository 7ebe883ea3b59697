"""Language identification by error-correcting output codes.

Every language gets a codeword; for each bit a binary n-gram classifier tells the languages with a one from those with a
zero. The classifiers are log-odds of hashed byte n-grams, estimated from the counts of all training texts, which are
summed per language in tables of a fixed number of cells. A text is decoded to the codeword with the least loss; the
losses are weighted by how well each bit's classifier does on each language, measured on a sample of the training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import share, shared

CELLS = 1 << 14
GRAMS = (1, 2, 3)
#: Languages that a model holds at most; a table has CELLS cells for each.
MAX_LANGUAGES = 512
#: Training texts (about) on which the bits' weights are measured.
WEIGH_ROWS = 4000
#: Least lead in score over the second language; below it a prediction is flagged as ambiguous.
LEAD = 0.2
UNKNOWN = "und"

_OTHER = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))
_FOLD = bytes.maketrans(_OTHER, b" " * len(_OTHER))


def cells(text: str) -> np.ndarray:
    """Counts of the hashed byte n-grams (1 to 3) of the text in lower case, anything but letters as one blank."""
    data = b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = np.zeros(CELLS, np.int64)
    for n in GRAMS:
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, n, np.uint32)
        for k in range(n):
            h = h * np.uint32(16777619) ^ b[k : k + len(h)]
        h *= np.uint32(2654435761)
        out += np.bincount(h >> np.uint32(32 - 14), minlength=CELLS)
    return out


def codebook(n: int, seed: int = 11) -> np.ndarray:
    """Codewords of -1 and 1, a row for each language: all distinct splits for few languages, else random columns.

    Of 50 random books the one whose closest two words are farthest apart is taken.
    """
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        bits = [[1 if (c >> i) & 1 else -1 for i in range(n - 1)] + [-1] for c in range(1, 2 ** (n - 1))]
        return np.array(bits, np.int8).T
    width, rng = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed)
    books = []
    for _ in range(50):
        book = rng.choice(np.array([-1, 1], np.int8), (n, width))
        book = book[:, np.abs(book.sum(axis=0)) < n]  # a column must split the languages
        apart = book.astype(int) @ book.T.astype(int) - 2 * book.shape[1] * np.eye(n, dtype=int)
        books.append((-apart.max(), len(books), book))
    return max(books)[2]


@dataclass
class Coder:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # cell x bit: log-odds
    bit_weight: np.ndarray  # language x bit, each row sums to one
    scale: np.ndarray  # per bit: typical size of a margin

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """Mean log-odds of the text's n-grams, per bit, in units of the bit's scale."""
        return counts @ self.weights / max(1, counts.sum()) / self.scale

    def decode(self, margins: np.ndarray) -> tuple[int, float, float]:
        """Language with the least weighted loss, its score and its lead over the second."""
        loss = (self.bit_weight * np.exp(-np.clip(self.code * margins, -4, 4))).sum(axis=1)
        p = np.exp(-3 * (loss - loss.min()))
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return int(order[0]), float(p[order[0]]), float(p[order[0]] - (p[order[1]] if len(p) > 1 else 0.0))


def _tallies(names: list[str]):
    """Function for mapInArrow: n-gram counts by language, summed over the whole task before anything is emitted."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), CELLS), np.int64)
        number = {x: i for i, x in enumerate(names)}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                sums[number[lang.as_py()]] += cells(text.as_py())
        at = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(at[0].astype(np.int32)), "cell": pa.array(at[1].astype(np.int32)), "n": pa.array(sums[at])}
        )

    return tally


def fit(train: DataFrame, weigh_rows: int = WEIGH_ROWS, smooth: float = 0.5) -> Coder:
    """Coder from training rows ``text, lang`` (neither null). All rows count; a hash sample measures the bits' weights."""
    sizes = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    names, rows = [r["lang"] for r in sizes], sum(r["n"] for r in sizes)
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    code = codebook(len(names))
    if len(names) < 2:
        return Coder(names, code, np.ones((CELLS, code.shape[1])), np.ones(code.shape), np.ones(code.shape[1]))
    sums = train.mapInArrow(_tallies(names), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(names), CELLS))
    for r in sums.toArrow().to_batches():  # languages x CELLS rows at most
        counts[r["lang"].to_numpy(), r["cell"].to_numpy()] = r["n"].to_numpy()
    share = counts + smooth
    share /= share.sum(axis=1, keepdims=True)  # languages weigh alike, however many texts they have
    ones, zeros = (code.T > 0).astype(float), (code.T < 0).astype(float)
    odds = np.log(ones @ share / ones.sum(axis=1, keepdims=True)) - np.log(zeros @ share / zeros.sum(axis=1, keepdims=True))
    coder = Coder(names, code, odds.T.copy(), np.full(code.shape, 1 / code.shape[1]), np.ones(code.shape[1]))
    return _weigh(train, coder, rows, weigh_rows)


def _weigh(train: DataFrame, coder: Coder, rows: int, weigh_rows: int) -> Coder:
    """Set scales and loss weights from margins of a hash sample of about ``weigh_rows`` training texts."""
    share = max(1, round(rows / weigh_rows))
    sample = train.filter(F.pmod(F.shiftrightunsigned(F.xxhash64("text"), 8), F.lit(share)) == 0)
    names, bits = coder.languages, coder.code.shape[1]

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per language and bit: texts, texts on the right side, sum of the margins' sizes."""
        number = {x: i for i, x in enumerate(names)}
        sums = np.zeros((len(names), bits, 3))
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                i, m = number[lang.as_py()], coder.margins(cells(text.as_py()))
                sums[i, :, 0] += 1
                sums[i, :, 1] += coder.code[i] * m > 0
                sums[i, :, 2] += np.abs(m)
        flat = sums.reshape(-1, 3)
        yield pa.RecordBatch.from_pydict(
            {"k": pa.array(np.arange(len(flat), dtype=np.int32)), **{c: pa.array(flat[:, j].copy()) for j, c in enumerate("nrs")}}
        )

    found = sample.mapInArrow(margins, "k int, n double, r double, s double").groupBy("k").agg(
        F.sum("n").alias("n"), F.sum("r").alias("r"), F.sum("s").alias("s")
    )
    n, r, s = (np.zeros(len(names) * bits) for _ in range(3))
    for row in found.collect():  # languages x bits rows
        n[row["k"]], r[row["k"]], s[row["k"]] = row["n"], row["r"], row["s"]
    n, r, s = (x.reshape(len(names), bits) for x in (n, r, s))
    right = np.clip((r + 1) / (n + 2) - 0.5, 0.01, None)  # what a bit is worth above a guess
    scale = np.where(n.sum(axis=0) > 0, s.sum(axis=0) / np.maximum(n.sum(axis=0), 1), 1.0)
    return Coder(names, coder.code, coder.weights, right / right.sum(axis=1, keepdims=True), np.maximum(scale, 1e-9))


_GUESS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lead", T.DoubleType())])


def predict(texts: DataFrame, coder: Coder, text: str = "text", name: str = "_guess") -> DataFrame:
    """Add a struct ``name``: language, score, lead. Texts that are null or have no letter are ``und`` with score 0."""
    model = share(texts.sparkSession, coder)

    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: Coder = shared(model)
        for batch in batches:
            out = []
            for t in batch:
                if not t.is_valid or not known.languages:
                    out.append((UNKNOWN, 0.0, 0.0))
                else:
                    i, score, lead = known.decode(known.margins(cells(t.as_py())))
                    out.append((known.languages[i], score, lead))
            lang, score, lead = zip(*out, strict=True) if out else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(lead, pa.float64())], ["lang", "score", "lead"]
            )

    lettered = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    return texts.withColumn(name, F.arrow_udf(guess, _GUESS).asNondeterministic()(lettered))


def identify(
    docs: DataFrame, held_out_mod: int = 5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **kw
) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, ambiguous``.

    A document is held out if the CRC-32 of its id as text is divisible by ``held_out_mod`` (a null id counts as the
    empty string). The model learns from text and lang of the others, as far as both are there; predictions see only
    the text. Without any labelled text all is ``und``. Repeated rows count and come back as often as they are there.
    Empty texts and texts without a letter are ``und``. Other columns aren't read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % held_out_mod == 0
    train = rows.filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    coder = fit(train, **kw)
    guessed = predict(rows.select("doc_id", held.alias("held_out"), "text"), coder)
    return guessed.select(
        "doc_id",
        "held_out",
        F.col("_guess.lang").alias("lang_pred"),
        F.col("_guess.score").alias("score"),
        (F.col("_guess.lead") < LEAD).alias("ambiguous"),
    )
