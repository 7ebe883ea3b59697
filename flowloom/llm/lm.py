"""Language-model scores by deleted interpolation of word n-gram estimates.

The probability of a word after another is a mixture of the bigram and the unigram maximum-likelihood estimates and a
uniform one. The mixture weights depend on how often the context occurs and are learned by expectation-maximisation on
the counts of training documents that were left out of the estimates.

Counts cover all training documents and are exchanged between blocks of documents and ranges of hashed n-grams. A block
(documents of about a million words) sends its distinct n-grams once, sorted and packed; a range adds up what it gets
and answers each block with totals in the order of its question. So no model is ever held in one place: a range holds
its share of the n-grams, a block the counts of its own n-grams.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import parts, utf8
from flowloom.session import materialise

#: Words of a block; a longer document is a block of its own.
BLOCK_WORDS = 1 << 19
#: Distinct n-grams that a range should hold.
RANGE_KEYS = 1 << 21
#: Blocks that meet their answers in one task, about.
BLOCKS_PER_TASK = 8
#: CRC-32 of the id modulo MODULUS: HELD_OUT documents are never learnt from, DELETED ones set the mixture weights.
MODULUS, HELD_OUT, DELETED = 7, 2, 3
FIT, WEIGHT, HELD = 0, 1, 2
#: Context-frequency buckets (powers of two), and bins of a probability (quarter octaves) in the counts for EM.
BUCKETS, BINS = 48, 129
ROUNDS = 50
_CODEC = "zstd"
_EMPTY = b""  # the end token; no word is empty


def release() -> None:
    """Give freed memory back to the system: a worker outlives its task, and large arrays leave its heap in pieces."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def pack(a: np.ndarray) -> bytes:
    """Array to bytes, compressed byte plane by byte plane."""
    a = np.ascontiguousarray(a)
    return pa.Codec(_CODEC).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), asbytes=True) if len(a) else b""


def unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    if not n:
        return np.zeros(0, kind)
    raw = pa.Codec(_CODEC).decompress(data, decompressed_size=n * kind.itemsize)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


_BLOCK = "block long, n_docs int, n_tokens int, n_types int, doc_ids binary, nulls binary, roles binary, lengths binary, keys binary, ids binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents ``doc_id, role, text`` to blocks: per document id, role and length, and the tokens as local numbers.

    A word is numbered by its first appearance in the block; ``keys`` has the hash of each.
    """
    task, made = TaskContext.get().partitionId(), 0
    number: dict[bytes, int] = {}
    docs: list[tuple] = []
    tokens: list[np.ndarray] = []
    size = 0

    def block() -> pa.RecordBatch:
        ids = np.concatenate(tokens)
        keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
        row = {
            "block": (task << 24) + made,
            "n_docs": len(docs),
            "n_tokens": len(ids),
            "n_types": len(keys),
            "doc_ids": pack(np.array([d[0] or 0 for d in docs], np.int64)),
            "nulls": pack(np.array([d[0] is None for d in docs], np.uint8)),
            "roles": pack(np.array([d[1] for d in docs], np.uint8)),
            "lengths": pack(np.array([d[2] for d in docs], np.int32)),
            "keys": keys.tobytes(),
            "ids": pack(ids),
        }
        kinds = {"block": pa.int64(), "n_docs": pa.int32(), "n_tokens": pa.int32(), "n_types": pa.int32()}
        return pa.RecordBatch.from_pydict({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})

    for batch in batches:
        for doc_id, role, text in zip(batch["doc_id"], batch["role"], batch["text"], strict=True):
            words = text.as_py().lower().split()
            if docs and size + len(words) >= BLOCK_WORDS:
                yield block()
                number, docs, tokens, size, made = {}, [], [], 0, made + 1
            new = number.setdefault
            ids = [new(w, len(number)) for w in words]
            ids.append(new(_EMPTY, len(number)))
            tokens.append(np.array(ids, np.int32))
            docs.append((doc_id.as_py(), role.as_py(), len(ids)))
            size += len(ids)
    if docs:
        yield block()
    number, docs, tokens = {}, [], []
    release()


class Block:
    """A block's tokens with their contexts, and its distinct words and word pairs in the order of their hashes."""

    def __init__(self, row: dict):
        self.row = row
        n = row["n_docs"]
        self.roles, self.lengths = unpack(row["roles"], n, "u1"), unpack(row["lengths"], n, "i4")
        self.ids = unpack(row["ids"], row["n_tokens"], "i4").astype(np.int64)
        self.types = row["n_types"]
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.role = np.repeat(self.roles, self.lengths)
        self.context = np.empty_like(self.ids)
        self.context[1:] = self.ids[:-1]
        self.context[self.starts] = self.ids[self.ends - 1]  # a document begins after an end
        self.pairs, self.pair = np.unique(self.context * self.types + self.ids, return_inverse=True)

    def counts(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each number in ``at``: occurrences in training documents, and in those of them that estimates use."""
        return np.bincount(at[self.role != HELD], minlength=n), np.bincount(at[self.role == FIT], minlength=n)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        word = np.frombuffer(self.row["keys"], np.uint64)
        a, b = word[self.pairs // self.types], word[self.pairs % self.types]
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return word, x ^ (x >> np.uint64(31))


_QUESTION = "slot int, block long, n int, keys binary, used binary, fit binary"


def _questions(ranges: tuple[int, int]):
    """Function for mapInArrow: a row for each block and range of hashes that it has words or pairs in.

    Slots of words come before slots of pairs. ``ranges`` are the binary logarithms of the two numbers of ranges.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for order, (keys, at) in enumerate(zip(block.hashes(), (block.ids, block.pair), strict=True)):
                    used, fit = block.counts(at, len(keys))
                    by = np.argsort(keys, kind="stable")
                    yield _asked(row["block"], (1 << ranges[0]) * order, ranges[order], keys[by], used[by], fit[by])
                del block, keys, at, used, fit, by
        release()

    return ask


def _asked(block: int, base: int, bits: int, keys: np.ndarray, used: np.ndarray, fit: np.ndarray) -> pa.RecordBatch:
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    found, first = np.unique(slot, return_index=True)
    last = np.append(first[1:], len(keys))
    cuts = list(zip(first.tolist(), last.tolist(), strict=True))
    return pa.RecordBatch.from_pydict(
        {
            "slot": pa.array((found + base).astype(np.int32)),
            "block": pa.array([block] * len(cuts), pa.int64()),
            "n": pa.array([b - a for a, b in cuts], pa.int32()),
            "keys": pa.array([pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in cuts], pa.binary()),
            "used": pa.array([pack(used[a:b]) for a, b in cuts], pa.binary()),
            "fit": pa.array([pack(fit[a:b]) for a, b in cuts], pa.binary()),
        }
    )


_ANSWER = "slot int, block long, n long, used binary, fit binary, types long, total long, total_fit long"


def _answer(key: tuple, asked: pa.Table) -> pa.Table:
    """Totals of a range for each block in the order it asked, and one row (block -1) with the range's own figures."""
    rows = asked.to_pylist()
    size = [r["n"] for r in rows]
    keys = np.concatenate([np.cumsum(unpack(r["keys"], r["n"], "u8"), dtype=np.uint64) for r in rows])
    _, at = np.unique(keys, return_inverse=True)
    totals, sums = [], []
    for name in ("used", "fit"):
        one = np.concatenate([unpack(r[name], r["n"], "i8") for r in rows])
        whole = np.bincount(at, weights=one).astype(np.int64)  # exact below 2 ** 53
        totals.append(np.split(whole[at], np.cumsum(size)[:-1]))
        sums.append(whole)
    slot = rows[0]["slot"]
    m = len(rows)
    out = pa.table(
        {
            "slot": pa.array([slot] * (m + 1), pa.int32()),
            "block": pa.array([r["block"] for r in rows] + [-1], pa.int64()),
            "n": pa.array([*size, 0], pa.int64()),
            "used": pa.array([*map(pack, totals[0]), b""], pa.binary()),
            "fit": pa.array([*map(pack, totals[1]), b""], pa.binary()),
            "types": pa.array([0] * m + [int((sums[0] > 0).sum())], pa.int64()),
            "total": pa.array([0] * m + [int(sums[0].sum())], pa.int64()),
            "total_fit": pa.array([0] * m + [int(sums[1].sum())], pa.int64()),
        }
    )
    del rows, keys, at, totals, sums, one, whole
    release()
    return out


_RESOLVED = (
    "block long, n_docs int, n_tokens int, n_types int, n_pairs int, doc_ids binary, nulls binary, roles binary, "
    "lengths binary, keys binary, ids binary, used1 binary, fit1 binary, used2 binary, fit2 binary"
)


def _resolve(pair_slot: int):
    """Function for a cogrouped applyInArrow: a block and its answers to the block with the counts of its n-grams."""

    def resolve(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        block = Block(row)
        got = sorted(answers.to_pylist(), key=lambda r: r["slot"])
        out = {**row, "n_pairs": len(block.pairs), "keys": b""}
        for order, keys in enumerate(block.hashes(), 1):
            mine = [r for r in got if (r["slot"] >= pair_slot) == (order == 2)]
            by = np.argsort(keys, kind="stable")
            for name in ("used", "fit"):
                counts = np.empty(len(keys), np.int64)
                counts[by] = np.concatenate([unpack(r[name], r["n"], "i8") for r in mine])
                out[f"{name}{order}"] = pack(counts)
        kinds = {"block": pa.int64(), **{k: pa.int32() for k in ("n_docs", "n_tokens", "n_types", "n_pairs")}}
        names = [c.split()[0] for c in _RESOLVED.split(", ")]
        made = pa.table({k: pa.array([out[k]], kinds.get(k, pa.binary())) for k in names})
        del block, keys, by, counts, out
        release()
        return made

    return resolve


def _token_counts(row: dict, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of a block: counts of the token, of its context, and of both together."""
    block = Block(row)
    one = unpack(row[f"{name}1"], row["n_types"], "i8")
    two = unpack(row[f"{name}2"], row["n_pairs"], "i8")
    return one[block.ids], one[block.context], two[block.pair]


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else one more than the binary logarithm of the count."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def _bin(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(1 + np.floor(-4 * np.log2(np.maximum(p, 1e-300))), BINS - 1), 0).astype(np.int64)


def _share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    return n / np.maximum(of, 1)


def _events(total_fit: int):
    """Function for mapInArrow: tokens of the documents left out of the estimates, counted by bucket and both bins."""

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                word, context, pair = _token_counts(row, "fit")
                role = np.repeat(unpack(row["roles"], row["n_docs"], "u1"), unpack(row["lengths"], row["n_docs"], "i4"))
                at = role == WEIGHT
                p2, p1 = _share(pair[at], context[at]), word[at] / max(total_fit, 1)
                code, n = np.unique((_bucket(context[at]) * BINS + _bin(p2)) * BINS + _bin(p1), return_counts=True)
                yield pa.RecordBatch.from_pydict({"code": pa.array(code, pa.int64()), "n": pa.array(n, pa.int64())})
                del word, context, pair, role, at, p2, p1, code, n
        release()

    return events


def learn_weights(code: np.ndarray, n: np.ndarray, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """EM for the weights (bigram, unigram, uniform) of each context bucket, from counted held-out events.

    The bucket of unseen contexts gives the bigram no weight. A bucket without events, such as that of contexts which
    only pass a power of two in the counts of all training documents, takes the weights of the nearest lower one that
    has events. One event's worth of the uniform estimate is added to each bucket, so no text has probability zero.
    """
    bucket, bins = code // BINS**2, (code // BINS % BINS, code % BINS)
    p = np.stack([np.where(b > 0, 2.0 ** (-(b - 0.5) / 4), 0.0) for b in bins] + [np.full(len(code), 1 / (types + 1))], axis=1)
    weights = np.tile([1 / 3, 1 / 3, 1 / 3], (BUCKETS, 1))
    for _ in range(rounds):
        part = weights[bucket] * p
        part *= (n / part.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(bucket, part[:, k], BUCKETS) for k in range(3)], axis=1).astype(float)
        sums += np.array([0.0, float(types > 0), 1.0])
        weights = sums / sums.sum(axis=1, keepdims=True)
    seen = np.bincount(bucket, n, BUCKETS) > 0
    for b in range(2, BUCKETS):
        if not seen[b]:
            weights[b] = weights[b - 1]
    return weights


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(weights: np.ndarray, total: int, types: int):
    """Function for mapInArrow: a row with scores for each document of a block."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                word, context, pair = _token_counts(row, "used")
                n = row["n_docs"]
                lengths, roles = unpack(row["lengths"], n, "i4"), unpack(row["roles"], n, "u1")
                first = np.cumsum(lengths) - lengths
                w = weights[_bucket(context)]
                p = w[:, 0] * _share(pair, context) + w[:, 1] * word / max(total, 1) + w[:, 2] / (types + 1)
                base = np.log10((word + 1.0) / (total + types + 1.0))
                ids, nulls = unpack(row["doc_ids"], n, "i8"), unpack(row["nulls"], n, "u1").astype(bool)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(ids, pa.int64(), mask=nulls),
                        "held_out": pa.array(roles == HELD),
                        "n_tokens": pa.array(lengths.astype(np.int64)),
                        "n_known": pa.array(np.add.reduceat((word > 0).astype(np.int64), first)),
                        "train_tokens": pa.array(np.full(n, total, np.int64)),
                        "base_score": pa.array(np.add.reduceat(base, first)),
                        "score": pa.array(np.add.reduceat(np.log10(p), first)),
                    }
                )
                del word, context, pair, w, p, base
        release()

    return score


def role(doc_id: str) -> Column:
    """HELD, WEIGHT or FIT by the CRC-32 of the id as text; a null id counts as the empty string."""
    rest = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % MODULUS
    return F.when(rest == HELD_OUT, HELD).when(rest == DELETED, WEIGHT).otherwise(FIT).cast("int")


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A-Z is lower-cased; tokens are the words and one end. ``base_score`` is the add-one unigram log10 probability,
    ``score`` that of the mixture, with counts of all training documents. Null and empty texts are the end alone.
    Repeated rows count and are scored singly. Words are told apart by 64-bit hashes. Without training documents the
    counts are zero and only the uniform estimate is left. An empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), role(doc_id).alias("role"), utf8(F.col(text)).alias("text"))
    blocks = materialise(rows.mapInArrow(_blocks, _BLOCK), "lm-blocks")
    long_sum = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    words, types, n_blocks = blocks.agg(long_sum("n_tokens"), long_sum("n_types"), F.count(F.lit(1))).first()
    bits = tuple(max(0, int(np.ceil(np.log2(max(1, n / RANGE_KEYS, parts(spark) / 2))))) for n in (types, words))
    # Tasks grow in number with the data, not in size: about a range of hashes each, then a few blocks each.
    asked = blocks.mapInArrow(_questions(bits), _QUESTION).repartition(max(parts(spark), sum(1 << b for b in bits)), "slot")
    answers = materialise(asked.groupBy("slot").applyInArrow(_answer, _ANSWER), "lm-answers")
    pair_slot = 1 << bits[0]
    figures = answers.filter((F.col("block") == -1) & (F.col("slot") < pair_slot)).agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "total", "total_fit")]
    )
    vocabulary, total, total_fit = figures.first()
    told = answers.filter("block >= 0").select("slot", "block", "n", "used", "fit")
    tasks = max(parts(spark), -(-n_blocks // BLOCKS_PER_TASK))
    asking, answered = (t.repartition(tasks, "block").groupBy("block") for t in (blocks, told))
    resolved = asking.cogroup(answered).applyInArrow(_resolve(pair_slot), _RESOLVED)
    resolved = materialise(resolved, "lm-resolved")
    events = resolved.mapInArrow(_events(total_fit), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counted = events.toArrow()  # at most BUCKETS * BINS * BINS rows
    weights = learn_weights(counted["code"].to_numpy(), counted["n"].to_numpy(), vocabulary)
    return resolved.mapInArrow(_scores(weights, total, vocabulary), _SCORED)
