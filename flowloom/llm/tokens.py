"""Token ids of whole texts by a public tokenizer, and the exact histogram of encoded lengths.

A byte-level BPE with the usual pre-tokenizer never makes a token across the place before a blank that a visible
character follows, nor between letters and marks, nor around a single line feed. Texts are therefore cut there, each
distinct piece is encoded once by the tokenizer and kept in a store of the worker that is bounded in characters, and a
document's ids are the joined ids of its pieces. Texts that hold the string of an added token, and vocabularies with
other rules, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import running
from flowloom.llm.lm import release
from flowloom.session import materialise

#: Distinct pieces of a store. A worker has the current one and the one before, from which pieces in use move on.
STORE = 375_000
#: Characters of a piece that is still stored, and the mean over a full store at which it starts anew all the same.
LONG, MEAN = 64, 16
_UNSAFE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?!\s|\Z)")
#: ASCII marks; a run of them after letters is a token boundary of the pre-tokenizer.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file, which lies at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Store:
    """Ids by piece, of the pieces in use: when full, the store starts anew and keeps the old one to take over from.

    It is full at ``size`` pieces or ``MEAN`` times as many characters. Pieces over ``LONG`` characters aren't kept.
    """

    def __init__(self, size: int):
        self.size, self.chars = size, 0
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _turn(self) -> None:
        self.before, self.now, self.chars = self.now, {}, 0

    def get(self, piece: str) -> bytes | None:
        ids = self.now.get(piece)
        if ids is None and (ids := self.before.get(piece)) is not None:
            self.put(piece, ids)
        return ids

    def put(self, piece: str, ids: bytes) -> bytes:
        if len(piece) > LONG:
            return ids
        if len(self.now) >= self.size or self.chars >= MEAN * self.size:
            self._turn()
        self.now[piece] = ids
        self.chars += len(piece)
        return ids


def _signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary, as the library spells characters."""
    from tokenizers.pre_tokenizers import ByteLevel

    spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    points = [*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x10000, 0x400), *range(0x10000, 0x110000, 0x8000)]
    return {b: sign for p in points for b, sign in zip(chr(p).encode(), spell(chr(p))[0][0], strict=True)}


class Encoder:
    """Encodes texts to little-endian ids of ``width`` bytes, piece by piece if the vocabulary's rules allow it.

    The strings of added tokens (such as an end mark) become their own ids, as the library does it by default, or
    ordinary text if ``plain``.
    """

    def __init__(self, path: str, store: int = STORE, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.width = id_width(self.tokenizer.get_vocab_size())
        rules = json.loads(self.tokenizer.to_str())
        #: Strings that the library takes out before it splits a text.
        self.added = [t["content"] for t in rules.get("added_tokens", []) if not (plain and t["special"])]
        split = rules["pre_tokenizer"] or {}
        self.by_piece = (
            rules["normalizer"] is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space", False)
        )
        self.model, self.signs = self.tokenizer.model.tokenize, _signs()
        #: Pieces after a blank and words after a blank share a store, as most words are pieces too; pieces without a blank.
        self.tails = self.words = Store(store)
        self.heads = Store(store // 6)

    def _pack(self, ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(self.width, "little") for i in ids])

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _unit(self, text: str) -> bytes:
        """Ids of a text that the pre-tokenizer doesn't divide."""
        if text.isascii():  # signs of ASCII letters are the letters
            return self._pack([t.id for t in self.model(text.replace(" ", self.signs[32]))])
        return self._pack([t.id for t in self.model(text.encode().decode("latin-1").translate(self.signs))])

    def _head(self, piece: str) -> bytes:
        """Ids of a piece without a blank before it."""
        ids = self.heads.get(piece)
        if ids is None:
            word = piece.rstrip(_MARKS)
            if word.isalpha():
                ids = self._unit(word) + (self._head(piece[len(word) :]) if len(word) < len(piece) else b"")
            else:
                ids = self._whole(piece)
            self.heads.put(piece, ids)
        return ids

    def _tail(self, piece: str) -> bytes:
        """Ids of a blank and a piece, from the store or put together: of letters and then marks, also on several lines."""
        return self.tails.get(piece) or self.tails.put(piece, self._new_tail(piece))

    def _new_tail(self, piece: str) -> bytes:
        word = piece.rstrip(_MARKS)
        if word.isalpha():
            return self._unit(" " + piece) if word == piece else self._tail(word) + self._head(piece[len(word) :])
        if "\n" in piece:
            first, *lines = piece.split("\n")
            if all(lines) and not any(c.isspace() for c in "".join(lines)) and first and not first[-1].isspace():
                return self._tail(first) + b"".join([self._head("\n") + self._head(x) for x in lines])
        return self._whole(" " + piece)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_piece or any(t in text for t in self.added):
            return self._whole(text)
        first, *rest = _CUT.split(text) if _UNSAFE.search(text) else text.split(" ")
        ids = list(map(self.tails.now.get, rest))
        if None in ids:
            ids = [self._tail(piece) if known is None else known for piece, known in zip(rest, ids, strict=True)]
        return self._head(first) + b"".join(ids)


def id_width(vocabulary: int) -> int:
    """Bytes of an unsigned id: 2 if the vocabulary and its end id fit, else 4."""
    return 2 if vocabulary <= 1 << 16 else 4


def encoder(path: str, plain: bool = False, store: int = STORE) -> Encoder:
    """The worker's encoder for a vocabulary; later tasks of the worker go on with its store.

    It is kept with the tokenizers module, as this module travels by value and would be new in each task.
    """
    import tokenizers

    kept = vars(tokenizers).setdefault("_kept_encoders", {})
    if (path, plain, store) not in kept:
        kept[path, plain, store] = Encoder(path, store, plain)
    return kept[path, plain, store]


def forget() -> None:
    """Drop the worker's encoders with their stores (about 100 MB each): a worker outlives its query, and the next may not need them."""
    if (module := sys.modules.get("tokenizers")) is not None and vars(module).pop("_kept_encoders", None):
        release()


def token_count(path: str):
    """Arrow UDF: number of ids of a text, 0 for null."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path)
        for batch in batches:
            yield pa.array([len(enc.encode(t.as_py() or "")) // enc.width for t in batch], pa.int64())
        release()

    return F.arrow_udf(count, T.LongType()).asNondeterministic()


def length_histogram(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """One row per encoded length: ``n_tokens, docs, tokens`` and, from prefix and suffix sums over the lengths,

    ``docs_at_least, tokens_at_least`` (documents of that length or longer, and their tokens),
    ``docs_at_most, share_at_most`` (which answer quantiles) and ``truncated_total`` (tokens that stay if every
    document is cut at that length). Null and empty texts have length 0; every row counts, repeats included; an empty
    table gives no rows. Other columns aren't read.
    """
    lengths = docs.select(token_count(path)(F.col(text)).alias("n_tokens"))
    counts = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    below = running(counts, ["n_tokens"], {"docs_below": "docs", "tokens_below": "tokens"}, "lengths")
    below = materialise(below, "histogram")
    total = below.agg(F.sum("docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    out = below.join(F.broadcast(total))  # one row
    return out.select(
        "n_tokens",
        "docs",
        "tokens",
        (F.col("all_docs") - F.col("docs_below")).alias("docs_at_least"),
        (F.col("all_tokens") - F.col("tokens_below")).alias("tokens_at_least"),
        (F.col("docs_below") + F.col("docs")).alias("docs_at_most"),
        ((F.col("docs_below") + F.col("docs")) / F.col("all_docs")).alias("share_at_most"),
        (F.col("tokens_below") + F.col("n_tokens") * (F.col("all_docs") - F.col("docs_below"))).alias("truncated_total"),
    )


def limit_report(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: ``context_limit, docs, total_tokens, longer_docs, kept_tokens`` from a histogram.

    ``longer_docs`` are the documents above the limit, ``kept_tokens`` what is left when they are cut there. One pass
    over the histogram answers all limits; none has to be a length that occurs.
    """
    at = F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context_limit")
    return (
        histogram.select("n_tokens", "docs", at)
        .groupBy("context_limit")
        .agg(
            F.sum("docs").alias("docs"),
            F.sum(F.col("docs") * F.col("n_tokens")).alias("total_tokens"),
            F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("docs")).otherwise(0)).alias("longer_docs"),
            F.sum(F.col("docs") * F.least("n_tokens", "context_limit")).alias("kept_tokens"),
        )
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the least length that at least that share of the documents don't exceed."""
    at = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    reached = histogram.select("n_tokens", "share_at_most", at).filter(F.col("share_at_most") >= F.col("share"))
    return reached.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
