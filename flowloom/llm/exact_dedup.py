"""Exact de-duplication with a separate path for heavy hitters, in DataFrame operations only.

A Misra-Gries summary names the digests that may be frequent, an exact count verifies them, and the winners of the
verified ones are broadcast, so that a document of a huge group finds its winner where it lies. All other digests are
shuffled; none of them can hold more than a ``1 / tracked`` share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.session import materialise

#: Digests that the summary returns, and counters that it keeps. The broadcast table has at most HEAVY rows of 60 bytes.
HEAVY = 256
TRACKED = 4096


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, _row, _digest``: SHA-256 of the text's UTF-8 bytes; a null text counts as empty.

    ``_row`` tells rows with one doc_id apart; it is fixed by writing the table.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.monotonically_increasing_id().alias("_row"),
            F.unhex(F.sha2(content, 256)).alias("_digest"),
        ),
        "digests",
    )


def frequent(rows: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """Candidates for frequent digests: ``_digest``, at most ``heavy`` rows, from a Misra-Gries summary.

    Every digest with more than ``rows / heavy`` copies is among them; rarer ones may be.
    """
    key = F.hex("_digest")  # the summary takes strings, not binary
    top = rows.agg(F.call_function("approx_top_k", key, F.lit(heavy), F.lit(tracked)).alias("top"))
    return top.select(F.explode("top.item").alias("key")).select(F.unhex("key").alias("_digest"))


def groups(rows: DataFrame) -> DataFrame:
    """Winner and size of each digest; partial sums leave one row per digest and task."""
    return rows.groupBy("_digest").agg(
        F.max(F.struct("doc_id", "_row")).alias("_winner"), F.count(F.lit(1)).alias("group_size")
    )


def exact_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY, tracked: int = TRACKED
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest doc_id stays. Null texts equal the empty one. A null doc_id is smaller
    than any other. Rows repeated with one doc_id count singly and exactly one row of a group has ``kept``, also in a
    tie. An empty table gives an empty result. Other columns are not read.
    """
    rows = digests(docs, doc_id, text)
    candidates = materialise(frequent(rows, heavy, tracked), "candidates")
    # Verified: exact figures, and only digests that do repeat.
    verified = groups(rows.join(F.broadcast(candidates), "_digest", "left_semi")).filter("group_size > 1")
    verified = materialise(verified, "heavy")
    found = rows.join(F.broadcast(verified), "_digest", "left")
    hot = found.filter(F.col("group_size").isNotNull())
    rest = rows.join(F.broadcast(verified.select("_digest")), "_digest", "left_anti")
    settled = hot.unionByName(rest.join(groups(rest), "_digest"))
    return settled.select(
        "doc_id",
        F.col("_winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_winner._row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
