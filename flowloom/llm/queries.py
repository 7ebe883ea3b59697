"""Registered queries of this subpackage and their SQL twins, where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.alignment import alignment
from flowloom.llm.centroids import cluster
from flowloom.llm.common import table
from flowloom.llm.decontaminate import contamination
from flowloom.llm.exact_dedup import exact_dedup
from flowloom.llm.lm import lm_scores
from flowloom.llm.mixing import mixture
from flowloom.llm.language import identify
from flowloom.llm.packing import pieces_of
from flowloom.llm.pii import personal_data
from flowloom.llm.quality import classify
from flowloom.llm.simhash import near_duplicates
from flowloom.llm.token_files import write_tokens
from flowloom.llm.tokens import length_histogram, vocabulary_path

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query(
    "op9_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM d
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op10_decontamination",
    f"""
    WITH d AS (SELECT doc_id, {_TERMS.format("coalesce(text, '')")} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TERMS.format("coalesce(text, '')")} AS w FROM benchmark),
    g AS (SELECT DISTINCT item, least(10, len(w)) AS n, w[i : i + least(10, len(w)) - 1] AS gram
          FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM g),
    windows AS (SELECT doc_id, n, i, w[i : i + n - 1] AS gram
                FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
    hits AS (SELECT doc_id, i, n, item FROM windows JOIN g USING (n, gram)),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
              FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op4_mixing",
    r"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
               FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight FROM s),
    -- Sources in the order in which a rising level meets their caps.
    o AS (SELECT *, sum(3 * source_size) OVER q AS capped, sum(weight) OVER q AS gone,
                 sum(source_size) OVER () AS whole, sum(weight) OVER () AS weights
          FROM w WINDOW q AS (ORDER BY source_size / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
    -- The last of them that is capped: its cap is at most its share of what the earlier ones leave.
    c AS (SELECT coalesce(max(capped), 0) AS capped, coalesce(max(gone), 0) AS gone FROM o
          WHERE 3 * source_size * (weights - gone + weight) <= (whole - capped + 3 * source_size) * weight),
    t AS (SELECT source, o.source_size,
                 CASE WHEN o.gone <= c.gone THEN CAST(3 * o.source_size AS DOUBLE)
                      ELSE CAST((whole - c.capped) * weight AS DOUBLE) / CAST(weights - c.gone AS DOUBLE) END AS target
          FROM o, c),
    r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                 CAST(('0x' || md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:13]) AS BIGINT)
                   / CAST(4503599627370496 AS DOUBLE) AS u
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM r
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


@query("op8_lm_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))

def _cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """SQL for the clustering: one pair of tables per round, as a recursive one can't be grouped by."""
    far = "CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    parts = [
        """kept AS MATERIALIZED (
             SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
             FROM embeddings
             WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
             SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c
             FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, v FROM kept) ORDER BY h, v LIMIT {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
             SELECT r, vec_id, v, cluster, far FROM (SELECT r, vec_id, v, cluster, {far} AS far FROM kept, c{i})
             QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, cluster) = 1)"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (
             WITH s AS (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                        FROM (SELECT cluster, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{i}) GROUP BY cluster, i),
             m AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s GROUP BY cluster)
             SELECT cluster, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN m USING (cluster))"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
        SELECT vec_id, CAST(cluster AS INT) AS cluster, far AS distance,
               CAST(sum(far) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (cluster)"""
    )


@query("op13_centroids", _cluster_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


@query("op11_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_of(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))
