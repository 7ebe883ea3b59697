"""Registry of named queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import fixed
from .sql_parts import with_parts

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Runner
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, parts: Iterable[str] = (), digits: dict[str, int] | str = (), extra: Iterable[str] = ()) -> Callable:
    """Register a query.

    ``parts`` names the SQL building blocks the text refers to, ``extra`` holds CTE
    texts of this query alone. ``digits`` lists
    the computed DOUBLE columns, which are rounded alike on both sides.
    """
    places = {c: 6 for c in digits.split()} if isinstance(digits, str) else dict(digits)

    def register(fn: Runner) -> Runner:
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: fixed(df[c], n) for c, n in places.items()}) if places else df

        text = None
        if sql is not None:
            rounded = ", ".join(f"round({c}, {n}) + 0.0 AS {c}" for c, n in places.items())
            body = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if places else sql
            text = with_parts(parts, extra) + body
        REGISTRY[name] = Entry(run, text)
        return fn

    return register
