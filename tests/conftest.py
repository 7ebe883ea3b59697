from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from flowloom.session import clear_scratch, local_session, materialise  # noqa: E402
from flowloom.sources import fixtures as fx  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    yield session
    clear_scratch(session)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def od(spark):
    return materialise(fx.od_batch(spark, SF), "od")


@pytest.fixture(scope="session")
def base(spark):
    return materialise(fx.base_od(spark, SF), "base")


@pytest.fixture(scope="session")
def dist(spark):
    from flowloom.operators.spatial import distances

    return materialise(distances(fx.zones(spark, SF), 25), "dist")
