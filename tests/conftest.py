from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from facetry.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def sample_reviews(spark):
    return spark.createDataFrame(
        [
            ("Awful zipper on this tent. Good pockets, though!", 2, "2025-11-04", "Dome 3"),
            ("Our guide hated the poles. We love the awning.", 4, "2025-11-23", "Dome 3"),
            ("The refund came within a day", 5, "2025-12-09", "Tarp"),
        ],
        "text string, rating int, date string, product string",
    )


@pytest.fixture
def one(spark):
    """Evaluate a column function on single values."""
    def run(build, *values, schema="string"):
        names = [f"v{i}" for i in range(len(values))]
        kinds = schema if isinstance(schema, list) else [schema] * len(values)
        frame = spark.createDataFrame(
            [tuple(values)], ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
        )
        return frame.select(build(*[frame[n] for n in names]).alias("out")).first()["out"]

    return run
