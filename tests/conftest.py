import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from plumewalk import get_session

    return get_session("tests")


@pytest.fixture()
def few_rows(spark):
    """Forces the plans for hot keys."""
    spark.conf.set("spark.plumewalk.maxGroupRows", "5")
    yield
    spark.conf.unset("spark.plumewalk.maxGroupRows")
