import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from domlens.session import get_session
    s = get_session(master="local[4]", **{"spark.sql.shuffle.partitions": "4"})
    yield s


@pytest.fixture(scope="session")
def rules(spark):
    from domlens.functions.domain import load_suffix_rules
    return load_suffix_rules(spark)
