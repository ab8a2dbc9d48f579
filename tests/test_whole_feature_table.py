"""The queries over all features leave none out; tests/test_catalog.py holds their values against SQL."""

import os

import pytest
from pyspark.sql import types as T

import __spark_entry__ as E
from domlens.plans.catalog_profile import TLS_FEATURES
from domlens.plans.records import KEYS

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("name", ["P17_fill_missing_all", "P19_sigmoid_all"])
def test_all_columns_of_the_feature_table(spark, name):
    fields = E.queries()["X1_feature_pipeline"](spark, SF).schema.fields
    want = {f.name for f in fields if f.name not in KEYS and isinstance(f.dataType, (T.NumericType, T.BooleanType))}
    assert len(want) > 150
    assert want == set(E.queries()[name](spark, SF).columns) - set(KEYS)


def test_all_pairs_of_features(spark):
    rows = E.queries()["A6_feature_correlations"](spark, SF).collect()
    names = {*TLS_FEATURES, "label_code"}
    assert {(r["feature_a"], r["feature_b"]) for r in rows} == {(a, b) for a in names for b in names}
