"""Every registered query of the classification engine against its DuckDB text."""

from __future__ import annotations

import pytest
from oracle import assert_same

import __spark_entry__
from neargrain import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, data, name):
    assert_same(catalogue.QUERIES[name](spark, data), catalogue.ORACLES[name], data)


@pytest.mark.parametrize("name", [
    "cosine_raw_topk", "cosine_shared_topk", "cosine_overlap_topk", "cosine_log_norm_topk", "neighbour_scores",
    "label_features", "label_features_per_occurrence", "ranks",
    "cosine_bounded_topk", "cosine_prefix_overlap_topk", "stored_index_topk",
])
def test_scores_equal_their_sql_on_more_rows(spark, name):
    data = "/root/testdata/sf0.01"
    assert_same(catalogue.QUERIES[name](spark, data), catalogue.ORACLES[name], data)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"lsh_neighbours"}


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["map", "mar", "maf"]
