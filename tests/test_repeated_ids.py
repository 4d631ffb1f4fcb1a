"""Candidates that share an id: as many rows as the check SQL gives."""

import os
import shutil

import pytest
from conftest import SMALL
from oracle_check import compare, connect
from pyspark.sql import functions as F

from sitefit.catalog import load


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The small tables with every fiftieth lineitem once more: another part and price, the same candidate id."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    for name in os.listdir(SMALL):
        if name != "lineitem.parquet":
            shutil.copy(f"{SMALL}/{name}", folder)
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    again = rows.filter("l_orderkey % 50 = 0").withColumn("l_partkey", F.col("l_partkey") + 1).withColumn("l_extendedprice", F.col("l_extendedprice") - 0.07)
    rows.unionByName(again).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    part = next(n for n in os.listdir(f"{folder}/lineitem.parquet") if n.endswith(".parquet"))
    shutil.copy(f"{folder}/lineitem.parquet/{part}", f"{folder}/copy")
    shutil.rmtree(f"{folder}/lineitem.parquet")
    os.rename(f"{folder}/copy", f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["score_features", "heuristic_score", "weak_labels"])
def test_rows_of_repeated_ids(spark, repeated, name):
    queries, oracles = load()
    ok, text = compare(queries[name](spark, repeated), connect(repeated), oracles[name])
    assert ok, text
