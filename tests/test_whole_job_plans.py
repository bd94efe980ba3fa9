"""Cases in which a query of the engine once did less than the whole job."""

import os

import pytest

import __spark_entry__ as entry
from tessera.plans.catalog import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_free_slots_of_more_than_25600(spark, tmp_path):
    for t in TABLES:
        if t != "part":
            os.symlink(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    ids = [k for k in range(30_020) if k % 1000 != 7]
    spark.createDataFrame([(k,) for k in ids], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    n = -(-len(ids) // 64)
    got = sorted((r.core, r.local) for r in entry.queries()["j7_free_slots"](spark, str(tmp_path)).collect())
    assert got == sorted((k // n, k % n) for k in set(range(64 * n)) - set(ids)) and max(got) > (25_600 // n, 25_600 % n)
