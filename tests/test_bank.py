import itertools

import pytest

from spindrift.operators import bank as B
from spindrift.plans import QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["range_search_l1", "j3_j4_fallback", "j22_w11_dual_range", "a12_j11_prototypes"])
def test_a_bank_too_large_to_gather_gives_the_same(spark, monkeypatch, name):
    want = rows(QUERIES[name](spark, SF))
    monkeypatch.setattr(B, "MOST_ROWS", 2)
    assert rows(QUERIES[name](spark, SF)) == want


def test_results_do_not_depend_on_partitions(spark):
    for name in ("range_search_l1", "a20_anchor_graph", "t9_refractory"):
        found = set()
        for n in (1, 7, 32):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.add(tuple(rows(QUERIES[name](spark, SF))))
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert len(found) == 1


def test_workers_find_the_package():
    """From another folder, with the package on the driver's path alone."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r})\nfrom pyspark.sql import SparkSession\ns = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\nimport __spark_entry__ as e\nprint('ROWS', e.queries()['e2_counter'](s, {SF!r}).count(), e.entry(s).count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd="/tmp", env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


def test_query_names_have_operators(spark):
    ids = set(itertools.chain.from_iterable(f.__doc__.split(":")[0].replace(" to ", ", ").split(", ") for f in QUERIES.values()))
    assert {"Q1", "J1", "W2", "A4", "R1", "T9", "E16", "G1", "M2", "F13"} <= ids
