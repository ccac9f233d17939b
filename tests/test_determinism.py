"""The same input gives the same rows, whatever the partitioning; every query has a name of its own and a stable schema."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the small tables")


@pytest.mark.parametrize("name", ["ranked_findings", "stratified_sample", "p6_report", "robots_decisions"])
def test_partitioning_does_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, entry.queries()[name](spark, SMALL).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and results[0]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_workers_need_no_path(tmp_path):
    """A session whose workers cannot see the repository runs a query that needs the package there."""
    import subprocess
    import sys

    code = f"import sys; sys.path.insert(0, {os.path.dirname(os.path.abspath(entry.__file__))!r}); import __spark_entry__ as e; from sitewarp.session import local_session; print('rows', e.queries()['p5_found'](local_session(2), {SMALL!r}).count())"
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=120)
    assert "rows " in done.stdout, done.stderr[-500:]
