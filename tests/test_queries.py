import duckdb
import pytest

from ridgeline import registry
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert not differences(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).limit(5).count() > 0


@pytest.mark.parametrize(("name", "size"), [("densify_5m", 1e12), ("error_metrics", 1e16)])
def test_sums_follow_the_track_not_the_file(spark, tmp_path, name, size):
    """Values so large that their sum depends on its order, in files in and against the track's order."""
    for path, order in (("along", ""), ("against", "DESC")):
        (tmp_path / path).mkdir()
        duckdb.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, 1::BIGINT AS user_id, i * 7919 % 1009 / 1009 * {size} AS value FROM range(501) r(i) ORDER BY i {order}) TO '{tmp_path}/{path}/events.parquet' (FORMAT parquet)")
    con = connect(tmp_path / "along")
    con.execute("SET threads = 1")
    for path in ("along", "against"):
        assert not differences(registry.queries()[name](spark, tmp_path / path), con, registry.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
