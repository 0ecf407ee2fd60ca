"""The checkpoint folder on a cluster: a mounted folder is tried, not refused by its name."""

import glob

import pytest

from tracefuse import session
from tracefuse.plans.queries import log_preview, manifest_parse, roc_points, stratified_split, window_metrics

QUERIES = [roc_points, stratified_split, window_metrics, manifest_parse, log_preview]


@pytest.fixture
def on_cluster(spark, monkeypatch):
    """The session under the name of a cluster's master; its folder is a ``file:`` path all its tasks share."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_SHARED", set(), raising=False)
    session.ensure_checkpoint_dir(spark)
    return spark


@pytest.fixture
def tables(spark, tmp_path):
    spark.range(60).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "CAST(id % 3 = 0 AS INT) AS toxic") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(60).selectExpr(
        "id AS event_id", "TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS ts", "id % 5 AS user_id",
        "element_at(array('signup', 'view', 'purchase'), CAST(id % 3 AS INT) + 1) AS event_type", "1.0D AS value") \
        .write.parquet(f"{tmp_path}/events.parquet")
    spark.range(40).selectExpr("id AS page_id", "concat('http://a/', id) AS url", "'' AS html") \
        .write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__name__)
def test_queries_run_on_a_mounted_checkpoint_folder(spark, tables, query, request):
    expected = sorted(map(str, query(spark, tables).collect()))
    spark = request.getfixturevalue("on_cluster")
    assert expected and sorted(map(str, query(spark, tables).collect())) == expected


def test_the_folder_is_tried_once(on_cluster, monkeypatch):
    folder = session.ensure_checkpoint_dir(on_cluster)
    assert folder.startswith("file:") and session._SHARED == {(on_cluster.sparkContext.applicationId, folder)}
    assert not glob.glob(f"{folder.removeprefix('file:')}/shared-*")
    monkeypatch.setattr(on_cluster, "range", lambda *a: pytest.fail("tried again"))
    assert session.ensure_checkpoint_dir(on_cluster) == folder


def test_a_folder_of_each_machine_is_refused(on_cluster, monkeypatch):
    monkeypatch.setattr(session, "_SHARED", set())
    whole = on_cluster.range  # one of the files stays on another machine
    monkeypatch.setattr(on_cluster, "range", lambda start, end, step, parts: whole(start, end - 1, step, parts))
    with pytest.raises(RuntimeError, match="shared file system, not file:"):
        session.ensure_checkpoint_dir(on_cluster)
    assert not session._SHARED


def test_a_cluster_without_the_setting_is_an_error(on_cluster, monkeypatch):
    monkeypatch.setattr(on_cluster.sparkContext, "getCheckpointDir", lambda: None)
    monkeypatch.setattr(on_cluster.sparkContext, "getConf", dict)
    with pytest.raises(RuntimeError, match="must name a shared folder"):
        session.ensure_checkpoint_dir(on_cluster)
