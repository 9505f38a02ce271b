"""Every query against its SQL in DuckDB, and those without SQL for rows."""

import pytest

from util import DATA, same

from contextloom import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["predict_embeddings", "train_ipca_events", "decompose_lineitem", "clustering_pipeline_events", "anomaly_pipeline_events", "online_offline_events"])
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_online_training_labels_every_row(spark):
    got = queries.QUERIES["online_offline_events"](spark, DATA)
    want = queries.QUERIES["seq_index_events"](spark, DATA)
    assert got.select("stream_key", "seq").distinct().count() == got.count() == want.count() and got.where("context_id is null").count() == 0
