"""Streams against the batch operators."""

import numpy as np
import pytest

from tempora.functions.statespace import local_level_smooth
from tempora.streaming.measures import local_level_filter, realized_variance


def files(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"k{i % 2}", i, float(v)) for i, v in enumerate(np.cumsum(rng.standard_normal(60)))]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], "g string, s long, y double").selectExpr("g", "timestamp_seconds(s * 3600) AS t", "y").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema("g string, t timestamp, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(query, name, mode):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_local_level(spark, tmp_path):
    rows, stream = files(spark, tmp_path)
    run(local_level_filter(stream, "t", "y", "g", 1.0, 0.5), "levels", "append")
    out = spark.sql("SELECT g, max_by(level, t) AS level, max_by(loglik, t) AS ll FROM levels GROUP BY g").collect()
    for r in out:
        want = local_level_smooth(np.array([y for g, _, y in rows if g == r.g]), 1.0, 0.5)
        assert r.level == pytest.approx(want["filtered_state"][-1]) and r.ll == pytest.approx(want["loglik"])


def test_realized_variance(spark, tmp_path):
    rows, stream = files(spark, tmp_path)
    run(realized_variance(stream, "t", "y", "g"), "rv", "complete")
    got = {(r.g, r.day): r.rv for r in spark.sql("SELECT g, cast(window.start AS date) AS day, rv FROM rv").collect()}
    assert sum(got.values()) == pytest.approx(sum(y * y for _, _, y in rows)) and len(got) == 6
