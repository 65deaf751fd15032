"""Streams give the rows a batch run gives."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope import schemas
from leakscope.operators import detectors as D
from leakscope.operators.answers import run_metadata
from leakscope.streaming import jobs


@pytest.fixture
def token_files(tmp_path):
    rng = np.random.default_rng(2)
    folder = tmp_path / "in"
    folder.mkdir()

    def add(name, ids):
        rows = []
        for i in ids:
            p = rng.random(30 + i).tolist()
            rows.append({"model_id": f"m{i % 2}", "ID": str(i), "CATEGORY": "c", "LABEL_BINARY": i % 2, "token_probs": p,
                         "token_log_likes": np.log(p).tolist()})
        (folder / name).write_text(json.dumps(rows))

    add("a.json", range(5))
    return tmp_path, folder, add


@pytest.mark.parametrize("detector", ["minK", "ngram_loglike", "curve_slope"])
def test_stream_equals_batch(spark, token_files, detector):
    tmp, folder, add = token_files
    args = (spark, str(folder), str(tmp / "out"), str(tmp / "state"), detector, 0.05)
    jobs.stream_score(*args).awaitTermination()
    add("b.json", range(5, 9))
    jobs.stream_score(*args).awaitTermination()
    got = spark.read.parquet(str(tmp / "out")).orderBy("ID").collect()
    batch = jobs.score(
        spark.read.schema("model_id string, " + schemas.TOKEN_DATA).json(str(folder), multiLine=True),
        detector,
        0.05,
    ).orderBy("ID").collect()
    assert len(got) == 9 and got == batch
    assert {r["model_id"] for r in got} == {"m0", "m1"}


def test_a_slope_fires_at_its_threshold(spark):
    row = [("1", "c", 1, [0.5] * 8, [-0.5, -1.0, -1.5, -0.25, -0.5, -1.0, -2.0, -0.5])]
    kind = "ID string, CATEGORY string, LABEL_BINARY int, token_probs array<double>, token_log_likes array<double>"
    df = spark.createDataFrame(row, kind)
    for detector, fires in (("curve_slope", 1), ("minK", 0)):
        theta = jobs.score(df, detector, 0.0).first()["feature"]
        assert jobs.score(df, detector, theta).first()["PREDICTION_BINARY"] == fires


def test_row_local_slope_equals_the_curve_fit(spark, token_files):
    _, folder, _ = token_files
    tokens = spark.read.schema(schemas.TOKEN_DATA).json(str(folder), multiLine=True)
    direct = {r["ID"]: r["m"] for r in tokens.select("ID", jobs.slope_of_scores(F.col("token_log_likes")).alias("m")).collect()}
    spread = tokens.select("ID", F.posexplode("token_log_likes").alias("pos", "log_like"))
    for r in D.curve_features(D.curves(spread), "linear").collect():
        assert direct[r["ID"]] == pytest.approx(r["m_value"])


def test_running_metrics(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = {"model_id": "m", "method_name": "k"}
    (folder / "a.json").write_text("\n".join(json.dumps(line | {"output": o, "label": l}) for o, l in ((True, "1"), (True, "0"))))
    seen = []

    def sink(df, batch_id):
        seen.append(df.collect())

    args = (spark, str(folder), str(tmp_path / "state"), sink)
    jobs.stream_metrics(*args).awaitTermination()
    (folder / "b.json").write_text(json.dumps(line | {"output": False, "label": "false"}))
    jobs.stream_metrics(*args).awaitTermination()
    assert (seen[-1][0]["total"], seen[-1][0]["correct"]) == (3, 2)


def test_batch_metrics_count_each_line_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def line(ident, time, output, model="m", **more):
        return {"model_id": model, "method_name": "k", "ID": ident, "timestamp": time, "label": "1",
                "output": output, "parameters": {"a": "1"}} | more

    def run(name, *lines):
        (folder / name).write_text("\n".join(map(json.dumps, lines)))
        jobs.stream_batch_metrics(spark, str(folder), out, state, "1 hour").awaitTermination()
        found = jobs.metrics_so_far(spark, out).collect()
        return {r["model_id"]: (r["total"], r["correct"], r["last_batch"]) for r in found}

    first = line("1", "2024-01-01 10:00:00", True)
    got = run("a.json", first, first, line("2", "2024-01-01 10:05:00", False))
    assert got == {"m": (2, 1, 0)}
    # A line again in a later file, one with other parameters, and one that is late but not too late.
    got = run("b.json", first, first | {"parameters": {"a": "2"}}, line("3", "2024-01-01 09:30:00", True))
    assert got["m"][:2] == (4, 3)
    run("c.json", line("4", "2024-01-01 15:00:00", True))
    got = run("d.json", line("5", "2024-01-01 11:00:00", True), first, line("6", None, True, model=None))
    assert got["m"][:2] == (5, 4)  # too late, and known
    assert got[None][:2] == (1, 1)  # without a time: that of its file


def test_a_replayed_batch_of_metrics_changes_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = {"model_id": "m", "method_name": "k", "ID": "1", "timestamp": "2024-01-01 10:00:00", "label": "1"}
    (folder / "a.json").write_text(json.dumps(line | {"output": True}))
    out = str(tmp_path / "out")
    for state in ("state", "lost"):  # the second run starts over, as if its commit had been lost
        jobs.stream_batch_metrics(spark, str(folder), out, str(tmp_path / state)).awaitTermination()
    row = jobs.metrics_so_far(spark, out).first()
    assert (row["total"], row["correct"], row["accuracy"]) == (1, 1, 1.0)


def test_answer_stream_writes_each_batch_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"ID":"1","LLM_RESPONSE":"x"}\n{"ID":"2","LLM_RESPONSE":"y"}')
    source = spark.readStream.schema("ID string, LLM_RESPONSE string").json(str(folder))
    for _ in range(2):
        jobs.stream_answers(
            source, run_metadata("e", "d", {}), str(tmp_path / "out"), str(tmp_path / "state")
        ).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 2
