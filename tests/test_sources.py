"""Readers, logs, reports, sinks and stage tables on small hand-written files."""

import json

import pytest
from pyspark.sql import functions as F

from leakscope.functions import text as X
from leakscope.operators import answers as AN
from leakscope.operators import report as R
from leakscope.plans import tuning
from leakscope.sources import logs as L
from leakscope.sources import readers, stages


def test_log(model, method, matrix, b, c, p, parameter, **extra):
    (tn, fp), (fn, tp) = matrix
    n = tn + fp + fn + tp
    return {
        "model_id": model, "data_name": "d", "datetime": "2025-01-01T00:00:00", "method_name": method,
        "parameter": parameter,
        "metrics": {
            "accuracy": (tn + tp) / n, "accuracy_95CI": [0.4, 0.8], "precision": tp / (tp + fp),
            "recall": tp / (tp + fn), "f1_score": 2 * tp / (2 * tp + fp + fn),
            "confusion_matrix": matrix, "mcnemar_b": b, "mcnemar_c": c, "mcnemar_p_value": p,
        },
        "n_bootstrap": 1000, "seed": 42, **extra,
    }


test_log.__test__ = False


def entry(method, parameter, test, train, thresholds, theta):
    out = {
        "method": method, "parameter": parameter, "all_cvacc_test": test, "all_cvacc_train": train,
        "all_thresholds": thresholds, "mean_cvacc_test": sum(test) / len(test),
    }
    if theta is not None:
        out["global_threshold"] = theta
    return out


@pytest.fixture(scope="module")
def log_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    a, b = root / "org" / "m1" / "minK", root / "org" / "m2" / "minK"
    a.mkdir(parents=True)
    b.mkdir(parents=True)
    (a / "x_test_log_overleaf2.json").write_text(
        json.dumps(
            test_log("org/m1", "minK", [[8, 7], [4, 11]], 8, 4, 0.3876953125,
                     {"parameter1": 5, "parameter2": None, "theta": "0.001723"}),
            indent=2,
        )
    )
    short = test_log("m2", "CDD", [[5, 10], [5, 10]], 5, 5, 1.0, {"parameter1": 0.2, "theta": "0.08"})
    del short["metrics"]["accuracy_95CI"]
    (b / "x_test_log_overleaf2.json").write_text(json.dumps(short))
    twice = json.dumps(test_log("m2", "pair", [[5, 10], [5, 10]], 5, 5, 1.0, {}))
    (b / "y_test_log_overleaf2.json").write_text(twice + "\n" + twice)
    (b / "z_test_log_overleaf2.json").write_text('{"model_id": "cut off"')

    def train(model, shift):
        return {
            "model_id": model, "data_set": "d", "datetime": "t", "method_name": "minK",
            "parameter_range": {"k": "[5, 10]"}, "CV_folds": 2, "CV_seed": 42,
            "all_log_entries": [
                entry("minK", {"k": 5}, [0.5, 0.7 + shift], [0.8, 0.6], [0.1, 0.3], 0.2),
                entry("minK", {"k": 10}, [0.6, 0.6 + shift], [0.7, 0.7], [0.0, 0.0], 0.0),
                entry("minK", {"k": 99}, [0.9, 0.9], [0.9, 0.9], [0.5, 0.5], None),
                entry("ContaTraces", {"fit": "exponential"}, [0.4, 0.6], [0.6, 0.6],
                      [[1.0, 0.2], [2.0, 0.4]], [1.5, 0.3]),
            ],
        }

    for folder, model, shift in ((a, "org/m1", 0.0), (b, "m2", 0.1)):
        (folder / "x_train_full_accuracylog_overleaf2.json").write_text(json.dumps(train(model, shift)))
    return str(root)


def test_broken_files_are_skipped_or_split(spark, log_root):
    files = L.find_logs(spark, log_root, "*test*overleaf2.json")
    assert files.count() == 4
    assert L.read_test_logs(spark, log_root, "*test*overleaf2.json").count() == 2
    split = L.read_test_logs(spark, log_root, "*test*overleaf2.json", on_corrupt="split")
    assert split.where("method_name = 'pair'").count() == 2
    with pytest.raises(ValueError):
        L.read_documents(files, "guess")


def test_flatten_test_logs(spark, log_root):
    flat = {r["model_id"]: r for r in R.flatten_test_logs(L.read_test_logs(spark, log_root, "*test*overleaf2.json")).collect()}
    one, two = flat["org/m1"], flat["m2"]
    assert one["method_name_with_param"] == "minK_parameter1=5_parameter2=None_theta=0.001723"
    assert two["method_name_with_param"] == "CDD_parameter1=0.2_theta=0.08"
    assert (one["accuracy_95CI_lower"], one["accuracy_95CI_upper"]) == (0.4, 0.8)
    assert two["accuracy_95CI_lower"] is None
    assert one["confusion_matrix"] == [[8, 7], [4, 11]] and one["param_theta"] == "0.001723"


def test_stored_metrics_follow_from_the_matrix(spark, log_root):
    from leakscope.functions.probability import mcnemar_exact

    logs = L.read_test_logs(spark, log_root, "*test*overleaf2.json")
    m = F.col("metrics.confusion_matrix")
    got = logs.select(
        "metrics.*", mcnemar_exact(m[0][0], m[1][0]).alias("p"),
        ((m[0][0] + m[1][1]) / 30).alias("acc"),
    ).collect()
    for r in got:
        assert r["p"] == pytest.approx(r["mcnemar_p_value"]) and r["acc"] == pytest.approx(r["accuracy"])


def test_flatten_train_logs(spark, log_root):
    logs = L.read_train_logs(spark, log_root, "*train*_accuracylog_overleaf2.json").where("model_id = 'org/m1'")
    flat = {r["method_name_with_param"]: r for r in R.flatten_train_logs(logs).collect()}
    k5, pair = flat["minK_k=5"], flat["ContaTraces_fit=exponential"]
    assert k5["mean_val_acc"] == pytest.approx(0.6) and k5["std_val_acc"] == pytest.approx(0.1)
    assert k5["global_threshold"] == [0.2] and k5["param_k"] == "5"
    assert pair["global_threshold"] == [1.5, 0.3]
    assert pair["mean_threshold"] == pytest.approx(0.9)
    assert flat["minK_k=10"]["global_threshold"] == [0.0]
    assert flat["minK_k=99"]["global_threshold"] is None
    compat = R.flatten_train_logs(logs, zero_is_null=True).where("method_name_with_param = 'minK_k=10'")
    assert compat.first()["global_threshold"] is None


def test_best_entries_take_the_first_maximum(spark, log_root):
    best = R.best_entries(R.flatten_train_logs(L.read_train_logs(spark, log_root, "*train*_accuracylog_overleaf2.json")).where("param_k != 99"))
    got = {(r["model_id"], r["method_name"]): r["method_name_with_param"] for r in best.collect()}
    assert got[("org/m1", "minK")] == "minK_k=5"


def test_summary_table_text(spark, log_root):
    flat = R.flatten_train_logs(L.read_train_logs(spark, log_root, "*train*_accuracylog_overleaf2.json"))
    rows = R.summary_table(flat).collect()
    assert [r["method_name_with_param"] for r in rows] == [
        "minK_k=10", "minK_k=5", "ContaTraces_fit=exponential", "baseline",
    ] or [r["method_name_with_param"] for r in rows] == [
        "minK_k=5", "minK_k=10", "ContaTraces_fit=exponential", "baseline",
    ]
    assert rows[-1]["m1"] == "0.5 ± 0.0" and rows[-1]["result"] == "0.5 ± 0.0"
    by = {r["method_name_with_param"]: r for r in rows}
    assert by["minK_k=5"]["m1"] == "0.6 ± 0.1"


def test_summary_table_numbers_and_order(spark, log_root):
    flat = R.flatten_train_logs(L.read_train_logs(spark, log_root, "*train*_accuracylog_overleaf2.json"))
    rows = R.summary_table(flat, "threshold", "train_accuracy", as_text=False, models=["m1", "m2"]).collect()
    assert rows[-1]["method_name_with_param"] == "baseline" and rows[-1]["m1_mean"] is None
    assert rows[0]["method_name_with_param"] in ("minK_k=10", "minK_k=5")
    by = {r["method_name_with_param"]: r for r in rows}
    assert by["minK_k=5"]["m1_mean"] == 0.2 and by["minK_k=5"]["result_std"] == 0.0
    up = R.summary_table(flat, as_text=False, models=["m1", "m2"], ascending=True).collect()
    assert up[-1]["method_name_with_param"] == "baseline"
    with pytest.raises(ValueError):
        R.summary_table(flat, "speed")
    with pytest.raises(ValueError):
        R.summary_table(flat, sort_by="threshold")


def test_accuracy_matrix(spark, log_root):
    flat = R.flatten_test_logs(L.read_test_logs(spark, log_root, "*test*overleaf2.json"))
    got = R.accuracy_matrix(flat, "model_id", "method_name", "accuracy", "accuracy_95CI_upper",
                            ["minK", "CDD", "Ensemble"])
    row = {r["model_id"]: r for r in got.collect()}
    assert row["org/m1"]["minK_ci"] == pytest.approx(0.8 - 19 / 30) and row["org/m1"]["CDD_accuracy"] is None
    assert "Ensemble_accuracy" not in got.columns


def test_token_and_generation_readers(spark, tmp_path):
    d = tmp_path / "m1"
    d.mkdir()
    item = {"ID": "1", "CATEGORY": "c", "PROBLEM": "p", "SOLUTION": "s", "LABEL": "Conta", "LABEL_BINARY": 1}
    (d / "tokens.json").write_text(json.dumps([item | {"token_probs": [0.5, 0.1], "token_log_likes": [-1, -2]}]))
    r = readers.read_token_data(spark, str(d / "tokens.json")).first()
    assert r["model_id"] == "m1" and r["token_probs"] == [0.5, 0.1]
    (d / "gen_samples50_max200_seed42.json").write_text(
        json.dumps([item | {"MAX_LENGTH": 2, "GREEDY_IDS": [1, 2], "SAMPLE_IDS": [[1], [2, 9, 3]]}])
    )
    r = readers.read_cdd(spark, str(d / "gen_samples50_max200_seed42.json")).first()
    assert (r["sample_size"], r["max_new_tokens"], r["gen_seed"]) == (50, 200, 42)
    (d / "ngram.json").write_text(json.dumps([item | {"NGRAM_GENERATION_DATA": {
        "2": {"TARGET_NGRAMS": [[1, 2]], "PREDICTED_NGRAMS": [[1, 3]], "START_POINTS": [5]}}}]))
    assert list(readers.read_ngram(spark, str(d / "ngram.json")).first()["NGRAM_GENERATION_DATA"]) == [2]
    (d / "ll.json").write_text(json.dumps([item | {"NGRAM_LOGLIKE_GENERATION_DATA": {
        "3": {"NGRAM_LOGLIKES": [-1.5], "DECODED_NGRAMS": [["a"]], "START_POINTS": [5]}}}]))
    got = readers.read_ngram_ll(spark, str(d / "ll.json")).first()["NGRAM_LOGLIKE_GENERATION_DATA"]
    assert got[3]["NGRAM_LOGLIKES"] == [-1.5]
    (d / "cdd.json").write_text(json.dumps([item | {"NGRAM_CDD_GENERATION_DATA": {
        "10": {"starttoken": [4], "cdd_generation_data": [
            {"GREEDY_IDS": [1, 9], "SAMPLE_IDS": [[1, 100257, 7], [2]], "MAX_LENGTH": 3}]}}}]))
    nested = readers.truncate_nested(readers.read_ngram_cdd(spark, str(d / "cdd.json")), 100257)
    row = readers.ngram_cdd_long(nested).first()
    assert (row["n"], row["start"]) == (10, 4) and row["SAMPLE_IDS"] == [[1, 100257], [2]]


def test_tables_and_sinks(spark, tmp_path):
    for m in ("a", "b"):
        p = tmp_path / "scores" / f"MODEL_SHORT={m}"
        p.mkdir(parents=True)
        (p / "s.csv").write_text("ID,CATEGORY,DIFFICULTY_SCORE_A,LABEL,CORRECTNESS\n1,c,2,Conta,1\n,c,2,Clean,0\n")
    got = readers.read_correctness(spark, str(tmp_path / "scores"))
    assert sorted(r["MODEL_SHORT"] for r in got.collect()) == ["a", "b"]
    (tmp_path / "l.jsonl").write_text('{"model_id":"m","output":true,"label":"1"}\n\n{"model_id":"m","output":false}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "l.jsonl")).count() == 2
    for i in (1, 2):
        (tmp_path / f"part{i}.json").write_text(json.dumps([{"ID": str(i)}]))
    L.merge_files(spark, [str(tmp_path / "part1.json"), str(tmp_path / "part2.json")], str(tmp_path / "m"), "ID string")
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    L.write_report(got, str(tmp_path / "rep"))
    L.write_rows(got, str(tmp_path / "rows"))
    L.write_rows(got, str(tmp_path / "rows"))
    assert spark.read.csv(str(tmp_path / "rep"), header=True).count() == 2
    assert spark.read.json(str(tmp_path / "rows")).count() == 4


def test_write_log_appends_readable_records(spark, tmp_path):
    df = spark.createDataFrame([(0.2, 0), (0.9, 1), (0.7, 1)], "f double, LABEL_BINARY int")
    for _ in range(2):
        L.write_log(tuning.evaluate(df, "f", 0.5, "org/m", "d", "minK", "5", draws=50), str(tmp_path / "log"))
    back = L.read_test_logs(spark, str(tmp_path / "log"), "*.json")
    assert back.count() == 2 and back.first()["metrics"]["confusion_matrix"] == [[1, 0], [0, 2]]
    assert {(r["model_id"], r["method_name"]) for r in back.collect()} == {("org/m", "minK")}


def test_materialize(spark, tmp_path):
    calls = []

    def build(v):
        def run():
            calls.append(v)
            return spark.createDataFrame([(v,)], "x int")

        return run

    args = (spark, str(tmp_path), "stage")
    assert stages.materialize(*args, {"model_id": "a"}, build(1)).first()["x"] == 1
    assert stages.materialize(*args, {"model_id": "a"}, build(2)).first()["x"] == 1
    assert stages.materialize(*args, {"model_id": "b"}, build(3)).first()["x"] == 3
    assert stages.materialize(*args, {"model_id": "a"}, build(4), force=True).first()["x"] == 4
    assert stages.materialize(*args, {"model_id": "b"}, build(5)).first()["x"] == 3
    assert calls == [1, 3, 4]


def test_answer_files_round_trip(spark, tmp_path):
    rows = [(str(i), i) for i in range(7)]
    df = spark.createDataFrame(rows, "ID string, row_idx long").selectExpr(
        "ID", "row_idx", "'q' as PROBLEM", "'c' as CATEGORY", "'Conta' as LABEL", "'p' as prompt",
        "'k' as EXTRACTED_ANSWER", "'s' as SOLUTION", "'r' as response", "'t0' as start_time", "'t1' as end_time",
    )
    record = AN.answer_record(df, "prompt", "response").join(df.select("ID", "row_idx"), "ID")
    L.write_answers(record, AN.run_metadata("e", "d", {"hardware": "cpu"}), str(tmp_path / "out"), 3)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["rows=0-2", "rows=3-5", "rows=6-6"]
    back = readers.read_answers(spark, str(tmp_path / "out"))
    assert sorted(r["ID"] for r in back.collect()) == [str(i) for i in range(7)]


def test_prompts(spark):
    df = spark.createDataFrame(
        [(i, "c", f"q{i}", f"a{i}", "x" if i == 0 else "") for i in range(5)],
        "ID int, CATEGORY string, PROBLEM string, SOLUTION string, EXTRACTED_ANSWER string",
    )
    rows = {r["ID"]: r for r in AN.add_prompts(df, 2, "EleutherAI/llemma_7b", "ID").collect()}
    assert rows[0]["shot_ids"] == ["3", "4"] and rows[4]["shot_ids"] == ["0", "1"]
    assert rows[4]["formatted_prompt"][0]["content"] == (
        "Q: q0 Let's think step by step.\nA: a0\nThe final answer is \\boxed{x}.\n\n"
        "Q: q1 Let's think step by step.\nA: a1\n\nQ: q4 Let's think step by step.\nA:"
    )
    chat = AN.add_prompts(df, 1, "deepseek-math", "ID").where("ID = 2").first()["formatted_prompt"]
    assert [t["role"] for t in chat] == ["user", "assistant", "user"]
    chat = AN.add_prompts(df, 1, "OLMo", "ID").where("ID = 2").first()["formatted_prompt"]
    assert chat[0]["role"] == "system"
    with pytest.raises(Exception, match="fewer than 6"):
        AN.add_prompts(df, 6, "OLMo", "ID").collect()


def shot_rows(spark):
    rows = [(k, None if k % 2 else "a", k // 4, f"q{k}", f"s{k}", "") for k in range(12)]
    kind = "ID int, CATEGORY string, o int, PROBLEM string, SOLUTION string, EXTRACTED_ANSWER string"
    return rows, spark.createDataFrame(rows, kind)


def test_no_shots_keep_every_row(spark):
    rows, df = shot_rows(spark)
    got = AN.add_shots(df, 0, "o").collect()
    assert len(got) == len(rows)
    assert all(r["shots"] == [] and r["shot_ids"] == [] for r in got)
    assert AN.add_prompts(df, 0, "olmo-chat", "o").count() == len(rows)


def test_shots_with_a_null_category_and_ties(spark):
    rows, df = shot_rows(spark)
    got = {r["ID"]: r["shot_ids"] for r in AN.add_shots(df, 2, "o").collect()}
    assert len(got) == len(rows)
    for category in (None, "a"):
        own = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0])) if r[1] == category]
        for i in own:
            chosen = own[-2:] if i in own[:2] else own[:2]
            assert got[i] == [str(c) for c in chosen]


def test_text_functions(spark):
    r = spark.range(1).select(
        X.boxed_items(F.lit(r"a \boxed{1} and \boxed {\frac{1}{2}} \boxed{}")).alias("b"),
        X.first_number(F.lit("0.57 ± 0.1")).alias("n"),
        X.theta_from_text(F.lit("[1.5,0.3]")).alias("two"),
        X.theta_from_text(F.lit("0.25")).alias("one"),
        X.theta_from_text(F.lit("majority")).alias("none"),
        X.method_label(F.lit("m"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit(None))).alias("label"),
        X.model_name(F.lit("a/b/c")).alias("name"),
    ).first()
    assert r["b"] == ["1", r"\frac{1}{2}", ""]
    assert r["n"] == 0.57 and r["two"] == [1.5, 0.3] and r["one"] == [0.25] and r["none"] == [None]
    assert r["label"] == "m_a=None_b=2" and r["name"] == "c"
