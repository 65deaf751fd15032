"""Declared schemas of the detector inputs and run logs."""

from __future__ import annotations

ITEM = (
    "ID string, CATEGORY string, PROBLEM string, SOLUTION string, "
    "LABEL string, LABEL_BINARY int"
)

VERBOSE_ITEM = ITEM + ", EXTRACTED_ANSWER string"

TOKEN_DATA = (
    ITEM + ", input_ids_list array<int>, decoded_tokens array<string>, "
    "token_probs array<double>, token_log_likes array<double>"
)

CDD_GENERATION = (
    ITEM + ", MAX_LENGTH int, GREEDY_IDS array<int>, SAMPLE_IDS array<array<int>>"
)

NGRAM_GENERATION = (
    ITEM + ", NGRAM_GENERATION_DATA map<string, struct<TARGET_NGRAMS: array<array<int>>, "
    "PREDICTED_NGRAMS: array<array<int>>, START_POINTS: array<int>>>"
)

NGRAM_LOGLIKE_GENERATION = (
    ITEM + ", NGRAM_LOGLIKE_GENERATION_DATA map<string, struct<NGRAM_LOGLIKES: array<double>, "
    "DECODED_NGRAMS: array<array<string>>, START_POINTS: array<int>>>"
)

NGRAM_CDD_GENERATION = (
    ITEM + ", NGRAM_CDD_GENERATION_DATA map<string, struct<starttoken: array<int>, "
    "cdd_generation_data: array<struct<GREEDY_IDS: array<int>, "
    "SAMPLE_IDS: array<array<int>>, MAX_LENGTH: int>>>>"
)

ANSWER = (
    "ID string, PROBLEM string, CATEGORY string, LABEL string, PROMPT string, "
    "SOLUTION_KEY string, SOLUTION_TEXT string, LLM_RESPONSE string, "
    "attributes struct<start_time: string, end_time: string>"
)

ANSWER_FILE = (
    "metadata struct<experiment_id: string, timestamp: string, description: string, "
    "additional_info: map<string,string>>, "
    "data array<struct<ID: string, PROBLEM: string, CATEGORY: string, LABEL: string, "
    "PROMPT: string, SOLUTION_KEY: string, SOLUTION_TEXT: string, LLM_RESPONSE: string, "
    "attributes: struct<start_time: string, end_time: string>>>"
)

CORRECTNESS = (
    "ID string, CATEGORY string, DIFFICULTY_SCORE_A int, LABEL string, "
    "CORRECTNESS int, MODEL_SHORT string"
)

METHOD_LINE = (
    "experiment_id string, model_id string, data_id string, data_version string, seed int, "
    "ID string, label string, timestamp string, method_name string, "
    "parameters map<string,string>, output boolean"
)

TEST_LOG = (
    "model_id string, data_name string, datetime string, method_name string, "
    "parameter map<string,string>, "
    "metrics struct<accuracy: double, accuracy_95CI: array<double>, precision: double, "
    "recall: double, f1_score: double, confusion_matrix: array<array<bigint>>, "
    "mcnemar_b: bigint, mcnemar_c: bigint, mcnemar_p_value: double>, "
    "n_bootstrap int, seed int"
)

LOG_ENTRY = (
    "struct<method: string, fit: string, parameter: map<string,string>, "
    "global_threshold: variant, median_threshold: double, median_threshold_1: double, "
    "median_threshold_2: double, mean_cvacc_train: double, mean_cvacc_test: double, "
    "all_thresholds: variant, all_cvacc_train: array<double>, all_cvacc_test: array<double>>"
)

TRAIN_LOG = (
    "model_id string, data_set string, datetime string, method_name string, "
    "parameter_range map<string,string>, CV_folds int, CV_seed int, "
    f"best_log_entry {LOG_ENTRY}, all_log_entries array<{LOG_ENTRY}>"
)
