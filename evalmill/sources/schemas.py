"""Schemas of the bronze files; readers take these and never infer."""

from __future__ import annotations

QUESTIONS_CSV = "scraped_at string, category_id smallint, category string, type string, difficulty string, question string, correct_answer string, incorrect_answers string, batch_index int, result_index int"
RESPONSES = """run_id string, run_order int, question_id string, prompt_variant string, prompt_version string, prompt_sha256 string, transport string, reasoning_mode string, max_tokens int, content string,
reasoning string, prompt_tokens int, completion_tokens int, reasoning_tokens int, tokens_per_second double, ttft_s double, finish_reason string, response_time double, attempt tinyint, error string, called_at timestamp"""
#: Fields of a manifest; nested ones are kept as their JSON text.
MANIFEST = """run_id string, model_key string, model_display_name string, model_quant string, model_format string, model_size_bytes bigint, instance_identifier string, context_length int, parallel int,
prompt_variant string, variant_label string, prompt_version string, reasoning_mode string, transport string, generation_params string, lmstudio_version string, runtime_engine string, python_version string,
package_version string, git_sha string, dataset_sha256 string, sample_spec string, n_questions_planned int, n_questions_done int, n_errors int, warmup_time_s double, context_length_end int, parallel_end int,
instance_identifier_end string, config_changed boolean, machine string, started_at timestamp, finished_at timestamp, status string"""
AUDIT = "called_at timestamp, endpoint string, status int, n_results int, duration_s double"
