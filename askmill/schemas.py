"""Fixed schemas, as DDL, of the stored tables and of the JSON payloads.

Nothing is inferred from values, so a column that holds only NULL keeps its type.
"""

CHUNKS = "id string, doc_id string, chunk_ix int, n_words int, text string"

VECTORS = "id string, text string, embedding array<float>, norm double, content_hash string"

CHANGES = "id string, text string, op string, seq bigint"

ANSWERS = (
    "ai_output string, question string, input_prompt string, time_s double, model string, "
    "answer_type string, inserted timestamp, failed boolean, error string"
)

VERDICTS = ANSWERS + ", score string, explanation string, score_num double"

PARAMS = "struct<max_tokens:int,temperature:double>"

# The field names of the configuration files.
CONFIG = (
    "configs struct<model_name:string,vector_search_endpoint_name:string,embedding_endpoint:string,"
    f"endpoint:string,extra_params:{PARAMS},system_prompt:string,rag_prompt:string,"
    "kv_scope:string,kv_secret:string>, "
    "questions map<string,string>, "
    f"judge_configs struct<databricks_endpoint:string,openai_endpoint:string,extra_params:{PARAMS}>, "
    "judge_prompts struct<rag_prompt:string,rag_ground_truth:string,function_prompt:string,"
    "normal_system_prompt:string>"
)

MESSAGES = "array<struct<role:string,content:string>>"

# The field names of tool calls and of weather reports.
TOOL_CALLS = "array<struct<function:struct<name:string,arguments:string>>>"

WEATHER = "struct<current_condition:array<struct<temp_C:string,weatherDesc:array<struct<value:string>>>>>"

OBSERVATIONS = "city string, observed_at timestamp, payload_json string"

RUBRICS = "question string, rubric_template string"

GROUND_TRUTH = "model string, answer_type string, truth string"
