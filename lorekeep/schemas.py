"""The tables' columns; nothing is inferred."""

MEMORIES = (
    "id bigint, conversation_id string, session_id string, turn_id string, s3_bucket string, s3_key string, "
    "byte_size int, content_hash binary, created_at timestamp"
)
EVENTS = (
    "id bigint, memory_id bigint, enrichment_version smallint, attempt int, status string, permanent boolean, "
    "error_message string, normalized_text string, lexemes array<string>, ts timestamp, embedding binary, created_at timestamp"
)
CACHE = "content_hash binary, model string, task_prefix string, dims smallint, vector binary, created_at timestamp"
TURNS = "conversation_id string, session_id string, turn_id string, speaker string, text string, date_time string, pos int"
QUESTIONS = "query_id string, conversation_id string, question string, question_date string, evidence array<string>, grp string"
