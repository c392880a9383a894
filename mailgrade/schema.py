"""Column layouts and labels shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# The four priorities, by id.
LABELS = ("critical", "high", "normal", "low")
CRITICAL, HIGH, NORMAL, LOW = range(4)

# Thresholds of the performance gate and defaults of the study.
ACCURACY_THRESHOLD = 0.75
MACRO_F1_THRESHOLD = 0.65
TEST_SHARE = 0.2
FOLDS = 5
SEED = 42
SAMPLE_CAP = 50_000
MAX_TERMS = 5000
EMBEDDING_SIZE = 768


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


RAW_COLUMNS = (
    "message_id", "sender", "recipients", "cc", "bcc", "subject", "body", "date", "folder",
)
FLAG_COLUMNS = (
    "has_cc", "has_bcc", "subject_has_re", "subject_has_fw", "is_reply", "is_forward",
)

RAW_MAIL = T.StructType(_fields(T.StringType(), *RAW_COLUMNS))

MAIL = T.StructType(
    _fields(T.StringType(), "message_id", "sender", "recipients", "cc", "bcc", "subject", "body",
            "date")
    + _fields(T.IntegerType(), "hour_of_day", "day_of_week")
    + _fields(T.StringType(), "thread_id", "folder")
    + _fields(T.IntegerType(), "priority")
    + _fields(T.StringType(), "priority_label")
    + _fields(T.IntegerType(), "body_length", "subject_length", "word_count", "recipient_count",
              *FLAG_COLUMNS)
)

REQUEST_MAIL = T.StructType(
    _fields(T.StringType(), "sender", "recipients", "subject", "body", "date", "cc", "bcc",
            "folder")
)
BATCH_REQUEST = T.StructType(
    [T.StructField("request_id", T.StringType()), T.StructField("emails", T.ArrayType(REQUEST_MAIL))]
)

SCORES = T.MapType(T.StringType(), T.DoubleType())

RESULT_COLUMNS = (
    "id", "sender", "recipients", "subject", "body", "date", "priority", "confidence",
    "confidence_scores", "shap_values", "model_used", "created_at", "updated_at",
)
