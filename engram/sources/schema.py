"""Row types of the fact store and validation that reports instead of raising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CONTENT_BYTES = 102_400
MAX_BOUNDARY_LEN = 64
MAX_ENTITY_NAME_BYTES = 256
MAX_RELATION_TYPE_BYTES = 64
MEMORY_TYPES = ("episodic", "semantic", "procedural")
BOUNDARY_PATTERN = rf"^[A-Za-z0-9_-]{{1,{MAX_BOUNDARY_LEN}}}$"


def _fields(spec: str) -> T.StructType:
    """``name type`` pairs separated by commas; a trailing ``?`` marks a nullable field."""
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, T._parse_datatype_string(kind.rstrip("?")), kind.endswith("?")))
    return T.StructType(fields)


#: Spark SQL type names; every table of the store.
SPECS = {
    "memories": "id string, content string, memory_type string, source_agent string?, boundary string, created_at timestamp, valid_from timestamp, "
    "valid_until timestamp?, confidence float, access_count bigint, last_accessed timestamp, superseded_by string?, archived_at timestamp?, metadata_json string",
    "vectors": "id string, embedding array<float>, boundary string",
    "entities": "id string, name string, entity_type string, boundary string, created_at timestamp",
    "relationships": "id string, from_entity_id string, to_entity_id string, relation_type string, boundary string, valid_from timestamp, "
    "valid_until timestamp?, confidence double, source_memory_id string?",
    "boundaries": "name string, description string?, created_at timestamp",
    "audit_log": "seq bigint, event_id string, timestamp string, user_id string?, device_id string?, event_type string, resource_type string?, resource_id string?, "
    "boundary string?, actor_kind string, actor_name string?, result string, details_json string, prev_event_hash string, event_hash string",
    "retry_queue": "id string, memory_id string, operation string, payload string?, sequence_id bigint, attempts_made int, next_attempt_at timestamp, created_at timestamp, last_error string?",
    "dead_letter": "id string, memory_id string, failed_operation string, failure_reason string, attempts_made int, first_failed_at timestamp, last_attempted_at timestamp, "
    "payload string?, resolution string?, resolved_at timestamp?",
    "pending_sync": "memory_id string, queued_at timestamp, operation string, payload string?",
    "checkpoint_entries": "checkpoint_id string, memory_id string, boundary string, change_type string, pre_image string?",
    "agent_tokens": "token_hash string, agent_name string, boundaries array<string>, created_at timestamp, revoked_at timestamp?",
}


def schema(table: str) -> T.StructType:
    """Schema of one table of the store."""
    return _fields(SPECS[table])


def _violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def validate_memories(memories: DataFrame) -> DataFrame:
    """Adds ``violations``: names of the rules each row breaks (empty for a sound row)."""
    rules = {
        "content_empty": F.length(F.trim("content")) > 0,
        "content_too_long": F.octet_length("content") <= MAX_CONTENT_BYTES,
        "content_nul": ~F.col("content").contains("\x00"),
        "memory_type": F.col("memory_type").isin(*MEMORY_TYPES),
        "boundary": F.col("boundary").rlike(BOUNDARY_PATTERN),
        "confidence": ~F.isnan("confidence") & F.col("confidence").between(0.0, 1.0),
        "validity": F.col("valid_until").isNull() | (F.col("valid_until") >= F.col("valid_from")),
    }
    return memories.withColumn("violations", _violations(rules))


def validate_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Adds ``violations`` of dimension, non-empty and finite values."""
    finite = ~F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return vectors.withColumn("violations", _violations({"dimension": F.size("embedding") == dim, "finite": finite}))


def validate_entities(entities: DataFrame) -> DataFrame:
    """Adds ``violations`` of name and boundary rules."""
    rules = {
        "name_empty": F.length(F.trim("name")) > 0,
        "name_too_long": F.octet_length("name") <= MAX_ENTITY_NAME_BYTES,
        "name_control": ~F.col("name").rlike(r"\p{Cntrl}"),
        "boundary": F.col("boundary").rlike(BOUNDARY_PATTERN),
    }
    return entities.withColumn("violations", _violations(rules))


def validate_relationships(relationships: DataFrame) -> DataFrame:
    """Adds ``violations`` of relation type, confidence, validity and self-loops."""
    rules = {
        "relation_empty": F.length(F.trim("relation_type")) > 0,
        "relation_too_long": F.octet_length("relation_type") <= MAX_RELATION_TYPE_BYTES,
        "confidence": ~F.isnan("confidence") & F.col("confidence").between(0.0, 1.0),
        "validity": F.col("valid_until").isNull() | (F.col("valid_until") >= F.col("valid_from")),
        "self_loop": F.col("from_entity_id") != F.col("to_entity_id"),
    }
    return relationships.withColumn("violations", _violations(rules))


def quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound rows (without ``violations``) and broken rows (with them)."""
    return validated.where(F.size("violations") == 0).drop("violations"), validated.where(F.size("violations") > 0)
