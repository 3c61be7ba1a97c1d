"""Conversations in any spelling, as one array of (role, content) with a reason for every rejected row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class MessageSchema:
    """Field names of a message and a partial renaming of roles."""

    role_key: str = "role"
    content_key: str = "content"
    role_map: dict[str, str] = field(default_factory=dict)


DEFAULT_SCHEMA = MessageSchema()


def schema_from_config(block: dict | None) -> MessageSchema:
    """The schema that a configuration block describes; None gives the default one."""
    if block is None:
        return DEFAULT_SCHEMA
    if not isinstance(block, dict):
        raise ValueError("message_schema must be a mapping")
    unknown = sorted(str(k) for k in set(block) - {"role_key", "content_key", "role_map"})
    if unknown:
        raise ValueError(f"message_schema has unknown keys: {', '.join(unknown)}")
    for key in ("role_key", "content_key"):
        if key in block and (not isinstance(block[key], str) or not block[key]):
            raise ValueError(f"message_schema.{key} must be a non-empty string")
    roles = block.get("role_map") or {}
    if not isinstance(roles, dict) or not all(isinstance(x, str) and x for pair in roles.items() for x in pair):
        raise ValueError("message_schema.role_map must map strings to strings")
    return MessageSchema(block.get("role_key", "role"), block.get("content_key", "content"), dict(roles))


def _renamed(role: Column, schema: MessageSchema) -> Column:
    if not schema.role_map:
        return role
    pairs = F.create_map(*[F.lit(x) for pair in schema.role_map.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, role), role)


def _from_array(value: Column, kind: T.ArrayType, schema: MessageSchema) -> tuple[Column, Column]:
    """(messages or null, reason)."""
    bad = F.lit(None).cast(MESSAGES)
    element = kind.elementType
    names = {f.name: f.dataType for f in element.fields} if isinstance(element, T.StructType) else {}
    if not all(isinstance(names.get(k), T.StringType) for k in (schema.role_key, schema.content_key)):
        reason = F.when(value.isNull(), "not_a_sequence").when(F.size(value) == 0, "empty").otherwise("bad_message")
        return bad, reason
    one = lambda m: F.struct(_renamed(m[schema.role_key], schema).alias("role"), m[schema.content_key].alias("content"))
    broken = F.exists(value, lambda m: F.coalesce(m[schema.role_key].isNull() | m[schema.content_key].isNull(), F.lit(True)))
    reason = F.when(value.isNull(), "not_a_sequence").when(broken, "bad_message").when(F.size(value) == 0, "empty")
    return F.transform(value, one), reason


def _from_json(value: Column, schema: MessageSchema) -> tuple[Column, Column]:
    """Strict: numbers are not strings and an object is not a sequence."""
    parsed = F.try_parse_json(value)
    kind = F.schema_of_variant(parsed)
    elements = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(parsed, "$", "array<variant>"))

    def text(m: Column, key: str) -> Column:
        found = F.try_variant_get(m, f"$['{key}']", "variant")
        return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(m, f"$['{key}']", "string"))

    pairs = F.transform(
        elements,
        lambda m: F.when(
            F.startswith(F.schema_of_variant(m), F.lit("OBJECT")),
            F.struct(text(m, schema.role_key).alias("role"), text(m, schema.content_key).alias("content")),
        ),
    )
    broken = F.exists(pairs, lambda m: F.coalesce(m["role"].isNull() | m["content"].isNull(), F.lit(True)))
    reason = F.when(elements.isNull(), "not_a_sequence").when(broken, "bad_message").when(F.size(elements) == 0, "empty")
    return F.transform(pairs, lambda m: F.struct(_renamed(m["role"], schema).alias("role"), m["content"].alias("content"))), reason


def normalize(df: DataFrame, column: str = "messages", schema: MessageSchema = DEFAULT_SCHEMA, *, strict: bool = False) -> DataFrame:
    """Adds ``turns`` (null where rejected) and ``drop_reason`` (null where kept).

    A missing column rejects every row, or raises if ``strict``.
    """
    if column not in df.columns:
        if strict:
            raise ValueError(f"no column {column!r}; there are {df.columns}")
        return df.withColumns({"turns": F.lit(None).cast(MESSAGES), "drop_reason": F.lit("missing_column")})
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        turns, reason = _from_array(F.col(column), kind, schema)
    elif isinstance(kind, T.StringType):
        turns, reason = _from_json(F.col(column), schema)
    else:
        turns, reason = F.lit(None).cast(MESSAGES), F.lit("not_a_sequence")
    out = df.withColumn("drop_reason", reason)
    return out.withColumn("turns", F.when(F.col("drop_reason").isNull(), turns))


def rejected(df: DataFrame, code: str, when: Column) -> DataFrame:
    """Marks rows that no earlier rule rejected."""
    return df.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & when, code).otherwise(F.col("drop_reason")))


def final_assistant(df: DataFrame) -> DataFrame:
    """Rejects conversations whose last turn is not an assistant's."""
    return rejected(df, "last_not_assistant", F.coalesce(F.element_at("turns", -1)["role"] != "assistant", F.lit(False)))


def inject_system(df: DataFrame, prompt: str | None) -> DataFrame:
    """Puts a system turn first where there is none; null and empty prompts put none."""
    if not prompt:
        return df
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content")))
    return df.withColumn("turns", F.when(F.get("turns", F.lit(0))["role"] != "system", F.concat(system, "turns")).otherwise(F.col("turns")))


def require_tags(df: DataFrame, start: str = "<think>", end: str = "</think>") -> DataFrame:
    """Rejects conversations whose last content lacks either tag."""
    last = F.element_at("turns", -1)["content"]
    return rejected(df, "missing_reasoning_tags", F.coalesce(~(F.contains(last, F.lit(start)) & F.contains(last, F.lit(end))), F.lit(False)))


def nested(turns: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """One row a conversation from one row a turn."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy(id_col).agg(F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
