"""Schemas of the catalog's tables, and bringing stored tables up to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEYWORD = "struct<term:string,weight:double>"
STAGE = "struct<stage:string,message:string,progress:int,at:timestamp>"
CITATION = "struct<chunk_id:string,chapter_id:string,book_id:string,score:double,content:string>"

TABLES: dict[str, StructType] = {
    name: StructType.fromDDL(ddl)
    for name, ddl in {
        "books": "book_id string, user_id string, title string, author string, publisher string, language string, "
        "publish_date string, isbn string, source_origin string, source_format string, file_path string, status string, "
        f"tags array<string>, category string, summary string, keywords array<{KEYWORD}>, cover_path string, "
        "created_at timestamp, updated_at timestamp",
        "chapters": "chapter_id string, book_id string, title string, level int, sort_order int, content string, summary string",
        "chunks": "chunk_id string, chapter_id string, book_id string, content string, token_count int, position int, "
        f"vector_id string, keywords array<{KEYWORD}>, tokens array<string>",
        "vectors": "id string, book_id string, chapter_id string, content string, position int, token_count int, vector array<float>",
        "tasks": "task_id string, book_id string, user_id string, type string, status string, progress int, error_msg string, "
        f"stages_log array<{STAGE}>, created_at timestamp, updated_at timestamp, dispatched_at timestamp",
        "api_tokens": "token_id string, user_id string, token_hash string, token_suffix string, alias string, "
        "last_used_at timestamp, expires_at timestamp, is_revoked boolean, created_at timestamp",
        "chat_sessions": "session_id string, user_id string, title string, book_ids array<string>, created_at timestamp, updated_at timestamp",
        "chat_messages": f"message_id string, session_id string, seq bigint, role string, content string, citations array<{CITATION}>, created_at timestamp",
        "users": "user_id string, username string, password_hash string, nickname string, avatar_path string, role string, "
        "status string, created_at timestamp, updated_at timestamp, last_login_at timestamp",
        "audit_log": "entry_id string, actor string, action string, target_type string, target_id string, detail string, created_at timestamp",
    }.items()
}
#: Columns that may be null; all other strings default to empty.
NULLABLE = {"dispatched_at", "last_login_at", "last_used_at", "expires_at"}


def conform(rows: DataFrame, table: str) -> DataFrame:
    """Rows with exactly the table's columns: missing ones get their defaults, others go, types are cast."""
    out = []
    for f in TABLES[table].fields:
        kind = f.dataType.simpleString()
        value = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        if f.name not in NULLABLE:
            if kind == "string":
                value = F.coalesce(value, F.lit(""))
            elif kind.startswith("array"):
                value = F.coalesce(value, F.array().cast(f.dataType))
            elif kind == "int":
                value = F.coalesce(value, F.lit(1 if f.name == "level" else 0))
            elif kind == "boolean":
                value = F.coalesce(value, F.lit(False))
        out.append(value.alias(f.name))
    return rows.select(*out)


def changes(stored: StructType, table: str) -> dict[str, list[str]]:
    """Columns that a stored table lacks, has beyond its schema, or has in another type."""
    want = {f.name: f.dataType.simpleString() for f in TABLES[table].fields}
    have = {f.name: f.dataType.simpleString() for f in stored.fields}
    return {
        "missing": [n for n in want if n not in have],
        "extra": [n for n in have if n not in want],
        "changed": [n for n in want if n in have and have[n] != want[n]],
    }


def migrate(spark: SparkSession, source: str, target: str, table: str) -> dict[str, list[str]]:
    """Write a stored table anew under its present schema, at another path; returns what changed."""
    rows = spark.read.parquet(source)
    found = changes(rows.schema, table)
    conform(rows, table).write.mode("overwrite").parquet(target)
    return found
