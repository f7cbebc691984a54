"""Notes, payload files and saved pages in; tables, reports and logs out.

Nothing here collects: every reader and writer is a distributed scan or a distributed write. File order, where a
result depends on it, is the order of full paths.
"""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papergrid.functions.references import safe_id
from papergrid.workspace import is_there


def read_notes(spark: SparkSession, folder: str, recursive: bool = False, pattern: str = "*.md") -> DataFrame:
    """(path, stem, content): one row for each note, the whole text in it."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    path = F.col("_metadata.file_path")
    return reader.text(folder, wholetext=True).select(
        path.alias("path"), F.regexp_replace(F.try_url_decode(F.element_at(F.split(path, "/"), -1)), r"\.[^.]+$", "").alias("stem"), F.col("value").alias("content")
    )


def find_notes(notes: DataFrame, name: str, how: str = "exact", ignore_case: bool = True) -> DataFrame:
    """The first note, by path, whose stem equals the name or begins with it; no row if there is none."""
    fold = F.lower if ignore_case and how == "prefix" else (lambda c: c)
    wanted, stem = fold(F.lit(name.removesuffix(".md"))), fold(F.col("stem"))
    return notes.where(stem == wanted if how == "exact" else stem.startswith(wanted)).orderBy("path").limit(1)


def note_matches(notes: DataFrame, name: str) -> DataFrame:
    """(name, path, matches): the chosen file and how many there are of that name."""
    return notes.where(F.col("stem") == name.removesuffix(".md")).agg(F.min("path").alias("path"), F.count("*").alias("matches")).select(F.lit(name).alias("name"), "path", "matches")


def read_articles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows under 'articles' of article files."""
    return spark.read.schema(f"articles array<struct<{schema}>>").json(path, multiLine=True).select(F.inline("articles"))


def read_table_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or an empty one where there is nothing at the path; what is there and can't be read is an error."""
    return spark.read.schema(schema).parquet(path) if is_there(spark, path) else spark.createDataFrame([], schema)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(key, fields of schema): a JSON object of records under their keys, saved as one file; no row where there is none."""
    kind = f"map<string,struct<{schema}>>"
    if not is_there(spark, path):
        return spark.createDataFrame([], f"key string, {schema}")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", kind))).select("key", "value.*")


def read_references(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a reference file, a JSON list; a missing file is an error."""
    if not is_there(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", f"array<struct<{schema}>>")))


def load_set(sets: DataFrame, set_id: str) -> DataFrame:
    """The rows of one set; characters that can't stand in an id are left out of the asked one."""
    return sets.where(F.col("set_id") == safe_id(F.lit(set_id)))


def list_sets(sets: DataFrame, created: str = "created_at", skip_backups: bool = False) -> DataFrame:
    """Sets newest first, ties by id. skip_backups: without those that are copies made before a change."""
    own = sets.where(~F.col("set_id").contains(".before_")) if skip_backups else sets
    return own.orderBy(F.desc(created), "set_id")


def _mime_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            message = email.message_from_bytes(bytes(content), policy=email.policy.default)
            for number, part in enumerate(p for p in message.walk() if not p.is_multipart()):
                data = part.get_payload(decode=True) or b""
                text = data.decode(part.get_content_charset() or "utf-8", "replace") if part.get_content_maintype() == "text" else None
                rows.append((path, number, part.get_content_type(), str(part.get("Content-Location") or ""), text, data))
        yield pd.DataFrame(rows, columns=["path", "part", "content_type", "location", "text", "data"])


def read_mhtml(spark: SparkSession, path: str, keep_data: bool = False) -> DataFrame:
    """(path, part, content_type, location, text[, data]): the parts of saved pages."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{mhtml,mht}").load(path).select("path", "content")
    parts = files.mapInPandas(_mime_parts, "path string, part int, content_type string, location string, text string, data binary")
    return parts if keep_data else parts.drop("data")


def main_pages(parts: DataFrame) -> DataFrame:
    """(path, location, text): of each saved page the longest HTML part, those that mention references far ahead."""
    weight = F.char_length("text") + F.when(F.lower("text").contains("references"), 5_000_000).otherwise(0)
    pages = parts.where((F.col("content_type") == "text/html") & F.col("text").isNotNull())
    best = pages.groupBy("path").agg(F.max_by(F.struct("location", "text"), F.struct(weight, -F.col("part"))).alias("p"))
    return best.select("path", "p.location", "p.text")


def named_apart(df: DataFrame, base: str, order: str, separator: str = "-", first: int = 2) -> DataFrame:
    """df with unique_id: the base, and from its second row on the base with a number."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return df.withColumn("_n", n).withColumn(
        "unique_id", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws(separator, F.col(base), (F.col("_n") - 2 + first).cast("string")))
    ).drop("_n")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_index(df: DataFrame, path: str, overwrite: bool = False, by: str | None = None) -> None:
    """A stored index; an existing one is replaced only on request. by: column to lay the folders out by."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_lines(df: DataFrame, line: str, path: str) -> None:
    """One text line for each row: logs of removed links and the like."""
    df.select(F.col(line).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_versions(df: DataFrame, path: str) -> None:
    """Changed notes beside their originals: (path, original, changed), only where they differ. The sources stay untouched."""
    df.where(~F.col("original").eqNullSafe(F.col("changed"))).write.mode("overwrite").parquet(path)


def append_session(df: DataFrame, path: str) -> None:
    """Questions and answers of a session, appended under its id."""
    df.write.mode("append").partitionBy("session_id").parquet(path)
