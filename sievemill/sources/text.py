"""Sources and sinks of text."""

from __future__ import annotations

import os
import tomllib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions.text import n_newlines, truncated, with_newline


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def bounded(df: DataFrame, most: int, text_col: str = "text", cut: bool = True, marker: str = "") -> DataFrame:
    """Texts of at most ``most`` bytes: longer ones are cut at a character, or left out."""
    return df.withColumn(text_col, truncated(F.col(text_col), most, marker)) if cut else df.filter(F.octet_length(text_col) <= most)


def rpc_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of lines (value) from a folder of text files; see functions.bodies.rpc_lines."""
    return spark.readStream.text(path)


def put_in_place(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let write() make a folder beside ``path``, then give it that name. A write that fails leaves what was there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    beside = lambda mark: spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{mark}-{uuid.uuid4().hex}")
    new, old = beside("new"), beside("old")
    try:
        write(new.toString())
    except BaseException:
        fs.delete(new, True)
        raise
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"can't move {path} away")
    if not fs.rename(new, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"can't put the new table at {path}")
    if had:
        fs.delete(old, True)


def write_text(df: DataFrame, path: str, text_col: str = "text") -> None:
    """Texts as they are, each with one newline at its end, replacing what is there once all is written."""
    rows = df.select(F.regexp_replace(with_newline(F.col(text_col)), "\\n\\z", "").alias("value"))
    put_in_place(df.sparkSession, path, lambda at: rows.write.text(at))


def write_table(df: DataFrame, path: str) -> None:
    """A table, replacing what is there (it may be what df reads) once all is written."""
    put_in_place(df.sparkSession, path, lambda at: df.write.parquet(at))


def sink_metrics(df: DataFrame, before: str, after: str) -> DataFrame:
    """(original_lines, clean_lines, pruned_lines), counted as newlines."""
    rows = df.agg(F.sum(n_newlines(F.col(before))).alias("original_lines"), F.sum(n_newlines(F.col(after))).alias("clean_lines"))
    return rows.withColumn("pruned_lines", F.col("original_lines") - F.col("clean_lines"))


@dataclass
class Config:
    """Settings of a run; the lists are (pattern, replacement) and noise patterns."""

    redact_rules: list[tuple[str, str | None]] = field(default_factory=list)
    noise_patterns: list[str] = field(default_factory=list)
    context_lines: int = 5
    strategy: str = "aggressive"
    max_hourly_tokens: int | None = None
    upstream: str = "auto"


def load_config(name: str, folders: tuple[str, ...] | None = None) -> Config:
    """The first file of that name in the working folder, then the home folder; defaults if there is none or it is broken."""
    for folder in folders or (".", os.path.expanduser("~")):
        path = Path(folder, name)
        if path.is_file():
            try:
                raw = tomllib.loads(path.read_text())
            except (tomllib.TOMLDecodeError, UnicodeDecodeError):
                return Config()
            known = {f.name for f in fields(Config)}
            out = Config(**{k: v for k, v in raw.items() if k in known and k != "redact_rules"})
            rules = raw.get("redact_rules", [])
            out.redact_rules = [(r["pattern"], r.get("replacement")) for r in rules if isinstance(r, dict) and isinstance(r.get("pattern"), str)]
            return out
    return Config()
