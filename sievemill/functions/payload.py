"""Sanitising chat payloads: secrets masked, then noise pruned, in user-side text only.

Turns as rows are built-in expressions. Whole JSON payloads go through a pandas UDF that applies the same rule tables
(redaction.RULES, noise.LABELS) to the strings that it finds in the tree.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import noise, redaction
from sievemill.functions.text import let
from sievemill.functions.jsontext import dump, load

# Blocks that stay as they are.
KEPT_PARTS = ("thinking", "redacted_thinking", "image", "tool_use")
KEPT_NESTED = ("image", "thinking")
KIND = "struct<payload:string,raw_bytes:bigint,clean_bytes:bigint,secrets:bigint>"


def clean_turn(role: Column, text: Column) -> Column:
    """struct(text, raw_bytes, clean_bytes, changed) of a turn; turns of the assistant stay as they are."""
    zero = F.lit(0).cast("long")

    def of(t: Column) -> Column:
        unchanged = F.struct(t.alias("text"), zero.alias("raw_bytes"), zero.alias("clean_bytes"), zero.alias("changed"))

        def cleaned(masked: Column) -> Column:
            sizes = lambda clean: F.struct(clean.alias("text"), F.octet_length(t).cast("long").alias("raw_bytes"), F.octet_length(clean).cast("long").alias("clean_bytes"), (masked != t).cast("long").alias("changed"))
            return let(noise.kept(masked), sizes)

        return F.when(role == "assistant", unchanged).otherwise(let(redaction.redact(t), cleaned))

    return let(text, of)


def sanitize_conversations(df: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """df with text cleaned and raw_bytes, clean_bytes, changed added."""
    turn = redaction.fresh(df.columns, "_turn")
    out = df.withColumn(turn, clean_turn(F.coalesce(F.col(role_col), F.lit("")), F.col(text_col)))
    return out.select(*[F.col(turn)["text"].alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns], *[F.col(turn)[x].alias(x) for x in ("raw_bytes", "clean_bytes", "changed")])


@lru_cache(1)
def _compiled() -> dict[str, Any]:
    python = lambda p: re.compile(p.replace(r"\z", r"\Z"))
    return {
        "rules": [(python(p), re.sub(r"\\(\d)", r"\\g<\1>", r)) for _, p, r in redaction.linear_rules()],
        "low": python(noise.LOWER_NOISE),
        "raw": python(noise.PLAIN_NOISE),
        "idle": python(noise.IDLE_BLOCK),
    }


def mask_text(text: str) -> str:
    for pattern, replacement in _compiled()["rules"]:
        text = pattern.sub(replacement, text)
    return text


def prune_text(text: str) -> str:
    c = _compiled()
    if any(m in text for m in noise.IDLE):
        text = c["idle"].sub("", text)
    if not text:
        return ""
    rows = re.sub(r"\r?\n\Z", "", text)
    rows = re.split(r"\r?\n", rows)
    return "\n".join(r for r in rows if not (c["low"].search(r.lower().replace("\\", "/")) or c["raw"].search(r)))


class Cleaner:
    """Rewrites one payload and counts."""

    def __init__(self) -> None:
        self.raw = self.clean = self.secrets = 0

    def text(self, s: str) -> str:
        masked = mask_text(s)
        out = prune_text(masked)
        self.raw += len(s.encode())
        self.clean += len(out.encode())
        self.secrets += masked != s
        return out

    def field(self, holder: dict, *names: str) -> None:
        """Cleans the first of the fields that is a string."""
        for n in names:
            if isinstance(holder.get(n), str):
                holder[n] = self.text(holder[n])
                return

    def parts(self, value: Any, kept: tuple[str, ...], names: tuple[str, ...], nested: bool = False, strings: bool = True) -> Any:
        if isinstance(value, str):
            return self.text(value)
        if not isinstance(value, list):
            return value
        for i, part in enumerate(value):
            if isinstance(part, str) and strings:
                value[i] = self.text(part)
            elif isinstance(part, dict) and part.get("type") not in kept:
                if nested and part.get("type") == "tool_result":
                    if "content" in part:
                        part["content"] = self.parts(part["content"], KEPT_NESTED, ("text",))
                else:
                    self.field(part, *names)
        return value

    def payload(self, body: Any) -> Any:
        if not isinstance(body, dict):
            return body
        for message in body["messages"] if isinstance(body.get("messages"), list) else ():
            if isinstance(message, dict) and message.get("role") != "assistant" and "content" in message:
                message["content"] = self.parts(message["content"], KEPT_PARTS, ("text", "content"), nested=True)
        if "system" in body:
            body["system"] = self.parts(body["system"], KEPT_NESTED, ("text",), strings=False)
        self.field(body, "prompt")
        if "input" in body:
            body["input"] = self.parts(body["input"], (), ())
        return body


def sanitize_json(payload: Column) -> Column:
    """struct(payload, raw_bytes, clean_bytes, secrets) of JSON payloads; null for what isn't JSON."""

    @F.pandas_udf(KIND)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            body, c = load(t), Cleaner()
            rows.append((None, None, None, None) if body is None else (dump(c.payload(body)), c.raw, c.clean, c.secrets))
        return pd.DataFrame(rows, columns=["payload", "raw_bytes", "clean_bytes", "secrets"]).astype({c: "Int64" for c in ("raw_bytes", "clean_bytes", "secrets")})

    return run(payload)
