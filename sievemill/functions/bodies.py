"""Decoding of request bodies and of JSON-RPC lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 32 << 20
KIND = "struct<body:binary,error:string>"


def unchunked(raw: bytes, most: int = MOST) -> tuple[bytes | None, str | None]:
    """(body, error) of a body in chunked transfer coding."""
    out, at, size = [], 0, 0
    while True:
        if at >= len(raw):
            return None, "Unexpected EOF in chunked body"
        end = raw.find(b"\r\n", at)
        if end < 0:
            return None, "Missing CRLF after chunk size"
        head = raw[at:end].split(b";")[0].strip()
        if not head or any(c not in b"0123456789abcdefABCDEF" for c in head):
            return None, "Invalid hex in chunk size"
        n = int(head, 16)
        if n == 0:
            return b"".join(out), None
        if n > most or size + n > most:
            return None, "Chunked payload exceeds maximum allowable size"
        at = end + 2
        if len(raw) < at + n + 2:
            return None, "Incomplete chunk data"
        if raw[at + n : at + n + 2] != b"\r\n":
            return None, "Missing CRLF after chunk data"
        out.append(raw[at : at + n])
        size += n
        at += n + 2


def decode_chunked(raw: Column, most: int = MOST) -> Column:
    """struct(body, error) of binary bodies."""

    @F.pandas_udf(KIND)
    def run(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if b is None else unchunked(bytes(b), most) for b in bodies], columns=["body", "error"])

    return run(raw)


def rpc_lines(lines: DataFrame, line_col: str = "value", most: int = 50_000_000) -> DataFrame:
    """lines with id, method, params and error (-32700: not JSON, -32600: no method or too long), for batch and stream."""
    line = F.col(line_col)
    tree = F.when(F.octet_length(line) <= most, F.try_parse_json(line))
    text = lambda path: F.try_variant_get(tree, path, "string")
    error = F.when(F.octet_length(line) > most, -32600).when(tree.isNull(), -32700).when(text("$.method").isNull(), -32600)
    return lines.filter(F.trim(line) != "").select("*", F.get_json_object(line, "$.id").alias("id"), text("$.method").alias("method"), F.get_json_object(line, "$.params").alias("params"), error.alias("error"))
