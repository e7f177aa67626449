"""Applying a patch to a text by unique match, and syntax gates."""

from __future__ import annotations

import ast
import json
import tomllib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions import lint
from sievemill.functions.tokens import TooMuch, js_error, rust_error
from sievemill.functions.yamlcheck import yaml_error

KIND = "struct<status:string,text:string>"
FOUND_NONE = "Error: original_code not found in the file. Make sure it matches exactly."
FOUND_MANY = "Error: original_code found {} times. Please provide a more specific code block."


def indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def rows_of(s: str) -> list[str]:
    return [r.removesuffix("\r") for r in s.removesuffix("\n").split("\n")] if s else []


def shift(line: str, by: int) -> str:
    if not line.strip():
        return ""
    return " " * by + line if by >= 0 else line[min(-by, indent(line)) :]


def tolerant(content: str, original: str, new: str) -> tuple[str, str] | None:
    """(what to replace, by what) if exactly one place has the lines of original, all indented differently by one amount."""
    have, want = rows_of(content), rows_of(original)
    if not want:
        return None
    places = []
    for i in range(len(have) - len(want) + 1):
        pairs = list(zip(have[i : i + len(want)], want, strict=True))
        if all(a.strip() == b.strip() for a, b in pairs):
            by = {indent(a) - indent(b) for a, b in pairs if a.strip()}
            if len(by) <= 1:
                places.append((i, by.pop() if by else 0))
    if len(places) != 1:
        return None
    (at, by), end = places[0], "\r\n" if "\r\n" in content else "\n"
    return end.join(have[at : at + len(want)]), end.join(shift(r, by) for r in rows_of(new))


def replaced(content: str, original: str, new: str) -> tuple[str, str]:
    """(status, text): 'ok' and the patched text, or an error and the text as it was. Tried in turn: as given, with CRLF,
    with LF, with shifted indents."""
    lf = lambda s: s.replace("\r\n", "\n")
    tries = [(original, new), (lf(original).replace("\n", "\r\n"), lf(new).replace("\n", "\r\n")), (lf(original), lf(new))]
    pair = next((t for t in tries if t[0] and t[0] in content), None) or tolerant(content, original, new) or tries[0]
    n = content.count(pair[0]) if pair[0] else 0
    if n != 1:
        return (FOUND_NONE if n == 0 else FOUND_MANY.format(n)), content
    return "ok", content.replace(pair[0], pair[1], 1)


def apply_patch(content: Column, original: Column, new: Column) -> Column:
    """struct(status, text)."""

    @F.pandas_udf(KIND)
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else replaced(x, y or "", z or "") for x, y, z in zip(a, b, c, strict=True)], columns=["status", "text"])

    return run(content, original, new)


def syntax_error(kind: str, code: str) -> str | None:
    """Why code of a kind (a file name's ending) isn't well formed; null if it is or the kind isn't known."""
    kind = kind.lower().lstrip(".")
    try:
        if kind == "json":
            json.loads(code)
        elif kind == "toml":
            tomllib.loads(code)
        elif kind in ("yaml", "yml"):
            return yaml_error(code)
        elif lint.LANGUAGES.get(kind) == "python":
            ast.parse(code)
        elif kind in lint.LANGUAGES:
            return rust_error(code) if lint.LANGUAGES[kind] == "rust" else js_error(code)
    except (ValueError, SyntaxError, RecursionError, TooMuch) as e:
        return str(e)[:200]
    return None


def syntax_gate(kind: Column, code: Column) -> Column:
    @F.pandas_udf("string")
    def run(kinds: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else syntax_error(k or "", c) for k, c in zip(kinds, codes, strict=True)], dtype=object)

    return run(kind, code)


def project_type(files: Column) -> Column:
    """Kind of project by the first known build file in an array of names."""
    known = (("Cargo.toml", "rust"), ("package.json", "node"), ("go.mod", "go"), ("pyproject.toml", "python"), ("requirements.txt", "python"), ("pom.xml", "java"), ("build.gradle", "java"), ("Gemfile", "ruby"), ("composer.json", "php"), ("CMakeLists.txt", "cpp"))
    out = None
    for name, kind in known:
        test = F.array_contains(files, name)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("unknown")
