"""Static checks of code snippets: five rules over Python, JavaScript/TypeScript and Rust.

Python is parsed with ast; code that doesn't parse is cut back to the part before the error, once. The other languages are
read as tokens. Deviations from a full syntax tree: limits are on ast's nodes and nesting, and on tokens and brackets.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions.tokens import MAX_DEPTH, MAX_TOKENS, TooMuch, js_tokens, partners, rust_tokens, without_macros

MAX_BYTES = 1 << 20
KIND = "struct<status:string,error:string,language:string,total_findings:int,findings:array<struct<rule:string,severity:string,message:string,line:int,`column`:int,snippet:string>>>"
# Names of languages, rules and messages.
LANGUAGES = {"python": "python", "py": "python", "javascript": "js", "js": "js", "mjs": "js", "cjs": "js", "typescript": "js", "ts": "js", "mts": "js", "cts": "js", "tsx": "js", "rust": "rust", "rs": "rust"}
OPEN = ("python/unclosed-open", "warning", "Resource leak hazard: 'open()' called without 'with' statement, 'contextlib.closing', or 'try ... finally: close()'")
EXEC = ("python/dangerous-exec-eval", "error", "Security Hazard (CWE-95): Unsafe dynamic execution via built-in '{}()'")
EVAL = ("javascript/dangerous-eval", "error", "Security Hazard (CWE-95): Unsafe dynamic execution via '{}()'")
NEW = ("javascript/dangerous-eval", "error", "Security Hazard (CWE-95): Unsafe dynamic execution via 'new Function()' constructor")
DEBUGGER = ("javascript/no-debugger", "warning", "Code Quality Hazard (CWE-489): Active 'debugger;' breakpoint statement left in production code")
PANIC = ("rust/explicit-panic", "warning", "Reliability Hazard: Explicit '{}!()' macro invocation in code")

Finding = tuple[str, str, str, int, int, str]


def utf16_column(prefix: str) -> int:
    """Column, from 1, of what follows prefix on its line, in UTF-16 units."""
    return len(prefix.encode("utf-16-le", "surrogatepass")) // 2 + 1


def finding(kind: tuple[str, str, str], name: str, code: str, at: int, end: int) -> Finding:
    start = code.rfind("\n", 0, at) + 1
    text = code[at:end]
    return (kind[0], kind[1], kind[2].format(name), code.count("\n", 0, at) + 1, utf16_column(code[start:at]), text.split("\n")[0].rstrip("\r"))


# Python


def parsed(code: str) -> ast.Module | None:
    for _ in range(2):
        try:
            return ast.parse(code)
        except SyntaxError as e:
            rows = code.split("\n")
            code = "\n".join(rows[: max(0, (e.lineno or 1) - 1)])
        except (ValueError, RecursionError, MemoryError):
            return None
    return None


def paths(tree: ast.AST) -> Iterator[tuple[ast.AST, tuple[ast.AST, ...]]]:
    """Nodes in the order of the source, each with its ancestors, the nearest last."""
    todo, seen = [(tree, ())], 0
    while todo:
        node, above = todo.pop()
        seen += 1
        if seen > MAX_TOKENS:
            raise TooMuch(f"AST node count limit exceeded (visited > {MAX_TOKENS} nodes)")
        if len(above) > MAX_DEPTH:
            raise TooMuch(f"AST nesting depth limit exceeded (depth > {MAX_DEPTH})")
        yield node, above
        todo.extend((c, (*above, node)) for c in reversed(list(ast.iter_child_nodes(node))))


def names_open(node: ast.AST) -> bool:
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return node.name == "open"
    return isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "open" for t in node.targets)


def closes(statements: list[ast.stmt], name: str) -> bool:
    calls = (n for s in statements for n in ast.walk(s) if isinstance(n, ast.Call))
    return any(isinstance(c.func, ast.Attribute) and c.func.attr == "close" and isinstance(c.func.value, ast.Name) and c.func.value.id == name for c in calls)


def bodies(node: ast.AST) -> Iterator[list[ast.stmt]]:
    for key in ("body", "orelse", "finalbody"):
        rows = getattr(node, key, None)
        if isinstance(rows, list):
            yield rows


def managed(call: ast.Call, above: tuple[ast.AST, ...]) -> bool:
    """In a with statement, an argument of ...closing(), or assigned to a name that a finally clause closes."""
    if any(isinstance(a, (ast.With, ast.AsyncWith)) for a in above):
        return True
    outer = above[-1] if above else None
    if isinstance(outer, ast.Call) and call in outer.args and ast.unparse(outer.func).endswith("closing"):
        return True
    holder = next((a for a in reversed(above) if isinstance(a, (ast.Assign, ast.AnnAssign, ast.FunctionDef, ast.AsyncFunctionDef, ast.Module))), None)
    target = holder.targets[0] if isinstance(holder, ast.Assign) else getattr(holder, "target", None)
    if not isinstance(target, ast.Name):
        return False
    line = [*above, call]
    for i, a in enumerate(above):
        if isinstance(a, ast.Try) and closes(a.finalbody, target.id):
            return True
        for rows in bodies(a):
            if line[i + 1] in rows:
                later = rows[rows.index(line[i + 1]) + 1 :]
                if any(isinstance(s, ast.Try) and closes(s.finalbody, target.id) for s in later):
                    return True
    return False


def lint_python(code: str) -> list[Finding]:
    tree = parsed(code)
    if tree is None:
        return []
    rows = list(paths(tree))
    shadowed = {id(above[-1]) for node, above in rows if above and names_open(node)}
    starts = [0]
    for r in code.split("\n"):
        starts.append(starts[-1] + len(r) + 1)
    lines = code.split("\n")

    def place(line: int, col: int) -> int:
        return starts[line - 1] + len(lines[line - 1].encode()[:col].decode("utf-8", "ignore"))

    unclosed, executed = [], []
    for node, above in rows:
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            at, end, name = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset), node.func.id
            if name in ("eval", "exec"):
                executed.append(finding(EXEC, name, code, at, end))
            elif name == "open" and not any(id(a) in shadowed for a in above) and not managed(node, above):
                unclosed.append(finding(OPEN, name, code, at, end))
    return unclosed + executed


# JavaScript, TypeScript, Rust


def lint_js(code: str) -> list[Finding]:
    tokens = list(js_tokens(code))
    ends, calls, stops = partners(tokens), [], []
    text = lambda i: tokens[i].text if 0 <= i < len(tokens) else ""
    for i, t in enumerate(tokens):
        if t.kind != "name" or t.text not in ("eval", "Function", "debugger") or text(i - 1) in (".", "?.", "function") or text(i - 1) == "*" and text(i - 2) == "function":
            continue
        at = i + 1 + (text(i + 1) == "?.")
        if t.text == "debugger" and text(i + 1) not in (":", "=", ".", "(", ",", ")", "]"):
            stops.append(finding(DEBUGGER, "", code, t.at, tokens[i + 1].end if text(i + 1) == ";" else t.end))
        elif t.text == "Function" and text(i - 1) == "new" and text(i + 1) not in (".", "?.", "["):
            calls.append(finding(NEW, t.text, code, tokens[i - 1].at, tokens[ends[at]].end if text(at) == "(" else t.end))
        elif t.text in ("eval", "Function") and text(i - 1) not in ("new", "class"):
            if text(at) == "(" and text(ends[at] + 1) != "{":
                calls.append(finding(EVAL, t.text, code, t.at, tokens[ends[at]].end))
            elif text(at)[:1] == "`":
                calls.append(finding(EVAL, t.text, code, t.at, tokens[at].end))
    return calls + stops


def lint_rust(code: str) -> list[Finding]:
    """Macros inside another macro's brackets are that macro's business, not invocations in the code."""
    tokens = list(rust_tokens(code))
    whole = partners(tokens)
    ends = {tokens[a].at: tokens[b].end for a, b in whole.items()}
    tokens, out = without_macros(tokens, whole), []
    for i, t in enumerate(tokens[:-2]):
        if t.kind == "name" and t.text in ("panic", "todo", "unimplemented") and tokens[i + 1].text == "!" and tokens[i + 2].text in ("(", "[", "{"):
            first = i
            while first >= 1 and tokens[first - 1].text == "::":
                first -= 2 if first >= 2 and tokens[first - 2].kind == "name" else 1
            out.append(finding(PANIC, t.text, code, tokens[first].at, ends[tokens[i + 2].at]))
    return out


RULES: dict[str, list[Callable[[str], list[Finding]]]] = {"python": [lint_python], "js": [lint_js], "rust": [lint_rust]}


def register(language: str, rule: Callable[[str], list[Finding]]) -> None:
    """Adds a rule of one's own for 'python', 'js' or 'rust'."""
    RULES[language].append(rule)


def analyze(language: str, code: str) -> tuple:
    kind = LANGUAGES.get(language.lower())
    size = len(code.encode())
    if size > MAX_BYTES:
        return "error", f"Payload too large: {size} bytes (max: {MAX_BYTES} bytes)", language, 0, []
    if kind is None:
        return "error", f"Unsupported language: '{language.lower()}'", language, 0, []
    try:
        found = [f for rule in RULES[kind] for f in rule(code)]
    except TooMuch as e:
        return "error", str(e), language, 0, []
    return "ok", None, language, len(found), [dict(zip(("rule", "severity", "message", "line", "column", "snippet"), f, strict=True)) for f in found]


def lint(language: Column, code: Column) -> Column:
    """struct(status, error, language, total_findings, findings) of snippets; null for null code.

    It counts as nondeterministic, so that no rule of the optimizer has it run twice (as filters inferred from an explode do)."""

    @F.pandas_udf(KIND)
    def run(languages: pd.Series, codes: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 5 if c is None else analyze(x or "", c) for x, c in zip(languages, codes, strict=True)]
        return pd.DataFrame(rows, columns=["status", "error", "language", "total_findings", "findings"]).astype({"total_findings": "Int32"})

    return run.asNondeterministic()(language, code)
