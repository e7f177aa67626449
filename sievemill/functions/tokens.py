"""Tokens of JavaScript, TypeScript and Rust: small lexers with a stack of modes, and a check of how tokens may follow.

A lexer skips comments (Rust's nest) and white space. In JavaScript a slash begins a regular expression or divides,
depending on the token before it, and a template goes on after the bracket that closes its ``${``. What can't be a token is
one of kind "bad". Limits: nesting of brackets and number of tokens; passing one raises TooMuch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

MAX_TOKENS, MAX_DEPTH = 50_000, 128
CLOSES = {"(": ")", "[": "]", "{": "}", "${": "}"}


class TooMuch(Exception):
    """A limit is passed."""


class Token(NamedTuple):
    kind: str  # name, number, string, regex, lifetime, op or bad
    text: str
    at: int
    end: int


# One match takes white space and comments, then a token, in the group that is its kind.
_STRINGS = r"""\"(?:\\[\s\S]|[^"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*'"""
_JS = re.compile(rf"""(?>\s+|//[^\n]*|/\*[\s\S]*?\*/|\A\#![^\n]*)*+(?:(?P<name>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)|(?P<number>\.?\d(?:[eE][+-]|[\w.])*)|(?P<string>{_STRINGS})|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\*\*|<<|>>|[-+*/%&|^]=|[-+*/%&|^!~<>=?:;,.(){{}}\[\]])|(?P<mark>`)|(?P<bad>[\s\S]))?""")
_JS_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_JS_TEXT = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*(?P<end>`|\$\{)?")
_RUST = re.compile(r"""(?>\s+|//[^\n]*)*+(?:(?P<string>[bc]?r(?P<h>\#*)"[\s\S]*?"(?P=h)|[bc]?"(?:\\[\s\S]|[^"\\])*"|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])')|(?P<lifetime>'\w+)|(?P<name>(?:r\#)?[^\W\d]\w*)|(?P<number>\d(?:\w|\.(?=\d)|(?<=[eE])[+-](?=\d))*)|(?P<op>\.\.=|\.\.\.|<<=|>>=|=>|->|==|!=|<=|>=|&&|\|\||::|\.\.|[-+*/%&|^]=|[-+*/%&|^!<>=?:;,.\#$@~(){}\[\]])|(?P<bad>[\s\S]))?""")
# Keywords, as the languages define them: those after which an expression begins, and the others.
JS_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new instanceof do else yield await extends default".split())
JS_WORDS = JS_BEFORE_VALUE | frozenset("let const var function class if for while switch try catch finally import export from as async static get set type interface enum declare abstract readonly namespace module public private protected implements keyof infer is asserts satisfies override unique break continue with super this accessor global".split())
RUST_WORDS = frozenset("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct super trait type union unsafe use where while auto default raw macro_rules safe gen yield box".split())


def js_tokens(code: str, max_depth: int = MAX_DEPTH) -> Iterator[Token]:
    at, last, stack, n = 0, None, [], 0
    before_last = None

    def value_next() -> bool:
        """Whether an expression may begin here, so that a slash begins a regular expression."""
        if last is None or last.kind == "bad":
            return True
        if last.kind == "string":
            return last.text.endswith("${")
        if last.kind == "name":
            return last.text in JS_BEFORE_VALUE and not (before_last and before_last.text in (".", "?."))
        if last.kind != "op":
            return False
        return opened if last.text in ")}" else last.text not in ("]", "++", "--")

    def template(at: int) -> Token:
        """A piece of a template's text, from the mark at a place; its own text is the marks at its ends."""
        m = _JS_TEXT.match(code, at + 1)
        if m["end"] == "${":
            stack.append(("${", True))
        return Token("string" if m["end"] else "bad", code[at] + (m["end"] or ""), at, m.end())

    opened = False  # whether the bracket that was closed last was one after which a statement begins
    while True:
        m = _JS.match(code, at)
        kind = m.lastgroup
        if kind is None:
            return
        start = m.start(kind)
        token = Token(kind, m[kind], start, m.end())
        if kind == "op":
            text = token.text
            if text[0] == "/":
                if code.startswith("/*", start):
                    token = Token("bad", "/*", start, start + 2)
                elif value_next() and (r := _JS_REGEX.match(code, start)):
                    token = Token("regex", r[0], start, r.end())
            elif text == "(":
                stack.append(("(", last is not None and last.text in ("if", "while", "for", "with")))
            elif text == "{":
                stack.append(("{", last is None or last.text in (";", "{", "}", ")", "=>", "else", "do", "try", "finally") or last.kind == "name" and last.text not in JS_BEFORE_VALUE))
            elif text == "[":
                stack.append(("[", False))
            elif text in ")]}" and stack:
                if text == "}" and stack[-1][0] == "${":
                    stack.pop()
                    token = template(start)
                elif CLOSES[stack[-1][0]] == text:
                    opened = stack.pop()[1]
        elif kind == "mark":
            token = template(start)
        n += 1
        if len(stack) > max_depth:
            raise TooMuch(f"AST nesting depth limit exceeded (depth > {max_depth})")
        if n > MAX_TOKENS:
            raise TooMuch(f"AST node count limit exceeded (visited > {MAX_TOKENS} nodes)")
        yield token
        before_last, last, at = last, token, token.end


def nested_comment(code: str, at: int) -> int:
    """Where a Rust comment that begins at a place ends; 0 if it doesn't."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(code, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return 0


def rust_tokens(code: str, max_depth: int = MAX_DEPTH) -> Iterator[Token]:
    at, depth, n = 0, 0, 0
    while True:
        m = _RUST.match(code, at)
        kind = m.lastgroup
        if kind is None:
            return
        start, at = m.start(kind), m.end()
        token = Token(kind, m[kind], start, at)
        if kind == "op":
            if token.text in "([{":
                depth += 1
            elif token.text in ")]}":
                depth -= 1
            elif code.startswith("/*", start):
                at = nested_comment(code, start)
                if at:
                    continue
                at = start + 2
                token = Token("bad", "/*", start, at)
        n += 1
        if depth > max_depth:
            raise TooMuch(f"AST nesting depth limit exceeded (depth > {max_depth})")
        if n > MAX_TOKENS:
            raise TooMuch(f"AST node count limit exceeded (visited > {MAX_TOKENS} nodes)")
        yield token


def partners(tokens: list[Token]) -> dict[int, int]:
    """By index of an opening bracket: that of the bracket that closes it, or of the last token."""
    out, stack = {}, []
    for i, t in enumerate(tokens):
        if t.kind == "op" and t.text in CLOSES:
            stack.append(i)
        elif t.kind == "op" and t.text in (")", "]", "}") and stack:
            out[stack.pop()] = i
    return out | dict.fromkeys(stack, len(tokens) - 1)


def without_macros(tokens: list[Token], ends: dict[int, int]) -> list[Token]:
    """Rust's tokens without what stands in macros' brackets and in attributes: there it needn't be Rust. ends: partners."""
    text, out, i = [t.text for t in tokens] + ["", "", ""], [], 0
    while i < len(tokens):
        t, at = tokens[i], None
        out.append(t)
        if text[i + 1] == "!" and t.kind == "name" and (t.text not in RUST_WORDS or t.text == "macro_rules"):
            at = i + 2 if text[i + 2] in CLOSES else i + 3 if t.text == "macro_rules" and text[i + 3] in CLOSES else None
        elif t.text == "#" and t.kind == "op":
            at = i + 1 if text[i + 1] == "[" else i + 2 if text[i + 1 : i + 3] == ["!", "["] else None
        if at is not None:
            out += tokens[i + 1 : at + 1]
            if ends[at] > at:
                out.append(tokens[ends[at]])
            i = ends[at]
        i += 1
    return out


#: Operators that need something on both sides, in both languages.
BOTH_SIDES = frozenset("= == === != !== <= >= % ** += -= *= /= %= &&= ||= ??= **= ?.".split())
#: What can't stand before these.
NOT_BEFORE = BOTH_SIDES | frozenset("( [ { , ; + - / ~ ? : => && || ??".split())


def grammar_error(tokens: list[Token], code: str, words: frozenset[str]) -> str | None:
    """The first place at which tokens can't follow one another, as line:column and what is wrong; null if there is none."""

    def place(t: Token, what: str) -> str:
        return f"line {code.count(chr(10), 0, t.at) + 1}:{t.at - code.rfind(chr(10), 0, t.at)} ({what})"

    stack, last = [], None
    for t in tokens:
        if t.kind == "bad":
            return place(t, f"unexpected {t.text!r}")
        op = t.text if t.kind == "op" else ""
        before = last.text if last and last.kind == "op" else ""
        if op in BOTH_SIDES and (last is None or before in NOT_BEFORE or last.kind == "name" and last.text in ("let", "const", "var", "return")):
            return place(t, f"unexpected {op!r}")
        if before in BOTH_SIDES and op in (")", "]", "}", ";", ","):
            return place(t, f"nothing after {before!r}")
        if last and {t.kind, last.kind} <= {"name", "number", "string"} and "\n" not in code[last.end : t.at] and not {t.text, last.text} & words:
            if not (last.text[0] == "@" or last.text.endswith("${") or t.text in ("}`", "}${") or t.text[0] == "`"):
                return place(t, f"unexpected {t.text[:20]!r}")
        if op in CLOSES:
            stack.append(t)
        elif op in (")", "]", "}") and (not stack or CLOSES[stack.pop().text] != op):
            return place(t, f"unexpected {op!r}")
        last = t
    if stack:
        return place(stack[-1], f"missing {CLOSES[stack[-1].text]!r}")
    return place(last, f"nothing after {last.text!r}") if last and last.kind == "op" and last.text in BOTH_SIDES else None


def js_error(code: str) -> str | None:
    """Why JavaScript isn't well formed. With JSX in it, whose texts are free, only the part before the first tag is judged."""
    tokens, last = [], None
    for t in js_tokens(code):
        if t.text == "<" and t.kind == "op" and (last is None or last.kind == "op" and last.text in ("(", "=", "=>", "?", ":", "&&", "||", ",") or last.text == "return") and re.match(r"<(?:>|[A-Za-z][\w.]*(?:\s+[\w-]+=|\s*/?>))", code[t.at :]):
            return None
        tokens.append(t)
        last = t
    open_ = sum(t.kind == "string" and (t.text[-2:] == "${") - (t.text[0] == "}") for t in tokens)
    return grammar_error(tokens, code, JS_WORDS) or ("template isn't closed" if open_ else None)


def rust_error(code: str) -> str | None:
    tokens = list(rust_tokens(code))
    return grammar_error(without_macros(tokens, partners(tokens)), code, RUST_WORDS)
