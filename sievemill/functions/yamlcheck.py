"""Whether a YAML text is well formed: block structure by a stack of indents, flow collections by a stack of brackets.

Known: documents, directives, comments, anchors and aliases, tags, quoted and plain scalars over several lines, block
scalars, explicit keys. Refused: tabs in indents, indents that no open block has, a list item among keys or the other way
round, two values on a line ("a: b: c"), text after a closed value, what isn't closed, equal keys, unknown aliases, and
plain scalars that begin with a reserved sign.
"""

from __future__ import annotations

import re
from itertools import accumulate

MAX_DEPTH = 128
_KEY = re.compile(r"""(?:"(?:\\.|[^"\\])*"|'(?:''|[^'])*'|(?![-?:](?:\s|$))[^\s#&*!|>'"%@`,\[\]{}](?:[^:#]|:(?=\S)|(?<=\S)\#)*?)\s*:(?=\s|$)""")
_LEAD = re.compile(r"(?:[&!][^\s,\[\]{}]*|!<[^>]*>)(?:\s+|$)")
_QUOTED = re.compile(r'''"(?:\\[\s\S]|[^"\\])*"|'(?:''|[^'])*\'''')
_FLOW = re.compile(r"""(?P<skip>\s+|(?<=\s)\#[^\n]*)|(?P<quoted>"(?:\\[\s\S]|[^"\\])*"|'(?:''|[^'])*')|(?P<sign>[\[\]{},])|(?P<colon>:(?=[\s,\[\]{}]|$)|(?<=["'\]}]):|\?(?=\s))|(?P<plain>(?:[^\s,\[\]{}:\#]|:(?=[^\s,\[\]{}])|(?<=\S)\#)(?:[^,\[\]{}:\#\n]|:(?=[^\s,\[\]{}])|(?<=\S)\#)*)""")


class Bad(ValueError):
    """Why and at which line (from 0) a text isn't YAML."""

    def __init__(self, line: int, what: str) -> None:
        super().__init__(f"line {line + 1}: {what}")


class Reader:
    def __init__(self, text: str) -> None:
        self.rows = [r.removesuffix("\r") for r in text.split("\n")]
        #: All rows as one text and where each begins: values over several lines are matched there, in place.
        self.text = "\n".join(self.rows)
        self.begin = list(accumulate((len(r) + 1 for r in self.rows), initial=0))
        self.i = 0
        self.stack: list[tuple[int, str, set[str]]] = []  # indent, kind (map, list), keys so far
        self.anchors: set[str] = set()
        self.open_value = -1  # indent of the key or item that still waits for its value

    def check(self) -> None:
        while self.i < len(self.rows):
            row = self.rows[self.i]
            body = row.lstrip(" ")
            if re.match(r"(---|\.\.\.)(\s|$)", row):
                self.stack, self.anchors, self.open_value = [], set(), -1
                rest = row[3:].strip()
                if rest and not rest.startswith("#"):
                    self.value(rest, row.index(rest, 3), -1)
                else:
                    self.i += 1
            elif not body.strip() or body.startswith("#") or row.startswith("%") and not self.stack:
                if "\t" in row[: len(row) - len(row.lstrip())] and body.strip():
                    raise Bad(self.i, "tab in indent")
                self.i += 1
            elif body.startswith("\t"):
                raise Bad(self.i, "tab in indent")
            else:
                self.node(len(row) - len(body), len(row) - len(body))

    def enter(self, indent: int, kind: str) -> set[str]:
        """Keys so far of the block at an indent, which is opened if it may be."""
        while self.stack and self.stack[-1][0] > indent:
            self.stack.pop()
        top = self.stack[-1] if self.stack else (-1, "", set())
        if top[0] == indent and top[1] == kind:
            return top[2]
        list_of_key = top[0] == indent and top[1] == "map" and kind == "list" and self.open_value == indent
        if top[0] == indent and top[1] == "list" and kind == "map" and len(self.stack) > 1 and self.stack[-2][:2] == (indent, "map"):
            self.stack.pop()
            return self.stack[-1][2]
        if not list_of_key and (top[0] == indent or top[0] >= 0 and self.open_value < 0 or not self.stack and self.open_value == -2):
            raise Bad(self.i, "unexpected indent or kind of block")
        if len(self.stack) >= MAX_DEPTH:
            raise Bad(self.i, "nesting is too deep")
        self.stack.append((indent, kind, set()))
        return self.stack[-1][2]

    def node(self, indent: int, at: int) -> None:
        """What begins at a column, in the block of an indent: an item, a key or a scalar."""
        row = self.rows[self.i]
        rest = row[at:]
        if re.match(r"-(\s|$)", rest):
            self.enter(indent, "list")
            inner = re.match(r"-\s*", rest).end()
            if not rest[inner:] or rest[inner] == "#":
                self.open_value = indent
                self.i += 1
            elif self.is_block(rest[inner:]):
                self.open_value = indent
                self.node(at + inner, at + inner)
            else:
                self.value(rest[inner:], at + inner, indent)
            return
        if re.match(r"\?(\s|$)", rest):
            self.enter(indent, "map")
            self.open_value = indent
            inner = re.match(r"\?\s*", rest).end()
            if not rest[inner:]:
                self.i += 1
            else:
                self.value(rest[inner:], at + inner, indent)
            return
        lead = 0
        while m := _LEAD.match(rest, lead):
            lead = m.end()
        self.note(rest[:lead])
        m = re.compile(r":(?=\s|$)").match(rest) or self.key(rest[lead:])
        if m:
            keys = self.enter(indent, "map")
            name = m[0][:-1].strip()
            if name and name in keys and name != "<<":
                raise Bad(self.i, f"duplicate key {name[:40]}")
            keys.add(name)
            after = rest[lead:][m.end() :] if name else rest[m.end() :]
            value = after.strip()
            self.open_value = indent
            if not value or value.startswith("#"):
                self.i += 1
            else:
                self.value(value, len(row) - len(after.lstrip()), indent)
            return
        if self.stack and self.open_value < 0:
            raise Bad(self.i, "no key")
        if self.stack and indent <= self.stack[-1][0] and rest[0] not in "]}":
            raise Bad(self.i, "value isn't indented")
        self.value(rest, at, self.stack[-1][0] if self.stack else -1)

    def key(self, rest: str) -> re.Match | None:
        if rest[:1] in "[{":
            return None
        m = _KEY.match(rest)
        return m

    def is_block(self, rest: str) -> bool:
        while m := _LEAD.match(rest):
            rest = rest[m.end() :]
        return bool(re.match(r"[-?](\s|$)", rest) or self.key(rest))

    def note(self, lead: str) -> None:
        self.anchors |= set(re.findall(r"&([^\s,\[\]{}]+)", lead))

    def value(self, rest: str, at: int, indent: int) -> None:
        """A value that begins on this line, in a block of an indent; goes on to the line after its end."""
        line, self.open_value = self.i, -1 if self.stack else -2
        m = re.match(r"(?:(?:[&!][^\s,\[\]{}]*|!<[^>]*>)\s+)*(?:[&!][^\s,\[\]{}]*$)?", rest)
        self.note(m[0])
        rest, at = rest[m.end() :], at + m.end()
        if not rest or rest.startswith("#"):
            self.open_value = indent
            self.i += 1
        elif re.match(r"[|>][-+0-9]*\s*(?:\s\#.*)?$", rest):
            self.i += 1
            while self.i < len(self.rows) and (not self.rows[self.i].strip() or len(self.rows[self.i]) - len(self.rows[self.i].lstrip(" ")) > indent):
                self.i += 1
        elif rest[0] == "*":
            name = re.match(r"\*([^\s,\[\]{}]+)\s*(?:\#.*)?$", rest)
            if not name or name[1] not in self.anchors:
                raise Bad(line, "unknown alias")
            self.i += 1
        elif rest[0] in "[{":
            self.flow(at)
        elif rest[0] in "\"'":
            m = _QUOTED.match(self.text, self.begin[line] + at)
            if not m:
                raise Bad(line, "quote isn't closed")
            self.end_at(line, m.end())
        elif rest[0] in "@`%,]}" or rest[0] == ":" and not rest[1:2].strip():
            raise Bad(line, f"unexpected {rest[0]!r}")
        else:
            self.plain(rest, indent)

    def plain(self, rest: str, indent: int) -> None:
        while True:
            bare = re.split(r"\s\#", rest, maxsplit=1)
            if re.search(r":(?:\s|$)", bare[0]):
                raise Bad(self.i, "a value within a value")
            self.i += 1
            ahead = self.i
            while ahead < len(self.rows) and not self.rows[ahead].strip():
                ahead += 1
            if len(bare) > 1 or ahead >= len(self.rows):
                return
            row = self.rows[ahead]
            body = row.lstrip(" ")
            if len(row) - len(body) <= indent or body.startswith("#") or re.match(r"(---|\.\.\.)(\s|$)", row):
                return
            self.i, rest = ahead, body

    def end_at(self, line: int, end: int) -> None:
        """What follows a closed value on its line may be a comment only."""
        stop = self.text.find("\n", end)
        tail = self.text[end : stop if stop >= 0 else len(self.text)]
        self.i = line + self.text.count("\n", self.begin[line], end)
        if not re.match(r"\s*(?:$|\s\#)", tail):
            raise Bad(self.i, f"unexpected {tail.strip()[:20]!r}")
        self.i += 1

    def flow(self, at: int) -> None:
        line, here, text, stack, last = self.i, self.i, self.text, [], ""
        at = seen = self.begin[line] + at
        while True:
            m = _FLOW.match(text, at)
            here, seen = here + text.count("\n", seen, at), at
            if not m:
                raise Bad(here, "bracket isn't closed" if at >= len(text) else f"unexpected {text[at]!r}")
            kind, at = m.lastgroup, m.end()
            if kind == "skip":
                continue
            sign = m[0] if kind == "sign" else kind
            if kind == "plain" and m[0][0] == "*" and m[0][1:].strip() not in self.anchors:
                raise Bad(here, "unknown alias")
            if kind == "plain" and (m[0][0] in "@`%" or m[0][0] in "|>" and len(m[0].strip()) == 1):
                raise Bad(here, f"unexpected {m[0][0]!r}")
            self.note(m[0] if kind == "plain" else "")
            if sign in ("plain", "quoted", "[", "{") and last in ("plain", "quoted", "]", "}") and not (last == "plain" and (sign == "plain" or tagged)):
                raise Bad(here, "',' or a bracket is missing")
            if sign == "," and last in ("", ",", "[", "{"):
                raise Bad(here, "unexpected ','")
            if sign in ("[", "{"):
                stack.append(sign)
                if len(stack) > MAX_DEPTH:
                    raise Bad(here, "nesting is too deep")
            elif sign in ("]", "}"):
                if not stack or {"[": "]", "{": "}"}[stack.pop()] != sign:
                    raise Bad(here, f"unexpected {sign!r}")
                if not stack:
                    self.end_at(line, at)
                    return
            last, tagged = sign, kind == "plain" and m[0][0] in "&!"


def yaml_error(text: str) -> str | None:
    """Why a text isn't well-formed YAML; null if it is."""
    try:
        Reader(text.removeprefix("\ufeff")).check()
    except Bad as e:
        return str(e)
    return None
