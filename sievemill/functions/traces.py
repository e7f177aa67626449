"""Source locations in stack traces of nine languages, as arrays of struct(file, line)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions.noise import any_of, is_noise

PATH = r"[a-zA-Z0-9_\-/\.]+"
# Classes whose JVM frames are never locations.
JVM_CLASSES = ("org.springframework.", "org.apache.", "org.hibernate.", "org.eclipse.jetty.", "jakarta.", "javax.", "io.netty.", "io.undertow.", "com.zaxxer.hikari.", "java.base/", "java.lang.reflect.", "jdk.internal.", "sun.reflect.", "sun.misc.", "kotlinx.coroutines.", "org.junit.", "org.testng.", "org.mockito.")


def has(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


@dataclass(frozen=True)
class Language:
    """How traces of a language are told and read. pairs: (file group, line group), the first that matched counts."""

    name: str
    detect: Callable[[Column], Column]
    pattern: str
    pairs: tuple[tuple[int, int], ...] = ((1, 2),)
    drops_noise: bool = True
    class_group: int | None = None


#: In the order in which the union takes them.
LANGUAGES: tuple[Language, ...] = (
    Language("rust", lambda t: has(t, "panicked at", ".rs:"), rf"({PATH}\.rs):(\d+)", drops_noise=False),
    Language("python", lambda t: has(t, "Traceback (most recent call last):", 'File "', '.py", line ', ".py:", ".pyi:", ".pyx:"), rf'(?:File\s+"([^"]+\.(?:py|pyi|pyx))",\s+line\s+(\d+)|(?:\A|\s+|at\s+)({PATH}\.(?:py|pyi|pyx)):(\d+))', pairs=((1, 2), (3, 4))),
    Language("js", lambda t: has(t, "Error:", "TypeError:", "ReferenceError:", "SyntaxError:", "UnhandledPromiseRejection") & has(t, "at ", ".js:", ".ts:", ".tsx:", ".jsx:"), r"(?:\(|at\s+)(?:file://|webpack:///)?([a-zA-Z0-9_@\-/\.]+\.(?:m?js|cjs|ts|tsx|jsx|mts|cts)):(\d+)"),
    Language("go", lambda t: has(t, "panic:", "goroutine ", ".go:"), rf"({PATH}\.go):(\d+)"),
    Language("java", lambda t: has(t, "Exception", "\tat ", "Caused by:"), rf"(?:at\s+([a-zA-Z0-9_\-/\.$]+)\s*)?\(({PATH}\.(?:java|kt)):(\d+)\)", pairs=((2, 3),), class_group=1),
    Language("cpp", lambda t: has(t, "AddressSanitizer", "Segmentation fault", "core dumped", ".cpp:", ".cc:", ".cxx:"), rf"(?:at\s+|\s+)({PATH}\.(?:cpp|cc|cxx|c|hpp|h)):(\d+)"),
    Language("php", lambda t: has(t, "Fatal error:", "Uncaught ") | has(t, "Stack trace:") & has(t, ".php"), rf"(?:in\s+|\s+)({PATH}\.php)(?::|\()(\d+)", drops_noise=False),
    Language("csharp", lambda t: has(t, ".cs:line ") | has(t, "Exception:") & has(t, " in ") & has(t, ".cs"), r"(?:in\s+|\s+)([a-zA-Z0-9_\-/\.\\:]+\.cs):line\s+(\d+)"),
    Language("ruby", lambda t: has(t, ".rb:") & has(t, ":in `", ":in '", "gems/", "Error", "Exception"), rf"(?:\A|\s+|\()({PATH}\.rb):(\d+)(?::in|:|\))"),
)
BY_NAME = {x.name: x for x in LANGUAGES}
EMPTY = "array<struct<file:string,line:bigint>>"


def locations(text: Column, language: str) -> Column:
    """Locations in order of appearance, repeats included; empty if the language isn't detected.

    Line numbers that don't fit a bigint are dropped."""
    x = BY_NAME[language]
    pattern = "(?U)" + x.pattern
    # one pass over the text; groups are then read from the matches, which are short
    groups = [*([x.class_group] if x.class_group is not None else []), *(g for pair in x.pairs for g in pair)]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.transform(matches, lambda m: F.struct(*[F.regexp_extract(m, pattern, g).alias(f"g{g}") for g in groups]))
    if x.class_group is not None:
        found = F.filter(found, lambda m: ~m[f"g{x.class_group}"].rlike(rf"\A(?:{any_of(JVM_CLASSES)})"))

    def location(m: Column) -> Column:
        out = None
        for f, n in x.pairs:
            value = F.struct(m[f"g{f}"].alias("file"), m[f"g{n}"].try_cast("bigint").alias("line"))
            out = F.when(m[f"g{f}"] != "", value) if out is None else out.when(m[f"g{f}"] != "", value)
        return out

    found = F.filter(F.transform(found, location), lambda l: l.isNotNull() & l["line"].isNotNull())  # noqa: E741
    if x.drops_noise:
        found = F.filter(found, lambda l: ~is_noise(l["file"]))  # noqa: E741
    return F.when(x.detect(text), found.cast(EMPTY)).otherwise(F.array().cast(EMPTY))


def all_locations(text: Column) -> Column:
    """Distinct locations of all languages, the first of equal ones stays."""
    return F.array_distinct(F.concat(*[locations(text, x.name) for x in LANGUAGES]))


def some(found: Column) -> Column:
    """A row for a non-empty array, none for an empty one. (A filter on it would compute it a second time.)"""
    return F.explode(F.filter(F.array(found), lambda l: F.size(l) > 0))  # noqa: E741
