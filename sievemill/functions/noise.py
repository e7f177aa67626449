"""Framework noise: which lines of a log are frames of frameworks and runtimes, what they belong to, and pruning."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions.text import let, lines

# What marks a line as noise.
COMPONENTS = ("node_modules", "site-packages", "dist-packages", "venv", ".venv", "vendor", "gems", "__pycache__", "vcpkg_installed", ".gradle", ".cargo/registry", ".rustup", "pkg/mod", "go/src", ".m2/repository", "usr/include", "usr/lib", "target/debug/build", "lib/python", "internal/modules", "rustc")
RUNTIME = ("node:internal/", "<frozen ", "asyncio/base_events", "asyncio/events.py", "starlette/routing", "uvicorn/protocols/", "gunicorn/workers/", "build/glibc-", "system.private.corelib", "microsoft.aspnetcore.")
FRAMES = ("org.springframework.", "org.apache.catalina.", "org.apache.tomcat.", "org.apache.coyote.", "org.hibernate.", "org.eclipse.jetty.", "jakarta.servlet.", "javax.servlet.", "io.netty.", "io.undertow.", "com.zaxxer.hikari.", "java.base/", "java.lang.reflect.", "jdk.internal.", "sun.reflect.", "kotlinx.coroutines.", "org.junit.", "System.", "Microsoft.AspNetCore.")
NATIVE = ("__libc_start_main", "__libc_start_call_main", "libc-start.c", "libc_start_call_main.h", "/lib/x86_64-linux-gnu/libc.so", "/lib/x86_64-linux-gnu/libasan.so", "/usr/lib/x86_64-linux-gnu/libasan.so", "/usr/lib/x86_64-linux-gnu/libstdc++.so", "libasan.so", "libstdc++.so", "__sanitizer::", "__asan::", "__asan_", "(/lib/x86_64-linux-gnu/", "(/usr/lib/x86_64-linux-gnu/", "sysdeps/nptl/")
IDLE = ("[force gc (idle)]", "[GC sweep wait]", "[GC scavenge wait]", "[finalizer wait]", "[scavenge wait]", "[select (no cases)]")
SCHEDULER = ("gopark(", "forcegchelper(", "goexit(", "gcBgMarkWorker(", "bgsweep(", "bgscavenge(", "runfinq(")
BORDER = r"""[/\\ \t"'()\[\]:\r\n]"""

any_of = lambda words: "|".join(re.escape(w) for w in words)
COMPONENT = rf"(?:\A|{BORDER})(?:{any_of(COMPONENTS)})(?:\z|{BORDER})"
#: On the lower-cased line with / for \, and on the line as it is; both in syntax common to Java and RE2.
LOWER_NOISE = rf"{COMPONENT}|{any_of(RUNTIME)}"
PLAIN_NOISE = rf"\A\s*at (?:{any_of(FRAMES)})|\A\s*\.\.\. (?:[\s\S]*)common frames omitted\z|{any_of(NATIVE)}| in _start \(| in _start\z|{any_of(IDLE)}|\A\s*runtime\.(?:{any_of(SCHEDULER)})"
#: Every noise line matches this; most prose doesn't, and is done with after one short pattern, whose first test of a place
#: is one set of characters.
HINT = r"(?i)(?=[-/\\_\[<(.vgrac])(?:[/\\_\[<(]|\.[a-z0-9]|venv|vendor|gems|rustc|-pac|at system\.|common frames)"
IDLE_LABEL = "go:idle_goroutines"

#: Labels in order. (name, pattern, on): on "low" (lower-cased, / for \) or "raw"; group 1 extends the name.
LABELS: tuple[tuple[str, str, str], ...] = (
    ("node_modules/", r"\A[\s\S]*?node_modules/(@[^/]*/[^/]*|[^/]*)", "low"),
    ("site-packages/", r"\A[\s\S]*?site-packages/([^/]*?)(?:\.py)*(?:/|\z)", "low"),
    ("site-packages/", r"\A[\s\S]*?dist-packages/([^/]*?)(?:\.py)*(?:/|\z)", "low"),
    ("node:internal", r"node:internal/|internal/modules", "low"),
    ("python:frozen", r"<frozen ", "low"),
    ("python:asyncio", r"asyncio/", "low"),
    ("site-packages/starlette", r"starlette/", "low"),
    ("site-packages/uvicorn", r"uvicorn/", "low"),
    ("site-packages/gunicorn", r"gunicorn/", "low"),
    ("python:stdlib", r"lib/python", "low"),
    ("python:venv", rf"(?:\A|{BORDER})\.?venv(?:\z|{BORDER})", "low"),
    ("org.springframework", r"\A\s*at org\.springframework\.", "raw"),
    ("org.apache", r"\A\s*at org\.apache\.", "raw"),
    ("org.hibernate", r"\A\s*at org\.hibernate\.", "raw"),
    ("java:servlet", r"\A\s*at (?:jakarta|javax)\.", "raw"),
    ("io.netty", r"\A\s*at io\.netty\.", "raw"),
    ("java.base", r"\A\s*at java\.base/", "raw"),
    ("java:internal", r"\A\s*at (?:java\.lang\.reflect|jdk\.internal|sun\.reflect)\.", "raw"),
    ("hikari_cp", r"\A\s*at com\.zaxxer\.hikari\.", "raw"),
    ("java:common_omitted", r"\A\s*\.\.\. (?:[\s\S]*)common frames omitted\z", "raw"),
    ("dotnet:corelib", r"system\.private\.corelib", "low"),
    ("dotnet:corelib", r"\A\s*at System\.", "raw"),
    ("dotnet:aspnetcore", r"microsoft\.aspnetcore\.", "low"),
    ("cpp:asan", r"__sanitizer|libasan|__asan", "low"),
    ("cpp:libc", r"libc", "low"),
    ("cpp:libc", r"glibc", "low"),
    ("cpp:libstdc++", r"libstdc\+\+", "low"),
    ("cargo:", r"\A[\s\S]*?\.cargo/registry/src/[^/]*/([^/-]*)", "low"),
    ("cargo:registry", r"\.cargo/registry/src/", "low"),
    ("rust:std", r"\.rustup|rustc", "low"),
    ("go:stdlib", r"go/src", "low"),
    ("go:", r"\A[\s\S]*?pkg/mod/([^/]*/[^/]*)", "low"),
    ("go:pkg_mod", r"pkg/mod/", "low"),
    ("go:runtime", r"\A\s*runtime\.", "raw"),
    ("ruby:", r"\A[\s\S]*?gems/([^/-]*)", "low"),
    *((c, rf"(?:\A|{BORDER}){re.escape(c)}(?:\z|{BORDER})", "low") for c in COMPONENTS),
)


def has_component(text: Column, component: str) -> Column:
    return text.rlike(rf"(?:\A|{BORDER}){re.escape(component)}(?:\z|{BORDER})") if component else F.lit(False)


def folded(line: Column) -> Column:
    return F.translate(F.lower(line), "\\", "/")


def is_noise(line: Column, custom: Iterable[str] = ()) -> Column:
    out = line.rlike(HINT) & (folded(line).rlike(LOWER_NOISE) | line.rlike("(?U)" + PLAIN_NOISE))
    return reduce(lambda a, p: a | F.lower(line).contains(p.lower()), [p for p in custom if p], out)


def category(line: Column, custom: Iterable[str] = ()) -> Column:
    """What a noise line belongs to; null for a line that isn't noise."""
    custom = [p for p in custom if p]

    def label(low: Column) -> Column:
        out = None
        for p in custom:
            test, value = F.lower(line).contains(p.lower()), F.lit(f"custom:{p}")
            out = F.when(test, value) if out is None else out.when(test, value)
        for name, pattern, on in LABELS:
            at = low if on == "low" else line
            pattern = pattern if on == "low" else "(?U)" + pattern
            value = F.concat(F.lit(name), F.regexp_extract(at, pattern, 1)) if name[-1] in ":/" else F.lit(name)
            out = F.when(at.rlike(pattern), value) if out is None else out.when(at.rlike(pattern), value)
        return out.otherwise("framework_noise")

    return F.when(is_noise(line, custom), let(folded(line), label))


_HEAD = r"[^\S\n]*goroutine "
#: A header of an idle goroutine, then lines that are neither empty nor another header.
IDLE_BLOCK = rf"(?m)^{_HEAD}[^\n]*(?:{any_of(IDLE)})[^\n]*(?:\n|\z)(?:(?!{_HEAD})(?!\r?(?:\n|\z))[^\n]+(?:\n|\z))*"


def without_idle(text: Column) -> tuple[Column, Column]:
    """(text without blocks of idle goroutines, number of lines that these had)."""
    idle = text.rlike(any_of(IDLE))
    blocks = F.when(idle, F.regexp_extract_all(text, F.lit(IDLE_BLOCK), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.when(idle, F.regexp_replace(text, IDLE_BLOCK, "")).otherwise(text), F.size(F.flatten(F.transform(blocks, lines)))


def kept(text: Column, custom: Iterable[str] = ()) -> Column:
    """What pruned() keeps, without saying what it drops."""
    return let(text, lambda t: F.array_join(F.filter(let(without_idle(t)[0], lines), lambda x: ~is_noise(x, custom)), "\n"))


def pruned(text: Column, custom: Iterable[str] = ()) -> Column:
    """struct(kept, dropped, categories): text without noise lines; number dropped; (category, n), sorted by category.

    Blocks of idle goroutines are cut out first, in one pass of a pattern; lines are then judged one by one."""
    def counts(names: Column) -> Column:
        return F.transform(F.array_sort(F.array_distinct(names)), lambda c: F.struct(c.alias("category"), F.size(F.filter(names, lambda n: n == c)).cast("long").alias("n")))

    def result(j: Column, n_idle: Column) -> Column:
        kept = F.array_join(F.transform(F.filter(j, lambda x: x["c"].isNull()), lambda x: x["line"]), "\n")
        names = F.concat(F.transform(F.filter(j, lambda x: x["c"].isNotNull()), lambda x: x["c"]), F.array_repeat(F.lit(IDLE_LABEL), n_idle))
        return let(names, lambda n: F.struct(kept.alias("kept"), F.size(n).cast("long").alias("dropped"), counts(n).alias("categories")))

    def of(t: Column) -> Column:
        rest, n_idle = without_idle(t)
        judged = F.transform(let(rest, lines), lambda x: F.struct(x.alias("line"), category(x, custom).alias("c")))
        return let(judged, lambda j: result(j, n_idle))

    return let(text, of)


def summary(dropped: Column, categories: Column) -> Column:
    """One line about what was dropped."""
    parts = F.array_join(F.transform(categories, lambda c: F.concat(c["category"], F.lit(": "), c["n"].cast("string"))), ", ")
    return F.when(dropped == 0, F.lit("0 frames (lossless)")).otherwise(F.concat(dropped.cast("string"), F.lit(" frames ("), parts, F.lit(")")))


# Rules by the thousand

#: Bytes of patterns that are sent to every task at once; more of them take more passes.
RULE_BYTES = 16 << 20


def first_rules(lines: DataFrame, line_col: str, rules: DataFrame, out: str = "rule", most_bytes: int = RULE_BYTES) -> DataFrame:
    """lines with the smallest ``rule`` (a number) whose ``pattern`` a line holds, whatever its case; null if none.

    The patterns are one automaton, which reads a line once however many they are. Their total size is measured; they are
    sent in passes of about ``most_bytes`` each. Null and empty patterns hold nowhere."""
    known = rules.filter("pattern <> '' and rule is not null").select(F.col("rule").cast("long").alias("rule"), F.lower("pattern").alias("pattern"))
    known = known.groupBy("pattern").agg(F.min("rule").alias("rule"))
    passes = -(-(known.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0) // most_bytes)
    found = [hits_of(F.col(line_col), known.filter(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == i).collect()) for i in range(passes)]
    least = F.lit(None).cast("long") if not found else found[0] if len(found) == 1 else F.least(*found)
    return lines.withColumn(out, least)


def hits_of(line: Column, rules: list) -> Column:
    """The smallest of some rules that a line holds."""
    pairs = [(r["pattern"], r["rule"]) for r in rules]

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = ahocorasick.Automaton()
        for p, n in pairs:
            words.add_word(p, n)
        words.make_automaton()
        for batch in batches:
            found = [None if x is None else min((n for _, n in words.iter(x)), default=None) for x in batch]
            yield pd.Series(found, dtype="Int64")

    return run(F.lower(line)) if pairs else F.lit(None).cast("long")
