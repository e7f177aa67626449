"""What an error log is about: its signature as a search query, and search results as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions.text import let, lines

MOST = 100
#: Lines that begin so are frames or run-time chatter.
FRAME = r'\A(?:at |File "|#|goroutine |\.\.\. |\+0x|runtime\.|exit status)'
PATHLIKE = r"\A0x|\A/|(?i)\A[cd]:\\|(?i)/(?:home|usr|var|etc|app|target)/"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def clean_query(raw: Column) -> Column:
    """Words without addresses and paths (all of it if nothing is left), 100 characters at most."""
    words = lambda r: F.filter(F.split(trim(r), r"(?U)\s+"), lambda w: (w != "") & ~w.rlike(PATHLIKE))
    return let(raw, lambda r: F.substring(let(words(r), lambda ws: F.when(F.size(ws) == 0, r).otherwise(F.array_join(ws, " "))), 1, MOST))


def after(text: Column, mark: str) -> Column:
    return F.substring(text, F.instr(text, mark) + len(mark), F.char_length(text))


def first(rows: Column, test) -> Column:
    return F.get(F.filter(rows, test), F.lit(0))


def error_query(log: Column) -> Column:
    """The signature: root cause, then a panic, then an error header, then the last line that isn't a frame."""
    return clean_query(let(F.transform(lines(log), trim), raw_signature))


def raw_signature(rows: Column) -> Column:
    cause = trim(F.regexp_replace(first(rows, lambda x: x.startswith("Caused by:")), r"\A(?:Caused by:)+", ""))
    is_thread = lambda x: x.startswith("thread ") & x.contains("panicked at")
    in_thread = lambda x: x.startswith("Exception in thread") & x.contains(":")
    headed = lambda x: (x.contains("Error: ") | x.contains("Exception: ")) & ~x.rlike(r'\A(?:at |File "|#)')

    def panic(x: Column) -> Column:
        plain = trim(F.regexp_replace(x, r"\A(?:panic:)+", ""))
        thread = F.regexp_replace(F.regexp_replace(trim(after(x, "panicked at")), r"\A'+|'+\z", ""), r'\A"+|"+\z', "")
        token = F.split(trim(after(x, "AddressSanitizer:")), r"(?U)\s+")[0]
        return F.when(x.startswith("panic:"), plain).when(is_thread(x), thread).otherwise(F.when(token == "", F.lit("heap-buffer-overflow")).otherwise(token))

    header = lambda x: F.when(in_thread(x), trim(after(x, ":"))).otherwise(x)
    rest = F.filter(rows, lambda x: (x != "") & ~x.rlike(FRAME))
    return F.coalesce(
        cause,
        let(first(rows, lambda x: x.startswith("panic:") | is_thread(x) | x.contains("AddressSanitizer:")), panic),
        let(first(rows, lambda x: in_thread(x) | headed(x)), header),
        let(rest, lambda r: F.when(F.size(r) > 0, F.element_at(r, -1))),
    )


def search_query(log: Column) -> Column:
    """The signature or, without one, the cleaned log; null if blank."""
    out = F.coalesce(error_query(log), clean_query(log))
    return F.when(trim(out) != "", out)


def search_report(response: Column) -> Column:
    """Text about the first three results of a JSON answer (items with title, link, is_answered); null if there are none."""
    items = F.from_json(response, "items array<struct<title:string,link:string,is_answered:boolean>>")["items"]
    good = F.filter(F.slice(items, 1, 3), lambda i: i["title"].isNotNull() & i["link"].isNotNull() & i["is_answered"].isNotNull())

    def plain(title: Column) -> Column:
        for code, char in (("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            title = F.replace(title, F.lit(code), F.lit(char))
        return title

    rows = F.transform(good, lambda i: F.concat(F.lit("- ["), F.when(i["is_answered"], F.lit("✅ Answered")).otherwise(F.lit("⏳ Unanswered")), F.lit("] "), plain(i["title"]), F.lit("\n  "), i["link"], F.lit("\n")))
    return F.when(F.size(rows) > 0, F.concat(F.lit("Based on automated Stack Overflow search:\n"), F.array_join(rows, "")))
