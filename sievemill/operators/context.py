"""Source windows around the frames of a trace: an equi- and range join of locations with source lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import noise, text, traces
from sievemill.operators.skew import join_unique
from sievemill.sources.scratch import written


def source_lines(sources: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line_no, line, n_lines) of source files; a row with line_no 0 stands for an empty file."""
    rows = sources.select(F.col(path_col).alias("path"), text.lines(F.col(text_col)).alias("rows"))
    return rows.select("path", F.size("rows").cast("long").alias("n_lines"), F.posexplode_outer("rows")).select("path", (F.coalesce("pos", F.lit(-1)) + 1).cast("long").alias("line_no"), F.col("col").alias("line"), "n_lines")


def frames(logs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, path, line): distinct locations that aren't noise, in order."""
    rows = logs.select(F.col(id_col).alias("id"), F.posexplode(traces.all_locations(F.col(text_col))))
    return rows.select("id", "pos", F.col("col.file").alias("path"), F.col("col.line").alias("line")).filter(~noise.is_noise(F.col("path")))


def window(line: Column, n_lines: Column, context: int) -> tuple[Column, Column]:
    """(first, last) line of a window, counted from 1; a line past the end gives first > last."""
    first = F.greatest(F.greatest(line - context, F.lit(0)) - 1, F.lit(0)) + 1
    return first, F.least(line + context, n_lines)


def windows(found: DataFrame, sources: DataFrame, context: int = 5, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, pos, path, line, first, last, body): one row for each frame whose file is there.

    Files are joined on the path once and cut with array functions, so a long file isn't spread into rows."""
    rows = sources.select(F.col(path_col).alias("path"), text.lines(F.col(text_col)).alias("rows"))
    first, last = window(F.col("line"), F.size("rows").cast("long"), context)
    met = found.join(rows, "path").withColumns({"first": first, "last": last})
    part = F.when(F.col("last") >= F.col("first"), F.slice("rows", F.col("first").cast("int"), (F.col("last") - F.col("first") + 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.transform(part, lambda x, i: F.concat((F.col("first") + i).cast("string"), F.lit(" | "), x, F.lit("\n"))), "")
    head = F.format_string("--- %s (Lines %d-%d) ---\n", F.col("path"), F.col("first"), F.col("last"))
    return met.select("id", "pos", "path", "line", "first", "last", F.concat(head, body, F.lit("\n")).alias("body"))


def windows_by_lines(found: DataFrame, lines: DataFrame, context: int = 5) -> DataFrame:
    """(id, pos, path, line, line_no, text): the same as rows, from source_lines: a range join within equal paths."""
    s = lines.alias("s")
    first, last = window(F.col("f.line"), F.col("s.n_lines"), context)
    met = found.alias("f").join(s, (F.col("f.path") == F.col("s.path")) & (F.col("s.line_no") >= first) & (F.col("s.line_no") <= last))
    return met.select("f.id", "f.pos", "f.path", "f.line", "s.line_no", F.col("s.line").alias("text"))


def windows_binned(found: DataFrame, lines: DataFrame, context: int = 5, root: str | None = None) -> DataFrame:
    """What ``windows`` gives, from source_lines, for files of any length and paths of any frequency.

    Each place (path, line) is cut out once, however many frames name it: its window lies in two bins of lines at most, so
    places and lines meet by equal (path, bin) and a long file is spread over its bins. Bin -1 holds a file's length. Lines
    are read once, found three times (write it first if it's much work). The windows then go to their frames; places that a
    thousandth of all frames name are sent to every task. root: only paths within it are read."""
    if root is not None:
        found = found.filter(inside(F.col("path"), root))
    width, length = 2 * context + 1, F.lit(-1).cast("long")
    places = written(found.groupBy("path", "line").agg(F.count("*").alias("frames")), "places")
    first, last = window(F.col("line"), F.col("line") + context, context)
    bins = F.sequence(F.floor((first - 1) / width), F.floor((F.greatest(last, first) - 1) / width))
    wanted = places.select("path", "line", "frames", F.explode(F.concat(F.array(length), bins)).alias("bin")).withColumns({"first": first, "last": last})
    no = F.col("line_no")
    bins = F.when(no == 0, F.array(length)).when(no == 1, F.array(length, F.lit(0).cast("long"))).otherwise(F.array(F.floor((no - 1) / width)))
    rows = lines.select(F.col("path").alias("p"), "line_no", F.col("line").alias("s"), "n_lines", F.explode(bins).alias("b"))
    rows = rows.withColumn("s", F.when(F.col("b") >= 0, F.col("s")))
    met = wanted.join(rows, (F.col("path") == F.col("p")) & (F.col("bin") == F.col("b")) & ((F.col("b") < 0) | no.between(F.col("first"), F.col("last"))))
    part = F.when(F.col("b") >= 0, F.struct("line_no", "s"))
    cut = met.groupBy("path", "line").agg(F.max("frames").alias("frames"), F.array_sort(F.collect_list(part)).alias("rows"), F.max(part["line_no"]).alias("end"), F.max("n_lines").alias("n_lines"))
    end = F.coalesce("end", F.least(F.col("line") + context, F.col("n_lines"))).cast("long")
    body = F.array_join(F.transform("rows", lambda r: F.concat(r["line_no"].cast("string"), F.lit(" | "), r["s"], F.lit("\n"))), "")
    head = F.format_string("--- %s (Lines %d-%d) ---\n", F.col("path"), first, end)
    known = written(cut.select("path", "line", "frames", first.alias("first"), end.alias("last"), F.concat(head, body, F.lit("\n")).alias("body")), "windows")
    total = places.agg(F.sum("frames")).first()[0] or 0
    return join_unique(found, known, ["path", "line"], "frames", total).select("id", "pos", "path", "line", "first", "last", "body")


def contexts(found: DataFrame, sources: DataFrame, context: int = 5, root: str | None = None) -> DataFrame:
    """(id, context, files): windows in frame order as one text, files in order of first sight. root: only paths within it
    are read; without one, all are."""
    if root is not None:
        found = found.filter(inside(F.col("path"), root))
    return put_together(windows(found, sources, context))


def put_together(cut: DataFrame) -> DataFrame:
    """(id, context, files) of windows."""
    rows = cut.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "body"))).alias("w"))
    return rows.select("id", F.array_join(F.transform("w", lambda x: x["body"]), "").alias("context"), F.array_distinct(F.transform("w", lambda x: x["path"])).alias("files"))


def present(found: DataFrame, sources: DataFrame) -> DataFrame:
    return found.join(sources.select("path"), "path", "left_semi")


def missing(found: DataFrame, sources: DataFrame) -> DataFrame:
    return found.join(sources.select("path"), "path", "left_anti")


def escapes(path: Column) -> Column:
    """Whether a relative path holds a NUL or climbs above its root at any point."""
    step = lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out"))
    walk = F.aggregate(F.split(F.translate(path, "\\", "/"), "/"), start, lambda a, p: F.struct((a["depth"] + step(p)).alias("depth"), (a["out"] | (a["depth"] + step(p) < 0)).alias("out")), lambda a: a["out"])
    return path.contains("\x00") | walk


def inside(path: Column, root: str) -> Column:
    """Whether a path stays within root: relative ones that don't escape, absolute ones below it."""
    root = root.rstrip("/")
    below = (path == root) | path.startswith(root + "/")
    rest = F.substring(path, F.lit(len(root) + 2), F.char_length(path))
    return F.when(path.startswith("/"), below & ~escapes(rest)).otherwise(~escapes(path))


def bounded_files(spark, glob: str, root: str, most: int = 10_000_000) -> DataFrame:
    """(path, text): regular files of at most ``most`` bytes whose path lies within root."""
    rows = spark.read.format("binaryFile").load(glob).filter(F.col("length") <= most)
    path = F.regexp_replace("path", r"\A[a-z]+:(?://)?", "")
    return rows.select(path.alias("path"), F.col("content").cast("string").alias("text")).filter(inside(F.col("path"), root))


def numbered(s: Column, first: int, last: int) -> Column:
    """Lines first to last, each with its number in four places."""
    rows = F.transform(F.slice(text.lines(s), first, max(0, last - first + 1)), lambda x, i: F.concat(F.lpad((i + first).cast("string"), 4, " "), F.lit(" | "), x))
    return F.array_join(rows, "\n")
