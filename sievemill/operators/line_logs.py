"""Logs as rows of lines, for files of any size: pruning and masking that give what they give for the whole text.

A log is (file, pos, line) with pos counting lines from 0. What a line means may depend on lines far before it (the header
of an idle goroutine, the BEGIN of a key) and, for keys, on whether an END comes later. ``scanned`` finds that in two
passes over blocks of consecutive lines: each block is first summed up in one row (the latest event in it); those rows are
carried over a file's blocks, in the same way; then each block goes on from what the blocks before it have left. A task
holds a block, never a file, and lines are shuffled once.

Null lines are kept as they are and mean nothing to others. Null file names are a file of their own. Positions must be unique within a
file; gaps in them do no harm.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions import noise, redaction, text
from sievemill.sources.scratch import written

#: Consecutive lines of a block, and of blocks of a block above; levels of blocks.
LINES, LEVELS = 20_000, 2


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(file, pos, line) of whole texts, split as ``text.lines`` does."""
    return docs.select(F.col(id_col).alias("file"), F.posexplode(text.lines(F.col(text_col))).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def raw_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(file, pos, line), split at each LF and at nothing else, so that joining the lines by LF gives the text again."""
    return docs.select(F.col(id_col).alias("file"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def scanned(rows: DataFrame, last: dict[str, Column], most: dict[str, Column] | None = None, block: int = LINES) -> DataFrame:
    """rows with, for each event in last, its latest value that isn't null in the file: ``name`` up to and with the row,
    ``name_before`` without it; and for each of most, its largest value in the whole file."""
    most, kept = most or {}, rows.columns
    rows = rows.withColumns({"_file": F.struct("file"), "_at": F.col("pos"), **{f"_{n}": c for n, c in (last | most).items()}})
    met = carried(rows, [f"_{n}" for n in last], [f"_{n}" for n in most], block, LEVELS)
    out = {}
    for n in last:
        out[n] = F.coalesce(f"_{n}", f"_{n}_before")
        out[f"{n}_before"] = F.col(f"_{n}_before")
    return met.select(*kept, *[c.alias(n) for n, c in out.items()], *[F.col(f"_{n}_most").alias(n) for n in most])


def carried(rows: DataFrame, last: list[str], most: list[str], block: int, levels: int) -> DataFrame:
    """rows (_file, _at, events) with the latest value of each of last before the row, ``_before``, and the largest of each
    of most in the file, ``_most``. Blocks are summed up and carried on in the same way, as rows of a level above (positions with gaps take larger blocks); at the top
    level, of some thousand blocks for a hundred terabytes, a file is one window."""
    before = lambda n, over: F.last(n, True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    of_file = Window.partitionBy("_file")
    if levels == 0:
        return rows.select("*", *[before(n, of_file.orderBy("_at")).alias(f"{n}_before") for n in last], *[F.max(n).over(of_file).alias(f"{n}_most") for n in most])
    rows = rows.withColumn("_block", F.floor(F.col("_at") / block))
    latest = [F.max_by(F.col(n), F.when(F.col(n).isNotNull(), F.col("_at"))).alias(n) for n in last]
    sums = rows.groupBy("_file", F.col("_block").alias("_at")).agg(*latest, *[F.max(n).alias(n) for n in most])
    above = carried(sums, last, most, min(block, LINES), levels - 1)
    known = reduce(lambda a, n: a | F.col(n).isNotNull(), [*(f"{n}_before" for n in last), *(f"{n}_most" for n in most)], F.lit(False))
    above = above.filter(known).select("_file", F.col("_at").alias("_block"), *[F.col(f"{n}_before").alias(f"{n}_in") for n in last], *[f"{n}_most" for n in most])
    inside = Window.partitionBy("_file", "_block").orderBy("_at")
    met = rows.join(above, ["_file", "_block"], "left")
    out = met.withColumns({f"{n}_before": F.coalesce(before(n, inside), F.col(f"{n}_in")) for n in last})
    return out.drop("_block", *[f"{n}_in" for n in last])


# Pruning


def judged(rows: DataFrame, custom: Iterable[str] = (), block: int = LINES) -> DataFrame:
    """rows with the category of each line that is noise; null for lines that stay."""
    line = F.col("line")
    idle = F.when(line.rlike(noise.any_of(noise.IDLE)), 1).otherwise(0)
    event = F.when(line.rlike(r"\A\s*goroutine "), idle).when(line == "", 0)
    state = redaction.fresh([*rows.columns, "category"], "idle")
    met = scanned(rows, {state: event}, block=block)
    category = F.when(F.col(state) == 1, F.when(line.isNotNull(), F.lit(noise.IDLE_LABEL))).otherwise(noise.category(line, custom))
    return met.select(*rows.columns, category.alias("category"))


def pruned_lines(rows: DataFrame, custom: Iterable[str] = (), block: int = LINES) -> DataFrame:
    """The lines that stay."""
    return judged(rows, custom, block).filter("category is null").drop("category")


def prune_report(found: DataFrame) -> DataFrame:
    """(file, kept, dropped, summary) from judged lines; a row for each file that has lines."""
    counts = found.groupBy("file", "category").count()
    per = counts.groupBy("file").agg(
        F.coalesce(F.sum(F.when(F.col("category").isNull(), F.col("count"))), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(F.col("category").isNotNull(), F.col("count"))), F.lit(0)).alias("dropped"),
        F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", F.col("count").alias("n"))))).alias("categories"),
    )
    return per.select("file", "kept", "dropped", noise.summary(F.col("dropped"), F.col("categories")).alias("summary"))


# Masking

#: What a line ends with if a key on it may have its value on a later line; a superset of what the rules need.
OPEN_KEY = r"(?U)(?i)(?:api_key|token|password|secret|auth|bearer)[a-z0-9_]*[\"']?\s*(?:[:=]\s*)?\z"
#: Lines that don't end such an open key.
GAP = r"(?U)\A\s*[:=]?\s*\z"
MARKER = r"-----(BEGIN|END)[A-Z ]*PRIVATE KEY-----"


def markers(line: Column) -> Column:
    """BEGIN and END marks of keys on a line, in order, as the rules before that of keys leave them; null if there is none."""
    earlier = [r for r in redaction.java_rules() if r[0] in FIRST_RULES]
    left = reduce(lambda now, rule: redaction.replaced(rule, now), earlier, line)
    found = F.regexp_extract_all(left, F.lit(MARKER), F.lit(1))
    return F.when(line.contains("PRIVATE KEY-----"), F.when(F.size(found) > 0, found))


#: The rules that are applied before that of keys.
FIRST_RULES = tuple(n for n, _, _ in redaction.RULES[: [n for n, _, _ in redaction.RULES].index("private_key")])


def redacted_lines(rows: DataFrame, custom: Iterable[tuple[str, str | None]] = (), block: int = LINES) -> DataFrame:
    """(file, pos, line) of the masked log: joined by LF, the lines of a file are its masked text.

    Only few lines depend on others: those from a key to its value and those that hold the marks of a private key. These
    are stitched to one row, at the place of the first; lines inside a private key vanish before that, so however long it
    is, no row holds it. All other lines are masked by themselves. Two marks that share their five dashes are both taken.
    Custom patterns see a row at a time."""
    line, pos = F.col("line"), F.col("pos")
    tail = F.when(line.rlike(OPEN_KEY), 1).when(line.rlike(GAP), F.lit(None)).when(line.isNotNull(), 0)
    rows = rows.select("file", "pos", "line", markers(line).alias("marks"))
    key = F.when(F.element_at("marks", -1) == "BEGIN", 1).when(F.col("marks").isNotNull(), 0)
    met = scanned(rows, {"tail": tail, "key": key}, {"end": F.when(F.array_contains("marks", "END"), pos)}, block)
    yes = lambda c: F.coalesce(c, F.lit(False))
    in_key = yes((F.col("key_before") == 1) & (pos <= F.col("end")))
    to_last = yes(F.col("tail_before") == 1) | in_key
    to_next = yes(F.col("tail") == 1) | yes((F.col("key") == 1) & (pos < F.col("end")))
    met = met.filter(~(in_key & F.col("marks").isNull())).select("file", "pos", "line", to_last.alias("to_last"), to_next.alias("to_next"))
    met = written(met, "bound-lines")
    alone = met.filter(~F.col("to_last") & ~F.col("to_next")).select("file", "pos", "line")
    bound = scanned(met.filter(F.col("to_last") | F.col("to_next")), {"first": F.when(~F.col("to_last"), pos)}, block=block)
    stitched = bound.groupBy(F.struct("file").alias("f"), "first").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    stitched = stitched.select("f.file", F.coalesce("first", F.col("rows")[0]["pos"]).alias("pos"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("line"))
    return alone.unionByName(stitched).select("file", "pos", redaction.redact(line, custom).alias("line"))
