"""Registered queries over logs as rows of lines, with reference SQL over the whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.operators import line_logs
from sievemill.plans import synthetic
from sievemill.plans.catalog import _IDLE, LOGS, query, quote, sql_category, sql_lines, sql_pruned, sql_redaction


def digest(*parts) -> F.Column:
    """An order-free digest of rows: the exclusive or of 60 bits of each row's hash."""
    return F.bit_xor(F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long"))


_DIGEST = "coalesce(bit_xor(concat('0x', substring(md5(concat_ws(':', {0})), 1, 15))::BIGINT), 0)"


@query(
    f"""WITH {LOGS}, {sql_pruned("logs")}, t AS (SELECT doc_id, count(*) FILTER (c IS NULL) AS n_kept, {_DIGEST.format("pos - 1, line")} AS all_digest, coalesce(bit_xor(concat('0x', substring(md5(concat_ws(':', pos - 1, line)), 1, 15))::BIGINT) FILTER (c IS NULL), 0) AS kept_digest FROM ct GROUP BY doc_id)
SELECT doc_id, n_kept, dropped, summary, kept_digest FROM pruned JOIN t USING (doc_id)"""
)
def prune_line_rows(spark, sf_dir):
    """Each log's lines as rows, pruned without putting a log together."""
    found = line_logs.judged(line_logs.line_rows(synthetic.logs(spark, sf_dir)), block=8)
    sums = line_logs.prune_report(found)
    kept = found.filter("category is null").groupBy("file").agg(digest("pos", "line").alias("kept_digest"))
    met = sums.join(kept, "file", "left")
    return met.select(F.col("file").alias("doc_id"), F.col("kept").alias("n_kept"), "dropped", "summary", F.coalesce("kept_digest", F.lit(0)).alias("kept_digest"))


#: Positions in one log have room for so many lines of a text; a block of them is a thousand texts.
SHIFT = 32
ONE_BLOCK = 1000 << SHIFT


def one_log(docs: DataFrame, raw: bool = False) -> DataFrame:
    """(file, pos, line, doc_id, at): all texts, in the order of their ids, as the lines of one log. Positions have gaps."""
    rows = (line_logs.raw_rows if raw else line_logs.line_rows)(docs)
    return rows.select(F.lit("all").alias("file"), (F.shiftleft(F.col("file"), SHIFT) + F.col("pos")).alias("pos"), "line", F.col("file").alias("doc_id"), F.col("pos").alias("at"))


#: A header of an idle goroutine ends every seventh log, so that what follows depends on it.
_ENDED = "SELECT doc_id, concat(text, CASE WHEN doc_id % 7 = 3 THEN concat(chr(10), 'goroutine 9 [finalizer wait]:') ELSE '' END) AS text FROM {0}"


@query(
    f"""WITH {LOGS}, src AS ({_ENDED.format("logs")}), ln AS ({sql_lines("src")}),
ev AS (SELECT *, CASE WHEN regexp_matches(line, '\\A\\s*goroutine ') THEN CASE WHEN {_IDLE} THEN 1 ELSE 0 END WHEN line = '' THEN 0 END AS e FROM ln),
st AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (ORDER BY doc_id, pos), 0) AS s FROM ev),
ct AS (SELECT *, CASE WHEN s = 1 THEN 'go:idle_goroutines' ELSE {sql_category("line")} END AS c FROM st)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c IS NULL) AS n_kept, count(*) FILTER (c = 'go:idle_goroutines') AS n_idle,
  coalesce(bit_xor(concat('0x', substring(md5(concat_ws(':', pos - 1, line)), 1, 15))::BIGINT) FILTER (c IS NULL), 0) AS kept_digest FROM ct GROUP BY doc_id"""
)
def prune_one_log(spark, sf_dir):
    """All logs as one: what a line is depends on lines of earlier documents, over any number of tasks."""
    docs = spark.sql(_ENDED.format("{logs}"), logs=synthetic.logs(spark, sf_dir))
    found = line_logs.judged(one_log(docs), block=ONE_BLOCK)
    kept = F.col("category").isNull()
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(kept).alias("n_kept"), F.count_if(F.col("category") == "go:idle_goroutines").alias("n_idle"),
        F.coalesce(F.bit_xor(F.when(kept, F.conv(F.substring(F.md5(F.concat_ws(":", "at", "line")), 1, 15), 16, 10).cast("long"))), F.lit(0)).alias("kept_digest"),
    )


#: Logs that end inside a key, in a key's name, or with the end of a key that an earlier one began.
_OPEN = """SELECT doc_id, concat(text, chr(10), CASE doc_id % 8 WHEN 0 THEN concat('x -----BEGIN RSA PRIVATE KEY-----', chr(10), 'MIIE') WHEN 3 THEN concat('MIIF', chr(10), '-----END RSA PRIVATE KEY----- y')
  WHEN 4 THEN 'db_password =' WHEN 5 THEN concat('Authorization:', chr(10), chr(10), '  Bearer') WHEN 6 THEN concat('token', chr(10), ' : ', chr(10), '   abcdefghijklmnop') ELSE 'end' END) AS text FROM {0}"""
_LINES_OF = f"SELECT doc_id, count(*) AS n_lines, sum(strlen(line))::BIGINT AS clean_bytes, {_DIGEST.format('line')} AS line_digest FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM red) GROUP BY doc_id"


@query(f"WITH {LOGS}, src AS ({_OPEN.format('logs')}), {sql_redaction('src', _LINES_OF)}")
def redact_line_rows(spark, sf_dir):
    """Each log's lines as rows, masked as its whole text is."""
    docs = spark.sql(_OPEN.format("{logs}"), logs=synthetic.logs(spark, sf_dir))
    rows = line_logs.redacted_lines(line_logs.raw_rows(docs), block=8)
    each = rows.select("file", F.explode(F.split("line", "\n", -1)).alias("line"))
    return each.groupBy(F.col("file").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).alias("clean_bytes"), digest("line").alias("line_digest"))


@query(f"WITH {LOGS}, parts AS ({_OPEN.format('logs')}), src AS (SELECT string_agg(text, chr(10) ORDER BY doc_id) AS text FROM parts), {sql_redaction('src', 'SELECT md5(line) AS line_md5, count(*) AS n FROM (SELECT unnest(string_split(t, chr(10))) AS line FROM red) GROUP BY line')}")
def redact_one_log(spark, sf_dir):
    """All logs as one: keys begin in one document and end in another one."""
    docs = spark.sql(_OPEN.format("{logs}"), logs=synthetic.logs(spark, sf_dir))
    rows = line_logs.redacted_lines(one_log(docs, raw=True), block=ONE_BLOCK)
    return rows.select(F.explode(F.split("line", "\n", -1)).alias("line")).groupBy(F.md5("line").alias("line_md5")).agg(F.count("*").alias("n"))
