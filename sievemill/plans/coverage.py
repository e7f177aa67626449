"""More registered queries with reference SQL: operators that the catalog's queries don't run."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.functions import patch, payload, payload_tree, signature, text
from sievemill.operators import audit, context, evaluation, store, traffic
from sievemill.plans import synthetic
from sievemill.plans.catalog import _CLEANED, LOGS, _payloads, _turns, oracle_sql, query, sql_lines, sql_pruned, sql_redaction
from sievemill.sources.scratch import written_by_python
from sievemill.sources.tables import table, texts

# D, F: paths within a root, numbered views, what is sent for a diagnosis

_STEPS = "list_transform(string_split({0}, '/'), lambda p: CASE WHEN p = '..' THEN -1 WHEN p IN ('', '.') THEN 0 ELSE 1 END)"
_LOW = "coalesce(list_min(list_transform(range(1, len({0}) + 1), lambda i: list_sum({0}[:i]))), 0) < 0"


@query(
    f"""WITH p AS (SELECT page_id, concat(CASE page_id % 5 WHEN 0 THEN '/srv/app/' WHEN 1 THEN '/srv/application/' WHEN 2 THEN '../' WHEN 3 THEN '/srv/app/a/../../' ELSE 'a/../' END, split_part(url, '/', 4)) AS path FROM pages),
r AS (SELECT *, starts_with(path, '/') AS absolute, CASE WHEN starts_with(path, '/') THEN substring(path, 10) ELSE path END AS rest FROM p), s AS (SELECT *, {_STEPS.format("rest")} AS s FROM r)
SELECT page_id, path, CASE WHEN absolute THEN (path = '/srv/app' OR starts_with(path, '/srv/app/')) AND NOT {_LOW.format("s")} ELSE NOT {_LOW.format("s")} END AS inside FROM s"""
)
def path_inside(spark, sf_dir):
    lead = F.when(F.col("page_id") % 5 == 0, "/srv/app/").when(F.col("page_id") % 5 == 1, "/srv/application/").when(F.col("page_id") % 5 == 2, "../").when(F.col("page_id") % 5 == 3, "/srv/app/a/../../").otherwise("a/../")
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(lead, F.split_part("url", F.lit("/"), F.lit(4))).alias("path"))
    return rows.withColumn("inside", context.inside(F.col("path"), "/srv/app"))


@query(f"WITH ln AS ({sql_lines('documents')}), v AS (SELECT doc_id, string_agg(concat(lpad(pos::VARCHAR, 4, ' '), ' | ', line), chr(10) ORDER BY pos) AS v FROM ln WHERE pos BETWEEN 2 AND 5 GROUP BY doc_id) SELECT doc_id, md5(coalesce(v, '')) AS view_md5 FROM documents LEFT JOIN v USING (doc_id)")
def numbered_views(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.md5(context.numbered(F.col("text"), 2, 5)).alias("view_md5"))


@query(f"WITH {LOGS}, {sql_pruned('logs')}, k AS (SELECT doc_id, concat('Log:', chr(10), kept, chr(10), chr(10), 'Context:', chr(10), 'see token=abcdefghij', CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), chr(10), 'Recent changes:', chr(10), 'diff ', doc_id) ELSE '' END) AS text FROM pruned), {sql_redaction('k', 'SELECT doc_id, md5(t) AS sent_md5 FROM red')}")
def diagnose_logs(spark, sf_dir):
    diff = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("diff "), F.col("doc_id").cast("string")))
    sent = audit.diagnosis(F.col("text"), F.lit("see token=abcdefghij"), diff, F.lit(""))
    return synthetic.logs(spark, sf_dir).select("doc_id", F.md5(sent).alias("sent_md5"))


# G: payloads of parts

@query(_CLEANED + " SELECT conv_id, turn, md5(kept) AS system_md5, md5(CASE WHEN k THEN text ELSE kept END) AS part_md5, md5(text) AS image_md5, md5(CASE WHEN k THEN text ELSE kept END) AS result_md5, md5(text) AS use_md5, md5(kept) AS input_md5, ((CASE WHEN k THEN 0 ELSE 2 END + 2) * strlen(text))::BIGINT AS raw_bytes, ((CASE WHEN k THEN 0 ELSE 2 END + 2) * strlen(kept))::BIGINT AS clean_bytes FROM c")
def sanitize_parts(spark, sf_dir):
    return _parts(spark, sf_dir, payload.sanitize_json)


def _parts(spark, sf_dir, sanitize):
    part = lambda kind, name: F.struct(F.lit(kind).alias("type"), F.col("text").alias(name))
    one = lambda x: F.to_json(x)
    result = F.to_json(F.struct(F.lit("tool_result").alias("type"), F.array(part("text", "text")).alias("content")))
    parts = F.concat(F.lit("["), F.concat_ws(",", one(part("text", "text")), one(part("image", "source")), result, one(part("tool_use", "input"))), F.lit("]"))
    body = F.concat(F.lit('{"model":"m","system":['), one(part("text", "text")), F.lit('],"messages":[{"role":'), F.to_json(F.array("role")).substr(F.lit(2), F.char_length(F.to_json(F.array("role"))) - 2), F.lit(',"content":'), parts, F.lit('}],"input":'), F.to_json(F.array("text")), F.lit("}"))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", sanitize(body).alias("s"))
    at = lambda path: F.md5(F.get_json_object("s.payload", path))
    content = "$.messages[0].content"
    return rows.select(
        "conv_id", "turn", at("$.system[0].text").alias("system_md5"), at(f"{content}[0].text").alias("part_md5"), at(f"{content}[1].source").alias("image_md5"), at(f"{content}[2].content[0].text").alias("result_md5"),
        at(f"{content}[3].input").alias("use_md5"), at("$.input[0]").alias("input_md5"), "s.raw_bytes", "s.clean_bytes",
    )


@query(oracle_sql()["sanitize_parts"])
def sanitize_parts_tree(spark, sf_dir):
    """The same on the JVM."""
    return _parts(spark, sf_dir, payload_tree.sanitize_tree)


@query(oracle_sql()["sanitize_payloads"])
def sanitize_payloads_tree(spark, sf_dir):
    rows = _payloads(spark, sf_dir).select("conv_id", payload_tree.sanitize_tree(F.col("payload")).alias("s"))
    return rows.select("conv_id", "s.raw_bytes", "s.clean_bytes", "s.secrets")


# I: the gateway's guards

_GUARD = "CASE WHEN page_id % 11 = 0 THEN 503 WHEN page_id % 7 = 0 OR page_id % 13 = 0 THEN 431 WHEN page_id % 5 = 0 THEN 403 WHEN page_id % 3 = 0 THEN 401 WHEN page_id % 4 = 0 THEN 413 WHEN page_id % 2 = 0 THEN 400 END"


@query(f"SELECT page_id, coalesce({_GUARD}, 0)::INT AS status, page_id % 3 <> 0 AS token_ok, CASE page_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'accept,x-a' ELSE 'x-a' END AS passed, (page_id % 2 = 0) AND page_id % 6 <> 4 AND page_id % 4 <> 2 AS cacheable, greatest(5.0::DOUBLE, CASE WHEN page_id % 10 > 0 THEN (page_id % 4)::DOUBLE / (page_id % 10) * 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS bar FROM pages")
def request_guards(spark, sf_dir):
    p = F.col("page_id")
    given = F.when(p % 3 == 0, "nope").when(p % 3 == 1, "bearer s3cret").otherwise("s3cret")
    token = traffic.token_matches(given, "s3cret")
    big = lambda k, n: F.when(p % k == 0, n + 1).otherwise(1)
    status = traffic.status_guard(big(7, traffic.MAX_HEADERS), big(13, traffic.MAX_HEADER), big(4, traffic.MAX_BODY), p % 5 != 0, token, p % 2 != 0, p % 11 != 0)
    header = lambda *names: F.create_map(*[x for n in names for x in (F.lit(n), F.lit("v"))])
    headers = F.when(p % 3 == 0, header("Host", "accept")).when(p % 3 == 1, header("x-a", "accept", "TE")).otherwise(header("Connection", "x-a"))
    passed = F.array_join(F.array_sort(F.map_keys(traffic.passed_headers(headers))), ",")
    cached = traffic.cacheable(F.when(p % 2 == 0, "POST").otherwise("GET"), F.when(p % 6 == 4, "/v1/models").otherwise("/v1/messages"), p % 4 == 2, F.lit(False))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(status, F.lit(0)).alias("status"), token.alias("token_ok"), passed.alias("passed"), cached.alias("cacheable"), traffic.bar(p % 10, p % 4).alias("bar"))


@query("WITH e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, sha256(event_id::VARCHAR)) AS r FROM events) SELECT user_id, event_id FROM e WHERE r <= 3")
def newest_per_user(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("hash"), F.col("ts").cast("timestamp").alias("stored_at"))
    return store.newest_per(rows, "user_id", 3).select("user_id", "event_id")


# J: reading the store, writing over it


@query("WITH m AS (SELECT max(epoch_us(ts)) AS m FROM events), s AS (SELECT sha256(event_id::VARCHAR) AS hash, event_type AS content, epoch_us(ts) AS us, event_id FROM events) SELECT hash, content FROM s, m WHERE event_id % 20 = 0 AND m - us <= 86400000000")
def cas_get(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    held = e.select(F.sha2(F.col("event_id").cast("string"), 256).alias("hash"), F.col("event_type").alias("content"), F.col("at").alias("stored_at"))
    wanted = e.filter("event_id % 20 = 0").select(F.concat(F.lit("sha256:"), F.sha2(F.col("event_id").cast("string"), 256)).alias("hash"))
    now = e.agg(F.max("at")).first()[0]
    return store.get(held, wanted, F.lit(now))


@query("WITH r AS (SELECT sha256(event_type || ':' || user_id::VARCHAR) AS hash, props, epoch_us(ts) AS us FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY us DESC, sha256(coalesce(props, '')) DESC, props DESC NULLS LAST) AS n FROM r) SELECT hash, md5(props) AS newest_md5, us AS stored_us FROM l WHERE n = 1")
def save_responses(spark, sf_dir):
    """Every key's newest answer; of several with one time stamp the one with the largest hash."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.sha2(F.concat_ws(":", "event_type", F.col("user_id").cast("string")), 256).alias("hash"), F.col("props").alias("content"), F.col("ts").cast("timestamp").alias("stored_at"), "event_id")
    old, new = rows.filter("event_id % 2 = 0").drop("event_id"), rows.filter("event_id % 2 = 1").drop("event_id")
    kept = store.save_response(store.save_response(old.limit(0), old), new)
    return kept.select("hash", F.md5("content").alias("newest_md5"), F.unix_micros("stored_at").alias("stored_us"))


# L: patches with shifted indents, syntax gates


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'Error: original_code not found in the file. Make sure it matches exactly.' ELSE 'ok' END AS status, md5(CASE doc_id % 3 WHEN 0 THEN concat('def f():', chr(10), '        x = ', doc_id, chr(10), '        if x:', chr(10), '            z()', chr(10)) WHEN 1 THEN concat('a', chr(13), chr(10), 'c', doc_id, chr(13), chr(10), 'd', chr(13), chr(10)) ELSE concat('one', chr(10)) END) AS text_md5 FROM documents")
def tolerant_patches(spark, sf_dir):
    d, nl = F.col("doc_id").cast("string"), "\n"
    case = lambda a, b, c: F.when(F.col("doc_id") % 3 == 0, a).when(F.col("doc_id") % 3 == 1, b).otherwise(c)
    content = case(F.concat(F.lit("def f():\n        x = "), d, F.lit("\n        if x:\n            y()\n")), F.concat(F.lit("a\r\nb"), d, F.lit("\r\nd\r\n")), F.lit("one\n"))
    old = case(F.lit("if x:\n    y()"), F.concat(F.lit("b"), d, F.lit(nl + "d")), F.lit("two"))
    new = case(F.lit("if x:\n    z()"), F.concat(F.lit("c"), d, F.lit(nl + "d")), F.lit("three"))
    rows = texts(spark, sf_dir).select("doc_id", patch.apply_patch(content, old, new).alias("p"))
    return rows.select("doc_id", "p.status", F.md5("p.text").alias("text_md5"))


_GATES = (("json", '{"a": 1}', True), ("json", '{"a": }', False), ("toml", "a = 1", True), ("toml", "a = ", False), ("yaml", "a:\n\tb: 1", False), ("yml", "a:\n  b: 1", True), ("py", "x = (1", False), ("js", "f({[1]})", True), ("rs", 'fn f() { g("}"); }', True), ("js", "f(]", False), ("txt", "((", True))


@query(f"SELECT doc_id, CASE doc_id % {len(_GATES)} " + " ".join(f"WHEN {i} THEN {str(ok).lower()}" for i, (_, _, ok) in enumerate(_GATES)) + " END AS ok FROM documents")
def syntax_gates(spark, sf_dir):
    pick = lambda k: F.element_at(F.array(*[F.lit(g[k]) for g in _GATES]), (F.col("doc_id") % len(_GATES) + 1).cast("int"))
    return texts(spark, sf_dir).select("doc_id", patch.syntax_gate(pick(0), pick(1)).isNull().alias("ok"))


# E, M: search, comparison with another tool


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL ELSE concat('Based on automated Stack Overflow search:', chr(10), '- [', CASE WHEN doc_id % 3 = 1 THEN '✅ Answered' ELSE '⏳ Unanswered' END, '] \"', doc_id, '\" & <more>', chr(10), '  http://x/', doc_id, chr(10)) END AS report FROM documents")
def search_reports(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    item = F.struct(F.concat(F.lit("&quot;"), d, F.lit("&quot; &amp; &lt;more&gt;")).alias("title"), F.concat(F.lit("http://x/"), d).alias("link"), (F.col("doc_id") % 3 == 1).alias("is_answered"))
    none = F.lit('{"items": []}')
    return texts(spark, sf_dir).select("doc_id", signature.search_report(F.when(F.col("doc_id") % 3 == 0, none).otherwise(F.to_json(F.struct(F.array(item).alias("items"))))).alias("report"))


@query(f"WITH tr AS ({synthetic.TRUTH}), o AS (SELECT id, CASE WHEN id % 2 = 0 THEN raw ELSE substring(raw, 3) END AS f FROM tr WHERE id % 3 <> 0) SELECT tr.id, tr.type, max(o.id IS NOT NULL) AS found FROM tr LEFT JOIN o ON tr.id = o.id AND (contains(raw, f) OR contains(f, raw)) GROUP BY tr.id, tr.type, tr.raw")
def detector_compared(spark, sf_dir):
    truth = synthetic.truth(spark, sf_dir)
    cut = F.when(F.col("id") % 2 == 0, F.col("raw")).otherwise(F.substring("raw", 3, 100000))
    theirs = truth.filter("id % 3 <> 0").select("id", cut.alias("found_text"))
    return evaluation.compared(truth, theirs).select("id", "type", "found")


@query(f"WITH ln AS ({sql_lines('documents')}), t AS (SELECT doc_id, pos, line, max(pos) OVER (PARTITION BY doc_id) AS n FROM ln), g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS s FROM t WHERE pos > n - 7 GROUP BY doc_id) SELECT doc_id, CASE WHEN text IS NOT NULL THEN md5(coalesce(s, '')) END AS tail_md5 FROM documents LEFT JOIN g USING (doc_id)")
def text_tails(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.md5(text.tail(F.col("text"), 7)).alias("tail_md5"))


# L: patches of whole texts: their first long line, as it is, indented, or with something added


_BARE = "regexp_replace({0}, '\\A\\s+|\\s+\\z', '', 'g')"
_TIMES = "(strlen(text) - strlen(replace(text, {0}, ''))) // strlen({0})"


@query(
    f"""WITH ln AS ({sql_lines('documents')}), f AS (SELECT doc_id, arg_min(line, pos) AS line FROM ln WHERE length({_BARE.format('line')}) >= 8 GROUP BY doc_id),
o AS (SELECT doc_id, text, CASE strlen(text) % 4 WHEN 0 THEN concat(line, 'zz') WHEN 1 THEN concat('  ', line) ELSE line END AS old FROM documents LEFT JOIN f USING (doc_id)),
k AS (SELECT o.doc_id, count(*) AS k, any_value(line) AS target FROM o JOIN ln ON o.doc_id = ln.doc_id AND {_BARE.format('old')} = {_BARE.format('line')} GROUP BY o.doc_id),
t AS (SELECT o.doc_id, text, CASE WHEN old IS NOT NULL AND contains(text, old) THEN old WHEN k = 1 THEN target END AS t FROM o LEFT JOIN k USING (doc_id)),
n AS (SELECT doc_id, text, t, CASE WHEN t IS NULL THEN 0 ELSE {_TIMES.format('t')} END AS n FROM t)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN n = 1 THEN 'ok' WHEN n = 0 THEN 'Error: original_code not found in the file. Make sure it matches exactly.' ELSE concat('Error: original_code found ', n, ' times. Please provide a more specific code block.') END AS status,
  md5(CASE WHEN n = 1 THEN replace(text, t, 'PATCHED') ELSE text END) AS text_md5 FROM n"""
)
def patch_texts(spark, sf_dir):
    docs = texts(spark, sf_dir)
    long = F.get(F.filter(text.lines(F.col("text")), lambda x: F.char_length(F.regexp_replace(x, r"\A\s+|\s+\z", "")) >= 8), F.lit(0))
    m = F.octet_length("text") % 4
    old = F.when(m == 0, F.concat(long, F.lit("zz"))).when(m == 1, F.concat(F.lit("  "), long)).otherwise(long)
    rows = docs.select("doc_id", patch.apply_patch(F.col("text"), old, F.lit("PATCHED")).alias("p"))
    return written_by_python(rows.select("doc_id", "p.status", F.md5("p.text").alias("text_md5")), "patched")
