"""Registered queries over code and files made from the lines of all documents, with reference SQL.

Each line of a text becomes a line of code in a form that its number and its document's id choose: the words stand in
strings, comments, templates, patterns or calls. What a check must find follows from the form and the words' length.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.functions import lint, noise, patch, text
from sievemill.plans.catalog import query, quote, sql_lines
from sievemill.sources.tables import table, texts

#: Lines of a snippet; a longer text gives several.
SNIPPET = 200
#: By form: the code, with @ for the words, the rule that must find something, and where: a column, from the words' length.
JS = (
    ('// eval("@")', None, 0, 0),
    ("/* @ eval(1) */ a = 1;", None, 0, 0),
    ('a = "@ eval(2) \\" eval(3)";', None, 0, 0),
    ('eval("@");', "javascript/dangerous-eval", 1, 0),
    ("s = `@ ${eval(x)} eval(y)`;", "javascript/dangerous-eval", 9, 1),
    ('r = /"[/]/; eval(z); t = /"/; // @', "javascript/dangerous-eval", 13, 0),
    ('o.eval("@"); q = a / b; eval(c) / 2;', "javascript/dangerous-eval", 24, 1),
    ("debugger; // @", "javascript/no-debugger", 1, 0),
)
RUST = (
    ('// panic!("@")', None, 0, 0),
    ('/* a /* @ */ panic!("x") */ let a = 1;', None, 0, 0),
    ('let s = r#"@ panic!("x")"#;', None, 0, 0),
    ('std::panic!("@");', "rust/explicit-panic", 1, 0),
    ("let c = '\"'; todo!(\"@\"); let d = '\"';", "rust/explicit-panic", 14, 0),
    ("fn f<'a>(x: &'a str) { unimplemented!() } // @", "rust/explicit-panic", 24, 0),
    ('println!("{}", panic!("@"));', None, 0, 0),
)
_WORD = "[^A-Za-z0-9 ]+"


def snippets(language, forms):
    """Runs of lines (a column of words), each in its form, as structs (language, part, code)."""
    form = F.array(*[F.lit(f) for f, *_ in forms])
    code = F.transform("words", lambda w, i: F.replace(F.element_at(form, (F.pmod(i + F.col("doc_id"), F.lit(len(forms))) + 1).cast("int")), F.lit("@"), w))

    def cut(c):
        starts = F.sequence(F.lit(0), F.floor((F.size(c) - 1) / SNIPPET).cast("int"))
        one = lambda i: F.struct(F.lit(language).alias("language"), i.alias("part"), F.array_join(F.slice(c, i * SNIPPET + 1, SNIPPET), "\n").alias("code"))
        return F.when(F.size(c) > 0, F.transform(starts, one))

    return text.let(code, cut)


def _expected(language, forms):
    case = lambda i: "CASE " + " ".join(f"WHEN m = {k} THEN {quote(f[i]) if isinstance(f[i], str) else f[i]}" for k, f in enumerate(forms) if f[1]) + " END"
    return f"""SELECT doc_id, '{language}' AS language, {case(1)} AS rule, pos::BIGINT AS line, ({case(2)} + {case(3)} * n)::BIGINT AS "column"
  FROM (SELECT doc_id, pos, (pos - 1 + doc_id) % {len(forms)} AS m, length(regexp_replace(line, '{_WORD}', '', 'g')) AS n FROM ln) WHERE {case(1)} IS NOT NULL"""


@query(f"WITH ln AS ({sql_lines('documents')}) {_expected('js', JS)} UNION ALL {_expected('rust', RUST)}")
def lint_made_code(spark, sf_dir):
    words = F.transform(text.lines(F.col("text")), lambda x: F.regexp_replace(x, _WORD, ""))
    docs = texts(spark, sf_dir).select("doc_id", words.alias("words"))
    rows = docs.select("doc_id", F.explode(F.concat(snippets("js", JS), snippets("rust", RUST))).alias("s"))
    rows = rows.select("doc_id", "s.part", lint.lint(F.col("s.language"), F.col("s.code")).alias("l"))
    rows = rows.select("doc_id", "part", F.col("l.language").alias("language"), F.explode("l.findings").alias("f"))
    return rows.select("doc_id", "language", "f.rule", (F.col("f.line") + F.col("part") * SNIPPET).cast("long").alias("line"), F.col("f.column").cast("long").alias("column"))


#: By form: what a file of lines ends with, and whether it is well formed then.
YAML = (("", True), ("bad: [1, 2", False), ("\t- x", False), ("a: b: c", False), ("lines: again", False), ("last: {a: [b, 'c']}", True), ("k: *gone", False), ("k: &x 1\nl: *x", True))
CODE = (("", True), ("let = = 3;", False), ("f(1, 2;", False), ("let t = `a ${", False), ("let u = `a ${b} c` / 2;", True), ("let v = 3 4;", False), ('let w = /[/"]/.test(x);', True), ("}", False))


@query(
    "WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) % 8 AS m FROM documents) SELECT doc_id, "
    + ", ".join(f"list_contains([{', '.join(str(i) for i, (_, ok) in enumerate(forms) if ok)}], m) AS {name}" for name, forms in (("yaml_ok", YAML), ("js_ok", CODE)))
    + " FROM d"
)
def gate_made_files(spark, sf_dir):
    docs = texts(spark, sf_dir)
    words = F.filter(F.transform(text.lines(F.coalesce("text", F.lit(""))), lambda x: F.regexp_replace(x, _WORD, "")), lambda w: w != "")
    end = lambda forms: F.element_at(F.array(*[F.lit(f) for f, _ in forms]), (F.coalesce(F.octet_length("text"), F.lit(0)) % 8 + 1).cast("int"))
    docs = docs.select("doc_id", "text", words.alias("words"))
    items = lambda one: F.array_join(F.transform("words", one), "")
    yaml = F.concat(F.lit("id: "), F.col("doc_id").cast("string"), F.lit("\nlines:\n"), items(lambda w: F.concat(F.lit('  - text: "'), w, F.lit('"\n    also: plain\n'))), end(YAML), F.lit("\n"))
    js = F.concat(items(lambda w: F.concat(F.lit('const {a, b} = f("'), w, F.lit('");\n'))), end(CODE), F.lit("\n"))
    ok = lambda kind, code: patch.syntax_gate(F.lit(kind), code).isNull()
    return docs.select("doc_id", ok("yaml", yaml).alias("yaml_ok"), ok("js", js).alias("js_ok"))


# B4: rules from a table


@query(
    f"""WITH ln AS ({sql_lines('documents')}), r AS (SELECT item_id AS i, lower(substring(text, 1, 12)) AS p FROM benchmark WHERE text <> ''),
h AS (SELECT doc_id, pos, min(i) AS i FROM ln JOIN r ON contains(lower(line), p) GROUP BY doc_id, pos)
SELECT ln.doc_id, count(*) AS n_lines, count(h.i) AS n_custom, coalesce(sum(h.i), 0)::BIGINT AS rule_sum FROM ln LEFT JOIN h ON ln.doc_id = h.doc_id AND ln.pos = h.pos GROUP BY ln.doc_id"""
)
def noise_rules(spark, sf_dir):
    rules = table(spark, sf_dir, "benchmark").filter("text <> ''").select(F.col("item_id").alias("rule"), F.substring("text", 1, 12).alias("pattern"))
    rows = texts(spark, sf_dir).select("doc_id", F.explode(text.lines(F.col("text"))).alias("line"))
    met = noise.first_rules(rows, "line", rules)
    return met.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("rule").alias("n_custom"), F.coalesce(F.sum("rule"), F.lit(0)).alias("rule_sum"))
