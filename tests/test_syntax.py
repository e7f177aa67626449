"""Lexers, rules over tokens, and gates, on good and bad files."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sievemill.functions import lint, patch, tokens
from sievemill.functions.yamlcheck import yaml_error

YAML_GOOD = [
    "a: 1\nb:\n  - x\n  - y: 2\n    z: 3\nc: [1, 2, {d: e}]\n", "- a\n- b:\n    c: d\n-\n  e: f\n", "", "# only\n", "plain scalar\n", "a: |\n  text: with\n   : odd\nb: >-\n  folded\n",
    "a: \"quoted: yes\n  more\"\nb: 'it''s'\n", "a: &x {b: 1}\nc: *x\n<<: *x\n", "a:\n- 1\n- 2\nb: 3\n", "---\na: 1\n---\nb: 2\n...\n", "a: http://x.y/z#frag # c\n", "key with space: v\n\"q k\": v\n? complex\n: value\n",
    "a: [\n  1,\n  2\n]\nb: {x: 1,\n  y: 2}\n", "a: b\n  continued\nc: d\n", "- - 1\n  - 2\n- - 3\n", "a: !!str 1\nb: ! x\n", "a:\n  b:\n    c: 1\n  d: 2\n",
    "on: push\njobs:\n  build:\n    steps:\n      - uses: x/y@v4\n      - name: Run\n        run: |\n          echo a: b\n\n          make\n", "[1, 2]\n", "{a: 1, 'b': [x]}\n", "a: \n  - b\n", "a: x,y\n", "%YAML 1.2\n---\na: 1\n", "a: 12:30\n", "- a: 1\n  b: 2\n- a: 3\n",
]
YAML_BAD = [
    "a: [1, 2", "a:\n\t- b\n", "a: b: c\n", "a: 1\n  b: 2\n", "a: 1\n- b\n", "- a\nb: 1\n", "a: \"x\n", "a: 1\na: 2\n", "a: *nope\n", "a: @x\n", "a: {b: 1\n", "a: [1, 2}\n", "a:\n   b: 1\n  c: 2\n", "a: [1] x\n", "a: 'x' y\n", "{a: 1}}\n", "a: [,]\n",
    "just text\na: 1\n", "a: 1\njust text\n", "a: `x`\n", "a: " + "[" * 300,
]
JS_GOOD = [
    "let a = 3;\nif (a) { b(); }", "const f = (x) => x / 2 / 3;", "x = a ? b : c;", "const {a, b = 2, ...c} = d;", "for (const x of y) /re\"/.test(x) && z();", "let s = `a ${b ? `c ${d}` : '}'} e`;",
    "class A extends B { static x = 1; get y() { return this.#z; } async *g() { yield* h(); } }", "import x, {y as z} from 'm';\nexport default function* f() {}", "let t: Map<string, Array<number>> = new Map();",
    "type A<T = string> = T extends infer U ? U : never;", "interface X { a?: string; (b: number): void }", "a?.b?.[0]?.(1);", "var r = a++ / 2; var q = /[/\"]/g;", "let v = <div>don't {x} (</div>;",
    "abstract class Q { abstract m(): void; private readonly x!: number }", "let n = 1e+5 + 0x1F + 1_000n + .5;", "async function f() { for await (const x of y) {} }", "@Comp({a: 1}) class Z { @Input() a = 1; @Out b: c }", "x = {a, 'b': 1, [c]: 2, get d() { return 1; }};",
    "declare module 'x' { export const y: string; }", "let u: | 'a' | 'b' = 'a';", "#!/usr/bin/env node\nlet x = 1;", "x = a\n  && b\n  || c",
]
JS_BAD = ["let = = 3;", "let a = 3 4;", "f(1, 2", "a = ;", "let s = `abc ${x", "let s = `abc", "foo bar", "if (a { b }", "let x = 'unterminated;\n", "x = == y", "const = 5;", "}", "a = (1 + 2]];", "x = 3 %;", "\"a\" \"b\"", "/* open", "let a = 'x' y;", "(" * 300]
RUST_GOOD = [
    "fn main() { let x: &'static str = \"a\"; println!(\"{} {}\", x, 1); }", "impl<'a, T: Clone + 'a> Foo<'a> for Bar<T> where T: Copy { const N: usize = 3; }", "/* a /* b */ c */ let c = '\"'; let d = '\\'';",
    "match x { Some(1..=5) | None => {}, _ if y >= 2 => (), }", "let r = r#\"a \"b\" c\"#; let b = b\"x\"; let z = br##\"y\"#\"##;", "macro_rules! m { ($a:expr => $b:tt) => { $a = = $b }; }", "#[derive(Debug, Clone)]\npub(crate) struct A<T = u8> { x: Vec<Vec<u8>>, }",
    "let f = |a: u8, b| -> u8 { a + b };", "if !(a) && !b { return; }", "let x = 1.0e-5_f64 + 0xFF_u8 as f64;", "for i in 0..n { x[i] %= 2; }", "'outer: loop { break 'outer; }", "let v: Vec<_> = x.iter().map(|&y| y * 2).collect::<Vec<_>>();",
]
RUST_BAD = ["let = = 3;", "fn f( { }", "let x = ;", "let s = \"abc", "/* /* */", "foo bar", "fn main() { x = == y; }", "let a = 3 4;", "}", "let y = (1 + 2];"]


@pytest.mark.parametrize("kind, good, bad", [("yaml", YAML_GOOD, YAML_BAD), ("js", JS_GOOD, JS_BAD), ("rs", RUST_GOOD, RUST_BAD), ("toml", ["a = 1"], ["a = "]), ("json", ["{}"], ["{"]), ("py", ["x = 1"], ["x ="])])
def test_gates(kind, good, bad):
    assert [x for x in good if patch.syntax_error(kind, x)] == []
    assert [x for x in bad if not patch.syntax_error(kind, x)] == []


def found(language, code):
    return [(f["rule"].split("/")[1], f["line"], f["column"], f["snippet"]) for f in lint.analyze(language, code)[4]]


@pytest.mark.parametrize("language, code, want", [
    ("js", 'a=/"/; eval(x); b=/"/;', [("dangerous-eval", 1, 8, "eval(x)")]),
    ("ts", "s=`${eval(x)}`", [("dangerous-eval", 1, 6, "eval(x)")]),
    ("js", "s = `a ${b + `eval(1) ${c}` + {d: eval(2)}.d} eval(3)`", [("dangerous-eval", 1, 35, "eval(2)")]),
    ("js", "class A { eval(x) { } }\no.eval(1); function eval(a) {} new eval(2)", []),
    ("js", "new Function; new Function('a'); Function('b'); new Function.x()", [("dangerous-eval", 1, 1, "new Function"), ("dangerous-eval", 1, 15, "new Function('a')"), ("dangerous-eval", 1, 34, "Function('b')")]),
    ("js", "eval?.(1); eval`x`", [("dangerous-eval", 1, 1, "eval?.(1)"), ("dangerous-eval", 1, 12, "eval`x`")]),
    ("js", "if (x) /a\"/.test(eval(y)); z = a / eval(b) / c", [("dangerous-eval", 1, 18, "eval(y)"), ("dangerous-eval", 1, 36, "eval(b)")]),
    ("js", "/* 😀 */ debugger\n;({debugger: 1}); x.debugger;", [("no-debugger", 1, 10, "debugger")]),
    ("rust", '/* /* */ panic!("x") */', []),
    ("rust", 'fn f<\'a>(x: &\'a str) { ::std::panic!("x"); let c = \'"\'; todo!() }', [("explicit-panic", 1, 24, '::std::panic!("x")'), ("explicit-panic", 1, 57, "todo!()")]),
    ("rust", 'println!("{}", panic!("n")); let s = r#"a" panic!()"#; unimplemented![\n1]', [("explicit-panic", 1, 56, "unimplemented![")]),
    ("rust", "macro_rules! m { () => { panic!() } } if !(a) { panic! {} } #[doc = \"panic!()\"] x != panic", [("explicit-panic", 1, 49, "panic! {}")]),
])
def test_rules_over_tokens(language, code, want):
    assert found(language, code) == want


def test_limits():
    assert lint.analyze("js", "(" * 300)[:2] == ("error", "AST nesting depth limit exceeded (depth > 128)")
    assert lint.analyze("rust", "a;" * 30_000)[1] == "AST node count limit exceeded (visited > 50000 nodes)"
    assert lint.analyze("js", "`${" * 200)[0] == "error"


def test_lexers_take_all_of_any_text():
    """No text is refused; tokens stand in order, do not overlap and hold all but white space and comments."""
    rng = random.Random(7)
    bits = ["`", "${", "}", "{", "(", ")", '"', "'", "/", "*", "//", "/*", "*/", "\\", "\n", " ", "a", "eval(", "r#\"", "\"#", "'a", "1", ".", "=", "😀", "é", "\x00", "return ", "!", "panic!("]
    for _ in range(3000):
        code = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))
        for lexer in (tokens.js_tokens, tokens.rust_tokens):
            at = 0
            for t in lexer(code):
                assert at <= t.at < t.end <= len(code)
                if lexer is tokens.rust_tokens or t.text == code[t.at : t.end]:
                    assert t.text == code[t.at : t.end]
                at = t.end
        for kind in ("js", "rs", "yaml"):
            patch.syntax_error(kind, code)
        lint.analyze("js", code), lint.analyze("rust", code)


def test_long_texts_stay_linear():
    for code in ("a: " + "x " * 200_000, "- 1\n" * 60_000, "a: [" + "1, " * 60_000 + "1]", "a: 'x" + "''" * 100_000 + "'"):
        assert yaml_error(code) is None
    assert patch.syntax_error("js", "x = a + " * 12_000 + "1") is None
    assert "node count" in patch.syntax_error("js", "x;" * 26_000)


def test_gate_column(spark):
    rows = [("yaml", "a: [1, 2"), ("yml", "a: 1"), ("ts", "let = = 3;"), (None, "x"), ("js", None)]
    got = [r["g"] is None for r in spark.createDataFrame(rows, "kind string, code string").select(patch.syntax_gate(F.col("kind"), F.col("code")).alias("g")).collect()]
    assert got == [False, True, False, True, True]


def test_yaml_takes_time_in_proportion_to_its_length():
    """The time of files of many quoted values, and of one long list in brackets, follows their length, not its square."""

    def seconds(text):
        best = 9.0
        for _ in range(3):
            began = time.process_time()
            assert yaml_error(text) is None
            best = min(best, time.process_time() - began)
        return best

    quoted = lambda k: "lines:\n" + '  - text: "some words of a line here"\n    also: plain\n' * k
    listed = lambda k: "k: [" + "a,\n " * k + "b]\n"
    for form in (quoted, listed):
        assert seconds(form(16000)) < 18 * seconds(form(1600))
    assert yaml_error(quoted(3) + '  - text: "open\n    also: plain\n') == "line 8: quote isn't closed"
    assert yaml_error("a: 'x\n\n  y'\nk: [a,\n b,\n , c]\n") == "line 6: unexpected ','"
