from pyspark.sql import functions as F

from sievemill.functions import noise, payload, signature, text, traces

NOISY = ["/app/node_modules/x/y.js", "C:\\p\\node_modules\\x.js", "  at org.springframework.web.X", "x __libc_start_main y", "goroutine 5 [GC sweep wait]:", "... 5 common frames omitted", "runtime.goexit()", "/usr/lib/python3/x"]
CLEAN = ["/app/vendor_portal/x.php", "/home/chicago/src/main.go", "/app/inventory/a.py", "at com.acme.Main.run", "/app/dist/bundle.js"]
LABELS = {
    "at f (/a/node_modules/@s/p/i.js)": "node_modules/@s/p",
    "/v/site-packages/six.py": "site-packages/six",
    "at jakarta.servlet.X": "java:servlet",
    "/r/.cargo/registry/src/idx/tokio-1.2/x.rs": "cargo:tokio",
    "/go/pkg/mod/github.com/x@v1/y.go": "go:github.com/x@v1",
    "/var/lib/gems/rack-2.0/x.rb": "ruby:rack-2.0/x.rb"[:9],
    "plain line": None,
}


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_noise(spark):
    df = spark.createDataFrame([(x,) for x in NOISY + CLEAN], "t string").withColumn("i", F.monotonically_increasing_id())
    assert [r[0] for r in df.orderBy("i").select(noise.is_noise(F.col("t"))).collect()] == [True] * len(NOISY) + [False] * len(CLEAN)
    for line, label in LABELS.items():
        assert one(spark, line, noise.category) == label
    assert one(spark, "my Thing here", lambda c: noise.category(c, ["tHING"])) == "custom:tHING"


def test_the_hint_misses_no_marker():
    import re

    marks = [*noise.COMPONENTS, *noise.RUNTIME, *("at " + f for f in noise.FRAMES), *noise.NATIVE, " in _start (", *noise.IDLE, *("runtime." + x for x in noise.SCHEDULER), "... 5 common frames omitted"]
    assert all(re.search(noise.HINT, m) for m in [*marks, *(m.upper() for m in marks), *(m.replace("/", "\\") for m in marks)])


def brute_prune(log):
    """Line by line, with the state of idle goroutine blocks."""
    idle, kept, dropped = False, [], 0
    for line in log.split("\n"):
        bare = line.strip()
        if bare.startswith("goroutine "):
            idle = any(m in bare for m in noise.IDLE)
        if idle and line:
            dropped += 1
            continue
        idle = idle and bool(line)
        if payload._compiled()["low"].search(line.lower().replace("\\", "/")) or payload._compiled()["raw"].search(line):
            dropped += 1
        else:
            kept.append(line)
    return "\n".join(kept), dropped


def test_pruning(spark):
    logs = [
        "a\ngoroutine 1 [running]:\nmain\n\ngoroutine 2 [GC sweep wait]:\nx\n \ny\n\nz",
        "goroutine 2 [GC sweep wait]:\nx\n  goroutine 3 [select (no cases)]: q\nw\ngoroutine 4 [running]:\nkeep",
        "/a/node_modules/b\nmine", "", "\n", "only", "x\n\n\ny",
    ]
    for log in logs:
        got = one(spark, log, noise.pruned)
        want = brute_prune(log) if log else ("", 0)
        assert (got["kept"], got["dropped"]) == (want[0].removesuffix("\n") if log == "\n" else want[0], want[1])
        assert sum(c["n"] for c in got["categories"]) == got["dropped"]
        assert payload.prune_text(log) == got["kept"]
    assert one(spark, logs[2], lambda c: noise.summary(noise.pruned(c)["dropped"], noise.pruned(c)["categories"])) == "1 frames (node_modules/b: 1)"
    assert one(spark, "x", lambda c: noise.summary(noise.pruned(c)["dropped"], noise.pruned(c)["categories"])) == "0 frames (lossless)"


def test_lines(spark):
    for s, want in (("", []), ("a", ["a"]), ("a\r\nb\n", ["a", "b"]), ("a\n\n", ["a", ""]), ("\n", [""])):
        assert one(spark, s, text.lines) == want
    assert one(spark, " a \n\n b\t\n", text.lossless_compact) == " a\n b"
    assert one(spark, "aé日x", lambda c: text.truncated(c, 4, "~")) == "aé~"
    assert one(spark, "1\n2\n3", lambda c: text.tail(c, 2)) == "2\n3"


TRACES = {
    "rust": ("thread 'main' panicked at src/main.rs:42:5", [("src/main.rs", 42)]),
    "python": ('File "/a/x.py", line 3, in f\n/b/y.py:9: E\nFile "/v/site-packages/z.py", line 1', [("/a/x.py", 3), ("/b/y.py", 9)]),
    "js": ("TypeError: x\n at f (/a/b.ts:1:2)\n at file:///c/d.mjs:3:1\n at g (/node_modules/e.js:1:1)", [("/a/b.ts", 1), ("/c/d.mjs", 3)]),
    "go": ("panic: x\n\t/a/main.go:7 +0x1\n\t/usr/local/go/src/r.go:1", [("/a/main.go", 7)]),
    "java": ("Exception\n\tat com.a.B.c(B.java:4)\n\tat org.junit.X.y(X.java:1)\n (K.kt:8)", [("B.java", 4), ("K.kt", 8)]),
    "cpp": ("core dumped\n#0 in f src/a.cpp:88\n at /usr/include/x.h:3", [("src/a.cpp", 88)]),
    "php": ("Fatal error: x in /w/a.php:73\n#0 /w/b.php(32): f()", [("/w/a.php", 73), ("/w/b.php", 32)]),
    "csharp": ("at A.B() in C:\\x\\O.cs:line 23", [("C:\\x\\O.cs", 23)]),
    "ruby": ("app/a.rb:42:in `f'\n(b/c.rb:7) Error", [("app/a.rb", 42), ("b/c.rb", 7)]),
}


def test_locations(spark):
    for name, (log, want) in TRACES.items():
        got = one(spark, log, lambda c, name=name: traces.locations(c, name))
        assert [tuple(x) for x in got] == want, name
        assert one(spark, "nothing here", lambda c, name=name: traces.locations(c, name)) == []
    both = "panic: a.go:1\n panicked at b.rs:2 b.rs:2 c.rs:99999999999999999999"
    assert [tuple(x) for x in one(spark, both, traces.all_locations)] == [("b.rs", 2), ("a.go", 1)]


def test_signatures(spark):
    cases = {
        "x\nCaused by: db.Timeout: late\npanic: p": "db.Timeout: late",
        "panic: runtime error at 0xc000": "runtime error at",
        "thread 'main' panicked at 'boom'": "boom",
        "==1== ERROR: AddressSanitizer: heap-use on x": "heap-use",
        "Exception in thread \"m\" a.B: bad": "bad",
        "at Error: no\nTypeError: x is y": "TypeError: x is y",
        "first\nlast words\nat frame\n": "last words",
        "/only/path": "/only/path",
    }
    for log, want in cases.items():
        assert one(spark, log, signature.error_query) == want
    assert one(spark, "at x\n#1", signature.error_query) is None
    assert one(spark, " \n", signature.search_query) is None
    items = '{"items":[{"title":"a &amp;lt; b","link":"l","is_answered":true},{"link":"x"},{"title":"q","link":"m","is_answered":false},{"title":"z","link":"n","is_answered":true}]}'
    report = one(spark, items, signature.search_report)
    assert "a < b" in report and "q" in report and "z" not in report
    assert one(spark, "{}", signature.search_report) is None
