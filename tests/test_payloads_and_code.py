import json

import pytest
from pyspark.sql import functions as F

from sievemill.functions import bodies, dialects, lint, patch, payload


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


def test_payload_parts(spark):
    secret = "token=abcdefghijk"
    body = {
        "system": [{"type": "text", "text": secret}, {"type": "image", "text": secret}],
        "prompt": secret, "input": [secret, 3],
        "messages": [
            {"role": "assistant", "content": secret}, {"role": "user", "content": secret + "\n/a/node_modules/x"},
            {"role": "user", "content": [secret, {"type": "thinking", "text": secret}, {"type": "text", "text": secret}, {"content": secret}, {"type": "tool_result", "tool_use_id": "i", "content": [{"text": secret}, {"type": "image", "text": secret}, secret]}, {"type": "tool_use", "input": secret}]},
        ],
    }
    got = one(spark, json.dumps(body), payload.sanitize_json)
    out = json.loads(got["payload"])
    text = json.dumps(out)
    assert got["secrets"] == text.count("[REDACTED]") == 9
    assert text.count(secret) == 5 and out["messages"][1]["content"] == "token=[REDACTED]"
    assert one(spark, "not json", payload.sanitize_json)["payload"] is None


def test_translation():
    ask = {"model": "m", "system": [{"text": "a"}, {"text": "b"}], "max_tokens": 5, "top_p": 0.5, "messages": [{"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": {"k": 1}}, {"type": "text", "text": "hi"}]}, {"role": "assistant", "content": [{"type": "tool_use", "id": "c", "name": "f", "input": {"x": 1}}]}], "tools": [{"name": "f"}]}
    out = json.loads(dialects.request_to_choices(json.dumps(ask)))
    assert [m["role"] for m in out["messages"]] == ["system", "tool", "user", "assistant"]
    assert out["messages"][0]["content"] == "a\nb" and out["messages"][1]["content"] == '{"k":1}'
    assert out["messages"][3]["content"] is None and out["messages"][3]["tool_calls"][0]["function"]["arguments"] == '{"x":1}'
    assert out["max_tokens"] == 5 and out["tools"][0]["function"]["parameters"] == dialects.NO_SCHEMA
    back = json.loads(dialects.request_to_blocks(json.dumps(out), "other"))
    assert back["model"] == "other" and back["system"] == "a\nb" and back["messages"][0]["content"][0]["type"] == "tool_result"
    assert back["messages"][2]["content"] == [{"type": "tool_use", "id": "c", "name": "f", "input": {"x": 1}}]
    assert json.loads(dialects.request_to_blocks("{}"))["max_tokens"] == 4096
    assert dialects.request_to_blocks("[]") is None


def test_answers():
    answer = {"id": "x", "choices": [{"finish_reason": "length", "message": {"content": "hey", "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": "[1]"}}]}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}}
    out = json.loads(dialects.response_to_blocks(json.dumps(answer)))
    assert out["id"] == "msg_x" and out["stop_reason"] == "tool_use" and out["content"][1]["input"] == {"raw": [1]}
    back = json.loads(dialects.response_to_choices(json.dumps(out), 7))
    assert back["created"] == 7 and back["choices"][0]["finish_reason"] == "tool_calls" and back["usage"]["total_tokens"] == 7
    errors = {'{"code":"invalid_api_key"}': "authentication_error", '{"type":"rate_limit_x"}': "rate_limit_error", '{"type":"invalid_request_error"}': "invalid_request_error", "{}": "api_error"}
    for e, kind in errors.items():
        assert json.loads(dialects.response_to_blocks(f'{{"error":{e}}}'))["error"]["type"] == kind
    events = dialects.chunk_events('{"choices":[{"delta":{"content":"a"},"finish_reason":"stop"}]}', True)
    assert [e.split("\n")[0] for e in events] == [f"event: {n}" for n in ("message_start", "content_block_start", "content_block_delta", "content_block_stop", "message_delta", "message_stop")]


def test_urls_and_routes(spark):
    for url, end, want in (("https://h/v1/messages?a=1", "v1/x", "https://h/v1/x?a=1"), ("https://h/messages", "/y", "https://h/y"), ("https://h/v1/chat/completions/z", "/y", "https://h/y"), ("https://h/p//", "/y", "https://h/p/y")):
        assert one(spark, url, lambda c, end=end: dialects.rewritten_url(c, end)) == want
    none = F.create_map().cast("map<string,string>")
    for conf, path, want in (("auto", "/v1/messages", "https://api.anthropic.com/v1/messages"), ("", "/api/x", "http://localhost:11434/api/x"), ("AUTO", "", "https://api.openai.com/"), ("http://u/v1/", "/v1/x", "http://u/v1/x"), ("http://u/v1", "/v1", "http://u/v1"), ("http://u", "x", "http://u/x")):
        assert one(spark, path, lambda c, conf=conf: dialects.upstream(F.lit(conf), c, none)) == want
    assert one(spark, "/v1/messages", lambda c: dialects.direction(c, F.lit("http://groq"))) == "blocks_to_choices"
    assert one(spark, "/v1/messages", lambda c: dialects.direction(c, F.lit("https://api.anthropic.com"))) == "none"
    assert one(spark, "/v1/chat/completions", lambda c: dialects.direction(c, F.lit("x"), F.create_map(F.lit("X-TARGET-provider"), F.lit("Anthropic")))) == "choices_to_blocks"


def test_streams_and_calls(spark):
    body = 'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: {"delta":{"text":"b"}}\ndata: [DONE]\ndata: {"delta":{"text":"c"}}'
    assert one(spark, body, dialects.streamed_text) == "ab"
    assert dialects.tool_call('so: {"name": "f", "arguments": {"x": 1}} ok') == '{"arguments":{"x":1},"name":"f"}'
    assert dialects.tool_call('{"name":"g"}') == '{"name":"g"}' and dialects.tool_call("none") is None


@pytest.mark.parametrize(("raw", "want"), [
    (b"3\r\nabc\r\n0\r\n\r\n", (b"abc", None)), (b"3;x\r\nabc\r\n2\r\nde\r\n0\r\n", (b"abcde", None)), (b"", (None, "Unexpected EOF in chunked body")), (b"3", (None, "Missing CRLF after chunk size")),
    (b"zz\r\n", (None, "Invalid hex in chunk size")), (b"fffffffff\r\n", (None, "Chunked payload exceeds maximum allowable size")), (b"5\r\nabc", (None, "Incomplete chunk data")), (b"3\r\nabcde", (None, "Missing CRLF after chunk data")),
])
def test_chunked(raw, want):
    assert bodies.unchunked(raw) == want


def test_rpc_lines(spark):
    df = spark.createDataFrame([('{"id":1,"method":"ping","params":{"a":1}}',), ("{",), ('{"id":2}',), (" ",)], "value string")
    got = [(r["method"], r["error"]) for r in bodies.rpc_lines(df).collect()]
    assert got == [("ping", None), (None, -32700), (None, -32600)]


LINT = [
    ("python", "def f():\n    g = open('x')\n    return g.read()\n", ["python/unclosed-open"]),
    ("py", "with open('x') as g:\n    g.read()\n", []),
    ("py", "from contextlib import closing\nx = closing(open('a'))\n", []),
    ("py", "f = open('x')\ntry:\n    f.read()\nfinally:\n    f.close()\n", []),
    ("py", "def open(x):\n    pass\nopen('x')\n", []),
    ("py", "m.eval()\nexec('1')\n", ["python/dangerous-exec-eval"]),
    ("py", "eval(1)\nx = = 2\n", ["python/dangerous-exec-eval"]),
    ("js", "eval('a'); new Function('b'); Function('c'); x.eval(1)", ["javascript/dangerous-eval"] * 3),
    ("ts", "// eval(1)\nconst s = 'debugger;';\ndebugger;\nfunction eval(x) {}", ["javascript/no-debugger"]),
    ("rust", 'panic!("x"); std::todo!(); my_panic!(); let s = "panic!()"; // todo!()', ["rust/explicit-panic"] * 2),
]


def test_lint(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in LINT] + [("cobol", "x"), ("py", "x" * (lint.MAX_BYTES + 1)), ("py", None)], "language string, code string")
    rows = [r["l"] for r in df.select(lint.lint(F.col("language"), F.col("code")).alias("l")).collect()]
    for r, (_, _, want) in zip(rows, LINT, strict=False):
        assert sorted(f["rule"] for f in r["findings"]) == sorted(want)
    assert rows[-3]["error"] == "Unsupported language: 'cobol'" and rows[-2]["error"].startswith("Payload too large") and rows[-1]["status"] is None
    assert lint.lint_js("/* é😀 */ eval(1)")[0][3:] == (1, 11, "eval(1)")
    assert lint.analyze("js", "(" * 300)[0] == "error"


def test_patches():
    assert patch.replaced("a\nb\na", "b", "c") == ("ok", "a\nc\na")
    assert patch.replaced("a\nb\na", "a", "c")[0] == patch.FOUND_MANY.format(2)
    assert patch.replaced("a", "z", "c")[0] == patch.FOUND_NONE
    assert patch.replaced("x\r\ny\r\nz", "x\ny", "p\nq") == ("ok", "p\r\nq\r\nz")
    assert patch.replaced("def f():\n        a\n        b\n", "a\nb", "c\nd") == ("ok", "def f():\n        c\n        d\n")
    assert patch.syntax_error("json", "{") and patch.syntax_error("toml", "a = 1") is None and patch.syntax_error("py", "x = = 1")
    assert patch.syntax_error("rs", "fn f() { (] }") and patch.syntax_error("js", "f('(')") is None and patch.syntax_error("yaml", "a:\n\tb: 1")
