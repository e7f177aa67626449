"""Payloads cleaned on the JVM are those cleaned by the walk in Python."""

import json
import random

from pyspark.sql import functions as F

from sievemill.functions import payload, payload_tree

SECRET = "token=abcdefghij1\nat org.hibernate.X\nkeep"
PAYLOADS = [
    {"model": "m", "system": SECRET, "messages": [{"role": "user", "content": SECRET}, {"role": "assistant", "content": SECRET}, {"role": "tool", "content": 5}, {"role": "user"}, "x", None]},
    {"system": [{"type": "text", "text": SECRET}, SECRET, {"type": "thinking", "text": SECRET}], "prompt": SECRET, "input": [SECRET, {"text": SECRET}, 3], "n": 1.5},
    {"messages": [{"role": "user", "content": [{"type": "text", "text": SECRET}, {"type": "image", "text": SECRET}, SECRET, {"type": "tool_result", "content": [{"type": "text", "text": SECRET}, {"type": "image", "text": SECRET}, SECRET]}, {"type": "tool_result", "content": SECRET}, {"type": "tool_result"}, {"type": "x", "content": SECRET}, {"type": "tool_use", "input": SECRET}, {"text": 3, "content": SECRET}, [1]]}]},
    [1, 2], "s", 3, {"messages": {"a": 1}, "prompt": 3, "input": SECRET, "system": None}, {}, {"messages": []}, {"prompt": 'é "q" \\ \n api_key=\'secret value\'', "z": {"b": 1, "a": [True, None]}},
]


def value(rng, depth=0):
    """A value at random, of the shapes that payloads have and others."""
    kinds = [lambda: SECRET, lambda: "plain é", lambda: "", lambda: rng.randrange(9), lambda: None, lambda: True]
    if depth < 3:
        kinds += [lambda: [value(rng, depth + 1) for _ in range(rng.randrange(4))]] * 2
        kinds += [lambda: {k: value(rng, depth + 1) for k in rng.sample(["text", "content", "x"], rng.randrange(1, 4))} | {"type": rng.choice(["text", "image", "tool_result", "thinking", "tool_use", 3])}] * 3
    return rng.choice(kinds)()


def test_same_as_the_walk_in_python(spark):
    rng = random.Random(9)
    some = lambda: {k: v for k, v in (("messages", [{"role": rng.choice(["user", "assistant", "tool", None]), "content": value(rng)} for _ in range(rng.randrange(3))]), ("system", value(rng)), ("prompt", value(rng)), ("input", value(rng)), ("model", "m")) if rng.random() < 0.7}
    rows = [(i, json.dumps(p, ensure_ascii=bool(i % 2))) for i, p in enumerate([*PAYLOADS, *(some() for _ in range(300))])]
    rows += [(1000, "{broken"), (1001, None), (1002, "")]
    df = spark.createDataFrame(rows, "i int, p string").repartition(4)
    both = df.select("i", payload.sanitize_json(F.col("p")).alias("a"), payload_tree.sanitize_tree(F.col("p")).alias("b")).collect()
    plain = lambda s: None if s is None or s["payload"] is None else tuple(s)
    assert [(r["i"], plain(r["a"]), plain(r["b"])) for r in both if plain(r["a"]) != plain(r["b"])] == []


def test_no_python_worker(spark):
    plan = spark.createDataFrame([("{}",)], "p string").select(payload_tree.sanitize_tree(F.col("p")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
