"""Sanitising JSON payloads on the JVM: the tree is a VARIANT, its texts are cleaned by the engine's own columns.

All texts that may be cleaned are first gathered in one array; each is masked and pruned once; then the tree is put together
again, each text replaced by what it was cleaned to. The rules of which texts these are are those of ``payload``: no turns of
the assistant, none of the kept kinds of parts. What isn't JSON, has a key twice, or is larger than a VARIANT may be gives
null; keys come out sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions import noise, redaction
from sievemill.functions.payload import KEPT_NESTED, KEPT_PARTS
from sievemill.functions.text import let

NO_TEXTS = "array<string>"


def as_map(v: Column) -> Column:
    """Fields of an object; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_text(v: Column) -> Column:
    """The text of a string; null for anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def put(fields: Column, name: str, value: Column) -> Column:
    """An object with one field replaced."""
    return F.to_variant_object(F.map_concat(F.map_filter(fields, lambda k, _: k != name), F.create_map(F.lit(name), value)))


def kind(fields: Column) -> Column:
    return F.coalesce(F.try_variant_get(F.try_element_at(fields, F.lit("type")), "$", "string"), F.lit(""))


class Rule:
    """Which texts of a value are cleaned: of the value itself, of a list's strings, of fields of a list's objects."""

    def __init__(self, kept: tuple[str, ...], names: tuple[str, ...], inner: Rule | None = None, strings: bool = True) -> None:
        self.kept, self.names, self.inner, self.strings = kept, names, inner, strings

    def _field(self, fields: Column, one, nothing: Column) -> Column:
        """one(name, text) for the first of the names that holds a string."""
        out = nothing
        for n in reversed(self.names):
            t = as_text(F.try_element_at(fields, F.lit(n)))
            out = F.when(t.isNotNull(), one(n, t)).otherwise(out)
        return out

    def _walk(self, v: Column, text, part, other: Column, whole) -> Column:
        items = whole(as_array(v), part)
        return F.when(as_text(v).isNotNull(), text(as_text(v))).when(as_array(v).isNotNull(), items).otherwise(other)

    def texts(self, v: Column) -> Column:
        """array<string>."""
        none = F.array().cast(NO_TEXTS)

        def part(p: Column) -> Column:
            def of(fields: Column) -> Column:
                out = self._field(fields, lambda _, t: F.array(t), none)
                if self.inner:
                    held = F.try_element_at(fields, F.lit("content"))
                    out = F.when(kind(fields) == "tool_result", F.when(held.isNotNull(), self.inner.texts(held)).otherwise(none)).otherwise(out)
                return F.when(fields.isNull() | kind(fields).isin(*self.kept), none).otherwise(out) if self.kept else F.when(fields.isNull(), none).otherwise(out)

            inside = let(as_map(p), of)
            return F.when(as_text(p).isNotNull(), F.array(as_text(p))).otherwise(inside) if self.strings else inside

        return self._walk(v, lambda t: F.array(t), part, none, lambda a, f: F.flatten(F.transform(a, f)))

    def rebuilt(self, v: Column, new) -> Column:
        """The value with its texts replaced; new(text) is a variant."""

        def part(p: Column) -> Column:
            def of(fields: Column) -> Column:
                out = self._field(fields, lambda n, t: put(fields, n, new(t)), p)
                if self.inner:
                    held = F.try_element_at(fields, F.lit("content"))
                    out = F.when(kind(fields) == "tool_result", F.when(held.isNotNull(), put(fields, "content", self.inner.rebuilt(held, new))).otherwise(p)).otherwise(out)
                same = fields.isNull() | kind(fields).isin(*self.kept) if self.kept else fields.isNull()
                return F.when(same, p).otherwise(out)

            inside = let(as_map(p), of)
            return F.when(as_text(p).isNotNull(), new(as_text(p))).otherwise(inside) if self.strings else inside

        return self._walk(v, new, part, v, lambda a, f: F.to_variant_object(F.transform(a, f)))


CONTENT = Rule(KEPT_PARTS, ("text", "content"), inner=Rule(KEPT_NESTED, ("text",)))
SYSTEM, INPUT = Rule(KEPT_NESTED, ("text",), strings=False), Rule((), ())
PROMPT = "prompt"


def told(fields: Column) -> Column:
    """Whether a message's content is cleaned."""
    role = F.coalesce(F.try_variant_get(F.try_element_at(fields, F.lit("role")), "$", "string"), F.lit(""))
    return fields.isNotNull() & (role != "assistant") & F.try_element_at(fields, F.lit("content")).isNotNull()


def texts_of(body: Column) -> Column:
    """All texts of a payload (its fields) that are cleaned."""
    none = F.array().cast(NO_TEXTS)
    at = lambda n: F.try_element_at(body, F.lit(n))
    message = lambda m: let(as_map(m), lambda f: F.when(told(f), CONTENT.texts(F.try_element_at(f, F.lit("content")))).otherwise(none))
    messages = F.flatten(F.transform(as_array(at("messages")), message))
    prompt = F.when(as_text(at(PROMPT)).isNotNull(), F.array(as_text(at(PROMPT))))
    return F.concat(*[F.coalesce(x, none) for x in (messages, SYSTEM.texts(at("system")), prompt, INPUT.texts(at("input")))])


def rebuilt(body: Column, new) -> Column:
    at = lambda n: F.try_element_at(body, F.lit(n))
    message = lambda m: let(as_map(m), lambda f: F.when(told(f), put(f, "content", CONTENT.rebuilt(F.try_element_at(f, F.lit("content")), new))).otherwise(m))
    changed = {
        "messages": F.when(as_array(at("messages")).isNotNull(), F.to_variant_object(F.transform(as_array(at("messages")), message))),
        "system": SYSTEM.rebuilt(at("system"), new),
        PROMPT: F.when(as_text(at(PROMPT)).isNotNull(), new(as_text(at(PROMPT)))),
        "input": INPUT.rebuilt(at("input"), new),
    }

    def field(k: Column, v: Column) -> Column:
        return reduce(lambda out, n: F.when((k == n) & changed[n].isNotNull(), changed[n]).otherwise(out), changed, v)

    return F.to_variant_object(F.transform_values(body, field))


def sanitize_tree(payload: Column) -> Column:
    """struct(payload, raw_bytes, clean_bytes, secrets), as ``payload.sanitize_json`` gives, without a Python worker."""
    cleaned_text = lambda t: let(redaction.redact(t), lambda m: F.struct(t.alias("t"), noise.kept(m).alias("c"), (m != t).alias("changed")))

    def result(v: Column, body: Column, done: Column) -> Column:
        size = lambda f: F.aggregate(done, F.lit(0).cast("long"), lambda a, x: a + f(x))
        known = F.map_from_entries(F.array_distinct(F.transform(done, lambda x: F.struct(x["t"], x["c"]))))
        out = let(known, lambda m: rebuilt(body, lambda t: F.try_element_at(m, t).cast("variant")))
        return F.struct(
            F.to_json(F.when(body.isNotNull(), out).otherwise(v)).alias("payload"), size(lambda x: F.octet_length(x["t"])).alias("raw_bytes"),
            size(lambda x: F.octet_length(x["c"])).alias("clean_bytes"), size(lambda x: x["changed"].cast("int")).alias("secrets"),
        )

    def of(v: Column) -> Column:
        return let(as_map(v), lambda body: let(F.transform(F.when(body.isNotNull(), texts_of(body)).otherwise(F.array().cast(NO_TEXTS)), cleaned_text), lambda done: result(v, body, done)))

    return let(F.try_parse_json(payload), lambda v: F.when(v.isNotNull(), of(v)))
