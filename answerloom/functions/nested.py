"""Text out of nested response JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom.functions.common import col_of, let, strict_json

# fixed values: keys that carry text, tried first, and keys that never do
TEXT_KEYS = [
    "content", "text", "value", "output_text", "response", "answer", "final", "refusal",
    "reasoning", "reasoning_content", "thinking", "message", "parts",
]
METADATA_KEYS = ["id", "type", "role", "index", "finish_reason", "logprobs", "usage"]
ITEM_KEYS = ["text", "content", "value"]
# fixed values: where the answer and the thinking may stand, in order of preference
CONTENT_PATHS = [
    "$.choices[0].message.content", "$.choices[0].text", "$.choices[0].content",
    "$.choices[0].output_text", "$.choices[0].delta", "$.response", "$.output_text",
    "$.output", "$.message", "$.messages", "$.completion",
]
THINKING_PATHS = [
    "$.choices[0].message.reasoning", "$.choices[0].message.reasoning_content",
    "$.choices[0].message.thinking", "$.choices[0].reasoning",
    "$.choices[0].reasoning_content", "$.choices[0].thinking", "$.reasoning",
    "$.reasoning_content", "$.thinking", "$.output",
]
MAX_DEPTH = 3
# Stands for text below MAX_DEPTH; no JSON text holds this character unescaped.
_DEEP = "\u0001"


def _keys(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _kind(value: Column) -> Column:
    return F.substring_index(F.schema_of_variant(value), "<", 1)


def variant_text(value: Column, depth: int = MAX_DEPTH) -> Column:
    """Text inside a JSON value, '' when there is none; nesting below ``depth`` gives a mark."""

    def as_text(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))

    def of_array(v: Column) -> Column:
        def item(x: Column) -> Column:
            fields = F.try_variant_get(x, "$", "map<string,variant>")
            present = F.filter(_keys(ITEM_KEYS), lambda k: F.map_contains_key(fields, k))
            return F.when(
                _kind(x) == "OBJECT", as_text(F.try_element_at(fields, F.get(present, F.lit(0))))
            ).otherwise(as_text(x))

        items = F.try_variant_get(v, "$", "array<variant>")
        return F.array_join(F.transform(items, item), "")

    def of_object(v: Column) -> Column:
        if depth == 0:
            return F.when(F.to_json(v).rlike(':"[^"]'), F.lit(_DEEP)).otherwise("")

        def gather(fields: Column) -> Column:
            named = F.filter(_keys(TEXT_KEYS), lambda k: F.map_contains_key(fields, k))
            others = F.filter(
                F.map_keys(fields),
                lambda k: ~F.array_contains(_keys(METADATA_KEYS + TEXT_KEYS), k),
            )
            # One nested read for both kinds of keys keeps the expression small.
            texts = F.transform(
                F.concat(named, others),
                lambda k: variant_text(F.try_element_at(fields, k), depth - 1),
            )

            def choose(t: Column) -> Column:
                first = F.array_join(F.slice(t, F.lit(1), F.size(named)), "")
                rest = F.slice(t, F.size(named) + 1, F.size(t))
                return F.coalesce(F.nullif(first, F.lit("")), F.array_join(rest, ""))

            return F.when(F.size(named) + F.size(others) > 0, let(texts, choose)).otherwise("")

        return let(F.try_variant_get(v, "$", "map<string,variant>"), gather)

    kind = _kind(value)
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit(""))
        .when(kind == "ARRAY", of_array(value))
        .when(kind == "OBJECT", of_object(value))
        .otherwise(as_text(value))
    )


def _first_text(value: Column, paths: list[str]) -> Column:
    found = F.array(*[F.try_variant_get(value, p, "variant") for p in paths])
    texts = F.transform(found, lambda v: variant_text(v))
    return F.coalesce(F.get(F.filter(texts, lambda s: s != ""), F.lit(0)), F.lit(""))


def response_fields(raw: Column | str) -> Column:
    """``struct(content, thinking, error)`` of one raw response line.

    Content falls back to the thinking text. Lines without usable text, or with text nested
    deeper than ``MAX_DEPTH``, get an error and are meant for a quarantine table.
    """

    def fields(v: Column) -> Column:
        choices = F.try_variant_get(v, "$.choices", "array<variant>")
        plain = F.when(
            _kind(F.try_variant_get(v, "$.choices[0].message", "variant")) == "STRING",
            F.try_variant_get(v, "$.choices[0].message", "string"),
        )
        content = F.coalesce(F.nullif(plain, F.lit("")), _first_text(v, CONTENT_PATHS))
        thinking = _first_text(v, THINKING_PATHS)
        return F.struct(
            F.coalesce(F.nullif(content, F.lit("")), thinking).alias("content"),
            thinking.alias("thinking"),
            F.when(v.isNull(), "not JSON")
            .when(F.coalesce(F.size(choices), F.lit(0)) <= 0, "no choices")
            .alias("problem"),
        )

    def checked(f: Column) -> Column:
        deep = F.contains(F.concat(f["content"], f["thinking"]), F.lit(_DEEP))
        error = F.coalesce(
            f["problem"], F.when(deep, "too deep"), F.when(f["content"] == "", "no text")
        )
        return F.struct(
            F.when(error.isNull(), f["content"]).alias("content"),
            F.when(error.isNull(), f["thinking"]).alias("thinking"),
            error.alias("error"),
        )

    return let(strict_json(col_of(raw)), lambda v: let(fields(v), checked))
