"""Transcript entries: what one is, and what is left of it after trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import text as T
from snagline.functions import variants as V

CONTENT = "$.message.content"


def blocks(v: Column) -> Column:
    """Content blocks; null when the content is not an array."""
    return F.try_variant_get(v, CONTENT, "array<variant>")


def human_turn(v: Column) -> Column:
    """A prompt someone typed: a user entry with text, not injected context."""
    has_text = F.exists(blocks(v), lambda b: V.string_at(b, "$.type") == "text")
    is_text = V.kind(V.at(v, CONTENT)) == "STRING"
    return F.coalesce(
        (V.string_at(v, "$.type") == "user")
        & ~V.is_true_at(v, "$.isMeta")
        & F.coalesce(is_text | F.coalesce(has_text, F.lit(False)), F.lit(False)),
        F.lit(False),
    )


def error_blocks(v: Column) -> Column:
    """Tool results that report an error."""
    return F.filter(
        blocks(v),
        lambda b: (V.string_at(b, "$.type") == "tool_result") & V.is_true_at(b, "$.is_error"),
    )


def n_error_blocks(v: Column) -> Column:
    return F.coalesce(F.size(error_blocks(v)), F.lit(0)).cast("bigint")


def tool_error_entry(v: Column) -> Column:
    return n_error_blocks(v) > 0


def denial_entry(v: Column) -> Column:
    return V.is_present(v, "$.toolDenialKind") & ~V.is_json_null(v, "$.toolDenialKind")


def _object(*parts: Column) -> Column:
    """JSON object text from `"key":value` parts; null parts are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _part(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{key}":'), value)


def _json_at(v: Column, path: str) -> Column:
    """JSON text of what lies under `path`, null when missing."""
    return F.to_json(V.at(v, path))


def _long_string(v: Column, limit: int) -> Column:
    text = V.string_at(v, "$")
    return F.when(F.length(text) > limit, text)


def _capped_input(v: Column, cap: int) -> Column:
    def one(item: Column) -> Column:
        long = _long_string(item["value"], cap)
        short = F.concat(
            F.left(long, F.lit(cap)), F.lit("["), item["key"], F.lit(": "),
            F.octet_length(long), F.lit(" bytes elided]"),
        )
        value = F.when(long.isNotNull(), V.json_string(short)).otherwise(F.to_json(item["value"]))
        return F.concat(V.json_string(item["key"]), F.lit(":"), value)

    entries = F.map_entries(F.try_variant_get(v, "$.input", "map<string,variant>"))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, one), ","), F.lit("}"))


def _result_content(v: Column, cap: int, head: int) -> Column:
    text = V.string_at(v, "$.content")
    too_long = F.when(F.length(text) > cap, text)
    error = F.when(
        too_long.isNotNull(),
        V.json_string(T.elide_payload(too_long, cap, "error content")),
    ).otherwise(F.coalesce(_json_at(v, "$.content"), F.lit("null")))
    quiet = F.when(text.isNotNull(), V.json_string(T.stub_payload(text, head))).otherwise(
        F.lit('"[tool_result: non-string payload elided]"')
    )
    return F.when(V.is_true_at(v, "$.is_error"), error).otherwise(quiet)


def compact_block(
    b: Column, input_cap: int = fixed.INPUT_FIELD_CAP, error_cap: int = fixed.ERROR_CAP, stub_head: int = fixed.STUB_HEAD
) -> Column:
    """JSON text of one trimmed block; null when the block is dropped.

    Longer input fields and error payloads are cut to their caps; other results
    keep a head.
    """
    kind = V.string_at(b, "$.type")
    is_error = F.when(V.is_true_at(b, "$.is_error"), "true").otherwise("false")
    return (
        F.when(kind.isin("thinking", "redacted_thinking"), F.lit(None).cast("string"))
        .when(
            kind == "text",
            _object(F.lit('"type":"text"'), _part("text", F.coalesce(_json_at(b, "$.text"), F.lit('""')))),
        )
        .when(
            kind == "tool_result",
            _object(
                F.lit('"type":"tool_result"'), _part("is_error", is_error),
                _part("tool_use_id", _json_at(b, "$.tool_use_id")),
                _part("content", _result_content(b, error_cap, stub_head)),
            ),
        )
        .when(
            kind == "tool_use",
            _object(
                F.lit('"type":"tool_use"'), _part("id", _json_at(b, "$.id")),
                _part("name", _json_at(b, "$.name")), _part("input", _capped_input(b, input_cap)),
            ),
        )
        .when(V.kind(b).startswith("OBJECT"), F.to_json(b))
    )


def compact_blocks(v: Column, **caps: int) -> Column:
    """JSON text of the trimmed content: a string as it is, else its blocks; `caps` as in `compact_block`."""
    kept = F.filter(F.transform(blocks(v), lambda b: compact_block(b, **caps)), lambda t: t.isNotNull())
    listed = F.concat(F.lit("["), F.coalesce(F.array_join(kept, ","), F.lit("")), F.lit("]"))
    return F.when(V.kind(V.at(v, CONTENT)) == "STRING", _json_at(v, CONTENT)).otherwise(listed)


def compact_entry(v: Column, **caps: int) -> Column:
    """JSON text of an entry without its envelope; `caps` as in `compact_block`."""
    message = F.when(
        V.kind(V.at(v, "$.message")).startswith("OBJECT"),
        _object(_part("role", _json_at(v, "$.message.role")), _part("content", compact_blocks(v, **caps))),
    )
    denial = F.when(denial_entry(v), _json_at(v, "$.toolDenialKind"))
    return _object(
        _part("type", F.coalesce(_json_at(v, "$.type"), F.lit("null"))),
        _part("isMeta", _json_at(v, "$.isMeta")),
        _part("message", message),
        _part("toolDenialKind", denial),
    )


def _strings(values: Column) -> Column:
    """The strings among an array of values."""
    return F.filter(F.transform(values, lambda x: V.string_at(x, "$")), lambda x: x.isNotNull())


def text_fields(v: Column) -> Column:
    """The texts of a trimmed entry that may be cut further, as an array."""

    def of_block(b: Column) -> Column:
        own = F.filter(F.array(V.string_at(b, "$.text"), V.string_at(b, "$.content")), lambda x: x.isNotNull())
        given = _strings(F.map_values(F.try_variant_get(b, "$.input", "map<string,variant>")))
        return F.concat(own, F.coalesce(given, F.array().cast("array<string>")))

    whole = V.string_at(v, CONTENT)
    listed = F.flatten(F.transform(blocks(v), of_block))
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.coalesce(listed, F.array().cast("array<string>")))


def _cut_value(value: Column, cap: Column) -> Column:
    text = V.string_at(value, "$")
    return F.when(text.isNotNull(), V.json_string(T.head_tail_excerpt(text, cap))).otherwise(F.to_json(value))


def _cut_object(value: Column, cap: Column, keys: list[str] | None = None) -> Column:
    """An object with the strings under `keys` (all, if None) cut, and those of an `input` in it."""

    def one(item: Column) -> Column:
        name, x = item["key"], item["value"]
        cut = _cut_value(x, cap)
        if keys is not None:
            within = F.when((name == "input") & V.kind(x).startswith("OBJECT"), _cut_object(x, cap)).otherwise(F.to_json(x))
            cut = F.when(name.isin(keys), cut).otherwise(within)
        return F.concat(V.json_string(name), F.lit(":"), cut)

    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, one), ","), F.lit("}"))


def _cut_block(b: Column, cap: Column) -> Column:
    kind = V.string_at(b, "$.type")
    given = V.at(b, "$.input")
    return (
        F.when(kind == "text", _object(F.lit('"type":"text"'), _part("text", _cut_value(V.at(b, "$.text"), cap))))
        .when(
            kind == "tool_result",
            _object(
                F.lit('"type":"tool_result"'), _part("is_error", _json_at(b, "$.is_error")),
                _part("tool_use_id", _json_at(b, "$.tool_use_id")), _part("content", _cut_value(V.at(b, "$.content"), cap)),
            ),
        )
        .when(
            kind == "tool_use",
            _object(
                F.lit('"type":"tool_use"'), _part("id", _json_at(b, "$.id")), _part("name", _json_at(b, "$.name")),
                _part("input", F.when(V.kind(given).startswith("OBJECT"), _cut_object(given, cap)).otherwise(F.to_json(given))),
            ),
        )
        .otherwise(_cut_object(b, cap, ["text", "content"]))
    )


def cut_entry(v: Column, cap: Column) -> Column:
    """JSON text of a trimmed entry, every text cut to `cap` characters."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(blocks(v), lambda b: _cut_block(b, cap)), ","), F.lit("]"))
    content = F.when(V.string_at(v, CONTENT).isNotNull(), _cut_value(V.at(v, CONTENT), cap)).otherwise(listed)
    message = F.when(
        V.kind(V.at(v, "$.message")).startswith("OBJECT"),
        _object(_part("role", _json_at(v, "$.message.role")), _part("content", content)),
    )
    return _object(
        _part("type", F.coalesce(_json_at(v, "$.type"), F.lit("null"))), _part("isMeta", _json_at(v, "$.isMeta")),
        _part("message", message), _part("toolDenialKind", _json_at(v, "$.toolDenialKind")),
    )


def note(content: Column) -> Column:
    """JSON text of an entry that stands for something left out."""
    return F.concat(
        F.lit('{"type":"note","message":{"role":"system","content":'),
        V.json_string(content), F.lit("}}"),
    )


def malformed_note(line: Column, index: Column, excerpt_cap: int = fixed.MALFORMED_EXCERPT) -> Column:
    """A note that stands for a line that is not an entry."""
    excerpt = F.left(line, F.lit(excerpt_cap))
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r")):
        excerpt = F.replace(excerpt, F.lit(raw), F.lit(shown))
    quoted = F.when(
        excerpt.contains("'") & ~excerpt.contains('"'), F.concat(F.lit('"'), excerpt, F.lit('"'))
    ).otherwise(F.concat(F.lit("'"), F.replace(excerpt, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return note(
        F.concat(F.lit("[malformed transcript line "), index, F.lit(" skipped: "), quoted, F.lit("]"))
    )
