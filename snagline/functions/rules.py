"""Record rules compiled to one array-of-errors column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import variants as V
from snagline.functions.redaction import BLANK
from snagline.functions.settle import settle


@dataclass(frozen=True)
class Rule:
    """What a property must look like; the first broken test is reported."""

    type: str | None = None
    const: int | None = None
    enum: Sequence[str] | None = None
    pattern: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    min_items: int | None = None
    required: bool = False


@dataclass(frozen=True)
class Condition:
    """When the named properties have these values, require some and forbid others."""

    when: Mapping[str, str]
    require: Sequence[str] = ()
    forbid: Sequence[str] = ()


@dataclass(frozen=True)
class Field:
    """A property as the tests see it."""

    present: Column
    string: Column
    is_string: Column
    value: Column | None = None


def variant_field(v: Column, name: str) -> Field:
    value = V.at(v, f"$.{name}")
    is_string = F.coalesce(V.kind(value) == "STRING", F.lit(False))
    return Field(
        value.isNotNull(), F.when(is_string, F.try_variant_get(value, "$", "string")), is_string, value
    )


def field_casts(v: Column, names: Sequence[str]) -> dict[str, Column]:
    """All properties of a record in two casts of the whole object; compute these once.

    `_values` keeps each property as it is.  `_strings` holds the bytes of the strings:
    of all JSON values only a string can be cast to binary, so nothing else is there.
    """
    record = lambda kind: F.try_variant_get(v, "$", f"struct<{', '.join(f'`{n}`: {kind}' for n in names)}>")
    return {"_values": record("variant"), "_strings": record("binary")}


def cast_field(name: str) -> Field:
    value, text = F.col("_values")[name], F.col("_strings")[name]
    return Field(value.isNotNull(), text.cast("string"), text.isNotNull(), value)


def string_field(c: Column) -> Field:
    return Field(c.isNotNull(), c, c.isNotNull(), None)


# --- fixed values: the rules of a stored record -----------------------------
_LINK = rf"https?://[^{BLANK}]+"
RECORD_RULES = {
    "id": Rule("string", pattern=fixed.ID_PATTERN, required=True),
    "v": Rule(const=1, required=True),
    "type": Rule("string", enum=fixed.RECORD_TYPES, required=True),
    "producer": Rule("string", min_length=1, required=True),
    "ts": Rule("string", pattern=fixed.TS_PATTERN, required=True),
    "machine": Rule("string", enum=fixed.MACHINES, required=True),
    "source": Rule("string", enum=fixed.SOURCES, required=True),
    "session_id": Rule("string", min_length=1),
    "category": Rule("string", enum=fixed.CATEGORIES),
    "severity": Rule("string", enum=fixed.SEVERITIES),
    "title": Rule("string", min_length=1, max_length=100),
    "description": Rule("string", min_length=1, max_length=1000),
    "suggested_fix": Rule("string", max_length=500),
    "repo": Rule("string", min_length=1),
    "resolves": Rule("string", pattern=fixed.ID_PATTERN),
    "status": Rule("string", enum=fixed.STATUSES),
    "fix_url": Rule("string", pattern=_LINK, max_length=300),
}
RECORD_CONDITIONS = [
    Condition(
        {"type": fixed.REPORT},
        require=["category", "severity", "title", "description"],
        forbid=["resolves", "status", "fix_url"],
    ),
    Condition(
        {"type": fixed.RESOLUTION},
        require=["resolves", "status"],
        forbid=["category", "severity", "title", "description", "suggested_fix"],
    ),
    Condition({"machine": "default", "type": fixed.REPORT}, require=["repo"]),
    Condition({"machine": "strict"}, forbid=["repo", "session_id"]),
]
CLUSTER_RULES = {
    "improvement": Rule("string", required=True),
    fixed.MEMBERS_KEY: Rule("array", min_items=1, required=True),
    "target": Rule("string", required=True),
    "effort": Rule("string", required=True),
    "confidence": Rule("string", required=True),
}
CONSOLIDATION_RULES = {
    "cluster": Rule("integer", required=True),
    "issue": Rule("string", pattern=_LINK, required=True),
}
FILED_RULES = {
    fixed.MEMBERS_KEY: Rule("array", min_items=1, required=True),
    "target": Rule("string", required=True),
    "repo": Rule("string", required=True),
    "title": Rule("string", required=True),
    "labels": Rule("array", required=True),
    "url": Rule("string", required=True),
}
CONSOLIDATED_RULES = {
    fixed.MEMBERS_KEY: Rule("array", min_items=1, required=True),
    "target": Rule("string", required=True),
    "repo": Rule("string", required=True),
    "issue": Rule("string", pattern=_LINK, required=True),
}


def _broken(name: Column | str, rule: Rule, field: Field) -> Column:
    """The first broken test of one property, or null."""
    label = F.lit(name) if isinstance(name, str) else name
    tests: list[tuple[Column, str]] = []
    if rule.type == "string":
        tests.append((~field.is_string, "expected string"))
    if rule.type == "integer":
        tests.append((F.coalesce(V.kind(field.value) != "BIGINT", F.lit(True)), "expected integer"))
    if rule.type == "array":
        tests.append((~F.coalesce(V.kind(field.value).startswith("ARRAY"), F.lit(False)), "expected array"))
    if rule.const is not None:
        number = F.try_variant_get(field.value, "$", "double")
        is_number = V.kind(field.value).isin("BIGINT", "DOUBLE") | V.kind(field.value).startswith("DECIMAL")
        equal = (is_number & (number == rule.const)) | (
            V.is_true_at(field.value, "$") if rule.const == 1 else F.lit(False)
        )
        tests.append((~F.coalesce(equal, F.lit(False)), f"must equal {rule.const}"))
    if rule.enum is not None:
        tests.append((~field.string.isin(list(rule.enum)), "not an allowed value"))
    if rule.pattern is not None:
        tests.append((~field.string.rlike(rf"\A(?:{rule.pattern})\z"), "does not match required pattern"))
    if rule.min_length is not None:
        tests.append((F.length(field.string) < rule.min_length, f"shorter than minLength {rule.min_length}"))
    if rule.max_length is not None:
        tests.append((F.length(field.string) > rule.max_length, f"longer than maxLength {rule.max_length}"))
    if rule.min_items is not None:
        size = F.size(F.try_variant_get(field.value, "$", "array<variant>"))
        tests.append((size < rule.min_items, f"fewer than minItems {rule.min_items}"))
    out = None
    for test, message in tests:
        text = F.concat(label, F.lit(f": {message}"))
        out = F.when(test, text) if out is None else out.when(test, text)
    return F.when(field.present, out) if out is not None else F.lit(None).cast("string")


def unknown_keys(v: Column, known: Sequence[str]) -> Column:
    """Keys of an object that no rule names."""
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.array_except(keys, F.array(*[F.lit(k) for k in known]))


def _listed(found: Sequence[Column]) -> Column:
    """The messages that are there, as an array.

    Joined and split again on a character no message holds: unlike a filtered
    array this stays inside generated code.
    """
    joined = F.concat_ws("\x01", *found)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, "\x01"))


def _conditional(condition: Condition, fields: Mapping[str, Field]) -> Column:
    met = F.lit(True)
    for name, value in condition.when.items():
        met = met & F.coalesce(fields[name].string == value, F.lit(False))
    first = None
    tests = [(~fields[n].present, f"conditionally required property missing: {n}") for n in condition.require]
    tests += [(fields[n].present, f"conditionally forbidden property present: {n}") for n in condition.forbid]
    for test, message in tests:
        first = F.when(test, message) if first is None else first.when(test, message)
    return F.when(met, first)


def errors_of(
    fields: Mapping[str, Field],
    rules: Mapping[str, Rule],
    conditions: Sequence[Condition] = (),
    extra_keys: Column | None = None,
) -> Column:
    """All errors of a record, as an array; empty when it is valid."""
    found = [
        F.when(~fields[n].present, F.lit(f"missing required property: {n}"))
        for n, r in rules.items()
        if r.required
    ]
    found += [_broken(n, r, fields[n]) for n, r in rules.items() if n in fields]
    found += [_conditional(c, fields) for c in conditions]
    errors = _listed(found)
    if extra_keys is not None:
        unexpected = F.transform(extra_keys, lambda k: F.concat(F.lit("unexpected property: "), k))
        errors = F.concat(F.coalesce(unexpected, F.array()), errors)
    return errors


def validate_objects(
    df: DataFrame, v: str, rules: Mapping[str, Rule], conditions: Sequence[Condition] = (),
    out: str = "errors",
) -> DataFrame:
    """Parsed objects with their errors against a rule set."""
    read = settle(df, {**field_casts(F.col(v), list(rules)), "_extra": unknown_keys(F.col(v), list(rules))})
    errors = errors_of({n: cast_field(n) for n in rules}, rules, conditions, F.col("_extra"))
    return settle(read, {out: errors}).drop("_values", "_strings", "_extra")


def validate_nested(
    v: Column, path: Column, rules: Mapping[str, Rule], string_arrays: Sequence[str] = (fixed.MEMBERS_KEY,)
) -> Column:
    """Errors of one element of an array, each naming where it is.

    `path` is the element's place, such as "[3]".
    """
    is_object = F.coalesce(V.kind(v).startswith("OBJECT"), F.lit(False))

    def dotted(name: str) -> Column:
        return F.concat(path, F.lit(f".{name}"))

    fields = {n: variant_field(v, n) for n in rules}
    found: list[Column] = [
        F.when(~fields[n].present, F.concat(path, F.lit(f": missing required property: {n}")))
        for n, r in rules.items()
        if r.required
    ]
    found += [_broken(dotted(n), r, fields[n]) for n, r in rules.items()]
    errors = _listed(found)
    unexpected = F.transform(
        F.coalesce(unknown_keys(v, list(rules)), F.array().cast("array<string>")),
        lambda k: F.concat(path, F.lit(": unexpected property: "), k),
    )

    def not_strings(name: str) -> Column:
        items = F.coalesce(
            F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>")
        )
        named: Callable[[Column, Column], Column] = lambda item, i: F.when(
            F.coalesce(V.kind(item) != "STRING", F.lit(True)),
            F.concat(path, F.lit(f".{name}["), i, F.lit("]: expected string")),
        )
        return F.filter(F.transform(items, named), lambda e: e.isNotNull())

    members = [not_strings(n) for n in string_arrays if n in rules]
    return F.when(is_object, F.concat(unexpected, errors, *members)).otherwise(
        F.array(F.concat(path, F.lit(": expected object")))
    )
