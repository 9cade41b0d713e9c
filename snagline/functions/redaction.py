"""Redaction steps as native column expressions.

Each step takes and returns a string column.  Word boundaries and blanks are
spelled out with Unicode classes, so that a letter such as "é" counts as a word
character.  Runs are entered at one place only (possessive quantifiers, look-behind),
which keeps every step linear in the length of the text.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions.settle import settle

WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
BLANK = r"\s\x0b\x1c-\x1f\x85\p{Z}"

PEM = f"(?s){fixed.PEM_PATTERN}"
# An edge before or after a character that is always a word character.
START, END = rf"(?<!{WORD})", rf"(?!{WORD})"
JWT = rf"{START}eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+{EDGE}"
# The scheme's run is entered at its first character; digits before the first
# letter travel in the kept group.
CREDENTIALS = (
    r"(?:\G|(?<![a-zA-Z0-9+.-]))([0-9+.-]*+[a-zA-Z][a-zA-Z0-9+.-]*+://)"
    rf"[^/@{BLANK}:]++:[^/@{BLANK}]++@"
)
KEY = (
    rf"{START}(?:sk-[A-Za-z0-9]{{10,}}|ghp_[A-Za-z0-9]{{10,}}|github_pat_[A-Za-z0-9_]{{10,}}"
    rf"|xox[a-zA-Z0-9-]{{10,}}|AKIA[A-Z0-9]{{12,20}}){EDGE}"
)
# A local part starts at the first word edge of its run; what lies before that
# edge is kept through group 1 or 2.
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = (
    rf"(?:\G|(?<![{_LOCAL}]))"
    rf"(?:(?<={WORD})([A-Za-z0-9_]*+)(?=[.%+-])|(?<!{WORD})([.%+-]*+)(?=[A-Za-z0-9_]))"
    rf"[{_LOCAL}]++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{END}"
)
_OCTET = r"(?:25[0-5]|2[0-4]\p{Nd}|1?\p{Nd}?\p{Nd})"
IPV4 = rf"{START}(?:{_OCTET}\.){{3}}{_OCTET}{END}"
IPV6_CANDIDATE = fixed.IPV6_CANDIDATE
IPV6_HINT = r":[0-9A-Fa-f]*:"
# One by one: a class of single characters is a table, one of ranges is asked range by range.
_TOKEN_CHARS = string.ascii_letters + string.digits + "+_-"
# Nearly every place fails at the first look, before the neighbours are asked.
TOKEN = rf"(?=[{_TOKEN_CHARS}]{{20}})(?<![={_TOKEN_CHARS}])[{_TOKEN_CHARS}]{{20,}}={{0,2}}(?![={_TOKEN_CHARS}])"
HOME = rf"{fixed.HOME_PREFIX}[^/{BLANK}]+"


def _quoted(words: Sequence[str]) -> str:
    return "|".join(r"\Q" + w.replace("\\E", "\\E\\\\E\\Q") + r"\E" for w in words)


def token_pattern(allowlist: Sequence[str]) -> str:
    """TOKEN, but a run that is exactly an allowlisted word does not match."""
    if not allowlist:
        return TOKEN
    spared = rf"(?!(?:{_quoted(allowlist)})(?![={_TOKEN_CHARS}]))"
    return TOKEN.replace(f"[{_TOKEN_CHARS}]{{20,}}", f"{spared}[{_TOKEN_CHARS}]{{20,}}", 1)


def _ipv6_grammar() -> str:
    h = "[0-9A-Fa-f]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = rf"(?:{octet}\.){{3}}{octet}"

    def groups(n: int) -> str:
        return "" if n == 0 else h if n == 1 else rf"{h}(?::{h}){{{n - 1}}}"

    def up_to(n: int) -> str:
        return "" if n == 0 else rf"(?:{h}(?::{h}){{0,{n - 1}}})?"

    forms = [rf"(?:{h}:){{6}}{v4}", rf"(?:{h}:){{7}}{h}"]
    forms += [f"{groups(n)}::{up_to(7 - n)}" for n in range(8)]
    forms += [rf"{groups(n)}::(?:{h}:){{0,{5 - n}}}{v4}" for n in range(6)]
    return "(?:" + "|".join(forms) + ")"


IPV6 = _ipv6_grammar()
# A lone colon glued on by a neighbouring label is not part of the address.
IPV6_WHOLE = rf"\A(:(?!:))?{IPV6}((?<!:):)?\z"


def _any_of(*parts: str) -> Callable[[Column], Column]:
    return lambda c: reduce(Column.__or__, [c.contains(p) for p in parts])


# What a text must hold for a pattern to match at all.  A plain substring search
# settles most texts before a pattern is tried.
HINTS: dict[str, Callable[[Column], Column]] = {
    "pem": _any_of("-----BEGIN "),
    "jwt": _any_of("eyJ"),
    "credentials": _any_of("://"),
    "key": _any_of("sk-", "ghp_", "github_pat_", "xox", "AKIA"),
    "email": _any_of("@"),
    "ipv4": lambda c: c.rlike(r"\p{Nd}\.\p{Nd}"),
    "home": _any_of("/Users/", "/home/"),
}


def _replace(name: str, pattern: str, replacement: str) -> Callable[[Column], Column]:
    hint = HINTS[name]
    return lambda c: F.when(
        hint(c), F.regexp_replace(c, F.lit(pattern), F.lit(replacement))
    ).otherwise(c)


redact_pem = _replace("pem", PEM, fixed.MARKERS["pem"])
redact_jwt = _replace("jwt", JWT, fixed.MARKERS["jwt"])
redact_url_creds = _replace("credentials", CREDENTIALS, "$1" + fixed.MARKERS["credentials"])
redact_keys = _replace("key", KEY, fixed.MARKERS["key"])
redact_email = _replace("email", EMAIL, "$1$2" + fixed.MARKERS["email"])
redact_ipv4 = _replace("ipv4", IPV4, fixed.MARKERS["ip"])
redact_home = _replace("home", HOME, fixed.MARKERS["home"])


def redact_token(c: Column, allowlist: Sequence[str] = fixed.TOKEN_ALLOWLIST) -> Column:
    return F.regexp_replace(c, F.lit(token_pattern(allowlist)), F.lit(fixed.MARKERS["token"]))


def redact_ipv6(c: Column) -> Column:
    """Split at the candidate runs, rewrite those that are addresses, join again.

    Only text with two colons around hex digits can hold an address; the rest
    passes by the array functions.
    """
    between = F.split(c, IPV6_CANDIDATE, -1)
    runs = F.transform(
        F.regexp_extract_all(c, F.lit(IPV6_CANDIDATE), F.lit(0)),
        lambda run: F.regexp_replace(
            run, F.lit(IPV6_WHOLE), F.lit("$1" + fixed.MARKERS["ip"] + "$2")
        ),
    )
    joined = F.array_join(
        F.zip_with(between, runs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    return F.when(c.rlike(IPV6_HINT), joined).otherwise(c)


def _inline_literal(literal: str) -> str:
    return r"(?iu)\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + r"\E"


def redact_denylist(c: Column, literals: Sequence[str]) -> Column:
    """Literals one after another, in list order, ignoring case.

    A later literal may match an earlier marker, so the order is part of the
    result.  Text that holds none of them is left alone after one look.
    """
    if not literals:
        return c
    out = c
    for literal in literals:
        out = F.regexp_replace(out, F.lit(_inline_literal(literal)), F.lit("[redacted]"))
    return F.when(denylist_hit(c, literals), out).otherwise(c)


def denylist_hit(c: Column, literals: Sequence[str]) -> Column:
    if not literals:
        return F.lit(False)
    return c.rlike("(?iu)" + _quoted(literals))


# The fixed order of the steps; an earlier one claims what a later, more generic
# one would break up.
STRUCTURED = [
    redact_pem, redact_jwt, redact_url_creds, redact_keys, redact_email, redact_ipv6, redact_ipv4,
]


def _apply(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in cols}) if cols else df


def scrub_corpus(
    df: DataFrame,
    text_cols: Sequence[str],
    link_cols: Sequence[str] = (),
    literals: Sequence[str] = (),
    allowlist: Sequence[str] = fixed.TOKEN_ALLOWLIST,
    runs_col: str | None = None,
) -> DataFrame:
    """Every built-in step, then the denylist, over whole texts.

    `link_cols` take only the structured steps, so that a commit hash in a link
    survives.  `runs_col` adds the word-shaped runs the token step removes.
    The steps are separate selects, because each reads its input more than once,
    and the result is settled, so that a filter on it is not pushed through them.
    """
    every = list(text_cols) + list(link_cols)
    for step in STRUCTURED:
        df = _apply(df, every, step)
    if runs_col:
        df = df.withColumn(
            runs_col, F.concat(*[F.coalesce(vocab_runs(F.col(c), allowlist), F.array()) for c in text_cols])
        )
    df = _apply(df, text_cols, lambda c: redact_token(c, allowlist))
    df = _apply(df, text_cols, redact_home)
    if literals:
        df = _apply(df, every, lambda c: redact_denylist(c, literals))
    return settle(df, {c: F.col(c) for c in [*every, *([runs_col] if runs_col else [])]})


def redact_url_safe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The structured steps alone: hashes and paths in a link survive."""
    return scrub_corpus(df, [], link_cols=cols)


def is_word_shaped(run: Column) -> Column:
    """Hyphenated or underscored words, upper-case names, camel-case names.

    Written as character tests without repeated groups, so that a run of any
    length is safe.
    """
    words = F.regexp_replace(run, r"\A(?:--?|_)", "")
    hyphenated = words.rlike(r"\A[A-Z]?[a-z]+[-_][a-z_-]*\z") & ~words.rlike(
        r"[-_][a-z]?(?:[-_]|\z)"
    )
    name = F.regexp_replace(run, r"\A_", "")
    upper = name.rlike(r"\A[A-Z]{2,}_[A-Z_]*\z") & ~name.rlike(r"_[A-Z]?(?:_|\z)")
    camel = (
        run.rlike(r"\A[A-Za-z]+\z") & run.rlike(r"[a-z][A-Z]") & ~run.rlike(r"[A-Z](?:[A-Z]|\z)")
    )
    return hyphenated | upper | camel


def vocab_runs(c: Column, allowlist: Sequence[str] = fixed.TOKEN_ALLOWLIST) -> Column:
    """Word-shaped runs the token step would remove, in order of occurrence.

    `c` is the text just before the token step.
    """
    runs = F.regexp_extract_all(c, F.lit(token_pattern(allowlist)), F.lit(0))
    return F.filter(runs, is_word_shaped)


PII_PATTERNS = {
    "pem": PEM,
    "jwt": JWT,
    "credentials": CREDENTIALS,
    "key": KEY,
    "email": EMAIL,
    "ipv4": IPV4,
    "token": TOKEN,
    "home": HOME,
}


def pii_counts(c: Column, patterns: dict[str, str] = PII_PATTERNS) -> dict[str, Column]:
    """Matches per pattern in the untouched text."""
    out = {}
    for name, pattern in patterns.items():
        n = F.regexp_count(c, F.lit(pattern)).cast("bigint")
        if name in HINTS:
            n = F.when(HINTS[name](c), n).otherwise(F.lit(0).cast("bigint"))
        out[f"n_{name}"] = n
    return out
