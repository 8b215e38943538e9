"""SQL fragments shared by the check queries."""

from __future__ import annotations

from scriptorium.functions import text as tx
from scriptorium.plans.fixtures import quoted

JA = quoted(f"[{tx.JAPANESE}]")
WS = quoted(tx.WHITESPACE)

FILENAME = "split_part(path, '/', -1)"
PARENT = r"regexp_extract(path, '^(.*)/[^/]*$', 1)"
SUFFIX = rf"regexp_extract({FILENAME}, '^.+(\.[^.]+)$', 1)"
EXTENSION = f"CASE WHEN {SUFFIX} = '' THEN '(no extension)' ELSE lower({SUFFIX}) END"
IS_CODE = r"regexp_matches(lower(path), '\.(c|h|cpp|hpp|java|js|py|rs|go)$')"


def re2(pattern: str) -> str:
    """A possessive pattern for an automaton, which has no use for that."""
    return pattern.replace("++", "+").replace("*+", "*").replace("?+", "?")


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def ends_with_any(expr: str, suffixes) -> str:
    return "(" + " OR ".join(f"ends_with({expr}, {quoted(s)})" for s in suffixes) + ")"
