"""Checking a Markdown text against the sections it must have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import once

#: Required sections where no template says otherwise, and the shortest content.
REQUIRED = {"summary": "Summary", "key changes": "Key Changes", "discussion & pitfalls": "Discussion & Pitfalls", "verification": "Verification"}
MIN_LENGTH, IGNORED = 10, ("pull request", "pr")
#: What does not count as content: comments, placeholder, hints and empty items.
COMMENT, PLACEHOLDER = r"(?s)<!--.*?-->", r"(?im)^\s*(?:[-*+]\s*)?\[answer here\]\s*$"
HINT, EMPTY_ITEM = r"(?m)^\s*\*.*?\?\*\s*$", r"(?m)^\s*[-*+]\s*$"


def parse(body: Column) -> Column:
    """array<struct<header, content>>: lower-cased headers with the text up to the next one."""
    parts = F.split(body, r"(?m)^(?=#+(?:\s|$))", -1)
    heads = F.filter(parts, lambda p: p.rlike(r"^#+(?:\s|$)"))
    return F.transform(
        heads,
        lambda p: F.struct(
            F.lower(F.trim(F.regexp_extract(p, r"^#+(?:[^\S\n]+([^\n]*))?", 1))).alias("header"), F.regexp_replace(p, r"^[^\n]*", "").alias("content")
        ),
    )


def required_of(template: str | None) -> dict[str, str]:
    """Sections a template asks for; the fixed ones without a template or headers."""
    found = {}
    for line in (template or "").split("\n"):
        head = line.lstrip("#")
        if line.startswith("#") and (not head or head[0].isspace()) and (name := head.strip()) and name.lower() not in IGNORED:
            found[name.lower()] = name
    return found or REQUIRED


def _rest(text: Column) -> Column:
    """What is left of a section's text to count."""
    for pattern in (PLACEHOLDER, HINT, EMPTY_ITEM):
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _section_errors(content: Column, name: str, least: int) -> Column:
    """array<string> of what is wrong with a section that is there."""

    def told(text: Column, rest: Column) -> Column:
        return F.array(
            F.when(text.rlike(PLACEHOLDER), F.concat(F.lit("placeholder: "), F.lit(name))),
            F.when(F.length(rest) < least, F.concat(F.lit("too short: "), F.lit(name), F.lit(" "), F.length(rest).cast("string"))),
        )

    text = F.trim(F.regexp_replace(F.regexp_replace(content, COMMENT, ""), r"^\s+|\s+$", ""))
    return once(text, lambda t: once(_rest(t), lambda r: told(t, r)))


def errors(body: Column, required: dict[str, str] | None = None, least: int = MIN_LENGTH) -> Column:
    """array<string> of what is wrong with a text, empty if nothing is. The text is parsed once, a section cleaned once."""

    def of(found: Column, key: str, name: str) -> Column:
        last = F.try_element_at(F.filter(found, lambda s: s["header"] == key), F.lit(-1))
        return once(last, lambda s: F.when(s.isNull(), F.array(F.concat(F.lit("missing: "), F.lit(name)))).otherwise(_section_errors(s["content"], name, least)))

    told = once(parse(body), lambda found: F.array_compact(F.flatten(F.array(*(of(found, key, name) for key, name in (required or REQUIRED).items())))))
    return F.when(body.isNull() | ~body.rlike(r"\S"), F.array(F.lit("empty"))).otherwise(told)
