"""Column functions over Markdown text and model replies. All are built-in expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as blank at the ends of a string (Unicode white space and the four separators).
SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """text without white space of any script at its ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def preview(content: Column, max_chars: int = 500) -> Column:
    """The start of a text without code and links; three dots if the whole text is longer than max_chars.

    Links lose their brackets before images are looked for, so that of an image `![a](u)` the text `!a` stays."""
    clean = F.regexp_replace(content, r"(?s)```.*?```", "")
    clean = F.regexp_replace(clean, r"`[^`]+`", "")
    clean = F.regexp_replace(clean, r"\[([^\]]+)\]\([^)]+\)", "$1")
    clean = F.regexp_replace(clean, r"!\[([^\]]*)\]\([^)]+\)", "")
    return F.concat(strip(F.substring(clean, 1, max_chars)), F.when(F.length(content) > max_chars, "...").otherwise(""))


def code_blocks(content: Column) -> Column:
    """array<struct<language, code>> of the fenced blocks of a text."""
    fence = F.lit(r"(?U)```(\w*)\n([\s\S]*?)```")
    both = F.arrays_zip(F.regexp_extract_all(content, fence, F.lit(1)).alias("language"), F.regexp_extract_all(content, fence, F.lit(2)).alias("code"))
    return F.transform(both, lambda x: F.struct(x["language"].alias("language"), x["code"].alias("code")))


def without_thinking(reply: Column) -> Column:
    return F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")


#: Labels that models put before an answer.
LABELS = ("摘要", "Summary", "描述", "Description")


def clean_reply(reply: Column) -> Column:
    """A reply without its thinking part, without label prefixes and lone colons at the start of lines, trimmed."""
    out = without_thinking(F.coalesce(reply, F.lit("")))
    for label in LABELS:
        out = F.regexp_replace(out, rf"(?iumd)^\*{{0,2}}{label}[:：]\*{{0,2}}(?U:\s*)", "")
    return strip(F.regexp_replace(out, r"(?md)^[:：](?U:\s*)", ""))


def unwrap_fence(reply: Column) -> Column:
    """The inside of a reply that is wrapped in one fence, marked as Markdown or not at all."""
    out = strip(reply)
    out = F.regexp_replace(out, r"\A```(?:markdown|md)?[ \t]*\n", "")
    return F.when(strip(reply).startswith("```"), strip(F.regexp_replace(out, r"\n?```\z", ""))).otherwise(out)


def json_body(reply: Column) -> Column:
    """The part of a reply that should be JSON: without a surrounding fence, else from the first { to the last }."""
    out = strip(reply)
    out = F.when(out.startswith("```"), F.regexp_replace(F.regexp_replace(out, r"\A[^\n]*(\n|\z)", ""), r"(^|\n)[ \t]*```[ \t]*\z", "")).otherwise(out)
    braces = F.regexp_extract(out, r"(?s)\{.*\}", 0)
    return F.when(strip(out).rlike(r"\A[\[{]") & strip(out).rlike(r"[\]}]\z"), strip(out)).otherwise(braces)


def tokens_estimate(chars: Column) -> Column:
    """Three characters count as a token."""
    return F.floor(chars / 3)


def cut_with_dots(text: Column, max_chars: int = 500) -> Column:
    return F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("..."))).otherwise(text)


def title_key(title: Column) -> Column:
    """Titles that differ only by case and white space have equal keys."""
    return F.regexp_replace(strip(F.lower(title)), r"(?U)\s+", " ")


def terms(text: Column) -> Column:
    """The words of a text: runs of ASCII letters and digits, lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
