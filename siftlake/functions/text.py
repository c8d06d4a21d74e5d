"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE = r"\b(?:A0[1-9]|A10|API[1-9]0?|LLM0[1-9]|LLM10)\b"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    """A closing newline starts a last, empty line; null counts 0."""
    return F.coalesce(F.size(lines(text)), F.lit(0))


def byte_count(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0))


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def codes_in(text: Column) -> Column:
    """Distinct category codes named in a text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CODE), F.lit(0)))


def exported_symbols(source: Column) -> Column:
    """Names that a module exports: declarations, then the outer names of export lists."""
    declared = F.regexp_extract_all(source, F.lit(r"export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)"), F.lit(1))
    listed = F.flatten(F.transform(F.regexp_extract_all(source, F.lit(r"export\s*\{([^}]*)\}"), F.lit(1)), lambda inner: F.split(inner, ",")))
    outer = F.transform(listed, lambda item: F.regexp_extract(F.trim(item), r"([A-Za-z_$][\w$]*)$", 1))
    return F.array_distinct(F.concat(declared, F.filter(outer, lambda name: name != "")))


def numbered(text: Column) -> Column:
    """Each line after its number, padded to the width of the last number."""
    all_lines = lines(text)
    width = F.length(F.size(all_lines).cast("string"))
    return F.array_join(F.transform(all_lines, lambda line, i: F.concat(F.lpad((i + 1).cast("string"), width, " "), F.lit(": "), line)), "\n")


def truncated(text: Column, most: int = 15_000, notice: str = "\n[truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(notice))).otherwise(text)


KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"


def redact_keys(text: Column) -> Column:
    """Private-key blocks replaced by a notice of as many lines."""
    breaks = lambda block: F.length(block) - F.length(F.replace(block, F.lit("\n"), F.lit("")))
    notice = lambda block: F.when(block.isNull(), "").otherwise(F.concat(F.lit("[REDACTED PRIVATE KEY]"), F.repeat(F.lit("\n"), breaks(block))))
    blocks = F.regexp_extract_all(text, F.lit(KEY_BLOCK), F.lit(0))
    return F.array_join(F.zip_with(F.split(text, KEY_BLOCK, -1), blocks, lambda rest, block: F.concat(rest, notice(block))), "")


def fenced_json(text: Column, variant: str = "object") -> Column:
    """The JSON of a model's answer: a fenced block's body, else what looks like JSON.

    object  else from the first brace to the last; null without one
    widest  else from the first bracket of any kind to the last of that kind; else the text, trimmed
    opening only a fence with its own lines counts; else from the first bracket on; else "{}"
    """
    fence = r"(?s)```(?:json)?\s*\n(.*?)\n```" if variant == "opening" else r"(?s)```(?:json)?\s*(.*?)```"
    fenced, bare = F.regexp_extract(text, fence, 1), F.btrim(text, F.lit(" \t\r\n"))
    if variant == "object":
        braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
        return F.when(fenced != "", F.btrim(fenced, F.lit(" \t\r\n"))).when(braces != "", braces)
    if variant == "widest":
        wide = F.regexp_extract(text, r"(?s)(\[.*\]|\{.*\})", 1)
        return F.when(text.rlike(fence), F.btrim(fenced, F.lit(" \t\r\n"))).when(wide != "", wide).otherwise(bare)
    if variant == "opening":
        rest = F.regexp_extract(bare, r"(?s)[\[{].*", 0)
        return F.when(text.rlike(fence), fenced).when(rest != "", rest).otherwise("{}")
    raise ValueError(f"unknown variant {variant!r}")


def is_transient_error(message: Column, status: Column | None = None) -> Column:
    """Worth a retry: by status code, or by what the message names.

    Status numbers, `timed out` and `socket hang up` in the message are our extension: ledgers often keep the message alone.
    """
    named = F.coalesce(message.rlike(r"(?i)\b(429|502|503|504)\b|timeout|timed out|ECONNRESET|ETIMEDOUT|socket hang up|rate limit"), F.lit(False))
    return named if status is None else named | F.coalesce(status.isin(429, 502, 503, 504), F.lit(False))


def outermost_handler(handler: Column) -> Column:
    """The handler's name, unwrapped from one asyncHandler() call."""
    inner = F.regexp_extract(handler, r"asyncHandler\(\s*(?:await\s+)?([\w$.]+)", 1)
    return F.coalesce(F.nullif(inner, F.lit("")), F.nullif(F.regexp_extract(handler, r"^([\w$.]+)", 1), F.lit("")))
