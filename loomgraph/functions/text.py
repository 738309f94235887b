"""Scalar functions as Column expressions: all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.schemas import ABSOLUTE_PATHS, MOST_PATH, ROLE_TOKENS, RULE_ID

#: Line comments, block comments, text blocks, strings and characters, each to its end or the text's; else a run of plain code, or one sign.
MASKED = r"""//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?|\"{3}(?:[^"]++|"(?!""))*+(?:\"{3})?|"(?:[^"\\]++|\\[\s\S]?)*+"?|'(?:[^'\\]++|\\[\s\S]?)*+'?|[^/"']++|/"""


def last_segment(x: Column, by: str = ".") -> Column:
    """What follows the last separator; all of it without one."""
    return F.substring_index(x, by, -1)


def name_tokens(x: Column) -> Column:
    """Lower-case tokens of a camelCase or separated name, without empty ones."""
    parts = F.split(F.lower(F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+")
    return F.filter(parts, lambda t: t != "")


def pipeline_role(tokens: Column) -> Column:
    """The first role with one of the tokens; null without."""
    out = None
    for role, words in ROLE_TOKENS.items():
        hit = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out


def portable_path(x: Column) -> Column:
    """Relative, short, without control characters, drives and parent segments."""
    bad = (x == "") | (F.char_length(x) > MOST_PATH) | x.rlike(r"[\x00-\x1F\x7F]") | x.rlike(r"^[/\\]") | x.rlike(r"^[A-Za-z]:[/\\]")
    up = F.array_contains(F.split(F.translate(x, "\\", "/"), "/"), "..")
    return F.coalesce(~(bad | up), F.lit(False))


def in_java(pattern: str) -> str:
    """A pattern whose word characters are letters and digits of all scripts, in the engine's own words for them."""
    return pattern.replace(r"\w", r"\p{L}\p{N}_")


def unsafe_text(x: Column) -> Column:
    """Holds a control, format or surrogate character, or what looks like an absolute path."""
    out = x.rlike(r"[\p{Cc}\p{Cf}\p{Cs}]")
    for p in ABSOLUTE_PATHS:
        out = out | x.rlike(in_java(p))
    return F.coalesce(out, F.lit(False))


def masked(x: Column) -> Column:
    """Code with its comments and the insides of its string, character and text-block literals, their marks included, as spaces; lengths and line breaks stay, so every place keeps its line and column. The
    pattern cuts the text from left to right into pieces that begin in code, as a transducer with the states code, line comment, block comment, text block, string and
    character would; what is not closed runs to the end, and a backslash takes the next character with it."""
    pieces = F.regexp_extract_all(x, F.lit(MASKED), F.lit(0))
    hidden = lambda p: p.startswith("//") | p.startswith("/*") | p.startswith('"') | p.startswith("'")
    return F.array_join(F.transform(pieces, lambda p: F.when(hidden(p), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)), "")


def api_path(x: Column, most: int = 1000) -> Column:
    """A relative path with forward slashes only, else null: safe text, no drive, and no empty or dotted part."""
    text = bounded_text(x, most)
    parts = F.filter(F.split(text, "/"), lambda p: (p != "") & (p != "."))  # a path's own normal form
    bad = text.contains("\\") | text.startswith("/") | text.rlike("^[A-Za-z]:") | text.isin(".", "..") | F.array_contains(parts, "..")
    return F.when(~bad, text)


def rule_id(x: Column) -> Column:
    return F.coalesce(x.rlike(f"^{RULE_ID}$") & ~x.contains("\n"), F.lit(False))


def clamp(x: Column, most: int) -> Column:
    """From 0 to most; null is 0."""
    return F.greatest(F.lit(0), F.least(F.coalesce(x, F.lit(0)), F.lit(most)))


def bounded_number(x: Column, most: float) -> Column:
    """From 0 to most with two decimals; null and what is not finite are 0."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.round(F.greatest(F.lit(0.0), F.least(x, F.lit(most))), 2)).otherwise(0.0)


def bounded_text(x: Column, most: int) -> Column:
    """Trimmed and cut; null if empty or unsafe."""
    clean = F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.when(~unsafe_text(x) & (clean != ""), F.substring(clean, 1, most))


def html_escape(x: Column) -> Column:
    """Characters that could end a script element, as escapes that JSON reads back."""
    out = x
    for c in "&<>":
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return out


def utc_text(x: Column) -> Column:
    """ISO-8601 of a UTC timestamp without zone, to the second."""
    return F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def version_parts(x: Column) -> Column:
    """[major, minor, patch] of a stable version, else null."""
    return F.when(x.rlike(r"^(0|[1-9][0-9]{0,8})\.(0|[1-9][0-9]{0,8})\.(0|[1-9][0-9]{0,8})$"), F.split(x, r"\.").cast("array<int>"))


def compatible_version(x: Column, least: str, current: str) -> Column:
    """Stable, not older than least and not newer than current."""
    v, low, high = version_parts(x), version_parts(F.lit(least)), version_parts(F.lit(current))
    return F.coalesce((v >= low) & (v <= high), F.lit(False))


def model_name(x: Column) -> Column:
    """A repository path and an optional tag, in plain characters, without dotted parts."""
    shape = x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]*(:[A-Za-z0-9][A-Za-z0-9._-]*)?$") & F.char_length(x).between(1, 200)
    odd = F.exists(F.split(F.substring_index(x, ":", 1), "/"), lambda p: p.isin("", ".", ".."))
    return F.coalesce(shape & ~odd, F.lit(False))


def model_digest(x: Column) -> Column:
    """sha256: and 64 hexadecimal digits, or null."""
    found = F.regexp_extract(x, "^(sha256:)?([0-9a-f]{64})$", 2)
    return F.when(found != "", F.concat(F.lit("sha256:"), found))


def flattened(metadata: Column, fields: dict[str, bool]) -> Column:
    """Keys and values of metadata as search text, keys in alphabetical order; fields: name -> whether it is a list (of which 20 count). Absent ones are left out."""
    parts = []
    for name, many in sorted(fields.items()):
        x = metadata.getField(name)
        value = F.when(F.size(x) > 0, F.array_join(F.slice(x, 1, 20), " ")) if many else x.cast("string")
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name} "), value)))
    return F.concat_ws(" ", *parts)


def percent_encode(x: Column) -> Column:
    """As RFC 3986 asks: everything but unreserved characters."""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def turtle_literal(x: Column) -> Column:
    out = x
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def predicate_name(x: Column) -> Column:
    """HAS_PIPELINE_ROLE -> HasPipelineRole."""
    return F.replace(F.initcap(F.replace(x, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a over the characters' code units (characters of the basic plane)."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), F.ascii)
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c.cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def ellipsis(x: Column, most: int) -> Column:
    return F.when(F.char_length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def line_of(x: Column, offset: Column) -> Column:
    """1-based line of a 1-based offset."""
    return F.regexp_count(F.substring(x, F.lit(1), offset - 1), F.lit("\n")) + 1


def search_text(*columns: Column) -> Column:
    """Lower-case haystack; missing fields leave their separating space."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))
