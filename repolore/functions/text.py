"""Text expressions (all JVM side)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolore import constants as C

# White space as Python's str.split/str.strip see it.
SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row: a column that is named several times may be worked out each time,
    and steps on steps then multiply."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | ~c.rlike(rf"[^{SPACE}]")


def estimate_tokens(c: Column) -> Column:
    """Number of white-space separated tokens."""
    return F.size(F.filter(F.split(c, rf"[{SPACE}]+"), lambda x: x != "")).cast("bigint")


def approx_tokens(c: Column) -> Column:
    """Four characters per token."""
    return F.floor(F.length(c) / 4).cast("bigint")


def chunk_count(n_words: Column, size: int = C.CHUNK_WORDS, overlap: int = C.CHUNK_OVERLAP) -> Column:
    step = size - overlap
    return (F.greatest(F.ceil((n_words - size) / F.lit(step)), F.lit(0)) + 1).cast("int")


def contains_any(c: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def strip_fences(c: Column, languages: list[str]) -> Column:
    """Drop an opening code fence (optionally tagged with one of ``languages``) and a closing one."""
    tags = "|".join(languages)
    opened = F.regexp_replace(c, rf"(?i)^```(?:{tags})[{SPACE}]*", "")
    return F.regexp_replace(opened, rf"```[{SPACE}]*\z", "")


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """``regexp_extract`` with null, not '', for no match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def drop_control_chars(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def slug(c: Column) -> Column:
    """Heading link: lower case, only ASCII word characters, blanks and hyphens kept, blank runs to one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), rf"[^0-9A-Za-z_{SPACE}-]", ""), rf"[{SPACE}]+", "-")


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` marks. ``{{name}}`` stays as a literal ``{name}``."""
    guarded = F.replace(F.replace(template, F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002"))
    for name, value in values.items():
        guarded = F.replace(guarded, F.lit("{" + name + "}"), value.cast("string"))
    return F.replace(F.replace(guarded, F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))
