"""File path rules as column expressions. Paths are relative to their repository and use '/'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolore import constants as C
from repolore.functions.text import approx_tokens, is_blank


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def clean_dir(pattern: Column) -> Column:
    """Strip every leading/trailing '.' and '/', so './.venv/' gives 'venv'."""
    return F.regexp_replace(pattern, r"^[./]+|[./]+$", "")


def clean_dirs(patterns: Column) -> Column:
    return F.transform(patterns, clean_dir)


def union_lists(*lists: Column) -> Column:
    """Distinct union of string arrays; a null list counts as empty."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(x, strings([])) for x in lists])))


def is_excluded(path: Column, dirs: Column, files: Column) -> Column:
    """A path component equals a cleaned directory, or the file name equals a pattern (globs are literals)."""
    return F.arrays_overlap(F.split(path, "/"), clean_dirs(dirs)) | F.array_contains(files, name(path))


def is_included(path: Column, dirs: Column, files: Column) -> Column:
    """A path component is in ``dirs`` or the name ends with one of ``files``."""
    return F.arrays_overlap(F.split(path, "/"), clean_dirs(dirs)) | F.exists(
        files, lambda f: F.endswith(name(path), f)
    )


def keep_path(path: Column, excl_dirs: Column, excl_files: Column, incl_dirs: Column, incl_files: Column) -> Column:
    """Inclusion rules when any are given; otherwise exclusion rules."""
    including = (F.size(incl_dirs) > 0) | (F.size(incl_files) > 0)
    return F.when(including, is_included(path, incl_dirs, incl_files)).otherwise(
        ~is_excluded(path, excl_dirs, excl_files)
    )


def extension(path: Column) -> Column:
    return F.regexp_extract(name(path), r"\.([^.]+)$", 1)


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def is_code(path: Column) -> Column:
    return extension(path).isin(C.CODE_EXTENSIONS)


def is_known_type(path: Column) -> Column:
    return extension(path).isin(C.CODE_EXTENSIONS + C.DOC_EXTENSIONS)


def is_implementation(path: Column) -> Column:
    return (
        is_code(path)
        & ~F.startswith(path, F.lit("test_"))
        & ~F.startswith(path, F.lit("app_"))
        & ~F.lower(path).contains("test")
    )


def token_cap(code: Column) -> Column:
    return F.when(code, F.lit(C.EMBED_TOKEN_LIMIT * C.CODE_TOKEN_FACTOR)).otherwise(F.lit(C.EMBED_TOKEN_LIMIT))


def is_listed(path: Column) -> Column:
    """Whether the tree listing shows the file."""
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    pruned = F.exists(dirs, lambda d: F.startswith(d, F.lit(".")) | d.isin(C.LISTING_PRUNED_DIRS))
    return ~(pruned | F.startswith(name(path), F.lit(".")) | name(path).isin(C.LISTING_SKIPPED_FILES))


def _unquote(x: Column) -> Column:
    """Resolve percent escapes; '+' and a '%' that starts no escape stay."""
    kept = F.replace(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(kept), x)


def decode_list(field: Column) -> Column:
    """Newline separated request field to values: blanks dropped, percent escapes resolved."""
    return F.transform(F.filter(F.split(field, "\n"), lambda x: ~is_blank(x)), _unquote)
