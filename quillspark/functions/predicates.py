"""Row predicates of the code index, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import glob_to_regex

#: Parts of a path that mark a test file, loosely.
TEST_PARTS = [".test.", ".spec.", "__tests__", "/test/", "/tests/", "test_", "_test.", "Test.", "Spec."]
#: Directories of vendored and generated files.
NOISE = r"(^|/)(node_modules|vendor|dist|build|\.next|coverage|generated|__generated__|target)/|\.min\.(js|css)$|\.lock$"
_GLOB = set("*?{}[]")


def is_test_file(path: Column) -> Column:
    out = F.lit(False)
    for part in TEST_PARTS:
        out = out | F.contains(path, F.lit(part))
    return out


def is_test_file_strict(path: Column) -> Column:
    """By patterns on whole path segments."""
    return path.rlike(r"(^|/)(tests?|__tests__|specs?|e2e|fixtures)/|(^|/)test_[^/]+\.py$|(^|/)[^/]+_test\.(go|py|rs)$|\.(test|spec)\.[jt]sx?$|(^|/)[^/]+(Test|Tests|Spec)\.(java|kt|php)$|(^|/)conftest\.py$")


def is_noise(path: Column) -> Column:
    return path.rlike(NOISE)


def matches_path(path: Column, pattern: str) -> Column:
    """Equal; without glob characters a part of the path; a glob without ``/`` matches base names, else whole paths."""
    if not _GLOB & set(pattern):
        return (path == pattern) | F.contains(path, F.lit(pattern))
    regex = glob_to_regex(pattern)
    return (path == pattern) | (path if "/" in pattern else F.element_at(F.split(path, "/"), -1)).rlike(regex)


def matches_name(path: Column, pattern: str) -> Column:
    """A pattern with ``/`` matches whole paths; else the base name, by equality, part or glob."""
    base = F.element_at(F.split(path, "/"), -1)
    if "/" in pattern:
        return path.rlike(glob_to_regex(pattern))
    if not _GLOB & set(pattern):
        return (base == pattern) | F.contains(path, F.lit(pattern))
    return base.rlike(glob_to_regex(pattern))


def has_decorator(decorators: Column, name: str) -> Column:
    """A decorator of that name, with or without ``@`` and arguments."""
    bare = name.lstrip("@")
    return F.exists(decorators, lambda d: (F.regexp_replace(d, "^@", "") == bare) | F.regexp_replace(d, "^@", "").startswith(bare + "("))


def word_in(text: Column, word: str) -> Column:
    """An identifier as a whole word, by ASCII classes."""
    import re

    return text.rlike(f"(^|[^A-Za-z0-9_]){re.escape(word)}([^A-Za-z0-9_]|$)")
