"""Scalar text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


#: Camel-case borders: before a capital after a small letter or digit, and before the last capital of a run.
_BORDER = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def tokenize(col: Column) -> Column:
    """Lower-case identifier tokens of two characters or more: split at non-alphanumerics and at camel-case borders."""
    spaced = F.regexp_replace(text_or_empty(col), _BORDER, " ")
    low = F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit("[a-z0-9]{2,}"), F.lit(0))


def query_tokens(query: str) -> list[str]:
    """The tokens of a query, with repeats, by the same rules."""
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query))
    return [t.lower() for t in re.split(r"[^a-zA-Z0-9]+", spaced) if len(t) >= 2]


def strip_comments(source: Column, prefix: int = 500) -> tuple[Column, Column]:
    """``(body, comments)`` of the first ``prefix`` characters: code without, and text of, ``//`` and ``/* */`` comments."""
    head = F.substring(text_or_empty(source), 1, prefix)
    pattern = r"(?s)/\*.*?\*/|//[^\n]*"
    return F.regexp_replace(head, pattern, " "), F.array_join(F.regexp_extract_all(head, F.lit(pattern), F.lit(0)), " ")


def fnv1a32(col: Column) -> Column:
    """32-bit FNV-1a over code points (equal to the byte hash for ASCII)."""
    codes = F.transform(F.filter(F.split(text_or_empty(col), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * 16777619, F.lit(4294967296)))


def djb2(col: Column) -> Column:
    """``h = h * 33 + c`` modulo 2^32, from 5381."""
    codes = F.transform(F.filter(F.split(text_or_empty(col), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: F.pmod(h * 33 + c, F.lit(4294967296)))


def token_estimate(col: Column, chars_per_token: float = 4) -> Column:
    return F.ceil(F.length(text_or_empty(col)) / F.lit(chars_per_token)).cast("long")


def lines(col: Column) -> Column:
    return F.split(text_or_empty(col), "\n")


def normalised_lines(col: Column) -> Column:
    """Lines cut at the first ``//``, trimmed, with single spaces; blank lines and lone closers dropped."""
    tidy = F.transform(lines(col), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "//.*$", ""), r"\s+", " ")))
    return F.filter(tidy, lambda x: ~x.isin("", "{", "}", ");"))


def shape(col: Column) -> Column:
    """A text's shape: words become ``_``, numbers ``N``, runs of white space one space."""
    words = F.regexp_replace(text_or_empty(col), r"[A-Za-zÀ-ɏ]+", "_")
    return F.trim(F.regexp_replace(F.regexp_replace(words, "[0-9]+", "N"), "[ \t\n]+", " "))


def chunk_starts(col: Column, step: int = 1280) -> Column:
    return F.when(F.length(col) > 0, F.sequence(F.lit(0), F.length(col) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def glob_to_regex(glob: str) -> str:
    """A glob as an anchored Java pattern: ``**/`` any directories, ``**`` anything, ``*`` and ``?`` within a segment, ``{a,b}``."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def dialect(sql: Column) -> Column:
    """The dialect that the first matching cue names."""
    low = F.lower(text_or_empty(sql))
    cues = [
        ("mysql", r"engine\s*=\s*innodb|auto_increment|`"),
        ("postgres", r"\bserial\b|\bbigserial\b|\bjsonb\b|\btimestamptz\b|::[a-z]|\$\$"),
        ("sqlite", r"\bautoincrement\b|\bpragma\b|without\s+rowid"),
        ("mssql", r"\bidentity\s*\(|\bnvarchar\b|\bgo\s*$|\[dbo\]"),
    ]
    out = F.lit("unknown")
    for name, cue in reversed(cues):
        out = F.when(low.rlike(cue), name).otherwise(out)
    return out


#: First words (letters) of SQL types by family.
SQL_TYPES = {
    "int": ["int", "integer", "smallint", "bigint", "serial", "bigserial", "smallserial", "tinyint", "mediumint"],
    "float": ["float", "real", "double", "decimal", "numeric", "money"],
    "string": ["text", "varchar", "char", "string", "nvarchar", "longtext", "mediumtext", "tinytext"],
    "bool": ["bool", "boolean", "bit"],
    "datetime": ["timestamp", "timestamptz", "datetime", "date", "time", "timetz"],
    "json": ["json", "jsonb"],
    "uuid": ["uuid"],
    "bytes": ["bytea", "blob", "binary", "longblob", "mediumblob", "tinyblob"],
}


def sql_type(declared: Column) -> Column:
    """The family of a declared type, by its first run of letters; that word itself if it has none, ``unknown`` without letters."""
    word = F.lower(F.regexp_extract(text_or_empty(declared), "[a-zA-Z]+", 0))
    out = F.when(word == "", "unknown").otherwise(word)
    for family, words in SQL_TYPES.items():
        out = F.when(word.isin(words), family).otherwise(out)
    return out
