"""Symbols and imports of source text.

``extract(files)`` dispatches by language in one Arrow pass: Python by its own grammar, Markdown, SQL, Prisma
and conversations by their line structure, other languages by declaration patterns at line starts. A Python file with
a syntax error is read statement by statement, and what doesn't parse by its declarations. Line-level extraction is less complete than a full grammar: nested declarations
of brace languages are found, anonymous ones are not.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schemas import IMPORT, SYMBOL, column_names

Found = dict

#: Files (and their bytes) that a worker takes at a time, symbols (and characters of source) that it hands on at a time.
TAKEN, TAKEN_BYTES, HANDED_ON, HANDED_ON_CHARS = 200, 16 << 20, 2000, 4 << 20


def _symbol(name: str, kind: str, start: int, end: int, lines: list[str], **more) -> Found:
    return {"name": name, "kind": kind, "start_line": start, "end_line": end, "source": "\n".join(lines[start - 1 : end]), **more}


_UNREADABLE = (SyntaxError, ValueError, RecursionError, MemoryError)
_PY_HEAD = re.compile(r"\s*(?P<a>async\s+)?(?P<k>def|class)\s+(?P<n>[^\W\d]\w*)")


def _blocks(lines: list[str], first: int, last: int) -> Iterator[tuple[int, int]]:
    """First and last line of each statement among the lines, by the indentation of the first one; decorators belong to what follows."""
    indent = lambda line: len(line) - len(line.lstrip())
    full = [i for i in range(first, last + 1) if lines[i - 1].strip() and lines[i - 1].lstrip()[0] != "#"]
    if not full:
        return
    level = indent(lines[full[0] - 1])
    starts = [i for i in full if indent(lines[i - 1]) <= level and lines[i - 1].lstrip()[0] not in ")]}"]
    starts = [i for k, i in enumerate(starts) if not k or not lines[starts[k - 1] - 1].lstrip().startswith("@")]
    for i, after in zip(starts, [*starts[1:], last + 1]):
        yield i, full[bisect_left(full, after) - 1]


def _python_by_blocks(lines: list[str], first: int, last: int, parent: str | None, out: list[Found]) -> None:
    """Symbols of lines that don't parse as a whole: each statement by the grammar, or else by its declaration's line."""
    blocks = list(_blocks(lines, first, last))
    declared = [i for i, (start, _) in enumerate(blocks) if lines[start - 1].lstrip().startswith("@") or _PY_HEAD.match(lines[start - 1])]
    read = tried = 0
    for i, (start, end) in enumerate(blocks):
        if start <= read:
            continue
        # a string or bracket may hold lines that look like statements: up to the next declaration all may be one
        nearest = bisect_right(declared, i)
        wide = blocks[(declared[nearest] if nearest < len(declared) else len(blocks)) - 1][1]
        for until in [end, wide] if end < wide != tried else [end]:
            tried = max(tried, until if until == wide else 0)
            block = lines[start - 1 : until]
            margin = len(block[0]) - len(block[0].lstrip())
            try:
                _python_by_grammar("\n".join(x[margin:] if not x[:margin].strip() else x for x in block), lines, parent, out, start - 1)
                read = until
                break
            except _UNREADABLE:
                pass
        if start <= read:
            continue
        head = next((k for k in range(start, end + 1) if not lines[k - 1].lstrip().startswith("@")), end)
        if not (m := _PY_HEAD.match(lines[head - 1])):
            continue
        is_class = m["k"] == "class"
        kind = "class" if is_class else "method" if parent else "test_case" if m["n"].startswith("test_") else "function"
        out.append(_symbol(
            m["n"], kind, start, end, lines, signature=lines[head - 1].strip().rstrip(":"), parent=parent, decorators=[x.strip()[1:] for x in lines[start - 1 : head - 1]],
            is_async=bool(m["a"]), is_exported=not m["n"].startswith("_"),
        ))
        if is_class:
            _python_by_blocks(lines, head + 1, end, m["n"], out)


def python(text: str) -> list[Found]:
    """Functions, classes, methods and constants of a module; of one with a syntax error, all that its statements and declarations tell."""
    lines, out = text.split("\n"), []
    try:
        _python_by_grammar(text, lines, None, out)
    except _UNREADABLE:
        _python_by_blocks(lines, 1, len(lines), None, out)
    return out


def _python_by_grammar(text: str, lines: list[str], parent: str | None, out: list[Found], before: int = 0) -> None:
    """Symbols of a text that parses, with their sources from ``lines``, of which ``before`` precede it; nothing is added if it doesn't."""
    tree, found = ast.parse(text), []
    if before:
        ast.increment_lineno(tree, before)

    def walk(body: list[ast.stmt], parent: str | None) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(node, ast.ClassDef)
                start = min([node.lineno, *[d.lineno for d in node.decorator_list]])
                kind = "class" if is_class else "method" if parent else "test_case" if node.name.startswith("test_") else "function"
                head = f"class {node.name}" if is_class else f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)})"
                found.append(_symbol(
                    node.name, kind, start, node.end_lineno or node.lineno, lines, signature=head, docstring=ast.get_docstring(node), parent=parent,
                    decorators=[ast.unparse(d) for d in node.decorator_list], extends=[ast.unparse(b) for b in node.bases] if is_class else None,
                    is_async=isinstance(node, ast.AsyncFunctionDef), is_exported=not node.name.startswith("_"),
                ))
                if is_class:
                    walk(node.body, node.name)
            elif isinstance(node, ast.Assign) and not parent:
                for t in node.targets:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        found.append(_symbol(t.id, "constant", node.lineno, node.end_lineno or node.lineno, lines, is_exported=True))

    walk(tree.body, parent)
    out += found


def markdown(text: str) -> list[Found]:
    """Sections by headings outside fences; a section reaches to the next heading of its level or above."""
    lines, heads, fenced = text.split("\n"), [], False
    for i, line in enumerate(lines, 1):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced and (m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)):
            heads.append((i, len(m[1]), m[2]))
    out = []
    for k, (line, level, name) in enumerate(heads):
        end = next((h[0] - 1 for h in heads[k + 1 :] if h[1] <= level), len(lines))
        parent = next((h[2] for h in reversed(heads[:k]) if h[1] < level), None)
        out.append(_symbol(name, "section", line, end, lines, parent=parent, meta={"level": str(level)}))
    return out


_DDL = re.compile(r"\bcreate\s+(?:or\s+replace\s+)?(?:unique\s+|temporary\s+|temp\s+|materialized\s+)*(table|view|index|trigger|procedure|function)\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)", re.I)


def _balanced(text: str, at: int) -> int:
    """The place behind the bracket that closes the one at ``at``, or the text's end."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i + 1
    return len(text)


def _top_level(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def sql(text: str) -> list[Found]:
    """DDL statements, and the columns of tables as fields. Template marks are blanked first."""
    text = re.sub(r"\{[{%#].*?[}%#]\}", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    lines, out = text.split("\n"), []
    for m in _DDL.finditer(text):
        name, kind = m[2].strip('"`[]'), m[1].lower()
        start = text.count("\n", 0, m.start()) + 1
        opened = text.find("(", m.end())
        end_at = text.find(";", m.end())
        if kind == "table" and opened >= 0 and (end_at < 0 or opened < end_at):
            closed = _balanced(text, opened)
            end_at = text.find(";", closed - 1)
            columns = _top_level(text[opened + 1 : closed - 1])
        else:
            columns = []
        end_at = len(text) if end_at < 0 else end_at
        out.append(_symbol(name, kind, start, text.count("\n", 0, end_at) + 1, lines))
        for c in columns:
            words = c.split()
            if words[0].upper() not in {"PRIMARY", "FOREIGN", "UNIQUE", "CONSTRAINT", "CHECK", "KEY", "INDEX"}:
                at = start + text[m.start() : text.find(c, opened)].count("\n")
                out.append(_symbol(words[0].strip('"`[]'), "field", at, at, lines, parent=name, signature=" ".join(words[1:2]), meta={"type": words[1] if len(words) > 1 else ""}))
    return out


def prisma(text: str) -> list[Found]:
    """Models and enums, and the models' fields."""
    lines, out, model = text.split("\n"), [], None
    for i, line in enumerate(lines, 1):
        if m := re.match(r"\s*(model|enum)\s+(\w+)\s*\{", line):
            end = next((k for k in range(i, len(lines) + 1) if lines[k - 1].strip() == "}"), len(lines))
            model = m[2] if m[1] == "model" else None
            out.append(_symbol(m[2], "class" if m[1] == "model" else "enum", i, end, lines))
        elif line.strip() == "}":
            model = None
        elif model and (m := re.match(r"\s*(\w+)\s+(\w+(?:\[\])?\??)", line)):
            out.append(_symbol(m[1], "field", i, i, lines, parent=model, signature=m[2], meta={"type": m[2]}))
    return out


def _braces_end(lines: list[str], start: int) -> int:
    depth, opened = 0, False
    for i in range(start - 1, len(lines)):
        bare = re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|//.*', "", lines[i])
        depth += bare.count("{") - bare.count("}")
        opened = opened or "{" in bare
        if opened and depth <= 0 or not opened and bare.rstrip().endswith(";"):
            return i + 1
    return start if not opened else len(lines)


#: Declarations at line starts, by language: (kind, pattern with the name in group ``n``).
DECLARATIONS = {
    "typescript": [
        ("class", r"^\s*(?P<x>export\s+)?(default\s+)?(abstract\s+)?class\s+(?P<n>\w+)(?:\s+extends\s+(?P<e>[\w.]+))?(?:<[^>]*>)?(?:\s+implements\s+(?P<i>[\w., ]+))?"),
        ("interface", r"^\s*(?P<x>export\s+)?interface\s+(?P<n>\w+)(?:\s+extends\s+(?P<e>[\w., ]+))?"),
        ("type", r"^\s*(?P<x>export\s+)?type\s+(?P<n>\w+)\s*(?:<[^>]*>)?\s*="), ("enum", r"^\s*(?P<x>export\s+)?(const\s+)?enum\s+(?P<n>\w+)"),
        ("function", r"^\s*(?P<x>export\s+)?(default\s+)?(?P<a>async\s+)?function\s*\*?\s*(?P<n>\w+)"),
        ("function", r"^\s*(?P<x>export\s+)?const\s+(?P<n>\w+)\s*(?::[^=]+)?=\s*(?P<a>async\s+)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
        ("test_suite", r"^\s*describe\s*\(\s*['\"`](?P<n>[^'\"`]+)"), ("test_case", r"^\s*(?:it|test)\s*\(\s*['\"`](?P<n>[^'\"`]+)"),
        ("constant", r"^(?P<x>export\s+)?const\s+(?P<n>[A-Z][A-Z0-9_]+)\s*[:=]"),
        ("method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|readonly\s+)*(?P<a>async\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?P<n>[a-zA-Z_]\w*)\s*\([^)]*\)\s*(?::\s*[^{]+)?\{\s*$"),
    ],
    "go": [("method", r"^func\s+\([^)]*\)\s*(?P<n>\w+)"), ("function", r"^func\s+(?P<n>\w+)"), ("class", r"^type\s+(?P<n>\w+)\s+struct"), ("interface", r"^type\s+(?P<n>\w+)\s+interface"), ("constant", r"^const\s+(?P<n>\w+)")],
    "rust": [("function", r"^\s*(?P<x>pub(?:\([^)]*\))?\s+)?(?P<a>async\s+)?(?:unsafe\s+)?fn\s+(?P<n>\w+)"), ("class", r"^\s*(?P<x>pub\s+)?struct\s+(?P<n>\w+)"), ("enum", r"^\s*(?P<x>pub\s+)?enum\s+(?P<n>\w+)"), ("interface", r"^\s*(?P<x>pub\s+)?trait\s+(?P<n>\w+)")],
    "kotlin": [("class", r"^\s*(?:data\s+|sealed\s+|abstract\s+|open\s+)*(?:class|object)\s+(?P<n>\w+)(?:\([^)]*\))?(?:\s*:\s*(?P<e>[\w., ()]+))?"), ("interface", r"^\s*(?:fun\s+)?interface\s+(?P<n>\w+)"), ("function", r"^\s*(?:(?:private|internal|override|inline)\s+)*(?P<a>suspend\s+)?fun\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?(?P<n>\w+)")],
    "php": [("class", r"^\s*(?:final\s+|abstract\s+)*class\s+(?P<n>\w+)(?:\s+extends\s+(?P<e>[\w\\]+))?(?:\s+implements\s+(?P<i>[\w\\, ]+))?"), ("interface", r"^\s*interface\s+(?P<n>\w+)"), ("method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+)+function\s+(?P<n>\w+)"), ("function", r"^function\s+(?P<n>\w+)")],
    "java": [("class", r"^\s*(?:public\s+|final\s+|abstract\s+)*class\s+(?P<n>\w+)(?:\s+extends\s+(?P<e>\w+))?"), ("interface", r"^\s*(?:public\s+)?interface\s+(?P<n>\w+)")],
}
DECLARATIONS["javascript"] = DECLARATIONS["astro"] = DECLARATIONS["typescript"]
_COMPILED = {lang: [(kind, re.compile(p)) for kind, p in rules] for lang, rules in DECLARATIONS.items()}


def braces(lang: str) -> Callable[[str], list[Found]]:
    """An extractor for a language with braces."""

    def run(text: str) -> list[Found]:
        lines, out = text.split("\n"), []
        for i, line in enumerate(lines, 1):
            for kind, pattern in _COMPILED[lang]:
                if m := pattern.match(line):
                    g = m.groupdict()
                    names = lambda k: [x.strip() for x in g[k].split(",")] if g.get(k) else None  # noqa: B023, E731
                    end = _braces_end(lines, i)
                    parent = next((s["name"] for s in reversed(out) if s["kind"] in {"class", "interface", "test_suite"} and s["start_line"] < i <= s["end_line"]), None)
                    out.append(_symbol(g["n"], kind, i, end, lines, signature=line.strip().rstrip("{").strip(), parent=parent, extends=names("e"), implements=names("i"), is_async=bool(g.get("a")), is_exported=bool(g.get("x"))))
                    break
        return out

    return run


EXTRACTORS: dict[str, Callable[[str], list[Found]]] = {"python": python, "markdown": markdown, "sql": sql, "prisma": prisma, **{lang: braces(lang) for lang in DECLARATIONS}}
_IMPORTS = {
    "python": [re.compile(r"^\s*from\s+(?P<t>[\w.]+)\s+import\s+(?P<s>\*)?"), re.compile(r"^\s*import\s+(?P<t>[\w.]+)")],
    "typescript": [re.compile(r"^\s*(?:import|export)\s+(?P<y>type\s+)?(?P<s>\*)?[^'\"]*from\s+['\"](?P<t>[^'\"]+)"), re.compile(r"^\s*import\s+['\"](?P<t>[^'\"]+)"), re.compile(r".*\brequire\(\s*['\"](?P<t>[^'\"]+)"), re.compile(r".*\bimport\(\s*['\"](?P<t>[^'\"]+)")],
    "php": [re.compile(r"^\s*use\s+(?P<t>[\w\\]+)")],
    "kotlin": [re.compile(r"^\s*import\s+(?P<t>[\w.]+?)(?P<s>\.\*)?\s*$")],
    "go": [re.compile(r"^\s*(?:import\s+)?(?:\w+\s+)?\"(?P<t>[\w./-]+)\"\s*$")],
    "rust": [re.compile(r"^\s*(?:pub\s+)?use\s+(?P<t>[\w:]+)(?P<s>::\*)?")],
}
_IMPORTS["javascript"] = _IMPORTS["astro"] = _IMPORTS["typescript"]


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows).reindex(columns=names).astype(object).where(lambda d: d.notna(), None) if rows else pd.DataFrame(columns=names)


def _symbols(batches: Iterator[pd.DataFrame], repo: str) -> Iterator[pd.DataFrame]:
    names = column_names(SYMBOL)
    rows, held = [], 0
    for pdf in batches:
        for path, lang, text in pdf[["path", "language", "text"]].itertuples(index=False):
            if lang not in EXTRACTORS or text is None:
                continue
            try:
                found = EXTRACTORS[lang](text)
            except _UNREADABLE:
                continue
            for s in found:
                key = hashlib.sha1(f"{path}:{s['name']}:{s['start_line']}".encode()).hexdigest()[:12]
                rows.append({"id": f"{path}:{s['name']}:{key}", "repo": repo, "file": path, **s})
                held += len(s["source"])
                if len(rows) >= HANDED_ON or held >= HANDED_ON_CHARS:
                    yield _frame(rows, names)
                    rows, held = [], 0
    yield _frame(rows, names)


def _short_batches(spark: SparkSession) -> None:
    """Let the session hand at most so many files at a time to Python; the setting stays, no result depends on it."""
    for name, most, default in (("spark.sql.execution.arrow.maxRecordsPerBatch", TAKEN, 10_000), ("spark.sql.execution.arrow.maxBytesPerBatch", TAKEN_BYTES, 2**31 - 1)):
        if not 0 < int(str(spark.conf.get(name, str(default))).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def extract(files: DataFrame, repo: str = "local") -> DataFrame:
    """Symbols of ``files (path, language, text)``. A worker holds some files and some symbols at a time, however many there are."""
    _short_batches(files.sparkSession)
    return files.select("path", "language", "text").mapInPandas(lambda b: _symbols(b, repo), SYMBOL)


def _imports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, lang, text in pdf[["path", "language", "text"]].itertuples(index=False):
            for i, line in enumerate((text or "").split("\n"), 1):
                for p in _IMPORTS.get(lang, []):
                    if m := p.match(line):
                        g = m.groupdict()
                        rows.append((path, m["t"], bool(g.get("y")), bool(g.get("s")), i))
                        break
        yield pd.DataFrame(rows, columns=column_names(IMPORT))


def imports(files: DataFrame) -> DataFrame:
    """Import statements of ``files (path, language, text)``: file, target as written, type_only, star_import, line."""
    return files.select("path", "language", "text").mapInPandas(_imports, IMPORT)
