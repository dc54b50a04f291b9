"""Schemas of the index tables and logs."""

from __future__ import annotations

SYMBOL = (
    "id string, repo string, name string, kind string, file string, start_line int, end_line int, signature string, docstring string, source string, "
    "parent string, decorators array<string>, `extends` array<string>, `implements` array<string>, is_async boolean, is_exported boolean, meta map<string,string>"
)
FILE = ("path string, language string, symbol_count int, last_modified long, mtime_ms long, sha1 string, stale boolean")
IMPORT = ("file string, target string, type_only boolean, star_import boolean, line int")
USAGE = (
    "ts long, machine string, tool string, repo string, args_summary string, elapsed_ms double, result_tokens long, result_chunks long, session_id string, "
    "host string, error boolean, error_class string, cache_hit boolean, hints_emitted array<string>, recommended_tools array<string>"
)
RETRO_FIELDS = "date skill project code_type friction_category missing_template context_gap turns_wasted tool_calls files_read files_modified branch sha7 blind_audit adversarial tool_status routing_status".split()

#: Languages by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "php": "php", "rb": "ruby", "swift": "swift", "c": "c",
    "h": "c", "cpp": "cpp", "cs": "csharp", "md": "markdown", "mdx": "markdown", "sql": "sql", "prisma": "prisma", "astro": "astro", "json": "json", "yaml": "yaml",
    "yml": "yaml", "toml": "toml", "css": "css", "html": "html", "jsonl": "conversation", "sh": "bash", "vue": "vue", "svelte": "svelte",
}


def column_names(ddl: str) -> list[str]:
    """The columns' names of one of the schemas above."""
    return [part.split()[0].strip("`") for part in ddl.replace("map<string,string>", "map").split(",")]
