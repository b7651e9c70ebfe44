"""Languages, extensions and skipped paths: built in, or from YAML."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: extensions by language, skipped folders and files. ----
LANGUAGES = {
    "go": [".go"],
    "rust": [".rs"],
    "python": [".py"],
    "javascript": [".js"],
    "typescript": [".ts"],
    "java": [".java"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp"],
    "ruby": [".rb"],
    "php": [".php"],
    "swift": [".swift"],
    "kotlin": [".kt"],
    "scala": [".scala"],
    "shell": [".sh", ".bash"],
    "sql": [".sql"],
    "markdown": [".md"],
    "yaml": [".yaml", ".yml"],
    "toml": [".toml"],
    "json": [".json"],
}
SKIP_DIRS = [".git", "vendor", "node_modules", ".venv", "__pycache__", "target", "bin", "build"]
SKIP_FILES = ["*_test.go"]
#: Bytes at a file's start in which a NUL marks it as binary.
SNIFF = 8000


def glob_pattern(glob: str) -> str | None:
    """A glob of one path part as a regular expression; None if it is malformed. [^x] negates, a backslash escapes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(glob):
                return None
            out += re.escape(glob[i])
        elif c == "[":
            m = re.match(r"\[(\^?)((?:\\.|[^\]\\])+)\]", glob[i:])
            if not m:
                return None
            inner = re.sub(r"\\(.)", lambda x: "\\" + x[1], m[2]).replace("[", "\\[").replace("&&", "&\\&").replace("^", "\\^")
            out += f"[{m[1]}{inner}]"
            i += len(m[0]) - 1
        else:
            out += re.escape(c)
        i += 1
    return out


@dataclass(frozen=True)
class Config:
    languages: dict[str, list[str]] = field(default_factory=lambda: LANGUAGES)
    skip_dirs: list[str] = field(default_factory=lambda: SKIP_DIRS)
    skip_files: list[str] = field(default_factory=lambda: SKIP_FILES)

    def extensions(self) -> dict[str, str]:
        """Language of each extension; of two languages that share one, the first by name."""
        return {e: lang for lang in sorted(self.languages, reverse=True) for e in self.languages[lang]}

    def language(self, path: Column) -> Column:
        """The language of a path's last extension in any case, else 'unknown'; null for null."""
        table = F.create_map(*[F.lit(x) for pair in self.extensions().items() for x in pair])
        return F.when(path.isNotNull(), F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))), F.lit("unknown")))

    def skipped(self, path: Column) -> Column:
        """Why a relative path is not indexed: its folder, its name, its language; null if it is."""
        parts = F.split(path, "/")
        folders, base = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
        globs = [p for p in map(glob_pattern, self.skip_files) if p]
        matched = F.lit(False)
        for p in globs:
            matched = matched | F.regexp_like(base, F.lit(f"^{p}$"))
        return (
            F.when(path.isNull(), "no path")
            .when(F.exists(folders, lambda d: F.startswith(d, F.lit(".")) | d.isin(self.skip_dirs)), "folder")
            .when(F.startswith(base, F.lit(".")), "hidden")
            .when(self.language(path) == "unknown", "extension")
            .when(matched, "pattern")
        )


def binary(content: Column) -> Column:
    """Whether bytes are taken for binary: empty, or a NUL among the first ones."""
    return (F.octet_length(content) == 0) | F.contains(F.substring(content, 1, SNIFF), F.unhex(F.lit("00")))


def load(path: str | Path | None = None) -> Config:
    """The configuration of a YAML file, or the built-in one without a file.

    languages, skip_dirs and skip_file_patterns; leaving the last out keeps the built-in patterns, an empty list turns them off.
    """
    if path is None:
        path = Path("config.yaml")
        if not path.exists():
            return Config()
    import yaml

    given = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    files = given.get("skip_file_patterns")
    return Config(given.get("languages") or {}, given.get("skip_dirs") or [], SKIP_FILES if files is None else files)
