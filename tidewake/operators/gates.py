"""Which files may be indexed, and why not."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import FILE_BYTES

# Files that are never worth indexing.
DENYLIST = [
    ".DS_Store", ".env", ".env.*", "*.swp", "*.swo", "*.log", "*.local",
    "*.min.js", "*.min.css", "*.min.map", "*.bundle.js", "*.bundle.css", "*.chunk.js", "*.vendor.js", "*.polyfills.js", "*.runtime.js", "*.map",
    "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.webp", "*.bmp", "*.tiff", "*.tif", "*.heic", "*.avif",
    "*.pdf", "*.doc", "*.docx", "*.xls", "*.xlsx", "*.ppt", "*.pptx", "*.zip", "*.tar", "*.tgz", "*.gz", "*.bz2", "*.xz", "*.7z", "*.rar", "*.dmg", "*.iso",
    "*.exe", "*.dll", "*.so", "*.dylib", "*.o", "*.obj", "*.a", "*.lib", "*.class", "*.jar", "*.war", "*.ear", "*.wasm", "*.pyc", "*.pyo", "*.pyd",
    "*.ttf", "*.otf", "*.woff", "*.woff2", "*.eot",
    "*.mp3", "*.mp4", "*.mov", "*.avi", "*.mkv", "*.webm", "*.wav", "*.flac", "*.ogg",
    "*.sqlite", "*.sqlite3", "*.db", "*.bin",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "Gemfile.lock", "composer.lock", "poetry.lock", "go.sum",
]


def glob_regex(pattern: str) -> str:
    """A gitignore glob as a regular expression over a path or its last part."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + r"(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + r"/.*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + r".*", i + 2
        elif c == "*":
            out, i = out + r"[^/]*", i + 1
        elif c == "?":
            out, i = out + r"[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", r"\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


@lru_cache(maxsize=64)
def compiled(rules: tuple[tuple[str, str], ...]) -> list[tuple[re.Pattern[str], bool, bool, str, str]]:
    """(expression, negated, directories only, rule, source) of each rule (line, source)."""
    out = []
    for line, source in rules:
        p = line.rstrip() if not line.endswith("\\ ") else line
        if not p or p.startswith("#"):
            continue
        negated = p.startswith("!")
        p = p[1:] if negated else p[1:] if p.startswith(("\\#", "\\!")) else p
        only_dirs = p.endswith("/")
        p = p.rstrip("/")
        anchored = "/" in p
        expression = glob_regex(p.lstrip("/"))
        out.append((re.compile(expression if anchored else rf"(?:.*/)?{expression}", re.S), negated, only_dirs, line, source))
    return out


def excluding_rule(path: str, rules: tuple[tuple[str, str], ...]) -> tuple[str, str] | None:
    """(rule, source) that excludes a file. The last match wins; below an excluded directory nothing comes back."""
    parts = path.split("/")
    for depth in range(1, len(parts) + 1):
        at, is_dir, hit = "/".join(parts[:depth]), depth < len(parts), None
        for expression, negated, only_dirs, rule, source in compiled(rules):
            if (is_dir or not only_dirs) and expression.fullmatch(at):
                hit = None if negated else (rule, source)
        if hit:
            return hit
    return None


def rule_set(user: Sequence[tuple[str, str]] = (), builtin: bool = True) -> tuple[tuple[str, str], ...]:
    """The built-in rules first, so that any other can undo them."""
    return (*((p, "builtin") for p in DENYLIST if builtin), *user)


def ignored(path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct<pattern, source> of the rule that excludes the path; null if none does."""
    @F.pandas_udf("pattern string, source string")  # type: ignore[call-overload]
    def run(paths: pd.Series) -> pd.DataFrame:
        found = [excluding_rule(p, rules) or (None, None) for p in paths]
        return pd.DataFrame(found, columns=["pattern", "source"])

    return run(path)


def extension_regex(patterns: Sequence[str] = DENYLIST) -> str:
    """The denylist as one expression over a path, for use without Python."""
    return "(?:^|/)(?:" + "|".join(glob_regex(p) for p in patterns) + ")(?:/|$)"


def verdict(path: Column, size: Column, valid_utf8: Column, *, regular: Column | None = None, outside: Column | None = None, excluded: Column | None = None, limit: int = FILE_BYTES) -> Column:
    """The first reason not to index a file; null if there is none. A limit of 0 or less lets any size pass."""
    false = F.lit(False)
    in_git = F.array_contains(F.split(path, "/"), ".git")
    return (
        F.when(in_git | F.coalesce(outside if outside is not None else false, false), "out_of_scope")
        .when(F.coalesce(excluded if excluded is not None else F.regexp_like(path, F.lit(extension_regex())), false), "ignored")
        .when(~F.coalesce(regular if regular is not None else F.lit(True), false), "not_regular")
        .when((size > limit) & F.lit(limit > 0), "oversize")
        .when(~valid_utf8, "non_utf8")
    )


def in_scope(files: DataFrame, barred: DataFrame) -> DataFrame:
    """Files that lie in or below none of the barred roots (nested worktrees, submodules)."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hit = files.select("path", F.explode(above).alias("root")).join(barred.select("root").distinct(), "root", "left_semi").select("path").distinct()
    return files.join(hit, "path", "left_anti")
