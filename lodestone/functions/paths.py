"""Path columns: languages, what is skipped, tests and legacy code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by extension.
LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".go": "go", ".md": "markdown", ".mdx": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".rs": "rust", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".h": "cpp", ".java": "java", ".rb": "ruby"}
CODE_LANGUAGES = ("typescript", "javascript", "python", "go")
#: Directories, extensions and names that are never read.
SKIP_ANYWHERE = (".git", "testdata", "fixtures", "node_modules", "vendor", "dist", "build", ".next", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", "coverage", ".coverage", "target", "out", ".idea", ".vscode")
SKIP_AT_TOP = ("audit", ".audit")
SKIP_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".mp4", ".mp3", ".zip", ".tar", ".gz", ".lock", ".sum", ".pdf", ".bin", ".exe", ".dll", ".so", ".dylib", ".map", ".pem", ".key", ".crt", ".cer", ".p12", ".pfx", ".kdbx", ".gpg", ".asc")
SECRET_NAMES = ("id_rsa", "id_dsa", "id_ed25519", "id_ecdsa", "kubeconfig", "htpasswd")
SECRET_PREFIXES = ("secrets.", "secrets-", "credentials.", "credentials-", "service-account.", "service_account.")
SECRET_EXTENSIONS = (".json", ".yaml", ".yml", ".toml", ".env", ".ini")
TEST_DIRS = ("__tests__", "tests", "test", "fixtures", "mocks", "testdata")
TEST_SUFFIXES = ("_test.go", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx")
LEGACY_TOKENS = ("compat", "legacy", "deprecated", "polyfill", "polyfills", "shims")
ROOT_DOCS = ("readme", "architecture", "contributing", "changelog")
#: Limits of a file that is read: bytes and lines.
MOST_BYTES, MOST_LINES = 524_288, 5_000


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base(path), r"\.[^.]*$", 0))


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def language(path: Column) -> Column:
    """Language by extension; null if none, or of minified code."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(~F.lower(path).rlike(r"\.min\.(js|css)$"), F.try_element_at(table, extension(path)))


def is_secret(path: Column) -> Column:
    b = F.lower(base(path))
    return b.isin(*SECRET_NAMES) | (_any(b.startswith(p) for p in SECRET_PREFIXES) & _any(b.endswith(e) for e in SECRET_EXTENSIONS))


def skipped(path: Column) -> Column:
    """The file, or a directory above it, is never read."""
    b = base(path)
    hidden = b.startswith(".") & ~F.lower(b).endswith(".md")
    folder = F.exists(directories(path), lambda d: d.isin(*SKIP_ANYWHERE)) | (F.contains(path, F.lit("/")) & F.substring_index(path, "/", 1).isin(*SKIP_AT_TOP))
    return folder | extension(path).isin(*SKIP_EXTENSIONS) | F.lower(b).endswith(".min.js") | hidden | is_secret(path)


def is_test_like(path: Column) -> Column:
    """As the ranker sees tests."""
    b = F.lower(base(path))
    return F.exists(directories(path), lambda d: F.lower(d).isin(*TEST_DIRS)) | _any(b.endswith(s) for s in TEST_SUFFIXES)


def is_test_path(path: Column) -> Column:
    """As the logic map sees tests."""
    p = F.lower(path)
    return p.rlike(r"(_test\.[a-z]+|\.test\.[a-z]+|\.spec\.[a-z]+)$") | p.rlike("(^|/)(__tests__|tests?)/")


def production_stem(path: Column) -> Column:
    return F.regexp_replace(strip_extension(F.lower(base(path))), r"(_test|\.test|\.spec)$", "")


def is_legacy_like(path: Column) -> Column:
    return F.exists(directories(path), lambda d: F.exists(F.split(F.lower(d), "[^a-z0-9]+"), lambda t: t.isin(*LEGACY_TOKENS)))


def is_root_doc(path: Column) -> Column:
    return ~F.contains(path, F.lit("/")) & F.lower(strip_extension(path)).isin(*ROOT_DOCS)


def under(path: Column, prefixes: Column) -> Column:
    """The path is one of the prefixes or lies under it."""
    return F.exists(prefixes, lambda p: (path == p) | path.startswith(F.concat(p, F.lit("/"))))


def focus_prefixes(focus: Column) -> Column:
    return F.filter(F.transform(F.split(focus, ","), lambda p: F.trim(p)), lambda p: p != "")


def _glob(pattern: str) -> str:
    """A shell pattern of one step as a regular expression; stars stop at slashes."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        close = pattern.find("]", k + 2) if c == "[" else -1
        if close > 0:
            out += pattern[k : close + 1]
            k = close
        elif c == "\\" and k + 1 < len(pattern):
            k += 1
            out += re.escape(pattern[k])
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        k += 1
    return out


def ignore_patterns(text: str) -> list[str]:
    """The patterns of an ignore file: lines that are neither blank nor comments."""
    return [p for p in (line.strip().replace("\\", "/") for line in text.split("\n")) if p and not p.startswith("#")]


def ignore_matches(path: Column, patterns: list[str], *, is_dir: bool = False) -> Column:
    """A pattern takes the path.

    Patterns that end in a slash take directories alone.  Without another slash a
    pattern is matched with every step; from a leading slash on it names a path from
    the root, or what lies under it; else it is a run of whole steps, of which only
    the first place in the path where its text stands is looked at.
    """
    each = []
    for p in patterns:
        if p.endswith("/") and not is_dir:
            continue
        p = p.removesuffix("/")
        if "/" not in p:
            each.append(path.rlike(f"(^|/){_glob(p)}(/|$)"))
        elif p.startswith("/"):
            each.append(path.rlike(f"^{_glob(p[1:])}$") | F.startswith(path, F.lit(p[1:] + "/")))
        else:
            at = F.locate(p, path)
            before, after = F.substring(path, at - 1, F.lit(1)), F.substring(path, at + len(p), F.lit(1))
            each.append((at > 0) & ((at == 1) | (before == "/")) & after.isin("", "/"))
    return _any(each) if each else F.lit(False)


def ignored(path: Column, patterns: list[str]) -> Column:
    """The file, or a directory above it, is taken by a pattern."""
    steps = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    return ignore_matches(path, patterns) | ((F.size(steps) > 1) & F.exists(above, lambda d: ignore_matches(d, patterns, is_dir=True)))
