"""Symbols, imports, signatures, chunks and declared blocks of source files.

Each file is one row, so parsing needs no shuffle: pandas UDFs turn contents into
arrays that Spark explodes.  A scanner tells code from strings and comments;
patterns are tables that run over code alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .scanner import Scan

#: Patterns of symbols (kind, pattern) and of imports by language, in the order in which symbols are listed.
_SCRIPT = (
    ("export_func", r"^export\s+(?:async\s+)?function\s+(\w+)"),
    ("export_class", r"^export\s+(?:default\s+)?class\s+(\w+)"),
    ("export_const", r"^export\s+(?:const|let|var)\s+(\w+)"),
    ("export_type", r"^export\s+(?:type|interface)\s+(\w+)"),
    ("export_default", r"^export\s+default\s+(?:function\s+)?(\w+)"),
    ("func", r"^(?:async\s+)?function\s+(\w+)"),
    ("class", r"^class\s+(\w+)"),
)
SYMBOLS = {
    "typescript": _SCRIPT,
    "javascript": _SCRIPT,
    "rust": (("fn", r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", r"^(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^(?:pub\s+)?enum\s+(\w+)"), ("trait", r"^(?:pub\s+)?trait\s+(\w+)"), ("impl", r"^impl(?:\s+<[^>]*>)?\s+(\w+)")),
    "cpp": (("class", r"^(?:class|struct)\s+(\w+)"), ("func", r"^[ \t]*(?:\w+(?:<[^>]*>)?\s+)+(\w+)\s*\([^)]*\)\s*(?:const\s*)?[\{;]")),
    "java": (("class", r"^\s*(?:(?:public|protected|private|static|abstract|final)\s+)*(?:class|interface|enum)\s+(\w+)"), ("method", r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+(?:[\w<>\[\]]+\s+)+(\w+)\s*\([^)]*\)")),
    "ruby": (("class", r"^(?:class|module)\s+(\w+)"), ("func", r"^\s*def\s+(\w+[\?!]?)")),
}
IMPORTS = {
    "typescript": (r"^import\s+.+from\s+['\"]([^'\"]+)['\"]", r"require\(['\"]([^'\"]+)['\"]\)"),
    "javascript": (r"^import\s+.+from\s+['\"]([^'\"]+)['\"]", r"require\(['\"]([^'\"]+)['\"]\)"),
    "python": (r"^import\s+(\S+)", r"^from\s+(\S+)\s+import"),
    "go": (r"^import\s+\"([^\"]+)\"",),
    "rust": (r"^use\s+([^;{]+)", r"^mod\s+(\w+);"),
    "cpp": (r"^#include\s+[\"<]([^\">]+)[\">]",),
    "java": (r"^import\s+([^;]+);",),
    "ruby": (r"^require(?:_relative)?\s+['\"]([^'\"]+)['\"]",),
}
#: Members of a class body (accessors, arrow fields, methods; the first pattern that fits decides) and words that begin a line and name none.
MEMBERS = (
    r"^\s*(?:(?:public|private|protected|static)\s+)*(get|set)\s+(\w+)\s*\(",
    r"^\s*(?:(?:public|private|protected|static|readonly|override)\s+)*(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>",
    r"^\s*(?:(?:public|private|protected|static|async|readonly|override|abstract)\s+)*(\w+)\s*(?:<[^>]*>)?\s*\(",
)
NO_MEMBER = frozenset("if for while switch return throw typeof new catch else do try function class await yield this super import".split())
#: The line of a signature for an import and for each kind of symbol.
SIGNATURES = {
    "typescript": {"import": "// import: {}", "export_func": "export function {}(...) {{ ... }}", "export_class": "export class {} {{ ... }}", "export_const": "export const {} = ...", "export_type": "export type/interface {} {{ ... }}", "export_default": "export default {}", "func": "function {}(...) {{ ... }}", "class": "class {} {{ ... }}", "method": "  {}(...): ...", "get": "  get {}(): ...", "set": "  set {}(...): void"},
    "python": {"import": "# import: {}", "func": "def {}(...): ...", "class": "class {}: ...", "method": "  def {}(...): ..."},
    "go": {"import": "// import: {}", "func": "func {}(...) {{ ... }}", "type": "type {} struct/interface {{ ... }}", "const": "const {} = ...", "var": "var {} ..."},
    "markdown": {"h1": "h1: {}", "h2": "h2: {}", "h3": "h3: {}"},
    "rust": {"import": "// import: {}", "fn": "fn {}(...) {{ ... }}", "struct": "struct {} {{ ... }}", "enum": "enum {} {{ ... }}", "trait": "trait {} {{ ... }}", "impl": "impl {} {{ ... }}"},
    "cpp": {"import": "#include <{}>", "class": "class/struct {} {{ ... }}", "func": "{}(...)"},
    "java": {"import": "import {};", "class": "class/interface {} {{ ... }}", "method": "  {}(...)"},
    "ruby": {"import": "require '{}'", "class": "class/module {}", "func": "  def {}"},
}
SIGNATURES["javascript"] = SIGNATURES["typescript"]
#: Functions inside a function, by their first line, the least lines of a function that is searched for them, and the most that ``chunks_of`` takes from one unless it is told otherwise (no query has a limit).
CLOSURES = (
    r"^(\s+)(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)(?:\s*:\s*[^=]+?)?\s*=\s*(?:async\s+)?(?:function\b|\()",
    r"^(\s+)(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(",
)
CLOSURE_LINES, CLOSURES_EACH = 40, 80
#: Words of a licence header.
LICENCE = ("copyright", "license", "spdx-license-identifier", "apache", "created by", "author", "all rights reserved")
#: Kinds of chunks that have a parent, and kinds that may be one.
MEMBER_KINDS = frozenset(("method", "get", "set", "nested_func"))
PARENT_KINDS = frozenset(("class", "export_class", "type", "interface", "func", "export_func", "const", "export_const", "let", "var"))

_PATTERNS = {lang: [(k, re.compile(p, re.M)) for k, p in ps] for lang, ps in SYMBOLS.items()}
_IMPORTS = {lang: [re.compile(p, re.M) for p in ps] for lang, ps in IMPORTS.items()}
_MEMBERS = [re.compile(p) for p in MEMBERS]
_CLOSURES = [re.compile(p) for p in CLOSURES]
_CLASS = re.compile(r"^(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(\w+)", re.M)
_PY = re.compile(r"^([ \t]*)(?:(class)\s+(\w+)\b|(?:async\s+)?def\s+(\w+))", re.M)
_HEADING = re.compile(r"^(#{1,3})\s+(.+)")
_UNSAFE = re.compile(r"[^a-zA-Z0-9._-]+")
_SCRIPTS = ("typescript", "javascript")

Symbol = tuple[str, str, int]


@dataclass
class Chunk:
    kind: str
    symbol: str
    start: int
    end: int
    chunk_id: str = ""
    parent: str | None = None


@dataclass
class Block:
    """Lines that a declaration takes, its label, and the names by which it is asked for."""

    label: str
    start: int
    end: int
    names: list[str]


class Source:
    """A source text with its scan and its lines; a last line end opens no line."""

    def __init__(self, lang: str | None, text: str):
        self.lang, self.text = lang or "", text
        self.scan = Scan(text, lang)
        self.lines = text.removesuffix("\n").split("\n")
        self.code_lines = self.scan.code.removesuffix("\n").split("\n")

    def line_start(self, line: int) -> int:
        return self.scan.starts[line - 1]


# Symbols, imports and signatures.


def symbols_of(lang: str | None, text: str) -> list[Symbol]:
    """(name, kind, line) of a file's symbols, the first of each name and kind."""
    return _symbols(Source(lang, text))


def _symbols(source: Source) -> list[Symbol]:
    scan = source.scan
    if source.lang == "python":
        found = _python(source)
    elif source.lang == "markdown":
        found = [(m[2].strip(), f"h{len(m[1])}", k) for k, line in enumerate(source.lines, 1) if (m := _HEADING.match(line))]
    elif source.lang == "go":
        found = sorted((s for d in go_declarations(source) for s in d.symbols()), key=lambda s: s[3:])
    else:
        found = [(m[1], kind, scan.line(m.start(1))) for kind, p in _PATTERNS.get(source.lang, ()) for m in p.finditer(scan.code)]
        if source.lang in _SCRIPTS:
            found += [s for m in _CLASS.finditer(scan.code) for s in _members(source, m)]
    return list({s[:2]: s[:3] for s in reversed(found)}.values())[::-1]


def _python(source: Source) -> list[Symbol]:
    """Functions in a class are Class.name, those in functions are none."""
    out, open_ = [], []
    for m in _PY.finditer(source.scan.code):
        indent, line = len(m[1]), source.scan.line(m.start())
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        around = open_[-1][1] if open_ else ""
        if m[2]:
            out.append((m[3], "class", line))
        elif not open_:
            out.append((m[4], "func", line))
        elif around:
            out.append((f"{around}.{m[4]}", "method", line))
        open_.append((indent, m[3] or ""))
    return out


def _members(source: Source, m: re.Match[str]) -> list[Symbol]:
    """Members at the level of the class body that opens after a match."""
    scan, out = source.scan, []
    open_ = scan.first(m.end(), "{;")
    if open_ < 0 or open_ not in scan.pair:
        return out
    level = scan.depth(open_) + 1
    for line in range(scan.line(open_), scan.line(scan.pair[open_]) + 1):
        start = max(source.line_start(line), open_ + 1)
        if scan.depth(start) != level or start >= scan.pair[open_]:
            continue
        end = scan.code.find("\n", start)
        text = scan.code[start : len(scan.code) if end < 0 else end]
        accessor, arrow, method = (p.match(text) for p in _MEMBERS)
        kind, name = (accessor[1], accessor[2]) if accessor else ("method", (arrow or method or [None, ""])[1])
        if name and name not in NO_MEMBER:
            out.append((f"{m[1]}.{name}", kind, line))
    return out


def imports_of(lang: str | None, text: str) -> list[str]:
    """Imports, pattern by pattern, the first of each."""
    return _imports(Source(lang, text))


def _imports(source: Source) -> list[str]:
    scan = source.scan
    found = [m[1].strip() for p in _IMPORTS.get(source.lang, ()) for m in p.finditer(scan.uncommented) if not scan.code[m.start()].isspace()]
    if source.lang == "go":
        for m in re.finditer(r"(?m)^import\s*\(", scan.code):
            found += re.findall(r'"([^"\n]+)"', scan.uncommented[m.end() : scan.pair.get(m.end() - 1, m.end())])
    return list(dict.fromkeys(found))


def signature_of(lang: str | None, text: str, symbols: list[Symbol] | None = None, imports: list[str] | None = None) -> str:
    """What a file offers, a line each; empty for a language without signatures."""
    if lang in ("json", "yaml"):
        return f"// {lang} file, {text.count(chr(10)) + 1} lines\n"
    forms = SIGNATURES.get(lang or "")
    if forms is None:
        return ""
    lines = [forms["import"].format(i) for i in (imports_of(lang, text) if imports is None else imports)] if "import" in forms else []
    lines += [forms[kind].format(name) for name, kind, _ in (symbols_of(lang, text) if symbols is None else symbols) if kind in forms]
    return "".join(f"{line}\n" for line in lines)


# Go declarations.


@dataclass
class Declaration:
    """A top-level func, or one entry of a type, const or var declaration; offsets of its code, and the line where its comment begins."""

    kind: str
    names: list[str]
    start: int
    end: int
    doc: int | None
    line: int
    receiver: str = ""
    inner: list[str] = field(default_factory=list)
    alone: bool = True  # the only entry: the keyword and the comment above it belong to it
    keyword: int = 0
    close: int = 0
    grouped: bool = False

    def symbols(self) -> list[tuple[str, str, int, int, int]]:
        rank = ("func", "type", "const", "var").index(self.kind)
        return [(n, self.kind, self.line, rank + 4 * self.grouped, self.start) for n in self.names if n != "_"]


_GO_DECL = re.compile(r"^(func|type|const|var)\b", re.M)
_GO_GOES_ON = frozenset(",+-*/%&|^<>=!:.~([{")
_GO_BODY = re.compile(r"\w+\s*(?:\[\s*[A-Za-z_][^\]]*\])?\s*=?\s*(struct|interface)\s*\{")
_GO_NAMES = re.compile(r"\w+(?:\s*,\s*\w+)*")


def go_declarations(source: Source) -> list[Declaration]:
    """In order; none for a text without a package clause or with brackets that do not match."""
    scan = source.scan
    if not scan.balanced or not re.search(r"(?m)^\s*package\s+\w+", scan.code):
        return []
    return [d for m in _GO_DECL.finditer(scan.code) if scan.depth(m.start()) == 0 for d in (_go_func(source, m) if m[1] == "func" else _go_entries(source, m))]


def _go_func(source: Source, m: re.Match[str]) -> list[Declaration]:
    scan, code = source.scan, source.scan.code
    at = re.compile(r"\s*").match(code, m.end()).end()
    receiver = ""
    if code.startswith("(", at):
        inside = re.sub(r"\[.*\]\s*$", "", code[at + 1 : scan.pair[at]], flags=re.S)
        receiver = (re.findall(r"\w+", inside) or [""])[-1]
        at = scan.pair[at] + 1
    name = re.compile(r"\s*(\w+)").match(code, at)
    if not name:
        return []
    at, end = name.end(), None
    while end is None:
        k = scan.first(at, "({[\n")
        if k < 0 or code[k] == "\n":
            end = len(code[:k].rstrip()) - 1 if k >= 0 else len(code) - 1
        elif code[k] == "{" and not re.search(r"\b(?:struct|interface)\s*$", code[max(at - 1, k - 12) : k]):
            end = scan.pair[k]
        else:
            at = scan.pair[k] + 1
    return [Declaration("func", [name[1]], m.start(), end, _doc(source, m.start()), scan.line(m.start()), receiver)]


def _go_entries(source: Source, m: re.Match[str]) -> list[Declaration]:
    scan, code = source.scan, source.scan.code
    at = m.end()
    while at < len(code) and code[at] in " \t":
        at += 1
    grouped = code.startswith("(", at)
    stop = scan.pair[at] if grouped else len(code)
    at += grouped
    out = []
    while at < stop and (k := re.compile(r"[\s;]*").match(code, at, stop).end()) < stop:
        end = _statement_end(scan, k, stop)
        names = _GO_NAMES.match(code, k)
        if names:
            body = _GO_BODY.match(code, k) if m[1] == "type" else None
            listed = [names[0].split(",")[0].strip()] if m[1] == "type" else [n.strip() for n in names[0].split(",")]
            out.append(Declaration(m[1], listed, k, end, _doc(source, k) if grouped else None, scan.line(k), inner=_go_inner(scan, body) if body else [], keyword=m.start(), close=stop if grouped else end, grouped=grouped))
        at = end + 1
        if not grouped:
            break
    outer = _doc(source, m.start())
    for k, d in enumerate(out):
        d.alone = len(out) == 1
        if k == 0 and d.doc is None:
            d.doc = outer
    return out


def _statement_end(scan: Scan, at: int, stop: int) -> int:
    """The last offset of a Go statement: a line ends it unless a bracket is open or its last sign asks for more."""
    filled = scan.filled
    pattern, k = re.compile(r"[(\[{\n;]"), at
    while m := pattern.search(filled, k, stop):
        if m[0] == ";":
            return m.start() - 1
        if m[0] != "\n":
            k = scan.pair.get(m.start(), m.start()) + 1
            continue
        last = len(filled[at : m.start()].rstrip()) + at - 1
        if last >= at and filled[last] not in _GO_GOES_ON:
            return last
        k = m.end()
    return len(filled[at:stop].rstrip()) + at - 1


def _go_inner(scan: Scan, body: re.Match[str]) -> list[str]:
    """Fields of a struct and methods of an interface; embedded types are none."""
    out, at, stop = [], body.end(), scan.pair[body.end() - 1]
    while at < stop and (k := re.compile(r"[\s;]*").match(scan.code, at, stop).end()) < stop:
        end = _statement_end(scan, k, stop)
        entry = scan.filled[k : end + 1]
        if body[1] == "interface":
            m = re.match(r"(\w+)\s*\(", entry)
            out += [m[1]] if m else []
        elif m := re.match(r"(\w+(?:\s*,\s*\w+)*)[ \t]+[^\s\x00]", entry):
            out += [n.strip() for n in m[1].split(",")]
        at = end + 1
    return out


def _doc(source: Source, at: int) -> int | None:
    """The first line of the comment that ends on the line above an offset."""
    line = first = source.scan.line(at)
    while line > 1 and line - 1 in source.scan.comment_lines:
        line -= 1
    return line if line < first else None


# Chunks.


def chunks_of(lang: str | None, rel_path: str, text: str, closures_each: int | None = CLOSURES_EACH) -> list[Chunk]:
    """A file's chunks in order, with their ids and parents; the whole file is one if nothing else is found.

    A class ends before its first member; functions inside long functions are
    chunks of their own beside them, ``closures_each`` of one at most, or all (None).
    """
    return _chunks(Source(lang, text), rel_path, closures_each)


def _chunks(source: Source, rel_path: str, closures_each: int | None = None) -> list[Chunk]:
    scripts = lambda s: _script_chunks(s, closures_each)
    by = {"go": _go_chunks, "python": _python_chunks, "markdown": _sections, "typescript": scripts, "javascript": scripts}
    found = by[source.lang](source) if source.lang in by else []
    if not found:
        found = [Chunk("file", re.split(r"[/\\]", rel_path)[-1], 1, len(source.lines))]
    for c in found:
        c.start, c.end = max(c.start, 1), max(c.start, c.end, 1)
        c.chunk_id = _UNSAFE.sub("-", f"{c.kind}:{c.symbol}".lower().strip()).strip("-") or "chunk"
    if source.lang != "markdown":
        found.sort(key=lambda c: (c.start, c.chunk_id))
    seen: dict[str, int] = {}
    for c in found:
        seen[c.chunk_id] = n = seen.get(c.chunk_id, 0) + 1
        c.chunk_id += f"-{n}" if n > 1 else ""
    parents: dict[str, str] = {}
    for c in found:
        if c.kind in PARENT_KINDS:
            parents.setdefault(c.symbol, c.chunk_id)
    for c in found:
        if c.kind in MEMBER_KINDS and "." in c.symbol:
            c.parent = parents.get(c.symbol.split(".")[0].strip())
    return found


def _sections(source: Source) -> list[Chunk]:
    heads = _symbols(source)
    if not heads:
        return []
    out = [Chunk("section", "preamble", 1, heads[0][2] - 1)] if heads[0][2] > 1 else []
    ends = [line - 1 for _, _, line in heads[1:]] + [len(source.lines)]
    return out + [Chunk("section", name, line, end) for (name, _, line), end in zip(heads, ends, strict=True)]


def _go_chunks(source: Source) -> list[Chunk]:
    scan, out = source.scan, []
    for d in go_declarations(source):
        kind, symbol = ("method", f"{d.receiver}.{d.names[0]}") if d.receiver else (d.kind, ",".join(d.names))
        start, end = (d.keyword, d.close) if d.kind != "func" and d.alone else (d.start, d.end)
        out.append(Chunk(kind, symbol, d.doc or scan.line(start), scan.line(end)))
    return out


def _script_chunks(source: Source, closures_each: int | None) -> list[Chunk]:
    out = []
    for name, kind, line in _symbols(source):
        end = source.scan.body_end(source.line_start(line))
        out.append(Chunk(kind, name, line, line if end is None else source.scan.line(end)))
    for c in out:
        if c.kind in ("class", "export_class"):
            inside = [m.start for m in out if m.kind in MEMBER_KINDS and m.symbol.split(".")[0] == c.symbol and c.start < m.start <= c.end]
            if inside:
                c.end = _without_tail(source, c.start, min(inside) - 1, ("//", "/*", "*", "@"))
    return out + _closures(source, out, closures_each)


def _without_tail(source: Source, start: int, end: int, marks: tuple[str, ...]) -> int:
    """The end without blank lines, comments and decorators, which belong to what follows."""
    while end > start and (not source.lines[end - 1].strip() or source.lines[end - 1].strip().startswith(marks)):
        end -= 1
    return end


def _closures(source: Source, chunks: list[Chunk], most: int | None) -> list[Chunk]:
    """The outermost functions inside each long function; one in several belongs to the innermost."""
    lines, found = source.lines, {}
    for k, text in enumerate(source.code_lines, 1):
        m = _CLOSURES[0].match(text) or _CLOSURES[1].match(text)
        if m:
            found[k] = (m[2], len(text) - len(text.lstrip(" \t")))
    places = list(found)
    taken = {c.symbol for c in chunks}
    out: dict[int, Chunk] = {}
    holds = lambda c: c.kind in ("func", "export_func") or (c.kind in ("const", "export_const", "let", "var") and ("=>" in lines[c.start - 1] or "function" in lines[c.start - 1]))
    long = [c for c in chunks if c.end - c.start >= CLOSURE_LINES and holds(c)]
    for parent in sorted(long, key=lambda c: c.end - c.start):
        inside = [(k, *found[k]) for k in places[bisect_right(places, parent.start) : bisect_left(places, parent.end)] if found[k][0] not in taken]
        least = min((indent for _, _, indent in inside), default=0)
        fresh = [x for x in inside if x[2] == least and x[0] not in out]
        for line, name, _ in fresh[:most]:
            end = source.scan.body_end(source.line_start(line))
            last = line if end is None else source.scan.line(end)
            out[line] = Chunk("nested_func", f"{parent.symbol}.{name}", line, min(last, parent.end))
    return [out[k] for k in sorted(out)]


def _indent(line: str) -> int | None:
    """Leading blanks; None for a line without code."""
    bare = line.lstrip(" \t")
    return None if not bare.strip() else len(line) - len(bare)


def _python_chunks(source: Source) -> list[Chunk]:
    n, out = len(source.lines), []
    for name, kind, line in _symbols(source):
        base = _indent(source.code_lines[line - 1]) or 0
        after = (k for k in range(line + 1, n + 1) if (i := _indent(source.code_lines[k - 1])) is not None and i <= base)
        out.append(Chunk(kind, name, line, next(after, n + 1) - 1))
    for c in out:
        if c.kind == "class":
            c.end = min([m.start - 1 for m in out if c.start < m.start <= c.end] + [c.end])
    for c in out:
        c.end = _without_tail(source, c.start, c.end, ("#", "@"))
    return out


# Blocks that an excerpt shows.


def blocks_of(lang: str | None, text: str) -> list[Block]:
    """The declarations of a file that a question may name."""
    source = Source(lang, text)
    if source.lang == "go":
        out = []
        for d in go_declarations(source):
            names, label = list(d.names), f"{d.kind} {', '.join(d.names)}"
            if d.receiver:
                names, label = [d.names[0], f"{d.receiver}.{d.names[0]}", d.receiver], f"func {d.receiver}.{d.names[0]}"
            out.append(Block(label, d.doc or source.scan.line(d.start), source.scan.line(d.end), names + d.inner))
        return out
    if source.lang not in (*_SCRIPTS, "python"):
        return []
    width = lambda s: len(s.expandtabs(4)) - len(s.expandtabs(4).lstrip(" "))
    lines, out = text.split("\n"), []
    code = source.scan.code.split("\n")
    for name, _, line in _symbols(source):
        if source.lang == "python":
            head, last = width(lines[line - 1]), line
            while last < len(lines) and (not code[last].strip() or width(lines[last]) > head):
                last += 1
        else:
            end = source.scan.body_end(source.line_start(line))
            last = min(line + 25, len(lines)) if end is None else source.scan.line(end)
        cut = name.find(".")
        out.append(Block(name, line, last, [name, name[:cut], name[cut + 1 :]] if cut > 0 else [name]))
    return out

# Forms of a text.


def compress(lang: str | None, content: str) -> str:
    """A licence comment at the top goes, several blank lines become one, blanks at line ends go; JSON is minified."""
    if lang == "json":
        import json

        try:
            return json.dumps(json.loads(content), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return content
    head = re.match(r"\s*(?:/\*.*?\*/|(?:(?://|#(?!!))[^\n]*(?:\n|\Z))+)", content, re.S)
    if head and any(w in head[0].lower() for w in LICENCE):
        content = content[head.end() :].lstrip("\n")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n|\Z)", "", content))


def without_comments(lang: str | None, content: str) -> str:
    """Comments go, strings stay."""
    out, at = [], 0
    for start, end in Scan(content, lang).comments:
        out.append(content[at:start])
        at = end
    return "".join([*out, content[at:]])


_STR, _INT = T.StringType(), T.IntegerType()
_SYMBOL = T.ArrayType(T.StructType([T.StructField("name", _STR), T.StructField("kind", _STR), T.StructField("line", _INT)]))
_PARSED = T.StructType([T.StructField("symbols", _SYMBOL), T.StructField("imports", T.ArrayType(_STR)), T.StructField("signature", _STR)])
_CHUNKS = T.ArrayType(T.StructType([T.StructField(c, _STR) for c in ("chunk_id", "kind", "symbol", "parent_id", "content", "ast_hash")] + [T.StructField(c, _INT) for c in ("start_line", "end_line")]))

_OUTLINE = T.StructType([T.StructField("chunks", T.ArrayType(T.StructType([T.StructField("kind", _STR), T.StructField("symbol", _STR), T.StructField("content", _STR), T.StructField("start_line", _INT)]))), T.StructField("names", T.ArrayType(_STR)), T.StructField("imports", T.ArrayType(_STR))])
_CLOSED = T.ArrayType(T.StructType([T.StructField(c, _STR) for c in ("symbol", "parent_id")] + [T.StructField(c, _INT) for c in ("start_line", "end_line", "parent_start", "parent_end")]))


@F.pandas_udf(_PARSED)
def _parsed(langs: pd.Series, contents: pd.Series) -> pd.DataFrame:
    out: dict[str, list] = {"symbols": [], "imports": [], "signature": []}
    for lang, content in zip(langs, contents, strict=True):
        source = Source(lang, content or "")
        symbols, imports = _symbols(source), _imports(source)
        out["symbols"].append([{"name": n, "kind": k, "line": i} for n, k, i in symbols])
        out["imports"].append(imports)
        out["signature"].append(signature_of(lang, content or "", symbols, imports))
    return pd.DataFrame(out)


@F.pandas_udf(_CHUNKS)
def _chunked(langs: pd.Series, paths: pd.Series, contents: pd.Series) -> pd.Series:
    out = []
    for lang, path, content in zip(langs, paths, contents, strict=True):
        lines = (content or "").removesuffix("\n").split("\n")
        told = lambda c: hashlib.sha256(f"{c.kind}\0{c.symbol}\0{c.start}\0{c.end}".encode()).hexdigest()
        out.append([{"chunk_id": c.chunk_id, "kind": c.kind, "symbol": c.symbol, "parent_id": c.parent, "content": "\n".join(lines[c.start - 1 : c.end]), "ast_hash": told(c), "start_line": c.start, "end_line": c.end} for c in chunks_of(lang, path or "", content or "", None)])
    return pd.Series(out)


@F.pandas_udf(_OUTLINE)
def _outlined(langs: pd.Series, paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
    out: dict[str, list] = {"chunks": [], "names": [], "imports": []}
    for lang, path, content in zip(langs, paths, contents, strict=True):
        source = Source(lang, content or "")
        out["chunks"].append([{"kind": c.kind, "symbol": c.symbol, "content": "\n".join(source.lines[c.start - 1 : c.end]), "start_line": c.start} for c in _chunks(source, path or "")])
        out["names"].append([name for name, _, _ in _symbols(source)])
        out["imports"].append(_imports(source))
    return pd.DataFrame(out)


@F.pandas_udf(_CLOSED)
def _closed(langs: pd.Series, paths: pd.Series, contents: pd.Series) -> pd.Series:
    out = []
    for lang, path, content in zip(langs, paths, contents, strict=True):
        chunks = chunks_of(lang, path or "", content or "", None)
        by_id = {c.chunk_id: c for c in chunks}
        nested = [(c, by_id[c.parent]) for c in chunks if c.kind == "nested_func" and c.parent in by_id]
        out.append([{"symbol": c.symbol, "parent_id": p.chunk_id, "start_line": c.start, "end_line": c.end, "parent_start": p.start, "parent_end": p.end} for c, p in nested])
    return pd.Series(out)


@F.pandas_udf(_STR)
def compressed(langs: pd.Series, contents: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else compress(lang, c) for lang, c in zip(langs, contents, strict=True)], dtype=object)


def parse(files: DataFrame) -> DataFrame:
    """files(rel_path, lang, content) with symbols(name, kind, line), imports and signature."""
    return files.withColumn("p", _parsed("lang", "content")).select(*files.columns, "p.symbols", "p.imports", "p.signature")


def code_chunks(files: DataFrame) -> DataFrame:
    """The chunks of files(rel_path, lang, content).

    rel_path, pos, chunk_id, kind, symbol, start_line, end_line, content, its hash,
    ast_hash (of kind, symbol and lines), parent_id, calls and token_estimate.
    Ids and parents are told within the file, so nothing moves.
    """
    each = files.select("rel_path", F.posexplode(_chunked("lang", "rel_path", "content")).alias("pos", "c")).select("rel_path", "pos", "c.*")
    return each.select(*each.columns, F.sha2("content", 256).alias("content_hash"), X.calls_in("content").alias("calls"), X.token_estimate("content").alias("token_estimate"))


def outlined(files: DataFrame) -> DataFrame:
    """rel_path, chunks(kind, symbol, content, start_line), names of symbols and imports of files(rel_path, lang, content), each parsed once and a row still."""
    return files.select("rel_path", _outlined("lang", "rel_path", "content").alias("o")).select("rel_path", "o.*")


def nested_closures(files: DataFrame) -> DataFrame:
    """Functions inside long functions of files(rel_path, lang, content), with the lines of both.

    Only scripts have them, so no other file is parsed, and each of these once: both lie in the same file.
    """
    scripts = files.where(F.col("lang").isin(*_SCRIPTS) & F.col("rel_path").isNotNull())
    each = scripts.select("rel_path", F.inline(_closed("lang", "rel_path", "content")))
    return each.select("rel_path", "symbol", "start_line", "end_line", "parent_id", "parent_start", "parent_end")
