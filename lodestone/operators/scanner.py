"""A lexical scanner: one pass over a source text tells code from strings and comments.

``Scan`` keeps the text with strings, templates, regex literals and comments
blanked at the same offsets, the pairs of brackets in code, and the depth of
brackets at every offset.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    """What opens something other than code in a language."""

    line: str = "//"
    block: bool = True
    triple: bool = False
    raw: str = ""
    template: bool = False
    regex: bool = False
    quotes: str = "\"'"
    letters: bool = False  # ' holds a single character, else it is no quote

    def opening(self) -> re.Pattern[str]:
        parts = [re.escape(self.line)]
        parts += [r"/\*"] * self.block + ['"""', "'''"] * self.triple
        parts += [r"r#*\""] * (self.raw == "#") + ["[" + re.escape(self.quotes + (self.raw if self.raw == "`" else "")) + "]"]
        return re.compile("|".join([*parts, "`"] if self.template else parts) + ("|/" if self.regex else "") + r"|[(){}\[\]]")


_SCRIPT = Lexicon(template=True, regex=True)
LEXICONS = {
    "typescript": _SCRIPT,
    "javascript": _SCRIPT,
    "python": Lexicon(line="#", block=False, triple=True),
    "go": Lexicon(raw="`", letters=True),
    "rust": Lexicon(raw="#", letters=True),
    "cpp": Lexicon(letters=True),
    "java": Lexicon(triple=True, letters=True),
    "ruby": Lexicon(line="#", block=False),
    "yaml": Lexicon(line="#", block=False),
}
_OPENING = {name: lexicon.opening() for name, lexicon in LEXICONS.items()}

_REST = {q: re.compile(rf"(?:\\.|[^{q}\\\n])*{q}?", re.S) for q in "\"'"}
_LETTER = re.compile(r"'(?:\\[^\n][^'\n]{0,9}|[^'\\\n])'")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(?:`|\$\{|\Z)", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TRIPLE = {q: re.compile(rf"(?:\\.|(?!{q})[^\\])*(?:{q}|\Z)", re.S) for q in ('"""', "'''")}
#: After these a slash opens a regex literal; after other words, names and closing brackets it divides.
_BEFORE_REGEX = frozenset("(,=:[!&|?{};+-*%<>~^")
_WORDS_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new do else yield await instanceof".split())
_LAST_WORD = re.compile(r"[A-Za-z_$][\w$]*\Z")
_CLOSES = {")": "(", "]": "[", "}": "{"}


class Scan:
    """The text at the same offsets in three forms, and its brackets.

    code: all but code blanked; uncommented: comments alone blanked; filled: code
    with strings and the like, line ends included, as \\0.  pair: the closing offset
    of each opening one; comment_lines: lines that hold comments and nothing else.
    """

    def __init__(self, text: str, lang: str | None):
        self.text, self.lexicon = text, LEXICONS.get(lang or "")
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.comments: list[tuple[int, int]] = []
        self.pair: dict[int, int] = {}
        self.balanced = True
        self._blank: list[tuple[int, int]] = []
        self._depths: tuple[list[int], list[int]] = ([], [])
        self._held = {"(": 0, "[": 0, "{": 0}
        if self.lexicon:
            self._run(_OPENING[lang])
        comments = set(self.comments)
        strings = [b for b in self._blank if b not in comments]
        self.code = self._without(self._blank, text)
        self.uncommented = self._without(self.comments, text)
        self.filled = self._without(strings, self.uncommented, "\0") if strings else self.uncommented
        lines = {k for start, end in self.comments for k in range(self.line(start), self.line(max(start, end - 1)) + 1)}
        self.comment_lines = {k for k in lines if not self.uncommented[self.starts[k - 1] : self.starts[k] if k < len(self.starts) else len(text)].strip()}

    def _run(self, opening: re.Pattern[str]) -> None:
        text, at, open_ = self.text, 0, []  # open_: (offset, bracket), ${ for code in a template
        while m := opening.search(text, at):
            token, start = m[0], m.start()
            if token in "([{":
                open_.append((start, token))
                self._held[token] += 1
                self._deepen(start, 1)
                at = m.end()
            elif token in _CLOSES:
                if open_ and open_[-1][1] == "${" and token == "}":
                    open_.pop()
                    at = self._template(m.end(), start, open_)
                else:
                    self._close(start, token, open_)
                    at = m.end()
            elif token == "`" and self.lexicon.template:
                at = self._template(m.end(), start, open_)
            elif token == "/":
                end = _REGEX.match(text, start) if self._regex_may_start(start) else None
                at = self._blanks(start, end.end()) if end else m.end()
            else:
                at = self._literal(token, start, m.end())
        self.balanced = self.balanced and not open_

    def _literal(self, token: str, start: int, after: int) -> int:
        text = self.text
        if token == self.lexicon.line or token == "/*":
            stop = text.find("\n" if token != "/*" else "*/", after)
            end = len(text) if stop < 0 else stop + (2 if token == "/*" else 0)
            self.comments.append((start, end))
            return self._blanks(start, end)
        if token in _TRIPLE:
            return self._blanks(start, _TRIPLE[token].match(text, after).end())
        if token == "`":
            stop = text.find("`", after)
            return self._blanks(start, len(text) if stop < 0 else stop + 1)
        if token[0] == "r":
            close = '"' + "#" * (len(token) - 2)
            stop = text.find(close, after)
            return self._blanks(start, len(text) if stop < 0 else stop + len(close))
        if token == "'" and self.lexicon.letters:
            m = _LETTER.match(text, start)
            return self._blanks(start, m.end()) if m else after
        return self._blanks(start, _REST[token].match(text, after).end())

    def _template(self, at: int, start: int, open_: list[tuple[int, str]]) -> int:
        end = _TEMPLATE.match(self.text, at).end()
        if self.text.endswith("${", at, end):
            open_.append((end - 1, "${"))
        return self._blanks(start, end)

    def _blanks(self, start: int, end: int) -> int:
        self._blank.append((start, end))
        return end

    def _deepen(self, at: int, by: int) -> None:
        places, depths = self._depths
        places.append(at)
        depths.append((depths[-1] if depths else 0) + by)

    def _close(self, at: int, token: str, open_: list[tuple[int, str]]) -> None:
        for k in range(len(open_) - 1 if self._held[_CLOSES[token]] else -1, -1, -1):
            if open_[k][1] == "${":
                break
            if open_[k][1] == _CLOSES[token]:
                self.balanced = self.balanced and k == len(open_) - 1
                self.pair[open_[k][0]] = at
                self._deepen(at, k - len(open_))
                for _, bracket in open_[k:]:
                    self._held[bracket] -= 1
                del open_[k:]
                return
        self.balanced = False

    def _regex_may_start(self, at: int) -> bool:
        k, last = at, len(self._blank)
        while True:
            while k and self.text[k - 1].isspace():
                k -= 1
            if last and self._blank[last - 1][1] == k and self._blank[last - 1] in self.comments[-8:]:
                last -= 1
                k = self._blank[last][0]
                continue
            break
        if not k:
            return True
        if last and self._blank[last - 1][1] == k:  # a string or template
            return False
        word = _LAST_WORD.search(self.text, max(0, k - 12), k)
        return word[0] in _WORDS_BEFORE_REGEX if word else self.text[k - 1] in _BEFORE_REGEX

    @staticmethod
    def _without(spans: list[tuple[int, int]], text: str, fill: str = "") -> str:
        """The text with spans blanked but for line ends, or filled with a sign."""
        out, at = [], 0
        for start, end in spans:
            out += [text[at:start], fill * (end - start) if fill else "\n".join([" " * len(x) for x in text[start:end].split("\n")])]
            at = end
        return "".join([*out, text[at:]])

    def line(self, at: int) -> int:
        """The line, from 1, of an offset."""
        return bisect_right(self.starts, at)

    def depth(self, at: int) -> int:
        """Brackets open before an offset."""
        places, depths = self._depths
        k = bisect_right(places, at - 1)
        return depths[k - 1] if k else 0

    def first(self, at: int, marks: str) -> int:
        """The first of some characters in code from an offset on, or -1."""
        m = re.compile(f"[{re.escape(marks)}]").search(self.code, at)
        return m.start() if m else -1

    def body_end(self, at: int) -> int | None:
        """Where the first braces from an offset on close, or the first ; if that comes before; None if neither is there."""
        k = self.first(at, "{;")
        return None if k < 0 else k if self.code[k] == ";" else self.pair.get(k)
