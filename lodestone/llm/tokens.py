"""Encoding of whole texts with a public byte-level BPE tokenizer.

Byte-level BPE merges only inside the pieces its pattern splits a text into, so
a piece's ids do not depend on its neighbours.  A space that precedes a
non-space always opens a piece; texts are split there, and each worker keeps
the ids of the pieces it has met.  Every new piece is encoded by the tokenizers
library itself, as are whole texts that hold an added token of the vocabulary,
such as <|endoftext|>.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Unicode White_Space, as in the tokenizer's \s.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ANY_WS = re.compile(f"[{_WS}]")
#: A space that does not open a piece.
_LOOSE = re.compile(f" (?:[{_WS}]|\\Z)")
_PIECE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_CLOSERS = frozenset(".,;:!?")

_ENCODERS: dict[str, PieceEncoder] = {}


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    keep: pieces whose ids are kept at most; then the cache starts anew.
    """

    def __init__(self, path: str, keep: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.keep = keep
        self.spaced: dict[str, bytes] = {}  # by piece without the space before it
        self.bare: dict[str, bytes] = {}
        self.line = self._one("\n")
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids whose bytes begin with a space, which byte-level vocabularies write so
        self.opens[[k for t, k in vocab.items() if t.startswith("\u0120")]] = True

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    @staticmethod
    def _cut(known: dict[str, bytes], pieces: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(starts) != len(pieces):
            raise ValueError("the vocabulary does not split texts before spaces and at line ends")
        known.update(zip(pieces, map(ids.tobytes().__getitem__, map(slice, (4 * starts).tolist(), (4 * ends).tolist())), strict=True))

    def encode(self, texts: list[str | None], span: int = 1 << 18) -> list[bytes]:
        """About ``span`` characters, or one longer text, are held in pieces at once: workers keep what they have once taken."""
        out, k = [], 0
        while k < len(texts):
            some, size = [], 0
            while k < len(texts) and (not some or size + len(texts[k] or "") < span):
                some.append(texts[k])
                size += len(texts[k] or "")
                k += 1
            out += self._encoded(some)
        return out

    def _encoded(self, texts: list[str | None]) -> list[bytes]:
        if self.added:
            whole = {k for k, t in enumerate(texts) if t and self.added.search(t)}
            if whole:
                rest = iter(self._encoded([t for k, t in enumerate(texts) if k not in whole]))
                return [self._one(t) if k in whole else next(rest) for k, t in enumerate(texts)]
        loose = [bool(t) and _LOOSE.search(t) is not None for t in texts]
        split = [None if not t else _PIECE.findall(t) if odd else t.split(" ") for t, odd in zip(texts, loose, strict=True)]
        spaced: set[str] = set()
        bare: set[str] = set()
        for parts, odd in zip(split, loose, strict=True):
            if parts is None:
                continue
            if odd:
                bare.update(parts)
            else:
                bare.add(parts[0])
                spaced.update(parts[1:])
        if len(self.spaced) + len(self.bare) > self.keep:
            self.spaced.clear()
            self.bare.clear()
        self._learn(self.spaced, spaced.difference(self.spaced), " ")
        self._learn(self.bare, bare.difference(self.bare), "")
        out = []
        for parts, odd in zip(split, loose, strict=True):
            if parts is None:
                out.append(b"")
            elif odd:
                out.append(b"".join(map(self.bare.__getitem__, parts)))
            else:
                out.append(self.bare[parts[0]] + b"".join(map(self.spaced.__getitem__, parts[1:])))
        return out

    def _learn(self, known: dict[str, bytes], new: set[str], before: str) -> None:
        known[""] = b""
        new.discard("")
        # A line end between non-spaces is a piece of its own.
        lines = {p: p.split("\n") for p in new if "\n" in p}
        lines = {p: parts for p, parts in lines.items() if all(q and not _ANY_WS.search(q) for q in parts)}
        if lines:
            new.difference_update(lines)
            self._learn(self.bare, {q for parts in lines.values() for q in parts[1:]}.difference(self.bare), "")
            new.update(parts[0] for parts in lines.values() if parts[0] not in known)
        closed = [p for p in new if p[-1] in _CLOSERS and p[:-1].isalpha()]
        new.difference_update(closed)
        new.update(p[:-1] for p in closed if p[:-1] not in known)
        odd = [p for p in new if not p.isalnum() and _ANY_WS.search(p)]
        new.difference_update(odd)
        plain = list(new)
        if plain and before:
            # Each piece opens with its space, and no other id of it does.
            ids = self._ids(before + before.join(plain))
            self._cut(known, plain, ids, starts := np.flatnonzero(self.opens[ids]), np.append(starts[1:], len(ids)))
        elif plain:
            # Pieces joined by line ends: a line end before a non-space is always its own piece.
            ids = self._ids("\n".join(plain))
            at = np.flatnonzero(ids == np.frombuffer(self.line, "<u4")[0])
            self._cut(known, plain, ids, np.append(0, at + 1), np.append(at, len(ids)))
        if odd:
            for p, e in zip(odd, self.tokenizer.encode_batch_fast([before + p for p in odd], add_special_tokens=False), strict=True):
                known[p] = np.array(e.ids, "<u4").tobytes()
        for p in closed:
            known[p] = known[p[:-1]] + (self.bare.get(p[-1]) or self.bare.setdefault(p[-1], self._one(p[-1])))
        for p, (head, *rest) in lines.items():
            known[p] = self.line.join([known[head], *map(self.bare.__getitem__, rest)])
