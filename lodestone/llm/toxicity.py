"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, letters without their diacritics, look-alike
letters of other alphabets to Latin, digits and signs between letters to the
letters they stand for, all else to spaces.  Digits and signs at the start or end
of a word give further readings of it; of all readings the heaviest counts.  The
lexicon holds whole words and word beginnings with a weight, the log odds of a
toxic label; it is learned from a bounded sample of labelled rows.
A match inside an exception phrase does not count.  A text's score comes from
its summed weights, as such and for each hundred words, by logistic regression.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held_out, sliced, table

#: Letters of other alphabets that look like Latin ones, and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "s",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a word of abuse is none.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "pond scum")

_INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$!]+(?=[^\W\d_])")
_LEADING = re.compile(r"(?<![^\W_])(?<![@$!])[013457@$!]+(?=[^\W\d_])")
_TRAILING = re.compile(r"(?<=[^\W\d_])[013457@$!]+(?![^\W_])")
#: A trailing run without the exclamation marks that end a sentence.
_TRAILING_BUT_MARKS = re.compile(r"(?<=[^\W\d_])[013457@$!]*[013457@$](?=!+(?![^\W_]|[@$]))")
_ANY_STAND_IN = re.compile(r"[013457@$!]")


class _Folds(dict):
    """Translation table that fills itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = "".join(LOOK_ALIKES.get(x, x) for x in c) if 0xFF01 > code or code > 0xFF5E else chr(code - 0xFEE0).lower()
        if unicodedata.combining(chr(code)):
            c = ""
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            c = "".join(LOOK_ALIKES.get(x, x) for x in plain) if plain != c and plain.isalpha() and len(plain) == len(c) else c
            c = c if c[:1].isalpha() else " "
        self[code] = c
        return c


_FOLDS = _Folds()
_LETTER_RUN = re.compile(r"[^ ]+")


def _letters(m: re.Match[str]) -> str:
    return "".join(STAND_INS[c] for c in m[0])


def fold(text: str) -> str:
    """Folded text with a space at either end."""
    if _ANY_STAND_IN.search(text):
        text = _INSIDE.sub(_letters, text)
    return f" {text.translate(_FOLDS)} "


def readings(text: str) -> list[str]:
    """Folded texts, of one length: the plain one, and those with digits and signs at the edges of words read as letters."""
    out = [fold(text)]
    if _ANY_STAND_IN.search(text):
        inside = _INSIDE.sub(_letters, text)
        led = _LEADING.sub(_letters, inside)
        for start in (inside, led):
            for trailing in (None, _TRAILING_BUT_MARKS, _TRAILING):
                folded = f" {(trailing.sub(_letters, start) if trailing else start).translate(_FOLDS)} "
                if folded not in out:
                    out.append(folded)
    return out


@dataclass(frozen=True)
class Lexicon:
    """terms: (term, weight); a term begins with a space and ends with one if it is a whole word."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    logit: tuple[float, float, float] = field(default=(-2.0, 1.0, 1.0))


@lru_cache(maxsize=4)
def _automaton(lexicon: Lexicon) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term, weight in lexicon.terms:
        out.add_word(term, (len(term), weight))
    for phrase in lexicon.exceptions:
        folded = fold(phrase)
        out.add_word(folded, (len(folded), None))
    out.make_automaton()
    return out


def _matches(folded: str, lexicon: Lexicon) -> dict[int, float]:
    """The heaviest weight by the start of its terms, without those in exceptions."""
    heaviest: dict[int, float] = {}
    harmless: list[tuple[int, int]] = []
    if len(_automaton(lexicon)):
        for end, (size, weight) in _automaton(lexicon).iter(folded):
            if weight is None:
                harmless.append((end - size + 1, end))
            elif weight > heaviest.get(end - size + 1, 0.0):
                heaviest[end - size + 1] = weight
    if not harmless:
        return heaviest
    covered: list[tuple[int, int]] = []
    for a, b in sorted(harmless):
        if covered and a < covered[-1][1]:
            covered[-1] = (covered[-1][0], max(b, covered[-1][1]))
        else:
            covered.append((a, b))
    starts = [a for a, _ in covered]
    inside = lambda at: (k := bisect_right(starts, at) - 1) >= 0 and at < covered[k][1]
    return {at: w for at, w in heaviest.items() if not inside(at)}


def features(text: str | None, lexicon: Lexicon) -> tuple[float, float]:
    """log(1 + w) of the summed weights w and of the weights in a hundred words; of terms that begin together the heaviest counts."""
    folded, *others = readings(text or "")
    found = _matches(folded, lexicon)
    for other in others:
        more = _matches(other, lexicon)
        if more:
            for m in _LETTER_RUN.finditer(other):
                s, e = m.span()
                if s - 1 in more and folded[s:e] != other[s:e]:
                    own = [k for k in range(s - 1, e - 1) if k in found]
                    if more[s - 1] > sum(found[k] for k in own):
                        for k in own:
                            del found[k]
                        found[s - 1] = more[s - 1]
    total = sum(found.values())
    words = folded.count(" ", 0, -1) - folded.count("  ") if total else 1
    return math.log1p(total), math.log1p(100 * total / max(1, words))


def _terms(text: str, shortest: int = 4, longest: int = 7) -> set[str]:
    out = set()
    for word in set(fold(text).split()):
        if len(word) >= 3:
            out.add(f" {word} ")
            out.update(f" {word[:n]}" for n in range(shortest, min(longest, len(word)) + 1))
    return out


def learn(docs: DataFrame, labels: DataFrame, *, rows: int = 4000, least: float = 2.5, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learns a lexicon from docs(doc_id, text) and labels(doc_id, toxic).

    Held-out documents are never read.  ``rows`` bounds the sample: as many
    labelled rows of each class, those with the smallest hashes of doc_id.
    ``least`` is the smallest weight; all terms of it that enough toxic rows of
    the sample hold are in the lexicon.  Rows without doc_id, label or text teach
    nothing; of several labels of a document the largest counts, of repeated
    documents one row.  Without labels of both classes the lexicon is empty.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    ids = [known.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in ("toxic", "not toxic")]
    picked = cut(ids[0].unionByName(ids[1]))
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sample = cut(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))
    n = {bool(r[0]): r[1] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Lexicon((), exceptions)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            seen = {True: Counter(), False: Counter()}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(_terms(text))
            every = list(seen[True] | seen[False])
            yield pa.RecordBatch.from_pydict({"term": pa.array(every, pa.string()), "bad": [seen[True][t] for t in every], "good": [seen[False][t] for t in every]})

    # Rows with a term are counted over the whole sample; the copies of a few texts alone don't make a term.
    enough = max(3, n[True] // 200)
    weight = F.log((F.col("bad") + 0.5) / (n[True] + 1)) - F.log((F.col("good") + 0.5) / (n[False] + 1))
    counted = sample.mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    best = counted.where(F.col("bad") >= enough).withColumn("weight", weight).where(F.col("weight") >= least).orderBy("term").collect()
    lexicon = Lexicon(tuple((r.term, round(r.weight, 4)) for r in best), exceptions)
    rows_ = _scored(sample.withColumn("doc_id", F.col("toxic").cast("long")), lexicon, "features").collect()
    x = np.array([[1.0, r.f1, r.f2] for r in rows_])
    y = np.array([float(r.doc_id) for r in rows_])
    return Lexicon(lexicon.terms, exceptions, _logit(x, y))


def _logit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, both classes weighing as much as in y."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (p - y) + ridge * w * [0, 1, 1]
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag([1e-6, 1, 1])
        w -= np.linalg.solve(curve, gradient)
    return tuple(float(v) for v in w)


def _scored(docs: DataFrame, lexicon: Lexicon, what: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # terms of a bounded sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in sliced(batches):
            f = np.array([features(t, lex) for t in b.column("text").to_pylist()], float).reshape(-1, 2)
            if what == "features":
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f[:, 0]), pa.array(f[:, 1])], ["doc_id", "f1", "f2"])
            else:
                a, *w = lex.logit
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-(a + f @ w))))], ["doc_id", "score"])

    schema = "doc_id long, f1 double, f2 double" if what == "features" else "doc_id long, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, schema)


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs(doc_id, text).

    Null and empty texts have no match and get the lexicon's base score, as does
    any text under an empty lexicon.  Other columns are ignored.
    """
    return _scored(docs, lexicon, "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a lexicon learned from the labelled rows outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
