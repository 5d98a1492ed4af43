"""Spelling variants by a symmetric-delete join.

Every word emits itself and its distinct single deletions.  Words that differ by
one inserted or deleted letter share a key that one of them is; words that differ
by one replaced letter share the key without that letter, and stand at one
position of it.  A key met on both sides with no common position is two edits
and goes.  So each pair of near words meets under exactly one key, and near words
are counted without a distinct.

A key is shared by no more words than letters can be put into it, so groups are
bounded by the alphabet and the length of a word, whatever the corpus.  Words
beyond ``WHOLE`` letters are named by two polynomial hashes modulo 2**61 - 1, so
that a long word emits a line for each of its letters, not itself.

Forms grow at least twofold with each step, so chains of forms are short; they
are followed by doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sliced, table, utf8, written
from .sql import crc32

#: A run of letters once A-Z are lower-case.
_RUN = re.compile("[a-zÀ-ÿ]+")
_GAP = re.compile("[^a-zÀ-ÿ]")
#: Letters up to which a word stands for itself in keys.
WHOLE = 64
_PRIME, _BASES = 2**61 - 1, (2249305148893767297, 750899921530048855)


def _pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in parts of about ``size``, cut between runs."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def words_of(doc_id: int | None, text: bytes | None, every: int) -> Iterator[tuple[str, int]]:
    """Results of a document's runs with their numbers; those whose hash ``every`` divides lose a letter."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for piece in _pieces((text or b"").lower().decode()):
        for run, n in Counter(_RUN.findall(piece)).items():
            h = zlib.crc32(run.encode(), start)
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            yield run, n


def word_counts(docs: DataFrame, *, every: int = 97, letters: int = 5, least: int = 3, held: int = 200_000) -> DataFrame:
    """word and n (long) of docs(doc_id, text): results of ``letters`` letters or more, ``least`` times or more.

    A task counts before it hands anything on; it holds ``held`` words at most.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for b in sliced(batches, size=4 << 20):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True):
                for word, n in words_of(doc_id, text, every):
                    if len(word) >= letters:
                        seen[word] += n
                        if len(seen) >= held:
                            yield out()
        yield out()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counts, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def named(word: str) -> str:
    """The word, or the hashes of a long one."""
    return word if len(word) <= WHOLE else _hashed([_chain(word, b)[0][-1] for b in _BASES], len(word))


def _hashed(hashes: list[int], length: int) -> str:
    return f"{length}:" + ":".join(f"{h:x}" for h in hashes)


def _chain(word: str, base: int) -> tuple[list[int], list[int]]:
    """Hashes of all prefixes, and powers of the base."""
    prefix, power = [0], [1]
    for c in word:
        prefix.append((prefix[-1] * base + ord(c)) % _PRIME)
        power.append(power[-1] * base % _PRIME)
    return prefix, power


def deletions(word: str) -> Iterator[tuple[str, int, int]]:
    """Each distinct deletion with the first and last place where a letter put in gives the word again."""
    n, at = len(word), 0
    chains = [_chain(word, b) for b in _BASES] if n - 1 > WHOLE else []
    for _, same in groupby(word):
        end = at + sum(1 for _ in same)
        if chains:
            key = _hashed([(p[at] * w[n - 1 - at] + p[n] - p[at + 1] * w[n - 1 - at]) % _PRIME for p, w in chains], n - 1)
        else:
            key = word[:at] + word[at + 1 :]
        yield key, at, end - 1
        at = end


def _keys(words: DataFrame) -> DataFrame:
    """key, id, n, low and high of words(id, word, n); low and high are null where the key is the word itself."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("id", pa.string()), ("n", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        for b in sliced(batches):
            for i, word, n in zip(*(b.column(c).to_pylist() for c in ("id", "word", "n")), strict=True):
                rows.append((i, i, n, None, None))
                for key, low, high in deletions(word):
                    rows.append((key, i, n, low, high))
                    if len(rows) >= 20_000:
                        yield out()
        if rows:
            yield out()

    return words.mapInArrow(keys, "key string, id string, n long, low int, high int")


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, form and form_n of the words(id, word, n) that have a near word; form is null without one of twice the n."""
    a, b = _keys(words), _keys(words).toDF("key", "id_", "n_", "low_", "high_")
    # One of the two is the key, or both lack a letter at a common place.
    one = F.col("low").isNull() | F.col("low_").isNull() | ((F.col("low") <= F.col("high_")) & (F.col("low_") <= F.col("high")))
    pairs = a.join(b, "key").where((F.col("id") != F.col("id_")) & one)
    best = F.min(F.struct((-F.col("n_")).alias("less"), F.col("id_").alias("form")))
    near = pairs.groupBy("id", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    big = -F.col("best.less") >= 2 * F.col("n")
    return near.select("id", "n_near", F.when(big, F.col("best.form")).alias("form"), F.when(big, -F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """id and root of forms(id, form): the last word that forms lead to."""
    now = cut(forms.select("id", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("id", "root")
        now = now.drop("moved")


def spelling_variants(docs: DataFrame, *, every: int = 97, letters: int = 5, least: int = 3) -> DataFrame:
    """The words of docs(doc_id, text) with their near words and forms: word, form, root (string), n, n_near, form_n (long).

    Runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, are the
    words; those whose crc32 with the doc_id ``every`` divides lose one letter.
    Words of fewer than ``letters`` letters or ``least`` occurrences go.  A form is
    the near word of largest n, of equals the least by code points, if it occurs
    twice as often or more; the root is the last word that forms lead to.

    Null texts have no word; a null doc_id counts as an empty one.  Repeated rows
    count as often as they are there.  Words of any length take part; beyond 64
    letters they are compared by 122 bits of hashes.  An empty table gives no row.
    Other columns are ignored.
    """
    counted = word_counts(docs, every=every, letters=letters, least=least)
    name = F.pandas_udf(lambda w: w.map(named), "string")
    words = written(counted.select(F.when(F.length("word") <= WHOLE, F.col("word")).otherwise(name("word")).alias("id"), "word", "n"), "words")
    near = written(near_words(words), "near-words")
    last = roots(near.where("form is not null"))
    long = words.where(F.length("word") > WHOLE)
    out = words.join(near, "id", "left").join(last, "id", "left")
    for c in ("form", "root"):  # hashes back to words
        out = out.join(long.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word")), c, "left").withColumn(c, F.coalesce(f"{c}_word", c)).drop(f"{c}_word")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with near words, forms and roots."""
    return spelling_variants(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), each AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM each
), changed AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), marked AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), gaps AS (
  SELECT left(word, i - 1) || '*' || substr(word, i + 1) AS k, word, n FROM marked
), shorter AS (
  SELECT DISTINCT left(word, i - 1) || substr(word, i + 1) AS k, word, n FROM marked
), near AS (
  SELECT a.word AS a, b.word AS b, b.n FROM gaps a JOIN gaps b ON a.k = b.k AND a.word <> b.word
  UNION ALL SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON w.word = s.k
  UNION ALL SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.k
), ranked AS (
  SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, encode(b)) AS k FROM near
), best AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN r.b END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.k = 1
), followed AS (
  SELECT word, word AS here, 0 AS d FROM best
  UNION ALL SELECT f.word, b.form, f.d + 1 FROM followed f JOIN best b ON b.word = f.here WHERE b.form IS NOT NULL
)
SELECT b.word, b.form, f.root, b.n, b.n_near, b.form_n FROM best b JOIN (SELECT word, arg_max(here, d) AS root FROM followed GROUP BY word) f USING (word)
"""
