"""Personal data by patterns, and what gives it away by information theory.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers:
the protected entities.  The words of a document outside them are terms; counted
over the whole corpus, a term discloses an entity as far as the pointwise mutual
information of the two comes up to the information content of the entity,

    disclosure = log2(N n(e,t) / (n(e) n(t))) / log2(N / n(e)),

with N documents, n(e) holding the entity, n(t) the term, and n(e,t) both.  It is
1 if the term is met with this entity alone.  Terms over the lower threshold are
generalised to their kind wherever they stand in documents that hold the entity;
terms over the upper one are removed from all documents.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hashed_words, sliced, spread_join, table, tidy

KINDS = ("email", "ip", "card", "phone")
#: What a span is replaced with, by kind; a removed term leaves nothing.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "name": "[NAME]", "number": "[NUMBER]", "word": "[WORD]", "removed": ""}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TWO_DIGITS = re.compile(r"[0-9][\x20-]?[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 0x20 for c in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_SEEN_BITS = 23
_UID = "__uid"


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base spans in code points, by start and then kind as listed."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _TWO_DIGITS.search(text):
        out += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if 12 <= len(d := _NO_DIGITS.sub("", m[0])) <= 19 and _luhn(d)]
    if "." in text and _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGITS.sub("", m[0])) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]


def _entity(kind: str, value: str) -> int:
    value = value.lower() if kind in ("email", "ip") else _NO_DIGITS.sub("", value)
    return int(np.uint64(xxhash.xxh64_intdigest(f"{kind}:{value}")).view(np.int64))


_SPAN = "struct<start:int,end:int,kind:string>"
_FOUND = f"uid long, doc_id long, spans array<{_SPAN}>, entities array<long>"
_ARROW = pa.schema([
    ("uid", pa.int64()), ("doc_id", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))),
    ("entities", pa.list_(pa.int64())),
])


def _shape(word: str) -> str:
    return "number" if any(c.isdigit() for c in word) else "name" if word[:1].isupper() else "word"


def _detected(docs: DataFrame) -> DataFrame:
    @tidy
    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            spans, entities = [], []
            for text in b.column("text").to_pylist():
                found = find_spans(text or "")
                spans.append([{"start": s, "end": e, "kind": kind} for s, e, kind in found])
                entities.append(sorted({_entity(kind, text[s:e]) for s, e, kind in found}))
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(spans, _ARROW.field("spans").type), pa.array(entities, _ARROW.field("entities").type)], schema=_ARROW)

    return docs.mapInArrow(detect, _FOUND)


def _outside(text: str) -> bytes:
    """The text with its base spans blanked, ready to be cut into words."""
    parts, at = [], 0
    for s, e, _ in find_spans(text):
        if s >= at:
            parts += [text[at:s], " "]
        at = max(at, e)
    return "".join([*parts, text[at:]]).encode().translate(_LETTERS)


def _together(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, term and n, the documents of a batch that hold both; entities that the filter rules out are left out."""
    among = docs.sparkSession.sparkContext.broadcast(_filter(entities.select(F.col("entity").alias("term"))))

    @tidy
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts, owners = [], []
            wanted = np.unpackbits(among.value).astype(bool)
            for text in b.column("text").to_pylist():
                found = np.array(sorted({_entity(kind, text[s:e]) for s, e, kind in find_spans(text or "")}), np.int64)
                found = found[wanted[(found.view(np.uint64) >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)]]
                if len(found):
                    texts.append(_outside(text))
                    owners.append(found)
            hashes, first = hashed_words(texts)
            held: dict[int, list[np.ndarray]] = defaultdict(list)
            for own, s, e in zip(owners, first[:-1], first[1:], strict=True):
                terms = np.unique(hashes[s:e])
                for entity in own.tolist():
                    held[entity].append(terms)
            for entity, lists in held.items():
                terms, n = np.unique(np.concatenate(lists), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), entity, np.int64)), pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["entity", "term", "n"])

    @tidy
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One entity's rows are few; Spark gets them in larger batches.
        kept, n = [], 0
        for b in pairs(batches):
            kept.append(b)
            n += b.num_rows
            if n >= 100_000:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, n = [], 0
        if n:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    return docs.select("text").mapInArrow(joined, "entity long, term long, n long")


def _filter(terms: DataFrame) -> np.ndarray:
    """A fixed filter of 2**23 bits, packed, that tells which words may be among the terms."""
    bits = terms.select(F.shiftrightunsigned("term", 64 - _SEEN_BITS).cast("int").alias("b"))
    packed = bits.groupBy(F.shiftright("b", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, b & 31))").alias("m"))
    seen = np.zeros(1 << _SEEN_BITS, bool)
    for w, m in packed.toLocalIterator():  # at most 2**18 rows, whatever the input
        seen[32 * w : 32 * w + 32] = [m >> k & 1 for k in range(32)]
    return np.packbits(seen)


def _places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """uid, term, start, end and shape of the words outside base spans that may be among the terms."""
    held = docs.sparkSession.sparkContext.broadcast(_filter(terms))

    @tidy
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(held.value).astype(bool)
        for b in sliced(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            hashes, first = hashed_words([t.encode().translate(_LETTERS) for t in texts])
            at = np.flatnonzero(seen[(hashes >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)])
            doc = np.searchsorted(first, at, "right") - 1
            out, known = [], -1
            for d, k in zip(doc.tolist(), at.tolist(), strict=True):
                if d != known:
                    known, spans, words = d, find_spans(texts[d]), list(_WORD.finditer(texts[d]))
                s, e = words[k - int(first[d])].span()
                if not any(x < e and s < y for x, y, _ in spans):
                    out.append((d, k, s, e, _shape(texts[d][s:e])))
            d, k, s, e, shape = zip(*out, strict=True) if out else ((), (), (), (), ())
            uid = b.column("uid").to_numpy()[np.array(d, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(hashes[np.array(k, np.int64)].view(np.int64)), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(shape, pa.string())], ["uid", "term", "start", "end", "shape"])

    return docs.select("uid", "text").mapInArrow(places, "uid long, term long, start int, end int, shape string")


def _document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and n_t, the documents that hold it, for the terms given; other words stay in their task as far as the filter tells."""
    held = docs.sparkSession.sparkContext.broadcast(_filter(terms))

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, met = np.unpackbits(held.value).astype(bool), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(np.array(list(met), np.uint64).view(np.int64)), pa.array(list(met.values()), pa.int64())], ["term", "n"])
            met.clear()
            return batch

        for b in sliced(batches):
            hashes, first = hashed_words([_outside(t or "") for t in b.column("text").to_pylist()])
            at = np.flatnonzero(seen[(hashes >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)])
            doc = np.searchsorted(first, at, "right") - 1
            both = np.unique(np.stack([doc.astype(np.uint64), hashes[at]]), axis=1)[1] if len(at) else np.empty(0, np.uint64)
            met.update(both.tolist())
            if len(met) >= 200_000:  # a task hands on each term once, as far as it can hold them
                yield out()
        yield out()

    counted = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    return counted.join(terms, "term", "left_semi")


def disclosures(docs: DataFrame, found: DataFrame, *, support: int, generalise: float) -> DataFrame:
    """entity, term and disclosure of the pairs at or over the lower threshold, met in ``support`` documents or more."""
    n = docs.count()
    own = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    # An entity in fewer documents than the support shares no term often enough.
    own = cut(own)
    pairs = cut(_together(docs, own.where(F.col("n_e") >= support)).join(own.where(F.col("n_e") >= support).select("entity"), "entity", "left_semi").groupBy("entity", "term").agg(F.sum("n").alias("n_et")).where(F.col("n_et") >= support))
    terms = pairs.select("term").distinct()
    weighed = pairs.join(own, "entity").join(_document_counts(docs, terms), "term")
    content = F.log2(F.lit(float(n)) / F.col("n_e"))
    shared = F.log2(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    return weighed.withColumn("disclosure", F.when(content > 0, shared / content)).where(F.col("disclosure") >= generalise).select("entity", "term", "disclosure")


def find_personal_data(docs: DataFrame, *, support: int = 3, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """The rows of docs(doc_id, text, ...) with a column spans: array of (start, end, kind) by start, null if there is none.

    Kinds are email, ip, card and phone, and for disclosing terms name, number,
    word (generalised) and removed.  ``support`` is the least number of documents
    that a term must share with the same entity.  Counts are over all documents.

    Null and empty texts have no span.  Repeated rows are documents of their own.
    Other columns stay; one named spans is replaced.  docs is read more than once;
    it must list its rows in the same order each time, as tables do.
    """
    asked, found, extra = _analysed(docs.drop("spans"), support, generalise, remove)
    spans = _all_spans(found.join(extra, "uid", "left")).where(F.size("spans") > 0).select("uid", "spans")
    return asked.join(spans.withColumnRenamed("uid", _UID), _UID, "left").drop(_UID)


def _analysed(docs: DataFrame, support: int, generalise: float, remove: float):
    asked = docs.withColumn(_UID, F.monotonically_increasing_id())
    texts = asked.select(F.col(_UID).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = cut(_detected(texts))
    pairs = cut(disclosures(texts, found, support=support, generalise=generalise))
    places = cut(_places(texts, pairs.select("term").distinct()))
    at = F.struct("start", "end", F.lit("removed").alias("kind")).alias("s")
    gone = places.join(pairs.where(F.col("disclosure") >= remove).select("term").distinct(), "term").select("uid", at)
    # From the places on: a document meets only the entities of terms that it holds, in one row a term.
    held = cut(places.select("uid", "term").distinct())
    owners = pairs.where(F.col("disclosure") < remove).groupBy("term").agg(F.collect_list("entity").alias("owners"))
    met = spread_join(held, owners.join(held.groupBy("term").agg(F.count("*").alias("n")), "term"), "term", held.count())
    holders = met.join(found.select("uid", "entities"), "uid").where(F.arrays_overlap("owners", "entities")).select("uid", "term")
    told = gone.unionByName(places.join(holders, ["uid", "term"]).select("uid", F.struct("start", "end", F.col("shape").alias("kind")).alias("s")))
    # A term of two entities is one span, removed if either asks for it.
    told = told.groupBy("uid", F.col("s.start").alias("start"), F.col("s.end").alias("end")).agg(F.max(F.struct((F.col("s.kind") == "removed").alias("r"), F.col("s.kind").alias("kind"))).alias("k"))
    extra = told.groupBy("uid").agg(F.collect_list(F.struct("start", "end", F.col("k.kind").alias("kind"))).alias("extra"))
    return asked, found, extra


def _all_spans(joined: DataFrame) -> DataFrame:
    order = lambda s: F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "name", "number", "word", "removed")]), s["kind"])
    every = F.concat("spans", F.coalesce("extra", F.array().cast(f"array<{_SPAN}>")))
    ranked = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), order(s).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return joined.withColumn("base", F.col("spans")).withColumn("spans", F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))


def sanitise(found: DataFrame) -> DataFrame:
    """find_personal_data's rows without spans, which are replaced in text: entities by their kind, terms generalised or removed."""

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, listed: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, listed, strict=True):
            if spans:
                parts, at = [], 0
                for kind, start, end in (s.split(":") for s in spans.split(",")):
                    if int(start) >= at:  # of overlapping spans the first stands
                        parts += [text[at : int(start)], MARKS[kind]]
                    at = max(at, int(end))
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    return found.withColumn("text", replaced("text", _listed(F.col("spans")))).drop("spans")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: counts and digest of the base spans, and all spans."""
    _, found, extra = _analysed(table(spark, sf_dir, "documents"), support=3, generalise=0.8, remove=0.95)
    joined = _all_spans(found.join(extra, "uid", "left"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return joined.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
