"""Excerpts: the blocks of a file that a question names, with marks for what is left out."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from . import parsing

#: A Go block of more lines keeps its head and tail; lines between blocks that are shown rather than marked.
MOST_LINES, HEAD, TAIL, GAP = 40, 8, 4, 2
#: Fixed value: the most tokens of a signature.
SIGNATURE_TOKENS = 350
_BLOCKS = S.ArrayType(S.StructType([S.StructField("label", S.StringType()), S.StructField("start", S.IntegerType()), S.StructField("end", S.IntegerType()), S.StructField("names", S.ArrayType(S.StringType()))]))


@F.pandas_udf(_BLOCKS)
def blocks(langs: pd.Series, contents: pd.Series) -> pd.Series:
    """The declarations of a file: label, lines and the names by which each is asked for."""
    return pd.Series([[{"label": b.label, "start": b.start, "end": b.end, "names": b.names} for b in parsing.blocks_of(lang, text or "")] for lang, text in zip(langs, contents, strict=True)])


def joined(blocks: list[tuple[int, int, str]], gap: int) -> list[tuple[int, int, str]]:
    """Blocks (start, end, label) in order, those that overlap or lie within ``gap`` lines as one with both labels."""
    out: list[tuple[int, int, str]] = []
    for start, end, label in sorted(blocks, key=lambda b: b[0]):
        if out and start <= out[-1][1] + gap:
            first, last, told = out[-1]
            out[-1] = (first, max(last, end), told if label in told else f"{told}, {label}")
        else:
            out.append((start, end, label))
    return out


def rendered(rel_path: str, lang: str, text: str, blocks: list[tuple[int, int, str]]) -> str:
    """A header, each block under its lines and labels, and marks for the lines in between."""
    lines, done = text.split("\n"), 0
    out = [f"// file: {rel_path}\n// lang: {lang}\n// representation: excerpt\n\n"]
    for start, end, label in joined(blocks, 0 if lang == "go" else GAP):
        left_out = start - done - 1
        if left_out > 0:
            out.append(f"\n// ... {left_out} lines omitted ...\n\n" if done else f"// ... {left_out} lines omitted from start ...\n\n")
        out.append(f"// ── {rel_path}:{start}-{end} ({label}) ──\n")
        shown, n = lines[start - 1 : end], end - start + 1
        if lang == "go" and n > MOST_LINES:
            shown = [*shown[:HEAD], f"// ... {n - HEAD - TAIL} lines elided in extracted excerpt ...", *shown[-TAIL:]]
        out += [f"{line}\n" for line in shown]
        done = end
    if done < len(lines):
        out.append(f"\n// ... {len(lines) - done} lines omitted to end ...\n")
    return "".join(out)


def asked_for(names: list[str], terms: list[str]) -> bool:
    """A form of a name lies within one of a term, or the other way round."""
    return any(n in t or t in n for n in names for t in terms)


@F.pandas_udf(S.StringType())
def _rendered(paths: pd.Series, langs: pd.Series, contents: pd.Series, blocks: pd.Series, terms: pd.Series) -> pd.Series:
    out = []
    for path, lang, text, own, asked in zip(paths, langs, contents, blocks, terms, strict=True):
        some = [(int(b["start"]), int(b["end"]), b["label"]) for b in own if asked_for(b["forms"], asked)] if own is not None and asked is not None else []
        out.append(rendered(path, lang, text or "", some) if some else None)
    return pd.Series(out, dtype=object)


def _forms(words: Column) -> Column:
    """Words and their stems, in lower case, of three bytes or more."""
    return F.array_distinct(F.filter(F.flatten(F.transform(words, lambda w: T.variants(F.lower(w)))), lambda v: F.octet_length(v) >= 3))


def symbol_excerpts(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(query_id, rel_path, terms) with excerpt and tokens; null where no block of the file is named.

    files(rel_path, lang, content).  A block is named if a form of one of its names
    and of a term match, either way round.  A file is parsed once for all questions
    that want it; only files that are wanted are read further.
    """
    asked = files.join(wanted.select("rel_path").distinct(), "rel_path", "left_semi")
    parsed = asked.select("rel_path", "lang", "content", blocks("lang", "content").alias("__b"))
    told = F.transform("__b", lambda b: F.struct(b["label"].alias("label"), b["start"].alias("start"), b["end"].alias("end"), _forms(b["names"]).alias("forms")))
    met = wanted.withColumn("__terms", _forms(F.col("terms"))).join(parsed.withColumn("__b", told), "rel_path")
    shown = met.withColumn("excerpt", _rendered("rel_path", "lang", "content", "__b", "__terms"))
    return shown.select(*wanted.columns, "excerpt", T.token_estimate("excerpt").alias("tokens"))


def shortened(signature: str, most: int = SIGNATURE_TOKENS) -> str:
    """A signature of at most so many tokens: its first lines and a mark for the rest."""
    lines = signature.split("\n")
    sizes = list(accumulate(len(line.encode()) + 1 for line in lines))
    if sizes[-1] - 1 <= 4 * most:
        return signature
    for n in range(len(lines) - 1, 1, -1):
        mark = f"// + {len(lines) - n} more lines (signature truncated)"
        if sizes[n - 1] + len(mark) <= 4 * most:
            return "\n".join([*lines[:n], mark])
    return "\n".join(lines[:2])


@F.pandas_udf(S.StringType())
def _shortened(signatures: pd.Series) -> pd.Series:
    return signatures.map(shortened)


def least_tokens(rel_path: Column, lang: Column, size: Column) -> Column:
    """Tokens that no form of a file of ``size`` bytes or more falls short of, told without reading it."""
    named = F.octet_length(rel_path) + F.octet_length(F.coalesce(lang, F.lit("")))
    head = named + len("// file: \n// lang: \n// representation: ")
    line = F.coalesce(*(F.when(lang == n, min(len(form.format("x")) for form in lines.values()) + 1) for n, lines in parsing.SIGNATURES.items()), F.lit(1))
    cut = named + F.when(named > SIGNATURE_TOKENS, len("// file: \n// lang: ")).otherwise(len("// file: \n// lang: \n// + 1 more lines (signature truncated)"))  # a long path leaves no room for the mark
    note = head + len("structural_note\n// size: 0 lines, 0 bytes\n")
    return F.ceil(F.least(size, head + len("signature\n\n") + line, cut, note) / 4).cast("int")


def forms(files: DataFrame) -> DataFrame:
    """rel_path, signature and note of files(rel_path, lang, content), as they stand in a bundle, and the tokens of all: full, signature_tokens, note_tokens."""
    parsed = parsing.parse(files.select("rel_path", "lang", "content"))
    content = F.coalesce("content", F.lit(""))
    head = F.concat(F.lit("// file: "), "rel_path", F.lit("\n// lang: "), F.coalesce("lang", F.lit("")), F.lit("\n// representation: "))
    listed = lambda name, values: F.when(F.size(values) > 0, F.concat(F.lit(f"// {name}: "), F.array_join(values, ", "), F.lit("\n"))).otherwise("")
    size = F.concat(F.lit("structural_note\n// size: "), T.line_count(content).cast("string"), F.lit(" lines, "), F.octet_length(content).cast("string"), F.lit(" bytes\n"))
    note = F.concat(head, size, listed("symbols", F.transform("symbols", lambda s: s["name"])), listed("imports", F.col("imports")))
    told = parsed.select("rel_path", T.token_estimate(content).alias("full"), note.alias("note"), F.when(F.col("signature") != "", F.concat(head, F.lit("signature\n\n"), "signature")).alias("s"))
    cut = told.select("rel_path", "full", "note", _shortened(F.coalesce("s", "note")).alias("signature"))
    return cut.select("rel_path", "full", "signature", "note", T.token_estimate("signature").alias("signature_tokens"), T.token_estimate("note").alias("note_tokens"))
