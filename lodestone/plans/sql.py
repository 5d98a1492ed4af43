"""SQL fragments shared by the oracle queries."""

from __future__ import annotations

from ..functions.text import STOP_WORDS


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def parts(w: str) -> str:
    spaced = f"regexp_replace(regexp_replace(regexp_replace(replace({w}, '_', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')"
    return f"list_filter(string_split({spaced}, ' '), lambda p: p <> '')"


def ordered_distinct(values: str, name: str = "z") -> str:
    return f"list_filter({values}, lambda {name}, {name}i: list_position({values}, {name}) = {name}i)"


def tokens(c: str) -> str:
    """All tokens of a text, with repeats."""
    every = f"flatten(list_transform(regexp_extract_all({c}, '[A-Za-z0-9_]+'), lambda w: list_concat([w], CASE WHEN len({parts('w')}) > 1 THEN {parts('w')} ELSE [] END)))"
    return f"list_filter(list_transform({every}, lambda t: lower(t)), lambda t: strlen(t) >= 3 AND t NOT IN ({quoted(STOP_WORDS)}))"


def stem(w: str) -> str:
    w = f"lower({w})"
    one = f"CASE WHEN {w} LIKE '%ies' AND strlen({w}) > 4 THEN left({w}, length({w}) - 3) || 'y' WHEN {w} LIKE '%sses' THEN left({w}, length({w}) - 2) WHEN {w} LIKE '%ss' THEN {w} WHEN {w} LIKE '%s' AND strlen({w}) > 3 THEN left({w}, length({w}) - 1) ELSE {w} END"
    one = f"({one})"
    two = f"CASE WHEN {one} LIKE '%ity' AND strlen({one}) > 4 THEN left({one}, length({one}) - 3) WHEN {one} LIKE '%ing' AND strlen({one}) > 5 THEN left({one}, length({one}) - 3) WHEN {one} LIKE '%ed' AND strlen({one}) > 4 THEN left({one}, length({one}) - 2) ELSE {one} END"
    return f"CASE WHEN strlen({w}) < 4 THEN {w} ELSE ({two}) END"


#: Documents as files: the language gives the extension.
FILES = """files AS (
  SELECT doc_id, source || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.ts' WHEN 'de' THEN '.go' WHEN 'es' THEN '.md' ELSE '.txt' END AS rel_path,
         CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'typescript' WHEN 'de' THEN 'go' WHEN 'es' THEN 'markdown' END AS lang, text AS content
  FROM documents
)"""
#: Their non-blank lines as chunks.
CHUNKS = f"""{FILES}, lines AS (
  SELECT doc_id, rel_path, lang, unnest(string_split(content, chr(10))) AS content, generate_subscripts(string_split(content, chr(10)), 1) AS start_line FROM files
), chunks AS (
  SELECT doc_id, rel_path, lang, start_line, content, regexp_extract(content, '[A-Za-z0-9_]+') AS symbol, CAST(ceil(strlen(content) / 4.0) AS INTEGER) AS token_estimate
  FROM lines WHERE trim(content, ' ') <> ''
)"""
#: Search terms of the benchmark's questions, with their forms.
TERMS = f"""asked AS (
  SELECT item_id, {tokens("text")} AS l FROM benchmark
), terms AS (
  SELECT DISTINCT item_id, unnest(l) AS term FROM asked
), stems AS (
  SELECT term, {stem("term")} AS st FROM (SELECT DISTINCT term FROM terms)
), forms AS (
  SELECT DISTINCT item_id, term, form FROM (
    SELECT item_id, term, term AS form FROM terms
    UNION ALL SELECT t.item_id, t.term, s.st FROM terms t JOIN stems s USING (term)
  ) WHERE strlen(form) >= 3
)"""
