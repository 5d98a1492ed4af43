"""Source files made from documents, by Spark and by SQL from one template.

Each language has a list of segments of whole lines; words and text of the document
fill the places.  The template says which segments make up a chunk or a block and
where a symbol stands, so SQL tells what a parser has to find without parsing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import parsing
from ..session import spread, whole_texts
from .registry import Tables

#: Places in a template: the first four words of a-z, the text without signs of code, the text.
WORDS, UNCODED = "[a-z]{3,12}", r"""["'\\`*#/]"""


@dataclass(frozen=True)
class Segment:
    """Lines, and the symbols (name, kind) on its first one."""

    text: str
    symbols: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Part:
    """Segments first to last: a chunk (kind, symbol and its parent's kind and symbol) or a block (symbol is its label)."""

    first: int
    last: int
    symbol: str
    kind: str = ""
    parent: tuple[str, str] | None = None


@dataclass(frozen=True)
class Template:
    segments: tuple[Segment, ...]
    chunks: tuple[Part, ...]
    imports: tuple[str, ...] = ()
    asked: tuple[str, ...] = ()
    blocks: tuple[Part, ...] = ()
    #: In which order the symbols are listed.
    order: tuple[int, ...] = ()


_A = "{a}_alpha"
TEMPLATES = {
    "python": Template(
        (
            Segment("import {a}_lib\nfrom {b}_lib import x\n\n\n"),
            Segment("class {a}_alpha:\n", ((_A, "class"),)),
            Segment('    """{clean}\n\n    def phantom_{a}():\n        pass\n    """\n\n    size = 3\n'),
            Segment("\n    @property\n"),
            Segment('    def {b}_beta(self):\n        def inner():\n            return "){"\n        return inner\n', ((f"{_A}.{{b}}_beta", "method"),)),
            Segment("\n"),
            Segment('    async def {c}_gamma(self, x):\n        return """\ndef ghost():\n    pass\n"""\n', ((f"{_A}.{{c}}_gamma", "method"),)),
            Segment("\n\n"),
            Segment("def {d}_delta(x):\n    return x  # def no():\n", (("{d}_delta", "func"),)),
        ),
        (Part(1, 2, _A, "class"), Part(4, 4, f"{_A}.{{b}}_beta", "method", ("class", _A)), Part(6, 6, f"{_A}.{{c}}_gamma", "method", ("class", _A)), Part(8, 8, "{d}_delta", "func")),
        ("{a}_lib", "{b}_lib"),
        ("{b}_beta", "{c}_gamma"),
        (Part(4, 7, f"{_A}.{{b}}_beta, {_A}.{{c}}_gamma"),),
        (0, 1, 2, 3),
    ),
    "typescript": Template(
        (
            Segment('import { x } from "./{a}_lib";\nconst y = require("{b}_lib");\n\n/* {clean} */\n'),
            Segment("export class {a}_alpha {\n  size = /[{]/;\n", ((_A, "export_class"),)),
            Segment("\n  // does it\n"),
            Segment('  {b}_beta(x = "}") {\n    return `${x} }`;\n  }\n', ((f"{_A}.{{b}}_beta", "method"),)),
            Segment("\n"),
            Segment("  get {c}_gamma() { return 1; }\n", ((f"{_A}.{{c}}_gamma", "get"),)),
            Segment("}\n\n"),
            Segment("export default function {d}_delta(a) {\n  return a / 2; // }\n}\n", (("{d}_delta", "export_default"),)),
            Segment("\n"),
            Segment("export function {a}_omega() {\n" + "  // a line of many\n" * 40, (("{a}_omega", "export_func"),)),
            Segment("  const {b}_iota = (x) => {\n    return x;\n  };\n"),
            Segment("  function {c}_kappa(y) {\n    const inner = (z) => z;\n    return y;\n  }\n"),
            Segment("  return 1;\n}\n"),
        ),
        (
            Part(1, 1, _A, "export_class"), Part(3, 3, f"{_A}.{{b}}_beta", "method", ("export_class", _A)), Part(5, 5, f"{_A}.{{c}}_gamma", "get", ("export_class", _A)), Part(7, 7, "{d}_delta", "export_default"),
            Part(9, 12, "{a}_omega", "export_func"), Part(10, 10, "{a}_omega.{b}_iota", "nested_func", ("export_func", "{a}_omega")), Part(11, 11, "{a}_omega.{c}_kappa", "nested_func", ("export_func", "{a}_omega")),
        ),
        ("./{a}_lib", "{b}_lib"),
        ("{c}_gamma", "{d}_delta"),
        (Part(5, 5, f"{_A}.{{c}}_gamma"), Part(7, 7, "{d}_delta")),
        (4, 0, 3, 1, 2),
    ),
    "go": Template(
        (
            Segment('package {a}\n\nimport (\n\t"fmt"\n\t"{b}/lib"\n)\n\n'),
            Segment("/* {clean} */\n"),
            Segment("type {a}_alpha struct {\n\t{b}_beta int // field\n\tc, {c}_gamma string\n}\n", ((_A, "type"),)),
            Segment("\n"),
            Segment("// {d}_delta runs.\n"),
            Segment('func (s *{a}_alpha) {d}_delta(m map[string]struct{}) (interface{}, error) {\n\treturn "}", nil\n}\n', (("{d}_delta", "func"),)),
            Segment("\n"),
            Segment("func ({a}_alpha) {a}_omega() {}\n", (("{a}_omega", "func"),)),
            Segment("\n// group\nconst (\n"),
            Segment("\t// first\n"),
            Segment("\t{b}_iota = `\n{raw\n`\n", (("{b}_iota", "const"),)),
            Segment("\t{c}_kappa = 1 +\n\t\t2\n", (("{c}_kappa", "const"),)),
            Segment(")\n\n"),
            Segment("var {d}_lambda = 3\n", (("{d}_lambda", "var"),)),
        ),
        (
            Part(1, 2, _A, "type"), Part(4, 5, f"{_A}.{{d}}_delta", "method", ("type", _A)), Part(7, 7, f"{_A}.{{a}}_omega", "method", ("type", _A)),
            Part(9, 10, "{b}_iota", "const"), Part(11, 11, "{c}_kappa", "const"), Part(13, 13, "{d}_lambda", "var"),
        ),
        ("fmt", "{b}/lib"),
        ("{c}_gamma", "{b}_iota"),
        (Part(1, 2, f"type {_A}"), Part(9, 10, "const {b}_iota")),
        (1, 2, 0, 5, 3, 4),
    ),
    "markdown": Template(
        (Segment("{clean}\n\n"), Segment("# {a} alpha\n\nOf {b}.\n", (("{a} alpha", "h1"),)), Segment("## {c} gamma\n{clean}\n", (("{c} gamma", "h2"),))),
        (Part(0, 0, "preamble", "section"), Part(1, 1, "{a} alpha", "section"), Part(2, 2, "{c} gamma", "section")),
        order=(0, 1),
    ),
    "": Template((Segment("{text}\n"),), (Part(0, 0, "{name}", "file"),)),
}

_PLACE = re.compile(r"\{([abcd]|clean|text|name)\}")


def _filled(template: str, **places: Column) -> Column:
    parts = _PLACE.split(template)
    return F.concat(F.lit(""), *(places[p] if k % 2 else F.lit(p) for k, p in enumerate(parts) if p))


def filled_sql(template: str) -> str:
    """A template in SQL, over the columns of ``docs``."""
    parts = _PLACE.split(template)
    quoted = lambda s: " || chr(10) || ".join(f"'{x.replace(chr(39), chr(39) * 2)}'" for x in s.split("\n"))
    return " || ".join(p if k % 2 else f"({quoted(p)})" for k, p in enumerate(parts) if p) or "''"


def source_files(t: Tables, *, dealt: bool = False, only: DataFrame | None = None) -> DataFrame:
    """rel_path, lang, content and asked (terms of a question about the file) of every document.

    ``dealt`` documents go first into parts of about 5,000, however few files they come
    in; with ``only``(rel_path) no other file is made.
    """
    whole_texts(t.spark)
    text = F.coalesce("text", F.lit(""))
    # The words before are possessed, so that none is given back; a text is read no further than its fourth word.
    word = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, rf"(?s)\A(?>.*?{WORDS}+){{{k}}}.*?({WORDS})", 1), F.lit("")), F.lit("none"))
    ending = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".ts").when(F.col("lang") == "de", ".go").when(F.col("lang") == "es", ".md").otherwise(".txt")
    name = F.concat(F.col("doc_id").cast("string"), ending)
    places = {"a": word(0), "b": word(1), "c": word(2), "d": word(3), "clean": F.regexp_replace(text, UNCODED, " "), "text": text, "name": name}
    documents = t.documents.select("doc_id", "text", "lang", "source")
    documents = spread(documents, "doc_id", rows=5_000) if dealt else documents
    if only is not None:
        documents = documents.withColumn("__path", F.concat("source", F.lit("/"), name)).join(only.select(F.col("rel_path").alias("__path")), "__path", "left_semi")
    files = documents.select(F.concat("source", F.lit("/"), name).alias("rel_path"), *(c.alias(f"__{p}") for p, c in places.items())).withColumn("lang", P.language(F.col("rel_path")))
    held = {p: F.col(f"__{p}") for p in places}
    by = lambda of: F.coalesce(*(F.when(F.coalesce("lang", F.lit("")) == lang, of(x)) for lang, x in TEMPLATES.items()))
    content = by(lambda x: _filled("".join(s.text for s in x.segments), **held))
    asked = by(lambda x: F.array(*(_filled(a, **held) for a in x.asked)).cast("array<string>"))
    return files.select("rel_path", "lang", content.alias("content"), asked.alias("asked"))


def source_sizes(t: Tables) -> DataFrame:
    """rel_path, lang and size of every file: bytes that it has at least, by its template and the length of its document; no text is filled in."""
    ending = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".ts").when(F.col("lang") == "de", ".go").when(F.col("lang") == "es", ".md").otherwise(".txt")
    held = F.coalesce(F.octet_length("text"), F.lit(0))
    files = t.documents.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ending).alias("rel_path"), held.alias("__held")).withColumn("lang", P.language(F.col("rel_path")))

    def least(x: Template) -> Column:
        parts = _PLACE.split("".join(s.text for s in x.segments))
        places = parts[1::2]
        return F.col("__held") * sum(p in ("clean", "text") for p in places) + len("".join(parts[::2]).encode()) + 3 * sum(p in "abcd" for p in places)

    return files.select("rel_path", "lang", F.coalesce(*(F.when(F.coalesce("lang", F.lit("")) == lang, least(x)) for lang, x in TEMPLATES.items())).alias("size"))


def _rows(of) -> str:
    """One SELECT for each thing that ``of`` lists of a template."""
    return "\n  UNION ALL ".join(f"SELECT rel_path, {row} FROM docs WHERE lang = '{lang}'" for lang, x in TEMPLATES.items() for row in of(x))


def _id(kind: str, symbol: str) -> str:
    return f"regexp_replace(lower('{kind}-' || {filled_sql(symbol)}), '[^a-z0-9._-]+', '-', 'g')"


_CODED = UNCODED.replace("'", "''")
#: The documents, the segments with the lines they take, and what the templates say of them.
SOURCES_SQL = f"""docs AS (
  SELECT source || '/' || name AS rel_path, * FROM (
    SELECT source, doc_id, doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.ts' WHEN 'de' THEN '.go' WHEN 'es' THEN '.md' ELSE '.txt' END AS name,
      CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'typescript' WHEN 'de' THEN 'go' WHEN 'es' THEN 'markdown' ELSE '' END AS lang,
      coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '{_CODED}', ' ', 'g') AS clean, {", ".join(f"coalesce(regexp_extract_all(coalesce(text, ''), '{WORDS}')[{k}], 'none') AS {c}" for k, c in enumerate("abcd", 1))}
    FROM documents)
), raw AS (
  {_rows(lambda x: [f"{k} AS k, {filled_sql(s.text)} AS seg" for k, s in enumerate(x.segments)])}
), segments AS (
  SELECT *, length(seg) - length(replace(seg, chr(10), '')) AS n, CAST(sum(length(seg) - length(replace(seg, chr(10), ''))) OVER (PARTITION BY rel_path ORDER BY k) AS BIGINT) AS last FROM raw
)"""
SYMBOLS_SQL = f"""symbols AS (
  {_rows(lambda x: [f"{k} AS k, {filled_sql(name)} AS name, '{kind}' AS kind" for k, s in enumerate(x.segments) for name, kind in s.symbols])}
), imports AS (
  {_rows(lambda x: [f"{filled_sql(i)} AS imp" for i in x.imports])}
)"""
CHUNKS_SQL = f"""parts AS (
  {_rows(lambda x: [f"{c.first} AS first, {c.last} AS last, '{c.kind}' AS kind, {filled_sql(c.symbol)} AS symbol, {_id(c.kind, c.symbol)} AS chunk_id, {_id(*c.parent) if c.parent else 'CAST(NULL AS VARCHAR)'} AS parent_id" for c in x.chunks])}
), chunks AS (
  SELECT p.rel_path, p.kind, p.symbol, p.chunk_id, p.parent_id, CAST(min(s.last - s.n + 1) AS INTEGER) AS start_line, CAST(max(s.last) AS INTEGER) AS end_line, regexp_replace(string_agg(s.seg, '' ORDER BY s.k), chr(10) || '$', '') AS content
  FROM parts p JOIN segments s ON s.rel_path = p.rel_path AND s.k BETWEEN p.first AND p.last GROUP BY ALL
)"""


def _listed(values: list[str]) -> str:
    every = f"[{', '.join(values)}]"
    return f"list_filter({every}, lambda x, i: list_position({every}, x) = i)" if values else "CAST([] AS VARCHAR[])"


def _forms(lang: str, x: Template) -> str:
    symbols = [(name, kind) for s in x.segments for name, kind in s.symbols]
    told = [symbols[k] for k in x.order]
    lines = "".join(parsing.SIGNATURES[lang][kind].format(name) + "\n" for name, kind in told) if lang else ""
    imports = _listed([filled_sql(i) for i in x.imports])
    prefix = parsing.SIGNATURES[lang]["import"].format("") if x.imports else ""
    return f"{imports} AS imports, [{', '.join(filled_sql(n) for n, _ in told)}] AS names, array_to_string(list_transform({imports}, lambda i: '{prefix}' || i || chr(10)), '') || {filled_sql(lines)} AS signature"


#: The forms of every file and their tokens.
FORMS_SQL = f"""offered AS (
  {" UNION ALL ".join(f"SELECT rel_path, lang, {_forms(lang, x)} FROM docs WHERE lang = '{lang}'" for lang, x in TEMPLATES.items())}
), wholes AS (
  SELECT rel_path, string_agg(seg, '' ORDER BY k) AS content FROM segments GROUP BY rel_path
), noted AS (
  SELECT o.rel_path, strlen(w.content) AS full_bytes, '// file: ' || o.rel_path || chr(10) || '// lang: ' || o.lang || chr(10) || '// representation: ' AS head, o.signature,
    '// size: ' || (length(w.content) - length(replace(w.content, chr(10), ''))) || ' lines, ' || strlen(w.content) || ' bytes' || chr(10)
    || CASE WHEN len(o.names) > 0 THEN '// symbols: ' || array_to_string(o.names, ', ') || chr(10) ELSE '' END || CASE WHEN len(o.imports) > 0 THEN '// imports: ' || array_to_string(o.imports, ', ') || chr(10) ELSE '' END AS told
  FROM offered o JOIN wholes w USING (rel_path)
), file_forms AS (
  SELECT rel_path, CAST(ceil(full_bytes / 4.0) AS INTEGER) AS full_, CAST(ceil(strlen(head || CASE WHEN signature = '' THEN 'structural_note' || chr(10) || told ELSE 'signature' || chr(10) || chr(10) || signature END) / 4.0) AS INTEGER) AS sig, CAST(ceil(strlen(head || 'structural_note' || chr(10) || told) / 4.0) AS INTEGER) AS note FROM noted
)"""
BLOCKS_SQL = f"""shown AS (
  {_rows(lambda x: [f"{b.first} AS first, {b.last} AS last, {filled_sql(b.symbol)} AS label" for b in x.blocks])}
), blocks AS (
  SELECT b.rel_path, b.label, min(s.last - s.n + 1) AS start, max(s.last) AS last, string_agg(s.seg, '' ORDER BY s.k) AS body
  FROM shown b JOIN segments s ON s.rel_path = b.rel_path AND s.k BETWEEN b.first AND b.last GROUP BY ALL
)"""
