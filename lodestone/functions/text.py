"""Text columns: query terms, identifiers, stems, matching, sizes and names.

All are native expressions.  Lengths that guard a rule are bytes
(octet_length), as token budgets are counted in bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query does not search for.
STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "of", "and", "or", "it", "for", "this", "that", "how", "what", "does", "do", "did", "with", "from", "where", "which", "can", "i", "my")
#: Terms that ask for tests, and terms that ask about the logic instead.
TEST_INTENT = ("test", "tests", "testing", "tested", "fixture", "fixtures", "mock", "mocks", "mocking", "mocked", "benchmark", "benchmarks", "coverage", "regression", "regressions", "golden", "prueba", "pruebas", "prueban", "pruebe", "probar", "testear", "testeando", "probando", "cobertura", "regresion", "regresión", "regresiones", "maqueta", "maquetas")
TEST_OVERRIDE = ("penalty", "outrank", "why", "algorithm", "implementation", "logic", "penalizacion", "penalización", "penalizaciones", "superar", "outrankear", "explicación", "explicacion", "lógica", "logica", "algoritmo", "algoritmos", "implementación", "implementacion")
#: Terms that ask for the legacy surface.
LEGACY_INTENT = ("compat", "compatibility", "legacy", "deprecated", "deprecation", "migration", "backwards")
#: Terms that tell what a question wants.
OUTLINE_HINTS = ("outline", "overview", "map", "structure", "files", "estructura", "resumen", "mapa")
BUNDLE_HINTS = ("implement", "build", "fix", "refactor", "review", "add", "arregla", "implementa", "revisa")
REVIEW_HINTS = ("review", "revisa")
#: Names before a bracket that are no calls.
CALL_STOP = ("if", "for", "while", "switch", "return", "func", "function", "def", "class", "var", "const", "type", "len", "cap", "make", "new", "byte", "by", "flow", "fresh", "only", "root", "summary")
#: Patterns of word runs, identifiers, calls and citations.
WORD = "[A-Za-z0-9_]+"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
CALL = r"(?<![0-9A-Za-z_])([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)?)\s*\("
CITATION = r"([A-Za-z0-9_./\-]+\.(?:ts|tsx|js|jsx|mjs|cjs|py|go|md|json|ya?ml))(?::(\d+))?"
EXPAND = r"^(.+):([0-9]+)(?:-([0-9]+))?$"

_BOUNDARY = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[A-Za-z])|_"


def _list(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def identifier_parts(c: Column | str) -> Column:
    """Parts of a camelCase or snake_case identifier, numbers with the letters before them; empty if it has one part."""
    parts = F.filter(F.split(text(c), _BOUNDARY), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def tokenise(c: Column | str) -> Column:
    """Search terms of a query: word runs and their parts, lower-cased, three bytes or more, no stop words, first seen first."""
    runs = extract_all(F.coalesce(text(c), F.lit("")), WORD)
    every = F.flatten(F.transform(runs, lambda w: F.concat(F.array(w), identifier_parts(w))))
    lower = F.transform(every, lambda w: F.lower(w))
    return F.array_distinct(F.filter(lower, lambda w: (F.octet_length(w) >= 3) & ~F.array_contains(_list(STOP_WORDS), w)))


def _drop_end(c: Column, n: int) -> Column:
    return F.substring(c, F.lit(1), F.char_length(c) - n)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that stands in the plan once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def stem(c: Column | str) -> Column:
    """Light English stem: plural endings, then ity, ing or ed; words under four bytes stay as they are."""

    def singular(w: Column) -> Column:
        size = F.octet_length(w)
        ies = F.concat(_drop_end(w, 3), F.lit("y"))
        return F.when(w.endswith("ies") & (size > 4), ies).when(w.endswith("sses"), _drop_end(w, 2)).when(w.endswith("ss"), w).when(w.endswith("s") & (size > 3), _drop_end(w, 1)).otherwise(w)

    def bare(w: Column) -> Column:
        size = F.octet_length(w)
        return F.when(w.endswith("ity") & (size > 4), _drop_end(w, 3)).when(w.endswith("ing") & (size > 5), _drop_end(w, 3)).when(w.endswith("ed") & (size > 4), _drop_end(w, 2)).otherwise(w)

    given = text(c)
    return F.when(F.octet_length(given) < 4, given).otherwise(let(let(F.lower(given), singular), bare))


def variants(c: Column | str) -> Column:
    """A term and its stem."""
    return F.filter(F.array_distinct(F.array(text(c), stem(c))), lambda v: v != "")


def contains_any(haystack: Column, needles: Column) -> Column:
    return F.exists(needles, lambda n: F.contains(haystack, n))


def any_contains(needles: Column, part: Column) -> Column:
    return F.exists(needles, lambda n: F.contains(n, part))


def term_matches(term: Column, where: Column) -> Column:
    """A variant of the term within one of the text, or the other way round; three bytes at least."""
    a, b = F.lower(term), F.lower(F.coalesce(where, F.lit("")))
    long = lambda vs: F.filter(vs, lambda v: F.octet_length(v) >= 3)
    both = F.exists(long(variants(a)), lambda t: F.exists(long(variants(b)), lambda p: F.contains(p, t) | F.contains(t, p)))
    return F.when((a == "") | (b == ""), F.lit(False)).otherwise(both)


def terms_match(terms: Column, where: Column) -> Column:
    return F.exists(terms, lambda t: term_matches(t, where))


def exactly_named(symbol: Column, terms: Column) -> Column:
    """A term equals the symbol or its last dotted part."""
    s = F.lower(F.trim(F.coalesce(symbol, F.lit(""))))
    last = F.when(s.endswith("."), s).otherwise(F.substring_index(s, ".", -1))
    return F.when(s == "", F.lit(False)).otherwise(F.array_contains(terms, s) | F.array_contains(terms, last))


def symbol_weight(symbol: Column, terms: Column, exact: float = 18.0, partial: float = 3.0) -> Column:
    """exact where a variant of a term equals one of the symbol, else partial."""
    own = variants(F.lower(symbol))
    return F.when(F.exists(terms, lambda t: F.arrays_overlap(variants(F.lower(F.trim(t))), own)), exact).otherwise(partial)


def compact(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]", "")


def token_estimate(c: Column | str) -> Column:
    """Four bytes are a token, rounded up."""
    return F.ceil(F.octet_length(text(c)) / 4).cast("int")


def line_count(c: Column | str) -> Column:
    """Line ends, and one more for a last line without one; 0 of an empty text."""
    t = text(c)
    ends = F.char_length(t) - F.char_length(F.replace(t, F.lit("\n")))
    return F.when(t == "", 0).otherwise(ends + F.when(t.endswith("\n"), 0).otherwise(1)).cast("int")


def logical_lines(c: Column | str) -> Column:
    """Lines of a text; a last line end opens no line."""
    return F.split(F.regexp_replace(text(c), r"\n\z", ""), "\n")


def lines_in_range(c: Column | str, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, inclusive) joined again; an end of 0 is the last line."""
    lines = logical_lines(F.replace(text(c), F.lit("\r\n"), F.lit("\n")))
    low = F.greatest(start, F.lit(1))
    high = F.when(end <= 0, F.size(lines)).otherwise(F.least(end, F.size(lines)))
    return F.when(high < low, "").otherwise(F.array_join(F.slice(lines, low, F.greatest(high - low + 1, F.lit(0))), "\n"))


def slug(c: Column | str, longest: int = 40) -> Column:
    s = F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.rtrim(F.substring(s, 1, longest), F.lit("-"))


def cache_name(query: Column, budget: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", budget.cast("string"), query)), 1, 8)


def query_id(c: Column | str) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(text(c))), 256), 1, 12)


def snippet_around(c: Column | str, needle: Column, window: int = 80) -> Column:
    """White space collapsed, up to ``window`` characters on either side of the first match, dots where cut; empty without a match."""
    t = F.trim(F.regexp_replace(text(c), r"[ \t\n\x0B\f\r]+", " "))
    at = F.instr(F.lower(t), F.lower(needle))
    low = F.greatest(at - window, F.lit(1))
    high = F.least(at + F.char_length(needle) - 1 + window, F.char_length(t))
    body = F.substring(t, low, high - low + 1)
    return F.when(at == 0, "").otherwise(F.concat(F.when(low > 1, "…").otherwise(""), body, F.when(high < F.char_length(t), "…").otherwise("")))


def preview(c: Column | str, longest: int) -> Column:
    t = text(c)
    return F.when(F.char_length(t) <= longest, t).otherwise(F.concat(F.substring(t, 1, longest), F.lit("…")))


def human_bytes(c: Column | str, largest: str = "GB") -> Column:
    """B, KB and MB with one decimal, GB with two; sizes beyond ``largest`` stay in it.  Halves go to the even digit, as C and Go print them; Java's formats round them up."""
    n = text(c)
    shown = lambda unit, name, digits=1: F.format_string(f"%.{digits}f {name}", F.bround(n / float(unit), digits))
    out = F.when(n.isNull(), None).when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, shown(1 << 10, "KB"))
    return out.otherwise(shown(1 << 20, "MB")) if largest == "MB" else out.when(n < 1 << 30, shown(1 << 20, "MB")).otherwise(shown(1 << 30, "GB", 2))


def query_words(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores of any alphabet."""
    return F.filter(F.split(F.lower(F.coalesce(text(c), F.lit(""))), r"[^\p{L}\p{Nd}_]+"), lambda w: w != "")


def wants_tests(c: Column | str) -> Column:
    w = query_words(c)
    return ~F.arrays_overlap(w, _list(TEST_OVERRIDE)) & F.arrays_overlap(w, _list(TEST_INTENT))


def wants_legacy(c: Column | str) -> Column:
    return F.arrays_overlap(query_words(c), _list(LEGACY_INTENT))


def intent(c: Column | str) -> Column:
    """outline, review, build or search."""
    w = query_words(c)
    bundle = F.when(F.try_element_at(F.filter(_list(BUNDLE_HINTS), lambda h: F.array_contains(w, h)), F.lit(1)).isin(*REVIEW_HINTS), "review").otherwise("build")
    return F.when(F.trim(F.coalesce(text(c), F.lit(""))) == "", "outline").when(F.arrays_overlap(w, _list(OUTLINE_HINTS)), "outline").when(F.arrays_overlap(w, _list(BUNDLE_HINTS)), bundle).otherwise("search")


def calls_in(c: Column | str) -> Column:
    """Called names, sorted."""
    return F.array_sort(F.array_distinct(F.filter(extract_all(text(c), CALL, 1), lambda x: ~F.array_contains(_list(CALL_STOP), F.lower(x)))))


def citations(c: Column | str) -> Column:
    """Distinct file references path[:line], in the order met."""
    return F.array_distinct(extract_all(text(c), CITATION, 0))


def expand_spec(c: Column | str) -> Column:
    """path, start and end of path:start-end; the whole as path otherwise."""
    t = text(c)
    part = lambda k: F.regexp_extract(t, EXPAND, k)
    found = part(1) != ""
    start = F.when(found, part(2).cast("int"))
    return F.struct(F.when(found, part(1)).otherwise(t).alias("path"), start.alias("start"), F.when(found & (part(3) != ""), part(3).cast("int")).otherwise(start).alias("end"))


def outcome_failed(c: Column | str) -> Column:
    return F.coalesce(text(c).rlike("(?i)fail|error|concerning|regress|broken|reject"), F.lit(False))


def token_kind(c: Column | str) -> Column:
    """path, api, symbol or skip of an identifier met in an answer."""
    t = text(c)
    known = F.lower(t).rlike(r"\.(ts|tsx|js|jsx|mjs|cjs|py|go|md|json|yaml|yml)$")
    dotted = F.contains(t, F.lit(".")) & ~F.exists(F.split(t, r"\."), lambda p: F.octet_length(p) < 2)
    upper, lower = F.regexp_count(t, F.lit("[A-Z]")), F.regexp_count(t, F.lit("[a-z]"))
    code = (F.octet_length(t) >= 4) & (F.contains(t, F.lit("_")) | (upper >= 2) | ((upper > 0) & (lower == 0)) | ((upper == 1) & (lower > 0) & t.rlike("^[a-z]")))
    return F.when(F.contains(t, F.lit("/")) | known, "path").when(dotted, "api").when(code, "symbol").otherwise("skip")


def code_tokens(c: Column | str) -> Column:
    """The distinct identifiers of a text whose kind is api or symbol."""
    # Most words have neither dot, underscore nor capital past their start; one pattern tells them apart before the kind is asked for.
    some = F.filter(extract_all(text(c), IDENTIFIER), lambda t: t.rlike(r"[._]|.[A-Z]|^[A-Z][^a-z]*\z"))
    return F.filter(F.array_distinct(some), lambda t: token_kind(t).isin("api", "symbol"))


def drift_parts(c: Column | str) -> Column:
    """Parts of a dotted, snake_case or camelCase token of three bytes or more."""
    return F.filter(F.split(text(c), r"[_.]|(?<=[a-z])(?=[A-Z])"), lambda p: F.octet_length(p) >= 3)


def fact_pattern(fact: Column) -> Column:
    """A case-insensitive pattern for a fact, at word boundaries where it begins or ends with a word character."""
    quoted = F.regexp_replace(fact, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    before = F.when(fact.rlike("^[0-9A-Za-z_]"), r"(?<![0-9A-Za-z_])").otherwise("")
    after = F.when(fact.rlike(r"[0-9A-Za-z_]\z"), r"(?![0-9A-Za-z_])").otherwise("")
    return F.concat(F.lit("(?i)"), before, quoted, after)
