"""The scanner, parsers, chunks and excerpts on small sources."""

import time

import pytest

from lodestone.operators import excerpts, parsing
from lodestone.operators.scanner import Scan


@pytest.mark.parametrize(
    ("lang", "text", "code"),
    [
        ("typescript", "a = /[/{]/g; b = c / d; // {", "a = ; b = c / d;"),
        ("typescript", "x = `a ${f(`}`)} }` + '}'", "x = f( ) +"),
        ("typescript", "return /}/ + it's\n}", "return + it }"),
        ("typescript", "a /* x */ / 2 /* } */ / 3", "a / 2 / 3"),
        ("python", 's = """a\n# b\'\'\' """ # c\nx = \'#\'', "s = x ="),
        ("go", "a := `x\n\"` + '{' + \"\\\"}\" // `", "a := + +"),
        ("rust", "fn f<'a>(x: &'a str) { r#\"}\"# ; '}' }", "fn f<'a>(x: &'a str) { ; }"),
        ("java", 'x = """\n } "quoted" """;', "x = ;"),
        (None, "it's {", "it's {"),
    ],
)
def test_scanner_blanks_all_but_code(lang, text, code):
    scan = Scan(text, lang)
    assert scan.code.split() == code.split() and scan.code.count("\n") == text.count("\n")
    assert len(scan.code) == len(scan.uncommented) == len(scan.filled) == len(text)


def test_depth_and_pairs():
    scan = Scan("f(a, {b: [1]}) { '}' }", "javascript")
    assert scan.pair == {1: 13, 5: 12, 9: 11, 15: 21} and scan.balanced
    assert [scan.depth(k) for k in (0, 2, 6, 10, 14, 17, 22)] == [0, 1, 2, 3, 0, 1, 0]
    assert not Scan("f(]", "go").balanced and not Scan("{", "go").balanced
    assert scan.body_end(0) == 12 and Scan("a; {", "go").body_end(0) == 1 and Scan("a", "go").body_end(0) is None


@pytest.mark.parametrize("text", ["(" * 200_000 + "]" * 200_000, "${`" * 60_000, "/" * 100_000, "'" * 100_001, "{" * 100_000 + "}" * 100_000, "export class A {\n" + "  m() {}\n" * 8000 + "}\n"])
def test_scanner_and_parser_take_linear_time(text):
    began = time.time()
    parsing.symbols_of("typescript", text)
    assert time.time() - began < 8


def test_script_symbols():
    text = 'export default function App() {}\nexport default Widget\nexport const [a] = 1\nexport type T = {}\nasync function go() {}\n// class No {}\nconst s = `\nclass Neither {}\n`\n'
    assert parsing.symbols_of("typescript", text) == [("T", "export_type", 4), ("App", "export_default", 1), ("Widget", "export_default", 2), ("go", "func", 5)]
    body = "abstract class Box<T> extends Base {\n  get size() { return 1 }\n  set size(n) {}\n  private load = async (x) => {\n    if (x) { y() }\n  }\n  static of<T>(x = /}/) {\n    return call(x)\n  }\n  constructor() { super() }\n}\n"
    assert parsing.symbols_of("javascript", body) == [("Box.size", "get", 2), ("Box.size", "set", 3), ("Box.load", "method", 4), ("Box.of", "method", 7), ("Box.constructor", "method", 10)]


def test_python_symbols():
    text = 'class A:\n    """x\n\n    def ghost(): pass\n    """\n    def f(self):\n        def inner(): pass\n        class B:\n            def g(self): pass\nasync def top(): pass\n'
    assert parsing.symbols_of("python", text) == [("A", "class", 1), ("A.f", "method", 6), ("B", "class", 8), ("B.g", "method", 9), ("top", "func", 10)]


GO = """package p

import (
	"fmt" // "not this"
	x "a/b"
)

// T is
// a type.
type T struct {
	Name, Other string `json:"name"`
	Embedded
	fn   func(a int) struct{ inner int }
}

type (
	Reader interface {
		Read(p []byte) (int, error)
		io.Closer
	}
	ID = string
)

func (t *T[K]) Run(m map[string]struct{}) interface{} {
	return func() { _ = "}" }
}

func (T) Stop() {}

func Map[A interface{ ~int }](a A) (b struct{ c int }, err error) {
	return
}

func external(a int) int

/* one */
const One = 1

const (
	// Two
	// is two
	Two = iota +
		1
	Three, Four = `a
b`, 4 // trailing

	_ = "x"
)
"""


def test_go_symbols_and_chunks():
    assert parsing.imports_of("go", GO) == ["fmt", "a/b"]
    names = [(n, k) for n, k, _ in parsing.symbols_of("go", GO)]
    assert names == [("Run", "func"), ("Stop", "func"), ("Map", "func"), ("external", "func"), ("T", "type"), ("One", "const"), ("Reader", "type"), ("ID", "type"), ("Two", "const"), ("Three", "const"), ("Four", "const")]
    got = [(c.kind, c.symbol, c.start, c.end, c.parent) for c in parsing.chunks_of("go", "x/p.go", GO)]
    assert got == [
        ("type", "T", 8, 14, None), ("type", "Reader", 17, 20, None), ("type", "ID", 21, 21, None), ("method", "T.Run", 24, 26, "type-t"), ("method", "T.Stop", 28, 28, "type-t"),
        ("func", "Map", 30, 32, None), ("func", "external", 34, 34, None), ("const", "One", 36, 37, None), ("const", "Two", 40, 43, None), ("const", "Three,Four", 44, 45, None), ("const", "_", 47, 47, None),
    ]
    inner = {d.names[0]: d.inner for d in parsing.go_declarations(parsing.Source("go", GO)) if d.inner}
    assert inner == {"T": ["Name", "Other", "fn"], "Reader": ["Read"]}
    broken = parsing.chunks_of("go", "d/b.go", "package p\nfunc f() {\n")
    assert [(c.kind, c.symbol, c.chunk_id, c.end) for c in broken] == [("file", "b.go", "file-b.go", 2)]


def test_script_chunks_and_closures():
    pad = "  // line\n" * 45
    text = f"export class A {{\n  x = 1\n\n  // about f\n  @deco\n  f() {{\n    return '}}'\n  }}\n}}\n\nexport function big(o) {{\n{pad}  const one: F<X> = async (a) => {{\n    const deep = () => 1\n    return a\n  }}\n  async function two(b) {{ }}\n  let big = function () {{ }}\n}}\nconst t = 1\nfunction big2() {{}}\n"
    got = {(c.kind, c.symbol, c.start, c.end, c.parent) for c in parsing.chunks_of("typescript", "a.ts", text)}
    assert got == {
        ("export_class", "A", 1, 2, None), ("method", "A.f", 6, 8, "export_class-a"), ("export_func", "big", 11, 63, None),
        ("nested_func", "big.one", 57, 60, "export_func-big"), ("nested_func", "big.two", 61, 61, "export_func-big"), ("func", "big2", 65, 65, None),
    }


def test_closures_belong_to_the_innermost_function_and_are_limited():
    many = "".join(f"  const f{k} = () => {{ }}\n" for k in range(100))
    text = f"function outer() {{\n{many}}}\n"
    got = [c for c in parsing.chunks_of("javascript", "a.js", text) if c.kind == "nested_func"]
    assert len(got) == parsing.CLOSURES_EACH and got[-1].symbol == "outer.f79"
    swallowed = "let loose = function\n" + "function big() {\n" + "  const a = () => { }\n" + "  // x\n" * 45 + "}\n"
    got = [(c.symbol, c.start) for c in parsing.chunks_of("javascript", "a.js", "export " + swallowed) if c.kind == "nested_func"]
    assert got == [("big.a", 3)]


def test_closures_of_a_table_are_whole(spark):
    many = "".join(f"  const f{k} = () => {{ }}\n" for k in range(250))
    files = spark.createDataFrame([("a.js", "javascript", f"function outer() {{\n{many}}}\n")], "rel_path string, lang string, content string")
    want = {(f"outer.f{k}", k + 2) for k in range(250)}
    assert {(r.symbol, r.start_line) for r in parsing.nested_closures(files).collect()} == want
    assert {(r.symbol, r.start_line) for r in parsing.code_chunks(files).where("kind = 'nested_func'").collect()} == want


def test_python_chunks_keep_strings_and_leave_decorators():
    text = 'class C:\n    """doc"""\n\n    flag = False\n\n    @property\n    def meta(self):\n        return """\nnot: the end\n"""\n\n# about g\n@wraps\ndef g():\n    pass\n'
    got = [(c.kind, c.symbol, c.start, c.end, c.parent) for c in parsing.chunks_of("python", "c.py", text)]
    assert got == [("class", "C", 1, 4, None), ("method", "C.meta", 7, 10, "class-c"), ("func", "g", 14, 15, None)]


def test_sections_and_whole_files():
    got = [(c.kind, c.symbol, c.start, c.end, c.chunk_id) for c in parsing.chunks_of("markdown", "a.md", "in\n\n# T\nx\n## T\ny\n#### no\n")]
    assert got == [("section", "preamble", 1, 2, "section-preamble"), ("section", "T", 3, 4, "section-t"), ("section", "T", 5, 7, "section-t-2")]
    assert [(c.kind, c.symbol, c.end) for c in parsing.chunks_of("markdown", "d/n.md", "a\nb\n")] == [("file", "n.md", 2)]
    assert [(c.kind, c.end) for c in parsing.chunks_of(None, "x", "")] == [("file", 1)]
    assert parsing.signature_of("json", "{\n}") == "// json file, 2 lines\n"
    assert parsing.signature_of("python", "import os\nclass A:\n    def f(self): pass\n") == "# import: os\nclass A: ...\n  def A.f(...): ...\n"


def excerpt(spark, lang, text, *terms):
    files = spark.createDataFrame([("d/f", lang, text)], "rel_path string, lang string, content string")
    wanted = spark.createDataFrame([(1, "d/f", list(terms))], "query_id long, rel_path string, terms array<string>")
    return excerpts.symbol_excerpts(wanted, files).first().excerpt


def test_excerpt_of_scripts(spark):
    text = "import x from 'y'\n\nexport function renderTree(a) {\n  return a\n}\n\nfunction other() {\n  return '}'\n}\n\nexport const auth = 1;\n\nclass Login {\n  go() {\n  }\n}\n"
    got = excerpt(spark, "typescript", text, "rendering", "authentication")
    head = "// file: d/f\n// lang: typescript\n// representation: excerpt\n\n"
    assert got == head + "// ... 2 lines omitted from start ...\n\n// ── d/f:3-5 (renderTree) ──\nexport function renderTree(a) {\n  return a\n}\n\n// ... 5 lines omitted ...\n\n// ── d/f:11-11 (auth) ──\nexport const auth = 1;\n\n// ... 6 lines omitted to end ...\n"
    assert excerpt(spark, "typescript", text, "nothing") is None and excerpt(spark, "typescript", text) is None
    assert excerpt(spark, "rust", "fn render() {}", "render") is None and excerpt(spark, "typescript", None, "x") is None
    assert "(Login, Login.go)" in excerpt(spark, "typescript", text, "login")


def test_excerpt_of_go(spark):
    long = "package p\n\n// Doc of Pack.\nfunc Pack(a int) {\n" + "".join(f"\tstep({k})\n" for k in range(60)) + "}\n\ntype Options struct {\n\tUpgradeWithSlack bool\n}\n\nconst (\n\tA = 1\n\t// about Beta\n\tBetaValue = 2\n\tC = 3\n)\n"
    got = excerpt(spark, "go", long, "packing")
    assert "// ── d/f:3-65 (func Pack) ──\n// Doc of Pack.\nfunc Pack(a int) {\n\tstep(0)" in got and "\tstep(5)\n// ... 51 lines elided in extracted excerpt ...\n\tstep(57)\n" in got and "step(6)" not in got
    assert "// ── d/f:67-69 (type Options) ──" in excerpt(spark, "go", long, "slack")
    assert "// ── d/f:73-74 (const BetaValue) ──\n\t// about Beta\n\tBetaValue = 2\n" in excerpt(spark, "go", long, "betavalue")
    assert excerpts.joined([(5, 9, "b"), (1, 3, "a"), (12, 12, "c")], 2) == [(1, 9, "a, b"), (12, 12, "c")]
    assert excerpts.joined([(5, 9, "b"), (1, 4, "a")], 0) == [(1, 4, "a"), (5, 9, "b")]
