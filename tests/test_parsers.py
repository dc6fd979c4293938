"""Each language's nodes."""

from __future__ import annotations

import pytest

from nodelake.operators import chunk
from nodelake.parsers import parse, parse_documents


def brief(language, text, *fields):
    return [tuple(n[f] if f in n else n["extra"].get(f) for f in fields) for n in parse(language, text)]


def kinds(language, text):
    return brief(language, text, "node_type", "node_name", "parent_scope")


def test_python():
    text = '@a\n@b(1)\ndef f(x):\n    """Doc é."""\n    def g(): pass\n\nclass C:\n    class Inner:\n        def m(self): ...\n\nimport os, sys\nfrom pathlib import Path\nimport numpy as np\nfrom . import y\nX = 1\nMAX_SIZE = 2\nMy_Var = 3\nz = lambda: 0\n'
    got = kinds("python", text)
    assert got == [
        ("function", "f", None), ("function", "g", None), ("class", "C", None), ("class", "Inner", "C"), ("method", "m", "Inner"), ("import", "os", None), ("import", "sys", None), ("import", "pathlib", None),
        ("constant", "X", None), ("constant", "MAX_SIZE", None)]
    f = parse("python", text)[0]
    assert f["extra"] == {"decorators": "@a,@b(1)", "is_async": "false"} and f["documentation"] == "Doc é." and f["signature"] == "def f(x)" and f["content"].startswith("@a")
    assert kinds("python", "def ok():\n  pass\n\ndef broken(:\n  pass\n\nclass Later:\n  def m(self):\n    pass\n") == [("function", "ok", None), ("function", "broken", None), ("class", "Later", None), ("method", "m", "Later")]
    assert parse("python", "# only a comment\n") == []


def test_javascript():
    text = "export class A { m() { return /[}]/.test(x) } }\nconst s = `}`; // }\nconst RUN = async (a) => { await a };\nlet low = 1;\nfunction* gen() {}\n"
    assert kinds("javascript", text) == [("export", "A", None), ("class", "A", None), ("method", "m", "A"), ("function", "RUN", None), ("constant", "RUN", None), ("function", "gen", None)]
    arrow = next(n for n in parse("javascript", text) if n["node_name"] == "RUN")
    assert arrow["signature"] == "(a) =>" and arrow["extra"] == {"is_async": "true", "is_generator": "false", "is_arrow": "true"}
    assert brief("javascript", "/**\n * One\n * two\n */\nfunction f() {}", "documentation") == [("One\ntwo",)]
    assert brief("javascript", "// no\nfunction f() {}", "documentation") == [(None,)]
    assert kinds("javascript", "export {a, b as c};\nexport default value;\nexport default class {}\n") == [("export", "a, b", None), ("export", "value", None), ("export", "default", None)]
    with pytest.raises(ValueError):
        parse("javascript", "export {}")


def test_typescript():
    text = "class C {\n  @a x = 1;\n  @b() public foo(): void {}\n  protected async bar(a: string): Promise<void> { }\n}\nabstract class D { abstract go(): number }\nexport enum E { A }\n"
    assert kinds("typescript", text) == [("class", "C", None), ("method", "foo", "C"), ("method", "bar", "C"), ("class", "D", None), ("method", "go", "D"), ("export", "default", None), ("enum", "E", None)]
    got = brief("typescript", text, "visibility", "decorators", "is_abstract")
    assert got[1] == ("public", "@a,@b()", "false") and got[2][0] == "protected" and got[3][2] == "true"


def test_typescript_exports_and_decorators():
    text = "export const enum E { A }\nexport const F = 1;\nclass C {\n  @log public open(): void {}\n  @a.b shut(): void {}\n}\n"
    assert kinds("typescript", text) == [("export", "default", None), ("enum", "E", None), ("export", "F", None), ("class", "C", None), ("method", "open", "C"), ("method", "shut", "C")]
    assert brief("typescript", text, "decorators")[4:] == [("@log",), ("@log,@a.b",)]


def test_deep_and_long_texts():
    nodes = parse("html", "<div>" * 6000 + "<h1>x</h1>" + "</div>" * 6000)
    assert [(n["node_type"], n["parent_scope"]) for n in nodes] == [("h1", "div")]
    assert len(parse("markdown", "".join(f"{'#' * (1 + i % 6)} t{i}\n" for i in range(20_000)))) == 20_000
    assert parse("html", "<H1>no</H1><UL><LI>x</UL>") == []


def test_rust():
    text = "//! top\n/// A\n/// B\n#[x]\n#[y]\npub struct S;\n// plain\nfn f() {}\nimpl<T> G<T> { fn m(&self) { let s = \"}\"; } }\nuse std::{a, b};\nuse x::*;\nunsafe trait U { fn no(&self); fn yes(&self) {} }\nconst lower: u8 = 1;\n"
    assert kinds("rust", text) == [("struct", "S", None), ("function", "f", None), ("method", "m", "G<T>"), ("trait", "U", None), ("method", "yes", "U"), ("constant", "lower", None)]
    s = parse("rust", text)[0]
    assert s["documentation"].endswith("A\nB") and s["extra"]["attributes"] == "#[x],#[y]" and s["extra"]["is_pub"] == "true"
    assert brief("rust", text, "documentation")[1] == (None,) and brief("rust", text, "is_unsafe")[3] == ("true",)


def test_html():
    text = '<section id="s"><h2 class="a b">One &amp; the two</h2><table><tr><td>1<td>2<td>3<tr><td>4</table></section><ul><li>x<li>y</ul><ol></ol><script>"<h1>"</script><table></table>'
    got = brief("html", text, "node_type", "node_name", "parent_scope", "rows", "cols", "item_count")
    assert got == [("h2", "one two", "section", None, None, None), ("table", "table", "section", "2", "3", None), ("ul", "ul-list", None, None, None, "2"), ("ol", "ol-list", None, None, None, "0"), ("table", "table", None, "0", "0", None)]
    assert brief("html", text, "class")[0] == ("a b",)
    assert parse("html", "plain text") == []


def test_css():
    text = "/* a{} */\n.x, .y { color: red; background: url('a;b'); }\n@media (min-width: 1px) { .z { top: 0 } }\n@keyframes s { from { a: b } }\n@import 'x.css';\n@charset \"utf-8\";\n@font-face { font-family: q }"
    assert brief("css", text, "node_type", "node_name", "parent_scope", "declaration_count") == [
        ("rule", ".x, .y", None, "2"), ("at-rule", "@media", None, None), ("rule", ".z", "@media", "1"), ("at-rule", "@keyframes s", None, None), ("at-rule", "@import", None, None), ("at-rule", "@charset", None, None),
        ("at-rule", "@font-face", None, None)]


def test_json():
    assert brief("json", '{"a": {"b": {"c": [1, {"d": 2}]}}}', "path") == [("root",), ("root.a",), ("root.a.b",), ("root.a.b.c",), ("root.a.b.c.[1]",)]
    assert parse("json", "3") == [] and parse("json", "") == [] and parse("json", '{"a": }') == []
    assert brief("json", '{"bad": , "good": {"x": 1}}', "path") == [("root.good",)]
    assert len(parse("json", "[[1,2],[3,4]]")) == 3


def test_yaml():
    assert brief("yaml", "servers:\n  - host: é\n    ports: [1, 2]\nflow: {a: 1}\n", "node_type", "path", "parent_scope", "length") == [
        ("mapping", "root", None, None), ("sequence", "root.servers", "root", "1"), ("mapping", "root.servers.[0].[0]", "[0]", None)]
    assert parse("yaml", "") == [] and parse("yaml", "a: [") == []


def test_toml():
    text = 'a = """\n[no]\n"""\nlist = [\n 1,\n 2,\n]\n[x.y] # c\nk = "[z]"\n[["quoted.key"]]\n'
    assert brief("toml", text, "node_type", "node_name", "parent_scope", "pair_count") == [("pair", "a", None, None), ("pair", "list", None, None), ("table", "y", "x", "1"), ("table_array", "key", '"quoted', "0")]


def test_markdown():
    assert kinds("markdown", "# A\n#### B\n## C\n#No\n##\n~~~\n# x\n~~~\n# D #\n") == [("Header 1", "A", None), ("Header 4", "B", "A"), ("Header 2", "C", "A"), ("Header 1", "D", None)]


@pytest.mark.parametrize("language,text", [
    ("python", "# é\ndef f():\n  return 'ü'\n"), ("javascript", "// é\nfunction f() { return 'ü' }\n"), ("rust", "// é\nfn f() { }\n"), ("css", "/* é */ .ü { a: b }"), ("json", '{"é": {"ü": [1]}}'), ("yaml", "é:\n  ü: 1\n"),
    ("toml", 'é = 1\n[ü]\nx = "ö"\n'), ("markdown", "é\n# ü\ntext\n"), ("html", "é<h1>ü</h1>"), ("typescript", "// é\ninterface Ü { a(): void }\n"),
])
def test_contents_are_byte_slices(language, text):
    nodes = parse(language, text)
    assert nodes
    for n in nodes:
        assert text.encode()[n["start_byte"] : n["end_byte"]].decode() == n["content"]
        assert n["start_line"] == text.encode()[: n["start_byte"]].count(b"\n") + 1


def test_errors_are_rows(spark):
    docs = spark.createDataFrame([("a", "javascript", "export {}"), ("b", "json", "{}"), ("c", "text", "x" * 260), ("d", "json", None)], "path string, language string, content string")
    got = sorted((r["path"], r["node_type"], r["error"] is None) for r in parse_documents(docs, ["path"]).collect())
    assert got == [("a", None, False), ("b", "object", True), ("c", "chunk", True), ("c", "chunk", True)]


@pytest.mark.parametrize("text,size,overlap,expected", [
    ("x" * 13, 100, 10, [(0, 13)]), ("abcdefghijABCDEFGHIJ", 10, 3, [(0, 10), (7, 17), (14, 20)]), (" " * 10, 10, 2, [(0, 10), (8, 10)]), ("abc", 2, 5, [(0, 2), (1, 3), (2, 3)]), ("", 10, 2, []), (None, 10, 2, []), ("é漢\U0001f600a", 2, 0, [(0, 2), (2, 4)]),
])
def test_chunks(spark, text, size, overlap, expected):
    got = chunk.chunks(spark.createDataFrame([(text,)], "content string"), size, overlap).orderBy("ordinal").collect()
    assert [(r["start_byte"], r["end_byte"]) for r in got] == expected
    assert all(r["content"] == text[r["start_byte"] : r["end_byte"]] for r in got)


def test_chunk_lines(spark):
    text = "\n".join(f"line {i}" for i in range(9000))
    for r in chunk.chunks(spark.createDataFrame([(text,)], "content string"), 20, 5).collect():
        assert (r["start_line"], r["end_line"]) == (text[: r["start_byte"]].count("\n") + 1, text[: r["end_byte"]].count("\n") + 1)
