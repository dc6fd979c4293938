"""Source texts made from the rows of a table, and the nodes that parsing them must give."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Case:
    """``{k}``, ``{n}`` and ``{l}`` stand for a row's key, its name and that in lower case, in the text and in what is expected:
    type, name, scope, signature, first and last line, content, documentation, extra (``key=value``, by key)."""

    text: str
    expected: tuple[tuple[str, str, str, str, int, int, str, str, str], ...]

    def source(self, key: Column, name: Column) -> Column:
        return F.replace(F.replace(F.lit(self.text), F.lit("{k}"), key.cast("string")), F.lit("{n}"), name)

    def sql(self, table: str, key: str, name: str, number: int) -> str:
        def text(x: str) -> str:
            return f"replace(replace(replace('{x.replace(chr(39), chr(39) * 2)}', '{{k}}', CAST({key} AS VARCHAR)), '{{n}}', {name}), '{{l}}', lower({name}))"

        parts = []
        for i, (*strings, first, last, content, doc, extra) in enumerate(self.expected):
            names = ", ".join(f"{text(x)} AS {n}" for x, n in zip((*strings, content, doc, extra), ("node_type", "node_name", "parent_scope", "signature", "content", "documentation", "extra")))
            at = f"strpos({text(self.text)}, {text(content)}) - 1"
            parts.append(f"SELECT CAST({key} AS BIGINT) AS k, CAST({number} AS INT) AS case_no, CAST({i} AS BIGINT) AS ordinal, {names}, CAST({first} AS BIGINT) AS start_line, CAST({last} AS BIGINT) AS end_line, CAST({at} AS BIGINT) AS start_byte, CAST({at} + strlen({text(content)}) AS BIGINT) AS end_byte FROM {table}")
        return " UNION ALL ".join(parts)


CASES = {
    "markdown": (
        Case('# {n}\n\ntext {k}\n\n## Part {k}\n\n```\n# no heading\n```\n# Next {n}\n', (
            ('Header 1', '{n}', '', '', 1, 10, '# {n}\n\ntext {k}\n\n## Part {k}\n\n```\n# no heading\n```\n', '', ''),
            ('Header 2', 'Part {k}', '{n}', '', 5, 10, '## Part {k}\n\n```\n# no heading\n```\n', '', ''),
            ('Header 1', 'Next {n}', '', '', 10, 11, '# Next {n}\n', '', ''),
        )),
        Case('# {n} #\n#### Deep {k}\n## Two\n#No\n##\n~~~\n# x\n~~~\nline\n===\n# Last\n', (
            ('Header 1', '{n}', '', '', 1, 11, '# {n} #\n#### Deep {k}\n## Two\n#No\n##\n~~~\n# x\n~~~\nline\n===\n', '', ''),
            ('Header 4', 'Deep {k}', '{n}', '', 2, 3, '#### Deep {k}\n', '', ''),
            ('Header 2', 'Two', '{n}', '', 3, 11, '## Two\n#No\n##\n~~~\n# x\n~~~\nline\n===\n', '', ''),
            ('Header 1', 'Last', '', '', 11, 12, '# Last\n', '', ''),
        )),
    ),
    "toml": (
        Case('title = "{n}"\n\n[server]\nport = {k}\n\n[server.ssl]\non = true\n\n[[items]]\nname = "{n}"\n', (
            ('pair', 'title', '', '', 1, 1, 'title = "{n}"', '', 'path=title'),
            ('table', 'server', '', '', 3, 4, '[server]\nport = {k}', '', 'pair_count=1;path=server'),
            ('table', 'ssl', 'server', '', 6, 7, '[server.ssl]\non = true', '', 'pair_count=1;path=server.ssl'),
            ('table_array', 'items', '', '', 9, 10, '[[items]]\nname = "{n}"', '', 'pair_count=1;path=items'),
        )),
        Case('a = """\n[no]\n"""\nlist = [\n 1,\n {k},\n]\n[x.y{k}] # c\nk = "[z]"\n[["quoted.key"]]\n', (
            ('pair', 'a', '', '', 1, 3, 'a = """\n[no]\n"""', '', 'path=a'),
            ('pair', 'list', '', '', 4, 7, 'list = [\n 1,\n {k},\n]', '', 'path=list'),
            ('table', 'y{k}', 'x', '', 8, 9, '[x.y{k}] # c\nk = "[z]"', '', 'pair_count=1;path=x.y{k}'),
            ('table_array', 'key', '"quoted', '', 10, 10, '[["quoted.key"]]', '', 'pair_count=0;path="quoted.key"'),
        )),
    ),
    "yaml": (
        Case('name: {n}\nserver:\n  port: {k}\nitems:\n  - a: {k}\n', (
            ('mapping', 'root', '', '', 1, 5, 'name: {n}\nserver:\n  port: {k}\nitems:\n  - a: {k}', '', 'path=root'),
            ('mapping', 'server', 'root', '', 3, 3, 'port: {k}', '', 'path=root.server'),
            ('sequence', 'items', 'root', '', 5, 5, '- a: {k}', '', 'length=1;path=root.items'),
            ('mapping', '[0]', '[0]', '', 5, 5, 'a: {k}', '', 'path=root.items.[0].[0]'),
        )),
        Case('a:\n  b:\n    c: {k}\nflow: {x: [1]}\nlist:\n  - - {k}\n', (
            ('mapping', 'root', '', '', 1, 6, 'a:\n  b:\n    c: {k}\nflow: {x: [1]}\nlist:\n  - - {k}', '', 'path=root'),
            ('mapping', 'a', 'root', '', 2, 3, 'b:\n    c: {k}', '', 'path=root.a'),
            ('mapping', 'b', 'a', '', 3, 3, 'c: {k}', '', 'path=root.a.b'),
            ('sequence', 'list', 'root', '', 6, 6, '- - {k}', '', 'length=1;path=root.list'),
            ('sequence', '[0]', '[0]', '', 6, 6, '- {k}', '', 'length=1;path=root.list.[0].[0]'),
        )),
    ),
    "json": (
        Case('{"name": "{n}",\n "sub": {"k": {k}},\n "list": [1, [2]]}', (
            ('object', 'root', '', '', 1, 3, '{"name": "{n}",\n "sub": {"k": {k}},\n "list": [1, [2]]}', '', 'path=root'),
            ('object', 'sub', 'root', '', 2, 2, '{"k": {k}}', '', 'path=root.sub'),
            ('array', 'list', 'root', '', 3, 3, '[1, [2]]', '', 'length=2;path=root.list'),
            ('array', '[1]', 'list', '', 3, 3, '[2]', '', 'length=1;path=root.list.[1]'),
        )),
        Case('{"a": {"b": [{"k": {k}}, []]}, "bad": , "ok": {}}', (
            ('object', 'a', 'root', '', 1, 1, '{"b": [{"k": {k}}, []]}', '', 'path=root.a'),
            ('array', 'b', 'a', '', 1, 1, '[{"k": {k}}, []]', '', 'length=2;path=root.a.b'),
            ('object', '[0]', 'b', '', 1, 1, '{"k": {k}}', '', 'path=root.a.b.[0]'),
            ('array', '[1]', 'b', '', 1, 1, '[]', '', 'length=0;path=root.a.b.[1]'),
            ('object', 'ok', 'root', '', 1, 1, '{}', '', 'path=root.ok'),
        )),
    ),
    "css": (
        Case('/* {n} */\n.c{k} { color: red; top: 1px }\n@media print {\n  .d{k} { a: b }\n}\n@keyframes k{k} { from { a: b } }\n', (
            ('rule', '.c{k}', '', '', 2, 2, '.c{k} { color: red; top: 1px }', '', 'declaration_count=2'),
            ('at-rule', '@media', '', '', 3, 5, '@media print {\n  .d{k} { a: b }\n}', '', 'value=print'),
            ('rule', '.d{k}', '@media', '', 4, 4, '.d{k} { a: b }', '', 'declaration_count=1'),
            ('at-rule', '@keyframes k{k}', '', '', 6, 6, '@keyframes k{k} { from { a: b } }', '', ''),
        )),
        Case("@import 'x{k}.css';\n.a{k}, .b { color: red; top: 0 }\n@supports (display: grid) { .c { left: 0 } }\n@font-face { font-family: q{k} }\n", (
            ('at-rule', '@import', '', '', 1, 1, "@import 'x{k}.css';", '', "value='x{k}.css'"),
            ('rule', '.a{k}, .b', '', '', 2, 2, '.a{k}, .b { color: red; top: 0 }', '', 'declaration_count=2'),
            ('at-rule', '@supports', '', '', 3, 3, '@supports (display: grid) { .c { left: 0 } }', '', 'value=(display: grid)'),
            ('rule', '.c', '@supports', '', 3, 3, '.c { left: 0 }', '', 'declaration_count=1'),
            ('at-rule', '@font-face', '', '', 4, 4, '@font-face { font-family: q{k} }', '', ''),
        )),
    ),
    "html": (
        Case('<article>\n<h1>The {n} of {k}</h1>\n<ol><li>a</li><li>b</li></ol>\n<table><tr><td>{k}</td></tr></table>\n</article>', (
            ('h1', '{l} {k}', 'article', '', 2, 2, '<h1>The {n} of {k}</h1>', '', 'cleaned_text={l} {k}'),
            ('ol', 'ol-list', 'article', '', 3, 3, '<ol><li>a</li><li>b</li></ol>', '', 'cleaned_text=b;item_count=2'),
            ('table', 'table', 'article', '', 4, 4, '<table><tr><td>{k}</td></tr></table>', '', 'cleaned_text={k};cols=1;rows=1'),
        )),
        Case('<section id="s{k}"><h2 class="a b">One &amp; the {k}</h2><ul><li>x<ul><li>y</ul></ul></section><H3>no</H3><table><tr><td>1<td>2<tr><td>3</table>\n', (
            ('h2', 'one {k}', 'section', '', 1, 1, '<h2 class="a b">One &amp; the {k}</h2>', '', 'class=a b;cleaned_text=one {k}'),
            ('ul', 'ul-list', 'section', '', 1, 1, '<ul><li>x<ul><li>y</ul></ul>', '', 'cleaned_text=x y;item_count=2'),
            ('ul', 'ul-list', 'section', '', 1, 1, '<ul><li>y</ul>', '', 'cleaned_text=y;item_count=1'),
            ('table', 'table', '', '', 1, 1, '<table><tr><td>1<td>2<tr><td>3</table>', '', 'cleaned_text=1 2 3;cols=2;rows=2'),
        )),
    ),
    "python": (
        Case('import os\n\nMAX_{k} = {k}\n\n\nclass C{k}:\n    """{n}"""\n\n    @wrap\n    async def run(self, x):\n        return x\n\n\ndef f{k}(a) -> int:\n    return {k}\n', (
            ('import', 'os', '', '', 1, 1, 'import os', '', ''),
            ('constant', 'MAX_{k}', '', '', 3, 3, 'MAX_{k} = {k}', '', ''),
            ('class', 'C{k}', '', '', 6, 11, 'class C{k}:\n    """{n}"""\n\n    @wrap\n    async def run(self, x):\n        return x', '{n}', 'decorators=;is_async=false'),
            ('method', 'run', 'C{k}', 'async def run(self, x)', 9, 11, '@wrap\n    async def run(self, x):\n        return x', '', 'decorators=@wrap;is_async=true'),
            ('function', 'f{k}', '', 'def f{k}(a) -> int', 14, 15, 'def f{k}(a) -> int:\n    return {k}', '', 'decorators=;is_async=false'),
        )),
        Case('@a\n@b(1)\ndef f{k}(x):\n    """Doc {n}."""\n    def g(): pass\n\nclass C{k}:\n    class Inner:\n        def m(self): ...\n\nimport os, sys\nfrom pathlib import Path\nX = 1\nMy_Var = 3\nz = lambda: 0\n', (
            ('function', 'f{k}', '', 'def f{k}(x)', 1, 5, '@a\n@b(1)\ndef f{k}(x):\n    """Doc {n}."""\n    def g(): pass', 'Doc {n}.', 'decorators=@a,@b(1);is_async=false'),
            ('function', 'g', '', 'def g()', 5, 5, 'def g(): pass', '', 'decorators=;is_async=false'),
            ('class', 'C{k}', '', '', 7, 9, 'class C{k}:\n    class Inner:\n        def m(self): ...', '', 'decorators=;is_async=false'),
            ('class', 'Inner', 'C{k}', '', 8, 9, 'class Inner:\n        def m(self): ...', '', 'decorators=;is_async=false'),
            ('method', 'm', 'Inner', 'def m(self)', 9, 9, 'def m(self): ...', '', 'decorators=;is_async=false'),
            ('import', 'os', '', '', 11, 11, 'import os, sys', '', ''),
            ('import', 'sys', '', '', 11, 11, 'import os, sys', '', ''),
            ('import', 'pathlib', '', '', 12, 12, 'from pathlib import Path', '', ''),
            ('constant', 'X', '', '', 13, 13, 'X = 1', '', ''),
        )),
    ),
    "javascript": (
        Case('import x from "m{k}";\n/** {n} */\nfunction f{k}(a) {\n  return a;\n}\nconst g = (b) => b;\nconst MAX_{k} = {k};\nclass C{k} extends D {\n  async run(x) { return x; }\n}\nexport const E{k} = 1;\n', (
            ('import', 'm{k}', '', '', 1, 1, 'import x from "m{k}";', '', 'is_arrow=false;is_async=false;is_generator=false'),
            ('function', 'f{k}', '', 'function f{k}(a)', 3, 5, 'function f{k}(a) {\n  return a;\n}', '{n}', 'is_arrow=false;is_async=false;is_generator=false'),
            ('function', 'g', '', '(b) =>', 6, 6, 'const g = (b) => b;', '', 'is_arrow=true;is_async=false;is_generator=false'),
            ('constant', 'MAX_{k}', '', '', 7, 7, 'const MAX_{k} = {k};', '', 'is_arrow=false;is_async=false;is_generator=false'),
            ('class', 'C{k}', '', '', 8, 10, 'class C{k} extends D {\n  async run(x) { return x; }\n}', '', 'is_arrow=false;is_async=false;is_generator=false'),
            ('method', 'run', 'C{k}', 'async run(x)', 9, 9, 'async run(x) { return x; }', '', 'is_arrow=false;is_async=true;is_generator=false'),
            ('export', 'E{k}', '', '', 11, 11, 'export const E{k} = 1;', '', 'is_arrow=false;is_async=false;is_generator=false'),
        )),
        Case('/** Sum {n} */\nexport async function add{k}(a, b) {\n  return a + b;\n}\nfunction* gen{k}() { yield {k}; }\nexport default class {\n  static get x() { return 1; }\n}\nexport { p, q as r };\nconst LIMIT = (z) => z;\n', (
            ('export', 'add{k}', '', '', 2, 4, 'export async function add{k}(a, b) {\n  return a + b;\n}', 'Sum {n}', 'is_arrow=false;is_async=false;is_generator=false'),
            ('function', 'add{k}', '', 'async function add{k}(a, b)', 2, 4, 'async function add{k}(a, b) {\n  return a + b;\n}', '', 'is_arrow=false;is_async=true;is_generator=false'),
            ('function', 'gen{k}', '', 'function* gen{k}()', 5, 5, 'function* gen{k}() { yield {k}; }', '', 'is_arrow=false;is_async=false;is_generator=true'),
            ('export', 'default', '', '', 6, 8, 'export default class {\n  static get x() { return 1; }\n}', '', 'is_arrow=false;is_async=false;is_generator=false'),
            ('export', 'p, q', '', '', 9, 9, 'export { p, q as r };', '', 'is_arrow=false;is_async=false;is_generator=false'),
            ('function', 'LIMIT', '', '(z) =>', 10, 10, 'const LIMIT = (z) => z;', '', 'is_arrow=true;is_async=false;is_generator=false'),
            ('constant', 'LIMIT', '', '', 10, 10, 'const LIMIT = (z) => z;', '', 'is_arrow=false;is_async=false;is_generator=false'),
        )),
    ),
    "typescript": (
        Case('interface I{k} {\n  m(x: number): void;\n}\ntype T{k} = string | number;\nenum E{k} { A, B }\nabstract class C{k} {\n  private foo(a: string): void {}\n}\nconst MAX_{k}: number = {k};\n', (
            ('interface', 'I{k}', '', '', 1, 3, 'interface I{k} {\n  m(x: number): void;\n}', '', 'decorators=;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility='),
            ('method', 'm', 'I{k}', 'm(x: number): void', 2, 2, 'm(x: number): void', '', 'decorators=;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility='),
            ('type_alias', 'T{k}', '', '', 4, 4, 'type T{k} = string | number;', '', 'decorators=;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility='),
            ('enum', 'E{k}', '', '', 5, 5, 'enum E{k} { A, B }', '', 'decorators=;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility='),
            ('class', 'C{k}', '', '', 6, 8, 'abstract class C{k} {\n  private foo(a: string): void {}\n}', '', 'decorators=;is_abstract=true;is_arrow=false;is_async=false;is_generator=false;visibility='),
            ('method', 'foo', 'C{k}', 'private foo(a: string): void', 7, 7, 'private foo(a: string): void {}', '', 'decorators=;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility=private'),
            ('constant', 'MAX_{k}', '', '', 9, 9, 'const MAX_{k}: number = {k};', '', 'decorators=;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility='),
        )),
        Case("import { a } from './m{k}';\n/** Box of {n} */\n@sealed\nexport class Box{k} {\n  @log public open(): void {}\n  protected async shut(x: string): Promise<void> { }\n}\nexport const enum Kind{k} { A }\nexport enum Mode{k} { B }\nexport type Id{k} = string;\n", (
            ('import', './m{k}', '', '', 1, 1, "import { a } from './m{k}';", '', 'decorators=;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility='),
            ('export', 'Box{k}', '', '', 4, 7, 'export class Box{k} {\n  @log public open(): void {}\n  protected async shut(x: string): Promise<void> { }\n}', '', 'decorators=;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility='),
            ('class', 'Box{k}', '', '', 4, 7, 'class Box{k} {\n  @log public open(): void {}\n  protected async shut(x: string): Promise<void> { }\n}', '', 'decorators=@sealed;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility='),
            ('method', 'open', 'Box{k}', 'public open(): void', 5, 5, 'public open(): void {}', '', 'decorators=@log;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility=public'),
            ('method', 'shut', 'Box{k}', 'protected async shut(x: string): Promise<void>', 6, 6, 'protected async shut(x: string): Promise<void> { }', '', 'decorators=@log;is_abstract=false;is_arrow=false;is_async=true;is_generator=false;visibility=protected'),
            ('export', 'default', '', '', 8, 8, 'export const enum Kind{k} { A }', '', 'decorators=;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility='),
            ('enum', 'Kind{k}', '', '', 8, 8, 'const enum Kind{k} { A }', '', 'decorators=;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility='),
            ('export', 'default', '', '', 9, 9, 'export enum Mode{k} { B }', '', 'decorators=;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility='),
            ('enum', 'Mode{k}', '', '', 9, 9, 'enum Mode{k} { B }', '', 'decorators=;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility='),
            ('export', 'Id{k}', '', '', 10, 10, 'export type Id{k} = string;', '', 'decorators=;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility='),
            ('type_alias', 'Id{k}', '', '', 10, 10, 'type Id{k} = string;', '', 'decorators=;is_abstract=false;is_arrow=false;is_async=false;is_generator=false;visibility='),
        )),
    ),
    "rust": (
        Case('use std::io::Read;\n/// {n}\n#[derive(Debug)]\npub struct S{k} { x: i32 }\nimpl S{k} {\n    pub async fn new(x: i32) -> Self { S{k} { x } }\n}\nconst X{k}: i32 = {k};\nmod m{k} {}\n', (
            ('import', 'Read', '', '', 1, 1, 'use std::io::Read;', '', 'attributes=;is_async=false;is_pub=false;is_unsafe=false'),
            ('struct', 'S{k}', '', '', 4, 4, 'pub struct S{k} { x: i32 }', '{n}', 'attributes=#[derive(Debug)];is_async=false;is_pub=true;is_unsafe=false'),
            ('impl', 'S{k}', '', '', 5, 7, 'impl S{k} {\n    pub async fn new(x: i32) -> Self { S{k} { x } }\n}', '', 'attributes=;is_async=false;is_pub=false;is_unsafe=false'),
            ('method', 'new', 'S{k}', 'pub async fn new(x: i32) -> Self', 6, 6, 'pub async fn new(x: i32) -> Self { S{k} { x } }', '', 'attributes=;is_async=true;is_pub=true;is_unsafe=false'),
            ('constant', 'X{k}', '', '', 8, 8, 'const X{k}: i32 = {k};', '', 'attributes=;is_async=false;is_pub=false;is_unsafe=false'),
            ('module', 'm{k}', '', '', 9, 9, 'mod m{k} {}', '', 'attributes=;is_async=false;is_pub=false;is_unsafe=false'),
        )),
        Case('//! crate\n/// One {n}\n/// two\n#[a]\n#[b(c)]\npub enum E{k} { A }\nunsafe trait T{k} { fn no(&self); fn yes(&self) {} }\nimpl<X> G<X> { fn m(&self) { let s = "}"; } }\nuse std::{a, b};\nuse a::b as c{k};\nstatic S{k}: u8 = 1;\ntype A{k} = u8;\n', (
            ('enum', 'E{k}', '', '', 6, 6, 'pub enum E{k} { A }', 'crate\nOne {n}\ntwo', 'attributes=#[a],#[b(c)];is_async=false;is_pub=true;is_unsafe=false'),
            ('trait', 'T{k}', '', '', 7, 7, 'unsafe trait T{k} { fn no(&self); fn yes(&self) {} }', '', 'attributes=;is_async=false;is_pub=false;is_unsafe=true'),
            ('method', 'yes', 'T{k}', 'fn yes(&self)', 7, 7, 'fn yes(&self) {}', '', 'attributes=;is_async=false;is_pub=false;is_unsafe=false'),
            ('method', 'm', 'G<X>', 'fn m(&self)', 8, 8, 'fn m(&self) { let s = "}"; }', '', 'attributes=;is_async=false;is_pub=false;is_unsafe=false'),
            ('import', 'c{k}', '', '', 10, 10, 'use a::b as c{k};', '', 'attributes=;is_async=false;is_pub=false;is_unsafe=false'),
            ('static', 'S{k}', '', '', 11, 11, 'static S{k}: u8 = 1;', '', 'attributes=;is_async=false;is_pub=false;is_unsafe=false'),
            ('type_alias', 'A{k}', '', '', 12, 12, 'type A{k} = u8;', '', 'attributes=;is_async=false;is_pub=false;is_unsafe=false'),
        )),
    ),
}
