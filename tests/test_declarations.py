"""Declarations of languages of braces, and their chunks."""

import time

import pytest

from corpuscle.operators import chunks, declarations

SCRIPT = """import a from 'a';
import {
  b,
} from "b";

const s = "} function no() {"; // { class No {
const r = x.replace(/[{"]/g, '{');
/** Says. */
export async function one({ a }: { a: number }): { b: number } {
  function inner() { return `}`; }
}

@Tag()
export abstract class Two<T> extends Base {
  x = call({});
  // makes
  constructor(private y: string) { super(); }
  abstract z(): void;
  static async *#w<U>(u: U) {
    if (u) { return; }
  }
}
export interface Three { f(): void }
type Four =
  | 'a'
  | 'b';
enum Five { A, B }
const arrow = () => { };
"""
GO = """package main

import (
\t"fmt"
)
// doc
func Run(a int) (int, error) {
\ts := `}`
\treturn '}', nil
}
func (s *Server) Stop() { }
type Server struct {
\tname string
}
type Doer interface { Do() }
type ID int
var x = 1
"""
RUST = """use std::fmt;
use std::io::{self, Read};

#[derive(Debug)]
pub struct Point<'a> { x: &'a str }
struct Unit;
pub enum Kind { A, B }
type Short = u8;
impl<'a> fmt::Display for Point<'a> {
    /// shows
    fn fmt(&self) -> String { let c = '{'; r#"}"#.into() }
    pub(crate) const fn two() -> u8 { 2 }
}
pub trait Flat { fn area(&self) -> f64 { 1.0 } }
pub trait Shape {
    fn area(&self) -> f64;
    fn twice(&self) -> f64 { 2.0 }
}
pub async fn go() {
    let x = "
}";
}
"""


@pytest.mark.parametrize(
    ("language", "source", "want"),
    [
        ("typescript", SCRIPT, [(1, 4, None, "imports"), (8, 11, "one", "function"), (13, 15, "Two", "class"), (16, 17, "Two.constructor", "method"), (19, 21, "Two.#w", "method"), (23, 23, "Three", "interface"), (24, 26, "Four", "type_alias"), (27, 27, "Five", "type_alias")]),
        ("go", GO, [(3, 5, None, "imports"), (6, 10, "Run", "function"), (11, 11, "Server.Stop", "method"), (12, 14, "Server", "struct"), (15, 15, "Doer", "interface"), (16, 16, "ID", "type_alias")]),
        ("rust", RUST, [(1, 2, None, "imports"), (4, 5, "Point", "struct"), (6, 6, "Unit", "struct"), (7, 7, "Kind", "type_alias"), (8, 8, "Short", "type_alias"), (9, 9, "Point", "class"), (10, 11, "Point.fmt", "method"), (12, 12, "Point.two", "method"), (14, 14, "Flat", "interface"), (15, 16, "Shape", "interface"), (17, 17, "Shape.twice", "method"), (19, 22, "go", "function")]),
    ],
)
def test_spans(language, source, want):
    assert declarations.spans(source, language) == want


def test_broken_and_long_files():
    with pytest.raises(ValueError):
        declarations.spans("function f() { ( }", "javascript")
    start = time.time()
    long = "function f(a) { if (a) { return [1, 2]; } }\nvar x = {};\n" * 20000 + "{" * 20000 + "}" * 20000
    assert len(declarations.spans(long, "javascript")) == 20000 and time.time() - start < 20


def test_chunks_keep_every_line(spark):
    rows = [(1, SCRIPT, "typescript"), (2, GO, "go"), (3, RUST, "rust"), (4, "fn f( {", "rust"), (5, None, "go"), (6, "", "rust"), (7, "class A {}", "java"), (8, SCRIPT, "typescript"), (9, "x y\nfunction f() {}", "javascript")]
    got = chunks.source_chunks(spark.createDataFrame(rows, "id int, text string, lang string"), "id", "text", "lang", 40).collect()
    for i, text, _ in rows:
        mine = sorted((r for r in got if r.id == i), key=lambda r: (r.start_line, r.end_line))
        assert "".join("".join(r.content for r in mine).split()) == "".join((text or "").split())
    assert {(r.symbol, r.kind) for r in got if r.id == 9} == {(None, "line_window"), ("f", "function")}
    assert {r.kind for r in got if r.id in (4, 7)} == {"line_window"}
    assert all(r.token_count <= 40 for r in got)


def test_texts_within_the_budget_are_one_chunk():
    for text in ("", "a", "a\n", "\n", "a\x0bb\x85c\r\nd\u2028e", "a b\n\nc\n"):
        tokens = len(chunks._TOKEN.findall(text))
        assert list(chunks._greedy(text, 6, 3)) == ([(3, 3 + text.count("\n") - text.endswith("\n"), text, tokens)] if text else [])
    assert [c[:2] for c in chunks._greedy("a b\nc d\n", 3)] == [(1, 1), (2, 2)]


def test_lines_of_other_breaks(spark):
    rows = [(1, "x = 1\rdef f():\r    pass\ny = '\x0c'\r\nz = 3", "python"), (2, "var a\r\nfunction f() {\r\n}\r\nvar b", "javascript")]
    got = chunks.source_chunks(spark.createDataFrame(rows, "id int, text string, lang string"), "id", "text", "lang").collect()
    assert {(r.id, r.content) for r in got if r.kind == "function"} == {(1, "def f():\r    pass\n"), (2, "function f() {\r\n}\r\n")}
    for i, text, _ in rows:
        assert "".join(r.content for r in sorted((r for r in got if r.id == i), key=lambda r: r.start_line)) == text
