"""Parsers on small sources of our own: symbols, kinds, owners, lines, calls, imports."""

from __future__ import annotations

import pytest

from fathomer.sources.languages import language_of
from fathomer.sources.languages.code import truncated


def parsed(path, source):
    return language_of(path).parse(source, path)


def kinds(result):
    return {(s.receiver + "." if s.receiver else "") + s.name: s.kind for s in result.symbols}


GO = '''// Package shop sells.
package shop

import (
	"fmt"
	str "strings"
)

import "os"

const Limit = 3

const (
	First, Second = 1, 2
	_             = 3
)

var cache map[string]int

// Basket holds items.
// It is not safe.
type Basket struct {
	items []string // "}" is no brace
}

type Seller interface {
	Sell(b *Basket) error
}

type ID = string

// Add puts an item in.
func (b *Basket) Add(item string) error {
	if str.TrimSpace(item) == "" {
		return fmt.Errorf("empty {")
	}
	b.items = append(b.items, item)
	helper(func() { inner() })
	return nil
}

func helper(f func()) { f() }

func Map[T any](in []T) []T {
	return in
}
'''


def test_go():
    r = parsed("shop.go", GO)
    assert kinds(r) == {
        "Limit": "const", "First": "const", "Second": "const", "cache": "var", "Basket": "struct", "Seller": "interface", "ID": "type",
        "Basket.Add": "method", "helper": "function", "Map": "function",
    }
    by = {s.name: s for s in r.symbols}
    assert by["Basket"].doc_comment == "Basket holds items.\nIt is not safe."
    assert by["Add"].signature == "func (b *Basket) Add(item string) error"
    assert (by["Add"].start_line, by["Add"].end_line, by["Add"].package) == (33, 40, "shop")
    assert by["Add"].key("shop.go") == "shop.go:Basket.Add:method"
    assert r.imports == ["fmt", "strings", "os"]
    assert {("Add", "TrimSpace"), ("Add", "Errorf"), ("Add", "append"), ("Add", "helper"), ("Add", "inner"), ("helper", "f")} <= {c[:2] for c in r.calls}
    assert not any(c[1] in ("func", "if") for c in r.calls)


def test_java():
    r = parsed("A.java", '''
package a.b;
import java.util.List;
import static a.b.C.run;
/** A cart. */
public class Cart extends Base {
    private final List<String> items = new ArrayList<>();
    int count, total = 2;
    public Cart(int n) { super(n); init(); }
    @Override
    public <T> List<T> add(T item) throws IOException {
        if (items.isEmpty()) { return log(item); }
        return null;
    }
    abstract void stop();
    interface Inner { void go(); }
    enum Color { RED, GREEN; Color() {} }
}
record Point(int x, int y) {}
''')
    got = kinds(r)
    assert got == {
        "Cart": "struct", "Cart.items": "field", "Cart.count": "field", "Cart.total": "field", "Cart.Cart": "function", "Cart.add": "method", "Cart.stop": "method",
        "Inner": "interface", "Inner.go": "method", "Color": "type", "Point": "struct",
    }
    assert r.imports == ["java.util.List", "a.b.C.run"]
    assert {("Cart", "init"), ("add", "isEmpty"), ("add", "log")} <= {c[:2] for c in r.calls}
    assert next(s for s in r.symbols if s.name == "Cart" and s.kind == "struct").doc_comment == "A cart."


def test_kotlin():
    r = parsed("a.kt", '''
package shop.core
import kotlin.math.max
val limit = 3
/** Sells. */
class Seller(private val name: String) : Base() {
    var sold = 0
    fun sell(item: String): Int {
        check(item)
        store.put(item)
        return max(1, 2)
    }
}
interface Buyer { fun buy() }
fun main() = run()
''')
    assert kinds(r) == {"limit": "var", "Seller": "struct", "Seller.sold": "field", "Seller.sell": "method", "Buyer": "interface", "Buyer.buy": "method", "main": "function"}
    assert {c[:2] for c in r.calls} == {("sell", "check"), ("sell", "max"), ("main", "run")}
    assert r.imports == ["kotlin.math.max"] and r.symbols[0].package == "shop.core"


def test_javascript_and_typescript():
    source = '''
import { a } from "./a";
import "./side";
// Loads it.
export async function load(url) { return fetch(url).then(parse); }
export default class Store {
  constructor(x) { this.x = x; }
  get size() { return 1; }
  async put(k, v) { await save(k); }
}
const twice = (f) => f(f(1));
let plain = 3;
export const named = function () { go(); };
'''
    r = parsed("a.js", source)
    assert kinds(r) == {"load": "function", "Store": "struct", "Store.constructor": "method", "Store.size": "method", "Store.put": "method", "twice": "function", "named": "function"}
    assert r.imports == ["./a", "./side"]
    assert {c[:2] for c in r.calls} == {("load", "fetch"), ("load", "then"), ("twice", "f"), ("named", "go")}
    t = parsed("a.tsx", source + '''
export interface Shape { area(): number; }
type Id = string | number;
export enum Color { Red }
export const typed = (x: number): number => calc(x);
''')
    assert {("Shape", "interface"), ("Id", "type"), ("Color", "type"), ("typed", "function")} <= {(s.name, s.kind) for s in t.symbols}


def test_rust():
    r = parsed("a.rs", '''
use std::collections::HashMap;
use crate::io::*;
use a::b as c;
/// A cart.
pub struct Cart<'a> { items: Vec<&'a str> }
pub enum Color { Red(char) }
pub trait Sell { fn sell(&self) -> u8; fn twice(&self) { self.sell(); } }
type Id = u64;
impl<'a> Cart<'a> {
    pub fn add(&mut self, x: &'a str) { let c = '{'; self.items.push(x); println!("{}", x); util::log(x); }
}
impl Sell for Cart<'_> { fn sell(&self) -> u8 { helper() } }
mod inner { pub fn deep() {} }
fn helper() -> u8 { 1 }
''')
    assert kinds(r) == {
        "Cart": "struct", "Color": "type", "Sell": "interface", "Sell.sell": "method", "Sell.twice": "method", "Id": "type", "Cart.add": "method", "Cart.sell": "method",
        "deep": "function", "helper": "function",
    }
    assert r.imports == ["std::collections::HashMap", "crate::io", "a::b"]
    assert {c[:2] for c in r.calls} == {("add", "push"), ("add", "log"), ("sell", "helper"), ("twice", "sell")}


def test_csharp():
    r = parsed("a.cs", '''
using System;
using static System.Math;
using X = A.B;
namespace Shop.Core {
    /// <summary>Sells.</summary>
    public class Seller : Base {
        private readonly int count = 3;
        public int Total { get; set; }
        public Seller(int n) { count = n; }
        public async Task<int> Sell(string item) { Console.WriteLine(item); return Count<int>(item); }
        int Twice(int x) => Add(x, x);
    }
    interface IBuyer { void Buy(); }
}
''')
    got = kinds(r)
    assert got["Seller"] == "struct" and got["IBuyer"] == "interface" and got["Seller.count"] == "field"
    assert got["Seller.Sell"] == got["Seller.Twice"] == got["IBuyer.Buy"] == "method"
    assert r.imports == ["System", "System.Math", "A.B"]
    assert {("Sell", "WriteLine"), ("Sell", "Count"), ("Twice", "Add")} <= {c[:2] for c in r.calls}
    assert {s.package for s in r.symbols} == {"Shop.Core"}


def test_c_and_cpp():
    r = parsed("a.h", '''
#include <stdio.h>
#include "own.h"
#define SQUARE(x) ((x) * (x))
#define PLAIN 3
#ifdef FOO
/* Adds. */
int add(int a, int b);
#endif
typedef struct { int x; } point_t;
typedef unsigned long size;
struct node { struct node *next; };
enum color { RED, GREEN };
static inline int twice(int a) { if (a) { return add(a, a); } log_it("{"); return 0; }
''')
    assert kinds(r) == {"SQUARE": "function", "add": "function", "point_t": "struct", "size": "type", "node": "struct", "color": "type", "twice": "function"}
    assert r.imports == ["stdio.h", "own.h"]
    assert {c[:2] for c in r.calls} == {("twice", "add"), ("twice", "log_it")}
    assert next(s for s in r.symbols if s.name == "add").doc_comment == "Adds."
    p = parsed("a.cpp", '''
#include <vector>
using namespace std;
using Id = int;
namespace shop {
class Cart : public Base {
 public:
  Cart(int n) : n_(n), m_{1} { init(); }
  ~Cart();
  int size() const { return items.size(); }
  void add(int x);
 private:
  int n_;
};
template <typename T> T largest(T a, T b) { return pick(a, b); }
enum class Color { Red };
}
void shop::Cart::add(int x) { push(x); std::move(x); }
''')
    got = {(s.receiver, s.name, s.kind) for s in p.symbols}
    assert {
        ("", "shop", "type"), ("", "Cart", "struct"), ("Cart", "Cart", "method"), ("Cart", "~Cart", "method"), ("Cart", "size", "method"), ("Cart", "add", "method"),
        ("", "largest", "function"), ("", "Color", "type"), ("", "Id", "type"),
    } <= got
    assert p.imports == ["vector", "std"]
    assert {("Cart", "init"), ("largest", "pick"), ("add", "push")} <= {c[:2] for c in p.calls}
    assert ("add", "move") not in {c[:2] for c in p.calls}


def test_sql():
    r = parsed("a.sql", '''
-- People.
CREATE TABLE IF NOT EXISTS app.users (
  id INT -- ; not the end
);
create or replace view "Active" as select 'create table x' from users;
CREATE MATERIALIZED VIEW mv AS SELECT 1;
CREATE UNIQUE INDEX idx_u ON users (id);
CREATE FUNCTION f() RETURNS int AS $$ create table no; $$ LANGUAGE sql;
CREATE TRIGGER t BEFORE INSERT ON users;
CREATE PROCEDURE p() BEGIN END;
''')
    assert kinds(r) == {"users": "table", "Active": "view", "mv": "view", "idx_u": "index", "f": "function", "t": "trigger", "p": "procedure"}
    users = r.symbols[0]
    assert (users.doc_comment, users.signature, users.start_line, users.end_line) == ("People.", "CREATE TABLE IF NOT EXISTS app.users (", 3, 5)


def test_markdown_html_shell():
    r = parsed("a.md", "# One\ntext\n\n```\n# no\n```\n## Two ##\nmore\n#none\n")
    assert [(s.name, s.kind, s.start_line, s.end_line) for s in r.symbols] == [("One", "section", 1, 6), ("Two", "section", 7, 9)]
    assert r.symbols[1].doc_comment == "more\n#none"
    h = parsed("a.html", "<title> A &amp; B </title><script><h1>no</h1></script><h1>One <b>not</b> two</h1><h2></h2>")
    assert [(s.name, s.kind) for s in h.symbols] == [("A & B", "element"), ("One two", "section")]
    s = parsed("a.sh", "#!/bin/sh\n# Builds.\nbuild() {\n  echo \"}\" # }\n}\nfunction clean {\n  rm x\n}\n")
    assert [(x.name, x.start_line, x.end_line, x.doc_comment) for x in s.symbols] == [("build", 3, 5, "Builds."), ("clean", 6, 8, "")]


def test_http_proto_text():
    r = parsed("a.http", "### Get it\nGET https://h/x/y?z=1 HTTP/1.1\nA: b\n\n### \n# Posts\nPOST http://h\n\n{}\n")
    assert [(s.name, s.kind, s.doc_comment, s.start_line) for s in r.symbols] == [("GET /x/y", "function", "Get it", 2), ("POST /", "function", "Posts", 7)]
    p = parsed("a.proto", 'package a.b;\n// Does.\nservice Svc {\n  // One.\n  rpc Do(M) returns (M);\n  rpc Go(M) returns (M) {}\n}\nmessage M { message In {} }\nenum E { A = 0; }\n')
    assert kinds(p) == {"Svc": "interface", "Svc.Do": "method", "Svc.Go": "method", "M": "type", "E": "type"}
    assert p.symbols[1].key("a.proto") == "a.proto:Svc.Do:method" and p.symbols[1].doc_comment == "One."
    t = parsed("x/Makefile", "\nall:\n\tgo\n")
    assert [(s.name, s.kind, s.signature, s.end_line) for s in t.symbols] == [("Makefile", "document", "all:\n\tgo", 2)]
    assert parsed("a.txt", " \n ").symbols == []
    assert len(parsed("b.txt", "é" * 5000).symbols[0].doc_comment.encode()) == 4000


def test_routing_and_truncation():
    assert language_of("a/B.GO").name == "go" and language_of("Dockerfile").name == "text" and language_of("a.py") is None
    assert truncated("aé", 2) == "a" and truncated("aé", 3) == "aé"


@pytest.mark.parametrize("path", ["a.go", "a.java", "a.kt", "a.js", "a.ts", "a.rs", "a.cs", "a.c", "a.cpp", "a.sql", "a.md", "a.html", "a.sh", "a.http", "a.proto", "a.txt"])
@pytest.mark.parametrize("source", ["", "\n", "{", "}", "func (", "class", "'", '"', "/*", "```", "<h1", "a" * 3000, "((((" * 200, "{" * 300, "\x00퟿"])
def test_no_source_breaks_a_parser(path, source):
    parsed(path, source)


def test_html_references_end_with_a_semicolon():
    found = parsed("a.html", "<title>a &amp; b &amp</title><h1>&lt; &#39; &#x41; &ampx; &lt</h1><h2>&amp;amp;</h2>")
    assert [s.name for s in found.symbols] == ["a & b &amp", "< ' A &ampx; &lt", "&amp;"]
