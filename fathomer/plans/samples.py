"""Sources for each language, made for each key, and what their parsers must find.

The sources are templates: ``{k}`` is a number.  ``EXPECTED`` lists what each
holds by the rules of its language: ``what | owner | name | kind | first line |
last line``, where ``what`` is a symbol, a call (by its owner) or an import.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Extension and source of each language.
SAMPLES = {
    "go": (
        "go",
        '''// Package shop{k} sells.
package shop{k}

import (
	"fmt"
	str "strings"
)

const Limit{k} = 3

const (
	First, Second = 1, 2
	_             = 3
)

var cache map[string]int

// Basket{k} holds items.
type Basket{k} struct {
	items []string // "}" is no brace
}

type Seller interface {
	Sell(b *Basket{k}) error
}

type ID = string

// Add puts an item in.
func (b *Basket{k}) Add(item string) error {
	if str.TrimSpace(item) == "" {
		return fmt.Errorf("empty {")
	}
	b.items = append(b.items, item)
	helper{k}(func() { inner() })
	return nil
}

func helper{k}(f func()) { f() }
''',
    ),
    "java": (
        "java",
        '''package a.b{k};
import java.util.List;
import static a.b.C.run;

/** A cart. */
public class Cart{k} extends Base {
    private final List<String> items = new ArrayList<>();
    int count, total = 2;
    public Cart{k}(int n) { super(n); init(); }
    @Override
    public <T> List<T> add(T item) throws IOException {
        if (items.isEmpty()) { return log{k}(item); }
        return null;
    }
    abstract void stop();
    interface Inner { void go(); }
    enum Color { RED, GREEN; Color() {} }
}
record Point(int x, int y) {}
''',
    ),
    "kotlin": (
        "kt",
        '''package shop.core{k}
import kotlin.math.max

val limit = 3

/** Sells. */
class Seller{k}(private val name: String) : Base() {
    var sold = 0
    fun sell(item: String): Int {
        check{k}(item)
        return max(1, 2)
    }
}
interface Buyer { fun buy() }
fun main{k}() = run()
''',
    ),
    "javascript": (
        "js",
        '''import { a } from "./a{k}";
import "./side";

// Loads it.
export async function load{k}(url) { return fetch(url).then(parse); }

export default class Store{k} {
  constructor(x) { this.x = x; }
  get size() { return 1; }
  async put(k, v) { await save(k); }
}
const twice = (f) => f(f(1));
let plain = 3;
export const named{k} = function () { go(); };
''',
    ),
    "typescript": (
        "ts",
        '''import { a } from "./a{k}";
import "./side";

// Loads it.
export async function load{k}(url) { return fetch(url).then(parse); }

export default class Store{k} {
  constructor(x) { this.x = x; }
  get size() { return 1; }
  async put(k, v) { await save(k); }
}
const twice = (f) => f(f(1));
let plain = 3;
export const named{k} = function () { go(); };

export interface Shape{k} { area(): number; }
type Id = string | number;
export enum Color { Red }
export const typed = (x: number): number => calc{k}(x);
''',
    ),
    "rust": (
        "rs",
        '''use std::collections::HashMap;
use crate::io{k}::*;
use a::b as c;

/// A cart.
pub struct Cart{k}<'a> { items: Vec<&'a str> }
pub enum Color { Red(char) }
pub trait Sell { fn sell(&self) -> u8; fn twice(&self) { self.sell(); } }
type Id = u64;
impl<'a> Cart{k}<'a> {
    pub fn add(&mut self, x: &'a str) {
        let c = '{';
        self.items.push(x);
        util::log{k}(x);
    }
}
impl Sell for Cart{k}<'_> { fn sell(&self) -> u8 { helper() } }
mod inner { pub fn deep() {} }
fn helper() -> u8 { 1 }
''',
    ),
    "csharp": (
        "cs",
        '''using System;
using static System.Math;
namespace Shop.Core{k} {
    /// <summary>Sells.</summary>
    public class Seller{k} : Base {
        private readonly int count = 3;
        public int Total { get; set; }
        public Seller{k}(int n) { count = n; }
        public async Task<int> Sell(string item) {
            Console.WriteLine(item);
            return Count{k}<int>(item);
        }
        int Twice(int x) => Add(x, x);
    }
    interface IBuyer { void Buy(); }
}
''',
    ),
    "c": (
        "c",
        '''#include <stdio.h>
#include "own{k}.h"
#define SQUARE(x) ((x) * (x))
#define PLAIN 3

/* Adds. */
int add{k}(int a, int b);

typedef struct { int x; } point{k}_t;
typedef unsigned long size{k};
struct node { struct node *next; };
enum color { RED, GREEN };

static inline int twice{k}(int a) {
    if (a) {
        return add{k}(a, a);
    }
    log_it("{");
    return 0;
}
''',
    ),
    "cpp": (
        "cpp",
        '''#include <vector>
using namespace std;
using Id = int;
namespace shop{k} {
class Cart{k} : public Base {
 public:
  Cart{k}(int n) : n_(n), m_{1} { init(); }
  ~Cart{k}();
  int size() const { return items.size(); }
  void add(int x);
 private:
  int n_;
};
template <typename T> T largest(T a, T b) { return pick{k}(a, b); }
enum class Color { Red };
}
void shop{k}::Cart{k}::add(int x) { push(x); }
''',
    ),
    "sql": (
        "sql",
        '''-- People.
CREATE TABLE IF NOT EXISTS app.users{k} (
  id INT -- ; not the end
);
create or replace view "Active{k}" as select 'create table x' from users{k};
CREATE MATERIALIZED VIEW mv AS SELECT 1;
CREATE UNIQUE INDEX idx_u ON users{k} (id);
CREATE FUNCTION f{k}() RETURNS int AS $$ create table no; $$ LANGUAGE sql;
CREATE TRIGGER t BEFORE INSERT ON users{k};
CREATE PROCEDURE p() BEGIN END;
''',
    ),
    "markdown": (
        "md",
        '''# One {k}
text

```
# no
```
## Two ##
more
#none
### Three {k}
''',
    ),
    "shell": (
        "sh",
        '''#!/bin/sh
# Builds {k}.
build{k}() {
  echo "}" # }
}
function clean {
  rm x{k}
}
''',
    ),
    "http": (
        "http",
        '''### Get it
GET https://h/x{k}/y?z=1 HTTP/1.1
A: b

###
# Posts
POST http://h{k}

{}

DELETE https://h/items/{k}
''',
    ),
    "protobuf": (
        "proto",
        '''syntax = "proto3";
package a.b{k};

// Does.
service Svc{k} {
  // One.
  rpc Do(M{k}) returns (M{k});
  rpc Go(M{k}) returns (M{k}) {}
}
message M{k} {
  message In {}
}
enum E { A = 0; }
''',
    ),
    "text": (
        "txt",
        '''
Notes {k}

second line
''',
    ),
}

# What the parsers find.
EXPECTED = {
    "go": """
        symbol||Limit{k}|const|9|9
        symbol||First|const|12|12
        symbol||Second|const|12|12
        symbol||cache|var|16|16
        symbol||Basket{k}|struct|19|21
        symbol||Seller|interface|23|25
        symbol||ID|type|27|27
        symbol|Basket{k}|Add|method|30|37
        symbol||helper{k}|function|39|39
        call|Add|TrimSpace||31|31
        call|Add|Errorf||32|32
        call|Add|append||34|34
        call|Add|helper{k}||35|35
        call|Add|inner||35|35
        call|helper{k}|f||39|39
        import||fmt||0|0
        import||strings||0|0
    """,
    "java": """
        symbol||Cart{k}|struct|6|18
        symbol|Cart{k}|Cart{k}|function|9|9
        symbol|Cart{k}|add|method|10|14
        symbol|Cart{k}|stop|method|15|15
        symbol|Cart{k}|items|field|7|7
        symbol|Cart{k}|count|field|8|8
        symbol|Cart{k}|total|field|8|8
        symbol||Inner|interface|16|16
        symbol|Inner|go|method|16|16
        symbol||Color|type|17|17
        symbol||Point|struct|19|19
        call|Cart{k}|init||9|9
        call|add|isEmpty||12|12
        call|add|log{k}||12|12
        import||java.util.List||0|0
        import||a.b.C.run||0|0
    """,
    "kotlin": """
        symbol||limit|var|4|4
        symbol||Seller{k}|struct|7|13
        symbol|Seller{k}|sold|field|8|8
        symbol|Seller{k}|sell|method|9|12
        symbol||Buyer|interface|14|14
        symbol|Buyer|buy|method|14|14
        symbol||main{k}|function|15|15
        call|sell|check{k}||10|10
        call|sell|max||11|11
        call|main{k}|run||15|15
        import||kotlin.math.max||0|0
    """,
    "javascript": """
        symbol||load{k}|function|5|5
        symbol||Store{k}|struct|7|11
        symbol|Store{k}|constructor|method|8|8
        symbol|Store{k}|size|method|9|9
        symbol|Store{k}|put|method|10|10
        symbol||twice|function|12|12
        symbol||named{k}|function|14|14
        call|load{k}|fetch||5|5
        call|load{k}|then||5|5
        call|twice|f||12|12
        call|named{k}|go||14|14
        import||./a{k}||0|0
        import||./side||0|0
    """,
    "typescript": """
        symbol||load{k}|function|5|5
        symbol||Store{k}|struct|7|11
        symbol|Store{k}|constructor|method|8|8
        symbol|Store{k}|size|method|9|9
        symbol|Store{k}|put|method|10|10
        symbol||twice|function|12|12
        symbol||named{k}|function|14|14
        symbol||Shape{k}|interface|16|16
        symbol||Id|type|17|17
        symbol||Color|type|18|18
        symbol||typed|function|19|19
        call|load{k}|fetch||5|5
        call|load{k}|then||5|5
        call|twice|f||12|12
        call|named{k}|go||14|14
        call|typed|calc{k}||19|19
        import||./a{k}||0|0
        import||./side||0|0
    """,
    "rust": """
        symbol||Cart{k}|struct|6|6
        symbol||Color|type|7|7
        symbol||Sell|interface|8|8
        symbol|Sell|sell|method|8|8
        symbol|Sell|twice|method|8|8
        symbol||Id|type|9|9
        symbol|Cart{k}|add|method|11|15
        symbol|Cart{k}|sell|method|17|17
        symbol||deep|function|18|18
        symbol||helper|function|19|19
        call|twice|sell||8|8
        call|add|push||13|13
        call|add|log{k}||14|14
        call|sell|helper||17|17
        import||std::collections::HashMap||0|0
        import||crate::io{k}||0|0
        import||a::b||0|0
    """,
    "csharp": """
        symbol||Seller{k}|struct|5|14
        symbol|Seller{k}|Seller{k}|method|8|8
        symbol|Seller{k}|Sell|method|9|12
        symbol|Seller{k}|Twice|method|13|13
        symbol|Seller{k}|count|field|6|6
        symbol||IBuyer|interface|15|15
        symbol|IBuyer|Buy|method|15|15
        call|Sell|WriteLine||10|10
        call|Sell|Count{k}||11|11
        call|Twice|Add||13|13
        import||System||0|0
        import||System.Math||0|0
    """,
    "c": """
        symbol||SQUARE|function|3|3
        symbol||add{k}|function|7|7
        symbol||point{k}_t|struct|9|9
        symbol||size{k}|type|10|10
        symbol||node|struct|11|11
        symbol||color|type|12|12
        symbol||twice{k}|function|14|20
        call|twice{k}|add{k}||16|16
        call|twice{k}|log_it||18|18
        import||stdio.h||0|0
        import||own{k}.h||0|0
    """,
    "cpp": """
        symbol||Id|type|3|3
        symbol||shop{k}|type|4|16
        symbol||Cart{k}|struct|5|13
        symbol|Cart{k}|Cart{k}|method|7|7
        symbol|Cart{k}|~Cart{k}|method|8|8
        symbol|Cart{k}|size|method|9|9
        symbol|Cart{k}|add|method|10|10
        symbol||largest|function|14|14
        symbol||Color|type|15|15
        symbol|shop{k}::Cart{k}|add|method|17|17
        call|Cart{k}|init||7|7
        call|size|size||9|9
        call|largest|pick{k}||14|14
        call|add|push||17|17
        import||vector||0|0
        import||std||0|0
    """,
    "sql": """
        symbol||users{k}|table|2|4
        symbol||Active{k}|view|5|5
        symbol||mv|view|6|6
        symbol||idx_u|index|7|7
        symbol||f{k}|function|8|8
        symbol||t|trigger|9|9
        symbol||p|procedure|10|10
    """,
    "markdown": """
        symbol||One {k}|section|1|6
        symbol||Two|section|7|9
        symbol||Three {k}|section|10|10
    """,
    "shell": """
        symbol||build{k}|function|3|5
        symbol||clean|function|6|8
    """,
    "http": """
        symbol||GET /x{k}/y|function|2|3
        symbol||POST /|function|7|9
        symbol||DELETE /items/{k}|function|11|11
    """,
    "protobuf": """
        symbol||Svc{k}|interface|5|9
        symbol||Svc{k}.Do|method|7|7
        symbol||Svc{k}.Go|method|8|8
        symbol||M{k}|type|10|12
        symbol||E|type|13|13
    """,
    "text": """
        symbol||f{k}.txt|document|1|3
    """,
}


def rows_of(language: str) -> list[list[str]]:
    """``EXPECTED`` of a language, cut into fields."""
    return [line.strip().split("|") for line in EXPECTED[language].strip().splitlines()]


def files(keys: DataFrame, language: str) -> DataFrame:
    """``path, content``: the source of a language for each supplier."""
    extension, source = SAMPLES[language]
    k = F.col("s_suppkey").cast("string")
    return keys.select(F.concat(F.lit("f"), k, F.lit(f".{extension}")).alias("path"), F.replace(F.lit(source), F.lit("{k}"), k).cast("binary").alias("content"))


def flat(parsed: dict[str, DataFrame]) -> DataFrame:
    """Symbols, calls and imports as rows of one kind."""
    row = lambda path, what, owner, name, kind, first, last: [
        F.col(path).alias("path"), F.lit(what).alias("what"), owner.alias("owner"), F.col(name).alias("name"), kind.alias("kind"), first.cast("int").alias("first_line"), last.cast("int").alias("last_line"),
    ]
    none, zero = F.lit(""), F.lit(0)
    symbols = parsed["symbols"].select(*row("file", "symbol", F.col("receiver"), "name", F.col("kind"), F.col("start_line"), F.col("end_line")))
    calls = parsed["call_edges"].select(*row("caller_file", "call", F.col("caller_symbol"), "callee_symbol", none, F.col("line"), F.col("line")))
    imports = parsed["import_edges"].select(*row("importer_file", "import", none, "imported_path", none, zero, zero))
    return symbols.union(calls).union(imports)


def sql(language: str) -> str:
    """What ``flat`` gives for the files of a language, in SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join("(" + ", ".join(map(quoted, r[:4])) + f", {r[4]}, {r[5]})" for r in rows_of(language))
    own = lambda c: f"replace({c}, '{{k}}', s_suppkey::VARCHAR) AS {c}"
    return f"""SELECT 'f' || s_suppkey || '.{SAMPLES[language][0]}' AS path, what, {own("owner")}, {own("name")}, kind, first_line, last_line
        FROM supplier, (VALUES {listed}) AS expected(what, owner, name, kind, first_line, last_line)"""
