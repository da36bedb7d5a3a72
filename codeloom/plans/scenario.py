"""Small literal projects that tests and registered queries share."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import SparkSession

from ..schemas import TABLES


def _frame(spark: SparkSession, table: str, columns: str, rows: list[tuple]):
    from ..schemas import conform

    fields = {f.name: f.dataType.simpleString() for f in TABLES[table]}
    return conform(spark.createDataFrame(rows, ", ".join(f"{c} {fields[c]}" for c in columns.split())), table)


def scenario(spark: SparkSession) -> SimpleNamespace:
    """A book catalogue: a search and its ranking, a web route, a nightly job that imports under another name, and a test."""
    paths = ("app/catalog/search.ts", "app/catalog/ranking.ts", "app/web/routes.ts", "app/jobs/reindex.ts", "tests/catalog/search.test.ts")
    files = _frame(spark, "files", "id path language size hash", [(i, p, "typescript", 900 + 70 * i, f"h{i}") for i, p in enumerate(paths, 1)])
    declared = (  # file, name, lines, exported
        (1, "findBooks", 8, 31, True), (1, "parseFilters", 33, 52, False),
        (2, "rankHits", 4, 27, True), (2, "weighTerm", 29, 40, False),
        (3, "getBooks", 12, 30, True), (3, "sendPage", 32, 47, False),
        (4, "rebuildIndex", 6, 44, True), (5, "checkFinding", 9, 26, False),
    )
    symbols = _frame(spark, "symbols", "id file_id name kind line_start line_end signature is_exported is_default", [(i, f, n, "function", a, z, f"function {n}()", e, False) for i, (f, n, a, z, e) in enumerate(declared, 1)])
    brought = ((1, "./ranking", "rankHits", {}), (3, "../catalog/search", "findBooks", {}), (4, "../catalog/search", "lookup", {"lookup": "findBooks"}), (5, "../../app/catalog/search", "findBooks", {}))
    imports = _frame(spark, "imports", "id file_id source_path imported_names original_names is_default is_namespace", [(i, f, p, [n], o, False, False) for i, (f, p, n, o) in enumerate(brought, 1)])
    called = ((1, "findBooks", "parseFilters", 12), (1, "findBooks", "rankHits", 24), (2, "rankHits", "weighTerm", 15), (3, "getBooks", "findBooks", 18), (3, "getBooks", "sendPage", 27), (4, "rebuildIndex", "lookup", 20), (5, "checkFinding", "findBooks", 14))
    sites = _frame(spark, "call_sites", "id file_id caller_name callee_name receiver_name line", [(i, f, a, z, None, n) for i, (f, a, z, n) in enumerate(called, 1)])
    empty = {t: spark.createDataFrame([], TABLES[t]) for t in ("type_hints", "implements", "co_changes", "type_refs")}
    calls = _frame(spark, "calls", "caller_symbol_id callee_symbol_id line confidence", [(1, 2, 12, 1.0), (1, 3, 24, 1.0), (3, 4, 15, 1.0), (5, 1, 18, 1.0), (5, 6, 27, 1.0), (7, 1, 20, 1.0), (8, 1, 14, 1.0)])
    return SimpleNamespace(files=files, symbols=symbols, imports=imports, call_sites=sites, calls=calls, **empty)


def receivers(spark: SparkSession) -> SimpleNamespace:
    """One call for each way in which a receiver tells its method; the last has none."""
    files = _frame(spark, "files", "id path", [(1, "a.ts"), (2, "b.ts"), (3, "c.ts")])
    rows = [(1, 2, "Store", "class", None), (2, 2, "put", "method", 1), (3, 3, "Disk", "class", None), (4, 3, "put", "method", 3), (5, 2, "Log", "class", None), (6, 2, "note", "method", 5), (7, 2, "Net", "class", None), (8, 2, "send", "method", 7), (9, 3, "Pipe", "class", None), (10, 3, "send", "method", 9)]
    rows += [(20 + i, 1, name, "function", None) for i, name in enumerate(("hint", "interface", "only", "import", "unknown"))]
    symbols = _frame(spark, "symbols", "id file_id name kind parent_symbol_id", rows)
    imports = _frame(spark, "imports", "id file_id source_path imported_names", [(1, 1, "./b", ["Net"])])
    sites = _frame(spark, "call_sites", "id file_id caller_name callee_name receiver_name line", [(1, 1, "hint", "put", "s", 1), (2, 1, "interface", "put", "k", 2), (3, 1, "only", "note", "x", 3), (4, 1, "import", "send", "n", 4), (5, 1, "unknown", "put", "z", 5), (6, 1, "hint", "put", "s", 6)])
    hints = _frame(spark, "type_hints", "id file_id scope variable_name type_name source", [(1, 1, "hint", "s", "Store", "annotation"), (2, 1, "__module__", "k", "Sink", "annotation")])
    implements = _frame(spark, "implements", "class_symbol_id interface_name", [(3, "Sink")])
    return SimpleNamespace(files=files, symbols=symbols, imports=imports, call_sites=sites, type_hints=hints, implements=implements)


#: One source a language.
SOURCES = [
    ("src/shop/cart.ts", '''import { Item, price as cost } from "./item";
import type { Store } from "../store";
import * as util from "util";
export * from "./extra";

/** Adds up a cart. */
export async function total(items: Item[], store: Store): Promise<Money> {
  const tax = new TaxTable();
  store.load(items);
  return items.map(round).reduce(cost, tax.rate());
}

function round(x: number) { return Math.round(x); }

export const discount = (x: number) => round(x * 0.9);

export default class CartController extends Base implements Saver, Loader<Item> {
  private limit = 10;
  #secret: string;

  constructor(private store: Store) { super(); }

  @Post("/cart")
  async checkout(req: Request) {
    const sum = await total(req.items, this.store);
    return this.save(sum);
  }

  private save(sum: number) { return this.store.put(sum, audit); }
}

export interface Saver { save(sum: number): void }
export type Money = { amount: number };
enum Currency { EUR, USD }
const plain = 3;
'''),
    ("lib/legacy.js", '''const { read, write: put } = require("./disk");
const path = require("path");
exports.copy = function (a, b) { put(b, read(a)); };
Queue.prototype.push = function (x) { this.items.add(x); };
function helper() { return path.join("a // not a comment", 'b'); }
module.exports = { helper };
'''),
    ("app/users.py", '''"""Users."""
from .models import User, Token as Tok
from os import *
import json as j

MAX_RETRIES = 3
_HIDDEN = 1


class UserService(Base):
    """Finds users."""

    table: str = "users"

    def __init__(self, db: Database):
        self.db = db

    @staticmethod
    @cached
    def find_by_email(email: str, limit=default_limit()) -> Optional[User]:
        return query(email, transform)

    def _check(self, password):
        return j.loads(password)


def authenticate(service: UserService, email):
    user = service.find_by_email(email)
    return User(user)


async def _later():
    await authenticate(None, "")
'''),
    ("pkg/auth.go", '''package auth

import (
	"fmt"
	db "example.com/x/database"
)

const (
	MaxRetries = 3
	hidden     = 1
)

var Default = New()

// AuthService checks users.
type AuthService struct {
	db *db.Conn
}

type Finder interface { Find(name string) error }
type Name string

// Login lets a user in.
func (s *AuthService) Login(name string) error {
	user := s.db.Find(name)
	if verify(user) { fmt.Println("ok {") }
	return nil
}

func verify(u *User) bool { return u != nil }
'''),
    ("src/auth.rs", '''use std::collections::{HashMap, hash_map::Entry as Slot};
use crate::database::Database;
use super::models::User;

pub const MAX: u32 = 3;

/// Checks users.
pub struct AuthService<'a> { db: &'a Database }
pub enum Role { Admin, Guest }
pub trait Finder { fn find(&self) -> bool; fn always(&self) -> bool { check() } }
pub type Answer = Result<User, String>;

impl AuthService<'_> {
    pub fn new(db: Database) -> Self { let s = build(db); log!("x"); println!("y"); s }
    fn verify(&self, user: &User) -> bool { self.db.find(user) && Role::is_admin(user) }
}

fn build(db: Database) -> AuthService { AuthService::wrap(db) }
'''),
    ("src/Auth.java", '''package app;

import app.models.User;
import java.util.*;

@Service
public class Auth extends Base implements Checker {
    public static final int MAX = 3;
    private User last;

    public Auth(Database db) { init(db); }

    @Override
    public User login(String name) throws Error {
        User u = finder.find(name);
        return verify(u) ? new User(name) : null;
    }

    private boolean verify(User u) { return u != null; }
}

interface Checker { User login(String name); }
enum Role { ADMIN, GUEST }
'''),
    ("lib/auth.rb", '''require 'json'
require_relative 'models/user'

MAX = 3

module Checks
  class Auth < Base
    def login(name)
      user = Finder.find(name)
      return verify(user) if user
      audit name
    end

    def self.create(options)
      new(options)
    end

    private

    def verify(user)
      user.valid? && check_role(user)
    end
  end

  class User
    def show; render(self); end
  end
end

def helper
  puts "x"
end
'''),
    ("src/Auth.cs", '''using System;
using Models = App.Models;

namespace App.Auth
{
    /// <summary>Checks users.</summary>
    [Serializable]
    public class AuthService : IAuth
    {
        public const int Max = 3;
        private static readonly string Key = "k", Other = "o";
        public string Name { get; set; }

        public AuthService(Database db) { Init(db); }

        public User Login(string name)
        {
            var user = finder.Find(name);
            return Verify(user) ? new User(name) : null;
        }

        bool Verify(User user) => Check(user);
    }

    public interface IAuth { User Login(string name); }
    public enum Role { Admin, Guest }
}
'''),
    ("src/Auth.php", '''<?php
namespace App;

use App\\Models\\User;
use App\\Store as Shop;

interface Checker { public function check($x); }
trait Logs { protected function log($x) { write($x); } }

class Auth implements Checker
{
    const MAX = 3;
    private $last;

    public function check($x): ?User
    {
        $user = $this->find($x);
        $shop->save($user);
        Shop::open();
        return new User($user);
    }

    private function find($x) { return lookup($x); }
}

function lookup($x) { return strtolower($x); }
'''),
]

#: What each source declares, by reading it: ending, name, kind, first and last line, whether it is exported, its parent.
DECLARED = [
    line.split(" ")
    for line in """
ts total function 7 11 y -
ts round function 13 13 n -
ts discount function 15 15 y -
ts CartController class 17 30 y -
ts limit variable 18 18 n CartController
ts secret variable 19 19 n CartController
ts constructor method 21 21 n CartController
ts checkout method 24 27 n CartController
ts save method 29 29 n CartController
ts Saver interface 32 32 y -
ts Money type 33 33 y -
ts Currency enum 34 34 n -
py MAX_RETRIES constant 6 6 y -
py _HIDDEN constant 7 7 n -
py UserService class 10 24 y -
py table variable 13 13 y UserService
py __init__ method 15 16 n UserService
py find_by_email method 18 21 y UserService
py _check method 23 24 n UserService
py authenticate function 27 29 y -
py _later function 32 33 n -
go MaxRetries constant 9 9 y -
go hidden constant 10 10 n -
go Default variable 13 13 y -
go AuthService class 16 18 y -
go Finder interface 20 20 y -
go Name type 21 21 y -
go Login method 24 28 y AuthService
go verify function 30 30 n -
rs MAX constant 5 5 y -
rs AuthService class 8 8 y -
rs Role enum 9 9 y -
rs Finder interface 10 10 y -
rs always method 10 10 n Finder
rs Answer type 11 11 y -
rs new method 14 14 y AuthService'_
rs verify method 15 15 n AuthService'_
rs build function 18 18 n -
java Auth class 6 20 y -
java MAX constant 8 8 y Auth
java last variable 9 9 n Auth
java Auth method 11 11 y Auth
java login method 13 17 y Auth
java verify method 19 19 n Auth
java Checker interface 22 22 n -
java login method 22 22 n Checker
java Role enum 23 23 n -
rb MAX constant 4 4 y -
rb Checks class 6 28 y -
rb Auth class 7 23 y Checks
rb login method 8 12 y Auth
rb create method 14 16 y Auth
rb verify method 20 22 n Auth
rb User class 25 27 y Checks
rb show method 26 26 y User
rb helper function 30 32 y -
cs App.Auth class 4 27 y -
cs AuthService class 8 23 y -
cs Max constant 10 10 y AuthService
cs Key constant 11 11 n AuthService
cs Other constant 11 11 n AuthService
cs Name variable 12 12 y AuthService
cs AuthService method 14 14 y AuthService
cs Login method 16 20 y AuthService
cs Verify method 22 22 n AuthService
cs IAuth interface 25 25 y -
cs Login method 25 25 n IAuth
cs Role enum 26 26 y -
php Checker interface 7 7 y -
php check method 7 7 y Checker
php Logs class 8 8 y -
php log method 8 8 y Logs
php Auth class 10 24 y -
php MAX constant 12 12 y Auth
php last variable 13 13 n Auth
php check method 15 21 y Auth
php find method 23 23 n Auth
php lookup function 26 26 y -
""".strip().splitlines()
]
