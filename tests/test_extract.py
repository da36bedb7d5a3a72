"""Extractors on one source a language."""

import pytest

from codeloom.operators.extract import EXTRACTORS
from codeloom.plans.scenario import SOURCES

LANGUAGE = {".ts": "typescript", ".js": "javascript", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".cs": "csharp", ".php": "php"}


def found(ending):
    path, text = next((p, t) for p, t in SOURCES if p.endswith(ending))
    return EXTRACTORS[LANGUAGE[ending]](text, path)


def symbols(f):
    return {(s.parent_name, s.name): s for s in f.symbols}


def calls(f):
    return {(c.caller_name, c.callee_name, c.receiver_name) for c in f.call_sites}


def imports(f):
    return {i.source_path: i for i in f.imports}


def test_typescript():
    f = found(".ts")
    s = symbols(f)
    assert s[None, "total"].is_exported and "Adds up" in s[None, "total"].doc_comment and s[None, "total"].return_type == "Money"
    assert not s[None, "round"].is_exported and s[None, "CartController"].implements == ["Saver", "Loader"]
    assert s["CartController", "checkout"].tags == ['@Post("/cart")'] and s["CartController", "secret"].kind == "variable"
    assert (None, "plain") not in s and s[None, "Saver"].kind == "interface" and s[None, "Money"].kind == "type" and s[None, "Currency"].kind == "enum"
    assert {("total", "TaxTable", None), ("total", "load", "store"), ("total", "round", None), ("total", "cost", None), ("CartController.checkout", "total", None), ("CartController.save", "audit", None), ("discount", "round", None)} <= calls(f)
    i = imports(f)
    assert i["./item"].imported_names == ["Item", "cost"] and i["./item"].original_names == {"cost": "price"}
    assert i["util"].is_namespace and i["./extra"].is_namespace and i["../store"].imported_names == ["Store"]
    hints = {(h.scope, h.variable_name, h.type_name, h.source) for h in f.type_hints}
    assert {("total", "store", "Store", "parameter"), ("total", "tax", "TaxTable", "constructor")} <= hints


def test_javascript():
    f = found(".js")
    s = symbols(f)
    assert s[None, "copy"].is_exported and s["Queue", "push"].kind == "method" and s[None, "helper"].is_exported
    assert imports(f)["./disk"].original_names == {"put": "write"} and imports(f)["path"].is_default
    assert {("copy", "put", None), ("copy", "read", None), ("helper", "join", "path")} <= calls(f)


def test_python():
    f = found(".py")
    s = symbols(f)
    assert s[None, "MAX_RETRIES"].kind == "constant" and s[None, "UserService"].doc_comment == "Finds users."
    method = s["UserService", "find_by_email"]
    assert method.signature == "def find_by_email(email: str, limit=default_limit()) -> Optional[User]" and method.return_type == "User" and method.line_start == 18
    assert not s["UserService", "_check"].is_exported and not s[None, "_later"].is_exported
    assert {("UserService.find_by_email", "cached", None), ("UserService.find_by_email", "default_limit", None), ("UserService.find_by_email", "transform", None), ("authenticate", "find_by_email", None), ("authenticate", "User", None), ("_later", "authenticate", None)} <= calls(f)
    i = imports(f)
    assert i[".models"].original_names == {"Tok": "Token"} and i["os"].is_namespace and i["json"].imported_names == ["j"]
    assert ("authenticate", "service", "UserService", "parameter") in {(h.scope, h.variable_name, h.type_name, h.source) for h in f.type_hints}


def test_python_survives_errors():
    f = EXTRACTORS["python"]("def good():\n    return 1\n\ndef bad(:\n    pass\n\nclass Fine:\n    def m(self):\n        good()\n", "x.py")
    assert {"good", "Fine"} <= {s.name for s in f.symbols}


def test_go():
    f = found(".go")
    s = symbols(f)
    assert s["AuthService", "Login"].kind == "method" and s["AuthService", "Login"].doc_comment == "// Login lets a user in."
    assert s[None, "AuthService"].kind == "class" and s[None, "Finder"].kind == "interface" and s[None, "Name"].kind == "type"
    assert s[None, "MaxRetries"].is_exported and not s[None, "hidden"].is_exported and s[None, "Default"].kind == "variable"
    assert {("AuthService.Login", "Find", None), ("AuthService.Login", "verify", None), ("AuthService.Login", "Println", None)} <= calls(f)
    assert imports(f)["example.com/x/database"].imported_names == ["db"] and imports(f)["fmt"].is_namespace


def test_rust():
    f = found(".rs")
    s = {x.name: x for x in f.symbols}
    assert s["new"].kind == "method" and s["new"].is_exported and not s["verify"].is_exported and s["build"].kind == "function"
    assert s["AuthService"].doc_comment == "/// Checks users." and s["Finder"].kind == "interface" and s["Answer"].kind == "type" and s["MAX"].kind == "constant"
    assert {"build", "log", "find", "is_admin", "wrap", "check"} <= {c for _, c, _ in calls(f)} and "println" not in {c for _, c, _ in calls(f)}
    i = imports(f)
    assert i["database"].imported_names == ["Database"] and i["../models"].imported_names == ["User"]
    assert i["std/collections"].imported_names == ["HashMap"] and i["std/collections/hash_map"].original_names == {"Slot": "Entry"}


def test_java():
    f = found(".java")
    s = symbols(f)
    assert s["Auth", "MAX"].kind == "constant" and s["Auth", "last"].kind == "variable" and s["Auth", "Auth"].kind == "method"
    assert s["Auth", "login"].is_exported and s["Auth", "login"].tags == ["@Override"] and not s["Auth", "verify"].is_exported
    assert {("Auth.login", "find", None), ("Auth.login", "verify", None), ("Auth.login", "User", None), ("Auth.Auth", "init", None)} <= calls(f)
    assert imports(f)["app.models"].imported_names == ["User"] and imports(f)["java.util"].is_namespace


def test_ruby():
    f = found(".rb")
    s = symbols(f)
    assert s["Checks", "Auth"].signature == "class Auth < Base" and s["Auth", "login"].is_exported and not s["Auth", "verify"].is_exported
    assert s["Auth", "create"].is_exported and s["User", "show"].is_exported and s[None, "helper"].kind == "function"
    assert {("Auth.login", "find", "Finder"), ("Auth.login", "verify", None), ("Auth.login", "audit", None), ("Auth.verify", "check_role", None), ("User.show", "render", None)} <= calls(f)
    assert "puts" not in {c for _, c, _ in calls(f)} and imports(f)["./models/user"].imported_names == ["user"]


def test_csharp():
    f = found(".cs")
    s = symbols(f)
    assert s["AuthService", "Key"].kind == "constant" and s["AuthService", "Other"].kind == "constant" and s["AuthService", "Name"].kind == "variable"
    assert s["AuthService", "Login"].is_exported and not s["AuthService", "Verify"].is_exported and s[None, "App.Auth"].kind == "class"
    assert s[None, "AuthService"].tags == ["[Serializable]"] and "Checks users" in s[None, "AuthService"].doc_comment
    assert {("AuthService.Login", "Find", None), ("AuthService.Login", "Verify", None), ("AuthService.Login", "User", None)} <= calls(f)


def test_php():
    f = found(".php")
    s = symbols(f)
    assert s["Auth", "check"].return_type == "User" and not s["Auth", "find"].is_exported and s["Auth", "last"].kind == "variable" and s[None, "Logs"].kind == "class"
    assert {("Auth.check", "find", None), ("Auth.check", "save", "shop"), ("Auth.check", "open", "Shop"), ("Auth.check", "User", None), ("lookup", "strtolower", None)} <= calls(f)
    assert imports(f)["App\\Store"].original_names == {"Shop": "Store"}


@pytest.mark.parametrize("language", sorted(EXTRACTORS))
def test_any_text_is_survived(language):
    for text in ("", "}}}{{{", "class", "def x(:\n", "\x00 é😀", "/* never closed", '"' * 7, "function (" * 50):
        EXTRACTORS[language](text, "x")
