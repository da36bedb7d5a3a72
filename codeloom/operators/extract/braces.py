"""Go, Rust, Java, C# and PHP: declarations found by pattern in masked text, scopes by braces."""

from __future__ import annotations

import re

from .source import C_STYLE, MOST_TAG, NAME, WORDS, CallSite, Found, Import, Scope, Source, Symbol, short

#: Macros that are hardly calls.
PLAIN_MACROS = frozenset("println print eprintln eprint format vec dbg todo unimplemented unreachable assert assert_eq assert_ne debug_assert cfg include env".split())
_CALL = rf"(?<![\w$])(?P<name>{NAME})\s*\("


class _Maker:
    """Collects symbols with their places, and opens scopes."""

    def __init__(self, src: Source):
        self.src, self.made, self.heads = src, [], set()

    def add(self, at: int, name: str, name_at: int, kind: str, end: int, opens: str | None = None, **more) -> Symbol:
        src = self.src
        more.setdefault("signature", src.signature(at))
        more.setdefault("doc_comment", src.doc(at))
        symbol = Symbol(name, kind, src.line(at), src.line(end), **more)
        self.made.append((at, symbol))
        self.heads.add(name_at)
        if opens:
            full = f"{symbol.parent_name}.{name}" if symbol.parent_name and opens == "function" else name
            src.scopes.append(Scope(at, end, full, opens))
        return symbol

    def done(self) -> Found:
        return Found(symbols=[s for _, s in sorted(self.made, key=lambda x: x[0])])


def _start(m: re.Match) -> int:
    return m.start() + len(m[0]) - len(m[0].lstrip())


def go(text: str, path: str = "") -> Found:
    src = Source(text, C_STYLE + r"|`[^`]*`")
    make, code = _Maker(src), src.code
    for m in re.finditer(rf"^func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<on>\w+)[^)]*\)\s*)?(?P<name>{NAME})\s*(?:\[[^\]]*\])?\(", code, re.M):
        close = src.closing(m.end() - 1)
        body = re.compile(r"(?<!interface)(?<!struct)\{").search(code, close)
        end = src.pairs[body.start()] if body and "\nfunc " not in code[close : body.start()] else close
        make.add(m.start(), m["name"], m.start("name"), "method" if m["on"] else "function", end, "function", is_exported=m["name"][0].isupper(), parent_name=m["on"])
    for m in re.finditer(rf"^(?:type\s+|[ \t]+)(?P<name>{NAME})(?:\[[^\]]*\])?\s+(?P<what>struct|interface|=?\s*[\w.*\[\]]+)", code, re.M):
        block = code[: m.start()].rfind("type (")
        if not m[0].startswith("type") and (block < 0 or ")" in code[block : m.start()].replace("()", "")):
            continue
        kind = {"struct": "class", "interface": "interface"}.get(m["what"], "type")
        body = src.body(m.end(), "\n") if kind != "type" else None
        make.add(_start(m), m["name"], m.start("name"), kind, body[1] if body else m.end(), signature=f"type {m['name']} {m['what']}", is_exported=m["name"][0].isupper())
    for m in re.finditer(r"^[ \t]*(const|var)\s*(\(|)", code, re.M):
        kind = "constant" if m[1] == "const" else "variable"
        if m[2]:
            inner, base = code[m.end() : src.closing(m.end() - 1)], m.end()
            rows = [(base + r.start(1), r[1]) for r in re.finditer(rf"^[ \t]*({NAME})\b[^\n]*", inner, re.M)]
        else:
            r = re.compile(rf"\s*({NAME})").match(code, m.end())
            rows = [(r.start(1), r[1])] if r else []
        for at, name in rows:
            make.add(at, name, at, kind, at, signature=src.line_text(at), is_exported=name[0].isupper())
    found = make.done()
    for m in re.finditer(r"^import\s*(\((?P<many>[^)]*)\)|[^\n]*)", code, re.M):
        for item in re.finditer(r"(?:([\w.]+)[ \t]+)?\"([^\"\n]+)\"", text[m.start() : m.end()]):
            found.imports.append(Import(item[2], [item[1] if item[1] and item[1] != "import" else item[2].split("/")[-1]], is_namespace=True))
    src.calls(found, _CALL, WORDS, make.heads)
    return found


def _rust_path(path: str) -> str:
    path = re.sub(r"^crate::", "", path.strip())
    return re.sub(r"^super::", "../", re.sub(r"^self::", "./", path)).replace("::", "/")


def _rust_uses(prefix: str, body: str):
    """(path, name, original) of a use tree."""
    body, depth, item, items = body.strip(), 0, "", []
    for c in body + ",":
        if c == "," and not depth:
            items.append(item.strip())
            item = ""
        else:
            depth += (c == "{") - (c == "}")
            item += c
    for item in filter(None, items):
        if m := re.fullmatch(r"(.*?)::\s*\{(.*)\}", item, re.S):
            yield from _rust_uses(f"{prefix}::{m[1]}" if prefix else m[1], m[2])
            continue
        path, _, renamed = (x.strip() for x in item.partition(" as "))
        head, _, last = path.rpartition("::")
        whole = "::".join(p for p in (prefix, head) if p)
        if last and last != "*":
            yield whole, renamed or (whole.rpartition("::")[2] if last == "self" else last), last


def rust(text: str, path: str = "") -> Found:
    src = Source(text, r"(?P<comment>//[^\n]*|/\*.*?\*/)|r#\".*?\"#|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'")
    make, code = _Maker(src), src.code
    seen = r"(?P<pub>pub(?:\([^)]*\))?\s+)?"
    owners: list[tuple[int, int, str]] = []
    for m in re.finditer(r"^[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?P<what>[^{]+?)\s*(?:where[^{]*)?\{", code, re.M):
        name = re.sub(r"[<>]", "", m["what"].split(" for ")[-1].strip())
        owners.append((m.start(), src.pairs[m.end() - 1], name))
    for kind, word in (("class", "struct"), ("enum", "enum"), ("interface", "trait"), ("type", "type"), ("constant", "const|static")):
        for m in re.finditer(rf"^[ \t]*{seen}(?:unsafe\s+)?(?:{word})\s+(?:mut\s+)?(?P<name>{NAME})", code, re.M):
            body = src.body(m.end()) if kind in ("class", "enum", "interface") else None
            end = body[1] if body else code.find(";", m.end())
            inside = next((o for a, b, o in owners if a < m.start() < b), None)
            if kind in ("type",) and inside:
                continue
            make.add(_start(m), m["name"], m.start("name"), kind, end if end >= 0 else m.end(), is_exported=bool(m["pub"]))
            if kind == "interface" and body:
                owners.append((m.start(), body[1], m["name"]))
    for m in re.finditer(rf"(?<![\w:]){seen}(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+(?P<name>{NAME})", code, re.M):
        body = src.body(m.end())
        if not body:
            continue
        around = [o for o in owners if o[0] < m.start() < o[1]]
        owner = max(around)[2] if around else None
        make.add(_start(m), m["name"], m.start("name"), "method" if owner else "function", body[1], "function", is_exported=bool(m["pub"]), parent_name=owner)
    found = make.done()
    for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", code, re.M):
        paths: dict[str, Import] = {}
        for where, name, original in _rust_uses("", m[1]):
            one = paths.setdefault(where, Import(_rust_path(where)))
            one.imported_names.append(name)
            if name != original and original != "self":
                one.original_names[name] = original
        found.imports += paths.values()
    src.calls(found, rf"(?<![\w$])(?P<name>{NAME})\s*(?:::<[^(]*>)?\(", WORDS | {"Some", "Ok", "Err", "None"}, make.heads)
    for m in re.finditer(rf"(?<![\w$])({NAME})!\s*[(\[{{]", code):
        if (caller := src.caller(m.start())) and m[1] not in PLAIN_MACROS and len(m[1]) < 50:
            found.call_sites.append(CallSite(caller, m[1], None, src.line(m.start())))
    found.call_sites.sort(key=lambda c: c.line)
    return found


def _annotations(src: Source, at: int, pattern: str) -> list[str]:
    tags, before = [], src.code[:at].rstrip()
    while m := re.search(pattern + r"$", before):
        tags.insert(0, src.text[m.start() : m.end()][:MOST_TAG])
        before = before[: m.start()].rstrip()
    return tags


def _typed(text: str, hidden: str, marks: str, types: str, kinds: dict[str, str], modifiers: str, shown, constant, scoped: frozenset[str], tag: str, header) -> tuple[Source, _Maker]:
    """What Java and C# have in common: types, members by the block they stand in, constructors, fields."""
    src = Source(text, hidden)
    make, code = _Maker(src), src.code
    blocks: dict[int, str] = {}
    for m in re.finditer(rf"(?P<mods>(?:(?:{modifiers})\s+)*)(?<![\w.])(?P<what>{types})\s+(?P<name>{NAME})[^{{;()]*(?:\([^)]*\)[^{{;]*)?\{{", code):
        opened, kind = m.end() - 1, kinds[m["what"].split()[0]]
        outer = blocks.get(src.block_of(m.start("what")))
        blocks[opened] = m["name"]
        make.add(_start(m), m["name"], m.start("name"), kind, src.pairs[opened], "class" if m["what"] in scoped else None, is_exported=shown(m["mods"]), parent_name=outer, tags=_annotations(src, m.start(), tag), signature=header(src, m))
    member = re.compile(rf"(?P<mods>(?:(?:{modifiers})\s+)*)(?:<[^>(]*>\s*)?(?:(?P<type>[A-Za-z_][\w.<>,\[\]? ]*?)\s+)?(?P<name>{NAME})\s*(?:<[\w, ]*>)?\((?=[^;{{}}]*\)[^;{{}}()]*(?:\([^)]*\)[^;{{}}()]*)?(?:[{{;]|=>))")
    for m in member.finditer(code):
        owner = blocks.get(src.block_of(m.start("name")))
        if owner is None or m["name"] in WORDS or m["type"] in ("new", "return", "else", "throw", "await") or (not m["type"] and m["name"] != owner) or "=" in code[code.rfind("\n", 0, m.start("name")) : m.start("name")]:
            continue
        close = src.closing(m.end() - 1)
        rest = re.compile(r"[{;]|=>").search(code, close)
        end = src.pairs[rest.start()] if rest and rest[0] == "{" else code.find(";", close)
        returned = " ".join((m["type"] or "").split()) or None
        make.add(_start(m), m["name"], m.start("name"), "method", end if end >= 0 else close, "function", is_exported=shown(m["mods"]), parent_name=owner, tags=_annotations(src, _start(m), tag), return_type=returned if returned and len(returned) <= 100 and marks == "C#" else returned if returned and returned[0].isupper() and len(returned) < 50 else None)
    fields = re.compile(rf"^[ \t]*(?P<mods>(?:(?:{modifiers})\s+)*)(?P<type>[A-Za-z_][\w.<>,\[\]?]*(?:\s*<[^;=(]*>)?)\s+(?P<names>{NAME}(?:\s*=[^;]*|\s*,[^;(]*)?);", re.M)
    for m in fields.finditer(code):
        owner = blocks.get(src.block_of(m.start("names")))
        if owner is None or m["type"] in WORDS or m["type"] in ("package", "using", "import", "namespace"):
            continue
        names = re.split(r",(?![^<(\[{]*[>)\]}])", m["names"])
        for item in names[: 1 if marks == "Java" else None]:
            name = re.match(NAME, item.strip())
            if name:
                at = m.start("names") + m["names"].find(name[0])
                make.add(_start(m), name[0], at, constant(m["mods"]), m.end(), is_exported=shown(m["mods"]), parent_name=owner, signature=src.line_text(_start(m)))
    return src, make


def java(text: str, path: str = "") -> Found:
    kinds = {"class": "class", "record": "class", "interface": "interface", "enum": "enum", "@interface": "interface"}
    src, make = _typed(
        text, C_STYLE + r'|""".*?"""', "Java", r"class|interface|enum|record", kinds, r"@[\w.]+(?:\([^()]*\))?|public|protected|private|static|final|abstract|synchronized|native|default|transient|volatile|sealed|strictfp",
        lambda mods: "public" in mods or "protected" in mods, lambda mods: "constant" if "static" in mods and "final" in mods else "variable", frozenset(("class", "interface", "record")), r"@[\w.]+(?:\([^()]*\))?", lambda s, m: s.signature(_start(m))
    )
    for at, symbol in make.made:
        head = re.match(r"(?:@[\w.]+(?:\([^()]*\))?\s*)+", src.code[at:])
        symbol.tags = [t[:MOST_TAG] for t in re.findall(r"@[\w.]+(?:\([^()]*\))?", src.text[at : at + head.end()])] if head else symbol.tags
    found = make.done()
    for m in re.finditer(r"^import\s+(?:static\s+)?([\w.]+?)\.(\w+|\*)\s*;", src.code, re.M):
        found.imports.append(Import(m[1], [] if m[2] == "*" else [m[2]], is_namespace=m[2] == "*"))
    made = {m.start(1) for m in re.finditer(rf"\bnew\s+({NAME})", src.code)}
    src.calls(found, _CALL, WORDS, make.heads | made)
    _constructed(src, found)
    return found


def _constructed(src: Source, found: Found) -> None:
    for m in re.finditer(rf"\bnew\s+\\?(?:{NAME}[.\\])*({NAME})\s*(?:<[^(]*>)?\s*[({{]", src.code):
        if caller := src.caller(m.start()):
            found.call_sites.append(CallSite(caller, m[1], None, src.line(m.start())))
    found.call_sites.sort(key=lambda c: c.line)


def csharp(text: str, path: str = "") -> Found:
    kinds = {"class": "class", "struct": "class", "record": "class", "interface": "interface", "enum": "enum", "namespace": "class"}
    src, make = _typed(
        text, r'(?P<comment>//[^\n]*|/\*.*?\*/)|@"(?:""|[^"])*"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', "C#", r"class|struct|interface|enum|record", kinds, r"public|protected|private|internal|static|readonly|const|abstract|sealed|virtual|override|async|partial|extern|unsafe|new|volatile|required",
        lambda mods: "public" in mods or "protected" in mods, lambda mods: "constant" if "const" in mods.split() or "static" in mods and "readonly" in mods else "variable", frozenset(("class", "struct", "interface", "record")), r"\[[^\[\]]*\]", lambda s, m: s.signature(_start(m))
    )
    code = src.code
    for m in re.finditer(r"^[ \t]*namespace\s+(?P<name>[\w.]+)\s*(?P<open>[{;])", code, re.M):
        end = src.pairs[m.end() - 1] if m["open"] == "{" else len(code)
        make.add(_start(m), m["name"], m.start("name"), "class", end, is_exported=True)
    for m in re.finditer(rf"^[ \t]*(?P<mods>(?:(?:public|protected|private|internal|static|virtual|override|abstract|required|new)\s+)*)(?P<type>[A-Za-z_][\w.<>,\[\]? ]*?)\s+(?P<name>{NAME})\s*\{{\s*(?:(?:private|protected|internal)\s+)?(?:get|set|init)\b", code, re.M):
        owner = src.scope_at(m.start("name"), "class")
        brace = code.find("{", m.end("name"))
        make.add(_start(m), m["name"], m.start("name"), "variable", src.pairs[brace], is_exported="public" in m["mods"] or "protected" in m["mods"], parent_name=owner.name if owner else None, signature=src.signature(_start(m)))
    found = make.done()
    for m in re.finditer(r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;", code, re.M):
        found.imports.append(Import(m[2], [m[1] or m[2].split(".")[-1]], {m[1]: m[2].split(".")[-1]} if m[1] else {}, is_namespace=True))
    made = {m.start(1) for m in re.finditer(rf"\bnew\s+({NAME})", code)}
    src.calls(found, rf"(?<![\w$])(?P<name>{NAME})\s*(?:<[\w\s,<>]*>)?\(", WORDS, make.heads | made)
    _constructed(src, found)
    return found


def php(text: str, path: str = "") -> Found:
    src = Source(text, r"(?P<comment>//[^\n]*|#(?!\[)[^\n]*|/\*.*?\*/)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'")
    make, code = _Maker(src), src.code
    mods = r"(?P<mods>(?:(?:public|protected|private|static|abstract|final|readonly|var)\s+)*)"
    owners: list[tuple[int, int, str]] = []
    for m in re.finditer(rf"^[ \t]*(?:(?:abstract|final|readonly)\s+)*(?P<what>class|interface|trait|enum)\s+(?P<name>{NAME})[^{{;]*\{{", code, re.M):
        kind = {"trait": "class"}.get(m["what"], m["what"])
        end = src.pairs[m.end() - 1]
        owners.append((m.end() - 1, end, m["name"]))
        make.add(_start(m), m["name"], m.start("name"), kind, end, "class", is_exported=True, signature=short(src.line_text(_start(m)).split("{")[0].strip()))
    owner_of = lambda at: next((o for a, _, o in owners if src.block_of(at) == a), None)
    hidden = lambda m: "private" in m["mods"]
    for m in re.finditer(rf"(?<![\w$]){mods}function\s+&?(?P<name>{NAME})\s*\(", code):
        owner, close = owner_of(m.start("name")), src.closing(m.end() - 1)
        body = src.body(close)
        returned = re.match(r"\)\s*:\s*\??\s*([\w\\|]+)", code[close:])
        make.add(_start(m), m["name"], m.start("name"), "method" if owner else "function", body[1] if body else close, "function", is_exported=not owner or not hidden(m), parent_name=owner, return_type=returned[1] if returned else None)
    for m in re.finditer(rf"^[ \t]*{mods}const\s+(?:[\w?|]+\s+)?(?P<name>{NAME})\s*=[^;]*;", code, re.M):
        if owner := owner_of(m.start("name")):
            make.add(_start(m), m["name"], m.start("name"), "constant", m.end(), is_exported=not hidden(m), parent_name=owner, signature=src.line_text(_start(m)))
    for m in re.finditer(rf"^[ \t]*(?P<mods>(?:(?:public|protected|private|static|readonly|var)\s+)+)(?:[\w?|\\]+\s+)?\$(?P<name>{NAME})", code, re.M):
        if owner := owner_of(m.start("name")):
            make.add(_start(m), m["name"], m.start("name"), "variable", code.find(";", m.end()), is_exported=not hidden(m), parent_name=owner, signature=src.line_text(_start(m)))
    found = make.done()
    for m in re.finditer(r"^use\s+(?:function\s+|const\s+)?([^;({]+)(?:\{([^}]*)\})?;", code, re.M):
        items = [m[1].rstrip() + x.strip() for x in m[2].split(",") if x.strip()] if m[2] else m[1].split(",")
        for item in items:
            full, _, alias = (x.strip() for x in item.strip().partition(" as "))
            last = full.split("\\")[-1]
            found.imports.append(Import(full, [alias or last], {alias: last} if alias else {}))
    skip = WORDS | frozenset("echo isset empty unset array list exit die include include_once require_once print match".split())
    src.calls(found, rf"(?:(?P<on>(?<![\w\\$>:])\$?{NAME})\s*(?:\??->|::)\s*)?(?P<name>(?<![\w$\\]){NAME})\s*\(", skip, make.heads | {m.start(1) for m in re.finditer(rf"\bnew\s+\\?(?:{NAME}\\)*({NAME})", code)}, frozenset(("$this", "self", "static", "parent")))
    for site in found.call_sites:
        if site.receiver_name:
            site.receiver_name = site.receiver_name.lstrip("$")
    _constructed(src, found)
    return found
