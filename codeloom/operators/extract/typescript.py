"""TypeScript and JavaScript."""

from __future__ import annotations

import re

from .source import C_STYLE, MOST_ARGUMENT, MOST_TAG, NAME, WORDS, CallSite, Found, Import, Scope, Source, Symbol, TypeHint

HIDDEN = C_STYLE + r"|`(?:\\.|[^`\\])*`"
#: Arguments that are hardly functions.
PLAIN_ARGUMENTS = frozenset("true false null undefined this self data value result err error ctx req res options config params args props state key index item name type path url msg message".split())
_MODIFIERS = r"(?:(?:public|private|protected|static|readonly|abstract|override|async|declare|get|set)\s+)*"
_EXPORT = r"(?P<export>export\s+)?(?P<default>default\s+)?"
_TYPE = re.compile(r"^[A-Z]")


def _unwrap(text: str | None) -> str | None:
    if not text:
        return None
    text = " ".join(text.split())
    text = re.sub(r"^Promise<(.+)>$", r"\1", text)
    text = re.sub(r"^Result<(.+?),.+>$", r"\1", text)
    return text if len(text) < 50 and _TYPE.match(text) else None


def _tags(src: Source, at: int, end: int, name: str, kind: str, jsx: bool) -> list[str]:
    tags, before = [], src.code[:at].rstrip()
    while m := re.search(r"@[\w.]+(?:\([^()]*\))?$", before):
        tags.insert(0, src.text[m.start() : m.end()][:MOST_TAG])
        before = before[: m.start()].rstrip()
    if kind == "function" and name[:1].isupper():
        head = src.text[at : src.text.find("=>", at) if "=>" in src.text[at:end] else end]
        if re.search(r":\s*[\w.]*(FC|FunctionComponent|ReactNode|JSX\.Element)\b", head) or jsx and re.search(r"<[A-Za-z>][^<]*", re.sub(r"[\w)\]]<[A-Za-z]", "", src.code[at:end])) and re.search(r"(/>|</)", src.code[at:end]):
            tags.append("component")
    return tags


def extract(text: str, path: str = "") -> Found:
    src, found, heads = Source(text, HIDDEN), Found(), set()
    code, jsx = src.code, path.endswith(("x",))
    made: list[tuple[int, Symbol]] = []

    def add(m: re.Match, kind: str, end: int, opens: str | None = None, body: int | None = None, **more) -> Symbol:
        at, name = m.start("name"), m["name"].lstrip("#")
        first = m.start() + len(m[0]) - len(m[0].lstrip())
        marks = re.match(r"(?:@[\w.]+(?:\([^()]*\))?\s*)+", code[first:at])
        first += marks.end() if marks else 0
        signature = f"{kind} {name}" if kind in ("class", "interface", "enum") else src.signature(first)
        symbol = Symbol(name, kind, src.line(first), src.line(end), signature, src.doc(first), tags=_tags(src, first, end, name, kind, jsx), **more)
        made.append((first, symbol))
        heads.add(m.start("name") + m["name"].startswith("#"))
        if opens:
            full = f"{more['parent_name']}.{name}" if more.get("parent_name") else name
            src.scopes.append(Scope(body if body is not None else at, end, full if opens == "function" else name, opens))
        return symbol

    def hints(parameters: str, scope: str) -> None:
        for p in re.finditer(rf"(?:^|,)\s*{_MODIFIERS}({NAME})\??\s*:\s*([A-Za-z_$][\w$.]*)", parameters):
            if _TYPE.match(p[2]):
                found.type_hints.append(TypeHint(scope, p[1], p[2], "parameter"))

    for m in re.finditer(rf"(?<![\w.$]){_EXPORT}(?:abstract\s+|declare\s+)*class\s+(?P<name>{NAME})(?P<rest>[^{{;]*)\{{", code):
        interfaces = re.search(r"\bimplements\s+(.+)$", m["rest"], re.S)
        listed = [re.sub(r"<.*", "", i).strip() for i in re.split(r",(?![^<]*>)", interfaces[1])] if interfaces else []
        opened = m.end() - 1
        add(m, "class", src.pairs[opened], "class", opened, is_exported=bool(m["export"]), is_default=bool(m["default"]), implements=listed)
        _members(src, found, opened, m["name"], add, heads)
    for kind, pattern in (("interface", rf"(?<![\w.$]){_EXPORT}(?:declare\s+)?interface\s+(?P<name>{NAME})"), ("enum", rf"(?<![\w.$]){_EXPORT}(?:declare\s+|const\s+)*enum\s+(?P<name>{NAME})"), ("type", rf"(?<![\w.$]){_EXPORT}(?:declare\s+)?type\s+(?P<name>{NAME})\s*(?:<[^=]*>)?\s*=")):
        for m in re.finditer(pattern, code):
            body = src.body(m.end()) if kind != "type" else None
            stop = code.find(";", m.end())
            add(m, kind, body[1] if body else stop if stop >= 0 else m.end(), is_exported=bool(m["export"]), is_default=bool(m["default"]))
    for m in re.finditer(rf"(?<![\w.$]){_EXPORT}(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{NAME})\s*(?:<[^(]*>)?\(", code):
        close = src.closing(m.end() - 1)
        body = src.body(close)
        head = code[close + 1 : body[0]] if body else ""
        returned = _unwrap(head.strip().lstrip(":").strip()) if head.strip().startswith(":") else None
        add(m, "function", body[1] if body else close, "function", close, is_exported=bool(m["export"]), is_default=bool(m["default"]), return_type=returned)
        hints(text[m.end() : close], m["name"])
    arrow = rf"(?:async\s+)?(?:function\b[^(]*\(|(?:<[^>]*>\s*)?\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{{]+)?=>)|{NAME}\s*=>)"
    for m in re.finditer(rf"(?<![\w.$])(?P<export>export\s+)?(?:const|let|var)\s+(?P<name>{NAME})\s*(?::[^=;]+)?=\s*{arrow}", code):
        add(m, "function", _end(src, m.end()), "function", m.end(), is_exported=bool(m["export"]))
    for m in re.finditer(rf"(?<![\w.$])(?:module\.)?exports\.(?P<name>{NAME})\s*=\s*(?P<fn>{arrow})?", code):
        if m["fn"]:
            add(m, "function", _end(src, m.end()), "function", m.end(), is_exported=True)
        else:
            _mark(made, {m["name"], code[m.end() :].split(";")[0].strip()})
    for m in re.finditer(rf"(?<![\w.$])(?P<obj>(?!module\b|exports\b|this\b|window\b){NAME})(?:\.prototype)?\.(?P<name>{NAME})\s*=\s*{arrow}", code):
        add(m, "method", _end(src, m.end()), "function", m.end(), is_exported=True, parent_name=m["obj"])
    for m in re.finditer(r"(?<![\w.$])module\.exports\s*=\s*(\{[^}]*\}|[\w$]+)", code):
        _mark(made, set(re.findall(NAME, m[1])))
    for m in re.finditer(r"(?<![\w.$])export\s*\{([^}]*)\}(?!\s*from)", code):
        _mark(made, {n.split()[0] for n in m[1].split(",") if n.strip()})
    for m in re.finditer(rf"(?<![\w.$])export\s+default\s+({NAME})\s*;", code):
        _mark(made, {m[1]}, default=True)
    _imports(src, found)
    for m in re.finditer(rf"(?:const|let|var)\s+({NAME})\s*(?::\s*([A-Za-z_$][\w$.]*)[^=;]*)?(?:=\s*new\s+([A-Z][\w$]*))?", code):
        scope = src.caller(m.start()) or "__module__"
        if m[2] and _TYPE.match(m[2]):
            found.type_hints.append(TypeHint(scope, m[1], m[2], "annotation"))
        elif m[3]:
            found.type_hints.append(TypeHint(scope, m[1], m[3], "constructor"))
    found.symbols = [s for _, s in sorted(made, key=lambda x: x[0])]
    # a receiver is told where it is one plain name
    called = rf"(?:(?<![\w$.\])?!])(?P<on>{NAME})\s*\??\.\s*)?(?P<name>(?<![\w$]){NAME})\s*(?:<[\w\s,<>\[\]]*>)?\((?!\s*\?)"
    constructed = {m.start(1) for m in re.finditer(rf"\bnew\s+({NAME})", code)}
    src.calls(found, called, WORDS | {"constructor"}, heads | constructed, frozenset(("this", "super")))
    for m in re.finditer(rf"\bnew\s+([A-Z][\w$]*)\s*(?:<[^(]*>)?\(", code):
        if caller := src.caller(m.start()):
            found.call_sites.append(CallSite(caller, m[1], None, src.line(m.start())))
    _arguments(src, found, called, PLAIN_ARGUMENTS, heads)
    found.call_sites.sort(key=lambda c: c.line)
    return found


def _end(src: Source, at: int) -> int:
    """Where an arrow function or function expression ends, whose head is matched up to ``at``."""
    if src.code[at - 1] == "(":
        at = src.closing(at - 1) + 1
    m = re.compile(r"=>\s*(\{)?|\{").search(src.code, max(0, at - 2))
    if m and src.code[m.end() - 1] == "{":
        return src.pairs[m.end() - 1]
    stop = re.compile(r";|\n\s*\n|\n(?=\S)").search(src.code, m.end() if m else at)
    return stop.start() if stop else len(src.code)


def _mark(made: list[tuple[int, Symbol]], names: set[str], default: bool = False) -> None:
    for _, symbol in made:
        if symbol.name in names and symbol.parent_name is None:
            symbol.is_exported, symbol.is_default = True, symbol.is_default or default


def _members(src: Source, found: Found, opened: int, owner: str, add, heads: set[int]) -> None:
    code, end = src.code, src.pairs[opened]
    method = re.compile(rf"(?:^|(?<=[;}}{{\n]))[ \t]*(?:@[\w.]+(?:\([^()]*\))?\s*)*{_MODIFIERS}\*?\s*(?P<name>#?{NAME})\s*\??(?:<[^(]*?>)?\(", re.M)
    at = opened + 1
    while (m := method.search(code, at)) and m.start() < end:
        at = m.end()
        if src.block_of(m.start("name")) != opened or m["name"] in WORDS:
            continue
        close = src.closing(m.end() - 1)
        body = src.body(close)
        if not body or re.search(r"[=(]", code[close + 1 : body[0]].split("=>")[0].replace("=>", "")):
            continue
        add(m, "method", body[1], "function", close, parent_name=owner)
        at = close
    field = re.compile(rf"(?:^|(?<=[;}}{{\n]))[ \t]*(?:@[\w.]+(?:\([^()]*\))?\s*)*{_MODIFIERS}(?P<name>#?{NAME})\s*[?!]?\s*(?::[^=;\n(]+)?(?:=(?!=)|;)", re.M)
    at = opened + 1
    while (m := field.search(code, at)) and m.start() < end:
        at = m.end()
        if src.block_of(m.start("name")) == opened and m["name"] not in WORDS:
            stop = code.find(";", m.end() - 1)
            add(m, "variable", stop if stop >= 0 else m.end(), parent_name=owner)


def _imports(src: Source, found: Found) -> None:
    code, text = src.code, src.text
    for m in re.finditer(r"(?<![\w.$])(?P<what>import|export)\b(?P<names>[^;'\"()=]*?)\bfrom\s*(?P<q>['\"])", code):
        source = text[m.end() : text.find(m["q"], m.end())]
        names = re.sub(r"^\s*type\b(?!\s*(?:,|from))", "", m["names"])
        one = Import(source)
        inner = re.search(r"\{([^}]*)\}", names)
        for item in inner[1].split(",") if inner else ():
            words = [w for w in item.split() if w != "type" or item.split() == ["type"]]
            if len(words) == 3 and words[1] == "as":
                one.imported_names.append(words[2])
                one.original_names[words[2]] = words[0]
            elif words:
                one.imported_names.append(words[0])
        rest = re.sub(r"\{[^}]*\}", "", names).strip().strip(",").strip()
        if space := re.search(rf"\*\s*(?:as\s+({NAME}))?", rest):
            one.is_namespace = True
            if space[1]:
                one.imported_names.append(space[1])
        elif m["what"] == "import" and (first := re.match(NAME, rest)):
            one.is_default = True
            one.imported_names.insert(0, first[0])
        found.imports.append(one)
    for m in re.finditer(rf"(?:const|let|var)\s+(?:({NAME})|\{{([^}}]*)\}})\s*=\s*require\(\s*(['\"])", code):
        source = text[m.end() : text.find(m[3], m.end())]
        one = Import(source, [m[1]] if m[1] else [], is_default=bool(m[1]))
        for item in (m[2] or "").split(","):
            words = [w.strip() for w in item.split(":") if w.strip()]
            if words:
                one.imported_names.append(words[-1])
                if len(words) == 2:
                    one.original_names[words[1]] = words[0]
        found.imports.append(one)


def _arguments(src: Source, found: Found, called: str, plain: frozenset[str], heads: set[int]) -> None:
    """Names handed over as arguments may be functions."""
    for m in re.finditer(called, src.code):
        if m["name"] in WORDS or m.start("name") in heads:
            continue
        caller = src.caller(m.start("name"))
        if caller:
            depth, item = 0, []
            close = src.closing(m.end() - 1)
            for i in range(m.end(), close + 1):
                c = src.code[i] if i < close else ","
                if c == "," and not depth:
                    word = "".join(item).strip()
                    if re.fullmatch(NAME, word) and 1 < len(word) < MOST_ARGUMENT and word not in plain:
                        found.call_sites.append(CallSite(caller, word, None, src.line(i - 1)))
                    item = []
                else:
                    depth += (c in "([{") - (c in ")]}")
                    item.append(c)
