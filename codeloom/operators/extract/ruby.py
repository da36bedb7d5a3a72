"""Ruby: declarations line by line, scopes by ``end``."""

from __future__ import annotations

import re

from .source import NAME, WORDS, CallSite, Found, Import, Scope, Source, Symbol

HIDDEN = r"(?P<comment>#(?!\{)[^\n]*|^=begin.*?^=end)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"
#: Words that are hardly calls.
PLAIN_CALLS = frozenset("puts print p pp raise require require_relative include extend attr_accessor attr_reader attr_writer private protected public".split())
_METHOD = r"[A-Za-z_]\w*[?!=]?"
#: A line that opens something an ``end`` closes.
_OPENS = re.compile(r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b(?!.*\bend\b\s*$)|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|unless|case|begin)\b(?!.*\bend\b\s*$)")
_ONE_LINE_DEF = re.compile(rf"^\s*def\s+(?:self\.)?{_METHOD}\s*(?:\([^)]*\))?\s*=\s")


def extract(text: str, path: str = "") -> Found:
    src, found = Source(text, HIDDEN), Found()
    lines, starts = src.code.split("\n"), [0, *(n + 1 for n in src.newlines)]
    stack: list[tuple[str, Symbol | None, str]] = []  # (what, symbol, visibility to go back to)
    visibility = "public"
    spans: list[tuple[Symbol, int]] = []
    for number, line in enumerate(lines):
        at = starts[number]
        owners = [s.name for what, s, _ in stack if what in ("class", "module") and s]
        inside = any(what == "def" for what, _, _ in stack)
        opened = bool(_OPENS.search(line)) and not _ONE_LINE_DEF.match(line)
        if m := re.match(rf"\s*(class|module)\s+(?!<<)([A-Z][\w:]*)(?:\s*<\s*([\w:]+))?", line):
            name = m[2].split("::")[-1]
            signature = f"{m[1]} {name}" + (f" < {m[3]}" if m[3] else "")
            symbol = Symbol(name, "class", number + 1, number + 1, signature, src.doc(at), True, parent_name=owners[-1] if owners else None)
            found.symbols.append(symbol)
            if opened:
                stack.append((m[1], symbol, visibility))
                visibility = "public" if m[1] == "class" else visibility
        elif m := re.match(rf"\s*(?:(private|protected|public)\s+)?def\s+(self\.)?({_METHOD})", line):
            owner = owners[-1] if owners else None
            shown = (m[1] or ("public" if m[2] else visibility)) == "public"
            symbol = Symbol(m[3], "method" if owner else "function", number + 1, number + 1, src.signature(at + len(line) - len(line.lstrip())), src.doc(at), shown, parent_name=owner)
            found.symbols.append(symbol)
            if opened:
                stack.append(("def", symbol, visibility))
                spans.append((symbol, at))
            else:
                src.scopes.append(Scope(at, at + len(line), f"{owner}.{m[3]}" if owner else m[3], "function"))
        elif opened:
            stack.append(("block", None, visibility))
        elif (m := re.match(r"\s*(private|protected|public)\s*$", line)) and not inside:
            visibility = m[1]
        elif (m := re.match(r"\s*([A-Z]\w*)\s*=(?!=)", line)) and not inside:
            found.symbols.append(Symbol(m[1], "constant", number + 1, number + 1, src.line_text(at), src.doc(at), True, parent_name=owners[-1] if owners else None))
        if m := re.match(r"\s*(require|require_relative)\s*\(?\s*['\"]", line):
            quoted = re.search(r"['\"]([^'\"]+)['\"]", text[at : at + len(line)])
            if quoted:
                source = ("./" if m[1] == "require_relative" else "") + quoted[1]
                found.imports.append(Import(source, [quoted[1].split("/")[-1]]))
        if re.match(r"\s*end\b", line) and stack:
            what, symbol, back = stack.pop()
            if symbol:
                symbol.line_end = number + 1
            if what in ("class", "module"):
                visibility = back
            for i, (s, a) in enumerate(spans):
                if s is symbol:
                    src.scopes.append(Scope(a, at, f"{s.parent_name}.{s.name}" if s.parent_name else s.name, "function"))
                    spans.pop(i)
                    break
    heads = {m.start(1) for m in re.finditer(rf"\bdef\s+(?:self\.)?({_METHOD})", src.code)}
    skip = WORDS | PLAIN_CALLS | {"self", "nil", "true", "false", "end", "do", "begin", "rescue", "ensure", "then", "module", "alias", "next", "break", "redo", "retry", "undef"}
    # with brackets or a receiver, or bare before an argument
    pattern = rf"(?:(?P<on>(?<![\w.@:)\]]){NAME})\s*&?\.\s*)?(?P<name>(?<![\w@$:]){_METHOD})(?=\s*\(|(?<=[?!])|[ \t]+(?:[:@\"'A-Za-z_\[]))"
    for m in re.finditer(pattern + rf"|(?P<on2>(?<![\w.@:)\]]){NAME})\s*&?\.\s*(?P<name2>{_METHOD})|(?<=[)\]\w])\.(?P<name3>{_METHOD})", src.code):
        name, on = (m["name"] or m["name2"] or m["name3"]), (m["on"] or m["on2"])
        at = m.start("name") if m["name"] else m.start("name2") if m["name2"] else m.start("name3")
        bare = m["name"] and not m["on"] and not re.match(r"\s*\(", src.code[m.end("name") :])
        if name in skip or at in heads or len(name) >= 100 or bare and not re.match(r"[ \t]*$|.*(?:[;=]|\breturn|\bif|\bunless|&&|\|\|)\s*$", src.code[src.code.rfind("\n", 0, at) + 1 : at]) or bare and re.match(r"[ \t]+(?:if|unless|and|or|do|then|in|while|until)\b", src.code[m.end("name") :]):
            continue
        if caller := src.caller(at):
            found.call_sites.append(CallSite(caller, name, on if on and on != "self" and on not in WORDS else None, src.line(at)))
    found.call_sites.sort(key=lambda c: c.line)
    return found
