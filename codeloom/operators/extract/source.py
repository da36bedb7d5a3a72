"""What the extractors share: masked text, blocks, scopes, and the records they fill."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

#: Lengths at which texts are cut.
MOST_SIGNATURE, MOST_CALLEE, MOST_TAG, MOST_ARGUMENT = 200, 100, 80, 60
NAME = r"[A-Za-z_$][\w$]*"


@dataclass
class Symbol:
    name: str
    kind: str
    line_start: int
    line_end: int
    signature: str = ""
    doc_comment: str | None = None
    is_exported: bool = False
    is_default: bool = False
    parent_name: str | None = None
    tags: list[str] = field(default_factory=list)
    return_type: str | None = None
    implements: list[str] = field(default_factory=list)


@dataclass
class Import:
    source_path: str
    imported_names: list[str] = field(default_factory=list)
    original_names: dict[str, str] = field(default_factory=dict)
    is_default: bool = False
    is_namespace: bool = False


@dataclass
class CallSite:
    caller_name: str
    callee_name: str
    receiver_name: str | None
    line: int


@dataclass
class TypeHint:
    scope: str
    variable_name: str
    type_name: str
    source: str


@dataclass
class Found:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    call_sites: list[CallSite] = field(default_factory=list)
    type_hints: list[TypeHint] = field(default_factory=list)


def short(text: str) -> str:
    return text if len(text) <= MOST_SIGNATURE else text[:MOST_SIGNATURE] + "..."


@dataclass
class Scope:
    """A declaration that calls may stand in: its range, its name as a caller, and what kind of scope it opens."""

    start: int
    end: int
    name: str
    opens: str  # "function" or "class"


class Source:
    """A text with comments and strings blanked out, so that patterns see code only; positions stay."""

    def __init__(self, text: str, hidden: str):
        self.text = text
        self.comments: list[tuple[int, int]] = []
        self.code = re.sub(hidden, self._blank, text, flags=re.S | re.M)
        self.newlines = [m.start() for m in re.finditer("\n", text)]
        self.pairs: dict[int, int] = {}
        self.opens: list[int] = []
        self.parents: list[int] = []
        stack: list[int] = []
        self.edges: list[int] = []
        self.inside: list[int] = []
        for m in re.finditer(r"[{}]", self.code):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                self.pairs[stack.pop()] = m.start()
            self.edges.append(m.start())
            self.inside.append(stack[-1] if stack else -1)
        for left in stack:
            self.pairs[left] = len(text)
        self.scopes: list[Scope] = []

    def _blank(self, m: re.Match) -> str:
        if m.lastgroup == "comment":
            self.comments.append(m.span())
            return re.sub(r"[^\n]", " ", m[0])
        return m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0]

    def line(self, at: int) -> int:
        return bisect_right(self.newlines, at - 1) + 1

    def line_text(self, at: int) -> str:
        start = self.text.rfind("\n", 0, at) + 1
        end = self.text.find("\n", at)
        return self.text[start : end if end >= 0 else len(self.text)].strip()

    def block_of(self, at: int) -> int:
        """Start of the innermost brace block around a position, or -1."""
        i = bisect_right(self.edges, at - 1) - 1
        return self.inside[i] if i >= 0 else -1

    def closing(self, at: int, pair: str = "()") -> int:
        """Position of the bracket that closes the one at ``at``."""
        depth = 0
        for i in range(at, len(self.code)):
            if self.code[i] == pair[0]:
                depth += 1
            elif self.code[i] == pair[1]:
                depth -= 1
                if not depth:
                    return i
        return len(self.code) - 1

    def body(self, at: int, stop: str = ";") -> tuple[int, int] | None:
        """(start, end) of the brace block that a declaration opens after ``at``, unless ``stop`` comes first."""
        m = re.compile(r"[{" + re.escape(stop) + r"]").search(self.code, at)
        if m and m[0] == "{":
            return m.start(), self.pairs[m.start()]
        return None

    def signature(self, at: int) -> str:
        """The declaration's first line up to its brace."""
        line = self.line_text(at)
        return short(line.split("{")[0].strip() or line)

    def doc(self, at: int) -> str | None:
        """The comment that ends right before the line of ``at``; lines of attributes between them don't count."""
        top = self.text.rfind("\n", 0, at) + 1
        while top and (above := self.text[self.text.rfind("\n", 0, top - 1) + 1 : top].strip()) and above[0] in "[@#" and above[-1] in ")]":
            top = self.text.rfind("\n", 0, top - 1) + 1
        start = None
        for a, b in reversed([c for c in self.comments if c[1] <= top]):
            between = self.text[b : top if start is None else start]
            if between.strip() or between.count("\n") > 1:
                break
            start = a
            if self.text.startswith("/*", a):
                break
        return self.text[start:top].strip() if start is not None else None

    def scope_at(self, at: int, opens: str) -> Scope | None:
        around = [s for s in self.scopes if s.opens == opens and s.start <= at <= s.end]
        return max(around, key=lambda s: s.start) if around else None

    def caller(self, at: int) -> str | None:
        scope = self.scope_at(at, "function")
        return scope.name if scope else None

    def calls(self, found: Found, pattern: str, skip: frozenset[str], heads: set[int], receivers: frozenset[str] | None = None) -> None:
        """Calls inside functions. The pattern has groups ``name`` and, if receivers are wanted, ``on``; ``receivers`` are none."""
        for m in re.finditer(pattern, self.code):
            name, at = m["name"], m.start("name")
            if name in skip or len(name) >= MOST_CALLEE or at in heads:
                continue
            caller = self.caller(at)
            if caller:
                on = m.groupdict().get("on") if receivers is not None else None
                found.call_sites.append(CallSite(caller, name, on if on and on not in receivers else None, self.line(at)))
        found.call_sites.sort(key=lambda c: c.line)


C_STYLE = r"""(?P<comment>//[^\n]*|/\*.*?\*/)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
WORDS = frozenset("if for while switch catch return function typeof new await super import sizeof else do throw match unless elsif and or not in defined require fn func def class with until case when foreach using lock nameof yield assert".split())
