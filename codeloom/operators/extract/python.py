"""Python, by its own parser; text that it rejects is cut back line by line until it parses."""

from __future__ import annotations

import ast

from .source import CallSite, Found, Import, Symbol, TypeHint, short

#: Arguments that are hardly functions, and decorators that are no calls.
PLAIN_ARGUMENTS = frozenset("True False None self cls data value result err args kwargs key index item name path msg".split())
PLAIN_DECORATORS = frozenset("staticmethod classmethod property abstractmethod override".split())


def _last(node: ast.expr) -> str | None:
    if isinstance(node, ast.Call):
        return _last(node.func)
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _type(node: ast.expr | None) -> str | None:
    """The class an annotation is about, without Optional or Annotated."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            node = ast.parse(node.value, mode="eval").body
        except SyntaxError:
            return None
    if isinstance(node, ast.Subscript) and _last(node.value) in ("Optional", "Annotated"):
        inner = node.slice.elts[0] if isinstance(node.slice, ast.Tuple) else node.slice
        return _type(inner)
    name = _last(node) if node is not None else None
    return name if name and name[0].isupper() else None


def tree_of(text: str) -> ast.Module:
    """The tree of the text, or of what parses when faulty lines are blanked, a few at a time."""
    lines = text.split("\n")
    for _ in range(40):
        try:
            return ast.parse("\n".join(lines))
        except SyntaxError as error:
            at = min(max(0, (error.lineno or 1) - 1), len(lines) - 1)
            while at > 0 and not lines[at].strip():
                at -= 1
            if not lines[at].strip():
                break
            indent = lines[at][: len(lines[at]) - len(lines[at].lstrip())]
            lines[at] = indent + "pass" if lines[at].strip() != "pass" else ""
        except ValueError:
            break
    return ast.Module([], [])


class _Walk(ast.NodeVisitor):
    def __init__(self, text: str):
        self.found, self.lines = Found(), text.split("\n")
        self.function: str | None = None
        self.owner: str | None = None
        self.depth = 0
        self.listed: list[str] = []

    def exported(self, name: str) -> bool:
        return name in self.listed if self.listed else not name.startswith("_")

    def call(self, name: str | None, line: int) -> None:
        if self.function and name and len(name) < 100:
            self.found.call_sites.append(CallSite(self.function, name, None, line))

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        inside = self.function
        method = self.owner is not None and inside is None
        name = f"{self.owner}.{node.name}" if method else node.name
        head = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
        signature = f"{head} {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        tags = ["@" + ast.unparse(d)[:79] for d in node.decorator_list]
        self.found.symbols.append(
            Symbol(node.name, "method" if method else "function", first, node.end_lineno or node.lineno, short(signature), ast.get_docstring(node), (method or self.depth == 0) and self.exported(node.name), False, self.owner if method else None, tags, _type(node.returns))
        )
        self.function = name
        for decorator in node.decorator_list:
            got = _last(decorator)
            if got and len(got) > 1 and got not in PLAIN_DECORATORS:
                self.call(got, decorator.lineno)
        for argument in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
            if got := _type(argument.annotation):
                self.found.type_hints.append(TypeHint(name, argument.arg, got, "parameter"))
        for default in (*node.args.defaults, *node.args.kw_defaults):
            if default is not None:
                self.visit(default)
        self.depth += 1
        for child in node.body:
            self.visit(child)
        self.depth -= 1
        self.function = inside

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        bases = ", ".join(ast.unparse(b) for b in (*node.bases, *(k.value for k in node.keywords)))
        self.found.symbols.append(Symbol(node.name, "class", first, node.end_lineno or node.lineno, f"class {node.name}({bases})" if bases else f"class {node.name}", ast.get_docstring(node), self.depth == 0 and self.exported(node.name), tags=["@" + ast.unparse(d)[:79] for d in node.decorator_list]))
        outer, inside, self.owner, self.function = self.owner, self.function, node.name, None
        self.depth += 1
        for child in node.body:
            self.visit(child)
        self.depth -= 1
        self.owner, self.function = outer, inside

    def assigned(self, node: ast.Assign | ast.AnnAssign, name: str) -> None:
        line = short(self.lines[node.lineno - 1].strip()) if node.lineno <= len(self.lines) else name
        end = node.end_lineno or node.lineno
        if self.owner and self.function is None:
            self.found.symbols.append(Symbol(name, "variable", node.lineno, end, line, parent_name=self.owner, is_exported=not name.startswith("_")))
        elif self.depth == 0 and name == name.upper() and name.lower() != name and len(name) > 1:
            self.found.symbols.append(Symbol(name, "constant", node.lineno, end, line, is_exported=self.exported(name)))

    def visit_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            if isinstance(target, ast.Name):
                self.assigned(node, target.id)
                if isinstance(node.value, ast.Call) and (got := _last(node.value)) and got[0].isupper():
                    self.found.type_hints.append(TypeHint(self.function or "__module__", target.id, got, "constructor"))
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if isinstance(node.target, ast.Name):
            self.assigned(node, node.target.id)
            if got := _type(node.annotation):
                self.found.type_hints.append(TypeHint(self.function or "__module__", node.target.id, got, "annotation"))
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for alias in node.names:
            local = alias.asname or alias.name.split(".")[0]
            self.found.imports.append(Import(alias.name, [local], {alias.asname: alias.name} if alias.asname else {}, True, True))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        renamed = {a.asname: a.name for a in node.names if a.asname}
        self.found.imports.append(Import("." * node.level + (node.module or ""), [a.asname or a.name for a in node.names], renamed, False, any(a.name == "*" for a in node.names)))

    def visit_Call(self, node: ast.Call) -> None:
        self.call(_last(node.func), node.lineno)
        for argument in node.args:
            if isinstance(argument, ast.Name) and 1 < len(argument.id) < 60 and argument.id not in PLAIN_ARGUMENTS and not argument.id.startswith("_"):
                self.call(argument.id, argument.lineno)
        self.generic_visit(node)


def extract(text: str, path: str = "") -> Found:
    tree, walk = tree_of(text), _Walk(text)
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            walk.listed = [e.value for e in node.value.elts if isinstance(e, ast.Constant)]
    walk.visit(tree)
    return walk.found
