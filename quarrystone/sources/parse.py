"""Parsing source files into the canonical relations.

Python is parsed with its own ``ast``.  The brace languages (TypeScript, JavaScript, Java, C#,
Go, Rust, C, C++, Kotlin, Swift, PHP) and Ruby are read by one lexer that blanks comments and
strings and then matches declarations and brackets; it knows declarations, not types.
Every file is parsed once, in ``mapInPandas``, into one row of arrays; ``relations`` flattens it.
Vue and Svelte files are lifted first: all but their scripts is blanked, so lines stay.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.session import ship

_SYMBOL = "symbol_id string, file string, parent_id string, name string, qualified_name string, kind string, visibility string, exported boolean, start_line int, end_line int, signature string, doc string, decorators array<string>, depth int, ordinal int"
_IMPORT = "file string, ordinal int, symbol string, from_spec string, alias string, is_type_only boolean, is_namespace boolean, is_default boolean, is_side_effect boolean, is_dynamic boolean"
_PARTS = {
    "symbols": _SYMBOL,
    "imports": _IMPORT,
    "decisions": "file string, line_no int",
    "calls": "file string, caller string, callee string, line_no int",
    "params": "file string, fn string, name string, type string",
    "uses": "file string, fn string, name string",
    "type_refs": "file string, symbol string, role string, line int, type_name string",
}
SCHEMA = "file string, language string, lines int, error string, " + ", ".join(f"{k} array<struct<{', '.join(p.replace(' ', ':', 1) for p in v.split(', '))}>>" for k, v in _PARTS.items())


@dataclass
class Parsed:
    file: str
    language: str
    lines: int = 0
    error: str | None = None
    symbols: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    decisions: list = field(default_factory=list)
    calls: list = field(default_factory=list)
    params: list = field(default_factory=list)
    uses: list = field(default_factory=list)
    type_refs: list = field(default_factory=list)

    def symbol(self, name: str, kind: str, start: int, end: int, parent: dict | None = None, visibility: str = "public", exported: bool | None = None, signature: str | None = None, doc: str | None = None, decorators=()) -> dict:
        qualified = f"{parent['qualified_name']}.{name}" if parent else name
        s = {
            "symbol_id": f"{parent['symbol_id']}.{name}" if parent else f"{self.file}::{name}", "file": self.file, "parent_id": parent["symbol_id"] if parent else None, "name": name, "qualified_name": qualified, "kind": kind, "visibility": visibility,
            "exported": exported, "start_line": start, "end_line": end, "signature": signature, "doc": doc, "decorators": list(decorators), "depth": parent["depth"] + 1 if parent else 0, "ordinal": len(self.symbols),
        }
        self.symbols.append(s)
        return s

    def imported(self, symbol: str, spec: str, alias: str | None = None, **flags: bool) -> None:
        kinds = {k: bool(flags.get(k, False)) for k in ("is_type_only", "is_namespace", "is_default", "is_side_effect", "is_dynamic")}
        self.imports.append({"file": self.file, "ordinal": len(self.imports), "symbol": symbol, "from_spec": spec, "alias": alias} | kinds)


# Python


class _Python(ast.NodeVisitor):
    def __init__(self, out: Parsed):
        self.out, self.parents, self.fn = out, [], None

    def _names(self, node: ast.AST) -> list[str]:
        return [n.id for n in ast.walk(node) if isinstance(n, ast.Name)] + [n.attr for n in ast.walk(node) if isinstance(n, ast.Attribute)]

    def _refs(self, annotation: ast.AST | None, symbol: str, role: str, line: int) -> None:
        for n in self._names(annotation) if annotation is not None else ():
            self.out.type_refs.append({"file": self.out.file, "symbol": symbol, "role": role, "line": line, "type_name": n})

    def _add(self, node, name: str, kind: str, signature: str | None = None, doc: str | None = None) -> dict:
        parent = self.parents[-1] if self.parents else None
        private = name.startswith("_") and not (name.startswith("__") and name.endswith("__"))
        marks = [ast.unparse(d) for d in getattr(node, "decorator_list", ())]
        start = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])
        return self.out.symbol(name, kind, start, node.end_lineno, parent, "private" if private else "public", (not private) if parent is None else None, signature, doc or None, marks)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        if self.fn is None:
            bases = ", ".join(map(ast.unparse, node.bases))
            self.parents.append(self._add(node, node.name, "class", f"class {node.name}({bases})" if bases else f"class {node.name}", ast.get_docstring(node)))
            self.generic_visit(node)
            self.parents.pop()
        else:
            self.generic_visit(node)

    def _function(self, node) -> None:
        outer = self.fn
        if outer is None:
            head = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
            result = f" -> {ast.unparse(node.returns)}" if node.returns else ""
            s = self._add(node, node.name, "method" if self.parents else "function", f"{head} {node.name}({ast.unparse(node.args)}){result}", ast.get_docstring(node))
            self.fn = s["qualified_name"]
            every = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *(x for x in (node.args.vararg, node.args.kwarg) if x)]
            for a in every:
                self.out.params.append({"file": self.out.file, "fn": self.fn, "name": a.arg, "type": ast.unparse(a.annotation) if a.annotation else None})
                self._refs(a.annotation, self.fn, "param", a.lineno)
            self._refs(node.returns, self.fn, "return", node.lineno)
            for part in node.body:
                self.out.uses += [{"file": self.out.file, "fn": self.fn, "name": n} for n in sorted({x.id for x in ast.walk(part) if isinstance(x, ast.Name)})]
        self.generic_visit(node)
        self.fn = outer

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Assign(self, node: ast.Assign) -> None:
        if self.fn is None:
            for t in node.targets:
                if isinstance(t, ast.Name):
                    self._add(node, t.id, "field" if self.parents else "const" if t.id.isupper() else "var")
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if isinstance(node.target, ast.Name):
            if self.fn is None:
                self._add(node, node.target.id, "field" if self.parents else "const" if node.target.id.isupper() else "var", ast.unparse(node))
            owner = f"{self.parents[-1]['qualified_name']}.{node.target.id}" if self.parents and self.fn is None else node.target.id
            self._refs(node.annotation, owner, "field" if self.parents and self.fn is None else "variable", node.lineno)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.out.imported(a.name, a.name, a.asname, is_namespace=True)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        dots = node.level
        start = "" if not dots else "./" if dots == 1 else "../" * (dots - 1)
        spec = start + (node.module or "").replace(".", "/") if dots else node.module or ""
        for a in node.names:
            self.out.imported(a.name, spec, a.asname, is_namespace=a.name == "*")

    def visit_Call(self, node: ast.Call) -> None:
        name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
        if name:
            self.out.calls.append({"file": self.out.file, "caller": self.fn or "<module>", "callee": name, "line_no": node.lineno})
        self.generic_visit(node)

    def generic_visit(self, node: ast.AST) -> None:
        if isinstance(node, ast.If | ast.For | ast.AsyncFor | ast.While | ast.ExceptHandler | ast.IfExp | ast.match_case):
            line = node.pattern.lineno if isinstance(node, ast.match_case) else node.lineno
            self.out.decisions.append({"file": self.out.file, "line_no": line})
        elif isinstance(node, ast.BoolOp):
            self.out.decisions += [{"file": self.out.file, "line_no": node.lineno}] * (len(node.values) - 1)
        super().generic_visit(node)


# Brace languages

_SCRIPT = {"typescript", "tsx", "javascript", "vue", "svelte"}


def blanked(text: str, language: str) -> str:
    """The text with comments and string contents blanked; lines and columns stay."""
    hash_comments = language in ("ruby", "php")
    pattern = r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`" + (r"|'(?:\\.|[^'\\\n])*'" if language not in ("rust",) else r"|'(?:\\.|[^'\\\n])'")
    if language == "ruby":
        pattern = r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
    elif hash_comments:
        pattern = r"#[^\n\[][^\n]*|" + pattern

    def blank(m: re.Match) -> str:
        s = m.group()
        body = re.sub(r"[^\n]", " ", s)
        return s[0] + body[1:-1] + s[-1] if s[0] in "\"'`" and len(s) > 1 else body

    return re.sub(pattern, blank, text, flags=re.S)


def lift_scripts(text: str) -> str:
    """A single-file component with all but its scripts blanked, line breaks kept."""
    keep = [m.span(1) for m in re.finditer(r"<script\b[^>]*>(.*?)</script\s*>", text, re.S | re.I)]
    out, at = [], 0
    for a, b in keep:
        out += [re.sub(r"[^\n]", " ", text[at:a]), text[a:b]]
        at = b
    return "".join(out) + re.sub(r"[^\n]", " ", text[at:])


_ID = r"[A-Za-z_$][\w$]*"
_DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "script": [
        ("class", rf"(?:abstract\s+)?class\s+({_ID})"), ("interface", rf"interface\s+({_ID})"), ("enum", rf"(?:const\s+)?enum\s+({_ID})"), ("type", rf"type\s+({_ID})\s*(?:<[^=]*>)?\s*="), ("namespace", rf"(?:namespace|module)\s+({_ID})"),
        ("function", rf"(?:async\s+)?function\s*\*?\s*({_ID})\s*(?=[(<])"), ("function", rf"(?:const|let|var)\s+({_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{_ID})\s*(?::[^=\n]+)?=>"), ("const", rf"const\s+({_ID})\s*(?::[^=\n]+)?="), ("var", rf"(?:let|var)\s+({_ID})\s*(?::[^=\n]+)?="),
    ],
    "go": [("struct", r"type\s+(\w+)\s+struct\b"), ("interface", r"type\s+(\w+)\s+interface\b"), ("type", r"type\s+(\w+)\s+(?!struct|interface)\S"), ("function", r"func\s+(\w+)\s*(?=[(\[])"), ("method", r"func\s+\([^)]*\)\s*(\w+)\s*(?=\()"), ("const", r"const\s+(\w+)\b"), ("var", r"var\s+(\w+)\b")],
    "rust": [("struct", r"(?:struct|union)\s+(\w+)"), ("enum", r"enum\s+(\w+)"), ("interface", r"trait\s+(\w+)"), ("type", r"type\s+(\w+)"), ("function", r"(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)"), ("const", r"(?:const|static)\s+(?:mut\s+)?(\w+)\s*:"), ("namespace", r"mod\s+(\w+)")],
    "java": [("class", r"(?:class|record)\s+(\w+)"), ("interface", r"@?interface\s+(\w+)"), ("enum", r"enum\s+(\w+)")],
    "csharp": [("class", r"(?:class|record)\s+(\w+)"), ("struct", r"struct\s+(\w+)"), ("interface", r"interface\s+(\w+)"), ("enum", r"enum\s+(\w+)")],
    "kotlin": [("class", r"(?:class|object)\s+(\w+)"), ("interface", r"interface\s+(\w+)"), ("function", r"fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*(?=\()"), ("const", r"const\s+val\s+(\w+)"), ("var", r"(?:val|var)\s+(\w+)"), ("type", r"typealias\s+(\w+)")],
    "swift": [("class", r"(?:class|actor)\s+(?!func\b|var\b)(\w+)"), ("struct", r"struct\s+(\w+)"), ("interface", r"protocol\s+(\w+)"), ("enum", r"enum\s+(\w+)"), ("function", r"func\s+(\w+)"), ("const", r"let\s+(\w+)"), ("var", r"var\s+(\w+)"), ("type", r"typealias\s+(\w+)")],
    "php": [("class", r"(?:class|trait)\s+(\w+)"), ("interface", r"interface\s+(\w+)"), ("enum", r"enum\s+(\w+)"), ("function", r"function\s+&?(\w+)\s*(?=\()"), ("const", r"const\s+(\w+)\s*=")],
    "c": [("struct", r"(?:struct|union)\s+(\w+)\s*(?=\{)"), ("enum", r"enum\s+(?:class\s+)?(\w+)\s*(?=[{:])"), ("class", r"class\s+(\w+)[^;{()]*(?=\{)"), ("namespace", r"namespace\s+(\w+)\s*(?=\{)"), ("const", r"#\s*define\s+(\w+)"), ("type", r"typedef\s+[^;{]*?(\w+)\s*;")],
}
_GROUP = {"vue": "script", "svelte": "script", "typescript": "script", "tsx": "script", "javascript": "script", "cpp": "c"}
_NOT_CALLS = frozenset("if for while switch catch return function func fn fun def class new typeof sizeof match elif else do try with await yield throw super import require using lock foreach when guard unless until case and or not".split())
_METHOD = rf"(?P<mods>(?:(?:public|private|protected|internal|static|async|abstract|override|virtual|final|readonly|sealed|get|set|export|default|synchronized|inline|extern|const)\s+)*)(?P<type>[\w<>\[\],.?:*&~]+(?:\s*[*&])?\s+)?(?P<name>[#~]?{_ID})\s*(?:<[^<>()]*>)?\s*\((?P<args>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?P<tail>[^;{{}}()=]*)(?=\{{)"
_DECISION = re.compile(r"\b(?:if|for|while|case|catch|when|foreach|elif|elsif|rescue|guard|unless|until)\b|&&|\|\||\?(?![.?:\s]*[,)\]>;:=])(?=[^:;{}\n]*:)")


def _line_of(starts: list[int], at: int) -> int:
    from bisect import bisect_right

    return bisect_right(starts, at)


def _closing(text: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``; the end if there is none."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.start()
    return len(text) - 1


def _exported(language: str, name: str, before: str, mods: str, nested: bool) -> bool | None:
    head = f"{before} {mods}"
    if nested:
        return bool(re.search(r"\bpublic\b", head)) if language in ("java", "csharp") else None
    if language in _SCRIPT:
        return bool(re.search(r"\bexport\b", head))
    if language == "go":
        return name[:1].isupper()
    if language == "rust":
        return bool(re.search(r"\bpub\b", head))
    if language in ("java", "csharp"):
        return bool(re.search(r"\bpublic\b", head))
    if language in ("c", "cpp"):
        return not re.search(r"\bstatic\b", head)
    if language in ("kotlin", "swift"):
        return not re.search(r"\b(?:private|fileprivate|internal)\b", head) if language == "kotlin" else bool(re.search(r"\b(?:public|open)\b", head))
    return not re.search(r"\b(?:private|protected)\b", head)


def _visibility(head: str, name: str) -> str:
    m = re.search(r"\b(private|protected|internal)\b", head)
    return m.group(1) if m else "private" if name.startswith("#") else "public"


def _doc_before(lines: list[str], line: int) -> str | None:
    out, k = [], line - 2
    while k >= 0 and re.match(r"\s*(?://|/?\*|#(?!\[|include|define)|\*/)", lines[k]):
        out.append(re.sub(r"^\s*(?:/\*+|\*/|\*|//+|#+)\s?|\s*\*/\s*$", "", lines[k]).strip())
        k -= 1
    doc = " ".join(x for x in reversed(out) if x)
    return doc or None


def _brace(out: Parsed, text: str) -> None:
    language = out.language
    if language in ("vue", "svelte"):
        text = lift_scripts(text)
    code, lines = blanked(text, language), text.split("\n")
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    group = _GROUP.get(language, language)
    found: dict[int, tuple] = {}
    for kind, pattern in _DECLARATIONS.get(group, ()):
        for m in re.finditer(rf"(?<![\w$.@]){pattern}", code):
            found.setdefault(m.start(1), (m.start(), kind, m.group(1), ""))
    for m in re.finditer(rf"(?<![\w$.]){_METHOD}", code):
        name = m.group("name")
        if name.lstrip("#~") in _NOT_CALLS or (m.group("type") or "").strip() in ("return", "new", "else", "throw", "await", "fn", "func", "fun", "function", "def", "case", "typeof"):
            continue
        if group in ("go", "rust", "kotlin", "swift", "php"):
            continue
        found.setdefault(m.start("name"), (m.start(), "method", name, m.group("mods")))
    open_: list[tuple[int, dict]] = []
    body_of: list[tuple[int, int, dict]] = []
    for at, (start, kind, name, mods) in sorted(found.items()):
        while open_ and open_[-1][0] < at:
            open_.pop()
        parent = open_[-1][1] if open_ else None
        if parent is not None and parent["kind"] in ("function", "method"):
            continue
        head = code[starts[_line_of(starts, start) - 1] : start]
        brace, semi = code.find("{", at), min((x for x in (code.find(";", at), code.find("\n\n", at)) if x >= 0), default=len(code))
        block = brace >= 0 and (brace < semi or kind in ("class", "interface", "struct", "enum", "namespace", "function", "method"))
        if kind in ("const", "var", "type") and not (block and brace < semi):
            block = False
        stop = _closing(code, brace) if block else min(semi, len(code) - 1)
        if kind == "method" and parent is None:
            if group == "script":
                continue
            kind = "function"
        if kind in ("function", "const", "var") and parent is not None and parent["kind"] in ("class", "interface", "struct", "enum"):
            kind = "method" if kind == "function" else "field"
        exported = _exported(language, name, head, mods, parent is not None)
        if group == "script" and kind in ("const", "var") and parent is None and not exported:
            continue
        first, last = _line_of(starts, start), _line_of(starts, max(stop, at))
        head_end = brace if block else stop
        signature = re.sub(r"\s+", " ", text[start:head_end]).strip().rstrip("=").strip()[:1000]
        marks = [m.group(1) for k in range(max(0, first - 4), first - 1) for m in re.finditer(r"^\s*@(\w+(?:\.\w+)*(?:\(.*\))?)", lines[k])] if group in ("script", "java", "kotlin") else []
        s = out.symbol(name.lstrip("#"), kind, first, last, parent, _visibility(f"{head} {mods}", name), exported, signature, _doc_before(lines, first - len(marks)), marks)
        if block:
            if kind in ("class", "interface", "struct", "enum", "namespace", "function", "method"):
                open_.append((stop, s))
            body_of.append((brace, stop, s))
        if kind in ("class", "struct", "interface") and block:
            _fields(out, code, brace, stop, s, starts, found)
    _flows(out, code, starts, body_of)
    _brace_imports(out, text, code)


def _fields(out: Parsed, code: str, brace: int, stop: int, owner: dict, starts: list[int], found: dict) -> None:
    """Members without a body, at the class's own depth."""
    depth, flat = 0, []
    for c in code[brace : stop + 1]:
        if c in "})]":
            depth -= 1
        flat.append(c if depth == 1 or c == "\n" else " ")
        if c in "{([":
            depth += 1
    own = "".join(flat)
    pattern = r"^[ \t]*(\w+)[ \t]+[\w\[\]*.]+[ \t]*$" if out.language == "go" else r"^[ \t]*(?:pub\s+)?(\w+)[ \t]*:[^:]" if out.language == "rust" else rf"^[ \t]*((?:(?:public|private|protected|internal|static|readonly|final|declare|override)\s+)*)(?:(?:[\w<>\[\],.?]+)[ \t]+)?({_ID}|#{_ID})[?!]?[ \t]*(?::[^;\n(]*)?(?:=[^;\n]*)?[;\n,]"
    for m in re.finditer(pattern, own, re.M):
        name = m.group(m.lastindex)
        if name in _NOT_CALLS or brace + m.start(m.lastindex) in found:
            continue
        line = _line_of(starts, brace + m.start(m.lastindex))
        out.symbol(name.lstrip("#"), "field", line, line, owner, _visibility(m.group(), name), bool(re.search(r"\bpublic\b", m.group())) if out.language in ("java", "csharp") else None, re.sub(r"\s+", " ", m.group()).strip(" ;,"))


def _flows(out: Parsed, code: str, starts: list[int], bodies: list[tuple[int, int, dict]]) -> None:
    """Decision points, calls, parameters, uses and annotated types."""
    for m in _DECISION.finditer(code):
        out.decisions.append({"file": out.file, "line_no": _line_of(starts, m.start())})
    spans = [(a, b, s) for a, b, s in bodies if s["kind"] in ("function", "method")]
    for m in re.finditer(rf"(?<![\w$])({_ID})\s*(?=\()", code):
        name = m.group(1)
        if name in _NOT_CALLS:
            continue
        inside = [s for a, b, s in spans if a < m.start() < b]
        if re.search(r"\b(?:function|func|fn|fun|def|class|interface)\s+$", code[max(0, m.start() - 12) : m.start()]) or any(s["name"] == name and s["start_line"] == _line_of(starts, m.start()) for s in out.symbols if s["kind"] in ("function", "method")):
            continue
        out.calls.append({"file": out.file, "caller": inside[-1]["qualified_name"] if inside else "<module>", "callee": name, "line_no": _line_of(starts, m.start())})
    for a, b, s in spans:
        for name, kind in _parameters(s["signature"] or "", out.language):
            out.params.append({"file": out.file, "fn": s["qualified_name"], "name": name, "type": kind})
            for t in re.findall(r"[A-Za-z_]\w*", kind or ""):
                out.type_refs.append({"file": out.file, "symbol": s["qualified_name"], "role": "param", "line": s["start_line"], "type_name": t})
        result = re.search(r"\)\s*(?::|->)\s*(.+?)(?:=>)?$", s["signature"] or "")
        for t in re.findall(r"[A-Za-z_]\w*", result.group(1)) if result else ():
            out.type_refs.append({"file": out.file, "symbol": s["qualified_name"], "role": "return", "line": s["start_line"], "type_name": t})
        out.uses += [{"file": out.file, "fn": s["qualified_name"], "name": n} for n in sorted(set(re.findall(rf"(?<![.\w$])({_ID})", code[a:b])))]
        for m in re.finditer(rf"\b(?:const|let|var)\s+({_ID})\s*:\s*([^=;\n]+)", code[a:b]):
            for t in re.findall(r"[A-Za-z_]\w*", m.group(2)):
                out.type_refs.append({"file": out.file, "symbol": m.group(1), "role": "variable", "line": _line_of(starts, a + m.start()), "type_name": t})
    for s in out.symbols:
        if s["kind"] == "field" and ":" in (s["signature"] or ""):
            for t in re.findall(r"[A-Za-z_]\w*", s["signature"].split(":", 1)[1].split("=")[0]):
                out.type_refs.append({"file": out.file, "symbol": s["qualified_name"], "role": "field", "line": s["start_line"], "type_name": t})


def _parameters(signature: str, language: str = "") -> list[tuple[str, str | None]]:
    if language == "go":
        # the receiver of a method isn't a parameter
        signature = re.sub(r"^func\s*\([^)]*\)\s*(?=\w)", "func ", signature)
    a = signature.find("(")
    if a < 0:
        return []
    depth, parts, buf = 0, [], ""
    for c in signature[a:]:
        if c in "([{<":
            depth += 1
            if depth == 1:
                continue
        elif c in ")]}>":
            depth -= 1
            if depth == 0:
                break
        if c == "," and depth == 1:
            parts.append(buf)
            buf = ""
        else:
            buf += c
    out = []
    for p in [*parts, buf]:
        p = re.sub(r"=.*$", "", p).strip().removeprefix("...").strip()
        m = re.fullmatch(rf"(?:(?:public|private|protected|readonly)\s+)*({_ID})\??\s*(?::\s*(.+))?", p, re.S)
        if m:
            out.append((m.group(1), m.group(2)))
        elif language == "go" and (m := re.fullmatch(rf"({_ID})\s+(.+)", p, re.S)):
            out.append((m.group(1), m.group(2).strip()))
        elif m := re.fullmatch(rf"(.+?)[\s*&]+\$?({_ID})", p, re.S):
            out.append((m.group(2), m.group(1).strip()))
    return out


def _brace_imports(out: Parsed, text: str, code: str) -> None:
    """Imports; strings are read from ``text`` where ``code`` shows that they are no comment."""
    live = lambda m: code[m.start()] == text[m.start()]
    language = out.language
    if language in _SCRIPT:
        for m in filter(live, re.finditer(r"\b(import|export)\s+(type\s+)?([^;'\"()]*?)\s*from\s*['\"]([^'\"]+)['\"]", text)):
            typed, what, spec = bool(m.group(2)), m.group(3), m.group(4)
            braces = re.search(r"\{([^}]*)\}", what)
            for item in (braces.group(1).split(",") if braces else ()):
                x = re.fullmatch(rf"\s*(type\s+)?({_ID})(?:\s+as\s+({_ID}))?\s*", item)
                if x:
                    out.imported(x.group(2), spec, x.group(3), is_type_only=typed or bool(x.group(1)))
            if star := re.search(rf"\*(?:\s+as\s+({_ID}))?", re.sub(r"\{[^}]*\}", "", what)):
                out.imported("*", spec, star.group(1), is_namespace=True, is_type_only=typed)
            elif m.group(1) == "import" and (x := re.match(rf"({_ID})", re.sub(r"\{[^}]*\}", "", what).strip(" ,"))):
                out.imported("default", spec, x.group(1), is_default=True, is_type_only=typed)
        for m in filter(live, re.finditer(r"\bimport\s*['\"]([^'\"]+)['\"]", text)):
            out.imported("*", m.group(1), None, is_side_effect=True)
        for m in filter(live, re.finditer(r"\b(?:import|require)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", text)):
            out.imported("*", m.group(1), None, is_dynamic=True, is_namespace=True)
    elif language == "go":
        for block in re.finditer(r"\bimport\s*(?:\(([^)]*)\)|((?:\w+\s+)?\"[^\"]+\"))", text):
            for x in re.finditer(r"(?:(\w+|\.|_)\s+)?\"([^\"]+)\"", block.group(1) or block.group(2)):
                out.imported("*", x.group(2), x.group(1), is_namespace=True)
    elif language in ("java", "kotlin"):
        for m in filter(live, re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+?)(\.\*)?(?:\s+as\s+(\w+))?\s*;?\s*$", text, re.M)):
            out.imported("*" if m.group(2) else m.group(1).rpartition(".")[2], m.group(1), m.group(3), is_namespace=bool(m.group(2)))
    elif language == "csharp":
        for m in filter(live, re.finditer(r"^\s*using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;", text, re.M)):
            out.imported("*", m.group(2), m.group(1), is_namespace=True)
    elif language == "swift":
        for m in filter(live, re.finditer(r"^\s*import\s+(?:class\s+|struct\s+|func\s+)?([\w.]+)", text, re.M)):
            out.imported("*", m.group(1), None, is_namespace=True)
    elif language in ("c", "cpp"):
        for m in re.finditer(r"^\s*#\s*include\s*([<\"])([^>\"]+)[>\"]", text, re.M):
            out.imported("*", ("./" if m.group(1) == '"' else "") + m.group(2), None, is_namespace=True)
    elif language == "rust":
        for m in filter(live, re.finditer(r"\buse\s+([\w:]+?)(?:::\{([^}]*)\}|::(\*)|)\s*(?:as\s+(\w+)\s*)?;", text)):
            path, many, star, alias = m.groups()
            if many:
                for x in many.split(","):
                    if n := re.match(r"\s*([\w:]+)(?:\s+as\s+(\w+))?", x):
                        out.imported(n.group(1), path, n.group(2), is_namespace=n.group(1) == "self")
            elif star:
                out.imported("*", path, None, is_namespace=True)
            else:
                out.imported(path.rpartition("::")[2], path.rpartition("::")[0] or path, alias)
    elif language == "php":
        for m in filter(live, re.finditer(r"^\s*use\s+([\w\\]+?)(?:\\?\{([^}]*)\}|)\s*(?:as\s+(\w+)\s*)?;", text, re.M)):
            base, many, alias = m.groups()
            for x in many.split(",") if many else [""]:
                full = base.rstrip("\\") + ("\\" + x.strip() if x.strip() else "")
                out.imported(full.rpartition("\\")[2], full, alias)
        for m in filter(live, re.finditer(r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]", text)):
            out.imported("*", m.group(1), None, is_side_effect=True)


def _ruby(out: Parsed, text: str) -> None:
    code, lines, stack, section = blanked(text, "ruby"), text.split("\n"), [], []
    opener = re.compile(r"^\s*(?:(class|module|def)\s+(self\.)?([\w:?!=]+)|(?:if|unless|while|until|case|begin|for)\b)|\bdo\b(?:\s*\|[^|]*\|)?\s*$")
    for n, line in enumerate(code.split("\n"), 1):
        if re.match(r"^\s*(private|protected|public)\s*$", line) and section:
            section[-1] = line.strip()
        m = opener.search(line)
        if m and not re.search(r"\bend\b\s*$", line):
            s = None
            if m.group(1):
                parent = next((x for x in reversed(stack) if x is not None), None)
                kind = {"class": "class", "module": "namespace", "def": "method" if parent else "function"}[m.group(1)]
                vis = section[-1] if section and kind == "method" else "public"
                s = out.symbol(m.group(3), kind, n, n, parent, vis, True if parent is None else None, lines[n - 1].strip(), _doc_before(lines, n))
            stack.append(s)
            section.append("public")
        elif re.match(r"^\s*end\b", line) and stack:
            if (s := stack.pop()) is not None:
                s["end_line"] = n
            section.pop()
        out.decisions += [{"file": out.file, "line_no": n} for _ in re.finditer(r"\b(?:if|elsif|unless|while|until|when|rescue)\b|&&|\|\|", line)]
        if m := re.match(r"^\s*require(_relative)?\s+['\"]([^'\"]+)", lines[n - 1]):
            out.imported("*", ("./" if m.group(1) else "") + m.group(2), None, is_side_effect=True)


def parse_file(file: str, language: str, text: str) -> Parsed:
    """All relations of one file; a file that can't be parsed has its error and no rows."""
    out = Parsed(file, language, text.count("\n") + 1)
    try:
        if language == "python":
            _Python(out).visit(ast.parse(text))
        elif language == "ruby":
            _ruby(out, text)
        else:
            _brace(out, text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return Parsed(file, language, out.lines, f"{type(e).__name__}: {e}"[:300])
    return out


def parse(files: DataFrame) -> DataFrame:
    """One row a file of ``files(file, language, content)`` with arrays of its relations."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [vars(parse_file(f, x, t)) for f, x, t in zip(b["file"], b["language"], b["content"], strict=True) if t is not None]
            yield pd.DataFrame(rows, columns=["file", "language", "lines", "error", *_PARTS])

    return files.select("file", "language", "content").mapInPandas(run, SCHEMA)


@dataclass(frozen=True)
class Relations:
    """The canonical relations of a parsed tree, each one explode away from the parsed table."""

    parsed: DataFrame

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _PARTS:
            raise AttributeError(name)
        return self.parsed.select(F.explode(name).alias("x")).select("x.*")

    @property
    def files(self) -> DataFrame:
        return self.parsed.select("file", "language", "lines", F.size("symbols").alias("symbol_count"), "error")


def relations(files: DataFrame, materialized: bool = True) -> Relations:
    """Parse once; by default the parsed table is written to the shared folder, so relations don't parse again."""
    parsed = parse(files)
    if materialized:
        from quarrystone.session import materialize

        parsed, _ = materialize(parsed, "parsed")
    return Relations(parsed)
