"""Python source text to records: functions, classes, calls, variables, imports, decorators, attributes, exceptions and module docstrings.

Everything here is plain Python over the standard syntax tree, one piece of a file at a time; scan.py runs it in Arrow batches. ``ord`` numbers the
records of a kind within a file, so that "first" and "last" mean the same in every run.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from bisect import bisect
from collections.abc import Iterator
from itertools import accumulate, count

FUNCTION_NODES = (ast.FunctionDef, ast.AsyncFunctionDef)
KINDS = {
    "functions": "ord:int name:string start_line:bigint end_line:bigint is_public:boolean source_code:string parent_class:string",
    "classes": "ord:int name:string start_line:bigint end_line:bigint bases:array<string> methods:array<string> is_public:boolean source_code:string",
    "calls": "ord:int caller_function:string caller_start_line:bigint called_name:string call_line:bigint",
    "variables": "ord:int name:string definition_line:bigint scope:string",
    "usages": "ord:int variable_name:string function_name:string usage_line:bigint",
    "imports": "ord:int module:string line_number:bigint is_relative:boolean",
    "imports_detailed": "ord:int imported_name:string import_type:string alias:string line_number:bigint is_relative:boolean module:string",
    "decorators": "ord:int name:string line_number:bigint arguments:string target_name:string target_type:string target_line:bigint",
    "attributes": "ord:int name:string class_name:string definition_line:bigint type_hint:string is_class_attribute:boolean",
    "accesses": "ord:int name:string class_name:string function_name:string function_line:bigint line_number:bigint access_type:string",
    "exceptions": "ord:int name:string line_number:bigint context:string function_name:string",
}


def analysis_ddl() -> str:
    """The nested record of one piece of a file, as a Spark type."""
    kinds = ", ".join(f"{kind} array<struct<{', '.join(spec.split())}>>" for kind, spec in KINDS.items())
    return f"file string, part int, content_hash string, docstring string, {kinds}, errors array<string>"


#: Signs of a text that are parsed at once, about: a syntax tree takes a few hundred times the memory of its text. A longer statement is parsed whole.
PIECE = 1 << 16
#: The columns that hold a line.
_LINES = {kind: [f.split(":")[0] for f in spec.split() if f.endswith(":bigint")] for kind, spec in KINDS.items()}
_UNREADABLE = (SyntaxError, ValueError, RecursionError, MemoryError)


_STRING_OR_COMMENT = re.compile(r"#[^\n]*|\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|\'\'\'(?:[^\\]|\\.)*?(?:\'\'\'|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|\'(?:[^\'\\\n]|\\.)*\'?", re.S)
_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b|[)\]}]")


def lines_of(text: str) -> list[str]:
    """As the syntax tree counts lines."""
    return re.split(r"\r\n|\r|\n", text)


def _parsed(text: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text)


def tolerant(text: str) -> tuple[ast.Module, list[str]]:
    """The syntax tree, and the first error of a text that has any: what can be read of it is in the tree all the same, at its own lines.

    A text with an error is read statement by statement; a statement that is broken is left out, but of a broken class, function or block the header stays, if
    that can be read, with those of its statements that can. Each level of nesting is read once more, so the work is bounded by length times depth.
    """
    try:
        return _parsed(text), []
    except _UNREADABLE as e:
        first = f"Syntax error: {e}"
    lines = lines_of(text)
    return ast.Module(_recovered(lines, _held(lines), 0), []), [first]


def _held(lines: list[str]) -> list[bool]:
    """Which lines begin inside a string."""
    held = [False] * (len(lines) + 1)
    ends = list(accumulate(len(line) + 1 for line in lines))
    for m in _STRING_OR_COMMENT.finditer("\n".join(lines)):
        for k in range(bisect(ends, m.start()) + 1, bisect(ends, m.end() - 1) + 1):
            held[k] = True
    return held


def _recovered(lines: list[str], held: list[bool], base: int, depth: int = 0) -> list[ast.stmt]:
    """The statements of ``lines``, whose own level begins at the left edge; ``base`` lines of the file are before them."""
    return [n for _, part in _recovered_parts(lines, held, base, depth) for n in part]


def _recovered_parts(lines: list[str], held: list[bool], base: int, depth: int = 0) -> Iterator[tuple[int, list[ast.stmt]]]:
    """As _recovered(), part by part, each with the line after it."""
    starts = [i for i, line in enumerate(lines) if line.strip() and not held[base + i] and not line[0].isspace() and line[0] != "#" and not _GOES_ON.match(line)]
    starts = [i for k, i in enumerate(starts) if not k or not lines[starts[k - 1]].startswith("@")]  # decorators belong to what follows
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        try:
            part = _parsed("\n".join(lines[a:b])).body
        except _UNREADABLE:
            part = _headed(lines[a:b], held, base + a, depth)
        else:
            for n in part:
                ast.increment_lineno(n, base + a)
        yield b, part


def _headed(lines: list[str], held: list[bool], base: int, depth: int) -> list[ast.stmt]:
    """A broken compound statement as its header and what can be read of its body; nothing if it has no header that can be read."""
    for k, line in enumerate(lines[:20]):
        if not line.split("#")[0].rstrip().endswith(":"):
            continue
        try:
            (node,) = _parsed("\n".join([*lines[: k + 1], "    pass"])).body
        except _UNREADABLE:
            continue
        inner = lines[k + 1 :]
        indents = [len(x) - len(x.lstrip()) for i, x in enumerate(inner) if x.strip() and not held[base + k + 1 + i] and x[0].isspace()]
        if not indents or depth > 50 or not hasattr(node, "body"):
            return []
        cut = min(indents)
        ast.increment_lineno(node, base)
        body = _recovered([x[cut:] if not x[:cut].strip() else "" for x in inner], held, base + k + 1, depth + 1)
        node.body = body or node.body
        node.end_lineno = base + max(i for i, x in enumerate(lines) if x.strip()) + 1
        return [node]
    return []


def _may_begin(lines: list[str], i: int) -> bool:
    """Whether a top-level statement may begin at line ``i``, from 0; it may also be inside a string or brackets."""
    line = lines[i]
    return bool(line) and not line[0].isspace() and line[0] != "#" and not _GOES_ON.match(line) and not lines[i - 1].startswith("@")


def _cuts(text: str, lines: list[str]) -> tuple[list[int], str | None]:
    """The lines at which pieces of about PIECE signs begin, and the first error of a text that has any.

    A piece is tried: what can be read by itself from the start of a statement ends with a statement, since a string, brackets or a block would be open else. If it
    cannot be read it is doubled, so an error is what cannot be read up to the end. A text of one piece is not tried.
    """
    if "\0" in text:
        return [0], _error_of(text)
    cuts, n = [0], len(lines)
    while True:
        at, want = cuts[-1], PIECE
        while True:
            end, size = at, 0
            while end < n and (size < want or not _may_begin(lines, end)):
                size += len(lines[end]) + 1
                end += 1
            if end == n and not at and want == PIECE:
                return cuts, None
            try:
                if _parsed("\n".join(lines[at:end])).body or end == n:
                    break
            except _UNREADABLE:
                if end == n:  # empty lines before it keep the numbers in the message right
                    return cuts, _error_of("\n" * at + "\n".join(lines[at:]))
            want = 2 * max(want, size)
        if end == n:
            return cuts, None
        cuts.append(end)


def _error_of(text: str) -> str | None:
    try:
        _parsed(text)
    except _UNREADABLE as e:
        return f"Syntax error: {e}"
    return None


def pieces(text: str, compat: bool = False) -> Iterator[_File]:
    """The text in order, in pieces of whole top-level statements, of which one at a time is in memory as a syntax tree. Only the first has a docstring and a syntax error."""
    if len(text) <= PIECE:
        yield _File(text, compat)
        return
    lines = lines_of(text)
    cuts, error = _cuts(text, lines)
    if error is None and len(cuts) == 1:
        yield _File(text, compat)
    elif error is None:
        for a, b in zip(cuts, [*cuts[1:], len(lines)]):
            yield _File.of(_parsed("\n".join(lines[a:b])), lines[a:b], a, compat)
    else:
        yield from _recovered_pieces(lines, error, compat)


def _recovered_pieces(lines: list[str], error: str, compat: bool) -> Iterator[_File]:
    at, seen, size, body, errors = 0, 0, 0, [], [error]
    for end, part in _recovered_parts(lines, _held(lines), 0):
        body += part
        size += sum(len(line) + 1 for line in lines[seen:end])
        seen = end
        if size >= PIECE and body:
            yield _shifted(body, lines, at, end, errors, compat)
            at, size, body, errors = end, 0, [], []
    if body or errors:
        yield _shifted(body, lines, at, len(lines), errors, compat)


def _shifted(body: list[ast.stmt], lines: list[str], at: int, end: int, errors: list[str], compat: bool) -> _File:
    for n in body:
        ast.increment_lineno(n, -at)
    return _File.of(ast.Module(body, []), lines[at:end], at, compat, errors)


class _File:
    """A text, or a piece of one with ``base`` lines before it; its nodes' lines count from its own beginning."""

    def __init__(self, text: str, compat: bool):
        tree, errors = tolerant(text)
        self._fill(tree, lines_of(text), 0, compat, errors)

    @classmethod
    def of(cls, tree: ast.Module, lines: list[str], base: int, compat: bool, errors: list[str] = ()) -> _File:
        out = cls.__new__(cls)
        out._fill(tree, lines, base, compat, list(errors))
        return out

    def _fill(self, tree: ast.Module, lines: list[str], base: int, compat: bool, errors: list[str]) -> None:
        self.tree, self.lines, self.base, self.compat, self.errors = tree, lines, base, compat, errors
        self.nodes = list(preorder(self.tree))
        self.functions = [n for n in self.nodes if isinstance(n, FUNCTION_NODES)]
        self.classes = [n for n in self.nodes if isinstance(n, ast.ClassDef)]
        self._around, self._inside = self._index(0), self._index(1)

    def source(self, node: ast.AST) -> str:
        return "\n".join(self.lines[node.lineno - 1 : node.end_lineno])

    def outermost(self, line: int, strict: bool = False):
        """The first function, in order of appearance, whose lines hold ``line``; with ``strict`` its first line does not count."""
        return (self._inside if strict else self._around)[line]

    def _index(self, skip: int) -> list:
        """For each line its outermost function. Every line is set once, so the cost is the file's length however many functions there are."""
        out: list = [None] * (len(self.lines) + 2)
        for f in self.functions:
            at = f.lineno + skip
            if at <= f.end_lineno and out[at] is not None and out[f.end_lineno] is out[at]:
                continue  # inside a function that is set already
            for line in range(at, f.end_lineno + 1):
                if out[line] is None:
                    out[line] = f
        return out


def preorder(tree: ast.AST) -> Iterator[ast.AST]:
    stack = [tree]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(list(ast.iter_child_nodes(node))))


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a chain of attributes, else None."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([node.id, *reversed(parts)])


def functions(f: _File) -> Iterator[dict]:
    parents = {}
    for c in f.classes:
        for child in c.body:
            if isinstance(child, FUNCTION_NODES) and not (f.compat and child.decorator_list):
                parents[child] = c.name
    for n in f.functions:
        yield {"name": n.name, "start_line": n.lineno, "end_line": n.end_lineno, "is_public": not n.name.startswith("_"), "source_code": f.source(n), "parent_class": parents.get(n)}


def classes(f: _File) -> Iterator[dict]:
    for c in f.classes:
        bases = [ast.unparse(b).strip("'\"") for b in c.bases]
        methods = [m.name for m in c.body if isinstance(m, FUNCTION_NODES)]
        yield {"name": c.name, "start_line": c.lineno, "end_line": c.end_lineno, "bases": bases, "methods": methods, "is_public": not c.name.startswith("_"), "source_code": f.source(c)}


def called_name(call: ast.Call) -> str | None:
    if isinstance(call.func, ast.Name):
        return call.func.id
    return call.func.attr if isinstance(call.func, ast.Attribute) else None


def calls(f: _File) -> Iterator[dict]:
    """Calls inside functions; each belongs to the outermost function around it."""
    for n in f.nodes:
        if isinstance(n, ast.Call) and (name := called_name(n)) and (caller := f.outermost(n.lineno)):
            yield {"caller_function": caller.name, "caller_start_line": caller.lineno, "called_name": name, "call_line": n.lineno}


def target_names(target: ast.AST) -> Iterator[str]:
    """Names that an assignment target binds; for items and attributes the name that they start from."""
    if isinstance(target, ast.Name):
        yield target.id
    elif isinstance(target, (ast.Tuple, ast.List)):
        for t in target.elts:
            yield from target_names(t)
    elif isinstance(target, (ast.Starred, ast.Subscript, ast.Attribute)):
        yield from target_names(target.value)


def variables(f: _File) -> Iterator[dict]:
    for n in f.nodes:
        if isinstance(n, ast.Assign):
            targets = n.targets
        elif isinstance(n, (ast.AugAssign, ast.AnnAssign, ast.NamedExpr)):
            targets = [n.target]
        else:
            continue
        inside = f.outermost(n.lineno, strict=True)
        for t in targets:
            for name in target_names(t):
                yield {"name": name, "definition_line": n.lineno, "scope": f"function:{inside.name}" if inside else "module"}


def usages(f: _File) -> Iterator[dict]:
    """Names read inside a function; inner functions' reads count for every function around them."""
    for fn in f.functions:
        for n in preorder(fn):
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
                yield {"variable_name": n.id, "function_name": fn.name, "usage_line": n.lineno}


def imports(f: _File) -> Iterator[dict]:
    for n in f.nodes:
        if isinstance(n, ast.Import):
            for a in n.names:
                yield {"module": a.name, "line_number": n.lineno, "is_relative": False}
        elif isinstance(n, ast.ImportFrom) and n.module:
            yield {"module": n.module, "line_number": n.lineno, "is_relative": n.level > 0}


def imports_detailed(f: _File) -> Iterator[dict]:
    for n in f.nodes:
        if isinstance(n, ast.Import):
            for a in n.names:
                yield {"imported_name": a.name, "import_type": "module", "alias": a.asname, "line_number": n.lineno, "is_relative": False, "module": None}
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                kind = "*" if a.name == "*" else "unknown"
                yield {"imported_name": a.name, "import_type": kind, "alias": a.asname, "line_number": n.lineno, "is_relative": n.level > 0, "module": n.module}


def jsonable(value):
    """Anything literal as JSON: tuples become lists, keys strings, and sets, bytes and complex numbers their text."""
    if isinstance(value, (list, tuple)):
        return [jsonable(v) for v in value]
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def _argument(node: ast.AST):
    try:
        return jsonable(ast.literal_eval(node))
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
        return ast.unparse(node)


def decorators(f: _File) -> Iterator[dict]:
    for n in f.nodes:
        if not isinstance(n, (*FUNCTION_NODES, ast.ClassDef)):
            continue
        for d in n.decorator_list:
            head, given = (d.func, d) if isinstance(d, ast.Call) else (d, None)
            arguments = {}
            if given:
                arguments = {f"arg_{i}": _argument(a) for i, a in enumerate(given.args)}
                arguments |= {k.arg or "**": _argument(k.value) for k in given.keywords}
            kind = "class" if isinstance(n, ast.ClassDef) else "function"
            yield {"name": dotted(head) or ast.unparse(head), "line_number": d.lineno, "arguments": json.dumps(arguments), "target_name": n.name, "target_type": kind, "target_line": n.lineno}


def _statements(body: list[ast.stmt]) -> Iterator[ast.stmt]:
    """Statements of a body and of the blocks in it, but not of inner functions and classes."""
    for s in body:
        yield s
        if isinstance(s, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.TryStar)):
            for part in ("body", "orelse", "finalbody"):
                yield from _statements(getattr(s, part, []))
            for h in getattr(s, "handlers", []):
                yield from _statements(h.body)


def _targets(s: ast.stmt) -> list[tuple[ast.AST, str | None]]:
    if isinstance(s, ast.Assign):
        flat = [e for t in s.targets for e in (t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t])]
        return [(t, None) for t in flat]
    if isinstance(s, ast.AnnAssign):
        return [(s.target, ast.unparse(s.annotation))]
    return []


def _is_self(node: ast.AST) -> bool:
    return isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self"


def attributes(f: _File) -> Iterator[dict]:
    """Assignments in a class body, and to ``self`` in its first __init__."""
    for c in f.classes:
        for s in c.body:
            for t, hint in _targets(s):
                if isinstance(t, ast.Name):
                    yield {"name": t.id, "class_name": c.name, "definition_line": s.lineno, "type_hint": hint, "is_class_attribute": True}
        first = next((m for m in c.body if isinstance(m, FUNCTION_NODES) and m.name == "__init__"), None)
        for s in _statements(first.body) if first else ():
            for t, hint in _targets(s):
                if _is_self(t):
                    yield {"name": t.attr, "class_name": c.name, "definition_line": s.lineno, "type_hint": hint, "is_class_attribute": False}


def accesses(f: _File) -> Iterator[dict]:
    """Reads and writes of ``self``'s attributes in methods. An augmented assignment is both."""
    for c in f.classes:
        for m in c.body:
            if not isinstance(m, FUNCTION_NODES):
                continue
            both = {id(n.target) for n in ast.walk(m) if isinstance(n, ast.AugAssign)}
            for n in preorder(m):
                if _is_self(n):
                    kind = "read_write" if id(n) in both else "read" if isinstance(n.ctx, ast.Load) else "write"
                    yield {"name": n.attr, "class_name": c.name, "function_name": m.name, "function_line": m.lineno, "line_number": n.lineno, "access_type": kind}


def _exception_name(node: ast.AST) -> str:
    if isinstance(node, ast.Call):
        node = node.func
    return dotted(node) or ast.unparse(node)


def exceptions(f: _File) -> Iterator[dict]:
    """Raises and handlers, each with the innermost function around it; ``compat`` repeats them for no function and for every one around."""
    around: dict[ast.AST, list[str]] = {}
    for fn in f.functions:
        for n in ast.walk(fn):
            if isinstance(n, (ast.Raise, ast.ExceptHandler)):
                around.setdefault(n, []).append(fn.name)
    for n in f.nodes:
        if isinstance(n, ast.Raise):
            names, context = ["<bare-raise>" if n.exc is None else _exception_name(n.exc)], "raise"
        elif isinstance(n, ast.ExceptHandler):
            types = [] if n.type is None else n.type.elts if isinstance(n.type, ast.Tuple) else [n.type]
            names, context = [_exception_name(t) for t in types] or ["<bare-except>"], "catch"
        else:
            continue
        owners = around.get(n, [])
        for owner in [None, *owners] if f.compat else [owners[-1] if owners else None]:
            for name in names:
                yield {"name": name, "line_number": n.lineno, "context": context, "function_name": owner}


EXTRACTORS = {
    "functions": functions,
    "classes": classes,
    "calls": calls,
    "variables": variables,
    "usages": usages,
    "imports": imports,
    "imports_detailed": imports_detailed,
    "decorators": decorators,
    "attributes": attributes,
    "accesses": accesses,
    "exceptions": exceptions,
}


def _records_of(f: _File, kind: str) -> list[dict]:
    """Records with the file's lines."""
    rows = list(EXTRACTORS[kind](f))
    if f.base:
        for r in rows:
            for c in _LINES[kind]:
                r[c] += f.base
    return rows


def analyse_parts(text: str, compat: bool = False, source_lines: int | None = None) -> Iterator[dict]:
    """The records of one file, piece by piece, ``part`` counting from 0. The first has the docstring, and an entry in ``errors`` if the text cannot be read as a whole.

    A syntax error costs the statements that cannot be read; a failing extractor its own kind alone, in its own piece. ``source_lines`` keeps so many lines of each
    definition's source (None: all, 0: none).
    """
    numbers = {kind: count() for kind in EXTRACTORS}
    for part, f in enumerate(pieces(text, compat)):
        out: dict = {kind: [] for kind in EXTRACTORS} | {"part": part, "docstring": None if part else ast.get_docstring(f.tree), "errors": [*f.errors]}
        for kind in EXTRACTORS:
            try:
                out[kind] = [{"ord": i} | r for r, i in zip(_records_of(f, kind), numbers[kind])]
            except (RecursionError, AttributeError, ValueError) as e:
                out["errors"].append(f"{kind}: {e}")
        if source_lines is not None:
            for r in (*out["functions"], *out["classes"]):
                r["source_code"] = "\n".join(r["source_code"].split("\n")[:source_lines]) if source_lines else None
        yield out


def analyse_text(text: str, compat: bool = False, source_lines: int | None = None) -> dict:
    """As analyse_parts(), in one."""
    out, *rest = analyse_parts(text, compat, source_lines)
    for more in rest:
        for c in (*EXTRACTORS, "errors"):
            out[c] += more[c]
    return {k: v for k, v in out.items() if k != "part"}


def _decoded(content: bytes | None) -> tuple[str | None, dict | None]:
    try:
        return (content or b"").decode("utf-8"), None
    except UnicodeDecodeError as e:
        return None, {kind: [] for kind in EXTRACTORS} | {"docstring": None, "errors": [f"Encoding error: {e}"]}


def analyse_bytes(content: bytes | None, compat: bool = False, source_lines: int | None = None) -> dict:
    """As analyse_text(), from a file's bytes, which must be UTF-8."""
    text, failed = _decoded(content)
    return failed or analyse_text(text, compat, source_lines)


def parts_of_bytes(content: bytes | None, compat: bool = False, source_lines: int | None = None) -> Iterator[dict]:
    """As analyse_parts(), from a file's bytes."""
    text, failed = _decoded(content)
    if failed:
        yield failed | {"part": 0}
    else:
        yield from analyse_parts(text, compat, source_lines)
