"""Python: the standard library's tree where the file parses, a scan by indentation where it doesn't."""

from __future__ import annotations

import ast
import re
import warnings

from symgrid.sources.parse.common import Parsed, count_lines, doc_line, first_lines, heading


def parse_python(path: str, text: str) -> Parsed:
    out = Parsed(path, "python", count_lines(text))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        out.truncated = True
        _scan(out, text)
        return out
    _walk(out, tree, text.split("\n"))
    return out


def _public(name: str) -> bool:
    return not any(part.startswith("_") for part in name.split("."))


def _slice(lines: list[str], a: int, a_col: int, b: int, b_col: int) -> str:
    """Source between two places; columns count UTF-8 bytes, as the tree does."""
    part = lines[a - 1 : b]
    if not part:
        return ""
    part = [x.encode() for x in part]
    part[-1] = part[-1][:b_col]
    part[0] = part[0][a_col:]
    return b"\n".join(part).decode("utf-8", "replace")


def _callee(node: ast.expr) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _walk(out: Parsed, tree: ast.Module, lines: list[str]) -> None:
    todo: list[tuple[ast.AST, tuple[str, ...], str]] = [(tree, (), "module")]
    while todo:
        node, scope, where = todo.pop()
        inner, kind = scope, where
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            name = ".".join((*scope, node.name))
            body = node.body[0]
            signature = heading(_slice(lines, node.lineno, node.col_offset, body.lineno, body.col_offset).split("#")[0] if body.lineno == node.lineno else _header(lines, node, body))
            doc = ast.get_docstring(node, clean=False)
            out.define(name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno or node.lineno, signature, doc_line(doc or ""), _public(name))
            inner, kind = (*scope, node.name), "class" if isinstance(node, ast.ClassDef) else "function"
        elif isinstance(node, (ast.Assign, ast.AnnAssign)) and where == "module":
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            text = _slice(lines, node.lineno, node.col_offset, node.end_lineno or node.lineno, node.end_col_offset or 0)
            for target in targets[:1]:
                if isinstance(target, ast.Name):
                    out.define(target.id, "constant", node.lineno, node.end_lineno or node.lineno, first_lines(text), "", _public(target.id))
        elif isinstance(node, ast.Call):
            out.refer(_callee(node.func), "call", node.func.end_lineno or node.lineno)
        elif isinstance(node, ast.Import):
            for alias in node.names:
                out.refer(alias.name, "import", node.lineno)
        elif isinstance(node, ast.ImportFrom):
            for alias in node.names:
                if alias.name != "*":
                    out.refer(alias.name, "import", node.lineno)
        if isinstance(node, (ast.Lambda, ast.ListComp, ast.If, ast.For, ast.While, ast.With, ast.Try)) and where == "module":
            kind = "block"
        for child in reversed(list(ast.iter_child_nodes(node))):
            todo.append((child, inner, kind))


def _header(lines: list[str], node: ast.AST, body: ast.stmt) -> str:
    """From ``def`` or ``class`` to the colon before the body, without comments."""
    text = _slice(lines, node.lineno, node.col_offset, body.lineno, body.col_offset)
    depth, quote, i = 0, "", 0
    while i < len(text):
        c = text[i]
        if quote:
            if text.startswith(quote, i):
                i += len(quote) - 1
                quote = ""
            elif c == "\\":
                i += 1
        elif c in "'\"":
            quote = c * 3 if text.startswith(c * 3, i) else c
            i += len(quote) - 1
        elif c == "#":
            end = text.find("\n", i)
            text = text[:i] + (text[end:] if end >= 0 else "")
            continue
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            return text[:i]
        i += 1
    return text


_DEFINES = re.compile(r"^([ \t]*)(?:async\s+)?(def|class)\s+([^\W\d]\w*)")
_ASSIGNS = re.compile(r"^([^\W\d]\w*)\s*(?::[^=]+)?=(?!=)")
_CALLS = re.compile(r"(?<![\w])([^\W\d]\w*)\s*\(")
_IMPORTS = re.compile(r"^\s*import\s+(.+)$|^\s*from\s+[.\w]+\s+import\s+\(?([^)#]*)")


def _scan(out: Parsed, text: str) -> None:
    """What single lines tell, nested by indentation."""
    lines = text.split("\n")
    open_: list[tuple[int, str, tuple]] = []
    for number, line in enumerate(lines, 1):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        indent = len(line.expandtabs()) - len(line.expandtabs().lstrip())
        while open_ and indent <= open_[-1][0]:
            open_.pop()
        for _, _, key in open_:
            out.defs[key]["end_line"] = number
        if m := _DEFINES.match(line):
            name = ".".join([*(n for _, n, _ in open_), m[3]])
            kind = "class" if m[2] == "class" else "function"
            out.define(name, kind, number, number, heading(bare), "", _public(name))
            open_.append((indent, m[3], (name, number, kind)))
        elif indent == 0 and (m := _ASSIGNS.match(line)):
            out.define(m[1], "constant", number, number, heading(bare), "", _public(m[1]))
        if m := _IMPORTS.match(line):
            for part in (m[1] or m[2] or "").split(","):
                word = part.split(" as ")[0].strip()
                if word and word != "*":
                    out.refer(word, "import", number)
        elif not _DEFINES.match(line):
            for m in _CALLS.finditer(line.split("#")[0]):
                if m[1] not in ("if", "while", "for", "return", "and", "or", "not", "in", "print_", "elif", "def", "class", "lambda", "assert", "with", "yield", "await"):
                    out.refer(m[1], "call", number)
