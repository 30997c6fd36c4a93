"""Symbols of Python sources, whole or broken.

A source that parses is read from its syntax tree.  Any other is read by logical lines: literals are blanked, lines with open
brackets are joined, and indentation tells what lies in what.  A definition that begins where a statement could, while a
bracket is still open, closes it; so a broken statement costs itself and the symbols around it keep kind, span and owner.
"""

from __future__ import annotations

import ast
import keyword
import re
from collections.abc import Iterator
from typing import NamedTuple

from ..functions.text import TEST_MARKS

Row = tuple[str, str, int, int, str, bool, bool]


class Scope(NamedTuple):
    """What a statement lies in: its class, the decorators of what is around it, and whether it is outside definitions."""

    owner: str | None = None
    marks: tuple[str, ...] = ()
    top: bool = True


def _definition(what: str, name: str, first: int, last: int, scope: Scope) -> Row:
    public = not name.startswith("_")
    if what == "class":
        return name, "Class", first, last, f"class {name}", False, public
    test = name.startswith(("test_", "Test")) or any(t in m for m in scope.marks for t in TEST_MARKS)
    kind = "Test" if test else "Method" if scope.owner else "Function"
    return f"{scope.owner}::{name}" if scope.owner else name, kind, first, last, f"def {name}(…)", test, public


def _constant(name: str, first: int, last: int) -> Row:
    return name, "Const", first, last, f"{name} = …", False, not name.startswith("_")


def _segments(decorator: str) -> tuple[str, ...]:
    return tuple(s.strip() for s in re.split(r"[.(]", decorator.lstrip("@")) if s.strip())


def rows(source: str) -> list[Row]:
    """Symbols in the order of the source."""
    try:
        return list(_of_tree(ast.parse(source)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _of_lines(source)


def _of_tree(tree: ast.Module) -> Iterator[Row]:
    waiting = [(node, Scope()) for node in reversed(tree.body)]
    while waiting:
        node, scope = waiting.pop()
        inner = scope
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            scope = scope._replace(marks=scope.marks + tuple(s for d in node.decorator_list for s in _segments(ast.unparse(d))))
            what = "class" if isinstance(node, ast.ClassDef) else "def"
            yield _definition(what, node.name, node.lineno, node.end_lineno, scope)
            inner = Scope(node.name if what == "class" else scope.owner, scope.marks, False)
        elif scope.top and isinstance(node, ast.Assign | ast.AnnAssign):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name):
                    yield _constant(target.id, target.lineno, node.end_lineno)
        if not isinstance(node, ast.expr):
            waiting += [(child, inner) for child in reversed(list(ast.iter_child_nodes(node))) if isinstance(child, ast.stmt | ast.ExceptHandler | ast.match_case)]


_LITERAL = re.compile(r"""#[^\n]*|[rRbBuUfFtT]{0,2}(?:'{3}.*?(?:'{3}|\Z)|"{3}.*?(?:"{3}|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z))""", re.S)
_BEGINS = re.compile(r"(?:(?:async\s+)?def|class)\s+\w|@\s*\w")
_DEFINES = re.compile(r"(?P<what>(?:async\s+)?def|class)\s+(?P<name>[^\W\d]\w*)")
_HEADER = re.compile(r"(?:if|elif|else|for|while|with|try|except|finally|match|case|async\s+for|async\s+with)\b")
_TARGET = re.compile(r"\s*(?P<name>[^\W\d]\w*)\s*(?:=(?!=)|(?P<typed>:(?!=)\s*\S))")


def _blanked(match: re.Match) -> str:
    """A literal as one word, so that a statement of a text alone still is one, with its line ends as \\v; a comment as nothing."""
    return " " * len(match[0]) if match[0].startswith("#") else re.sub(r"[^\v]", "_", match[0].replace("\n", "\v"))


def _indent(line: str) -> int:
    return len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip())


def _logical(source: str) -> Iterator[tuple[int, int, int, str]]:
    """(first line, last line, indentation, text) of statements, literals blanked."""
    held, first, indent, depth = [], 0, 0, 0
    number = 0
    for line in _LITERAL.sub(_blanked, source.replace("\v", " ")).split("\n"):
        start, number = number + 1, number + 1 + line.count("\v")
        if held and _BEGINS.match(line.lstrip()) and _indent(line) <= indent:
            yield first, start - 1, indent, "\n".join(held)
            held, depth = [], 0
        if not held:
            if not line.strip():
                continue
            first, indent = start, _indent(line)
        held.append(line)
        for c in line:
            depth = depth + 1 if c in "([{" else max(0, depth - 1) if c in ")]}" else depth
        if depth == 0 and not line.rstrip().endswith("\\"):
            yield first, number, indent, "\n".join(held)
            held = []
    if held:
        yield first, number, indent, "\n".join(held)


def _split(text: str, at: str) -> list[str]:
    """A text cut at a character outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == at and depth <= 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def _constants(text: str, first: int, last: int) -> Iterator[Row]:
    """Names that the simple statements of a logical line set."""
    head = text.strip()
    if _HEADER.match(head):
        head = ":".join(_split(head, ":")[1:])
    at = first
    for statement in _split(head, ";"):
        rest = statement
        while (m := _TARGET.match(rest)) and not keyword.iskeyword(m["name"]):
            yield _constant(m["name"], at, last)
            if m["typed"]:
                break
            rest = rest[m.end() :]
        at += statement.count("\n") + statement.count("\v")


def _of_lines(source: str) -> list[Row]:
    out: list[Row] = []
    inside: list[tuple[int, int, Scope]] = []  # indentation, place in out, scope of the body
    marks: tuple[str, ...] = ()
    end = 0

    def leave(indent: int) -> None:
        while inside and indent <= inside[-1][0]:
            _, at, _ = inside.pop()
            out[at] = (*out[at][:3], end, *out[at][4:])

    for first, last, indent, text in _logical(source):
        leave(indent)
        scope = inside[-1][2] if inside else Scope()
        head = text.strip()
        if head.startswith("@"):
            marks += _segments(head.split("\n")[0])
        elif m := _DEFINES.match(head):
            what = "class" if m["what"] == "class" else "def"
            scope = scope._replace(marks=scope.marks + marks)
            out.append(_definition(what, m["name"], first, last, scope))
            inside.append((indent, len(out) - 1, Scope(m["name"] if what == "class" else scope.owner, scope.marks, False)))
            marks = ()
        else:
            marks = ()
            if scope.top:
                out += _constants(text, first, last)
        end = last
    leave(-1)
    return out
