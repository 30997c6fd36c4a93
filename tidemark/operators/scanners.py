"""Symbol scanners for single languages: a source to (name, kind, start, end, signature, is_test, is_public) rows."""

from __future__ import annotations

import bisect
import re

from ..functions.text import TEST_MARKS
from . import pysource

LANGUAGES = ("Rust", "Python", "JavaScript", "TypeScript", "Go", "CSharp")
MOST_BYTES = 512 * 1024

Row = tuple[str, str, int, int, str, bool, bool]

_SKIP = re.compile(
    r"""//[^\n]*|/\*.*?(?:\*/|\Z)|r(?P<h>#*)".*?"(?P=h)|@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`""",
    re.S,
)
_SCRIPT_SKIP = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)


def scan(language: str, source: str | None) -> list[Row] | None:
    """Symbols in the order of the source; None if it cannot be read as that language, which happens to Rust alone."""
    if source is None or len(source.encode("utf-8", "surrogatepass")) > MOST_BYTES:
        return []
    if language == "Python":
        return pysource.rows(source)
    scripts = language in ("JavaScript", "TypeScript")
    masked = _masked(source, _SCRIPT_SKIP if scripts else _SKIP)
    if language == "Rust" and masked.count("{") != masked.count("}"):
        return None
    if scripts:
        return script(source, masked, language == "TypeScript")
    return {"Rust": rust, "Go": golang, "CSharp": csharp}[language](source, masked)


def _masked(source: str, skip: re.Pattern) -> str:
    """The source with literals and comments blanked, every line and column kept."""
    return skip.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


_ENDS = re.compile(r"[()\[\]{};]")


class _Text:
    """Places of a masked source: line numbers, matching braces, depth."""

    def __init__(self, masked: str):
        self.masked = masked
        self.starts = [0] + [m.end() for m in re.finditer("\n", masked)]
        self.close: dict[int, int] = {}
        stacks: dict[str, list[int]] = {"}": [], ")": [], "]": []}
        for m in re.finditer(r"[{}()\[\]]", masked):
            if m[0] in "{([":
                stacks[{"{": "}", "(": ")", "[": "]"}[m[0]]].append(m.start())
            elif stacks[m[0]]:
                self.close[stacks[m[0]].pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def end(self, at: int) -> int:
        """Where the item that starts at a place ends: its brace's partner, or its semicolon."""
        depth = 0
        for m in _ENDS.finditer(self.masked, at):
            c, place = m[0], m.start()
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif depth <= 0 and c == "{":
                return self.close.get(place, len(self.masked) - 1)
            elif depth <= 0 and c in ";}":
                return place
        return len(self.masked.rstrip()) - 1 if self.masked.rstrip() else 0

    def body(self, at: int, stop: int) -> tuple[int, int] | None:
        place = self.masked.find("{", at, stop + 1)
        return (place + 1, self.close.get(place, stop)) if place >= 0 else None


def _rust_tokens(text: str) -> str:
    """Tokens joined by blanks, but for the insides of brackets, the way a printed token stream looks."""
    joined = " ".join(re.findall(r"'[a-z_]\w*(?!')|\w+|::|->|=>|&&|\S", text))
    return re.sub(r" ([)\]])", r"\1", re.sub(r"([(\[]) ", r"\1", joined))


_RUST = re.compile(
    r"(?P<attrs>(?:#!?\[[^\]]*\]\s*)*)(?P<vis>pub\b(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|unsafe|const|extern(?:\s+\"[^\"]*\")?)\s+)*"
    r"\b(?P<what>fn|struct|enum|trait|impl|const|static|mod|type|union)\b\s*(?:mut\s+)?(?P<name>[A-Za-z_]\w*)?"
    r"|(?P<skip>\b[A-Za-z_]\w*!\s*(?:[A-Za-z_]\w*\s*)?(?=[({\[])|\bextern\b\s*(?=\{))"
)
RUST_KINDS = {"struct": "Struct", "enum": "Enum", "trait": "Trait", "const": "Const", "static": "Static", "type": "TypeAlias"}
#: Characters of the right side of a type alias in its signature.
MOST_ALIAS = 120


def _after_generics(masked: str, at: int) -> int:
    """Where a parameter list in angle brackets ends, if there is one."""
    m = re.compile(r"\s*<").match(masked, at)
    if not m:
        return at
    depth = 1
    for k in re.compile(r"->|[<>]").finditer(masked, m.end()):
        depth += {"<": 1, ">": -1}.get(k[0], 0)
        if not depth:
            return k.end()
    return at


def _rust_signature(source: str, masked: str, at: _Text, name: str, after: int, end: int) -> str:
    paren = masked.find("(", _after_generics(masked, after))
    close = at.close.get(paren, end)
    args = [_rust_tokens(a) for a in _split(source[paren + 1 : close])]
    stop, depth = end + 1, 0
    for m in _ENDS.finditer(masked, close + 1, end + 1):
        if depth <= 0 and m[0] in "{;":
            stop = m.start()
            break
        depth += (m[0] in "([{") - (m[0] in ")]}")
    tail = masked[close + 1 : stop]
    result = re.search(r"->\s*(.*?)\s*(?:\bwhere\b.*)?$", tail, re.S)
    return f"fn {name}({', '.join(args)})" + (f" -> {_rust_tokens(result[1])}" if result else "")


def rust(source: str, masked: str) -> list[Row]:
    """Items of a file and of its modules, and the functions of its impl blocks; what macros, traits and foreign blocks hold is left out."""
    at = _Text(masked)
    out: list[Row] = []

    def items(start: int, stop: int, owner: str | None) -> None:
        place = start
        while m := _RUST.search(masked, place, stop):
            end = min(at.end(m.end()), stop)
            what, name = m["what"], m["name"]
            attrs = source[m.start("attrs") : m.end("attrs")] if what else ""
            place = max(end + 1, m.end())
            if not what or what == "union" or (owner and what != "fn"):
                continue
            where = m.start("name") if name else m.start("what")
            first, last, public = at.line(where), at.line(end), bool(m["vis"]) and "(" not in m["vis"]
            if what == "impl":
                after = _after_generics(masked, m.end("what"))
                target = re.split(r"\bfor\b(?!\s*<)", masked[after : masked.find("{", after)])[-1]
                body = at.body(after, end)
                if body:
                    items(*body, re.sub(r"\s+", "", re.split(r"\bwhere\b", target)[0]))
            elif what == "fn" and name:
                test = bool(re.search(r"#\[test\b" if owner else r"#\[(?:\w+::)*test\b", attrs))
                kind = "Test" if test else "Method" if owner else "Function"
                out.append((f"{owner}::{name}" if owner else name, kind, first, last, _rust_signature(source, masked, at, name, m.end("name"), end), test, public))
            elif name and what == "mod":
                out.append((name, "Module", first, last, f"mod {name}", name == "tests" or "cfg(test" in attrs.replace(" ", ""), public))
                body = at.body(m.end(), end) if "{" in masked[m.end() : end + 1] else None
                if body:
                    items(*body, None)
            elif name:
                signature = f"{what} {name}"
                if what == "type":
                    right = re.sub(r"\s+", "", source[source.find("=", m.end()) + 1 : end])
                    signature += f" = {right[:MOST_ALIAS]}{'…' * (len(right) > MOST_ALIAS)}"
                out.append((name, RUST_KINDS[what], first, last, signature, False, public))

    items(0, len(masked), None)
    return out


def _split(args: str) -> list[str]:
    parts, depth, now = [], 0, ""
    for i, c in enumerate(args):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and args[i - 1 : i] not in ("-", "=")))
        if c == "," and depth <= 0:
            parts.append(now)
            now = ""
        else:
            now += c
    return [p for p in [*parts, now] if p.strip()]


_WORD = r"[A-Za-z_$][\w$]*"
_SCRIPT = re.compile(
    rf"(?<![\w$.#])(?:(?P<what>(?:async\s+)?function\s*\*?|(?:abstract\s+)?class)\s+(?P<name>{_WORD})|(?:async\s+)?function\s*\*\s*(?P<maker>{_WORD})"
    rf"|(?P<typed>interface|(?:const\s+)?enum|type|namespace)\s+(?P<tname>{_WORD}(?:\.{_WORD})*)(?=\s*[<{{=]|\s+extends\b)"
    rf"|(?P<set>const|let|var)\s"
    rf"|(?P<mods>(?:(?:public|private|protected|static|async|readonly|override|get|set|abstract)\s+|\*\s*)*)(?P<method>#?{_WORD})(?=\s*(?:<[^<>(){{}};]*>)?\s*\())"
)
_NO_METHOD = frozenset("if for while switch catch with function return new await typeof super do else yield case in of delete throw void import".split())
_EXPRESSION = re.compile(r"(?:[=(,:?&|!+\-*/<>\[]|\b(?:return|typeof|new|void|await|yield|case|in|of|delete|throw))\s*$")
_STARTS = re.compile(r"(?:[{};,)\n]|^)\s*$")
_FOR_EACH = re.compile(rf"(?:{_WORD}|[\[{{][^=;]*?[\]}}])\s+(?:of|in)\s")


def script(source: str, masked: str, typed: bool = True) -> list[Row]:
    """Declarations at any depth, methods of classes and of object literals."""
    at = _Text(masked)
    out: list[Row] = []
    classes: list[tuple[int, int, str]] = []  # bodies, the innermost last
    public_ = lambda name: not name.startswith("_")
    before = lambda place: masked[max(0, place - 80) : place]
    place = 0
    while m := _SCRIPT.search(masked, place):
        place = m.end()
        what, name = (m["what"] or ("function" if m["maker"] else "")), m["name"] or m["maker"] or m["tname"]
        if what:
            if _EXPRESSION.search(before(m.start())):
                continue
            end = at.end(m.end())
            first, last = at.line(m.start()), at.line(end)
            if what.endswith("class"):
                out.append((name, "Class", first, last, f"class {name}", False, public_(name)))
                body = at.body(m.end(), end)
                if body:
                    classes.append((*body, name))
            else:
                test = "test" in name
                out.append((name, "Test" if test else "Function", first, last, f"function {name}(…)", test, public_(name)))
        elif m["typed"]:
            kind = m["typed"].split()[-1]
            if not typed or _EXPRESSION.search(before(m.start())):
                continue
            end = _statement_end(masked, m.end(), at) if kind == "type" else at.end(m.end())
            public = kind in ("interface", "enum") or public_(name)
            out.append((name, {"interface": "Interface", "enum": "Enum", "type": "TypeAlias", "namespace": "Module"}[kind], at.line(m.start()), at.line(end), f"{kind} {name}", False, public))
        elif m["set"]:
            if re.search(r"\bfor\s*(?:await\s*)?\(\s*$", before(m.start())) and _FOR_EACH.match(masked, m.end()):
                continue
            end = _statement_end(masked, m.end(), at)
            name = _declared(source, masked, m.end(), end, at)
            if name is None:
                continue
            body = source[m.start() : end + 1]
            test = "describe(" in body or "it(" in body or "test" in name
            out.append((name, "Test" if test else "Const", at.line(m.start()), at.line(end), f"const {name}", test, False))
        else:
            name = m["method"]
            paren = masked.find("(", m.end())
            close = at.close.get(paren)
            if name in _NO_METHOD or close is None or not _STARTS.search(before(m.start())):
                continue
            opens = re.compile(r"\s*(?::[^={};()]*(?:\{[^{}]*\})?[^={};()]*)?\{").match(masked, close + 1)
            if not opens:
                continue
            while classes and not classes[-1][0] <= m.start() <= classes[-1][1]:
                classes.pop()
            end = at.close.get(opens.end() - 1, len(masked) - 1)
            full = f"{classes[-1][2]}::{name}" if classes else name
            out.append((full, "Method", at.line(m.start()), at.line(end), f"{name}(…)", "test" in name, public_(name) and name != "constructor"))
    return out


def _declared(source: str, masked: str, start: int, end: int, at: _Text) -> str | None:
    """The name of a declaration: of a pattern the plain value it takes apart, or else the pattern itself."""
    m = re.compile(rf"\s*({_WORD})").match(masked, start)
    if m:
        return m[1]
    m = re.compile(r"\s*([\[{])").match(masked, start)
    if not m or m.start(1) not in at.close:
        return None
    close = at.close[m.start(1)]
    value = re.compile(rf"\s*=\s*({_WORD})\s*;?\s*$").match(masked, close + 1, end + 1)
    return value[1] if value else source[m.start(1) : close + 1]


def _statement_end(masked: str, start: int, at: _Text) -> int:
    """End of a declaration without a body of its own: its semicolon, or the line end outside all brackets."""
    depth, place = 0, start
    while place < len(masked):
        c = masked[place]
        if c == "{" and depth == 0:
            place = at.close.get(place, len(masked) - 1)
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            if depth == 0:
                return place - 1
            depth -= 1
        elif depth == 0 and (c == ";" or (c == "\n" and not re.search(r"(=|=>|,|\||&)\s*$", masked[start:place]))):
            return place if c == ";" else place - 1
        place += 1
    return len(masked.rstrip()) - 1


_GO = re.compile(r"^func\b[ \t]*(?P<recv>\([^)]*\)\s*)?(?P<func>[^\W\d]\w*)|(?<![\w.])type\s+(?:(?P<many>\()|(?=[^\W\d]))", re.M)
_GO_TYPE = re.compile(r"\s*(?P<name>[^\W\d]\w*)(?P<params>\s*\[(?=\s*[^\W\d]\w*[\s,])[^\]]*\])?\s*(?P<alias>=)?\s*(?P<what>struct\b|interface\b)?")
#: Beginnings of the names of Go's test functions.
GO_TESTS = ("Test", "Example", "Benchmark", "Fuzz")


def golang(source: str, masked: str) -> list[Row]:
    """Functions, methods and types, these at any depth; an alias (type A = B) is no type of its own."""
    at = _Text(masked)
    out: list[Row] = []

    def line_end(place: int) -> int:
        """The end of what starts at a place: the end of the line at which all brackets are closed."""
        while (m := re.compile(r"[\n;({\[)}\]]").search(masked, place)) and m[0] in "({[":
            place = at.close.get(m.start(), len(masked) - 1) + 1
        return (m.start() if m else len(masked)) - 1

    def declared(place: int) -> int:
        m = _GO_TYPE.match(masked, place)
        end = line_end(m.end())
        if not m["alias"]:
            what = m["what"] or "type"
            kind = {"struct": "Struct", "interface": "Interface"}.get(what, "TypeAlias")
            out.append((m["name"], kind, at.line(m.start("name")), at.line(end), f"type {m['name']} {what}", False, m["name"][0].isupper()))
        return m.end()

    place = 0
    while m := _GO.search(masked, place):
        place = m.end()
        if m["func"]:
            name = m["func"]
            paren = masked.find("(", place)
            close = at.close.get(paren, place)
            end = line_end(close + 1) if paren >= 0 else place
            owner = re.findall(r"\w+", re.sub(r"\[[^\]]*\]", "", m["recv"]))[-1:] if m["recv"] else []
            test = not m["recv"] and name.startswith(GO_TESTS)
            full = "::".join([*owner, name])
            out.append((full, "Method" if m["recv"] else "Test" if test else "Function", at.line(m.start()), at.line(end), f"func {name}(…)", test, name[0].isupper()))
        elif m["many"]:
            stop = at.close.get(m.end() - 1, len(masked))
            place = m.end()
            while (n := re.compile(r"[^\W\d]").search(masked, place, stop)) and _GO_TYPE.match(masked, n.start()):
                place = declared(n.start())
                place = max(place, line_end(place) + 1)
        else:
            place = declared(m.end())
    return out


_SHARP_MODS = r"(?P<attrs>(?:\[[^\]]*\]\s*)*)(?P<mods>(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|async|override|virtual|const|new|extern|unsafe|volatile|required|ref|file)\s+)*)"
_SHARP_TYPE = re.compile(_SHARP_MODS + r"(?P<what>class|struct|interface|enum|record(?:\s+(?:class|struct))?)\s+(?P<name>[A-Za-z_]\w*)")
_SHARP_MEMBER = re.compile(_SHARP_MODS + r"(?:(?P<type>(?!return\b|throw\b|event\b|delegate\b|operator\b|new\b)[A-Za-z_][\w.]*(?:\s*<[^;{}()=]*>)?[\w\[\]?,. ]*?)\s+)?(?P<name>[A-Za-z_]\w*)\s*(?:<[^<>(){};]*>\s*)?(?P<next>=>|[({;=,])")


def csharp(source: str, masked: str) -> list[Row]:
    """Types and their members; the members of a nested type are of that type alone."""
    at = _Text(masked)
    out: list[Row] = []
    public_ = lambda m: "public" in m["mods"].split()

    def fields(m: re.Match, owner: str, stop: int) -> int:
        """The declarators of a field, each with its own lines."""
        place, kind = m.start("name"), "Const" if "const" in m["mods"].split() else "Field"
        while name := re.compile(r"\s*([A-Za-z_]\w*)").match(masked, place, stop):
            end = name.end()
            while (k := re.compile(r"[,;({\[]").search(masked, end, stop)) and k[0] in "({[":
                end = at.close.get(k.start(), stop) + 1
            end = k.start() if k else stop
            body = masked[name.start(1) : end].rstrip()
            out.append((f"{owner}::{name[1]}" if owner else name[1], kind, at.line(name.start(1)), at.line(name.start(1) + len(body) - 1), f"field {name[1]}", False, public_(m)))
            place = end + 1
            if not k or k[0] == ";":
                break
        return place

    def members(owner: str | None, start: int, stop: int) -> None:
        place = start
        while place < stop:
            inner = _SHARP_TYPE.search(masked, place, stop)
            m = _SHARP_MEMBER.search(masked, place, stop) if owner is not None else None
            if inner and (m is None or inner.start() <= m.start()):
                place = declare(inner, owner, stop)
                continue
            if m is None:
                return
            name = m["name"]
            first = at.line(m.start())
            end = min(at.end(m.start("next")), stop)
            if m["next"] == "(":
                close = at.close.get(m.start("next"), stop)
                tail = re.compile(r"[^{;=]*").match(masked, close + 1, stop)
                end = at.close.get(tail.end(), stop) if masked[tail.end() : tail.end() + 1] == "{" else min(x for x in (masked.find(";", tail.end(), stop), stop) if x >= 0)
                if not m["type"] and name == owner:
                    out.append((f"{owner}::new", "Method", first, at.line(end), f"{owner}::new(…)", False, public_(m)))
                elif m["type"]:
                    test = any(t in a for a in re.findall(r"[\w.]+", re.sub(r"\([^)]*\)", "", source[m.start("attrs") : m.end("attrs")])) for t in TEST_MARKS)
                    out.append((f"{owner}::{name}", "Test" if test else "Method", first, at.line(end), f"{name}(…)", test, public_(m)))
                place = end + 1
            elif m["type"] and m["next"] in ("{", "=>"):
                if m["next"] == "=>":
                    end = masked.find(";", m.end(), stop)
                    end = stop if end < 0 else end
                after = re.compile(r"\s*=[^;]*;").match(masked, end + 1, stop)
                end = after.end() - 1 if after else end
                out.append((f"{owner}::{name}", "Field", first, at.line(end), f"property {name}", False, public_(m)))
                place = end + 1
            elif m["type"]:
                place = fields(m, owner, stop)
            else:
                place = m.end()

    def declare(m: re.Match, owner: str | None, stop: int) -> int:
        end = min(at.end(m.end()), stop)
        kind = {"class": "Class", "struct": "Struct", "interface": "Interface", "enum": "Enum"}.get(m["what"])
        if kind:
            out.append((m["name"], kind, at.line(m.start()), at.line(end), f"{m['what']} {m['name']}", False, public_(m)))
        body = at.body(m.end(), end)
        if body and kind != "Enum":
            members(m["name"] if kind else owner, *body)
        return end + 1

    members(None, 0, len(masked))
    return out
