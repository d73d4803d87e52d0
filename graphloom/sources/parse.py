"""Source text -> symbols, edges and tags, one parser a language, without grammars from outside.

Python goes through its own syntax tree. The other languages are read by a scanner: comments and
strings are blanked in place (so offsets keep), declarations are found by pattern on what is left, and
braces give their extents. parse() is what a worker calls for each file; a file that
fails gives no rows but a message.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import TAGS
from graphloom.operators.storage import ship, spread

_TAG = {t: re.compile(rf"(?<![A-Za-z0-9_]){t}(?![A-Za-z0-9_])") for t in TAGS}
_ANY_TAG = re.compile("|".join(TAGS))
_NOT_NEWLINE, _NEWLINE, _BRACES, _PARENS, _STOPS = re.compile(r"[^\n]"), re.compile("\n"), re.compile(r"[{}]"), re.compile(r"[()]"), re.compile(r"[(){};]")
_C_LIKE = re.compile(r"""(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)""", re.S)
_RUST = re.compile(r"""(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>r(?P<h>\#*)".*?"(?P=h)|"(?:\\.|[^"\\])*"?|'(?:\\.[^']*|[^'\\])')""", re.S)
_PHP = re.compile(r"""(?P<c>//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?)""", re.S)
#: Words before '(' that are no calls, by language.
_COMMON = "if for while switch catch return function new else do in of throw case super await try"
_WORDS = {k: frozenset(f"{_COMMON} {more}".split()) for k, more in {
    "ts": "async typeof import require delete void instanceof with yield", "go": "func go defer select range", "java": "synchronized instanceof",
    "php": "echo print isset empty array list and or elseif foreach fn match require require_once include include_once",
}.items()}


@dataclass
class Parsed:
    """nodes: (id, kind, name, line_start, line_end, exported, complexity, doc); edges: (src, dst, kind, confidence); tags: (type, text, line, comment kind)."""

    path: str
    nodes: list[tuple] = field(default_factory=list)
    edges: list[tuple] = field(default_factory=list)
    tags: list[tuple] = field(default_factory=list)

    def symbol(self, kind: str, name: str, first: int, last: int, exported: bool, complexity: float = 0.0, doc: str | None = None) -> str:
        key = f"{'cls' if kind == 'Class' else 'fn'}:{self.path}:{name}"
        self.nodes.append((key, kind, name, first, last, exported, complexity, doc))
        self.edges.append((f"file:{self.path}", key, "EXPORTS", 1.0))
        return key


def join_path(current: str, imported: str) -> str:
    """. stays, .. goes up, anything else goes down from the file's directory."""
    parts = current.split("/")[:-1]
    for part in imported.split("/"):
        if part == "..":
            parts = parts[:-1]
        elif part != ".":
            parts.append(part)
    return "/".join(parts)


class Scan:
    """A text with comments and strings blanked, and where they were."""

    def __init__(self, text: str, pattern: re.Pattern):
        self.text = text
        self.comments, self.strings = [], []
        out, at = [], 0
        for m in pattern.finditer(text):
            (self.comments if m["c"] is not None else self.strings).append(m.span())
            out += [text[at : m.start()], _NOT_NEWLINE.sub(" ", m[0])]
            at = m.end()
        self._set("".join(out) + text[at:])

    def _set(self, plain: str) -> None:
        """The blanked text, where its lines start, and where each brace closes."""
        self.plain = plain
        self.starts = [0, *(m.end() for m in _NEWLINE.finditer(self.text))]
        self.close: dict[int, int] = {}
        stack = []
        for m in _BRACES.finditer(plain):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def body(self, at: int) -> tuple[int, int] | None:
        """The braces that open from here before the next ';' outside parentheses."""
        depth = 0
        for m in _STOPS.finditer(self.plain, at):
            if m[0] == "(":
                depth += 1
            elif m[0] == ")":
                depth -= 1
            elif depth <= 0 and m[0] == "{":
                return m.start(), self.close.get(m.start(), len(self.plain))
            elif depth <= 0 and m[0] in ";}":
                return None
        return None

    def after_params(self, at: int) -> int:
        """The offset after the parentheses that open at or after here."""
        depth = 0
        for m in _PARENS.finditer(self.plain, at):
            depth += 1 if m[0] == "(" else -1
            if depth <= 0:
                return m.end()
        return len(self.plain)

    def doc(self, line: int, keep: Callable[[str], bool], within: int = 3) -> str | None:
        """The nearest kept comment that ends at most `within` lines above, with its run of line comments, markers taken off."""
        above = [(a, b) for a, b in self.comments if self.line(b - 1) < line]
        run: list[str] = []
        want = line
        for a, b in reversed(above):
            end = self.line(b - 1)
            if want - end > (within if not run else 1) or not keep(self.text[a:b]):
                break
            run.insert(0, self.text[a:b])
            want = self.line(a)
            if run[0].startswith("/*"):
                break
        return stripped(run) or None


#: After one of these a slash begins a regular expression, and an angle bracket markup.
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do await yield default extends instanceof".split())
_VALUE_END = re.compile(r"[\w$)\]}]\Z")
_LAST_WORD = re.compile(r"[A-Za-z_$][\w$]*\Z")
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TAG_OPENS = re.compile(r"<(?:>|([A-Za-z_$][\w$.:-]*)(?!\s*(?:,|extends\b))(?=[\s/>{]))")


#: What ends a stretch of code, a template's text and an element's text; the pieces of a tag; the rest of a string.
_SPECIAL = re.compile(r"""//[^\n]*|/\*|["'`/<{}]""")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|(?!\$\{)[^`\\])*")
_ELEMENT_TEXT = re.compile(r"[^<{]*")
_IN_TAG = re.compile(r"""\s+|"[^"]*"?|'[^']*'?|/>|[>{]|[^\s"'/>{]+|/""")
_QUOTED = {q: re.compile(rf"(?:\\[\s\S]|[^{q}\\\n])*{q}?") for q in "\"'"}


class ScriptScan(Scan):
    """A Scan of TypeScript or JavaScript, with a stack of modes.

    In code, comments, strings and regular expressions are blanked. A template blanks its text, and what stands in ${} is code again, to any depth. Where
    markup may occur, an element's text is blanked and what stands in its braces is code; its tags stay, without attribute strings.
    """

    def __init__(self, text: str, markup: bool):
        self._markup = markup
        self._spans: list[tuple[int, int, str]] = []
        #: Where elements open, and their names.
        self.elements: list[tuple[int, str]] = []
        self._walk(text)
        self.text, self.comments, self.strings = text, [], []
        plain = list(text)
        for a, b, kind in self._spans:
            plain[a:b] = _NOT_NEWLINE.sub(" ", text[a:b])
            if kind == "c":
                self.comments.append((a, b))
            elif kind == "s":
                self.strings.append((a, b))
        self._set("".join(plain))

    def _walk(self, text: str) -> None:
        """Fills the spans to blank: comments c, strings s, other o."""
        stack: list[list] = [["code", 0]]  # mode, and open braces in code, or where a template began
        at, n, before = 0, len(text), ""  # before: the end of what was last seen in code
        blank = self._spans.append
        while at < n:
            mode = stack[-1]
            if mode[0] == "template":
                m = _TEMPLATE.match(text, at)
                whole = text[m.end() : m.end() + 1] == "`" and mode[1] == at - 1
                if text[m.end() : m.end() + 2] != "${":
                    blank((at - 1 if whole else at, min(n, m.end() + 1), "s" if whole else "o"))
                    stack.pop()
                    at, before = m.end() + 1, ")"
                else:
                    blank((at, m.end() + 2, "o"))
                    stack.append(["code", 0, "template"])
                    at, before = m.end() + 2, ""
            elif mode[0] == "text":
                m = _ELEMENT_TEXT.match(text, at)
                blank((at, m.end(), "o"))
                at = m.end()
                if text[at : at + 1] == "{":
                    stack.append(["code", 0, "text"])
                    at, before = at + 1, ""
                elif text[at : at + 2] == "</":
                    end = text.find(">", at)
                    stack.pop()
                    at, before = (end + 1 if end >= 0 else n), ")"
                elif at < n:
                    at = self._tag(stack, text, at)
            elif mode[0] == "tag":
                m = _IN_TAG.match(text, at)
                at = m.end()
                if m[0][0] in "\"'":
                    blank((m.start(), m.end(), "o"))
                elif m[0] == "{":
                    stack.append(["code", 0, "tag"])
                    before = ""
                elif m[0] == "/>":
                    stack.pop()
                    before = ")"
                elif m[0] == ">":
                    stack[-1] = ["text"]
            else:
                m = _SPECIAL.search(text, at)
                if not m:
                    return
                passed = text[at : m.start()].split()
                if passed:
                    before = passed[-1]
                word, at = m[0], m.end()
                if word.startswith("//"):
                    blank((m.start(), at, "c"))
                elif word == "/*":
                    end = text.find("*/", at)
                    at = end + 2 if end >= 0 else n
                    blank((m.start(), at, "c"))
                elif word in "\"'":
                    end = _QUOTED[word].match(text, at).end()
                    blank((m.start(), end, "s"))
                    at, before = end, ")"
                elif word == "`":
                    stack.append(["template", m.start()])
                    blank((m.start(), at, "o"))
                elif word == "/":
                    found = None if self._value(before) else _REGEX.match(text, m.start())
                    if found:
                        blank((m.start(), found.end(), "o"))
                        at, before = found.end(), ")"
                    else:
                        before = word
                elif word == "<" and self._markup and not self._value(before) and _TAG_OPENS.match(text, m.start()):
                    at = self._tag(stack, text, m.start())
                elif word == "{":
                    mode[1] += 1
                    before = word
                elif word == "}" and mode[1] == 0 and len(mode) > 2:
                    stack.pop()
                    if mode[2] == "template":
                        blank((m.start(), at, "o"))
                else:
                    mode[1] -= word == "}" and mode[1] > 0
                    before = word

    @staticmethod
    def _value(before: str) -> bool:
        """Whether what ends so is a value, after which an operator comes."""
        if not _VALUE_END.search(before):
            return False
        word = _LAST_WORD.search(before)
        return not (word and word[0] in _BEFORE_VALUE)

    def _tag(self, stack: list[list], text: str, at: int) -> int:
        """Enters an element at its bracket; or leaves a lone one as text."""
        m = _TAG_OPENS.match(text, at)
        if not m:
            self._spans.append((at, at + 1, "o"))
            return at + 1
        if m[1]:
            self.elements.append((at, m[1]))
        stack.append(["text"] if m[0] == "<>" else ["tag"])
        return m.end()


def stripped(comments: list[str]) -> str:
    """The words of a doc comment."""
    out = []
    for c in comments:
        c = re.sub(r"^/\*\*?|\*/$", "", c.strip())
        for line in c.split("\n"):
            out.append(re.sub(r"^\s*(?:///|//!|//|\*|\#)\s?", "", line).strip())
    return "\n".join(x for x in out if x).strip()


#: A name is tried once, from its begin to its end.
_CALL = re.compile(r"(?=[A-Za-z_$])(?P<new>\bnew\s+)?(?<![A-Za-z_$])(?:(?P<obj>[A-Za-z_$][\w$]*+)\s*\??(?:\.|->|::)\s*)?(?P<name>[A-Za-z_$][\w$]*+)\s*(?:<[\w\s,<>\[\]]*>)?\(")


def _calls(out: Parsed, scan: Scan, owners: list[tuple[int, int, str]], skip: set[int], words: str, jsx: bool = False, objects: bool = True) -> None:
    """CALLS from the innermost named function around each call, else from the file."""
    owners = sorted(owners)

    def owner(at: int) -> str:
        best = None
        for a, b, key in owners:
            if a > at:
                break
            if at < b and (best is None or a >= best[0]):
                best = (a, key)
        return best[1] if best else f"file:{out.path}"

    for m in _CALL.finditer(scan.plain):
        if m["name"] in _WORDS[words] or m.start("name") in skip:
            continue
        src = owner(m.start("name"))
        out.edges.append((src, m["name"], "CALLS", 0.7))
        if objects and m["obj"] and not m["new"] and m["obj"] not in ("this", "self", "super") and m["obj"] not in _WORDS[words]:
            out.edges.append((src, m["obj"], "CALLS", 0.6))
    if jsx:
        out.edges += [(owner(at), name, "CALLS", 0.6) for at, name in scan.elements if re.fullmatch(r"[A-Z][\w$]*", name)]


def _tags(out: Parsed, scan: Scan) -> None:
    """The first tagged line of each comment; within a line the order of TAGS decides."""
    for a, b in scan.comments:
        comment = scan.text[a:b]
        if not _ANY_TAG.search(comment):
            continue
        for k, line in enumerate(comment.split("\n")):
            tag = next((t for t in TAGS if _TAG[t].search(line)), None)
            if tag:
                in_jsx = scan.text[:a].rstrip().endswith("{") and scan.text[b:].lstrip().startswith("}")
                kind = ("jsx_commented_code" if "<" in comment else "jsx") if in_jsx else "code"
                out.tags.append((tag, line.strip(" \t/*#"), scan.line(a) + k, kind))
                break


_BRANCH = re.compile(r"\b(?:if|for|while|do|switch|catch)\b|&&|\|\||\?(?![.?:])")


def _complexity(scan: Scan, a: int, b: int) -> float:
    """Branches, each 1 and half more for every branch around it, and half a point for && and ||; in hundredths, at most 1."""
    score, ends = 0.0, []
    for m in _BRANCH.finditer(scan.plain, a, b):
        ends = [e for e in ends if e > m.start()]
        if m[0] in ("&&", "||"):
            score += 0.5
            continue
        score += 1 + 0.5 * len(ends)
        inner = scan.body(scan.after_params(m.end()) if m[0] in ("if", "for", "while", "switch", "catch") else m.end()) if m[0] != "?" else None
        ends.append(inner[1] if inner else end if (end := scan.plain.find("\n", m.end())) >= 0 else b)
    return min(score, 100.0) / 100


_METHOD = re.compile(r"(?=[*#A-Za-z_$])(?<![A-Za-z_$])(?:\b(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?(?P<name>\#?[A-Za-z_$][\w$]*+)\s*(?:<[^>(]*>)?\(")
_METHOD_BODY = re.compile(r"\s*(?::\s*[^{;=]*(?:\{[^{}]*\}[^{;=]*)?)?\{")
_IMPORTS = re.compile(r"\brequire\s*\(\s*$|\bimport\s*\(?\s*$|\bimport\b(?:(?!\b(?:im|ex)port\b)[^;])*\bfrom\s*$")


def parse_typescript(path: str, text: str) -> Parsed:
    markup = path.endswith((".tsx", ".jsx", ".js"))
    out, scan = Parsed(path), ScriptScan(text, markup)
    exported = {n.strip().split(" as ")[0] for m in re.finditer(r"\bexport\s*\{([^}]*)\}", scan.plain) for n in m[1].split(",") if n.strip()}
    keep = lambda c: c.startswith(("/**", "///"))
    owners, skip, classes = [], set(), []
    for m in re.finditer(r"(?=[eac])(?P<export>\bexport\s+(?:default\s+)?)?(?:abstract\s+)?\bclass\s+(?P<name>[A-Za-z_$][\w$]*)", scan.plain):
        body = scan.body(m.end()) or (m.end(), m.end())
        classes.append(body)
        line = scan.line(m.start())
        out.symbol("Class", m["name"], line, scan.line(body[1]), bool(m["export"]) or m["name"] in exported, _complexity(scan, *body), scan.doc(line, keep))

    def function(m: re.Match, start: int, body: tuple[int, int] | None, is_exported: bool) -> None:
        end = body[1] if body else m.end()
        line = scan.line(start)
        key = out.symbol("Function", m["name"], line, scan.line(end), is_exported, _complexity(scan, start, end), scan.doc(line, keep))
        owners.append((m.start("name"), end, key))
        skip.add(m.start("name"))

    for m in re.finditer(r"(?=[eaf])(?P<export>\bexport\s+(?:default\s+)?)?(?:async\s+)?\bfunction\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)", scan.plain):
        function(m, m.start(), scan.body(scan.after_params(m.end())), bool(m["export"]) or m["name"] in exported)
    for m in re.finditer(r"(?=[eclv])(?P<export>\bexport\s+)?\b(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=;]*)?=\s*(?:async\s+)?(?:function\b|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[A-Za-z_$][\w$]*)\s*(?::[^={]*)?=>)", scan.plain):
        rest = re.compile(r"\s*").match(scan.plain, m.end()).end()
        body = scan.body(m.end()) if m[0].endswith("function") or scan.plain[rest : rest + 1] == "{" else None
        if body is None:
            end = scan.plain.find("\n", m.end())
            body = (m.end(), end if end >= 0 else len(scan.plain))
        function(m, m.start(), body, bool(m["export"]) or m["name"] in exported)
    at = 0  # methods of classes and of object literals
    while m := _METHOD.search(scan.plain, at):
        after = scan.after_params(m.end() - 1)
        tail = _METHOD_BODY.match(scan.plain, after)
        at = m.end()
        if m["name"] in _WORDS["ts"] or m.start("name") in skip or not tail or scan.plain[: m.start()].rstrip()[-1:] not in ("{", "}", ",", ";", ")", '"', ""):
            continue
        open_at = tail.end() - 1
        function(m, m.start("name"), (open_at, scan.close.get(open_at, len(scan.plain))), m["name"] in exported)
        at = after
    for a, b in scan.strings:
        if text[a + 1 : a + 2] == ".":
            before = scan.plain[max(0, a - 2000) : a]
            if _IMPORTS.search(before):
                out.edges.append((f"file:{path}", f"file:{join_path(path, text[a + 1 : b - 1])}", "IMPORTS", 1.0))
    _calls(out, scan, owners, skip, "ts", jsx=markup)
    _tags(out, scan)
    return out


def parse_python(path: str, text: str) -> Parsed:
    out = Parsed(path)
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "Class" if isinstance(node, ast.ClassDef) else "Function"
            out.symbol(kind, node.name, node.lineno, node.end_lineno or node.lineno, not node.name.startswith("_"), 0.0, ast.get_docstring(node))
        elif isinstance(node, ast.Import):
            out.edges += [(f"file:{path}", f"file:{a.name.replace('.', '/')}.py", "IMPORTS", 1.0) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and (node.module or node.level):
            module = (node.module or "").replace(".", "/")
            target = join_path(path, "/".join([*[".."] * (node.level - 1), *([module] if module else ["__init__"])])) if node.level else module
            out.edges.append((f"file:{path}", f"file:{target}.py", "IMPORTS", 1.0))
    return out


def parse_rust(path: str, text: str, bare_modules: bool = False) -> Parsed:
    """bare_modules: `use crate::m;` imports src/m.rs as well."""
    out, scan = Parsed(path), Scan(text, _RUST)
    keep = lambda c: c.startswith(("///", "/**"))
    public = set(re.findall(r"\bpub(?:\([^)]*\))?\s+(?:(?:async|const|unsafe|extern)\s+)*(?:fn|struct|enum|trait)\s+(\w+)", scan.plain))
    for m in re.finditer(r"\b(fn|struct|enum|trait)\s+(\w+)", scan.plain):
        body = scan.body(scan.after_params(m.end()) if m[1] == "fn" else m.end())
        line = scan.line(scan.plain.rfind("\n", 0, m.start()) + 1)
        out.symbol("Function" if m[1] == "fn" else "Class", m[2], line, scan.line(body[1] if body else m.end()), m[2] in public, 0.0, scan.doc(line, keep, 4))
    for m in re.finditer(r"\buse\s+([\w:]+)", scan.plain):
        parts = [p for p in m[1].split("::") if p]
        if parts[0] == "crate" and (len(parts) > 2 or (bare_modules and len(parts) == 2)):
            inner = parts[1:-1] or parts[1:]
            out.edges.append((f"file:{path}", f"file:src/{'/'.join(inner)}.rs", "IMPORTS", 1.0))
        elif len(parts) == 1 and parts[0] != "crate":
            out.edges.append((f"file:{path}", f"file:{parts[0]}.rs", "IMPORTS", 1.0))
    for m in re.finditer(r"\bimpl(?:<[^{;]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)", scan.plain):
        out.edges.append((f"file:{path}", f"cls:{path}:{m[1]}", "EXPORTS", 1.0))
    return out


def parse_go(path: str, text: str) -> Parsed:
    out, scan = Parsed(path), Scan(text, _C_LIKE)
    keep = lambda c: c.startswith(("//", "/*"))
    owners, skip = [], set()
    for m in re.finditer(r"^func\s*(?:\([^)]*\)\s*)?(?P<name>\w+)", scan.plain, re.M):
        body = scan.body(scan.after_params(m.end()))
        line = scan.line(m.start())
        key = out.symbol("Function", m["name"], line, scan.line(body[1] if body else m.end()), m["name"][0].isupper(), 0.0, scan.doc(line, keep, 1))
        skip.add(m.start("name"))
        if body:
            owners.append((*body, key))
    for m in re.finditer(r"^type\s+(\w+)", scan.plain, re.M):
        body, line = scan.body(m.end()), scan.line(m.start())
        out.symbol("Class", m[1], line, scan.line(body[1]) if body else line, m[1][0].isupper(), 0.0, scan.doc(line, keep, 1))
    block = [m.span() for m in re.finditer(r"^import\s*(?:\([^)]*\)|[^\n]*)", scan.plain, re.M)]
    for a, b in scan.strings:
        if any(x <= a < y for x, y in block) and text[a + 1 : a + 2] == ".":
            out.edges.append((f"file:{path}", f"file:{join_path(path, text[a + 1 : b - 1])}", "IMPORTS", 1.0))
    _within(out, scan, owners, skip, "go")
    return out


def _within(out: Parsed, scan: Scan, owners: list, skip: set[int], words: str) -> None:
    """Calls inside named functions only."""
    inner = Parsed(out.path)
    _calls(inner, scan, owners, skip, words, objects=False)
    out.edges += [e for e in inner.edges if not e[0].startswith("file:")]


def parse_java(path: str, text: str) -> Parsed:
    out, scan = Parsed(path), Scan(text, _C_LIKE)
    keep = lambda c: c.startswith("/**")
    owners, skip = [], set()
    for m in re.finditer(r"\b(?:class|interface)\s+(\w+)", scan.plain):
        body, line = scan.body(m.end()), scan.line(m.start())
        out.symbol("Class", m[1], line, scan.line(body[1]) if body else line, False, 0.0, scan.doc(line, keep, 4))
    method = r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|async|override|virtual|internal)\s+)*(?:<[^>]+>\s*)?(?:[\w.<>\[\],? ]+\s+)?(?P<name>\w+)\s*\("
    for m in re.finditer(method, scan.plain, re.M):
        if m["name"] in _WORDS["java"] or re.match(r"\s*(?:return|new|throw|else)\b", m[0]):
            continue
        tail = re.compile(r"\s*(?:throws\s+[\w.,\s]+)?[{;]").match(scan.plain, scan.after_params(m.end() - 1))
        if not tail or (tail[0].endswith(";") and not re.search(r"\b(?:abstract|native)\b|\w\s+\w+\s*\($", m[0])):
            continue
        if tail[0].endswith(";") and any(a < m.start() < b for a, b, _ in owners):
            continue
        body = (tail.end() - 1, scan.close.get(tail.end() - 1, tail.end()))
        line = scan.line(m.start("name"))
        key = out.symbol("Function", m["name"], line, scan.line(body[1]), False, 0.0, scan.doc(line, keep, 4))
        owners.append((*body, key))
        skip.add(m.start("name"))
    for m in re.finditer(r"^import\s+(?:static\s+)?([\w.]+);", scan.plain, re.M):
        out.edges.append((f"file:{path}", f"file:{m[1].replace('.', '/')}.java", "IMPORTS", 1.0))
    _within(out, scan, owners, skip, "java")
    return out


def parse_php(path: str, text: str) -> Parsed:
    out, scan = Parsed(path), Scan(text, _PHP)
    keep = lambda c: c.startswith("/**")
    owners, skip = [], set()
    for m in re.finditer(r"\b(?:class|interface)\s+(\w+)", scan.plain):
        body, line = scan.body(m.end()), scan.line(m.start())
        out.symbol("Class", m[1], line, scan.line(body[1]) if body else line, False, 0.0, scan.doc(line, keep, 4))
    for m in re.finditer(r"\bfunction\s+&?(?P<name>\w+)\s*\(", scan.plain):
        body = scan.body(scan.after_params(m.end() - 1))
        line = scan.line(m.start())
        key = out.symbol("Function", m["name"], line, scan.line(body[1] if body else m.end()), False, 0.0, scan.doc(line, keep, 4))
        skip.add(m.start("name"))
        if body:
            owners.append((*body, key))
    for a, b in scan.strings:
        if re.search(r"\b(?:include|require)(?:_once)?\b\s*\(?\s*$", scan.plain[max(0, a - 200) : a]):
            out.edges.append((f"file:{path}", f"file:{join_path(path, text[a + 1 : b - 1])}", "IMPORTS", 1.0))
    _within(out, scan, owners, skip, "php")
    return out


#: Parsers by language; register() adds others.
PARSERS: dict[str, Callable[[str, str], Parsed]] = {
    "typescript": parse_typescript, "javascript": parse_typescript, "python": parse_python, "rust": parse_rust,
    "go": parse_go, "java": parse_java, "csharp": parse_java, "php": parse_php,
}


def register(language: str, parser: Callable[[str, str], Parsed]) -> None:
    """Adds a parser, or takes another one for a language; extract() sends it to the workers as it is then."""
    PARSERS[language] = parser


def parse(path: str, language: str, text: str, parsers: dict[str, Callable[[str, str], Parsed]] | None = None) -> tuple[Parsed, str | None]:
    """What the language's parser sees, and the message of a failure; unknown languages have nothing."""
    parser = (PARSERS if parsers is None else parsers).get(language)
    if parser is None:
        return Parsed(path), None
    try:
        return parser(path, text), None
    except Exception as why:  # one broken file is a row with a message
        return Parsed(path), f"{type(why).__name__}: {why}"


#: Files whose findings are Python objects at a time.
SLICE_FILES = 1000

SCHEMA = (
    "path string, language string, error string, "
    "nodes array<struct<id:string,kind:string,name:string,line_start:int,line_end:int,exported:boolean,complexity:double,doc_comment:string>>, "
    "edges array<struct<src:string,dst:string,kind:string,confidence:double>>, "
    "tags array<struct<tag_type:string,text:string,line:int,comment_type:string>>"
)


def extract(files: DataFrame, dealt: bool = False) -> DataFrame:
    """One row a file (path, language, content) with arrays of what its parser saw; parsed where they are, in Arrow batches.

    Parsing costs far more than sending a text, so the files are dealt over tasks by path first, unless the caller has dealt them. Read what
    comes back more than once from a stored() copy, as each plan that reads it parses all files again.
    """
    ship(files.sparkSession)
    parsers = dict(PARSERS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = {
            "nodes": (("id", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("exported", pa.bool_()), ("complexity", pa.float64()), ("doc_comment", pa.string())),
            "edges": (("src", pa.string()), ("dst", pa.string()), ("kind", pa.string()), ("confidence", pa.float64())),
            "tags": (("tag_type", pa.string()), ("text", pa.string()), ("line", pa.int32()), ("comment_type", pa.string())),
        }

        def lists(found: list[list[tuple]], fields: tuple) -> pa.Array:
            flat = list(zip(*(x for xs in found for x in xs), strict=True)) or [()] * len(fields)
            rows = pa.StructArray.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(flat, fields, strict=True)], [name for name, _ in fields])
            ends = [0]
            for xs in found:
                ends.append(ends[-1] + len(xs))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_FILES):
                part = batch.slice(at, SLICE_FILES)
                paths, languages = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = [parse(path, language or "", content or "", parsers) for path, language, content in zip(paths, languages, part.column(2).to_pylist(), strict=True)]
                found = [p for p, _ in rows]
                columns = [part.column(0), part.column(1), pa.array([error for _, error in rows], pa.string())]
                columns += [lists([getattr(p, c) for p in found], names[c]) for c in ("nodes", "edges", "tags")]
                yield pa.RecordBatch.from_arrays(columns, ["path", "language", "error", "nodes", "edges", "tags"])

    texts = files.select("path", "language", "content")
    return (texts if dealt else spread(texts, "path")).mapInArrow(run, SCHEMA)


def nodes_of(parsed: DataFrame) -> DataFrame:
    """Symbols; of several with one id the last in the file stays."""
    rows = parsed.select("path", "language", F.posexplode("nodes").alias("k", "n"))
    last = rows.groupBy("path", "language", F.col("n.id").alias("id")).agg(F.max_by("n", "k").alias("n"))
    return last.select("id", "n.kind", "n.name", "path", "n.line_start", "n.line_end", "language", "n.exported", "n.complexity", "n.doc_comment")


def edges_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode("edges").alias("e")).select("e.src", "e.dst", "e.kind", F.lit(1.0).alias("weight"), "e.confidence").distinct()


def tags_of(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.col("path").alias("file_path"), F.explode("tags").alias("t")).select("file_path", "t.*")
    return rows.select(F.concat_ws(":", F.lit("tag"), "file_path", F.col("line").cast("string"), "tag_type").alias("id"), "file_path", "tag_type", "text", "line", "comment_type")
