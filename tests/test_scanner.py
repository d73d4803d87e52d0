"""TypeScript texts made by a generator that knows what is in them: nested templates, markup, object methods, decoys."""

import random

import pytest

from graphloom.sources import parse


class Maker:
    """Makes expressions and statements, and notes who calls what as it goes."""

    def __init__(self, seed, markup):
        self.rng, self.markup, self.n = random.Random(seed), markup, 0
        self.calls, self.functions = set(), set()

    def name(self, kind):
        self.n += 1
        return f"{kind}{self.n}"

    def expression(self, owner, depth):
        kinds = ["number", "string", "regex", "call", "template", "object", "comment", "divide", "member", "new"] + ["element", "element"] * self.markup
        kind = self.rng.choice(kinds if depth else ["number", "string", "regex"])
        inner = lambda: self.expression(owner, depth - 1)
        if kind == "number":
            return str(self.rng.randrange(100))
        if kind == "string":
            return self.rng.choice(['"decoy(1) { ` ${decoy(2)}"', "'it\\'s // decoy(3) {'", "`plain decoy(4) } \\` \\${x}`", '""'])
        if kind == "regex":
            return self.rng.choice([r"/decoy\(5\)[/\"'`{]/g", r"/[`]decoy(6)\//", r"/'/"])
        if kind == "call":
            f = self.name("call")
            self.calls.add((owner, f))
            return f"{f}({', '.join(inner() for _ in range(self.rng.randrange(3)))})"
        if kind == "new":
            f = self.name("Made")
            self.calls.add((owner, f))
            return f"new {f}({inner()})"
        if kind == "member":
            f, o = self.name("meth"), self.name("obj")
            self.calls |= {(owner, f), (owner, o)}
            return f"{o}.{f}({inner()})"
        if kind == "template":
            return f"`decoy(7) {{ ${{{inner()}}} \" // decoy(8) ${{ {inner()} }} '`"
        if kind == "comment":
            return f"/* decoy(9) ` {{ */ {inner()}"
        if kind == "divide":
            return f"(1 / {inner()} / 2)"
        if kind == "object":
            m = self.name("own")
            self.functions.add(m)
            return f"({{ a: {inner()}, {self.rng.choice(['', 'async ', 'get '])}{m}(p: number) {{ return {self.expression(m, depth - 1)}; }}, 'b': 1 }})"
        c = self.name("Comp")
        self.calls.add((owner, c))
        if self.rng.random() < 0.3:
            return f'<{c} a={{{inner()}}} b="decoy(10)" />'
        return f"<{c} a='decoy(11) {{'>it's decoy(12) // ` {{{inner()}}} <b>decoy(13)</b>{{/* decoy(14) */}}</{c}>"

    def statement(self, depth):
        kind = self.rng.choice(["function", "arrow", "class", "plain"])
        if kind == "plain":
            return f"use = {self.expression('', depth)};\n"
        f = self.name("fn")
        if kind == "class":
            self.functions.add(f)
            return f"class {self.name('Cls')} {{\n  x = 1;\n  private async {f}(a: string, b = 2): Promise<void> {{\n    if (a < b) {{ return {self.expression(f, depth)}; }}\n  }}\n}}\n"
        self.functions.add(f)
        body = f"{{\n  const k = {self.expression(f, depth)};\n  return {self.expression(f, depth)};\n}}\n"
        return f"function {f}(a) {body}" if kind == "function" else f"export const {f} = async (a) => {body}"


@pytest.mark.parametrize("markup", [False, True])
def test_generated_texts(markup):
    for seed in range(300):
        made = Maker(seed, markup)
        text = "// decoy(15) `\n" + "".join(made.statement(3) for _ in range(4))
        path = "a.tsx" if markup else "a.ts"
        found = parse.parse_typescript(path, text)
        names = {n[0]: n[2] for n in found.nodes}
        calls = {(names.get(a, ""), b) for a, b, kind, _ in found.edges if kind == "CALLS"}
        assert calls == made.calls, text
        assert {n[2] for n in found.nodes if n[1] == "Function"} == made.functions, text


def test_odd_texts_end():
    for text in ("`", "`${", "`${`", "/*", "'", '"\n', "<A", "<A>", "<A>{", "</A>", "}", "a = <", "/x", "${}", "`\\", "{{{", "<A b='", "\\"):
        for path in ("a.ts", "a.tsx"):
            parse.parse_typescript(path, text)
    found = parse.parse_typescript("a.tsx", "import a from './a'\nexport { b } from './b'\nconst c = require('./c');\nfunction k<T>(x: T) { return x as Array<T>; }\nexport { k as z };")
    assert {e[1] for e in found.edges if e[2] == "IMPORTS"} == {"file:a", "file:c"} and not [e for e in found.edges if e[2] == "CALLS"]
    assert [n[5] for n in found.nodes] == [True]
