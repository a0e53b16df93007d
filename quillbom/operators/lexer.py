"""Tokens of JavaScript and TypeScript, in one pass from left to right.

Where a slash begins a regular expression, and where a brace ends a piece of a template, depends on
what stands before: so the lexer keeps whether an expression may begin and a stack of open
brackets, a pushdown automaton. Every character is looked at a bounded number of times, in broken
code too: a quote that is not closed is a mark, and none of its kind is tried again before the end
of its line (a template's: of the file).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_piece = re.compile(
    r"""(?P<space>\s+)
|(?P<comment>//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\Z))
|(?P<name>\#?[^\W\d][\w$]*+|\$[\w$]*+)
|(?P<number>(?:\d|\.\d)[\w.]*+)
|(?P<mark>\?\.(?!\d)|=>|\+\+|--|\.\.\.|.)""",
    re.X | re.S,
)
#: The rest of a literal after its first quote; group 1 is empty if it is not closed.
_rest = {
    "'": re.compile(r"[^'\\\n]*+(?:\\.[^'\\\n]*+)*+('?)", re.S),
    '"': re.compile(r"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+(\"?)", re.S),
    "`": re.compile(r"[^`\\$]*+(?:(?:\\.|\$(?!\{))[^`\\$]*+)*+(`|\$\{|)", re.S),
    "/": re.compile(r"(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++((?:/[A-Za-z]*+)?)"),
}
#: Words after which an expression begins.
BEFORE_OPERAND = frozenset("return typeof case in of delete void throw new instanceof do else yield await extends default".split())
#: Words whose condition in brackets is followed by a statement.
CONDITIONS = frozenset("if while for with".split())
#: Words that stand before a bracket and are no call.
NO_CALLS = frozenset("if while for with switch catch function return typeof case in of delete void throw new instanceof do else yield await super async".split())
#: After these, a brace opens a block, and what follows the block is a statement.
_BEFORE_BLOCK = frozenset(("", "=>", ";", "{", "}", ")", "else", "do", "try", "finally"))


def tokens(code: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, place): comment, name, number (a sign before it is its own), text (strings, and pieces of templates), regex, mark."""
    at, n, before = 0, len(code), ""
    operand = True  # an expression may begin here, so a slash begins a regular expression
    dead = dict.fromkeys(_rest, -1)
    brackets: list[tuple[str, bool]] = []  # opener, and whether an operand may follow the closing one

    def literal(quote: str, start: int) -> int:
        """The end of the literal whose rest begins there, or 0 if it is not closed."""
        if start <= dead[quote]:
            return 0
        m = _rest[quote].match(code, start)
        if m and m[1]:
            return m.end()
        if quote == "/":
            end = code.find("\n", start)
            dead[quote] = n if end < 0 else end
        else:
            dead[quote] = m.end()
        return 0

    if code.startswith("#!"):
        at = code.find("\n") if "\n" in code else n
        yield "comment", code[:at], 0
    while at < n:
        m = _piece.match(code, at)
        kind, value, start = m.lastgroup, m[0], at
        at = m.end()
        if kind == "space":
            continue
        if kind == "comment":
            yield kind, value, start
            continue
        if kind == "name":
            follows = value in BEFORE_OPERAND and before not in (".", "?.")
            yield kind, value, start
            operand, before = follows, value
            continue
        if kind == "number":
            yield kind, value, start
            operand, before = False, "0"
            continue
        if value in ("'", '"', "`") or value == "/" and operand and before != "<":
            if end := literal(value, at):
                yield "regex" if value == "/" else "text", code[start:end], start
                at, operand, before = end, False, "0"
                if value == "`" and code[end - 1] == "{":
                    brackets.append(("`", False))
                    operand, before = True, "("
                continue
        elif value == "-" and operand and (m := _piece.match(code, at)) and m.lastgroup == "number":
            yield "number", value + m[0], start
            at, operand, before = m.end(), False, "0"
            continue
        elif value == "(":
            brackets.append((value, before in CONDITIONS))
            operand = True
        elif value == "[":
            brackets.append((value, False))
            operand = True
        elif value == "{":
            brackets.append((value, not operand or before in _BEFORE_BLOCK))
            operand = True
        elif value == "}" and brackets and brackets[-1][0] == "`":
            brackets.pop()
            if end := literal("`", at):
                yield "text", code[start:end], start
                at, operand, before = end, False, "0"
                if code[end - 1] == "{":
                    brackets.append(("`", False))
                    operand, before = True, "("
                continue
        elif value in (")", "]", "}"):
            operand = brackets.pop()[1] if brackets and brackets[-1][0] != "`" else False
        elif value not in ("++", "--"):
            operand = True
        yield kind, value, start
        before = value


def without_comments(code: str) -> str:
    """The code with a space in place of each block comment, whose line feeds stay."""
    out, at = [], 0
    if "/*" not in code:
        return code
    for kind, value, start in tokens(code):
        if kind == "comment" and value.startswith("/*"):
            out += [code[at:start], " ", "\n" * value.count("\n")]
            at = start + len(value)
    out.append(code[at:])
    return "".join(out)


def paths(found: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """The tokens with members joined to one name: a.b, a?.b, a['b'], and require('m').b as m.b."""
    out: list[tuple[str, str, int]] = []
    i, n = 0, len(found)
    mark = lambda k, *values: k < n and found[k][0] == "mark" and found[k][1] in values
    while i < n:
        kind, value, at = found[i]
        i += 1
        if kind != "name":
            out.append((kind, value, at))
            continue
        name = [value]
        if value == "require" and mark(i, "(") and i + 4 < n and found[i + 1][0] == "text" and mark(i + 2, ")") and mark(i + 3, ".", "?.") and found[i + 4][0] == "name":
            name, i = [found[i + 1][1][1:-1]], i + 3
        while True:
            if mark(i, ".", "?.") and i + 1 < n and found[i + 1][0] == "name":
                name.append(found[i + 1][1])
                i += 2
            elif mark(k := i + mark(i, "?."), "[") and k + 2 < n and found[k + 1][0] == "text" and mark(k + 2, "]") and re.fullmatch(r"['\"`][\w$-]+['\"`]", found[k + 1][1]):
                name.append(found[k + 1][1][1:-1])
                i = k + 3
            else:
                break
        if mark(i, "?.") and mark(i + 1, "("):
            i += 1
        out.append((kind, ".".join(name), at))
    return out
