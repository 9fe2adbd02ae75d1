"""A linear scan of JavaScript or TypeScript text: tokens, and the few facts about them that rules ask for.

This is no parser and builds no tree. Tokens are told by the characters at hand
and the token before; a stack of open brackets, each with the operand and the
sum that it has reached, is enough to tell calls, arrays of strings, names bound
to modules, and how deep ``+`` nests. Text whose brackets, strings or comments
don't close counts as unreadable. Functions here see one text at a time; files
are dealt out by ``quillon.operators.scripts``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

CODE = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/|\A\#![^\n]*)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<name>\#?[A-Za-z_$\u0080-\U0010ffff][\w$]*)|(?P<number>0[xXoObB]\w+|\.?\d[\w.]*(?:(?<=[eE])[+-]\d\w*)?)
    |(?P<punct>=>|\.\.\.|\?\.(?!\d)|\?\?=?|\*\*=?|\+\+|--|[=!]==?|[<>]=|&&=?|\|\|=?|[-+*/%&|^]=|.)""",
    re.X | re.S,
)
CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n]){0,4096}\]){1,4096}/[A-Za-z]*")
ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\n\u2028\u2029])|([0-7]{1,3})|(.))", re.S)
PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}

#: Words of the language: before an operand that they change, before one that begins an expression, before brackets of their own, and operands.
UNARY = {"typeof", "void", "delete", "await", "yield"}
STATEMENT = {"return", "case", "throw", "in", "of", "instanceof", "else", "do", "var", "let", "const", "extends", "default", "export", "async", "static", "try", "finally", "break", "continue"}
CONTROL = {"if", "for", "while", "switch", "catch", "with"}
DECLARATION, BODY = {"function", "class"}, {"else", "do", "try", "finally", "catch"}
CLOSES = {")": "(", "]": "[", "}": "{", "}$": "${"}


def unescaped(raw: str) -> str:
    """The value of a literal."""
    if "\\" not in raw:
        return raw

    def one(m: re.Match) -> str:
        if code := m[1] or m[2] or m[3]:
            return chr(min(int(code, 16), 0x10FFFF))
        return "" if m[4] else chr(int(m[5], 8)) if m[5] else PLAIN.get(m[6], m[6])

    value = ESCAPE.sub(one, raw)
    return value.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def tokens(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, value): comment, string, template (its opening), chunk (a piece of a template), regex, name, number, punct, or broken."""
    at, size, holes, before = 0, len(text), [], None
    while at < size:
        if text[at] == "/" and text[at : at + 2] not in ("//", "/*") and (before is None or before[0] == "punct" and before[1] not in (")", "]", "++", "--") or before[0] == "name" and before[1] in UNARY | STATEMENT):
            if m := REGEX.match(text, at):
                yield "regex", at, m.end(), m[0]
                at, before = m.end(), ("regex", "")
                continue
        m = CODE.match(text, at)
        kind, start, at = m.lastgroup, at, m.end()
        if kind == "space":
            continue
        if kind == "comment":
            yield kind, start, at, m[0]
            continue
        value = m[0]
        if kind == "string":
            value = unescaped(value[1:-1])
        elif kind == "punct":
            if value in "\"'\\" or text.startswith("/*", start):
                yield "broken", start, at, value
                if value == "/":
                    return
                continue
            if value == "{":
                holes.append(False)
            ends_hole = value == "}" and bool(holes) and holes.pop()
            if ends_hole:
                value = "}$"
            if value == "`":
                yield "template", start, at, value
            if value == "`" or ends_hole:
                if ends_hole:
                    yield "punct", start, at, value
                m = CHUNK.match(text, at)
                yield "chunk", at, m.end(), unescaped(m[0])
                start, at = m.end(), min(m.end() + 2, size)
                before = ("template", "")
                if text.startswith("${", start):
                    holes.append(True)
                    before = ("punct", "${")
                    yield "punct", start, at, "${"
                elif start < size and text[start] == "`":
                    at = start + 1
                else:
                    yield "broken", start, size, ""
                    at = size
                continue
        yield kind, start, at, value
        before = (kind, value)


class Open:
    """An open bracket (or the text itself) and the expression that it has reached."""

    __slots__ = ("kind", "start", "callee", "left", "sign", "operand", "begin", "chain", "chain_at", "unary", "product", "several", "spread", "mixed", "size", "text", "items", "strings", "encoded", "pure", "first", "env", "names", "closed", "target", "new_at", "first_values")

    def __init__(self, kind: str, start: int, callee: tuple | None = None):
        self.kind, self.start, self.callee = kind, start, callee
        self.several, self.items, self.strings, self.encoded, self.pure, self.first, self.env = False, 0, 0, 0, True, "none", False
        self.names, self.closed, self.target, self.new_at, self.first_values = [], [], [], None, []
        self.over()
        self.next()

    def over(self) -> None:
        """The expression ends; another may begin."""
        self.left, self.sign, self.operand, self.begin, self.chain, self.chain_at, self.unary, self.product = None, None, None, 0, None, 0, False, False

    def next(self) -> None:
        """An item of a list begins: spread, more than one operand, number of tokens, and the text if it is a string."""
        self.spread, self.mixed, self.size, self.text = False, False, 0, None

    def put(self, at: int, depth: int = 1, chain: str | None = None) -> None:
        if self.left is None and not self.product:
            self.begin = at if self.new_at is None else self.new_at
        self.chain = chain
        self.operand = 1 if self.unary or self.product else depth
        self.chain_at = at
        self.unary = self.product = False

    def sum(self) -> int:
        """Depth of what is summed up so far; 1 for anything but a sum."""
        if self.operand is not None:
            self.left = self.operand if self.sign is None else 1 + max(self.left, self.operand) if self.sign == "+" else 1
            self.sign, self.operand, self.chain = None, None, None
        return self.left or 1


def encoded(value: str) -> bool:
    """Whether a member of a table of strings looks encoded."""
    return not re.search("[A-Za-z]", value) or not re.fullmatch("[ -~]*", value) or bool(re.fullmatch("[A-Za-z0-9+/=]{16,}|[0-9a-fA-F]{8,}", value))


class Facts:
    """Facts of one text: (kind, position, name, n, m).

    literal (value), comment (n: its end), call (callee; n: 1 if its first argument
    isn't a literal, 2 if it reads the environment, 3 for both), member (dotted
    name), import (module; n: 1 if required, 2 if imported as it runs), bind (name; m is its
    module), array (first members; n strings, m encoded ones), sum (n: depth).
    """

    def __init__(self, text: str, members: frozenset[str]):
        self.rows: list[tuple] = []
        self.members, self.readable, self.chars = members, True, 0
        self.deepest, self.deepest_at = 0, 0
        self.stack = [Open("", 0)]
        self.call: tuple | None = None  # closed by the last token
        self.word: str | None = None  # the last token, if it is a word of the language
        self.last = ""  # the last token, if it is punctuation
        self.importing: list | None = None
        for kind, start, end, value in tokens(text):
            if kind == "comment":
                self.rows.append(("comment", start, None, end, None))
                continue
            if self.call:
                if value not in ("{", "=>") or kind != "punct":
                    self._called(*self.call)
                self.call = None
            getattr(self, f"_{kind}")(start, value)
            if kind != "name":
                self.word = None
            self.last = value if kind == "punct" else ""
        if self.call:
            self._called(*self.call)
        self._summed(self.stack[-1])
        self.readable &= len(self.stack) == 1
        if self.deepest > 1:
            self.rows.append(("sum", self.deepest_at, None, self.deepest, None))

    def _broken(self, start: int, value: str) -> None:
        self.readable = False

    def _operand(self, start: int, chain: str | None = None, depth: int = 1) -> None:
        top = self.stack[-1]
        self._apart(top)
        if chain not in ("require", "import"):
            top.target = []
        top.put(start, depth, chain)
        top.size += 1

    def _apart(self, top: Open) -> None:
        """Two operands without an operator between them belong to two expressions."""
        if top.operand is not None:
            self._summed(top)
            top.several = True
            top.over()

    def _literal(self, start: int, value: str) -> None:
        self.rows.append(("literal", start, value, None, None))
        self.chars += len(value)

    def _string(self, start: int, value: str) -> None:
        self._literal(start, value)
        self._operand(start)
        self.stack[-1].text = value
        if self.importing is not None:
            self.rows.append(("import", self.importing[0], value, 0, None))
            self.rows += [("bind", self.importing[0], name, None, value) for name in self.importing[1:]]
            self.importing = None

    def _chunk(self, start: int, value: str) -> None:
        self._literal(start, value)

    def _number(self, start: int, value: str) -> None:
        self._operand(start)

    _regex = _number

    def _template(self, start: int, value: str) -> None:
        top = self.stack[-1]
        if top.operand is None:
            self._operand(start)
        else:  # a tag stands before it
            top.size, top.chain = top.size + 1, None

    def _name(self, start: int, value: str) -> None:
        top, before = self.stack[-1], self.word
        self.word = None
        if self.last in (".", "?."):
            top.size += 1
            if top.operand is not None:
                top.operand = 1
            if top.chain is not None:
                top.chain = f"{top.chain}.{value}" if self.last == "." else None
                self._member(top)
            return
        if self.importing is not None and len(self.stack) == 1 and value not in ("from", "as", "type"):
            self.importing.append(value)
        if value in UNARY or value == "new":
            top.size += 1
            self._apart(top)
            if value == "new":
                top.new_at = start
            else:
                top.unary = top.mixed = True
            self.word = value
        elif value in STATEMENT or value in CONTROL:
            self._summed(top)
            top.several = top.mixed = True
            top.over()
            self.word = value
        elif value in DECLARATION:
            self._operand(start)
            self.word = value
        elif before in DECLARATION:
            top.size += 1
        else:
            if value == "import" and not top.kind:
                self.importing = [start]
            self._operand(start, None if value in ("null", "true", "false") else value)

    def _member(self, top: Open) -> None:
        if top.chain is not None and top.chain.rpartition(".")[2] in self.members:
            self.rows.append(("member", top.chain_at, top.chain, None, None))

    def _summed(self, top: Open) -> None:
        depth = top.sum()
        if depth > self.deepest:
            self.deepest, self.deepest_at = depth, top.begin

    def _punct(self, start: int, value: str) -> None:
        top = self.stack[-1]
        if value in ("(", "[", "{", "${"):
            self._opened(top, start, value)
        elif value in CLOSES:
            self._closed(start, value)
        elif value == ",":
            self._item(top, False)
            top.several = True
        elif value in (".", "?."):
            top.size += 1
        elif value == "...":
            top.spread = True
        elif value in ("+", "-", "!", "~") and top.operand is None:
            top.unary = top.mixed = True
            top.size += 1
        elif value in ("++", "--"):
            top.size += 1
            top.mixed = True
            top.unary |= top.operand is None
        elif value in ("+", "-"):
            self._summed(top)
            top.sign, top.mixed = value, True
        elif value in ("*", "/", "%", "**"):
            top.product, top.operand, top.chain, top.mixed = True, None, None, True
        else:
            if value == "=":
                top.target = top.closed if self.last == "}" else [top.chain] if top.chain and "." not in top.chain else []
            elif value == ";":
                top.target, self.importing = [], None
            self._summed(top)
            top.several = top.mixed = True
            top.new_at = None
            top.over()

    def _opened(self, top: Open, start: int, value: str) -> None:
        kind, callee = value, None
        if value == "(" and self.word in CONTROL:
            kind = "control"
        elif value in "([" and top.operand is not None:
            kind = "call" if value == "(" else "index"
            callee = (top.chain, top.chain_at if top.new_at is None else top.new_at)
            if value == "(" and top.chain == "import":
                self.importing = None
        elif value == "{" and self.importing is None and (self.word in BODY or self.word is None and self.last in (")", ";", "{", "}", "")):
            kind = "block"
        self.stack.append(Open(kind, start, callee))

    def _item(self, top: Open, last: bool) -> None:
        """An item of a list ends."""
        single = top.text if top.text is not None and top.size == 1 and not top.mixed and not top.spread else None
        if top.size or top.mixed or top.spread or not last:
            top.pure &= single is not None
            if single is not None:
                top.strings += 1
                top.encoded += encoded(single)
                if top.strings <= 4:
                    top.first_values.append(single)
            if top.items == 0:
                top.first = "string" if single is not None else "other"
            whole = top.chain == "process.env" and not top.mixed
            top.env |= whole and (top.kind == "call" or top.spread) or top.kind == "call" and top.chain == "{env}" and not top.mixed
            if top.chain and "." not in top.chain:
                top.names.append(top.chain)
            top.items += 1
        self._summed(top)
        top.over()
        top.next()

    def _closed(self, start: int, value: str) -> None:
        top = self.stack[-1]
        opened = {"call": "(", "control": "(", "index": "[", "block": "{"}.get(top.kind, top.kind)
        if opened != CLOSES[value]:
            self.readable = False
            return
        depth = top.sum() if top.kind == "(" else 1
        single = top.text if top.text is not None and top.size == 1 and not top.mixed and not top.items else None
        self._item(top, True)
        self.stack.pop()
        outer = self.stack[-1]
        if top.kind == "(":
            self._operand(top.start, None, 1 if top.several or top.items != 1 else depth)
        elif top.kind == "control" or top.kind == "block":
            outer.over()
        elif top.kind == "call":
            self.call = (*top.callee, top.first, top.first_values, top.env, outer.target)
            outer.operand, outer.chain, outer.new_at, outer.mixed = 1, None, None, True
        elif top.kind == "index":
            chain = top.callee[0]
            outer.operand, outer.chain = 1, chain and (f"{chain}.{single}" if single is not None else f"{chain}[]")
            outer.size += 1
            self._member(outer)
        elif top.kind == "[":
            if top.pure and top.strings:
                self.rows.append(("array", top.start, ", ".join(top.first_values), top.strings, top.encoded))
            self._operand(top.start)
        elif top.kind == "{":
            if self.importing is not None:
                self.importing += top.names
            self._operand(top.start, "{env}" if top.env else None)
            outer.closed = top.names

    def _called(self, callee: str | None, at: int, first: str, values: list[str], env: bool, target: list[str]) -> None:
        if callee is None:
            return
        if callee in ("require", "import") and first == "string":
            self.rows.append(("import", at, values[0], 1 + (callee == "import"), None))
            self.rows += [("bind", at, name, None, values[0]) for name in target]
        self.rows.append(("call", at, callee, (first == "other") + 2 * env, None))


def facts(text: str, members: frozenset[str]) -> tuple[list[tuple], bool, int]:
    """Facts, whether the text could be read, and characters in literals."""
    found = Facts(text, members)
    return found.rows, found.readable, found.chars


class Lines:
    """Numbers, from 1, of the lines that positions lie in."""

    def __init__(self, text: str):
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def __call__(self, at: int) -> int:
        return bisect_right(self.ends, at - 1) + 1
