"""A lexer of assignments in source code and configuration: which literals are given to which names.

One pass over the tokens of a text (strings with escapes and of several lines, names, operators, brackets, line starts)
finds pairs of a target and a value:

- ``name = v``, ``name := v``, ``name: v``, ``"name" => v``, ``obj["name"] = v``, ``name: type = v``, keyword arguments;
- ``set("name", v)``, ``setName(v)``, ``<name>v</name>``, ``name="name" value="v"``,
  ``#define name v``;
- values of several terms joined by ``+``, ``.`` or adjacency, in brackets or over lines, with ``or`` / ``||`` / ``??``
  defaults, in calls that only convert (``str("...")``), and block scalars (``name: |`` and the indented lines below).

A term is a literal or a name. Names refer to assignments of the same or an enclosing scope (braces, and the indented
bodies of ``def`` and ``class``), the latest before the use or else the first after it. References are followed, never
copied: what a value is made of is summed up once for each assignment, and a value longer than its text is no literal, so
the work is linear in the text. A string that itself holds assignments is lexed too, to DEPTH levels.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

DEPTH = 3
_STRING = r"""(?P<q>["'`])(?P<body>(?:[^\\\n"'`]|\\.|(?!(?P=q))["'`])*+)(?P=q)"""
_TRIPLE = r"""(?P<tq>\"\"\"|''')(?P<tbody>(?:[^\\"']|\\.|(?!(?P=tq))["'])*+)(?P=tq)"""
_PREFIX = r"""(?:\b[bBrRuUfF]{1,2}(?=["']))?"""
_TOKEN = re.compile(
    rf"""(?P<line>\n[ \t]*+)|(?P<space>[ \t\r]++)|{_PREFIX}(?:{_TRIPLE}|(?:(?<!\w)|(?<=[bBrRuUfF])){_STRING})"""
    r"""|(?P<element><(?P<tag>[A-Za-z_][\w.-]*+)>[ \t]*+(?P<inside>[^<>\s]++)[ \t]*+</)"""
    r"""|(?P<name>[A-Za-z_$][\w$]*+(?:[.-][\w$]++)*+)|(?P<number>[0-9][\w.]*+)|(?P<op>:=|=>|===?|!==?|<=|>=|\|\||\?\?|::|[^\s\w])|(?P<other>.)""",
    re.ASCII | re.DOTALL,
)
_TERM = re.compile(rf"""{_PREFIX}(?:{_TRIPLE}|{_STRING})|(?P<bare>[^\s"'`,;(){{}}\[\]<>]++)""", re.ASCII | re.DOTALL)
_NAME = re.compile(r"[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)*+", re.ASCII)
_TYPE = re.compile(r"[ \t]*+[A-Za-z_][\w.\[\], |?<>]{0,80}?[ \t]*=(?![=>])", re.ASCII)
_BLOCK = re.compile(r"[ \t]*+[|>][+-]?[0-9]?[ \t]*+\n(?P<lines>(?:[ \t]++[^\n]*+\n?|[ \t]*+\n)++)")
_JOIN = re.compile(r"[ \t]*+(?:\\?\n[ \t]*+)?(?:\+|\.{1,2}(?=[ \t]*+[\"'$]))[ \t]*+(?:\\?\n[ \t]*+)?(?=[\w\"'`$(])|[ \t]*+\\\n[ \t]*+(?=[\"'])|[ \t]++(?=[\"'])")
_JOIN_IN_BRACKETS = re.compile(r"\s*+\+\s*+(?=[\w\"'`$(])|\s++(?=[\"'])")
_OPEN = re.compile(r"[ \t]*+(?:(?:new[ \t]++)?(?P<call>[A-Za-z_][\w.]*+)?\((?:[ \t\r\n]*+))?", re.ASCII)
_DEFINED = re.compile(r"[ \t]++([A-Za-z_]\w*+)[ \t]++", re.ASCII)
_GAP = re.compile(r"[ \t]*+")
#: Calls that give back their argument, and names of attributes whose neighbour holds the value.
CONVERTERS = ("str", "String", "bytes", "bytearray", "Secret", "SecretStr", "SecretString", "Buffer.from", "b64decode", "base64.b64decode", "encode", "trim", "quote")
NAMING_ATTRIBUTES = ("name", "key", "id")
_SETTERS = ("set", "with", "put", "add", "use")


@dataclass
class Sum:
    """What a value is made of: characters, whether any is white space, a placeholder, and whether it was a literal."""

    length: int = 0
    counts: Counter = field(default_factory=Counter)
    spaced: bool = False
    placeholder: bool = False
    quoted: bool = False


@dataclass
class Assignment:
    target: str
    scope: int
    at: int
    #: (start, end, quoted) of literals, or (name, start, end) of names that may be references.
    terms: list[tuple]


class _Lexer:
    def __init__(self, text: str):
        self.text, self.made = text, []
        self.parent: list[int] = [-1]
        self.by_name: dict[tuple[int, str], list[int]] = {}

    # -- reading -------------------------------------------------------------------------------------------------------

    def read(self, start: int, end: int, depth: int = DEPTH) -> None:
        text, at = self.text, start
        scope, scopes = (0 if depth == DEPTH else self._open(0)), []  # scopes: (the one outside, indent or None for braces)
        pending: str | None = None
        current: str | None = None  # the target of the assignment that this line holds
        attribute: str | None = None
        calls: list[list] = []  # [callee, first string or None, arguments begun]
        body_indent: int | None = None  # after def or class: the indent of its line
        indent, at_line_start = 0, True
        while at < end:
            m = _TOKEN.match(text, at, end)
            kind, at = m.lastgroup, m.end()
            if kind == "line":
                following = text[at : at + 1]
                if following not in ("\n", "\r", ""):
                    indent = m.end() - m.start() - 1
                    while scopes and scopes[-1][1] is not None and indent <= scopes[-1][1]:
                        scope = scopes.pop()[0]
                    if body_indent is not None and indent > body_indent:
                        scopes.append((scope, body_indent))
                        scope = self._open(scope)
                    body_indent, at_line_start = None, True
                pending = current = attribute = None
                continue
            if kind == "space" or kind == "number":
                continue
            if m["element"] is not None:
                self._add(m["tag"], scope, m.start("inside"), [(*m.span("inside"), True)])
                continue
            if m["q"] is not None or m["tq"] is not None:
                a, b = m.span("body") if m["q"] is not None else m.span("tbody")
                pending = text[a:b] if b - a <= 100 else None
                if calls:
                    callee, first, count = calls[-1]
                    if count == 0:
                        calls[-1][1] = pending
                        if callee and callee.rsplit(".", 1)[-1].lower().startswith(_SETTERS) and text[at : at + 1] == ")":
                            self._add(callee, scope, a, [(a, b, True)])
                    elif count == 1 and first:
                        self._add(first, scope, a, [(a, b, True)])
                if depth and ("=" in text[a:b] or ":" in text[a:b]):
                    self.read(a, b, depth - 1)
                at_line_start = False
                continue
            if kind == "name":
                word = m["name"]
                if word in ("def", "class") and at_line_start:
                    body_indent = indent
                if word == "define" and text[m.start() - 1 : m.start()] == "#" and (named := _DEFINED.match(text, at, end)):
                    current = named[1]
                    at = self._assign(current, scope, named.end(), end, indent, depth)
                if word == "or" and current:
                    at = self._assign(current, scope, at, end, indent, depth)
                pending, at_line_start = word, False
                continue
            op = m["op"] or ""
            at_line_start = False
            if op in ("=", ":=", "=>", ":") and pending and not (op == ":" and text[at : at + 1] in (":", "/")):
                if op == ":" and (typed := _TYPE.match(text, at, end)):
                    at = typed.end()
                target = attribute if attribute and pending.lower() == "value" else pending
                begun = len(self.made)
                at, current, pending = self._assign(target, scope, at, end, indent, depth), target, None
                if target.lower() in NAMING_ATTRIBUTES and len(self.made) > begun and len(self.made[-1].terms) == 1 and len(t := self.made[-1].terms[0]) == 3 and t[2] is True:
                    attribute = text[t[0] : t[1]]
            elif op in ("||", "??") and current:
                at = self._assign(current, scope, at, end, indent, depth)
            elif op == "(":
                calls.append([pending, None, 0])
                pending = None
            elif op == ")":
                if calls:
                    calls.pop()
                pending = None
            elif op == ",":
                if calls:
                    calls[-1][2] += 1
                pending = current = None
            elif op == "{":
                scopes.append((scope, None))
                scope, pending = self._open(scope), None
            elif op == "}":
                while scopes and scopes[-1][1] is not None:
                    scope = scopes.pop()[0]
                if scopes:
                    scope = scopes.pop()[0]
                pending = None
            elif op not in ("]", "?", "!", "[", "-", '"', "'"):
                pending = None

    def _open(self, outer: int) -> int:
        self.parent.append(outer)
        return len(self.parent) - 1

    def _add(self, target: str, scope: int, at: int, terms: list[tuple]) -> None:
        if terms:
            self.by_name.setdefault((scope, target), []).append(len(self.made))
            self.made.append(Assignment(target, scope, at, terms))

    def _assign(self, target: str, scope: int, at: int, end: int, indent: int, depth: int) -> int:
        """Read the value at ``at`` and give back where it ends."""
        text, terms, begun = self.text, [], at
        if block := _BLOCK.match(text, at, end):
            at, stop = block.start("lines"), block.end()
            while at < stop:
                line_end = text.find("\n", at, stop)
                line_end = stop if line_end < 0 else line_end
                line = text[at:line_end]
                if line.strip():
                    if len(line) - len(line.lstrip(" \t")) <= indent:
                        break
                    a = at + len(line) - len(line.lstrip())
                    terms.append((a, a + len(line.strip()), True))
                at = line_end + 1
            self._add(target, scope, begun, terms)
            return min(at, end)
        inside = False
        while True:
            opened = _OPEN.match(text, at, end)
            if opened.end() > at and text[opened.end() - 1 : opened.end()] in ("(", " ", "\t", "\n", "\r") and "(" in opened[0]:
                if opened["call"] and opened["call"] not in CONVERTERS:
                    break
                inside, at = True, opened.end()
            else:
                at = _GAP.match(text, at, end).end()
            m = _TERM.match(text, at, end)
            if not m:
                break
            if m["bare"] is not None:
                whole = _NAME.fullmatch(m["bare"])
                if whole and text[m.end() : m.end() + 1] in ("(", "["):
                    break
                terms.append((m["bare"], *m.span("bare")) if whole else (*m.span("bare"), False))
            elif m["q"] is not None:
                terms.append((*m.span("body"), True))
                if depth and ("=" in m["body"] or ":" in m["body"]):
                    self.read(*m.span("body"), depth - 1)
            else:
                a, stop = m.span("tbody")
                for line in re.finditer(r"[^\n]+", text[a:stop]):
                    if line[0].strip():
                        lead = len(line[0]) - len(line[0].lstrip())
                        terms.append((a + line.start() + lead, a + line.start() + lead + len(line[0].strip()), True))
            at = m.end()
            joined = (_JOIN_IN_BRACKETS if inside else _JOIN).match(text, at, end)
            if not joined:
                break
            at = joined.end()
        self._add(target, scope, begun, terms)
        return at

    # -- following names -----------------------------------------------------------------------------------------------

    def _meant(self, name: str, scope: int, at: int) -> int | None:
        """The assignment that a name stands for."""
        if name.rsplit(".", 1)[-1] not in self.last_parts:
            return None
        for spelled in (name, name.split(".", 1)[1]) if name.startswith(("self.", "this.")) else (name,):
            here = scope
            while here >= 0:
                if found := self.by_name.get((here, spelled)):
                    k = bisect.bisect_left(found, at, key=lambda i: self.made[i].at)
                    return found[k - 1] if k else found[0]
                here = self.parent[here]
        return None

    def resolve(self, wanted: Callable[[str], bool], placeholder: Callable[[str], bool]) -> list[tuple[Assignment, Sum, int]]:
        """The assignments to wanted targets, what their values are made of, and their place in ``made``."""
        text, sums, most = self.text, {}, len(self.text)
        self.last_parts = {x.target.rsplit(".", 1)[-1] for x in self.made}
        self.refs: list[list[int | None]] = [[self._meant(t[0], x.scope, x.at) if isinstance(t[0], str) else None for t in x.terms] for x in self.made]
        todo = [i for i, x in enumerate(self.made) if wanted(x.target)]
        asked, begun = list(todo), set()
        todo.reverse()
        while todo:
            i = todo[-1]
            if i in sums:
                todo.pop()
                continue
            if i not in begun:
                begun.add(i)
                more = [r for r in self.refs[i] if r is not None and r not in sums and r not in begun]
                if more:
                    todo += more
                    continue
            total = Sum()
            for term, ref in zip(self.made[i].terms, self.refs[i], strict=True):
                if ref is not None:
                    part = sums.get(ref)
                    if part is None:  # a name that leads back to itself
                        continue
                else:
                    a, b = term[:2] if not isinstance(term[0], str) else term[1:]
                    piece = text[a:b]
                    part = Sum(len(piece), Counter(piece), any(c.isspace() for c in piece), placeholder(piece), term[2] is True)
                total.length += part.length
                total.quoted |= part.quoted
                total.spaced |= part.spaced
                total.placeholder |= part.placeholder
                if total.length <= most:
                    total.counts.update(part.counts)
                else:
                    total.length, total.placeholder = most + 1, True
            sums[i] = total
            todo.pop()
        return [(self.made[i], sums[i], i) for i in asked]

    def literals(self, chosen: list[int]) -> set[tuple[int, int]]:
        """Spans of all literals that reach one of ``chosen``."""
        spans, seen, todo = set(), set(), list(chosen)
        while todo:
            i = todo.pop()
            if i in seen:
                continue
            seen.add(i)
            for term, ref in zip(self.made[i].terms, self.refs[i], strict=True):
                if ref is not None:
                    todo.append(ref)
                else:
                    spans.add(tuple(term[:2] if not isinstance(term[0], str) else term[1:]))
        return spans


def assignments(text: str) -> _Lexer:
    """The assignments of a text."""
    lexer = _Lexer(text)
    lexer.read(0, len(text))
    return lexer
