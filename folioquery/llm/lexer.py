"""A lexer of source code and configuration that pairs assigned names with literals.

It knows what most languages share: comments, strings with escapes, triple
quotes and back quotes, names with attributes and subscripts, assignment signs,
brackets; and of configuration: indented blocks, lists and block scalars after a
colon, ``[section]`` lines and elements ``<name>value</name>``. Comments assign
nothing. A text is read once from its start to its end; what prose holds
between such tokens is passed over by the matching engine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

_KEY = r"""\[[ \t]*(?:"[^"\\\n]*+"|'[^'\\\n]*+'|[A-Za-z0-9_.$\-]++)[ \t]*\]"""
_SIGN = r"(?:(?P<sign>:=|=>|(?<![=!<>+*/%&|^~])=(?![=~>])|:(?![:/=])|:(?=//))[ \t]*)"
#: A name, a name with subscripts or subscripts alone, and an assignment sign.
_TARGET = re.compile(rf"""(?P<name>(?P<q1>["']?)[A-Za-z_$][\w$.\-]*+(?P=q1)(?:{_KEY})*+|(?:{_KEY})++)[ \t]*{_SIGN}""", re.ASCII)
_TYPE = r"""["']?[A-Za-z_][\w.]*+(?:\[[^\n=]{0,128}?\]|<[^\n=]{0,128}?>){0,4}\??["']?"""
#: A type after a colon, and the sign that follows.
_ANNOTATION = re.compile(rf"(?P<type>(?:&(?:'[a-z]+[ \t]+)?)?{_TYPE}(?:[ \t]*\|[ \t]*{_TYPE}){{0,8}})[ \t]*=(?![=>])[ \t]*", re.ASCII)
_STRING = re.compile(r"""(?:[rRbBuUfF]{1,2}(?=["']))?(?:"(?!"")(?P<double>(?:[^"\\\n]|\\.)*+)"|'(?!'')(?P<single>(?:[^'\\\n]|\\.)*+)')""")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
_TOKEN = re.compile(
    rf"""(?P<newline>\n(?P<indent>[ \t]*+(?:-[ \t]++)*+))
    |(?P<line>(?:(?<=\s)|(?<![^\n]))(?:\#|//|--[ ])[^\n]*+|(?<![^\n]);[^\n]*+)
    |(?P<long>/\*|<!--|\"{{3}}|'{{3}}|`)
    |(?P<element><(?P<tag>[A-Za-z_][\w.:\-]*+)(?:[ \t][^<>\n]*+)?>[ \t\r\n]*+(?P<inner>[^<>\s]++)[ \t\r\n]*+</(?P=tag)[ \t]*>)
    |(?P<section>(?<![^\n])\[(?P<title>[A-Za-z_][^\]\n"']*+)\][ \t\r]*+(?=\n|\Z))
    |(?P<target>(?<![\w$.\-"'])(?:{_TARGET.pattern}))
    |(?P<string>(?:(?<!\w)'(?!'')(?:[^'\\\n]|\\.)*+'|"(?!"")(?:[^"\\\n]|\\.)*+"))
    |(?P<open>[\[({{])|(?P<close>[\])}}])""",
    re.ASCII | re.VERBOSE,
)
_CLOSERS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''", "`": "`"}
_REST = re.compile(r"[ \t]*+(?P<block>[|>][+\-]?[0-9]?)?[ \t]*+(?:\#[^\n]*+)?(?=\r?\n)")
_ITEM = re.compile(r"[ \t]*+(?:-[ \t]++)?")
_SPACE = re.compile(r"\s*+")
_GAP = re.compile(r"[ \t]*+(?:\\?\r?\n[ \t]*+)?(?:(?:\+|\.\.?|&)(?=[ \t\r\n]*+[rRbBuUfF]{0,2}[\"'])[ \t]*+(?:\\?\r?\n[ \t]*+)?)?")
#: Names that say nothing of their own, so that the one around them counts.
GENERIC = frozenset({"value", "val", "default", "data", "content", "text", "string", "literal", "item", "raw", "plain"})


@dataclass(slots=True)
class Assignment:
    """Names, the literal they are given and where its pieces lie; names in angle brackets tell what it is but stand for nothing."""

    names: list[str]
    value: str
    pieces: list[tuple[int, int]]
    quoted: bool


def _name(raw: str) -> str:
    """A target as one dotted name: subscripts count as attributes."""
    return raw.strip("\"'") if "[" not in raw else ".".join(x.strip(" \t\"'") for x in re.split(r"[\[\]]+", raw) if x.strip(" \t\"'"))


def _pieces(text: str, at: int, wide: bool) -> tuple[list[tuple[int, int]], int]:
    """Places of the strings from ``at`` on that are joined by a sign or by standing side by side, and the end; ``wide`` allows line ends."""
    out = []
    while True:
        start = at
        opener = text[at : at + 3]
        if opener in ('"""', "'''"):
            end = text.find(opener, at + 3)
            if end < 0:
                return out, start
            out.append((at + 3, end))
            at = end + 3
        elif m := _STRING.match(text, at):
            part = m.lastgroup
            out.append((m.start(part), m.end(part)))
            at = m.end()
        else:
            return out, out and end_of or start
        end_of = at
        gap = _GAP.match(text, at)
        joined = gap[0].strip(" \t\\\r\n")
        if "\n" in gap[0] and not (wide or joined or "\\" in gap[0]):
            return out, end_of
        at = gap.end()


class _Reader:
    def __init__(self, text: str):
        self.text = text
        self.section: str | None = None
        #: Names around the place that is read: (indent of a block or None for a bracket, name or None).
        self.around: list[tuple[int | None, str | None]] = []
        self.closed: set[str] = set()
        self.indent = 0

    def inside(self) -> str | None:
        for _, name in reversed(self.around):
            if name:
                return name
        return self.section

    def named(self, names: list[str]) -> list[str]:
        own = names[0].rpartition(".")[2].lower()
        outer = self.inside() if own in GENERIC or own.isdigit() else None
        return [*names, f"<{outer}>"] if outer else names

    def read(self) -> Iterator[Assignment]:
        text, at = self.text, 0
        first = _ITEM.match(text)
        self.indent = first.end()
        while m := _TOKEN.search(text, at):
            kind, at = m.lastgroup, m.end()
            if m["newline"] is not None:
                follows = text[at : at + 1]
                if follows not in ("\n", "\r", "#", ""):
                    self.indent = len(m["indent"])
                    while self.around and self.around[-1][0] is not None and self.around[-1][0] >= self.indent:
                        self.around.pop()
            elif m["long"]:
                at = self.skip(m["long"], at)
            elif m["element"]:
                yield Assignment(self.named([m["tag"].rpartition(":")[2]]), m["inner"], [m.span("inner")], True)
            elif m["section"]:
                self.section = m["title"].strip("[] \t")
                self.around.clear()
            elif m["target"]:
                at = yield from self.assigned(m, at)
            elif m["string"]:
                if self.around and self.around[-1][0] is None and self.around[-1][1]:  # an item of a named list
                    yield Assignment([f"<{self.around[-1][1]}>"], m["string"].lstrip("rRbBuUfF")[1:-1], [(m.end() - len(m["string"].lstrip("rRbBuUfF")) + 1, m.end() - 1)], True)
            elif kind == "open":
                self.around.append((None, None))
            elif kind == "close":
                self.close()

    def close(self) -> None:
        """Leave the innermost bracket, and the blocks in it."""
        for k in range(len(self.around) - 1, -1, -1):
            if self.around[k][0] is None:
                del self.around[k:]
                return

    def skip(self, opener: str, at: int) -> int:
        """The end of a comment or long string; an opener that nothing closes is no opener."""
        if opener in self.closed:
            return at
        end = self.text.find(_CLOSERS[opener], at)
        if end < 0:
            self.closed.add(opener)
            return at
        return end + len(_CLOSERS[opener])

    def assigned(self, m: re.Match, at: int) -> Iterator[Assignment]:
        text, names, first = self.text, [_name(m["name"])], at
        kind = _ANNOTATION.match(text, at) if m["sign"] == ":" else None
        if kind:
            at = kind.end()
        while (n := _TARGET.match(text, at)) and n["sign"] in ("=", ":=") and (text[n.start("sign") - 1] in " \t" or text[n.end("sign") : n.end("sign") + 1] in ('"', "'")):
            names.append(_name(n["name"]))
            at = n.end()
        if kind:
            names.append(f"<{kind['type']}>")
        names = self.named(names)
        opener = text[at : at + 1]
        if opener == "(":  # strings in parentheses may go on over lines
            inner = _SPACE.match(text, at + 1).end()
            pieces, end = _pieces(text, inner, True)
            if pieces:
                self.around.append((None, None))
                yield self.literal(names, pieces)
                return end
            return at
        pieces, end = _pieces(text, at, False)
        if pieces:
            yield self.literal(names, pieces)
            return end
        if opener == "`":
            end = text.find("`", at + 1)
            if end > 0:
                yield self.literal(names, [(at + 1, end)])
                return end + 1
            return at + 1
        if opener in ("[", "{"):
            self.around.append((None, names[0]))
            return at + 1
        if m["sign"] == ":" and at == first and (rest := _REST.match(text, at)):
            return (yield from self.block(names, rest))
        bare = _BARE.match(text, at)
        if bare is None:
            return at
        if text[bare.end() : bare.end() + 1] != "(":  # a call gives no literal
            yield Assignment(names, bare[0], [bare.span()], False)
        return bare.end()

    def literal(self, names: list[str], pieces: list[tuple[int, int]]) -> Assignment:
        return Assignment(names, "".join(self.text[a:b] for a, b in pieces), pieces, True)

    def block(self, names: list[str], rest: re.Match) -> Iterator[Assignment]:
        """What is indented below a name: a block scalar, values or a list of them, or names."""
        text, at, pieces = self.text, rest.end(), []
        while at < len(text):
            start = at + (2 if text[at] == "\r" else 1)
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
            item = _ITEM.match(text, start, end)
            stop = end - 1 if text[end - 1 : end] == "\r" else end
            if item.end() < stop:
                dashed = "-" in item[0]
                if len(item[0]) - (2 if dashed else 0) < self.indent + (0 if dashed else 1):
                    break
                if rest["block"]:
                    pieces.append((item.end(), stop))
                else:
                    found, after = _pieces(text, item.end(), False)
                    bare = None if found else _BARE.match(text, item.end(), stop)
                    after = after if found else bare.end() if bare else item.end()
                    if after < stop and text[after:stop].strip(" \t")[:1] not in ("", "#") or _TARGET.match(text, item.end(), stop):
                        break
                    yield self.literal(names if not dashed else [f"<{names[0]}>"], found) if found else Assignment(
                        names if not dashed else [f"<{names[0]}>"], bare[0], [bare.span()], False
                    )
            at = end
        if pieces:
            yield self.literal(names, pieces)
        elif at == rest.end():
            self.around.append((self.indent, names[0]))
        return at


def assignments(text: str) -> Iterator[Assignment]:
    """The assignments of a text, in order.

    ``a = b = value`` gives the value to both names; the type in ``a: type = value``
    is a name that stands for nothing, as is the name around a list's item or a
    generic name. ``a=b=c`` without spaces or quotes gives a the bare literal b=c.
    """
    return _Reader(text).read()
