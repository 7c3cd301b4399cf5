"""HTML as Markdown, and conversion of scripts by a table, as pandas functions."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKIPPED = {"script", "style", "head", "template", "noscript", "svg"}
_BLOCKS = {"p", "div", "article", "section", "main", "header", "footer", "nav", "aside", "figure", "figcaption", "form", "address", "body", "html", "dl", "dt", "dd", "fieldset"}
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "col", "area", "base", "embed", "track", "param"}


class _Markdown(HTMLParser):
    """Collects blocks of Markdown. Unclosed elements end where their parent does."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.skipped = 0
        self.lists: list[list] = []
        self.prefix = ""
        self.links: list[tuple[int, str]] = []
        self.marks: list[tuple[str, int]] = []
        self.pre = 0
        self.rows: list[list[str]] | None = None
        self.cell: int | None = None
        self.quotes = 0

    def flush(self) -> None:
        text = "".join(self.line)
        self.line, self.links, self.marks = [], [], []
        text = text.strip("\n") if self.pre else "\n".join(re.sub(r"[ \t\r\n]+", " ", x).strip() for x in text.split("\x00")).strip()
        if text:
            if self.pre:
                text = f"```\n{text}\n```"
            text = self.prefix + text
            self.blocks.append("\n".join("> " * self.quotes + x for x in text.split("\n")) if self.quotes else text)
        self.prefix = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SKIPPED:
            self.skipped += 1
        if self.skipped:
            return
        named = dict(attrs)
        if tag in _MARKS and not self.pre:
            self.marks.append((tag, len(self.line)))
        elif tag == "a":
            self.links.append((len(self.line), named.get("href") or ""))
        elif tag == "br":
            self.line.append("\n" if self.pre else "\x00")
        elif tag == "img":
            self.line.append(f"![{named.get('alt') or ''}]({named.get('src') or ''})")
        elif tag == "hr":
            self.flush()
            self.blocks.append("---")
        elif self.cell is not None and tag not in ("td", "th", "tr", "table"):
            return
        elif tag in ("td", "th") and self.rows is not None:
            self.end_cell()
            self.cell = len(self.line)
        elif tag == "tr" and self.rows is not None:
            self.end_cell()
            self.rows.append([])
        elif tag == "table":
            self.flush()
            self.rows = []
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.prefix = "#" * int(tag[1]) + " "
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush()
            if self.lists:
                self.lists[-1][1] += 1
            kind, place = self.lists[-1] if self.lists else ("ul", 1)
            self.prefix = "  " * max(0, len(self.lists) - 1) + (f"{place}. " if kind == "ol" else "- ")
        elif tag == "pre":
            self.flush()
            self.pre += 1
        elif tag == "blockquote":
            self.flush()
            self.quotes += 1
        elif tag in _BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED and self.skipped:
            self.skipped -= 1
            return
        if self.skipped or tag in _VOID:
            return
        if tag in _MARKS:
            for k in range(len(self.marks) - 1, -1, -1):
                if self.marks[k][0] == tag:
                    _, at = self.marks.pop(k)
                    inner = "".join(self.line[at:])
                    if inner.strip(" \t\r\n\x00"):
                        kept = inner.strip(" \t\r\n\x00")
                        lead = inner[: inner.index(kept[0])] if kept else ""
                        self.line[at:] = [lead, _MARKS[tag], kept, _MARKS[tag], " " if inner[-1:].isspace() else ""]
                    break
        elif tag == "a" and self.links:
            at, href = self.links.pop()
            inner = re.sub(r"[ \t\r\n\x00]+", " ", "".join(self.line[at:])).strip()
            self.line[at:] = [f"[{inner}]({href})"] if href and inner else [inner]
        elif tag in ("td", "th"):
            self.end_cell()
        elif tag == "table" and self.rows is not None:
            self.end_cell()
            rows = [r for r in self.rows if r]
            self.rows = None
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                self.blocks.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
        elif self.cell is not None:
            return
        elif tag == "pre" and self.pre:
            self.flush()
            self.pre -= 1
        elif tag == "blockquote" and self.quotes:
            self.flush()
            self.quotes -= 1
        elif tag in ("ul", "ol"):
            self.flush()
            if self.lists:
                self.lists.pop()
        elif tag in _BLOCKS or tag == "li" or re.fullmatch("h[1-6]", tag):
            self.flush()

    def end_cell(self) -> None:
        if self.cell is not None:
            text = re.sub(r"[ \t\r\n\x00]+", " ", "".join(self.line[self.cell :])).strip().replace("|", "\\|")
            del self.line[self.cell :]
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(text)
            self.cell = None

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.line.append(data)


def _convert(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    if parser.rows is not None:
        parser.handle_endtag("table")
    parser.flush()
    return re.sub(r"(?m)^((?: {2})*(?:-|\d+\.) .*)\n\n(?=(?: {2})*(?:-|\d+\.) )", r"\1\n", "\n\n".join(parser.blocks))


@F.pandas_udf(T.StringType())
def html_markdown(html: pd.Series) -> pd.Series:
    """Markdown of HTML: headings, paragraphs, lists, quotes, tables, code, links, images and marks; null stays null.

    Scripts, styles, heads and comments don't show. Broken markup is read as far
    as it goes.
    """
    return html.map(_convert)


@F.pandas_udf(T.StringType())
def plain_key(text: pd.Series) -> pd.Series:
    """What texts are compared by: without tags, entities resolved, letters and digits in folded case."""
    from html import unescape

    return text.map(lambda x: None if x is None else "".join(c.casefold() for c in unescape(re.sub(r"<[^>]*>", "", x)) if c.isalnum()))


def convert_script(table: dict[str, str], protected: str = r"`[^`\n]*`|https?://\S+|\{\{.*?\}\}"):
    """A function of a text column that replaces the longest words of a table first, left to right; code, addresses and placeholders stay.

    The table is the caller's, as a dictionary of words or characters; without one
    texts stay as they are. It goes to the workers with the function.
    """
    longest = sorted(table, key=len, reverse=True)
    pattern = re.compile(f"({protected})" + (f"|({'|'.join(map(re.escape, longest))})" if longest else ""), re.DOTALL)

    def convert(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else pattern.sub(lambda m: m[1] if m[1] is not None else table[m[2]], x))

    function = F.pandas_udf(convert, T.StringType())

    def of(column: Column) -> Column:
        return function(column) if longest else column

    return of
