"""Markdown notes as HTML and as text with their source references filled in; plain functions for Arrow UDFs.

A note's Markdown has code fences, headings of three levels, dash lists, quotes, paragraphs, bold and inline code. One
pattern finds the next block of each kind, so a text is a run of matches rather than a walk over lines.
"""

from __future__ import annotations

import re
from html import escape
from typing import NamedTuple

# What an export says of lines, of a reference that isn't found, and of a note's parts.
LINES = "행"
NOT_FOUND = "현재 소스에서 찾지 못함"
FUNCTION, SOURCE, TAGS = "함수", "소스", "태그"

REFERENCE = re.compile(r"\[line:(\d+)(?:-(\d+))?\]")
_INLINE = re.compile(r"\*\*(?P<bold>[^*]+)\*\*|`(?P<code>[^`]+)`")
#: A line that begins another block than a paragraph.
_OTHER = r"\#{1,3}\s|-\ |>\ |```"
_BLOCK = re.compile(
    rf"""
      ^```(?P<language>[^\n]*)(?:\n(?P<code>(?:(?!```)[^\n]*(?:\n|\Z))*?))?(?:^```[^\n]*|\Z|(?=^```))
    | ^(?P<marks>\#{{1,3}})[^\S\n]+(?P<heading>[^\n]+)$
    | (?P<items>(?:^-\ [^\n]*(?:\n|\Z))+)
    | ^>\ (?P<quote>[^\n]*)$
    | (?P<lines>^(?=[^\n]*\S)[^\n]*(?:\n(?!{_OTHER})(?=[^\n]*\S)[^\n]*)*)
    """,
    re.M | re.X,
)


class Expanded(NamedTuple):
    html: str
    text: str
    resolved: int
    unresolved: int


def escaped(text: str) -> str:
    return escape(text).replace("&#x27;", "&#39;")


def inline(text: str) -> str:
    """A line's text with bold and code."""
    out, at = [], 0
    for m in _INLINE.finditer(text):
        tag = "strong" if m["bold"] else "code"
        out += [escaped(text[at : m.start()]), f"<{tag}>{escaped(m['bold'] or m['code'])}</{tag}>"]
        at = m.end()
    return "".join([*out, escaped(text[at:])])


def _block(m: re.Match) -> str:
    if m["language"] is not None:
        kind = m["language"].strip()
        kind = f' class="language-{escaped(kind)}"' if kind else ""
        return f"<pre><code{kind}>{escaped((m['code'] or '').removesuffix(chr(10)))}</code></pre>"
    if m["marks"]:
        return f"<h{len(m['marks'])}>{inline(m['heading'])}</h{len(m['marks'])}>"
    if m["items"]:
        return "<ul>" + "".join(f"<li>{inline(x[2:])}</li>" for x in m["items"].removesuffix("\n").split("\n")) + "</ul>"
    if m["quote"] is not None:
        return f"<blockquote>{inline(m['quote'])}</blockquote>"
    return "<p>" + "<br>".join(map(inline, m["lines"].split("\n"))) + "</p>"


def to_html(markdown: str) -> str:
    """HTML of a text. A fence without end takes the rest; an empty heading is a paragraph."""
    return "".join(map(_block, _BLOCK.finditer(markdown)))


def line_range(m: re.Match) -> tuple[int, int] | None:
    """First and last line of a reference, in order; None if one is under 1."""
    a, b = int(m[1]), int(m[2] or m[1])
    return (min(a, b), max(a, b)) if min(a, b) >= 1 else None


def reference_at(text: str, offset: int) -> tuple[int, int] | None:
    """The lines of the first reference that touches a place of the text, ends included; None if it isn't valid."""
    hit = next((m for m in REFERENCE.finditer(text) if m.start() <= offset <= m.end()), None)
    return line_range(hit) if hit else None


def expand(markdown: str, path: str | None, source: str | None, language: str | None) -> Expanded:
    """The text with its references as source code. Without a source, references stay as they are and count as unresolved.

    A reference that begins after the last line stays with a notice; one that ends after it is cut."""
    if source is None:
        return Expanded(to_html(markdown), markdown, 0, len(REFERENCE.findall(markdown)))
    lines = re.split(r"\r?\n", source)
    html, text, counts, at = [], [], [0, 0], 0

    def plain(part: str) -> None:
        if part:
            html.append(to_html(part))
            text.append(part)

    for m in REFERENCE.finditer(markdown):
        plain(markdown[at : m.start()])
        at, found = m.end(), line_range(m)
        if found is None:
            plain(m[0])
        elif found[0] > len(lines):
            counts[1] += 1
            html.append(f"<p><strong>{escaped(m[0])}</strong> — {NOT_FOUND}</p>")
            text.append(f"{m[0]} — {NOT_FOUND}")
        else:
            counts[0] += 1
            first, last = found[0], min(found[1], len(lines))
            label = f"{path} · {first if first == last else f'{first}–{last}'}{LINES}"
            code = "\n".join(lines[first - 1 : last])
            html.append(f'<p><strong>{escaped(label)}</strong></p><pre><code class="language-{language}">{escaped(code)}</code></pre>')
            text.append(f"**{label}**\n\n```{language}\n{code}\n```")
    plain(markdown[at:])
    return Expanded("".join(html), "\n\n".join(text), *counts)
