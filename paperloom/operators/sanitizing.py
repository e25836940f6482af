"""Safe markup: pages rewritten in one pass over their tags, keeping what a list allows.

What isn't allowed is unwrapped, or left out with all it holds where it is never text. Elements left open are closed,
empty blocks left out, and text that stands in no element is put into paragraphs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that are kept, and their attributes.
KEPT = frozenset("p h2 h3 h4 ul ol li strong b em i blockquote mark table thead tbody tr th td br a figure figcaption img code pre sup sub hr div span".split())
ATTRIBUTES = {
    "a": frozenset("href rel target title class".split()),
    "img": frozenset("src alt width height loading decoding fetchpriority style".split()),
    "th": frozenset("scope colspan rowspan".split()),
    "td": frozenset("colspan rowspan".split()),
    "figure": frozenset(["style"]),
    "figcaption": frozenset(["style"]),
    "div": frozenset(["style", "class"]),
    "span": frozenset(["style", "class"]),
    "blockquote": frozenset(["cite"]),
}
# Elements left out with their content, and headings that are lowered or raised.
DROPPED = frozenset("script style iframe object embed form input button noscript svg math link meta head title select textarea".split())
RENAMED = {"h1": "h2", "h5": "h4", "h6": "h4"}

_VOID = frozenset("br hr img input embed link meta area base col source track wbr param".split())
_BLOCKS = frozenset("p h2 h3 h4 ul ol li blockquote table figure pre div hr".split())
_NEVER_EMPTY = frozenset("p h2 h3 h4 li blockquote".split())
#: An element that begins closes open ones of these, up to the nearest of the bounds.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_WEB = re.compile(r"https?://[^/?#\s]+", re.I)
_STYLE = re.compile(r"[\w\s:;#%,.()\-/'\"]*")
_FENCE = re.compile(r"^```(?:html)?|```$", re.I | re.M)


def _safe(name: str, value: str) -> bool:
    if name in ("href", "src", "cite"):
        return bool(_WEB.match(value.strip()))
    low = value.lower()
    return name != "style" or bool(_STYLE.fullmatch(value)) and "expression" not in low and "url(" not in low


class _Writer(HTMLParser):
    """Open elements are buffers on a stack; a closed one is written into the next below it."""

    def __init__(self, links: bool, images: bool):
        super().__init__(convert_charrefs=True)
        self.links, self.images, self.hidden = links, images, []
        self.stack: list[list] = [["", "", [], True]]  # name, begin, parts, whether it holds something

    def _close(self) -> None:
        name, begin, parts, full = self.stack.pop()
        if name in _NEVER_EMPTY and not full:
            return
        self.stack[-1][2].append(f"{begin}{''.join(parts)}</{name}>")
        self.stack[-1][3] |= full

    def _close_to(self, name: str, bounds=frozenset()) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] == name:
                while len(self.stack) > depth:
                    self._close()
                return
            if self.stack[depth][0] in bounds:
                return

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            if tag not in _VOID:
                self.hidden.append(tag)
            return
        tag = RENAMED.get(tag, tag)
        if self.hidden or tag not in KEPT or (tag == "img" and not self.images) or (tag == "a" and not self.links):
            return
        kept: dict[str, str] = {}
        for k, v in attrs:  # of one repeated the first counts
            if k in ATTRIBUTES.get(tag, ()) and _safe(k, v or ""):
                kept.setdefault(k, v or "")
        if tag == "a":
            if not kept.get("href"):
                return
            self._close_to("a")
            kept |= {"rel": "nofollow noopener", "target": "_blank"}
        if tag in _BLOCKS:
            self._close_to("p", {"td", "th", "li", "div", "blockquote", "figure"})
        names, bounds = _CLOSES.get(tag, ((), ()))
        for n in names:
            self._close_to(n, bounds)
        begin = f"<{tag}" + "".join(f' {k}="{html.escape(v)}"' for k, v in kept.items()) + ">"
        if tag in _VOID:
            self.stack[-1][2].append(begin)
            self.stack[-1][3] |= tag == "img"
        else:
            self.stack.append([tag, begin, [], False])

    def handle_endtag(self, tag):
        if tag in DROPPED:
            if tag in self.hidden:
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        elif not self.hidden:
            self._close_to(RENAMED.get(tag, tag))

    def handle_data(self, data):
        if self.hidden or (len(self.stack) == 1 and not data.strip()):
            return
        text = html.escape(data, quote=False)
        if len(self.stack) == 1:
            self.stack[0][2].append(f"<p>{' '.join(text.split())}</p>")
        else:
            self.stack[-1][2].append(text)
            self.stack[-1][3] |= bool(data.strip())

    def result(self) -> str:
        self.close()
        while len(self.stack) > 1:
            self._close()
        return re.sub(r"(?:<br>\s*){2,}", "<br>", "".join(self.stack[0][2])).strip()


def sanitized(markup: str | None, links: bool = True, images: bool = False) -> str:
    """Safe markup of a text, fences of code blocks left out; no text gives an empty one."""
    if not markup:
        return ""
    w = _Writer(links, images)
    w.feed(_FENCE.sub("", markup.strip()))
    return w.result()


@F.pandas_udf(T.StringType())
def sanitize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Safe markup with links, without images."""
    for s in batches:
        yield s.map(sanitized)
