"""The main part of an HTML page as Markdown: balanced elements from one stream of tags, in time linear in the page.

No built-in expression keeps a depth while it walks a string, so this is a Pandas UDF; it sees a
batch of pages at a time, and each page by itself.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed names: elements that never hold an article, and words in class or id that mark such containers.
BOILERPLATE_TAGS = "nav header footer aside form script style noscript svg template iframe select dialog".split()
CONTAINER_TAGS = "div section ul ol span table".split()
CONTAINER_WORDS = (
    "nav navbar navigation menu megamenu header footer sidebar side-bar breadcrumb cookie consent gdpr popup modal banner widget social share subscribe newsletter "
    "pagination pager comment related-posts lang-switch language-switcher topbar offcanvas drawer skip-link screen-reader"
).split()
#: Least text of a container, least words and most link density of an article, longest line that may be a label.
CONTAINER_TEXT, ARTICLE_WORDS, ARTICLE_LINKS, LABEL = 400, 120, 0.45, 60

_WHITE = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_FLAGS = re.I | re.A
_TRIMMED = "".join(chr(c) for c in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
_CONTAINER = re.compile(rf"""<({"|".join(CONTAINER_TAGS)})\b[^>]*?(?:class|id)[{_WHITE}]*=[{_WHITE}]*["']([^"']*)["'][^>]*>""", _FLAGS)
_MARKED = re.compile(rf"(?:^|[{_WHITE}_-])(?:{'|'.join(CONTAINER_WORDS)})(?:[{_WHITE}_-]|$)", _FLAGS)
_ROLE_MAIN = re.compile(rf"""<(div|section)\b[^>]*role[{_WHITE}]*=[{_WHITE}]*["']main["'][^>]*>""", _FLAGS)
_SPACES = re.compile(f"[{_WHITE}]+")
_NAMED = {"nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"', "mdash": "-", "ndash": "-"}


def block_ends(html: str, tag: str) -> dict[int, int | None]:
    """Where each element of one name that opens at a place ends; None if it is never closed."""
    ends: dict[int, int | None] = {}
    open_: list[int] = []
    for m in re.finditer(rf"<{tag}\b|</{tag}[{_WHITE}]*>", html, _FLAGS):
        if m[0][1] != "/":
            ends[m.start()] = None
            open_.append(m.start())
        elif open_:
            ends[open_.pop()] = m.end()
    return ends


def without_blocks(html: str, tags: list[str] = BOILERPLATE_TAGS) -> str:
    """html without the elements of these names; of an unclosed one only the opening goes."""
    for tag in tags:
        out, at = [], 0
        for start, end in block_ends(html, tag).items():  # in order of the page
            if start >= at:
                out += [html[at:start], " "]
                at = end if end is not None else start + 1 + len(tag)
        html = "".join([*out, html[at:]])
    return html


def without_containers(html: str) -> str:
    """html without block elements whose class or id tells that they hold no article; the others lose their attributes."""
    ends = {tag: block_ends(html, tag) for tag in CONTAINER_TAGS}
    out, at = [], 0
    for m in iter(lambda: _CONTAINER.search(html, at), None):
        out.append(html[at : m.start()])
        if _MARKED.search(m[2]):
            end = ends[m[1].lower()].get(m.start())
            out.append(" ")
            at = end if end is not None else m.end()
        else:
            out.append(f"<{m[1]}>")
            at = m.end()
    return "".join([*out, html[at:]])


def text_of(html: str) -> str:
    return _SPACES.sub(" ", re.sub("<[^>]+>", " ", html)).strip()


def _inside(html: str, opening: str, closings: dict[str, str]):
    """(start of the tag, start and end of the content, end) of elements that end at the next closing tag of their name."""
    low, at, shut = html.lower(), 0, set()
    for m in re.finditer(opening, html, _FLAGS):
        close = closings[m[1].lower()]
        if m.start() < at or close in shut:
            continue
        end = low.find(close, m.end())
        if end < 0:
            shut.add(close)
            continue
        at = end + len(close)
        yield m.start(), m.end(), end, at


def link_density(html: str) -> float:
    """Share of the text inside links; 1 where there is no text."""
    total = len(text_of(html))
    linked = sum(len(text_of(html[a:b])) for _, a, b, _ in _inside(html, r"<(a)\b[^>]*>", {"a": "</a>"}))
    return min(1.0, linked / total) if total else 1.0


def container(html: str) -> str:
    """The first article, main or role=main element with enough text, or all."""
    for pattern in (r"<(article)\b", r"<(main)\b", _ROLE_MAIN):
        m = re.compile(pattern, _FLAGS).search(html) if isinstance(pattern, str) else pattern.search(html)
        end = block_ends(html, m[1].lower()).get(m.start()) if m else None
        if end is not None and len(text_of(html[m.start() : end])) > CONTAINER_TEXT:
            return html[m.start() : end]
    return html


def decoded(text: str) -> str:
    for name, char in _NAMED.items():
        text = text.replace(f"&{name};", char)
    return re.sub("&#([0-9]+);", lambda m: chr(int(m[1]) & 0xFFFF), text)


def to_markdown(html: str) -> str:
    """Headings, list items, table cells, bold words and paragraph breaks as Markdown, all else as text."""
    s = re.sub(rf"<br[{_WHITE}]*/?>", "\n", html, flags=_FLAGS)
    s = re.sub(r"</(?:p|div|section|li|tr|h[1-6]|blockquote)>", "\n\n", s, flags=_FLAGS)
    s = re.sub(r"<h([1-6])\b[^>]*>", lambda m: "\n\n" + "#" * int(m[1]) + " ", s, flags=_FLAGS)
    s = re.sub(r"<li\b[^>]*>", "\n- ", s, flags=_FLAGS)
    s = re.sub(r"<t[dh]\b[^>]*>", " | ", s, flags=_FLAGS)
    out, at = [], 0
    for start, a, b, end in _inside(s, r"<(strong|b)\b[^>]*>", {"strong": "</strong>", "b": "</b>"}):
        out += [s[at:start], f"**{text_of(s[a:b])}**"]
        at = end
    s = decoded(re.sub("<[^>]+>", " ", "".join([*out, s[at:]])))
    lines = [re.sub("[ \t\u00a0]+", " ", x).strip(_TRIMMED) for x in s.split("\n")]
    kept = [x for i, x in enumerate(lines) if x or (i and lines[i - 1])]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip(_TRIMMED)


def is_label(line: str) -> bool:
    """Whether a line may be a button or menu entry: short, no heading, no sentence."""
    t = line.strip(_TRIMMED)
    if t.startswith("#") or len(t) > LABEL or re.search("[.!?:;·]", line):
        return False
    kinds = "".join("l" if unicodedata.category(c) == "Ll" else "s" if _SPACES.fullmatch(c) else "x" for c in line)
    return not re.search("lsl+sl+", kinds)


def without_repeats(markdown: str) -> str:
    """Labels that stand three times or more are kept once."""
    lines = markdown.split("\n")
    keys = [x.strip(_TRIMMED).lower() for x in lines]
    times: dict[str, int] = {}
    for k in keys:
        times[k] = times.get(k, 0) + 1
    seen, out = set(), []
    for line, k in zip(lines, keys):
        if not k or times[k] < 3 or not is_label(line) or k not in seen:
            out.append(line)
        if k and times[k] >= 3 and is_label(line):
            seen.add(k)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out))


def main_part(html: str) -> tuple[str, str, int, float, bool]:
    """(Markdown, its words as text, how many, link density, whether the page holds no article)."""
    m = re.search(r"<body\b[^>]*>", html, _FLAGS)
    last = html.lower().rfind("</body>") if m else -1
    cleaned = without_blocks(html[m.end() : last] if m and last >= m.end() else html)
    h1 = next(_inside(cleaned, r"<(h1)\b[^>]*>", {"h1": "</h1>"}), None)  # before containers go: it may share one with a banner
    heading = text_of(cleaned[h1[1] : h1[2]]) if h1 else ""
    cleaned = container(without_containers(cleaned))
    density, markdown = link_density(cleaned), without_repeats(to_markdown(cleaned))
    if heading and not re.search(rf"^#[{_WHITE}]+[^{_WHITE}]", markdown, re.M):
        markdown = f"# {decoded(heading)}\n\n{markdown}"
    text = _SPACES.sub(" ", re.sub("[#*|>-]", " ", markdown)).strip()
    words = len(text.split(" ")) if text else 0
    return markdown, text, words, math.floor(density * 100 + 0.5) / 100, words < ARTICLE_WORDS or density > ARTICLE_LINKS


_MAIN = T.StructType([T.StructField("markdown", T.StringType()), T.StructField("text", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("link_density", T.DoubleType()), T.StructField("boilerplate", T.BooleanType())])


@F.pandas_udf(_MAIN)
def main_parts(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([main_part(h or "") for h in html], columns=["markdown", "text", "words", "link_density", "boilerplate"])


@F.pandas_udf(T.StringType())
def unboxed(html: pd.Series) -> pd.Series:
    """Pages without the elements that never hold an article."""
    return html.map(lambda h: without_blocks(h or ""))
