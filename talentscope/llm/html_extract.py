"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass labels each block
from stop-word density, length and link density, together with the scope it
stands in: navigation, header, footer, aside, form, script and the like, or a
class or id that names such a part, is not text; inside an article (or an
element named as content) a block is text, but three or more blocks in a row that
are mostly links, at the start or the end of the article, are a menu; where a
page has an article, what stands outside is not text. An article inside a form
is text. So is one inside a part that only its name keeps out, unless the page
has an article elsewhere (then it is a teaser). An article inside a part named for
comments or replies is a comment: it is text only if the page has no other. An element whose tag
or one of whose names says content is not kept out by its other names. Names like
``has-sidebar`` or ``no-comments`` tell what an element holds or lacks and do not
count; a frame around content and such a part (``content-sidebar-wrap``) takes the
surrounding scope. Everything else is good,
bad, or ambiguous. The second pass gives ambiguous blocks the label of their
nearest decided neighbours: both agree, or, where they differ, the one that the
block's own stop-word density favours; an ambiguous heading follows the block below it.

Character references are decoded, white space inside a block becomes one space,
``<br>`` counts as white space, kept blocks are joined in page order by ``\\n``.

Defined cases: NULL, empty and wordless pages give an empty text; unclosed tags,
comments and scripts end with the page; a page with no decided block keeps its
ambiguous blocks; repeated rows give one result each; other columns are kept or
ignored, whatever their names.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from talentscope.llm.arrow_rows import map_texts

# Stop words, tag classes, names of page parts.
STOP_WORDS = frozenset("""
    the of and to in a is that for it was on are as with be by this at from or an not have
    de la le et les des en un une que est pour dans du par sur pas qui au avec
    der die und den von zu das mit des ein auf ist im dem nicht eine sich er es
    el y los se del las con una su al lo como para""".split())
BLOCK_TAGS = frozenset("""
    address article aside blockquote body center dd details dialog div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
    option p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID_TAGS = frozenset("""
    area base br col embed hr img input link meta param source track wbr""".split())
RAW_TAGS = frozenset("script style title textarea noscript template iframe svg select button "
                     "object canvas math noframes xmp".split())
OUT_TAGS = frozenset("nav footer aside form dialog menu head fieldset".split())
IN_TAGS = frozenset("article main".split())
OUT_NAMES = frozenset("""
    ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner
    nav navbar navigation menu menubar sidebar side aside footer masthead topbar breadcrumb
    breadcrumbs pagination pager toolbar cookie cookies consent gdpr notice notices notification
    alert popup modal overlay newsletter subscribe signup login share sharing social related
    recommended recommendations widget comment comments reply replies respond discussion disqus
    copyright legal disclaimer skip search""".split())
IN_NAMES = frozenset("article content post entry story maincontent articlebody".split())
TALK_NAMES = frozenset("comment comments reply replies respond discussion disqus".split())
FORM_TAGS = frozenset("form fieldset".split())
STATES = frozenset("has no with without".split())            # first part of a name
FRAMES = frozenset("wrap wrapper container layout grid row inner outer".split())    # last part

SHORT = 70
LONG = 200
MANY_STOPS = 0.30
FEW_STOPS = 0.15
MANY_LINKS = 0.33
ALL_LINKS = 0.60

GOOD, BAD, SHORT_BLOCK, NEAR, LINKS = "good", "bad", "short", "near", "links"
MENU = 3                     # link blocks in a row that make a menu

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HEADING = re.compile(r"h[1-6]$")


def _names(attrs: str) -> tuple[bool, bool, bool]:
    """Whether names among an element's class, id and role say out, content, comments."""
    out = content = talk = False
    for m in _NAMED.finditer(attrs) if "=" in attrs else ():
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [x for x in re.split(r"[_\-]+", name) if x]
            if not parts or len(parts) > 1 and parts[0] in STATES:
                continue
            outer, inner = not OUT_NAMES.isdisjoint(parts), not IN_NAMES.isdisjoint(parts)
            if name in IN_NAMES:
                return False, True, False
            if outer and inner and parts[-1] in FRAMES:
                continue
            out, content = out or outer, content or inner
            talk = talk or not TALK_NAMES.isdisjoint(parts)
    return out, content, talk


def _scope(tag: str, attrs: str, inside: str) -> str:
    """Scope below an element: "out", "form" or "named" (out, by a form or a name),
    "talk" (out, by a name for comments), "article" or "in" (by a name), "again" (an
    article below "named"), "comment" (one below "talk"), or the surrounding one."""
    if inside in ("out", "comment"):
        return inside
    out, content, talk = _names(attrs)
    out = out and tag not in ("body", "html")
    if inside == "talk":
        return "comment" if tag in IN_TAGS and not out else "out" if tag in OUT_TAGS else "talk"
    if out and talk:
        return "talk"
    if tag in IN_TAGS:
        return ("article" if inside not in ("named", "again") else
                inside if out else "again")
    if inside in ("form", "named"):
        return "out" if tag in OUT_TAGS - FORM_TAGS else "named" if out else inside
    if tag in FORM_TAGS:
        return "form"
    if tag in OUT_TAGS:
        return "out"
    if out:
        return "named"
    if tag == "header" and inside not in ("in", "article", "again"):
        return "out"
    if content and tag not in ("body", "html"):
        return inside if inside in ("article", "again") else "in"
    return inside


def blocks(page: str) -> list[tuple[str, str, float, bool]]:
    """(text, scope, link density, is a heading) of the non-empty blocks in page order."""
    out: list[tuple[str, str, float, bool]] = []
    parts: list[str] = []
    linked = 0                       # characters of the open block inside links
    stack: list[tuple[str, str]] = []
    open_tags: Counter = Counter()   # of the stack
    headings = 0
    scope, links = "", 0
    lower = None

    def close():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, scope, min(1.0, linked / len(text)), headings > 0))
            parts.clear()
        linked = 0

    def cut(i: int):
        """Closes the element at ``i`` of the stack and all inside it."""
        nonlocal scope, headings
        for t, _ in stack[i:]:
            open_tags[t] -= 1
            headings -= bool(_HEADING.match(t))
        del stack[i:]
        scope = stack[-1][1] if stack else ""

    def add(raw: str):
        nonlocal linked
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.search(page, pos)
        if not m:
            add(page[pos:])
            break
        add(page[pos:m.start()])
        pos = m.end()
        end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if end:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK_TAGS:
                close()
            for i in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                if stack[i][0] == tag:
                    cut(i)
                    break
            continue
        if tag in RAW_TAGS:
            if attrs.rstrip().endswith("/"):
                continue
            if lower is None:
                lower = page.lower()
            stop = lower.find(f"</{tag}", pos) if len(lower) == size else -1
            if stop < 0 and len(lower) != size:
                found = re.compile(f"</{tag}", re.I).search(page, pos)
                stop = found.start() if found else -1
            pos = size if stop < 0 else stop
            parts.append(" ")
            continue
        if tag == "a":
            links += 1
        if tag in BLOCK_TAGS:
            close()
            links = links if tag == "a" else 0
            if tag in ("p", "li", "dd", "dt", "option") or _HEADING.match(tag):
                # an open paragraph, or a sibling item, ends here
                for i in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                    if stack[i][0] == tag:
                        cut(i)
                        break
                    if stack[i][0] in BLOCK_TAGS and stack[i][0] != "p":
                        break
        if tag in VOID_TAGS or attrs.rstrip().endswith("/"):
            continue
        below = _scope(tag, attrs, scope)
        if below != scope and tag not in BLOCK_TAGS:
            close()
        stack.append((tag, below))
        open_tags[tag] += 1
        headings += bool(_HEADING.match(tag))
        scope = below
    close()
    return out


def _first_pass(text: str, scope: str, links: float, article: bool) -> tuple[str, float]:
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if scope in ("out", "form", "named", "talk"):
        return BAD, stops
    if scope == "in":
        return LINKS if links > ALL_LINKS else GOOD, stops
    if article or links > MANY_LINKS:
        return BAD, stops
    if len(text) < SHORT:
        return BAD if links > 0 else SHORT_BLOCK, stops
    if stops >= MANY_STOPS:
        return GOOD if len(text) > LONG else NEAR, stops
    return NEAR if stops >= FEW_STOPS else BAD, stops


def _link_runs(first: list[tuple[str, float]], scopes: list[str]) -> None:
    """Decides the link blocks inside articles: part of them, unless a long row of them
    begins or ends the article."""
    i = 0
    while i < len(first):
        j = i
        while j < len(first) and first[j][0] == LINKS:
            j += 1
        inner = i > 0 and scopes[i - 1] == "in" and j < len(first) and scopes[j] == "in"
        beside = i > 0 and scopes[i - 1] == "in" or j < len(first) and scopes[j] == "in"
        for at in range(i, j):
            first[at] = (GOOD if inner or beside and j - i < MENU else BAD, first[at][1])
        i = max(j, i + 1)


def labels(found: list[tuple[str, str, float, bool]]) -> list[bool]:
    """True for each block that is part of the main text."""
    keep = _labels(found, "out")
    if not any(keep) and any(b[1] == "comment" for b in found):
        keep = _labels(found, "in")
    return keep


def _labels(found: list[tuple[str, str, float, bool]], comment: str) -> list[bool]:
    again = "out" if any(b[1] == "article" for b in found) else "in"
    scopes = [{"article": "in", "again": again, "comment": comment}.get(b[1], b[1]) for b in found]
    article = "in" in scopes
    first = [_first_pass(b[0], s, b[2], article) for b, s in zip(found, scopes)]
    _link_runs(first, scopes)
    decided = [i for i, (k, _) in enumerate(first) if k in (GOOD, BAD)]
    keep, j = [], 0
    for i, (kind, stops) in enumerate(first):
        while j < len(decided) and decided[j] < i:
            j += 1
        if kind in (GOOD, BAD):
            keep.append(kind == GOOD)
            continue
        near = [first[d][0] == GOOD for d in ([decided[j - 1]] if j else [])
                + ([decided[j]] if j < len(decided) else [])]
        if found[i][3] and j < len(decided):
            keep.append(near[-1])
        elif not near or all(near):
            keep.append(True)
        elif not any(near):
            keep.append(kind == NEAR and stops >= MANY_STOPS)
        else:
            keep.append(kind == NEAR or stops >= FEW_STOPS)
    return keep


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    return "\n".join(b[0] for b, k in zip(found, labels(found)) if k)


def extract(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """``keys`` of every page with ``text`` and ``n_chars`` (code points)."""
    def make():
        def fn(texts):
            out = [main_text(t) for t in texts]
            return {"text": pa.array(out, pa.string()),
                    "n_chars": pa.array([len(t) for t in out], pa.int64())}
        return fn
    return map_texts(pages, keys, html, StructType([
        StructField("text", StringType()), StructField("n_chars", LongType())]), make)
