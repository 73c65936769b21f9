"""Text blocks of an HTML page, each with what its place in the markup says about it."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

#: What markup says of a block.
DROPPED, NEUTRAL, CONTENT, ARTICLE = -1, 0, 1, 2

MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>", re.S)
LOOSE_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Names that HTML and common page templates give to these parts.
RAW = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
SPACING = frozenset("br td th wbr".split())
NEVER_TEXT = frozenset("nav footer aside form noscript template iframe object svg math canvas button select textarea dialog menu head title audio video map option".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup paywall "
    "sidebar sidenav aside nav navbar navigation topnav menu menus breadcrumb breadcrumbs pagination pager footer masthead comment comments disqus respond replies related recommended recommendations share sharing social toolbar widget widgets login search skiplink".split()
)
CONTENT_NAMES = frozenset("content main article post entry story maincontent articlebody postcontent entrycontent articlecontent storybody postbody entrybody contentmain".split())
COMMENT_NAMES = frozenset("comment comments replies".split())
NEGATIONS = frozenset("no has with without".split())
#: These start a block, and so end an open p.
ENDS_ITSELF = frozenset("p li dt dd tr option".split())


@lru_cache(maxsize=4096)
def judged(tag: str, attributes: str) -> int:
    """DROPPED, CONTENT or NEUTRAL for an element by its name, role, class and id."""
    if tag in NEVER_TEXT:
        return DROPPED
    if not attributes.strip():
        return CONTENT if tag == "main" else NEUTRAL
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    names = [[p.lower() for p in NAME_PART.findall(n)] for n in f"{found.get('class', '')} {found.get('id', '')}".split()]
    if tag == "article" and any(n and (n[0] in COMMENT_NAMES or n[-1] in COMMENT_NAMES) for n in names):
        return DROPPED
    if tag in ("article", "main", "body", "html"):
        return CONTENT if tag == "main" else NEUTRAL
    if role in DROPPED_ROLES or "hidden" in found:
        return DROPPED
    for n in names:
        if n and not NEGATIONS.intersection(n) and (n[0] in DROPPED_NAMES or n[-1] in DROPPED_NAMES):
            return DROPPED
    if tag not in INLINE and (role == "main" or found.get("itemprop", "").lower() == "articlebody" or any("".join(n) in CONTENT_NAMES for n in names)):
        return CONTENT
    return NEUTRAL


def blocks(html: str) -> list[tuple[str, int]]:
    """(text, zone) of each block that has text, in page order.

    A page header is dropped; a header inside an article or content belongs to it. Unclosed
    elements end where an element around them does, at the latest with the page.
    """
    out: list[tuple[str, int]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = []
    zone = NEUTRAL
    at, size, mark = 0, len(html), MARK
    last_end = html.rfind(">")

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, zone))
            pieces.clear()

    while at < size:
        opened = html.find("<", at)
        if opened < 0:
            opened = size
        if opened > at:
            raw = html[at:opened]
            pieces.append(unescape(raw) if "&" in raw else raw)
        if opened == size:
            break
        if opened > last_end:  # nothing ends a mark any more: what is left is text, up to an open comment
            comment = html.find("<!--", opened)
            pieces.append(unescape(html[opened : comment if comment >= 0 else size]))
            break
        m = mark.match(html, opened)
        if m is None and mark is MARK and (loose := LOOSE_MARK.match(html, opened)):
            mark, m = LOOSE_MARK, loose  # an unclosed quote: from here on quotes mean nothing
        if m is None:
            pieces.append("<")
            at = opened + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE and not any(t == tag for t, _ in stack[-3:]):
                continue
            if tag not in INLINE:
                flush() if tag not in SPACING else pieces.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush()
                    zone = stack[i][1]
                    del stack[i:]
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag in VOID or tag in SPACING:
            pieces.append(" ") if tag in SPACING else None
            if tag == "hr":
                flush()
            continue
        if tag in INLINE and (not m[3].strip() or judged(tag, m[3]) != DROPPED):
            continue
        flush()
        if tag not in INLINE and stack and stack[-1][0] in ENDS_ITSELF and (stack[-1][0] == tag or stack[-1][0] == "p"):
            zone = stack.pop()[1]
        if m[3].endswith("/"):
            continue
        stack.append((tag, zone))
        if zone == DROPPED:
            continue
        says = judged(tag, m[3])
        if says == DROPPED or (tag == "header" and zone == NEUTRAL):
            zone = DROPPED
        elif tag == "article":
            zone = ARTICLE
        elif says == CONTENT and zone == NEUTRAL:
            zone = CONTENT
    flush()
    return out
