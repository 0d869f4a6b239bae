"""The text lines of a web page, with where they stand. Tolerates cut and badly nested markup."""

from __future__ import annotations

import re
from html import unescape

# A line's place.
OUTSIDE, INSIDE, DROPPED = 0, 1, 2

# What an element of these holds is no text.
_RAW = {t: re.compile(rf"</{t}\s*+>", re.I) for t in "script style template noscript iframe textarea title svg".split()}
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
# An attribute, or a bare mark; a quote opens a value only right after the equals sign.
_NEXT = re.compile(r"[\s/]*+(?:(>)|([^\s/>=]++|=[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+)")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Ends of these are often left out; they are not tracked.
_LOOSE = frozenset("p li dt dd tr td th option thead tbody tfoot colgroup".split())
_MAIN = frozenset(("article", "main"))
_BESIDE = frozenset("nav footer header aside form menu button select dialog".split())
# Whole names in a class or id; words in longer names (has-sidebar, entry-header, social-history) tell nothing.
_NAMES = re.compile(
    r"(?:ads?|adverts?|advertisements?|advertising|banners?|breadcrumbs?|comments?|comment-(?:list|body)|user-comments?|cookies?|cookie-(?:banner|consent|notice)|consent|disqus|footers?|headers?|masthead|menus?|nav|navbar|navigation|newsletters?|notices?|popups?|promos?|promoted"
    r"|related|replies|share|sharing|sidebars?|social|sponsor|sponsored|subscribe|toolbar|widgets?)"
)
# Inside an article only adverts, sidebars, newsletters and what others wrote go by their names.
_NAMES_IN_MAIN = re.compile(r"ads?|adverts?|advertisements?|advertising|sponsored|sidebars?|newsletters?|comments?|comment-(?:list|body)|user-comments?")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
_WATCHED = frozenset("class id role hidden aria-hidden".split())
# A start tag of these ends an open element of the key.
_ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}


def _tags(html: str):
    """(start, end, tag, whether it closes, attributes that matter) of every tag, and (start, end, None, False, None) of what else is no text.

    One pass to the right. Where no bracket closes a tag any more, the last opening one begins a cut tag and all before is text.
    """
    last, at = html.rfind(">"), 0
    while True:
        low = html.find("<", at)
        if low < 0:
            return
        if html.startswith("<!--", low):
            end = html.find("-->", low + 4)
            at = len(html) if end < 0 else end + 3
            yield low, at, None, False, None
            continue
        m = _TAG.match(html, low)
        other = m is None and html[low + 1:low + 2] in ("!", "?", "/")
        if low > last:
            low = html.rfind("<")
            if _TAG.match(html, low) or html[low + 1:low + 2] in ("!", "/"):
                yield low, len(html), None, False, None
            return
        if other:
            at = html.index(">", low) + 1
            yield low, at, None, False, None
            continue
        if m is None:
            at = low + 1
            continue
        tag, at, attributes = m.group(1).lower(), m.end(), None
        while n := _NEXT.match(html, at):
            at = n.end()
            if n.group(1):
                break
            name = n.group(2).lower()
            if name in _WATCHED:
                attributes = attributes or []
                attributes.append((name, n.group(3) or n.group(4) or n.group(5) or ""))
        else:
            at = len(html)
        closes = html[low + 1] == "/"
        if not closes and tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else len(html)
            yield low, at, None, False, None
        else:
            yield low, at, tag, closes, attributes


def _beside(tag: str, attributes: list[tuple[str, str]] | None, in_main: bool) -> bool:
    """Whether an element holds what isn't part of an article."""
    if tag in _BESIDE and not (tag == "header" and in_main):
        return True
    for name, value in attributes or ():
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main") and any((_NAMES_IN_MAIN if in_main else _NAMES).fullmatch(w) for w in value.lower().split()):
            return True
    return False


def lines(html: str | None) -> list[tuple[str, int]]:
    """Text blocks in page order with their place: in the article, in an element beside it, or elsewhere.

    An element that encloses an article is never beside it. Character references are decoded, white space in a block is one
    blank, empty blocks are left out.
    """
    if not html:
        return []
    # Each line with the innermost element beside the article that it is in, by number; 0 is none.
    found: list[tuple[str, int, int]] = []
    # The element beside the article around each such element, and whether it turned out to enclose an article.
    around, enclosing = [0], [True]
    parts: list[str] = []
    # Open elements that matter: tag, and place and element beside the article inside of it. How many of each tag are open.
    open_tags: list[tuple[str, int, int]] = []
    open_count: dict[str, int] = {}
    place, beside, head = OUTSIDE, 0, False

    def end_block() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text and not head:
            found.append((text, place, beside))

    def close(many: int) -> tuple[int, int]:
        """Close open elements until ``many`` are left; the place and element beside the article then."""
        while len(open_tags) > many:
            open_count[open_tags.pop()[0]] -= 1
        return open_tags[-1][1:] if open_tags else (OUTSIDE, 0)

    at = 0
    for low, high, tag, closes, attributes in _tags(html):
        parts.append(html[at:low])
        at = high
        if tag is None:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "head":
            end_block()
            head = not closes
            continue
        if tag == "body" and head:
            end_block()
            head = False
        inline = tag in _INLINE
        if not inline:
            end_block()
        if tag in _VOID:
            continue
        if closes:
            if open_count.get(tag):
                k = len(open_tags) - 1
                while open_tags[k][0] != tag:
                    k -= 1
                now = close(k)
                if now != (place, beside) and inline:
                    end_block()
                place, beside = now
            continue
        # A start tag may end the element before it, whose end tag was left out.
        if open_tags and not inline and open_tags[-1][0] in _ENDS and tag in (_ENDS[open_tags[-1][0]] or (tag,)):
            place, beside = close(len(open_tags) - 1)
        now = place, beside
        if _beside(tag, attributes, place == INSIDE):
            around.append(beside)
            enclosing.append(False)
            now = place, len(around) - 1
        elif tag in _MAIN and place == OUTSIDE:
            while not enclosing[beside]:
                enclosing[beside] = True
                beside = around[beside]
            now = INSIDE, 0
        elif tag in _LOOSE:
            continue
        if now != (place, beside) and inline:
            end_block()
        if not inline or now != (place, beside):
            open_tags.append((tag, *now))
            open_count[tag] = open_count.get(tag, 0) + 1
        place, beside = now
    parts.append(html[at:])
    end_block()
    # Outer elements have lower numbers.
    dropped = [False]
    for k in range(1, len(around)):
        dropped.append(not enclosing[k] or dropped[around[k]])
    return [(x, DROPPED if dropped[b] else p) for x, p, b in found]
