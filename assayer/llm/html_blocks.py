"""Leaf blocks of a page with the features that their ancestors and their text give."""

from __future__ import annotations

import html
import re
from collections import Counter

#: Elements whose content isn't text of the page; elements without content; elements that stay inside a block.
UNSEEN = frozenset("script style noscript template iframe svg annotation title canvas audio video select datalist textarea".split())
#: Elements whose content has no tags.
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title")}
#: Where a script or the like without an end tag is taken to end; what may stand in a list of choices.
BODY = re.compile(r"</?(?:p|div|h[1-6]|article|section|main|ul|ol|dl|table|blockquote|body|html|header|footer|nav|aside)(?=[\s/>])", re.I)
CHOICES = frozenset("option optgroup hr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img button input math mi mn mo ms mrow mtext mspace mfrac msqrt mroot msup msub msubsup mover munder munderover mfenced mstyle mtable mtr mtd semantics".split())
#: Tags and words of class, id and role that are features.
TAGS = "nav header footer aside article main section div form fieldset ul ol li dl dt dd table tr td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption details summary address dialog menu center body".split()
WORDS = (
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr privacy notice alert warning message "
    "comment comments reply replies discussion disqus respond sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer foot copyright legal header masthead top topbar "
    "share sharing social related recommended more tags tag category meta byline author date newsletter subscribe signup login search form rating vote "
    "content article post entry story body text main page title headline lead intro paragraph caption"
).split()
#: Closed by a start tag of their own kind.
_AGAIN = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = {"ul", "ol", "table", "div", "section", "article", "body", "dl", "blockquote", "form", "main", "aside", "nav", "td", "header", "footer"}
_PARTS = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.S)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

FEATURES = ["bias", *(f"in:{t}" for t in TAGS), *(f"own:{t}" for t in TAGS), *(f"word:{w}" for w in WORDS), *(f"near:{w}" for w in WORDS)]
FEATURES += [f"words:{k}" for k in range(7)] + [f"links:{k}" for k in range(4)] + ["stop", "mark", "bars", "colon", "digits", "capitals", "copyright", "no tags"]
NUMBER = {f: k for k, f in enumerate(FEATURES)}
_TAGS, _WORDS = frozenset(TAGS), frozenset(WORDS)
_known: dict[tuple, frozenset] = {}
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in UNSEEN}


def _context(above: frozenset, tag: str, attributes: str) -> frozenset:
    """The features of all blocks in an element, from its parent's, its tag and its names."""
    key = (above, tag, attributes)
    if key in _known:
        return _known[key]
    own = {f for f in above if not FEATURES[f].startswith(("own:", "near:"))}
    if tag in _TAGS:
        own |= {NUMBER[f"in:{tag}"], NUMBER[f"own:{tag}"]}
    for m in _NAMED.finditer(attributes) if "=" in attributes else ():
        for w in _SPLIT.split(_CAMEL.sub("-", m[1] or m[2] or m[3] or "").lower()):
            if w in _WORDS:
                own |= {NUMBER[f"word:{w}"], NUMBER[f"near:{w}"]}
    if len(_known) > 20_000:
        _known.clear()
    return _known.setdefault(key, frozenset(own))


_BUCKETS = (2, 4, 8, 15, 30, 60)


def _text_features(text: str, linked: int) -> list[int]:
    n = text.count(" ") + 1
    share = linked / len(text)
    out = [NUMBER["bias"], NUMBER["words:0"] + sum(n > b for b in _BUCKETS), NUMBER["links:0"] + (share > 0.05) + (share > 0.3) + (share > 0.8)]
    if text[-1] in ".!?…»”\"":
        out.append(NUMBER["stop"])
    if any(c in text for c in ".,;"):
        out.append(NUMBER["mark"])
    if "·" in text or "»" in text or "›" in text:
        out.append(NUMBER["bars"])
    if text[-1] == ":":
        out.append(NUMBER["colon"])
    if text[0].isdigit():
        out.append(NUMBER["digits"])
    if text.isupper():
        out.append(NUMBER["capitals"])
    if "©" in text or "(c)" in text:
        out.append(NUMBER["copyright"])
    return out


def blocks(page: str) -> list[tuple[str, list[int]]]:
    """(text, features) of the page's leaf blocks in order, white space squeezed and character references decoded; empty blocks are left out.

    A start or end tag of an element that isn't inline ends a block; br is a space; unclosed elements, stray end tags, cut-off
    tags and comments are borne. All that head shows is skipped by itself, so head needs no end. Elements without an end tag
    hide nothing, but for noscript, which ends with an element around it, and scripts and the like, which end at the next tag
    of a body; a list of choices ends at any tag that can't stand in it.
    """
    root = frozenset()
    stack: list[tuple[str, frozenset]] = [("", root)]
    out: list[tuple[str, list[int], frozenset]] = []
    held: list[str] = []
    linked = in_link = 0
    skip: str | None = None
    inner: Counter = Counter()
    ends: dict[str, int] = {}
    at = 0

    def flush():
        nonlocal linked, in_link
        if held:
            raw = "".join(held)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            held.clear()
            if text:
                out.append((text, _text_features(text, linked), stack[-1][1]))
        linked = in_link = 0

    def closed(tag: str) -> bool:
        """Whether the element's end tag stands ahead."""
        if ends.get(tag, 0) <= at:
            found = _ENDS[tag].search(page, at)
            ends[tag] = found.end() if found else len(page) + 1
        return ends[tag] <= len(page)

    while m := _PARTS.match(page, at):
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if skip is None and m[0][:2] != "<!" and m[0][:2] not in ("<?", "</"):
                held.append(m[0])
                if in_link:
                    linked += len(m[0])
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing and not attributes.endswith("/"):
            end = RAW[tag].search(page, at) if closed(tag) else BODY.search(page, at)
            at = end.start() if end else len(page)
            continue
        if skip in ("select", "datalist") and not closing and tag not in CHOICES:
            skip = None
        if skip is not None:
            if closing and tag == skip:
                skip = None
                continue
            if not closing or inner[tag] or all(tag != t for t, _ in stack):
                inner[tag] += -(inner[tag] > 0) if closing else not attributes.endswith("/")
                continue
            skip = None
        if tag in UNSEEN:
            if not closing and not attributes.endswith("/") and (closed(tag) or tag in ("select", "datalist") or tag == "noscript" and stack[-1][0] not in ("", "html", "body")):
                skip = tag
                inner.clear()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br" or tag == "img" or tag == "input":
                held.append(" ")
            continue
        flush()
        if tag in VOID or tag == "head":
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag == "p" and stack[k][0] in _BARRIER:
                    break
            continue
        if tag in _AGAIN:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _AGAIN[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in _BARRIER and stack[k][0] != tag:
                    break
        elif tag not in ("html",) and stack[-1][0] == "p":
            stack.pop()  # a block element ends an open paragraph
        if not attributes.endswith("/"):
            stack.append((tag, _context(stack[-1][1], tag, attributes)))
    flush()
    plain = NUMBER["no tags"]
    return [(t, f + ([plain] if not c else list(c))) for t, f, c in out]
