"""A small reader of HTML as it is found: a tree of elements and texts, tolerant of what is left open or cut off."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(r"""<(?:!--.*?(?:-->|$)|([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|/([a-zA-Z][^\s/>]*)[^>]*>|[!?/][^>]*>|[a-zA-Z!?/][^<]*\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes if it is open, and the elements that shield it.
CLOSES = {
    **{t: ({"p"}, frozenset({"table", "button", "td", "th", "caption", "object"})) for t in BLOCK - {"br", "body", "html", "head", "li", "dd", "dt", "option", "optgroup", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "legend"}},
    "li": ({"li", "p"}, frozenset({"ul", "ol", "menu"})),
    **{t: ({"dd", "dt", "p"}, frozenset({"dl"})) for t in ("dd", "dt")},
    "option": ({"option"}, frozenset({"select", "datalist"})),
    **{t: ({"td", "th"}, frozenset({"table", "tr"})) for t in ("td", "th")},
    "tr": ({"tr", "td", "th"}, frozenset({"table"})),
    **{t: ({"tbody", "thead", "tfoot", "tr", "td", "th"}, frozenset({"table"})) for t in ("tbody", "thead", "tfoot")},
}

#: Words of class, id and role names that mark what isn't the main text.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing "
    "social related recommended widget pagination pager skip toolbar complementary contentinfo search login".split()
)
ASIDE_TAGS = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select textarea input head title menu dialog audio video map".split())
#: What HTML itself keeps out of a page's text: what is not shown, and what is filled in.
SILENT_TAGS = frozenset("head script style noscript template iframe object svg canvas button select textarea input title audio video map form".split())
MAIN_TAGS = frozenset({"article", "main"})
DEEPEST = 200


class Element:
    __slots__ = ("tag", "label", "aside", "named", "silent", "kids")

    def __init__(self, tag: str, label: str, aside: bool, named: bool):
        self.tag, self.label = tag, label
        self.aside = aside  # not main text, by its tag or name
        self.named = named  # and so only by its class, id or role
        self.silent = tag in SILENT_TAGS
        self.kids: list[Element | str] = []


def parse(page: str) -> Element:
    """The root element, whose label is empty."""
    root = Element("", "", False, False)
    stack, at, seen_main, too_deep = [root], 0, False, {}
    search = TOKEN.search
    while True:
        m = search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].kids.append(html.unescape(text) if "&" in text else text)
        if not m:
            return root
        at = m.end()
        if opened := m[1]:
            tag = opened.lower()
            if tag in CLOSES:
                closed, shields = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in closed:
                        del stack[k:]
                        # an open row holds open cells
                        if tag not in ("tr", "tbody", "thead", "tfoot", "li", "dd", "dt"):
                            break
                    elif stack[k].tag in shields:
                        break
            names = {n.lower(): a or b or c for n, a, b, c in ATTRIBUTE.findall(m[2])} if "=" in m[2] else {}
            marks = sorted(f"{names.get('class', '')} {names.get('id', '')}".split())
            label = tag + "".join("." + x for x in marks if not any(c.isdigit() for c in x))
            role = names.get("role", "").lower()
            words = {w for x in marks for w in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", x)} | set(role.split())
            in_main = any(e.tag in MAIN_TAGS for e in stack)
            named = tag not in ("html", "body", "") and not ASIDE_WORDS.isdisjoint(w.lower() for w in words)
            aside = named or tag in ASIDE_TAGS or tag == "header" and not in_main
            if tag in MAIN_TAGS and not named and not seen_main:
                seen_main = True
                for e in stack:  # what holds the main text isn't beside it, whatever its name
                    if e.named and e.tag not in ASIDE_TAGS:
                        e.aside = e.named = False
            element = Element(tag, label, aside, named)
            stack[-1].kids.append(element)
            if tag in RAW:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                content = page[at : end.start()] if end else page[at:]
                if tag in ("textarea", "title"):
                    element.kids.append(html.unescape(content))
                at = page.find(">", end.end() - 1) + 1 if end else len(page)
                at = at or len(page)
            elif tag not in VOID:
                if len(stack) < DEEPEST:
                    stack.append(element)
                else:  # what is nested deeper lies side by side
                    too_deep[tag] = too_deep.get(tag, 0) + 1
        elif m[3]:
            tag = m[3].lower()
            if too_deep.get(tag):
                too_deep[tag] -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break


def pieces(element: Element, skip: frozenset[int] | set[int] = frozenset(), out: list[str] | None = None, left: dict[int, bool] | None = None) -> list[str]:
    """Texts of the main part in page order, with a blank where a block begins or ends. `skip` has ids of elements
    whose own texts are left out; `left` tells by id which elements are left out whole: those it does not know are if
    their tag or name says so."""
    out, left = [] if out is None else out, left or {}
    # (element, its next kid), so that deep pages need no deep stack
    todo = [(element, iter(element.kids), id(element) in skip)]
    while todo:
        now, kids, silent = todo[-1]
        for kid in kids:
            if isinstance(kid, str):
                if not silent:
                    out.append(kid)
                continue
            if kid.tag in BLOCK:
                out.append(" ")
            if not (kid.silent or left.get(id(kid), kid.aside)):
                todo.append((kid, iter(kid.kids), id(kid) in skip))
                break
        else:
            if now.tag in BLOCK:
                out.append(" ")
            todo.pop()
    return out


def flowing(parts: list[str]) -> str:
    """White space within and between blocks as one blank, none at the ends."""
    return " ".join("".join(parts).split())
