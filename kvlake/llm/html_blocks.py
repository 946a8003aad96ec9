"""HTML to leaf blocks: runs of text between block-level tags, with what stands above each in the document tree."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content a browser doesn't show as text of the page: code, embedded media and the choices of form fields.
UNSEEN = frozenset("script style noscript template svg head title select textarea iframe object canvas datalist".split())
#: Those of them whose content holds no tags.
RAW = frozenset("script style noscript title textarea iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder mover semantics annotation q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What can stand in a head; anything else, or text, ends an open one.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Kinds of elements of which an open one ends when the next begins, and what that ends with it.
GROUP_OF = {"p": 0, "li": 1, "dt": 2, "dd": 2, "td": 3, "th": 3, "tr": 4, "option": 5}
#: Elements in which a list item or a description of an outer list can't end.
_CLOSED = (ENDS_P - {"address", "div", "p"}) | {"td", "th", "caption"}
#: For each element, the kinds whose open element is out of reach inside it.
RESETS = {n: (1, 2) for n in _CLOSED} | {"table": (0, 1, 2, 3, 4), "tr": (3,), "td": (0, 1, 2), "th": (0, 1, 2), "caption": (0, 1, 2), "button": (0,), "template": (0, 1, 2, 3, 4)}
#: An end tag inside one of these doesn't reach an element around it, unless it is one of a table's own.
BARRIERS = frozenset("td th caption table template".split())
OF_TABLE = frozenset("table thead tbody tfoot tr td th caption template body html".split())
# A hand-picked list of names that page authors give to the parts of a page. Blocks below such a name get its
# kind as a feature, and the training pages draw their names from it; how the field does without it is tested.
NAMES = {
    "menu": "nav navbar navigation menu main-menu site-nav topnav breadcrumb breadcrumbs nav-links primary-menu pagination pager toc tabs skip-link".split(),
    "header": "header site-header masthead topbar top-bar page-header branding logo site-title tagline".split(),
    "footer": "footer site-footer page-footer colophon copyright legal bottom footer-links credits".split(),
    "sidebar": "sidebar side-bar aside widget widget-area rail right-rail related related-posts recommended popular trending more-stories secondary read-next tags tag-list".split(),
    "notice": "notice cookie-notice cookie-banner cookie-consent consent gdpr alert banner message popup modal overlay warning announcement privacy-notice paywall disclaimer".split(),
    "ad": "ad ads advert advertisement ad-slot ad-banner adsbox sponsored sponsor promo promotion promoted banner-ad dfp commercial".split(),
    "form": "form newsletter subscribe signup login search search-form contact-form email-signup poll".split(),
    "share": "share share-buttons social social-links follow toolbar sharing".split(),
    "comments": "comments comment-list commentlist comment reply replies responses respond discussion disqus user-comments reader-comments feedback".split(),
}
MAIN = "content main post post-content entry entry-content article article-body story story-body body text main-content single page-content prose article-content".split()

def kinds(names: dict[str, list[str]] = NAMES, main: list[str] = MAIN) -> dict[str, str]:
    """The kind of part that a word of a name stands for; words of several kinds stand for none."""
    by: dict[str, set] = {}
    for kind, own in [*names.items(), ("main", main)]:
        for w in {w for n in own for w in n.split("-")}:
            by.setdefault(w, set()).add(kind)
    plain = {"page", "site", "main", "primary", "list", "area", "user", "box", "bar", "more", "next", "read", "right", "secondary", "links", "top", "single"}
    return {w: k.pop() for w, k in by.items() if len(k) == 1 and w not in plain}


KIND_OF = kinds()
TAG_KINDS = {"nav": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "article": "main", "main": "main"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Node:
    """An open element: a link of the chain to the root, which all blocks and elements inside it share."""

    __slots__ = ("name", "up", "own", "new", "unseen", "link", "near", "named", "in_main", "open", "barrier", "place", "total")

    def __init__(self, name: str, up: Node | None, own: frozenset, new: tuple, *, unseen: bool, link: bool, near: str, named: bool, in_main: bool, open_: tuple, barrier: int, place: int):
        self.name, self.up, self.own, self.new = name, up, own, new
        self.unseen, self.link, self.near, self.named, self.in_main = unseen, link, near, named, in_main
        #: Places of the open elements by kind, and of the nearest barrier; its own place in the stack.
        self.open, self.barrier, self.place = open_, barrier, place
        self.total: float | None = None

    def above(self) -> frozenset:
        """The features of the element and of all around it."""
        out, n = set(), self
        while n:
            out.update(n.new)
            n = n.up
        return frozenset(out)

    def weight(self, get) -> float:
        """The sum of ``get(feature)`` over ``above()``, found once for each element."""
        chain, n = [], self
        while n is not None and n.total is None:
            chain.append(n)
            n = n.up
        total = n.total if n is not None else 0.0
        for n in reversed(chain):
            total += sum(map(get, n.new))
            n.total = total
        return total


@dataclass
class Block:
    text: str
    node: Node  # the block's own element
    linked: int  # characters inside links and buttons
    path: str  # the tags of its two nearest elements

    @property
    def above(self) -> frozenset:
        return self.node.above()

    @property
    def parent(self) -> frozenset:
        return self.node.own

    @property
    def near(self) -> str:
        return self.node.near


def _names(attributes: str) -> tuple[frozenset, bool]:
    """Words of the element's names, and whether it is hidden."""
    words, hidden = set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif key == "hidden":
            hidden |= m[2] is m[3] is m[4] is None or value.lower() in ("", "hidden")
        else:
            for w in _NAME.findall(value):
                w = w.lower()
                words.add("c=" + w)
                if len(w) > 3 and w.endswith("s"):
                    words.add("c=" + w[:-1])
    return frozenset(words), hidden


def blocks(page: str | None, kind_of: dict[str, str] = KIND_OF) -> list[Block]:
    """The page's blocks in order, none empty; white space in a block is one space and character references are decoded.

    The time is proportional to the page, however deep its elements are: what an element needs to know
    of those around it is held by the element, and where elements of a name are open is held by name.
    """
    page = page or ""
    out: list[Block] = []
    root = Node("", None, frozenset(), (), unseen=False, link=False, near="", named=False, in_main=False, open_=(-1,) * 6, barrier=0, place=0)
    stack = [root]
    open_at: dict[str, list[int]] = {}
    having: dict[str, int] = {}  # how many open elements have a feature
    place_at = [0]  # the nearest element that is not inline, for each open one
    text: list[str] = []
    linked = 0
    place, path = root, ""

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, place, linked, path))
            text.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked, place, path
        if stack[-1].name == "head" and raw.strip():
            cut(len(stack) - 1)
        top = stack[-1]
        if top.unseen or not raw:
            return
        if not text:
            k = place_at[-1]
            place, path = stack[k], f"{stack[k - 1].name}>{stack[k].name}" if k else ""
        text.append(raw)
        if top.link:
            linked += len(raw.strip())

    def cut(k: int) -> None:
        """Ends the elements from a place on."""
        for n in stack[k:]:
            open_at[n.name].pop()
            for x in n.own:
                having[x] -= 1
        del stack[k:], place_at[k:]

    def close(name: str) -> None:
        at = open_at.get(name)
        if at and (at[-1] >= stack[-1].barrier or name in OF_TABLE):
            cut(at[-1])

    at, size = 0, len(page)
    last = page.rfind(">")
    while at < size:
        m = _TOKEN.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, ending, attributes = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name == "br":
            say(" ")
            continue
        if name not in INLINE:
            flush()
        if ending:
            close(name)
            continue
        if name not in IN_HEAD and stack[-1].name == "head":
            cut(len(stack) - 1)
        if name in VOID:
            continue
        group = GROUP_OF.get(name)
        ends = stack[-1].open[0] if name in ENDS_P else -1
        if group:
            ends = stack[-1].open[group]
        if ends >= 0:
            cut(ends)
        words, hidden = _names(attributes) if attributes else (frozenset(), False)
        top = stack[-1]
        found = {kind_of[w[2:]] for w in words if w[2:] in kind_of}
        found = found - {"main"} or found or ({TAG_KINDS[name]} if name in TAG_KINDS else set())
        own = words | {"t=" + name} | {"k=" + k for k in found}
        if not attributes.endswith("/") or name not in ("svg", "path", "g"):
            k = len(stack)
            reach = list(top.open)
            for g in RESETS.get(name, ()):
                reach[g] = -1
            if group is not None:
                reach[group] = k
            new = tuple(x for x in own if not having.get(x))
            node = Node(
                name, top, own, new, unseen=top.unseen or hidden or name in UNSEEN, link=top.link or name in ("a", "button"), near=min(found) if found else top.near,
                named=top.named or bool(words), in_main=top.in_main or name in ("article", "main"), open_=tuple(reach), barrier=k if name in BARRIERS else top.barrier, place=k,
            )
            stack.append(node)
            place_at.append(place_at[-1] if name in INLINE else k)
            open_at.setdefault(name, []).append(k)
            for x in own:
                having[x] = having.get(x, 0) + 1
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            at = end.start() if end else size
    flush()
    return out
