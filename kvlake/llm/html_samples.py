"""Labelled pages to train on: page layouts of many kinds, each block known to be the article's or not.

Words are made up, so that a model learns places and shapes and no vocabulary.
"""

from __future__ import annotations

import random

from .html_blocks import MAIN, NAMES

_SYLLABLES = "an be ci do el fu ga hi in jo ka lu mo ne or pa qui re sa ti um va wo xe yu zu ä é ñó ß ção ст ра но".split()


class Writer:
    def __init__(self, rng: random.Random, names: dict[str, list[str]] = NAMES, main: list[str] = MAIN):
        self.rng, self.names, self.main = rng, names, main
        self.alphabet = rng.sample(_SYLLABLES, 14)

    def word(self) -> str:
        return "".join(self.rng.choices(self.alphabet, k=self.rng.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        w = " ".join(self.word() for _ in range(self.rng.randint(low, high)))
        return w[:1].upper() + w[1:]

    def sentences(self, low: int, high: int) -> str:
        mark = lambda: self.rng.choice((".", ".", ".", "?", "!"))
        return " ".join(self.words(1, 18).replace(" ", ", " if self.rng.random() < 0.1 else " ", 1) + mark() for _ in range(self.rng.randint(low, high)))

    def paragraph(self) -> str:
        r = self.rng.random()
        if r < 0.2:
            return self.words(1, 4) + self.rng.choice((".", "", ".", "?"))
        if r < 0.23:  # a licence, a date or a number
            return self.words(1, 4) + f" {self.rng.choice(('CC', 'No.', 'v', '©', 'ISBN'))} {self.rng.randint(1, 2030)}.{self.rng.randint(0, 99)}" + self.rng.choice((".", ""))
        if r < 0.34:  # lists of cells, code and the like
            return self.rng.choice((" | ", " ", " *** ", ": ")).join(self.words(1, 2) for _ in range(self.rng.randint(3, 80)))
        return self.sentences(1, 12)

    def name(self, kind: str) -> str:
        n = self.rng.choice(self.main if kind == "main" else self.names[kind])
        if self.rng.random() < 0.15:
            n = self.rng.choice(("js-", "c-", "block-", "region-", "m-")) + n
        if self.rng.random() < 0.1:
            n = "".join(x.capitalize() for x in n.split("-"))
        return n

    def attributes(self, kind: str, bare: float) -> str:
        if self.rng.random() < bare:
            return ""
        key = self.rng.choice(("class", "class", "class", "id"))
        extra = f" {self.word()}" if key == "class" and self.rng.random() < 0.3 else ""
        return f' {key}="{self.name(kind)}{extra}"'


def page(seed: int, names: dict[str, list[str]] = NAMES, main: list[str] = MAIN) -> tuple[str, list[str]]:
    """A page and the article's blocks in order. Its parts have some of ``names``, the article's some of ``main``."""
    rng = random.Random(seed)
    w = Writer(rng, names, main)
    bare, semantic = rng.choice((0.0, 0.0, 0.2, 0.5)), rng.random() < 0.65
    truth: list[str] = []

    def tag(name: str, kind: str, inner: str, loose: float | None = None) -> str:
        return f"<{name}{w.attributes(kind, bare if loose is None else loose)}>{inner}</{name}>"

    def links(low: int, high: int, short: bool = True) -> str:
        one = lambda: f'<a href="/{w.word()}">{w.words(1, 2) if short else w.words(3, 10)}</a>'
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(rng.randint(low, high))) + "</ul>"
        return rng.choice((" ", " | ", " &middot; ", " / ")).join(one() for _ in range(rng.randint(low, high)))

    def part(kind: str) -> str:
        if kind == "menu":
            return tag(rng.choice(("nav", "nav", "div", "ul")) if semantic else "div", "menu", links(3, 9), 0.4 if semantic else bare / 2)
        if kind == "header":
            inner = f"<{(h := rng.choice(('h1', 'div', 'p', 'a', 'h2')))}>{w.words(1, 4)}</{h}>" + (f"<p>{w.words(2, 8)}</p>" if rng.random() < 0.5 else "")
            return tag("header" if semantic else "div", "header", inner, 0.5 if semantic else 0.1)
        if kind == "footer":
            inner = rng.choice(("&copy; ", "© 2024 ", "Copyright ", "")) + w.word() + rng.choice((" &middot; ", ". ", " - ")) + w.sentences(1, 2) + (links(2, 6) if rng.random() < 0.5 else "")
            return tag("footer" if semantic else "div", "footer", inner if rng.random() < 0.5 else f"<p>{inner}</p>", 0.5 if semantic else 0.1)
        if kind == "sidebar":
            inner = f"<h3>{w.words(1, 4)}</h3>" + (links(3, 8, False) if rng.random() < 0.7 else f"<p>{w.sentences(1, 3)}</p>")
            return tag("aside" if semantic else "div", "sidebar", inner, 0.4 if semantic else 0.0)
        if kind == "share":
            return tag("div", "share", links(2, 5), 0.0)
        if kind == "form":
            field = '<input type="text" name="q">' + rng.choice(("", "<button>Go</button>", f'<input type="submit" value="{w.word()}">'))
            inner = rng.choice((f"<label>{w.words(1, 4)}</label>", f"<p>{w.sentences(1, 2)}</p>", f"<h3>{w.words(1, 4)}</h3><p>{w.words(3, 12)}</p>")) + field
            return f"<form{w.attributes('form', 0.4)}>{inner}</form>"
        if kind == "comments":
            one = lambda: tag(rng.choice(("div", "li", "article", "div")), "comments", rng.choice((f"<b>{w.words(1, 2)}</b> ", f"<p>{w.words(1, 3)}</p>", "", f"<h4>{w.words(1, 3)}</h4>")) + f"<p>{w.sentences(1, 5)}</p>", 0.4)
            inner = f"<h3>{w.words(1, 3)}</h3>" * (rng.random() < 0.7) + "".join(one() for _ in range(rng.randint(1, 6)))
            return tag(rng.choice(("section", "div", "ol")), "comments", inner, 0)
        inner = w.sentences(1, 3) if kind == "notice" else rng.choice((w.sentences(1, 2), w.words(2, 8), f"<a href='#'>{w.words(2, 8)}</a>"))
        inner = inner if rng.random() < 0.5 else f"<p>{inner}</p>"
        return f"<!-- {kind} -->" * (rng.random() < 0.2) + tag(rng.choice(("div", "div", "section", "aside", "p")), kind, inner, 0.0)

    def say(text: str) -> str:
        truth.append(" ".join(text.split()))
        return text.replace("&", "&amp;").replace("<", "&lt;")

    def article() -> str:
        out = []
        if rng.random() < 0.85:
            h = f"<h1>{say(w.words(1, 9))}</h1>"
            out.append(tag("header", "main", h, 1.0) if semantic and rng.random() < 0.12 else h)
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.72:
                p, begin = w.paragraph(), rng.choice(("<p>", "<p>", "<p>", "<p><b>", f'<p class="{w.word()}">'))
                end = rng.choice(("</p>", "</p>", "</p>", "", "<br>")) if "b>" not in begin else rng.choice(("</b></p>", "<br>"))
                out.append(begin + say(p) + end)
            elif r < 0.78:
                out.append(f"<{(h := rng.choice(('h2', 'h3')))}>{say(w.words(1, 6))}</{h}>")
            elif r < 0.83:
                out.append("<ul>" + "".join(f"<li>{say(w.sentences(1, 2) if rng.random() < 0.6 else w.words(1, 6))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif r < 0.87:
                out.append(f"<blockquote><p>{say(w.sentences(1, 3))}</p></blockquote>")
            elif r < 0.9:
                a, b = w.words(2, 8), w.words(1, 3)
                truth.append(f"{a} {b} end.")
                begin, end = rng.choice((('<a href="/x">', "</a>"),) * 4 + (("<math><mi>", "</mi></math>"), ("<button>", "</button>"), ('<span aria-hidden="true">', "</span>")))
                out.append(f"<p>{a} {begin}{b}{end} end.</p>")
            elif r < 0.92:
                out.append(f"<pre>{say(w.words(2, 30))}</pre>")
            elif r < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{say(w.words(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            else:
                out.append(part(rng.choice(("ad", "ad", "share", "notice", "sidebar", "form"))))
        return "".join(out)

    before = [part(k) for k in ("header", "menu", "notice", "ad", "form", "share") if rng.random() < {"header": 0.5, "menu": 0.8, "notice": 0.35, "ad": 0.4, "form": 0.2, "share": 0.1}[k]]
    rng.shuffle(before)
    body = article()
    kind = rng.random()
    if semantic and kind < 0.7:
        body = f"<article{w.attributes('main', 0.6)}>{body}" + (part("comments") if rng.random() < 0.06 else "") + "</article>"
        body = f"<main>{body}</main>" if rng.random() < 0.3 else body
    elif semantic and kind < 0.9:
        body = f"<main{w.attributes('main', 0.5)}>{body}</main>"
    else:
        body = f"<div{w.attributes('main', bare)}>{body}</div>"
        body = f'<div id="wrapper">{body}</div>' if rng.random() < 0.3 else body
    after = [part(k) for k in ("share", "comments", "sidebar", "ad", "form", "notice", "footer") if rng.random() < {"share": 0.2, "comments": 0.45, "sidebar": 0.5, "ad": 0.2, "form": 0.3, "notice": 0.15, "footer": 0.85}[k]]
    before += [part("sidebar")] * (rng.random() < 0.15)
    head = f"<!DOCTYPE html><html><head><title>{w.words(1, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
    return head + "".join(before) + body + "".join(after) + rng.choice(("</body></html>", "")), truth
