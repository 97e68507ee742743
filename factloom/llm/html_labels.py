"""Labelled pages from which the content weights are learned.

Pages are built from templates with known parts. Every word of the main text
begins with ``c``, every other word with ``b``, so a parsed block tells its label.
"""

from __future__ import annotations

import random

#: Class or id words of containers, by what they hold.
CONTENT_NAMES = ["content", "post", "entry", "article", "story", "main", "body", "text", "page"]
OTHER_NAMES = {
    "menu": ["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "tabs", "pagination", "skip"],
    "side": ["sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "tags", "share", "social", "author", "promo"],
    "notice": ["notice", "cookie", "cookies", "consent", "gdpr", "banner", "alert", "popup", "modal", "overlay", "message", "hidden", "disclaimer"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promoted", "adbox"],
    "talk": ["comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "review"],
    "frame": ["header", "masthead", "topbar", "footer", "copyright", "legal", "subscribe", "newsletter", "signup", "login", "search"],
}


def _words(draw: random.Random, mark: str, low: int, high: int) -> str:
    return " ".join(f"{mark}{draw.randrange(10000)}" for _ in range(draw.randint(low, high)))


def _inline(draw: random.Random) -> str:
    """A few words of a paragraph, plain, linked or in an inline element, sometimes left open."""
    words, kind = _words(draw, "c", 1, 4), draw.random()
    if kind < 0.4:
        return f' <a href="/x">{words}</a> '
    tag = draw.choice(["b", "i", "em", "strong", "span"])
    return f" <{tag}>{words}</{tag}> " if kind < 0.8 else f" <{tag}>{words}<br>"


def _prose(draw: random.Random) -> str:
    level = draw.randint(1, 2)
    out = [f"<h{level}>{_words(draw, 'c', 3, 10)}</h{level}>"] if draw.random() < 0.9 else []
    for _ in range(draw.randint(2, 12)):
        kind = draw.random()
        if kind < 0.65:
            middle = _inline(draw) if draw.random() < 0.4 else " "
            out.append(f"<p>{_words(draw, 'c', 5, 80)}{middle}{_words(draw, 'c', 1, 20)}" + ("</p>" if draw.random() < 0.8 else ""))
        elif kind < 0.8:
            tag = draw.choice(["ul", "ol"])
            out.append(f"<{tag}>" + "".join(f"<li>{_words(draw, 'c', 3, 25)}</li>" for _ in range(draw.randint(3, 8))) + f"</{tag}>")
        elif kind < 0.85:
            out.append(f"<blockquote><p>{_words(draw, 'c', 5, 30)}</p></blockquote>")
        elif kind < 0.9:
            out.append("<table>" + "".join(f"<tr><td>{_words(draw, 'c', 1, 5)}</td><td>{_words(draw, 'c', 1, 5)}</td></tr>" for _ in range(3)) + "</table>")
        else:
            level = draw.randint(2, 3)
            out.append(f"<h{level}>{_words(draw, 'c', 2, 6)}</h{level}>")
    return "".join(out)


def _other(draw: random.Random, kind: str) -> str:
    links = "".join(f'<li><a href="/y">{_words(draw, "b", 1, 3)}</a></li>' for _ in range(draw.randint(3, 9)))
    inner = {
        "menu": f"<ul>{links}</ul>",
        "side": f"<h3>{_words(draw, 'b', 1, 3)}</h3><ul>{links}</ul>",
        "notice": f"<p>{_words(draw, 'b', 5, 30)}</p><button>{_words(draw, 'b', 1, 2)}</button>",
        "advert": f"{_words(draw, 'b', 3, 20)}",
        "talk": "".join(f"<div><b>{_words(draw, 'b', 1, 2)}</b><p>{_words(draw, 'b', 3, 40)}</p></div>" for _ in range(draw.randint(1, 4))),
        "frame": f"{_words(draw, 'b', 3, 12)} <a href='/z'>{_words(draw, 'b', 1, 3)}</a>",
    }[kind]
    if kind == "frame" and draw.random() < 0.3:
        return f"<form><label>{_words(draw, 'b', 1, 3)}</label><select><option>{_words(draw, 'b', 1, 2)}</option></select><button>{_words(draw, 'b', 1, 2)}</button></form>"
    if draw.random() < 0.5:
        tag = {"menu": "nav", "side": "aside", "frame": draw.choice(["header", "footer"])}.get(kind)
        if tag:
            return f"<{tag}>{inner}</{tag}>"
    return f'<div {draw.choice(["class", "id"])}="{draw.choice(OTHER_NAMES[kind])}">{inner}</div>'


def labelled_pages(number: int = 1500, seed: int = 11):
    """Pages as strings; the same for the same arguments."""
    draw = random.Random(seed)
    for _ in range(number):
        prose = _prose(draw)
        if draw.random() < 0.2:  # something foreign in the middle
            cut = prose.find("</p>") + 4 if "</p>" in prose else len(prose)
            prose = prose[:cut] + _other(draw, draw.choice(["advert", "side", "notice"])) + prose[cut:]
        style = draw.random()
        if style < 0.35:
            prose = f"<article>{prose}</article>"
        elif style < 0.5:
            prose = f"<main>{prose}</main>"
        elif style < 0.85:
            prose = f'<div class="{draw.choice(CONTENT_NAMES)}">{prose}</div>'
        before = "".join(_other(draw, draw.choice(["menu", "frame", "notice", "advert"])) for _ in range(draw.randint(1, 3)))
        after = "".join(_other(draw, draw.choice(["side", "talk", "frame", "advert", "menu"])) for _ in range(draw.randint(1, 4)))
        yield f"<html><head><title>{_words(draw, 'b', 3, 8)}</title></head><body>{before}{prose}{after}</body></html>"
