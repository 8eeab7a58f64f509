"""Pages with known main text, made up to train the block labeller on: layouts of many kinds."""

from __future__ import annotations

import random

SYLLABLES = ("an", "be", "ci", "do", "er", "fa", "go", "he", "in", "ju", "ka", "lo", "mi", "no", "os", "pre", "qua",
             "ri", "sch", "ti", "un", "ver", "wo", "ung", "ción", "é", "ä")
#: Kinds of block that are not main text: element, names used in class or id, and typical words.
OTHER = {
    "menu": (("nav", "ul", "div"), ("nav", "menu", "navbar", "navigation", "breadcrumb", "topnav", "toc", "tabs"),
             ("Home", "About", "Contact", "Products", "Blog", "News", "Start", "Login", "More")),
    "header": (("header", "div"), ("header", "masthead", "site-header", "topbar", "banner", "logo", "branding"),
               ("Welcome", "Daily", "Online", "The", "News", "Portal")),
    "footer": (("footer", "div"), ("footer", "site-footer", "bottom", "copyright", "legal", "imprint"),
               ("©", "Copyright", "All rights reserved", "Privacy", "Terms", "Imprint", "2024")),
    "sidebar": (("aside", "div", "section"), ("sidebar", "aside", "related", "widget", "recommended", "popular",
                                              "trending", "secondary", "share", "social", "tags"),
                ("Related", "Popular", "Read more", "Most read", "See also", "Share", "Follow us", "Tags")),
    "notice": (("div", "section"), ("cookie", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "modal",
                                    "newsletter", "paywall", "message"),
               ("We use cookies", "Accept", "Privacy", "Subscribe", "Notice", "Your browser", "Sign up")),
    "advert": (("div", "aside", "section"), ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsor",
                                                    "sponsored", "promo", "banner-ad", "adsbygoogle"),
               ("Advertisement", "Sponsored", "Buy now", "Offer", "Sale", "Click here")),
    "form": (("form", "div"), ("form", "search", "login", "signup", "subscribe", "contact-form", "search-form"),
             ("Email", "Password", "Send", "Search", "Name", "Submit", "Your message")),
    "comments": (("div", "section", "ol", "aside"), ("comments", "comment", "comment-list", "replies", "disqus", "responses",
                                                     "discussion", "reader-comments"),
                 ("Reply", "says", "wrote", "Great post", "Comments", "Anonymous", "1 hour ago")),
}
MAIN = (("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post"),
        ("div", "entry-content"), ("div", "main"), ("section", "story"), ("div", "text"), ("article", "entry"),
        ("main", "content"), ("div", "page"))


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def _sentence(rng: random.Random) -> str:
    return _words(rng, rng.randint(1, 28)).capitalize() + rng.choice(".....!?")


def _open(rng: random.Random, tag: str, name: str) -> str:
    extra = rng.choice(("", "", f" c{rng.randint(0, 99)}", f" {_words(rng, 1)}"))
    return f"<{tag} {rng.choice(('class', 'id'))}=\"{name}{extra}\">" if name else f"<{tag}>"


def _other(rng: random.Random, kind: str, out: list) -> None:
    tags, names, words = OTHER[kind]
    tag = rng.choice(tags)
    name = rng.choice(names) if tag in ("div", "section", "ul", "ol") or rng.random() < 0.5 else ""
    out.append((_open(rng, tag, name), None))
    text = lambda: (_sentence(rng) if rng.random() < 0.5 else rng.choice(words) + rng.choice(("", " " + _words(rng, 2))))
    if kind == "menu" or rng.random() < 0.3:
        out.append(("" if tag in ("ul", "ol") else "<ul>", None))
        for _ in range(rng.randint(1, 8)):
            out += [(f'<li><a href="/{_words(rng, 1)}">', None), (text(), 0), ("</a></li>", None)]
        out.append(("" if tag in ("ul", "ol") else "</ul>", None))
    elif kind == "form":
        out += [("<label>", None), (text(), 0), ('</label><input name="q"><button>', None), (text(), 0), ("</button>", None)]
    elif kind == "comments":
        for _ in range(rng.randint(1, 6)):
            inner = rng.choice(("div", "li", "article", "p"))
            out += [(_open(rng, inner, rng.choice(("comment", "reply", ""))), None), (_sentence(rng) + " " + _sentence(rng), 0),
                    (f"</{inner}>", None)]
    else:
        for _ in range(rng.randint(1, 3)):
            inner = rng.choice(("", "p", "div", "span", "h3"))
            out += [(f"<{inner}>" if inner else "", None), (text(), 0), (f"</{inner}>" if inner else "", None)]
    out.append((f"</{tag}>", None))


def _article(rng: random.Random, out: list) -> None:
    tag, name = rng.choice(MAIN)
    out.append((_open(rng, tag, name), None))
    nested = rng.random() < 0.25
    if nested:
        out.append((_open(rng, "div", rng.choice(("", "content", "body", "text"))), None))
    if rng.random() < 0.8:
        out += [("<h1>", None), (_words(rng, rng.randint(1, 12)), 1), ("</h1>", None)]
    for _ in range(max(1, int(rng.lognormvariate(1.6, 0.9)))):
        if rng.random() < 0.06:
            _other(rng, rng.choice(("advert", "sidebar", "notice", "form")), out)
        kind = rng.choices(("p", "h2", "h3", "li", "blockquote", "pre", "td"), (16, 2, 1, 2, 1, 0.5, 0.5))[0]
        text = " ".join(_sentence(rng) for _ in range(rng.randint(1, 7))) if kind in ("p", "blockquote", "pre") else _words(rng, 5)
        if kind == "li":
            out += [("<ul>", None)] + [x for _ in range(rng.randint(1, 4))
                                       for x in (("<li>", None), (_sentence(rng), 1), ("</li>", None))] + [("</ul>", None)]
        elif kind == "td":
            out += [("<table><tr><td>", None), (text, 1), ("</td><td>", None), (_words(rng, 2), 1), ("</td></tr></table>", None)]
        elif rng.random() < 0.15:
            out += [(f"<{kind}><b>", None), (text, 1), ("<br>", None)]  # left open
        else:
            out += [(f"<{kind}>", None), (text, 1), (f"</{kind}>", None)]
    if rng.random() < 0.15:
        _other(rng, rng.choice(("comments", "sidebar")), out)
    if nested:
        out.append(("</div>", None))
    out.append((f"</{tag}>", None))


def training_page(rng: random.Random) -> tuple[str, list[tuple[str, int]]]:
    """The html of a page, and its texts in order, each with 1 for main text."""
    out: list[tuple[str, int | None]] = []
    for kind in ("notice", "header", "menu", "advert", "form"):
        if rng.random() < 0.45:
            _other(rng, kind, out)
    wrapped = rng.random() < 0.4
    if wrapped:
        out.append((_open(rng, "div", rng.choice(("wrapper", "container", "page", "site", "row"))), None))
    if rng.random() < 0.3:
        _other(rng, rng.choice(("sidebar", "advert", "menu")), out)
    if rng.random() < 0.97:
        _article(rng, out)
    for kind, share in (("comments", 0.35), ("sidebar", 0.4), ("advert", 0.35), ("form", 0.2), ("notice", 0.15)):
        if rng.random() < share:
            _other(rng, kind, out)
    if wrapped:
        out.append(("</div>", None))
    if rng.random() < 0.7:
        _other(rng, rng.choice(("footer", "footer", "notice")), out)
    head = "<html><head><title>x</title><script>var a='<p>';</script></head><body>"
    texts = [(t, label) for t, label in out if label is not None]
    return head + "".join(t for t, _ in out) + rng.choice(("</body></html>", "")), texts
