"""Labelled pages for the extractor: written from templates of common site layouts by a seeded generator.

Each page is a list of (html, text, label) blocks inside wrappers; the label says whether the text is part
of the article. Nothing here comes from the tables that the extractor is applied to.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ren tas vel dor in che bra sul pen mar ti os gra fel nor wi eth".split()
_MENU = "Home News Sport Contact Search Archive Login Shop Weather Video Topics Jobs Forum Help About".split()
_ADVERTS = ["Buy now and save", "Special offer today only", "Sponsored: best prices", "Try it free for 30 days", "Limited deal, order now"]
_NOTICES = ["We use cookies to improve your visit.", "Accept all cookies", "By using this site you agree to our terms.", "This site works best with scripts enabled.", "Your subscription has expired."]
_FOOTS = ["© 2024 {}. All rights reserved.", "Terms of use", "Privacy policy", "{} · Imprint", "Contact us", "Copyright {}"]
_SIDES = ["Most read", "Related stories", "Trending now", "Read more: {}", "You may also like {}", "Newsletter", "Popular posts"]
_REMARKS = ["{} says: {}", "I don't agree. {}", "Great post! {}", "{} replied 2 hours ago", "3 comments", "Leave a reply", "Reply"]
_FORMS = ["Your e-mail", "Subscribe", "Name", "Password", "Sign in", "Send", "Search this site", "Leave a comment"]
_SHARES = ["Share on social media", "Tweet", "Tags: {}", "By {}", "Posted in {}", "Print this page", "3 min read"]

#: Names that sites give to the parts of a page.
NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu links pagination pager toc skip".split(),
    "header": "header masthead topbar banner site brand logo top head".split(),
    "footer": "footer foot bottom legal copyright colophon imprint".split(),
    "side": "sidebar aside related widget rail recommended trending popular more teaser side secondary complementary".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo banner adsense dfp commercial promotion".split(),
    "notice": "cookie notice consent gdpr alert popup modal overlay message warning banner announcement paywall".split(),
    "form": "form login search signup newsletter subscribe subscription contact".split(),
    "comment": "comments comment replies reply discussion respond disqus thread feedback reader".split(),
    "share": "share social tags meta byline author toolbar tools metadata".split(),
    "article": "article content post entry story body text main page single prose".split(),
}


class _Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 4)))

    def sentence(self, most: int = 18) -> str:
        words = [self.word() for _ in range(self.rng.randint(1, most))]
        return " ".join(words).capitalize() + self.rng.choice(["."] * 6 + ["", "!", "?", "…"])

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.choice([1, 1, 1, 2, 3, 5, 8])))

    def named(self, part: str) -> str:
        """An attribute that names the part, or none."""
        names = NAMES[part]
        k = self.rng.random()
        if k < 0.2:
            return ""
        value = self.rng.choice(names) + self.rng.choice(["", "", "-box", "-1", "_area", " wrap", "-" + self.rng.choice(names)])
        return f' {self.rng.choice(["class", "class", "class", "id", "role"])}="{value}"'

    def fill(self, text: str) -> str:
        return text.replace("{}", self.sentence(4).rstrip(".!?…"), 1).replace("{}", self.sentence(8), 1)

    def block(self, tag: str, text: str, label: int) -> list:
        opened = self.rng.random() < 0.08 and tag == "p"
        return [(f"<{tag}>{'<b>' if opened else ''}{text}{'<br>' if opened else f'</{tag}>'}", text, label)]

    def links(self, part: str, tag: str) -> list:
        k = self.rng.randint(2, 8)
        texts = [self.rng.choice([*_MENU, self.word(), self.word().capitalize(), self.sentence(3)]) for _ in range(k)]
        if self.rng.random() < 0.25:
            inner = [(f'<a href="/{i}">{t}</a> ', t, None) for i, t in enumerate(texts)]
            inner = [("".join(x[0] for x in inner), " ".join(texts), 0)]
        else:
            inner = [(f'<li><a href="/{i}">{t}</a></li>', t, 0) for i, t in enumerate(texts)]
            inner = [("<ul>", None, None), *inner, ("</ul>", None, None)]
        return self.wrap(tag, part, inner)

    def wrap(self, tag: str, part: str, inner: list, must: bool = False) -> list:
        name = self.named(part)
        while (must or tag in ("div", "section", "ul")) and not name:
            name = self.named(part)
        return [(f"<{tag}{name}>", None, None), *inner, (f"</{tag}>", None, None)]

    def part(self, part: str) -> list:
        rng = self.rng
        if part == "nav":
            return self.links("nav", rng.choice(["nav", "nav", "div"]))
        if part == "header":
            inner = self.block(rng.choice(["h1", "p", "div"]), self.sentence(4), 0)
            if rng.random() < 0.5:
                inner += self.part("nav")
            return self.wrap(rng.choice(["header", "header", "div"]), "header", inner)
        lists = {"footer": _FOOTS, "side": _SIDES, "advert": _ADVERTS, "notice": _NOTICES, "form": _FORMS, "comment": _REMARKS, "share": _SHARES}
        tags = {"footer": ["footer", "footer", "div"], "side": ["aside", "aside", "div"], "advert": ["div", "aside", "section"], "notice": ["div", "section", "dialog"], "form": ["form", "form", "div"], "comment": ["section", "div"], "share": ["div", "ul"]}
        tag, inner = rng.choice(tags[part]), []
        for _ in range(rng.randint(1, 4)):
            text = self.fill(rng.choice(lists[part])) if rng.random() < 0.55 else self.paragraph()
            kind = rng.choice({"form": ["label", "p", "button"], "comment": ["p", "div", "li", "h3"]}.get(part, ["p", "div", "li", "span", "h3"]))
            inner += self.block("li" if tag == "ul" else kind, text, 0)
            if kind in ("label", "button", "span") and tag != "ul":
                inner.append(("<hr>", None, None))
        if rng.random() < 0.5 and len(inner) == 1 and tag == "div":
            inner = [(inner[0][1], inner[0][1], 0)]
        return self.wrap(tag, part, inner)

    def article(self) -> list:
        rng = self.rng
        inner = self.block("h1", self.sentence(12), 1)
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            kind = rng.choices(["p", "h2", "li", "blockquote", "pre", "td"], [16, 2, 1, 1, 0.5, 0.5])[0]
            if kind == "li":
                inner += [("<ul>", None, None), *(b for _ in range(rng.randint(1, 4)) for b in self.block("li", self.sentence(8), 1)), ("</ul>", None, None)]
            elif kind == "td":
                inner += [("<table><tr>", None, None), *(b for _ in range(4) for b in self.block("td", self.sentence(3), 1)), ("</tr></table>", None, None)]
            else:
                text = self.sentence(8) if kind == "h2" else self.paragraph()
                inner += self.block(kind, text, 1)
            if rng.random() < 0.07:
                inner += self.part(rng.choice(["advert", "share", "side", "form"]))
        if rng.random() < 0.15:
            inner += self.part("comment")
        if rng.random() < 0.2:
            inner = [*self.part("share"), *inner]
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        out = self.wrap(tag, "article", inner)
        if rng.random() < 0.35:
            out = self.wrap(rng.choice(["main", "div"]), "article", out)
        return out

    def page(self) -> list:
        rng, before, after = self.rng, [], []
        for part, chance in (("notice", 0.3), ("header", 0.5), ("nav", 0.7), ("advert", 0.45), ("form", 0.2), ("side", 0.2)):
            if rng.random() < chance:
                before += self.part(part)
        for part, chance in (("share", 0.3), ("side", 0.35), ("advert", 0.3), ("comment", 0.35), ("form", 0.2), ("nav", 0.2), ("footer", 0.8), ("notice", 0.15)):
            if rng.random() < chance:
                after += self.part(part)
        return [*before, *self.article(), *after]


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(text, label), ...]) of n pages; label 1 is article."""
    out = []
    for i in range(n):
        parts = _Writer(seed * 100_003 + i).page()
        html = "<!DOCTYPE html><html><head><title>x</title><script>var a='</p>';</script></head><body>" + "".join(p[0] for p in parts) + "</body></html>"
        out.append((html, [(t, label) for _, t, label in parts if t is not None and label is not None]))
    return out
