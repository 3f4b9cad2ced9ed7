"""Labelled pages to train a block labeller on: layouts drawn from a stated vocabulary, texts from given words.

Every text of a page is marked as main text or not by a private character at its start;
``labelled`` reads the page as any other and takes the marks off. A layout is semantic tags,
classes, both, or neither; names of classes are drawn per page, so that no single name
decides, and some pages have invented names or none.
"""

from __future__ import annotations

import random

from terraquarry.llm.blocks import Block, read

MAIN, OTHER = "\ue000", "\ue001"

# Tags and names by the role of a part of a page.
TAGS = {
    "main": ("main", "article", "div", "section"), "nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div", "section"),
    "notice": ("div", "section", "aside"), "ad": ("div", "aside", "section", "ins"), "form": ("form", "div"), "comments": ("section", "div", "ol"), "share": ("div", "ul"),
}
NAMES = {
    "main": "content main post article entry story body text page-content article-body post-content main-content entry-content story-body articleText prose",
    "nav": "nav menu navbar navigation main-menu top-nav breadcrumb breadcrumbs tabs pagination pager site-nav toc links menu-bar skip-link",
    "header": "header masthead top site-header branding logo page-header topbar head",
    "footer": "footer site-footer bottom copyright colophon legal foot footer-links imprint credits",
    "side": "sidebar side aside rail widget related recommended popular trending more-stories latest read-next related-posts secondary column tag-cloud archive author-bio",
    "notice": "cookie consent gdpr notice alert popup modal newsletter subscribe paywall cookie-banner overlay message banner-notice disclaimer toast announcement warning",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner ad-slot adsbox commercial dfp adunit promotion affiliate",
    "form": "form search login signup search-form contact-form subscribe-form poll register",
    "comments": "comments comment replies discussion responses comment-list disqus reader-comments commentlist feedback user-comments reviews",
    "share": "share social sharing share-buttons social-links follow tools print",
}
PHRASES = {
    "nav": "Home|About us|Contact|Next|Previous|Back to top|Sign in|Products|Services|Blog|News|Accueil|Startseite|Über uns|Kontakt|Inicio|Contacto|Menu|Skip to content|Archive|FAQ|RSS|Politics|Sport",
    "header": "Welcome to our site|The daily news|Subscribe today|Log in|Your account|Bienvenue|Willkommen",
    "footer": "© 2024 All rights reserved.|Privacy policy|Terms of use|Imprint|Contact us|Powered by Press|Tous droits réservés|Alle Rechte vorbehalten|Impressum|Aviso legal|Sitemap",
    "side": "Related articles|Most read|Recent posts|Popular|You may also like|Read more|Trending now|Categories|Tags|À lire aussi|Mehr zum Thema|Lo más leído|About the author",
    "notice": "We use cookies to improve your experience.|Accept all|Reject|This site uses cookies.|Please enable JavaScript.|Nous utilisons des cookies.|Wir verwenden Cookies.|Subscribe to continue reading.|Breaking news alert",
    "ad": "Advertisement|Sponsored|Buy now and save 50%|Special offer|Limited time offer: order today!|Anzeige|Publicité|Publicidad|Click here|Free shipping",
    "form": "Search|Submit|Your email address|Name|Password|Send|Suchen|Rechercher|Buscar|Leave a message|Required fields are marked *|Sign up for our newsletter",
    "comments": "Reply|3 comments|Leave a comment|Great article, thanks!|I disagree with this.|says:|Posted by anonymous|Like|Report|Kommentare|Commentaires|2 hours ago|First!",
    "share": "Share|Tweet|Share on Facebook|Print|Email this|Teilen|Partager|Follow us|Copy link|Pin it",
}
#: Words for texts where a table gives none.
WORDS = "the of and to in a is that for it was on are as with at by this from or an be have not they which one all were when we there can said what".split()


class Layout:
    """One page: its style, its names, its words."""

    def __init__(self, rng: random.Random, words: list[str]):
        self.rng, self.words = rng, words or WORDS
        self.style = rng.choices(("semantic", "named", "both", "invented", "bare"), (4, 4, 4, 1, 1))[0]
        self.names = {role: rng.sample(names.split(), min(3, len(names.split()))) for role, names in NAMES.items()}
        self.shout = rng.random() < 0.08  # upper-case tags
        self.manner = rng.choices(("plain", "upper", "marks", "stuck"), (12, 1, 1, 1))[0]

    # texts

    def some(self, low: int, high: int) -> str:
        text = self.rng.choices(self.words, k=self.rng.randint(low, high))
        if self.manner == "marks":
            text = [w + self.rng.choice(("", "###", "!!", "***", "&&", "$$$")) for w in text]
        elif self.manner == "stuck":
            text = text[: self.rng.randint(1, 2)] * self.rng.randint(1, 12)
        return " ".join(text).upper() if self.manner == "upper" else " ".join(text)

    def sentence(self, low: int = 3, high: int = 18) -> str:
        text = self.some(low, high)
        return text[:1].upper() + text[1:] + self.rng.choice(("." * 6 + "!?:"))

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.choice((1, 1, 2, 3, 4, 6, 9))))

    def other(self, role: str, prose: float = 0.35) -> str:
        """A text of a part that is not main text: a stock phrase, a few words, or prose like any."""
        draw = self.rng.random()
        if draw < prose:
            return OTHER + (self.paragraph() if draw < prose / 3 else self.sentence())
        return OTHER + (self.rng.choice(PHRASES[role].split("|")) if draw < prose + 0.35 else self.some(1, 4))

    # tags

    def tag(self, name: str, inside: str, attributes: str = "", close: bool = True) -> str:
        name = name.upper() if self.shout else name
        return f"<{name}{attributes}>{inside}" + (f"</{name}>" if close else "")

    def part(self, role: str, inside: str, deep: bool = False) -> str:
        """The element of a role around ``inside``."""
        rng = self.rng
        name, attributes = "div", ""
        if self.style in ("semantic", "both"):
            name = TAGS[role][0]
        elif self.style == "named":
            name = rng.choice(TAGS[role][1:])
        if deep and name in ("main", "ul", "ol"):
            name = "div"
        if self.style in ("named", "both") or (self.style == "semantic" and role in ("ad", "notice", "comments", "share", "form", "side")):
            kind = rng.choice(("class", "class", "id"))
            own = rng.choice(self.names[role])
            attributes = f' {kind}="{own}"' if rng.random() < 0.7 else f' {kind}="{own} {rng.choice(("c1", "wrap", "block", "inner", "row", "clearfix", "x-" + str(rng.randrange(99))))}"'
        elif self.style == "invented":
            attributes = f' class="css-{rng.randrange(16**5):05x}"'
        if role == "notice" and rng.random() < 0.2:
            attributes += rng.choice((" hidden", ' style="display:none"', ' role="dialog"', ' role="alert"'))
        if name in ("ul", "ol") and "<li" not in inside:
            inside = self.tag("li", inside)
        return self.tag(name, inside, attributes)

    def links(self, role: str, count: int) -> str:
        rng = self.rng
        items = [self.tag("a", self.other(role, 0.05), f' href="/{rng.randrange(999)}"') for _ in range(count)]
        return self.tag("ul", "".join(self.tag("li", i, close=rng.random() < 0.8) for i in items)) if rng.random() < 0.7 else rng.choice((" ", " | ", "<br>")).join(items)

    # parts

    def nav(self) -> str:
        return self.part("nav", self.links("nav", self.rng.randint(2, 8)))

    def header(self) -> str:
        inside = self.tag(self.rng.choice(("h1", "div", "p", "a")), self.other("header", 0.2))
        return self.part("header", inside + (self.nav() if self.rng.random() < 0.5 else "") + (self.form() if self.rng.random() < 0.2 else ""))

    def footer(self) -> str:
        rng = self.rng
        inside = "".join(rng.choice((lambda: self.tag("p", self.other("footer")), lambda: self.links("footer", rng.randint(2, 6)), lambda: self.other("footer") + "<br>"))() for _ in range(rng.randint(1, 4)))
        return self.part("footer", inside)

    def side(self) -> str:
        rng = self.rng
        out = [self.tag(rng.choice(("h3", "h4", "div", "h2")), self.other("side", 0.1)), self.links("side", rng.randint(2, 6)) if rng.random() < 0.7 else ""]
        out += [self.tag("p", self.other("side", 0.7)) for _ in range(rng.choice((0, 0, 1, 2, 3)))]
        return self.part("side", "".join(out))

    def box(self, role: str) -> str:
        rng = self.rng
        if rng.random() < 0.3:
            return self.part(role, self.other(role, 0.6))
        return self.part(role, "".join(self.tag(rng.choice(("p", "div", "span", "h3", "a")), self.other(role, 0.5)) for _ in range(rng.randint(1, 3))))

    def form(self) -> str:
        rng = self.rng
        fields = "".join(rng.choice((lambda: self.tag("label", self.other("form", 0.1)) + "<input>", lambda: self.tag("p", self.other("form", 0.3)), lambda: self.tag("button", OTHER + "Send")))() for _ in range(rng.randint(1, 4)))
        return self.tag("form", fields, ' action="/s"') if rng.random() < 0.7 else self.part("form", fields)

    def comments(self) -> str:
        rng = self.rng
        out = [self.tag(rng.choice(("h2", "h3", "div")), self.other("comments", 0.05))]
        for _ in range(rng.randint(1, 6)):
            own = self.tag(rng.choice(("b", "span", "div", "cite", "h4")), OTHER + self.some(1, 2)) + self.tag(rng.choice(("p", "div")), self.other("comments", 0.85))
            out.append(self.tag(rng.choice(("div", "li", "article")), own + self.other("comments", 0.0) * (rng.random() < 0.3), f' class="{rng.choice(("comment", "reply", "item", "c"))}"' if self.style in ("named", "both") else ""))
        return self.part("comments", "".join(out) + (self.form() if rng.random() < 0.3 else ""))

    def body(self) -> str:
        """The main text, with what is strewn into it."""
        rng, out = self.rng, []
        if rng.random() < 0.85:
            title = self.tag(rng.choice(("h1", "h1", "h1", "h2")), MAIN + self.some(1, 14))
            out.append(self.tag("header", title) if self.style in ("semantic", "both") and rng.random() < 0.15 else title)
        plain = rng.choice(("p", "p", "p", "p", "div"))
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 6, 8, 12, 20, 40))):
            if rng.random() < 0.05:  # a line over and over
                line = MAIN + rng.choice((self.sentence, lambda: self.some(1, 3), self.paragraph))()
                out += [self.tag(plain, line)] * rng.choice((2, 3, 8, 20, 50))
                continue
            draw = rng.random()
            if draw < 0.66:
                text = self.paragraph()
                if rng.random() < 0.2:
                    cut = text.split(" ", 1)
                    text = f'{cut[0]} <a href="/x">{cut[-1]}</a>' if rng.random() < 0.3 else f"{cut[0]} <em>{cut[-1]}</em>"
                if rng.random() < 0.12:
                    out.append(f"<p><b>{MAIN}{text}<br>")
                else:
                    out.append(self.tag(plain, MAIN + text, close=rng.random() < 0.9))
            elif draw < 0.74:
                out.append(self.tag(rng.choice(("h2", "h3", "h4")), MAIN + self.some(1, 8)))
            elif draw < 0.80:
                out.append(self.tag(rng.choice(("ul", "ol")), "".join(self.tag("li", MAIN + rng.choice((self.some(1, 5), self.sentence()))) for _ in range(rng.randint(1, 6)))))
            elif draw < 0.85:
                out.append(self.tag("blockquote", self.tag("p", MAIN + self.paragraph())))
            elif draw < 0.88:
                rows = "".join(self.tag("tr", "".join(self.tag("td", MAIN + self.some(1, 3)) for _ in range(3))) for _ in range(rng.randint(1, 4)))
                out.append(self.tag("table", rows))
            elif draw < 0.91:
                out.append(self.tag("figure", "<img src=x>" + self.tag("figcaption", MAIN + self.sentence())))
            elif draw < 0.93:
                out.append(self.tag("pre", MAIN + self.some(2, 20)))
            elif self.style in ("semantic", "named", "both"):
                out.append(rng.choice((lambda: self.box("ad"), lambda: self.side(), lambda: self.box("notice"), lambda: self.form(), lambda: self.part("share", self.links("share", 3)))))
                out[-1] = out[-1]()
        return "".join(out)

    def main(self) -> str:
        rng, inside = self.rng, self.body()
        if self.style != "bare" and rng.random() < 0.3:
            inside = self.part("main", inside, deep=True)
        if self.style in ("semantic", "both") and rng.random() < 0.8:
            inside = self.tag("article", inside)
        else:
            inside = self.part("main", inside)
        if self.style in ("semantic", "both", "named") and rng.random() < 0.3:
            inside = self.part("main", inside + (self.comments() if rng.random() < 0.3 else "") + (self.side() if rng.random() < 0.2 else ""))
        return inside

    def page(self) -> str:
        rng = self.rng
        if rng.random() < 0.06:  # a text with little or no markup
            return rng.choice(("<html><body>{}</body></html>", "{}", "<div>{}</div>")).format("".join(self.tag("p", MAIN + self.paragraph()) for _ in range(rng.randint(1, 5))) if rng.random() < 0.7 else MAIN + self.paragraph())
        few = lambda p, make: make() if rng.random() < p else ""
        top = [few(0.25, lambda: self.box("notice")), few(0.6, self.header), few(0.7, self.nav), few(0.15, self.form), few(0.4, lambda: self.box("ad")), few(0.1, self.side)]
        if rng.random() < 0.2:
            rng.shuffle(top)
        low = [few(0.15, lambda: self.part("share", self.links("share", rng.randint(2, 5)))), few(0.3, self.comments), few(0.4, self.side), few(0.2, lambda: self.box("ad")), few(0.1, self.form), few(0.8, self.footer), few(0.1, lambda: self.box("notice"))]
        if rng.random() < 0.2:
            rng.shuffle(low)
        inside = "".join(top) + (self.main() if rng.random() < 0.97 else "") + "".join(low)
        if rng.random() < 0.25:
            inside = self.tag("div", inside, f' class="{rng.choice(("wrapper", "container", "page", "site", "outer", "grid"))}"')
        if rng.random() < 0.04:
            inside = self.tag("form", inside, ' id="aspnetForm"')
        return f"<!DOCTYPE html><html><head><title>{self.some(1, 5)}</title></head><body>{inside}</body></html>"


def labelled(page: str) -> tuple[list[Block], list[bool]]:
    """A marked page's blocks without marks, and whether each is main text; unmarked ones are as the one before."""
    blocks, labels = read(page), []
    for block in blocks:
        first = next((c for c in block.text if c in (MAIN, OTHER)), None)
        labels.append(first == MAIN if first else bool(labels and labels[-1]))
        block.text = block.text.replace(MAIN, "").replace(OTHER, "")
    return blocks, labels


def pages(count: int, words: list[str], seed: int = 11) -> list[tuple[list[Block], list[bool]]]:
    """``count`` labelled pages, the same for the same words and seed."""
    rng = random.Random(seed)
    drawn = (labelled(Layout(rng, words).page()) for _ in range(count))
    return [p for p in drawn if p[0]]
