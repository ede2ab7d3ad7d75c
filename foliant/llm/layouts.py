"""Pages of several layouts whose blocks are labelled, the small table that the block tree is trained on.

Every layout is a rule that writes a page from random words and says of each
block whether it is main text. Sizes vary so that no single measure tells.
"""

from __future__ import annotations

import random
from collections.abc import Callable

SYLLABLES = "ka lo mi ren ta sol ver din po ur an ges ti bra mon ".split()


class Page:
    """HTML that grows by blocks, with their texts and labels in order."""

    def __init__(self, rng: random.Random) -> None:
        self.rng, self.html, self.labelled = rng, [], []

    def words(self, n: int) -> str:
        return " ".join("".join(self.rng.choices(SYLLABLES, k=self.rng.randrange(1, 4))) for _ in range(n)).capitalize()

    def raw(self, html: str) -> None:
        self.html.append(html)

    def block(self, main: bool, low: int, high: int, tag: str = "p", attrs: str = "", links: float = 0.0) -> None:
        """A block of low to high words of which a share stands in a link."""
        n = self.rng.randint(low, high)
        k = min(n, round(n * links)) if links else 0
        plain, linked = self.words(n - k) if n > k else "", self.words(k) if k else ""
        self.labelled.append((f"{linked} {plain}".strip(), main))
        inner = (f'<a href="/x">{linked}</a> ' if k else "") + plain
        self.raw(f"<{tag}{' ' + attrs if attrs else ''}>{inner}</{tag}>")

    def menu(self, n: int, tag: str = "li") -> None:
        for _ in range(n):
            self.block(False, 1, 3, tag, links=1.0)

    def form(self) -> None:
        """Half the time, a small form of one or two blocks."""
        if self.rng.random() < 0.5:
            self.raw("<form>")
            for _ in range(self.rng.randint(1, 2)):
                self.block(False, 1, 12)
            self.raw("</form>")

    def story(self, n: int) -> None:
        """Paragraphs of an article, a few of them very short."""
        for _ in range(n):
            if self.rng.random() < 0.25:
                self.block(True, 1, 12)
            else:
                self.block(True, 15, 140, links=self.rng.choice([0.0, 0.0, 0.1, 0.3]))


def _news(p: Page) -> None:
    p.raw("<nav><ul>")
    p.menu(p.rng.randint(3, 8))
    p.raw("</ul></nav>")
    p.block(False, 3, 20, "div", 'class="ad"')
    p.raw("<article>")
    p.block(True, 2, 14, "h1")
    p.story(p.rng.randint(2, 9))
    p.raw("</article>")
    p.form()
    if p.rng.random() < 0.5:
        p.block(False, 3, 25, "footer")


def _wrapped(p: Page) -> None:
    p.raw('<div class="content has-sidebar"><header>')
    p.block(False, 1, 6, "div")
    p.raw("</header><article>")
    p.block(True, 2, 12, "h1")
    p.story(p.rng.randint(3, 7))
    p.raw('</article></div><aside class="sidebar">')
    p.block(False, 1, 4, "h3")
    p.menu(p.rng.randint(2, 6))
    p.block(False, 15, 60)
    p.raw("</aside>")
    if p.rng.random() < 0.5:
        p.block(False, 4, 12, "div", 'class="footer"')


def _divs(p: Page) -> None:
    p.raw("<div>")
    p.menu(p.rng.randint(3, 7), "div")
    p.raw("</div><div>")
    p.block(True, 2, 10, "h1")
    p.story(p.rng.randint(4, 9))
    p.raw("</div><div>")
    p.menu(p.rng.randint(2, 5), "div")
    p.raw("</div>")
    p.block(False, 3, 9, "div")


def _table(p: Page) -> None:
    p.raw("<table><tr><td>")
    p.menu(p.rng.randint(4, 8), "div")
    p.raw("</td><td>")
    p.block(True, 3, 9, "h2")
    p.story(p.rng.randint(4, 8))
    p.raw("</td></tr><tr><td>")
    p.block(False, 2, 8, "div", links=0.6)
    p.raw("</td></tr></table>")


def _cards(p: Page) -> None:
    p.raw("<main>")
    p.block(True, 2, 12, "h1")
    p.story(p.rng.randint(3, 7))
    p.raw('</main><div class="related">')
    for _ in range(p.rng.randint(2, 5)):
        p.raw("<article>")
        p.block(False, 3, 9, "h3", links=1.0)
        p.block(False, 8, 26)
        p.raw("</article>")
    p.raw("</div>")


def _comments(p: Page) -> None:
    p.raw('<article><h1></h1>')
    p.block(True, 3, 9, "h1")
    p.story(p.rng.randint(3, 8))
    p.raw('</article><section class="comments">')
    p.block(False, 1, 4, "h3")
    for _ in range(p.rng.randint(2, 8)):
        p.raw(p.rng.choice(["<article>", "<div>"]))
        p.block(False, 1, 3, "div", 'class="comment-author"', links=p.rng.choice([0.0, 1.0]))
        p.block(False, 3, 90)
        p.raw("</article></div>")
    p.raw("</section>")


def _notices(p: Page) -> None:
    p.block(False, 15, 50, "div", 'class="cookie-consent"', links=0.1)
    p.raw("<div>")
    p.menu(p.rng.randint(2, 5), "span class=x><div")
    p.raw('</div><div id="content">')
    p.block(True, 2, 10, "h1")
    p.story(p.rng.randint(4, 8))
    p.raw('</div><div class="newsletter">')
    p.block(False, 6, 30)
    p.raw("<form>")
    p.block(False, 1, 4, "button")
    p.raw("</form></div>")
    p.block(False, 8, 40, "div", 'class="notice"')


def _inner(p: Page) -> None:
    p.raw("<article>")
    p.block(True, 2, 12, "h1")
    p.story(2)
    p.block(False, 4, 40, "div", 'class="advert"')
    p.story(2)
    p.raw('<div class="share">')
    p.menu(3, "span class=y><div")
    p.raw("</div><ul>")
    for _ in range(p.rng.randint(2, 5)):
        p.block(True, 2, 15, "li", links=p.rng.choice([0.0, 0.0, 1.0]))
    p.raw("</ul>")
    p.block(True, 4, 14, "figcaption")
    p.raw("<aside>")
    p.block(False, 8, 40)
    p.raw("</aside>")
    p.story(2)
    p.block(False, 5, 30, "div", 'class="notice"')
    p.raw("</article>")


def _named_main(p: Page) -> None:
    p.raw("<ul>")
    p.menu(p.rng.randint(3, 6))
    p.raw(f'</ul><section class="{p.rng.choice(["legal", "search", "notice", "related", "share"])}">')
    p.block(True, 3, 10, "h1")
    for _ in range(p.rng.randint(4, 8)):
        p.block(True, 35, 150)
    p.raw("</section>")
    p.block(False, 3, 9, "div", 'class="copyright"')


def _page_form(p: Page) -> None:
    p.raw('<form id="page"><div>')
    p.menu(p.rng.randint(3, 6), "div")
    p.raw("</div>")
    p.block(True, 3, 9, "h1")
    for _ in range(p.rng.randint(4, 8)):
        p.block(True, 30, 140)
    if p.rng.random() < 0.5:
        p.block(False, 1, 8, "div", 'class="toolbar"')
    p.block(False, 1, 3, "button")
    p.raw("</form>")


def _short(p: Page) -> None:
    p.raw("<nav>")
    p.menu(p.rng.randint(2, 5), "div")
    p.raw("</nav>")
    p.block(False, 4, 14, "div", 'class="ad"')
    p.raw("<article>")
    p.block(True, 1, 12, "h1")
    for _ in range(p.rng.randint(1, 4)):
        p.block(True, 1, 12, links=p.rng.choice([0.0, 0.0, 0.5]))
    p.raw("</article>")
    p.form()
    if p.rng.random() < 0.5:
        p.block(False, 3, 14, "footer")


def _bare(p: Page) -> None:
    if p.rng.random() < 0.5:
        p.block(True, 2, 10, "h1")
    p.story(p.rng.randint(1, 6))
    p.block(True, 10, 80)


def _ending(p: Page) -> None:
    """An article that ends the page with short blocks."""
    p.raw(f"<{p.rng.choice(['article', 'main'])}>")
    p.block(True, 1, 12, "h1")
    for _ in range(p.rng.randint(0, 3)):
        p.block(True, 1, p.rng.choice([12, 140, 2000]))
    for _ in range(p.rng.randint(0, 2)):
        p.block(True, 1, 8)
    p.block(True, 1, p.rng.choice([4, 12, 30]), links=p.rng.choice([0.0, 0.0, 0.2]))


LAYOUTS: list[Callable[[Page], None]] = [_news, _wrapped, _divs, _table, _cards, _comments, _notices, _inner, _named_main, _page_form, _short, _bare, _ending]


def pages(seed: int, each: int, layouts: list[Callable[[Page], None]] = LAYOUTS) -> list[tuple[str, list[tuple[str, bool]]]]:
    """(html, labelled blocks) of so many pages of each layout; the same for the same seed."""
    out = []
    for layout in layouts:
        for k in range(each):
            page = Page(random.Random(f"{seed} {layout.__name__} {k}"))
            layout(page)
            out.append((f"<html><body>{''.join(page.html)}</body></html>", page.labelled))
    return out
