"""Labelled pages to learn from: texts of the corpus set in layouts drawn at random."""

from __future__ import annotations

import html

import numpy as np

from covermart.llm.html_blocks import Block, blocks

#: Names that pages give to the parts of a layout.
CONTENT = ("content", "post", "entry", "article body", "story", "main", "text", "page content")
MENU = ("menu", "nav", "navbar", "navigation", "breadcrumb", "topnav", "links")
HEADER = ("header", "masthead", "site header", "branding", "top")
FOOTER = ("footer", "site footer", "bottom", "copyright", "legal")
SIDEBAR = ("sidebar", "widget", "related", "aside", "recommended", "trending", "tags")
NOTICE = ("notice", "cookie banner", "consent", "alert", "popup", "newsletter", "gdpr", "message")
ADVERT = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner ad")
COMMENTS = ("comments", "comment list", "discussion", "replies", "responses", "reader comments")
FORM = ("form", "search", "login", "subscribe", "signup", "contact")
#: Words for the short texts around an article.
CHROME = (
    "Home About Contact Login Search Menu News Sport Next Previous Share Print Reply Subscribe "
    "Accept Reject Privacy Terms Impressum Kontakt Suche Accueil Recherche Inicio Buscar Archive"
).split()
_SEMANTIC_OUT = frozenset("nav footer aside header form button label option dialog menu".split())


def guessed(page: str) -> list[tuple[Block, int]]:
    """Blocks of a page with labels from its semantic elements; empty if it has no article."""
    found = blocks(page)
    labels = []
    for block in found:
        path = set(block.path)
        inside = "article" in path or "main" in path
        named = any(f".{word}" in path for word in ("ad", "ads", "sidebar", "comments", "comment", "menu"))
        labels.append(int(inside and not named and not path & _SEMANTIC_OUT))
    return list(zip(found, labels, strict=True)) if any(labels) else []


def filler(draw: np.random.Generator, words: int) -> str:
    """Invented prose, for corpora that offer none."""
    letters = np.array(list("eeettaaoinshrdlucm"))
    made = ["".join(draw.choice(letters, draw.integers(1, 9))) for _ in range(words)]
    return " ".join(made).capitalize() + "."


class Layouts:
    """Random pages around paragraphs, with the label of every block."""

    def __init__(self, paragraphs: list[str], seed: int = 0):
        self.draw = np.random.default_rng(seed)
        self.paragraphs = paragraphs

    def page(self) -> list[tuple[Block, int]]:
        self.marks: list[int] = []
        body = "".join(self._around(self._article()))
        found = blocks(f"<html><head><title>x</title></head><body>{body}</body></html>")
        if len(found) != len(self.marks):
            return []
        return list(zip(found, self.marks, strict=True))

    def _some(self, *choices):
        return choices[self.draw.integers(len(choices))]

    def _chance(self, share: float) -> bool:
        return self.draw.random() < share

    def _prose(self) -> str:
        if self.paragraphs and self._chance(0.9):
            return self._some(*self.paragraphs) if len(self.paragraphs) < 50 else self.paragraphs[
                self.draw.integers(len(self.paragraphs))
            ]
        return filler(self.draw, int(self.draw.integers(3, 60)))

    def _short(self) -> str:
        if self._chance(0.5):
            return " ".join(self._some(*CHROME) for _ in range(self.draw.integers(1, 4)))
        return " ".join(self._prose().split()[: self.draw.integers(1, 10)]) or "x"

    def _leaf(self, tag: str, text: str, label: int, close: bool = True) -> str:
        self.marks.append(label)
        text = html.escape(text, quote=False)
        if label and self._chance(0.2):
            words = text.split(" ")
            at = self.draw.integers(len(words))
            words[at] = self._some("<a href='/x'>{}</a>", "<b>{}</b>", "<em>{}</em>").format(words[at])
            text = " ".join(words)
        return f"<{tag}>{text}</{tag}>" if close else f"<{tag}>{text}"

    def _box(self, tag: str, names: tuple[str, ...], inner: str) -> str:
        kind = self._some("class", "class", "id")
        named = f' {kind}="{self._some(*names)}"' if tag in ("div", "section", "ul") or self._chance(0.3) else ""
        return f"<{tag}{named}>{inner}</{tag}>"

    def _article(self):
        tag = self._some("article", "article", "main", "div", "section")
        marks, self.marks = self.marks, []
        inner = self._leaf(self._some("h1", "h1", "h2"), self._short(), 1) if self._chance(0.9) else ""
        for _ in range(self.draw.integers(0 if inner else 1, 12)):
            kind = self.draw.random()
            if kind < 0.7:
                inner += self._leaf("p", self._prose(), 1, close=self._chance(0.9))
            elif kind < 0.78:
                inner += self._leaf(self._some("h2", "h3"), self._short(), 1)
            elif kind < 0.86:
                rows = "".join(self._leaf("li", self._short(), 1) for _ in range(self.draw.integers(1, 5)))
                inner += f"<ul>{rows}</ul>"
            elif kind < 0.92:
                inner += self._leaf("blockquote", self._prose(), 1)
            elif kind < 0.96:
                inner += self._box("div", ADVERT + SIDEBAR, self._leaf("p", self._prose(), 0))
            else:
                inner += self._leaf("p", f"{self._prose()}", 1)
        own, self.marks = self.marks, marks
        return self._box(tag, CONTENT, inner), own

    def _links(self, label: int = 0) -> str:
        rows = [self._short() for _ in range(self.draw.integers(1, 8))]
        self.marks.extend([label] * len(rows))
        return "<ul>" + "".join(f'<li><a href="/{i}">{html.escape(x)}</a></li>' for i, x in enumerate(rows)) + "</ul>"

    def _around(self, article):
        before = (
            (0.8, lambda: self._box(self._some("nav", "nav", "div"), MENU, self._links())),
            (0.4, lambda: self._box(self._some("header", "div"), HEADER, self._leaf("p", self._short(), 0))),
            (0.4, lambda: self._box(self._some("div", "div", "aside"), NOTICE, self._leaf("p", self._prose(), 0))),
            (0.6, lambda: self._box("div", ADVERT, self._leaf(self._some("p", "span"), self._prose(), 0))),
            (0.3, lambda: self._box("form", FORM, self._leaf("label", self._short(), 0) + "<input>" + self._leaf("button", self._short(), 0))),
            (0.3, self._sidebar),
        )
        after = (
            (0.4, self._sidebar),
            (0.5, self._comments),
            (0.4, lambda: self._box("div", ADVERT, self._leaf("p", self._prose(), 0))),
            (0.3, lambda: self._box(self._some("form", "div"), FORM, self._leaf("label", self._short(), 0))),
            (0.2, lambda: self._box("div", NOTICE, self._leaf("p", self._prose(), 0))),
            (0.8, lambda: self._box(self._some("footer", "footer", "div"), FOOTER, self._leaf(self._some("p", "span"), "© " + self._prose(), 0))),
        )
        for share, part in before:
            if self._chance(share):
                yield part()
        body, marks = article
        self.marks.extend(marks)
        yield body
        for share, part in after:
            if self._chance(share):
                yield part()

    def _sidebar(self) -> str:
        inner = self._leaf("h3", self._short(), 0) + self._links()
        if self._chance(0.4):
            inner += self._leaf("p", self._prose(), 0)
        return self._box(self._some("aside", "div", "div"), SIDEBAR, inner)

    def _comments(self) -> str:
        inner = self._leaf(self._some("h2", "h3"), self._short(), 0)
        for _ in range(self.draw.integers(1, 5)):
            inner += '<div class="comment">' + self._leaf("span", self._short(), 0) + self._leaf("p", self._prose(), 0) + "</div>"
        return self._box(self._some("section", "div", "div"), COMMENTS, inner)
