"""Labelled pages from which the block classifier of html_extract is fitted.

The pages are written by rule from a seed, in layouts that are common on the web: with
landmark elements, with named divisions, with tables, and without any hint but the text.
Content is spelled with the letters a to m alone and everything else with n to z, so a
block's label can be read off its text, while no feature looks at a word's letters.
"""

from __future__ import annotations

import random

CONTENT, OTHER = "abcdefghijklm", "nopqrstuvwxyz"
LAYOUTS = 6


def is_content(text: str) -> bool:
    """The label of a block of a fixture page."""
    letters = [c for c in text.lower() if "a" <= c <= "z"]
    return sum(c in CONTENT for c in letters) * 2 > len(letters)


class _Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, n: int, letters: str) -> str:
        return " ".join("".join(self.rng.choice(letters) for _ in range(self.rng.randint(2, 9))) for _ in range(n))

    def prose(self, n: int, letters: str) -> str:
        """About n words in sentences with commas."""
        said = []
        while n > 0:
            k = min(n, self.rng.randint(4, 16))
            s = self.words(k, letters)
            if k > 8 and self.rng.random() < 0.6:
                s = s.replace(" ", ", ", 1)
            said.append(s[0].upper() + s[1:] + self.rng.choice("....?!"))
            n -= k
        return " ".join(said)

    def link(self, letters: str, most: int = 3) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{self.words(self.rng.randint(1, most), letters)}</a>'

    def menu(self) -> str:
        return "<ul>" + "".join(f"<li>{self.link(OTHER)}</li>" for _ in range(self.rng.randint(3, 9))) + "</ul>"

    def teasers(self) -> str:
        return "".join(f"<div>{self.link(OTHER, 7)} {self.words(self.rng.randint(0, 4), OTHER)}</div>" for _ in range(self.rng.randint(2, 6)))

    def advert(self) -> str:
        said = self.prose(self.rng.randint(3, 9), OTHER)
        return self.rng.choice((f"<div>{said}</div>", f"<p>{said}</p>", f"<p>{self.words(3, OTHER)} {self.link(OTHER, 4)}</p>", f"<div>{self.link(OTHER, 6)}</div>", f"<span>{self.words(3, OTHER)}</span>"))

    def foot(self) -> str:
        return f"<div>&copy; 20{self.rng.randint(10, 26)} {self.words(3, OTHER)} &middot; {self.link(OTHER)} | {self.link(OTHER)}</div>"

    def paragraph(self) -> str:
        n = self.rng.choice((1, 3, 8, 20, 40, 60, 80, 120))
        text = self.prose(n, CONTENT)
        if self.rng.random() < 0.25:
            text += " " + self.link(CONTENT) + " " + self.prose(self.rng.randint(3, 12), CONTENT)
        return f"<p>{text}</p>"

    def article(self, tag: str = "p") -> str:
        parts = [f"<h1>{self.words(self.rng.randint(2, 9), CONTENT)}</h1>"]
        for _ in range(self.rng.randint(2, 9)):
            kind = self.rng.random()
            if kind < 0.72:
                parts.append(self.paragraph().replace("<p>", f"<{tag}>").replace("</p>", f"</{tag}>"))
            elif kind < 0.82:
                parts.append(f"<h2>{self.words(self.rng.randint(1, 6), CONTENT)}</h2>" + self.paragraph())
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{self.prose(self.rng.randint(2, 20), CONTENT)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.95:
                parts.append(f"<blockquote>{self.prose(30, CONTENT)}</blockquote>")
            else:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(2, CONTENT)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
        return "".join(parts)

    def page(self, layout: int) -> str:
        body = self.article("div" if layout == 5 else "p")
        if layout == 0:
            page = f"<nav>{self.menu()}</nav><div class=ad>{self.advert()}</div><article>{body}</article><footer>{self.foot()}</footer>"
        elif layout == 1:
            notes = "".join(f"<div class=comment><p>{self.prose(self.rng.randint(3, 60), OTHER)}</p></div>" for _ in range(3))
            page = f"<header>{self.link(OTHER)}{self.menu()}</header><div id=content>{body}</div><div id=sidebar>{self.teasers()}</div><div id=comments>{notes}</div>{self.foot()}"
        elif layout == 2:
            page = f"<div>{self.menu()}</div><div>{body}</div><div>{self.advert()}</div><div>{self.teasers()}</div>{self.foot()}"
        elif layout == 3:
            page = f"<table><tr><td>{self.menu()}</td><td>{body}</td><td>{self.teasers()}</td></tr></table>{self.foot()}"
        elif layout == 5:
            page = f"<div>{self.menu()}</div>{self.advert()}<div>{body}</div>{self.advert()}{self.teasers()}{self.foot()}"
        else:
            page = f"{self.advert()}<div>{self.link(OTHER)} | {self.link(OTHER)}</div><section>{body}</section>{self.menu()}{self.foot()}"
        return f"<html><head><title>x</title></head><body>{page}</body></html>"


def pages(n: int = 180, seed: int = 5) -> list[str]:
    """n pages, the layouts in turn."""
    return [_Writer(seed * 100_003 + k).page(k % LAYOUTS) for k in range(n)]
