"""A small streaming reader of page structure, used inside Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

NOISE = frozenset(["script", "style", "nav", "header", "footer"])
HEADINGS = ("h1", "h2", "h3")
# Tags that end an open paragraph, and those that end an open list item.
_BLOCKS = frozenset("p div ul ol li table section article h1 h2 h3 h4 h5 h6 blockquote pre form".split())

_LIST = "list"


class PageReader(HTMLParser):
    """Collects the title, headings, paragraphs, list items and tag pills of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.fields: dict[str, list[str]] = {k: [] for k in ("title", *HEADINGS, "p", "li", "pill", "labelled")}
        self._open: list[tuple[str, list[str]]] = []
        self._skip: list[str] = []
        self._label: list[str] | None = None
        self._in_industries = 0

    def handle_starttag(self, tag, attrs):
        if self._skip or tag in NOISE:
            if tag in NOISE:
                self._skip.append(tag)
            return
        if tag in _BLOCKS:
            self._close("p")
        if tag == "li":
            self._close("li")
        if tag in ("ul", "ol"):
            self._open.append((_LIST, []))
        classes = (dict(attrs).get("class") or "").split()
        if tag in ("div", "section") and self._in_industries:
            self._in_industries += 1
        if tag in ("title", *HEADINGS, "p", "li"):
            self._open.append((tag, []))
        if tag == "span" and ("badge" in classes or "o_tag" in classes):
            self._open.append(("pill", []))
        elif tag in ("span", "a"):
            self._open.append((tag, []))
        if tag in ("label", "h4", "h5", "strong"):
            self._label = []

    def handle_endtag(self, tag):
        if self._skip:
            if tag == self._skip[-1]:
                self._skip.pop()
            return
        if tag in ("label", "h4", "h5", "strong") and self._label is not None:
            if "industr" in "".join(self._label).lower():
                self._in_industries = max(self._in_industries, 1)
            self._label = None
        if tag in ("div", "section") and self._in_industries:
            self._in_industries -= 1
        if tag in ("ul", "ol"):
            self._close("li")
            self._close(_LIST)
        if tag == "span":
            self._close("pill", "span")
        elif tag in ("a", "title", *HEADINGS, "p", "li"):
            self._close(tag)

    def handle_data(self, data):
        if self._skip:
            return
        for _, parts in self._open:
            parts.append(data)
        if self._label is not None:
            self._label.append(data)

    def close(self):
        super().close()
        while self._open:
            self._close(self._open[-1][0])

    def _close(self, *names: str) -> None:
        """End the innermost open element of these names and all inside it, but no list around it."""
        for name, _ in reversed(self._open):
            if name in names:
                break
            if name == _LIST and "li" in names:
                return
        else:
            return
        while True:
            name, parts = self._open.pop()
            text = "".join(parts).strip()
            if text and name in self.fields:
                self.fields[name].append(text)
            if text and self._in_industries and name in ("span", "pill", "li", "a"):
                self.fields["labelled"].append(text)
            if name in names:
                return


def read_page(html: str | None) -> dict[str, list[str]]:
    reader = PageReader()
    reader.feed(html or "")
    reader.close()
    return reader.fields
