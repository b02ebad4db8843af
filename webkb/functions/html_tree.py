"""Pages as trees: typed content blocks, links, images and metadata.

The tree follows the tags as written: void elements have no children, an end tag closes the nearest open
element of its name, what is open at the end stays open to there. Functions here take one page; the
operators apply them in Arrow batches.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

# Elements that are dropped, headings, and names that mark hidden or main content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript iframe svg canvas video audio map object embed".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
NESTED = frozenset(("ul", "ol", "table", "blockquote", "pre"))
HIDDEN = re.compile(r"\b(hidden|invisible|sr-only)\b")
CONTENT_NAME = re.compile(r"main|content|article", re.I)


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self):
        """Descendant elements in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def strings(self):
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            else:
                stack += reversed(c.children)

    def text(self) -> str:
        return " ".join(" ".join(s.strip() for s in self.strings() if s.strip()).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("")]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.open[0]


def pruned(node: Node) -> Node:
    """Without scripts, media and hidden elements."""

    def shown(n: Node) -> bool:
        return n.tag not in DROPPED and "hidden" not in n.attrs and n.attrs.get("aria-hidden") != "true" and not HIDDEN.search(n.attrs.get("class", ""))

    stack = [node]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or shown(c)]
        stack += [c for c in n.children if isinstance(c, Node)]
    return node


def title(root: Node) -> str:
    found = root.find("title") or root.find("h1")
    text = found.text() if found else ""
    return text or next((n.attrs.get("content", "") for n in root.all("meta") if n.attrs.get("property") == "og:title"), "")


def language(root: Node) -> str | None:
    found = root.find("html")
    return (found.attrs.get("lang") or None) if found else None


def _skipped(href: str) -> bool:
    return href.lower().startswith(("javascript:", "mailto:", "tel:"))


def links(root: Node, url: str) -> list[dict]:
    """Every link once, absolute and without fragment."""
    out: dict[str, dict] = {}
    for a in root.all("a"):
        href = a.attrs.get("href", "").strip()
        if href and not _skipped(href):
            target = urldefrag(urljoin(url, href))[0]
            out.setdefault(target, {"url": target, "text": a.text(), "title": a.attrs.get("title", ""), "rel": a.attrs.get("rel", "")})
    return list(out.values())


def images(root: Node, url: str) -> list[dict]:
    out: dict[str, dict] = {}
    for i in root.all("img"):
        if src := i.attrs.get("src"):
            out.setdefault(urljoin(url, src), {"src": urljoin(url, src), **{k: i.attrs.get(k, "") for k in ("alt", "title", "width", "height")}})
    return list(out.values())


def _block(node: Node) -> dict | None:
    kind = {**dict.fromkeys(HEADINGS, "heading"), "p": "paragraph", "ul": "list", "ol": "list", "table": "table", "blockquote": "quote", "pre": "code", "img": "image"}.get(node.tag)
    attrs: dict[str, str] = {}
    level = 0
    if node.tag == "div":
        if any(c.tag in ("div", "p", "table", "blockquote", "pre", "ul", "ol", "section", "article") or c.tag in HEADINGS for c in node.walk()) or len(node.text()) < 10:
            return None
        kind, text = "paragraph", node.text()
    elif kind is None:
        return None
    elif kind == "list":
        text = "\n".join(f"• {t}" for li in node.children if isinstance(li, Node) and li.tag == "li" and (t := li.text()))
    elif kind == "table":
        rows = [[c.text() for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.all("tr")]
        rows = [r for r in rows if r]
        text = "\n".join(" | ".join(r) for r in rows)
        attrs = {"rows": str(len(rows)), "cols": str(max(map(len, rows), default=0))}
    elif kind == "code":
        text = "".join(node.strings())
        code = node.find("code")
        names = f"{node.attrs.get('class', '')} {code.attrs.get('class', '') if code else ''}"
        if m := re.search(r"\b(?:language|lang)-(\w+)", names):
            attrs = {"language": m[1]}
    elif kind == "image":
        text = node.attrs.get("alt") or node.attrs.get("title", "")
    else:
        text = node.text()
        level = int(node.tag[1]) if kind == "heading" else 0
        if kind == "quote" and (cite := node.attrs.get("cite")):
            attrs = {"cite": cite}
    if not text and kind != "image":
        return None
    return {"block_type": kind, "text": text, "tag_name": node.tag, "level": level, "attributes": attrs, "links": len(node.all("a"))}


def blocks(root: Node) -> list[dict]:
    """Typed blocks of the body in document order; nothing inside a list, table, quote or code block counts again."""
    out = []
    stack = [c for c in reversed((root.find("body") or root).children) if isinstance(c, Node)]
    while stack:
        node = stack.pop()
        block = _block(node)
        if block:
            out.append(block | {"position": len(out)})
        if node.tag not in NESTED:
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def container(root: Node) -> Node | None:
    """main, article, role=main, or an element whose id or class sounds like content; the first kind that exists."""
    for test in (lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("role") == "main", lambda n: bool(CONTENT_NAME.search(n.attrs.get("id", "")) or CONTENT_NAME.search(n.attrs.get("class", "")))):
        if found := next((n for n in root.walk() if test(n)), None):
            return found
    return None


def main_blocks(root: Node, found: list[dict]) -> list[dict]:
    """Blocks whose text is part of the container's; without one, no short blocks and no lists of many links and few words."""
    box = container(root)
    if box is not None:
        text = box.text()
        return [b for b in found if b["text"] in text]
    words = lambda b: len(b["text"].split())
    return [b for b in found if (b["block_type"] == "heading" or words(b) >= 5) and not (b["block_type"] == "list" and b["links"] > 5 and words(b) < 50)]


def content_score(node: Node) -> float:
    """How much an element looks like main content: text, few links, paragraphs; nothing for navigation or little text."""
    name = f"{node.attrs.get('id', '')} {node.attrs.get('class', '')}".lower()
    text = node.text()
    if len(text) < 100 or re.search(r"nav|menu|sidebar|footer|header|comment", name):
        return 0.0
    linked = sum(len(a.text()) for a in node.all("a"))
    return min(0.4, len(text) / 5000) + 0.3 * (1 - linked / len(text)) + min(0.3, 0.03 * len(node.all("p")))


def metadata(root: Node) -> dict:
    """Names, Open Graph, Twitter cards and JSON-LD of a page."""
    named, og, twitter, equiv, charset = {}, {}, {}, {}, None
    for m in root.all("meta"):
        a, value = m.attrs, m.attrs.get("content", "")
        charset = charset or a.get("charset")
        if a.get("property", "").startswith("og:"):
            og.setdefault(a["property"][3:], value)
        elif a.get("property"):
            named.setdefault(a["property"].lower(), value)
        key = a.get("name", "").lower()
        if key.startswith("twitter:"):
            twitter.setdefault(key[8:], value)
        elif key:
            named.setdefault(key, value)
        if a.get("http-equiv"):
            equiv.setdefault(a["http-equiv"].lower(), value)
    data = []
    for s in root.all("script"):
        if s.attrs.get("type") == "application/ld+json":
            try:
                loaded = json.loads("".join(s.strings()))
            except ValueError:
                continue
            data += [d for d in (loaded if isinstance(loaded, list) else [loaded]) if isinstance(d, dict)]
    kinds = [(d.get("@type")[0] if isinstance(d.get("@type"), list) and d["@type"] else d.get("@type")) or "Unknown" for d in data]
    canonical = next((n.attrs.get("href", "") for n in root.all("link") if "canonical" in n.attrs.get("rel", "").split()), None)
    time = next((n.attrs["datetime"] for n in root.all("time") if n.attrs.get("datetime")), None)
    first = lambda key: next((str(d[key]) for d in data if d.get(key)), None)
    page_title = root.find("title")
    return {
        "title": page_title.text() if page_title else "", "description": named.get("description", ""), "keywords": [k.strip() for k in named.get("keywords", "").split(",") if k.strip()],
        "author": named.get("author"), "canonical": canonical, "charset": charset, "viewport": named.get("viewport"), "robots": named.get("robots"),
        "og": og, "twitter": twitter, "ld_types": [str(k) for k in kinds], "ld_json": [json.dumps(d) for d in data],
        "best_title": og.get("title") or twitter.get("title") or (page_title.text() if page_title else ""),
        "best_description": og.get("description") or twitter.get("description") or named.get("description", ""), "best_image": og.get("image") or twitter.get("image"),
        "published": named.get("article:published_time") or first("datePublished") or time, "modified": named.get("article:modified_time") or first("dateModified"),
        "language": language(root) or equiv.get("content-language") or (og.get("locale", "").split("_")[0] or None),
    }
