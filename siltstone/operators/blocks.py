"""A pruned page as a list of semantic blocks, as chunks, and as labelled values."""

from __future__ import annotations

import re

from .tree import HEADINGS, Node

_WRAPPERS = ("div", "section", "article", "main", "body")


def blank(kind: str, **fields) -> dict:
    """A block of every field, those not given empty."""
    return {"type": kind, "level": None, "text": None, "list_type": None, "items": None, "pairs": None, "rows": None, "src": None, "alt": None, "placeholder": None, "value": None} | fields


def blocks(root: Node) -> list[dict]:
    """Headings, paragraphs, lists, definitions, tables, images and inputs in document order.

    Wrappers are entered; anything else is text of the paragraph around it.
    """
    out: list[dict] = []

    def flush(inline: list) -> None:
        text = " ".join(t for t in (c.text() if isinstance(c, Node) else c.strip() for c in inline) if t)
        if text:
            out.append(blank("paragraph", text=text))
        inline.clear()

    def visit(node: Node) -> None:
        inline: list = []
        for c in node.children:
            made = _block(c) if isinstance(c, Node) else None
            if made is None:
                inline.append(c)
                continue
            flush(inline)
            if c.tag in _WRAPPERS:
                visit(c)
            else:
                out.extend(made)
        flush(inline)

    visit(root.first("body") or root)
    return out


def _block(node: Node) -> list[dict] | None:
    """The blocks of one element, none if it is empty; null for what is inline."""
    tag = node.tag
    if tag in _WRAPPERS:
        return []
    if tag in HEADINGS:
        return [blank("heading", level=int(tag[1]), text=t)] if (t := node.text()) else []
    if tag == "p":
        return [blank("paragraph", text=t)] if (t := node.text()) else []
    if tag in ("ul", "ol"):
        items = [t for c in node.elements() if c.tag == "li" and (t := c.text())]
        return [blank("list", list_type="ordered" if tag == "ol" else "unordered", items=items)] if items else []
    if tag == "dl":
        pairs = definitions(node)
        return [blank("definition_list", pairs=[{"key": k, "value": v} for k, v in pairs])] if pairs else []
    if tag == "table":
        rows = [r for tr in node.find("tr") if any(r := [c.text() for c in tr.find("td", "th")])]
        return [blank("table", rows=rows)] if rows else []
    if tag == "img":
        src, alt = node.get("src"), node.get("alt") or node.get("title")
        return [blank("image", src=src, alt=alt)] if src or alt else []
    if tag == "input":
        hint, value = node.get("placeholder"), node.get("value")
        return [blank("input", placeholder=hint, value=value)] if hint or value else []
    return None


def definitions(dl: Node) -> list[tuple[str, str]]:
    out, term = [], None
    for c in dl.elements():
        if c.tag == "dt":
            term = c.text()
        elif c.tag == "dd" and term:
            out.append((term, c.text()))
            term = None
    return out


_CHECKS = "✓✔☑•-*"
_VALUE_HINTS = ("rs", "₹", "$", "lakh", "crore", "sq", "feet", "outlets", "year")
_LABEL = re.compile(r"(?:(?<=\s)|^)([A-Z][\w/&.'-]*(?:\s+[\w/&.'-]+){0,5}?)\s*:\s+")


def text_pairs(text: str) -> list[tuple[str, str]]:
    """``Label: value`` runs of a text, one a line or one behind another; a single one is prose."""
    lines = [" ".join(s.split()) for s in text.split("\n") if s.strip()]
    by_line = [m.groups() for s in lines if (m := re.match(r"([A-Z][^:]{0,80}?)\s*:\s*(\S.*)$", s)) and len(m[1].split()) <= 6]
    if len(lines) >= 2 and len(by_line) == len(lines):
        return by_line
    flat = " ".join(lines)
    found = list(_LABEL.finditer(flat))
    pairs = [(m[1], flat[m.end() : found[k + 1].start() if k + 1 < len(found) else len(flat)].strip()) for k, m in enumerate(found)]
    pairs = [p for p in pairs if p[1]]
    return pairs if len(pairs) >= 2 else []


def layouts(root: Node, snippets: bool = True) -> list[dict]:
    """Recurring ways to lay out labels and values, each with the pairs that it states: (type, tag, snippet, pairs); a snippet is null if none are wanted."""
    out: list[dict] = []
    texts_of: dict[Node, str] = {}

    def said(node: Node) -> str:
        """An element's text, put together once."""
        if (text := texts_of.get(node)) is None:
            text = texts_of[node] = node.text()
        return text

    def add(kind: str, node: Node, pairs: list[tuple[str, str | list[str]]]) -> None:
        out.append({"type": kind, "tag": node.tag, "snippet": node.html()[:200] if snippets else None, "pairs": [{"k": k, "v": v if isinstance(v, str) else None, "v_list": v if isinstance(v, list) else None} for k, v in pairs]})

    nodes = root.nodes()
    for n in nodes:
        if n.tag == "table":
            asks = any("?" in said(c) for c in n.find("td", "th"))
            add("QA Layout" if asks else "Specification Layout", n, table_pairs(n))
    for n in nodes:
        if n.tag == "dl":
            add("QA Layout" if any("?" in said(t) for t in n.find("dt")) else "Specification Layout", n, definitions(n))
    last_heading = None
    for n in nodes:
        if n.tag in HEADINGS:
            last_heading = n
        if n.tag not in ("ul", "ol"):
            continue
        items = [t for li in n.find("li") if (t := said(li))]
        if not items:
            continue
        split = [tuple(s.strip() for s in t.split(":", 1)) for t in items if ":" in t and not re.search(r"(https?|mailto|tel):", t, re.I)]
        if items[0][0] in _CHECKS:
            add("Checklist Layout", n, [(said(last_heading), [t.lstrip(_CHECKS + " ") for t in items])] if last_heading else [])
        elif any("?" in t and ":" in t for t in items):
            add("QA Layout", n, split)
        elif all(":" in t for t in items[:2]):
            add("Specification Layout", n, split)
        else:
            add("Content Section", n, [])
    for n in nodes:
        if n.tag in (*HEADINGS, "strong", "b") and "?" in (q := said(n)) and (a := n.after()) and a.tag in ("p", "div", "span") and said(a):
            add("QA Layout", n, [(q, said(a))])
    for n in nodes:
        if n.tag not in ("div", "section") or len(said(n)) > 500:
            continue
        full = [c for c in n.elements() if said(c)]
        texts = [said(c) for c in full]
        if len(full) == 2 and any(_valued(t) and len(o) < 40 for t, o in (texts, texts[::-1])):
            one, two = texts
            add("Statistic Layout", n, [(two, one)] if _valued(one) and not _valued(two) else [(one, two)])
        elif 3 <= len(full) <= 8 and all(":" in t for t in texts):
            add("Summary Layout", n, [tuple(s.strip() for s in t.split(":", 1)) for t in texts])
        elif len(full) <= 1 and not (full and full[0].tag in ("div", "section")) and (pairs := text_pairs("\n".join(n.strings()))):
            add("Summary Layout", n, pairs)
    for n in nodes:
        if n.tag in HEADINGS and "?" not in said(n):
            beside = n.after()
            if beside is None:
                add("Content Section", n, [])
            elif beside.tag in ("ul", "ol"):
                items = [t for li in beside.find("li") if (t := said(li))]
                add("Content Section", n, [(said(n), items)] if items else [])
            else:
                plain = beside.tag in ("p", "span", "div") and not beside.first("div", "p", "table", "ul", "ol")
                add("Content Section", n, [(said(n), said(beside))] if plain and said(beside) else [])
    return out


def _valued(text: str) -> bool:
    return text[:1].isdigit() or any(h in text.lower() for h in _VALUE_HINTS)


def table_pairs(table: Node) -> list[tuple[str, str]]:
    """Rows of two cells, or each row's cells under the headers."""
    rows = [tr.find("td", "th") for tr in table.find("tr")]
    if not rows:
        return []
    heads = rows[0]
    headed = len(heads) > 1 and (any(c.tag == "th" for c in heads) and not any(c.tag == "td" for c in heads) or all(c.first("strong", "b") for c in heads))
    if not headed:
        return [(r[0].text(), r[1].text()) for r in rows if len(r) == 2]
    names = [c.text().lower().rstrip(":") for c in heads]
    return [(k, c.text()) for r in rows[1:] if len(r) == len(names) for k, c in zip(names, r, strict=True)]


def chunks(root: Node, limit: int = 60_000, loose_text: bool = True) -> list[dict]:
    """Pieces of a page of at most ``limit`` estimated tokens: (chunk_type, heading_path, html, n_tokens).

    A page that fits is one.  Else elements are split into their children, lists and tables into halves of
    their rows, and what has no parts into windows of characters.  Text right under a split element is a piece of the
    kind TEXT, in windows if it is long; without ``loose_text`` it is left out, as it is in older datasets.
    """
    size = lambda html: max(1, len(html) // 4)
    whole = root.html()
    if size(whole) <= limit:
        return [{"chunk_type": "DIRECT", "heading_path": [], "html": whole, "n_tokens": size(whole)}]
    step = max(1000, 3 * limit)
    windows = lambda kind, text, path: [{"chunk_type": kind, "heading_path": list(path), "html": text[k : k + step], "n_tokens": size(text[k : k + step])} for k in range(0, len(text), step)]
    out: list[dict] = []
    todo: list[tuple[Node | str, tuple[str, ...]]] = [(root.first("body") or root, ())]
    while todo:
        node, path = todo.pop()
        if isinstance(node, str):
            out += windows("TEXT", node, path)
            continue
        html = node.html()
        if node.tag and size(html) <= limit:
            out.append({"chunk_type": node.tag.upper(), "heading_path": list(path), "html": html, "n_tokens": size(html)})
            continue
        parts = node.find("tr") if node.tag == "table" else node.elements()
        if node.tag in ("ul", "ol", "table") and len(parts) > 1:
            for half in (parts[len(parts) // 2 :], parts[: len(parts) // 2]):
                made = Node(node.tag, node.attrs)
                made.children = half
                todo.append((made, path))
        elif parts:
            under, named = [], path
            for c in parts if node.tag == "table" else node.children:
                if isinstance(c, str):
                    under += [(text, named)] if loose_text and (text := c.strip()) else []
                    continue
                under.append((c, named))
                if c.tag in HEADINGS:  # it is above what follows, not above itself
                    named = (*path, c.text())
            todo += reversed(under)
        else:
            out += windows("WINDOW", node.text(), path)
    return out
