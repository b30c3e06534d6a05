"""Cleaning a page: technical tags, unwanted sections, images, links, attributes; its metadata and kind."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from .tree import HEADINGS, Node, parse, select

# Tags without content, attributes that stay, and labels that are kept where a schema names none.
TECHNICAL = ("script", "style", "noscript", "template", "svg", "canvas", "iframe", "embed", "object")
ATTRIBUTES = ("href", "src", "value", "title", "alt", "placeholder", "class", "id", "role", "aria-label", "aria-controls", "data-bs-toggle", "data-toggle")
LABELS = ("investment", "investment required", "franchise fee", "phone", "email", "address", "support", "training", "brand", "category", "about", "business model", "royalty", "roi", "payback", "location")
_LABELLED = frozenset([*HEADINGS, "label", "dt", "th", "td", "span", "p", "div"])


def labels_of(schema: dict | None) -> frozenset[str]:
    """The words of a schema's columns, aliases and fields."""
    schema = schema or {}
    words = [*schema.get("columns", []), *schema.get("extraction_fields", {})]
    for alias, column in schema.get("aliases", {}).items():
        words += [alias, column]
    return frozenset(str(w).strip().lower() for w in words) or frozenset(LABELS)


def preserved(node: Node, labels: Iterable[str]) -> bool:
    """Whether an element holds a table, a definition list or a schema's label."""
    if node.tag in ("html", "body") or node.parent is None or not node.parent.tag and node.tag == "html":
        return True
    for n in (node, *node.walk()):
        if n.tag in ("table", "dl"):
            return True
        if n.tag in _LABELLED:
            text = n.text().lower()
            if any(w in text for w in labels):
                return True
    return False


def cleaned(html: str | None, config: dict | None = None, schema: dict | None = None) -> Node:
    """The tree of a page as a site's ``dom_clean_config`` wants it."""
    return clean_tree(parse(html), config, schema)


def clean_tree(root: Node, config: dict | None = None, schema: dict | None = None) -> Node:
    """``cleaned`` of a tree, which it changes; the root may be another afterwards."""
    config = config or {}
    labels = labels_of(schema) if any(config.get(k) for k in ("removable_selectors", "ignored_classes", "ignored_ids")) else frozenset()
    for n in root.find(*TECHNICAL):
        n.drop()
    if config.get("content_container") and (found := select(root, config["content_container"])):
        found[0].drop()
        root = Node("")
        root.children, found[0].parent = [found[0]], root
    for selector in config.get("removable_selectors", []):
        for n in select(root, selector):
            if n.attached(root) and not preserved(n, labels):
                n.drop()
    classes, ids = {c.lower() for c in config.get("ignored_classes", [])}, [i.lower() for i in config.get("ignored_ids", [])]
    for n in root.nodes() if classes or ids else ():
        if n.attached(root) and (classes & set(n.get("class").lower().split()) or any(i in n.get("id").lower() for i in ids)) and not preserved(n, labels):
            n.drop()
    images, links = config.get("image_handling", "keep"), config.get("link_handling", "keep")
    for n in root.nodes() if (images, links) != ("keep", "keep") else ():
        if not n.attached(root):
            continue
        if n.tag == "img" and images != "keep":
            alt = n.get("alt") or n.get("title")
            n.replace(f" [Image: {alt}] ") if images != "remove" and alt else n.drop()
        elif n.tag == "a" and links != "keep":
            n.drop() if links == "remove" else n.replace(f" {n.text()} ({n.get('href')}) ")
    allowed = config.get("allowed_tags")
    for n in root.nodes():
        if allowed and n.tag not in allowed and n.tag not in ("html", "body", "head"):
            n.unwrap()
        elif n.attrs:
            n.attrs = {k: v for k, v in n.attrs.items() if k in ATTRIBUTES}
    return root


def clean_html(html: str | None, config: dict | None = None, schema: dict | None = None) -> str:
    return " ".join(cleaned(html, config, schema).html().split())


def metadata(html: str | None) -> dict:
    """Title (or first h1), description, and a map of og: and twitter: properties."""
    return metadata_of(parse(html))


def metadata_of(root: Node) -> dict:
    title, h1 = root.first("title"), root.first("h1")
    named, social = {}, {}
    for m in root.find("meta"):
        key = m.get("name") or m.get("property")
        named.setdefault(key.lower(), m.get("content"))
        if key.startswith(("og:", "twitter:")):
            social[key] = m.get("content")
    return {
        "title": (title.text() if title else "") or (h1.text() if h1 else ""),
        "description": named.get("description") or named.get("og:description") or "",
        "social": social,
    }


def estimated_tokens(html: str, visible: str) -> int:
    return max(len(html) // 4, len(visible) // 3)


# What speaks for each kind of page, and how much.
_KIND_WORDS = {
    "faq": ("faq", "frequently-asked", "question", "answer"),
    "product": ("product", "item", "card", "grid", "listing", "shop"),
    "article": ("author", "published", "byline", "written-by", "date"),
}
_TEXT_WORDS = {
    "franchise": ("franchise", "territory", "own a unit", "investment range", "franchising"),
    "docs": ("docs", "documentation", "guide", "api", "reference"),
    "news": ("news", "report", "press release", "journal", "associated press", "editor"),
    "company": ("about us", "contact us", "our services", "careers", "privacy policy", "solutions", "partners"),
}
_PRICES, _ACTIONS = ("$", "€", "£", "price"), ("add to cart", "buy now", "checkout")
LEAST_SCORE = 0.45


def page_features(root: Node) -> dict[str, int]:
    """Counts that tell kinds of pages apart."""
    text = " ".join(root.strings()).lower()
    nodes = root.nodes()
    marks = [f"{n.get('id')}\n{n.get('class')}".lower() for n in nodes if n.attrs]
    count = Counter(n.tag for n in nodes)
    out = {f"{k}_marks": sum(w in m for m in marks for w in words) for k, words in _KIND_WORDS.items()}
    out |= {f"{k}_words": sum(w in text for w in words) for k, words in _TEXT_WORDS.items()}
    return out | {
        "headings": count["h1"] + count["h2"] + count["h3"],
        "paragraphs": count["p"],
        "details": count["details"],
        "links": count["a"],
        "code": count["code"] + count["pre"],
        "tables": count["table"],
        "lists": count["ul"] + count["ol"],
        "questions": sum(n.text().endswith("?") for n in nodes if n.tag in ("h2", "h3")),
        "says_faq": int("faq" in text or "frequently asked questions" in text),
        "prices": sum(text.count(w) for w in _PRICES),
        "actions": sum(text.count(w) for w in _ACTIONS),
    }


def page_kind(f: dict[str, int]) -> tuple[str, float]:
    """The kind with the highest score, the first of equals; below ``LEAST_SCORE`` unknown."""
    story = 0.4 * (f["article_marks"] >= 2) + 0.3 * (f["paragraphs"] >= 6 and f["links"] < f["paragraphs"] * 2.5)
    scores = {
        "FAQ": 0.6 * (f["faq_marks"] >= 3 or f["details"] >= 3) + 0.5 * (f["questions"] >= 3) + 0.3 * f["says_faq"],
        "Product Listing": 0.7 * (f["prices"] >= 5 and (f["product_marks"] >= 5 or f["actions"] >= 3)),
        "Franchise Listing": 0.8 * (f["franchise_words"] >= 2),
        "Documentation": 0.4 * (f["code"] >= 3) + 0.3 * (f["headings"] >= 8) + 0.3 * (f["docs_words"] >= 2),
        "News Article": story + 0.3 * (f["news_words"] >= 2),
        "Blog": story + 0.1 * (f["news_words"] < 2),
        "Product Page": 0.7 * (0 < f["prices"] < 5 and f["actions"] >= 1),
        "Company Website": 0.7 * (f["company_words"] >= 3),
    }
    kind = max(scores, key=scores.get)
    return (kind, round(min(scores[kind], 1.0), 2)) if scores[kind] >= LEAST_SCORE else ("Unknown", 0.0)
