"""Facts of a page without a model: every source in turn, the first to state a field stands."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from urllib.parse import parse_qs, urlsplit

from ..plans.fields import allowed, field_for
from .blocks import layouts
from .tree import HEADINGS, Node

# Fixed values, patterns included: links that share, hosts' parts that name nobody, links to known services, words for no value, parts of an address, class names of names.
SHARES = ("share", "sharer", "intent/tweet", "sharearticle", "dialog/share", "pin/create", "sharing", "twitter.com/home?status", "facebook.com/sharer.php")
COMMON = ("www", "com", "net", "org", "co", "in")
SERVICES = [("facebook", ("facebook",)), ("instagram", ("instagram",)), ("linkedin", ("linkedin",)), ("twitter", ("twitter", "x.com")), ("youtube", ("youtube", "youtu.be"))]
MAPS = ("maps.google", "google.com/maps", "openstreetmap", "directions", "location")
WHATSAPP = ("wa.me", "api.whatsapp.com", "whatsapp:")
NEGATIVE = ("not revealed", "not disclosed", "n/a", "nil", "none", "not specified", "not available")
ADDRESS = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")
NAMES = (".company-name", ".brand-name", ".business-name", ".franchise-name", ".company-title")
ASKS = ("what ", "why ", "how ", "where ", "who ", "when ")
EMAIL = re.compile(r"\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+\b")
PHONE = re.compile(r"\b\+?\d[\d\s\-()]{8,15}\d\b")
LISTS = ("products", "services", "images", "preferred_locations", "expansion_locations")
MOST_IMAGES = 15


class Facts(dict):
    """Fields that pages may set, the first value standing; ``said`` has who stated what, in order."""

    def __init__(self):
        super().__init__()
        self.said: list[dict] = []

    def state(self, source: str, field: str, value) -> bool:
        if not value or not allowed(field) or self.get(field):
            return False
        self[field] = value
        self.said.append({"source": source, "field": field, "value": value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)})
        return True


def own_link(href: str, url: str) -> bool:
    """Whether a link shares the page or leads back to its own site."""
    low, parts = href.lower(), _host_parts(url)
    return any(s in low for s in SHARES) or any(p in low for p in parts)


@lru_cache(maxsize=256)
def _host_parts(url: str) -> tuple[str, ...]:
    """The parts of a url's host that name its site."""
    host = urlsplit(url if "//" in url else f"//{url}").netloc.lower()
    return tuple(p for p in host.split(".") if len(p) > 3 and p not in COMMON)


def extract(root: Node, url: str = "", aliases: dict[str, str] | None = None, found: list[dict] | None = None) -> dict:
    """(fields, lists, faq, said) of a page; ``found`` are its layouts, if known."""
    facts, faq, nodes = Facts(), [], root.nodes()
    for script in (n for n in nodes if n.tag == "script"):
        if script.get("type") == "application/ld+json":
            try:
                data = json.loads("".join(c for c in script.children if isinstance(c, str)))
            except ValueError:
                continue
            _linked_data(data, facts, faq, url)
    for meta in (n for n in nodes if n.tag == "meta"):
        key = (meta.get("property") or meta.get("name")).lower()
        if key in ("og:title", "twitter:title", "title"):
            facts.state("meta", "franchise_name", meta.get("content").strip())
        elif key == "og:url" and not own_link(meta.get("content"), url):
            facts.state("meta", "website", meta.get("content").strip())
    _crumbs(nodes, facts)
    _identity(nodes, facts)
    _anchors(nodes, facts, url)
    _images(nodes, facts)
    for layout in layouts(root, snippets=False) if found is None else found:
        for pair in layout["pairs"]:
            field = field_for(pair["k"], aliases)
            value = pair["v_list"] or " ".join((pair["v"] or "").split())
            if field is None or isinstance(value, str) and value.lower().startswith(NEGATIVE):
                continue
            if field == "brand" and (not isinstance(value, str) or len(value) > 60 or len(value.split()) > 8 or "." in value):
                continue
            if field in LISTS:
                facts.state(layout["type"], field, value if isinstance(value, list) else [value])
            else:
                facts.state(layout["type"], field, ", ".join(value) if isinstance(value, list) else value)
    text = root.text()
    for field, pattern in (("email", EMAIL), ("phone", PHONE)):
        if (m := pattern.search(text)) and (field == "email" and not own_link(m[0], url) or field == "phone" and sum(c.isdigit() for c in m[0]) >= 9):
            facts.state("text", field, m[0])
    if facts.get("whatsapp_link") and (number := parse_qs(urlsplit(facts["whatsapp_link"]).query).get("phone")):
        facts.state("whatsapp", "phone", number[0].strip())
    name, brand = facts.get("franchise_name"), facts.get("brand", "")
    if name and (not brand or len(brand.split()) > 8 or len(brand) > 60):
        facts["brand"] = name
    for one, other in (("franchise_since", "franchise_start_year"), ("franchise_start_year", "franchise_since")):
        if facts.get(one):
            facts.state("bridge", other, facts[one])
    faq += [x for x in _questions(nodes) if x not in faq]
    return {
        "fields": {k: v for k, v in facts.items() if isinstance(v, str)},
        "lists": {k: v for k, v in facts.items() if not isinstance(v, str)},
        "faq": faq,
        "said": facts.said,
    }


def _linked_data(data, facts: Facts, faq: list, url: str) -> None:
    if isinstance(data, list):
        for x in data:
            _linked_data(x, facts, faq, url)
    if not isinstance(data, dict):
        return
    for x in data.values():
        _linked_data(x, facts, faq, url)
    texts = {k: v for k, v in data.items() if isinstance(v, str)}
    facts.state("json-ld", "franchise_name", texts.get("name") or texts.get("legalName"))
    if "@" in texts.get("email", "") and not own_link(texts["email"], url):
        facts.state("json-ld", "email", texts["email"])
    facts.state("json-ld", "phone", texts.get("telephone") or texts.get("phone"))
    if texts.get("url", "").startswith(("http", "www")) and not own_link(texts["url"], url):
        facts.state("json-ld", "website", texts["url"])
    logo = data.get("logo")
    logo = logo.get("url") if isinstance(logo, dict) else logo
    if isinstance(logo, str) and logo.startswith(("http", "www")):
        facts.state("json-ld", "logo", logo)
        facts.state("json-ld", "logo_url", logo)
    place = data.get("address")
    facts.state("json-ld", "address", place if isinstance(place, str) else ", ".join(place[k] for k in ADDRESS if isinstance(place.get(k), str)) if isinstance(place, dict) else None)
    if data.get("@type") == "FAQPage":
        asked = data.get("mainEntity") or []
        for q in asked if isinstance(asked, list) else [asked]:
            answer = (q.get("acceptedAnswer") or {}).get("text") if isinstance(q, dict) and isinstance(q.get("acceptedAnswer"), dict) else None
            if isinstance(q, dict) and q.get("@type") == "Question" and q.get("name") and answer:
                faq.append({"question": str(q["name"]), "answer": str(answer)})
    if data.get("@type") == "BreadcrumbList" and isinstance(data.get("itemListElement"), list):
        names = [str(n).strip() for x in data["itemListElement"] if isinstance(x, dict) and (n := x.get("name") or (x["item"].get("name") if isinstance(x.get("item"), dict) else None))]
        if names:
            facts.state("json-ld", "category", names[-1])
            facts.state("json-ld", "segment", " > ".join(names))


def _crumbs(nodes: list[Node], facts: Facts) -> None:
    trail = next((n for n in nodes if n.attrs and any("breadcrumb" in n.get(a).lower() for a in ("class", "id", "role"))), None)
    if trail:
        names = [t for n in trail.find("li", "span", "a") if (t := n.text()) and t not in (">", "/", "|", "home", "home page")]
        if names:
            facts.state("breadcrumb", "category", names[-1])
            facts.state("breadcrumb", "segment", " > ".join(names))


def _identity(nodes: list[Node], facts: Facts) -> None:
    first: dict[str, Node] = {}
    for n in nodes:
        if n.tag in ("h1", "title"):
            first.setdefault(n.tag, n)
        for c in n.get("class").split():
            first.setdefault(f".{c}", n)
    named = [first.get(k) for k in ("h1", *NAMES, "title")]
    pictures = [n.get("alt") for n in nodes if n.tag == "img" and "alt" in n.attrs][:1]
    name = next((t for t in [*(n.text() for n in named if n), *map(str.strip, pictures)] if 0 < len(t) <= 60), None)
    facts.state("identity", "franchise_name", name)
    facts.state("identity", "brand", name)


def _anchors(nodes: list[Node], facts: Facts, url: str) -> None:
    for a in (n for n in nodes if n.tag == "a"):
        href, text = a.get("href").strip(), a.text().lower()
        low = href.lower()
        if not href or own_link(href, url):
            continue
        if low.startswith(("mailto:", "tel:")):
            facts.state("link", "email" if low[0] == "m" else "phone", href.split(":", 1)[1].split("?")[0].strip())
        elif any(w in low for w in WHATSAPP):
            facts.state("link", "whatsapp_link", href)
        elif not any(m in low for m in MAPS):
            service = next((s for s, words in SERVICES if any(w in low for w in words) or s in text), None)
            if service:
                if href.startswith(("http", "www")):
                    facts.state("link", service, href)
            elif "website" in text or "visit site" in text:
                facts.state("link", "website", href)


def _images(nodes: list[Node], facts: Facts) -> None:
    shown = [n for n in nodes if n.tag == "img" and (s := n.get("src").strip()) and not s.startswith("data:")]

    def is_logo(n: Node) -> bool:
        if any("logo" in n.get(a).lower() for a in ("class", "id", "src")):
            return True
        while (n := n.parent) is not None and n.tag != "body":
            if n.tag == "header" or "logo" in f"{n.get('class')} {n.get('id')}".lower() or "header" in n.get("class").lower():
                return True
        return False

    if shown:
        logo = next(filter(is_logo, shown), shown[0]).get("src").strip()
        facts.state("image", "logo", logo)
        facts.state("image", "logo_url", logo)
        facts.state("image", "images", [n.get("src").strip() for n in shown[:MOST_IMAGES]])


def _questions(nodes: list[Node]) -> list[dict]:
    out: list[dict] = []

    def add(q: Node, answers, most_q: int, least_a: int, most_a: int) -> None:
        a = q.after()
        while a is not None and not answers(a):
            a = a.after()
        if a is not None and 0 < len(q.text()) < most_q and least_a < len(a.text()) < most_a:
            x = {"question": q.text(), "answer": a.text()}
            if x not in out:
                out.append(x)

    for block in nodes:
        if not block.attrs:
            continue
        if "faq" in block.get("class").lower() or block.get("itemtype") == "https://schema.org/FAQPage":
            for q in block.walk():
                if q.tag in ("h3", "h4") or "question" in q.get("class").lower() or q.get("itemprop") == "name":
                    add(q, lambda n: n.tag in ("p", "div") or "answer" in n.get("class").lower() or n.get("itemprop") == "text", 200, 0, 1000)
    if not out:
        for q in (n for n in nodes if n.tag in ("dt", "strong", *HEADINGS[3:5])):
            text = q.text()
            if text.endswith("?") or any(w in text.lower() for w in ASKS):
                add(q, lambda n: n.tag in ("dd", "p", "div"), 150, 20, 800)
    return out
