"""Tab panes of a page: what each snapshot of a page shows of them, spliced into one document."""

from __future__ import annotations

from .tree import Node, parse

# What marks a pane, the classes of one that is shown, and what hides one.
ROLE, MARKS, SHOWN = "tabpanel", ("tab-pane", "tabpane"), ("active", "show")
HIDDEN = {"display: none": "display: block", "display:none": "display:block"}


def is_pane(node: Node) -> bool:
    return node.tag == "div" and (node.get("role") == ROLE or any(m in c for c in node.get("class").split() for m in MARKS))


def text_length(node: Node) -> int:
    return len(node.text(""))


def panes_of(html: str | None) -> list[dict]:
    """(pane_id, html, size) of each pane with an id: its markup and the length of its text."""
    return [{"pane_id": n.get("id"), "html": n.html(), "size": text_length(n)} for n in parse(html).walk() if is_pane(n) and n.get("id")]


def shown(pane: Node) -> None:
    classes = pane.get("class").split()
    if SHOWN[0] not in classes:
        pane.attrs["class"] = " ".join([*classes, *SHOWN])
    style = pane.get("style")
    for hides, shows in HIDDEN.items():
        style = style.replace(hides, shows)
    if style:
        pane.attrs["style"] = style


def spliced(html: str | None, panes: list[tuple[str, str]]) -> str:
    """A page with ``panes`` (id, html) in place of its own of that id where theirs have more text, and at the end of the body where it has none.

    Panes are taken in the order given, and all of the page's are shown.  Of a page without a body, none is added.
    """
    root = parse(html)
    own = {n.get("id"): n for n in root.walk() if is_pane(n) and n.get("id")}
    body = root.first("body")
    for name, markup in panes:
        new = next((n for n in parse(markup).walk() if is_pane(n)), None)
        if new is None:
            continue
        if name in own:
            if text_length(new) > text_length(own[name]):
                own[name].children = new.children
                for child in new.elements():
                    child.parent = own[name]
        elif body is not None:
            new.parent = body
            body.children.append(new)
            own[name] = new
    for pane in root.walk():
        if is_pane(pane):
            shown(pane)
    return root.html()
