"""Which blocks of a page a model is shown, and the prompt that shows them."""

from __future__ import annotations

import json

from ..plans.fields import CONCEPTS

# Scores of blocks and the budget of the prompt, in tokens.
HEADING, STRUCTURE, WORD, NEAR = 15.0, 5.0, 15.0, 8.0
BUDGET, SOFT_BUDGET, GOOD = 4000, 6000, 20.0
FEW, ENOUGH = 10, 15


def block_text(block: dict) -> str:
    parts = [block.get("text") or block.get("placeholder") or block.get("alt") or "", *(block.get("items") or [])]
    parts += [f"{p['key']} {p['value']}" for p in block.get("pairs") or []]
    parts += [" ".join(r) for r in block.get("rows") or []]
    return " ".join(p for p in parts if p)


def keywords(field: str, description: str = "") -> set[str]:
    """Words that a block about the field may hold."""
    out = {field.lower(), *field.lower().split("_")}
    for alias in CONCEPTS.get(field, ()):
        out |= {alias, *alias.split(" ")}
    out |= {w for raw in description.lower().split() if len(w := raw.strip(".,;:?!()\"'")) > 3}
    return {w for w in out if len(w) > 2}


def tokens(block: dict) -> int:
    return max(5, len(json.dumps({k: v for k, v in block.items() if v is not None})) // 4)


def scores(blocks: list[dict], words: set[str]) -> list[float]:
    """A score a block; a heading that says a wanted word lifts the two blocks after it, and these may lift others."""
    out = []
    for b in blocks:
        text = block_text(b).lower()
        base = HEADING if b["type"] == "heading" else STRUCTURE if b["type"] in ("table", "definition_list", "list") else 0.0
        out.append(base + WORD * sum(w in text for w in words))
    for k, b in enumerate(blocks):
        if b["type"] == "heading" and out[k] > HEADING:
            for j in range(k + 1, min(k + 3, len(out))):
                out[j] += NEAR
    return out


def chosen(blocks: list[dict], words: set[str]) -> list[int]:
    """Indices of the blocks that fit the budget, best first chosen, in page order."""
    score = scores(blocks, words)
    ranked = sorted(range(len(blocks)), key=lambda k: -score[k])
    picked = {k for k in ranked if blocks[k]["type"] == "heading" and score[k] >= HEADING}
    used = sum(tokens(blocks[k]) for k in picked)
    for k in ranked:
        n = tokens(blocks[k])
        if k not in picked and (used + n <= BUDGET or score[k] > GOOD and used < SOFT_BUDGET):
            picked.add(k)
            used += n
    if len(picked) < FEW:
        picked |= set(ranked[:ENOUGH])
    return sorted(picked)


def prompt(url: str, title: str, fields: dict[str, dict], solved: set[str], blocks: list[dict]) -> str:
    """What a model is asked: only for fields that the page itself hasn't given."""
    asked = {f: info for f, info in fields.items() if f not in solved}
    words = set().union(*(keywords(f, info.get("description", "")) for f, info in asked.items())) if asked else set()
    lines = []
    for f, info in asked.items():
        aliases = [a for a in info.get("aliases", []) if a.lower() != f.lower()]
        lines.append(f"- {f} ({info.get('type', 'string')})" + (f": {info['description']}" if info.get("description") else "") + (f" [also: {', '.join(aliases)}]" if aliases else ""))
    shown = [{k: v for k, v in blocks[k].items() if v is not None} for k in chosen(blocks, words)]
    sections = [
        ("Task", "Fill the fields below from the page. Answer with one JSON object and nothing else."),
        ("Page", f"{title}\n{url}"),
        ("Fields", "\n".join(lines) or "none"),
        ("Known", ", ".join(sorted(solved)) or "none"),
        ("Rules", "Use null for what the page does not say. Do not guess. Copy values as they stand."),
        ("Content", json.dumps(shown, ensure_ascii=False)),
        ("Answer", "{" + ", ".join(f'"{f}": ...' for f in asked) + "}"),
    ]
    return "\n\n".join(f"## {name}\n{body}" for name, body in sections)
