"""Trees, cleaning, pruning, blocks, facts, prompts and answers, without Spark."""

import json

from siltstone.operators import blocks, clean, extract, model, prompt, relevant
from siltstone.operators.tree import parse, select
from siltstone.plans import fields
from siltstone.plans.mapping import Aliases


def test_tree_recovers():
    root = parse("<ul><li>a<li>b</ul><p>one<p>two<div><b>x</div>y<table><tr><td>1<td>2<tr><td>3</table>")
    assert [n.text() for n in root.find("li")] == ["a", "b"]
    assert [n.text() for n in root.find("p")] == ["one", "two"]
    assert [len(tr.find("td")) for tr in root.find("tr")] == [2, 1]
    assert parse(None).html() == ""


def test_select():
    root = parse('<div class="a b" id="x"><p><a href="/t" role="tab">t</a></p></div><p>z</p>')
    assert len(select(root, "div.a > p a[role=tab], #x")) == 2
    assert [n.text() for n in select(root, "p")] == ["t", "z"]


def test_clean():
    html = '<html><head><title>T</title><script>x</script></head><body><nav>menu</nav><div class="sidebar">s</div><p onclick="x" id="k">text <a href="/u">l</a><img src="i" alt="pic"></p></body></html>'
    out = clean.clean_html(html, {"removable_selectors": ["nav"], "ignored_classes": ["sidebar"], "link_handling": "text", "image_handling": "alt"})
    assert "menu" not in out and "onclick" not in out and "l (/u)" in out and "[Image: pic]" in out and 'id="k"' in out
    assert clean.metadata(html)["title"] == "T"
    assert clean.clean_html("") == ""


def test_prune():
    junk = "".join(f'<div class="sidebar">junk {k}</div>' for k in range(8))
    root = parse(f'<body><nav>n</nav>{junk}<div class="content"><h2>Investment</h2><p>Rs. 5 Lakhs</p></div><div style="display: none">h</div><section><h2>Related posts</h2><p>r</p></section><footer>f</footer></body>')
    stats = relevant.prune(root)
    text = root.text()
    assert "Rs. 5 Lakhs" in text and all(x not in text for x in ("junk", "Related", " h", "f"[:0] or "footer"))
    assert stats["removed"] >= 11 and stats["contact_lost"]


def test_blocks():
    root = parse("<body><h1>Title</h1><p>Text</p><ul><li>a</li><li>b</li></ul><table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table><dl><dt>k<dd>v</dl>tail <b>bold</b></body>")
    assert [b["type"] for b in blocks.blocks(root)] == ["heading", "paragraph", "list", "table", "definition_list", "paragraph"]


def test_text_pairs():
    assert len(blocks.text_pairs("Operations Commenced On: 2023 Franchising / Distribution Commenced On: 2025 Number of Employees: 15")) == 3
    assert blocks.text_pairs("This company has operated since 2023.") == []


def test_layouts():
    dl = parse("<dl><dt>Is it easy?<dd>yes<dt>Term of Agreement?<dd>5 Years</dl>")
    (one,) = blocks.layouts(dl)
    assert one["type"] == "QA Layout" and len(one["pairs"]) == 2
    card = blocks.layouts(parse("<div><div>Area</div><div>500 sq ft</div></div>"))[0]
    assert card["type"] == "Statistic Layout" and card["pairs"][0]["k"] == "Area"


def test_extract():
    html = """<body><h1>Beat Gym</h1><table><tr><td>Investment</td><td>Rs. 20 Lakhs</td></tr><tr><td>Franchise Fee</td><td>Not Revealed</td></tr>
    <tr><td>Working Hours</td><td>8 Hours</td></tr></table><a href="mailto:a@beat.com">mail</a><a href="https://facebook.com/beat">fb</a><img src="/logo.png"></body>"""
    out = extract.extract(parse(html), "https://portal.example.com/x")
    f = out["fields"]
    assert (f["franchise_name"], f["brand"], f["investment_required"], f["expected_hours"], f["email"], f["facebook"], f["logo"]) == ("Beat Gym", "Beat Gym", "Rs. 20 Lakhs", "8 Hours", "a@beat.com", "https://facebook.com/beat", "/logo.png")
    assert "franchise_fee" not in f
    ld = '<script type="application/ld+json">{"@type":"FAQPage","name":"N","email":"x@y.z","mainEntity":[{"@type":"Question","name":"q","acceptedAnswer":{"text":"a"}}]}</script>'
    out = extract.extract(parse(ld))
    assert out["faq"] == [{"question": "q", "answer": "a"}] and out["fields"]["franchise_name"] == "q"  # parts of an object speak before it


def test_fields():
    assert fields.field_for("Total Investment:") == "investment_required"
    assert fields.field_for("Do you need training?") is None
    assert fields.field_for("Space", {"space": "area_required"}) == "area_required"
    assert fields.strategy("unknown") == ("llm", "llm_only")


def test_chunks():
    root = parse("<body><h1>A</h1>" + "".join(f"<ul>{''.join(f'<li>item {k}-{j}</li>' for j in range(60))}</ul>" for k in range(3)) + "</body>")
    parts = blocks.chunks(root, 100)
    assert len(parts) > 3 and all(p["n_tokens"] <= 100 for p in parts) and parts[-1]["heading_path"] == ["A"]
    assert blocks.chunks(root)[0]["chunk_type"] == "DIRECT"


def test_prompt():
    bs = blocks.blocks(parse("<h1>Fees</h1><p>franchise fee is 5 Lakhs</p><p>other</p>"))
    out = prompt.prompt("u", "t", {"franchise_fee": {"type": "string", "aliases": ["fee"]}, "brand": {}}, {"brand"}, bs)
    assert [s.split("\n")[0] for s in out.split("## ")[1:]] == ["Task", "Page", "Fields", "Known", "Rules", "Content", "Answer"]
    assert "- franchise_fee (string) [also: fee]" in out
    assert prompt.scores(bs, {"fee"})[1] == 15 + 8


def test_repair():
    for raw in ('{"a": 1,}', '```json\n{"a": 1}\n```', '{"a": "hello', '{"a": [{"b": 1', '{"a":'):
        assert "a" in json.loads(model.repaired(raw))
    assert model.coerced("tag1, tag2, tag3", "array") == ["tag1", "tag2", "tag3"]
    assert model.coerced("tagA\ntagB", "array") == ["tagA", "tagB"]
    assert model.coerced({"min": 1, "max": 2}, "string") == "1 - 2"
    assert len(model.key_values({"description": "d", "faq": [], "area": 3})) == 3
    assert model.quota_error("429: requests per day exceeded") == "daily"


def test_retries():
    class Flaky:
        n = 0

        def answer(self, prompt):
            self.n += 1
            if self.n < 3:
                raise OSError("connection refused")
            return '{"a": 1'

    pauses = []
    assert model.ask(Flaky(), "p", sleep=pauses.append) == {"a": 1} and pauses == [2.0, 4.0]


def test_columns():
    a = Aliases(["investment_required", "phone"], {"investment_required": ["capital required"]})
    cols = ["Investment Required", "Total Capital", "Phone"]
    assert a.column_for("capital required", cols) == ("Investment Required", 0.95, "Alias Match")
    assert a.column_for("Phone", cols)[:2] == ("Phone", 1.0)
    column, score, _ = a.column_for("capital", cols)
    assert column == "Total Capital" and score >= 0.6
    assert a.column_for("colour", cols)[0] is None


def test_chunk_is_under_the_headings_before_it_at_each_depth():
    root = parse("<body><h1>Top</h1><div><h2>One</h2><p>" + "a " * 300 + "</p><h2>Two</h2><p>" + "b " * 300 + "</p></div></body>")
    paths = [(p["chunk_type"], p["heading_path"]) for p in blocks.chunks(root, 200)]
    assert paths == [("H1", []), ("H2", ["Top"]), ("P", ["Top", "One"]), ("H2", ["Top", "One"]), ("P", ["Top", "Two"])]
