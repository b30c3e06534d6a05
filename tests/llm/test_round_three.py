"""Main text, Merkle manifest and fill-in-middle: brute force, planted pages, odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from checking import SMALL, same_rows
from pyspark.sql import functions as F

from siltstone.llm import boost, infill, main_text, merkle, page_layouts, queries

ODD = [None, "", " ", "a", "a b", "  \t\n", " lead and tail \n", "a <P> b", "< <P x <", "é ü 😀 z", "wörd" * 3 + "\t\n" * 5 + "é", " x y", "x" * 5000]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- fill in middle


def test_lists_of_ends():
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab é\n😀 ") for _ in range(rng.randrange(400))) for _ in range(200)]
    for piece in (infill.PIECE, 3, 64):
        for t in texts:
            before, infill.PIECE = infill.PIECE, piece
            try:
                ends, size = infill.ends_of(np.frombuffer(t.encode(), dtype=np.uint8))
            finally:
                infill.PIECE = before
            want = [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)]
            assert ends.tolist() == want and size == len(t)
            low, high = infill.packed(ends, size)
            assert infill.chosen(len(ends), size, low, high, list(range(len(ends) + 1))) == [0, *want]
    long = np.cumsum(np.random.default_rng(2).integers(1, 40, 100_000))
    low, high = infill.packed(long, int(long[-1]))
    assert len(low) + len(high) < 100_000 and infill.chosen(len(long), int(long[-1]), low, high, [1, 777, 100_000]) == [long[0], long[776], long[-1]]


def test_infill_by_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "a b c"), (None, "a b c"), (3, "other text with this id")] + [(100 + k, f"one two  three {'more ' * (k % 7)}") for k in range(120)] + [(1000 + k, "the same text in many rows") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "form", "_key", "_text", "output", "size")})
    out = infill.rearranged(df).select("*", infill.restored(F.col("output"), F.col("form")).alias("again"))
    want = []
    for i, t in rows:
        t = t or ""
        e = [0] + [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)]
        h = H("42:", "" if i is None else str(i))
        a, b = sorted(int(h[8 * k : 8 * k + 8], 16) % len(e) for k in (0, 1))
        p, m, s = t[: e[a]], t[e[a] : e[b]], t[e[b] :]
        form = "plain" if not t or re.search("<[PSM]>", t) or int(h[16:24], 16) % 100 >= 50 else "spm" if int(h[24:32], 16) % 100 < 80 else "psm"
        want.append((i, t, len(e) - 1, form, e[a], e[b], {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form], t))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want)) and {w[3] for w in want} == {"plain", "psm", "spm"}
    assert infill.rearranged(df.limit(0)).count() == 0


def test_infill_one_list_for_copies(spark):
    df = spark.createDataFrame([(k, "same text here" if k % 3 else f"text {k}") for k in range(300)], "doc_id long, text string")
    own = df.select(F.unhex(F.sha2("text", 256)).alias("k"), "text")
    made = infill.index(own, "k", "text")
    assert made.count() == 101 and made.agg(F.sum("copies")).first()[0] == 300
    with pytest.raises(ValueError):
        infill.index(own.withColumn("k", F.lit(b"one")), "k", "text")


# --- Merkle manifest


def brute(rows, lower):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H(*map(enc, r[:4]), enc(t))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def path(tree, i):
        out = []
        for level in tree[:-1]:
            s = i // 8 * 8
            out.append(("".join(level[s:i]), "".join(level[i + 1 : s + 8])))
            i //= 8
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {g: levels([leaf(r, r[4]) for r in groups[g]]) for g in langs}
    crown = levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i) + path(crown, k)
            node = leaf(r, r[4].translate(lower) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4])
            for a, b in steps:
                node = H(a, node, b)
            out.append((r[0], trees[g][0][i], trees[g][-1][0], crown[-1][0], H(*[a + b for a, b in steps]), node, node == crown[-1][0]))
    return sorted(map(repr, out))


def manifest_of(df):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    made = merkle.manifest(df, found={"text": tampered})
    return sorted(repr(tuple(r)) for r in made.select("doc_id", "leaf", "subroot", "root", merkle.proof_sha256(F.col("path")), "folded_root", "verified").collect())


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_manifest_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["web", None, "Bücher"]), "en" if k < 700 else rng.choice(["de", None, "é", "Z", ""]), rng.choice([None, 3]), rng.choice(["Text A", "x", "", None, "Ünï B"]) ) for k in range(800)]
    rows += [(9000, "s", "lone", 1, "Lone Text")] + [(5, "web", "en", 3, "Twice B")] * 40 + [(None, "s", "de", None, "N"), (None, None, None, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    odd = df.withColumns({c: F.lit(1) for c in ("_g", "_pos", "_n", "leaf", "root", "path")})
    got = manifest_of(odd)
    assert got == brute(rows, LOWER) and any("False" in r for r in got) and any("True" in r for r in got)
    assert manifest_of(df.limit(0)) == []
    one = [(1, None, None, None, "Only")]
    assert manifest_of(spark.createDataFrame(one, df.schema)) == brute(one, LOWER)


def test_manifest_over_several_blocks(spark, monkeypatch):
    """Small blocks, so that blocks of roots of blocks are climbed; a hot language, and few of many."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(k, "s", "hot" if k % 3 else f"l{k % 90:03d}", k, f"T{k}") for k in range(600)]
    assert manifest_of(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")) == brute(rows, LOWER)


def test_manifest_sql_on_odd_rows(spark):
    """The SQL and the query agree where the small tables have no such rows."""
    rows = [(k, None if k % 4 else "s", None if k % 5 == 0 else "en", None, "Ab" if k % 2 else None) for k in range(70)] + [(None, "s", "x", 1, "n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    c = duckdb.connect()
    c.register("documents", df.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    have = c.execute(queries.SQL["op12_merkle_manifest"])
    names = [d[0] for d in have.description]
    assert sorted(repr(tuple(r[names.index(n)] for n in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))) for r in have.fetchall()) == brute(rows, LOWER)


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_fill_in_middle"])
def test_new_queries(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck, queries.SQL[name])


# --- main text


@pytest.fixture(scope="module")
def forest(spark):
    return main_text.fit(spark.read.parquet(f"{SMALL}/pages.parquet"))


def test_main_text_of_pages(spark):
    """Exactly the article of every page, by a plain reading of its mark-up."""
    import html

    got = {r["page_id"]: r["text"] for r in queries.op11_html_extraction(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        inside = re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", r["html"].split("<article>")[1].split("</article>")[0]))
        assert got[r["page_id"]] == " ".join(html.unescape(inside).split())


def test_main_text_of_layouts_not_seen(forest):
    """On drawn pages of another seed, with words that the training pages lack, nearly all words are right."""
    rng = random.Random(77)
    right = found = wanted = 0
    for _ in range(150):
        page = page_layouts.drawn(rng, [], [], main_text.MARK)
        o = main_text.Outline(page)
        want = " ".join(t for t, m in zip(o.text, o.main, strict=True) if m and t).split()
        got = main_text.texts([page.replace(f' {main_text.MARK}="1"', "").replace(f' {main_text.MARK}="0"', "")], forest)[0].split()
        right, found, wanted = right + sum(w in want for w in got), found + len(got), wanted + len(want)
    assert right / found > 0.95 and 0.93 < found / wanted < 1.07


PAGES = [
    (
        "<body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><main><article><h1>Title here</h1><p>First part, with a <a href=x>li<b>n</b>k</a> in it.</p><aside>Side note about something.</aside>"
        "<p>Second &amp; last&nbsp;\n part.</p></article><section class=comments><h2>Comments</h2><div class=comment><p>I liked this article a lot. It was great and I will come back.</p></div></section></main><footer>Copyright</footer>",
        "Title here First part, with a link in it. Second & last part.",
    ),
    (
        "<div id=top-menu><ul><li><a href=1>A</a><li><a href=2>B</a></ul></div><div id=cookie-banner>We use cookies to improve things. <button>OK</button></div><div class=content><h1>Head</h1><p>Some real text is here, long enough to be text."
        "<div class=ad>Buy now! Cheap stuff.</div><p>More real text follows after the advert, also long.</p><ul><li>One point</li><li>Another point</li></ul></div><div class=sidebar><h3>Popular</h3><ul><li><a href=3>Story about things</a></li></ul></div>"
        "<form class=newsletter><label>Email</label><input><button>Go</button></form><script>var a='<p>no</p>'</script>",
        "Head Some real text is here, long enough to be text. More real text follows after the advert, also long. One point Another point",
    ),
    (
        "<body><div class='navbar'><a href=1>Home</a></div><div id='main-content'><h1>News today</h1><p>It was a good day for all of us in town.</p><div class='related'><h3>Related</h3><ul><li><a href=2>Other story of note</a></li></ul></div><p>The mayor said so.</p></div>"
        "<div id='comments'><p>Nice one, mayor. I agree with you.</p></div><div id='footer'>All rights reserved</div></body>",
        "News today It was a good day for all of us in town. The mayor said so.",
    ),
    (
        "<header>Site name</header><nav><ul><li><a href=1>A</a></li></ul></nav><article><h1>One</h1><p>Alpha beta gamma.</p></article><aside><p>Aside text that is long enough to look like text.</p></aside><div class=notice>We use cookies on this site.</div>"
        "<form><input name=q><button>Go</button></form><section class=comments><p>Great post!</p><p>I disagree with it strongly, since it is wrong.</p></section><footer><p>&copy; 2024</p></footer>",
        "One Alpha beta gamma.",
    ),
    (
        "<body><div class='header'><p>My blog</p></div><div class='post'><h2>Entry</h2><p>Text of entry &eacute;&#233; here.</p><blockquote>Quoted words are here.</blockquote><pre>code  line\n two</pre></div><div class='sidebar'><p>About me: I write things now and then.</p></div></body>",
        "Entry Text of entry éé here. Quoted words are here. code line two",
    ),
    ("plain text only, no markup at all here.", "plain text only, no markup at all here."),
    (None, ""),
    ("", ""),
    ("<nav><a href=/>only</a> <a href=/>links</a></nav>", ""),
]


def test_main_text_of_planted_pages(spark, forest):
    rows = [(k, h, "x") for k, (h, _) in enumerate(PAGES)] * 2
    df = spark.createDataFrame(rows, "page_id long, html string, text string").withColumn("n_chars", F.lit("clash"))
    out = main_text.extracted(df, forest)
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in out.collect()) == sorted((k, t, len(t)) for k, (_, t) in enumerate(PAGES) for _ in range(2))
    assert main_text.extracted(df.limit(0), forest).count() == 0


def test_main_text_decoding_is_closed():
    """No node is kept under one that is left out, and no other such set has more log-odds: against all sets of small trees."""
    rng = random.Random(6)
    for _ in range(60):
        o = main_text.Outline("")
        n = rng.randint(2, 9)
        o.parent, o.text = [-1] + [rng.randrange(k) for k in range(1, n)], [""] + [f"t{k}" for k in range(1, n)]
        odds = np.array([rng.uniform(-3, 3) for _ in range(n - 1)])
        best = max(sum(odds[k - 1] for k in range(1, n) if s >> k & 1) for s in range(1, 2**n, 2) if all(s >> o.parent[k] & 1 for k in range(1, n) if s >> k & 1))
        kept = [int(t[1:]) for t in o.decoded(odds).split()]
        assert sum(odds[k - 1] for k in kept) == pytest.approx(best) and all(o.parent[k] in (0, *kept) for k in kept)


def test_main_text_of_long_and_deep_pages(forest):
    deep = "<div>" * 3000 + "<p>Deep down is a sentence. And one more of them.</p>"
    long = "<article><h1>T</h1>" + "".join(f"<p>Paragraph {k} says this. And it says that.</p>" for k in range(20_000)) + "</article>"
    texts = main_text.texts([deep, long], forest)
    assert len(texts) == 2 and texts[1].startswith("T Paragraph 0 says") and texts[1].endswith("And it says that.") and texts[1].count("Paragraph") == 20_000


def test_forest_learns_and_repeats():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    one, two = boost.fit(x, y), boost.fit(x, y)
    assert ((one.margins(x) > 0) == (y > 0)).mean() > 0.98 and (one.margins(x) == two.margins(x)).all()
    assert (boost.fit(x[:0], y[:0]).margins(x) == 0).all()
