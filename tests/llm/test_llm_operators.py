"""Each operator against a brute-force version, and on nulls, empty texts, ties, repeated rows, empty tables and clashing names."""

import collections
import hashlib
import re
import time
import unicodedata

import pytest
from checking import SMALL, same_rows
from pyspark.sql import functions as F

from siltstone.llm import decontam, jaccard, langid, licence_notices, licences, line_dedup, mixing, phrases, pii, quality, queries, url_rules

DOCS = "doc_id long, text string, lang string, source string"
LONG = "word " * 5000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Every odd case at once: nulls in each column, empty and long texts, repeated rows, ids that repeat, clashing names."""
    rows = [(1, None, "en", None), (2, "", None, "a"), (3, LONG, "en", "a"), (4, "a b c", "en", "b"), (4, "a b c", "en", "b"), (4, "other text", "fr", "b"), (None, "a b c", None, None), (None, None, None, None), (5, " \n\t ", "en", "a")]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("_row", "_text", "_id", "size", "kept", "spans", "n_words", "n_removed", "u", "k1", "at", "lines", "_made0", "copies", "hash", "score")})


@pytest.mark.parametrize("name", sorted(queries.SQL, key=lambda x: int(re.sub(r"\D", "", x.split("_")[0]))))
def test_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck, queries.SQL[name])


def test_odd_rows(spark, odd):
    n = odd.count()
    bench = spark.createDataFrame([(1, "a b c"), (2, None)], "item_id long, text string")
    runs = {
        "pii": lambda d: pii.find_pii(d),
        "decontam": lambda d: decontam.find_benchmark(d, bench),
        "langid": lambda d: langid.identify(d, langid.fit(d)),
        "mixing": lambda d: mixing.mix(d),
        "lines": lambda d: line_dedup.dedup_lines(d),
        "jaccard": lambda d: jaccard.group_near(d),
        "licences": lambda d: licences.scan_licenses(d, licences.known_frame(spark)),
        "phrases": lambda d: phrases.cut_repeats(d),
        "quality": lambda d: quality.judge(d),
        "urls": lambda d: url_rules.filter_urls(d, url_rules.rules_frame(spark, url_rules.RULES), id_col="doc_id", url_col="text"),
    }
    for name, run in runs.items():
        assert run(odd).count() == n, name
        assert run(odd.limit(0)).count() == 0, name
    kept = pii.find_pii(odd)
    assert "_row" in kept.columns and kept.columns.count("spans") == 1


def test_url_rules(spark):
    rows = [(1, None), (1, None), (2, "x"), (3, "http://Example.com/en/x"), (4, "http://com"), (6, "http://a.www.example.com/en/?q"), (8, "http://xnet/es/"), (9, "https://b.net/es/#a")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in url_rules.filter_urls(df, url_rules.rules_frame(spark, url_rules.RULES)).fillna("-").collect())
    assert got == [(1, "", "-", "allow"), (1, "", "-", "allow"), (2, "", "-", "allow"), (3, "example.com", "example.com/en/", "block"), (4, "com", "-", "allow"), (6, "a.www.example.com", "www.example.com/en/", "allow"), (8, "xnet", "-", "allow"), (9, "b.net", "net/es/", "block")]


def test_url_rules_in_cells(spark, monkeypatch):
    """Many rules, cut into cells, against every rule tried on every url."""
    rules = [(f"h{k % 40}.org/{'p' * (k % 7)}", "block" if k % 3 else "allow") for k in range(400)] + [("org", "block")]
    urls = [(k, f"http://a.h{k % 50}.org/{'p' * (k % 9)}") for k in range(500)]
    monkeypatch.setattr(url_rules, "RULES_PER_CELL", 20)
    got = {r["page_id"]: r["rule"] for r in url_rules.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), url_rules.rules_frame(spark, rules)).collect()}
    for k, url in urls:
        host, _, path = url.removeprefix("http://").partition("/")
        fit = [r for r, _ in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and f"/{path}".startswith(r[len(r.split("/")[0]) :])]
        assert got[k] == max(fit, key=len)


@pytest.mark.parametrize(
    "text, found",
    [
        ("mail bob.x at mail5 dot example dot com now", ["email:bob.x at mail5 dot example dot com"]),
        ("bob [at] mail5.example [dot] com", ["email:bob [at] mail5.example [dot] com"]),
        ("jоhn@example.com", ["email:jоhn@example.com", "email:hn@example.com"]),
        ("call plus one four one five five five five one two one two ok", ["phone:plus one four one five five five five one two one two"]),
        ("ip 192 dot 168 dot 0 dot 1", ["ip:192 dot 168 dot 0 dot 1"]),
        ("4111 1111 1111 1111 and +1 (743) 555-3824", ["card:4111 1111 1111 1111", "phone:+1 (743) 555-3824"]),
        ("10.0.0.256 10.1.2.3.4.5.6.7", ["ip:10.1.2.3", "ip:4.5.6.7"]),
        ("look at example.com, I am at home. dot com", []),
        ("one two three of us", []),
    ],
)
def test_pii(text, found):
    assert [f"{k}:{text[a:b]}" for a, b, k in pii.all_spans(text)[1]] == found


@pytest.mark.parametrize(
    "text, found",
    [
        ("write mary.ann.lee at example dot com", ["email:mary.ann.lee at example dot com"]),
        ("write mary dot ann dot lee at example dot com now", ["email:mary dot ann dot lee at example dot com"]),
        ("bob at example dot photography", ["email:bob at example dot photography"]),
        ("ask mary.lee at host.com, or bob42 at host.com", ["email:mary.lee at host.com", "email:bob42 at host.com"]),
        ("mail: bob at host.com", ["email:bob at host.com"]),
        ("a dot b at c dot org and d dot e dot f at g dot org", ["email:a dot b at c dot org", "email:d dot e dot f at g dot org"]),
        ("bob at example dot com dot 5", ["email:bob at example dot com"]),
        ("look at example.com; mail me at home.net; read node.js at nodejs.org", []),
    ],
)
def test_pii_said(text, found):
    assert [f"{k}:{text[a:b]}" for a, b, k in pii.all_spans(text)[1]] == found


@pytest.mark.parametrize(
    "text, found",
    [
        ("host one nine two dot one six eight dot zero dot one up", ["ip:one nine two dot one six eight dot zero dot one"]),
        ("host 192 dot one six eight dot 0 dot 1", ["ip:192 dot one six eight dot 0 dot 1"]),
        ("host one zero.zero.zero.double five", ["ip:one zero.zero.zero.double five"]),
        ("plus one (four one five) five five five - zero one two three", ["phone:plus one (four one five) five five five - zero one two three"]),
        ("plus one four one five. five five five. zero one two three.", ["phone:plus one four one five. five five five. zero one two three"]),
        ("+1 [four one five] five five five zero one two three", ["phone:+1 [four one five] five five five zero one two three"]),
        ("call (four one five) five five five zero one two three", ["phone:(four one five) five five five zero one two three"]),
        ("one nine two dot one six eight dot zero dot one, four one five five five five zero one two three", ["ip:one nine two dot one six eight dot zero dot one", "phone:four one five five five five zero one two three"]),
        ("One. Two. Three. Four. It is one (two) three.", []),
        ("version 2 dot one, one dot two", []),
    ],
)
def test_pii_spelled(text, found):
    assert [f"{k}:{text[a:b]}" for a, b, k in pii.all_spans(text)[1]] == found


def test_pii_foreign():
    bold = "".join(chr(0x1D41A + ord(c) - 97) if c.isalpha() else c for c in "bob@example.com")
    circled = "".join(chr(0x24D0 + ord(c) - 97) if c.isalpha() else c for c in "bob@example.com")
    squared = "".join(chr(0x1F130 + ord(c) - 97) if c.isalpha() else c for c in "bob@example.com")
    for text in (bold, circled, squared, "mi\u043ae@example.com", "bob\uff20example\uff0ecom", "\u0299ob@example.com"):
        assert (0, len(text), "email") in pii.all_spans(f"{text} now")[1]
    assert (0, 11, "ip") in pii.all_spans("".join(chr(0x1D7E2 + int(c)) if c.isdigit() else c for c in "192.168.0.1"))[1]
    assert pii.all_spans("bob@example.com\u2122")[1] == [(0, 15, "email")]
    for c in map(chr, range(0x80, 0x110000)):
        form = unicodedata.normalize("NFKC", c)
        if re.fullmatch("[ -~]+", form) and c not in "\u2122\u2120":
            assert pii._FOREIGN.fullmatch(c), hex(ord(c))


def test_pii_said_is_linear():
    for text in ("one (" * 40_000, "one." * 40_000, "1." * 60_000 + "one", "plus " * 40_000, "double " * 40_000, "one" + " " * 200_000, "a dot " * 40_000, "a at " * 40_000, " " * 200_000 + "at", "a dot b at " * 20_000, "dot at " * 40_000, "a@" * 60_000 + " dot"):
        start = time.monotonic()
        pii.all_spans(text)
        assert time.monotonic() - start < 5


def test_pii_base(docs):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub(r"\D", "", s)
    good = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    texts = [r["text"] or "" for r in docs.collect()] + ["a@b.c%d@e.f", "1.2.3.4.5.6.7.8.9", "+1+1 23456789 (", "a@@b.c", "..@a.b"]
    for t in texts:
        want = sorted(((*m.span(), k) for k, p in patterns.items() for m in re.finditer(p, t) if good[k](m[0])), key=lambda s: (s[0], pii.KINDS.index(s[2])))
        base, every = pii.all_spans(t)
        assert base == want and set(base) <= set(every)


def test_decontamination_spans(spark):
    df = spark.createDataFrame([(1, "Intro: One, TWO three four five six seven eight nine ten! end")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "one two three four five six seven eight nine ten"), (8, "END")], "item_id long, text string")
    for most in (decontam.MAX_CHARS, 10):
        r = decontam.find_benchmark(df, bench, max_chars=most).first()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items"]) == (12, 11, 2, ["7", "8"])
        assert r["items_sha256"] == hashlib.sha256(b"7,8").hexdigest()
    text = df.first()["text"]
    r = decontam.find_benchmark(df, bench).first()
    assert [text[s["start"] : s["end"]] for s in r["spans"]] == ["One, TWO three four five six seven eight nine ten! end"]


def test_language(spark, docs):
    told = langid.identify(docs.withColumn("held", langid.held_out(F.col("doc_id"))), langid.fit(docs))
    hit = [r["lang"] == r["lang_pred"] for r in told.where("held and lang is not null").collect()]
    assert sum(hit) / len(hit) >= 0.95
    few = spark.createDataFrame([(1, None), (2, "123 !!"), (3, "")], "doc_id long, text string")
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(few, langid.fit(docs)).collect()} == {("und", 0.0)}


def test_language_draw(spark):
    """A rare language is learned, frequencies are of all rows, and copies of a row neither crowd others out nor change reruns."""
    rows = [(k, f"the quick word {k}", "en") for k in range(9000)] + [(20_000 + k, f"un mot rapide zzz {k}", "fr") for k in range(3)] + [(30_000, "das gleiche Wort", "de")] * 6000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, other = langid.fit(df), langid.fit(df.repartition(7))
    assert one["names"] == ["de", "en", "fr"] or not df.where("lang = 'de'").where(~langid.held_out(F.col("doc_id"))).count() and one["names"] == ["en", "fr"]
    assert (one["weights"] == other["weights"]).all() and (one["idf"] == other["idf"]).all()
    learnable = df.where(~langid.held_out(F.col("doc_id")))
    assert langid.document_frequencies(learnable.select("text"))[1] == learnable.count()


def test_mixing(docs):
    rows = mixing.mix(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode().split()) and r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    names = sorted(sizes)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, want = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        each = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if each * weights[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            want[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    want |= {s: each * weights[s] for s in open_}
    most = max(r["size"] for r in rows)
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= most
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7)).collect())


def test_near(spark, docs):
    def sets(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    base = [f"w{k}" for k in range(100)]
    chain = [(10_000 + k, " ".join(base[k * 3 :] + [f"v{j}" for j in range(k * 3)])) for k in range(12)]  # near ones reach far ones
    extra = spark.createDataFrame([*chain, (20_000, None), (20_001, " "), (20_002, "Two words"), (20_003, "two  WORDS")], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra)
    own = {r["doc_id"]: sets(r["text"]) for r in df.collect()}
    root = {d: d for d in own}
    by = collections.defaultdict(list)
    for d, s in own.items():
        for g in s:
            by[g].append(d)
    met = {(a, b) for ds in by.values() for a in ds for b in ds if a < b}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in met:
        if 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.group_near(df).collect()}
    assert got == {d: (len(s), top(d)) for d, s in own.items()}
    jaccard.FREQUENT, was = 1, jaccard.FREQUENT
    try:
        assert got == {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.group_near(df).collect()}
    finally:
        jaccard.FREQUENT = was


def test_phrases(docs):
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        w = (r["text"] or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if (win := tuple(w[k : k + 20])) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(win)
        want[r["doc_id"]] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in phrases.cut_repeats(docs).collect()} == want


def test_licences(spark):
    mit = licences.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 Some Body\n\n" + mit.upper()), (2, mit.replace("sublicense", "sublicense,")), (3, mit + " more"), (4, None), (5, "released under the MIT licence")]
    got = {r["doc_id"]: (r["license_id"], r["n_copyright"]) for r in licences.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licences.known_frame(spark)).collect()}
    assert got == {1: ("MIT", 1), 2: ("MIT", 0), 3: (None, 0), 4: (None, 0), 5: ("MIT", 0)}


def test_licence_notices(spark):
    full = dict(licence_notices.texts())
    header = "# " + licence_notices.HEADERS[0][1].replace(" you", "\n# you")
    example = "<one line to give the program's name and a brief idea of what it does.>\nCopyright (C) <year>  <name of author>\n\nThis program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n"
    texts = {
        "some prose\nThis work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
        "some prose\nLicensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "some prose\nReleased under the MIT Licence.\nmore": "MIT",
        "a\n\nLicensed under the Apache\nLicense, Version 2.0.\n\nb": "Apache-2.0",
        "code\n// SPDX-License-Identifier: GPL-2.0-or-later OR MIT": "GPL-2.0-or-later,MIT",
        "© 2021 Some Body. Released under the MIT License.": "MIT",
        f"{header}\ncode": "Apache-2.0",
        f"intro\n{full['GPL-3.0']}\nmore": "GPL-3.0",
        f"{full['GPL-2.0']}\n{example}": "GPL-2.0",
        example.split("\n\n")[1]: "GPL-2.0-or-later",
        f"{full['MIT']}\n\n{full['ISC']}": "ISC,MIT",
        "This is not released under the MIT License, they say": "",
        "copyright notices must be kept": "",
        "": "",
    }
    rows = [(k, t) for k, t in enumerate(texts)] + [(-1, None)]
    got = {r["doc_id"]: r for r in licence_notices.find_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["license_ids"] for k in range(len(texts))] == list(texts.values()) and got[-1]["license_ids"] == ""
    assert [k for k in got if got[k]["n_copyright"]] == [5, 8]


def test_licence_notices_of_the_table(spark, docs):
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    want = {r["doc_id"]: ",".join(sorted({lines[x] for x in (r["text"] or "").split("\n") if x in lines})) for r in docs.collect()}
    assert want == {r["doc_id"]: r["license_ids"] for r in licence_notices.find_notices(docs).collect()} and any(want.values())


def test_lines(spark):
    rows = [(2, "a\nb\nc\nd"), (1, "x\na\nb\nc"), (3, "a\nb"), (4, "\n\n\n\n"), (5, "a\nb\nc\na\nb\nc"), (None, "a\nb\nc")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: ("a\nb\nc", 0), 1: ("x", 3), 2: ("d", 3), 3: ("a\nb", 0), 4: ("\n\n\n\n", 0), 5: ("", 6)}


def test_quality(docs):
    for r in quality.judge(docs).collect():
        text = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        times, covered = collections.Counter(wins), set()
        for k, x in enumerate(wins):
            if times[x] > 1:
                covered |= set(range(k, k + 8))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r["_n_words"], r["_word_chars"], r["_n_symbols"], r["_n_dup_lines"], r["_n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(d).where("not base_failed").join(labels, "doc_id").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) / len(rows) > 0.97
