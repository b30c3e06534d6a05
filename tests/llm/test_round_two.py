"""Cases with expected rows of their own: estimates, thresholds, disguises, shards, odd names, the pipeline's stages."""

import collections
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import decontam, jaccard, langid, line_dedup, mixing, phrases, pii, quality, url_rules


def test_quality_estimates():
    """Against expectation-maximisation over documents one by one, in arrays."""
    rng = np.random.default_rng(3)
    good = rng.random(4000) < 0.8
    votes = np.where(rng.random((4000, 4)) < 0.2, 0, np.where(good[:, None], np.where(rng.random((4000, 4)) < 0.02, -1, 1), np.where(rng.random((4000, 4)) < 0.6, -1, 1)))
    model = quality.fit(list(collections.Counter(map(tuple, votes.tolist())).items()), 4)
    assert all(b >= a - 1e-6 for a, b in zip(model["objective"], model["objective"][1:], strict=False))
    n = len(votes)
    sure, doubt = quality.BEFORE_GOOD * quality.RIGHT_BEFORE, quality.BEFORE_GOOD * (1 - quality.RIGHT_BEFORE)
    p = np.where((votes == -1).any(axis=1), 0.01, 0.99)
    for _ in range(len(model["objective"])):
        prior = (p.sum() + 1) / (n + 2)
        a = ((p[:, None] * (votes == 1)).sum(0) + sure) / ((p[:, None] * (votes != 0)).sum(0) + sure + doubt)
        c = (((1 - p)[:, None] * (votes == -1)).sum(0) + 1) / (((1 - p)[:, None] * (votes != 0)).sum(0) + 2)
        g = prior * np.where(votes == 1, a, np.where(votes == -1, 1 - a, 1)).prod(1)
        b = (1 - prior) * np.where(votes == -1, c, np.where(votes == 1, 1 - c, 1)).prod(1)
        p = g / (g + b)
    assert model["prior"] == pytest.approx(prior) and model["on_good"] == pytest.approx(list(a)) and model["on_bad"] == pytest.approx(list(c))
    seen = [((votes[:, j] == 1) & good).sum() / ((votes[:, j] != 0) & good).sum() for j in range(4)]
    assert all(abs(a - x) < 0.02 for a, x in zip(model["on_good"], seen, strict=True))  # documents outvote the prior


def test_quality_noisy_rule():
    """A rule that a third of the good documents fail is found to be so, and rejects none of them by itself."""
    probe = [((1,) * 10, 600), ((-1,) + (1,) * 9, 300), ((-1,) * 10, 100)]
    model = quality.fit(probe, 10)
    assert abs(model["on_good"][0] - 2 / 3) < 0.02 and all(x > 0.99 for x in model["on_good"][1:]) and abs(model["prior"] - 0.9) < 0.01
    odds = {v: math.log(model["prior"] / (1 - model["prior"])) + sum(math.log(a / (1 - c)) if x == 1 else math.log((1 - a) / c) for x, a, c in zip(v, model["on_good"], model["on_bad"], strict=True)) for v, _ in probe}
    assert [odds[v] > 0 for v, _ in probe] == [True, True, False]
    assert quality.fit([], 3)["prior"] == 0.5


def test_quality_measures_of_symbols(spark):
    rows = ["a b c", "a | b | c", "w### x%%% y", "#a b#c <> é _ -- 1", "", None]
    made = quality.measures(spark.createDataFrame([(t,) for t in rows], "text string"), F.col("text"))
    got = {r["text"]: (r["_n_symbolic"], r["_n_bare"], r["_n_symbol_runs"]) for r in made.collect()}
    assert got == {"a b c": (0, 0, 0), "a | b | c": (2, 2, 0), "w### x%%% y": (2, 0, 2), "#a b#c <> é _ -- 1": (3, 3, 1), "": (0, 0, 0), None: (0, 0, 0)}


def test_quality_is_not_all_must_pass(spark):
    """Good documents that one noisy rule says bad of are kept; junk that several rules of a group see goes."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9)))
    plain = [" ".join(word() for _ in range(60)) for _ in range(400)]
    loud = [" ".join(word() + "!" * (k % 2) for k in range(60)) for _ in range(150)]  # exclaims, and nothing else
    junk = [" ".join(word() + rng.choice(["###", "$$", "%%%"]) for _ in range(60)) for _ in range(50)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(plain + loud + junk)], "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.judge(df).where("kept").collect()}
    assert kept == set(range(550))


def test_quality_posterior(spark):
    model = {"prior": 0.7, "on_good": [0.9, 0.8], "on_bad": [0.6, 0.7]}
    df = spark.createDataFrame([(1, -1), (0, 0), (-1, 1)], "x int, y int")
    got = [r["p"] for r in df.select(quality.posterior(model, ["x", "y"]).alias("p")).collect()]
    by_hand = [0.7 * g / (0.7 * g + 0.3 * b) for g, b in ((0.9 * 0.2, 0.4 * 0.7), (1, 1), (0.1 * 0.8, 0.6 * 0.3))]
    assert got == pytest.approx(by_hand)


def test_mixing_threshold(spark):
    """The documents below the threshold are those of the least hashes, as many as come nearest to the target; ties in id, not in text, are apart."""
    rng = random.Random(5)
    rows = [(None if k % 3 == 0 else k % 7, " ".join(["w"] * rng.randrange(1, 40)) + f" t{k}", "ab"[k % 2]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = df.withColumn("h", mixing.hash_of(F.col("doc_id"), F.col("text"))).collect()
    taken = {(r["source"], r["text"]): (r["copies"], r["taken"]) for r in mixing.mix_rows(df).collect()}
    target = {r["source"]: r["target"] for r in mixing.mix(df).select("source_size", "target").distinct().join(df.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("source_size")), "source_size").collect()}
    for s in "ab":
        own = sorted((r["h"] % (1 << 64), len(r["text"].split()), r["text"]) for r in hashed if r["source"] == s)
        size = sum(n for _, n, _ in own)
        times, rest = math.floor(target[s] / size), target[s] - math.floor(target[s] / size) * size
        run, extra = 0, set()
        for _, n, t in own:
            if run + n - rest > rest - run:
                break
            run += n
            extra.add(t)
        assert {t: taken.get((s, t), (0, 0))[0] for _, _, t in own} == {t: times + (t in extra) for _, _, t in own}


def _disguised(rng):
    name, host = rng.choice(["mary.lee", "bob42", "j_smith", "anna.b.c"]), rng.choice(["example.com", "mail.example.org", "firm.co.uk"])
    ip = ".".join(str(rng.randrange(1, 255)) for _ in range(4))
    number = "".join(str(rng.randrange(10)) for _ in range(9))
    spell = dict(zip("0123456789", "zero one two three four five six seven eight nine".split(), strict=True))
    said = lambda s: " ".join(spell[c] for c in s)
    looks = str.maketrans("aeopc", "аеорс")
    return {
        "at and dot": ("email", f"{name} at {host.replace('.', ' dot ')}"),
        "brackets": ("email", f"{name}[at]{host.replace('.', '[dot]')}"),
        "round brackets": ("email", f"{name} (at) {host.replace('.', ' (dot) ')}"),
        "entity": ("email", f"{name}&#64;{host}"),
        "look-alikes": ("email", f"{name}@{host}".translate(looks)),
        "full width": ("email", "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in f"{name}@{host}")),
        "invisible": ("email", f"{name}​@​{host}"),
        "dotted ip": ("ip", ip.replace(".", " dot ")),
        "bracketed ip": ("ip", ip.replace(".", "[.]")),
        "spelled ip": ("ip", " dot ".join(said(p) for p in ip.split("."))),
        "spelled phone": ("phone", f"plus one {said('4' + number)}"),
        "full width phone": ("phone", "".join(chr(ord(c) + 0xFEE0) for c in f"+14{number}")),
    }


def test_disguises_planted():
    """Of every disguise at least nine in ten are found, at the characters where they stand."""
    rng = random.Random(9)
    hit = collections.Counter()
    for _ in range(100):
        for how, (kind, text) in _disguised(rng).items():
            before = " ".join(rng.choice(["please", "see", "the", "note", "from", "last", "week"]) for _ in range(rng.randrange(1, 9))) + ": "
            start = len(before)
            hit[how] += (start, start + len(text), kind) in pii.all_spans(f"{before}{text}; thanks")[1]
    assert len(hit) == 12 and min(hit.values()) >= 90, hit


def test_long_texts_in_linear_time():
    n = 1_000_000
    for text in ("@" + " " * n, "[at] " + " " * n + "[", " at " * (n // 4), "[ " * (n // 2) + "@", "bob at host dot com and " * (n // 24), "a [at] b [dot] c " * (n // 17)):
        start = time.monotonic()
        pii.all_spans(text)
        assert time.monotonic() - start < 5


def test_decontamination_shards(spark):
    """Spans that overlap or follow one another are one, however many shards there are."""
    text = "zero one two three four five six seven eight nine ten eleven twelve; end"
    words = text.replace(";", "").split()
    items = [(k, " ".join(words[k : k + 10])) for k in (0, 1, 3)] + [(9, "end"), (10, "twelve end"), (11, None), (12, "")]
    df = spark.createDataFrame([(1, text, "c"), (1, text, "c"), (2, None, "c"), (3, "nothing", None), (4, "END end", "x")], "doc_id long, text string, `a.b` string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]], r["a.b"] or "") for r in decontam.find_benchmark(df, bench, max_chars=m).collect()) for m in (decontam.MAX_CHARS, 50, 1)]
    assert got[0] == got[1] == got[2]
    one = (1, 14, 14, ["0", "1", "10", "3", "9"], [(0, len(text))], "c")
    assert got[0] == [one, one, (2, 0, 0, [], [], "c"), (3, 1, 0, [], [], ""), (4, 2, 2, ["9"], [(0, 7)], "x")]
    assert decontam.find_benchmark(df, bench.limit(0)).where("contaminated or n_items > 0").count() == 0


def test_language_letters_and_leader():
    model = langid.train([([1, 2], [1, 1], "a"), ([3], [2], "b"), ([1], [1], "a"), ([3, 4], [1, 1], "b"), ([2], [1], "a")], np.zeros(langid.DIMS), 5)
    assert langid.predict("½ ² Ⅷ 12", model) == ("und", 0.0) and langid.predict(None, model) == ("und", 0.0)
    # the leader's weights against the formula, coordinate by coordinate
    leader, dims = langid.Leader(3, 2), 3
    z, n = [[0.0, 0.0] for _ in range(dims)], [[0.0, 0.0] for _ in range(dims)]
    weight = lambda i, k: 0.0 if abs(z[i][k]) <= langid.L1 else -(z[i][k] - math.copysign(langid.L1, z[i][k])) / ((langid.BETA + math.sqrt(n[i][k])) / langid.ALPHA + langid.L2)
    for x, y in [({0: 1.0, 2: 0.5}, 0), ({1: 1.0}, 1), ({0: 0.3, 1: 0.3}, 1), ({2: 1.0}, 0)] * 5:
        leader.learn(np.array(list(x)), np.array(list(x.values())), y)
        w = {i: [weight(i, k) for k in (0, 1)] for i in x}
        logits = [sum(v * w[i][k] for i, v in x.items()) for k in (0, 1)]
        e = [math.exp(v - max(logits)) for v in logits]
        for i, v in x.items():
            for k in (0, 1):
                g = v * (e[k] / sum(e) - (k == y))
                s = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / langid.ALPHA
                z[i][k] += g - s * w[i][k]
                n[i][k] += g * g
    assert np.allclose(leader.weights(slice(None)), [[weight(i, k) for k in (0, 1)] for i in range(dims)])
    logits, labels = np.random.default_rng(1).normal(size=(200, 3)) * 4, np.random.default_rng(2).integers(0, 3, 200)
    loss = lambda t: -np.log(langid.softmax(logits / t)[np.arange(200), labels]).mean()
    assert loss(langid.temperature_for(logits, labels)) <= min(loss(t) for t in np.linspace(0.2, 9, 300)) + 1e-6


def test_defined_results(spark):
    """Nulls, empty texts, repeated rows, ties and names with dots: what each operator gives."""
    shared = " ".join(f"w{k}" for k in range(30))
    rows = [(1, shared, 1), (1, shared, 1), (2, shared + " more", 2), (None, None, 3), (3, "", None), (4, "a b", 5), (4, "a b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long")
    near = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.group_near(df).collect()))
    assert near == [(0, 0, 0), (1, 26, 1), (1, 26, 1), (2, 27, 1), (3, 0, 3), (4, 1, 4), (4, 1, 4)]
    cut = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["a.b"] or 0) for r in phrases.cut_repeats(df).collect()))
    assert cut == [(0, 0, 0, 3), (1, 30, 0, 1), (1, 30, 0, 1), (2, 31, 30, 2), (3, 0, 0, 0), (4, 2, 0, 5), (4, 2, 0, 5)]
    lines = spark.createDataFrame([(1, "a\nb\nc", 7), (1, "a\nb\nc", 7), (2, "x\na\nb\nc", 8), (3, None, 9)], "doc_id long, text string, `a.b` long")
    assert sorted((r["doc_id"], r["text"] or "", r["n_removed"], r["a.b"]) for r in line_dedup.dedup_lines(lines).collect()) == [(1, "a\nb\nc", 0, 7), (1, "a\nb\nc", 0, 7), (2, "x", 3, 8), (3, "", 0, 9)]
    judged = quality.judge(df.withColumn("kept", F.lit("mine")))
    assert judged.count() == len(rows) and not judged.where("kept and base_failed").count()
    assert {(r["doc_id"], r["base_failed"]) for r in judged.collect()} == {(1, False), (2, False), (None, True), (3, True), (4, True)}
    renamed = df.withColumnsRenamed({"doc_id": "the.id", "text": "the.text"})
    assert mixing.mix(renamed, id_col="the.id", text_col="the.text", source_col="a.b").count() == len(rows)
    assert sorted(r["component_id"] or 0 for r in jaccard.group_near(renamed, id_col="the.id", text_col="the.text").collect()) == [0, 1, 1, 1, 3, 4, 4]
    assert url_rules.filter_urls(renamed, url_rules.rules_frame(spark, url_rules.RULES), id_col="the.id", url_col="the.text").count() == len(rows)


GOOD = "The committee met again on Tuesday to look at the plans for the old harbour and its warehouses near the river bank number {} of many"


def test_stages_on_odd_tables(spark, tmp_path):
    """Names that operators use and names with dots keep their values; ids may repeat, also across sources."""
    rows = [(k % 5, GOOD.format(" ".join(f"n{k}x{j}" for j in range(8 + k % 3))), "en", "ab"[k % 2], k) for k in range(40)]
    rows += [(None, GOOD.format("null " * 3), "en", None, 99), (7, None, None, None, 98), (8, "", "en", "a", 97)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = df.withColumns({c: F.col("n_chars") for c in ("kept", "items", "spans", "n_words", "contaminated", "size", "hash", "_row", "_rest", "_own_size", "_mix_id", "copies", "taken", "a.b", "p_good", "_n_words", "n_removed", "f")})
    spark.createDataFrame([(1, "not in any text at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, odd, str(tmp_path))
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
        extra = [c for c in odd.columns if c not in ("text", "n_chars", "copies", "taken")]
        assert [c for c in out[name].columns if c not in ("copies", "taken")] == [c for c in odd.columns if c not in ("copies", "taken")]
        for r in out[name].collect():
            assert all(r[c] == r["a.b"] for c in extra if c in ("kept", "items", "spans", "size", "_row", "_rest", "n_words", "f"))
    ids = lambda d: sorted(r["a.b"] for r in d.collect())
    assert ids(out["quality_rules"]) == [*range(40), 99]
    assert ids(out["line_dedup"]) == [*range(40), 97, 98, 99] == ids(out["decontamination"])
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len((text or "").split())
    mixed = out["source_mixing"].collect()
    assert len({r["a.b"] for r in mixed}) == len(mixed)  # no row twice
    taken = collections.Counter()
    for r in mixed:
        taken[r["source"]] += r["taken"]
        assert r["taken"] == r["copies"] * len((r["text"] or "").split())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 3 * max(len((r[1] or "").split()) for r in rows)
