"""The operators' queries over the test tables, and their SQL for DuckDB where it can say the same."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, infill, jaccard, langid, licence_notices, licences, line_dedup, main_text, merkle, mixing, phrases, pii, quality, url_rules
from ..plans.registry import spread
from .common import LOWER, UPPER, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), url_rules.rules_frame(spark, url_rules.RULES))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_benchmark(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    told = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return told.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.group_near(documents(spark, sf_dir).select("doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = phrases.cut_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licenses(documents(spark, sf_dir), licences.known_frame(spark))


def op8_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_notices.find_notices(documents(spark, sf_dir).select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col(f"_{x}").alias(x) for x in base], "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"))
    return main_text.extracted(pages.select("page_id", "url", "html"), main_text.fit(pages)).select("page_id", "url", "text", "n_chars")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    proved = merkle.manifest(documents(spark, sf_dir), found={"text": tampered})
    return proved.select("doc_id", "leaf", "subroot", "root", merkle.proof_sha256(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.rearranged(documents(spark, sf_dir).select("doc_id", "text"))
    cut = F.col("form") != "plain"
    return made.select(
        "doc_id",
        "n",
        "form",
        F.when(cut, F.col("first")).alias("prefix_chars"),
        F.when(cut, F.col("last") - F.col("first")).alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_URL_RULES = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in url_rules.RULES)

OP1_SQL = f"""
with rules(rule_host, rule_path, rule, verdict) as (values {_URL_RULES}),
parts as (
  select page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path,
         row_number() over () as n
  from pages),
fits as (
  select n, rule, verdict, row_number() over (partition by n order by length(rule) desc) as place
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from parts left join fits on parts.n = fits.n and place = 1
"""

OP6_SQL = """
with texts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
at_all as (select doc_id, lines, unnest(range(1, len(lines) - 1)) as k from texts where len(lines) >= 3),
wins as (select doc_id, k, array_to_string(lines[k:k + 2], chr(10)) as w from at_all),
ranked as (
  select doc_id, k, row_number() over (partition by w order by doc_id nulls first, k) as place
  from wins where regexp_matches(w, '[^\\x20\\x09-\\x0D]')),
gone as (select distinct doc_id, unnest([k, k + 1, k + 2]) as k from ranked where place > 1),
numbered as (select doc_id, unnest(range(1, len(lines) + 1)) as k, unnest(lines) as line from texts),
kept as (
  select n.doc_id, count(*) as n_lines, count(g.k) as n_removed,
         coalesce(string_agg(n.line, chr(10) order by n.k) filter (where g.k is null), '') as body
  from numbered n left join gone g on n.doc_id = g.doc_id and n.k = g.k group by n.doc_id)
select doc_id, n_lines, n_removed, sha256(body) as kept_sha256 from kept
"""


def _canonical_sql(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"' ' || regexp_replace(regexp_replace({lower}, '(?m)^[ \\t]*(copyright|\\(c\\)|©).*$', ' ', 'g'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g') || ' '"
    for one, other in licences.EQUIVALENT:
        out = f"replace({out}, ' {one} ', ' {other} ')"
    return f"trim(replace({out}, '  ', ' '))"


_KNOWN = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licences.KNOWN)

OP8_SQL = f"""
with known(license_id, text) as (values {_KNOWN}),
digests as (select sha256(form) as digest, min(license_id) as license_id from (select license_id, {_canonical_sql("text")} as form from known) group by 1),
own as (
  select doc_id, sha256({_canonical_sql("text")}) as digest,
         len(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?m)^[ \\t]*(copyright|\\(c\\)|©).*$')) as n_copyright
  from documents)
select doc_id, n_copyright, own.digest as digest, license_id from own left join digests on own.digest = digests.digest
"""

OP3_SQL = """
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
item_at as (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as k from item_words where len(w) > 0),
item_windows as (select distinct item_id, least(len(w), 10) as size, array_to_string(w[k:k + 9], ' ') as win from item_at),
sizes as (select distinct size from item_windows),
doc_at as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from words, sizes where len(w) >= size),
doc_windows as (select doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') as win from doc_at),
hits as (select doc_id, d.size as size, k, item_id from doc_windows d join item_windows i on d.win = i.win and d.size = i.size),
hit_words as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + size)) as pos from hits) group by 1),
hit_items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by 1)
select words.doc_id as doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit_words on words.doc_id = hit_words.doc_id left join hit_items on words.doc_id = hit_items.doc_id
"""

OP7_SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
at_all as (select doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) as k from words where len(w) > 0),
grams as (select distinct doc_id, array_to_string(w[k:k + 4], ' ') as g from at_all),
sizes as (select doc_id, count(*) as n from grams group by 1),
met as (select a.doc_id as a, b.doc_id as b, count(*) as k from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
linked as (select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
ways as (select a, b from linked union all select b, a from linked),
reach(doc_id, root) as (select doc_id, doc_id from words union select ways.b, reach.root from reach join ways on ways.a = reach.doc_id)
select words.doc_id as doc_id, coalesce(n, 0) as n_shingles, c as component_id
from words left join sizes on words.doc_id = sizes.doc_id join (select doc_id, min(root) as c from reach group by 1) r on words.doc_id = r.doc_id
"""

OP9_SQL = """
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
at_all as (select doc_id, w, unnest(range(1, len(w) - 18)) as k from words where len(w) >= 20),
wins as (select doc_id, k, array_to_string(w[k:k + 19], ' ') as win from at_all),
ranked as (select doc_id, k, row_number() over (partition by win order by doc_id, k) as place from wins),
gone as (select distinct doc_id, unnest(range(k, k + 20)) as k from ranked where place > 1),
numbered as (select doc_id, unnest(range(1, len(w) + 1)) as k, unnest(w) as word from words where len(w) > 0),
kept as (
  select n.doc_id, count(g.k) as n_removed, coalesce(string_agg(n.word, ' ' order by n.k) filter (where g.k is null), '') as body
  from numbered n left join gone g on n.doc_id = g.doc_id and n.k = g.k group by n.doc_id)
select words.doc_id as doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(body, '')) as kept_sha256
from words left join kept on words.doc_id = kept.doc_id
"""



def _remainders() -> list[int]:
    out = []
    for half in range(16):
        for _ in range(4):
            half = half >> 1 ^ (0xEDB88320 if half & 1 else 0)
        out.append(half)
    return out


def _level_sql(k: int) -> str:
    """Nodes of level ``k + 1`` from those of level ``k``: (t, g, p, d, n), a tree's key, its place and the number of its nodes."""
    return f"""l{k + 1} as (select t, g, p // 8 as p, case when max(n) > 1 then sha256(string_agg(d, '' order by p)) else max(d) end as d, (max(n) + 7) // 8 as n from l{k} group by t, g, p // 8)"""


def _siblings_sql(k: int) -> str:
    """What stands left and right of each node of level ``k`` in its run, where the level has a run."""
    return f"""s{k} as (select t, g, p, coalesce(string_agg(d, '' order by p) over (partition by t, g, p // 8 order by p rows between unbounded preceding and 1 preceding), '') as a, coalesce(string_agg(d, '' order by p) over (partition by t, g, p // 8 order by p rows between 1 following and unbounded following), '') as b, n > 1 as run from l{k})"""


_TREE, _CROWN = 10, 3  # levels: a billion documents a language, 512 languages
#: The 16 remainders of the reflected polynomial 0xEDB88320 for half a byte.
_CRC = "[" + ", ".join(str(c) for c in _remainders()) + "]"
_HALF = lambda x: f"xor(({x}) >> 4, {_CRC}[((({x}) & 15) + 1)])"
_CRC_SQL = f"xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)), lambda c, b: {_HALF(_HALF('xor(c, b)'))}))"


def _enc(c: str, v: str | None = None) -> str:
    v = v or f"cast({c} as varchar)"
    return f"case when {c} is null then '-' else strlen({v}) || ':' || {v} end"


def _climb_sql(first: str, last: int, carry: str) -> str:
    """Folds from level 0 to ``last``: (g, p, x, proof) with x the digest so far."""
    out, before = [], first
    for k in range(last):
        out.append(f"""f{carry}{k} as (select f.id as id, f.g as g, f.p // 8 as p, case when s.run then sha256(s.a || f.x || s.b) else f.x end as x, case when s.run then f.proof || s.a || s.b else f.proof end as proof from {before} f join {carry}s{k} s on f.g = s.g and f.p = s.p)""")
        before = f"f{carry}{k}"
    return ", ".join(out)


def _renamed(sql: str, prefix: str) -> str:
    return re.sub(r"\b([ls])(\d+)\b", rf"{prefix}\1\2", sql)


OP12_SQL = f"""
with base as (
  select row_number() over () as id, doc_id, coalesce('=' || lang, '') as g,
         sha256({_enc("doc_id")} || {_enc("source")} || {_enc("lang")} || {_enc("n_chars")} || {_enc("text")}) as leaf,
         case when ({_CRC_SQL}) % 3 = 0
              then sha256({_enc("doc_id")} || {_enc("source")} || {_enc("lang")} || {_enc("n_chars")} || {_enc("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) end as seen
  from documents),
placed as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as p, count(*) over (partition by g) as n from base),
tl0 as (select 0 as t, g, p, leaf as d, n from placed), {", ".join(_renamed(_level_sql(k), "t") for k in range(_TREE))},
{", ".join(_renamed(_siblings_sql(k), "t") for k in range(_TREE))},
crown as (select g as lang, d, row_number() over (order by g) - 1 as p, count(*) over () as n from tl{_TREE}),
cl0 as (select 0 as t, '' as g, p, d, n from crown), {", ".join(_renamed(_level_sql(k), "c") for k in range(_CROWN))},
{", ".join(_renamed(_siblings_sql(k), "c") for k in range(_CROWN))},
start as (select id, g, p, coalesce(seen, leaf) as x, '' as proof from placed),
{_climb_sql("start", _TREE, "t")},
over as (select id, '' as g, crown.p as p, x, proof from ft{_TREE - 1} f join crown on crown.lang = f.g),
{_climb_sql("over", _CROWN, "c")}
select doc_id, leaf, crown.d as subroot, cl{_CROWN}.d as root, sha256(f.proof) as proof_sha256, f.x as folded_root, f.x = cl{_CROWN}.d as verified
from placed join fc{_CROWN - 1} f on f.id = placed.id join crown on crown.lang = placed.g cross join cl{_CROWN}
"""

OP13_SQL = """
with own as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as w
  from documents),
drawn as (
  select *, len(w) as n, ('0x' || h[1:8])::bigint % (len(w) + 1) as one, ('0x' || h[9:16])::bigint % (len(w) + 1) as other,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 50 then 'plain'
              when ('0x' || h[25:32])::bigint % 100 < 80 then 'spm' else 'psm' end as form
  from own),
parts as (
  select *, array_to_string(w[1:least(one, other)], '') as prefix, array_to_string(w[least(one, other) + 1:greatest(one, other)], '') as middle,
         array_to_string(w[greatest(one, other) + 1:n], '') as suffix
  from drawn)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(prefix || middle || suffix) as restored_sha256
from parts
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_pii,
        op3_decontamination,
        op4_language_id,
        op5_mixing,
        op6_line_dedup,
        op7_ngram_jaccard,
        op8_license_scans,
        op8_license_notices,
        op9_substring_dedup,
        op10_quality_rules,
        op11_html_extraction,
        op12_merkle_manifest,
        op13_fill_in_middle,
    )
}
SQL = {
    "op1_url_filters": OP1_SQL,
    "op3_decontamination": OP3_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_ngram_jaccard": OP7_SQL,
    "op8_license_scans": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
