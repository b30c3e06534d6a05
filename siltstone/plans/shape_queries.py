"""Queries over pages made of table rows, of which SQL knows each shape: scored sections, layouts, chunks, blocks within a budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from .pages import chunked, exploded, pages_with
from .prompts import BLOCKS, chosen_blocks
from .registry import ROWS_A_TASK, query, spread, table


def _part_pages(spark, sf_dir, html: str):
    p = spread(table(spark, sf_dir, "part"), rows=ROWS_A_TASK)
    return p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("http://made.test/"), "p_partkey").alias("url"), F.expr(html).alias("html"))


# A section by its class, its label, its heading, its table and a word that makes it critical; around it a box that scores by what it holds.
_INNER = """concat('<section', case p_size % 3 when 0 then '' when 1 then ' class=\"entry\"' else ' class=\"entry body\"' end, case when p_partkey % 3 = 0 then ' aria-label=\"related things\"' else '' end, '>',
 case p_size % 4 when 0 then '' when 1 then '<h3>About</h3>' when 2 then '<h3>Subscribe</h3>' else '<h3>Menu</h3><h4>Comments</h4>' end,
 case when p_partkey % 2 = 0 then concat('<table><tr>', case when p_size % 7 = 0 then '<td>Key</td>' else '<th>Key</th>' end, '</tr><tr><td>v', p_size, '</td></tr></table>') else '' end,
 '<p>', case when p_size % 11 = 0 then 'royalty due' else 'plain words' end, '</p></section>')"""
_SECTIONS = f"""concat('<html><body><nav>Links</nav><div><p>Note ', p_size, '</p>', {_INNER}, '<span> </span></div><div role=\"navigation\">gone</div><article><p>Last</p></article></body></html>')"""


@query(f"""with s as (select p_partkey as page_id, p_size, {_INNER} as section, p_size % 11 = 0 as critical,
  case p_size % 4 when 0 then 0 when 1 then 10 when 2 then -8 else -16 end + case when p_partkey % 2 = 0 and p_size % 7 <> 0 then 8 else 0 end as held,
  5 * (p_size % 3) - case when p_partkey % 3 = 0 then 6 else 0 end as named from part),
k as (select *, critical or held >= 0 as box, critical or held >= 0 and held + named >= 0 as kept_section from s)
select page_id, 1 + case when box then 1 else 0 end + case when kept_section then 1 else 0 end as kept, 3 - case when kept_section then 1 else 0 end as removed,
 '<html><body>' || case when box then '<div><p>Note ' || p_size || '</p>' || case when kept_section then section else '' end || '</div>' else '' end || '<article><p>Last</p></article></body></html>' as filtered from k""".replace('\\"', '"'))
def prune_sections(spark, sf_dir):
    """Sections on both sides of every weight: names, headings, tables and critical words, and a box that goes with what it holds."""
    done = pages_with(_part_pages(spark, sf_dir, _SECTIONS), want=["filtered", "kept", "removed"])
    return done.select("page_id", "page.kept", "page.removed", "page.filtered")


_LAYOUT = """concat('<html><body>', case p_size % 8
 when 0 then concat('<dl><dt>Why ', p_size, '?</dt><dd>So.</dd><dt>Kind</dt><dd>', p_type, '</dd></dl>')
 when 1 then concat('<table><tr><td>Kind</td><td>', p_type, '</td></tr><tr><td>alone</td></tr></table>')
 when 2 then concat('<h3>Given</h3><ul><li>✓ one</li><li>✓ two ', p_size, '</li></ul>')
 when 3 then concat('<div><b>', p_size, ' years</b><span>Age</span></div>')
 when 4 then concat('<div><p>Kind: ', p_type, '</p><p>Size: ', p_size, '</p><p>Maker: ', p_brand, '</p></div>')
 when 5 then concat('<h2>On kinds</h2><p>Made as ', p_type, '.</p>')
 when 6 then concat('<table><tr><th>Kind:</th><th>Size</th></tr><tr><td>', p_type, '</td><td>', p_size, '</td></tr><tr><td>b</td><td>2</td></tr></table>')
 else concat('<ul><li>Kind: ', p_type, '</li><li>Size: ', p_size, '</li></ul><h4>What is ', p_size, '?</h4><p>A size.</p>') end, '</body></html>')"""


@query("""with l as (select p_partkey as page_id, unnest(case p_size % 8
 when 0 then [['QA Layout', 'dl', 'Why ' || p_size || '?=So.|Kind=' || p_type]]
 when 1 then [['Specification Layout', 'table', 'Kind=' || p_type]]
 when 2 then [['Checklist Layout', 'ul', 'Given=one+two ' || p_size], ['Content Section', 'h3', 'Given=✓ one+✓ two ' || p_size]]
 when 3 then [['Statistic Layout', 'div', 'Age=' || p_size || ' years']]
 when 4 then [['Summary Layout', 'div', 'Kind=' || p_type || '|Size=' || p_size || '|Maker=' || p_brand]]
 when 5 then [['Content Section', 'h2', 'On kinds=Made as ' || p_type || '.']]
 when 6 then [['Specification Layout', 'table', 'kind=' || p_type || '|size=' || p_size || '|kind=b|size=2']]
 else [['Specification Layout', 'ul', 'Kind=' || p_type || '|Size=' || p_size], ['QA Layout', 'h4', 'What is ' || p_size || '?=A size.']] end) as x from part)
select page_id, x[1] as type, x[2] as tag, x[3] as pairs from l""")
def layout_kinds(spark, sf_dir):
    """Every kind of layout, with the pairs that it states."""
    found = exploded(pages_with(_part_pages(spark, sf_dir, _LAYOUT), want=["layouts"]), ["page_id"], "page.layouts", "idx", "l")
    said = F.transform("l.pairs", lambda p: F.concat(p["k"], F.lit("="), F.coalesce(p["v"], F.array_join(p["v_list"], "+"))))
    return found.select("page_id", "l.type", "l.tag", F.array_join(said, "|").alias("pairs"))


_ITEM = "'<li>item {k} ', repeat('x', 40), '</li>'"
_LONG = f"""concat('<html><body><h2>Size ', p_size, '</h2><p>', repeat('ab ', p_size), '</p>loose ', p_size, '<ul>', {", ".join(_ITEM.format(k=k) for k in range(4))}, '</ul><h3>More</h3><div>', repeat('y', 990 + p_size * 20), '</div></body></html>')"""


@query(f"""with c as (select p_partkey as page_id, p_size, unnest([['H2', '', '<h2>Size ' || p_size || '</h2>'], case when (7 + 3 * p_size) // 4 <= 35 then ['P', '0', '<p>' || repeat('ab ', p_size) || '</p>'] else ['WINDOW', '0', trim(repeat('ab ', p_size))] end, ['TEXT', '0', 'loose ' || p_size],
  ['UL', '0', concat('<ul>', {_ITEM.format(k=0)}, {_ITEM.format(k=1)}, '</ul>')], ['UL', '0', concat('<ul>', {_ITEM.format(k=2)}, {_ITEM.format(k=3)}, '</ul>')], ['H3', '0', '<h3>More</h3>'], ['WINDOW', '1', repeat('y', least(1000, 990 + p_size * 20))], ['WINDOW', '1', repeat('y', greatest(0, p_size * 20 - 10))]]) as x,
  unnest(range(8)) as idx from part)
select page_id, idx, x[1] as chunk_type, case x[2] when '' then '' when '1' then 'More' else 'Size ' || p_size end as path, x[3] as html, greatest(1, length(x[3]) // 4) as n_tokens from c where x[3] <> ''""")
def chunk_edges(spark, sf_dir):
    """A page in pieces: whole elements, halves of a list, loose text, and windows of what has no parts."""
    cut = _part_pages(spark, sf_dir, _LONG).select("page_id", chunked(F.col("html"), 35).alias("chunks"))
    c = exploded(cut, ["page_id"], "chunks", "idx", "c")
    return c.select("page_id", "idx", "c.chunk_type", F.array_join("c.heading_path", " > ").alias("path"), "c.html", "c.n_tokens")


_SAID = "concat(case o_orderkey % 5 when 0 then 'alpha ' when 1 then 'alpha beta ' else 'gamma ' end, repeat('x', cast(o_orderkey % 97 * 30 as int)))"


@query(f"""with recursive b as (select o_custkey // 3 as page_id, o_orderkey, length({_SAID}) as n, case o_orderkey % 5 when 0 then 15 when 1 then 30 else 0 end as score from orders),
r as (select page_id, row_number() over (partition by page_id order by o_orderkey) - 1 as idx, row_number() over (partition by page_id order by score desc, o_orderkey) as k, greatest(5, (n + 33) // 4) as tokens, score from b),
g(page_id, k, idx, used, picked, n) as (select page_id, k, idx, case when tokens <= 4000 or score > 20 then tokens else 0 end, tokens <= 4000 or score > 20, case when tokens <= 4000 or score > 20 then 1 else 0 end from r where k = 1
 union all select r.page_id, r.k, r.idx, g.used + case when g.used + r.tokens <= 4000 or r.score > 20 and g.used < 6000 then r.tokens else 0 end, g.used + r.tokens <= 4000 or r.score > 20 and g.used < 6000,
  g.n + case when g.used + r.tokens <= 4000 or r.score > 20 and g.used < 6000 then 1 else 0 end from g join r on r.page_id = g.page_id and r.k = g.k + 1),
t as (select *, max(n) over (partition by page_id) as total from g)
select page_id, string_agg(idx::varchar, ',' order by idx) filter (where picked or total < 10 and k <= 15) as chosen from t group by 1""")
def budget_blocks(spark, sf_dir):
    """Which paragraphs fit a prompt's budget: the best first, some over it if they are good, and the best fifteen where few fit."""
    o = table(spark, sf_dir, "orders").select(F.expr("o_custkey div 3").alias("page_id"), "o_orderkey", F.expr(_SAID).alias("said"))
    empty = {f.name: F.lit(None).cast(f.dataType) for f in BLOCKS.elementType.fields}
    made = lambda x: F.struct(*[(F.lit("paragraph") if n == "type" else x["said"] if n == "text" else v).alias(n) for n, v in empty.items()])
    pages = o.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "said"))), made).alias("blocks"))
    return pages.select("page_id", F.array_join(chosen_blocks(F.col("blocks"), {"alpha", "beta"}), ",").alias("chosen"))
