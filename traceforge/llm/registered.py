"""Queries of the pipeline operators, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from traceforge.llm import (
    decontaminate,
    html_text,
    language,
    lattice_lm,
    packing,
    pii,
    quality,
    ranked_search,
    simhash,
    spelling,
    substring_dedup,
    topk,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(query):
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_substring_dedup(spark, sf_dir):
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op2_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.hex("fingerprint")))


@register
def op3_packing(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, with_ids=False).drop("boundary")


@register
def op4_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op4_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 5
"""


@register
def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = language.held_out(F.col("doc_id"), 4, 2)
    languages, matrix = language.fit(docs.where(~held_out))
    return language.predict(docs, languages, matrix, [F.col("doc_id"), held_out.alias("held_out")])


@register
def op5_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = language.held_out(F.col("doc_id"), 3, 1)
    model = quality.fit(docs.where(~held_out), labels.where(~held_out))
    return quality.score(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


@register
def op8_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, [pages["page_id"], pages["url"]])


@register
def op9_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), [F.col("page_id")])


def _quoted(*values: str) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


ORACLE["op9_url_filter"] = f"""
with site(verdict, host, path) as (values {', '.join(_quoted(r.verdict, r.host, r.path) for r in url_filter.SITE_RULES)}),
pattern(nth, verdict, name, expression) as (values {', '.join(f'({i}, ' + _quoted(r.verdict, r.name, r.pattern)[1:] for i, r in enumerate(url_filter.PATTERN_RULES))}),
rest as (
  select row_number() over () as row, page_id,
    case when coalesce(position('://' in url), 0) > 0 then substr(url, position('://' in url) + 3) else '' end as rest
  from pages
),
parts as (
  select row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.ascii_uppercase}', '{url_filter.ascii_lowercase}') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from rest
),
sites as (
  select p.row, s.verdict, s.host || s.path as rule,
    row_number() over (partition by p.row order by length(s.host || s.path) desc) as nth
  from parts p join site s
    on (p.host = s.host or ends_with(p.host, '.' || s.host)) and starts_with(p.path, s.path)
),
patterns as (
  select p.row, t.verdict, t.name, row_number() over (partition by p.row order by t.nth) as nth
  from parts p join pattern t
    on regexp_matches(translate(p.host || p.path, '{url_filter.ascii_uppercase}', '{url_filter.ascii_lowercase}'), t.expression)
)
select p.page_id, p.host, p.path, s.rule, coalesce(s.verdict, t.verdict, 'allow') as verdict,
  case when s.rule is null then t.name end as pattern
from parts p
left join sites s on s.row = p.row and s.nth = 1
left join patterns t on t.row = p.row and t.nth = 1
"""


@register
def op7_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op6_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    counts = [f"n_{kind}" for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


@register
def op11_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = language.held_out(F.col("doc_id"), 10, 0)
    model = lattice_lm.fit(docs, held_out, public_tokenizers.path("piece_bpe_32k.model"))
    return lattice_lm.score(docs, model, keep=(held_out.alias("held_out"),))


@register
def op12_ranked_search(spark, sf_dir):
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _terms_sql(text: str) -> str:
    return (
        f"regexp_extract_all(translate({text}, '{url_filter.ascii_uppercase}', '{url_filter.ascii_lowercase}'), "
        r"'[0-9a-z\x{80}-\x{10FFFF}]+')"
    )


ORACLE["op12_ranked_search"] = f"""
with d as (select row_number() over () as row, doc_id, {_terms_sql('text')} as terms from documents where text is not null),
held as (select row, doc_id, terms, len(terms)::bigint as n from d where len(terms) > 0),
corpus as (select count(*)::bigint as docs, sum(n)::bigint as total from held),
item as (select row_number() over () as item, item_id, text from (select distinct item_id, text from benchmark where text is not null)),
asked as (select distinct item, item_id, unnest({_terms_sql('text')}) as term from item),
entry as (
  select row, term, count(*)::bigint as tf from (select row, unnest(terms) as term from held)
  where term in (select term from asked) group by row, term
),
weight as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from entry, corpus group by term
),
value as (
  select e.row, e.term, w.w * ((1000000000 * e.tf) // (1000 * e.tf + 20 * (100 - 50 + (50 * h.n * c.docs) // c.total))) as v
  from entry e join held h on e.row = h.row join weight w on w.term = e.term, corpus c
),
scored as (
  select a.item, a.item_id, h.doc_id, sum(v.v)::bigint as score
  from asked a join value v on a.term = v.term join held h on h.row = v.row
  group by a.item, a.item_id, v.row, h.doc_id having sum(v.v) > 0
)
select item_id, rank::integer as rank, doc_id, score
from (select *, row_number() over (partition by item order by score desc, doc_id nulls last) as rank from scored)
where rank <= 50
"""


@register
def op13_spelling(spark, sf_dir):
    return spelling.group_variants(spelling.corpus_words(table(spark, sf_dir, "documents"), misspell=31))
