"""Registered queries: title lookup, top-k, relevance and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinium.functions import text as tx
from affinium.functions import vectors as vec
from affinium.operators import lookup, topk
from affinium.operators.metrics import metrics_at_k, query_metrics
from affinium.operators.pruned import rank_pruned
from affinium.operators.relevance import (
    mark_hits,
    overlapping_pairs,
    overlaps_per_signature,
    relevant_counts,
    signature_counts,
)
from affinium.plans import runs
from affinium.plans.registered import register
from affinium.plans.registered import sql as q
from affinium.plans.runs import evaluate_variants
from affinium.session import fresh_path, materialise
from affinium.sources import tables as tb
from affinium.sources.store import Run

TITLES = ["SMALL ring brand#2", "gizmo Brand#1", "Brand#25", "a.c", "red"]
TITLES_SQL = "[" + ", ".join(f"'{title}'" for title in TITLES) + "]"


def matched(query: str, source: str) -> str:
    """First exact, else first substring match of one title."""
    return (
        f"(select row_id from {source} where contains(lower(title), lower({query})) "
        f"order by (lower(title) <> lower({query}))::int, row_id limit 1)"
    )


def queries_of(items):
    return items.select(F.col("row_id").alias("q_id"), "embedding")


def ranking(spark, folder, k=10):
    items = tb.labelled_vectors(spark, folder)
    return topk.rank_catalog(queries_of(items), items, k)


@register("flt8_find_title", f"""with {q.CATALOG}, w as (select unnest({TITLES_SQL}) query),
m as (select query, row_id, (lower(title) <> lower(query))::int cls
      from w join catalog on contains(lower(title), lower(query)))
select query, row_id from m qualify row_number() over (partition by query order by cls, row_id) = 1""")
def flt8(spark, folder):
    return lookup.match_titles(tb.catalog(spark, folder), TITLES)


# Whole titles, pieces of them in other case, short pieces and unknown titles: thousands, from the tables themselves.
ASKED = ["concat(p_name, ' ', p_brand)", "upper(p_name)", "substr(p_brand, 3, 20)", "substr(concat(p_name, ' ', p_brand), 4, 9)",
         "substr(p_name, 2, 2)", "substr(p_name, 1, 1)", "concat(p_name, '!')", "p_type", "substr(p_name, 50, 3)"]


def asked_titles(spark, folder):
    part = tb.table(spark, folder, "part")
    return part.select(F.explode(F.array(*[F.expr(e) for e in ASKED])).alias("query")).distinct()


@register("flt8_title_table", f"""with {q.CATALOG}, w as (select distinct unnest([{", ".join(ASKED)}]) query from part),
names as (select lower(title) n, min(row_id) row_id from catalog group by 1),
m as (select query, row_id, (n <> lower(query))::int cls from w join names on contains(n, lower(query)))
select query, row_id from m qualify row_number() over (partition by query order by cls, row_id) = 1""")
def flt8_table(spark, folder):
    return lookup.match_title_table(tb.catalog(spark, folder), asked_titles(spark, folder))


@register("top1_similar_titles", f"""with {q.INDEX}, w as (select distinct unnest([{", ".join(ASKED)}]) query from part),
names as (select lower(title) n, min(row_id) row_id from indexed group by 1),
m as (select query, row_id, (n <> lower(query))::int cls from w join names on contains(n, lower(query))),
asked as (select query, row_id from m qualify row_number() over (partition by query order by cls, row_id) = 1),
scored as (select a.row_id q_id, c.row_id, round(list_inner_product(a.embedding, c.embedding), 9) score
  from indexed a join indexed c on a.row_id <> c.row_id where a.row_id in (select row_id from asked)),
ranked as (select *, row_number() over (partition by q_id order by score desc, row_id) "rank" from scored)
select query, r.row_id, round(score, 6) score, "rank"::int "rank" from asked join ranked r on r.q_id = asked.row_id where "rank" <= 5""")
def top1_titles(spark, folder):
    index = stored_index(spark, folder)
    found = runs.similar_titles(index, asked_titles(spark, folder), 5)
    return found.select("query", "row_id", F.round("score", 6).alias("score"), "rank")


@register("flt9_index_guard", f"""with {q.INDEX} select (select count(*) from catalog) catalog_rows,
    count(*) index_rows, count(*) filter (len(embedding) <> 64) wrong_dim,
    (select count(*) from catalog where row_id not in (select row_id from indexed)) not_indexed from indexed""")
def flt9(spark, folder):
    catalog = materialise(tb.catalog(spark, folder), "catalog")
    index = catalog.join(tb.vectors(spark, folder), "row_id")
    return lookup.index_report(index, catalog, 64)


def stored_index(spark, folder):
    run = Run(spark, fresh_path(spark, "run"))
    run.save_index(tb.indexed_catalog(spark, folder))
    return run.index()


@register("snk4_build_index", f"with {q.INDEX} select row_id, title, genres, len(embedding)::int dim from indexed")
def snk4(spark, folder):
    return stored_index(spark, folder).select("row_id", "title", "genres", F.size("embedding").alias("dim"))


@register("src7_load_index", f"with {q.INDEX} select row_id, title, genres, []::varchar[] \"cast\", director from indexed")
def src7(spark, folder):
    run = Run(spark, fresh_path(spark, "run"))
    run.save_index(tb.indexed_catalog(spark, folder).drop("cast"))
    return run.index().select("row_id", "title", "genres", "cast", "director")


@register("jn8_catalog_vectors", f"with {q.INDEX} select row_id, title, round(list_sum(embedding), 5) total from indexed")
def jn8(spark, folder):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return tb.indexed_catalog(spark, folder).select("row_id", "title", F.round(total, 5).alias("total"))


SIMILAR = f"""{q.INDEX},
query as (select * from indexed where row_id = {matched("'ring'", "indexed")}),
result as (
  select i.row_id, i.title, i."year", i.genres, i.rating,
         round(list_inner_product(i.embedding, query.embedding), 9) score
  from indexed i, query where i.row_id <> query.row_id order by score desc, i.row_id limit 10)"""


def similar_items(spark, folder):
    index = materialise(tb.indexed_catalog(spark, folder), "index")
    return topk.similar_to_row(index, lookup.find_item(index, "ring"), 10)


@register("top1_similar_by_title", f"with {SIMILAR} select row_id, score from result")
def top1(spark, folder):
    return similar_items(spark, folder).select("row_id", "score")


@register("prj10_result_columns", f"with {SIMILAR} select title, \"year\", genres, round(rating, 6) rating, "
          "score from result")
def prj10(spark, folder):
    return topk.present(similar_items(spark, folder)).withColumn("rating", F.round("rating", 6))


@register("jn7_query_scores", f"""with {q.VECTORS}
select v.row_id, round(list_inner_product(v.embedding, w.embedding), 9) score
from vectors v, vectors w where w.row_id = (select min(row_id) from vectors)""")
def jn7(spark, folder):
    items = tb.labelled_vectors(spark, folder)
    first = items.orderBy("row_id").first()
    scored = topk.scores(items, topk.query_vector(first["embedding"]))
    return scored.select("row_id", "score")


@register("top3_cosine_top_k", f"""with {q.VECTORS}
select v.row_id, round(list_cosine_similarity(v.embedding, w.embedding), 9) score
from vectors v, vectors w where w.row_id = (select max(row_id) from vectors)
order by round(list_cosine_similarity(v.embedding, w.embedding), 9) desc, v.row_id limit 3""")
def top3(spark, folder):
    items = tb.labelled_vectors(spark, folder)
    last = items.orderBy(F.desc("row_id")).first()
    scored = topk.scores(items, topk.query_vector(last["embedding"]), vec.cosine)
    return topk.top_k(scored, 3).select("row_id", "score")


@register("top4_batch_ranking", f'with {q.RANKING} select q_id, row_id, score, "rank" from ranking')
def top4(spark, folder):
    return ranking(spark, folder).withColumn("rank", F.col("rank").cast("long"))


@register("top4_pruned_ranking", f'with {q.RANKING} select q_id, row_id, score, "rank" from ranking')
def top4_pruned(spark, folder):
    """The same by pivots and bounds; blocks of a size that small tables have several of."""
    items = tb.labelled_vectors(spark, folder)
    ranked, _ = rank_pruned(queries_of(items), items, 10, block_items=256)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


@register("top4_block_grid_ranking", f'with {q.RANKING} select q_id, row_id, score, "rank" from ranking')
def top4_grid(spark, folder):
    """The same ranking by the path for query tables beyond the broadcast limit."""
    items = tb.labelled_vectors(spark, folder)
    ranked = topk.rank_catalog(queries_of(items), items, 10, block_rows=256)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


@register("win2_rank_scores", """with s as (
  select l_suppkey q_id, l_partkey row_id, sum(l_quantity) score from lineitem group by 1, 2)
select q_id, row_id, score, row_number() over (partition by q_id order by score desc, row_id) "rank"
from s qualify "rank" <= 10""")
def win2(spark, folder):
    scored = tb.table(spark, folder, "lineitem").groupBy(
        F.col("l_suppkey").alias("q_id"), F.col("l_partkey").alias("row_id")
    ).agg(F.sum("l_quantity").alias("score"))
    return topk.rank_by_score(scored, 10).withColumn("rank", F.col("rank").cast("long"))


@register("ml5_unit_vectors", f"""with {q.VECTORS}
select row_id, list_transform(embedding, lambda x: round(x / sqrt(list_inner_product(embedding, embedding)), 6)) unit
from vectors""")
def ml5(spark, folder):
    unit = vec.unit(F.col("embedding"))
    return tb.vectors(spark, folder).select("row_id", F.transform(unit, lambda x: F.round(x, 6)).alias("unit"))


GENRES = f"""{q.RAW},
items as (select row_id, {q.split_list('"Genres"')} genres from catalog_raw)"""


def genre_items(spark, folder):
    return tb.catalog_raw(spark, folder).select("row_id", tx.split_list(F.col("Genres")).alias("genres"))


@register("jn5_overlapping_pairs", f"""with {GENRES}
select count(*) n_pairs from items a join items b on a.row_id <> b.row_id and list_has_any(a.genres, b.genres)""")
def jn5(spark, folder):
    return overlapping_pairs(genre_items(spark, folder))


@register("jn5_wide_sets", f"""with {q.RAW}, items as (select row_id, string_split("Cast", ',') genres from catalog_raw)
select a.row_id, count(b.row_id) n_relevant
from items a left join items b on a.row_id <> b.row_id and list_has_any(a.genres, b.genres) group by 1""")
def jn5_wide(spark, folder):
    """Sets too wide for subset counting: shared cast members by bitmaps."""
    items = tb.catalog_raw(spark, folder).select("row_id", F.split("Cast", ",").alias("genres"))
    return relevant_counts(items)


@register("agg7_relevant_counts", f"""with {GENRES}
select a.row_id, count(b.row_id) n_relevant
from items a left join items b on a.row_id <> b.row_id and list_has_any(a.genres, b.genres) group by 1""")
def agg7(spark, folder):
    return relevant_counts(genre_items(spark, folder))


@register("set1_overlap_by_signature", f"""with {GENRES},
s as (select list_sort(list_distinct(genres)) sig, count(*) n_items from items group by 1)
select a.sig, any_value(a.n_items) n_items, sum(b.n_items)::bigint n_overlapping
from s a join s b on list_has_any(a.sig, b.sig) group by 1""")
def set1(spark, folder):
    return overlaps_per_signature(signature_counts(genre_items(spark, folder)))


@register("flt6_queries_with_relevant", f"""with {GENRES}
select distinct a.row_id q_id from items a join items b on a.row_id <> b.row_id and list_has_any(a.genres, b.genres)""")
def flt6(spark, folder):
    counted = relevant_counts(genre_items(spark, folder))
    return counted.filter("n_relevant > 0").select(F.col("row_id").alias("q_id"))


@register("agg8_retrieval_metrics", f"with {q.RANKING}, {q.RELEVANT} {q.metrics('ranking')}")
def agg8(spark, folder):
    items = tb.labelled_vectors(spark, folder)
    hits = mark_hits(ranking(spark, folder), items)
    return metrics_at_k(hits, relevant_counts(items)).withColumn("value", F.round("value", 6))


@register("agg8_query_metrics", f"""with {q.RANKING}, {q.RELEVANT},
hits as (
  select q_id, "rank", list_has_any(a.genres, b.genres) hit, n_relevant
  from ranking r join vectors a on a.row_id = q_id join vectors b on b.row_id = r.row_id
       join relevant v on v.row_id = q_id where n_relevant > 0)
select q_id, count(*) filter (hit) / 10 precision_10,
       round(count(*) filter (hit) / any_value(n_relevant), 6) recall_10,
       round(coalesce(1 / min("rank") filter (hit), 0), 6) mrr_10
from hits group by 1""")
def agg8_per_query(spark, folder):
    items = tb.labelled_vectors(spark, folder)
    hits = mark_hits(ranking(spark, folder), items)
    table = query_metrics(hits, relevant_counts(items))
    return table.select(
        "q_id", F.col("`Precision@10`").alias("precision_10"),
        F.round("`Recall@10`", 6).alias("recall_10"), F.round("`MRR@10`", 6).alias("mrr_10"),
    )


HALF = """
half as (select row_id, genres, embedding[1:32] embedding from vectors),
halves as (
  select row_id, genres, list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding)))
         embedding from half),
scored_half as (
  select q.row_id q_id, c.row_id, round(list_inner_product(q.embedding, c.embedding), 9) score
  from halves q, halves c where q.row_id <> c.row_id),
variant_ranking as (
  select 'full' variant, q_id, row_id, "rank" from ranking
  union all
  select 'half', q_id, row_id, row_number() over (partition by q_id order by score desc, row_id) "rank"
  from scored_half qualify "rank" <= 10)"""


def two_variants(spark, folder):
    items = tb.labelled_vectors(spark, folder)
    half = items.withColumn("embedding", vec.unit(F.slice("embedding", 1, 32)))
    return items, {"full": items, "half": half}


@register("ml8_variant_metrics", f"with {q.RANKING}, {q.RELEVANT}, {HALF} {q.metrics('variant_ranking', 'variant')}")
def ml8(spark, folder):
    items, variants = two_variants(spark, folder)
    return evaluate_variants(variants, items).withColumn("value", F.round("value", 6))


@register("snk8_evaluation_report", f"with {q.RANKING}, {q.RELEVANT}, {HALF} {q.metrics('variant_ranking', 'variant')}")
def snk8(spark, folder):
    items, variants = two_variants(spark, folder)
    run = Run(spark, fresh_path(spark, "run"))
    run.save_evaluation(evaluate_variants(variants, items))
    return run.evaluation().drop("run").withColumn("value", F.round("value", 6))
