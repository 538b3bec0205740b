"""Registered queries: landed responses, collection, incremental ingest, comparison, projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinium import fixed
from affinium.functions import vectors as vec
from affinium.operators import collecting, comparison, topk
from affinium.operators.blocks import block_count
from affinium.operators.metrics import metrics_at_k
from affinium.operators.projection import embedding_map, principal_components, result_map
from affinium.operators.relevance import mark_hits, relevant_counts
from affinium.plans.registered import register
from affinium.plans.registered import sql as q
from affinium.plans.registered.retrieve import HALF, queries_of, two_variants
from affinium.session import fresh_path, materialise
from affinium.sources import landed as ld
from affinium.sources import tables as tb
from affinium.streaming import ingest as st

# --- film API ---------------------------------------------------------------


def landed_films(spark, folder):
    """One landed response per part: the lookup of promotional items failed, some
    titles resolve to a canonical one, and fields without a value are absent."""
    raw = tb.catalog_raw(spark, folder)
    promo = F.col("Genres").startswith("PROMO")
    canonical = F.when(F.col("Genres").startswith("SMALL"), F.initcap("Title")).otherwise(F.col("Title"))
    reply = F.struct(
        F.when(promo, "False").otherwise("True").alias("Response"), canonical.alias("Title"),
        F.substring_index("Release Date", ", ", -1).alias("Year"), F.col("Genres").alias("Genre"),
        F.col("Description").alias("Plot"), F.lit("feature").alias("Type"),
    )
    return raw.select(
        F.col("row_id").alias("seq"), F.col("Title").alias("requested"), F.to_json(reply).alias("body")
    )


# initcap on words: first letter up, the rest down, as Spark does on spaces.
INITCAP = (
    "array_to_string(list_transform(string_split(\"Title\", ' '), "
    "lambda w: upper(w[1]) || lower(w[2:])), ' ')"
)
FILMS = f"""{q.RAW},
films as (
  select row_id seq, "Title" requested,
         case when "Genres" like 'SMALL%' then {INITCAP} else "Title" end "Title",
         right("Release Date", 4) "Year", "Genres" "Genre", coalesce("Description", 'N/A') "Description"
  from catalog_raw where "Genres" not like 'PROMO%')"""


@register("src4_film_records", f"with {FILMS} select * from films")
def src4(spark, folder):
    return ld.film_records(landed_films(spark, folder))


@register("jn9_failed_titles", f'with {FILMS} select distinct "Title" requested from catalog_raw '
          'where "Title" not in (select requested from films)')
def jn9(spark, folder):
    landed = landed_films(spark, folder)
    return collecting.failed_titles(landed.select("requested").distinct(), ld.film_records(landed))


def english_titles(spark, folder):
    """Titles already collected: those with an English description."""
    documents = tb.table(spark, folder, "documents").filter("lang = 'en'")
    raw = tb.catalog_raw(spark, folder)
    return raw.join(documents, F.col("row_id") == F.col("doc_id"), "left_semi").select("Title")


KNOWN = f"""{FILMS},
known as (
  select distinct lower("Title") known from catalog_raw
  where row_id in (select doc_id from documents where lang = 'en'))"""


@register("set3_known_titles", f"""with {KNOWN} select known from known
    union select lower(s_name) from supplier""")
def set3(spark, folder):
    return collecting.known_titles(english_titles(spark, folder), tb.table(spark, folder, "supplier").select("s_name"))


@register("jn1_new_records", f"""with {KNOWN} select seq, requested, "Title" from films
    where lower(requested) not in (from known) and lower("Title") not in (from known)
    qualify row_number() over (partition by lower("Title") order by seq) = 1""")
def jn1(spark, folder):
    known = collecting.known_titles(english_titles(spark, folder))
    fresh = collecting.new_records(ld.film_records(landed_films(spark, folder)), known)
    return fresh.select("seq", "requested", "Title")


@register("set4_append_results", f"""with {FILMS} select requested, "Title" from films
    union all select requested, "Title" from films where "Genre" like 'LARGE%'""")
def set4(spark, folder):
    """Results of two calls appended: all titles, then the large ones again."""
    path = fresh_path(spark, "results")
    landed = landed_films(spark, folder)
    ld.film_records(landed).select("requested", "Title").write.mode("append").parquet(path)
    again = ld.film_records(landed).filter(F.col("Genre").startswith("LARGE"))
    again.select("requested", "Title").write.mode("append").parquet(path)
    return spark.read.parquet(path)


# Titles of landed responses are dealt to files of about this many rows, four at least.
LANDED_ROWS = 100_000


@register("str1_incremental_ingest", f"""with {KNOWN} select seq, requested, "Title" from films
    where lower(requested) not in (from known) and lower("Title") not in (from known)
    qualify row_number() over (partition by lower("Title") order by seq) = 1""")
def str1(spark, folder):
    """All responses landed in title-disjoint files, streamed in twice; the second run adds nothing."""
    source, target, checkpoint = (fresh_path(spark, name) for name in ("landed", "collected", "checkpoint"))
    files = max(4, block_count(tb.table(spark, folder, "part").count(), LANDED_ROWS))
    parts = landed_films(spark, folder).repartition(files, F.lower("requested"))
    parts.write.json(source)
    ignore = materialise(collecting.known_titles(english_titles(spark, folder)), "known")
    for _ in range(2):
        # Two batches, whatever the number of files.
        landed = st.read_landed(spark, source, files_per_batch=-(-files // 2))
        st.ingest(landed, target, checkpoint, ignore).awaitTermination()
    return spark.read.parquet(target).select("seq", "requested", "Title")


# --- encyclopedia -------------------------------------------------------------


def first_items(spark, folder):
    """Lowest row of each title."""
    raw = tb.catalog_raw(spark, folder)
    return raw.groupBy("Title").agg(F.min_by(F.struct("*"), "row_id").alias("r")).select("r.*")


ITEMS = f"""{q.RAW},
items as (select * from catalog_raw qualify row_number() over (partition by "Title" order by row_id) = 1)"""


def item_id(row_id="row_id"):
    return F.concat(F.lit("Q"), F.col(row_id).cast("string"))


def landed_pages(items):
    """Responses per candidate page: economy items have a film page besides the bare
    one, promotional items have no page, small ones lack a knowledge-base item."""
    economy, promo = F.col("Genres").startswith("ECONOMY"), F.col("Genres").startswith("PROMO")
    film = F.concat(F.col("Title"), F.lit(" (film)"))

    def response(title, missing, item):
        page = F.struct(title.alias("title"), F.col("Description").alias("extract"), missing.alias("missing"),
                        F.struct(item.alias("wikibase_item")).alias("pageprops"))
        pages = F.create_map(F.col("row_id").cast("string"), page)
        return F.to_json(F.struct(F.struct(pages.alias("pages")).alias("query")))

    small = F.col("Genres").startswith("SMALL")
    bare = items.select(
        F.col("Title").alias("candidate"),
        response(F.col("Title"), F.when(promo, ""), F.when(~small, item_id())).alias("body"),
    )
    films = items.filter(economy).select(
        film.alias("candidate"), response(film, F.lit(None).cast("string"), item_id()).alias("body")
    )
    return bare.unionByName(films)


def landed_claims(items):
    """Claims per item; medium items answer with broken JSON, large ones without a date."""
    stamp = F.date_format(F.to_date("Release Date", "MMM d, yyyy"), "'+'yyyy-MM-dd'T00:00:00Z'")

    def claim(time=None, entity=None):
        value = F.struct(
            (time if time is not None else F.lit(None).cast("string")).alias("time"),
            (entity if entity is not None else F.lit(None).cast("string")).alias("id"),
        )
        return F.struct(F.struct(F.struct(value.alias("value")).alias("datavalue")).alias("mainsnak"))

    dated = F.when(~F.col("Genres").startswith("LARGE"), F.array(claim(time=stamp)))
    people = F.array(claim(entity=F.col("Directed by")), claim(entity=F.col("Written by")))
    genres = F.transform(F.split("Genres", ", "), lambda g: claim(entity=g))
    claims = F.struct(dated.alias("P577"), people.alias("P57"), genres.alias("P136"))
    body = F.to_json(F.struct(F.create_map(item_id(), F.struct(claims.alias("claims"))).alias("entities")))
    broken = F.when(F.col("Genres").startswith("MEDIUM"), F.lit("{oops")).otherwise(body)
    return items.select(item_id().alias("item"), broken.alias("body"))


def landed_labels(items):
    """Labels of all genres but standard, of the directors, not of the writers."""
    genres = items.select(F.explode(F.split("Genres", ", ")).alias("entity")).filter("entity <> 'STANDARD'")
    entities = genres.union(items.select("Directed by")).distinct()
    label = F.struct(F.struct(F.struct(F.concat(F.lit("the "), F.col("entity")).alias("value")).alias("en")).alias("labels"))
    return entities.select("entity", F.to_json(F.struct(F.create_map("entity", label).alias("entities"))).alias("body"))


def pages_and_claims(spark, folder):
    items = materialise(first_items(spark, folder), "items")
    requests = items.select(F.col("Title").alias("requested"))
    return (
        requests, ld.valid_pages(landed_pages(items)), ld.item_claims(landed_claims(items)),
        ld.entity_labels(landed_labels(items)),
    )


@register("flt5_valid_pages", f"""with {ITEMS}
select "Title" candidate, "Title" title, 'Q' || row_id item from items
where "Genres" not like 'PROMO%' and "Genres" not like 'SMALL%'
union all select "Title" || ' (film)', "Title" || ' (film)', 'Q' || row_id from items where "Genres" like 'ECONOMY%'""")
def flt5(spark, folder):
    return ld.valid_pages(landed_pages(first_items(spark, folder))).select("candidate", "title", "item")


@register("jn2_first_page", f"""with {ITEMS}
select "Title" requested, case when "Genres" like 'ECONOMY%' then "Title" || ' (film)' else "Title" end title,
       'Q' || row_id item from items where "Genres" not like 'PROMO%' and "Genres" not like 'SMALL%'""")
def jn2(spark, folder):
    items = materialise(first_items(spark, folder), "items")
    pages = ld.valid_pages(landed_pages(items))
    return ld.choose_pages(items.select(F.col("Title").alias("requested")), pages).select("requested", "title", "item")


@register("prj19_nested_claims", f"""with {ITEMS}
select 'Q' || row_id item, case when "Genres" not like 'LARGE%' then
         strftime(strptime("Release Date", '%b %-d, %Y'), '+%Y-%m-%dT00:00:00Z') end "time",
       ["Directed by", "Written by"] directors, string_split("Genres", ', ') genres
from items where "Genres" not like 'MEDIUM%'""")
def prj19(spark, folder):
    return ld.item_claims(landed_claims(first_items(spark, folder)))


GENRE_LABELS = (
    "list_transform(list_filter(string_split(\"Genres\", ', '), lambda g: g <> 'STANDARD'), lambda g: 'the ' || g)"
)


@register("jn3_claim_labels", f"""with {ITEMS}
select 'Q' || row_id item, 'the ' || "Directed by" directors, array_to_string({GENRE_LABELS}, ', ') genres
from items where "Genres" not like 'MEDIUM%'""")
def jn3(spark, folder):
    _, _, claims, labels = pages_and_claims(spark, folder)
    return ld.with_labels(claims.drop("time"), "item", ["directors", "genres"], labels)


@register("src5_page_records", f"""with {ITEMS}
select "Title" requested, "Title",
       case when "Genres" like 'LARGE%' then 'N/A' else right("Release Date", 4) end "Year",
       'the ' || "Directed by" "Director", array_to_string({GENRE_LABELS}, ', ') "Genre",
       case when length("Description") > 500 then substring("Description", 1, 500) || '...'
            else coalesce("Description", '') end "Description",
       'https://en.wikipedia.org/wiki/' || url_encode(
         case when "Genres" like 'ECONOMY%' then "Title" || ' (film)' else "Title" end) "Wikipedia_URL"
from items where not regexp_matches("Genres", '^(PROMO|SMALL|MEDIUM)')""")
def src5(spark, folder):
    return ld.page_records(*pages_and_claims(spark, folder))


# --- comparison -----------------------------------------------------------------


def two_rankings(spark, folder, k=10):
    items, variants = two_variants(spark, folder)
    parts = [
        topk.rank_catalog(queries_of(vectors), vectors, k).withColumn("variant", F.lit(name))
        for name, vectors in variants.items()
    ]
    return items, parts[0].unionByName(parts[1])


@register("agg11_top_overlap", f"""with {q.RANKING}, {HALF},
titled as (select variant, q_id, p_name title from variant_ranking join part on row_id = p_partkey),
sets as (select q_id, variant, list(distinct title) titles from titled group by 1, 2)
select a.q_id::varchar query, a.variant run_a, b.variant run_b, len(list_intersect(a.titles, b.titles)) n_shared,
       round(len(list_intersect(a.titles, b.titles)) / 10, 6) shared_of_k,
       round(len(list_intersect(a.titles, b.titles)) / len(list_distinct(list_concat(a.titles, b.titles))), 6) jaccard
from sets a join sets b on a.q_id = b.q_id and a.variant = 'full' and b.variant = 'half'""")
def agg11(spark, folder):
    _, rankings = two_rankings(spark, folder)
    titles = tb.table(spark, folder, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("title"))
    tops = rankings.join(titles, "row_id").select(
        F.when(F.col("variant") == "full", 0).otherwise(1).alias("run_at"), F.col("variant").alias("run"),
        F.col("q_id").cast("string").alias("query"), "title",
    )
    table = comparison.top_overlap(tops, 10)
    return table.withColumns({name: F.round(name, 6) for name in ("shared_of_k", "jaccard")})


@register("set2_title_sets", f"""with {q.CATALOG},
s as (select director, "year", list(distinct title) titles from catalog group by 1, 2)
select a.director, a."year" year_a, b."year" year_b, len(list_intersect(a.titles, b.titles)) n_shared,
       len(list_distinct(list_concat(a.titles, b.titles))) n_united
from s a join s b on a.director = b.director and a."year" < b."year" """)
def set2(spark, folder):
    """Shared and united titles of every two years of a director, by counts: no set is ever collected."""
    titles = materialise(tb.catalog(spark, folder).select("director", "year", "title").distinct(), "titles")
    sizes = titles.groupBy("director", "year").agg(F.count("*").alias("n"))
    earlier, later = (
        sizes.select("director", F.col("year").alias(f"year_{side}"), F.col("n").alias(f"n_{side}")) for side in "ab"
    )
    both = (
        titles.withColumnRenamed("year", "year_a")
        .join(titles.withColumnRenamed("year", "year_b"), ["director", "title"]).filter("year_a < year_b")
        .groupBy("director", "year_a", "year_b").agg(F.count("*").alias("n_shared"))
    )
    pairs = earlier.join(later, "director").filter("year_a < year_b")
    shared = F.coalesce("n_shared", F.lit(0)).cast("long")
    return pairs.join(both, ["director", "year_a", "year_b"], "left").select(
        "director", "year_a", "year_b", shared.alias("n_shared"),
        (F.col("n_a") + F.col("n_b") - shared).alias("n_united"),
    )


def run_metrics(spark, folder):
    """Two evaluated runs: full vectors and the first half of each vector."""
    items, rankings = two_rankings(spark, folder)
    values = metrics_at_k(mark_hits(rankings, items), relevant_counts(items), by=["variant"])
    return values.select(F.col("variant").alias("run"), F.lit("baseline").alias("variant"), "metric",
                         F.round("value", 6).alias("value"))


@register("agg13_metric_table", f"""with {q.RANKING}, {q.RELEVANT}, {HALF},
m as ({q.metrics('variant_ranking', 'variant')})
select 'baseline' variant, metric, max("value") filter (variant = 'full') "full",
       max("value") filter (variant = 'half') half from m group by metric""")
def agg13(spark, folder):
    return comparison.side_by_side(run_metrics(spark, folder), ["variant", "metric"], ["full", "half"])


def run_configs(spark, folder):
    """Configs of one run per source of documents, sized by the data behind it."""
    documents = tb.table(spark, folder, "documents")
    return documents.groupBy(F.col("source").alias("data")).agg(
        F.count("*").alias("epochs"), F.countDistinct("lang").alias("embed_dim"), F.lit(42).alias("seed")
    ).withColumn("run", F.col("data"))


@register("jn10_settings_table", """with c as (select source, count(*) epochs, count(distinct lang) embed_dim
  from documents group by 1),
s as (select source, unnest([{'k': 'data', 'v': source}, {'k': 'text_model', 'v': '-'}, {'k': 'finetune_text', 'v': '-'},
  {'k': 'embed_dim', 'v': embed_dim::varchar}, {'k': 'hidden_dim', 'v': '-'}, {'k': 'modality_dropout', 'v': '-'},
  {'k': 'jaccard', 'v': '-'}, {'k': 'epochs', 'v': epochs::varchar}, {'k': 'seed', 'v': '42'}]) e from c),
named as (
  select source, name, row_number() over (order by source nulls first) place,
         bool_or(lower(name) in ('', 'setting')) over () or count(distinct lower(name)) over () < count(*) over () numbered
  from (select source, coalesce(source, 'null') name from c)),
cells as (
  select case when numbered then place || ':' || name else name end run, e.k setting, coalesce(e.v, '-') "value"
  from s join named on s.source is not distinct from named.source)
from (pivot cells on run using first("value") group by setting)""")
def jn10(spark, folder):
    """Settings of every source, one column each: what `compare` shows of its runs."""
    configs = materialise(run_configs(spark, folder), "configs")
    return comparison.settings_table(configs, fixed.COMPARED_SETTINGS)


@register("agg12_comparable", "select count(distinct source) = 1 comparable from documents")
def agg12(spark, folder):
    return comparison.same_test_split(run_configs(spark, folder))


# --- projection -------------------------------------------------------------------


def leading_component(at: int) -> str:
    """Views of the unit eigenvector and value of matrix m<at> (i, j, v), and m<at + 1>, the matrix without them.

    Repeated squaring lets the largest eigenvalue outgrow the others; a row of the power is its eigenvector.
    """
    return f"""
powers{at} as (
  select 0 step, i, j, v / (select sum(v) from m{at} where i = j) v from m{at}
  union all
  select step + 1, i, j, v / sum(v) filter (i = j) over () v from (
    select a.step, a.i, b.j, sum(a.v * b.v) v
    from powers{at} a join powers{at} b on a.j = b.i and a.step = b.step where a.step < 24 group by all)),
row{at} as (select j i, v from powers{at} where step = 24 and i = (
  select i from powers{at} where step = 24 and i = j order by v desc, i limit 1)),
vector{at} as materialized (
  select i, v * (select sign(arg_max(v, abs(v))) from row{at}) / sqrt((select sum(v * v) from row{at})) v from row{at}),
value{at} as materialized (
  select sum(m.v * a.v * b.v) v from m{at} m join vector{at} a on a.i = m.i join vector{at} b on b.i = m.j),
m{at + 1} as materialized (
  select m.i, m.j, m.v - (select v from value{at}) * a.v * b.v v
  from m{at} m join vector{at} a on a.i = m.i join vector{at} b on b.i = m.j)"""


def components(rows: str) -> str:
    """Views ending in placed (row_id, pc) and explained (ratios) of the vectors in `rows` (row_id, embedding)."""
    return f"""entries as (
  select row_id, unnest(range(1, len(embedding) + 1)) i, unnest(embedding)::double x from {rows}),
centred as materialized (select row_id, i, x - avg(x) over (partition by i) x from entries),
m1 as materialized (
  select a.i, b.i j, sum(a.x * b.x) / (count(*) - 1) v from centred a join centred b using (row_id) group by all),
{','.join(leading_component(at) for at in (1, 2, 3))},
components as (
  {' union all '.join(f"select {at} as nr, i, v from vector{at}" for at in (1, 2, 3))}),
placed as (
  select row_id, list(round(p, 6) order by nr) pc from (
    select row_id, nr, sum(x * v) p from centred join components using (i) group by all) group by 1),
explained as (
  select list_transform([a.v, b.v, c.v], lambda x: x / t.v) ratios
  from value1 a, value2 b, value3 c, (select sum(v) v from m1 where i = j) t)"""


@register("agg14_principal_components", f"""with recursive {q.VECTORS}, {components('vectors')}
select row_id, pc, list_transform(ratios, lambda x: round(x, 6)) explained from placed, explained""")
def agg14(spark, folder):
    projection = principal_components(tb.vectors(spark, folder))
    ratio = F.array(*[F.lit(round(x, 6)) for x in projection.explained])
    return projection.rows.select("row_id", F.transform("pc", lambda x: F.round(x, 6)).alias("pc"),
                                  ratio.alias("explained"))


@register("ml6_embedding_map", f"""with recursive {q.INDEX},
sampled as materialized (select * from indexed order by md5('0:' || row_id), row_id limit 300),
{components('sampled')}
select row_id, case when "year" is not null then title || ' (' || "year"::bigint || ')' else title end label,
       coalesce(nullif(trim(genres[1]), ''), 'Unknown') category, pc[1] pc1, pc[2] pc2, pc[3] pc3,
       round(list_sum(ratios), 6) explained
from sampled join placed using (row_id), explained""")
def ml6(spark, folder):
    index = materialise(tb.indexed_catalog(spark, folder), "index")
    return embedding_map(index, 300).withColumns({name: F.round(name, 6) for name in ("pc1", "pc2", "pc3", "explained")})


@register("ml7_result_map", f"""with {q.VECTORS},
query as (select embedding from vectors where row_id = (select min(row_id) from vectors)),
top as (
  select v.row_id, round(list_cosine_similarity(v.embedding, query.embedding), 9) score
  from vectors v, query order by score desc, v.row_id limit 5)
select row_id, score, round(8 + 20 * score, 8) marker_size,
       round(least(greatest(score, 0.05), 1), 9)::double marker_alpha,
       round(least(greatest(score * 0.7, 0.05), 1), 9)::double line_alpha from top
union all select -1, 1, 12, 1, null""")
def ml7(spark, folder):
    items = tb.vectors(spark, folder)
    first = items.orderBy("row_id").first()["embedding"]
    found = topk.top_k(topk.scores(items, topk.query_vector(first), vec.cosine), 5)
    titled = materialise(found.withColumn("title", F.col("row_id").cast("string")), "found")
    points = result_map(first, titled, "embedding")
    digits = {"score": 9, "marker_size": 8, "marker_alpha": 9, "line_alpha": 9}
    return points.select("row_id", *[F.round(name, n).alias(name) for name, n in digits.items()])
