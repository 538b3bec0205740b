"""SQL building blocks shared by the twins (DuckDB dialect)."""

from __future__ import annotations

from affinium import fixed

NA = ", ".join(f"'{token}'" for token in fixed.NA_TOKENS)
WS = fixed.WHITESPACE


def na(expr: str) -> str:
    return f"(case when {expr} in ({NA}) then null else {expr} end)"


def strip(expr: str) -> str:
    return f"trim({expr}, '{WS}')"


def year(expr: str) -> str:
    return (
        f"list_filter(regexp_extract_all({expr}, '[0-9]+'), "
        "lambda x: len(x) = 4 and x between '1800' and '2100')[1]::double"
    )


def split_list(expr: str) -> str:
    return (
        f"coalesce(list_filter(list_transform(string_split({expr}, ','), lambda x: {strip('x')}), "
        "lambda x: x <> '' and upper(x) <> 'N/A'), []::varchar[])"
    )


def duration(expr: str) -> str:
    return f"try_cast(nullif(regexp_extract({expr}, '([0-9]+)', 1), '') as double)"


RAW = """
sales as (
  select l_partkey, count(*) votes, avg(l_quantity) rating, min(l_shipdate) d,
         list_sort(list(distinct s_name)) cst,
         arg_min(s_name, (l_orderkey, l_linenumber)) writer
  from lineitem join supplier on l_suppkey = s_suppkey group by 1),
catalog_raw as (
  select p_partkey row_id, p_name || ' ' || p_brand as "Title",
         strftime(d, '%b %-d, %Y') as "Release Date",
         p_type || ', ' || replace(p_name, ' ', ', ') as "Genres",
         text as "Description", p_brand as "Directed by", writer as "Written by",
         rating as "Rating", p_size || ' min' as "Duration",
         votes as "No of Persons Voted", array_to_string(cst, ',') as "Cast"
  from part left join sales on p_partkey = l_partkey
            left join documents on p_partkey = doc_id)"""

UNIFIED = f"""{RAW},
unified as (
  select row_id, {na('"Title"')} title, {year(na('"Release Date"'))} "year",
         {split_list(na('"Genres"'))} genres,
         {strip("coalesce(" + na('"Description"') + ", '')")} description,
         coalesce({na('"Directed by"')}, '<missing>') director, "Rating" rating,
         coalesce({na('"Written by"')}, '<missing>') writer,
         {duration(na('"Duration"'))} duration, "No of Persons Voted"::double votes,
         {split_list(na('"Cast"'))} "cast"
  from catalog_raw)"""

CATALOG = f"""{UNIFIED},
valid as (
  select * replace ({strip('title')} as title) from unified
  where title is not null and length(description) > 0 and upper(description) <> 'N/A'),
catalog as (
  select * from valid
  qualify row_number() over (partition by title, "year" order by row_id) = 1)"""

SPLIT = f"""{CATALOG},
shuffled as (
  select *, row_number() over (order by md5('42:' || row_id), row_id) rn, count(*) over () n from catalog),
labelled as (
  select * exclude (rn, n),
         case when rn <= floor(n * 0.15::double) then 'test'
              when rn <= 2 * floor(n * 0.15::double) then 'val' else 'train' end split
  from shuffled)"""

VOCAB = f"""{SPLIT},
train as (select * from labelled where split = 'train'),
genre_values as (select distinct unnest(genres) as value from train),
genre_vocab as (select value, row_number() over (order by value) - 1 idx from genre_values),
director_vocab as (
  select director as value, row_number() over (order by count(*) desc, director) idx
  from train where director <> '<missing>' group by 1 qualify idx <= 2000),
writer_vocab as (
  select writer as value, row_number() over (order by count(*) desc, writer) idx
  from train where writer <> '<missing>' group by 1 qualify idx <= 2000),
cast_vocab as (
  select value, row_number() over (order by count(*) desc, value) - 1 idx
  from (select unnest("cast") as value from train) group by 1 qualify idx < 2000),
vocab as (
  select 'genres' field, value, idx from genre_vocab
  union all select 'director', value, idx from director_vocab
  union all select 'writer', value, idx from writer_vocab
  union all select 'cast', value, idx from cast_vocab),
stats as (
  select coalesce(min("year"), 1900) year_min, coalesce(max("year"), 2025) year_max,
         coalesce(avg(rating), 6.5) rating_mean, coalesce(nullif(stddev_samp(rating), 0), 1.5) rating_std,
         coalesce(avg(duration), 100) duration_mean,
         coalesce(nullif(stddev_samp(duration), 0), 40) duration_std,
         coalesce(avg(ln(1 + votes)), 10) votes_log_mean,
         coalesce(nullif(stddev_samp(ln(1 + votes)), 0), 2) votes_log_std
  from train)"""

INDEX = f"""{CATALOG},
indexed as (
  select catalog.*, embedding::double[] embedding from catalog join embeddings on row_id = vec_id)"""

VECTORS = """
vectors as (
  select vec_id row_id, [label::varchar] genres, embedding::double[] embedding from embeddings)"""

RANKING = f"""{VECTORS},
scored as (
  select q.row_id q_id, c.row_id, round(list_inner_product(q.embedding, c.embedding), 9) score
  from vectors q, vectors c where q.row_id <> c.row_id),
ranking as (
  select *, row_number() over (partition by q_id order by score desc, row_id) "rank"
  from scored qualify "rank" <= 10)"""

RELEVANT = """
relevant as (
  select q.row_id, count(c.row_id) n_relevant
  from vectors q left join vectors c on q.row_id <> c.row_id and list_has_any(q.genres, c.genres)
  group by 1)"""


def metrics(ranking: str, by: str = "") -> str:
    """Metric rows of a ranking over `vectors`, as a union of one select per cut-off."""
    group = f"{by}, " if by else ""
    parts = []
    for k in fixed.METRIC_CUTOFFS:
        per_query = f"""
        select {group}q_id, any_value(n_relevant) rel,
               count(*) filter (hit and "rank" <= {k}) hits,
               coalesce(sum(1 / log2("rank" + 1)) filter (hit and "rank" <= {k}), 0) gain,
               min("rank") filter (hit and "rank" <= {k}) first_hit
        from {ranking} r join vectors q on q.row_id = q_id join vectors c on c.row_id = r.row_id
             join relevant v on v.row_id = q_id,
             lateral (select list_has_any(q.genres, c.genres) hit)
        where n_relevant > 0 group by {group}q_id"""
        formulas = {
            "HitRate": "(hits > 0)::int",
            "MRR": "coalesce(1 / first_hit, 0)",
            "NDCG": f"gain / list_sum(list_transform(range(1, least(rel, {k}) + 1), lambda r: 1 / log2(r + 1)))",
            "Precision": f"hits / {k}",
            "Recall": "hits / rel",
        }
        for name, formula in formulas.items():
            parts.append(
                f"select {group}'{name}@{k}' metric, round(avg({formula}), 6) \"value\" "
                f"from ({per_query}) group by {by or 'true'}"
            )
    return " union all ".join(parts)


BATCHES = f"""{VECTORS},
batched as (
  select *, (row_number() over (order by md5('42:0:' || row_id), row_id) - 1) // 64 batch_id,
         count(*) over () n
  from vectors),
kept as (select * from batched where batch_id < n // 64)"""

PAIRS = f"""{BATCHES},
pairs as (
  select a.batch_id, a.row_id, b.row_id other_id, list_inner_product(a.embedding, b.embedding) / 0.07 s,
         list_has_any(a.genres, b.genres)::int w
  from kept a join kept b on a.batch_id = b.batch_id and a.row_id <> b.row_id),
anchors as (
  select batch_id, row_id, max(s) m, sum(w) w_sum from pairs group by 1, 2),
denominators as (
  select p.batch_id, p.row_id, any_value(m) + ln(sum(exp(s - m))) lse
  from pairs p join anchors using (batch_id, row_id) group by 1, 2),
terms as (
  select p.batch_id, p.row_id, -sum(w * (s - lse)) / any_value(w_sum) term
  from pairs p join anchors using (batch_id, row_id) join denominators using (batch_id, row_id)
  where w_sum > 0 group by 1, 2),
sizes as (select batch_id, count(*) n_items from kept group by 1),
losses as (
  select batch_id, n_items, count(term) n_valid, coalesce(avg(term), 0) loss
  from sizes left join terms using (batch_id) group by 1, 2)"""
