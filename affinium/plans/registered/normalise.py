"""Registered queries: sources, scalar functions, filters and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinium import fixed
from affinium.functions import text as tx
from affinium.operators import collecting
from affinium.operators.dedupe import first_per_key
from affinium.plans.registered import register
from affinium.plans.registered import sql as q
from affinium.session import fresh_path, materialise
from affinium.sources import catalog as cat
from affinium.sources import tables as tb
from affinium.sources.store import append_snapshot, write_records

CLEAN = ["row_id", "title", "year", "genres", "description", "director", "writer", "duration", "votes", "cast"]
CLEAN_SQL = (
    'row_id, title, "year", genres, description, director, writer, duration, votes, "cast", '
    "round(rating, 6) rating"
)


def clean_columns(df):
    return df.select(*CLEAN, F.round("rating", 6).alias("rating"))


@register("src1_load_catalog", f"with {q.CATALOG} select {CLEAN_SQL} from catalog")
def src1(spark, folder):
    path = fresh_path(spark, "dump") + ".csv"
    tb.catalog_raw(spark, folder).write.csv(path, header=True, escape='"')
    return clean_columns(cat.load_catalog(spark, path))


@register("src1_row_ids", f"""with {q.CATALOG} select row_number() over (order by row_id) - 1 row_id, title, "year"
from catalog""")
def src1_row_ids(spark, folder):
    """Catalog of a dump in several files, in order, whose rows bring no id of their own."""
    path = fresh_path(spark, "dump") + ".csv"
    clean = materialise(tb.catalog(spark, folder), "catalog")
    named = clean.select(
        "row_id", "title", "year", F.array_join("genres", ",").alias("genres"), "description"
    )
    named.repartitionByRange(4, "row_id").sortWithinPartitions("row_id").drop("row_id").write.csv(
        path, header=True, escape='"'
    )
    return cat.load_catalog(spark, path).select("row_id", "title", "year")


@register("src1_split_csv", f"""with {q.CATALOG} select row_number() over (order by row_id) - 1 row_id, title, "year",
description || chr(10) || '"' || chr(10) || title description from catalog""")
def src1_split_csv(spark, folder):
    """The same dump, its descriptions with line breaks, by the reader that cuts a file into blocks."""
    path = fresh_path(spark, "dump") + ".csv"
    clean = materialise(tb.catalog(spark, folder), "catalog")
    lines = F.concat_ws("\n", "description", F.lit('"'), "title").alias("description")
    named = clean.select("row_id", "title", "year", F.array_join("genres", ",").alias("genres"), lines)
    named.repartitionByRange(4, "row_id").sortWithinPartitions("row_id").drop("row_id").write.csv(
        path, header=True, escape='"'
    )
    return cat.load_catalog(spark, path, split=True).select("row_id", "title", "year", "description")


@register("src2_dataset_alias", "select p_partkey row_id, p_name as \"name\" from part")
def src2(spark, folder):
    path = cat.resolve_dataset("small", folder, {"small": "part.parquet"})
    return cat.read_table(spark, path).select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"))


@register("src3_title_list", f'with {q.RAW} select "Title" from catalog_raw')
def src3(spark, folder):
    path = fresh_path(spark, "titles") + ".csv"
    tb.catalog_raw(spark, folder).select("row_id", "Title").write.csv(path, header=True)
    return cat.read_titles(spark, path)


@register(
    "prj1_header_resolution",
    "select p_partkey row_id, p_name title, p_brand director, [p_type] genres, text description "
    "from part left join documents on p_partkey = doc_id "
    "where text is not null",
)
def prj1(spark, folder):
    documents = tb.table(spark, folder, "documents")
    raw = tb.table(spark, folder, "part").join(documents, F.col("p_partkey") == F.col("doc_id"))
    messy = raw.select(
        F.col("p_partkey").alias("row_id"), F.col("p_name").alias(" TITLE "), F.col("p_type").alias("Genres"),
        F.lit("shadowed").alias("PLOT"), F.col("text").alias("Description "),
        F.lit("shadowed").alias("Director"), F.col("p_brand").alias("DIRECTED by"),
    )
    return cat.project_unified(messy).select(
        "row_id", "title", "director", "genres", F.col("description")
    )


TOKENS = [*fixed.NA_TOKENS, " N/A", "none", "0"]


@register(
    "prj2_missing_tokens",
    "select p_partkey row_id, case when p_size % 23 = 22 then p_name else "
    + q.na("[" + ", ".join(f"'{t}'" for t in TOKENS) + "][p_size % 23 + 1]")
    + " end as \"value\" from part",
)
def prj2(spark, folder):
    tokens = F.array(*[F.lit(token) for token in TOKENS])
    value = F.coalesce(F.get(tokens, F.col("p_size") % 23), F.col("p_name"))
    return tb.table(spark, folder, "part").select(
        F.col("p_partkey").alias("row_id"), tx.na_to_null(value).alias("value")
    )


DATE_SQL = """case o_orderpriority
    when '1-URGENT' then strftime(o_orderdate, '%b %-d, %Y')
    when '2-HIGH' then strftime(o_orderdate, '%Y') || '.0'
    when '3-MEDIUM' then o_orderkey || ' x ' || strftime(o_orderdate, '%Y-%m-%d')
    when '4-NOT SPECIFIED' then '0999 2101 ' || o_orderkey
    else null end"""


@register("prj3_year_of_text", f"select o_orderkey row_id, {q.year(DATE_SQL)} \"year\" from orders")
def prj3(spark, folder):
    day, key, priority = F.col("o_orderdate"), F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    text = (
        F.when(priority == "1-URGENT", F.date_format(day, "MMM d, yyyy"))
        .when(priority == "2-HIGH", F.concat(F.date_format(day, "yyyy"), F.lit(".0")))
        .when(priority == "3-MEDIUM", F.concat(key, F.lit(" x "), F.date_format(day, "yyyy-MM-dd")))
        .when(priority == "4-NOT SPECIFIED", F.concat(F.lit("0999 2101 "), key))
    )
    return tb.table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), tx.year_of(text).alias("year"))


@register(
    "prj4_split_list",
    "select p_partkey row_id, "
    + q.split_list("' ' || p_type || ' , ,N/A, n/a,' || replace(p_name, ' ', ',\t') || ',' || p_type")
    + " as \"values\" from part",
)
def prj4(spark, folder):
    text = F.concat(
        F.lit(" "), F.col("p_type"), F.lit(" , ,N/A, n/a,"),
        F.replace("p_name", F.lit(" "), F.lit(",\t")), F.lit(","), F.col("p_type"),
    )
    return tb.table(spark, folder, "part").select(
        F.col("p_partkey").alias("row_id"), tx.split_list(text).alias("values")
    )


@register(
    "prj5_text_defaults",
    f"with {q.RAW} select row_id, "
    + q.strip("coalesce(' \t' || \"Description\" || '  \n', '')")
    + " description, coalesce(case when \"Duration\" > '3' then ' ' || \"Directed by\" end, '<missing>') director, "
    "'<missing>' writer from catalog_raw",
)
def prj5(spark, folder):
    padded = F.concat(F.lit(" \t"), F.col("Description"), F.lit("  \n"))
    director = F.when(F.col("Duration") > "3", F.concat(F.lit(" "), F.col("Directed by")))
    raw = tb.catalog_raw(spark, folder).select(
        "row_id", "Title", "Genres", padded.alias("Description"), director.alias("Director")
    )
    return cat.project_unified(raw).select("row_id", "description", "director", "writer")


NUMBER_SQL = """case c_custkey % 8 when 0 then c_acctbal::varchar when 1 then ' ' || c_custkey || ' '
    when 2 then '1,' || c_custkey when 3 then c_custkey || 'd' when 4 then c_custkey || 'e3'
    when 5 then '.' || c_custkey when 6 then c_custkey || '.' else 'nan' end"""


@register(
    "prj6_number_of_text",
    f"with t as (select c_custkey row_id, {q.strip(NUMBER_SQL)} x from customer) "
    "select row_id, case when regexp_matches(x, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') "
    "then try_cast(x as double) end as \"value\" from t",
)
def prj6(spark, folder):
    key, which = F.col("c_custkey").cast("string"), F.col("c_custkey") % 8
    text = (
        F.when(which == 0, F.col("c_acctbal").cast("string"))
        .when(which == 1, F.concat(F.lit(" "), key, F.lit(" ")))
        .when(which == 2, F.concat(F.lit("1,"), key))
        .when(which == 3, F.concat(key, F.lit("d")))
        .when(which == 4, F.concat(key, F.lit("e3")))
        .when(which == 5, F.concat(F.lit("."), key))
        .when(which == 6, F.concat(key, F.lit(".")))
        .otherwise("nan")
    )
    return tb.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("row_id"), tx.number_of(text).alias("value")
    )


@register(
    "prj7_duration_of_text",
    "select p_partkey row_id, "
    + q.duration("case p_type when 'ECONOMY' then p_size || ' h 30 m' when 'PROMO' then 'unknown' "
                 "else p_size || ' min' end")
    + " duration from part",
)
def prj7(spark, folder):
    size = F.col("p_size").cast("string")
    text = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(size, F.lit(" h 30 m")))
        .when(F.col("p_type") == "PROMO", "unknown")
        .otherwise(F.concat(size, F.lit(" min")))
    )
    return tb.table(spark, folder, "part").select(
        F.col("p_partkey").alias("row_id"), tx.duration_of(text).alias("duration")
    )


@register(
    "prj8_primary_category",
    f"with {q.CATALOG} select row_id, coalesce(nullif(trim(genres[1]), ''), 'Unknown') category from catalog",
)
def prj8(spark, folder):
    return tb.catalog(spark, folder).select("row_id", tx.primary_category(F.col("genres")).alias("category"))


@register("prj9_list_text", f"with {q.CATALOG} select row_id, array_to_string(genres, ',') genres, "
          "array_to_string(\"cast\", ',') \"cast\" from catalog")
def prj9(spark, folder):
    return tb.catalog(spark, folder).select(
        "row_id", tx.join_list(F.col("genres")).alias("genres"), tx.join_list(F.col("cast")).alias("cast")
    )


@register("prj11_display_label", f"with {q.UNIFIED} select row_id, "
          "case when \"year\" is not null then title || ' (' || \"year\"::bigint || ')' else title end label "
          "from unified")
def prj11(spark, folder):
    unified = cat.project_unified(tb.catalog_raw(spark, folder))
    return unified.select("row_id", tx.display_label(F.col("title"), F.col("year")).alias("label"))


@register("prj12_shorten", "select doc_id, case when length(text) > 500 then substring(text, 1, 500) || '...' "
          "else text end short from documents")
def prj12(spark, folder):
    return tb.table(spark, folder, "documents").select("doc_id", tx.shorten(F.col("text")).alias("short"))


@register("prj13_page_name", "select p_partkey row_id, p_name || ' ' || p_brand as \"name\" from part")
def prj13(spark, folder):
    title = F.concat(F.col("p_name"), F.lit(" (film) "), F.col("p_brand"), F.lit(" (film)"))
    return tb.table(spark, folder, "part").select(
        F.col("p_partkey").alias("row_id"), tx.page_name(title).alias("name")
    )


@register("prj14_page_url", "select doc_id, 'https://en.wikipedia.org/wiki/' || "
          "replace(url_encode(text || ' a/b*~'), '%2F', '/') url from documents")
def prj14(spark, folder):
    title = F.concat("text", F.lit(" a/b*~"))
    return tb.table(spark, folder, "documents").select("doc_id", tx.page_url(title).alias("url"))


@register("prj15_claim_year", "select o_orderkey, case when o_orderpriority = '5-LOW' then 'N/A' "
          "else strftime(o_orderdate, '%Y') end \"year\" from orders")
def prj15(spark, folder):
    stamp = F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'"))
    present = F.when(F.col("o_orderpriority") != "5-LOW", stamp)
    return tb.table(spark, folder, "orders").select("o_orderkey", tx.claim_year(present).alias("year"))


@register("prj16_text_key", "select doc_id, md5('hashed-terms-64' || chr(0) || text) text_key from documents")
def prj16(spark, folder):
    return tb.table(spark, folder, "documents").select(
        "doc_id", tx.text_key("hashed-terms-64", F.col("text")).alias("text_key")
    )


@register("prj17_plot_attributes", "select p_partkey row_id, round(8 + 20 * s, 6) marker_size, "
          "round(least(greatest(s, 0.05), 1), 6)::double marker_alpha, "
          "round(least(greatest(s * 0.7, 0.05), 1), 6)::double line_alpha "
          "from (select p_partkey, p_retailprice / 1000 - 0.5::double s from part)")
def prj17(spark, folder):
    score = F.col("p_retailprice") / 1000 - 0.5
    return tb.table(spark, folder, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.round(tx.marker_size(score), 6).alias("marker_size"),
        F.round(tx.marker_alpha(score), 6).alias("marker_alpha"),
        F.round(tx.line_alpha(score), 6).alias("line_alpha"),
    )


@register("prj18_without_description", f"with {q.RAW} select row_id, \"Title\", \"Genres\" from catalog_raw "
          "where \"Description\" is not null")
def prj18(spark, folder):
    kept = cat.with_any_description(tb.catalog_raw(spark, folder))
    return kept.select("row_id", "Title", "Genres", "Description").drop("Description", "not there")


@register("flt1_with_title", f"with {q.UNIFIED} select row_id, {q.strip('t')} title from "
          "(select row_id, case when duration > 45 then null when duration > 40 then ' \t' else title end t "
          "from unified) where t is not null")
def flt1(spark, folder):
    unified = cat.project_unified(tb.catalog_raw(spark, folder))
    title = F.when(F.col("duration") > 45, None).when(F.col("duration") > 40, " \t").otherwise(F.col("title"))
    return cat.with_title(unified.withColumn("title", title)).select("row_id", "title")


@register("flt2_with_description", f"with {q.UNIFIED} select row_id, description from "
          "(select row_id, case when duration > 45 then 'n/A' else description end description from unified) "
          "where length(description) > 0 and upper(description) <> 'N/A'")
def flt2(spark, folder):
    unified = cat.project_unified(tb.catalog_raw(spark, folder))
    text = F.when(F.col("duration") > 45, "n/A").otherwise(F.col("description"))
    return cat.with_description(unified.withColumn("description", text)).select("row_id", "description")


@register("flt3_any_description", f"with {q.RAW} select row_id, coalesce({q.na(chr(34) + 'Description' + chr(34))}, '')"
          " as \"Description\" from catalog_raw where "
          f"length(coalesce({q.na(chr(34) + 'Description' + chr(34))}, '')) > 0")
def flt3(spark, folder):
    return cat.with_any_description(tb.catalog_raw(spark, folder)).select("row_id", "Description")


def collected(spark, folder):
    """Catalog rows as collected records, some fields unavailable."""
    raw = tb.catalog_raw(spark, folder)
    genre = F.when(F.col("Duration").startswith("1"), "N/A").otherwise(F.col("Genres"))
    text = F.when(F.col("Duration").startswith("2"), "").otherwise(F.col("Description"))
    return raw.select(
        F.col("row_id").alias("seq"), "Title", F.substring_index("Release Date", ", ", -1).alias("Year"),
        genre.alias("Genre"), F.coalesce(text, F.lit(fixed.NOT_AVAILABLE)).alias("Description"),
    )


COLLECTED = f"""{q.RAW},
collected as (
  select row_id seq, "Title", right("Release Date", 4) "Year",
         case when "Duration" like '1%' then 'N/A' else "Genres" end "Genre",
         case when "Duration" like '2%' then '' else coalesce("Description", 'N/A') end "Description"
  from catalog_raw),
complete as (
  select * from collected where "Genre" <> 'N/A' and "Description" not in ('', 'N/A')),
cleaned as (
  select * from complete qualify row_number() over (partition by "Title", "Year" order by seq) = 1)"""


@register("flt4_complete_records", f"with {COLLECTED} select * from cleaned")
def flt4(spark, folder):
    return collecting.clean_records(collected(spark, folder))


@register("snk1_write_records", f'with {COLLECTED} select "Title", "Year", "Genre", "Description" from cleaned')
def snk1(spark, folder):
    path = fresh_path(spark, "records")
    cleaned = collecting.clean_records(collected(spark, folder)).drop("seq")
    write_records(cleaned, path, "parquet")
    return spark.read.parquet(path)


@register("snk2_snapshot", f'with {COLLECTED} select seq, "Title", "Year", true stamped from collected')
def snk2(spark, folder):
    path = fresh_path(spark, "snapshots")
    append_snapshot(collected(spark, folder), path)
    stamped = F.col("ingest_ts").isNotNull() & (F.to_date("ingest_ts") == F.col("ingest_date"))
    return spark.read.parquet(path).select("seq", "Title", "Year", stamped.alias("stamped"))


@register("win1_first_per_key", f"with {q.CATALOG} select row_id, title, \"year\" from catalog")
def win1(spark, folder):
    return tb.catalog(spark, folder).select("row_id", "title", "year")


@register("win1b_first_collected", f'with {COLLECTED} select * from collected '
          'qualify row_number() over (partition by "Title", "Year" order by seq) = 1')
def win1b(spark, folder):
    return first_per_key(collected(spark, folder), ["Title", "Year"], ["seq"])
