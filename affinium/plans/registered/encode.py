"""Registered queries: splits, vocabularies, statistics, encoding, run tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinium import fixed
from affinium.operators import encoding as enc
from affinium.operators import ordering
from affinium.plans.registered import register
from affinium.plans.registered import sql as q
from affinium.session import fresh_path, materialise
from affinium.sources import tables as tb
from affinium.sources.store import SPLITS, Run, from_flat


def labelled(spark, folder):
    """The split catalog, written once because several steps read it."""
    catalog = materialise(tb.catalog(spark, folder), "catalog")
    return ordering.split_catalog(catalog)


def train_items(spark, folder):
    return labelled(spark, folder).filter("split = 'train'")


def rounded(df, names, digits=6):
    return df.withColumns({name: F.round(name, digits) for name in names})


@register("win3_split", f"with {q.SPLIT} select row_id, split from labelled")
def win3(spark, folder):
    return labelled(spark, folder).select("row_id", "split")


@register("win4_batches", "select doc_id row_id, (row_number() over (order by md5('42:3:' || doc_id), doc_id) - 1) // 64 "
          "batch_id from documents qualify batch_id < (count(*) over ()) // 64")
def win4(spark, folder):
    items = tb.table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"))
    return ordering.assign_batches(items, fixed.SEED, epoch=3)


@register("top5_sample", "select doc_id row_id, lang from documents order by md5('0:' || doc_id), doc_id limit 300")
def top5(spark, folder):
    items = tb.table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    return ordering.sample_rows(items, 300)


@register("src6_load_split", f"with {q.SPLIT} select row_id, title, genres, \"cast\", director, writer, description "
          "from labelled where split = 'test'")
def src6(spark, folder):
    run = Run(spark, fresh_path(spark, "run"))
    run.save_splits(labelled(spark, folder))
    return run.split("test").select("row_id", "title", "genres", "cast", "director", "writer", "description")


@register("snk3_save_splits", f"with {q.SPLIT} select split, row_id, title, genres, \"cast\", director from labelled")
def snk3(spark, folder):
    run = Run(spark, fresh_path(spark, "run"))
    run.save_splits(labelled(spark, folder))
    parts = []
    for split in SPLITS:
        path = fresh_path(spark, f"export-{split}")
        run.export_split(split, path)
        text = spark.read.csv(path, header=True, multiLine=True, escape='"')
        parts.append(from_flat(text).select(
            F.lit(split).alias("split"), F.col("row_id").cast("long"), "title", "genres", "cast", "director"
        ))
    return reduce(DataFrame.unionByName, parts)


@register("agg1_genre_vocabulary", f"with {q.VOCAB} select value, idx from genre_vocab")
def agg1(spark, folder):
    return enc.genre_vocabulary(train_items(spark, folder))


@register("agg2_people_vocabulary", f"with {q.VOCAB} select field, value, idx from vocab "
          "where field in ('director', 'writer')")
def agg2(spark, folder):
    items = train_items(spark, folder)
    parts = [
        enc.people_vocabulary(items, name).select(F.lit(name).alias("field"), "value", "idx")
        for name in ("director", "writer")
    ]
    return parts[0].unionByName(parts[1])


@register("agg3_cast_vocabulary", f"with {q.VOCAB} select value, idx from cast_vocab")
def agg3(spark, folder):
    return enc.cast_vocabulary(train_items(spark, folder))


@register("agg4_year_range", f"with {q.VOCAB} select year_min, year_max from stats")
def agg4(spark, folder):
    return enc.fit_stats(train_items(spark, folder)).select("year_min", "year_max")


MEANS = ["rating_mean", "rating_std", "duration_mean", "duration_std"]


@register("agg5_mean_and_spread", f"with {q.VOCAB} select "
          + ", ".join(f"round({name}, 6) {name}" for name in MEANS) + " from stats")
def agg5(spark, folder):
    return rounded(enc.fit_stats(train_items(spark, folder)).select(*MEANS), MEANS)


@register("agg6_log_votes", f"with {q.VOCAB} select round(votes_log_mean, 6) votes_log_mean, "
          "round(votes_log_std, 6) votes_log_std from stats")
def agg6(spark, folder):
    names = ["votes_log_mean", "votes_log_std"]
    return rounded(enc.fit_stats(train_items(spark, folder)).select(*names), names)


def encoded(spark, folder):
    items = materialise(labelled(spark, folder), "labelled")
    state = enc.fit_encoder(items.filter("split = 'train'"))
    saved = fresh_path(spark, "encoder")
    state.save(saved)
    return enc.encode(items, enc.EncoderState.load(spark, saved))


@register("enc1_multi_hot", f"""with {q.VOCAB},
g as (select row_id, list_sort(list(distinct idx::int)) genre_idx
      from (select row_id, unnest(genres) as value from labelled) join genre_vocab using (value) group by 1),
c as (select row_id, list_sort(list(distinct idx::int)) cast_idx
      from (select row_id, unnest("cast") as value from labelled) join cast_vocab using (value) group by 1)
select row_id, coalesce(genre_idx, []::int[]) genre_idx, coalesce(cast_idx, []::int[]) cast_idx
from labelled left join g using (row_id) left join c using (row_id)""")
def enc1(spark, folder):
    return encoded(spark, folder).select("row_id", "genre_idx", "cast_idx")


@register("enc2_scaled_year", f"""with {q.VOCAB} select row_id, round(least(greatest(
    (coalesce("year", (year_min + year_max) / 2) - year_min) / greatest(year_max - year_min, 1), 0), 1), 6)::double year_n
from labelled, stats""")
def enc2(spark, folder):
    return rounded(encoded(spark, folder).select("row_id", "year_n"), ["year_n"])


@register("enc3_z_scores", f"""with {q.VOCAB} select row_id,
    round((coalesce(rating, rating_mean) - rating_mean) / greatest(rating_std, 1e-6), 6) rating_n,
    round((coalesce(duration, duration_mean) - duration_mean) / greatest(duration_std, 1e-6), 6) duration_n
from labelled, stats""")
def enc3(spark, folder):
    names = ["rating_n", "duration_n"]
    return rounded(encoded(spark, folder).select("row_id", *names), names)


@register("enc4_votes", f"""with {q.VOCAB} select row_id,
    round((ln(1 + coalesce(votes, 0)) - votes_log_mean) / greatest(votes_log_std, 1e-6), 6) votes_n
from labelled, stats""")
def enc4(spark, folder):
    return rounded(encoded(spark, folder).select("row_id", "votes_n"), ["votes_n"])


@register("enc5_people_ids", f"""with {q.VOCAB} select row_id, coalesce(d.idx, 0)::int director_idx,
    coalesce(w.idx, 0)::int writer_idx
from labelled left join director_vocab d on director = d.value left join writer_vocab w on writer = w.value""")
def enc5(spark, folder):
    return encoded(spark, folder).select("row_id", "director_idx", "writer_idx")


@register("jn4_vocabulary_join", """with v as (
  select lang as value, row_number() over (order by count(*) desc, lang) idx from documents
  where source <> 'src0' group by 1 qualify idx <= 2)
select doc_id row_id, coalesce(idx, 0)::int lang_idx from documents left join v on lang = value""")
def jn4(spark, folder):
    items = tb.table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), "lang", "source")
    vocab = enc.people_vocabulary(items.filter("source <> 'src0'"), "lang", cap=2)
    return enc.encode_people(items, "lang", "lang_idx", vocab).select("row_id", "lang_idx")


@register("enc6_fit_sizes", f"""with {q.VOCAB} select field, count(*) + any_value(case when field in ('director', 'writer')
    then 1 else 0 end) n from vocab group by 1""")
def enc6(spark, folder):
    return enc.fit_encoder(materialise(train_items(spark, folder), "train")).size_table()


@register("snk6_encoder_state", f"with {q.VOCAB} select field, value, idx, round(rating_mean, 6) rating_mean "
          "from vocab, stats")
def snk6(spark, folder):
    path = fresh_path(spark, "encoder")
    enc.fit_encoder(materialise(train_items(spark, folder), "train")).save(path)
    state = enc.EncoderState.load(spark, path)
    mean = state.stats.select(F.round("rating_mean", 6)).scalar()
    return state.vocab.select(F.col("field").cast("string"), "value", "idx", mean.alias("rating_mean"))


@register("snk7_run_config", f"""with {q.VOCAB} select 'table' "data", 42::bigint seed, count(*) n_genres,
    (select count(*) + 1 from director_vocab) n_directors from genre_vocab""")
def snk7(spark, folder):
    run = Run(spark, fresh_path(spark, "run"))
    sizes = enc.fit_encoder(materialise(train_items(spark, folder), "train")).sizes()
    run.save_config({"data": "table", "seed": fixed.SEED, "n_genres": sizes["genres"], "n_directors": sizes["director"]})
    return run.config_frame().select("data", "seed", "n_genres", "n_directors")
