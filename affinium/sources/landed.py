"""Landed API responses (JSON text) to flat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinium import fixed
from affinium.functions import text as tx

FILM_SCHEMA = "Response string, Title string, Year string, Genre string, Plot string"
PAGE_SCHEMA = (
    "query struct<pages: map<string, struct<title: string, extract: string, missing: string,"
    " pageprops: struct<wikibase_item: string>>>>"
)
_CLAIM = "array<struct<mainsnak: struct<datavalue: struct<value: struct<time: string, id: string>>>>>"
CLAIMS_SCHEMA = (
    "entities map<string, struct<claims: struct<"
    + ", ".join(f"{p}: {_CLAIM}" for p in (fixed.PUBLICATION_DATE, fixed.DIRECTED_BY, fixed.GENRE))
    + ">>>"
)
LABELS_SCHEMA = "entities map<string, struct<labels: struct<en: struct<value: string>>>>"


def or_not_available(value: Column) -> Column:
    return F.coalesce(value, F.lit(fixed.NOT_AVAILABLE))


def film_records(landed: DataFrame, body: str = "body") -> DataFrame:
    """Film-API responses to (Title, Year, Genre, Description); failed lookups are dropped.

    Every other column of `landed` (request, sequence) is kept.
    """
    kept = [name for name in landed.columns if name != body]
    parsed = landed.select(*kept, F.from_json(body, FILM_SCHEMA).alias("r")).filter("r.Response = 'True'")
    return parsed.select(
        *kept,
        or_not_available(F.col("r.Title")).alias("Title"),
        or_not_available(F.col("r.Year")).alias("Year"),
        or_not_available(F.col("r.Genre")).alias("Genre"),
        or_not_available(F.col("r.Plot")).alias("Description"),
    )


def valid_pages(landed: DataFrame, body: str = "body") -> DataFrame:
    """Existing pages with a knowledge-base item: `(..., title, extract, item)`.

    A response names one page; if it ever holds more, the first counts.
    """
    kept = [name for name in landed.columns if name != body]
    pages = F.map_values(F.from_json(body, PAGE_SCHEMA)["query"]["pages"])
    first = landed.select(*kept, F.get(pages, F.lit(0)).alias("p"))
    return first.filter("p.missing is null and p.pageprops.wikibase_item is not null").select(
        *kept,
        F.coalesce("p.title", F.lit("")).alias("title"),
        F.coalesce("p.extract", F.lit("")).alias("extract"),
        F.col("p.pageprops.wikibase_item").alias("item"),
    )


def page_candidates(requests: DataFrame) -> DataFrame:
    """Page names to try per request, in priority order; a `year` column adds one."""
    title = F.col("requested")
    names = [F.concat(title, F.lit(" (film)")), title]
    if "year" in requests.columns:
        names.append(F.concat(title, F.lit(" ("), F.col("year").cast("string"), F.lit(" film)")))
    tries = F.array(*[F.struct(F.lit(at).alias("prio"), name.alias("candidate"))
                      for at, name in enumerate(names)])
    return requests.select("requested", F.inline(tries)).filter("candidate is not null")


def choose_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """First existing page per request; `pages` is keyed by `candidate`."""
    page = F.struct("prio", "title", "extract", "item")
    return (
        page_candidates(requests.distinct())
        .join(pages, "candidate")
        .groupBy("requested")
        .agg(F.min(page).alias("page"))
        .select("requested", "page.title", "page.extract", "page.item")
    )


def item_claims(landed: DataFrame, body: str = "body") -> DataFrame:
    """Claims per item: release time and the ids of directors and genres.

    Unreadable responses are dropped; a readable one without the entity or
    the property gives null or empty fields.
    """
    readable = landed.filter(F.try_parse_json(body).isNotNull())
    entity = F.try_element_at(F.from_json(body, CLAIMS_SCHEMA)["entities"], F.col("item"))
    claims = readable.select("item", entity["claims"].alias("c"))

    def ids(prop: str) -> Column:
        found = F.transform(F.col(f"c.{prop}"), lambda claim: claim["mainsnak"]["datavalue"]["value"]["id"])
        named = F.filter(found, lambda value: value.isNotNull() & (value != ""))
        return F.coalesce(named, F.array().cast("array<string>"))

    first = F.get(F.col(f"c.{fixed.PUBLICATION_DATE}"), F.lit(0))
    return claims.select(
        "item",
        first["mainsnak"]["datavalue"]["value"]["time"].alias("time"),
        ids(fixed.DIRECTED_BY).alias("directors"),
        ids(fixed.GENRE).alias("genres"),
    )


def entity_labels(landed: DataFrame, body: str = "body") -> DataFrame:
    """English labels: `(entity, label)`."""
    entity = F.try_element_at(F.from_json(body, LABELS_SCHEMA)["entities"], F.col("entity"))
    return landed.select("entity", entity["labels"]["en"]["value"].alias("label")).filter(
        "label is not null and label <> ''"
    )


def with_labels(df: DataFrame, key: str, fields: list[str], labels: DataFrame) -> DataFrame:
    """Replace id lists by their labels, in order, joined by `, `; none gives `N/A`.

    All fields go through one join; the label lists are small, their number
    per row is the number of claims.
    """

    def entries_of(field: str) -> Column:
        return F.transform(
            field, lambda entity, at: F.struct(F.lit(field).alias("field"), at.alias("at"), entity.alias("entity"))
        )

    entries = F.flatten(F.array(*[entries_of(field) for field in fields]))
    found = df.select(key, F.inline(entries)).join(labels, "entity").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("field", "at", "label"))).alias("_found")
    )

    def names(field: str) -> Column:
        own = F.filter("_found", lambda entry: entry["field"] == field)
        text = F.array_join(F.transform(own, lambda entry: entry["label"]), ", ")
        return or_not_available(F.nullif(text, F.lit("")))

    kept = [name for name in df.columns if name not in fields]
    joined = df.drop(*fields).join(found, key, "left")
    return joined.select(*kept, *[names(field).alias(field) for field in fields])


def page_records(requests: DataFrame, pages: DataFrame, claims: DataFrame, labels: DataFrame) -> DataFrame:
    """Encyclopedia pages plus knowledge-base claims to flat records.

    The first existing page decides; without readable claims the record is
    dropped and no other page is tried.
    """
    # Of several landed claims of one item the smallest counts, whatever order they were read in.
    only = claims.groupBy("item").agg(F.min(F.struct("time", "directors", "genres")).alias("c")).select("item", "c.*")
    facts = choose_pages(requests, pages).join(only, "item")
    named = with_labels(facts, "requested", ["directors", "genres"], labels)
    return named.select(
        "requested",
        tx.page_name(F.col("title")).alias("Title"),
        tx.claim_year(F.col("time")).alias("Year"),
        F.col("directors").alias("Director"),
        F.col("genres").alias("Genre"),
        tx.shorten(F.col("extract")).alias("Description"),
        tx.page_url(F.col("title")).alias("Wikipedia_URL"),
    )
