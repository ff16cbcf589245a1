"""Listings out of stored pages, by patterns over their HTML."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.html import inner_by_class
from .clean import is_detail_link

# Patterns of the pages' markup. Structured blocks; a street, an address in one
# line, parts of an address and a point in inline JSON; where an address stands in a page's
# description and title; words that tell that a year is a house's.
_LD = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
_STREET = r'"streetAddress"\s*:\s*"([^"]+)"'
_ONELINE = r'"unifiedOneline"\s*:\s*"([^"]+)"'
_PART = r'\{"value(?:ForAddress)?"\s*:\s*"([^"]+)"'
_POINT = r'"point"\s*:\s*\{\s*"latitude"\s*:\s*([0-9]+(?:\.[0-9]+)?)\s*,\s*"longitude"\s*:\s*([0-9]+(?:\.[0-9]+)?)'
_DESCRIBED = r"Адрес:\s*([^,]+(?:,\s*[^,✅]+)*)"
_TITLED = r"—\s*([^—]+?)\s*—\s*id\s*\d+"
_HOUSE_WORDS = "дом|год|сдан|постро"
# Classes of an address, a station with its minutes, and a house's features.
CLASSES = [("CardLocation__addressItem", True), ("MetroWithTime", True), ("OfferCardFeature__text|OfferCardBuildingFeatures__feature", False)]

_ADDRESS = "address: struct<streetAddress: string, addressLocality: string>"
_SHAPE = f"array<struct<`@type`: string, name: string, description: string, {_ADDRESS}, geo: struct<latitude: string, longitude: string>, offers: struct<price: string, priceCurrency: string>>>"
# What a structured block's type is worth.
TYPE_SCORES = {"product": 100, "offer": 80, "apartment": 70, "realestatelisting": 70, "organization": -1000, "breadcrumblist": -1000}


def plain(html: Column) -> Column:
    """A page's text: no scripts, styles or tags; common entities decoded."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    for name, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(to))
    return t


def element(html: Column, tag: str) -> Column:
    """The text of the first such element; null without one."""
    return F.nullif(tx.trimmed(plain(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))), F.lit(""))


def meta_description(html: Column) -> Column:
    return tx.found(html, r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']""")


def by_class(html: Column, wanted: list[tuple[str, bool]]) -> Column:
    """For each (css, whole) of `wanted` the texts of all elements with such a class, in order:
    array<array<string>>. With `whole` a class begins with `css`, else it holds it. Elements are
    read by their nesting depth in one linear scan of a page, of any depth, width and length;
    patterns can't count. Null pages have none."""

    @F.pandas_udf("array<array<string>>")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: [[] for _ in wanted] if p is None else inner_by_class(p, wanted))

    return F.transform(read(html), lambda texts: F.transform(texts, lambda x: tx.trimmed(plain(x))))


def first_text(texts: Column) -> Column:
    """The first of an array of texts; null if there is none, or it is empty."""
    return F.nullif(F.get(texts, 0), F.lit(""))


def point_of(html: Column) -> Column:
    """struct(lat, lon) of the first element with data attributes for both (the longitude's also
    misspelt); null without one."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<[^>]*\bdata-latitude\s*=[^>]*>"), 0)
    of = lambda tag, name: tx.number(tx.found(tag, rf"""(?i)\b{name}\s*=\s*["']\s*([0-9.,\-]+)\s*["']"""))
    points = F.transform(tags, lambda t: F.struct(of(t, "data-latitude").alias("lat"), F.coalesce(of(t, "data-longtitude"), of(t, "data-longitude")).alias("lon")))
    return F.get(F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()), 0)


def structured(html: Column) -> Column:
    """The structured-data candidates of a page in order, single objects and arrays alike."""
    raw = F.transform(F.regexp_extract_all(html, F.lit(_LD), 1), lambda s: tx.trimmed(s))
    lists = F.transform(raw, lambda s: F.coalesce(F.from_json(F.when(s.startswith("["), s).otherwise(F.concat(F.lit("["), s, F.lit("]"))), _SHAPE), F.expr(f"cast(array() as {_SHAPE})")))
    return F.flatten(lists)


def candidate_score(c: Column) -> Column:
    """The worth of a block's type, 50 for a price, 10 for a name."""
    kind, out = F.lower(tx.trimmed(F.coalesce(c["@type"], F.lit("")))), F
    for name, n in TYPE_SCORES.items():
        out = out.when(kind == name, n)
    some = lambda x: F.when(F.coalesce(x, F.lit("")) != "", 1).otherwise(0)
    return out.otherwise(0) + 50 * some(c["offers"]["price"]) + 10 * some(c["name"])


def best_candidate(candidates: Column) -> Column:
    """The best block, the first on ties; null if none is above -1000. One page's blocks
    are compared inside its row."""
    ranked = F.transform(candidates, lambda c, i: F.struct((-candidate_score(c)).alias("s"), i.alias("i"), c.alias("c")))
    top = F.array_min(F.transform(ranked, lambda r: F.struct(r["s"].alias("s"), r["i"].alias("i"))))
    return F.when(top["s"] < 1000, F.get(candidates, top["i"]))


def extract_listings(pages: DataFrame, deal_type: str = "rent_long", source: str = "site", detail: str = r"/offer/[0-9]+") -> DataFrame:
    """B1: a raw listing for each page (page_id, url, html) of one offer by its url, or with a
    structured block that passes; other pages give none. One narrow pass; elements of a class
    are read by a scan in Python workers, all else by patterns.

    Street and locality come from the structured block, the point too; else from data
    attributes and the visible address; else from inline JSON around the street's name, or the
    first point. Pages without a block are read field by field from their text."""
    ld = F.col("ld")
    p = pages.where("html is not null").select("page_id", "url", "html", best_candidate(structured(F.col("html"))).alias("ld"))
    p = p.where(ld.isNotNull() | F.coalesce(is_detail_link("url", detail), F.lit(False))).withColumn("_attr", point_of(F.col("html"))).withColumn("_by_class", by_class(F.col("html"), CLASSES)).withColumn("_body", plain(F.col("html"))).withColumn("_lower", F.lower("_body"))
    place, metro, features = (F.col("_by_class")[k] for k in range(3))
    html, some = F.col("html"), lambda c: F.nullif(tx.trimmed(F.coalesce(c, F.lit(""))), F.lit(""))
    said = some(F.concat_ws(", ", some(ld["address"]["streetAddress"]), some(ld["address"]["addressLocality"])))
    shown = F.coalesce(first_text(place), tx.found(meta_description(html), _DESCRIBED), tx.found(element(html, "title"), _TITLED))
    street = tx.found(html, _STREET)
    at = F.regexp_instr(html, F.lit(_STREET))
    start = F.greatest(at - 2000, F.lit(1))
    around = F.when(at > 0, F.substr(html, start, at + F.length(F.regexp_substr(html, F.lit(_STREET))) + 3000 - start)).otherwise(html)
    inline = lambda g: tx.number(tx.found(around, _POINT, g))
    parts = F.array_join(F.filter(F.transform(F.slice(F.regexp_extract_all(html, F.lit(_PART), 1), 1, 6), lambda x: tx.trimmed(x)), lambda x: x != ""), ", ")
    address = F.coalesce(said, some(tx.stripped(tx.trimmed(F.coalesce(shown, F.lit(""))), ", ")), some(street), some(tx.found(html, _ONELINE)), some(parts))
    facts = F.concat(F.coalesce(ld["name"], F.lit("")), F.lit("\n"), F.coalesce(ld["description"], F.lit("")))
    body, floors = F.col("_body"), tx.floors_from_text(facts)
    label = lambda word: tx.number(F.coalesce(tx.found(html, rf"""(?isu)__value[^>]*>\s*([0-9]+(?:[.,][0-9]+)?)[^<]*</[^>]*>\s*<[^>]*__label[^>]*>[^<]*{word}"""), tx.found(F.col("_lower"), rf"(?u){word}[^0-9]{{0,20}}?(\d+(?:[\.,]\d+)?)\s*м²")))
    told = F.transform(features, lambda x: F.lower(x))
    year = F.get(F.filter(F.transform(F.filter(told, lambda x: x.rlike(_HOUSE_WORDS)), lambda x: tx.first_year(x)), lambda y: y.isNotNull()), 0)
    material = F.get(F.filter(F.transform(told, lambda x: tx.house_material(x)), lambda m: F.coalesce(m, F.lit("")) != ""), 0)
    return p.select(
        "page_id", F.lit(source).alias("source"), F.lit(deal_type).alias("deal_type"), tx.external_id("url").alias("external_id"), "url",
        tx.trimmed(F.coalesce(ld["name"], F.lit(""))).alias("title"), tx.trimmed(F.coalesce(ld["description"], F.lit(""))).alias("description"),
        tx.number(ld["offers"]["price"]).alias("price_value"), tx.currency(F.coalesce(ld["offers"]["priceCurrency"], F.lit(""))).alias("price_currency"), tx.price_period(F.lit(deal_type), F.concat_ws(" ", ld["description"], ld["name"], body)).alias("price_period"),
        F.coalesce(tx.rooms_from_text(facts), tx.rooms_from_page(body, element(html, "title"), meta_description(html), element(html, "h1"))).alias("rooms"),
        tx.area_from_text(facts).alias("area_total"), label("жила").alias("area_living"), label("кухн").alias("area_kitchen"), floors["floor"].alias("floor"), floors["floors_total"].alias("floors_total"),
        F.coalesce(year, tx.first_year(F.col("_lower"))).alias("year_built"), F.coalesce(material, tx.house_material(body)).alias("house_material"),
        tx.stripped(tx.trimmed(F.coalesce(address, F.lit(""))), ", ").alias("address_text"),
        F.coalesce(tx.number(ld["geo"]["latitude"]), F.col("_attr.lat"), inline(1)).alias("lat"), F.coalesce(tx.number(ld["geo"]["longitude"]), F.col("_attr.lon"), inline(2)).alias("lon"), F.coalesce(first_text(metro), F.lit("")).alias("metro"),
    )


def extract_links(pages: DataFrame, pattern: str = r"/offer/[0-9]+") -> DataFrame:
    """B2: (page_id, href) of the links of pages that aren't details themselves, as often as
    they stand there."""
    listing = pages.where(~F.coalesce(is_detail_link("url", pattern), F.lit(False)))
    links = listing.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href=["']([^"']*)["']"""), 1)).alias("href"))
    return links.where(is_detail_link("href", pattern))


def link_counts(pages: DataFrame, pattern: str = r"/offer/[0-9]+") -> DataFrame:
    """B2: (page_id, n, is_empty) for every page that isn't a detail."""
    n = extract_links(pages, pattern).groupBy("page_id").agg(F.count("*").alias("n"))
    base = pages.where(~F.coalesce(is_detail_link("url", pattern), F.lit(False))).select("page_id")
    return base.join(n, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("is_empty"))


def headings(pages: DataFrame) -> DataFrame:
    """B1's title and heading of every page."""
    return pages.select("page_id", element(F.col("html"), "title").alias("title"), element(F.col("html"), "h1").alias("h1"))
