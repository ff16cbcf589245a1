"""Scalar functions on listing texts and numbers, all as column expressions.

Patterns fold Cyrillic case, and word edges next to digits are ASCII-only, so that a number
followed by a Cyrillic letter still ends there.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE_L, _EDGE_R = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
_NBSP = "[  ]+"
_DASH = "[-–—‑]"

# Words for the number of rooms, tried in this order.
ROOM_WORDS = [
    ("однокомнат", 1),
    ("двухкомн", 2),
    ("трехкомн", 3),
    ("трёхкомн", 3),
    ("четырехкомн", 4),
    ("четырёхкомн", 4),
    ("пятикомнат", 5),
    ("шестикомнат", 6),
]
# House materials by the words that must all occur, tried in this order.
MATERIALS = [
    (("кирпич", "монолит"), "кирпично-монолитный"),
    (("монолит", "каркас"), "монолитно-каркасный"),
    (("панел",), "панельный"),
    (("монолит",), "монолитный"),
    (("кирпич",), "кирпичный"),
    (("газобетон",), "газобетон"),
    (("пенобетон",), "пенобетон"),
    (("блок",), "блочный"),
    (("дерев",), "деревянный"),
    (("сталин",), "сталинский"),
    (("хрущ",), "хрущёвка"),
    (("брежнев",), "брежневка"),
]
# Address prefixes that name the country and city, tried in this order.
CITY_PREFIXES = ["Россия, Москва, ", "Россия, Москва,", "Москва, Россия, ", "Москва, Россия,", "Москва, "]
# Patterns of texts. A studio; numbers of rooms behind and before the word for
# rooms; an area; a floor of how many; a year; minutes on foot.
STUDIO = r"(^|[^\p{L}\p{N}])студи(?:я|ю|и|ей|е|о)($|[^\p{L}\p{N}])"
ROOMS_AFTER = [rf"\s*{_DASH}?\s*комнат", rf"\s*{_DASH}?\s*[xх]\s*комнат", rf"\s*(?:{_DASH}?\s*)?комн", rf"\s*{_DASH}?\s*к(?:\.)?\s*(?:кв|квар)"]
ROOMS_BEFORE = [r"комнат[0-9A-Za-z_]*", r"комн\.?", "комнаты"]
AREA = r"(\d+(?:[\.,]\d+)?)\s*м²"
FLOORS = [r"(?u)на\s*(\d+)\s*этаж[е]?\s*из\s*(\d+)", rf"(?u){_EDGE_L}(\d+)\s*этаж[е]?\s*из\s*(\d+)"]
YEAR = rf"{_EDGE_L}(1\d{{3}}|20\d{{2}}|2100){_EDGE_R}"
MINUTES = r"(?iu)(\d{1,3})\s*мин"
# A report's sentences.
SUMMARY = ["Объект в городе ", "по адресу «{address}»", "Оценочная ставка аренды: ~{pred} ₽/мес", " (диапазон {low}–{high} ₽/мес)."]
FACTORS = {
    "area_total": "Большая общая площадь квартиры (~{area} м²) заметно {way} прогнозируемую стоимость.",
    "dist_to_center_km": "Удалённость от центра города {way} ожидаемую цену аренды.",
    "house_material_": "Материал дома («{material}») слабо влияет на итоговую оценку и лишь незначительно её {way}.",
    "floor": "Этаж расположения квартиры (этаж {floor}) немного {way} стоимость аренды.",
    "metro_walk_min": "Время пешей доступности до метро (≈{walk} минут) слегка {way} цену.",
    "": "Признак «{name}» умеренно {way} оценку объекта (вклад {size} в лог-пространстве).",
}
MAIN_FACTORS = " Наибольшее влияние на оценку оказывают следующие факторы: "


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(text: Column | str) -> Column:
    """Without white space of any kind, no-break spaces too, at both ends."""
    return F.regexp_replace(_c(text), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def found(text: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match or with an empty group."""
    return F.nullif(F.regexp_extract(_c(text), pattern, group), F.lit(""))


def stripped(text: Column, chars: str, left: bool = True) -> Column:
    cls = "[" + "".join("\\" + c if c in "-]^\\" else c for c in chars) + "]+"
    return F.regexp_replace(text, (f"^{cls}|" if left else "") + f"{cls}$", "")


def monthly_price(deal: Column | str, value: Column | str, days: float = 30.0) -> Column:
    """F1: the price for a month: daily rents times `days` (30.44 if not above 0)."""
    return F.when(_c(deal) == "rent_daily", _c(value) * F.lit(days if days > 0 else 30.44)).otherwise(_c(value))


def period(deal: Column | str) -> Column:
    """month for rents, null for sales."""
    return F.when(_c(deal).isin("rent_long", "rent_daily"), "month")


def price_per_m2(price: Column | str, area: Column | str) -> Column:
    """rounded to cents; null without a price or a positive area."""
    return F.when(_c(price).isNotNull() & (_c(area) > 0), F.round(_c(price) / _c(area), 2))


def metro_text(text: Column | str) -> Column:
    """The text of F3 in single spaces: `parse_metro` of it looks at it several times, so let a
    projection below compute it."""
    return F.regexp_replace(F.regexp_replace(trimmed(text), _NBSP, " "), r"\s+", " ")


def parse_metro(text: Column | str, ready: bool = False) -> Column:
    """struct(station, walk_min): what stands before "N мин", or without minutes the text up
    to a comma; separators around it go. No station: empty; no minutes: null. ready: the text
    is `metro_text`'s."""
    t = _c(text) if ready else metro_text(text)
    at = F.regexp_instr(t, F.lit(MINUTES))
    name = stripped(F.when(at > 0, F.substr(t, F.lit(1), at - 1)).otherwise(F.substring_index(t, ",", 1)), " •·,;-", left=False)
    name = F.when(at > 0, stripped(name, " -—–")).otherwise(name)
    return F.struct(trimmed(name).alias("station"), found(t, MINUTES).cast("int").alias("walk_min"))


def station(parsed: Column, stored: Column | str) -> Column:
    """the parsed station, or the stored one if that is empty."""
    return F.coalesce(F.nullif(parsed, F.lit("")), _c(stored))


def empty_to_null(text: Column | str) -> Column:
    """single spaces, trimmed, empty as null."""
    return F.nullif(trimmed(F.regexp_replace(_c(text), r"\s+", " ")), F.lit(""))


def rooms_bucket(rooms: Column | str) -> Column:
    """other (null), studio (0 or less), r1 to r4, r5p; fractions are cut off."""
    n = _c(rooms).cast("int")
    return F.when(n.isNull(), "other").when(n <= 0, "studio").when(n <= 4, F.concat(F.lit("r"), n.cast("string"))).otherwise("r5p")


def canon_addr(address: Column | str) -> Column:
    """lower case, ё as е (only those that were small), single spaces; null as empty."""
    t = F.lower(F.trim(F.translate(F.coalesce(_c(address), F.lit("")), "ё", "е")))
    return F.regexp_replace(t, r"\s+", " ")


def address_hash(address: Column | str) -> Column:
    """F8: sha1 of the trimmed lower-case address."""
    return F.sha1(F.lower(trimmed(address)))


def geocode_query(address: Column | str, city: Column | str, default_city: str) -> Column:
    """the city in front, if neither it nor the default stands in the address. An empty
    city leaves the address as it is."""
    a, c = trimmed(F.coalesce(_c(address), F.lit(""))), F.coalesce(_c(city), F.lit(""))
    return F.when(a == "", c).when((c == "") | a.contains(c) | (a.contains(default_city) if default_city else F.lit(False)), a).otherwise(F.concat(c, F.lit(", "), a))


def strip_city_prefix(address: Column | str, prefixes: list[str] = CITY_PREFIXES) -> Column:
    """without the first fitting prefix, if something follows it."""
    a, out = _c(address), None
    for p in prefixes:
        fits = a.startswith(p) & (F.length(a) > len(p))
        cut = F.substr(a, F.lit(len(p) + 1))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(a)


def house_age(year_built: Column | str, as_of: Column) -> Column:
    """whole years since `year_built`, at least 0; null stays null."""
    return F.when(_c(year_built).isNotNull(), F.greatest(F.year(as_of) - _c(year_built), F.lit(0)))


def price_per_m2_calc(price: Column | str, area: Column | str) -> Column:
    """null for an area of 0."""
    return _c(price) / F.nullif(_c(area), F.lit(0.0))


def currency(text: Column | str) -> Column:
    """F13"""
    t = F.upper(trimmed(text))
    return F.when(t.isin("RUB", "RUR", "₽"), "RUB").when(t.isin("USD", "$"), "USD").when(t.isin("EUR", "€"), "EUR").otherwise(t)


def number(text: Column | str) -> Column:
    """a number written with spaces or a decimal comma; anything else is null."""
    return F.regexp_replace(F.regexp_replace(_c(text), "[  ]", ""), ",", ".").try_cast("double")


def external_id(url: Column | str) -> Column:
    """the first run of six digits or more, or else the url without scheme, `/` as `-`."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(url), "^https://", ""), "^http://", ""), "^/+|/+$", "")
    return F.coalesce(found(url, "([0-9]{6,})"), F.regexp_replace(F.regexp_replace(rest, "/", "-"), "^-+|-+$", ""))


def first_year(text: Column | str) -> Column:
    """F16: the first four-digit number of a likely form, if it lies in 1900 to 2100."""
    y = found(text, YEAR).cast("int")
    return F.when(y.between(1900, 2100), y)


def osm_attributes(tags: Column) -> Column:
    """struct(floors_total, year_built, house_material) of a tag map."""
    floors = F.coalesce(*[tags[k].try_cast("double").cast("int") for k in ("building:levels", "levels")])
    first = F.coalesce(*[found(F.nullif(tags[k], F.lit("")), "((?:18|19|20)[0-9]{2})") for k in ("start_date", "year_of_construction", "building:year_built")])
    material = F.coalesce(F.nullif(tags["building:material"], F.lit("")), tags["material"])
    return F.struct(floors.alias("floors_total"), first.cast("int").alias("year_built"), material.alias("house_material"))


def house_material(text: Column | str) -> Column:
    """empty if no material is named."""
    t, out = F.lower(F.translate(F.coalesce(_c(text), F.lit("")), " ", " ")), F
    for words, name in MATERIALS:
        fits = t.contains(words[0])
        for w in words[1:]:
            fits = fits & t.contains(w)
        out = out.when(fits, F.lit(name))
    return out.otherwise("")


def is_studio(text: Column) -> Column:
    return F.lower(text).rlike("(?mu)" + STUDIO)


def _counted(t: Column, edge: str) -> list[Column]:
    return [found(t, rf"(?mu){edge}(\d+){f}").try_cast("int") for f in ROOMS_AFTER]


def _worded(t: Column) -> Column:
    out = F
    for w, n in ROOM_WORDS:
        out = out.when(t.contains(w), F.lit(n))
    return out.otherwise(F.lit(None).cast("int"))


def rooms_from_text(text: Column | str) -> Column:
    """0 for a studio, a number before "комн", or a number word; else null."""
    t = F.lower(_c(text))
    return F.when(is_studio(t), 0).otherwise(F.coalesce(*_counted(t, _EDGE_L), _worded(t)))


def rooms_from_page(text: Column, title: Column, description: Column, h1: Column) -> Column:
    """F19 for a whole page: a studio by its headings, numbers before or behind "комн", words."""
    t = F.translate(F.lower(text), " ", " ")
    back = [found(t, rf"(?mu){f}\s*[:–-]?\s*(\d+)").try_cast("int") for f in ROOMS_BEFORE]
    studio = F.lit(False)
    for x in (title, description, h1):
        studio = studio | F.coalesce(is_studio(x), F.lit(False))
    return F.when(studio, 0).otherwise(F.coalesce(*_counted(t, ""), *back, _worded(t)))


def area_from_text(text: Column | str) -> Column:
    """the first number before "м²"."""
    return number(found(F.lower(_c(text)), AREA))


def floors_from_text(text: Column | str) -> Column:
    """struct(floor, floors_total) of "N этаж из M"."""
    t = F.lower(_c(text))
    one, two = FLOORS
    get = lambda g: F.when(t.rlike(one), found(t, one, g)).otherwise(found(t, two, g)).try_cast("int")
    return F.struct(get(1).alias("floor"), get(2).alias("floors_total"))


def price_period(deal: Column | str, text: Column | str) -> Column:
    """month or day by words of the text; null for sales."""
    t = F.lower(_c(text))
    return F.when(_c(deal) == "sale", None).when(t.contains("месяц"), "month").when(t.contains("сутки"), "day")


def fmt_rub(value: Column | str) -> Column:
    """rounded half to even, thousands parted by spaces."""
    return F.translate(F.format_number(F.bround(_c(value).cast("double"), 0), 0), ",", " ")


def round_thousand(value: Column | str) -> Column:
    """to the nearest thousand, half to even."""
    return (F.bround(_c(value) / 1000, 0) * 1000).cast("long")


def repair_interval(low: Column | str, mid: Column | str, high: Column | str) -> Column:
    """struct(low, high) around `mid`."""
    xs = [_c(low), _c(mid), _c(high)]
    return F.struct(F.least(*xs).alias("low"), F.greatest(*xs).alias("high"))


def log_target(price: Column | str) -> Column:
    """F26; its inverse is exp."""
    return F.ln(F.greatest(_c(price), F.lit(1.0)))


def area_penalty(area: Column | str, target: Column | str) -> Column:
    """the squared log ratio, clipped to a fifth and five; 0 without a positive target."""
    ratio = F.least(F.greatest(_c(area) / _c(target), F.lit(0.2)), F.lit(5.0))
    return F.when(_c(target) > 0, F.pow(F.ln(ratio), 2)).otherwise(0.0)


def text_blocks(city: Column, address: Column, area: Column, floor: Column, walk: Column, pred: Column, low: Column, high: Column, features: Column) -> Column:
    """struct(summary_short, summary_long, factors_summary) from a report's fields;
    `features` is array<struct<feature, contribution>>, of which five sentences are made."""
    say = lambda template, **parts: F.concat(*[parts[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", template) if x])
    header = F.concat_ws(", ", F.when(F.coalesce(city, F.lit("")) != "", F.concat(F.lit(SUMMARY[0]), city)), say(SUMMARY[1], address=F.coalesce(F.nullif(address, F.lit("")), F.lit("объект"))))
    rate, band = say(SUMMARY[2], pred=fmt_rub(pred)), say(SUMMARY[3], low=fmt_rub(low), high=fmt_rub(high))
    short = F.concat(header, F.lit(". "), F.coalesce(F.concat(rate, F.coalesce(band, F.lit("."))), F.lit("")))
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))

    def sentence(f: Column) -> Column:
        name = f["feature"]
        parts = {
            "way": F.when(f["contribution"] > 0, "повышает").otherwise("снижает"),
            "area": shown(area),
            "floor": shown(floor),
            "walk": F.coalesce(F.nullif(walk.cast("string"), F.lit("0")), F.lit("N")),
            "material": F.regexp_replace(name, "^house_material_", ""),
            "name": name,
            "size": F.format_string("%.2f", F.abs(f["contribution"])),
        }
        out = F
        for key, template in FACTORS.items():
            if key:
                out = out.when(name.startswith(key) if key.endswith("_") else name == key, say(template, **parts))
        return out.otherwise(say(FACTORS[""], **parts))

    named = F.filter(features, lambda f: F.coalesce(f["feature"], F.lit("")) != "")
    factors = F.slice(F.transform(named, sentence), 1, 5)
    long_ = F.when(F.size(factors) > 0, F.concat(short, F.lit(MAIN_FACTORS), F.array_join(factors, " "))).otherwise(short)
    return F.struct(short.alias("summary_short"), long_.alias("summary_long"), factors.alias("factors_summary"))


def pair_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """how alike two candidate listings are, from their price, area, floor, year and
    material; added in this order, as doubles."""
    both = lambda k: a[k].isNotNull() & b[k].isNotNull()
    head = lambda c: F.substring(c.cast("binary"), 1, 6)  # noqa: E731  six bytes: three Cyrillic letters
    parts = [
        (both("area_total"), 0.25),
        (both("price_rub"), 0.20),
        (both("floor") & (a["floor"] == b["floor"]), 0.10),
        (both("year_built") & (F.abs(a["year_built"] - b["year_built"]) <= 1), 0.03),
        (both("house_material") & (a["house_material"] != "") & (b["house_material"] != "") & (head(a["house_material"]) == head(b["house_material"])), 0.02),
    ]
    score = F.lit(0.40)
    for fits, w in parts:
        score = score + F.when(F.coalesce(fits, F.lit(False)), F.lit(w)).otherwise(0.0)
    return score
