"""Golden rows of the text functions."""

import pytest
from pyspark.sql import functions as F

from listinglab.functions import geo
from listinglab.functions import text as tx



def apply(spark, f, *args):
    return spark.range(1).select(f(*[F.lit(a) for a in args]).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "station", "walk"),
    [("Юго-Западная • 8 мин.", "Юго-Западная", 8), ("Площадь Ильича, 12 мин.", "Площадь Ильича", 12), ("Китай-город", "Китай-город", None), ("Сокол, выход 2", "Сокол", None), ("8 мин.", "", 8), ("Сокол • 5 МИН", "Сокол", 5)],
)
def test_metro(spark, text, station, walk):
    got = apply(spark, tx.parse_metro, text)
    assert (got["station"], got["walk_min"]) == (station, walk)


@pytest.mark.parametrize(("text", "n"), [("Квартира-студия, 25 м²", 0), ("2-комнатная квартира", 2), ("4-х комнатная", 4), ("3 комн.", 3), ("5-к. кв., 100 м²", 5), ("двухкомнатная", 2), ("Шестикомнатная", 6), ("просторный дом", None)])
def test_rooms(spark, text, n):
    assert apply(spark, tx.rooms_from_text, text) == n


@pytest.mark.parametrize(("text", "area", "floor", "total"), [("54,3 м² на 5 этаже из 9", 54.3, 5, 9), ("19 этаж из 29", None, 19, 29), ("нет", None, None, None)])
def test_area_and_floor(spark, text, area, floor, total):
    f = apply(spark, tx.floors_from_text, text)
    assert (apply(spark, tx.area_from_text, text), f["floor"], f["floors_total"]) == (area, floor, total)


@pytest.mark.parametrize(("text", "year"), [("2008г", 2008), ("в 1234 и 2001", None), ("дом 1999 года", 1999), ("12005", None)])
def test_year(spark, text, year):
    assert apply(spark, tx.first_year, text) == year


@pytest.mark.parametrize(("text", "name"), [("кирпично-монолитный дом", "кирпично-монолитный"), ("монолит, каркас", "монолитно-каркасный"), ("газобетонный блок", "газобетон"), ("сталинка", "сталинский"), ("дача", ""), ("Панельный", "панельный")])
def test_material(spark, text, name):
    assert apply(spark, tx.house_material, text) == name


@pytest.mark.parametrize(
    ("f", "args", "want"),
    [
        (tx.currency, (" rur ",), "RUB"),
        (tx.currency, ("€",), "EUR"),
        (tx.currency, ("kzt",), "KZT"),
        (tx.number, ("170 000,5",), 170000.5),
        (tx.number, ("abc",), None),
        (tx.external_id, ("https://x.y/offer/5180127926972954744/",), "5180127926972954744"),
        (tx.external_id, ("https://a.b/c/d/",), "a.b-c-d"),
        (tx.price_period, ("rent_long", "цена в месяц"), "month"),
        (tx.price_period, ("rent_long", "за сутки"), "day"),
        (tx.price_period, ("sale", "в месяц"), None),
        (tx.canon_addr, (" Ёлка  ёж ",), "ёлка еж"),
        (tx.fmt_rub, (174557.007,), "174 557"),
        (tx.fmt_rub, (2.5,), "2"),
        (tx.round_thousand, (174557.0,), 175000),
        (tx.price_per_m2, (170000.0, 90.0), 1888.89),
        (tx.price_per_m2, (89500.0, 60.0), 1491.67),
        (tx.price_per_m2, (0.0, 60.0), 0.0),
        (tx.rooms_bucket, (None,), "other"),
        (tx.rooms_bucket, (-1,), "studio"),
        (tx.rooms_bucket, (1.9,), "r1"),
        (tx.rooms_bucket, (4,), "r4"),
        (tx.rooms_bucket, (7,), "r5p"),
        (tx.strip_city_prefix, ("Россия, Москва, Тверская улица, 1",), "Тверская улица, 1"),
        (tx.strip_city_prefix, ("Москва, ",), "Москва, "),
        (tx.empty_to_null, ("   ",), None),
        (geo.walk_min, (1298.9228372170382,), 17),
        (geo.walk_min, (None,), None),
    ],
)
def test_scalars(spark, f, args, want):
    assert apply(spark, f, *args) == want


@pytest.mark.parametrize(("a", "city", "want"), [("Тверская, 1", "Москва", "Москва, Тверская, 1"), ("", "Казань", "Казань"), ("Тверская", "", "Тверская"), ("Москва, Арбат", "Казань", "Москва, Арбат")])
def test_geocode_query(spark, a, city, want):
    assert apply(spark, lambda x, y: tx.geocode_query(x, y, "Москва"), a, city) == want


def test_distance(spark):
    km = apply(spark, lambda a, b, c, d: geo.haversine_km((a, b), (c, d)), 55.7190196, 37.4788686, 55.7558, 37.6173)
    assert km == pytest.approx(9.582564978642905, abs=1e-12)


def test_pair_score_adds_up_to_the_limit(spark):
    row = {"area_total": 50.0, "price_rub": None, "floor": 1, "year_built": 2000, "house_material": "кирпичный"}
    lit = lambda r: {k: F.lit(v).cast("double") if k in ("area_total", "price_rub") else F.lit(v) for k, v in r.items()}
    score = lambda other: spark.range(1).select(tx.pair_score(lit(row), lit(row | other)).alias("s")).first()[0]
    assert score({"floor": 2, "year_built": 2001, "house_material": "кирзавод"}) >= 0.70
    assert score({"floor": 2, "year_built": 2002, "house_material": "кирзавод"}) < 0.68


def test_text_blocks(spark):
    feats = F.expr("array(named_struct('feature', 'floor', 'contribution', 0.1D), named_struct('feature', 'house_material_панельный', 'contribution', -0.2D))")
    args = [F.lit("Казань"), F.lit("Баумана, 1"), F.lit(40.0), F.lit(3), F.lit(None).cast("int"), F.lit(50000.0), F.lit(None).cast("double"), F.lit(None).cast("double"), feats]
    got = spark.range(1).select(tx.text_blocks(*args).alias("t")).first()["t"]
    assert got["summary_short"] == "Объект в городе Казань, по адресу «Баумана, 1». Оценочная ставка аренды: ~50 000 ₽/мес."
    assert got["factors_summary"][0] == "Этаж расположения квартиры (этаж 3) немного повышает стоимость аренды."
    assert got["factors_summary"][1].endswith("незначительно её снижает.")
    assert got["summary_long"].startswith(got["summary_short"] + " Наибольшее влияние")
