"""The HTML reader: elements of any depth, width and length, and broken pages."""

import time

from pyspark.sql import functions as F

from listinglab.functions.html import events, inner_by_class
from listinglab.operators import pages


def one(page, css="x", whole=True):
    return inner_by_class(page, [(css, whole)])[0]


def test_elements_of_any_depth_width_and_length():
    deep = "<div>" * 3000 + "end" + "</div>" * 3000
    assert one(f'<div class="a x1">{deep}</div><div>no</div>') == [deep]
    wide = "<div>c</div>" * 500
    assert one(f"<div CLASS='x'>{wide}</div>") == [wide]
    long = "t" * 100_000
    assert one(f"<p class=x>{long}</p>") == [long]


def test_elements_within_others_and_broken_ones():
    assert one('<i class="x">a<i>b</i><i class="x y">c</i></i>d') == ["a<i>b</i><i class=\"x y\">c</i>", "c"]
    assert one('</b><b class="x">a</b></b><b class="x">never closed') == ["a", "never closed"]
    assert one('<script>"<b class=x>no</b>"</script><!-- <b class="x">no</b> --><b class="ax">no</b><img class="x"><b title="<b class=x>" class=\'x\'>yes</b>') == ["yes"]
    assert one('<b class="ax">in</b><u class="AX|">U</u>', "ax|q", whole=False) == ["in", "U"]
    assert one("") == [] and one("<b class='x") == []


def test_time_grows_with_the_page():
    took = []
    for n in (20_000, 80_000):
        page = '<div class="x">' + "<p>" * n + '"' * n + "<a '" * n
        began = time.perf_counter()
        one(page)
        list(events(page))
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_golden_pages(spark):
    rows = [
        (1, '<div class="CardLocation__addressItem"><div><div><div><div><b>Lane</b></div></div></div></div> 5, </div>'),
        (2, '<span class="MetroWithTime">' + "".join(f"<span>s{k}</span>" for k in range(12)) + "</span>"),
        (3, '<div class="OfferCardFeature__text">' + "слово " * 2000 + "дом сдан в 1985, панельный</div>"),
        (4, None),
    ]
    df = spark.createDataFrame([(i, f"https://x.y/offer/12345{i}", h) for i, h in rows], "page_id int, url string, html string")
    got = {r["page_id"]: r for r in pages.extract_listings(df).collect()}
    assert got.keys() == {1, 2, 3}
    assert got[1]["address_text"].split() == ["Lane", "5"]
    assert got[2]["metro"].split() == [f"s{k}" for k in range(12)]
    assert (got[3]["year_built"], got[3]["house_material"]) == (1985, "панельный")
    texts = df.select("page_id", pages.by_class(F.col("html"), [("MetroWithTime", True), ("none", True)]).alias("t")).collect()
    assert {r["page_id"]: [len(x) for x in r["t"]] for r in texts} == {1: [0, 0], 2: [1, 0], 3: [0, 0], 4: [0, 0]}
