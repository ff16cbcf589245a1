"""Conditional intervals: their width follows the row, and they hold what they should."""

import numpy as np
from pyspark.sql import functions as F

from listinglab.operators import model


def test_conditional_intervals_cover_each_bucket(spark):
    rng = np.random.default_rng(4)
    n = 6000
    rooms = rng.integers(1, 4, n)
    area = rng.uniform(20, 100, n)
    noise = rng.normal(size=n) * np.array([0.0, 0.05, 0.15, 0.4])[rooms]
    price = np.exp(10.5 + 0.005 * area + 0.1 * rooms + noise)
    rows = [(int(i), int(r), float(a), float(p), "x", f"c{i % 3}", f"r{r}") for i, (r, a, p) in enumerate(zip(rooms, area, price, strict=True))]
    df = spark.createDataFrame(rows, "id long, rooms int, area_total double, price_rub double, house_material string, cell string, rooms_bucket string")
    train, valid, held = df.where("id % 3 = 0"), df.where("id % 3 = 1"), df.where("id % 3 = 2")
    fitted = model.train(train, valid, ["rooms", "area_total"], ["house_material"], trees=6, depth=3, conditional=True)
    out = model.predict(fitted, held.where("price_rub between 10000 and 600000"), interval="conditional")
    inside = F.avg((F.col("price_rub").between(F.col("interval_low_rub"), F.col("interval_high_rub"))).cast("double"))
    got = {r["rooms"]: (r["c"], r["w"]) for r in out.groupBy("rooms").agg(inside.alias("c"), F.avg(F.log(F.col("interval_high_rub") / F.col("interval_low_rub"))).alias("w")).collect()}
    assert abs(out.agg(inside).first()[0] - 0.8) < 0.06
    print(got)
    assert got[1][1] < got[2][1] < got[3][1]
    assert out.where("interval_low_rub > prediction_rub or interval_high_rub < prediction_rub").count() == 0
