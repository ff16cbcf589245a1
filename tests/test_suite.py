"""Every registered listing query against its DuckDB twin."""

import inspect

import pytest
from oracle import connect, same

import __spark_entry__ as entry
from listinglab.plans import suite

SLOW = {"price_predictions", "price_explanations", "requests_to_reports"}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(suite.ORACLE_SQL))
def test_query_equals_sql(spark, data, con, name):
    same(suite.QUERIES[name](spark, data), con, suite.ORACLE_SQL[name])


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(suite.QUERIES) - set(suite.ORACLE_SQL) == SLOW


@pytest.fixture
def small_model(monkeypatch):
    """Fewer trees: what is tested doesn't depend on their number. Gives the sizes asked for."""
    from listinglab.operators import model as m

    train, size = m.train, []

    def quick(*args, **kw):
        call = inspect.signature(train).bind(*args, **kw)
        call.apply_defaults()
        size.append((call.arguments["trees"], call.arguments["depth"]))
        call.arguments.update(trees=8, depth=4)
        return train(*call.args, **call.kwargs)

    monkeypatch.setattr(m, "train", quick)
    suite._MODELS.clear()
    yield size
    suite._MODELS.clear()


def test_explanations_add_up_and_intervals_hold_the_estimate(spark, data, small_model):
    from pyspark.sql import functions as F

    from listinglab.operators import model as m

    fitted, rows = suite._model(spark, data)
    out = m.explain(fitted, m.predict(fitted, rows)).cache()
    off = F.abs(F.aggregate("contributions", F.col("base_value"), lambda a, c: a + c["contribution"]) - F.col("prediction"))
    assert out.agg(F.max(off)).first()[0] < 1e-9
    assert out.where("prediction_rub < interval_low_rub or prediction_rub > interval_high_rub").count() == 0
    inside = out.where("price_rub between 10000 and 600000").agg(F.avg((F.abs(F.ln("price_rub") - F.col("prediction")) <= fitted.eps + 1e-9).cast("int"))).first()[0]
    assert inside >= 0.9
    mean = rows.where("price_rub between 10000 and 600000").agg(F.avg(F.abs(F.col("price_rub") - fitted.mean.first()[0]))).first()[0]
    assert fitted.metrics["mae"] <= mean
    assert fitted.low < fitted.high
    wide = m.predict(fitted, rows, interval="quantile")
    assert wide.where("prediction_rub < interval_low_rub or prediction_rub > interval_high_rub or interval_low_rub is null").count() == 0


def test_model_queries_train_fully_once_and_take_all_rentals(spark, data, small_model):
    want = sorted(r["id"] for r in suite.listing(spark, data).where("deal_type <> 'sale'").select("id").collect())
    assert sorted(r["id"] for r in suite.price_predictions(spark, data).collect()) == want
    told = suite.price_explanations(spark, data).collect()
    assert sorted(r["id"] for r in told) == want
    assert all(len(r["top_features"]) == 8 and [abs(f["contribution"]) for f in r["top_features"]] == sorted((abs(f["contribution"]) for f in r["top_features"]), reverse=True) for r in told[:50])
    assert small_model == [(100, 6)]
    reports = suite.requests_to_reports(spark, data).collect()
    assert len(reports) == suite.star.view(spark, data, "request").count()
    for r in reports:
        assert (r["reject"] is None) == (r["pricing"]["prediction_rub"] is not None)
        if r["reject"] is None:
            assert r["pricing"]["interval_low_rub"] <= r["pricing"]["prediction_rub"] <= r["pricing"]["interval_high_rub"] and r["enriched"]["density_500m"] is not None


def test_training_tables(spark, data):
    from pyspark.sql import functions as F

    from listinglab.sources.io import EXPORT

    rows = suite.run_pipeline(suite.raw(spark, data), suite.star.stations(spark, data), suite.star.cities(spark, data), suite.star.as_of()).cache()
    export, train, valid = suite.training_tables(rows, ratio=0.3)
    assert export.columns == EXPORT and export.count() == rows.where("is_active").count()
    rents = rows.where("deal_type = 'rent_long'")
    assert train.count() + valid.count() == rents.count() and train.agg(F.max("last_seen")).first()[0] < valid.agg(F.min("last_seen")).first()[0]


def test_the_model_queries_share_their_rows(spark, data, small_model):
    """Rows that the model reads are made once, not by each query and each part of the training."""
    first = suite._model(spark, data)
    assert suite._model(spark, data)[1] is first[1] and "listingraw" not in first[1]._jdf.queryExecution().toString().replace("_", "")


def test_requests_are_stored_before_their_features(spark, data, monkeypatch):
    """The features of requests read resolved requests in four parts. Each held all of their joins,
    in a plan that the driver rewrites with every stage."""
    from pyspark.sql import functions as F

    from listinglab.plans import pipeline

    class Enough(Exception):
        pass

    def kept(df, name="step", stored=pipeline.stored):
        if name == "requests":
            relations.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
            raise Enough
        return stored(df, name)

    relations = []
    monkeypatch.setattr(pipeline, "stored", kept)
    view = lambda name: suite.star.view(spark, data, name)
    with pytest.raises(Enough):
        pipeline.value_requests(view("request"), view("geocode_cache"), view("building_cache"), view("building").withColumn("year_built", F.lit(None).cast("int")), suite.listing(spark, data), suite.star.stations(spark, data), suite.star.cities(spark, data), None, suite.star.as_of())
    assert relations[0] < 12
