"""A resource in a database: what reaches the store, and results, on an embedded one."""

import pytest
from pyspark.sql import functions as F

from graphweft.engine import Engine
from graphweft.sources.graph import Graph
from graphweft.sources.resource import Resource, Vocabulary, series_template
from graphweft.sources.store import pushed, store_table

V = Vocabulary("http://e/")
DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
URL = "jdbc:derby:memory:graphweft;create=true"
ROWS = [(f"s{k % 3}", f"2024-01-01 0{k % 9}:00:00", float(k)) for k in range(60)]


@pytest.fixture(scope="module")
def points(spark):
    con = spark._jvm.java.sql.DriverManager.getConnection(URL)
    st = con.createStatement()
    st.execute('CREATE TABLE "points" ("id" VARCHAR(8), "timestamp" TIMESTAMP, "value" DOUBLE, "unused" INT)')
    st.execute('INSERT INTO "points" VALUES ' + ", ".join(f"('{i}', TIMESTAMP('{t}'), {v}, 0)" for i, t, v in ROWS))
    st.execute('CREATE TABLE "none" ("id" VARCHAR(8), "value" DOUBLE)')
    con.close()
    yield lambda **k: store_table(spark, URL, "APP.points", **k)


def test_pushes_filters_columns_and_aggregates(points):
    (scan,) = pushed(points().where("value > 20").select("id"))
    assert "value" in scan and "> 20" in scan and "unused" not in scan
    (scan,) = pushed(points().groupBy("id").agg(F.sum("value").alias("x")))
    assert "PushedAggregates" in scan and "SUM" in scan and "PushedGroupByExpressions" in scan


def test_ranges_lose_nothing(spark, points):
    df = points(split=("value", 4))
    assert df.rdd.getNumPartitions() == 4 and df.count() == 60
    assert store_table(spark, URL, "APP.none", split=("value", 4)).count() == 0
    with pytest.raises(ValueError):
        store_table(spark, "jdbc:derby:memory:other", "APP.points")


def test_as_a_resource(spark, points):
    g = Graph(spark).load_turtle("""@prefix e: <http://e/> . e:a e:hasTimeseries [ e:hasExternalId "s1" ; e:hasResource "points" ] .""")
    engine = Engine(spark, g, [Resource("points", points(), series_template(V))], V)
    df = engine.query("PREFIX e: <http://e/> SELECT ?n (SUM(?v) AS ?total) WHERE { ?n e:hasTimeseries/e:hasDataPoint ?d . ?d e:hasValue ?v FILTER(?v >= 30) } GROUP BY ?n")
    assert "30" in pushed(df)[0] and "unused" not in pushed(df)[0]
    assert [tuple(r) for r in df.collect()] == [("<http://e/a>", sum(v for i, _, v in ROWS if i == "s1" and v >= 30))]
