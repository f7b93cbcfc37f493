import json

from pyspark.sql import functions as F

from pageflow.settings import USUAL_SPEED, Settings, next_version, restored


def test_restore():
    assert Settings.restore(None) == Settings() == Settings.restore("{") == Settings.restore("[1]")
    own = Settings.restore(json.dumps({"model": "m", "nearby_pages": "x", "characters_per_second": 200, "schema_version": 2}))
    assert (own.model, own.nearby_pages, own.characters_per_second) == ("m", 2, 200)
    assert Settings.restore(json.dumps({"characters_per_second": 200})).characters_per_second == USUAL_SPEED
    assert Settings.restore(own.store()) == own


def test_versions_rise():
    assert next_version(5_000_000, 1) == 5_000_001 and next_version(0, 7) == 7000


def test_a_column_of_settings(spark):
    """The same as one by one."""
    own = [None, "", "{", "[1]", "7", "null", "{}", json.dumps({"model": "m", "nearby_pages": "x", "characters_per_second": 200, "schema_version": 2}), json.dumps({"characters_per_second": 9, "schema_version": 2}), json.dumps({"characters_per_second": True, "concurrency": 2.5, "provider": None, "schema_version": 2}), json.dumps({"characters_per_second": 300}), Settings(model="q", language="it's").store()]
    df = spark.createDataFrame(list(enumerate(own)), "i int, s string").selectExpr("*").withColumn("r", restored(F.col("s")))
    for r in df.collect():
        assert r.r.asDict() == Settings.restore(own[r.i]).__dict__, own[r.i]
