import pytest
from pyspark.sql import functions as F

from sparkloom.extensions import Plugin, Registry, Sync, as_files
from sparkloom.functions import registered
from sparkloom.plans.engine import Engine
from sparkloom.sources import parsers
from sparkloom.sources.connectors import Connector


class Two(Connector):
    name, schedule = "two", "@daily"

    def fetch(self, spark):
        if self.config.get("broken"):
            raise RuntimeError("no access")
        return spark.createDataFrame([("x:1", "Heron", "nests by the lock"), ("x:2", "Otter", "swims")], "id string, title string, content string")


def test_registry(spark, tmp_path):
    registry = Registry()
    assert registry.register(Plugin("shout", extensions=(".shout",), parse=lambda content, name: content.decode().upper()))
    assert parsers.parse(b"hey", "a.shout") == "HEY"
    assert not registry.register(Plugin("bad", setup=lambda config: 1 / 0)) and "zero" in registry.failed["bad"]
    with pytest.raises(ValueError):
        registry.register(Plugin("shout"))
    registry.register(Plugin("turn", rerank=lambda q, df: df.withColumn("score", -F.col("score")), teardown=lambda: 1 / 0))
    assert registry.rerank("q", spark.createDataFrame([(1.0,)], "score double")).first()["score"] == -1.0
    assert [p.name for p in registry.of("parse")] == ["shout"]
    registry.unregister("turn")
    assert registry.of("rerank") == [] and registry.discover(["nothing"]) == []

    registry.register(Plugin("two", connector=Two()))
    registry.register(Plugin("broken", connector=Two()), {"broken": True})
    engine = Engine(spark, str(tmp_path / "index"))
    sync = Sync(registry)
    done = sync.run_all(spark, lambda df: engine.index(as_files(df, 5.0), 5.0)["indexed"], 5.0)
    assert done["two"]["documents"] == 2 and done["broken"]["error"] == "no access"
    assert {r["name"]: r["schedule"] for r in sync.overview()} == {"two": "@daily", "broken": "@daily"}
    assert engine.search("heron", 3, alpha=0.0).first()["path"] == "x:1"


def test_sql_functions(spark):
    registered.register(spark)
    row = spark.sql("SELECT index_terms('Ab c_d') AS a, word_tokens('Ab c_d') AS b, dot_product(array(1F, 2F), array(3F, 4F)) AS c, rrf_part(1D, 1) AS d, recency_boost(0D, 0D) AS e").first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == (["ab", "c", "d"], ["ab", "c_d"], 11.0, 1 / 61, 1.08)
