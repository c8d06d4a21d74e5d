"""Files that routes stand behind: the join grows with the sets of names, not with the routes."""

from pyspark.sql import functions as F

from siftlake.operators import routes as R

ROUTE = "ord long, handler string, middleware array<string>, auth string"


def test_routes_of_the_same_names_are_joined_once(spark):
    many = spark.range(3000).select(F.col("id").alias("ord"), F.lit("f1.get").alias("handler"), F.array(F.lit("use(f2)")).alias("middleware"), F.when(F.col("id") % 2 == 0, "a").alias("auth"))
    odd = spark.createDataFrame([(1, "f3", [], None), (9000, None, None, "a"), (9001, "f4.x", ["f1, f4"], "a"), (9001, "f2", [], "a")], ROUTE)
    symbols = spark.createDataFrame([(file, name) for file in ("a.ts", "b.ts") for name in ("f1", "f2")] + [("c.ts", "f4"), ("d.ts", "f3"), ("e.ts", "f9"), ("a.ts", "f1")], "file string, name string")
    found = R.backed_files(symbols.select("file"), symbols, many.unionByName(odd))
    assert sorted(map(tuple, found.collect())) == [("a.ts", 3001, False), ("b.ts", 3001, False), ("c.ts", 1, True), ("d.ts", 1, False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "n#" in plan.split("Join", 1)[1], "the sets are counted below the join"
