import pandas as pd
from pyspark.sql import functions as F

from presence.operators import measures


def test_photos_stand_as_objects_a_few_at_a_time(spark):
    """A batch of Arrow holds up to 10,000 rows; its photos must not become
    Python objects all at once. Rows keep their own answers."""

    def make():
        def work(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"n": [len(frame)] * len(frame), "data": [None if d is None else bytes(d)[::-1] for d in frame["data"]]})

        return work

    data = F.when(F.col("id") % 7 != 0, F.encode(F.concat(F.lit("x"), "id"), "utf-8"))
    seen = measures.per_row(measures.iterated(make), "n int, data binary")(F.struct(data.alias("data"), F.col("id")))
    rows = spark.range(1000).coalesce(1).select("id", seen.alias("seen")).collect()
    assert max(r["seen"]["n"] for r in rows) <= measures.UNPACKED
    assert {r["id"]: r["seen"]["data"] for r in rows} == {i: None if i % 7 == 0 else f"x{i}".encode()[::-1] for i in range(1000)}
    assert spark.range(0).select(seen.alias("seen")).collect() == []
