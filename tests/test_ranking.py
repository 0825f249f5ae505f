from pyspark.sql import functions as F

from grainfield.functions.sites import site_of
from grainfield.operators.ranking import grouped_rank, latest_by


def test_grouped_rank_matches_plain_numbering(spark):
    rows = [("a" if i % 3 else None, (i * 7919) % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    got = {(r.g, r.id): r["rank"] for r in grouped_rank(df, ["g"], [F.col("v").desc(), F.col("id")]).collect()}
    for g in ("a", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[g, r[2]] for r in own] == list(range(1, len(own) + 1))


def test_grouped_rank_of_nothing(spark):
    assert grouped_rank(spark.createDataFrame([], "g string, v int"), ["g"], [F.col("v")]).count() == 0


def test_latest_by_over_files_and_frames(spark, tmp_path):
    rows = [(1, 10, "x"), (1, 12, "y"), (2, None, "z"), (2, 5, "w"), (3, 1, "q"), (3, 1, "q"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "id int, at int, t string")
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    for x in (df, spark.read.parquet(str(tmp_path / "t"))):
        assert sorted(((r.id or 0), r.t) for r in latest_by(x, "id", "at").collect()) == [(0, "n"), (1, "y"), (2, "w"), (3, "q")]


def test_site_of(spark):
    want = {
        "https://WWW.Ex.org./a": "ex.org", "HTTP://me:pw@ex.org:8443/x": "ex.org", "https://www.www.ex.org": "www.ex.org", "//ex.org/q": "ex.org",
        "https://docs.ex.org?x=1": "docs.ex.org", "not a url": "", "": "", "https://ex.org#t": "ex.org", "https://[::1]:80/": "[::1]",
    }
    df = spark.createDataFrame([(u,) for u in want] + [(None,)], "u string").select("u", site_of(F.col("u")).alias("s"))
    assert {r.u: r.s for r in df.collect()} == want | {None: ""}
