from readloom.operators.session import kept, tagged, with_progress


def test_progress_tags_and_cache(spark):
    df, seen = with_progress(spark.range(100))
    with tagged(spark, "mine"):
        assert "mine" in spark.getTags()
        assert df.count() == 100
    assert "mine" not in spark.getTags() and seen.get["rows"] == 100
    held = kept(spark.range(5))
    assert held.count() == 5 and held.is_cached
    held.unpersist()
