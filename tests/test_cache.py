"""Keyed cache tables: unique keys, lookups that leave the cache where it is, compaction."""

import pytest
from pyspark.sql import functions as F

from lingomesh.operators import embed
from lingomesh.sources.cache import KeyedCache

SCHEMA = "key string, vector array<float>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def stored(cache):
    return {r["key"]: r["vector"] for r in cache.read().collect()}


def test_appends_keep_keys_unique(spark, tmp_path):
    cache = KeyedCache(spark, str(tmp_path / "c"), buckets=4)
    cache.append(spark.createDataFrame([("a", [1.0]), ("b", [2.0]), (None, [9.0]), ("a", [0.5])], SCHEMA))
    cache.append(spark.createDataFrame([("a", [7.0]), ("c", [3.0])], SCHEMA))
    cache.append(spark.createDataFrame([], SCHEMA))
    assert stored(cache) == {"a": [0.5], "b": [2.0], "c": [3.0]}
    assert cache._newest().count() == 3                            # the second "a" was not written at all


def test_two_writers_of_one_key_read_as_one_row(spark, tmp_path):
    cache = KeyedCache(spark, str(tmp_path / "c"), buckets=4)
    for seq, value in ((2, [2.0]), (1, [1.0])):                    # appends that did not see each other
        rows = spark.createDataFrame([("a", seq, value)], "key string, seq long, vector array<float>")
        cache._write(rows, f"{cache.path}/v000001-b4", 4)
    assert cache._newest().count() == 2 and stored(cache) == {"a": [1.0]}
    cache.compact()
    assert cache._newest().count() == 1 and stored(cache) == {"a": [1.0]}


def test_lookup_does_not_shuffle_the_cache(spark, tmp_path, no_broadcast):
    cache = KeyedCache(spark, str(tmp_path / "c"), buckets=16)
    for part in range(3):
        cache.append(spark.range(part * 100, part * 100 + 150).select(F.col("id").cast("string").alias("key"), F.array(F.col("id").cast("float")).alias("vector")))
    assert "Exchange" not in plan_of(cache.read())
    asked = spark.range(50, 500).select(F.col("id").cast("string").alias("key"))
    found = asked.join(cache.read(), "key")
    assert plan_of(found).split("Final Plan")[0].count("Exchange hashpartitioning") == 1      # the rows that ask
    missed = asked.join(cache.read().select("key"), "key", "left_anti")
    assert plan_of(missed).split("Final Plan")[0].count("Exchange hashpartitioning") == 1
    assert found.count() == 300 and missed.count() == 150
    assert cache.read().count() == 350


def test_compaction_and_another_session_state(spark, tmp_path):
    cache = KeyedCache(spark, str(tmp_path / "c"), buckets=4)
    cache.append(spark.createDataFrame([("a", [1.0])], SCHEMA))
    cache.append(spark.createDataFrame([("b", [2.0])], SCHEMA))
    cache.compact()
    assert [v for v, _, _ in cache.versions()] == [1, 2]
    (tmp_path / "c" / "v000003-b4").mkdir()                        # a compaction that died: no marker
    assert stored(cache) == {"a": [1.0], "b": [2.0]}
    cache.drop_old()
    assert [v for v, _, _ in cache.versions()] == [2]
    for t in spark.catalog.listTables():                           # as a new session finds it: files only
        if t.name.startswith("lingomesh_cache_"):
            spark.sql(f"DROP TABLE {t.name}")
    again = KeyedCache(spark, str(tmp_path / "c"))
    again.append(spark.createDataFrame([("a", [5.0]), ("z", [6.0])], SCHEMA))
    assert stored(again) == {"a": [1.0], "b": [2.0], "z": [6.0]}
    assert again.versions()[-1][1] == 4                            # the folder keeps its number of buckets


def test_empty_cache(spark, tmp_path):
    assert KeyedCache(spark, str(tmp_path / "none"), "text string").read().collect() == []
    with pytest.raises(FileNotFoundError):
        KeyedCache(spark, str(tmp_path / "none")).read()
    cache = KeyedCache(spark, str(tmp_path / "c"), "vector array<float>", buckets=4)
    cache.append(spark.createDataFrame([], SCHEMA))               # a run without one vector
    assert stored(cache) == {}
    cache.append(spark.createDataFrame([("a", [1.0])], SCHEMA))
    assert stored(cache) == {"a": [1.0]}
    assert embed.read_cache(spark, str(tmp_path / "none")).dtypes == [("key", "string"), ("vector", "array<float>")]


def test_embedding_twice_asks_once(spark, tmp_path):
    path, asked = str(tmp_path / "c"), spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None)], "i long, text string")
    run = embed.embed_texts(asked.where("text IS NOT NULL"), "text", embed.sha1_embedder(4), cache=embed.read_cache(spark, path))
    embed.append_cache(path, run.new_cache)
    more = spark.createDataFrame([(0, "a"), (1, "c")], "i long, text string")
    run = embed.embed_texts(more, "text", embed.sha1_embedder(4), cache=embed.read_cache(spark, path))
    assert run.new_cache.count() == 1
    embed.append_cache(path, run.new_cache)
    assert embed.read_cache(spark, path).count() == 3


def test_a_run_that_dies_asks_again_for_open_slices_only(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([(i, f"text {i % 40}") for i in range(80)] + [(80, ""), (81, None)], "i long, text string")
    asked = spark.sparkContext.accumulator(0)
    whole = embed.sha1_embedder(4)

    def flaky(limit):
        stop = tmp_path / f"stop{limit}"

        def fn(texts):
            done = len(list(stop.parent.glob("*.asked")))
            if done >= limit:
                raise embed.FatalEmbeddingError("HTTP 401")
            for t in texts:
                (stop.parent / f"{hash(t)}.asked").touch()
            asked.add(len(texts))
            return whole(texts)
        return fn

    with pytest.raises(embed.FatalEmbeddingError):
        embed.embed_in_slices(df, "text", flaky(15), path, slices=4, batch_size=100)
    first = asked.value
    done = embed.read_cache(spark, path).count()
    assert 0 < first < 40 and done == first
    run = embed.embed_in_slices(df, "text", flaky(1000), path, slices=4, batch_size=100)
    assert asked.value == 40                                        # no text was asked for twice
    rows = {r["i"]: r["vector"] for r in run.rows.collect()}
    assert len(rows) == 82 and rows[80] is None and rows[81] is None
    assert all(rows[i] == rows[i + 40] == pytest.approx(whole([f"text {i}"])[0]) for i in range(40))
    assert run.new_cache.count() == 40 - done


def test_texts_that_fail_in_a_slice_keep_their_reason(spark, tmp_path):
    def fn(texts):
        if "bad" in texts:
            raise RuntimeError("HTTP 400")
        return [[1.0]] * len(texts)

    df = spark.createDataFrame([(0, "good"), (1, "bad")], "i long, text string")
    run = embed.embed_in_slices(df, "text", fn, str(tmp_path / "c"), slices=2, batch_size=1)
    rows = {r["i"]: r for r in run.rows.collect()}
    assert rows[0]["vector"] == [1.0] and rows[0]["error"] is None
    assert rows[1]["vector"] is None and "HTTP 400" in rows[1]["error"]
