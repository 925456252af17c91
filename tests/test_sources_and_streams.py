from pyspark.sql import functions as F

from terraloom.sources import files
from terraloom.streaming import jobs


def test_chunk_files(spark, tmp_path):
    path = tmp_path / "chunks"
    path.mkdir()
    (path / "a.jsonl").write_text('{"id":"1","text":"x","metadata":{"k":"v"}}\nbroken\n{"id":"","text":"x","metadata":{}}\n{"id":"2","text":"y","metadata":"no"}\n{"id":"3","text":" ","metadata":{}}\n')
    rows = files.read_chunks(spark, str(path))
    assert [(r.id, r.metadata) for r in rows.collect()] == [("1", {"k": "v"})]
    files.write_chunks(rows, str(tmp_path / "out"))
    files.write_chunks(rows, str(tmp_path / "out"), append=True)
    assert files.read_chunks(spark, str(tmp_path / "out")).count() == 2


def test_articles_front_matter_and_lanes(spark, tmp_path):
    rows = spark.createDataFrame([("Côte d'Ivoire", "2024-03-01", "a"), (None, None, "b")], "country string, published string, body string")
    files.write_articles(rows, str(tmp_path / "articles"), "country", "published")
    assert {(r.country_slug, str(r.pub_year)) for r in spark.read.parquet(str(tmp_path / "articles")).collect()} == {("c-te-d-ivoire", "2024"), ("unknown", "unknown")}
    folder = tmp_path / "texts" / "kenya"
    folder.mkdir(parents=True)
    (folder / "x.txt").write_text('---\ntitle: "Rain"\ncountry:\n---\nbody\nmore')
    (folder / "y.txt").write_text("no header")
    got = {r.title: (r.country, r.body) for r in files.read_front_matter(spark, str(tmp_path / "texts"), ["title", "country"], str(tmp_path / "texts")).collect()}
    assert got == {"Rain": ("kenya", "body\nmore"), None: ("kenya", "no header")}
    (tmp_path / "lane.json").write_text('{"insight_text":"a"}\n{"text_insight":"b"}\n')
    assert {r.text for r in files.read_lanes(spark, str(tmp_path / "lane.json"), {"text": ["insight_text", "text_insight"]}).collect()} == {"a", "b"}


def test_exports_and_routes(spark, tmp_path):
    df = spark.createDataFrame([(2, "news"), (1, "paper")], "rank int, kind string")
    files.write_csv(df, str(tmp_path / "csv"), "rank")
    assert [r["rank"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["1", "2"]
    files.route(df, "kind", {"news": "articles"}, str(tmp_path / "routed"))
    assert {r.target for r in spark.read.parquet(str(tmp_path / "routed")).collect()} == {"articles", "other"}
    files.extract_partition(df, "rank > 1", str(tmp_path / "part"), ["rank"], 5)
    assert files.read_layer(spark, str(tmp_path), ".", "part").count() == 1


def stream(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    n = events.count()
    for i in range(3):
        events.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), events, n


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_counts_and_deduplication(spark, tmp_path, sf):
    live, events, n = stream(spark, tmp_path, sf)
    got = drain(jobs.counts(live, "ts", ["event_type"], late="100 days"), "counted", "complete")
    want = jobs.counts(events, "ts", ["event_type"], late="100 days")
    key = lambda df: sorted((r.event_type, r.window.start, r.n) for r in df.collect())
    assert key(got) == key(want)
    once = drain(jobs.deduplicate(live, "ts", F.col("user_id") % 7, "100 days"), "deduplicated")
    assert once.count() == 7


def test_rate_limit_in_batch_and_stream(spark, tmp_path, sf):
    assert jobs.accept([0, 1, 2, 59, 60.5, 61.5], [], 2, 60) == ([True, True, False, False, True, True], [60.5, 61.5])
    live, events, n = stream(spark, tmp_path, sf)
    batch = jobs.limit_rate(events, "user_id", "ts", "event_id", 2, 3600)
    assert batch.count() == n and batch.where("accepted").count() > 0
    assert drain(jobs.limit_rate_stream(live, "user_id", "ts", "event_id", 2, 3600), "limited").count() == n


def test_waiting_rate_limit_equals_the_batch(spark, tmp_path, sf):
    """Thirds of the events arrive out of order; a row far ahead lets the watermark pass them all, and the query ends by itself."""
    import datetime

    live, events, n = stream(spark, tmp_path, sf)
    last = events.agg(F.max("ts")).first()[0]
    ahead = spark.createDataFrame([(-1, last + datetime.timedelta(days=900))], "event_id long, ts timestamp_ntz")
    ahead = events.limit(1).drop("event_id", "ts").crossJoin(ahead).select(*[F.col(c).cast(t) for c, t in events.dtypes])
    ahead.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = drain(jobs.limit_rate_stream(live, "user_id", "ts", "event_id", 2, 3600, late="400 days"), "waited")
    want = jobs.limit_rate(events, "user_id", "ts", "event_id", 2, 3600)
    rows = lambda df: sorted((r.user_id, r.event_id, r.accepted) for r in df.collect() if r.event_id != -1)
    assert rows(got) == rows(want) and len(rows(want)) == n


def test_batch_rate_limit_matches_a_plain_loop(spark):
    import random

    rng = random.Random(3)
    events = [(rng.choice([1, 1, 1, 2, None]), i, None if i % 50 == 49 else rng.randrange(3000)) for i in range(600)]
    df = spark.createDataFrame(events, "u int, i int, s int").selectExpr("u", "i", "timestamp_seconds(s) AS t")
    want = {i: False for _, i, s in events if s is None}
    for u in (1, 2, None):
        own = sorted((s, i) for v, i, s in events if v == u and s is not None)
        want |= dict(zip([i for _, i in own], jobs.accept([float(s) for s, _ in own], [], 3, 60.0)[0], strict=True))
    got = {r.i: r.accepted for r in jobs.limit_rate(df, "u", "t", "i", 3, 60.0).collect()}
    assert got == want


def test_upsert_is_the_same_on_every_run(spark):
    from terraloom.operators import star

    target = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k int, p int, v string")
    new = spark.createDataFrame([(1, 6, "x"), (1, 6, "y"), (1, 7, "c"), (3, 6, "d"), (3, 6, "e"), (2, 5, "late")], "k int, p int, v string")
    for parts in (1, 5):
        out = star.upsert(target, new.repartition(parts), ["k"], "p")
        assert {tuple(r) for r in out.collect()} == {(1, 7, "c"), (2, 5, "b"), (3, 6, "e")}
    assert star.upsert(target.limit(0), new, ["k"], "p").count() == 3


def test_merge_batches(spark):
    target = {"df": spark.createDataFrame([(1, 1, "a")], "k int, p int, v string")}

    def write(df):
        target["df"] = spark.createDataFrame(df.collect(), df.schema)

    merge = jobs.merge_batches(lambda: target["df"], write, ["k"], "p")
    merge(spark.createDataFrame([(1, 1, "b"), (2, 2, "c")], "k int, p int, v string"), 0)
    first = {(r.k, r.v) for r in target["df"].collect()}
    merge(spark.createDataFrame([(2, 2, "c")], "k int, p int, v string"), 1)
    assert first == {(1, "b"), (2, "c")} == {(r.k, r.v) for r in target["df"].collect()}
