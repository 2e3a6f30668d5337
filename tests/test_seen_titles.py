"""The index of seen titles: filters, merged segments, few rows read."""

import numpy as np
from pyspark.sql import functions as F

import shelfmark.streaming.seen_titles as st
from shelfmark.streaming.ingest import ingest_batch, read_ingested
from shelfmark.streaming.seen_titles import SeenTitles, filter_bits, may_hold, title_key


def _titles(spark, names):
    return spark.createDataFrame([(n,) for n in names], "title string").select(*title_key("title"))


def test_filters_never_lose_a_key():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    bits = filter_bits(hi, lo)
    assert may_hold(bits, hi, lo).all()
    other = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    assert may_hold(bits, *other).mean() < 0.02
    assert not may_hold(filter_bits(hi[:0], lo[:0]), hi, lo).any()


def test_batches_read_only_buckets_they_may_hit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "BUCKET_KEYS", 50)
    monkeypatch.setattr(st, "MERGED", 3)
    index, read = SeenTitles(spark, str(tmp_path / "seen")), []
    for batch in range(7):
        index.merge(batch)
        names = [f"title {batch} {i}" for i in range(200)] + [None] * (batch == 0)
        new, folders = index.seen(_titles(spark, names), batch)
        assert new.count() == 0
        read.append(index._keys(folders).count())
        index.write(_titles(spark, names), (0, batch))
    assert max(read[4:]) <= max(read[1:4]) + 200  # what a batch reads does not grow with the past
    assert index.in_use(7) == [(0, 6), (1, 0), (1, 1)] and index.in_use(5) == [(0, 3), (0, 4), (1, 0)]
    known, folders = index.seen(_titles(spark, ["title 1 5", "never stored", None]), 7)
    assert known.count() == 2 and 0 < len(folders) <= 3 and all("level=1/segment=0" in f for f in folders if "0" in f)
    assert index._keys(folders).count() < 300 < 1401
    again, _ = index.seen(_titles(spark, ["title 3 1"]), 3)
    assert again.count() == 0  # a batch that runs again does not see itself


def test_batches_that_run_again_and_tables_without_an_index(spark, tmp_path):
    out = str(tmp_path / "out")
    for name, titles in (("a", ["First title", "Second title"]), ("b", ["Second title", "Third title"]), ("c", ["First title", "Fourth title"])):
        (tmp_path / f"{name}.csv").write_text("title\n" + "\n".join(titles) + "\n")
    spark.createDataFrame([("Third title", 0)], "title string, ingest_ord long").withColumns(
        {c: F.lit(None).cast("string") for c in ("authors", "summary", "published", "url", "archivo")}
    ).write.parquet(f"{out}/batch_id=0")  # stored before there was an index
    for batch, name in ((1, "a"), (2, "b"), (2, "b"), (3, "c"), (3, "c")):
        ingest_batch(spark, [str(tmp_path / f"{name}.csv")], out, batch)
    rows = [(r["title"], r["batch_id"]) for r in read_ingested(spark, out).collect()]
    assert sorted(rows) == [("First title", 1), ("Fourth title", 3), ("Second title", 1), ("Third title", 0)]
