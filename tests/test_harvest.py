"""The harvest source: batch, stream and restarted stream give the same entries."""

import json
import os
import random

from bibliospark.sources import harvest as H
from bibliospark.sources import landed


def page(n, status=200, entries=3):
    body = json.dumps({"search-results": {"entry": [{"dc:identifier": f"SCOPUS_ID:{n}-{k}"} for k in range(entries)]}})
    return (n, n * 25, status, body)


def land(spark, rows, folder):
    return H.land_pages(spark.createDataFrame(rows, "page long, start long, status int, body string").repartition(3), folder)


def ids(df):
    return sorted((r.start, r.pos, r.i) for r in H.entries_of(df).select(
        "start", "pos", landed.entry_id(H.F.col("entry")).alias("i")).collect())


def run(spark, folder, out, checkpoint):
    query = (H.stream_harvest(spark, folder).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return [p["numInputRows"] for p in query.recentProgress]


def test_batch_stream_and_restarted_stream_agree(spark, tmp_path):
    folder, out, once, cp, cp1 = (str(tmp_path / n) for n in ("pages", "out", "once", "cp", "cp1"))
    rows = [page(n) for n in range(150)] + [page(150, entries=0), (151, 151 * 25, 200, "no json"), page(152, 429), page(153)]
    pages = spark.createDataFrame([r[1:] for r in rows], "start long, status int, body string")
    want = sorted((r.start, r.pos, r.i) for r in landed.pages_until_error(pages).select(
        "start", "pos", landed.entry_id(H.F.col("entry")).alias("i")).collect())
    # nothing yet, then some with a gap, then all; another process starts each run
    read = lambda: spark.read.schema(H.SCHEMA).parquet(out)
    assert H.read_harvest(spark, folder).count() == 0
    assert land(spark, rows[:70] + rows[90:100], folder) == 80
    run(spark, folder, out, cp)
    assert ids(read()) == [w for w in want if w[0] < 70 * 25]
    land(spark, rows[70:90], folder)
    assert sum(run(spark, folder, out, cp)) == 30  # only what is new
    land(spark, random.Random(1).sample(rows[100:], 54), folder)
    run(spark, folder, out, cp)
    assert sum(run(spark, folder, out, cp)) == 0  # the failed page ends the harvest
    run(spark, folder, once, cp1)
    assert ids(read()) == ids(spark.read.schema(H.SCHEMA).parquet(once)) == ids(H.read_harvest(spark, folder)) == want
    assert read().count() == 152 and read().select("page").distinct().count() == 152


def test_pages_are_cut_over_tasks_and_half_written_files_ignored(spark, tmp_path):
    folder = str(tmp_path / "pages")
    land(spark, [page(n, entries=1) for n in range(H.PAGES + 1)], folder)
    open(os.path.join(folder, f"page-{H.PAGES + 1:09d}-9-200.json.part"), "w").close()
    pages = H.read_harvest(spark, folder)
    assert pages.rdd.getNumPartitions() == 2 and pages.count() == H.PAGES + 1
