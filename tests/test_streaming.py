import datetime as dt
import os
import tempfile

from sitewise.streaming import read_observation_stream, start_clean_ingest, stream_daily_counts


def test_incremental_ingest_and_daily_counts(spark):
    src = tempfile.mkdtemp(prefix="sitewise-stream-src-")
    out = tempfile.mkdtemp(prefix="sitewise-stream-out-")
    with open(os.path.join(src, "round1.csv"), "w") as f:
        f.write("SITECODE,LCODE,SDATE,FIELDNAME,VALUE\nT01,1,05-Jan-93,A1,3\nT01,1,05-Jan-93,Q1,2\n"
                "T01,1,06-Jan-93,A1,4\n")
    q = start_clean_ingest(spark, src, out, name="test_ingest_" + os.path.basename(out))
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 2 and {r.SITECODE for r in got.collect()} == {"T01"}

    mem = "daily_" + os.path.basename(out).replace("-", "_")
    daily = stream_daily_counts(read_observation_stream(spark, src), lateness="0 days")
    q2 = (daily.writeStream.format("memory").queryName(mem).outputMode("append")
          .option("checkpointLocation", os.path.join(out, "_ck2")).trigger(availableNow=True).start())
    q2.awaitTermination(120)
    rows = {r.DATE: r["count"] for r in spark.table(mem).collect()}
    # the watermark closes 5 January once 6 January is seen; 6 January stays open
    assert rows.get(dt.date(1993, 1, 5)) == 3.0
