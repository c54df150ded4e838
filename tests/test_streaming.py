"""Streaming: exports arriving in a folder go through the same cleaning."""

from __future__ import annotations

from conftest import raw_row
from churnscope.sources import io
from churnscope.streaming import exports


def test_exports_folder_appends_cleaned_rows(spark, make_raw, tmp_path):
    inbox = tmp_path / "inbox"
    io.write_raw_csv(make_raw([raw_row(cid="A1", total=" "), raw_row(cid="A2", churn="Yes")]), str(inbox / "day1"))
    out = str(tmp_path / "clean")
    stream = exports.clean_stream(exports.stream_raw_exports(spark, str(inbox / "*")))
    q = exports.append_to_parquet(stream, out, str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = {r.customer_id: (r.total_charges, r.churn_flag) for r in spark.read.parquet(out).collect()}
    assert got == {"A1": (50.0, 0), "A2": (500.0, 1)}

    # A second export arrives; the restarted query picks up only the new file.
    io.write_raw_csv(make_raw([raw_row(cid="A3", contract=" Two year ")]), str(inbox / "day2"))
    q = exports.append_to_parquet(stream, out, str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 3


def test_segment_counts_stream(spark, make_raw, tmp_path):
    inbox = tmp_path / "inbox2"
    rows = [raw_row(cid="A1", churn="Yes"), raw_row(cid="A2"), raw_row(cid="A3", contract="One year")]
    io.write_raw_csv(make_raw(rows), str(inbox / "day1"))
    typed = exports.typed_stream(exports.stream_raw_exports(spark, str(inbox / "*")))
    counts = exports.segment_counts_stream(typed, ["contract"])
    q = (
        counts.writeStream.format("memory").queryName("seg_counts").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "ckpt2")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    got = {r.contract: (r.total_customers, r.churned) for r in spark.table("seg_counts").collect()}
    assert got == {"Month-to-month": (2, 1), "One year": (1, 0)}
