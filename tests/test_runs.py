"""Saved runs, configurations, streams, and the whole path from a capture."""

import json

import pytest
from pyspark.sql import functions as F

from flowscape import config, pipeline
from flowscape.sources import capture, runs
from flowscape.streaming import packets as stream


def _frames():
    out = []
    for k in range(40):
        src, dst = f"10.0.0.{1 + k % 5}", f"192.0.2.{k % 7}"
        out.append((100.0 + k, capture.frame_of(src, 40000 + k, dst, 80, 6, 2, 54)))
        if k % 3 == 0:
            out.append((100.25 + k, capture.frame_of(dst, 80, src, 40000 + k, 6, 4, 54)))
    out += [(150.0 + k, capture.frame_of("10.9.9.9", 5000 + k, "192.0.2.9", 53, 17, None, 54)) for k in range(5)]
    return [(ts, f, len(f)) for ts, f in out]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    (folder / "in").mkdir()
    (folder / "in" / "a.pcap").write_bytes(capture.write_pcap(iter(_frames())))
    return pipeline.run(spark, str(folder / "in"), str(folder / "one"), config.parse({"scan": {"min_syn_to_rst": 1, "min_targets": 1}, "prefix": {"percent": 10}})), folder


def test_a_run_is_published_and_checked(spark, made):
    run, folder = made
    rows = runs.inspect(run, run.manifest["config_hash"])
    assert rows["flows"] == rows["labels"] == 45
    assert run.table("labels").where("strict_removed").count() == 14
    assert run.table("heavy").agg(F.sum("residual")).first()[0] == 59 * 54
    with pytest.raises(runs.RunError, match="exists"):
        runs.publish(spark, str(folder / "one"), {}, {})
    with pytest.raises(runs.RunError):
        runs.inspect(run, "other")
    (folder / "bad").mkdir()
    (folder / "bad" / runs.MANIFEST).write_text(json.dumps({"status": "failed"}))
    with pytest.raises(runs.RunError, match="failed"):
        runs.load_run(spark, str(folder / "bad"))


def test_contexts_and_comparison(spark, made):
    run, folder = made
    packets = capture.packets_of(capture.read_captures(spark, str(folder / "in")))
    tuples, sources = pipeline.one_packet_contexts(run, packets)
    single = run.table("flows").join(run.table("labels"), "flow_id").where("packet_count = 1 and not broad_removed").count()
    assert tuples.count() == sources.count() == single == 5
    with pytest.raises(Exception, match="ambiguous target match"):
        pipeline.one_packet_contexts(run, packets.unionByName(packets))[0].collect()
    with pytest.raises(Exception, match="missing target match"):
        pipeline.one_packet_contexts(run, packets.where("protocol = 6"))[0].collect()
    same = pipeline.compare_runs(run, run)
    assert same["prefixes"].first().jaccard == 1.0 and same["frequencies"].first().missing == 0


def test_batches(spark, made):
    run, folder = made
    done = pipeline.run_batch(spark, ["202401010000", "202401010015"], lambda i: str(folder / ("in" if i.endswith("00") and not i.endswith("15") else "nowhere")), str(folder / "batch"))
    assert isinstance(done["202401010000"], runs.Run) and isinstance(done["202401010015"], Exception)
    loaded = runs.load_batch(spark, str(folder / "batch"), list(done))
    assert runs.together(loaded, "flows").select("dataset").distinct().count() == 1
    assert runs.dataset_ids("# days\n202401010000\n202401010015 # second\n") == list(done)
    with pytest.raises(runs.RunError):
        runs.dataset_ids("202401010000\n202401010000")


def test_strict_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,TRUE\n2,0\n")
    df = runs.read_csv(spark, str(tmp_path / "t.csv"), ["a", "b"], 2)
    assert [tuple(r) for r in df.select(runs.integer(F.col("a"), 1, 5), runs.boolean(F.col("b"))).collect()] == [(1, True), (2, False)]
    for columns, rows in ((["a"], None), (["a", "b"], 3)):
        with pytest.raises(runs.RunError):
            runs.read_csv(spark, str(tmp_path / "t.csv"), columns, rows)
    (tmp_path / "ragged.csv").write_text("a,b\n1\n")
    with pytest.raises(Exception):
        runs.read_csv(spark, str(tmp_path / "ragged.csv"), ["a", "b"]).collect()
    for bad in ("x", "-1", "9" * 19, None):
        with pytest.raises(Exception, match="not an integer"):
            spark.createDataFrame([(bad,)], "a string").select(runs.integer(F.col("a"))).collect()
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("yes",)], "a string").select(runs.boolean(F.col("a"))).collect()
    counts = spark.createDataFrame([("b", 2, 1), ("a", 9, 1), ("b", 1, 3)], "distribution string, packet_count long, frequency long")
    runs.write_frequencies(counts, str(tmp_path / "f"))
    assert [r.packet_count for r in spark.read.csv(str(tmp_path / "f"), header=True).collect()] == ["9", "1", "2"]
    calls = []
    build = lambda: calls.append(1) or counts
    for _ in range(2):
        assert runs.cached(spark, str(tmp_path / "cache"), {"x": 1}, build).count() == 3
    assert len(calls) == 1


def test_chunks(spark, tmp_path):
    urls = runs.chunk_urls("20240101", "https://host.example/{chunk}.pcap.gz")
    assert len(urls) == 96 and urls[-1] == ("202401012345", "https://host.example/202401012345.pcap.gz")
    seen = spark.createDataFrame([(1.5, "a", 1, "b", 2)], "ts double, src_ip string, src_port int, dst_ip string, dst_port int")
    for _ in range(2):
        runs.write_chunk(seen, str(tmp_path / "c"), "202401010000")
    assert runs.read_chunks(spark, str(tmp_path / "c"), ["202401010000"]).count() == 1
    with pytest.raises(runs.RunError, match="missing"):
        runs.read_chunks(spark, str(tmp_path / "c"), ["202401010015"])
    assert runs.load_notes('{"dataset": "x"}') == {"dataset": "x"}
    with pytest.raises(runs.RunError):
        runs.load_notes('{"other": 1}')


def test_configurations():
    assert config.load('{"flow": {"protocols": ["tcp"]}}').flow.protocols == ("tcp",)
    for bad in ({"x": {}}, {"flow": {"y": 1}}, {"flow": {"protocols": []}}, {"scan": {"step_seconds": 90}}, {"scan": {"strict": False}}, {"prefix": {"percent": 0}}, {"prefix": {"min_length": 20}}):
        with pytest.raises(config.ConfigError):
            config.parse(bad)


def test_streams(spark, made, tmp_path):
    _, folder = made
    names = [c.split(" ")[0] for c in stream.PACKETS.split(", ")]
    packets = capture.packets_of(capture.read_captures(spark, str(folder / "in"))).select(*names)
    packets.write.parquet(str(tmp_path / "p"))

    def drained(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    live = lambda: stream.read_packets(spark, str(tmp_path / "p"))
    assert drained(stream.slots(live()), "slots").agg(F.sum("packets")).first()[0] == 59
    assert drained(stream.session_flows(live(), "60 seconds"), "sessions").count() == 45
    windows = drained(stream.syn_windows(live(), "60 seconds", "10 seconds"), "syns")
    assert windows.agg(F.max("syns")).first()[0] == 8
    stream.ingest(live(), str(tmp_path / "chunks"), str(tmp_path / "ck")).awaitTermination()
    stream.ingest(live(), str(tmp_path / "chunks"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "chunks" / "batch=0")).count() == 59
    with pytest.raises(runs.RunError):
        stream.retire(spark, str(tmp_path / "chunks"), [], {0: 1})
    assert stream.retire(spark, str(tmp_path / "chunks"), [str(tmp_path / "p")], {0: 59}) and not (tmp_path / "p").exists()
