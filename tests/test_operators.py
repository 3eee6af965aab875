import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import names
from gridloom.operators import arrays, coding, intervals, metrics, statistics
from gridloom.plans import experiment
from gridloom.sources import arrayfile, logs

CLUSTERS = {"raster": {4: 169}, "morton": {1: 16, 2: 12, 3: 8, 4: 37, 6: 18, 7: 16, 8: 26, 10: 36}, "gray": {1: 16, 2: 20, 4: 37, 6: 34, 8: 26, 10: 36}, "hilbert": {1: 20, 2: 20, 3: 42, 4: 30, 5: 20, 6: 37}}
#: ratio keys, sum of ratio, exact keys, sum of exact, (area, gap) pairs, sum of areas, sum of edges, corrected
PAIRS = {
    "raster": (332, 352204721, 287, 332692021, 480, 3289600, 10048, 7395),
    "morton": (1276, 354833729, 2462, 336226814, 1540, 4678400, 25908, 7605),
    "gray": (1967, 381829410, 4497, 359859308, 417, 4870800, 36406, 10716),
    "hilbert": (1631, 363577974, 3683, 343842526, 1388, 3792970, 63410, 9140),
}


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_metrics(spark, name):
    assert {r.key: r.regions for r in metrics.clusters(spark, name, 4).collect()} == CLUSTERS[name]
    want = PAIRS[name]
    for exact, at in ((False, 0), (True, 2)):
        rows = metrics.ratio(spark, name, 4, exact=exact).collect()
        assert (len(rows), sum(r.key * r.regions for r in rows)) == want[at : at + 2]
        assert sum(r.regions for r in rows) == 32640
    rows = metrics.bounding_boxes(spark, name, 4).collect()
    assert (len(rows), sum(r.area * r.regions for r in rows)) == want[4:6]
    for corrected, at in ((False, 6), (True, 7)):
        rows = metrics.grid_edges(spark, name, 4, corrected=corrected).collect()
        assert (sum(r.regions for r in rows), sum(r.key * r.regions for r in rows)) == (870, want[at])


def test_metric_errors(spark):
    with pytest.raises(ValueError):
        metrics.clusters(spark, "morton", 3, side=0)
    with pytest.raises(ValueError):
        metrics.metric(spark, "none", "morton", 3)


def test_intervals(spark):
    rows = lambda df: sorted((r.lo, r.hi) for r in df.collect())
    merged = intervals.merge_intervals(spark.createDataFrame([(1, 4), (7, 9), (15, 10), (20, 23)], "a long, b long"), "a", "b")
    assert rows(merged) == [(1, 4), (7, 15), (20, 23)]
    held = spark.createDataFrame([(0, 0), (7, 8), (19, 25), (50, 55)], "lo long, hi long")
    assert rows(intervals.insert_values(held, spark.createDataFrame([(9,), (6,), (67,)], "v long"), "v")) == [(0, 0), (6, 9), (19, 25), (50, 55), (67, 67)]
    assert rows(intervals.islands(spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 5, 6, 8, 9, 10, 0)], "v long"), "v")) == [(0, 3), (5, 6), (8, 10)]
    assert rows(intervals.islands(spark.createDataFrame([], "v long"), "v")) == []


def test_geometry(spark):
    df = spark.createDataFrame([(1, 1, 1, 7, 7, 7, 7, 7, 1, 1)], ", ".join(f"{c} long" for c in ("a0", "a1", "a2", "a3", "a4", "b0", "b1", "b2", "b3", "b4")))
    low, high = G.box([F.col(f"a{i}") for i in range(5)], [F.col(f"b{i}") for i in range(5)])
    row = df.select(G.box_area(low, high).alias("area"), G.box_contains(low, high, [F.lit(v) for v in (2, 3, 4, 5, 6)]).alias("yes"), G.box_contains(low, high, [F.lit(v) for v in (0, 3, 4, 8, 6)]).alias("no")).first()
    assert (row.area, row.yes, row.no) == (16807, True, False)
    p, q = [F.lit(0), F.lit(0)], [F.lit(3), F.lit(-5)]
    row = spark.range(1).select(G.distance(p, q, "l1").alias("a"), F.round(G.distance(p, q, "l2"), 4).alias("b"), G.distance(p, q, "l2", whole=True).alias("c"), G.distance(p, q, "linf").alias("d")).first()
    assert tuple(row) == (8, 5.831, 5, 5)
    with pytest.raises(ValueError):
        G.distance(p, q, "l3")
    with pytest.raises(Exception, match="power of two"):
        spark.range(3, 4).select(G.ilog2(F.col("id"))).collect()


def test_statistics(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([5, 5, 5, 7, 7, 5])], "g string, i long, v long")
    assert sorted((r.start, r.v, r.n) for r in statistics.runs(df, "v", "i", ["g"]).collect()) == [(0, 5, 3), (3, 7, 2), (5, 5, 1)]
    assert sorted((r.start, r.piece, r.n) for r in statistics.capped_runs(df, "v", "i", ["g"], cap=2).collect()) == [(0, 0, 2), (0, 1, 1), (3, 0, 2), (5, 0, 1)]
    flat = spark.range(256).select((F.col("id") % 256).alias("v"))
    assert statistics.entropy(flat, "v").first().entropy == pytest.approx(1.0)
    assert [r["diff"] for r in statistics.differences(df, "v", "i", ["g"]).orderBy("i").collect()] == [0, 0, 2, 0, -2]
    with pytest.raises(Exception, match="more symbols"):
        statistics.entropy(spark.range(300), "id").collect()


def test_bit_planes(spark):
    df = spark.range(20).select("id", (F.col("id") % 16).alias("v"))
    planes = arrays.bit_planes(df, "v", "id", 16)
    assert [r.word for r in planes.where("block = 0").orderBy("plane").collect()][:5] == [0xAAAA, 0xCCCC, 0xF0F0, 0xFF00, 0]
    assert sorted((r.pos, r.value) for r in arrays.unplane(planes, 16).collect()) == [(i, i) for i in range(16)]
    assert arrays.plane_tail(df, "id", 16, 20).count() == 4
    words = np.arange(16, dtype="<u2").tobytes()
    coded = arrays.planes_payload(words, 2)
    assert np.frombuffer(coded, "<u2").tolist() == [0xAAAA, 0xCCCC, 0xF0F0, 0xFF00] + [0] * 12
    for width in (1, 2, 4, 8):
        for size in (0, 3, 8 * width * width, 8 * width * width * 3 + 5):
            data = np.random.default_rng(size).bytes(size)
            assert arrays.planes_payload(arrays.planes_payload(data, width), width, inverse=True) == data


@pytest.mark.parametrize("n", [2, 3])
def test_reorder_payload(n):
    k = 3
    data = np.arange(1 << (n * k), dtype="<u4").tobytes()
    for a in ("raster", "morton", "gray", "hilbert"):
        for b in ("raster", "morton", "gray", "hilbert"):
            moved = arrays.reorder_payload(data, 4, k, n, a, b)
            assert arrays.reorder_payload(moved, 4, k, n, b, a) == data
    for bad in ((3, n), (4, 4)):
        with pytest.raises(ValueError):
            arrays.reorder_payload(data, bad[0], k, bad[1], "raster", "morton")


def _arrays(spark, n=3):
    rng = np.random.default_rng(1)
    rows = [(f"dir/t{i}.sfcc", 2, 4, 2, 0, False, 0, None, bytearray((np.cumsum(rng.integers(-3, 4, 256)) & 0xFFFF).astype("<u2").tobytes())) for i in range(n)]
    return spark.createDataFrame(rows, arrayfile._SCHEMA)


@pytest.mark.parametrize("codec", ["none", "rle", "huffman", "lz77", "lzw", "bzip_lz77", "bzip_lzw", "bwt"])
def test_array_files(spark, tmp_path, codec):
    plain = _arrays(spark)
    coded = arrayfile.compress(plain, "gray_code", codec, transposed=codec != "rle")
    arrayfile.write_arrays(coded, f"file://{tmp_path}")
    read = arrayfile.read_arrays(spark, f"file://{tmp_path}")
    assert {r.compression for r in arrayfile.header_info(read).collect()} == {codec.upper()}
    back = {r.path.rsplit("/", 1)[-1]: bytes(r.payload) for r in arrayfile.decompress(read).collect()}
    assert back == {r.path.rsplit("/", 1)[-1]: bytes(r.payload) for r in plain.collect()}
    with pytest.raises(Exception, match="already"):
        arrayfile.compress(read.where("compression <> 0 or sfctype <> 0"), "morton", "none").collect()


def test_array_headers(spark, tmp_path):
    assert arrayfile.pack_header(2, 7, 4, 3, True, 2, 5).hex() == "53464343" + "020704" + "83" + "02" + "05"
    info = arrayfile.header_info(_arrays(spark, 1)).first()
    assert (info.sfc, info.compression, info.consistent, info.payload_bytes, len(info["sample"])) == ("ROW_MAJOR", "NONE", True, 512, 32)
    (tmp_path / "bad.sfcc").write_bytes(b"NOPE12345")
    with pytest.raises(Exception, match="no array file"):
        arrayfile.read_arrays(spark, str(tmp_path)).collect()
    assert arrayfile.tile_list(spark).count() == 868
    assert arrayfile.plain_name(arrayfile.coded_name("a.sfcc", "hilbert", True, "lzw")) == "a.sfcc"


def test_block_pipeline(spark):
    data = bytes(range(256)) * 40
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b""))], "k long, p binary")
    from gridloom.functions.codecs import bzip_decode

    got = {r.k: bytes(r.encoded) for r in coding.encode_blocks(df, "k", "p", "lz77", 1000).collect()}
    assert bzip_decode(got[1], "lz77") == data and got[2] == b""


def test_names(spark):
    files = ["x/s26.tif.sfcc.mrtn.btr.bzip_lzw", "t.1.sfcc", "a.sfcc.gry.lz4", "b.sfcc.gry.hbrt"]
    rows = spark.createDataFrame([(f,) for f in files], "p string").select(names.parse_filename(F.col("p")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in rows] == [("s26", "morton", "lzw", True, True), ("t.1", "raster", "none", False, False), ("a", "gray", "lz4", False, False), ("b", "hilbert", "none", False, False)]
    with pytest.raises(Exception, match="unknown token"):
        spark.createDataFrame([("a.sfcc.what",)], "p string").select(names.parse_filename(F.col("p"), strict=True)).collect()
    row = spark.range(1).select(names.parse_command(F.lit("tool compress -s GRAY_CODE -b -c LZW dir/a.sfcc")).alias("c")).select("c.*").first()
    assert tuple(row) == ("a", "gray", "lzw", False, True)
    row = spark.range(1).select(names.expected_filename(F.lit("a"), F.lit("morton"), F.lit("lz77"), F.lit(True), F.lit(True)).alias("e"), names.curve_label(F.lit(3)).alias("c"), names.compression_label(F.lit(77)).alias("u"), names.sfc(F.lit("ZORDER")).alias("z")).first()
    assert tuple(row) == ("a.sfcc.mrtn.btr.bwt.lz77", "GRAY_CODE", "NULL", "morton")


def test_experiment(spark, tmp_path):
    assert experiment.valid_configs(spark).count() == 104
    (tmp_path / "sizes.tsv").write_text("100\td/a.sfcc\n80\td/a.sfcc.mrtn\n50\td/a.sfcc.mrtn.gz\n40\td/z.sfcc\n")
    head = "Seq\tHost\tStarttime\tJobRuntime\tSend\tReceive\tExitval\tSignal\tCommand\n"
    line = "{}\t:\t0\t{}\t0\t0\t{}\t0\t{}\n".format
    (tmp_path / "c.log").write_text(head + line(1, 1.5, 0, "cp d/a.sfcc") + line(2, 0.25, 0, "run d/a.sfcc.mrtn") + line(3, 0.5, 0, "gzip d/a.sfcc.mrtn.gz") + line(4, 9, 1, "run d/a.sfcc.hbrt"))
    sizes = experiment.sizes(logs.read_sizes(spark, str(tmp_path / "sizes.tsv")))
    runs = experiment.runtimes(logs.read_joblog(spark, str(tmp_path / "c.log")), "runtime_compress")
    assert experiment.without_size(sizes, runs).count() == 0 and experiment.repeated(runs).count() == 0
    both = experiment.join_results(sizes, runs, runs.withColumnRenamed("runtime_compress", "runtime_decompress"))
    kept = experiment.ignore(both, spark.createDataFrame([("z",)], "filename string"))
    out = {(r.sfc, r.compression): (r.runtime_compress, r.relative_compress) for r in experiment.add_relative(experiment.add_external_base(kept)).collect()}
    assert out == {("raster", "none"): (1500, 0), ("morton", "none"): (250, -1250), ("morton", "gzip"): (750, 500)}
    assert experiment.incomplete(both).count() == 1
    logs.write_results(experiment.add_relative(experiment.add_external_base(kept)), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out" / "data_srtm"), header=True).count() == 3
    assert experiment.anomalies(both, 1).count() == 1


def test_metric_file(spark, tmp_path):
    to = logs.write_metric(metrics.clusters(spark, "hilbert", 3), str(tmp_path), "clusters", "hilbert", 8)
    assert [int(r.Clusters) for r in spark.read.csv(to, sep="\t", header=True).collect()] == [1, 2, 3, 4, 5, 6]


def test_streams(spark, tmp_path):
    from gridloom.functions.codecs import lz77_encode
    from gridloom.streaming.decoder import decode_stream
    from gridloom.streaming.windows import cell_counts

    message = b"stream stream stream stream"
    coded = lz77_encode(message)
    pieces = [(7, i, bytearray(coded[i : i + 3])) for i in range(0, len(coded), 3)]
    spark.createDataFrame(pieces, "stream_id long, seq long, piece binary").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id long, seq long, piece binary").parquet(str(tmp_path / "in"))
    query = decode_stream(stream).writeStream.format("memory").queryName("decoded").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [bytes(r.message) for r in spark.table("decoded").collect()] == [message]
    events = spark.createDataFrame([("2024-01-01 00:10:00", 1, 2), ("2024-01-01 00:20:00", 1, 2), ("2024-01-01 02:00:00", 3, 3)], "ts string, x long, y long").select(F.col("ts").cast("timestamp"), "x", "y")
    assert sorted((r.cell, r.n) for r in cell_counts(events, "ts", ["x", "y"], 4, 0).collect()) == [(9, 2), (15, 1)]
