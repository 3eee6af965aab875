"""Queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import curves, geometry, names
from gridloom.operators import arrays, coding, intervals, metrics, statistics
from gridloom.plans import experiment, surface
from gridloom.sources import arrayfile, logs
from gridloom.streaming.windows import cell_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
K2, K3 = 8, 6


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _grid2(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "lineitem").select((F.col("l_partkey") % 256).alias("x"), (F.col("l_suppkey") % 256).alias("y"))


def _grid3(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "lineitem").select((F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y"), (F.col("l_quantity").cast("long") % 64).alias("z"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select("event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("v"))


@_query
def morton_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: quantities by blocks of 256 Morton cells."""
    lines = _table(spark, sf, "lineitem").select((F.col("l_partkey") % 256).alias("x"), (F.col("l_suppkey") % 256).alias("y"), F.col("l_quantity").cast("long").alias("q"))
    d = curves.morton_forward([F.col("x"), F.col("y")], K2)
    return lines.groupBy(F.shiftrightunsigned(d, 8).alias("cell")).agg(F.count("*").alias("n"), F.sum("q").alias("quantity"))


def _forward(name: str, n: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df, axes, k = (_grid2(spark, sf), ["x", "y"], K2) if n == 2 else (_grid3(spark, sf), ["x", "y", "z"], K3)
        return arrays.with_distance(df.select(*axes), name, axes, k)

    return run


def _inverse(name: str, n: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = (F.col("l_orderkey") * 31 + F.col("l_partkey")) % (1 << (16 if n == 2 else 18))
        ids = _table(spark, sf, "lineitem").select(d.alias("d"))
        return arrays.with_coords(ids, name, "d", ["x", "y", "z"][:n], K2 if n == 2 else K3)

    return run


for _name in ("raster", "morton", "gray", "hilbert"):
    for _n in (2, 3):
        QUERIES[f"{_name}{_n}_fwd"] = _forward(_name, _n)
        QUERIES[f"{_name}{_n}_inv"] = _inverse(_name, _n)
QUERIES["gray2_canonical"] = _forward("gray_canonical", 2)
QUERIES["gray2_canonical_inv"] = _inverse("gray_canonical", 2)


@_query
def curve_walk(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name in ("raster", "morton", "gray", "hilbert"):
        part = curves.walk(spark, name, 6).select(F.lit(name).alias("curve"), "d", "x", "y")
        out = part if out is None else out.unionByName(part)
    return out


@_query
def bounds_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = _table(spark, sf, "lineitem").select((F.col("l_partkey") % 300).alias("x"), (F.col("l_suppkey") % 300).alias("y"))
    return df.select("x", "y", curves.to_distance("morton", [F.col("x"), F.col("y")], K2).alias("d"))


def _norm(norm: str, whole: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        df = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 256).alias("x"), (F.col("l_suppkey") % 256).alias("y"))
        pair = df.select("l_orderkey", "l_linenumber", "x", "y", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py")).where("px is not null")
        dist = geometry.distance([F.col("x"), F.col("y")], [F.col("px"), F.col("py")], norm, whole)
        return pair.select("l_orderkey", "l_linenumber", (F.round(dist, 6) if norm == "l2" and not whole else dist).alias("dist"))

    return run


for _q, _norm_name, _whole in (("dist_l1", "l1", False), ("dist_l2", "l2", False), ("dist_linf", "linf", False), ("dist_l2_trunc", "l2", True)):
    QUERIES[_q] = _norm(_norm_name, _whole)


@_query
def box_contains(spark: SparkSession, sf: str) -> DataFrame:
    low, high = geometry.box([F.lit(200), F.lit(20)], [F.lit(40), F.lit(90)])
    return _grid2(spark, sf).where(geometry.box_contains(low, high, [F.col("x"), F.col("y")]))


@_query
def box_bounds_area(spark: SparkSession, sf: str) -> DataFrame:
    df = _table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 256).alias("x"), (F.col("l_suppkey") % 256).alias("y"))
    boxes = df.groupBy("l_orderkey").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return boxes.select("*", geometry.box_area([F.col("x0"), F.col("y0")], [F.col("x1"), F.col("y1")]).alias("area"))


@_query
def cmp_all_components(spark: SparkSession, sf: str) -> DataFrame:
    a, b = [F.col("x"), F.col("y")], [F.lit(128), F.lit(64)]
    moved = geometry.subtract(geometry.add(a, geometry.unit(0, 2)), geometry.unit(1, 2))
    return _grid2(spark, sf).select("x", "y", *(geometry.compare_all(a, b, op).alias(n) for op, n in (("<", "lt"), ("<=", "le"), (">", "gt"), (">=", "ge"))), moved[0].alias("mx"), moved[1].alias("my"))


@_query
def pow2_checks(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("p_size").cast("long")
    return _table(spark, sf, "part").select("p_partkey", geometry.is_power_of_two(v).alias("is_pow2"), geometry.ilog2(v, strict=False).cast("long").alias("log2"), geometry.bit_length(v).cast("long").alias("bits"), geometry.next_power_of_two(v).alias("next_pow2"), geometry.int_power(v, 3).alias("cube"), geometry.is_multiple_of(v, 4).alias("by_four"))


@_query
def islands_from_values(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.islands(_table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 512).alias("v")), "v", ["l_suppkey"])


@_query
def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    spans = _table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 4096).alias("a"), (F.col("l_partkey") % 4096 + F.rint("l_quantity").cast("long")).alias("b"))
    return intervals.merge_intervals(spans, "a", "b", ["l_suppkey"], as_given=True)


@_query
def box_to_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.box_ranges(spark, "hilbert", 5, [3, 5], [17, 11])


def _metric(name: str, curve: str, **options) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = metrics.metric(spark, name, curve, 4, **options)
        out = out.drop("key") if name == "bbox" else out
        return out.withColumn("normalised", F.round("normalised", 9))

    return run


for _curve in ("raster", "morton", "gray", "hilbert"):
    for _q, _m, _o in (("clusters", "clusters", {}), ("ratio", "ratio", {}), ("ratio_exact", "ratio", {"exact": True}), ("bbox", "bbox", {}), ("gridedges", "gridedges", {}), ("gridedges_corrected", "gridedges", {"corrected": True})):
        QUERIES[f"metric_{_q}_{_curve}"] = _metric(_m, _curve, **_o)


@_query
def value_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.histogram(_events(spark, sf), "v")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("mean", "std", "p25", "p50", "p75")})


@_query
def describe_values(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(statistics.describe(_events(spark, sf), "v", ["event_type"]))


@_query
def describe_diffs(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(statistics.describe(statistics.differences(_events(spark, sf), "v", "event_id", ["event_type"]), "diff", ["event_type"]))


@_query
def entropy_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.entropy(_events(spark, sf), "v", ["event_type"], 2).withColumn("entropy", F.round("entropy", 6))


@_query
def block_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.block_entropy(_events(spark, sf), "v", "event_id", 1000, item_bytes=2).withColumn("entropy", F.round("entropy", 6))


@_query
def rle_runs(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.runs(_table(spark, sf, "events").select("user_id", "event_id", "event_type"), "event_type", "event_id", ["user_id"])


@_query
def rle_runs_capped(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.capped_runs(_table(spark, sf, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("at"), F.lit(1).alias("one")), "one", "at", ["l_suppkey"], 40).groupBy("l_suppkey", "piece").agg(F.sum("n").alias("n"))


@_query
def bitplane_events(spark: SparkSession, sf: str) -> DataFrame:
    """Planes of full blocks; the tail's values pass through as plane -1."""
    events = _events(spark, sf)
    tail = arrays.plane_tail(events, "event_id", 16, events.count())
    return arrays.bit_planes(events, "v", "event_id", 16).unionByName(tail.select(F.lit(-1).alias("plane"), F.col("event_id").alias("block"), F.col("v").alias("word")))


@_query
def bitplane_inverse(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    tail = arrays.plane_tail(events, "event_id", 16, events.count())
    return arrays.unplane(arrays.bit_planes(events, "v", "event_id", 16), 16).unionByName(tail.select(F.col("event_id").alias("pos"), F.col("v").alias("value")))


@_query
def reorder_morton_to_hilbert(spark: SparkSession, sf: str) -> DataFrame:
    """Every 4,096 events are an array; cells of the last, short one move like the others."""
    cells = _events(spark, sf).select(F.expr("event_id div 4096").alias("a"), (F.col("event_id") % 4096).alias("pos"), "v")
    return arrays.reorder_cells(cells, "pos", "morton", "hilbert", 6)


@_query
def reorder_layout_checksum(spark: SparkSession, sf: str) -> DataFrame:
    laid = arrays.curve_layout(_grid2(spark, sf), "morton", ["x", "y"], K2)
    return laid.agg(F.count("*").alias("n"), F.sum("d").alias("sum_d"), F.max("d").alias("max_d"), F.sum(F.col("d") * F.col("x")).alias("sum_dx"))


def _bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as bytes, an even number of them so that two-byte words fit."""
    text = F.when(F.octet_length("text") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" ")))
    return _table(spark, sf, "documents").select("doc_id", F.encode(text, "UTF-8").alias("payload"))


def _round_trip(codec: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return coding.round_trip(_bytes(spark, sf), "payload", codec).select("doc_id", "n_bytes", "ok")

    return run


for _codec in ("rle", "huffman", "lz77", "lzw", "bwt", "bzip_lz77", "bzip_lzw", "gzip", "bzip2"):
    QUERIES[f"roundtrip_{_codec}"] = _round_trip(_codec)


@_query
def codec_sizes(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for codec in ("none", "rle", "huffman", "lz77", "lzw", "bwt", "gzip", "bzip2"):
        part = coding.encode_column(_bytes(spark, sf), "payload", codec).agg(F.lit(codec).alias("codec"), F.sum(F.length("payload")).alias("n_bytes"), F.sum(F.length("encoded")).alias("n_encoded"))
        out = part if out is None else out.unionByName(part)
    return out


@_query
def huffman_freq(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.byte_histogram(_table(spark, sf, "documents"), "text", ["doc_id"])


@_query
def block_pipeline_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Block-parallel Burrows-Wheeler pipeline over the whole payloads."""
    return coding.encode_blocks(_bytes(spark, sf), "doc_id", "payload", "lz77", 1 << 16).select("doc_id", F.length("encoded").cast("long").alias("n_encoded"))


def _array_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays of 32 by 32 two-byte words from all events, 1,024 in each."""
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "v")))
    pair = lambda r: F.concat(F.lpad(F.hex(r["v"].bitwiseAND(F.lit(255).cast("long"))), 2, "0"), F.lpad(F.hex(F.shiftright(r["v"], 8).bitwiseAND(F.lit(255).cast("long"))), 2, "0"))
    grouped = _events(spark, sf).groupBy(F.expr("event_id div 1024").alias("a")).agg(ordered.alias("r"))
    # the last array is filled up with zeros
    grouped = grouped.withColumn("r", F.expr("concat(r, array_repeat(named_struct('event_id', -1L, 'v', 0L), 1024 - size(r)))"))
    return grouped.select(F.concat(F.lit("array-"), F.col("a")).alias("path"), *(F.lit(v).alias(c) for c, v in (("ndims", 2), ("k", 5), ("dtype_nbytes", 2), ("sfctype", 0), ("bittransposed", False), ("compression", 0))), F.lit(None).cast("int").alias("npaddingbits"), F.unhex(F.array_join(F.transform("r", pair), "")).alias("payload"))


@_query
def array_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    plain = _array_payloads(spark, sf)
    back = arrayfile.decompress(arrayfile.compress(plain, "hilbert", "huffman", transposed=True))
    return plain.join(back.select("path", F.col("payload").alias("b")), "path").select("path", F.length("payload").cast("long").alias("n_bytes"), (F.col("payload") == F.col("b")).alias("ok"))


@_query
def array_headers(spark: SparkSession, sf: str) -> DataFrame:
    return arrayfile.header_info(_array_payloads(spark, sf)).select("path", "ndims", "k", "dtype_nbytes", "sfc", "bittransposed", "compression", "payload_bytes", "consistent")


@_query
def array_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return arrayfile.tile_list(spark).agg(F.count("*").alias("tiles"), F.sum("c0").alias("s0"), F.sum("c1").alias("s1"), F.sum("c2").alias("s2"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "nation").select(F.concat(F.lit("tile"), "n_nationkey").alias("filename"), F.col("n_nationkey").cast("long").alias("key"))


@_query
def config_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return experiment.config_matrix(spark, _files(spark, sf))


@_query
def valid_configs(spark: SparkSession, sf: str) -> DataFrame:
    return experiment.valid_configs(spark)


@_query
def parse_filename(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    path = F.concat(F.lit("dir/tile"), key, F.lit(".tif.sfcc"), F.get(F.array(*map(F.lit, ["", ".mrtn", ".gry", ".hbrt"])), (key % 4).cast("int")), F.when(key % 3 == 1, ".btr").otherwise(""), F.get(F.array(*map(F.lit, ["", ".rle", ".hff", ".bzip_lzw", ".gz"])), (key % 5).cast("int")))
    return _table(spark, sf, "part").select("p_partkey", names.parse_filename(path).alias("c")).select("p_partkey", "c.*")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """A full experiment over the nations; every seventh file lacks decompression times."""
    configs = experiment.valid_configs(spark)
    every = _files(spark, sf).crossJoin(F.broadcast(configs))
    return every.select("filename", "sfc", "compression", "bwt", "bitshuffle", (F.col("key") * 1000 + F.length("name") * 7).cast("long").alias("size"), (F.col("key") * 7 + F.length("name") * 13).cast("long").alias("runtime_compress"), F.when(F.col("key") % 7 != 3, F.col("key") * 5 + F.length("name") * 11).cast("long").alias("runtime_decompress"))


@_query
def runs_joined(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf)
    key = experiment.KEY
    return experiment.join_results(runs.select(*key, "size"), runs.select(*key, "runtime_compress"), runs.where("runtime_decompress is not null").select(*key, "runtime_decompress"))


@_query
def runs_external_sum(spark: SparkSession, sf: str) -> DataFrame:
    return experiment.add_external_base(_runs(spark, sf))


@_query
def runs_relative(spark: SparkSession, sf: str) -> DataFrame:
    return experiment.add_relative(experiment.add_external_base(_runs(spark, sf)))


@_query
def runs_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    return experiment.incomplete(_runs(spark, sf)).groupBy("filename").agg(F.count("*").alias("n"))


@_query
def stats_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = _table(spark, sf, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("value"))
    new = _table(spark, sf, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_nationkey", (F.col("c_acctbal") + 1).alias("value"))
    return experiment.upsert(old, new, ["c_custkey", "c_nationkey"]).withColumn("value", F.round("value", 2))


@_query
def ignore_list(spark: SparkSession, sf: str) -> DataFrame:
    ignored = _files(spark, sf).where("key % 5 = 0").select("filename")
    return experiment.ignore(_runs(spark, sf).select("filename", "sfc", "compression", "bwt", "bitshuffle", "size"), ignored)


@_query
def config_summary(spark: SparkSession, sf: str) -> DataFrame:
    return experiment.summary(_runs(spark, sf))


@_query
def config_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return experiment.anomalies(_runs(spark, sf).where("not (sfc = 'gray' and filename = 'tile3')"), 25)


@_query
def events_cell_windows(spark: SparkSession, sf: str) -> DataFrame:
    events = _table(spark, sf, "events").select("ts", (F.col("user_id") % 64).alias("x"), (F.col("event_id") % 64).alias("y"))
    return cell_counts(events, "ts", ["x", "y"], 6, 6, "1 day")


@_query
def metric_file(spark: SparkSession, sf: str) -> DataFrame:
    """A metric under the headings of its file."""
    return logs.metric_lines(metrics.metric(spark, "clusters", "hilbert", 4).withColumn("normalised", F.round("normalised", 9)), "clusters")


QUERIES |= surface.QUERIES
