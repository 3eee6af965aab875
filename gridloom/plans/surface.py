"""Queries over names, sources, small functions and SQL registrations, each beside its SQL for DuckDB."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import curves, geometry, names, registry
from gridloom.functions.codecs import bwt_rows
from gridloom.operators import statistics
from gridloom.plans import experiment
from gridloom.sources import arrayfile, logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir; in local mode a temporary one will do."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if told:
        return f"{told.rstrip('/')}/gridloom/files-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="gridloom-")


_CONFIG_SQL = """(SELECT sfc, compression, bwt, bitshuffle FROM (VALUES ('raster'), ('morton'), ('gray'), ('hilbert')) s(sfc),
 (VALUES ('none'), ('rle'), ('huffman'), ('lz77'), ('lzw'), ('gzip'), ('bzip2'), ('lz4'), ('lzo')) c(compression),
 (VALUES (false), (true)) b(bwt), (VALUES (false), (true)) t(bitshuffle) WHERE NOT bwt OR compression IN ('none', 'lz77', 'lzw', 'lz4'))"""
_CONFIG = ["sfc", "compression", "bwt", "bitshuffle"]


@_query("SELECT CAST(n AS INT) AS n, (SELECT CAST(sum(CAST(1 AS BIGINT) << b.range) AS BIGINT) FROM range(0, 32) b WHERE b.range % n = 0) AS mask, (CAST(1 AS BIGINT) << least(16, 32 // n)) - 1 AS longest FROM (VALUES (1), (2), (3), (4)) v(n)")
def interleave_limits(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n, curves.interleave_mask(n, 32), curves.max_interleave_length(32, 16, n)) for n in (1, 2, 3, 4)], "n int, mask long, longest long")


@_query("SELECT l_orderkey, l_linenumber, l_partkey, least(40, l_partkey % 256) AS x0, least(50, l_suppkey % 256) AS y0, greatest(90, l_partkey % 256) AS x1, greatest(120, l_suppkey % 256) AS y1 FROM lineitem")
def box_expanded(spark: SparkSession, sf: str) -> DataFrame:
    lines = _table(spark, sf, "lineitem")
    low, high = geometry.box_expand([F.lit(40), F.lit(50)], [F.lit(90), F.lit(120)], [F.col("l_partkey") % 256, F.col("l_suppkey") % 256])
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", *(c.cast("long").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (*low, *high), strict=True)))


@_query("SELECT t AS type, b AS bits, CAST(1 AS BIGINT) << e AS power FROM (VALUES ('tinyint', 8, 0), ('smallint', 16, 5), ('int', 32, 31), ('bigint', 64, 62)) v(t, b, e)")
def integer_constants(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, exponent in (("tinyint", 0), ("smallint", 5), ("int", 31), ("bigint", 62)):
        row = spark.range(1).select(F.lit(name).alias("type"), F.lit(geometry.sizeof_bits(name)).alias("bits"), geometry.power_of_two(exponent).alias("power"))
        out = row if out is None else out.unionByName(row)
    return out


@_query("SELECT p_partkey, CASE WHEN encode(p_name) < encode(p_brand) THEN -1 WHEN encode(p_name) > encode(p_brand) THEN 1 ELSE 0 END AS by_name, CASE WHEN encode(p_type) < encode('PROMO') THEN -1 WHEN encode(p_type) > encode('PROMO') THEN 1 ELSE 0 END AS by_type FROM part")
def words_compared(spark: SparkSession, sf: str) -> DataFrame:
    binary = lambda c: F.encode(c, "UTF-8")
    return _table(spark, sf, "part").select("p_partkey", geometry.compare_words(binary(F.col("p_name")), binary(F.col("p_brand"))).alias("by_name"), geometry.compare_words(binary(F.col("p_type")), binary(F.lit("PROMO"))).alias("by_type"))


@_query("WITH n AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS r FROM lineitem) SELECT a.l_orderkey, count(*) AS pairs, CAST(sum(b.l_partkey - a.l_partkey) AS BIGINT) AS gaps FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND a.r < b.r GROUP BY a.l_orderkey")
def combinations_in_orders(spark: SparkSession, sf: str) -> DataFrame:
    parts = _table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("parts"))
    return parts.select("l_orderkey", F.explode(geometry.each_combination(F.col("parts"), lambda a, b: b - a)).alias("gap")).groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.sum("gap").alias("gaps"))


@_query("SELECT p_partkey, 'tile' || p_partkey AS filename, (['raster', 'morton', 'gray', 'hilbert'])[p_partkey % 4 + 1] AS sfc, (['none', 'huffman', 'lz77', 'lzw', 'lz77'])[p_partkey % 5 + 1] AS compression, p_partkey % 5 >= 4 AS bwt, p_partkey % 3 = 1 AS bitshuffle FROM part")
def parse_commands(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (key % n).cast("int"))
    command = F.concat(F.lit("tool compress "), F.when(key % 3 == 1, "-b ").otherwise(""), F.lit("-s "), pick(["ROW_MAJOR", "MORTON", "GRAY_CODE", "HILBERT"], 4), F.lit(" -c "), pick(["NONE", "HUFFMAN", "LZ77", "LZW", "BZIP_LZ77"], 5), F.lit(" data/tile"), key, F.lit(".tif.sfcc"))
    return _table(spark, sf, "part").select("p_partkey", names.parse_command(command).alias("c")).select("p_partkey", "c.*")


@_query(f"""SELECT sfc, compression, bwt, bitshuffle, 'tile.sfcc' || CASE sfc WHEN 'morton' THEN '.mrtn' WHEN 'gray' THEN '.gry' WHEN 'hilbert' THEN '.hbrt' ELSE '' END || CASE WHEN bitshuffle THEN '.btr' ELSE '' END || CASE WHEN bwt THEN '.bwt' ELSE '' END
 || CASE compression WHEN 'none' THEN '' WHEN 'huffman' THEN '.hff' WHEN 'gzip' THEN '.gz' WHEN 'bzip2' THEN '.bz2' ELSE '.' || compression END AS name,
 CASE WHEN compression NOT IN ('gzip', 'bzip2', 'lz4', 'lzo') THEN concat_ws(' ', 'compress', CASE WHEN bitshuffle THEN '-b' END, '-s', CASE sfc WHEN 'raster' THEN 'ROW_MAJOR' WHEN 'gray' THEN 'GRAY_CODE' ELSE upper(sfc) END, '-c', CASE WHEN bwt AND compression = 'none' THEN 'BWT' WHEN bwt THEN 'BZIP_' || upper(compression) ELSE upper(compression) END) END AS arguments,
 sfc = 'raster' AND compression = 'none' AND NOT bwt AND NOT bitshuffle AS original, compression IN ('gzip', 'bzip2', 'lz4', 'lzo') AS external FROM {_CONFIG_SQL}""")
def config_names(spark: SparkSession, sf: str) -> DataFrame:
    columns = [F.col(c) for c in _CONFIG]
    return experiment.valid_configs(spark).select(*columns, names.expected_filename(F.lit("tile"), *columns).alias("name"), names.command_arguments(*columns).alias("arguments"), names.is_original(*columns).alias("original"), names.is_external(F.col("compression")).alias("external"))


@_query("""SELECT * FROM (VALUES ('zorder', 'morton', NULL), ('MRTN', 'morton', NULL), ('Gray_Code', 'gray', NULL), ('rstr', 'raster', NULL), ('hbrt', 'hilbert', NULL), ('huff', NULL, 'huffman'),
 ('GZ', NULL, 'gzip'), ('bzip', NULL, 'bzip2'), ('bzip_lzw', NULL, 'lzw'), ('none', NULL, 'none'), ('tif', NULL, NULL)) v(token, sfc, compression)""")
def token_names(spark: SparkSession, sf: str) -> DataFrame:
    tokens = spark.createDataFrame([(t,) for t in ("zorder", "MRTN", "Gray_Code", "rstr", "hbrt", "huff", "GZ", "bzip", "bzip_lzw", "none", "tif")], "token string")
    return tokens.select("token", names.sfc(F.col("token")).alias("sfc"), names.compression(F.col("token")).alias("compression"))


@_query(f"SELECT compression, bitshuffle, count(*) AS n FROM {_CONFIG_SQL}, nation WHERE sfc = 'hilbert' AND bwt GROUP BY ALL")
def config_matches(spark: SparkSession, sf: str) -> DataFrame:
    runs = _table(spark, sf, "nation").crossJoin(F.broadcast(experiment.valid_configs(spark)))
    return runs.where(names.matches(sfc="hilbert", bwt=True, compression=None)).groupBy("compression", "bitshuffle").agg(F.count("*").alias("n"))


@_query(f"""WITH p AS (SELECT sfc, compression, bwt, true AS bitshuffle FROM (VALUES ('raster'), ('morton'), ('gray'), ('hilbert')) s(sfc), (VALUES ('none'), ('rle'), ('huffman'), ('lz77'), ('lzw'), ('gzip'), ('bzip2'), ('lz4'), ('lzo')) c(compression), (VALUES (false), (true)) b(bwt)
 WHERE NOT bwt OR compression IN ('lz4', 'lz77', 'lzw')), r AS (SELECT sfc, compression, bwt, bitshuffle, count(*) AS n FROM {_CONFIG_SQL}, nation WHERE sfc <> 'gray' GROUP BY ALL) SELECT p.*, coalesce(n, 0) AS n FROM p LEFT JOIN r USING (sfc, compression, bwt, bitshuffle)""")
def preloaded_counts(spark: SparkSession, sf: str) -> DataFrame:
    runs = _table(spark, sf, "nation").crossJoin(F.broadcast(experiment.valid_configs(spark))).where("sfc <> 'gray'")
    return experiment.expected_counts(runs, experiment.preloaded(spark))


@_query("""SELECT p_partkey, 'tile' || p_partkey || '.a' AS filename, (['Raster', 'Z-Order', 'Gray', 'Hilbert'])[p_partkey % 4 + 1] AS sfc,
 CASE p_partkey % 6 WHEN 0 THEN 'None' WHEN 1 THEN CASE WHEN p_partkey % 2 = 1 THEN 'BWT77' ELSE 'LZ77' END WHEN 2 THEN 'HUFFMAN' WHEN 3 THEN CASE WHEN p_partkey % 2 = 1 THEN 'BWT4' ELSE 'LZ4' END WHEN 4 THEN 'GZIP' ELSE CASE WHEN p_partkey % 2 = 1 THEN 'BWTW' ELSE 'LZW' END END AS compression,
 p_partkey % 2 = 1 AS bwt, p_partkey % 3 = 1 AS bitshuffle FROM part""")
def legacy_names(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))
    path = F.concat(F.lit("out/tile"), key, F.lit(".a.sfcc"), pick(["", ".mrtn", ".gry", ".hbrt"]), F.when(key % 3 == 1, ".btr").otherwise(""), F.when(key % 2 == 1, ".bwt").otherwise(""), pick(["", ".lz77", ".hff", ".lz4", ".gz", ".lzw"]))
    return _table(spark, sf, "part").select("p_partkey", names.parse_legacy(path).alias("c")).select("p_partkey", "c.*")


_SIZES_SQL = f"(SELECT 'tile' || n_nationkey AS filename, sfc, compression, bwt, bitshuffle, CAST(n_nationkey AS BIGINT) AS key FROM nation, {_CONFIG_SQL})"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of a full experiment over the nations."""
    runs = _table(spark, sf, "nation").select(F.concat(F.lit("tile"), "n_nationkey").alias("filename"), F.col("n_nationkey").cast("long").alias("key")).crossJoin(F.broadcast(experiment.valid_configs(spark)))
    return runs.select("*", F.concat(F.lit("out/"), names.expected_filename(F.col("filename"), *(F.col(c) for c in _CONFIG))).alias("path"))


@_query(f"SELECT filename, sfc, compression, bwt, bitshuffle, key * 10 + 1 AS size FROM {_SIZES_SQL}")
def size_listing(spark: SparkSession, sf: str) -> DataFrame:
    to = scratch(spark) + "/sizes"
    _named(spark, sf).select(F.concat((F.col("key") * 10 + 1).cast("string"), F.lit("\t"), "path")).write.text(to)
    return experiment.sizes(logs.read_sizes(spark, to))


@_query(f"SELECT filename, sfc, compression, bwt, bitshuffle, key * 1000 + 250 AS runtime FROM {_SIZES_SQL} WHERE key % 4 <> 1")
def joblog_runtimes(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs that ended well; every fourth file's jobs failed."""
    to = scratch(spark) + "/log"
    cells = ["1", "host", "0.0", F.concat("key", F.lit(".25")), "0", "0", F.when(F.col("key") % 4 == 1, "1").otherwise("0"), "0", F.concat(F.lit("compress "), "path")]
    head = ["Seq", "Host", "Starttime", "JobRuntime", "Send", "Receive", "Exitval", "Signal", "Command"]
    _named(spark, sf).select(*((F.lit(c) if isinstance(c, str) else c).alias(h) for c, h in zip(cells, head, strict=True))).write.csv(to, sep="\t", header=True)
    return experiment.runtimes(logs.read_joblog(spark, to), "runtime")


@_query(f"""SELECT key * 10 AS "Bytes", CASE WHEN key % 3 = 0 THEN -1 ELSE key END AS "Compression Runtime", key + 1 AS "Decompression Runtime", -1 AS "Relative Compression Runtime", -1 AS "Relative Decompression Runtime",
 filename AS "Name", sfc AS "SFC", compression AS "Compression", bwt AS "BWT", bitshuffle AS "BitShuffle" FROM {_SIZES_SQL}""")
def exported_results(spark: SparkSession, sf: str) -> DataFrame:
    """The result files, written and read again."""
    to = scratch(spark)
    none = F.lit(None).cast("long")
    runs = _named(spark, sf).select("filename", *_CONFIG, (F.col("key") * 10).alias("size"), F.when(F.col("key") % 3 != 0, F.col("key")).alias("runtime_compress"), (F.col("key") + 1).alias("runtime_decompress"), none.alias("relative_compress"), none.alias("relative_decompress"))
    logs.write_results(runs, to, "tile1")
    kinds = {c: "string" for c in ("Name", "SFC", "Compression")} | {c: "boolean" for c in ("BWT", "BitShuffle")}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'long')}" for c in experiment.RESULT_COLUMNS.values())
    return spark.read.csv([f"{to}/data_ska", f"{to}/data_srtm"], header=True, schema=schema)


@_query(f"SELECT r.*, r.runtime - b.runtime AS relative_runtime FROM (SELECT *, key * 7 + length(compression) AS runtime FROM {_SIZES_SQL}) r LEFT JOIN (SELECT *, key * 7 + 4 AS runtime FROM {_SIZES_SQL} WHERE compression = 'none') b USING (filename, sfc, bwt, bitshuffle)")
def runs_by_window(spark: SparkSession, sf: str) -> DataFrame:
    runs = _named(spark, sf).select("filename", *_CONFIG, "key", (F.col("key") * 7 + F.length("compression")).alias("runtime"))
    return experiment.relative_to_base(runs, "runtime")


_ENTROPY_SQL = "WITH c AS (SELECT event_id // 1000 AS block, CAST(round(value * 100) AS BIGINT) % 256 AS v, count(*) AS c FROM events GROUP BY ALL), t AS (SELECT block, sum(c) AS n, sum(c * ln(c)) AS s FROM c GROUP BY block) SELECT 'tile' AS name, 'Gray' AS \"SFC\", true AS bittransposed, false AS bwt, block * 1000 AS \"offset\", round((ln(n) - s / n) / ln(256), 6) AS entropy FROM t"


@_query(_ENTROPY_SQL)
def entropy_file(spark: SparkSession, sf: str) -> DataFrame:
    events = _table(spark, sf, "events").select("event_id", (F.round(F.col("value") * 100).cast("long") % 256).alias("v"))
    blocks = statistics.block_entropy(events, "v", "event_id", 1000).select(F.lit("data/tile.sfcc.gry.btr").alias("path"), (F.col("block") * 1000).alias("offset"), "entropy")
    lines = logs.entropy_lines(blocks)
    each = lines.select("name", "SFC", "bittransposed", "bwt", F.explode(F.arrays_zip("entropy_offsets", "entropy_encoded")).alias("e"))
    return each.select("name", "SFC", "bittransposed", "bwt", F.col("e.entropy_offsets").alias("offset"), F.round("e.entropy_encoded", 6).alias("entropy"))


@_query("""WITH s AS (SELECT n_nationkey, n_name, i.range AS i, substr(n_name, CAST(i.range AS INT) + 1) AS rest FROM nation, range(0, 64) i WHERE i.range <= length(n_name)),
 r AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY rest) - 1 AS row, CASE WHEN i > 0 THEN substr(n_name, CAST(i AS INT), 1) END AS c FROM s),
 f AS (SELECT *, coalesce(c, lag(c) OVER (PARTITION BY n_nationkey ORDER BY row)) AS last FROM r)
 SELECT n_nationkey, string_agg(last, '' ORDER BY row) AS turned, CAST(max(CASE WHEN i = 0 THEN row END) AS INT) AS row FROM f GROUP BY n_nationkey""")
def bwt_of_names(spark: SparkSession, sf: str) -> DataFrame:
    """The n + 1 rows form of the Burrows-Wheeler transform."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            done = [bwt_rows(name.encode()) for name in batch["n_name"]]
            yield pd.DataFrame({"n_nationkey": batch["n_nationkey"], "turned": [t.decode() for t, _ in done], "row": [r for _, r in done]})

    return _table(spark, sf, "nation").select("n_nationkey", "n_name").mapInPandas(run, "n_nationkey int, turned string, row int")


@_query("""WITH v AS (SELECT event_id // 1024 AS a, string_agg(printf('%02X%02X', w & 255, (w >> 8) & 255), '' ORDER BY event_id) AS h FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS w FROM events) GROUP BY a)
 SELECT 'array-' || a AS name, 2 AS ndims, 5 AS k, 2 AS dtype_nbytes, 0 AS sfctype, false AS bittransposed, 0 AS compression, md5(unhex(rpad(h, 4096, '0'))) AS digest FROM v""")
def array_files(spark: SparkSession, sf: str) -> DataFrame:
    """All events as array files, written by the tasks and read again."""
    from gridloom.plans.catalogue import _array_payloads

    to = scratch(spark)
    arrayfile.write_arrays(_array_payloads(spark, sf), to)
    read = arrayfile.read_arrays(spark, to)
    return read.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "ndims", "k", "dtype_nbytes", "sfctype", "bittransposed", "compression", F.md5("payload").alias("digest"))


@_query()
def sql_walks(spark: SparkSession, sf: str) -> DataFrame:
    """Curves by the registered SQL functions; the distances of the walked cells are their numbers."""
    registry.register(spark)
    parts = [f"SELECT '{name}' AS curve, d, x, y, curve_distance('{name}', 6, x, y) AS back FROM grid_walk('{name}', 6)" for name in ("raster", "morton", "gray", "hilbert")]
    return spark.sql(" UNION ALL ".join(parts))


@_query("SELECT 1 AS code, 'SNAKE_SCAN' AS label, false AS supported UNION ALL SELECT 2, 'MORTON', true")
def snake_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The snake scan has a code and a label, but no mapping: asking for it raises."""

    def there(name: str) -> bool:
        try:
            curves.curve(name)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(1, there("snake_scan")), (2, there("morton"))], "code int, supported boolean").select("code", names.curve_label(F.col("code")).alias("label"), "supported")
