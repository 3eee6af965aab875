"""Analysis of compression experiments: sizes, run times, their joins, configurations, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import names

KEY = ["filename", "sfc", "compression", "bwt", "bitshuffle"]
#: Files that a complete experiment has for each configuration; columns of the result files.
EXPECTED_FILES = 1788
RESULT_COLUMNS = {"size": "Bytes", "runtime_compress": "Compression Runtime", "runtime_decompress": "Decompression Runtime", "relative_compress": "Relative Compression Runtime", "relative_decompress": "Relative Decompression Runtime", "filename": "Name", "sfc": "SFC", "compression": "Compression", "bwt": "BWT", "bitshuffle": "BitShuffle"}


def sizes(listing: DataFrame) -> DataFrame:
    """Key and size from (size, path)."""
    return listing.select(names.parse_filename(F.col("path")).alias("c"), F.col("size").cast("long")).select("c.*", "size")


def runtimes(joblog: DataFrame, measure: str) -> DataFrame:
    """Key and whole milliseconds of the jobs that ended well (exit and signal 0)."""
    good = joblog.where("exit = 0 and signal = 0")
    return good.select(names.parse_command(F.col("command")).alias("c"), F.floor(F.col("runtime").cast("double") * 1000).cast("long").alias(measure)).select("c.*", measure)


def join_results(size: DataFrame, compress: DataFrame, decompress: DataFrame) -> DataFrame:
    """Every size with its run times, if any."""
    return size.join(compress, KEY, "left").join(decompress, KEY, "left")


def without_size(size: DataFrame, log: DataFrame) -> DataFrame:
    """Runs that belong to no size: an error of the experiment."""
    return log.join(size, KEY, "left_anti")


def repeated(log: DataFrame) -> DataFrame:
    """Keys that ran more than once: an error of the experiment."""
    return log.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def ignore(results: DataFrame, filenames: DataFrame) -> DataFrame:
    return results.join(filenames.select("filename"), "filename", "left_anti")


def incomplete(results: DataFrame) -> DataFrame:
    return results.where("size is null or runtime_compress is null or runtime_decompress is null")


def add_external_base(results: DataFrame) -> DataFrame:
    """External codecs run on the stored file of the same configuration without codec: its times are added."""
    base = results.where(F.col("compression") == "none").select("filename", "sfc", "bwt", "bitshuffle", F.col("runtime_compress").alias("_c"), F.col("runtime_decompress").alias("_d"))
    joined = results.join(base, ["filename", "sfc", "bwt", "bitshuffle"], "left")
    add = names.is_external(F.col("compression"))
    return joined.withColumns({"runtime_compress": F.when(add, F.col("runtime_compress") + F.col("_c")).otherwise(F.col("runtime_compress")), "runtime_decompress": F.when(add, F.col("runtime_decompress") + F.col("_d")).otherwise(F.col("runtime_decompress"))}).drop("_c", "_d")


def add_relative(results: DataFrame) -> DataFrame:
    """Run time beyond that of the input configuration: the same without codec, or the original file where there is none."""
    base = results.select(F.col("filename"), F.col("sfc").alias("_sfc"), F.col("bwt").alias("_bwt"), F.col("bitshuffle").alias("_shuffle"), F.col("runtime_compress").alias("_c"), F.col("runtime_decompress").alias("_d")).where(F.col("compression") == "none")
    coded = F.col("compression") != "none"
    keyed = results.withColumns({"_sfc": F.when(coded, F.col("sfc")).otherwise("raster"), "_bwt": coded & F.col("bwt"), "_shuffle": coded & F.col("bitshuffle")})
    joined = keyed.join(base, ["filename", "_sfc", "_bwt", "_shuffle"], "left")
    return joined.withColumns({"relative_compress": F.col("runtime_compress") - F.col("_c"), "relative_decompress": F.col("runtime_decompress") - F.col("_d")}).drop("_sfc", "_bwt", "_shuffle", "_c", "_d")


def exported(results: DataFrame) -> DataFrame:
    """Columns of the result files; missing numbers are -1."""
    cells = [F.coalesce(F.col(c), F.lit(-1)) if c in ("size", "runtime_compress", "runtime_decompress", "relative_compress", "relative_decompress") else F.col(c) for c in RESULT_COLUMNS]
    return results.select(*(c.alias(n) for c, n in zip(cells, RESULT_COLUMNS.values(), strict=True)))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; others of both stay."""
    rest = [c for c in old.columns if c not in key]
    there = new.select(*key, F.struct(*rest).alias("_new"))
    joined = old.select(*key, F.struct(*rest).alias("_old")).join(there, key, "full_outer")
    return joined.select(*key, F.coalesce("_new", "_old").alias("_v")).select(*key, *(F.col("_v")[c].alias(c) for c in rest))


def config_matrix(spark: SparkSession, files: DataFrame) -> DataFrame:
    """files x 4 curves x 8 codecs x bit planes: 64 rows a file; the product has a fixed size beside the files."""
    codecs = ["none", "rle", "huffman", "lz77", "lzw", "bwt", "bzip_lz77", "bzip_lzw"]
    return files.select("filename", F.explode(F.array(*map(F.lit, names.SFC_EXTENSIONS))).alias("sfc")).select("*", F.explode(F.array(*map(F.lit, codecs))).alias("codec")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("bitshuffle"))


def valid_configs(spark: SparkSession) -> DataFrame:
    """The 104 valid configurations with short name and the name of the configuration that each runs on.

    External codecs run on the same configuration without codec, all others on the original file; the original has no parent.
    """
    both = F.array(F.lit(False), F.lit(True))
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, names.SFC_EXTENSIONS))).alias("sfc")).select("*", F.explode(F.array(*map(F.lit, names.COMPRESSION_EXTENSIONS))).alias("compression")).select("*", F.explode(both).alias("bwt")).select("*", F.explode(both).alias("bitshuffle"))
    valid = every.where(names.is_valid(F.col("compression"), F.col("bwt")))
    columns = [F.col(c) for c in ("sfc", "compression", "bwt", "bitshuffle")]
    stored = names.short_name(F.col("sfc"), F.lit("none"), F.col("bwt"), F.col("bitshuffle"))
    parent = F.when(names.is_external(F.col("compression")), stored).when(~names.is_original(*columns), names.short_name(F.lit("raster"), F.lit("none"), F.lit(False), F.lit(False)))
    return valid.select(*columns, names.short_name(*columns).alias("name"), parent.alias("parent")).dropDuplicates(["name"])


def expected_counts(results: DataFrame, configs: DataFrame) -> DataFrame:
    """Files of each configuration, 0 for those without."""
    key = ["sfc", "compression", "bwt", "bitshuffle"]
    return configs.select(*key).join(results.groupBy(*key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def summary(results: DataFrame) -> DataFrame:
    """Counts by curve, codec, bit planes, Burrows-Wheeler, file, and whole configuration, in one pass."""
    whole = ["sfc", "compression", "bwt", "bitshuffle"]
    sets = [["sfc"], ["compression"], ["bitshuffle"], ["bwt"], ["filename"], whole]
    columns = [F.col(c) for c in ("sfc", "compression", "bitshuffle", "bwt", "filename")]
    grouped = results.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return grouped.agg(F.count("*").alias("n"))


def preloaded(spark: SparkSession) -> DataFrame:
    """The configurations with bit planes that an experiment must have, before any file is counted."""
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, names.SFC_EXTENSIONS))).alias("sfc")).select("*", F.explode(F.array(*map(F.lit, names.COMPRESSION_EXTENSIONS))).alias("compression"))
    every = rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("bwt"), F.lit(True).alias("bitshuffle"))
    return every.where(~F.col("bwt") | F.col("compression").isin("lz4", "lz77", "lzw"))


def relative_to_base(results: DataFrame, measure: str) -> DataFrame:
    """Each run's measure beyond that of its group's run without codec, by a window instead of a join."""
    w = Window.partitionBy("filename", "sfc", "bwt", "bitshuffle")
    base = F.max(F.when(F.col("compression") == "none", F.col(measure))).over(w)
    return results.withColumn(f"relative_{measure}", F.col(measure) - base)


def anomalies(results: DataFrame, expected: int = EXPECTED_FILES) -> DataFrame:
    """Configurations without the expected number of files."""
    return results.groupBy("sfc", "compression", "bwt", "bitshuffle").agg(F.count("*").alias("n")).where(F.col("n") != expected)
