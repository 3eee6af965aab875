"""Names of experiment files as column expressions: aliases, tokens, extensions, configurations."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted spellings, by what they stand for.
SFC_ALIASES = {"raster": "raster", "row_major": "raster", "rstr": "raster", "zorder": "morton", "morton": "morton", "mrtn": "morton", "gray": "gray", "gray_code": "gray", "gry": "gray", "hilbert": "hilbert", "hbrt": "hilbert"}
COMPRESSION_ALIASES = {"huffman": "huffman", "huff": "huffman", "hff": "huffman", "gzip": "gzip", "gz": "gzip", "bzip": "bzip2", "bzip2": "bzip2", "bz2": "bzip2", "lz4": "lz4", "lz77": "lz77", "bzip_lz77": "lz77", "lzo": "lzo", "lzw": "lzw", "bzip_lzw": "lzw", "rle": "rle", "none": "none"}
BWT_TOKENS = ["bwt", "bzip_lz77", "bzip_lzw"]
SHUFFLE_TOKENS = ["btr"]
BASE_TOKENS = ["sfcc", "tif"]
#: File extensions, and the codecs that run outside the library.
SFC_EXTENSIONS = {"raster": "", "morton": ".mrtn", "gray": ".gry", "hilbert": ".hbrt"}
COMPRESSION_EXTENSIONS = {"none": "", "rle": ".rle", "huffman": ".hff", "lz77": ".lz77", "lzw": ".lzw", "gzip": ".gz", "bzip2": ".bz2", "lz4": ".lz4", "lzo": ".lzo"}
EXTERNAL = ["gzip", "bzip2", "lz4", "lzo"]
BWT_PARTNERS = ["none", "lz77", "lzw", "lz4"]
#: Labels of header codes.
CURVE_NAMES = ["ROW_MAJOR", "SNAKE_SCAN", "MORTON", "GRAY_CODE", "HILBERT"]
COMPRESSION_NAMES = ["NONE", "RLE", "HUFFMAN", "LZ77", "LZ78", "LZW", "DEFLATE", "BZIP_LZ77", "BZIP_LZW", "BWT"]


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))


def _label(code: Column, names: list[str]) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), code.cast("int")), F.lit("NULL"))


def curve_label(code: Column) -> Column:
    return _label(code, CURVE_NAMES)


def compression_label(code: Column) -> Column:
    return _label(code, COMPRESSION_NAMES)


def sfc(token: Column) -> Column:
    """Curve of a spelling in any case; null for others."""
    return F.get(F.array(F.try_element_at(_map(SFC_ALIASES), F.lower(token))), 0)


def compression(token: Column) -> Column:
    return F.get(F.array(F.try_element_at(_map(COMPRESSION_ALIASES), F.lower(token))), 0)


def parse_tokens(tokens: Column, strict: bool = False) -> Column:
    """struct(sfc, compression, bwt, bitshuffle) of an array of lower-case tokens; the last of a kind wins."""
    curves_, codecs = F.filter(tokens, lambda t: t.isin(list(SFC_ALIASES))), F.filter(tokens, lambda t: t.isin(list(COMPRESSION_ALIASES)))
    known = [*SFC_ALIASES, *COMPRESSION_ALIASES, *BWT_TOKENS, *SHUFFLE_TOKENS]
    out = F.struct(
        F.coalesce(sfc(F.try_element_at(curves_, F.lit(-1))), F.lit("raster")).alias("sfc"),
        F.coalesce(compression(F.try_element_at(codecs, F.lit(-1))), F.lit("none")).alias("compression"),
        F.arrays_overlap(tokens, F.array(*map(F.lit, BWT_TOKENS))).alias("bwt"),
        F.arrays_overlap(tokens, F.array(*map(F.lit, SHUFFLE_TOKENS))).alias("bitshuffle"),
    )
    return F.when(F.exists(tokens, lambda t: ~t.isin(known)), F.raise_error(F.lit("unknown token"))).otherwise(out) if strict else out


def parse_filename(path: Column, strict: bool = False) -> Column:
    """struct(filename, sfc, compression, bwt, bitshuffle): tokens after the base part (up to sfcc or tif) name the rest."""
    parts = F.split(F.lower(F.element_at(F.split(path, "/"), -1)), "\\.")
    bases = F.transform(parts, lambda t, i: F.when(t.isin(BASE_TOKENS), i))
    last = F.coalesce(F.array_max(bases), F.lit(0))
    name = F.array_join(F.filter(F.slice(parts, 1, last + 1), lambda t: ~t.isin(BASE_TOKENS)), ".")
    rest = parse_tokens(F.slice(parts, last + 2, F.size(parts)), strict)
    return F.struct(name.alias("filename"), *(rest[c].alias(c) for c in ("sfc", "compression", "bwt", "bitshuffle")))


#: The labels of the older result files, by extension, in the order in which they are looked for.
LEGACY_CURVES = {"mrtn": "Z-Order", "gry": "Gray", "hbrt": "Hilbert"}
LEGACY_CODECS = {"gz": "GZIP", "bz2": "BZIP2", "hff": "HUFFMAN", "lz4": "LZ4", "lz77": "LZ77", "lzo": "LZO", "lzw": "LZW", "rle": "RLE"}
LEGACY_BWT = {"LZ77": "BWT77", "LZW": "BWTW", "LZ4": "BWT4"}
#: Curve labels of block-entropy files.
ENTROPY_CURVES = {"gry": "Gray", "hbrt": "Hilbert", "mrtn": "Morton"}


def _first_of(tokens: Column, labels: dict[str, str], other: str) -> Column:
    return F.coalesce(*(F.when(F.array_contains(tokens, t), label) for t, label in labels.items()), F.lit(other))


def parse_legacy(path: Column) -> Column:
    """struct(filename, sfc, compression, bwt, bitshuffle) with the older labels; a name without an sfcc part raises."""
    parts = F.split(F.element_at(F.split(path, "/"), -1), "\\.")
    at = F.array_position(parts, "sfcc").cast("int")
    rest = F.slice(parts, at + 1, F.size(parts))
    bwt, codec = F.array_contains(rest, "bwt"), _first_of(rest, LEGACY_CODECS, "None")
    named = F.when(bwt, F.coalesce(F.try_element_at(_map(LEGACY_BWT), codec), codec)).otherwise(codec)
    out = F.struct(F.array_join(F.slice(parts, 1, at - 1), ".").alias("filename"), _first_of(rest, LEGACY_CURVES, "Raster").alias("sfc"), named.alias("compression"), bwt.alias("bwt"), F.array_contains(rest, "btr").alias("bitshuffle"))
    return F.when(at > 0, out).otherwise(F.raise_error(F.concat(F.lit("no sfcc part: "), path)))


def parse_entropy_name(path: Column) -> Column:
    """struct(name, sfc, bittransposed, bwt) of a block-entropy file; the second part is skipped, two curves give NULL."""
    parts = F.split(F.element_at(F.split(path, "/"), -1), "\\.")
    rest = F.slice(parts, 3, F.size(parts))
    found = F.filter(rest, lambda t: t.isin(list(ENTROPY_CURVES)))
    label = F.when(F.size(found) == 0, "Raster").when(F.size(found) == 1, _map(ENTROPY_CURVES)[F.get(found, 0)]).otherwise("NULL")
    return F.struct(F.get(parts, 0).alias("name"), label.alias("sfc"), F.array_contains(rest, "btr").alias("bittransposed"), F.array_contains(rest, "bwt").alias("bwt"))


def parse_command(command: Column) -> Column:
    """As parse_filename for a command line: the last argument is the file, known other arguments override its tokens."""
    args = F.filter(F.split(F.trim(command), "\\s+"), lambda a: a != "")
    base = parse_filename(F.element_at(args, -1))
    lower = F.transform(F.slice(args, 1, F.size(args) - 1), lambda a: F.lower(a))
    curves_, codecs = F.filter(lower, lambda t: t.isin(list(SFC_ALIASES))), F.filter(lower, lambda t: t.isin(list(COMPRESSION_ALIASES)))
    return F.struct(
        base["filename"].alias("filename"),
        F.coalesce(sfc(F.try_element_at(curves_, F.lit(-1))), base["sfc"]).alias("sfc"),
        F.coalesce(compression(F.try_element_at(codecs, F.lit(-1))), base["compression"]).alias("compression"),
        (base["bwt"] | F.arrays_overlap(lower, F.array(*map(F.lit, BWT_TOKENS)))).alias("bwt"),
        (base["bitshuffle"] | F.arrays_overlap(lower, F.array(*map(F.lit, [*SHUFFLE_TOKENS, "-b"])))).alias("bitshuffle"),
    )


def expected_filename(filename: Column, sfc_: Column, compression_: Column, bwt: Column, bitshuffle: Column) -> Column:
    """Name that a configuration gives its file."""
    return F.concat(filename, F.lit(".sfcc"), _map(SFC_EXTENSIONS)[sfc_], F.when(bitshuffle, ".btr").otherwise(""), F.when(bwt, ".bwt").otherwise(""), _map(COMPRESSION_EXTENSIONS)[compression_])


def short_name(sfc_: Column, compression_: Column, bwt: Column, bitshuffle: Column) -> Column:
    return F.concat_ws("-", sfc_, compression_, F.when(bwt, "bwt"), F.when(bitshuffle, "btr"))


def is_valid(compression_: Column, bwt: Column) -> Column:
    return ~bwt | compression_.isin(BWT_PARTNERS)


def is_external(compression_: Column) -> Column:
    return compression_.isin(EXTERNAL)


def is_original(sfc_: Column, compression_: Column, bwt: Column, bitshuffle: Column) -> Column:
    return (sfc_ == "raster") & (compression_ == "none") & ~bwt & ~bitshuffle


def matches(**wanted) -> Column:
    """Conjunction of equalities; what is None is free."""
    out = F.lit(True)
    for column, value in wanted.items():
        if value is not None:
            out = out & (F.col(column) == value)
    return out


def command_arguments(sfc_: Column, compression_: Column, bwt: Column, bitshuffle: Column) -> Column:
    """Arguments of a compress command for a configuration; external codecs have none."""
    codec = F.when(bwt & (compression_ == "none"), "BWT").when(bwt, F.concat(F.lit("BZIP_"), F.upper(compression_))).otherwise(F.upper(compression_))
    curve = F.when(sfc_ == "raster", "ROW_MAJOR").when(sfc_ == "gray", "GRAY_CODE").otherwise(F.upper(sfc_))
    return F.when(~is_external(compression_), F.concat_ws(" ", F.lit("compress"), F.when(bitshuffle, "-b"), F.lit("-s"), curve, F.lit("-c"), codec))
