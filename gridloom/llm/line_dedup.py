"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find; one line of each group stays.

Everything is DataFrame functions.

1. Lines (split at newlines; lines of white space are never touched) are known by two 64-bit hashes, so equal lines are
   one. Signature: MINIMA minima of the hashes of all character 5-grams, the same that step 3 compares, so signatures
   agree as often as the lines are similar; grouping by line needs no more than one row for each line and task.
2. A band is the minima at STEPS from its own number, so no two bands share more than one. Two lines that are alone
   in a band are a pair; in larger groups each line is first compared with the group's central line (that of most company
   in all its bands), then, the group sorted by its lines' other minima, with the closest of the NEAR lines before it that are in another
   component. These two rounds take only pairs that agree in AGREE minima (neighbours in CLOSE); they connect most of what
   is linked, without a square of pairs, and decide nothing. Groups are sorted in range partitions, so that a large one is no single task.
   The last round is complete: of every group that still holds several components, all pairs of lines of different
   components, without any cap. Sketches, then odd sketches of the sets of 5-grams, drop pairs in the join, only such as cannot be linked.
3. Each candidate pair is verified once: exact Jaccard of the sets of all character 5-grams, at least `least`.
4. Components by contraction (graph.components). Of each component the first line stays: the smallest doc_id, there the
   first row, there the smallest line number.

A pair of similarity 0.8 shares a band with a chance of 0.987, one of 0.85 with 0.998.

Null texts have no lines; empty texts have one blank line. Rows without doc_id are passed through unchanged by `dedup_lines` and
left out of `line_report`; rows that repeat a doc_id are documents of their own, in an order fixed when they are read, so a line
that they share stays in the first of them. Unequal lines with equal first hashes are told apart by the second and stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.graph import components
from gridloom.llm.util import drop, free_name, materialize, numbered, release, scratch, small, stacked

MINIMA, BANDS = 24, 20
#: Distances of a band's minima from its number, modulo MINIMA; all differences differ.
STEPS = (0, 1, 4, 9, 11)
#: Characters of white space, of which a line may consist.
BLANKS = " \\t\\n\\u000B\\u000C\\r"
#: Characters of a shingle.
GRAM = 5
#: 5-grams of a line that are hashed in one row.
RUN = 12
#: Minima in which a pair with a central line must agree, and those in which neighbours must; pairs of similarity 0.8 do
#: with chances of 0.996 and 0.91, and a line mostly has several neighbours that it is linked with.
AGREE, CLOSE = 14, 17
#: Lines before it in a sorted group that a line is compared with.
NEAR = 64
#: Words of 64 bits in a line's sketch, a power of two.
WORDS = 8
#: Bands that are worked on at a time: a quarter of them lies on disk at once, and generated code stays under the 8,000 bytes
#: of a method that the JVM compiles (all in one were more, and ran interpreted).
SLICES = tuple(range(k, k + 5) for k in range(0, BANDS, 5))
#: Parts in which lines get signatures, by their hash: their rows with whole minima are what a run moves most of at once.
HALVES = 2
#: Columns that hold 16 bits of four minima each.
SIGNATURE = tuple(f"s{i}" for i in range(MINIMA // 4))
#: Columns of a sketch: how many 5-grams a line has, repeats too, and a bit for the hash of each.
SKETCH = ("grams", *(f"w{j}" for j in range(WORDS)))
#: Words of an odd sketch, a power of two; those of lines of more than LONG 5-grams, which have WIDE besides.
ODD, WIDE, LONG = 32, 256, 4096
#: Rows with odd sketches that lie on disk at a time, about 300 bytes each.
ROWS = 1 << 20


def _lines(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, line_no, line, id, twin of lines that are not blank; docs has keys and text."""
    rows = docs.select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.expr(f"ltrim('{BLANKS}', line) <> ''"))
    return rows.withColumns({"id": F.xxhash64("line"), "twin": F.xxhash64(F.lit(1), "line")})


def _minima() -> list[str]:
    """Keys of the minima: either half of the hash, crossed with seeds that are spread over its range.

    The minimum of half ^ seed is the hash nearest to the seed, a min-wise choice.
    """
    n = MINIMA // 2
    seeds = [((i << 32) // n + 0x05A3C1E7 * (i + 1) % ((1 << 32) // n)) & 0xFFFFFFFF for i in range(n)]
    keys = [f"{half} ^ {s - (1 << 32) if s >> 31 else s}" for s in seeds for half in ("top", "low")]
    # minima of neighbouring seeds stand a third of the list apart
    return [keys[(3 * i + i // 8) % MINIMA] for i in range(MINIMA)]


#: Where the 5-grams of an encoded line (four bytes a character) begin, and the hash of the one at i; a shorter line is one.
_OFFSETS = f"sequence(1, greatest(1, octet_length({{0}}) - {4 * GRAM - 1}), 4)"
_HASH = f"xxhash64(substring({{0}}, i, {4 * GRAM}))"


def _encoded(line: str) -> str:
    return f"encode({line}, 'UTF-32')"


def _gram_set(code: str) -> str:
    """Hashes of the distinct character 5-grams of an encoded line.

    The line is bound to a lambda's variable: interpreted functions that read a column copy its bytes out of the row, here
    the whole line again for each of its grams.
    """
    return f"get(transform(array({code}), code -> array_distinct(transform({_OFFSETS.format('code')}, i -> {_HASH.format('code')}))), 0)"


def _lane(i: int) -> str:
    """16 bits of minimum i of a signature."""
    return f"(shiftright({SIGNATURE[i // 4]}, {16 * (i % 4)}) & 65535L)"


def _signatures(lines: DataFrame) -> DataFrame:
    """(id, signature, sketch): distinct lines with the low 16 bits, the most varied ones, of their minima, and their sketches."""
    coded = lines.select("id", F.expr(_encoded("line")).alias("code")).withColumn("grams", F.expr(f"greatest(1, octet_length(code) div 4 - {GRAM - 1})"))
    runs = coded.select("id", "code", "grams", F.explode(F.expr(f"sequence(0, grams - 1, {RUN})")).alias("at"))
    # beyond its end a line's last run takes its first 5-gram again, which changes neither minima nor bits
    hashes = runs.select("id", "grams", *(F.expr(_HASH.format("code").replace("i,", f"1 + 4 * if(at + {j} < grams, at + {j}, at),")).alias(f"h{j}") for j in range(RUN)))
    parts = {"top": "cast(shiftright({}, 32) as int)", "low": "cast(shiftright(shiftleft({}, 32), 32) as int)", "word": f"cast(shiftright({{}}, 6) & {WORDS - 1} as int)", "bit": "shiftleft(1L, cast({} & 63 as int))"}
    halves = hashes.select("id", "grams", *(F.expr(e.format(f"h{j}")).alias(f"{name}{j}") for name, e in parts.items() for j in range(RUN)))
    least = (f"least({', '.join(key.replace('top', f'top{j}').replace('low', f'low{j}') for j in range(RUN))})" for key in _minima())
    words = (" | ".join(f"if(word{i} = {j}, bit{i}, 0L)" for i in range(RUN)) for j in range(WORDS))
    minima = halves.groupBy("id").agg(*(F.min(F.expr(key)).alias(f"m{i}") for i, key in enumerate(least)), F.max("grams").alias("grams"), *(F.bit_or(F.expr(e)).alias(f"w{j}") for j, e in enumerate(words)))
    packed = [" | ".join(f"shiftleft(cast(m{4 * k + i} & 65535 as bigint), {16 * i})" for i in range(4)) for k in range(len(SIGNATURE))]
    return minima.select("id", *(F.expr(e).alias(s) for s, e in zip(SIGNATURE, packed, strict=True)), *SKETCH)


def _bands(lines: DataFrame, some: range = range(BANDS)) -> DataFrame:
    """(k, band, id): each line under its bands of the numbers `some`."""
    bands = (f"xxhash64({k}, {', '.join(_lane((k + d) % MINIMA) for d in STEPS)})" for k in some)
    return lines.select(F.posexplode(F.expr(f"array({', '.join(bands)})")).alias("k", "band"), "id").withColumn("k", F.col("k") + some.start)


def _grouped(bands: DataFrame) -> DataFrame:
    """bands of the lines that are not alone in a band, with n, how many these are, and high: of two the larger id, else null.

    The bands, by far the most rows of all, are moved once, and a line that is alone is gone before anything is written.
    """
    group = Window.partitionBy("band")
    counted = bands.withColumns({"n": F.count("*").over(group), "high": F.max("id").over(group)}).where("n > 1")
    return counted.select("band", "k", "id", "n", F.when(F.col("n") == 2, F.col("high")).alias("high"))


def _near() -> str:
    """Eight minima outside band k, as two numbers to sort by; lanes holds those of a signature."""
    others = [d for d in range(MINIMA) if d not in STEPS]
    x, y = (" | ".join(f"shiftleft(get(lanes, (k + {d}) % {MINIMA}), {16 * i})" for i, d in enumerate(others[lo : lo + 4])) for lo in (0, 4))
    return f"named_struct('x', {x}, 'y', {y})"


def _agreeing(x: str, y: str) -> str:
    """In how many lanes two sides agree; equal minima have equal lanes."""
    lanes = (f"if(({x}.{s} ^ {y}.{s}) & {65535 << 16 * i if i < 3 else -(1 << 48)}L = 0L, 1, 0)" for s in SIGNATURE for i in range(4))
    return f"({' + '.join(lanes)})"


def _only(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of lines whose id is in ids, which may repeat."""
    ids = materialize(ids.distinct(), "line-ids")
    return lines.join(small(ids, ids.count(), 16), "id", "left_semi")


def _promising(pairs: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree in AGREE minima and whose sketches allow that they are linked."""
    pairs = materialize(pairs, "line-pairs")
    met = materialize(_only(lines, pairs.select(F.col("a").alias("id")).union(pairs.select("b"))), "signed")
    x, y = (met.select(F.col("id").alias(side), F.struct(*SIGNATURE, *SKETCH).alias(f"of_{side}")) for side in "ab")
    return pairs.join(x, "a").join(y, "b").where(f"{_agreeing('of_a', 'of_b')} >= {AGREE} and {_alike('of_a', 'of_b', least)}").select("a", "b")


def _texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, line) of the lines in ids, which may repeat."""
    return _only(_lines(docs).select("id", "line"), ids).dropDuplicates(["id"])


def _verified(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(a, b, linked) for each pair of line ids, from the whole lines."""
    with scratch() as keep:
        pairs = materialize(pairs, "candidates")
        texts = materialize(_texts(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs), "line-texts")
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
        sets = both.select("a", "b", *(F.expr(_gram_set(_encoded(f"line_{s}"))).alias(f"set_{s}") for s in "ab"))
        counted = sets.select("a", "b", F.expr("size(set_a) + size(set_b)").alias("sizes"), F.expr("size(array_intersect(set_a, set_b))").alias("both"))
        return keep(counted, "line-verified").select("a", "b", F.expr(f"both >= {least} * (sizes - both)").alias("linked"))


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _neighbours(members: DataFrame, found: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b): each line of a sorted group with that of the NEAR lines before it that agrees with it in most minima, CLOSE at
    least, of those in other components. One for each line, so that a large group makes no square of pairs."""
    placed = members.join(small(found, found.count(), 24), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band")
    signed = placed.join(mixed, "band", "left_semi").join(lines.select("id", *SIGNATURE), "id")
    lanes = signed.withColumns({"of": F.struct(*SIGNATURE), "lanes": F.expr(f"array({', '.join(map(_lane, range(MINIMA)))})")})
    left = materialize(lanes.withColumn("near", F.expr(_near())).drop("k", "lanes", *SIGNATURE), "left")
    drop(placed)
    ranged = materialize(left.repartitionByRange("band", "near", "id").withColumn("run", F.spark_partition_id()), "ranged")
    drop(left)
    before = Window.partitionBy("band", "run").orderBy("near", "id").rowsBetween(-NEAR, -1)
    met = ranged.withColumn("before", F.collect_list(F.struct("id", "component", "of")).over(before))
    agreeing = f"transform(filter(before, other -> other.component <> component), other -> struct({_agreeing('of', 'other.of')} as n, other.id as id))"
    best = met.select("id", F.array_max(F.expr(agreeing)).alias("best")).where(f"best.n >= {CLOSE}")
    return best.select("id", F.col("best.id").alias("other")).select(*_ordered("id", "other")).distinct()


def _alike(x: str, y: str, least: float) -> str:
    """Two sketches allow the similarity `least`.

    A bit that one line alone has stands for a 5-gram that it alone has; linked lines have no more of these than this share of
    their sets' sizes, which are at most their numbers of 5-grams. So no linked pair is dropped.
    """
    apart = " + ".join(f"bit_count({x}.w{j} ^ {y}.w{j})" for j in range(WORDS))
    return f"({apart}) * {1 + least}D <= ({x}.grams + {y}.grams) * {1 - least}D + 1e-6D"


def _odd(texts: DataFrame) -> DataFrame:
    """(id, size, o0 and on, wide): the size of each line's set of 5-grams, and its odd sketch: each bit tells whether the number
    of 5-grams whose hash falls on it is odd. wide is the sketch in WIDE words of a line of more than LONG 5-grams, else null."""
    sets = texts.select("id", F.expr(_gram_set(_encoded("line"))).alias("set"))
    hashes = sets.select("id", F.size("set").alias("size"), F.explode("set").alias("h"))
    placed = hashes.select("id", "size", F.expr(f"cast(shiftright(h, 6) & if(size > {LONG}, {WIDE - 1}, {ODD - 1}) as int)").alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    words = materialize(placed.groupBy("id", "size", "word").agg(F.expr("bit_xor(bit)").alias("bits")), "odd-words")
    odd = words.groupBy("id").agg(F.max("size").alias("size"), *(F.expr(f"bit_xor(if((word & {ODD - 1}) = {j}, bits, 0L))").alias(f"o{j}") for j in range(ODD)))
    wide = words.where(f"size > {LONG}").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("by_word"))
    wide = wide.select("id", F.expr(f"transform(sequence(0, {WIDE - 1}), j -> coalesce(try_element_at(by_word, j), 0L))").alias("wide"))
    out = materialize(odd.join(wide, "id", "left"), "odd")
    drop(words)
    return out


def _matching(x: str, y: str, least: float) -> str:
    """As _alike, for odd sketches: where two differ there is a 5-gram that one line alone has."""
    allowed = f"({x}.size + {y}.size) * {1 - least}D + 1e-6D"
    apart = " + ".join(f"bit_count({x}.o{j} ^ {y}.o{j})" for j in range(ODD))
    wide = f"aggregate(zip_with({x}.wide, {y}.wide, (p, q) -> bit_count(p ^ q)), 0, (s, n) -> s + n)"
    return f"abs({x}.size - {y}.size) * {1 + least}D <= {allowed} and ({apart}) * {1 + least}D <= {allowed} and ({x}.wide is null or {y}.wide is null or {wide} * {1 + least}D <= {allowed})"


def _open(placed: DataFrame) -> DataFrame:
    """The rows of groups that hold several components, with in_main, whether a line is in the group's largest one.

    Rows are moved once, by band, and those of groups that are one component go before anything else is done.
    """
    group, share = Window.partitionBy("band"), Window.partitionBy("band", "component")
    mixed = placed.withColumns({"x": F.min("component").over(group), "y": F.max("component").over(group)}).where("x < y").drop("x", "y")
    counted = mixed.withColumn("n", F.count("*").over(share)).withColumn("main", F.max(F.struct("n", "component")).over(group))
    return counted.select("band", "id", "component", (F.col("component") == F.col("main.component")).alias("in_main"))


def _across(members: DataFrame, found: DataFrame, lines: DataFrame, docs: DataFrame, least: float, spent: Sequence[DataFrame] = ()) -> DataFrame:
    """(a, b): all lines of different components that share a band, but for those whose sets show that they are not linked.

    members has all groups; it and lines are read before any pairs are looked for, and spent, the tables that they lie in, go then. A group's largest component meets the others only, so a group that is one component but for
    a few lines costs as many comparisons as these lines times the group. A pair counts in the least of the bands that it
    shares, and only there its lines get odd sketches, if the plain ones allow that it is linked; pairs become rows only
    if these allow it too, so close pairs that are not linked make none. Where many lines are left, bands are taken in parts.
    """
    placed = members.join(small(found, found.count(), 24), "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    left = materialize(_open(placed), "open")
    # lines of different components that share a band share it here, so these are all that can be the least
    own = materialize(left.groupBy("id", "component").agg(F.collect_list(F.struct("band", "in_main")).alias("places")), "open-ids")
    drop(left)
    n = own.count()
    signed = lines.join(small(own.select("id"), n, 16), "id", "left_semi").select("id", F.struct(*SKETCH).alias("sketch"))
    ready = signed.join(small(own, n, 48 + 32 * BANDS), "id").withColumn("place", F.explode("places"))
    ready = ready.select("place.band", "id", "component", "place.in_main", "sketch", F.expr("transform(filter(places, p -> p.band < place.band), p -> p.band)").alias("bands"))
    ready = materialize(ready, "open-lines")
    for table in (own, *spent):
        drop(table)
    apart, first = "x.band = y.band and x.component <> y.component", "not arrays_overlap(x.bands, y.bands)"
    met = F.expr(f"{apart} and {_alike('x.sketch', 'y.sketch', least)} and {first}")
    outside = materialize(ready.where("not in_main").alias("x").join(ready.alias("y"), met, "left_semi"), "outside")
    inside = ready.where("in_main").alias("x").join(outside.alias("y"), met, "left_semi")
    close = materialize(outside.union(inside).drop("sketch"), "close")
    drop(ready)
    drop(outside)
    odd = _odd(_texts(close.select("id"), docs))
    pairs, parts = [], 1 + close.count() // ROWS
    for i in range(parts):
        rows = materialize(close.where(f"pmod(xxhash64(band), {parts}) = {i}").join(odd, "id"), "close-lines")
        x, y = rows.where("not in_main").alias("x"), rows.alias("y")
        linked = F.expr(f"{apart} and (y.in_main or x.id < y.id) and {_matching('x', 'y', least)} and {first}")
        pairs.append(materialize(x.join(y, linked).select(*_ordered("x.id", "y.id")), "across"))
        drop(rows)
    drop(close)
    drop(odd)
    return stacked(pairs).distinct()


def line_groups(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(id, component): lines (by hash) that are linked with other lines; component is the smallest id reached."""
    spark = docs.sparkSession
    release(spark)
    with scratch() as keep:
        alone = [materialize(_signatures(_lines(docs).where(f"pmod(id, {HALVES}) = {i}")), "lines") for i in range(HALVES)]
        slices = [materialize(_grouped(_bands(stacked(alone), some)), "members") for some in SLICES]
        grouped = stacked(slices)
        members = grouped.where("high is null").drop("high")
        # of lines that are alone in all their bands nothing more is asked
        lines = materialize(_only(stacked(alone), grouped.select("id")), "banded")
        for table in alone:
            drop(table)
        release(spark)
        with scratch() as keep_here:
            company = members.groupBy("id").agg(F.sum("n").alias("company"))
            central = members.join(company, "id").groupBy("band").agg(F.max_by("id", "company").alias("lead"))
            stars = members.join(central, "band").where("id <> lead").select(*_ordered("id", "lead"))
            pairs = grouped.where("id < high").select(F.col("id").alias("a"), F.col("high").alias("b"))
            checked = keep_here(_verified(_promising(stars.union(pairs).distinct(), lines, least), docs, least), "checked")
        found = components(checked.where("linked").select("a", "b"))
        release(spark)
        with scratch() as keep_here:
            rest = _neighbours(members.drop("n"), found, lines).join(checked.select("a", "b"), ["a", "b"], "left_anti")
            more = keep_here(_verified(rest, docs, least).where("linked").select("a", "b"), "more")
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
        release(spark)
        # what is not linked by now: every pair that shares a band
        with scratch() as keep_here:
            rest = _across(grouped.select("band", "id"), found, lines, docs, least, spent=(lines, *slices))
            last = keep_here(_verified(rest, docs, least).where("linked").select("a", "b"), "last")
        return keep(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(last)), "line-groups")


def _removed(rows: DataFrame, row: str, least: float) -> DataFrame:
    """(doc_id, row, removed): the line numbers that go, in order, for the rows that lose any."""
    docs = rows.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row, "text")
    with scratch() as hold:
        groups = line_groups(docs.select("text"), least)
        n = groups.count()
        # a linked line goes by its component, any other by its own two hashes
        twins = _lines(docs).join(small(groups, n, 24), "id", "left_semi").groupBy("id").agg(F.min("twin").alias("twin"), F.max("twin").alias("other")).where("twin = other").drop("other")
        groups = materialize(groups.join(small(twins, n, 24), "id"), "twinned")
        named = _lines(docs, "doc_id", row).drop("line").join(small(groups, n, 32), ["id", "twin"], "left")
        places = materialize(named.select("doc_id", row, "line_no", F.coalesce("component", "id").alias("group"), F.when(F.col("component").isNull(), F.col("twin")).otherwise(0).alias("single")), "places")
        repeated = places.groupBy("group", "single").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        repeated = materialize(repeated, "repeated")
        mine = materialize(places.join(small(repeated, repeated.count(), 32), ["group", "single"]), "repeated-places")
        keep = materialize(mine.groupBy("group", "single").agg(F.min(F.struct("doc_id", row, "line_no")).alias("first")), "keep")
        gone = mine.join(small(keep, keep.count(), 64), ["group", "single"]).where(F.struct("doc_id", row, "line_no") != F.col("first"))
        return hold(gone.groupBy("doc_id", row).agg(F.sort_array(F.collect_list("line_no")).alias("removed")), "removed")


def _small_removed(removed: DataFrame) -> DataFrame:
    n, lines = removed.agg(F.count("*"), F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()
    return small(removed, 6 * n + lines, 8)


def line_report(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, n_lines (blank ones too), n_removed, removed (their numbers from 0, in order) for every document."""
    rows = numbered(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "row")
    removed = _removed(rows, "row", least)
    counts = rows.select("doc_id", "row", F.expr("if(text is null, 0, length(text) - length(replace(text, '\n', '')) + 1)").cast("long").alias("n_lines"))
    whole = counts.join(_small_removed(removed), ["doc_id", "row"], "left").withColumn("removed", F.coalesce("removed", F.expr("cast(array() as array<int>)")))
    return whole.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def dedup_lines(docs: DataFrame, least: float = 0.8, drop_emptied: bool = False) -> DataFrame:
    """The documents without the lines that the report removes.

    A document that loses all its lines keeps an empty text, or goes if drop_emptied.

    n_chars, where there is such a column, follows the text.
    """
    row, gone, parts = (free_name(docs, name) for name in ("row", "gone", "parts"))
    rows = numbered(docs, row)
    removed = _removed(rows, row, least).withColumnsRenamed({"removed": gone, "doc_id": f"{gone}_doc", row: f"{gone}_row"})
    joined = rows.join(_small_removed(removed.withColumnRenamed(gone, "removed")).withColumnRenamed("removed", gone), (F.col("doc_id") == F.col(f"{gone}_doc")) & (F.col(row) == F.col(f"{gone}_row")), "left")
    split = joined.withColumn(parts, F.when(F.col(gone).isNotNull(), F.split("text", "\n")))
    left = f"array_join(transform(array_except(sequence(0, size(`{parts}`) - 1), `{gone}`), i -> get(`{parts}`, i)), '\n')"
    out = split.withColumn("text", F.expr(f"if(`{gone}` is null, text, {left})"))
    if drop_emptied:
        out = out.where(f"`{gone}` is null or text rlike '\\\\S'")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.expr(f"if(`{gone}` is null, n_chars, length(text))").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
