"""Each operator against brute force on small fixtures, with nulls, empty and long texts, repeats and odd columns."""

import collections
import hashlib
import itertools
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, graph, html_extract, line_dedup, mixing, ngram_join, quality_mil, quality_rules, substring_dedup, toxicity, url_filter, util
from gridloom.llm.textops import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, removed string, rate string, hi string"
_RND = random.Random(5)
_VOCAB = ["".join(_RND.choice("abdefilmnorstu") for _ in range(_RND.randint(2, 7))) for _ in range(400)]


def _prose(n, rnd):
    return " ".join(rnd.choice(_VOCAB) for _ in range(n))


def _texts():
    """Documents by id: copies, near copies, shared passages, junk, empty, null, long, odd white space."""
    rnd = random.Random(1)
    base, passage, line = _prose(120, rnd), _prose(60, rnd), _prose(14, rnd)
    out = {i: _prose(rnd.randint(20, 90), rnd) for i in range(10)}
    out |= {10: base, 11: base, 12: base.upper(), 13: " ".join([*base.split()[:-1], "other"]), 14: _prose(30, rnd) + " " + passage + " " + _prose(30, rnd), 15: passage + "\n" + _prose(20, rnd)}
    out |= {16: line + "\n" + _prose(20, rnd) + "\n" + line, 17: _prose(10, rnd) + "\n" + line.replace("a", "e", 1) + "\n\n", 18: "", 19: None, 20: " \t\n ", 21: "one", 22: "one", 23: "tab\there\x0bvertical\x0cform\rreturn", 24: ("word " * 3000).strip(), 25: "a b c d  e é ß", 26: passage, 27: "\n".join([line] * 5)}
    out |= {28 + i: " ".join(w if (j * 7 + i) % 60 else f"edit{i}" for j, w in enumerate(base.split())) for i in range(6)}
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "x", "y", "z", "h") for i, t in _texts().items()]
    return spark.createDataFrame([*rows, (None, "row without an id", "en", "s", 0, "x", "y", "z", "h")], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (7, 6), (5, 5), (2, 1), (None, 4), *((i, i + 1) for i in range(100, 140))]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6} | {i: 100 for i in range(100, 141)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _brute_windows(rows):
    """(n_words, kept text) of each (doc_id, text): windows of 13 words that a smaller doc_id has go."""
    texts = [(i, [w.decode() for w in words(t)]) for i, t in rows]
    first = {}
    for i, w in texts:
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def _cut_rows(df):
    rows = df.collect()
    assert all(r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)
    return sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in rows)


def test_substring_dedup(docs, none):
    want = _brute_windows(_texts().items())
    for flush in (4_000_000, 40):
        assert _cut_rows(substring_dedup.substring_dedup(docs, flush_windows=flush)) == want
    assert substring_dedup.substring_dedup(none).count() == 0


def test_substring_dedup_repeated_rows(spark):
    """Rows that share a doc_id, with equal and with different texts, are each judged by their own words."""
    rnd = random.Random(21)
    p, q = _prose(40, rnd), _prose(40, rnd)
    rows = [(1, p), (1, q), (1, "short"), (2, _prose(10, rnd) + " " + p), (2, _prose(3, rnd) + " " + q + " tail"), (2, p), (2, p), (3, q + " " + p), (3, None)]
    assert _cut_rows(substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id int, text string").repartition(3))) == _brute_windows(rows)


def test_substring_dedup_collisions(spark):
    """Windows whose hashes are forced to collide are compared by their words; windows of the graph are hashed to 4 bits here."""
    rnd = random.Random(22)
    p = _prose(30, rnd)
    rows = [(1, _prose(30, rnd)), (2, p), (3, _prose(30, rnd)), (4, _prose(5, rnd) + " " + p), (5, _prose(14, rnd)), (6, p + " " + _prose(4, rnd))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    # rows of one text each, so that a weak hash can be put in place of the real one in the same process
    import numpy as np

    from gridloom.llm import textops

    real, weak = textops.window_hashes, lambda h, k: real(h, k) & np.uint64(15)
    k = 13
    textops.window_hashes = weak
    try:
        import pandas as pd

        frame = docs.toPandas()
        packed = pd.concat(substring_dedup._ship(k, 2, 50)(iter([frame])))
        edges = pd.concat([substring_dedup._meet(2)(part) for _, part in packed.groupby("bucket")])
        paths = pd.concat([substring_dedup._compacted(part) for _, part in edges.groupby("bucket")])
        held = {d: substring_dedup._Words(t) for d, t in rows}
        walks = collections.defaultdict(list)
        for r in paths.itertuples():
            mark = held[r.src].digest(r.sstart, r.edges + k - 1)
            walks[r.doc_id].append({"start": r.start, "edges": r.edges, "marks": [mark] if mark else None})
        batch = pd.DataFrame({"doc_id": frame["doc_id"], "text": frame["text"], "walks": [walks.get(d) for d in frame["doc_id"]], "exact": None})
        got = pd.concat(substring_dedup._cut(k, True)(iter([batch])))
        unsure = {h for hashes in got["unsure"] for h in hashes}
        assert unsure
        windows = pd.concat(substring_dedup._windows(k)(iter([frame])))
        windows = windows[windows["hash"].isin(unsure)]
        first = windows.groupby("words")["doc_id"].min()
        later = windows[windows["doc_id"] > windows["words"].map(first)]
        batch["exact"] = [later[later["doc_id"] == d][["tag", "pos"]].to_dict("records") for d in frame["doc_id"]]
        again = pd.concat(substring_dedup._cut(k, True)(iter([batch])))
    finally:
        textops.window_hashes = real
    assert sorted(zip(again["doc_id"], again["n_words"], again["n_removed"], again["text"])) == _brute_windows(rows)


def test_substring_dedup_compact():
    import numpy as np

    got = substring_dedup.compact(*(np.array(x) for x in ([7, 7, 7, 7, 8, 7], [3, 4, 5, 9, 3, 4], [1, 1, 1, 1, 1, 1], [10, 11, 12, 2, 10, 11])))
    assert got.values.tolist() == [[7, 9, 1, 1, 2], [7, 3, 3, 1, 10], [8, 3, 1, 1, 10]]


def _sets(n):
    out = {}
    for i, t in _texts().items():
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        out[i] = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(docs, none, n, percent):
    sets = _sets(n)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, n, percent).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    if n == 4:
        assert ngram_join.ngram_join(none).count() == 0
        kept = ngram_join.keep_first(docs, n, percent)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {i for i in sets if find(i) == i} | {None}


def test_line_dedup(docs, none):
    texts = _texts()
    places = [(i, n, x) for i in sorted(texts) for n, x in enumerate((texts[i] or "").split("\n")) if texts[i] is not None and x.strip(" \t\r\x0b\f")]
    grams = {x: {x[p : p + 5] for p in range(len(x) - 4)} if len(x) >= 5 else {x} for _, _, x in places}
    names = sorted(grams)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in names:
        for b in names:
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                root[find(b)] = find(a)
    seen, want = set(), collections.defaultdict(list)
    for i, n, x in places:
        if find(x) in seen:
            want[i].append(n)
        seen.add(find(x))
    got = {r.doc_id: r for r in line_dedup.line_report(docs).collect()}
    assert {i: r.removed for i, r in got.items()} == {i: want[i] for i in texts}
    assert all(r.n_lines == (0 if texts[i] is None else texts[i].count("\n") + 1) and r.n_removed == len(r.removed) for i, r in got.items())
    cleaned = line_dedup.dedup_lines(docs)
    assert cleaned.columns == docs.columns
    for r in cleaned.collect():
        if r.doc_id is not None:
            t = texts[r.doc_id]
            assert r.text == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[r.doc_id]))
    assert line_dedup.line_report(none).count() == 0 and line_dedup.dedup_lines(none).count() == 0
    assert {r.doc_id for r in line_dedup.dedup_lines(docs, drop_emptied=True).collect()} >= {0, 10, 18}


def _jaccard_lines(x, y):
    a, b = ({t[p : p + 5] for p in range(len(t) - 4)} for t in (x, y))
    return len(a & b) / len(a | b)


def test_line_dedup_large_group(spark, monkeypatch):
    """Two strays beside a linked group are joined though all their bands hold every line."""
    monkeypatch.setattr(line_dedup, "AGREE", 0)
    monkeypatch.setattr(line_dedup, "CLOSE", 0)
    monkeypatch.setattr(line_dedup, "NEAR", 130)
    rnd = random.Random(12)
    near = _prose(30, rnd)
    lines = [" ".join(w if j != k % 30 else f"v{k}" for j, w in enumerate(near.split())) for k in range(120)]
    lines += ["stray alpha " + _prose(25, rnd)]
    lines += [lines[-1] + " x"]
    # one signature for all: every group holds every line
    monkeypatch.setattr(line_dedup, "_minima", lambda: ["0"] * line_dedup.MINIMA)
    corpus = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    removed = {r.doc_id for r in line_dedup.line_report(corpus).collect() if r.n_removed}
    assert _jaccard_lines(*lines[-2:]) > 0.8 > _jaccard_lines(lines[0], lines[-1])
    assert len(lines) - 1 in removed and len(lines) - 2 not in removed


def _brute_lines(lines):
    """Numbers of the lines that go: all but the first of each group of lines of similarity 0.8 or more."""
    grams = [{t[p : p + 5] for p in range(max(1, len(t) - 4))} for t in lines]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(lines)):
        for a in range(b):
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in range(len(lines)) if find(i) != i}


@pytest.mark.parametrize("kind", ["variants", "no spaces", "tabs"])
def test_line_dedup_recall(spark, kind):
    """Many near lines in one group, most of them not linked with its leaders: at least 0.96 of what brute force removes."""
    rnd = random.Random(len(kind))
    if kind == "variants":
        base = _prose(40, rnd).split()
        lines = [" ".join(rnd.choice(_VOCAB) if j in at else w for j, w in enumerate(base)) for at in (set(rnd.sample(range(40), rnd.choice([2, 3]))) for _ in range(300))]
    else:
        sep = "" if kind == "no spaces" else "\t"
        lines = []
        for _ in range(60):
            base = [rnd.choice(_VOCAB) for _ in range(30)]
            lines += [sep.join(base), sep.join(rnd.choice(_VOCAB) if j in at else w for at in [{rnd.randrange(30)}] for j, w in enumerate(base))]
    corpus = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got, want = {r.doc_id for r in line_dedup.line_report(corpus).collect() if r.n_removed}, _brute_lines(lines)
    assert not got - want and len(want) > 30 and len(got) >= 0.96 * len(want)


def test_line_dedup_every_pair_of_a_band(spark, monkeypatch):
    """Of lines that share bands, most of them not linked with any central line, each linked pair is found, whatever the first rounds let through."""
    monkeypatch.setattr(line_dedup, "AGREE", 24)
    monkeypatch.setattr(line_dedup, "CLOSE", 24)
    monkeypatch.setattr(line_dedup, "NEAR", 1)
    rnd = random.Random(5)
    base = _prose(40, rnd).split()
    changed = lambda words, k: [rnd.choice(_VOCAB) if j in at else w for at in [set(rnd.sample(range(40), k))] for j, w in enumerate(words)]
    lines = [" ".join(x) for y in (changed(base, 9) for _ in range(150)) for x in (y, changed(y, rnd.choice([2, 3, 4])))]
    corpus = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    number = {r.id: i for i, r in reversed(list(enumerate(corpus.select(F.xxhash64("text").alias("id")).collect())))}
    bands, grams, root = collections.defaultdict(list), [{t[p : p + 5] for p in range(len(t) - 4)} for t in lines], list(range(len(lines)))
    for r in line_dedup._bands(line_dedup._signatures(line_dedup._lines(corpus))).select("band", "id").collect():
        bands[r.band].append(number[r.id])

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in {tuple(sorted(p)) for group in bands.values() for p in itertools.combinations(group, 2)}:
        if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    repeated = {i for i, t in enumerate(lines) if lines.index(t) != i}
    want = {i for i in range(len(lines)) if find(i) != i} | repeated
    assert {r.doc_id for r in line_dedup.line_report(corpus).collect() if r.n_removed} == want


def test_line_dedup_sets_for_one_band_of_a_pair(spark, monkeypatch):
    """The complete round gives the two lines of a pair their sets in one of the bands that they share."""
    rnd, written, materialize = random.Random(5), [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "AGREE", 25)
    monkeypatch.setattr(line_dedup, "CLOSE", 25)
    pairs = [(line, line + " x") for line in (_prose(40, rnd) for _ in range(30))]

    def counted(df, name="table"):
        table = materialize(df, name)
        if name == "close-lines":
            written.append(table.count())
        return table

    monkeypatch.setattr(line_dedup, "materialize", counted)
    corpus = spark.createDataFrame(list(enumerate(x for p in pairs for x in p)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.line_report(corpus).collect() if r.n_removed} == set(range(1, 60, 2))
    assert written == [60]


def test_line_dedup_complete_round_in_parts(spark, monkeypatch):
    """The complete round takes long lines by sketches of a fixed size, in parts and wide ones too, and gives every linked pair."""
    rnd = random.Random(6)
    base = [[rnd.choice(_VOCAB) + str(rnd.randrange(1000)) for _ in range(200)] for _ in range(3)]
    lines = [" ".join(w if j % step != k else "other" for j, w in enumerate(b)) for b in base for step, k in ((60, 0), (60, 1), (5, 0))]
    corpus = util.materialize(spark.createDataFrame([("\n".join(lines),)], "text string"))
    number = {r.id: r.line_no for r in line_dedup._lines(corpus).select("id", "line_no").collect()}
    signed = util.materialize(line_dedup._signatures(line_dedup._lines(corpus)))
    alone = spark.createDataFrame([], "id long, component long")
    linked = {(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if _jaccard_lines(lines[a], lines[b]) >= 0.8}
    for rows, long in ((1 << 20, 4096), (4, 1000)):
        monkeypatch.setattr(line_dedup, "ROWS", rows)
        monkeypatch.setattr(line_dedup, "LONG", long)
        found = line_dedup._across(line_dedup._bands(signed).select("band", "id"), alone, signed, corpus, 0.8).collect()
        assert len(linked) == 3 and {tuple(sorted((number[r.a], number[r.b]))) for r in found} == linked


def test_line_dedup_signatures_by_runs(spark, monkeypatch):
    """Runs of 5-grams give the minima and bits of each single 5-gram, whatever is left over, in compiled code."""
    rnd = random.Random(8)
    lines = [("\U0001F600é x"[:n] or "y") + " ".join(rnd.choice(_VOCAB) for _ in range(n % 7))[:n] for n in range(60)] + ["ab" * 500]
    corpus = spark.createDataFrame([("\n".join(lines),)], "text string")
    code, want = line_dedup._encoded("line"), set()
    for r in line_dedup._lines(corpus).select("id", F.length("line").alias("n"), F.expr(line_dedup._gram_set(code)).alias("grams")).collect():
        halves = [{"top": h >> 32, "low": (h & 0xFFFFFFFF) - ((h & 0x80000000) << 1)} for h in r.grams]
        minima = [min(h[half] ^ int(seed) for h in halves) & 65535 for half, seed in (key.split(" ^ ") for key in line_dedup._minima())]
        words = [0] * line_dedup.WORDS
        for h in r.grams:
            words[(h >> 6) % line_dedup.WORDS] |= 1 << (h & 63)
        packed = [sum(m << 16 * i for i, m in enumerate(minima[k : k + 4])) for k in range(0, line_dedup.MINIMA, 4)]
        want.add((r.id, *(x - (x >> 63 << 64) for x in packed), max(1, r.n - 4), *(x - (x >> 63 << 64) for x in words)))
    for run in (2, 5, line_dedup.RUN):
        monkeypatch.setattr(line_dedup, "RUN", run)
        assert {tuple(r) for r in line_dedup._signatures(line_dedup._lines(corpus)).collect()} == want
    assert len(want) == len(set(lines)) and line_dedup.RUN > 5
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = line_dedup._signatures(line_dedup._lines(corpus))._jdf.queryExecution()
        code = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) <= 8000


def test_line_dedup_bands_move_once(spark):
    """The lines that share a band are found with one shuffle of the bands, none after it; those alone in a band are not among them."""
    rnd = random.Random(9)
    base = _prose(40, rnd).split()
    lines = [" ".join(w if j not in (k, k + 20) else f"v{k}" for j, w in enumerate(base)) for k in range(8)] + [_prose(40, rnd) for _ in range(20)]
    signed = util.materialize(line_dedup._signatures(line_dedup._lines(spark.createDataFrame([("\n".join(lines),)], "text string"))))
    bands = collections.defaultdict(list)
    for r in line_dedup._bands(signed).collect():
        bands[r.band, r.k].append(r.id)
    want = {(b, k, i, len(ids), max(ids) if len(ids) == 2 else None) for (b, k), ids in bands.items() if len(ids) > 1 for i in ids}
    grouped = line_dedup._grouped(line_dedup._bands(signed))
    assert {tuple(r) for r in grouped.collect()} == want and {n for _, _, _, n, _ in want} >= {2, 3}
    assert grouped._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert grouped._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_line_dedup_bands_are_compiled(spark):
    """No generated method of a slice of the bands is over 8,000 bytes, beyond which the JVM interprets it; the slices are all bands."""
    lines = util.materialize(line_dedup._signatures(line_dedup._lines(spark.createDataFrame([(0, "a line of some words")], "doc_id long, text string"))))
    assert [k for some in line_dedup.SLICES for k in some] == list(range(line_dedup.BANDS))
    whole = {tuple(r) for r in line_dedup._bands(lines).collect()}
    assert {tuple(r) for some in line_dedup.SLICES for r in line_dedup._bands(lines, some).collect()} == whole and len(whole) == 20
    # the adaptive plan shows no code before it runs
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = [line_dedup._bands(lines, some).groupBy("band").agg(F.min("id"), F.max("id"), F.count("*"))._jdf.queryExecution() for some in line_dedup.SLICES]
        made = [plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")) for plan in plans]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for code in made:
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
        assert sizes and max(sizes) < 8000


def test_line_dedup_tables_hold_what_is_asked(spark, monkeypatch):
    """Lines that are alone in all bands keep no signature, and signatures and bands are gone when pairs are looked for."""
    rows, seen, there = {}, {}, lambda name: sorted(n for n, path in seen.items() if n.startswith(name) and os.path.exists(path))
    before = []
    real = line_dedup.materialize

    def noted(df, name="table"):
        if name == "outside":
            before.extend(n for kind in ("lines", "banded", "members") for n in there(kind))
        out = real(df, name)
        seen[f"{name}-{len(seen)}"] = re.sub("^file:", "", out._table_path)
        rows[name] = rows.get(name, 0) + out.count() if name == "lines" else out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", noted)
    rnd = random.Random(8)
    line = _prose(16, rnd)
    texts = [line, line + " more", *(_prose(16, rnd) for _ in range(30))]
    got = line_dedup.line_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("n_removed > 0")
    assert [r.doc_id for r in got.collect()] == [1]
    assert rows["lines"] == 32 and 2 <= rows["banded"] < 10
    assert any(n.startswith("members") for n in seen) and "outside" in rows and before == []


def test_line_dedup_open_groups_move_once(spark):
    rows = [(b, 10 * b + i, c) for b, parts in enumerate(([1, 1, 1], [1, 2, 2], [3, 3, 4, 4], [5])) for i, c in enumerate(parts)]
    got = line_dedup._open(spark.createDataFrame(rows, "band long, id long, component long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((b, i, c, c == {1: 2, 2: 4}[b]) for b, i, c in rows if b in (1, 2))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") in (1, 2)  # the final plan of an adaptive one names it again


def test_line_dedup_close_lines_make_no_square(spark, monkeypatch):
    """Lines of one group that are close and not linked: what is verified grows with the lines, not with their square."""
    rnd = random.Random(8)
    base = _prose(168, rnd).split()
    lines = [" ".join(rnd.choice(_VOCAB) if j in at else w for j, w in enumerate(base)) for at in (set(rnd.sample(range(168), 8)) for _ in range(200))]
    verified, seen = line_dedup._verified, []

    def counted(pairs, *rest):
        out = verified(pairs, *rest)
        seen.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "_verified", counted)
    corpus = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got, want = {r.doc_id for r in line_dedup.line_report(corpus).collect() if r.n_removed}, _brute_lines(lines)
    assert got <= want and len(got) >= 0.96 * len(want)
    assert len(seen) == 3 and sum(seen) <= 25 * len(lines)


def test_line_dedup_repeated_rows(spark):
    """Rows that share a doc_id: the first keeps a line, the others lose it; nothing else is lost."""
    rows = [(5, "a line that two equal rows have\nand one more line here", 1), (5, "a line that two equal rows have\nand one more line here", 1), (5, "an other text of the same id", 2), (6, "an other text of the same id", 3), (None, "a line that two equal rows have", 4)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, row int")
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert got == sorted([(5, rows[0][1]), (5, ""), (5, rows[2][1]), (6, ""), (0, rows[4][1])])
    assert sorted(r.n_removed for r in line_dedup.line_report(docs).collect()) == [0, 0, 1, 2]
    kept = line_dedup.dedup_lines(docs, drop_emptied=True)
    assert kept.columns == docs.columns and sorted(r.row for r in kept.collect()) == [1, 2, 4]


def test_line_dedup_signatures(spark):
    """Lines that few or no spaces cut are linked as well: short ones, URLs, tabs, scripts without spaces."""
    pairs = [("Read more...", "Read more.."), ("All rights reserved worldwide 2023.", "All rights reserved worldwide 2024."), ("http://example.org/archive/2024/item/1234567890/view", "http://example.org/archive/2024/item/1234567890/vie"), ("\t".join(f"cell{i}" for i in range(40)), "\t".join(f"cell{i}" for i in range(39)) + "\tcell4x"), ("春眠不覚暁処処聞啼鳥夜来風雨声花落知多少今日晴天", "春眠不覚暁処処聞啼鳥夜来風雨声花落知多少今日晴"), ("\U0001f600" * 3 + "smile and wave to all", "\U0001f600" * 3 + "smile and wave to al")]
    assert all(_jaccard_lines(*p) >= 0.8 for p in pairs)
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(t for p in pairs for t in p)], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.line_report(corpus).collect() if r.n_removed} == set(range(1, 2 * len(pairs), 2))
    texts = spark.createDataFrame([("a\U0001f600b\nc d",), ("abc",), ("",), ("aaaaaaaaa",)], "t string").select(F.expr("encode(t, 'UTF-32')").alias("code"))
    assert [n for (n,) in texts.select(F.expr(f"size({line_dedup._gram_set('code')})")).collect()] == [3, 1, 1, 1]


def test_quality_counts():
    text = "A b#c\n\nA b#c\n x x x x x y x x x x x y é|<>"
    n_words, chars, symbols, dup, repeats, *_ = quality_rules.text_counts(text)
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert (n_words, chars, symbols, dup) == (len(w), sum(map(len, w)), 5, 1)
    counts = collections.Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
    hit = [any(counts[tuple(w[p : p + 5])] > 1 for p in range(max(0, i - 4), min(i, len(w) - 5) + 1)) for i in range(len(w))]
    assert repeats == sum(hit)
    assert quality_rules.text_counts(None) == quality_rules.text_counts(" \n") == [0] * 11


def _labelled(spark):
    """Plain and junk documents with labels; a fifth of each kind without."""
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        bad, toxic = i % 4 == 0, i % 3 == 0
        w = _prose(rnd.randint(15, 200), rnd).split()
        if toxic:
            w[len(w) // 2] = rnd.choice(["blorgh", "skrunk"])
        text = " ".join(x + "%%%" for x in w) if bad else " ".join(w)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_rules(spark, docs, none):
    corpus, labels = _labelled(spark)
    rows = quality_rules.quality_rules(corpus, labels).collect()
    assert all(r.base_failed or r.kept == (r.doc_id % 4 != 0) for r in rows)
    unlabelled = labels.limit(0)
    odd = {r.doc_id: r for r in quality_rules.quality_rules(docs, unlabelled).collect()}
    assert set(odd) == set(_texts()) and not odd[19].kept and not odd[24].kept and odd[0].kept and all(r.rule == 0 for r in odd.values())
    assert quality_rules.quality_rules(none, unlabelled).count() == 0
    kept = quality_rules.keep_quality(corpus, labels)
    assert kept.columns == corpus.columns and all(r.doc_id % 4 for r in kept.collect())


@pytest.mark.parametrize(("operator", "label", "of"), [(quality_mil.quality_classifier, "quality", lambda i: i % 4 != 0), (toxicity.toxicity, "toxic", lambda i: i % 3 == 0)])
def test_classifiers(spark, docs, none, operator, label, of):
    import zlib

    corpus, labels = _labelled(spark)
    rows = operator(corpus, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.predicted == of(r.doc_id) for r in held) >= 0.95 * len(held)
    again = operator(corpus, labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col(label)).otherwise(F.col(label)))).collect()
    assert {r.doc_id: round(r.score, 6) for r in again} == {r.doc_id: round(r.score, 6) for r in rows}
    odd = operator(docs, labels).collect()
    assert {r.doc_id for r in odd} == set(_texts()) and all(r.score == r.score for r in odd)
    assert operator(none, labels).count() == 0 and operator(docs, labels.limit(0)).count() == len(_texts())


def test_restoring(spark):
    corpus = spark.createDataFrame([(i, "you are an idiot and a moron with pathetic trash for clowns " * 5) for i in range(20)], "doc_id long, text string")
    model = toxicity.letter_model(corpus)
    for disguised, plain in (("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooot", "idiot"), ("m0r0n", "moron"), ("p@thet1c", "pathetic"), ("tr4sh", "trash"), ("cl*wns", "clowns"), ("i d i o t", "idiot")):
        assert plain in toxicity.restored(f"so {disguised} then", model, {})
    assert toxicity.restored("plain words, only.", model, {}) == {"plain", "words", "only"}
    assert toxicity.restored(None, model, {}) == set()


def test_html():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="page"><header><a>Home</a></header><div id="cookie-notice">We use cookies</div>
    <nav><ul><li>menu</ul></nav><div class=sidebar>side</div><div class="content"><h1>T&eacute;st &amp; more</h1><p>One  two<br>three <b>bold</b><p>Four<ul><li>a<li>b</ul>
    <form><input><label>q</label></form><table><tr><td>x<td>y</table><div class="comments"><p>reader</div><script>if(a<b){"</p>"}</script>tail &lt; 5 a < b</div><footer>f</footer>"""
    text = lambda p: [b.text for b in html_extract.chosen(html_extract.parse(p)[0])]
    assert text(page) == ["Tést & more", "One two three bold", "Four", "a", "b", "x", "y", "tail < 5 a < b"]
    assert text("<body><div>out</div><article><header><h1>H</h1><span>by</span></header><p>A<aside>no</aside>B</article><article class=comment>c</article>") == ["H", "A", "B"]
    assert text(None) == text("") == text("<p> &nbsp; </p>") == [] and text("plain &amp; text") == ["plain & text"]
    assert text("<article>" + "<p><b>x" * 2000) == ["x"] * 2000


def test_style_tree(spark):
    """Without <article>, a branch that is the same on all pages of a host goes; what differs stays."""
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<body><div class=top>Welcome here</div><div class=text><p>Story {i}<p>More {i * 7}</div></body>") for i in range(60)]
    rows += [(100, None, None), (101, "http://solo.org/", "<div class=top>Welcome here</div>"), (None, "x", "<article>y</article>")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, low string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.html_extract(pages).collect()}
    assert got[3] == ("Story 3\nMore 21", 15) and got[100] == ("", 0) and got[101] == ("Welcome here", 12) and got[None] == ("y", 1)
    assert html_extract.html_extract(pages.limit(0)).count() == 0


def test_style_tree_in_articles(spark):
    """Importance decides inside <article> too: a branch that all pages of the host share goes; copies of a page keep their text."""
    page = "<body><article><h1>Title {0}</h1><div class=note>Read our other stories</div><p>Story {0} of the day.</article></body>"
    rows = [(i, f"http://a.org/{i}", page.format(i)) for i in range(40)] + [(100 + i, "http://copies.org/", page.format(7)) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.html_extract(pages).collect()}
    assert got[3] == "Title 3\nStory 3 of the day." and got[105] == "Title 7\nRead our other stories\nStory 7 of the day."
    # without the tree the shared branch stays
    kept = {r.page_id: r.text for r in html_extract.html_extract(pages, least=0.0).collect()}
    assert kept[3] == "Title 3\nRead our other stories\nStory 3 of the day."


def test_url_filter(spark):
    cases = [("http://A.Example.ORG/es/x", "example.org/es/", "block"), ("https://example.org/en/125?q", "example.org/en/1", "block"), ("http://x.org/", "org/", "allow"), ("http://x.org", None, "allow"), ("http://notexample.org/es/", "org/", "allow"), ("http://b.com/fr/1#t", "com/fr/", "allow"), ("http://com/de/", "com/de/", "block"), ("http://b.net/de/", None, "allow"), ("no scheme", None, "allow"), (None, None, "allow"), ("http://x.org/", "org/", "allow"), ("http:///fr/", None, "allow")]
    pages = spark.createDataFrame([(i, u, "e") for i, (u, *_) in enumerate(cases)], "page_id long, url string, entry string")
    rules = url_filter.rule_table(spark, url_filter.RULES)
    got = {r.page_id: r for r in url_filter.url_filter(pages, rules).collect()}
    assert {i: (r.rule, r.verdict) for i, r in got.items()} == {i: c[1:] for i, c in enumerate(cases)}
    assert (got[0].host, got[0].path, got[8].host, got[9].path) == ("a.example.org", "/es/x", "", "")
    assert all(r.verdict == "allow" and r.rule is None for r in url_filter.url_filter(pages, rules.limit(0)).collect())
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0
    # many entries: the filter lets possible hits through and the join has the last word
    many = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".org/p")).alias("entry"), F.lit("block").alias("verdict"))
    seen = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".org/p")).alias("url"))
    assert {r.page_id for r in url_filter.url_filter(seen, many).where("verdict = 'block'").collect()} == set(range(3000))


def test_leaks(spark, docs, none):
    rnd = random.Random(9)
    items = [(i, _prose(rnd.randint(15, 40), rnd), "e") for i in range(12)] + [(50, "tiny item", "e"), (51, "", "e"), (52, None, "e"), (None, "x y z", "e")]
    rows, want = [], set()
    for i in range(12):
        w = items[i][1].split()
        changed = list(w)
        changed[1] = "swapped"
        for j, piece in enumerate((w, [x.upper() for x in w], changed, w[: len(w) // 2])):
            rows.append((10 * i + j, _prose(20, rnd) + "\n" + " ".join(piece) + " " + _prose(20, rnd)))
    rows += [(900, "so a tiny item here"), (901, "tiny"), (902, None), (903, ""), (904, items[3][1])]
    corpus = spark.createDataFrame([(*r, "e", "f") for r in rows], "doc_id long, text string, item_id string, size string")
    shingles = lambda w, n: collections.Counter(tuple(w[p : p + n]) for p in range(len(w) - n + 1))
    for d, t, *_ in rows:
        w = (t or "").lower().split()
        for i, s, _ in items:
            iw = (s or "").lower().split()
            if i is None or not iw:
                continue
            n, m = min(5, len(iw)), len(iw)
            a = shingles(iw, n)
            for p in range(max(1, len(w) - m + 1)):
                b = shingles(w[p : p + m], n)
                if b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(corpus, bench).collect()} == want and len(want) > 24
    clean = decontaminate.decontaminate(corpus, bench)
    assert clean.columns == corpus.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(none, bench).count() == 0


def test_leaks_index_is_broadcast_only_if_it_fits(spark):
    """The entries of many items are not sent to the driver and to all executors: only few are broadcast; both ways find the same."""
    prints = util.materialize(spark.range(1000).selectExpr("id as item_id", "20 as size", "xxhash64(id) as item_print"))
    printed = util.materialize(prints.selectExpr("item_id as doc_id", "size", "1 as start", "item_print ^ 2049 as print"))
    for items in (prints, prints.where("item_id < 50")):
        found = decontaminate.meet(printed, items)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastExchange" in plan) == (items is not prints)
        assert {(r.doc_id, r.item_id) for r in found.collect()} >= {(i, i) for i in range(1000 if items is prints else 50)}


@pytest.mark.parametrize("n", [44, 60, 100])
def test_leaks_reordered(spark, n):
    """An item whose halves are swapped is found."""
    rnd = random.Random(n)
    w = [f"w{i}" for i in range(n)]
    text = _prose(80, rnd) + " " + " ".join(w[n // 2 :] + w[: n // 2]) + " " + _prose(80, rnd)
    got = decontaminate.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")).collect()
    both = n - 4 - 4
    assert [(r.doc_id, r.item_id, r.start) for r in got] == [(1, 7, 80)] and abs(got[0].similarity - both / (2 * (n - 4) - both)) < 1e-9


def test_hamming_index(spark):
    """Every fingerprint within the radius is found."""
    rnd = random.Random(4)
    base = [rnd.getrandbits(63) for _ in range(6)]
    near = [(i, b ^ sum(1 << x for x in rnd.sample(range(63), d))) for i, b in enumerate(base) for d in (0, 5, decontaminate.RADIUS)]
    index = decontaminate.multi_index(spark.createDataFrame(list(enumerate(base)), "i long, f long"), "f", exact=False)
    asked = decontaminate.multi_index(spark.createDataFrame([(n, *x) for n, x in enumerate(near)], "n long, i long, g long"), "g", exact=True).withColumnRenamed("i", "j")
    assert {r.n for r in index.join(asked, "part").where("i = j").select("n").collect()} == set(range(len(near)))


def test_mixing(spark, docs, none):
    corpus, labels = _labelled(spark)
    known = labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("junk").alias("domain"))
    rows = mixing.mixing_rates(corpus, known, {"good": 0.5, "junk": 0.5}).collect()
    total = sum(r.n_words for r in rows)
    for d in ("good", "junk"):
        assert abs(sum(r.rate * r.n_words * r[f"p_{d}"] for r in rows) / total - 0.5) < 0.01
    assert all(r.rate >= 0 and abs(r.p_good + r.p_junk - 1) < 1e-9 for r in rows)
    out = mixing.mix(docs, known, {"good": 0.9, "junk": 0.1})
    assert out.count() == docs.count() and out.where("rate is null").count() == 0 and out.columns == docs.columns[:-2] + ["hi", "rate"] or "rate" in out.columns
    assert mixing.mix(none, known, {"good": 1.0}).count() == 0
    assert {r.rate for r in mixing.mix(docs, known.limit(0), {"good": 1.0}).collect()} == {1.0}


def test_rare_domains(spark):
    """Rates are at the optimum, which hard posteriors give in closed form, however rare a domain is."""
    shares, targets, ridge = [0.8, 0.15, 0.04, 0.009, 0.001], [0.55, 0.18, 0.16, 0.09, 0.02], 0.001
    rows = [(i, int(1e6 * w), [float(i == j) for j in range(5)]) for i, w in enumerate(shares)]
    got = mixing.solve_rates(spark.createDataFrame(rows, "doc_id long, n_words long, p array<double>"), targets, ridge, 100, 1e-5).collect()
    for r in got:
        w, t = shares[r.doc_id], targets[r.doc_id]
        assert abs(r.rate - (t + ridge) / (w + ridge)) < 0.01


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(6)
    item = _prose(25, rnd)
    rows = [(i, _prose(rnd.randint(40, 80), rnd), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s", 0) for i in range(5)] + [(200, _prose(20, rnd) + " " + item + " " + _prose(20, rnd), "en", "s", 0), (201, "short", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == list(range(60)) and all(r.rate >= 0 for r in out)


def test_pipeline_stages_leave_no_tables(spark, docs):
    """What a stage wrote on its way is gone when its result can be read, so that the next one has the disk."""
    import os

    import corpus_pipeline
    from gridloom.llm.util import materialize, shared_dir

    def tables():
        top = shared_dir(spark).removeprefix("file:") + "/gridloom"
        return set(os.listdir(top)) if os.path.isdir(top) else set()

    for stage, most in ((corpus_pipeline.lines, 2), (corpus_pipeline.copies, 1)):
        before = tables()
        out = stage(spark, docs, "")
        assert len(tables() - before) <= most and out.count() > 0
    mine = materialize(docs.select("doc_id"), "mine")
    assert mine.count() == docs.count()


def test_materialize_leaves_no_shuffle_files(spark):
    """A table's shuffle files go with its write, before the driver collects any garbage; the setting is as before."""
    def blocks():
        return {b for b in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}

    before, told = blocks(), spark.conf.get(util.CLEAN_UP, None)
    table = util.materialize(spark.range(20000).repartition(4, "id").groupBy((F.col("id") % 500).alias("k")).count())
    end = time.time() + 5
    while blocks() - before and time.time() < end:
        time.sleep(0.1)
    assert not blocks() - before and table.count() == 500 and spark.conf.get(util.CLEAN_UP, None) == told


def test_pipeline_lines_whatever_the_caps(spark, monkeypatch):
    """The stage lines removes a linked line that only the complete round can find."""
    import corpus_pipeline

    for name, value in (("AGREE", 25), ("CLOSE", 25), ("NEAR", 1)):
        monkeypatch.setattr(line_dedup, name, value)
    base = _prose(40, random.Random(31)).split()
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(["first", *base[1:]]), _prose(30, random.Random(32))]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    assert _jaccard_lines(*texts[:2]) > 0.8 and _jaccard_lines(texts[0], texts[2]) > 0.8
    assert sorted(r.doc_id for r in corpus_pipeline.lines(spark, docs, "").collect()) == [0, 3]


def test_python_workers_get_texts_by_bytes(spark, monkeypatch):
    def held(real, *columns):
        def run(batches):
            def watched():
                for batch in batches:
                    got = sum(batch[c].str.len().sum() for c in columns)
                    assert len(batch) == 1 or got <= 8 << 20, got
                    yield batch

            return real(watched())

        return run

    for module, name, *columns in ((quality_rules, "_measure", "text"), (ngram_join, "_blobs", "text")):
        monkeypatch.setattr(module, name, held(getattr(module, name), *columns))
    for name, *columns in (("_count", "text"), ("_prefixes", "text"), ("_verify", "blob_a", "blob_b")):
        monkeypatch.setattr(ngram_join, name, lambda *a, make=getattr(ngram_join, name), columns=columns: held(make(*a), *columns))
    rnd = random.Random(3)
    texts = [_prose(90_000, rnd) for _ in range(20)]
    docs = spark.createDataFrame([(i, t + " end" * (i % 2)) for i, t in enumerate(2 * texts)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert quality_rules.quality_rules(docs, labels).count() == 40
    assert [r.component_id for r in ngram_join.ngram_join(docs).orderBy("doc_id").collect()] == [*range(20), *range(20)]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
