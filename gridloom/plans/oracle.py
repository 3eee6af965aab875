"""SQL for DuckDB that gives what the catalogue's queries give, written independently of the column functions."""

from __future__ import annotations

from gridloom.plans import surface

_G2 = "(SELECT l_partkey % 256 AS x, l_suppkey % 256 AS y FROM lineitem)"
_G3 = "(SELECT l_partkey % 64 AS x, l_suppkey % 64 AS y, CAST(l_quantity AS BIGINT) % 64 AS z FROM lineitem)"
_EV = "(SELECT event_id, event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events)"


def _weave(cols: list[str], k: int) -> str:
    n = len(cols)
    return "(" + " | ".join(f"((({c} >> {b}) & 1) << {n * b + i})" for b in range(k) for i, c in enumerate(cols)) + ")"


def _pick(d: str, n: int, i: int, k: int) -> str:
    return "(" + " | ".join(f"((({d} >> {n * b + i}) & 1) << {b})" for b in range(k)) + ")"


def _prefix_xor(source: str, column: str) -> str:
    for s in (32, 16, 8, 4, 2, 1):
        source = f"(SELECT * REPLACE (xor({column}, {column} >> {s}) AS {column}) FROM {source})"
    return source


def _hilbert2(source: str, k: int) -> str:
    """source has x and y; adds d."""
    top = (1 << k) - 1
    source = f"(SELECT *, x AS hx, y AS hy, CAST(0 AS BIGINT) AS d FROM {source})"
    for b in range(k - 1, -1, -1):
        rx, ry = f"((hx >> {b}) & 1)", f"((hy >> {b}) & 1)"
        source = f"(SELECT * REPLACE (CASE WHEN {ry} = 0 THEN CASE WHEN {rx} = 1 THEN {top} - hy ELSE hy END ELSE hx END AS hx, CASE WHEN {ry} = 0 THEN CASE WHEN {rx} = 1 THEN {top} - hx ELSE hx END ELSE hy END AS hy, d + (xor(3 * {rx}, {ry}) << {2 * b}) AS d) FROM {source})"
    return source


def _hilbert2_back(source: str, k: int) -> str:
    """source has d; adds x and y."""
    source = f"(SELECT *, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y FROM {source})"
    for b in range(k):
        s = 1 << b
        rx = f"((d >> {2 * b + 1}) & 1)"
        ry = f"xor((d >> {2 * b}) & 1, {rx})"
        source = f"(SELECT * REPLACE ({s} * {rx} + CASE WHEN {ry} = 0 THEN CASE WHEN {rx} = 1 THEN {s - 1} - y ELSE y END ELSE x END AS x, {s} * {ry} + CASE WHEN {ry} = 0 THEN CASE WHEN {rx} = 1 THEN {s - 1} - x ELSE x END ELSE y END AS y) FROM {source})"
    return source


def _turns(source: str, levels: range, axes: range) -> str:
    """Exchange steps on columns h0, h1, h2."""
    for b in levels:
        q, p = 1 << b, (1 << b) - 1
        for i in axes:
            if i == 0:
                change = f"CASE WHEN h0 & {q} <> 0 THEN xor(h0, {p}) ELSE h0 END AS h0"
            else:
                t = f"(xor(h0, h{i}) & {p})"
                change = f"CASE WHEN h{i} & {q} <> 0 THEN xor(h0, {p}) ELSE xor(h0, {t}) END AS h0, CASE WHEN h{i} & {q} <> 0 THEN h{i} ELSE xor(h{i}, {t}) END AS h{i}"
            source = f"(SELECT * REPLACE ({change}) FROM {source})"
    return source


def _hilbert3(source: str, k: int) -> str:
    source = _turns(f"(SELECT *, x AS h0, y AS h1, z AS h2 FROM {source})", range(k - 1, 0, -1), range(3))
    source = f"(SELECT * REPLACE (xor(h0, h1) AS h1, xor(xor(h0, h1), h2) AS h2) FROM {source})"
    t = "CAST(0 AS BIGINT)"
    for b in range(k - 1, 0, -1):
        t = f"xor({t}, CASE WHEN h2 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    source = f"(SELECT *, {t} AS ht FROM {source})"
    source = f"(SELECT * REPLACE (xor(h0, ht) AS h0, xor(h1, ht) AS h1, xor(h2, ht) AS h2) FROM {source})"
    return f"(SELECT *, {_weave(['h2', 'h1', 'h0'], k)} AS d FROM {source})"


def _hilbert3_back(source: str, k: int) -> str:
    source = f"(SELECT *, {_pick('d', 3, 2, k)} AS h0, {_pick('d', 3, 1, k)} AS h1, {_pick('d', 3, 0, k)} AS h2 FROM {source})"
    source = f"(SELECT * REPLACE (xor(h0, h2 >> 1) AS h0, xor(h1, h0) AS h1, xor(h2, h1) AS h2) FROM {source})"
    return f"(SELECT *, h0 AS x, h1 AS y, h2 AS z FROM {_turns(source, range(1, k), range(2, -1, -1))})"


def forward(name: str, source: str, n: int, k: int) -> str:
    """A source with coordinates, with d added."""
    axes = ["x", "y", "z"][:n]
    if name == "raster":
        return f"(SELECT *, {' + '.join(f'{a} * {1 << (k * i)}' for i, a in enumerate(axes))} AS d FROM {source})"
    if name == "hilbert":
        return _hilbert2(source, k) if n == 2 else _hilbert3(source, k)
    woven = f"(SELECT *, {_weave(axes, k)} AS d FROM {source})"
    if name == "gray":
        return f"(SELECT * REPLACE (xor(d, d >> 1) AS d) FROM {woven})"
    return _prefix_xor(woven, "d") if name == "gray_canonical" else woven


def inverse(name: str, source: str, n: int, k: int) -> str:
    """A source with d, with coordinates added."""
    axes = ["x", "y", "z"][:n]
    if name == "raster":
        return f"(SELECT *, {', '.join(f'(d // {1 << (k * i)}) % {1 << k} AS {a}' for i, a in enumerate(axes))} FROM {source})"
    if name == "hilbert":
        return _hilbert2_back(source, k) if n == 2 else _hilbert3_back(source, k)
    inner = f"(SELECT *, d AS m FROM {source})"
    if name == "gray":
        inner = _prefix_xor(inner, "m")
    if name == "gray_canonical":
        inner = f"(SELECT * REPLACE (xor(m, m >> 1) AS m) FROM {inner})"
    return f"(SELECT *, {', '.join(f'{_pick('m', n, i, k)} AS {a}' for i, a in enumerate(axes))} FROM {inner})"


def _cells(side: int) -> str:
    return f"(SELECT a.range AS x, b.range AS y FROM range({side}) a, range({side}) b)"


_PAIR_NORM = 255 * 254 / 2


def _metric_sql(metric: str, name: str) -> str:
    points = forward(name, _cells(16), 2, 4)
    if metric == "clusters":
        windows = f"(SELECT w.x AS wx, w.y AS wy, w.x + o.x AS x, w.y + o.y AS y FROM {_cells(13)} w, {_cells(4)} o)"
        placed = forward(name, windows, 2, 4)
        return f"WITH p AS (SELECT wx, wy, d FROM {placed}), s AS (SELECT wx, wy, CASE WHEN d - lag(d) OVER (PARTITION BY wx, wy ORDER BY d) = 1 THEN 0 ELSE 1 END AS st FROM p), c AS (SELECT CAST(sum(st) AS BIGINT) AS key FROM s GROUP BY wx, wy) SELECT key, count(*) AS regions, round(count(*) / 169.0, 9) AS normalised FROM c GROUP BY key"
    if metric in ("ratio", "ratio_exact"):
        norm = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
        norm = norm if metric == "ratio_exact" else f"floor({norm})"
        return f"WITH p AS (SELECT x, y, d FROM {points}) SELECT CAST(floor(CAST(1000.0 AS DOUBLE) * (b.d - a.d) / {norm}) AS BIGINT) AS key, count(*) AS regions, round(count(*) / CAST({_PAIR_NORM} AS DOUBLE), 9) AS normalised FROM p a JOIN p b ON a.d < b.d GROUP BY key"
    if metric == "bbox":
        return f"WITH p AS (SELECT x, y, d FROM {points}), w AS (SELECT a.d AS i, b.d AS j, (max(b.x) OVER v - min(b.x) OVER v + 1) * (max(b.y) OVER v - min(b.y) OVER v + 1) AS area FROM p a JOIN p b ON a.d <= b.d WINDOW v AS (PARTITION BY a.d ORDER BY b.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT area, j - i AS gap, count(*) AS regions, round(count(*) / CAST({_PAIR_NORM} AS DOUBLE), 9) AS normalised FROM w WHERE j > i GROUP BY ALL"
    base = "c.d" if metric == "gridedges_corrected" else "c.x + c.y * 15"
    return f"WITH p AS (SELECT x, y, d FROM {points}), e AS (SELECT abs(q.d - ({base})) AS key FROM p c JOIN p q ON (abs(q.x - c.x) + abs(q.y - c.y)) = 1 WHERE c.x < 15 AND c.y < 15) SELECT key, count(*) AS regions, round(count(*) / CAST({_PAIR_NORM} AS DOUBLE), 9) AS normalised FROM e GROUP BY key"


_INV2 = "(SELECT (l_orderkey * 31 + l_partkey) % 65536 AS d FROM lineitem)"
_INV3 = "(SELECT (l_orderkey * 31 + l_partkey) % 262144 AS d FROM lineitem)"


def _dist(norm: str) -> str:
    dx, dy = "abs(x - px)", "abs(y - py)"
    value = {"l1": f"{dx} + {dy}", "l2": f"round(sqrt({dx} * {dx} + {dy} * {dy}), 6)", "linf": f"greatest({dx}, {dy})", "l2_trunc": f"CAST(floor(sqrt({dx} * {dx} + {dy} * {dy})) AS BIGINT)"}[norm]
    return f"WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS x, l_suppkey % 256 AS y, lag(l_partkey % 256) OVER w AS px, lag(l_suppkey % 256) OVER w AS py FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) SELECT l_orderkey, l_linenumber, {value} AS dist FROM p WHERE px IS NOT NULL"


_DESCRIBE = "count(*) AS count, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std, min({v}) AS min, round(quantile_cont({v}, 0.25), 4) AS p25, round(quantile_cont({v}, 0.5), 4) AS p50, round(quantile_cont({v}, 0.75), 4) AS p75, max({v}) AS max"


def _entropy(by: str, expression: str) -> str:
    return f"WITH c AS (SELECT {expression}, v, count(*) AS c FROM {_EV} GROUP BY ALL), t AS (SELECT {by}, CAST(sum(c) AS BIGINT) AS n, count(*) AS symbols, sum(c * ln(c)) AS s FROM c GROUP BY {by}) SELECT {by}, n, symbols, round((ln(n) - s / n) / ln(65536), 6) AS entropy FROM t"


_CONFIGS = """(SELECT sfc, compression, bwt, bitshuffle, concat_ws('-', sfc, compression, CASE WHEN bwt THEN 'bwt' END, CASE WHEN bitshuffle THEN 'btr' END) AS name
 FROM (VALUES ('raster'), ('morton'), ('gray'), ('hilbert')) s(sfc), (VALUES ('none'), ('rle'), ('huffman'), ('lz77'), ('lzw'), ('gzip'), ('bzip2'), ('lz4'), ('lzo')) c(compression),
 (VALUES (false), (true)) b(bwt), (VALUES (false), (true)) t(bitshuffle) WHERE NOT bwt OR compression IN ('none', 'lz77', 'lzw', 'lz4'))"""
_RUNS = f"""(SELECT 'tile' || n_nationkey AS filename, sfc, compression, bwt, bitshuffle, CAST(n_nationkey AS BIGINT) * 1000 + length(name) * 7 AS size, CAST(n_nationkey AS BIGINT) * 7 + length(name) * 13 AS runtime_compress,
 CASE WHEN n_nationkey % 7 <> 3 THEN CAST(n_nationkey AS BIGINT) * 5 + length(name) * 11 END AS runtime_decompress FROM nation, {_CONFIGS})"""
_SUMMED = f"""(SELECT r.filename, r.sfc, r.compression, r.bwt, r.bitshuffle, r.size,
 CASE WHEN r.compression IN ('gzip', 'bzip2', 'lz4', 'lzo') THEN r.runtime_compress + b.runtime_compress ELSE r.runtime_compress END AS runtime_compress,
 CASE WHEN r.compression IN ('gzip', 'bzip2', 'lz4', 'lzo') THEN r.runtime_decompress + b.runtime_decompress ELSE r.runtime_decompress END AS runtime_decompress
 FROM {_RUNS} r LEFT JOIN {_RUNS} b ON b.compression = 'none' AND b.filename = r.filename AND b.sfc = r.sfc AND b.bwt = r.bwt AND b.bitshuffle = r.bitshuffle)"""
_FULL = "(SELECT DISTINCT event_id // 1024 AS a FROM events)"
_TAIL = f"(SELECT event_id, v FROM {_EV} WHERE event_id >= (SELECT count(*) - count(*) % 16 FROM events))"
_PLANES = f"(SELECT event_id, event_id // 16 AS block, v FROM {_EV} WHERE event_id // 16 IN (SELECT event_id // 16 FROM events GROUP BY 1 HAVING count(*) = 16))"


def oracle_sql() -> dict[str, str]:
    out = {"morton_cells": f"SELECT {_weave(['x', 'y'], 8)} >> 8 AS cell, count(*) AS n, CAST(sum(q) AS BIGINT) AS quantity FROM (SELECT l_partkey % 256 AS x, l_suppkey % 256 AS y, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY cell"}
    for name in ("raster", "morton", "gray", "hilbert"):
        out[f"{name}2_fwd"] = f"SELECT x, y, d FROM {forward(name, _G2, 2, 8)}"
        out[f"{name}3_fwd"] = f"SELECT x, y, z, d FROM {forward(name, _G3, 3, 6)}"
        out[f"{name}2_inv"] = f"SELECT d, x, y FROM {inverse(name, _INV2, 2, 8)}"
        out[f"{name}3_inv"] = f"SELECT d, x, y, z FROM {inverse(name, _INV3, 3, 6)}"
        for metric in ("clusters", "ratio", "ratio_exact", "bbox", "gridedges", "gridedges_corrected"):
            out[f"metric_{metric}_{name}"] = _metric_sql(metric, name)
    out["gray2_canonical"] = f"SELECT x, y, d FROM {forward('gray_canonical', _G2, 2, 8)}"
    out["gray2_canonical_inv"] = f"SELECT d, x, y FROM {inverse('gray_canonical', _INV2, 2, 8)}"
    out["curve_walk"] = " UNION ALL ".join(f"SELECT '{name}' AS curve, d, x, y FROM {inverse(name, '(SELECT range AS d FROM range(4096))', 2, 6)}" for name in ("raster", "morton", "gray", "hilbert"))
    out["bounds_filter"] = f"SELECT x, y, CASE WHEN x < 256 AND y < 256 THEN {_weave(['x', 'y'], 8)} END AS d FROM (SELECT l_partkey % 300 AS x, l_suppkey % 300 AS y FROM lineitem)"
    for norm in ("l1", "l2", "linf", "l2_trunc"):
        out[f"dist_{norm}"] = _dist(norm)
    out["box_contains"] = f"SELECT x, y FROM {_G2} WHERE x BETWEEN 40 AND 200 AND y BETWEEN 20 AND 90"
    out["box_bounds_area"] = "WITH b AS (SELECT l_orderkey, min(l_partkey % 256) AS x0, min(l_suppkey % 256) AS y0, max(l_partkey % 256) AS x1, max(l_suppkey % 256) AS y1 FROM lineitem GROUP BY l_orderkey) SELECT *, (x1 - x0 + 1) * (y1 - y0 + 1) AS area FROM b"
    out["cmp_all_components"] = f"SELECT x, y, x < 128 AND y < 64 AS lt, x <= 128 AND y <= 64 AS le, x > 128 AND y > 64 AS gt, x >= 128 AND y >= 64 AS ge, x + 1 AS mx, y - 1 AS my FROM {_G2}"
    out["pow2_checks"] = "SELECT p_partkey, bit_count(v) = 1 AS is_pow2, CASE WHEN bit_count(v) = 1 THEN CAST(length(bin(v)) - 1 AS BIGINT) END AS log2, CAST(length(bin(v)) AS BIGINT) AS bits, CASE WHEN bit_count(v) = 1 THEN v ELSE CAST(1 AS BIGINT) << length(bin(v)) END AS next_pow2, v * v * v AS cube, v % 4 = 0 AS by_four FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS v FROM part)"
    out["islands_from_values"] = "WITH u AS (SELECT DISTINCT l_suppkey, l_partkey % 512 AS v FROM lineitem), r AS (SELECT *, v - row_number() OVER (PARTITION BY l_suppkey ORDER BY v) AS g FROM u) SELECT l_suppkey, min(v) AS lo, max(v) AS hi FROM r GROUP BY l_suppkey, g"
    out["interval_merge"] = "WITH s AS (SELECT l_suppkey, l_partkey % 4096 AS lo, l_partkey % 4096 + CAST(l_quantity AS BIGINT) AS hi FROM lineitem), m AS (SELECT *, max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), n AS (SELECT *, CASE WHEN reach IS NULL OR lo > reach + 1 THEN 1 ELSE 0 END AS fresh FROM m), g AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM n) SELECT l_suppkey, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY l_suppkey, g"
    out["box_to_ranges"] = f"WITH c AS (SELECT d FROM {forward('hilbert', '(SELECT a.range AS x, b.range AS y FROM range(3, 18) a, range(5, 12) b)', 2, 5)}), r AS (SELECT d, d - row_number() OVER (ORDER BY d) AS g FROM c) SELECT min(d) AS lo, max(d) AS hi FROM r GROUP BY g"
    out["value_histogram"] = f"SELECT v, count(*) AS n FROM {_EV} GROUP BY v"
    out["describe_values"] = f"SELECT event_type, {_DESCRIBE.format(v='v')} FROM {_EV} GROUP BY event_type"
    out["describe_diffs"] = f"WITH d AS (SELECT event_type, v - lag(v) OVER (PARTITION BY event_type ORDER BY event_id) AS diff FROM {_EV}) SELECT event_type, {_DESCRIBE.format(v='diff')} FROM d WHERE diff IS NOT NULL GROUP BY event_type"
    out["entropy_by_type"] = _entropy("event_type", "event_type")
    out["block_entropy"] = _entropy("block", "event_id // 1000 AS block")
    out["rle_runs"] = "WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM c) SELECT user_id, event_type, min(event_id) AS start, count(*) AS n FROM g GROUP BY user_id, g, event_type"
    out["rle_runs_capped"] = "WITH s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey), p AS (SELECT l_suppkey, n, unnest(range(0, (n - 1) // 40 + 1)) AS piece FROM s) SELECT l_suppkey, CAST(piece AS INT) AS piece, least(40, n - piece * 40) AS n FROM p"
    out["bitplane_events"] = f"SELECT CAST(b.range AS INT) AS plane, block, CAST(sum(((v >> b.range) & 1) << (event_id % 16)) AS BIGINT) AS word FROM {_PLANES}, range(16) b GROUP BY ALL UNION ALL SELECT -1, event_id, v FROM {_TAIL}"
    out["bitplane_inverse"] = f"SELECT event_id AS pos, v & 65535 AS value FROM {_PLANES} UNION ALL SELECT event_id, v FROM {_TAIL}"
    moved = forward("hilbert", inverse("morton", f"(SELECT event_id // 4096 AS a, event_id % 4096 AS d, v FROM {_EV})", 2, 6).replace("SELECT *, d AS m", "SELECT * EXCLUDE (d), d AS m"), 2, 6)
    out["reorder_morton_to_hilbert"] = f"SELECT a, d AS pos, v FROM {moved}"
    out["reorder_layout_checksum"] = f"SELECT count(*) AS n, CAST(sum(d) AS BIGINT) AS sum_d, max(d) AS max_d, CAST(sum(d * x) AS BIGINT) AS sum_dx FROM {forward('morton', _G2, 2, 8)}"
    for codec in ("rle", "huffman", "lz77", "lzw", "bwt", "bzip_lz77", "bzip_lzw", "gzip", "bzip2"):
        out[f"roundtrip_{codec}"] = "SELECT doc_id, CAST(octet_length(encode(text)) + octet_length(encode(text)) % 2 AS BIGINT) AS n_bytes, true AS ok FROM documents"
    out["huffman_freq"] = "SELECT doc_id, byte, count(*) AS n FROM (SELECT doc_id, CAST((instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1 AS INT) AS byte FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents)) GROUP BY ALL"
    out["array_pipeline"] = f"SELECT 'array-' || a AS path, CAST(2048 AS BIGINT) AS n_bytes, true AS ok FROM {_FULL}"
    out["array_headers"] = f"SELECT 'array-' || a AS path, 2 AS ndims, 5 AS k, 2 AS dtype_nbytes, 'ROW_MAJOR' AS sfc, false AS bittransposed, 'NONE' AS compression, CAST(2048 AS BIGINT) AS payload_bytes, true AS consistent FROM {_FULL}"
    out["array_tiles"] = "SELECT count(*) AS tiles, CAST(sum(a.range) AS BIGINT) AS s0, CAST(sum(b.range) AS BIGINT) AS s1, CAST(sum(c.range) AS BIGINT) AS s2 FROM range(0, 896, 128) a, range(0, 3968, 128) b, range(0, 416, 128) c"
    out["config_matrix"] = "SELECT 'tile' || n_nationkey AS filename, sfc, codec, bitshuffle FROM nation, (VALUES ('raster'), ('morton'), ('gray'), ('hilbert')) s(sfc), (VALUES ('none'), ('rle'), ('huffman'), ('lz77'), ('lzw'), ('bwt'), ('bzip_lz77'), ('bzip_lzw')) c(codec), (VALUES (false), (true)) t(bitshuffle)"
    out["valid_configs"] = f"SELECT sfc, compression, bwt, bitshuffle, name, CASE WHEN compression IN ('gzip', 'bzip2', 'lz4', 'lzo') THEN concat_ws('-', sfc, 'none', CASE WHEN bwt THEN 'bwt' END, CASE WHEN bitshuffle THEN 'btr' END) WHEN name <> 'raster-none' THEN 'raster-none' END AS parent FROM {_CONFIGS}"
    out["parse_filename"] = "SELECT p_partkey, 'tile' || p_partkey AS filename, (['raster', 'morton', 'gray', 'hilbert'])[p_partkey % 4 + 1] AS sfc, (['none', 'rle', 'huffman', 'lzw', 'gzip'])[p_partkey % 5 + 1] AS compression, p_partkey % 5 = 3 AS bwt, p_partkey % 3 = 1 AS bitshuffle FROM part"
    out["runs_joined"] = f"SELECT * FROM {_RUNS}"
    out["runs_external_sum"] = f"SELECT * FROM {_SUMMED}"
    out["runs_relative"] = f"WITH r AS (SELECT * FROM {_SUMMED}) SELECT r.*, r.runtime_compress - b.runtime_compress AS relative_compress, r.runtime_decompress - b.runtime_decompress AS relative_decompress FROM r LEFT JOIN r b ON b.compression = 'none' AND b.filename = r.filename AND CASE WHEN r.compression <> 'none' THEN b.sfc = r.sfc AND b.bwt = r.bwt AND b.bitshuffle = r.bitshuffle ELSE b.sfc = 'raster' AND NOT b.bwt AND NOT b.bitshuffle END"
    out["runs_incomplete"] = f"SELECT filename, count(*) AS n FROM {_RUNS} WHERE runtime_decompress IS NULL GROUP BY filename"
    out["stats_upsert"] = "SELECT c_custkey, c_nationkey, round(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 2) AS value FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0"
    out["ignore_list"] = f"SELECT filename, sfc, compression, bwt, bitshuffle, size FROM {_RUNS} r WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 5 = 0 AND 'tile' || n_nationkey = r.filename)"
    out["config_summary"] = f"SELECT sfc, compression, bitshuffle, bwt, filename, count(*) AS n FROM {_RUNS} GROUP BY GROUPING SETS ((sfc), (compression), (bitshuffle), (bwt), (filename), (sfc, compression, bwt, bitshuffle))"
    out["config_anomalies"] = f"SELECT sfc, compression, bwt, bitshuffle, count(*) AS n FROM {_RUNS} WHERE NOT (sfc = 'gray' AND filename = 'tile3') GROUP BY ALL HAVING count(*) <> 25"
    out["events_cell_windows"] = f"SELECT date_trunc('day', ts) AS start, {_weave(['(user_id % 64)', '(event_id % 64)'], 6)} >> 6 AS cell, count(*) AS n FROM events GROUP BY ALL"
    out["metric_file"] = f'SELECT key AS "Clusters", regions AS "Regions", normalised AS "Normalised" FROM ({out["metric_clusters_hilbert"]})'
    out["sql_walks"] = f"SELECT *, d AS back FROM ({out['curve_walk']})"
    return out | surface.SQL
