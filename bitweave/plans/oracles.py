"""The raster queries as DuckDB SQL, stated another way than the engine does.

Lines are lists with mirrored indices instead of windows, blocks come from a
table of places, and words from lists of coefficients instead of matrices.
"""

from __future__ import annotations

from bitweave.plans.queries import ACROSS, CHANGES, SETTINGS, SIZE, SLICE, WIDE

# Fixed values, as the format defines them; written here on their own, so that a slip in the coder's tables shows.
WEIGHTS = (3, 3, 3, 2, 2, 2, 1, 1, 1, 0)
CODES = """codes AS (SELECT len, option, CAST(unnest(range(0, len(string_split(all_codes, ' ')))) AS INTEGER) AS sym, unnest(string_split(all_codes, ' ')) AS code FROM (VALUES
  (2, 0, '1 01 001 000'),
  (3, 0, '1 01 001 00000 00001 00010 000110 000111'),
  (3, 1, '10 11 010 011 0010 0011 0000 0001'),
  (4, 0, '1 01 001 0001 0000000 0000001 0000010 0000011 00001000 00001001 00001010 00001011 00001100 00001101 00001110 00001111'),
  (4, 1, '10 11 010 011 0010 0011 000000 000001 000010 000011 000100 000101 0001100 0001101 0001110 0001111'),
  (4, 2, '100 101 110 111 0100 0101 0110 0111 00100 00101 00110 00111 00000 00001 00010 00011')) t(len, option, all_codes))"""
#: The words of each length and kind of word, in the order of their symbols.
SYMBOLS = """symbols AS (SELECT len, map, unnest(string_split(all_words, ' ')) AS bits, CAST(unnest(range(0, len(string_split(all_words, ' ')))) AS INTEGER) AS sym FROM (VALUES
  (2, 'any', '00 10 01 11'),
  (3, 'any', '010 000 100 110 001 011 101 111'),
  (3, 'tran_D', '010 100 110 001 011 101 111'),
  (4, 'any', '1000 0001 0100 0010 1100 0101 0011 1010 1001 0110 0000 1110 0111 1011 1101 1111'),
  (4, 'types_H', '1000 0001 0100 0010 1100 0101 0011 1010 1001 0110 1110 0111 1011 1101 1111'),
  (4, 'tran_H', '1000 0001 0100 0010 1100 0101 0011 1010 1001 0110 1110 0111 1011 1101 1111')) t(len, map, all_words))"""
#: Of each place in a block: subband, blocks' step in the subband, row and column in the step.
PLACES = """places AS (SELECT i, CASE WHEN i < 4 THEN i WHEN i < 16 THEN 3 + i // 4 ELSE 6 + i // 16 END AS sb, CASE WHEN i < 4 THEN 1 WHEN i < 16 THEN 2 ELSE 4 END AS s,
  CASE WHEN i < 4 THEN 0 WHEN i < 16 THEN i // 2 % 2 ELSE i // 8 % 2 * 2 + i // 2 % 2 END AS a, CASE WHEN i < 4 THEN 0 WHEN i < 16 THEN i % 2 ELSE i // 4 % 2 * 2 + i % 2 END AS b FROM (SELECT unnest(range(0, 64)) AS i))"""
_SB = [k if k < 4 else 3 + k // 4 if k < 16 else 6 + k // 16 for k in range(64)]

IMG = "img AS (SELECT vec_id AS y, CAST(i - 1 AS BIGINT) AS x, CAST(floor(CAST(embedding[i] AS DOUBLE) * 4096) AS BIGINT) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"
PAD = "pad AS (SELECT p.y, img.x, img.v FROM (SELECT unnest(range(0, (SELECT (max(y) + 8) // 8 * 8 FROM img))) AS y) p JOIN img ON img.y = least(p.y, (SELECT max(y) FROM img)))"


def _at(k: str) -> str:
    return f"a[1 + CASE WHEN {k} < 0 THEN -({k}) WHEN {k} >= n THEN 2 * (n - 1) - ({k}) ELSE {k} END]"


def _lines(name: str, source: str, key: str, pos: str) -> str:
    """CTEs name_1 (lists), name_2 (with high-pass h) and name (with low-pass l) of lines."""
    pair = f"{_at('2*j')} + {_at('2*j+2')}"
    high = f"a[2*j+2] - (({pair} + (({pair} - {_at('2*j-2')} - {_at('2*j+4')}) >> 3) + 1) >> 1)"
    low = "a[2*j+1] - ((2 - h[greatest(j, 1)] - h[j+1]) >> 2)"
    return f"""{name}_1 AS (SELECT {key}, list(v ORDER BY {pos}) AS a, count(*) AS n FROM {source} GROUP BY ALL),
{name}_2 AS (SELECT *, [{high} FOR j IN range(0, n // 2)] AS h FROM {name}_1),
{name} AS (SELECT *, [{low} FOR j IN range(0, n // 2)] AS l FROM {name}_2)"""


def _level(name: str, source: str) -> str:
    return f"""{_lines(name + 'h', source, 'y', 'x')},
{name}c AS (SELECT 0 AS kx, i - 1 AS c, y, l[i] AS v FROM {name}h, (SELECT unnest(range(1, 1 + (SELECT max(n) // 2 FROM {name}h))) AS i)
  UNION ALL SELECT 1, i - 1, y, h[i] FROM {name}h, (SELECT unnest(range(1, 1 + (SELECT max(n) // 2 FROM {name}h))) AS i)),
{_lines(name + 'v', name + 'c', 'kx, c', 'y')},
{name} AS (SELECT kx, 0 AS ky, i - 1 AS r, c, l[i] AS v FROM {name}v, (SELECT unnest(range(1, 1 + (SELECT max(n) // 2 FROM {name}v))) AS i)
  UNION ALL SELECT kx, 1, i - 1, c, h[i] FROM {name}v, (SELECT unnest(range(1, 1 + (SELECT max(n) // 2 FROM {name}v))) AS i))"""


def _low(name: str, level: str) -> str:
    return f"{name} AS (SELECT r AS y, c AS x, v FROM {level} WHERE kx = 0 AND ky = 0)"


LEVELS = ",\n".join([IMG, PAD, _level("w1", "pad"), _low("s1", "w1"), _level("w2", "s1"), _low("s2", "w2"), _level("w3", "s2")])
PLAIN = f"""{LEVELS},
plain AS (SELECT CASE WHEN kx + ky = 0 THEN 0 ELSE kx + 2 * ky END AS sb, r, c, v FROM w3
  UNION ALL SELECT 3 + kx + 2 * ky, r, c, v FROM w2 WHERE kx + ky > 0 UNION ALL SELECT 6 + kx + 2 * ky, r, c, v FROM w1 WHERE kx + ky > 0)"""
WEIGHT = "[" + ", ".join(map(str, WEIGHTS)) + "][sb + 1]"
SCALED = f"{PLAIN},\nscaled AS (SELECT sb, r, c, v * CAST(2 ** {WEIGHT} AS BIGINT) AS v FROM plain)"

def _blocks(source: str) -> str:
    return f"""{PLACES},
blocks AS (SELECT k.r // p.s * (SELECT max(c) + 1 FROM {source} WHERE sb = 0) + k.c // p.s AS blk, list(k.v ORDER BY p.i) AS content
  FROM {source} k JOIN places p ON p.sb = k.sb AND k.r % p.s = p.a AND k.c % p.s = p.b GROUP BY ALL),
cut AS (SELECT blk // {SIZE} AS segment_id, blk % {SIZE} AS b, blk % {SIZE} // 16 AS gaggle, content FROM blocks)"""


def _width(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0 ELSE length(ltrim(bin(CAST({x} AS BIGINT)), '0')) END"


BLOCKS = f"{SCALED},\n{_blocks('scaled')}"


def _stats(weight: int) -> str:
    return f"""depths AS (SELECT segment_id, b, gaggle, content[1] AS dc, CAST({_width('list_max([abs(x) FOR x IN content[2:]])')} AS INTEGER) AS depth FROM cut),
seen AS (SELECT segment_id, count(*) AS size, CAST(1 + {_width('max(CASE WHEN dc < 0 THEN -1 - dc ELSE dc END)')} AS INTEGER) AS bdepth_dc, max(depth) AS bdepth_ac FROM depths GROUP BY segment_id),
stats AS (SELECT *, CAST(greatest({weight}, CASE WHEN bdepth_dc <= 3 THEN 0 WHEN bdepth_dc - (1 + bdepth_ac // 2) <= 1 THEN bdepth_dc - 3
  WHEN bdepth_dc - (1 + bdepth_ac // 2) > 10 THEN bdepth_dc - 10 ELSE 1 + bdepth_ac // 2 END) AS INTEGER) AS q FROM seen)"""


STATS = f"{BLOCKS},\n{_stats(WEIGHTS[0])}"


def _fold(name: str) -> str:
    """The difference to the previous p in the range lo to hi: its rank among all possible ones."""
    d, t = f"({name} - p)", "least(p - lo, hi - p)"
    return f"CASE WHEN p IS NULL THEN NULL WHEN abs({d}) <= {t} THEN CASE WHEN {d} >= 0 THEN 2 * {d} ELSE -2 * {d} - 1 END ELSE {t} + abs({d}) END"


DIFF = f"""{STATS},
quant AS (SELECT d.*, s.size, s.bdepth_dc, s.bdepth_ac, s.q, CAST(floor(dc / 2.0 ** q) AS BIGINT) AS dc_q, dc - CAST(floor(dc / 2.0 ** q) AS BIGINT) * CAST(2 ** q AS BIGINT) AS low,
  greatest(bdepth_dc - q, 1) AS dc_n, CAST({_width('s.bdepth_ac')} AS INTEGER) AS ac_n FROM depths d JOIN stats s USING (segment_id)),
dcd AS (SELECT a.*, p.dc_q AS p, -CAST(2 ** (a.dc_n - 1) AS BIGINT) AS lo, CAST(2 ** (a.dc_n - 1) AS BIGINT) - 1 AS hi FROM quant a LEFT JOIN quant p ON p.segment_id = a.segment_id AND p.b = a.b - 1),
acd AS (SELECT a.*, p.depth AS p, 0 AS lo, CAST(2 ** a.ac_n AS BIGINT) - 1 AS hi FROM quant a LEFT JOIN quant p ON p.segment_id = a.segment_id AND p.b = a.b - 1),
diffs AS (SELECT segment_id, b, gaggle, 'dc' AS kind, dc_n AS n, dc_q AS own, CASE WHEN dc_n > 1 THEN {_fold('dc_q')} WHEN p IS NOT NULL THEN dc_q & 1 END AS d FROM dcd
  UNION ALL SELECT segment_id, b, gaggle, 'ac', ac_n, depth, CASE WHEN ac_n > 1 THEN {_fold('depth')} WHEN p IS NOT NULL THEN depth END FROM acd WHERE bdepth_ac > 0)"""
GAGGLES = f"""{DIFF},
gag AS (SELECT segment_id, kind, gaggle, max(n) AS n, count(d) AS j, coalesce(sum(d), 0) AS total, list(d ORDER BY b) FILTER (d IS NOT NULL) AS ds, min(own) FILTER (b = 0) AS reference FROM diffs GROUP BY ALL),
sizes AS (SELECT g.*, k, coalesce(list_sum([x >> k FOR x IN ds]), 0) + j * (k + 1) AS bits FROM gag g, (SELECT unnest(range(0, 9)) AS k) WHERE k = 0 OR k <= n - 2),
best AS (SELECT segment_id, kind, gaggle, n, j, total, ds, reference, min(bits) AS bits, arg_min(k, bits * 100 + k) AS k0 FROM sizes GROUP BY ALL),
opt AS (SELECT *, CAST(CASE WHEN n = 1 OR bits >= n * j THEN -1 ELSE k0 END AS INTEGER) AS k FROM best)"""
HEUR = f"""CAST(CASE WHEN n = 1 OR j = 0 OR 64 * total >= 23 * j * 2 ** n THEN -1 WHEN 207 * j > 128 * total THEN 0
  WHEN j * 2 ** (n + 5) <= 128 * total + 49 * j THEN n - 2 ELSE greatest(0, ({_width('CAST(128 * total + 49 * j AS BIGINT) // j')}) - 8) END AS INTEGER)"""


def _plain(x: str, n: str) -> str:
    """The low n bits of x, as a string."""
    return f"CASE WHEN {n} <= 0 THEN '' ELSE right(repeat('0', 64) || bin(CAST({x} AS BIGINT) & (CAST(2 ** ({n}) AS BIGINT) - 1)), CAST({n} AS INTEGER)) END"


_KW = _width("n - 1")
RICE = f"""{GAGGLES},
coded AS (SELECT segment_id, kind, gaggle, CASE WHEN n > 1 THEN {_plain('CASE WHEN k < 0 THEN CAST(2 ** (' + _KW + ') AS BIGINT) - 1 ELSE k END', _KW)} ELSE '' END
  || CASE WHEN gaggle = 0 THEN {_plain('reference', 'n')} ELSE '' END
  || CASE WHEN k < 0 THEN coalesce(array_to_string([{_plain('x', 'n')} FOR x IN ds], ''), '')
     ELSE coalesce(array_to_string([repeat('0', CAST(x >> k AS INTEGER)) || '1' FOR x IN ds], ''), '') || coalesce(array_to_string([{_plain('x', 'k')} FOR x IN ds], ''), '') END AS bits FROM opt)"""

_W = "[" + ", ".join(str(WEIGHTS[sb]) for sb in _SB) + "]"
_CH = [list(range(5 + 4 * f, 9 + 4 * f)) for f in range(3)]  # places in lists begin with 1
_GR = [[list(range(17 + 16 * f + 4 * k, 21 + 16 * f + 4 * k)) for k in range(4)] for f in range(3)]


def _list(group) -> str:
    return "[" + ", ".join(map(str, group)) + "]"


def _count(column: str, group) -> str:
    return f"list_sum([{column}[i] FOR i IN {_list(group)}])"


def _words_sql() -> str:
    grand = [sum(g, []) for g in _GR]
    fam = [c + g for c, g in zip(_CH, grand, strict=True)]
    every = list(range(5, 65))
    fresh = lambda group: f"({_count('above', group)} = 0 AND {_count('op', group)} > 0)"
    none = lambda group: f"{_count('now', group)} = 0"
    ctes = [
        f"""pl AS (SELECT c.segment_id, c.b, c.gaggle, p AS plane, q, content[1] AS dc, [CASE WHEN x < 0 THEN 1 ELSE 0 END FOR x IN content] AS neg,
  [(abs(x) >> p) & 1 FOR x IN content] AS now, [CASE WHEN abs(x) >> (p + 1) > 0 THEN 1 ELSE 0 END FOR x IN content] AS above, [CASE WHEN w <= p THEN 1 ELSE 0 END FOR w IN {_W}] AS op
  FROM cut c JOIN stats USING (segment_id), (SELECT CAST(unnest(range(0, 64)) AS INTEGER) AS p) WHERE p < bdepth_ac)""",
        "t0 AS (SELECT *, [CASE WHEN above[i] = 0 AND op[i] = 1 THEN 1 ELSE 0 END FOR i IN range(1, 65)] AS free, " + fresh(every) + " AS b_sent FROM pl)",
        f"t1 AS (SELECT *, b_sent AND {none(every)} AS b_none FROM t0)",
        "t2 AS (SELECT *, " + ", ".join(f"NOT b_none AND {fresh(g)} AS d{f}_sent" for f, g in enumerate(fam)) + " FROM t1)",
        "t3 AS (SELECT *, " + ", ".join(f"b_none OR d{f}_sent AND {none(g)} AS d{f}_none" for f, g in enumerate(fam)) + " FROM t2)",
        "t4 AS (SELECT *, " + ", ".join(f"NOT d{f}_none AND {fresh(g)} AS g{f}_sent" for f, g in enumerate(grand)) + " FROM t3)",
        "t5 AS (SELECT *, " + ", ".join(f"d{f}_none OR g{f}_sent AND {none(g)} AS g{f}_none" for f, g in enumerate(grand)) + " FROM t4)",
        "t6 AS (SELECT *, " + ", ".join(f"NOT g{f}_none AND {fresh(g)} AS h{f}{k}_sent" for f in range(3) for k, g in enumerate(_GR[f])) + " FROM t5)",
        "t7 AS (SELECT *, " + ", ".join(f"g{f}_none OR h{f}{k}_sent AND {none(g)} AS h{f}{k}_none" for f in range(3) for k, g in enumerate(_GR[f])) + " FROM t6)",
    ]
    rows: list[tuple[int, int, str, str]] = []

    def types(stage, seq, kind, group, off):
        bits = f"array_to_string([now[i] FOR i IN {_list(group)} IF free[i] = 1], '')"
        signs = f"array_to_string([neg[i] FOR i IN {_list(group)} IF free[i] = 1 AND now[i] = 1], '')"
        rows.append((stage, seq, kind, f"CASE WHEN {off} THEN '' ELSE {bits} END"))
        rows.append((stage, seq + 1, "signs", f"CASE WHEN {off} THEN '' ELSE {signs} END"))

    def flags(stage, seq, kind, pairs):
        rows.append((stage, seq, kind, " || ".join(f"CASE WHEN {sent} THEN CASE WHEN {none(g)} THEN '0' ELSE '1' END ELSE '' END" for sent, g in pairs)))

    types(1, 0, "types_P", [2, 3, 4], "false")
    flags(2, 0, "tran_B", [("b_sent", every)])
    flags(2, 1, "tran_D", [(f"d{f}_sent", g) for f, g in enumerate(fam)])
    flags(3, 0, "tran_G", [(f"g{f}_sent", g) for f, g in enumerate(grand)])
    for f in range(3):
        types(2, 2 + 2 * f, "types_C", _CH[f], f"d{f}_none")
        flags(3, 1 + f, "tran_H", [(f"h{f}{k}_sent", g) for k, g in enumerate(_GR[f])])
        for k in range(4):
            types(3, 4 + 8 * f + 2 * k, "types_H", _GR[f][k], f"h{f}{k}_none")
    rows.append((0, 0, "dc", f"CASE WHEN plane < q AND plane >= {WEIGHTS[0]} THEN CAST((dc >> plane) & 1 AS VARCHAR) ELSE '' END"))
    rows.append((4, 0, "refinement", "array_to_string([now[i] FOR i IN range(2, 65) IF above[i] = 1 AND op[i] = 1], '')"))
    union = "\n UNION ALL ".join(f"SELECT segment_id, b, gaggle, plane, {s} AS stage, {q} AS seq, '{k}' AS kind, {x} AS bits FROM t7" for s, q, k, x in rows)
    ctes.append(f"every_word AS ({union})")
    ctes.append("words AS (SELECT * FROM every_word WHERE bits <> '')")
    return ",\n".join(ctes)


WORDS = f"{STATS},\n{_words_sql()}"
_BIN = lambda w, n: format(w, f"0{n}b")
VLC = f"""{WORDS}, {SYMBOLS}, {CODES},
sym AS (SELECT w.*, length(w.bits) AS len, s.sym FROM words w JOIN symbols s ON s.len = length(w.bits) AND s.bits = w.bits
  AND s.map = CASE WHEN length(w.bits) = 3 AND w.kind = 'tran_D' THEN 'tran_D' WHEN length(w.bits) = 4 AND w.kind IN ('types_H', 'tran_H') THEN w.kind ELSE 'any' END
  WHERE w.kind LIKE 'types%' OR w.kind LIKE 'tran%'),
cost AS (SELECT segment_id, plane, gaggle, s.len, o.option, sum(length(o.code)) AS bits, count(*) AS n FROM sym s JOIN (SELECT * FROM codes UNION ALL SELECT DISTINCT len, -1, sym, repeat('0', len) FROM codes) o ON o.len = s.len AND o.sym = s.sym GROUP BY ALL),
choice AS (SELECT segment_id, plane, gaggle, len, max(n) AS n, min(bits) AS bits, CAST(arg_min(option, bits * 10 + option) AS INTEGER) AS option FROM cost GROUP BY ALL),
first AS (SELECT segment_id, plane, gaggle, len, min(stage * 100000000 + b * 100 + seq) AS at FROM sym GROUP BY ALL),
stream AS (SELECT w.segment_id, w.plane, w.stage, w.b, w.seq,
  CASE WHEN s.sym IS NULL THEN w.bits ELSE CASE WHEN f.at IS NULL THEN '' WHEN c.option < 0 THEN repeat('1', CASE WHEN s.len = 2 THEN 1 ELSE 2 END) ELSE {_plain('c.option', 'CASE WHEN s.len = 2 THEN 1 ELSE 2 END')} END
  || coalesce(k.code, {_plain('s.sym', 's.len')}) END AS bits
  FROM words w LEFT JOIN sym s USING (segment_id, plane, gaggle, stage, b, seq) LEFT JOIN choice c ON c.segment_id = s.segment_id AND c.plane = s.plane AND c.gaggle = s.gaggle AND c.len = s.len
  LEFT JOIN first f ON f.segment_id = s.segment_id AND f.plane = s.plane AND f.gaggle = s.gaggle AND f.len = s.len AND f.at = s.stage * 100000000 + s.b * 100 + s.seq
  LEFT JOIN codes k ON k.len = s.len AND k.option = c.option AND k.sym = s.sym)"""


def _bits(condition: str = "true", numbers: str = "true") -> str:
    rice = RICE[len(STATS) :]  # after the statistics, which the words need too
    return f"""{VLC}{rice},
parts AS (SELECT segment_id, CASE kind WHEN 'dc' THEN 0 ELSE 2 END AS part, 0 AS plane, 0 AS stage, gaggle AS b, 0 AS seq, bits FROM coded WHERE {numbers}
  UNION ALL SELECT segment_id, 1, -p, 0, b, 0, CAST((content[1] >> p) & 1 AS VARCHAR) FROM cut JOIN stats USING (segment_id), (SELECT CAST(unnest(range(0, 64)) AS INTEGER) AS p) WHERE p < q AND p >= greatest(bdepth_ac, {WEIGHTS[0]})
  UNION ALL SELECT segment_id, 3, -plane, stage, b, seq, bits FROM stream WHERE {condition}),
whole AS (SELECT segment_id, string_agg(bits, '' ORDER BY part, plane, stage, b, seq) AS bits FROM parts GROUP BY segment_id)"""


def _q(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


#: Whole bytes of a string of bits.
_BLOB = lambda bits, unit=8: f"unbin(rpad({bits}, CAST((length({bits}) + {unit - 1}) // {unit} * {unit} AS INTEGER), '0'))"
_BITS = f"SELECT segment_id, CAST(length(bits) AS BIGINT) AS n_bits, md5({_BLOB('bits')}) AS digest FROM whole"
_SET = "settings(from_segment, blocks, heuristic) AS (VALUES " + ", ".join(f"(CAST({a} AS BIGINT), {b}, {str(c).lower()})" for a, b, c in SETTINGS) + ")"
_SHOWN = "SELECT segment_id, b, plane, stage, seq, bits FROM words WHERE "
_HEAD = f"""{_bits()},
img_size AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h, 1 + {_width('max(CASE WHEN v < 0 THEN -1 - v ELSE v END)')} AS depth FROM img),
file AS (SELECT s.*, segment_id = 0 AS first, segment_id = (SELECT max(segment_id) FROM stats) AS last, (length(bits) + 63) // 64 * 8 AS data, bits, i.* FROM stats s JOIN whole USING (segment_id), img_size i),
head AS (SELECT *, CASE WHEN first THEN '1' ELSE '0' END || CASE WHEN last THEN '1' ELSE '0' END || {_plain('segment_id', '8')} || {_plain('bdepth_dc', '5')} || {_plain('bdepth_ac', '5')} || '0'
  || CASE WHEN first THEN '1' ELSE '0' END || CASE WHEN first OR last AND size <> {SIZE} THEN '1' ELSE '0' END || CASE WHEN first THEN '1' ELSE '0' END
  || CASE WHEN last THEN {_plain('(8 - h % 8) % 8', '3')} || '00000' ELSE '' END
  || CASE WHEN first THEN repeat('0', 27) || '0' || '00000' || '11' || '0' || '0000' ELSE '' END
  || CASE WHEN first OR last AND size <> {SIZE} THEN {_plain('size', '20')} || '1100' ELSE '' END
  || CASE WHEN first THEN '0' || '0' || CASE WHEN depth > 16 THEN '1' ELSE '0' END || '1' || {_plain('depth', '4')} || {_plain('w', '20')} || '0' || '111' || '0' || '{"".join(_BIN(w, 2) for w in reversed(WEIGHTS))}' || repeat('0', 11) ELSE '' END AS headers FROM file),
envelope AS (SELECT *, '00' || {_plain('length(headers) // 8 + data', '62')} || {_plain('32 - length(headers) // 8', '8')} || '01011110' || '00010000' || repeat('0', 16) AS env FROM head),
bytes AS (SELECT *, CAST(32 + data AS BIGINT) AS n_bytes, rpad(env, CAST(256 - length(headers) AS INTEGER), '0') || headers AS top FROM envelope)"""
_HEX = "array_to_string([substr('0123456789ABCDEF', 1 + 8 * CAST(top[4*i+1] AS INT) + 4 * CAST(top[4*i+2] AS INT) + 2 * CAST(top[4*i+3] AS INT) + CAST(top[4*i+4] AS INT), 1) FOR i IN range(0, 64)], '')"

_SMOOTH = "img AS (SELECT y, x, y * 40 + x * 3 + (v >> 9) AS v FROM first_img)"
SMOOTH = lambda sql: sql.replace(IMG, IMG.replace("img AS", "first_img AS", 1) + ", " + _SMOOTH)
#: The wide image's channels, padded on both sides.
_WIDE = f"SELECT vec_id // {ACROSS} AS y, CAST(vec_id % {ACROSS} * 64 + i - 1 AS BIGINT) AS x, CAST(floor(CAST(embedding[i] AS DOUBLE) * 4096) AS BIGINT) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)"
_CHANNELS = ("v", "-v", "v * 3 + x")
_WIDE_IMG = lambda z: f"whole_img AS ({_WIDE}), img AS (SELECT y, x, {_CHANNELS[z]} AS v FROM whole_img WHERE x < {WIDE} AND y < (SELECT max(y) FROM whole_img))"
_WIDE_PAD = "pad AS (SELECT p.y, q.x, img.v FROM (SELECT unnest(range(0, (SELECT (max(y) + 8) // 8 * 8 FROM img))) AS y) p, (SELECT unnest(range(0, (SELECT (max(x) + 8) // 8 * 8 FROM img))) AS x) q JOIN img ON img.y = least(p.y, (SELECT max(y) FROM img)) AND img.x = least(q.x, (SELECT max(x) FROM img)))"


def _wide(ctes: str, select: str) -> str:
    """A query over each channel of the wide image."""
    one = lambda z: f"SELECT {z} AS z, * FROM ({_q(ctes.replace(IMG, _WIDE_IMG(z)).replace(PAD, _WIDE_PAD), select)})"
    return "\nUNION ALL\n".join(one(z) for z in range(3))


def _changing() -> str:
    """CTE of the segments that the changes make: segment_id, size, start, strict and heuristics."""
    from bitweave.sources.raster import STEP

    rows, size, dc, ac = [], SIZE, 1, 1
    for i in range(60):
        own = [c for at, c in CHANGES if at == i]
        for c in own:
            size, dc, ac = c.get("segment_size", size), 1 - c.get("heuristic_dc", 1 - dc), 1 - c.get("heuristic_ac", 1 - ac)
        rows.append(f"({i}, {size}, {int(bool(own) or i == 0)}, {int(dc)}, {int(ac)})")
    total = f"(SELECT (max(x) + {STEP}) // {STEP} * ((max(y) + {STEP}) // {STEP}) FROM img)"
    return f"""{IMG}, plan(segment_id, nominal, strict, dc, ac) AS (VALUES {', '.join(rows)}),
placed AS (SELECT *, CAST(sum(nominal) OVER (ORDER BY segment_id) - nominal AS BIGINT) AS start, {total} AS total FROM plan),
sized AS (SELECT *, least(nominal, total - start) AS size, start + nominal >= total AS last FROM placed WHERE start < total)"""


def _generated(width: int, height: int, channels: int, bdepth: int, seed: int = 1067) -> str:
    h = f"(z * 83492791 + y * 73856093 + x * 19349663 + {seed * 12345}) % 2147483648"
    return f"""WITH cells AS (SELECT CAST(z AS INTEGER) AS z, y, x FROM (SELECT unnest(range(0, {channels})) AS z), (SELECT unnest(range(0, {height})) AS y), (SELECT unnest(range(0, {width})) AS x)),
h0 AS (SELECT *, {h} AS h FROM cells), h1 AS (SELECT z, y, x, xor(h, h >> 13) * 1274126177 % 2147483648 AS h FROM h0), h2 AS (SELECT z, y, x, xor(h, h >> 16) * 1103515245 % 2147483648 AS h FROM h1),
n AS (SELECT *, (xor(h, h >> 15) % 1048576) / 1048576.0::DOUBLE AS noise, y * 0.173::DOUBLE + x * 0.0030679615757712823::DOUBLE AS a FROM h2)
SELECT z, y, x, CAST(floor((noise * 8 - 4 + 2 * cos(a * 3) + 2 * sin(a * 2)) * {1 << (bdepth - 4)}::DOUBLE) AS BIGINT) AS v FROM n"""


ORACLES = {
    "img_from_embeddings": _q(IMG, "SELECT y, x, v FROM img"),
    "img_padded": _q(f"{IMG}, {PAD}", "SELECT y, x, v FROM pad"),
    "img_transpose": _q(IMG, "SELECT x AS y, y AS x, v FROM img"),
    "img_slice": _q(IMG, f"SELECT y - {SLICE[0]} AS y, x - {SLICE[1]} AS x, v FROM img WHERE y >= {SLICE[0]} AND y < {SLICE[0] + SLICE[2]} AND x >= {SLICE[1]} AND x < {SLICE[1] + SLICE[3]}"),
    "img_linear": _q(IMG, "SELECT y * 64 + x AS lin, v FROM img WHERE y * 64 + x BETWEEN 1000 AND 5999"),
    "img_append": _q(IMG, "SELECT y, x, v FROM img WHERE y < 100 UNION ALL SELECT y + 100, x, v FROM img"),
    "img_meta": _q(IMG, f"SELECT max(x) + 1 AS width, max(y) + 1 AS height, 1 AS channels, CAST(1 + {_width('max(CASE WHEN v < 0 THEN -1 - v ELSE v END)')} AS INTEGER) AS bdepth, (max(x) + 8) // 8 * 8 AS padded_width, (max(y) + 8) // 8 * 8 AS padded_height, CAST((max(y) + 8) // 8 * 8 - max(y) - 1 AS INTEGER) AS pad_rows FROM img"),
    "img_generate": _generated(64, 48, 3, 12),
    "dwt1d_row": _q(f"{IMG}, {PAD}, {_lines('w', 'pad', 'y', 'x')}", "SELECT y, 0 AS high, CAST(i - 1 AS BIGINT) AS at, l[i] AS v FROM w, (SELECT unnest(range(1, 33)) AS i) UNION ALL SELECT y, 1, i - 1, h[i] FROM w, (SELECT unnest(range(1, 33)) AS i)"),
    "idwt1d_row": _q(f"{IMG}, {PAD}", "SELECT y, x, v FROM pad"),
    "dwt2d_l1": _q(f"{IMG}, {PAD}, {_level('w1', 'pad')}", "SELECT kx, ky, r, c, v FROM w1"),
    "dwt2d_l3": _q(PLAIN, "SELECT sb, r, c, v FROM plain"),
    "subband_scale": _q(SCALED, "SELECT sb, r, c, v FROM scaled"),
    "subband_unscale": _q(PLAIN, "SELECT sb, r, c, v FROM plain"),
    "idwt_roundtrip": _q(f"{IMG}, {PAD}", "SELECT y, x, v FROM pad"),
    "blocks": _q(BLOCKS, "SELECT blk, array_to_string(content, ',') AS content FROM blocks"),
    "segment_cut": _q(BLOCKS, "SELECT segment_id, count(*) AS size, max(gaggle) AS last_gaggle, max(b) AS last_block FROM cut GROUP BY segment_id"),
    "bdepth": _q(STATS, "SELECT segment_id, size, bdepth_dc, bdepth_ac, q FROM stats"),
    "block_depth": _q(STATS, "SELECT segment_id, b, gaggle, dc, depth FROM depths"),
    "quant_dc": _q(DIFF, "SELECT segment_id, b, dc_q, low FROM quant"),
    "dc_delta": _q(DIFF, "SELECT segment_id, b, CAST(d AS BIGINT) AS dc_delta FROM diffs WHERE kind = 'dc'"),
    "ac_delta": _q(DIFF, "SELECT segment_id, b, CAST(d AS BIGINT) AS ac_delta FROM diffs WHERE kind = 'ac'"),
    "reference_sample": _q(DIFF, "SELECT segment_id, dc_q AS reference_dc, depth AS reference_ac FROM quant WHERE b = 0"),
    "k_optimal": _q(GAGGLES, "SELECT segment_id, kind, gaggle, n, j AS numbers, k FROM opt"),
    "k_heuristic": _q(GAGGLES, f"SELECT segment_id, kind, gaggle, n, j AS numbers, {HEUR} AS k FROM gag"),
    "dc_bits": _q(RICE, "SELECT segment_id, gaggle, bits FROM coded WHERE kind = 'dc'"),
    "acdepth_bits": _q(RICE, "SELECT segment_id, gaggle, bits FROM coded WHERE kind = 'ac'"),
    "types_words": _q(WORDS, _SHOWN + "kind LIKE 'types%'"),
    "signs_words": _q(WORDS, _SHOWN + "kind = 'signs'"),
    "tran_words": _q(WORDS, _SHOWN + "kind LIKE 'tran%'"),
    "refinement_bits": _q(WORDS, _SHOWN + "kind = 'refinement'"),
    "stage0_dc": _q(WORDS, _SHOWN + "kind = 'dc'"),
    "additional_dc": SMOOTH(_q(STATS, f"SELECT segment_id, b, p AS plane, CAST((content[1] >> p) & 1 AS INTEGER) AS bit FROM cut JOIN stats USING (segment_id), (SELECT CAST(unnest(range(0, 64)) AS INTEGER) AS p) WHERE p < q AND p >= greatest(bdepth_ac, {WEIGHTS[0]})")),
    "smooth_roundtrip": SMOOTH(_q(IMG, "SELECT y, x, v FROM img")),
    "wide_meta": "SELECT min(width) AS width, min(height) AS height, 3 AS channels, max(bdepth) AS bdepth, min(padded_width) AS padded_width, min(padded_height) AS padded_height, min(pad_rows) AS pad_rows FROM (" + _wide(IMG, f"SELECT max(x) + 1 AS width, max(y) + 1 AS height, CAST(1 + {_width('max(CASE WHEN v < 0 THEN -1 - v ELSE v END)')} AS INTEGER) AS bdepth, (max(x) + 8) // 8 * 8 AS padded_width, (max(y) + 8) // 8 * 8 AS padded_height, CAST((max(y) + 8) // 8 * 8 - max(y) - 1 AS INTEGER) AS pad_rows FROM img") + ")",
    "wide_blocks": _wide(BLOCKS, "SELECT blk, array_to_string(content, ',') AS content FROM blocks"),
    "wide_roundtrip": _wide(IMG, "SELECT y, x, v FROM img"),
    "channel_count": "SELECT CAST(3 AS BIGINT) AS channels, true AS consistent",
    "settings_coded": _q(_changing(), "SELECT CAST(segment_id AS BIGINT) AS segment_id, CAST(size AS BIGINT) AS size, start, CAST(strict AS BIGINT) AS part2, CAST(CASE WHEN strict = 1 OR last AND size <> nominal THEN 1 ELSE 0 END AS BIGINT) AS part3, CAST(dc AS BIGINT) AS optimal_dc, CAST(ac AS BIGINT) AS optimal_ac FROM sized"),
    "settings_roundtrip": _q(IMG, "SELECT y, x, v FROM img"),
    "header_check": "SELECT 0 AS z, CAST(i AS BIGINT) AS segment_id, p AS problem FROM (VALUES (2, 'gap'), (2, 'truncated'), (3, 'marker'), (4, 'repeated')) t(i, p)",
    "bare_size": _q(_HEAD, "SELECT segment_id, CAST(length(headers) // 8 + data AS BIGINT) AS n_bytes, CAST(length(headers) // 8 AS BIGINT) AS header_end, CAST(bdepth_dc AS BIGINT) AS bdepth_dc, CAST(bdepth_ac AS BIGINT) AS bdepth_ac FROM bytes"),
    "part_bits": _q(_bits("stage <> 3", "kind = 'dc'"), _BITS),
    "symbols": _q(VLC, "SELECT segment_id, plane, CAST(len AS INTEGER) AS len, sym, count(*) AS n FROM sym GROUP BY ALL"),
    "vlc_option": _q(VLC, "SELECT segment_id, plane, gaggle, CAST(len AS INTEGER) AS len, option, n, CAST(bits AS BIGINT) AS bits FROM choice"),
    "vlc_length": _q(VLC, "SELECT segment_id, plane, stage, CAST(sum(length(bits)) AS BIGINT) AS bits FROM stream GROUP BY ALL"),
    "segment_bits": _q(_bits(), _BITS),
    "early_stop": _q(_bits("plane > 4 OR plane = 4 AND stage <= 1"), _BITS),
    "segment_file": _q(_HEAD, f"SELECT segment_id, n_bytes, {_HEX} AS head, sha256(unbin(top || rpad(bits, CAST(data * 8 AS INTEGER), '0'))) AS digest FROM bytes"),
    "compressed_size": _q(_HEAD, "SELECT count(*) AS segments, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM bytes"),
    "header_scan": _q(_HEAD, f"SELECT segment_id, CAST(94 AS BIGINT) AS marker, CAST(32 - length(headers) // 8 AS BIGINT) AS offset, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, CAST(bdepth_dc AS BIGINT) AS bdepth_dc, CAST(bdepth_ac AS BIGINT) AS bdepth_ac, size, w AS width, CASE WHEN last THEN CAST((8 - h % 8) % 8 AS BIGINT) END AS pad_rows FROM bytes"),
    "decode_roundtrip": _q(IMG, "SELECT y, x, v FROM img"),
    "settings_asof": _q(f"{STATS}, {_SET}", "SELECT s.segment_id, s.size, t.from_segment, t.blocks, t.heuristic, t.from_segment = s.segment_id AS strict FROM stats s ASOF LEFT JOIN settings t ON s.segment_id >= t.from_segment"),
    "settings_dedupe": _q(_SET, "SELECT from_segment, blocks, heuristic FROM settings s WHERE NOT EXISTS (SELECT 1 FROM settings p WHERE p.from_segment = (SELECT max(from_segment) FROM settings m WHERE m.from_segment < s.from_segment) AND p.blocks = s.blocks AND p.heuristic = s.heuristic)"),
    "seq_check": _q(STATS, "SELECT segment_id, expected FROM (SELECT segment_id, coalesce((SELECT max(p.segment_id) FROM stats p WHERE p.segment_id < s.segment_id AND p.segment_id <> 1) + 1, 0) AS expected FROM stats s WHERE segment_id <> 1) WHERE segment_id <> expected"),
}
