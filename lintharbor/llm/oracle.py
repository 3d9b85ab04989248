"""SQL for the operators that SQL can express."""

from __future__ import annotations

from itertools import permutations

_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{_SPACE}'), lambda x: x <> '')"


def _shingles(table: str, key: str, text: str) -> str:
    """Distinct 5-word shingles of a table, as words joined by a space."""
    return f"""
        SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s FROM (
            SELECT {key}, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i
            FROM (SELECT {key}, {_words(text)} AS w FROM {table}) WHERE len(w) > 0)"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = f"""
WITH RECURSIVE s AS ({_shingles('documents', 'doc_id', _LOWER)}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.node = e.a),
c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT doc_id, coalesce(md5(string_agg(s, chr(10) ORDER BY s)), 'none ' || doc_id) AS set_of
      FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, min(doc_id) OVER (PARTITION BY set_of) AS class_id
FROM c LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)"""

DECONTAMINATION = f"""
WITH d AS ({_shingles('documents', 'doc_id', 'lower(text)')}),
b AS ({_shingles('benchmark', 'item_id', 'lower(text)')}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY ALL HAVING 100 * count(*) >= 80 * n_item"""

_MEASURES = ["symbol_share", "dup_line_share", "repeat_share", "word_length"]
_LEAST = {"symbol_share": 0.02, "dup_line_share": 0.1, "repeat_share": 0.05, "word_length": 1.0}


def _limits(level: str, keys: str) -> str:
    cuts = ", ".join(
        f"quantile_disc({m}, 0.25) AS {m}_lo, quantile_disc({m}, 0.75) AS {m}_hi" for m in _MEASURES)
    by = f"GROUP BY {keys}" if keys else ""
    return f"{level} AS (SELECT {keys + ',' if keys else ''} count(*) AS n, {cuts} FROM good {by})"


def _verdict() -> str:
    tests = []
    for m in _MEASURES:
        spread = f"greatest({m}_hi - {m}_lo, {_LEAST[m]})"
        tests.append(f"{m} > {m}_hi + 3.0 * {spread}")
        if m == "word_length":
            tests.append(f"{m} < {m}_lo - 3.0 * {spread}")
    return " OR ".join(tests)


def _chosen() -> str:
    return ", ".join(
        f"CASE WHEN g.n >= 200 THEN g.{c} WHEN l.n >= 200 THEN l.{c} ELSE o.{c} END AS {c}"
        for m in _MEASURES for c in (f"{m}_lo", f"{m}_hi"))


QUALITY_RULES = f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_words('text')} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) > 7)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(8) r(j) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
m AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        n_symbols / greatest(word_chars, 1)::DOUBLE AS symbol_share,
        n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_share,
        n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_share,
        word_chars / greatest(n_words, 1)::DOUBLE AS word_length FROM m),
good AS (SELECT * FROM f WHERE NOT base_failed),
{_limits('g', 'lang, source')}, {_limits('l', 'lang')}, {_limits('o', '')},
lim AS (SELECT g.lang, g.source, {_chosen()} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang CROSS JOIN o)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT (base_failed OR coalesce({_verdict()}, false)) AS kept
FROM f LEFT JOIN lim ON f.lang IS NOT DISTINCT FROM lim.lang AND f.source IS NOT DISTINCT FROM lim.source"""

_ORDERS = ",".join("".join(p) for p in permutations("ABCDE"))
_BITS = "(1 << (ascii({}) - 65))"

FILTER_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_words('text')} AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT unnest(string_split('{_ORDERS}', ',')) AS filter_order),
s AS (SELECT filter_order, step, {_BITS.format('filter_order[step]')} AS own,
        coalesce(list_sum(list_transform(generate_series(1, step - 1), lambda i: {_BITS.format('filter_order[i]')})), 0) AS earlier
      FROM o, range(1, 6) r(step))
SELECT part, filter_order, step::INT AS step,
    sum(n * (mask & (own | earlier) = 0)::INT)::BIGINT AS kept,
    sum(n * (mask & own <> 0 AND mask & earlier = 0)::INT)::BIGINT AS removed,
    sum(n * (mask & own <> 0 AND mask & earlier <> 0)::INT)::BIGINT AS redundant,
    sum(n * (mask = own)::INT)::BIGINT AS unique_fails,
    sum(good * (mask & own <> 0 AND mask & earlier = 0)::INT)::BIGINT AS good_lost,
    sum(toxic * (mask & own <> 0 AND mask & earlier = 0)::INT)::BIGINT AS toxic_lost,
    sum(CASE WHEN mask & own <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END)::BIGINT AS shapley
FROM c, s GROUP BY ALL"""

SOURCE_MIXING = f"""
WITH d AS (SELECT doc_id, source, len({_words('text')})::BIGINT AS size,
        md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, '-'), md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
p AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS rest,
        sum(w) OVER after AS weights
      FROM s WINDOW before AS (ORDER BY 3 * source_size * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        after AS (ORDER BY 3 * source_size * (10 // w), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
x AS (SELECT *, cap * weights <= rest * w AS is_full FROM p),
o AS (SELECT arg_max(weights, weights) AS ow, arg_max(rest, weights) AS orest FROM x WHERE NOT is_full),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE orest::DOUBLE * w::DOUBLE / ow::DOUBLE END AS target FROM x, o),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
k AS (SELECT source, key, any_value(size) AS size, count(*) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) - sum(size) AS before
      FROM d GROUP BY source, key)
SELECT d.doc_id, d.source, d.size, source_size, target,
    (epochs * d.size + greatest(0, least(d.size, (budget - epochs * source_size - before) // n)))::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.key = k.key JOIN e ON d.source IS NOT DISTINCT FROM e.source"""


def _framed(columns: list[str]) -> str:
    return " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)


def _climb(start: str, name: str, levels: int) -> str:
    """Tables of each level (tree, i, h, w), and of its runs (tree, run, w, hs): a tree of one node stays as it is."""
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        out.append(f"{name}r{k} AS (SELECT tree, i // 16 AS run, w, list(h ORDER BY i) AS hs FROM {name}{k} GROUP BY ALL)")
        out.append(f"""{name}{k + 1} AS (SELECT tree, run AS i, CASE WHEN w > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h,
            (w + 15) // 16 AS w FROM {name}r{k})""")
    return ", ".join(out)


def _fold(start: str, name: str, runs: str, tree: str, place: str, levels: int) -> str:
    """Proof and folded hash of each leaf, level by level over the tables of runs."""
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        at = f"(({place}) >> {4 * k})"
        out.append(f"""{name}{k + 1} AS (SELECT x.* EXCLUDE (proof, folded),
            CASE WHEN w > 1 THEN proof || array_to_string(hs[1:{at} % 16] || hs[{at} % 16 + 2:], '') ELSE proof END AS proof,
            CASE WHEN w > 1 THEN sha256(array_to_string(hs[1:{at} % 16] || [folded] || hs[{at} % 16 + 2:], '')) ELSE folded END AS folded
            FROM {name}{k} x JOIN {runs}r{k} r ON {tree} = r.tree AND {at} // 16 = r.run)""")
    return ", ".join(out)


# The reduction reads each byte as an exclusive or, then eight shifts by the polynomial.
_CRC32 = """(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({0}, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""
_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

# Enough levels for 16 ** 5 rows a source and 16 ** 3 sources.
MERKLE_MANIFEST = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, sha256({_framed(_FIELDS)}) AS leaf,
        CASE WHEN xor({_CRC32.format('doc_id::VARCHAR')}, 4294967295) % 5 = 0
             THEN sha256({_framed([*_FIELDS[:4], _LOWER])}) END AS changed FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS w FROM d),
{_climb('SELECT tree, i, leaf AS h, w FROM n', 'a', 5)},
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS w FROM a5),
{_climb("SELECT '' AS tree, place AS i, subroot AS h, w FROM s", 'b', 3)},
{_fold("SELECT doc_id, tree, leaf, i, '' AS proof, coalesce(changed, leaf) AS folded FROM n", 'x', 'a', 'x.tree', 'x.i', 5)},
{_fold("SELECT x5.*, subroot, place FROM x5 JOIN s USING (tree)", 'y', 'b', "''", 'x.place', 3)}
SELECT doc_id, leaf, subroot, b3.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b3.h AS verified FROM y3, b3"""

SQL = {
    "op1_ngram_jaccard_join": NGRAM_JOIN,
    "op4_benchmark_decontamination": DECONTAMINATION,
    "op7_quality_rules": QUALITY_RULES,
    "op11_filter_audit": FILTER_AUDIT,
    "op12_source_mixing": SOURCE_MIXING,
    "op13_merkle_manifest": MERKLE_MANIFEST,
}
