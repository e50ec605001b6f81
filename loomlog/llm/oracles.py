"""SQL of those text operators whose rules SQL can state, over whole tables: no anchors, tiles or bounds, only the rule."""

from __future__ import annotations

from . import jaccard_join, quality, vector_codes

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

def _joined(source: str, item: str, n: int, between: str) -> str:
    """SELECT of ``source`` (doc_id, ``item``, i) with ``key``: the ``n`` items from each one on as one text, null
    where fewer are left. Lengths double, so the work is linear in them."""
    glue = f" || '{between}' || " if between else " || "
    powers = [1 << k for k in range(n.bit_length())]
    held = f"(SELECT *, {item} AS k1 FROM {source})"
    at = lambda p, j: f"lead(k{p}, {j}) OVER o" if j else f"k{p}"
    for p in powers[1:]:
        held = f"(SELECT *, k{p // 2}{glue}{at(p // 2, p // 2)} AS k{p} FROM {held} WINDOW o AS (PARTITION BY doc_id ORDER BY i))"
    parts, done = [], 0
    for p in reversed(powers):
        if n & p:
            parts.append(at(p, done))
            done += p
    return f"SELECT doc_id, {item}, i, {glue.join(parts)} AS key FROM {held} WINDOW o AS (PARTITION BY doc_id ORDER BY i)"


def _removed(item: str, n: int, between: str) -> str:
    """CTEs ``gone``: which items are covered by a window of ``n`` that also starts earlier."""
    return f"""items AS (SELECT doc_id, unnest(w) AS {item}, generate_subscripts(w, 1) AS i FROM d),
windows AS ({_joined("items", item, n, between)}),
late AS (SELECT doc_id, {item}, i, key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1 AS again FROM windows),
gone AS (SELECT doc_id, {item}, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS gone FROM late)"""


OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
{_removed("word", 20, " ")},
kept AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: Bytes are pairs of hexadecimal digits here; the rest is as with words.
OP2 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS w FROM documents),
{_removed("byte", 100, "")},
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM gone),
kept AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
        sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256
    FROM runs GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: Overlaps are counted shingle by shingle; what links lead to is followed from each document.
OP3 = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
items AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
shingles AS (
    SELECT DISTINCT doc_id, key AS s FROM ({_joined("items", "word", jaccard_join.SHINGLE, " ")}) WHERE key IS NOT NULL
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {jaccard_join.SHINGLE - 1}),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a, b
    FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * shared >= {jaccard_join.PERCENT} * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS origin, doc_id AS reached FROM d UNION SELECT origin, b FROM reach JOIN links ON a = reached)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(reached) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN reach ON origin = d.doc_id GROUP BY d.doc_id
"""


#: The rules of ``quality.votes``, in its order: 0 bad, 1 good, else null.
VOTES = (
    "CASE WHEN n_symbols * 10 > n_words THEN 0 WHEN n_symbols * 50 <= n_words THEN 1 END",
    "CASE WHEN n_symbols * 20 > word_chars THEN 0 WHEN n_symbols * 100 <= word_chars THEN 1 END",
    "CASE WHEN n_shout * 10 > n_words THEN 0 WHEN n_shout * 50 <= n_words THEN 1 END",
    "CASE WHEN n_upper * 10 > word_chars * 3 THEN 0 WHEN n_upper * 10 < word_chars THEN 1 END",
    "CASE WHEN n_repeat_words * 10 > n_words * 3 THEN 0 WHEN n_repeat_words * 10 < n_words THEN 1 END",
    "CASE WHEN n_lines > 1 THEN CASE WHEN n_dup_lines * 10 > n_lines * 3 THEN 0 WHEN n_dup_lines = 0 THEN 1 END END",
    "CASE WHEN n_words BETWEEN 20 AND 2000 THEN CASE WHEN kinds * 10 < n_words * 2 THEN 0 WHEN kinds * 10 > n_words * 3 THEN 1 END END",
    "CASE WHEN n_words > 0 THEN CASE WHEN word_chars > n_words * 14 OR word_chars < n_words * 2 THEN 0 WHEN word_chars BETWEEN n_words * 3 AND n_words * 10 THEN 1 END END",
    "CASE WHEN n_words >= 30 THEN CASE WHEN functional < 2 THEN 0 WHEN functional >= 4 THEN 1 END END",
)


def _op6() -> str:
    span = range(1, len(VOTES) + 1)
    clamp = lambda x, least: f"least(greatest({x}, {least}), 1 - {least})"
    odds = "ln(prior / (1 - prior))" + "".join(f" + CASE v[{i}] WHEN 0 THEN ln(good[{i}] / bad[{i}]) WHEN 1 THEN ln((1 - good[{i}]) / (1 - bad[{i}])) ELSE 0 END" for i in span)
    rate = lambda i, of: clamp(f"(sum(CASE WHEN v[{i}] = 0 THEN {of} ELSE 0 END) + 1e-3) / (sum(CASE WHEN v[{i}] IS NOT NULL THEN {of} ELSE 0 END) + 2e-3)", "1e-4")
    rates = lambda of: "[" + ", ".join(rate(i, of) for i in span) + "]"
    listed = ", ".join(f"'{w}'" for w in quality.FUNCTION_WORDS)
    bad, good, prior = quality.START
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
items AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
windows AS ({_joined("items", "word", 3, " ")}),
again AS (SELECT doc_id, i, key IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, key) > 1 AS again FROM windows),
covered AS (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM again),
repeats AS (SELECT doc_id, count(*) FILTER (covered) AS n_repeat_words FROM covered GROUP BY doc_id),
f AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper,
        length(text) - length(replace(text, '!', '')) AS n_shout, len(list_distinct(w)) AS kinds, len(list_intersect(list_distinct(w), [{listed}])) AS functional
    FROM d LEFT JOIN repeats USING (doc_id)),
voted AS (
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{', '.join(VOTES)}] AS v
    FROM f),
patterns AS (SELECT v, count(*)::DOUBLE AS n FROM voted WHERE NOT base_failed GROUP BY v),
em AS (
    SELECT 0 AS round, {prior}::DOUBLE AS prior, {[bad] * len(VOTES)}::DOUBLE[] AS bad, {[good] * len(VOTES)}::DOUBLE[] AS good, 1.0::DOUBLE AS moved
    UNION ALL
    SELECT round + 1, p, b, g, greatest(abs(p - prior), list_max(list_transform(b, lambda x, i: abs(x - bad[i]))), list_max(list_transform(g, lambda x, i: abs(x - good[i]))))
    FROM (
        SELECT round, any_value(prior) AS prior, any_value(bad) AS bad, any_value(good) AS good, {clamp("sum(g) / sum(n)", "1e-3")} AS p, {rates("n - g")} AS b, {rates("g")} AS g
        FROM (SELECT em.*, v, n, n / (1 + exp(-({odds}))) AS g FROM em, patterns WHERE moved > {quality.TOLERANCE} AND round < {quality.MOST_ROUNDS}) GROUP BY round)),
model AS (SELECT prior, bad, good FROM em ORDER BY round DESC LIMIT 1),
told AS (SELECT voted.*, 1 / (1 + exp(-({odds}))) AS p FROM voted, model)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= {quality.KEEP_AT} AS kept, round(p, 6) AS p_good
FROM told
"""


ORACLES = {"op1_substring_dedup": OP1, "op2_suffix_array_dedup": OP2, "op3_jaccard_join": OP3, "op6_quality": _op6()}


def _op11() -> str:
    parts, entries, rounds = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
    floor_div = lambda a, b: f"({a} - (({a} % {b}) + {b}) % {b}) // {b}"

    def assigned(r: int) -> str:
        """Nearest entries in round ``r``: least by distance, then by number. Products of these integers are exact in DOUBLE."""
        far = f"list_inner_product(x::DOUBLE[], x::DOUBLE[]) - 2 * list_inner_product(x::DOUBLE[], c::DOUBLE[]) + list_inner_product(c::DOUBLE[], c::DOUBLE[])"
        return f"a{r} AS (SELECT vec_id, p, x, e, far FROM (SELECT vec_id, p, x, e, {far} AS far FROM cut JOIN b{r} USING (p)) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY far, e) = 1)"

    steps = []
    for r in range(rounds):
        each = f"(SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r})"
        means = f"SELECT p, e, list({floor_div('s', 'n')} ORDER BY i) AS c FROM (SELECT p, e, i, sum(v)::BIGINT AS s, count(*) AS n FROM {each} GROUP BY ALL) GROUP BY ALL"
        steps += [assigned(r), f"b{r + 1} AS (SELECT b{r}.p, b{r}.e, coalesce(m.c, b{r}.c) AS c FROM b{r} LEFT JOIN ({means}) m ON m.p = b{r}.p AND m.e = b{r}.e)"]
    return f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda c: floor({vector_codes.SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cut AS (SELECT vec_id, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM kept, range({parts}) t(p)),
b0 AS (SELECT p, e, x AS c FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id)),
{", ".join(steps)}, {assigned(rounds)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
told AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), told
"""


ORACLES["op11_vector_codes"] = _op11()
