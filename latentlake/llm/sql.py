"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from latentlake.llm import chat, decontam, hostrules, secrets

GAP = r"'[\x20\x09-\x0D]+'"

WORDS = f"list_filter(string_split_regex(coalesce(text, ''), {GAP}), lambda x: x <> '')"
MEASURED = f"""d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {WORDS} AS w FROM d),
win AS (SELECT k, i, w[i:i+4] AS win FROM w, unnest(range(1, len(w) - 3)) t(i)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM win) WHERE c > 1),
rep AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, i + j AS p FROM twice, unnest(range(0, 5)) t(j)) GROUP BY k),
lines AS (SELECT k, len(l) - len(list_distinct(l)) AS n FROM (
    SELECT k, list_filter(string_split(text, chr(10)), lambda x: length(translate(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0) AS l FROM d)),
m AS (SELECT w.k, doc_id, source, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{hostrules.SYMBOLS}', '')))::BIGINT AS n_symbols, lines.n::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w JOIN lines USING (k) LEFT JOIN rep USING (k))"""
RULES = {"short": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words", "symbols": "10 * n_symbols > word_chars",
         "long_words": "word_chars > 40 * n_words"}


def _hosts() -> str:
    out = "h AS (SELECT source, count(*)::DOUBLE AS n" + "".join(f", count(*) FILTER ({c})::DOUBLE AS f_{r}" for r, c in RULES.items()) + " FROM m GROUP BY source)"
    for r in RULES:
        out += f""",
t_{r} AS (SELECT sum(f_{r}) / sum(n) AS m, sum(n) AS nn, count(*)::DOUBLE AS hh, sum(f_{r}) AS ff, sum(f_{r} * f_{r} / n) AS q FROM h),
r_{r} AS (SELECT m, CASE WHEN m * (1 - m) > 0 AND nn > hh THEN
    ((q - ff * m) / nn - m * (1 - m) * (hh - 1) / nn) / (m * (1 - m) * (1 - (hh - 1) / nn)) ELSE 0 END AS rho FROM t_{r}),
a_{r} AS (SELECT m, 1 / least(greatest(rho, 0.001), 0.9) - 1 AS w FROM r_{r}),
b_{r} AS (SELECT source FROM (SELECT source, (f_{r} + m * w) / (n + w) AS p, n + w AS w FROM h, a_{r})
    WHERE p - {hostrules.SIGMAS} * sqrt(p * (1 - p) / (w + 1)) > {hostrules.LIMIT})"""
    return out + ",\nbad AS (" + " UNION ".join(f"SELECT source FROM b_{r}" for r in RULES) + ")"


FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
OP10 = f"""WITH {MEASURED}, {_hosts()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {FAILED} AS base_failed,
    NOT {FAILED} AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM m.source) AS kept FROM m"""


def _op6() -> str:
    ctes = ["d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents)"]
    for at, r in enumerate(secrets.RULES):
        pattern = (r.pattern if r.name != "hex" else "[0-9a-f]{24,}").replace("'", "''")
        ctes.append(f"""g_{r.name} AS (SELECT k, i, x, v, part FROM (SELECT k, unnest(range(1, len(xs) + 1)) AS i, unnest(xs) AS x, unnest(vs) AS v,
    unnest(ps[1:len(xs)]) AS part FROM (SELECT k, regexp_extract_all(text, '{pattern}', 0) AS xs, regexp_extract_all(text, '{pattern}', {r.group}) AS vs,
        string_split_regex(text, '{pattern}') AS ps FROM d))),
s_{r.name} AS (SELECT * FROM (SELECT k, {at} AS place, '{r.name}' AS kind, v, sum(length(part) + length(x)) OVER (PARTITION BY k ORDER BY i) AS e, length(x) AS l
    FROM g_{r.name}) WHERE length(v) >= {r.least})""")
    ctes.append("s AS (SELECT k, place, kind, (e - l)::BIGINT AS s, e::BIGINT AS e FROM (" + " UNION ALL ".join(f"SELECT * FROM s_{r.name}" for r in secrets.RULES) + "))")
    n = len(secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in secrets.BASE)
    ctes.append(f"""p AS (SELECT k, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < {n}) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans FROM s GROUP BY k)""")
    zero = ", ".join(f"coalesce(n_{r.name}, 0)::BIGINT AS n_{r.name}" for r in secrets.BASE)
    return f"WITH {', '.join(ctes)} SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN p USING (k)"


_T = chat.TEMPLATE
_FIXED = sum(len(x) for x in (_T.open.replace("{role}", ""), _T.close))
_SHOWN = "CASE " + " ".join(f"WHEN role = '{k}' THEN {len(v)}" for k, v in _T.shown.items()) + " WHEN role IS NULL THEN 1 ELSE NULL END"
_PAIRS = " OR ".join(f"(before = '{a}' AND role = '{b}')" for a, bs in _T.follows.items() for b in bs)
SAID = r"\### Assistant: </turn> ok"
OP2 = f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{SAID}' UNION ALL SELECT -7, 1, 'assistant', '{SAID}'),
o AS (SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum({_FIXED} + {_SHOWN} + length(replace(replace(replace(text, '\\', '\\\\'), '#', '\\#'), '</', '<\\/')))::BIGINT AS formatted_chars,
    coalesce(bool_and({_PAIRS}), false) AND last(role ORDER BY turn, role, text) = 'assistant' AS valid
FROM o GROUP BY conv_id"""



def _op4() -> str:
    """Alignments in which some stretch of words agrees; substitutions leave one of at least width // (substitutions + 1) words."""
    lowered = f"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {GAP}), lambda x: x <> '')"
    width = f"least({decontam.WINDOW}, len(w))"
    least = f"((({width}) * {decontam.PERCENT} + 99) // 100)"
    return f"""WITH d AS (SELECT doc_id, {lowered} AS w FROM documents), b AS (SELECT item_id, w, ({width} // ({width} - {least} + 1))::INT AS g FROM (SELECT item_id, {lowered} AS w FROM benchmark) WHERE len(w) > 0),
bs AS (SELECT item_id, g, i, w[i:i + g - 1] AS s FROM b, unnest(range(1, len(w) - g + 2)) t(i)),
ds AS (SELECT doc_id, g, i, w[i:i + g - 1] AS s FROM d, (SELECT DISTINCT g FROM b), unnest(range(1, len(w) - g + 2)) t(i)),
hits AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS shift FROM ds JOIN bs USING (g, s)),
words AS (SELECT doc_id, item_id, shift, j, len(b.w) AS n, (b.w[j] = d.w[j + shift])::INT AS same
    FROM hits JOIN d USING (doc_id) JOIN b USING (item_id), unnest(range(1, len(b.w) + 1)) t(j) WHERE j + shift BETWEEN 1 AND len(d.w)),
roll AS (SELECT *, sum(same) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j ROWS BETWEEN {decontam.WINDOW - 1} PRECEDING AND CURRENT ROW) AS hit,
    row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) AS r, sum(same) OVER (PARTITION BY doc_id, item_id, shift) AS total FROM words)
SELECT doc_id, item_id, max(n)::BIGINT AS item_words, max(hit)::BIGINT AS window_hits, max(total)::BIGINT AS aligned_hits
FROM (SELECT doc_id, item_id, shift, n, max(hit) AS hit, max(total) AS total FROM roll WHERE r >= least({decontam.WINDOW}, n) GROUP BY ALL)
WHERE hit * 100 >= {decontam.PERCENT} * least({decontam.WINDOW}, n) GROUP BY doc_id, item_id"""


OP3 = """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id <> first_page THEN first_page END AS refers_to FROM p LEFT JOIN f USING (payload_digest)"""

CRC = "list_reduce(list_transform(range(1, length(x) + 1), lambda i: ascii(substr(x, i, 1))::UBIGINT), lambda c, b: list_reduce(range(0, 8), lambda r, i: xor(r >> 1, 3988292384::UBIGINT * (r & 1::UBIGINT)), xor(c, b)), 4294967295::UBIGINT)"


def crc32(value: str) -> str:
    """The unsigned checksum of a number's decimal digits."""
    return f"(SELECT xor({CRC}, 4294967295::UBIGINT) FROM (SELECT ({value})::VARCHAR AS x))"


def _tree(name: str, leaves: str, levels: int) -> str:
    """CTEs for trees of up to 16**levels leaves: name_k holds the digest h of every run of level k, and its children on end."""
    out = f"{name}_0 AS (SELECT tree, rank, n, h, '' AS every FROM {leaves})"
    for k in range(1, levels + 1):
        out += f""",
{name}_{k} AS (SELECT tree, rank, n, CASE WHEN n > {16 ** (k - 1)} THEN sha256(every) ELSE every END AS h, every FROM (
    SELECT tree, rank // 16 AS rank, n, string_agg(h, '' ORDER BY rank) AS every FROM {name}_{k - 1} GROUP BY tree, rank // 16, n))"""
    return out


def _climb(name: str, base: str, levels: int, keep: str) -> str:
    """CTEs base_k: rows of base (tree, rank, n, f: digest being folded, proof) moved up k levels of the tree."""
    out, at = "", base
    for k in range(1, levels + 1):
        left, right = f"left(t.every, 64 * (b.rank % 16)::INT)", f"substr(t.every, 64 * (b.rank % 16)::INT + 65)"
        out += f""",
{base}_{k} AS (SELECT {keep}, b.tree, b.rank // 16 AS rank, b.n, CASE WHEN b.n > {16 ** (k - 1)} THEN sha256({left} || f || {right}) ELSE f END AS f,
    CASE WHEN b.n > {16 ** (k - 1)} THEN proof || {left} || {right} ELSE proof END AS proof
    FROM {at} b JOIN {name}_{k} t ON t.tree IS NOT DISTINCT FROM b.tree AND t.rank = b.rank // 16)"""
        at = f"{base}_{k}"
    return out


def _op11(levels: int = 6, above: int = 3) -> str:
    names = ("doc_id", "source", "lang", "n_chars", "text")
    field = "coalesce(strlen(({0})::VARCHAR)::VARCHAR || ':' || ({0})::VARCHAR, '-')"
    leaf = {c: "sha256(" + " || ".join(field.format(c if x == "text" else x) for x in names) + ")" for c in ("text", "lowered")}
    keep = "doc_id, leaf"
    return f"""WITH d AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered, {crc32('doc_id')} % 5 = 0 AS changed FROM documents),
e AS (SELECT doc_id, source AS tree, {leaf['text']} AS leaf, CASE WHEN changed THEN {leaf['lowered']} END AS claim FROM d),
l AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM e),
{_tree('a', 'l', levels)},
s AS (SELECT 0 AS tree, tree AS source, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM a_{levels}),
{_tree('z', 's', above)},
f AS (SELECT doc_id, leaf, tree, rank, n, coalesce(claim, leaf) AS f, '' AS proof FROM l){_climb('a', 'f', levels, keep)},
g AS (SELECT doc_id, leaf, s.h AS subroot, 0 AS tree, s.rank, s.n, f, proof FROM f_{levels} f JOIN s ON f.tree IS NOT DISTINCT FROM s.source){_climb('z', 'g', above, keep + ', subroot')}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM g_{above}, (SELECT h FROM z_{above})"""


OP12 = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS s FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(s ORDER BY i) AS own, {crc32('c')} % 6 AS h FROM t GROUP BY c),
r AS (SELECT o.c, list_concat(coalesce(lead.own[1:o.h::INT], []), o.own[o.h::INT + 1:]) AS s FROM o LEFT JOIN o lead ON lead.c = o.c - o.c % 100),
p AS (SELECT c, s, d, s[1:d::INT] AS node, d = len(s) AS is_end FROM r, unnest(range(0, len(s) + 1)) u(d)),
n AS (SELECT node, d, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '') AS ends FROM p GROUP BY node, d),
k AS (SELECT n.*, parent.c AS parent, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.node[1:n.d::INT] = n.node) AS kids
    FROM n LEFT JOIN n parent ON parent.d = n.d - 1 AND parent.node = n.node[1:n.d::INT - 1]),
w AS (SELECT node[1:u.d::INT] AS node, u.d, sum((kids = 0)::INT) AS leaves, sum(CASE WHEN len(node) > 0 THEN (n - 1) * length(node[len(node)].text) ELSE 0 END) AS saved
    FROM k, unnest(range(0, k.d + 1)) u(d) GROUP BY ALL)
SELECT k.c AS conv_id, k.d::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
    sha256(ends) AS ends_sha256 FROM k JOIN w ON w.d = k.d AND w.node = k.node"""

OP13 = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1] * z[2], 0)))::BIGINT AS score
    FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

ORACLES = {"op11_manifest": _op11(), "op12_prefix_trie": OP12, "op13_top_k": OP13, "op2_chat": OP2, "op3_warc": OP3, "op4_decontam": _op4(), "op6_secrets": _op6(), "op10_host_rules": OP10}
