"""SQL that some of the queries are checked against: plain forms over whole tables, fit for small ones only."""

from __future__ import annotations

_REACH = """
reach(a, b) AS (
    SELECT id, id FROM nodes
    UNION
    SELECT r.a, l.v FROM reach r JOIN links l ON l.u = r.b)"""

ARCHIVES = """
WITH payloads AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages),
firsts AS (
    SELECT payload_digest, max(page_id) AS top FROM payloads WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM payloads LEFT JOIN firsts USING (payload_digest)
"""

NEAR_DOCUMENTS = r"""
WITH RECURSIVE words AS (
    SELECT doc_id AS id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
nodes AS (
    SELECT id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
                    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
               END AS shingles
    FROM words),
held AS (SELECT id, len(shingles) AS n, unnest(shingles) AS s FROM nodes),
shared AS (
    SELECT a.id AS u, b.id AS v, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS k
    FROM held a JOIN held b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id),
links AS (SELECT u, v FROM shared WHERE 100 * k >= 85 * (m + n - k)),""" + _REACH + """
SELECT n.id AS doc_id, CAST(len(n.shingles) AS BIGINT) AS n_shingles, c.least AS component_id, n.id = c.least AS kept
FROM nodes n JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) c ON c.a = n.id
"""

NEAR_VECTORS = """
WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (
    SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM nodes
    WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
    SELECT a.id AS u, b.id AS v FROM sound a JOIN sound b ON a.id <> b.id AND a.norm > 0 AND b.norm > 0 AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),""" + _REACH + """
SELECT n.id AS vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.least AS component_id, n.id = c.least AS kept
FROM nodes n JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) c ON c.a = n.id
LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) d ON d.u = n.id
"""

COLLOCATIONS = r"""
WITH lines AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM lines),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM pieces, range(1, 6) t(k)),
counted AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY ALL HAVING count(*) >= 100),
inner_parts AS (
    SELECT lang, f, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM counted, range(2, 5) t(m) WHERE m < k),
within AS (SELECT lang, phrase, max(f) AS f FROM inner_parts GROUP BY lang, phrase),
cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, x.cut, array_to_string(c.w[1:x.cut], ' ') AS head, array_to_string(c.w[x.cut + 1:], ' ') AS tail
    FROM counted c LEFT JOIN within i ON i.lang = c.lang AND i.phrase = c.phrase, range(1, 5) x(cut)
    WHERE c.k > 1 AND x.cut < c.k AND (i.f IS NULL OR 100 * i.f < 100 * c.f)),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.cut, h.f AS l, t.f AS r, n.n,
           (1000 * CAST(c.a AS HUGEINT) * n.n) // (CAST(h.f AS HUGEINT) * t.f) AS score
    FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = c.head JOIN counted t ON t.lang = c.lang AND t.phrase = c.tail
    JOIN totals n ON n.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM lowest QUALIFY rank <= 2000
"""


def _climb(name: str, nodes: str, levels: int) -> str:
    """CTEs of one tree per ``g``: ``nodes`` has (g, idx, n, d); ``{name}s<k>`` are a level's nodes with their siblings."""
    out = [f"{name}l0 AS MATERIALIZED ({nodes})"]
    for k in range(levels):
        frame = "OVER (PARTITION BY g, idx // 3 ORDER BY idx ROWS BETWEEN {})"
        out.append(f"""{name}s{k} AS MATERIALIZED (SELECT g, idx, n,
          coalesce(string_agg(d, '') {frame.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS l,
          coalesce(string_agg(d, '') {frame.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS r FROM {name}l{k})""")
        out.append(f"""{name}l{k + 1} AS MATERIALIZED (SELECT g, idx // 3 AS idx, CASE WHEN n > 1 THEN (n + 2) // 3 ELSE 1 END AS n,
          CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY idx)) ELSE any_value(d) END AS d FROM {name}l{k} GROUP BY g, idx // 3, n)""")
    return ", ".join(out)


def _folded(name: str, start: str, levels: int) -> str:
    """CTEs that carry rows (g, idx, node, proof and others) up a tree made by ``_climb``."""
    out = [f"{name}f0 AS MATERIALIZED ({start})"]
    for k in range(levels):
        out.append(f"""{name}f{k + 1} AS MATERIALIZED (SELECT f.* REPLACE (f.idx // 3 AS idx, f.proof || s.l || s.r AS proof,
          CASE WHEN s.n > 1 THEN sha256(s.l || f.node || s.r) ELSE f.node END AS node)
          FROM {name}f{k} f JOIN {name}s{k} s ON s.g = f.g AND s.idx = f.idx)""")
    return ", ".join(out)


_TOLD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_FIELDS = " || ".join(_TOLD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: Unsigned crc32 of the decimal id, bit by bit.
_BITS = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END))"""
#: Fit for up to 3**14 documents a source and 3**8 sources.
MANIFEST = f"""
WITH leaves AS MATERIALIZED (
    SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS g, sha256({_FIELDS} || {_TOLD.format('text')}) AS leaf,
      sha256({_FIELDS} || {_TOLD.format("CASE WHEN xor(" + _BITS + ", 4294967295::UBIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS found
    FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{_climb("d", "SELECT g, idx, n, leaf AS d FROM placed", 14)},
tops AS MATERIALIZED (SELECT 0 AS g, g AS src, d, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM dl14),
{_climb("t", "SELECT g, idx, n, d FROM tops", 8)},
{_folded("d", "SELECT g, idx, doc_id, leaf, found AS node, '' AS proof FROM placed", 14)},
{_folded("t", "SELECT tops.g, tops.idx, f.doc_id, f.leaf, f.node, f.proof, tops.d AS subroot FROM df14 f JOIN tops ON tops.src = f.g", 8)}
SELECT f.doc_id, f.leaf, f.subroot, r.d AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = r.d AS verified
FROM tf8 f, tl8 r
"""

ORACLES = {
    "op2_warc_salvage": ARCHIVES,
    "op7_minhash_near_duplicates": NEAR_DOCUMENTS,
    "op10_near_vectors": NEAR_VECTORS,
    "op11_merkle_manifest": MANIFEST,
    "op12_phrase_collocations": COLLOCATIONS,
}
