"""SQL building blocks for the checks that run beside the Spark queries.

Everything here is plain text for an independent engine: the same rules, written as SQL over the
same tables. Offsets come from marking matches and summing piece lengths.
"""

from __future__ import annotations

from veilframe.operators.rules import BUILTIN_RULES, CATEGORIES, DEFAULT_POLICY, RANK, Policy, Rule


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def grouped(pattern: str) -> str:
    return f"(?i)({pattern[4:]})" if pattern.startswith("(?i)") else f"({pattern})"


def rank_case(col: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN {q(a)} THEN {r}" for a, r in RANK.items()) + " END"


def any_of(text: str, terms) -> str:
    return "(" + (" OR ".join(f"contains({text}, {q(t)})" for t in terms) or "false") + ")"


def spans_of(source: str, pattern: str, where: str = "true") -> str:
    """``source`` has (k, leaf_seq, ptr, text); yields one row per match with st, en, v, match_seq."""
    marked = f"string_split(regexp_replace(text, {q(grouped(pattern))}, chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    return f"""
      SELECT k, leaf_seq, ptr, text, i // 2 - 1 AS match_seq, (pos - length(part))::BIGINT AS st, pos::BIGINT AS en, part AS v
      FROM (SELECT *, sum(length(part)) OVER (PARTITION BY k, leaf_seq ORDER BY i) AS pos
            FROM (SELECT k, leaf_seq, ptr, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
                  FROM (SELECT k, leaf_seq, ptr, text, {marked} AS parts FROM {source}
                        WHERE {where} AND regexp_matches(text, {q(pattern)}))))
      WHERE i % 2 = 0"""


def rule_sql(rule: Rule, seq: int, source: str, action: str) -> str:
    gate = "true"
    if rule.gate:
        gate = "(" + " OR ".join(f"ends_with(ptr, {q(s)})" for s in rule.gate) + ")"
    score, keep = str(rule.priority), "true"
    if rule.context:
        c = rule.context
        window = (f"lower(substring(text, greatest(st - {c.window}, 0) + 1, "
                  f"en + {c.window} - greatest(st - {c.window}, 0)))")
        pos, neg = any_of(window, c.positive), any_of(window, c.negative)
        score = (f"greatest(0, {rule.priority} + CASE WHEN {pos} THEN {c.boost} ELSE 0 END"
                 f" - CASE WHEN {neg} THEN {c.penalty} ELSE 0 END)")
        if c.require_positive:
            keep += f" AND {pos}"
        if c.suppress_on_negative:
            keep += f" AND NOT {neg}"
    return f"""
    SELECT k, leaf_seq, ptr, {seq} AS rule_seq,
           row_number() OVER (PARTITION BY k, leaf_seq ORDER BY st) - 1 AS match_seq,
           {q(rule.rule_id)} AS rule_id, {q(rule.category)} AS category, st, en,
           {q(rule.action or action)} AS action, {RANK[rule.action or action]} AS rank, {score} AS priority,
           {q(rule.template) if rule.template else 'NULL'}::VARCHAR AS template, v, text
    FROM ({spans_of(source, rule.pattern, gate)}) WHERE {keep}"""


def hits_ctes(leaves: str, *, profile: str = "strict", policy: Policy = DEFAULT_POLICY, rules=BUILTIN_RULES,
              extra: tuple[Rule, ...] = ()) -> str:
    """``WITH`` list: ``leaves`` (k, leaf_seq, ptr, text) and ``hits`` under one profile."""
    chosen = policy.by_id[profile]
    parts = [rule_sql(r, i, "leaves", chosen.action_for(r.category)) for i, r in enumerate((*rules, *extra))]
    return f"leaves AS MATERIALIZED ({leaves}), hits AS MATERIALIZED ({' UNION ALL '.join(parts)})"


SPANS = """
    ordered AS (
      SELECT *, max(en) OVER (PARTITION BY k, ptr ORDER BY st, en DESC, priority DESC, rule_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM hits),
    numbered AS (
      SELECT *, sum(CASE WHEN st < seen THEN 0 ELSE 1 END)
                OVER (PARTITION BY k, ptr ORDER BY st, en DESC, priority DESC, rule_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM ordered),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY k, ptr, island ORDER BY rank DESC, priority DESC, rule_id) AS place,
             min(st) OVER (PARTITION BY k, ptr, island) AS i_st, max(en) OVER (PARTITION BY k, ptr, island) AS i_en,
             count(*) OVER (PARTITION BY k, ptr, island) AS members
      FROM numbered),
    spans AS MATERIALIZED (
      SELECT k, leaf_seq, ptr, i_st AS st, i_en AS en, rule_id, category, action, rank, priority, template,
             members - 1 AS suppressed, text FROM placed WHERE place = 1)
"""


def leaf_source(table: str, key: str, text: str, ptr: str) -> str:
    return f"SELECT {key} AS k, 0 AS leaf_seq, {q(ptr)} AS ptr, {text} AS text FROM {table}"


DOCS = leaf_source("documents", "doc_id", "text", "/content")
PAGES = leaf_source("pages", "page_id", "html", "/html")


def fragment_sql(visible: int, text: str = "frag") -> str:
    """The rewritten fragment; hashing is left to the caller."""
    return f"""CASE action
      WHEN 'redact' THEN '[REDACTED]'
      WHEN 'mask' THEN regexp_replace(substring({text}, 1, greatest(length({text}) - {visible}, 0)), '\\S', '*', 'g')
                       || right({text}, least({visible}, length({text})))
      WHEN 'replace' THEN coalesce(template, '[REPLACED]') WHEN 'block' THEN '[BLOCKED]' ELSE {text} END"""


FINAL = """
    final AS MATERIALIZED (
      SELECT k, max(rank) AS rank,
             CASE max(rank) WHEN 4 THEN 'block' WHEN 3 THEN 'redact' WHEN 2 THEN 'replace' WHEN 1 THEN 'mask'
                            ELSE 'allow' END AS final_action
      FROM spans GROUP BY k)
"""


def rewritten_ctes(visible: int) -> str:
    """``rewritten`` (k, leaf_seq, new_text) for every leaf that has spans."""
    return f"""
    pieces AS (
      SELECT k, leaf_seq, st, en, text, substring(text, st + 1, en - st) AS frag, action, template,
             coalesce(lag(en) OVER w, 0) AS prev, row_number() OVER w AS n,
             count(*) OVER (PARTITION BY k, leaf_seq) AS total
      FROM spans WINDOW w AS (PARTITION BY k, leaf_seq ORDER BY st)),
    rewritten AS MATERIALIZED (
      SELECT k, leaf_seq, string_agg(
               substring(text, prev + 1, st - prev) || {fragment_sql(visible)}
               || CASE WHEN n = total THEN substring(text, en + 1) ELSE '' END, '' ORDER BY st) AS new_text
      FROM pieces GROUP BY k, leaf_seq)
"""


def categories_case() -> str:
    return ", ".join(q(c) for c in CATEGORIES)
