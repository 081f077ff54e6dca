"""Evaluation queries over documents, labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions.arrays import explode_once
from veilframe.operators import evals as E
from veilframe.operators import metrics as MT
from veilframe.operators import ner as N
from veilframe.operators import sanitize as S
from veilframe.plans import oracle as O
from veilframe.plans.detection import documents
from veilframe.plans.metrics import AUDIT, audit_events
from veilframe.plans.ner import spans
from veilframe.sources.tables import known_size, table

QUERIES, ORACLES = {}, {}
NAME = "[A-Z][a-z]{4,}"


def add(name, oracle=None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


CASES = f"""WITH {O.hits_ctes(O.DOCS)}, {O.SPANS}, {O.FINAL}, cases AS (SELECT doc_id, CASE WHEN contains(text, 'token = ') THEN 'block' WHEN contains(text, '@') THEN 'redact' ELSE 'allow' END AS expected,
  coalesce(final_action, 'allow') AS actual FROM documents LEFT JOIN final ON k = doc_id)"""


def replayed(spark, sf):
    expected = F.when(F.contains("text", F.lit("token = ")), "block").when(F.contains("text", F.lit("@")), "redact").otherwise("allow")
    cases = documents(spark, sf).withColumn("expected", expected)
    return S.resolve(S.detect_text(cases, "text")).select("doc_id", "expected", F.col("final_action").alias("actual"))


@add("e1_replay", f"{CASES} SELECT doc_id, expected, actual, expected = actual AS policy_match FROM cases")
def replay(spark, sf):
    """Every document as a case: expected against actual action."""
    return replayed(spark, sf).withColumn("policy_match", F.col("expected") == F.col("actual"))


@add("e2_report_totals", f"{CASES} SELECT count(*) AS total, count(*) FILTER (expected = actual) AS passed FROM cases")
def report_totals(spark, sf):
    """Cases and passes."""
    return replayed(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.col("expected") == F.col("actual")).alias("passed"))


def annotated(spark, sf):
    i, v = F.col("doc_id"), F.concat(F.lit("v"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(
        "doc_id", "source", F.when(i % 3 == 0, F.array(F.struct(F.upper("lang").alias("label"), v.alias("value")))).alias("privacy_mask"),
        F.when(i % 3 == 1, F.concat(F.lit("[{start: 0, end: 2, text: '"), v, F.lit("', label: '"), F.col("lang"), F.lit("'}]"))).alias("spans"),
        F.when(i % 3 == 2, F.concat(F.lit('[{"entity": "'), v, F.lit("\", types: ['"), F.col("lang"), F.lit("', 'any']}]"))).alias("entities"))


def annotation_rows(spark, sf):
    a = annotated(spark, sf).withColumn("a", E.annotations(F.col("privacy_mask"), F.col("spans"), F.col("entities")))
    return explode_once(a, "a", "a", "doc_id", "source").select("doc_id", "source", "a.label", "a.value")


ANN = """ann AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS label, 'v' || doc_id AS value FROM documents UNION ALL SELECT doc_id, source, 'any', 'v' || doc_id FROM documents WHERE doc_id % 3 = 2)"""


@add("e3_annotations", f"WITH {ANN} SELECT * FROM ann")
def annotation_query(spark, sf):
    """Annotations from the three dataset shapes."""
    return annotation_rows(spark, sf)


def gold_and_found(spark, sf):
    w = spans(documents(spark, sf), "doc_id", NAME, "lang")
    entity = F.when(F.char_length("s.v") % 2 == 0, "person").otherwise("organization")
    st, en = F.col("s.st"), F.col("s.en")
    gold = w.select("doc_id", "lang", entity.alias("entity"), st.alias("st"), en.alias("en"))
    moved = w.filter(st % 5 != 0).select("doc_id", "lang", entity.alias("entity"), (st + st % 4).alias("st"), (en + st % 4).alias("en"))
    return gold, moved


GF = f"""leaves AS ({O.DOCS}), w AS MATERIALIZED (SELECT k AS doc_id, lang, st, en, CASE WHEN length(v) % 2 = 0 THEN 'person' ELSE 'organization' END AS entity FROM ({O.spans_of('leaves', NAME)}) JOIN documents ON doc_id = k),
  g AS (FROM w), p AS (SELECT doc_id, lang, st + st % 4 AS st, en + st % 4 AS en, entity FROM w WHERE st % 5 <> 0),
  m AS MATERIALIZED (SELECT g.doc_id, g.lang, g.entity, g.st AS g_st, g.en AS g_en, p.st AS p_st, p.en AS p_en FROM g JOIN p ON g.doc_id = p.doc_id AND g.entity = p.entity AND g.st < p.en AND p.st < g.en
    WHERE 2 * (least(g.en, p.en) - greatest(g.st, p.st)) >= least(g.en - g.st, p.en - p.st))"""


@add("e4_span_matches", f"WITH {GF} SELECT doc_id, entity, g_st::BIGINT AS g_st, p_st::BIGINT AS p_st FROM m")
def span_match_query(spark, sf):
    """Gold and found spans that match."""
    m = E.span_matches(*gold_and_found(spark, sf))
    return m.select("doc_id", "entity", F.col("g_st").cast("bigint").alias("g_st"), F.col("p_st").cast("bigint").alias("p_st"))


@add("e5_detection_metrics", f"""WITH {GF}, r AS (SELECT entity, lang, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.doc_id = g.doc_id AND m.entity = g.entity AND m.g_st = g.st) THEN 'tp' ELSE 'fn' END AS k FROM g
    UNION ALL SELECT entity, lang, 'fp' FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = p.doc_id AND m.entity = p.entity AND m.p_st = p.st AND m.p_en = p.en)),
  c AS (SELECT entity, family, lang, count(*) FILTER (k = 'tp') AS tp, count(*) FILTER (k = 'fp') AS fp, count(*) FILTER (k = 'fn') AS fn
    FROM (SELECT *, CASE entity WHEN 'person' THEN 'pii' ELSE 'corporate_markers' END AS family FROM r) GROUP BY GROUPING SETS ((), (entity), (family), (lang))),
  s AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM c)
  SELECT entity, family, lang, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1, round(coalesce(5 * p * r / nullif(4 * p + r, 0), 0.0), 6) AS f2 FROM s""")
def detection_metrics(spark, sf):
    """Precision, recall, F1 and F2 overall, per entity, family and language."""
    both = (df.withColumn("family", N.category(F.col("entity"))) for df in gold_and_found(spark, sf))
    return E.detection_metrics(*both, by=("family", "lang"))


@add("e6_expected_redaction", "SELECT doc_id, md5(replace(replace(text, 'tion', '[REDACTED]'), 'an', '[REDACTED]')) AS text_md5 FROM documents")
def expected_redaction(spark, sf):
    """Annotated values replaced, longest first."""
    values = F.array(F.lit("an"), F.lit("tion"), F.lit("an"), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.md5(E.expected_redaction(F.col("text"), values)).alias("text_md5"))


@add("e7_label_partition", f"WITH {ANN} SELECT DISTINCT label, 'unmapped' AS problem FROM ann WHERE label NOT IN ('en', 'fr', 'EN', 'any') UNION ALL SELECT DISTINCT label, 'mapped and backlogged' FROM ann WHERE label IN ('fr')")
def label_partition(spark, sf):
    """Labels in neither list, and labels in both."""
    seen = annotation_rows(spark, sf).select("label").distinct()
    mapped = known_size(spark, [("en",), ("fr",), ("EN",)], "label string")
    backlog = known_size(spark, [("any",), ("fr",)], "label string")
    unmapped = seen.join(mapped.union(backlog).distinct(), "label", "left_anti").withColumn("problem", F.lit("unmapped"))
    return unmapped.unionByName(seen.intersect(mapped.intersect(backlog)).withColumn("problem", F.lit("mapped and backlogged")))


@add("e8_label_gaps", f"""WITH {ANN} SELECT label, count(*) AS hits, count(DISTINCT source) AS sources, string_agg(DISTINCT source, ',' ORDER BY source) AS datasets, min(doc_id) AS first_row,
  CASE WHEN count(*) >= 8 THEN 'high' WHEN count(*) >= 4 THEN 'medium' ELSE 'low' END AS bucket, label IN ('en', 'fr') AS supported,
  (SELECT round(count(*) FILTER (label IN ('en', 'fr')) / count(*), 6) FROM ann) AS share FROM ann GROUP BY label""")
def label_gaps(spark, sf):
    """Label coverage report."""
    supported = known_size(spark, [("en",), ("fr",)], "label string")
    return E.label_gaps(annotation_rows(spark, sf).withColumnRenamed("doc_id", "row_idx"), supported)


@add("e8_expansion_candidates", f"""WITH {ANN}, s AS (SELECT label, count(*) AS hits, min({{'source': source, 'row_idx': doc_id}}) AS spot FROM ann GROUP BY label)
  SELECT row_number() OVER (ORDER BY hits DESC, label)::INT AS rank, label, entity, hits, spot.source AS dataset, spot.row_idx AS row_idx
  FROM s JOIN (VALUES ('en', 'person'), ('fr', 'person'), ('de', 'place'), ('any', 'other'), ('none', 'other')) m(label, entity) USING (label) WHERE label <> 'fr'""")
def expansion_candidates(spark, sf):
    """Mapped labels without an assertion, most hits first, with their first row."""
    mapping = known_size(spark, [("en", "person"), ("fr", "person"), ("de", "place"), ("any", "other"), ("none", "other")], "label string, entity string")
    return E.expansion_candidates(annotation_rows(spark, sf).withColumnRenamed("doc_id", "row_idx"), mapping, known_size(spark, [("fr",)], "label string"))


@add("e9_parity", "SELECT coalesce(a.source, b.source) AS source, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM (SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL) a FULL JOIN (SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY ALL) b ON a.source = b.source")
def parity(spark, sf):
    """Deltas of one run (even documents) against another (odd)."""
    def run(rest):
        return table(spark, sf, "documents").filter(F.col("doc_id") % 2 == rest).groupBy("source").agg(F.count("*").alias("n"))
    return E.parity(run(0), run(1), "source", "n")


@add("e10_quality_gates", "SELECT level, blocking, bool_and(output IN (SELECT DISTINCT event_type FROM events)) AS passed FROM (VALUES ('one', true, 'click'), ('one', true, 'view'), ('two', false, 'refund'), ('two', false, 'view')) r(level, blocking, output) GROUP BY ALL")
def quality_gates(spark, sf):
    """Gate levels whose required outputs all exist."""
    required = known_size(spark, [("one", True, "click"), ("one", True, "view"), ("two", False, "refund"), ("two", False, "view")], "level string, blocking boolean, output string")
    return E.gates(required, table(spark, sf, "events").select(F.col("event_type").alias("output")))


@add("e13_security_rates", f"{CASES} SELECT round(avg((actual = 'allow')::INT), 6) AS bypass_rate, round(avg((actual = expected)::INT), 6) AS correct_rate FROM cases WHERE expected <> 'allow'")
def security_rates(spark, sf):
    """Share of sensitive cases that slipped through and that were handled as expected."""
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    adversarial = F.when(F.col("expected") != "allow", F.col("actual"))
    return replayed(spark, sf).agg(rate(adversarial == "allow").alias("bypass_rate"), rate(adversarial == F.col("expected")).alias("correct_rate"))


@add("e14_latency_summary", f"""WITH a AS ({AUDIT}), r AS (SELECT event_type, duration_ms, row_number() OVER (PARTITION BY event_type ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM a),
  p AS (SELECT event_type, min(duration_ms) FILTER (i = (n - 1) * 50 // 100) AS p50, min(duration_ms) FILTER (i = (n - 1) * 95 // 100) AS p95, min(duration_ms) FILTER (i = (n - 1) * 99 // 100) AS p99 FROM r GROUP BY ALL) SELECT *, p95 <= 50 AND p99 <= 100 AS passed FROM p""")
def latency_summary(spark, sf):
    """P50, P95, P99 against the pass thresholds."""
    p = MT.nearest_rank(audit_events(spark, sf), "duration_ms", [50, 95, 99], "event_type")
    return p.withColumn("passed", (F.col("p95") <= 50) & (F.col("p99") <= 100))


@add("s3_row_texts", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def row_texts(spark, sf):
    """The first non-blank text column."""
    df = table(spark, sf, "documents").withColumn("source_text", F.lit("  "))
    return df.select("doc_id", F.md5(E.row_text(df)).alias("text_md5"))


@add("s4_payload_adapter", "SELECT doc_id, md5(text) AS content_md5 FROM documents")
def payload_adapter(spark, sf):
    """Plain texts wrapped as chat payloads."""
    df = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(F.array(F.struct(F.col("text").alias("content"))).alias("messages"))).alias("p"))
    return df.select("doc_id", F.md5(F.get_json_object("p", "$.messages[0].content")).alias("content_md5"))
