"""Entity queries; words of documents play tokens, with labels derived from the words."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions import match as M
from veilframe.functions.arrays import explode_once, pinned
from veilframe.operators import entities as E
from veilframe.operators import ner as N
from veilframe.operators import sanitize as S
from veilframe.operators.rules import Rule
from veilframe.plans import oracle as O
from veilframe.plans.detection import documents
from veilframe.plans.payloads import CHAT, chats
from veilframe.sources.tables import known_size, table

QUERIES, ORACLES = {}, {}
WORD = "[A-Za-z]+"
NAME = "[A-Z][a-z]{8,}"


def add(name, oracle=None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


def spans(df, key, pattern, *keep):
    staged = df.select(key, "text", *keep).withColumn("s", pinned(M.match_spans("text", pattern)))
    return staged.select(key, "text", *keep, F.posexplode_outer("s").alias("tok_idx", "s")).filter("s is not null")


def label_of(word):
    """Capitals open a person, words of three letters go on, of five change kind."""
    return F.when(F.ascii(word).between(65, 90), "B-PER").when(F.char_length(word) == 3, "I-PER").when(
        F.char_length(word) == 5, "I-ORG").otherwise("O")


def tokens(spark, sf):
    """A token per word."""
    n = F.char_length("s.v").cast("double")
    return spans(documents(spark, sf), "doc_id", WORD).select(
        F.col("doc_id").alias("text_id"), "tok_idx", label_of(F.col("s.v")).alias("label"), F.col("s.st").alias("st"), F.col("s.en").alias("en"),
        F.array(n % 4, (F.col("tok_idx") % 5).cast("double"), (F.col("s.st") % 3).cast("double")).alias("logits"))


def decoded(spark, sf, **kw):
    """The words of each document as tokens of one row, and the spans they make."""
    words = documents(spark, sf).select(F.col("doc_id").alias("text_id"), pinned(M.match_spans("text", WORD)).alias("w"))
    n = lambda w: F.char_length(w["v"]).cast("double")
    toks = F.transform("w", lambda w, i: F.struct(
        label_of(w["v"]).alias("label"), w["st"].alias("st"), w["en"].alias("en"),
        F.array(n(w) % 4, (i % 5).cast("double"), (w["st"] % 3).cast("double")).alias("logits")))
    spans_ = words.select("text_id", pinned(toks).alias("t")).select("text_id", pinned(N.bio_spans(F.col("t"), **kw)).alias("s"))
    return explode_once(spans_, "s", "s", "text_id")


TOK = f"""leaves AS ({O.DOCS}), tok AS MATERIALIZED (SELECT k AS text_id, match_seq AS tok_idx, st, en, v, CASE WHEN regexp_matches(v, '^[A-Z]') THEN 'B-PER' WHEN length(v) = 3 THEN 'I-PER' WHEN length(v) = 5 THEN 'I-ORG' ELSE 'O' END AS label,
  [(length(v) % 4)::DOUBLE, (match_seq % 5)::DOUBLE, (st % 3)::DOUBLE] AS logits FROM ({O.spans_of('leaves', WORD)}))"""


@add("n1_candidates", """SELECT doc_id, octet_length(encode(text)) >= 3 AND regexp_matches(trim(text), '\\p{L}') AND NOT (regexp_matches(trim(text), '^[0-9]') AND (contains(text, ':') OR contains(text, '-') OR contains(text, '/'))) AS candidate FROM documents""")
def candidates(spark, sf):
    """Texts worth a model run."""
    return documents(spark, sf).select("doc_id", N.is_candidate(F.col("text")).alias("candidate"))


@add("n2_skipped_pointers", f"SELECT request_id, ptr FROM ({CHAT}) WHERE NOT (starts_with(ptr, '/tools') OR ptr = '/messages/0/content' OR (ptr = '/messages/1/content' AND role = 'system') OR ptr LIKE '%/role')")
def skipped_pointers(spark, sf):
    """Leaves of chat requests that reach the model."""
    df = S.with_leaves(chats(spark, sf), "payload").withColumn("roles", F.array(F.lit("system"), F.col("role")))
    x = explode_once(df, "leaves", "l", "request_id", "roles")
    return x.filter(~N.skipped_pointer(F.col("l.ptr"), F.lit("llm"), F.col("roles"), ("^role$",))).select("request_id", "l.ptr")


def long_names():
    """A stand-in model: long capitalised words are persons."""
    import re

    pattern = re.compile(NAME)
    return lambda texts: [[("person", m.start(), m.end(), 0.9, "en") for m in pattern.finditer(t)] for t in texts]


@add("n3_recognized_texts", f"""WITH leaves AS ({O.DOCS}) SELECT k AS doc_id, st, en, 'ner.person.en' AS rule_id FROM ({O.spans_of('leaves', NAME)})""")
def recognized_texts(spark, sf):
    """Distinct texts through the model, results fanned back to every document."""
    found = N.recognize_distinct(documents(spark, sf).select("doc_id", "text"), "text", long_names)
    x = explode_once(found, "ner_spans", "s", "doc_id")
    return x.select("doc_id", F.col("s.st").cast("bigint").alias("st"), F.col("s.en").cast("bigint").alias("en"), N.rule_id(F.col("s.entity"), F.col("s.lang")).alias("rule_id"))


@add("n4_languages", "SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[\\x{0400}-\\x{04FF}]')) > len(regexp_extract_all(text, '[A-Za-z]')) THEN 'ru' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS lang FROM documents")
def languages(spark, sf):
    """Script-based language."""
    return documents(spark, sf).select("doc_id", N.language(F.col("text")).alias("lang"))


BIO = f"""{TOK}, e AS (SELECT *, CASE WHEN label <> 'O' THEN substring(label, 3) END AS entity FROM tok),
  f AS (SELECT *, entity IS NOT NULL AND (label LIKE 'B-%' OR lag(entity) OVER (PARTITION BY text_id ORDER BY tok_idx) IS DISTINCT FROM entity) AS opens FROM e),
  g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY text_id ORDER BY tok_idx) AS n FROM f)"""


@add("n5_bio_spans", f"WITH {BIO} SELECT text_id, entity, min(tok_idx)::BIGINT AS first_token, max(tok_idx)::BIGINT AS last_token, min(st)::BIGINT AS st, max(en)::BIGINT AS en FROM g WHERE entity IS NOT NULL GROUP BY text_id, n, entity")
def bio(spark, sf):
    """Token labels to entity spans."""
    return decoded(spark, sf, scored=False).select("text_id", "s.entity", *[F.col(f"s.{c}").cast("bigint").alias(c) for c in ("first_token", "last_token", "st", "en")])


@add("n6_best_labels", f"WITH {TOK} SELECT list_position(logits, list_max(logits))::BIGINT - 1 AS label_idx, count(*) AS tokens FROM tok GROUP BY ALL")
def best_labels(spark, sf):
    """First best label per token, counted."""
    return tokens(spark, sf).groupBy(N.best_label(F.col("logits")).alias("label_idx")).agg(F.count("*").alias("tokens"))


@add("n7_confidence", f"""WITH {BIO}, p AS (SELECT text_id, entity, n, st, en, 1 / (exp(logits[1] - list_max(logits)) + exp(logits[2] - list_max(logits)) + exp(logits[3] - list_max(logits))) AS p FROM g WHERE entity IS NOT NULL)
  SELECT text_id, entity, min(st)::BIGINT AS st, max(en)::BIGINT AS en, round(avg(p), 6) AS score FROM p GROUP BY text_id, entity, n HAVING avg(p) >= 0.7""")
def confidence(spark, sf):
    """Spans whose labels have a mean probability above the threshold."""
    return decoded(spark, sf, threshold=N.THRESHOLD).select("text_id", "s.entity", *[F.col(f"s.{c}").cast("bigint").alias(c) for c in ("st", "en")],
                                                  F.round("s.score", 6).alias("score"))


@add("n8_model_choice", "SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 3 ELSE 2 END::BIGINT AS model_idx FROM documents")
def model_choice(spark, sf):
    """Model index per document language."""
    models = known_size(spark, [(0, "en", 10), (1, "en", 20), (2, "ru", 5), (3, "fr", 1)], "idx bigint, language string, priority int")
    return N.pick_models(documents(spark, sf).select("doc_id", "lang"), models, "ru").select("doc_id", "model_idx")


def model_hits(spark, sf):
    """Hits of three pretend models that often agree or overlap."""
    w = spans(documents(spark, sf), "doc_id", "[A-Z][a-z]+")
    hit = lambda m, e, grow, mod: F.struct(F.lit(m).alias("model_idx"), F.lit(e).alias("entity"), F.col("s.st").alias("st"), (F.col("s.en") + grow).alias("en"),
                                        ((F.col("s.st") % mod) / F.lit(float(mod))).alias("score"))
    return w.select(F.col("doc_id").alias("text_id"), F.explode(F.array(hit(0, "person", 0, 7), hit(1, "organization", 0, 11), hit(2, "organization", 4, 13))).alias("h")).select("text_id", "h.*")


MH = f"leaves AS ({O.DOCS}), m AS (SELECT k AS text_id, st, en, v FROM ({O.spans_of('leaves', '[A-Z][a-z]+')})), mh AS MATERIALIZED (SELECT text_id, 0 AS model_idx, 'person' AS entity, st, en, (st % 7) / 7.0::DOUBLE AS score FROM m UNION ALL SELECT text_id, 1, 'organization', st, en, (st % 11) / 11.0::DOUBLE FROM m UNION ALL SELECT text_id, 2, 'organization', st, en + 4, (st % 13) / 13.0::DOUBLE FROM m)"


@add("n9_merged_union", f"WITH {MH} SELECT text_id, st::BIGINT AS st, en::BIGINT AS en, arg_max(entity, {{'s': score, 'm': -model_idx}}) AS entity, round(max(score), 6) AS score FROM mh GROUP BY text_id, st, en")
def merged_union(spark, sf):
    """Best hit per exact range."""
    return N.merge_union(model_hits(spark, sf)).select("text_id", F.col("st").cast("bigint").alias("st"), F.col("en").cast("bigint").alias("en"), "entity", F.round("score", 6).alias("score"))


@add("n10_merged_highest", f"""WITH RECURSIVE leaves AS ({O.DOCS}), w AS (SELECT k, st, en FROM ({O.spans_of('leaves', NAME)})),
  h AS (SELECT k, st, en, (st % 7) / 7.0::DOUBLE AS score FROM w UNION ALL SELECT k, st, en + 4, (st % 13) / 13.0::DOUBLE FROM w),
  o AS MATERIALIZED (SELECT k, list({{'st': st, 'en': en, 'score': score}} ORDER BY score DESC, st, en) AS hs FROM h GROUP BY k),
  s(k, hs, i, kept) AS (SELECT k, hs, 1, hs[:0] FROM o UNION ALL SELECT k, hs, i + 1,
    CASE WHEN len(list_filter(kept, lambda x: x.st < hs[i].en AND hs[i].st < x.en)) > 0 THEN kept ELSE list_append(kept, hs[i]) END FROM s WHERE i <= len(hs))
  SELECT k AS doc_id, x.st::BIGINT AS st, x.en::BIGINT AS en, round(x.score, 6) AS score FROM (SELECT k, unnest(kept) AS x FROM s WHERE i = len(hs) + 1)""")
def merged_highest(spark, sf):
    """Greedy non-overlapping hits per text, chosen by score."""
    staged = documents(spark, sf).select("doc_id", "text").withColumn("w", pinned(M.match_spans("text", NAME)))
    hits = F.flatten(F.transform("w", lambda s: F.array(
        F.struct(s["st"].alias("st"), s["en"].alias("en"), ((s["st"] % 7) / F.lit(7.0)).alias("score")),
        F.struct(s["st"].alias("st"), (s["en"] + 4).alias("en"), ((s["st"] % 13) / F.lit(13.0)).alias("score")))))
    merged = staged.select("doc_id", pinned(hits).alias("h")).select("doc_id", pinned(N.merge_highest(F.col("h"))).alias("m"))
    return explode_once(merged, "m", "m", "doc_id").select(
        "doc_id", F.col("m.st").cast("bigint").alias("st"), F.col("m.en").cast("bigint").alias("en"), F.round("m.score", 6).alias("score"))


@add("n11_blanked_regions", "SELECT doc_id, md5(regexp_replace(text, '[0-9]', ' ', 'g')) AS text_md5 FROM documents")
def blanked_regions(spark, sf):
    """Digits blanked out, length kept."""
    df = documents(spark, sf).select("doc_id", "text").withColumn("s", pinned(M.match_spans("text", "[0-9]+")))
    return df.select("doc_id", F.md5(N.blank_regions(F.col("text"), F.col("s"))).alias("text_md5"))


@add("n12_widened_spans", f"""WITH leaves AS ({O.DOCS}), m AS (SELECT k AS doc_id, text, st + 2 AS st, en - 1 AS en FROM ({O.spans_of('leaves', NAME)}))
  SELECT doc_id, (st - length(regexp_extract(substring(text, 1, st), '[\\p{{L}}\\p{{N}}_''-]*$')))::BIGINT AS st, (en + length(regexp_extract(substring(text, en + 1), '^[\\p{{L}}\\p{{N}}_''-]*')))::BIGINT AS en FROM m""")
def widened_spans(spark, sf):
    """Spans inside words grown to the whole word."""
    w = spans(documents(spark, sf), "doc_id", NAME)
    st, en = N.widened(F.col("text"), F.col("s.st") + 2, F.col("s.en") - 1)
    return w.select("doc_id", st.cast("bigint").alias("st"), en.cast("bigint").alias("en"))


@add("n13_excluded_hits", f"WITH leaves AS ({O.DOCS}) SELECT k AS doc_id, st FROM ({O.spans_of('leaves', NAME)}) WHERE NOT regexp_matches(v, '^[AEIOU]')")
def excluded_hits(spark, sf):
    """Hits kept after exclusion patterns."""
    w = spans(documents(spark, sf), "doc_id", NAME)
    return w.filter(~N.excluded(F.concat(F.lit('"'), F.col("s.v"), F.lit('"')), ("^[AEIOU]",))).select("doc_id", F.col("s.st").cast("bigint").alias("st"))


ENT = "CASE WHEN length(v) % 2 = 0 THEN 'person' ELSE 'organization' END"


@add("n14_entity_hits", f"WITH leaves AS ({O.DOCS}) SELECT 'ner.' || {ENT} || '.en' AS rule_id, CASE {ENT} WHEN 'person' THEN 'pii' ELSE 'corporate_markers' END AS category, 200::BIGINT AS priority, CASE {ENT} WHEN 'person' THEN 'redact' ELSE 'mask' END AS action, count(*) AS hits FROM ({O.spans_of('leaves', NAME)}) GROUP BY ALL")
def entity_hits(spark, sf):
    """Entity spans as policy hits under the strict profile."""
    entity = F.when(F.char_length("s.v") % 2 == 0, "person").otherwise("organization")
    df = spans(documents(spark, sf), "doc_id", NAME).select(entity.alias("entity"))
    cat = N.category(F.col("entity"))
    action = F.when(cat == "pii", S.DEFAULT_POLICY.by_id["strict"].action_for("pii")).otherwise(S.DEFAULT_POLICY.by_id["strict"].action_for("corporate_markers"))
    return df.groupBy(N.rule_id(F.col("entity"), F.lit("en")).alias("rule_id"), cat.alias("category"), F.lit(N.PRIORITY).cast("bigint").alias("priority"), action.alias("action")).agg(F.count("*").alias("hits"))


@add("n15_profile_entities", f"WITH {MH} SELECT CASE WHEN text_id % 2 = 0 THEN 'strict' ELSE 'custom' END AS profile, entity, count(*) AS hits FROM mh WHERE text_id % 2 = 0 OR entity = 'person' GROUP BY ALL")
def profile_entities(spark, sf):
    """Hits of the entity types a profile asks for."""
    types = known_size(spark, [("strict", ["person", "organization"]), ("custom", ["person"])], "profile string, types array<string>")
    h = model_hits(spark, sf).withColumn("profile", F.when(F.col("text_id") % 2 == 0, "strict").otherwise("custom"))
    return h.join(types, "profile").filter(F.array_contains("types", F.col("entity"))).groupBy("profile", "entity").agg(F.count("*").alias("hits"))


@add("n16_degraded_actions", "SELECT CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'block' ELSE 'allow' END AS action, count(*) AS docs FROM documents GROUP BY ALL")
def degraded_actions(spark, sf):
    """Failed runs block where the profile fails closed and enforces."""
    status = F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("ok")
    mode = F.when(F.col("doc_id") % 2 == 0, "enforce").otherwise("dry_run")
    return table(spark, sf, "documents").groupBy(N.degraded_action(F.lit("allow"), status, F.lit("fail_closed"), mode).alias("action")).agg(F.count("*").alias("docs"))


CORE, TOKEN = "[A-Z][a-z]{5,}", "[\\p{L}\\p{N}_'-]*[A-Z][a-z]{5,}[\\p{L}\\p{N}_'-]*"
READ = """SELECT * FROM leaves WHERE octet_length(encode(text)) >= 3 AND regexp_matches(text, '\\p{L}')
  AND NOT (regexp_matches(trim(text), '^[0-9]') AND regexp_matches(text, '[:/-]'))"""


def capital_cores():
    """A stand-in model: long runs of letters after a capital are persons; their tokens may be longer."""
    import re

    pattern = re.compile(CORE)
    return lambda texts: [[("person", m.start(), m.end(), 0.9, "en") for m in pattern.finditer(t)] for t in texts]


TURNS = """SELECT conv_id || '-' || turn AS k, v.* FROM conversations, LATERAL (VALUES
  (0, '/content', conversations.text), (1, '/role', conversations.role)) v(leaf_seq, ptr, text)"""
PERSON_HIT = Rule("ner.person.en", "pii", TOKEN, N.PRIORITY)


@add("n17_entity_pipeline", f"""
  WITH leaves AS MATERIALIZED ({TURNS}), read AS ({READ}),
  hits AS MATERIALIZED ({" UNION ALL ".join([*(O.rule_sql(r, i, "leaves", S.DEFAULT_POLICY.by_id["strict"].action_for(r.category)) for i, r in enumerate(O.BUILTIN_RULES)), O.rule_sql(PERSON_HIT, 1_000_000, "read", "redact")])}),
  {O.SPANS}, {O.FINAL}, {O.rewritten_ctes(4)}, h AS (SELECT k, count(*) AS n, count(*) FILTER (rule_id LIKE 'ner.%') AS entities FROM hits GROUP BY k)
  SELECT l.k AS request_id, coalesce(f.final_action, 'allow') AS final_action, coalesce(h.n, 0)::BIGINT AS hits, coalesce(h.entities, 0)::BIGINT AS entities,
    CASE WHEN coalesce(f.final_action, '') <> 'block' THEN md5(coalesce(r.new_text, l.text)) END AS content_md5
  FROM leaves l LEFT JOIN final f ON f.k = l.k LEFT JOIN h ON h.k = l.k LEFT JOIN rewritten r ON r.k = l.k AND r.leaf_seq = 0 WHERE l.leaf_seq = 0""")
def entity_pipeline(spark, sf):
    """Turns of conversations masked by rules and by a model's persons together."""
    req = table(spark, sf, "conversations").select(
        F.expr("concat_ws('-', cast(conv_id as string), cast(turn as string))").alias("request_id"), F.lit("strict").alias("effective_profile"),
        F.lit("enforce").alias("mode"), F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("payload"))
    out = E.evaluate_with_entities(req, capital_cores, trace=True)
    return out.select("request_id", "final_action", F.size("hits").cast("bigint").alias("hits"),
                      F.expr("cast(size(filter(hits, h -> startswith(h.rule_id, 'ner.'))) as bigint)").alias("entities"),
                      F.md5(F.get_json_object("sanitized_payload", "$.content")).alias("content_md5"))
