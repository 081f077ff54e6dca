"""Personal data: patterns with offsets, and terms that disclose a protected value by co-occurrence.

Everything here is DataFrame and SQL functions.

Terms are counted in whole documents, over the whole corpus. Protected are single values and their kinds: a
term discloses one when documents with the term hold it far more often than chance. Its pointwise mutual
information and the posterior of the protected entity given the term must both reach their thresholds, with
enough documents, different contexts and weight of evidence. Disclosing terms are removed, or generalised
where the posterior is lower.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import staged


@dataclass(frozen=True)
class Thresholds:
    """Documents and different contexts needed, bits of information, posteriors that generalise or remove a term.

    No term can tell more than the entity itself holds, which is little for a frequent one; there ``share`` of
    that is asked for in place of ``bits``. ``evidence`` is the weight in bits of all documents with the term
    against chance: 20 bits let one in a million chance terms through.
    """

    contexts: int = 3
    bits: float = 6.0
    generalise: float = 0.5
    remove: float = 0.9
    share: float = 0.8
    evidence: float = 20.0


OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
OCTET_CHECK = r"\.".join([OCTET] * 4)
#: Kinds in the order of the listing: pattern, cheap condition of any match, check of a match. Possessive
#: quantifiers and the look-behinds leave the leftmost matches as they are and keep long runs linear.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
              "contains({t}, '@')", "true"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
           r"rlike({t}, r'[0-9]\.[0-9]++\.[0-9]++\.[0-9]')",
           "rlike({v}, r'^" + OCTET_CHECK + "$')"),
    "card": (r"[0-9](?:[ -]?+[0-9])++", r"rlike({t}, r'[0-9](?:[ -]?+[0-9]){{13}}')",
             "(char_length(regexp_replace({v}, '[ -]', '')) between 14 and 19 and luhn_check(regexp_replace({v}, '[ -]', '')))"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "contains({t}, '+')",
              "char_length(regexp_replace({v}, '[^0-9]', '')) between 10 and 15"),
}
TERM = r"\p{L}{4,}+"
#: Terms and what stands for a replaced match, which is no term.
MARKED = r"\[(?:" + "|".join(kind.upper() for kind in KINDS) + r")\]|" + TERM
BLOCK = 256
HIT = "array<struct<st:int,k:int,en:int,kind:string,v:string>>"


def hits_sql(text: str, pattern: str, k: int, kind: str, valid: str) -> str:
    """Checked matches with character offsets: gaps and matches alternate, a blocked running length places them."""
    p = f"r'{pattern}'"
    steps = "zip_with(gaps, hits, (g, v) -> struct(g as gap, v))"
    length = "char_length(x.gap) + coalesce(char_length(x.v), 0)"
    inner = f"""aggregate(b.steps, struct(b.base as pos, cast(array() as {HIT}) as out),
        (acc, x) -> struct(acc.pos + {length} as pos,
          if(x.v is not null and {valid.format(v='x.v')},
             concat(acc.out, array(struct(acc.pos + char_length(x.gap) as st, {k} as k, acc.pos + {length} as en,
                                          '{kind}' as kind, x.v as v))), acc.out) as out),
        acc -> acc.out)"""
    blocks = f"""aggregate(
        transform(sequence(0, (size(steps) - 1) div {BLOCK}), j -> slice(steps, j * {BLOCK} + 1, {BLOCK})),
        struct(0 as base, cast(array() as array<struct<base:int,steps:array<struct<gap:string,v:string>>>>) as out),
        (acc, part) -> struct(acc.base + aggregate(part, 0, (n, x) -> n + {length}) as base,
                              concat(acc.out, array(struct(acc.base as base, part as steps))) as out),
        acc -> acc.out)"""
    return f"""flatten(transform(transform(array(struct(split({text}, {p}, -1) as gaps, regexp_extract_all({text}, {p}, 0) as hits)),
        s -> {steps.replace('gaps', 's.gaps').replace('hits', 's.hits')}),
        steps -> flatten(transform({blocks}, b -> {inner}))))"""


def base_hits(text: str) -> str:
    """All checked matches of all kinds in ``text``, by start and then kind."""
    parts = []
    for k, (kind, (pattern, guard, valid)) in enumerate(KINDS.items()):
        parts.append(f"if({guard.format(t=text)}, {hits_sql(text, pattern, k, kind, valid)}, cast(array() as {HIT}))")
    return f"array_sort(concat({', '.join(parts)}))"


def words_sql(text: str) -> str:
    """All terms of ``text`` in order, outside of addresses; matches of other kinds hold no letters."""
    pattern, guard, _ = KINDS["email"]
    bare = f"if({guard.format(t=text)}, regexp_replace({text}, r'{pattern}', '\\n'), {text})"
    return f"regexp_extract_all(lower({bare}), r'{TERM}', 0)"


def find_base(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, text_key, hits, words`` per row; the key tells texts of one id apart, rows without hits have no words."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = rows.select("doc_id", "t", F.xxhash64("t").alias("text_key"), F.expr(base_hits("t")).alias("hits"))
    return found.select("doc_id", "text_key", "hits", F.expr(
        f"if(size(hits) > 0, {words_sql('t')}, cast(array() as array<string>))").alias("words"))


def disclosing_terms(docs: DataFrame, base: DataFrame, limits: Thresholds = Thresholds(), text: str = "text") -> DataFrame:
    """``term, action, bits, posterior``: terms that give a protected value or kind away, one row each.

    Counts are of rows, over all of them and their whole texts. Contexts are different pairs of neighbouring
    terms, so copies of one document are one piece of evidence. A value in fewer rows than ``contexts`` can
    have no term of its own; it is protected as one of its kind.
    """
    seen = base.filter("size(hits) > 0")
    value = "sha2(concat_ws(':', h.kind, lower(regexp_replace(h.v, r'[ ().-]', ''))), 256)"
    kinds = seen.select("words", F.explode(F.expr("array_distinct(transform(hits, h -> h.kind))")).alias("entity"))
    values = seen.select("words", F.explode(F.expr(f"array_distinct(transform(hits, h -> {value}))")).alias("entity"))
    n_entity = staged(kinds.select("entity").unionByName(values.select("entity")).groupBy("entity").agg(
        F.count("*").alias("n_entity")).filter(F.col("n_entity") >= limits.contexts), "entities")
    held = kinds.unionByName(values.join(n_entity.select("entity"), "entity", "left_semi").select("words", "entity"))
    pairs = held.select("entity", F.explode(F.array_distinct("words")).alias("term")).groupBy("entity", "term").agg(
        F.count("*").alias("n_both")).filter(F.col("n_both") >= limits.contexts)
    terms = docs.select(F.explode(F.array_distinct(F.expr(words_sql(text)))).alias("term")).groupBy("term").agg(
        F.count("*").alias("n_term")).filter(F.col("n_term") >= limits.contexts)
    prior = F.col("n_entity") / F.lit(docs.count())
    rest = F.when(F.col("posterior") < 1, (1 - F.col("posterior")) * F.log2((1 - F.col("posterior")) / (1 - F.col("prior"))))
    scored = (pairs.join(terms, "term").join(n_entity, "entity").withColumn("prior", prior)
              .withColumn("posterior", F.col("n_both") / F.col("n_term"))
              .withColumn("bits", F.log2(F.col("posterior") / F.col("prior")))
              .withColumn("evidence", F.col("n_term") * (F.col("posterior") * F.col("bits") + F.coalesce(rest, F.lit(0.0)))))
    scored = staged(scored.filter(
        (F.col("posterior") >= limits.generalise) & (F.col("evidence") >= limits.evidence)
        & (F.col("bits") >= F.least(F.lit(limits.bits), -limits.share * F.log2("prior")))).select(
        "entity", "term", "posterior", "bits"), "scored")
    steps = "transform(array(words), w -> transform(w, (x, i) -> struct(x as term, xxhash64(get(w, i - 1), get(w, i + 1)) as context)))[0]"
    told = held.join(scored.select("entity").distinct(), "entity", "left_semi").select("entity", F.expr(f"inline({steps})"))
    enough = told.join(scored.select("entity", "term"), ["entity", "term"], "left_semi").distinct().groupBy("entity", "term").agg(
        F.count("*").alias("contexts")).filter(F.col("contexts") >= limits.contexts)
    return (scored.join(enough, ["entity", "term"])
            .groupBy("term").agg(F.max("bits").alias("bits"), F.max("posterior").alias("posterior"))
            .select("term", F.when(F.col("posterior") >= limits.remove, "remove").otherwise("generalise").alias("action"),
                    "bits", "posterior"))


def _with_terms(docs: DataFrame, terms: DataFrame, text: str, key: str) -> DataFrame:
    """``doc_id, text_key, removed, generalised``: the disclosing terms that each document holds."""
    words = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"),
                        F.explode(F.array_distinct(F.expr(words_sql(text)))).alias("term"))
    return words.join(terms, "term").groupBy("doc_id", "text_key").agg(
        F.collect_set(F.when(F.col("action") == "remove", F.col("term"))).alias("removed"),
        F.collect_set(F.when(F.col("action") == "generalise", F.col("term"))).alias("generalised"))


def private_spans(docs: DataFrame, limits: Thresholds = Thresholds(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, hits, terms`` for every row: checked matches, and spans of disclosing terms outside of them.

    Null text counts as empty. Offsets are characters, ends exclusive. Rows with null or repeated ids keep
    their own spans. No rows give no rows.
    """
    base = staged(find_base(docs, text, key), "hits")
    terms = staged(disclosing_terms(docs, base, limits, text), "terms")
    empty = F.expr(f"cast(array() as {HIT})")
    if terms.isEmpty():
        return base.select("doc_id", "hits", empty.alias("terms"))
    held = staged(_with_terms(docs, terms, text, key), "held")  # its size is then known before texts would be shuffled
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn(
        "text_key", F.xxhash64("t"))
    same = rows.doc_id.eqNullSafe(held.doc_id) & (rows.text_key == held.text_key)
    spans = rows.join(held, same).select(
        rows.doc_id, rows.text_key, "removed", "generalised", F.expr(hits_sql("t", TERM, 4, "term", "true")).alias("all"))
    spans = spans.select("doc_id", "text_key", F.expr(
        "filter(all, x -> array_contains(removed, lower(x.v)) or array_contains(generalised, lower(x.v)))").alias("terms")
    ).groupBy("doc_id", "text_key").agg(F.any_value("terms").alias("terms"))
    joined = base.join(spans, base.doc_id.eqNullSafe(spans.doc_id) & (base.text_key == spans.text_key), "left")
    return joined.select(base.doc_id, "hits", F.expr(
        f"filter(coalesce(terms, cast(array() as {HIT})), x -> not exists(hits, h -> h.st < x.en and x.st < h.en))").alias("terms"))


def _replaced(text: str, pattern: str, value: str) -> str:
    """``text`` with each match v of ``pattern`` replaced by the SQL ``value``."""
    p = f"r'{pattern}'"
    return (f"array_join(zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), "
            f"(g, v) -> concat(g, if(v is null, '', {value}))), '')")


def sanitise(docs: DataFrame, limits: Thresholds = Thresholds(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with every checked match replaced by its kind and every disclosing term removed or generalised.

    Columns stay as they are, other than the text; a null text stays null.
    """
    base = staged(find_base(docs, text, key), "hits")
    terms = staged(disclosing_terms(docs, base, limits, text), "terms")
    out = docs.withColumn("__text", F.col(text))
    for kind, (pattern, guard, valid) in KINDS.items():
        changed = _replaced("__text", pattern, f"if({valid.format(v='v')}, '[{kind.upper()}]', v)")
        out = out.withColumn("__text", F.expr(f"if({guard.format(t='__text')}, {changed}, __text)"))
    if not terms.isEmpty():
        held = staged(_with_terms(docs, terms, text, key), "held").withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
        out = out.join(held, F.col(key).eqNullSafe(F.col("__id"))
                       & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__key")), "left")
        value = ("case when array_contains(removed, lower(v)) then '' "
                 "when array_contains(generalised, lower(v)) then '[TERM]' else v end")
        out = out.withColumn("__text", F.expr(f"if(removed is null, __text, {_replaced('__text', MARKED, value)})"))
    return out.select(*(F.col("__text").alias(c) if c == text else F.col(c) for c in docs.columns))
