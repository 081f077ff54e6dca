"""Merkle manifest of a dataset: leaves, roots and proofs from levels kept as strings of hex digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.arrays import explode_once
from veilframe.llm.common import staged

ARITY = 3
#: Levels that one block of a tree climbs at once: 3**5 digests are a string of 15,552 characters.
BLOCK_LEVELS = 5
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*values: Column) -> Column:
    """Digest of the values in turn, each ``-`` if null, else its bytes' number, ``:`` and itself."""
    def told(value: Column) -> Column:
        as_text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(as_text).cast("string"), F.lit(":"), as_text), F.lit("-"))

    return F.sha2(F.concat(*map(told, values)), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with their place in the group (``at``, from 0) and its size (``many``).

    Rows are dealt to tasks by ranges of group and order, equal ones by where they were read, so a large
    group is many tasks. Each task numbers its own; what earlier tasks hold of the group is added from
    a table with a row for each task and group in it.
    """
    laid = rows.withColumn("seen", F.monotonically_increasing_id())
    laid = laid.repartitionByRange(group, *order, "seen").sortWithinPartitions(group, *order, "seen").drop("seen")
    laid = staged(laid.withColumn("spot", F.monotonically_increasing_id()).withColumn("part", F.expr("shiftright(spot, 33)")), "numbered")
    tally = laid.groupBy(group, "part").agg(F.min("spot").alias("first"), F.count("*").alias("n"))
    tally = tally.selectExpr(group, "part", f"first - sum(n) over (partition by {group} order by part) + n as first",
                             f"sum(n) over (partition by {group}) as many")
    return laid.join(tally, [group, "part"]).withColumn("at", F.col("spot") - F.col("first")).drop("spot", "part", "first")


def climbed(nodes: DataFrame, largest: int, crown) -> DataFrame:
    """Path and root of every node of the trees of all groups.

    ``nodes`` has ``g`` (group), ``at``, ``many``, ``digest`` and ``payload``; ``largest`` is the largest
    ``many``. Aligned blocks of nodes climb up to ``BLOCK_LEVELS`` levels as strings; their tops are the
    nodes of the next climb. ``crown`` takes the groups' roots (``g, digest``) and tells ``g, path, root``
    of what lies above them. Returns ``g, at, digest, payload, path, root`` and ``subroot``, the root of
    the group; a path has a pair of sibling strings for each level, left and right of the node's run.
    """
    width, step = ARITY**BLOCK_LEVELS, ARITY * DIGEST
    rise = "case {} else {} end".format(
        " ".join(f"when many <= {ARITY**k} then {k}" for k in range(BLOCK_LEVELS)), BLOCK_LEVELS)
    blocks = nodes.groupBy("g", F.expr(f"at div {width}").alias("block"), "many").agg(
        F.array_sort(F.collect_list(F.struct("at", "digest", "payload"))).alias("members"))
    blocks = blocks.select("g", "block", "many", F.expr("transform(members, m -> m.payload)").alias("payloads"),
                           F.expr("array_join(transform(members, m -> m.digest), '')").alias("level0"))
    levels = [f"level{k}" for k in range(BLOCK_LEVELS + 1)]

    def with_levels(df: DataFrame) -> DataFrame:
        df = df.withColumn("rise", F.expr(rise))
        for k, (below, level) in enumerate(zip(levels, levels[1:])):
            df = df.withColumn(level, F.expr(
                f"case when rise > {k} then array_join(transform(sequence(0, (length({below}) - 1) div {step}), "
                f"i -> sha2(substring({below}, i * {step} + 1, {step}), 256)), '') else {below} end"))
        return df

    blocks = staged(with_levels(blocks).select("g", "block", "many", "payloads", "level0", F.col(levels[-1]).alias("top")), "blocks")
    tops = blocks.select("g", F.col("block").alias("at"), F.expr(f"(many + {width - 1}) div {width}").alias("many"),
                         F.col("top").alias("digest"))
    if largest > width:
        above = climbed(tops.withColumn("payload", F.lit(None).cast("int")), -(-largest // width), crown)
    else:
        above = crown(tops.select("g", "digest")).join(tops.select("g", F.col("digest").alias("subroot")), "g").withColumn(
            "at", F.lit(0).cast("long"))
    above = above.select("g", F.col("at").alias("block"), F.col("path").alias("further"), "subroot", "root")

    def pair(k: int) -> str:
        spot, level = f"(p div {ARITY**k})", levels[k]
        run = f"({spot} div {ARITY}) * {step}"
        return (f"struct(substring({level}, {run} + 1, ({spot} % {ARITY}) * {DIGEST}) as lefts, "
                f"substring({level}, {spot} * {DIGEST} + {DIGEST + 1}, ({ARITY - 1} - {spot} % {ARITY}) * {DIGEST}) as rights)")

    paths = f"slice(array({', '.join(map(pair, range(BLOCK_LEVELS)))}), 1, rise)"
    joined = with_levels(blocks.join(above, ["g", "block"]))
    members = F.expr(f"transform(payloads, (m, p) -> struct(p, m as payload, "
                     f"substring(level0, p * {DIGEST} + 1, {DIGEST}) as digest, {paths} as path))")
    return explode_once(joined, members, "m", "g", "block", "further", "subroot", "root").select(
        "g", F.expr(f"block * {width} + m.p").alias("at"), "m.digest", "m.payload",
        F.concat("m.path", "further").alias("path"), "subroot", "root")


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("many")).first()[0] or 0


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    A leaf is the digest of the row's ``doc_id, source, lang, n_chars, text``; other columns do not
    count. Leaves of a source ascend by id (null first, equal ids by digest; rows equal in all fields
    have equal leaves, one after the other), every three make the next level, and the last one is the
    source's root. The roots of the sources, by name with null first, make the dataset's root the same
    way. The proof is the siblings on the way up. Where the id's checksum is even the text is tampered
    with: its line ends go. ``folded_root`` is what the leaf of the row then found folds up to with the
    stored siblings, and ``verified`` tells whether this is the root. No rows give no rows.
    """
    doc = [F.col(c) for c in FIELDS]
    tampered = F.replace("text", F.lit("\n"), F.lit(""))
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(*doc).alias("digest"), F.when(hit, leaf_digest(*doc[:-1], tampered)).alias("found"))
    placed = staged(numbered(leaves, "g", "doc_id", "digest").withColumn("payload", F.struct("doc_id", "found")), "leaves")

    def nothing_above(roots: DataFrame) -> DataFrame:
        return roots.select("g", F.col("digest").alias("root"), F.expr(
            "cast(array() as array<struct<lefts: string, rights: string>>)").alias("path"))

    def dataset(roots: DataFrame) -> DataFrame:
        sources = staged(numbered(roots.select(F.lit(0).alias("g"), F.col("g").alias("payload"), "digest"), "g", "payload"), "sources")
        return climbed(sources, _largest(sources), nothing_above).select(F.col("payload").alias("g"), "path", "root")

    proved = climbed(placed, _largest(placed), dataset)
    return proved.select(
        "payload.doc_id", F.col("digest").alias("leaf"), "subroot", "root",
        F.expr("sha2(array_join(transform(path, s -> concat(s.lefts, s.rights)), ''), 256)").alias("proof_sha256"),
        F.expr("aggregate(path, coalesce(payload.found, digest), (node, s) -> sha2(concat(s.lefts, node, s.rights), 256))").alias(
            "folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
