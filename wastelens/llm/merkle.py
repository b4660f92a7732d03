"""Merkle manifest of a dataset: leaves, a tree per language, a tree over the languages, inclusion proofs.

Method: nodes are ranked and the octal digits of their rank inside a block of ``8 ** DIGITS`` nodes are grouped away one after the other,
from the last digit on, each time nesting the child structs in a sorted array beside their digest. One shuffle by (tree, block)
serves all groupings of a pass. The block roots are the nodes of the next pass, until every language has one root; the same
passes over the languages' roots end in the root of the manifest. On the way back a final transform over the nested
structs, and an explode, give every node its own path before the path of its block; the path of a block reaches it
as a second row of its group, not by a join.

* A row holds at most ``8 ** DIGITS`` leaves, whatever the size of a language; a language with a third of all rows has more blocks.
* Ranks: rows are ranged by (language, doc_id, leaf) into buckets, and the sums of the buckets give each its offset, so that
  no task sees a whole language. Null ids come first; rows that agree in all five fields are equal leaves side by side.
* Null language is a language of its own and comes first. Null fields enter a leaf as ``-``. Null ids are never tampered with.
  An empty table gives an empty result.
* A path is an array of (left, right), the joined digests on either side of the node in its run, bottom up; a node alone
  in its run has two empty ones, a tree of one node has no level.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wastelens.llm import common

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
WIDTH = 8
DIGITS = 3
BLOCK = WIDTH ** DIGITS
PATH = "array<struct<left:string,right:string>>"


def sealed(values: list[Column]) -> Column:
    """Digest of values, each written so that no two lists of values look alike."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """One row per document: its key, id, leaf, and the leaf of the tampered text where it is tampered with (else null)."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id"), sealed([F.col(c) for c in FIELDS]).alias("digest"),
        F.when(tampered, sealed([lower if c == "text" else F.col(c) for c in FIELDS])).alias("changed"))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Add ``rank``, from 0 inside each tree, and ``n``, its number of rows."""
    rows = rows.repartitionByRange(tree, *order).withColumn("_bucket", F.spark_partition_id())
    rows = common.cut_lineage(rows, "ranks")
    return common.running_before(rows, tree, "_bucket", order, F.lit(1).cast("long"), "rank", "n").drop("_bucket")


def _hash(kids: Column) -> Column:
    return F.sha2(F.array_join(F.transform(kids, lambda k: k["digest"]), ""), 256)


def rolled(nodes: DataFrame) -> DataFrame:
    """One row per block of nodes (tree, rank, n, digest, payload): tree, block, blocks, digest of the block, ``kids`` with all its nodes.

    A level is hashed only while the tree has several nodes on it; above that the only node passes.
    """
    digits = [F.pmod(F.floor(F.col("rank") / F.lit(WIDTH ** i)), F.lit(WIDTH)).cast("int").alias(f"d{i}") for i in range(DIGITS)]
    rows = nodes.select(
        "tree", F.floor(F.col("rank") / F.lit(BLOCK)).alias("block"), "n", *digits, "digest", F.col("payload").alias("kids"))
    rows = rows.repartition("tree", "block")
    for i in range(DIGITS):
        above = [f"d{j}" for j in range(i + 1, DIGITS)]
        rows = rows.groupBy("tree", "block", "n", *above).agg(
            F.sort_array(F.collect_list(F.struct(F.col(f"d{i}").alias("digit"), "digest", "kids"))).alias("kids"))
        several = F.col("n") > WIDTH ** i
        rows = rows.withColumn("digest", F.when(several, _hash(F.col("kids"))).otherwise(F.get("kids", F.lit(0))["digest"]))
    return rows.select("tree", "block", F.ceil(F.col("n") / F.lit(BLOCK)).alias("blocks"), "n", "digest", "kids")


def _step(kids: Column, i: Column, several: Column) -> Column:
    """The path over one level for child i: digests left and right of it."""
    side = lambda part: F.array_join(F.transform(part, lambda k: k["digest"]), "")
    one = F.struct(side(F.slice(kids, F.lit(1), i)).alias("left"), side(F.slice(kids, i + 2, F.lit(WIDTH))).alias("right"))
    return F.when(several, F.array(one)).otherwise(F.array().cast(PATH))


def unrolled(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """One row per node: tree, payload, path, and the ``top`` of its tree: (path above, subroot, root).

    ``above`` has the same for the blocks: tree, block, path, top. Two rows meet in a group, a block and its path.
    """
    rows = blocks.select("tree", "block", "n", "kids", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("struct<subroot:string,root:string>").alias("top"))
    other = above.select("tree", "block", F.lit(None).cast("long").alias("n"), F.lit(None).cast(blocks.schema["kids"].dataType).alias("kids"), "path", "top")
    rows = rows.unionByName(other).groupBy("tree", "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "top")])

    def down(kids: Column, level: int, path) -> Column:
        """All nodes below ``kids`` as (payload, path)."""
        several = F.col("n") > WIDTH ** level
        if level == 0:
            return F.transform(kids, lambda k, i: F.struct(
                k["kids"].alias("payload"), F.concat(_step(kids, i, several), path).alias("path")))
        return F.flatten(F.transform(kids, lambda k, i: down(k["kids"], level - 1, F.concat(_step(kids, i, several), path))))

    rows = rows.select("tree", "top", F.explode(down(F.col("kids"), DIGITS - 1, F.col("path"))).alias("_node"))
    return rows.select("tree", "_node.payload", "_node.path", "top")


def _passes(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Roll up until every tree is one block. Each pass is written: it is read on the way up and on the way down."""
    passes = []
    while True:
        passes.append(common.cut_lineage(rolled(nodes), "merkle"))
        roots = passes[-1].select("tree", F.col("block").alias("rank"), F.col("blocks").alias("n"), "digest", F.col("block").alias("payload"))
        if (passes[-1].agg(F.max("blocks")).first()[0] or 0) <= 1:
            return passes, roots
        nodes = roots


def _descend(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """From the paths of the trees' roots (tree, path, top) to those of all nodes of the first pass."""
    above = above.select("tree", F.lit(0).cast("long").alias("block"), "path", "top")
    for blocks in reversed(passes[1:]):
        above = unrolled(blocks, above).select("tree", F.col("payload").alias("block"), "path", "top")
    return unrolled(passes[0], above)


def proofs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, changed, path (bottom up to the root), subroot, root."""
    nodes = ranked(leaves(docs), "tree", ["doc_id", "digest"]).select(
        "tree", "rank", "n", "digest", F.struct("doc_id", F.col("digest").alias("leaf"), "changed").alias("payload"))
    passes, subroots = _passes(nodes)
    trees = ranked(subroots.select(F.lit("*").alias("_all"), "tree", "digest"), "_all", ["tree"])
    upper, roots = _passes(trees.select(
        F.col("_all").alias("tree"), "rank", "n", "digest", F.struct("tree", F.col("digest").alias("subroot")).alias("payload")))
    top = roots.select("tree", F.array().cast(PATH).alias("path"), F.struct(F.lit("").alias("subroot"), F.col("digest").alias("root")).alias("top"))
    by_tree = _descend(upper, top).select(
        "payload.tree", "path", F.struct(F.col("payload.subroot").alias("subroot"), F.col("top.root").alias("root")).alias("top"))
    return _descend(passes, by_tree).select("payload.doc_id", "payload.leaf", "payload.changed", "path", "top.subroot", "top.root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, level: F.sha2(F.concat(level["left"], acc, level["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered document), verified."""
    siblings = F.array_join(F.transform("path", lambda level: F.concat(level["left"], level["right"])), "")
    rows = proofs(docs).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(common.table(spark, sf_dir, "documents"))


def _level(below: str, name: str, tree: str) -> str:
    """SQL of one level of trees: runs of eight nodes (t, i, n, h) become their digest; a lone node stays."""
    return f"""
{name}_r AS (SELECT t, i, n, h, coalesce(string_agg(h, '') OVER (PARTITION BY t, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
   coalesce(string_agg(h, '') OVER (PARTITION BY t, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {below}),
{name} AS (SELECT t, i // 8 AS i, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
   FROM {below} GROUP BY t, i // 8)"""


def _oracle(levels: int = 7, upper: int = 2) -> str:
    """SQL for languages of at most 8**levels documents and at most 8**upper languages."""
    field = lambda c, text="text": f"coalesce(strlen({(v := c if c != 'text' else text)}::VARCHAR) || ':' || {v}::VARCHAR, '-')"
    leaf = " || ".join(field(c) for c in FIELDS)
    low = " || ".join(field(c, f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')") for c in FIELDS)
    crc = ("xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda a, b: list_reduce("
           "[0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x // 2, 3988292384 * (x % 2)), xor(a, b)), 4294967295::BIGINT), 4294967295)")
    ctes = [f"""d AS (SELECT doc_id, coalesce('=' || lang, '') AS t, sha256({leaf}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({low}) END AS changed FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d),
a0 AS (SELECT t, i, n, leaf AS h FROM o)"""]
    ctes += [_level(f"a{k}", f"a{k + 1}", "t") for k in range(levels)]
    ctes += [f"u AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n, h FROM a{levels})",
             "b0 AS (SELECT 0 AS t, i, n, h FROM u)"]
    ctes += [_level(f"b{k}", f"b{k + 1}", "t") for k in range(upper)]
    steps = [(f"x{k}", f"JOIN a{k + 1}_r x{k} ON x{k}.t = o.t AND x{k}.i = o.i // {8 ** k}") for k in range(levels)]
    steps += [(f"y{k}", f"JOIN b{k + 1}_r y{k} ON y{k}.i = u.i // {8 ** k}") for k in range(upper)]
    fold, proof = "coalesce(o.changed, o.leaf)", []
    ctes += [f"""p AS (SELECT o.doc_id, o.leaf, coalesce(o.changed, o.leaf) AS f0, u.h AS subroot, b{upper}.h AS root, {', '.join(
        f"{a}.n AS {a}n, {a}.l AS {a}l, {a}.r AS {a}r" for a, _ in steps)}
FROM o JOIN u ON u.t = o.t JOIN b{upper} ON true {' '.join(j for _, j in steps)})"""]
    fold = "f0"
    for k, (a, _) in enumerate(steps):
        ctes.append(f"f{k + 1} AS (SELECT *, CASE WHEN {a}n > 1 THEN sha256({a}l || {fold} || {a}r) ELSE {fold} END AS f{k + 1} FROM {'p' if k == 0 else f'f{k}'})")
        fold = f"f{k + 1}"
        proof.append(f"{a}l || {a}r")
    return f"""WITH {', '.join(ctes)}
SELECT doc_id, leaf, subroot, root, sha256({' || '.join(proof)}) AS proof_sha256, {fold} AS folded_root, {fold} = root AS verified FROM {fold}"""


QUERIES = {"op11_merkle": op11_merkle}
ORACLES = {"op11_merkle": _oracle()}
