"""A Merkle manifest of a table, and proofs of single rows, in SQL functions alone.

Digests are lowercase hex of sha256, nodes join up to FAN digests.  A block of
FAN ** DEPTH consecutive nodes keeps each of its levels as one string of hex
digests; a parent is the hash of a substring of fixed width, a node's siblings
are the two substrings that flank it.  The roots of the blocks are the nodes of
the next round, until each branch has one node; the nodes of all branches, in
order, are then the leaves of the last tree.  Every round holds one row a block
of the round before, so all groups are bounded whatever the size of a branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palaver.llm.shared import BROADCAST_IDS, stored
from palaver.plans.scale import checked_broadcast

FAN = 8
DEPTH = 3  # levels that one block holds: 512 nodes, 32 KB of hex
WIDTH = 64  # characters of a digest
NODES = FAN**DEPTH

C = F.col
STEP = "struct<before: string, after: string>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _numbered(rows: DataFrame) -> DataFrame:
    """(branch, node, row, pos, nodes): ``rows`` numbered from 0 in the order of ``rank`` per branch.

    One range shuffle in the order of all branches; rows that are equal in
    branch, rank and node are interchangeable, and the last column keeps a run
    of them from being one range.  Sizes are summed per range and branch.
    """
    order = ["branch", "rank", "node", "_spread"]
    ordered = rows.withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ordered.select("branch", "node", "row", F.monotonically_increasing_id().alias("_at")), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sums = placed.groupBy("_part", "branch").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    branch = W.partitionBy("branch")
    before = F.coalesce(F.sum("_n").over(branch.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bounds = stored(sums.select("_part", "branch", (before - C("_first")).alias("_shift"), F.sum("_n").over(branch).alias("nodes")), "bounds")
    out = placed.join(checked_broadcast(bounds, BROADCAST_IDS), ["_part", "branch"])
    return out.select("branch", "node", "row", (C("_at") + C("_shift")).alias("pos"), "nodes")


def _parents(level: Column) -> Column:
    runs = F.ceil(F.length(level) / (FAN * WIDTH)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * (FAN * WIDTH) + 1, F.lit(FAN * WIDTH)), 256)), "")


def _round(nodes: DataFrame) -> DataFrame:
    """(branch, block, nodes, rows, s0, s1, ..): the blocks of numbered nodes and their levels.

    A level above the root of a branch repeats it, so the last one is the root of the block.
    """
    item = F.struct((C("pos") % NODES).cast("int").alias("at"), "node", "row")
    blocks = nodes.groupBy("branch", F.floor(C("pos") / NODES).alias("block")).agg(F.max("nodes").alias("nodes"), F.sort_array(F.collect_list(item)).alias("items"))
    blocks = blocks.select("branch", "block", "nodes", C("items.row").alias("rows"), F.array_join("items.node", "").alias("s0"))
    for level in range(DEPTH):
        s = C(f"s{level}")
        blocks = blocks.withColumn(f"s{level + 1}", F.when(C("nodes") > FAN**level, _parents(s)).otherwise(s))
    return blocks


def _siblings(at: Column) -> Column:
    """(before, after) of node ``at`` of a block and of each of its ancestors below the block's root."""

    def step(level: int) -> Column:
        s, own = C(f"s{level}"), F.floor(at / FAN**level).cast("int")
        first = own - own % FAN
        return F.struct(
            F.substring(s, first * WIDTH + 1, (own - first) * WIDTH).alias("before"),
            F.substring(s, (own + 1) * WIDTH + 1, (first + FAN - 1 - own) * WIDTH).alias("after"),
        )

    steps = F.array(*[F.when(C("nodes") > FAN**level, step(level)) for level in range(DEPTH)])
    return F.filter(steps, lambda x: x.isNotNull())  # a branch with one node left has no further level


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The rounds of numbered nodes, up to one block a branch."""
    rounds = [stored(_round(nodes), "blocks")]
    while (rounds[-1].agg(F.max("nodes").alias("n")).first()["n"] or 0) > NODES:
        roots = rounds[-1].select("branch", C(f"s{DEPTH}").alias("node"), F.lit(None).cast("string").alias("row"), C("block").alias("pos"), F.ceil(C("nodes") / NODES).alias("nodes"))
        rounds.append(stored(_round(roots), "blocks"))
    return rounds


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(branch, top, node, row, path) of the nodes of the lowest round.

    ``above`` has (branch, top, upper), ``upper`` being the steps over the root of the branch.
    """
    paths = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        joined = blocks.join(paths, ["branch", "block"])
        item = F.transform("rows", lambda row, i: F.struct((C("block") * NODES + i).alias("at"), F.substring("s0", i * WIDTH + 1, F.lit(WIDTH)).alias("node"), row.alias("row"), F.concat(_siblings(i), C("upper")).alias("path")))
        nodes = joined.select("branch", "top", F.explode(item).alias("x")).select("branch", "top", "x.*")
        if blocks is rounds[0]:
            break
        paths = stored(nodes.select("branch", "top", C("at").alias("block"), C("path").alias("upper")), "paths")
    return nodes.drop("at")


def manifest(rows: DataFrame, branch: Column, order: list[str], leaf: Column, found: Column, keep: list[str]) -> DataFrame:
    """(row, branch, leaf, subroot, root, path, folded_root) of every row; ``row`` holds the columns ``keep``.

    ``leaf`` is the digest of a row, ``found`` the digest that is found when the
    row is read again (null: the same).  ``path`` lists per level the digests
    before and after the node, from the leaf to the root of all;
    ``folded_root`` is computed from the digest found and the path.

    Defined cases: branches ascend bytewise, null first; rows of a branch ascend
    by ``order``, nulls first, equal ones by leaf; a lone leaf is the root of
    its branch, and a lone branch's root is the root of all; an empty table
    gives no rows.
    """
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), branch.cast("string")), F.lit("")).alias("branch"), F.struct(*order).alias("rank"), leaf.alias("node"),
        F.struct(found.alias("found"), F.struct(*keep).alias("row")).alias("row"),
    )
    rounds = _climb(_numbered(stored(leaves, "leaves")))
    subroots = rounds[-1].select(F.lit("").alias("branch"), C("branch").alias("rank"), C(f"s{DEPTH}").alias("node"), C("branch").alias("row"))
    trunk = _climb(_numbered(subroots))
    upper = _descend(trunk, trunk[-1].select("branch", F.lit("").alias("top"), F.array().cast(f"array<{STEP}>").alias("upper")))
    upper = stored(upper.select(C("row").alias("branch"), C("node").alias("top"), C("path").alias("upper")), "upper")
    out = _descend(rounds, upper)
    fold = F.aggregate("path", F.coalesce("row.found", "node"), lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))
    name = F.when(C("branch") != "", F.substring("branch", 2, 1 << 30)).alias("branch")
    root = trunk[-1].select(f"s{DEPTH}").scalar()
    return out.select(C("row.row").alias("row"), name, C("node").alias("leaf"), C("top").alias("subroot"), root.alias("root"), "path", fold.alias("folded_root"))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def changed(doc_id: Column) -> Column:
    """True for the documents that are tampered with: 3 divides the crc32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))


def document_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    A document is a leaf of the branch of its language, by ascending doc_id.
    Where ``changed``, the text is read with A-Z lower-cased when its root is
    folded again.

    Defined cases: null values enter the leaf as ``-``; documents without a
    language form the first branch; null ids come first, equal ids by leaf;
    repeated rows are leaves each; other columns are ignored; an empty table
    gives no rows.
    """
    typed = docs.select(*[C(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in COLUMNS])
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.when(changed(C("doc_id")), digest(*[lowered if c == "text" else C(c) for c in COLUMNS]))
    out = manifest(typed, C("lang"), ["doc_id"], digest(*map(C, COLUMNS)), found, ["doc_id"])
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    return out.select("row.doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (C("folded_root") == C("root")).alias("verified"))


# crc32 byte by byte, eight steps each: 3988292384 is its reflected polynomial
SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    xor(list_reduce(
      list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) % 3 = 0 AS changed
  FROM documents
), leaves AS (
  SELECT doc_id, lang, pos, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN changed THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS found
  FROM base
), tree AS (
  SELECT lang, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM tree WHERE n > 1 GROUP BY lang, level, pos // 8
), subroots AS (
  SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1
), trunk AS (
  SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM trunk WHERE n > 1 GROUP BY level, pos // 8
), runs AS (
  SELECT lang, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM tree WHERE n > 1 GROUP BY ALL
), trunk_runs AS (
  SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM trunk WHERE n > 1 GROUP BY ALL
), below AS (
  SELECT l.doc_id, l.lang, l.pos, 0 AS level, l.pos AS at, '' AS proof, coalesce(l.found, l.leaf) AS h FROM leaves l
  UNION ALL
  SELECT b.doc_id, b.lang, b.pos, b.level + 1, b.at // 8,
    b.proof || array_to_string(r.hs[:b.at % 8], '') || array_to_string(r.hs[b.at % 8 + 2:], ''),
    sha256(array_to_string(r.hs[:b.at % 8], '') || b.h || array_to_string(r.hs[b.at % 8 + 2:], ''))
  FROM below b JOIN runs r ON r.lang IS NOT DISTINCT FROM b.lang AND r.level = b.level AND r.run = b.at // 8
), above AS (
  SELECT b.doc_id, b.lang, b.pos, 0 AS level, s.pos AS at, b.proof, b.h
  FROM below b JOIN subroots s ON s.lang IS NOT DISTINCT FROM b.lang AND s.height = b.level
  UNION ALL
  SELECT a.doc_id, a.lang, a.pos, a.level + 1, a.at // 8,
    a.proof || array_to_string(r.hs[:a.at % 8], '') || array_to_string(r.hs[a.at % 8 + 2:], ''),
    sha256(array_to_string(r.hs[:a.at % 8], '') || a.h || array_to_string(r.hs[a.at % 8 + 2:], ''))
  FROM above a JOIN trunk_runs r ON r.level = a.level AND r.run = a.at // 8
)
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(a.proof) AS proof_sha256, a.h AS folded_root, a.h = t.h AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
JOIN (SELECT h, level FROM trunk WHERE n = 1) t ON true
JOIN above a ON a.lang IS NOT DISTINCT FROM l.lang AND a.pos = l.pos AND a.level = t.level
"""
