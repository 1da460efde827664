"""Conversation prefix trie by prefix-doubling naming.

Every conversation is a row of turns; each turn, and each aligned block of 2, 4, 8, ... turns, gets a dense name:
a whole number that equal blocks share. A block's name comes from the pair of its halves' names, so log2(turns)
rounds of joins name all blocks. A prefix of d turns is composed from the blocks of d's binary digits: its name
comes from the pair (name of the prefix without d's last block, name of that block), again in at most log2(turns)
rounds. Prefixes of one depth with one name are a node of the trie, so nodes are groups of rows.

Sums over subtrees need no walk over the tree: a node is owned by its smallest member, so what a subtree holds is
added up along each conversation (what it owns from a depth downwards), and then over the members of the node.

Texts are read once, for a digest of role and text (sha-256, by which turns are held equal) and a length; what is
shuffled afterwards are numbers. Groups are summed before they move, joins that deal names back can be split where
one name is hot (adaptive skew join), and the ids of a node are hashed in sorted pieces of bounded size.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Conversation c borrows its first turns from conversation c - c % BORROW, crc32(c) % BORROWED of them at most.
BORROW, BORROWED = 100, 6
#: Characters of a piece of a node's id list.
PIECE = 16_384


def _numbered(turns: DataFrame) -> DataFrame:
    """``(conv, pos, digest, points)``: the turns in order, from 1; ``digest`` stands for role and text, ``points`` are the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    base = turns.select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("points")).filter("conv IS NOT NULL")
    in_order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")
    return base.select("conv", F.row_number().over(in_order).cast("long").alias("pos"), "digest", "points")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: ``(conv, depth, digest, points)`` for each turn and ``(conv, length)`` for each conversation."""
    own = written(_numbered(turns), "turns")
    convs = own.groupBy("conv").agg(F.max("pos").alias("own"))
    borrowed = (F.crc32(F.col("conv").cast("string").cast("binary")) % BORROWED).alias("h")
    plan = convs.select("conv", "own", borrowed, (F.col("conv") - F.col("conv") % BORROW).alias("lender"))
    lenders = convs.filter(F.col("conv") % BORROW == 0).select(F.col("conv").alias("lender"), F.col("own").alias("lends"))
    plan = plan.join(lenders, "lender", "left").select("conv", "lender", "h", "own", F.least("h", F.coalesce("lends", F.lit(0).cast("long"))).alias("got"))
    plan = written(plan, "plan")
    lent = own.filter((F.col("conv") % BORROW == 0) & (F.col("pos") < BORROWED)).withColumnRenamed("conv", "lender")
    first = plan.join(lent, "lender").filter("pos <= got").select("conv", F.col("pos").alias("depth"), "digest", "points")
    rest = own.join(plan, "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("depth"), "digest", "points")
    lengths = plan.select("conv", (F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))).alias("length"))
    return written(first.unionByName(rest), "rebuilt"), lengths


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``name`` in place of ``keys``: equal keys get one number, from 0 on without gaps."""
    numbered = written(rows.select(*keys).distinct().withColumn("_at", F.monotonically_increasing_id()), "names")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["n"]) for r in numbered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    starts = dict(zip((p for p, _ in sizes), itertools.accumulate((n for _, n in sizes), initial=0), strict=False))
    first = F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), part) if starts else F.lit(0)
    names = numbered.select(*(F.col(k).alias(f"_{k}") for k in keys), (first + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("name"))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    return rows.join(names, same).drop(*keys, *(f"_{k}" for k in keys))


def _blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """For each level k the named blocks ``(conv, at, name)``: the turns ``at * 2**k + 1 .. (at + 1) * 2**k``."""
    level = written(named(turns.select("conv", (F.col("depth") - 1).alias("at"), "digest"), ["digest"]), "block-names")
    levels = [level]
    while 1 << len(levels) <= longest:
        left, right = (F.max(F.when(F.col("at") % 2 == side, F.col("name"))) for side in (0, 1))
        pairs = level.groupBy("conv", F.shiftright("at", 1).alias("half")).agg(left.alias("left"), right.alias("right")).filter("left IS NOT NULL AND right IS NOT NULL")
        level = written(named(pairs.withColumnRenamed("half", "at"), ["left", "right"]), "block-names")
        levels.append(level)
    return levels


def prefix_names(turns: DataFrame) -> DataFrame:
    """``(conv, depth, name)``: prefixes of one depth are equal where their names are."""
    longest = turns.agg(F.max("depth")).first()[0] or 0
    # the last block of a prefix of depth d is the one of even place that ends there
    last = None
    for k, level in enumerate(_blocks(turns, longest)):
        part = level.filter("at % 2 = 0").select("conv", (F.col("at") * (1 << k)).alias("before"), ((F.col("at") + 1) * (1 << k)).alias("depth"), F.col("name").alias("block"))
        last = part if last is None else last.unionByName(part)
    last = written(last, "last-blocks")
    composed = last.filter("before = 0").select("conv", "depth", F.col("block").alias("name"))
    out, digits = composed, 1
    while (2 << digits) - 1 <= longest:
        shorter = composed.select(F.col("conv").alias("_conv"), F.col("depth").alias("_depth"), F.col("name").alias("left"))
        these = last.filter((F.col("before") > 0) & (F.bit_count("depth") == digits + 1))
        pairs = these.join(shorter, (F.col("conv") == F.col("_conv")) & (F.col("before") == F.col("_depth"))).select("conv", "depth", "left", F.col("block").alias("right"))
        composed = written(named(written(pairs, "prefix-pairs"), ["left", "right"]), "prefix-names")
        out, digits = out.unionByName(composed), digits + 1
    return out


def _id_pieces(batches):
    """Of rows sorted by (depth, top, conv): the ids of a node as text, in pieces of PIECE characters or less."""
    node, ids, size, first = None, [], 0, None
    out = []

    def close():
        if ids:
            out.append((*node, first, ",".join(ids)))

    def batch():
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["depth", "top", "first", "ids"])

    for b in batches:
        for d, t, c in zip(*(b[x].to_pylist() for x in ("depth", "top", "conv")), strict=True):
            text = str(c)
            if (d, t) != node or size + len(text) + 1 > PIECE:
                close()
                node, ids, size, first = (d, t), [], 0, c
            ids.append(text)
            size += len(text) + 1
        if len(out) >= 512:
            yield batch()
            out = []
    close()
    if out:
        yield batch()


def _digests(batches):
    """Of pieces sorted by (depth, top, first): the digest of each node's whole list, which is never held whole."""
    node, digest = None, None
    for b in batches:
        out = []
        for d, t, ids in zip(*(b[x].to_pylist() for x in ("depth", "top", "ids")), strict=True):
            if (d, t) == node:
                digest.update(b"," + ids.encode())
                continue
            if node:
                out.append((*node, digest.hexdigest()))
            node, digest = (d, t), hashlib.sha256(ids.encode())
        if out:
            yield _node_batch(out)
    if node:
        yield _node_batch([(*node, digest.hexdigest())])


def _node_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["depth", "top", "ends_sha256"])


def list_digests(members: DataFrame) -> DataFrame:
    """``(depth, top, ends_sha256)`` of ``members(depth, top, conv)``: sha-256 of a node's ids, ascending and comma-joined."""
    dealt = members.repartitionByRange("depth", "top", "conv").sortWithinPartitions("depth", "top", "conv")
    pieces = dealt.mapInArrow(_id_pieces, "depth long, top long, first long, ids string")
    return pieces.repartition("depth", "top").sortWithinPartitions("depth", "top", "first").mapInArrow(_digests, "depth long, top long, ends_sha256 string")


def _sum(x: Column) -> Column:
    return F.sum(x).cast("long")


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations, from ``turns(conv_id, turn, role, text)``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. Turns are ordered by ``turn``, null first; turns of one number by the digest
    of role and text, so repeated rows are turns of their own. Null roles and texts are empty ones. Rows without
    conv_id belong to no conversation and are left out. The remainder has the sign of conv_id. A conversation may
    have no turn left and then ends in the root. An empty table has no nodes, not even a root. A very long text is
    read once, as a digest; a very long conversation is sorted by one task, as digests, and spills. Other columns are
    not read.
    """
    rows, lengths = rebuilt(turns)
    names = prefix_names(rows)
    lengths = written(lengths, "lengths")
    facts = rows.select("conv", "depth", "points").join(lengths, "conv")
    prefixes = written(names.join(facts, ["conv", "depth"]), "prefixes")
    tops = prefixes.groupBy("depth", "name").agg(F.min("conv").alias("top"), (F.max("length") > F.col("depth")).alias("goes_on"))
    nodes = written(tops.withColumnsRenamed({"depth": "_depth", "name": "_name"}), "nodes")
    below = prefixes.join(nodes, (F.col("depth") == F.col("_depth")) & (F.col("name") == F.col("_name"))).select("conv", "depth", "points", "length", "top", "goes_on")
    smallest = lengths.agg(F.min("conv").alias("c"), F.max("length").alias("n")).first()
    root = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("points"), "length", F.lit(smallest["c"]).cast("long").alias("top"), F.lit((smallest["n"] or 0) > 0).alias("goes_on"))
    path = written(below.unionByName(root), "paths")
    upwards = Window.partitionBy("conv").orderBy(F.desc("depth"))
    so_far = upwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = F.col("conv") == F.col("top")
    sums = path.select(
        "conv", "depth", "top", "length",
        F.lead("top").over(upwards).alias("parent"),
        F.coalesce(F.lag(owned.cast("long")).over(upwards), F.lit(0)).alias("child"),
        F.sum((owned & ~F.col("goes_on")).cast("long")).over(so_far).alias("leaves"),
        F.sum(F.when(owned, 0).otherwise(F.col("points"))).over(so_far).alias("saved"),
    )
    out = sums.groupBy("depth", "top").agg(F.max("parent").alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"), _sum(F.col("child")).alias("n_children"), _sum(F.col("leaves")).alias("n_leaves"), _sum(F.col("saved")).alias("saved_tokens"))
    ends = list_digests(path.filter("depth = length").select("depth", "top", "conv")).withColumnsRenamed({"depth": "_depth", "top": "_top"})
    return out.join(ends, (F.col("depth") == F.col("_depth")) & (F.col("top") == F.col("_top")), "left").select(
        F.col("top").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: DuckDB has no crc32: the digits of an id, folded bit by bit.
_CRC = """xor(list_reduce([4294967295] || list_transform(range(1, length(CAST(ID AS varchar)) + 1), lambda i: CAST(ascii(substr(CAST(ID AS varchar), i, 1)) AS bigint)),
 lambda a, b: list_reduce([xor(a, b)] || range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""
SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, conv_id - conv_id % {BORROW} AS lender, CAST({_CRC.replace('ID', 'conv_id')} % {BORROWED} AS bigint) AS h FROM t GROUP BY conv_id),
s AS (SELECT p.conv_id, 0 AS own, pos, role, text FROM p JOIN t ON t.conv_id = lender AND pos <= h UNION ALL SELECT p.conv_id, 1, pos, role, text FROM p JOIN t ON t.conv_id = p.conv_id AND pos > h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, length(text) AS points, concat(length(role), ':', length(text), ':', role, text) AS said FROM s),
x AS (SELECT conv_id, depth, points, list(said) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM d
 UNION ALL SELECT conv_id, 0, 0, CAST([] AS varchar[]), conv_id NOT IN (SELECT conv_id FROM d) FROM p),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(points) AS points, coalesce(string_agg(CAST(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM x GROUP BY depth, prefix),
up AS (SELECT c.conv_id, c.depth, c.n_convs, c.points, c.ids, u.conv_id AS parent_conv_id, c.prefix FROM n c LEFT JOIN n u ON u.depth = c.depth - 1 AND u.prefix = c.prefix[1:c.depth - 1]),
kids AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n FROM up WHERE depth > 0 GROUP BY 1, 2),
k AS (SELECT up.*, coalesce(kids.n, 0) AS n_children FROM up LEFT JOIN kids ON kids.depth = up.depth AND kids.conv_id = up.conv_id),
b AS (SELECT prefix[1:part] AS top, sum((n_convs - 1) * points) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS part FROM k) z GROUP BY 1)
SELECT conv_id, CAST(depth AS bigint) AS depth, parent_conv_id, n_convs, n_children, leaves AS n_leaves, CAST(saved AS bigint) AS saved_tokens, sha256(ids) AS ends_sha256 FROM k JOIN b ON b.top = k.prefix
"""
