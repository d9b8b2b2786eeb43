"""Conversation prefix trie by fixed-length block hashing, in DataFrame functions but for one hash.

1. Turns become digests of (role, text) with their length in code points; texts go no further. They
   are ranked inside conversations by ranges of (conv_id, turn, digest): a place is the row's number
   in its range and the rows of the conversation in earlier ranges, so that a conversation of any
   length is ranked by many tasks.
2. Blocks. ``BLOCK`` turns in a row form a block with one digest. Successive block digests fold into
   the prefix key of every block: at most ``FOLD`` digests in one row, and the keys of full folds
   once more.
3. Groups. Conversations are grouped by (prefix key, block digest) only, as partial sums, so copies
   count once a task. A prefix with a single following block does not diverge: that block's turns
   are nodes as they stand, with the members of the block. Only where siblings diverge are the turns
   of the distinct blocks grouped into nodes.
4. Subtrees without walking the tree. Every node is owned by its smallest member, and the nodes a
   conversation owns are the lower end of its path. With totals over members of all turn lengths, of
   owned lengths and of owned leaves (a second pass of step 3 over those sums), a node's subtree has
   as many leaves as its members own, and saves
   (sum of totals - n * before) - (sum of owned - own of the smallest + total of the smallest - before)
   code points, where ``before`` is the length above the node.
5. Ends. Ids of conversations that end at a node are joined in chunks of ``CHUNK`` consecutive
   numbers; a node of several chunks is hashed in one pass over its sorted chunks, a batch at a time.

Defined results: a null role or text counts as empty; turns are in the order of ``turn`` (null
first), equal ones in the order of their digest; repeated turns stay repeated; rows without conv_id
belong to no conversation and are left out; an empty table has no root and gives an empty result.
Turns of any length and conversations of any number of turns are handled whole. Other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, store, table

BLOCK, FOLD, CHUNK_BITS = 4, 4096, 10
OPENING, FAMILY = 6, 100
NOTHING = b""


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _null_safe_text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def ranked_turns(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, digest, n) and, per conversation and range of rows, what turns ``at`` into the
    place in the conversation: (conv_id, part, offset, rows)."""
    role, text = _null_safe_text("role"), _null_safe_text("text")
    turns = store(convs.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        _sha(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.length(text).cast("bigint").alias("n")), "turns")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ranked = store(turns.repartitionByRange(*order).sortWithinPartitions(*order)
                   .select("conv_id", F.monotonically_increasing_id().alias("at"), "digest", "n"), "ranked")
    parts = ranked.groupBy("conv_id", F.shiftright("at", 33).alias("part")).agg(
        F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return ranked, parts.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"), "rows")


def rebuilt_turns(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c as the first h turns of conversation c - c % 100 and its own turns after
    its first h, h = crc32(c) % 6: turns (conv_id, place, size, digest, n) and all conversations
    (conv_id, size), turnless ones included."""
    ranked, parts = ranked_turns(convs)
    parts = store(parts, "parts")
    c = F.col("conv_id")
    opening = (ranked.filter(c % FAMILY == 0).withColumn("part", F.shiftright("at", 33))
               .join(parts, ["conv_id", "part"]).withColumn("place", F.col("at") + F.col("offset"))
               .filter(F.col("place") < OPENING - 1).groupBy(c.alias("base"))
               .agg(F.sort_array(F.collect_list(F.struct("place", "digest", "n"))).alias("opening")))
    sizes = (parts.groupBy("conv_id").agg(F.sum("rows").alias("rows"))
             .withColumn("h", F.crc32(c.cast("string")) % OPENING)
             .join(opening, c - c % FAMILY == F.col("base"), "left")
             .withColumn("opening", F.slice(F.coalesce("opening", F.array().cast(
                 "array<struct<place:bigint,digest:binary,n:bigint>>")), F.lit(1), F.col("h").cast("int")))
             .withColumn("shift", F.size("opening") - F.col("h"))
             .withColumn("size", F.size("opening") + F.greatest(F.col("rows") - F.col("h"), F.lit(0))))
    sizes = store(sizes.select("conv_id", "h", "shift", "size", "opening"), "sizes")
    moved = parts.join(sizes, "conv_id").select("conv_id", "part", "offset", "h", "shift", "size")
    own = (ranked.withColumn("part", F.shiftright("at", 33)).join(moved, ["conv_id", "part"])
           .withColumn("place", F.col("at") + F.col("offset")).filter(F.col("place") >= F.col("h"))
           .select("conv_id", (F.col("place") + F.col("shift")).alias("place"), "size", "digest", "n"))
    lent = sizes.select("conv_id", "size", F.inline("opening")).select("conv_id", "place", "size", "digest", "n")
    return own.unionByName(lent), sizes.select("conv_id", "size")


def _folded(start: Column, items: Column, tag: bytes) -> Column:
    """Running (digest, chars) over ``items`` of the same fields, ``start`` first."""
    return F.aggregate(items, F.array(start), lambda acc, x: F.concat(acc, F.array(F.struct(
        _sha(F.lit(tag), F.element_at(acc, -1)["d"], x["d"]).alias("d"),
        (F.element_at(acc, -1)["c"] + x["c"]).alias("c")))))


def block_rows(turns: DataFrame, block: int = BLOCK, fold: int = FOLD) -> DataFrame:
    """One row per conversation and block: conv_id, k, size (of the conversation), digest, turns, prefix
    (key of the blocks before), before (their code points), following (key with this block)."""
    blocks = (turns.groupBy("conv_id", F.floor(F.col("place") / block).cast("bigint").alias("k"))
              .agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("place", "digest", "n"))).alias("t"))
              .withColumn("turns", F.transform("t", lambda x: F.struct(x["digest"].alias("d"), x["n"].alias("n"))))
              .withColumn("d", _sha(*[F.coalesce(F.get("turns", F.lit(i))["d"], F.lit(NOTHING)) for i in range(block)]))
              .withColumn("c", F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])))
    zero = F.struct(F.lit(NOTHING).alias("d"), F.lit(0).cast("bigint").alias("c"))
    rows = (blocks.groupBy("conv_id", F.floor(F.col("k") / fold).cast("bigint").alias("s"))
            .agg(F.sort_array(F.collect_list(F.struct("k", "d", "c", "size", "turns"))).alias("a"))
            .withColumn("run", _folded(zero, F.col("a"), b"b")))
    rows = store(rows, "folds")
    seeds = (rows.filter(F.size("a") == fold).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("s", F.element_at("run", -1).alias("f")))).alias("f"))
             .withColumn("run", _folded(zero, F.transform("f", lambda x: x["f"]), b"f"))
             .select("conv_id", F.posexplode("run").alias("s", "seed"), F.col("run").alias("all"))
             .select("conv_id", F.col("s").cast("bigint").alias("s"), "seed", F.get("all", F.col("s") + 1)["d"].alias("later")))
    one = (rows.join(seeds, ["conv_id", "s"], "left")
           .select("conv_id", "s", "run", "seed", "later", F.posexplode("a").alias("j", "b")))
    within, after = F.get("run", F.col("j")), F.get("run", F.col("j") + 1)

    def key(seed: Column, inside: Column) -> Column:
        return F.when(F.col("s") == 0, inside).otherwise(_sha(F.lit(b"k"), seed, inside))

    return one.select(
        "conv_id", "b.k", "b.size", F.col("b.d").alias("digest"), "b.turns",
        key(F.col("seed.d"), within["d"]).alias("prefix"),
        (F.coalesce("seed.c", F.lit(0)) + within["c"]).alias("before"),
        F.when(F.col("j") + 1 < fold, key(F.col("seed.d"), after["d"]))
        .otherwise(_sha(F.lit(b"k"), F.col("later"))).alias("following"))


def _inner(prefix: Column, digests: Column) -> Column:
    """Key of a node inside a block: the prefix and the digests of the block's turns so far."""
    return _sha(F.lit(b"n"), F.aggregate(digests, prefix, lambda a, x: F.concat(a, x)))


def _node_rows(blocks: DataFrame, block: int) -> DataFrame:
    """The turns of distinct blocks as node rows: node, parent, depth, length, before."""
    digests = F.transform("turns", lambda x: x["d"])
    keys = F.transform("turns", lambda _, i: F.when(i + 1 == block, F.col("following")).otherwise(
        _inner(F.col("prefix"), F.slice(digests, F.lit(1), i + 1))))
    one = blocks.withColumn("keys", keys).select("*", F.posexplode("turns").alias("i", "turn"))
    above = F.aggregate(F.slice("turns", F.lit(1), F.col("i")), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return one.select(
        "prefix", "digest", "lone", "members", "conv", F.get("keys", F.col("i")).alias("node"),
        F.when(F.col("i") == 0, F.col("prefix")).otherwise(F.get("keys", F.col("i") - 1)).alias("parent"),
        (F.col("k") * block + F.col("i") + 1).alias("depth"), F.col("turn.n").alias("length"),
        (F.col("before") + above).alias("before"))


def _ends(rows: DataFrame, sizes: DataFrame, block: int, chunk_bits: int) -> DataFrame:
    """(node, ends): SHA-256 of the sorted, comma-joined ids of conversations that end at a node."""
    last = rows.filter((F.col("k") + 1) * block >= F.col("size")).select(
        "conv_id", F.when(F.size("turns") == block, F.col("following")).otherwise(
            _inner(F.col("prefix"), F.transform("turns", lambda x: x["d"]))).alias("node"))
    last = last.unionByName(sizes.filter("size = 0").select("conv_id", F.lit(NOTHING).alias("node")))
    chunks = store(last.groupBy("node", F.shiftright("conv_id", chunk_bits).alias("chunk")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids")), "ends")
    per = chunks.groupBy("node").agg(F.count("*").alias("chunks"), F.min("ids").alias("ids"))
    single = per.filter("chunks = 1").select("node", F.sha2("ids", 256).alias("ends"))
    several = (chunks.join(per.filter("chunks > 1").select("node"), "node")
               .repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for b in batches:
            done = []
            for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key != node:
                    if h is not None:
                        done.append((node, h.hexdigest()))
                    node, h = key, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield _pairs(done)
        if h is not None:
            yield _pairs([(node, h.hexdigest())])

    return single.unionByName(several.mapInArrow(hashed, "node binary, ends string"))


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()),
                                       pa.array([r[1] for r in rows], pa.string())], ["node", "ends"])


def prefix_trie(turns: DataFrame, sizes: DataFrame, block: int = BLOCK, fold: int = FOLD,
                chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The nodes of the trie of conversations: ``turns`` (conv_id, place from 0, size, digest, n), ``sizes``
    (conv_id, size) with every conversation once."""
    sizes = store(sizes, "sizes")
    rows = store(block_rows(turns, block, fold), "blocks")
    distinct = rows.groupBy("prefix", "digest").agg(
        F.count("*").alias("members"), F.min("conv_id").alias("conv"), F.first("k").alias("k"),
        F.first("before").alias("before"), F.first("following").alias("following"), F.first("turns").alias("turns"))
    distinct = store(distinct, "distinct")
    lone = (distinct.groupBy("prefix").agg(F.count("*").alias("siblings")).filter("siblings = 1")
            .select("prefix", F.lit(True).alias("lone")))
    marked = distinct.join(lone, "prefix", "left").withColumn("lone", F.coalesce("lone", F.lit(False)))
    placed = store(_node_rows(marked, block), "placed")
    fields = ["parent", "depth", "length", "before"]
    straight = placed.filter("lone").select("node", *fields, F.col("members").alias("n_convs"), "conv")
    refined = placed.filter("not lone").groupBy("node").agg(
        *[F.first(x).alias(x) for x in fields], F.sum("members").alias("n_convs"), F.min("conv").alias("conv"))
    root = sizes.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv")).filter("n_convs > 0").select(
        F.lit(NOTHING).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"),
        F.lit(0).cast("bigint").alias("length"), F.lit(0).cast("bigint").alias("before"), "n_convs", "conv")
    nodes = straight.unionByName(refined).unionByName(root)
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = store(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    owned = nodes.groupBy(F.col("conv").alias("conv_id")).agg(
        F.sum("length").alias("own"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    totals = turns.groupBy("conv_id").agg(F.sum("n").alias("total"))
    of_conv = store(sizes.select("conv_id").join(totals, "conv_id", "left").join(owned, "conv_id", "left")
                    .na.fill(0, ["total", "own", "leaves"]), "owned")
    sums = [F.sum(x).alias(x) for x in ("total", "own", "leaves")]
    of_block = rows.select("conv_id", "prefix", "digest").join(of_conv, "conv_id").groupBy("prefix", "digest").agg(*sums)
    spread = placed.select("prefix", "digest", "lone", "node").join(of_block, ["prefix", "digest"])
    of_node = (spread.filter("lone").select("node", "total", "own", "leaves")
               .unionByName(spread.filter("not lone").groupBy("node").agg(*sums))
               .unionByName(of_conv.agg(*sums).select(F.lit(NOTHING).alias("node"), "total", "own", "leaves")))
    smallest = of_conv.select(F.col("conv_id").alias("conv"), F.col("total").alias("top_total"), F.col("own").alias("top_own"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    n, before = F.col("n_convs"), F.col("before")
    return (nodes.join(of_node, "node").join(smallest, "conv").join(above, "parent", "left")
            .join(_ends(rows, sizes, block, chunk_bits), "node", "left")
            .select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
                    F.col("leaves").alias("n_leaves"),
                    (F.col("total") - n * before - (F.col("own") - F.col("top_own") + F.col("top_total") - before)
                     ).alias("saved_tokens"),
                    F.coalesce("ends", F.sha2(F.lit(NOTHING), 256)).alias("ends_sha256")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    turns, sizes = rebuilt_turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return prefix_trie(store(turns, "rebuilt"), sizes)


#: crc32 (polynomial 0xEDB88320, reflected) bit by bit, as the engine has no such function.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
       lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)),
       4294967295)"""

OP12_SQL = f"""
WITH told AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
         sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
ranked AS (SELECT conv_id, digest, length(text) AS n,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM told),
heads AS (SELECT conv_id, ({_CRC}) % 6 AS h FROM (SELECT DISTINCT conv_id FROM told)),
joined AS (
  SELECT c.conv_id, r.digest, r.n, r.place FROM heads c JOIN ranked r ON r.conv_id = c.conv_id - c.conv_id % 100 AND r.place < c.h
  UNION ALL SELECT c.conv_id, r.digest, r.n, r.place + 6 FROM heads c JOIN ranked r ON r.conv_id = c.conv_id AND r.place >= c.h),
paths AS (
  SELECT conv_id, row_number() OVER o AS depth, n, sha256(string_agg(digest, ',') OVER o) AS node FROM joined
  WINDOW o AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, 0, '' FROM heads),
steps AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
                 depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM paths),
nodes AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(n) AS n, min(conv_id) AS conv_id,
                 count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '') AS ends
          FROM steps GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
under AS (SELECT DISTINCT a.node, b.node AS below FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
subtrees AS (
  SELECT u.node, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.n) AS saved_tokens
  FROM under u JOIN nodes x ON x.node = u.below LEFT JOIN children c ON c.node = u.below GROUP BY u.node)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n_children, 0) AS n_children,
       s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM nodes v JOIN subtrees s USING (node) LEFT JOIN children c USING (node) LEFT JOIN nodes p ON p.node = v.parent
"""
