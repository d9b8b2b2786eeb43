"""Mixing sources to target weights by min-cost flow, for documents of one or of several sources.

Documents are aggregated by membership pattern (their set of sources): words and rows. A flow routes
the patterns' words to the sources' quotas; the j-th copy of a pattern's words costs more than the
one before (convex), so nothing repeats while other words would do. As only copies cost, the flow
is found copy by copy: augment to the maximum with one copy, then with one more. Documents of a
pattern then take the whole copies of its flow, and documents in seeded order (MD5 of seed and
doc_id) one copy more, until the flow is met to the word; the last takes its leading words.

Quotas: weights share ``TOTAL`` times all words; a target stops at ``COPIES`` times the words of its
source, and what exceeds is shared again by weight until no target is above.

What the driver sees is one row per pattern, ``MAX_PATTERNS`` at most (an error names the number
beyond). The seeded order is cut by hash prefixes: sums per pattern and prefix find the prefix where
the extra copy ends, and only the rows of that one prefix are ordered.

Defined results: a null text has size 0 and a size of 0 takes nothing; the null source is a source
of its own, last in order; null ids hash as the empty string; rows alike in id and size share a
place in the order, so their sum is fixed and either may hold the cut; an empty table gives an empty
result. Other columns travel along.
"""

from __future__ import annotations

import json
import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, store, table, text_of, unpacked, whole_text

WEIGHTS, TOTAL, COPIES, SEED = (5, 2, 1), 1.5, 2, "mix"
MAX_PATTERNS, ROWS_A_PREFIX = 100_000, 256
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def source_targets(sizes: dict, weights: dict, total: float, copies: float) -> dict:
    """Targets by source: shares of ``total`` by weight, at most ``copies`` times the size."""
    target, left, free = {}, total, set(sizes)
    while free:
        unit = left / sum(weights[s] for s in free)
        over = {s for s in free if unit * weights[s] > copies * sizes[s]}
        if not over:
            return target | {s: unit * weights[s] for s in free}
        for s in sorted(over, key=str):
            target[s] = float(copies * sizes[s])
            left -= target[s]
        free -= over
    return target


def flow(supply: dict[tuple, int], quota: dict, copies: int) -> dict[tuple, dict]:
    """{pattern: {source: words}}: quotas met as far as possible with as few repeats as possible."""
    sent: dict[tuple, dict] = {p: dict.fromkeys(p, 0) for p in supply}
    left, users = dict(quota), {s: [] for s in quota}
    for p in supply:
        for s in p:
            users[s].append(p)
    for _ in range(copies):
        for pattern, room in supply.items():
            while room > 0:  # a path pattern -> source (-> pattern -> source)* that ends in a quota with room
                came: dict = {("p", pattern): None}
                todo, end = deque([("p", pattern)]), None
                while todo and end is None:
                    kind, at = todo.popleft()
                    if kind == "p":
                        for s in at:
                            if ("s", s) not in came:
                                came["s", s] = (kind, at)
                                if left[s] > 0:
                                    end = ("s", s)
                                    break
                                todo.append(("s", s))
                    else:
                        for p in users[at]:
                            if ("p", p) not in came and sent[p][at] > 0:
                                came["p", p] = (kind, at)
                                todo.append(("p", p))
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                back = [sent[path[i + 1][1]][path[i][1]] for i in range(1, len(path) - 1, 2)]
                amount = min([room, left[end[1]], *back])
                for i in range(0, len(path) - 1):
                    if i % 2 == 0:
                        sent[path[i][1]][path[i + 1][1]] += amount
                    else:
                        sent[path[i + 1][1]][path[i][1]] -= amount
                left[end[1]] -= amount
                room -= amount
    return sent


@dataclass
class Plan:
    """Bounded tables of a mix: one row per pattern and one per source."""

    patterns: list[tuple]  # (pattern, words, words taken)
    sources: list[tuple]   # (source, words, target)
    flow: dict


def make_plan(sums: list[tuple[tuple, int]], weights: tuple, total: float, copies: int) -> Plan:
    """``sums``: (pattern, words) of every pattern."""
    sizes: dict = {}
    for p, n in sums:
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    share = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    targets = source_targets(sizes, share, total * sum(n for _, n in sums), copies) if sizes else {}
    supply = dict(sorted(sums, key=lambda x: [(s is None, s or "") for s in x[0]]))
    sent = flow(supply, {s: math.floor(targets[s] + 0.5) for s in order}, copies)
    return Plan([(p, n, sum(sent[p].values())) for p, n in supply.items()],
                [(s, sizes[s], targets[s]) for s in order], sent)


def _order(id_col: str) -> Column:
    return F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def mix(docs: DataFrame, sources_col: str, size_col: str, id_col: str = "doc_id", weights: tuple = WEIGHTS,
        total: float = TOTAL, copies: int = COPIES) -> tuple[DataFrame, Plan]:
    """``docs`` with ``__taken``, the words that the mix takes of the row, and the plan. The column
    ``sources_col`` is an array of sources (may hold null; repeats count once; rows without any take
    nothing). Rows pass without a
    shuffle; sums per pattern and per hash prefix are aggregated."""
    spark = docs.sparkSession
    # a pattern's key: its sorted sources as JSON, null as null
    key = F.to_json(F.struct(F.sort_array(F.array_distinct(F.coalesce(
        F.col(sources_col), F.array().cast("array<string>"))), asc=False).alias("s")))
    light = store(docs.select(key.alias("__key"), F.col(size_col).alias("__size"), _order(id_col).alias("__order")), "mix")
    sums = light.groupBy("__key").agg(F.sum("__size").alias("words"), F.count("*").alias("n")).limit(
        MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    keys = {tuple(sorted(json.loads(r["__key"])["s"], key=lambda s: (s is None, s or ""))): r for r in sums}
    plan = make_plan([(p, r["words"]) for p, r in keys.items()], weights, total, copies)
    digits = min(7, max(1, math.ceil(math.log(max(1, max([r["n"] for r in sums], default=1)) / ROWS_A_PREFIX + 1, 16))))
    rows = [(keys[p]["__key"], t // n if n else 0, t % n if n else 0) for p, n, t in plan.patterns]
    table_ = spark.createDataFrame(rows, "__key string, __copies bigint, __extra bigint")
    prefix = F.substring("__order", 1, digits)
    by_prefix = light.groupBy("__key", prefix.alias("__cut")).agg(F.sum("__size").alias("w"))
    before = F.coalesce(F.sum("w").over(Window.partitionBy("__key").orderBy("__cut").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    cuts = by_prefix.withColumn("b", before).join(F.broadcast(table_), "__key").filter(
        "b <= __extra and __extra < b + w").select("__key", "__cut", (F.col("__extra") - F.col("b")).alias("__rest"))
    fate = store(table_.join(cuts, "__key", "left"), "mix-plan")
    size = F.col(size_col)
    keyed = docs.withColumn("__key", key).withColumn("__order", _order(id_col)).join(F.broadcast(fate), "__key", "left")
    at = F.substring("__order", 1, digits)
    plain = keyed.filter(F.col("__cut").isNull() | (at != F.col("__cut"))).withColumn(
        "__taken", size * (F.col("__copies") + F.coalesce(at < F.col("__cut"), F.lit(False)).cast("bigint")))
    w = Window.partitionBy("__key").orderBy("__order", size, id_col).rowsBetween(Window.unboundedPreceding, -1)
    cut = keyed.filter(at == F.col("__cut")).withColumn("__taken", size * F.col("__copies") + F.greatest(F.lit(0), F.least(
        size, F.col("__rest") - F.coalesce(F.sum(size).over(w), F.lit(0)))))
    extra = ["__key", "__order", "__copies", "__extra", "__cut", "__rest"]
    return plain.unionByName(cut).drop(*extra), plan


def take_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for every copy taken, the leading words
    of the text (and their ``n_chars``) where the copy is cut; rows the mix takes nothing of go."""
    row, text = F.col("row"), text_of(text_col)
    sized = packed(docs).withColumns({"__size": words(text), "__sources": F.array(row[source_col].cast("string")), "__id": row[id_col]})
    mixed, _ = mix(sized, "__sources", "__size", "__id")
    full = F.floor(F.col("__taken") / F.col("__size"))
    parts = F.concat(F.array_repeat(F.col("__size"), full.cast("int")), F.filter(
        F.array(F.pmod("__taken", "__size")), lambda x: x > 0))
    rows = mixed.filter("__taken > 0").withColumn("__part", F.explode(parts))
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)),
                                F.lit(1), F.col("__part").cast("int")), "")
    cut = F.col("__part") < F.col("__size")
    changed = {text_col: F.when(cut, head).otherwise(row[text_col])}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(cut, F.length(head)).otherwise(row["n_chars"]).cast(kind)
    return unpacked(rows, docs.columns, changed)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    sized = store(docs.select("doc_id", "source", F.array("source").alias("sources"), words(whole_text()).alias("size")), "sizes")
    mixed, plan = mix(sized, "sources", "size")
    # one row a source, as many as the plan's patterns at most
    targets = spark.createDataFrame(plan.sources, "source string, source_size bigint, target double")
    t = targets.withColumnRenamed("source", "__s")
    return mixed.join(F.broadcast(t), F.col("source").eqNullSafe(F.col("__s"))).select(
        "doc_id", "size", "source_size", "target", F.col("__taken").alias("taken"))


OP7_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT source, n, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
-- sorted by 2n / w, the sources that stop at twice their size come first; unit is what a weight of one gets
r AS (SELECT *, 2.0 * n / w AS bound, sum(2 * n) OVER lower AS below, sum(w) OVER upper AS rest FROM w
      WINDOW lower AS (ORDER BY 2.0 * n / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             upper AS (ORDER BY 2.0 * n / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
u AS (SELECT arg_min((1.5 * (SELECT sum(n) FROM w) - coalesce(below, 0)) / rest, bound) AS unit FROM r
      WHERE (1.5 * (SELECT sum(n) FROM w) - coalesce(below, 0)) / rest <= bound),
t AS (SELECT source, n, least(2.0 * n, unit * w) AS target FROM w, u),
q AS (SELECT source, n, target, floor(target + 0.5)::BIGINT AS quota FROM t),
o AS (SELECT d.doc_id, d.size, q.n, q.target, q.quota // greatest(q.n, 1) AS copies, q.quota % greatest(q.n, 1) AS extra,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix|' || coalesce(d.doc_id::VARCHAR, '')), d.size, d.doc_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size::BIGINT AS size, n AS source_size, target::DOUBLE AS target,
       (size * copies + greatest(0, least(size, extra - before)))::BIGINT AS taken
FROM o
"""
