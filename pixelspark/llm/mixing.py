"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target in words is a share of the whole by its weight, at most `cap` times the source, the excess going
to the others (water filling). Every document of a source then wants target / source size copies: a whole part, which
it gets, and a fraction. Two documents with fractions are paired and mass (words x fraction) moves at random from one to
the other until one of the fractions is 0 or 1; the chances keep each expectation, so each document keeps its own
probability while the words of the source stay as they were. A node of the tree streams through its documents with one
open fraction, and what is open at its end goes to the next level, `FAN` nodes to one. The last fraction of a source
is drawn. So a source's words differ from its target by less than its last document.

Nodes are dealt by a hash, so a source with a third of all rows is spread over as many nodes as its rows need, and
only (doc_id, source, size) moves. Draws are hashes of the documents: reruns and lost tasks give the same result.

Rows that agree in (doc_id, source, size) are n equal rows: as many of them as their fraction says are settled at once, and
what is left over is the fraction of one row, so their number doesn't make the mix coarser.

Defined results: null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; repeated
rows get copies that differ by one at most; a text counts whole however long, and one that holds much of its source makes
the mix as coarse as it is; of equal draws the smaller doc_id comes first; an empty table gives no rows; other columns are
ignored by mix().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelspark.llm.common import WORD_PATTERN, holding, written

LEAF, FAN, EPS = 2_000, 64, 1e-9
STATE = "doc_id long, source string, size long, n long, source_size long, target double, whole int, part double, node long, draw double"


def targets(sources: DataFrame, weights: tuple[int, ...], total_share: float, cap: float) -> DataFrame:
    """sources: (source, source_size), one row per source. Adds the target of each.

    With the sources in order of cap x size / weight, the water level is the greatest one that doesn't drown a source
    which it takes as not capped.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank"), F.lit(len(weights))) + 1)
    all_rows = Window.partitionBy(F.lit(0))
    df = sources.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", weight)
    df = df.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    level = (total_share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("level", level)
    df = df.withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_rows))
    return df.select("source", "source_size", F.least("most", F.coalesce(F.col("water"), F.lit(math.inf)) * F.col("weight")).alias("target"))


def _round_nodes(rows: DataFrame, last: bool) -> DataFrame:
    """Stream each (source, node): pair its documents one after another, leaving one fraction open at most."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, open_row = None, None
        names = None

        def settle(row):
            if last and EPS < row["part"] < 1 - EPS:
                row["part"] = float(row["draw"] < row["part"])
            return row

        for batch in batches:
            names, out = batch.schema, []
            for row in batch.to_pylist():
                if open_row is not None and (row["source"], row["node"]) != key:
                    out.append(settle(open_row))
                    open_row = None
                key = (row["source"], row["node"])
                if not EPS < row["part"] < 1 - EPS or not row["size"]:
                    out.append(row)
                elif open_row is None:
                    open_row = row
                else:
                    # t words move to the new row (up) or from it (down) until a fraction is integral
                    a, b = open_row["size"] * open_row["n"], row["size"] * row["n"]
                    up = min((1 - row["part"]) * b, open_row["part"] * a)
                    down = min(row["part"] * b, (1 - open_row["part"]) * a)
                    t = up if row["draw"] * (up + down) < down else -down
                    row["part"] += t / b
                    open_row["part"] -= t / a
                    for x in (row, open_row):
                        x["part"] = 0.0 if x["part"] < EPS else 1.0 if x["part"] > 1 - EPS else x["part"]
                    done = [x for x in (open_row, row) if x["part"] in (0.0, 1.0)]
                    left = [x for x in (open_row, row) if x["part"] not in (0.0, 1.0)]
                    out += done
                    open_row = left[0] if left else None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=names)
        if open_row is not None:
            yield pa.RecordBatch.from_pylist([settle(open_row)], schema=names)

    # The largest come first, so that the fraction which stays open to the end is mostly of a small document.
    dealt = rows.repartition("source", "node").sortWithinPartitions("source", "node", F.col("size").desc(), "draw", "doc_id")
    return dealt.mapInArrow(run, STATE)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total_share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, n, source_size, target, copies: n rows of docs with these copies; up to three such rows per distinct
    (doc_id, source, size)."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    items = written(items.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "items")
    by_source = targets(items.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, total_share, cap)
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    nodes = max(1, math.ceil(items.count() / LEAF))

    def draw(level: int):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "source", "size"), F.lit(1 << 52)) / F.lit(float(1 << 52))

    renamed = by_source.withColumnRenamed("source", "of")
    state = items.join(renamed, items.source.eqNullSafe(renamed.of)).drop("of").withColumn("want", want)
    state = state.withColumn("whole", F.floor(F.col("want") + EPS).cast("int")).withColumn("part", F.greatest(F.lit(0.0), F.col("want") - F.col("whole")))
    state = state.withColumn("node", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(nodes))).withColumn("draw", draw(0))
    state = _apart(state).select(*(c.split()[0] for c in STATE.split(", ")))
    done, tables = _settled(state, nodes, draw)
    copies = F.col("whole") + F.when(F.col("size") > 0, F.round("part")).otherwise(0).cast("int")
    return holding(done.select("doc_id", "source", "size", "n", "source_size", "target", copies.alias("copies")), items, *tables)


def _apart(state: DataFrame) -> DataFrame:
    """n equal rows as rows that are settled and one that has what is left over as its fraction."""
    mass = F.col("n") * F.col("part")
    up = F.floor(mass + EPS)
    rest = F.greatest(F.lit(0.0), mass - up)
    one = (rest > EPS).cast("long")
    piece = lambda n, part: F.struct(n.cast("long").alias("n"), part.cast("double").alias("part"))
    parts = F.array(piece(up, F.lit(1.0)), piece(one, rest), piece(F.col("n") - up - one, F.lit(0.0)))
    alone = (F.col("n") == 1) | (F.col("size") == 0)  # nothing to part
    parts = F.when(alone, F.array(piece(F.col("n"), F.col("part")))).otherwise(F.filter(parts, lambda p: p["n"] > 0))
    return state.withColumn("_p", F.explode(parts)).withColumn("n", F.col("_p.n")).withColumn("part", F.col("_p.part")).drop("_p")


def _settled(state: DataFrame, nodes: int, draw) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of STATE with integral parts, level by level up the tree, FAN nodes to one; and the written tables they are in."""
    done, tables, level = [], [], 0
    fraction = F.col("part").between(EPS, 1 - EPS) & (F.col("size") > 0)
    while True:
        last = nodes == 1
        state = written(_round_nodes(state, last), f"rounded{level}")
        tables.append(state)
        if last:
            return reduce(DataFrame.unionByName, [*done, state]), tables
        done.append(state.where(~fraction))
        nodes, level = math.ceil(nodes / FAN), level + 1
        state = state.where(fraction).withColumn("node", F.floor(F.col("node") / FAN)).withColumn("draw", draw(level))


def take(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total_share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed table itself: each row of docs, with its columns, as often as the mix takes it. Texts are never shuffled.

    Here the leaves of the tree are the tasks that read the table: each pairs the documents of a source as they come, holding
    one open document per source. Only what is open at a task's end, at most a document per task and source, goes up the tree
    by its number and is joined to its decision.
    """
    names = docs.columns
    clash = [f"_own{k}" for k in range(len(names))]  # the helpers' names may not meet those of the table
    text, source, doc = (clash[names.index(c)] for c in ("text", "source", "doc_id"))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = docs.toDF(*clash).withColumn("size", size).withColumn("source", F.col(source).cast("string"))
    shares = goals = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_share, cap), "goals")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    number = lambda level: F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col(doc), "source", "size"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    goals = goals.select(F.col("source").alias("of"), (F.floor(want + EPS)).cast("int").alias("whole"), F.greatest(F.lit(0.0), want - F.floor(want + EPS)).alias("part"))
    rows = sized.join(goals, F.col("source").eqNullSafe(F.col("of"))).withColumn("draw", number(0)).select(*clash, "source", "size", "whole", "part", "draw")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict = {}  # source: [size, part, row]
        for batch in batches:
            parts = batch.column("part").to_pylist()
            pieces, sizes = [batch], batch.column("size").to_pylist()
            final: list = list(parts)
            for k, (of, n, draw) in enumerate(zip(batch.column("source").to_pylist(), sizes, batch.column("draw").to_pylist(), strict=True)):
                if not n or not EPS < parts[k] < 1 - EPS:
                    final[k] = 0.0 if not n else float(round(parts[k]))
                    continue
                if of not in held:
                    held[of] = [n, parts[k], k]
                    continue
                m, p, row = held[of]
                q = parts[k]
                up, down = min((1 - q) * n, p * m), min(q * n, (1 - p) * m)
                t = up if draw * (up + down) < down else -down
                p, q = p - t / m, q + t / n
                settled = [x if EPS < x < 1 - EPS else float(round(x)) for x in (p, q)]
                for x, at in zip(settled, (row, k), strict=True):
                    if isinstance(at, int):
                        final[at] = x
                    elif x in (0.0, 1.0):  # a row of an earlier batch goes out now
                        pieces.append(at)
                        final.append(x)
                if settled[1] not in (0.0, 1.0):
                    held[of] = [n, settled[1], k]
                elif settled[0] not in (0.0, 1.0):
                    held[of][1] = settled[0]
                else:
                    del held[of]
            waiting = {h[2] for h in held.values() if isinstance(h[2], int)}
            whole = pa.Table.from_batches(pieces)
            whole = whole.set_column(whole.schema.get_field_index("part"), "part", pa.array(final, pa.float64()))
            keep = [k for k in range(whole.num_rows) if k not in waiting]
            for h in held.values():
                if isinstance(h[2], int):
                    h[2] = batch.slice(h[2], 1)
            yield from whole.take(keep).to_batches()
        for _, p, row in held.values():
            yield row.set_column(row.schema.get_field_index("part"), "part", pa.array([p], pa.float64()))

    first = written(rows.mapInArrow(run, rows.schema), "taken")
    fraction = F.col("part").between(EPS, 1 - EPS) & (F.col("size") > 0)
    rest = written(first.where(fraction).withColumn("rid", F.monotonically_increasing_id()), "open")
    nodes = max(1, math.ceil(rest.count() / LEAF))
    draw = lambda level: F.pmod(F.xxhash64(F.lit(seed), F.lit(level + 1), "doc_id", "source", "size"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    state = rest.select(F.col("rid").alias("doc_id"), "source", "size", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), "whole", "part")
    state = state.withColumn("node", F.pmod(F.xxhash64("doc_id"), F.lit(nodes))).withColumn("draw", draw(0)).select(*(c.split()[0] for c in STATE.split(", ")))
    decided, tables = _settled(state, nodes, draw)
    tables += [shares, first, rest]
    decided = decided.select(F.col("doc_id").alias("rid"), F.round("part").alias("_part"))
    rest = rest.join(decided, "rid").withColumn("part", F.col("_part")).select(*first.columns)
    every = first.where(~fraction).unionByName(rest).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.round("part").cast("int")).otherwise(0))
    times = every.where("copies > 0").withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return holding(times.select(*(F.col(c).alias(n) for c, n in zip(clash, names, strict=True))), *tables)


def repeat(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as the column says, in two steps: no array grows with the count beyond its root."""
    block = 1000
    df = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / block))))
    own = F.least(F.lit(block), F.col(times) - F.col("_block") * block)
    return df.withColumn("_each", F.explode(F.sequence(F.lit(1), own.cast("int")))).drop("_block", "_each")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return repeat(mixed, "n").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
