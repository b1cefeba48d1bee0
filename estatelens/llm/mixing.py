"""Sources mixed to target shares of the total size.

How much each source gives: its target share of the total, at most its size times the allowed
repeats. By default the total is the largest at which the scarcest source still reaches its
share. For a larger total, given as a parameter, what capped sources leave is shared by the
others in proportion to their targets until all is placed (water filling).

In which order: slots of equal size are dealt to sources by a low-discrepancy sequence. Slot i
lies at frac((i + 1) / golden ratio) on the line of cumulative shares, so every prefix of the
schedule has nearly the target shares. A source whose share no point meets, as slots are few or the share is narrow,
gets one slot behind the others. The k-th slot of a source takes its k-th block of shuffled documents of
about equal tokens; the repeats of a source are further passes over its blocks.

Running sums are taken in two levels (hash buckets in the shuffled order, at most 65,536 a source, then within a bucket), so no source is
ever summed in one task, and buckets that lie wholly behind what a source is due are left out before the second level.
Documents with no tokens (null and empty texts) take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.session import cut

GOLDEN = (math.sqrt(5) - 1) / 2
MOST_SOURCES = 100_000
CHUNK = 4096
MOST_BUCKETS = 1 << 16


def allocation(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens of each source; ``targets`` gives share and repeats.

    Without ``total`` it is the largest total at which every source that has documents reaches its
    target (targets of sources without documents are dealt to the others in proportion), so that
    shares miss their targets only where the repeats allow no more.
    """
    room = {s: float(sizes.get(s, 0)) * max(0, repeats) for s, (_, repeats) in targets.items()}
    live = [s for s, (share, _) in targets.items() if share > 0 and room[s] > 0]
    weights = sum(targets[s][0] for s in live)
    goal = min((room[s] * weights / targets[s][0] for s in live), default=0.0) if total is None else float(total)
    given, open_ = dict.fromkeys(targets, 0.0), {s for s, (share, _) in targets.items() if share > 0 and room[s] > 0}
    left = goal
    while open_ and left > 1e-9:
        weight = sum(targets[s][0] for s in open_)
        full = {s for s in open_ if room[s] <= left * targets[s][0] / weight}
        if not full:
            given.update({s: left * targets[s][0] / weight for s in open_})
            break
        for s in full:
            given[s] = room[s]
        left -= sum(room[s] for s in full)
        open_ -= full
    return given


def mix(documents: DataFrame, targets: DataFrame, tokens: str = "n_tokens", seed: int = 17, block: int | None = None, total: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(schedule, shares): chosen documents with repeat number and slot, and actual against target shares.

    ``documents`` has doc_id, source and ``tokens``; ``targets`` has source, target_share, max_repeats.
    ``block`` is the size of a slot in tokens, by default 1/20,000 of the total and at least 8,192.
    ``total`` is the size of the mix, "corpus" for as many tokens as the documents of all target sources have.
    Sources that only one side has give nothing. A source without documents has an actual share of 0. ``unused_tokens``
    are those of a source's documents that the mix leaves out.
    """
    spark = documents.sparkSession
    wanted = targets.select("source", "target_share", "max_repeats").filter("source IS NOT NULL")
    rows = wanted.limit(MOST_SOURCES + 1).collect()  # a configuration table, its size is checked
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    goals = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in rows}
    plan_schema = "source string, target_share double, max_repeats int, size bigint, tokens_due double, n_buckets bigint"
    sized = cut(documents.select(F.col("doc_id"), F.col("source"), F.col(tokens).cast("bigint").alias("n")).filter("n > 0 AND source IS NOT NULL").join(wanted.select("source"), "source", "left_semi"))
    sizes = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # at most one row per target source
    due = allocation(sizes, goals, float(sum(sizes.values())) if total == "corpus" else total)
    goal = sum(due.values())
    block = block or max(8192, int(goal / 20_000))
    plan = spark.createDataFrame([(s, goals[s][0], goals[s][1], int(sizes.get(s, 0)), due[s], min(MOST_BUCKETS, max(1, math.ceil(sizes.get(s, 0) / (block * 16))))) for s in goals], plan_schema)
    live = [s for s in goals if due[s] > 0]
    n_slots = sum(max(1, round(due[s] / block)) for s in live)

    # slots: position on the line of cumulative shares
    edges, at = [], 0.0
    for s in live:
        at += due[s] / goal
        edges.append((s, at))
    ends = F.array(*[F.lit(e) for _, e in edges[:-1]]) if len(edges) > 1 else F.array().cast("array<double>")
    names = F.array(*[F.lit(s) for s, _ in edges]) if edges else F.array().cast("array<string>")
    point = (F.col("id") + 1) * F.lit(GOLDEN)
    x = point - F.floor(point)
    slots = spark.range(n_slots).withColumn("source", F.element_at(names, F.size(F.filter(ends, lambda e: e <= x)) + 1)).withColumn("chunk", F.floor(F.col("id") / CHUNK))
    per_chunk = slots.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("c"))
    offsets = per_chunk.select("source", "chunk", (F.sum("c").over(Window.partitionBy("source").orderBy("chunk")) - F.col("c")).alias("base"))
    slots = slots.join(offsets, ["source", "chunk"]).withColumn("k", F.col("base") + F.row_number().over(Window.partitionBy("source", "chunk").orderBy("id")) - 1).select("source", "k", F.col("id").alias("slot"))
    # a share that none of the points met gets one slot behind the others, so that no source that is due tokens is lost
    unmet = plan.filter("tokens_due > 0").join(per_chunk, "source", "left_anti")
    slots = slots.unionByName(unmet.select("source", F.lit(0).cast("bigint").alias("k"), (F.lit(n_slots) + F.row_number().over(Window.orderBy("source")) - 1).cast("bigint").alias("slot")))  # at most one row per target

    # documents: place of each in its source's shuffled sequence; plan has as many rows as targets, checked above
    facts = F.broadcast(plan.filter("tokens_due > 0").select("source", "max_repeats", "size", "tokens_due", "n_buckets"))
    shuffled = sized.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1)).join(facts, "source")
    shuffled = shuffled.withColumn("bucket", F.shiftright(F.shiftright("h", 31) * F.col("n_buckets"), 32))
    sums = shuffled.groupBy("source", "bucket", "tokens_due").agg(F.sum("n").alias("t"))
    bases = sums.select("source", "bucket", "tokens_due", (F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("base"))
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = shuffled.join(bases.filter("base < tokens_due").drop("tokens_due"), ["source", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    # a repeat is one more pass; a document counts while its start lies below what is due
    repeated = placed.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.col("max_repeats") - 1, F.ceil(F.col("tokens_due") / F.col("size")).cast("int") - 1)))))
    repeated = repeated.withColumn("from", F.col("start") + F.col("repeat") * F.col("size")).filter(F.col("from") + F.col("n") / 2 <= F.col("tokens_due"))
    # due tokens and slots of a source differ by less than a slot; the last slot takes what is over
    counts = slots.groupBy("source").agg(F.count(F.lit(1)).alias("n_slots"))
    blocks = repeated.join(F.broadcast(counts), "source").withColumn("k", F.least(F.floor(F.col("from") * F.col("n_slots") / F.col("tokens_due")), F.col("n_slots") - 1))
    schedule = blocks.join(slots, ["source", "k"]).select("doc_id", "source", F.col("repeat").cast("int").alias("repeat_no"), "slot", F.col("n").alias("n_tokens"))
    chosen = schedule.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_uses"), F.count_if(F.col("repeat_no") == 0).alias("n_documents"), F.sum(F.when(F.col("repeat_no") == 0, F.col("n_tokens"))).alias("used"), F.max("repeat_no").alias("last_repeat"))
    whole = chosen.agg(F.sum("tokens").alias("all_tokens"))
    shares = plan.join(chosen, "source", "left").withColumn("all_tokens", whole.scalar()).select(
        "source", "target_share", "max_repeats", F.col("size").alias("available_tokens"), F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.col("size") - F.coalesce("used", F.lit(0))).alias("unused_tokens"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce(F.col("last_repeat") + 1, F.lit(0)).alias("repeats"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share")
    )
    return schedule, shares


def due_tokens(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, available, due): what each target source gives by default, as a query over (source, n) sizes; see ``allocation``."""
    room = targets.filter("source IS NOT NULL").join(sizes.filter("n > 0").groupBy("source").agg(F.sum("n").alias("available")), "source", "left")
    room = room.withColumns({"available": F.coalesce("available", F.lit(0)), "live": (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("available").isNotNull()})
    bounds = room.filter("live").agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("least"))
    return room.select("source", "available", F.when(F.col("live"), F.col("target_share") * bounds.scalar()).otherwise(0.0).alias("due"))
