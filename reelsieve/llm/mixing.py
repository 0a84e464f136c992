"""Mixing sources to target weights by systematic sampling.

Each source's documents stand in one fixed order. A document of ``n`` tokens of a source drawn ``rate``
times over is expected in ``rate`` copies. With one size for all documents the prefix sum of these
expectations, plus one random offset of the source, crosses an integer boundary as often as the document
is drawn. Sizes differ widely here, so the prefix sum of each document's expected tokens decides: the
documents of one size class (sizes within three percent of each other) form a stretch of the order, the
largest first, and each stretch begins with what the ones before it fell short of their expected tokens,
so what one stretch gains the next gives back.
Copies are the floor or the ceiling of the rate, and the source's tokens are within about one document
of its target. The prefix sums are made in two levels (blocks of documents, then within a block), so a
source with a third of all documents is never in one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsieve.session import cut

#: Documents of a block of prefix sums, at most about so many.
BLOCK_ROWS = 100_000


def offset(source: str, seed: int) -> float:
    """The random offset of a source in [0, 1), from its name and the seed."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{source}".encode()).digest()[:6], "big") / 2**48


def plan_rates(have: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """How often a document of each source is expected to be drawn.

    Sources without tokens can't be drawn; their share falls to the others in proportion. ``total`` is
    the size of the mix; without one it is what all sources have, each once. Sources that would pass their
    cap are drawn at it and fall short of their target, so that a poor source can't shrink the mix; the
    others keep the proportions of their targets and share out what is missing, until it is placed or all
    are at their caps.
    """
    open_ = {s for s in share if share[s] and share[s] > 0 and have.get(s, 0) > 0 and (repeats.get(s) or 0) > 0}
    if not open_:
        return {}
    rates: dict[str, float] = {}
    rest = float(sum(have[s] for s in open_) if total is None else total)
    while open_:
        weight = sum(share[s] for s in open_)
        full = {s for s in open_ if rest * share[s] / weight >= repeats[s] * have[s] * (1 - 1e-12)}
        if not full:
            return rates | {s: rest * share[s] / weight / have[s] for s in open_}
        for s in full:
            rates[s] = float(repeats[s])
            rest -= repeats[s] * have[s]
        open_ -= full
    return rates


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, n_docs, n_tokens): combines before its shuffle."""
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))


def draw(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents drawn at least once.

    ``docs``: doc_id, source, n_tokens. ``targets``: source, target_share, max_repeats (one row a
    source; a handful of rows, it is collected with the sources' sizes; sources outside the targets
    aren't collected). Rows repeated in ``docs`` count once by doc_id. Documents without tokens, with
    a null source or one outside the targets are never drawn; targets with a null or non-positive
    share or cap draw nothing. The order within a source is by size class, then a hash of doc_id, then
    doc_id, so that the drawn documents' sizes are spread like the source's; the result depends on the
    rows and the seed only, not on partitions. The counted documents are cut once.
    """
    spark = docs.sparkSession
    goal = {r["source"]: r for r in targets.select("source", "target_share", "max_repeats").distinct().collect() if r["source"] is not None}
    docs = docs.groupBy("doc_id").agg(F.max(F.struct("source", "n_tokens")).alias("r")).select("doc_id", "r.source", "r.n_tokens")
    docs = docs.where(F.col("source").isin(*goal) & (F.col("n_tokens") > 0)) if goal else docs.where(F.lit(False))
    docs = cut(docs)
    have = {r["source"]: (r["n_docs"], r["n_tokens"]) for r in source_sizes(docs).collect()}
    rates = plan_rates({s: n for s, (_, n) in have.items()}, {s: r["target_share"] for s, r in goal.items()}, {s: r["max_repeats"] for s, r in goal.items()}, total_tokens)
    plan = spark.createDataFrame([(s, float(rates[s]), offset(s, seed), max(1, -(-have[s][0] // BLOCK_ROWS)), int(goal[s]["max_repeats"])) for s in rates], "source string, rate double, start double, blocks int, cap int")
    placed = docs.join(F.broadcast(plan), "source").withColumn("size_class", size_class(F.col("n_tokens"))).withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    placed = placed.withColumn("block", F.pmod("h", "blocks"))
    starts = class_starts(placed, plan)
    # level 1: documents of the class before each block; few blocks a source, and the window runs over them only
    counts = placed.groupBy("source", "size_class", "block").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source", "size_class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n").join(F.broadcast(starts), ["source", "size_class"])
    within = Window.partitionBy("source", "size_class", "block").orderBy("h", "doc_id")
    ranked = placed.join(counts, ["source", "size_class", "block"]).withColumn("k", F.col("ahead") + F.row_number().over(within))
    # level 2: boundaries crossed between the prefix sums before and after the document
    upto = lambda k: F.floor(F.col("begin") + k * F.col("rate") + F.lit(1e-9))
    copies = F.least(upto(F.col("k")) - upto(F.col("k") - 1), F.col("cap"))
    return ranked.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")


#: Size classes to the doubling of a size.
CLASSES = 24


def size_class(tokens: Column) -> Column:
    return F.floor(F.log2(tokens) * CLASSES).cast("int")


def class_starts(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, size_class, begin): where each class's prefix sum begins, one row a class.

    Classes are taken from the largest documents down. A class of ``n`` documents draws floor(begin +
    n * rate) copies; ``begin`` is the source's random offset for the first class, later what the classes
    before fell short of their expected tokens, in documents of this class, kept within [0, 1). A source
    has at most about CLASSES classes a doubling, a few hundred, whatever the number of its documents.
    """
    sizes = placed.groupBy("source", "size_class").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    packed = sizes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size_class", "n", "tokens")), asc=False).alias("cs"))
    packed = packed.join(F.broadcast(plan.select("source", "rate", "start")), "source")
    zero = F.lit(0.0)
    begin = F.struct(F.slice(F.array(F.struct(F.lit(0).alias("size_class"), zero.alias("begin"))), 1, 0).alias("out"), zero.alias("owed"))

    def step(acc: Column, c: Column) -> Column:
        mean = c["tokens"] / c["n"]
        want = F.when(F.size(acc["out"]) == 0, F.col("start")).otherwise(0.5 + acc["owed"] / mean)
        at = F.greatest(zero, F.least(want, F.lit(1 - 1e-6)))
        drawn = F.floor(at + c["n"] * F.col("rate") + 1e-9)
        return F.struct(F.concat(acc["out"], F.array(F.struct(c["size_class"].alias("size_class"), at.alias("begin")))).alias("out"), (acc["owed"] + (c["n"] * F.col("rate") - drawn) * mean).alias("owed"))

    return packed.select("source", F.inline(F.aggregate("cs", begin, step, lambda acc: acc["out"])))


def report(docs: DataFrame, targets: DataFrame, drawn: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Per source: target share, what it has, what was drawn, and the shares planned and really reached.

    ``share_planned`` is the target after the caps: a source at its cap falls short of its target, the
    others share out what it leaves. ``at_cap`` tells which. Sources of the documents without a target,
    null too, are listed with a target share of 0.
    """
    had = source_sizes(docs).withColumnRenamed("n_docs", "docs_in_source").withColumnRenamed("n_tokens", "tokens_in_source")
    got = drawn.groupBy("source").agg(F.count("*").alias("docs_drawn"), F.sum("copies").alias("copies_drawn"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_drawn"))
    goal = targets.select("source", "target_share", "max_repeats").distinct()
    everything = Window.partitionBy()  # over one row a source
    t = had.alias("h").join(goal.alias("g"), F.col("h.source").eqNullSafe(F.col("g.source")), "full_outer")
    t = t.select(F.coalesce("h.source", "g.source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", "docs_in_source", "tokens_in_source")
    t = t.join(got, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    t = t.select("source", "target_share", "max_repeats", *[zero(c) for c in ("docs_in_source", "tokens_in_source", "docs_drawn", "copies_drawn", "most_copies", "tokens_drawn")])
    sum_all = F.sum("tokens_drawn").over(everything)
    t = t.withColumn("share_reached", F.when(sum_all > 0, F.round(F.col("tokens_drawn") / sum_all, 6)).otherwise(0.0))
    # the plan is made of one row a source
    rows = [r for r in t.select("source", "target_share", "max_repeats", "tokens_in_source").collect() if r["source"] is not None]
    have = {r["source"]: r["tokens_in_source"] for r in rows}
    rates = plan_rates(have, {r["source"]: r["target_share"] for r in rows}, {r["source"]: r["max_repeats"] for r in rows}, total_tokens)
    size = sum(rates[s] * have[s] for s in rates) or 1.0
    planned = [(s, rates[s] * have[s] / size, rates[s] >= next(r["max_repeats"] for r in rows if r["source"] == s)) for s in rates]
    plan = t.sparkSession.createDataFrame(planned, "source string, share_planned double, at_cap boolean")
    t = t.join(F.broadcast(plan), "source", "left")
    return t.withColumns({"share_planned": F.round(F.coalesce("share_planned", F.lit(0.0)), 6), "at_cap": F.coalesce("at_cap", F.lit(False))})
