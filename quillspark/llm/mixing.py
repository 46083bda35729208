"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.llm.common import n_words, own_names
from quillspark.session import stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
BEFORE = (W.unboundedPreceding, -1)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``sources`` (source, source_size, ...) with the column target.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; a target
    stops at ``most`` times its source's size, and the excess is shared again by weight. That level is
    found in one pass: in order of cap over weight, the first source whose share of what the earlier
    caps leave does not exceed its own cap sets it. One row a source; the windows see nothing larger.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.lit(list(weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", most * F.col("source_size"))
    earlier = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(*BEFORE)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    leveled = ranked.withColumn("level", left.cast("double") / free)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return leveled.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).drop("weight", "cap", "level")


def draw(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def queued(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
           most: int = 3, seed: int = 17, run_rows: int = 64, most_runs: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): rows (doc_id, draw, size, source_size, target, upto, key, run, place), one for each row of ``docs``; sources (key, source_size, target, n).

    Each source's documents are shuffled by the seeded hash ``draw``; upto: the source's words to the end
    of this document. Running sums over a hot source are taken in two steps: runs of about ``run_rows``
    documents by hash range (``most_runs`` a source at most, so that the sums of a source's runs stay few),
    a running sum over the runs, then one inside each run. (key, run, place) tells rows apart.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"), n_words(F.col(text_col)).alias("size"),
                              draw(seed, F.col(id_col), F.col(text_col)).alias("draw")))
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = targets(sources, weights, most).withColumn("runs", F.least(F.lit(most_runs), F.ceil(F.col("n") / run_rows)).cast("int"))
    sources = stored(sources.drop("source"))  # a table of known size: Spark broadcasts it only below its threshold
    run = F.floor(F.shiftrightunsigned("draw", 33) * F.col("runs") / F.lit(float(1 << 31))).cast("int")
    rows = rows.drop("source").join(sources.drop("n"), "key").withColumn("run", run).drop("runs")
    runs = rows.groupBy("key", "run").agg(F.sum("size").alias("in_run"))
    runs = runs.select("key", "run", F.coalesce(F.sum("in_run").over(W.partitionBy("key").orderBy("run").rowsBetween(*BEFORE)), F.lit(0)).alias("earlier"))
    inside = W.partitionBy("key", "run").orderBy(F.shiftrightunsigned("draw", 1), "draw", "doc_id", "size")  # unsigned, as runs are
    rows = rows.withColumns({"inside": F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)), "place": F.row_number().over(inside)}).join(runs, ["key", "run"])
    return rows.select("doc_id", "draw", "size", "source_size", "target", (F.col("inside") + F.col("earlier")).alias("upto"), "key", "run", "place"), sources


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
                most: int = 3, packet: int = 128, range_rows: int = 64, most_ranges: int = 1 << 16, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken, finish, draw), one row for each row of ``docs``, in order of service.

    Every document is queued ``most`` times in its source, in packets of at most ``packet`` words. A packet's virtual finish time is
    its source's words up to its end over the source's target. All packets of all sources are put in one order, by finish time
    and, on ties, draw; the words before each are summed up in that order, and the queue is cut where the sum reaches the budget, the
    sum of all sizes: packets before are taken whole, the one at the cut in part. Targets add up to the budget,
    so the cut lies near the virtual time 1 and each source ends within about a packet of its target. finish: that of the document's first packet.

    The order is kept in ranges of equal virtual time (words are served evenly in it, so ranges hold about equally many words): the ranges' sums are
    summed up, ``most_ranges`` rows, then the packets inside each range. Packets that finish too late for any cut are not queued: when each of S sources is less than a
    packet behind its target, S packets of words are missing at time 1, and the sources that still have words serve them in S * packet / their targets.

    taken: words that the mix takes, repeats counted. Null or blank text has size 0 and gives none; null
    sources form one source; ids may be null or repeat, each row is queued by itself. An empty table gives
    no rows. Other columns are ignored.
    """
    rows, sources = queued(docs, id_col, text_col, source_col, weights, most, **how)
    open_ = F.sum(F.when(F.col("target") < most * F.col("source_size"), F.col("target")))
    told = sources.agg(F.sum("source_size").alias("budget"), F.count("*").alias("s"), open_.alias("open"), F.sum("n").alias("n")).first()
    budget, latest = told.budget or 0, 1 + (told.s or 0) * (packet + 1) / told.open if told.open else 1.0
    ranges = max(1, min(most_ranges, -(-((told.n or 0) + budget // packet) // range_rows)))
    copies = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    begins = F.col("upto") - F.col("size") + F.col("epoch") * F.col("source_size")
    first = F.col("epoch") == 0
    copies = copies.withColumn("begins", begins).where(first | (F.col("begins") <= latest * F.col("target")))
    packets = copies.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / packet).cast("int") - 1))))
    ends = F.least(F.col("size"), (F.col("k") + 1) * packet)
    packets = packets.withColumns({"words": ends - F.col("k") * packet, "finish": F.try_divide((F.col("begins") + ends).cast("double"), F.col("target"))})
    packets = packets.where((first & (F.col("k") == 0)) | (F.col("finish") <= latest))
    # Packets without words, and those kept only so that their row has a result, take no part in the order; they are spread over ranges of their own.
    idle = (F.col("words") == 0) | ~F.coalesce(F.col("finish") <= latest, F.lit(False))
    packets = packets.withColumns({
        "range": F.when(idle, ranges + 1 + F.pmod(F.xxhash64("draw", "place"), F.lit(ranges))).otherwise(F.floor(F.col("finish") * (ranges / latest))).cast("int"),
        "words": F.when(idle, 0).otherwise(F.col("words")),
    })
    sums = packets.groupBy("range").agg(F.sum("words").alias("in_range"))
    sums = sums.select("range", F.coalesce(F.sum("in_range").over(W.orderBy("range").rowsBetween(*BEFORE)), F.lit(0)).alias("earlier"))
    order = W.partitionBy("range").orderBy("finish", "draw", "key", "run", "place", "k").rowsBetween(*BEFORE)
    sorted_ = packets.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0))).join(sums, "range")
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - F.col("before") - F.col("earlier")))
    one = sorted_.groupBy("key", "run", "place", "doc_id", "draw", "size", "source_size", "target").agg(F.sum(taken).cast("long").alias("taken"), F.min("finish").alias("finish"))
    return one.drop("key", "run", "place").repartitionByRange("finish", "draw").sortWithinPartitions("finish", "draw")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        most: int = 3, seed: int = 17, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it, with all their columns.

    Documents stay whole here: a copy of which the mix takes at least half is taken. Rows that agree in id
    and text share their copies evenly, rounded up. Null and blank texts give none; an empty table no rows.
    """
    rows = mixed_sizes(docs, id_col, text_col, source_col, weights, most, seed=seed, **how)
    at, copies, id_, held, copy = own_names(docs, "at", "copies", "id", "draw", "copy")
    whole = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))
    counts = rows.where("taken > 0").groupBy(F.col("doc_id").alias(id_), F.col("draw").alias(held)).agg(F.sum(whole).alias("whole"))
    n = rows.groupBy(F.col("doc_id").alias("i"), F.col("draw").alias("d")).agg(F.count("*").alias("n"))
    counts = counts.join(n, F.col(id_).eqNullSafe(F.col("i")) & (F.col(held) == F.col("d"))).select(id_, held, F.ceil(F.col("whole") / F.col("n")).cast("int").alias(copies)).where(F.col(copies) > 0)
    marked = docs.withColumn(at, draw(seed, F.col(id_col), F.col(text_col)))
    taken = marked.join(counts, marked[id_col].eqNullSafe(counts[id_]) & (F.col(at) == F.col(held)))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)
