"""Problem 3: lines repeated across the papers of one ticker.

Method: each partition of the lines keeps, per ticker, a Misra-Gries summary
of `capacity` counters (line -> count, and the weight it has pruned). The
summaries merge by adding counts and pruned weights, so a line whose merged
count plus the ticker's pruned weight reaches the threshold is a candidate.
That misses no line as long as the pruned weight is below the threshold; the
lines of tickers where it isn't are all counted, by a partially aggregated
grouping. A second pass counts the distinct papers of the candidates exactly.
The confirmed lines, per ticker at most the mean number of lines of its papers
divided by the share, are a set of keys that is broadcast if its counted size
allows it; it gives the numbers of the lines to remove, which meet the
contents by their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import maybe_broadcast
from tallyloom.session import materialize

MIN_PAPERS = 5
MIN_SHARE = 0.2
CAPACITY = 256
#: Counters that a task holds over all tickers before it hands its summaries on and starts anew.
HELD_COUNTERS = 300_000
BROADCAST_ROWS = 200_000


def line_text(line: Column) -> Column:
    """Lower case, letters and digits only, each run of digits written as 0."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), r"[^\p{L}\p{Nd}]+", ""), r"\p{Nd}+", "0")


def ticker_of(c: Column) -> Column:
    """Tickers without case and outer blanks; null if nothing is left."""
    t = F.upper(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))
    return F.when(t != "", t)


def _summaries(batches: Iterator[pd.DataFrame], capacity: int, most: int) -> Iterator[pd.DataFrame]:
    counts: dict[str, dict] = {}
    pruned: dict[str, int] = {}

    def prune(t: str) -> None:
        own = counts[t]
        if len(own) > capacity:
            cut = sorted(own.values(), reverse=True)[capacity]
            pruned[t] = pruned.get(t, 0) + cut
            counts[t] = {k: n - cut for k, n in own.items() if n > cut}

    def handed_on() -> Iterator[pd.DataFrame]:
        for t in list(counts):
            prune(t)
        rows = [(t, k1, k2, n, 0) for t, own in counts.items() for (k1, k2), n in own.items()] + [(t, 0, 0, 0, n) for t, n in pruned.items() if n]
        counts.clear()
        pruned.clear()
        for k in range(0, len(rows), 50_000):
            yield pd.DataFrame(rows[k : k + 50_000], columns=["ticker", "k1", "k2", "n", "pruned"])

    held = 0
    for b in batches:
        for (t, k1, k2), n in b.groupby(["ticker", "k1", "k2"], sort=False).size().items():
            own = counts.setdefault(t, {})
            before = len(own)
            own[k1, k2] = own.get((k1, k2), 0) + n
            if len(own) > 2 * capacity:
                prune(t)
            held += len(counts[t]) - before
        if held > most:  # summaries add up, so a task may give several
            yield from handed_on()
            held = 0
    yield from handed_on()


def repeated_lines(chunks: DataFrame, *, min_papers: int = MIN_PAPERS, min_share: float = MIN_SHARE, capacity: int = CAPACITY, held: int = HELD_COUNTERS) -> tuple[DataFrame, DataFrame]:
    """Lines (id, text_hash, line_no, ticker, k1, k2) and the confirmed (ticker, k1, k2, papers).

    chunks: id, paper_id, ticker, content, is_table; further columns are
    ignored. Table chunks and those without a ticker or content are not
    searched, but their papers count. A chunk delivered twice counts once, as
    papers are counted distinctly; papers without an id count as none.
    """
    base = chunks.select("id", "paper_id", ticker_of(F.col("ticker")).alias("ticker"), "content", "is_table").where("ticker is not null")
    papers = base.groupBy("ticker", "paper_id").agg(F.lit(1).alias("one")).groupBy("ticker").agg(F.count("paper_id").alias("papers"))
    need = F.greatest(F.lit(min_papers).cast("double"), F.col("papers") * min_share - 1e-9)
    papers = materialize(papers.select("ticker", need.alias("need")), "p3-papers")
    lines = base.where(~F.coalesce("is_table", F.lit(False)) & F.col("content").isNotNull()).select("id", "paper_id", "ticker", F.xxhash64("content").alias("text_hash"), F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
    text = line_text(F.col("line"))
    lines = lines.select("id", "paper_id", "ticker", "text_hash", (F.col("pos") + 1).alias("line_no"), text.alias("text")).where("text <> ''")
    lines = lines.select("id", "paper_id", "ticker", "text_hash", "line_no", F.xxhash64("text").alias("k1"), F.hash("text").cast("long").alias("k2"))
    lines = materialize(lines, "p3-lines")
    local = lines.select("ticker", "k1", "k2").mapInPandas(partial(_summaries, capacity=capacity, most=held), "ticker string, k1 long, k2 long, n long, pruned long")
    merged = local.groupBy("ticker", "k1", "k2").agg(F.sum("n").alias("n"), F.sum("pruned").alias("pruned"))
    merged = materialize(merged, "p3-summaries")
    lost = merged.groupBy("ticker").agg(F.sum("pruned").alias("lost"))
    bar = maybe_broadcast(papers.join(lost, "ticker", "left").select("ticker", "need", F.coalesce("lost", F.lit(0)).alias("lost")), BROADCAST_ROWS)
    candidates = merged.where("n > 0").join(bar, "ticker").where("lost < need and n + lost >= need").select("ticker", "k1", "k2", "need")
    # where so much was pruned, a line over the threshold may have no counter left: all lines of these tickers are counted
    over = bar.where("lost >= need").select("ticker", "need")
    if not over.isEmpty():
        counted = lines.join(maybe_broadcast(over, BROADCAST_ROWS), "ticker").groupBy("ticker", "k1", "k2", "need").agg(F.count(F.lit(1)).alias("n"))
        candidates = candidates.union(counted.where("n >= need").select("ticker", "k1", "k2", "need"))
    candidates = materialize(candidates, "p3-candidates")
    hits = lines.join(maybe_broadcast(candidates, BROADCAST_ROWS), ["ticker", "k1", "k2"])
    exact = hits.groupBy("ticker", "k1", "k2", "need", "paper_id").agg(F.lit(1).alias("one")).groupBy("ticker", "k1", "k2", "need").agg(F.count("paper_id").alias("papers"))
    confirmed = materialize(exact.where("papers >= need").select("ticker", "k1", "k2", "papers"), "p3-confirmed")
    return lines, confirmed


def found_lines(chunks: DataFrame, **how) -> DataFrame:
    """id, line_no of every repeated line, each once."""
    lines, confirmed = repeated_lines(chunks, **how)
    return lines.where("id is not null").join(maybe_broadcast(confirmed, BROADCAST_ROWS), ["ticker", "k1", "k2"]).select("id", "line_no").distinct()


def without_lines(chunks: DataFrame, **how) -> DataFrame:
    """id, content, removed: every chunk once, its repeated lines left out, and how many these were.

    A chunk that isn't searched keeps its content. Of rows with one id the
    one with the smallest content stands.
    """
    lines, confirmed = repeated_lines(chunks, **how)
    cut = lines.where("id is not null").join(maybe_broadcast(confirmed, BROADCAST_ROWS), ["ticker", "k1", "k2"]).groupBy("id", "text_hash", "ticker").agg(F.collect_set("line_no").alias("cut"))
    one = chunks.select("id", "content", ticker_of(F.col("ticker")).alias("ticker"), (~F.coalesce("is_table", F.lit(False))).alias("searched")).where("id is not null")
    one = one.groupBy("id").agg(F.min(F.struct("content", "ticker", "searched")).alias("r")).select("id", "r.*")
    both = one.withColumn("text_hash", F.xxhash64("content")).join(cut.withColumnRenamed("ticker", "of"), ["id", "text_hash"], "left").where("of is null or of = ticker or not searched").dropDuplicates(["id"])
    kept = F.filter(F.split("content", "\n", -1), lambda _, i: ~F.array_contains("cut", i + 1))
    act = F.col("searched") & F.col("cut").isNotNull()
    return both.select("id", F.when(act, F.array_join(kept, "\n")).otherwise(F.col("content")).alias("content"), F.when(act, F.size("cut")).otherwise(F.lit(0)).alias("removed"))
