"""Pair, group and information metrics, sweeps and reports. Ratios of nothing are `empty` (0 or 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, empty).otherwise(F.round(a / b, 6))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(F.round(2 * p * r / (p + r), 6))


def confusion(rows: DataFrame, predicted: str = "predicted", truth: str = "truth", keys: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn of boolean columns."""
    p, t = F.col(predicted), F.col(truth)
    return rows.groupBy(*keys).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))


def with_scores(counts: DataFrame, empty: float = 0.0) -> DataFrame:
    """tp, fp, fn with precision, recall and f1."""
    out = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), empty)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), empty))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def choose2(n: Column) -> Column:
    return F.sum(n * (n - 1) / 2).cast("long")


def contingency(records: DataFrame) -> DataFrame:
    """label, cluster_id, n."""
    return records.groupBy("label", "cluster_id").agg(F.count("*").alias("n"))


def sums(cells: DataFrame) -> DataFrame:
    """One row: pairs within cells, labels, clusters and all, without making a pair."""
    both = cells.agg(choose2(F.col("n")).alias("tp"), F.sum("n").alias("total"))
    by = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(choose2(F.col("n")).alias(name))
    # One row each.
    return both.join(by("label", "labelled")).join(by("cluster_id", "matched"))


def pair_metrics(records: DataFrame, empty: float = 0.0) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 over all pairs of records (label, cluster_id), from group sizes alone."""
    s = sums(contingency(records))
    counts = s.select("tp", (F.col("labelled") - F.col("tp")).alias("fp"), (F.col("matched") - F.col("tp")).alias("fn"), (F.expr("total * (total - 1) / 2").cast("long") - F.col("labelled") - F.col("matched") + F.col("tp")).alias("tn"))
    return with_scores(counts, empty)


def group_overlap(records: DataFrame) -> DataFrame:
    """group_precision, group_recall (mean share of the largest overlap), exact (labels that are clusters), complete (share of them)."""
    cells = contingency(records)
    label = cells.groupBy("label").agg(F.max("n").alias("top"), F.sum("n").alias("size"))
    cluster = cells.groupBy("cluster_id").agg(F.max("n").alias("top"), F.sum("n").alias("size"))
    exact = cells.join(label.select("label", F.col("size").alias("ls")), "label").join(cluster.select("cluster_id", F.col("size").alias("cs")), "cluster_id").where("n = ls and n = cs").agg(F.count("*").alias("exact"))
    p = label.agg(F.round(F.sum("top") / F.sum("size"), 6).alias("group_precision"), F.count("*").alias("labels"))
    r = cluster.agg(F.round(F.sum("top") / F.sum("size"), 6).alias("group_recall"), F.count("*").alias("clusters"))
    return p.join(r).join(exact).withColumn("complete", ratio(F.col("exact"), F.col("clusters")))


def record_metrics(records: DataFrame) -> DataFrame:
    """Sums over records of R (its label's records), I (its cluster's), their overlap and difference; and shares."""
    cells = contingency(records)
    label = cells.groupBy("label").agg(F.sum("n").alias("r"))
    cluster = cells.groupBy("cluster_id").agg(F.sum("n").alias("i"))
    rows = cells.join(label, "label").join(cluster, "cluster_id")
    s = rows.agg(
        F.sum("n").alias("records"), F.sum(F.col("n") * F.col("n")).alias("match"), F.sum(F.col("n") * F.col("r")).alias("r"), F.sum(F.col("n") * F.col("i")).alias("i"),
        F.sum(F.col("n") * (F.col("r") + F.col("i") - 2 * F.col("n"))).alias("mismatch"), F.sum(F.when((F.col("r") == F.col("n")) & (F.col("i") == F.col("n")), F.col("n")).otherwise(0)).alias("complete"),
    )
    return s.select("records", "match", "mismatch", "complete", ratio(F.col("match"), F.col("r")).alias("precision"), ratio(F.col("match"), F.col("i")).alias("recall"), ratio(F.col("complete"), F.col("records")).alias("complete_share"))


def information(records: DataFrame) -> DataFrame:
    """ari, homogeneity, completeness, v (equal to nmi) of label against cluster_id."""
    cells = contingency(records)
    s = sums(cells)
    # Products of counts of pairs don't fit in 64 bits.
    total, labelled, matched = (F.col(c).cast("double") for c in ("total", "labelled", "matched"))
    entropy = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).join(cells.agg(F.sum("n").alias("all"))).agg((-F.sum(F.col("n") / F.col("all") * F.log(F.col("n") / F.col("all")))).alias(name))
    l, c = cells.groupBy("label").agg(F.sum("n").alias("ln")), cells.groupBy("cluster_id").agg(F.sum("n").alias("cn"))
    mutual = cells.join(l, "label").join(c, "cluster_id").join(cells.agg(F.sum("n").alias("all"))).agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n").cast("double") * F.col("all") / (F.col("ln").cast("double") * F.col("cn")))).alias("mi"))
    one = s.join(entropy("label", "hl")).join(entropy("cluster_id", "hc")).join(mutual)
    expected = labelled * matched / (total * (total - 1) / 2)
    most = (labelled + matched) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("tp") - expected) / (most - expected))
    h, k = F.when(F.col("hc") == 0, 1.0).otherwise(F.col("mi") / F.col("hc")), F.when(F.col("hl") == 0, 1.0).otherwise(F.col("mi") / F.col("hl"))
    v = F.when(h + k == 0, 0.0).otherwise(2 * h * k / (h + k))
    return one.select(F.round(ari, 6).alias("ari"), F.round(v, 6).alias("nmi"), F.round(h, 6).alias("homogeneity"), F.round(k, 6).alias("completeness"), F.round(v, 6).alias("v"))


def threshold_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1: one pass, a column for each threshold."""
    p, t = F.col("p"), F.col("truth")
    counted = scores.agg(F.count_if(t).alias("all"), *(x for i, v in enumerate(thresholds) for x in (F.count_if((p >= v) & t).alias(f"tp{i}"), F.count_if((p >= v) & ~t).alias(f"fp{i}"))))
    rows = F.array(*(F.struct(F.lit(v).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), (F.col("all") - F.col(f"tp{i}")).alias("fn")) for i, v in enumerate(thresholds)))
    return with_scores(counted.select(F.explode(rows).alias("r")).select("r.*"))


def band_sweep(scores: DataFrame, bands: list[tuple[float, float]]) -> DataFrame:
    """lo, hi, accepted, rejected, asked, saved (share that needs no expensive call)."""
    p = F.col("p")
    rows = F.array(*(F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.col(f"a{i}").alias("accepted"), F.col(f"r{i}").alias("rejected")) for i, (lo, hi) in enumerate(bands)))
    counted = scores.agg(F.count("*").alias("n"), *(x for i, (lo, hi) in enumerate(bands) for x in (F.count_if(p >= hi).alias(f"a{i}"), F.count_if(p <= lo).alias(f"r{i}"))))
    return counted.select("n", F.explode(rows).alias("b")).select("b.*", "n").withColumn("asked", F.col("n") - F.col("accepted") - F.col("rejected")).withColumn("saved", ratio(F.col("accepted") + F.col("rejected"), F.col("n"))).drop("n")


def histogram(scores: DataFrame, column: str = "p") -> DataFrame:
    """bin, n in tenths; 1.0 is in the last."""
    return scores.groupBy(F.least(F.floor(F.col(column) * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def score_stats(scores: DataFrame, tau: float) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), F.round(F.min("p"), 6).alias("least"), F.round(F.max("p"), 6).alias("most"), F.round(F.avg("p"), 6).alias("mean"), F.count_if(F.col("p") >= tau).alias("over"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """both, only_a, only_b, agreement of two sets of pairs."""
    j = a.select("a", "b", F.lit(1).alias("x")).join(b.select("a", "b", F.lit(1).alias("y")), ["a", "b"], "full")
    out = j.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"), F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"))
    return out.withColumn("agreement", ratio(F.col("both"), F.col("both") + F.col("only_a") + F.col("only_b"), 1.0))


def cost(pairs: DataFrame, batch: int = 20, tokens: int = 800, price: float = 0.06) -> DataFrame:
    n = F.count("*")
    return pairs.agg(n.alias("calls"), F.ceil(n / batch).cast("long").alias("batches"), (n * tokens).alias("tokens"), F.round(n * tokens / 1000 * price, 6).alias("dollars"))


def label6(truth: Column, decision: Column) -> Column:
    """TP, FP, FN, TN or the two unknowns by truth + (2 if same, 0 if not, 4 if unknown)."""
    code = truth.cast("int") + F.when(decision == "SAME", 2).when(decision == "NOT_SAME", 0).otherwise(4)
    return F.element_at(F.array(*(F.lit(x) for x in ("TN", "FN", "FP", "TP", "UNKNOWN_MISMATCH", "UNKNOWN_MATCH"))), code + 1)
