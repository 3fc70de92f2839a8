"""Losses over a sample's page scores, and over a page's block scores.

rows of pages: (sample, page_index, logit, is_target) and, for readout and focus,
``focus``, the best score of the page's blocks; ``retained`` is how many pages the
sample may keep, null where it has no such budget. rows of blocks: (sample,
page_index, block_index, logit, is_target) and ``page_is_target``.

A sample's pages (a page's blocks) become two short arrays in one grouping: positives,
and negatives by falling score, ties by index. Everything else is an expression
over them, so each loss is one shuffle. Samples without a loss have none: no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sides(rows: DataFrame, group: list[str], index: str, by: str, *more: str) -> DataFrame:
    """group, pos and neg (arrays of structs, best first by ``by``), n, retained."""
    entry = F.struct((-F.col(by).cast("double")).alias("down"), F.col(index).alias("at"), F.col(by).cast("double").alias("s"), *[F.col(c).cast("double").alias(c) for c in more])
    side = lambda on: F.array_sort(F.collect_list(F.when(on, entry)))
    target = F.coalesce(F.col("is_target"), F.lit(False))
    retained = [F.max("retained").alias("retained")] if "retained" in rows.columns else [F.lit(None).cast("long").alias("retained")]
    return rows.groupBy(*group).agg(side(target).alias("pos"), side(~target).alias("neg"), F.count("*").alias("n"), *retained)


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _hinge(pos: Column, neg: Column, margin: float) -> Column:
    """Mean of max(0, margin - p + n) over all pairs of two arrays of numbers."""
    per = F.transform(pos, lambda p: F.aggregate(neg, F.lit(0.0), lambda s, n: s + F.greatest(F.lit(0.0), F.lit(margin) - p + n)))
    return F.aggregate(per, F.lit(0.0), lambda s, x: s + x) / (F.size(pos) * F.size(neg))


def _budget() -> Column:
    return F.coalesce(F.col("retained") > 0, F.lit(False))


def _slots() -> Column:
    """Negatives that fit beside the positives."""
    return F.greatest(F.lit(0), F.col("retained").cast("int") - F.size("pos"))


def _hard(topk: int) -> Column:
    """Negatives up to the first that must not fit, where there is a budget; else the ``topk`` hardest."""
    k = F.when(_budget(), F.least(F.size("neg"), _slots() + 1)).otherwise(F.least(F.size("neg"), F.lit(max(1, topk))))
    return F.slice("neg", F.lit(1), k)


def _crowded() -> Column:
    """Whether there are positives, and more negatives than fit."""
    return (F.size("pos") > 0) & (F.size("neg") > 0) & (~_budget() | (F.size("neg") > _slots()))


def _scores(a: Column, field: str = "s") -> Column:
    return F.transform(a, lambda x: x[field])


def readout_ranking(rows: DataFrame, margin: float, topk: int = 1, focus_weight: float = 0.25) -> DataFrame:
    """(sample, loss, pairs, focus_pairs): positives above the hard negatives, by page score and, weighed, by focus.

    With a budget the page term is held against the first negative that must not fit alone.
    """
    focused = "focus" in rows.columns and focus_weight > 0
    per = _sides(rows, ["sample"], "page_index", "logit", *(["focus"] if focused else [])).where(_crowded()).withColumn("hard", _hard(topk))
    edge = F.slice(_scores(F.col("hard")), -1, 1)
    against = F.when(_budget(), edge).otherwise(_scores(F.col("hard")))
    loss = _hinge(_scores(F.col("pos")), against, margin)
    pairs = F.size("pos") * F.size(against)
    if focused:
        loss = loss + F.lit(float(focus_weight)) * _hinge(_scores(F.col("pos"), "focus"), _scores(F.col("hard"), "focus"), margin)
    focus_pairs = F.size("pos") * F.size("hard") if focused else F.lit(0)
    return per.select("sample", loss.alias("loss"), pairs.cast("long").alias("pairs"), focus_pairs.cast("long").alias("focus_pairs"))


def single_page_focus(rows: DataFrame, margin: float, topk: int = 1) -> DataFrame:
    """(sample, loss, pairs): of samples with one target page, its focus against the others'."""
    per = _sides(rows, ["sample"], "page_index", "focus").where((F.size("pos") == 1) & _crowded()).withColumn("hard", _scores(_hard(topk)))
    against = F.when(_budget(), F.slice("hard", -1, 1)).otherwise(F.col("hard"))
    return per.select("sample", _hinge(_scores(F.col("pos")), against, margin).alias("loss"), F.size(against).cast("long").alias("pairs"))


def multi_page_coverage(rows: DataFrame, margin: float, topk: int = 1) -> DataFrame:
    """(sample, loss, positives): of samples with several target pages, the weakest against the last hard negative."""
    per = _sides(rows, ["sample"], "page_index", "logit").where((F.size("pos") >= 2) & _crowded()).withColumn("hard", _scores(_hard(topk)))
    weakest = F.element_at(_scores(F.col("pos")), -1)
    loss = F.greatest(F.lit(0.0), F.lit(margin) - weakest + F.element_at("hard", -1))
    return per.select("sample", loss.alias("loss"), F.size("pos").cast("long").alias("positives"))


def _membership(s: Column, threshold: Column, temperature: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(s - threshold) / max(temperature, 1e-6)))


def _cross_entropy(p: Column, target: Column) -> Column:
    """-(t ln p + (1 - t) ln(1 - p)), each logarithm -100 at least."""
    log = lambda x: F.greatest(F.lit(-100.0), F.when(x > 0, F.log(x)).otherwise(F.lit(-100.0)))
    return -(target * log(p) + (1.0 - target) * log(1.0 - p))


def _edge(k: Column) -> Column:
    """The midpoint between the last of the k best of all scores and the first beyond."""
    ranked = F.sort_array(F.concat(_scores(F.col("pos")), _scores(F.col("neg"))), asc=False)
    return 0.5 * (F.element_at(ranked, k) + F.element_at(ranked, k + 1))


def _boundary(keep: Column, most: int) -> Column:
    """Negatives just beyond those that fit beside the positives; empty where all fit."""
    fits = F.greatest(F.lit(0), keep - F.least(F.size("pos"), keep))
    beyond = F.greatest(F.lit(0), F.size("neg") - fits)
    count = F.least(F.lit(most) if most > 0 else F.greatest(F.lit(1), keep), beyond)
    return F.when(beyond > 0, F.slice("neg", fits + 1, count)).otherwise(F.slice("neg", 1, 0))


def _set_loss(per: DataFrame, keep: Column, hard: Column, temperature: float, negative_weight: float) -> DataFrame:
    """Cross entropy of the soft top-k membership: positives towards their share of the places, hard negatives towards 0."""
    per = per.withColumn("edge", _edge(keep)).withColumn("hard", hard)
    share = F.least(F.size("pos"), keep).cast("double") / F.size("pos")
    soft = lambda x: _membership(x.s, F.col("edge"), temperature)
    positive = _mean(F.transform("pos", lambda x: _cross_entropy(soft(x), share)))
    negative = F.when(F.size("hard") > 0, _mean(F.transform("hard", lambda x: _cross_entropy(soft(x), F.lit(0.0))))).otherwise(0.0)
    return per.withColumn("loss", positive + F.lit(float(negative_weight)) * negative).withColumn("positives", F.size("pos").cast("long"))


def page_retained_set(rows: DataFrame, temperature: float, negative_weight: float, negative_topk: int = 0) -> DataFrame:
    """(sample, loss, positives): target pages ought to be among the retained ones, boundary negatives not."""
    keep = F.col("retained").cast("int")
    per = _sides(rows, ["sample"], "page_index", "logit").where((F.size("pos") > 0) & (F.size("neg") > 0) & (F.col("retained") > 0) & (F.col("retained") < F.col("n")))
    return _set_loss(per, keep, _boundary(keep, negative_topk), temperature, negative_weight).select("sample", "loss", "positives")


def retained_recovery(rows: DataFrame, margin: float, negative_topk: int = 0) -> DataFrame:
    """(sample, loss, pairs, in_top): of samples with one target page, it against the boundary negatives.

    ``in_top`` tells whether it is retained; where all negatives fit the loss is null.
    """
    keep = F.col("retained").cast("int")
    per = _sides(rows, ["sample"], "page_index", "logit").where((F.size("pos") == 1) & (F.size("neg") > 0) & (F.col("retained") > 0) & (F.col("retained") < F.col("n")))
    per = per.withColumn("hard", _scores(_boundary(keep, negative_topk)))
    own = F.col("pos")[0]
    ahead = F.size(F.filter("neg", lambda x: (x.s > own.s) | ((x.s == own.s) & (x.at < own.at))))
    loss = F.when(F.size("hard") > 0, _hinge(_scores(F.col("pos")), F.col("hard"), margin))
    return per.select("sample", loss.alias("loss"), F.size("hard").cast("long").alias("pairs"), (ahead < keep).alias("in_top"))


def block_retained_set(blocks: DataFrame, keep: int, temperature: float, negative_weight: float, negative_topk: int = 0) -> DataFrame:
    """(sample, page_index, loss, positives): per page with target blocks and more blocks than are kept; the hardest negatives count."""
    per = _sides(blocks, ["sample", "page_index"], "block_index", "logit").where((F.size("pos") > 0) & (F.col("n") > keep))
    hard = F.slice("neg", 1, negative_topk if negative_topk > 0 else max(1, keep))
    return _set_loss(per, F.lit(keep), hard, temperature, negative_weight).select("sample", "page_index", "loss", "positives")


def _block_pages(blocks: DataFrame) -> DataFrame:
    """One row per page: its block arrays, and whether the page is a target."""
    whole = F.array_sort(F.collect_list(F.struct((-F.col("logit").cast("double")).alias("down"), F.col("block_index").alias("at"), F.col("logit").cast("double").alias("s"))))
    about = blocks.groupBy("sample", "page_index").agg(F.max(F.coalesce("page_is_target", F.lit(False))).alias("page_is_target"), whole.alias("all"))
    target = F.coalesce(F.col("is_target"), F.lit(False))
    sides = _sides(blocks.withColumn("is_target", target), ["sample", "page_index"], "block_index", "logit")
    return sides.join(about, ["sample", "page_index"])


def _focus_gap(topk: int, margin: float) -> Column:
    """max(0, margin - mean of the best blocks + mean of the others), or of all where there are no others."""
    k = F.least(F.lit(max(1, topk)), F.size("all"))
    rest = F.slice("all", k + 1, F.greatest(F.lit(0), F.size("all") - k))
    background = F.when(F.size(rest) > 0, _mean(_scores(rest))).otherwise(_mean(_scores(F.col("all"))))
    return F.greatest(F.lit(0.0), F.lit(margin) - _mean(_scores(F.slice("all", F.lit(1), k))) + background)


def _local_margin(kind: str, margin: float, topk: int, keep: int) -> Column:
    """Positives against the page's own negatives: against the first that must not fit, or the ``topk`` hardest; null where there is none."""
    fits = F.greatest(F.lit(0), F.lit(keep) - F.size("pos"))
    if kind == "budget_ranking":
        edge = F.slice(_scores(F.col("neg")), fits + 1, F.lit(1))
        return F.when(F.size("neg") > fits, _hinge(_scores(F.col("pos")), edge, margin))
    return F.when(F.size("neg") > 0, _hinge(_scores(F.col("pos")), F.slice(_scores(F.col("neg")), 1, max(1, topk)), margin))


def block_focus(blocks: DataFrame, kind: str, margin: float, topk: int, keep: int) -> DataFrame:
    """(sample, page_index, kind, loss) of target pages.

    Pages with target blocks: ``ranking`` or ``budget_ranking`` margins, or ``bce``,
    class-weighted cross entropy of the logits. Target pages without: their best blocks
    ought to stand out (``focus``).
    """
    if kind not in ("ranking", "budget_ranking", "bce"):
        raise ValueError(f"unknown loss {kind!r}")
    per = _block_pages(blocks).where("page_is_target")
    if kind == "bce":
        # softplus forms: -ln sigmoid(x) = softplus(-x), -ln(1 - sigmoid(x)) = softplus(x)
        softplus = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
        weight = F.greatest(F.lit(1), F.size("neg")).cast("double") / F.greatest(F.lit(1), F.size("pos"))
        total = F.aggregate("pos", F.lit(0.0), lambda s, x: s + weight * softplus(-x.s)) + F.aggregate("neg", F.lit(0.0), lambda s, x: s + softplus(x.s))
        supervised = total / F.size("all")
    else:
        supervised = _local_margin(kind, margin, topk, keep)
    marked = F.size("pos") > 0
    out = per.select("sample", "page_index", F.when(marked, F.lit(kind)).otherwise("focus").alias("kind"), F.when(marked, supervised).otherwise(_focus_gap(topk, margin)).alias("loss"))
    return out.where(F.col("loss").isNotNull())


def block_readout(blocks: DataFrame, pages: DataFrame, margin: float, topk: int, keep: int, budget: bool = False) -> DataFrame:
    """(sample, page_index, kind, loss) of target pages, their blocks also held against the hard negative pages' best blocks.

    Hard negative pages of a sample are chosen by page score as in
    :func:`readout_ranking`; each counts by its share in their softmax, with its
    ``keep`` best blocks. pages: rows of pages; positives there are pages with target blocks.
    """
    per = _block_pages(blocks)
    marked_pages = per.where("page_is_target AND size(pos) > 0").groupBy("sample").agg(F.count("*").alias("n_marked"))
    negatives = pages.where(~F.coalesce(F.col("is_target"), F.lit(False))).join(marked_pages, "sample", "left")
    entry = F.struct((-F.col("logit").cast("double")).alias("down"), F.col("page_index").alias("at"), F.col("logit").cast("double").alias("s"))
    retained = F.max("retained") if "retained" in pages.columns else F.lit(None).cast("long")
    ranked = negatives.groupBy("sample").agg(F.array_sort(F.collect_list(entry)).alias("neg"), F.coalesce(F.max("n_marked"), F.lit(0)).alias("n_pos"), retained.alias("retained"))
    fits = F.greatest(F.lit(0), F.col("retained").cast("int") - F.col("n_pos").cast("int"))
    count = F.when(_budget(), F.when(F.size("neg") > fits, fits + 1).otherwise(0)).otherwise(F.least(F.size("neg"), F.lit(max(1, topk))))
    hard = ranked.withColumn("hard", F.slice("neg", F.lit(1), count)).where(F.size("hard") > 0)
    mass = F.aggregate("hard", F.lit(0.0), lambda s, x: s + F.exp(x.s - F.col("hard")[0].s))
    weighed = hard.select("sample", F.explode("hard").alias("h"), mass.alias("mass"), F.col("hard")[0].s.alias("peak")).select("sample", F.col("h.at").alias("page_index"), (F.exp(F.col("h.s") - F.col("peak")) / F.col("mass")).alias("w"))
    best = per.select("sample", "page_index", F.slice(_scores(F.col("all")), 1, max(1, keep)).alias("best"))
    groups = weighed.join(best, ["sample", "page_index"]).groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("page_index", "w", "best"))).alias("groups"))
    rows = per.where("page_is_target").join(groups, "sample", "left")
    local = _local_margin("budget_ranking" if budget else "ranking", margin, topk, keep)
    across = F.when(F.size("groups") > 0, F.aggregate("groups", F.lit(0.0), lambda s, g: s + g.w * _hinge(_scores(F.col("pos")), g.best, margin)))
    some = local.isNotNull() | across.isNotNull()
    ranked_loss = F.when(some, F.coalesce(local, F.lit(0.0)) + F.coalesce(across, F.lit(0.0)))
    marked = (F.size("pos") > 0) & some
    return rows.select("sample", "page_index", F.when(marked, "readout").otherwise("focus").alias("kind"), F.when(marked, ranked_loss).otherwise(_focus_gap(topk, margin)).alias("loss"))
