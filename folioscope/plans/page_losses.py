"""Page and block losses over scores of the documents' own pages and lines.

A page's score is the logarithm of its length, its focus that of its longest line; pages
and lines are targets by how many words they hold. A document keeps a third of its
pages, or has no budget where its first line is short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import tokens
from folioscope.operators import page_losses as L
from folioscope.plans import surrogates as S
from folioscope.plans.registry import register

MARGIN, TOPK, KEEP, TEMPERATURE, NEGATIVES = 0.5, 2, 2, 0.4, 0.3


def scored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(tokens(F.col("text")))
    rows = S.blocks(spark, sf_dir).select(F.col("doc_id").alias("sample"), F.col("page_id").alias("page_index"), F.col("order_index").alias("block_index"), F.log1p(F.length("text").cast("double")).alias("logit"), n.alias("n"), F.length("text").alias("chars"))
    marked = F.sum("n").over(Window.partitionBy("sample", "page_index")) % 3 == 0  # a page's few lines
    return rows.select("sample", "page_index", "block_index", "logit", (F.col("n") % 4 == 0).alias("is_target"), marked.alias("page_is_target"), "chars")


def scored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = scored_blocks(spark, sf_dir)
    pages = blocks.groupBy("sample", "page_index").agg(
        F.log1p(F.sum("chars").cast("double")).alias("logit"), F.max("logit").alias("focus"), F.max("page_is_target").alias("is_target"), F.max(F.when(F.col("block_index") == 0, F.col("chars"))).alias("first")
    )
    about = pages.groupBy("sample").agg(F.count("*").alias("n"), F.max("first").alias("first"))
    budget = F.when(F.col("first") >= 40, F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / 3)))
    return pages.drop("first").join(about.select("sample", budget.alias("retained")), "sample")


_BASE = f"""{S.SQL_BLOCKS},
bl AS (SELECT doc_id, page_id, order_index AS ix, ln(1 + length(text))::DOUBLE AS s, len({S.sql_tokens('text')}) AS n, length(text) AS chars FROM blocks),
pg AS (SELECT doc_id, page_id AS ix, ln(1 + sum(chars))::DOUBLE AS s, max(s) AS f, sum(n) % 3 = 0 AS t, max(CASE WHEN ix = 0 THEN chars END) AS first FROM bl GROUP BY ALL),
rt AS (SELECT doc_id, CASE WHEN max(first) >= 40 THEN greatest(1, count(*) // 3) END AS retained FROM pg GROUP BY doc_id),
l AS (
  SELECT doc_id, any_value(retained) AS r, count(*) AS n, list({{'s': s, 'f': f, 'ix': ix, 't': t}} ORDER BY s DESC, ix) AS xs, list({{'s': s, 'f': f, 'ix': ix, 't': t}} ORDER BY f DESC, ix) AS fs
  FROM pg JOIN rt USING (doc_id) GROUP BY doc_id
),
z AS (SELECT doc_id, r, n, list_filter(xs, lambda x: x.t) AS pos, list_filter(xs, lambda x: NOT x.t) AS neg, list_filter(fs, lambda x: NOT x.t) AS fneg, xs FROM l),
y AS (SELECT *, coalesce(r > 0, false) AS budget, greatest(0, r - len(pos)) AS slots FROM z),
w AS (
  SELECT *, neg[1:CASE WHEN budget THEN least(len(neg), slots + 1) ELSE least(len(neg), {TOPK}) END] AS hard, fneg[1:CASE WHEN budget THEN least(len(neg), slots + 1) ELSE least(len(neg), {TOPK}) END] AS fhard,
    neg[greatest(0, r - least(len(pos), r)) + 1:greatest(0, r - least(len(pos), r)) + r] AS beyond, 0.5::DOUBLE * (xs[r].s + xs[r + 1].s) AS edge,
    len(pos) > 0 AND len(neg) > 0 AND (NOT budget OR len(neg) > slots) AS crowded
  FROM y
)
"""


def _hinge(pos: str, neg: str, p: str = "s", n: str = "s") -> str:
    return f"list_avg(flatten(list_transform({pos}, lambda up: list_transform({neg}, lambda down: greatest(0, {MARGIN}::DOUBLE - up.{p} + down.{n})))))"


def _entropy(items: str, target: str, edge: str) -> str:
    soft = f"(1 / (1 + exp(-(x.s - {edge}) / {TEMPERATURE}::DOUBLE)))"
    log = lambda v: f"greatest(-100, CASE WHEN {v} > 0 THEN ln({v}) ELSE -100 END)"
    return f"list_avg(list_transform({items}, lambda x: -({target} * {log(soft)} + (1 - {target}) * {log(f'(1 - {soft})')})))"


@register("page_readout_loss", f"""WITH {_BASE}
    SELECT doc_id, round({_hinge('pos', 'CASE WHEN budget THEN [hard[-1]] ELSE hard END')} + 0.25 * {_hinge('pos', 'hard', 'f', 'f')}, 6) + 0 AS loss, (len(pos) * CASE WHEN budget THEN 1 ELSE len(hard) END)::BIGINT AS pairs, (len(pos) * len(hard))::BIGINT AS focus_pairs FROM w WHERE crowded""")
def page_readout_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.readout_ranking(scored_pages(spark, sf_dir), MARGIN, TOPK)
    return out.select(F.col("sample").alias("doc_id"), (F.round("loss", 6) + 0.0).alias("loss"), "pairs", "focus_pairs")


@register("page_focus_loss", f"""WITH {_BASE}
    SELECT doc_id, round({_hinge('pos', 'CASE WHEN budget THEN [fhard[-1]] ELSE fhard END', 'f', 'f')}, 6) + 0 AS loss, (CASE WHEN budget THEN 1 ELSE len(fhard) END)::BIGINT AS pairs FROM w WHERE crowded AND len(pos) = 1""")
def page_focus_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.single_page_focus(scored_pages(spark, sf_dir), MARGIN, TOPK)
    return out.select(F.col("sample").alias("doc_id"), (F.round("loss", 6) + 0.0).alias("loss"), "pairs")


@register("page_coverage_loss", f"""WITH {_BASE}
    SELECT doc_id, round(greatest(0, {MARGIN}::DOUBLE - pos[-1].s + hard[-1].s), 6) + 0 AS loss, len(pos)::BIGINT AS positives FROM w WHERE crowded AND len(pos) >= 2""")
def page_coverage_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.multi_page_coverage(scored_pages(spark, sf_dir), MARGIN, TOPK)
    return out.select(F.col("sample").alias("doc_id"), (F.round("loss", 6) + 0.0).alias("loss"), "positives")


@register("page_retained_set_loss", f"""WITH {_BASE}
    SELECT doc_id, round({_entropy('pos', '(least(len(pos), r) / len(pos)::DOUBLE)', 'edge')} + {NEGATIVES} * coalesce({_entropy('beyond', '0', 'edge')}, 0), 6) AS loss, len(pos)::BIGINT AS positives
    FROM w WHERE len(pos) > 0 AND len(neg) > 0 AND r > 0 AND r < n""")
def page_retained_set_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.page_retained_set(scored_pages(spark, sf_dir), TEMPERATURE, NEGATIVES)
    return out.select(F.col("sample").alias("doc_id"), F.round("loss", 6).alias("loss"), "positives")


@register("page_recovery_loss", f"""WITH {_BASE}
    SELECT doc_id, round({_hinge('pos', 'beyond')}, 6) + 0 AS loss, len(beyond)::BIGINT AS pairs, list_position(xs, pos[1]) <= r AS in_top FROM w WHERE len(pos) = 1 AND len(neg) > 0 AND r > 0 AND r < n""")
def page_recovery_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.retained_recovery(scored_pages(spark, sf_dir), MARGIN)
    return out.select(F.col("sample").alias("doc_id"), (F.round("loss", 6) + 0.0).alias("loss"), "pairs", "in_top")


_BLOCKS = f"""{_BASE},
bp AS (SELECT bl.doc_id, bl.page_id, list({{'s': bl.s, 'ix': bl.ix, 't': bl.n % 4 = 0}} ORDER BY bl.s DESC, bl.ix) AS xs, any_value(pg.t) AS pt FROM bl JOIN pg ON pg.doc_id = bl.doc_id AND pg.ix = bl.page_id GROUP BY ALL),
bs AS (SELECT *, list_filter(xs, lambda x: x.t) AS pos, list_filter(xs, lambda x: NOT x.t) AS neg, 0.5::DOUBLE * (xs[{KEEP}].s + xs[{KEEP + 1}].s) AS edge FROM bp),
bf AS (
  SELECT *, greatest(0, {MARGIN}::DOUBLE - list_avg(list_transform(xs[1:{TOPK}], lambda x: x.s)) + list_avg(list_transform(CASE WHEN len(xs) > {TOPK} THEN xs[{TOPK + 1}:] ELSE xs END, lambda x: x.s))) AS gap,
    CASE WHEN len(neg) > greatest(0, {KEEP} - len(pos)) THEN {_hinge('pos', f'[neg[greatest(0, {KEEP} - len(pos)) + 1]]')} END AS budgeted, CASE WHEN len(neg) > 0 THEN {_hinge('pos', f'neg[1:{TOPK}]')} END AS ranked,
    (coalesce(list_sum(list_transform(pos, lambda x: greatest(1, len(neg)) / greatest(1, len(pos))::DOUBLE * (greatest(-x.s, 0) + ln(1 + exp(-abs(x.s)))))), 0) + coalesce(list_sum(list_transform(neg, lambda x: greatest(x.s, 0) + ln(1 + exp(-abs(x.s))))), 0)) / len(xs) AS bce
  FROM bs
)
"""


@register("block_focus_loss", f"""WITH {_BLOCKS}
    SELECT doc_id, page_id, CASE WHEN len(pos) = 0 THEN 'focus' ELSE kind END AS kind, round(CASE WHEN len(pos) = 0 THEN gap WHEN kind = 'bce' THEN bce WHEN kind = 'ranking' THEN ranked ELSE budgeted END, 6) + 0 AS loss
    FROM bf, (VALUES ('bce'), ('ranking'), ('budget_ranking')) k(kind) WHERE pt AND (len(pos) = 0 OR CASE WHEN kind = 'bce' THEN bce WHEN kind = 'ranking' THEN ranked ELSE budgeted END IS NOT NULL)""")
def block_focus_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three kinds of supervision, one after the other."""
    blocks, out = scored_blocks(spark, sf_dir), None
    for kind in ("bce", "ranking", "budget_ranking"):
        part = L.block_focus(blocks, kind, MARGIN, TOPK, KEEP)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("sample").alias("doc_id"), F.col("page_index").alias("page_id"), "kind", (F.round("loss", 6) + 0.0).alias("loss"))


@register("block_retained_set_loss", f"""WITH {_BLOCKS}
    SELECT doc_id, page_id, round({_entropy('pos', f'(least(len(pos), {KEEP}) / len(pos)::DOUBLE)', 'edge')} + {NEGATIVES} * coalesce({_entropy(f'neg[1:{KEEP}]', '0', 'edge')}, 0), 6) AS loss, len(pos)::BIGINT AS positives
    FROM bs WHERE len(pos) > 0 AND len(xs) > {KEEP}""")
def block_retained_set_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.block_retained_set(scored_blocks(spark, sf_dir), KEEP, TEMPERATURE, NEGATIVES)
    return out.select(F.col("sample").alias("doc_id"), F.col("page_index").alias("page_id"), F.round("loss", 6).alias("loss"), "positives")


@register("block_readout_loss", f"""WITH {_BLOCKS},
    nm AS (SELECT doc_id, count(*) AS n_pos FROM bf WHERE pt AND len(pos) > 0 GROUP BY doc_id),
    h0 AS (SELECT doc_id, neg, budget, greatest(0, r - coalesce(n_pos, 0)) AS fits FROM w LEFT JOIN nm USING (doc_id)),
    h1 AS (SELECT doc_id, neg[1:CASE WHEN budget THEN CASE WHEN len(neg) > fits THEN fits + 1 ELSE 0 END ELSE least(len(neg), {TOPK}) END] AS hard FROM h0),
    h2 AS (SELECT doc_id, unnest(hard) AS h, list_sum(list_transform(hard, lambda x: exp(x.s - hard[1].s))) AS mass, hard[1].s AS peak FROM h1 WHERE len(hard) > 0),
    h3 AS (SELECT h2.doc_id, list({{'w': exp(h.s - peak) / mass, 'best': xs[1:{KEEP}]}}) AS gs FROM h2 JOIN bf ON bf.doc_id = h2.doc_id AND bf.page_id = h.ix GROUP BY h2.doc_id),
    v AS (SELECT bf.*, list_sum(list_transform(gs, lambda g: g.w * {_hinge('pos', 'g.best')})) AS across FROM bf LEFT JOIN h3 USING (doc_id) WHERE pt)
    SELECT doc_id, page_id, CASE WHEN len(pos) > 0 AND coalesce(budgeted, across) IS NOT NULL THEN 'readout' ELSE 'focus' END AS kind,
      round(CASE WHEN len(pos) > 0 AND coalesce(budgeted, across) IS NOT NULL THEN coalesce(budgeted, 0) + coalesce(across, 0) ELSE gap END, 6) + 0 AS loss FROM v""")
def block_readout_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.block_readout(scored_blocks(spark, sf_dir), scored_pages(spark, sf_dir), MARGIN, TOPK, KEEP, budget=True)
    return out.select(F.col("sample").alias("doc_id"), F.col("page_index").alias("page_id"), "kind", (F.round("loss", 6) + 0.0).alias("loss"))
