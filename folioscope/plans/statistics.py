"""Paired-statistics queries over two binary arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import tokens
from folioscope.operators import losses, paired
from folioscope.plans import surrogates as S
from folioscope.plans.registry import register
from folioscope.session import table

_MCNEMAR = """count(*) AS n, round(avg(base::INT), 6) AS base_rate, round(avg(arm::INT), 6) AS arm_rate, count(*) FILTER (NOT base AND arm) AS b, count(*) FILTER (base AND NOT arm) AS c"""
_INTERVAL = """round((b - c) / n::DOUBLE, 6) AS delta, round((b - c) / n::DOUBLE - 1.96 * sqrt(greatest({var}, 0)) / n, 6) AS lo, round((b - c) / n::DOUBLE + 1.96 * sqrt(greatest({var}, 0)) / n, 6) AS hi,
    CASE WHEN b + c > 0 THEN round((abs(b - c) - 1) ** 2 / (b + c)::DOUBLE, 6) ELSE 0 END::DOUBLE AS chi2"""
_EXACT = _INTERVAL.format(var="(b + c) - (b - c) * (b - c) / n::DOUBLE")


def _shown(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, "n", *[F.round(c, 6).alias(c) for c in ("base_rate", "arm_rate")], "b", "c", *[F.round(c, 6).alias(c) for c in ("delta", "lo", "hi", "chi2")])


@register("mcnemar", f"WITH {S.SQL_ARMS}, m AS (SELECT {_MCNEMAR} FROM arms) SELECT *, {_EXACT} FROM m")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(paired.mcnemar(S.arms(spark, sf_dir), F.col("base"), F.col("arm")))


@register("mcnemar_null", f"WITH {S.SQL_ARMS}, m AS (SELECT lang, {_MCNEMAR} FROM arms GROUP BY lang) SELECT *, {_INTERVAL.format(var='(b + c)::DOUBLE')} FROM m")
def mcnemar_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(paired.mcnemar(S.arms(spark, sf_dir), F.col("base"), F.col("arm"), ["lang"], variance="null"), "lang")


@register("mcnemar_strata", f"WITH {S.SQL_ARMS}, m AS (SELECT source, {_MCNEMAR} FROM arms GROUP BY source) SELECT *, {_EXACT} FROM m")
def mcnemar_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(paired.mcnemar(S.arms(spark, sf_dir), F.col("base"), F.col("arm"), ["source"]), "source")


@register("mcnemar_p")
def mcnemar_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values with family-wise thresholds; erfc has no SQL twin."""
    rows = paired.with_p(paired.mcnemar(S.arms(spark, sf_dir), F.col("base"), F.col("arm"), ["lang"])).withColumn("family", F.lit("language"))
    return paired.bonferroni(rows, "family").select("lang", "b", "c", "p", "survives_family", "survives_pooled")


@register("paired_difference", f"""WITH {S.SQL_ARMS}, d AS (SELECT lang, arm::INT - base::INT AS d FROM arms)
    SELECT lang, count(*) AS n, round(avg(d), 6) AS mean_diff, round(stddev_samp(d), 6) AS sd, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses FROM d GROUP BY lang""")
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paired.paired_difference(S.arms(spark, sf_dir), F.col("base").cast("int"), F.col("arm").cast("int"), ["lang"])
    return out.select("lang", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("sd", 6).alias("sd"), "wins", "ties", "losses")


@register("two_sample", f"""WITH {S.SQL_ARMS}, d AS (SELECT lang, (arm::INT - base::INT)::DOUBLE AS d FROM arms),
    m AS (SELECT count(*) FILTER (lang = 'en') AS n_l, count(*) FILTER (lang <> 'en') AS n_r, avg(d) FILTER (lang = 'en') AS ml, avg(d) FILTER (lang <> 'en') AS mr, var_samp(d) FILTER (lang = 'en') AS vl, var_samp(d) FILTER (lang <> 'en') AS vr FROM d)
    SELECT n_l, n_r, round(ml - mr, 6) AS delta, round((ml - mr) / sqrt(vl / n_l + vr / n_r), 6) AS z FROM m""")
def two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paired.two_sample(S.arms(spark, sf_dir), F.col("arm").cast("int") - F.col("base").cast("int"), F.col("lang") == "en", F.col("lang") != "en")
    return out.select("n_l", "n_r", F.round("delta", 6).alias("delta"), F.round("z", 6).alias("z"))


@register("bootstrap_ci", f"""WITH {S.SQL_ARMS}, v AS (SELECT list((arm::INT - base::INT)::DOUBLE ORDER BY doc_id) AS v, count(*) AS n FROM arms),
    m AS (SELECT rep, list_sum(list_transform(range(n), lambda i: v[(((rep + 1) * 1103515245 + (i + 1) * 12345 + (rep + 7) * (i + 3) * (i + 3) * 7919) % 2147483647) % n + 1])) / n AS m FROM v, range(10000) t(rep)),
    o AS (SELECT list(m ORDER BY m) AS m FROM m)
    SELECT 10000::BIGINT AS replicates, round(m[251], 6) AS lo, round(m[9751], 6) AS hi FROM o""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.arms(spark, sf_dir).select("doc_id", (F.col("arm").cast("int") - F.col("base").cast("int")).alias("d"))
    return paired.bootstrap_mean(rows, "d", ["doc_id"]).select("replicates", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@register("difference_in_differences", """WITH e AS (SELECT user_id, event_id % 2 AS level, avg(value) AS v FROM events GROUP BY ALL), d AS (SELECT h.v - l.v AS d FROM e h JOIN e l ON h.user_id = l.user_id AND h.level = 1 AND l.level = 0)
    SELECT count(*) AS n, round(avg(d), 4) AS interaction, round(sqrt(var_samp(d) / count(*)), 4) AS se FROM d""")
def did(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").groupBy("user_id", F.pmod("event_id", F.lit(2)).alias("level")).agg(F.avg("value").alias("v"))
    out = paired.difference_in_differences(cells, "user_id", "level", F.col("v"), 1, 0)
    return out.select("n", F.round("interaction", 4).alias("interaction"), F.round("se", 4).alias("se"))


@register("abstention_balance", """WITH r AS (SELECT doc_id, quality = 0 AS u, n_chars < 1000 AS a FROM labels JOIN documents USING (doc_id))
    SELECT round(avg(a::INT) FILTER (u), 6) AS hit_rate, round(avg(a::INT) FILTER (NOT u), 6) AS false_alarm, round((avg(a::INT) FILTER (u) + 1 - avg(a::INT) FILTER (NOT u)) / 2, 6) AS balanced_accuracy FROM r""")
def abstention_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    out = paired.abstention(rows, F.col("quality") == 0, F.col("n_chars") < 1000)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@register("strata_crosstab", f"""WITH {S.SQL_ARMS} SELECT lang, source, count(*) AS n, round(avg(base::INT), 6) AS base_rate, round(avg(arm::INT), 6) AS arm_rate FROM arms GROUP BY ROLLUP (lang, source)""")
def strata_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.arms(spark, sf_dir).rollup("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg(F.col("base").cast("int")), 6).alias("base_rate"), F.round(F.avg(F.col("arm").cast("int")), 6).alias("arm_rate"))


@register("tag_strata", f"""WITH {S.SQL_ARMS}, t AS (SELECT unnest([lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END]) AS tag, base, arm FROM arms) SELECT tag, {_MCNEMAR} FROM t GROUP BY tag""")
def tag_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping strata: a row counts in each of its tags."""
    rows = S.arms(spark, sf_dir).withColumn("tag", F.explode(F.array("lang", "source", F.when(F.col("n_chars") > 2000, "long").otherwise("short"))))
    return paired.mcnemar(rows, F.col("base"), F.col("arm"), ["tag"]).select("tag", "n", F.round("base_rate", 6).alias("base_rate"), F.round("arm_rate", 6).alias("arm_rate"), "b", "c")


@register("common_samples", """SELECT q.doc_id, quality AS a, toxic AS b, n_chars AS c FROM labels q JOIN documents d USING (doc_id)""")
def common_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    as_v = lambda df, c: df.select("doc_id", F.col(c).cast("long").alias("v"))
    out = paired.common_samples({"a": as_v(labels, "quality"), "b": as_v(labels, "toxic"), "c": as_v(docs, "n_chars")}, "doc_id", "v")
    return out.select("doc_id", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "c")


@register("grader_agreement", """WITH p AS (SELECT lang, quality, 1 - toxic AS other FROM labels JOIN documents USING (doc_id))
    SELECT lang, count(*) AS n, round(avg((quality = other)::INT), 6) AS agreement, count(*) FILTER (quality > other) AS first_only, count(*) FILTER (quality < other) AS second_only FROM p GROUP BY ROLLUP (lang)""")
def grader_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumn("other", 1 - F.col("toxic"))
    return rows.rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == F.col("other")).cast("int")), 6).alias("agreement"), F.count_if(F.col("quality") > F.col("other")).alias("first_only"), F.count_if(F.col("quality") < F.col("other")).alias("second_only"))


_LINES = f"{S.SQL_BLOCKS}, r AS (SELECT doc_id, order_index AS block, len({S.sql_tokens('text')}) % 4 = 0 AS pos, ln(1 + length(text))::DOUBLE AS s FROM blocks)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines as candidates: longer ones score higher, those with a number of words divisible by four are positive."""
    return S.blocks(spark, sf_dir).select("doc_id", F.col("order_index").alias("block"), (F.size(tokens(F.col("text"))) % 4 == 0).alias("pos"), F.log1p(F.length("text").cast("double")).alias("s"))


@register("softmax_loss", f"""WITH {_LINES}, m AS (SELECT doc_id, max(s) AS peak FROM r GROUP BY doc_id),
    z AS (SELECT doc_id, sum(CASE WHEN pos THEN exp(s - peak) ELSE 0 END) AS p, sum(exp(s - peak)) AS z FROM r JOIN m USING (doc_id) GROUP BY doc_id) SELECT doc_id, round(ln(z / p), 6) + 0 AS loss FROM z WHERE p > 0""")
def softmax_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.softmax_nll(_lines(spark, sf_dir), "doc_id", F.col("pos"), F.col("s")).select("doc_id", (F.round("loss", 6) + 0.0).alias("loss"))


@register("hinge_loss", f"""WITH {_LINES}, n AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, block) AS k FROM r WHERE NOT pos) WHERE k <= 3)
    SELECT r.doc_id, round(avg(greatest(0, 0.2::DOUBLE - r.s + n.s)), 6) AS loss FROM r JOIN n ON r.doc_id = n.doc_id AND r.pos GROUP BY r.doc_id""")
def hinge_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = losses.hinge_top_negatives(_lines(spark, sf_dir), "doc_id", F.col("pos"), F.col("s"), ["block"], 3, 0.2)
    return out.select("doc_id", F.round("loss", 6).alias("loss"))
