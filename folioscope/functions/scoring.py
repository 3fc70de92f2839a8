"""Answer scores over a prediction column and an array of reference answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import normalize_answer, strip


def soft_accuracy(pred: Column, answers: Column) -> Column:
    """Share of answers equal to the prediction after normalisation; 0 for a blank prediction or no answer."""
    p = normalize_answer(F.coalesce(pred, F.lit("")))
    hits = F.size(F.filter(answers, lambda a: normalize_answer(a) == p))
    return F.when((p == "") | (F.size(answers) <= 0), 0.0).otherwise(F.least(F.lit(1.0), hits / F.size(answers).cast("double")))


def exact_match(pred: Column, answers: Column) -> Column:
    p = normalize_answer(pred)
    return F.coalesce(F.exists(answers, lambda a: normalize_answer(a) == p), F.lit(False)).cast("double")


def relaxed_numeric(pred: Column, answers: Column, rel: float = 0.01, absolute: float = 1e-4, compat: bool = True) -> Column:
    """Numeric match within a tolerance, else exact match.

    ``compat`` parses after punctuation has become spaces, so that signs and
    decimal points are lost; otherwise numbers are parsed as written.
    """
    form = (lambda c: normalize_answer(c)) if compat else strip
    p = form(pred).try_cast("double")

    def close(a: Column) -> Column:
        v = form(a).try_cast("double")
        return F.coalesce(F.abs(p - v) <= F.greatest(F.lit(absolute), F.lit(rel) * F.greatest(F.lit(1.0), F.abs(v))), F.lit(False))

    return F.when(p.isNull(), exact_match(pred, answers)).otherwise(F.exists(answers, close).cast("double"))


def anls(pred: Column, answers: Column, threshold: float = 0.5) -> Column:
    """Best 1 - distance / length over the answers, 0 from the threshold on.

    Texts are normalised once. Lengths that differ too much settle a pair;
    only the others are measured.
    """
    forms = F.transform(answers, normalize_answer)

    def best(p: Column) -> Column:
        def one(n: Column) -> Column:
            longest = F.greatest(F.length(p), F.length(n), F.lit(1))
            apart = F.abs(F.length(p) - F.length(n)) / longest.cast("double")
            far = F.levenshtein(p, n) / longest.cast("double")
            return F.when((n != "") & (apart < threshold), F.when(far < threshold, 1.0 - far).otherwise(0.0)).otherwise(0.0)

        return F.when(p == "", 0.0).otherwise(F.coalesce(F.array_max(F.transform(forms, one)), F.lit(0.0)))

    # An array of one, so that the prediction is a lambda's variable, and found once.
    return F.get(F.transform(F.array(normalize_answer(F.coalesce(pred, F.lit("")))), best), F.lit(0))


def choice_match(pred: Column, answers: Column) -> Column:
    gold, p = F.upper(normalize_answer(F.try_element_at(answers, F.lit(1)))), F.upper(normalize_answer(pred))
    return (F.array_contains(F.split(p, " "), gold) | (p == gold)).cast("double")


def contains_match(pred: Column, answers: Column) -> Column:
    """A one-word answer must be a word of the prediction, a longer one a part of it."""
    p = normalize_answer(pred)
    words = F.split(p, " ")

    def one(a: Column) -> Column:
        n = normalize_answer(a)
        return (n != "") & F.when(F.contains(n, F.lit(" ")), F.contains(p, n)).otherwise(F.array_contains(words, n))

    return F.exists(answers, one).cast("double")


#: Which metric scores which dataset; all others use soft accuracy.
METRICS = {"RealWorldQA": "choice_em", "OCRBench-v2": "ocr_contains_em", "ChartQA": "relaxed_numeric", "SLIDEVQA_MINI": "anls", "SLIDEVQA": "anls", "MMLongBench_DOC": "anls"}


def score_by_dataset(dataset: Column, pred: Column, answers: Column) -> Column:
    """struct(scorable, score, metric)."""
    scores = {"choice_em": choice_match, "ocr_contains_em": contains_match, "relaxed_numeric": relaxed_numeric, "anls": anls}
    metric, value = F.lit("vqa_soft"), soft_accuracy(pred, answers)
    for name, kind in METRICS.items():
        metric = F.when(dataset == name, kind).otherwise(metric)
        value = F.when(dataset == name, scores[kind](pred, answers)).otherwise(value)
    scorable = F.coalesce(F.size(answers) > 0, F.lit(False))
    return F.struct(scorable.alias("scorable"), F.when(scorable, value).alias("score"), F.when(scorable, metric).alias("metric"))


VERDICT_SCORE = {"correct": 1.0, "partial": 0.5, "incorrect": 0.0}


def parse_verdict(text: Column) -> Column:
    """struct(verdict, score, reason) from a grader's answer: JSON, JSON with repaired escapes, or the bare fields."""
    body = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    shape = "verdict string, reason string"
    fixed = F.regexp_replace(body, r'\\(?!["\\/bfnrtu])', r"\\\\\\\\")
    read = lambda c: F.from_json(c, shape, {"mode": "PERMISSIVE"})
    known = lambda v: F.when(F.lower(F.trim(v)).isin(*VERDICT_SCORE), F.lower(F.trim(v)))
    bare = F.nullif(F.lower(F.regexp_extract(text, r'(?i)"?verdict"?\s*[:=]\s*"?(correct|partial|incorrect)\b', 1)), F.lit(""))
    verdict = F.coalesce(known(read(body)["verdict"]), known(read(fixed)["verdict"]), bare)
    reason = F.coalesce(read(body)["reason"], read(fixed)["reason"], F.regexp_extract(text, r'(?s)"reason"\s*:\s*"(.*?)"', 1), F.lit(""))
    score = F.create_map(*[F.lit(x) for kv in VERDICT_SCORE.items() for x in kv])[verdict]
    return F.when(verdict.isNotNull(), F.struct(verdict.alias("verdict"), score.alias("score"), F.substring(reason, 1, 300).alias("reason")))


def snap(score: Column, levels: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> Column:
    """The nearest level, the lower one on ties."""
    options = F.array(*[F.struct(F.abs(score - v).alias("d"), F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(levels)])
    return F.array_min(options)["v"]


def grounded_mix(result: Column, gold: Column, claim: Column, citation: Column) -> Column:
    """struct(judge, grounded, strict): 0.4/0.4/0.2 of the judge's scores, then 0.8/0.2 with the citation score."""
    judge = 0.4 * result + 0.4 * gold + 0.2 * claim
    return F.struct(judge.alias("judge"), (0.2 * citation + 0.8 * judge).alias("grounded"), (F.least(result, gold, claim, citation) >= 1.0).alias("strict"))
