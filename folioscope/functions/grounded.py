"""Instructions, prefills and messages of answers that cite their evidence.

All wordings are fixed values: results are compared with runs that used them.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope.functions.text import strip

# What the system part says in each phase.
GROUNDED_SYSTEM = (
    "你必须输出一个严格合法的 JSON 对象，不要输出 Markdown，不要输出解释，不要输出额外前后缀。"
    " `claims` 是数组，每项至少包含 `claim_id` 和 `text`。"
    " `evidence` 是数组，每项至少包含 `evidence_id` 和 `supports`。"
    " `supports` 是被该证据支持的 claim_id 列表。"
)
PLAN_SYSTEM = " 当前阶段是 evidence-plan，只学习 claim 与 evidence_id 对齐，不输出最终答案。"
FINAL_SYSTEM = (
    " 当前阶段允许输出最终答案。"
    " 若无法稳定给出 `page_id/block_id/quote`，优先保证 `evidence_id` 与 `supports` 正确；"
    " 评测侧会按 `evidence_id` 做确定性 citation 映射。"
    " 输出必须简洁，禁止重复同一条 claim 或 evidence。"
    " `result` 必须优先写成直接回答问题的最短答案。"
    " 若答案是编号、日期、标题、专有名词、数值、百分比、面积、单位短语或其它短字符串，"
    " 必须尽量从证据中原样复制，保留大小写、连字符、空格和标点，不要自行改写。"
)
# What follows the question in each phase.
PLAN_USER = """请严格输出如下 JSON 结构：
{
  "claims": [{"claim_id": "c1", "text": "..."}],
  "evidence": [{"evidence_id": "e1", "supports": ["c1"]}]
}
要求：
1. 只输出 claim 与 evidence_id 对齐，不输出最终答案；
2. `evidence_id` 必须来自候选证据集合；
3. 如果无法确定，就返回空数组，但 JSON 结构仍必须完整。
"""
FINAL_USER = """请严格输出如下 JSON 结构：
{
  "result": "... 或结构化对象 ...",
  "claims": [{"claim_id": "c1", "text": "..."}],
  "evidence": [
    {"evidence_id": "e1", "supports": ["c1"]}
  ]
}
要求：
1. `evidence` 至少给出 `evidence_id` 与 `supports`；
2. 如果已经能回答问题，就不要把 `claims` 和 `evidence` 都输出为空数组；
3. 若你能稳定给出 citation，也可额外补充 `page_id/block_id/quote`；
4. `result` 优先输出直接回答问题的最短答案；若是短字符串，尽量原样复制证据中的 span；
5. 如果无法确定，就返回空数组，但 JSON 结构仍必须完整。
"""
PREFILLS = {"plan": '{"claims":', "final": '{"result":', "pref": '{"result":'}
PHASES = {"": "final", "grounded_json": "final", "default": "final", "plan": "plan", "final": "final", "pref": "pref"}
# The extractor of a second answer from verified evidence.
REFINE_SYSTEM = (
    "你是一个严格的基于证据的答案抽取器。"
    " 只能依据给定证据回答，不要补充常识，不要解释。"
    " 如果问题询问编号、数值、日期、标题、专有名词、缩写、项目号、ISSN、百分比、面积或短语，"
    " 必须尽量从证据中原样复制最短答案，保留大小写、连字符、空格和标点。"
    " 如果证据不足，就输出最短可证实短语。"
    " 只输出最终答案，不要输出 JSON，不要输出引号。"
)
REFINE_QUESTION, REFINE_EVIDENCE, REFINE_ASK, REFINE_LABEL = "问题：", "证据：", "请只输出最终答案。", "[证据{n}] "
REFINE_SNIPPETS = 3
# The judge's rules, and the fields of what it is shown, in order.
JUDGE_HEAD = "你是一个严格的 long-document grounded benchmark judge。\n下面是固定评分规则与输出要求，你必须始终遵守：\n"
JUDGE_RULES = {
    "role": "strict long-document grounded benchmark judge",
    "instructions": [
        "只能基于给定的 gold result、gold facts、以及已经通过硬校验整理后的证据包打分。",
        "不要使用外部常识，不要脑补文档中未提供的信息。",
        "所有分数只能取 0、0.25、0.5、0.75、1.0 五档。",
        "必须输出严格 JSON，对每个 gold fact 和每个 pred claim 分别打分。",
    ],
    "required_output_schema": {
        "result_score": 0.0,
        "gold_fact_scores": [{"fact_id": "f1", "score": 0.0, "reason": "..."}],
        "claim_scores": [{"claim_id": "c1", "score": 0.0, "reason": "..."}],
        "summary": "...",
    },
    "scoring_rules": {
        "result_score": "最终结果与 gold result 的语义一致程度；允许部分正确。",
        "gold_fact_scores": "每条 gold fact 被 verified evidence 支撑的程度。",
        "claim_scores": "每条 pred claim 被 verified evidence 支撑的程度。",
    },
}
JUDGE_USER = "下面是当前样本的评分输入数据（JSON）：\n"
JUDGE_FIELDS = (
    "query", "context", "gold_result", "gold_result_text", "gold_atomic_facts", "pred_result", "pred_result_text", "raw_prediction_text", "pred_claims", "verified_evidence", "invalid_evidence_summary",
)


def phase(name: str | None) -> str:
    """The training phase that a name stands for."""
    known = PHASES.get((name or "final").strip().lower())
    if known is None:
        raise ValueError(f"unknown phase {name!r}")
    return known


def wants_grounding(source_kind: Column, output_mode: Column) -> Column:
    """Whether a sample is asked for cited evidence: by its output mode, unless it only measures throughput."""
    form = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    return (form(output_mode) == "grounded_json") & (form(source_kind) != "throughput")


def grounded_prompt(system: Column, user: Column, training_phase: str | None = None) -> tuple[Column, Column]:
    """System and user text with the instructions of a phase."""
    plan = phase(training_phase) == "plan"
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    return (
        F.concat(text(system), F.lit("\n\n" + GROUNDED_SYSTEM + (PLAN_SYSTEM if plan else FINAL_SYSTEM))),
        F.concat(text(user), F.lit("\n\n" + (PLAN_USER if plan else FINAL_USER))),
    )


def prefill(training_phase: str | None = None) -> str:
    return PREFILLS[phase(training_phase)]


def refine_snippets(evidence: Column) -> Column:
    """Of array<struct<matched_snippet_raw, matched_snippet, quote>> the first text that is there, for each; blank ones go."""
    filled = lambda c: F.nullif(c, F.lit(""))
    found = F.transform(evidence, lambda e: strip(F.coalesce(filled(e.matched_snippet_raw), filled(e.matched_snippet), filled(e.quote), F.lit(""))))
    return F.filter(found, lambda s: s != "")


def refine_prompt(question: Column, snippets: Column, citation_score: Column, mode: Column) -> tuple[Column, Column]:
    """System and user text of the second question over the first verified snippets.

    Null where no citation holds, the mode is another, or there is no snippet.
    """
    some = F.slice(snippets, 1, REFINE_SNIPPETS)
    head, tail = REFINE_LABEL.split("{n}")
    lines = F.array_join(F.transform(some, lambda s, i: F.concat(F.lit(head), (i + 1).cast("string"), F.lit(tail), s)), "\n")
    asked = F.coalesce((citation_score > 0) & (F.size(some) > 0) & (mode == "quote_extract"), F.lit(False))
    user = F.concat(F.lit(REFINE_QUESTION), strip(F.coalesce(question, F.lit(""))), F.lit(f"\n\n{REFINE_EVIDENCE}\n"), lines, F.lit(f"\n\n{REFINE_ASK}"))
    return F.when(asked, F.lit(REFINE_SYSTEM)), F.when(asked, user)


@F.pandas_udf(StringType())
def indented(payload: pd.Series) -> pd.Series:
    """JSON with two blanks a level and all letters as they are."""
    return payload.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=2))


def judge_messages(fields: dict[str, Column]) -> tuple[Column, Column]:
    """The judge's system text, alike for all rows, and the row's user text; ``fields`` by JUDGE_FIELDS, null where absent."""
    unknown = set(fields) - set(JUDGE_FIELDS)
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    system = F.lit(JUDGE_HEAD + json.dumps(JUDGE_RULES, ensure_ascii=False, indent=2))
    shown = F.struct(*[fields.get(f, F.lit(None).cast("string")).alias(f) for f in JUDGE_FIELDS])
    return system, F.concat(F.lit(JUDGE_USER), indented(F.to_json(shown, {"ignoreNullFields": "false"})))
