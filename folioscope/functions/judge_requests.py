"""Requests to a judge in the two dialects of its service, and the text of the answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dialects' paths, and the efforts a reasoning judge knows.
PATHS = {"responses": "/responses", "chat": "/chat/completions"}
EFFORTS = ("none", "minimal", "low", "medium", "high", "xhigh", "max")
MOST_TOKENS = 8000
_RESPONSES = "output array<struct<content: array<struct<type: string, text: string>>>>"
_CHAT = "choices array<struct<message: struct<content: string>>>"


def _known(style: str) -> str:
    if style not in PATHS:
        raise ValueError(f"unknown dialect {style!r}")
    return style


def endpoint(base: str, style: str) -> str:
    return base.rstrip("/") + PATHS[_known(style)]


def body(style: str, model: str, instructions: str, user: Column, effort: str = "", most_tokens: int = MOST_TOKENS) -> Column:
    """The request as JSON. Effort goes, nested, to models named gpt-... in the ``responses`` dialect alone."""
    if effort and effort not in EFFORTS:
        raise ValueError(f"unknown effort {effort!r}")
    rules = F.lit(instructions)
    if _known(style) == "responses":
        fields = [F.lit(model).alias("model"), rules.alias("instructions"), user.alias("input"), F.lit(most_tokens).alias("max_output_tokens")]
        if effort and model.lower().startswith("gpt-"):
            fields.append(F.struct(F.lit(effort).alias("effort")).alias("reasoning"))
    else:
        turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
        fields = [F.lit(model).alias("model"), F.lit(most_tokens).alias("max_tokens"), F.array(turn("system", rules), turn("user", user)).alias("messages")]
    return F.to_json(F.struct(*fields))


def answer_text(style: str, response: Column) -> Column:
    """The text of a JSON answer: all output texts joined, or the first choice's message; empty where there is none."""
    if _known(style) == "responses":
        parts = F.flatten(F.transform(F.from_json(response, _RESPONSES)["output"], lambda o: F.coalesce(o.content, F.array().cast("array<struct<type:string,text:string>>"))))
        texts = F.transform(F.filter(parts, lambda c: c.type == "output_text"), lambda c: F.coalesce(c.text, F.lit("")))
        return F.coalesce(F.array_join(texts, ""), F.lit(""))
    return F.coalesce(F.get(F.from_json(response, _CHAT)["choices"], 0)["message"]["content"], F.lit(""))
