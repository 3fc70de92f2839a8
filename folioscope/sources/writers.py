"""Sinks: JSON lines, stores by document, id lists, summaries, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str, append: bool = False, by: list[str] | None = None) -> None:
    """One object per line, split into folders by ``by``; the committer publishes whole files only."""
    writer = rows.write.mode("append" if append else "errorifexists").option("ignoreNullFields", False)
    (writer.partitionBy(*by) if by else writer).json(path)


def document_store(pages: DataFrame, path: str) -> None:
    """Pages as one JSON object per document."""
    held = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in pages.columns if c != "document_id"]))).alias("pages"))
    held.write.json(path)


def id_list(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.text(path)


def summary(rows: DataFrame, path: str) -> None:
    """A one-row aggregate as JSON beside its data."""
    rows.coalesce(1).write.json(path)


def markdown(rows: DataFrame, columns: list[str], digits: int = 3, most: int = 1000) -> str:
    """A report table of a small aggregate; more than ``most`` rows is an error, not a cut."""
    found = rows.select(*columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report holds at most {most} rows")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [columns, ["---"] * len(columns), *[[show(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def signed(value: float, digits: int = 3) -> str:
    return f"{value:+.{digits}f}"


def p_value(p: float) -> str:
    return "<1e-4" if p < 1e-4 else f"{p:.3g}"


def store_by_document(pages: DataFrame, path: str, donors: DataFrame | None = None) -> None:
    """A folder of JSON per document, and beside it the map of a deranged store (document_id, donor)."""
    pages.write.partitionBy("document_id").json(f"{path}/documents")
    if donors is not None:
        donors.coalesce(1).write.json(f"{path}/_derangement")


def report(title: str, sections: list[tuple[str, DataFrame, list[str]]], digits: int = 3) -> str:
    """A markdown report: a table for each (heading, small aggregate, columns)."""
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n{markdown(rows, columns, digits)}" for name, rows, columns in sections]]) + "\n"
