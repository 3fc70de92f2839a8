"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document. The ledger keeps the measurements and
one integer whose bit k says that rule k failed. A policy is a named, versioned
set of rules; applying one is ``fail_bits & mask = 0``, and ablations (what a
policy would keep without one of its rules) come from the bits alone, without
reading a text again.

Words are maximal runs of bytes other than space and 0x09-0x0D. Repeats within
a document are found by 64-bit fingerprints of exact byte ranges (see ``kernel``).

Defined cases: a null or empty text has no word and fails ``few_words``; ids may
repeat or be null (rows are judged one by one); an empty table gives an empty
ledger; other columns are not read. The work is one pass without a shuffle, in
chunks of bounded size, so no hot key gathers anywhere; a text longer than a chunk
is one of its own and takes about 20 bytes of memory a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import kernel as K
from folioscope.llm.common import lean, texts

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_ascii_letters", "n_marked_words")

SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

#: Rule name -> failure condition over the measurements, in whole numbers. The
#: position in this mapping is the rule's bit; rules are only ever appended.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "100 * n_symbols > 20 * n_words",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "odd_word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
    "shouting": "n_ascii_letters >= 50 AND 100 * n_upper > 60 * n_ascii_letters",
    "marked_words": "100 * n_marked_words > 50 * n_words",
}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
_SIX = ("few_words", "repeated_words", "symbol_heavy", "repeated_lines", "odd_word_length", "shouting")
#: Version 2 keeps texts whose words end in marks: many of them are clean.
PRODUCTION = Policy("production", 2, _SIX)
#: Versions are only ever added, so that a ledger's old verdicts can be had again.
POLICIES = (
    BASE, Policy("production", 1, (*_SIX, "marked_words")), PRODUCTION,
    Policy("no_markup", 1, ("few_words", "repeated_words", "symbol_heavy", "marked_words")), Policy("no_markup", 2, ("few_words", "repeated_words", "symbol_heavy")),
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Marks at word ends.
_MARK = _SYMBOL.copy()
_MARK[ord("!")] = True
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_ALPHA = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122))


def _duplicates(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal elsewhere in its text, is not the first of its equals)."""
    order = np.argsort(keys ^ K.mix(doc.astype(K.U) + K.U(1)), kind="stable")
    k, d = keys[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    later = np.zeros(len(keys), bool)
    later[order[1:]] = same
    several = later.copy()
    several[order[:-1][same]] = True
    return several, later


def measure_chunk(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    inside = ~K.SPACE[buf]
    start, end, doc = K.runs(inside, offsets)
    prints = K.Fingerprints(buf)
    words = prints.of(start, end)
    count = lambda d: np.bincount(d, minlength=n).astype(np.int64)
    out = {
        "n_words": count(doc),
        "word_chars": K.per_text(inside & ((buf & 0xC0) != 0x80), offsets),
        "n_symbols": K.per_text(_SYMBOL[buf], offsets),
        "n_upper": K.per_text(_UPPER[buf], offsets),
        "n_ascii_letters": K.per_text(_ALPHA[buf], offsets),
    }
    out["n_marked_words"] = count(doc[_MARK[buf[end - 1]]])
    tri, whole = K.shingles(words, doc, 3)
    at = np.flatnonzero(whole)
    again, _ = _duplicates(tri[at], doc[at])
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[at[again] + k] = True
    out["n_repeat_words"] = count(doc[covered])
    ls, le, ld = K.runs(buf != 10, offsets)
    worded = np.searchsorted(start, le) > np.searchsorted(start, ls)
    ls, le, ld = ls[worded], le[worded], ld[worded]
    _, later = _duplicates(prints.of(ls, le), ld)
    out["n_lines"] = count(ld)
    out["n_dup_lines"] = count(ld[later])
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, offsets in K.string_chunks(batch, "text"):
            got = measure_chunk(buf, offsets)
            ids = K.batched(batch, rows).column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(got[m]) for m in MEASURES]], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and fail_bits with every rule's outcome."""
    measured = texts(docs).mapInArrow(lean(_measure), SCHEMA)
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k}L ELSE 0L END" for k, rule in enumerate(RULES.values()))
    return measured.withColumn("fail_bits", F.expr(bits))


def passes(policy: Policy, bits: str | Column = "fail_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policies(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """One boolean column ``<name>_v<version>`` for each policy."""
    return book.select("*", *[passes(p).alias(f"{p.name}_v{p.version}") for p in policies])


def ablations(book: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents it fails, and those that only it fails.

    One pass over the bits with partial aggregation: a document's failures are
    counted per rule, and ``any_bits``/``all_bits`` are the bitwise or/and.
    """
    mask = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    aggs = [F.count("*").alias("n"), F.count_if(mask == 0).alias("kept"), F.bit_or(mask).alias("any_bits"), F.bit_and(mask).alias("all_bits")]
    for r in policy.rules:
        bit = 1 << list(RULES).index(r)
        aggs += [F.count_if(mask.bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"fail_{r}"), F.count_if(mask == bit).alias(f"only_{r}")]
    one = book.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"fail_{r}").alias("n_failed"), F.col(f"only_{r}").alias("n_only"), (F.col("kept") + F.col(f"only_{r}")).alias("kept_without")) for r in policy.rules])
    return one.select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "n", "kept", "any_bits", "all_bits", F.explode(rows).alias("r")).select("policy", "version", "n", "kept", "any_bits", "all_bits", "r.*")


def filter_documents(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The documents that pass, with all their columns.

    The text travels through the same pass as its measurements, so nothing is
    joined back by id and repeated or null ids are safe.
    """
    from folioscope.llm.common import prepare

    prepare(docs.sparkSession)
    numbered = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in K.string_chunks(batch, "text"):
                got = measure_chunk(buf, offsets)
                yield pa.RecordBatch.from_arrays([K.batched(batch, rows).column("row"), *[pa.array(got[m]) for m in MEASURES]], ["row", *MEASURES])

    from pyspark.sql.types import LongType, StructType

    schema = StructType().add("row", numbered.schema["row"].dataType)
    for m in MEASURES:
        schema.add(m, LongType())
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k}L ELSE 0L END" for k, rule in enumerate(RULES.values()))
    return numbered.mapInArrow(lean(judged), schema).where(passes(policy, F.expr(bits))).select("row.*")
