"""Token counts by heap-and-linked-list byte-pair merging.

A piece's symbols form a doubly linked list; a heap holds its adjacent pairs by
merge rank. The lowest pair is popped, checked against the list, and merged,
which offers at most two new pairs. The count is the initial symbols less the
merges made; identifiers are never emitted.

Vocabulary, merges, normalisation and splitting are those of the tokenizer file,
whose path is a parameter. White space always separates pieces, so a text is
counted run by run; counts of runs met before are kept in a two-generation table
of bounded size.

Defined cases: a null or empty text has 0 tokens; ids may repeat or be null; an
empty table gives no row; special strings in a text count as one token each, as
in the library; texts of any length are counted whole. One pass, no shuffle.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import lean, texts

#: Entries in one generation of the table of known runs.
KEPT = 400_000

_SEPARATORS = "\x1c\x1d\x1e\x1f"  # str.split() takes these for white space; the tokenizer doesn't


class Generations(dict):
    """A bounded memo: a full generation is demoted, and used again when asked for."""

    def __init__(self, make, kept: int = KEPT):
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def _byte_symbols() -> list[str]:
    """The printable stand-in for each byte in the public byte-level format."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        symbols = _byte_symbols()
        self.first = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.suffix] for s in symbols]
        #: (left id, right id) as one number -> rank and merged id as one number
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"[^\s", r"[^\p{White_Space}")).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, self.special))).split
        self.runs = regex.compile(r"[^\p{White_Space}]+").findall
        self.of_piece = Generations(self.merge)
        self.of_run = Generations(self.count_run)

    def merge(self, piece: str) -> int:
        """Symbols left after merging one piece."""
        data = piece.encode("utf-8")
        n = len(data)
        ids = [self.first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if n == 1:
            return 1
        ranks = self.ranks
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []
        for i in range(n - 1):
            r = ranks.get(ids[i] << 20 | ids[i + 1])
            if r is not None:
                heap.append((r >> 20) << 40 | i)
        heapq.heapify(heap)
        pop, push, merges = heapq.heappop, heapq.heappush, 0
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFFFF
            left = ids[i]
            j = nxt[i]
            if left < 0 or j < 0:
                continue
            r = ranks.get(left << 20 | ids[j])
            if r is None or r >> 20 != top >> 40:
                continue  # the pair has changed since it was offered
            ids[i], ids[j] = r & 0xFFFFF, -1
            merges += 1
            k = nxt[i] = nxt[j]
            if k >= 0:
                prv[k] = i
                r = ranks.get(ids[i] << 20 | ids[k])
                if r is not None:
                    push(heap, (r >> 20) << 40 | i)
            h = prv[i]
            if h >= 0:
                r = ranks.get(ids[h] << 20 | ids[i])
                if r is not None:
                    push(heap, (r >> 20) << 40 | h)
        return n - merges

    def count_plain(self, run: str) -> int:
        run = unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()
        return sum(map(self.of_piece.__getitem__, self.pieces(run)))

    def count_run(self, run: str) -> int:
        if "<|" not in run:
            return self.count_plain(run)
        parts = self.specials(run)
        return len(parts) - 1 + sum(self.count_plain(p) for p in parts if p)

    def count(self, text: str) -> int:
        runs = self.runs(text) if any(c in text for c in _SEPARATORS) else text.split()
        return sum(map(self.of_run.__getitem__, runs))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer).count
        for batch in batches:
            counts = [of(t) if t else 0 for t in map(pa.StringScalar.as_py, batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return rows.mapInArrow(lean(count), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
