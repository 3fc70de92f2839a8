"""Token ids of whole texts, as little-endian unsigned 32-bit numbers.

The ids are the tokenizers library's. White space always separates pieces in
this vocabulary, so each distinct run between white space is encoded once and
kept in a bounded table; a text's ids are its runs' ids joined. A letters-only
run is one piece, and so is a tail of marks behind it: they are encoded apart, and
many unknown ones go through the library in one call, cut again at the tokens that
end a word. Special strings are matched before letters are made lower case, so a
text that holds one in any letter case is encoded as it stands.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folioscope.llm import kernel as K

#: Runs that a worker's table holds, at some 40 bytes each.
KEPT = 1_000_000
#: Runs that one call of the library encodes: its results are far larger than the ids.
CALL = 1000
#: Bytes of text encoded at once; a longer text is cut at white space.
STRETCH = 2 << 20
#: Marks that make one piece when they follow a word.
_TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
#: Arrow takes these for white space; the tokenizer doesn't.
_SEPARATORS = "[\x1c-\x1f]"


class Table:
    """Ids of known runs in flat arrays, found by two fingerprints of a run's bytes."""

    def __init__(self, kept: int):
        self.kept = kept
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = np.zeros(0, K.U), np.zeros(0, K.U)
        self.start, self.size, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
        self.pool, self.filled = np.zeros(1 << 16, "<u4"), 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The row of each run, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        rows = np.where((self.keys[at] == keys) & (self.checks[at] == checks), at, -1)
        self.used[rows[rows >= 0]] = True
        return rows

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Keep the ids of new runs; where they are in the pool."""
        data = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        start = self.filled + np.cumsum(size, dtype=np.int32) - size
        if self.filled + len(data) > len(self.pool):
            self.pool = np.append(self.pool[: self.filled], np.zeros(max(self.filled, 2 * len(data)), "<u4"))
        self.pool[self.filled: self.filled + len(data)] = data
        self.filled += len(data)
        order = np.argsort(keys, kind="stable")
        place = np.searchsorted(self.keys, keys[order])
        new = {"keys": keys, "checks": checks, "start": start, "size": size, "used": np.ones(len(keys), bool)}
        for name, values in new.items():
            setattr(self, name, np.insert(getattr(self, name), place, values[order]))
        return start, size

    def age(self) -> None:
        """A full table keeps the runs asked for since it was last full, if they are few enough."""
        if len(self.keys) <= self.kept:
            return
        stay = np.flatnonzero(self.used)
        if 2 * len(stay) > self.kept:
            self.clear()
            return
        size = self.size[stay]
        upto = np.cumsum(size, dtype=np.int32)
        gathered = self.pool[np.repeat(self.start[stay] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        self.keys, self.checks, self.start, self.size = self.keys[stay], self.checks[stay], upto - size, size
        self.pool, self.filled, self.used = gathered, len(gathered), np.zeros(len(stay), bool)


def _letters(run: str) -> bool:
    """Whether a run is letters alone once it is in normal form C and lower case."""
    return unicodedata.normalize("NFC", run).lower().isalpha()


class Encoder:
    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known = Table(kept)
        self.special = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        if not all(x.startswith("<|") for x in self.special):
            raise ValueError("special strings of another form")
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, number in vocab.items():
            self.ends[number] = token.endswith("</w>")

    def _library(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), CALL):
            out += [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts[i: i + CALL], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of runs of letters, many to a call."""
        out: list[bytes] = []
        for i in range(0, len(words), CALL):
            some = words[i: i + CALL]
            ids = np.asarray(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some):
                data, ends = ids.tobytes(), (cut * 4).tolist()
                out += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            else:
                out += self._library(some)
        return out

    def encode_runs(self, runs: list[str]) -> list[bytes]:
        """The ids of distinct runs without white space."""
        words, tailed, odd = [], [], []
        for k, r in enumerate(runs):
            if r.isalpha() and (r.isascii() or _letters(r)):
                words.append(k)
                continue
            core = r.rstrip(_TAIL)
            if core.isalpha() and (core.isascii() or _letters(core)):
                tailed.append((k, core, r[len(core):]))
            else:
                odd.append(k)
        out: list[bytes] = [b""] * len(runs)
        # A word and the marks behind it are two pieces.
        cores, tails = list({c for _, c, _ in tailed}), list({t for *_, t in tailed})
        found = self._words([*[runs[k] for k in words], *cores])
        for k, ids in zip(words, found, strict=False):
            out[k] = ids
        core_ids, tail_ids = dict(zip(cores, found[len(words):], strict=True)), dict(zip(tails, self._library(tails), strict=True))
        for k, core, tail in tailed:
            out[k] = core_ids[core] + tail_ids[tail]
        for k, ids in zip(odd, self._library([runs[k] for k in odd]), strict=True):
            out[k] = ids
        return out

    def lookup(self, runs: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct runs start in the table's pool, and how many they are."""
        offsets = np.frombuffer(runs.buffers()[1], np.int32, len(runs) + 1, runs.offset * 4).astype(np.int64)
        prints = K.Fingerprints(np.frombuffer(runs.buffers()[2] or b"", np.uint8))
        keys, checks = (prints.of(offsets[:-1], offsets[1:], seed) for seed in (0, 1))
        rows = self.known.find(keys, checks)
        new = np.flatnonzero(rows < 0)
        start, size = (c[rows] if len(c) else np.zeros(len(rows), np.int32) for c in (self.known.start, self.known.size))
        if len(new):
            start[new], size[new] = self.known.add(keys[new], checks[new], self.encode_runs(runs.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist()))
        return start, size

    def encode_column(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a column of texts, each followed by the end id.

        Splitting and finding the distinct runs is Arrow's; the table is asked for
        each distinct run once, and the ids are gathered by position.
        """
        if column.null_count:
            column = column.fill_null("")
        if not len(column):
            return np.zeros(1, np.int64), np.zeros(0, "<u4")
        apart = pc.match_substring_regex(column, _SEPARATORS)
        if apart.true_count:
            offsets, ids = self.encode_column(pc.if_else(apart, "", column), end_id)
            parts = np.split(ids, offsets[1:-1])
            for k in np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist():
                parts[k] = np.append(np.frombuffer(self._library([column[k].as_py()])[0], "<u4"), np.asarray([end_id], "<u4"))
            return np.cumsum([0, *map(len, parts)]), np.concatenate(parts)
        data = pa.concat_arrays([column]).buffers()[2]  # this stretch's bytes alone
        bytes_ = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        if not (bytes_ >= 0xC4).any():
            # Latin-1 is in normal form C, and its lower case is found letter by letter;
            # a full stop or comma between a letter and white space is a piece of its own.
            low = pc.utf8_lower(column)
            found = [pc.match_substring(low, x) for x in self.special] if pc.any(pc.match_substring(low, "<|")).as_py() else []
            low = pc.replace_substring_regex(low, "([a-zß-öø-ÿ])([.,])(\\s)", "\\1 \\2\\3")
            for hit in found:
                low = pc.if_else(hit, column, low) if hit.true_count else low
            column = low
        words = pc.utf8_split_whitespace(column)
        texts = words.offsets.to_numpy().astype(np.int64)
        texts -= texts[0]
        coded = words.flatten().dictionary_encode()
        start, size = self.lookup(coded.dictionary)
        start, size = np.append(start, np.int32(self.known.filled)), np.append(size, np.int32(1))
        pool = np.append(self.known.pool[: self.known.filled], np.asarray([end_id], "<u4"))
        self.known.age()
        which = np.insert(coded.indices.to_numpy(), texts[1:], len(start) - 1)
        n = size[which]
        upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        place = np.arange(upto[-1], dtype=np.int32)
        place += np.repeat(start[which] - upto[:-1].astype(np.int32), n)
        return upto[texts + np.arange(len(texts))], pool[place]

    def encode_long(self, text: str, end_id: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`encode_column` of one long text, cut at blanks, which no piece spans."""
        parts, at = [], 0
        while at < len(text):
            to = len(text)
            if at + limit < to:
                blank = text.rfind(" ", at + 1, at + limit)
                blank = blank if blank > 0 else text.find(" ", at + limit)
                to = blank if blank > 0 else to
            parts.append(self.encode_column(pa.array([text[at:to]]), end_id)[1][:-1])
            at = to
        ids = np.append(np.concatenate(parts), np.asarray([end_id], "<u4"))
        return np.asarray([0, len(ids)]), ids

    def encode_batches(self, column: pa.Array, end_id: int, limit: int = STRETCH):
        """(first row, offsets, ids) of consecutive stretches of a column, bounded in bytes."""
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + limit, "right")) - 1)
            if to == at + 1 and sizes[at] > limit:
                yield at, *self.encode_long(column[at].as_py(), end_id, limit)
            else:
                yield at, *self.encode_column(column[at:to], end_id)
            at = to


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
