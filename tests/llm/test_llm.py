"""Each operator against a plain version, and the defined edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import chat_format, components, encoding, jaccard_join, kernel, language_id, packing, phrase_index, quality_ledger, suffix_dedup, token_count, token_table, toxicity
from folioscope.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_b string, rid long"


def frame(spark, rows, parts=3):
    full = [(i, t, "en", "s", None if t is None else len(t), "clash", 5) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.integers(60)) for _ in range(n))


def edge_rows(seed=0):
    """Null, empty and long texts, exact and near copies, ties, and letters of several scripts."""
    rng = np.random.default_rng(seed)
    base = [sentence(rng, int(n)) for n in rng.integers(3, 160, 24)]
    passage = sentence(rng, 70)
    rows = [*base, *base[:6], *[b.replace(" ", "  ", 1) for b in base[6:9]]]
    for b in base[:8]:
        w = b.split()
        w[len(w) // 2] = "changed"
        rows.append(" ".join(w))
    rows += [f"{sentence(rng, 30)} {passage} {sentence(rng, 25)}" for _ in range(5)]
    rows += [None, "", " \n\t", "a", "É" * 60 + "ß日本" * 30, "É" * 60 + "ß日本" * 30 + "x", "spam " * 400, sentence(rng, 9000), "line one\nline one\n\nline two"]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


TRICKY = ["İ. İ, aİ!", "क़. कa क़क़", "a<|endoftext|>b <|startoftext|> <|endof", "\x1cfoo\x1d bar's I'M don't.", "ΑΣ ΣΑΣ", "İstanbul é́", "١٢٣ 12x3", "日本語", "x​y  z", "🙂🙂 ok!!!", "ﬁ ǅ ẞ", "x' y'' 'S 's", "a_b foo- -foo, x."]


def test_heap_counts_and_encoder_match_the_library(tokenizer):
    texts = [t for _, t in edge_rows() if t] + TRICKY
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    count = token_count.Counter(tokenizer_path()).count
    assert [count(t) for t in texts] == [len(w) for w in want]
    small = encoding.Encoder(tokenizer_path(), kept=50)
    for column in (texts, texts[::-1], texts):
        offsets, ids = small.encode_column(pa.array(column), 2)
        got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == [[*w, 2] for w in (want if column is texts else want[::-1])]


def test_fuzzed_texts_match_the_library_in_any_batch(tokenizer):
    rng = np.random.default_rng(3)
    alphabet = list("aAbzéßİıΣσςﬁǅक़्日本🙂٣９1234.,!?'-_|<>&%$# \n\t\x1c\u0307\u200b\u00a0\u0301") + [" ", "<|endoftext|>", "<|EndOfText|>", "'s", "İ.", "the ", "Word "]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 30)))) for _ in range(20_000)]
    want = [[*e.ids, 2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    coder, at = encoding.Encoder(tokenizer_path(), kept=3000), 0
    while at < len(texts):
        to = at + int(rng.integers(1, 60))
        offsets, ids = coder.encode_column(pa.array(texts[at:to]), 2)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want[at:to]
        at = to
    count = token_count.Counter(tokenizer_path()).count
    assert [count(t) + 1 for t in texts] == [len(w) for w in want]


def test_special_strings_in_any_letter_case(tokenizer):
    texts = ["Alpha. <|ENDOFTEXT|> beta, x", "a<|EndOfText|>b <|StartOfText|>. C", "<|endoftext|> Same. one", "Plain. text, here", ""]
    count = token_count.Counter(tokenizer_path()).count
    for neighbours in ([], ["日本 Ω"], ["É é. x"]):
        column = texts + neighbours
        want = [e.ids for e in tokenizer.encode_batch(column, add_special_tokens=False)]
        offsets, ids = encoding.Encoder(tokenizer_path()).encode_column(pa.array(column), 2)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [[*w, 2] for w in want]
        assert [count(t) for t in column] == [len(w) for w in want]


def test_token_counts(spark, tokenizer):
    rows = edge_rows()
    got = {r["doc_id"]: r for r in token_count.token_counts(frame(spark, rows), tokenizer_path()).collect()}
    for i, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)
    assert token_count.token_counts(frame(spark, []), tokenizer_path()).count() == 0


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    twice = Counter(tri)
    marked = {i + k for i, g in enumerate(tri) if twice[g] > 1 for k in range(3)}
    lines = [ln for ln in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", ln)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(marked), "n_lines": len(lines)}


def test_quality_ledger(spark):
    rows = edge_rows() + [(900, "x | y # z\nx | y # z"), (900, "HELLO!! " * 80)]
    book = quality_ledger.ledger(frame(spark, rows))
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_lines"]) for r in book.collect())
    assert got == sorted((i, *plain_measures(t).values()) for i, t in rows)
    per = [r.asDict() for r in quality_ledger.apply_policies(book).collect()]
    for r in per:
        assert r["base_v1"] == (not (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]))
    bits = [r["fail_bits"] for r in per]
    for policy in quality_ledger.POLICIES:
        ablation = {r["rule"]: r for r in quality_ledger.ablations(book, policy).collect()}
        assert set(ablation) == set(policy.rules)
        for rule in policy.rules:
            k = list(quality_ledger.RULES).index(rule)
            assert ablation[rule]["n_failed"] == sum(b >> k & 1 for b in bits)
            assert ablation[rule]["n_only"] == sum(b & policy.mask == 1 << k for b in bits)
    kept = quality_ledger.filter_documents(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert kept.count() == sum(b & quality_ledger.PRODUCTION.mask == 0 for b in bits)
    assert quality_ledger.ledger(frame(spark, [])).count() == 0


def test_packing_is_gapless_and_tight(spark, tokenizer, monkeypatch):
    rows = edge_rows() + [(5, "tie"), (None, "tie")]
    monkeypatch.setattr(packing, "BLOCK", 25)  # several blocks, so that leftovers are dealt again
    got = packing.pack(frame(spark, rows), tokenizer_path(), 1, 256).collect()
    want = Counter()
    for i, t in rows:
        ids = np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at: at + 256]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(bins) <= math.ceil(total / 256) + 3
    assert packing.pack(frame(spark, []), tokenizer_path(), 1).count() == 0


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 200, 300).tolist()
    a, b = (packing.fit_all(lengths, rng.permutation(300).tolist(), 256) for _ in range(2))
    child = packing.crossover(a, b, lengths, rng)
    assert sorted(i for items in child.items for i in items) == list(range(300))
    assert all(256 - r == sum(lengths[i] for i in items) <= 256 for r, items in zip(child.room, child.items, strict=True))
    best, made = packing.evolve(lengths, 256, 0, [])
    assert made >= 1 and len(best.items) <= min(len(a.items), len(b.items))


def test_evolution_beats_best_fit():
    """Triples that fill a bin exactly: best fit, longest first, wastes bins that crossover wins back."""
    rng = np.random.default_rng(0)
    lengths = []
    for _ in range(60):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(max(251, 501 - a), min(499, 749 - a) + 1))
        lengths += [a, b, 1000 - a - b]
    plain = packing.fit_all(lengths, np.argsort(-np.asarray(lengths)).tolist(), 1000)
    for seed in range(3):
        best, made = packing.evolve(lengths, 1000, seed, [], patience=30)
        parents = np.random.default_rng(seed)
        parent = min(len(packing.fit_all(lengths, parents.permutation(180).tolist(), 1000).items) for _ in range(packing.POPULATION))
        assert made > 30 and 60 <= len(best.items) < min(parent, len(plain.items))
    assigned = [0] * len(lengths)
    for k, items in enumerate(best.items):
        for i in items:
            assigned[i] = k
    again, _ = packing.evolve(lengths, 1000, 9, [assigned], patience=30)
    assert len(again.items) <= len(best.items)


def test_islands_cross_and_migrate(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(packing, "BLOCK", 60)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(5, 90, 300))], "pid long, length long")
    seen = []
    keep = packing.written
    monkeypatch.setattr(packing, "written", lambda df, label, **o: seen.append((label, keep(df, label, **o))) or seen[-1][1])
    out = packing.assign(pieces, 100).collect()
    assert sorted(r["pid"] for r in out) == list(range(300))
    epochs = [df for label, df in seen if "epoch" in label]
    assert len(epochs) >= 4 and all(r["crossovers"] >= 1 for df in epochs for r in df.collect())


def test_token_table_round_trip(spark, tokenizer, tmp_path):
    rows = edge_rows() + [(3, "repeated id"), (None, "no id")]
    path = f"file://{tmp_path}/tokens"
    token_table.write_token_table(frame(spark, rows), path, tokenizer_path(), 2)
    got = sorted(token_table.digests(spark, path).collect(), key=lambda r: r["start"])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = token_table.read_documents(spark, path, 10, 12).collect()
    assert sorted(r["doc_id"] for r in some) == [10, 11, 12]
    assert all(r["ids"][-1] == 2 for r in some)


def plain_repeats(rows, span=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        m = bytearray(len(b))
        for q in range(len(b) - span + 1):
            w = b[q: q + span]
            if w in seen:
                m[q: q + span] = b"\1" * span
            seen.add(w)
        out[i] = (len(b), sum(m), len(bytes(m).replace(b"\0", b" ").split()), bytes(c for c, k in zip(b, m, strict=True) if not k))
    return out


@pytest.mark.parametrize("hot_runs", [100_000, 1])
def test_suffix_dedup(spark, hot_runs):
    rows = edge_rows(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.stripped(frame(spark, rows), hot_runs=hot_runs).collect()}
    assert got == plain_repeats(rows)


def test_suffix_dedup_random_small_alphabet(spark):
    rng = np.random.default_rng(5)
    parts = ["".join(rng.choice(list("ab"), 40)) for _ in range(6)]
    rows = [(i, "".join(rng.choice(parts, int(rng.integers(0, 14))))) for i in range(60)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.stripped(frame(spark, rows)).collect()}
    assert got == plain_repeats(rows)


def test_suffix_dedup_keeps_columns_and_odd_ids(spark):
    rows = edge_rows(4) + [(None, "no id " * 50), (2, "second two " * 30), (2, "second two " * 30)]
    docs = frame(spark, rows)
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert all(r["n_chars"] == len(r["text"]) and r["text_b"] == "clash" for r in out.collect() if r["text"] is not None)
    assert suffix_dedup.stripped(frame(spark, [])).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 4, 9000), rng.integers(-3, 3, 9000), rng.integers(0, 1000, 9000)]
    order = suffix_dedup.multikey_quicksort(keys)
    rows = list(zip(*[k[order].tolist() for k in keys], strict=True))
    assert rows == sorted(zip(*[k.tolist() for k in keys], strict=True))


def plain_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(n, len(w))
        sets[i] = {tuple(w[j: j + k]) for j in range(len(w) - k + 1)} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                    ra, rb = root(a), root(b)
                    comp[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def unlike_but_regular():
    """Two strings of two letters that fool polynomial fingerprints."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_regular_strings_stay_apart(spark):
    a, b = unlike_but_regular()
    docs = frame(spark, [(1, f"{a}\n{b}"), (2, a), (3, b), (4, None)])
    book = {r["doc_id"]: r for r in quality_ledger.ledger(docs).collect()}
    assert book[1]["n_dup_lines"] == 0
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.link_components(docs, 4, (85, 100)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    bench = spark.createDataFrame([(1, b)], "item_id long, text string")
    assert {r["row"]["doc_id"]: r["n_hit"] for r in phrase_index.decontaminate(docs, bench).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_fingerprints_tell_ranges_apart():
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    start, size = rng.integers(0, 2700, 50_000), rng.integers(0, 200, 50_000)
    for prints, least in ((kernel.Fingerprints(buf), 0), (kernel.Rolling(buf, 200), 8)):
        on = size >= least
        seen = {}
        for a, n, h in zip(start[on].tolist(), size[on].tolist(), prints.of(start[on], start[on] + size[on]).tolist(), strict=True):
            assert seen.setdefault(buf[a: a + n].tobytes(), h) == h
        assert len(set(seen.values())) == len(seen)
    for width in (8, 32, 100):
        every = kernel.Rolling(buf, 200).every(width)
        assert len(set(every.tolist())) == len({buf[i: i + width].tobytes() for i in range(len(every))})


def test_null_ids_come_last_in_a_component(spark):
    rng = np.random.default_rng(8)
    text = sentence(rng, 60)
    docs = frame(spark, [(None, text), (6, text), (5, text), (None, "alone " * 9), (7, "other")])
    got = [(r["doc_id"], r["component_id"]) for r in jaccard_join.link_components(docs, 4, (85, 100)).collect()]
    assert sorted(got, key=str) == sorted([(None, 5), (6, 5), (5, 5), (None, None), (7, 7)], key=str)


def near_rows(seed):
    """Chains of edits of a few bases, so that links run through other copies."""
    rng = np.random.default_rng(seed)
    rows = []
    for base in range(5):
        words = sentence(rng, int(rng.integers(8, 120))).split()
        for _ in range(24):
            rows.append(" ".join(words))
            words = list(rows[int(rng.integers(max(0, len(rows) - 6), len(rows)))].split()) if rng.random() < 0.5 else list(words)
            for _ in range(int(rng.integers(0, max(2, len(words) // 12)))):
                words[int(rng.integers(len(words)))] = f"edit{rng.integers(1000)}"
    return list(enumerate(rows)) + [(1000 + i, t) for i, t in edge_rows(seed)]


@pytest.mark.parametrize(("seed", "n", "threshold"), [(0, 4, (85, 100)), (1, 5, (80, 100))])
def test_jaccard_join(spark, seed, n, threshold):
    rows = near_rows(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(frame(spark, rows), n, threshold).collect()}
    assert got == plain_components(rows, n, *threshold)


def test_jaccard_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MEMBERS", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rows = near_rows(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(frame(spark, rows), 4, (85, 100)).collect()}
    assert got == plain_components(rows, 4, 85, 100)


def test_jaccard_join_by_prefix(spark, monkeypatch):
    """Sets that fall short under every hash are joined exactly."""
    monkeypatch.setattr(jaccard_join, "SEEDS", 0)
    rows = near_rows(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(frame(spark, rows), 4, (85, 100)).collect()}
    assert got == plain_components(rows, 4, 85, 100)


def test_signatures_find_every_close_pair():
    """Sets that differ in at most H elements share a signature, short sets included."""
    rng = np.random.default_rng(0)
    for size in (6, 7, 8, 11, 12, 13, 20, 40):
        for seed in range(30):
            a = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
            most = int(jaccard_join.most_different(len(a), len(a), 85, 100)) // 2
            b = np.concatenate([a[most:], rng.integers(1, 1 << 62, most).astype(np.uint64)])
            d = np.repeat([0, 1], [len(a), len(b)])
            doc, sig, short = jaccard_join.signatures(d, np.concatenate([a, b]), np.bincount(d), 85, 100, seed % 3)
            if len(short) < 2:
                assert set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist()), (size, seed)


def test_representatives(spark):
    rows = near_rows(3) + [(None, "nothing " * 9), (None, None)]
    docs = frame(spark, rows)
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    want = [i for i, (_, c) in plain_components(near_rows(3), 5, 80, 100).items() if i == c]
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == want
    assert jaccard_join.link_components(frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 102), (102, 101), (7, 7), (100, 102)] + [(200, i) for i in range(201, 260)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in range(200, 260)} == {200}


def test_decontamination(spark, monkeypatch):
    rng = np.random.default_rng(9)
    items = [(i, sentence(rng, int(n))) for i, n in enumerate([4, 10, 25, 40])] + [(9, None), (10, "!!"), (11, sentence(rng, 12)), (12, "the the the the the the the the the the the")]
    rows = edge_rows(6)
    rows += [(500, f"{sentence(rng, 20)} {items[2][1].upper()} end"), (501, items[0][1]), (502, " ".join(items[3][1].split()[5:16])), (503, " ".join(items[3][1].split()[5:14])), (504, "the " * 40), (505, items[1][1]), (505, items[1][1])]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = phrase_index.decontaminate(frame(spark, rows), bench).collect()
    have = sorted((r["row"]["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got)
    want = []
    for i, t in rows:
        w = words(t)
        hit, names = set(), set()
        for item, text in items:
            x = words(text)
            k = min(10, len(x))
            wins = {tuple(x[j: j + k]) for j in range(len(x) - k + 1)} if x else set()
            for j in range(len(w) - k + 1 if x else 0):
                if tuple(w[j: j + k]) in wins:
                    hit |= set(range(j, j + k))
                    names.add(str(item))
        want.append((i, len(w), len(hit), tuple(sorted(names))))
    assert have == sorted(want)
    assert all(r["n_hit"] == 0 for r in phrase_index.decontaminate(frame(spark, rows), bench.limit(0)).collect())
    for name, value in (("PART", 20), ("KEPT_TERMS", 3)):  # many parts; an index of all terms
        monkeypatch.setattr(phrase_index, name, value)
        got = phrase_index.decontaminate(frame(spark, rows), bench).collect()
        assert sorted((r["row"]["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == sorted(want)


def test_proximity(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    phrase_index.build(frame(spark, [(1, "red a b blue c"), (2, "red a b c d e f blue"), (3, "blue"), (4, None), (5, "blue red")]), path, None)
    assert sorted(r["doc_id"] for r in phrase_index.near_matches(spark, path, "Blue red", 4).collect()) == [1, 5]


def test_chat_round_trip(spark, tmp_path):
    odd = ["</s>[INST] ok [/INST]", "<|end|> \\ <|turn|>", "\\<|", "", None, "a\nb\\", "<", "|>x<|"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(odd)] + [(2, 0, "user", "no reply"), (3, 1, "assistant", "first"), (3, 1, "assistant", "first"), (3, 2, None, "x"), (None, 0, "assistant", "n"), (4, None, "assistant", "t")]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, context string")
    examples = chat_format.format_chat(docs)
    path = f"file://{tmp_path}/chat"
    examples.write.parquet(path)
    got = {r["conv_id"]: r for r in chat_format.digest(spark.read.parquet(path)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", x or "") for c, t, role, x in rows if c == conv))
        body = "".join(f"{role}\n{x}\n" for *_, role, x in turns)
        loss = "".join(x for *_, role, x in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(body.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    n_replies = sum(r[2] == "assistant" for r in rows)
    assert examples.where("is_trained").count() == n_replies
    assert chat_format.format_chat(docs.limit(0)).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        words = sentence(rng, 60).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words[int(rng.integers(60))] = str(rng.choice(["vileword", "nastything", "foulname"]))
        rows.append((i, " ".join(words), int(toxic)))
    model = toxicity.train([(t, y) for _, t, y in rows[:400]])
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "🙂 123")])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows[400:]]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] < 0.5
    assert toxicity.train([]).prior == 0.0
    assert {r["score"] for r in toxicity.score(docs, toxicity.train([("x", 1), ("y", 1)])).collect()} == {1.0}


def test_toxicity_dictionaries_are_trained():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1500):
        words = re.sub(r"\d", lambda m: chr(97 + int(m[0])), sentence(rng, 60)).split()
        for k in rng.choice(60, 6 if i % 6 == 0 else 0, replace=False):
            words[k] = str(rng.choice(["scoundrel", "blockhead", "nitwitted", "dunderhead"]))
        rows.append((" ".join(words), int(i % 6 == 0)))
    model = toxicity.train(rows[:1000])
    magic = (0xEC30A437).to_bytes(4, "little")
    assert len(model.dictionaries) == len(toxicity.PAIRS)
    for plain, toxic in model.dictionaries:
        assert plain.startswith(magic) and toxic.startswith(magic) and plain != toxic
        assert b"scoundrel" in toxic and b"scoundrel" not in plain
    # The features against windows compressed one by one.
    text = rows[0][0]
    got = model.features(text)
    plain, toxic = (toxicity._compressor(d) for d in model.dictionaries[0])
    saved = sorted(len(plain(w)) - len(toxic(w)) for w in toxicity.windows(text))
    assert got[0] == saved[-1] and got[2] == pytest.approx(sum(saved) / len(saved))
    held = [(float(model.score(np.asarray([model.features(t)]))[0]) >= 0.5, y) for t, y in rows[1000:]]
    assert np.mean([p == bool(y) for p, y in held]) > 0.95
    assert toxicity.windows("a b c", 2, 1) == [b" a b ", b" b c "] and toxicity.windows("1 2") == []


def test_toxicity_trains_alike_as_tasks_and_here(spark):
    rng = np.random.default_rng(5)
    rows = [(sentence(rng, 40) + (" you scoundrel blockhead nitwitted" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(120)]
    here, tasks = toxicity.train(rows), toxicity.train(rows, spark)
    assert here.dictionaries == tasks.dictionaries and here.weights == tasks.weights and here.centre == tasks.centre
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(frame(spark, []), here).collect() == []
    empty = toxicity.train(toxicity.sample(frame(spark, []), labels, F.lit(True)), spark)
    long = "plain words " * 60_000
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, [(1, long), (2, None)]), here).collect()}
    assert got[1] == float(here.score(np.asarray([here.features(long)]))[0]) and 0 <= got[2] <= 1
    assert [r["score"] for r in toxicity.score(frame(spark, [(1, "a")]), empty).collect()] == [0.0]


def test_language_id(spark):
    rng = np.random.default_rng(0)
    parts = {"xx": ["ing", "the", "er", "tion"], "yy": ["sch", "ung", "keit", "ver"], "zz": ["eau", "oi", "ment", "que"]}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang], int(rng.integers(1, 4)))) for _ in range(30))
    train = [(make(lang), lang) for lang in parts for _ in range(30)]
    model = language_id.train(train, language_id.vocabulary(tokenizer_path("piece_bpe_32k.model")))
    rows = [(i, make(lang), lang) for i, lang in enumerate([*parts] * 10)]
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "12 !? ½²"), (903, "q" * 500)])
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows]) >= 0.95
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert got[903]["lang_pred"] in parts
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.train([], ["a"])).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab"]
    model = language_id.Model(["x"], {p: k for k, p in enumerate(pieces)}, np.asarray([[0.1], [0.2], [0.3], [0.15], [0.05], [0.2]]))
    want = 0.2 + 0.2 * 0.15 + 0.1 * 0.05 + 0.1 * 0.3 * 0.15  # ▁ab, ▁a+b, ▁+ab, ▁+a+b
    assert model.forward("ab")[0] == pytest.approx(math.log(want))
    assert model.forward_many(["ab"])[0, 0] == pytest.approx(math.log(want))


def plain_em(words, pieces, rounds):
    """Piece probabilities by listing every segmentation of every word."""
    def cuts(w):
        if not w:
            return [[]]
        return [[w[:j], *rest] for j in range(1, len(w) + 1) if w[:j] in pieces for rest in cuts(w[j:])]

    p = {x: 1 / len(pieces) for x in pieces}
    for _ in range(rounds):
        used = dict.fromkeys(pieces, 0.01)
        for w, c in words.items():
            ways = cuts("▁" + w)
            weight = [math.prod(p[x] for x in way) for way in ways]
            for way, m in zip(ways, weight, strict=True):
                for x in way:
                    used[x] += c * m / sum(weight)
        total = sum(used.values())
        p = {x: v / total for x, v in used.items()}
    return p, cuts


def test_language_model_against_all_segmentations(spark):
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "c"]
    rows = [("ab aab ba ab", "x"), ("c ca bc", "y"), ("ab c", "y"), (None, "x")]
    model = language_id.train(rows, pieces)
    tables = {}
    for column, lang in enumerate(model.languages):
        words = Counter(w for t, y in rows if y == lang and t for w in t.split())
        p, cuts = plain_em(words, pieces, language_id.ROUNDS)
        tables[lang] = p
        assert [model.probabilities[model.pieces[x], column] for x in pieces] == pytest.approx([p[x] for x in pieces])
    texts_ = ["ab ba", "c bc c", "abab", ""]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(frame(spark, list(enumerate(texts_))), model).collect()}
    for i, t in enumerate(texts_):
        score = {lang: sum(math.log(sum(math.prod(p[x] for x in way) for way in cuts("▁" + w))) for w in t.split()) for lang, p in tables.items()}
        assert got[i] == (max(sorted(score), key=score.get) if t else "und")


def test_old_and_new_policies_read_one_ledger(spark):
    """Bits keep their places; version 1 of production rejects texts whose words end in marks, version 2 keeps them."""
    assert list(quality_ledger.RULES) == ["few_words", "repeated_words", "symbol_heavy", "repeated_lines", "odd_word_length", "shouting", "marked_words"]
    rows = [(1, " ".join(f"word{k}!" for k in range(60))), (2, " ".join(f"word{k}" for k in range(60))), (3, "a b")]
    book = {r["doc_id"]: r for r in quality_ledger.apply_policies(quality_ledger.ledger(frame(spark, rows))).collect()}
    assert [book[k]["fail_bits"] for k in (1, 2)] == [64, 0] and book[3]["fail_bits"] & 1 and book[1]["n_marked_words"] == 60
    assert [(book[k]["production_v1"], book[k]["production_v2"], book[k]["no_markup_v1"], book[k]["no_markup_v2"]) for k in (1, 2, 3)] == [(False, True, False, True), (True,) * 4, (False,) * 4]


def test_an_item_without_id_is_no_item(spark):
    text = " ".join(f"w{k}" for k in range(20))
    docs = frame(spark, [(1, text), (2, f"{text} more")])
    items = spark.createDataFrame([(None, text), (5, "w3 w4 w5 w6")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], list(r["items"])) for r in phrase_index.decontaminate(docs, items).select("row.doc_id", "n_hit", "items").collect()}
    assert got == {1: (4, ["5"]), 2: (4, ["5"])}


def test_components_that_do_not_settle_are_an_error(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["component"] for r in components.components(edges).collect()} == {0}
    monkeypatch.setattr(components, "ROUNDS", 2)
    with pytest.raises(RuntimeError):
        components.components(edges)


def test_long_and_uncovered_words_are_learnt_from(spark):
    """A run of letters without blanks, and letters without a piece, tell a language as well."""
    pieces = ["▁", "▁a", "a", "b", "ab", "c"]
    for text in ("ab" * 40, "ab" * 250, "abßab" * 3, "ß" * 20 + "ab"):
        model = language_id.train([(text, "x"), ("c" * 90, "y")], pieces)
        x, y = model.probabilities[:, 0], model.probabilities[:, 1]
        assert x[model.pieces["ab"]] > 3 * y[model.pieces["ab"]] and y[model.pieces["c"]] > 3 * x[model.pieces["c"]]
    # In logarithms and together the sums are the same.
    p = np.asarray([0.1, 0.2, 0.3, 0.15, 0.2, 0.05])
    index = {q: k for k, q in enumerate(pieces)}
    for word in ("abab", "aßb", "c"):
        one = np.zeros(len(pieces) + 2)
        language_id._expected_long("▁" + word, 3, index, p, one)
        assert language_id._expected([word], [3], index, p) == pytest.approx(one[: len(pieces)])
    rows = [("ab aab ba ab " + "ab" * 99, "x"), ("c ca bc", "y"), ("ab c", "y"), (None, "x")]
    assert (language_id.train(rows, pieces, spark).probabilities == language_id.train(rows, pieces).probabilities).all()


def test_language_id_of_an_empty_table_and_ties(spark):
    docs = frame(spark, [])
    pieces = ["▁", "▁a", "a"]
    model = language_id.train(language_id.sample(docs, F.lit(True)), pieces, spark)
    assert model.languages == [] and language_id.predict(docs, model).collect() == []
    tie = language_id.train([("a aa", "y"), ("aa a", "x")], pieces)
    got = language_id.predict(frame(spark, [(1, "a"), (2, "a" * 3_000)]), tie).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("x", 0.5)] * 2


def test_samples_keep_each_rows_own_label(spark):
    rows = [(1, "aaa", "x"), (1, "bbb", "y"), (1, "bbb", "y"), (2, None, "x"), (3, "z" * 600_000, "x"), (None, "n", "x"), (4, "d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = F.col("doc_id") > 0
    assert sorted(language_id.sample(docs, learn), key=str) == sorted([("aaa", "x"), ("bbb", "y"), ("bbb", "y"), (None, "x")], key=str)
    assert len(language_id.sample(docs, learn, most=1)) == 2
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (9, 1), (3, None)], "doc_id long, toxic int")
    assert len(toxicity.sample(docs, labels, learn)) == 7


def test_string_chunks_cut_between_texts():
    col = pa.array(["ab", None, "", "cdef", "g"] * 3)
    batch = pa.RecordBatch.from_arrays([col], ["text"]).slice(1, 11)
    got = []
    for rows, data, offsets in kernel.string_chunks(batch, "text", limit=4):
        got += [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert rows.stop - rows.start == len(offsets) - 1
    assert got == [t or "" for t in batch.column("text").to_pylist()]


def test_long_texts(spark, tokenizer):
    """A text far beyond a chunk, in every operator over documents."""
    rng = np.random.default_rng(11)
    body = " ".join(np.char.add(rng.choice(WORDS, 400_000), rng.integers(0, 40_000, 400_000).astype(str)).tolist())
    rows = [(1, body), (2, body[700_000:702_000]), (3, "short one"), (4, body + " tail")]
    assert len(body) > 2 * kernel.CHUNK
    docs = frame(spark, rows, 2)
    library = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}
    assert {r["doc_id"]: r["n_tokens"] + 1 for r in token_count.token_counts(docs, tokenizer_path()).collect()} == {i: len(x) for i, x in library.items()}
    book = {r["doc_id"]: r for r in quality_ledger.ledger(docs).collect()}
    for i, t in rows:
        assert [book[i][m] for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [*plain_measures(t).values()][:5]
    offsets, ids = encoding.Encoder(tokenizer_path()).encode_long(body, 2, 100_000)
    assert ids.tolist() == library[1] and offsets.tolist() == [0, len(library[1])]
    assert sum(r["length"] for r in packing.pack(docs, tokenizer_path(), 1).collect()) == sum(map(len, library.values()))
    removed = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.stripped(docs).collect()}
    assert removed == {1: (0, 0), 2: (2000, 1), 3: (0, 0), 4: (len(body), 1)}
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.link_components(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    bench = spark.createDataFrame([(7, " ".join(body.split()[300_000:300_012]))], "item_id long, text string")
    assert {r["row"]["doc_id"]: r["n_hit"] for r in phrase_index.decontaminate(docs, bench).collect()} == {1: 12, 2: 0, 3: 0, 4: 12}


def test_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} <|end|>") for k in range(600)]
    examples = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat_format.digest(examples).first()
    assert got["n_turns"] == 600 and got["loss_chars"] == sum(len(t) for _, k, _, t in rows if k % 2)
    assert got["formatted_chars"] > 600 * 600 / 4 * 20


def plain_pipeline(docs, items, tokenizer):
    """The pipeline by plain means: rows (doc_id, text) that are left after each stage, then the pieces."""
    left = []
    for i, t in docs:
        m = plain_measures(t)
        letters, upper = len(re.findall("[A-Za-z]", t or "")), len(re.findall("[A-Z]", t or ""))
        n = m["n_words"]
        bad = n < 50 or 100 * m["n_repeat_words"] > 50 * n or 100 * m["n_symbols"] > 20 * n or (m["n_lines"] >= 4 and 100 * m["n_dup_lines"] > 50 * m["n_lines"])
        bad = bad or not 2 * n <= m["word_chars"] <= 20 * n or (letters >= 50 and 100 * upper > 60 * letters)
        if not bad:
            left.append((i, t))
    stages = [sorted(left)]
    comp = plain_components(left, 5, 80, 100)
    stages.append([(i, t) for i, t in stages[-1] if comp[i][1] == i])
    cut = plain_repeats(stages[-1])
    stages.append([(i, cut[i][3].decode("utf-8", "ignore")) for i, t in stages[-1] if not t or cut[i][3].decode("utf-8", "ignore")])
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w, k: {tuple(w[j: j + k]) for j in range(len(w) - k + 1)}
    held = [(min(10, len(w)), grams(w, min(10, len(w)))) for w in map(words, items) if w]
    clean = []
    for i, t in stages[-1]:
        w = words(t)
        mine = {k: grams(w, k) for k in {k for k, _ in held}}
        if not any(mine[k] & g for k, g in held):
            clean.append((i, t))
    stages.append(clean)
    pieces = Counter()
    for i, t in clean:
        ids = np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            pieces[i, k, at, len(ids[at: at + 4096]), zlib.crc32(ids[at: at + 4096].tobytes())] += 1
    return stages, pieces


def test_pipeline(spark, tokenizer):
    """Every stage against its plain version, on documents that each stage has work with."""
    import corpus_pipeline

    home = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{home}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{home}/benchmark.parquet").collect()]
    rng = np.random.default_rng(12)
    prose = [sentence(rng, 120) for _ in range(6)]
    passage = sentence(rng, 60)
    made = [*prose, prose[0], prose[1].replace(" ", "  ", 1), " ".join(["changed", *prose[2].split()[1:]]), f"{sentence(rng, 60)} {passage} {sentence(rng, 60)}", f"{sentence(rng, 70)} {passage}", f"{sentence(rng, 60)} {items[0]} {sentence(rng, 60)}", "", None, "tail " * 90]
    more = spark.createDataFrame([(100_000 + i, t, "en", "made", len(t or "")) for i, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long")
    now = docs.unionByName(more.select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])).persist()
    rows = [(r["doc_id"], r["text"]) for r in now.collect()]
    stages, pieces = plain_pipeline(rows, items, tokenizer)
    assert [len(rows), *map(len, stages)] == sorted([len(rows), *map(len, stages)], reverse=True) and len({len(s) for s in stages}) >= 3
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, home).persist()
        if k < 4:
            assert now.schema.simpleString() == docs.schema.simpleString()
            assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == sorted(stages[k])
    got = now.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    bins = Counter()
    for r in got:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 4096 and len(bins) <= -(-sum(bins.values()) // 4096) + 1


def test_pipeline_stages_on_odd_rows(spark):
    """Null ids and texts, repeated rows and an empty table pass through every stage."""
    import corpus_pipeline

    home = "/root/testdata/sf0.001"
    rng = np.random.default_rng(13)
    text = sentence(rng, 90)
    rows = [(None, text), (None, text), (3, text), (3, text), (4, None), (5, ""), (6, sentence(rng, 80)), (None, None)]
    for held in (rows, []):
        now = spark.createDataFrame([(i, t, None, None, None) for i, t in held], "doc_id long, text string, lang string, source string, n_chars long")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, home).persist()
            if k == 1 and held:
                assert sorted(r["doc_id"] for r in now.collect()) == [3, 6]
            if not held:
                assert now.count() == 0
