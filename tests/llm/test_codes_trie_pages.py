"""Vector codes, the prefix trie and main texts against plain versions, and their defined cases."""

import hashlib
import zlib

import numpy as np
import pytest

from folioscope.llm import main_text, prefix_trie, vector_codes


# Vector codes ---------------------------------------------------------------


def plain_codes(rows, parts=16, k=64, rounds=2):
    """(codes by row, errors by row, codebooks) of kept rows [(id, vector)], by exact integers."""
    kept = sorted([(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[int(np.floor(256 * float(np.float32(x)))) for x in v] for _, v in kept]
    w = len(ints[0]) // parts
    cut = [[v[j * w : (j + 1) * w] for j in range(parts)] for v in ints]
    books = [[cut[e][j] for e in range(min(k, len(cut)))] for j in range(parts)]

    def nearest(j, p):
        return min((sum((a - b) ** 2 for a, b in zip(p, e)), i) for i, e in enumerate(books[j]))

    for _ in range(rounds):
        at = [[nearest(j, c[j])[1] for j in range(parts)] for c in cut]
        for j in range(parts):
            for e in range(len(books[j])):
                mine = [c[j] for c, a in zip(cut, at) if a[j] == e]
                if mine:
                    books[j][e] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [[nearest(j, c[j]) for j in range(parts)] for c in cut]
    return sorted((i, bytes(e for _, e in o), sum(d for d, _ in o)) for (i, _), o in zip(kept, out)), books


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, i % 3 if i is not None and i % 7 else None, "clash") for i, v in rows], "vec_id long, embedding array<float>, label int, ints string").repartition(parts)


@pytest.mark.parametrize("grain", [0, 8])
def test_codes_equal_plain_lloyd(spark, grain):
    """With coarse components most distances tie."""
    rng = np.random.default_rng(4)
    rows = [(int(i), (np.round(v * grain) / grain if grain else v).astype(np.float32).tolist()) for i, v in enumerate(rng.normal(0, 0.4, (260, 32)))]
    rows += [(300, None), (301, [0.1] * 31 + [None]), (302, [float("nan")] * 32), (303, [float("-inf")] * 32), (304, rows[0][1]), (305, rows[0][1])]
    coded, books = vector_codes.compress(vectors(spark, rows))
    want, plain = plain_codes(rows)
    assert sorted((r["vec_id"], bytes(r["codes"]), r["error"]) for r in coded.collect()) == want
    assert books.entries.tolist() == plain
    sums: dict = {}
    found = vector_codes.label_errors(coded).collect()
    for r in found:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert len(found) == len(want) and all(r["label_error"] == sums[r["label"]] for r in found)


def test_bounds_skip_groups_and_change_nothing():
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, (64, 4))
    points = centres[rng.integers(0, 64, 6000)] + rng.integers(-9, 10, (6000, 4))
    books = vector_codes.Codebooks(points[None, :64])
    code, _, low = books.first(0, points)
    share = []
    for _ in range(4):
        sums, counts = np.zeros_like(books.entries), np.zeros((1, 64), np.int64)
        np.add.at(sums[0], code, points)
        np.add.at(counts[0], code, 1)
        books = books.updated(sums, counts)
        code, best, low, taken = books.again(0, points, code, low)
        full, nearest, _ = books.first(0, points)
        assert (code == full).all() and (best == nearest).all()
        share.append(taken / (len(points) * 64))
        for g in range(books.n_groups):  # every bound holds
            members = np.flatnonzero(books.groups[0] == g)
            d = np.sqrt(vector_codes.squared(points, books.entries[0][members]).astype(float))
            d[members[None, :] == code[:, None]] = np.inf
            assert (low[:, g] <= d.min(1)).all()
    assert share[-1] < 0.5


def test_codes_of_odd_tables(spark):
    empty, books = vector_codes.compress(vectors(spark, [(1, None)]))
    assert empty.count() == 0 and books is None
    few = [(None, [0.5] * 16), (2, [0.25] * 16), (2, [0.125] * 16)]
    coded, books = vector_codes.compress(vectors(spark, few))
    assert books.entries.shape == (16, 3, 1) and books.entries[0, :, 0].tolist() == [32, 64, 128] and coded.count() == 3
    for bad in ([(1, [0.0] * 16), (2, [0.0] * 32)], [(1, [0.0] * 10)], [(1, [3e37] * 16)]):
        with pytest.raises(ValueError):
            vector_codes.compress(vectors(spark, bad))


# Prefix trie ----------------------------------------------------------------


def plain_trie(rows, rebuild=True):
    own: dict = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:] if rebuild else turns)
    members: dict = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    found = set()
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if paths[c] == p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        found.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return found


def talks(seed, n, turns=9, words=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, turns))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "é🙂"[: int(rng.integers(0, 3))] + "w" * int(rng.integers(0, words))))
    return rows


def conversations(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, path string").repartition(parts)


def check_trie(found, want):
    rows = [tuple(r[c] for c in prefix_trie.RESULT) for r in found.collect()]
    assert len(rows) == len(set(rows)) == len(want) and set(rows) == want


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_equals_plain_version(spark, rebuild):
    rows = [*talks(1, 260), (260, None, "user", "first"), (260, 0, "user", None), (261, 0, None, None), (None, 0, "user", "nobody"), (1299, 0, "user", "alone")]
    check_trie(prefix_trie.conversation_trie(conversations(spark, rows), rebuild), plain_trie(rows, rebuild))


def test_trie_of_many_small_parts_and_one_hot_path(spark):
    """Splitters fall into shared paths and between the ids of one path."""
    rows = talks(2, 150) + [(1000 + c, t, "user", f"same {t}") for c in range(700) for t in range(3)] + [(2000 + c, t, "user", f"long {min(t, 39 - c % 3)}") for c in range(9) for t in range(40)]
    want = plain_trie(rows, False)
    for part_bytes, run_bytes in ((700, 2000), (20_000, 1 << 20)):
        sequences = prefix_trie.paths(conversations(spark, rows))
        check_trie(prefix_trie.trie(sequences, part_bytes, run_bytes), want)


def test_merge_by_lcps():
    rng = np.random.default_rng(3)
    code = [bytes([k]) * prefix_trie.WIDTH for k in range(3)]
    rows = [(b"".join(code[k] for k in rng.integers(0, 3, rng.integers(0, 9))), int(i)) for i in range(900)]
    for k in (1, 2, 3, 7):
        runs = [prefix_trie.Run(*p[1:]) for i in range(k) for p in prefix_trie.front_coded(rows[i::k], [])]
        got = [(p, ids.tolist()) for p, _, ids in prefix_trie.merged(runs)]
        assert got == sorted((p, sorted(i for q, i in rows if q == p)) for p in {p for p, _ in rows})
    lcps = [(p, lcp) for p, lcp, _ in prefix_trie.merged([prefix_trie.Run(*p[1:]) for i in range(5) for p in prefix_trie.front_coded(rows[i::5], [])])]
    assert all(lcp == prefix_trie.common(a, b) for (a, _), (b, lcp) in zip(lcps, lcps[1:]))


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.conversation_trie(conversations(spark, [(None, 0, "user", "x")])).collect() == []


# Main text ------------------------------------------------------------------

CHROME = '<header class="site"><h1>Site</h1></header><nav><a href="/">Home</a></nav>'


def extracted(spark, pages):
    rows = spark.createDataFrame([(i, u, h, "clash", 1) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, host string, path int").repartition(3)
    return {r["page_id"]: r["text"] for r in main_text.extract(rows).collect()}


def test_main_text_of_made_pages(spark):
    prose = [f"Paragraph {k} tells a story of some length, with commas and all." for k in range(4)]
    article = (
        f"<!doctype html><html><head><title>T</title><style>p{{}}</style><script>if (a<b) '</p>'</script></head><body>{CHROME}"
        f'<div class="cookie-notice"><p>We use cookies, a great many of them, and tell you so at length.</p></div>'
        f"<article class=post-17><header><h1>A &amp; B&nbsp;C</h1></header><p>{prose[0]}<br>{prose[1]}<p>Some <b>bold</b>\n  <a href=x>link</a> text&#33;"
        f'<div class="ad-slot"><p>Buy now, buy cheap, buy often.</p></div><ul><li>One<li>Two</ul><aside>Beside the point, but rather long.</aside>'
        f"<form><label>Mail</label><input></form><section id=comments><p>{prose[2]} said a reader, and went on and on about it for long.</p></section></article>"
        f'<div class="sidebar"><p>{prose[3]}</p></div><footer>&copy; All of it</footer>'
    )
    want = f"A & B C\n\n{prose[0]} {prose[1]}\n\nSome bold link text!\n\nOne\n\nTwo"
    # Unmarked containers: the host's pages agree on div.x#, where the box differs and the notice never does.
    boxes = [f'<div class=w><p>An unmarked line that stands on every page.</p><div class="x{k}"><p>{prose[k % 4]} {k}</p><p>{prose[0]}</p></div></div><div><a href=a>one</a> <a href=b>two</a></div>' for k in range(6)]
    pages = [("https://a.example/1", article), *[("http://u@B.example:80/" + str(k), h) for k, h in enumerate(boxes)], (None, None), ("x", ""), ("x", "no tags, only &lt;text&gt; < 3"), ("https://c.example/", "<p>cut off <b"), ("https://c.example/2", "<div class='x")]
    found = extracted(spark, pages)
    assert found[0] == want
    for k in range(6):
        assert found[1 + k] == f"{prose[k % 4]} {k}\n\n{prose[0]}"
    assert [found[k] for k in range(7, 12)] == ["", "", "no tags, only <text> < 3", "cut off", ""]


def test_pages_without_their_hosts_container_use_their_own(spark):
    pages = [("https://h.example/%d" % k, f"<body><main><p>Main text number {k} of this host, as usual.</p></main></body>") for k in range(5)]
    pages += [("https://h.example/odd", "<body><div class=story><p>Another make of page, without the container.</p></div></body>")] * 2
    found = extracted(spark, pages)
    assert found[5] == found[6] == "Another make of page, without the container." and found[3].startswith("Main text number 3")


def test_copies_keep_their_text(spark):
    """Pages that are all the same have no part that only the host repeats."""
    pages = [("https://h.example/%d" % k, "<div class=page><h2>Head</h2><p>The same text everywhere, and no other.</p></div>") for k in range(8)]
    assert set(extracted(spark, pages).values()) == {"Head\n\nThe same text everywhere, and no other."}


def test_host_votes(spark):
    rows = spark.createDataFrame([(0, "https://h.example/", "<body><div class='post n7'><p>Text, and more text.</p></div></body>")] * 3, "page_id long, url string, html string")
    (won,) = main_text.winners(rows).collect()
    assert (won["host"], won["label"], won["pages"], won["same"]) == ("h.example", "div.n#.post", 3, [])


def test_headers_of_site_and_article():
    text = "A sentence of the article that is long enough to be told from the rest of the page."
    made = lambda top: main_text.Page(f'<body><div class="site-header"><h1>Site</h1></div><div class="post">{top}<p>{text}</p><div class="post-footer">Filed under x</div></div></body>').text()
    assert made('<div class="post-header"><h1>Title</h1></div>') == f"Title\n\n{text}"
    assert made('<header class="entry-header"><h2>Title</h2></header>') == f"Title\n\n{text}"
    assert made('<div class="header"><h1>Title</h1></div>') == text and made('<div class="post-header">by someone</div>') == text


def test_long_and_deep_pages():
    page = main_text.Page("<div>" * 3000 + "<p>deep down, some text" + "</div>" * 3000)
    assert page.text() == "deep down, some text"
    assert len(main_text.Page("<article>" + "<p>word word</p>" * 100_000).text()) == 100_000 * 11 - 2
    assert main_text.Page('<a b="' * 20_000).text() == ""
    assert extracted_text("<table><tr><td>a cell of text<td>another one</table><p>x") == "a cell of text\n\nanother one\n\nx"


def extracted_text(html):
    return main_text.Page(html).text()


def test_empty_table_of_pages(spark):
    rows = spark.createDataFrame([], "page_id long, url string, html string")
    assert main_text.extract(rows).collect() == []
