"""Lexical and vector retrieval with deterministic top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import BLOCK_STOP, PAGE_STOP, tokens


def term_counts(rows: DataFrame, keys: list[str], text: Column, profile: str = "block", vocabulary: DataFrame | None = None) -> DataFrame:
    """(keys..., token, tf): one row per key and token, combined before the shuffle.

    With a ``vocabulary`` (token) all other tokens go before anything is counted
    or shuffled; Spark broadcasts it if its size allows.
    """
    found = rows.select(*keys, F.explode(tokens(text, "all")).alias("token"))
    if profile == "block":  # filtered as rows, in generated code, rather than inside the array
        found = found.where(~F.col("token").isin(*BLOCK_STOP))
    elif profile == "page":
        found = found.where(~F.col("token").isin(*PAGE_STOP) & (F.length("token") >= 2))
    if vocabulary is not None:
        found = found.join(vocabulary.select("token").distinct(), "token", "left_semi")
    return found.groupBy(*keys, "token").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log((1.0 + n) / (1.0 + df)) + 1.0


def lexical_scores(query_terms: DataFrame, unit_terms: DataFrame, totals: DataFrame, unit: list[str], scope: list[str] | None = None) -> DataFrame:
    """Score of every unit that shares a token with a query.

    score = sum over tokens of q_tf * min(3, tf) * (ln((1 + N) / (1 + df)) + 1).

    query_terms: (qid, token, q_tf); unit_terms: (scope..., unit..., token, tf);
    totals: (scope..., n_units). Without ``scope``, N and df are the corpus's;
    with ``scope`` = ['qid'] they are those of each query's own candidates. Unit
    terms that no query uses are dropped here; :func:`term_counts` with a
    vocabulary drops them before they are counted.
    """
    scope = scope or []
    vocabulary = query_terms.select(*scope, "token").distinct()
    used = unit_terms.join(vocabulary, [*scope, "token"], "left_semi")
    frequency = used.groupBy(*scope, "token").agg(F.count("*").alias("df"))
    weighed = query_terms.join(frequency, [*scope, "token"])
    weighed = weighed.join(totals, scope) if scope else weighed.crossJoin(F.broadcast(totals))  # totals is one row
    weighed = weighed.select("qid", "token", (F.col("q_tf") * idf(F.col("n_units"), F.col("df"))).alias("weight"))
    on = ["qid", "token"] if "qid" in scope else ["token"]
    return (
        used.join(weighed, on)
        .groupBy("qid", *unit)
        .agg(F.sum(F.col("weight") * F.least(F.lit(3), F.col("tf"))).alias("score"), F.count("*").alias("matched"))
    )


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """Rows ranked 1..k within ``by``; ``order`` must be total."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return ranked.where(F.col(rank) <= k)


def select_pages(ranked: Column, known: Column, k: int, fallback: int) -> Column:
    """The first k known pages of a ranking without repeats; the first ``fallback`` known pages where none is ranked."""
    found = F.slice(F.filter(F.array_distinct(ranked), lambda p: F.array_contains(known, p)), 1, k)
    return F.when(F.size(found) > 0, found).otherwise(F.slice(known, 1, fallback))


def restore_order(selected: Column, original: Column) -> Column:
    return F.filter(original, lambda p: F.array_contains(selected, p))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays; 0 where their lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def cosine(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(eps))


def late_interaction(query_vectors: DataFrame, page_vectors: DataFrame, k: int) -> DataFrame:
    """Sum over query vectors of the best dot product on each page; top k pages.

    query_vectors: (qid, q_pos, q_vec), a stated query set; page_vectors: (page_id,
    p_vec). The queries are dealt into blocks of ``BLOCK`` vectors, each one row;
    every page vector meets every block once, and partial maxima combine before
    the shuffle. No block grows with the data.
    """
    blocks = query_blocks(query_vectors, "q_pos", ["qid", "q_pos", "q_vec"])
    parts = blocks.count()
    dealt = page_vectors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, parts - 1)).cast("long"))))
    scored = dealt.join(blocks, "block").select("page_id", "p_vec", F.explode("queries").alias("q")).select("q.qid", "q.q_pos", "page_id", dot(F.col("q.q_vec"), F.col("p_vec")).alias("s"))
    best = scored.groupBy("qid", "page_id", "q_pos").agg(F.max("s").alias("s"))
    pages = best.groupBy("qid", "page_id").agg(F.sum("s").alias("score"))
    return top_k(pages, ["qid"], [F.round("score", 6).desc(), F.col("page_id")], k)


#: Query vectors in one block.
BLOCK = 512


def query_blocks(queries: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(block, queries): a stated query set as arrays of about ``BLOCK`` rows, blocks numbered from 0."""
    n = -(-queries.count() // BLOCK) or 1
    return queries.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n))).groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("queries")).select(
        (F.row_number().over(Window.orderBy("block")) - 1).cast("long").alias("block"), "queries"
    )  # one row a block


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, cosine, rank): exact cosine neighbours, a query itself left out.

    vectors: (vec_id, embedding); queries: (qid, a), a stated set, in blocks. A
    partition keeps its own k best of each query before anything is shuffled, so
    what is shuffled grows with partitions and queries, not with all pairs.
    """
    blocks = query_blocks(queries, "qid", ["qid", "a"])
    parts = blocks.count()
    dealt = vectors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, parts - 1)).cast("long"))))
    pairs = dealt.join(blocks, "block").select("vec_id", "embedding", F.explode("queries").alias("q")).where(F.col("q.qid") != F.col("vec_id"))
    scored = pairs.select(F.col("q.qid").alias("qid"), "vec_id", F.round(cosine(F.col("q.a"), F.col("embedding")), 6).alias("cosine"))
    return top_k(scored, ["qid"], [F.col("cosine").desc(), F.col("vec_id")], k)


def baseline_order(kind: str, pages: Column, gold: Column, seed: str = "0") -> Column:
    """Control rankings: as given, gold first, or by a stable hash."""
    if kind == "first":
        return pages
    if kind == "oracle":
        return F.concat(F.filter(pages, lambda p: F.array_contains(gold, p)), F.filter(pages, lambda p: ~F.array_contains(gold, p)))
    if kind == "random":
        return F.transform(F.array_sort(F.transform(pages, lambda p: F.struct(F.sha2(F.concat(F.lit(seed), F.lit(":"), p.cast("string")).cast("binary"), 256).alias("h"), p.alias("p")))), lambda s: s.p)
    raise ValueError(f"unknown baseline {kind!r}")
