"""Sources: JSON lines, document stores, rankings, tab-separated metadata, report tables.

Readers give typed frames and never collect; paths may be any that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from folioscope.functions.text import strip

DOCUMENT = """document_id string, schema_version string, pages array<struct<page_id: string, width: double, height: double, image_path: string, page_text: string,
  blocks: array<struct<block_id: string, type: string, bbox: array<double>, text: string, order_index: int>>>>"""

RANKING = "sample_id string, id string, dataset string, ranked_page_ids array<string>, selected_page_ids array<string>, page_ids array<string>, top_page_ids array<string>, scores array<struct<page_id: string, score: double>>, latency_s double, num_pages int, model string"


class BadRow(ValueError):
    """A strict source holds a row that can't be read."""


def json_lines(spark: SparkSession, path: str | list[str], schema: str | StructType, strict: bool = False) -> DataFrame:
    """One object per line; blank lines are skipped. gz files are read as they are.

    A bad line is an error, never lost. Strict sources are read once more
    beforehand, so that the error names the file and line.
    """
    if strict:
        _refuse_bad_lines(spark, path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _refuse_bad_lines(spark: SparkSession, path: str | list[str]) -> None:
    """Raise :class:`BadRow` with file:line for a line that is no JSON object."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(strip(F.col("value")) != "")
    bad = lines.where(F.try_parse_json("value").isNull() | ~strip(F.col("value")).startswith("{")).first()
    if bad is None:
        return
    whole = spark.read.text(bad["file"], wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    place = whole.where(F.col("line") == bad["value"]).agg(F.min("n")).first()[0]
    raise BadRow(f"{bad['file']}:{(place or 0) + 1}: not a JSON object")


def page_number(c: Column, least: int | None = 1) -> Column:
    """The whole number that a string spells, or null; below ``least`` null too."""
    text = strip(c.cast("string"))
    n = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    return n if least is None else F.when(n >= least, n)


def whole_number(c: Column, least: int | None = 1) -> Column:
    """A number without its fraction; null below ``least``."""
    n = c.try_cast("int")
    return n if least is None else F.when(n >= least, n)


def sorted_pages(a: Column, least: int | None = 1) -> Column:
    """Distinct tolerant page numbers, ascending."""
    return F.array_sort(F.array_distinct(page_numbers(a, least)))


def sorted_blocks(a: Column) -> Column:
    """Distinct block ids that aren't blank, ascending."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(a, strip), lambda x: F.coalesce(x != "", F.lit(False)))))


def page_numbers(a: Column, least: int | None = 1) -> Column:
    """Tolerant whole numbers in order, without those that fail."""
    return F.filter(F.transform(a, lambda x: page_number(x, least)), lambda x: x.isNotNull())


def document_store(spark: SparkSession, path: str, min_page_id: int | None = None) -> DataFrame:
    """Pages of per-document JSON files: document_id, page_id, width, height, page_text, blocks. A broken file is an error."""
    return document_pages(spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path), min_page_id)


def document_pages(docs: DataFrame, min_page_id: int | None = None) -> DataFrame:
    """Pages of parsed documents; those without a page number go."""
    pages = docs.select("document_id", F.explode_outer("pages").alias("p"))
    rows = pages.select("document_id", page_number(F.col("p.page_id"), min_page_id).alias("page_id"), F.col("p.width").alias("width"), F.col("p.height").alias("height"), F.coalesce("p.page_text", F.lit("")).alias("page_text"), F.col("p.blocks").alias("blocks"))
    return rows.where(F.col("page_id").isNotNull())


def store_blocks(pages: DataFrame) -> DataFrame:
    """One row per block: geometry null where degenerate, order from the file where not given."""
    rows = pages.select("document_id", "page_id", "width", "height", F.posexplode("blocks").alias("pos", "b"))
    box = F.when((F.size("b.bbox") == 4) & (F.col("b.bbox")[2] > F.col("b.bbox")[0]) & (F.col("b.bbox")[3] > F.col("b.bbox")[1]), F.col("b.bbox"))
    return rows.select(
        "document_id", "page_id", "width", "height", strip(F.col("b.block_id")).alias("block_id"), F.coalesce("b.type", F.lit("")).alias("type"), box.alias("bbox"),
        F.coalesce("b.text", F.lit("")).alias("text"), F.coalesce("b.order_index", "pos").alias("order_index"),
    ).where("block_id <> ''")


def ranked_pages(rows: DataFrame, dedup: bool = True, kept: list[str] | None = None) -> DataFrame:
    """(sample_id, ranked): the first non-empty of the ranking columns, else scores by (-score, page). Columns ``kept`` stay, ids as they are."""
    by_score = F.transform(
        F.array_sort(F.transform("scores", lambda s: F.struct((-s.score).alias("neg"), page_number(s.page_id).alias("page"))), None), lambda s: s.page
    )
    given = [page_numbers(F.col(c)) for c in ("ranked_page_ids", "selected_page_ids", "page_ids", "top_page_ids")]
    options = [*given, F.filter(by_score, lambda p: p.isNotNull())]
    ranked = F.coalesce(*[F.when(F.size(o) > 0, o) for o in options], F.array().cast("array<int>"))
    ids = ["sample_id", "id", *kept] if kept is not None else [F.coalesce("sample_id", "id").alias("sample_id")]
    return rows.select(*ids, (F.array_distinct(ranked) if dedup else ranked).alias("ranked"))


def external_ranked(rows: DataFrame) -> DataFrame:
    """(sample_id, ranked) by ``ranked_page_ids`` in their order, else by scores, highest first, then page; any whole number is a page."""
    scored = F.filter(F.transform("scores", lambda s: F.struct((-s.score).alias("neg"), page_number(s.page_id, None).alias("page"))), lambda s: s.neg.isNotNull() & s.page.isNotNull())
    given, by_score = F.array_distinct(page_numbers(F.col("ranked_page_ids"), None)), F.transform(F.array_sort(scored), lambda s: s.page)
    ranked = F.when(F.size(given) > 0, given).otherwise(F.coalesce(by_score, F.array().cast("array<int>")))
    return rows.withColumn("ranked", ranked)


def _in_file_order(rows: DataFrame) -> DataFrame:
    """``rows`` of a reader with ``ordinal``, which sorts as the rows lie in their file."""
    return rows.withColumn("ordinal", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.lit(0).alias("item")))


def _named_sample(rows: DataFrame) -> DataFrame:
    named = F.coalesce(F.nullif(F.col("sample_id"), F.lit("")), F.col("id"))
    return rows.withColumn("sample_id", strip(named)).where("sample_id <> '' AND size(ranked) > 0")


def external_rankings(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, ranked) of another system's file: JSON lines, a JSON list, or an object with ``predictions``.

    Of a repeated sample the last row that ranks a page stays; rows without an id or
    a page go, wherever they stand.
    """
    if path.rstrip("/").endswith((".jsonl", ".jsonl.gz")):
        rows = _in_file_order(json_lines(spark, path, RANKING))
    else:
        one = StructType.fromDDL(RANKING)
        both = StructType([*one.fields]).add("predictions", ArrayType(one))
        held = _in_file_order(spark.read.schema(both).option("multiLine", True).option("mode", "FAILFAST").json(path))
        plain = held.where("predictions IS NULL").drop("predictions")
        listed = held.where("predictions IS NOT NULL").select("ordinal", F.posexplode("predictions").alias("pos", "p"))
        rows = plain.unionByName(listed.select("p.*", F.col("ordinal").withField("item", F.col("pos")).alias("ordinal")))
    found = _named_sample(external_ranked(rows))
    return found.groupBy("sample_id").agg(F.max_by("ranked", "ordinal").alias("ranked"))


def rankings(spark: SparkSession, paths: list[str], k: int | None = None) -> DataFrame:
    """Union of ranking files, cut to k: of a repeated sample the last file's last row that ranks a page stays. A broken line is an error."""
    parts = [_in_file_order(json_lines(spark, p, RANKING)).withColumn("file", F.lit(i)) for i, p in enumerate(paths)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    kept = [c for c in rows.columns if c not in ("sample_id", "id")]
    found = _named_sample(ranked_pages(rows, kept=kept))
    out = found.groupBy("sample_id").agg(F.max_by("ranked", F.struct("file", "ordinal")).alias("ranked"))
    return out if k is None else out.withColumn("ranked", F.slice("ranked", 1, max(1, k)))


def literal_list(c: Column) -> Column:
    """A list written as a literal (single or double quotes) as array<string>; empty where it isn't one."""
    body = F.regexp_extract(F.trim(c), r"^\[(.*)\]$", 1)
    items = F.regexp_extract_all(body, F.lit(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([^,\s'\"]+)"), F.lit(0))
    bare = F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(x, r"^['\"]|['\"]$", ""), r"\\(.)", "$1"))
    return F.coalesce(bare, F.array().cast("array<string>"))


def benchmark_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated benchmark rows with list columns parsed."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("maxCharsPerColumn", -1).csv(path)
    return rows.select("index", "question", "doc_id", "doc_type", "answer_format", literal_list(F.col("evidence_sources")).alias("evidence_sources"), F.size(literal_list(F.col("image_path"))).alias("doc_pages"))


def manifest_documents(rows: DataFrame) -> DataFrame:
    """(document_id, page_id, image_path) of all manifests' pages; of a repeated page the first path stays.

    rows: document_id, ordinal, image_paths. Pages are numbered by their file
    names, else by their place.
    """
    pages = rows.select("document_id", "ordinal", F.posexplode("image_paths").alias("pos", "path"))
    numbered = pages.withColumn("page_id", F.coalesce(image_page(F.col("path")), F.col("pos") + 1))
    first = numbered.groupBy("document_id", "page_id").agg(F.min_by("path", F.struct("ordinal", "pos")).alias("image_path"))
    return first.where("document_id <> ''")


def pages_present(pages: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose image is in ``folder``; the listing alone is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return pages.withColumn("file", F.element_at(F.split("image_path", "/"), -1)).join(listed.distinct(), "file", "left_semi").drop("file")


def evidence_of(manifests: dict[str, DataFrame]) -> DataFrame:
    """(task, sample_id, page_id, block_id, text_excerpt): every task's evidence, one row a piece."""
    out = None
    for task, rows in manifests.items():
        e = rows.select(F.lit(task).alias("task"), "sample_id", F.explode("evidence").alias("e")).select("task", "sample_id", "e.page_id", "e.block_id", "e.text_excerpt")
        out = e if out is None else out.unionByName(e)
    return out


def judged(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Rows with ``correct``; a row without a verdict, or with an error, is refused, or null where not strict."""
    from folioscope.operators.sets import expect

    known = F.col("judge.verdict").isin("correct", "partial", "incorrect")
    if strict:
        expect(rows, unjudged=~F.coalesce(known, F.lit(False)))
    return rows.withColumn("correct", F.when(known, F.col("judge.verdict") == "correct"))


def page_layouts(pages: DataFrame) -> DataFrame:
    """(document_id, page_id, width, height, ordered): block ids of a page in reading order."""
    blocks = store_blocks(pages)
    ordered = blocks.groupBy("document_id", "page_id", "width", "height").agg(F.array_sort(F.collect_list(F.struct("order_index", "block_id"))).alias("o"))
    return ordered.select("document_id", "page_id", "width", "height", F.transform("o", lambda x: x.block_id).alias("ordered"))


def document_bundle(pages: DataFrame) -> DataFrame:
    """(document_id, block_id, page_id, text, page_text): texts in their quote form, found by block."""
    from folioscope.functions.text import normalize_quote

    texts = pages.select("document_id", "page_id", normalize_quote(F.col("page_text")).alias("page_text"))
    blocks = store_blocks(pages).select("document_id", "page_id", "block_id", normalize_quote(F.col("text")).alias("text"))
    return blocks.join(texts, ["document_id", "page_id"])


def page_range(sample_id: Column) -> Column:
    """Pages of a ``:a-b`` suffix; null without one or where b < a."""
    a = F.nullif(F.regexp_extract(sample_id, r":(\d+)-(\d+)$", 1), F.lit("")).cast("int")
    b = F.nullif(F.regexp_extract(sample_id, r":(\d+)-(\d+)$", 2), F.lit("")).cast("int")
    return F.when(b >= a, F.sequence(a, b))


def image_page(path: Column) -> Column:
    """Page number of ``page_0012.png`` or ``..._12.jpg`` (jpeg, png), in letters of either case; other files have none."""
    return F.nullif(F.regexp_extract(path, r"(?i)_(\d+)\.(?:jpg|jpeg|png)$", 1), F.lit("")).cast("int")


def page_and_block(name: Column) -> Column:
    """struct(page, block) of ``p12_b3``; nulls where it has another form."""
    part = lambda i: F.nullif(F.regexp_extract(name, r"^p(\d+)_(.+)$", i), F.lit(""))
    return F.struct(part(1).cast("int").alias("page"), part(2).alias("block"))


def markdown_tables(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the tables of markdown files: file, table, row, cells (header -> cell).

    A repeated header gets a numbered suffix. A file is a report, so its lines
    meet in one row.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("lines"))
    lines = files.select("file", F.posexplode("lines").alias("n", "line")).where(F.trim("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    own = Window.partitionBy("file").orderBy("n")
    marked = lines.select("file", "n", cells.alias("cells"), F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$").alias("rule"))
    marked = marked.withColumn("table", F.col("n") - F.row_number().over(own))
    within = Window.partitionBy("file", "table").orderBy("n")
    rows = marked.withColumn("header", F.first("cells").over(within)).withColumn("row", F.row_number().over(within) - 3).where(~F.col("rule")).where("row >= 0")
    named = F.transform("header", lambda h, i: F.when(F.size(F.filter(F.slice("header", F.lit(1), i), lambda x: x == h)) > 0, F.concat(h, F.lit("_"), (F.size(F.filter(F.slice("header", F.lit(1), i), lambda x: x == h)) + 1).cast("string"))).otherwise(h))
    return rows.select("file", F.dense_rank().over(Window.partitionBy("file").orderBy("table")).alias("table"), "row", F.map_from_arrays(named, F.slice("cells", F.lit(1), F.size("header"))).alias("cells"))


def numbers(cell: Column) -> Column:
    """All numbers in a cell, the typographic minus included."""
    plain = F.replace(cell, F.lit("−"), F.lit("-"))
    return F.transform(F.regexp_extract_all(plain, F.lit(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"), F.lit(0)), lambda x: x.cast("double"))


TRAINING = """id string, question string, answer string, images array<string>, input_page_ids array<string>, document_id string,
  evidence array<struct<page_id: int, block_id: string, text_excerpt: string>>, benchmark string"""


def training_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples with an answer and an image; page ids default to the images' places."""
    rows = json_lines(spark, path, TRAINING)
    given = page_numbers(F.col("input_page_ids"))
    places = F.sequence(F.lit(1), F.size("images"))
    usable = rows.where((F.coalesce(strip(F.col("answer")), F.lit("")) != "") & (F.size("images") > 0))
    return usable.withColumn("input_page_ids", F.when(F.size(given) == F.size("images"), given).otherwise(places))


def latest_predictions(spark: SparkSession, path: str, schema: str, exists: bool) -> DataFrame:
    """Judged rows by id, of a repeated id the last; a missing file has no rows."""
    if not exists:
        return spark.createDataFrame([], schema)
    rows = json_lines(spark, path, schema).withColumn("_at", F.monotonically_increasing_id())
    last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "_at")]), "_at").alias("r"))
    return last.select("id", "r.*")
