"""Text functions, identifiers and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import identifiers as ids
from quern.functions import text, vectors
from quern.operators.chunking import split_column
from quern.plans.tables import spread, table

YEAR = 2026


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation pairs of all sorts from order keys."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("Regulation", "directive", "Decision"))), (k % 3 + 1).cast("int"))
    first = F.when(k % 4 == 0, (F.lit(1950) + k % 90).cast("string")).when(k % 4 == 1, (k % 100).cast("string")).otherwise((k % 3000).cast("string"))
    return o.select("o_orderkey", kind.alias("kind"), first.alias("first"), (F.lit(1900) + (k * 7) % 140).cast("string").alias("second"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).withColumn("ny", ids.number_and_year(F.col("kind"), F.col("first"), F.col("second"), YEAR))
    built = p.select("o_orderkey", F.col("ny.number").alias("number"), F.col("ny.year").alias("year"), ids.build(F.col("kind"), F.col("ny.year"), F.col("ny.number"), YEAR).alias("celex"))
    return built.select("*", ids.act_name(F.col("celex"), F.lit(None).cast("string")).alias("name"), ids.consolidated_stem(F.col("celex")).alias("stem"), ids.page_url(F.col("celex")).alias("url"), ids.is_legislation(F.col("celex")).alias("legislation"))


_YEAR = "CASE WHEN regexp_full_match(CASE WHEN length({x}) = 2 THEN '19' || {x} ELSE {x} END, '(19|20)[0-9]{{2}}') AND CAST(CASE WHEN length({x}) = 2 THEN '19' || {x} ELSE {x} END AS INTEGER) <= 2026 THEN CAST(CASE WHEN length({x}) = 2 THEN '19' || {x} ELSE {x} END AS INTEGER) END"
IDENTIFIERS = f"""WITH p AS (SELECT o_orderkey, ['Regulation', 'directive', 'Decision'][o_orderkey % 3 + 1] AS kind,
      CASE o_orderkey % 4 WHEN 0 THEN CAST(1950 + o_orderkey % 90 AS VARCHAR) WHEN 1 THEN CAST(o_orderkey % 100 AS VARCHAR) ELSE CAST(o_orderkey % 3000 AS VARCHAR) END AS first,
      CAST(1900 + (o_orderkey * 7) % 140 AS VARCHAR) AS second FROM orders),
    y AS (SELECT *, {_YEAR.format(x="first")} AS a, {_YEAR.format(x="second")} AS b FROM p),
    n AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN lower(kind) IN ('directive', 'decision') OR a >= 2015 ELSE b IS NULL END AS yf FROM y),
    m AS (SELECT *, CASE WHEN yf THEN second ELSE first END AS number, CASE WHEN yf THEN first ELSE second END AS year FROM n),
    c AS (SELECT *, '3' || CASE WHEN length(year) = 2 THEN '19' || year ELSE year END || CASE lower(kind) WHEN 'regulation' THEN 'R' WHEN 'directive' THEN 'L' ELSE 'D' END || CASE WHEN length(number) < 4 THEN lpad(number, 4, '0') ELSE number END AS made,
          {_YEAR.format(x="year")} AS yy FROM m),
    d AS (SELECT *, CASE WHEN yy IS NOT NULL AND regexp_full_match(made, '3[0-9]{{4}}[RLD][0-9]{{4}}') THEN made END AS celex FROM c)
    SELECT o_orderkey, number, year, celex, CASE WHEN celex IS NULL THEN NULL WHEN CAST(celex[2:5] AS INTEGER) >= 2015 THEN CASE celex[6] WHEN 'R' THEN 'Regulation' WHEN 'L' THEN 'Directive' ELSE 'Decision' END || ' (EU) ' || celex[2:5] || '/' || CAST(CAST(celex[7:] AS INTEGER) AS VARCHAR) ELSE celex END AS name,
           '0' || celex[2:] || '-' AS stem, '{ids.PAGE}' || celex AS url, celex IS NOT NULL AS legislation FROM d"""


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    marked = c.select("conv_id", "turn", F.concat("text", F.lit(" [2] and [1][2] ["), "turn", F.lit("].")).alias("t"))
    return marked.select("conv_id", "turn", F.array_join(text.marker_numbers("t").cast("array<string>"), ",").alias("markers"), F.length(text.without_markers("t")).alias("chars"))


MARKERS = r"""WITH m AS (SELECT conv_id, turn, text || ' [2] and [1][2] [' || CAST(turn AS VARCHAR) || '].' AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn IN (1, 2) THEN '2,1' ELSE '2,1,' || CAST(turn AS VARCHAR) END AS markers, CAST(length(regexp_replace(t, '\s*\[\d+\]', '', 'g')) AS INTEGER) AS chars FROM m"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.length(text.without_scripts("html")).alias("bare"), text.holds_drawn_formulas("html").alias("drawn"), F.md5(F.translate(text.clean_text(F.regexp_replace("html", "<[^>]*>", " ")), " ", " ")).alias("md5"))


CLEANED = r"""SELECT page_id, CAST(length(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g')) AS INTEGER) AS bare, contains(html, 'src="data:image') AS drawn,
    md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s*\(\s*\)', '', 'g'), '\s+', ' ', 'g'))) AS md5 FROM pages"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha"), F.concat_ws("/", "source", "lang", F.concat(F.sha2("text", 256), F.lit(".html"))).alias("key"))


HASHES = "SELECT doc_id, sha256(text) AS sha, source || '/' || lang || '/' || sha256(text) || '.html' AS key FROM documents"


def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, every hundredth vector, against all vectors of its label."""
    e = table(spark, sf_dir, "embeddings")
    a = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), "label")
    b = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"), "label")
    return vectors.cosines(a, b, "label").select("a", "b", F.round("cosine", 5).alias("cosine"))


EMBEDDING_COSINE = """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0"""


def chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split to pieces of at most 2000 characters; held by golden tests."""
    return split_column(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "part", "parts", F.length("piece").alias("chars"), F.md5("piece").alias("md5"))


def listed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part")
    lines = d.select("p_partkey", F.concat(F.lit("Intro (x) here\n("), (F.col("p_size") % 10).cast("string"), F.lit(") one\n(b) two\nno (c) three")).alias("t"))
    return lines.select("p_partkey", F.array_join(text.listed_points("t"), ",").alias("points"))


LISTED_POINTS = "SELECT p_partkey, CAST(p_size % 10 AS VARCHAR) || ',b' AS points FROM part"


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", text.markdown_table(F.concat("n_name", F.lit(" | key\nrow | "), F.col("n_regionkey").cast("string"))).alias("markdown"))


TABLES = "SELECT n_nationkey, '| ' || n_name || ' | key |' || chr(10) || '| --- | --- |' || chr(10) || '| row | ' || CAST(n_regionkey AS VARCHAR) || ' |' AS markdown FROM nation"

QUERIES = {"identifiers": identifiers, "citation_markers": markers, "cleaned_pages": cleaned, "content_keys": hashes, "embedding_cosine": embedding_cosine, "chunk_pieces": chunk_pieces, "listed_points": listed_points, "markdown_tables": tables}
ORACLES = {"identifiers": IDENTIFIERS, "citation_markers": MARKERS, "cleaned_pages": CLEANED, "content_keys": HASHES, "embedding_cosine": EMBEDDING_COSINE, "listed_points": LISTED_POINTS, "markdown_tables": TABLES}
