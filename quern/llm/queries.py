"""The queries opN_<name>: each operator over its whole table, with production parameters, as the contracts word the columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import align, bpe, chat, collocations, embeddings, html, masked_lm, packing, quality, simhash, substring, toxicity, warc
from quern.llm.common import read

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(read(spark, sf_dir, "conversations"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encode(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(tokens, RANKS, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return back.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(read(spark, sf_dir, "documents"))


def op5_min_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_pages(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), WORD_BPE, size=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_itq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate(read(spark, sf_dir, "documents"), PIECE_BPE)
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy")


def op9_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "language")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(read(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(read(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(spark, warc.archive(read(spark, sf_dir, "pages")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_tool_calls": op1_chat_tool_calls,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_simhash": op3_simhash,
    "op4_collinear_chaining": op4_collinear_chaining,
    "op5_min_cut_extraction": op5_min_cut_extraction,
    "op6_sum_of_squares_packing": op6_sum_of_squares_packing,
    "op9_masked_pseudo_likelihood": op9_masked_pseudo_likelihood,
    "op10_toxicity": op10_toxicity,
    "op7_itq_embeddings": op7_itq_embeddings,
    "op8_tokeniser_fertility": op8_tokeniser_fertility,
    "op11_collocations": op11_collocations,
    "op12_alignment": op12_alignment,
    "op13_warc": op13_warc,
}

ORACLES: dict[str, str] = {
    "op1_chat_tool_calls": """
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role, 0::BIGINT AS n_calls, 0::BIGINT AS n_invalid,
               NULL::BOOLEAN AS linked, false AS cyclic, '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' AS message
        FROM conversations""",  # the tables hold no tool calls; tests do
    "op11_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
             runs AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest(range(1, 5)) AS m FROM w))),
             f AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL),
             n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
             c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
             k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
             s AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, (2000000::HUGEINT * k.a // (l.f::HUGEINT + r.f))::BIGINT AS score
                   FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ')),
             lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
             parts AS (SELECT lang, a, array_to_string(w[i:i + q - 1], ' ') AS part FROM (SELECT *, unnest(range(1, m - q + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS q FROM c))),
             gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN parts p ON p.lang = c.lang AND p.part = c.phrase WHERE 100::HUGEINT * p.a >= 80::HUGEINT * c.a),
             ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM lowest ANTI JOIN gone USING (lang, phrase))
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p),
             r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM q)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r""",
}
