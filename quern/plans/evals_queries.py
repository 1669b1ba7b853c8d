"""Evaluation metrics: a labelled document is a case; its quality and toxicity stand for what was found, cited and judged."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import evals
from quern.operators.search import few
from quern.plans.tables import spread, table

_REF = "struct<celex:string,article:string,paragraph:string,point:string,annex:string,content_hashes:array<string>>"


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases with targets 1 .. id % 3, states whose hits and sources hold some of them, judgements of two thirds."""
    lab = table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    none = F.lit(None).cast("string")

    def items(first, last, article):
        return F.when(last >= first, F.transform(F.sequence(F.lit(first), F.greatest(last, F.lit(first))).cast("array<int>"), article)).otherwise(F.array())

    target = lambda i: F.struct(F.lit("c").alias("celex"), F.concat(F.lit("A"), i.cast("string")).alias("article"), none.alias("paragraph"), none.alias("point"), none.alias("annex"), F.array().cast("array<string>").alias("content_hashes"))
    hit = lambda i: F.struct(F.lit("c").alias("celex"), F.concat(F.lit("a"), i.cast("string")).alias("article"), none.alias("annex"), F.repeat(F.lit("x"), i).alias("text"), (i % 2 == 1).alias("corpus"))
    cases = lab.select(k.alias("case_id"), F.when(F.col("toxic") == 0, "in_corpus").otherwise("out_of_corpus").alias("kind"), items(1, (k % 3).cast("int"), target).alias("targets"))
    step = lambda name, ms: F.struct(F.lit(name).alias("step"), ms.alias("ms"), F.lit(1).cast("long").alias("input_tokens"), F.lit(2).cast("long").alias("output_tokens"), F.lit(0.5).alias("cost_usd"))
    steps = F.when(k % 5 == 0, F.array()).when(k % 4 == 0, F.array(step("retrieve", k % 90), step("assess", k % 50))).otherwise(F.array(step("retrieve", k % 90)))
    states = lab.select(
        k.alias("case_id"), items(2, (k % 4).cast("int"), hit).alias("hits"), items(1, (k % 5).cast("int"), hit).alias("sources"), steps.alias("steps"), F.when(k % 7 != 0, F.concat(F.lit("As the context says [1] and ["), (k % 6).cast("string"), F.lit("]."))).alias("answer"),
        F.when(k % 11 == 0, "nothing_retrieved").when(k % 13 == 0, "insufficient_context").alias("refusal"), F.when(k % 17 == 0, "boom").alias("error"), F.when(k % 19 == 0, "aborted").when(k % 11 == 0, "refused").otherwise("done").alias("outcome"), (k % 1000).alias("total_ms"),
    )
    judged = lab.where("doc_id % 3 <> 0").select(k.alias("case_id"), F.when(F.col("quality") == 1, "pass").when(k % 2 == 0, "fail").otherwise("cannot_judge").alias("correctness"), items(1, (k % 4).cast("int"), lambda i: F.struct((i % 2 == 0).alias("supported"))).alias("claims"), F.when(F.col("toxic") == 1, F.lit("declined")).alias("refused"))
    return cases, states, judged


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, states, judged = _inputs(spark, sf_dir)
    found = evals.metrics(evals.results(cases, states, judged))
    return found.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes))


def _articles(first: str, last: str) -> str:
    return f"range({first}, ({last}) + 1)"


METRICS = f"""WITH l AS (SELECT doc_id AS k, toxic, quality, {_articles('1', 'doc_id % 3')} AS t, {_articles('2', 'doc_id % 4')} AS h, {_articles('1', 'doc_id % 5')} AS s, CASE WHEN doc_id % 7 <> 0 THEN list_distinct([1, doc_id % 6]) ELSE [] END AS m FROM labels),
    r AS (SELECT *, toxic = 0 AS inc, k % 17 <> 0 AS scored, CASE WHEN k % 19 = 0 THEN 'aborted' WHEN k % 11 = 0 THEN 'refused' ELSE 'done' END AS outcome,
      CASE WHEN len(t) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(t, h))::DOUBLE / len(t) END AS raw, CASE WHEN len(t) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(list_intersect(t, s), lambda x: x % 2 = 1))::DOUBLE / len(t) END AS exp,
      CASE WHEN k % 19 = 0 THEN len(s) = 0 ELSE k % 11 = 0 END AS gate, k % 11 <> 0 AND k % 13 = 0 AS assess, k % 5 <> 0 AS searched,
      list_filter(m, lambda x: x >= 1 AND x <= len(s)) AS ok, CASE WHEN k % 3 <> 0 THEN true ELSE false END AS judged FROM l),
    q AS (SELECT *, CASE WHEN len(t) > 0 THEN len(list_filter(list_intersect(t, ok), lambda x: x % 2 = 1))::DOUBLE / len(t) END AS cited, CASE WHEN len(m) > 0 THEN len(ok)::DOUBLE / len(m) END AS valid FROM r)
    SELECT count(*) AS cases, count(*) FILTER (inc) AS in_corpus, count(*) FILTER (NOT inc) AS out_of_corpus, count(*) FILTER (NOT scored) AS errors,
      round(avg((raw > 0)::INT) FILTER (scored AND inc AND len(t) > 0), 6) AS raw_hit_rate, round(avg(raw) FILTER (scored AND inc AND len(t) > 0), 6) AS raw_recall,
      round(avg((exp > 0)::INT) FILTER (scored AND inc AND len(t) > 0), 6) AS expanded_hit_rate, round(avg(exp) FILTER (scored AND inc AND len(t) > 0), 6) AS expanded_recall,
      round(avg(len(s)) FILTER (scored AND inc), 6) AS mean_context_chunks, round(avg(coalesce(list_sum(s), 0)) FILTER (scored AND inc), 6) AS mean_context_chars,
      round(avg(gate::INT) FILTER (scored AND NOT inc AND searched), 6) AS gate_refusal_rate, count(*) FILTER (scored AND inc AND gate) AS false_refusals, count(*) FILTER (scored AND inc AND gate AND raw > 0) AS refused_a_found_reference,
      round(avg(assess::INT) FILTER (scored AND NOT inc AND searched), 6) AS assess_refusal_rate, count(*) FILTER (scored AND inc AND assess) AS assess_false_refusals,
      round(avg(cited) FILTER (scored AND inc AND outcome = 'done'), 6) AS cited_references, round(avg(valid) FILTER (scored), 6) AS markers_in_context,
      count(*) FILTER (scored AND k % 7 <> 0) AS prompt_wording, CAST(round_even(avg(7) FILTER (scored AND k % 7 <> 0), 0) AS BIGINT) AS mean_words,
      count(*) FILTER (scored AND judged) AS judged, round(avg(CASE WHEN quality = 1 THEN 1 WHEN k % 2 = 0 THEN 0 END) FILTER (scored AND judged), 6) AS correctness,
      round(avg(CASE WHEN k % 4 > 0 THEN ((k % 4) // 2)::DOUBLE / (k % 4) END) FILTER (scored AND judged), 6) AS faithfulness, round(avg(CASE WHEN toxic = 1 THEN 1 END) FILTER (scored AND judged), 6) AS model_refusal_rate,
      CAST(coalesce(floor(avg(k % 1000) FILTER (scored)), 0) AS BIGINT) AS mean_total_ms FROM q"""


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, states, _ = _inputs(spark, sf_dir)
    return evals.step_latency(evals.results(cases, states))


LATENCY = """WITH s AS (SELECT 'retrieve' AS step, doc_id, doc_id % 90 AS ms FROM labels UNION ALL SELECT 'assess', doc_id, doc_id % 50 FROM labels WHERE doc_id % 4 = 0)
    SELECT step, CAST(floor(avg(ms)) AS BIGINT) AS mean_ms FROM s WHERE doc_id % 17 <> 0 AND doc_id % 5 <> 0 GROUP BY step"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, states, _ = _inputs(spark, sf_dir)
    return evals.run_usage(evals.results(cases, states))


USAGE = """WITH s AS (SELECT CAST(sum(CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM labels WHERE doc_id % 17 <> 0 AND doc_id % 5 <> 0)
    SELECT n AS input_tokens, 2 * n AS output_tokens, 0.5::DOUBLE * n AS cost_usd FROM s"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.judge_coverage(evals.results(*_inputs(spark, sf_dir))).withColumn("coverage", F.round("coverage", 6))


COVERAGE = """WITH c AS (SELECT count(*) FILTER (doc_id % 17 <> 0 AND doc_id % 19 <> 0 AND doc_id % 11 <> 0) AS judgeable, count(*) FILTER (doc_id % 17 <> 0 AND doc_id % 3 <> 0) AS judged FROM labels)
    SELECT judgeable, judged, round(judged::DOUBLE / judgeable, 6) AS coverage, judged < 0.9 * judgeable AS too_few, judged = 0 AS never_answered FROM c"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a run of eight words with each benchmark item, by an equi-join of shingles."""

    def shingles(df: DataFrame, key: str) -> DataFrame:
        """Runs of eight words as two hashes, 96 bits in all; a run that comes back is there again."""
        words = df.select(key, F.split(F.regexp_replace("text", "\n", " "), " ").alias("w")).where("size(w) >= 8")
        run = lambda i: F.slice("w", i, 8)
        return words.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.struct(F.xxhash64(run(i)).alias("a"), F.hash(run(i)).alias("b")))).alias("s")).select(key, "s.*")

    asked = few(shingles(table(spark, sf_dir, "benchmark"), "item_id").distinct())
    found = shingles(spread(table(spark, sf_dir, "documents")), "doc_id").join(asked, ["a", "b"]).withColumn("shingle", F.struct("a", "b"))
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("shingle").alias("shingles"))


PASSAGES = """WITH d AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents), b AS (SELECT item_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM benchmark),
    ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)), bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b))
    SELECT item_id, count(DISTINCT doc_id) AS documents, count(DISTINCT s) AS shingles FROM ds JOIN bs USING (s) GROUP BY item_id"""


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, states, judged = _inputs(spark, sf_dir)
    r = evals.results(cases, states, judged)
    # measures as they are reported, at six digits
    measured = (evals.metrics(x) for x in (r, r.where("case_id % 2 = 0")))
    base, other = (evals.flattened(m.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes))) for m in measured)
    return evals.compared(base, other).select("metric", F.round("delta", 6).alias("delta"))


_COMPARED = METRICS[METRICS.rindex("SELECT count(*) AS cases") :]
_NAMES = re.findall(r"AS (\w+)(?:,|\s+FROM q)", _COMPARED)
COMPARED = METRICS.replace(_COMPARED, "") + f""", a AS ({_COMPARED}), b AS ({_COMPARED.replace("FROM q", "FROM q WHERE k % 2 = 0")})
    SELECT metric, round(delta, 6) AS delta FROM ({" UNION ALL ".join(f"SELECT '{n}' AS metric, CAST(b.{n} AS DOUBLE) - CAST(a.{n} AS DOUBLE) AS delta FROM a, b" for n in _NAMES)})"""


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of the cases, which stamps don't change."""
    cases = table(spark, sf_dir, "labels").selectExpr("string(doc_id) AS case_id", "IF(toxic = 0, 'in_corpus', 'out_of_corpus') AS kind", "array(named_struct('celex', concat('c', doc_id), 'content_hashes', array('h'))) AS targets", "cast(array() AS array<string>) AS traits")
    return evals.dataset_hash(cases)


DATASET = """WITH l AS (SELECT '{"case_id":"' || doc_id || '","kind":"' || CASE WHEN toxic = 0 THEN 'in_corpus' ELSE 'out_of_corpus' END || '","targets":[{"celex":"c' || doc_id || '"}]}' AS line FROM labels)
    SELECT sha256('[' || string_agg(line, ', ' ORDER BY line) || ']') AS sha256 FROM l"""


QUERIES = {"eval_metrics": metrics, "eval_latency": latency, "eval_usage": usage, "judge_coverage": coverage, "benchmark_passages": passages, "run_comparison": compared, "dataset_hash": dataset}
ORACLES = {"eval_metrics": METRICS, "eval_latency": LATENCY, "eval_usage": USAGE, "judge_coverage": COVERAGE, "benchmark_passages": PASSAGES, "run_comparison": COMPARED, "dataset_hash": DATASET}
