"""Scores of retrieval and answers over evaluated cases. What wasn't measured is null, never zero, unless said so.

Inputs: cases (case_id, kind, traits, question, answer, targets), one row a case, with targets
array<struct<celex, article, paragraph, point, annex, content_hashes>>; states (case_id, hits, sources, steps, answer,
refusal, error, outcome, total_ms) with hits and sources array<struct<celex, article, annex, text, corpus>> and steps
array<struct<step, ms, input_tokens, output_tokens, cost_usd>>; judgements (case_id, correctness, claims, refused).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text
from quern.functions.bind import bound
from quern.operators import corpus
from quern.operators.context import division_hashes

#: Fixed value: words by which an answer gives away how it was prompted.
PROMPT_WORDING = (
    r"(?i)\b(?:the|this|provided|given|retrieved|available) context\b(?! of\b)"
    r"|\bcontext (?:provided|given|blocks?)\b"
    r"|\b(?:the|provided|numbered|retrieved) blocks\b|\bblocks (?:provided|shown)\b"
    r"|\b(?:provided|numbered|given) (?:passages|excerpts)\b|\bpassages (?:provided|shown)\b"
    r"|\b(?:provided|given) texts?\b|\btexts? provided\b"
)
TOO_FEW_JUDGED = 0.9


def division(item: Column) -> Column:
    """The act and division of a target or chunk as one key: articles in lower case, annexes as they are, nulls told from ''."""
    return F.to_json(F.struct(item["celex"].alias("c"), F.lower(item["article"]).alias("a"), item["annex"].alias("x")), {"ignoreNullFields": "false"})


def _divisions(items: Column) -> Column:
    return F.transform(F.coalesce(items, F.array()), division)


def share_found(targets: Column, items: Column) -> Column:
    """Share of the targets, repeats counted, whose division is among the items'; null without targets."""
    found = bound(_divisions(items), lambda have: F.filter(_divisions(targets), lambda d: F.array_contains(have, d)))
    return F.when(F.size(targets) > 0, F.size(found) / F.size(targets))


def recall(targets: Column, items: Column) -> Column:
    """The same, but zero without targets."""
    return F.coalesce(share_found(targets, items), F.lit(0.0))


def cited_sources(answer: Column, sources: Column) -> Column:
    """The sources that an answer's markers name, in order of first use; markers beyond the sources name none."""
    valid = F.filter(text.marker_numbers(F.coalesce(answer, F.lit(""))), lambda n: (n >= 1) & (n <= F.size(sources)))
    return F.transform(valid, lambda n: F.element_at(sources, n))


def citation_validity(answer: Column, sources: Column) -> Column:
    markers = text.marker_numbers(F.coalesce(answer, F.lit("")))
    return F.when(F.size(markers) > 0, F.size(cited_sources(answer, sources)) / F.size(markers))


def citation_rate(answer: Column, sources: Column, targets: Column) -> Column:
    """Share of a case's targets that its answer cites; null without targets. Only chunks of the corpus count."""
    return share_found(targets, F.filter(cited_sources(answer, sources), lambda s: F.coalesce(s["corpus"], F.lit(False))))


def prompt_wording(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(PROMPT_WORDING), F.lit(0))


def selected(cases: DataFrame, ids: str | None = None, traits: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """Cases whose id contains a text, that have one of the traits, and are of a kind: all that are asked for."""
    found = cases if ids is None else cases.where(F.col("case_id").contains(ids))
    found = found if not traits else found.where(F.arrays_overlap("traits", F.array(*map(F.lit, traits))))
    return found if kind is None else found.where(F.col("kind") == kind)


def results(cases: DataFrame, states: DataFrame, judgements: DataFrame | None = None) -> DataFrame:
    """A wide row a case with every per-case score; the population flags are columns."""
    r = cases.select("case_id", "kind", "targets").join(states, "case_id")
    scored = F.col("error").isNull()
    inside, outside = scored & (F.col("kind") == "in_corpus"), scored & (F.col("kind") == "out_of_corpus")
    searched = F.exists("steps", lambda s: s["step"] == "retrieve")
    gate = F.when(F.col("outcome") == "aborted", F.size("sources") == 0).otherwise(F.coalesce(F.col("refusal") == "nothing_retrieved", F.lit(False)))
    r = r.withColumns({
        "scored": scored, "inside": inside, "outside": outside, "searched_outside": outside & searched, "referenced": inside & (F.size("targets") > 0), "answered": inside & (F.col("outcome") == "done"),
        "raw_recall": recall(F.col("targets"), F.col("hits")), "expanded_recall": recall(F.col("targets"), F.filter("sources", lambda s: F.coalesce(s["corpus"], F.lit(False)))),
        "gate_refused": gate, "assess_refused": F.coalesce(F.col("refusal") == "insufficient_context", F.lit(False)),
        "cited": citation_rate(F.col("answer"), F.col("sources"), F.col("targets")), "valid": citation_validity(F.col("answer"), F.col("sources")),
        "worded": F.size(prompt_wording(F.coalesce("answer", F.lit("")))) > 0, "words": F.when(F.coalesce(F.col("answer"), F.lit("")) != "", F.size(F.filter(F.split("answer", r"\s+"), lambda w: w != ""))),
        "chunks": F.size("sources").cast("double"), "chars": F.aggregate("sources", F.lit(0), lambda n, s: n + F.length(s["text"])).cast("double"),
    })
    if judgements is None:
        return r.withColumns({c: F.lit(None).cast(t) for c, t in (("correct", "double"), ("faithful", "double"), ("declined", "double"), ("judged", "boolean"))})
    verdict = lambda c, good: F.when(F.col(c) == "cannot_judge", None).when(F.col(c).isNotNull(), (F.col(c) == good).cast("double"))
    faithful = F.when(F.size("claims") > 0, F.size(F.filter("claims", lambda c: c["supported"])) / F.size("claims"))
    j = judgements.select("case_id", verdict("correctness", "pass").alias("correct"), faithful.alias("faithful"), verdict("refused", "declined").alias("declined"), F.lit(True).alias("judged"))
    return r.join(j, "case_id", "left")


def metrics(r: DataFrame) -> DataFrame:
    """One row with every measure of a run, over the rows of `results`."""
    mean = lambda c, where: F.avg(F.when(F.col(where), F.col(c).cast("double")))
    count = lambda *cs: F.count_if(reduce(lambda a, b: a & b, (F.col(c) for c in cs)))
    marked = r.withColumns({"raw_hit": F.col("raw_recall") > 0, "expanded_hit": F.col("expanded_recall") > 0})
    return marked.agg(
        F.count("*").alias("cases"), F.count_if(F.col("kind") == "in_corpus").alias("in_corpus"), F.count_if(F.col("kind") == "out_of_corpus").alias("out_of_corpus"), F.count_if(~F.col("scored")).alias("errors"),
        mean("raw_hit", "referenced").alias("raw_hit_rate"), mean("raw_recall", "referenced").alias("raw_recall"), mean("expanded_hit", "referenced").alias("expanded_hit_rate"), mean("expanded_recall", "referenced").alias("expanded_recall"),
        mean("chunks", "inside").alias("mean_context_chunks"), mean("chars", "inside").alias("mean_context_chars"),
        mean("gate_refused", "searched_outside").alias("gate_refusal_rate"), count("inside", "gate_refused").alias("false_refusals"), count("inside", "gate_refused", "raw_hit").alias("refused_a_found_reference"),
        mean("assess_refused", "searched_outside").alias("assess_refusal_rate"), count("inside", "assess_refused").alias("assess_false_refusals"),
        mean("cited", "answered").alias("cited_references"), mean("valid", "scored").alias("markers_in_context"),
        count("scored", "worded").alias("prompt_wording"), F.bround(mean("words", "scored"), 0).cast("long").alias("mean_words"),
        F.count_if(F.col("scored") & F.coalesce("judged", F.lit(False))).alias("judged"), mean("correct", "scored").alias("correctness"), mean("faithful", "scored").alias("faithfulness"), mean("declined", "scored").alias("model_refusal_rate"),
        F.coalesce(F.floor(mean("total_ms", "scored")), F.lit(0)).cast("long").alias("mean_total_ms"),
    )


def step_latency(r: DataFrame) -> DataFrame:
    """step, mean_ms (rounded down) over the scored cases that ran it."""
    steps = r.where("scored").select(F.explode("steps").alias("s"))
    return steps.groupBy(F.col("s.step").alias("step")).agg(F.floor(F.sum("s.ms") / F.count("s.ms")).alias("mean_ms"))


def run_usage(r: DataFrame) -> DataFrame:
    """Tokens and cost of the run; zero where no case called a model."""
    steps = r.where("scored").select(F.explode("steps").alias("s"))
    return steps.agg(*(F.coalesce(F.sum(f"s.{c}"), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cost_usd")))


def judge_coverage(r: DataFrame) -> DataFrame:
    """judgeable, judged, coverage, too_few, never_answered."""
    able = F.count_if(F.col("scored") & (F.col("outcome") == "done"))
    judged = F.count_if(F.col("scored") & F.coalesce("judged", F.lit(False)))
    return r.agg(able.alias("judgeable"), judged.alias("judged")).select("judgeable", "judged", F.when(F.col("judgeable") > 0, F.col("judged") / F.col("judgeable")).alias("coverage"), ((F.col("judgeable") > 0) & (F.col("judged") < TOO_FEW_JUDGED * F.col("judgeable"))).alias("too_few"), ((F.col("judgeable") > 0) & (F.col("judged") == 0)).alias("never_answered"))


def drift(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """case_id, place, drift of each target: unresolved, unstamped, stale or clean against the corpus now."""
    targets = cases.select("case_id", F.posexplode("targets").alias("place", "t")).select("case_id", "place", "t.*")
    numbered = targets.withColumn("target_id", F.concat_ws("#", "case_id", "place"))
    now = division_hashes(numbered, chunks).select("target_id", text.short_hashes("content_hashes").alias("now"))
    kind = F.when(F.col("now").isNull(), "unresolved").when(F.size(F.coalesce("content_hashes", F.array().cast("array<string>"))) == 0, "unstamped").when(F.col("now") != F.col("content_hashes"), "stale").otherwise("clean")
    return numbered.join(now, "target_id", "left").select("case_id", "place", kind.alias("drift"), F.col("now").alias("current"))


def stamped(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cases with the current hashes on their targets; raises if any target is unresolved."""
    found = drift(cases, chunks)
    if not found.where("drift = 'unresolved'").isEmpty():
        raise ValueError("unresolved references: nothing is stamped")
    now = found.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "current"))), lambda x: x["current"]).alias("_now"))
    zipped = F.transform(F.arrays_zip(F.col("targets").alias("t"), F.col("_now").alias("n")), lambda z: z["t"].withField("content_hashes", z["n"]))
    return cases.join(now, "case_id", "left").withColumn("targets", F.when(F.size("targets") > 0, zipped).otherwise(F.col("targets"))).drop("_now")


def flattened(df: DataFrame) -> DataFrame:
    """A one-row table of nested metrics as (metric, value): dotted paths and numbers as text."""
    def leaves(fields: Iterable[T.StructField], prefix: str) -> Iterable[tuple[str, T.DataType]]:
        for f in fields:
            yield from leaves(f.dataType.fields, f"{prefix}{f.name}.") if isinstance(f.dataType, T.StructType) else [(f"{prefix}{f.name}", f.dataType)]

    pairs = [F.struct(F.lit(p).alias("metric"), F.col(p).cast("string").alias("value"), F.lit(i).alias("place"), F.lit(isinstance(t, T.NumericType)).alias("number")) for i, (p, t) in enumerate(leaves(df.schema.fields, ""))]
    return df.select(F.explode(F.array(*pairs)).alias("m")).select("m.*")


def compared(base: DataFrame, other: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """metric, base, other, delta, shown, place of two runs (metric, value, place, number): in the declared order (metric,
    place) or else the first run's, unknown ones last.

    Only pairs of numbers have a delta, shown with its sign; booleans are no numbers.
    """
    b, o = base.select("metric", F.col("value").alias("base"), "place", F.col("number").alias("_bn")), other.select("metric", F.col("value").alias("other"), F.col("number").alias("_on"))
    delta = F.when(F.col("_bn") & F.col("_on"), F.col("other").try_cast("double") - F.col("base").try_cast("double"))
    both = b.join(o, "metric", "full_outer").withColumn("delta", delta)
    if declared is not None:
        both = both.drop("place").join(declared.select("metric", "place"), "metric", "left")
    return both.select("metric", "base", "other", "delta", F.format_string("%+.3f", "delta").alias("shown"), F.coalesce("place", F.lit(1 << 30)).alias("place")).withColumn("shown", F.when(F.col("delta").isNotNull(), F.col("shown"))).orderBy("place", "metric")


#: What of a case doesn't change what it asserts.
UNSCORED = ("content_hashes",)


def dataset_hash(cases: DataFrame) -> DataFrame:
    """sha256 of what all cases assert, stamps and empty fields left out, so that neither a new stamp nor a new optional field
    makes runs incomparable."""
    kept = [F.when(F.size(c) > 0, F.col(c)).alias(c) if isinstance(t, T.ArrayType) else F.col(c) for c, t in ((f.name, f.dataType) for f in cases.schema) if c not in UNSCORED]
    told = cases.select(*kept)
    if "targets" in cases.columns:
        told = told.withColumn("targets", F.transform("targets", lambda x: x.dropFields(*UNSCORED)))
    line = F.to_json(F.struct(*sorted(told.columns)))  # null fields are left out
    return corpus.hashed_in_order(told.select(line.alias("line")))


def summary(r: DataFrame) -> DataFrame:
    """place, line: a run's report from its measures: the cases by kind, then each measure that has a value, in order."""
    m = metrics(r)
    head = m.select(F.lit(0).alias("place"), F.format_string("%d cases: %d in corpus, %d out of corpus, %d errors", "cases", "in_corpus", "out_of_corpus", "errors").alias("line"))
    rest = flattened(m).where("value is not null and place > 3")
    return head.unionByName(rest.select("place", F.concat(F.rpad("metric", 28, " "), F.when(F.col("number") & F.col("value").contains("."), F.format_string("%.3f", F.col("value").try_cast("double"))).otherwise(F.col("value"))).alias("line")))


def tuning_order(entries: DataFrame) -> DataFrame:
    """Entries with their rank: recall falling (unmeasured last), then cost (unmeasured last), then cheaper context."""
    order = [F.coalesce("recall", F.lit(-1.0)).desc(), F.col("cost_usd").asc_nulls_last(), F.col("context_chars").asc_nulls_last(), F.asc("name")]
    return entries.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # a sweep's settings: tens of rows


def sweep(grid: dict[str, list[Any]], baseline: dict[str, Any], measure: Callable[[dict[str, Any]], dict[str, Any]], companions: dict[str, dict[str, Any]] | None = None) -> list[dict[str, Any]]:
    """One factor at a time: the baseline, then every other value of each parameter, with what must go along with it."""
    found = [{"name": "baseline", **measure(dict(baseline))}]
    for name, values in grid.items():
        for v in values:
            if v != baseline.get(name):
                settings = {**baseline, **(companions or {}).get(name, {}), name: v}
                found.append({"name": f"{name}={v}", **measure(settings)})
    return found


def case_lines(r: DataFrame) -> DataFrame:
    """case_id, line: a case's outcome as a line of a report."""
    mark = F.when(~F.col("scored"), "error").when(F.col("inside") & (F.size("targets") > 0), F.format_string("recall %.2f", "expanded_recall")).otherwise(F.col("outcome"))
    return r.select("case_id", F.concat(F.rpad("case_id", 32, " "), F.lit(" "), mark).alias("line"))


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from JSON lines, checked: known kinds, unique ids, answers and targets only in the corpus, at least one case."""
    schema = "case_id string, kind string, traits array<string>, question string, answer string, targets array<struct<celex:string,article:string,paragraph:string,point:string,annex:string,content_hashes:array<string>>>"
    cases = spark.read.schema(schema).json(path)
    bad = cases.where(~F.coalesce(F.col("kind").isin("in_corpus", "out_of_corpus"), F.lit(False)) | ((F.col("kind") == "out_of_corpus") & (F.col("answer").isNotNull() | (F.size("targets") > 0))))
    if cases.isEmpty():
        raise ValueError("no cases")
    if not bad.isEmpty():
        raise ValueError(f"cases with fields that their kind can't have: {[r.case_id for r in bad.select('case_id').limit(5).collect()]}")
    if not cases.groupBy("case_id").count().where("count > 1").isEmpty():
        raise ValueError("case ids aren't unique")
    return cases


def save_cases(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").option("ignoreNullFields", "true").json(path)
