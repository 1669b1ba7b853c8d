"""The pipeline's stages, each against a plain reading of its operator's verdicts, on a small corpus and on edge cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quern.llm import quality, simhash, substring, toxicity
from quern.llm.common import keyed, settled

AT = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    found = {"documents": docs}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, AT)
        docs = docs.cache()
        found[name] = docs
    return found


def test_stage_columns(stages):
    first = stages["documents"].columns
    assert all(stages[name].columns == first for name, _ in cp.STAGES[:-1])


def test_quality_stage_follows_the_verdicts(spark, stages):
    kept = {r.doc_id for r in quality.rate(stages["documents"], cp.PIECE_BPE).where("kept").collect()}
    assert rows(stages["quality"]) == [r for r in rows(stages["documents"]) if r[0] in kept]


def test_toxicity_stage_follows_the_scores(spark, stages):
    docs = stages["quality"]
    model = toxicity.fit(docs, spark.read.parquet(f"{AT}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(docs, model).where(f"score < {toxicity.THRESHOLD}").collect()}
    assert rows(stages["toxicity"]) == [r for r in rows(docs) if r[0] in clean]


def test_simhash_stage_keeps_one_of_each_group(stages):
    docs = stages["toxicity"]
    keep = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert rows(stages["simhash"]) == [r for r in rows(docs) if r[0] in keep]


def test_substring_stage_cuts_the_passages(stages):
    docs = stages["simhash"]
    spans = {}
    for r in substring.passages(docs).collect():
        spans.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    want = []
    for k, t in rows(docs):
        words = [w for i, w in enumerate(t.split()) if i not in spans.get(k, ())]
        if words:
            want.append((k, words))
    got = stages["substring"].collect()
    assert sorted((r.doc_id, r.text.split()) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_packing_stage_holds_every_document(stages):
    pieces = stages["packing"].collect()
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert sorted(total) == [k for k, _ in rows(stages["substring"])]
    assert all(total[p.doc_id] == p.doc_tokens for p in pieces)


def test_edge_cases(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(n))
    long = prose(20_000)
    given = [(1, None), (2, ""), (None, prose(80)), (4, long), (5, long), (6, prose(120)), (6, prose(90)), (None, None), (7, "x " * 400)]
    docs = spark.createDataFrame([(k, t, None, None, None, 1.5) for k, t in given], "doc_id long, text string, lang string, source string, n_chars long, score double")
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, AT).cache()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
            kept = {k for k, _ in [(r.doc_id, 0) for r in docs.collect()]}
            assert {4, 6, None} <= kept and not kept & {1, 2, 7}
    assert docs.count() > 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, AT).count() == 0


def test_rows_that_share_an_id_are_decided_about_one_by_one(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(n))
    a, b, c, head = prose(120), prose(100), prose(90), prose(40)
    given = [(1, b), (6, a), (6, b), (9, c), (9, c), (6, f"{head} {b}"), (None, prose(100)), (None, b), (3, "too short")]
    extra = "_spans long, _of string, _id long, _score string, _own long, _row long, key long, spans long, doc string, score long, kept string, lang string"
    docs = spark.createDataFrame([(k, t, 7, "x", 1, "y", 2, 3, 4, 5, "z", 6, "w", None) for k, t in given], f"doc_id long, text string, {extra}")
    docs.repartition(3).write.parquet(str(tmp_path / "given"))
    docs = spark.read.parquet(str(tmp_path / "given"))
    plain = [(k, t) for k, t in given if t != "too short"]
    wants = [plain, plain, None, None]
    for (name, stage), want in zip(cp.STAGES[:-1], wants, strict=False):
        stage(spark, docs, AT).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert len(docs.columns) == 14 and all(tuple(r)[2:] == (7, "x", 1, "y", 2, 3, 4, 5, "z", 6, "w", None) for r in docs.collect())
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        if want is not None:
            assert got == sorted(want, key=str), name
        elif name == "simhash":
            assert got == sorted([(1, b), (6, a), (9, c), (6, f"{head} {b}"), given[6]], key=str)
        else:
            assert [(k, t.split()) for k, t in got] == sorted([(1, b.split()), (6, a.split()), (9, c.split()), (6, head.split()), (None, given[6][1].split())], key=str)


def test_rows_out_of_shuffles_joins_and_samples(spark, tmp_path):
    """Such rows may lie elsewhere at each reading; with shared ids every stage still decides about each for its own text."""
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(n))
    given = [(i % 40, prose(60) if i % 3 else f"{prose(3)} junk", None, "s", 7) for i in range(300)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "given"))
    docs = spark.read.parquet(str(tmp_path / "given"))
    good = sorted(t for _, t, *_ in given if not t.endswith("junk"))
    lookup = spark.createDataFrame([(i, i) for i in range(40)], "doc_id long, other long")
    joined = docs.hint("shuffle_hash").join(lookup, "doc_id").drop("other")
    for name, df in {"dealt": docs.repartition(8), "joined": joined, "sorted": docs.orderBy(F.rand()), "limited": docs.repartition(8).limit(300), "union": docs.union(docs.limit(0)).repartition(3)}.items():
        assert sorted(r.text for r in cp.quality_rules(spark, df, AT).collect()) == good, name
    clean = docs.where("text not like '%junk'")
    for stage in (cp.simhash_dedup, cp.substring_dedup):
        assert sorted(r.text for r in stage(spark, clean.repartition(8), AT).collect()) == good
    some = [r.text for r in cp.quality_rules(spark, docs.repartition(8).sample(0.5, seed=3), AT).collect()]
    assert len(set(some)) == len(some) > 50 and set(some) <= set(good)


def test_what_is_read_alike_is_not_written_again(spark, tmp_path):
    spark.range(9).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "ids"))
    files = spark.read.parquet(str(tmp_path / "ids"))
    for df in (files, files.where("doc_id > 3").select((F.col("doc_id") + 1).alias("doc_id")), files.union(files), files.checkpoint()):
        assert settled(df) is df
    for df in (files.repartition(2), files.withColumn("x", F.rand()), files.sample(0.5), files.limit(3), files.distinct(), files.join(files, "doc_id")):
        assert settled(df) is not df


def test_numbers_of_rows(spark):
    def numbers(ids):
        found, name = keyed(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
        got = [(r.doc_id, r[name]) for r in found.collect()]
        assert len({n for _, n in got}) == len(ids)
        return got

    assert sorted(numbers([3, 1, 2])) == [(1, 1), (2, 2), (3, 3)]
    assert all(n == i or i in (5, None) and n > 7 for i, n in numbers([5, 5, 7, None, None]))
    assert all(n == i or i == 5 and n < 5 for i, n in numbers([5, 5, (1 << 63) - 1]))
    numbers([-(1 << 63), (1 << 63) - 1, 4, 4])
    numbers([None, None])
    assert numbers([]) == []


def test_run(spark, stages):
    got = cp.run(spark, AT)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {k for k, _ in rows(stages["substring"])}
