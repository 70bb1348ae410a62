"""The five stages together: planted rows go, clean ones stay, and folders go when used."""

import os

import corpus_pipeline
import pytest
from test_near_dedup import brute
from test_packing import want
from test_small_operators import brute_hits

from boostlab import session
from boostlab.llm import toxicity


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The small tables, with planted copies, a benchmark passage and a null text."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    passage = max((r["text"] for r in bench.collect()), key=len)
    body = " ".join(f"planted{i}" for i in range(300))
    planted = {900_001: body, 900_002: body.upper(), 900_003: body + " end",
               900_004: f"quoted: {passage} and so on", 900_005: None,
               900_006: " ".join(f"lonely{i}" for i in range(80))}
    rows = [docs.first().asDict() | {"doc_id": i, "text": t} for i, t in planted.items()]
    extra = spark.createDataFrame(rows, docs.schema)
    docs.unionByName(extra).write.parquet(f"{path}/documents.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_planted_rows(spark, folder):
    home = session._home(spark).removeprefix("file:")
    before = set(os.listdir(home)) if os.path.isdir(home) else set()
    packed = corpus_pipeline.run(spark, folder)
    rows = packed.select("doc_id", "sequence_id", "offset", "length").collect()
    ids = {r["doc_id"] for r in rows}
    assert not ids & {900_001, 900_003, 900_004}
    assert {900_002, 900_006} <= ids  # of exact copies the largest id stays, of near ones the least
    assert len(ids) > 0.5 * spark.read.parquet(f"{folder}/documents.parquet").count()
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    # the last stage's input and its pieces
    assert len(set(os.listdir(home)) - before) == 2


def test_all_but_the_last_stage_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema == docs.schema, name


def test_empty_tables_give_no_sequences(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(
            f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What goes into every stage and comes out of it, as rows."""
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after, _ = session.settled_alone(spark, lambda d=docs, s=stage: s(spark, d, folder))
        seen[name] = (docs.collect(), after.collect())
        docs = after
    return seen


def _ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_toxic_rows_go_by_their_decisions(spark, folder, stages):
    before, after = stages["toxicity"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    marked = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["predicted"]}
    assert _ids(after) == sorted(set(_ids(before)) - marked)
    labels = {r["doc_id"]: r["toxic"] for r in
              spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert not [i for i in marked if labels.get(i) == 0]  # no row known to be clean goes


def test_exact_copies_by_force(stages):
    before, after = stages["exact_dedup"]
    last = {}
    for r in before:
        key = (r["text"] or "").encode().lower()
        last[key] = max(r["doc_id"], last.get(key, r["doc_id"]))
    assert _ids(after) == sorted(last.values())


def test_near_copies_by_force(stages):
    before, after = stages["near_dedup"]
    wanted = brute([(r["doc_id"], r["text"]) for r in before])
    assert _ids(after) == sorted(i for i, _, _, kept in wanted if kept)


def test_benchmark_passages_by_force(spark, folder, stages):
    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in
             spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    judged = brute_hits([(r["doc_id"], r["text"]) for r in before], items, 10)
    assert _ids(after) == sorted(i for i, *_, hit in judged if not hit)


def test_rows_stay_as_they_are(stages):
    """A stage drops rows; it changes none."""
    for name, _ in corpus_pipeline.STAGES[:-1]:
        before, after = stages[name]
        assert set(after) <= set(before) and len(after) > 0, name


def test_packed_pieces_by_the_library(stages):
    before, after = stages["packing"]
    got = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"])
                 for r in after)
    assert got == want([(r["doc_id"], r["text"]) for r in before])
