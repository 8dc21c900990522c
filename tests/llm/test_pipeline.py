"""The pipeline against plain Python, and the registered queries."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from echolith.llm import decontamination, quality_classifier, secret_scan
from echolith.llm.common import shared_folder
from tests.llm.test_operators import fingerprint_model, linked_model, mix_model, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    good = [prose(rng, rng.randint(30, 120)) for _ in range(150)]
    bad = [" ".join(w + rng.choice("#$%&") * 3 for w in prose(rng, 60).split()) for _ in range(60)]
    items = [prose(rng, 40).replace("\n", " ") for _ in range(5)]
    more = [good[0], good[0], good[1] + " more", good[2] + "\n" + items[0], items[1], "so " + good[3] + " password=correcthorsebattery end", None, ""]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate([*good, *bad, *more])]
    rows.append(rows[5])
    labels = [(i, int(i < 150), 0) for i in range(210)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_pipeline_by_stages(spark, sf_dir):
    path, rows, items = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    model = quality_classifier.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    scores = {r.i: r.s for r in quality_classifier.scored(docs, model).selectExpr("_keep.doc_id i", "_score s").collect()}
    for i in range(210):
        if zlib.crc32(str(i).encode()) % 5 == 0:
            assert (scores[i] >= 0.3) == (i < 150)
    alive = [r for r in rows if scores[r[0]] >= 0.3]
    step = iter(corpus_pipeline.STAGES)

    def run(docs):
        name, stage = next(step)
        return stage(spark, docs, path)

    docs = run(docs)
    assert docs.columns == columns and Counter(r.doc_id for r in docs.collect()) == Counter(r[0] for r in alive)
    texts = {r[0]: r[1] for r in alive}
    ids = sorted(texts)
    roots, least = linked_model([fingerprint_model(texts[i]) for i in ids]), {}
    for i, root in zip(ids, roots, strict=True):
        least.setdefault(root, i)
    docs = run(docs)
    alive = sorted(least.values())
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == alive
    known = [" ".join(decontamination.word_list(t)) for t in items]
    alive = [i for i in alive if not any(k in " ".join(decontamination.word_list(texts[i])) for k in known)]
    docs = run(docs)
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == alive
    docs = run(docs)
    got = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and sorted(got) == alive
    assert all(r.text == secret_scan.redacted(texts[i]) and r.n_chars == len(r.text or "") for i, r in got.items() if r.text is not None)
    assert not any("correcthorse" in (r.text or "") for r in got.values())
    last = {r.doc_id: r for r in run(docs).collect()}
    sizes, target = mix_model([(i, got[i].text, got[i].source) for i in alive])
    taken = defaultdict(int)
    for i, r in last.items():
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(len(WORD.findall(got[i].text or "")) for i in alive if got[i].source == s) / 2 + 1
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    whole = corpus_pipeline.run(spark, path)
    assert len([x for x in set(os.listdir(shared_folder(spark).removeprefix("file:"))) - before if x.endswith(".parquet")]) <= 2
    assert all(r.text == got[r.doc_id].text and r.source == got[r.doc_id].source for r in whole.collect()) and set(columns) <= set(whole.columns)
    assert {(r.doc_id, r.taken) for r in whole.collect()} == {(i, r.taken) for i, r in last.items()}


def test_stages_take_empty_tables_and_odd_columns(spark, sf_dir):
    path, *_ = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "'x' as _keep", "1 as _row", "2 as taken", "array(doc_id) as size")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), path).count() == 0, name
        out = stage(spark, docs, path)
        assert out.count() > 0 and (name == "source_mix" or out.columns == docs.columns), name


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(names)
