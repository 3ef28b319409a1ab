"""run() against the stages' definitions, on a small folder of tables."""

import random

import pytest
from odd import prose, table

import corpus_pipeline


def unlike(seed, n):
    return " ".join(f"{w}{seed}x{k % 7}" for k, w in enumerate(prose(seed, n).split()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    r = random.Random(3)
    good = [(i, unlike(i, 120), "en", f"s{0 if i % 4 else i % 3}") for i in range(120)]
    junk = [(200 + i, " ".join(w.upper() + r.choice(["!!", "$$$"]) for w in prose(i, 120).split()), "en", "s0") for i in range(60)]
    copies = [(300 + i, good[i][1], "en", "s1") for i in range(10)] + [(320 + i, good[i + 20][1] + " tail", "en", "s2") for i in range(5)]
    leaks = [(400 + i, f"{unlike(900 + i, 60)} {unlike(5000 + i, 30)}", "en", "s1") for i in range(6)]
    table(spark, *good, *junk, *copies, *leaks).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, unlike(5000 + i, 30)) for i in range(6)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(200 + i, 0, 0) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), {i for i, *_ in good}


def test_run(spark, folder):
    from quillspark.llm import token_output

    path, good = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in rows} == good  # junk, later copies and leaks are gone; clean documents aren't
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert all(token_output.decode_ids(r.tokens) == docs[r.doc_id] for r in rows)


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = out
    position = {r.doc_id: k for k, r in enumerate(docs.collect())}
    assert len(position) == 120


def test_training_order_survives_files(spark, folder, tmp_path):
    """Files of unequal size, the last ones largest: they're read before the others."""
    path, _ = folder
    sizes = [3, 1, 40, 2, 90, 7]
    for k, n in enumerate(sizes):
        first = sum(sizes[:k])
        rows = [(first + i, unlike(first + i, 20 * n)) for i in range(n)]
        table(spark, *rows).coalesce(1).write.parquet(f"{tmp_path}/{k}")
        made = next((tmp_path / str(k)).glob("part-*.parquet"))
        (tmp_path / "mixed").mkdir(exist_ok=True)
        made.rename(tmp_path / "mixed" / f"part-{k:05d}-x-c000.parquet")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    for docs in (mixed, mixed.orderBy("doc_id")):
        made = corpus_pipeline.token_id_output(spark, docs, path)
        made.write.mode("overwrite").parquet(f"{tmp_path}/out")
        assert [r.doc_id for r in made.collect()] == list(range(sum(sizes)))
        assert all(r.position == r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_odd_rows(spark, folder, tmp_path):
    """Nulls, repeats, long texts, clashing columns, and two texts under one doc_id, of which one is a copy or a leak."""
    from odd import ROWS, odd

    path, _ = folder
    leak, clean, copy = f"{unlike(901, 60)} {unlike(5001, 30)}", unlike(7001, 80), unlike(7002, 80)
    more = table(spark, (700, leak), (700, clean), (701, copy), (702, copy), (702, unlike(7003, 80))).selectExpr("*", *(f"'clash' as {c}" for c in odd(spark).columns[5:]))
    docs = odd(spark).unionByName(more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == odd(spark).columns
    rows = docs.collect()
    assert {r.text for r in rows if r.doc_id in (700, 701, 702)} == {clean, copy, unlike(7003, 80)}
    assert all(r.term == "clash" for r in rows)
    whole = {str(i) for i, *_ in ROWS} - {"2", "9"}  # copies of 1 and 8
    assert {str(r.doc_id) for r in rows} == whole | {"700", "701", "702"}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in rows)
    assert [r.position for r in out] == list(range(len(out)))


def test_empty(spark, folder, tmp_path):
    path, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_that_run_python_bound_its_batches(spark, monkeypatch, tmp_path):
    import corpus_pipeline as P
    from quillspark.llm.common import BATCH_BYTES

    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    had = spark.conf.get(key, None)
    docs = spark.createDataFrame([(1, "a", "en", "x", 0)], "doc_id bigint, text string, lang string, source string, position bigint")
    docs.write.parquet(f"{tmp_path}/benchmark.parquet")
    see = lambda *args, **kw: seen.append(spark.conf.get(key)) or docs
    monkeypatch.setattr(P.decontam, "decontaminate", see)
    monkeypatch.setattr(P.token_output, "token_output", see)
    P.benchmark_decontamination(spark, docs, str(tmp_path))
    P.token_id_output(spark, docs, str(tmp_path))
    assert seen == [str(BATCH_BYTES)] * 2 and spark.conf.get(key, None) == had
