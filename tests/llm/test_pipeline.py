import hashlib

import pytest

import corpus_pipeline
from compare import difference, duck
from curvelake.llm import decontaminate
from curvelake.llm.common import scratch
from curvelake.llm.queries import REGISTRY
from helpers import PROSE, awkward, base_secrets, benchmark_hits, components, empty, line_counts, shingles

SF = "/root/testdata/sf0.001"


def hits(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in rows)


def expected(docs, items):
    out = []
    for r in docs.collect():
        n, hit, found = benchmark_hits(r.text, items)
        out.append((r.doc_id is None, r.doc_id or 0, n, len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= n))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 24, 400])
def test_decontamination(spark, monkeypatch, block):
    """One automaton, and the benchmark in many parts."""
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    items = [(1, PROSE), (2, "lazy DOG"), (None, "ships drift"), (4, None), (5, "..."), (1, "seven old"), (6, "日本 🙂")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    named = [("null" if i is None else str(i), t) for i, t in items]
    assert hits(decontaminate.contaminated(awkward(spark), benchmark).collect()) == expected(awkward(spark), named)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = spark.read.parquet(f"{SF}/benchmark.parquet")
    named = [(str(r.item_id), r.text) for r in table.collect()]
    assert hits(decontaminate.contaminated(docs, table).collect()) == expected(docs, named)


def test_decontamination_spans_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "é 🙂 x, SEVEN --old ships; y")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "seven old ships")], "item_id long, text string")
    row = decontaminate.contaminated(docs, benchmark).first()
    assert [docs.first().text[s["start"] : s["end"]] for s in row.spans] == ["SEVEN --old ships"]
    assert decontaminate.contaminated(empty(spark), benchmark).count() == 0
    assert not decontaminate.contaminated(docs, benchmark.limit(0)).first().contaminated


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_queries_against_sql(spark, name):
    made = REGISTRY[name].build(spark, SF)
    longs = {c: "Int64" for c, kind in made.dtypes if kind == "bigint"}
    assert difference(made.toPandas().astype(longs), duck(SF).execute(REGISTRY[name].sql).df().astype(longs)) is None


@pytest.mark.parametrize("name", sorted(n for n in REGISTRY if n != "op13_prefix_trie"))
def test_queries_return_whole_tables(spark, name):
    table = "conversations" if name.startswith("op10") else "documents"
    got = REGISTRY[name].build(spark, SF)
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert got.count() == rows or name == "op3_packing" and got.select("doc_id").distinct().count() == rows


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        folder = scratch(spark, "stage-test")
        stage(spark, docs, SF).write.parquet(folder)
        before, after = {r.doc_id: r for r in docs.collect()}, spark.read.parquet(folder)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        kept = {r.doc_id: r for r in after.collect()}
        assert len(kept) == after.count() and set(kept) <= set(before)
        if name == "quality_rules":
            assert all(not line_counts(before[i].text)[-1] for i in kept) and len(kept) > 0.6 * len(before)
            assert all(set(kept[i].text.split("\n")) <= set(before[i].text.split("\n")) for i in kept)
        elif name == "near_dedup":
            component = components({i: shingles(r.text) for i, r in before.items()}, 80)
            assert set(kept) == set(component.values())
        elif name == "decontamination":
            bad = {i for i, r in before.items() if (h := benchmark_hits(r.text, items))[1] and 20 * len(h[1]) >= h[0]}
            assert bad and set(kept) == set(before) - bad
        else:
            assert set(kept) == set(before) and not any(base_secrets(r.text) for r in kept.values())
            assert all(kept[i].text == r.text for i, r in before.items() if "[SECRET]" not in kept[i].text)
        assert all(r.n_chars == len(r.text) for r in kept.values())
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.count()


def test_stages_take_awkward_rows(spark):
    for make in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            rows = make(spark)
            if name == "packing":
                assert stage(spark, rows, SF).select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
            else:
                out = stage(spark, rows, SF)
                assert out.columns == rows.columns
                out.collect()


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and {"sequence_id", "offset", "ids"} <= set(rows.columns)
    assert all(hashlib.sha256(r.ids).digest() and len(r.ids) == 4 * r.length for r in rows.limit(5).collect())
