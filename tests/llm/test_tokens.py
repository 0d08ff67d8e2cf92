import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from curvelake.llm import packing, token_files
from curvelake.llm.common import scratch
from curvelake.llm.tokens import Encoder, default_vocabulary
from helpers import awkward, empty

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(default_vocabulary())
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(plain):
    parts = list("ab1 \n\t'.,é日　\xa0\x1c\x85😀 s't \r\x0b<|#") + ["<|endoftext|>", "  ", "'re", "Word, ", "été."]
    draw = np.random.default_rng(3)
    texts = ["".join(draw.choice(parts, draw.integers(0, 30))) for _ in range(3000)]
    for text, raw in zip(texts, Encoder(default_vocabulary())(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == plain(text), repr(text)


def check_files(spark, docs, plain):
    folder = scratch(spark, "tokens-test")
    token_files.write_token_files(docs, folder)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or ""))
    got = sorted(token_files.digests(token_files.read_tokens(spark, folder)).collect(), key=lambda r: r.start)
    start = 0
    for row, r in zip(rows, got, strict=True):
        ids = np.array([*plain(row.text), 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return folder


def test_files_round_trip_and_layout(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = check_files(spark, docs, plain)
    part = token_files.read_tokens(spark, folder, 10, 19).collect()
    assert sorted(r.doc_id for r in part) == list(range(10, 20))
    assert "GreaterThanOrEqual(doc_id,10)" in token_files.read_tokens(spark, folder, 10, 19)._jdf.queryExecution().toString()
    assert token_files.read_metadata(spark, folder).columns == ["doc_id", "start", "n_tokens", "part", "local_start"]
    plan = token_files.read_metadata(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "array<int>" not in plan
    meta = pq.ParquetFile(glob.glob(folder.removeprefix("file:") + "/*.parquet")[0]).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_column_index
    tokens = next(c for name, c in columns.items() if name.startswith("tokens"))
    assert tokens.has_dictionary_page and tokens.has_offset_index


def test_files_of_awkward_rows(spark, plain):
    check_files(spark, awkward(spark), plain)
    folder = scratch(spark, "tokens-test")
    token_files.write_token_files(empty(spark), folder)
    assert token_files.read_tokens(spark, folder).count() == 0


def check_packing(docs, plain, pieces):
    wanted = {}
    for r in docs.select("doc_id", "text").collect():
        wanted.setdefault(r.doc_id, []).append(np.array([*plain(r.text), 0], "<u4").tobytes())
    found, sequences = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
        found.setdefault(p.doc_id, []).append((p.start, p.ids))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length, p.tier, p.step_group))
    for doc_id, texts in wanted.items():
        ids = b"".join(x for _, x in sorted(found.pop(doc_id)))
        assert len(ids) == sum(map(len, texts))
        if len(texts) == 1:
            assert ids == texts[0]
    assert not found
    for parts in sequences.values():
        parts.sort()
        at = 0
        for offset, n, tier, group in parts:
            assert offset == at and tier == parts[0][2] and group == parts[0][3]
            at += n
        assert at == parts[0][2] <= 1024 and at & (at - 1) == 0
    return sequences


def test_packing(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    sequences = check_packing(docs, plain, packing.pack_documents(docs).collect())
    assert sum(1 for s in sequences.values() if s[0][2] == 1024) > 0.7 * len(sequences)


def test_packing_awkward_rows(spark, plain):
    docs = awkward(spark)
    check_packing(docs, plain, packing.pack_documents(docs).collect())
    assert packing.pack_documents(empty(spark)).count() == 0


def test_step_groups_cost_alike():
    packer, draw = packing.Packer(step_tokens=8 * 1024), np.random.default_rng(1)
    for i in range(3000):
        packer.add(i, bytes(4 * int(draw.integers(1, 1500))))
    packer.finish()
    cost, tokens = {}, {}
    for _, _, n, _, _, _, _, tier, group in packer.steps(True):
        cost[tier, group] = cost.get((tier, group), 0) + n * n
        tokens[tier, group] = tokens.get((tier, group), 0) + n
    full = [c for k, c in cost.items() if k[0] == 1024 and tokens[k] == 8 * 1024]
    assert len(full) > 50 and max(full) < 1.2 * min(full)
