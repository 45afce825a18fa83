"""The pipeline and the registered queries on the smallest tables, stage by stage against plain versions."""

import os
import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_operators import hits_plain, removed_lines, test_encoder_is_the_tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from loomgraph.llm import queries, similar  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    out, docs = [], spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA)
        rows = after.collect()
        out.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in rows]))
        docs = spark.createDataFrame(rows, after.schema)
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert list(before[0]) == list(after[0]) == list(corpus_pipeline.COLUMNS)
        assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)


def test_toxicity_stage(stages, spark):
    before, after = stages[0]
    assert {(r["doc_id"], r["text"]) for r in after} <= {(r["doc_id"], r["text"]) for r in before}
    # The smallest tables have a handful of toxic documents, too few to learn from; the next size has fifty.
    more = DATA.replace("0.001", "0.01")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{more}/documents.parquet"), more).collect()}
    labels = spark.read.parquet(f"{more}/labels.parquet").collect()
    clean, toxic = ([r["doc_id"] for r in labels if r["toxic"] == c] for c in (0, 1))
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    assert sum(d in kept for d in toxic) <= 0.1 * len(toxic)


def test_line_stage(stages):
    before, after = stages[1]
    texts = [(r["doc_id"], r["text"]) for r in before]
    gone = removed_lines(texts, 50)
    assert {r["doc_id"]: r["text"] for r in after} == {d: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) for d, t in texts}


def test_near_duplicate_stage(stages):
    before, after = stages[2]
    kept = {r["doc_id"] for r in after}
    sets = {r["doc_id"]: similar.shingle_set(r["text"]) for r in before}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ids = sorted(sets)
    groups = {d: d for d in ids}

    def find(x):
        while groups[x] != x:
            x = groups[x]
        return x

    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near(a, b)]
    for a, b in pairs:
        x, y = find(a), find(b)
        groups[max(x, y)] = min(x, y)
    heads = {find(d) for d in ids}
    assert heads <= kept  # nothing goes that has no near copy
    assert kept == heads  # and every near copy goes


def test_decontamination_stage(stages, spark):
    before, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hits = hits_plain([(r["doc_id"], r["text"]) for r in before], items)
    got = {r["doc_id"]: r["text"] for r in after}
    for r in before:
        n, hit, _ = hits[r["doc_id"]]
        assert (r["doc_id"] in got) == (hit <= n * 0.5)
        if not hit:
            assert got[r["doc_id"]] == r["text"]
        elif r["doc_id"] in got:
            assert len(re.findall(r"\S+", got[r["doc_id"]])) < len(re.findall(r"\S+", r["text"]))


def test_packing_stage(stages):
    before, after = stages[4]
    want = []
    for r in before:
        ids = np.array([*test_encoder_is_the_tokenizer.t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r["doc_id"], p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after) == sorted(want)
    places = defaultdict(int)
    for r in after:
        places[r["sequence_id"]] += r["length"]
    assert max(places.values()) <= 4096
    assert len(places) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_run_gives_what_the_stages_give(spark, stages):
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages[4][1])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, name):
    df = queries.queries()[name](spark, DATA)
    rows = df.collect()
    assert rows
    if "doc_id" in df.columns and "piece" not in df.columns:
        assert len(rows) == 200
