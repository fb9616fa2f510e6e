"""The pipeline's stages, each against a plain form on its own input."""

import collections
import zlib

import corpus_pipeline
from tests.llm.test_operators import SF, plain_links, plain_measures, plain_spans, whole_ids, words_of_rows


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, None
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = dict(words_of_rows(docs))
        step(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
            after = dict(words_of_rows(docs))
            assert set(after) <= set(before)
        if name == "quality_rules":
            base = {d for d, t in before.items() if (m := plain_measures(t))[0] >= 50 and 100 * m[4] <= 50 * m[0]}
            assert set(after) <= base and len(after) >= 0.8 * len(base)
        elif name == "near_copies":
            assert set(after) == {d for d, _, c in plain_links(list(before.items()), 5, 80) if d == c}
        elif name == "benchmark":
            leaks = {d for d, t in before.items() if any(x in t for x in items)}
            assert not leaks & set(after) and len(after) >= len(before) - len(leaks) - 2
        elif name == "personal_data":
            assert set(after) == set(before)
            assert all(plain_spans(t) == "" for t in after.values())
            assert all(after[d] == t for d, t in before.items() if plain_spans(t) == "")
        elif name == "packing":
            want = collections.Counter()
            for d, ids in zip(before, whole_ids("byte_bpe_50k.json", list(before.values()), True)):
                want.update((d, a, min(2048, len(ids) - a), zlib.crc32(ids[a:a + 2048].tobytes())) for a in range(0, len(ids), 2048))
            assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in docs.collect()) == want


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0
