"""The pipeline on the smallest tables: each stage's decisions against a brute-force version, and the result of ``run``."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from loantide.llm import lines
from tests.llm.test_operators import brute_print

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are absent")


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, SF)
    text = {r.doc_id: r.text for r in first.collect()}
    assert first.columns == docs.columns and 0 < len(text) < docs.count()
    second = corpus_pipeline.line_dedup(spark, first, SF)
    seen, want = set(), {}
    for i in sorted(text):
        split, start, out = text[i].split("\n"), 0, []
        for end in lines.chunk_bounds(split):
            body = "\n".join(split[start:end])
            if end - start < 2 or body not in seen:
                out += split[start:end]
            seen.add(body) if end - start > 1 else None
            start = end
        want[i] = "\n".join(out)
    assert {r.doc_id: r.text for r in second.collect()} == want
    group = {i: i for i in want}
    prints = {i: brute_print(t) for i, t in want.items()}
    for _ in range(3):
        for a in want:
            for b in want:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    third = corpus_pipeline.simhash_near_dedup(spark, second, SF)
    assert Counter(r.doc_id for r in third.collect()) == Counter(set(group.values()))
    result = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in result.collect()} == set(group.values())
