"""Each stage on its own input, held against a brute-force version."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
import test_line_dedup
import test_packing
import test_simhash

from quarry.llm import decontaminate
from quarry.llm.queries import tokenizer_path
from quarry.session import cut


@pytest.fixture(scope="module")
def outputs(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], sf)))
    return out


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_columns(outputs):
    assert [f.columns for f in outputs[1:-1]] == [outputs[0].columns] * 4
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]


def test_quality(outputs, spark):
    before, after = rows(outputs[0]), rows(outputs[1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    assert all(after[i] == before[i] for i in after)
    assert sum(labels[i] == 1 for i in labels if i not in after) <= 0.02 * len(labels)
    assert sum(labels[i] == 0 for i in labels if i in after) <= 0.2 * sum(v == 0 for v in labels.values())


def test_lines(outputs):
    before, after = rows(outputs[1]), rows(outputs[2])
    lines = sorted({line for r in before.values() for line in r.text.split("\n") if line.strip()})
    shared = {}
    for n, line in enumerate(lines):  # a near pair has two words in a row in common, or is short
        own = line.split(" ")
        for gram in {("short", len(line) // 3 + d) for d in (0, 1) if len(own) < 12} | set(zip(own, own[1:])):
            shared.setdefault(gram, []).append(n)
    near = {}
    for own in shared.values():
        for a in own:
            near.setdefault(lines[a], set()).update(lines[b] for b in own if a != b and abs(len(lines[a]) - len(lines[b])) < 60)
    seen = set()
    for i in sorted(before):
        left = []
        for line in before[i].text.split("\n"):
            if not line.strip() or line not in seen and not any(x in seen and test_line_dedup.is_near(x, line) for x in near.get(line, ())):
                left.append(line)
            if line.strip():
                seen.add(line)
        text = "\n".join(left)
        if text.strip() or text == before[i].text:
            assert after[i].text == text and after[i].n_chars == len(text)
        else:
            assert i not in after
    assert after.keys() <= before.keys()


def test_near_duplicates(outputs):
    before, after = rows(outputs[2]), rows(outputs[3])
    labelled = test_simhash.brute_components([(i, test_simhash.brute_print(before[i].text, 5)) for i in sorted(before)])
    assert after.keys() == {component for _, _, component in labelled}
    assert all(after[i] == before[i] for i in after)


def test_benchmark(outputs, spark):
    before, after = rows(outputs[3]), rows(outputs[4])
    items = [decontaminate.normalised(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    grams = {t[i : i + 30] for t in items for i in range(len(t) - 29)}
    for i, r in before.items():
        text = decontaminate.normalised(r.text)
        if any(t in text for t in items):
            assert i not in after
        elif not any(text[j : j + 30] in grams for j in range(len(text) - 29)):
            assert after[i] == r


def test_packing_stage(outputs):
    docs = [(r.doc_id, r.text) for r in outputs[4].collect()]
    padding, total = test_packing.check(outputs[5].collect(), docs, tokenizer_path())
    assert padding < 0.03 * total


def test_one_of_each_with_odd_rows(spark):
    from quarry.llm import simhash

    rows = [(None, "same text here and there", 1), (None, "same text here and there", 1), (7, "same text here and there", 2), (7, "same text here and there", 2), (None, "other words that stand alone", 3), (9, None, 4), (8, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int").withColumnRenamed("h", "a.b")
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([(7, "same text here and there", 2), (None, "other words that stand alone", 3), (8, "", 5)], key=repr)
