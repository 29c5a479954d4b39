"""Each stage of the pipeline on what its predecessor kept, against plain versions."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from speechlake.llm import queries
from speechlake.sources.shared import written
from tests.llm.test_operators import SCHEMA, WORD, near_rows, odd_rows, plain_components, reference_ids

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that go into each stage, and the last one's result."""
    rows = odd_rows() + [(2000 + (i or 0), t, s) for i, t, s in near_rows()]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")}).select(*DOCUMENTS)
    out = [written(docs, "test")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], ""), "test"))
    return [[tuple(r) for r in df.collect()] for df in out], [df.columns for df in out]


def test_columns(stages):
    assert all(c == DOCUMENTS for c in stages[1][:-1]) and len(corpus_pipeline.STAGES) == 5


def test_quality_keeps_clean_documents(stages):
    before, after = stages[0][0], stages[0][1]

    def clean(text):
        w = WORD.findall(text or "")
        n = Counter(zip(w, w[1:], w[2:]))
        covered = {j + d for j, x in enumerate(zip(w, w[1:], w[2:])) if n[x] > 1 for d in range(3)}
        return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)

    assert Counter(after) == Counter(r for r in before if clean(r[1]))


def test_lines_follow_the_counts(stages):
    before, after = stages[0][1], stages[0][2]
    assert Counter(r[0] for r in before) == Counter(r[0] for r in after)
    assert all(r[4] == len(r[1]) for r in after)
    texts = {r[0]: r[1] for r in before}
    assert all(set(r[1].split("\n")) <= set(texts[r[0]].split("\n")) for r in after)
    assert sum(len(r[1]) for r in after) < sum(len(r[1]) for r in before)


def test_one_of_each_group_stays(stages):
    before, after = stages[0][2], stages[0][3]
    want = plain_components([r[:3] for r in before], 5, 80)
    assert Counter(after) == Counter(r for r in before if r[0] is None or want[r[0]] == r[0])
    assert len(after) < len(before)


def test_mix_takes_whole_documents(stages):
    before, after = Counter(stages[0][3]), Counter(stages[0][4])
    assert set(after) <= set(before) and after
    assert all(n <= 2 * before[r] for r, n in after.items())


def test_everything_mixed_is_packed(stages):
    before, after = stages[0][4], stages[0][5]
    path = public_tokenizers.path("word_bpe_49k.json")
    want = Counter()
    for r in before:
        n = len(reference_ids(path, r[1])) + 1
        want.update((r[0], at // 2048, min(2048, n - at)) for at in range(0, n, 2048))
    assert Counter((r[0], r[1], r[3]) for r in after) == want


def test_queries_are_complete():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.SQL) <= set(queries.QUERIES)
