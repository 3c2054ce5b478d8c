"""The pipeline's stages, each against brute force on its own input, and the registered queries on the smallest tables."""

import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fieldglass.llm.toxicity import learn, score_texts

sys.path.insert(0, str(Path(__file__).parent))
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from fieldglass.llm.shared import written

    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, DIR), name)
        out[name] = (docs, made)
        docs = made
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_keep_the_columns(stages):
    for name in list(stages)[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    weights = learn(before, spark.read.parquet(f"{DIR}/labels.parquet"), 3, 1)
    bad = {r.doc_id for r in score_texts(before, weights).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in rows(after)} == {r["doc_id"] for r in rows(before)} - bad


def test_one_of_equal_texts_stays(stages):
    before, after = map(rows, stages["exact_dedup"])
    best = {}
    for r in before:
        key = re.sub(r"[\x20\x09-\x0D]+", "", r["text"] or "")
        best[key] = min(best.get(key, (0, 10**18)), (-len(r["text"] or ""), r["doc_id"]))
    assert sorted(r["doc_id"] for r in after) == sorted(i for _, i in best.values())


def test_one_of_near_texts_stays(stages):
    from test_text_operators import near_by_brute_force

    before, after = map(rows, stages["near_dedup"])
    told = near_by_brute_force([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == [i for i, _, home in told if i == home]


def test_sources_come_near_their_targets(stages):
    before, after = map(rows, stages["mixing"])
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r["source"]] += size(r)
        largest[r["source"]] = max(largest[r["source"]], size(r))
    for r in after:
        taken[r["source"]] += size(r)
    weights, open_, targets = (3, 1, 2), {}, {}
    open_ = {s: weights[k % 3] for k, s in enumerate(sorted(sizes))}
    while True:
        left = 1.5 * sum(sizes.values()) - sum(targets.values())
        full = [s for s, w in open_.items() if left * w / sum(open_.values()) >= 2 * sizes[s]]
        if not full:
            break
        for s in full:
            targets[s] = 2 * sizes[s]
            del open_[s]
    targets |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2


def test_every_copy_is_packed(stages):
    before, after = map(rows, stages["packing"])
    copies, tokens, pieces = Counter(r["doc_id"] for r in before), {}, Counter()
    for r in after:
        tokens[r["doc_id"]] = r["doc_tokens"]
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {i: n * tokens[i] for i, n in copies.items()}


def test_every_query_runs(spark):
    known = entry.queries()
    names = [n for n in known if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11)) and "pipeline" in known
    for name in names:
        assert known[name](spark, DIR).count() > 0
