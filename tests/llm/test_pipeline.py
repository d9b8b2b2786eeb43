import hashlib
import re

import numpy as np

import corpus_pipeline
from cdmspark.llm import toxicity
from cdmspark.llm.common import table
from cdmspark.llm.mixing import make_plan
from tests.conftest import SF_SMALL
from tests.llm.test_pieces import brute as brute_ids
from tests.llm.test_simhash import brute_components, brute_fp

WORDS = re.compile("[^\\x20\\x09-\\x0D]+")


def brute(spark, rows):
    """The rows of the pipeline, stage by stage, over (doc_id, text, source)."""
    model = toxicity.fit(toxicity.training_rows(table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")))
    scorer = model.scorer()
    rows = [r for r in rows if scorer(r[1]) < 0.5 or not scorer.judge(r[1])[1]]
    last = {}
    for r in sorted(rows):
        last[r[1]] = r
    rows = sorted(last.values())
    comp = brute_components([brute_fp(t) for _, t, _ in rows])
    rows = [r for k, r in enumerate(rows) if comp[k] == k]
    size = {r[0]: len(WORDS.findall(r[1])) for r in rows}
    sums = {}
    for i, _, s in rows:
        sums[s] = sums.get(s, 0) + size[i]
    plan = make_plan([((s,), n) for s, n in sums.items()], (5, 2, 1), 1.5, 2)
    taken = {p[0]: t for p, _, t in plan.patterns}
    out = []
    for s, n in sums.items():
        copies, extra = divmod(taken[s], n)
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"mix|{r[0]}".encode()).hexdigest()):
            part = min(extra, size[i])
            extra -= part
            out += [(i, t)] * copies
            if part == size[i]:
                out.append((i, t))
            elif part:
                out.append((i, t[:list(WORDS.finditer(t))[part - 1].end()]))
    return out


def test_run_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, SF_SMALL, "documents").collect()]
    want = brute(spark, docs)
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert sorted((r.doc_id, len(r.ids), r.n_pieces) for r in got) == sorted(
        (i, len(x), len(x)) for i, x in ((i, brute_ids(t)) for i, t in want))
    assert all(r.decoded for r in got)
    assert len({(r.doc_id, tuple(r.ids)) for r in got}) == len({(i, t) for i, t in want})


def test_stages_keep_the_columns_and_survive_odd_rows(spark):
    schema = table(spark, SF_SMALL, "documents").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "a b", None, None, 3),
                                 (3, "q " * 100_000, "en", "a", 200_000)], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_SMALL)
            assert docs.columns == schema.names and docs.dtypes == odd.dtypes
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
        assert all(r.decoded for r in rows)
    assert len(corpus_pipeline.STAGES) == 5
    assert np.array(rows).size == 0


CLASHES = ["__word", "__bits", "__maybe", "__h", "__sha", "__row", "__id", "__of", "__hash", "__stays", "__key", "__size", "__order",
           "__sources", "__taken", "__copies", "__extra", "__cut", "__rest", "__part", "row", "n", "a.b", "a`b", "s", "fp", "root"]


def test_stages_leave_clashing_columns_alone(spark, tmp_path):
    rows = [(k, f"some words of text {k % 7} " * (4 + k % 3), "en", "ab"[k % 2], 1) for k in range(40)] + [(41, None, None, None, None)]
    docs = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in CLASHES]) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
                                     "`" + c.replace("`", "``") + "` string" for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        got = stage(spark, docs, SF_SMALL)
        assert got.columns == docs.columns, name
        for r in got.collect():
            assert [r[c] for c in CLASHES] == [f"{c}{r['doc_id']}" for c in CLASHES], name


def test_labels_of_one_kind_do_not_empty_the_corpus(spark, tmp_path):
    schema = table(spark, SF_SMALL, "documents").schema
    docs = spark.createDataFrame([(k, f"clean words {k}", "en", "a", 10) for k in range(20)], schema)
    for k, toxic in enumerate(([1] * 20, [1] * 15 + [0] * 5, [0] * 20)):
        labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], table(spark, SF_SMALL, "labels").schema)
        labels.write.parquet(f"{tmp_path}/{k}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/{k}").count() == 20
