import inspect

import corpus_pipeline
from factweave.llm import decontam, packing, toxicity
from factweave.llm.common import table

from .test_decontam import brute as overlaps
from .test_linedup import brute as cut
from .test_minhash import brute as near


def rows_of(frame):
    return sorted((r.doc_id, r.text) for r in frame.collect())


def test_stages_are_the_operators_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]


def test_each_stage_matches_brute_force_on_its_own_input(spark, folder):
    docs = table(spark, folder, "documents")
    stages = [f for _, f in corpus_pipeline.STAGES]

    model = toxicity.fit(docs, table(spark, folder, "labels"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    calm = stages[0](spark, docs, folder).cache()
    assert rejected and rows_of(calm) == [r for r in rows_of(docs) if r[0] not in rejected]
    assert calm.schema == docs.schema

    before = rows_of(calm)
    after = [(i, t) for (i, t), (_, old) in zip(cut(before), before) if t.split() or not old.split()]
    cleaned = stages[1](spark, calm, folder).cache()
    assert rows_of(cleaned) == after and len(after) < len(before)
    assert cleaned.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in cleaned.collect())

    groups = {doc: c for doc, _, c in near(after, 5, 80)}
    single = stages[2](spark, cleaned, folder).cache()
    assert rows_of(single) == [r for r in after if groups[r[0]] == r[0]]

    items = [(r.item_id, r.text) for r in table(spark, folder, "benchmark").collect()]
    leaked = {doc for doc, item, _ in near_overlaps(rows_of(single), items)}
    clean = stages[3](spark, single, folder).cache()
    assert rows_of(clean) == [r for r in rows_of(single) if r[0] not in leaked]

    packed = stages[4](spark, clean, folder).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows_of(clean)}
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {r.doc_id for r in packed}


def near_overlaps(docs, items):
    """Overlaps by brute force of the documents that share a run of five words with an item."""
    words = lambda t: decontam.words_of((t or "").encode())
    runs = {tuple(w[k : k + 5]) for _, t in items for w in [words(t)] for k in range(len(w) - 4)}
    some = [(i, t) for i, t in docs if any(tuple(w[k : k + 5]) in runs for w in [words(t)] for k in range(len(w) - 4))]
    return overlaps(some, items)


def test_packing_is_padded_little(spark, folder):
    from factweave.llm.queries import tokenizer_path

    rows = packing.pack(table(spark, folder, "documents"), tokenizer_path()).collect()
    assert sum(r.length for r in rows) / 4096 / len({r.sequence_id for r in rows}) > 0.95
