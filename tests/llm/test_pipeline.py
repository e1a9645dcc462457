import corpus_pipeline
from cellgrove.llm import decontaminate, language, lines, mixing, simhash
from cellgrove.llm.common import residue, table
from tests.conftest import SF
from tests.llm.test_contracts import brute_components, brute_hits, brute_lines, brute_print


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    have = sorted((r.doc_id, r.text) for r in docs.collect())
    have = [(i, t) for i, t in have if any(c.isalpha() for c in t or "")]
    reduced = brute_lines(have)
    have = [(i, reduced[i]) for i, _ in have]
    roots = brute_components([brute_print(t) for _, t in have])
    have = [x for k, (x, r) in enumerate(zip(have, roots)) if k == r]
    have = [(i, t) for i, t in have if not brute_hits(t, items)[1]]
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.written(stage(spark, left, SF))
        assert left.columns == docs.columns, name
    assert sorted((r.doc_id, r.text) for r in left.collect()) == have
    drawn = corpus_pipeline.STAGES[-1][1](spark, left, SF)
    assert {r.doc_id for r in drawn.collect()} <= {i for i, _ in have}
    assert all((r.n_chars or 0) == len(r.text) for r in left.collect())


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for docs in (odd.select(*corpus_pipeline.COLUMNS), none):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert set(corpus_pipeline.COLUMNS) <= set(docs.columns)


def test_stage_operators():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["identify_languages", "dedup_lines", "dedup_documents", "remove_benchmark", "mix_sources"]
    assert all(m.__doc__ for m in (decontaminate, language, lines, mixing, simhash, residue))
