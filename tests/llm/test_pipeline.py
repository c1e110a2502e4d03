from __future__ import annotations

import corpus_pipeline
from roundforge.llm.common import written


def test_stages_keep_clean_documents_and_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = [docs.count()]
    first = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, small), f"test-{i}")
        if i < 4:
            assert docs.columns == first
            n.append(docs.count())
    assert n[0] > n[1] >= n[2] > n[3] == n[4] > 0.5 * n[0]
    assert docs.select("doc_id").distinct().count() == n[4]


def test_stages_on_odd_and_empty_tables(spark, odd, none, small):
    for docs in (odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), none):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = written(stage(spark, docs, small), f"odd-{i}")
        assert docs.count() >= 0


def test_stages_decide_by_row(spark, odd, small):
    """Repeated and null ids, as the odd table has them."""
    from roundforge.llm import langid, ngram_join, quality_rules

    many = odd.unionByName(odd).select("doc_id", "text")
    got = sorted((r["doc_id"] or 0, (r["text"] or "").strip()[:9]) for r in ngram_join.deduplicate(many).collect())
    texts = {(r["text"] or "") for r in many.collect()}
    assert len(got) == len({g[1] for g in got}) <= len(texts) and (8, "x") in got and (0, "a row wit") in got
    model = langid.fit(spark.read.parquet(f"{small}/documents.parquet"))
    rows = [(1, "plain words of a text here"), (1, "12 34"), (None, "words of another text here"), (None, "--")]
    kept = langid.language_filter(spark.createDataFrame(rows, "doc_id long, text string"), model, 8.0).collect()  # invented training text, so real words cost more
    assert sorted(r["text"] for r in kept) == sorted([rows[0][1], rows[2][1]])
    long = " ".join(f"word{chr(97 + i)}" for i in range(20))
    rows = [(1, long, "h"), (1, "short", "h"), (None, long, "h"), (None, "short", "h")]
    kept = quality_rules.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, long), (1, long)]


def test_the_pipeline_runs_on_the_whole_odd_table(spark, odd, small):
    docs = odd.unionByName(odd)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, small), f"whole-odd-{i}")
        if i == 2:
            # 4, 5, 6 and 10 hold the same windows, 7 and 9 and the null id are texts of their own, each came twice
            assert docs.count() == docs.select("text").distinct().count()
    assert docs.count() > 0


def test_a_plain_version_of_the_pipeline(spark, small):
    """The documents that run() packs are those that plain versions of the filtering stages keep."""
    from test_ngram_join import brute

    from roundforge.llm import langid, quality_rules

    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, small).select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    judged = {r["doc_id"] for r in quality_rules.judge(docs).filter("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in judged and langid.normal_bytes(r["text"])]
    assert packed == {root for root, _ in brute(rows).values()}


def test_tables_go_once_nothing_needs_them(spark, small):
    """A stage's own tables go when the next one has its written output, not before, and not those of results that are still to be read."""
    from roundforge.llm.common import tables

    docs = spark.read.parquet(f"{small}/documents.parquet")
    first, again = corpus_pipeline.quality(spark, docs, small), corpus_pipeline.quality(spark, docs.limit(50), small)
    made = set(corpus_pipeline._MADE["quality"])
    assert made <= tables()
    lazily = corpus_pipeline.language(spark, first, small)  # its input reads the tables
    assert made <= tables() and lazily.count() > 0 and again.count() > 0
    kept = written(first, "test-kept")
    corpus_pipeline.near_duplicates(spark, kept, small)
    assert not made & tables() and kept.count() > 0
    results = [corpus_pipeline.run(spark, small) for _ in range(2)]
    assert len({tuple(sorted((r["doc_id"], r["start"], r["length"]) for r in x.collect())) for x in results}) == 1
