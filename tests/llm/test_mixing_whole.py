from collections import defaultdict

import corpus_pipeline


def test_the_pipeline_mixes_whole_documents(spark):
    """No text is cut or loses its line breaks, and each source is within half a document of its target."""
    from corpusloom.llm import mixing

    rows = [(i, "\n".join(f"d{i}w{j}" for j in range(5 + i * 7 % 30)), f"s{i % 5}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts, target = {i: t for i, t, _ in rows}, {r.k[1:]: r.target for r in mixing.mix(df).collect()}
    words = defaultdict(int)
    for r in corpus_pipeline.mix_sources(spark, df, "").collect():
        assert r.text == texts[r.doc_id]
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - target[s]) <= 17 + 1 for s in target)
