import zlib

import corpus_pipeline as C
from corpusloom.llm import mixing, secrets, toxicity
from corpusloom.llm.queries import table, tokenizer_paths
from corpusloom.storage import materialize

SF = "/root/testdata/sf0.001"


def test_stages_feed_each_other(spark):
    docs = table(spark, SF, "documents")
    columns, sizes = docs.columns, []
    for name, stage in C.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] == sizes[2] > 0
    mixed = mixing.mix(docs.dropDuplicates(["doc_id"]))
    assert mixed.count() > 0
    found = secrets.find_secrets(docs).where("size(assign) + size(access) > 0").count()
    assert found == 0
    pieces = C.STAGES[-1][1](spark, docs, SF).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_paths()[0])
    wanted = sorted(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sorted(p.doc_tokens for p in pieces if p.start == 0) == wanted
    assert sum(p.length for p in pieces) == sum(wanted)


def test_defined_cases_of_every_stage(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns of names used inside, an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, k string, _row string, bins string, component_id int"
    long = "some words of a long text " * 20000
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "a b c d e f g", None, None, 13), (None, None, None, None, None)]
    rows += [(4, long, "en", "s", len(long)), (5, "password=hunter22 " + "x " * 9, "en", None, 36)]
    docs = spark.createDataFrame([(*r, "1", "2", "3", "4", 5) for r in rows], schema)
    ids = []
    for _, stage in C.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "cases")
        assert docs.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
        assert {tuple(r)[5:] for r in docs.collect()} == {("1", "2", "3", "4", 5)}
        ids.append(sorted(r.doc_id or 0 for r in docs.collect()))
    assert ids[0] == [0, 0, 1, 1, 2, 3, 4, 5] and ids[1] == ids[2] == [0, 0, 1, 2, 3, 4, 5]
    assert {r.text for r in docs.where("doc_id = 5").collect()} <= {"[SECRET] " + "x " * 9}
    pieces = C.STAGES[-1][1](spark, docs, SF)
    assert pieces.where("start = 0").count() == docs.count()
    empty = spark.createDataFrame([], schema)
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0
    assert C.STAGES[-1][1](spark, empty, SF).count() == 0


def test_run_leaves_one_table(spark):
    from corpusloom.storage import made

    before = made(spark)
    C.run(spark, SF)
    assert made(spark) - before <= 3


def test_run_is_the_stages(spark):
    out = C.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_toxic_documents_go(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.count() <= docs.count() and zlib.crc32(b"") == 0
