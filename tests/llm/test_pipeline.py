import corpus_pipeline
from fixtures import WORD, empty, messy

from haulbook.llm import mixing, pii_crf, piece_transducer, quality_rules, simhash
from haulbook.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns(spark):
    for start in (messy(spark), empty(spark)):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR)
            assert docs.columns == start.columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
        assert last.columns[: len(start.columns)] == start.columns and {"ids", "round_trip"} <= set(last.columns)
        last.collect()


def smallest_of_groups(rows):
    """Ids that are the smallest of their group, by the Jaccard similarity of all pairs of texts."""
    words = [[word.translate(LOWER_LETTERS) for word in WORD.findall(row["text"] or "")] for row in rows]
    sets = [{tuple(text[at : at + 5]) for at in range(max(1, len(text) - 4))} if text else set() for text in words]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if value == old else value for value in root]
    return {min(row["doc_id"] for row, value in zip(rows, root) if value == own) for own in set(root)}


LOWER_LETTERS = {upper: upper + 32 for upper in range(65, 91)}


def test_run_equals_the_stages_by_hand(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = [row for row in quality_rules.judge(docs).collect() if row["kept"]]
    alone = smallest_of_groups(rows)
    assert len(alone) < len(rows)
    assert {row["doc_id"] for row in simhash.one_of_each(docs.where(docs.doc_id.isin([row["doc_id"] for row in rows]))).collect()} == alone
    rows = [row for row in rows if row["doc_id"] in alone]
    kept = docs.where(docs.doc_id.isin([row["doc_id"] for row in rows]))
    field = pii_crf.learned(kept)
    texts = {row["doc_id"]: pii_crf.redacted(row["text"], field.spans(row["text"], pii_crf.base_spans(row["text"]))) for row in rows}
    transducer = piece_transducer.compiled(piece_transducer.read_model(corpus_pipeline.PIECE_MODEL))
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert found and {row["doc_id"] for row in found} <= set(texts)
    for row in found:
        assert row["text"] == texts[row["doc_id"]] and row["ids"] == transducer.encode(row["text"]) and row["round_trip"]
    spent = sum(len(WORD.findall(row["text"])) for row in found)
    whole = sum(len(WORD.findall(text)) for text in texts.values())
    assert 0.2 * whole < spent <= 0.5 * whole
    assert mixing.LEVELS == ("domain", "lang", "source")
