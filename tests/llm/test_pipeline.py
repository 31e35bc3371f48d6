import corpus_pipeline
import pytest

import __spark_entry__ as entry
from plumbline.llm import queries
from plumbline.llm.common import ROW_KEY, with_row_key

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before the first and after every stage."""
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "docs")
        stage(spark, docs[-1], FOLDER).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash", "decontamination", "mixing"]


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert all(docs.columns == COLUMNS for docs in stages[:-1])
    assert stages[-1].columns[:5] == COLUMNS


def test_every_decision_takes_effect(spark, stages):
    from test_decontaminate import brute as hit
    from test_line_dedup import brute as lines
    from test_line_dedup import plain
    from test_simhash import brute as copies

    from plumbline.llm import toxicity

    rows = [{r.doc_id: r.text for r in docs.collect()} for docs in stages]
    toxic = {r.doc_id for r in toxicity.grade_documents(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet")).collect() if r.toxic}
    assert toxic and rows[1].keys() == rows[0].keys() - toxic
    expected = {}
    kept = lines(list(rows[1].items()))
    for doc, text in rows[1].items():
        n, stay = kept[doc]
        if stay or not n:
            expected[doc] = "\n".join(line for i, line in enumerate(text.split("\n")) if i in stay or not plain(line)) if n else text
    assert rows[2] == expected
    first = {doc for doc, _, smallest in copies(list(rows[2].items())) if doc == smallest}
    assert rows[3].keys() == first
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {doc for doc, *_, bad in hit(list(rows[3].items()), items) if not bad}
    assert rows[4].keys() == clean
    assert rows[5] == rows[4]


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    found = sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).drop("slot", "block", "released", "deadline", "in_mix").collect()))
    assert found == sorted(map(tuple, stages[-1].select(COLUMNS).collect()))


def test_all_queries_are_registered():
    names = entry.queries().keys()
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 11)) and "pipeline" in names
    assert queries.QUERIES.keys() <= names


def test_row_keys_name_rows(spark, documents):
    rows = documents([(1, "a"), (1, "a"), (None, None)])
    keyed = with_row_key(rows)
    assert len({tuple(r) for r in keyed.select(*ROW_KEY).collect()}) == 3
    with pytest.raises(ValueError, match="__file"):
        with_row_key(keyed)
