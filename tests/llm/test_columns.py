"""Stages over documents with columns of any name."""

import pytest

from plumbline.llm import decontaminate, line_dedup, mixing, simhash, substring_dedup, toxicity

NAMES = ["a.b", "a`b", "__kept", "__later", "__file", "__at", "__others", "row", "fp", "slot", "two words", "ü"]


@pytest.fixture(scope="module")
def docs(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    texts = [passage, f"{passage}\nand a line of its own here", "quite another text\nwith a second line", "quite another text\nwith a second line", None, "nothing of note"]
    rows = [(i, text, "en", f"s{i % 2}", len(text or ""), *[f"{name}-{i}" for name in NAMES]) for i, text in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join("`" + name.replace("`", "``") + "` string" for name in NAMES)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def stages(spark):
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0), (4, 0, 1)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([("i", "nothing of note")], "item_id string, text string")
    return {
        "toxicity": lambda docs: toxicity.without_toxic(docs, labels),
        "line dedup": line_dedup.without_repeated_lines,
        "simhash": simhash.one_of_each,
        "decontamination": lambda docs: decontaminate.without_contaminated(docs, items),
        "substrings": substring_dedup.without_later_passages,
        "mixing": mixing.mix,
    }


@pytest.mark.parametrize("stage", ["toxicity", "line dedup", "simhash", "decontamination", "substrings", "mixing"])
def test_columns_of_any_name_come_back(docs, stages, stage):
    alone = stages[stage](docs.select("doc_id", "text", "lang", "source", "n_chars"))
    found = stages[stage](docs)
    names = [name for name in docs.columns if name not in alone.columns[5:]]
    assert found.columns == [*names, *alone.columns[5:]]
    rows = [row.asDict() for row in found.collect()]
    assert rows and all(row[name] == f"{name}-{row['doc_id']}" for row in rows for name in NAMES if name in names)
    expected = sorted(tuple(row[name] for name in ("doc_id", "text")) for row in alone.fillna("").collect())
    assert sorted((row["doc_id"], row["text"] or "") for row in rows) == expected
