"""Work over large tables: in how many tasks it runs, and what a task holds."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from plumbline.catalogue import queries, views
from plumbline.operators import checks, dataset, dependencies, frequency, ground
from plumbline.operators.dataset import ROW_ID, Dataset
from plumbline.plans.analysis import analyze, measure

AS_OF = date(2024, 6, 30)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def one_part(spark):
    """Many rows that are read as one part, with gaps, long text and a row id that is sometimes null."""
    rows = spark.range(400).select(
        F.when(F.col("id") % 50 > 0, F.col("id")).alias(ROW_ID),
        F.concat(F.lit("c"), F.col("id") % 7).alias("code"),
        F.when(F.col("id") % 9 > 0, F.concat(F.lit("name "), F.col("id") % 7)).alias("name"),
        F.concat(F.lit("n"), F.col("id")).alias("number"),
        F.repeat(F.concat(F.lit("word "), F.col("id") % 3), 60).alias("note"),
    )
    return Dataset(rows.coalesce(1), "one part")


def facts_of(review):
    return sorted(map(repr, review.fact_rows)), sorted(map(repr, review.profiles.collect()))


def test_a_table_read_in_one_part_is_spread_before_its_cells_are_judged(one_part, monkeypatch):
    whole = measure(one_part, AS_OF)
    monkeypatch.setattr(dataset, "ROWS_PER_TASK", 10, raising=False)
    parts = measure(one_part, AS_OF)
    assert whole.data.frame.rdd.getNumPartitions() == 1
    assert parts.data.frame.rdd.getNumPartitions() > 1
    assert facts_of(parts) == facts_of(whole)
    order = lambda data: sorted(map(repr, data.frame.collect()))
    assert order(parts.data) == order(one_part)


def test_nearly_unique_cells_are_read_from_the_spread_table(one_part, monkeypatch):
    monkeypatch.setattr(dataset, "ROWS_PER_TASK", 10, raising=False)
    known = frequency.frequencies(one_part, 50)
    assert known.near_unique and known.cells().rdd.getNumPartitions() > 1


def test_released_analyses_read_the_table_as_given(one_part, monkeypatch):
    monkeypatch.setattr(dataset, "ROWS_PER_TASK", 10, raising=False)
    analysis = analyze(one_part, None, AS_OF, row_ids=False, only=["missing_values"])
    assert analysis.data.frame.rdd.getNumPartitions() > 1
    analysis.release()
    assert analysis.data.frame.count() == 400 and analysis.data.frame.rdd.getNumPartitions() == 1


def test_pairs_of_columns_are_hashed_not_sorted(one_part):
    pairs = dependencies.pair_statistics(one_part, ["name"])
    assert "HashAggregate" in plan(pairs) and "SortAggregate" not in plan(pairs)
    found = {row.determinant: row for row in pairs.collect()}
    assert found["code"].decides and found["code"].varies and found["code"].gap_rows == 45
    assert not found["note"].decides and found["note"].distinct_keys == 3
    best = dependencies.find_determinants(one_part, ["name"]).collect()
    assert [(row.determinant, row.target, row.recoverable_rows) for row in best] == [("code", "name", 45)]


def test_keys_of_one_value_do_not_make_a_column_vary(spark):
    rows = spark.createDataFrame([(i, str(i % 4), None if i == 3 else "x") for i in range(40)], f"{ROW_ID} bigint, key string, value string")
    pairs = dependencies.pair_statistics(Dataset(rows), ["value"]).collect()
    assert [(row.determinant, row.decides, row.varies) for row in pairs] == [("key", True, False)]


def test_long_texts_are_looked_up_without_sorting_them(one_part):
    form = one_part.frame.select(frequency.short_form(F.col("note")).alias("form")).first().form
    found = frequency._distinct_wholes(one_part, [{"pos": 3, "form": form}])
    assert "SortAggregate" not in plan(found)
    assert [len(row.whole) for row in found.collect()] == [360]
    assert frequency.whole_texts(one_part, {3: {form, "short"}}) == {(3, form): found.first().whole}


def test_parts_without_rows_are_no_tasks(spark, one_part, monkeypatch):
    monkeypatch.setattr(dataset, "ROWS_PER_TASK", 10)
    empty = spark.range(0, 40, 1, 40).filter("id < 0").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in one_part.frame.schema])
    split = Dataset(empty.union(one_part.frame), "rows in one of many parts")
    assert {sketch.parts for sketch in frequency.column_sketches(split, [0, 1]).values()} == {1}
    review = measure(split, AS_OF)
    assert review.data.frame.select(F.spark_partition_id()).distinct().count() > 1
    assert facts_of(review) == facts_of(measure(one_part, AS_OF))


def test_identity_keys_are_worked_out_once(spark):
    names = ["Ann", "ann ", "Bo", "Bo", None, "", "Cy", "CY.", "Cy"]
    data = Dataset(spark.createDataFrame([(i, name, i % 2) for i, name in enumerate(names)], f"{ROW_ID} bigint, full_name string, side int"))
    colliding = checks.colliding_identities(data, ["full_name"])
    joined = checks._identities(data, ["full_name"]).join(F.broadcast(colliding), "identity")
    for found in (colliding, joined):
        assert not [line for line in plan(found).splitlines() if "Filter" in line and "regexp_replace" in line]
    assert sorted(map(tuple, colliding.collect())) == [("ann", 2, 2, 0), ("bo", 2, 2, 2), ("cy", 3, 1, 7)]
    assert sorted(row[ROW_ID] for row in joined.collect()) == [0, 1, 2, 3, 6, 7, 8]


def test_only_chosen_cells_are_judged(spark, one_part, monkeypatch):
    cells = frequency.judged_cells(one_part, [1, 2, 3])
    wanted = cells.filter("t IN ('name 3', 'n7') OR is_long").select("pos", F.unhex(F.md5("fold")).alias("digest")).distinct()
    few = frequency._cells_of_forms(one_part, [1, 2, 3], wanted)
    monkeypatch.setattr(frequency, "lookup", lambda df: df)
    many = frequency._cells_of_forms(one_part, [1, 2, 3], wanted)
    rows = lambda df: sorted(map(repr, df.select(*frequency.VALUE_COLUMNS).collect()))
    assert rows(few) == rows(many) and len(rows(few)) > 400
    lines = few._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Join LeftSemi" in line)
    assert any("RLIKE" in line for line in lines[:at]) and not any("RLIKE" in line for line in lines[at:])


@pytest.fixture
def many_names(spark, tmp_path):
    """Customers of as many names as rows, one of them a proposed word; it is neither early nor frequent."""
    names = F.when(F.col("id") == 260, " rOME ").otherwise(F.concat(F.lit("Name "), F.col("id")))
    rows = spark.range(300).select(F.col("id").alias("c_custkey"), names.alias("c_name"), F.concat(F.lit("SEGMENT"), F.col("id") % 4).alias("c_mktsegment"))
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_rules_are_grounded_in_every_value_of_nearly_unique_columns(spark, many_names, monkeypatch):
    review = measure(views.dataset(spark, many_names, "dirty_customer"), AS_OF, 30)
    assert {0, 1, 2} <= review.frequencies.near_unique.keys()
    monkeypatch.setattr(queries, "review_of", lambda spark, sf_dir, name: review)
    accepted = dict(map(tuple, queries.ground_rules(spark, many_names).collect()))
    assert len(accepted) == 18
    assert {name for name, known in accepted.items() if known and name.endswith("_words")} == {"full_name_words", "city_words", "currency_words"}


def test_only_proposed_levels_are_told_apart(spark):
    schema = "suggestion bigint, name string, rule_type string, `column` string, minimum double, maximum double, allowed_values array<string>, confidence double"
    words = [["v7", "nowhere"], [" V399 ", None], ["v400"], [None], []]
    rules = spark.createDataFrame([(i, f"r{i}", "allowed_values", "c", None, None, each, 0.9) for i, each in enumerate(words)], schema)
    levels = spark.range(400).select(F.lit("c").alias("column"), F.concat(F.lit("v"), F.col("id")).alias("t"))
    grounded = ground.ground_rules(rules, spark.createDataFrame([("c",)], "`column` string"), levels)
    assert sorted(row.suggestion for row in grounded.filter("accepted").collect()) == [0, 1]
    lines = grounded._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = lines[next(i for i, line in enumerate(lines) if "Range (" in line)::-1]
    first = next(line for line in above if "Join" in line or "Aggregate" in line)
    assert "Join LeftSemi" in first
