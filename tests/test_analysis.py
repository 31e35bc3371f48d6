"""Profiles, checks and scores on small tables."""

import json
from dataclasses import replace
from datetime import date, datetime, timedelta
from decimal import Decimal
from hashlib import md5

import pytest
from pyspark.sql import functions as F

import plumbline.operators.rules as rl
from plumbline import analyze, measure
from plumbline.operators import checks, dependencies, frequency, profile
from plumbline.operators.checks import Verdict, column_check, run_checks
from plumbline.operators.dataset import ROW_ID, Dataset, ShapeError, first_per_group
from plumbline.operators.findings import worst_first
from plumbline.operators.frequency import frequencies, value_counts
from plumbline.operators.isolation import halved, reason, surviving
from plumbline.operators.propose import propose
from plumbline.operators.rules import NotNull, Regex, RuleSet, Unique
from plumbline.operators.sampling import evenly_spaced_sample
from plumbline.plans.analysis import structural_findings
from plumbline.plans.review import occurring_levels

AS_OF = date(2024, 6, 30)


def found(analysis):
    return {(row.check_id, row["column"]): row for row in analysis.findings.collect()}


#: How columns of the given tables are rewritten as text -> the type that is read from them.
REWRITTEN = {
    "concat('mail', o_custkey, '@shop', o_orderkey % 9, '.example')": "email",
    "CASE WHEN o_orderkey % 5 = 0 THEN concat('mail', o_custkey, '@') ELSE concat('mail', o_custkey, '@shop.example') END": "email",
    "CASE WHEN o_totalprice > 150000 THEN 'yes' ELSE 'no' END": "boolean",
    "date_format(o_orderdate, 'dd.MM.yyyy')": "date",
    "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')": "datetime",
    "CASE WHEN o_orderkey % 5 > 0 THEN date_format(o_orderdate, 'dd MMM yyyy') ELSE o_orderpriority END": "date",
    "cast(o_custkey AS string)": "integer",
    "format_number(o_totalprice, 2)": "float",
    "CASE WHEN o_orderkey % 4 > 0 THEN concat('(', o_totalprice, ')') ELSE o_orderstatus END": "float",
    "o_orderpriority": "categorical",
    "concat(o_orderstatus, '/', o_orderkey)": "identifier",
    "cast(NULL AS string)": "empty",
    "concat('order ', o_orderkey % 700, ' of customer ', o_custkey, ' came to ', o_totalprice, ' and was called ', o_orderpriority)": "text",
}


def test_semantic_types(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    columns = [F.expr(sql).alias(f"value {i}") for i, sql in enumerate(REWRITTEN)]
    review = measure(Dataset(orders.select(F.col("o_orderkey").alias(ROW_ID), *columns), "orders"), AS_OF)
    types = {row.position: row.semantic_type for row in review.profiles.collect()}
    assert [types[i] for i in range(len(types))] == list(REWRITTEN.values())


def test_a_name_of_time_needs_fewer_dates(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    half = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE o_orderpriority END")
    review = measure(Dataset(orders.select(F.col("o_orderkey").alias(ROW_ID), half.alias("shipped_on_date"), half.alias("remark")), "orders"), AS_OF)
    assert {row["column"]: row.semantic_type == "date" for row in review.profiles.collect()} == {"shipped_on_date": True, "remark": False}


def test_profile_numbers(table):
    rows = {r["column"]: r for r in measure(table(price=["1,5", "2", "x", "(3)", "4"], one=["5"]), AS_OF).profiles.collect()}
    stats = rows["price"].numeric
    assert (stats.minimum, stats.maximum, stats.median, stats.negative_count) == (-3.0, 4.0, 1.75, 1)
    assert stats.std_dev == pytest.approx(2.954516, abs=1e-5)
    assert rows["one"].numeric.std_dev == 0.0
    assert rows["price"].sample_values == ["1,5", "2", "x", "(3)", "4"]


def test_clean_tables_raise_no_alarm(spark, table):
    names = spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").orderBy("s_suppkey").limit(60).collect()
    keys = [f"S-{row.s_suppkey:06d}" for row in names]
    sets = [
        table(supplier=[row.s_name for row in names], key_code=keys),
        table(nation=[f"Nation {row.s_nationkey % 6}" for row in names], key_code=keys),
        table(mail=[f"desk.{row.s_suppkey}@post-{row.s_nationkey}.example.org" for row in names], key_code=keys),
        table(opened_on=[f"{row.s_suppkey % 28 + 1:02d}.11.2022" for row in names], key_code=keys),
        table(pieces=[str(3 + row.s_suppkey % 40) for row in names], rate=[f"{7 + row.s_suppkey % 25}.25" for row in names]),
    ]
    for data in sets:
        analysis = analyze(data, as_of=AS_OF, row_ids=False)
        assert analysis.findings.count() == 0, analysis.findings.collect()
        assert analysis.score.first().overall == 100.0


def test_every_defect_is_found(table):
    n = 60
    names = [f"Impresa {i}" for i in range(n)]
    names[5:12] = ["ditta individuale"] * 4 + ["Ditta Individuale"] * 3
    columns = {
        "company": names,
        "email": ["bad@" if i == 3 else None if i == 4 else f"u{i}@example.com" for i in range(n)],
        "signup_date": ["2023-02-30" if i == 1 else "2999-01-01" if i == 2 else "15/01/2024" if i == 3 else f"2024-01-{i % 28 + 1:02d}" for i in range(n)],
        "age": ["199" if i == 7 else str(20 + i % 40) for i in range(n)],
        "revenue": ["-5,000.00" if i == 8 else "a lot" if i == 9 else f"{i + 1},000.50" for i in range(n)],
        "kind": ["Soft ware" if i == 1 else "software" if i == 2 else " Hardware" if i == 3 else ["Software", "Hardware"][i % 2] for i in range(n)],
        "city": ["MalmÃ¶" if i == 5 else "Malmö" for i in range(n)],
        "mixed": [str(i) if i % 2 else f"word {i}" for i in range(n)],
        "currency": ["EUR"] * n,
    }
    analysis = analyze(table(**columns), as_of=AS_OF)
    seen = found(analysis)
    expected = {
        ("placeholder_values", "company"): 7, ("missing_values", "email"): 1, ("invalid_email", "email"): 1,
        ("invalid_date", "signup_date"): 1, ("inconsistent_date_format", "signup_date"): n - 1, ("future_date", "signup_date"): 1,
        ("impossible_numeric", "age"): 1, ("suspicious_numeric", "age"): 1, ("impossible_numeric", "revenue"): 1,
        ("numeric_stored_as_text", "revenue"): n - 1, ("inconsistent_category", "kind"): 31, ("inconsistent_capitalization", "kind"): 30,
        ("leading_trailing_whitespace", "kind"): 1, ("corrupted_encoding", "city"): 1, ("mixed_datatypes", "mixed"): n,
        ("constant_column", "currency"): n,
    }
    assert {key: seen[key].affected_rows for key in expected if key in seen} == expected
    assert seen[("invalid_email", "email")].row_ids == [3]
    assert seen[("placeholder_values", "company")].row_ids == list(range(5, 12))
    assert seen[("inconsistent_category", "kind")].severity == "medium"
    assert "ditta individuale" in json.loads(seen[("placeholder_values", "company")].details)["values"]
    assert worst_first(analysis.findings).first().severity == "high"


def test_duplicates(table):
    rows = [("Rossi Srl", "a"), ("rossi srl ", "A"), ("ROSSI S.r.l.", "b"), ("Bianchi", "c"), (None, None), (None, None)]
    data = table(company=[r[0] for r in rows], note=[r[1] for r in rows])
    seen = found(analyze(data, as_of=AS_OF, only=["exact_duplicate_rows", "probable_duplicate_rows"]))
    exact, probable = seen[("exact_duplicate_rows", None)], seen[("probable_duplicate_rows", None)]
    assert (exact.affected_rows, exact.row_ids, json.loads(exact.details)["duplicate_groups"]) == (2, [1, 5], 2)
    assert (probable.affected_rows, probable.row_ids) == (1, [2])
    assert json.loads(probable.details)["examples"][0]["rows"] == [0, 1, 2]


def test_header_notes_become_a_finding(table):
    data = table(a=["x", "y"])
    seen = found(analyze(Dataset(data.frame, "t", ("Header 1 was empty.",)), as_of=AS_OF, row_ids=False))
    assert seen[("schema_mismatch", None)].affected_rows == 0


def test_score_formula(table):
    analysis = analyze(table(a=["x", None, None, None], b=["1", "2", "3", "4"]), as_of=AS_OF, row_ids=False)
    scores = {row["column"]: row.score for row in analysis.column_scores.collect()}
    total = analysis.score.first()
    assert scores["a"] == 25.0 and scores["b"] == 100.0  # critical: weight 1, three rows of four
    assert (total.overall, total.grade, total.critical, total.info) == (62.5, "C", 1, 1)


def test_missing_cells(spark):
    df = spark.createDataFrame([("a", 1.0), ("", float("nan")), ("  ", None), (None, 2.0)], "t string, x double")
    counts = {row["column"]: row.missing_count for row in profile.missing_counts(Dataset.of(df)).collect()}
    assert counts == {"t": 3, "x": 2}


def test_native_and_nested_columns(spark):
    df = spark.sql(
        "SELECT CAST(id AS INT) AS n, id * 1.5D AS d, CAST(id AS DECIMAL(10,2)) AS m, id % 2 = 0 AS flag, "
        "DATE '2024-01-01' + CAST(id AS INT) AS order_date, array(id) AS nested FROM range(30)"
    )
    rows = {r["column"]: r for r in measure(Dataset.of(df), AS_OF).profiles.collect()}
    assert [rows[c].semantic_type for c in ("n", "d", "m", "flag", "order_date", "nested")] == [
        "integer", "float", "float", "boolean", "date", "unknown"]
    assert rows["m"].numeric.maximum == 29.0 and rows["order_date"].temporal.minimum == "2024-01-01"
    assert rows["flag"].unique_count == 2 and rows["nested"].missing_count == 0


def test_long_texts_are_judged_whole(table):
    long = "word " * 100
    data = table(note=[long, long + " ", long.upper(), "short", " " * 400, "x" * 300 + "é", None])
    review = measure(data, AS_OF)
    row = review.profiles.first()
    assert (row.missing_count, row.unique_count, row.text.max_length) == (2, 4, 501)
    assert (row.top_values[0].value, row.top_values[0]["count"], row.sample_values[0]) == (long.strip(), 2, long)
    assert any(md5(long.strip().encode()).hexdigest() in (r.t or "") for r in review.values.collect())
    fact = review.fact_rows[0]
    assert fact["case_rows"] == 3 and fact["distinct_folded"] == 3
    assert not any("long:" in str(value) for value in [row, *review.values.collect()])


def test_both_paths_agree(table):
    """The checks that aggregates alone can answer say the same as the full analysis."""
    data = table(a=["x", None, " ", "y", "X "], b=["k"] * 5, c=["1", "2", "2", "1", "1"], d=["q", "r", "r", "s", "Q"])
    rules = rl.RuleSet((rl.NotNull("a_given", column="a"), rl.Range("c_small", column="c", maximum=1)))
    only = ["missing_values", "constant_column", "exact_duplicate_rows", "business_rule"]
    columns = ["check_id", "column", "severity", "affected_rows", "row_count", "title"]
    full = analyze(data, rules, AS_OF, row_ids=False, only=only).findings.select(columns).collect()
    structural = structural_findings(data, rules, AS_OF).select(columns).collect()
    assert sorted(map(repr, full)) == sorted(map(repr, structural)) and full


def test_every_text_column_is_checked_for_spellings(spark):
    """However many levels a column has."""
    levels = [f"Level {i}" for i in range(400)] * 3 + ["LEVEL 7", "level 8"]
    data = Dataset.of(spark.createDataFrame([(level,) for level in levels], "level string"))
    found = {r.check_id: r for r in analyze(data, as_of=AS_OF, only=["inconsistent_capitalization"]).findings.collect()}
    row = found["inconsistent_capitalization"]
    assert row.affected_rows == 8 and len(row.row_ids) == 8


def test_wide_tables_are_searched_for_determinants(spark):
    """Sixty-one columns give what sixty do."""
    extra = ", ".join(f"CAST(id % {n} AS STRING) AS x{n}" for n in range(100, 159))
    sql = f"SELECT id AS row_key, CAST(id % 7 AS STRING) AS k, IF(id % 9 = 0, NULL, concat('v', id % 7)) AS v, {extra} FROM range(500)"
    data = Dataset.of(spark.sql(sql).withColumn("__row_id", F.col("row_key")).drop("row_key"))
    assert len(data.columns) == 61
    row = dependencies.find_determinants(data, ["v"]).first()
    assert (row.determinant, row.unrecoverable_rows) == ("k", 0)


def test_median_narrowing_is_exact(spark):
    df = spark.sql("SELECT CASE WHEN id % 3 = 0 THEN 7.0D ELSE pow(id, 1.7) END AS x, id AS y FROM range(20001)")
    values = value_counts(Dataset.of(df)).cache()
    measured = profile.measures(values, AS_OF)
    exact = {0: df.selectExpr("median(x)").first()[0], 1: 10000.0}
    for window in (10, 300, 10**6):
        got = {row.pos: row.median for row in profile.medians(values, measured, window).collect()}
        assert got == exact


def test_evenly_spaced_sample(spark, table):
    data = table(a=[None if i % 5 == 0 else str(i) for i in range(1000)])
    given = [i for i in range(1000) if i % 5]
    got = sorted(row[ROW_ID] for row in evenly_spaced_sample(data, "a", 60).collect())
    assert got == given[:: -(-len(given) // 60)]


def test_results_do_not_depend_on_partitions(spark, table):
    data = table(a=[f"v{i % 7} " if i % 11 else "N/A" for i in range(300)], amount=[str(i * 37 % 101 - 3) for i in range(300)])
    spread = data.with_frame(data.frame.repartition(13))
    one, two = analyze(data, as_of=AS_OF), analyze(spread, as_of=AS_OF)
    keep = ["finding_id", "affected_rows", "row_ids", "details"]
    rows = lambda a: sorted(map(str, a.findings.select(*keep).collect()))
    assert rows(one) == rows(two)


def test_first_per_group(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id")
    got = first_per_group(df, ["g"], [F.asc("id")], 4).groupBy("g").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    assert {r.g: r.ids for r in got.collect()} == {g: [g, g + 3, g + 6, g + 9] for g in range(3)}


@pytest.fixture
def extra_checks():
    """Register checks for one test: ``add(name, verdict, on_rows=False)``."""
    added = []

    def add(name, build, on_rows=False):
        (checks.dataset_check if on_rows else column_check)(name)(build)
        added.append(name)

    yield add
    for name in added:
        checks.COLUMN_CHECKS.pop(name, None), checks.DATASET_CHECKS.pop(name, None)


def always():
    return Verdict(F.lit(True), F.lit("info"), F.lit(0), F.lit("t"), F.lit("e"), F.lit("{}"))


def raising_verdict():
    return Verdict(F.raise_error(F.concat(F.lit("no verdict on "), F.col("column"))).cast("boolean"), F.lit("info"), F.lit(0), F.lit("t"), F.lit("e"), F.lit("{}"))


def unbuildable():
    raise RuntimeError("no")


def test_checks_can_be_added_and_fail_alone(table, extra_checks):
    extra_checks("always", always)
    extra_checks("broken", unbuildable)
    with pytest.raises(ValueError):
        column_check("always")(always)
    review = measure(table(a=["x"]), AS_OF)
    context = checks.Context(review.data, review.facts, 1, AS_OF, row_ids=False)
    assert [r.check_id for r in run_checks(context, ["always", "broken"]).collect()] == ["always"]


def test_checks_that_fail_while_running_are_named_and_skipped(table, extra_checks):
    data = table(a=["x", None, " y"], b=["1", "2", "x"])
    whole = analyze(data, as_of=AS_OF)
    assert whole.skipped.isEmpty() and whole.summary()["skipped_checks"] == []
    extra_checks("always", always)
    extra_checks("broken", unbuildable)
    extra_checks("raising", raising_verdict)
    extra_checks("raising_rows", lambda context: context.findings_that_are_not_there, on_rows=True)
    extra_checks("raising_late", lambda context: checks.as_findings(context.facts, [F.when(raising_verdict().fires, checks.finding(
        "raising_late", "x", F.lit("low"), F.lit(None), F.lit(""), F.lit(""), F.lit(1), F.lit(1), F.lit("{}")))]), on_rows=True)
    run = analyze(data, as_of=AS_OF)
    assert sorted(row.check_id for row in run.skipped.collect()) == ["broken", "raising", "raising_late", "raising_rows"]
    reasons = {row.check_id: row.reason for row in run.skipped.collect()}
    assert "no verdict on" in reasons["raising"] and "RuntimeError: no" == reasons["broken"]
    before, after = ({(r.check_id, r.column, r.affected_rows, tuple(r.row_ids)) for r in each.findings.collect()} for each in (whole, run))
    assert after - before == {("always", "a", 0, ()), ("always", "b", 0, ())} and before <= after
    assert run.score.first() is not None and "raising" in run.summary()["skipped_checks"]


def test_a_failing_rule_leaves_the_other_rules(table):
    data = table(a=["x", None, "y"], b=["1", "2", "3"])
    rules = RuleSet((NotNull("given", column="a"), Regex("broken", column="b", pattern="[0-"), NotNull("also", column="b"), Unique("once", columns=("a",)), NotNull("else", column="z")))
    run = analyze(data, rules, AS_OF)
    assert [(row.check_id, row.part) for row in run.skipped.collect()] == [("business_rule", "broken")]
    found = {r.title: r for r in run.findings.filter("check_id = 'business_rule'").collect()}
    assert set(found) == {"Business rule failed: given", "Rules that do not fit this table: 1"}
    assert found["Business rule failed: given"].row_ids == [1]


def test_when_nothing_runs_the_error_is_raised(table, extra_checks):
    review = measure(table(a=["x"]), AS_OF)
    context = checks.Context(review.data, review.facts.withColumn("row_count", F.raise_error(F.lit("no facts")).cast("bigint")), 1, AS_OF, row_ids=False)
    with pytest.raises(Exception, match="no facts"):
        checks.run_isolated(context, ["missing_values", "constant_column"])
    assert checks.run_isolated(context, ["missing_values"]).skipped.count() == 1


def test_halving_finds_every_culprit():
    tried = []

    def attempt(items):
        tried.append(list(items))
        if any(item < 0 for item in items):
            raise ValueError(str(items))
        return sum(items)

    results, refused = halved([1, 2, -3, 4, 5, -6, 7], attempt)
    assert sum(results) == 19 and [item for item, _ in refused] == [-3, -6]
    assert halved([], attempt) == ([], []) and halved([1, 2], attempt) == ([3], [])

    def growing(items):
        if any(b < a for a, b in zip(items, items[1:])):
            raise ValueError

    kept, refused = surviving([1, 5, 2, 6, 3], growing)
    assert kept == [1, 5, 6] and [item for item, _ in refused] == [2, 3]
    assert reason(ValueError("one\ntwo")) == "ValueError: one" and reason(ValueError()) == "ValueError"


def everything(analysis):
    """What an analysis says, free of the order of its tables."""
    def plain(value):
        if isinstance(value, float):
            return float(f"{value:.8g}")
        if isinstance(value, dict):
            return {key: plain(each) for key, each in value.items()}
        return [plain(each) for each in value] if isinstance(value, list) else value

    def rows(df):
        return sorted((json.dumps(plain(row.asDict(recursive=True)), sort_keys=True, default=str) for row in df.collect()))

    offers = propose(analysis)
    levels = occurring_levels(analysis)
    return [rows(each) for each in (analysis.profiles, analysis.findings, analysis.score, analysis.column_scores, offers.table, offers.mappings, levels)]


def near_unique_columns():
    n = 240
    names = [f"Person number {i}" for i in range(n)]
    for i in range(0, 60, 4):
        names[i] = names[i + 1].upper() if i % 8 else f"  {names[i + 1]} "
    names[100:104], names[150:160], names[170] = ["n/a", "N/A", "unknown", ""], ["same one"] * 10, None
    return {
        "name": names,
        "note": [f"{'long text ' * 40}{i % 200}" if i % 3 else f"Long Text {i}" for i in range(n)],
        "price": [f"${i * 7 % 231},{i % 1000:03d}.50" if i % 50 else "free" for i in range(n)],
        "birth_date": [f"{1900 + i % 130}-{1 + i % 12:02d}-{1 + i % 28:02d}" if i % 7 else f"{1 + i % 28:02d}/{1 + i % 12:02d}/{1950 + i % 40}" for i in range(n)],
        "email": [f"user{i}@mail.org" if i % 20 else f"user{i} at mail" for i in range(n)],
        "kind": [["a", "b", "B", None][i % 4] for i in range(n)],
        "decoded": [f"Malm\u00c3\u00b6 {i}" if i % 30 == 0 else f"Lund {i}" for i in range(n)],
    }


def test_nearly_unique_columns_are_measured_alike(spark, table):
    data = table(**near_unique_columns())
    assert frequencies(data, 30).near_unique.keys() >= {0, 1, 2, 3, 4, 6} and 5 not in frequencies(data, 30).near_unique
    full, near = (everything(analyze(data, as_of=AS_OF, near_unique=least)) for least in (10**9, 30))
    assert near == full


def test_nearly_unique_native_columns_are_measured_alike(spark):
    n, zero = 500, datetime(2020, 1, 1)
    rows = [
        (i, i * 3, None if i % 97 == 0 else i / 7 - 3, Decimal(i * 11) / 100, zero + timedelta(hours=i), i % 3 == 0, 130 - i if i % 5 == 0 else 40, -i if i % 250 == 249 else 10**9 if i == 77 else i)
        for i in range(n)
    ]
    rows += [(n + i, 9, 9.5, None, zero, None, None, 7) for i in range(40)]
    schema = f"{ROW_ID} bigint, id bigint, x double, d decimal(10, 2), created_at timestamp_ntz, flag boolean, age int, amount bigint"
    data = Dataset(spark.createDataFrame(rows, schema), "natives")
    assert frequencies(data, 30).near_unique.keys() >= {0, 1, 2, 3, 6}
    full, near = (everything(analyze(data, as_of=AS_OF, near_unique=least)) for least in (10**9, 30))
    assert near == full


def test_nearly_unique_columns_with_many_wanted_values(spark, table, monkeypatch):
    """Few values fit the first pass, first rows are empty, ids repeat and observed totals are off."""
    monkeypatch.setattr(frequency, "_KEPT_AT_ONCE", 14)
    monkeypatch.setattr(frequency, "_EARLY", 3)
    columns = near_unique_columns()
    data = table(**{name: [None] * 4 + columns[name] for name in ("name", "price", "kind")})
    data = data.with_frame(data.frame.withColumn(ROW_ID, F.col(ROW_ID) - F.col(ROW_ID) % 3).withColumn("number", F.col(ROW_ID) * 7 + F.length("name")))
    full, near = (everything(analyze(data, as_of=AS_OF, near_unique=least))[0] for least in (10**9, 30))
    assert near == full
    monkeypatch.setattr(frequency, "column_sketches", lambda data, positions, of=frequency.column_sketches: {p: replace(s, rows=s.rows + 1) for p, s in of(data, positions).items()})
    assert everything(analyze(data, as_of=AS_OF, near_unique=30))[0] == full


def test_only_nearly_unique_columns_are_kept_short(spark):
    data = Dataset(spark.range(5000).select(F.col("id").alias(ROW_ID), F.col("id").alias("key"), (F.col("id") % 2000).alias("half"), F.concat(F.lit("v"), "id").alias("text"), (F.col("id") % 7).alias("few")), "t")
    known = frequencies(data, 100)
    assert set(known.near_unique) == {0, 1, 2}
    assert (known.near_unique[0].raw, known.near_unique[1].raw, known.near_unique[2].text, known.near_unique[2].folded) == (5000, 2000, 5000, 5000)
    assert known.ordinary.count() == 7 and known.kept.count() <= 45
    assert value_counts(data).count() == 5000 + 2000 + 5000 + 7


def test_long_values_are_shown_whole(table):
    long = ["  " + "many words " * 40 + str(i % 3) for i in range(9)]
    lookalike = "z" * 200 + "… #" + "0" * 32
    for least in (10**9, 2):
        review = measure(table(note=long, mark=[lookalike] * 9, few=list("ababababa")), AS_OF, least)
        rows = {row["column"]: row for row in review.profiles.collect()}
        assert sorted((e.value, e["count"]) for e in rows["note"].top_values) == [(text.strip(), 3) for text in long[:3]]
        assert rows["note"].sample_values == long[:3] and rows["mark"].sample_values == [lookalike]
    assert rows["few"].sample_values == ["a", "b"]


def test_medians_of_all_columns_narrow_together(spark):
    rows = [(0, float(i), 1) for i in range(1001)] + [(1, float(i % 5), 3) for i in range(400)] + [(2, 7.0, 500)] + [(2, float(i), 1) for i in range(300)] + [(3, -1.5, 1), (3, 2.5, 1)]
    values = spark.createDataFrame(rows, "pos int, number double, n bigint")
    measured = values.groupBy("pos").agg(F.sum("n").alias("number_count"), F.countDistinct("number").alias("distinct_raw"))
    expected = {0: 500.0, 1: 2.0, 2: 7.0, 3: 0.5}
    for window, sliced in ((1_000_000, ()), (10, ()), (1, ()), (1_000_000, (0, 2, 3)), (20, (0, 1, 2, 3))):
        assert {row.pos: row.median for row in profile.medians(values, measured, window, sliced).collect()} == expected


def test_shape_guards(spark, table):
    with pytest.raises(ShapeError):
        table(a=["x"]).with_frame(table(a=["x"]).frame.limit(0)).check_shape()
    with pytest.raises(ShapeError):
        table(a=["x", "y"]).check_shape(max_rows=1)
    with pytest.raises(ShapeError):
        table(a=["x"], b=["y"]).check_shape(max_columns=1)
