"""Rules, dependencies, corrections, grounding, files and history."""

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from plumbline import History, advise, analyze, clean, decide, load_rules, offer, parse_rules, read_csv
from plumbline.catalogue.views import dataset
from plumbline.operators import dependencies, ground, report
from plumbline.operators import rules as rl
from plumbline.operators.apply import apply_corrections, approved_in_order, without_repeats
from plumbline.operators.dataset import ROW_ID, Dataset, ShapeError, collecting
from plumbline.operators.propose import Proposals, may_impute, propose
from plumbline.operators.rules import NotNull, Range, RuleSet, Unique
from plumbline.sources import readers, writers
from plumbline.sources.history import redact

AS_OF = date(2024, 6, 30)


def values(data, column):
    return [row[column] for row in data.frame.orderBy(ROW_ID).collect()]


def approve(spark, offers, *actions):
    rows = offers.table.filter(F.col("action").isin(*actions)).collect()
    return decide(spark, [row.proposal_id for row in rows])


def counted(data, rule):
    return rl.evaluate(data, rl.RuleSet((rule,)), AS_OF).first().affected


# ------------------------------------------------------------------ rules


def test_rule_kinds(table):
    data = table(
        a=["1", "5", "x", "", None, "1,200"], b=["2", "4", "9", "9", "9", "1"], s=["Yes", "no ", "MAYBE", " ", None, "yes"],
        d=["2024-06-30", "2024-07-02", "01/08/2024", "soon", "", None], e=["2024-06-01"] * 6,
    )
    assert counted(data, rl.NotNull("r", column="a")) == 2
    assert counted(data, rl.Range("r", column="a", minimum=2, maximum=100)) == 2
    assert counted(data, rl.AllowedValues("r", column="s", values=("YES", "no"))) == 1
    assert counted(data, rl.AllowedValues("r", column="s", values=("yes", "no"), case_sensitive=True)) == 2
    assert counted(data, rl.NoFutureDates("r", column="d")) == 2
    assert counted(data, rl.NoFutureDates("r", column="d", tolerance_days=5)) == 1
    assert counted(data, rl.Regex("r", column="s", pattern="[A-Z]")) == 2
    assert counted(data, rl.Unique("r", columns=("s",))) == 1
    assert counted(data, rl.Unique("r", columns=("b",))) == 2
    assert counted(data, rl.Comparison("r", left="a", operator="<", right="b")) == 2
    assert counted(data, rl.Comparison("r", left="e", operator=">=", right="d", compare_as="date")) == 3


def test_rule_findings(table):
    rules = rl.RuleSet((
        rl.NotNull("need_a", column="a"), rl.Unique("one_ab", columns=("a", "b")), rl.Range("lost", column="z", minimum=1),
        rl.NotNull("off", column="a", enabled=False), rl.Range("fine", column="b", minimum=0),
    ))
    analysis = analyze(table(a=["x", None, None], b=["1", "2", "2"]), rules, AS_OF, only=["business_rule"])
    rows = {row.title: row for row in analysis.findings.collect()}
    assert rows["Business rule failed: need_a"].row_ids == [1, 2] and rows["Business rule failed: need_a"].severity == "critical"
    assert rows["Business rule failed: one_ab"]["column"] is None and rows["Business rule failed: one_ab"].row_ids == [2]
    assert rows["Rules that do not fit this table: 1"].affected_rows == 0
    assert len(rows) == 3


@pytest.mark.parametrize("entry", [
    {"name": "r", "type": "nope", "column": "a"}, {"name": "r", "type": "range", "column": "a"},
    {"name": "r", "type": "range", "column": "a", "minimum": 3, "maximum": 1}, {"name": "r", "type": "allowed_values", "column": "a", "values": []},
    {"name": "", "type": "not_null", "column": "a"}, {"name": "r", "type": "not_null", "column": "a", "severity": "awful"},
    {"name": "r", "type": "not_null"}, {"name": "r", "type": "comparison", "left": "a", "right": "b", "operator": "~"},
    {"name": "r", "type": "not_null", "column": "a", "colour": "red"},
])
def test_bad_rules_are_refused(entry):
    with pytest.raises(rl.RuleError):
        parse_rules({"rules": [entry]})


def test_rule_files(spark, tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text("name: demo\nrules:\n  - {name: a, type: not_null, column: x}\n  - {name: b, type: allowed_values, column: x, values: [1, 2]}\n")
    rules = load_rules(path)
    assert [r.name for r in rules.rules] == ["a", "b"] and rules.rules[1].values == ("1", "2")
    assert rl.load_rules_or_none(tmp_path / "absent.yaml") is None
    with pytest.raises(rl.RuleError):
        rl.RuleSet((rl.NotNull("a", column="x"), rl.NotNull("a", column="y")))
    with pytest.raises(rl.RuleError):
        rl.check_patterns(spark, rl.RuleSet((rl.Regex("r", column="x", pattern="(["),)))


# ------------------------------------------------------------------ dependencies and imputation


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def nations(spark):
    """Customers with the keys and names of their nations, some of either missing, as a dataset and as rows by id."""
    data = dataset(spark, SF, "gappy_nation")
    return data, {row[ROW_ID]: row for row in data.frame.collect()}


def known_names(rows):
    return {row.nation_key: row.nation_name for row in rows.values() if row.nation_key and row.nation_name}


def test_determinants(nations):
    data, rows = nations
    names, gaps = known_names(rows), [row for row in rows.values() if not row.nation_name]
    row = dependencies.find_determinants(data, ["nation_name"]).first()
    assert (row.determinant, row.distinct_keys) == ("nation_key", len(names))
    assert row.recoverable_rows == sum(gap.nation_key in names for gap in gaps)
    assert row.unrecoverable_rows == sum(gap.nation_key not in names for gap in gaps)


def test_unrelated_columns_determine_nothing(nations):
    data, _ = nations
    alone = data.with_frame(data.frame.drop("nation_key"))
    assert dependencies.find_determinants(alone, ["nation_name"]).isEmpty()


def test_gaps_are_recovered_before_they_are_invented(spark, nations):
    data, rows = nations
    names = known_names(rows)
    analysis = analyze(data, as_of=AS_OF, only=["missing_values"])
    offers = offer(analysis)
    recover = offers.table.filter("action = 'fill_from_related' AND `column` = 'nation_name'").first()
    filled = {i: names[row.nation_key] for i, row in rows.items() if not row.nation_name and row.nation_key in names}
    assert (recover.affected_rows, recover.destructive) == (len(filled), False)
    first = min(filled)
    assert (recover.preview[0].row_id, recover.preview[0].after) == (first, filled[first])
    cleaned = apply_corrections(analysis.data, offers, decide(spark, [recover.proposal_id]))
    after = {row[ROW_ID]: row.nation_name for row in cleaned.data.frame.collect()}
    assert after == {i: filled.get(i, row.nation_name) for i, row in rows.items()}
    assert cleaned.applied.first().rows_changed == len(filled)


def test_gaps_that_no_row_answers_go_to_a_person(nations):
    data, rows = nations
    lost = sorted(known_names(rows))[::4]
    blank = F.when(~F.col("nation_key").isin(lost) & F.col("nation_name").isNotNull(), F.col("nation_name"))
    some = data.frame.filter(F.col("nation_name").isNotNull() & F.col("nation_key").isNotNull()).withColumn("nation_name", blank)
    offers = propose(analyze(data.with_frame(some), as_of=AS_OF, row_ids=False, only=["missing_values"]))
    row = offers.table.filter("`column` = 'nation_name'").first()
    assert row.action == "manual_review" and "nation_key" in row.description


def test_imputation(table):
    n = [str(i) if i != 3 else None for i in range(1, 11)]
    data = table(quantity=n, municipio=n, geo_x=n, tie=["a", "b", None] + ["a", "b"] * 3, mode=["a", "a", None] + ["a", "b"] * 3)
    offers = {r["column"]: r for r in propose(analyze(data, as_of=AS_OF, row_ids=False, only=["missing_values"])).table.collect()}
    assert offers["quantity"].action == "fill_missing" and offers["quantity"].parameters["value"] == "6.0"
    assert offers["mode"].parameters["value"] == "a" and offers["mode"].confidence == 0.5
    assert {offers[c].action for c in ("municipio", "geo_x", "tie")} == {"manual_review"}
    assert not may_impute("x", "identifier")


# ------------------------------------------------------------------ corrections


def messy(table):
    return table(
        name=[" Ann", "Bob", "bob", "Bob", "Eve ", " ", "Ann", "Ann"],
        day=["2024-01-05", "06/01/2024", "2024-01-07", "2024-01-08", "2024-02-30", "2024-01-09", "2024-01-05", "2024-01-05"],
        amount=["1,000.5", "2", "(3)", "4", "5", "six", "1,000.5", "1,000.5"],
    )


def test_nothing_changes_without_approval(spark, table):
    data = messy(table)
    analysis = analyze(data, as_of=AS_OF, row_ids=False)
    cleaned = apply_corrections(data, propose(analysis), decide(spark))
    assert cleaned.applied.isEmpty() and sorted(cleaned.data.frame.collect()) == sorted(data.frame.collect())


def test_corrections_apply_in_order_and_are_measured(spark, table):
    data = messy(table)
    analysis = analyze(data, as_of=AS_OF)
    offers = offer(analysis)
    wanted = approve(spark, offers, "strip_whitespace", "normalize_case", "parse_dates", "cast_to_numeric", "drop_duplicate_rows")
    order = [row.action for row in approved_in_order(offers.table, wanted).collect()]
    assert order == ["strip_whitespace", "normalize_case", "cast_to_numeric", "parse_dates", "drop_duplicate_rows"]
    run = clean(analysis, offers, wanted)
    # Row 7 repeats row 6 as it stands; once trimmed, row 6 repeats row 0 as well.
    assert values(run.data, "name") == ["Ann", "Bob", "Bob", "Bob", "Eve", ""]
    assert values(run.data, "day") == ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08", None, "2024-01-09"]
    assert values(run.data, "amount") == [1000.5, 2.0, -3.0, 4.0, 5.0, None]
    changed = {row.action: row.rows_changed for row in run.applied.collect()}
    assert changed["strip_whitespace"] == 3 and changed["normalize_case"] == 1 and changed["drop_duplicate_rows"] == 2
    outcome = run.outcome.first()
    assert (outcome.rows_before, outcome.rows_after, outcome.rows_removed) == (8, 6, 2)
    assert outcome.score_after > outcome.score_before
    assert values(data, "name")[0] == " Ann"


def test_ties_have_no_majority(table):
    offers = propose(analyze(table(c=["It", "IT", "fr"] * 3), as_of=AS_OF, row_ids=False))
    assert offers.table.filter("action = 'normalize_case'").isEmpty()


def test_clearing_clipping_and_repair(spark, table):
    data = table(s=["N/A", "unknown", "Rossi srl", "SpecialitÃ\xa0 srl", "nil"], email=["a@b.com", "bad", "c@d.com", "e@f.com", " "], n=["1", "5", "99", "x", "-4"])
    analysis = analyze(data, as_of=AS_OF, row_ids=False)
    offers = propose(analysis)
    cleaned = apply_corrections(data, offers, approve(spark, offers, "repair_encoding", "clear_invalid_values"))
    assert values(cleaned.data, "s") == [None, None, "Rossi srl", "Specialità srl", None]
    assert values(cleaned.data, "email") == ["a@b.com", None, "c@d.com", "e@f.com", None]
    clip = spark.createDataFrame([("p", "clip_to_range", "n", {"minimum": "0", "maximum": "10"})], "proposal_id string, action string, `column` string, parameters map<string,string>")
    clipped = apply_corrections(data, Proposals(clip, offers.mappings), decide(spark, ["p"]))
    assert values(clipped.data, "n") == [1.0, 5.0, 10.0, None, 0.0]


def test_misfit_corrections_are_skipped(spark, table):
    odd = spark.createDataFrame([("p", "strip_whitespace", "absent", {}), ("q", "fill_missing", "a", {})], "proposal_id string, action string, `column` string, parameters map<string,string>")
    data = table(a=["x", None])
    cleaned = apply_corrections(data, Proposals(odd, spark.createDataFrame([], "proposal_id string, from_value string, to_value string")), decide(spark, ["p", "q"]))
    assert cleaned.applied.isEmpty() and values(cleaned.data, "a") == ["x", None]


def said(analysis):
    """Findings, profiles and scores as comparable rows."""
    def plain(value):
        if isinstance(value, float):
            return float(f"{value:.8g}")
        if isinstance(value, dict):
            return {key: plain(each) for key, each in value.items()}
        return [plain(each) for each in value] if isinstance(value, list) else value

    tables = (analysis.findings, analysis.profiles, analysis.score, analysis.column_scores)
    return [sorted(json.dumps(plain(row.asDict(recursive=True)), sort_keys=True, default=str) for row in each.collect()) for each in tables]


def test_cleaned_tables_are_measured_again_as_if_new(spark, table):
    n, least = 40, 16
    data = table(
        name=[f" Name {i % 30} " if i % 4 else f"name {i % 30}" for i in range(n)],
        segment=["alpha", "Alpha", "alpha", "be-ta", "beta", "unknown", None, "gamma"] * 5,
        price=[f"${i},000.00" if i % 6 else f"({i})" for i in range(n)],
        age=[str(i) if i % 9 else None for i in range(n)],
        day=[f"2024-01-{1 + i % 28:02d}" if i % 3 else f"{13 + i % 15}/02/2024" for i in range(n)],
        code=[f"c{i % 3}" for i in range(n)],
        label=[{0: "red", 1: "green", 2: "blue"}[i % 3] if i % 7 else None for i in range(n)],
        note=["x" * 300 + str(i % 5) + " " * (i % 2) for i in range(n)],
        email=[f"a{i}@b.org" if i % 5 else "broken" for i in range(n)],
    )
    rules = RuleSet((NotNull("aged", column="age"), Unique("codes", columns=("code",)), Range("low", column="price", maximum=20000)))
    analysis = analyze(data, rules, AS_OF, near_unique=least)
    offers = offer(analysis, with_previews=False)
    found = offers.table.filter("action <> 'manual_review'").collect()
    assert {row.action for row in found} >= {"strip_whitespace", "normalize_case", "cast_to_numeric", "parse_dates", "fill_from_related", "clear_invalid_values"}
    for chosen in ({"strip_whitespace", "parse_dates"}, {row.action for row in found} - {"drop_duplicate_rows"}):
        run = clean(analysis, offers, decide(spark, [row.proposal_id for row in found if row.action in chosen]))
        assert said(run.after) == said(analyze(run.data, rules, AS_OF, near_unique=least))


def test_a_correction_that_fails_while_running_costs_only_itself(spark, table):
    schema = "proposal_id string, action string, `column` string, parameters map<string,string>"
    made = spark.createDataFrame([("p", "strip_whitespace", "a", {}), ("q", "parse_dates", "d", {"output_format": "yyyy-bb-QQQQQQ"}), ("r", "fill_missing", "b", {"value": "0"})], schema)
    data = table(a=[" x", None], d=["2024-01-05", "5/1/2024"], b=[None, "1"])
    cleaned = apply_corrections(data, Proposals(made, spark.createDataFrame([], "proposal_id string, from_value string, to_value string")), decide(spark, ["p", "q", "r"]))
    assert {row.proposal_id: row.rows_changed for row in cleaned.applied.collect()} == {"p": 1, "r": 1}
    assert [values(cleaned.data, c) for c in "adb"] == [["x", None], ["2024-01-05", "5/1/2024"], ["0", "1"]]


# ------------------------------------------------------------------ grounding


def test_mappings_are_grounded(spark, table):
    analysis = analyze(table(c=["UK", "United Kingdom", "Eire", "Ireland", "FR"]), as_of=AS_OF, row_ids=False)
    rows = [
        (1, "c", "UK", "United Kingdom", 0.9), (2, "c", "United Kingdom", "UK", 0.9), (3, "c", "UK", "FR", 0.9), (4, "c", "Eire", "Ireland", 0.5),
        (5, "c", "FR", "FR", 0.9), (6, "c", "Mars", "FR", 0.9), (7, "c", "FR", "France", 0.9), (8, "z", "UK", "FR", 0.9), (9, "c", "United Kingdom", "FR", 0.7),
    ]
    made = spark.createDataFrame(rows, "suggestion long, `column` string, from_value string, to_value string, confidence double")
    advice = advise(analysis, mappings=made)
    assert advice.rejected.count() == 7
    finding, proposal = advice.findings.first(), advice.proposals.table.first()
    assert (finding.affected_rows, finding.source, finding.confidence) == (2, "advisory", 0.7)
    cleaned = apply_corrections(analysis.data, advice.proposals, decide(spark, [proposal.proposal_id]))
    assert values(cleaned.data, "c") == ["United Kingdom", "FR", "Eire", "Ireland", "FR"]


def test_rules_descriptions_and_explanations_are_grounded(spark, table):
    analysis = analyze(table(c=["UK", "FR", None, None], n=["1", "2", "3", "4"]), as_of=AS_OF, row_ids=False)
    rules = spark.createDataFrame(
        [(1, "a", "range", "n", 5.0, 1.0, [], 0.9), (2, "a", "range", "n", 1.0, 5.0, [], 0.9), (3, "a", "range", "n", 0.0, 5.0, [], 0.9),
         (4, "b", "allowed_values", "c", None, None, ["uk "], 0.9), (5, "d", "allowed_values", "c", None, None, ["xx"], 0.9),
         (6, "e", "spell", "c", None, None, [], 0.9), (7, "f", "unique", "c", None, None, [], 0.1)],
        "suggestion long, name string, rule_type string, `column` string, minimum double, maximum double, allowed_values array<string>, confidence double")
    columns = analysis.profiles.select("column")
    levels = spark.createDataFrame([("c", "UK"), ("c", "FR")], "`column` string, t string")
    accepted = ground.ground_rules(rules, columns, levels).filter("accepted")
    assert sorted(r.suggestion for r in accepted.collect()) == [2, 4]
    words = spark.createDataFrame([(1, "c", "where", 0.9), (2, "c", "again", 0.9), (3, "z", "no", 0.9)], "suggestion long, `column` string, meaning string, confidence double")
    severe = analysis.findings.filter("severity = 'high'").first()
    notes = spark.createDataFrame([(severe.finding_id, "because"), ("nope", "?")], "finding_reference string, text string")
    advice = advise(analysis, descriptions=words, rules=rules, explanations=notes)
    assert advice.findings.groupBy("check_id").count().count() == 3 and advice.rejected.count() == 2 + 1 + 5
    merged = ground.merge_findings(analysis.findings, advice.findings)
    from plumbline.operators.score import column_scores, quality_score
    assert quality_score(merged, column_scores(merged, analysis.profiles)).first() == analysis.score.first()


# ------------------------------------------------------------------ files


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_delimiters():
    assert readers.detect_delimiter(["a;b;c", "1,5;2;3", "4;5;6"]) == ";"
    assert readers.detect_delimiter(["amount", "1,234.50"]) == ","
    assert readers.detect_delimiter(["a\tb", "1\t2"]) == "\t" and readers.detect_delimiter([]) == ","
    assert readers.detect_delimiter(["a|b,c", "1|2", "3|4"]) == "|"


def test_csv_reading(spark, tmp_path):
    path = write(tmp_path / "x.csv", 'id, name ,,id\n1,"a ""quoted"", cell",x,9\n\n2,N/A,,8\n3,"two\nlines",y\n', "utf-8-sig")
    data = read_csv(spark, path, with_hash=True)
    assert data.columns == ["id", "name", "column_3", "id_1"] and len(data.notes) == 3 and len(data.content_hash) == 64
    assert [tuple(r)[:4] for r in data.frame.orderBy(ROW_ID).collect()] == [
        ("1", 'a "quoted", cell', "x", "9"), ("2", "N/A", "", "8"), ("3", "two\nlines", "y", "")]


def test_csv_encodings(spark, tmp_path):
    for name, codec in (("a", "utf-8"), ("b", "cp1252"), ("c", "utf-8-sig")):
        data = read_csv(spark, write(tmp_path / f"{name}.csv", "city;n\nMálaga – €;1\n", codec))
        assert values(data, "city") == ["Málaga – €"]
    (tmp_path / "d.csv").write_bytes(b"city,n\nM\xe1laga\x81,1\n")
    assert values(read_csv(spark, str(tmp_path / "d.csv")), "city") == ["Málaga\x81"]


def test_bad_csv(spark, tmp_path):
    for name, text in (("ragged", "a,b\n1,2,3\n"), ("header", "a,b\n"), ("blank", "\n\n")):
        with pytest.raises(ShapeError):
            read_csv(spark, write(tmp_path / f"{name}.csv", text))


def test_views_and_export(spark, tmp_path, table):
    path = write(tmp_path / "x.tsv", "a\tb\n=1+1\t2\n")
    data = readers.open_view(spark, path, "opened")
    assert spark.sql("SELECT a FROM opened").first().a == "=1+1"
    writers.write_csv(data, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().a == "'=1+1"
    writers.write_parquet(data, str(tmp_path / "pq.parquet"))
    assert readers.open_view(spark, str(tmp_path / "pq.parquet"), "again").frame.count() == 1
    with pytest.raises(ValueError):
        readers.open_view(spark, "x.xlsx", "no")


def written_csv(path, rows, end="\n", mark=","):
    def cell(text):
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in '"\r\n' + mark) else text

    path.write_bytes(end.join(mark.join(map(cell, row)) for row in rows).encode() + end.encode())


@pytest.mark.parametrize("end, mark, size", [("\n", ",", 64), ("\r\n", ";", 40), ("\n", "\t", 17), ("\n", "|", 1000)])
def test_line_breaks_in_cells_are_read_in_splits(spark, tmp_path, end, mark, size):
    rng = random.Random(size)
    parts = ["a", "b c", "\n", '"', mark, "'", "", '""', "é", "\n\n", '"\n', f'"{mark}\n"', "x" * 30]
    rows = [["key", "text", "more"]] + [[str(i), "".join(rng.choices(parts, k=rng.randint(0, 6))), "".join(rng.choices(parts, k=2))] for i in range(300)]
    rows += [["300", f'5" pipe{mark[:0]}', 'it is 6" long'], ["301", "\n" * 40, "last"]]
    written_csv(tmp_path / "a.csv", rows, end, mark)
    written_csv(tmp_path / "b.csv", [rows[0], ["302", "one\nmore", "file"]], end, mark)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size * 16)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        data = read_csv(spark, str(tmp_path), delimiter=mark)
        found = sorted(((row.key, row.text, row.more) for row in data.frame.collect()), key=lambda row: int(row[0]))
        order = [row.key for row in data.frame.filter("key < 302").orderBy(ROW_ID).collect()]
        whole = read_csv(spark, str(tmp_path), delimiter=mark, multi_line=True).frame.collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == [tuple(row) for row in rows[1:]] + [("302", "one\nmore", "file")]
    assert order == [str(i) for i in range(302)]
    assert sorted((row.key, row.text, row.more) for row in whole) == sorted(found)


def test_stray_quotes_open_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\na,b\n5" pipe,x\n"y" z,"1\n\n2"\n\n,"open\n')
    data = read_csv(spark, str(tmp_path / "a.csv"))
    assert [(row.a, row.b) for row in data.frame.orderBy(ROW_ID).collect()][:2] == [('5" pipe', "x"), ('"y" z', "1\n\n2")]


def test_accents_and_line_breaks_in_other_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('name,note\n"Zoë\nÉ",€5\nañb,x\n'.encode("cp1252"))
    data = read_csv(spark, str(tmp_path / "a.csv"))
    assert data.encoding == "windows-1252"
    assert [(row["name"], row.note) for row in data.frame.orderBy(ROW_ID).collect()] == [("Zoë\nÉ", "€5"), ("añb", "x")]


# ------------------------------------------------------------------ history and reports


def test_a_save_that_breaks_off_leaves_nothing(spark, tmp_path, table, monkeypatch):
    analysis = analyze(table(a=["x", None]), as_of=AS_OF, row_ids=False, only=["missing_values"])
    history = History(spark, str(tmp_path / "history"))
    append = History._append

    def failing(self, commit, name, df):
        if name == "findings":
            raise OSError("no space left")
        append(self, commit, name, df)

    monkeypatch.setattr(History, "_append", failing)
    with pytest.raises(OSError):
        history.save_analysis(analysis)
    assert all(history.table(name).isEmpty() for name in ("analyses", "analysis_columns", "findings", "audit_events")) and history.commits().isEmpty()
    with pytest.raises(LookupError):
        history.audit_trail(analysis.analysis_id)
    monkeypatch.undo()
    history.save_analysis(analysis)
    assert [row.kind for row in history.commits().collect()] == ["analysis"]
    assert [history.table(name).count() for name in ("analyses", "analysis_columns", "findings", "audit_events")] == [1, 1, 1, 1]


def test_rows_from_before_commits_are_read(spark, tmp_path):
    history = History(spark, str(tmp_path / "history"))
    spark.createDataFrame([("a1", "old")], "analysis_id string, source_name string").write.parquet(f"{history.root}/analyses")
    assert [(row.analysis_id, row.source_name) for row in history.table("analyses").collect()] == [("a1", "old")]
    long = "x" * 900
    history.log_event("note", long, "a1")
    assert history.audit_trail("a1").first().summary == long


def test_history(spark, tmp_path, table):
    analysis = analyze(messy(table), as_of=AS_OF)
    offers = offer(analysis)
    decisions = approve(spark, offers, "strip_whitespace", "drop_duplicate_rows")
    run = clean(analysis, offers, decisions)
    history = History(spark, str(tmp_path / "history"))
    with pytest.raises(LookupError):
        history.save_review(analysis, offers, decisions)
    history.save_analysis(analysis)
    history.save_review(analysis, offers, decisions)
    history.save_review(analysis, offers, decisions)
    history.save_cleaned(analysis, run)
    history.log_event("note", "seen", analysis.analysis_id)
    history.log_call(analysis.analysis_id, "t", "m", 5, 7, 9)
    history.log_call(None, "t", "m", 1, 1, 1, False, "Timeout")
    assert [r.event_type for r in history.audit_trail(analysis.analysis_id).collect()] == [
        "analysis.completed", "review.decided", "review.decided", "dataset.cleaned", "note"]
    stored = history.table("proposals")
    assert stored.count() == offers.table.count() and stored.filter("decision_status = 'approved'").count() == 2
    assert [r.action for r in history.applied_changes(analysis.analysis_id).collect()] == ["strip_whitespace", "drop_duplicate_rows"]
    assert history.recent_analyses().first().quality_score == analysis.score.first().overall
    assert tuple(history.usage_totals().first()) == (2, 6, 8)
    kept = "".join(r.details for r in history.table("findings").collect())
    assert "Ann" not in kept and "examples_count" in kept
    log = json.loads(report.audit_log(analysis, offers.table, decisions, run).first().value)
    assert log["outcome"]["rows_after"] == run.outcome.first().rows_after
    assert {d["status"] for d in log["decisions"]} == {"approved", "pending"}
    tables = report.report_tables(analysis, offers.table, decisions, run)
    assert tables["decisions"].first().approved == 2 and tables["columns"].count() == 3
    assert "critical 1" in tables["score"].first().formula
    assert tables["dataset"].first().column_count == 3 and tables["dataset"].first().duplicate_rows is not None


def test_redaction(spark):
    raw = '{"examples":["a","b"],"constant_value":"EUR","variant_groups":{"x":["X","x"]},"parseable":5}'
    df = spark.createDataFrame([(raw,)], "d string")
    assert json.loads(df.select(redact(F.col("d"))).first()[0]) == {
        "examples_count": "2", "constant_value_present": "true", "variant_groups_count": "1", "parseable": "5"}
    assert df.select(redact(F.col("d"), True)).first()[0] == raw


def test_summaries_hide_content(table):
    analysis = analyze(table(email=["ann@example.com", "bob@example.com"], level=["low", "high"]), as_of=AS_OF, row_ids=False)
    shown = {r["column"]: json.loads(r.summary) for r in report.column_summaries(analysis.profiles).collect()}
    assert shown["email"]["examples"][0] == "aaa@aaaaaaa.aaa" and shown["email"]["examples_are_masked"]
    assert shown["level"]["examples"] == ["low", "high"]


def test_marks_and_blanks_are_no_spellings(table):
    data = table(kind=["-", "?", "  ", "A-1", "A 1", "A 1", "a 1"] * 6, other=[str(i) for i in range(42)])
    offers = offer(analyze(data, as_of=AS_OF))
    mapped = {row.from_value: row.to_value for row in offers.mappings.collect()}
    assert mapped == {"A-1": "A 1", "a 1": "A 1"}


def test_groups_without_a_majority_are_counted(table):
    data = table(kind=["Red", "red", "Blue", "BLUE", "blue", "blue", "Sea", "sea"], n=list("12345678"))
    offers = offer(analyze(data, as_of=AS_OF, only=["inconsistent_capitalization"]), with_previews=False)
    row = offers.table.filter("action = 'normalize_case'").first()
    assert "2 group(s) have no majority" in row.description and row.affected_rows == 2


def test_one_row_of_a_group_stays_where_ids_repeat(spark):
    rows = [(1, "x"), (1, "X "), (1, "x"), (2, "x"), (2, "y"), (3, "z")]
    data = Dataset.of(spark.createDataFrame(rows, "k int, v string"), row_id="k")
    kept = without_repeats(data.with_frame(data.frame.drop("k"))).collect()
    assert sorted(row.v.strip().lower() for row in kept) == ["x", "y", "z"]


def test_mapping_suggestions_settle_in_order(spark):
    rng = random.Random(12)
    names = ["a", "b", "c", "d"]
    rows = [(i, "kind", rng.choice(names), rng.choice(names)) for i in range(60)]
    expected, taken = {}, {}
    for i, _, source, target in rows:
        if source == target:
            continue
        good = source not in taken and taken.get(target) != source
        expected[i] = good
        if good:
            taken[source] = target
    suggestions = spark.createDataFrame([(*row, 0.9) for row in rows], "suggestion bigint, `column` string, from_value string, to_value string, confidence double")
    columns = spark.createDataFrame([("kind",)], "`column` string")
    levels = spark.createDataFrame([("kind", name) for name in names], "`column` string, t string")
    found = {r.suggestion: r.accepted for r in ground.ground_mappings(suggestions, columns, levels).collect() if r.source != r.target}
    assert found == expected


def test_every_severe_finding_can_be_explained(spark, table):
    data = table(**{f"c{i}": ["1"] + [None] * 9 for i in range(12)})
    analysis = analyze(data, as_of=AS_OF, only=["missing_values"])
    severe = [r.finding_id for r in analysis.findings.collect()]
    explanations = spark.createDataFrame([(i, "because") for i in [*severe, "none"]], "finding_reference string, text string")
    advice = advise(analysis, explanations=explanations)
    assert advice.findings.count() == 12 and advice.rejected.count() == 1


def test_intermediate_tables_can_be_released(spark, table):
    with collecting() as owner:
        analyze(table(a=["x", "X", None]), as_of=AS_OF)
    assert owner.kept or owner.paths
    owner.release()
    assert not owner.kept and not owner.paths
