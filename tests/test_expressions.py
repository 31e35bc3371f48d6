"""Column expressions against tables of values and a small Python model."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions import naming
from plumbline.functions import text as tx
from plumbline.functions.dates import DATE_FORMATS, with_dates
from plumbline.functions.numbers import with_number

# Strptime spellings of the formats, in bit order.
STRPTIME = (
    "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d", "%d.%m.%Y", "%d %b %Y", "%b %d, %Y", "%d %B %Y", "%B %d, %Y",
    "%Y%m%d", "%d/%m/%y", "%m/%d/%y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d/%m/%Y %H:%M", "%m/%d/%Y %H:%M",
)


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row.x for row in build(df).select("i", "x").orderBy("i").collect()]


def each(spark, values, expression):
    return column(spark, values, lambda df: df.withColumn("x", expression(F.col("v"))))


def model_formats(text):
    text = text.strip()
    if not text or (text.lstrip("+-").isdigit() and len(text) != 8):
        return 0
    mask = 0
    for bit, pattern in enumerate(STRPTIME):
        try:
            datetime.strptime(text, pattern)
        except ValueError:
            continue
        mask |= 1 << bit
    return mask


def grouped(digits, mark):
    """Digits in groups of three from the right."""
    head = len(digits) % 3
    return mark.join(part for part in [digits[:head], *(digits[i : i + 3] for i in range(head, len(digits), 3))] if part)


def spelled_numbers(rng, n):
    """Numbers in every spelling the grammar allows, with their values."""
    for _ in range(n):
        size = rng.randint(1, 9)
        whole = str(rng.randint(10 ** (size - 1), 10**size - 1))
        part = "".join(rng.choices("0123456789", k=rng.choice([1, 2])))
        value = float(f"{whole}.{part}")
        spellings = [(whole, float(whole)), (f"{whole}.{part}", value), (f"{whole},{part}", value), (f"{whole}e{len(part)}", float(f"{whole}e{len(part)}")), (f".{part}", float(f"0.{part}"))]
        if size > 3:
            spellings += [(grouped(whole, ","), float(whole)), (f"{grouped(whole, ',')}.{part}", value), (f"{grouped(whole, '.')},{part}", value), (f"{whole},{part}{part}{part}", float(f"{whole}.{part}{part}{part}"))]
        if size > 6:
            spellings.append((grouped(whole, "."), float(whole)))
        text, value = rng.choice(spellings)
        frame, sign = rng.choice([("{}", 1), ("-{}", -1), ("+{}", 1), ("({})", -1), ("( {} )", -1), ("{}%", 1), ("{} %", 1), ("${}", 1), ("€ {}", 1), ("£{}", 1)])
        yield rng.choice(["", " ", "\t", "\xa0"]) + frame.format(text) + rng.choice(["", "  "]), sign * value


def test_every_spelling_of_a_number_is_read(spark):
    texts, values = zip(*spelled_numbers(random.Random(23), 1500))
    assert column(spark, texts, lambda df: with_number(df, F.col("v"), "x")) == list(values)


def test_words_and_broken_numbers_are_none(spark):
    names = [row.p_name for row in spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(50).collect()]
    rng = random.Random(29)
    broken = [f"{rng.randint(1, 999)}{rng.choice(['x', 'kg', '.', '-', ' 7th'])}" for _ in range(60)]
    broken += [f"{rng.randint(1, 99)}.{rng.randint(1, 99)}.{rng.randint(1, 99)},{rng.randint(1, 9)},{rng.randint(1, 9)}" for _ in range(20)]
    assert column(spark, [*names, *broken, "", " ", "-", "()", "%"], lambda df: with_number(df, F.col("v"), "x")) == [None] * (len(names) + len(broken) + 5)


def test_numbers_are_read_back_as_written(spark):
    rng = random.Random(7)
    values, texts = [], []
    for _ in range(600):
        value = round(rng.uniform(-5_000_000, 5_000_000), 2)
        english = f"{value:,.2f}"
        swapped = english.replace(",", "_").replace(".", ",").replace("_", ".")
        bracketed = f"({abs(value):,.2f})" if value < 0 else english
        for text in (english, swapped, bracketed, f"€{abs(value):,.2f}" if value >= 0 else english, f" {english} "):
            values.append(value)
            texts.append(text)
    assert column(spark, texts, lambda df: with_number(df, F.col("v"), "x")) == values


def test_dates_match_strptime_on_random_text(spark):
    rng = random.Random(11)
    pieces = ["1", "01", "12", "13", "29", "30", "31", "2024", "2023", "0000", "70", "68", "Jan", "may", "August", "Foo", "00"]
    seps = ["-", "/", ".", " ", ", ", "  ", ""]
    texts = ["2024-01-01 10:30:00", "2024-01-01T10:30:00", "2024-01-01t1:2:3", "01/02/2024 10:30", "31/12/2023 25:00",
             "2024-01-01 10:30", "20240229", "20230229", "+2024010", "2024-01- 5", "1/ 5/2024", "29/02/1900", "2024-02-30"]
    for _ in range(4000):
        sep = rng.choice(seps)
        other = sep if rng.random() < 0.8 else rng.choice(seps)
        text = rng.choice(pieces) + sep + rng.choice(pieces) + other + rng.choice(pieces)
        texts.append(text + rng.choice(["", "", "", " 10:30", " 23:59:59", "T08:00:00", " "]))
    for _ in range(1500):
        day = datetime(rng.randint(1, 9999), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59))
        texts.append(day.strftime(rng.choice(STRPTIME)))
    got = column(spark, texts, lambda df: with_dates(df, F.col("v"), "x", "moment"))
    wrong = [(text, mask, model_formats(text)) for text, mask in zip(texts, got) if mask != model_formats(text)]
    assert not wrong, wrong[:10]
    assert len(DATE_FORMATS) == len(STRPTIME)


def test_lenient_date_prefers_day_first(spark):
    texts = ["03/04/2024", "2024-03-04", "12/31/2024", "4 Mar 2024", "3/4/70", "2024-13-01", "2024"]
    got = column(spark, texts, lambda df: with_dates(df, F.col("v"), "m", "moment").withColumn("x", F.date_format("moment", "yyyy-MM-dd")))
    assert got == ["2024-04-03", "2024-03-04", "2024-12-31", "2024-03-04", "1970-04-03", None, None]


@pytest.mark.parametrize("damaged, whole", [
    ("crÃ¨me", "crème"), ("FlÃ\xa0vio", "Flàvio"), ("itâ€™s", "it’s"), ("Â§12", "§12"), ("GÃ¶teborg", "Göteborg"),
])
def test_mojibake_is_repaired(spark, damaged, whole):
    assert each(spark, [damaged], tx.repair_encoding) == [whole]


def test_sound_text_is_left_alone(spark):
    sound = ["Łódź Glöck oHG", "crème brûlée", "Ærøskøbing", "Ünal Öz", "Nguyễn Thị", "TORINO", "90210", "", "Vill\N{REPLACEMENT CHARACTER}"]
    assert each(spark, sound, tx.repair_encoding) == [None] * len(sound)


def test_mojibake_round_trip(spark):
    words = ["Málaga", "Łódź", "Zürich", "señor – «x»", "日本", "naïve façade", "Ω≈ç"]
    damaged, whole = [], []
    for word in words:
        for codec in ("cp1252", "latin-1"):
            try:
                damaged.append(word.encode("utf-8").decode(codec))
                whole.append(word)
            except UnicodeDecodeError:
                pass
    assert each(spark, damaged, tx.repair_encoding) == whole


def test_booleans(spark):
    assert each(spark, ["TRUE", " y ", "1", "sì", "No", "0", "maybe", "", "2"], tx.boolean_token) == [
        True, True, True, True, False, False, None, None, None]


def test_emails(spark):
    good = ["a@b.com", "x.y+tag@sub.a-b.co.uk", "nome@sotto.dominio.museum"]
    bad = ["a@", "a.example.com", "a@@b.com", "a@b", "a b@c.com", "a@b.com\nx", ".a@b.com", "a@-b.com"]
    assert each(spark, good + bad, tx.is_email) == [True] * len(good) + [False] * len(bad)


def test_whitespace_covers_every_kind(spark):
    every = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
    assert set(every) == set(tx.WHITESPACE)
    assert each(spark, [every + "x y" + every], tx.trim) == ["x y"]


def test_keys(spark):
    assert each(spark, ["United Kingdom", "united-kingdom", " UNITED_KINGDOM "], tx.squash) == ["unitedkingdom"] * 3
    assert each(spark, ["Ελλάδα", "日本"], tx.squash) == ["ελλάδα", "日本"]
    names = ["Rossi S.p.A.", "ROSSI SpA", "rossi, Ltd", "Rossi  Group"]
    assert each(spark, names, tx.identity_key) == ["rossi"] * 4
    assert each(spark, ["Info@A.example.com"], tx.identity_key) == ["info@a.example.com"]


def test_masks_and_formulas(spark):
    assert each(spark, ["FR-12 x", "é" * 50], tx.mask) == ["aa-99 a", "a" * 40 + "…"]
    cells = ["=1+1", "+SUM(A1)", "@import", "-42.5", "-not a number", "Paris", "", "  =x", "+1,5"]
    assert each(spark, cells, tx.neutralise_formula) == ["'=1+1", "'+SUM(A1)", "'@import", "-42.5", "'-not a number", "Paris", "", "'  =x", "+1,5"]
    assert each(spark, [None, "", " a", "a"], tx.render) == ["(empty)", "(empty)", "[ a]", "a"]


def test_names_match_whole_words():
    assert "amount" in naming.hinted("total_amount") and "amount" not in naming.hinted("discount")
    assert "age" not in naming.hinted("average") and "age" in naming.hinted("Age at entry")
    assert "code" in naming.hinted("MUNICIPIO") and "identifier" in naming.hinted("id_nil") and not naming.hinted("width")
    assert "coordinate" in naming.hinted("geo_x") and "coordinate" not in naming.hinted("unit_price")
    assert "sensitive" in naming.hinted("Homephone2") and naming.hinted("") == set()
    assert naming.identity_columns(["customer_id", "full_name", "email", "vat_number", "client"]) == ["full_name", "email", "vat_number"]
