"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns find emails, IP addresses, card and phone numbers. These seeds induce lexical
patterns: the word before, the word after, and both. A graph joins each pattern to the distinct
values it extracts. Scores go round it: a pattern's confidence in a kind is the share of its values
that are known to be of that kind, a value's score follows from the confidence of its patterns, and
well-scored values count as known in the next round. In the end, high-confidence patterns name the
unseen identifiers among the tokens that hold digits or an at sign.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import ROW_KEY, with_row_key, written

# The base patterns, by kind, in the order in which kinds are listed. Possessive
# repetition and the look-behinds change no match; they keep the time in proportion to the text.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that may be identifiers.
TOKEN = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++"
#: An unseen identifier holds this many digits, or an at sign.
LEAST_DIGITS = 4
#: Characters before and after a value in which its context words are looked for.
REACH = 64
#: A pattern counts once the scores of its values add up to this, and from this confidence on.
LEAST_MASS, LEAST_CONFIDENCE = 4.0, 0.7
#: Values count as known from this score on.
LEAST_SCORE = 0.7
#: Rounds over the graph.
ROUNDS = 3

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def part(at: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - at, F.lit(1)).cast("int")
        doubled = 2 * digit
        return F.when(at % 2 == 0, digit).otherwise(doubled - F.when(doubled > 9, 9).otherwise(0))

    places = F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0)))
    return F.aggregate(places, F.lit(0), lambda total, at: total + part(at)) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    return (
        F.when(kind == "ip", value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == "card", n.between(12, 19) & _luhn(_digits(value)))
        .when(kind == "phone", n.between(9, 15))
        .when(kind == "token", (n >= LEAST_DIGITS) | value.contains("@"))
        .otherwise(F.lit(True))
    )


def _entities(rows: DataFrame) -> DataFrame:
    """Every match of a base pattern that is valid, and every token that may be an identifier.

    One row each: the row's key, ``kind``, ``begin`` and ``end`` in code points, ``value`` and the
    context words ``left`` and ``right``.
    """
    patterns = {**KINDS, "token": TOKEN}
    needs = {"email": "@", "phone": "+"}
    text = F.col("__text")
    cut = rows.filter(text.rlike("[0-9@]"))
    none = F.array().cast("array<string>")
    columns = {}
    for kind, pattern in patterns.items():
        present = text.contains(needs[kind]) if kind in needs else F.lit(True)
        columns[f"__found_{kind}"] = F.when(present, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    cut = cut.withColumns(columns)
    cut = cut.withColumns(
        {f"__between_{kind}": F.when(F.size(f"__found_{kind}") > 0, F.split(text, pattern, -1)).otherwise(none) for kind, pattern in patterns.items()}
    )

    def listed(kind: str) -> Column:
        found, between = F.col(f"__found_{kind}"), F.col(f"__between_{kind}")
        return F.transform(
            found,
            lambda value, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("number"),
                value.alias("value"),
                F.length(F.get(between, i)).alias("gap"),
                F.right(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(between, i)), F.lit(REACH)).alias("before"),
                F.left(F.concat(F.get(between, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), F.lit(REACH)).alias("after"),
            ),
        )

    each = cut.select(*ROW_KEY, F.explode(F.concat(*[listed(kind) for kind in patterns])).alias("m")).select(*ROW_KEY, "m.*")
    sofar = Window.partitionBy(*ROW_KEY, "kind").orderBy("number")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(sofar).cast("long"))
    word = lambda source, pattern: F.regexp_replace(F.lower(F.regexp_extract(source, pattern, 1)), "[0-9]", "9")
    return placed.filter(_valid(F.col("kind"), F.col("value"))).select(
        *ROW_KEY,
        "kind",
        (F.col("end") - F.length("value")).alias("begin"),
        "end",
        "value",
        word("before", r"(\S++)\s*+$").alias("left"),
        word("after", r"^\s*+(\S++)").alias("right"),
    )


def _unseen(entities: DataFrame) -> DataFrame:
    """``entities`` without the tokens that touch a match of a base pattern."""
    base = F.col("kind") != "token"
    order = Window.partitionBy(*ROW_KEY).orderBy("begin", base.desc(), "end")
    earlier = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    later = F.min(F.when(base, F.col("begin"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    touched = (F.coalesce(earlier, F.lit(0)) > F.col("begin")) | (F.coalesce(later, F.col("end")) < F.col("end"))
    return entities.withColumn("__touched", touched).filter(base | ~F.col("__touched")).drop("__touched")


def _with_patterns(entities: DataFrame) -> DataFrame:
    """A row for each of the lexical patterns around an entity."""
    left, right = F.col("left"), F.col("right")
    patterns = F.array(
        F.when(left != "", F.concat(F.lit("L "), left)),
        F.when(right != "", F.concat(F.lit("R "), right)),
        F.when((left != "") & (right != ""), F.concat(F.lit("B "), left, F.lit(" "), right)),
    )
    return entities.withColumn("pattern", F.explode(F.array_compact(patterns)))


def confident_patterns(entities: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, kind, confidence``: what the rounds over the pattern-instance graph accept."""
    edges = written(_with_patterns(entities).select("pattern", "kind", "value").distinct())
    totals = edges.groupBy("pattern").agg(F.countDistinct("value").alias("total"))
    seeds = edges.filter("kind <> 'token'").select("pattern", "kind", F.lit(1.0).alias("score"))
    open_edges = edges.filter("kind = 'token'").select("pattern", "value")
    found, accepted = None, None
    for _ in range(rounds):
        votes = seeds
        if found is not None:
            votes = votes.unionByName(open_edges.join(found, "value").select("pattern", "kind", "score"))
        mass = votes.groupBy("pattern", "kind").agg(F.sum("score").alias("mass")).filter(F.col("mass") >= LEAST_MASS)
        accepted = written(
            mass.join(totals, "pattern")
            .select("pattern", "kind", (F.col("mass") / (F.col("total") + 1)).alias("confidence"))
            .filter(F.col("confidence") >= LEAST_CONFIDENCE)
        )
        scored = (
            open_edges.join(accepted, "pattern")
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
            .filter(F.col("score") >= LEAST_SCORE)
        )
        best = scored.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("best"))
        found = written(best.select("value", "best.kind", "best.score"))
    return accepted


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Spans of personal data in every row of ``docs``.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone`` (base matches), ``base_sha256`` (digest of
    the base spans), ``spans`` (base and discovered spans, written ``kind:start:end`` and joined by
    commas, by start and then in the order of the kinds) and ``n_discovered``. Null and empty texts
    have no spans. Repeated rows come out as often as they came in; their values count once.
    """
    rows = with_row_key(docs.select("doc_id", "text")).select("doc_id", *ROW_KEY, F.coalesce("text", F.lit("")).alias("__text"))
    entities = written(_unseen(_entities(rows)))
    patterns = confident_patterns(entities, rounds)
    tokens = _with_patterns(entities.filter("kind = 'token'").drop("kind")).join(patterns, "pattern")
    discovered = tokens.groupBy(*ROW_KEY, "begin", "end").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    spans = entities.filter("kind <> 'token'").select(*ROW_KEY, "kind", "begin", "end", F.lit(True).alias("base")).unionByName(
        discovered.select(*ROW_KEY, "best.kind", "begin", "end", F.lit(False).alias("base"))
    )
    rank = reduce(lambda chain, kind: chain.when(F.col("kind") == kind[1], kind[0]), enumerate(KINDS), F.when(F.lit(False), -1))
    entry = F.struct("begin", rank.alias("rank"), "end", "base", F.concat_ws(":", "kind", "begin", "end").alias("span"))
    joined = lambda column: F.array_join(F.transform(F.sort_array(column), lambda s: s["span"]), ",")
    by_row = spans.groupBy(*ROW_KEY).agg(
        *[F.count_if(F.col("base") & (F.col("kind") == kind)).alias(f"n_{kind}") for kind in KINDS],
        joined(F.collect_list(F.when(F.col("base"), entry))).alias("base_spans"),
        joined(F.collect_list(entry)).alias("spans"),
        F.count_if(~F.col("base")).alias("n_discovered"),
    )
    return rows.select("doc_id", *ROW_KEY).join(by_row, ROW_KEY, "left").select(
        "doc_id",
        *[F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_discovered", F.lit(0)).cast("long").alias("n_discovered"),
    )
