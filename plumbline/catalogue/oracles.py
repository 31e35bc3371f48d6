"""The expected result of each query, as SQL that DuckDB runs over the same tables."""

from __future__ import annotations

from plumbline.catalogue.queries import AS_OF
from plumbline.catalogue.views import with_views
from plumbline.functions.naming import SENSITIVE_FRAGMENTS
from plumbline.functions.text import FILLER_WORDS, LEGAL_FORMS

CUSTOMER = ("customer_id", "full_name", "email", "segment", "age", "revenue", "signup_date", "city", "currency")
PART = ("part_type", "mixed", "remark", "in_stock")
TODAY = f"DATE '{AS_OF.isoformat()}'"

ORACLES: dict[str, str] = {}


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _gap(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '')"


def _severity(ratio: str, medium: float = 0.05) -> str:
    return f"CASE WHEN {ratio} > 0.5 THEN 'critical' WHEN {ratio} > 0.2 THEN 'high' WHEN {ratio} > {medium} THEN 'medium' ELSE 'low' END"


def _brief(column: str, severity: str, affected: str, view: str = "dirty_customer", fires: str | None = None) -> str:
    """One finding of a column: ``affected`` is an aggregate over the view."""
    return (
        f"SELECT '{column}' AS \"column\", {severity} AS severity, affected_rows, row_count FROM "
        f"(SELECT {affected} AS affected_rows, count(*) AS row_count FROM {view}) WHERE {fires or 'affected_rows > 0'}"
    )


_RATIO = "affected_rows / row_count"

# ------------------------------------------------------------------ value expressions

#: Dollar sign and thousands comma removed; the views hold no other decoration.
_MONEY = "try_cast(replace(replace(trim(revenue), '$', ''), ',', '') AS DOUBLE)"
_AGE = "try_cast(age AS DOUBLE)"
_AMOUNT = (
    "CASE WHEN amount LIKE '(%' THEN -try_cast(replace(replace(amount, '(', ''), ')', '') AS DOUBLE) "
    "ELSE try_cast(replace(amount, '%', '') AS DOUBLE) END"
)


def _iso(c: str) -> str:
    return f"(CASE WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({c} AS DATE) END)"


def _slashed(c: str, pattern: str) -> str:
    return f"(CASE WHEN regexp_full_match({c}, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN CAST(try_strptime({c}, '{pattern}') AS DATE) END)"


def _day(c: str) -> str:
    return f"coalesce({_iso(c)}, {_slashed(c, '%d/%m/%Y')}, {_slashed(c, '%m/%d/%Y')})"


_EMAIL = (
    r"regexp_full_match(trim(email), '[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+)*"
    r"@[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+')"
)


def _key(c: str) -> str:
    return f"regexp_replace(lower(trim({c})), '[^a-z0-9]+', '', 'g')"


def _identity(c: str) -> str:
    spaced = f"regexp_replace(lower({c}), '[^a-z0-9_\\s@.]+', ' ', 'g')"
    dotless = f"CASE WHEN contains({spaced}, '@') THEN {spaced} ELSE replace({spaced}, '.', '') END"
    bare = f"regexp_replace({dotless}, '\\b({'|'.join(LEGAL_FORMS)})\\b', ' ', 'g')"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


_COMPANY_KEY = f"concat({_identity('company_name')}, '|', {_identity('contact_email')}, '|', {_identity('vat_code')})"

# ------------------------------------------------------------------ profile

ORACLES["missing_counts"] = _union(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {_gap(c)}) AS missing_count, count(*) AS row_count FROM dirty_customer"
    for c in CUSTOMER
)
ORACLES["profile_numeric"] = _union(
    f"SELECT '{c}' AS \"column\", min({c}) AS minimum, max({c}) AS maximum, round(avg({c}), 4) AS mean, "
    f"round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std_dev, count(*) FILTER (WHERE {c} = 0) AS zero_count, "
    f"count(*) FILTER (WHERE {c} < 0) AS negative_count FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
)
ORACLES["profile_numeric_text"] = _union(
    f"SELECT '{c}' AS \"column\", min({x}) AS minimum, max({x}) AS maximum, round(avg({x}), 4) AS mean, "
    f"median({x}) AS median, round(stddev_samp({x}), 4) AS std_dev FROM dirty_customer"
    for c, x in (("age", _AGE), ("revenue", _MONEY))
)
ORACLES["profile_text"] = _union(
    f"SELECT '{c}' AS \"column\", min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 2) AS mean_length, "
    f"count(*) FILTER (WHERE trim({c}) = '') AS blank_count, count(*) FILTER (WHERE {_gap(c)}) AS missing_count FROM documents"
    for c in ("lang", "source", "text")
)
ORACLES["profile_temporal"] = (
    "SELECT 'order_date' AS \"column\", strftime(min(d), '%Y-%m-%d') AS earliest, strftime(max(d), '%Y-%m-%d') AS latest, "
    "'DD/MM/YYYY; MM/DD/YYYY; YYYY-MM-DD (ISO)' AS formats, count(*) FILTER (WHERE d IS NULL) AS unparseable "
    f"FROM (SELECT {_day('order_date')} AS d FROM dirty_orders) UNION ALL "
    "SELECT 'delivery_date', strftime(min(d), '%Y-%m-%d'), strftime(max(d), '%Y-%m-%d'), 'YYYY-MM-DD (ISO)', "
    f"count(*) FILTER (WHERE d IS NULL) FROM (SELECT {_day('delivery_date')} AS d FROM dirty_orders)"
)
ORACLES["profile_native_dates"] = (
    "SELECT 'o_orderdate' AS \"column\", 'datetime' AS semantic_type, strftime(min(o_orderdate), '%Y-%m-%d') AS earliest, "
    "strftime(max(o_orderdate), '%Y-%m-%d') AS latest, count(DISTINCT o_orderdate) AS unique_count FROM orders"
)
ORACLES["cardinality"] = _union(
    f"SELECT '{c}' AS \"column\", count(DISTINCT CASE WHEN NOT {_gap(c)} THEN trim({c}) END) AS unique_count, count(*) AS row_count FROM dirty_customer"
    for c in CUSTOMER
)
ORACLES["cardinality_events"] = _union(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM events"
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
)
ORACLES["top_values"] = (
    "SELECT \"column\", rank, value, n FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) - 1 AS rank FROM ("
    + _union(
        f"SELECT '{c}' AS \"column\", trim({c}) AS value, count(*) AS n FROM dirty_customer WHERE NOT {_gap(c)} GROUP BY 2"
        for c in ("segment", "age", "city")
    )
    + ")) WHERE rank < 10"
)
ORACLES["sample_values"] = (
    "SELECT \"column\", rank, value FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY first_row, value) - 1 AS rank FROM ("
    + _union(
        f"SELECT '{c}' AS \"column\", {c} AS value, min(row_key) AS first_row FROM dirty_customer WHERE NOT {_gap(c)} GROUP BY 2"
        for c in ("segment", "full_name", "city")
    )
    + ")) WHERE rank < 5"
)
_TOKENS = "('true','yes','y','1','t','si','sì','oui','vrai','false','no','n','0','f','non','faux')"


def _inferred(c: str, temporal: bool = False, identifier: bool = False) -> str:
    """The semantic type of a text column, from the shares of its given values."""
    number = f"try_cast(replace(replace(trim({c}), '$', ''), ',', '') AS DOUBLE)"
    shares = (
        f"SELECT CAST(count({c}) AS DOUBLE) AS given, count(*) FILTER (WHERE {_EMAIL.replace('email', c)}) AS emails, "
        f"count(*) FILTER (WHERE contains({c}, '@')) AS ats, count(*) FILTER (WHERE lower(trim({c})) IN {_TOKENS}) AS tokens, "
        f"count({_day(c)}) AS dates, count({number}) AS numbers, bool_and({number} = floor({number})) AS whole, max(length(trim({c}))) AS longest, "
        f"count(DISTINCT CASE WHEN NOT {_gap(c)} THEN trim({c}) END) + CAST(count(*) FILTER (WHERE trim({c}) = '') > 0 AS INTEGER) AS forms "
        "FROM dirty_customer"
    )
    return (
        f"SELECT '{c}' AS \"column\", CASE WHEN given = 0 THEN 'empty' WHEN emails / given >= 0.6 OR (ats / given >= 0.8 AND emails / given >= 0.3) THEN 'email' "
        f"WHEN tokens / given >= 0.9 THEN 'boolean' WHEN dates / given >= {0.4 if temporal else 0.7} THEN 'date' "
        "WHEN numbers / given >= 0.7 THEN CASE WHEN whole THEN 'integer' ELSE 'float' END "
        "WHEN forms / given > 0.95 AND longest <= 40 AND numbers / given < 0.5 AND dates / given < 0.5 "
        f"AND ({str(identifier).lower()} OR (forms = given AND given >= 20)) THEN 'identifier' "
        f"WHEN longest <= 60 AND (forms <= 50 OR forms / given <= 0.25) THEN 'categorical' ELSE 'text' END AS semantic_type FROM ({shares})"
    )


ORACLES["infer_types"] = _union(_inferred(c, c == "signup_date", c == "customer_id") for c in CUSTOMER)
ORACLES["infer_types_native"] = (
    "SELECT 'o_custkey' AS \"column\", 'integer' AS semantic_type, CAST(1 AS DOUBLE) AS confidence "
    "UNION ALL SELECT 'o_orderkey', 'integer', 1 "
    "UNION ALL SELECT 'o_totalprice', 'float', 1 UNION ALL SELECT 'o_orderdate', 'datetime', 1 "
    "UNION ALL SELECT 'o_orderstatus', 'categorical', round(1 - count(DISTINCT o_orderstatus) / count(*), 4) FROM orders "
    "UNION ALL SELECT 'o_orderpriority', 'categorical', round(1 - count(DISTINCT o_orderpriority) / count(*), 4) FROM orders"
)
ORACLES["columns_per_type"] = (
    "SELECT semantic_type, count(*) AS columns FROM (" + ORACLES["infer_types"] + ") GROUP BY semantic_type"
)
ORACLES["most_missing"] = (
    "SELECT \"column\", round(missing_count / row_count * 100, 2) AS missing_percent FROM ("
    + ORACLES["missing_counts"] + ") WHERE missing_count > 0"
)
ORACLES["dataset_totals"] = (
    "SELECT max(row_count) AS row_count, count(*) AS column_count, sum(row_count) AS total_cells, sum(missing_count) AS missing_cells, "
    "round(sum(missing_count) / sum(row_count), 6) AS missing_ratio FROM (" + ORACLES["missing_counts"] + ")"
)
ORACLES["duplicate_rows"] = (
    "SELECT coalesce(sum(n - 1), 0) AS duplicate_rows, count(*) FILTER (WHERE n > 1) AS duplicate_groups "
    "FROM (SELECT count(*) AS n FROM repeated_orders GROUP BY customer, status, priority)"
)
ORACLES["duplicate_line_items"] = (
    "SELECT coalesce(sum(n - 1), 0) AS duplicate_rows, count(*) FILTER (WHERE n > 1) AS duplicate_groups "
    "FROM (SELECT count(*) AS n FROM repeated_lines GROUP BY line, flag, status, lot)"
)


def _kinds(c: str) -> str:
    number = f"regexp_full_match(trim({c}), '[-+]?\\d+(\\.\\d+)?')"
    truth = f"lower(trim({c})) IN ('true','yes','y','1','t','si','sì','oui','vrai','false','no','n','0','f','non','faux')"
    return (
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {number}) AS numbers, "
        f"count(*) FILTER (WHERE NOT {number} AND {_day(c)} IS NOT NULL) AS dates, "
        f"count(*) FILTER (WHERE NOT {number} AND {_day(c)} IS NULL AND {truth}) AS booleans, "
        f"count(*) FILTER (WHERE NOT {number} AND {_day(c)} IS NULL AND NOT {truth}) AS text FROM dirty_part"
    )


ORACLES["kind_shares"] = _union(_kinds(c) for c in PART)
ORACLES["date_formats"] = "SELECT bit, n FROM (" + _union(
    f"SELECT CAST({bit} AS BIGINT) AS bit, count(*) FILTER (WHERE {d} IS NOT NULL) AS n FROM dirty_orders"
    for bit, d in ((0, _iso("order_date")), (1, _slashed("order_date", "%d/%m/%Y")), (2, _slashed("order_date", "%m/%d/%Y")))
) + ") WHERE n > 0"
ORACLES["evenly_spaced_sample"] = (
    "SELECT row_key AS row_id, email AS value FROM (SELECT row_key, email, row_number() OVER (ORDER BY row_key) - 1 AS i, "
    "count(*) OVER () AS n FROM dirty_customer WHERE email IS NOT NULL) WHERE n <= 100 OR i % CAST(ceil(n / 100) AS BIGINT) = 0"
)

# ------------------------------------------------------------------ expressions

ORACLES["parse_numbers"] = f"SELECT row_key, {_AMOUNT} AS number FROM dirty_orders"
ORACLES["parse_dates"] = (
    f"SELECT row_key, strftime({_day('signup_date')}, '%Y-%m-%d') AS day, "
    f"CAST(({_iso('signup_date')} IS NOT NULL) AS BIGINT) + CAST(({_slashed('signup_date', '%d/%m/%Y')} IS NOT NULL) AS BIGINT) "
    f"+ CAST(({_slashed('signup_date', '%m/%d/%Y')} IS NOT NULL) AS BIGINT) AS formats FROM dirty_customer"
)
ORACLES["parse_numbers_european"] = (
    "SELECT row_key, CAST(replace(replace(replace(price, ' €', ''), '.', ''), ',', '.') AS DOUBLE) AS number FROM european_prices"
)
ORACLES["parse_dates_every_format"] = "SELECT row_key, strftime(make_date(y, m, d), '%Y-%m-%d') AS day FROM dated_orders"
ORACLES["boolean_tokens"] = (
    "SELECT row_key, CASE WHEN lower(in_stock) IN ('yes', 'oui') THEN true WHEN lower(in_stock) = 'no' THEN false END AS truth FROM dirty_part"
)
ORACLES["valid_emails"] = f"SELECT row_key, {_EMAIL} AS valid FROM dirty_customer"
ORACLES["category_keys"] = f"SELECT {_key('part_type')} AS key, count(*) AS n FROM dirty_part GROUP BY 1"
ORACLES["identity_keys"] = (
    f"SELECT row_key, concat({_identity('company_name')}, '|', {_identity('contact_email')}) AS identity FROM dirty_company"
)
ORACLES["repair_encoding"] = (
    "SELECT row_key, CASE WHEN city = 'MalmÃ¶' THEN 'Malmö' END AS repaired, contains(city, chr(65533)) AS lost FROM dirty_customer"
)
ORACLES["mask_values"] = (
    "SELECT row_key, regexp_replace(regexp_replace(revenue, '[0-9]', '9', 'g'), '[A-Za-z]', 'a', 'g') AS shape FROM dirty_customer"
)
ORACLES["neutralise_formulas"] = (
    "SELECT row_key, CASE WHEN regexp_matches(trim(remark), '^[=+@-]') AND NOT regexp_full_match(trim(remark), '[-+]?\\d+(\\.\\d+)?') "
    "THEN concat('''', remark) ELSE remark END AS remark FROM dirty_part"
)
ORACLES["plain_numbers"] = (
    "SELECT count(*) FILTER (WHERE regexp_full_match(trim(amount), '[-+]?\\d+(\\.\\d+)?')) AS plain, count(*) AS row_count FROM dirty_orders"
)

# ------------------------------------------------------------------ checks

_MISSING_SEVERITY = f"CASE WHEN {_RATIO} >= 1 THEN 'critical' ELSE {_severity(_RATIO, 0.02)} END"
ORACLES["check_missing_values"] = _union(
    _brief(c, _MISSING_SEVERITY, f"count(*) FILTER (WHERE {_gap(c)})") for c in CUSTOMER
)
ORACLES["check_constant_column"] = _union(
    f"SELECT '{c}' AS \"column\", 'info' AS severity, affected_rows, row_count FROM (SELECT count(*) FILTER (WHERE NOT {_gap(c)}) AS affected_rows, "
    f"count(*) AS row_count, count(DISTINCT trim({c})) FILTER (WHERE NOT {_gap(c)}) AS d FROM dirty_customer) WHERE d = 1 AND row_count >= 2"
    for c in CUSTOMER
)
_LONG_FILLERS = ", ".join(f"'{word}'" for word in FILLER_WORDS if len(word) > 3)
_SHORT_FILLERS = ", ".join(f"'{word}'" for word in FILLER_WORDS if len(word) <= 3)


def _fillers(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", {_severity(_RATIO)} AS severity, affected_rows, row_count FROM ("
        f"SELECT count(*) FILTER (WHERE {_key('v')} IN ({_LONG_FILLERS}) OR ({_key('v')} IN ({_SHORT_FILLERS}) AND longest > 3) "
        f"OR ({_key('v')} = '' AND length(v) <= 3 AND regexp_full_match(v, '[ -~]+')) "
        f"OR (folds / present >= 0.7 AND n >= greatest(5, floor(total * 0.01)) AND n / total <= 0.5)) AS affected_rows, max(total) AS row_count "
        f"FROM (SELECT trim({c}) AS v, lower(trim({c})) AS f, max(length(trim({c}))) OVER () AS longest, "
        f"count(*) OVER () AS present, count(*) OVER (PARTITION BY lower(trim({c}))) AS n, "
        f"(SELECT count(DISTINCT lower(trim({c}))) FROM dirty_customer WHERE NOT {_gap(c)}) AS folds, "
        f"(SELECT count(*) FROM dirty_customer) AS total FROM dirty_customer WHERE NOT {_gap(c)})) WHERE affected_rows > 0"
    )


ORACLES["check_placeholder_values"] = _union(_fillers(c) for c in CUSTOMER)
ORACLES["check_invalid_date"] = _brief("signup_date", _severity(_RATIO), f"count(*) FILTER (WHERE {_day('signup_date')} IS NULL)")
ORACLES["check_inconsistent_date_format"] = _brief("signup_date", "'high'", f"count({_day('signup_date')})")
ORACLES["check_mixed_date_format_orders"] = _brief("order_date", "'high'", f"count({_day('order_date')})", "dirty_orders")
ORACLES["check_invalid_email"] = _brief(
    "email", _severity(_RATIO), f"count(*) FILTER (WHERE NOT {_gap('email')} AND NOT {_EMAIL})"
)
ORACLES["check_numeric_stored_as_text"] = _brief("revenue", "'medium'", f"count({_MONEY})")
ORACLES["check_impossible_numeric"] = _brief("age", "'high'", f"count(*) FILTER (WHERE {_AGE} < 0 OR {_AGE} > 120)")
ORACLES["check_impossible_amounts"] = _brief("amount", "'high'", f"count(*) FILTER (WHERE {_AMOUNT} < 0)", "dirty_orders")
ORACLES["check_suspicious_numeric"] = _union(
    f"SELECT '{c}' AS \"column\", 'low' AS severity, affected_rows, row_count FROM (SELECT count(*) FILTER (WHERE abs(x - mean) / std > 5) AS affected_rows, "
    f"count(*) AS row_count, count(x) AS numbers FROM (SELECT {x} AS x, avg({x}) OVER () AS mean, stddev_samp({x}) OVER () AS std FROM dirty_customer)) "
    "WHERE affected_rows > 0 AND numbers >= 20"
    for c, x in (("age", _AGE), ("revenue", _MONEY))
)
ORACLES["check_future_date"] = _brief("signup_date", "'high'", f"count(*) FILTER (WHERE {_day('signup_date')} > {TODAY})")


def _variants(c: str, key: str, form: str, severity: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", '{severity}' AS severity, sum(n) AS affected_rows, max(total) AS row_count FROM ("
        f"SELECT count(*) AS n, count(DISTINCT {form}) AS forms, (SELECT count(*) FROM dirty_customer) AS total FROM dirty_customer "
        f"WHERE NOT {_gap(c)} GROUP BY {key}) WHERE forms > 1 HAVING count(*) > 0"
    )


ORACLES["check_inconsistent_category"] = _variants("segment", _key("segment"), "lower(trim(segment))", "medium")
ORACLES["check_inconsistent_capitalization"] = _variants("segment", "lower(trim(segment))", "trim(segment)", "low")
ORACLES["check_leading_trailing_whitespace"] = _union(
    _brief(c, "'low'", f"count(*) FILTER (WHERE NOT {_gap(c)} AND trim({c}) <> {c})") for c in CUSTOMER
)
ORACLES["check_corrupted_encoding"] = _brief(
    "city", f"CASE WHEN {_severity(_RATIO)} = 'low' THEN 'medium' ELSE {_severity(_RATIO)} END",
    "count(*) FILTER (WHERE city = 'MalmÃ¶' OR contains(city, chr(65533)))",
)
ORACLES["check_mixed_datatypes"] = _brief("mixed", "'medium'", "count(*)", "dirty_part")
_ORDER_KEYS = "customer, lower(trim(status)), lower(trim(priority))"
_DUPLICATE_SUMMARY = (
    "SELECT CASE WHEN affected_rows / row_count > {limit} THEN 'high' ELSE 'medium' END AS severity, affected_rows, row_count, duplicate_groups FROM ({body}) "
    "WHERE affected_rows > 0"
)
ORACLES["check_exact_duplicates"] = _DUPLICATE_SUMMARY.format(
    limit=0.05,
    body="SELECT sum(n - 1) FILTER (WHERE n > 1) AS affected_rows, sum(n) AS row_count, count(*) FILTER (WHERE n > 1) AS duplicate_groups "
    f"FROM (SELECT count(*) AS n FROM repeated_orders GROUP BY {_ORDER_KEYS})",
)
_COMPANY_ROWS = (
    f"SELECT row_key, {_COMPANY_KEY} AS k, count(*) OVER (PARTITION BY {_COMPANY_KEY}) AS same_key, "
    "count(*) OVER (PARTITION BY lower(trim(company_name)), lower(trim(contact_email)), lower(trim(vat_code)), lower(trim(status))) AS same_row "
    "FROM dirty_company"
)
ORACLES["check_probable_duplicates"] = _DUPLICATE_SUMMARY.format(
    limit=0.02,
    body="SELECT count(*) FILTER (WHERE same_key > 1 AND same_row = 1) AS affected_rows, count(*) AS row_count, "
    f"count(DISTINCT k) FILTER (WHERE same_key > 1 AND same_row = 1) AS duplicate_groups FROM ({_COMPANY_ROWS})",
)
ORACLES["probable_duplicate_rows_first"] = (
    f"SELECT row_key AS row_id FROM ({_COMPANY_ROWS}) WHERE same_key > 1 AND same_row = 1 ORDER BY row_key LIMIT 200"
)
ORACLES["exact_duplicate_rows_first"] = (
    f"SELECT row_key AS row_id FROM (SELECT row_key, row_number() OVER (PARTITION BY {_ORDER_KEYS} ORDER BY row_key) AS rn FROM repeated_orders) "
    "WHERE rn > 1 ORDER BY row_key LIMIT 200"
)

# ------------------------------------------------------------------ rules

_SEGMENTS = "('automobile', 'building', 'furniture', 'household', 'machinery')"
_BROKEN = {
    "email_required": ("email", "critical", _gap("email")),
    "age_plausible": ("age", "high", f"{_AGE} < 0 OR {_AGE} > 120"),
    "revenue_small": ("revenue", "medium", f"{_MONEY} > 9000"),
    "segment_known": ("segment", "low", f"NOT {_gap('segment')} AND lower(trim(segment)) NOT IN {_SEGMENTS}"),
    "signup_past": ("signup_date", "high", f"{_day('signup_date')} > {TODAY}"),
    "customer_id_format": ("customer_id", "high", "NOT regexp_full_match(customer_id, 'CUST-[0-9]+')"),
}
_REPEATED_IDS = "(SELECT row_number() OVER (PARTITION BY lower(trim(customer_id)) ORDER BY row_key) AS rn, row_key FROM dirty_customer)"
_RULE_COUNTS = _union(
    [
        f"SELECT '{rule}' AS rule, '{column}' AS \"column\", '{severity}' AS severity, count(*) FILTER (WHERE {test}) AS affected, count(*) AS row_count FROM dirty_customer"
        for rule, (column, severity, test) in _BROKEN.items()
    ]
    + [
        "SELECT 'customer_id_unique', 'customer_id', 'critical', count(*) FILTER (WHERE rn > 1), count(*) FROM " + _REPEATED_IDS
    ]
)
ORACLES["check_business_rules"] = (
    "SELECT concat('Business rule failed: ', rule) AS title, \"column\", severity, affected AS affected_rows, row_count FROM ("
    + _RULE_COUNTS + ") WHERE affected > 0 UNION ALL SELECT 'Rules that do not fit this table: 1', NULL, 'info', 0, count(*) FROM dirty_customer"
)
ORACLES["rule_split"] = (
    "SELECT rule, 'evaluated' AS state, affected FROM (" + _RULE_COUNTS + ") UNION ALL SELECT 'absent_column', 'skipped', NULL"
)
ORACLES["violating_rows"] = "SELECT rule, row_id FROM (" + _union(
    [
        f"(SELECT '{rule}' AS rule, row_key AS row_id FROM dirty_customer WHERE {test} ORDER BY row_key LIMIT 50)"
        for rule, (_, _, test) in _BROKEN.items()
    ]
    + [f"(SELECT 'customer_id_unique', row_key FROM {_REPEATED_IDS} WHERE rn > 1 ORDER BY row_key LIMIT 50)"]
) + ")"


def _rule(name: str, test: str, view: str) -> str:
    return f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {test}) AS affected FROM {view}"


ORACLES["rule_not_null"] = _rule("email_required", _gap("email"), "dirty_customer")
ORACLES["rule_range"] = _rule("quantity_range", "l_quantity < 5 OR l_quantity > 45", "lineitem")
ORACLES["rule_range_text"] = _rule("revenue_range", f"{_MONEY} < 2000 OR {_MONEY} > 8000", "dirty_customer")
ORACLES["rule_allowed_values"] = _rule("status_known", "lower(trim(o_orderstatus)) NOT IN ('f', 'o')", "orders")
ORACLES["rule_no_future_dates"] = _rule("signup_past", f"{_day('signup_date')} > {TODAY} + INTERVAL 30 DAY", "dirty_customer")
ORACLES["rule_regex"] = _rule("vat_format", "NOT regexp_full_match(vat_code, '[A-Z]{2}[0-9]{9}')", "dirty_company")
ORACLES["rule_unique"] = (
    "SELECT 'line_unique' AS rule, coalesce(sum(n - 1), 0) AS affected FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"
)
ORACLES["rule_comparison_dates"] = _rule("delivered_later", f"{_day('delivery_date')} < {_day('order_date')}", "dirty_orders")
ORACLES["rule_comparison_numbers"] = _rule("discount_below_tax", "NOT l_discount < l_tax", "lineitem")

# ------------------------------------------------------------------ findings, evidence, score

_FOUND = _union(
    f"SELECT '{check}' AS check_id, \"column\", severity, affected_rows, row_count FROM ({ORACLES['check_' + check]})"
    for check in ("missing_values", "invalid_email", "leading_trailing_whitespace", "impossible_numeric")
)
ORACLES["findings_sorted"] = f"SELECT check_id, \"column\", severity, affected_rows FROM ({_FOUND})"
ORACLES["finding_ids"] = (
    f"SELECT substr(sha256(concat('deterministic|', check_id, '|', check_id, '|', \"column\", '|')), 1, 16) AS finding_id, check_id, \"column\" FROM ({_FOUND})"
)
ORACLES["finding_summaries"] = (
    f"SELECT check_id AS issue_type, severity, \"column\", affected_rows, row_count AS total_rows FROM ({_FOUND})"
)
_WEIGHT = "CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.6 WHEN 'medium' THEN 0.3 WHEN 'low' THEN 0.1 ELSE 0.0 END"
_CHARGED = f"SELECT \"column\", sum({_WEIGHT} * affected_rows / row_count * 100) AS penalty, count(*) AS n FROM ({_FOUND}) GROUP BY \"column\""
_COLUMN_SCORES = (
    "SELECT c.\"column\", round(greatest(0, least(100, 100 - coalesce(p.penalty, 0))), 2) AS score, round(coalesce(p.penalty, 0), 2) AS penalty, "
    f"coalesce(p.n, 0) AS finding_count FROM ({ORACLES['infer_types']}) c LEFT JOIN ({_CHARGED}) p ON c.\"column\" = p.\"column\""
)
ORACLES["column_scores"] = _COLUMN_SCORES
ORACLES["worst_columns"] = f"SELECT * FROM ({_COLUMN_SCORES}) ORDER BY score, \"column\" LIMIT 3"
_SEVERITY_COUNTS = ", ".join(
    f"(SELECT count(*) FROM ({_FOUND}) WHERE severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info")
)
ORACLES["quality_score"] = (
    "SELECT overall, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 60 THEN 'C' WHEN overall >= 40 THEN 'D' ELSE 'E' END AS grade, "
    f"CAST(0 AS DOUBLE) AS dataset_penalty, {_SEVERITY_COUNTS} FROM (SELECT round(avg(score), 2) AS overall FROM ({_COLUMN_SCORES}))"
)
ORACLES["severity_counts"] = _union(
    f"SELECT '{s}' AS severity, count(*) AS findings FROM ({_FOUND}) WHERE severity = '{s}'" for s in ("critical", "high", "medium", "low", "info")
)


def _rows(check: str, column: str, test: str) -> str:
    return f"(SELECT '{check}' AS check_id, '{column}' AS \"column\", row_key AS row_id FROM dirty_customer WHERE {test} ORDER BY row_key LIMIT 200)"


ORACLES["evidence_rows"] = _union(
    [
        _rows("invalid_email", "email", f"NOT {_gap('email')} AND NOT {_EMAIL}"),
        _rows("leading_trailing_whitespace", "full_name", "trim(full_name) <> full_name"),
        _rows("missing_values", "email", _gap("email")),
        _rows("missing_values", "age", _gap("age")),
        _rows("impossible_numeric", "age", f"{_AGE} < 0 OR {_AGE} > 120"),
        _rows("future_date", "signup_date", f"{_day('signup_date')} > {TODAY}"),
        _rows("placeholder_values", "segment", "segment = 'unknown'"),
    ]
)
ORACLES["structural_findings"] = (
    _union(
        f"SELECT 'missing_values' AS check_id, * FROM ({_brief(c, _severity(_RATIO), f'count(*) FILTER (WHERE {_gap(c)})')})" for c in CUSTOMER
    )
    + f" UNION ALL SELECT 'constant_column', * FROM ({ORACLES['check_constant_column']})"
    + f" UNION ALL SELECT 'business_rule', \"column\", severity, affected_rows, row_count FROM ({ORACLES['check_business_rules']})"
)

# ------------------------------------------------------------------ dependencies, spelling, imputation


def _pair(source: str) -> str:
    per_key = (
        f"SELECT {source} AS k, count(nation_name) AS filled, count(*) FILTER (WHERE nation_name IS NULL) AS gaps, "
        "count(DISTINCT nation_name) AS names FROM gappy_nation GROUP BY 1"
    )
    taught = "k IS NOT NULL AND filled > 0"
    return (
        f"SELECT '{source}' AS determinant, 'nation_name' AS target, coalesce(sum(filled) FILTER (WHERE {taught}), 0) AS evidence_rows, "
        f"count(*) FILTER (WHERE {taught}) AS distinct_keys, coalesce(bool_and(names = 1) FILTER (WHERE {taught}), false) AS decides, "
        f"coalesce(sum(gaps) FILTER (WHERE {taught}), 0) AS recoverable_rows, sum(gaps) - coalesce(sum(gaps) FILTER (WHERE {taught}), 0) AS unrecoverable_rows "
        f"FROM ({per_key})"
    )


ORACLES["pair_statistics"] = _union(_pair(source) for source in ("segment", "nation_key"))
ORACLES["functional_dependencies"] = (
    "SELECT determinant, target, evidence_rows, distinct_keys, recoverable_rows, unrecoverable_rows FROM ("
    + ORACLES["pair_statistics"] + ") WHERE decides AND evidence_rows >= 20 AND distinct_keys BETWEEN 2 AND 0.5 * evidence_rows"
)
ORACLES["lookup_table"] = (
    "SELECT nation_key AS key, min(nation_name) AS value FROM gappy_nation WHERE nation_key IS NOT NULL AND nation_name IS NOT NULL GROUP BY 1"
)


def _spelling(key: str) -> str:
    return (
        "SELECT from_value, to_value, n FROM (SELECT segment AS from_value, n, first_value(segment) OVER (PARTITION BY k ORDER BY n DESC, segment) AS to_value, "
        "max(n) OVER (PARTITION BY k) AS most, nth_value(n, 2) OVER (PARTITION BY k ORDER BY n DESC, segment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second "
        f"FROM (SELECT segment, {key} AS k, count(*) AS n FROM dirty_customer WHERE segment IS NOT NULL GROUP BY 1, 2)) WHERE from_value <> to_value AND most > second"
    )


_CASE_MAP, _CATEGORY_MAP = _spelling("lower(trim(segment))"), _spelling(_key("segment"))
ORACLES["canonical_spelling"] = _CASE_MAP
ORACLES["category_spelling"] = _CATEGORY_MAP
ORACLES["impute_median"] = _union(
    f"SELECT '{c}' AS \"column\", median({x}) AS median FROM dirty_customer" for c, x in (("age", _AGE), ("revenue", _MONEY))
)
ORACLES["impute_mode"] = _union(
    f"SELECT \"column\", value FROM (SELECT '{c}' AS \"column\", value, n, rn, max(n) FILTER (WHERE rn = 2) OVER () AS second FROM ("
    f"SELECT trim({c}) AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, trim({c})) AS rn FROM dirty_customer "
    f"WHERE NOT {_gap(c)} GROUP BY 1)) WHERE rn = 1 AND (second IS NULL OR n > second)"
    for c in ("segment", "city", "currency")
)

# ------------------------------------------------------------------ corrections

_REPAIRED = "CASE WHEN city = 'MalmÃ¶' THEN 'Malmö' ELSE city END"
ORACLES["proposal_mappings"] = (
    f"SELECT from_value, to_value, 'normalize_case' AS action, 'segment' AS \"column\" FROM ({_CASE_MAP}) "
    f"UNION ALL SELECT from_value, to_value, 'map_category', 'segment' FROM ({_CATEGORY_MAP})"
)
ORACLES["corrected_customers"] = (
    f"SELECT row_key AS row_id, trim(full_name) AS full_name, coalesce(m.to_value, segment) AS segment, {_REPAIRED} AS city, "
    f"strftime({_day('signup_date')}, '%Y-%m-%d') AS signup_date, {_MONEY} AS revenue, age "
    f"FROM dirty_customer LEFT JOIN ({_CASE_MAP}) m ON segment = m.from_value"
)
ORACLES["cleared_customers"] = (
    f"SELECT row_key AS row_id, CASE WHEN {_EMAIL} THEN email END AS email, CASE WHEN segment <> 'unknown' THEN segment END AS segment, "
    f"CASE WHEN {_day('signup_date')} IS NOT NULL THEN signup_date END AS signup_date, "
    f"coalesce(age, (SELECT CASE WHEN median({_AGE}) = floor(median({_AGE})) THEN concat(CAST(CAST(median({_AGE}) AS BIGINT) AS STRING), '.0') "
    f"ELSE CAST(median({_AGE}) AS STRING) END FROM dirty_customer)) AS age FROM dirty_customer"
)
ORACLES["recovered_nations"] = (
    "SELECT row_key AS row_id, nation_key, coalesce(nation_name, l.value) AS nation_name FROM gappy_nation "
    f"LEFT JOIN ({ORACLES['lookup_table']}) l ON nation_key = l.key"
)
ORACLES["drop_duplicates"] = f"SELECT min(row_key) AS row_id FROM repeated_orders GROUP BY {_ORDER_KEYS}"
ORACLES["drop_duplicates_shared_ids"] = "SELECT DISTINCT customer, status, lower(priority) AS priority FROM shared_ids"
ORACLES["clipped_ages"] = f"SELECT row_key AS row_id, CASE WHEN {_AGE} IS NOT NULL THEN greatest(0, least(75, {_AGE})) END AS clipped FROM dirty_customer"
ORACLES["proposed_removal"] = (
    "SELECT 'drop_duplicate_rows' AS action, affected AS rows_removed, affected AS affected_rows, true AS destructive FROM "
    f"(SELECT CAST(sum(n - 1) AS BIGINT) AS affected FROM (SELECT count(*) AS n FROM repeated_orders GROUP BY {_ORDER_KEYS}))"
)
_LONG_GROUPS = (
    "SELECT row_key, note, lower(trim(note)) AS k, count(DISTINCT trim(note)) OVER (PARTITION BY lower(trim(note))) AS forms FROM long_notes"
)
_LONG_FORMS = "SELECT note, lower(note) AS k, count(*) AS n FROM long_notes GROUP BY 1, 2"
_LONG_MAP = (
    "SELECT from_value, to_value, n FROM (SELECT note AS from_value, n, first_value(note) OVER (PARTITION BY k ORDER BY n DESC, note) AS to_value, "
    "max(n) OVER (PARTITION BY k) AS most, count(*) OVER (PARTITION BY k, n) AS alike, n AS own FROM "
    f"({_LONG_FORMS})) x WHERE from_value <> to_value AND most > own"
)
ORACLES["long_value_findings"] = (
    "SELECT 'inconsistent_capitalization' AS check_id, 'note' AS \"column\", 'low' AS severity, count(*) FILTER (WHERE forms > 1) AS affected_rows, "
    f"count(*) AS row_count FROM ({_LONG_GROUPS})"
)
ORACLES["long_value_evidence"] = (
    f"SELECT 'inconsistent_capitalization' AS check_id, 'note' AS \"column\", row_key AS row_id FROM ({_LONG_GROUPS}) WHERE forms > 1 ORDER BY row_key LIMIT 200"
)
ORACLES["long_value_mapping"] = f"SELECT md5(to_value) AS to_digest, n FROM ({_LONG_MAP})"
ORACLES["long_value_correction"] = (
    "SELECT row_key AS row_id, md5(coalesce(to_value, note)) AS note, CAST(length(code) AS INTEGER) AS code_length FROM long_notes "
    f"LEFT JOIN ({_LONG_MAP}) ON note = from_value"
)
_BRAND_FORMS = f"SELECT brand, {_key('brand')} AS k, lower(trim(brand)) AS f, count(*) AS n FROM marked_parts WHERE NOT {_gap('brand')} GROUP BY 1, 2, 3"
ORACLES["marks_stay_gaps"] = (
    "SELECT f.brand AS from_value, w.brand AS to_value, f.n FROM "
    f"({_BRAND_FORMS}) f JOIN (SELECT k, max(n) AS most, count(*) AS forms FROM ({_BRAND_FORMS}) WHERE k <> '' GROUP BY k) m ON f.k = m.k "
    f"JOIN (SELECT k, n, min(brand) AS brand, count(*) AS leaders FROM ({_BRAND_FORMS}) GROUP BY k, n) w ON w.k = f.k AND w.n = m.most "
    "WHERE leaders = 1 AND f.brand <> w.brand"
)
ORACLES["tied_spellings"] = (
    "SELECT m.f AS key, count(*) AS leaders FROM "
    f"({_BRAND_FORMS}) b JOIN (SELECT f, max(n) AS most FROM ({_BRAND_FORMS}) GROUP BY f HAVING count(*) > 1) m ON b.f = m.f AND b.n = m.most GROUP BY 1"
)
ORACLES["wide_dependencies"] = ORACLES["functional_dependencies"].replace("gappy_nation", "wide_nation")
ORACLES["dataset_profile"] = (
    "SELECT t.*, d.* FROM (SELECT max(row_count) AS row_count, count(*) AS column_count, CAST(sum(row_count) AS BIGINT) AS total_cells, "
    "CAST(sum(missing) AS BIGINT) AS missing_cells, sum(missing) / sum(row_count) AS missing_ratio FROM ("
    + _union(f"SELECT count(*) AS row_count, count(*) FILTER (WHERE {_gap(c)}) AS missing FROM repeated_orders" for c in ("customer", "status", "priority"))
    + ")) t, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, count(*) FILTER (WHERE n > 1) AS duplicate_groups "
    "FROM (SELECT count(*) AS n FROM repeated_orders GROUP BY customer, status, priority)) d"
)
ORACLES["correction_previews"] = (
    "SELECT action, row_id, \"column\", before, after FROM ("
    "(SELECT 'strip_whitespace' AS action, row_key AS row_id, 'full_name' AS \"column\", concat('[', full_name, ']') AS before, trim(full_name) AS after "
    "FROM dirty_customer WHERE trim(full_name) <> full_name ORDER BY row_key LIMIT 10) UNION ALL "
    f"(SELECT 'parse_dates', row_key, 'signup_date', signup_date, coalesce(strftime({_day('signup_date')}, '%Y-%m-%d'), '(empty)') "
    f"FROM dirty_customer WHERE signup_date <> coalesce(strftime({_day('signup_date')}, '%Y-%m-%d'), '') ORDER BY row_key LIMIT 10) UNION ALL "
    f"(SELECT 'cast_to_numeric', row_key, 'revenue', revenue, coalesce(CAST({_MONEY} AS STRING), '(empty)') FROM dirty_customer "
    "ORDER BY row_key LIMIT 10))"
)

_REWRITTEN = f"signup_date <> coalesce(strftime({_day('signup_date')}, '%Y-%m-%d'), '')"
_DAMAGED = "count(*) FILTER (WHERE city = 'MalmÃ¶')"


def _offer(action: str, column: str, affected: str, destructive: bool, confidence: float, source: str = "dirty_customer") -> str:
    return (
        f"SELECT '{action}' AS action, '{column}' AS \"column\", {affected} AS affected_rows, "
        f"{str(destructive).lower()} AS destructive, CAST({confidence} AS DOUBLE) AS confidence FROM {source}"
    )


ORACLES["proposals"] = _union(
    [
        _offer("parse_dates", "signup_date", f"count(*) FILTER (WHERE {_REWRITTEN})", True, 0.7),
        _offer("cast_to_numeric", "revenue", f"count({_MONEY})", True, 1),
        _offer("normalize_case", "segment", "sum(n)", False, 1, f"({_CASE_MAP})"),
        _offer("map_category", "segment", "sum(n)", False, 1, f"({_CATEGORY_MAP})"),
        _offer("strip_whitespace", "full_name", "count(*) FILTER (WHERE trim(full_name) <> full_name)", False, 1),
        _offer("clear_invalid_values", "email", f"count(*) FILTER (WHERE NOT {_gap('email')} AND NOT {_EMAIL})", True, 1),
        _offer("clear_invalid_values", "signup_date", f"count(*) FILTER (WHERE {_day('signup_date')} IS NULL)", True, 1),
        _offer("clear_invalid_values", "segment", "count(*) FILTER (WHERE segment = 'unknown')", True, 1),
        _offer("fill_missing", "age", f"count(*) FILTER (WHERE {_gap('age')})", False, 0.5),
        _offer("repair_encoding", "city", _DAMAGED, False, 0.95),
    ]
)
ORACLES["proposals_with_status"] = (
    "SELECT action, \"column\", CASE WHEN action = 'strip_whitespace' THEN 'approved' ELSE 'pending' END AS status FROM ("
    + ORACLES["proposals"] + ")"
)
_MANUAL = " + ".join(
    f"(SELECT count(*) FROM ({ORACLES['check_' + check]}) WHERE {test})"
    for check, test in (
        ("constant_column", "true"), ("future_date", "true"), ("impossible_numeric", "true"), ("suspicious_numeric", "true"),
        ("missing_values", "\"column\" = 'email'"),
    )
)
ORACLES["decision_counts"] = (
    "SELECT actionable + manual_review AS total, actionable, approved, CAST(0 AS BIGINT) AS rejected, actionable + manual_review - approved AS pending, "
    "manual_review, CAST(0 AS BIGINT) AS advisory, actionable - approved AS pending_actionable FROM (SELECT count(*) AS actionable, "
    f"count(*) FILTER (WHERE action IN ('strip_whitespace', 'parse_dates')) AS approved, {_MANUAL} AS manual_review FROM ({ORACLES['proposals']}))"
)
_MERGED = (
    f"(SELECT s0, s1, coalesce(c.to_value, s1) AS s2 FROM (SELECT segment AS s0, coalesce(m.to_value, segment) AS s1 FROM dirty_customer "
    f"LEFT JOIN ({_CASE_MAP}) m ON segment = m.from_value) LEFT JOIN ({_CATEGORY_MAP}) c ON s1 = c.from_value)"
)


def _applied(action: str, column: str, changed: str, source: str = "dirty_customer") -> str:
    return f"SELECT '{action}' AS action, '{column}' AS \"column\", {changed} AS rows_changed FROM {source}"


ORACLES["applied_changes"] = "SELECT * FROM (" + _union(
    [
        _applied("repair_encoding", "city", _DAMAGED),
        _applied("strip_whitespace", "full_name", "count(*) FILTER (WHERE trim(full_name) <> full_name)"),
        _applied("normalize_case", "segment", "count(*) FILTER (WHERE s0 <> s1)", _MERGED),
        _applied("map_category", "segment", "count(*) FILTER (WHERE s1 <> s2)", _MERGED),
        _applied("cast_to_numeric", "revenue", "count(*)"),
        _applied("parse_dates", "signup_date", f"count(*) FILTER (WHERE {_REWRITTEN})"),
        _applied("clear_invalid_values", "email", f"count(*) FILTER (WHERE email IS NOT NULL AND NOT {_EMAIL})"),
        _applied("clear_invalid_values", "segment", "count(*) FILTER (WHERE s2 = 'unknown')", _MERGED),
        _applied("fill_missing", "age", f"count(*) FILTER (WHERE {_gap('age')})"),
    ]
) + ") WHERE rows_changed > 0"
_ORDERS = {
    "invalid_date": _brief("order_date", _severity(_RATIO), f"count(*) FILTER (WHERE {_day('order_date')} IS NULL)", "dirty_orders"),
    "inconsistent_date_format": ORACLES["check_mixed_date_format_orders"],
    "future_date": _brief("order_date", "'high'", f"count(*) FILTER (WHERE {_day('order_date')} > {TODAY})", "dirty_orders"),
    "numeric_stored_as_text": _brief("amount", "'medium'", f"count({_AMOUNT})", "dirty_orders"),
    "impossible_numeric": ORACLES["check_impossible_amounts"],
    "inconsistent_capitalization": _variants("priority", "lower(trim(priority))", "trim(priority)", "low").replace("dirty_customer", "dirty_orders"),
}
ORACLES["analysis_orders"] = _union(f"SELECT '{check}' AS check_id, * FROM ({sql})" for check, sql in _ORDERS.items())
_GIVEN = {
    c: f"SELECT 'business_rule' AS check_id, * FROM ({_brief(c, chr(39) + 'high' + chr(39), f'count(*) FILTER (WHERE {_gap(c)})', 'dirty_orders')})"
    for c in ("amount", "order_date")
}
ORACLES["checks_beside_failing_ones"] = _union(
    [ORACLES["analysis_orders"], *_GIVEN.values()]
    + [
        f"SELECT 'skipped: {name}', NULL, NULL, NULL, NULL FROM (SELECT count(*) FROM orders)"
        for name in ("breaking", "breaking_on_rows", "business_rule unreadable_pattern")
    ]
)

# ------------------------------------------------------------------ suggestions and reports

_LEVELS = f"(SELECT DISTINCT trim(segment) AS t FROM dirty_customer WHERE NOT {_gap('segment')})"
#: Each spelling is suggested to become its capital form, and each capital form to become its small one.
_FORWARD = f"SELECT t AS source, upper(t) AS target FROM {_LEVELS} WHERE t <> upper(t)"
_BACKWARD = f"SELECT DISTINCT upper(t) AS source, lower(t) AS target FROM {_LEVELS}"
_OCCUR = f"source IN {_LEVELS} AND target IN {_LEVELS}"
ORACLES["ground_mappings"] = (
    f"SELECT 'segment' AS \"column\", source, target, source <> target AND {_OCCUR} AS accepted FROM ({_BACKWARD}) UNION ALL "
    f"SELECT 'segment', t, upper(t), t <> upper(t) AND NOT starts_with(t, 'b') AND upper(t) IN {_LEVELS} AND NOT (lower(t) = t AND upper(t) IN {_LEVELS}) "
    f"FROM {_LEVELS} UNION ALL SELECT 'nowhere', t, 'X', false FROM {_LEVELS}"
)
_SOUND = (
    f"(SELECT source FROM ({ORACLES['ground_mappings']}) WHERE accepted)"
)
ORACLES["advisory_findings"] = (
    "SELECT 'advised_category_mapping' AS check_id, 'segment' AS \"column\", 'info' AS severity, 'advisory' AS source, "
    f"count(*) AS affected_rows FROM dirty_customer WHERE trim(segment) IN {_SOUND}"
)
ORACLES["table_preview"] = f"SELECT {', '.join(CUSTOMER)} FROM dirty_customer ORDER BY row_key LIMIT 50"

ORACLES["level_counts"] = (
    f"SELECT trim(segment) AS value, count(*) AS count FROM dirty_customer WHERE NOT {_gap('segment')} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60"
)
ORACLES["ground_descriptions"] = (
    "WITH made AS (SELECT i AS suggestion, c AS \"column\" FROM (VALUES "
    + ", ".join(f"({i}, '{c}'), ({i + 100}, '{c}')" for i, c in enumerate(CUSTOMER)) + ", "
    + ", ".join(f"({500 + i}, '{c}')" for i, c in enumerate(("order_date", "delivery_date", "amount", "priority")))
    + ") AS v(i, c)) SELECT CAST(suggestion AS BIGINT) AS suggestion, \"column\", suggestion < 100 AS accepted FROM made "
    "WHERE EXISTS (SELECT 1 FROM dirty_customer)"
)
ORACLES["ground_rules"] = _union(
    [f"SELECT concat(\"column\", '_range') AS name, semantic_type IN ('integer', 'float') AS accepted FROM ({ORACLES['infer_types']})"]
    + [
        f"SELECT '{c}_words', count(*) FILTER (WHERE lower(trim({c})) IN ('eur', 'rome')) > 0 FROM dirty_customer"
        for c in CUSTOMER
    ]
)
ORACLES["masked_columns"] = (
    f"SELECT \"column\", semantic_type IN ('email', 'identifier') OR regexp_matches(\"column\", '{'|'.join(SENSITIVE_FRAGMENTS)}') AS masked "
    f"FROM ({ORACLES['infer_types']})"
)
ORACLES["redacted_details"] = (
    "SELECT 'invalid_email' AS check_id, 'email' AS \"column\", concat('{\"examples_count\":\"', CAST(least(5, count(DISTINCT email)) AS STRING), '\"}') AS details "
    f"FROM dirty_customer WHERE NOT {_gap('email')} AND NOT {_EMAIL}"
)
ORACLES["audit_log"] = f"SELECT count(*) AS rows, CAST({len(CUSTOMER)} AS BIGINT) AS columns FROM dirty_customer"


# ------------------------------------------------------------------ files and history

ORACLES["csv_round_trip"] = f"SELECT {', '.join(f"coalesce({c}, '') AS {c}" for c in CUSTOMER)} FROM dirty_customer"
ORACLES["csv_semicolons"] = "SELECT CAST(row_key AS STRING) AS \"Key\", price AS key_1, price AS price FROM european_prices"
ORACLES["csv_line_breaks"] = (
    "SELECT CAST(p_partkey AS STRING) AS \"key\", CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, chr(10), p_type, ', \"', p_brand, '\"', chr(10)) "
    "WHEN p_partkey % 3 = 1 THEN concat('a ', chr(34), ' b') ELSE p_name END AS note, p_brand AS brand FROM part"
)
ORACLES["csv_latin"] = "SELECT customer_id, replace(replace(city, 'Ã¶', 'é'), chr(65533), 'é') AS city FROM dirty_customer"
ORACLES["stored_columns"] = (
    f"SELECT m.\"column\" AS name, m.row_count, missing_count, unique_count FROM ({ORACLES['missing_counts']}) m "
    f"JOIN ({ORACLES['cardinality']}) c ON m.\"column\" = c.\"column\""
)
ORACLES["stored_findings"] = f"SELECT \"column\" AS column_name, severity, affected_rows, row_count FROM ({ORACLES['check_missing_values']})"
ORACLES["recent_analyses"] = (
    f"SELECT 'dirty_customer' AS source_name, count(*) AS row_count, CAST({len(CUSTOMER)} AS INTEGER) AS column_count FROM dirty_customer "
    "UNION ALL SELECT 'gappy_nation', count(*), 3 FROM gappy_nation"
)
ORACLES["stored_events"] = "SELECT 'analysis.completed' AS event_type, count(*) AS rows FROM dirty_customer"
ORACLES["usage_totals"] = (
    "SELECT count(DISTINCT c_mktsegment) AS calls, count(*) AS input_tokens, 2 * count(*) AS output_tokens FROM customer"
)
ORACLES["ragged_rows"] = (
    "SELECT CAST(c_custkey AS STRING) AS \"key\", CASE WHEN c_custkey % 9 > 0 THEN c_mktsegment ELSE '' END AS segment, "
    "CASE WHEN c_custkey % 3 > 0 THEN CAST(c_nationkey AS STRING) ELSE '' END AS nation FROM customer"
)
ORACLES["opened_view"] = "SELECT segment, count(*) AS customers, min(row_key) AS first_row FROM dirty_customer GROUP BY segment"
ORACLES["header_findings"] = "SELECT 'schema_mismatch' AS check_id, 'medium' AS severity, CAST(0 AS BIGINT) AS affected_rows, count(*) AS row_count FROM european_prices"
ORACLES["stored_proposals"] = f"SELECT action, \"column\" AS column_name, status FROM ({ORACLES['proposals_with_status']})"
ORACLES["stored_changes"] = (
    "SELECT CAST(row_number() OVER (ORDER BY step) AS INTEGER) AS position, action, column_name, rows_changed FROM ("
    "SELECT 1 AS step, 'strip_whitespace' AS action, 'full_name' AS column_name, count(*) FILTER (WHERE trim(full_name) <> full_name) AS rows_changed FROM dirty_customer "
    f"UNION ALL SELECT 2, 'parse_dates', 'signup_date', count(*) FILTER (WHERE {_REWRITTEN}) FROM dirty_customer) WHERE rows_changed > 0"
)
ORACLES["history_after_a_failed_save"] = (
    f"SELECT 'dirty_customer' AS source_name, count(*) AS row_count, CAST({len(CUSTOMER)} AS BIGINT) AS columns, CAST(1 AS BIGINT) AS events FROM dirty_customer "
    "UNION ALL SELECT 'gappy_nation', count(*), 3, 1 FROM gappy_nation"
)

# ------------------------------------------------------------------ reviews, reports and evidence in groups

_EVERY_CHECK = _union(
    f"SELECT \"column\", severity, affected_rows, row_count FROM ({ORACLES['check_' + check]})"
    for check in (
        "missing_values", "constant_column", "placeholder_values", "invalid_email", "numeric_stored_as_text", "impossible_numeric", "suspicious_numeric", "future_date", "inconsistent_category",
        "inconsistent_capitalization", "leading_trailing_whitespace", "corrupted_encoding",
    )
) + " UNION ALL " + _union(
    [
        _brief("signup_date", _severity(_RATIO), f"count(*) FILTER (WHERE NOT {_gap('signup_date')} AND {_day('signup_date')} IS NULL)"),
        _brief(
            "signup_date", "'high'", f"count({_day('signup_date')})",
            fires=f"(SELECT count(DISTINCT contains(signup_date, '/')) FROM dirty_customer WHERE {_day('signup_date')} IS NOT NULL) > 1",
        ),
    ]
)


def _overall(view: str) -> str:
    """The score of a table from the findings of every check."""
    charged = f"SELECT \"column\", sum({_WEIGHT} * affected_rows / row_count * 100) AS penalty FROM ({_EVERY_CHECK}) GROUP BY \"column\""
    names = _union(f"SELECT '{c}' AS \"column\"" for c in CUSTOMER)
    return (
        "SELECT round(avg(round(greatest(0, least(100, 100 - coalesce(penalty, 0))), 2)), 2) AS overall "
        f"FROM ({names}) c LEFT JOIN ({charged}) p ON c.\"column\" = p.\"column\""
    ).replace("dirty_customer", view)


_FIXED = (
    "SELECT row_key, customer_id, trim(full_name) AS full_name, email, segment, age, revenue, "
    f"strftime({_day('signup_date')}, '%Y-%m-%d') AS signup_date, city, currency FROM dirty_customer"
)
ORACLES["score_after_corrections"] = (
    f"WITH fixed_customer AS ({_FIXED}) SELECT b.overall AS score_before, a.overall AS score_after, round(a.overall - b.overall, 2) AS score_delta, "
    "n AS rows_before, n AS rows_after, CAST(0 AS INTEGER) AS rows_removed, changed AS cells_changed "
    f"FROM ({_overall('dirty_customer')}) b, ({_overall('fixed_customer')}) a, (SELECT count(*) AS n, "
    f"count(*) FILTER (WHERE trim(full_name) <> full_name) + count(*) FILTER (WHERE {_REWRITTEN}) AS changed FROM dirty_customer) c"
)
ORACLES["manual_offers"] = _union(
    f"SELECT \"column\", affected_rows FROM ({ORACLES['check_' + check]}) WHERE {test}"
    for check, test in (
        ("constant_column", "true"), ("future_date", "true"), ("impossible_numeric", "true"), ("suspicious_numeric", "true"),
        ("missing_values", "\"column\" = 'email'"),
    )
)
ORACLES["application_order"] = (
    "SELECT CAST(list_position(['repair_encoding', 'strip_whitespace', 'normalize_case', 'map_category', 'cast_to_numeric', 'parse_dates', "
    f"'clear_invalid_values', 'clip_to_range', 'fill_from_related', 'fill_missing', 'drop_duplicate_rows'], action) AS BIGINT) AS step, action, \"column\" FROM ({ORACLES['proposals']})"
)
ORACLES["report_columns"] = (
    f"SELECT t.\"column\", semantic_type, missing_count, round(missing_count / m.row_count * 100, 1) AS missing_percent, unique_count FROM ({ORACLES['infer_types']}) t "
    f"JOIN ({ORACLES['missing_counts']}) m ON t.\"column\" = m.\"column\" JOIN ({ORACLES['cardinality']}) c ON t.\"column\" = c.\"column\""
)
ORACLES["column_summaries"] = (
    "SELECT t.\"column\", semantic_type AS inferred_type, missing_count AS missing, m.row_count, unique_count AS distinct_count, round(minimum, 4) AS lowest, "
    "round(maximum, 4) AS highest, masked, examples "
    f"FROM ({ORACLES['infer_types']}) t JOIN ({ORACLES['missing_counts']}) m ON t.\"column\" = m.\"column\" JOIN ({ORACLES['cardinality']}) c ON t.\"column\" = c.\"column\" "
    f"JOIN ({ORACLES['masked_columns']}) k ON t.\"column\" = k.\"column\" LEFT JOIN ({ORACLES['profile_numeric_text']}) p ON t.\"column\" = p.\"column\" LEFT JOIN ("
    + _union(
        f"SELECT '{c}' AS \"column\", string_agg({shown}, ';' ORDER BY first_row) AS examples FROM (SELECT {c}, min(row_key) AS first_row FROM dirty_customer "
        f"WHERE NOT {_gap(c)} GROUP BY 1 ORDER BY 2 LIMIT 5)"
        for c, shown in (("segment", "segment"), ("customer_id", "regexp_replace(regexp_replace(customer_id, '[0-9]', '9', 'g'), '[A-Z]', 'a', 'g')"))
    )
    + ") e ON t.\"column\" = e.\"column\""
)
ORACLES["probable_duplicate_examples"] = (
    "SELECT CAST(place - 1 AS INTEGER) AS place, CAST(member - 1 AS INTEGER) AS member, row_key AS row_id FROM ("
    "SELECT row_key, row_number() OVER (PARTITION BY r.k ORDER BY row_key) AS member, place FROM "
    f"({_COMPANY_ROWS}) r JOIN (SELECT k, row_number() OVER (ORDER BY min(row_key)) AS place FROM ({_COMPANY_ROWS}) WHERE same_key > 1 AND same_row = 1 GROUP BY k) g ON r.k = g.k "
    "WHERE place <= 5) WHERE member <= 4"
)
ORACLES["rules_read_from_yaml"] = (
    f"SELECT rule, affected FROM ({_RULE_COUNTS}) WHERE rule IN ('email_required', 'customer_id_unique', 'age_plausible', 'customer_id_format')"
)


#: DuckDB sums integers into 128 bits; these results are ordinary integers.
_INTEGERS = {
    "dataset_totals": ("total_cells", "missing_cells"),
    "duplicate_rows": ("duplicate_rows",),
    "duplicate_line_items": ("duplicate_rows",),
    "check_inconsistent_category": ("affected_rows",),
    "check_inconsistent_capitalization": ("affected_rows",),
    "check_exact_duplicates": ("affected_rows", "row_count"),
    "rule_unique": ("affected",),
    "pair_statistics": ("evidence_rows", "recoverable_rows", "unrecoverable_rows"),
    "functional_dependencies": ("evidence_rows", "recoverable_rows", "unrecoverable_rows"),
    "proposals": ("affected_rows",),
    "analysis_orders": ("affected_rows",),
    "checks_beside_failing_ones": ("affected_rows",),
}


def _as_integers(name: str, sql: str) -> str:
    casts = ", ".join(f"CAST({column} AS BIGINT) AS {column}" for column in _INTEGERS.get(name, ()))
    return f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql


def oracle_sql() -> dict[str, str]:
    return {name: with_views(_as_integers(name, sql)) for name, sql in ORACLES.items()}
