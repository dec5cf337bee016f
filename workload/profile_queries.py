"""Profiling, value frequencies, duplicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.functions import values
from dqspark.operators import detect, duplicates, privacy, profile, score
from dqspark.operators.cells import Layout, value_counts, with_names
from dqspark.operators.rules import Rule
from dqspark.plans.audit import audit
from dqspark.sources import readers

from .registry import bool_token, card, email, ident, inferred, ip, luhn, miss, num, phone, register, stamp, union, unique_of
from .tables import table, view
from .views import AS_OF, with_views

OPTIONS = profile.Options(as_of=AS_OF)
DIRTY = ("customer_id", "full_name", "email", "phone", "segment", "balance_amount", "status")
PEOPLE = ("person_code", "email", "phone", "status", "age", "discount_percent", "birth_date", "updated_at", "email_verified", "card_number", "host")


def _profile_sql(name: str, c: str, source: str) -> str:
    u, m = unique_of(c), f"count_if({miss(c)})"
    return f"""select '{name}' as column_name, {inferred(name, c)} as inferred_type, count(*) as row_count, cast({m} as bigint) as missing_count,
 round(cast({m} as double) / count(*), 4) as missing_rate, {u} as unique_count, round(cast({u} as double) / count(*), 4) as unique_rate,
 case when {u} = 0 then 'empty' when {u} = 1 then 'constant' when cast({u} as double) / count(*) <= 0.05 then 'low'
   when cast({u} as double) / count(*) >= 0.95 then 'unique' when cast({u} as double) / count(*) >= 0.5 then 'high' else 'medium' end as cardinality,
 {u} = 1 and count(*) > 1 as is_constant,
 (round(cast({u} as double) / count(*), 4) >= 0.95 or {str(any(t in name for t in ('id', 'key', 'uuid'))).lower()}) as identifier_candidate
 from {source}"""


@register("profile_columns", with_views(["customer_dirty"], union([_profile_sql(c, c, "customer_dirty") for c in DIRTY])))
def profile_columns(spark, sf_dir):
    found = profile.profile_columns(view(spark, sf_dir, "customer_dirty"), options=OPTIONS)
    return found.selectExpr(
        "column as column_name", "inferred_type", "row_count", "missing_count", "missing_rate", "unique_count", "unique_rate",
        "cardinality", "constant as is_constant", "identifier_candidate",
    )


@register("profile_types", with_views(["people"], union([
    f"select '{c}' as column_name, {inferred(c, c)} as inferred_type from people" for c in PEOPLE if c != "age"]
    + ["select 'age' as column_name, 'numeric' as inferred_type"])))
def profile_types(spark, sf_dir):
    df = view(spark, sf_dir, "people")
    layout = Layout.of(df)
    return with_names(profile.column_types(df, layout, OPTIONS), layout).selectExpr("column as column_name", "inferred_type")


def _numeric_sql(c: str) -> str:
    return f"""select '{c}' as column_name, min({c}) as min_value, max({c}) as max_value, round_even(avg({c}), 4) as mean_value,
 round(median({c}), 4) as median_value, round(stddev_pop({c}), 4) as std_dev,
 (select count(*) from lineitem, (select quantile_cont({c}, 0.25) as a, quantile_cont({c}, 0.75) as b from lineitem) q
   where b <> a and ({c} < a - 1.5 * (b - a) or {c} > b + 1.5 * (b - a))) as outlier_count
 from lineitem"""


@register("profile_numeric", union([_numeric_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]))
def profile_numeric(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", heavy=True).select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return profile.profile_columns(df, options=OPTIONS).selectExpr(
        "column as column_name", "min as min_value", "max as max_value", "mean as mean_value", "round(median, 4) as median_value",
        "std_dev", "outlier_count",
    )


@register("profile_text", with_views(["customer_dirty"], union([
    f"""select '{c}' as column_name, min(length(trim({c}))) as min_length, max(length(trim({c}))) as max_length,
 round(avg(length(trim({c}))), 2) as average_length from customer_dirty""" for c in ("full_name", "email", "phone", "segment", "status")])))
def profile_text(spark, sf_dir):
    df = view(spark, sf_dir, "customer_dirty").select("full_name", "email", "phone", "segment", "status")
    return profile.profile_columns(df, options=OPTIONS).selectExpr(
        "column as column_name", "cast(min_length as bigint) as min_length", "cast(max_length as bigint) as max_length", "average_length"
    )


@register("profile_documents", union([
    f"""select '{c}' as column_name, count(*) as row_count, count(distinct {c}) as unique_count,
 min(length(trim({c}, e' \\t\\n\\r'))) as min_length, max(length(trim({c}, e' \\t\\n\\r'))) as max_length from documents""" for c in ("text", "lang", "source")]))
def profile_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents", heavy=True).select("text", "lang", "source")
    return profile.profile_columns(df, options=OPTIONS).selectExpr(
        "column as column_name", "row_count", "unique_count", "cast(min_length as bigint) as min_length", "cast(max_length as bigint) as max_length"
    )


@register("profile_dates", with_views(["orders_dirty"], union([
    f"select '{c}' as column_name, cast(min({c}) as varchar) as first_at, cast(max({c}) as varchar) as last_at from orders_dirty"
    for c in ("start_date", "end_date")])))
def profile_dates(spark, sf_dir):
    df = view(spark, sf_dir, "orders_dirty").select("start_date", "end_date")
    return profile.profile_columns(df, options=OPTIONS).selectExpr(
        "column as column_name", "cast(first_timestamp as string) as first_at", "cast(last_timestamp as string) as last_at"
    )


def _risk_sql(c: str) -> str:
    u, m = unique_of(c), f"count_if({miss(c)})"
    rate = f"round(cast({m} as double) / count(*), 4)"
    return f"""select '{c}' as column_name, cast(least(100, case when count({c}) = 0 then 70 else 0 end
 + case when {rate} >= 0.5 then 45 when {rate} >= 0.1 then 25 when {rate} > 0 then 8 else 0 end
 + case when {u} = 1 and count(*) > 1 then 20 else 0 end) as int) as risk_score from customer_dirty"""


@register("profile_risk", with_views(["customer_dirty"], f"""select *, case when risk_score >= 50 then 'high' when risk_score >= 20 then 'medium'
 else 'low' end as risk_level from ({union([_risk_sql(c) for c in DIRTY if c != 'balance_amount'])})"""))
def profile_risk(spark, sf_dir):
    df = view(spark, sf_dir, "customer_dirty").drop("balance_amount")
    return profile.profile_columns(df, options=OPTIONS).selectExpr("column as column_name", "risk_score", "risk_level")


_ALL = ", ".join(DIRTY)
_MISSING = " + ".join(f"count_if({miss(c)})" for c in DIRTY)


@register("dataset_profile", with_views(["customer_dup"], f"""select t.n as row_count, 7 as column_count, cast(t.n - d.kinds as bigint) as duplicate_row_count,
 round(1 - cast(t.missing as double) / (t.n * 7), 4) as completeness_rate, round(cast(t.n - d.kinds as double) / t.n, 4) as duplicate_row_rate,
 cast(d.copies as bigint) as rows_in_duplicate_groups from (select count(*) as n, {_MISSING} as missing from customer_dup) t,
 (select count(*) as kinds, sum(case when k > 1 then k else 0 end) as copies from (select count(*) as k from customer_dup group by {_ALL})) d"""))
def dataset_profile(spark, sf_dir):
    found = profile.profile_dataset(view(spark, sf_dir, "customer_dup"), options=OPTIONS)
    return found.selectExpr(
        "row_count", "cast(column_count as int) as column_count", "duplicate_row_count", "completeness_rate", "duplicate_row_rate",
        "rows_in_duplicate_groups",
    )


@register("top_values", with_views(["customer_dirty"], "select * from (" + union([
    f"""select '{c}' as column_name, trim({c}) as value, count(*) as n,
 cast(row_number() over (order by count(*) desc, trim({c})) as int) as place from customer_dirty where {c} is not null group by trim({c})"""
    for c in DIRTY]) + ") where place <= 5"))
def top_values(spark, sf_dir):
    return profile.top_values(view(spark, sf_dir, "customer_dirty"), 5, sensitive=True).withColumnRenamed("column", "column_name")


@register("value_frequency", union([
    f"select '{c}' as column_name, cast({c} as varchar) as value, count(*) as n from events group by {c}" for c in ("user_id", "event_type")]))
def value_frequency(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_type")
    layout = Layout.of(df)
    return with_names(value_counts(df, layout), layout).selectExpr("column as column_name", "value", "n")


@register("top_values_long", """select 'text' as column_name, value, n, cast(row_number() over (order by n desc, value) as int) as place from (
 select trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as value, count(*) as n from documents group by 1) order by n desc, value limit 5""")
def top_values_long(spark, sf_dir):
    """The most frequent whole texts of the documents."""
    return profile.top_values(table(spark, sf_dir, "documents", heavy=True).select("text"), 5).withColumnRenamed("column", "column_name")


@register("sample_values", with_views(["customer_dirty"], "select * from (" + union([
    f"""select '{c}' as column_name, value, cast(row_number() over (order by value) as int) as place
 from (select distinct trim({c}) as value from customer_dirty where not {miss(c)})""" for c in DIRTY]) + ") where place <= 5"))
def sample_values(spark, sf_dir):
    return profile.sample_values(view(spark, sf_dir, "customer_dirty"), 5, sensitive=True).withColumnRenamed("column", "column_name")


@register("duplicate_rows", """select cast(sum(k - 1) as bigint) as duplicate_row_count, cast(sum(case when k > 1 then k else 0 end) as bigint) as rows_in_duplicate_groups
 from (select count(*) as k from documents group by text, lang, source, n_chars)""")
def duplicate_rows(spark, sf_dir):
    """Documents that differ by their id only."""
    df = table(spark, sf_dir, "documents", heavy=True).drop("doc_id")
    return duplicates.duplicate_counts(df, Layout.of(df))


@register("duplicate_rows_by_slice", """select source, lang, cast(sum(k - 1) as bigint) as duplicate_row_count, cast(sum(case when k > 1 then k else 0 end) as bigint) as rows_in_duplicate_groups
 from (select source, lang, count(*) as k from documents group by source, lang, text, n_chars) group by source, lang""")
def duplicate_rows_by_slice(spark, sf_dir):
    df = table(spark, sf_dir, "documents", heavy=True).drop("doc_id")
    return duplicates.duplicate_counts(df, Layout.of(df, ["source", "lang"]))


@register("key_duplicates", union([
    f"""select '{c}' as column_name, count(*) as unique_count, cast(coalesce(sum(case when k > 1 then k else 0 end), 0) as bigint) as repeated_rows
 from (select count(*) as k from lineitem group by {c})""" for c in ("l_orderkey", "l_partkey", "l_suppkey")]))
def key_duplicates(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", heavy=True).select("l_orderkey", "l_partkey", "l_suppkey")
    layout = Layout.of(df)
    return with_names(profile.distinct_measures(df, layout), layout).selectExpr("column as column_name", "unique_count", "repeated_rows")


@register("casing_variants", with_views(["customer_dirty"], union([
    f"""select '{c}' as column_name, cast(count(distinct {c}) - count(distinct lower(trim({c}))) as bigint) as variants from customer_dirty where not {miss(c)}"""
    for c in ("segment", "status")])))
def casing_variants(spark, sf_dir):
    df = view(spark, sf_dir, "customer_dirty").select("segment", "status")
    return detect.casing_variants(df, Layout.of(df)).selectExpr("column as column_name", "variants")


@register("profile_by_slice", with_views(["order_versions"], union([
    f"""select dataset, version, '{c}' as column_name, {inferred(c, c)} as inferred_type, count(*) as row_count,
 round(cast(count_if({miss(c)}) as double) / count(*), 4) as missing_rate, {unique_of(c)} as unique_count from order_versions group by dataset, version"""
    for c in ("order_key", "total", "remark", "state")])))
def profile_by_slice(spark, sf_dir):
    found = profile.profile_columns(view(spark, sf_dir, "order_versions"), ["dataset", "version"], OPTIONS)
    return found.selectExpr("dataset", "version", "column as column_name", "inferred_type", "row_count", "missing_rate", "unique_count")


@register("outliers_iqr", with_views(["orders_dirty"], """select 'total_amount' as column_name, round(a, 4) as q1, round(m, 4) as median_value, round(b, 4) as q3,
 (select count(*) from orders_dirty where total_amount < a - 1.5 * (b - a) or total_amount > b + 1.5 * (b - a)) as outlier_count
 from (select quantile_cont(total_amount, 0.25) as a, quantile_cont(total_amount, 0.5) as m, quantile_cont(total_amount, 0.75) as b from orders_dirty)"""))
def outliers_iqr(spark, sf_dir):
    df = view(spark, sf_dir, "orders_dirty").select("total_amount")
    layout = Layout.of(df)
    measures = profile.column_measures(df, layout, OPTIONS)
    found = profile.outlier_measures(df, layout, measures, OPTIONS)
    return with_names(found, layout).selectExpr(
        "column as column_name", "round(q1, 4) as q1", "round(median, 4) as median_value", "round(q3, 4) as q3", "outliers as outlier_count"
    )


@register("quantiles_grouped", """select l_returnflag, l_linestatus, count(*) as n, round(quantile_cont(l_extendedprice, 0.25), 4) as q1,
 round(quantile_cont(l_extendedprice, 0.5), 4) as q2, round(quantile_cont(l_extendedprice, 0.75), 4) as q3 from lineitem group by l_returnflag, l_linestatus""")
def quantiles_grouped(spark, sf_dir):
    from dqspark.operators.quantiles import exact_quantiles

    df = table(spark, sf_dir, "lineitem", heavy=True).selectExpr("l_returnflag", "l_linestatus", "l_extendedprice as x")
    found = exact_quantiles(df, ["l_returnflag", "l_linestatus"], [0.25, 0.5, 0.75])
    return found.selectExpr("l_returnflag", "l_linestatus", "n", "round(q0, 4) as q1", "round(q1, 4) as q2", "round(q2, 4) as q3")


@register("quantiles_sketched", """select l_returnflag, l_linestatus, count(*) as n, true as close from lineitem group by l_returnflag, l_linestatus""")
def quantiles_sketched(spark, sf_dir):
    """Quartiles from sketches, and whether the true share of rows up to each is within 2 % of what was asked."""
    from dqspark.operators.quantiles import sketched_quantiles

    keys = ["l_returnflag", "l_linestatus"]
    df = table(spark, sf_dir, "lineitem", heavy=True).selectExpr(*keys, "l_extendedprice as x")
    found = F.broadcast(sketched_quantiles(df, keys, [0.25, 0.5, 0.75]))  # a row per group
    off = " and ".join(f"abs(avg(if(x <= q{i}, 1D, 0D)) - {p}D) < 0.02D" for i, p in enumerate((0.25, 0.5, 0.75)))
    return df.join(found, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.expr(f"{off} as close"))


# --- privacy -----------------------------------------------------------------------
_NAME_CLASS = {
    "email": ("email", "high"), "phone": ("phone_number", "high"), "full_name": ("person_name", "high"),
    "card_number": ("payment_card", "critical"), "email_verified": None, "host": None, "status": None,
}
_RANK = {"medium": 2, "high": 3, "critical": 4}


def _privacy_sql(c: str, source: str) -> str:
    p = f"count_if(not {miss(c)})"
    share = lambda test: f"(cast(count_if(not {miss(c)} and {test}) as double) / nullif({p}, 0))"
    e, ph, i, cd = share(email(c)), share(phone(c)), share(ip(c)), share(card(c))
    pairs = [("email", 3, e, 2), ("phone_number", 3, ph, 3), ("network_identifier", 2, i, 4), ("payment_card", 4, cd, 5)]
    cands = [f"case when {s} >= 0.6 then {{'r': {r}, 'c': least(0.99, 0.75 + {s} * 0.24), 't': {-t}, 'k': '{k}'}} end" for k, r, s, t in pairs]
    named = _NAME_CLASS.get(c)
    if named:
        cands.append(f"{{'r': {_RANK[named[1]]}, 'c': cast(0.93 as double), 't': 0, 'k': '{named[0]}'}}")
    if any(t in c for t in ("id", "identifier", "number")):
        cands.append(f"case when {share(ident(c))} >= 0.8 and cast({unique_of(c)} as double) / nullif({p}, 0) >= 0.8 then {{'r': 3, 'c': cast(0.84 as double), 't': -9, 'k': 'personal_identifier'}} end")
    return f"select '{c}' as column_name, list_max(list_filter([{', '.join(cands)}], lambda x: x is not null)) as best from {source}"


_LEVEL = "case best.r when 2 then 'medium' when 3 then 'high' when 4 then 'critical' end"
_PRIVATE = ["customer_id", "full_name", "email", "phone", "segment", "status"]


@register("privacy_scan", with_views(["customer_dirty", "people"], f"""select column_name, best.k as classification, {_LEVEL} as sensitivity,
 round(best.c, 3) as confidence from ({union([_privacy_sql(c, 'customer_dirty') for c in _PRIVATE] + [_privacy_sql(c, 'people') for c in ('card_number', 'host')])})
 where best is not null"""))
def privacy_scan(spark, sf_dir):
    customers = profile.scan_privacy(view(spark, sf_dir, "customer_dirty").select(*_PRIVATE), options=OPTIONS)
    people = profile.scan_privacy(view(spark, sf_dir, "people").select("card_number", "host", "email_verified"), options=OPTIONS)
    return privacy.findings(customers.unionByName(people)).selectExpr("column as column_name", "classification", "sensitivity", "confidence")


@register("privacy_summary", with_views(["customer_dirty"], f"""select count(*) as sensitive_column_count,
 case max(best.r) when 2 then 'medium' when 3 then 'high' when 4 then 'critical' else 'low' end as highest_sensitivity,
 cast(0 as bigint) as low_count, count_if(best.r = 2) as medium_count, count_if(best.r = 3) as high_count, count_if(best.r = 4) as critical_count
 from ({union([_privacy_sql(c, 'customer_dirty') for c in _PRIVATE])}) where best is not null"""))
def privacy_summary(spark, sf_dir):
    return privacy.scan_summary(profile.scan_privacy(view(spark, sf_dir, "customer_dirty").select(*_PRIVATE), options=OPTIONS))


@register("privacy_conversations", f"""select count(*) as rows_seen, count_if({email('text')}) as email_rows, count_if({phone('text')}) as phone_rows,
 count_if(contains(text, '@')) as marked_rows from conversations""")
def privacy_conversations(spark, sf_dir):
    from dqspark.functions import fixed

    text = values.stripped("text")
    return table(spark, sf_dir, "conversations").selectExpr(
        "count(1) as rows_seen", f"count_if({values.is_email(text)}) as email_rows",
        f"count_if({values.is_phone(text)}) as phone_rows", "count_if(contains(text, '@')) as marked_rows",
    )


# --- scalar functions --------------------------------------------------------------
@register("luhn_check", with_views(["people"], f"select card_number, {luhn('card_number')} as valid from people"))
def luhn_check(spark, sf_dir):
    return view(spark, sf_dir, "people").selectExpr("card_number", f"{values.is_card('card_number')} as valid")


@register("title_case", """select o_orderkey, o_orderpriority as label,
 array_to_string(list_transform(regexp_extract_all(lower(o_orderpriority), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') as title from orders""")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderpriority as label", f"{values.title_case('o_orderpriority')} as title")


@register("hash_tokens", "select c_custkey, substr(sha256(c_name), 1, 12) as token from customer")
def hash_tokens(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{values.token('c_name')} as token")


@register("parse_numbers", with_views(["customer_dirty"], f"select customer_id, {num('balance_amount')} as amount from customer_dirty"))
def parse_numbers(spark, sf_dir):
    return view(spark, sf_dir, "customer_dirty").selectExpr("customer_id", f"{values.number_in(values.stripped('balance_amount'))} as amount")


@register("parse_timestamps", with_views(["people"], f"""select person_code, cast({stamp('birth_date')} as varchar) as born,
 cast({stamp('updated_at')} as varchar) as changed from people"""))
def parse_timestamps(spark, sf_dir):
    return view(spark, sf_dir, "people").selectExpr(
        "person_code", f"cast({values.timestamp_in('birth_date')} as string) as born", f"cast({values.timestamp_in('updated_at')} as string) as changed"
    )


@register("boolean_tokens", with_views(["people"], f"select email_verified, {bool_token('email_verified')} as is_token, count(*) as n from people group by 1, 2"))
def boolean_tokens(spark, sf_dir):
    from dqspark.functions import fixed

    found = view(spark, sf_dir, "people").selectExpr("email_verified", f"{values.in_tokens('email_verified', fixed.BOOLEAN_TOKENS)} as is_token")
    return found.groupBy("email_verified", "is_token").count().withColumnRenamed("count", "n")


@register("json_fields", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{values.json_field('props', '$.k', 'bigint')} as k")


# --- sources -----------------------------------------------------------------------
@register("na_tokens", with_views(["customer_dirty"], """select customer_id, case when balance_amount in ('n/a', 'NA', 'null', '') then null else balance_amount end as balance_amount
 from customer_dirty"""))
def na_tokens(spark, sf_dir):
    return readers.normalise_na(view(spark, sf_dir, "customer_dirty")).select("customer_id", "balance_amount")


@register("preview_rows", "select event_id, event_type, value from events order by event_id limit 10")
def preview_rows(spark, sf_dir):
    ordered = readers.validate_frame(table(spark, sf_dir, "events")).orderBy("event_id")
    return readers.preview(ordered, 10).select("event_id", "event_type", "value")


@register("privacy_safe_profile", union([
    f"""select '{c}' as column_name, round(avg({c}), 4) as mean_value, min({c}) as min_value, max({c}) as max_value from orders"""
    for c in ("o_totalprice",)]))
def privacy_safe_profile(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_totalprice")
    return score.privacy_safe_context(profile.profile_columns(df, options=OPTIONS)).selectExpr(
        "column as column_name", "mean as mean_value", "min as min_value", "max as max_value"
    )


# --- issues ------------------------------------------------------------------------
def _found(test: str, category: str, severity: str, title: str, rows: str, confidence: float, source: str) -> str:
    return f"""select '{category}' as category, {severity} as severity, '{title}' as title, cast({rows} as bigint) as affected_rows,
 round(cast({rows} as double) / (select count(*) from {source}), 4) as affected_rate, cast({confidence} as double) as confidence
 from {source} having {test}"""


def _missing_issue(c: str, source: str) -> str:
    m = f"count_if({miss(c)})"
    rate = f"round(cast({m} as double) / count(*), 4)"
    level = f"case when {rate} >= 0.5 then 'critical' when {rate} >= 0.2 then 'high' when {rate} >= 0.05 then 'medium' else 'low' end"
    return _found(f"{m} > 0", "completeness", level, f"Missing values in {c}", m, 0.98, source)


def _some(test: str, *rest) -> str:
    return _found(f"count_if({test}) > 0", rest[0], f"'{rest[1]}'", rest[2], f"count_if({test})", rest[3], rest[4])


def _repeats(c: str, category: str, severity: str, title: str, confidence: float, source: str) -> str:
    return f"""select '{category}' as category, '{severity}' as severity, '{title}' as title, cast(sum(k) as bigint) as affected_rows,
 round(cast(sum(k) as double) / (select count(*) from {source}), 4) as affected_rate, cast({confidence} as double) as confidence
 from (select count(*) as k from {source} where not {miss(c)} group by trim({c}) having count(*) > 1) having sum(k) > 0"""


def _outlier_issue(c: str, value: str, source: str) -> str:
    return f"""select 'anomaly' as category, 'medium' as severity, 'Outliers detected in {c}' as title, count(*) as affected_rows,
 round(cast(count(*) as double) / (select count(*) from {source}), 4) as affected_rate, cast(0.82 as double) as confidence
 from {source}, (select quantile_cont({value}, 0.25) as a, quantile_cont({value}, 0.75) as b from {source})
 where {value} < a - 1.5 * (b - a) or {value} > b + 1.5 * (b - a) having count(*) > 0"""


_CUSTOMER_ISSUES = union([
    *[_missing_issue(c, "customer_dup") for c in DIRTY],
    f"""select 'uniqueness' as category, 'medium' as severity, 'Duplicate rows detected' as title, cast(sum(k - 1) as bigint) as affected_rows,
 round(cast(sum(k - 1) as double) / sum(k), 4) as affected_rate, cast(0.99 as double) as confidence
 from (select count(*) as k from customer_dup group by {_ALL}) having sum(k - 1) > 0""",
    _repeats("customer_id", "uniqueness", "high", "Duplicate key values in customer_id", 0.94, "customer_dup"),
    _some(f"not {miss('email')} and not {email('email')}", "validity", "high", "Invalid email format in email", 0.96, "customer_dup"),
    _some(f"not {miss('phone')} and not {phone('phone')}", "validity", "medium", "Invalid phone format in phone", 0.88, "customer_dup"),
    _found("true", "privacy", "'high'", "Potential PII columns detected", "count(*)", 0.0, "customer_dup"),
    _outlier_issue("balance_amount", num("balance_amount"), "customer_dup"),
    _some(f"{num('balance_amount')} < 0", "validity", "high", "Negative monetary values in balance_amount", 0.9, "customer_dup"),
    _some(f"lower(trim(status)) = 'active' and {miss('email')} and {miss('phone')}", "integrity", "high", "Active records missing contact details", 0.9, "customer_dup"),
    f"""select 'consistency' as category, 'low' as severity, 'Inconsistent category casing in segment' as title,
 cast(count(distinct segment) - count(distinct lower(segment)) as bigint) as affected_rows,
 round(cast(count(distinct segment) - count(distinct lower(segment)) as double) / count(*), 4) as affected_rate, cast(0.84 as double) as confidence from customer_dup""",
])


@register("issues_customer", with_views(["customer_dup"], f"""select category, severity, title, affected_rows, affected_rate,
 case when category = 'privacy' then null else confidence end as confidence from ({_CUSTOMER_ISSUES})"""))
def issues_customer(spark, sf_dir):
    found = audit(view(spark, sf_dir, "customer_dup"), options=OPTIONS).issues
    return found.selectExpr(
        "category", "severity", "title", "affected_rows", "affected_rate", "if(category = 'privacy', null, confidence) as confidence"
    )


NOW = f"timestamp '{AS_OF}'"
_PEOPLE_ISSUES = union([
    *[_missing_issue(c, "people") for c in ("email", "phone", "discount_percent")],
    _some("age < 0 or age > 120", "validity", "high", "Impossible age values in age", 0.91, "people"),
    _some(f"{num('discount_percent')} < 0 or {num('discount_percent')} > 100", "validity", "medium", "Percentage values outside 0-100 in discount_percent", 0.87, "people"),
    _some(f"{stamp('birth_date')} > {NOW}", "validity", "medium", "Future dates in birth_date", 0.88, "people"),
    _some(f"{stamp('birth_date')} > {NOW} or {stamp('birth_date')} < {NOW} - interval 120 year", "validity", "high", "Impossible birth dates in birth_date", 0.9, "people"),
    _some(f"{stamp('updated_at')} > {NOW}", "validity", "medium", "Future dates in updated_at", 0.88, "people"),
    _some(f"{stamp('updated_at')} < {NOW} - interval 3 year", "timeliness", "medium", "Stale timestamp values in updated_at", 0.82, "people"),
    _some(f"lower(trim(status)) = 'active' and {miss('email')} and {miss('phone')}", "integrity", "high", "Active records missing contact details", 0.9, "people"),
])


@register("issues_people", with_views(["people"], _PEOPLE_ISSUES))
def issues_people(spark, sf_dir):
    df = view(spark, sf_dir, "people").select("email", "phone", "status", "age", "discount_percent", "birth_date", "updated_at")
    found = audit(df, options=OPTIONS).issues
    return found.where("category in ('completeness', 'validity', 'timeliness', 'integrity')").select(
        "category", "severity", "title", "affected_rows", "affected_rate", "confidence"
    )


_ORDER_ISSUES = union([
    """select 'completeness' as category, 'low' as severity, 'Missing values in total_amount' as title, count_if(total_amount is null) as affected_rows,
 round(cast(count_if(total_amount is null) as double) / count(*), 4) as affected_rate, cast(0.98 as double) as confidence from orders_dirty""",
    _some("end_date < start_date", "integrity", "high", "end_date is before start_date", 0.93, "orders_dirty"),
    """select 'uniqueness' as category, 'medium' as severity, 'Duplicate rows detected' as title, cast(sum(k - 1) as bigint) as affected_rows,
 round(cast(sum(k - 1) as double) / sum(k), 4) as affected_rate, cast(0.99 as double) as confidence
 from (select count(*) as k from orders_dirty group by start_date, end_date, total_amount) having sum(k - 1) > 0""",
    f"""select 'privacy' as category, 'high' as severity, 'Potential PII columns detected' as title, count(*) as affected_rows, cast(1 as double) as affected_rate,
 round(least(0.99, 0.75 + 0.24 * count_if({phone('cast(total_amount as varchar)')}) / count(total_amount)), 3) as confidence from orders_dirty
 having count_if({phone('cast(total_amount as varchar)')}) >= 0.6 * count(total_amount)""",
])


@register("issues_orders", with_views(["orders_dirty"], _ORDER_ISSUES))
def issues_orders(spark, sf_dir):
    df = view(spark, sf_dir, "orders_dirty").select("start_date", "end_date", "total_amount")
    return audit(df, options=OPTIONS).issues.select("category", "severity", "title", "affected_rows", "affected_rate", "confidence")


EXPECTED = detect.Expectations(
    required_columns=["CUSTOMER_ID", "region"], unique_columns=["customer_id", "email"],
    expected_types={"balance_amount": "text", "segment": "text"},
    allowed_values={"segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]},
    numeric_ranges={"balance_amount": (0, 5000)},
)


@register("issues_expectations", with_views(["customer_dup"], union([
    _found("true", "schema", "'critical'", "Required column missing: region", "count(*)", 0.99, "customer_dup"),
    _repeats("customer_id", "uniqueness", "critical", "Configured unique column has duplicates: customer_id", 0.98, "customer_dup"),
    _repeats("email", "uniqueness", "critical", "Configured unique column has duplicates: email", 0.98, "customer_dup"),
    _found("true", "schema", "'high'", "Unexpected type for balance_amount", "count(*)", 0.89, "customer_dup"),
    _some(f"not {miss('segment')} and segment not in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')", "validity", "high", "Values outside allowed set in segment", 0.95, "customer_dup"),
    _some(f"{num('balance_amount')} < 0 or {num('balance_amount')} > 5000", "validity", "high", "Configured numeric range violated in balance_amount", 0.94, "customer_dup"),
])))
def issues_expectations(spark, sf_dir):
    found = audit(view(spark, sf_dir, "customer_dup"), expectations=EXPECTED, options=OPTIONS).issues
    wanted = "title like 'Required column%' or title like 'Configured%' or title like 'Unexpected type%' or title like 'Values outside allowed%'"
    return found.where(wanted).select("category", "severity", "title", "affected_rows", "affected_rate", "confidence")


DATED = detect.Expectations(date_ranges={"updated_at": ("2020-01-01", "today")}, stale_after_days={"birth_date": 20000})


@register("issues_date_expectations", with_views(["people"], union([
    _some(f"{stamp('updated_at')} < timestamp '2020-01-01' or {stamp('updated_at')} > {NOW}", "validity", "high", "Configured date range violated in updated_at", 0.94, "people"),
    _some(f"{stamp('birth_date')} < {NOW} - interval 20000 day", "validity", "medium", "Configured staleness threshold exceeded in birth_date", 0.88, "people"),
])))
def issues_date_expectations(spark, sf_dir):
    df = view(spark, sf_dir, "people").select("birth_date", "updated_at")
    layout = Layout.of(df)
    checks = detect.row_checks(layout, DATED, OPTIONS)
    raised = detect.row_issues(detect.count_rows(df, layout, [c.predicate for c in checks]), layout, checks)
    return detect.number_issues(raised, layout).select("category", "severity", "title", "affected_rows", "affected_rate", "confidence")


@register("finding_examples", with_views(["orders_dirty"], """select * from (
 select 'end_date is before start_date' as finding, cast(row_number() over (order by o_orderkey) as int) as place, cast(o_orderkey as varchar) as order_key from orders_dirty where end_date < start_date
 union all select 'Missing values in total_amount', cast(row_number() over (order by o_orderkey) as int), cast(o_orderkey as varchar) from orders_dirty where total_amount is null
 union all select 'Large orders failed', cast(row_number() over (order by o_orderkey) as int), cast(o_orderkey as varchar) from orders_dirty where total_amount > 450000) where place <= 3"""))
def finding_examples(spark, sf_dir):
    """Example rows of the audit's own findings."""
    rules = [Rule(1, "Large orders", "numeric_range", "total_amount", parameters={"max": 450000})]
    found = detect.finding_examples(view(spark, sf_dir, "orders_dirty"), ["o_orderkey"], rules, options=OPTIONS)
    return found.selectExpr("finding", "place", "key.o_orderkey as order_key").withColumn("order_key", F.col("order_key").cast("string"))


@register("issue_examples", with_views(["orders_dirty"], """select * from (
 select 'late' as finding, cast(row_number() over (order by o_orderkey) as int) as place, cast(o_orderkey as varchar) as order_key from orders_dirty where end_date < start_date
 union all
 select 'gap', cast(row_number() over (order by o_orderkey) as int), cast(o_orderkey as varchar) from orders_dirty where total_amount is null) where place <= 3"""))
def issue_examples(spark, sf_dir):
    found = detect.examples(
        view(spark, sf_dir, "orders_dirty"), {"late": "end_date < start_date", "gap": "total_amount is null"},
        ["o_orderkey", "total_amount"], ["o_orderkey"],
    )
    return found.selectExpr("finding", "place", "row['o_orderkey'] as order_key")
