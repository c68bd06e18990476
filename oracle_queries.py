"""DuckDB SQL for every registered query, over the driver's views.

Money and days are integers of hundredths throughout and turn into DOUBLE only at the
end, so nothing is rounded in floating point. ``t_…`` are the nine raw tables derived
from the driver's files, ``fact`` is the order-level fact.
"""

from __future__ import annotations

from parcelwise.plans.quality import CHECKS, KEY_CONSTRAINTS
from parcelwise.sources.schema import TABLE_SPECS


def _half_away(n: str, d: str) -> str:
    """n / d to the nearest integer, halves away from zero; NULL when d is 0."""
    sign = f"CASE WHEN (({n}) < 0) <> (({d}) < 0) THEN -1 ELSE 1 END"
    return f"({sign} * ((2 * abs({n}) + abs({d})) // (2 * nullif(abs({d}), 0))))"


def _out(hundredths: str) -> str:
    return f"CAST({hundredths} AS BIGINT) / 100e0"


def _days(end: str, start: str) -> str:
    return _half_away(f"epoch_us({end}) - epoch_us({start})", "864000000")


def _mean(column: str, where: str | None = None) -> str:
    """Mean of a hundredths column."""
    f = f" FILTER (WHERE {where})" if where else ""
    return _out(_half_away(f"sum({column}){f}", f"count({column}){f}"))


def _pct(part: str, whole: str) -> str:
    return _out(_half_away(f"10000 * CAST({part} AS HUGEINT)", f"CAST({whole} AS HUGEINT)"))


_LATE = "count(*) FILTER (WHERE delivery_status = 'Late')"
_ONTIME = "count(*) FILTER (WHERE delivery_status = 'On Time')"
_AVG_SCORE = _out(_half_away("100 * sum(review_score)", "count(review_score)"))
_NEG = "count(*) FILTER (WHERE review_score <= 2)"
_POS = "count(*) FILTER (WHERE review_score >= 4)"
_TOTAL = _out("sum(order_value)")

_TABLES = {
    "t_customers": """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_unique_id,
       lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
       n_name AS customer_city, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS customer_state
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "t_sellers": """
SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS seller_zip_code_prefix,
       n_name AS seller_city, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS seller_state
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "o_bought": """
SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderstatus = 'O' THEN 'shipped' ELSE 'delivered' END AS st,
       o_orderdate + INTERVAL ((o_orderkey * 7919) % 86400) SECOND AS bought,
       CASE WHEN o_orderkey % 499 <> 0 THEN
         o_orderdate + INTERVAL (4 + 4 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) DAY END AS due
FROM orders""",
    "o_approved": """
SELECT *, CASE WHEN k % 97 <> 0 THEN bought + INTERVAL (k % 48) HOUR END AS approved FROM o_bought""",
    "o_shipped": """
SELECT *, CASE WHEN k % 89 <> 0 THEN coalesce(approved, bought) + INTERVAL ((k * 31) % 220 - 3) HOUR END AS shipped
FROM o_approved""",
    "t_orders": """
SELECT CAST(k AS VARCHAR) AS order_id, CAST(c AS VARCHAR) AS customer_id, st AS order_status,
       bought AS order_purchase_timestamp, approved AS order_approved_at, shipped AS order_delivered_carrier_date,
       CASE WHEN st = 'shipped' OR k % 101 = 0 THEN NULL WHEN k % 313 = 0 THEN bought - INTERVAL 1 DAY
            ELSE coalesce(shipped, bought) + INTERVAL ((k * 37) % 290) HOUR END AS order_delivered_customer_date,
       due AS order_estimated_delivery_date
FROM o_shipped""",
    "t_order_items": """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS order_item_id, CAST(l_partkey AS VARCHAR) AS product_id,
       CAST(l_suppkey AS VARCHAR) AS seller_id, l_shipdate AS shipping_limit_date,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS freight_value
FROM lineitem""",
    "t_order_payments": """
SELECT CAST(CASE WHEN o_orderkey % 401 = 0 THEN -1 ELSE o_orderkey END AS VARCHAR) AS order_id,
       1 AS payment_sequential, lower(substr(o_orderpriority, 3)) AS payment_type,
       o_orderkey % 10 + 1 AS payment_installments, CAST(o_totalprice AS DECIMAL(12,2)) AS payment_value
FROM orders""",
    "t_order_reviews": """
SELECT CAST(event_id AS VARCHAR) AS review_id,
       CAST(CASE WHEN event_id % 211 = 0 THEN -1 WHEN event_id % 5 = 0 THEN event_id + 1 ELSE event_id END AS VARCHAR) AS order_id,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_type = 'purchase' THEN 5 WHEN event_type = 'signup' THEN 4
            WHEN event_type = 'click' THEN 3 WHEN event_type = 'view' THEN 2 WHEN event_type = 'error' THEN 1 END AS review_score,
       CAST(NULL AS VARCHAR) AS review_comment_title, props AS review_comment_message, ts AS review_creation_date,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS review_answer_timestamp
FROM events""",
    "t_products": """
SELECT CAST(p_partkey AS VARCHAR) AS product_id, CASE WHEN p_partkey % 53 <> 0 THEN p_brand END AS product_category_name,
       CAST(NULL AS INTEGER) AS product_name_lenght, CAST(NULL AS INTEGER) AS product_description_lenght,
       CAST(NULL AS INTEGER) AS product_photos_qty, CAST(p_size AS DECIMAL(12,2)) AS product_weight_g,
       CAST(NULL AS DECIMAL(12,2)) AS product_length_cm, CAST(NULL AS DECIMAL(12,2)) AS product_height_cm,
       CAST(NULL AS DECIMAL(12,2)) AS product_width_cm
FROM part""",
    "t_product_category_translation": """
SELECT DISTINCT p_brand AS product_category_name, replace(p_brand, 'Brand#', 'brand_') AS product_category_name_english
FROM part WHERE p_brand <> 'Brand#25'""",
    "t_geolocation": """
SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS geolocation_zip_code_prefix,
       CAST(c_nationkey * 1.5 - 20 AS DOUBLE) AS geolocation_lat, CAST(NULL AS DOUBLE) AS geolocation_lng,
       CAST(NULL AS VARCHAR) AS geolocation_city, CAST(NULL AS VARCHAR) AS geolocation_state
FROM customer""",
}

_FACT = {
    **_TABLES,
    "basket": """
SELECT order_id, count(*) AS item_count, sum(CAST(price * 100 AS BIGINT)) AS item_value,
       sum(CAST(freight_value * 100 AS BIGINT)) AS freight_value,
       sum(CAST((price + freight_value) * 100 AS BIGINT)) AS order_value
FROM t_order_items GROUP BY order_id""",
    "verdict": """
SELECT order_id, review_score FROM (
  SELECT order_id, review_score, row_number() OVER (PARTITION BY order_id
    ORDER BY review_answer_timestamp DESC NULLS LAST, review_id ASC NULLS FIRST, review_score ASC NULLS FIRST) AS place
  FROM t_order_reviews) WHERE place = 1""",
    "fact": f"""
SELECT o.order_id, o.customer_id, c.customer_state, c.customer_city, o.order_status, o.order_purchase_timestamp,
       o.order_approved_at, o.order_delivered_carrier_date, o.order_delivered_customer_date, o.order_estimated_delivery_date,
       {_days('o.order_delivered_customer_date', 'o.order_purchase_timestamp')} AS actual_delivery_days,
       {_days('o.order_estimated_delivery_date', 'o.order_purchase_timestamp')} AS estimated_delivery_days,
       {_days('o.order_delivered_customer_date', 'o.order_estimated_delivery_date')} AS delivery_delay_days,
       CASE WHEN o.order_estimated_delivery_date >= o.order_delivered_customer_date THEN 'On Time' ELSE 'Late' END AS delivery_status,
       {_days('o.order_delivered_carrier_date', 'o.order_approved_at')} AS seller_handling_days,
       {_days('o.order_delivered_customer_date', 'o.order_delivered_carrier_date')} AS carrier_shipping_days,
       b.item_count, b.item_value, b.freight_value, b.order_value, v.review_score,
       CASE v.review_score WHEN 5 THEN 'Satisfied' WHEN 4 THEN 'Satisfied' WHEN 3 THEN 'Neutral'
            WHEN 2 THEN 'Dissatisfied' WHEN 1 THEN 'Dissatisfied' END AS satisfaction_bucket,
       make_date(CAST(year(o.order_purchase_timestamp) AS INTEGER), CAST(month(o.order_purchase_timestamp) AS INTEGER), 1) AS order_month,
       year(o.order_purchase_timestamp) AS order_year
FROM t_orders o JOIN t_customers c USING (customer_id) LEFT JOIN basket b USING (order_id) LEFT JOIN verdict v USING (order_id)
WHERE o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL""",
}

_CATEGORIES = {
    **_FACT,
    "named_items": """
SELECT i.order_id, i.order_item_id, i.product_id, CAST((i.price + i.freight_value) * 100 AS BIGINT) AS item_total,
       coalesce(t.product_category_name_english, p.product_category_name, 'unknown') AS product_category
FROM t_order_items i LEFT JOIN t_products p USING (product_id)
LEFT JOIN t_product_category_translation t ON t.product_category_name = p.product_category_name""",
    "category_orders": """
SELECT order_id, product_category, sum(item_total) AS order_value, any_value(f.review_score) AS review_score,
       any_value(f.actual_delivery_days) AS actual_delivery_days, any_value(f.delivery_status) AS delivery_status
FROM named_items JOIN fact f USING (order_id) GROUP BY order_id, product_category""",
    "categories": f"""
SELECT product_category, count(*) AS order_count, {_TOTAL} AS total_order_value,
       {_mean('order_value')} AS avg_category_order_value, {_AVG_SCORE} AS avg_review_score,
       {_mean('actual_delivery_days')} AS avg_delivery_days, {_pct(_ONTIME, 'count(*)')} AS pct_on_time,
       {_pct(_LATE, 'count(*)')} AS pct_late, CAST(sum(order_value) AS HUGEINT) AS cents,
       {_half_away(f'10000 * CAST({_LATE} AS HUGEINT)', 'count(*)')} AS late_points
FROM category_orders GROUP BY product_category""",
}


def _with(ctes: dict[str, str], body: str) -> str:
    listed = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    return f"WITH {listed}\n{body}"


def _on_tables(body: str) -> str:
    return _with(_TABLES, body)


def _on_fact(body: str) -> str:
    return _with(_FACT, body)


def _on_categories(body: str) -> str:
    return _with(_CATEGORIES, body)


def _scan(name: str) -> str:
    kinds = {"decimal(12,2)": "DOUBLE", "int": "BIGINT", "smallint": "BIGINT"}
    columns = ", ".join(
        f"CAST({f.name} AS {kinds[f.type.simpleString()]}) AS {f.name}" if f.type.simpleString() in kinds else f.name
        for f in TABLE_SPECS[name].fields
    )
    return _on_tables(f"SELECT {columns} FROM t_{name}")


def _broken_texts() -> str:
    """All texts of a row, each twice with a line break between, as one."""
    rows = []
    for name, spec in TABLE_SPECS.items():
        texts = [f.name for f in spec.fields if f.type.simpleString() == "string"]
        twice = ", ".join(f"{c} || chr(13) || chr(10) || '\"\",' || chr(10) || {c}" for c in texts)
        rows.append(f"SELECT '{name}' AS table_name, concat_ws('|', {twice}) AS texts FROM t_{name}")
    return _on_tables("\nUNION ALL ".join(rows))


def _by_status(columns: str, where: str = "true") -> str:
    return _on_fact(f"SELECT delivery_status, {columns} FROM fact WHERE {where} GROUP BY delivery_status")


def _rollup(key: str, key_type: str) -> str:
    return _on_fact(f"""
SELECT CAST({key} AS {key_type}) AS {key}, count(*) AS order_count, {_TOTAL} AS total_order_value,
       {_mean('order_value')} AS avg_order_value, {_AVG_SCORE} AS avg_review_score,
       {_pct(_ONTIME, 'count(*)')} AS pct_on_time, {_pct(_LATE, 'count(*)')} AS pct_late,
       {_mean('actual_delivery_days')} AS avg_delivery_days, {_mean('delivery_delay_days')} AS avg_delivery_delay_days
FROM fact GROUP BY {key}""")


def _summary() -> str:
    return _by_status(f"""
count(*) AS order_count, {_pct('count(*)', 'sum(count(*)) OVER ()')} AS pct_of_orders, {_AVG_SCORE} AS avg_review_score,
{_pct(_NEG, 'count(review_score)')} AS pct_negative_reviews, {_pct(_POS, 'count(review_score)')} AS pct_positive_reviews,
{_mean('order_value')} AS avg_order_value, {_TOTAL} AS total_order_value,
{_mean('delivery_delay_days')} AS avg_delivery_delay_days, {_mean('actual_delivery_days')} AS avg_delivery_days""")


def _states(columns: str, min_orders: int) -> str:
    return f"SELECT {columns} FROM ({_rollup('customer_state', 'VARCHAR')}) WHERE order_count >= {min_orders}"


def _stage_bands(days: str, edges: tuple[int, ...], labels: tuple[str, ...], name: str) -> str:
    chain = " ".join(f"WHEN {days} < {100 * e} THEN '{label}'" for e, label in zip(edges, labels))
    return _on_fact(f"""
SELECT CASE {chain} ELSE '{labels[-1]}' END AS {name}, count(*) AS order_count, {_mean(days)} AS avg_{days},
       {_pct(_LATE, 'count(*)')} AS pct_late, {_AVG_SCORE} AS avg_review_score
FROM fact GROUP BY 1""")


_RANKED_ORDERS = """
SELECT order_id, order_value, delivery_status, review_score,
       ntile(4) OVER (ORDER BY order_value ASC NULLS LAST, order_id ASC) AS value_quartile
FROM fact"""

_SEVERE = "delivery_delay_days > 700"
_IS_LATE = "delivery_status = 'Late'"


def _views() -> dict[str, str]:
    days = (
        "actual_delivery_days",
        "estimated_delivery_days",
        "delivery_delay_days",
        "seller_handling_days",
        "carrier_shipping_days",
        "item_value",
        "freight_value",
        "order_value",
    )
    in_units = ", ".join(f"{_out(c)} AS {c}" for c in days)
    return {
        "view_order_metrics": _on_fact(f"""
SELECT order_id, customer_id, customer_state, customer_city, order_status, order_purchase_timestamp, order_approved_at,
       order_delivered_carrier_date, order_delivered_customer_date, order_estimated_delivery_date, {in_units},
       delivery_status, item_count, CAST(review_score AS BIGINT) AS review_score, satisfaction_bucket, order_month,
       CAST(order_year AS BIGINT) AS order_year
FROM fact"""),
        "view_reliability_summary": _summary(),
        "view_monthly": _rollup("order_month", "DATE"),
        "view_state": _rollup("customer_state", "VARCHAR"),
        "view_category_performance": _on_categories("SELECT * EXCLUDE (cents, late_points) FROM categories"),
    }


def _findings() -> dict[str, str]:
    sql = {
        "find_01_overall": _summary(),
        "find_02_satisfaction": _by_status(
            f"count(*) AS reviewed_orders, {_AVG_SCORE} AS avg_review_score, "
            f"{_pct(_NEG, 'count(*)')} AS pct_negative_reviews, {_pct(_POS, 'count(*)')} AS pct_positive_reviews",
            where="review_score IS NOT NULL",
        ),
        "find_03_score_distribution": _on_fact(f"""
SELECT delivery_status, CAST(review_score AS BIGINT) AS review_score, count(*) AS order_count,
       {_pct('count(*)', 'sum(count(*)) OVER (PARTITION BY delivery_status)')} AS pct_of_status_orders
FROM fact WHERE review_score IS NOT NULL GROUP BY delivery_status, review_score"""),
        "find_04_late_value_share": _by_status(
            f"count(*) AS order_count, {_TOTAL} AS total_order_value, {_mean('order_value')} AS avg_order_value, "
            f"{_pct('sum(order_value)', 'sum(sum(order_value)) OVER ()')} AS pct_of_total_order_value"
        ),
        "find_05_estimated_vs_actual": _by_status(
            f"count(*) AS order_count, {_mean('estimated_delivery_days')} AS avg_estimated_delivery_days, "
            f"{_mean('actual_delivery_days')} AS avg_actual_delivery_days, "
            f"{_mean('delivery_delay_days')} AS avg_delivery_delay_days, "
            f"{_out('max(delivery_delay_days)')} AS max_delivery_delay_days"
        ),
        "find_10_handling_bands": _stage_bands(
            "seller_handling_days", (2, 4, 7), ("Under 2 days", "2-3 days", "4-6 days", "7+ days"), "seller_handling_band"
        ),
        "find_11_shipping_bands": _stage_bands(
            "carrier_shipping_days", (2, 5, 8), ("Under 2 days", "2-4 days", "5-7 days", "8+ days"), "carrier_shipping_band"
        ),
        "find_12_contribution": _by_status(
            f"count(*) AS order_count, {_mean('seller_handling_days')} AS avg_seller_handling_days, "
            f"{_mean('carrier_shipping_days')} AS avg_carrier_shipping_days, "
            f"{_mean('delivery_delay_days')} AS avg_delivery_delay_days"
        ),
        "find_13_monthly": _rollup("order_month", "DATE"),
        "find_14_yearly": f"SELECT * EXCLUDE (avg_delivery_days) FROM ({_rollup('order_year', 'BIGINT')})",
        "find_15_delay_bands": _on_fact(f"""
SELECT CASE WHEN delivery_delay_days <= 0 THEN 'On Time' WHEN delivery_delay_days <= 200 THEN '1-2 days late'
            WHEN delivery_delay_days <= 700 THEN '3-7 days late' WHEN delivery_delay_days <= 1400 THEN '8-14 days late'
            ELSE '15+ days late' END AS delay_band,
       count(*) AS order_count, {_pct('count(*)', 'sum(count(*)) OVER ()')} AS pct_of_orders,
       {_AVG_SCORE} AS avg_review_score, {_mean('order_value')} AS avg_order_value, {_TOTAL} AS total_order_value
FROM fact GROUP BY 1"""),
        "find_16_severe": _on_fact(f"""
SELECT count(*) FILTER (WHERE {_SEVERE}) AS severely_delayed_orders, count(*) AS total_orders,
       {_pct(f'count(*) FILTER (WHERE {_SEVERE})', 'count(*)')} AS pct_severely_delayed_orders,
       {_out(f'sum(order_value) FILTER (WHERE {_SEVERE})')} AS severely_delayed_order_value, {_TOTAL} AS total_order_value,
       {_pct(f'sum(order_value) FILTER (WHERE {_SEVERE})', 'sum(order_value)')} AS pct_order_value_severely_delayed
FROM fact"""),
        "find_17_value_quartiles": _on_fact(f"""
SELECT value_quartile, count(*) AS order_count, {_mean('order_value')} AS avg_order_value,
       {_pct(_LATE, 'count(*)')} AS pct_late, {_AVG_SCORE} AS avg_review_score
FROM ({_RANKED_ORDERS}) GROUP BY value_quartile"""),
        "find_18_executive": _on_fact(f"""
SELECT count(*) AS total_delivered_orders, {_pct(_LATE, 'count(*)')} AS pct_late, {_pct(_ONTIME, 'count(*)')} AS pct_on_time,
       {_AVG_SCORE} AS overall_avg_review_score, {_mean('delivery_delay_days', _IS_LATE)} AS avg_delay_among_late_orders,
       {_TOTAL} AS total_order_value, {_out(f'sum(order_value) FILTER (WHERE {_IS_LATE})')} AS late_order_value,
       {_pct(f'sum(order_value) FILTER (WHERE {_IS_LATE})', 'sum(order_value)')} AS pct_order_value_late
FROM fact"""),
    }
    at_risk = _out("(2 * cents * late_points + 10000) // 20000")
    for suffix, least in (("", 100), ("_min400", 400), ("_min1500", 1500)):
        if least != 1500:
            sql[f"find_06_worst_states{suffix}"] = _states(
                "customer_state, order_count, pct_late, pct_on_time, avg_delivery_days, avg_delivery_delay_days, "
                "avg_review_score, total_order_value",
                least,
            )
            sql[f"find_07_best_states{suffix}"] = _states(
                "customer_state, order_count, pct_on_time, pct_late, avg_delivery_days, avg_review_score", least
            )
        if least != 400:
            sql[f"find_08_categories{suffix}"] = _on_categories(f"""
SELECT product_category, order_count, pct_late, pct_on_time, avg_delivery_days, avg_review_score, total_order_value
FROM categories WHERE order_count >= {least}""")
            sql[f"find_09_value_at_risk{suffix}"] = _on_categories(f"""
SELECT product_category, order_count, total_order_value, {at_risk} AS estimated_late_order_value, pct_late, avg_review_score
FROM categories WHERE order_count >= {least}""")
    return sql


def _dup(table: str, *key: str) -> str:
    keys = ", ".join(key)
    return f"SELECT count(*) FROM (SELECT {keys} FROM t_{table} GROUP BY {keys} HAVING count(*) > 1)"


def _orphan(child: str, parent: str, key: str) -> str:
    return (
        f"SELECT count(*) FROM t_{child} c WHERE NOT EXISTS (SELECT 1 FROM t_{parent} p WHERE p.{key} = c.{key})"
    )


def _where(table: str, condition: str) -> str:
    return f"SELECT count(*) FROM t_{table} WHERE {condition}"


_UNTRANSLATED = """SELECT DISTINCT product_category_name FROM t_products p WHERE product_category_name IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM t_product_category_translation t WHERE t.product_category_name = p.product_category_name)"""

_ISSUES = {
    "dup_customers": _dup("customers", "customer_id"),
    "dup_orders": _dup("orders", "order_id"),
    "dup_products": _dup("products", "product_id"),
    "dup_sellers": _dup("sellers", "seller_id"),
    "orphan_orders_customers": _orphan("orders", "customers", "customer_id"),
    "orphan_items_orders": _orphan("order_items", "orders", "order_id"),
    "orphan_items_products": _orphan("order_items", "products", "product_id"),
    "orphan_items_sellers": _orphan("order_items", "sellers", "seller_id"),
    "orphan_payments_orders": _orphan("order_payments", "orders", "order_id"),
    "orphan_reviews_orders": _orphan("order_reviews", "orders", "order_id"),
    "untranslated_categories": f"SELECT count(*) FROM ({_UNTRANSLATED})",
    "orders_missing_purchase": _where("orders", "order_purchase_timestamp IS NULL"),
    "delivered_missing_date": _where("orders", "order_status = 'delivered' AND order_delivered_customer_date IS NULL"),
    "items_missing_price": _where("order_items", "price IS NULL OR freight_value IS NULL"),
    "items_negative": _where("order_items", "least(price, freight_value) < 0"),
    "invalid_scores": _where("order_reviews", "review_score NOT IN (1, 2, 3, 4, 5)"),
    "delivered_before_purchase": _where("orders", "order_purchase_timestamp > order_delivered_customer_date"),
    "carrier_after_delivery": _where("orders", "order_delivered_customer_date < order_delivered_carrier_date"),
    "multi_review_orders": _dup("order_reviews", "order_id"),
    "dup_item_keys": _dup("order_items", "order_id", "order_item_id"),
    "dup_payment_keys": _dup("order_payments", "order_id", "payment_sequential"),
    "dup_categories": _dup("product_category_translation", "product_category_name"),
}


def _check_rows(names: list[str]) -> str:
    titles = {**CHECKS, **KEY_CONSTRAINTS}
    counted = " UNION ALL ".join(
        f"SELECT '{titles[n].name}' AS check_name, ({_ISSUES[n]}) AS issue_count" for n in names
    )
    return _on_tables(
        f"SELECT check_name, issue_count, CASE WHEN issue_count > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ({counted})"
    )


# The declared keys, NOT NULL columns and lengths, written out so that a rule missing from the
# package's schema shows.
_KEYS = {
    "customers": ("customer_id",),
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "order_payments": ("order_id", "payment_sequential"),
    "products": ("product_id",),
    "sellers": ("seller_id",),
    "product_category_translation": ("product_category_name",),
}
_REQUIRED = {
    "customers": ("customer_id", "customer_unique_id"),
    "orders": ("order_id", "customer_id", "order_status"),
    "order_items": ("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"),
    "order_payments": ("order_id", "payment_sequential"),
    "order_reviews": ("order_id",),
    "products": ("product_id",),
    "sellers": ("seller_id",),
    "product_category_translation": ("product_category_name",),
}
_LENGTHS = {
    "customers": {
        "customer_id": 50,
        "customer_unique_id": 50,
        "customer_zip_code_prefix": 5,
        "customer_city": 100,
        "customer_state": 2,
    },
    "orders": {"order_id": 50, "customer_id": 50, "order_status": 30},
    "order_items": {"order_id": 50, "product_id": 50, "seller_id": 50},
    "order_payments": {"order_id": 50, "payment_type": 30},
    "order_reviews": {"review_id": 50, "order_id": 50},
    "products": {"product_id": 50, "product_category_name": 100},
    "sellers": {"seller_id": 50, "seller_zip_code_prefix": 5, "seller_city": 100, "seller_state": 2},
    "product_category_translation": {"product_category_name": 100, "product_category_name_english": 100},
    "geolocation": {"geolocation_zip_code_prefix": 5, "geolocation_city": 100, "geolocation_state": 2},
}


def _null_rows() -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS issue_count FROM t_{name}"
        for name, columns in _REQUIRED.items()
        for c in columns
    )


def _length_rows() -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{c}' AS column_name, CAST({longest} AS BIGINT) AS max_length, "
        f"count(*) FILTER (WHERE length(rtrim({c}, ' ')) > {longest}) AS issue_count FROM t_{name}"
        for name, lengths in _LENGTHS.items()
        for c, longest in lengths.items()
    )


def _violations() -> str:
    parts = [
        f"SELECT '{name}: duplicate key' AS check_name, ({_dup(name, *key)}) AS issue_count"
        for name, key in _KEYS.items()
    ]
    parts.append(f"SELECT 'order_reviews: review_score is invalid', ({_ISSUES['invalid_scores']})")
    parts.append(f"SELECT table_name || ': ' || column_name || ' is NULL', issue_count FROM ({_null_rows()})")
    parts.append(f"SELECT table_name || ': ' || column_name || ' is too long', issue_count FROM ({_length_rows()})")
    return f"SELECT check_name, issue_count FROM ({' UNION ALL '.join(parts)}) WHERE issue_count > 0"


def _counts(alias: str) -> str:
    return _on_tables(
        " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS {alias} FROM t_{n}" for n in TABLE_SPECS)
    )


def _quality() -> dict[str, str]:
    return {
        **{f"dq_{n}": _check_rows([n]) for n in (*CHECKS, *KEY_CONSTRAINTS)},
        "dq_summary": _check_rows(list(CHECKS)),
        "dq_untranslated_names": _on_tables(_UNTRANSLATED),
        "dq_not_null": _on_tables(_null_rows()),
        "dq_lengths": _on_tables(_length_rows()),
        "dq_constraint_violations": _on_tables(_violations()),
        "row_counts": _counts("row_count"),
        "loaded_rows": _counts("loaded_rows"),
        "status_breakdown": _on_tables(f"""
SELECT order_status, count(*) AS order_count, {_pct('count(*)', 'sum(count(*)) OVER ()')} AS pct_of_orders
FROM t_orders GROUP BY order_status"""),
    }


def _parts() -> dict[str, str]:
    """Single expressions, filters, joins and aggregations the views are made of."""
    money = ", ".join(f"{_out(c)} AS {c}" for c in ("item_value", "freight_value", "order_value"))
    pairs = {
        "actual_delivery_days": ("order_delivered_customer_date", "order_purchase_timestamp"),
        "estimated_delivery_days": ("order_estimated_delivery_date", "order_purchase_timestamp"),
        "delivery_delay_days": ("order_delivered_customer_date", "order_estimated_delivery_date"),
        "seller_handling_days": ("order_delivered_carrier_date", "order_approved_at"),
        "carrier_shipping_days": ("order_delivered_customer_date", "order_delivered_carrier_date"),
    }
    diffs = ", ".join(f"{_out(_days(*pair))} AS {name}" for name, pair in pairs.items())
    ratio = _out(_half_away("CAST(price * 10000 AS HUGEINT)", "CAST(freight_value * 100 AS HUGEINT)"))
    return {
        "scalar_day_diffs": _on_tables(f"SELECT order_id, {diffs} FROM t_orders"),
        "scalar_nullif": _on_tables(
            f"SELECT order_id, CAST(order_item_id AS BIGINT) AS order_item_id, {ratio} AS price_to_freight FROM t_order_items"
        ),
        "scalar_category_name": _on_tables("""
SELECT product_id, coalesce(product_category_name_english, p.product_category_name, 'unknown') AS product_category
FROM t_products p LEFT JOIN t_product_category_translation t ON t.product_category_name = p.product_category_name"""),
        "scalar_delivery_status": _on_fact("SELECT order_id, delivery_status FROM fact"),
        "scalar_satisfaction_bucket": _on_tables("""
SELECT review_id, CAST(review_score AS BIGINT) AS review_score, CASE WHEN review_score IN (4, 5) THEN 'Satisfied'
  WHEN review_score = 3 THEN 'Neutral' WHEN review_score IN (1, 2) THEN 'Dissatisfied' END AS satisfaction_bucket
FROM t_order_reviews"""),
        "scalar_time_dims": _on_tables("""
SELECT order_id, CAST(strftime(order_purchase_timestamp, '%Y-%m-01') AS DATE) AS order_month,
       CAST(year(order_purchase_timestamp) AS BIGINT) AS order_year
FROM t_orders"""),
        "filter_delivered": _on_tables(
            "SELECT * FROM t_orders WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL"
        ),
        "join_inner_orders_customers": _on_tables(
            "SELECT order_id, customer_id, customer_state, customer_city FROM t_orders JOIN t_customers USING (customer_id)"
        ),
        "join_left_order_value": _on_fact(
            f"SELECT o.order_id, item_count, {money} FROM t_orders o LEFT JOIN basket USING (order_id)"
        ),
        "join_left_latest_review": _on_fact(
            "SELECT o.order_id, CAST(review_score AS BIGINT) AS review_score FROM t_orders o LEFT JOIN verdict USING (order_id)"
        ),
        "join_left_category_chain": _on_categories(
            "SELECT order_id, CAST(order_item_id AS BIGINT) AS order_item_id, product_id, product_category FROM named_items"
        ),
        "order_value": _on_fact(f"SELECT order_id, item_count, {money} FROM basket"),
        "latest_review_per_order": _on_fact("SELECT order_id, CAST(review_score AS BIGINT) AS review_score FROM verdict"),
        "category_orders": _on_categories(f"""
SELECT order_id, product_category, {_out('order_value')} AS order_value, CAST(review_score AS BIGINT) AS review_score,
       {_out('actual_delivery_days')} AS actual_delivery_days, delivery_status
FROM category_orders"""),
        "ntile_order_value": _on_fact(
            f"SELECT order_id, {_out('order_value')} AS order_value, CAST(value_quartile AS BIGINT) AS value_quartile "
            f"FROM ({_RANKED_ORDERS})"
        ),
    }


def oracle_sql() -> dict[str, str]:
    scans = {f"scan_{name}": _scan(name) for name in TABLE_SPECS}
    ingested = {f"ingest_{name}": _scan(name) for name in TABLE_SPECS}
    views = _views()
    return {
        **scans,
        **ingested,
        "ingest_refused_keeps_sellers": _scan("sellers"),
        "ingest_row_counts": _counts("row_count"),
        "ingest_line_breaks": _broken_texts(),
        "catalog_orders": _scan("orders"),
        "catalog_states": views["view_state"],
        "catalog_items_by_status": _on_fact("""
SELECT delivery_status, count(*) AS items, CAST(sum(CAST(price * 100 AS BIGINT)) AS BIGINT) / 100e0 AS price
FROM t_order_items JOIN fact USING (order_id) GROUP BY delivery_status"""),
        **_parts(),
        **views,
        "publish_order_metrics": views["view_order_metrics"],
        "publish_given_order_metrics": f"SELECT * FROM ({views['view_order_metrics']}) WHERE delivery_status = 'Late'",
        "publish_category_performance": views["view_category_performance"],
        "sql_named_order_metrics": _by_status(
            f"count(*) AS order_count, {_TOTAL} AS total_order_value, {_NEG} AS negative_reviews"
        ),
        "sql_named_states": f"SELECT * FROM ({views['view_state']}) WHERE pct_late > 30",
        **_findings(),
        **_quality(),
    }
