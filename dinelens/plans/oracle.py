"""Independent DuckDB SQL for each registered query (the correctness oracle).

Written straight from the reference's SQL semantics (join-then-aggregate,
name-join fan-out, per-row loops as window functions), over the driver's
base tables with the fixture mapping inlined as CTEs. Only the CTEs a
query uses (and their dependencies) are emitted.
"""

from __future__ import annotations

# Fixed value: Python str.isspace() characters as a regex class (same text
# as dinelens.functions.cleaning.WS_CLASS).
WS = (
    r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def strip(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '^{WS}+', ''), '{WS}+$', '')"


def rc(col: str) -> str:
    """Real city of an ``Area,City`` text."""
    return f"CASE WHEN contains({col}, ',') THEN trim(split_part({col}, ',', 2)) ELSE trim({col}) END"


def area(col: str) -> str:
    return f"CASE WHEN contains({col}, ',') THEN trim(split_part({col}, ',', 1)) ELSE trim({col}) END"


def aov(rev: str = "total_revenue", n: str = "total_orders") -> str:
    return f"ROUND({rev} / NULLIF({n}, 0), 2)"


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


cte(
    "raw_restaurants",
    [],
    """SELECT CAST(s_suppkey AS VARCHAR) AS id,
 'Merchant ' || CAST(CAST(FLOOR(s_suppkey/2) AS BIGINT) AS VARCHAR) AS name,
 CASE WHEN s_suppkey % 11 = 3 THEN NULL WHEN s_suppkey % 5 = 4 THEN r_name ELSE n_name || ', ' || r_name END AS city,
 CASE WHEN s_suppkey % 9 = 2 THEN '--' ELSE CAST(1 + (s_suppkey*7) % 4 AS VARCHAR) || '.' || CAST((s_suppkey*3) % 10 AS VARCHAR) END AS rating,
 '₹ ' || CAST(100 + 50*(s_suppkey % 12) AS VARCHAR) AS cost,
 CASE s_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' Indian' WHEN 3 THEN 'Indian' WHEN 4 THEN 'Chinese' WHEN 5 THEN 'Pizza,Fast Food' ELSE 'South Indian' END AS cuisine
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)

cte(
    "typed_input",
    [],
    """SELECT s_suppkey AS restaurant_id,
 'Merchant ' || CAST(CAST(FLOOR(s_suppkey/2) AS BIGINT) AS VARCHAR) AS restaurant_name,
 CASE WHEN s_suppkey % 11 = 3 THEN NULL WHEN s_suppkey % 5 = 4 THEN r_name ELSE n_name || ', ' || r_name END AS city,
 CASE s_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' Indian' WHEN 3 THEN 'Indian' WHEN 4 THEN 'Chinese' WHEN 5 THEN 'Pizza,Fast Food' ELSE 'South Indian' END AS cuisine,
 CASE WHEN s_suppkey % 9 = 2 THEN NULL ELSE CAST(CAST(1 + (s_suppkey*7) % 4 AS VARCHAR) || '.' || CAST((s_suppkey*3) % 10 AS VARCHAR) AS DOUBLE) END AS rating,
 CAST(100 + 50*(s_suppkey % 12) AS DOUBLE) + (s_suppkey % 5) * 0.5 AS cost_for_two
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)

cte(
    "raw_orders",
    ["raw_restaurants"],
    """SELECT CAST(l_orderkey*8 + l_linenumber AS VARCHAR) AS order_id, CAST(l_suppkey AS VARCHAR) AS r_id,
 CAST(o_custkey AS VARCHAR) AS user_id,
 CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS order_date,
 l_linestatus AS order_status,
 CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN NULL ELSE l_extendedprice END AS sales_amount,
 city AS restaurant_city
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN raw_restaurants ON id = CAST(l_suppkey AS VARCHAR)""",
)

cte(
    "raw_reviews",
    [],
    """SELECT d.doc_id AS review_id, CAST(CAST(FLOOR(SQRT(d.doc_id)) AS BIGINT) AS VARCHAR) AS restaurant_id,
 CASE WHEN d.doc_id % 50 = 7 THEN NULL WHEN d.doc_id % 50 = 9 THEN '   ' ELSE text END AS comment,
 CASE WHEN quality IS NULL THEN NULL ELSE 1 + 2*quality + 2*(1-toxic) END AS rating
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)

cte(
    "review_responses",
    ["raw_reviews"],
    """SELECT review_id,
 CASE WHEN review_id % 40 = 3 THEN 'not json'
  WHEN review_id % 40 = 11 THEN '{"sentiment": "Positive"} {"x": 1}' WHEN review_id % 40 = 17 THEN '{}'
  WHEN review_id % 40 = 23 THEN '{"sentiment": null, "topics": "Service", "extra": [1, {"y": 2}]}'
  WHEN review_id % 40 = 29 THEN '{"sentiment": "Negative"} as asked' WHEN review_id % 40 = 37 THEN '[{"sentiment": "Negative"}]'
  ELSE '<think>x</think>```json' || chr(10) || '{"sentiment": "' || CASE WHEN rating >= 4 THEN 'Positive' WHEN rating <= 2 THEN 'Negative' ELSE 'Neutral' END
   || '"' || CASE WHEN review_id % 13 = 0 THEN '' ELSE ', "topics": "' || CASE review_id % 4 WHEN 0 THEN 'Delivery, Food Quality' WHEN 1 THEN 'Packaging,, Delivery ' WHEN 2 THEN 'Service' ELSE 'Food Quality, Price' END || '"' END
   || ', "summary": "s' || CAST(review_id % 17 AS VARCHAR) || '"}' || chr(10) || '```' END AS response
FROM raw_reviews WHERE comment IS NOT NULL AND length(comment) >= 15""",
)

_NEG = {
    0: "[]",
    1: '["late delivery", "cold food"]',
    2: '["late delivery", "cold food", "rude staff", "wrong order", "high price", "small portions"]',
}
_POS = {
    0: '["great taste", "fast delivery"]',
    1: '["great taste", "fast delivery", "good packaging", "polite staff", "fair price", "big portions"]',
    2: "[]",
}


def _pick(d: dict[int, str]) -> str:
    k = "(CAST(restaurant_id AS BIGINT) + request) % 3"
    return f"CASE {k} WHEN 0 THEN '{d[0]}' WHEN 1 THEN '{d[1]}' ELSE '{d[2]}' END"


# Every comment's request: 30 comments of a restaurant each, by review id.
cte(
    "requests",
    ["raw_reviews"],
    """SELECT restaurant_id, review_id, comment, rating, CAST((pos - 1) // 30 AS BIGINT) AS request, CAST((pos - 1) % 30 + 1 AS INTEGER) AS rn
FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id ORDER BY review_id) AS pos
      FROM raw_reviews WHERE comment IS NOT NULL AND trim(comment) != '') n""",
)

cte(
    "insight_responses",
    ["requests"],
    f"""SELECT restaurant_id || '/' || CAST(request AS VARCHAR) AS request_id, restaurant_id, request,
 CASE WHEN CAST(restaurant_id AS BIGINT) % 10 = 4 THEN 'Rate limit reached, try again later'
 WHEN CAST(restaurant_id AS BIGINT) % 11 = 1 THEN '{{"positive_count": 1, "top_negative_themes": null}}'
 WHEN CAST(restaurant_id AS BIGINT) % 11 = 2 THEN '{{"positive_count": 1, "top_positive_themes": "great taste"}}'
 WHEN CAST(restaurant_id AS BIGINT) % 11 = 3 THEN '{{"positive_count": 3.0, "negative_count": "2", "neutral_count": 1.6, "top_negative_themes": ["a", "b", "c", "d", "e"]}}'
 WHEN CAST(restaurant_id AS BIGINT) % 11 = 5 THEN '{{"positive_count": "many"}}'
 WHEN CAST(restaurant_id AS BIGINT) % 11 = 9 THEN '{{"positive_count": 1}} then {{"negative_count": 2}}'
 WHEN CAST(restaurant_id AS BIGINT) % 11 = 10 THEN '{{}}'
 ELSE '<think>' || CAST(n AS VARCHAR) || ' reviews {{draft}}</think>```json' || chr(10)
  || '{{"positive_count": ' || CAST(pos AS VARCHAR) || ', "negative_count": ' || CAST(neg AS VARCHAR)
  || ', "neutral_count": ' || CAST(n - pos - neg AS VARCHAR)
  || ', "top_negative_themes": ' || {_pick(_NEG)}
  || ', "top_positive_themes": ' || {_pick(_POS)}
  || CASE WHEN CAST(restaurant_id AS BIGINT) % 7 = 5 THEN '' ELSE ', "summary": "Restaurant ' || restaurant_id || ' verdict."' END
  || '}}' || chr(10) || '```' END AS response
FROM (SELECT restaurant_id, request, COUNT(*) AS n, COUNT(CASE WHEN rating >= 4 THEN 1 END) AS pos,
             COUNT(CASE WHEN rating <= 2 THEN 1 END) AS neg
      FROM requests GROUP BY restaurant_id, request) t""",
)

cte(
    "stg_restaurants",
    ["raw_restaurants"],
    """SELECT CAST(id AS BIGINT) AS restaurant_id, name AS restaurant_name, city,
 CASE WHEN rating = '--' THEN NULL ELSE CAST(rating AS FLOAT) END AS rating,
 CAST(REPLACE(cost, '₹ ', '') AS INTEGER) AS cost_for_two, cuisine
FROM raw_restaurants""",
)

cte(
    "stg_orders",
    ["raw_orders"],
    """SELECT CAST(order_id AS BIGINT) AS order_id, CAST(r_id AS BIGINT) AS restaurant_id,
 CAST(user_id AS BIGINT) AS user_id, CAST(order_date AS DATE) AS order_date, order_status,
 CAST(sales_amount AS FLOAT) AS order_amount
FROM raw_orders""",
)

cte(
    "mart_orders",
    ["stg_orders", "stg_restaurants"],
    """SELECT r.restaurant_name, r.city, COUNT(o.order_id) AS total_orders, SUM(o.order_amount) AS total_revenue
FROM stg_orders o JOIN stg_restaurants r ON o.restaurant_id = r.restaurant_id
GROUP BY r.restaurant_name, r.city""",
)

# Candidates, recorded replies, parse.
_CLEAN_FENCES = strip("replace(replace(response, '```json', ''), '```', '')")
_CLEAN_REVIEW = strip(f"regexp_replace({_CLEAN_FENCES}, '(?is)<think>.*?</think>', '', 'g')")

cte(
    "candidates",
    ["raw_reviews"],
    """SELECT review_id, CAST(comment AS VARCHAR) AS text FROM raw_reviews
WHERE comment IS NOT NULL AND length(comment) >= 15""",
)


def _review_parse(src: str, keep: str) -> str:
    return f"""SELECT {keep}, COALESCE(j IS NOT NULL AND len(json_keys(j)) > 0, false) AS ok,
 CASE WHEN json_exists(j, '$.sentiment') THEN json_extract_string(j, '$.sentiment') ELSE 'Neutral' END AS sentiment,
 CASE WHEN json_exists(j, '$.topics') THEN json_extract_string(j, '$.topics') ELSE 'General' END AS topics,
 CASE WHEN json_exists(j, '$.summary') THEN json_extract_string(j, '$.summary') ELSE 'No summary' END AS summary
FROM (SELECT *, CASE WHEN json_valid(c) AND json_type(c) = 'OBJECT' THEN c END AS j
      FROM (SELECT *, CASE WHEN regexp_matches(c0, '(?s)^\\{{.*\\}}$') THEN c0 END AS c
            FROM (SELECT *, {_CLEAN_REVIEW} AS c0 FROM {src}) a) b) x"""


cte(
    "review_parsed",
    ["review_responses"],
    _review_parse("review_responses", "review_id"),
)

cte(
    "enriched",
    ["candidates", "review_responses"],
    """SELECT review_id, text AS original_text, ok, sentiment, topics, summary FROM ("""
    + _review_parse(
        "(SELECT c.review_id, c.text, r.response FROM candidates c LEFT JOIN review_responses r ON c.review_id = r.review_id) q",
        "review_id, text",
    )
    + ") e",
)

cte(
    "gold_review_sentiments",
    ["enriched"],
    "SELECT review_id, original_text, sentiment, topics, summary FROM enriched WHERE ok",
)

cte(
    "first_batch_done",
    ["candidates", "review_responses"],
    """SELECT review_id FROM ("""
    + _review_parse(
        "(SELECT c.review_id, c.text, r.response FROM (SELECT * FROM candidates ORDER BY review_id LIMIT 100) c LEFT JOIN review_responses r ON c.review_id = r.review_id) q",
        "review_id",
    )
    + ") f WHERE ok",
)

# Review volume, sample, bundle, insight replies.
cte(
    "commented",
    ["raw_reviews"],
    """SELECT CAST(restaurant_id AS VARCHAR) AS rid, review_id, comment FROM raw_reviews
WHERE comment IS NOT NULL AND trim(comment) != ''""",
)

cte(
    "volume_all",
    ["stg_restaurants", "raw_reviews"],
    """SELECT s.restaurant_id, s.restaurant_name, s.city, COUNT(r.comment) AS review_count
FROM stg_restaurants s JOIN raw_reviews r ON CAST(r.restaurant_id AS VARCHAR) = CAST(s.restaurant_id AS VARCHAR)
WHERE r.comment IS NOT NULL AND trim(r.comment) != ''
GROUP BY s.restaurant_id, s.restaurant_name, s.city
HAVING COUNT(r.comment) >= 5""",
)

cte(
    "sample30",
    ["commented"],
    """SELECT rid AS restaurant_id, rn, review_id, comment FROM (
 SELECT rid, review_id, comment, CAST(row_number() OVER (PARTITION BY rid ORDER BY review_id) AS INTEGER) AS rn
 FROM commented) s
WHERE rn <= 30""",
)

cte(
    "bundles",
    ["requests"],
    """SELECT restaurant_id, request, CAST(COUNT(*) AS INTEGER) AS n_reviews,
 string_agg(CAST(rn AS VARCHAR) || '. ' || comment, chr(10) ORDER BY rn) AS numbered_reviews
FROM requests GROUP BY restaurant_id, request""",
)

_CLEAN_INSIGHT0 = strip(f"regexp_replace({_CLEAN_FENCES}, '(?is)<think>.*?</think>', '', 'g')")
_COUNTS = ("positive_count", "negative_count", "neutral_count")
_THEMES = ("top_negative_themes", "top_positive_themes")


def _insight_parse(src: str, keep: str) -> str:
    def cnt(name):
        return (
            f"CASE WHEN json_exists(j, '$.{name}') THEN CAST(round_even(TRY_CAST(json_extract_string(j, '$.{name}') AS DOUBLE), 0) AS INTEGER) "
            f"ELSE 0 END AS {name}"
        )

    def themes(name):
        return (
            f"CASE WHEN json_type(j, '$.{name}') = 'ARRAY' THEN list_slice(CAST(json_extract(j, '$.{name}') AS VARCHAR[]), 1, 4) "
            f"WHEN json_exists(j, '$.{name}') THEN NULL ELSE CAST([] AS VARCHAR[]) END AS {name}"
        )

    good = [f"(json_type(j, '$.{n}') IS NULL OR json_type(j, '$.{n}') = 'NULL' OR TRY_CAST(json_extract_string(j, '$.{n}') AS DOUBLE) IS NOT NULL)" for n in _COUNTS]
    good += [f"(NOT json_exists(j, '$.{n}') OR json_type(j, '$.{n}') = 'ARRAY')" for n in _THEMES]
    return f"""SELECT {keep}, COALESCE(j IS NOT NULL AND {' AND '.join(good)}, false) AS ok,
 {', '.join(map(cnt, _COUNTS))}, {', '.join(map(themes, _THEMES))},
 CASE WHEN json_exists(j, '$.summary') THEN json_extract_string(j, '$.summary') ELSE '' END AS summary
FROM (SELECT *, CASE WHEN json_valid(c) AND json_type(c) = 'OBJECT' THEN c END AS j
      FROM (SELECT *, CASE WHEN regexp_extract(c0, '(?s)\\{{.*\\}}', 0) = '' THEN c0
                           ELSE regexp_extract(c0, '(?s)\\{{.*\\}}', 0) END AS c
            FROM (SELECT *, {_CLEAN_INSIGHT0} AS c0 FROM {src}) a) b) x"""


cte("insight_parsed", ["insight_responses"], _insight_parse("insight_responses", "request_id, restaurant_id, request"))


def _themes_of(kind: str) -> str:
    """The most frequent themes of a restaurant's replies, at most four."""
    return f"""(SELECT array_to_string(list_slice(list(theme ORDER BY n DESC, theme), 1, 4), ', ')
  FROM (SELECT theme, COUNT(*) AS n FROM (SELECT unnest({kind}) AS theme FROM p p2 WHERE p2.restaurant_id = p1.restaurant_id) u
        WHERE theme IS NOT NULL GROUP BY theme) c)"""


def _insights_build(volume: str) -> str:
    parse = _insight_parse(
        f"""(SELECT q.*, ir.response FROM (
   SELECT CAST(v.restaurant_id AS VARCHAR) AS restaurant_id, v.restaurant_name, v.city, b.request, b.n_reviews
   FROM {volume} v JOIN bundles b ON CAST(v.restaurant_id AS VARCHAR) = b.restaurant_id) q
  LEFT JOIN insight_responses ir ON q.restaurant_id = ir.restaurant_id AND q.request = ir.request) r""",
        "restaurant_id, restaurant_name, city, request, n_reviews",
    )
    sums = ", ".join(f"CASE WHEN bool_and(ok) THEN CAST(SUM({c}) AS INTEGER) END AS {c}" for c in _COUNTS)
    themes = ", ".join(f"CASE WHEN bool_and(ok) THEN COALESCE({_themes_of(k)}, '') END AS {k}" for k in _THEMES)
    return f"""WITH p AS ({parse})
SELECT restaurant_id, restaurant_name, city, CAST(SUM(n_reviews) AS INTEGER) AS review_count, {sums}, {themes},
 CASE WHEN bool_and(ok) THEN arg_min(summary, request) END AS summary, bool_and(ok) AS ok
FROM p p1 GROUP BY restaurant_id, restaurant_name, city"""


cte("insight_build", ["volume_all", "bundles", "insight_responses"], _insights_build("volume_all"))
cte("volume_even", ["volume_all"], "SELECT * FROM volume_all WHERE restaurant_id % 2 = 0")
cte("insight_first_run", ["volume_even", "bundles", "insight_responses"], _insights_build("volume_even"))
cte(
    "gold_restaurant_insights",
    ["insight_build"],
    """SELECT restaurant_id, restaurant_name, city, review_count, positive_count, negative_count, neutral_count,
 top_negative_themes, top_positive_themes, summary FROM insight_build WHERE ok""",
)


def with_ctes(names: list[str], select: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS (\n{CTES[n][1]}\n)" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + select if parts else select


# --------------------------------------------------------------- queries
ORACLE: dict[str, str] = {}


def q(key: str, ctes: list[str], select: str) -> None:
    ORACLE[key] = with_ctes(ctes, select)


CITY = "'EUROPE'"
TIES = "restaurant_name ASC NULLS LAST, city ASC NULLS LAST"
BY_REV = f"total_revenue DESC NULLS LAST, {TIES}"

# A
q("scan_raw_restaurants", ["raw_restaurants"], "SELECT * FROM raw_restaurants")
q("scan_raw_orders", ["raw_orders"], "SELECT * FROM raw_orders")
q("scan_raw_reviews", ["raw_reviews"], "SELECT * FROM raw_reviews")
q(
    "table_counts",
    ["stg_restaurants", "stg_orders", "mart_orders", "gold_review_sentiments"],
    """SELECT 'stg_restaurants' AS table_name, COUNT(*) AS row_count FROM stg_restaurants
UNION ALL SELECT 'stg_orders', COUNT(*) FROM stg_orders
UNION ALL SELECT 'mart_orders', COUNT(*) FROM mart_orders
UNION ALL SELECT 'gold_review_sentiments', COUNT(*) FROM gold_review_sentiments""",
)

# B
q("stg_restaurants", ["stg_restaurants"], "SELECT * FROM stg_restaurants")
q(
    "stg_restaurants_typed",
    ["typed_input"],
    """SELECT restaurant_id, restaurant_name, city, cuisine, CAST(rating AS FLOAT) AS rating,
 CAST(cost_for_two AS INTEGER) AS cost_for_two FROM typed_input""",
)
q("stg_orders", ["stg_orders"], "SELECT * FROM stg_orders")
q("mart_orders", ["mart_orders"], "SELECT * FROM mart_orders")
q(
    "restaurant_rejects",
    ["raw_restaurants"],
    """SELECT COUNT(*) FILTER (WHERE id IS NOT NULL AND TRY_CAST(id AS BIGINT) IS NULL) AS id_rejects,
 COUNT(*) FILTER (WHERE rating IS NOT NULL AND rating != '--' AND TRY_CAST(rating AS FLOAT) IS NULL) AS rating_rejects,
 COUNT(*) FILTER (WHERE cost IS NOT NULL AND TRY_CAST(REPLACE(cost, '₹ ', '') AS INTEGER) IS NULL) AS cost_rejects
FROM raw_restaurants""",
)
q(
    "order_rejects",
    ["raw_orders"],
    """SELECT """
    + ",\n ".join(
        f"COUNT(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS {t}) IS NULL) AS {c}_rejects"
        for c, t in [("order_id", "BIGINT"), ("r_id", "BIGINT"), ("user_id", "BIGINT"), ("order_date", "DATE"), ("sales_amount", "FLOAT")]
    )
    + "\nFROM raw_orders",
)
q(
    "mart_city_restaurant_stats",
    ["stg_restaurants"],
    """SELECT city, COUNT(restaurant_id) AS total_restaurants, ROUND(AVG(rating), 2) AS avg_rating,
 ROUND(AVG(cost_for_two), 2) AS avg_cost_for_two
FROM stg_restaurants WHERE city IS NOT NULL GROUP BY city""",
)
q(
    "mart_city_order_stats",
    ["stg_orders", "stg_restaurants"],
    """SELECT r.city, COUNT(DISTINCT r.restaurant_id) AS restaurant_count, COUNT(o.order_id) AS total_orders,
 SUM(o.order_amount) AS total_revenue
FROM stg_orders o JOIN stg_restaurants r ON o.restaurant_id = r.restaurant_id GROUP BY r.city""",
)

# C
_KPI = """SELECT
 (SELECT COALESCE(SUM(total_revenue), 0) FROM mart_orders {w}) AS total_revenue,
 (SELECT CAST(COALESCE(SUM(total_orders), 0) AS BIGINT) FROM mart_orders {w}) AS total_orders,
 {aov}(SELECT COUNT(*) FROM stg_restaurants {w}) AS total_restaurants,
 (SELECT COALESCE(ROUND(AVG(rating), 2), 0) FROM stg_restaurants {w}) AS avg_rating"""
_AOV = "(SELECT COALESCE(ROUND(SUM(total_revenue) / NULLIF(SUM(total_orders), 0), 2), 0) FROM mart_orders {w}) AS avg_order_value,\n "
_WC = f"WHERE {rc('city')} = {CITY}"
q("kpis", ["mart_orders", "stg_restaurants"], _KPI.format(w="", aov=""))
q("kpis_by_scope", ["mart_orders", "stg_restaurants"], _KPI.format(w="", aov=_AOV.format(w="")))
q("kpis_by_scope_city", ["mart_orders", "stg_restaurants"], _KPI.format(w=_WC, aov=_AOV.format(w=_WC)))
q(
    "top_city_rows",
    ["mart_orders"],
    f"SELECT city, total_revenue FROM (SELECT * FROM mart_orders ORDER BY {BY_REV} LIMIT 10) t",
)
q(
    "top_restaurants",
    ["mart_orders"],
    f"SELECT restaurant_name, total_revenue FROM (SELECT * FROM mart_orders ORDER BY {BY_REV} LIMIT 10) t",
)
q(
    "top_restaurants_city",
    ["mart_orders"],
    f"SELECT restaurant_name, total_revenue FROM (SELECT * FROM mart_orders {_WC} ORDER BY {BY_REV} LIMIT 10) t",
)
_REV_BY_CITY = """SELECT city, SUM(total_revenue) AS rev FROM mart_orders GROUP BY city
ORDER BY rev DESC NULLS LAST, city ASC NULLS LAST LIMIT 10"""
q("revenue_by_city", ["mart_orders"], _REV_BY_CITY)
q(
    "revenue_share_top_cities",
    ["mart_orders"],
    f"SELECT city, rev, ROUND(100.0 * rev / SUM(rev) OVER (), 4) AS share_pct FROM ({_REV_BY_CITY}) t",
)
q(
    "orders_vs_revenue",
    ["mart_orders"],
    f"""SELECT city, total_orders, total_revenue FROM (SELECT * FROM mart_orders WHERE total_revenue > 0
ORDER BY {BY_REV} LIMIT 20) t""",
)
q(
    "restaurant_detail",
    ["mart_orders"],
    f"""SELECT restaurant_name, city, total_orders, ROUND(total_revenue, 2) AS revenue, {aov()} AS avg_order_value
FROM (SELECT * FROM mart_orders ORDER BY {BY_REV} LIMIT 20) t""",
)


def _trend(fmt: str, desc: bool, limit: int | None, city: bool) -> str:
    where_city = f" AND {rc('restaurant_city')} = {CITY}" if city else ""
    order = "period_label DESC" if desc else "period_label ASC"
    lim = f" LIMIT {limit}" if limit else ""
    return f"""SELECT strftime(CAST(order_date AS DATE), '{fmt}') AS period_label, COUNT(*) AS total_orders,
 ROUND(SUM(CAST(sales_amount AS FLOAT)), 2) AS total_revenue, ROUND(AVG(CAST(sales_amount AS FLOAT)), 2) AS avg_order_value
FROM raw_orders WHERE order_date IS NOT NULL AND sales_amount IS NOT NULL{where_city}
GROUP BY strftime(CAST(order_date AS DATE), '{fmt}') ORDER BY {order}{lim}"""


def _summary(inner: str) -> str:
    return f"""SELECT COALESCE(ROUND(SUM(total_revenue), 2), 0) AS total_revenue,
 CAST(COALESCE(SUM(total_orders), 0) AS BIGINT) AS total_orders,
 COALESCE(ROUND(AVG(avg_order_value), 2), 0) AS avg_order_value FROM ({inner}) t"""


q("trend_monthly", ["raw_orders"], _trend("%Y-%m", True, 20, False))
q("trend_yearly", ["raw_orders"], _trend("%Y", True, 20, False))
q("trend_scoped", ["raw_orders"], _trend("%Y-%m", False, None, False))
q("trend_scoped_city", ["raw_orders"], _trend("%Y-%m", False, None, True))
q("trend_scoped_yearly", ["raw_orders"], _trend("%Y", False, None, False))
q("aov_trend", ["raw_orders"], f"SELECT period_label, avg_order_value FROM ({_trend('%Y-%m', False, None, False)}) t")
q(
    "aov_trend_city",
    ["raw_orders"],
    f"SELECT period_label, avg_order_value FROM ({_trend('%Y-%m', False, None, True)}) t",
)
q("trend_summary_monthly", ["raw_orders"], _summary(_trend("%Y-%m", True, 20, False)))
q("trend_summary_yearly", ["raw_orders"], _summary(_trend("%Y", True, 20, False)))
q("trend_summary_scoped_city", ["raw_orders"], _summary(_trend("%Y-%m", False, None, True)))


def _filtered(min_rev: int, sort: str, limit: int) -> str:
    order = {
        "total_revenue": f"total_revenue DESC NULLS LAST, {TIES}",
        "total_orders": f"total_orders DESC NULLS LAST, {TIES}",
        "city": "city DESC NULLS LAST, restaurant_name ASC NULLS LAST",
    }[sort]
    return f"""SELECT restaurant_name, city, total_orders, total_revenue, {aov()} AS avg_order_value
FROM mart_orders WHERE total_revenue >= {min_rev} ORDER BY {order} LIMIT {limit}"""


q("trend_summary_all_time", ["mart_orders"], _summary(_filtered(30000000, "total_revenue", 20)))
q("restaurants_filtered", ["mart_orders"], _filtered(30000000, "total_revenue", 20))
q("restaurants_filtered_by_city", ["mart_orders"], _filtered(30000000, "city", 20))
q("restaurants_filtered_by_orders", ["mart_orders"], _filtered(0, "total_orders", 500))
q(
    "cities_ranked",
    ["mart_orders"],
    f"""SELECT {rc('city')} AS city, SUM(total_revenue) AS revenue, CAST(SUM(total_orders) AS BIGINT) AS orders,
 COUNT(*) AS restaurant_count FROM mart_orders GROUP BY {rc('city')}""",
)
q(
    "breakdown_city",
    ["mart_orders"],
    f"""SELECT {rc('city')} AS label, SUM(total_revenue) AS revenue, CAST(SUM(total_orders) AS BIGINT) AS orders
FROM mart_orders GROUP BY {rc('city')} ORDER BY revenue DESC NULLS LAST, label ASC NULLS LAST LIMIT 15""",
)
q(
    "breakdown_area",
    ["mart_orders"],
    f"""SELECT {area('city')} AS label, SUM(total_revenue) AS revenue, CAST(SUM(total_orders) AS BIGINT) AS orders
FROM mart_orders WHERE {rc('city')} = {CITY} GROUP BY {area('city')}
ORDER BY revenue DESC NULLS LAST, label ASC NULLS LAST LIMIT 20""",
)


def _cuisine(city: bool) -> str:
    where = f"WHERE {rc('o.city')} = {CITY}" if city else ""
    return f"""SELECT cuisine, revenue FROM (
 SELECT COALESCE(NULLIF(trim(r.cuisine), ''), 'Unspecified') AS label, SUM(o.total_revenue) AS revenue
 FROM mart_orders o LEFT JOIN stg_restaurants r ON r.restaurant_name = o.restaurant_name
 {where}
 GROUP BY r.cuisine) t(cuisine, revenue)
ORDER BY revenue DESC NULLS LAST, cuisine ASC NULLS LAST LIMIT 10"""


q("cuisine_revenue", ["mart_orders", "stg_restaurants"], _cuisine(False))
q("cuisine_revenue_city", ["mart_orders", "stg_restaurants"], _cuisine(True))


def _ratings(city: bool) -> str:
    where = f"WHERE {rc('city')} = {CITY} AND rating IS NOT NULL" if city else "WHERE rating IS NOT NULL"
    return f"""SELECT bucket, COUNT(*) AS restaurant_count FROM (
 SELECT CASE WHEN rating < 2 THEN '< 2.0' WHEN rating < 3 THEN '2.0 - 3.0' WHEN rating < 4 THEN '3.0 - 4.0'
             WHEN rating < 4.5 THEN '4.0 - 4.5' ELSE '4.5+' END AS bucket,
        CASE WHEN rating < 2 THEN 0 WHEN rating < 3 THEN 1 WHEN rating < 4 THEN 2 WHEN rating < 4.5 THEN 3 ELSE 4 END AS sort_order
 FROM stg_restaurants {where}) t
GROUP BY bucket, sort_order ORDER BY sort_order"""


q("rating_distribution", ["stg_restaurants"], _ratings(False))
q("rating_distribution_city", ["stg_restaurants"], _ratings(True))


def _perf(where: str, order: str, limit: int, offset: int) -> str:
    return f"""SELECT restaurant_name, city, total_orders, total_revenue, {aov()} AS avg_order_value
FROM mart_orders {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}"""


q("performance_page", ["mart_orders"], _perf("", BY_REV, 3, 3))
q("performance_page_city", ["mart_orders"], _perf(_WC, BY_REV, 100, 0))
q(
    "performance_after",
    ["mart_orders"],
    f"""SELECT restaurant_name, city, total_orders, total_revenue, {aov()} AS avg_order_value FROM mart_orders
WHERE total_revenue IS NULL OR total_revenue < 30000000 OR (total_revenue = 30000000 AND (restaurant_name IS NULL OR restaurant_name > 'Merchant 3'))
ORDER BY {BY_REV} LIMIT 5""",
)
q(
    "performance_page_by_name",
    ["mart_orders"],
    _perf("", "restaurant_name DESC NULLS LAST, city ASC NULLS LAST", 3, 3),
)
q("performance_page_by_orders", ["mart_orders"], _perf("", f"total_orders DESC NULLS LAST, {TIES}", 3, 3))

# D
_REST_ORDER = "rating DESC NULLS LAST, restaurant_name ASC NULLS LAST, city ASC NULLS LAST, restaurant_id ASC NULLS LAST"


def _rest(where: str, limit: int, offset: int) -> str:
    return f"""SELECT restaurant_name, city, rating, cuisine, cost_for_two FROM stg_restaurants {where}
ORDER BY {_REST_ORDER} LIMIT {limit} OFFSET {offset}"""


_SEARCH = "regexp_matches(restaurant_name, 'chant [1-4]', 'i')"
_RATING = "rating >= CAST(4.1 AS FLOAT)"
q("explore_restaurants", ["stg_restaurants"], _rest("", 3, 3))
q("explore_restaurants_search", ["stg_restaurants"], _rest(f"WHERE {_SEARCH}", 100, 0))
q("explore_restaurants_rating", ["stg_restaurants"], _rest(f"WHERE {_RATING}", 100, 0))
q("explore_restaurants_rating0", ["stg_restaurants"], _rest("", 100, 0))
q("explore_restaurants_city", ["stg_restaurants"], _rest(f"WHERE {rc('city')} = {CITY}", 100, 0))
q("explore_restaurants_head", ["stg_restaurants"], _rest(f"WHERE {_SEARCH}", 500, 0))


def _info(inner_from_where: str, size: int, page: int) -> str:
    return f"""SELECT COUNT(*) AS total_count, GREATEST(1, CAST(CEIL(COUNT(*) / {size}) AS BIGINT)) AS total_pages,
 {page} AS page, {size} AS page_size FROM {inner_from_where}"""


q(
    "explore_restaurants_info",
    ["stg_restaurants"],
    _info(f"stg_restaurants WHERE {_SEARCH} AND {_RATING}", 3, 2),
)


def _orders(where: str, limit: int, offset: int) -> str:
    return f"""SELECT restaurant_name, city, total_orders, total_revenue, {aov()} AS avg_order_value
FROM mart_orders WHERE {where} ORDER BY {BY_REV} LIMIT {limit} OFFSET {offset}"""


_MINS0 = "total_orders >= 0 AND total_revenue >= 0"
q("explore_orders", ["mart_orders"], _orders(_MINS0, 3, 3))
q("explore_orders_filtered", ["mart_orders"], _orders("total_orders >= 0 AND total_revenue >= 30000000", 100, 0))
q(
    "explore_orders_search",
    ["mart_orders"],
    _orders(f"{_SEARCH} AND total_orders >= 1 AND total_revenue >= 0", 100, 0),
)
q(
    "explore_orders_cities",
    ["mart_orders"],
    _orders(f"city IN ('ARGENTINA, AMERICA', 'EUROPE', 'FRANCE, EUROPE') AND {_MINS0}", 100, 0),
)
q("explore_orders_city", ["mart_orders"], _orders(f"{rc('city')} = {CITY} AND {_MINS0}", 100, 0))
q(
    "explore_orders_info",
    ["mart_orders"],
    _info("mart_orders WHERE total_orders >= 0 AND total_revenue >= 30000000", 3, 2),
)
_GOLD_REV = "SELECT review_id, original_text AS review, sentiment, topics, summary FROM gold_review_sentiments"
_REV_SEARCH = "regexp_matches(review, 'the', 'i')"
q(
    "explore_reviews",
    ["gold_review_sentiments"],
    f"SELECT * FROM ({_GOLD_REV}) t ORDER BY review_id LIMIT 3 OFFSET 3",
)
q(
    "explore_reviews_search",
    ["gold_review_sentiments"],
    f"SELECT * FROM ({_GOLD_REV}) t WHERE {_REV_SEARCH} ORDER BY review_id LIMIT 100",
)
q(
    "explore_reviews_raw",
    ["raw_reviews"],
    f"""SELECT * FROM (SELECT review_id, comment AS review, rating FROM raw_reviews) t
WHERE {_REV_SEARCH} ORDER BY review_id LIMIT 100""",
)
q(
    "explore_reviews_info",
    ["gold_review_sentiments"],
    _info(f"({_GOLD_REV}) t WHERE {_REV_SEARCH}", 3, 2),
)
q(
    "distinct_cities",
    ["mart_orders"],
    "SELECT DISTINCT city FROM mart_orders WHERE city IS NOT NULL ORDER BY city",
)
q(
    "distinct_real_cities",
    ["mart_orders"],
    f"SELECT DISTINCT {rc('city')} AS city FROM mart_orders WHERE {rc('city')} IS NOT NULL ORDER BY city",
)

# E
q(
    "sentiment_counts",
    ["gold_review_sentiments"],
    'SELECT sentiment, COUNT(*) AS "count" FROM gold_review_sentiments GROUP BY sentiment',
)
q(
    "sentiment_summary",
    ["gold_review_sentiments"],
    """SELECT true AS enriched, COUNT(*) FILTER (WHERE sentiment = 'Positive') AS positive,
 COUNT(*) FILTER (WHERE sentiment = 'Negative') AS negative, COUNT(*) FILTER (WHERE sentiment = 'Neutral') AS neutral,
 CAST(NULL AS BIGINT) AS raw_count FROM gold_review_sentiments""",
)
q(
    "sentiment_summary_raw",
    ["raw_reviews"],
    """SELECT false AS enriched, CAST(0 AS BIGINT) AS positive, CAST(0 AS BIGINT) AS negative,
 CAST(0 AS BIGINT) AS neutral, COUNT(*) AS raw_count FROM raw_reviews""",
)
q(
    "reviews_fallback",
    ["raw_reviews"],
    "SELECT review_id, comment, rating FROM raw_reviews",
)
q(
    "sample_reviews",
    ["gold_review_sentiments"],
    "SELECT original_text, sentiment, summary FROM gold_review_sentiments ORDER BY review_id LIMIT 10",
)
_TOPICS = f"""SELECT topic, COUNT(*) AS "count" FROM (
 SELECT {strip('t')} AS topic FROM (SELECT unnest(string_split(topics, ',')) AS t FROM gold_review_sentiments) u) v
WHERE topic != '' GROUP BY topic"""
q("topic_counts", ["gold_review_sentiments"], _TOPICS)
q(
    "top_topics",
    ["gold_review_sentiments"],
    f'SELECT * FROM ({_TOPICS}) w ORDER BY "count" DESC, topic ASC LIMIT 15',
)
q("enrich_candidates", ["candidates"], "SELECT review_id, text FROM candidates")
q(
    "enrich_candidates_resume",
    ["candidates", "first_batch_done"],
    "SELECT review_id, text FROM candidates WHERE review_id NOT IN (SELECT review_id FROM first_batch_done)",
)
q(
    "enrich_candidates_batch",
    ["candidates"],
    "SELECT review_id, text FROM candidates ORDER BY review_id LIMIT 100",
)
q("parse_review_reply", ["review_parsed"], "SELECT * FROM review_parsed")
q("enrich_reviews", ["enriched"], "SELECT * FROM enriched")
_GOOD = "('good', 'great', 'tasty', 'fresh', 'friendly', 'fast', 'excellent', 'love', 'polite', 'best')"
_BAD = "('bad', 'cold', 'late', 'rude', 'stale', 'slow', 'worst', 'disgusting', 'worthless', 'pathetic')"
_TOPIC = {
    "Delivery": "['delivery', 'late', 'fast', 'slow', 'rider']",
    "Food Quality": "['cold', 'stale', 'fresh', 'tasty', 'taste', 'disgusting']",
    "Service": "['rude', 'friendly', 'polite', 'staff', 'service']",
    "Price": "['price', 'expensive', 'cheap', 'worthless']",
}
q(
    "enrich_reviews_rules",
    ["candidates"],
    f"""SELECT review_id, text AS original_text, true AS ok,
 CASE WHEN good > bad THEN 'Positive' WHEN bad > good THEN 'Negative' ELSE 'Neutral' END AS sentiment,
 CASE WHEN topics = '' THEN 'General' ELSE topics END AS topics,
 CAST(good AS VARCHAR) || ' good and ' || CAST(bad AS VARCHAR) || ' bad words' AS summary
FROM (SELECT *, len(list_filter(w, lambda x: x IN {_GOOD})) AS good, len(list_filter(w, lambda x: x IN {_BAD})) AS bad,
        concat_ws(', ', {', '.join(f"CASE WHEN list_has_any(w, {v}) THEN '{k}' END" for k, v in _TOPIC.items())}) AS topics
      FROM (SELECT *, string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+') AS w FROM candidates) a) b""",
)


def _buckets(source: str, keep: str, text: str) -> str:
    """``keep`` and the hashed features ``b`` of ``text``."""
    words = f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    marks = {
        "distinct": "len(list_distinct(w)) * 20 // greatest(len(w), 1)",
        "marks": "length(regexp_replace(t, '[\\p{L} \\t\\n\\r]', '', 'g')) * 40 // greatest(length(t), 1)",
        "capitals": "length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) * 40 // greatest(length(t), 1)",
        "lines": "len(list_distinct(string_split(t, chr(10)))) * 10 // len(string_split(t, chr(10)))",
        "letters": "length(array_to_string(w, '')) * 2 // greatest(len(w), 1)",
    }
    shape = ", ".join(f"'#{name}:' || CAST({e} AS VARCHAR)" for name, e in marks.items())
    return f"""SELECT {keep}, list_distinct(list_transform(list_concat(w, [{shape}]), lambda x: CAST('0x' || md5(x)[1:4] AS INTEGER))) AS b
FROM (SELECT *, {text} AS t, {words} AS w FROM {source}) p"""


cte(
    "learn_rows",
    ["raw_reviews"],
    _buckets(
        "(SELECT *, CASE WHEN rating <= 2 THEN 0 WHEN rating >= 4 THEN 2 ELSE 1 END AS label,"
        " CAST('0x' || md5(comment)[1] AS INTEGER) AS fold FROM raw_reviews WHERE rating IS NOT NULL AND comment IS NOT NULL) r",
        "label, fold, row_number() OVER () AS id",
        "comment",
    ),
)
cte(
    "learn_docs",
    ["learn_rows"],
    """SELECT c.label, COUNT(r.label) AS d, SUM(COUNT(r.label)) OVER () AS total FROM (VALUES (0), (1), (2)) c(label)
LEFT JOIN (SELECT label FROM learn_rows WHERE fold < 12) r ON r.label = c.label GROUP BY c.label""",
)
cte(
    "learn_weights",
    ["learn_rows", "learn_docs"],
    """SELECT bucket, label, CAST(round(1000 * odds) AS BIGINT) AS weight FROM (
 SELECT bucket, label, n_all, ln((n + 0.5) / (d + 1.0)) - ln((n_all - n + 0.5) / (total - d + 1.0)) AS odds,
  sqrt(1.0 / (n + 0.5) + 1.0 / (n_all - n + 0.5)) AS error
 FROM (SELECT a.bucket, o.label, o.d, o.total, a.n_all, CAST(coalesce(h.n, 0) AS DOUBLE) AS n
  FROM (SELECT bucket, CAST(COUNT(*) AS DOUBLE) AS n_all FROM (SELECT unnest(b) AS bucket FROM learn_rows WHERE fold < 12) GROUP BY bucket) a
  CROSS JOIN learn_docs o
  LEFT JOIN (SELECT label, bucket, COUNT(*) AS n FROM (SELECT label, unnest(b) AS bucket FROM learn_rows WHERE fold < 12) GROUP BY ALL) h
   ON h.bucket = a.bucket AND h.label = o.label) x) y
WHERE n_all >= 5 AND abs(odds) > 6 * error""",
)


def _judged(source: str, key: str) -> str:
    """``key, mood, bin`` of the rows ``key, b``."""
    return f"""SELECT {key}, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS mood,
 CASE WHEN lead < 250 THEN 0 ELSE length(bin(lead // 250)) END AS bin
FROM (SELECT *, greatest(s0, s1, s2) - CASE WHEN s0 >= s1 AND s0 >= s2 THEN greatest(s1, s2) WHEN s1 >= s2 THEN greatest(s0, s2) ELSE greatest(s0, s1) END AS lead
 FROM (SELECT {key}, {", ".join(f"CAST(coalesce(SUM(weight) FILTER (label = {c}), 0) AS BIGINT) + (SELECT CAST(round(1000 * ln((d + 1.0) / (total - d + 1.0))) AS BIGINT) FROM learn_docs WHERE label = {c}) AS s{c}" for c in range(3))}
  FROM (SELECT {key}, unnest(CASE WHEN len(b) = 0 THEN [-1] ELSE b END) AS bucket FROM {source}) e
  LEFT JOIN learn_weights USING (bucket) GROUP BY {key}) g) h"""


cte("learn_judged", ["learn_rows", "learn_docs", "learn_weights"], _judged("learn_rows", "id"))
cte(
    "learn_bins",
    ["learn_rows", "learn_judged"],
    """SELECT bin, greatest(333, MAX(1000 * (good + 1) // (n + 2)) OVER (ORDER BY bin)) AS confidence
FROM (SELECT bin, COUNT(*) AS n, COUNT(*) FILTER (label = mood) AS good FROM learn_rows JOIN learn_judged USING (id)
 WHERE fold IN (12, 13) GROUP BY bin) x""",
)
cte("cand_buckets", ["candidates"], _buckets("(SELECT *, row_number() OVER () AS id FROM candidates) c", "id, review_id, text, w", "text"))
cte("cand_judged", ["cand_buckets", "learn_docs", "learn_weights"], _judged("cand_buckets", "id"))
_MOOD = "['Negative', 'Neutral', 'Positive']"
q(
    "enrich_reviews_learned",
    ["cand_buckets", "cand_judged", "learn_bins"],
    f"""SELECT review_id, text AS original_text, true AS ok, {_MOOD}[mood + 1] AS sentiment,
 CASE WHEN topics = '' THEN 'General' ELSE topics END AS topics,
 'confidence ' || CAST(coalesce((SELECT MAX(l.confidence) FROM learn_bins l WHERE l.bin <= j.bin), 333) AS VARCHAR) || '/1000' AS summary
FROM (SELECT *, concat_ws(', ', {", ".join(f"CASE WHEN list_has_any(w, {v}) THEN '{k}' END" for k, v in _TOPIC.items())}) AS topics FROM cand_buckets) c
JOIN cand_judged j USING (id)""",
)
q(
    "learned_held_out",
    ["learn_rows", "learn_judged"],
    f"""SELECT {_MOOD}[label + 1] AS rated, {_MOOD}[mood + 1] AS found, COUNT(*) AS count
FROM learn_rows JOIN learn_judged USING (id) WHERE fold >= 14 GROUP BY ALL""",
)
q(
    "enrich_report",
    ["enriched"],
    "SELECT COUNT(*) FILTER (WHERE ok) AS enriched, COUNT(*) FILTER (WHERE NOT ok) AS failed FROM enriched",
)
q(
    "review_volume",
    ["volume_all"],
    "SELECT * FROM volume_all ORDER BY review_count DESC, restaurant_id ASC LIMIT 50",
)
q("review_volume_all", ["volume_all"], "SELECT * FROM volume_all")
q(
    "pending_restaurants",
    ["volume_all", "insight_first_run"],
    """SELECT * FROM volume_all WHERE CAST(restaurant_id AS VARCHAR) NOT IN
 (SELECT restaurant_id FROM insight_first_run WHERE ok)""",
)
q("review_sample", ["sample30"], "SELECT * FROM sample30")
q("review_bundle", ["bundles"], "SELECT * FROM bundles")
q(
    "parse_insight_reply",
    ["insight_parsed"],
    "SELECT * REPLACE (" + ", ".join(f"array_to_string({k}, ', ') AS {k}" for k in _THEMES) + ") FROM insight_parsed",
)
q("insights_build", ["insight_build"], "SELECT * FROM insight_build")
q(
    "insights_report",
    ["insight_build"],
    "SELECT COUNT(*) FILTER (WHERE ok) AS analyzed, COUNT(*) FILTER (WHERE NOT ok) AS failed FROM insight_build",
)
_INS_LIST = """SELECT restaurant_id, restaurant_name, city, review_count, positive_count, negative_count, neutral_count
FROM gold_restaurant_insights"""
_INS_ORDER = "review_count DESC NULLS LAST, restaurant_name ASC NULLS LAST, restaurant_id ASC NULLS LAST"
q("insights_list", ["gold_restaurant_insights"], f"{_INS_LIST} ORDER BY {_INS_ORDER} LIMIT 20")
q(
    "insights_list_search",
    ["gold_restaurant_insights"],
    f"{_INS_LIST} WHERE {_SEARCH} ORDER BY {_INS_ORDER} LIMIT 100",
)
q("insights_list_info", ["gold_restaurant_insights"], _info("gold_restaurant_insights", 20, 1))


def _split_themes(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, ','), lambda x: {strip('x')}), lambda x: x != '')"


q(
    "insight_detail",
    ["gold_restaurant_insights"],
    f"""SELECT restaurant_id, restaurant_name, city, review_count, positive_count, negative_count, neutral_count,
 {_split_themes('top_negative_themes')} AS negative_themes, {_split_themes('top_positive_themes')} AS positive_themes,
 summary FROM gold_restaurant_insights WHERE restaurant_id = '8'""",
)

# G
q(
    "guarded_sql",
    ["mart_orders"],
    """SELECT city, ROUND(SUM(total_revenue), 2) AS revenue, CAST(SUM(total_orders) AS BIGINT) AS orders
FROM mart_orders GROUP BY city""",
)
q(
    "ask_city_totals",
    ["mart_orders"],
    f"""SELECT COALESCE(SUM(total_revenue), 0) AS total_revenue, CAST(COALESCE(SUM(total_orders), 0) AS BIGINT) AS total_orders
FROM mart_orders {_WC}""",
)
q(
    "ask_negative_topic",
    ["gold_review_sentiments"],
    "SELECT COUNT(*) AS review_count FROM gold_review_sentiments WHERE sentiment = 'Negative' AND topics ILIKE '%delivery%'",
)
q(
    "ask_top_rated_cities",
    ["stg_restaurants"],
    f"""SELECT {rc('city')} AS city, ROUND(AVG(rating), 2) AS avg_rating FROM stg_restaurants
WHERE {rc('city')} IS NOT NULL GROUP BY {rc('city')} ORDER BY avg_rating DESC NULLS LAST, city ASC NULLS LAST LIMIT 3""",
)
q(
    "ask_top_cities",
    ["mart_orders"],
    f"""SELECT {rc('city')} AS city, SUM(total_revenue) AS revenue, CAST(SUM(total_orders) AS BIGINT) AS orders,
 COUNT(*) AS restaurant_count FROM mart_orders GROUP BY {rc('city')}
ORDER BY revenue DESC NULLS LAST, city ASC NULLS LAST LIMIT 5""",
)
q("ask_restaurant_count", ["stg_restaurants"], "SELECT COUNT(*) AS total_restaurants FROM stg_restaurants")
q(
    "ask_avg_order_value",
    ["mart_orders"],
    "SELECT ROUND(SUM(total_revenue) / NULLIF(SUM(total_orders), 0), 2) AS avg_order_value FROM mart_orders",
)


q(
    "export_json_parsed",
    ["mart_orders"],
    f"""SELECT {rc('city')} AS city, SUM(total_revenue) AS revenue, CAST(SUM(total_orders) AS BIGINT) AS orders,
 COUNT(*) AS restaurant_count FROM mart_orders GROUP BY {rc('city')}""",
)
q("ingest_csv_lines", ["raw_restaurants"], "SELECT * REPLACE (NULLIF(cuisine, '') AS cuisine) FROM raw_restaurants")
q(
    "append_new_rows",
    ["raw_reviews"],
    """SELECT DISTINCT CAST(FLOOR(review_id / 2) AS BIGINT) AS review_id FROM raw_reviews
WHERE CAST(FLOOR(review_id / 2) AS BIGINT) NOT IN (SELECT review_id FROM raw_reviews WHERE review_id % 3 = 0)""",
)
q(
    "source_choice",
    [],
    """SELECT 'labels' AS wanted, 'enriched' AS source, COUNT(*) AS row_count FROM labels
UNION ALL SELECT 'gold_review_sentiments', 'raw', COUNT(*) FROM documents""",
)


cte(
    "bad_restaurants",
    ["raw_restaurants"],
    """SELECT * REPLACE (CASE WHEN CAST(id AS BIGINT) % 10 = 1 THEN 'x' || id ELSE id END AS id,
 CASE WHEN CAST(id AS BIGINT) % 10 = 2 THEN 'new' ELSE rating END AS rating,
 CASE WHEN CAST(id AS BIGINT) % 10 = 3 THEN '₹ many' ELSE cost END AS cost) FROM raw_restaurants""",
)
q(
    "restaurant_rejects_lenient",
    ["bad_restaurants"],
    """SELECT COUNT(*) FILTER (WHERE id IS NOT NULL AND TRY_CAST(id AS BIGINT) IS NULL) AS id_rejects,
 COUNT(*) FILTER (WHERE rating IS NOT NULL AND rating != '--' AND TRY_CAST(rating AS FLOAT) IS NULL) AS rating_rejects,
 COUNT(*) FILTER (WHERE cost IS NOT NULL AND TRY_CAST(REPLACE(cost, '₹ ', '') AS INTEGER) IS NULL) AS cost_rejects FROM bad_restaurants""",
)
q(
    "stg_restaurants_lenient",
    ["bad_restaurants"],
    """SELECT TRY_CAST(id AS BIGINT) AS restaurant_id, name AS restaurant_name, city, TRY_CAST(rating AS FLOAT) AS rating,
 TRY_CAST(REPLACE(cost, '₹ ', '') AS INTEGER) AS cost_for_two, cuisine FROM bad_restaurants""",
)
q(
    "order_rejects_lenient",
    ["raw_orders"],
    """SELECT COUNT(*) FILTER (WHERE k % 100 = 11) AS order_id_rejects, CAST(0 AS BIGINT) AS r_id_rejects,
 COUNT(*) FILTER (WHERE k % 100 = 12) AS order_date_rejects, COUNT(*) FILTER (WHERE k % 100 = 13) AS sales_amount_rejects
FROM (SELECT CAST(order_id AS BIGINT) AS k FROM raw_orders) t""",
)


cte(
    "theme_counts",
    ["raw_reviews", "stg_restaurants"],
    f"""SELECT rid, place, theme, CAST(COUNT(*) AS DOUBLE) AS n FROM (
 SELECT rid, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS theme FROM (
  SELECT restaurant_id AS rid, list_filter(string_split_regex(lower(comment), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
  FROM raw_reviews WHERE comment IS NOT NULL AND {strip('comment')} <> '') a) b
JOIN (SELECT DISTINCT CAST(restaurant_id AS VARCHAR) AS rid, coalesce(city, '') AS place FROM stg_restaurants) p USING (rid)
GROUP BY ALL""",
)
cte(
    "theme_scores",
    ["theme_counts"],
    """SELECT rid, theme, n, n_place, round((ln(mine / (all_rid + 500.0 - mine)) - ln(theirs / (all_place - all_rid + 500.0 - theirs))) / sqrt(1.0 / mine + 1.0 / theirs), 6) AS score
FROM (SELECT *, n + 500.0 * n_all / total AS mine, n_place - n + 500.0 * n_all / total AS theirs FROM (
 SELECT *, SUM(n) OVER (PARTITION BY place, theme) AS n_place, SUM(n) OVER (PARTITION BY theme) AS n_all,
  SUM(n) OVER (PARTITION BY rid, place) AS all_rid, SUM(n) OVER (PARTITION BY place) AS all_place, SUM(n) OVER () AS total FROM theme_counts) x
 WHERE n >= 3) y""",
)
q(
    "restaurant_themes",
    ["theme_scores"],
    """SELECT rid AS restaurant_id, rank, theme, CAST(n AS BIGINT) AS reviews, CAST(n_place AS BIGINT) AS city_reviews, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, theme) AS rank FROM theme_scores WHERE score > 0) z WHERE rank <= 5""",
)
_PAGES = "SELECT CAST((n - 1) // 7 + 1 AS INT) AS page, n AS row_number, t.* EXCLUDE (n) FROM ({t}) t WHERE (n - 1) // 7 + 1 IN (1, 3, 20, 1000)"
q(
    "order_pages_index",
    ["stg_orders"],
    _PAGES.format(
        t="""SELECT order_id, restaurant_id, order_date, order_amount, row_number() OVER
 (ORDER BY order_amount DESC NULLS LAST, order_date ASC NULLS LAST, restaurant_id ASC NULLS LAST, order_id ASC NULLS LAST) AS n FROM stg_orders"""
    ),
)
q(
    "explore_orders_pages_index",
    ["mart_orders"],
    _PAGES.format(
        t=f"""SELECT restaurant_name, city, total_orders, total_revenue, {aov()} AS avg_order_value, row_number() OVER (ORDER BY {BY_REV}) AS n
 FROM mart_orders WHERE {_MINS0}"""
    ),
)
q("explore_orders_pages_index_info", ["mart_orders"], _info(f"mart_orders WHERE {_MINS0}", 3, 2))
q(
    "city_month_users_sketched",
    ["stg_orders", "stg_restaurants"],
    f"""SELECT {rc("city")} AS city, CAST(date_trunc('month', order_date) AS DATE) AS month, COUNT(user_id) AS orders,
 COUNT(DISTINCT user_id) AS users, TRUE AS estimate_holds
FROM stg_orders o JOIN stg_restaurants r ON o.restaurant_id = r.restaurant_id GROUP BY 1, 2""",
)
for _key in ("mart_orders", "mart_city_order_stats"):
    ORACLE[f"{_key}_incremental"] = ORACLE[_key]
q(
    "append_new_rows_nulls",
    ["raw_reviews"],
    """SELECT DISTINCT CASE WHEN review_id % 5 <> 0 THEN review_id // 2 END AS review_id FROM raw_reviews
EXCEPT SELECT NULLIF(review_id, 0) FROM raw_reviews WHERE review_id % 3 = 0""",
)
q(
    "append_ledger",
    ["raw_reviews"],
    """SELECT review_id, MIN(batch_id) AS batch_id FROM
 (SELECT CASE WHEN review_id % 7 <> 3 THEN review_id // 2 END AS review_id, review_id % 3 AS batch_id FROM raw_reviews) r GROUP BY review_id""",
)
q(
    "ingest_quarantine",
    ["raw_restaurants"],
    """SELECT CAST(id AS BIGINT) AS id, name, city, rating, cost, NULLIF(cuisine, '') AS cuisine FROM raw_restaurants
WHERE CAST(id AS BIGINT) % 10 NOT IN (1, 2, 3)""",
)
q(
    "ingest_rejects",
    ["raw_restaurants"],
    """SELECT folder, record, reason FROM (
 SELECT k % 10 AS kind, CAST(k % 2 AS INTEGER) AS folder, row_number() OVER (PARTITION BY k % 2 ORDER BY k) AS record,
  CASE WHEN k % 10 = 1 THEN 'bad value: id' ELSE 'wrong number of fields' END AS reason
 FROM (SELECT CAST(id AS BIGINT) AS k FROM raw_restaurants) a) b WHERE kind IN (1, 2, 3)""",
)
for _key in ("explore_reviews_search", "explore_restaurants_search", "explore_orders_search"):
    ORACLE[f"{_key}_index"] = ORACLE[_key]
q(
    "review_matches_index",
    ["candidates"],
    " UNION ALL ".join(
        f"SELECT '{p}' AS pattern, review_id FROM candidates WHERE regexp_matches(text, '{p}', 'i')"
        for p in ("thorr[a-z]+nd", "ünge(n|r)? |AN[DT] T?HE[ .]", "a[qx]u")
    ),
)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
