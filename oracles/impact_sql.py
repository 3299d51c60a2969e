"""SQL for the impact checks: the original form of each statement, not the rewritten one."""

_O = "o AS (SELECT * REPLACE (CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS o_custkey) FROM orders)"
_C = "c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS c_custkey FROM customer)"


def _bytes(table: str, text: str, fixed: str) -> str:
    rows = [f"SELECT '{table}' AS table_name, '{c}' AS column_name, sum(octet_length(encode({c})))::BIGINT AS bytes FROM {table}" for c in text.split()]
    rows += [f"SELECT '{table}', '{c}', count({c}) * {w} FROM {table}" for c, w in (x.split(":") for x in fixed.split())]
    return " UNION ALL ".join(rows)


def _distinct(keys: str) -> str:
    return f"SELECT '{keys}' AS keys, count(*) AS rows, count(DISTINCT ({keys})) AS distinct_rows FROM lineitem"


def _forms(source: str, **forms: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS form, count(*) FILTER ({c}) AS rows FROM {source}" for f, c in forms.items()
    )


def _layout(column: str) -> str:
    return f"""SELECT '{column}' AS column_name, count(*) AS rows, count(DISTINCT {column}) AS distinct_values,
      count(*) - count({column}) AS null_rows,
      (SELECT max(n) FROM (SELECT count(*) AS n FROM o WHERE {column} IS NOT NULL GROUP BY {column})) AS top_rows,
      min({column})::VARCHAR AS min_value, max({column})::VARCHAR AS max_value FROM o"""


def _cast(name: str, expr: str) -> str:
    return f"SELECT '{name}' AS column_name, count({expr}) AS n_values, count(try_cast({expr} AS INTEGER)) AS castable FROM events"


def _zones(column: str, low: str, high: str) -> str:
    return f"""SELECT '{column}' AS column_name, count(*) AS blocks, count(*) FILTER (most < {low} OR least >= {high}) AS skipped_blocks,
      coalesce(sum(n) FILTER (most < {low} OR least >= {high}), 0)::BIGINT AS skipped_rows
      FROM (SELECT min({column}) AS least, max({column}) AS most, count(*) AS n
            FROM (SELECT {column}, (row_number() OVER () - 1) // 100 AS block FROM orders) GROUP BY block)"""


_K = "regexp_extract(props, '[0-9]+')"


def impact_oracles() -> dict[str, str]:
    return {
        "impact_column_bytes": _bytes("orders", "o_orderstatus o_orderpriority", "o_orderkey:8 o_custkey:8 o_totalprice:8 o_orderdate:8")
        + " UNION ALL " + _bytes("lineitem", "l_returnflag l_linestatus", "l_orderkey:8 l_partkey:8 l_suppkey:8 l_linenumber:4 l_quantity:8 l_extendedprice:8 l_discount:8 l_tax:8 l_shipdate:8"),
        "impact_or_split": f"""WITH {_O} SELECT 'either' AS form, count(*) AS rows FROM o WHERE o_orderstatus = 'F' OR o_custkey < 500
          UNION ALL SELECT 'overlap', count(*) FROM o WHERE o_orderstatus = 'F' AND o_custkey < 500
          UNION ALL SELECT 'union_all', count(*) FROM o WHERE o_orderstatus = 'F' OR o_custkey < 500""",
        "impact_like_forms": """SELECT p_brand, count(*) FILTER (p_name LIKE 'ring%') AS prefix, count(*) FILTER (p_name LIKE '%ring') AS suffix,
          count(*) FILTER (p_name LIKE '%ring%') AS contains FROM part GROUP BY p_brand""",
        "impact_distinct": " UNION ALL ".join(_distinct(k) for k in ("l_orderkey,l_linenumber", "l_orderkey", "l_returnflag,l_linestatus")),
        "impact_not_in": f"""WITH {_O}, {_C} SELECT 'not_in' AS form, count(*) AS rows FROM c WHERE c_custkey NOT IN (SELECT o_custkey FROM o)
          UNION ALL SELECT 'not_exists', count(*) FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey = c.c_custkey)
          UNION ALL SELECT 'left_nulls', count(*) FROM c WHERE c_custkey IS NULL
          UNION ALL SELECT 'right_nulls', count(*) FROM o WHERE o_custkey IS NULL""",
        "impact_not_in_rows": f"""WITH {_C} SELECT id FROM c WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 <> 0)""",
        "impact_scalar_subquery": """SELECT o_orderkey, o_custkey,
          (SELECT max(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey) AS max_price,
          (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) AS last_ship FROM orders""",
        "impact_union": """SELECT a AS union_all, u AS union_rows, a - u AS removed FROM
          (SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)) AS a,
                  (SELECT count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)) AS u)""",
        "impact_sargable_year": _forms("orders", function="year(o_orderdate) = 1996", range="o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01'"),
        "impact_sargable_math": _forms("part", column="p_size + 10 > 20", literal="p_size > 10"),
        "impact_having": "SELECT max(o_totalprice) AS top, count(*) AS n FROM orders HAVING count(*) > 5",
        "impact_self_comparison": f"WITH {_O} " + _forms("o", all_rows="true", self_equal="o_custkey = o_custkey", not_null="o_custkey IS NOT NULL", lost="o_custkey IS NULL"),
        "impact_join_fanout": """SELECT key, left_rows, right_rows, left_rows * right_rows AS pairs
          FROM (SELECT user_id AS key, count(*) AS left_rows FROM events GROUP BY 1)
          JOIN (SELECT o_custkey AS key, count(*) AS right_rows FROM orders GROUP BY 1) USING (key) ORDER BY pairs DESC, key LIMIT 10""",
        "impact_join_totals": """SELECT 'joined' AS form, count(*) AS rows FROM events JOIN orders ON user_id = o_custkey
          UNION ALL SELECT 'cartesian', (SELECT count(*) FROM events) * (SELECT count(*) FROM orders)""",
        "impact_ordinal_sort": """SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INT AS rank
          FROM (SELECT c_name, c_acctbal, c_custkey FROM customer ORDER BY 2 DESC, 3 LIMIT 20)""",
        "impact_comma_join": """SELECT n_name, comma_rows, join_rows FROM
          (SELECT n_name, count(*) AS comma_rows FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY n_name)
          FULL JOIN (SELECT n_name, count(*) AS join_rows FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) USING (n_name)""",
        "impact_schema_diff": """WITH e(column_name, expected) AS (VALUES ('orderkey', 'numeric'), ('custkey', 'numeric'), ('orderstatus', 'string'),
            ('totalprice', 'numeric'), ('orderdate', 'other'), ('orderpriority', 'string')),
          a(column_name, actual) AS (VALUES ('orderkey', 'numeric'), ('partkey', 'numeric'), ('suppkey', 'numeric'), ('linenumber', 'numeric'),
            ('quantity', 'numeric'), ('extendedprice', 'numeric'), ('discount', 'numeric'), ('tax', 'numeric'), ('returnflag', 'string'),
            ('linestatus', 'string'), ('shipdate', 'other'))
          SELECT column_name, expected, actual, CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra'
            WHEN expected <> actual THEN 'type' ELSE 'same' END AS status FROM e FULL JOIN a USING (column_name)""",
        "impact_cast_share": " UNION ALL ".join([_cast("props", "props"), _cast("k", _K), _cast("event_type", "event_type"),
            _cast("k_below_50", f"CASE WHEN {_K}::INT < 50 THEN {_K} ELSE 'many' END")]),
        "impact_column_layout": f"WITH {_O} SELECT *, CASE WHEN distinct_values <= 50 THEN 'partition' WHEN top_rows * 2 > rows THEN 'none' ELSE 'bucket' END AS advice FROM ("
        + " UNION ALL ".join(_layout(c) for c in ("o_custkey", "o_orderstatus", "o_orderpriority")) + ")",
        "impact_null_comparison": f"WITH {_O} " + _forms("o", equals_null="o_custkey = NULL", not_equals_null="o_custkey <> NULL", is_null="o_custkey IS NULL"),
        "impact_guarded_rows": f"WITH {_O} " + _forms("o", touched="true", meant="o_custkey < 100", protected="coalesce(NOT o_custkey < 100, true)"),
        "impact_page": "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS all_rows FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20",
        "impact_page_deep": f"""WITH {_O} SELECT o_orderkey, o_custkey, o_orderstatus, (SELECT count(*) FROM o) AS all_rows FROM o
          ORDER BY o_orderstatus DESC NULLS LAST, o_custkey NULLS FIRST, o_orderkey DESC LIMIT 10 OFFSET 10000""",
        "impact_zone_skip": _zones("o_orderkey", "500", "700") + " UNION ALL " + _zones("o_orderdate", "TIMESTAMP '1996-01-01'", "TIMESTAMP '1997-01-01'"),
    }
