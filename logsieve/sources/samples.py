"""A query log derived from an events table: each event becomes one logged statement.

``{u}`` is the user, ``{e}`` the event id; texts with ``{e}`` are unique, the others repeat, as
in real logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Statement templates; event_id modulo their number picks one.
TEMPLATES = [
    "SELECT * FROM orders",
    "SELECT COUNT(*) FROM orders",
    "DELETE FROM orders",
    "UPDATE orders SET o_orderstatus = 'F'",
    "DELETE FROM orders WHERE o_custkey = {u}",
    "SELECT o_orderkey FROM orders WHERE o_custkey = {u} OR o_orderstatus = 'F' OR o_orderstatus = 'P' LIMIT 5",
    "select o_orderkey FROM orders LIMIT 5",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'on hold' LIMIT 5",
    "SELECT p_partkey FROM part WHERE p_name LIKE '%ring' LIMIT 5",
    "SELECT p_partkey FROM part WHERE p_name LIKE 'red%' LIMIT 5",
    "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%ring' LIMIT 5",
    "SELECT DISTINCT c_mktsegment FROM customer LIMIT 5",
    "SELECT COUNT(DISTINCT c_mktsegment) FROM customer",
    "DROP TABLE part",
    "TRUNCATE TABLE part",
    "DROP VIEW v",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) LIMIT 5",
    "SELECT c_custkey FROM customer c JOIN orders ON c.c_custkey = orders.o_custkey LIMIT 5",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders) LIMIT 5",
    "SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier",
    "SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "SELECT o_orderkey FROM orders WHERE YEAR(o_orderdate) = 1996 LIMIT 5",
    "SELECT p_partkey FROM part WHERE p_size + 10 > 20 LIMIT 5",
    "SELECT p_size + 10 FROM part WHERE p_size > 10 LIMIT 5",
    "SELECT DISTINCT c_mktsegment FROM customer GROUP BY c_mktsegment LIMIT 5",
    "SELECT MAX(o_totalprice) FROM orders HAVING COUNT(*) > 5",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = o_orderstatus LIMIT 5",
    "SELECT c.c_name FROM customer c JOIN nation n ON 1=1 LIMIT 5",
    "SELECT c.c_name FROM customer c CROSS JOIN nation n LIMIT 5",
    "SELECT c_name, c_acctbal FROM customer ORDER BY 2 LIMIT 5",
    "SELECT c.c_name FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey LIMIT 5",
    "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders) LIMIT 5",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = NULL AND o_custkey != NULL LIMIT 5",
    "SELECT c.c_name, (SELECT n.n_name FROM nation n WHERE n.n_nationkey = c.c_nationkey) FROM customer c LIMIT 5",
    "SELECT o_orderkey FROM orders WHERE ((o_custkey = {u})) LIMIT 5",
    "SELECT o_orderkey FROM orders WHERE o_custkey = {u} LIMIT 10",
    "SELECT d.k FROM (SELECT DISTINCT o_custkey AS k FROM orders) d LIMIT 5",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT * FROM orders) LIMIT 5",
    "WITH t AS (SELECT * FROM orders) SELECT o_orderkey FROM t LIMIT 5",
    "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(o_orderkey) > 5 LIMIT 5",
    "SELECT c_custkey FROM customer c LIMIT 5",
    "SELECT c.c_custkey FROM customer c JOIN nation n ON (1=1) LIMIT 5",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus ILIKE '%f' LIMIT 5",
    "SELECT x FROM no_such_table LIMIT 5",
    "SELECT no_such_col FROM orders LIMIT 5",
    "SELECT z.o_orderkey FROM orders LIMIT 5",
    "SELECT c_nationkey FROM customer JOIN customer b ON customer.c_custkey = b.c_custkey LIMIT 5",
    "SELECT o_orderkey FROM orders WHERE o_orderkey = 'ACTIVE' LIMIT 5",
    "SELECT c_custkey FROM customer WHERE c_name = 5 LIMIT 5",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' LIMIT 5",
    "THIS IS NOT SQL !!!",
    "SELECT o_orderkey FROM orders; DELETE FROM part",
    "INSERT INTO part SELECT * FROM part",
    "SELECT c.c_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_name IS DISTINCT FROM 'x' LIMIT 5",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = {e} LIMIT 1",
    "SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey > {e}) ORDER BY o.o_orderkey LIMIT 5",
    "-- event {e}, isn't it\nSELECT o.o_orderstatus AS st,\n       SUM(l.l_extendedprice * (1 - l.l_discount)) AS revenue /* net */\nFROM orders o\nLEFT OUTER JOIN lineitem l ON l.l_orderkey = o.o_orderkey\nWHERE o.o_orderdate BETWEEN '1996-01-01' AND '1996-12-31'\n  AND o.o_orderkey <> {e}\nGROUP BY o.o_orderstatus\nHAVING SUM(l.l_quantity) > 10\nORDER BY revenue DESC\nLIMIT 100;",
    "SELECT event_type, COUNT(*) AS n FROM events WHERE user_id = {u} AND event_id >= {e} GROUP BY event_type ORDER BY 1, 2 DESC",
    "INSERT INTO orders (o_orderkey, o_orderstatus) VALUES ({e}, 'it''s; (new')",
    "UPDATE part SET p_name = NULL WHERE p_partkey = {e}; SELECT COUNT(*) FROM part WHERE p_partkey = {e}",
    "(SELECT c_custkey FROM customer WHERE c_custkey = {u} LIMIT 3) UNION ALL (SELECT o_custkey FROM orders ORDER BY 1)",
    "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey), best AS (SELECT o_custkey FROM big WHERE total > {e}) SELECT c.c_name FROM customer c JOIN best t ON t.o_custkey = c.c_custkey WHERE CASE WHEN c.c_acctbal + 1 > 0 THEN 1 ELSE 0 END = 1 LIMIT 20",
    "SELECT s.s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_orderkey = {e}) OR COALESCE((SELECT MAX(l_tax) FROM lineitem), 0) > s.s_acctbal * 2 LIMIT 5",
    "SELECT p_partkey FROM part WHERE UPPER(p_name) LIKE '%{e}' OR CAST(p_size AS VARCHAR) = '7' OR (p_size * 2) = {e} LIMIT 5",
    "SELECT l_orderkey, COUNT(*) FROM lineitem JOIN orders o USING (o_orderkey), nation WHERE l_quantity IN ({u}, {e}) AND l_shipdate > DATE '1996-01-01' - INTERVAL '3' DAY GROUP BY l_orderkey LIMIT 7",
    "SELECT n.* FROM nation n NATURAL JOIN region WHERE ((n.n_regionkey = {u}) AND (n.n_nationkey < {e})) LIMIT 9",
    "SELECT a.b.c.d.e.f.g.h.i.j.k.l FROM part LIMIT 5",
    "SELECT */*all*/FROM orders",
    "SELECT o . o_orderkey FROM orders o WHERE o . o_custkey = o.o_custkey LIMIT 5",
    "SELECT c.c_name FROM customer c JOIN nation n ON LOWER(n.n_name) = LOWER(n.n_name) LIMIT 5",
    "SELECT c.c_name FROM customer c LEFT JOIN nation n ON n.n_nationkey + {u} = n.n_nationkey + {u} WHERE c.c_custkey + 1 >= CASE WHEN c.c_acctbal = 1 THEN 2 ELSE c.c_nationkey * (3 + 1) END LIMIT 5",
    "SELECT index FROM part WHERE index = index AND view > 5 LIMIT 5",
    "WITH t AS (SELECT * FROM orders) INSERT INTO part SELECT o_orderkey FROM t",
    "SELECT p_partkey FROM part WHERE NOT p_size - 1 = p_size - 1 OR p_size BETWEEN 1 AND {u} AND p_name = p_name LIMIT 5",
]


def sample_log(events: DataFrame, templates: list[str] = TEMPLATES) -> DataFrame:
    """``query_log(query_id, ts, user_id, dialect, sql)`` from ``events``."""
    pick = (F.col("event_id") % len(templates)).cast("int") + 1
    template = F.element_at(F.array(*[F.lit(t) for t in templates]), pick)
    sql = F.replace(template, F.lit("{u}"), F.col("user_id").cast("string"))
    return events.select(
        F.col("event_id").alias("query_id"),
        "ts",
        "user_id",
        F.lit("generic").alias("dialect"),
        F.replace(sql, F.lit("{e}"), F.col("event_id").cast("string")).alias("sql"),
    )


# DDL templates; event_id modulo their number picks one.
DDL_TEMPLATES = [
    "CREATE TABLE sensor (code INT);",
    "CREATE TABLE sensor (code INT, place VARCHAR(80));",
    "CREATE TABLE sensor (code INT, place VARCHAR(80)); CREATE TABLE reading (sensor_code INT, degrees DOUBLE);",
    "CREATE TABLE sensor (code INT PRIMARY KEY, place VARCHAR(80));",
    "CREATE TABLE t_{u} (a BIGINT, b TEXT, c DECIMAL(10, 2), PRIMARY KEY (a, b)); CREATE INDEX i ON t_{u} (c)",
    "CREATE TABLE IF NOT EXISTS Shop.Item_{e} (Id BIGINT NOT NULL UNIQUE, Made DATE DEFAULT CURRENT_DATE, CONSTRAINT u UNIQUE (made), FOREIGN KEY (id) REFERENCES x (id))",
    "CREATE INDEX early ON log_{e} (b); CREATE TABLE log_{e} (a INT, b INT); CREATE UNIQUE INDEX late ON log_{e} (a, lower(b))",
    "CREATE TABLE twice_{e} (a INT PRIMARY KEY, b INT); CREATE TABLE twice_{e} (b DOUBLE, c TIMESTAMP)",
    "CREATE TABLE broken_{e} (a INT",
    "DROP TABLE sensor; CREATE VIEW v AS SELECT 1; CREATE TABLE n_{u} (name STRING, size FLOAT)",
]

# Texts that the dialects read differently; event_id modulo their number picks one.
DIALECT_TEMPLATES = [
    "SELECT a FROM t WHERE b = $$it's$$ LIMIT 1",
    "SELECT a FROM t WHERE b = E'it\\'s' LIMIT 1",
    "SELECT a FROM t /* one /* two */ OR three */ LIMIT 1",
    "SELECT a # or 'b\nFROM t LIMIT 1",
    "SELECT \"a\" FROM t WHERE \"a\" = \"a\" LIMIT 1",
    "SELECT [a b] FROM t WHERE [it's] = [it's] LIMIT 1",
    "SELECT a FROM t WHERE b = 'x\\' OR 'y' LIMIT 1",
    "SELECT a FROM t WHERE b = '''it's''' LIMIT 1",
    "SELECT a--1 OR b\nFROM t LIMIT 1",
    "SELECT */*all*/FROM t",
    "SELECT a /* open FROM t",
    "SELECT #x FROM t",
    "SELECT a . b FROM t WHERE t . a = t.a LIMIT 1",
    "SELECT \"it\"\"s\" FROM t WHERE `a``b` = `a``b` LIMIT 1",
    "SELECT $tag$ $$ or 'x $tag$ FROM t",
    "SELECT 'a /* b' FROM t /* c /* ' */ ' */ WHERE a = 1 OR b = '*/' LIMIT 1",
    "SELECT a FROM t /* one /* two */ LIMIT 1",
]

# Statements that fill tables from others; event_id modulo their number picks one.
FLOW_TEMPLATES = [
    "CREATE TABLE IF NOT EXISTS stage_{u} AS SELECT r.k FROM raw_{u} r JOIN calendar ON r.d = calendar.d",
    "INSERT INTO mart_{u} (k) SELECT k FROM stage_{u} UNION ALL SELECT k FROM (SELECT k FROM fixes_{u}) f",
    "CREATE OR REPLACE VIEW Report_{u} AS WITH best AS (SELECT * FROM mart_{u}) SELECT * FROM best, regions",
    "INSERT INTO raw_{u} SELECT k FROM report_{u} WHERE k NOT IN (SELECT k FROM seen_{u})",
    "INSERT INTO total SELECT SUM(k) FROM mart_{u}; SELECT * FROM raw_{u}",
    "WITH stage_{u} AS (SELECT * FROM stage_{u}) INSERT INTO daily_{u} SELECT * FROM stage_{u}",
    "INSERT INTO log_{u} VALUES ({e}, 'SELECT k FROM raw_{u}'); DELETE FROM mart_{u} WHERE k = {e}",
    "CREATE TABLE plain_{u} (k INT); INSERT INTO plain_{u} SELECT k FROM total",
]

# What the test tables are said to hold; not all of it is so.
TABLE_DDL = [
    "CREATE TABLE region (r_regionkey INT PRIMARY KEY, r_name VARCHAR(25), r_comment VARCHAR(152))",
    "CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name VARCHAR(25), n_regionkey BIGINT)",
    "CREATE TABLE customer (c_custkey BIGINT PRIMARY KEY, c_name TEXT, c_nationkey INT, c_acctbal INT)",
    "CREATE TABLE supplier (s_suppkey INT PRIMARY KEY, s_name TEXT, s_nationkey INT, s_acctbal DOUBLE)",
    "CREATE TABLE part (p_partkey BIGINT PRIMARY KEY, p_name TEXT, p_brand TEXT, p_type TEXT, p_size VARCHAR(5), p_retailprice BIGINT)",
    "CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT UNIQUE, o_orderstatus VARCHAR(1), o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_clerk TEXT)",
    "CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey INT, l_suppkey BIGINT, l_linenumber INT, l_quantity INT, l_extendedprice DOUBLE, l_discount INT, l_tax DOUBLE, l_returnflag TEXT, l_linestatus TEXT, l_shipdate TIMESTAMP)",
    "CREATE TABLE events (event_id BIGINT PRIMARY KEY, ts TIMESTAMP, user_id INT, event_type BIGINT, value DOUBLE, props TEXT)",
]

# Spellings of dialect names found in logs; some unknown.
DIALECT_SPELLINGS = [
    "PostgreSQL", "mysql", "MSSQL", "BigQuery", "sqlite", "ANSI", "generic", "oracle", "Snowflake",
]


def sample_ddl(events: DataFrame) -> DataFrame:
    """``ddl(ddl_id, dialect, sql)`` from ``events``, one DDL text per event."""
    return sample_log(events, DDL_TEMPLATES).select(
        F.col("query_id").alias("ddl_id"), "dialect", "sql"
    )


def spread_dialects(log: DataFrame) -> DataFrame:
    """The log with dialect names as users spell them."""
    names = F.array(*[F.lit(d) for d in DIALECT_SPELLINGS])
    pick = (F.col("query_id") % len(DIALECT_SPELLINGS)).cast("int") + 1
    return log.withColumn("dialect", F.element_at(names, pick))


def dialect_log(events: DataFrame) -> DataFrame:
    """Each of the texts that dialects read differently, under each spelling of a dialect."""
    log = sample_log(events, DIALECT_TEMPLATES)
    names = F.array(*[F.lit(d) for d in DIALECT_SPELLINGS])
    turn = F.floor(F.col("query_id") / len(DIALECT_TEMPLATES)) % len(DIALECT_SPELLINGS)
    return log.withColumn("dialect", F.element_at(names, turn.cast("int") + 1))
