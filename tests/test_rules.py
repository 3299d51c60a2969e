"""One positive and one negative case per rule, in default and in parity mode."""

import pytest

from logsieve.plans import lint
from logsieve.plans.registry import tables_catalog
from logsieve.sources.samples import TEMPLATES
from tests.helpers import found, make_log

# template number -> (rules that must fire, rules that must not); "x2" means twice
CASES = {
    1: ("L001 L026", "L006"), 2: ("L026", "L001"), 3: ("L002", "L026"), 4: ("L002", ""),
    5: ("", "L002"), 6: ("L003x2", "L026"), 7: ("L004", ""), 8: ("L004", ""), 9: ("L005", ""),
    10: ("", "L005"), 11: ("", "L005"), 12: ("L006", "L013"), 13: ("", "L006"), 14: ("L007", ""),
    15: ("L007", ""), 16: ("", "L007"), 17: ("L008", "L010"), 18: ("L009", "L016"),
    19: ("L010", "L024"), 20: ("L011", "L026"), 21: ("", "L011"), 22: ("L012", ""),
    23: ("L012", ""), 24: ("", "L012"), 25: ("L013 L006", ""), 26: ("L014", "L012"),
    27: ("L015", ""), 28: ("L016", "L009"), 29: ("", "L016"), 30: ("L017", ""),
    31: ("L018", "L009 L016"), 32: ("L019", ""), 33: ("L023x2", ""), 34: ("L024", "L010"),
    35: ("L025", ""), 37: ("L006", ""), 38: ("L001", ""), 39: ("L001", ""), 40: ("L012", "L014"),
    42: ("", "L016"), 43: ("", "L005"), 51: ("", "L001 L002 L003 L004 L026"), 52: ("L026 L002", ""),
    53: ("L001", ""), 54: ("", "L016 L018"),
}
CATALOG_CASES = {
    41: ("", "L020"), 44: ("L020", ""), 45: ("L020", ""), 46: ("L020", ""), 48: ("L021", "L022"),
    49: ("L021 L022", ""), 50: ("L022", "L021"), 17: ("", "L020"), 39: ("", "L020"), 34: ("", "L020"),
}


def check(result, cases):
    for number, (fires, silent) in cases.items():
        got = result[number - 1]
        for rule in fires.split():
            rule, _, times = rule.partition("x")
            assert got.count(rule) == int(times or 1), (number, TEMPLATES[number - 1], got)
        for rule in silent.split():
            assert rule not in got, (number, TEMPLATES[number - 1], got)


@pytest.fixture(scope="module")
def modes(spark, sf_dir):
    catalog = tables_catalog(spark, sf_dir)
    return {
        "default": found(spark, TEMPLATES[:54]),
        "parity": found(spark, TEMPLATES[:54], parity=True),
        "catalog": found(spark, TEMPLATES[:54], catalog),
        "catalog_parity": found(spark, TEMPLATES[:54], catalog, parity=True),
    }


def test_default(modes):
    check(modes["default"], CASES)
    severe = {"L001", "L002", "L003", "L005", "L007", "L008", "L010", "L012", "L023", "L026"}
    assert not severe & set(modes["default"][35])


def test_parity_hides_unvisited_queries(modes):
    check(modes["parity"], {n: c for n, c in CASES.items() if n not in (37, 38, 39, 53)})
    check(modes["parity"], {37: ("", "L006"), 38: ("", "L001"), 39: ("", "L001"), 53: ("", "L001 L026")})


def test_catalog(modes):
    check(modes["catalog"], CATALOG_CASES)


def test_catalog_parity_reports_more(modes):
    check(modes["catalog_parity"], {41: ("L020", ""), 39: ("L020", ""), 34: ("L020", "")})


def test_parity_is_a_subset_except_names(modes):
    for default, parity in zip(modes["catalog"], modes["catalog_parity"]):
        assert {r for r in parity if r not in ("L020", "L022")} <= set(default)


TWO_TABLES = "CREATE TABLE sensor (code INT, place VARCHAR(80)); CREATE TABLE reading (code INT, degrees DOUBLE)"
DDL_CASES = [
    ("CREATE TABLE sensor (code INT)", "SELECT degrees FROM reading LIMIT 1", "L020"),
    ("CREATE TABLE sensor (code INT, place VARCHAR(80))", "SELECT height FROM sensor LIMIT 1", "L020"),
    (TWO_TABLES, "SELECT code FROM sensor s JOIN reading r ON s.code = r.code LIMIT 1", "L020"),
    (TWO_TABLES, "SELECT place FROM sensor WHERE code < 'high' LIMIT 1", "L021"),
    ("CREATE TABLE sensor (code INT UNIQUE, place VARCHAR(80))", "SELECT code FROM sensor WHERE place > 'm' LIMIT 1", "L022"),
]


@pytest.mark.parametrize("ddl,sql,rule", DDL_CASES)
def test_catalog_from_ddl(spark, ddl, sql, rule):
    from logsieve.sources.catalog import catalog_from_ddl

    ddls = spark.createDataFrame([(0, "generic", ddl)], "ddl_id bigint, dialect string, sql string")
    catalog = catalog_from_ddl(ddls).drop("ddl_id")
    names = lint.lint(make_log(spark, [sql]), catalog, only=["L020", "L021", "L022"]).collect()
    assert rule in [r.rule_id for r in names]


def test_empty_catalog_reports_no_names(spark):
    from logsieve.sources.catalog import empty_catalog

    got = found(spark, ["SELECT z.nope FROM nowhere LIMIT 1"], empty_catalog(spark))
    assert got == [[]]


EDGE = [
    # text, rules in default mode
    ("SELECT COALESCE((SELECT MAX(x) FROM t), 0) FROM u WHERE COALESCE((SELECT MAX(x) FROM t), 0) = 1 LIMIT 1",
     ["L010", "L024"]),
    ("SELECT a FROM t WHERE SUM(CASE WHEN a THEN 1 END) > 1 LIMIT 1", []),
    ("SELECT a FROM t WHERE a BETWEEN 1 AND 2 AND b + 1 = 3 LIMIT 1", ["L012"]),
    ("SELECT a FROM t WHERE CAST(a AS INT) + 1 > 5 AND -a > 3 AND SUBSTRING(a, 1, 2) = 'x' LIMIT 1", []),
    ("SELECT a FROM t WHERE (a + 1) * 2 > 5 LIMIT 1", ["L012"]),
    ("SELECT a FROM t WHERE f(g(a)) = 1 LIMIT 1", ["L012", "L012"]),
    ("SELECT a FROM t WHERE (((a = 1))) LIMIT 1", ["L025", "L025"]),
    ("SELECT a FROM x LEFT JOIN y q USING (a) FULL OUTER JOIN z r LIMIT 1", ["L016"]),
    ("SELECT a FROM x JOIN y q ON q.a = q.a CROSS JOIN z JOIN w v ON TRUE LIMIT 1", ["L009", "L016", "L016"]),
    ("SELECT a FROM x JOIN y q ON 1 = 1 AND x.a = q.b LIMIT 1", []),
    ("SELECT a FROM x JOIN y q ON f(q.a, 'b') = f(q.a, 'b') LEFT JOIN z r ON r.a - 1 = r.a - 1 LIMIT 1", ["L016", "L016"]),
    ("SELECT a FROM x JOIN y q ON q.a - q.b * q.a - q.c * q.a = q.a - q.c * q.a - q.b * q.a LIMIT 1", []),
    ("SELECT a FROM x JOIN y q ON q.a = q.a = q.a LIMIT 1", []),
    ("SELECT a FROM x JOIN y q ON (q.a = q.a) LIMIT 1", []),
    ("SELECT index FROM t WHERE index = index AND set > 1 AND view IN (1) LIMIT 1", ["L015"]),
    ("SELECT SUM(a) OVER (PARTITION BY partition) FROM t LIMIT 1", []),
    ("SELECT a FROM t WHERE t . a = t.a LIMIT 1", ["L015"]),
    ("SELECT */*all*/FROM t LIMIT 1", ["L001"]),
    ("SELECT a FROM t /* b /* c */ OR d */ LIMIT 1", []),
    ("SELECT a FROM (x JOIN y ON x.a = y.a) JOIN z q ON q.a = x.a LIMIT 1", []),
    ("SELECT a FROM t GROUP BY a ORDER BY 1 + 1, a LIMIT 1", []),
    ("SELECT EXTRACT(year FROM d) FROM t LIMIT 1", []),
    ("SELECT a FROM t WHERE a = a + 1 LIMIT 1", ["L012"]),
    ("SELECT a FROM t WHERE A.b = a.b OR t.c = t.c LIMIT 1", ["L003", "L015"]),
    ("UPDATE t SET a = NULL WHERE NULL = b", ["L023"]),
    ("(SELECT a FROM t) UNION (SELECT b FROM u LIMIT 1)", ["L011", "L026"]),
    ("SELECT a, (b), COUNT(*) FROM t, (SELECT 1) LIMIT 1", ["L018", "L019"]),
    ("DELETE FROM t WHERE a IN (SELECT b FROM u)", []),
    ("DELETE FROM t USING (SELECT b FROM u WHERE b = 1) q", ["L002"]),
]


def test_edges(spark):
    got = found(spark, [sql for sql, _ in EDGE])
    for (sql, want), have in zip(EDGE, got):
        assert have == sorted(want), sql


def test_comments_and_blanks_change_nothing(spark):
    base = [t for t in TEMPLATES[:54] if "'" not in t]
    noisy = [t.replace(" ", " /* from (;' */\n\t").replace("\n\t(", " (") + " -- where (" for t in base]
    plain, with_noise = found(spark, base), found(spark, noisy)
    strip = lambda rows: [[r for r in x if r != "L004"] for x in rows]
    assert strip(plain) == strip(with_noise)


def test_splitting_the_log_changes_nothing(spark):
    log = make_log(spark, TEMPLATES)
    key = ["query_id", "rule_id", "pos"]
    whole = lint.lint(log).select(*key).collect()
    halves = [
        r for h in (0, 1) for r in lint.lint(log.filter(f"query_id % 2 = {h}")).select(*key).collect()
    ]
    assert sorted(whole) == sorted(halves)


def test_a_list_before_insert_is_not_a_query(spark):
    sql = "WITH q AS (SELECT a FROM t) INSERT INTO u SELECT * FROM q WHERE a = 1 OR b = 2"
    assert found(spark, [sql]) == [["L001", "L003"]] and found(spark, [sql], parity=True) == [[]]
    assert found(spark, ["WITH q AS (SELECT a FROM t) SELECT a FROM q"], parity=True) == [["L026"]]


def test_single_rules_skip_other_texts_only(spark):
    """A rule alone finds what it finds among all rules, and tokenises no text in which it can find nothing."""
    sqls = [
        "SELECT a FROM t joın u ON t.a = u.a LIMIT 1", "SELECT a FROM t join u USING (a) LIMIT 1",
        "SELECT DISTINCT a FROM t group BY a LIMIT 1", "SELECT MAX(a) FROM t havıng 1 LIMIT 1",
        "SELECT a FROM t WHERE a /* x /* y */ z */ >= a LIMIT 1", "SELECT a FROM t WHERE a != a LIMIT 1",
        "SELECT a FROM t, u LIMIT 1", "SELECT a FROM t HAVING COUNT(*) > 5 LIMIT 1", "SELECT 1", "not sql , having",
    ]
    log = make_log(spark, sqls)
    key = lambda r: (r.query_id, r.rule_id, r.pos)
    every = [key(r) for r in lint.lint(log).collect()]
    for rule in ("L009", "L014"):
        alone = sorted(key(r) for r in lint.lint(log, only=[rule]).collect())
        assert alone and alone == sorted(k for k in every if k[1] == rule)
    for rule, texts in (("L009", 2), ("L013", 1), ("L014", 3), ("L018", 2)):
        assert lint.prepare(log, [rule]).tokens.select("text_id").distinct().count() == texts
    assert lint.prepare(log, ["L009", "L020"]).tokens.select("text_id").distinct().count() == len(sqls)


def test_findings_are_built_only_where_there_are_some(spark):
    from logsieve.operators.rules import token_hits

    assert str(token_hits(["L003"])).startswith("Column<'CASE WHEN")
    assert found(spark, ["SELECT a FROM t LIMIT 1", "SELECT * FROM t LIMIT 1"]) == [[], ["L001"]]
