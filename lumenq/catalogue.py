"""The named queries: dialect text, and the same in DuckDB's SQL where it is spelled otherwise."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenq.session import Engine

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
FLAGSHIP = "SELECT l_returnflag, sum(l_quantity) AS q, count(1) AS n FROM lineitem WHERE l_discount < 0.05 GROUP BY l_returnflag ORDER BY l_returnflag"

#: name -> dialect text, DuckDB text (None: the same)
SELECTS: dict[str, tuple[str, str | None]] = {
    # scan and project
    "scan_full": ("SELECT * FROM nation", None),
    "scan_limited": ("SELECT r_regionkey FROM region LIMIT 99", None),
    "project_alias": ("SELECT r_regionkey AS k, r_name AS name FROM region", None),
    "project_star": ("SELECT * FROM region", None),
    "project_qualified_star": ("SELECT n.* FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'", None),
    "project_unaliased": ("SELECT r_regionkey + 1 FROM region", 'SELECT CAST(r_regionkey + 1 AS BIGINT) AS "?column?" FROM region'),
    "select_no_from": ("SELECT 1 AS one, 'a' AS a, 1.5 AS f, TRUE AS t", "SELECT 1::BIGINT AS one, 'a' AS a, 1.5::DOUBLE AS f, TRUE AS t"),
    # comparisons
    "filter_eq": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", None),
    "filter_neq": ("SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'", None),
    "filter_neq_angle": ("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'", None),
    "filter_lt": ("SELECT p_partkey FROM part WHERE p_size < 10", None),
    "filter_gt": ("SELECT p_partkey FROM part WHERE p_retailprice > 950.5", None),
    "filter_lte": ("SELECT p_partkey FROM part WHERE p_size <= 10", None),
    "filter_gte": ("SELECT p_partkey FROM part WHERE p_brand >= 'Brand#3'", None),
    "filter_and": ("SELECT p_partkey FROM part WHERE p_size > 10 AND p_size < 20 AND p_retailprice > 950.0", None),
    "filter_or": ("SELECT p_partkey FROM part WHERE p_size < 5 OR p_size > 45", None),
    "filter_not": ("SELECT p_partkey FROM part WHERE NOT p_size < 40", None),
    "filter_bang": ("SELECT p_partkey FROM part WHERE !(p_size < 40)", "SELECT p_partkey FROM part WHERE NOT (p_size < 40)"),
    "filter_precedence": ("SELECT p_partkey FROM part WHERE p_size = 1 OR p_size = 2 AND p_partkey * 2 + 1 > 500 - 10 - 20", None),
    "filter_parens": ("SELECT p_partkey FROM part WHERE (p_size = 1 OR p_size = 2) AND p_partkey > 500", None),
    "filter_null_drops": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NULLIF(l_linenumber, 1) > 5", None),
    # predicates
    "filter_between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice > 950.0", None),
    "filter_not_between": ("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45", None),
    "filter_in": ("SELECT p_partkey FROM part WHERE p_size IN (1, 3, 5)", None),
    "filter_not_in": ("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P')", None),
    "filter_like": ("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%'", None),
    "filter_not_like": ("SELECT p_partkey FROM part WHERE p_brand NOT LIKE 'Brand#1_'", None),
    "filter_is_null": ("SELECT event_id FROM events WHERE NULLIF(event_type, 'click') IS NULL", None),
    "filter_is_not_null": ("SELECT event_id FROM events WHERE NULLIF(event_type, 'click') IS NOT NULL", None),
    "filter_is_true": ("SELECT event_id FROM events WHERE (NULLIF(event_type, 'click') = 'view') IS TRUE", None),
    "filter_is_not_true": ("SELECT event_id FROM events WHERE (NULLIF(event_type, 'click') = 'view') IS NOT TRUE", None),
    "filter_is_false": ("SELECT event_id FROM events WHERE (NULLIF(event_type, 'click') = 'view') IS FALSE", None),
    "filter_is_not_false": ("SELECT event_id FROM events WHERE (NULLIF(event_type, 'click') = 'view') IS NOT FALSE", None),
    # arithmetic
    "arith_int": ("SELECT p_partkey, p_partkey + p_size AS a, p_partkey - p_size AS s, p_partkey * p_size AS m FROM part", None),
    "arith_float": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity - l_tax AS d, l_quantity + l_tax AS a FROM lineitem", None),
    "int_div": ("SELECT p_partkey, p_partkey / p_size AS d, (0 - p_partkey) / 7 AS e FROM part", "SELECT p_partkey, p_partkey // p_size AS d, (0 - p_partkey) // 7 AS e FROM part"),
    "float_div": ("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS d FROM lineitem", None),
    "float_div_zero": ("SELECT l_orderkey, l_linenumber, l_quantity / (l_tax * 0.0) AS inf, (0.0 - l_quantity) / (l_tax * 0.0) AS ninf FROM lineitem", "SELECT l_orderkey, l_linenumber, 'inf'::DOUBLE AS inf, '-inf'::DOUBLE AS ninf FROM lineitem"),
    "string_concat": ("SELECT n_nationkey, n_name + '-' + n_name AS nn FROM nation", "SELECT n_nationkey, n_name || '-' || n_name AS nn FROM nation"),
    "unary_neg": ("SELECT p_partkey, -p_size AS neg, -p_retailprice AS negf FROM part", None),
    "unary_pos": ("SELECT p_partkey, +p_size AS pos FROM part", None),
    "literals": ("SELECT r_regionkey, 'it''s' AS s, 2.5 AS f, -3 AS i, NULL AS n FROM region", "SELECT r_regionkey, 'it''s' AS s, 2.5::DOUBLE AS f, (-3)::BIGINT AS i, NULL::VARCHAR AS n FROM region"),
    "comments": ("SELECT r_name /* the name */ FROM region -- all of it", "SELECT r_name FROM region"),
    "quoted_identifiers": ('SELECT "r_name" AS `the name` FROM "region"', 'SELECT r_name AS "the name" FROM region'),
    # conditional functions
    "fn_nullif": ("SELECT l_orderkey, l_linenumber, NULLIF(l_linenumber, 1) AS v FROM lineitem", None),
    "fn_coalesce": ("SELECT event_id, COALESCE(NULLIF(event_type, 'click'), 'was click') AS v FROM events", None),
    "fn_greatest": ("SELECT l_orderkey, l_linenumber, GREATEST(l_quantity, l_linenumber * 5.0, NULL) AS v FROM lineitem", "SELECT l_orderkey, l_linenumber, GREATEST(l_quantity, l_linenumber * 5.0::DOUBLE) AS v FROM lineitem"),
    "fn_least": ("SELECT l_orderkey, l_linenumber, least(l_quantity, l_linenumber * 5.0) AS v FROM lineitem", "SELECT l_orderkey, l_linenumber, least(l_quantity, l_linenumber * 5.0::DOUBLE) AS v FROM lineitem"),
    # aggregates
    "agg_count_col": ("SELECT count(NULLIF(event_type, 'click')) AS n FROM events", None),
    "agg_count_const": ("SELECT count(1) AS n, count(NULL) AS z FROM events", None),
    "agg_count_star": ("SELECT count(*) AS n FROM events", None),
    "agg_sum_int": ("SELECT sum(l_linenumber) AS s FROM lineitem", "SELECT sum(l_linenumber)::BIGINT AS s FROM lineitem"),
    "agg_sum_float": ("SELECT l_returnflag, sum(l_quantity) AS s FROM lineitem GROUP BY l_returnflag", None),
    "agg_max": ("SELECT max(l_extendedprice) AS m, max(l_shipdate) AS d FROM lineitem", None),
    "agg_min": ("SELECT min(l_extendedprice) AS m, min(l_returnflag) AS f FROM lineitem", None),
    "agg_avg": ("SELECT l_linestatus, avg(l_linenumber) AS a FROM lineitem GROUP BY l_linestatus", None),
    "agg_every": ("SELECT event_type, every(user_id > 1) AS e FROM events GROUP BY event_type", "SELECT event_type, bool_and(user_id > 1) AS e FROM events GROUP BY event_type"),
    "agg_array": ("SELECT n_regionkey, arrayagg(n_nationkey) AS a FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS a FROM nation GROUP BY n_regionkey"),
    "agg_string": ("SELECT n_regionkey, stringagg(n_name, ', ') AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey"),
    "agg_expr": ("SELECT l_returnflag, sum(l_linenumber * 2 + 1) + 1 AS s, sum(-l_linenumber) AS n, sum(l_linenumber) * 2 AS t FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, (sum(l_linenumber * 2 + 1) + 1)::BIGINT AS s, sum(-l_linenumber)::BIGINT AS n, (sum(l_linenumber) * 2)::BIGINT AS t FROM lineitem GROUP BY l_returnflag"),
    "agg_global": ("SELECT count(o_orderkey) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderstatus = 'F'", None),
    "agg_global_empty": ("SELECT count(1) AS n, sum(o_orderkey) AS s, max(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0", "SELECT count(1) AS n, sum(o_orderkey)::BIGINT AS s, max(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0"),
    # grouping
    "group_one": ("SELECT event_type, count(1) AS n FROM events GROUP BY event_type", None),
    "group_many": ("SELECT l_returnflag, l_linestatus, count(1) AS n, sum(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(1) AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "group_no_agg": ("SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_all": ("SELECT o_orderstatus, o_orderpriority, count(1) AS n FROM orders GROUP BY ALL", None),
    "group_all_aggregates": ("SELECT count(1) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL", "SELECT count(1) AS n, sum(l_quantity) AS q FROM lineitem"),
    "group_null_key": ("SELECT e.k AS k, count(1) AS n FROM (SELECT NULLIF(event_type, 'click') AS k FROM events) AS e GROUP BY e.k", "SELECT NULLIF(event_type, 'click') AS k, count(1) AS n FROM events GROUP BY 1"),
    "having": ("SELECT o_custkey, count(1) AS n FROM orders GROUP BY o_custkey HAVING count(1) > 10 AND sum(o_totalprice) > 1000.0", None),
    "order_by_agg": ("SELECT p_brand, count(1) AS n FROM part GROUP BY p_brand ORDER BY sum(p_size) DESC, p_brand LIMIT 5", None),
    # order, slice
    "sort_asc": ("SELECT c_custkey, c_name FROM customer ORDER BY c_name ASC", None),
    "sort_desc": ("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20", None),
    "sort_multi": ("SELECT o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_custkey ASC, o_orderkey LIMIT 50", None),
    "sort_expr": ("SELECT p_partkey FROM part ORDER BY p_size * 3 - p_partkey DESC, p_partkey LIMIT 30", None),
    "sort_alias": ("SELECT p_partkey, p_size * 2 AS twice FROM part ORDER BY twice DESC, p_partkey LIMIT 30", None),
    "sort_nulls_default": ("SELECT event_id FROM events ORDER BY NULLIF(event_type, 'click') DESC, event_id LIMIT 40", "SELECT event_id FROM events ORDER BY NULLIF(event_type, 'click') DESC NULLS FIRST, event_id LIMIT 40"),
    "sort_nulls_first": ("SELECT event_id FROM events ORDER BY NULLIF(event_type, 'click') ASC NULLS FIRST, event_id LIMIT 40", None),
    "sort_nulls_last": ("SELECT event_id FROM events ORDER BY NULLIF(event_type, 'click') DESC NULLS LAST, event_id LIMIT 40", None),
    "limit": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7", None),
    "offset": ("SELECT r_regionkey FROM region ORDER BY r_regionkey OFFSET 3", None),
    "offset_past_end": ("SELECT r_regionkey FROM region ORDER BY r_regionkey OFFSET 10", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 5 LIMIT 7", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5"),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    # joins
    "join_inner": ("SELECT o.o_orderkey AS k, c.c_name AS name FROM orders AS o INNER JOIN customer AS c ON o.o_custkey = c.c_custkey", None),
    "join_left": ("SELECT d.doc_id AS doc_id, l.quality AS quality FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id", None),
    "join_right": ("SELECT l.quality AS quality, d.doc_id AS doc_id FROM labels AS l RIGHT OUTER JOIN documents AS d ON d.doc_id = l.doc_id", None),
    "join_full": ("SELECT l.doc_id AS a, b.item_id AS b FROM labels AS l FULL OUTER JOIN benchmark AS b ON l.doc_id = b.item_id", None),
    "join_theta": ("SELECT a.n_nationkey AS x, r.r_regionkey AS y FROM nation AS a JOIN region AS r ON a.n_regionkey < r.r_regionkey", None),
    "join_no_on": ("SELECT a.r_name AS x, b.n_name AS y FROM region AS a JOIN nation AS b", "SELECT a.r_name AS x, b.n_name AS y FROM region AS a CROSS JOIN nation AS b"),
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "join_chain": ("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", None),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_agg": ("SELECT n.n_name AS name, count(1) AS orders FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name ORDER BY n.n_name", None),
    # subqueries
    "derived_table": ("SELECT x.k AS k, x.n AS n FROM (SELECT o_custkey AS k, count(1) AS n FROM orders GROUP BY o_custkey) AS x WHERE x.n > 5", None),
    "scalar_subquery": ("SELECT p_partkey FROM part WHERE p_size > (SELECT avg(p_size) FROM part)", None),
    "scalar_subquery_select": ("SELECT r_regionkey, (SELECT count(1) FROM nation) AS n FROM region", None),
    "in_subquery": ("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", None),
    "not_in_subquery": ("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", None),
    "not_in_subquery_null": ("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT NULLIF(n_nationkey, 3) FROM nation)", None),
    "flagship": (FLAGSHIP, None),
}


def engine_on(spark: SparkSession, sf_dir: str, warehouse: str | None = None) -> Engine:
    """An engine that knows the driver's tables."""
    engine = Engine(spark, warehouse)
    for name in TABLES:
        engine.register(name, _Lazy(spark, f"{sf_dir}/{name}.parquet"))
    return engine


class _Lazy:
    """A table that is looked up when first used, so that missing ones do no harm."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path, self._frame = spark, path, None

    def __getattr__(self, name):
        if self._frame is None:
            self._frame = self._spark.read.parquet(self._path)
        return getattr(self._frame, name)


def warehouse_of(spark: SparkSession) -> str:
    """A new folder in the store that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/lumenq-{uuid.uuid4().hex[:12]}"


def _select(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine_on(spark, sf_dir).sql(text)


# --- statements that change tables: each runs in a warehouse of its own and returns the final table ---

_ORDERS = "INSERT INTO t (k, status, price) SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
_CREATE = "CREATE TABLE t (k INTEGER PRIMARY KEY, status VARCHAR(1) NOT NULL, price FLOAT)"


def _script(*statements: str | Callable[[Engine], None], fails: str = "", params: dict[int, list] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """Runs statements; the last one is the result. fails: a statement that must be refused."""

    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        from lumenq.errors import LumenError

        engine = engine_on(spark, sf_dir, warehouse_of(spark))
        for n, s in enumerate(statements):
            if callable(s):
                s(engine)
                continue
            if s == fails:
                try:
                    engine.sql(s)
                except LumenError:
                    continue
                raise AssertionError(f"{s} should fail")
            out = engine.sql(s, (params or {}).get(n, ()))
        return out

    return go


_ALL = "SELECT * FROM t"
SCRIPTS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "insert_values": (_script(_CREATE, "INSERT INTO t (status, k, price) VALUES ('F', 1, 1.5), ('O', 2, NULL), ('P', 1 + 2, 2)", _ALL), "SELECT * FROM (VALUES (1::BIGINT, 'F', 1.5::DOUBLE), (2, 'O', NULL), (3, 'P', 2.0)) AS t(k, status, price)"),
    "insert_defaults": (_script("CREATE TABLE t (k INTEGER, s VARCHAR(9))", "ALTER TABLE t ALTER COLUMN s SET DEFAULT 'new'", "INSERT INTO t (k) VALUES (1)", "INSERT INTO t (k, s) VALUES (2, DEFAULT), (3, NULL)", _ALL), "SELECT * FROM (VALUES (1::BIGINT, 'new'), (2, 'new'), (3, NULL)) AS t(k, s)"),
    "insert_select": (_script(_CREATE, _ORDERS, _ALL), "SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders"),
    "update_where": (_script(_CREATE, _ORDERS, "UPDATE t SET status = 'X' WHERE k < 100", _ALL), "SELECT o_orderkey AS k, CASE WHEN o_orderkey < 100 THEN 'X' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders"),
    "update_expr": (_script(_CREATE, _ORDERS, "UPDATE t AS a SET price = a.price * 2 + 1, k = -k", _ALL), "SELECT -o_orderkey AS k, o_orderstatus AS status, o_totalprice * 2 + 1 AS price FROM orders"),
    "delete_where": (_script(_CREATE, _ORDERS, "DELETE FROM t WHERE status = 'F' OR NULLIF(k, 7) IS NULL", _ALL), "SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey <> 7"),
    "delete_all": (_script(_CREATE, _ORDERS, "DELETE FROM t", "SELECT count(1) AS n FROM t"), "SELECT 0::BIGINT AS n"),
    "alter_add_column": (_script(_CREATE, _ORDERS, "ALTER TABLE t ADD COLUMN note VARCHAR(9)", "SELECT k, note FROM t"), "SELECT o_orderkey AS k, NULL::VARCHAR AS note FROM orders"),
    "alter_drop_column": (_script(_CREATE, _ORDERS, "ALTER TABLE t DROP COLUMN price", _ALL), "SELECT o_orderkey AS k, o_orderstatus AS status FROM orders"),
    "alter_rename_column": (_script(_CREATE, _ORDERS, "ALTER TABLE t RENAME COLUMN price TO cost", _ALL), "SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS cost FROM orders"),
    "alter_rename_table": (_script(_CREATE, _ORDERS, "ALTER TABLE t RENAME TO u", "SELECT * FROM u"), "SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders"),
    "alter_set_type": (_script(_CREATE, _ORDERS, "ALTER TABLE t ALTER COLUMN k TYPE FLOAT", "SELECT k, status FROM t"), "SELECT o_orderkey::DOUBLE AS k, o_orderstatus AS status FROM orders"),
    "alter_defaults": (_script(_CREATE, "ALTER TABLE t ALTER price SET DEFAULT 9.5", "INSERT INTO t (k, status) VALUES (1, 'a')", "ALTER TABLE t ALTER price DROP DEFAULT", "INSERT INTO t (k, status) VALUES (2, 'b')", _ALL), "SELECT * FROM (VALUES (1::BIGINT, 'a', 9.5::DOUBLE), (2, 'b', NULL)) AS t(k, status, price)"),
    "alter_not_null": (_script(_CREATE, "ALTER TABLE t ALTER price SET NOT NULL", "INSERT INTO t (k, status) VALUES (1, 'a')", "ALTER TABLE t ALTER price DROP NOT NULL", "INSERT INTO t (k, status) VALUES (2, 'b')", _ALL, fails="INSERT INTO t (k, status) VALUES (1, 'a')"), "SELECT 2::BIGINT AS k, 'b' AS status, NULL::DOUBLE AS price"),
    "unique_reject": (_script(_CREATE, _ORDERS, "INSERT INTO t (k, status) VALUES (1, 'F')", "SELECT count(1) AS n FROM t", fails="INSERT INTO t (k, status) VALUES (1, 'F')"), "SELECT count(1) AS n FROM orders"),
    "unique_index": (_script(_CREATE, _ORDERS, "CREATE UNIQUE INDEX i ON t (status)", "CREATE INDEX j ON t (status)", "DROP INDEX j ON t", "SELECT count(1) AS n FROM t", fails="CREATE UNIQUE INDEX i ON t (status)"), "SELECT count(1) AS n FROM orders"),
    "index_point_lookup": (_script(_CREATE, _ORDERS, lambda e: e.cluster("t", "k"), "SELECT k, price FROM t WHERE k = 1203"), "SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_orderkey = 1203"),
    "index_range_lookup": (_script(_CREATE, _ORDERS, lambda e: e.cluster("t", "k"), "SELECT k, price FROM t WHERE k >= 2100 AND k < 2350"), "SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_orderkey >= 2100 AND o_orderkey < 2350"),
    "alter_if_exists": (_script(_CREATE, "ALTER TABLE IF EXISTS nowhere RENAME TO u", "ALTER TABLE IF EXISTS t RENAME TO u", _ORDERS.replace("INTO t", "INTO u"), "SELECT k FROM u"), "SELECT o_orderkey AS k FROM orders"),
    "txn_recreate": (_script(_CREATE, _ORDERS, "BEGIN TRANSACTION", "DROP TABLE t", "CREATE TABLE t (k INTEGER, s VARCHAR(9))", "INSERT INTO t (k, s) VALUES (1, 'new')", "COMMIT", "SELECT * FROM t"), "SELECT 1::BIGINT AS k, 'new' AS s"),
    "show_tables": (_script(_CREATE, "CREATE TABLE IF NOT EXISTS u (a BOOLEAN)", "DROP TABLE IF EXISTS v", "SHOW TABLES"), "SELECT * FROM (VALUES ('t'), ('u')) AS x(\"table name\")"),
    "show_databases": (_script("CREATE DATABASE a", "CREATE DATABASE IF NOT EXISTS a", "ALTER DATABASE a RENAME TO b", "CREATE DATABASE c", "DROP DATABASE c", "\\l"), "SELECT * FROM (VALUES ('default'), ('b')) AS x(\"database name\")"),
    "use_database": (_script("CREATE DATABASE a", "\\c a", "CREATE TABLE t (k INT)", "INSERT INTO a.t (k) VALUES (1)", "USE default", "SELECT * FROM a.t"), "SELECT 1::BIGINT AS k"),
    "desc_table": (_script("CREATE TABLE t (k INTEGER PRIMARY KEY, s VARCHAR(9) COMMENT 'a text', f FLOAT)", "DESC t"), "SELECT * FROM (VALUES ('k', 'INTEGER', 'NO', '', ''), ('s', 'VARCHAR(9)', 'YES', '', 'a text'), ('f', 'FLOAT', 'YES', '', '')) AS x(Field, Type, \"Null\", \"Default\", Comment)"),
    "txn_rollback": (_script(_CREATE, _ORDERS, "BEGIN TRANSACTION", "DELETE FROM t", "ROLLBACK", "SELECT count(1) AS n FROM t"), "SELECT count(1) AS n FROM orders"),
    "txn_commit": (_script(_CREATE, _ORDERS, "BEGIN TRANSACTION", "DELETE FROM t WHERE k > 10", "COMMIT", _ALL), "SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey <= 10"),
    "param_binding": (_script(_CREATE, _ORDERS, "SELECT k, status FROM t WHERE k < $1 AND status = $2", params={2: [500, "F"]}), "SELECT o_orderkey AS k, o_orderstatus AS status FROM orders WHERE o_orderkey < 500 AND o_orderstatus = 'F'"),
}


def _user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    engine = engine_on(spark, sf_dir)
    engine.register_function("initial", lambda c: F.substring(c, 1, 1), "string")
    return engine.sql("SELECT n_nationkey, initial(n_name) AS i FROM nation")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _select(text) for name, (text, _) in SELECTS.items()} | {name: go for name, (go, _) in SCRIPTS.items()} | {"user_function": _user_function}


def oracle_sql() -> dict[str, str]:
    out = {name: other or text for name, (text, other) in SELECTS.items()} | {name: sql for name, (_, sql) in SCRIPTS.items()}
    return out | {"user_function": "SELECT n_nationkey, substr(n_name, 1, 1) AS i FROM nation"}
