"""Lexer, parser and semantics that queries alone do not pin down."""

import pytest

from lumenq import ConflictError, Engine, ExecuteError, LexError, ParseError, TypeMismatch
from lumenq.lang import ast as A
from lumenq.lang.lexer import tokenize
from lumenq.lang.parser import parse


def where(sql):
    return parse(f"SELECT 1 FROM t WHERE {sql}")[0].where


def test_tokens():
    assert [(t.kind, t.value) for t in tokenize("a 1 1.5 'it''s' \"B c\" `d` $2 -- x\n<= /* y */ !=")][:-1] == [("word", "a"), ("int", 1), ("float", 1.5), ("text", "it's"), ("quoted", "B c"), ("quoted", "d"), ("param", 2), ("op", "<="), ("op", "!=")]
    with pytest.raises(LexError):
        tokenize("'open")


def test_precedence():
    assert where("a = 1 AND b = 2 AND c = 3") == where("(a = 1 AND b = 2) AND c = 3")
    assert where("a - b - c - d = 0") == where("((a - b) - c) - d = 0")
    assert where("a * b + c = d") == where("((a * b) + c) = d")
    assert where("a = 1 OR b = 2 AND NOT c = 3") == where("a = 1 OR (b = 2 AND (NOT (c = 3)))")
    assert where("a BETWEEN 1 AND 2 AND b") == where("(a BETWEEN 1 AND 2) AND b")
    assert where("a = -1") == A.Binary("=", A.ColumnRef("a"), A.Literal(-1))


@pytest.mark.parametrize("sql", ["SELECT", "SELECT a b c", "FOO", "SELECT 1 FROM t HAVING 1", "SELECT 1 FROM t LEFT JOIN u", "INSERT INTO t (a, b) VALUES (1)", "SELECT 1 LIMIT -1", "CREATE INDEX i ON t (a, b)", "SELECT a FROM t GROUP BY a + 1"])
def test_refused(sql):
    with pytest.raises(ParseError):
        parse(sql)


def one(engine, sql, *params):
    return engine.sql(sql, params).first()[0]


def test_arithmetic(engine):
    assert one(engine, "SELECT 7 / 2") == 3 and one(engine, "SELECT -7 / 2") == -3
    assert one(engine, "SELECT 1.0 / 0.0") == float("inf") and str(one(engine, "SELECT 0.0 / 0.0")) == "nan"
    assert one(engine, "SELECT 2.5 - 1.0") == 1.5 and one(engine, "SELECT 'a' + 'b'") == "ab"
    for sql in ("SELECT 9223372036854775807 + 1", "SELECT 1 / 0", "SELECT (-9223372036854775808) - 1"):
        with pytest.raises(Exception, match="OVERFLOW|DIVIDE_BY_ZERO"):
            engine.sql(sql).collect()
    for sql in ("SELECT 1 + 'a'", "SELECT NOT 1", "SELECT 1 WHERE 1", "SELECT TRUE AND 1"):
        with pytest.raises(TypeMismatch):
            engine.sql(sql)


def test_nulls(engine):
    assert engine.sql("SELECT NULL = NULL AS a, NOT NULL AS b, NULL AND FALSE AS c, 1 IN (NULL, 1) AS d, NULL IS NULL AS e").first()[:] == (None, None, False, True, True)


def test_strict_types(spark):
    assert Engine(spark).sql("SELECT 1 + 1.5").first()[0] == 2.5
    with pytest.raises(TypeMismatch):
        Engine(spark, strict_types=True).sql("SELECT 1 + 1.5")


def test_names(engine):
    engine.sql("CREATE TABLE t (a INT, b INT)")
    for sql in ("SELECT c FROM t", "SELECT a FROM t AS x JOIN t AS y", "SELECT b FROM t GROUP BY a", "SELECT * FROM u", "SELECT sum(sum(a)) FROM t", "SELECT f(a) FROM t"):
        with pytest.raises(ExecuteError):
            engine.sql(sql)
    with pytest.raises(ExecuteError):
        engine.sql('CREATE TABLE "../x" (a INT)')


def test_describe_runs_nothing(engine):
    engine.sql("CREATE TABLE t (a INT, b VARCHAR(3))")
    assert [(f.name, f.dataType.simpleString()) for f in engine.schema("SELECT a + 1, b AS x, count(1) FROM t GROUP BY ALL")] == [("?column?", "bigint"), ("x", "string"), ("?column?", "bigint")]


def test_constraints(engine):
    engine.sql("CREATE TABLE t (id INTEGER PRIMARY KEY, score INTEGER)")
    assert engine.sql("INSERT INTO t (id, score) VALUES (1, 10), (2, 20), (3, 20)").tag == "INSERT 0 3"
    for sql in ("INSERT INTO t (id) VALUES (1)", "INSERT INTO t (id) VALUES (7), (7)", "INSERT INTO t (score) VALUES (1)", "INSERT INTO t (id) VALUES (NULL)", "INSERT INTO t (id) VALUES ('x')", "INSERT INTO t (id, nope) VALUES (8, 1)", "UPDATE t SET id = 1", "UPDATE t SET id = NULL WHERE id = 1", "CREATE UNIQUE INDEX i ON t (score)"):
        with pytest.raises((ExecuteError, TypeMismatch)):
            engine.sql(sql)
    assert engine.sql("UPDATE t SET score = score + id WHERE id > 1").affected_rows == 2
    assert engine.sql("DELETE FROM t WHERE score > 22").affected_rows == 1
    assert sorted(map(tuple, engine.sql("SELECT * FROM t").collect())) == [(1, 10), (2, 22)]


def test_lookup_is_pushed_down(engine):
    engine.sql("CREATE TABLE stock (item INTEGER PRIMARY KEY, place VARCHAR(20))")
    engine.sql("INSERT INTO stock (item, place) VALUES " + ", ".join(f"({7 * i + 3}, 'shelf {i % 11}')" for i in range(250)))
    engine.cluster("stock", "item")
    found = engine.sql("SELECT place FROM stock WHERE item >= 700 AND item < 730")
    assert found.count() == sum(700 <= 7 * i + 3 < 730 for i in range(250))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c1,700)" in plan and "LessThan(c1,730)" in plan
    assert one(engine, "SELECT place FROM stock WHERE item = $1", 87) == "shelf 1"


def test_schema_changes_nothing(engine):
    engine.sql("CREATE TABLE t (a INT)")
    engine.sql("INSERT INTO t (a) VALUES (1), (2)")
    for text in ("DELETE FROM t", "UPDATE t SET a = 3", "INSERT INTO t (a) VALUES (4)", "DROP TABLE t", "BEGIN TRANSACTION", "CREATE DATABASE d"):
        with pytest.raises(ExecuteError):
            engine.schema(text)
    assert sorted(r.a for r in engine.sql("SELECT * FROM t").collect()) == [1, 2] and not engine.in_transaction
    assert [f.name for f in engine.schema("SELECT a + 1 AS b FROM t")] == ["b"]


def test_only_files_with_changed_rows_are_written(engine):
    engine.sql("CREATE TABLE t (a INT, b INT)")
    for i in range(3):
        engine.sql(f"INSERT INTO t (a, b) VALUES ({i}, 0), ({i + 10}, 0)")
    before = engine.table(A.TableName("t"))[1].data
    assert engine.sql("UPDATE t SET b = b + 5 WHERE a = 11").affected_rows == 1
    after = engine.table(A.TableName("t"))[1].data
    assert {before[0], before[2]} <= set(after) and before[1] not in after
    assert engine.sql("DELETE FROM t AS x WHERE x.a = 2").affected_rows == 1
    assert engine.sql("DELETE FROM t WHERE a = 99").affected_rows == 0
    assert before[0] in engine.table(A.TableName("t"))[1].data
    assert sorted(map(tuple, engine.sql("SELECT * FROM t").collect())) == [(0, 0), (1, 0), (10, 0), (11, 5), (12, 0)]
    assert engine.sql("DELETE FROM t WHERE a < 2").affected_rows == 2 and engine.sql("SELECT * FROM t").count() == 3


def test_transactions_over_tables_made_anew(spark, tmp_path):
    mine, other = (Engine(spark, f"file://{tmp_path}/w") for _ in range(2))
    mine.sql("CREATE TABLE t (a INT)")
    mine.sql("INSERT INTO t (a) VALUES (1)")
    for s in ("BEGIN TRANSACTION", "DROP TABLE t", "CREATE TABLE t (b INT)", "INSERT INTO t (b) VALUES (7)"):
        mine.sql(s)
    with pytest.raises(ExecuteError):
        mine.sql("CREATE DATABASE d")
    assert [r.a for r in other.sql("SELECT * FROM t").collect()] == [1]
    mine.sql("COMMIT")
    assert [r.b for r in other.sql("SELECT * FROM t").collect()] == [7]
    mine.sql("BEGIN TRANSACTION")
    mine.sql("DROP TABLE t")
    other.sql("INSERT INTO t (b) VALUES (8)")
    with pytest.raises(ConflictError):
        mine.sql("COMMIT")


def test_transactions_and_conflicts(spark, tmp_path):
    mine, other = (Engine(spark, f"file://{tmp_path}/w") for _ in range(2))
    mine.sql("CREATE TABLE t (a INT)")
    mine.sql("BEGIN TRANSACTION")
    mine.sql("INSERT INTO t (a) VALUES (1)")
    assert mine.sql("SELECT * FROM t").count() == 1 and other.sql("SELECT * FROM t").count() == 0
    other.sql("INSERT INTO t (a) VALUES (2)")
    with pytest.raises(ConflictError):
        mine.sql("COMMIT")
    assert [r.a for r in mine.sql("SELECT * FROM t").collect()] == [2]


def test_leftovers_are_ignored(engine):
    engine.sql("CREATE TABLE t (a INT)")
    path, meta = engine.table(A.TableName("t"))
    engine.store.write(path, meta, engine.spark.createDataFrame([(9,)], "a long"))  # a crash before the commit
    assert engine.sql("SELECT * FROM t").count() == 0


def test_stream(spark, tmp_path):
    from lumenq.streaming.sink import append_stream

    engine = Engine(spark, f"file://{tmp_path}/w")
    engine.sql("CREATE TABLE t (a INT)")
    spark.range(5).selectExpr("id AS a").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        append_stream(engine, spark.readStream.schema("a long").parquet(f"{tmp_path}/in"), "t", f"file://{tmp_path}/c", available_now=True).awaitTermination()
    assert sorted(r.a for r in engine.sql("SELECT * FROM t").collect()) == list(range(5))


def test_a_batch_that_comes_again_is_left_out(spark, tmp_path, monkeypatch):
    """The batch is in the table's version itself, so a crash right after the commit does no harm."""
    import shutil

    from lumenq.streaming.sink import append_stream

    engine = Engine(spark, f"file://{tmp_path}/w")
    engine.sql("CREATE TABLE t (a INT)")
    spark.range(5).selectExpr("id AS a").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        append_stream(engine, spark.readStream.schema("a long").parquet(f"{tmp_path}/in"), "t", f"file://{tmp_path}/c", available_now=True).awaitTermination()
        shutil.rmtree(f"{tmp_path}/c/state/commits")
    assert sorted(r.a for r in engine.sql("SELECT * FROM t").collect()) == list(range(5))
