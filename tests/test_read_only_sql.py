import pytest

from paypulse.plans.read_only_sql import check_read_only, read_only_sql
from paypulse.plans.views import VIEWS, register_views

from tests.conftest import at, rows_of


@pytest.mark.parametrize("query, message", [
    (None, "SQL is empty."), ("  ;; ", "SQL is empty."), ("", "SQL is empty."),
    ("show tables", "Only SELECT queries are allowed."),
    ("delete from t", "Only SELECT queries are allowed."),
    ("select replace(a, 'x', 'y') from t", "Query contains disallowed keywords."),
    ("select 'update'", "Query contains disallowed keywords."),
    ("with a as (select 1) insert into t select * from a", "Query contains disallowed keywords."),
    ("select 1; Drop table t", "Query contains disallowed keywords."),
    ("select java_method('java.lang.System', 'exit', 1)", "Query contains disallowed keywords."),
    ("select reflect('java.util.UUID', 'randomUUID')", "Query contains disallowed keywords."),
])
def test_refused(query, message):
    with pytest.raises(ValueError, match=message):
        check_read_only(query)


@pytest.mark.parametrize("query", [
    "SELECT updated_at, get_json FROM t", " with x as (select 1) select * from x ; ",
    "select 'created'",
])
def test_allowed(query):
    assert check_read_only(query) == query.strip(" ;")


def test_cap_holds_whatever_the_query_says(spark):
    spark.range(100).createOrReplaceTempView("hundred")
    views = ["Hundred"]
    assert read_only_sql(spark, "select * from hundred", views=views).count() == 50
    assert read_only_sql(spark, "select * from hundred\nLIMIT 90", 10, views).count() == 10
    assert read_only_sql(spark, "select ' limit ' as a, id from hundred", 7, views).count() == 7
    assert read_only_sql(spark, "select * from HUNDRED limit 3;", views=views).count() == 3


@pytest.mark.parametrize("query", [
    "select 1; select 2",
    "select * from parquet.`/root/testdata/sf0.001/events.parquet`",
    "select transform(id) using 'cat' as (x string) from hundred",
    "with a as (from hundred map id using 'cat' as x) select * from a",
    "select * from (from hundred reduce id using 'cat' as x)",
    "select id from hundred where id in (select transform(id) using 'cat' as (x string) from hundred)",
    "select (select max(x) from (select transform(id) using 'cat' as (x int) from hundred))",
    "select * from secret", "select * from default.hundred", "select 1 where exists (select * from secret)",
    "with secret2 as (select 1) select * from (with x as (select * from secret) select * from x)",
    "select * from (with inner_name as (select 1) select 1) join inner_name",
    "with a as (select * from b), b as (select 1) select * from a",
    "select * from hundred, lateral (select * from secret)", "select * from range(5)",
    "select id from hundred union all select id from secret", "select * from hundred order by (select max(id) from secret)",
])
def test_refused_before_anything_runs(spark, query):
    spark.range(3).createOrReplaceTempView("secret")
    spark.range(100).createOrReplaceTempView("hundred")
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.runSQLOnFiles")
    with pytest.raises(Exception):
        read_only_sql(spark, query, views=["hundred"])
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.runSQLOnFiles"))


@pytest.mark.parametrize("query, rows", [
    ("select transform(array(1, 2), x -> x + 1) as a", 1),
    ("with h as (select id from hundred where id < 9), g as (select * from h) select count(*) from g join h using (id)", 1),
    ("select id from hundred where id in (select max(id) from hundred) or exists (select 1 from hundred where id < 0)", 1),
    ("select id % 3 as k, count(*) as n, max(n2) over (order by id % 3) from (select id, id as n2 from hundred) group by id % 3, n2 having n > 5", 0),
    ("select distinct id % 4 as k from hundred union select 9 order by k desc limit 3", 3),
    ("select * from values (1), (2) as t(a)", 2), ("select explode(array(1, 2, 3)) as x", 3),
    ("select x from hundred lateral view explode(array(id)) e as x where id < 2", 2),
    ("select * from (select id % 2 as p, id from hundred) pivot (count(id) for p in (0, 1))", 1),
    ("select (select max(id) from hundred) as top, h.* from hundred as h(i) where i = 3", 1),
])
def test_queries_over_the_views(spark, query, rows):
    spark.range(100).createOrReplaceTempView("hundred")
    assert read_only_sql(spark, query, views=["hundred"]).count() == rows


def test_views(spark, orders, payments):
    names = register_views(
        orders=orders([("a", "10:00")]), payments=payments([("1", "a", "PAID", 2.0, "10:01")])
    )
    assert set(names) == {
        "curated_orders", "curated_payments", "v_revenue_per_minute", "v_payment_failure_rate",
        "v_order_conversion",
    }
    assert set(names) <= set(VIEWS)
    assert rows_of(read_only_sql(spark, "select * from v_order_conversion")) == [(at("10:00"), 1, 1, 100.0)]
    assert rows_of(read_only_sql(spark, "select * from v_revenue_per_minute")) == [(at("10:01"), 2.0)]
