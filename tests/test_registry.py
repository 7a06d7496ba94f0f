import os

import pytest

import __spark_entry__
from tests import oracle
from vellumix import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the input tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.same(registry.queries()[name](spark, FOLDER), con, registry.oracle_sql()[name]) > 0


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(registry.oracle_sql()) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "n_chunks", "translated_chars"] and df.count() == 200


def test_formulas_come_back(spark):
    rows = registry.queries()["q_math_restore"](spark, FOLDER)
    assert rows.where("size(missing) > 0 OR size(unexpected) > 0 OR protected = restored AND doc_id % 6 = 1").isEmpty()


def test_spans_hold_the_text(spark):
    from pyspark.sql import functions as F

    text = registry.queries()["q_spans"](spark, FOLDER).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_index", "text"))), lambda s: s["text"]), "").alias("got"))
    from vellumix.functions import text as T
    from vellumix.plans import views

    source = views.frame(spark, FOLDER, "math_docs").select("doc_id", T.column(T.normalized, "text").alias("want"))
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    assert source.join(text, "doc_id").where(bare("got") != bare("want")).isEmpty()
    assert text.count() == source.count()
