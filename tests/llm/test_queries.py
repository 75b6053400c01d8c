"""The queries with SQL against it on the smallest tables, and the invariants of those without, where the tables are there."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.llm import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, db, name):
    got, want = registry.queries()[name](spark, FOLDER).toPandas(), db.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda d: sorted(map(tuple, d[sorted(d.columns)].values.tolist()))
    assert key(got) == key(want) and len(got)


def test_equal_forms_are_equal_looks(spark):
    """p1_found's pairs are those of p1_forms whose forms are equal and whose texts are not."""
    pairs = registry.queries()["p1_found"](spark, FOLDER)
    forms = registry.queries()["p1_forms"](spark, FOLDER)
    side = lambda p: forms.select("tbl", F.col("id").alias(f"id_{p}"), F.col("text").alias(f"text_{p}"))
    joined = pairs.join(side("a"), ["tbl", "id_a"]).join(side("b"), ["tbl", "id_b"])
    assert joined.where("text_a = text_b").count() == pairs.count() > 0


def test_segments_are_numbered(spark):
    found = registry.queries()["p2_labels"](spark, FOLDER)
    per = found.groupBy("tbl", "rec_id").agg(F.count("*").alias("n"), F.max("seg_no").alias("last"))
    assert per.where("n <> last").count() == 0 and found.where("confidence < 0.5 or confidence > 1").count() == 0


def test_containers_hold_all_tokens(spark):
    packed = registry.queries()["p7_packed"](spark, FOLDER)
    boxes = packed.groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.max("filled").alias("filled"))
    assert boxes.where("tokens <> filled or tokens > 2048").count() == 0
    total, n = boxes.agg(F.sum("tokens"), F.count("*")).first()
    assert n <= -(-total // 2048) * 1.02 + 1


def test_no_document_is_used_too_often(spark):
    limits = spark.read.parquet(f"{FOLDER}/mix_targets.parquet").select("source", "max_repeat")
    for name in ("p8_selection", "p8_whole"):
        chosen = registry.queries()[name](spark, FOLDER)
        assert chosen.join(limits, "source", "left").where("max_repeat is null or copies > max_repeat or copies < 1").count() == 0 and chosen.count() > 0
    shares = registry.queries()["p8_whole_shares"](spark, FOLDER)
    assert shares.count() == limits.count() and shares.agg(F.max("most_copies")).first()[0] > 1
    assert abs(shares.agg(F.sum("share")).first()[0] - 1) < 1e-6


def test_pieces_are_within_the_limit(spark):
    pieces = registry.queries()["p9_pieces"](spark, FOLDER)
    assert pieces.where("n_tokens > 512 or start_char > new_from").count() == 0 and pieces.count() > 0
