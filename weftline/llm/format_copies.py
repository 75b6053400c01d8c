"""Problem 6: duplicates hidden by formatting differences.

Every record is reduced to a canonical digest (blanks, letter case and punctuation disregarded, the
two texts in either order). One pass finds, in every partition, the positions of a Bloom filter that the
partition's digests set once and those set repeatedly; the partial filters are merged block by
block (a position is repeated if any part repeats it or two parts set it) and grow with the records. What
is broadcast is a filter of the repeated positions, of bounded size: one, or one for each range of digests
where there are too many. Only records that pass it, i.e. all true copies and a small share of the
others, are shuffled for exact grouping on the 128-bit digest; all others are singletons by proof.

Defined cases: a record of which a text is null, blank or `nan` is no record and never comes out; a
text of punctuation only compares as empty but is a text; payloads that cannot be read are no
records; rows repeated under one id count as copies with that id, and give no (keep, dup) row;
empty tables give empty results; columns other than those named are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bloom
from weftline.llm.common import has_text, join_groups, stored, table

def canonical(text: F.Column) -> F.Column:
    """Lower case without blanks and punctuation; vowel marks, digits and symbols stay."""
    return F.regexp_replace(F.lower(text), rf"[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}\p{{P}}]+", "")


def read_serialised(lines: DataFrame) -> DataFrame:
    """raw_lines -> (line_id, s, t). Null, empty or cut-off payloads are dropped.

    A payload is JSON where head_line is null, with the keys in any order, and else tab-separated in
    the order of head_line; it is cut off if the JSON does not parse or the number of fields differs.
    """
    parsed = F.from_json("payload", "s string, t string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    head, cells = F.split("head_line", "\t"), F.split("payload", "\t")
    cell = lambda name: F.element_at(F.map_from_arrays(head, cells), name)
    whole = F.coalesce((F.size(head) == F.size(cells)) & (F.size(F.array_distinct(head)) == F.size(head)), F.lit(False))
    json = lines.where(F.col("head_line").isNull() & F.col("payload").isNotNull()).select("line_id", parsed.alias("p"))
    json = json.where(F.col("p").isNotNull() & F.col("p._bad").isNull()).select("line_id", "p.s", "p.t")
    tsv = lines.where(F.col("head_line").isNotNull() & F.col("payload").isNotNull() & whole)
    return json.unionByName(tsv.select("line_id", F.when(whole, cell("src")).alias("s"), F.when(whole, cell("tgt")).alias("t")))


def keyed(records: DataFrame) -> DataFrame:
    """(tbl, id, s, t) -> (tbl, id, h, digest): one row for every record with two texts."""
    a, b = canonical(F.col("s")), canonical(F.col("t"))
    both = F.concat_ws("\u0000", F.col("tbl"), F.least("a", "b"), F.greatest("a", "b"))
    kept = records.where(has_text("s") & has_text("t")).select("tbl", "id", a.alias("a"), b.alias("b"))
    return kept.select("tbl", "id", both.alias("k")).select("tbl", "id", F.xxhash64("k").alias("h"), F.unhex(F.md5("k")).alias("digest"))


def flagged(keys: DataFrame, one: bloom.Filter) -> DataFrame:
    """The rows of keys in the filter's range of hashes, with the column again: may there be a copy?"""
    shared = keys.sparkSession.sparkContext.broadcast(one)

    @F.arrow_udf("boolean")
    def repeated(h: pa.Array) -> pa.Array:
        return pa.array(shared.value.passes(h.to_numpy(zero_copy_only=False)))

    block = F.shiftrightunsigned("h", 64 - one.width) if one.width else F.lit(0)
    return keys.where((block >= one.first) & (block <= one.last)).select("tbl", "id", "digest", repeated("h").alias("again"))


def split_repeats(records: DataFrame, max_bits: int = bloom.MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """(tbl, id, s, t) -> possible repeats (tbl, id, digest) and sure singletons (tbl, id)."""
    keys = stored(keyed(records))
    again, alone = None, None
    for one in bloom.fit(keys.select("h"), max_bits, repeated=True):
        rows = flagged(keys, one)
        maybe, sure = rows.where("again").select("tbl", "id", "digest"), rows.where("not again").select("tbl", "id")
        again, alone = (maybe, sure) if again is None else (again.unionByName(maybe), alone.unionByName(sure))
    return stored(again), alone


def repeats(again: DataFrame) -> DataFrame:
    """(tbl, id, digest) -> (tbl, id, keep_id, copies), exact groups."""
    groups = stored(again.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")))
    return join_groups(again, groups, ["digest"], "copies").select("tbl", "id", "keep_id", "copies")


def copies(records: DataFrame, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """(tbl, id, s, t) -> (tbl, id, keep_id, copies): for each record its kept record and group size.

    Singletons keep themselves and have 1 copy. max_bits bounds each filter that is broadcast; the result and
    the share of records that are shuffled do not depend on it.
    """
    again, alone = split_repeats(records, max_bits)
    single = alone.select("tbl", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    return repeats(again).unionByName(single)


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "pool_pairs").select(F.lit("pool_pairs").alias("tbl"), F.col("row_id").alias("id"), "s", "t")
    lines = read_serialised(table(spark, sf_dir, "raw_lines").select("line_id", "head_line", "payload"))
    return pool.unionByName(lines.select(F.lit("raw_lines").alias("tbl"), F.col("line_id").alias("id"), "s", "t"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(split_repeats(all_records(spark, sf_dir))[0]).where("id <> keep_id")
    return found.select("tbl", "keep_id", F.col("id").alias("dup_id"))


def p6_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each group with the number of copies it had, counted over all records."""
    return copies(all_records(spark, sf_dir)).where("id = keep_id").select("tbl", "keep_id", "copies")


_CUT = r"regexp_replace(lower({}), '[\t-\r\x{{1c}}-\x{{20}}\x{{85}}\p{{Z}}\p{{P}}]+', '', 'g')"
_OK = r"{0} IS NOT NULL AND lower(regexp_replace({0}, '[\t-\r\x{{1c}}-\x{{20}}\x{{85}}\p{{Z}}]+', '', 'g')) NOT IN ('', 'nan')"
_FIELD = "string_split(payload, chr(9))[list_position(string_split(head_line, chr(9)), '{}')]"
_JSON = "CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.{}') END"
_GROUPS = f"""WITH r AS (SELECT 'pool_pairs' AS tbl, row_id AS id, s, t FROM pool_pairs
    UNION ALL SELECT 'raw_lines', line_id, {_JSON.format("s")}, {_JSON.format("t")} FROM raw_lines WHERE head_line IS NULL
    UNION ALL SELECT 'raw_lines', line_id, {_FIELD.format("src")}, {_FIELD.format("tgt")} FROM raw_lines WHERE head_line IS NOT NULL AND len(string_split(head_line, chr(9))) = len(string_split(payload, chr(9)))),
k AS (SELECT tbl, id, {_CUT.format("s")} AS a, {_CUT.format("t")} AS b FROM r WHERE {_OK.format("s")} AND {_OK.format("t")}),
g AS (SELECT tbl, id, min(id) OVER w AS keep_id, count(*) OVER w AS copies FROM k WINDOW w AS (PARTITION BY tbl, least(a, b), greatest(a, b)))"""
SQL = {
    "p6_found": f"{_GROUPS} SELECT tbl, keep_id, id AS dup_id FROM g WHERE id <> keep_id",
    "p6_copies": f"{_GROUPS} SELECT tbl, keep_id, copies FROM g WHERE id = keep_id",
}
QUERIES = {"p6_found": p6_found, "p6_copies": p6_copies}
