"""Line dedup by distinct-site spread, in DataFrame functions only.

A line's key is the hash of the line without white space at its ends; blank lines have none. Keys seen on one site only leave
after a plain minimum and maximum of sites, which Spark combines before the shuffle. The others get a HyperLogLog sketch of
their sites, merged by aggregation, so no group of rows is ever gathered, whatever its size. Where the estimate is near the
threshold, an exact distinct count decides. A line on `min_sites` sites or more is boilerplate: it stays in the document with
the smallest id that has it and goes from every other.

Null text stays null and has no lines; empty texts have none either. A null site counts as one site of its own. Rows with the
same id count as one document. A row without an id keeps all its lines, which still count for the spread. A text that loses all
its lines becomes empty; the row stays. An empty table gives an empty one. Other columns pass through, whatever their names. Lines
are told apart by a hash of 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import discard, free_name, written

MIN_SITES = 10
#: Estimates within this share of the threshold are counted exactly; 12 index bits have a standard error of 1.6 %.
NEAR, INDEX_BITS = 0.25, 12
WHITE = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(WHITE)))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(id, gone array<long>): of each document that loses lines, their keys."""
    line = F.explode(F.filter(_lines(F.col(text_col)), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit("\0none"))).alias("site"), line.alias("line"))
    lines = written(lines.select("id", "site", _key(F.col("line")).alias("key")), "lines")
    some = lines.groupBy("key").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.min("id").alias("first")).where("lo < hi" if min_sites > 1 else "true")
    some = written(some.select("key", "first"), "spread")
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(INDEX_BITS)))
    sites = lines.join(some, "key", "left_semi").groupBy("key").agg(sketch.alias("sites"))
    sites = written(sites.where(F.col("sites") >= min_sites * (1 - NEAR)), "sites")
    sure, near = sites.where(F.col("sites") > min_sites * (1 + NEAR)), sites.where(F.col("sites") <= min_sites * (1 + NEAR))
    exact = lines.join(near, "key", "left_semi").groupBy("key").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    spread = written(sure.select("key").unionByName(exact.select("key")).join(some, "key"), "boilerplate")
    discard(some, sites)
    return lines.join(spread, "key").where("id != first").groupBy("id").agg(F.collect_set("key").alias("gone")).withColumnRenamed("id", id_col)


def drop_spread_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", chars_col: str | None = "n_chars", counts: bool = False
) -> DataFrame:
    """All rows and columns, with text (and chars_col, if there) after the removal; counts adds n_lines and n_removed."""
    gone, n_gone, before = (free_name(docs, x) for x in ("gone", "n_removed", "n_lines"))
    keys = spread_lines(docs, min_sites, id_col, text_col, site_col).withColumnRenamed("gone", gone)
    out = docs.join(keys, id_col, "left").select(*[docs[c] if c != id_col else F.col(id_col) for c in docs.columns], gone)
    left = F.filter(_lines(F.col(text_col)), lambda x: ~F.array_contains(gone, _key(x)) | (F.btrim(x, F.lit(WHITE)) == ""))
    new = F.when(F.col(gone).isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    made = {text_col: new}
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        made[chars_col] = F.when(F.col(gone).isNull() | F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(new).cast(kind))
    if counts:
        made[before] = F.coalesce(F.size(F.filter(_lines(F.col(text_col)), lambda x: F.btrim(x, F.lit(WHITE)) != "")), F.lit(0)).cast("long")
        made[n_gone] = F.when(F.col(gone).isNull() | F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(_lines(F.col(text_col))) - F.size(left)).cast("long")
    return out.withColumns(made).drop(gone)


#: The same in DuckDB, with exact counts throughout.
ORACLE = f"""
with l as (
    select doc_id, coalesce(source, chr(0) || 'none') as site, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line
    from documents where text is not null
), k as (select *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as key from l),
spread as (select key, min(doc_id) as first from k where key <> '' group by key having count(distinct site) >= {MIN_SITES}),
marked as (select k.*, spread.key is not null and k.doc_id <> spread.first as gone from k left join spread using (key))
select d.doc_id,
    case when d.text is null then null else coalesce(string_agg(m.line, chr(10) order by m.pos) filter (where not m.gone), '') end as text,
    count(*) filter (where m.key <> '') as n_lines,
    count(*) filter (where m.gone) as n_removed
from documents d left join marked m using (doc_id) group by d.doc_id, d.text
"""
