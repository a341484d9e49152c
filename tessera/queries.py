"""Queries over the test tables, one or more for each operator, and the same in DuckDB's SQL.

Where a result is random by construction but not expressible in SQL, the query
returns invariants (counts of violations) instead, which SQL states as literals.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tessera as ts
from tessera.functions.kinds import finite_double
from tessera.operators.names import library
from tessera.operators.profile import frequencies, histograms, is_stratifiable, profile, top_values

SEED = 42
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) and its SQL."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def md5_sql(salt: str, *key: str, seed: int = SEED) -> str:
    parts = ", ".join(f"coalesce({k}::varchar, '\\N')" for k in key)
    return f"md5(concat_ws('|', '{seed}', '{salt}', {parts}))"


def uniform_sql(salt: str, *key: str, seed: int = SEED) -> str:
    return f"(('0x' || substr({md5_sql(salt, *key, seed=seed)}, 1, 8))::bigint / 4294967296.0)"


def alloc_sql(source: str, strata: list[str], n: int) -> str:
    """CTEs ending in alloc(strata..., size, alloc)."""
    s = ", ".join(strata)
    order = ", ".join(f"{c} asc nulls last" for c in strata)
    return f"""sizes as (select {s}, count(*)::bigint as size from {source} group by {s}),
quota as (select *, (size * {n}) // (sum(size) over ())::bigint as q, (size * {n}) % (sum(size) over ())::bigint as r from sizes),
alloc as (select {s}, size, (q + case when row_number() over (order by r desc, {order}) <= {n} - sum(q) over () then 1 else 0 end)::bigint as alloc from quota)"""


def stratified_sql(source: str, strata: list[str], n: int, key: list[str], columns: str = "t.*", before: str = "") -> str:
    match = " and ".join(f"t.{c} is not distinct from a.{c}" for c in strata)
    k, s = ", ".join(key), ", ".join(strata)
    return f"""with {before}{alloc_sql(source, strata, n)},
ranked as (select *, row_number() over (partition by {s} order by {md5_sql('stratified', *key)}, {k}) as rn from {source})
select {columns} from ranked t join alloc a on {match} where rn <= a.alloc"""


LINE_COLUMNS = "t.l_orderkey, t.l_partkey, t.l_suppkey, t.l_linenumber, t.l_quantity, t.l_extendedprice, t.l_discount, t.l_tax, t.l_returnflag, t.l_linestatus, t.l_shipdate"


# Strata, allocation, samples


@query("select l_returnflag, l_linestatus, l_linenumber, count(*)::bigint as size from lineitem group by all")
def stratum_sizes_lineitem(spark, d):
    return ts.stratum_sizes(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(f"with {alloc_sql('lineitem', ['l_returnflag', 'l_linestatus'], 1000)} select * from alloc")
def allocation_lineitem(spark, d):
    strata = ["l_returnflag", "l_linestatus"]
    return ts.allocate(ts.stratum_sizes(read(spark, d, "lineitem"), strata), strata, 1000)


@query(f"with e as (select event_id % 10 as g from events), {alloc_sql('e', ['g'], 105)} select * from alloc")
def allocation_ties(spark, d):
    return ts.allocate(ts.stratum_sizes(read(spark, d, "events").select((F.col("event_id") % 10).alias("g")), ["g"]), ["g"], 105)


NULL_ORDERS = "o as (select o_orderkey, o_orderstatus, case when o_orderkey % 10 = 0 then null else o_orderpriority end as p from orders), "


def _null_orders(spark, d) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")).alias("p"))


@query(f"with {NULL_ORDERS}{alloc_sql('o', ['o_orderstatus', 'p'], 501)} select * from alloc")
def allocation_null_stratum(spark, d):
    return ts.allocate(ts.stratum_sizes(_null_orders(spark, d), ["o_orderstatus", "p"]), ["o_orderstatus", "p"], 501)


@query(stratified_sql("lineitem", ["l_returnflag", "l_linestatus"], 1000, LINE_KEY, LINE_COLUMNS))
def stratified_sample_lineitem(spark, d):
    return ts.stratified_sample(read(spark, d, "lineitem"), 1000, ["l_returnflag", "l_linestatus"], seed=SEED, key=LINE_KEY)[0]


@query(stratified_sql("orders", ["o_orderpriority"], 500, ["o_orderkey"], "t.o_orderkey, t.o_custkey, t.o_orderstatus, t.o_totalprice, t.o_orderdate, t.o_orderpriority"))
def stratified_sample_orders(spark, d):
    return ts.stratified_sample(read(spark, d, "orders"), 500, ["o_orderpriority"], seed=SEED, key=["o_orderkey"])[0]


@query(stratified_sql("o", ["o_orderstatus", "p"], 501, ["o_orderkey"], "t.o_orderkey, t.o_orderstatus, t.p", NULL_ORDERS))
def stratified_null_stratum(spark, d):
    return ts.stratified_sample(_null_orders(spark, d), 501, ["o_orderstatus", "p"], seed=SEED, key=["o_orderkey"])[0]


@query(stratified_sql("documents", ["lang", "source"], 150, ["doc_id"], "t.doc_id, t.lang, t.source"))
def stratified_sample_documents(spark, d):
    return ts.stratified_sample(read(spark, d, "documents"), 150, ["lang", "source"], seed=SEED, key=["doc_id"])[0].select("doc_id", "lang", "source")


@query(stratified_sql("part", ["p_type", "p_brand"], 500, ["p_partkey"], "t.p_partkey, t.p_name, t.p_brand, t.p_type, t.p_size, t.p_retailprice"))
def narrow_sample_part(spark, d):
    return ts.stratified_sample(read(spark, d, "part"), 500, ["p_type", "p_brand"], seed=SEED, key=["p_partkey"], narrow=True)[0]


@query(f"select * from events order by {md5_sql('random', 'event_id')}, event_id limit 500")
def random_sample_events(spark, d):
    return ts.random_sample(read(spark, d, "events"), 500, seed=SEED, key=["event_id"])


@query(f"select * from lineitem order by {md5_sql('random', *LINE_KEY)}, {', '.join(LINE_KEY)} limit 1000")
def random_sample_lineitem(spark, d):
    return ts.random_sample(read(spark, d, "lineitem"), 1000, seed=SEED, key=LINE_KEY)


@query("select * from nation")
def sample_all_when_n_exceeds(spark, d):
    return ts.sample(read(spark, d, "nation"), 100, seed=SEED).data


@query(stratified_sql("orders", ["o_orderstatus", "o_orderpriority"], 500, ["o_orderkey"], "t.o_orderkey, t.o_orderstatus, t.o_orderpriority"))
def auto_sample_orders(spark, d):
    return ts.sample(read(spark, d, "orders"), 500, seed=SEED, key=["o_orderkey"]).data.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(f"select s_suppkey, s_name from supplier order by {md5_sql('random', 's_suppkey')}, s_suppkey limit 5")
def sample_fallback_supplier(spark, d):
    """No column of suppliers makes strata, so the sample is random."""
    return ts.sample(read(spark, d, "supplier").select("s_suppkey", "s_name"), 5, seed=SEED, key=["s_suppkey"]).data


@query("select 0::bigint as extra, 0::bigint as differing, 1200::bigint as n")
def sample_by_file_identity(spark, d):
    """Rows known by file and row number: no duplicates, and the same rows under another partitioning."""
    a = ts.sample(read(spark, d, "orders"), 1200, seed=7).data.select("o_orderkey")
    spark_files = read(spark, d, "orders")
    b = ts.sample(spark_files, 1200, seed=7, strat_cols=["o_orderstatus", "o_orderpriority"]).data.select("o_orderkey")
    return a.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("o_orderkey")).alias("extra")).crossJoin(a.exceptAll(b).agg(F.count(F.lit(1)).alias("differing"))).select("extra", "differing", "n")


def _auto(table: str, n: int, picks: list[str]):
    sql = " union all ".join(f"select {i + 1}::bigint as ord, '{c}' as column_name, count(distinct {c})::bigint as n_distinct from {table}" for i, c in enumerate(picks))

    def run(spark, d):
        found = ts.find_stratification_columns(read(spark, d, table), n)
        return spark.createDataFrame([(i + 1, c, k) for i, (c, k) in enumerate(found)], "ord bigint, column_name string, n_distinct bigint")

    query(sql, f"auto_strata_{table}")(run)


_auto("lineitem", 500, ["l_linestatus", "l_returnflag", "l_linenumber"])
_auto("orders", 500, ["o_orderstatus", "o_orderpriority"])
_auto("customer", 500, ["c_mktsegment"])
_auto("part", 500, ["p_type", "p_brand"])
_auto("events", 500, ["event_type", "props"])
_auto("documents", 500, ["lang", "source"])
_auto("conversations", 500, ["role", "turn"])
_auto("labels", 100, ["quality", "toxic"])
_auto("embeddings", 100, ["label"])


@query("select 'c_mktsegment' as column_name, true as stratifiable union all select 'c_name', false union all select 'c_acctbal', false union all select 'c_custkey', false union all select 'c_nationkey', false")
def stratifiable_columns(spark, d):
    df = read(spark, d, "customer")
    rows = df.count()
    return spark.createDataFrame([(s.name, is_stratifiable(s, rows)) for s in profile(df, distributions=False)], "column_name string, stratifiable boolean")


# Profiles


def _profile_sql(table: str, numeric: list[str], other: list[str]) -> str:
    parts = []
    for c in [*numeric, *other]:
        x = f"{c}::double" if c in numeric else "null::double"
        parts.append(
            f"select '{c}' as name, count({c})::bigint as n, (count(*) - count({c}))::bigint as missing, count(distinct {c})::bigint as n_unique, "
            f"min({x}) as low, max({x}) as high, round(avg({x}), 4) as mean, round(stddev_samp({x}), 4) as std, quantile_cont({x}, 0.5) as median, "
            f"(select {c}::varchar from (select {c}, count(*) as k from {table} where {c} is not null group by {c}) order by k desc, {c} limit 1) as mode from {table}"
        )
    return " union all ".join(parts)


def _profile(table: str, numeric: list[str], other: list[str]):
    def run(spark, d):
        t = ts.profile_table(read(spark, d, table), [*numeric, *other])
        return t.select("name", F.col("count").alias("n"), "missing", F.col("unique").alias("n_unique"), F.col("min").alias("low"), F.col("max").alias("high"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "median", "mode")

    query(_profile_sql(table, numeric, other), f"profile_{table}_exact")(run)


_profile("lineitem", ["l_linenumber", "l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus", "l_shipdate"])
_profile("events", ["event_id", "user_id", "value"], ["event_type", "props"])
_profile("documents", ["doc_id", "n_chars"], ["text", "lang", "source"])
_profile("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"])


@query(" union all ".join(f"select '{c}' as name, true as distinct_near, true as median_near" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice")))
def profile_approx_lineitem(spark, d):
    """Sketches against exact figures: distinct counts within 15 %, medians within 5 %."""
    df = read(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice")
    near = lambda a, b, r: abs(a - b) <= r * abs(b) + 1e-9
    pairs = zip(profile(df, approximate=True, distributions=False), profile(df, distributions=False), strict=True)
    return spark.createDataFrame([(a.name, near(a.unique, b.unique, 0.15), near(a.median, b.median, 0.05)) for a, b in pairs], "name string, distinct_near boolean, median_near boolean")


def _bins_sql(table: str, c: str) -> str:
    return f"""with r as (select min({c})::double as lo, max({c})::double as hi from {table}),
b as (select least(9, greatest(0, floor(({c} - lo) / ((hi - lo) / 10))))::bigint as bin from {table}, r)
select bin, count(*)::bigint as n from b group by bin"""


@query(_bins_sql("lineitem", "l_extendedprice"))
def histogram_extendedprice(spark, d):
    df = read(spark, d, "lineitem")
    low, high = df.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    return histograms(df, {"l_extendedprice": (low, high)}, 10).select(F.col("bin").cast("bigint").alias("bin"), "n")


@query("select i::bigint as bin, case when i = 5 then (select count(*) from region) else 0 end::bigint as n from range(10) t(i)")
def histogram_constant(spark, d):
    s = profile(read(spark, d, "region").select(F.lit(7).alias("x")))[0]
    return spark.createDataFrame(list(enumerate(s.histogram)), "bin bigint, n bigint")


@query("select event_type as value, count(*)::bigint as n from events group by event_type order by n desc, value limit 5")
def topk_event_type(spark, d):
    return top_values(frequencies(read(spark, d, "events"), ["event_type"]), 5).select("value", "n")


@query("select p_brand as value, count(*)::bigint as n from part group by p_brand order by n desc, value limit 8")
def topk_p_brand(spark, d):
    return top_values(frequencies(read(spark, d, "part"), ["p_brand"]), 8).select("value", "n")


@query("""with e as (select case event_id % 7 when 0 then null when 1 then 'NaN'::double when 2 then 'Infinity'::double when 3 then '-Infinity'::double else event_id::double end as x from events)
select count(x)::bigint as n, count(*) filter (x is null)::bigint as missing, min(x) filter (isfinite(x)) as low, max(x) filter (isfinite(x)) as high, avg(x) filter (isfinite(x)) as mean, count(*) filter (isfinite(x))::bigint as n_finite from e""")
def nonfinite_stats(spark, d):
    m = F.col("event_id") % 7
    x = F.when(m == 0, None).when(m == 1, float("nan")).when(m == 2, float("inf")).when(m == 3, float("-inf")).otherwise(F.col("event_id").cast("double"))
    df = read(spark, d, "events").select(x.alias("x"))
    y = finite_double(F.col("x"), T.DoubleType())
    return df.agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.min(y).alias("low"), F.max(y).alias("high"), F.avg(y).alias("mean"), F.count(y).alias("n_finite"))


@query(" union all ".join(f"select '{c}' as name, bool_or({c} <> floor({c})) as fractional from lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")))
def fractional_probe(spark, d):
    found = profile(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], approximate=True, distributions=False)
    return spark.createDataFrame([(s.name, s.fractional) for s in found], "name string, fractional boolean")


@query("select * from (values ('doc_id', 'numeric'), ('text', 'text'), ('lang', 'categorical'), ('source', 'categorical'), ('n_chars', 'numeric'), ('flag', 'boolean'), ('day', 'datetime'), ('list', 'other'), ('span', 'other')) t(name, kind)")
def kind_classification(spark, d):
    df = read(spark, d, "documents").select("*", F.lit(True).alias("flag"), F.to_date(F.lit("2020-01-01")).alias("day"), F.array("lang").alias("list"), F.expr("interval 1 day").alias("span"))
    return spark.createDataFrame([(s.name, s.kind) for s in profile(df, approximate=True, distributions=False)], "name string, kind string")


@query("""with n as (select l_linestatus as v, count(*) as n from lineitem group by 1 order by n desc, v limit 1),
q as (select format('{:,}', min(l_quantity)::bigint) || ' … ' || format('{:,}', max(l_quantity)::bigint) || '  μ=' || format('{:,.2f}', avg(l_quantity)) as text from lineitem)
select 'sparkline' as what, '▁▂▄█' as text union all select 'l_linestatus', 'top: ' || v || ' (' || format('{:.0f}', 100.0 * n / (select count(*) from lineitem)) || '%)' from n union all select 'l_quantity', text from q""")
def sparkline_and_summary(spark, d):
    stats = profile(read(spark, d, "lineitem"), ["l_linestatus", "l_quantity"])
    return spark.createDataFrame([("sparkline", ts.sparkline([0, 2, 4, 8])), *((s.name, s.summary()) for s in stats)], "what string, text string")


# Reports

ORDER_SAMPLE = stratified_sql("orders", ["o_orderpriority"], 500, ["o_orderkey"], "t.*")


@query(f"""with drawn as ({ORDER_SAMPLE}), r as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders),
f as (select 'source' as side, * from orders union all by name select 'sample' as side, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from drawn),
bins as (select 'o_totalprice' as column_name, least(9, greatest(0, floor((o_totalprice - lo) / ((hi - lo) / 10))))::int as ord, count(*) filter (side = 'source') as s, count(*) filter (side = 'sample') as m from f, r group by 1, 2),
v as (select 'o_orderstatus' as column_name, o_orderstatus as value, side from f union all select 'o_orderpriority', o_orderpriority, side from f),
c as (select column_name, value, count(*) filter (side = 'source') as s, count(*) filter (side = 'sample') as m from v group by 1, 2),
o as (select column_name, (row_number() over (partition by column_name order by s desc, value) - 1)::int as ord, s, m from c)
select column_name, ord::bigint as ord, s::bigint as source_n, m::bigint as sample_n, round(100.0 * s / sum(s) over (partition by column_name), 6) as source_pct, round(100.0 * m / sum(m) over (partition by column_name), 6) as sample_pct
from (select * from bins union all select * from o)""")
def hist_source_vs_sample(spark, d):
    df = read(spark, d, "orders").select("o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderkey")
    drawn = ts.stratified_sample(df, 500, ["o_orderpriority"], seed=SEED, key=["o_orderkey"])[0]
    t = ts.histogram_comparison(df.drop("o_orderkey"), drawn)
    return t.select(F.col("column").alias("column_name"), F.col("ord").cast("bigint").alias("ord"), "source_n", "sample_n", F.round("source_pct", 6).alias("source_pct"), F.round("sample_pct", 6).alias("sample_pct")).where("source_n > 0")


@query(f"""with drawn as ({ORDER_SAMPLE}), s as (select o_orderpriority as value, count(*) as source_n from orders group by 1), m as (select o_orderpriority as value, count(*) as sample_n from drawn group by 1)
select 'o_orderpriority' as column_name, value, source_n::bigint as source_n, sample_n::bigint as sample_n, round(100.0 * source_n / sum(source_n) over (), 6) as source_pct, round(100.0 * sample_n / sum(sample_n) over (), 6) as sample_pct from s join m using (value)""")
def strat_report_table(spark, d):
    df = read(spark, d, "orders")
    drawn = ts.stratified_sample(df, 500, ["o_orderpriority"], seed=SEED, key=["o_orderkey"])[0]
    t = ts.stratification_table(df, drawn, ["o_orderpriority"])
    return t.select(F.col("column").alias("column_name"), "value", "source_n", "sample_n", F.round("source_pct", 6).alias("source_pct"), F.round("sample_pct", 6).alias("sample_pct"))


RARE = "r as (select o_orderkey, o_orderstatus, case when o_orderkey % 3000 = 1 then 'rare' else o_orderpriority end as p from orders), "


@query(f"""with {RARE}{alloc_sql('r', ['o_orderstatus', 'p'], 60)}, v as (select 'o_orderstatus' as column_name, o_orderstatus as value, size, alloc from alloc union all select 'p', p, size, alloc from alloc)
select column_name, value, count(*)::bigint as n_groups, max(size)::bigint as largest, sum(alloc)::bigint as allocated from v group by 1, 2 having sum(alloc) = 0""")
def zero_alloc_report(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3000 == 1, "rare").otherwise(F.col("o_orderpriority")).alias("p"))
    strata = ["o_orderstatus", "p"]
    t = ts.unrepresented(ts.allocate(ts.stratum_sizes(df, strata), strata, 60), strata)
    return t.select(F.col("column").alias("column_name"), "value", F.col("groups").alias("n_groups"), "largest", "allocated")


@query("select 'stratification' as report, true as ok union all select 'histograms', true union all select 'distribution', true union all select 'reduction', true union all select 'snippet', true")
def text_reports(spark, d):
    """The text reports hold what they have to."""
    df = read(spark, d, "orders")
    r = ts.sample(df, 500, seed=SEED, key=["o_orderkey"])
    red = ts.reduce_columns(read(spark, d, "part").select("p_size", "p_retailprice", "p_type"), n_components=1)
    checks = [
        ("stratification", "# Strata by " in (t := ts.format_stratification_report(df, r)) and "o_orderpriority" in t),
        ("histograms", "o_totalprice (numeric)" in ts.format_histograms(df, r.data)),
        ("distribution", "values in" in ts.format_distribution(df, "o_orderstatus")),
        ("reduction", "PC1" in ts.format_reduction_report(red)),
        ("snippet", "tessera.sample" in ts.snippet("a.csv", 5, seed=1)),
    ]
    return spark.createDataFrame(checks, "report string, ok boolean")


def text_rows(text: str, head: str, cells: int) -> list[tuple]:
    """Cells of the lines of the section of a report that begins with ``head``, without rules and bars."""
    section = next(x for x in text.split("\n\n") if x.startswith(head))
    split = [[c for c in re.split(r"\s{2,}", line.strip()) if not re.fullmatch("[█░-]+", c)] for line in section.split("\n")[2:]]
    return [tuple(x) for x in split if len(x) == cells]


@query(f"""with drawn as ({ORDER_SAMPLE}), s as (select o_orderpriority as value, count(*) as a from orders group by 1), m as (select o_orderpriority as value, count(*) as b from drawn group by 1),
p as (select value, a, b, 100.0 * a / sum(a) over () as x, 100.0 * b / sum(b) over () as y from s join m using (value))
select value, format('{{:,}}', a) as in_source, format('{{:,}}', b) as drawn, format('{{:.1f}}%', x) as of_rows, format('{{:.1f}}%', y) as of_drawn from p""")
def strat_report_text(spark, d):
    """The text of the stratification report, line by line."""
    df = read(spark, d, "orders")
    r = ts.sample(df, 500, strat_cols=["o_orderpriority"], seed=SEED, key=["o_orderkey"])
    return spark.createDataFrame([x[:5] for x in text_rows(ts.format_stratification_report(df, r), "o_orderpriority", 6)], "value string, in_source string, drawn string, of_rows string, of_drawn string")


@query("select o_orderstatus as value, format('{:,}', count(*)) as n, format('{:.1f}%', 100.0 * count(*) / (select count(*) from orders)) as share from orders group by 1")
def distribution_text(spark, d):
    return spark.createDataFrame(text_rows("x\n\n" + ts.format_distribution(read(spark, d, "orders"), "o_orderstatus").split("\n\n", 1)[1], "o_orderstatus", 3), "value string, n string, share string")


@query(f"""with drawn as ({ORDER_SAMPLE}), c as (select o_orderstatus as value, count(*) as a from orders group by 1), m as (select o_orderstatus as value, count(*) as b from drawn group by 1)
select value, format('{{:.1f}}%', 100.0 * a / sum(a) over ()) as in_source, format('{{:.1f}}%', 100.0 * coalesce(b, 0) / sum(b) over ()) as in_sample from c left join m using (value)""")
def histogram_text(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    drawn = ts.stratified_sample(df, 500, ["o_orderpriority"], seed=SEED, key=["o_orderkey"])[0]
    return spark.createDataFrame(text_rows(ts.format_histograms(df, drawn), "o_orderstatus", 3), "value string, in_source string, in_sample string")


@query("""with r as (select abs(corr(l_quantity, 2 * l_quantity + 50 * l_tax)) as r from lineitem)
select 'PC1' as component, format('{:.1f}%', 50 * (1 + r)) as variance, '100.0%' as held, 'l_quantity, other' as together, format('{:.2f}', r) as mean_r from r""")
def reduction_text(spark, d):
    """Of two standardised columns the first component has half of 1 + |r|."""
    r = ts.reduce_columns(read(spark, d, "lineitem").select("l_quantity", (2 * F.col("l_quantity") + 50 * F.col("l_tax")).alias("other")), n_components=2)
    text = ts.format_reduction_report(r)
    first, group = text_rows(text, "component", 4)[0], text_rows(text, "move together", 2)[0]
    return spark.createDataFrame([(first[0], first[2], text_rows(text, "component", 4)[-1][3], *group)], "component string, variance string, held string, together string, mean_r string")


@query("select 'a.csv' as source, 'import tessera' as first_line, 5::bigint as n, true as runs")
def snippet_text(spark, d):
    """The snippet is Python, and names what it was given."""
    text = ts.snippet("a.csv", 5, seed=1, anon={"x": ("hex", {"length": 4})}, reduce={"n_components": 1})
    compile(text, "snippet", "exec")
    runs = all(x in text for x in ("'a.csv'", "seed=1", "('hex', {'length': 4})", "'n_components': 1"))
    return spark.createDataFrame([("a.csv", text.split("\n")[0], 5, runs)], "source string, first_line string, n bigint, runs boolean")


# Anonymisation


@query("with f as (select c_mktsegment as v, row_number() over (order by min(c_custkey)) as i from customer group by 1) select c_custkey, (1000 + 7 * (i - 1))::bigint as c_mktsegment from customer join f on v = c_mktsegment")
def seq_id_mktsegment(spark, d):
    df = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return ts.anonymize(df, {"c_mktsegment": ("sequential_id", {"start": 1000, "interval": 7})}, SEED, ["c_custkey"])


@query("with f as (select c_mktsegment as v, row_number() over (order by min(c_custkey)) as i from customer group by 1) select c_custkey, 'SEG-' || lpad(i::varchar, 4, '0') as c_mktsegment from customer join f on v = c_mktsegment")
def seq_id_prefix_width(spark, d):
    df = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return ts.anonymize(df, {"c_mktsegment": ("seq", {"prefix": "SEG-", "width": 4})}, SEED, ["c_custkey"])


@query(f"select c_custkey, round(case when c_acctbal = 0 then 0 else c_acctbal * (1 - 0.2 + 2 * 0.2 * {uniform_sql('c_acctbal', 'c_acctbal')}) end, 6) as c_acctbal from customer")
def jitter_acctbal(spark, d):
    return ts.anonymize(read(spark, d, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": "numeric_jitter"}, SEED).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query(f"select l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even(l_quantity * (1 - 0.1 + 2 * 0.1 * {uniform_sql('l_quantity', 'l_quantity')}), 0)::bigint as l_quantity from lineitem")
def jitter_integer_qty(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return ts.anonymize(df, {"l_quantity": ("jitter", {"pct": 0.1})}, SEED)


@query("select 0::bigint as outside, 0::bigint as nulls, count(*)::bigint as n from part")
def jitter_bounds_inv(spark, d):
    df = read(spark, d, "part").select("p_partkey", "p_retailprice")
    new = ts.anonymize(df, {"p_retailprice": ("numbers", {"pct": 0.3, "round_to": 2})}, SEED).withColumnRenamed("p_retailprice", "x")
    both = df.join(new, "p_partkey")
    return both.agg(F.count_if(F.abs(F.col("x") - F.col("p_retailprice")) > 0.3 * F.abs("p_retailprice") + 0.005).alias("outside"), F.count_if(F.col("x").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n"))


@query(f"select o_orderkey, o_orderdate + to_seconds((floor({uniform_sql('o_orderdate', 'o_orderdate')} * 1209601) - 604800)::bigint) as o_orderdate from orders")
def dt_jitter_orderdate(spark, d):
    return ts.anonymize(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), {"o_orderdate": "datetime_jitter"}, SEED)


@query(f"select o_orderkey, (o_orderdate::date + (floor({uniform_sql('day', 'o_orderdate::date')} * 61) - 30)::int)::date::varchar as day from orders")
def dt_jitter_days(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return ts.anonymize(df, {"day": ("dates", {"max_delta": "30D", "unit": "D"})}, SEED).select("o_orderkey", F.col("day").cast("string").alias("day"))


@query(f"select c_custkey, substr({md5_sql('c_name', 'c_name')}, 1, 12) as c_name from customer")
def hex_custname(spark, d):
    return ts.anonymize(read(spark, d, "customer").select("c_custkey", "c_name"), {"c_name": ("hex", {"length": 12})}, SEED)


_DIGITS = " || ".join(f"(('0x' || substr(h, {1 + 4 * i}, 4))::bigint % 10)::varchar" for i in range(2))


@query(f"""with h as (select distinct p_size as v, {md5_sql('p_size', 'p_size')} as h from part), c as (select v, {_DIGITS} as c from h), k as (select v, c, row_number() over (partition by c order by v) as k from c)
select p_partkey, case when k = 1 then c else c || ' ' || k::varchar end as p_size from part join k on v = p_size""")
def random_string_digits_suffix(spark, d):
    return ts.anonymize(read(spark, d, "part").select("p_partkey", "p_size"), {"p_size": ("random_string", {"length": 2, "charset": "digits"})}, SEED)


@query("select 0::bigint as repeated, 0::bigint as empty, count(distinct c_name)::bigint as n from customer")
def names_custname(spark, d):
    new = ts.anonymize(read(spark, d, "customer").select("c_name"), {"c_name": "names"}, SEED)
    return new.agg((F.count("c_name") - F.count_distinct("c_name")).alias("repeated"), F.count_if(F.length("c_name") < 3).alias("empty"), F.count_distinct("c_name").alias("n"))


def _people(spark, d) -> DataFrame:
    sex = F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("m")
    origin = F.when(F.col("c_custkey") % 3 == 0, "Chinese").otherwise("Italian")
    return read(spark, d, "customer").select("c_custkey", "c_name", sex.alias("sex"), origin.alias("origin"))


@query("select 0::bigint as wrong_gender, 0::bigint as repeated, count(*)::bigint as n from customer")
def names_linked_gender(spark, d):
    df = ts.anonymize(_people(spark, d), {"c_name": ("names", {"style": "first_last", "gender_column": "sex", "ethnicity_column": "origin"})}, SEED, ["c_custkey"])
    lib = library()
    pools = F.create_map(*[F.lit(x) for s, g in (("F", "female"), ("m", "male")) for o in ("Chinese", "Italian") for x in (f"{s}{o}", "|".join(lib.first_names(g, o.lower())))])
    ok = F.exists(F.split(F.element_at(pools, F.concat("sex", "origin")), "\\|"), lambda p: F.startswith(F.col("c_name"), p))
    return df.agg(F.count_if(~ok).alias("wrong_gender"), (F.count("c_name") - F.count_distinct("c_name")).alias("repeated"), F.count(F.lit(1)).alias("n"))


@query("select 0::bigint as unknown, true as both, count(*)::bigint as n from customer")
def names_randomize_gender(spark, d):
    df = ts.anonymize(_people(spark, d), {"c_name": ("names", {"gender_column": "sex", "randomize_gender": True})}, SEED, ["c_custkey"])
    return df.agg(F.count_if(~F.col("sex").isin("male", "female")).alias("unknown"), (F.count_distinct("sex") == 2).alias("both"), F.count(F.lit(1)).alias("n"))


@query("select 0::bigint as inconsistent, 0::bigint as merged, 0::bigint as nulls_changed")
def consistent_mapping_inv(spark, d):
    df = _null_orders(spark, d).select("o_orderkey", F.col("p"), F.col("p").alias("old"))
    new = ts.anonymize(df, {"p": "random_string"}, SEED)
    by_old, by_new = new.where("old is not null").groupBy("old").agg(F.count_distinct("p").alias("k")), new.where("p is not null").groupBy("p").agg(F.count_distinct("old").alias("k"))
    a, b = by_old.where("k <> 1").count(), by_new.where("k <> 1").count()
    return spark.createDataFrame([(a, b, new.where("(p is null) <> (old is null)").count())], "inconsistent bigint, merged bigint, nulls_changed bigint")


def _suggest(table: str, kinds: dict[str, str]):
    def run(spark, d):
        plan = ts.AnonymizationPlan.suggest(read(spark, d, table))
        return spark.createDataFrame([(c, plan.type_of(c)) for c in plan.assignments], "column_name string, kind string")

    query("select * from (values " + ", ".join(f"('{c}', '{k}')" for c, k in kinds.items()) + ") t(column_name, kind)", f"suggest_{table}")(run)


_suggest("customer", {"c_custkey": "sequential_id", "c_name": "names", "c_nationkey": "numeric_jitter", "c_acctbal": "numeric_jitter", "c_mktsegment": "none"})
_suggest("events", {"event_id": "sequential_id", "ts": "datetime_jitter", "user_id": "numeric_jitter", "event_type": "none", "value": "numeric_jitter", "props": "none"})


@query("select 'male' as gender, 2::bigint as n union all select 'female', 2 union all select 'third', 1 union all select 'undisclosed', 2 union all select null, 1")
def gender_detection(spark, d):
    values = spark.createDataFrame([("M",), ("  Man ",), ("weiblich",), ("feminine",), ("NB",), ("n/a",), ("",), ("qq",)], "v string")
    found = ts.suggest_gender_mapping(values, "v")
    return spark.createDataFrame([(g,) for g in found.values()], "gender string").groupBy("gender").agg(F.count(F.lit(1)).alias("n"))


@query(f"select event_id, value * (1 - 0.2 + 2 * 0.2 * {uniform_sql('value', 'value')}) as value from events where value <> 0 union all select event_id, value from events where value = 0")
def stream_jitter(spark, d):
    """The stateless anonymisers on a stream, run until its files are read."""
    source = read(spark, d, "events").select("event_id", "value")
    name, where = f"jittered_{uuid.uuid4().hex}", f"{_scratch(spark)}/checkpoint"
    stream = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parquet" if "*" in d else f"{d}/event[s].parquet").select(*source.columns)
    out = f"{_scratch(spark)}/out"
    run = ts.anonymize_stream(stream, {"value": "numeric_jitter"}, SEED).writeStream.format("parquet").option("path", out).option("checkpointLocation", where).queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("event_id bigint, value double").parquet(out)


# Reduction


@query("select round(corr(p_size, p_retailprice), 6) as r from part")
def corr_matrix_part(spark, d):
    r = ts.reduce_columns(read(spark, d, "part").select("p_size", "p_retailprice"), n_components=1)
    return spark.createDataFrame([(round(float(r.correlation_matrix[0, 1]), 6),)], "r double")


@query("select 1::bigint as component, round((1 + abs(corr(p_size, p_retailprice))) / 2, 6) as ratio from part union all select 2, round((1 - abs(corr(p_size, p_retailprice))) / 2, 6) from part")
def pca2_explained(spark, d):
    r = ts.reduce_columns(read(spark, d, "part").select("p_size", "p_retailprice"), n_components=2)
    return spark.createDataFrame([(i + 1, round(x, 6)) for i, x in enumerate(r.explained_variance_ratio)], "component bigint, ratio double")


@query("""with s as (select avg(l_quantity) as ma, stddev_samp(l_quantity) as sa, avg(l_extendedprice) as mb, stddev_samp(l_extendedprice) as sb, sign(corr(l_quantity, l_extendedprice)) as g from lineitem)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(((l_quantity - ma) / sa + g * (l_extendedprice - mb) / sb) / sqrt(2), 4) as "PC1" from lineitem, s""")
def pca2_scores(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    r = ts.reduce_columns(df, n_components=1, columns=["l_quantity", "l_extendedprice"])
    return r.data.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("PC1", 4).alias("PC1"))


@query("select true as full_ratio, true as reaches, 0::bigint as correlated, count(*)::bigint as n from lineitem")
def pca_k_by_variance(spark, d):
    df = read(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    full, some = ts.reduce_columns(df, n_components=4), ts.reduce_columns(df, variance_ratio=0.9)
    pairs = [(i, j) for i in range(4) for j in range(i)]
    row = full.data.agg(*[F.abs(F.corr(f"PC{i + 1}", f"PC{j + 1}")) for i, j in pairs]).first()
    return spark.createDataFrame([(abs(sum(full.explained_variance_ratio) - 1) < 1e-9, some.total_variance_retained >= 0.9, sum(x > 1e-6 for x in row), some.data.count())], "full_ratio boolean, reaches boolean, correlated bigint, n bigint")


@query("select 'k' as dropped, 2::bigint as k, 0::bigint as nulls, count(*)::bigint as n from part")
def pca_imputed_constant(spark, d):
    df = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("p_size"), "p_retailprice", F.lit(3.0).alias("k"))
    r = ts.reduce_columns(df, n_components=5, exclude=["p_partkey"])
    return r.data.agg(F.lit(r.dropped_columns[0]).alias("dropped"), F.lit(r.n_components).cast("bigint").alias("k"), F.count_if(F.col("PC1").isNull() | F.isnan("PC1")).alias("nulls"), F.count(F.lit(1)).alias("n"))


@query("select 1::bigint as grp, 'l_quantity' as column_name union all select 1, 'double_quantity'")
def corr_groups(spark, d):
    df = read(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", (F.col("l_quantity") * 2).alias("double_quantity"))
    r = ts.reduce_columns(df, n_components=2)
    return spark.createDataFrame([(i + 1, c) for i, g in enumerate(r.column_groups) for c in g], "grp bigint, column_name string")


# Files


def _scratch(spark) -> str:
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or tempfile.gettempdir()).rstrip('/')}/tessera-{uuid.uuid4().hex}"


@query("select f.kind, n_nationkey, n_name, n_regionkey from nation, (values ('csv'), ('tsv'), ('json'), ('parquet')) f(kind)")
def csv_json_tsv_roundtrip(spark, d):
    df, where, out = read(spark, d, "nation"), _scratch(spark), None
    for kind in ("csv", "tsv", "json", "parquet"):
        ts.write_table(df, f"{where}/{kind}.{kind}", kind)
        back = ts.read_table(spark, f"{where}/{kind}.{kind}").select(F.lit(kind).alias("kind"), F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))
        out = back if out is None else out.unionByName(back)
    return out


@query("select 500::bigint as n, 500::bigint as ids, true as jittered, true as reduced from customer limit 1")
def sample_anonymize_reduce(spark, d):
    """Sample, anonymise, reduce: the whole workflow, by invariants."""
    df = read(spark, d, "customer")
    r = ts.sample(df, 500, seed=SEED, key=["c_custkey"])
    out = ts.AnonymizationPlan.suggest(df).assign("c_custkey", "hex", length=16).apply(r.data, SEED, ["c_custkey"])
    red = ts.reduce_columns(out, n_components=1)
    return red.data.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("ids"), (F.count("c_name") == 500).alias("jittered"), F.lit("PC1" in red.data.columns).alias("reduced"))


@query("select o_orderstatus, count(*)::bigint as n from orders group by 1")
def glob_scan(spark, d):
    """Several files through one pattern."""
    where, df = _scratch(spark), read(spark, d, "orders")
    for s in ("F", "O", "P"):
        ts.write_table(df.where(F.col("o_orderstatus") == s), f"{where}/part_{s}.parquet")
    ts.write_table(df.limit(5), f"{where}/other.csv", "csv")
    return ts.read_table(spark, f"{where}/part_*.parquet").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("select 'lines' as layout, (select count(*) from region)::varchar as outcome union all select 'columns', 'refused' union all select 'array', (select count(*) from region)::varchar")
def json_layouts(spark, d):
    """Records in lines, or in an array, are read; a table by columns is refused."""
    df, where, out = read(spark, d, "region").select("r_regionkey", "r_name"), _scratch(spark), []
    lines = df.toJSON().collect()  # five regions
    for layout, text in (("lines", "\n".join(lines)), ("array", "[" + ",\n".join(lines) + "]"), ("columns", '{"r_regionkey": {"0": 0, "1": 1}, "r_name": {"0": "a", "1": "b"}}')):
        path = f"{where}/{layout}.json"
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        try:
            out.append((layout, str(ts.read_table(spark, path).count())))
        except ValueError:
            out.append((layout, "refused"))
    return spark.createDataFrame(out, "layout string, outcome string")


@query("select 'select' as column_name, count(distinct n_regionkey)::bigint as n_unique, count(*)::bigint as ids from nation union all select 'a.b c', count(distinct n_name), count(*) from nation union all select 'x`y', count(distinct n_nationkey), count(*) from nation")
def hostile_names(spark, d):
    """Keywords, dots, blanks and backticks as names, through profile, sample and an anonymiser."""
    df = read(spark, d, "nation").select(F.col("n_regionkey").alias("select"), F.col("n_name").alias("a.b c"), F.col("n_nationkey").alias("x`y"))
    unique = {s.name: s.unique for s in ts.profile(df)}
    drawn = ts.sample(df, 10, strat_cols=["select"], seed=SEED, key=["x`y"]).data.count()
    ids = ts.anonymize(df, {c: ("sequential_id", {}) for c in df.columns if c != "select"}, SEED, ["x`y"]).select("`a.b c`").distinct().count() if drawn == 10 else -1
    return spark.createDataFrame([(c, n, ids) for c, n in unique.items()], "column_name string, n_unique bigint, ids bigint")


@query("select count(*)::bigint as n, 0::bigint as outside, true as refused from orders where o_orderkey % 50 = 0")
def date_strings(spark, d):
    """Dates as strings are read as dates and moved by a day at most; a string that is none is refused."""
    df = read(spark, d, "orders").where("o_orderkey % 50 = 0").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderdate").cast("timestamp").alias("was"))
    out = ts.anonymize(df, {"day": ("datetime_jitter", {"max_delta": "1D"})}, SEED, ["o_orderkey"])
    try:
        ts.anonymize(df.select("o_orderkey", F.lit("no day").alias("day")), {"day": ("datetime_jitter", {})}, SEED, ["o_orderkey"]).count()
        refused = False
    except (TypeError, ValueError):
        refused = True
    moved = F.abs(F.col("day").cast("timestamp").cast("bigint") - F.col("was").cast("bigint"))
    return out.agg(F.count("day").alias("n"), F.count_if(moved > 86400).alias("outside"), F.lit(refused).alias("refused"))


@query("select * from (values ('sample', 'ValueError'), ('profile', 'ValueError'), ('anonymize', 'ValueError'), ('reduce', 'ValueError'), ('components', 'ValueError'), ('kind', 'ValueError')) t(operation, raised)")
def unknown_columns(spark, d):
    df, out = read(spark, d, "nation"), []
    for name, call in (
        ("sample", lambda: ts.sample(df, 5, strat_cols=["nope"])), ("profile", lambda: ts.profile(df, ["nope"])), ("anonymize", lambda: ts.anonymize(df, {"nope": ("hex", {})}, 1)),
        ("reduce", lambda: ts.reduce_columns(df, n_components=1, exclude=["nope"])), ("components", lambda: ts.reduce_columns(df, n_components=1, variance_ratio=0.5)), ("kind", lambda: ts.AnonymizationPlan().assign("n_name", "nope")),
    ):
        try:
            call()
            out.append((name, "nothing"))
        except (ValueError, KeyError) as wrong:
            out.append((name, "ValueError" if isinstance(wrong, (ValueError, KeyError)) else "other"))
    return spark.createDataFrame(out, "operation string, raised string")


@query("select * from (values ('too few', 0::bigint, true), ('constant', 0, true), ('identifier', 1, true), ('text numbers', 1, false)) t(what, k, noted)")
def reduction_notes(spark, d):
    """Nothing to reduce is a note; identifiers are warned of; strings are numbers where asked for."""
    df = read(spark, d, "part")
    cases = {
        "too few": ts.reduce_columns(df.select("p_name", "p_size"), n_components=1),
        "constant": ts.reduce_columns(df.select(F.lit(1.0).alias("a"), F.lit(2.0).alias("b")), n_components=1),
        "identifier": ts.reduce_columns(df.select(F.col("p_partkey").alias("customer_id"), "p_size"), n_components=1),
        "text numbers": ts.reduce_columns(df.select(F.col("p_size").cast("string").alias("a"), F.col("p_retailprice").cast("string").alias("b")), n_components=1, columns=["a", "b"]),
    }
    return spark.createDataFrame([(k, r.n_components, bool(r.notes)) for k, r in cases.items()], "what string, k bigint, noted boolean")


@query("select 'all in pool' as what, count(distinct c_custkey)::bigint as n from customer where c_custkey <= 40 union all select 'groups', 33")
def names_fixed_pool(spark, d):
    """Names of a fixed gender and group all come from its pool, also those with middle names."""
    df = read(spark, d, "customer").where("c_custkey <= 40").select("c_custkey", F.col("c_custkey").cast("string").alias("who"))
    out = ts.anonymize(df, {"who": ts.Names(gender="female", ethnicity="french")}, SEED, ["c_custkey"])
    pool = set(library().first_names("female", "french"))
    inside = sum(r.who.split()[0] in pool for r in out.collect())  # 40 rows
    return spark.createDataFrame([("all in pool", inside), ("groups", len(library().groups))], "what string, n bigint")


@query("select * from (values ('french', 'french'), ('Indian Tamil', 'indian_tamil'), ('arab', 'arab'), ('nowhere', null)) t(raw, mapped)")
def ethnicity_mapping(spark, d):
    values = spark.createDataFrame([("french",), ("Indian Tamil",), ("arab",), ("nowhere",), (None,)], "v string")
    found = ts.suggest_ethnicity_mapping(values, "v")
    fits = lambda raw, got: None if got is None else raw.strip().lower().replace(" ", "_") if library().first_names("male", raw.strip().lower().replace(" ", "_")) else "no pool"
    return spark.createDataFrame([(k, fits(k, v)) for k, v in found.items() if k is not None], "raw string, mapped string")


@query("select 'json' as kind, 33::bigint as n_groups, true as same union all select 'custom', 1, true")
def name_library_roundtrip(spark, d):
    """The library exported and loaded again, and one of one's own."""
    own = library()
    back = ts.NameLibrary.load(own.export())
    custom = ts.NameLibrary.load({"first": {"elvish_male": ["Ar"], "elvish_female": ["Ga"]}, "last": {"elvish": ["Oak"]}})
    return spark.createDataFrame([("json", len(back.groups), back == own), ("custom", len(custom.groups), custom.first_names("female") == ["Ga"])], "kind string, n_groups bigint, same boolean")


@query("select * from (values ('c_custkey', 'hex'), ('c_name', 'names'), ('c_acctbal', 'numeric_jitter'), ('c_mktsegment', 'none')) t(column_name, kind)")
def plan_dialogue(spark, d):
    """Answers by place, by the start of a word, by kind, and none at all."""
    df = read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    answers = iter(["hex", "", "noi", "1"])
    plan = ts.AnonymizationPlan.for_columns(df.columns).choose_interactively(df, prompt=lambda _: next(answers), echo=lambda _: None)
    return spark.createDataFrame([(c, plan.type_of(c)) for c in df.columns], "column_name string, kind string")


@query("select 'sample_100_anon_pca1' as label, 100::bigint as n, count(*)::bigint as same_status, 0::bigint as code from (select distinct o_orderstatus from orders)")
def command_line_run(spark, d):
    """One run of the command line over a file: saved under its tag, with all rows and strata."""
    import contextlib
    import io

    from tessera import cli

    where = tempfile.mkdtemp()
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        code = cli.main([f"{d}/orders.parquet", "100", "--seed", "7", "--anon", "o_orderkey=sequential_id:start=5", "--reduce-components", "1", "--reduce-exclude", "o_orderkey", "--outdir", where], spark)
    path = re.search("Saved (.*)", said.getvalue())[1]
    got = __import__("pandas").read_parquet(path)
    return spark.createDataFrame([(path.rsplit("orders_", 1)[1].removesuffix(".parquet"), len(got), got.o_orderstatus.nunique(), code)], "label string, n bigint, same_status bigint, code bigint")
