"""Registered queries over the operators, with the SQL that each must agree with. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clusters, density, greedy, joins, ordered, quality, retrieval, sampling, structure, summary
from ..sources import sinks, tables

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, and its SQL."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Predicates, casts, identifiers


@query("""
select reason, cast(count(*) as bigint) as n, round(count(*) / cast((select count(*) from orders) as double), 6) as share, reason = 'passed' as is_pass
from (select case when o_orderstatus is null or upper(o_orderstatus) not in ('O', 'F') then 'wrong_status'
  when o_totalprice is not null and o_totalprice > 400000 then 'too_expensive'
  when c_custkey is null then 'no_customer' when c_mktsegment = 'BUILDING' then 'wrong_segment' when c_acctbal < 0 then 'negative_balance' else 'passed' end as reason
  from orders left join customer on o_custkey = c_custkey) group by reason""")
def qc_reason_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rules = [
        ("wrong_status", F.col("o_orderstatus").isNull() | ~F.upper("o_orderstatus").isin("O", "F")),
        ("too_expensive", F.col("o_totalprice") > 400000),
        ("no_customer", F.col("c_custkey").isNull()),
        ("wrong_segment", F.col("c_mktsegment") == "BUILDING"),
        ("negative_balance", F.col("c_acctbal") < 0),
    ]
    out = summary.reason_counts(rows.select(quality.first_reason(rules).alias("reason")), "reason")
    return out.withColumn("share", r6("share"))


@query("""
select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), 0.0) as k, cast(trunc(coalesce(try_cast(value as double), 0.0)) as bigint) as whole,
  coalesce(case when trim(event_type) not in ('', '.', '?', 'click') then trim(event_type) end, 'other') as kind from events""")
def lenient_cast_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    k = F.coalesce(S.lenient_double(F.get_json_object("props", "$.k")), F.lit(0.0))
    return e.select("event_id", k.alias("k"), S.int_or(F.col("value")).alias("whole"), F.coalesce(S.first_valid(F.col("event_type"), blanks=("", ".", "?", "click")), F.lit("other")).alias("kind"))


@query("select distinct lower(trim(source)) as id from documents where length(trim(source)) between 4 and 5")
def id_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.clean_ids(t(spark, sf_dir, "documents"), F.col("source"), (4, 5))


@query("""
with p as (select a.n_regionkey as region, a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name < b.n_name)
select region, least(a, b) || '__' || greatest(a, b) as pair, x.pep || '_as_peptide__' || x.rec || '_as_receptor' as direction, x.pep as peptide, x.rec as receptor,
  (select cast(count(*) as bigint) from nation m where m.n_regionkey = region and m.n_name not in (a, b)) as masked
from (select region, a, b, unnest([{'pep': b, 'rec': a}, {'pep': a, 'rec': b}]) as x from p)""")
def pair_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"))
    both = joins.both_directions(joins.unordered_pairs(n, ["region"], "name"), "a", "b")
    out = structure.with_masked(both, n.withColumn("place", F.col("name")), ["region"], "name", "place")
    masked = F.size("masked").cast("long")
    return out.select("region", S.pair_id(F.col("a"), F.col("b")).alias("pair"), S.direction(F.col("peptide"), F.col("receptor")).alias("direction"), "peptide", "receptor", masked.alias("masked"))


@query("""
select l_suppkey, l_partkey, cast(count(*) as bigint) as contacts, cast(count(distinct l_orderkey) as bigint) as orders
from lineitem group by all having count(*) >= 3 and count(distinct l_orderkey) >= 2""")
def directed_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    return structure.eligible(near, ["l_suppkey", "l_partkey"], "l_orderkey", 3, 2).withColumnRenamed("items", "orders")


# Spatial and interval joins


@query("""
with a as (select c_custkey as id, c_nationkey as g, c_acctbal as x, (c_custkey % 10) * 200.0 as y, (c_custkey % 7) * 150.0 as z from customer),
b as (select s_suppkey as id, s_nationkey as g, s_acctbal as x, (s_suppkey % 10) * 200.0 as y, (s_suppkey % 7) * 150.0 as z from supplier),
p as (select a.id, b.id as other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as d from a join b using (g) where d <= 800)
select id, cast(count(*) as bigint) as near, round(min(d), 6) as min_distance, first(other order by d, other) as nearest from p group by id""")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 10 * 200.0).alias("y"), (F.col("c_custkey") % 7 * 150.0).alias("z"))
    s = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 10 * 200.0).alias("y"), (F.col("s_suppkey") % 7 * 150.0).alias("z"))
    return joins.radius_nearest(c, s, ["g"], ["x", "y", "z"], 800.0).select("id", "near", r6("min_distance").alias("min_distance"), "nearest")


@query("""
with v as (select event_id, user_id, value, lag(event_id) over w as pi, lag(value) over w as pv, lead(event_id) over w as ni, lead(value) over w as nv from events window w as (partition by user_id order by value, event_id))
select event_id, round(least(coalesce(value - pv, 1e300), coalesce(nv - value, 1e300)), 6) as distance,
  case when pv is not null and (nv is null or value - pv <= nv - value) then pi else ni end as nearest from v where pv is not null or nv is not null""")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    v = t(spark, sf_dir, "events").select("event_id", "user_id", "value").withColumns({"pi": F.lag("event_id").over(w), "pv": F.lag("value").over(w), "ni": F.lead("event_id").over(w), "nv": F.lead("value").over(w)})
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"{c}i").alias("other"), F.abs(F.col(f"{c}v") - F.col("value")).alias("distance")) for i, c in enumerate("pn")))
    pairs = v.select("event_id", F.explode(sides).alias("x")).select("event_id", "x.*").filter("other is not null")
    return joins.nearest(pairs, ["event_id"], "other", tie="side").select("event_id", r6("min_distance").alias("distance"), "nearest")


@query("""
with w as (select o_custkey as c, o_orderkey as o, min(date_diff('day', timestamp '1990-01-01', l_shipdate)) as lo, max(date_diff('day', timestamp '1990-01-01', l_shipdate)) as hi, min(l_quantity) as p, max(l_quantity) as q from orders join lineitem on o_orderkey = l_orderkey group by all),
p as (select a.c, a.o as a, b.o as b, a.lo as al, a.hi as ah, b.lo as bl, b.hi as bh, abs(a.p - b.p) as dp, abs(a.q - b.q) as dq, greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1) as s from w a join w b on a.c = b.c and a.o < b.o)
select c as customer, a, b, round(s / cast((ah - al + 1) + (bh - bl + 1) - s as double), 6) as iou from p
where abs((ah - al) - (bh - bl)) <= 400 and dp <= 20 and dq <= 20 and ((al <= bl and ah >= bh) or (bl <= al and bh >= ah) or s / cast((ah - al + 1) + (bh - bl + 1) - s as double) >= 0.8)""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("long")
    w = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("o")).agg(F.min(day).alias("lo"), F.max(day).alias("hi"), F.min("l_quantity").alias("p"), F.max("l_quantity").alias("q"))
    return joins.interval_conflicts(w, ["customer"], "o", "lo", "hi", anchors=("p", "q"), anchor_gap=20, length_gap=400).withColumn("iou", r6("iou"))


# Frames, runs, windows


_EVENTS = "select event_id, user_id, ts, event_type, value, cast(floor(value) as bigint) % 4 as c from events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").withColumn("c", F.pmod(F.floor("value").cast("long"), F.lit(4)))


_BY_TIME = ["ts", "event_id"]


@query(f"""
with e as ({_EVENTS}) select event_id, round(avg(c) over f, 6) as local_avg, round(avg(case when c > 0 then 1.0 else 0.0 end) over f, 6) as local_coverage,
  cast(list_max(list_transform(string_split(array_to_string(list_transform(list(c) over f, lambda x: case when x > 0 then 'x' else ' ' end), ''), ' '), lambda x: length(x))) as integer) as local_run
from e window f as (partition by user_id order by ts, event_id rows between 3 preceding and 3 following)""")
def local_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.local_frame(_events(spark, sf_dir), ["user_id"], _BY_TIME, "c").select("event_id", r6("local_avg").alias("local_avg"), r6("local_coverage").alias("local_coverage"), "local_run")


@query(f"""
with e as ({_EVENTS}), p as (select user_id, row_number() over w - 1 as i, sum(case when c > 0 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as s, case when c > 0 then 1 else 0 end as f from e window w as (partition by user_id order by ts, event_id))
select a.user_id, cast(a.i as bigint) as left_index, cast(n as bigint) as length, cast(b.s - a.s + a.f as bigint) as contacts
from p a cross join (select unnest(range(8, 21)) as n) v join p b on a.user_id = b.user_id and b.i = a.i + n - 1 where (b.s - a.s + a.f) / cast(n as double) >= 0.9""")
def prefix_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = (F.col("c") > 0).cast("long")
    e = ordered.with_prefix(_events(spark, sf_dir), ["user_id"], _BY_TIME, flag, "s")
    w = ordered.over(["user_id"], _BY_TIME)
    e = e.withColumn("i", F.row_number().over(w) - 1)
    ends = F.array(*(F.struct(F.lit(n).cast("long").alias("n"), F.lead("s", n - 1).over(w).alias("e")) for n in range(8, 21)))
    rows = e.withColumn("ends", ends).select("user_id", F.col("i").cast("long").alias("left_index"), "s", "c", F.explode("ends").alias("x"))
    contacts = F.col("x.e") - F.col("s") + flag
    return rows.filter("x.e is not null").select("user_id", "left_index", F.col("x.n").alias("length"), contacts.alias("contacts")).filter("contacts / length >= 0.9")


@query("""
with u as (select c_custkey as u, c_custkey % 40 + 8 as n, c_custkey % 7 + 4 as a from customer),
w as (select u, n, a, len, unnest(range(greatest(0, a - len + 1), least(a, n - len) + 1)) as l from (select *, unnest(range(8, 21)) as len from u) where least(a, n - len) >= greatest(0, a - len + 1))
select u as id, cast(l as bigint) as "left", cast(l + len - 1 as bigint) as "right", cast(len as bigint) as length from w""")
def window_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40 + 8).alias("n"), (F.col("c_custkey") % 7 + 4).alias("a"))
    w = ordered.enumerate_windows(a, "n", "a", 8, 20)
    return w.select("id", F.col("left").cast("long"), F.col("right").cast("long"), F.col("length").cast("long"))


@query("""
with e as (select event_id, user_id, ts, value, abs(value - lag(value) over (partition by user_id order by ts, event_id)) <= 40 as ok from events),
f as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) = 1 or coalesce(ok, false) as linked from e)
select event_id, cast(sum(case when linked then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as breaks from f""")
def continuity_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    w = ordered.over(["user_id"], _BY_TIME)
    linked = F.abs(F.col("value") - F.lag("value").over(w)) <= 40
    return ordered.with_breaks(e.withColumn("ok", linked), ["user_id"], _BY_TIME, F.col("ok")).select("event_id", F.col("breaks").cast("long").alias("breaks"))


@query("""
with e as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as i, event_type in ('click', 'view') as f from events),
g as (select user_id, f, i - row_number() over (partition by user_id, f order by i) as k from e)
select user_id, cast(coalesce(max(case when f then n end), 0) as bigint) as longest_run from (select user_id, f, k, count(*) as n from g group by all) group by user_id""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.longest_run(t(spark, sf_dir, "events"), ["user_id"], _BY_TIME, F.col("event_type").isin("click", "view"))


# Quotas, ranks, caps


def _line() -> list[Column]:
    return [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_quantity")]


_LINE_SQL = "l_extendedprice desc, l_orderkey, l_linenumber, l_suppkey, l_quantity"


@query(f"""
with b as (select *, case when l_quantity <= 10 then '8_10' when l_quantity <= 14 then '11_14' else '15_20' end as band from lineitem),
f as (select *, row_number() over (partition by l_partkey, band order by {_LINE_SQL}) <= case band when '8_10' then 6 when '11_14' then 6 else 4 end as inq from b),
k as (select * from f qualify row_number() over (partition by l_partkey order by inq desc, {_LINE_SQL}) <= 10)
select l_partkey, l_orderkey, l_linenumber, band, cast(row_number() over (partition by l_partkey order by {_LINE_SQL}) as integer) as rank from k""")
def band_quota_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").withColumn("band", S.short_length_band(F.col("l_quantity")))
    out = ordered.band_quota_backfill(li, ["l_partkey"], "band", {"8_10": 6, "11_14": 6, "15_20": 4}, _line(), 10)
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "band", "rank")


@query(f"""
select l_orderkey, l_linenumber, l_partkey, rank, round(l_extendedprice / s, 6) as share from (select *, cast(row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey, l_suppkey, l_quantity) as integer) as rank, sum(l_extendedprice) over (partition by l_orderkey) as s from lineitem) where rank <= 4""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    shared = ordered.with_share(li, ["l_orderkey"], F.col("l_extendedprice"), "share")
    top = ordered.top_k(shared, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")], 4)
    return top.select("l_orderkey", "l_linenumber", "l_partkey", "rank", r6("share").alias("share"))


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1")
def task_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.first_of_group(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("""
select l_suppkey, l_orderkey, l_linenumber, round(greatest(0.001, case when l_discount > 0.05 then l_discount - 0.05 else l_discount end) / sum(greatest(0.001, case when l_discount > 0.05 then l_discount - 0.05 else l_discount end)) over (partition by l_suppkey), 6) as keep_prob from lineitem""")
def weighted_keep_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_discount")
    out = ordered.with_share(li, ["l_suppkey"], sampling.coverage_weight(F.col("l_discount"), 0.05), "keep_prob")
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", r6("keep_prob").alias("keep_prob"))


@query("""
with w as (select o_custkey, o_orderkey, ln((cast(('0x' || substr(md5('s' || cast(o_orderkey as varchar)), 1, 13)) as bigint) + 0.5) / 4503599627370496.0) / greatest(o_totalprice, 0.000001) as es from orders)
select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by es desc, o_orderkey) as integer) as pick from w qualify pick <= 3""")
def weighted_sample_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sampling.weighted_sample(o, ["o_custkey"], F.col("o_totalprice"), F.col("o_orderkey"), 3, "s").select("o_custkey", "o_orderkey", "pick")


_PRICE, _SIZE, _QTY = [-0.1, 1000.0, 1500.0, 1800.0, float("inf")], [0.0, 15.0, 35.0, float("inf")], [-0.01, 1200.0, 1600.0, float("inf")]


def _labels(edges: list[float]) -> list[str]:
    shown = ["inf" if e == float("inf") else repr(float(e)) for e in edges]
    return [f"[{a}, {b})" for a, b in zip(shown, shown[1:])]


def _sql_bin(value: str, edges: list[float]) -> str:
    parts = [f"when {value} >= {a} {'' if b == float('inf') else f'and {value} < {b}'} then '{x}'" for a, b, x in zip(edges, edges[1:], _labels(edges))]
    return f"case {' '.join(parts)} else 'nan' end"


_AXES = {"price_bin": _labels(_PRICE), "size_bin": _labels(_SIZE), "extra_bin": _labels(_QTY)}


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = t(spark, sf_dir, "part")
    p = p.select("p_partkey", "p_brand", "p_retailprice", S.bin_label(F.col("p_retailprice"), _PRICE).alias("price_bin"), S.bin_label(F.col("p_size"), _SIZE).alias("size_bin"), S.bin_label(F.col("p_retailprice") + F.col("p_size"), _QTY).alias("extra_bin"))
    ref = t(spark, sf_dir, "lineitem").filter("l_quantity < 10").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return p, ref


_CELLS_SQL = f"""
p as (select p_partkey, p_brand, p_retailprice, {_sql_bin("p_retailprice", _PRICE)} as price_bin, {_sql_bin("p_size", _SIZE)} as size_bin, {_sql_bin("(p_retailprice + p_size)", _QTY)} as extra_bin from part),
r as (select p.* from lineitem join p on l_partkey = p_partkey where l_quantity < 10),
g as (select * from (values {", ".join(f"('{x}')" for x in _AXES["price_bin"])}) a(price_bin), (values {", ".join(f"('{x}')" for x in _AXES["size_bin"])}) b(size_bin), (values {", ".join(f"('{x}')" for x in _AXES["extra_bin"])}) c(extra_bin)),
d as (select g.*, coalesce(x.n, 0) as count_gen, coalesce(y.n, 0) as count_ref from g left join (select price_bin, size_bin, extra_bin, count(*) as n from p group by all) x using (price_bin, size_bin, extra_bin) left join (select price_bin, size_bin, extra_bin, count(*) as n from r group by all) y using (price_bin, size_bin, extra_bin)),
e as (select *, count_gen / cast(sum(count_gen) over () as double) as p_gen, case when count_ref > 0 then count_ref / cast(sum(count_ref) over () as double) else 0.000001 end as raw from d),
h as (select *, raw / sum(raw) over () as p_ref from e),
k as (select *, p_ref / (p_gen + 0.00001) as density_ratio from h)"""


@query(f"""with {_CELLS_SQL}
select price_bin, size_bin, extra_bin, cast(count_gen as bigint) as count_gen, cast(count_ref as bigint) as count_ref, round(p_gen, 6) as p_gen, round(p_ref, 6) as p_ref, round(density_ratio, 4) as density_ratio, round(ln(1 + density_ratio) / max(ln(1 + density_ratio)) over (), 6) as weight from k""")
def grid_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    gen, ref = _cells(spark, sf_dir)
    out = density.grid_density(gen, ref, _AXES)
    return out.select(*_AXES, "count_gen", "count_ref", r6("p_gen").alias("p_gen"), r6("p_ref").alias("p_ref"), F.round("density_ratio", 4).alias("density_ratio"), r6("weight").alias("weight"))


_QUOTA_SQL = """, w as (select *, round(p_ref, 9) as sh from k), z as (select *, sh / sum(sh) over () * 500 as part from w), f as (select *, floor(part) as fl from z),
q as (select *, cast(fl + case when row_number() over (order by round(part - fl, 6) desc, price_bin, size_bin, extra_bin) <= 500 - sum(fl) over () then 1 else 0 end as bigint) as quota from f)"""


def _quotas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gen, ref = _cells(spark, sf_dir)
    shares = density.grid_density(gen, ref, _AXES).withColumn("sh", F.round("p_ref", 9))
    return gen, density.apportioned(shares, "sh", F.lit(500), list(_AXES)).select(*_AXES, "quota")


@query(f"with {_CELLS_SQL}{_QUOTA_SQL} select price_bin, size_bin, extra_bin, quota from q")
def hamilton_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotas(spark, sf_dir)[1]


@query(f"""with {_CELLS_SQL}{_QUOTA_SQL},
a as (select p.*, quota, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) = 1 as fl0 from p left join q using (price_bin, size_bin, extra_bin)),
b as (select *, sum(case when fl0 then 1 else 0 end) over (partition by price_bin, size_bin, extra_bin) as nf, row_number() over (partition by price_bin, size_bin, extra_bin, fl0 order by p_retailprice desc, p_partkey) as rn from a),
s as (select *, case when fl0 then 'floor' when rn <= greatest(0, coalesce(quota, 0) - nf) then 'quota' end as st from b),
m as (select greatest(0, 600 - count(*)) as n from s where st is not null)
select p_partkey, st as keep_stage from s where st is not null union all
select p_partkey, 'fill' from (select p_partkey, row_number() over (order by p_retailprice desc, p_partkey) as i from s where st is null), m where i <= m.n""")
def quota_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    gen, quotas = _quotas(spark, sf_dir)
    out = density.quota_keep(gen, quotas, list(_AXES), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 600)
    return out.select("p_partkey", "keep_stage")


@query("""
select l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_quantity) <= 200 as kept,
  case when row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_quantity) > 200 then 'group_cap' end as drop_reason from lineitem""")
def family_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return ordered.capped(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")], 200).drop("l_extendedprice", "l_quantity")


@query("""
with l as (select l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_suppkey, row_number() over (partition by l_partkey order by l_quantity >= 45 desc, l_extendedprice desc, l_orderkey, l_linenumber, l_suppkey, l_quantity) as n, sum(case when l_quantity >= 45 then 1 else 0 end) over (partition by l_partkey) as p from lineitem)
select l_partkey, l_orderkey, l_linenumber from l where l_partkey % 10 = 0 or n <= greatest(l_partkey % 7 + 3, p)""")
def thin_to_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem")
    quotas = t(spark, sf_dir, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 7 + 3).alias("quota"))
    return ordered.thin_to_quota(li, quotas, ["l_partkey"], F.col("l_quantity") >= 45, _line()).select("l_partkey", "l_orderkey", "l_linenumber")


@query("""
with g as (select c_nationkey as grp, min(c_mktsegment) as cell from customer group by 1),
h as (select *, count(*) over (partition by cell) as n, row_number() over (partition by cell order by md5('' || cast(grp as varchar)), grp) as r from g)
select c_custkey, c_nationkey, case when r <= least(n, greatest(1, cast(round_even(n * 0.1, 0) as bigint))) then 'monitor' else 'main_train' end as split from customer join h on c_nationkey = grp""")
def group_safe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.group_split(t(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", 0.1).select("c_custkey", "c_nationkey", "split")


@query("""
select doc_id, case when row_number() over (order by md5('7' || cast(doc_id as varchar))) <= round_even((select count(*) from documents) * 0.1, 0) then 'monitor' else 'main_train' end as split from documents""")
def row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.row_split(t(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 0.1, "7")


# Clusters and duplicates


@query("""
with c as (select doc_id, min(doc_id) over (partition by text) as cluster from documents), s as (select cluster, count(*) as n from c group by 1)
select cast(sum(n) as bigint) as members, cast(count(*) as bigint) as clusters, cast(sum(case when n = 1 then 1 else 0 end) as bigint) as singletons, cast(min(n) as bigint) as smallest, cast(median(n) as double) as median, round(avg(n), 6) as mean, cast(max(n) as bigint) as largest from s""")
def exact_cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_stats(clusters.exact_clusters(t(spark, sf_dir, "documents"), "doc_id", "text")).withColumn("mean", r6("mean"))


@query("select doc_id, min(doc_id) over (partition by text) as cluster from documents")
def exact_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.exact_clusters(t(spark, sf_dir, "documents"), "doc_id", "text")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short and long sequences of letters from parts: brand and type digits spelt out, names in capitals."""
    p = t(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.upper(F.regexp_replace(F.concat("p_name", "p_type"), " ", "")).alias("s"), F.concat(F.upper("p_name"), "p_brand", F.col("p_size").cast("string")).alias("l"), F.col("p_retailprice").alias("w"))


_NAMES_SQL = """n as (select p_partkey as id, upper(replace(p_name || p_type, ' ', '')) as s, upper(p_name) || p_brand || cast(p_size as varchar) as l, p_retailprice as w from part)"""
_PAIRS_SQL = f"""{_NAMES_SQL}, k as (select id, s, l, case when length(s) <= 10 then 3 else 4 end as k from n),
m as (select distinct id, s, l, k, substr(s, i, k) as g from (select *, unnest(range(1, greatest(length(s) - k + 1, 1) + 1)) as i from k)),
c as (select distinct a.id as a, b.id as b, a.s as sa, b.s as sb, a.l as la, b.l as lb from m a join m b on a.k = b.k and a.g = b.g and a.id < b.id where least(length(a.s), length(b.s)) / cast(greatest(length(a.s), length(b.s)) as double) >= 0.85 and least(length(a.l), length(b.l)) / cast(greatest(length(a.l), length(b.l)) as double) >= 0.85),
p as (select a, b, list_sum(list_transform(range(1, least(length(sa), length(sb)) + 1), lambda i: case when substr(sa, i, 1) = substr(sb, i, 1) then 1 else 0 end)) / cast(greatest(length(sa), length(sb)) as double) as si, list_sum(list_transform(range(1, least(length(la), length(lb)) + 1), lambda i: case when substr(la, i, 1) = substr(lb, i, 1) then 1 else 0 end)) / cast(greatest(length(la), length(lb)) as double) as li from c)"""


@query(f"with {_PAIRS_SQL} select a, b, round(si, 6) as short_identity, round(li, 6) as long_identity from p where si >= 0.85 and li >= 0.85")
def kmer_block_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.kmer_conflicts(_names(spark, sf_dir), "id", "s", "l")
    return out.withColumns({"short_identity": r6("short_identity"), "long_identity": r6("long_identity")})


@query(f"""
with recursive {_PAIRS_SQL}, x as materialized (select a, b from p where si >= 0.85 and li >= 0.85), y as materialized (select a, list(b) as l from (select a, b from x union all select b, a from x) group by a),
o as materialized (select id, y.l as l, row_number() over (order by -w, id) as i from n left join y on id = a),
r as (select cast(0 as bigint) as i, cast([] as bigint[]) as kept union all select o.i, case when o.l is null or len(list_intersect(kept, o.l)) = 0 then list_append(kept, o.id) else kept end from r join o on o.i = r.i + 1),
z as (select kept from r order by i desc limit 1)
select o.id, list_contains(z.kept, o.id) as kept, case when not list_contains(z.kept, o.id) then (select arg_min(q.id, q.i) from o q where list_contains(z.kept, q.id) and list_contains(o.l, q.id)) end as by from o, z""")
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    classes = joins.sequence_classes(names, "s", "l")
    conflicts = joins.class_conflicts(classes).select(F.col("x").alias("a"), F.col("y").alias("b"))
    rows = joins.with_class(names, classes, "s", "l").select("id", (-F.col("w")).alias("priority"), "class")
    return greedy.independent_set_of_copies(rows, conflicts)


@query("""
with recursive e as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as i from events),
o as materialized (select *, row_number() over (partition by user_id order by value desc, i) as s from e),
r as (select distinct user_id, cast(0 as bigint) as s, cast([] as bigint[]) as kept, cast(null as bigint) as event_id from e
  union all select o.user_id, o.s, case when ok then list_append(kept, o.i) else kept end, case when ok then o.event_id end
  from (select o.*, r.kept, len(r.kept) < 5 and len(list_filter(r.kept, lambda k: abs(k - o.i) <= 2)) = 0 as ok from r join o on o.user_id = r.user_id and o.s = r.s + 1) o)
select user_id, event_id, cast(len(kept) as integer) as rank from r where event_id is not null""")
def greedy_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "value", F.row_number().over(ordered.over(["user_id"], _BY_TIME)).alias("i"))
    return greedy.spaced_positions(e, ["user_id"], "i", ["-value", "i"], 2, 5).select("user_id", "event_id", "rank")


# Relational shapes


@query("""
with a as (select o_orderkey as k, o_totalprice as total, 'o' as origin from orders where o_orderstatus <> 'P'), b as (select l_orderkey as k, cast(count(*) as bigint) as lines, 'l' as origin from lineitem where l_quantity > 5 group by 1)
select a.k, a.total, b.lines, b.origin from a join b using (k)""")
def step_merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _merge_sides(spark, sf_dir)
    return joins.merge_stages(a, b, ["k"])


def _merge_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = t(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"), F.lit("o").alias("origin"))
    b = t(spark, sf_dir, "lineitem").filter("l_quantity > 5").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("lines"), F.lit("l").alias("origin"))
    return a, b


@query("""
with a as (select distinct o_orderkey as k from orders where o_orderstatus <> 'P'), b as (select distinct l_orderkey as k from lineitem where l_quantity > 5)
select cast(count(*) filter (a.k is not null and b.k is not null) as bigint) as both, cast(count(*) filter (b.k is null) as bigint) as left_only, cast(count(*) filter (a.k is null) as bigint) as right_only from a full join b on a.k = b.k""")
def step_merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.merge_report(*_merge_sides(spark, sf_dir), ["k"])


@query("""
with l as (select * from orders), x as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from l) select o_custkey, o_orderkey from x where n = 1""")
def last_duplicate_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.last_by_key(t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(f"""with {_CELLS_SQL}, v as (select price_bin, size_bin, extra_bin, round(ln(1 + density_ratio) / max(ln(1 + density_ratio)) over (), 6) as weight from k where count_gen > 20)
select p_partkey, coalesce(weight, 0.0) as weight from p left join v using (price_bin, size_bin, extra_bin)""")
def lookup_left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    gen, ref = _cells(spark, sf_dir)
    cells = density.grid_density(gen, ref, _AXES).filter("count_gen > 20")
    cells = cells.select(*_AXES, r6(F.col("log_ratio") / F.max("log_ratio").over(Window.partitionBy())).alias("weight"))
    return joins.with_lookup(gen, cells, list(_AXES), {"weight": 0.0}).select("p_partkey", "weight")


@query("select l_orderkey, l_linenumber, l_suppkey, s_nationkey, n_name as cluster from lineitem left join supplier on l_suppkey = s_suppkey left join nation on s_nationkey = n_nationkey")
def double_left_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    keys = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    names = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("cluster"))
    return clusters.annotated(li, keys, names, ["l_suppkey"], "s_nationkey").select("l_orderkey", "l_linenumber", "l_suppkey", "s_nationkey", "cluster")


@query("""
select c_custkey, 'with' as side from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)
union all select c_custkey, 'without' from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)""")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select("c_custkey")
    o = t(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("side", F.lit("with")).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("side", F.lit("without")))


@query("""
select s_suppkey as id, s_name as name, 'main' as split, cast(null as varchar) as drop_reason from supplier union all by name select c_custkey as id, c_name as name, 'monitor' as split, case when c_acctbal < 0 then 'negative' end as drop_reason from customer""")
def union_split_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("main").alias("split"))
    monitor = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("monitor").alias("split"), F.when(F.col("c_acctbal") < 0, "negative").alias("drop_reason"))
    return tables.union_by_name(main, monitor)


@query("""
select o_custkey as k from orders intersect select c_custkey from customer where c_acctbal > 5000""")
def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(t(spark, sf_dir, "customer").filter("c_acctbal > 5000").select("c_custkey"))


@query("select p_brand as k from part where p_size > 48 union select p_type from part except select p_brand from part where p_size < 3")
def key_union_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    return p.filter("p_size > 48").select(F.col("p_brand").alias("k")).union(p.select("p_type")).distinct().subtract(p.filter("p_size < 3").select("p_brand"))


# Summaries


def _stats_sql(column: str, table: str) -> str:
    return f"""select '{column}' as "column", cast(count({column}) as bigint) as n, round(cast(min({column}) as double), 4) as min, round(cast(quantile_cont({column}, 0.25) as double), 4) as p25, round(cast(quantile_cont({column}, 0.5) as double), 4) as p50, round(cast(quantile_cont({column}, 0.75) as double), 4) as p75, round(cast(max({column}) as double), 4) as max, round(avg({column}), 4) as mean from {table}"""


@query(" union all ".join(_stats_sql(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount")))
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.numeric_summary(t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("column", "n", *(F.round(c, 4).alias(c) for c in ("min", "p25", "p50", "p75", "max", "mean")))


@query("select 'value' as \"column\", cast(0 as bigint) as n, 0.0 as min, 0.0 as p25, 0.0 as p50, 0.0 as p75, 0.0 as max, 0.0 as mean")
def numeric_summary_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select(F.when(F.col("value") > 1e12, F.col("value")).alias("value"))
    return summary.numeric_summary(rows, ["value"], empty_as_zero=True)


@query("""
select case when n_chars between 8 and 10 then '8-10' when n_chars between 11 and 15 then '11-15' when n_chars between 16 and 20 then '16-20' else 'other' end as wide, case when n_chars <= 200 then 'short' when n_chars <= 2000 then 'medium' else 'long' end as band, cast(count(*) as bigint) as n from documents group by all""")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return d.groupBy(S.wide_length_band(F.col("n_chars")).alias("wide"), S.band(F.col("n_chars"), [(200, "short"), (2000, "medium")], "long").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("select cast(count(*) as bigint) as rows, count(distinct l_orderkey) as distinct_l_orderkey, count(distinct l_partkey) as distinct_l_partkey, count(distinct l_suppkey) as distinct_l_suppkey from lineitem")
def distinct_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.profile(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])


@query("select round(avg(case when quality = 1 then 1.0 else 0.0 end), 6) as good, round(avg(case when toxic = 1 then 1.0 else 0.0 end), 6) as toxic, round(avg(case when quality = 1 and toxic = 0 then 1.0 else 0.0 end), 6) as clean from labels")
def pair_ratio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.ratios(t(spark, sf_dir, "labels"), {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "clean": (F.col("quality") == 1) & (F.col("toxic") == 0)})
    return out.select(*(r6(c).alias(c) for c in out.columns))


@query("""
with n as (select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by 1) select cast(sum(case when n = 0 then 1 else 0 end) as bigint) as without, round(avg(n), 6) as mean, cast(max(n) as bigint) as most from n""")
def children_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return summary.counts_per_parent(c, t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k").withColumn("mean", r6("mean"))


# Sequences, text, keys


@query("""
select item_id, array_to_string(case when len(i) = 0 then [1] else i end, ' ') as ids from (select item_id, list_transform(list_filter(string_split(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ''), lambda c: trim(c) <> '' and c <> chr(10)), lambda c: case when c between 'A' and 'Z' and length(c) = 1 and ascii(c) between 65 and 90 then ascii(c) - 63 else 1 end) as i from benchmark)""")
def token_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = S.token_ids(F.regexp_replace("text", "\n", " "))
    return t(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("ids"))


@query("""
select doc_id // 64 as batch, source || '|' || lang as key, cast(count(*) * (count(*) - 1) as bigint) as masked from documents group by 1, 2 having count(*) > 1""")
def composite_key_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select(F.expr("doc_id div 64").alias("batch"), F.col("doc_id").alias("item"), S.composite_key(F.col("source"), F.col("lang")).alias("key"))
    return joins.equal_key_pairs(d, ["batch"], "key", "item").groupBy("batch", "key").agg(F.count(F.lit(1)).alias("masked"))


@query("""
select doc_id, trim(regexp_replace(regexp_replace(trim(replace(lower(string_split(text, chr(10))[1]), 'ß', 'ss')), '^[0-9]+[.)]\\s*', ''), '[^a-z0-9一-鿿]+', ' ', 'g')) as heading,
  case when trim(regexp_replace(trim(source), '[^A-Za-z0-9._-]+', '_', 'g'), '._-') = '' then 'unknown' else trim(regexp_replace(trim(source), '[^A-Za-z0-9._-]+', '_', 'g'), '._-') end as source,
  case when trim(regexp_replace(trim(substr(text, 1, 24)), '[^A-Za-z0-9._-]+', '_', 'g'), '._-') = '' then 'unknown' else trim(regexp_replace(trim(substr(text, 1, 24)), '[^A-Za-z0-9._-]+', '_', 'g'), '._-') end as token from documents""")
def heading_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", S.heading(F.split("text", "\n")[0]).alias("heading"), S.sanitized(F.col("source")).alias("source"), S.sanitized(F.substring("text", 1, 24)).alias("token"))


@query("""
with p as (select page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) as h, regexp_extract(url, '://[^/]*/([^?#]*)', 1) as q from pages), k as (select distinct h as known from p where q like 'en/%')
select page_id, coalesce(a.known, b.known, 'unknown') as found from p left join k a on a.known = h left join k b on b.known = regexp_replace(h, '^(m|blog)[.]', '')""")
def path_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1)).alias("h"), F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("q"))
    known = p.filter(F.col("q").startswith("en/")).select(F.col("h").alias("known")).distinct()
    found = tables.resolve_paths(p, known.withColumnRenamed("known", "name"), [F.col("h"), F.regexp_replace("h", "^(m|blog)[.]", "")])
    return found.select("page_id", F.coalesce("resolved", F.lit("unknown")).alias("found"))


@query("select event_id, case when cast(json_extract_string(props, '$.k') as bigint) >= 90 then 'error' else 'ok' end as status, case when cast(json_extract_string(props, '$.k') as bigint) >= 90 then 'k out of range: ' || json_extract_string(props, '$.k') end as message from events")
def dead_letter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    good, bad = sinks.dead_letters(t(spark, sf_dir, "events").select("event_id", "props"), F.when(k.cast("long") >= 90, F.concat(F.lit("k out of range: "), k)))
    good = good.select("event_id", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("message"))
    return good.unionByName(bad.select("event_id", F.lit("error").alias("status"), F.col("error").alias("message")))


@query("""
select doc_id, case when quality = 0 then 'family:low' when lang <> 'en' then 'target:' || lang else 'task:' || cast(doc_id as varchar) end as grp from documents left join labels using (doc_id)""")
def group_key_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", S.group_key([F.when(F.col("quality") == 0, "low").otherwise(" "), F.lit("nan")], F.when(F.col("lang") != "en", F.col("lang")), F.col("doc_id")).alias("grp"))


@query("""
select c_custkey, cast(list_sum(list_transform(string_split(c_name, ''), lambda c: ascii(c))) as bigint) as code_sum, round(0.6 * (c_acctbal / 10000) + 0.3 * 0.5 - 0.15 * (case when c_nationkey < 5 then 1 else 0 end), 6) as score, c_nationkey - (c_nationkey + c_nationkey + 9) / 2.0 as off from customer""")
def scalar_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    return t(spark, sf_dir, "customer").select("c_custkey", S.code_sum(F.col("c_name")).alias("code_sum"), r6(S.window_score(F.col("c_acctbal") / 10000, F.lit(0.5), F.when(n < 5, 1).otherwise(0))).alias("score"), S.anchor_offset(n, n, n + 9).alias("off"))


# Retrieval


_DOT = "list_sum(list_transform(list_zip(cast(a.embedding as double[]), cast(b.embedding as double[])), lambda z: z[1] * z[2]))"
_COS = f"{_DOT} / (sqrt(list_sum(list_transform(cast(a.embedding as double[]), lambda z: z * z))) * sqrt(list_sum(list_transform(cast(b.embedding as double[]), lambda z: z * z))))"


@query(f"""
select a.vec_id as query, b.vec_id as item, cast(row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) as integer) as rank, round({_COS}, 5) as score from embeddings a, embeddings b where a.vec_id % 100 = 0 qualify rank <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t(spark, sf_dir, "embeddings")
    best = retrieval.block_top(v.filter("vec_id % 100 = 0"), v, "vec_id", "vec_id", "embedding", "embedding", 5)
    return best.select("query", "item", "rank", F.round("score", 5).alias("score"))


_PAIRED = "p as (select a.vec_id // 2 as query, b.vec_id // 2 as item, %s as score from embeddings a, embeddings b where a.vec_id %% 2 = 0 and b.vec_id %% 2 = 1 %s)"


@query(f"""
with {_PAIRED % (_DOT, "")}, o as (select query, score as t from p where query = item)
select cast(count(*) as bigint) as n, cast(quantile_disc(rank, 0.5) as double) as median_rank, round(avg(rank), 6) as mean_rank, round(avg(1.0 / rank), 6) as mrr, round(avg(case when rank <= 1 then 1.0 else 0.0 end), 6) as recall_at_1, round(avg(case when rank <= 5 then 1.0 else 0.0 end), 6) as recall_at_5, round(avg(case when rank <= 10 then 1.0 else 0.0 end), 6) as recall_at_10
from (select p.query, 1 + sum(case when score > t or (score = t and item < p.query) then 1 else 0 end) as rank from p join o on p.query = o.query group by 1)""")
def retrieval_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every even vector against all odd vectors."""
    v = t(spark, sf_dir, "embeddings").withColumn("pair", F.expr("vec_id div 2"))
    m = retrieval.rank_metrics(retrieval.block_ranks(v.filter("vec_id % 2 = 0"), v.filter("vec_id % 2 = 1"), "pair", "pair", "embedding", "embedding"))
    return m.select("n", "median_rank", *(r6(c).alias(c) for c in m.columns[2:]))


@query(f"""
with p as (select a.vec_id // 64 as batch, a.vec_id as query, b.vec_id as item, case when a.label = b.label and a.vec_id <> b.vec_id then -1000000.0 else {_DOT} end as z from embeddings a, embeddings b where a.vec_id // 64 = b.vec_id // 64)
select batch, cast(count(*) as bigint) as n, round(avg(l - own), 5) as loss from (select batch, query, ln(sum(exp(z))) as l, max(case when query = item then z end) as own from p group by all) group by batch""")
def inbatch_softmax_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t(spark, sf_dir, "embeddings").withColumn("batch", F.expr("vec_id div 64"))
    labels = v.select("vec_id", "label")
    scores = retrieval.similarity(v, v, "vec_id", "vec_id", "embedding", "embedding", ["batch"])
    scores = scores.join(labels.toDF("query", "ql"), "query").join(labels.toDF("item", "il"), "item")
    return retrieval.in_batch_loss(scores, "batch", F.col("ql") == F.col("il")).withColumn("loss", F.round("loss", 5))
