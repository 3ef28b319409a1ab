"""Mixing sources to target weights that vary over training.

Each source has weights at knots of training time t in [0, 1], linear between
them and normalised at each knot, so its share s(t) is piecewise linear and its
cumulative token demand D(t) = T * integral of s piecewise quadratic. Documents of
a source stand in a seeded pseudo-random order; the tokens before a document,
inverted through D, give the time at which the run asks for it. A source asked
for more than it has goes round again (epoch 1, 2, ...).

The running sum over a source isn't one window: the order's first hex digits, more
of them the more rows there are, cut a source into 16^digits buckets, whose totals give
each bucket's start, and windows run inside the buckets. So a hot source is spread like
any other.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized_broadcast

SEED, ALPHA = "mix-1", 0.7
#: Rows that a bucket of the pseudo-random order holds, about, of a source that has all.
BUCKET_ROWS = 1 << 16


def n_tokens(text: Column) -> Column:
    """Space-separated pieces of a text, at least 1."""
    return F.greatest(F.lit(1), F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def natural_to_smoothed(supply: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The default schedule (src, t, weight): from each source's share of the
    tokens at the start to that share to the power alpha at the end."""
    x = supply.withColumn("share", F.col("supply") / F.sum("supply").over(Window.partitionBy()))
    ends = F.array(F.struct(F.lit(0.0).alias("t"), F.col("share").alias("weight")), F.struct(F.lit(1.0).alias("t"), F.pow("share", F.lit(alpha)).alias("weight")))
    return x.select("src", F.inline(ends))


def _src(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def pieces(supply: DataFrame, schedule: DataFrame, total: float | None, max_epochs: int | None) -> DataFrame:
    """(src, supply, limit, pieces, total): each source's linear pieces (t0, t1, w0, w1, d0)
    with its demand before each, and how many of its tokens are asked for. One row a source.
    At a knot whose weights are all 0 nothing is asked for."""
    by_knot, by_src = Window.partitionBy("t"), Window.partitionBy("src").orderBy("t")
    knots = schedule.join(supply, "src").withColumn("w", F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(by_knot)), F.lit(0.0)))
    x = knots.select("src", "supply", F.col("t").alias("t0"), F.lead("t").over(by_src).alias("t1"), F.col("w").alias("w0"), F.lead("w").over(by_src).alias("w1")).where("t1 is not null")
    x = x.withColumn("area", (F.col("t1") - F.col("t0")) * (F.col("w0") + F.col("w1")) / 2)
    x = x.withColumn("before", F.coalesce(F.sum("area").over(Window.partitionBy("src").orderBy("t0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = x.groupBy("src", "supply").agg(F.sum("area").alias("share"), F.sort_array(F.collect_list(F.struct("t0", "t1", "w0", "w1", "before"))).alias("pieces"))
    t = F.lit(float(total)) if total is not None else F.max(F.when(F.col("share") > 0, F.col("supply") / F.col("share"))).over(Window.partitionBy())
    s = s.withColumn("total", t)
    asked = F.col("share") * F.col("total")
    return s.withColumn("limit", asked if max_epochs is None else F.least(asked, (F.col("supply") * max_epochs).cast("double")))


def _time(c: Column, total: Column, pieces: Column) -> Column:
    """The time at which a source's demand reaches c."""
    y = c / total
    last = F.element_at(F.filter(pieces, lambda p: p["before"] <= y), -1)
    rise = (last["w1"] - last["w0"]) / (last["t1"] - last["t0"])  # twice the quadratic term
    need = y - last["before"]
    root = F.sqrt(F.greatest(last["w0"] * last["w0"] + 2 * rise * need, F.lit(0.0)))
    low = last["w0"] + root
    return F.when(low > 0, F.least(last["t0"] + 2 * need / low, last["t1"])).otherwise(last["t0"])


def mix(docs: DataFrame, schedule: DataFrame | None = None, total: float | None = None, max_epochs: int | None = None, seed: str = SEED, digits: int | None = None) -> DataFrame:
    """docs in training order, with (n_tokens, epoch, position): a row for each
    time that a document is asked for, position being its time in [0, 1].

    schedule is (source, t, weight) with a row for every source at every knot, the
    first at 0 and the last at 1; without one it's natural_to_smoothed. At a knot whose
    weights are all 0 nothing is asked for. total is the run's tokens; without one, the
    least at which every document is asked for once (a source of weight 0 apart). A source is
    repeated as often as its weights ask, unless max_epochs bounds it; what it then
    lacks is left unfilled. digits changes no result.

    A null source is a source of its own, and no schedule's unless it has rows of
    a null source; sources absent from the schedule aren't asked for. A null or
    empty text counts one token. Rows that repeat a doc_id are documents of their
    own, ordered by their texts; a null doc_id has an order too. An empty table
    gives no rows. Columns named n_tokens, epoch or position are replaced, others kept
    whatever their names."""
    names = [c for c in docs.columns if c.lower() not in ("n_tokens", "epoch", "position")]
    if digits is None:
        digits = max(3, math.ceil(math.log(max(1, docs.count()) / BUCKET_ROWS, 16)))
    tag = f"_{uuid.uuid4().hex}"  # no column of docs ends so
    c = lambda name: F.col(name + tag)
    own = lambda df: df.select(*(F.col(x).alias(x + tag) for x in df.columns))
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    x = docs.select(*(F.col(f"`{k}`") for k in names), n_tokens(F.col("text")).alias("n" + tag), _src(F.col("source")).alias("src" + tag), order.alias("order" + tag))
    x = x.withColumn("bucket" + tag, F.substring(c("order"), 1, digits))
    buckets = materialize(x.groupBy(c("src").alias("src"), c("bucket").alias("bucket")).agg(F.sum(c("n")).alias("n")))
    supply = buckets.groupBy("src").agg(F.sum("n").alias("supply"))
    if schedule is None:
        plan = natural_to_smoothed(supply)
    else:
        plan = schedule.select(_src(F.col("source")).alias("src"), F.col("t").cast("double").alias("t"), F.col("weight").cast("double").alias("weight"))
    plan = materialize(pieces(supply, plan, total, max_epochs))
    w = Window.partitionBy("src").orderBy("bucket")
    starts = buckets.select("src", "bucket", (F.sum("n").over(w) - F.col("n")).alias("start"))
    starts = materialize(own(starts.join(sized_broadcast(plan), "src")))
    inside = Window.partitionBy(c("src"), c("bucket")).orderBy(c("order"), F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("sum" + tag, F.sum(c("n")).over(inside) - c("n"))
    x = x.join(sized_broadcast(starts), ["src" + tag, "bucket" + tag]).withColumn("c" + tag, c("start") + c("sum"))
    times = F.ceil((c("limit") - c("c")) / c("supply")).cast("int")
    x = x.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    at = (c("c") + F.col("epoch") * c("supply")).cast("double")
    x = x.withColumn("position", F.round(_time(at, c("total"), c("pieces")), 9))
    return x.select(*(F.col(f"`{k}`") for k in names), c("n").alias("n_tokens"), "epoch", "position").orderBy("position", F.col("doc_id").asc_nulls_first(), "epoch")


_RUNNING = "rows between unbounded preceding and 1 preceding"
SQL = f"""
with x as (
  select *, greatest(1, length(text) - length(replace(text, ' ', '')) + 1)::bigint as n_tokens,
         coalesce('s' || source, 'n') as src, md5('{SEED}:' || coalesce(doc_id::varchar, '')) as ord
  from documents),
supply as (select src, sum(n_tokens)::bigint as supply from x group by src),
shares as (select src, supply, supply::double / (sum(supply) over ())::double as w0 from supply),
knots as (select src, supply, w0 / sum(w0) over () as w0, pow(w0, {ALPHA}) / sum(pow(w0, {ALPHA})) over () as w1 from shares),
plan as (select *, (w0 + w1) / 2 as share, max(supply / ((w0 + w1) / 2)) over () as total from knots),
c as (
  select x.*, p.supply, p.w0, p.w1, p.total, p.share * p.total as lim,
         coalesce(sum(n_tokens) over (partition by x.src order by ord, doc_id nulls first, text nulls first {_RUNNING}), 0)::bigint as c
  from x join plan p on x.src = p.src),
e as (select *, unnest(range(ceil((lim - c) / supply)::bigint))::int as epoch from c where lim > c)
select doc_id, text, lang, source, n_chars, n_tokens, epoch,
       round(least(2 * ((c + epoch * supply) / total) / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * ((c + epoch * supply) / total))), 1.0), 9) as position
from e"""
