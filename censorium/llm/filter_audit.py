"""How filters act on one another, in every order of them.

A document matters only through its profile: which filters it fails, its part and its
labels.  Profiles are counted first; each then adds its counts to the edges of the filter
lattice, an edge being the set of filters already applied and the next filter: 80 for five
filters.  An order of the filters is a path of edges, so the steps of all orders, 600 for
five filters, are one join of the summed edges with the table of steps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from censorium.llm.common import table, text_or_empty

#: The white space between words, and the symbols of filter D (fixed values).
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
#: Filters at most: orders grow with the factorial of their number.
MOST_FILTERS = 7
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text: A short, B repetitive, C upper case, D symbols; true where the text fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.char_length(text),
        "D": text.rlike(SYMBOLS),
    }


def _mask(failures: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), (F.coalesce(f, F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(failures)))


def labelled(docs: DataFrame, labels: DataFrame, *, failures: dict[str, Column], part: Column, text_col: str = "text") -> DataFrame:
    """``(_digest, _part, _mask, _good, _toxic, _low, _n, _n_low, _n_free)``: equal rows counted.

    ``_n`` counts rows; ``_low`` is the smallest doc_id among them, ``_n_low`` the rows that have it, and ``_n_free``
    the rows without a doc_id.  Repeated rows meet before the shuffle.  A doc_id with several rows in ``labels``
    is good or toxic if any of them says so.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("_digest"), part.alias("_part"), _mask(list(failures.values())).alias("_mask"))
    rows = rows.groupBy("_id", "_digest", "_part", "_mask").agg(F.count("*").alias("_n"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_said")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    both = rows.join(said, F.col("_id") == F.col("_said"), "left")
    low = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_n")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return (
        both.groupBy("_digest", "_part", "_mask", zero("_good").alias("_good"), zero("_toxic").alias("_toxic"))
        .agg(F.sum("_n").alias("_n"), low.alias("_first"), F.sum(F.when(F.col("_id").isNull(), F.col("_n")).otherwise(0)).alias("_n_free"))
        .select("_digest", "_part", "_mask", "_good", "_toxic", F.col("_first._id").alias("_low"), "_n", F.coalesce("_first._n", F.lit(0)).alias("_n_low"), "_n_free")
    )


def profiles(rows: DataFrame, *, repeat_bit: int) -> DataFrame:
    """``(part, mask, n, good, toxic)``: rows by the filters that they fail, ``repeat_bit`` being that of later copies.

    A row is a later copy if its text is also that of a smaller doc_id; rows without a doc_id are none and make none.
    """
    # a text has at most four rows a part here, however many documents have it
    at = rows.withColumn("_lowest", F.min("_low").over(Window.partitionBy("_digest")))
    first = F.col("_n_free") + F.when(F.col("_low") == F.col("_lowest"), F.col("_n_low")).otherwise(0)
    both = F.array(F.struct(F.col("_mask").alias("mask"), first.alias("n")), F.struct(F.col("_mask").bitwiseOR(F.lit(1 << repeat_bit)).alias("mask"), (F.col("_n") - first).alias("n")))
    split = at.select("_part", "_good", "_toxic", F.explode(both).alias("x")).select(F.col("_part").alias("part"), "x.mask", "x.n", "_good", "_toxic").where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_good")).alias("good"), F.sum(F.col("n") * F.col("_toxic")).alias("toxic"))


def edges(found: DataFrame, k: int) -> DataFrame:
    """``(part, before, next, kept, removed, redundant, unique_fails, good_lost, toxic_lost)`` of the k * 2^(k-1) edges, by part.

    ``before`` is the mask of the filters already applied, ``next`` the number of the filter that follows.
    """
    lattice = [(s, f) for s in range(1 << k) for f in range(k) if not s >> f & 1]
    steps = found.sparkSession.createDataFrame(lattice, "before int, next int")
    # a table of bounded size beside each profile
    each = found.crossJoin(F.broadcast(steps)).withColumn("bit", F.expr("shiftleft(1, next)"))
    lives, fails = F.expr("(mask & before) = 0"), F.expr("(mask & bit) <> 0")
    count = lambda c, of="n": F.sum(F.when(c, F.col(of)).otherwise(0))
    return each.groupBy("part", "before", "next").agg(
        count(lives & ~fails).alias("kept"), count(lives & fails).alias("removed"), count(~lives & fails).alias("redundant"), count(F.expr("mask = bit")).alias("unique_fails"),
        count(lives & fails, "good").alias("good_lost"), count(lives & fails, "toxic").alias("toxic_lost"),
    )


def order_steps(found: DataFrame, names: str) -> DataFrame:
    """The steps of all orders of the filters from summed edges: ``(part, filter_order, step, <counts>, shapley)``.

    ``shapley`` sums a filter's ``removed`` over all orders: an edge lies on |before|! (k - 1 - |before|)! of them.
    """
    k, spark = len(names), found.sparkSession
    path = []
    for order in permutations(range(k)):
        name, before = "".join(names[f] for f in order), 0
        for i, f in enumerate(order):
            path.append((name, i + 1, before, f))
            before |= 1 << f
    steps = spark.createDataFrame(path, "filter_order string, step int, before int, next int")
    orders = F.element_at(F.array(*(F.lit(math.factorial(s) * math.factorial(k - 1 - s)) for s in range(k))), F.bit_count("before") + 1)
    whole = found.withColumn("shapley", F.sum(orders * F.col("removed")).over(Window.partitionBy("part", "next")))
    return whole.join(F.broadcast(steps), ["before", "next"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, *, failures: dict[str, Column] | None = None, part_col: str = "lang", text_col: str = "text", repeats: str = "E") -> DataFrame:
    """Counts of every step of every order of the filters, by part: what stays, goes, would have gone anyway, and which good and toxic documents go.

    ``failures`` names the filters of single rows by one letter each (``text_failures`` by default; null is no failure);
    ``repeats`` is the letter of the filter of later copies of a text.  Null text is empty, a null part the empty string.
    Each row counts, repeated ones too; ties of doc_id are no copies of one another, and rows without a doc_id
    neither are copies nor make others so, and have no labels.  Texts are told apart by SHA-256.
    An empty table gives no rows; other columns are ignored.
    """
    failures = failures or text_failures(text_or_empty(text_col))
    names = "".join(failures) + repeats
    if len(names) > MOST_FILTERS or len(set(names)) < len(names) or any(len(f) != 1 for f in failures):
        raise ValueError(f"at most {MOST_FILTERS} filters with different letters")
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = labelled(docs, labels, failures=failures, part=part, text_col=text_col)
    return order_steps(edges(profiles(rows, repeat_bit=len(failures)), len(names)), names)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, counts and shapley of five filters in all 120 orders over all documents."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
with recursive docs as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
split as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by text) as lowest from docs),
said as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
flagged as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::int
      + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(split.doc_id > lowest, false)::int as mask
  from split left join said using (doc_id)),
profile as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from flagged group by part, mask),
path as (
  select '' as filter_order, 0 as step, 0 as before, 0 as bit
  union all
  select filter_order || letter, step + 1, before + bit, b from path, (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as f(letter, b) where ((before + bit) & b) = 0),
orders as (select filter_order from path where step = 5),
steps as (select o.filter_order, p.step, p.before, p.bit from orders o join path p on p.step > 0 and p.filter_order = left(o.filter_order, p.step)),
counted as (
  select part, filter_order, step, bit,
    sum(case when (mask & before) = 0 and (mask & bit) = 0 then n else 0 end) as kept, sum(case when (mask & before) = 0 and (mask & bit) > 0 then n else 0 end) as removed,
    sum(case when (mask & before) > 0 and (mask & bit) > 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when (mask & before) = 0 and (mask & bit) > 0 then good else 0 end) as good_lost, sum(case when (mask & before) = 0 and (mask & bit) > 0 then toxic else 0 end) as toxic_lost
  from profile, steps group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley
from counted
"""
