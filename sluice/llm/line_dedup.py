r"""Removal of repeated runs of lines, by a suffix array over line ids.

A document is the sequence of its lines that hold a word, each with an id from
its content. Lines that occur once in the corpus never enter. All sequences
together are sorted as suffixes by distributed prefix doubling: ranks by the
first 2^k lines, joined with the ranks 2^k lines on, give the order by the
first 2^(k+1).

A run of lines is worth deleting from LEAST_WORDS words on. Each suffix asks at
the depths of the shortest runs of so many words that begin with it (from its
first line on, or up to a later line's end), and only suffixes that ask stand in
the array; no depth exceeds LEAST_WORDS lines. Common prefixes of neighbours in
the array cut it into intervals: at depth d a new one begins wherever fewer than
d lines are shared. The first member of an interval in document order is the
copy that stays, of every other one the first d lines are deleted. What is
deleted is exactly what the maximal repeated runs of LEAST_WORDS words or more
cover, except their first copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sluice.llm import blocks, scratch

#: A repeated run is deleted only if it has at least so many words.
LEAST_WORDS = 20
WORDS = r"[^\x20\x09-\x0D]+"
#: A document: its id, and a hash that keeps rows with the same id and other text apart.
KEY = ["doc_id", "digest"]


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*more, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def line_table(docs: DataFrame) -> DataFrame:
    r"""(doc_id, digest, seq, line, id1, id2, words) of every \n-split line with a word, of every whole text; seq counts those lines."""
    parts = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("content")))
    lines = _keyed(docs).select(*KEY, F.posexplode(F.filter(parts, lambda x: x["content"].rlike(WORDS))).alias("seq", "at"))
    words = F.regexp_count("at.content", F.lit(WORDS))
    return lines.select(*KEY, "seq", "at.line", F.xxhash64("at.content").alias("id1"), F.xxhash64(F.lit(1), "at.content").alias("id2"), words.cast("int").alias("words"))


def rank_pairs(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``rows`` with ``name`` = how many rows have a smaller pair (a, b); equal pairs get equal ranks.

    Rows per pair are counted with partial sums. Only one row per distinct pair
    is then put in order, by ranges; the sizes of the ranges give their offsets.
    """
    counted = rows.groupBy(F.col(a).alias("pa"), F.col(b).alias("pb")).agg(F.count("*").alias("times"))
    dealt = scratch.keep(counted.repartitionByRange("pa", "pb").withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("part").agg(F.sum("times").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("pa", "pb").rowsBetween(Window.unboundedPreceding, -1)
    ranks = dealt.withColumn("inner", F.coalesce(F.sum("times").over(inside), F.lit(0))).join(base, "part")
    # stored, so that the join below can split the pairs of a hot line
    ranks = scratch.keep(ranks.select(F.col("pa").alias(a), F.col("pb").alias(b), (F.col("base") + F.col("inner")).alias(name)), "pairs")
    out = scratch.keep(rows.join(ranks, [a, b]).drop(a, b), "ranks")
    scratch.drop(dealt, ranks)
    return out


def _asking(lines: DataFrame, least: int) -> DataFrame:
    """(key, seq, depths, prefix, numbers) of the suffixes at which a shortest run of ``least`` words begins.

    ``depths`` are the lengths of such runs, ``prefix`` and ``numbers`` the ranks
    and the line numbers of the suffix's lines down to the deepest.
    """
    at = Window.partitionBy(*KEY).orderBy("seq")
    ahead = at.rowsBetween(0, least - 1)
    line = F.struct("seq", "words", "r0", "line")

    def length(run: Column, step: int) -> Column:
        """Lines of ``run`` until the words reach the limit, or 0 if they do not before a line is missing."""
        start = F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("n"), F.lit(True).alias("ok"))
        grow = lambda s, x: F.struct((s["w"] + x["words"]).alias("w"), (s["n"] + 1).alias("n"), (s["ok"] & (x["seq"] == F.col("seq") + step * s["n"])).alias("ok"))
        end = F.aggregate(run, start, lambda s, x: F.when((s["w"] >= least) | ~s["ok"], s).otherwise(grow(s, x)))
        return F.when((end["w"] >= least) & end["ok"], end["n"]).otherwise(0)

    rows = lines.withColumn("ahead", F.collect_list(line).over(ahead)).withColumn("behind", F.reverse(F.collect_list(F.struct("seq", "words")).over(at.rowsBetween(-(least - 1), 0))))
    rows = rows.select(*KEY, "seq", "ahead", length(F.col("ahead"), 1).alias("on"), length(F.col("behind"), -1).alias("back"))
    # a run that ends n lines on and is n + 1 lines long begins here
    ends = F.transform(F.collect_list("back").over(ahead), lambda b, i: F.when(b == i + 1, b).otherwise(0))
    rows = rows.withColumn("depths", F.array_sort(F.array_distinct(F.filter(F.concat(F.array("on"), ends), lambda d: d > 0)))).where(F.size("depths") > 0)
    deepest = F.slice("ahead", 1, F.element_at("depths", -1))
    return rows.select(*KEY, "seq", "depths", deepest["r0"].alias("prefix"), deepest["line"].alias("numbers"))


def suffix_order(lines: DataFrame, deepest: int) -> DataFrame:
    """(key, seq, head, next): the order by (head, next) is that of the suffixes by their first ``deepest`` lines, by prefix doubling."""
    now, step, held = lines.select(*KEY, "seq", F.col("r0").alias("head")), 1, None
    while True:
        on = now.select(*KEY, (F.col("seq") - step).alias("seq"), F.col("head").alias("next"))
        pairs = now.join(on, [*KEY, "seq"], "left").withColumn("next", F.coalesce("next", F.lit(-1).cast("long")))
        if 2 * step >= deepest:
            out = scratch.keep(pairs, "suffixes")
            scratch.drop(*filter(None, [held]))
            return out
        now = rank_pairs(pairs, "head", "next", "rank").withColumnRenamed("rank", "head")
        now, before = now.select(*KEY, "seq", "head"), held
        held, step = now, 2 * step
        scratch.drop(*filter(None, [before]))


def intervals(asking: DataFrame, order: DataFrame, deepest: int) -> DataFrame:
    """(depth, interval, key, seq, numbers): the interval of the suffix array that each suffix is in, at each depth it asks.

    The array is dealt by ranges and sorted inside them. What a range needs to
    know of the ranges before it is one row each: its last suffix, and at how
    many places fewer than 1, 2, ... lines are shared.
    """
    by = ["head", "next", *KEY, "seq"]
    array = asking.join(order, [*KEY, "seq"]).repartitionByRange(*by).withColumn("part", F.spark_partition_id())
    array = scratch.keep(array, "array")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = array.groupBy("part").agg(F.max_by("prefix", F.struct(*by)).alias("prefix")).withColumn("last", F.lag("prefix").over(Window.orderBy("part"))).select("part", "last")
    inside = Window.partitionBy("part").orderBy(*by)
    rows = array.join(F.broadcast(ends), "part").withColumn("left", F.coalesce(F.lag("prefix").over(inside), "last"))
    same = F.zip_with("left", "prefix", lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False).cast("int")
    rows = rows.withColumn("lcp", F.when(F.col("left").isNull(), 0).when(first > 0, first - 1).otherwise(F.size("prefix"))).drop("left", "last", "prefix")
    depths = range(1, deepest + 1)
    rows = rows.select("part", *by, "depths", "numbers", "lcp", *[F.sum((F.col("lcp") < d).cast("long")).over(inside).alias(f"n{d}") for d in depths])
    rows = scratch.keep(rows, "lcp")
    sizes = rows.groupBy("part").agg(*[F.max(f"n{d}").alias(f"n{d}") for d in depths])
    base = sizes.select("part", F.array(*[F.coalesce(F.sum(f"n{d}").over(before), F.lit(0)) for d in depths]).alias("base"))
    rows = rows.join(F.broadcast(base), "part").withColumn("depth", F.explode("depths"))
    number = F.get("base", F.col("depth") - 1) + F.get(F.array(*[f"n{d}" for d in depths]), F.col("depth") - 1)
    out = scratch.keep(rows.select("depth", number.alias("interval"), *KEY, "seq", F.slice("numbers", 1, F.col("depth")).alias("numbers")), "intervals")
    scratch.drop(array, rows)
    return out


def repeated_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Stored (doc_id, digest, lines): ascending numbers of the lines to delete in each document that has any."""
    every = line_table(docs)
    times = scratch.keep(every.groupBy("id1", "id2").agg(F.count("*").alias("times")).where("times > 1").select("id1", "id2"), "times")
    # rows that repeat id and text are one document
    lines = scratch.keep(every.join(times, ["id1", "id2"]).repartition(*KEY).dropDuplicates([*KEY, "seq"]), "lines")
    ranked = rank_pairs(lines, "id1", "id2", "r0")
    asking = scratch.keep(_asking(ranked, least), "asking")
    deepest = asking.agg(F.max(F.element_at("depths", -1))).first()[0] or 0
    order = suffix_order(ranked, max(deepest, 1))
    found = intervals(asking, order, max(deepest, 1))
    scratch.drop(times, lines, ranked, asking, order)
    spot = F.struct(*KEY, "seq")
    first = scratch.keep(found.groupBy("depth", "interval").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first < last").drop("last"), "first")
    later = found.join(first, ["depth", "interval"]).where(spot > F.col("first"))
    gone = later.groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("lines"))
    gone = scratch.keep(gone, "gone")
    scratch.drop(found, first)
    return gone


def remove_repeated_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    r"""``docs`` with n_lines, n_deleted and the text without its deleted lines.

    Lines are split at \n and joined by \n again. A line goes if it belongs to a
    run of lines with at least ``least`` words that also stands earlier: in a
    document with a smaller id, or further up. Lines without a word neither
    count in a run nor go. A null text stays null and has no lines; rows without
    doc_id come after all others; rows that repeat id and text are one document.
    Other columns are carried along; of columns named n_lines or n_deleted the
    new ones stay. Texts stay in their blocks, only line numbers travel.
    """
    spark, docs = docs.sparkSession, docs.drop("n_lines", "n_deleted")
    schema = StructType([StructField("text", StringType()) if f.name == "text" else f for f in docs.schema] + [StructField("n_lines", LongType()), StructField("n_deleted", LongType())])
    rest = F.struct(F.col("text").isNull().alias("no_text"), F.struct(*[c for c in docs.columns if c != "text"]).alias("columns"))
    blocked = blocks.pack(docs, "texts", rest=rest)
    gone = repeated_lines(blocked, least)
    rows = _keyed(blocked, "block", "row").drop("text")
    told = scratch.keep(rows.join(gone, KEY).select("block", "row", "lines"), "told")

    def without(block: int, rows: pa.Table, answers: pa.Table) -> pa.Table:
        lines = dict(zip(answers.column("row").to_pylist(), answers.column("lines").to_pylist(), strict=True))
        number = rows.column("row").to_pylist()
        text, found = rows.column("text").combine_chunks(), rows.column("rest").combine_chunks()
        n_lines = pc.add(pc.count_substring(text, "\n"), 1).cast(pa.int64())
        hit = [k for k, r in enumerate(number) if r in lines]
        kept = []
        for k in hit:
            away = set(lines[number[k]])
            kept.append("\n".join(x for i, x in enumerate(text[k].as_py().split("\n")) if i not in away))
        mask = np.zeros(len(number), bool)
        mask[hit] = True
        text = pc.replace_with_mask(text, pa.array(mask), pa.array(kept, pa.string()))
        none, others = found.field("no_text"), found.field("columns")
        out = [pc.if_else(none, pa.scalar(None, pa.string()), text) if c == "text" else others.field(c) for c in schema.names[:-2]]
        out += [pc.if_else(none, pa.scalar(0, pa.int64()), n_lines), pa.array([len(lines.get(r, ())) for r in number], pa.int64())]
        return pa.table(out, names=schema.names)

    out = scratch.keep(blocks.answer_by_block(blocked.select("block", "row", "text", "rest"), told, without, schema), "deduplicated")
    scratch.drop(blocked, gone, told)
    scratch.release(spark)
    return out
