"""Exact n-gram Jaccard self-join by T-occurrence search, and the components of its links.

Two documents link when ``100 * |A & B| >= 75 * |A | B|`` over their sets of
distinct five-word shingles. The join never compares all documents:

1. Equal sets collapse to one representative.
2. Every distinct shingle is counted once per block over the whole corpus; the
   reducers answer each block with a frequency class per shingle. A document
   whose shared shingles (frequency two or more) are fewer than the overlap any
   partner needs links with nothing, and leaves exactly.
3. The rest order their shingles rarest first. Linked documents share one of
   the first ``n - T + 1``; documents that share such a shingle form clusters.
4. Inside a cluster an inverted index answers each document's T-occurrence
   query the DivideSkip way: the short lists are merged and counted, the longest
   ones are only probed by binary search for the candidates that can still
   reach T. Documents that link to the smallest one of the cluster ask nothing,
   and candidates already connected are skipped, so a group of copies does not
   cost a comparison per pair.
5. Clusters beyond a size are dealt into parts. The cluster's leader joins every
   part, and only documents that did not connect to it are searched against the
   other parts, or, where that moves fewer rows, against the documents they share
   a token with; a bounded number at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sluice.llm import blocks, scan, scratch
from sluice.llm.components import components

SHINGLE_WORDS = 5
#: Similarity as a fraction: 75 / 100.
SIMILARITY = (75, 100)
#: Bits of a token that hold the frequency class of its shingle.
CLASS_BITS = 5
#: Documents, and bytes of shingles, of one part of a cluster.
PART_DOCS = 2000
PART_BYTES = 24 << 20


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes of the distinct shingles of a chunk of at most 4,000 documents, ordered by both.

    A document with fewer words than ``size`` has its whole sequence as one shingle; without words, none.
    """
    w = scan.Words(raw, offsets, scan.FOLDED)
    gram = scan.gram_hash(w.hash, size)
    keep = w.doc[: len(gram)] == w.doc[size - 1 :] if len(gram) else np.zeros(0, bool)
    doc, h = [w.doc[: len(gram)][keep].astype(np.uint16)], [gram[keep]]
    for k in range(1, size):
        short = np.flatnonzero(w.count == k)
        if len(short):
            doc.append(short.astype(np.uint16))
            h.append(scan.mix(scan.gram_hash(w.hash, k)[w.bounds[short]] + np.uint64(k)))
    doc, h = np.concatenate(doc), np.concatenate(h)
    o = np.argsort(h)
    o = o[np.argsort(doc[o], kind="stable")]
    s = scan.group_starts(doc[o], h[o])
    return doc[o[s]], h[o[s]]


def set_columns(table: pa.Table) -> dict[str, pa.Array]:
    """n_shingles and a 128-bit key of the shingle set of each row."""
    raw, offsets = scan.text_bytes(table.column("text"))
    n, k1, k2 = [], [], []
    for i, j in scan.chunks(offsets):
        doc, h = shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        n.append(np.diff(cut))
        for out, seed in ((k1, 0x5851F42D4C957F2D), (k2, 0x14057B7EF767814F)):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scan.mix(h * scan.GOLD + np.uint64(seed)))])
            out.append((sums[cut[1:]] - sums[cut[:-1]]).view(np.int64))
    cat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    return {"n": cat(n).cast(pa.int64()), "k1": cat(k1), "k2": cat(k2)}


def _chosen(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The block's representatives, each once, in their fixed order."""
    kinds = answers.column("kind").to_numpy()
    ids = answers.column("id").to_numpy()[kinds == 0]
    docs = docs.filter(pa.array(np.isin(docs.column("doc_id").fill_null(-(1 << 62)).to_numpy(), ids)))
    docs = blocks.ordered(docs.select(["doc_id", "text"]))
    if docs.num_rows > 1:
        d, t = docs.column("doc_id"), docs.column("text").combine_chunks()
        same = np.zeros(docs.num_rows, bool)
        same[1:] = d.to_numpy()[1:] == d.to_numpy()[:-1]
        for i in np.flatnonzero(same):
            same[i] = t[int(i)] == t[int(i) - 1]
        docs = docs.filter(pa.array(~same))
    return docs


def _block_shingles(docs: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    raw, offsets = scan.text_bytes(docs.column("text"))
    doc, h = [], []
    for i, j in scan.chunks(offsets):
        d, x = shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        doc.append(d.astype(np.int64) + i)
        h.append(x)
    return doc, h


def _counting(parts: int):
    """Distinct shingles of a block, dealt over the counters by hash range."""

    def fn(block: int, docs: pa.Table, answers: pa.Table) -> pa.Table:
        h = _block_shingles(_chosen(docs, answers))[1]
        h, count = np.unique(np.concatenate(h) if h else np.zeros(0, np.uint64), return_counts=True)
        rows = blocks.ranges(blocks.route(h, parts, 64).astype(np.int64))
        more = []
        for _, a, b in rows:
            at = np.flatnonzero(count[a:b] > 1)
            more.append(np.stack([at, count[a:b][at]]).astype("<u4").tobytes())
        return pa.table({"part": pa.array([r for r, _, _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int64()), "hashes": pa.array([scan.pack48(h[a:b]) for _, a, b in rows], pa.binary()), "more": pa.array(more, pa.binary())})

    return fn


def _classes(table: pa.Table) -> pa.Table:
    """Frequency class of each hash a block sent, in the order sent: 0 for one document, else log2."""
    sent = [scan.unpack48(x) for x in table.column("hashes").to_pylist()]
    h = np.concatenate(sent)
    count = np.ones(len(h), np.int64)
    ends = np.cumsum([len(x) for x in sent])
    for x, start in zip(table.column("more").to_pylist(), ends - [len(y) for y in sent], strict=True):
        at, c = np.frombuffer(x, "<u4").reshape(2, -1)
        count[start + at.astype(np.int64)] = c
    o = np.argsort(h, kind="stable")
    s = scan.group_starts(h[o])
    total = np.add.reduceat(count[o], s)
    level = np.minimum(np.floor(np.log2(total)).astype(np.uint8), 30)
    out = np.empty(len(h), np.uint8)
    out[o] = np.repeat(level, np.diff(np.append(s, len(h))))
    return pa.table({"block": table.column("block"), "kind": pa.array([1] * len(sent), pa.int32()), "part": table.column("part"), "id": pa.nulls(len(sent), pa.int64()), "blob": pa.array([x.tobytes() for x in np.split(out, ends[:-1])], pa.binary())})


def _survivors(block: int, docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents that could link, with their shared shingles rarest first and the prefix to look up."""
    docs = _chosen(docs, answers)
    doc, h = _block_shingles(docs)
    doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)
    h = np.concatenate(h) if h else np.zeros(0, np.uint64)
    distinct, at = np.unique(h, return_inverse=True)
    told = answers.filter(pa.array(answers.column("kind").to_numpy() == 1))
    order = np.argsort(told.column("part").to_numpy())
    blobs = told.column("blob").to_pylist()
    level = np.concatenate([np.frombuffer(blobs[i], np.uint8) for i in order]) if len(order) else np.zeros(0, np.uint8)
    if len(level) != len(distinct):
        raise ValueError(f"block {block}: {len(distinct)} shingles, {len(level)} answers")
    level = level[at].astype(np.uint64)
    n = np.bincount(doc, minlength=docs.num_rows)
    shared = level > 0
    left = np.bincount(doc[shared], minlength=docs.num_rows)
    need = least_overlap(n)
    stay = (left >= need) & (n > 0)
    pick = shared & stay[doc]
    # the class above 59 bits of the hash: rarest first
    token = (level[pick] << np.uint64(64 - CLASS_BITS)) | (h[pick] >> np.uint64(CLASS_BITS))
    owner = doc[pick]
    o = np.lexsort((token, owner))
    token, owner = token[o].view(np.int64), owner[o]
    who = np.flatnonzero(stay)
    cut = np.searchsorted(owner, np.append(who, docs.num_rows))
    prefix = (n - need + 1 - (n - left))[who]
    ids = docs.column("doc_id").to_numpy()[who]
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "n": pa.array(n[who], pa.int64()),
        "prefix": pa.array([token[a : a + k] for a, k in zip(cut[:-1], prefix, strict=True)], pa.list_(pa.int64())),
        "tokens": pa.array([token[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
    })


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Shingles that any partner of a document with n shingles must share with it."""
    a, b = SIMILARITY
    return -(-a * n // b)


def pair_overlap(n: int, m: np.ndarray) -> np.ndarray:
    """Shared shingles at which sets of n and m link: b * i >= a * (n + m - i)."""
    a, b = SIMILARITY
    return -(-a * (n + m) // (a + b))


class Forest:
    """Union-find over positions; roots are the smallest positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            further = self.up[r]
            if np.array_equal(further, r):
                return r
            r = further

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


class Inverted:
    """Posting lists of a set of documents, in one sorted array."""

    def __init__(self, sets: list[np.ndarray]):
        self.m = len(sets)
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(self.m), self.sizes)
        self.terms, of = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_inverse=True)
        self.lists = np.split(of, np.cumsum(self.sizes)[:-1]) if sets else []
        self.keys = np.sort(of.astype(np.int64) * self.m + owner)
        self.start = np.searchsorted(self.keys, np.arange(len(self.terms) + 1, dtype=np.int64) * self.m)
        self.length = np.diff(self.start)

    def merge(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents that any of the lists holds, ascending, and how many hold each: one merge of the sorted lists."""
        a, k = self.start[lists], self.length[lists]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        merged = np.sort(self.keys[at] - np.repeat(lists, k) * self.m, kind="stable")
        s = scan.group_starts(merged)
        return merged[s], np.diff(np.append(s, len(merged)))

    def probe(self, lists: np.ndarray, doc: int) -> int:
        """In how many of the lists a binary search finds the document."""
        want = lists.astype(np.int64) * self.m + doc
        at = np.searchsorted(self.keys, want)
        return int((self.keys[np.minimum(at, len(self.keys) - 1)] == want).sum())


def search(sets: list[np.ndarray], n: np.ndarray, forest: Forest, queries: np.ndarray) -> None:
    """Join in ``forest`` every query with each document it links to (DivideSkip)."""
    index = Inverted(sets)
    for x in queries:
        lists = index.lists[x]
        least = int(least_overlap(n[x]))
        if len(lists) < least:
            continue
        lists = lists[np.argsort(index.length[lists], kind="stable")]
        longest = max(2, int(index.length[lists[-1]]))
        set_aside = min(least - 1, int(least / (0.01 * math.log2(longest) + 1)))
        short, long = lists[: len(lists) - set_aside], lists[len(lists) - set_aside :]
        candidates, found = index.merge(short)
        need = pair_overlap(int(n[x]), n[candidates])
        fits = (found >= least - set_aside) & (found + set_aside >= need) & (need <= np.minimum(n[x], n[candidates])) & (candidates != x)
        candidates, found, need = candidates[fits], found[fits], need[fits]
        while True:
            other = forest.roots(candidates) != forest.find(int(x))
            candidates, found, need = candidates[other], found[other], need[other]
            if not len(candidates):
                break
            best = int(np.argmax(found))
            y = int(candidates[best])
            if found[best] + index.probe(long, y) >= need[best]:
                forest.join(int(x), y)
            candidates, found, need = np.delete(candidates, best), np.delete(found, best), np.delete(need, best)


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in table.column("tokens").to_pylist()]


def _same_ids(ids: np.ndarray, forest: Forest) -> None:
    for i in np.flatnonzero(ids[1:] == ids[:-1]):
        forest.join(int(i), int(i) + 1)


def _part(table: pa.Table) -> pa.Table:
    """Links inside one part of a cluster: each document with the smallest it reaches there."""
    table = table.sort_by([("doc_id", "ascending")])
    ids, n = table.column("doc_id").to_numpy(), table.column("n").to_numpy()
    forest, sets = Forest(len(ids)), _sets(table)
    _same_ids(ids, forest)
    # most members link to the first; two that do need no comparison with each other
    for i in range(1, len(ids)):
        if len(np.intersect1d(sets[0], sets[i], assume_unique=True)) >= pair_overlap(int(n[0]), n[i : i + 1])[0]:
            forest.join(0, i)
    search(sets, n, forest, np.flatnonzero(forest.roots(np.arange(len(ids))) > 0))
    root = forest.roots(np.arange(len(ids)))
    return pa.table({"doc_id": table.column("doc_id"), "root": pa.array(ids[root]), "cluster": table.column("cluster"), "parts": table.column("parts")})


def _across(key: tuple, queries: pa.Table, index: pa.Table) -> pa.Table:
    """Links of a bounded number of documents with one part of their cluster."""
    both = pa.concat_tables([queries.select(["doc_id", "n", "tokens"]), index.select(["doc_id", "n", "tokens"])])
    ids, n = both.column("doc_id").to_numpy(), both.column("n").to_numpy()
    forest = Forest(len(ids))
    search(_sets(both), n, forest, np.arange(queries.num_rows))
    root = forest.roots(np.arange(len(ids)))
    apart = ids != ids[root]
    return pa.table({"doc_id": pa.array(ids[apart]), "root": pa.array(ids[root][apart])})


def _cluster_links(survivors: DataFrame) -> DataFrame:
    """(doc_id, root) edges whose components are those of the exact links; ``scratch_parts`` are the tables they read."""
    postings = survivors.select("doc_id", F.explode("prefix").alias("token"))
    leaders = scratch.keep(postings.groupBy("token").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last").drop("last"), "leaders")
    pairs = postings.join(leaders, "token").where("doc_id <> leader").select("doc_id", "leader").distinct()
    cluster = scratch.keep(components(pairs).toDF("doc_id", "cluster"), "clusters")
    scratch.drop(leaders)
    members = survivors.select("doc_id", "n", "tokens", F.col("prefix")).join(cluster, "doc_id")
    sized = survivors.select("doc_id", F.length("tokens").alias("size")).join(cluster, "doc_id").groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / PART_DOCS), F.ceil(F.sum("size") / PART_BYTES)).cast("int").alias("parts"))
    members = scratch.keep(members.join(sized, "cluster"), "members")
    scratch.drop(cluster)
    mine = F.pmod(F.xxhash64("doc_id"), F.col("parts").cast("long")).cast("int")
    leader = F.col("doc_id") == F.col("cluster")
    dealt = members.drop("prefix").withColumn("part", F.explode(F.when(leader, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(mine))))
    local = scratch.keep(dealt.groupBy("cluster", "part").applyInArrow(_part, "doc_id long, root long, cluster long, parts int").distinct(), "links")
    links, held = local.select("doc_id", "root"), [members, local]
    if local.where("parts > 1").limit(1).count():
        many = members.where("parts > 1")
        alone = local.where("parts > 1 and root <> cluster").select("doc_id").distinct()
        asking = scratch.keep(many.join(alone, "doc_id", "left_semi"), "asking")
        held.append(asking)
        links = links.union(_asked(asking, many))
    links.scratch_parts = held
    return links


def _asked(asking: DataFrame, many: DataFrame) -> DataFrame:
    """(doc_id, root) links of ``asking`` with all documents of their clusters in ``many`` that they can link to.

    A pair that links shares its cluster, and a token of both prefixes. It meets
    in the group of the one or the other, whichever moves fewer rows for the
    cluster: a tight one meets as a whole, a chain of documents with little in
    common token by token. A group's documents are dealt into parts and those
    that ask into batches, both of bounded size.
    """
    size = lambda x, name: x.groupBy("cluster", "token").agg(F.count("*").alias(name))
    moved = lambda a, d: F.col(a) * F.ceil(F.col(d) / PART_DOCS) + F.col(d) * F.ceil(F.col(a) / PART_DOCS)
    token = F.explode("prefix").alias("token")
    shared = size(asking.select("cluster", token), "a").join(size(many.select("cluster", token), "d"), ["cluster", "token"])
    by_token = shared.groupBy("cluster").agg(F.sum(moved("a", "d")).alias("by_token"))
    whole = many.groupBy("cluster").agg(F.count("*").alias("d")).join(asking.groupBy("cluster").agg(F.count("*").alias("a")), "cluster")
    way = scratch.keep(whole.join(by_token, "cluster").select("cluster", (F.col("by_token") < moved("a", "d")).alias("split")), "ways")
    meet = F.explode(F.when(F.col("split"), F.col("prefix")).otherwise(F.array(F.lit(0).cast("long")))).alias("token")
    asks, has = (x.join(way, "cluster").select("cluster", "doc_id", meet) for x in (asking, many))
    keys = ["cluster", "token"]
    groups = asks.groupBy(*keys).agg(F.ceil(F.count("*") / PART_DOCS).cast("int").alias("batches")).join(has.groupBy(*keys).agg(F.ceil(F.count("*") / PART_DOCS).cast("int").alias("parts")), keys)
    groups = scratch.keep(groups, "groups")
    batch, part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("batches").cast("long")).cast("int"), F.pmod(F.xxhash64("doc_id"), F.col("parts").cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asks.join(groups, keys).select("doc_id", *keys, batch.alias("batch"), every("parts").alias("part"))
    right = has.join(groups, keys).select("doc_id", *keys, every("batches").alias("batch"), part.alias("part"))
    keys += ["batch", "part"]
    left, right = (x.join(y.select("doc_id", "n", "tokens"), "doc_id").select(*keys, "doc_id", "n", "tokens") for x, y in ((left, asking), (right, many)))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_across, "doc_id long, root long")


class Linked:
    """``docs`` in blocks, with the component of each distinct shingle set."""

    KEYS = ["n", "k1", "k2"]

    def __init__(self, docs: DataFrame, rest: Column | None = None):
        spark = docs.sparkSession
        self.blocked = blocks.pack(docs, "jaccard", set_columns, "n long, k1 long, k2 long", rest=rest)
        self.sets = self.blocked.select("block", "row", "doc_id", *self.KEYS)
        self.first = scratch.keep(self.sets.where("n > 0 and doc_id is not null").groupBy(*self.KEYS).agg(F.min(F.struct("doc_id", "block")).alias("first")).select(*self.KEYS, "first.doc_id", "first.block"), "first")
        chosen = self.first.select("block", F.lit(0).alias("kind"), F.lit(0).alias("part"), F.col("doc_id").alias("id"), F.lit(None).cast("binary").alias("blob"))
        text = self.blocked.select("block", "doc_id", "text")
        parts = 2 * blocks.buckets_for(docs)
        counted = blocks.answer_by_block(text, chosen, _counting(parts), "part int, block long, hashes binary, more binary")
        answers = counted.groupBy("part").applyInArrow(_classes, "block long, kind int, part int, id long, blob binary")
        survivors = scratch.keep(blocks.answer_by_block(text, chosen.union(answers), _survivors, "doc_id long, n long, prefix array<long>, tokens binary"), "survivors")
        del counted, answers
        scratch.release(spark)
        links = _cluster_links(survivors)
        found = scratch.keep(components(links).toDF("first_id", "component_id"), "found")
        scratch.drop(survivors, *links.scratch_parts)
        scratch.release(spark)
        self.found = found

    def components(self) -> DataFrame:
        """(block, row, doc_id, n, component_id) of every row."""
        by_set = self.first.select(*self.KEYS, F.col("doc_id").alias("first_id")).join(self.found, "first_id", "left").select(*self.KEYS, F.coalesce("component_id", "first_id").alias("component_id"))
        return self.sets.join(by_set, self.KEYS, "left").select("block", "row", "doc_id", "n", F.coalesce("component_id", F.col("doc_id")).alias("component_id"))

    def drop(self) -> None:
        scratch.drop(self.blocked, self.first, self.found)
        scratch.release(self.blocked.sparkSession)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable by links, itself included.
    Null and empty texts, and texts without words, have an empty set and link
    with nothing. Rows that repeat a doc_id count as one document with several
    sets. A row without doc_id gets the component of its set, or null if no
    numbered row has that set. Further columns of ``docs`` are ignored.
    """
    linked = Linked(docs)
    out = scratch.keep(linked.components().select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "jaccard")
    linked.drop()
    return out


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    Texts stay in their blocks, only the numbers of the rows to leave out travel.
    Rows without doc_id stay, and so do all rows that repeat the smallest
    doc_id. All columns are kept, text as a string.
    """
    schema = StructType([StructField("text", StringType()) if f.name == "text" else f for f in docs.schema])
    rest = F.struct(F.col("text").isNull().alias("no_text"), F.struct(*[c for c in docs.columns if c != "text"]).alias("columns"))
    linked = Linked(docs, rest)
    later = scratch.keep(linked.components().where("doc_id <> component_id").select("block", "row"), "later")

    def left(block: int, rows: pa.Table, gone: pa.Table) -> pa.Table:
        rows = rows.filter(pa.array(~np.isin(rows.column("row").to_numpy(), gone.column("row").to_numpy())))
        found = rows.column("rest").combine_chunks()
        found = found if isinstance(found, pa.StructArray) else pa.concat_arrays(found.chunks)
        others = found.field("columns")
        text = pc.if_else(found.field("no_text"), pa.scalar(None, pa.string()), rows.column("text").combine_chunks())
        return pa.table([text if f.name == "text" else others.field(f.name) for f in schema], names=schema.names)

    out = scratch.keep(blocks.answer_by_block(linked.blocked.select("block", "row", "text", "rest"), later, left, schema), "representatives")
    scratch.drop(later)
    linked.drop()
    return out
