"""Near duplicates by BagMinHash: signatures, bands, and exact multiset overlap of word shingles.

1. One pass over the texts gives each document a 128-bit hash of its words and, by ``REGISTERS`` registers
   of a BagMinHash signature, ``BANDS`` band hashes.  Documents of equal words form a class at once; only a
   representative of each goes on, so large groups of copies cost nothing later.
2. Representatives that share a band hash form a bucket.  Each is compared with the bucket's most central
   member (the one whose bands are shared most): a star, however large the bucket is.  Comparison is exact:
   the overlap of the shingle multisets against ``THRESHOLD``.
3. Links give components.  Where a bucket still holds several, its members meet in blocks of bounded size,
   and a block compares every pair that shares a band and is not connected yet, but only emits links that
   join components.  So no candidate pair is dropped and no list of pairs is ever written.
4. Components of all links are the classes.

With 24 bands of 5 registers, a pair of similarity 0.8 shares a band with a probability above 0.9999.
Work beyond the star grows with the product of a bucket's unconnected members and its size.

Defined cases: a null text is empty; documents without words are one class; texts of fewer than five words
have one shingle of all their words; a null id counts as a document of its own words, its class is named
by another member if there is one and else by a negative hash; rows that repeat an id with another text are
documents of their own, each linked by its text, and named by the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwise.llm import bagminhash, shingles
from poolwise.llm.components import components
from poolwise.llm.staging import ship, small, stage

THRESHOLD = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Members of a block; two blocks meet in one task.
BLOCK = 96
#: Buckets of so many members or fewer list their unconnected pairs instead.
FEW = 16
#: Words that are turned into signatures at a time.
_WORDS_AT_ONCE = 40_000


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """(documents, BANDS) hashes of the bands, each salted with its place."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(shingles.mix(np.arange(BANDS, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(ROWS):
        out = shingles.mix(out ^ parts[:, :, k])
    return out.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts, unnamed, digests, at = *batch.columns, 0
        while at < len(batch):
            words, total, first = [], 0, at
            while at < len(batch) and total < _WORDS_AT_ONCE:
                words.append(shingles.word_hashes(texts[at].as_py() or ""))
                total += len(words[-1])
                at += 1
            sign = bagminhash.signatures(*shingles.counted(*shingles.shingles(words)), len(words), REGISTERS)
            bands = band_hashes(sign).reshape(-1)
            same = [xxhash.xxh3_128_hexdigest(w.tobytes()) for w in words]
            filled = np.array([len(w) > 0 for w in words])
            offsets = np.arange(0, len(bands) + 1, BANDS, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands))
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(first, at - first) for c in (keys, unnamed, digests)), pa.array(same), pa.array(filled), lists],
                ["key", "unnamed", "digest", "same", "filled", "bands"],
            )
    shingles.forget()


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _similar(units: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (left[i], right[i]) have the similarity."""
    size = np.fromiter(map(len, units), np.int64, len(units))
    low, high = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
    out = np.zeros(len(left), bool)
    todo = np.flatnonzero(low >= threshold * high)
    if len(todo) <= 48:
        out[todo] = [_overlap(units[left[i]], units[right[i]]) >= threshold for i in todo]
        return out
    # overlaps of all at once: a product of 0/1 rows over the units that occur more than once
    used = np.unique(np.concatenate([left[todo], right[todo]]))
    row = np.repeat(np.arange(len(used)), size[used])
    flat = np.concatenate([units[i] for i in used])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, (_, column) = row[shared], np.unique(column[shared], return_inverse=True)
    both, width = np.zeros((len(used), len(used)), np.float32), 4096
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(used), width), np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1
        both += part @ part.T
    place = np.zeros(len(units), np.int64)
    place[used] = np.arange(len(used))
    meet = both[place[left[todo]], place[right[todo]]].astype(np.float64)
    out[todo] = meet >= threshold * (low + high)[todo] / (1 + threshold) - 1e-9
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _star(table: pa.Table) -> pa.Table:
    """Links of one chunk of members to their centre."""
    nodes, lead = np.array(table["node"].to_pylist(), np.int64), np.array(table["lead"].to_pylist(), bool)
    centre = np.flatnonzero(lead)
    others = np.flatnonzero(~lead)
    if not len(centre) or not len(others):
        return _LINKS.empty_table()
    texts = table["text"].to_pylist()
    units = [shingles.units(x or "") for x in texts]
    linked = others[_similar(units, np.full(len(others), centre[0]), others, THRESHOLD)]
    return pa.table([pa.array(np.full(len(linked), nodes[centre[0]])), pa.array(nodes[linked])], schema=_LINKS)


def _meet(table: pa.Table) -> pa.Table:
    """Links that join components, among all pairs of the block (or of its two sides) whose first common band is this."""
    band = table["band"][0].as_py()
    nodes, comps = (np.array(table[c].to_pylist(), np.int64) for c in ("node", "comp"))
    side = np.array(table["side"].to_pylist(), np.int64)
    bands = np.array(table["bands"].to_pylist(), np.int64)
    left, right = np.triu_indices(len(nodes), 1)
    wanted = comps[left] != comps[right]
    if side.any():  # two blocks: each meets the other; within itself it is met elsewhere
        wanted &= side[left] != side[right]
    left, right = left[wanted], right[wanted]
    # the place of this band among the columns, and pairs that share an earlier one
    column = int(np.flatnonzero((bands == band).all(0))[0])
    earlier = np.zeros(len(left), bool)
    for k in range(column):
        earlier |= bands[left, k] == bands[right, k]
    left, right = left[~earlier], right[~earlier]
    if not len(left):
        return _LINKS.empty_table()
    need = np.unique(np.concatenate([left, right]))
    texts = table["text"]
    units = [np.zeros(0, np.uint64)] * len(nodes)
    for i in need:
        units[i] = shingles.units(texts[int(i)].as_py() or "")
    ok = _similar(units, left, right, THRESHOLD)
    label = {c: c for c in set(comps.tolist())}

    def find(c: int) -> int:
        while label[c] != c:
            label[c] = c = label[label[c]]
        return c

    a, b = [], []
    for i, j in zip(left[ok].tolist(), right[ok].tolist(), strict=True):
        x, y = find(int(comps[i])), find(int(comps[j]))
        if x != y:
            label[max(x, y)] = min(x, y)
            a.append(nodes[i])
            b.append(nodes[j])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)


def _open(buckets: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rows (band, node, comp, main, n, n_main) of buckets of three or more that hold more than one component."""
    named = buckets.where("n > 2").select("band", "node").join(labelled, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = named.groupBy("band", "comp").agg(F.count("*").alias("n"))
    split = sizes.groupBy("band").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n")).where("comps > 1")
    split = split.select("band", "n", F.col("top.comp").alias("main"), F.col("top.n").alias("n_main"))
    return stage(named.join(stage(split, "split"), "band"), "open")


def _few(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (lead, node) of buckets of at most FEW members, without those that are compared already."""
    rows = rows.where(F.col("n") <= FEW).select("band", "node", "comp")
    other = rows.select("band", F.col("node").alias("lead"), F.col("comp").alias("other"))
    met = rows.join(other, "band").where("lead < node AND comp <> other").select("lead", "node").distinct()
    known = pairs.select(F.least("lead", "node").alias("lead"), F.greatest("lead", "node").alias("node"))
    return stage(met.join(known, ["lead", "node"], "left_anti"), "few")


def _blocks(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Blocks of larger buckets, as (task, band, node, comp, side, text, bands)."""
    rows = rows.where(F.col("n") > FEW)
    # members of the largest component meet only the others; the others meet everyone
    inner = F.col("comp") == F.col("main")
    whole = F.col("n") <= 2 * BLOCK
    n_in, n_out = F.ceil(F.col("n_main") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.when(inner, n_in).otherwise(n_out)).cast("int")
    name = lambda x, i: F.struct(x.alias("in"), i.alias("i"))
    out_blocks = F.transform(F.sequence(F.lit(0), n_out - 1), lambda i: name(F.lit(False), i))
    in_blocks = F.transform(F.sequence(F.lit(0), n_in - 1), lambda i: name(F.lit(True), i))
    only = name(F.lit(False), F.lit(0))
    partners = F.when(whole, F.array(only)).when(inner, out_blocks).otherwise(F.concat(out_blocks, in_blocks))
    rows = rows.withColumn("own", F.when(whole, only).otherwise(name(inner, mine))).withColumn("other", F.explode(partners))
    pair = F.array_sort(F.array("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(pair[0] == F.col("own"), 1).otherwise(2)
    tasks = rows.select(F.xxhash64(pair).alias("task"), "band", "node", "comp", side.alias("side"))
    return tasks.join(texts, "node")


def _starred(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among (lead, node) pairs; the members of one lead are compared in chunks of bounded size."""
    chunks = stage(pairs.groupBy("lead").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("chunks")), "chunks")
    place = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    rows = pairs.join(chunks, "lead").select("node", F.col("lead").alias("task"), place.alias("chunk"), F.lit(False).alias("lead"))
    each = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    heads = chunks.select(F.col("lead").alias("node"), F.col("lead").alias("task"), each.alias("chunk"), F.lit(True).alias("lead"))
    return rows.unionByName(heads).join(texts, "node").groupBy("task", "chunk").applyInArrow(_star, "a long, b long")


#: Which row of a class names it: named ones first, then by id.
_ROW = ("unnamed", "key", "digest")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text, unnamed, digest): the text is known by its id and a hash, since ids may repeat."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), -F.abs(F.xxhash64(text)) - 1)
    return docs.select(key.alias("key"), text.alias("text"), F.col(id_col).isNull().alias("unnamed"), F.xxhash64(text).alias("digest"))


def _classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row as (key, unnamed, digest, rep, top): the row of its words, and the row that names its class, as ``_ROW``."""
    ship(docs.sparkSession)
    source = _source(docs, id_col, text_col)
    sketched = source.mapInArrow(_sketch, "key long, unnamed boolean, digest long, same string, filled boolean, bands array<long>")
    sketched = stage(sketched, "sketch")
    classes = sketched.groupBy("same").agg(F.min(F.struct(*_ROW)).alias("rep"), F.bool_or("filled").alias("filled"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = sketched.select(*_ROW, "same").join(classes.select("same", "node", "rep"), "same").select(*_ROW, "node", "rep")
    members = stage(members, "members")
    # one row per representative, with its bands
    mine = (F.col("key") == F.col("rep.key")) & (F.col("digest") == F.col("rep.digest"))
    chosen = sketched.select("key", "digest", "same", "bands").join(classes.where("filled"), "same").where(mine)
    reps = stage(chosen.select("node", "key", "digest", "bands").dropDuplicates(["node"]), "reps")
    shared = reps.select("node", F.explode("bands").alias("band"))
    counts = shared.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    buckets = stage(shared.join(counts, "band"), "buckets")
    central = stage(buckets.groupBy("node").agg(F.sum("n").alias("centrality")), "central")
    leads = buckets.join(central, "node").groupBy("band").agg(F.max(F.struct("centrality", (-F.col("node")).alias("minus"))).alias("top"))
    leads = leads.select("band", (-F.col("top.minus")).alias("lead"))
    pairs = buckets.select("band", "node").join(leads, "band").where("node <> lead").select("lead", "node").distinct()
    pairs = stage(pairs, "pairs")
    wanted = stage(reps.select("node", "key", "digest").join(central.select("node"), "node"), "wanted")
    texts = source.select("key", "digest", "text").join(small(wanted), ["key", "digest"]).select("node", "text")
    texts = stage(texts.dropDuplicates(["node"]), "texts")
    links = stage(_starred(pairs, texts), "links")
    rows = _open(buckets, components(links))
    more = stage(_starred(_few(rows, pairs), texts), "few")
    blocks = _blocks(rows, texts.join(reps.select("node", "bands"), "node"))
    most = stage(blocks.groupBy("band", "task").applyInArrow(_meet, "a long, b long"), "blocks")
    labels = components(links.unionByName(more).unionByName(most))
    named = stage(labels.join(classes.select("node", "rep"), "node"), "named")
    tops = named.groupBy("comp").agg(F.min("rep").alias("top"))
    labels = stage(named.select("node", "comp").join(tops, "comp").select("node", "top"), "tops")
    return members.join(labels, "node", "left").select(*_ROW, "rep", F.coalesce("top", "rep").alias("top"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, ``class_id`` (the least id of its class) and ``copy_of`` (its representative)."""
    found = _classified(docs, id_col, text_col)
    return found.select(F.when(~F.col("unnamed"), F.col("key")).alias(id_col), F.col("top.key").alias("class_id"), F.col("rep.key").alias("copy_of"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: of its least id.  Rows without an id stay if no other is of their class."""
    found = stage(_classified(docs, id_col, text_col), "found")
    stays = found.where((F.col("key") == F.col("top.key")) & (F.col("digest") == F.col("top.digest")))
    stays = stage(stays.groupBy(F.col("key").alias("_key"), F.col("digest").alias("_digest")).agg(F.count("*").alias("_n")), "stays")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), -F.abs(F.xxhash64(text)) - 1)
    kept = docs.withColumns({"_key": key, "_digest": F.xxhash64(text)}).join(stays, ["_key", "_digest"])
    # rows that repeat the one that stays: few, so only these are dealt by it
    alone, again = kept.where("_n = 1"), kept.where("_n > 1").dropDuplicates(["_key", "_digest"])
    return alone.unionByName(again).select(docs.columns)


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
