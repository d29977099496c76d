"""Operator 8: near-duplicate documents by DartMinHash. Hashed darts are thrown
into the regions of weighted elements, the earliest of each coordinate makes
the signature, and bands of coordinates name the candidates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dropped, with_row_key, written

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bounds of the rank regions below 1; above, regions double.
_RANKS = [0.0, 2.0**-10, 2.0**-7, 2.0**-4, 2.0**-2, 1.0]


@dataclass(frozen=True)
class Params:
    """bands of rows coordinates. At similarity 0.8 a pair shares no band with
    probability (1 - 0.8**7)**36, about 0.0002; at 0.85 under 0.000001."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 36
    rows: int = 7
    darts: int = 8  # expected darts a coordinate in the first throw
    counts: bool = False  # weigh a shingle by its count in the text; else by 1
    batch_elements: int = 50_000
    group_rows: int = 2000  # rows that share a copy of a hub's set
    block_shingles: int = 500_000  # shingles of a bucket that are dealt out together
    broadcast_ids: int = 1_000_000  # most ids that are broadcast (8 MB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _poisson_table(mean: float) -> np.ndarray:
    n = int(mean + 12 * mean**0.5 + 12)
    k = np.arange(1, n + 1)
    logs = -mean + np.concatenate([[0.0], np.cumsum(np.log(mean / k))])
    return np.cumsum(np.exp(logs))


_TABLES: dict[int, tuple[float, float, np.ndarray]] = {}


def _region(i: int) -> tuple[float, float, np.ndarray]:
    if i not in _TABLES:
        low = _RANKS[i] if i < len(_RANKS) else 2.0 ** (i - len(_RANKS) + 1)
        high = _RANKS[i + 1] if i + 1 < len(_RANKS) else 2.0 ** (i - len(_RANKS) + 2)
        _TABLES[i] = (low, high, _poisson_table(high - low))
    return _TABLES[i]


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int, darts: int = 8) -> np.ndarray:
    """(n, k) signatures of n weighted sets, given as the elements' 64-bit
    hashes, their positive weights and the set (0 to n - 1) that each is in.

    An element of weight w has the region from 0 to w times all ranks; darts
    fall there at rate 1, fixed by hashes of the element, the unit of its weight
    and the rank region. Each dart has a coordinate; a set keeps the dart of
    least rank of each. Two sets agree in a coordinate with the probability of
    their weighted Jaccard similarity. Only ranks up to a limit are thrown; a
    set with a coordinate left empty is thrown again with twice the limit. A set
    without elements has zeros.
    """
    out = np.zeros((n, k), np.uint64)
    # each element's weight in units: unit j holds weights j to j + 1
    units = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), units)
    unit = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    part = np.minimum(1.0, weights[at] - unit)
    base = mixed(elements[at] + _GOLD * (unit.astype(np.uint64) + np.uint64(1)))
    own = owner[at]
    total = np.bincount(owner, weights=weights, minlength=n)
    limit = np.where(total > 0, darts * k / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        sel = todo[own]
        e, o, p = base[sel], own[sel], part[sel]
        best = np.full(n * k, np.inf)
        sig = np.zeros(n * k, np.uint64)
        i = 0
        while True:
            low, high, table = _region(i)
            on = limit[o] > low
            if not on.any():
                break
            e, o, p = e[on], o[on], p[on]
            h = mixed(e + np.uint64((i + 101) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
            count = np.searchsorted(table, (h >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
            of = np.repeat(np.arange(len(e)), count)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            d = mixed(h[of] + _GOLD * (nth.astype(np.uint64) + np.uint64(1)))
            rank = low + (high - low) * ((d >> np.uint64(32)).astype(np.float64) * 2.0**-32)
            keep = rank <= limit[o[of]]
            if (p < 1).any():  # a dart beyond the element's weight misses
                keep &= (mixed(d) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < p[of]
            d, rank, of = d[keep], rank[keep], of[keep]
            slot = o[of] * k + (((d & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(best, slot, rank)
            first = rank == best[slot]
            sig[slot[first]] = d[first]
            i += 1
        full = np.isfinite(best).reshape(n, k).all(axis=1) & todo
        out[full] = sig.reshape(n, k)[full]
        todo &= ~full
        limit = limit * 2
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = sig.reshape(len(sig), bands, rows)
    h = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD), x.shape[:2]).copy()
    for j in range(rows):
        h = mixed(h ^ x[:, :, j])
    return h.view(np.int64)


class Words(dict):
    """64-bit hashes of words; the size bounds memory only."""

    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


def weighted(text: str, size: int, cache: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, in order, and the counts of all runs of size words
    (lower case, between white space); of a shorter text its words together;
    none of an empty one."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
    m = max(1, len(h) - size + 1)
    s = np.full(m, np.uint64(len(w) if len(w) < size else size))
    for j in range(min(size, len(h))):
        s = mixed(s * _GOLD + h[j: j + m])
    return np.unique(s, return_counts=True)


def shingles(text: str, size: int, cache: Words) -> np.ndarray:
    return weighted(text, size, cache)[0]


def units(text: str, p: Params, cache: Words) -> np.ndarray:
    """Distinct hashes whose Jaccard similarity is that of the weighted sets: a
    shingle itself and, with p.counts, one more for each further time it occurs."""
    s, n = weighted(text, p.words, cache)
    if not p.counts:
        return s
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.unique(mixed(np.repeat(s, n) + _GOLD * nth.astype(np.uint64)))


def _described(docs: DataFrame, p: Params) -> DataFrame:
    """(rid, same, n, bands): same identifies the weighted set of shingles."""

    def run(batches):
        import xxhash

        cache = Words()
        for pdf in batches:
            texts, rids = pdf["text"].tolist(), pdf["rid"].to_numpy()
            low = 0
            while low < len(texts):
                sets, counts, held, high = [], [], 0, low
                while high < len(texts) and held < p.batch_elements:
                    x, c = weighted(texts[high], p.words, cache)
                    sets.append(x)
                    counts.append(c if p.counts else np.ones(len(x), np.int64))
                    held += int(counts[-1].sum())
                    high += 1
                owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                sig = signatures(np.concatenate(sets), np.concatenate(counts).astype(np.float64), owner, len(sets), p.bands * p.rows, p.darts)
                yield pd.DataFrame({
                    "rid": rids[low:high], "same": [xxhash.xxh3_128_digest(x.tobytes() + c.tobytes()) for x, c in zip(sets, counts)],
                    "n": [int(c.sum()) for c in counts], "bands": list(band_keys(sig, p.bands, p.rows)),
                })
                low = high

    return docs.select("rid", "text").mapInPandas(run, "rid long, same binary, n long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """(rid, shingles) of the documents in wanted (rid), as 64-bit hashes."""

    def run(batches):
        cache = Words()
        for pdf in batches:
            for low in range(0, len(pdf), 500):
                some = pdf.iloc[low: low + 500]
                sets = [units(t, p, cache).astype("<u8").tobytes() for t in some["text"]]
                yield pd.DataFrame({"rid": some["rid"].to_numpy(), "shingles": sets})

    wanted = written(wanted, "wanted")
    few = F.broadcast(wanted) if wanted.count() <= p.broadcast_ids else wanted
    return docs.select("rid", "text").join(few, "rid", "left_semi").mapInPandas(run, "rid long, shingles binary")


def linked(docs: DataFrame, pairs: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose similarity is p.similarity or more.

    Each set is sent once a pair, a hub's own set once for every p.group_rows
    of its pairs, which are dealt out by salt; rows of a group arrive hub first
    and are compared as they pass, so a task holds one set at a time.
    """
    pairs = written(pairs, "pairs")
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / p.group_rows).alias("salts"))
    salted = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    rows = salted.select("a", "salt", F.col("b").alias("rid")).union(salted.select("a", "salt", F.col("a").alias("rid")).distinct())
    sets = _sets(docs, rows.select("rid").distinct(), p)
    dealt = rows.join(sets, "rid").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("rid") != F.col("a"))

    def run(batches):
        hub, own = None, None
        for pdf in batches:
            a_out, b_out = [], []
            for a, salt, rid, raw in zip(pdf["a"], pdf["salt"], pdf["rid"], pdf["shingles"]):
                s = np.frombuffer(raw, "<u8")
                if rid == a:
                    hub, own = (a, salt), s
                    continue
                assert hub == (a, salt)
                small, large = sorted((len(s), len(own)))
                if large and small >= p.similarity * large:
                    both = len(np.intersect1d(s, own, assume_unique=True))
                    if both >= p.similarity * (len(s) + len(own) - both):
                        a_out.append(a)
                        b_out.append(rid)
            yield pd.DataFrame({"a": np.array(a_out, np.int64), "b": np.array(b_out, np.int64)})

    return dealt.mapInPandas(run, "a long, b long")


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin to begin + n - 1 of each, in a row."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def joined(comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float, chunk: int = 1 << 22) -> list[tuple[int, int]]:
    """Pairs of at least the similarity that join all the components that such
    pairs join; sets have distinct elements. Pairs of two sides only, unless all
    are of one.

    Exact: of two alike sets, each cut to its rarest elements, as many as leave
    too few for the similarity, some element is in both. A pair has a member
    outside the largest component, so those alone look for others.
    """
    _, root, size = np.unique(comp, return_inverse=True, return_counts=True)
    if len(size) < 2:
        return []
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rank[at]
    token = token[np.lexsort((token, owner))]
    begin = np.cumsum(n) - n
    rare = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    rare = np.minimum(rare, n)
    head = _ranges(begin, rare)
    by = np.argsort(token[head], kind="stable")
    held = owner[head][by]
    held_n = np.bincount(token[head], minlength=len(count))
    held_at = np.cumsum(held_n) - held_n
    both_sides = len(np.unique(side)) > 1
    has = np.zeros(len(count), bool)
    out = []
    for x in np.flatnonzero(root != size.argmax()).tolist():
        t = token[begin[x]: begin[x] + rare[x]]
        c = np.unique(held[_ranges(held_at[t], held_n[t])])
        c = c[(root[c] != root[x]) & (np.minimum(n[c], n[x]) >= similarity * np.maximum(n[c], n[x]))]
        if both_sides:
            c = c[side[c] != side[x]]
        if not len(c):
            continue
        has[token[begin[x]: begin[x] + n[x]]] = True
        step = max(1, chunk // int(n[c].max()))
        for low in range(0, len(c), step):
            some = c[low: low + step]
            some = some[root[some] != root[x]]
            if not len(some):
                continue
            both = np.add.reduceat(has[token[_ranges(begin[some], n[some])]].astype(np.int64), np.cumsum(n[some]) - n[some])
            for y in some[both >= similarity * (n[some] + n[x] - both)].tolist():
                if root[y] != root[x]:
                    out.append((x, y))
                    root[root == root[y]] = root[x]
        has[token[begin[x]: begin[x] + n[x]]] = False
    return out


def _placed(shared: DataFrame, comp: DataFrame, p: Params) -> DataFrame:
    """(bucket, rid, comp, top, seekers, targets) of the rows of shared (bucket,
    rid, n) in buckets that span components of comp (node, comp): the component
    that holds most shingles of the bucket, and the blocks of the others'
    shingles and of its own. A bucket of at most p.block_shingles has no targets
    and one block."""
    rows = shared.join(comp, shared.rid == comp.node, "left").select("bucket", "rid", "n", F.coalesce("comp", "rid").alias("comp"))
    most = rows.groupBy("bucket", "comp").agg(F.sum("n").alias("m")).groupBy("bucket").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("held"), F.count(F.lit(1)).alias("comps"))
    small = F.col("held") <= p.block_shingles
    blocks = most.where("comps > 1").select(
        "bucket", F.col("top.comp").alias("top"),
        F.when(small, F.lit(1)).otherwise(F.ceil((F.col("held") - F.col("top.m")) / p.block_shingles)).alias("seekers"),
        F.when(small, F.lit(0)).otherwise(F.ceil(F.col("top.m") / p.block_shingles)).alias("targets"),
    )
    return rows.join(blocks, "bucket").select("bucket", "rid", "comp", "top", "seekers", "targets")


def _dealt(placed: DataFrame) -> DataFrame:
    """(bucket, lo, hi, rid, comp, side) of each task that a row of _placed()
    goes to: the tasks are the pairs of two blocks of seekers, and of one of
    seekers and one of targets. Targets, one component, never meet each other."""
    target = (F.col("comp") == F.col("top")) & (F.col("targets") > 0)
    side = F.when(target, F.col("seekers") + F.pmod(F.xxhash64("rid"), F.col("targets"))).otherwise(F.pmod(F.xxhash64("rid"), F.col("seekers")))
    met = F.when(target, F.col("seekers")).otherwise(F.col("seekers") + F.col("targets"))
    own = placed.select("bucket", "rid", "comp", side.alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), met - 1)).alias("other"))
    return own.select("bucket", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "rid", "comp", "side")


def _joined(keyed: DataFrame, placed: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) of p.similarity or more that join the components of each
    bucket of _placed() as all its pairs do.

    A large bucket is dealt out in blocks by rid, so what a task holds does not
    grow with the bucket. Rows of its largest component, in a hot bucket nearly
    all of them, are copied once a block of the others, not once a block.
    """
    placed = written(placed, "large")
    rows = _dealt(placed)
    sets = _sets(keyed, placed.select("rid").distinct(), p)
    dealt = rows.join(sets, "rid").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def run(batches):
        key, rid, comp, side, sets = None, [], [], [], []

        def work():
            got = joined(np.array(comp), np.array(side), sets, p.similarity)
            return pd.DataFrame([(rid[i], rid[j]) for i, j in got], columns=["a", "b"]).astype("int64")

        for pdf in batches:
            for b, lo, hi, r, c, s, raw in zip(pdf["bucket"], pdf["lo"], pdf["hi"], pdf["rid"], pdf["comp"], pdf["side"], pdf["shingles"]):
                if key != (b, lo, hi):
                    if rid:
                        yield work()
                    key, rid, comp, side, sets = (b, lo, hi), [], [], [], []
                rid.append(r)
                comp.append(c)
                side.append(s)
                sets.append(np.frombuffer(raw, "<u8"))
        if rid:
            yield work()

    return dealt.mapInPandas(run, "a long, b long")


def _contracted(links: DataFrame, comp: DataFrame) -> DataFrame:
    """links (a, b) between the components comp (rid, c) of their ends."""
    for side in ("a", "b"):
        links = links.join(comp.withColumnRenamed("rid", side), side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
    return links.select("a", "b")


def classes(keyed: DataFrame, p: Params = Params()) -> DataFrame:
    """(rid, class) of every row of keyed (rid, text): rows are in a class if a
    chain of pairs of p.similarity or more joins them; class is its least rid.

    Rows with equal weighted sets are one from the start. Each of the others is
    first compared with one head, the least of all it shares a bucket with: one
    comparison a row, which makes one component of a large group of near copies.
    What is left are the buckets that still span components. Their sets meet by
    their rarest shingles (joined), so every pair that shares a band is linked,
    compared or excluded by a bound, whatever the size of its bucket.
    """
    s = written(_described(keyed, p), "signatures")
    rep = s.groupBy("same").agg(F.min("rid").alias("rep"))
    members = written(s.join(rep, "same").select("rid", "rep", "n", F.when(F.col("rid") == F.col("rep"), F.col("bands")).alias("bands")), "members")
    rows = members.where("rid = rep and n > 0").select("rid", "n", F.explode("bands").alias("bucket"))
    least = rows.groupBy("bucket").agg(F.min("rid").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    shared = written(rows.join(least, "bucket").select("bucket", "rid", "n", "a"), "buckets")
    heads = shared.where("rid <> a").groupBy("rid").agg(F.min("a").alias("a")).select("a", F.col("rid").alias("b"))
    links = written(linked(keyed, heads, p), "links")
    first = written(components(links), "components")
    more = written(_joined(keyed, _placed(shared, first, p), p), "more")
    comp = first.select(F.col("node").alias("rid"), F.col("comp").alias("c"))
    second = components(_contracted(more, comp))
    top = members.select("rid", "rep").join(comp, F.col("rep") == comp.rid, "left").select(members.rid, F.coalesce("c", "rep").alias("c"))
    out = written(top.join(second, top.c == second.node, "left").select("rid", F.coalesce("comp", "c").alias("class")), "classes")
    dropped(s, members, shared, links, first, more)
    return out


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and kept (whether it is
    the one that stays) of every row of docs.

    Null texts count as empty; texts without words are one class. Repeated rows
    and equal texts are in one class and one of them stays; null doc_ids come
    first in the order and make the class's id null only if they are its least.
    An empty table gives no rows. Columns other than doc_id and text are not
    read.
    """
    keyed = with_row_key(docs, "doc_id", "text")
    c = classes(keyed, p)
    if keyed.own_ids:
        return c.select(F.col("rid").alias("doc_id"), F.col("class").alias("class_id"), (F.col("rid") == F.col("class")).alias("kept"))
    ids = keyed.select("rid", "doc_id")
    heads = ids.join(c.select(F.col("class").alias("rid")).distinct(), "rid").select(F.col("rid").alias("class"), F.col("doc_id").alias("class_id"))
    return c.join(ids, "rid").join(heads, "class").select("doc_id", "class_id", (F.col("rid") == F.col("class")).alias("kept"))


def deduplicated(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs of which near_duplicates() keeps one a class, columns
    as given. Null and empty texts are one class; of repeated rows one stays; an
    empty table gives no rows."""
    keyed = with_row_key(docs, "doc_id", "text", carry=True)
    stays = written(classes(keyed, p).where("rid = class").select("rid"), "stays")
    few = F.broadcast(stays) if stays.count() <= p.broadcast_ids else stays
    return keyed.join(few, "rid", "left_semi").select("row.*")


def op8_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
