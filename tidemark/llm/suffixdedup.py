"""Operator 10: removal of repeated byte strings by sorted suffixes. Suffixes
are gathered by content-chosen anchors, sorted deep-shallow (multikey quicksort
to a shallow depth, then blind tries for what still ties), and every string of
the match length that also starts earlier is removed."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import with_row_key, written

_BASE = 0x100000001B3
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Params:
    length: int = 100
    gram: int = 32  # bytes of an anchor: a power of two
    chunk: int = 1 << 22  # windows of a text taken at once
    hot: int = 100_000  # occurrences of an anchor above which its strings meet as digests
    block: int = 8000  # anchor occurrences sorted together
    strings: int = 120_000  # strings sorted together
    shallow: int = 2  # 8-byte words of the multikey quicksort
    broadcast_ids: int = 1_000_000  # most ids that are broadcast (8 MB)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Well-mixed 64-bit hashes of all runs of gram bytes, by doubling."""
    h = b.astype(np.uint64) + np.uint64(1)
    k = 1
    while k < gram:
        h = h[:-k] * np.uint64(pow(_BASE, k, 1 << 64)) + h[k:]
        k *= 2
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k:]) if w > k else x


def anchors(b: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): the anchor of a string of p.length bytes is
    its run of p.gram bytes of least hash, the leftmost if several; a row for
    each run of strings, starting at first to last, whose anchor is at place.
    Equal strings have their anchor at the same offset."""
    width = p.length - p.gram + 1
    got = []
    for low in range(0, len(b) - p.length + 1, p.chunk):
        part = b[low: low + p.chunk + p.length - 1]
        h = gram_hashes(part, p.gram)
        bits = np.uint64(max(1, int(len(h)).bit_length()))
        keep = (~np.uint64(0) >> bits) << bits
        packed = (h & keep) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(packed, width) & ~keep).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
        place = at[first]
        got.append((h[place].view(np.int64), place + low, first + low, last + low))
    if not got:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*got))


def _anchored(docs: DataFrame, p: Params) -> DataFrame:
    """(h, rid, code) of all texts; code packs place and the distances of the
    first and last string from it."""

    def run(batches):
        for pdf in batches:
            for low in range(0, len(pdf), 1000):
                some = pdf.iloc[low: low + 1000]
                hs, rids, codes = [], [], []
                for rid, raw in zip(some["rid"], some["bytes"]):
                    h, place, first, last = anchors(np.frombuffer(raw, np.uint8), p)
                    if len(h):
                        hs.append(h)
                        rids.append(np.full(len(h), rid, np.int64))
                        codes.append(place << 16 | (place - first) << 8 | (place - last))
                if hs:
                    yield pd.DataFrame({"h": np.concatenate(hs), "rid": np.concatenate(rids), "code": np.concatenate(codes)})

    return docs.where(F.octet_length("text") >= p.length).select("rid", F.col("text").cast("binary").alias("bytes")).mapInPandas(run, "h long, rid long, code long")


_CONTEXT = "h long, rid long, code long, context binary"


def _contexts(text: DataFrame, repeated: DataFrame, p: Params) -> DataFrame:
    """_CONTEXT rows for repeated (rid, codes): the bytes from the first string
    of each anchor to the end of its last one."""

    names = ["h", "rid", "code", "context"]

    def run(batches):
        for pdf in batches:
            out = []
            for rid, raw, codes in zip(pdf["rid"], pdf["bytes"], pdf["codes"]):
                places = np.asarray(codes) >> 16
                grams = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), p.gram)[places]
                hashes = gram_hashes(grams.T, p.gram)[0].view(np.int64)
                for h, code in zip(hashes.tolist(), codes):
                    place, a, z = int(code) >> 16, (int(code) >> 8) & 255, int(code) & 255
                    out.append((h, rid, code, raw[place - a: place - z + p.length]))
                if len(out) >= p.block:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return repeated.join(text, "rid").select("rid", "bytes", "codes").mapInPandas(run, _CONTEXT)


def _hot_repeats(text: DataFrame, hot: DataFrame, p: Params) -> DataFrame:
    """(rid, first, last) of the repeats among the strings of hot (rid, codes).

    A task sorts its strings some p.strings at a time; all but the earliest of
    equal ones are repeats. What is left, one of each block, meets as digests in
    a grouped minimum, which is taken before the shuffle too; a digest in over
    p.hot blocks is sent to all tasks, unless these are over p.broadcast_ids."""

    def sorted_out(rid, start, raw):
        strings = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), p.length)
        order, leaf = deep_shallow(strings, np.zeros(len(raw), np.int64), p)
        r, s = np.array(rid, np.int64), np.array(start, np.int64)
        again = later(order, leaf, r, s)
        first = np.ones(len(raw), bool)
        first[again] = False
        key = [hashlib.blake2b(x, digest_size=16).digest() if f else None for x, f in zip(raw, first.tolist())]
        return pd.DataFrame({"key": key, "rid": r, "start": s})

    def run(batches):
        rids, starts, raws = [], [], []
        for pdf in batches:
            for rid, raw, codes in zip(pdf["rid"], pdf["bytes"], pdf["codes"]):
                for code in map(int, codes):
                    low, high = (code >> 16) - ((code >> 8) & 255), (code >> 16) - (code & 255) + 1
                    rids += [rid] * (high - low)
                    starts += range(low, high)
                    raws += [raw[x: x + p.length] for x in range(low, high)]
                    if len(raws) >= p.strings:
                        yield sorted_out(rids, starts, raws)
                        rids, starts, raws = [], [], []
        if raws:
            yield sorted_out(rids, starts, raws)

    strings = written(hot.join(text, "rid").select("rid", "bytes", "codes").mapInPandas(run, "key binary, rid long, start long"), "strings")
    place, open_ = F.struct("rid", "start"), strings.where("key is not null")
    least = open_.groupBy("key").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1")
    least = written(least, "least")
    many = least.where(F.col("m") > p.hot)
    many = F.broadcast(many) if many.count() <= p.broadcast_ids else many
    rest = open_.join(many, "key", "left_anti").join(least.where(F.col("m") <= p.hot), "key")
    both = open_.join(many, "key").select(*rest.columns).union(rest)
    again = both.where(place != F.col("least")).select("rid", "start").union(strings.where("key is null").select("rid", "start"))
    return again.select("rid", F.col("start").alias("first"), F.col("start").alias("last"))


def _ties(order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of groups of two or more, and their groups, numbered anew."""
    if not len(order):
        return order, group
    new = np.concatenate([[True], group[1:] != group[:-1]])
    number = np.cumsum(new) - 1
    many = np.bincount(number)[number] > 1
    return order[many], (np.cumsum(new & many) - 1)[many]


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of the strings that tie with another of their group in all
    of words, whose rows are strings cut in big-endian words.

    Multikey quicksort, all segments a step at a time: each is parted by one word
    into what is less than its pivot, equal, and greater; equal ones go on with
    their next word. A string alone in its segment is sorted and leaves; a
    segment equal in every word is done.
    """
    order = np.argsort(group, kind="stable")
    order, segment = _ties(order, group[order])
    depth = np.zeros(len(order), np.int64)
    done, done_segment, parts = [], [], 0
    while len(order):
        key = words[order, depth]
        begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        size = np.diff(np.append(begin, len(order)))
        lo, mid, hi = key[begin], key[begin + size // 2], key[begin + size - 1]
        pivot = np.maximum(np.minimum(lo, mid), np.minimum(np.maximum(lo, mid), hi))[segment]
        side = (key > pivot).astype(np.int64) - (key < pivot)
        by = np.argsort(3 * segment + side, kind="stable")
        order, segment, depth, side = order[by], segment[by], depth[by], side[by]
        depth += side == 0
        part = np.cumsum(np.concatenate([[0], (segment[1:] != segment[:-1]) | (side[1:] != side[:-1])]))
        many = np.bincount(part)[part] > 1
        full = many & (depth == words.shape[1])
        if full.any():
            done.append(order[full])
            done_segment.append(part[full] + parts)
            parts += len(part)
        on = many & ~full
        order, depth = order[on], depth[on]
        segment = np.cumsum(np.concatenate([[0], np.diff(part[on]) > 0])) if len(order) else part[:0]
    if not done:
        return order, segment
    segment = np.concatenate(done_segment)
    return np.concatenate(done), np.unique(segment, return_inverse=True)[1]


def deep_shallow(text: np.ndarray, group: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(order, leaf) of the rows of text (n, bytes) that equal another of their
    group: multikey quicksort by the first 8 * p.shallow bytes, then blind tries
    of what still ties. Equal rows have equal leaves and stand together."""
    shallow = min(8 * p.shallow, text.shape[1])
    wide = np.zeros((len(text), -(-shallow // 8) * 8), np.uint8)
    wide[:, :shallow] = text[:, :shallow]
    order, segment = multikey_quicksort(wide.view(">u8").astype(np.uint64), group)
    return blind_tries(text, order, segment, min(shallow, text.shape[1] - 1))


def later(order: np.ndarray, leaf: np.ndarray, rid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of equal strings all but the earliest by (rid, start)."""
    by = np.lexsort((start[order], rid[order], leaf))
    return order[by][np.concatenate([[False], leaf[by][1:] == leaf[by][:-1]])] if len(by) else order


def blind_tries(text: np.ndarray, order: np.ndarray, group: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, leaf) of tied strings: a blind trie a group, all groups at once.

    An inner node has the depth at which the strings below it branch and a child
    for each byte there; the bytes between are not looked at. A string descends
    blindly to a leaf (from a node without its byte, to any leaf below), is
    verified there once over its rest, from start on, and ends at that leaf or
    branches off where it first differs. Strings descend together; of those that
    would part one edge at several depths the middle depth is taken, one string
    for each byte, and the others descend anew. Strings of one leaf are equal.
    """
    if not len(order):
        return order, group
    width = text.shape[1]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    number = np.cumsum(new) - 1
    leaf = order[new]  # a string below each node; nodes begin as the groups' first strings
    root, depth, link = np.arange(len(leaf)), np.full(len(leaf), width), np.full(len(leaf), -1)
    key, child = np.zeros(0, np.int64), np.zeros(0, np.int64)  # (node, byte) to node, sorted
    end = np.where(new, number, -1)
    left = np.flatnonzero(~new)

    def kids(node: np.ndarray, string: np.ndarray) -> np.ndarray:
        want = node << 8 | text[string, depth[node]]
        i = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return np.where(key[i] == want, child[i], -1)

    while len(left):
        s = order[left]
        at = root[number[left]]
        on = np.flatnonzero(depth[at] < width)
        while len(on):
            to = kids(at[on], s[on])
            on, to = on[to >= 0], to[to >= 0]
            at[on] = to
            on = on[depth[to] < width]
        differs = text[s, start:] != text[leaf[at], start:]
        prefix = np.where(differs.any(axis=1), differs.argmax(axis=1) + start, width)
        end[left[prefix == width]] = at[prefix == width]
        left, s, prefix = left[prefix < width], s[prefix < width], prefix[prefix < width]
        if not len(left):
            break
        at = root[number[left]]
        on = np.flatnonzero(depth[at] < prefix)
        while len(on):  # down to the edge or node where it branches off
            at[on] = kids(at[on], s[on])
            on = on[depth[at[on]] < prefix[on]]
        by = np.lexsort((text[s, prefix], prefix, at))
        left, s, prefix, at = left[by], s[by], prefix[by], at[by]
        head = np.concatenate([[True], at[1:] != at[:-1]])
        size = np.diff(np.append(np.flatnonzero(head), len(at)))
        middle = prefix[np.flatnonzero(head) + size // 2][np.cumsum(head) - 1]
        byte = text[s, prefix]
        one = head | np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (byte[1:] != byte[:-1])])
        taken = np.flatnonzero(one & (prefix == middle))
        at, prefix, byte, s = at[taken], prefix[taken], byte[taken], s[taken]
        # edges to part: their new nodes take the lower end's place
        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]) & (depth[at] > prefix))
        low, inner = at[edge], len(depth) + np.arange(len(edge))
        inside = link[low] >= 0
        child[np.searchsorted(key, link[low][inside])] = inner[inside]
        root[number[left[taken[edge]]][~inside]] = inner[~inside]
        up = np.arange(len(depth))
        up[low] = inner
        node, leaves = up[at], len(depth) + len(edge) + np.arange(len(taken))
        depth = np.concatenate([depth, prefix[edge], np.full(len(taken), width)])
        link = np.concatenate([link, link[low], node << 8 | byte])
        link[low] = inner << 8 | text[leaf[low], prefix[edge]]
        leaf = np.concatenate([leaf, leaf[low], s])
        key, child = np.concatenate([key, link[low], link[leaves]]), np.concatenate([child, low, leaves])
        by = np.argsort(key)
        key, child = key[by], child[by]
        end[left[taken]] = leaves
        left = np.delete(left, taken)
    by = np.argsort(end, kind="stable")
    return _ties(order[by], end[by])


def repeated_strings(h: np.ndarray, rid: np.ndarray, code: np.ndarray, context: list[bytes], p: Params):
    """(rid, first, last): the strings, as runs of their starts, that also start
    earlier by (rid, start), among whole groups of equal h."""
    place, far, near = code >> 16, (code >> 8) & 255, code & 255
    # equal contexts first: all but the earliest are repeated throughout
    same = np.unique(h, return_inverse=True)[1].ravel() << 16 | code & 0xFFFF
    wide = 2 * p.length - p.gram
    text = np.frombuffer(b"".join(c.ljust(wide, b"\0") for c in context), np.uint8).reshape(len(context), wide)
    order, leaf = deep_shallow(text, same, p)
    again = later(order, leaf, rid, place)
    out = [(rid[again], place[again] - far[again], place[again] - near[again])]
    rest = np.ones(len(h), bool)
    rest[again] = False
    rep = np.flatnonzero(rest)
    rep = rep[np.argsort(h[rep], kind="stable")]
    rep, anchor = _ties(rep, np.cumsum(np.concatenate([[0], (h[rep][1:] != h[rep][:-1]).astype(np.int64)]))) if len(rep) else (rep, rep)
    if len(rep):
        step = max(1, p.strings // len(rep))
        view = np.lib.stride_tricks.sliding_window_view(text.reshape(-1), p.length)
        for d in range(0, int(far[rep].max()) + 1, step):  # equal strings have equal distances
            low, high = np.maximum(near[rep], d), np.minimum(far[rep], d + step - 1)
            n = np.maximum(0, high - low + 1)
            of = np.repeat(np.arange(len(rep)), n)
            if not len(of):
                continue
            dist = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]
            strings = view[rep[of] * wide + far[rep][of] - dist]
            r, s = rid[rep][of], place[rep][of] - dist
            order, leaf = deep_shallow(strings, anchor[of] * 256 + dist, p)
            out.append(_runs(r, s, later(order, leaf, r, s)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _runs(rid: np.ndarray, start: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rid, first, last): the starts of some, neighbours joined."""
    some = some[np.lexsort((start[some], rid[some]))]
    r, s = rid[some], start[some]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)])) if len(r) else np.zeros(0, np.int64)
    return r[new], s[new], s[np.append(new[1:], len(s)) - 1] if len(r) else s


def _repeats(contexts: DataFrame, p: Params) -> DataFrame:
    """(rid, first, last) from _CONTEXT rows: groups of an anchor meet in one
    task, sorted, and are worked off some p.block rows at a time."""

    def run(batches):
        held: list[pd.DataFrame] = []
        rows = 0

        def worked(pdf):
            r, a, z = repeated_strings(pdf["h"].to_numpy(), pdf["rid"].to_numpy(), pdf["code"].to_numpy(), pdf["context"].tolist(), p)
            return pd.DataFrame({"rid": r, "first": a, "last": z})

        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            rows += len(pdf)
            if rows < p.block or held[0]["h"].iloc[0] == pdf["h"].iloc[-1]:
                continue
            whole = pd.concat(held, ignore_index=True)
            h = whole["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if cut:
                yield worked(whole.iloc[:cut])
            held, rows = [whole.iloc[cut:]], len(whole) - cut
        if rows:
            yield worked(pd.concat(held, ignore_index=True))

    return contexts.repartition("h").sortWithinPartitions("h").mapInPandas(run, "rid long, first long, last long")


def copies(keyed: DataFrame, p: Params = Params()) -> DataFrame:
    """(rid, first, last) of texts of p.length bytes or more that equal an
    earlier one: all of their strings are repeats."""
    long = keyed.select("rid", F.octet_length("text").cast("long").alias("n"), F.unhex(F.sha2("text", 256)).alias("digest")).where(F.col("n") >= p.length)
    least = long.groupBy("digest").agg(F.min("rid").alias("original"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return long.join(least, "digest").where("rid <> original").select("rid", F.lit(0).cast("long").alias("first"), (F.col("n") - p.length).alias("last"))


def repeats(keyed: DataFrame, text: DataFrame, p: Params = Params()) -> DataFrame:
    """(rid, first, last) for keyed (rid, text): runs of starts of strings of
    p.length bytes that also start earlier.

    Whole copies are told by digest and take no further part. Of the others only
    anchors that occur twice can lie in such strings; the rest, most of the
    text, ends at the first shuffle of 24 bytes each. The places of an anchor in
    over p.hot of them are never gathered.
    """
    whole = written(copies(keyed, p), "copies")
    few = F.broadcast(whole.select("rid")) if whole.count() <= p.broadcast_ids else whole.select("rid")
    a = _anchored(keyed.join(few, "rid", "left_anti"), p)
    hot = written(_hot(a, p), "hot")
    n_hot = hot.count()
    marked = a.join(F.broadcast(hot) if n_hot <= p.broadcast_ids else hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    # a hot anchor's places need not meet
    n = F.count(F.lit(1)).over(Window.partitionBy("hot", F.when(F.col("hot"), F.xxhash64("rid", "code")).otherwise(F.col("h"))))
    twice = marked.withColumn("n", n).where("hot or n > 1")
    if not n_hot:
        codes = twice.groupBy("rid").agg(F.collect_list("code").alias("codes"))
        return _repeats(_contexts(text, codes, p), p).unionByName(whole)
    codes = written(twice.groupBy("rid", "hot").agg(F.collect_list("code").alias("codes")), "codes")
    cold = _repeats(_contexts(text, codes.where("not hot").drop("hot"), p), p)
    return cold.unionByName(_hot_repeats(text, codes.where("hot").drop("hot"), p)).unionByName(whole)


def _hot(anchored: DataFrame, p: Params) -> DataFrame:
    """(h, hot) of the anchors in over p.hot places, hot true. Only hashes whose
    last 16 bits are in as many places are counted singly."""
    part = F.col("h").bitwiseAND(F.lit(0xFFFF))
    parts = written(anchored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > p.hot).select("part"), "parts")
    if not parts.count():
        return parts.select(F.col("part").alias("h"), F.lit(True).alias("hot"))
    some = anchored.join(F.broadcast(parts), part == F.col("part"), "left_semi")
    return some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > p.hot).select("h", F.lit(True).alias("hot"))


_CUT = "rid long, n_bytes long, n_removed long, n_spans long, kept binary"


def removed(keyed: DataFrame, p: Params = Params(), whole_characters: bool = False) -> DataFrame:
    """_CUT rows: each text's bytes without those that a repeated string covers;
    whole_characters leaves out what is left of characters cut apart."""

    def run(batches):
        for pdf in batches:
            out = []
            for rid, raw, spans in zip(pdf["rid"], pdf["bytes"], pdf["spans"]):
                if spans is None or not len(spans):
                    out.append((rid, len(raw), 0, 0, raw))
                    continue
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, [s["first"] for s in spans], 1)
                np.add.at(edge, [s["last"] + p.length for s in spans], -1)
                gone = np.cumsum(edge)[:-1] > 0
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                if whole_characters:
                    kept = kept.decode("utf-8", "ignore").encode()
                out.append((rid, len(raw), int(gone.sum()), n_spans, kept))
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in _CUT.split(", ")])
                    out = []
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _CUT.split(", ")])

    # the same exchange of texts serves both joins
    text = keyed.where("rid is not null").select("rid", F.col("text").cast("binary").alias("bytes"))
    spans = repeats(keyed, text, p).groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return text.join(spans, "rid", "left").select("rid", "bytes", "spans").mapInPandas(run, _CUT)


def without_repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that remain) of
    every row of docs.

    Texts are UTF-8; null counts as empty. Rows are ordered by doc_id (null
    first) and, where ids repeat, by text; a row that repeats another is a later
    document like any. An empty table gives no rows. Columns other than doc_id
    and text are not read.
    """
    keyed = with_row_key(docs, "doc_id", "text")
    cut = removed(keyed, p)
    if not keyed.own_ids:
        return cut.join(keyed.select("rid", "doc_id"), "rid").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    return cut.select(F.col("rid").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def cleaned(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs with text and n_chars of what remains, columns as given; a character
    of which bytes are gone goes whole. Rows of which nothing remains go; rows
    that were empty stay, with an empty text."""
    keyed = with_row_key(docs, "doc_id", "text", carry=True)
    cut = removed(keyed, p, whole_characters=True).where("n_bytes = 0 or octet_length(kept) > 0")
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = keyed.select("rid", F.struct(*(F.col("row")[c].alias(c) for c in rest)).alias("row"))
    text = F.col("kept").cast("string")
    made = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return cut.join(rows, "rid").select(*(made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in docs.columns))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
