"""Removal of byte passages that an earlier document has, by common-prefix intervals of enhanced suffix arrays.

Every window of LENGTH bytes has an anchor: the smallest hash of its 20-byte grams. Equal windows have equal anchors, so the
suffixes of all texts are dealt out by anchor and each anchor's suffixes are sorted by themselves. Only anchors in two
documents or more matter; the first step finds them from packed hashes. In each part a suffix array with common
prefix lengths is built over the different contexts of its anchors, a stack scan walks its interval tree, and each interval of
LENGTH or more bytes whose members differ in the byte before (or start their context) is a maximal repeat group with all
occurrences. A group's bytes are removed in every document but its first. Anchors in more than HOT of the documents
are dealt out by window instead, and equal contexts of a shard travel once, so a passage in a third of all
documents doesn't meet in one task.

Cases: a null text is empty; texts shorter than LENGTH keep all; documents with equal ids don't remove from each other; a null id
removes and loses nothing; overlaps count, judged on the input; an empty table gives an empty result; other columns take no part.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termflow.llm.textarr import BLOCK_BYTES, blocks, mix, powers
from termflow.session import materialize

LENGTH, GRAM = 50, 20
#: Bytes of text in one shard, on average.
SHARD_BYTES = 16 << 20
#: Share of the documents from which an anchor is dealt out by window.
HOT = 0.001
#: Suffixes sorted at a time.
CHUNK = 1 << 20
_STEP = 1 << 19
_POS = np.uint64((1 << 20) - 1)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns if len(c)))


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, s in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, np.uint8, n * s, at).reshape(s, n).T.copy().view(k).ravel())
        at += n * s
    return out


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each position."""
    n = len(data) - size + 1
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * inverse[:n])


def anchored(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, anchor hash) of each run of windows with one anchor."""
    span = length - GRAM + 1
    out: list[tuple[np.ndarray, ...]] = []
    for s in range(0, max(0, len(data) - length + 1), _STEP):
        part = data[s:s + _STEP + length - 1]
        h = gram_hashes(part, GRAM)
        m = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < span:
            m = np.minimum(m[:len(m) - (span - width)], m[span - width:])
        anchor = (m & _POS).astype(np.int64)
        start = s + np.arange(len(anchor))
        row = np.searchsorted(off, start, "right") - 1
        ok = start + length <= off[row + 1]
        change = np.ones(len(anchor), bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])
        at = np.flatnonzero(change)
        size = np.diff(np.append(at, len(anchor)))
        keep = ok[at]
        at, size = at[keep], size[keep]
        out.append((row[at], start[at], size, h[anchor[at]] >> np.uint64(16)))  # 48 bits: a chance meeting costs a comparison only
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def context_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Hash of each context: its bytes, the byte before, its number of windows."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    body = (sums[start + size + length - 1] - sums[start]) * inverse[start]
    return mix(body + mix(left.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)))


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after the other."""
    end = np.cumsum(size)
    return data[np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


class Contexts:
    """The windows of a block that stand at repeated anchors, with their bytes."""

    def __init__(self, data: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, off: np.ndarray, hot: np.ndarray, length: int):
        at = np.searchsorted(hot, anchor)
        at[at == len(hot)] = 0
        is_hot = (hot[at] == anchor) if len(hot) else np.zeros(len(anchor), bool)
        if is_hot.any():  # one context a window, keyed by the window
            n = size[is_hot]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            each = np.repeat(start[is_hot], n) + step
            wins = gram_hashes(data, length)
            row = np.concatenate([row[~is_hot], np.repeat(row[is_hot], n)])
            anchor = np.concatenate([anchor[~is_hot], wins[each]])
            start, size = np.concatenate([start[~is_hot], each]), np.concatenate([size[~is_hot], np.ones(len(each), np.int64)])
        self.row, self.start, self.size, self.key = row, start, size, anchor
        self.left = np.where(start > off[row], data[np.maximum(start - 1, 0)].astype(np.int16), np.int16(-1))
        self.hash = context_hashes(data, start, size, self.left, length)


def intervals(lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int, bool]]:
    """(common prefix, first, last, left-diverse) of every interval of the tree with `least` bytes or more, children first.

    lcp[i] is that of suffixes i and i + 1. left: byte before each suffix, below 0 if nothing stands before it.
    """
    stack: list[list[int]] = []  # prefix, first, left byte (-2: different ones)
    for i in range(len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        first, seen = i, left[i] if left[i] >= 0 else -2
        while stack and stack[-1][0] > now:
            length, first, before = stack.pop()
            if before != seen:
                seen = -2
            yield length, first, i, seen == -2
        if now >= least:
            if stack and stack[-1][0] == now:
                if stack[-1][2] != seen:
                    stack[-1][2] = -2
            else:
                stack.append([now, first, seen])


def repeat_groups(data: np.ndarray, base: np.ndarray, sizes: np.ndarray, before: np.ndarray, least_doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(context, offset, bytes, first document, group hash) of each occurrence of a maximal repeat group among different contexts.

    Context i has sizes[i] windows from data[base[i]] on, `before` is the byte before it or -1, least_doc the least id of
    the documents that have it. Windows that stand once are no repeats and don't enter the suffix array.
    """
    lengths = sizes + length - 1
    words = -(-int(lengths.max()) // 8)
    who = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    window = gram_hashes(data, length)[base[who] + step]
    by = np.argsort(window, kind="stable")
    same = window[by][1:] == window[by][:-1]
    twice = np.zeros(len(window), bool)
    twice[by[1:]] |= same
    twice[by[:-1]] |= same
    who, step = who[twice], step[twice]
    if not len(who):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    text = np.concatenate([data, np.zeros(8 * words + 8, np.uint8)])
    pos, room = base[who] + step, lengths[who] - step
    word = np.zeros(len(text) - 7, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | text[j:len(text) - 7 + j]
    # bytes past the context count as the smallest, and of equal suffixes the shorter stands first: it parts no longer ones
    masks = np.array([((1 << 64) - 1) ^ ((1 << 8 * (8 - v)) - 1) for v in range(9)], np.uint64)
    keys = [word[pos + 8 * j] & masks[np.clip(room - 8 * j, 0, 8)] for j in range(words)]
    order = np.lexsort([room, *keys[::-1]])
    same, lcp = np.ones(len(order) - 1, bool), np.zeros(len(order) - 1, np.int64)
    for k in keys:
        diff = k[order[1:]] ^ k[order[:-1]]
        for byte in range(8):  # equal leading bytes
            lcp += same & (diff < np.uint64(1 << 8 * byte))
        same &= diff == 0
    lcp = np.minimum(lcp, np.minimum(room[order[1:]], room[order[:-1]]))
    left = np.where(step[order] > 0, text[np.maximum(pos[order] - 1, 0)].astype(np.int64), before[who[order]].astype(np.int64))
    out: list[tuple[np.ndarray, ...]] = []
    edge = np.flatnonzero(lcp < length)
    firsts, lasts = np.append(0, edge + 1), np.append(edge, len(order) - 1)
    for a, b in zip(firsts[lasts > firsts].tolist(), lasts[lasts > firsts].tolist(), strict=True):
        member = order[a:b + 1]
        docs = least_doc[who[member]]
        for size, i, j, diverse in intervals(lcp[a:b].tolist(), left[a:b + 1].tolist(), length):
            part = member[i:j + 1]
            if diverse or (step[part] == 0).any():  # else the group one byte to the left has all this
                n = len(part)
                p = int(pos[part[0]])
                g = int.from_bytes(hashlib.blake2b(text[p:p + size].tobytes(), digest_size=8).digest(), "little", signed=True)
                out.append((who[part], step[part], np.full(n, size), np.full(n, docs[i:j + 1].min()), np.full(n, g)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


def _prime(n: int) -> int:
    while n > 2 and any(n % i == 0 for i in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def _different(key: np.ndarray, hash_: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position, least and largest id of each different context."""
    if not len(key):
        return np.zeros(0, np.int64), lo, hi
    order = np.lexsort((hash_, key))
    k, x = key[order], hash_[order]
    at = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (x[1:] != x[:-1])))
    return order[at], np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at)


def _chunks(key: np.ndarray, size: np.ndarray, most: int) -> list[int]:
    """Cuts between sorted keys, so that each chunk but those of one key has about `most` windows."""
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    total, cuts = np.cumsum(size), [0]
    while cuts[-1] < len(key):
        want = (total[cuts[-1] - 1] if cuts[-1] else 0) + most
        i = int(np.searchsorted(total[ends - 1], want, "right")) - 1
        nxt = ends[max(i, int(np.searchsorted(ends, cuts[-1], "right")))]
        cuts.append(int(nxt))
    return cuts


def _by_value(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, positions) of each value."""
    if not len(values):
        return
    order = np.argsort(values, kind="stable")
    at = np.flatnonzero(np.append(True, values[order][1:] != values[order][:-1]))
    for a, b in zip(at, np.append(at[1:], len(values)), strict=True):
        yield int(values[order[a]]), order[a:b]


ITEM = (np.uint64, np.int64)
TEXTS = (np.int64, np.int64)
META = (np.uint64, np.int64, np.int64, np.int16, np.int16)
FOUND = (np.uint64, np.int16, np.int16, np.int64, np.int64)


def _plan(docs: DataFrame, id_col: str, text: str, length: int, named: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """The texts by shard, and what is known of each shard's passages: repeated anchors and the groups (by name, if asked) their contexts are in."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_docs, n_bytes = base.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = _prime(max(3, n_bytes // SHARD_BYTES))
    hot_docs = max(4096, int(HOT * n_docs))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: an anchor and the document it is in, or -1 if several of the batch (they are passed on as kind 1)."""
        for batch in batches:
            ids, rows, hashes = batch.column(0).to_numpy(zero_copy_only=False), [], []
            for first, _, data, off in blocks(batch.column(1), lower=False, tail=""):
                row, _, _, h = anchored(data, off, length)
                rows.append(row + first)
                hashes.append(h)
            h, row = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((hashes, np.uint64), (rows, np.int64)))
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, doc = h[new], ids[row[new]].astype(np.int64)
            at = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1)) != 0) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(at, len(h)))
            one_h, one_d = h[at], np.where(n == 1, doc[at], -1)
            out_kind, out_to, out_blob = [], [], []
            to = (one_h >> np.uint64(16)).astype(np.int64) % shards
            by = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[by], np.arange(shards + 1))
            for s in range(shards):
                p = by[cut[s]:cut[s + 1]]
                if len(p):
                    out_kind.append(0)
                    out_to.append(s)
                    out_blob.append(pack(one_h[p], one_d[p], n[p]))
            many = np.repeat(n > 1, n)
            mh, md = h[many], doc[many]
            to = md % shards
            by = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[by], np.arange(shards + 1))
            for s in range(shards):
                p = by[cut[s]:cut[s + 1]]
                if len(p):
                    out_kind.append(1)
                    out_to.append(s)
                    out_blob.append(pack(mh[p], md[p]))
            if out_kind:
                yield pa.RecordBatch.from_arrays([pa.array(out_kind, pa.int32()), pa.array(out_to, pa.int64()), pa.array(out_blob, pa.binary())], ["kind", "dest", "blob"])

    def repeated(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """kind 1: anchors of a document that other documents have too; kind 2: hot anchors, to every shard."""
        kind = pdf["kind"].to_numpy()
        out = [(1, keys[0], b) for b in pdf["blob"][kind == 1]]
        parts = [unpack(b, np.uint64, np.int64, np.int64) for b in pdf["blob"][kind == 0]]
        if parts:
            h, doc, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            h, doc, n = h[order], doc[order], n[order]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            count = np.diff(np.append(at, len(h)))
            flag = np.repeat(count > 1, count) & (doc >= 0)
            fh, fd = h[flag], doc[flag]
            to = fd % shards
            by = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[by], np.arange(shards + 1))
            out += [(1, s, pack(fh[p], fd[p])) for s in range(shards) if len(p := by[cut[s]:cut[s + 1]])]
            hot = h[at][np.add.reduceat(n, at) > hot_docs]
            if len(hot):
                blob = pack(hot, np.zeros(len(hot), np.int64))
                out += [(2, s, blob) for s in range(shards)]
        return pd.DataFrame(out, columns=["kind", "shard", "blob"])

    known = base.where("id is not null")
    packed = known.mapInArrow(anchors, "kind int, dest long, blob binary")
    flags = materialize(packed.groupBy("dest").applyInPandas(repeated, "kind int, shard long, blob binary"), "suffix-anchors")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of a batch by shard, compressed together."""
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            size = np.array([len(t) for t in raw], np.int64)
            rows = [(s, pack(ids[i], size[i]), zstandard.ZstdCompressor(level=3).compress(b"".join([raw[j] for j in i]))) for s, i in _by_value(ids % shards)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "meta", "body"])

    texts = known.mapInArrow(bundle, "shard long, meta binary, body binary")

    def contexts(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The shard's different contexts, each with the least and the largest id of the documents that have it, packed by part."""
        parts, texts_, at = [], [], 0
        for ids, _, data, c in _windows(left, right, length):
            d = ids[c.row]
            first, lo, hi = _different(c.key, c.hash, d, d)
            size = c.size[first]
            texts_.append(gather(data, c.start[first], size + length - 1))
            end = np.cumsum(size + length - 1)
            parts.append((c.key[first], c.hash[first], lo, hi, size, c.left[first], at + end - (size + length - 1)))
            at += len(texts_[-1])
        if not at:
            return pd.DataFrame([], columns=["shard", "dest", "meta", "ctx"])
        key, hash_, lo, hi, size, before, base = (np.concatenate(x) for x in zip(*parts, strict=True))
        first, lo, hi = _different(key, hash_, lo, hi)
        key, size, before, base, data = key[first], size[first], before[first], base[first], np.concatenate(texts_)
        dest = (key % np.uint64(shards)).astype(np.int64)
        by = np.argsort(dest, kind="stable")
        cut, out = np.searchsorted(dest[by], np.arange(shards + 1)), []
        for p in range(shards):
            i = by[cut[p]:cut[p + 1]]
            if len(i):
                meta = pack(key[i], lo[i], hi[i] - lo[i], size[i].astype(np.int16), before[i])
                out.append((keys[0], p, meta, zstandard.ZstdCompressor(level=3).compress(gather(data, base[i], size[i] + length - 1).tobytes())))
        return pd.DataFrame(out, columns=["shard", "dest", "meta", "ctx"])

    own = texts.groupBy("shard").cogroup(flags.groupBy("shard")).applyInPandas(contexts, "shard long, dest long, meta binary, ctx binary")

    def groups(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """kind 3: for each shard the groups that its contexts of this part are in."""
        metas = [unpack(m, *META) for m in pdf["meta"]]
        key, lo, hi, size, before = (np.concatenate(x) for x in zip(*metas, strict=True))
        size, shard = size.astype(np.int64), np.repeat(pdf["shard"].to_numpy(), [len(m[0]) for m in metas])
        hi = lo + hi
        data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(c) for c in pdf["ctx"]), np.uint8)
        base = np.cumsum(size + length - 1) - (size + length - 1)
        hash_ = np.concatenate([context_hashes(data[base[a]:base[b - 1] + size[b - 1] + length - 1], base[a:b] - base[a], size[a:b], before[a:b], length) for a, b in ((i, min(i + 100_000, len(size))) for i in range(0, len(size), 100_000))])
        order = np.lexsort((hash_, key))
        shard, key, lo, hi, size, before, base, hash_ = (x[order] for x in (shard, key, lo, hi, size, before, base, hash_))
        cuts = _chunks(key, size, CHUNK)
        out: dict[int, list] = {}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            new = np.append(True, (key[a + 1:b] != key[a:b - 1]) | (hash_[a + 1:b] != hash_[a:b - 1]))
            at, which = a + np.flatnonzero(new), np.cumsum(new) - 1
            low, high = np.minimum.reduceat(lo[a:b], at - a), np.maximum.reduceat(hi[a:b], at - a)
            n = size[at]
            part = gather(data, base[at], n + length - 1)
            c, off, m, doc, g = repeat_groups(part, np.cumsum(n + length - 1) - (n + length - 1), n, before[at], low, length)
            whole = np.flatnonzero(low < high)  # equal contexts in several documents are a group by themselves
            c, off, m, doc, g = (np.concatenate(x) for x in ((c, whole), (off, np.zeros(len(whole), np.int64)), (m, n[whole] + length - 1), (doc, low[whole]), (g, hash_[at][whole].view(np.int64))))
            by = np.argsort(c, kind="stable")
            c, off, m, doc, g = c[by], off[by], m[by], doc[by], g[by]
            x, y = np.searchsorted(c, which), np.searchsorted(c, which, "right")
            count = y - x
            take = np.repeat(x - (np.cumsum(count) - count), count) + np.arange(count.sum())
            line = a + np.repeat(np.arange(b - a), count)
            keep = doc[take] <= hi[line]
            take, line = take[keep], line[keep]
            for s, i in _by_value(shard[line]):
                out.setdefault(s, []).append((hash_[line[i]], off[take[i]].astype(np.int16), m[take[i]].astype(np.int16), doc[take[i]], g[take[i]] if named else np.zeros(len(i), np.int64)))
        return pd.DataFrame([(3, s, pack(*(np.concatenate(x) for x in zip(*v, strict=True)))) for s, v in out.items()], columns=["kind", "shard", "blob"])

    found = materialize(own.groupBy("dest").applyInPandas(groups, "kind int, shard long, blob binary"), "suffix-groups")
    return texts, flags.unionByName(found), shards


def _windows(left: pd.DataFrame, right: pd.DataFrame, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Contexts]]:
    """(ids, sizes, bytes, contexts) of blocks of a shard's texts; contexts at repeated anchors only."""
    kind = right["kind"].to_numpy() if len(right) else np.zeros(0)
    flag = [unpack(b, *ITEM) for b in right["blob"][kind == 1]] if len(right) else []
    hot = [unpack(b, *ITEM)[0] for b in right["blob"][kind == 2]] if len(right) else []
    hot_h = np.unique(np.concatenate(hot)) if hot else np.zeros(0, np.uint64)
    fh, fd = (np.concatenate(x) for x in zip(*flag, strict=True)) if flag else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    pair = np.unique(mix(fh + mix(fd.view(np.uint64))))
    for meta, body in zip(left["meta"], left["body"], strict=True):
        all_ids, all_sizes = unpack(meta, *TEXTS)
        whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
        ends, at = np.cumsum(all_sizes), 0
        while at < len(all_ids):
            done = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, "right")))
            ids, sizes, data = all_ids[at:end], all_sizes[at:end], whole[done:ends[end - 1]]
            off = np.concatenate([[0], np.cumsum(sizes)])
            row, start, size, h = anchored(data, off, length)
            own = mix(h + mix(ids[row].view(np.uint64)))
            hit = np.searchsorted(pair, own)
            hit[hit == len(pair)] = 0
            keep = (pair[hit] == own) if len(pair) else np.zeros(len(own), bool)
            yield ids, sizes, data, Contexts(data, row[keep], start[keep], size[keep], h[keep], off, hot_h, length)
            at = end


def _occurrences(left: pd.DataFrame, right: pd.DataFrame, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per block: ids, sizes, bytes; row, start, size, first document and name of every occurrence of a group."""
    blobs = [unpack(b, *FOUND) for b in right["blob"][right["kind"] == 3]] if len(right) else []
    tag, off, n, doc, g = (np.concatenate(x) for x in zip(*blobs, strict=True)) if blobs else (np.zeros(0, k) for k in FOUND)
    order = np.argsort(tag, kind="stable")
    tag, off, n, doc, g = tag[order], off[order].astype(np.int64), n[order].astype(np.int64), doc[order], g[order]
    for ids, sizes, data, c in _windows(left, right, length):
        a, b = np.searchsorted(tag, c.hash), np.searchsorted(tag, c.hash, "right")
        count = b - a
        take = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())
        which = np.repeat(np.arange(len(c.hash)), count)
        yield ids, sizes, data, c.row[which], c.start[which] + off[take], n[take], doc[take], g[take]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans): spans are the removed runs, [start, end) in bytes."""
    texts, known, _ = _plan(docs, id_col, text, length)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"

    def job(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, sizes, data, row, start, size, doc, _ in _occurrences(left, right, length):
            later = doc < ids[row]
            mark = np.zeros(len(data) + 1, np.int32)
            np.add.at(mark, start[later], 1)
            np.add.at(mark, (start + size)[later], -1)
            gone = np.cumsum(mark[:-1]) > 0
            at = 0
            for i, n in zip(ids.tolist(), sizes.tolist(), strict=True):
                g = gone[at:at + n]
                edge = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0))
                kept = data[at:at + n][~g]
                out.append((i, n, int(g.sum()), len(edge) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]))
                at += n
        return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    done = texts.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(job, schema)
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    nameless = nameless.select("id", F.octet_length("t").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("t", 256).alias("kept_sha256"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return done.unionByName(nameless)


def occurrences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(group_id, id, start, n_bytes, first_id): every occurrence of every maximal repeat group, within the contexts of its anchors."""
    texts, known, _ = _plan(docs, id_col, text, length, named=True)

    def job(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, sizes, _, row, start, size, doc, g in _occurrences(left, right, length):
            begin = np.concatenate([[0], np.cumsum(sizes)])
            out.append(pd.DataFrame({"group_id": g, "id": ids[row], "start": start - begin[row], "n_bytes": size, "first_id": doc}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("group_id", "id", "start", "n_bytes", "first_id")})

    return texts.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(job, "group_id long, id long, start long, n_bytes long, first_id long")
