"""Exact substring deduplication over bytes by suffix arrays.

1. Which parts can repeat at all? In every ``size``-byte window the least hash of its
   GRAM-byte grams is the window's anchor. Equal windows have equal anchors, so a window whose
   anchor occurs once in the corpus cannot repeat. Anchors (about one in 26 bytes) are counted
   like op4's windows: packed by block, dealt into buckets by hash, answered by block.
2. Windows with a repeated anchor are cut out: a region is a run of consecutive windows with
   one anchor. Regions are dealt to shards by anchor, so equal windows always meet. A block
   sends one copy of equal regions and knows the others as repeats. An anchor of more than
   HOT_REGIONS distinct regions would fill one shard: its windows are dealt one by one by the
   hash of the whole window, which equal windows share too.
3. A shard builds the suffix array of its regions by Larsson-Sadakane refinement (rank pairs
   at doubling distance, sorting only groups that are not yet told apart) and the common
   prefixes by Kasai's walk; neighbours with a common prefix of ``size`` are one window. A
   shard over PIECE_BYTES is worked piece by piece; the windows known so far are a sorted
   list in which those of the next piece are looked up by binary search. Of one window all
   occurrences but the earliest are repeats.
4. Repeats go back by block and merge into maximal spans; those of all blocks with a row of
   equal id and text are united and joined to the texts.

Occurrences are ordered by id, then by place. A row without id counts as smaller than every
id; rows of equal id are ordered by the hash of their text; rows equal in id and text are one
occurrence and get the same answer. Texts shorter than a window, empty and null ones keep all
bytes. Input columns named like the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BYTE, NO_ID, SPANS, U64, append, blocks, column, covered, cuts, longs, mix, partitions, powers, rolled, runs, spans_array, table_column, text_bytes, unz, z
from quire.llm.op4_substrings import FIELDS, ROW

WINDOW = 100
GRAM = 50
BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 96 << 20
SHARD_BYTES = 6 << 20
PIECE_BYTES = 3 << 20
#: More distinct regions of one anchor than this are dealt window by window.
HOT_REGIONS = SHARD_BYTES // (2 * WINDOW - GRAM)
HOT_WINDOWS = 1 << 17


def slide(values: np.ndarray, span: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``span`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= span:
        values = best(values[:-have], values[have:])
        have *= 2
    return best(values[: len(values) - (span - have)], values[span - have :]) if span > have else values


def window_anchors(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every gram; anchor at every place; whether a window of one text begins there."""
    gram, n = min(GRAM, size), len(buf)
    if n < size:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool)
    at = np.arange(n - gram + 1)
    grams = mix(rolled(BYTE[buf], at, at + gram)) | U64(1)
    end = np.repeat(off[1:], np.diff(off))
    return grams, slide(grams, size - gram + 1, np.minimum), np.arange(n - size + 1) + size <= end[: n - size + 1]


def anchor_places(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every gram that is the anchor of some window: text, hash, hash of all bytes of the
    text that windows with it can have."""
    grams, anchors, valid = window_anchors(buf, off, size)
    if not len(grams):
        return np.zeros(0, np.int64), grams, grams
    # a gram is one if the greatest anchor of the windows round it is its own hash
    margin = np.zeros(size - min(GRAM, size), U64)
    greatest = slide(np.concatenate([margin, np.where(valid, anchors, U64(0)), margin]), len(margin) + 1, np.maximum)
    at = np.flatnonzero(greatest == grams)
    doc = np.searchsorted(off, at, "right") - 1
    low, high = np.maximum(at - len(margin), off[doc]), np.minimum(at + size, off[doc + 1])
    return doc, grams[at], mix(rolled(BYTE[buf], low, high) + (high - low).astype(U64))


def anchor_runs(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of a text with one anchor: text, first window (place in the
    text), windows, anchor."""
    _, anchor, valid = window_anchors(buf, off, size)
    start = np.flatnonzero(valid)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    anchor = anchor[start]
    head = np.ones(len(start), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(head)
    doc = np.searchsorted(off, start[heads], "right") - 1
    # empty texts share their offset with the next one; the last of them owns the bytes
    return doc, start[heads] - off[doc], np.diff(np.append(heads, len(start))), anchor[heads]


def in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows by id and hash of the text, equal ones once."""
    ids, hashes = longs(table_column(table, "_id")), longs(table_column(table, "_hash"))
    order = np.lexsort((hashes, ids))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(hashes[order]) != 0)
    order = order[new]
    return table.take(pa.array(order)), ids[order], hashes[order]


def record(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], FIELDS)


def by_slices(fn, buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """``fn``'s arrays over slices of the texts, the first one being the text's number."""
    parts = []
    for i, j in cuts(off):
        doc, *rest = fn(buf[off[i] : off[j]], off[i : j + 1] - off[i], size)
        parts.append((doc + i, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts))


# ---------------------------------------------------------------- which anchors repeat


def anchor_entries(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in blocks(batches, BLOCK_BYTES):
            table, ids, hashes = in_order(table)
            doc, h, round_ = by_slices(anchor_places, *text_bytes(table_column(table, "text")), size)
            sort = np.argsort(h)
            hs = h[sort]
            head = np.ones(len(h), bool)
            head[1:] = hs[1:] != hs[:-1]
            values = hs[head]
            heads = np.flatnonzero(head)
            many = np.diff(np.append(heads, len(h))) > 1
            # distinct surroundings of each anchor, about the regions the block will send
            of_value = np.cumsum(head) - 1
            open_ = many[of_value]
            mine, around = of_value[open_], round_[sort][open_]
            pairs = np.lexsort((around, mine))
            new = np.ones(len(pairs), bool)
            new[1:] = (np.diff(mine[pairs]) != 0) | (around[pairs][1:] != around[pairs][:-1])
            distinct = np.where(many, np.bincount(mine[pairs][new], minlength=len(values)), 1)
            counts = (distinct << 1 | many).astype(np.uint32)
            bucket = (values % U64(buckets)).astype(np.int64)
            dealt = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[dealt], np.arange(buckets + 1))
            # each text's anchors as places in the order of the buckets, for the last step
            place = np.empty(len(values), np.uint32)
            place[dealt] = np.arange(len(values))
            of = np.empty(len(h), np.uint32)
            of[sort] = place[np.cumsum(head) - 1]
            rows = [(number % buckets, number, True, z(ids), z(hashes), z(np.bincount(doc, minlength=len(ids))), z(of), z(at), None)]
            for b in range(buckets):
                mine = dealt[at[b] : at[b + 1]]
                if len(mine):
                    rows.append((b, number, False, values[mine].tobytes(), z(counts[mine]), None, None, None, None))
            yield record(rows)

    return run


def count_anchors(hot: int):
    """For each block the anchors of this bucket that repeat: values, and places in the bucket.
    The last bit of a value, set in all hashes, is taken away in anchors of more than ``hot``
    distinct surroundings."""

    def run(table: pa.Table) -> pa.Table:
        whole = table.column("whole").to_numpy()
        passed, rows = table.filter(pa.array(whole)), table.filter(pa.array(~whole))
        out = []
        if rows.num_rows:
            values = [np.frombuffer(x, np.uint64) for x in rows.column("a").to_pylist()]
            h = np.concatenate(values)
            counts = np.concatenate([unz(x, np.uint32) for x in rows.column("b").to_pylist()]).astype(np.int64)
            many = (counts & 1) > 0
            sort = np.argsort(h)
            hs = h[sort]
            head = np.ones(len(h), bool)
            head[1:] = hs[1:] != hs[:-1]
            heads = np.flatnonzero(head)
            often = np.logical_or(np.diff(np.append(heads, len(h))) > 1, np.logical_or.reduceat(many[sort], heads))
            crowded = np.add.reduceat(counts[sort] >> 1, heads) > hot
            repeat = np.zeros(len(h), bool)
            repeat[sort] = often[np.cumsum(head) - 1]
            told = np.empty(len(h), U64)
            told[sort] = hs ^ crowded[np.cumsum(head) - 1].astype(U64)
            ends = np.cumsum([len(x) for x in values])
            for bucket, number, mine, end in zip(rows.column("bucket").to_pylist(), rows.column("block").to_pylist(), values, ends):
                flags = repeat[end - len(mine) : end]
                if flags.any():
                    out.append((bucket, number, False, told[end - len(mine) : end][flags].tobytes(), z(np.flatnonzero(flags)), None, None, None, None))
        made = pa.table([pa.array([r[i] for r in out], passed.schema.field(i).type) for i in range(len(FIELDS))], schema=passed.schema)
        return pa.concat_tables([passed, made])

    return run


def anchors_of_texts(table: pa.Table) -> pa.Table:
    """Back by block: each text's repeated anchors."""
    rows = table.to_pylist()
    w = next(r for r in rows if r["whole"])
    ids, hashes, count, of, at = (unz(w[c], t) for c, t in zip("abcde", (np.int64, np.int64, np.int64, np.uint32, np.int64)))
    value, flag = np.zeros(at[-1], U64), np.zeros(at[-1], bool)
    for r in rows:
        if not r["whole"]:
            place = at[r["bucket"]] + unz(r["b"], np.int64)
            value[place], flag[place] = np.frombuffer(r["a"], U64), True
    doc = np.repeat(np.arange(len(ids)), count)[flag[of]]
    anchors = value[of[flag[of]]]
    texts, first = np.unique(doc, return_index=True)
    ends = np.append(first[1:], len(doc))
    packed = [np.unique(anchors[i:j]).tobytes() for i, j in zip(first.tolist(), ends.tolist())] if len(doc) else []
    return pa.table([pa.array(ids[texts]), pa.array(hashes[texts]), pa.array(packed, pa.binary())], names=["_id", "_hash", "anchors"])


# ---------------------------------------------------------------- regions and their shards


def regions(size: int, shards: int, text: str):
    """Rows of ROW: block rows with the texts and their known repeats; for each shard the
    block's distinct regions: bytes, lengths, ids, hashes of texts, places, window numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in blocks(batches, BLOCK_BYTES, text):
            table, ids, hashes = in_order(table)
            buf, off = text_bytes(table_column(table, text))
            doc, start, n, anchor = by_slices(anchor_runs, buf, off, size)
            known = np.unique(np.concatenate([np.frombuffer(x, U64) for x in table.column("anchors").to_pylist()] or [np.zeros(0, U64)]))
            at = np.minimum(np.searchsorted(known | U64(1), anchor), max(0, len(known) - 1))
            keep = (known[at] | U64(1)) == anchor if len(known) else np.zeros(len(anchor), bool)
            hot = (known[at[keep]] & U64(1)) == 0
            doc, start, n, anchor = doc[keep], start[keep], n[keep], anchor[keep]
            base = np.cumsum(n) - n
            raw, seen, copy = buf.tobytes(), set(), np.zeros(len(doc), bool)
            texts = []
            for k, (s, e) in enumerate(zip((off[doc] + start).tolist(), (off[doc] + start + n + size - 1).tolist())):
                region = raw[s:e]
                if region in seen:
                    copy[k] = True
                else:
                    seen.add(region)
                texts.append(region)
            n_bytes = np.diff(off)
            rows = [(number % shards, number, True, z(ids), z(hashes), z(n_bytes), z(doc), z(np.stack([start, n])), z(copy))]
            shard = (mix(anchor) % U64(shards)).astype(np.int64)
            sent = np.flatnonzero(~copy & ~hot)
            sent = sent[np.argsort(shard[sent], kind="stable")]
            cut = np.searchsorted(shard[sent], np.arange(shards + 1))
            for b in range(shards):
                mine = sent[cut[b] : cut[b + 1]]
                if len(mine):
                    rows.append((b, number, False, z(np.frombuffer(b"".join([texts[k] for k in mine.tolist()]), np.uint8)), z(n[mine] + size - 1), z(np.diff(ids[doc[mine]], prepend=0)), hashes[doc[mine]].tobytes(), z(start[mine]), z(np.diff(base[mine], prepend=0))))
            for i in range(0, len(rows), 32):
                yield record(rows[i : i + 32])
            # regions of crowded anchors go window by window, by the hash of the whole window
            single = np.flatnonzero(~copy & hot)
            ends = np.cumsum(n[single])
            for i in range(0, int(ends[-1]) if len(single) else 0, HOT_WINDOWS):
                number_of = np.arange(i, min(i + HOT_WINDOWS, ends[-1]))
                k = np.searchsorted(ends, number_of, "right")
                step = number_of - (ends - n[single])[k]
                k = single[k]
                window = np.lib.stride_tricks.sliding_window_view(buf, size)[off[doc[k]] + start[k] + step]
                value = np.zeros(len(k), U64)
                for p, power in enumerate(powers(size)):
                    value += BYTE[window[:, p]] * power
                shard = (mix(value) % U64(shards)).astype(np.int64)
                dealt = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[dealt], np.arange(shards + 1))
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    mine = dealt[cut[b] : cut[b + 1]]
                    at = k[mine]
                    yield record([(b, number, False, z(window[mine]), z(np.full(len(mine), size)), z(np.diff(ids[doc[at]], prepend=0)), hashes[doc[at]].tobytes(), z(start[at] + step[mine]), z(np.diff(base[at] + step[mine], prepend=0)))])

    return run


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one number, zeros behind the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    out = np.zeros(len(buf), U64)
    for k in range(8):
        out |= padded[k : k + len(buf)].astype(U64) << U64(56 - 8 * k)
    return out


def suffix_array(eight: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane: suffixes sorted by at least ``depth`` bytes, and which of them equal
    the one before in all these bytes. A suffix's rank is the last place of its group; groups
    of one are done."""
    n = len(eight)
    order = np.argsort(eight, kind="stable")
    rank = np.empty(n, np.int64)
    key = eight[order]
    last = np.append(key[1:] != key[:-1], True)
    ends = np.flatnonzero(last)
    rank[order] = np.repeat(ends, np.diff(ends, prepend=-1))
    single = last & np.insert(last[:-1], 0, True)
    open_ = np.flatnonzero(~single)  # places in order
    known = 8
    while known < depth and len(open_):
        mine = order[open_]
        group = rank[mine]
        second = np.where(mine + known < n, rank[np.minimum(mine + known, n - 1)] + 1, 0)
        pair = (group.astype(U64) << U64(32)) | second.astype(U64)
        sort = np.argsort(pair, kind="stable")
        order[open_] = mine = mine[sort]
        pair = pair[sort]
        last = np.append(pair[1:] != pair[:-1], True)
        ends = np.flatnonzero(last)
        rank[mine] = np.repeat(open_[ends], np.diff(ends, prepend=-1))
        single = last & np.insert(last[:-1], 0, True)
        open_ = open_[~single]
        known *= 2
    grouped = rank[order]
    return order, np.append(False, grouped[1:] == grouped[:-1])


def kasai(eight: np.ndarray, order: np.ndarray, tied: np.ndarray, depth: int, lane: int = 256) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it; at least ``depth``
    stands for any longer one.

    Kasai's walk goes through the text and starts each comparison at the last length less one.
    Here stretches of ``lane`` places walk side by side, and eight bytes are compared at once.
    Suffixes the sorting could not tell apart need no comparison; behind them it starts anew,
    as their order says nothing about what follows.
    """
    n = len(eight)
    before, same = np.full(n, -1, np.int64), np.zeros(n, bool)
    before[order[1:]], same[order] = order[:-1], tied
    common = np.zeros(n, np.int64)
    at = np.arange(0, n, lane)
    h = np.zeros(len(at), np.int64)
    for _ in range(min(lane, n)):
        if at[-1] >= n:
            at, h = at[:-1], h[:-1]
            if not len(at):
                break
        other, tie = before[at], same[at]
        h = np.where(other < 0, 0, np.maximum(h - 1, 0))
        going = np.flatnonzero((other >= 0) & ~tie)
        while len(going):
            p, q = at[going] + h[going], other[going] + h[going]
            fit = (p + 8 <= n) & (q + 8 <= n)
            differ = eight[np.minimum(p, n - 1)] ^ eight[np.minimum(q, n - 1)]
            lead = np.full(len(going), 8, np.int64)
            for bits in range(0, 64, 8):
                lead -= differ >= U64(1 << bits)
            lead = np.minimum(lead, np.minimum(n - p, n - q))
            h[going] += lead
            going = going[fit & (lead == 8) & (h[going] < depth)]
        common[at] = np.where(tie, depth, h)
        h[tie | (h >= depth)] = 0
        at = at + 1
    return common[order]


def _less(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether window p of text a comes before window q of text b, and whether they are equal."""
    less, equal = np.zeros(len(p), bool), np.ones(len(p), bool)
    offsets = [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]
    open_ = np.arange(len(p))
    for o in offsets:
        x, y = a[p[open_] + o], b[q[open_] + o]
        differ = x != y
        less[open_[differ]] = x[differ] < y[differ]
        equal[open_[differ]] = False
        open_ = open_[~differ]
        if not len(open_):
            break
    return less, equal


class Known:
    """The windows of a shard's earlier pieces in ascending order, each with its earliest
    occurrence: id, hash of text, place, block, window number."""

    def __init__(self) -> None:
        self.eight, self.at, self.occurrence = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros((5, 0), np.int64)

    def find(self, eight: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Binary search: where each window stands or would stand, and whether it is there."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.at))
        found = np.zeros(len(at), bool)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low, found
            mid = (low[open_] + high[open_]) // 2
            less, equal = _less(self.eight, self.at[mid], eight, at[open_], size)
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
            found[open_[equal]] = True
            low[open_[equal]], high[open_[equal]] = mid[equal], mid[equal]

    def add(self, eight: np.ndarray, at: np.ndarray, occurrence: np.ndarray, where: np.ndarray) -> None:
        self.at = np.insert(self.at, where, at + len(self.eight))
        self.occurrence = np.insert(self.occurrence, where, occurrence, axis=1)
        self.eight = np.concatenate([self.eight, eight])


def work_piece(known: Known, held: dict[bytes, tuple], size: int, more: bool) -> tuple[np.ndarray, np.ndarray]:
    """Repeats (block and number of windows) that a piece's regions bring to light."""
    length = np.array([len(x) for x in held], np.int64)
    buf = np.frombuffer(b"".join(held), np.uint8)
    count = length - size + 1
    first = np.cumsum(length) - length
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    valid = np.repeat(first, count) + step
    occurrence = np.repeat(np.array(list(held.values()), np.int64).T, count, axis=1)
    occurrence[2] += step
    occurrence[4] += step
    eight = words_at(buf)
    order, tied = suffix_array(eight, size)
    common = kasai(eight, order, tied, size)
    name = np.cumsum(common < size)  # the number of the window that begins here, ascending
    names = np.empty(len(buf), np.int64)
    names[order] = name
    mine = names[valid]
    sort = np.lexsort((occurrence[2], occurrence[1], occurrence[0], mine))
    head = np.ones(len(sort), bool)
    head[1:] = np.diff(mine[sort]) != 0
    lead = sort[head][np.cumsum(head) - 1]
    later = (occurrence[:3, sort] != occurrence[:3, lead]).any(axis=0)
    blocks_, numbers = [occurrence[3, sort[later]]], [occurrence[4, sort[later]]]
    chosen = sort[head]  # one for each window, in ascending order
    if more or len(known.at):
        where, there = known.find(eight, valid[chosen], size)
        old, new = where[there], chosen[there]
        a, b = known.occurrence[:3, old], occurrence[:3, new]
        first_differs = np.argmax(a != b, axis=0)
        cols = np.arange(a.shape[1])
        x, y = a[first_differs, cols], b[first_differs, cols]
        for flag, source, at in ((x < y, occurrence, new), (x > y, known.occurrence, old)):
            blocks_.append(source[3, at[flag]].copy())
            numbers.append(source[4, at[flag]].copy())
        known.occurrence[:, old[x > y]] = occurrence[:, new[x > y]]
        if more:
            known.add(eight, valid[chosen[~there]], occurrence[:, chosen[~there]], where[~there])
    return np.concatenate(blocks_), np.concatenate(numbers)


def shard_repeats(size: int, piece_bytes: int):
    """Streams through a shard's rows. Equal regions are one; of them only the earliest
    occurrence is held, the others are repeats as a whole."""

    def answer(block: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((number, block))
        block, number = block[order], number[order]
        edges = np.flatnonzero(np.diff(block)) + 1
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(block)]):
            if e > s:
                yield record([(0, int(block[s]), False, z(np.diff(number[s:e], prepend=0)), None, None, None, None, None)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, bytes_ = Known(), {}, 0
        copies: list[tuple[int, int, int]] = []

        def flush(more: bool) -> Iterator[pa.RecordBatch]:
            block, number = work_piece(known, held, size, more) if held else (np.zeros(0, np.int64),) * 2
            b, first, n = np.array(copies, np.int64).reshape(-1, 3).T
            whole = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield from answer(np.concatenate([block, np.repeat(b, n)]), np.concatenate([number, whole]))

        for batch in batches:
            for row in batch.to_pylist():
                if row["whole"]:
                    yield record([tuple(row[c] for c in FIELDS)])
                    continue
                ends = np.cumsum(unz(row["b"], np.int64)).tolist()
                ids, places, numbers = (x.tolist() for x in (np.cumsum(unz(row["c"], np.int64)), unz(row["e"], np.int64), np.cumsum(unz(row["f"], np.int64))))
                hashes, raw, at = np.frombuffer(row["d"], np.int64).tolist(), unz(row["a"], np.uint8).tobytes(), 0
                for end, i, h, p, k in zip(ends, ids, hashes, places, numbers):
                    region, mine, at = raw[at:end], (i, h, p, row["block"], k), end
                    other = held.get(region)
                    if other is None:
                        held[region] = mine
                        bytes_ += len(region)
                    elif other[:3] != mine[:3]:
                        if mine[:3] < other[:3]:
                            held[region], mine = mine, other
                        copies.append((mine[3], mine[4], len(region) - size + 1))
                if bytes_ > piece_bytes:
                    yield from flush(True)
                    held, bytes_ = {}, 0
                    copies.clear()
        yield from flush(False)

    return run


def spans_of_block(size: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        w = next(r for r in rows if r["whole"])
        ids, hashes, n_bytes, doc = (unz(w[c], np.int64) for c in "abcd")
        start, n = unz(w["e"], np.int64).reshape(2, -1)
        copy = unz(w["f"], bool)
        flags = np.repeat(copy, n)
        for r in rows:
            if not r["whole"]:
                flags[np.cumsum(unz(r["a"], np.int64))] = True
        off = np.concatenate([[0], np.cumsum(n_bytes)])
        place = np.repeat(off[doc] + start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s, e, where = runs(covered(place[flags], size, int(off[-1])), off)
        keep = np.diff(where) > 0
        return pa.table([pa.array(ids[keep]), pa.array(hashes[keep]), spans_array(s, e, where).filter(pa.array(keep))], names=["_id", "_hash", "spans"])

    return run


def united(lists: str) -> Column:
    """One list of spans from those of all blocks, as each block with one of several equal rows
    may know a part. With starts and ends sorted apart, a span ends where the next start is
    behind the end."""
    spans = F.flatten(lists)
    starts, ends = F.array_sort(F.transform(spans, lambda x: x["start"])), F.array_sort(F.transform(spans, lambda x: x["end"]))
    n = F.size(starts)
    first = F.filter(starts, lambda x, i: (i == 0) | (x > F.get(ends, i - 1)))
    last = F.filter(ends, lambda x, i: (i == n - 1) | (x < F.get(starts, i + 1)))
    merged = F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return F.when(F.size(lists) == 1, F.get(lists, 0)).otherwise(merged)


def repeated_spans(docs: DataFrame, size: int = WINDOW, text: str = "text", piece_bytes: int = PIECE_BYTES, hot: int = HOT_REGIONS) -> DataFrame:
    """_id, _hash, spans: the maximal spans of bytes to remove, where there are any. ``docs``
    has _id and _hash; it is joined with all its columns, as later with the spans, so that one
    exchange of the texts serves both joins."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = partitions(spark)
    buckets, shards = max(n, -(-total // BUCKET_BYTES)), max(n, -(-total // SHARD_BYTES))
    counted = docs.select("_id", "_hash", F.col(text).alias("text")).mapInArrow(anchor_entries(size, buckets), ROW).groupBy("bucket").applyInArrow(count_anchors(hot), ROW)
    anchors = counted.groupBy("block").applyInArrow(anchors_of_texts, "_id bigint, _hash bigint, anchors binary")
    anchors = anchors.groupBy("_id", "_hash").agg(F.first("anchors").alias("anchors"))
    cut = docs.join(anchors, ["_id", "_hash"]).mapInArrow(regions(size, shards, text), ROW)
    repeats = cut.groupBy("bucket").applyInArrow(shard_repeats(size, piece_bytes), ROW)
    spans = repeats.groupBy("block").applyInArrow(spans_of_block(size), f"_id bigint, _hash bigint, spans {SPANS}")
    return spans.groupBy("_id", "_hash").agg(F.collect_set("spans").alias("lists")).select("_id", "_hash", united("lists").alias("spans"))


def remove_repeats(docs: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text", piece_bytes: int = PIECE_BYTES, as_text: bool = False, hot: int = HOT_REGIONS) -> DataFrame:
    """``docs`` with n_bytes, n_removed, removed (maximal spans of bytes) and kept (the bytes
    left, as binary: a cut may fall inside a character; as text without such broken ones)."""
    docs = docs.drop("n_bytes", "n_removed", "removed", "kept", "anchors", "_id", "_hash")
    docs = docs.withColumns({"_id": F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), "_hash": F.coalesce(F.xxhash64(text), F.lit(0))})
    spans = repeated_spans(docs, size, text, piece_bytes, hot).withColumnRenamed("spans", "removed")
    joined = docs.join(spans, ["_id", "_hash"], "left")

    def fn(part: pa.RecordBatch) -> list[pa.Array]:
        buf, off = text_bytes(column(part, text))
        raw, kept, lost = buf.tobytes(), [], []
        for d, spans in enumerate(column(part, "removed").to_pylist()):
            at, end, pieces, gone = int(off[d]), int(off[d + 1]), [], 0
            base = at
            for s in spans or ():
                pieces.append(raw[at : base + s["start"]])
                at = base + s["end"]
                gone += s["end"] - s["start"]
            pieces.append(raw[at:end])
            whole = b"".join(pieces)
            kept.append(whole.decode(errors="ignore") if as_text else whole)
            lost.append(gone)
        return [pa.array(np.diff(off), pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary())]

    return append(joined, fn, [("n_bytes", "bigint"), ("n_removed", "bigint"), ("kept", "string" if as_text else "binary")], text, more=("removed",)).drop("_id", "_hash")
