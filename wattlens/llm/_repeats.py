"""Windows of text that also start in a document with a smaller id.

Shared by the substring and the suffix operator. Both cut a text into units (words, bytes), look at
every run of ``WINDOW`` units and drop units covered by a window that an earlier document has too.
Consecutive windows whose smallest gram hash (minimiser) is the same gram form one super-k-mer.

1. ``census``: documents are dealt into parts by id and text, so that rows of one id spread (only rows with
   both alike stay together); rows without an id are never dealt, as they are kept whole. Each part lists its distinct minimisers once,
   so a hot passage costs one entry a part, not one a document.
2. ``shared``: a bucket of minimisers tells each part which of its minimisers other documents have.
   Equal windows have equal minimisers, so all other windows are unique and never travel.
3. ``travel``: super-k-mers with shared minimisers go as packed strings to their minimiser's bucket,
   each distinct string of a part once, with the smallest document id that holds it. Strings reach past
   a repeated passage into its surroundings, so a passage in many different documents gives as many
   strings for one minimiser. Minimisers with ``HOT`` super-k-mers (``census`` counts, ``shared`` adds
   up) therefore send single windows, keyed by the window's own hash, each distinct one of a part once.
4. ``resolve``: a bucket sorts the windows of its strings (the operator's own method) and returns,
   as one bit a window, whether a smaller id has the window too.
5. ``settle``: the parts find their super-k-mers again and cut what the bits say.

Every exchange is keyed by part or bucket; the text is dealt out once and that exchange is reused.
All steps give the same rows whatever the order in which rows arrive, so a lost executor's tasks
can simply run again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text

WINDOW = 50
#: Bytes of text in a part at least: what one task holds of a table at a time.
PART_BYTES = 8 << 20
#: The exchanges have an entry for each pair of part and bucket, and as many buckets as parts. Parts of
#: sqrt(ENTRY_BYTES * all bytes) keep about 16 minimisers in an entry: 8 MB up to 230 GB of text, 230 MB at 180 TB.
ENTRY_BYTES = 290
#: Super-k-mers of one minimiser, at least, whose windows are dealt out one by one: bounds what one bucket gets for one minimiser.
HOT = 4096
#: Buckets of such windows for each bucket of minimisers: a window takes more room than its share of a string.
SPREAD = 4
#: Small inputs still use this many parts.
MIN_PARTS = 12

#: Runs of removed units of a row.
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

_PART = "__part"
_LOW = np.uint64(0xFFFFFFFF)


class Supermers(NamedTuple):
    """Runs of consecutive windows with one minimiser."""

    text: np.ndarray      #: bytes in which the spans lie
    row: np.ndarray       #: row of the batch
    anchor: np.ndarray    #: 64-bit hash of the minimiser
    start: np.ndarray     #: span of the packed string in ``text``
    end: np.ndarray
    first: np.ndarray     #: unit of the batch at which the first window starts
    count: np.ndarray     #: number of windows, 64 at most
    window: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]  #: spans in ``text`` of the windows at some units


def minimiser_runs(grams: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser hash, first window and window count of each run.

    grams: hash of the gram at each unit; valid: units at which a window starts; width: grams in a window.
    Of equal hashes in a window the leftmost counts, so equal windows agree on their minimiser.
    """
    starts = np.flatnonzero(valid)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    w = 1
    while 2 * w <= width:
        key = np.minimum(key[:-w], key[w:])
        w *= 2
    if w < width:
        key = np.minimum(key[:w - width], key[width - w:])
    at = (key[starts] & _LOW).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    return grams[at[head]], starts[head], np.diff(np.append(head, len(starts)))


def refine(load, n: int, depth: int, rank: np.ndarray | None = None) -> np.ndarray:
    """Rank n strings by ``depth`` 64-bit keys; equal strings get equal ranks.

    load(k, at) gives key k of the strings ``at``. Only strings still tied are read further.
    """
    rank = np.zeros(n, np.int64) if rank is None else rank.copy()
    tied = np.arange(n)
    for k in range(depth):
        if not len(tied):
            break
        keys = load(k, tied)
        order = np.lexsort((keys, rank[tied])) if k or rank.any() else np.argsort(keys, kind="stable")
        at, key, old = tied[order], keys[order], rank[tied[order]]
        group = np.ones(len(at), bool)
        group[1:] = old[1:] != old[:-1]
        part = group.copy()
        part[1:] |= key[1:] != key[:-1]
        i = np.arange(len(at))
        head = np.maximum.accumulate(np.where(part, i, 0))
        rank[at] = old + head - np.maximum.accumulate(np.where(group, i, 0))
        alone = part & np.append(part[1:], True)
        tied = at[~alone]
    return rank


def _pack48(h: np.ndarray) -> bytes:
    """The upper 48 bits of hashes. A chance match only lets a string travel in vain."""
    return np.ascontiguousarray((h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(blobs: list[bytes]) -> list[np.ndarray]:
    out = []
    for b in blobs:
        wide = np.zeros((len(b) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
        out.append(wide.view("<u8")[:, 0])
    return out


def _names(h: np.ndarray) -> np.ndarray:
    """Hashes as ``_pack48`` keeps them. Whether a minimiser is hot goes by this name, so that all parts agree."""
    return h >> np.uint64(16)


def _short(h: np.ndarray) -> np.ndarray:
    """What names a minimiser within a part or a bucket: 32 bits of its hash."""
    return (h >> np.uint64(32)).astype(np.uint32)


def _blob(values: np.ndarray, kind: Any) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _blobs(column: pa.ChunkedArray, kind: Any) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for chunk in column.chunks for x in chunk]


def _ids(table: pa.Table, id_col: str) -> tuple[np.ndarray, np.ndarray]:
    column = table.column(id_col).cast(pa.int64())
    return pc.fill_null(column, 0).to_numpy(), pc.is_valid(column).to_numpy()


def _cat(arrays: list[np.ndarray], kind: Any) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _groups(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values."""
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    head = np.flatnonzero(new)
    return head, np.append(head[1:], len(sorted_))[:len(head)]


class Repeats:
    """The five steps. A subclass gives the units: ``supermers``, ``classes``, ``measure`` and ``cut``."""

    #: name and type of the columns that ``cut`` adds
    added: list[tuple[str, T.DataType]] = []

    def __init__(self, id_col: str, text_col: str, parts: int, hot: int = HOT):
        self.id_col, self.text_col, self.parts, self.hot = id_col, text_col, parts, hot

    def supermers(self, buf: np.ndarray, offs: np.ndarray) -> Supermers:
        raise NotImplementedError

    def classes(self, data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of each string laid end to end: how many per string, and the class (equal windows) of each."""
        raise NotImplementedError

    def cut(self, buf: np.ndarray, offs: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        """The added columns of a batch, of which the windows at the units ``first`` go."""
        raise NotImplementedError

    # 1
    def census(self, table: pa.Table) -> pa.Table:
        hashes, ids = [], []
        for t in _text.slices([table], self.text_col):
            s = self.supermers(*_text.utf8(t.column(self.text_col)))
            i, known = _ids(t, self.id_col)
            hashes.append(s.anchor[known[s.row]])
            ids.append(i[s.row][known[s.row]])
        h, d = _cat(hashes, np.uint64), _cat(ids, np.int64)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        head, tail = _groups(h)
        several = d[tail - 1] != d[head]
        h = h[head]
        log = np.ceil(np.log2(tail - head)).astype(np.uint8)  # of the count, rounded up
        bucket = (_names(h) % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(self.parts + 1))
        part = table.column(_PART)[0].as_py()
        rows = []
        for b in range(self.parts):
            if len(x := order[edge[b]:edge[b + 1]]):
                one, more = x[~several[x]], x[several[x]]
                rows.append((b, part, _pack48(h[one]), _pack48(h[more]), _blob(log[one], np.uint8), _blob(log[more], np.uint8)))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.int32()),
                         **{name: pa.array([r[i] for r in rows], pa.binary()) for i, name in enumerate(("one", "several", "one_log", "several_log"), 2)}})

    # 2
    def shared(self, table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        one, several = (_unpack48(table.column(c).to_pylist()) for c in ("one", "several"))
        h = _cat(one + several, np.uint64)
        owner = np.repeat(np.concatenate([part, part]), [len(x) for x in one + several])
        surely = np.arange(len(h)) >= sum(map(len, one))
        log = _cat(_blobs(table.column("one_log"), np.uint8) + _blobs(table.column("several_log"), np.uint8), np.uint8)
        order = np.argsort(h, kind="stable")
        h, owner, surely, log = h[order], owner[order], surely[order], log[order]
        head, tail = _groups(h)
        hot = np.repeat(np.add.reduceat(np.int64(1) << log.astype(np.int64), head) >= self.hot, tail - head)
        again = np.zeros(len(h) + 1, bool)
        again[1:-1] = h[1:] == h[:-1]
        keep = again[1:] | again[:-1] | surely
        h, owner, hot = h[keep], owner[keep], hot[keep]
        order = np.argsort(owner, kind="stable")
        h, owner, hot = h[order], owner[order], hot[order]
        head, tail = _groups(owner)
        return self._to_parts([(int(owner[a]), _blob(np.unique(h[a:b] >> np.uint64(16)), np.uint32), _blob(np.unique(h[a:b][hot[a:b]]), np.uint64), None, None)
                               for a, b in zip(head, tail, strict=True)])

    @staticmethod
    def _to_parts(rows: list[tuple]) -> pa.Table:
        return pa.table({_PART: pa.array([r[0] for r in rows], pa.int32()),
                         **{name: pa.array([r[i] for r in rows], pa.binary()) for i, name in enumerate(("anchors", "hot", "pieces", "masks"), 1)}})

    @staticmethod
    def _apart(s: Supermers, hot: np.ndarray) -> tuple[Supermers, np.ndarray]:
        """Marked super-k-mers are replaced by their windows, named by their own hashes; and which entries are such windows."""
        n = np.where(hot, s.count, 1)
        of = np.repeat(np.arange(len(n)), n)
        hot, first = hot[of], s.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        start, end, anchor = s.start[of], s.end[of], s.anchor[of]
        start[hot], end[hot] = s.window(first[hot])
        anchor[hot] = _text.span_hash(_text.byte_prefix(s.text), start[hot], end[hot])
        return s._replace(row=s.row[of], anchor=anchor, start=start, end=end, first=first, count=np.where(hot, 1, s.count[of])), hot

    def _pieces(self, table: pa.Table, news: pa.Table):
        """The part's rows by id, its distinct strings with shared minimisers, their buckets, and where they stand."""
        anchors = np.unique(_cat(_blobs(pc.drop_null(news.column("anchors")), np.uint32), np.uint32))
        hot = _cat(_blobs(pc.drop_null(news.column("hot")), np.uint64), np.uint64)
        table = table.take(pc.sort_indices(table, [(self.id_col, "ascending"), (self.text_col, "ascending")]))
        number: dict[bytes, int] = {}
        anchor, single, smallest, found, base = [], [], [], [], 0
        for t in _text.slices([table], self.text_col):
            if len(anchors):
                s = self.supermers(*_text.utf8(t.column(self.text_col)))
                ids, known = _ids(t, self.id_col)
                own = _short(s.anchor)
                at = np.minimum(np.searchsorted(anchors, own), len(anchors) - 1)
                x = np.flatnonzero((anchors[at] == own) & known[s.row])
                s = s._replace(**{c: getattr(s, c)[x] for c in ("row", "anchor", "start", "end", "first", "count")})
                alone = np.isin(_names(s.anchor), hot)
                if alone.any():
                    s, alone = self._apart(s, alone)
                data, piece = s.text.tobytes(), np.empty(len(s.row), np.int64)
                for j, (a, b, h, w, i) in enumerate(zip(s.start.tolist(), s.end.tolist(), s.anchor.tolist(), alone.tolist(), ids[s.row].tolist(), strict=True)):
                    piece[j] = k = number.setdefault(data[a:b], len(number))
                    if k == len(anchor):
                        anchor.append(h)
                        single.append(w)
                        smallest.append(i)  # rows come by id, so the first is the smallest
                found.append((base, s.row, s.first, s.count, piece, ids[s.row]))
            else:
                none = np.zeros(0, np.int64)
                found.append((base, none, none, none, none, none))
            base += t.num_rows
        anchor = np.array(anchor, np.uint64)
        name, parts = _names(anchor), np.uint64(self.parts)
        bucket = np.where(np.array(single, bool), parts + name % (parts * np.uint64(SPREAD)), name % parts).astype(np.int64)
        return table, list(number), anchor, bucket, np.array(smallest, np.int64), found

    # 3
    def travel(self, table: pa.Table, news: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows and news.num_rows:
            part = table.column(_PART)[0].as_py()
            _, pieces, anchor, bucket, smallest, _ = self._pieces(table, news)
            order = np.argsort(bucket, kind="stable")
            pack = zstandard.ZstdCompressor(level=1)
            for a, b in zip(*_groups(bucket[order]), strict=True) if len(order) else ():
                x = order[a:b]
                own = [pieces[k] for k in x]
                rows.append((int(bucket[x[0]]), part, _blob(x, np.uint32), _blob(smallest[x], np.int64), _blob(_short(anchor[x]), np.uint32),
                             _blob(np.fromiter(map(len, own), np.int64, len(own)), np.uint32), pack.compress(b"".join(own))))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.int32()),
                         **{name: pa.array([r[i] for r in rows], pa.binary()) for i, name in enumerate(("pieces", "ids", "anchors", "lengths", "data"), 2)}})

    # 4
    def resolve(self, table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        unpack = zstandard.ZstdDecompressor()
        ids, lengths = _blobs(table.column("ids"), np.int64), _blobs(table.column("lengths"), np.uint32)
        which = []
        for data, size in zip(table.column("data"), lengths, strict=True):
            raw, edge = unpack.decompress(data.as_buffer()), np.append(0, np.cumsum(size, dtype=np.int64)).tolist()
            which.append(np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(edge, edge[1:], strict=False)), np.int64, len(size)))
        of, doc = np.concatenate(which), np.concatenate(ids)
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, of, doc)
        masks = np.where(least[of] < doc, ~np.uint64(0), np.uint64(0))
        # Strings alone with their minimiser share no window with another string; the others are sorted.
        anchor = np.empty(len(number), np.uint32)
        anchor[of] = np.concatenate(_blobs(table.column("anchors"), np.uint32))
        _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
        met = np.flatnonzero(size[group] > 1)
        if len(met):
            strings = list(number)
            own = [strings[k] for k in met.tolist()]
            counts, cls = self.classes(b"".join(own), np.fromiter(map(len, own), np.int64, len(own)))
            order = np.argsort(cls, kind="stable")
            head, tail = _groups(cls[order])
            first = np.empty(len(cls), np.int64)
            first[order] = np.repeat(np.minimum.reduceat(np.repeat(least[met], counts)[order], head), tail - head)
            start, place = np.cumsum(counts) - counts, np.full(len(number), -1)
            place[met] = np.arange(len(met))
            x = np.flatnonzero(place[of] >= 0)
            k = place[of[x]]
            n = counts[k]
            head = np.cumsum(n) - n
            bit = np.arange(n.sum()) - np.repeat(head, n)
            smaller = first[np.repeat(start[k], n) + bit] < np.repeat(doc[x], n)
            masks[x] = np.bitwise_or.reduceat(smaller.astype(np.uint64) << bit.astype(np.uint64), head)
        rows, base = [], 0
        for part, piece in zip(table.column("part").to_pylist(), _blobs(table.column("pieces"), np.uint32), strict=True):
            mask = masks[base:base + len(piece)]
            base += len(piece)
            if (hit := np.flatnonzero(mask)).size:
                rows.append((part, None, None, _blob(piece[hit], np.uint32), _blob(mask[hit], np.uint64)))
        return self._to_parts(rows)

    def whole(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of which nothing is cut."""
        for t in _text.slices(batches, self.text_col):
            keep = [c for c in t.schema.names if c != self.text_col]
            columns = self.cut(*_text.utf8(t.column(self.text_col)), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in keep), *columns], names=[*keep, *(name for name, _ in self.added)])

    # 5
    def settle(self, table: pa.Table, news: pa.Table) -> pa.Table:
        table, pieces, _, _, smallest, found = self._pieces(table, news)
        mask = np.zeros(len(pieces), np.uint64)
        mask[_cat(_blobs(pc.drop_null(news.column("pieces")), np.uint32), np.uint32)] = _cat(_blobs(pc.drop_null(news.column("masks")), np.uint64), np.uint64)
        done = []
        for t, (_, _, first, count, piece, ids) in zip(_text.slices([table], self.text_col), found, strict=True):
            bits = np.where(ids > smallest[piece], ~np.uint64(0), mask[piece]) if len(piece) else np.zeros(0, np.uint64)
            n = count
            bit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            gone = (np.repeat(bits, n) >> bit.astype(np.uint64)) & np.uint64(1) == 1
            columns = self.cut(*_text.utf8(t.column(self.text_col)), (np.repeat(first, n) + bit)[gone])
            keep = [c for c in t.column_names if c not in (_PART, self.text_col)]
            done.append(pa.table([*(t.column(c) for c in keep), *columns], names=[*keep, *(name for name, _ in self.added)]))
        return pa.concat_tables(done)


def dealt(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """The rows with an id, and their part."""
    own = F.col(f"`{id_col}`").cast("long")
    return docs.where(own.isNotNull()).withColumn(_PART, F.pmod(F.xxhash64(own, F.col(f"`{text_col}`")), F.lit(parts)).cast("int"))


def run(docs: DataFrame, kind: type[Repeats], id_col: str, text_col: str, part_bytes: int) -> DataFrame:
    """All columns of ``docs`` but the text, and the columns that ``kind`` adds; one row per row. Ids are whole numbers
    (or texts of such; another text is an error)."""
    aside = {c: _text.free_name(f"{c}_of_input", docs.columns) for c in docs.columns if c.lower() == _PART and c not in (id_col, text_col)}
    if aside:  # the user's column keeps its name outside
        out = run(docs.withColumnsRenamed(aside), kind, id_col, text_col, part_bytes)
        return out.withColumnsRenamed({new: old for old, new in aside.items()})
    names = {name for name, _ in kind.added}
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c == text_col or c not in names))
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    parts = max(MIN_PARTS, math.ceil(size / max(part_bytes, math.isqrt(ENTRY_BYTES * size))))
    job = kind(id_col, text_col, parts, HOT)
    by_part = dealt(docs, id_col, text_col, parts).groupBy(_PART)
    census = by_part.applyInArrow(lambda t: job.census(t), "bucket int, part int, one binary, several binary, one_log binary, several_log binary")
    to_part = f"`{_PART}` int, anchors binary, hot binary, pieces binary, masks binary"
    shared = census.groupBy("bucket").applyInArrow(lambda t: job.shared(t), to_part)
    travel = by_part.cogroup(shared.groupBy(_PART)).applyInArrow(
        lambda t, news: job.travel(t, news), "bucket int, part int, pieces binary, ids binary, anchors binary, lengths binary, data binary")
    bits = travel.groupBy("bucket").applyInArrow(lambda t: job.resolve(t), to_part)
    out = T.StructType([f for f in docs.schema if f.name != text_col] + [T.StructField(*a) for a in kind.added])
    known = by_part.cogroup(shared.unionByName(bits).groupBy(_PART)).applyInArrow(lambda t, news: job.settle(t, news), out)
    unknown = docs.where(F.col(f"`{id_col}`").cast("long").isNull())
    return known.unionByName(unknown.mapInArrow(lambda batches: job.whole(batches), out))
