"""Substring dedup by fixed-block anchors.

A window is ``WINDOW`` = 13 consecutive words.  Any window covers one whole
block of ``BLOCK`` = 7 words of the grid of its document (13 = 2 * 7 - 1), so two
documents that share a window share the 7 words of one's grid block, wherever
they stand in the other.

1. Each document gives its grid blocks to an index and probes it with every
   rolling run of 7 words.  A run is live if its words are a grid block of a
   document and stand in a later one.
2. Hits are extended: the windows around live runs are the only candidates, and
   each candidate window is traced to the smallest ``doc_id`` it starts in.
3. A document loses the words of its windows that start in a smaller one, which
   is every maximal exact repeat of 13 words or more.

What is shuffled is packed: one row holds, for a block of documents and a range
of hashes, the sorted distinct hashes of each document, so a run repeated within
a document counts once and no group of copies is ever paired with itself.  Runs
are filtered by 32 bits and a bucket (a chance hit costs a candidate, no more);
windows are compared by 128 bits of hash over 13 words.  Documents travel in
compressed pieces, dealt by ``doc_id``.  Buckets and pieces are as many as the
text needs, so what a task holds does not grow.

A null text has no words.  A null ``doc_id`` counts as the largest, and nulls do
not lose words to each other.  Rows of one ``doc_id`` do not lose words to each
other and get a row each.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.common import byte_blocks, ids_and_texts, mix, rolling, word_hashes

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
BUCKET_BYTES = 24 << 20  # text per bucket of hashes
PIECE_BYTES = 16 << 20  # text per piece of documents
LAST = np.iinfo(np.int64).max  # stands for a null doc_id

_PACKED = "bucket long, ids binary, counts binary, low binary, high binary"


def _document_words(which: list[int], data: bytes, bounds: np.ndarray):
    start, end, hashes = word_hashes(data)
    return start, end, hashes, np.searchsorted(bounds, start, side="right") - 1


def _runs(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words that lie in one document, with their places."""
    runs = rolling(hashes, size)
    at = np.flatnonzero(doc[: len(runs)] == doc[size - 1 : size - 1 + len(runs)]) if len(runs) else np.empty(0, np.int64)
    return runs[at], at


def _packed(bucket: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, low_type) -> Iterator[tuple]:
    """Rows of sorted distinct ``(id, low)`` per bucket; of equals the least ``high`` stays."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if not len(part):
            continue
        k = part[np.lexsort((high[part], low[part], ids[part]))]
        i, l, h = ids[k], low[k], high[k]
        first = np.concatenate(([True], (i[1:] != i[:-1]) | (l[1:] != l[:-1])))
        i, l, h = i[first], l[first], h[first]
        opens = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        counts = np.diff(np.concatenate((opens, [len(i)])))
        steps = np.diff(i[opens].astype("<u8"), prepend=np.uint64(0))  # small, so they compress
        extra = np.packbits(h.astype(bool)) if low_type == "<u4" else h.astype("<u8")
        yield int(bucket[part[0]]), steps.tobytes(), counts.astype("<u4").tobytes(), l.astype(low_type).tobytes(), extra.tobytes()


def _unpacked(group: pd.DataFrame, low_type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ids, low, high`` of all rows of a group."""
    ids, low, high = [np.empty(0, np.int64)], [np.empty(0, low_type)], [np.empty(0, "<u8")]
    for steps, counts, l, h in zip(group["ids"], group["counts"], group["low"], group["high"]):
        own = np.cumsum(np.frombuffer(steps, "<u8"), dtype=np.uint64).view(np.int64)
        ids.append(np.repeat(own, np.frombuffer(counts, "<u4")))
        low.append(np.frombuffer(l, low_type))
        n = len(low[-1])
        high.append(np.unpackbits(np.frombuffer(h, np.uint8))[:n].astype("<u8") if low_type == "<u4" else np.frombuffer(h, "<u8"))
    return np.concatenate(ids), np.concatenate(low), np.concatenate(high)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow_schema() -> pa.Schema:
    return pa.schema([("bucket", pa.int64())] + [(n, pa.binary()) for n in ("ids", "counts", "low", "high")])


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return np.array([LAST if i is None else i for i in part.column("doc_id").to_pylist()], dtype=np.int64)


def _piece_of(ids: np.ndarray, pieces: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(pieces)).astype(np.int64)


def _probes(docs: DataFrame, buckets: int) -> DataFrame:
    """Every run of ``BLOCK`` words by bucket; ``high`` is 0 for grid blocks, else 1."""

    def emit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = _ids(part)
            for which, data, bounds in byte_blocks(part.column("text").to_pylist(), 4 << 20):
                _, _, hashes, doc = _document_words(which, data, bounds)
                n = np.bincount(doc, minlength=len(which))
                first = np.concatenate(([0], np.cumsum(n)))
                runs, at = _runs(hashes, doc, BLOCK)
                long = n[doc[at]] >= WINDOW
                runs, at = runs[long], at[long]
                off_grid = (at - first[doc[at]]) % BLOCK != 0
                own = ids[np.array(which)][doc[at]]
                low = (runs >> np.uint64(8)) & np.uint64(0xFFFFFFFF)
                bucket = (mix(runs) % np.uint64(buckets)).astype(np.int64)
                yield _batch(list(_packed(bucket, own, low, off_grid.astype("<u8"), "<u4")), _arrow_schema())

    return docs.mapInArrow(emit, _PACKED)


def _live(probes: DataFrame, pieces: int) -> DataFrame:
    """The live runs of every document, dealt by document."""

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        ids, low, off_grid = _unpacked(group, "<u4")
        order = np.argsort(low, kind="stable")
        ids, low, on_grid = ids[order], low[order], off_grid[order] == 0
        opens = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))) if len(low) else np.empty(0, np.int64)
        if not len(opens):
            return _frame([])
        source = np.minimum.reduceat(np.where(on_grid, ids, LAST), opens)
        latest = np.maximum.reduceat(ids, opens)
        size = np.diff(np.concatenate((opens, [len(low)])))
        live = np.repeat(source < latest, size)
        ids, low = ids[live], low[live].astype("<u8")
        rows = _packed(_piece_of(ids, pieces), ids, low, np.zeros(len(ids), "<u8"), "<u4")
        return _frame(list(rows))

    return probes.groupBy("bucket").applyInPandas(pick, _PACKED)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "ids", "counts", "low", "high"]).astype({"bucket": "int64"})


def _pieces(docs: DataFrame, pieces: int) -> DataFrame:
    """Documents packed by ``doc_id`` into compressed texts."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        schema = pa.schema([("piece", pa.int64())] + [(n, pa.binary()) for n in ("ids", "sizes", "texts")])
        for part in parts:
            ids = _ids(part)
            for which, data, bounds in byte_blocks(part.column("text").to_pylist(), 16 << 20):
                own = ids[np.array(which)]
                piece = _piece_of(own, pieces)
                rows = []
                for p in np.unique(piece).tolist():
                    k = np.flatnonzero(piece == p)
                    sizes = (bounds[k + 1] - bounds[k] - 1).astype("<i8")
                    texts = b"".join(data[bounds[i] : bounds[i + 1] - 1] for i in k.tolist())
                    rows.append((p, own[k].tobytes(), sizes.tobytes(), squeeze(texts)))
                yield _batch(rows, schema)

    return docs.mapInArrow(pack, "piece long, ids binary, sizes binary, texts binary")


def _opened(group: pd.DataFrame) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """``ids, data, bounds`` of packed documents, some megabytes at a time."""
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for ids, sizes, texts in zip(group["ids"], group["sizes"], group["texts"]):
        size = np.frombuffer(sizes, "<i8")
        raw = expand.decompress(texts, max_output_size=max(1, int(size.sum()))) if size.sum() else b""
        cut = np.concatenate(([0], np.cumsum(size))).tolist()
        own = np.frombuffer(ids, "<i8")
        data = b"\n".join(raw[a:b] for a, b in zip(cut, cut[1:])) + b"\n"
        yield own, data, np.concatenate(([0], np.cumsum(size + 1)))


def _key(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(ids.view(np.uint64)) ^ hashes


def _listed(wanted: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ``wanted``."""
    if not len(wanted) or not len(keys):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return wanted[at] == keys


def _window_hashes(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one, at = _runs(hashes, doc, WINDOW)
    two, _ = _runs(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), doc, WINDOW)
    return one, two, at


def _candidates(pieces: DataFrame, live: DataFrame, buckets: int) -> DataFrame:
    """The windows around live runs, by bucket."""

    def extend(group: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        ids, low, _ = _unpacked(hits, "<u4")
        wanted = np.unique(_key(ids, mix(low.astype("<u8"))))
        rows: list[tuple] = []
        if len(wanted):
            for own, data, bounds in _opened(group):
                _, _, hashes, doc = _document_words(own, data, bounds)
                runs, at = _runs(hashes, doc, BLOCK)
                hit = np.zeros(len(hashes) + 1, dtype=np.int64)
                hit[at[_listed(wanted, _key(own[doc[at]], mix((runs >> np.uint64(8)) & np.uint64(0xFFFFFFFF))))]] = 1
                before = np.concatenate(([0], np.cumsum(hit)))
                one, two, start = _window_hashes(hashes, doc)
                # a window has the runs that begin at its first WINDOW - BLOCK + 1 words
                near = before[start + WINDOW - BLOCK + 1] > before[start]
                one, two, start = one[near], two[near], start[near]
                bucket = (mix(one) % np.uint64(buckets)).astype(np.int64)
                rows += _packed(bucket, own[doc[start]], one, two, "<u8")
        return _frame(rows)

    return (
        pieces.groupBy("piece").cogroup(live.withColumnRenamed("bucket", "piece").groupBy("piece"))
        .applyInPandas(extend, _PACKED)
    )


def _repeats(candidates: DataFrame, pieces: int) -> DataFrame:
    """The windows of every document that start in a smaller one, dealt by document."""

    def trace(group: pd.DataFrame) -> pd.DataFrame:
        ids, one, two = _unpacked(group, "<u8")
        if not len(ids):
            return _frame([])
        order = np.lexsort((two, one))
        ids, one, two = ids[order], one[order], two[order]
        opens = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
        size = np.diff(np.concatenate((opens, [len(ids)])))
        later = ids > np.repeat(np.minimum.reduceat(ids, opens), size)
        ids, one, two = ids[later], one[later], two[later]
        return _frame(list(_packed(_piece_of(ids, pieces), ids, one, two, "<u8")))

    return candidates.groupBy("bucket").applyInPandas(trace, _PACKED)


def _cleaned(pieces: DataFrame, repeats: DataFrame) -> DataFrame:
    def remove(group: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        ids, one, two = _unpacked(hits, "<u8")
        wanted = np.unique(_key(ids, mix(one) + two))
        out_id, n_words, n_removed, kept = [], [], [], []
        for own, data, bounds in _opened(group):
            start, end, hashes, doc = _document_words(own, data, bounds)
            first, second, at = _window_hashes(hashes, doc)
            gone = at[_listed(wanted, _key(own[doc[at]], mix(first) + second))]
            change = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.add.at(change, gone, 1)
            np.add.at(change, gone + WINDOW, -1)
            stays = np.cumsum(change)[:-1] == 0
            n = np.bincount(doc, minlength=len(own))
            left = np.bincount(doc[stays], minlength=len(own))
            cut = np.concatenate(([0], np.cumsum(n)))
            for i in range(len(own)):
                if left[i] == n[i]:
                    text = b" ".join(data[bounds[i] : bounds[i + 1] - 1].split())
                else:
                    k = np.arange(cut[i], cut[i + 1])[stays[cut[i] : cut[i + 1]]]
                    text = b" ".join([data[s:e] for s, e in zip(start[k].tolist(), end[k].tolist())])
                kept.append(text)
            out_id += [None if i == LAST else i for i in own.tolist()]
            n_words += n.tolist()
            n_removed += (n - left).tolist()
        return pd.DataFrame(
            {
                "doc_id": pd.array(out_id, dtype="Int64"),
                "n_words": np.array(n_words, np.int64),
                "n_removed": np.array(n_removed, np.int64),
                "kept": [t.decode("utf-8", "replace") for t in kept],
            }
        )

    return (
        pieces.groupBy("piece")
        .cogroup(repeats.withColumnRenamed("bucket", "piece").groupBy("piece"))
        .applyInPandas(remove, "doc_id long, n_words long, n_removed long, kept string")
    )


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row; ``kept`` are the words
    that stay, joined by one space."""
    rows = ids_and_texts(docs)
    n_bytes = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    buckets = int(max(64, -(-n_bytes // BUCKET_BYTES)))
    n_pieces = int(max(64, -(-n_bytes // PIECE_BYTES)))
    pieces = _pieces(rows, n_pieces)
    live = _live(_probes(rows, buckets), n_pieces)
    repeats = _repeats(_candidates(pieces, live, buckets), n_pieces)
    return _cleaned(pieces, repeats)
