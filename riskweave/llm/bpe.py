"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A block of texts is split into words, and each distinct word is encoded once. The distinct words form one corpus with an inverted index
from the rank of a token pair to the places where the pair stands. Ranks are replayed in rising order; each merge touches only the
pairs to its left and right, which enter the index under their own ranks. Ids of texts are then gathered from those of their words.
Blocks are bounded in bytes and words that were met lately are kept up to a bound, so memory does not grow with the table, and the
work needs no shuffle.

Defined cases: a null or empty text has no ids; special tokens in a text are ordinary text; very long texts are encoded whole, in a block of
their own; of pairs with one rank the leftmost is merged first; repeated rows are encoded one by one; an empty table gives an empty result;
other columns are carried along by `encode` and `decode` and never read (one with the name of a column to be made goes on as {name}_in). Ids
are a binary column of little-endian unsigned 32-bit integers. `decode` gives bytes, null for null; an id without a token stops the job.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import aside, cut, fresh
from riskweave.llm.pretokens import Splitter, character_classes, gather, slices

_BLOCK = 2 << 20
_WORDS_KEPT = 200_000
_SHIFT = 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a rank file: a token in base64 and its rank on each line."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


class MergeTable:
    """What pairs of tokens merge into. A token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {}
        get = ranks.get
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a = get(token[:i])
                if a is not None and (b := get(token[i:])) is not None:
                    self.pairs[a << _SHIFT | b] = rank
        two = np.full((256, 256), -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                two[token[0], token[1]] = rank
        self.two = two.ravel()
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.known = np.zeros(size, bool)
        self.known[list(ranks.values())] = True
        self.token_at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct non-empty words, each as little-endian bytes."""
        data = b"\n" + b"\n".join(words) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        gaps = np.append(0, stops)
        symbols = self.bytes_of[raw]
        symbols[gaps] = -1  # before and after each word; a pair with a gap has a negative key
        first = np.full(len(raw), -1, np.int64)
        first[:-1] = self.two[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        first[gaps] = -1
        first[stops - 1] = -1
        where = np.flatnonzero(first >= 0)
        where = where[np.argsort(first[where], kind="stable")]
        kinds, begins = np.unique(first[where], return_index=True)
        parts = np.split(where, begins[1:]) if len(where) else []
        index = {int(k): p.tolist() for k, p in zip(kinds, parts, strict=True)}
        heap = kinds.tolist()  # rising, so it is a heap
        rank_at, sym = first.tolist(), symbols.tolist()
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        pair, inside = self.pairs.get, index.get
        while heap:
            r = heappop(heap)
            places = index.pop(r, None)
            if not places:
                continue
            places.sort()
            shifted = r << _SHIFT
            for k, p in enumerate(places):
                if rank_at[p] != r:
                    continue  # another merge has used it
                q, o = after[p], before[p]
                s = after[q]
                sym[p] = r
                sym[q] = rank_at[q] = -2
                after[p], before[s] = s, p
                lower = False
                rank_at[o] = rank = pair(sym[o] << _SHIFT | r)
                if rank is not None:
                    if (known := inside(rank)) is None:
                        index[rank] = [o]
                        heappush(heap, rank)
                    else:
                        known.append(o)
                    lower = rank < r
                rank_at[p] = rank = pair(shifted | sym[s])
                if rank is not None:
                    if (known := inside(rank)) is None:
                        index[rank] = [p]
                        heappush(heap, rank)
                    else:
                        known.append(p)
                    lower |= rank < r
                if lower:  # a lower rank has come up: it goes first, then the rest of this rank
                    index[r] = places[k + 1 :] + (inside(r) or [])
                    heappush(heap, r)
                    break
        done = np.array(sym, np.int64)
        there = np.flatnonzero(done >= 0)
        ids = done[there].astype("<u4").tobytes()
        at = (4 * np.searchsorted(there, stops)).tolist()
        return [ids[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]


class Encoder:
    """Ids of texts by way of their distinct words."""

    def __init__(self, path: str):
        self.table = MergeTable(read_ranks(path))
        self.split = Splitter(character_classes())
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text begins (one more than texts)."""
        words, codes, places = self.split.words(texts)
        if len(self.kept) > _WORDS_KEPT:
            self.kept.clear()
        kept, whole = self.kept, self.table.ranks.get
        new = []
        for w in words:
            if w not in kept:
                raw = w.encode()
                rank = whole(raw)  # a word that is a token itself needs no merges
                if rank is None:
                    new.append((w, raw))
                else:
                    kept[w] = rank.to_bytes(4, "little")
        if new:
            kept.update(zip((w for w, _ in new), self.table.replay([raw for _, raw in new]), strict=True))
        lists = [kept[w] for w in words]
        at = np.zeros(len(lists) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)) // 4, out=at[1:])
        ids, begin = gather(np.frombuffer(b"".join(lists), "<u4"), at, codes)
        return ids, begin[places]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker; its words serve later tasks too."""
    return Encoder(path)


@lru_cache(maxsize=1)
def merge_table(path: str) -> MergeTable:
    return MergeTable(read_ranks(path))


def _slices(data: memoryview, at: list[int]) -> list[memoryview]:
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _binary(data: np.ndarray, at: np.ndarray):
    """A pyarrow binary array of consecutive slices of data's bytes."""
    import pyarrow as pa

    if at[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.array([bytes(x) for x in _slices(memoryview(data).cast("B"), at.tolist())], pa.binary())


def _add_columns(df: DataFrame, read: str, made: list[tuple[str, str]], work, keep: bool = True) -> DataFrame:
    """df and the columns made: work(a column's slice) for slices of record batches with bounded bytes. Carried columns go along as they are; what is
    read need not come back (keep)."""
    df = aside(df, *[c for c, _ in made])
    taken = fresh(df, *[c for c, _ in made])
    fields = ", ".join(f"`{c}` {t}" for (_, t), c in zip(made, taken, strict=True))
    at = df.columns.index(read)

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, at, _BLOCK):
            own = [i for i in range(part.num_columns) if keep or i != at]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in own), *work(part.column(at))], names=[*(part.schema.names[i] for i in own), *taken])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if keep or f.name != read)
    return df.mapInArrow(run, f"{kinds}{fields}").withColumnsRenamed(dict(zip(taken, (c for c, _ in made), strict=True)))


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens", keep: bool = True) -> DataFrame:
    """docs with the ids of each text and their number; without the text if it is not to be kept. The rank file's path must be readable on every executor."""

    def work(texts):
        import pyarrow as pa

        ids, at = encoder(ranks_path).encode([t or "" for t in texts.to_pylist()])
        return [_binary(ids, 4 * at), pa.array(np.diff(at))]

    return _add_columns(docs, text_col, [(ids_col, "binary"), (count_col, "long")], work, keep)


def encode_by_corpus(docs: DataFrame, ranks_path: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens") -> DataFrame:
    """As encode, but each distinct word of the whole table is merged once, and the text column goes.

    Blocks of texts are split first: a block's rows hold the numbers of their words, its first row the words. These are made distinct over
    all blocks, replayed (every partition of them is one corpus with its index), joined back to the blocks that have them, and gathered."""
    docs = aside(docs, ids_col, count_col)
    at = docs.columns.index(text_col)
    block, codes, words, n, ids = fresh(docs, "block", "codes", "words", "n", "ids")
    kept = [f for f in docs.schema.fields if f.name != text_col]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)

    def split(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        splitter, number = Splitter(character_classes()), TaskContext.get().partitionId() << 32
        for part in slices(batches, at, _BLOCK):
            found, places, begin = splitter.words([t or "" for t in part.column(at).to_pylist()])
            made = [pa.array([number] * part.num_rows, pa.int64()), _binary(places.astype("<u4"), 4 * begin), pa.array([found, *[None] * (part.num_rows - 1)], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != at), *made], names=[*(f.name for f in kept), block, codes, words])
            number += 1

    def replay(batches):
        import pyarrow as pa

        table = merge_table(ranks_path)
        for part in slices(batches, 0, _BLOCK):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(table.replay([w.encode() for w in part.column(0).to_pylist()]), pa.binary())], names=["word", "ids"])

    def collect(left, right):
        import pyarrow as pa

        lists = [b""] * right.num_rows
        for c, x in zip(right["code"].to_pylist(), right["ids"].to_pylist(), strict=True):
            lists[c] = x
        at = np.append(0, np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)) // 4))
        places = left[codes].to_pylist()
        begin = np.append(0, np.cumsum([len(p) // 4 for p in places]))
        values, stops = gather(np.frombuffer(b"".join(lists), "<u4"), at, np.frombuffer(b"".join(places), "<u4").astype(np.int64))
        own = stops[begin]
        return pa.table([*(left[f.name] for f in kept), _binary(values, 4 * own), pa.array(np.diff(own))], names=[*(f.name for f in kept), ids, n])

    rows = cut(docs.mapInArrow(split, f"{kinds}`{block}` long, `{codes}` binary, `{words}` array<string>"))
    pairs = rows.where(F.col(words).isNotNull()).select(block, F.posexplode(words).alias("code", "word"))
    merged = pairs.select("word").distinct().mapInArrow(replay, "word string, ids binary")
    known = pairs.join(merged, "word").select(F.col(block).alias("of"), "code", "ids")
    out = rows.drop(words).groupBy(block).cogroup(known.groupBy("of")).applyInArrow(collect, f"{kinds}`{ids}` binary, `{n}` long")  # a block at a time
    return out.withColumnsRenamed({ids: ids_col, n: count_col})


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """encoded with the bytes that the ids stand for."""

    def work(column):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = merge_table(ranks_path)
        known = column.is_valid().to_pylist()
        lists = [x or b"" for x in column.to_pylist()]
        ids = np.frombuffer(b"".join(lists), "<u4")
        if len(ids) and (ids.max() >= len(table.known) or not table.known[ids].all()):
            raise ValueError("an id has no token")
        at = np.zeros(len(lists) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)) // 4, out=at[1:])
        data, begin = gather(table.token_bytes, table.token_at, ids)
        made = _binary(data, begin[at]) if len(lists) else pa.array([], pa.binary())
        return [made if all(known) else pc.if_else(pa.array(known), made, pa.scalar(None, pa.binary()))]

    return _add_columns(encoded, ids_col, [(bytes_col, "binary")], work)
