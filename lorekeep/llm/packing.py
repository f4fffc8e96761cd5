"""Lexical retrieval packing: documents that share words share a window.

Every document's ids are cut into whole windows and one shorter rest. The rests are put in the order of their most telling
terms (token ids) by range partitioning, and each stretch of so many rests in that order is a shard with a BM25 inverted
index of its own, with the statistics of all documents. A shard packs its rests: the seed, the first that is
unused, asks the index with all its terms, and its unused neighbours fill the window from the best on; the one that is too
long for the room left is cut, and what remains of it is the next seed. So every window is full. What a shard has left,
less than a window, goes on to the next shard of the partition; only a partition's last ids go to windows of sizes that
are powers of two, and no place is padded.

Memory is bounded by the shard, not by the data or by a partition; the only thing broadcast is a weight for each id of the
vocabulary. The range bounds of partitions are sampled, so another run can cut shards elsewhere; within a run, a task that
is repeated gives the same windows, as its rows are sorted by all that tells them apart.

Defined cases: null text is empty text, so its only id is the end; repeated rows are packed each; rows that tie in all
their terms go by doc_id; a very long text is whole windows and one rest; an empty table gives no piece; only the id and
text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .tokens import default_tokenizer, encoder

WINDOW, END = 4096, 2
#: Rests in a shard.
SHARD = 1024
K1, B = 1.2, 0.75
#: The terms that order the rests.
LEADING = 3
LEADS = [f"lead{i}" for i in range(LEADING)]
#: A term that is in one of so many of a shard's rests, or in more, has a row of the shard's matrix.
DENSE = 8
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names)


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of some ids, in order, and how often each is there."""
    ids = np.sort(ids)
    before = np.flatnonzero(ids[1:] != ids[:-1])  # where another id follows
    ends = np.append(before, len(ids) - 1)
    tf = ends.copy()
    tf[0] += 1
    tf[1:] -= before
    return ids[ends], tf


def leading(terms: np.ndarray, tf: np.ndarray) -> list[int]:
    """The most telling of a rest's terms, which are in order. What orders the rests is the vocabulary's own order, in which
    merges come from the most frequent on, so that it needs no statistics of the data; the index has those."""
    weight = tf / (tf + K1) * np.log(terms + 2.0)
    return ([int(x) for x in terms[np.argsort(-weight, kind="stable")[:LEADING]]] + [-1] * LEADING)[:LEADING]


def token_table(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, n, lead0.. and ids (binary, 16 bits each if the vocabulary allows), written to the shared folder. After its
    documents, each task adds a row with n = -1 whose ids are the numbers of its rests that hold each term, of its rests
    and of their ids."""
    names = ["doc_id", "n", *LEADS, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        kind = "<u2" if encode.vocabulary <= 1 << 16 else "<u4"
        last, df = np.array([end], "<u4"), np.zeros(encode.vocabulary + 2, np.int64)
        types = [pa.int64(), pa.int64(), *[pa.int32()] * LEADING, pa.binary()]
        for b in batches:
            each = encode.encode_all(b.column(1))
            for at in range(0, b.num_rows, 512):
                out = []
                for doc in b.column(0).slice(at, 512).to_pylist():
                    ids = np.concatenate([next(each), last])
                    rest, lead = ids[len(ids) // WINDOW * WINDOW :], [-1] * LEADING
                    if len(rest):
                        terms, tf = counted(rest)
                        lead = leading(terms, tf)
                        df[terms] += 1
                        df[-2:] += 1, len(rest)
                    out.append((doc, len(ids), *lead, ids.astype(kind).tobytes()))
                yield _batch(out, names, types)
        yield _batch([(None, -1, *[-1] * LEADING, df.tobytes())], names, types)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n long, {', '.join(f'{x} int' for x in LEADS)}, ids binary")
    return written(rows)


def _array(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def term_weights(tokens: DataFrame, vocabulary: int) -> tuple[np.ndarray, float]:
    """BM25's idf of each id of the vocabulary and the mean length, over all rests. As many numbers as the vocabulary has
    come to the driver, whatever the size of the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocabulary + 2, np.int64)
        for b in batches:
            for data in b.column(0):
                df += np.frombuffer(data.as_py(), np.int64)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["term", "df"])

    counts = tokens.where("n < 0").select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(vocabulary + 2)
    for term, n in counts.collect():
        df[term] = n
    rests, ids = df[-2:]
    idf = np.log1p((rests - df[:-2] + 0.5) / (df[:-2] + 0.5))
    return idf.astype(np.float32), ids / max(rests, 1)


def impacts(rest: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """A rest's terms and what each adds to the BM25 score of the rest."""
    terms, tf = counted(rest)
    return terms, (idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(rest) / mean))).astype(np.float32)


class Shard:
    """An inverted index over some rests, and the windows that they fill. Terms of many rests are rows of a matrix, as a
    sum of rows takes a tenth of the time of as many postings; the others have postings."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean: float):
        self.rests, self.left = rests, np.array([len(x) for x in rests])
        self.cut = np.zeros(len(rests), np.int64)
        self.terms, values = zip(*(impacts(x, idf, mean) for x in rests))
        docs = np.repeat(np.arange(len(rests)), [len(x) for x in self.terms])
        terms, values = np.concatenate(self.terms), np.concatenate(values)
        order = np.argsort(terms, kind="stable")
        docs, terms, values = docs[order], terms[order], values[order]
        distinct, df = counted(terms)
        dense = df * DENSE >= len(rests)
        self.dense, self.columns = distinct[dense], np.arange(len(rests))
        self.matrix, many = np.zeros((len(self.dense), len(rests)), np.float32), np.repeat(dense, df)
        self.matrix[np.repeat(np.arange(len(self.dense)), df[dense]), docs[many]] = values[many]
        self.docs, self.all_terms, self.values = docs[~many], terms[~many], values[~many]

    def _drop_used(self) -> None:
        keep = self.left[self.docs] > 0
        self.docs, self.all_terms, self.values = self.docs[keep], self.all_terms[keep], self.values[keep]
        keep = self.left[self.columns] > 0
        self.matrix, self.columns = self.matrix[:, keep], self.columns[keep]

    def neighbours(self, seed: int) -> np.ndarray:
        """The unused others, best score first, ties in order."""
        terms = self.terms[seed]
        row = np.searchsorted(self.dense, terms)
        dense = np.append(self.dense, -1)[row] == terms
        terms = terms[~dense]
        first, last = np.searchsorted(self.all_terms, terms, "left"), np.searchsorted(self.all_terms, terms, "right")
        n = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        scores = np.zeros(len(self.rests))
        scores[self.columns] = self.matrix[row[dense]].sum(0, dtype=float)
        scores += np.bincount(self.docs[at], self.values[at], len(self.rests))
        free = np.flatnonzero((self.left > 0) & (np.arange(len(self.rests)) != seed))
        return free[np.argsort(-scores[free], kind="stable")]

    def _take(self, doc: int, n: int) -> tuple[int, int, int]:
        start = int(self.cut[doc])
        self.cut[doc] += n
        self.left[doc] -= n
        return doc, start, n

    def windows(self, last: bool = True) -> Iterator[list[tuple[int, int, int]]]:
        """Each a list of (rest, start in it, length). What is less than a window is left over unless it is the last."""
        unused, first, carried = int(self.left.sum()), 0, -1
        indexed = len(self.rests)
        while unused:
            while self.left[first] == 0:
                first += 1
            if unused < WINDOW:
                if last:
                    yield from self._last(first, carried)
                return
            seed = carried if carried >= 0 and self.left[carried] else first
            pieces, room = [self._take(seed, int(self.left[seed]))], WINDOW
            room, carried = WINDOW - pieces[0][2], -1
            if room:
                others = self.neighbours(seed)
                ends = np.cumsum(self.left[others])
                whole = int(np.searchsorted(ends, room, "right"))
                for doc in others[:whole]:
                    room -= int(self.left[doc])
                    pieces.append(self._take(int(doc), int(self.left[doc])))
                if room:
                    carried = int(others[whole])
                    pieces.append(self._take(carried, room))
            unused -= WINDOW
            yield pieces
            if (alive := int((self.left > 0).sum())) * 2 < indexed:
                self._drop_used()
                indexed = alive

    def _last(self, first: int, carried: int) -> Iterator[list[tuple[int, int, int]]]:
        """Less than a window is left; windows of powers of two, the largest first."""
        order = [carried] if carried >= 0 else []
        order += [i for i in range(first, len(self.rests)) if self.left[i] and i != carried]
        total = int(self.left.sum())
        for power in [1 << k for k in reversed(range(WINDOW.bit_length())) if total >> k & 1]:
            pieces, room = [], power
            while room:
                n = min(room, int(self.left[order[0]]))
                pieces.append(self._take(order[0], n))
                room -= n
                if not self.left[order[0]]:
                    order.pop(0)
            yield pieces


def pack(docs: DataFrame, tokenizer: str | None = None, shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for."""
    tokenizer = tokenizer or default_tokenizer()
    tokens = token_table(docs, tokenizer)
    idf, mean = term_weights(tokens, encoder(tokenizer).vocabulary)
    tokens = tokens.where("n >= 0")
    shared = docs.sparkSession.sparkContext.broadcast((idf, mean))
    names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * with_ids
    types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
    schema = PIECE + ", ids array<int>" * with_ids

    def row(doc: int | None, start: int, ids: np.ndarray, n: int, sequence: int, offset: int) -> tuple:
        return (doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids)), n, sequence, offset, *([ids.astype("i4")] * with_ids))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, n, data in zip(*(b.column(i).to_pylist() for i in range(2)), b.column(2)):
                ids = _array(data.as_py(), n)
                yield _batch([row(doc, k, ids[k : k + WINDOW], n, 0, 0) for k in range(0, n // WINDOW * WINDOW, WINDOW)], names, types)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weight, length = shared.value
        sequence, held = TaskContext.get().partitionId() << 33, []

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            index, out = Shard([ids for *_, ids in held], weight, length), []
            for pieces in index.windows(last):
                offset = 0
                for i, start, size in pieces:
                    doc, n, at, ids = held[i]
                    out.append(row(doc, at + start, ids[start : start + size], n, sequence * 2, offset))
                    offset += size
                sequence += 1
            held = [(doc, n, at + cut, ids[cut:]) for (doc, n, at, ids), cut in zip(held, index.cut.tolist()) if cut < len(ids)]
            yield _batch(out, names, types)

        for b in batches:
            for doc, n, data in zip(*(b.column(i).to_pylist() for i in range(2)), b.column(2)):
                # a full shard waits for one more rest, as the last of a partition leaves nothing over
                if len(held) >= shard:
                    yield from close(False)
                held.append((doc, n, n // WINDOW * WINDOW, _array(data.as_py(), n % WINDOW)))
        if held:
            yield from close(True)

    full = tokens.where(F.col("n") >= WINDOW).select("doc_id", "n", "ids").mapInArrow(whole, schema).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1)
    cut = F.floor(F.col("n") / WINDOW) * WINDOW
    width = F.octet_length("ids") / F.col("n")
    pool = tokens.where(F.col("n") > cut).select("doc_id", "n", *LEADS, F.substring("ids", (cut * width + 1).cast("int"), F.octet_length("ids")).alias("rest"))
    order = [*LEADS, "doc_id", "n"]
    pool = pool.repartitionByRange(*order).sortWithinPartitions(*order)
    return full.unionByName(pool.select("doc_id", "n", "rest").mapInArrow(packed, schema))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
