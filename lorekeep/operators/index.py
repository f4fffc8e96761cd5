"""A stored inverted index: built once from a corpus, asked by any number of queries.

Documents lie in blocks of at most DOCUMENTS of one conversation, in the order of their ids within a partition; nothing is
shuffled to make them. The index has a row for each term and block, in a folder by the term's hash: the documents' places
in the block, how often each has the term, and the competitive pairs, those of a count and a document's length that no
other pair of the block beats in both. Whatever the parameters of BM25 and the average length, the greatest impact that the
term has in the block is that of one of these pairs. One more row for each block has its ids and lengths.

A search reads the pairs of the asked terms first, no postings: their greatest impacts bound what any document of a block
can score for a query. Each query's block with the highest bound is scored exactly, which gives a limit, the score of its
n-th document; of the other blocks only those whose bound reaches the limit are scored. So the result is that of summing
everything. Scoring meets a block's postings with the queries that still want it, in parts of PART queries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lorekeep.functions.text import stemmed_words
from lorekeep.storage import is_written, new_folder, shared_folder, written

from .bm25 import K1, B, idf, term_weight
from .ranking import DIGITS, top_n

#: Documents, and lexemes, of a block at most; but a longer document is a block of its own.
DOCUMENTS, LEXEMES = 1024, 1 << 20
#: Folders of terms, and queries that are scored at once.
BUCKETS, PART = 16, 1024
#: Where the rows of blocks' documents are, and the number of this layout.
OF_BLOCKS, LAYOUT = -1, 1


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def inverted(lexemes: pa.ListArray, stemmed: bool) -> tuple[np.ndarray, list[pa.Array]]:
    """The documents' lengths, and of each term: the term, places, counts, and the competitive pairs' counts and lengths."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lexemes), 0)).astype(np.int64)
    coded = pc.list_flatten(lexemes).dictionary_encode()
    names = coded.dictionary
    place, code = np.repeat(np.arange(len(lengths)), lengths), np.asarray(coded.indices).astype(np.int64)
    if stemmed:  # each word of the block once
        stems = pa.array(stemmed_words(names.to_pylist()), pa.string()).dictionary_encode()
        names, code = stems.dictionary, np.asarray(stems.indices)[code].astype(np.int64)
        kept = ~np.asarray(pc.equal(names, "")).astype(bool)[code]
        place, code = place[kept], code[kept]
        lengths = np.bincount(place, minlength=len(lengths))
    pair, counts = np.unique(code * len(lengths) + place, return_counts=True) if len(code) else (np.zeros(0, np.int64),) * 2
    term, place = np.divmod(pair, max(len(lengths), 1))
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    length = lengths[place]
    order = np.lexsort((length, -counts, term))
    rank = np.searchsorted(first, order, side="right")  # terms rise in this order, too
    least = np.minimum.accumulate(length[order] - rank * (1 << 40)) if len(order) else length[order]
    best = order[np.append(True, least[1:] < least[:-1])] if len(order) else order

    def lists(starts: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, pa.int32()))

    of_best = np.searchsorted(term[best], term[first])
    return lengths, [names.take(pa.array(term[first])), lists(first, place), lists(first, counts), lists(of_best, counts[best]), lists(of_best, length[best])]


def build(corpus: DataFrame, folder: str, stemmed: bool = False, documents: int = DOCUMENTS, most: int = LEXEMES) -> Index:
    """Writes the index of corpus(conversation_id, id, lexemes); with `stemmed`, of the lexemes' stems."""
    kind = dict(corpus.dtypes)["id"]
    names = ["conversation_id", "block", "term", "ids", "places", "counts", "best_counts", "best_lengths"]

    def made(held: list[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, lexemes = rows["id"].combine_chunks(), rows["lexemes"].combine_chunks()
        lengths, (terms, places, counts, best_counts, best_lengths) = inverted(lexemes, stemmed)
        conversation = rows["conversation_id"][0].as_py()
        none = pa.nulls(1, pa.list_(pa.int32()))
        whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        sizes = pa.array([lengths.tolist()], pa.list_(pa.int32()))
        first = [pa.array([conversation], pa.string()), pa.array([block], pa.int64()), pa.nulls(1, pa.string()), whole, none, sizes, none, none]
        yield pa.RecordBatch.from_arrays(first, names)
        n = len(terms)
        rest = [pa.array([conversation] * n, pa.string()), pa.array([block] * n, pa.int64()), terms, pa.nulls(n, whole.type), places, counts, best_counts, best_lengths]
        yield pa.RecordBatch.from_arrays(rest, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, n, size, number, part = [], None, 0, 0, 0, None
        for b in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(b.column(2)), 0))
            conversations, parts = b.column(0).to_pylist(), b.column(3).to_pylist()
            start = 0
            for i in range(b.num_rows):
                if n and (conversations[i] != of or n >= documents or size + sizes[i] > most):
                    yield from made([*held, b.slice(start, i - start)], (part << 32) + number)
                    held, n, size, start, number = [], 0, 0, i, number + 1
                of, n, size, part = conversations[i], n + 1, size + int(sizes[i]), parts[i]
            held.append(b.slice(start))
        if n:
            yield from made(held, (part << 32) + number)

    rows = corpus.select(F.col("conversation_id").cast("string").alias("conversation_id"), "id", "lexemes", F.spark_partition_id().alias("part"))
    rows = rows.sortWithinPartitions("conversation_id", "id")
    lists = "places array<int>, counts array<int>, best_counts array<int>, best_lengths array<int>"
    out = rows.mapInArrow(run, f"conversation_id string, block long, term string, ids array<{kind}>, {lists}")
    out = out.withColumn("bucket", F.when(F.col("term").isNull(), OF_BLOCKS).otherwise(bucket_of(F.col("term"))))
    out.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows")
    index = Index(corpus.sparkSession, folder, out.schema)
    df = index.terms().groupBy("bucket", "conversation_id", "term").agg(F.sum(F.size("places").cast("long")).alias("df"))
    df.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/df")
    total, n = F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)), F.sum(F.size("ids").cast("long"))
    stats = index.blocks().groupBy("conversation_id").agg(n.alias("n_docs"), (total / n).alias("avg_len"))
    stats.write.mode("overwrite").parquet(f"{folder}/stats")
    return index


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    folder: str
    schema: StructType

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")

    def blocks(self) -> DataFrame:
        """conversation_id, block, ids and lengths."""
        return self._rows().where(F.col("bucket") == OF_BLOCKS).select("conversation_id", "block", "ids", F.col("counts").alias("lengths"))

    def terms(self) -> DataFrame:
        """A row for each term and block; a join by bucket reads the wanted folders alone."""
        return self._rows().where(F.col("bucket") != OF_BLOCKS).drop("ids")

    def stats(self) -> DataFrame:
        """conversation_id, n_docs and avg_len; documents without lexemes count."""
        return self.spark.read.schema("conversation_id string, n_docs long, avg_len double").parquet(f"{self.folder}/stats")

    def document_frequency(self) -> DataFrame:
        """conversation_id, term, df and the term's bucket."""
        return self.spark.read.schema("conversation_id string, term string, df long, bucket int").parquet(f"{self.folder}/df")


def stored_index(spark: SparkSession, inputs: DataFrame, name: str, corpus: Callable[[], DataFrame], stemmed: bool = False, store: str | None = None) -> Index:
    """The index of a table's files as they are now: opened if it's in the store, else built from corpus(). `name` tells
    apart what is made of the same files; an index of files that have changed since is not found, nor one of another
    layout. Without a store the application has one of its own in the shared folder."""
    manager = spark.sparkContext._jvm.org.apache.hadoop.fs
    facts = [name, str(stemmed), str(LAYOUT)]
    for path in sorted(inputs.inputFiles()):
        status = manager.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(manager.Path(path))
        facts.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    store = store or f"{shared_folder(spark)}/lorekeep-indexes-{spark.sparkContext.applicationId}"
    folder = f"{store}/{hashlib.sha256(chr(10).join(facts).encode()).hexdigest()[:32]}"
    if is_written(spark, f"{folder}/stats"):  # the last part
        return Index(spark, folder, spark.read.parquet(f"{folder}/rows").schema)
    return build(corpus(), folder, stemmed)


def _asked(index: Index, queries: DataFrame) -> DataFrame:
    """conversation_id, query_id, bucket, term and weight of what is asked and known, and the average length."""
    asked = queries.select(F.col("conversation_id").cast("string").alias("conversation_id"), "query_id", F.explode("lexemes").alias("term"))
    asked = asked.groupBy("conversation_id", "query_id", "term").agg(F.count("*").alias("times")).withColumn("bucket", bucket_of(F.col("term")))
    rows = asked.join(index.document_frequency(), ["bucket", "conversation_id", "term"]).join(index.stats(), "conversation_id")
    weight = F.col("times") * idf(F.col("n_docs"), F.col("df"))
    return written(rows.select("conversation_id", "query_id", "bucket", "term", weight.alias("weight"), "avg_len"))


def _bounds(index: Index, weights: DataFrame, k1: float, b: float) -> DataFrame:
    """conversation_id, query_id, block and bound: what a document of the block can score at most."""
    rows = weights.join(index.terms().drop("places", "counts"), ["bucket", "conversation_id", "term"])
    impacts = F.zip_with("best_counts", "best_lengths", lambda tf, n: term_weight(tf, n, F.col("avg_len"), k1, b))
    return rows.groupBy("conversation_id", "query_id", "block").agg(F.sum(F.col("weight") * F.array_max(impacts)).alias("bound"))


def _scored(index: Index, weights: DataFrame, pairs: DataFrame, parts: int, n: int, k1: float, b: float) -> DataFrame:
    """query_id, id, score of the best n documents of each pair's block; all for n <= 0. A block meets its queries in parts."""
    by = ["conversation_id", "block", "part"]
    pairs = pairs.select("conversation_id", "block", "query_id", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part"))
    cells = pairs.select(*(F.col(c).alias(c) for c in by)).distinct()
    asked = weights.groupBy("conversation_id", "query_id").agg(F.collect_list(F.struct("term", "weight")).alias("asked"), F.first("avg_len").alias("avg_len"))
    asked = pairs.join(asked, ["conversation_id", "query_id"])
    wanted = weights.select("bucket", "conversation_id", "term").distinct()
    ids_kind = index.schema["ids"].dataType
    null = lambda kind: F.lit(None).cast(kind)
    held = index.terms().join(wanted, ["bucket", "conversation_id", "term"], "left_semi").select("conversation_id", "block", "term", null(ids_kind).alias("ids"), "places", "counts")
    whole = index.blocks().select("conversation_id", "block", null("string").alias("term"), "ids", null("array<int>").alias("places"), F.col("lengths").alias("counts"))
    held = held.unionByName(whole).join(cells, ["conversation_id", "block"])

    def run(rows: pa.Table, wants: pa.Table) -> pa.Table:
        terms = rows["term"].to_pylist()
        at = terms.index(None)
        ids, lengths = rows["ids"].combine_chunks()[at].values, np.asarray(rows["counts"].combine_chunks()[at].values).astype(np.float64)
        base = k1 * (1 - b + b * lengths / (wants["avg_len"][0].as_py() or 1))
        places, counts, impacts = rows["places"].combine_chunks(), rows["counts"].combine_chunks(), {}
        for i, t in enumerate(terms):
            if t is not None:
                place, tf = np.asarray(places[i].values), np.asarray(counts[i].values).astype(np.float64)
                impacts[t] = place, tf * (k1 + 1) / (tf + base[place])
        order = np.argsort(np.array(ids.to_pylist()), kind="stable")  # ties go to the lesser id
        which, best, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, asked in enumerate(wants["asked"].to_pylist()):
            score = np.zeros(len(ids))
            for x in asked:
                if (found := impacts.get(x["term"])) is not None:
                    score[found[0]] += x["weight"] * found[1]
            score = np.round(score, DIGITS)[order]
            if 0 < n < len(score):  # what ties with the n-th is sorted too
                own = np.flatnonzero((score >= np.partition(score, -n)[-n]) & (score > 0))
            else:
                own = np.flatnonzero(score > 0)
            own = own[np.argsort(-score[own], kind="stable")][: n if n > 0 else None]
            which.append(np.full(len(own), i))
            best.append(order[own])
            scores.append(score[own])
        take = lambda column, at: column.take(pa.array(np.concatenate(at)))
        columns = [take(wants["query_id"].combine_chunks(), which), take(ids, best), pa.array(np.concatenate(scores))]
        return pa.Table.from_arrays(columns, ["query_id", "id", "score"])

    kinds = f"query_id {dict(pairs.dtypes)['query_id']}, id {ids_kind.elementType.simpleString()}, score double"
    # every cell has the row of its block's documents and a query
    return held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, kinds)


def search(index: Index, queries: DataFrame, n: int = 0, k1: float = K1, b: float = B, report: bool = False) -> DataFrame:
    """query_id, id, score, rank of the best n documents that share a term with the query, within its conversation; all of
    them for n <= 0. A term that a query repeats counts as often.

    With `report`: query_id, blocks and skipped instead, how many blocks have a term of the query and how many of these no
    document was scored in."""
    weights, parts = _asked(index, queries), -(-queries.count() // PART) or 1
    bounds = _bounds(index, weights, k1, b)
    if n <= 0:
        return top_n(_scored(index, weights, bounds, parts, 0, k1, b))
    highest = Window.partitionBy("query_id").orderBy(F.desc("bound"), "conversation_id", "block")
    bounds = written(bounds.withColumn("_place", F.row_number().over(highest)))
    first = written(_scored(index, weights, bounds.where("_place = 1"), parts, n, k1, b))
    limits = top_n(first, n).where(F.col("rank") == n).select("query_id", F.col("score").alias("limit"))
    rest = bounds.where("_place > 1").join(limits, "query_id", "left")
    rest = rest.where(F.col("limit").isNull() | (F.col("bound") >= F.col("limit") - 1e-6)).drop("limit")
    if report:
        scored = rest.groupBy("query_id").agg(F.count("*").alias("_rest"))
        counts = bounds.groupBy("query_id").agg(F.count("*").alias("blocks")).join(scored, "query_id", "left")
        return counts.select("query_id", "blocks", (F.col("blocks") - 1 - F.coalesce("_rest", F.lit(0))).alias("skipped"))
    return top_n(first.unionByName(_scored(index, weights, rest, parts, n, k1, b)), n)


def temporary_index(corpus: DataFrame, stemmed: bool = False) -> Index:
    return build(corpus, new_folder(corpus.sparkSession), stemmed)
