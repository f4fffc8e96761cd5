"""Classification by compression: language of a text, and its quality.

For each class a raw-content zstandard dictionary is made of a bounded sample of its labelled rows. A text is compressed,
in blocks so that the dictionary stays what matters, with each class's dictionary; the smallest result tells the class.
Models are dictionaries of a bounded size, broadcast to the tasks; every text is read whole, and rows stay where they are
(no shuffle of texts).

What a dictionary holds: of each class the `BLOCKS` rows with the least hashes of id and text, whose whole texts are cut into blocks of `SNIPPET` characters. One
block of each row is taken, chosen by hash, then a second one of each, until there are `BLOCKS`. So every sampled row is in
it, no place in a text is preferred, and nothing that is gathered is thrown away. `BLOCKS` and, for quality, `CALIBRATION` are
limits for each class, however often an id or a row is repeated.

Defined cases: a null text or one without a letter has language `und` and score 0; a null text has the quality of an empty
one; a very long text is compressed block by block; without any labelled row the language is `und`, and without both
labels, or where they can't be told apart, the quality is their smoothed share; documents labelled both ways aren't learned from; ties between languages go to
the more frequent one; rows that are repeated or share an id are judged each; of more than `LANGUAGES` languages the most
frequent are learned; an empty table gives an empty result. Only the id, text, language and label columns are read.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

#: Blocks in a class's dictionary, and their characters. Languages share ALL_BLOCKS if there are many.
BLOCKS, SNIPPET, ALL_BLOCKS = 1024, 256, 1 << 16
#: Rows of each class that quality is learned from, and the folds in which scores are calibrated on them.
CALIBRATION, FOLDS = 4000, 5
LEVEL, LANG_BLOCK, QUALITY_BLOCK = 9, 512, 128
#: What zstandard writes around each block; left out of sizes.
FRAME = 3
#: A language is rejected if the next one's size is less than this share above.
MARGIN = 0.01
#: How fast a language's share of the score falls with its size above the least, as a share of that.
SHARPNESS = 60.0
#: Languages that are learned; digested dictionaries and rows that a task works on at once.
LANGUAGES, AT_ONCE, ROWS = 4096, 64, 1024


def in_training(folds: int = 5) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0


def held_out(folds: int = 5) -> Column:
    return F.coalesce(~in_training(folds), F.lit(False))


def place() -> Column:
    """A row's place in the order that samples are taken in."""
    return F.xxhash64(F.col("doc_id").cast("string"), "text")


def slim_rows(rows: DataFrame) -> DataFrame:
    """The distinct (_class, doc_id, _place) of labelled rows, without their texts, and _rows, how many are alike; written."""
    return written(rows.groupBy("_class", "doc_id", "_place").agg(F.count("*").alias("_rows")))


def class_counts(slim: DataFrame, most: int) -> DataFrame:
    """_class, _n (its rows) and _distinct (those that aren't alike) of the most frequent classes."""
    counts = slim.groupBy("_class").agg(F.sum("_rows").alias("_n"), F.count("*").alias("_distinct"))
    return written(counts.orderBy(F.desc("_n"), "_class").limit(most))


def sampled(docs: DataFrame, slim: DataFrame, counts: DataFrame, wanted: int) -> DataFrame:
    """_class, doc_id, text, _rank and _n of the first `wanted` rows of each class in `counts` in the order of their places.

    Only slim rows are ranked, and of those what lies beyond where the first `wanted` end is left out before, as places are
    spread evenly; so what meets the texts is bounded by `wanted` for each class, and is broadcast."""
    at = F.pmod("_place", F.lit(1 << 30))
    far = (wanted + 8 * math.sqrt(wanted) + 16) / F.col("_distinct") * float(1 << 30)
    order = Window.partitionBy("_class").orderBy("_at", "_place", "doc_id")
    first = slim.join(F.broadcast(counts), "_class").withColumn("_at", at).where(F.col("_at") < far)
    first = written(first.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= wanted).select("_class", "doc_id", "_place", "_n"))
    rows = docs.select("doc_id", "text", place().alias("_place")).join(F.broadcast(first), ["doc_id", "_place"])
    order = Window.partitionBy("_class").orderBy("_at", "_place", "doc_id", "text")
    rows = rows.withColumn("_at", at).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= wanted)
    return rows.select("_class", "doc_id", "text", "_rank", "_n")


def snippets(rows: DataFrame, blocks: int) -> dict[object, list[str]]:
    """Blocks of the sampled rows' whole texts, one of each row, then a second one of each, and so on."""
    pieces = F.greatest(F.ceil(F.length("text") / SNIPPET), F.lit(1)).cast("int")
    cut = rows.withColumn("_at", F.explode(F.sequence(F.lit(0), pieces - 1))).withColumn("_turn_hash", F.xxhash64("doc_id", "_rank", "_at"))
    turn = F.row_number().over(Window.partitionBy("_class", "_rank").orderBy("_turn_hash", "_at"))
    cut = cut.select("_class", "_rank", "_turn_hash", turn.alias("_turn"), F.col("text").substr(F.col("_at") * SNIPPET + 1, F.lit(SNIPPET)).alias("text"))
    order = Window.partitionBy("_class").orderBy("_turn", "_rank")
    got = cut.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= blocks).select("_class", "_n", "text").collect()
    out: dict[object, list[str]] = {}
    for r in sorted(got, key=lambda r: r["_n"]):
        out.setdefault(r["_class"], []).append(r["text"])
    return out


def dictionary(texts: list[bytes]) -> bytes:
    return b"\n".join(texts)


def compressor(content: bytes, level: int = LEVEL) -> Callable[[bytes], bytes]:
    import zstandard

    options = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(content) < 8:  # too short to be a dictionary
        return zstandard.ZstdCompressor(**options).compress
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=made, **options).compress


def size(compress: Callable[[bytes], bytes], data: bytes, block: int) -> int:
    return sum(len(compress(data[i : i + block])) - FRAME for i in range(0, len(data), block))


_compressors: dict[bytes, Callable[[bytes], bytes]] = {}


def kept_compressor(content: bytes) -> Callable[[bytes], bytes]:
    """The same in each task of a worker; digesting a dictionary takes long."""
    if content not in _compressors:
        if len(_compressors) > 2 * AT_ONCE:
            _compressors.clear()
        _compressors[content] = compressor(content)
    return _compressors[content]


_model_compressors: list = [None, None]


def model_compressors(model: list) -> list:
    """Of one model of quality, the last that the worker was asked for: rows are to come model by model."""
    if _model_compressors[0] != model:
        _model_compressors[:] = model, [[compressor(c) for c in pair] for pair in model]
    return _model_compressors[1]


def learn_languages(docs: DataFrame) -> list[tuple[str, bytes]]:
    """Each language and its dictionary, the most frequent one first."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & in_training())
    slim = slim_rows(known.select(F.col("lang").alias("_class"), "doc_id", place().alias("_place")))
    counts = class_counts(slim, LANGUAGES)
    order = [r["_class"] for r in sorted(counts.collect(), key=lambda r: (-r["_n"], r["_class"]))]
    blocks = min(BLOCKS, ALL_BLOCKS // max(len(order), 1))
    found = snippets(sampled(known, slim, counts, blocks), blocks)
    return [(x, dictionary([t.lower().encode() for t in found.get(x, [])])) for x in order]


def sizes(texts: list[bytes], contents: list[bytes], block: int = LANG_BLOCK) -> np.ndarray:
    """Of each text, with each dictionary; so many dictionaries are digested at a time as a worker keeps."""
    out = np.zeros((len(texts), len(contents)))
    for start in range(0, len(contents), AT_ONCE):
        for j, content in enumerate(contents[start : start + AT_ONCE], start):
            compress = kept_compressor(content)
            out[:, j] = [size(compress, x, block) for x in texts]
    return out


def languages(texts: list[str | None], names: list[str], contents: list[bytes], margin: float = MARGIN) -> list[tuple[str, float, bool]]:
    """Of each text the language, a score, and whether the margin is too narrow to rely on it. The score goes by the sizes'
    shares above the least, so that it doesn't rise with the length of a text."""
    told = [i for i, x in enumerate(texts) if x and names and any(map(str.isalpha, x))]
    out = [("und", 0.0, True)] * len(texts)
    for i, found in zip(told, sizes([texts[i].lower().encode() for i in told], contents)):
        best = int(found.argmin())
        above = found / max(found[best], 1) - 1
        others = np.delete(above, best)
        out[i] = names[best], float(1 / np.exp(-SHARPNESS * np.maximum(above, 0)).sum()), bool(len(others) and others.min() < margin)
    return out


def identify(docs: DataFrame, models: list[tuple[str, bytes]]) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every text; the function sees nothing else of a row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, contents = [x for x, _ in shared.value], [x for _, x in shared.value]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                found = languages(b.column(1).to_pylist(), names, contents)
                columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


#: Letters' cases, digits and other signs, for a view of a text's form without its words.
_FORM = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_WORDS = re.compile(rb"([^\x20\x09-\x0D]+)")


def form(data: bytes) -> bytes:
    """Each letter's case, digits and signs, as many as there are; a word that repeats the one before it is, with the space
    before it, one byte that counts its repetitions, as a dictionary then tells long repetitions from short ones."""
    out, last, again = [], None, 0
    for word in _WORDS.split(data):
        if not word or word[0] in b" \t\n\x0b\x0c\r":
            out.append(word)
        elif word == last:
            again += 1
            out[-1] = bytes((128 + again % 128,))
        else:
            last, again = word, 0
            out.append(word.translate(_FORM))
    return b"".join(out)


#: How a text is seen; each view has its own two dictionaries.
VIEWS: tuple[Callable[[bytes], bytes], ...] = (bytes, form)
#: A view's normalised difference counts as the hyperbolic tangent of so many times itself, so that one far out isn't all.
SURE = 8.0


def differences(text: str | None, pairs: list) -> list[float]:
    """Of each view the normalised difference of the sizes with the bad and the good dictionary."""
    data, out = (text or "").encode(), []
    for view, (bad, good) in zip(VIEWS, pairs):
        seen = view(data)
        b, g = size(bad, seen, QUALITY_BLOCK), size(good, seen, QUALITY_BLOCK)
        out.append((b - g) / max(b + g, 1))
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression of one column, by Newton's method: intercept and slope."""
    mean, spread = x.mean(), x.std() + 1e-9
    z, w, hold = np.column_stack([np.ones(len(x)), (x - mean) / spread]), np.zeros(2), np.diag([1e-6, ridge])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold, z.T @ (y - p) - hold @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return np.array([w[0] - w[1] / spread * mean, w[1] / spread])


def learn_quality(docs: DataFrame, labels: DataFrame) -> dict:
    """The dictionaries of bad and good texts and of their forms, and the weights that make the sum of differences a score.

    Every sampled row is in the dictionaries, and every one calibrates the score: with its difference by dictionaries of
    the other folds' rows, which are made alike. Without both labels, or if good texts' differences aren't above bad ones'
    (of too few rows to learn from), the score is the labels' smoothed share."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & in_training())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_class"), F.max("quality").alias("_most"))
        .where("_class = _most")
        .select(F.col("doc_id").alias("_labelled"), "_class")
    )
    texts = docs.where(F.col("text").isNotNull())
    slim = texts.select("doc_id", place().alias("_place")).join(known, F.col("doc_id") == F.col("_labelled"))
    slim = slim_rows(slim)
    counts = class_counts(slim, 2)
    n = {int(r["_class"]): r["_n"] for r in counts.collect()}
    prior = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    if len(n) < 2:
        return {"prior": prior}
    # a text that is there more than once is in one fold
    drawn = written(sampled(texts, slim, counts, CALIBRATION).withColumn("_fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")))
    others = F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda i: i != F.col("_fold"))  # the last model is of all rows
    dealt = drawn.withColumn("_in", F.explode(others)).withColumn("_class", F.concat_ws(":", "_in", "_class"))
    found = snippets(dealt, BLOCKS)
    models = [[[t.encode() for t in found.get(f"{i}:{k}", [])] for k in (0, 1)] for i in range(FOLDS + 1)]
    models = [[[dictionary([view(t) for t in part]) for part in parts] for view in VIEWS] for parts in models]
    by_fold = drawn.repartition(FOLDS, "_fold").sortWithinPartitions("_fold")  # so a worker has one fold's dictionaries at a time
    rows = measured(by_fold, models, ["_class"], "_fold").select("row._class", "difference").collect()
    x, y = np.array([r["difference"] for r in rows]), np.array([r["_class"] for r in rows], float)
    w = fit(np.tanh(SURE * x).sum(1), y)
    if w[1] <= 0:
        return {"prior": prior}
    # each class was sampled at its own rate, so its rows are weighed back to its share
    share = y.mean()
    w[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return {"prior": prior, "contents": models[-1], "weights": w.tolist()}


def measured(docs: DataFrame, models: list, carried: Sequence[str], which: str | None = None) -> DataFrame:
    """The differences of every text, by the model whose place the column `which` has, and its row: a struct of the
    columns to carry, whatever their names."""
    place_of = F.col(which) if which else F.lit(0)
    rows = docs.select(F.struct(*carried).alias("row"), place_of.cast("int").alias("which"), *([] if "text" in carried else ["text"]))
    kind = rows.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2) if b.num_columns > 2 else b.column(0).field("text")
            found = [differences(x.as_py(), model_compressors(shared.value[i])) for x, i in zip(texts, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float64()))], ["row", "difference"])

    return rows.mapInArrow(run, f"row {kind}, difference array<double>")


def scored(docs: DataFrame, model: dict, carried: Sequence[str] = ("doc_id",)) -> DataFrame:
    """row (the columns to carry) and score, the probability of label 1, of every row."""
    if "weights" not in model:
        return docs.select(F.struct(*carried).alias("row"), F.lit(model["prior"]).alias("score"))
    base, slope = model["weights"]
    told = [F.tanh(SURE * F.get("difference", F.lit(i))) for i in range(len(VIEWS))]
    z = F.lit(base) + functools.reduce(operator.add, told) * slope
    return measured(docs, [model["contents"]], carried).select("row", (1 / (1 + F.exp(-z))).alias("score"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn_languages(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


#: The least score of a document that is kept.
LEAST_SCORE = 0.3


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = scored(docs, learn_quality(docs, table(spark, sf_dir, "labels"))).select("row.doc_id", "score")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
