"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base measures are computed over the whole text. A rule rejects a document whose ratio is above a cutoff. Labelled texts,
each distinct one of a stratum once, are split in two by a hash. On the first half the pairs of a rule and a cutoff that
reject more than they cost are put in a row, from the fewest good texts rejected on; each prefix of the row is a set of
rules with one cutoff each, and the sets grow. The second half, the holdout, tests the sets in that order by what they
reject together: a set passes if, were the true rate of rejected good texts `risk` or more, so few rejections as were seen
would have a probability of at most `doubt / strata` (the exact binomial tail, so that the exact upper confidence bound is
below `risk`). The first that fails ends the row, so trying many sets needs no further correction (fixed-sequence testing);
the division over strata is Bonferroni's. With probability 1 - doubt, the rules of every stratum then reject, all together,
less than `risk` of its good texts. Of the sets that pass, the one with the best balance of bad and good texts rejected is
used; a stratum with few labels (217 good ones in the holdout for four strata) has no learned rule. The base rules hold
everywhere, whatever labels say, and are not part of the guarantee.

Defined cases: null text has no words; a null stratum is a stratum; a text labelled both ways counts as good, as that is
the careful side; labels that are null or neither 0 nor 1 are left out; repeated rows, null ids and shared ids are measured
and judged each by their own text; a very long text is measured whole, in its own row; empty tables give an empty result.
Only the id, text and stratum columns are read, so other columns can have any names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, WORD, null_safe, table, written

#: Words in a window that is looked for again in the same text.
WINDOW = 8
#: The rate of good texts that a stratum's rules may reject together, and the probability that any stratum's is above.
RISK, DOUBT = 0.02, 0.05
#: A good document that is rejected weighs as this many bad ones that are kept.
GOOD_WEIGHS = 4
#: More strata than this are not broadcast.
MOST_BROADCAST = 10_000
_SHARES = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06)
#: The rules' cutoffs, from the loosest on.
CUTS: dict[str, tuple[float, ...]] = {
    "symbols": (3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07),
    "shouting": _SHARES,
    "repeated_words": _SHARES,
    "repeated_lines": _SHARES,
    "long_words": (100.0, 60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.0),
}


def _rules() -> dict[str, tuple[Column, tuple[float, ...]]]:
    """What each rule measures, and its cutoffs."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    values = {
        "symbols": F.col("n_symbols") / words,
        "shouting": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / words,
        "repeated_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "long_words": F.col("word_chars") / words,
    }
    return {name: (value, CUTS[name]) for name, value in values.items()}


def measures(docs: DataFrame, carried: Sequence[str] = ("doc_id",), stratum: str = "lang", window: int = WINDOW) -> DataFrame:
    """row (a struct of the columns to carry), doc_id, stratum, digest (of the text) and n_words, word_chars, n_symbols,
    n_dup_lines, n_lines, n_upper, n_repeat_words of whole texts.

    A window of words is compared by its 64-bit hash. Positions of windows that occur again are found by sorting the
    text's hashes only if some hash occurs again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    rows = docs.select(
        F.struct(*carried).alias("row"),
        "doc_id",
        F.col(stratum).cast("string").alias("stratum"),
        text.alias("_text"),
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
    )
    n = F.size("_words")
    rows = rows.select(
        "row",
        "doc_id",
        "stratum",
        F.md5("_text").alias("digest"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(n > window, F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice("_words", i, window)))).alias("_hashes"),
    )
    again = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    rows = rows.withColumn(
        "_sorted",
        F.when(again, F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("_hashes")
    same = lambda x, k: (x["h"] == F.get("_sorted", k - 1)["h"]) | (x["h"] == F.get("_sorted", k + 1)["h"])
    found = F.filter("_sorted", lambda x, k: F.coalesce(same(x, k), F.lit(False)))
    rows = rows.withColumn("_at", F.array_sort(F.transform(found, lambda x: x["i"]))).drop("_sorted")
    # a word that several windows hold counts once: each window adds the words up to the next window's start
    steps = F.zip_with("_at", F.slice("_at", F.lit(2), F.greatest(F.size("_at") - 1, F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)
    return rows.withColumn("n_repeat_words", F.when(F.col("_at").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("_at")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by 8; good to 1e-12 for x >= 1."""
    y = x + 8.0
    shift = sum((F.log(x + float(i)) for i in range(1, 8)), F.log(x))
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), for k < n p; 1 elsewhere. The sum runs down from k, as its terms fall from there: the j-th is
    below exp(-j (j - 1) / 2 k) times the first, so that those after 10 roots of k are less than the digits of a double."""
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    zero = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * ((k - j + 1) / (n - k + j) * ((1 - p) / p))
        return F.struct((s["sum"] + term).alias("sum"), term.alias("term"))

    terms = F.greatest(F.least(k, F.ceil(10 * F.sqrt(k)) + 20), F.lit(1)).cast("int")
    summed = F.aggregate(F.sequence(F.lit(1), terms), zero, step, lambda s: s["sum"])
    return F.when(k >= n * p, 1.0).when(k == 0, first).otherwise(F.least(first * summed, F.lit(1.0)))


def _few(strata: DataFrame) -> DataFrame:
    """A table with a row for each stratum, broadcast only if they are counted to be few."""
    return F.broadcast(strata) if strata.count() <= MOST_BROADCAST else strata


def labelled(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, good, held (in the holdout) and levels of each distinct text that has labels. A level is, for each rule,
    the number of the first cutoff that rejects; past the last if none does."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("_labelled"))
        .agg(F.max("quality").alias("_quality"))
    )
    levels = F.array(*(sum((F.when(value > c, 0).otherwise(1) for c in cuts), F.lit(1)) for value, cuts in _rules().values()))
    rows = measured.join(known, measured["doc_id"] == known["_labelled"]).select("stratum", "digest", "_quality", levels.alias("levels"))
    rows = rows.groupBy("stratum", "digest").agg((F.max("_quality") == 1).alias("good"), F.max("levels").alias("levels"))
    return rows.select("stratum", "good", (F.substring("digest", 1, 1) >= "8").alias("held"), "levels")


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """stratum and one cutoff for each rule (null: none passed), from the labelled rows of `measured`."""
    rows = written(labelled(measured, labels))
    n_good, n_bad = F.count_if("good"), F.count_if(~F.col("good"))
    totals = written(
        rows.groupBy("stratum").agg(
            *(F.count_if((F.col("good") == good) & (F.col("held") == held)).alias(f"n_{name}_{part}") for good, name in ((True, "good"), (False, "bad")) for held, part in ((False, "first"), (True, "held")))
        )
    )
    gain = lambda part: F.col("bad") - GOOD_WEIGHS * F.col("good") * F.greatest(F.col(f"n_bad_{part}"), F.lit(1)) / F.col(f"n_good_{part}")
    so_far = lambda within, by: Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    # every cutoff of every rule and what it rejects in the first half
    cells = [F.struct(F.lit(i).alias("place"), F.lit(k).alias("level"), F.lit(float(c)).alias("cutoff")) for i, cuts in enumerate(CUTS.values()) for k, c in enumerate(cuts, 1)]
    grid = totals.select("stratum", "n_good_first", "n_bad_first", F.inline(F.array(*cells)))
    counts = rows.where("not held").select("stratum", "good", F.posexplode("levels").alias("place", "level"))
    counts = counts.groupBy("stratum", "place", "level").agg(n_good.alias("good"), n_bad.alias("bad"))
    grid = null_safe(grid, counts, ["stratum", "place", "level"], "left")
    grid = grid.withColumns({c: F.coalesce(F.sum(c).over(so_far(["stratum", "place"], "level")), F.lit(0)) for c in ("good", "bad")})
    worth = (F.col("n_good_first") > 0) & (gain("first") > 0)
    order = Window.partitionBy("stratum", "_worth").orderBy("good", F.desc("bad"), "place", "level")
    grid = grid.withColumn("_worth", worth).withColumn("step", F.when(F.col("_worth"), F.row_number().over(order)))
    grid = written(grid.select("stratum", "place", "level", "cutoff", "step"))
    # what the sets reject together in the holdout: each text counts at its first step
    downward = Window.partitionBy("stratum", "place").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    firsts = grid.withColumn("first", F.min("step").over(downward)).groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("place", "level", "first"))).alias("_firsts"))
    held = null_safe(rows.where("held"), _few(written(firsts)), ["stratum"])
    starts = F.array(*(F.lit(sum(map(len, list(CUTS.values())[:i]))) for i in range(len(CUTS))))
    lengths = F.array(*(F.lit(len(cuts)) for cuts in CUTS.values()))
    step = lambda level, i: F.when(level <= F.get(lengths, i), F.get("_firsts", F.get(starts, i) + level - 1)["first"])
    held = held.select("stratum", "good", F.array_min(F.transform("levels", step)).alias("step")).where("step is not null")
    seen = held.groupBy("stratum", "step").agg(n_good.alias("good"), n_bad.alias("bad"))
    steps = null_safe(grid.where("step is not null").select("stratum", "step"), seen, ["stratum", "step"], "left")
    steps = null_safe(steps, totals.select("stratum", "n_good_held", "n_bad_held"), ["stratum"])
    steps = steps.withColumns({c: F.coalesce(F.sum(c).over(so_far(["stratum"], "step")), F.lit(0)) for c in ("good", "bad")})
    steps = steps.where("n_good_held > 0").withColumn("_fails", binomial_tail(F.col("good"), F.col("n_good_held"), risk) > doubt / max(totals.count(), 1))
    steps = steps.withColumn("_failed", F.max("_fails").over(so_far(["stratum"], "step"))).where("not _failed").withColumn("_gain", gain("held"))
    best = Window.partitionBy("stratum").orderBy(F.desc("_gain"), "step")
    used = steps.where("_gain > 0").withColumn("_n", F.row_number().over(best)).where("_n = 1").select("stratum", F.col("step").alias("_last"))
    grid = null_safe(grid.where("step is not null"), used, ["stratum"]).where("step <= _last")
    return grid.groupBy("stratum").agg(*(F.min(F.when(F.col("place") == i, F.col("cutoff"))).alias(f"max_{name}") for i, name in enumerate(CUTS)))


def judged(docs: DataFrame, labels: DataFrame, carried: Sequence[str] = ("doc_id",), stratum: str = "lang", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """The measures of each document and the columns to carry in `row`, with base_failed, rejected_by (names of rules) and kept."""
    measured = written(measures(docs, carried, stratum))
    rows = null_safe(measured, _few(written(thresholds(measured, labels, risk, doubt))), ["stratum"], "left")
    hits = [F.when(value > F.col(f"max_{name}"), F.lit(name)) for name, (value, _) in _rules().items()]
    rows = rows.withColumn("rejected_by", F.array_compact(F.array(*hits))).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rule = F.array_join("rejected_by", ",").alias("rejected_by")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", rule)


def _sql() -> str:
    """The same in SQL, with the tail's terms summed one by one."""
    values = {
        "symbols": "n_symbols / greatest(n_words, 1)::DOUBLE",
        "shouting": "n_upper / greatest(word_chars, 1)::DOUBLE",
        "repeated_words": "n_repeat_words / greatest(n_words, 1)::DOUBLE",
        "repeated_lines": "n_dup_lines / greatest(n_lines, 1)::DOUBLE",
        "long_words": "word_chars / greatest(n_words, 1)::DOUBLE",
    }
    parts = " UNION ALL ".join(
        f"SELECT r, doc_id, stratum, digest, {i} AS place, '{rule}' AS rule, {values[rule]} AS value, {list(cuts)}::DOUBLE[] AS cuts FROM m" for i, (rule, cuts) in enumerate(CUTS.items())
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, stratum, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
win AS (SELECT r, i, list_slice(w, i, i + {WINDOW - 1}) AS k FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) > {WINDOW})),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
cov AS (SELECT r, CAST(sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
m AS (SELECT w.r, doc_id, stratum, md5(t) AS digest, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov ON cov.r = w.r),
x AS ({parts}),
known AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
lab AS (SELECT stratum, digest, max(q) = 1 AS good, digest >= '8' AS held FROM m JOIN known USING (doc_id) GROUP BY stratum, digest),
v AS (SELECT DISTINCT x.stratum, x.digest, place, rule, value, cuts, good, held FROM x JOIN lab ON x.stratum IS NOT DISTINCT FROM lab.stratum AND x.digest = lab.digest),
tot AS (SELECT stratum, count(*) FILTER (WHERE good AND NOT held) AS good_a, count(*) FILTER (WHERE NOT good AND NOT held) AS bad_a,
  count(*) FILTER (WHERE good AND held) AS good_b, count(*) FILTER (WHERE NOT good AND held) AS bad_b FROM lab GROUP BY stratum),
u AS (SELECT stratum, digest, place, rule, value, good, held, unnest(cuts) AS cut, generate_subscripts(cuts, 1) AS level FROM v),
g AS (SELECT stratum, place, rule, level, cut, count(*) FILTER (WHERE NOT held AND good AND value > cut) AS good, count(*) FILTER (WHERE NOT held AND NOT good AND value > cut) AS bad FROM u GROUP BY ALL),
cand AS (SELECT g.*, row_number() OVER (PARTITION BY g.stratum ORDER BY good, bad DESC, place, level) AS step FROM g JOIN tot ON g.stratum IS NOT DISTINCT FROM tot.stratum
  WHERE good_a > 0 AND bad - {GOOD_WEIGHS} * good * greatest(bad_a, 1) / good_a::DOUBLE > 0),
hit AS (SELECT u.stratum, u.digest, u.good, min(step) AS step FROM u JOIN cand c ON u.stratum IS NOT DISTINCT FROM c.stratum AND u.rule = c.rule AND u.level = c.level AND value > u.cut WHERE held GROUP BY ALL),
p AS (SELECT c.stratum, c.step, good_b, bad_b, (SELECT count(*) FROM hit WHERE hit.stratum IS NOT DISTINCT FROM c.stratum AND hit.step <= c.step AND hit.good) AS good,
  (SELECT count(*) FROM hit WHERE hit.stratum IS NOT DISTINCT FROM c.stratum AND hit.step <= c.step AND NOT hit.good) AS bad FROM cand c JOIN tot ON c.stratum IS NOT DISTINCT FROM tot.stratum WHERE good_b > 0),
f AS (SELECT *, CASE WHEN good >= good_b * {RISK} THEN 1 ELSE list_sum([exp(lgamma(good_b + 1) - lgamma(i + 1) - lgamma(good_b - i + 1) + i * ln({RISK}) + (good_b - i) * ln(1 - {RISK}))
  FOR i IN range(0, good + 1)]) END > {DOUBT} / (SELECT count(*) FROM tot) AS fails, bad - {GOOD_WEIGHS} * good * greatest(bad_b, 1) / good_b::DOUBLE AS gain FROM p),
s AS (SELECT *, bool_or(fails) OVER (PARTITION BY stratum ORDER BY step) AS failed FROM f),
chosen AS (SELECT stratum, step FROM s WHERE NOT failed AND gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, step) = 1),
c AS (SELECT cand.stratum, rule, min(cut) AS cut FROM cand JOIN chosen ON cand.stratum IS NOT DISTINCT FROM chosen.stratum AND cand.step <= chosen.step GROUP BY cand.stratum, rule),
h AS (SELECT r, string_agg(x.rule, ',' ORDER BY place) AS rejected_by FROM x JOIN c ON x.stratum IS NOT DISTINCT FROM c.stratum AND x.rule = c.rule AND x.value > c.cut GROUP BY r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM b LEFT JOIN h USING (r)
"""


OP10_SQL = _sql()
