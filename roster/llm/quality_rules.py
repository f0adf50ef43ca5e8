"""Quality rules: counting rules, and a log-likelihood ratio of hashed n-grams.

The words and word pairs of a text fall into ``BUCKETS`` buckets by hash. Two multinomials over the
buckets, of the trusted documents and of the whole corpus, give each bucket the logarithm of how
much likelier it is among the trusted. The trusted counts start from ``PRIOR`` n-grams dealt like the
whole corpus, so few trusted n-grams say little of any bucket, frequent or rare, and none say nothing.
A text's score is the mean over its n-grams. Weights are rounded to millionths once, so sums are whole
numbers and verdicts don't depend on the order of addition.

Every text of a corpus gets a verdict by the same threshold. It follows from the number T of trusted
n-grams: the weight of n-grams that come ``SHARE`` times as often among the trusted as in the corpus,
less what good texts outside the trusted ones miss by chance. For independent draws that is half the
variance of the smoothed ratios, B T / (T + PRIOR)^2 / 2 over B buckets in use; it is taken twice, as
words of a text come in bursts. Both parts vanish with T, and the second also where T is large.

Everything is column expressions; the driver sees one row per bucket.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.llm.common import join_labels, let, without

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
UNIT = 1_000_000
PRIOR = 4 * BUCKETS
SHARE = 0.9
#: The threshold for any number of trusted n-grams large enough.
THRESHOLD = math.log(SHARE)
MIN_WORDS, MAX_REPEATED = 50, 50
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOL = r"[#*$%&|<>]"


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def words(text: Column) -> Column:
    inside = F.btrim(text, F.lit(_BLANKS))
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, r"[\x20\x09-\x0D]+", -1))


def _pairs(hashes: Column) -> Column:
    """Hashes of neighbouring words."""
    return F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))),
                      F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def bucket(hash_: Column) -> Column:
    return F.shiftrightunsigned(hash_, 64 - BUCKET_BITS).cast("int")


def repeated_words(hashes: Column, pairs: Column) -> Column:
    """Number of words in windows of three words that come twice or more.

    Windows with their places are sorted by hash; those equal to a neighbour come again. Each then
    covers its three words, less those the next one covers.
    """
    count = F.greatest(F.size(hashes) - 2, F.lit(0))
    triples = F.zip_with(F.slice(pairs, 1, count), F.slice(hashes, 3, count), lambda a, b: F.xxhash64(a, b))

    def places(placed: Column) -> Column:
        none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
        before = F.concat(none, F.slice(placed, F.lit(1), F.greatest(F.size(placed) - 1, F.lit(0))))
        after = F.concat(F.slice(placed, F.lit(2), F.size(placed)), none)
        rows = F.arrays_zip(placed.alias("own"), before.alias("before"), after.alias("after"))
        again = F.filter(rows, lambda r: (r["own"]["h"] == r["before"]["h"]) | (r["own"]["h"] == r["after"]["h"]))
        return F.sort_array(F.transform(again, lambda r: r["own"]["i"]))

    def placed(found: Column) -> Column:
        return F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(-3).alias("last"))

    def covered(found: Column) -> Column:
        return F.aggregate(
            let(placed(found), places), start,
            lambda total, i: F.struct(
                (total["covered"] + F.least(F.lit(3), i - total["last"])).alias("covered"), i.alias("last")
            ),
            lambda total: total["covered"],
        )

    # most texts repeat no window and need no sorting
    none = F.lit(0).cast("long")
    return let(triples, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), none).otherwise(covered(t)))


def _features(docs: DataFrame) -> DataFrame:
    """Hashes of words and pairs, each made once per text."""
    worded = docs.withColumn("_words", words(_text()))
    hashed = worded.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    return hashed.withColumn("_pairs", _pairs(F.col("_hashes")))


def train(docs: DataFrame, trusted: DataFrame) -> tuple[list[int], float]:
    """Weight of each bucket in millionths, from the n-grams of all documents and of the trusted
    (doc_id), and the threshold; buckets nobody uses weigh nothing. Without trusted documents all weigh
    nothing and the threshold is 0."""
    marked = trusted.select("doc_id").filter("doc_id IS NOT NULL").distinct().withColumn("_trusted", F.lit(1))
    known = _features(join_labels(docs.select("doc_id", "text"), marked, "left"))
    grams = known.select("_trusted", F.explode(F.concat("_hashes", "_pairs")).alias("gram"))
    counted = grams.groupBy(bucket(F.col("gram")).alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("target")).collect()
    all_raw, all_target = sum(n for _, n, _ in counted), sum(t for _, _, t in counted)
    weight = [0] * BUCKETS
    for at, n, t in counted:
        weight[at] = round(UNIT * math.log((t * all_raw / n + PRIOR) / (all_target + PRIOR)))
    missed = len(counted) * all_target / (all_target + PRIOR) ** 2
    return weight, math.log((SHARE * all_target + PRIOR) / (all_target + PRIOR)) - missed


def weights(docs: DataFrame, trusted: DataFrame) -> list[int]:
    """Weight of each bucket in millionths."""
    return train(docs, trusted)[0]


def judge(docs: DataFrame, weight: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    A null or empty text has no words, so it fails. The score is the mean weight of the text's words
    and word pairs, 0 without any. Input columns with the names of results are replaced.
    """
    table = F.from_json(F.lit(json.dumps(weight)), "array<int>")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    base = without(docs, *names)
    lines = F.filter(F.split(_text(), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    total = F.aggregate(
        F.concat("_hashes", "_pairs"), F.lit(0).cast("long"), lambda sum_, h: sum_ + F.element_at(table, bucket(h) + 1)
    )
    found = (
        _features(base)
        .withColumns({
            "n_words": F.size("_hashes").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(_text(), F.lit(_SYMBOL)).cast("long"),
            "_lines": lines,
            "n_repeat_words": repeated_words(F.col("_hashes"), F.col("_pairs")),
            "_total": total,
        })
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
        .withColumn("score", F.col("_total") / (UNIT * F.greatest(2 * F.col("n_words") - 1, F.lit(1))))
    )
    kept = ~F.col("base_failed") & (F.col("score") >= threshold)
    return found.withColumn("kept", kept).select(*base.columns, *names)


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents judged, with those labelled of good quality as the trusted ones.

    Repeated rows are judged alike; a null doc_id is judged and never trusted.
    """
    return judge(docs, *train(docs, labels.filter("quality = 1")))
