"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs, where long paragraphs count sentence by sentence. Each
is hashed to a wide vector, and the fingerprint is the sum of the vectors, lane by lane modulo powers
of two: order plays no part, equal texts have equal fingerprints, and a paragraph's vector can be added
or taken away without the text. ``LANES`` lanes of 15 bits count ones of hash bits, ``SUMS`` lanes of
60 bits add whole hashes up, and one counts the paragraphs.

The bit lanes also measure likeness. A lane's count of ones, twice, less the count of paragraphs is a
sum of random signs, so the squared distance of two texts' signed lanes estimates how many paragraphs
they don't share, and the squared norms how many they have.

Everything is column expressions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roster.llm.common import let

#: Four lanes share a word of 60 bits.
LANES, SUMS = 120, 4
_WORDS = LANES // 4
_LANE_BITS = 15
_WORD = (1 << 60) - 1
_ONES = sum(1 << (_LANE_BITS * i) for i in range(4))
#: A paragraph ends at a line break, a sentence after . ! ? ; or | and a blank.
_CUT = r"\n|(?<=[.!?;|])[\x20\t]"
#: Documents are dealt by ranges of ids into groups of about ``GROUP_ROWS``, at most 2 ^ ``GROUP_BITS``.
GROUP_ROWS, GROUP_BITS = 2000, 12


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, _CUT, -1), lambda p: F.length(p) > 0)


def hashes(text: Column) -> Column:
    """Four hashes of every paragraph."""
    return F.transform(
        paragraphs(text),
        lambda p: F.array(F.xxhash64(p), F.xxhash64(F.lit(1), p), F.xxhash64(F.lit(2), p), F.xxhash64(F.lit(3), p)),
    )


def vector(text: Column) -> Column:
    """The sums, as an array of ``LANES`` / 4 + ``SUMS`` + 1 numbers."""
    return let(hashes(text), _sums)


def _sums(hashes: Column) -> Column:
    ones, word = F.lit(_ONES).cast("long"), F.lit(_WORD).cast("long")

    def bits(number: int) -> Column:
        hash_, shift = number % 2, number // 2  # 15 shifts of a hash give each of its low 60 bits a lane
        return F.aggregate(
            hashes, F.lit(0).cast("long"),
            lambda total, h: (total + F.shiftrightunsigned(h[hash_], shift).bitwiseAND(ones)).bitwiseAND(word),
        )

    def whole(number: int) -> Column:
        return F.aggregate(
            hashes, F.lit(0).cast("long"), lambda total, h: (total + h[number].bitwiseAND(word)).bitwiseAND(word)
        )

    return F.array(*[bits(i) for i in range(_WORDS)], *[whole(i) for i in range(SUMS)], F.size(hashes).cast("long"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector of the paragraphs of ``a`` with those of ``b`` put in, or taken out (``sign`` -1)."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(_WORD).cast("long")))


def as_text(sums: Column) -> Column:
    """The fingerprint: a vector in hexadecimal."""
    return F.array_join(F.transform(sums, lambda x: F.lower(F.lpad(F.hex(x), 15, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common paragraphs, from 0 to 1; 1 for two texts without paragraphs.

    Twice the common paragraphs by all paragraphs of both, each as often as it comes. A lane wraps at
    32,768 paragraphs; texts of more blur the estimate.
    """
    last = _WORDS + SUMS + 1
    n, m = F.element_at(a, last), F.element_at(b, last)
    both = F.arrays_zip(F.slice(a, 1, _WORDS).alias("a"), F.slice(b, 1, _WORDS).alias("b"))
    mask = F.lit((1 << _LANE_BITS) - 1).cast("long")

    def lanes(word: Column, count: Column) -> list[Column]:
        """Sums of signs: twice the ones less the count."""
        ones = [F.shiftrightunsigned(word, _LANE_BITS * i).bitwiseAND(mask) for i in range(4)]
        return [(2 * x - count).cast("double") for x in ones]

    def squares(values: list[Column]) -> Column:
        return sum((x * x for x in values[1:]), values[0] * values[0])

    zero = F.struct(F.lit(0.0).alias("apart"), F.lit(0.0).alias("size"))

    def add(total: Column, pair: Column) -> Column:
        x, y = lanes(pair["a"], n), lanes(pair["b"], m)
        apart = squares([i - j for i, j in zip(x, y)])
        return F.struct((total["apart"] + apart).alias("apart"), (total["size"] + squares(x) + squares(y)).alias("size"))

    def finish(total: Column) -> Column:
        share = 1 - total["apart"] / total["size"]
        return F.when(total["size"] == 0, 1.0).otherwise(F.greatest(F.lit(0.0), share))

    return F.aggregate(both, zero, add, finish)


def fingerprint(docs: DataFrame) -> DataFrame:
    """Add ``fingerprint``; a column of that name is replaced. A null text is empty."""
    return docs.withColumn("fingerprint", as_text(vector(F.coalesce("text", F.lit("")))))


def _grouped(rows: DataFrame, key: str) -> tuple[DataFrame, Window]:
    """Rows dealt into ranges of ``key``, and a window in which each row's successor follows it.

    The cuts between ranges are keys that exist, so the rows of a cut are the first of their range; copies
    of them (``_copy``) end the range before, and those of the least key end the last range. Only the
    cuts come to the driver.
    """
    count, least = rows.agg(F.count(F.lit(1)), F.min(key)).first()
    groups = min(1 << GROUP_BITS, max(1, count // GROUP_ROWS))
    shares = [i / groups for i in range(1, groups)]
    cuts = rows.agg(F.percentile_approx(key, shares, 100 * groups)).first()[0] if shares and count else []
    cuts = sorted({least, *(cuts or [])}) if count else [0]
    bits = max(1, (len(cuts) - 1).bit_length())
    table = F.from_json(F.lit(json.dumps([*cuts, *[None] * ((1 << bits) - len(cuts))])), "array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bits))])
    at = F.aggregate(
        steps, F.lit(0), lambda low, step: F.when(F.element_at(table, low + step + 1) <= F.col(key), low + step).otherwise(low)
    )
    dealt = rows.withColumn("_at", at).withColumn("_first", F.element_at(table, F.col("_at") + 1) == F.col(key))
    before = F.when(F.col("_at") > 0, F.col("_at") - 1).otherwise(len(cuts) - 1)
    own = F.struct(F.col("_at").alias("group"), F.lit(0).alias("copy"))
    places = F.when(F.col("_first"), F.array(own, F.struct(before.alias("group"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    dealt = dealt.withColumn("_place", F.explode(places)).withColumns(
        {"_group": F.col("_place.group"), "_copy": F.col("_place.copy")}
    )
    return dealt.drop("_at", "_first", "_place"), Window.partitionBy("_group").orderBy("_copy", key, "text")


def against_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the last quarter of the code points, rounded down, replaced by the first as many
    (or all) of the next document's, by ascending doc_id; the first follows the last. Null texts are
    empty; a null doc_id comes before all others; rows with equal ids follow by text. A single
    document is its own next. Extra columns are ignored.
    """
    least = F.lit(-(1 << 63)).cast("long")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), least).alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    dealt, following = _grouped(rows, "_key")
    quarter = F.floor(F.length("text") / 4).cast("int")
    found = (
        dealt.withColumn("_next", F.lead("text").over(following))
        .withColumn("_sums", vector(F.col("text")))
        .withColumn("_next_sums", F.lead("_sums").over(following))
        .filter("_copy = 0")
        .withColumn("_edited", F.concat(F.left("text", F.length("text") - quarter), F.left("_next", quarter)))
        .withColumn("_edited_sums", vector(F.col("_edited")))
    )
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        as_text(F.col("_sums")).alias("fingerprint"), as_text(F.col("_edited_sums")).alias("edited_fingerprint"),
        likeness(F.col("_sums"), F.col("_edited_sums")).alias("near_edited"),
        likeness(F.col("_sums"), F.col("_next_sums")).alias("near_next"),
    )
