"""Personal data: exact patterns, and further spans by candidate gradient boosting.

Base spans are the matches of four patterns that pass their checks. High-recall generators
propose more, looser spans that may overlap them and each other. Boosted trees rate a candidate by
its format and context, and never see what the base checks test (check digits, a leading plus): trained on
which candidates touch base spans, over all documents, they tell candidates that look and stand like
personal data from those that don't. For each kind the threshold is the least at which, on a fifth
of the documents that isn't trained on, enough of the selected candidates touch base spans.

Everything is column expressions; the driver sees counts by feature combination.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.llm import boosting
from roster.llm.common import id_text, let, without

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.8
FOLDS = 5

# Fixed patterns. Possessive quantifiers and the look-behind change no match: they keep long runs
# linear and the matcher's stack flat.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
GENERATORS = {
    "email": [
        rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++",
    ],
    "ip": [r"(?<![0-9.,])[0-9]{1,3}(?:[.,][0-9]{1,3}){3}(?![0-9.,])"],
    "card": [
        r"(?<![0-9])[0-9]{13,19}(?![0-9])",
        r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![0-9])",
    ],
    "phone": [
        r"(?<![0-9])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
        r"(?<![0-9])(?:00|0)[0-9]{8,12}(?![0-9])",
    ],
}
_ANY = r"[0-9@]|[(\[]at[)\]]"
_HINTS = {
    1: r"(?i)(phone|tel|call|mobile|cell|fax)[^a-z]{0,4}$",
    2: r"(?i)(card|visa|credit|iban|account)[^a-z]{0,4}$",
    3: r"(?i)(mail|contact|write)[^a-z]{0,4}$",
    4: r"(?i)(ip|host|server|address|addr)[^a-z]{0,4}$",
    5: r"(?i)(token|key|secret|hash|id|password)[^a-z]{0,4}$",
}
FEATURES = ("digits", "groups", "separators", "before", "after", "hint")


# --- spans -----------------------------------------------------------------------------------------


def _running(values: Column) -> Column:
    """Running sums of an array, by doubling: each step adds the sums so many places before."""
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(30)]), lambda s: s < F.size(values))
    zero = F.lit(0).cast("long")
    return F.aggregate(
        steps, values,
        lambda sums, s: F.zip_with(
            sums, F.concat(F.array_repeat(zero, s), F.slice(sums, F.lit(1), F.size(sums) - s)), lambda a, b: a + b
        ),
    )


def _matches(text: Column, pattern: str) -> Column:
    """(start, end, match, before, after) of all matches; offsets in code points."""

    def place(found: Column, gaps: Column) -> Column:
        count = F.size(found)
        before = F.slice(gaps, F.lit(1), count)
        lengths = F.zip_with(before, found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        rows = F.arrays_zip(
            let(lengths, _running).alias("end"), found.alias("match"), before.alias("before"),
            F.slice(gaps, F.lit(2), count).alias("after"),
        )
        return F.transform(rows, lambda r: F.struct(
            (r["end"] - F.length(r["match"])).alias("start"), r["end"].alias("end"), r["match"].alias("match"),
            F.right(r["before"], F.lit(24)).alias("before"), F.left(r["after"], F.lit(1)).alias("after"),
        ))

    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>")
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: place(found, gaps))).otherwise(none),
    )


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 1, F.try_mod(2 * c.try_cast("int"), F.lit(9)) + F.when(c == "9", 9).otherwise(0)
    ).otherwise(c.try_cast("int")))
    return F.aggregate(values, F.lit(0), lambda total, v: total + F.coalesce(v, F.lit(0))) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        count = F.length(_digits(match))
        return F.when(count.between(16, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _span(kind: str, row: Column) -> Column:
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), row["start"].alias("start"), row["end"].alias("end"))


def _base(text: Column, kind: str) -> Column:
    """Base spans of a kind, by start."""
    return F.transform(
        F.filter(_matches(text, BASE[kind]), lambda r: _passes(kind, r["match"])), lambda r: _span(kind, r)
    )


# --- candidates ------------------------------------------------------------------------------------


def _edge(character: Column) -> Column:
    """Kind of a neighbouring character: none or blank, letter, digit, quote, other."""
    return (
        F.when(character.rlike(r"^\s?$"), 0).when(character.rlike("[A-Za-z]"), 1).when(character.rlike("[0-9]"), 2)
        .when(character.rlike("[\"'`=:/]"), 3).otherwise(4)
    )


def _features(row: Column) -> list[Column]:
    match = row["match"]
    count = F.length(_digits(match))
    groups = F.regexp_count(match, F.lit("[0-9]+"))
    separators = (
        F.when(match.rlike("^[0-9]+$"), 0).when(match.rlike(r"[@(\[](at)?"), F.when(match.rlike("[@]"), 1).when(match.rlike("at"), 2).otherwise(3))
        .when(match.rlike(r"^[0-9.]+$"), 4).when(match.rlike(r"^[0-9-]+$"), 5).when(match.rlike(r"^[0-9\x20]+$"), 6).otherwise(7)
    )
    hint = reduce(lambda rest, item: F.when(row["before"].rlike(item[1]), item[0]).otherwise(rest), _HINTS.items(), F.lit(0))
    return [F.least(count, F.lit(20)), F.least(groups, F.lit(6)), separators, _edge(F.right(row["before"], F.lit(1))), _edge(row["after"]), hint]


def _proposed(text: Column, kind: str, pattern: str, base: Column) -> Column:
    """(kind, start, end, touches, and the features) of what a generator proposes."""

    def make(row: Column) -> Column:
        touches = F.exists(base, lambda b: (b["start"] < row["end"]) & (row["start"] < b["end"]))
        features = [f.cast("int").alias(n) for f, n in zip(_features(row), FEATURES)]
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), row["start"].alias("start"), row["end"].alias("end"),
            touches.alias("touches"), *features,
        )

    return F.transform(_matches(text, pattern), make)


def _detected(docs: DataFrame) -> DataFrame:
    """Documents with ``_base0``..``_base3`` and ``_candidates``; texts without a digit or an at have none."""
    text = F.coalesce("text", F.lit(""))
    some = text.rlike(_ANY)
    span, features = "kind:int,start:bigint,end:bigint", ",".join(f"{n}:int" for n in FEATURES)
    none = F.array().cast(f"array<struct<{span}>>")
    based = docs.withColumns({
        f"_base{i}": F.when(some, _base(text, kind)).otherwise(none) for i, kind in enumerate(KINDS)
    })
    empty = F.array().cast(f"array<struct<{span},touches:boolean,{features}>>")
    proposed = F.concat(*[
        _proposed(text, kind, pattern, F.col(f"_base{i}")) for i, kind in enumerate(KINDS) for pattern in GENERATORS[kind]
    ])
    return based.withColumn("_candidates", F.when(some, proposed).otherwise(empty))


Model = dict[int, tuple[boosting.Trees, float]]


def train(docs: DataFrame) -> Model:
    """Trees and threshold (of the margin) for each kind, from the candidates of all documents.

    A kind without candidates that touch base spans selects nothing.
    """
    held = F.pmod(F.xxhash64(id_text()), F.lit(FOLDS)) == 0
    rows = (
        _detected(docs.select("doc_id", "text")).select(held.alias("held"), F.explode("_candidates").alias("c"))
        .groupBy("held", "c.kind", *[F.col(f"c.{n}").alias(n) for n in FEATURES])
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("c.touches").alias("positives")).collect()
    )
    model: Model = {}
    for kind in range(len(KINDS)):
        own = sorted((r["held"], tuple(r[n] for n in FEATURES), r["n"], r["positives"]) for r in rows if r["kind"] == kind)
        learned = [r[1:] for r in own if not r[0]]
        trees = boosting.fit(learned)
        threshold, taken, right = math.inf, 0, 0
        rated = sorted(((round(trees.margin(f), 6), n, p) for held_, f, n, p in own if held_), reverse=True)
        for place, (margin, n, p) in enumerate(rated):
            taken, right = taken + n, right + p
            last = place + 1 == len(rated) or rated[place + 1][0] < margin
            if last and right and right >= PRECISION * taken:
                threshold = margin
        model[kind] = (trees, threshold)
    return model


def _added(model: Model) -> Column:
    """Selected candidates that touch no base span of any kind nor an earlier selected one."""

    def selected(c: Column) -> Column:
        tests = [
            (c["kind"] == kind) & (F.round(trees.column(lambda i: c[FEATURES[i]]), 5) >= round(threshold, 5) - 1e-9)
            for kind, (trees, threshold) in model.items() if threshold < math.inf
        ]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    base = F.concat(*[F.col(f"_base{i}") for i in range(len(KINDS))])
    free = F.filter(
        "_candidates",
        lambda c: ~c["touches"] & selected(c) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    # the longest of those that start first stay
    ordered = F.array_sort(F.transform(free, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("least"), c["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>").alias("out"))
    return F.aggregate(
        ordered, start,
        lambda total, c: F.when(c["start"] < total["last"], total).otherwise(F.struct(
            (-c["least"]).alias("last"),
            F.concat(total["out"], F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), (-c["least"]).alias("end")))).alias("out"),
        )),
        lambda total: total["out"],
    )


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


RESULTS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found")


def find(docs: DataFrame, model: Model) -> DataFrame:
    """Add the numbers of base spans, ``base_sha256``, ``spans`` as text and ``found`` as structs.

    Spans are kind:start:end in code points, the end exclusive, by kind and start. Null and empty texts have
    none. Input columns with the names of results are replaced; internal ones start with an underscore.
    """
    base = without(docs, *RESULTS)
    all_base = F.concat(*[F.col(f"_base{i}") for i in range(len(KINDS))])
    rated = _detected(base).withColumn("found", F.array_sort(F.concat(all_base, _added(model))))
    return rated.select(
        *base.columns,
        *[F.size(f"_base{i}").cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(_text_of(all_base), 256).alias("base_sha256"), _text_of(F.col("found")).alias("spans"), "found",
    )


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind, as <EMAIL>; null texts stay null.

    Spans that overlap are replaced together, by the kind of the first.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    ordered = F.array_sort(F.transform("_found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def put(total: Column, s: Column) -> Column:
        between = F.substring(F.col("text"), (total["at"] + 1).cast("int"), (s["start"] - total["at"]).cast("int"))
        return F.struct(
            F.greatest(total["at"], s["end"]).alias("at"),
            F.when(s["start"] < total["at"], total["out"]).otherwise(F.concat(total["out"], between, F.element_at(names, s["kind"] + 1))).alias("out"),
        )

    clean = F.aggregate(ordered, start, put, lambda total: F.concat(
        total["out"], F.substring(F.col("text"), (total["at"] + 1).cast("int"), F.length("text"))
    ))
    found = find(docs.select(*[F.col(c) for c in docs.columns], F.struct(*docs.columns).alias("_row")), model)
    return (
        found.select("_row.*", F.col("found").alias("_found"))
        .withColumn("text", F.when(F.size("_found") > 0, clean).otherwise(F.col("text")))
        .select(*docs.columns)
    )
