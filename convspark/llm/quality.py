"""Quality rules by distribution divergence, in DataFrame operations only.

Two histograms of a document, of character classes and of common words, are compared with those of a language by the
Jensen-Shannon distance. The references come from the corpus: for each language the median share of each class over
its documents, and the share of its most frequent words. A document far from every reference is rejected. Documents
with few words are not judged by divergence, since their histograms say little; nor are documents in a language that
has too little text for a reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.llm.common import bind, words
from convspark.session import stage

#: Character classes in the order in which they are taken out of a text; what is left is the last one, ``other``.
CLASSES = (
    ("small", r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+"),
    ("space", r"[\x20\x09-\x0D]+"),
    ("sentence", r"[.,;:!?'\"()’“”«»-]+"),
    ("capital", r"[\p{Lu}\p{Lt}]+"),
    ("digit", r"\p{N}+"),
)
#: Fixed value of the base rules: all but the symbols that they count.
NO_SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rules:
    """``min_words``, ``repeat_percent``: base rules. ``judged_words``: least words for the divergence. ``class_distance``,
    ``word_distance``: largest Jensen-Shannon distances (square roots, base 2) that are kept. ``common_share``: least share of a
    language's words for a word to be in its histogram. ``language_share``: least share of all words for a language to
    have a reference. Their inverses bound the histograms and the number of references."""

    min_words: int = 50
    repeat_percent: int = 50
    judged_words: int = 100
    class_distance: float = 0.19
    word_distance: float = 0.4
    common_share: float = 0.003
    language_share: float = 0.01


def class_counts(text: Column) -> Column:
    """Code points of each class, in order, ``other`` last. Each class is taken out of what the ones before left."""

    def taken(rest: Column, at: int) -> Column:
        if at == len(CLASSES):
            return F.array(F.char_length(rest))
        less = F.regexp_replace(rest, CLASSES[at][1], "")
        return bind(less, lambda left: F.concat(F.array(F.char_length(rest) - F.char_length(left)), taken(left, at + 1)))

    return bind(F.coalesce(text, F.lit("")), lambda t: taken(t, 0))


def repeated_words(found: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text."""

    def marked(s: Column) -> Column:
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (s[j]["h"] == F.get(s, j - 1)["h"]) | (s[j]["h"] == F.get(s, j + 1)["h"]))
        places = F.transform(twice, lambda j: F.array(s[j]["i"], s[j]["i"] + 1, s[j]["i"] + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def counted(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(F.array_sort(pairs), marked))

    return F.when(F.size(found) < 3, F.lit(0)).otherwise(bind(windows(found), counted))


def base_counts(text: Column, found: Column) -> Column:
    """struct of the base counts (longs) from the text and its words."""
    plain = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda line: F.btrim(line, F.lit(" \t\x0b\x0c\r")) != "")
    dup_lines = bind(lines, lambda n: F.size(n) - F.size(F.array_distinct(n)))
    unlettered = F.regexp_replace(plain, NO_SYMBOLS, "")
    return F.struct(
        F.size(found).cast("long").alias("n_words"),
        F.char_length(F.array_join(found, "")).cast("long").alias("word_chars"),
        F.char_length(unlettered).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
        repeated_words(found).cast("long").alias("n_repeat_words"),
    )


def failed(counts: Column, rules: Rules) -> Column:
    return (counts["n_words"] < rules.min_words) | (100 * counts["n_repeat_words"] > rules.repeat_percent * counts["n_words"])


@dataclass(frozen=True)
class Reference:
    """For each language: shares of the classes, shares of the common words (``words`` of all languages in one list)."""

    languages: list[str]
    classes: list[list[float]]
    words: list[str]
    shares: list[list[float]]


def references(docs: DataFrame, rules: Rules) -> Reference:
    """References of the languages that have enough text. What comes to the driver is bounded by the shares: at most
    1 / ``language_share`` languages with 1 / ``common_share`` words each."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    each = rows.select("lang", F.explode(words(F.lower("text"))).alias("word"))
    counts = stage(each.groupBy("lang", "word").agg(F.count("*").alias("n")), "language-words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    whole = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    large = totals.where(F.col("total") >= rules.language_share * whole)
    common = counts.join(F.broadcast(large), "lang").where(F.col("n") >= rules.common_share * F.col("total")).orderBy("lang", "word").collect()
    languages = sorted({r["lang"] for r in common})
    vocabulary = sorted({r["word"] for r in common})
    held = {(r["lang"], r["word"]): r["n"] / r["total"] for r in common}
    share = bind(class_counts(F.col("text")), lambda c: F.transform(c, lambda n: n / F.aggregate(c, F.lit(0), lambda a, b: a + b)))
    medians = F.array(*(F.percentile_approx(F.col("s")[k], 0.5, 1000) for k in range(len(CLASSES) + 1)))
    judged = rows.where(F.col("lang").isin(languages) & (F.char_length("text") >= rules.judged_words)).select("lang", share.alias("s"))
    found = {r["lang"]: r["m"] for r in judged.groupBy("lang").agg(medians.alias("m")).collect()} if languages else {}
    languages = [lang for lang in languages if lang in found]
    classes = [[v / sum(found[lang]) for v in found[lang]] for lang in languages]
    return Reference(languages, classes, vocabulary, [[held.get((lang, w), 0.0) for w in vocabulary] for lang in languages])


def _term(p: Column, q: Column) -> Column:
    """What two shares of a bin add to the Jensen-Shannon divergence (base 2), without the part that p = 0 would add."""
    m = (p + q) / 2
    return F.when(p > 0, p / 2 * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q / 2 * F.log2(q / m)).otherwise(0.0)


def class_distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of class counts from the shares of a reference."""

    def distance(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0), lambda a, b: a + b)
        return F.sqrt(F.greatest(F.lit(0.0), sum((_term(c[k] / total, F.lit(q)) for k, q in enumerate(reference)), F.lit(0.0))))

    return bind(counts, distance)


def common_counts(found: Column, vocabulary: list[str]) -> Column:
    """array of (``at``: place in the vocabulary from 1, ``n``: times) of the common words among the words, lower-cased."""
    known = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    lowered = F.transform(F.filter(found, lambda w: F.char_length(w) <= max(map(len, vocabulary), default=0)), F.lower)
    common = F.array_sort(F.filter(lowered, lambda w: w.isin(vocabulary) if vocabulary else F.lit(False)))

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (w[i] != F.get(w, i - 1)))

        def sized(at: Column) -> Column:
            return F.transform(
                at, lambda i, k: F.struct(F.array_position(known, w[i]).cast("int").alias("at"), (F.coalesce(F.get(at, k + 1), F.size(w)) - i).alias("n"))
            )

        return bind(starts, sized)

    none = F.array().cast("array<struct<at:int,n:int>>")
    return bind(common, lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(none))


def word_distance(counts: Column, n_words: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance of the common-word histogram, all other words being one more bin. Common words that the
    document lacks add half their share each; they are what is left of the reference's whole."""
    q = F.array(*map(F.lit, shares)) if shares else F.array().cast("array<double>")
    rest = 1.0 - sum(shares)

    def step(acc: Column, c: Column) -> Column:
        own = q[c["at"] - 1]
        return F.struct((acc["d"] + _term(c["n"] / n_words, own)).alias("d"), (acc["q"] + own).alias("q"), (acc["n"] + c["n"]).alias("n"))

    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q"), F.lit(0).alias("n"))

    def finish(acc: Column) -> Column:
        others = _term((n_words - acc["n"]) / n_words, F.lit(rest))
        return F.sqrt(F.greatest(F.lit(0.0), acc["d"] + others + (sum(shares) - acc["q"]) / 2))

    return F.aggregate(counts, zero, step, finish)


def judged(docs: DataFrame, rules: Rules, column: str = "__quality") -> DataFrame:
    """``docs`` with a struct ``column``: the base counts, ``base_failed``, ``class_distance`` and ``word_distance`` (smallest
    over the references, null where they are not judged) and ``kept``."""
    ref = references(docs, rules)
    text = F.col("text")

    def verdict(z: Column) -> Column:
        base_failed = failed(z["base"], rules)
        has_reference = F.col("lang").isNull() | F.col("lang").isin(ref.languages) if ref.languages else F.lit(False)
        judge = ~base_failed & (z["base"]["n_words"] >= rules.judged_words) & has_reference
        by_class = [class_distance(z["classes"], c) for c in ref.classes]
        by_word = bind(common_counts(z["words"], ref.words), lambda c: _smallest([word_distance(c, z["base"]["n_words"], s) for s in ref.shares]))
        far = bind(
            F.struct(F.when(judge, _smallest(by_class)).alias("c"), F.when(judge, by_word).alias("w")),
            lambda d: F.struct(
                base_failed.alias("base_failed"),
                d["c"].alias("class_distance"),
                d["w"].alias("word_distance"),
                (~base_failed & (~judge | ((d["c"] <= rules.class_distance) & (d["w"] <= rules.word_distance)))).alias("kept"),
            ),
        )
        return bind(far, lambda f: F.struct(*(z["base"][n].alias(n) for n in BASE), *(f[n].alias(n) for n in ("base_failed", "class_distance", "word_distance", "kept"))))

    def measured(found: Column) -> Column:
        return bind(F.struct(base_counts(text, found).alias("base"), class_counts(text).alias("classes"), found.alias("words")), verdict)

    # the words are bound, not a column: a filter on the verdict may be moved before that column and split the text anew
    # for every place that names it
    return docs.withColumn(column, bind(words(text), measured))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _smallest(distances: list[Column]) -> Column:
    return F.lit(None).cast("double") if not distances else distances[0] if len(distances) == 1 else F.least(*distances)


def quality(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``class_distance``, ``word_distance`` and ``kept`` of every row.

    Null and blank texts have no word and fail the base rules. A null language is held against every reference, a
    language without a reference passes. Null ids and repeated rows stay; other columns are ignored; an empty table
    gives an empty table."""
    rows = judged(docs.select("doc_id", "text", "lang"), rules or Rules())
    return rows.select("doc_id", "__quality.*")


def keep_good(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they had."""
    return judged(docs, rules or Rules()).where("__quality.kept").select(*docs.columns)
