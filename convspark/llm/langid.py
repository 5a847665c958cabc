"""Language identification by interpolated Kneser-Ney character models.

Every language has a model of the n-grams of letters up to ``order``. The highest order counts occurrences, lower
orders count distinct left neighbours, and each order is interpolated with the next lower one by an absolute
discount. The n-grams of all languages lie in one sorted array of hashes for each order, with one column of
log-probabilities a language, so a text is looked up once for all languages. The language with the lowest
cross-entropy a character wins; how far that value may lie above what is usual for the language is calibrated on
labelled texts that the model has not seen."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.llm.common import crc_remainder
from convspark.operators.lookup import lookup_join
from convspark.session import stage

UNKNOWN = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)
LN2 = math.log(2)


@dataclass(frozen=True)
class Rules:
    """``texts_per_language``: bound of the training sample, drawn by a hash of the ids; every tenth of them is kept for
    calibration. ``tolerance``: standard deviations above the usual cross-entropy at which a text is rejected.
    ``sharpness``: characters whose likelihood ratio makes the score."""

    order: int = 4
    texts_per_language: int = 2000
    discount: float = 0.75
    tolerance: float = 6.0
    sharpness: int = 25


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters_of(text: str | None) -> np.ndarray:
    """Code points of the lower-case letters; whatever lies between words is one space, one is put before and after.
    Empty if there is no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64)
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = codes[keep]
    return np.concatenate([[32], codes, [32]] if codes[-1] != 32 else [[32], codes]).astype(np.uint64)


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each place, for n from 1 to ``order``; the first place only begins contexts.
    Where a text has less than n characters before, the hash covers what there is."""
    at = [codes]
    for n in range(1, order):
        longer = at[-1].copy()
        longer[n:] = _extend(at[0][:-n] if n < len(codes) else at[0][:0], at[-1][n:], n)
        at.append(longer)
    return [h[1:] for h in at]


def _extend(first: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    mixed = (first + np.uint64(n) + np.uint64(0x51ED270B)) * MIX
    return rest * np.uint64(0xD6E8FEB86659FD93) ^ (mixed ^ (mixed >> np.uint64(32)))


def _gram_columns(codes: np.ndarray, n: int) -> np.ndarray:
    """The n-grams themselves as rows of n code points, zeros where a text begins."""
    padded = np.concatenate([np.zeros(n - 1, np.uint64), codes])
    return np.stack([padded[k : k + len(codes)] for k in range(n)], axis=1)[1:]


@dataclass
class Model:
    """``grams[n]``: sorted hashes of order n + 1, ``logs[n]``: log2 probability in each language (a column each).
    ``contexts[n]``: sorted hashes of order n + 1 that were met as a context, ``backoff[n]``: log2 of the weight of the
    next lower order there."""

    languages: list[str]
    order: int
    sharpness: int
    grams: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: float = -20.0
    usual: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def log_probabilities(self, order: int, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """log2 P of the last character given the ones before, for each place (a row) and language (a column)."""
        if order < 0:
            return np.full((len(grams[0]), len(self.languages)), self.floor)
        out = np.empty((len(grams[0]), len(self.languages)))
        known = self.grams[order]
        at = np.minimum(np.searchsorted(known, grams[order]), max(len(known) - 1, 0))
        hit = known[at] == grams[order] if len(known) else np.zeros(len(out), bool)
        out[hit] = self.logs[order][at[hit]]
        if not hit.all():
            miss = ~hit
            lower = self.log_probabilities(order - 1, [g[miss] for g in grams], [c[miss] for c in contexts])
            if order > 0 and len(self.contexts[order - 1]):
                held = self.contexts[order - 1]
                wanted = contexts[order - 1][miss]
                at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                met = held[at] == wanted
                lower[met] += self.backoff[order - 1][at[met]]
            out[miss] = lower
        return out

    def cross_entropies(self, text: str | None) -> np.ndarray | None:
        """Bits a character in each language; None for a text without a letter."""
        codes = letters_of(text)
        if not len(codes):
            return None
        grams = gram_hashes(codes, self.order)
        _, first, count = np.unique(grams[-1], return_index=True, return_counts=True)
        contexts = [np.concatenate([codes[:1], g[:-1]]) for g in grams[:-1]]
        logs = self.log_probabilities(self.order - 1, [g[first] for g in grams], [c[first] for c in contexts])
        return -(count @ logs) / count.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool, float | None]:
        """Language, score, whether its cross-entropy is usual for the language, cross-entropy."""
        bits = self.cross_entropies(text) if self.languages else None
        if bits is None:
            return UNKNOWN, 0.0, False, None
        best = int(bits.argmin())
        score = 1.0 / np.exp2(np.maximum(-60.0, -(bits - bits[best]) * self.sharpness)).sum()
        accepted = bool(bits[best] <= self.usual[best])
        return self.languages[best], float(score if accepted else score / 2), accepted, float(bits[best])


def _counts(texts: DataFrame, order: int) -> DataFrame:
    """(``lang``, ``gram``: array of code points, ``times``) of the highest order over ``texts`` (``text``, ``lang``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                codes = [c for t in own["text"] if len(c := letters_of(t))]
                if codes:
                    keys = np.concatenate([gram_hashes(c, order)[-1] for c in codes])
                    _, first, times = np.unique(keys, return_index=True, return_counts=True)
                    grams = np.concatenate([_gram_columns(c, order) for c in codes])[first]
                    yield pd.DataFrame({"lang": lang, "gram": list(grams.astype(np.int64)), "times": times})

    counted = texts.mapInPandas(run, "lang string, gram array<long>, times long")
    return counted.groupBy("lang", "gram").agg(F.sum("times").alias("times"))


def _key(columns: np.ndarray) -> np.ndarray:
    """Hashes of n-grams given as rows of code points, equal to those of ``gram_hashes``."""
    n = columns.shape[1]
    key = columns[:, n - 1].astype(np.uint64)
    for k in range(1, n):
        first = columns[:, n - 1 - k].astype(np.uint64)
        key = np.where(first == 0, key, _extend(first, key, k))
    return key


def build_model(counts: pd.DataFrame, rules: Rules) -> Model:
    """The model from the counts of the highest order (bounded by the training sample)."""
    languages = sorted(counts["lang"].unique())
    model = Model(languages, rules.order, rules.sharpness)
    if not languages:
        return model
    tables: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in languages:
        own = counts[counts["lang"] == lang]
        grams, times = np.array(own["gram"].tolist(), np.int64), own["times"].to_numpy(np.float64)
        by_order = [(grams, times)]
        for _ in range(rules.order - 1):
            higher = by_order[0][0]
            lower, seen = np.unique(higher[:, 1:], axis=0, return_counts=True)
            by_order.insert(0, (lower, seen.astype(np.float64)))
        tables.append(by_order)
    alphabet = len({int(c) for t in tables for c in t[0][0][:, 0]}) + 1
    model.floor = -math.log2(alphabet)
    for n in range(rules.order):
        keys = [_key(t[n][0]) for t in tables]
        model.grams.append(np.unique(np.concatenate(keys)))
        owners = [_key(t[n][0][:, :-1]) if n else np.zeros(len(t[n][0]), np.uint64) for t in tables]
        held = np.unique(np.concatenate(owners))
        weight = np.zeros((len(held), len(languages)))
        logs = np.empty((len(model.grams[n]), len(languages)))
        spelled = {}
        for t in tables:
            for key, gram in zip(_key(t[n][0]).tolist(), t[n][0]):
                spelled.setdefault(key, gram)
        columns = np.array([spelled[k] for k in model.grams[n].tolist()], np.int64)
        owner_of = _key(columns[:, :-1]) if n else np.zeros(len(columns), np.uint64)
        if n:
            chain_g = [_key(columns[:, n - k :]) for k in range(n)]
            chain_c = [_key(columns[:, n - 1 - k : n]) for k in range(n - 1)]
            lower = model.log_probabilities(n - 1, chain_g, chain_c)
        else:
            lower = np.full(logs.shape, model.floor)
        for at, (_, times) in enumerate(t[n] for t in tables):
            place = np.searchsorted(held, owners[at])
            total = np.bincount(place, times, len(held))
            types = np.bincount(place, minlength=len(held))
            with np.errstate(divide="ignore", invalid="ignore"):
                weight[:, at] = np.where(total > 0, rules.discount * types / np.maximum(total, 1), 1.0)
            mass = np.zeros(len(model.grams[n]))
            own = np.searchsorted(model.grams[n], keys[at])
            mass[own] = np.maximum(times - rules.discount, 0) / total[place]
            logs[:, at] = np.log2(mass + weight[np.searchsorted(held, owner_of), at] * np.exp2(lower[:, at]))
        if n:
            model.contexts.append(held)
            model.backoff.append(np.log2(weight))
        else:
            model.floor += float(np.log2(weight).max())
        model.logs.append(logs)
    return model


def train(labelled: DataFrame, rules: Rules | None = None) -> Model:
    """A model from rows (``doc_id``, ``text``, ``lang``), null texts and null languages left out. A language with more
    than ``texts_per_language`` texts gives about that many, those with the smallest hashes of their ids."""
    rules = rules or Rules()
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("texts"))
    share = F.lit(float(rules.texts_per_language)) / F.col("texts")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    sample = stage(lookup_join(rows, sizes, "lang", ["doc_id"]).where(draw < share).select("doc_id", "text", "lang"), "language-sample")
    held_back = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(10)) == 0
    model = build_model(_counts(sample.where(~held_back), rules.order).toPandas(), rules)
    if model.languages:
        bits = _bits_of_own_language(sample.where(held_back), model)
        usual = {r["lang"]: r["mean"] + rules.tolerance * max(r["spread"] or 0.0, 0.1) for r in bits.collect()}
        model.usual = np.array([usual.get(lang, np.inf) for lang in model.languages])
    return model


def _bits_of_own_language(texts: DataFrame, model: Model) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        place = {lang: n for n, lang in enumerate(m.languages)}
        for batch in batches:
            rows = [(lang, b[place[lang]]) for lang, t in zip(batch["lang"], batch["text"]) if lang in place and (b := m.cross_entropies(t)) is not None]
            yield pd.DataFrame(rows, columns=["lang", "bits"])

    found = texts.mapInPandas(run, "lang string, bits double")
    return found.groupBy("lang").agg(F.avg("bits").alias("mean"), F.stddev("bits").alias("spread"))


def predict(text: Column, model: Model, spark) -> Column:
    """struct(lang_pred, score, accepted, bits_per_char) of a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean, bits_per_char double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            yield pd.DataFrame([m.predict(t) for t in batch], columns=["lang_pred", "score", "accepted", "bits_per_char"])

    return run(text)


def identify(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``accepted`` and ``bits_per_char`` of every row. The model
    learns from rows with a text and a language whose crc32(doc_id) mod 4 is not 2; the others are held out.

    A null text or one without a letter gives ``und``, as does every text if there is nothing to learn from. A null
    doc_id counts as not held out; repeated rows stay; ties go to the first language; other columns are ignored."""
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs.where(~held_out), rules)
    found = docs.select("doc_id", held_out.alias("held_out"), predict(F.col("text"), model, docs.sparkSession).alias("p"))
    return found.select("doc_id", "held_out", "p.*")
