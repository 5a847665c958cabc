"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns find the plain identifiers; they are the seeds. The words around seeds and around other tokens that
look like identifiers are lexical patterns. Patterns and instances form a graph: a pattern is as good as the share
of its distinct instances that are believed, an instance as the patterns that hold it, and both are scored in turns.
Patterns of high confidence then find identifiers that the base patterns miss; each gets the kind of its pattern.

Texts are read once; what is staged of them are spans and their context. No step gathers a pattern or an instance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.llm.common import bind
from convspark.session import stage

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns. Possessive repeats and the look-behinds keep the search linear in very long runs; they change no
#: match: a search that fails at the beginning of a run fails inside it, and nothing follows the repeats.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Tokens that look like identifiers: groups of digits, or a token with a digit or an at sign.
TOKEN = "[A-Za-z0-9@._%+-]"
CANDIDATE = rf"(?<!{TOKEN})(?:\+?[0-9]++(?:[\x20()-]{{1,2}}[0-9]++)++|(?=[A-Za-z._%+-]*+[0-9@]){TOKEN}++)"
#: Code points of the shortest token that is looked at as an identifier.
SHORTEST = 5
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
MATCHES = "array<struct<kind:int,at:int,gap:int,text:string,before:string,after:string>>"


@dataclass(frozen=True)
class Rules:
    """``min_seeds``: distinct believed instances that a pattern needs; ``confidence``: of a pattern, to find new ones;
    ``rounds``: of scoring; ``reach``: characters of context on either side."""

    min_seeds: int = 3
    confidence: float = 0.8
    rounds: int = 3
    reach: int = 60


def matches(text: Column, kind: int, pattern: str, needed: str, reach: int) -> Column:
    """The matches of a pattern, leftmost first, as an array of (``kind``, ``at``: number in the text, ``gap``: code points
    since the match before, ``text``, ``before`` and ``after``: context up to ``reach`` code points)."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))

    def described(z: Column) -> Column:
        return F.transform(
            z["found"],
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("at"),
                F.char_length(z["between"][i]).alias("gap"),
                m.alias("text"),
                F.right(z["between"][i], F.lit(reach)).alias("before"),
                F.left(z["between"][i + 1], F.lit(reach)).alias("after"),
            ),
        )

    return F.when(text.rlike(needed), bind(parts, described)).otherwise(F.array().cast(MATCHES))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def passes_luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    size = F.char_length(_digits(value))
    if kind == "card":
        return F.when(size.between(12, 19), passes_luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def _patterns() -> Column:
    """Lexical patterns of a match: the two words before it, and the word on either side; numbers count alike. A match
    without a word before it has none."""
    plain = F.regexp_replace(F.lower("before"), "[0-9]+", "0")
    last = F.regexp_extract(plain, r"(\S+)\s*$", 1)
    last_two = F.regexp_replace(F.regexp_extract(plain, r"(\S+\s+\S+)\s*$", 1), r"\s+", " ")
    first = F.regexp_extract(F.regexp_replace(F.lower("after"), "[0-9]+", "0"), r"^\s*(\S+)", 1)
    return F.array_compact(F.array(F.when(last_two != "", F.concat(last_two, F.lit(" _"))), F.when(last != "", F.concat(last, F.lit(" _ "), first))))


def identifiers(docs: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Staged rows (``doc_id``, ``row``), and staged spans (``row``, ``start``, ``kind``, ``end``, ``instance``, ``patterns``): all
    base spans with their kind's number, and other tokens that look like identifiers with the kind -1.

    Texts are read here only. Positions are running sums over the matches of one text."""
    text = F.coalesce("text", F.lit(""))
    tried = [matches(text, n, PATTERNS[kind], NEEDED[kind], rules.reach) for n, kind in enumerate(KINDS)]
    tried.append(matches(text, -1, CANDIDATE, "[0-9@]", rules.reach))
    rows = stage(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.concat(*tried).alias("matches")), "identifiers")
    one = rows.select("row", F.explode("matches").alias("m")).select("row", "m.*").withColumn("size", F.char_length("text"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("at"))
    placed = one.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    good = F.when(F.col("kind") < 0, F.col("size") >= SHORTEST)
    for n, kind in enumerate(KINDS):
        good = good.when(F.col("kind") == n, valid(kind, F.col("text")))
    placed = placed.where(good)
    # a candidate must not overlap a base span: neither one that begins before it nor one that begins inside it
    onward = Window.partitionBy("row").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backward = Window.partitionBy("row").orderBy(F.desc("start"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_base = F.col("kind") >= 0
    reached = F.max(F.when(is_base, F.col("end"))).over(onward)
    ahead = F.min(F.when(is_base, F.col("start"))).over(backward)
    placed = placed.withColumns({"reached": reached, "ahead": ahead})
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))
    spans = placed.where(is_base | free).select("row", "start", "kind", "end", F.lower("text").alias("instance"), _patterns().alias("patterns"))
    return rows.select("doc_id", "row"), stage(spans, "spans")


def score_patterns(edges: DataFrame, rules: Rules) -> DataFrame:
    """(``pattern``, ``kind``, ``confidence``) of the patterns of high confidence.

    ``edges``: distinct (``pattern``, ``instance``, ``kind``), the kind -1 for instances that are no seeds. Each round gives
    an instance that is no seed the belief of its best patterns (noisy or) and a pattern the mean belief of its
    instances, for each kind."""
    seeds = edges.where("kind >= 0").select("pattern", "instance", "kind", F.lit(1.0).alias("belief"))
    free = edges.where("kind < 0").select("pattern", "instance")
    sizes = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("instances"))
    believed = seeds
    for n in range(rules.rounds):
        scored = (
            believed.groupBy("pattern", "kind")
            .agg(F.sum("belief").alias("belief"), F.sum((F.col("belief") == 1.0).cast("int")).alias("seeds"))
            .where(F.col("seeds") >= rules.min_seeds)
            .join(sizes, "pattern")
            .withColumn("confidence", F.col("belief") / F.col("instances"))
        )
        scored = stage(scored.select("pattern", "kind", "confidence"), "patterns")
        if n + 1 < rules.rounds:
            doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
            beliefs = free.join(scored.where(F.col("confidence") >= rules.confidence / 2), "pattern").groupBy("instance", "kind").agg((1 - doubt).alias("belief"))
            # one kind for each instance: the most believed, then the first
            best = beliefs.groupBy("instance").agg(F.max(F.struct("belief", (-F.col("kind")).alias("order"))).alias("b"))
            best = best.select("instance", (-F.col("b.order")).alias("kind"), F.least(F.col("b.belief"), F.lit(0.99)).alias("belief"))
            believed = seeds.unionByName(free.join(best, "instance").select("pattern", "instance", "kind", "belief"))
    return scored.where(F.col("confidence") >= rules.confidence)


def learned_spans(spans: DataFrame, rules: Rules) -> DataFrame:
    """(``row``, ``start``, ``kind``, ``end``): the spans that patterns of high confidence add."""
    one = spans.withColumn("pattern", F.explode("patterns"))
    edges = stage(one.select("pattern", "instance", "kind").distinct(), "pattern-edges")
    good = score_patterns(edges, rules)
    hits = one.where("kind < 0").select("row", "start", "end", "pattern").join(good, "pattern")
    best = hits.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("order"))).alias("b"))
    return best.select("row", "start", (-F.col("b.order")).alias("kind"), "end")


def find_personal_data(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``doc_id``, ``base`` and ``learned`` of every row: arrays of (``start``, ``kind``, ``end``) in code points, end exclusive,
    by start, then kind in the order of ``KINDS``.

    Null texts are empty; rows with a null doc_id and repeated rows stay, each with its own spans; other columns are
    ignored; an empty table gives an empty table."""
    rules = rules or Rules()
    rows, spans = identifiers(docs, rules)
    found = spans.where("kind >= 0").select("row", "start", "kind", "end", F.lit(True).alias("is_base"))
    found = found.unionByName(learned_spans(spans, rules).withColumn("is_base", F.lit(False)))
    # the spans of one text
    both = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "is_base"))).alias("found"))

    def those(base: bool) -> Column:
        kept = F.filter(F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,is_base:boolean>>")), lambda s: s["is_base"] == base)
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return rows.join(both, "row", "left").select("doc_id", those(True).alias("base"), those(False).alias("learned"))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``doc_id`` and ``text`` with every span replaced by its kind in angle brackets; of overlapping spans the first
    counts, then the longer one. Null texts become empty."""
    rules = rules or Rules()
    text = F.coalesce("text", F.lit(""))
    keyed = stage(docs.select("doc_id", text.alias("text")), "texts")
    found = find_personal_data(keyed.withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("hash"))), rules)
    spans = found.select("doc_id", F.concat("base", "learned").alias("spans")).dropDuplicates(["doc_id"])
    joined = keyed.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("hash"))).join(spans.withColumnRenamed("doc_id", "key"), "key")
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))

    def cut(z: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            piece = F.concat(F.substring(z["text"], (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), names[s["kind"]], F.lit(">"))
            return F.when(s["start"] < acc["at"], acc).otherwise(F.struct((-s["end"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out")))

        return F.aggregate(z["spans"], zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(z["text"], (acc["at"] + 1).cast("int"), F.char_length(z["text"]))))

    return joined.select(F.col("doc_id"), bind(F.struct("text", ordered.alias("spans")), cut).alias("text"))
