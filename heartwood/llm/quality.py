"""Quality rules by weak supervision, in DataFrame operations only.

Each rule looks at one figure of a text and votes good, bad, or abstains. Expectation-maximisation over the counts of
the vote patterns (there are at most 3 to the number of rules, whatever the number of documents) estimates how often
each rule is right about good and about bad documents; a document is kept if its posterior probability of being good
reaches one half. The whole estimation is one SQL expression over an array of patterns.

Null texts count as empty: no words, base_failed. The figures of a text come from its own row alone (higher-order
functions over its words and lines), so that no text is shuffled. Repeated rows and ties get equal results; an empty
table gives no rows. `kept_documents` passes other columns through, `quality` leaves them out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, stored, text_or_empty

SYMBOLS = "#*$%&|<>"  # fixed value
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50  # fixed values
ROUNDS = 25

#: rule: (figure, bad below, bad above, good from, good up to); elsewhere it abstains. None: no such side.
RULES: dict[str, tuple[str, float | None, float | None, float | None, float | None]] = {
    "length": ("n_words", 50, None, 60, None),
    "repeats": ("repeat_share", None, 0.30, None, 0.10),
    "symbols": ("symbol_share", None, 0.08, None, None),
    "marked_words": ("symbols_per_word", None, 0.50, None, 0.05),
    "lines": ("dup_line_share", None, 0.50, None, None),
    "shouting": ("shout_share", None, 0.60, None, 0.30),
    "variety": ("distinct_share", 0.30, None, None, None),
    "letters": ("word_length", 2.5, 20.0, None, None),
}

#: Figures that base_failed looks at.
BASE = ["n_words", "n_repeat_words"]
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_distinct"]


def with_figures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts of FEATURES of each text, as long columns. They come as one generated row for each row: the
    optimizer doesn't move filters on them below that, where each would be worked out again word by word."""
    words, lines, pairs = "_words", "_lines", "_windows"
    size = lambda c: F.size(c).cast("long")
    t = text_or_empty(text)
    df = df.withColumn(words, F.filter(F.split(t, BLANKS), lambda w: w != ""))
    df = df.withColumn(lines, F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != ""))
    # 3-word windows as (window, place), sorted; those with an equal neighbour are repeated.
    window = lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    df = df.withColumn(pairs, F.sort_array(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), window)))
    df = df.withColumn(pairs, F.filter(pairs, lambda x, k: (x["h"] == F.get(pairs, k - 1)["h"]) | (x["h"] == F.get(pairs, k + 1)["h"])))
    places = F.sort_array(F.transform(pairs, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    bare = F.translate(t, " \t\n\x0b\x0c\r", "")
    figures = F.struct(
        size(words).alias("n_words"), F.length(bare).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (size(lines) - size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.when(F.size(pairs) > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        size(lines).alias("n_lines"),
        (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length(t) - F.length(F.translate(t, "abcdefghijklmnopqrstuvwxyz", ""))).cast("long").alias("n_lower"),
        size(F.array_distinct(words)).alias("n_distinct"),
    )
    return df.select(*[c for c in df.columns if c not in (words, lines, pairs)], F.inline(F.array(figures)))


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    figures = {
        "n_words": F.col("n_words").cast("double"), "repeat_share": share("n_repeat_words", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
        "symbols_per_word": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "shout_share": F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)),
        "distinct_share": F.col("n_distinct") / F.pow(F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.lit(0.85)), "word_length": share("word_chars", "n_words"),
    }
    out = {}
    for name, (figure, bad_below, bad_above, good_from, good_to) in RULES.items():
        x = figures[figure]
        bad = [x < bad_below] if bad_below is not None else []
        bad += [x > bad_above] if bad_above is not None else []
        good = [x >= good_from] if good_from is not None else []
        good += [x <= good_to] if good_to is not None else []
        vote = F.when(reduce(lambda a, b: a | b, bad), -1)
        out[name] = (vote.when(reduce(lambda a, b: a & b, good), 1) if good else vote).otherwise(0).cast("int")
    return out


def with_votes(df: DataFrame) -> DataFrame:
    return df.withColumn("_votes", F.array(*votes().values()))


#: Rates of good and of bad votes that estimation starts from, on good documents and on bad ones; share of good documents.
START = {"good_yes": 0.60, "good_no": 0.02, "bad_yes": 0.30, "bad_no": 0.30, "prior": 0.75}
SMOOTH = 10.0


def log_odds(votes: Column, model: Column) -> Column:
    """Log odds that a document with these votes is good. An abstention is an outcome like the two votes."""

    def chance(yes: str, no: str) -> Column:
        return F.aggregate(
            F.zip_with(votes, F.arrays_zip(model[yes].alias("yes"), model[no].alias("no")), lambda v, p: F.log(F.when(v == 1, p["yes"]).when(v == -1, p["no"]).otherwise(1 - p["yes"] - p["no"]))),
            F.lit(0.0), lambda a, x: a + x,
        )

    odds = F.log(model["prior"]) - F.log(1 - model["prior"]) + chance("good_yes", "good_no") - chance("bad_yes", "bad_no")
    return F.greatest(F.least(odds, F.lit(50.0)), F.lit(-50.0))


def estimates(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row `_model`: the share of good documents and each rule's rates of good and of bad votes on good documents
    and on bad ones, by expectation-maximisation over the patterns (_votes, n). SMOOTH documents of the starting rates
    are added to each estimate; they keep rates off 0 and 1 and fix which of the two classes is the good one."""
    m = len(RULES)
    kinds = [k for k in START if k != "prior"]
    model = "struct<prior:double," + ",".join(f"{k}:array<double>" for k in kinds) + ">"

    def step(at: Column, _: Column) -> Column:
        weighed = F.transform("_patterns", lambda p: F.struct(p["v"].alias("v"), (p["n"] / (1 + F.exp(-log_odds(p["v"], at)))).alias("g"), p["n"].cast("double").alias("n")))
        zero = F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("n"), *[F.array_repeat(F.lit(0.0), m).alias(k) for k in kinds])

        def add(a: Column, p: Column) -> Column:
            def part(kind: str) -> Column:
                weight, vote = p["g"] if kind.startswith("good") else p["n"] - p["g"], 1 if kind.endswith("yes") else -1
                return F.zip_with(a[kind], p["v"], lambda s, v: s + F.when(v == vote, weight).otherwise(0.0)).alias(kind)

            return F.struct((a["g"] + p["g"]).alias("g"), (a["n"] + p["n"]).alias("n"), *map(part, kinds))

        def new(a: Column) -> Column:
            def rate(kind: str) -> Column:
                of = a["g"] if kind.startswith("good") else a["n"] - a["g"]
                return F.transform(a[kind], lambda h: (h + SMOOTH * START[kind]) / (of + SMOOTH)).alias(kind)

            return F.struct(((a["g"] + START["prior"] * SMOOTH) / (a["n"] + SMOOTH)).alias("prior"), *map(rate, kinds)).cast(model)

        return F.aggregate(weighed, zero, add, new)

    start = F.struct(F.lit(START["prior"]).alias("prior"), *[F.array_repeat(F.lit(START[k]), m).alias(k) for k in kinds]).cast(model)
    rows = patterns.agg(F.array_sort(F.collect_list(F.struct(F.col("_votes").alias("v"), F.col("n")))).alias("_patterns"))
    return rows.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("_model"))


def judged(df: DataFrame, model: DataFrame) -> DataFrame:
    """df (with figures and _votes) with base_failed, p_good and kept. The one row of the model is broadcast."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    out = df.crossJoin(F.broadcast(model)).withColumns({"base_failed": base, "p_good": 1 / (1 + F.exp(-log_odds(F.col("_votes"), F.col("_model"))))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)).drop("_model", "_votes")


def quality(docs: DataFrame) -> DataFrame:
    """The figures, base_failed, p_good and kept of every document. The figures are worked out once and kept in the
    shared folder (a few numbers a document), for they are needed for the estimates and again for the verdicts."""
    figures = cut(with_votes(with_figures(docs.select("doc_id", "text")).drop("text")))
    model = cut(estimates(figures.groupBy("_votes").agg(F.count("*").alias("n"))))
    return judged(figures, model)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns, whatever their names. Figures are worked out once: the votes are
    written beside the documents, so that texts aren't shuffled to meet them again."""
    rows = docs.select(F.struct(*docs.columns).alias("_document"), "text")
    votes = stored(with_votes(with_figures(rows).drop("text")).select("_document", *BASE, "_votes"), "votes")
    model = cut(estimates(votes.groupBy("_votes").agg(F.count("*").alias("n"))))
    return judged(votes, model).where("kept").select("_document.*")
