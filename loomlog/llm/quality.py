"""Quality rules as weak supervision, in DataFrame and SQL functions only.

Each rule votes good (1) or bad (0) on a document or abstains (null). Documents are counted by their
pattern of votes, at most three to the power of the number of rules; on that small table
expectation-maximisation estimates, without labels, how often each rule votes bad on good and on bad
documents and how common bad ones are, until no rate moves by more than ``TOLERANCE``. A document's posterior probability of being good replaces
the demand that every rule passes.

Cases: null and blank texts have no words and fail the base rules; a null doc_id is kept; repeated rows
give repeated rows and count as often as they occur; an empty table gives an empty result; other columns
are ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEPARATORS = " \t\n\x0b\f\r"
#: Rounds end when no rate moved by more than this in one, and in any case after ``MOST_ROUNDS``.
TOLERANCE = 1e-8
MOST_ROUNDS = 2000
KEEP_AT = 0.5

#: Frequent function words of the languages in the corpus.
FUNCTION_WORDS = ["the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "de", "la", "le", "les", "des", "et", "que", "en", "los", "las", "del", "y", "der", "die", "und", "das", "den", "von", "mit", "zu", "un", "une", "es", "se"]

#: Where EM starts: how often a rule votes bad on bad and on good documents, and the share of good documents.
START = (0.4, 0.02, 0.9)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words in three-word windows whose hash occurs twice or more."""

    def starts(t: Column) -> Column:
        again = F.filter(t, lambda x, j: (x["h"] == F.get(t, j - 1)["h"]) | (x["h"] == F.get(t, j + 1)["h"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(ordered, starts), lambda s: F.aggregate(F.transform(s, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x))


def _repeat_words(words: Column) -> Column:
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h))))


def features(text: Column) -> Column:
    """A struct of counts of one text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SEPARATORS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SEPARATORS}]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    by_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _repeat_words(w).cast("bigint").alias("n_repeat_words"),
            _let(F.array_distinct(w), lambda d: F.struct(F.size(d).cast("bigint").alias("kinds"), F.size(F.array_intersect(d, F.array(*map(F.lit, FUNCTION_WORDS)))).cast("bigint").alias("functional"))).alias("d"),
        ),
    )
    return F.struct(
        by_words.alias("w"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("!"), F.lit("")))).cast("bigint").alias("n_shout"),
    )


def _with_features(docs: DataFrame, text: Column, carried: list[Column]) -> DataFrame:
    found = docs.select(*carried, features(text).alias("_f"))
    return found.select(
        *found.columns[:-1],
        F.col("_f.w.n_words").alias("_n_words"),
        F.col("_f.w.word_chars").alias("_word_chars"),
        F.col("_f.n_symbols").alias("_n_symbols"),
        F.col("_f.lines.dup").alias("_n_dup_lines"),
        F.col("_f.w.n_repeat_words").alias("_n_repeat_words"),
        F.col("_f.lines.n").alias("_n_lines"),
        F.col("_f.n_upper").alias("_n_upper"),
        F.col("_f.n_shout").alias("_n_shout"),
        F.col("_f.w.d.kinds").alias("_kinds"),
        F.col("_f.w.d.functional").alias("_functional"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def votes() -> dict[str, Column]:
    """The rules over the feature columns."""
    c = F.col
    n = c("_n_words")
    return {
        "symbols": _vote(c("_n_symbols") * 10 > n, c("_n_symbols") * 50 <= n),
        "symbol_chars": _vote(c("_n_symbols") * 20 > c("_word_chars"), c("_n_symbols") * 100 <= c("_word_chars")),
        "shouting": _vote(c("_n_shout") * 10 > n, c("_n_shout") * 50 <= n),
        "capitals": _vote(c("_n_upper") * 10 > c("_word_chars") * 3, c("_n_upper") * 10 < c("_word_chars")),
        "repetition": _vote(c("_n_repeat_words") * 10 > n * 3, c("_n_repeat_words") * 10 < n),
        "lines": F.when(c("_n_lines") > 1, _vote(c("_n_dup_lines") * 10 > c("_n_lines") * 3, c("_n_dup_lines") == 0)),
        "variety": F.when(n.between(20, 2000), _vote(c("_kinds") * 10 < n * 2, c("_kinds") * 10 > n * 3)),
        "word_length": F.when(n > 0, _vote((c("_word_chars") > n * 14) | (c("_word_chars") < n * 2), c("_word_chars").between(n * 3, n * 10))),
        "function_words": F.when(n >= 30, _vote(c("_functional") < 2, c("_functional") >= 4)),
    }


def base_failed() -> Column:
    return (F.col("_n_words") < 50) | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * 50)


def log_odds(prior: Column, rates: Column, votes: Column) -> Column:
    """Of good against bad, of an array of votes given ``rates`` (bad, good): how often each rule votes bad on either."""
    told = F.zip_with(rates, votes, lambda r, v: F.when(v == 0, F.log(r["good"] / r["bad"])).when(v == 1, F.log((1 - r["good"]) / (1 - r["bad"]))).otherwise(F.lit(0.0)))
    return F.aggregate(told, F.log(prior / (1 - prior)), lambda total, x: total + x)


def _maximised(patterns: Column, model: Column, rules: int) -> Column:
    """One round of EM: a new model from ``patterns`` (votes, n), weighed by the posterior of the old one."""
    within = lambda x, least: F.least(F.greatest(x, F.lit(least)), F.lit(1 - least))
    weighed = F.transform(patterns, lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] / (1 + F.exp(-log_odds(model["prior"], model["rates"], x["votes"])))).alias("good")))

    def fitted(w: Column) -> Column:
        total = lambda of: F.aggregate(w, F.lit(0.0), lambda sum_, x: sum_ + of(x))
        voted = lambda i, vote, of: total(lambda x: F.when(F.get(x["votes"], i) == vote, of(x)).otherwise(F.lit(0.0)))

        def rate(i: Column, of: Callable[[Column], Column]) -> Column:
            bad = voted(i, 0, of)
            return within((bad + 1e-3) / (bad + voted(i, 1, of) + 2e-3), 1e-4)

        good, bad = lambda x: x["good"], lambda x: x["n"] - x["good"]
        rates = F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), lambda i: F.struct(rate(i, bad).alias("bad"), rate(i, good).alias("good")))
        return F.struct(within(total(good) / total(lambda x: x["n"]), 1e-3).alias("prior"), rates.alias("rates"))

    return _let(weighed, fitted)


class Model:
    """Estimated rates; ``posterior`` gives the probability of good as a Column over the vote columns."""

    def __init__(self, rates: dict[str, tuple[float, float]], prior: float) -> None:
        self.rates, self.prior = rates, prior

    def posterior(self, vote: dict[str, Column]) -> Column:
        rates = F.array(*(F.struct(F.lit(bad).alias("bad"), F.lit(good).alias("good")) for bad, good in self.rates.values()))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds(F.lit(self.prior), rates, F.array(*(vote[k] for k in self.rates)))))


def _moved(old: Column, new: Column) -> Column:
    """The largest change of a rate."""
    each = F.zip_with(old["rates"], new["rates"], lambda a, b: F.greatest(F.abs(a["bad"] - b["bad"]), F.abs(a["good"] - b["good"])))
    return F.greatest(F.abs(old["prior"] - new["prior"]), F.array_max(each))


def fit(voted: DataFrame, names: list[str], tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> Model:
    """EM over the vote columns ``names`` of all rows, in one query: rows are counted by pattern, and the patterns,
    at most 3 to the power of the rules, are folded in one row."""
    counts = voted.groupBy(F.array(*names).alias("votes")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    start = F.struct(F.lit(START[2]).alias("prior"), F.array_repeat(F.struct(F.lit(START[0]).alias("bad"), F.lit(START[1]).alias("good")), len(names)).alias("rates"), F.lit(1.0).alias("moved"))

    def one_round(model: Column, p: Column) -> Column:
        after = lambda new: F.struct(new["prior"].alias("prior"), new["rates"].alias("rates"), _moved(model, new).alias("moved"))
        return F.when(model["moved"] <= tolerance, model).otherwise(_let(_maximised(p, model, len(names)), after))

    patterns = F.sort_array(F.collect_list(F.struct("votes", "n")))
    folded = lambda p: F.aggregate(F.sequence(F.lit(1), F.lit(most_rounds)), start, lambda model, _: one_round(model, p))
    found = counts.agg(patterns.alias("p")).select(F.when(F.size("p") > 0, _let(F.col("p"), folded)).alias("m")).first().m
    if found is None:
        return Model(dict.fromkeys(names, START[:2]), START[2])
    return Model({k: (r.bad, r.good) for k, r in zip(names, found.rates, strict=True)}, found.prior)


_OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, *, keep_at: float = KEEP_AT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, counts, base_failed, kept and the posterior ``p_good``."""
    found = _with_features(docs, F.col("text"), [F.col("doc_id").cast("bigint").alias("doc_id")])
    rules = votes()
    found = common.checkpointed(found.select("doc_id", *(F.col(f"_{c}").alias(c) for c in _OUT), base_failed().alias("base_failed"), *(v.alias(f"v_{k}") for k, v in rules.items())))
    names = [f"v_{k}" for k in rules]
    p = fit(found.filter("not base_failed"), names).posterior({k: F.col(k) for k in names})
    return found.select("doc_id", *_OUT, "base_failed", (~F.col("base_failed") & (p >= keep_at)).alias("kept"), p.alias("p_good"))


def keep_good(docs: DataFrame, *, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    rules = votes()
    found = _with_features(docs, F.col(text), [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")])
    # kept with its votes: counting the patterns and judging the rows would else compute the features twice
    found = common.checkpointed(found.select("_row", base_failed().alias("_failed"), *(v.alias(f"v_{k}") for k, v in rules.items()))).filter("not _failed")
    names = [f"v_{k}" for k in rules]
    model = fit(found, names)
    return found.filter((model.posterior({k: F.col(k) for k in names}) >= keep_at)).select("_row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir)).withColumn("p_good", F.round("p_good", 6))
