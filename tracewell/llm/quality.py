"""Quality rules with risk-controlled thresholds.

Each rule looks at one measure in [0, 1] that rises with badness and rejects a document from a cutoff
on. Cutoffs are not guessed: labelled documents are split by a hash into a tuning and a holdout half.
The tuning half lays out a path per stratum: rule sets that grow by one lowered cutoff at a time, those
first that reject the fewest good documents for each bad one, and only cutoffs where at least
``precision`` of what the rule rejects, and of what the path doesn't reject before it, is bad. On the holdout half exact binomial tests follow the path, up to the first rule
set that isn't proven to falsely reject at most ``risk`` of the good documents, all its rules together.
The order is fixed before, so the steps cost no correction; over strata the error ``delta`` is divided
by their number (Bonferroni). So with probability 1 - ``delta`` at most ``risk`` of the good documents
of every stratum are rejected. The last proven rule set counts; rules without a step in it are off.
With 4 strata a first step without false rejections needs 86 good holdout documents in its stratum.

Defined results: a null text has no words; a null stratum is a stratum; a stratum without labels has
no rules, so its documents pass; labels without an id or a value are not read, and of several labels
of one id the lowest counts; documents without an id have no label; an empty table gives no rows. All
labelled rows are counted, in any number: what is passed on is one row per stratum, rule and step, and one
per stratum and step of its path.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.words import words
from tracewell.session import broadcast_if_small, written_table

STEPS = 100
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(0x41, 0x5B))
DIGITS = b"0123456789"
WINDOW = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
          "n_upper", "n_digits", "n_calls", "n_top_word"]
COUNT_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


@dataclass(frozen=True)
class Risk:
    """False rejections allowed per stratum, error probability, least share of bad ones rejected."""

    risk: float = 0.05
    delta: float = 0.05
    precision: float = 0.8


# Measures that rise with badness, from the counts; a text without words has none.
def _per(c: Column, top: str, bottom: str) -> Column:
    return F.when(c[bottom] > 0, c[top] / c[bottom])


RULES: dict[str, Callable[[Column], Column]] = {
    "symbols": lambda c: 2 * _per(c, "n_symbols", "word_chars"),
    "dup_lines": lambda c: _per(c, "n_dup_lines", "n_lines"),
    "repeats": lambda c: _per(c, "n_repeat_words", "n_words"),
    "long_words": lambda c: _per(c, "word_chars", "n_words") / 20,
    "short_words": lambda c: 1 - _per(c, "word_chars", "n_words") / 20,
    "upper": lambda c: _per(c, "n_upper", "word_chars"),
    "digits": lambda c: _per(c, "n_digits", "word_chars"),
    "calls": lambda c: 5 * _per(c, "n_calls", "word_chars"),
    "one_word": lambda c: _per(c, "n_top_word", "n_words"),
    "short": lambda c: 1 - c["n_words"] / 200,
}


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def repeated_words(tokens: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words that occur more than once."""
    n = len(tokens)
    if n <= window:
        return 0
    h = np.fromiter(map(hash, tokens), np.int64, n).view(np.uint64)
    step = 1
    while step < window:
        h = _mix(h[:-step], h[step:])
        step *= 2
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    edges = np.bincount(at, minlength=n + 1) - np.bincount(at + window, minlength=n + 1)
    return int(np.count_nonzero(np.cumsum(edges)))


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one whole text."""
    text = text or b""
    tokens = words(text)
    if not tokens:
        return (0,) * len(COUNTS)
    joined = b"".join(tokens)
    size = len(joined)
    without = lambda chars: size - len(joined.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(tokens), size - without(CONTINUATION), without(SYMBOLS), len(lines),
            len(lines) - len(set(lines)), repeated_words(tokens), without(UPPER), without(DIGITS),
            without(b"!?"), max(Counter(tokens).values()))


@F.arrow_udf(COUNT_TYPE)
def _counts(text: pa.Array) -> pa.Array:
    rows = [text_counts(t.as_py()) for t in text]
    cols = np.array(rows, dtype=np.int64).reshape(len(rows), len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(cols[:, i]) for i in range(len(COUNTS))], COUNTS)


def count_text(text: Column) -> Column:
    """A struct of the ``COUNTS`` of a text.

    Marked as nondeterministic so that a filter on it isn't moved below, which would count twice.
    """
    return _counts.asNondeterministic()(text.cast("binary"))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def rule_steps(counts: Column) -> Column:
    """The step, 0 to ``STEPS``, that each rule's measure reaches, in the order of ``RULES``."""
    measures = [rule(counts) for rule in RULES.values()]
    return F.array(*[F.floor(F.least(F.greatest(F.coalesce(m, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
                             * STEPS + F.lit(1e-9)).cast("int") for m in measures])


def binomial_below(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), through the incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1.0, 1.0 - p  # I_{1-p}(n - k, k + 1)
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1.0 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    frac = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            frac *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    part = front * frac
    return 1.0 - part if flip else part


def choose_cutoff(steps: pd.DataFrame, limit: float, error: float, precision: float) -> int:
    """The cutoff of a rule that is tested alone in one stratum; ``STEPS`` + 1 if it is off.

    ``steps`` has ``step``, ``good_hold``, ``good_tune`` and ``bad_tune`` counts.
    """
    def above(col):
        out = np.zeros(STEPS + 2, dtype=np.int64)
        np.add.at(out, steps["step"].to_numpy(), steps[col].to_numpy())
        return out[::-1].cumsum()[::-1]

    hold, good, bad = above("good_hold"), above("good_tune"), above("bad_tune")
    best, n = STEPS + 1, int(hold[0])
    for cut in range(STEPS, 0, -1):
        if binomial_below(int(hold[cut]), n, limit) > error:
            break
        if bad[cut] and bad[cut] >= precision * (bad[cut] + good[cut]):
            best = cut
    return best


def rule_path(steps: pd.DataFrame, precision: float) -> list[tuple[int, int]]:
    """The path of one stratum: (rule, cutoff), each of which lowers that rule's cutoff.

    ``steps`` has ``rule``, ``step``, ``good`` and ``bad`` counts of the tuning half.
    """
    moves = []
    for rule, mine in steps.groupby("rule"):
        counts = np.zeros((2, STEPS + 1), dtype=np.int64)
        np.add.at(counts[0], mine["step"].to_numpy(), mine["good"].to_numpy())
        np.add.at(counts[1], mine["step"].to_numpy(), mine["bad"].to_numpy())
        good, bad = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        most = 0
        for cut in range(STEPS, 0, -1):
            if bad[cut] > most and bad[cut] >= precision * (bad[cut] + good[cut]):
                most = bad[cut]
                moves.append(((good[cut] + 1) / (bad[cut] + 1), -cut, int(rule)))
    path, now = [], {}
    for _, cut, rule in sorted(moves):
        if -cut < now.get(rule, STEPS + 1):
            now[rule] = -cut
            path.append((rule, -cut))
    return path


def proven_steps(first: np.ndarray, counts: np.ndarray, length: int, limit: float, error: float) -> int:
    """How many steps of a path are proven; ``counts`` good documents are rejected from step ``first`` on."""
    by_step = np.zeros(length + 1, dtype=np.int64)
    np.add.at(by_step, first, counts)
    n, out = int(by_step.sum()), by_step.cumsum()
    for done in range(length):
        if binomial_below(int(out[done]), n, limit) > error:
            return done
    return length


def fit_cutoffs(labelled: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """One row per stratum: ``stratum`` and ``cutoffs``, an array in the order of ``RULES``.

    ``labelled`` has ``id``, ``stratum``, ``steps`` and ``quality`` (0 or 1).
    """
    hold = F.pmod(F.xxhash64(F.lit("holdout"), F.col("id")), F.lit(2)) == 0
    table = written_table(labelled.select("stratum", "quality", "steps", hold.alias("hold")), "labelled")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    tuning = (table.where(~F.col("hold")).select("stratum", "quality", F.posexplode("steps").alias("rule", "step"))
              .groupBy("stratum", "rule", "step")
              .agg(count(F.col("quality") == 1).alias("good"), count(F.col("quality") == 0).alias("bad")))
    precision, limit = risk.precision, risk.risk

    def lay_out(pdf: pd.DataFrame) -> pd.DataFrame:
        path = rule_path(pdf, precision)
        return pd.DataFrame({"stratum": pdf["stratum"].iloc[:1].to_list(), "rules": [[r for r, _ in path]],
                             "cuts": [[c for _, c in path]]})

    form = "stratum string, rules array<int>, cuts array<int>"
    paths = written_table(tuning.groupBy("stratum").applyInPandas(lay_out, form), "paths")

    def firsts(rows: DataFrame, paths: DataFrame) -> DataFrame:
        """Per stratum and first step of its path that rejects them, the number of good and bad documents."""
        reached = F.zip_with("rules", "cuts", lambda r, c: F.get("steps", r) >= c)
        at = F.array_position(reached, True)
        return (rows.join(broadcast_if_small(paths), "stratum")
                .select("stratum", "quality", F.when(at > 0, at - 1).otherwise(F.size("rules")).alias("first"))
                .groupBy("stratum", "first")
                .agg(count(F.col("quality") == 1).alias("good"), count(F.col("quality") == 0).alias("bad")))

    def thin(new: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        path = path.copy()
        new = new[(new["bad"] > 0) & (new["bad"] >= precision * (new["bad"] + new["good"]))]
        for c in ("rules", "cuts"):
            path[c] = [[int(x[k]) for k in sorted(new["first"]) if k < len(x)] for x in path[c]]
        return path[["stratum", "rules", "cuts"]]

    paths = written_table(firsts(table.where(~F.col("hold")), paths).groupBy("stratum").cogroup(
        paths.groupBy("stratum")).applyInPandas(thin, form), "paths")
    error = risk.delta / max(1, paths.count())
    first = firsts(table.where(F.col("hold") & (F.col("quality") == 1)), paths)

    def fit(good: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        cuts = [STEPS + 1] * len(RULES)
        if not len(path):
            return pd.DataFrame({"stratum": [], "cutoffs": []})
        rules, steps = path["rules"].iloc[0], path["cuts"].iloc[0]
        for k in range(proven_steps(good["first"].to_numpy(np.int64), good["good"].to_numpy(np.int64), len(rules),
                                    limit, error)):
            cuts[rules[k]] = int(steps[k])
        return pd.DataFrame({"stratum": path["stratum"].iloc[:1].to_list(), "cutoffs": [cuts]})

    return first.groupBy("stratum").cogroup(paths.groupBy("stratum")).applyInPandas(
        fit, "stratum string, cutoffs array<int>")


def rejected(steps: Column, cutoffs: Column) -> Column:
    """Whether any rule reaches its cutoff; without cutoffs nothing is rejected."""
    hit = F.exists(F.zip_with(steps, cutoffs, lambda s, c: s >= c), lambda x: x)
    return F.coalesce(hit, F.lit(False))


def label_table(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    return (labels.where(F.col(doc_id).isNotNull() & F.col(quality).isin(0, 1))
            .groupBy(F.col(doc_id).alias("id")).agg(F.min(quality).alias("quality")))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang"
             ) -> DataFrame:
    """``id``, ``stratum``, counts, ``steps`` and ``base_failed`` of every document."""
    x = docs.select(F.col(doc_id).alias("id"),
                    F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
                    count_text(F.col(text)).alias("_x"))
    return x.select("id", "stratum", "_x.*", rule_steps(F.col("_x")).alias("steps"),
                    base_failed(F.col("_x")).alias("base_failed"))


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), **names) -> DataFrame:
    """``measured`` with ``kept``. The texts are read once; the measures are written in between."""
    table = written_table(measured(docs, **names), "measures")
    cutoffs = fit_cutoffs(
        table.where(~F.col("base_failed")).join(label_table(labels), "id"), risk)
    return table.join(broadcast_if_small(written_table(cutoffs, "cutoffs")), "stratum", "left").withColumn(
        "kept", ~F.col("base_failed") & ~rejected(F.col("steps"), F.col("cutoffs")))


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), doc_id: str = "doc_id",
              text: str = "text", stratum: str = "lang") -> DataFrame:
    """The documents that pass, with all their columns.

    Texts are measured twice, for the fit and for the verdict, which is cheaper than to shuffle them.
    """
    fit = measured(docs, doc_id, text, stratum).where(~F.col("base_failed")).join(
        label_table(labels), "id")
    cutoffs = broadcast_if_small(written_table(fit_cutoffs(fit, risk), "cutoffs"))
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(
        F.col(stratum).cast("string"), F.lit("")).alias("stratum"), count_text(F.col(text)).alias("_x"))
    passed = rows.join(cutoffs, "stratum", "left").where(
        ~base_failed(F.col("_x")) & ~rejected(rule_steps(F.col("_x")), F.col("cutoffs")))
    return passed.select("_row.*")
