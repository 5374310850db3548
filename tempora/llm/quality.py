"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each
failed rule; policies are versioned masks over those bits, and ablations are counts over the few distinct
bit patterns, so that a new policy needs neither the texts nor the rules again: the query writes its ledger and applies
its policy to the table. DataFrame functions only, no shuffle: all that a document needs stands in its own row.

Defined results: a null or empty text has no words and fails few_words. Repeated rows and ties get equal
rows each. Extra columns are ignored. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import GAP_CHARS, let, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rules in bit order: name, and the condition over the measurements under which a document fails.
RULES: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("few_words", lambda m: m["n_words"] < 20),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    ("symbols", lambda m: 100 * m["n_symbols"] > 20 * m["n_words"]),
    ("stutter", lambda m: 100 * m["n_stutter"] > 25 * m["n_words"]),
    ("shouting", lambda m: 100 * m["n_upper"] > 60 * m["n_letters"]),
    ("exclaiming", lambda m: 100 * m["n_exclaim"] > 60 * m["n_words"]),
    ("long_words", lambda m: m["word_chars"] > 40 * m["n_words"]),
    ("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["stutter"] | BIT["shouting"] | BIT["exclaiming"] | BIT["long_words"],
    "strict": (1 << len(RULES)) - 1,
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutter", "n_upper", "n_letters", "n_exclaim", "n_lines"]


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: equal hashes stand together after a sort, and each
    repeated window adds the words up to the next repeated one, WINDOW at most."""

    def repeated(s: Column) -> Column:
        same = lambda e, at: F.coalesce(F.get(s, at)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["at"]))

    def total(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(let(pairs, repeated), total)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of MEASURES. Windows are compared by 64-bit hashes of 64-bit hashes of words.

    Words, lines and windows are bound by let() and not by columns: a filter on the result may be moved below the
    columns it needs, and would then work them out again for each element."""

    def of_words(t: Column, words: Column, lines: Column) -> Column:
        n = F.size(words)
        slid = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
        windows = F.when(n >= WINDOW, slid).otherwise(F.array().cast("array<bigint>"))
        found = {
            "n_words": n,
            "word_chars": F.length(F.translate(t, GAP_CHARS, "")),
            "n_symbols": _count(t, SYMBOLS),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": let(windows, _covered),
            "n_stutter": F.size(F.filter(words, lambda h, i: F.coalesce(F.get(words, i - 1) == h, F.lit(False)))),
            "n_upper": _count(t, UPPER),
            "n_letters": _count(t, UPPER + UPPER.lower()),
            "n_exclaim": _count(t, "!"),
            "n_lines": F.size(lines),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in found.items()])

    words = F.transform(words_of(text), lambda w: F.xxhash64(w))
    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, GAP_CHARS, "")) > 0)
    bound = F.struct(F.coalesce(text, F.lit("")).alias("t"), words.alias("w"))
    return let(bound, lambda x: let(lines(x["t"]), lambda y: of_words(x["t"], x["w"], y)))


def ledger(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, the measurements and fail_bits, with bit i for the i-th of RULES."""

    def booked(m: Column) -> Column:
        total = F.lit(0).cast("long")
        for i, (_, fails) in enumerate(RULES):
            total = total.bitwiseOR(F.when(fails(m), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        return F.struct(*[m[k].alias(k) for k in MEASURES], total.alias("fail_bits"))

    return docs.select(*keep, let(measures(F.col("text")), booked).alias("__book")).select(*keep, *[F.col(f"__book.{c}").alias(c) for c in [*MEASURES, "fail_bits"]])


def passes(mask: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policy(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds base_failed and kept under a named policy."""
    return book.withColumns({"base_failed": ~passes(BASE), "kept": passes(BASE | POLICIES[policy])})


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: rows that fail it, and rows that it alone rejects. The ledger is first
    counted by bit pattern, so the rules are read off at most 2^len(RULES) rows."""
    mask = POLICIES[policy]
    patterns = book.groupBy("fail_bits").count()
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & mask]))
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    return (
        patterns.select("fail_bits", "count", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("failed"),
            F.sum(F.when(hit == F.col("r.bit"), F.col("count")).otherwise(0)).alias("only_this"),
        )
    )
