"""Personal data by weak supervision.

Regular expressions give candidate spans; regex, gazetteer and context labelers vote on each (1, -1 or 0 for
no opinion). Expectation-maximisation over the counts of vote patterns, of which there are at most 3^labelers
for each kind, estimates every labeler's reliability and each pattern's probability of being personal data.
Those probabilities then train a logistic span classifier on the patterns, and its decision is applied to
every candidate. Spans that the base patterns accept always stay; the classifier adds others.

DataFrame functions only: texts are cut by split() and regexp_extract_all(), offsets are running sums of code
point lengths over the hits, and only counts of patterns reach the driver.

Defined results: a null or empty text has no spans; repeated rows get equal rows each; an empty table gives
no rows and the prior model.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import let, written

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. A match starts at the start of its run of characters or where the last match
#: ended, so that runs that are no match are read once; groups repeat possessively, so that depth stays bounded.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider patterns, whose hits are personal data only if the classifier says so.
_EMAIL_WORDS = r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[({]\x20?(?:dot|DOT)\x20?[\])}]|\.)\x20?[A-Za-z0-9-]{1,63})++"
_IP_MARKED = r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[({](?:\.|dot|DOT)[\])}]\x20?[0-9]{1,3}){3}(?![0-9])"
_CARD_GROUPS = r"(?<![0-9A-Za-z./_])[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{1,7}(?![0-9A-Za-z/_])"
_CARD_RUN = r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"
_PHONE_LOCAL = r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"

#: Detectors: name, kind, pattern, and a cheap test that every text with a hit passes.
DETECTORS = (
    ("email", "email", _EMAIL, "contains(__text, '@')"),
    ("ip", "ip", _IP, r"__text rlike '[0-9][.][0-9]+[.][0-9]+[.][0-9]'"),
    ("card", "card", _CARD, r"__text rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'"),
    ("phone", "phone", _PHONE, "contains(__text, '+')"),
    ("email_words", "email", _EMAIL_WORDS, "__text rlike '[\\\\[({] ?(at|AT) ?[\\\\])}]'"),
    ("ip_marked", "ip", _IP_MARKED, r"__text rlike '[0-9] ?[\\[({]([.]|dot|DOT)[\\])}] ?[0-9]'"),
    ("card_groups", "card", _CARD_GROUPS, r"__text rlike '[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}'"),
    ("card_run", "card", _CARD_RUN, r"__text rlike '[0-9]{13}'"),
    ("phone_local", "phone", _PHONE_LOCAL, r"__text rlike '[0-9]{3}[ .-][0-9]{4}'"),
)
BASE = ("email", "ip", "card", "phone")
CONTEXT = 32

#: Gazetteers, as regular expressions over the hit or its surroundings.
_DOMAINS = r"(?i)[.\x20](com|org|net|edu|gov|int|info|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca)\W*$"
_RESERVED = r"^(0|127|255)\.|^1\.[0-9]+\.[0-9]+\.[0-9]+$"
_ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6)"
_NEAR = {
    "email": r"(?i)(mail|contact|write|reach|address|from|to)\W*$",
    "ip": r"(?i)\b(ip|host|address|server|client|addr)\W*$",
    "card": r"(?i)\b(card|visa|mastercard|credit|debit|payment)\W*$",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|cell|dial)\W*$",
}
_FAR = r"(?i)(version|release|isbn|issue|section|chapter|page|rfc|order|invoice|id|no|number|#)\W*$"
LABELERS = ("form", "checks", "gazetteer", "near", "apart")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _plausible(kind: Column, hit: Column) -> Column:
    """Whether a hit has as many digits as its kind can have; others are no candidates at all."""
    n = F.length(_digits(hit))
    return F.when(kind == "card", n.between(12, 19)).when(kind == "phone", n.between(9, 15)).otherwise(True)


def _checks(kind: Column, hit: Column) -> Column:
    """The base rules on a hit: parts of an address, length and check digit of a card, digits of a phone number."""
    digits = _digits(hit)
    parts = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))
    small = F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(9)).try_cast("int"), F.lit(0)) <= 255))
    return F.when(~_plausible(kind, hit), False).when(kind == "ip", small).when(kind == "card", _luhn(digits)).otherwise(True)


def hits_of(k: int):
    """A function of a struct (gaps, hits) that gives the k-th detector's hits with what stands around them."""

    def one(p: Column, h: Column, i: Column) -> Column:
        before, after = F.right(p["gaps"][i], F.lit(CONTEXT)), F.left(p["gaps"][i + 1], F.lit(CONTEXT))
        return F.struct(F.lit(k).alias("detector"), i.alias("i"), F.length(p["gaps"][i]).alias("gap"), h.alias("hit"), before.alias("before"), after.alias("after"))

    return lambda p: F.transform(p["hits"], lambda h, i: one(p, h, i))


_HIT = "struct<detector:int,i:int,gap:int,hit:string,before:string,after:string>"


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each hit: kept (a struct of keep), uid, detector, kind, start, stop, hit, before, after; a text without hits
    has one with a null detector."""
    kept = F.struct(F.lit(0), *keep).alias("kept")
    source = docs.select(kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"), F.monotonically_increasing_id().alias("uid"))
    none, empty = F.lit(None).cast(f"array<{_HIT}>"), F.array().cast(f"array<{_HIT}>")
    # A row of its own for texts without hits: what explode_outer() leaves empty reads as the last detector later on.
    nothing = F.array(F.expr(f"CAST(named_struct('d', -1, 'i', 0, 'g', 0, 'h', '', 'b', '', 'a', '') AS {_HIT})"))
    found = []
    for k, (_, _, pattern, test) in enumerate(DETECTORS):
        pair = F.struct(F.split("__text", pattern, -1).alias("gaps"), F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)).alias("hits"))
        rows = let(pair, hits_of(k))
        found.append(F.when(F.expr(test), rows).otherwise(none))
    every = let(F.concat(*[F.coalesce(f, empty) for f in found]), lambda h: F.when(F.size(h) == 0, nothing).otherwise(h))
    hits = source.select("kept", "uid", F.explode(every).alias("h")).select("kept", "uid", "h.*")
    before = Window.partitionBy("uid", "detector").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    some = F.col("detector") >= 0
    ends = hits.withColumn("stop", F.when(some, F.sum(F.col("gap") + F.length("hit")).over(before)))
    told = lambda values: F.when(some, F.element_at(F.array(*[F.lit(v) for v in values]), F.greatest(F.lit(1), F.col("detector") + 1)))
    name, kind = told([d[0] for d in DETECTORS]), told([KINDS.index(d[1]) for d in DETECTORS])
    hit = lambda c: F.when(some, F.col(c)).alias(c)
    return ends.select("kept", "uid", name.alias("detector"), kind.alias("kind"), (F.col("stop") - F.length("hit")).alias("start"), "stop", hit("hit"), hit("before"), hit("after"))


def vote(found: DataFrame) -> DataFrame:
    """Adds base (the base rules accept) and a vote of each of LABELERS; what is no candidate has no votes."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    checks = _checks(kind, F.col("hit"))
    near = F.lit(False)
    for k, pattern in _NEAR.items():
        near = near | ((kind == k) & F.col("before").rlike(pattern))
    gazetteer = (
        F.when(kind == "email", F.when(F.col("hit").rlike(_DOMAINS), 1).otherwise(-1))
        .when(kind == "ip", F.when(F.col("hit").rlike(_RESERVED), -1).otherwise(1))
        .when(kind == "card", F.when(_digits(F.col("hit")).rlike(_ISSUERS), 1).otherwise(-1))
        .otherwise(F.lit(0))
    )
    votes = {
        "form": F.when(F.col("detector").isin(*BASE), 1).otherwise(F.lit(0)),
        "checks": F.when(checks, 1).otherwise(F.lit(-1)),
        "gazetteer": gazetteer,
        "near": F.when(near, 1).when(F.col("before").rlike(_FAR), -1).otherwise(F.lit(0)),
        "apart": F.when(F.col("before").rlike(r"[A-Za-z0-9]$") | F.col("after").rlike(r"^[A-Za-z0-9]"), -1).otherwise(F.lit(1)),
    }
    some = F.col("detector").isNotNull() & _plausible(kind, F.col("hit"))
    return found.withColumns({"base": some & F.col("detector").isin(*BASE) & checks} | {k: F.when(some, v).cast("int") for k, v in votes.items()})


#: Where the estimation starts: odds that a candidate is personal data, and that a labeler votes right.
PRIOR, RIGHT, ROUNDS, SMOOTH = 0.5, 0.8, 50, 1.0


def estimate(counts: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over (votes, count): the share of positives, for each labeler and vote its
    probability under a positive and a negative, and each pattern's probability of being positive."""
    share = PRIOR
    table = [{1: (RIGHT * 0.7, (1 - RIGHT) * 0.7), -1: ((1 - RIGHT) * 0.7, RIGHT * 0.7), 0: (0.3, 0.3)} for _ in LABELERS]
    believed: dict[tuple[int, ...], float] = {}
    for _ in range(ROUNDS):
        for votes, _ in counts:
            yes = math.log(share) + sum(math.log(t[v][0]) for t, v in zip(table, votes, strict=True))
            no = math.log(1 - share) + sum(math.log(t[v][1]) for t, v in zip(table, votes, strict=True))
            believed[votes] = 1 / (1 + math.exp(min(700.0, no - yes)))
        total = sum(n for _, n in counts)
        up = sum(believed[v] * n for v, n in counts)
        share = (up + 1) / (total + 2)
        for j in range(len(LABELERS)):
            for value in (1, -1, 0):
                right = sum(believed[v] * n for v, n in counts if v[j] == value)
                wrong = sum((1 - believed[v]) * n for v, n in counts if v[j] == value)
                start = {1: (RIGHT * 0.7, (1 - RIGHT) * 0.7), -1: ((1 - RIGHT) * 0.7, RIGHT * 0.7), 0: (0.3, 0.3)}[value]
                table[j][value] = ((right + 10 * SMOOTH * start[0]) / (up + 10 * SMOOTH), (wrong + 10 * SMOOTH * start[1]) / (total - up + 10 * SMOOTH))
    return share, table, believed


def train(counts: list[tuple[tuple[int, ...], int]], believed: dict[tuple[int, ...], float], steps: int = 200) -> list[float]:
    """A logistic classifier on the votes, fitted to the estimated probabilities; the bias comes first. A labeler that always
    votes the same has no part in it."""
    varies = [len({votes[j] for votes, _ in counts}) > 1 for j in range(len(LABELERS))]
    weights = [0.0] * (len(LABELERS) + 1)
    total = sum(n for _, n in counts) or 1
    for _ in range(steps):
        slope = [0.0] * len(weights)
        for votes, n in counts:
            x = (1, *(v if told else 0 for v, told in zip(votes, varies, strict=True)))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * v for w, v in zip(weights, x, strict=True))))))
            for j, v in enumerate(x):
                slope[j] += n / total * (believed[votes] - p) * v
        weights = [w + 2.0 * s - 0.0005 * w for w, s in zip(weights, slope, strict=True)]
    return weights


def fit(voted: DataFrame) -> dict[int, list[float]]:
    """A classifier for each kind, from the counts of vote patterns over all candidates."""
    counted = voted.where("form IS NOT NULL").groupBy("kind", *LABELERS).count().collect()
    models = {}
    for kind in range(len(KINDS)):
        counts = sorted(((tuple(r[1:-1]), r[-1]) for r in counted if r[0] == kind))
        models[kind] = train(counts, estimate(counts)[2]) if counts else [0.0] * (len(LABELERS) + 1)
    return models


def score(models: dict[int, list[float]]) -> Column:
    total = None
    for kind, w in models.items():
        value = F.lit(w[0])
        for name, x in zip(LABELERS, w[1:], strict=True):
            value = value + F.lit(x) * F.col(name)
        total = F.when(F.col("kind") == kind, value) if total is None else total.when(F.col("kind") == kind, value)
    return total


#: The classifier adds a span that its log-odds put above this, and that passes the checks of its kind.
ADD_ABOVE = 1.0


def find(docs: DataFrame, keep: list[str], uid: str = "uid", spans: str = "spans") -> DataFrame:
    """keep, uid and spans: array of (start, kind, stop, base, hit) in order of start and kind, one row for each document.

    A span that the classifier adds touches no base span: of those that begin before it none ends after its start, and
    none after it begins before its end."""
    voted = written(vote(candidates(docs, keep)), "pii-voted")
    added = ~F.col("base") & (F.col("checks") == 1) & (score(fit(voted)) > ADD_ABOVE)
    line = Window.partitionBy("uid").orderBy("start", "kind", "stop")
    reached = F.max(F.when(F.col("base"), F.col("stop"))).over(line.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(line.rowsBetween(1, Window.unboundedFollowing))
    apart = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(following, F.col("stop")) >= F.col("stop"))
    chosen = F.when(F.col("base") | (F.col("added") & F.col("apart")), F.struct("start", "kind", "stop", "base", "hit"))
    grouped = voted.withColumns({"added": added, "apart": apart}).groupBy("uid").agg(F.first("kept").alias("kept"), F.sort_array(F.collect_list(chosen)).alias("spans"))
    return grouped.select(*[F.col("kept")[c].alias(c) for c in keep], F.col("uid").alias(uid), F.col("spans").alias(spans))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span that find() accepts replaced by its kind in angle brackets; columns as before.

    Found spans go back to their texts by uid, which both sides take from the same scan of a written table.
    """
    columns = docs.columns
    own = "uid_of_" + "_".join(columns)  # names that the table does not have
    found = "spans_of_" + "_".join(columns)
    base = written(docs.withColumn(own, F.monotonically_increasing_id()), "pii-texts")
    spans = find(base, [own], own + "_again", found).select(own, found).where(F.size(found) > 0)
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.col("text")
    # Texts between spans: from the furthest stop so far to the next start; a span that begins inside another adds no second mark.
    parts = F.aggregate(
        found,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["stop"].alias("at"), F.concat(a["out"], F.array(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.concat(F.lit("<"), F.element_at(names, s["kind"] + 1), F.lit(">")))).alias("out")),
        ).otherwise(F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    joined = base.join(spans, own, "left").withColumn("text", F.when(F.col(found).isNull(), text).otherwise(parts))
    if "n_chars" in columns:
        joined = joined.withColumn("n_chars", F.length("text").cast("long"))
    return joined.select(*columns)
