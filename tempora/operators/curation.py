"""From extracted records to claims: crosswalks, matches by name and period, holds, plans and inventories.

Joins are equi-joins on names, codes or addresses with a condition on periods behind them; what has to be unique is counted
by a window or an aggregate of its own key, and what is not unique stays in the result with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.inorder import in_order
from tempora.sources.stores import written


def _overlap(f: Column, t: Column, f2: Column, t2: Column) -> Column:
    return (f <= t2) & (t >= f2)


def unique_matches(rows: DataFrame, others: DataFrame, on: list[str], condition: Column | None = None) -> DataFrame:
    """Rows (id, ...) with the other (other) that alone equals them in on and meets the condition on r and o; others without or with
    several have null and candidates, their number."""
    r, o = rows.alias("r"), others.alias("o")
    met = F.lit(True) if condition is None else condition
    for c in on:
        met = met & (F.col(f"r.{c}") == F.col(f"o.{c}"))
    pairs = r.join(o, met).groupBy("r.id").agg(F.count_distinct("o.other").alias("candidates"), F.min("o.other").alias("one"))
    line = rows.join(pairs, "id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return line.withColumn("other", F.when(F.col("candidates") == 1, F.col("one"))).drop("one")


def by_tokens(rows: DataFrame, others: DataFrame, within: str) -> DataFrame:
    """Id, candidates and other: the only one of others (other, within, tokens) of the same group that shares a token with a row
    (id, within, tokens)."""
    left = rows.select("id", within, F.explode("tokens").alias("token"))
    right = others.select("other", within, F.explode("tokens").alias("token")).where(F.length("token") > 1)
    met = left.join(right, [within, "token"]).groupBy("id").agg(F.count_distinct("other").alias("candidates"), F.min("other").alias("one"))
    line = rows.select("id").join(met, "id", "left")
    return line.select("id", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(F.col("candidates") == 1, F.col("one")).alias("other"))


def by_name_then_dates(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows (id, polity, key, f, t) with the other (other, polity, key, f, t) of their name; of several the one whose dates are
    equal, if there is one: id, other, outcome: matched, conflict (other dates) or unmatched."""
    a, b = rows.alias("a"), others.alias("b")
    met = a.join(b, (F.col("a.polity") == F.col("b.polity")) & (F.col("a.key") == F.col("b.key")))
    same = F.col("a.f").eqNullSafe(F.col("b.f")) & F.col("a.t").eqNullSafe(F.col("b.t"))
    per = met.groupBy("a.id").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("equal"), F.min("b.other").alias("any"), F.min(F.when(same, F.col("b.other"))).alias("exact"))
    line = rows.select("id").join(per, "id", "left")
    outcome = F.when(F.col("equal") == 1, "matched").when((F.col("n") == 1) & (F.col("equal") == 0), "conflict").otherwise("unmatched")
    return line.select("id", outcome.alias("outcome"), F.when(outcome == "matched", F.col("exact")).when(outcome == "conflict", F.col("any")).alias("other"))


def by_jurisdiction(rows: DataFrame, polities: DataFrame, slack: int = 15) -> DataFrame:
    """Rows (id, name, f, t) with the only polity (polity, name, first, last) of their name whose span they overlap: id, polity and
    reason: invalid, ambiguous (none or several), outside (more than slack years beyond the span) or null."""
    sound = F.col("f").isNotNull() & F.col("t").isNotNull() & (F.col("f") <= F.col("t"))
    met = rows.where(sound).alias("r").join(polities.alias("p"), (F.col("r.name") == F.col("p.name")) & _overlap(F.col("r.f"), F.col("r.t"), F.col("p.first"), F.col("p.last")))
    far = (F.col("r.f") < F.col("p.first") - slack) | (F.col("r.t") > F.col("p.last") + slack)
    per = met.groupBy("r.id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("p.polity", far.alias("far"))).alias("one"))
    line = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).select("id", "sound").join(per, "id", "left")
    reason = F.when(~F.col("sound"), "invalid").when(F.coalesce("n", F.lit(0)) != 1, "ambiguous").when(F.col("one.far"), "outside")
    return line.select("id", F.when(reason.isNull(), F.col("one.polity")).alias("polity"), reason.alias("reason"))


def by_code(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows (id, code, f, t) with the only period (code, first, last, polity) that holds their start and ends at most a year
    before them: id, polity."""
    met = rows.alias("r").join(periods.alias("p"), (F.col("r.code") == F.col("p.code")) & F.col("r.f").between(F.col("p.first"), F.col("p.last")) & (F.col("r.t") <= F.col("p.last") + 1))
    per = met.groupBy("r.id").agg(F.count(F.lit(1)).alias("n"), F.min("p.polity").alias("one"))
    return rows.select("id").join(per, "id", "left").select("id", F.when(F.col("n") == 1, F.col("one")).alias("polity"))


def routes(pages: DataFrame, identities: DataFrame) -> DataFrame:
    """Identities (polity, urls) by the addresses of pages (page, url, aliases), their own and those that lead to them: page, polity."""
    named = pages.select("page", F.explode(F.array_distinct(F.concat(F.array("url"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("url"))
    return identities.select("polity", F.explode("urls").alias("url")).join(named, "url").select("page", "polity").distinct()


def umbrellas(rows: DataFrame) -> DataFrame:
    """Identities (polity, name, url, title, first, last) whose page also serves another with an overlapping span and is not named
    like them: those are skipped, polity and url."""
    known = written(rows.select("polity", "name", "url", "title", "first", "last").where("url IS NOT NULL AND polity IS NOT NULL"), "spans")
    proper, odd = known.where("first <= last"), known.where("first > last")
    asked = proper.where(F.lower("title") != F.lower("name"))
    # Spans that a span meets: those that begin by its end, less those that end before its beginning. Others are there if these are
    # more than those of the same identity.
    for n, keys in (("n", ["url"]), ("own", ["url", "polity"])):
        ends = [proper.select(*keys, F.col(c).alias("year"), F.lit(i).alias("begun"), F.lit(1 - i).alias("ended")) for i, c in ((1, "first"), (0, "last"))]
        counts = ends[0].unionByName(ends[1]).groupBy(*keys, "year").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended"))
        so_far = Window.partitionBy(*keys).orderBy("year")
        counts = counts.select(*keys, "year", F.sum("begun").over(so_far).alias("begun"), (F.sum("ended").over(so_far) - F.col("ended")).alias("ended"))
        asked = asked.join(counts.select(*keys, F.col("year").alias("last"), "begun"), [*keys, "last"]).join(counts.select(*keys, F.col("year").alias("first"), "ended"), [*keys, "first"])
        asked = asked.withColumn(n, F.col("begun") - F.col("ended")).drop("begun", "ended")
    met = asked.where("n > own").select("polity", "url")
    # Spans that end before they begin are compared one by one.
    for a, b in ((odd, known), (proper, odd)):
        a, b = a.alias("a"), b.alias("b")
        pairs = a.join(b, (F.col("a.url") == F.col("b.url")) & (F.col("a.polity") != F.col("b.polity")) & _overlap(F.col("a.first"), F.col("a.last"), F.col("b.first"), F.col("b.last")))
        met = met.unionByName(pairs.where(F.lower("a.title") != F.lower("a.name")).select("a.polity", "a.url"))
    return met.distinct()


def associated(tenures: DataFrame, spans: DataFrame) -> DataFrame:
    """tenures (id, polity, f, t) that overlap their polity's span (polity, first, last); their bounds stay whole, and a missing
    one counts as open."""
    line = tenures.join(spans, "polity")
    return line.where((F.coalesce("f", "t") <= F.col("last")) & (F.coalesce("t", "f") >= F.col("first"))).select(*tenures.columns)


def held(rows: DataFrame, holds: DataFrame, on: list[str]) -> DataFrame:
    """rows with the reason of a hold list (on, reason) that names them, null for those that go on."""
    return rows.join(holds.select(*on, "reason").dropDuplicates(on), on, "left")


def unqualified(tenures: DataFrame, positions: DataFrame) -> DataFrame:
    """tenures (id, person, office, f, t) of people who hold no qualified position (person, office, f, t) of the same office
    at the time."""
    p = positions.alias("p")
    met = (F.col("t.person") == F.col("p.person")) & (F.col("t.office") == F.col("p.office")) & _overlap(F.col("p.f"), F.col("p.t"), F.col("t.f"), F.col("t.t"))
    return tenures.alias("t").join(p, met, "left_anti")


def undisputed(pages: DataFrame, html: str, marks: tuple[str, ...]) -> DataFrame:
    """pages without a mark that warns of their accuracy."""
    return pages.where(~F.coalesce(F.col(html).rlike("|".join(marks)), F.lit(False)))


def within_entity(tenures: DataFrame, spans: DataFrame) -> DataFrame:
    """Tenures (id, polity, f, t) with held: whether they cross the start or end (begun, ended; null unknown) of what they
    belong to. None is cut."""
    line = tenures.join(spans, "polity", "left")
    crosses = F.coalesce(F.col("f") < F.col("begun"), F.lit(False)) | F.coalesce(F.col("t") > F.col("ended"), F.lit(False))
    return line.withColumn("held", crosses).select(*tenures.columns, "held")


def merged_profiles(profiles: DataFrame, fields: list[str], listed: str) -> DataFrame:
    """One row for each polity from rows of several families (polity, family_ord): of each field the last that is set, and of the
    column listed all texts in order."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("family_ord"))).alias(c) for c in fields]
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col(listed).isNotNull(), F.struct("family_ord", listed)))), lambda x: x[listed])
    return profiles.groupBy("polity").agg(*last, F.array_join(texts, " ").alias(listed))


def applied_plan(claims: DataFrame, groups: DataFrame, conflicted: DataFrame) -> DataFrame:
    """Claims (id, polity, person, f, t) after an identity plan: groups (id, keeper) fold into their keeper, conflicted (id) are
    withheld with all versions of their group. fate: kept, merged or withheld; a plan that folds claims of different polity or bounds
    fails."""
    both = claims.join(groups, "id", "left").join(claims.select(F.col("id").alias("keeper"), F.col("polity").alias("kp"), F.col("f").alias("kf"), F.col("t").alias("kt")), "keeper", "left")
    same = (F.col("polity") == F.col("kp")) & F.col("f").eqNullSafe(F.col("kf")) & F.col("t").eqNullSafe(F.col("kt"))
    checked = F.when(F.col("keeper").isNotNull() & ~F.coalesce(same, F.lit(False)), F.raise_error(F.concat(F.lit("the plan folds unlike claims into "), "keeper"))).otherwise(F.coalesce("keeper", "id"))
    line = both.withColumn("to", checked)
    bad = conflicted.select("id").distinct().join(line.select("id", "to"), "id").select("to").distinct().withColumn("bad", F.lit(True))
    fate = F.when(F.col("bad"), "withheld").when(F.col("to") != F.col("id"), "merged").otherwise("kept")
    return line.join(bad, "to", "left").select("id", "to", fate.alias("fate"))


def claims_of(records: DataFrame, peers: DataFrame) -> DataFrame:
    """A claim for each record (id, src, rid, polity, person, role, f, t) with its own assertion and those of its peers (id, ord,
    src, rid, person, f, t); the person is the first peer's."""
    own = records.select("id", F.lit(-1).alias("ord"), "src", "rid", "person", "f", "t")
    told = own.unionByName(peers.select(own.columns)).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "src", "rid", "f", "t"))).alias("assertions"), F.min_by("person", F.when(F.col("ord") >= 0, F.col("ord"))).alias("first")
    )
    return records.join(told, "id").select("id", "polity", F.coalesce("first", "person").alias("person"), "role", "f", "t", "assertions")


def chronologies(records: DataFrame) -> DataFrame:
    """An assertion for each alternative of a record (rid, alternatives: array of struct(chronology, f, t)), with an id that tells
    them apart."""
    line = records.select("rid", F.posexplode("alternatives").alias("ord", "a"))
    mark = F.left(F.sha2(F.concat_ws("|", "rid", "a.chronology", F.coalesce(F.col("a.f").cast("string"), F.lit("")), F.coalesce(F.col("a.t").cast("string"), F.lit(""))), 256), F.lit(12))
    return line.select(F.concat_ws("#", "rid", mark).alias("rid"), "ord", "a.chronology", "a.f", "a.t")


def inventory(identities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every identity (polity) with its distinct candidate addresses (polity, url, ord) in order, and whether one of them also
    stands for another identity."""
    once = candidates.groupBy("polity", "url").agg(F.min("ord").alias("ord"))
    shared = once.groupBy("url").agg(F.count_distinct("polity").alias("n")).where("n > 1").select("url", F.lit(True).alias("shared"))
    told = once.join(shared, "url", "left").groupBy("polity").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url"))), lambda x: x["url"]).alias("urls"), F.coalesce(F.bool_or("shared"), F.lit(False)).alias("ambiguous"))
    return identities.select("polity").join(told, "polity", "left").select("polity", F.coalesce("urls", F.array().cast("array<string>")).alias("urls"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def extracted_statements(direct: DataFrame, offices: DataFrame, holders: DataFrame) -> DataFrame:
    """Statements with the route that found them: direct (polity, statement, person), or by an office (polity, office) and who held
    it (office, statement, person); a statement found both ways is direct: polity, statement, person, route, office."""
    a = direct.select("polity", "statement", "person", F.lit("direct").alias("route"), F.lit(None).cast("string").alias("office"))
    b = offices.join(holders, "office").select("polity", "statement", "person", F.lit("office").alias("route"), F.col("office").cast("string").alias("office"))
    w = Window.partitionBy("polity", "statement").orderBy("route", F.asc_nulls_first("office"))
    return a.unionByName(b).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def review_report(reviewed: DataFrame, least: int = 5, share: float = 0.9) -> DataFrame:
    """Reviewed records (src, rid, outcome) by source: selected, matched, conflicting, unresolved, and whether they pass."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    per = reviewed.groupBy("src").agg(F.count(F.lit(1)).alias("selected"), n("matched").alias("matched"), n("conflict").alias("conflicting"), F.count_if(F.col("outcome").isNull()).alias("unresolved"))
    return per.withColumn("passes", (F.col("selected") >= least) & (F.col("unresolved") == 0) & (F.col("matched") >= share * F.col("selected")))


def coverage_dispositions(identities: DataFrame, rosters: DataFrame, candidates: DataFrame, holds: DataFrame) -> DataFrame:
    """Every identity once by how it is covered: roster, held, candidate (an address, no roster) or none; kind and identities."""
    flag = lambda df, name: df.select("polity").distinct().withColumn(name, F.lit(True))
    line = identities.select("polity").join(flag(rosters, "has"), "polity", "left").join(flag(holds, "kept"), "polity", "left").join(flag(candidates, "seen"), "polity", "left")
    kind = F.when(F.col("has"), "roster").when(F.col("kept"), "held").when(F.col("seen"), "candidate").otherwise("none")
    return line.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("identities"))


def distinct_days(rows: DataFrame, signature: list[str]) -> DataFrame:
    """U8: of rows (ord, from_day, to_day) equal in signature the first, and later ones only if they and all that stand are known to
    the day and touch none of them. Days are ISO texts or structs that compare in time."""
    def step(state, ord_, f, t):
        known = f is not None and t is not None
        if not state:
            state.update(first=ord_, known=known, held=[])
        first = ord_ == state["first"]
        f, t = (tuple(v.values()) if isinstance(v, dict) else v for v in (f, t))
        free = state["known"] and known and all(b <= f or t <= a for a, b in state["held"])
        if free:
            state["held"].append((f, t))
        return first or free

    # Which row stands depends on those before it; a signature is one person's tenures of one office, so few stand.
    line = in_order(rows.where("ord IS NOT NULL"), signature, ["ord"], ["ord", "from_day", "to_day"], dict, step, "__stands boolean")
    return line.where("__stands").select(*rows.columns)


def planned(routes_: list[DataFrame]) -> DataFrame:
    """Addresses (polity, url) of several lists in order of preference, each once, where the first list names it: with route, its number."""
    every = None
    for i, r in enumerate(routes_):
        part = r.select("polity", "url").distinct().withColumn("route", F.lit(i))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("polity", "url").agg(F.min("route").alias("route"))


def crawled(starts: DataFrame, links: DataFrame, pattern: str, written) -> DataFrame:
    """Pages (page) reached from starts by links (page, target) whose target matches a pattern, with depth, rounds until no page
    is new. written(df, name) cuts lineage: it stores a table and reads it back."""
    seen = written(starts.select("page").distinct().withColumn("depth", F.lit(0)), "crawled")
    fresh, depth = seen, 0
    good = links.where(F.col("target").rlike(pattern))
    while not fresh.isEmpty():
        depth += 1
        found = fresh.select("page").join(good, "page").select(F.col("target").alias("page")).distinct().join(seen.select("page"), "page", "left_anti")
        fresh = written(found.withColumn("depth", F.lit(depth)), "crawled")
        seen = seen.unionByName(fresh)
    return seen


def paired_events(pairs: DataFrame, tenures: DataFrame, events: DataFrame) -> DataFrame:
    """Tenures (id, f, t) against an independent chronology (line, year) by a table of pairs (id, start_line, end_line): id, the two
    years of the chronology and whether both are equal."""
    year = lambda name: events.select(F.col("line").alias(f"{name}_line"), F.col("year").alias(name))
    line = pairs.join(tenures, "id").join(year("start"), "start_line", "left").join(year("end"), "end_line", "left")
    return line.select("id", "start", "end", (F.col("f").eqNullSafe(F.col("start")) & F.col("t").eqNullSafe(F.col("end"))).alias("equal"))


def holders_to_find(offices: DataFrame, holders: DataFrame, covered: DataFrame, spans: DataFrame, before: int = 1875) -> DataFrame:
    """X11: distinct (person, office) of offices (polity, office) of identities that have no roster (polity) or ended before a year."""
    past = spans.where(F.col("last") < before).select("polity")
    wanted = offices.join(covered.select("polity"), "polity", "left_anti").unionByName(offices.join(past, "polity", "left_semi"))
    return holders.join(wanted.select("office").distinct(), "office", "left_semi").select("person", "office").distinct()


def recovered(receipts: DataFrame, prints: DataFrame) -> DataFrame:
    """The last receipt (time, path, url, sha256) of each address whose stored file (path, sha256) still has its hash; of equal
    times the later path."""
    sound = receipts.join(prints.select("path", "sha256"), ["path", "sha256"], "left_semi")
    return sound.groupBy("url").agg(F.max(F.struct("time", "path", "sha256")).alias("r")).select("url", "r.time", "r.path", "r.sha256")


def complete_rosters(rosters: DataFrame, expected: DataFrame, least: int = 2) -> DataFrame:
    """Polities whose expected entries (polity, entry) are, entry for entry, those of rosters (polity, src, lineage, entry) of at
    least two lineages: polity, lineages."""
    listed = lambda df, by: df.groupBy(*by).agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    want = listed(expected, ["polity"]).where(F.size("entries") == F.size(F.array_distinct("entries")))
    equal = listed(rosters, ["polity", "src", "lineage"]).join(want, ["polity", "entries"], "left_semi")
    return equal.groupBy("polity").agg(F.count_distinct("lineage").alias("lineages")).where(F.col("lineages") >= least)
