"""Identity work on rulers' rows: components, keepers, duplicates, conflicts, redirects, routing.

Rows have id, polity, person, name, role, from, to (nullable years). Self-joins are keyed by polity and person or name, and
range conditions stand beside the key, so that no join is a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.sources.stores import dropped, written

def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node that links (a, b) reach.

    In each round every node goes to its smallest neighbour, if that is smaller, and on to where that one goes; links then lead between
    the places arrived at, so that at most half of the nodes are left after two rounds. In the end the rounds are followed backwards.
    Rounds are stored tables, deleted when they are done; their joins are merges, as a table told to all tasks in every round would pass
    through the driver as often."""
    links = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    rounds = []
    while True:
        goes = written(links.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("to")).withColumn("moved", F.col("node") > F.col("to")), "goes")
        while not goes.where("moved").isEmpty():
            ahead = goes.select(F.col("node").alias("to"), F.col("to").alias("far")).hint("merge")
            after = written(goes.join(ahead, "to").select("node", F.col("far").alias("to"), (F.col("to") > F.col("far")).alias("moved")), "goes")
            dropped(goes)
            goes = after
        rounds.append(goes)
        at = lambda end: goes.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")).hint("merge")
        left = written(links.where("a < b").join(at("a"), "a").join(at("b"), "b").where("a_to <> b_to").select(F.explode(F.array(F.struct(F.col("a_to").alias("a"), F.col("b_to").alias("b")), F.struct(F.col("b_to").alias("a"), F.col("a_to").alias("b")))).alias("l")).select("l.*").distinct(), "links")
        dropped(links)
        links = left
        if links.isEmpty():
            break
    dropped(links)
    labels = rounds.pop()
    found = labels.select("node", F.col("to").alias("component"))
    while rounds:
        before = rounds.pop()
        known = found.select(F.col("node").alias("to"), "component").hint("merge")
        after = written(before.join(known, "to", "left").select("node", F.coalesce("component", "to").alias("component")), "labels")
        dropped(labels, before)
        labels = found = after
    return found


def consolidated(rows: DataFrame) -> DataFrame:
    """Rows (source, person, name) with component: people joined by a shared id, or by a name that each source gives to
    one person only; no component takes names of two persons with an external id (wd:)."""
    people = rows.select("source", "person", "name").distinct()
    sure = people.groupBy("source", "name").agg(F.count_distinct("person").alias("n"), F.min("person").alias("person")).groupBy("name").agg(
        F.max("n").alias("most"), F.count_distinct(F.when(F.col("person").startswith("wd:"), F.col("person"))).alias("known"), F.min(F.when(F.col("n") == 1, F.col("person"))).alias("first")
    )
    sure = sure.where("most = 1 AND known <= 1").select("name", "first")
    edges = people.join(sure, "name").select(F.col("person").alias("a"), F.col("first").alias("b"))
    known = components(edges)
    # A component with two external ids is not believed: its people stay apart.
    doubtful = known.groupBy("component").agg(F.count_if(F.col("node").startswith("wd:")).alias("n")).where("n > 1").select("component", F.lit(True).alias("doubtful"))
    final = known.join(doubtful, "component", "left").select(F.col("node").alias("person"), F.when(F.col("doubtful"), F.col("node")).otherwise(F.col("component")).alias("component"))
    return rows.join(final, "person", "left").withColumn("component", F.coalesce("component", "person"))


def keepers(rows: DataFrame, group: list[str]) -> DataFrame:
    """The row of each group to keep: certain, exact, corroborated, of a specific office, then by id."""
    w = Window.partitionBy(*group).orderBy("uncertain", "approximate", F.desc("corroborated"), F.desc("specific"), "id")
    return rows.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")


def duplicates(rows: DataFrame) -> DataFrame:
    """Groups of rows equal in polity, person and bounds with pairwise compatible offices: equal ones, and generic (*) ones
    where a single specific office stands beside them. Columns polity, person, from, to, role and ids."""
    key = ["polity", "person", "from", "to"]
    generic = F.col("role").startswith("*")
    w = Window.partitionBy(*key)
    offices = F.array_distinct(F.collect_list(F.when(~generic, F.col("role"))).over(w))
    placed = rows.where("`from` IS NOT NULL AND to IS NOT NULL").withColumn("__of", offices)
    role = F.when(generic, F.when(F.size("__of") == 1, F.col("__of")[0]).otherwise(F.col("role"))).otherwise(F.col("role"))
    grouped = placed.withColumn("role", role).groupBy(*key, "role").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return grouped.where(F.size("ids") > 1)


def interval_audit(rows: DataFrame) -> DataFrame:
    """Groups with equal polity and bounds: rows, and whether one person or several stand behind them."""
    found = rows.groupBy("polity", "from", "to").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("person").alias("people"))
    return found.where("rows > 1").withColumn("kind", F.when(F.col("people") == 1, "one").otherwise("several"))


def conflicts(rows: DataFrame) -> DataFrame:
    """Pairs a < b of one person, polity and explicit office whose known bounds differ and strictly overlap."""
    known = rows.where("`from` IS NOT NULL AND to IS NOT NULL AND role NOT LIKE '*%'").select("id", "polity", "person", "role", "from", "to").distinct()
    a, b = known.alias("a"), known.alias("b")
    on = " AND ".join(f"a.{c} = b.{c}" for c in ("polity", "person", "role")) + " AND a.id < b.id AND a.from < b.to AND b.from < a.to AND (a.from <> b.from OR a.to <> b.to)"
    return a.join(b, F.expr(on)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "a.person", "a.polity")


def withheld(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows without those that stand in a conflict."""
    bad = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return rows.join(bad, "id", "left_anti")


def held_incomplete(rows: DataFrame) -> DataFrame:
    """Rows with one bound, with the dated rows of the same person and polity that share it: id and peers."""
    open_ = rows.where("(`from` IS NULL) <> (to IS NULL)").alias("o")
    dated = rows.where("`from` IS NOT NULL AND to IS NOT NULL").alias("d")
    on = F.expr("o.polity = d.polity AND o.person = d.person AND coalesce(o.from = d.from, o.to = d.to)")
    return open_.join(dated, on).groupBy("o.id").agg(F.sort_array(F.collect_set("d.id")).alias("peers"))


def superseding(rows: DataFrame, replaced: DataFrame) -> DataFrame:
    """Rows after replacements (id, old): the old row of the same person and start goes. A replacement of another person or
    start, or of an ended row, raises an error."""
    new, old = rows.alias("n"), rows.alias("o")
    checked = replaced.alias("r").join(new, F.expr("r.id = n.id"), "left").join(old, F.expr("r.old = o.id"), "left")
    fine = F.expr("n.person = o.person AND n.from = o.from AND o.to IS NULL AND n.to IS NOT NULL")
    gone = checked.select(F.when(F.coalesce(fine, F.lit(False)), F.col("r.old")).otherwise(F.raise_error(F.concat(F.lit("invalid supersession of "), F.col("r.old").cast("string"))).cast("long")).alias("id"))
    return rows.join(gone, "id", "left_anti")


def redirected(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """pages (page) with target, where redirects (page, target) lead in the end; a page in a circle has none.

    Each round doubles the steps that a redirect takes; when they are as many as there are redirects, what still has
    somewhere to go runs in a circle."""
    now = written(redirects.where("page <> target").dropDuplicates(["page"]), "redirects")
    for _ in range(max(1, now.count()).bit_length()):
        ahead = now.select(F.col("page").alias("target"), F.col("target").alias("far"))
        following = written(now.join(ahead, "target", "left").select("page", F.coalesce("far", "target").alias("target")), "redirects")
        settled = following.join(now, ["page", "target"], "left_anti").isEmpty()
        dropped(now)
        now = following
        if settled:
            break
    open_ = now.select(F.col("page").alias("target"), F.lit(True).alias("circle"))
    ends = now.join(open_, "target", "left").select("page", F.when(F.col("circle").isNull(), F.col("target")).alias("target"), F.lit(True).alias("moved"))
    return pages.join(ends, "page", "left").select("page", F.when(F.col("moved"), F.col("target")).otherwise(F.col("page")).alias("target"))


def by_alias(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows (polity, name) with person, where aliases (polity, name, person) know exactly one."""
    one = aliases.groupBy("polity", "name").agg(F.count_distinct("person").alias("n"), F.min("person").alias("person")).where("n = 1").drop("n")
    return rows.join(one, ["polity", "name"], "left")


def by_suffix(short: DataFrame, full: DataFrame, least: int = 5) -> DataFrame:
    """Short names (polity, name) with the person of the only full name that ends with them as whole words.

    Full names are spread into their suffixes, so that the join is an equi-join."""
    words = F.split("name", " ")
    tails = full.select("polity", "person", F.explode(F.transform(F.sequence(F.lit(2), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))).alias("name"), F.size(words).alias("n"))
    found = tails.where((F.col("n") > 1) & (F.length("name") >= least)).groupBy("polity", "name").agg(F.count_distinct("person").alias("n"), F.min("person").alias("person"))
    return short.join(found.where("n = 1").drop("n"), ["polity", "name"], "left")


def peers(rows: DataFrame, others: DataFrame) -> DataFrame:
    """For each row (id, lineage, polity, person, name, role, from, to) the overlapping rows of other lineages that are the
    same by person, or where none is, by name; several persons behind the name mean no match. id, peer and by."""
    meets = "a.lineage <> b.lineage AND coalesce(a.from, -1000000) <= coalesce(b.to, 1000000) AND coalesce(b.from, -1000000) <= coalesce(a.to, 1000000)"
    a, b = rows.alias("a"), others.alias("b")
    pick = lambda more: F.expr(f"a.polity = b.polity AND a.role = b.role AND {more} AND {meets}")
    direct = a.join(b, pick("a.person = b.person")).select("a.id", F.col("b.id").alias("peer")).distinct()
    # Names can be frequent: whether one person is behind them is settled between the few kinds of rows (name, lineage and bounds), and
    # only rows that meet a single person then meet their peers, by person.
    kind = ["polity", "role", "name", "lineage", "from", "to"]
    told = others.groupBy(*kind).agg(F.min("person").alias("least"), F.max("person").alias("most"))
    met = rows.select(*kind).distinct().alias("a").join(told.alias("b"), pick("a.name = b.name")).groupBy(*[f"a.{c}" for c in kind]).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    same = F.expr(" AND ".join(f"a.`{c}` <=> m.`{c}`" for c in kind))
    behind = a.join(met.alias("m"), same).groupBy("a.id").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    single = behind.where("least = most").select("id", "least").join(direct.select("id").distinct(), "id", "left_anti")
    asked = rows.drop("person").join(single, "id").withColumn("person", F.explode(F.array("least", F.lit(None)))).alias("a")
    named = asked.join(b, pick("a.name = b.name AND a.person <=> b.person")).select("a.id", F.col("b.id").alias("peer")).distinct()
    return direct.withColumn("by", F.lit("person")).unionByName(named.withColumn("by", F.lit("name")))


def disposed(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """How an import (id, polity, person, role, from, to) goes: candidateDuplicate (a missing bound, with peers), conflict
    (a peer contradicts a bound), matched (a peer equals it), or import. Peers are existing rows of person, polity and role."""
    same = ["polity", "person", "role"]
    known = existing.select(*same, F.col("from").alias("f"), F.col("to").alias("t"), F.lit(True).alias("peer"))
    j = rows.join(known, same, "left")
    equal = F.col("peer") & F.col("f").eqNullSafe(F.col("from")) & F.col("t").eqNullSafe(F.col("to"))
    overlap = F.expr("peer AND f <= to AND t >= `from` AND (f <> `from` OR t <> to)")
    told = j.groupBy("id").agg(F.count("peer").alias("peers"), F.bool_or(F.coalesce(equal, F.lit(False))).alias("equal"), F.bool_or(F.coalesce(overlap, F.lit(False))).alias("against"), F.bool_or(F.expr("`from` IS NULL OR to IS NULL")).alias("open"))
    kind = F.when(F.col("open") & (F.col("peers") > 0), "candidateDuplicate").when(F.col("against"), "conflict").when(F.col("equal"), "matched").otherwise("import")
    return told.select("id", kind.alias("disposition"))


def unequal_rosters(left: DataFrame, right: DataFrame, group: str, key: str) -> DataFrame:
    """Groups whose two rosters are not the same list of keys, repeats counted: group, left_n and right_n."""
    both = left.select(group, key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(group, key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = both.groupBy(group, key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per.groupBy(group).agg(F.sum("l").alias("left_n"), F.sum("r").alias("right_n"), F.bool_or(F.col("l") != F.col("r")).alias("bad")).where("bad").drop("bad")


def first_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key in an order that the rows carry."""
    return rows.withColumn("__at", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__at = 1").drop("__at")


def repeated_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def across_phases(rows: DataFrame, year: int) -> DataFrame:
    """Rows with phase: early up to the year, late from it on; a tenure that spans it stands in both."""
    phases = F.array_compact(F.array(F.when(F.col("from") < year, "early"), F.when(F.col("to") >= year, "late")))
    return rows.withColumn("phase", F.explode(phases))
