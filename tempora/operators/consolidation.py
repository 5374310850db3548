"""Imports consolidated with each other: components that never hold two external identities, offices that go together, and routes.

Rows are claims: id, block (what polity and office make one), person (an external identity starts with wd:), source, name, from and to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import dates
from tempora.functions.names import EFFECTIVE
from tempora.operators.identity import components
from tempora.sources.derived import evenly
from tempora.sources.stores import dropped, written

#: Openings of offices that a bare monarch may stand for, heads of government, and the class of a source that names
#: whoever led.
ROYAL = (
    "emperor", "empress", "king", "queen", "sultan", "emir", "shah", "shahanshah", "caliph", "duke", "prince", "grand duke", "grand prince", "khan", "khagan", "bey", "doge",
    "apostolic king", "raja", "maharaja", "maharajadhiraja", "tsar", "yang di pertuan agong", "nevvab", "ispehbed",
)
GOVERNING = ("prime minister", "premier", "chancellor", "reich chancellor")
TENURE = ["polity", "person", "from", "to"]
LEADER, MONARCH, STATE, GOVERNMENT = "*effective", "*monarch", "*head of state", "*head of government"


def placed(rows: DataFrame) -> DataFrame:
    """Claims with node, the smallest id of those that certainly are one with it: all of its person, as long as none of these has a second
    person or block. Such a set is tried before any name and can't be refused, so that it is one from the start. first marks one row
    of each id."""
    own = F.when(F.col("person").isNotNull(), F.struct("block", "person"))
    by = Window.partitionBy("id")
    line = rows.select("id", "block", "person", "source", "name").withColumn("own", own)
    line = line.withColumns({"least": F.min("own").over(by), "most": F.max("own").over(by), "first": F.row_number().over(by.orderBy("block", "person", "source", "name")) == 1})
    line = line.withColumn("several", F.coalesce(F.col("least") != F.col("most"), F.lit(False)))
    owner = F.when(F.col("several"), F.col("own")).otherwise(F.col("least"))
    line = line.withColumns({"of_block": owner["block"], "of_person": owner["person"]}).withColumn("alone", F.when(owner.isNull(), F.col("id")))
    each = Window.partitionBy("of_block", "of_person", "alone")
    line = line.withColumns({"mixed": F.max("several").over(each), "head": F.min("id").over(each)})
    return line.withColumn("node", F.when(F.col("mixed"), F.col("id")).otherwise(F.col("head"))).select("id", "block", "person", "source", "name", "node", "mixed", "first")


def joins(claims: DataFrame) -> DataFrame:
    """Sets of placed claims that may be one, in the order in which they are tried: block, ord, id (their nodes). First all of one person,
    then all of one name that every source gives to a single person there; each by its smallest id, then by what they share. Those
    that are one already are left out."""
    people = claims.where("person IS NOT NULL AND mixed")
    of_person = people.groupBy("block", F.col("person").alias("shared")).agg(F.min("id").alias("least")).withColumn("kind", F.lit(0))
    bounds = [F.min("id").alias("least"), F.min("person").alias("one"), F.max("person").alias("other"), F.min("node").alias("lo"), F.max("node").alias("hi")]
    told = claims.where("name IS NOT NULL").groupBy("block", F.col("name").alias("shared"), "source").agg(*bounds)
    named = told.groupBy("block", "shared").agg(F.min("least").alias("least"), F.max(F.col("one") != F.col("other")).alias("several"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    named = named.where("NOT several AND lo < hi").select("block", "shared", "least", F.lit(1).alias("kind"))
    sets = of_person.select("block", "shared", "least", "kind").unionByName(named).withColumn("ord", F.struct("kind", "least", "shared"))
    member = lambda of, key, kind: of.where(F.col(key).isNotNull()).select("block", F.lit(kind).alias("kind"), F.col(key).alias("shared"), F.col("node").alias("id")).distinct()
    members = member(people, "person", 0).unionByName(member(claims, "name", 1))
    return members.join(sets.hint("merge"), ["block", "kind", "shared"]).select("block", "ord", "id")


def consolidated(rows: DataFrame) -> DataFrame:
    """Id and component of each claim, the smallest id of those that it is one with.

    Sets are joined one after another; a set that would bring two external identities together is refused as a whole, and what was
    joined before stays. Where no such set is in reach any order gives the same, so that plain components do; the others go in
    rounds: each set asks for all components that it touches, one that is the first to ask at each of them is settled, and the
    rest asks again. This is the order of one after another, as sets that touch nothing in common don't depend on each other.
    Claims of one person are a single node from the start (placed), and only nodes that some set joins with others go into rounds."""
    claims = written(placed(rows), "claims")
    sets = written(joins(claims).withColumn("set", F.xxhash64("block", "ord")), "sets")
    least = sets.groupBy("set").agg(F.min("id").alias("b"))
    plain = components(sets.join(least.hint("merge"), "set").select(F.col("id").alias("a"), "b"))
    external = F.when(F.col("person").startswith("wd:"), F.col("person"))
    known = claims.select(F.col("node").alias("id"), external.alias("wd")).distinct()
    joined = written(known.join(plain.withColumnRenamed("node", "id").hint("merge"), "id"), "placed")
    doubtful = joined.groupBy("component").agg(F.count_distinct("wd").alias("n")).where("n > 1").select("component")
    held = joined.join(doubtful, "component", "left_semi")
    labels = written(held.select("id", F.col("id").alias("at"), "wd").groupBy("id", "at").agg(F.max("wd").alias("wd")), "labels")
    pending = written(sets.join(labels.select("id"), "id", "left_semi").select("set", "ord", "block", "id"), "pending")
    dropped(sets)
    while True:
        touched = pending.join(labels.select("id", "at", "wd"), "id").groupBy("set", "ord", "block", "at").agg(F.max("wd").alias("wd"))
        sets_ = touched.groupBy("set", "ord", "block").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("wd").alias("wds"), F.min("at").alias("to"), F.max("wd").alias("wd"))
        open_ = written(sets_.where("n > 1"), "open")
        if open_.isEmpty():
            dropped(open_)
            break
        asks = written(touched.select("set", "at").join(open_.select("set", "ord"), "set"), "asks")
        first = asks.groupBy("at").agg(F.min("ord").alias("first"))
        ready = asks.join(first, "at").groupBy("set").agg(F.bool_and(F.col("ord") == F.col("first")).alias("ready")).where("ready").select("set")
        ready = written(ready, "ready")
        merged = asks.join(ready, "set").join(open_.where("wds <= 1").select("set", "to", F.col("wd").alias("new")), "set").select("at", "to", "new")
        after = labels.join(merged, "at", "left").select("id", F.coalesce("to", "at").alias("at"), F.coalesce("new", "wd").alias("wd"))
        after = written(after, "labels")
        left = written(pending.join(open_.select("set"), "set", "left_semi").join(ready, "set", "left_anti"), "pending")
        dropped(labels, pending, open_, asks, ready)
        labels, pending = after, left
    names = labels.groupBy("at").agg(F.min("id").alias("component"))
    settled = labels.join(names, "at").select("id", "component")
    rest = joined.join(doubtful, "component", "left_anti").select("id", "component").distinct()
    where = rest.unionByName(settled).select(F.col("id").alias("node"), "component")
    return claims.where("first").select("id", "node").join(where.hint("merge"), "node", "left").select("id", F.coalesce("component", "node").alias("component"))


def compatible(a: Column, b: Column) -> Column:
    """Whether two offices (see office_of) may be one: equal ones, and a general one beside what it stands for."""
    opens = lambda of, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: (of == w) | of.startswith(F.concat(w, F.lit(" "))))

    def covers(general: Column, named: Column) -> Column:
        bare = F.regexp_replace(general, r"^\*+", "")
        return (
            (general == LEADER)
            | ((general == MONARCH) & (opens(named, ROYAL) | named.isin(STATE, GOVERNMENT)))
            | ((general == STATE) & (opens(named, ROYAL) | named.startswith("president")))
            | ((general == GOVERNMENT) & (opens(named, ROYAL) | F.exists(F.array(*[F.lit(w) for w in GOVERNING]), lambda w: named.startswith(w))))
            | named.startswith(F.concat(bare, F.lit(" of "))) | named.startswith(F.concat(bare, F.lit(" in ")))
        )

    return (a == b) | covers(a, b) | covers(b, a)


def office_of(role: Column) -> Column:
    """The class of an office, * before those without a name of their own."""
    return F.when(role == EFFECTIVE, LEADER).otherwise(dates.office_class(role))


def office_groups(rows: DataFrame, equivalent: DataFrame | None = None) -> DataFrame:
    """Rows (id, polity, person, from, to, role, days) with clique: those of one polity, person and bounds (null as a value) that
    share it are the same tenure. equivalent: reviewed pairs of offices (polity, one, other).

    Offices go one by one, named ones first and then by their smallest id, into the first group whose offices they all go together
    with, or into a new one. Rows with one office always go together, so that only the few distinct offices of a tenure are
    gathered, whatever its rows. Rows with days are apart from those with other days; where some are, a row without days could be
    any of them and stays alone."""
    line = _with_days(rows)
    placed = _cliques(line, equivalent, dict(rows.dtypes)["id"])
    placed = placed.select(*TENURE, "clique", F.explode("__group").alias("__e")).select(*TENURE, "clique", F.col("__e.role").alias("role"), F.col("__e.days").alias("__days"))
    same = " AND ".join(f"l.`{k}` <=> p.`{k}`" for k in [*TENURE, "role", "__days"])
    return line.alias("l").join(placed.alias("p"), F.expr(f"{same} AND NOT l.__unsure"), "left").select(*[f"l.`{c}`" for c in rows.columns], "p.clique")


def _with_days(rows: DataFrame) -> DataFrame:
    """Rows with __days and __unsure: without days where others of the tenure have several; dealt by tenure."""
    line = evenly(rows, *TENURE)
    if "days" not in rows.columns:
        return line.withColumns({"__days": F.lit(None).cast("string"), "__unsure": F.lit(False)})
    line, w = line.withColumn("__days", F.col("days").cast("string")), Window.partitionBy(*TENURE)
    return line.withColumn("__unsure", F.coalesce(F.min("__days").over(w) != F.max("__days").over(w), F.lit(False)) & F.col("__days").isNull())


def _cliques(line: DataFrame, equivalent: DataFrame | None, id_: str, ids: bool = False) -> DataFrame:
    """Tenures with clique and __group, its distinct offices; with ids each has its rows' ids, and tenures of a single id go."""
    key = TENURE
    told = F.collect_set("id") if ids else F.array().cast(f"array<{id_}>")
    kinds = line.where("NOT __unsure").groupBy(*key, "role", "__days").agg(F.min("id").alias("least"), *([told.alias("ids")] if ids else []))
    kinds = kinds if ids else kinds.withColumn("ids", told)
    pairs = F.array().cast("array<struct<one:string,other:string>>")
    # A role's class takes long to tell and is asked only where a tenure has several.
    several = F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1
    kinds = kinds.withColumn("__several", several).withColumn("__office", F.when(F.col("__several"), office_of(F.col("role"))))
    office = F.struct(F.col("__office").startswith("*").alias("general"), "least", "role", F.col("__office").alias("office"), F.col("__days").alias("days"), "ids")
    entries = kinds.groupBy(*key).agg(F.array_sort(F.collect_list(office)).alias("__all"))
    if ids:
        entries = entries.where((F.size("__all") > 1) | (F.size(F.col("__all")[0]["ids"]) > 1))
    if equivalent is not None:
        told = equivalent.groupBy("polity").agg(F.collect_set(F.struct("one", "other")).alias("__pairs"))
        entries = entries.join(told, "polity", "left").withColumn("__pairs", F.coalesce("__pairs", pairs))
    else:
        entries = entries.withColumn("__pairs", pairs)

    def together(e: Column, x: Column) -> Column:
        reviewed = F.exists("__pairs", lambda p: ((p["one"] == e["role"]) & (p["other"] == x["role"])) | ((p["one"] == x["role"]) & (p["other"] == e["role"])))
        apart = F.coalesce(e["days"] != x["days"], F.lit(False))
        return (compatible(e["office"], x["office"]) | reviewed) & ~apart

    def put(groups: Column, x: Column) -> Column:
        fits = F.transform(groups, lambda g: F.forall(g, lambda e: together(e, x)))
        return F.transform(F.array(F.array_position(fits, F.lit(True))), lambda at: F.when(at == 0, F.concat(groups, F.array(F.array(x)))).otherwise(F.transform(groups, lambda g, i: F.when(i + 1 == at, F.concat(g, F.array(x))).otherwise(g))))[0]

    entry = "struct<general:boolean,least:{id},role:string,office:string,days:string,ids:array<{id}>>".format(id=id_)
    one = F.size("__all") == 1
    groups = F.when(one, F.array("__all")).otherwise(F.aggregate("__all", F.array().cast(f"array<array<{entry}>>"), put))
    return entries.select(*key, F.posexplode(groups).alias("clique", "__group"))


def merges(rows: DataFrame, equivalent: DataFrame | None = None) -> DataFrame:
    """Tenures that several rows tell: polity, person, from, to, clique and ids."""
    line = _with_days(rows.where("`from` IS NOT NULL AND to IS NOT NULL"))
    placed = _cliques(line, equivalent, dict(rows.dtypes)["id"], ids=True)
    ids = F.sort_array(F.array_distinct(F.flatten(F.transform("__group", lambda e: e["ids"]))))
    return placed.select(*TENURE, "clique", ids.alias("ids")).where(F.size("ids") > 1)


def routed(rows: DataFrame, peers: DataFrame) -> DataFrame:
    """Id, route and existing of each import (id, component, valid, precision, from, to, ambiguous, external), against what is
    there and against the other imports.

    peers (id, peer, from, to, precision): rows already there of the same person and office. In this order: rejected; candidateDuplicate
    (a bound is missing and there are peers); conflict (a peer gives another year); matched (a peer says just the same: checks_only
    if its years stand already); duplicate (its years stand already); candidateDuplicate (its name has several persons); import.

    Imports and matched rows that are no checks then meet the others of their component: those without a bound beside dated ones
    are candidateDuplicates, those that overlap others with other years are conflicts, and of equal ones the first stays (matched
    before imported, external identities first, then by id) and the others are its duplicates. Nothing is compared pairwise: a
    tenure overlaps another if one of those that begin before it ends after its start, or one begins before its end."""
    told = peers.select("id", "peer", *[F.col(c).alias(f"p_{c}") for c in ("from", "to", "precision")])
    line = rows.join(told, "id", "left")
    differs = lambda c: F.coalesce(F.col(c) != F.col(f"p_{c}"), F.lit(False))
    there = F.col("peer").isNotNull() & F.col("from").eqNullSafe(F.col("p_from")) & F.col("to").eqNullSafe(F.col("p_to"))
    seen = line.groupBy(*rows.columns).agg(
        F.count("peer").alias("n"), F.bool_or(differs("from") | differs("to")).alias("against"), F.bool_or(there).alias("there"),
        F.bool_or(there & (F.col("precision") == F.col("p_precision"))).alias("same"), F.sort_array(F.collect_set(F.when(there, F.col("peer").cast("string")))).alias("existing"),
    )
    open_ = F.col("from").isNull() | F.col("to").isNull()
    first = (
        F.when(~F.col("valid"), "rejected").when(open_ & (F.col("n") > 0), "candidateDuplicate").when(F.col("against"), "conflict")
        .when(F.coalesce("same", F.lit(False)), "matched").when(F.coalesce("there", F.lit(False)), "duplicate").when(F.col("ambiguous"), "candidateDuplicate").otherwise("import")
    )
    seen = written(seen.withColumns({"route": first, "checks_only": (first == "matched") & F.coalesce("there", F.lit(False))}), "routes")
    live = seen.where("route = 'import' OR (route = 'matched' AND NOT checks_only)")

    dated = live.where("`from` IS NOT NULL AND to IS NOT NULL").select("component", "from", "to").distinct()
    by = Window.partitionBy("component").orderBy("from", "to")
    before, behind = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    long = F.col("from") < F.col("to")
    meets = (long & (F.max("to").over(before) > F.col("from"))) | (F.min(F.when(long, F.col("from"))).over(behind) < F.col("to")) | (F.count(F.lit(1)).over(Window.partitionBy("component", "from")) > 1)
    clashes = dated.withColumn("clash", F.coalesce(meets, F.lit(False))).where("clash")
    some = dated.select("component").distinct().withColumn("dated", F.lit(True))
    met = live.join(clashes, ["component", "from", "to"], "left").join(some, "component", "left")
    order = [F.col("route") != "matched", ~F.col("external"), F.col("id")]
    w = Window.partitionBy("component", "from", "to", "precision").orderBy(*order)
    met = met.withColumn("keeper", F.first("id").over(w))
    second = F.when(open_ & F.col("dated"), "candidateDuplicate").when(F.col("clash"), "conflict").when(~open_ & (F.col("keeper") != F.col("id")), "duplicate").otherwise(F.col("route"))
    after = met.select("id", second.alias("again"), F.when(second == "duplicate", F.array(F.col("keeper").cast("string"))).alias("keepers"))
    out = seen.join(after, "id", "left")
    return out.select("id", F.coalesce("again", "route").alias("route"), F.coalesce("keepers", "existing").alias("existing"), "checks_only")
