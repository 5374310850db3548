"""Pages as an outline: headings, list items, paragraphs, tables and infobox rows with the headings they stand under, their text
and links; and the records of office holders that lists and tables give.

One pass over a page with the standard parser, in Arrow batches; what a row means is decided by column functions afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import dates
from tempora.sources.adapters import table_rows

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = ("h2", "h3", "h4")
#: Classes whose content is no text of the page.
HIDDEN = re.compile(r"\b(?:reference|sortkey|mw-editsection|noprint)\b")
_LINK = pa.struct([("href", pa.string()), ("text", pa.string()), ("bold", pa.bool_())])
_BLOCK = pa.schema([("key", pa.int64()), ("ord", pa.int32()), ("kind", pa.string()), ("section", pa.list_(pa.string())), ("depth", pa.int32()), ("parent", pa.int32()), ("text", pa.string()), ("links", pa.list_(_LINK))])
OUTLINE = "key long, ord int, kind string, section array<string>, depth int, parent int, text string, links array<struct<href:string,text:string,bold:boolean>>"


class _Outline(HTMLParser):
    """Blocks (kind, section, depth, parent, text, links) of a page in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.open: list[dict] = []  # blocks that take text, innermost last
        self.tags: list[tuple[str, bool]] = []
        self.heads: list[str | None] = [None] * len(HEADINGS)
        self.bold = self.hidden = 0
        self.link: dict | None = None

    def start(self, kind: str) -> None:
        parent = next((b["ord"] for b in reversed(self.open) if b["kind"] == "li"), None)
        block = {"ord": len(self.blocks), "kind": kind, "section": [h for h in self.heads if h], "depth": sum(b["kind"] == "li" for b in self.open), "parent": parent, "text": [], "links": []}
        self.blocks.append(block)
        self.open.append(block)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in VOID:
            if self.open and tag == "br":
                self.open[-1]["text"].append(" ")
            return
        hides = bool(HIDDEN.search(given.get("class") or "")) or "display:none" in (given.get("style") or "").replace(" ", "") or tag in ("script", "style")
        if tag in ("li", "p"):  # ends the one before it in the same list, or the open paragraph
            since = [t for t, _ in self.tags]
            lists = [i for i, t in enumerate(since) if t in ("ul", "ol")]
            if tag in since[lists[-1] if lists else 0 :]:
                self.handle_endtag(tag)
        self.tags.append((tag, hides))
        self.hidden += hides
        if tag in HEADINGS or tag in ("li", "p", "caption", "table"):
            self.start("heading" if tag in HEADINGS else tag)
        elif tag in ("b", "strong", "th"):
            self.bold += 1
        elif tag == "a" and given.get("href") and self.open and not self.hidden:
            self.link = {"href": given["href"], "text": [], "bold": self.bold > 0}
            self.open[-1]["links"].append(self.link)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not any(t == tag for t, _ in self.tags):
            return
        while True:
            was, hides = self.tags.pop()
            self.hidden -= hides
            if was in ("b", "strong", "th"):
                self.bold -= 1
            elif was == "a":
                self.link = None
            elif was in HEADINGS or was in ("li", "p", "caption", "table"):
                kind = "heading" if was in HEADINGS else was
                if any(b["kind"] == kind for b in self.open):
                    while self.open.pop()["kind"] != kind:
                        pass
                if was in HEADINGS and self.blocks:
                    level = HEADINGS.index(was)
                    block = next(b for b in reversed(self.blocks) if b["kind"] == "heading")
                    self.heads[level:] = [" ".join("".join(block["text"]).split()), *[None] * (len(HEADINGS) - level - 1)]
            if was == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.hidden or not self.open:
            return
        self.open[-1]["text"].append(data)
        if self.link is not None:
            self.link["text"].append(data)


def parsed(page: str) -> list[dict]:
    parser = _Outline()
    parser.feed(page)
    parser.close()
    tidy = lambda parts: " ".join("".join(parts).split())
    return [dict(b, text=tidy(b["text"]), links=[dict(x, text=tidy(x["text"])) for x in b["links"]]) for b in parser.blocks]


def outline(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Key, ord, kind, section (headings above it, outermost first), depth and parent of list items, text and links of each
    block. A list item's text is its own, without the lists inside it; references, sort keys and hidden nodes are left out. A null page
    has no blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [dict(b, key=k) for b in parsed(page or "")]
                if found:
                    yield pa.RecordBatch.from_pylist(found, _BLOCK)

    return pages.select(F.col(key).cast("long"), F.col(html).cast("string")).mapInArrow(run, OUTLINE).withColumnRenamed("key", key)


def person_link(links: Column, ranks: str = r"(?i)\b(?:king|queen|emperor|list of|dynasty|house of|prime minister|president)\b") -> Column:
    """The link that names a person: the first bold one, else the first, of those that name no rank or list; null without one."""
    own = F.filter(links, lambda x: (x["text"] != "") & ~x["text"].rlike(ranks) & ~x["href"].rlike(r"^#|(?i)(?:file|category|help):"))
    return F.coalesce(F.get(F.filter(own, lambda x: x["bold"]), F.lit(0)), F.get(own, F.lit(0)))


def unlinked_name(text: Column) -> Column:
    """What stands before the date of a line, without marks at its end."""
    name = F.regexp_extract(text, r"^([^\d\s].+?)[\s,;:(–—-]+(?:c\.\s*)?\d{1,4}\b", 1)
    return F.when(F.trim(name) != "", F.trim(name))


def list_records(blocks: DataFrame, key: str) -> DataFrame:
    """List items with exactly one range of years: key, ord, section, name, href, f, t, precision. The range stands in parentheses
    or after the name; an item without a name, or with several ranges, is none."""
    inside = F.regexp_extract_all("text", F.lit(r"\(([^()]*\d[^()]*)\)"), F.lit(1))
    after = F.regexp_extract_all("text", F.lit(r"((?:c\.\s*)?\d{1,4}(?:\s*(?:BCE?|AD|CE))?\s*[–—-]\s*(?:c\.\s*)?\d{1,4}(?:\s*(?:BCE?|AD|CE))?)"), F.lit(1))
    told = F.array_compact(F.transform(F.when(F.size(inside) > 0, inside).otherwise(after), lambda x: dates.date_range(x)))
    line = blocks.where("kind = 'li'").withColumn("ranges", told).where(F.size("ranges") == 1)
    who = person_link(F.col("links"))
    name = F.coalesce(who["text"], unlinked_name(F.col("text")))
    found = line.select(key, "ord", "section", name.alias("name"), who["href"].alias("href"), F.col("ranges")[0]["from"].alias("f"), F.col("ranges")[0]["to"].alias("t"), F.col("ranges")[0]["precision"].alias("precision"))
    return found.where("name IS NOT NULL").where(~dates.names_nobody(F.col("name")))


def nested_records(blocks: DataFrame, key: str) -> DataFrame:
    """Items of a list inside an item that names an office, under a heading that names the jurisdiction; each tenure of an item's
    comma list is a row: key, jurisdiction, office, name, episode, f, t."""
    items = blocks.where("kind = 'li'")
    offices = items.select(key, F.col("ord").alias("parent"), F.regexp_replace("text", r":\s*$", "").alias("office"))
    name = F.trim(F.regexp_extract("text", r"^([^(]*?)\s*\(", 1))
    inside = F.regexp_extract("text", r"\(([^()]*)\)\s*$", 1)
    line = items.where("parent IS NOT NULL").withColumns({"name": name, "inside": inside}).where("name <> '' AND inside <> ''").join(offices, [key, "parent"])
    told = line.select(key, F.element_at("section", -1).alias("jurisdiction"), "office", "name", F.explode(dates.episodes(F.col("inside"))).alias("e"))
    return told.where("jurisdiction IS NOT NULL").select(key, "jurisdiction", "office", "name", F.col("e.episode").alias("episode"), F.col("e.from").alias("f"), F.col("e.to").alias("t"))


#: Words that tell what a column of a table holds.
REIGN = r"(?i)\b(?:reign(?:ed)?|term|in office|tenure|ruled|years|dates)\b"
NO_REIGN = r"(?i)\b(?:birth|born|death|died|dynasty|length|duration|number|era name)\b"
NAME = r"(?i)\b(?:name|monarch|king|queen|ruler|emperor|sultan|president|governor|prime minister|officeholder)\b"
NO_NAME = r"(?i)\b(?:family|portrait|image|dynasty|house|vice|from|until|spouse)\b"
HEADER_ROWS = 8


def table_records(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Rows of tables with a name and a reign column: key, table, row, name, f, t, precision and skipped, the reason why a row
    is no record (placeholder, label or undated). The header is the first of eight rows that has both columns."""
    rows = table_rows(pages, key, html)
    position = lambda yes, no: F.array_position(F.transform("cells", lambda c: c.rlike(yes) & ~c.rlike(no) & ~c.rlike(r"\d") & (F.length(c) <= 40)), True)
    heads = rows.where(F.col("row") < HEADER_ROWS).withColumns({"name_at": position(NAME, NO_NAME), "reign_at": position(REIGN, NO_REIGN)}).where("name_at > 0 AND reign_at > 0")
    first = heads.groupBy(key, "table").agg(F.min(F.struct("row", "name_at", "reign_at")).alias("h"))
    cell = lambda at: F.trim(F.try_element_at("cells", F.col(at).cast("int")))
    body = rows.join(first, [key, "table"]).where("row > h.row").withColumns({"name": F.lit(""), "name_at": F.col("h.name_at"), "reign_at": F.col("h.reign_at")})
    body = body.withColumns({"name": cell("name_at"), "reign": cell("reign_at")}).withColumn("r", dates.date_range(F.col("reign")))
    label = F.size(F.array_distinct("cells")) == 1
    skipped = F.when(label, "label").when((F.col("name") == "") | F.col("name").isNull() | dates.names_nobody(F.col("name")), "placeholder").when(F.col("r").isNull(), "undated")
    return body.select(key, "table", "row", "name", F.col("r.from").alias("f"), F.col("r.to").alias("t"), "r.precision", skipped.alias("skipped"))


def infobox_records(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Dated rows of two-column tables, whose label before them names the office: key, table, row, office, name, f, t. A name that
    joins two people is none."""
    rows = table_rows(pages, key, html).where(F.size("cells").between(1, 2))
    label = (F.size("cells") == 1) | (F.get("cells", 0) == F.get("cells", 1))
    office = F.last(F.when(label, F.get("cells", 0)), ignorenulls=True).over(Window.partitionBy(key, "table").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    line = rows.withColumns({"office": office, "label": label}).where(~F.col("label") & F.col("office").isNotNull())
    told = line.withColumn("r", dates.date_range(F.get("cells", 0))).where("r IS NOT NULL").withColumn("name", F.trim(F.get("cells", 1)))
    return told.where((F.col("name") != "") & ~F.col("name").rlike(r"(?i)\s(?:and|&)\s")).select(key, "table", "row", "office", "name", F.col("r.from").alias("f"), F.col("r.to").alias("t"))


def linked_targets(blocks: DataFrame, key: str, titles: DataFrame, generic: tuple[str, ...] = ("list", "of", "the", "rulers", "kings", "monarchs", "and")) -> DataFrame:
    """Links whose text shares a word that is not generic with the title of their page (key, title): key, href, scope, the part after #."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*generic))
    line = blocks.select(key, F.explode("links").alias("x")).join(titles, key)
    kept = line.where(F.arrays_overlap(words(F.col("x.text")), words(F.col("title"))) & ~F.col("x.href").startswith("#"))
    parts = F.split(F.col("x.href"), "#")
    return kept.select(key, F.get(parts, 0).alias("href"), F.get(parts, 1).alias("scope")).distinct()
