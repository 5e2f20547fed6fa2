"""Structure-aware sections of parsed documents: gaps and islands over a preorder list of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import collapse, content_hash, present, stable_id, trim

#: A parsed document; heading nodes' descendants aren't listed.
PARSED = (
    "doc_id string, text string,"
    " pages array<struct<page_num:int,text:string,text_items:array<struct<mcid:bigint,text:string>>>>,"
    " nodes array<struct<seq:int,depth:int,type:string,actual_text:string,mcids:array<bigint>>>"
)


def marked_content(parsed: DataFrame, by_page: bool = False) -> DataFrame:
    """(doc_id, mcid, text, page[, at_page]): texts of an id joined in order, and the page where it is first seen.

    Ids hold for a whole document, as some writers reuse them on later pages; ``by_page`` keeps pages apart.
    """
    pages = parsed.select("doc_id", F.posexplode("pages").alias("p", "page"))
    items = pages.select("doc_id", "p", F.coalesce("page.page_num", F.lit(1)).alias("page"), F.posexplode("page.text_items").alias("i", "item"))
    items = items.select("doc_id", "p", "i", "page", F.col("item.mcid").alias("mcid"), F.col("item.text").alias("text")).where(F.col("mcid").isNotNull() & present(F.col("text")))
    keys = ["doc_id", "mcid", *(["page"] if by_page else [])]
    ordered = F.array_sort(F.collect_list(F.struct("p", "i", "text")))
    return items.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), *([] if by_page else [F.min_by("page", F.struct("p", "i")).alias("page")]))


def nodes_with_text(parsed: DataFrame) -> DataFrame:
    """(doc_id, seq, depth, level, heading, text, page): page is that of the first id with one, null without.

    Text items, references to them and the nodes themselves go in one list, which is exploded and dealt by document
    once: what meets by marked-content id, then by node, then in the windows of ``section_parents`` stays in its task.
    """
    kind = "struct<mcid:bigint,p:int,i:int,page:int,text:string,seq:int,at:int,depth:int,type:string,actual_text:string>"
    entry = lambda **values: F.struct(*[values.get(f.split(":")[0], F.lit(None).cast(f.split(":")[1])).cast(f.split(":")[1]).alias(f.split(":")[0]) for f in kind[7:-1].split(",")])
    none = F.array().cast(f"array<{kind}>")
    listed = lambda column, make: F.coalesce(F.transform(column, make), none)
    items = F.flatten(F.coalesce(F.transform("pages", lambda page, p: listed(page["text_items"], lambda x, i: entry(mcid=x["mcid"], p=p, i=i, page=F.coalesce(page["page_num"], F.lit(1)), text=x["text"]))), F.array(none)))
    references = F.flatten(F.coalesce(F.transform("nodes", lambda n: listed(n["mcids"], lambda m, at: entry(mcid=m, seq=n["seq"], at=at))), F.array(none)))
    nodes = listed("nodes", lambda n: entry(seq=n["seq"], at=F.lit(-1), depth=F.coalesce(n["depth"], F.lit(0)), type=n["type"], actual_text=n["actual_text"]))
    rows = parsed.select("doc_id", F.explode(F.concat(items, F.filter(references, lambda r: r["mcid"].isNotNull()), nodes)).alias("e")).select("doc_id", "e.*")
    rows = rows.where("seq IS NOT NULL OR (mcid IS NOT NULL AND text <> '')").repartition("doc_id")
    item = F.when(F.col("seq").isNull(), F.struct("p", "i", "text", "page"))
    asked = F.when(F.col("seq").isNotNull(), F.struct("seq", "at", "depth", "type", "actual_text"))
    by_id = rows.groupBy("doc_id", "mcid").agg(F.array_sort(F.collect_list(item)).alias("items"), F.collect_list(asked).alias("asked"))
    found = by_id.select("doc_id", F.explode("asked").alias("n"), F.array_join(F.col("items.text"), " ").alias("piece"), F.try_element_at("items", F.lit(1))["page"].alias("page"))
    ordered = F.array_sort(F.collect_list(F.when((F.col("n.at") >= 0) & (F.col("piece") != ""), F.struct("n.at", "piece"))))
    first = F.min_by("page", F.when(F.col("page") != 0, F.col("n.at")))
    whole = found.groupBy("doc_id", F.col("n.seq").alias("seq")).agg(F.max("n.depth").alias("depth"), F.max("n.type").alias("type"), F.max("n.actual_text").alias("actual_text"), F.array_join(F.transform(ordered, lambda x: x["piece"]), " ").alias("pieces"), first.alias("page"))
    text = trim(collapse(F.concat_ws(" ", F.nullif("actual_text", F.lit("")), F.nullif("pieces", F.lit("")))))
    level = F.nullif(F.regexp_extract(F.upper(F.coalesce("type", F.lit(""))), "^H([1-6])$", 1), F.lit("")).cast("int")
    return whole.select("doc_id", "seq", "depth", level.alias("level"), trim(collapse(F.coalesce("actual_text", text))).alias("heading"), text.alias("text"), "page")


def _parent_columns(index: Column, text: Column, start: Column, end: Column) -> list[Column]:
    return [stable_id(F.col("doc_id"), index, content_hash(text)).alias("id"), F.col("doc_id").alias("document_id"), index.cast("int").alias("index"), text.alias("text"), content_hash(text).alias("content_hash"), start.cast("int").alias("start_page"), end.cast("int").alias("end_page")]


def section_parents(parsed: DataFrame, with_path: bool = False) -> DataFrame:
    """Sections that begin at a heading of level 1, or at a document's first heading of any level.

    What stands before the first heading is left out, as is the starting heading's own text; deeper headings stand in
    the text with one # for each level.  Sections without text aren't given, and indexes count those that are.

    Pages: a section starts on its heading's page; without one, on page 1 at the root, else where the section before
    ended.  So starts with a page of their own or at the root open an island, and a running maximum inside it gives the
    others.  It ends on the last page that its start or its texts name.

    ``with_path`` adds section_path: the starting heading, and after it the last heading of each level inside; a heading
    of level n ends the path at n - 1, and skipped levels aren't filled in.
    """
    in_doc = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = nodes_with_text(parsed).withColumn("headings", F.count("level").over(in_doc))
    starts = F.col("level").isNotNull() & ((F.col("level") == 1) | (F.col("headings") == 1))
    rows = rows.withColumn("starts", starts).withColumn("parent_no", F.sum(starts.cast("int")).over(in_doc)).where("parent_no > 0")
    anchor = F.coalesce("page", F.when((F.col("depth") == 0) | (F.col("parent_no") == 1), F.lit(1)))
    rows = rows.withColumn("own_page", F.when(F.col("starts"), anchor).when(F.col("level").isNull() & (F.col("text") != ""), F.col("page")))
    rows = rows.withColumn("island", F.sum((F.col("starts") & anchor.isNotNull()).cast("int")).over(in_doc))
    in_island = Window.partitionBy("doc_id", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("reached", F.max("own_page").over(in_island))
    block = F.when(F.col("starts"), None).when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "heading")).otherwise(F.nullif("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.when(block.isNotNull(), F.struct("seq", block.alias("block")))))
    headings = F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("seq", F.when(F.col("starts"), 1).otherwise(F.col("level")).alias("level"), "heading"))))
    path = F.aggregate(headings, F.array().cast("array<string>"), lambda held, h: F.concat(F.slice(held, F.lit(1), h["level"] - 1), F.array(h["heading"])))
    made = rows.groupBy("doc_id", "parent_no").agg(trim(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n")).alias("text"), F.max(F.when(F.col("starts"), F.col("reached"))).alias("start"), F.max("reached").alias("end"), *([path.alias("section_path")] if with_path else []))
    made = made.where("text <> ''").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("parent_no")) - 1)
    return made.select(*_parent_columns(F.col("n"), F.col("text"), F.col("start"), F.col("end")), *(["section_path"] if with_path else []))


def fallback_parents(parsed: DataFrame) -> DataFrame:
    """One section for each page with text; the index is the page's place, so there may be gaps."""
    pages = parsed.select("doc_id", F.posexplode("pages").alias("place", "page"))
    number = F.coalesce("page.page_num", F.col("place") + 1)
    rows = pages.select("doc_id", "place", trim(F.coalesce("page.text", F.lit(""))).alias("text"), number.alias("number")).where("text <> ''")
    return rows.select(*_parent_columns(F.col("place"), F.col("text"), F.col("number"), F.col("number")))


def logical_parents(parsed: DataFrame) -> DataFrame:
    """Sections, and pages for the documents that have none."""
    both = section_parents(parsed).withColumn("section", F.lit(True)).unionByName(fallback_parents(parsed).withColumn("section", F.lit(False)))
    return both.withColumn("any", F.max("section").over(Window.partitionBy("document_id"))).where(F.col("section") == F.col("any")).drop("section", "any")
