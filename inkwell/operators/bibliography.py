"""Citations, entries and the inlined bibliography, as joins and ordered aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, cited_keys, format_entry


def citation_order(docs: DataFrame, content: str = "content") -> DataFrame:
    """doc_id, key and ord (from 1) of the distinct keys, by first citation."""
    return _in_order(docs.select("doc_id", cited_keys(F.col(content)).alias("keys")))


def _in_order(keys: DataFrame) -> DataFrame:
    # The array has the order already, so no rows need to be grouped or sorted for it.
    return keys.select("doc_id", F.posexplode(F.array_distinct("keys")).alias("pos", "key")).select("doc_id", "key", (F.col("pos") + 1).alias("ord"))


def last_entries(entries: DataFrame, by: list[str]) -> DataFrame:
    """One entry for each key: of several, that of the last file, and there the last."""
    last = entries.groupBy(*by, "key").agg(F.max_by(F.struct("kind", "fields"), F.struct("file_ord", "entry_no")).alias("e"))
    return last.select(*by, "key", "e.kind", "e.fields")


def chosen_entries(citations: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of the cited keys in their order; ``\\nocite{*}`` (key ``*``) adds the
    others by key.  Unknown keys have no entry.  ``entries`` without a doc_id belong to
    all documents alike; of those, ``\\nocite{*}`` adds none."""
    if "doc_id" not in entries.columns:
        return citations.select("doc_id", "key", F.col("ord").alias("place")).join(entries, "key")
    cited = entries.join(citations.select("doc_id", "key", F.struct(F.lit(0).alias("late"), F.col("ord"), F.lit("").alias("name")).alias("place")), ["doc_id", "key"])
    everything = citations.where("key = '*'").select("doc_id").distinct()
    rest = entries.join(everything, "doc_id", "left_semi").join(citations, ["doc_id", "key"], "left_anti")
    return cited.unionByName(rest.withColumn("place", F.struct(F.lit(1).alias("late"), F.lit(0).alias("ord"), F.col("key").alias("name"))))


def with_item(entries: DataFrame) -> DataFrame:
    """``entries`` with their ``item`` of a block in place of kind and fields."""
    item = F.concat(F.lit("\\bibitem{"), "key", F.lit("}\n"), format_entry(F.col("fields"), F.col("kind")), F.lit("\n\n"))
    return entries.withColumn("item", item).drop("kind", "fields")


def thebibliography(chosen: DataFrame) -> DataFrame:
    """doc_id and the block assembled of items (doc_id, place, item)."""
    made = chosen.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["item"]), "")
    return made.select("doc_id", F.concat(F.lit("\\begin{thebibliography}{"), F.size("items"), F.lit("}\n\n"), body, F.lit("\\end{thebibliography}")).alias("block"))


_COMMAND = r"\\(?:bibliography|addbibresource)\{[^}]+\}"


def inline_block(content: Column, block: Column) -> Column:
    """The block in place of the first bibliography command; further ones and the
    style line go.  A null block leaves the text alone."""
    plain = F.regexp_replace(content, r"\\bibliographystyle\{[^}]+\}\s*\n?", "")
    whole = lambda rest: F.concat(rest[0], block, F.array_join(F.slice(rest, 2, F.size(rest)), ""))
    made = bound(F.split(plain, _COMMAND, -1), lambda rest: F.when(F.size(rest) > 1, whole(rest)))
    return F.when(block.isNull(), content).otherwise(F.coalesce(made, content))


def inline_bibliography(docs: DataFrame, entries: DataFrame, bbl: DataFrame | None = None) -> DataFrame:
    """``docs`` (doc_id, content) with the bibliography inlined.

    ``entries``: file_ord, entry_no, key, kind, fields, and doc_id where they belong to one
    document.  ``bbl``: doc_id, priority,
    content; the first one there is taken as it is, and its document's entries are not
    read.  Documents with neither stay as they are.
    """
    blocks = bibliography_blocks(docs, entries, bbl)
    return docs.join(blocks, "doc_id", "left").withColumn("content", inline_block(F.col("content"), F.col("block"))).drop("block")


def wanted_keys(content: Column) -> Column:
    """The citation keys of a text that has a bibliography command; null for others."""
    return F.when(content.rlike(_COMMAND), cited_keys(content))


def bibliography_blocks(docs: DataFrame, entries: DataFrame, bbl: DataFrame | None = None) -> DataFrame:
    """doc_id and the block of every document that has a bibliography command; see
    ``inline_bibliography``."""
    return blocks_of(docs.select("doc_id", wanted_keys(F.col("content")).alias("keys")), entries, bbl)


def blocks_of(keys: DataFrame, entries: DataFrame, bbl: DataFrame | None = None) -> DataFrame:
    """``bibliography_blocks`` of documents whose keys are known (doc_id, keys, as of
    ``wanted_keys``), without their texts."""
    used = keys  # no row comes of null keys; a filter would read each text once more
    if bbl is not None:
        ready = bbl.where("content IS NOT NULL").groupBy("doc_id").agg(F.min_by("content", "priority").alias("block"))
        used = used.join(ready, "doc_id", "left_anti")
    if "doc_id" in entries.columns:
        made = with_item(chosen_entries(_in_order(used), last_entries(entries, ["doc_id"])))
    else:  # an entry that all documents may cite is written once, not for each of them
        made = chosen_entries(_in_order(used), with_item(last_entries(entries, [])))
    made = thebibliography(made)
    return made if bbl is None else made.unionByName(ready)


def resolve_bibs(wanted: DataFrame, files: DataFrame, folders: list[str]) -> DataFrame:
    """doc_id, file_ord, name and the first path in ``folders`` that has the file
    (null: missing).  ``wanted``: doc_id, names (comma list); ``files``: path, and
    doc_id where a file belongs to one document."""
    names = wanted.select("doc_id", F.posexplode(F.split("names", r"\s*,\s*")).alias("file_ord", "name"))
    name = F.when(F.col("name").endswith(".bib"), F.col("name")).otherwise(F.concat("name", F.lit(".bib")))
    tries = names.withColumn("name", F.trim(name)).select("*", F.posexplode(F.array(*[F.concat(F.lit(f"{f}/" if f else ""), "name") for f in folders])).alias("priority", "path"))
    own = "doc_id" in files.columns
    there = files.select(F.col("path").alias("found"), *[F.col("doc_id").alias("of")] * own)
    hit = tries.join(there, (F.col("path") == F.col("found")) & (F.col("doc_id") == F.col("of") if own else F.lit(True)), "left")
    return hit.groupBy("doc_id", "file_ord", "name").agg(F.min_by("found", F.when(F.col("found").isNotNull(), F.col("priority"))).alias("path"))
