"""The structure graph of a corpus as tables of nodes and edges, keyed by document.

nodes: doc_id, id, type and attributes that depend on it; edges: doc_id, source, target, relation, similarity.
Ids are ``section:<path>``, ``chunk:<index>`` and ``page:<number>``.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.operators.vectors import nearest
from docgraph.sources.shared import discard, stored


def chunk_node(index: Column) -> Column:
    return F.concat(F.lit("chunk:"), index.cast("string"))


def node_number(node: Column) -> Column:
    """The number in a chunk's or page's node id."""
    return F.regexp_extract(node, r":(\d+)$", 1).cast("int")


def section_nodes(headers: DataFrame) -> DataFrame:
    """Every path and all its ancestors, once; a path's last header gives its attributes.

    An ancestor without a header takes level and line of the first header of its title, else a level by its depth and line 0.
    """
    parts = F.split("section_path", " > ", -1)
    prefixes = headers.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " > "))).alias("section_path")).distinct()
    own = headers.groupBy("doc_id", "section_path").agg(F.max_by(F.struct("title", "level", F.col("line").alias("start_line")), "line").alias("own"))
    of_title = headers.groupBy("doc_id", "title").agg(F.min_by(F.struct("level", F.col("line").alias("start_line")), "line").alias("like"))
    last = F.element_at(F.split("section_path", " > ", -1), -1)
    made = prefixes.join(own, ["doc_id", "section_path"], "left").withColumn("title", F.coalesce("own.title", last)).join(of_title, ["doc_id", "title"], "left")
    return made.select(
        "doc_id", F.concat(F.lit("section:"), "section_path").alias("id"), F.lit("section").alias("type"), "section_path", F.col("title").alias("section_title"),
        F.coalesce("own.level", "like.level", F.size(F.split("section_path", " > ", -1)) + 1).alias("level"), F.coalesce("own.start_line", "like.start_line", F.lit(0)).alias("start_line"),
    )


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", chunk_node(F.col("chunk_index")).alias("id"), F.lit("chunk").alias("type"), F.col("chunk_index").alias("chunk_id"), "section_path", "heading")


def page_nodes(chunks: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Pages above 0 that chunks lie on, with a classification where (doc_id, page_number, classification) has one."""
    pages = chunks.where("page_number > 0").select("doc_id", "page_number").distinct()
    pages = pages.join(classes, ["doc_id", "page_number"], "left") if classes is not None else pages.withColumn("classification", F.lit(None).cast("string"))
    return pages.select("doc_id", F.concat(F.lit("page:"), F.col("page_number")).alias("id"), F.lit("page").alias("type"), "page_number", "classification")


def all_nodes(*parts: DataFrame) -> DataFrame:
    """One wide table; what a type lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _edges(df: DataFrame, source: Column, target: Column, relation: str) -> DataFrame:
    return df.select("doc_id", source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(None).cast("double").alias("similarity"))


def section_edges(nodes: DataFrame) -> DataFrame:
    """Parent to child section, where the parent is a node."""
    sections = nodes.where("type = 'section'")
    parts = F.split("section_path", " > ", -1)
    children = sections.where(F.size(parts) > 1).select("doc_id", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " > ").alias("parent"), "id")
    known = children.join(sections.select("doc_id", F.col("section_path").alias("parent")), ["doc_id", "parent"], "left_semi")
    return _edges(known, F.concat(F.lit("section:"), "parent"), F.col("id"), "contains_section")


def containment_edges(chunks: DataFrame) -> DataFrame:
    """Section to chunk and back."""
    section, chunk = F.concat(F.lit("section:"), F.col("section_path")), chunk_node(F.col("chunk_index"))
    own = chunks.where("section_path IS NOT NULL AND section_path != ''")
    return _edges(own, section, chunk, "contains").unionByName(_edges(own, chunk, section, "belongs_to"))


def page_edges(chunks: DataFrame) -> DataFrame:
    return _edges(chunks.where("page_number > 0"), F.concat(F.lit("page:"), F.col("page_number")), chunk_node(F.col("chunk_index")), "on_page")


def follow_edges(chunks: DataFrame) -> DataFrame:
    """From each of the two chunks before."""
    pairs = chunks.select("doc_id", "chunk_index", F.explode("prev_chunk_ids").alias("prev"))
    return _edges(pairs, chunk_node(F.col("prev")), chunk_node(F.col("chunk_index")), "follows")


def similar_edges(vectors: DataFrame, follows: DataFrame, search: int = 8, keep: int = 5, above: float = 0.5) -> DataFrame:
    """(doc_id, chunk_index, vec) -> similar_to edges.

    Of each chunk's ``search`` nearest, itself among them, the best ``keep`` others; similarity is 1 for the nearest and 0 for the
    farthest of these, and what is above ``above`` is an edge, unless the two follow each other. Of both directions the one from the lower index stays.
    """
    found = nearest(vectors.select(F.col("chunk_index").alias("query_id"), "doc_id", "vec"), vectors.select("doc_id", F.col("chunk_index").alias("id"), "vec"), search)
    near = found.select("doc_id", F.col("query_id").alias("i"), F.col("id").alias("j"), F.col("distance").alias("d")).where("i != j")
    by_chunk = Window.partitionBy("doc_id", "i")
    top = near.withColumn("k", F.row_number().over(by_chunk.orderBy("d", "j"))).where(F.col("k") <= keep)
    scored = top.withColumn("similarity", 1 - (F.col("d") - F.min("d").over(by_chunk)) / (F.max("d").over(by_chunk) - F.min("d").over(by_chunk) + 1e-9)).where(F.col("similarity") > above)
    linked = follows.select("doc_id", node_number(F.col("source")).alias("i"), node_number(F.col("target")).alias("j"))
    both = linked.unionByName(linked.select("doc_id", F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    free = scored.join(both, ["doc_id", "i", "j"], "left_anti")
    one = free.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", F.least("i", "j"), F.greatest("i", "j")).orderBy("i"))).where("turn = 1")
    return one.select("doc_id", chunk_node(F.col("i")).alias("source"), chunk_node(F.col("j")).alias("target"), F.lit("similar_to").alias("relation"), "similarity")


def parent_sections(edges: DataFrame) -> DataFrame:
    """doc_id, chunk_id, section_path."""
    own = edges.where("relation = 'belongs_to'")
    return own.select("doc_id", node_number(F.col("source")).alias("chunk_id"), F.regexp_replace("target", "^section:", "").alias("section_path"))


def section_chunks(edges: DataFrame) -> DataFrame:
    """doc_id, section_path, chunk_ids (sorted)."""
    own = edges.where("relation = 'contains'")
    return own.groupBy("doc_id", F.regexp_replace("source", "^section:", "").alias("section_path")).agg(F.sort_array(F.collect_list(node_number(F.col("target")))).alias("chunk_ids"))


def page_chunks(edges: DataFrame) -> DataFrame:
    """doc_id, page_number, chunk_ids (sorted)."""
    return edges.where("relation = 'on_page'").groupBy("doc_id", node_number(F.col("source")).alias("page_number")).agg(F.sort_array(F.collect_list(node_number(F.col("target")))).alias("chunk_ids"))


def chunk_pages(edges: DataFrame) -> DataFrame:
    """doc_id, chunk_id, page_number."""
    return edges.where("relation = 'on_page'").select("doc_id", node_number(F.col("target")).alias("chunk_id"), node_number(F.col("source")).alias("page_number"))


def adjacent_chunks(edges: DataFrame, window: int = 1) -> DataFrame:
    """doc_id, chunk_id, neighbour, place: predecessors by falling nearness last written first, then successors, two per unit of the window."""
    own = edges.where("relation = 'follows'").select("doc_id", node_number(F.col("source")).alias("s"), node_number(F.col("target")).alias("t"))
    both = own.select("doc_id", F.col("t").alias("chunk_id"), F.col("s").alias("neighbour"), F.lit(0).alias("side")).unionByName(own.select("doc_id", F.col("s").alias("chunk_id"), F.col("t").alias("neighbour"), F.lit(1).alias("side")))
    order = Window.partitionBy("doc_id", "chunk_id").orderBy("side", "neighbour")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2 * window).drop("side")


def similar_chunks(edges: DataFrame) -> DataFrame:
    """doc_id, chunk_id, neighbour, similarity, either direction."""
    own = edges.where("relation = 'similar_to'").select("doc_id", node_number(F.col("source")).alias("chunk_id"), node_number(F.col("target")).alias("neighbour"), "similarity")
    return own.unionByName(own.select("doc_id", F.col("neighbour").alias("chunk_id"), F.col("chunk_id").alias("neighbour"), "similarity"))


def one_step(frontier: DataFrame, near: DataFrame, of: DataFrame | None) -> DataFrame:
    """(query_id, doc_id, chunk_id) -> query_id, doc_id, chunk_id that one step reaches by ``near`` (doc_id, chunk_id, neighbour) and by sections, ``of``.

    The frontier is joined with links and with its sections, each of which is opened once per query; pairs of a section's chunks are never made.
    A section holds the chunk that it was reached from.
    """
    found = frontier.join(near, ["doc_id", "chunk_id"]).select("query_id", "doc_id", F.col("neighbour").alias("chunk_id"))
    if of is not None:
        opened = frontier.join(of, ["doc_id", "chunk_id"]).select("query_id", "doc_id", "section_path").distinct()
        found = found.unionByName(opened.join(of, ["doc_id", "section_path"]).select("query_id", "doc_id", "chunk_id"))
    return found.distinct()


def expand(seeds: DataFrame, edges: DataFrame, most: int = 30, section_step: bool = True) -> DataFrame:
    """(query_id, doc_id, chunk_id) seeds -> query_id, doc_id, chunk_id, hop, rank: breadth first over a batch of queries.

    Rounds go on until no query has anywhere to go: it has ``most`` chunks, or a step from its last ones finds none that is new. A round takes
    one step for all queries that are left, adjacent, similar and same section (unless switched off); what was reached before is left out, and of the
    rest only as many as a query still has room for, by id, as later ones would rank below ``most``. So a query never has more than ``most`` rows,
    whatever the graph. Seeds all count, and the result is ranked by hop and id and cut at ``most``.

    Links are written once and each round's chunks too, so the plan of a round doesn't hold those before. Null ids reach nothing; repeated
    seeds are one; cycles end as their chunks are known; without edges or seeds there are the seeds or nothing.
    """
    near = stored(adjacent_chunks(edges).select("doc_id", "chunk_id", "neighbour").unionByName(similar_chunks(edges).select("doc_id", "chunk_id", "neighbour")).distinct(), "links")
    of = stored(parent_sections(edges), "sections") if section_step else None
    frontier = stored(seeds.select("query_id", "doc_id", "chunk_id").distinct().withColumn("hop", F.lit(0)), "hop")
    parts = [frontier]
    by_id = Window.partitionBy("query_id").orderBy("chunk_id")
    for hop in itertools.count(1):
        reached = functools.reduce(DataFrame.unionByName, parts)
        room = reached.groupBy("query_id").agg((F.lit(most) - F.count("*")).alias("room"))
        going = frontier.join(room.where("room > 0").select("query_id"), "query_id", "left_semi").select("query_id", "doc_id", "chunk_id")
        new = one_step(going, near, of).join(reached, ["query_id", "doc_id", "chunk_id"], "left_anti").join(room, "query_id")
        frontier = stored(new.withColumn("k", F.row_number().over(by_id)).where("k <= room").select("query_id", "doc_id", "chunk_id", F.lit(hop).alias("hop")), "hop")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > 8:  # many small tables become one
            parts = [stored(functools.reduce(DataFrame.unionByName, parts), "hops")]
    discard(near, *([of] if section_step else []), frontier)
    reached = functools.reduce(DataFrame.unionByName, parts)
    return reached.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "chunk_id"))).where(F.col("rank") <= most)


def expand_prioritized(seeds: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, doc_id, chunk_id) one seed each -> query_id, doc_id, chunk_id, priority, rank.

    Similar chunks come first (0), then those of the section (1), then those of the page (2); each once, without the seed.
    """
    seed = seeds.select("query_id", "doc_id", F.col("chunk_id").alias("seed"))
    same = lambda of, key: seed.join(of.withColumnRenamed("chunk_id", "seed"), ["doc_id", "seed"]).join(of, ["doc_id", key]).select("query_id", "doc_id", "seed", "chunk_id")
    similar = seed.join(similar_chunks(edges).withColumnRenamed("chunk_id", "seed"), ["doc_id", "seed"]).select("query_id", "doc_id", "seed", F.col("neighbour").alias("chunk_id"))
    parts = [similar, same(parent_sections(edges), "section_path"), same(chunk_pages(edges), "page_number")]
    union = None
    for k, p in enumerate(parts):
        p = p.withColumn("priority", F.lit(k))
        union = p if union is None else union.unionByName(p)
    found = union.where("chunk_id != seed").groupBy("query_id", "doc_id", "chunk_id").agg(F.min("priority").alias("priority"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "chunk_id"))).where(F.col("rank") <= most)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per document: node and edge counts by kind, density, similarity summary over non-zero, chunks per section."""
    n = nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), *[F.count_if(F.col("type") == t).alias(f"n_{t}s") for t in ("section", "chunk", "page")])
    kinds = ("contains_section", "contains", "belongs_to", "on_page", "follows", "similar_to")
    s = F.when(F.col("similarity") != 0, F.col("similarity"))
    m = edges.groupBy("doc_id").agg(
        F.count("*").alias("n_edges"), *[F.count_if(F.col("relation") == k).alias(f"n_{k}") for k in kinds],
        F.count(s).alias("n_similarities"), F.avg(s).alias("avg_similarity"), F.min(s).alias("min_similarity"), F.max(s).alias("max_similarity"),
    )
    both = n.join(m, "doc_id", "left").fillna(0, ["n_edges", "n_similarities", *[f"n_{k}" for k in kinds]])
    return both.withColumns(
        {
            "density": F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0),
            "chunks_per_section": F.when(F.col("n_sections") > 0, F.col("n_chunks") / F.col("n_sections")).otherwise(0.0),
        }
    )


def simplified(nodes: DataFrame, edges: DataFrame, most_nodes: int = 100) -> tuple[DataFrame, DataFrame]:
    """All sections, and the first chunks up to ``most_nodes`` in all, with the edges among them."""
    sections = nodes.where("type = 'section'").select("doc_id", "id", "type")
    room = sections.groupBy("doc_id").agg((F.lit(most_nodes) - F.count("*")).alias("room"))
    chunks = nodes.where("type = 'chunk'").withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id"))).join(room, "doc_id", "left").where(F.col("k") <= F.coalesce("room", F.lit(most_nodes)))
    kept = sections.unionByName(chunks.select("doc_id", "id", "type"))
    ends = kept.select("doc_id", "id")
    inner = edges.join(ends.withColumnRenamed("id", "source"), ["doc_id", "source"], "left_semi").join(ends.withColumnRenamed("id", "target"), ["doc_id", "target"], "left_semi")
    return kept, inner


def display_nodes(nodes: DataFrame) -> DataFrame:
    """doc_id, id, label (30 characters at most), title, group, for drawing."""
    name = F.when(F.col("type") == "section", F.col("section_title")).when(F.col("type") == "chunk", F.coalesce(F.nullif("heading", F.lit("")), F.concat(F.lit("Chunk "), "chunk_id"))).otherwise(F.concat(F.lit("Page "), "page_number"))
    title = F.when(F.col("type") == "section", F.concat(F.lit("Section: "), "section_path")).when(F.col("type") == "chunk", F.concat(F.lit("Chunk "), "chunk_id", F.lit(": "), F.coalesce("heading", F.lit("")))).otherwise(name)
    return nodes.select("doc_id", "id", F.when(F.length(name) > 30, F.concat(F.substring(name, 1, 27), F.lit("..."))).otherwise(name).alias("label"), title.alias("title"), F.col("type").alias("group"))
