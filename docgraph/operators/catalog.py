"""The catalog of documents, and conversations about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.operators.grounding import cited_in_order


def document_status(docs: DataFrame, markdown: DataFrame, mappings: DataFrame, graphs: DataFrame, stores: DataFrame) -> DataFrame:
    """document_id, status by what exists of it: uploaded, processing, vectorized, ready. The others are tables of document ids."""
    out = docs.select("document_id")
    for name, df in (("m", markdown), ("c", mappings), ("g", graphs), ("v", stores)):
        out = out.join(df.select("document_id").distinct().withColumn(name, F.lit(True)), "document_id", "left")
    built = F.col("c").isNotNull() & F.col("g").isNotNull()
    return out.select("document_id", F.when(built & F.col("v").isNotNull(), "ready").when(built, "vectorized").when(F.col("m").isNotNull(), "processing").otherwise("uploaded").alias("status"))


def display_name(*candidates: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def documents_of_users(records: DataFrame, docs: DataFrame) -> DataFrame:
    """user_id, document_id, created_at, place (newest first) of documents that exist."""
    own = records.join(docs.select("document_id"), "document_id", "left_semi")
    return own.select("user_id", "document_id", "created_at", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "document_id")).alias("place"))


def owned_by(rows: DataFrame, records: DataFrame, keys: tuple[str, str] = ("user_id", "document_id")) -> DataFrame:
    return rows.join(records.select(*keys).distinct(), list(keys), "left_semi")


def active_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions that aren't archived with their place among those of their user and document, latest first."""
    order = Window.partitionBy("user_id", "document_id").orderBy(F.desc("updated_at"), "id")
    return sessions.where("NOT is_archived").withColumn("place", F.row_number().over(order))


def session_messages(messages: DataFrame, limit: int = 500) -> DataFrame:
    """The first messages of each session in order of time; ``limit`` is from 1 to 500."""
    order = Window.partitionBy("session_id").orderBy("created_at", "id")
    return messages.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(1, min(500, limit)))


def messages_before(requests: DataFrame, messages: DataFrame, last: int = 7) -> DataFrame:
    """(session_id, before_id) -> the last messages before an id, place in order of time."""
    own = requests.join(messages, "session_id").where(F.col("id") < F.col("before_id"))
    recent = own.withColumn("k", F.row_number().over(Window.partitionBy("session_id", "before_id").orderBy(F.desc("id")))).where(F.col("k") <= last)
    return recent.withColumn("place", F.row_number().over(Window.partitionBy("session_id", "before_id").orderBy("id"))).drop("k")


def cited_chunks(messages: DataFrame, most: int = 2) -> DataFrame:
    """(id, role, content, chunks) -> id, place, chunk_index, content of the chunks that an assistant's message cites, by first mention."""
    own = messages.where("role = 'assistant'")
    refs = own.select("id", F.posexplode(cited_in_order(F.col("content"))).alias("p", "chunk_index"))
    have = own.select("id", F.explode("chunks").alias("c")).select("id", "c.chunk_index", F.col("c.content").alias("content"))
    joined = refs.join(have, ["id", "chunk_index"])
    return joined.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("p"))).where(F.col("place") <= most).drop("p")


def archive(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """``sessions`` with those that (id) names archived."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return sessions.join(gone, "id", "left").withColumn("is_archived", F.coalesce("_gone", F.col("is_archived"))).drop("_gone")


def validate_requests(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """(request_id, user_id, session_id, document_id) -> request_id, ok, reason: the session exists, is active, the user's, and of the document."""
    s = sessions.select(F.col("id").alias("session_id"), F.col("user_id").alias("owner"), F.col("document_id").alias("of_document"), "is_archived")
    j = requests.join(s, "session_id", "left")
    reason = F.when(F.col("owner").isNull(), "no such session").when(F.col("owner") != F.col("user_id"), "not the user's").when(F.col("is_archived"), "archived").when(F.col("of_document") != F.col("document_id"), "another document")
    return j.select("request_id", reason.isNull().alias("ok"), reason.alias("reason"))


def suggested_questions(docs: DataFrame, overviews: DataFrame) -> DataFrame:
    """document_id, suggested_queries; an empty list where none are known."""
    return docs.select("document_id").join(overviews.select("document_id", "suggested_queries"), "document_id", "left").withColumn("suggested_queries", F.coalesce("suggested_queries", F.array().cast("array<string>")))


def brief_summary(docs: DataFrame, brief: DataFrame, overview: DataFrame) -> DataFrame:
    """document_id, summary: the brief one, else the overview's, where not blank."""
    j = docs.select("document_id").join(brief, "document_id", "left").join(overview, "document_id", "left")
    return j.select("document_id", F.coalesce(F.nullif(F.trim("brief"), F.lit("")), F.nullif(F.trim("overview"), F.lit(""))).alias("summary"))


def delete_documents(rows: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    """What stays of a table when documents go."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def delete_messages(messages: DataFrame, sessions: DataFrame, gone: DataFrame) -> DataFrame:
    """What stays of messages: those of sessions that aren't on a document that goes."""
    dead = sessions.join(gone.select("document_id").distinct(), "document_id", "left_semi").select(F.col("id").alias("session_id"))
    return messages.join(dead, "session_id", "left_anti")


def register_documents(records: DataFrame, new: DataFrame) -> DataFrame:
    """``records`` and the first new record of each document that has none."""
    order = Window.partitionBy("document_id").orderBy("created_at", "user_id")
    fresh = new.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k").join(records.select("document_id"), "document_id", "left_anti")
    return records.unionByName(fresh.select(*records.columns))


def page_ranges(rows: DataFrame) -> DataFrame:
    """Valid stored ranges with their place: start and end are whole numbers, start above 0, end not before it, a summary."""
    typed = rows.withColumns({"start_page": F.col("start_page").try_cast("int"), "end_page": F.col("end_page").try_cast("int")})
    good = typed.where("start_page > 0 AND end_page >= start_page AND trim(summary) != ''")
    return good.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("start_page", "end_page", "summary")))
