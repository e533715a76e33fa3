"""Chat exports: one JSON document with polymorphic text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = "struct<type:string,text:string,href:string>"

# the fields of a record that are read; ``text`` is kept as a variant because it
# is a string in some records and an array in others
MESSAGE_SCHEMA = (
    "struct<id:bigint,type:string,date:string,date_unixtime:string,from:string,from_id:string,"
    "actor:string,actor_id:string,action:string,title:string,members:array<string>,text:variant,"
    f"text_entities:array<{SPAN}>,reply_to_message_id:bigint,photo:string,file:string,"
    "file_name:string,mime_type:string,width:int,height:int,reactions:array<struct<count:int>>,"
    "edited:string,forwarded_from:string,text_source:string>"
)


def flatten_text(text: Column) -> Column:
    """A string, or an array of strings and spans, as plain text; else ''."""

    def part(v: Column) -> Column:
        shape = F.schema_of_variant(v)
        return (
            F.when(F.startswith(shape, F.lit("OBJECT")), F.try_variant_get(v, "$.text", "string"))
            .when(shape == "STRING", F.try_variant_get(v, "$", "string"))
            .otherwise(F.lit(""))
        )

    shape = F.schema_of_variant(text)
    parts = F.try_variant_get(text, "$", "array<variant>")
    joined = F.array_join(F.transform(parts, lambda v: F.coalesce(part(v), F.lit(""))), "")
    return F.coalesce(
        F.when(shape == "STRING", F.try_variant_get(text, "$", "string")).when(
            F.startswith(shape, F.lit("ARRAY")), joined
        ),
        F.lit(""),
    )


def text_links(text: Column) -> Column:
    """Targets of link spans inside an array text, in order."""
    spans = F.filter(
        F.try_variant_get(text, "$", "array<variant>"),
        lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")),
    )
    typed = F.transform(
        spans,
        lambda v: F.struct(
            F.try_variant_get(v, "$.type", "string").alias("type"),
            F.try_variant_get(v, "$.text", "string").alias("text"),
            F.try_variant_get(v, "$.href", "string").alias("href"),
        ),
    )
    found = F.when(F.startswith(F.schema_of_variant(text), F.lit("ARRAY")), span_links(typed))
    return F.coalesce(found, F.array().cast("array<string>"))


def span_links(spans: Column) -> Column:
    """Targets of ``link`` and ``text_link`` spans: href if given, else the text."""
    links = F.filter(spans, lambda s: s["type"].isin("link", "text_link"))
    urls = F.transform(links, lambda s: F.coalesce(s["href"], s["text"]))
    return F.coalesce(F.filter(urls, lambda u: u != ""), F.array().cast("array<string>"))


def link_union(text: Column, entities: Column) -> Column:
    """Links of the text array, then new ones of the entity array."""
    return F.array_union(text_links(text), span_links(entities))


def reaction_sum(reactions: Column) -> Column:
    """Sum of the counts of a nested reaction array, 0 if there is none."""
    total = F.aggregate(
        reactions, F.lit(0).cast("bigint"), lambda acc, r: acc + F.coalesce(r["count"], F.lit(0))
    )
    return F.coalesce(total, F.lit(0))


def read_export(spark: SparkSession, path: str, *, one_per_line: bool = False) -> DataFrame:
    """Messages of the first chat of each export.

    One export is one JSON document and therefore one task; a corpus of many
    exports is spread file by file, or line by line with ``one_per_line``.
    """
    schema = f"chats struct<list:array<struct<name:string,type:string,id:bigint,messages:array<{MESSAGE_SCHEMA}>>>>"
    raw = spark.read.json(path, multiLine=not one_per_line, schema=schema)
    first = F.get(F.col("chats.list"), F.lit(0))
    return raw.select(F.explode(first["messages"]).alias("m")).select("m.*")


def enriched_frame(messages: DataFrame, topics: DataFrame) -> DataFrame:
    """Analysis columns of content messages.  ``topics`` = (id, topic)."""
    text = flatten_text(F.col("text"))
    ts = F.to_timestamp("date")
    content = messages.where(F.col("type") == "message")
    return (
        content.join(topics, "id", "left")
        .select(
            "id",
            ts.alias("date"),
            F.coalesce("from", "actor", F.lit("Unknown")).alias("sender"),
            F.coalesce("from_id", "actor_id", F.lit("")).alias("sender_id"),
            text.alias("text"),
            F.length(text).alias("text_length"),
            "topic",
            F.col("photo").isNotNull().alias("has_photo"),
            F.col("file").isNotNull().alias("has_file"),
            "file_name",
            "mime_type",
            reaction_sum(F.col("reactions")).alias("reaction_count"),
            link_union(F.col("text"), F.col("text_entities")).alias("links"),
            F.col("edited").isNotNull().alias("is_edited"),
            F.col("forwarded_from").isNotNull().alias("is_forwarded"),
            F.col("reply_to_message_id").alias("reply_to"),
        )
        .withColumn("link_count", F.size("links"))
    )


# fixed values: service actions that are modelled, by code
ACTION_NAMES = {
    "ChatCreate": "create_group",
    "ChatEditTitle": "edit_group_title",
    "ChatEditPhoto": "edit_group_photo",
    "ChatDeletePhoto": "delete_group_photo",
    "ChatAddUser": "invite_members",
    "ChatJoinedByLink": "join_group_by_link",
    "ChatDeleteUser": "remove_members",
    "PinMessage": "pin_message",
    "ChannelMigrateFrom": "migrate_from_group",
    "ChatMigrateTo": "migrate_to_supergroup",
    "TopicCreate": "topic_created",
    "TopicEdit": "topic_edit",
}


def normalise_records(raw: DataFrame, actions: dict[str, str] | None = None) -> DataFrame:
    """Raw records to typed rows.

    Input: id, kind ('message' / 'service'), ts, peer_kind, peer_id, peer_name,
    action_code, title, body, reply_to_id, reply_root_id, media_kind,
    media_name, media_type.  Service rows of an action that is not modelled are
    dropped; a reply points at the direct parent, else at the thread root.
    """
    names = actions or ACTION_NAMES
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    service = F.col("kind") == "service"
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    peer = F.concat(F.col("peer_kind"), F.col("peer_id").cast("string"))
    photo, document = F.col("media_kind") == "photo", F.col("media_kind") == "document"
    return (
        raw.withColumn("action", F.when(service, F.try_element_at(lookup, F.col("action_code"))))
        .where(~service | F.col("action").isNotNull())
        .select(
            "id",
            F.col("kind").alias("type"),
            iso.alias("date"),
            F.unix_seconds("ts").cast("string").alias("date_unixtime"),
            F.when(~service, F.col("peer_name")).alias("from"),
            F.when(~service, peer).alias("from_id"),
            F.when(service, F.col("peer_name")).alias("actor"),
            F.when(service, peer).alias("actor_id"),
            "action",
            F.when(
                F.col("action").isin("topic_created", "edit_group_title", "create_group"),
                F.col("title"),
            ).alias("title"),
            F.when(service, F.lit("")).otherwise(F.coalesce("body", F.lit(""))).alias("text"),
            F.when(
                ~service,
                F.coalesce(
                    F.when(F.col("reply_to_id") != 0, F.col("reply_to_id")), F.col("reply_root_id")
                ),
            ).alias("reply_to_message_id"),
            F.when(~service & photo, F.concat(F.lit("photos/photo_"), F.col("id").cast("string"),
                                              F.lit("@"), iso, F.lit(".jpg"))).alias("photo"),
            F.when(~service & document, F.concat(F.lit("files/"), F.col("media_name"))).alias("file"),
            F.when(~service & document, F.col("media_name")).alias("file_name"),
            F.when(~service & document, F.coalesce("media_type", F.lit(""))).alias("mime_type"),
        )
    )


def cover_spans(text: Column, entities: Column) -> Column:
    """Styled spans plus the plain gaps between them, covering the whole text.

    ``entities`` = array of (offset, length, type).  Spans are taken by offset,
    longest first; one that starts inside the span before it is skipped.
    """
    span = "array<struct<type:string,text:string>>"
    ordered = F.array_sort(
        F.transform(
            entities,
            lambda e: F.struct(e["offset"].alias("a"), (-e["length"]).alias("b"), e["type"].alias("t")),
        )
    )

    def piece(kind: Column, start: Column, length: Column) -> Column:
        return F.array(F.struct(kind.alias("type"), text.substr(start + 1, length).alias("text")))

    def step(acc: Column, e: Column) -> Column:
        gap = F.when(
            e["a"] > acc["at"], piece(F.lit("plain"), acc["at"], e["a"] - acc["at"])
        ).otherwise(F.array().cast(span))
        grown = F.struct(
            (e["a"] - e["b"]).cast("int").alias("at"),
            F.concat(acc["out"], gap, piece(e["t"], e["a"], -e["b"])).alias("out"),
        )
        return F.when(e["a"] < acc["at"], acc).otherwise(grown)

    def finish(acc: Column) -> Column:
        rest = piece(F.lit("plain"), acc["at"], F.length(text))
        return F.when(acc["at"] < F.length(text), F.concat(acc["out"], rest)).otherwise(acc["out"])

    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(span)).otherwise(
        F.aggregate(F.coalesce(ordered, F.array().cast("array<struct<a:int,b:int,t:string>>")), start, step, finish)
    )
