"""Catalogue, governance and reporting over documents, groups, users, tags, settings and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import extension
from folioscope.functions.vocab import DEFAULT_PROVIDER, RETRIEVAL_DEFAULTS
from folioscope.operators.windows import top_k


# ---------------------------------------------------------------- documents

def size_text(n_bytes: Column) -> Column:
    """Bytes as B/KB/MB/GB/TB with one decimal."""
    def shown(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(n_bytes / F.lit(float(1024 ** power)), 1))
    out = shown(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n_bytes < 1024 ** (power + 1), shown(power, unit)).otherwise(out)
    return out


def index_status(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, metadata: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs plus has_chunks, has_vectors, has_metadata."""
    out = docs
    for name, table in (("has_chunks", chunks), ("has_vectors", vectors), ("has_metadata", metadata)):
        out = out.join(table.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(
            name, F.coalesce(name, F.lit(False)))
    return out


def missing_index(docs: DataFrame, vectors: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with content that no vector row covers: the rebuild list."""
    return docs.filter(F.col(text) != "").join(vectors.select(key).distinct(), key, "left_anti")


def access_semi_join(rows: DataFrame, membership: DataFrame, asked: DataFrame) -> DataFrame:
    """user_id and the rows (with group_id) that each asked user (user_id, role) may read: all for an 'admin', else their groups'.

    Users meet groups first and single rows last; an admin's permission is one row for each group. The rows of a group are dealt
    over as many lanes as there are cores, and its users go to each of them. The number of parts is given: both sides are small
    beside what they make, and parts put together by their size would make it in one task.
    """
    groups = rows.select("group_id").distinct()
    own = membership.join(asked.filter("role <> 'admin' or role is null"), "user_id", "left_semi").select("user_id", "group_id").distinct()
    every = asked.filter("role = 'admin'").select("user_id").distinct().crossJoin(groups)
    spark = rows.sparkSession
    lanes, lane = spark.sparkContext.defaultParallelism, "_lane".ljust(max(map(len, rows.columns)) + 1, "_")  # a name that no column has
    parts = max(lanes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn(lane, F.pmod(F.monotonically_increasing_id(), F.lit(lanes)).cast("int")).repartition(parts, "group_id", lane)
    users = own.unionByName(every).withColumn(lane, F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).repartition(parts, "group_id", lane)
    return dealt.join(users, ["group_id", lane]).drop(lane)


def access_counts(rows: DataFrame, membership: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, n_visible for every user. Rows are counted per group first, so users never meet single rows."""
    per_group = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    total = per_group.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    own = membership.select("user_id", "group_id").distinct().join(per_group, "group_id").groupBy("user_id").agg(F.sum("n").alias("own"))
    return users.join(own, "user_id", "left").join(F.broadcast(total)).select(  # one-row side
        "user_id", F.when(F.col("role") == "admin", F.col("total")).otherwise(F.coalesce("own", F.lit(0))).alias("n_visible"))


def documents_by_group(docs: DataFrame) -> DataFrame:
    """group_name, is_persistent, n_documents. ``docs``: group_name, origin, file_path."""
    kept = F.coalesce(F.col("origin").isin("folder", "group"), F.lit(False)) | F.col("file_path").isNotNull()
    return docs.groupBy(F.coalesce("group_name", F.lit("Uploaded")).alias("group_name"), kept.alias("is_persistent")).agg(
        F.count(F.lit(1)).alias("n_documents"))


def corpus_counters(docs: DataFrame, today: Column, day: str = "uploaded_at", kind: str = "type") -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("total_documents"),
                    F.count(F.when(F.to_date(day) == today, 1)).alias("uploaded_today"),
                    F.count_distinct(kind).alias("distinct_types"))


def admin_counters(users: DataFrame, documents: DataFrame) -> DataFrame:
    u = users.agg(F.count(F.lit(1)).alias("users"), F.count(F.when(F.col("is_active"), 1)).alias("active_users"))
    d = documents.agg(F.count(F.lit(1)).alias("documents"))
    return u.join(F.broadcast(d))  # one row each


def catalog_listing(docs: DataFrame, tags: DataFrame, status: DataFrame) -> DataFrame:
    """Documents, newest first, with type, size, tags ('Untagged' by default) and index status.

    ``docs``: doc_id, filename, uploaded_at, n_bytes; ``tags``: doc_id, tag; ``status`` as index_status gives it.
    """
    joined = tags.distinct().groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ", ").alias("tags"))
    return (
        docs.join(joined, "doc_id", "left").join(status, "doc_id", "left")
        .select("doc_id", "filename", "uploaded_at", F.upper(extension(F.col("filename"))).alias("type"),
                size_text(F.col("n_bytes")).alias("size"), F.coalesce("tags", F.lit("Untagged")).alias("tags"),
                "has_chunks", "has_vectors", "has_metadata")
        .orderBy(F.desc("uploaded_at"), "doc_id")
    )


def catalog_page(docs: DataFrame, tags: DataFrame, status: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """The next ``limit`` rows of ``catalog_listing`` after the (uploaded_at, doc_id) of the row last shown; from the first without.

    Tasks keep ``limit`` documents each, and tags and status are joined to those of the page only. Documents without a time come
    last, as in the listing.
    """
    if after is not None:
        at, last = F.lit(after[0]).cast(docs.schema["uploaded_at"].dataType), F.lit(after[1])
        older = at.isNull() & F.lit(False) if after[0] is None else F.col("uploaded_at").isNull() | (F.col("uploaded_at") < at)
        docs = docs.filter(older | (F.col("uploaded_at").eqNullSafe(at) & (F.col("doc_id") > last)))
    page = docs.orderBy(F.desc("uploaded_at"), "doc_id").limit(limit)
    return catalog_listing(page, *(t.join(page.select("doc_id"), "doc_id", "left_semi") for t in (tags, status)))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("n_chunks"),
                                                F.sum(F.length("chunk_text")).alias("n_chars"))


def language_mix(rows: DataFrame, scope: str) -> DataFrame:
    """scope, lang, n: every language that occurs, null too."""
    return rows.groupBy(scope, "lang").agg(F.count(F.lit(1)).alias("n"))


def distinct_tags(tags: DataFrame) -> DataFrame:
    """tag: every tag once plus 'all'."""
    return tags.select("tag").unionByName(tags.sparkSession.createDataFrame([("all",)], "tag string")).distinct().orderBy("tag")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("document").pivot("vote", ["like", "dislike"]).agg(F.count(F.lit(1))).na.fill(0)


def longest_documents(docs: DataFrame, group: str, k: int = 3) -> DataFrame:
    return top_k(docs, [group], [F.desc("n_chars"), F.col("doc_id")], k)


# ---------------------------------------------------------------- set changes

def hide_groups(docs: DataFrame, hidden: DataFrame) -> DataFrame:
    return docs.join(hidden.select("group_id").distinct(), "group_id", "left_anti")


def restore_groups(working: DataFrame, docs: DataFrame, restored: DataFrame) -> DataFrame:
    back = docs.join(restored.select("group_id").distinct(), "group_id", "left_semi")
    return working.unionByName(back.join(working.select("doc_id"), "doc_id", "left_anti").select(working.columns))


def delete_group_documents(table: DataFrame, docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``table`` (any table with doc_id) without the documents of the given groups."""
    gone = docs.join(groups.select("group_id").distinct(), "group_id", "left_semi").select("doc_id")
    return table.join(gone, "doc_id", "left_anti")


def merge_tags(old: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, tag after replacing the tags of the edited documents. ``edits``: doc_id, tag_text ('a, b')."""
    parsed = F.filter(F.transform(F.split(F.coalesce("tag_text", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    blank = F.coalesce("tag_text", F.lit("")) == ""
    new = edits.select("doc_id", F.explode(F.when(blank, F.array(F.lit("Untagged"))).otherwise(parsed)).alias("tag"))
    return old.join(edits.select("doc_id"), "doc_id", "left_anti").select("doc_id", "tag").unionByName(new)


def discover_groups(*sources: DataFrame) -> DataFrame:
    """group_id, name from the first source that has any group, else one default group."""
    spark = sources[0].sparkSession
    tagged = spark.createDataFrame([(len(sources), "default", "Default")], "p int, group_id string, name string")
    for p, s in enumerate(sources):
        tagged = tagged.unionByName(s.select(F.lit(p).alias("p"), "group_id", "name"))
    best = tagged.agg(F.min("p").alias("p"))
    return tagged.join(F.broadcast(best), "p").select("group_id", "name").distinct()  # one-row side


# ---------------------------------------------------------------- users and groups

def memberships(users: DataFrame, membership: DataFrame, groups: DataFrame, admins: DataFrame) -> DataFrame:
    """user_id, group_id, group_name, is_admin. ``admins``: group_id, user_id."""
    leads = admins.select("group_id", "user_id").distinct().withColumn("is_admin", F.lit(True))
    return (
        membership.join(users.select("user_id"), "user_id", "left_semi").join(groups, "group_id")
        .join(leads, ["group_id", "user_id"], "left")
        .select("user_id", "group_id", F.col("name").alias("group_name"), F.coalesce("is_admin", F.lit(False)).alias("is_admin"))
    )


def primary_group(users: DataFrame, membership: DataFrame) -> DataFrame:
    """user_id, group_id: the first group by ``ord``, else 'public'."""
    first = membership.groupBy("user_id").agg(F.min_by("group_id", "ord").alias("group_id"))
    return users.select("user_id").join(first, "user_id", "left").select(
        "user_id", F.coalesce(F.col("group_id").cast("string"), F.lit("public")).alias("group_id"))


def group_report(groups: DataFrame, membership: DataFrame, admins: DataFrame, users: DataFrame) -> DataFrame:
    """group_id, name, members_count, member, is_admin — one row per member, so that no group is one cell.

    Groups without members keep one row. ``admins``: group_id, user_id.
    """
    counts = membership.groupBy("group_id").agg(F.count(F.lit(1)).alias("members_count"))
    rows = (
        membership.join(users.select("user_id", "username"), "user_id", "left")
        .join(admins.select("group_id", "user_id").distinct().withColumn("is_admin", F.lit(True)), ["group_id", "user_id"], "left")
    )
    return (
        groups.select("group_id", "name").join(counts, "group_id", "left").join(rows, "group_id", "left")
        .select("group_id", "name", F.coalesce("members_count", F.lit(0)).alias("members_count"),
                F.col("username").alias("member"), F.coalesce("is_admin", F.lit(False)).alias("is_admin"))
    )


def user_report(users: DataFrame, membership: DataFrame, groups: DataFrame, admins: DataFrame, tags: DataFrame) -> DataFrame:
    """user_id, username, status, last_login, user_tag, groups, admin_groups."""
    names = groups.select("group_id", "name")
    listed = lambda df, out: df.join(names, "group_id").groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_list("name")), ", ").alias(out))  # the groups of one user
    return (
        users.join(listed(membership, "groups"), "user_id", "left").join(listed(admins, "admin_groups"), "user_id", "left")
        .join(tags, "user_id", "left")
        .select("user_id", "username", F.when(F.col("is_active"), "Active").otherwise("Inactive").alias("status"),
                F.coalesce(F.date_format("last_login", "yyyy-MM-dd HH:mm"), F.lit("Never")).alias("last_login"),
                *[F.coalesce(c, F.lit("")).alias(c) for c in ("user_tag", "groups", "admin_groups")])
    )


def membership_violations(membership: DataFrame, admins: DataFrame, groups: DataFrame) -> DataFrame:
    """rule, subject, n: users in several groups, admins outside their group, names that give the same id."""
    many = membership.groupBy("user_id").agg(F.count_distinct("group_id").alias("n")).filter("n > 1").select(
        F.lit("several groups").alias("rule"), F.col("user_id").cast("string").alias("subject"), "n")
    outside = admins.join(membership, ["group_id", "user_id"], "left_anti").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n")).select(
        F.lit("admin outside group").alias("rule"), F.col("user_id").cast("string").alias("subject"), "n")
    clash = groups.groupBy(F.replace(F.lower("name"), F.lit(" "), F.lit("_")).alias("subject")).agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("same id").alias("rule"), "subject", "n")
    return many.unionByName(outside).unionByName(clash)


def resolve_settings(groups: DataFrame, settings: DataFrame) -> DataFrame:
    """group_id, provider and limits: the group's own value, else the 'default' row's, else the constants; clamped."""
    d = RETRIEVAL_DEFAULTS
    names = ["provider", *d]
    base = settings.filter("group_id = 'default'").select(*[F.col(c).alias(f"d_{c}") for c in names])
    base = base.agg(*[F.first(f"d_{c}").alias(f"d_{c}") for c in names])  # one row, also without a default
    own = settings.filter("group_id <> 'default'")
    pick = lambda c, fixed: F.coalesce(F.col(c), F.col(f"d_{c}"), F.lit(fixed))
    clamp = lambda col, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), col))
    return groups.select("group_id").join(own, "group_id", "left").join(F.broadcast(base)).select(
        "group_id", pick("provider", DEFAULT_PROVIDER).alias("provider"),
        clamp(pick("chunks_per_doc", d["chunks_per_doc"]), 1, 20).alias("chunks_per_doc"),
        clamp(pick("max_total_chunks", d["max_total_chunks"]), 1, 50).alias("max_total_chunks"),
        clamp(pick("similarity_threshold", d["similarity_threshold"]), 0.0, 1.0).alias("similarity_threshold"),
        pick("default_language", d["default_language"]).alias("default_language"))


def purge_user_from_group(membership: DataFrame, admins: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(membership, admins) without the (user_id, group_id) pairs of ``removals``."""
    on = ["user_id", "group_id"]
    return membership.join(removals, on, "left_anti"), admins.join(removals, on, "left_anti")
