"""Catalogue, governance, reports, set changes and stores (S, J9-J11, A, U, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import catalog
from folioscope.plans.graph_plans import GRAPH_SQL, build
from folioscope.plans.inputs import chunks, documents
from folioscope.plans.registry import query
from folioscope.plans.sql_parts import CHUNKS
from folioscope.session import read_table, scratch_path
from folioscope.sources import catalog_json, corpus, index_store

# roles of the tables: customer = users, nation = groups, supplier = group admins, documents by source = group files


def users(spark, sf):
    last = read_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_login"))
    return read_table(spark, sf, "customer").join(last, "c_custkey", "left").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), (F.col("c_acctbal") > 0).alias("is_active"),
        F.when(F.col("c_acctbal") > 9900, "admin").otherwise("user").alias("role"), "last_login")


def membership(spark, sf):
    c = read_table(spark, sf, "customer")
    first = c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("group_id"), F.lit(0).alias("ord"))
    second = c.filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("user_id"), ((F.col("c_nationkey") + 1) % 25).alias("group_id"), F.lit(1).alias("ord"))
    return first.unionByName(second)


def groups(spark, sf):
    return read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("name"))


def admins(spark, sf):
    return read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("group_id"), F.col("s_suppkey").alias("user_id"))


def group_documents(spark, sf):
    """Documents with the group key of their source."""
    return documents(spark, sf).withColumn("group_id", F.substring("source", 4, 9).cast("int"))


PEOPLE = """
us AS (SELECT c_custkey AS user_id, c_name AS username, c_acctbal > 0 AS is_active, CASE WHEN c_acctbal > 9900 THEN 'admin' ELSE 'user' END AS role, last_login, c_mktsegment
  FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_orderdate) AS last_login FROM orders GROUP BY 1) USING (c_custkey)),
mb AS (SELECT c_custkey AS user_id, c_nationkey AS group_id, 0 AS ord FROM customer
  UNION ALL SELECT c_custkey, (c_nationkey + 1) % 25, 1 FROM customer WHERE c_mktsegment = 'BUILDING'),
gr AS (SELECT n_nationkey AS group_id, n_name AS name FROM nation),
ad AS (SELECT s_nationkey AS group_id, s_suppkey AS user_id FROM supplier),
gd AS (SELECT *, substr(source, 4)::INT AS group_id FROM documents)"""

# ---------------------------------------------------------------- index state and access

_HAS = """
st AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM documents WHERE length(text) > 300) AS has_chunks,
  doc_id IN (SELECT vec_id FROM embeddings) AS has_vectors, doc_id IN (SELECT doc_id FROM labels) AS has_metadata FROM documents)"""


def _status(spark, sf):
    docs = documents(spark, sf)
    have = docs.filter(F.length("text") > 300)
    vectors = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return catalog.index_status(docs.select("doc_id"), have, vectors, read_table(spark, sf, "labels"))


@query("index_status", f"WITH {_HAS} SELECT * FROM st")
def _index_status(spark, sf):
    return _status(spark, sf)


@query("missing_index", "SELECT doc_id, source FROM documents WHERE text <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _missing(spark, sf):
    vectors = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return catalog.missing_index(documents(spark, sf), vectors).select("doc_id", "source")


@query("access_semi_join", f"""WITH {PEOPLE}, asked AS (SELECT user_id, role FROM us JOIN customer ON c_custkey = user_id
  WHERE customer.c_mktsegment = 'MACHINERY'),
per AS (SELECT DISTINCT user_id, group_id FROM mb JOIN asked USING (user_id) WHERE role <> 'admin'
  UNION SELECT user_id, group_id FROM asked, (SELECT DISTINCT group_id FROM gd) WHERE role = 'admin')
SELECT user_id, doc_id, group_id FROM gd JOIN per USING (group_id)""")
def _access(spark, sf):
    machinery = read_table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    asked = users(spark, sf).join(machinery, "user_id", "left_semi")
    docs = group_documents(spark, sf).select("doc_id", "group_id")
    return catalog.access_semi_join(docs, membership(spark, sf), asked).select("user_id", "doc_id", "group_id")


@query("access_counts", f"""WITH {PEOPLE}, pg AS (SELECT group_id, count(*) AS n FROM gd GROUP BY 1),
own AS (SELECT user_id, sum(n) AS n FROM (SELECT DISTINCT user_id, group_id FROM mb) JOIN pg USING (group_id) GROUP BY 1)
SELECT user_id, (CASE WHEN role = 'admin' THEN (SELECT count(*) FROM gd) ELSE coalesce(n, 0) END)::BIGINT AS n_visible FROM us LEFT JOIN own USING (user_id)""")
def _access_counts(spark, sf):
    return catalog.access_counts(group_documents(spark, sf), membership(spark, sf), users(spark, sf))


# ---------------------------------------------------------------- reports


@query("documents_by_group", """
SELECT coalesce(CASE WHEN doc_id % 7 <> 0 THEN source END, 'Uploaded') AS group_name,
  doc_id % 3 = 0 OR doc_id % 5 = 0 AS is_persistent, count(*) AS n_documents FROM documents GROUP BY ALL""")
def _by_group(spark, sf):
    i = F.col("doc_id")
    return catalog.documents_by_group(documents(spark, sf).select(
        F.when(i % 7 != 0, F.col("source")).alias("group_name"), F.when(i % 3 == 0, "folder").alias("origin"),
        F.when(i % 5 == 0, F.concat(F.lit("/files/"), i)).alias("file_path")))


@query("corpus_counters", """
SELECT count(*) AS total_documents, count(*) FILTER (WHERE o_orderdate::DATE = DATE '1998-08-02') AS uploaded_today,
  count(DISTINCT o_orderpriority) AS distinct_types FROM orders""")
def _corpus_counters(spark, sf):
    return catalog.corpus_counters(read_table(spark, sf, "orders"), F.lit("1998-08-02").cast("date"), "o_orderdate", "o_orderpriority")


@query("admin_counters", """
SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active_users,
  (SELECT count(*) FROM documents) AS documents""")
def _admin_counters(spark, sf):
    return catalog.admin_counters(users(spark, sf), documents(spark, sf))


_TAGS = "tg AS (SELECT doc_id, 'quality' AS tag FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)"


def tags(spark, sf):
    t = read_table(spark, sf, "labels")
    return t.filter("quality = 1").select("doc_id", F.lit("quality").alias("tag")).unionByName(
        t.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("tag")))


_LISTING = f"""WITH {_HAS}, {_TAGS}, tj AS (SELECT doc_id, string_agg(tag, ', ' ORDER BY tag) AS tags FROM tg GROUP BY 1),
d AS (SELECT *, strlen(text) AS nb FROM documents)
SELECT doc_id, doc_id || '_' || source || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.md' END AS filename,
  TIMESTAMP '2024-01-01' + to_hours(doc_id) AS uploaded_at, CASE WHEN doc_id % 2 = 0 THEN 'TXT' ELSE 'MD' END AS type,
  CASE WHEN nb < 1024 THEN printf('%.1f B', nb::DOUBLE) WHEN nb < 1048576 THEN printf('%.1f KB', nb / 1024e0) ELSE printf('%.1f MB', nb / 1048576e0) END AS size,
  coalesce(tags, 'Untagged') AS tags, has_chunks, has_vectors, has_metadata FROM d LEFT JOIN tj USING (doc_id) LEFT JOIN st USING (doc_id)"""


def _uploads(spark, sf):
    i = F.col("doc_id")
    return documents(spark, sf).select(
        "doc_id", F.concat("doc_id", F.lit("_"), "source", F.when(i % 2 == 0, ".txt").otherwise(".md")).alias("filename"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=i.cast("int"))).alias("uploaded_at"),
        F.octet_length("text").alias("n_bytes"))


@query("catalog_listing", _LISTING)
def _listing(spark, sf):
    return catalog.catalog_listing(_uploads(spark, sf), tags(spark, sf), _status(spark, sf))


@query("catalog_page", f"{_LISTING} ORDER BY uploaded_at DESC, doc_id LIMIT 50 OFFSET 100")
def _page(spark, sf):
    """The third page of fifty: it begins after the last row of the second."""
    docs = _uploads(spark, sf)
    shown = docs.orderBy(F.desc("uploaded_at"), "doc_id").limit(100).orderBy("uploaded_at", F.desc("doc_id")).first()
    return catalog.catalog_page(docs, tags(spark, sf), _status(spark, sf), 50, (shown["uploaded_at"], shown["doc_id"]))


@query("chunk_counts", f"WITH {CHUNKS} SELECT doc_id, lang, count(*) AS n_chunks, sum(length(chunk_text))::BIGINT AS n_chars FROM chunks GROUP BY 1, 2")
def _chunk_counts(spark, sf):
    return catalog.chunk_counts(chunks(spark, sf))


@query("language_mix", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def _language_mix(spark, sf):
    return catalog.language_mix(documents(spark, sf), "source")


@query("topk_per_key", """
SELECT source, doc_id, n_chars, rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents) WHERE rank <= 3""")
def _topk(spark, sf):
    return catalog.longest_documents(read_table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source")


@query("distinct_tags", f"WITH {_TAGS} SELECT DISTINCT tag FROM tg UNION SELECT 'all'")
def _distinct_tags(spark, sf):
    return catalog.distinct_tags(tags(spark, sf))


@query("feedback_summary", """
SELECT user_id % 200 AS document, count(*) FILTER (WHERE event_type = 'click') AS "like", count(*) FILTER (WHERE event_type = 'error') AS dislike
FROM events WHERE event_type IN ('click', 'error') GROUP BY 1""")
def _feedback_summary(spark, sf):
    votes = read_table(spark, sf, "events").filter("event_type in ('click', 'error')").select(
        (F.col("user_id") % 200).alias("document"), F.when(F.col("event_type") == "click", "like").otherwise("dislike").alias("vote"))
    return catalog.feedback_summary(votes)


# ---------------------------------------------------------------- set changes

_HIDDEN = "hid AS (SELECT DISTINCT source FROM documents WHERE source IN ('src1', 'src2', 'src3'))"


def _named_groups(spark, sf, names):
    return documents(spark, sf).filter(F.col("source").isin(names)).select(F.col("source").alias("group_id")).distinct()


@query("hide_group", "SELECT doc_id, source AS group_id FROM documents WHERE source NOT IN ('src1', 'src2', 'src3')")
def _hide(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.col("source").alias("group_id"))
    return catalog.hide_groups(docs, _named_groups(spark, sf, ["src1", "src2", "src3"]))


@query("restore_group", "SELECT doc_id, source AS group_id FROM documents WHERE source NOT IN ('src1', 'src3')")
def _restore(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.col("source").alias("group_id"))
    working = catalog.hide_groups(docs, _named_groups(spark, sf, ["src1", "src2", "src3"]))
    return catalog.restore_groups(working, docs, _named_groups(spark, sf, ["src2", "src4"]))


@query("delete_group_documents", f"WITH {CHUNKS} SELECT doc_id, chunk_id FROM chunks WHERE source NOT IN ('src5', 'src6')")
def _delete_group(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.col("source").alias("group_id"))
    return catalog.delete_group_documents(chunks(spark, sf).select("doc_id", "chunk_id"), docs, _named_groups(spark, sf, ["src5", "src6"]))


@query("merge_tags", f"""WITH {_TAGS}, ed AS (SELECT doc_id, CASE WHEN quality = 0 THEN '' ELSE ' reviewed, ,kept by ' || toxic END AS tt FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'en'))
SELECT doc_id, tag FROM tg WHERE doc_id NOT IN (SELECT doc_id FROM ed)
UNION ALL SELECT doc_id, trim(t) FROM (SELECT doc_id, unnest(CASE WHEN tt = '' THEN ['Untagged'] ELSE string_split(tt, ',') END) AS t FROM ed) WHERE trim(t) <> ''""")
def _merge_tags(spark, sf):
    other = documents(spark, sf).filter("lang <> 'en'").select("doc_id")
    edits = read_table(spark, sf, "labels").join(other, "doc_id", "left_semi").select("doc_id", F.when(
        F.col("quality") == 0, "").otherwise(F.concat(F.lit(" reviewed, ,kept by "), "toxic")).alias("tag_text"))
    return catalog.merge_tags(tags(spark, sf), edits)


@query("discover_groups", "SELECT DISTINCT source AS group_id, upper(source[1]) || substr(source, 2) AS name FROM documents")
def _discover(spark, sf):
    none = read_table(spark, sf, "nation").filter("n_name = ''").select(F.col("n_name").alias("group_id"), F.col("n_name").alias("name"))
    files = documents(spark, sf).select(F.col("source").alias("group_id"), F.initcap("source").alias("name")).distinct()
    index = read_table(spark, sf, "nation").select(F.col("n_name").alias("group_id"), F.col("n_name").alias("name"))
    return catalog.discover_groups(none, files, index)


# ---------------------------------------------------------------- users and groups


@query("memberships", f"""WITH {PEOPLE} SELECT user_id, group_id, name AS group_name, EXISTS (SELECT 1 FROM ad WHERE ad.group_id = mb.group_id AND ad.user_id = mb.user_id) AS is_admin
FROM mb JOIN gr USING (group_id)""")
def _memberships(spark, sf):
    return catalog.memberships(users(spark, sf), membership(spark, sf), groups(spark, sf), admins(spark, sf))


@query("primary_group", f"""WITH {PEOPLE} SELECT user_id, coalesce(g::VARCHAR, 'public') AS group_id
FROM us LEFT JOIN (SELECT user_id, arg_min(group_id, ord) AS g FROM mb JOIN us USING (user_id) WHERE is_active GROUP BY 1) USING (user_id)""")
def _primary(spark, sf):
    active = users(spark, sf).filter("is_active")
    return catalog.primary_group(users(spark, sf), membership(spark, sf).join(active, "user_id", "left_semi"))


@query("group_report", f"""WITH {PEOPLE} SELECT group_id, name, coalesce(n, 0) AS members_count, username AS member,
  EXISTS (SELECT 1 FROM ad WHERE ad.group_id = gr.group_id AND ad.user_id = mb.user_id) AS is_admin
FROM gr LEFT JOIN (SELECT group_id, count(*) AS n FROM mb GROUP BY 1) USING (group_id) LEFT JOIN mb USING (group_id) LEFT JOIN us USING (user_id)""")
def _group_report(spark, sf):
    return catalog.group_report(groups(spark, sf), membership(spark, sf), admins(spark, sf), users(spark, sf))


@query("user_report", f"""WITH {PEOPLE}, g1 AS (SELECT user_id, string_agg(name, ', ' ORDER BY name) AS g FROM mb JOIN gr USING (group_id) GROUP BY 1),
a1 AS (SELECT user_id, string_agg(name, ', ' ORDER BY name) AS a FROM ad JOIN gr USING (group_id) GROUP BY 1)
SELECT user_id, username, CASE WHEN is_active THEN 'Active' ELSE 'Inactive' END AS status, coalesce(strftime(last_login, '%Y-%m-%d %H:%M'), 'Never') AS last_login,
  CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'driver' ELSE '' END AS user_tag, coalesce(g, '') AS groups, coalesce(a, '') AS admin_groups
FROM us LEFT JOIN g1 USING (user_id) LEFT JOIN a1 USING (user_id)""")
def _user_report(spark, sf):
    tag = read_table(spark, sf, "customer").filter("c_mktsegment = 'AUTOMOBILE'").select(
        F.col("c_custkey").alias("user_id"), F.lit("driver").alias("user_tag"))
    return catalog.user_report(users(spark, sf), membership(spark, sf), groups(spark, sf), admins(spark, sf), tag)


@query("membership_violations", f"""WITH {PEOPLE}, nm AS (SELECT name FROM gr UNION ALL SELECT replace(name, '_', ' ') FROM gr)
SELECT 'several groups' AS rule, user_id::VARCHAR AS subject, count(DISTINCT group_id) AS n FROM mb GROUP BY user_id HAVING count(DISTINCT group_id) > 1
UNION ALL SELECT 'admin outside group', user_id::VARCHAR, count(*) FROM ad WHERE NOT EXISTS (SELECT 1 FROM mb WHERE mb.group_id = ad.group_id AND mb.user_id = ad.user_id) GROUP BY user_id
UNION ALL SELECT 'same id', replace(lower(name), ' ', '_'), count(*) FROM nm GROUP BY 2 HAVING count(*) > 1""")
def _violations(spark, sf):
    g = groups(spark, sf)
    twins = g.select("group_id", F.replace("name", F.lit("_"), F.lit(" ")).alias("name"))
    return catalog.membership_violations(membership(spark, sf), admins(spark, sf), g.unionByName(twins))


_SETTINGS = """
se AS (SELECT r_name AS group_id, CASE WHEN r_regionkey % 2 = 0 THEN 'claude' END AS provider, r_regionkey * 9 AS chunks_per_doc,
   CASE WHEN r_regionkey <> 1 THEN r_regionkey * 20 END AS max_total_chunks, CASE WHEN r_regionkey <> 2 THEN r_regionkey * 0.4e0 END AS similarity_threshold,
   CASE WHEN r_regionkey = 3 THEN 'id' END AS default_language FROM region),
df AS (SELECT 'gpt' AS provider, 4 AS chunks_per_doc, NULL::INT AS max_total_chunks, 0.6e0 AS similarity_threshold),
gi AS (SELECT r_name AS group_id FROM region UNION ALL SELECT n_name FROM nation)"""


def _settings_tables(spark, sf):
    r = F.col("r_regionkey")
    own = read_table(spark, sf, "region").select(
        F.col("r_name").alias("group_id"), F.when(r % 2 == 0, "claude").alias("provider"), (r * 9).alias("chunks_per_doc"),
        F.when(r != 1, r * 20).alias("max_total_chunks"), F.when(r != 2, r * F.lit(0.4)).alias("similarity_threshold"),
        F.when(r == 3, "id").alias("default_language"))
    fallback = spark.createDataFrame([("default", "gpt", 4, None, 0.6, None)], own.schema)
    ids = read_table(spark, sf, "region").select(F.col("r_name").alias("group_id")).unionByName(
        read_table(spark, sf, "nation").select(F.col("n_name").alias("group_id")))
    return ids, own.unionByName(fallback)


@query("resolve_settings", f"""WITH {_SETTINGS}
SELECT group_id, coalesce(se.provider, df.provider) AS provider, greatest(1, least(20, coalesce(se.chunks_per_doc, df.chunks_per_doc, 3))) AS chunks_per_doc,
  greatest(1, least(50, coalesce(se.max_total_chunks, df.max_total_chunks, 10))) AS max_total_chunks,
  greatest(0e0, least(1e0, coalesce(se.similarity_threshold, df.similarity_threshold, 0.75e0))) AS similarity_threshold,
  coalesce(default_language, 'en') AS default_language FROM gi LEFT JOIN se USING (group_id), df""")
def _resolve(spark, sf):
    return catalog.resolve_settings(*_settings_tables(spark, sf))


@query("resolve_provider", f"WITH {_SETTINGS} SELECT group_id, coalesce(se.provider, df.provider) AS provider FROM gi LEFT JOIN se USING (group_id), df")
def _provider(spark, sf):
    return catalog.resolve_settings(*_settings_tables(spark, sf)).select("group_id", "provider")


@query("purge_user_from_group", f"""WITH {PEOPLE}, rm AS (SELECT c_custkey AS user_id, c_nationkey AS group_id FROM customer WHERE c_acctbal < 0)
SELECT 'member' AS kind, user_id, group_id FROM mb WHERE (user_id, group_id) NOT IN (SELECT user_id, group_id FROM rm)
UNION ALL SELECT 'admin', user_id, group_id FROM ad WHERE (user_id, group_id) NOT IN (SELECT user_id, group_id FROM rm)""")
def _purge(spark, sf):
    gone = read_table(spark, sf, "customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("group_id"))
    left, leads = catalog.purge_user_from_group(membership(spark, sf).drop("ord"), admins(spark, sf), gone)
    cols = ["user_id", "group_id"]
    return left.select(F.lit("member").alias("kind"), *cols).unionByName(leads.select(F.lit("admin").alias("kind"), *cols))


# ---------------------------------------------------------------- sources and stores


@query("read_text_files", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unsupported type' WHEN doc_id % 5 = 0 THEN 'no content' END AS reason,
  CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN length(text)::INT END AS n_chars FROM documents""")
def _text_files(spark, sf):
    i = F.col("doc_id")
    payload = F.concat(F.when(i % 5 == 0, "").otherwise(F.lit("data:text/plain;base64,")), F.base64(F.col("text").cast("binary")))
    files = corpus.decode_payloads(documents(spark, sf).select(
        "doc_id", F.concat("doc_id", F.when(i % 3 == 0, ".exe").otherwise(".txt")).alias("filename"),
        F.when((i % 5 == 0) & (i % 3 != 0), F.lit("data:text/plain;base64,%%")).otherwise(payload).alias("payload")))
    good, bad = corpus.read_text_files(files)
    return good.select("doc_id", F.lit(None).cast("string").alias("reason"), F.length("text").alias("n_chars")).unionByName(
        bad.select("doc_id", "reason", F.lit(None).cast("int").alias("n_chars")))


@query("read_chunk_maps", f"""WITH {CHUNKS} SELECT doc_id, 'chunk_' || chunk_index AS chunk_key, chunk_text AS text, doc_id || '.txt' AS filename, lang AS language FROM chunks""")
def _chunk_maps(spark, sf):
    """One map per document, in sequences of many maps in a folder per group; the document is named in its entries."""
    entry = F.struct(F.concat(F.lit("chunk_"), "chunk_index").alias("key"), F.struct(
        F.col("chunk_text").alias("text"), F.concat("doc_id", F.lit(".txt")).alias("filename"), F.col("lang").alias("language")).alias("value"))
    maps = chunks(spark, sf).groupBy("source", "doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    path = scratch_path(spark, "chunk-maps")
    catalog_json.write_json_sequences(maps, path, "source")
    rows = catalog_json.chunk_maps(catalog_json.read_json_texts(spark, path))
    return rows.select(F.regexp_extract("filename", "^(.*)[.]txt$", 1).cast("bigint").alias("doc_id"), "chunk_key", "text", "filename", "language")


@query("read_catalog_json", """
SELECT 'group' AS kind, n_nationkey::VARCHAR AS id, n_name AS value FROM nation UNION ALL SELECT 'membership', c_custkey::VARCHAR, c_nationkey::VARCHAR FROM customer
UNION ALL SELECT 'tag', doc_id::VARCHAR, 'q' || quality FROM labels UNION ALL SELECT 'user tag', s_suppkey::VARCHAR, s_name FROM supplier
UNION ALL SELECT 'settings', r_name, 'gpt/' || r_regionkey FROM region UNION ALL SELECT 'settings', 'default', 'azure/3'
""")
def _catalog_json(spark, sf):
    path = scratch_path(spark, "catalogue")

    def filed(objects, name):  # files of one object per line, so that a large map is split over files
        objects.write.text(f"{path}/{name}")
        return catalog_json.read_json_lines(spark, f"{path}/{name}")

    def stored(df, key, value):
        return filed(df.select(F.to_json(F.create_map(F.col(key).cast("string"), value)).alias("value")), key)
    nation, customer = read_table(spark, sf, "nation"), read_table(spark, sf, "customer")
    g = catalog_json.group_rows(stored(nation, "n_nationkey", F.struct(F.col("n_name").alias("name"))))
    m = catalog_json.membership_rows(stored(customer, "c_custkey", F.array(F.col("c_nationkey").cast("string"))))
    t = catalog_json.document_tag_rows(stored(read_table(spark, sf, "labels"), "doc_id", F.array(F.concat(F.lit("q"), "quality"))))
    u = catalog_json.user_tag_rows(stored(read_table(spark, sf, "supplier"), "s_suppkey", F.col("s_name")))
    r = read_table(spark, sf, "region").select(F.to_json(F.struct(
        F.lit("azure").alias("default"), F.create_map("r_name", F.lit("gpt")).alias("groups"),
        F.create_map("r_name", F.struct(F.col("r_regionkey").alias("chunks_per_doc"))).alias("retrieval_params"))).alias("value"))
    s = catalog_json.settings_rows(filed(r, "settings")).groupBy("group_id").agg(F.max("provider").alias("p"), F.max("chunks_per_doc").alias("c"))
    row = lambda df, kind, i, v: df.select(F.lit(kind).alias("kind"), F.col(i).alias("id"), v.alias("value"))
    out = row(g, "group", "group_id", F.col("name"))
    for part in (row(m, "membership", "user_id", F.col("group_id")), row(t, "tag", "doc_id", F.col("tag")),
                 row(u, "user tag", "user_id", F.col("user_tag")),
                 row(s, "settings", "group_id", F.concat_ws("/", "p", F.coalesce("c", F.lit(3))))):
        out = out.unionByName(part)
    return out


def _index_rows(spark, sf):
    return chunks(spark, sf).select(F.col("source").alias("group_id"), "doc_id", F.concat("doc_id", F.lit(".txt")).alias("filename"),
                                    "chunk_id", "chunk_index", "chunk_text")


@query("write_index", f"WITH {CHUNKS} SELECT source AS group_id, doc_id, doc_id || '.txt' AS filename, chunk_id, chunk_index, chunk_text FROM chunks")
def _write_index(spark, sf):
    path = scratch_path(spark, "index")
    index_store.write_index(_index_rows(spark, sf), path)
    return spark.read.parquet(path)


@query("export_json", f"WITH {CHUNKS} SELECT chunk_id, chunk_index::BIGINT AS chunk_index, '2024-01-02T03:04:05.000006' AS created_at FROM chunks")
def _export_json(spark, sf):
    path = scratch_path(spark, "records")
    index_store.export_json(chunks(spark, sf).select(
        "chunk_id", "chunk_index", F.lit("2024-01-02 03:04:05.000006").cast("timestamp").alias("created_at")), path)
    return spark.read.schema("chunk_id string, chunk_index long, created_at string").json(path)


@query("upsert_chunks", f"""WITH {CHUNKS} SELECT chunk_id, CASE WHEN source = 'src3' THEN 'new ' || chunk_text ELSE chunk_text END AS chunk_text,
  CASE WHEN source = 'src3' THEN 2 ELSE 1 END AS version FROM chunks""")
def _upsert(spark, sf):
    old = chunks(spark, sf).select("chunk_id", "chunk_text", F.lit(1).alias("version"))
    new = chunks(spark, sf).filter("source = 'src3'").select("chunk_id", F.concat(F.lit("new "), "chunk_text").alias("chunk_text"), F.lit(2).alias("version"))
    return index_store.upsert_chunks(old, new)


@query("delete_document", f"WITH {CHUNKS} SELECT source AS group_id, chunk_id FROM chunks WHERE source <> 'src7' AND NOT (source = 'src8' AND lang = 'en')")
def _delete(spark, sf):
    path = scratch_path(spark, "index")
    index_store.write_index(_index_rows(spark, sf), path)
    gone = documents(spark, sf).filter("source = 'src7' or (source = 'src8' and lang = 'en')").select(
        F.col("source").alias("group_id"), F.concat("doc_id", F.lit(".txt")).alias("filename"))
    index_store.delete_from_index(spark, path, gone)
    return spark.read.parquet(path).select("group_id", "chunk_id")


@query("append_feedback", """
SELECT ts::TIMESTAMP AS ts, 'q' || event_id AS query, event_type AS vote, user_id::VARCHAR AS document FROM events WHERE event_type IN ('click', 'error')""")
def _append(spark, sf):
    path = scratch_path(spark, "feedback")
    for kind in ("click", "error"):
        index_store.append_feedback(read_table(spark, sf, "events").filter(F.col("event_type") == kind).select(
            "ts", F.concat(F.lit("q"), "event_id").alias("query"), F.lit("").alias("response"), F.col("event_type").alias("vote"),
            F.col("user_id").cast("string").alias("document")), path)
    return spark.read.parquet(path).drop("response")


@query("write_graph", f"""WITH RECURSIVE {GRAPH_SQL} SELECT 'node' AS part, type, count(*) AS n FROM gn GROUP BY type
UNION ALL SELECT 'edge', type, count(*) FROM fe WHERE type <> 'keyword' GROUP BY type UNION ALL SELECT 'hub', 'keyword', count(*) FROM km WHERE n > 1""")
def _write_graph(spark, sf):
    path = scratch_path(spark, "graph")
    g = build(spark, sf, keep=True)
    index_store.write_graph(g.nodes, g.edges, g.hubs, path)
    nodes, edges, hubs = index_store.read_graph(spark, path)
    n = F.count(F.lit(1)).alias("n")
    return (
        nodes.groupBy("type").agg(n).select(F.lit("node").alias("part"), "type", "n")
        .unionByName(edges.groupBy("type").agg(n).select(F.lit("edge").alias("part"), "type", "n"))
        .unionByName(hubs.agg(n).select(F.lit("hub").alias("part"), F.lit("keyword").alias("type"), "n"))
    )
