"""Named queries of the core engine on the supplied tables, and the DuckDB SQL that gives the same rows.

The tables stand in for the engine's own: embeddings for children (label is the parent), documents for parents, orders
for the document catalogue, customers for users, conversations for messages, pages for parsed documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import markup
from lodestone.functions import text as T
from lodestone.functions import validation as V
from lodestone.operators import catalog, chunking, diff, retrieve, sections, sessions, vector
from lodestone.plans import service
from lodestone.sources import adapters, store
from lodestone.sources.layout import spread
from lodestone.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# vector search and retrieval


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as children; label is the parent, and the text is made of the id."""
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("parent_id"), F.concat(F.lit(" excerpt "), F.col("vec_id").cast("string")).alias("text"), "embedding")


def _query_vector(children: DataFrame, key: int = 0) -> list[float]:
    return children.where(F.col("id") == key).first()["embedding"]


_SCORED = """
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)) AS score FROM embeddings)"""


@_query(f"WITH {_SCORED} SELECT vec_id AS id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rank FROM s ORDER BY score DESC, vec_id LIMIT 5")
def vector_topk(spark, sf_dir):
    children = _children(spark, sf_dir)
    return vector.topk(children, _query_vector(children), 5).select("id", F.round("score", 6).alias("score"), "rank")


@_query(f"WITH {_SCORED} SELECT vec_id AS id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rank FROM s WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 5")
def vector_topk_filtered(spark, sf_dir):
    children = _children(spark, sf_dir)
    only = spark.range(3, 4).select(F.col("id").alias("parent_id"))
    return vector.topk(children, _query_vector(children), 5, only=only, only_key="parent_id").select("id", F.round("score", 6).alias("score"), "rank")


def _metric(metric: str, sql: str):
    """Searches: every fiftieth id, against all rows."""

    def run(spark, sf_dir):
        children = _children(spark, sf_dir)
        return vector.batch_topk(children, children.where("id % 50 = 0").select("id", "embedding"), 5, metric).select("query_id", "id", F.round("score", 6).alias("score"), "rank")

    run.__name__ = "vector_topk_batch" if metric == "cosine" else f"vector_topk_{metric}"
    return _query(f"""
SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS id, {sql} AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 50 = 0 AND a.embedding IS NOT NULL AND len(b.embedding) = len(a.embedding))) WHERE rank <= 5""")(run)


_metric("cosine", "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])")
_metric("dot", "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])")
_metric("l2", "-list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])")


def _hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    children = _children(spark, sf_dir)
    found = vector.topk(children, _query_vector(children), k)
    return found.join(children.select("id", "parent_id", "text"), "id").select("rank", "parent_id", "text")


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("index"), "text")


_HITS = f"""WITH {_SCORED},
h AS (SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS rank, label AS parent_id, 'excerpt ' || vec_id AS text FROM s ORDER BY score DESC, vec_id LIMIT 20)"""


@_query(f"""{_HITS},
p AS (SELECT parent_id, min(rank) AS rank, string_agg(text, chr(10) ORDER BY rank) AS snippets FROM h GROUP BY parent_id),
b AS (SELECT p.rank, 'Parent section (' || d.doc_id || '):' || chr(10) || d.text || chr(10) || chr(10) || 'Relevant child excerpts:' || chr(10) || p.snippets AS block
      FROM p JOIN documents d ON d.doc_id = p.parent_id)
SELECT string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context_text,
       (SELECT count(*) FROM h) AS retrieved_children, count(*) AS retrieved_parents FROM b""")
def retrieve_context(spark, sf_dir):
    return retrieve.context(_hits(spark, sf_dir, 20), _parents(spark, sf_dir))


@_query(f"{_HITS} SELECT parent_id::BIGINT AS parent_id, CAST(min(rank) AS INT) AS rank FROM h GROUP BY parent_id")
def parent_dedup_rank(spark, sf_dir):
    return retrieve.ranked_parents(_hits(spark, sf_dir, 20))


@_query("SELECT vec_id AS id FROM embeddings WHERE len(embedding) IS DISTINCT FROM 64")
def embedding_dim_check(spark, sf_dir):
    return V.wrong_dimension(_children(spark, sf_dir), 64).select("id")


@_query("SELECT vec_id AS id, CAST((row_number() OVER (ORDER BY vec_id) - 1) // 20 AS BIGINT) AS batch FROM embeddings")
def batch_assign(spark, sf_dir):
    return adapters.assign_batches(_children(spark, sf_dir), "id")


@_query("SELECT item_id AS id, 32::INT AS dimensions FROM benchmark")
def embed_passages(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    settings = adapters.Settings(dimensions=32, batch_delay_ms=0)
    return adapters.embed_children(rows, lambda: adapters.HashEmbedder(32), settings).select("id", F.size("embedding").alias("dimensions"))


# catalogue


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("email"))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "F", "deleted").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("size"))


_CATALOGUE = "c AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderstatus = 'F' THEN 'deleted' ELSE o_orderstatus END AS status, o_orderdate AS created_at, o_totalprice AS size FROM orders)"


@_query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS email FROM customer WHERE regexp_matches(c_name, '(?i)er#0+1') OR regexp_matches(c_mktsegment, '(?i)er#0+1') OR regexp_matches(c_mktsegment, '(?i)^mach')")
def user_search(spark, sf_dir):
    return catalog.search(_users(spark, sf_dir), "er#0+1|^mach", ("name", "email"))


@_query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS email FROM customer WHERE contains(lower(c_name), 'r#00000001') OR contains(lower(c_mktsegment), 'r#00000001')")
def user_search_literal(spark, sf_dir):
    return catalog.search(_users(spark, sf_dir), "R#00000001", ("name", "email"), literal=True)


@_query(f"WITH {_CATALOGUE} SELECT * FROM c WHERE status IS DISTINCT FROM 'deleted' ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def list_documents_page(spark, sf_dir):
    return catalog.page_of(catalog.undeleted(_catalogue(spark, sf_dir)), [F.desc("created_at"), F.col("id")], 3, 20)


@_query(f"WITH {_CATALOGUE} SELECT 3::INT AS page, 20::INT AS \"limit\", count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM c WHERE status IS DISTINCT FROM 'deleted'")
def pagination_meta(spark, sf_dir):
    return catalog.pagination(catalog.undeleted(_catalogue(spark, sf_dir)), 3, 20)


@_query("SELECT o_orderkey AS id, o_totalprice AS size, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS parent_count FROM orders")
def document_with_parent_count(spark, sf_dir):
    return catalog.with_count(_catalogue(spark, sf_dir).select("id", "size"), "id", _table(spark, sf_dir, "lineitem"), "l_orderkey")


@_query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS email FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf_dir):
    return catalog.lookup(_users(spark, sf_dir), "id", 42)


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def semi_lookup(spark, sf_dir):
    gone = _catalogue(spark, sf_dir).where("status = 'deleted'").select(F.col("id").alias("l_orderkey"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_semi")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def cascade_delete(spark, sf_dir):
    gone = _catalogue(spark, sf_dir).where("status = 'deleted'")
    return store.delete_by_ids(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


@_query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 0 THEN 'deleted' WHEN o_orderstatus = 'F' THEN 'deleted' ELSE o_orderstatus END AS status FROM orders")
def soft_delete(spark, sf_dir):
    return store.update_where(_catalogue(spark, sf_dir), F.col("user_id") % 10 == 0, status=F.lit("deleted")).select("id", "status")


@_query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'user ' || c_custkey ELSE c_name END AS name, c_mktsegment AS email FROM customer")
def patch_users(spark, sf_dir):
    users = _users(spark, sf_dir)
    return store.patch(users, users.where("id % 7 = 0").select("id", F.concat(F.lit("user "), F.col("id").cast("string")).alias("name")))


@_query("SELECT c_custkey AS id, c_name AS name FROM customer a WHERE EXISTS (SELECT 1 FROM customer b WHERE b.c_name = a.c_name AND b.c_custkey IS DISTINCT FROM a.c_custkey + 1)")
def email_conflict(spark, sf_dir):
    users = _users(spark, sf_dir)
    candidates = users.select((F.col("id") + 1).alias("id"), "name")
    return catalog.conflicts(candidates, users, "name", "id").select((F.col("id") - 1).alias("id"), "name")


@_query("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'A valid email is required.' WHEN length(c_name) < 18 THEN 'Password is required and must be at least 6 characters long.' END AS error FROM customer")
def user_validation(spark, sf_dir):
    mail = F.when(F.col("email") == "MACHINERY", F.lit("a@b")).otherwise(F.concat(F.lit(" "), "email", F.lit("@Example.org ")))
    password = F.when(F.length("name") < 18, "12345").otherwise("123456")
    return _users(spark, sf_dir).select("id", V.user_error(F.col("name"), mail, password, F.lit(None).cast("string")).alias("error"))


@_query(f"""
WITH n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_name END AS name, 'u' || (c_custkey % 100) || '@example.org' AS email, CASE WHEN c_custkey % 7 = 0 THEN 'abc' ELSE 'secret' END AS password,
             CASE WHEN c_custkey % 13 = 0 THEN 'owner' WHEN c_custkey % 3 = 0 THEN 'editor' END AS role FROM customer),
e AS (SELECT *, CASE WHEN trim(name) = '' THEN 'Name is required.' WHEN length(password) < 6 THEN 'Password is required and must be at least 6 characters long.' WHEN role NOT IN ('user', 'editor', 'admin') THEN 'Invalid role.' END AS error FROM n),
f AS (SELECT email, min(id) AS first_id FROM e WHERE error IS NULL GROUP BY email)
SELECT id, email, coalesce(error, CASE WHEN id % 10 = 0 OR id <> first_id THEN '{catalog.TAKEN}' END) AS error, CASE WHEN error IS NULL AND id % 10 <> 0 AND id = first_id THEN coalesce(role, 'user') END AS role
FROM e LEFT JOIN f USING (email)""")
def create_users(spark, sf_dir):
    """All customers as new users; some addresses are taken, and each comes several times."""
    key = F.col("id")
    address = F.concat(F.lit(" U"), (key % 100).cast("string"), F.lit("@Example.org "))
    role = F.when(key % 13 == 0, "owner").when(key % 3 == 0, "editor")
    new = _users(spark, sf_dir).select("id", F.when(key % 11 == 0, " ").otherwise(F.col("name")).alias("name"), address.alias("email"), F.when(key % 7 == 0, "abc").otherwise("secret").alias("password"), role.alias("role"), F.lit(None).cast("boolean").alias("is_active"))
    held = new.where(key % 10 == 0).select(F.lower(T.trim(F.col("email"))).alias("email"))
    good, bad = catalog.create_users(held, new, F.lit("2024-01-01").cast("timestamp"))
    return good.select("id", "email", F.lit(None).cast("string").alias("error"), "role").unionByName(bad.select("id", "email", "error", F.lit(None).cast("string").alias("role")))


@_query(f"""
WITH u AS (SELECT c_custkey AS id, c_name AS name, 'u' || c_custkey || '@x.org' AS email FROM customer),
n AS (SELECT id, CASE id % 4 WHEN 0 THEN 'u' || (id + 1) || '@x.org' WHEN 2 THEN 'new' || (id % 50) || '@x.org' END AS email FROM u),
f AS (SELECT email, min(id) AS first_id FROM n WHERE email IS NOT NULL GROUP BY email)
SELECT u.id, CASE WHEN u.id % 4 = 1 THEN 'x' ELSE u.name END AS name,
       CASE WHEN n.email IS NOT NULL AND f.first_id = u.id AND NOT EXISTS (SELECT 1 FROM u b WHERE b.email = n.email) THEN n.email ELSE u.email END AS email,
       CASE WHEN u.id % 4 = 3 THEN 'Invalid role.' WHEN n.email IS NOT NULL AND (f.first_id <> u.id OR EXISTS (SELECT 1 FROM u b WHERE b.email = n.email)) THEN '{catalog.TAKEN}' END AS error
FROM u JOIN n USING (id) LEFT JOIN f ON f.email = n.email""")
def update_users(spark, sf_dir):
    """A patch for every user: to an address that is held, to one that several want, to a name, to an unknown role."""
    key = F.col("id")
    address = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts], F.lit("@x.org"))
    users = _users(spark, sf_dir).select("id", "name", address("u", key.cast("string")).alias("email"), F.lit("h").alias("password"), F.lit("user").alias("role"), F.lit(True).alias("is_active"), F.lit(None).cast("timestamp").alias("updated_at"))
    mail = F.when(key % 4 == 0, address("u", (key + 1).cast("string"))).when(key % 4 == 2, address("NEW", (key % 50).cast("string")))
    none = F.lit(None)
    patches = users.select("id", F.when(key % 4 == 1, " x ").alias("name"), mail.alias("email"), none.cast("string").alias("password"), F.when(key % 4 == 3, "boss").alias("role"), none.cast("boolean").alias("is_active"))
    after, rejected = catalog.update_users(users, patches, F.lit("2024-01-01").cast("timestamp"))
    return after.select("id", "name", "email").join(rejected, "id", "left")


@_query("""SELECT c_custkey AS id, c_custkey % 4 <> 1 AS created, c_custkey % 4 <> 0 AND (c_custkey % 4 <> 1) AND NOT (c_custkey % 4 = 2 AND c_custkey % 3 = 0) AS updated FROM customer""")
def active_flags(spark, sf_dir):
    """Values of several types for a flag: on creation only real booleans count, in an update truthiness does."""
    key = F.col("id")
    given = F.when(key % 4 == 0, "").when(key % 4 == 1, "false").when(key % 4 == 2, (key % 3).cast("string")).otherwise("false")
    kind = F.when(key % 4 == 1, "boolean").when(key % 4 == 2, "number").otherwise("string")
    return _users(spark, sf_dir).select("id", V.active_on_create(given, kind).alias("created"), V.truthy(given, kind).alias("updated"))


# content and incremental re-ingest


@_query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents of one source as a file's sections, before and after a third went, a third came, and half of the rest moved."""
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("document_id"), "doc_id", "text", T.content_hash(F.col("text")).alias("content_hash"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"))
    old = rows.where("doc_id % 3 < 2").select(F.col("doc_id").alias("id"), "document_id", F.col("doc_id").alias("index"), "text", "content_hash", "start_page", "end_page")
    new = rows.where("doc_id % 3 > 0").select("document_id", (F.col("doc_id") + F.col("doc_id") % 2 * 10_000_000_000).alias("index"), "text", "content_hash", "start_page", "end_page")
    return old, new


_VERSIONS = """
o AS (SELECT doc_id AS id, source AS document_id, doc_id AS idx, sha256(text) AS content_hash FROM documents WHERE doc_id % 3 < 2),
n AS (SELECT source AS document_id, doc_id + doc_id % 2 * 10000000000 AS idx, sha256(text) AS content_hash FROM documents WHERE doc_id % 3 > 0),
o2 AS (SELECT *, row_number() OVER (PARTITION BY document_id, content_hash ORDER BY idx, id) AS occurrence FROM o),
n2 AS (SELECT *, row_number() OVER (PARTITION BY document_id, content_hash ORDER BY idx) AS occurrence FROM n),
d AS (SELECT coalesce(o2.document_id, n2.document_id) AS document_id, coalesce(o2.content_hash, n2.content_hash) AS content_hash,
             coalesce(o2.occurrence, n2.occurrence) AS occurrence, o2.id AS old_id, n2.idx AS new_index,
             CASE WHEN o2.id IS NULL THEN 'changed' WHEN n2.idx IS NULL THEN 'removed' WHEN o2.idx = n2.idx THEN 'unchanged' ELSE 'reposition' END AS state
      FROM o2 FULL JOIN n2 ON o2.document_id = n2.document_id AND o2.content_hash = n2.content_hash AND o2.occurrence = n2.occurrence)"""


@_query(f"WITH {_VERSIONS} SELECT document_id, content_hash, CAST(occurrence AS INT) AS occurrence, coalesce(old_id, -1) AS old_id, coalesce(new_index, -1) AS new_index, state FROM d")
def diff_classify(spark, sf_dir):
    found = diff.classify(*_versions(spark, sf_dir))
    return found.select("document_id", "content_hash", "occurrence", F.coalesce("old_id", F.lit(-1)).alias("old_id"), F.coalesce("new_place.index", F.lit(-1)).alias("new_index"), "state")


@_query(f"""WITH {_VERSIONS} SELECT document_id, count(*) FILTER (state <> 'removed') AS parents_total, count(*) FILTER (state IN ('unchanged', 'reposition')) AS parents_unchanged,
count(*) FILTER (state = 'changed') AS parents_changed_or_added, count(*) FILTER (state = 'removed') AS parents_removed FROM d GROUP BY document_id""")
def diff_counters(spark, sf_dir):
    return diff.counters(diff.classify(*_versions(spark, sf_dir)))


@_query(f"WITH {_VERSIONS} SELECT document_id, content_hash, idx AS \"index\" FROM n")
def diff_apply(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return diff.apply(diff.classify(old, new), old).select("document_id", "content_hash", "index")


@_query("SELECT source AS document_id, count(*) AS sections, count(*) AS ids, count(DISTINCT sha256(text)) AS contents FROM documents WHERE doc_id % 3 < 2 GROUP BY source")
def diff_reapply(spark, sf_dir):
    """A file's versions one, two, two reversed and one again: as many ids as sections at the end, though contents came back."""
    old, new = _versions(spark, sf_dir)
    state = old
    for version in (new, new.withColumn("index", -F.col("index")), old.drop("id")):
        state = diff.apply(diff.classify(state, version), state)
    return state.groupBy("document_id").agg(F.count(F.lit(1)).alias("sections"), F.countDistinct("id").alias("ids"), F.countDistinct("content_hash").alias("contents"))


@_query(f"WITH {_VERSIONS} SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT old_id FROM d WHERE state = 'removed')")
def diff_children(spark, sf_dir):
    children = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent_id"), "l_linenumber")
    return diff.surviving_children(diff.classify(*_versions(spark, sf_dir)), children).select(F.col("parent_id").alias("l_orderkey"), "l_linenumber")


# sections and passages


_SPACE = "[\\t\\n\\x0b\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every heading and paragraph of web pages with its whole text as parsed documents; four nodes make a page."""
    rows = spread(_table(spark, sf_dir, "pages")).select(F.col("page_id").cast("string").alias("doc_id"), markup.html_elements(F.col("html")).alias("found")).where(F.size("found") > 0)
    at = F.sequence(F.lit(0), F.size("found") - 1)
    nodes = F.transform(at, lambda i: F.struct(i.alias("seq"), F.lit(0).alias("depth"), F.upper(F.get("found", i)["tag"]).alias("type"), F.lit(None).cast("string").alias("actual_text"), F.array(i.cast("long")).alias("mcids")))
    items = lambda n: F.transform(F.slice(at, n * 4 + 1, F.lit(4)), lambda i: F.struct(i.cast("long").alias("mcid"), F.get("found", i)["text"].alias("text")))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("found") - 1) / 4).cast("int")), lambda n: F.struct((n + 1).alias("page_num"), F.lit("").alias("text"), items(n).alias("text_items")))
    return rows.select("doc_id", F.array_join(F.col("found.text"), "\n").alias("text"), pages.alias("pages"), nodes.alias("nodes"))


_BLOCKS = "|".join(sorted(markup.BLOCK))
_PLAIN = r"regexp_replace(html, '(?is)<!--.*?-->|<(?:script|style|template|title|textarea|noscript|iframe)(?:\s[^>]*)?>.*?</(?:script|style|template|title|textarea|noscript|iframe)\s*>', '', 'g')"
_PLAIN = rf"regexp_replace({_PLAIN}, '(?i)<(h[1-6]|p)(?:\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g')"
_PLAIN = rf"regexp_replace({_PLAIN}, '(?i)</?(?:{_BLOCKS})(?:\s[^>]*)?>', chr(1) || chr(2), 'g')"
_PLAIN = f"regexp_replace(regexp_replace({_PLAIN}, '(?i)<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')"


@_query(f"""
WITH t AS (SELECT page_id, string_split({_PLAIN}, chr(1)) AS pieces FROM pages),
u AS (SELECT page_id, unnest(range(len(pieces))) AS place, unnest(pieces) AS piece FROM t),
e AS (SELECT page_id, place, lower(split_part(piece, chr(2), 1)) AS tag, replace(replace(replace(replace(split_part(piece, chr(2), 2), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS raw FROM u WHERE contains(piece, chr(2))),
f AS (SELECT page_id, place, tag, regexp_replace(regexp_replace(raw, '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS text FROM e WHERE tag <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS seq, CASE WHEN tag <> 'p' THEN CAST(substr(tag, 2) AS INT) END AS level FROM f WHERE text <> ''),
s AS (SELECT *, seq // 4 + 1 AS page, level IS NOT NULL AND (level = 1 OR count(level) OVER (PARTITION BY page_id ORDER BY seq) = 1) AS starts FROM n),
p AS (SELECT *, sum(starts::INT) OVER (PARTITION BY page_id ORDER BY seq) AS parent_no FROM s),
g AS (SELECT page_id, parent_no, string_agg(CASE WHEN level IS NULL THEN text ELSE repeat('#', level) || ' ' || text END, chr(10) || chr(10) ORDER BY seq) FILTER (NOT starts) AS text,
             min(page) AS start_page, max(page) FILTER (starts OR level IS NULL) AS end_page FROM p WHERE parent_no > 0 GROUP BY ALL)
SELECT CAST(page_id AS VARCHAR) AS document_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY parent_no) - 1 AS INT) AS "index", text, sha256(text) AS content_hash,
       CAST(start_page AS INT) AS start_page, CAST(end_page AS INT) AS end_page FROM g WHERE text IS NOT NULL""")
def section_parents(spark, sf_dir):
    """Sections of all headings and paragraphs, whole."""
    return sections.section_parents(_parsed(spark, sf_dir)).drop("id")


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as parsed documents without structure: a page for each turn, its role and text as marked content."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    item = F.struct((F.col("turn") % 3).alias("mcid"), F.col("text"))
    page = F.struct("turn", F.struct((F.col("turn") + 1).cast("int").alias("page_num"), F.when(F.col("role") == "system", "  ").otherwise(F.col("text")).alias("text"), F.array(item).alias("text_items")).alias("page"))
    pages = F.transform(F.array_sort(F.collect_list(page)), lambda p: p["page"])
    return rows.groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(pages.alias("pages")).select("doc_id", F.lit("").alias("text"), "pages", F.expr("CAST(array() AS array<struct<seq:int,depth:int,type:string,actual_text:string,mcids:array<bigint>>>)").alias("nodes"))


@_query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn % 3 AS mcid, string_agg(text, ' ' ORDER BY turn) AS text, CAST(min(turn) + 1 AS INT) AS page FROM conversations WHERE text <> '' GROUP BY ALL")
def marked_content(spark, sf_dir):
    return sections.marked_content(_talks(spark, sf_dir))


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as parsed documents with structure: a node for each turn, of every level and at two depths, some without a page."""
    rows = _table(spark, sf_dir, "conversations").where("turn IS NOT NULL").select("conv_id", "turn", "role", "text")
    kind = F.when(F.col("role") == "assistant", "P").otherwise(F.concat(F.lit("h"), (F.col("turn") % 4 + 1).cast("string")))
    node = F.struct(F.col("turn").cast("int").alias("seq"), (F.col("turn") % 2).cast("int").alias("depth"), kind.alias("type"), F.lit(None).cast("string").alias("actual_text"), F.array(F.col("turn").cast("long")).alias("mcids"))
    item = F.struct(F.col("turn").cast("long").alias("mcid"), F.col("text"))
    page = F.struct("turn", F.struct(F.when(F.col("turn") % 3 == 2, 0).otherwise(F.col("turn") + 1).cast("int").alias("page_num"), F.lit("").alias("text"), F.array(item).alias("text_items")).alias("page"))
    pages = F.transform(F.array_sort(F.collect_list(page)), lambda p: p["page"])
    return rows.groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(pages.alias("pages"), F.array_sort(F.collect_list(node)).alias("nodes")).select("doc_id", F.lit("").alias("text"), "pages", "nodes")


@_query(f"""
WITH n AS (SELECT conv_id, turn AS seq, turn % 2 AS depth, CASE WHEN role = 'assistant' THEN NULL ELSE turn % 4 + 1 END AS level, CASE WHEN turn % 3 = 2 OR text IS NULL OR text = '' THEN NULL ELSE turn + 1 END AS page,
             regexp_replace(regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS text FROM conversations WHERE turn IS NOT NULL),
s AS (SELECT *, level IS NOT NULL AND (level = 1 OR count(level) OVER (PARTITION BY conv_id ORDER BY seq) = 1) AS starts FROM n),
p AS (SELECT *, sum(starts::INT) OVER (PARTITION BY conv_id ORDER BY seq) AS parent_no FROM s),
a AS (SELECT *, coalesce(page, CASE WHEN depth = 0 OR parent_no = 1 THEN 1 END) AS anchor FROM p WHERE parent_no > 0),
i AS (SELECT *, CASE WHEN starts THEN anchor WHEN level IS NULL AND text <> '' THEN page END AS own, sum((starts AND anchor IS NOT NULL)::INT) OVER (PARTITION BY conv_id ORDER BY seq) AS island FROM a),
r AS (SELECT *, max(own) OVER (PARTITION BY conv_id, island ORDER BY seq) AS reached FROM i),
g AS (SELECT conv_id, parent_no, regexp_replace(string_agg(CASE WHEN level IS NULL THEN text ELSE repeat('#', CAST(level AS INT)) || ' ' || text END, chr(10) || chr(10) ORDER BY seq) FILTER (NOT starts AND (level IS NOT NULL OR text <> '')), '{_SPACE}+$', '') AS text,
             max(reached) FILTER (starts) AS start_page, max(reached) AS end_page FROM r GROUP BY ALL)
SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY parent_no) - 1 AS INT) AS "index", text, sha256(text) AS content_hash,
       CAST(start_page AS INT) AS start_page, CAST(end_page AS INT) AS end_page FROM g WHERE text <> ''""")
def section_tree(spark, sf_dir):
    """Sections of documents with deeper headings, nested nodes and missing pages."""
    return sections.section_parents(_trees(spark, sf_dir)).drop("id")


@_query(f"""SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(place AS INT) AS "index", text, sha256(text) AS content_hash, CAST(turn + 1 AS INT) AS start_page, CAST(turn + 1 AS INT) AS end_page
FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS text FROM conversations)
WHERE role <> 'system' AND text <> ''""")
def fallback_parents(spark, sf_dir):
    return sections.logical_parents(_talks(spark, sf_dir)).drop("id")


def _passages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("document_id"), "text", F.lit(1).alias("start_page"))
    return docs, chunking.child_chunks(docs)


@_query()
def child_chunks(spark, sf_dir):
    return _passages(spark, sf_dir)[1]


@_query(f"""
WITH d AS (SELECT length(text) AS n, regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS text FROM documents)
SELECT unnest(['blank', 'not in parent', 'repeated index', 'too long']) AS rule, 0::BIGINT AS found
UNION ALL SELECT 'documents', count(*) FILTER (text <> '') FROM d
UNION ALL SELECT 'characters of short documents', CAST(sum(length(text)) FILTER (n <= 800) AS BIGINT) FROM d
UNION ALL SELECT 'beginnings', count(DISTINCT substr(text, 1, 1)) FILTER (text <> '') FROM d
UNION ALL SELECT 'ends', count(DISTINCT substr(text, -1)) FILTER (text <> '') FROM d""")
def chunk_invariants(spark, sf_dir):
    """Violations of what holds for all passages, and counts that the documents give too."""
    docs, children = _passages(spark, sf_dir)
    both = children.join(docs.select(F.col("id").alias("parent_id"), F.col("text").alias("whole")), "parent_id")
    n = F.row_number().over(Window.partitionBy("parent_id", "index").orderBy("id"))
    ends = both.groupBy("parent_id").agg(F.substring(F.min_by("text", "index"), 1, 1).alias("first"), F.substring(F.max_by("text", "index"), -1, 1).alias("last"))
    ends = ends.agg(F.countDistinct("first").alias("beginnings"), F.countDistinct("last").alias("ends"), F.count(F.lit(1)).alias("documents"))
    short = F.sum(F.when(T.utf16_length(F.col("whole")) <= chunking.SIZE, F.length("text")))
    marks = both.withColumn("n", n).agg(F.count_if(T.trim(F.col("text")) == "").alias("blank"), F.count_if(~F.contains("whole", "text")).alias("not in parent"), F.count_if(F.col("n") > 1).alias("repeated index"), F.count_if(T.utf16_length(F.col("text")) > chunking.SIZE).alias("too long"), short.alias("characters of short documents"))
    rows = [m.unpivot([], m.columns, "rule", "found") for m in (marks, ends)]
    return rows[0].unionByName(rows[1])


_TURNS = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role <> 'system' AND trim(text) <> ''"


@_query(f"""
WITH t AS ({_TURNS}), c AS (SELECT conv_id, count(*) AS parts FROM t GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS id,
       CASE WHEN conv_id % 5 = 0 THEN 'deleted' WHEN conv_id % 3 = 0 THEN 'failed' WHEN conv_id % 3 = 1 THEN CASE WHEN parts > 1 THEN 'completed' ELSE 'failed' END ELSE 'uploaded' END AS status,
       parts - CASE WHEN conv_id % 5 <> 0 AND conv_id % 3 = 1 AND parts > 1 THEN 1 ELSE 0 END AS parent_count
FROM c""")
def reprocess_failed(spark, sf_dir):
    """Documents of which a third is parsed again without text, and a third without the first page: only these lose a section."""
    talks = _talks(spark, sf_dir)
    parents = sections.logical_parents(talks)
    documents = parents.select(F.col("document_id").alias("id")).distinct().withColumn("status", F.when(F.col("id") % 5 == 0, "deleted").otherwise("uploaded"))
    corpus = service.Corpus(documents, parents, chunking.child_chunks(parents))
    pages = F.filter("pages", lambda p: T.trim(p["text"]) != "")
    again = talks.where("doc_id % 3 < 2").withColumn("pages", F.when(F.col("doc_id") % 3 == 1, F.slice(pages, F.lit(2), F.greatest(F.size(pages) - 1, F.lit(0)))))
    again = again.withColumn("text", F.when(F.col("doc_id") % 3 == 1, F.array_join(F.col("pages.text"), " ")))
    after, _ = service.reprocess(corpus, again)
    return catalog.with_count(after.documents, "id", after.parents, "document_id")


# sessions


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


@_query("SELECT conv_id AS session_id, count(*) AS messages, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS outline FROM conversations GROUP BY conv_id")
def session_history(spark, sf_dir):
    view = sessions.session_view(_messages(spark, sf_dir).withColumn("created_at", F.lit(None).cast("timestamp")))
    outline = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), ",")
    return view.select("session_id", F.size("messages").cast("long").alias("messages"), outline.alias("outline"))


@_query("SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def last_n_messages(spark, sf_dir):
    return sessions.last_messages(_messages(spark, sf_dir), 3)


@_query("SELECT conv_id AS session_id, max(turn) AS updated_at, 1::BIGINT AS user_id FROM conversations GROUP BY conv_id ORDER BY 2 DESC, 1")
def session_list(spark, sf_dir):
    rows = _messages(spark, sf_dir).groupBy("session_id").agg(F.max("seq").alias("updated_at")).withColumn("user_id", F.lit(1).cast("long"))
    return sessions.list_sessions(rows, 1)


@_query(f"""SELECT conv_id AS session_id, coalesce(nullif(regexp_replace(substr(regexp_replace(arg_min(text, turn) FILTER (role = 'user'), '^{_SPACE}+|{_SPACE}+$', '', 'g'), 1, 40), '^{_SPACE}+|{_SPACE}+$', '', 'g'), ''), 'New chat') AS title
FROM conversations GROUP BY conv_id""")
def session_title(spark, sf_dir):
    return sessions.session_view(_messages(spark, sf_dir).withColumn("created_at", F.lit(None).cast("timestamp"))).select("session_id", "title")


@_query(f"""
WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS content, text FROM conversations),
k AS (SELECT conv_id, max(turn) AS last FROM t WHERE turn < 2 GROUP BY conv_id)
SELECT conv_id AS session_id, CAST(turn AS INT) AS seq, role, text AS content FROM t WHERE turn < 2
UNION ALL SELECT conv_id, CAST(coalesce(last, -1) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT), role, content
FROM t LEFT JOIN k USING (conv_id) WHERE turn >= 2 AND content <> '' AND role IN ('user', 'assistant')""")
def append_messages(spark, sf_dir):
    """The first two turns of each conversation, with the others appended."""
    rows = _messages(spark, sf_dir).withColumn("created_at", F.lit(None).cast("timestamp"))
    held = rows.where("seq < 2").withColumn("seq", F.col("seq").cast("int"))
    return sessions.append_messages(held, rows.where("seq >= 2").withColumnRenamed("seq", "order")).drop("created_at")


@_query(f"""
SELECT conv_id AS user_id, conv_id % 3 <> 0 AS is_new, CASE WHEN conv_id % 3 = 0 THEN CAST(conv_id AS VARCHAR) END AS reached,
       CASE WHEN conv_id % 3 <> 0 THEN coalesce(nullif(regexp_replace(substr(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), 1, 40), '^{_SPACE}+|{_SPACE}+$', '', 'g'), ''), 'New chat') END AS title
FROM conversations WHERE turn = 0""")
def resolve_sessions(spark, sf_dir):
    """The first message of each conversation goes to a session of its user, to another user's, or to none."""
    first = _messages(spark, sf_dir).where("seq = 0").select(F.col("session_id").alias("user_id"), F.col("content").alias("message"))
    asked = first.withColumn("session_id", F.when(F.col("user_id") % 3 < 2, F.col("user_id").cast("string")))
    held = first.select(F.col("user_id").cast("string").alias("session_id"), F.when(F.col("user_id") % 3 == 0, F.col("user_id")).otherwise(-1).alias("user_id"))
    found = sessions.resolve_sessions(asked, held)
    return found.select("user_id", "is_new", F.when(~F.col("is_new"), F.col("session_id")).alias("reached"), "title")


@_query(f"""SELECT conv_id AS session_id, turn AS seq, CASE WHEN turn % 3 = 0 AND text <> '' THEN text WHEN turn % 3 < 2 AND regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') <> '' THEN regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') || '.' ELSE 'I’m here to help.' END AS reply FROM conversations""")
def reply_texts(spark, sf_dir):
    """Responses with a text, with parts alone, and without either."""
    rows, third = _messages(spark, sf_dir), F.col("seq") % 3
    parts = F.when(third < 2, F.array(F.struct(F.concat(F.lit(" "), "content").alias("text")), F.struct(F.lit(None).cast("string").alias("text")), F.struct(F.when(T.trim(F.col("content")) != "", ".").alias("text"))))
    return rows.select("session_id", "seq", sessions.reply_text(F.when(third == 0, F.col("content")).otherwise(F.lit("")), parts).alias("reply"))


@_query(f"""
WITH t AS ({_TURNS}), p AS (SELECT conv_id, count(*) AS parent_count FROM t GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS document_id, count(*)::INT AS pages, coalesce(any_value(parent_count), 0)::BIGINT AS parent_count, CASE WHEN any_value(parent_count) IS NULL THEN 'no parents' END AS error, 800 AS child_chunk_size, 120 AS child_chunk_overlap, 2000::BIGINT AS processing_ms
FROM conversations LEFT JOIN p USING (conv_id) GROUP BY conv_id""")
def ingest_meta(spark, sf_dir):
    """What is told of the ingest of conversations as documents."""
    talks = _talks(spark, sf_dir).withColumn("text", F.lit("x"))
    parents = sections.logical_parents(talks)
    counts = chunking.ingest_counts(talks, parents, chunking.child_chunks(parents))
    return chunking.ingest_meta(counts, F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:02").cast("timestamp")).drop("child_count")


@_query("SELECT conv_id AS session_id, turn AS seq, role FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')")
def role_quarantine(spark, sf_dir):
    return V.quarantine(_messages(spark, sf_dir), "role", V.MESSAGE_ROLES).select("session_id", "seq", "role")


@_query(f"""SELECT conv_id AS session_id, 'user: {sessions.PREAMBLE}'.replace(chr(92) || 'n', chr(10)) || 'context' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 10 GROUP BY conv_id""")
def prompt_assembly(spark, sf_dir):
    made = sessions.prompts(_messages(spark, sf_dir), F.lit("context"))
    return made.select("session_id", F.array_join(F.transform("contents", lambda c: F.concat(c["role"], F.lit(": "), c["text"])), "\n").alias("prompt"))


@_query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    rows = ingest.windowed_counts(_table(spark, sf_dir, "events"))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))
