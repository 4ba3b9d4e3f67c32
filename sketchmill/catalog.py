"""The registered queries of the library, and the same results in SQL.

Each query applies operators to whole tables. Where no table holds what an operator reads (diagrams), plans.corpora renders it from
relational tables, and the SQL computes the answer from those tables without reading any text: a round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics, preprocess, text
from .operators import analysis, blocks, classify, consistency, curate, elements, images, lookup, scan, stats
from .plans import corpora
from .sources import readers, scratch, shards, sinks
from .streaming import incremental, submissions

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


EXT = "['.puml', '.pu', '.plantuml', '.wsd', '.iuml', '.uml', '.txt', '.PUML'][(doc_id % 8 + 1)::BIGINT]"
BLOBS = f"""blobs AS (SELECT doc_id, sha1(text) AS blob_id, 'src/d' || doc_id || {EXT} AS file_path,
  CASE doc_id % 3 WHEN 0 THEN '@startuml' || chr(10) || text || chr(10) || '@EndUML' WHEN 1 THEN '@startuml' || chr(10) || text ELSE text END AS content FROM documents)"""
COUNT = "len(list_filter(string_split({}, chr(10)), lambda x: regexp_matches(x, '\\S')))"
LINES = f"nl AS (SELECT doc_id, {COUNT.format('text')}::BIGINT AS n_lines FROM documents)"
RANKED = "r AS (SELECT {v} AS v, row_number() OVER (ORDER BY {v}) AS k, count(*) OVER () AS n FROM {t})"
RANKS = """SELECT count(*)::BIGINT AS n, min(v)::BIGINT AS "min", max(CASE WHEN k = n // 4 + 1 THEN v END)::BIGINT AS q1, max(CASE WHEN k = n // 2 + 1 THEN v END)::BIGINT AS median,
  max(CASE WHEN k = 3 * n // 4 + 1 THEN v END)::BIGINT AS q3, max(v)::BIGINT AS "max", avg(v) AS mean FROM r"""
SHA40 = "regexp_full_match(blob_id, '[0-9a-fA-F]{40}')"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


def sql_case(key: str, texts) -> str:
    """The text of a row by its key modulo their number, with the key for {k}."""
    return f"replace({sql_list(texts)}[({key} % {len(texts)} + 1)::BIGINT], '{{k}}', {key}::VARCHAR)"


def case(key: str, texts) -> Column:
    """The same as a Column."""
    picked = F.element_at(F.array(*map(F.lit, texts)), (F.col(key) % len(texts) + 1).cast("int"))
    return F.replace(picked, F.lit("{k}"), F.col(key).cast("string"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return corpora.read(spark, d, "documents")


def counted(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", text.nonempty_lines(F.col("text")).cast("long").alias("n_lines"))


# ---------------------------------------------------------------- records


@query(f"WITH {LINES} SELECT doc_id, n_lines FROM nl WHERE n_lines >= 5")
def nonempty_filter(spark, d):
    return curate.length_filter(documents(spark, d), "text").select("doc_id", F.col("n_lines").cast("long").alias("n_lines"))


@query(f"WITH {BLOBS} SELECT blob_id, file_path FROM blobs WHERE regexp_matches(file_path, '(?i)\\.(puml|pu|plantuml|wsd|iuml|uml)$')")
def ext_filter(spark, d):
    lines = corpora.blobs(spark, d).select(F.concat_ws(";", "blob_id", "file_path").alias("value"))
    return curate.path_records(lines.where(curate.has_diagram_extension(F.col("value"))))


@query(
    f"""WITH {BLOBS} SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'error' WHEN content = '' THEN 'error' WHEN m = '' THEN 'valid' ELSE 'invalid' END AS status,
  CASE WHEN doc_id % 10 = 9 THEN 'Blob not found' WHEN content = '' THEN 'Empty content' WHEN m = '' THEN NULL ELSE m END AS reason
  FROM (SELECT *, array_to_string(list_filter([CASE WHEN NOT contains(lower(content), '@startuml') THEN 'missing @startuml' END, CASE WHEN NOT contains(lower(content), '@enduml') THEN 'missing @enduml' END], lambda x: x IS NOT NULL), ', ') AS m FROM blobs)"""
)
def marker_status(spark, d):
    b = corpora.blobs(spark, d)
    held = b.where("doc_id % 10 <> 9").select(F.col("doc_id").cast("string").alias("blob_id"), "content")
    return curate.lookup_content(b.select("doc_id", F.col("doc_id").cast("string").alias("blob_id")), held).select("doc_id", "status", "reason")


@query(
    f"""WITH {BLOBS}, l AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'xyz' ELSE blob_id END AS blob_id, content FROM blobs)
  SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'line ' || doc_id || ': malformed line' WHEN NOT {SHA40} THEN 'line ' || doc_id || ': invalid blob id' WHEN doc_id % 7 = 2 THEN 'line ' || doc_id || ': bad base64'
    WHEN m <> '' THEN 'line ' || doc_id || ': ' || m END AS reason, CASE WHEN doc_id % 7 NOT IN (1, 2) THEN md5(content) END AS content_md5
  FROM (SELECT *, array_to_string(list_filter([CASE WHEN NOT contains(lower(content), '@startuml') THEN 'missing @startuml' END, CASE WHEN NOT contains(lower(content), '@enduml') THEN 'missing @enduml' END], lambda x: x IS NOT NULL), ', ') AS m FROM l)"""
)
def record_parse(spark, d):
    b = corpora.blobs(spark, d)
    blob = F.when(F.col("doc_id") % 7 == 0, "xyz").otherwise(F.col("blob_id"))
    whole = sinks.content_line(blob, F.col("file_path"), F.col("content"))
    value = F.when(F.col("doc_id") % 7 == 1, F.concat_ws(";", blob, "file_path")).when(F.col("doc_id") % 7 == 2, F.concat_ws(";", blob, "file_path", F.lit("YQ"))).otherwise(whole)
    return curate.content_records(b.select("doc_id", F.col("doc_id").alias("line_no"), value.alias("value"))).select("doc_id", "reason", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"WITH {BLOBS} SELECT blob_id, doc_id, file_path FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY doc_id) AS r FROM blobs) WHERE r = 1")
def dedup_first(spark, d):
    return curate.first_by_key(corpora.blobs(spark, d).select("blob_id", "doc_id", "file_path"), "blob_id", "doc_id")


@query("SELECT sha1(text) AS content_sha1, count(*) AS n FROM documents GROUP BY 1")
def content_duplicates(spark, d):
    return curate.content_duplicates(documents(spark, d), "text")


@query("SELECT doc_id AS blob_id, source AS project, quality FROM documents JOIN labels USING (doc_id)")
def project_join(spark, d):
    records = corpora.read(spark, d, "labels").select(F.col("doc_id").alias("blob_id"), "quality")
    return curate.join_projects(records, documents(spark, d).select(F.col("doc_id").alias("blob_id"), F.col("source").alias("project"))).select("blob_id", "project", "quality")


MAP = """m AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN sha1('hot') ELSE sha1(l_partkey::VARCHAR) END AS blob_id, 'p' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS project FROM lineitem),
  w AS (SELECT CASE WHEN p_size = 1 THEN sha1('hot') WHEN p_size = 2 THEN sha1('absent' || p_partkey) ELSE sha1(p_partkey::VARCHAR) END AS blob_id, p_partkey, p_size FROM part WHERE p_size <= 4)"""


def blob_map(spark, d):
    """Projects by blob, as an archive's map has them: an item a row, and one blob with a third of all rows. Wanted: blobs by part."""
    sha = lambda c: F.sha1(c.cast("string").cast("binary"))
    li, p = corpora.read(spark, d, "lineitem"), corpora.read(spark, d, "part").where("p_size <= 4")
    project = F.concat_ws("/", F.concat(F.lit("p"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    projects = li.select(F.when(F.col("l_partkey") % 3 == 0, sha(F.lit("hot"))).otherwise(sha(F.col("l_partkey"))).alias("blob_id"), project.alias("project"))
    blob = F.when(F.col("p_size") == 1, sha(F.lit("hot"))).when(F.col("p_size") == 2, sha(F.concat(F.lit("absent"), F.col("p_partkey").cast("string")))).otherwise(sha(F.col("p_partkey")))
    return projects, p.select(blob.alias("blob_id"), "p_partkey", "p_size")


@query(f"WITH {MAP} SELECT p_partkey, blob_id, count(project) AS n, min(project) AS first, max(project) AS last FROM w LEFT JOIN m USING (blob_id) GROUP BY ALL")
def blob_store_join(spark, d):
    """Wanted blobs looked up in a bucketed store behind a Bloom filter, with those that it doesn't have."""
    projects, wanted = blob_map(spark, d)
    store = lookup.write_store(projects, scratch.shared_path(spark, "blob-store"))
    found = lookup.look_up(wanted.select("blob_id").distinct(), store, "left")
    sums = found.groupBy("blob_id").agg(F.count("project").alias("n"), F.min("project").alias("first"), F.max("project").alias("last"))
    return wanted.join(sums, "blob_id").select("p_partkey", "blob_id", "n", "first", "last")


@query(f"WITH {MAP} SELECT count(*) AS n_rows, count(*) FILTER (blob_id IN (SELECT blob_id FROM w)) AS n_matched, true AS pruned FROM m")
def blob_store_pruned(spark, d):
    """How many of a store's rows the filter of the wanted blobs keeps from the join: nine tenths of those that don't match, at least."""
    projects, wanted = blob_map(spark, d)
    got = lookup.pruned_share(wanted.where("p_size > 1 OR p_partkey % 2 = 0").unionByName(wanted), lookup.write_store(projects, scratch.shared_path(spark, "blob-store")))
    passed_wrongly = F.col("n_passed") - F.col("n_matched")
    return got.select("n_rows", "n_matched", (passed_wrongly * 10 <= F.col("n_rows") - F.col("n_matched")).alias("pruned"))


@query(f"WITH {BLOBS} SELECT doc_id, lower(sha1(('blob ' || octet_length(encode(content)))::BLOB || '\\x00'::BLOB || encode(content))) AS git_id FROM blobs")
def git_ids(spark, d):
    return corpora.blobs(spark, d).select("doc_id", curate.git_blob_id(F.col("content")).alias("git_id"))


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'a' END AS content FROM customer"
)
def first_directory(spark, d):
    c = corpora.read(spark, d, "customer")
    a = c.where("c_custkey % 3 <> 0").select("c_custkey", F.lit(0).alias("priority"), F.lit("a").alias("content"))
    return curate.first_directory_hit(a.unionByName(c.select("c_custkey", F.lit(1).alias("priority"), F.lit("b").alias("content"))), "c_custkey").select("c_custkey", "content")


@query("SELECT o_orderkey, ((k - 1) // 1000 + 1)::INTEGER AS batch, printf('batch_%04d', ((k - 1) // 1000 + 1)::INTEGER) AS directory FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders)")
def batch_assign(spark, d):
    return curate.assign_batches(corpora.read(spark, d, "orders").select("o_orderkey"), 1000, "o_orderkey")


@query("SELECT o_orderkey, ((k - 1) // 100000 + 1)::INTEGER AS batch FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) WHERE (k - 1) // 100000 + 1 NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey > 1)")
def request_batches(spark, d):
    made = curate.assign_batches(corpora.read(spark, d, "orders").select("o_orderkey"), 100_000, "o_orderkey").drop("directory")
    done = corpora.read(spark, d, "nation").where("n_nationkey > 1").select(F.col("n_nationkey").alias("batch"))
    return curate.not_submitted(made, done).select("o_orderkey", "batch")


@query(f"WITH {BLOBS} SELECT doc_id, translate(ltrim('/' || file_path, '/'), '/', '_') AS name FROM blobs")
def sanitize_names(spark, d):
    return corpora.blobs(spark, d).select("doc_id", curate.sanitize_path(F.concat(F.lit("/"), "file_path")).alias("name"))


@query("SELECT substr(regexp_replace(replace(p_name || '.puml', '.puml', ''), '[^A-Za-z0-9_-]', '_', 'g'), 1, 64) AS custom_id, arg_max(p_name || '.puml', p_partkey) AS file_name FROM part GROUP BY 1")
def sanitize_ids(spark, d):
    return curate.id_map(corpora.read(spark, d, "part").select(F.concat("p_name", F.lit(".puml")).alias("file_name"), F.col("p_partkey").alias("ord")))


@query(
    "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'f' || s_suppkey ELSE 's' || s_suppkey || '.puml' END AS file_name FROM supplier"
)
def id_back_map(spark, d):
    s = corpora.read(spark, d, "supplier")
    cid = F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("custom_id")
    ids = s.where("s_suppkey % 2 = 0").select(cid, F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("file_name"))
    return curate.back_map(s.select("s_suppkey", cid), ids).select("s_suppkey", "file_name")


@query(f"WITH {BLOBS} SELECT doc_id, md5(blob_id || ';' || file_path || ';' || to_base64(encode(content))) AS line_md5, md5(content) AS content_md5 FROM blobs")
def base64_round_trip(spark, d):
    line = sinks.content_line(F.col("blob_id"), F.col("file_path"), F.col("content"))
    back = text.utf8(text.decode_base64(text.fields(line, 3)[2]))
    return corpora.blobs(spark, d).select("doc_id", F.md5(line.cast("binary")).alias("line_md5"), F.md5(back.cast("binary")).alias("content_md5"))


# ---------------------------------------------------------------- distributions


@query(f"WITH {LINES} SELECT n_lines, count(*) AS n FROM nl GROUP BY 1")
def line_histogram(spark, d):
    return stats.histogram(counted(spark, d), "n_lines")


@query(f"WITH {LINES}, {RANKED.format(v='n_lines', t='nl')} {RANKS}")
def line_stats(spark, d):
    return stats.rank_stats(counted(spark, d), "n_lines")


@query(f"WITH {RANKED.format(v='l_partkey', t='lineitem')} {RANKS}")
def rank_stats_large(spark, d):
    return stats.rank_stats(corpora.read(spark, d, "lineitem"), "l_partkey", stored=True)


@query(f"WITH {RANKED.format(v='l_extendedprice', t='lineitem')} {RANKS.replace('::BIGINT', '').replace(', avg(v) AS mean', '')}".replace("count(*) AS n, min", "count(*)::BIGINT AS n, min"))
def rank_stats_doubles(spark, d):
    """Ranks of a column of nearly as many different values as rows."""
    return stats.rank_stats(corpora.read(spark, d, "lineitem"), "l_extendedprice", stored=True).drop("mean")


@query(
    f"""WITH {LINES}, t AS (SELECT n_lines, count(*) AS n, min(doc_id) AS seen FROM nl GROUP BY 1 ORDER BY n DESC, seen LIMIT 20)
  SELECT n_lines, n, repeat('█', least(50, n * 50 // max(n) OVER ())::BIGINT) AS bar FROM t"""
)
def top_line_counts_by_first_seen(spark, d):
    return stats.top_buckets(counted(spark, d), "n_lines", seen="doc_id")


@query(
    f"""WITH {LINES}, b AS (SELECT * FROM (VALUES (0, '1-10', 1, 10), (1, '11-50', 11, 50), (2, '51-100', 51, 100), (3, '101-200', 101, 200), (4, '201+', 201, 1000000000)) t(ord, bucket, lo, hi))
  SELECT ord, bucket, count(n_lines) AS n FROM b LEFT JOIN nl ON n_lines BETWEEN lo AND hi GROUP BY 1, 2"""
)
def line_buckets(spark, d):
    return stats.bucket_counts(counted(spark, d), "n_lines")


@query(
    f"""WITH {LINES}, t AS (SELECT n_lines, count(*) AS n FROM nl GROUP BY 1 ORDER BY n DESC, n_lines LIMIT 20)
  SELECT n_lines, n, repeat('█', least(50, n * 50 // max(n) OVER ())::BIGINT) AS bar FROM t"""
)
def top_line_counts(spark, d):
    return stats.top_buckets(counted(spark, d), "n_lines")


@query("SELECT lang AS status, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM documents GROUP BY 1")
def status_rates(spark, d):
    return stats.status_counts(documents(spark, d).select(F.col("lang").alias("status")))


@query(
    f"""WITH {LINES} SELECT count(*) AS total, count(*) FILTER (n_lines >= 5) AS kept, count(*) FILTER (n_lines BETWEEN 1 AND 4) AS filtered, count(*) FILTER (n_lines = 0) AS errors,
  count(*) FILTER (n_lines >= 5) / count(*) AS kept_rate FROM nl"""
)
def filter_rates(spark, d):
    n = F.col("n_lines")
    return counted(spark, d).agg(*stats.filter_rates(n >= 5, n == 0))


# ---------------------------------------------------------------- splitting and normalising


@query(
    """WITH b AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
  p AS (SELECT *, chr(39) || ' order ' || l_orderkey || chr(10) || chr(10) AS head, '@startuml' || chr(10) || 'item_' || l_partkey || chr(10) || '@enduml' || chr(10) AS block FROM b)
  SELECT 'o' || l_orderkey AS stem, k::INTEGER AS part, 'o' || l_orderkey || '_' || lpad(k::VARCHAR, 2, '0') || '.puml' AS file_name, head || block AS content FROM p WHERE n > 1
  UNION ALL SELECT 'o' || l_orderkey, 0, 'o' || l_orderkey || '.puml', head || CASE WHEN l_partkey % 5 = 0 THEN '@startuml' || chr(10) || 'lost' || chr(10) ELSE '' END || block || 'outside' || chr(10)
    || CASE WHEN l_orderkey % 7 = 0 THEN '@startsalt' || chr(10) || 'open' || chr(10) ELSE '' END FROM p WHERE n = 1"""
)
def split_blocks(spark, d):
    return blocks.split_files(corpora.multi_diagrams(spark, d))


@query(
    """WITH b AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE 'u' || user_id % 20 END AS stem, event_id, event_id * 8 + 2 AS first_line, event_id * 8 + CASE WHEN event_id % 7 <> 0 THEN 4 ELSE 6 END AS last_line
    FROM events WHERE event_id % 7 <> 0 OR event_id % 11 = 0)
  SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY event_id) AS part, first_line, last_line, CASE WHEN event_id % 7 <> 0 THEN 3 ELSE 4 END::BIGINT AS n_lines,
    9 + 1 + length(event_id::VARCHAR) + CASE WHEN event_id % 7 <> 0 THEN 7 ELSE 17 + 8 END AS n_chars FROM b"""
)
def split_scan(spark, d):
    """Blocks of files that are tables of lines, one with a third of all lines; each block's lines counted where they stand."""
    lines = corpora.event_lines(spark, d)
    spans = scan.block_spans(lines)
    inside = scan.label_lines(lines, spans).where("part IS NOT NULL")
    sums = inside.groupBy("stem", "part").agg(F.count("*").alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))
    return spans.join(sums, ["stem", "part"])


@query(
    """WITH e AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE 'u' || user_id % 20 END AS stem, event_id FROM events),
  p AS (SELECT stem, count(*) AS parts FROM e WHERE event_id % 7 <> 0 OR event_id % 11 = 0 GROUP BY stem),
  n AS (SELECT stem, 5 + (event_id % 5 = 0)::INT + (event_id % 7 <> 0)::INT + (event_id % 11 = 0)::INT - 1 AS all_lines, CASE WHEN event_id % 7 <> 0 THEN 3 WHEN event_id % 11 = 0 THEN 4 ELSE 0 END AS block_lines FROM e)
  SELECT stem, coalesce(parts, 0) > 1 AS split, CASE WHEN coalesce(parts, 0) > 1 THEN sum(block_lines) + parts ELSE sum(all_lines) END::BIGINT AS n_lines FROM n LEFT JOIN p USING (stem) GROUP BY stem, parts"""
)
def split_scan_files(spark, d):
    """The files that splitting makes of them, as lines: each part has the file's first comment as its header."""
    made = scan.split_lines(corpora.event_lines(spark, d))
    return made.groupBy("stem").agg((F.max("part") > 0).alias("split"), F.count("*").alias("n_lines"))


@query("SELECT 'o' || l_orderkey AS stem, count(*) AS n_blocks, chr(39) || ' order ' || l_orderkey || chr(10) || chr(10) AS header FROM lineitem GROUP BY l_orderkey")
def block_counts(spark, d):
    return corpora.multi_diagrams(spark, d).select("stem", F.size(blocks.diagram_blocks(F.col("content"))).cast("long").alias("n_blocks"), blocks.header(F.col("content")).alias("header"))


@query("SELECT 'o' || l_orderkey AS stem FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def split_sources(spark, d):
    return blocks.split_sources(corpora.multi_diagrams(spark, d)).select("stem")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '@startuml' WHEN 1 THEN '@startuml' WHEN 2 THEN '@startuml (id=' || p_partkey || ')' ELSE 'x @startuml' END || chr(10) || p_name || chr(10) || '@enduml' AS content FROM part"""
)
def normalize_tags(spark, d):
    key = F.col("p_partkey").cast("string")
    tag = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("@startuml name "), key)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("@startuml{n"), key, F.lit("}"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("@startuml (id="), key, F.lit(")"))).otherwise("x @startuml  (gone)")
    return corpora.read(spark, d, "part").select("p_partkey", blocks.normalize_tags(F.concat(tag, F.lit("\n"), "p_name", F.lit("\n@enduml"))).alias("content"))


@query("SELECT count(*) AS processed, count(*) FILTER (p_partkey % 4 <> 2) AS modified, count(*) FILTER (p_partkey % 4 = 2) AS unchanged FROM part")
def normalize_stats(spark, d):
    key = F.col("p_partkey").cast("string")
    tag = F.when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("@startuml (id="), key, F.lit(")"))).otherwise(F.concat(F.lit("@startuml n"), key))
    changed = blocks.normalize_tags(F.col("content")) != F.col("content")
    return corpora.read(spark, d, "part").select(tag.alias("content")).agg(F.count("*").alias("processed"), F.count_if(changed).alias("modified"), F.count_if(~changed).alias("unchanged"))


def _stems(spark, d):
    return corpora.read(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("stem"))


def _images(spark, d):
    k, key = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("o"), key)).when(k == 1, F.concat(F.lit("o"), key, F.lit("_001"))).when(k == 2, F.concat(F.lit("o"), key, F.lit("_01"))).when(k == 3, F.concat(F.lit("x"), key))
    paths = corpora.read(spark, d, "orders").where(name.isNotNull()).select(F.concat(F.lit("/img/"), name, F.lit(".png")).alias("path"))
    return images.image_stems(paths)


@query("SELECT 'o' || o_orderkey AS stem FROM orders WHERE o_orderkey % 5 IN (0, 1)")
def has_image(spark, d):
    return images.with_image(_stems(spark, d), _images(spark, d))


@query("SELECT 'o' || o_orderkey AS stem FROM orders WHERE o_orderkey % 5 NOT IN (0, 1)")
def no_image(spark, d):
    return images.without_image(_stems(spark, d), _images(spark, d))


@query("SELECT o_orderkey % 5 IN (0, 1) AS has_image, count(*) AS n FROM orders GROUP BY 1")
def image_routes(spark, d):
    return sinks.route_by_image(_stems(spark, d), _images(spark, d)).groupBy("has_image").agg(F.count("*").alias("n"))


@query("SELECT 100000::BIGINT AS total, count(DISTINCT c_nationkey) AS failed, 100000 - count(DISTINCT c_nationkey) AS valid, (100000 - count(DISTINCT c_nationkey)) * 100 // 100000 AS percent FROM customer")
def render_stats(spark, d):
    log = corpora.read(spark, d, "customer").select(F.concat(F.lit("Error line 3 in file: /p/n"), F.col("c_nationkey").cast("string"), F.lit(".puml")).alias("value"))
    return images.render_stats(log, 100_000)


# ---------------------------------------------------------------- cleaning


def _clean_sql(*noise_lines: int) -> str:
    return "SELECT user_id % 50 AS grp, string_agg('U' || user_id || ' -> V : m' || event_id, chr(10) ORDER BY event_id) AS content FROM events GROUP BY 1"


def _tidy(c):
    """Blank lines and blanks at line ends are not compared."""
    return F.array_join(F.filter(F.transform(text.lines(c), text.strip), lambda x: x != ""), "\n")


def _cleaned(spark, d, noise, step):
    return corpora.noisy_diagrams(spark, d, noise).select("grp", _tidy(step(F.col("content"))).alias("content"))


COMMENTS = {0: "' a comment\n", 1: "/' one\ntwo '/", 2: "   '' more\n"}
STYLING = {0: "skinparam class {\n Color red\n}\n", 1: "skinparam dpi 100\n", 2: "hide empty members\n", 3: "style a {\n b\n}\n"}
SPRITES = {0: "sprite $foo [16x16/16] {\nFFF\n}\n", 1: "sprite bar <svg w=1>\n<path/></svg>\n"}
DIRECTIVES = {0: "!define A b\n", 1: "!include x.iuml\n", 2: "!procedure $p()\n!endprocedure\n", 3: "!$v = 1\n"}
NOTES = {0: "note left: hello\n", 1: "note right of V\n text\nend note\n", 2: 'note "x" as N1\n'}
FRAMES = {0: "title Some title\n", 1: "legend\n a\nendlegend\n", 2: "caption c\n", 3: "left header\n h\nendheader\n"}


@query(_clean_sql())
def strip_comments(spark, d):
    return _cleaned(spark, d, COMMENTS, preprocess.strip_comments)


@query(_clean_sql())
def strip_styling(spark, d):
    return _cleaned(spark, d, STYLING, preprocess.strip_styling)


@query(_clean_sql())
def strip_sprites(spark, d):
    return _cleaned(spark, d, SPRITES, preprocess.strip_sprites)


@query(_clean_sql())
def strip_directives(spark, d):
    return _cleaned(spark, d, DIRECTIVES, preprocess.strip_directives)


@query(_clean_sql())
def strip_notes(spark, d):
    return _cleaned(spark, d, NOTES, preprocess.strip_notes)


@query(_clean_sql())
def strip_frames(spark, d):
    return _cleaned(spark, d, FRAMES, preprocess.strip_frames)


@query(_clean_sql())
def preprocess_all(spark, d):
    mixed = {0: COMMENTS[0] + STYLING[1] + NOTES[1], 1: SPRITES[0] + FRAMES[1], 2: DIRECTIVES[2] + NOTES[2], 3: STYLING[0] + COMMENTS[1]}
    return _cleaned(spark, d, mixed, preprocess.preprocess)


#: Lines with what is left of them when inline comments are cut; then texts with what is left of them when all is cleaned.
INLINE = {
    "A{k} -> B ' hi": "A{k} -> B", "Alice's x{k}": "Alice's x{k}", "say \"{k} ' a\" ok": "say \"{k} ' a\" ok", "a 'text{k}' b": "a 'text{k}' b", "tail{k} '": "tail{k}", "x{k} \"q ' open": "x{k} \"q ' open",
    "p 'q' r{k} ' c": "p 'q' r{k}", "a{k} \"s\"'": "a{k} \"s\"'", "x{k} '\"y\"": "x{k} '\"y\"", "x{k} \"a\" ' \"b\"": "x{k} \"a\"", "' all {k}": "", "no {k}\t' tab": "no {k}",
}
CLEANED = {
    "!function $f{k}()\n!return 1\n!endfunction\nA{k} -> B": "\nA{k} -> B",
    "!unquoted procedure $p{k}\nA -> B{k}": "\nA -> B{k}",
    "footer\n page {k}\nendfooter\nA{k} -> B": "\nA{k} -> B",
    "right footer\n p{k}\nendfooter\nA -> B{k}": "\nA -> B{k}",
    "center header\n h{k}\nendheader\nA -> B{k}": "\nA -> B{k}",
    "title\nclass Foo{k}\nclass Bar{k}": "\nclass Bar{k}",
    "note left: hi{k}\nA{k} -> B": "\nA{k} -> B",
    "note over C{k},D : t": "note over C{k},D : t",
    "show x{k}\nA -> B": "\nA -> B",
    "sprite $foo{k} [16x16/16] {\nFFF\n}\nA -> B": "\nA -> B",
    "skinparam class {\n A b{k}\n}\nclass X\nhide\nclass Y\nshow z": "\nclass X\n\n",
    "a{k}\n' c\nb /' x\ny '/ d": "a{k}\n\nb  d",
}


@query(f"SELECT c_custkey, {sql_case('c_custkey', INLINE.values())} AS line FROM customer")
def inline_comments(spark, d):
    return corpora.read(spark, d, "customer").select("c_custkey", preprocess.strip_inline_comment(case("c_custkey", INLINE)).alias("line"))


@query(f"SELECT c_custkey, {sql_case('c_custkey', CLEANED.values())} AS content FROM customer")
def cleaning_forms(spark, d):
    return corpora.read(spark, d, "customer").select("c_custkey", preprocess.preprocess(case("c_custkey", CLEANED)).alias("content"))


@query("SELECT c_custkey, 'class C' || c_custkey || ' { }' || chr(10) || 'interface I { }' || chr(10) || 'C --> I' AS content FROM customer")
def member_bodies(spark, d):
    c = F.concat(F.lit("class C"), F.col("c_custkey").cast("string"), F.lit(" {\n int a() { x }\n}\ninterface I {\n +m()\n}\nC --> I"))
    return corpora.read(spark, d, "customer").select("c_custkey", elements.strip_member_bodies(c).alias("content"))


# ---------------------------------------------------------------- metrics


@query(
    """SELECT user_id % 50 AS grp, count(*) AS loc, 3 + 1 + 1 + count(*) + count(*) FILTER (event_id % 4 = 0) + count(*) FILTER (event_id % 4 = 1) + count(*) FILTER (event_id % 4 = 2) + 1 AS total_lines,
    1 + count(*) FILTER (event_id % 4 = 1) AS blank_lines, count(*) FILTER (event_id % 4 IN (0, 2)) AS comment_lines FROM events GROUP BY 1"""
)
def loc_metrics(spark, d):
    noisy = corpora.noisy_diagrams(spark, d, {0: "' a comment\n", 1: "\n", 2: "  ' b\n"})
    whole = F.concat(sinks.long_header(F.lit("b"), F.lit("p"), "archive"), F.lit("@startuml\n"), "content", F.lit("\n@enduml"))
    m = noisy.select("grp", metrics.loc_metrics(whole).alias("m"))
    return m.select("grp", *[F.col(f"m.{c}").cast("long").alias(c) for c in ("loc", "total_lines", "blank_lines", "comment_lines")])


@query("SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n_words, len(regexp_extract_all(text, '\\S+')) > 500 AS truncated, least(len(regexp_extract_all(text, '\\S+')), CASE WHEN len(regexp_extract_all(text, '\\S+')) > 500 THEN 400 ELSE 1000000000 END)::BIGINT AS kept FROM documents")
def word_truncate(spark, d):
    cut = metrics.truncate_words(F.col("text"), F.col("text"), 500, 400)
    rows = documents(spark, d).select("doc_id", metrics.word_count(F.col("text")).cast("long").alias("n_words"), cut.alias("c"))
    return rows.select("doc_id", "n_words", "c.truncated", metrics.word_count(F.col("c.text")).cast("long").alias("kept"))


@query("SELECT user_id % 50 AS grp, count(*) AS arrows FROM events GROUP BY 1")
def arrow_counts(spark, d):
    return corpora.noisy_diagrams(spark, d, {0: "@startuml -> x\n", 1: "!define A ->\n"}).select("grp", metrics.arrow_count(F.col("content")).cast("long").alias("arrows"))


#: Lines with the arrows that count in them.
ARROW_FORMS = {
    "A{k} -> B": 1, "A *-- B{k}": 1, "A{k} -->> B": 1, "A o-- B{k}": 1, "A{k} <-- B": 1, "A *--> B{k}": 2, "A{k} <--> B": 1, "A o--> B{k}": 2, "A{k} -- B": 0, "A --o B{k}": 1, "A{k} .. B": 0, "A{k} --other": 0,
    "A{k} ..> B": 1, "A <-left-> B{k}": 2, "A{k} <|-- B": 1, "A -up-> B{k}": 1, "A{k} ..|> B": 1, "A{k} \"1\" --> \"0..*\" B": 2, "A ->x B{k}": 1, "to-do list{k}": 1, "@startuml -> x{k}": 0, "!define A{k} ->": 0,
    "A{k} <<-- B": 1, "A{k} x<- B": 1, "A{k} <.. B": 1, "A{k} --* B": 1,
}


@query(f"SELECT c_custkey, {sql_list(ARROW_FORMS.values())}[(c_custkey % {len(ARROW_FORMS)} + 1)::BIGINT]::BIGINT AS arrows FROM customer")
def arrow_forms(spark, d):
    return corpora.read(spark, d, "customer").select("c_custkey", metrics.arrow_count(case("c_custkey", ARROW_FORMS)).cast("long").alias("arrows"))


@query("SELECT c_nationkey AS nation, 'structural' AS category, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def relationship_counts(spark, d):
    m = metrics.relationships(F.col("content"), F.lit("class"))
    return corpora.class_diagrams(spark, d).select("nation", F.explode(m).alias("category", "n")).withColumn("n", F.col("n").cast("long"))


@query(
    """SELECT CASE k WHEN 0 THEN 'message' WHEN 1 THEN 'structural' WHEN 2 THEN 'association' WHEN 3 THEN 'structural' WHEN 4 THEN 'structural' WHEN 5 THEN 'flow' WHEN 6 THEN 'flow' WHEN 7 THEN 'structural' WHEN 8 THEN 'message' ELSE 'structural' END AS category,
    sum(n)::BIGINT AS total, count(*) AS files FROM (SELECT l_orderkey, l_orderkey % 10 AS k, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1"""
)
def relationship_totals(spark, d):
    li = corpora.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.repeat(F.lit("A --> B\n"), F.count("*").cast("int")).alias("content"))
    kind = F.element_at(F.array(*map(F.lit, corpora.TYPE_CYCLE)), (F.col("l_orderkey") % 10 + 1).cast("int"))
    return stats.map_totals(li.withColumn("r", metrics.relationships(F.col("content"), kind)), "r", "category").withColumn("total", F.col("total").cast("long"))


# ---------------------------------------------------------------- elements


def _counted_elements(rows: DataFrame, kind: str) -> DataFrame:
    return elements.with_elements(rows.withColumn("clean", preprocess.preprocess(F.col("content"))).withColumn("primary_type", F.lit(kind)).drop("content"))


def _long(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.explode("elements").alias("type", "n")).withColumn("n", F.col("n").cast("long"))


@query(
    """SELECT c_nationkey AS nation, CASE WHEN c_custkey % 3 = 0 THEN 'interface' ELSE 'class' END AS type, count(*) + CASE WHEN c_custkey % 3 <> 0 THEN any_value(p) ELSE 0 END AS n FROM customer
  JOIN (SELECT c_nationkey AS k, count(DISTINCT o_orderkey % 50) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ON k = c_nationkey GROUP BY c_nationkey, c_custkey % 3 = 0, type"""
    .replace("CASE WHEN c_custkey % 3 <> 0 THEN any_value(p) ELSE 0 END", "max(CASE WHEN c_custkey % 3 <> 0 THEN p ELSE 0 END)")
)
def elements_class(spark, d):
    rows = _counted_elements(corpora.class_diagrams(spark, d), "class")
    return _long(rows, "nation")


@query("SELECT user_id % 50 AS grp, 'participant' AS type, count(DISTINCT user_id) + count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def elements_sequence(spark, d):
    rows = _counted_elements(corpora.sequence_diagrams(spark, d), "sequence")
    return _long(rows, "grp")


@query(
    """SELECT s_nationkey AS nation, 'component' AS type, count(DISTINCT s_suppkey) AS n FROM supplier GROUP BY 1
  UNION ALL SELECT s_nationkey, 'interface', count(DISTINCT s_suppkey % 7) FROM supplier GROUP BY 1"""
)
def elements_component(spark, d):
    rows = _counted_elements(corpora.component_diagrams(spark, d), "component")
    return _long(rows, "nation")


@query("SELECT p_brand AS brand, 'usecase' AS type, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'actor', count(DISTINCT p_size) FROM part GROUP BY 1")
def elements_usecase(spark, d):
    rows = _counted_elements(corpora.usecase_diagrams(spark, d), "usecase")
    return _long(rows, "brand")


@query(
    """WITH x AS (SELECT user_id % 50 AS grp, count(DISTINCT user_id) + count(DISTINCT event_type) AS n FROM events GROUP BY 1)
  SELECT CASE WHEN grp % 2 = 0 THEN 'file not found' END AS note, CASE WHEN grp % 2 = 0 THEN 0 ELSE n END::BIGINT AS total_elements, grp FROM x"""
)
def element_results(spark, d):
    s = corpora.sequence_diagrams(spark, d)
    name = F.concat(F.lit("g"), F.col("grp").cast("string"), F.lit(".puml")).alias("file_name")
    got = elements.element_results(s.select("grp", name, F.lit("sequence").alias("primary_type")), s.where("grp % 2 = 1").select(name, "content"))
    return got.select("note", F.col("total_elements").cast("long").alias("total_elements"), "grp")


#: Diagrams with their type and the elements in them.
ELEMENT_FORMS = [
    ("class", "class Foo{k}\nclass foo{k}\nabstract class Bar{k} as B\ninterface Baz<T>\nFoo{k} --> Qux\nB --> Baz", "abstract class=1,class=2,interface=1"),
    ("sequence", "participant Alice\nAlice -> Bob{k} : hi\nBob{k} --> Alice: ok\ngroup G1\nCarol ->> Bob{k} : x", "participant=3"),
    ("class", "participant Alice\nAlice -> Bob{k} : hi\nBob{k} --> Alice: ok\ngroup G1\nCarol ->> Bob{k} : x", "class=2,group=1,participant=1"),
    ("component", "[Web{k}] as W\n[Web{k}] --> [DB]\n() API\nW --> API", "component=2,interface=1"),
    ("usecase", ":User{k}: as U\n(Log in) as (L)\nU --> (Log in)\nU --> (Pay)", "actor=1,usecase=2"),
    ("class", "A{k} -> B -> C", "class=2"),
    ("class", "abstract  class X{k}", "abstract class=1"),
    ("state", "[*] --> S{k}", ""),
    ("unclassified", "class A{k}", ""),
    ("class", "A{k} \"1\" --> \"0..*\" B", "class=2"),
    ("class", "note -> Foo{k}", "class=1"),
    ("timing", "Foo{k} -> Bar", "participant=2"),
    ("sequence", ":Act{k}: as a\na -> Bob : x", "actor=1,participant=1"),
    ("deployment", "node N{k}\nN{k} --> M", "node=2"),
]


@query(f"SELECT c_custkey, {sql_case('c_custkey', [x[2] for x in ELEMENT_FORMS])} AS elements FROM customer")
def element_forms(spark, d):
    kind, text_ = case("c_custkey", [x[0] for x in ELEMENT_FORMS]), case("c_custkey", [x[1] for x in ELEMENT_FORMS])
    found = elements.with_elements(corpora.read(spark, d, "customer").select("c_custkey", kind.alias("primary_type"), text_.alias("clean")))
    said = F.transform(F.map_entries("elements"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select("c_custkey", F.array_join(F.sort_array(said), ",").alias("elements"))


#: Groups of events as classified diagrams: of every three, one has no file, one can't be read.
GROUPS = "g AS (SELECT user_id % 50 AS grp, count(*) AS n, count(DISTINCT user_id) + count(DISTINCT event_type) AS e FROM events GROUP BY 1)"
NOTE = "CASE grp % 3 WHEN 0 THEN 'file not found' WHEN 1 THEN 'read error' END AS note"


def _groups(spark, d):
    s = corpora.sequence_diagrams(spark, d)
    name = F.concat(F.lit("g"), F.col("grp").cast("string"), F.lit(".puml")).alias("file_name")
    files = s.where("grp % 3 <> 0").select(name, F.when(F.col("grp") % 3 == 2, F.col("content")).alias("content"))
    return s.select("grp", name, F.lit("sequence").alias("primary_type")), files


@query(f"WITH {GROUPS} SELECT grp, {NOTE}, CASE WHEN grp % 3 = 2 THEN 'sequence' ELSE '' END AS primary_type, CASE WHEN grp % 3 = 2 THEN e ELSE 0 END::BIGINT AS total_elements FROM g")
def element_notes(spark, d):
    return elements.element_results(*_groups(spark, d)).select("grp", "note", "primary_type", F.col("total_elements").cast("long").alias("total_elements"))


@query(
    f"WITH {GROUPS} SELECT grp, CASE WHEN grp % 3 = 0 THEN 'file not found' END AS note, CASE WHEN grp % 3 = 2 THEN e ELSE 0 END::BIGINT AS total_elements, CASE WHEN grp % 3 = 2 THEN n END::BIGINT AS messages, CASE WHEN grp % 3 = 2 THEN n ELSE 0 END::BIGINT AS total_relationships FROM g"
)
def merged_analysis(spark, d):
    classified, files = _groups(spark, d)
    got = analysis.merged(elements.element_results(classified, files), files)
    long = lambda c, name: c.cast("long").alias(name)
    return got.select("grp", "note", long(F.col("total_elements"), "total_elements"), long(F.try_element_at("relationships", F.lit("message")), "messages"), long(F.col("total_relationships"), "total_relationships"))


@query(f"WITH {GROUPS} SELECT count(*) AS total_files, count(*) FILTER (grp % 3 = 2) AS files_with_relationships, coalesce(sum(n) FILTER (grp % 3 = 2), 0)::BIGINT AS total_relationships FROM g")
def relationship_stats(spark, d):
    classified, files = _groups(spark, d)
    return analysis.relationship_stats(analysis.merged(elements.element_results(classified, files), files))


@query(f"WITH {GROUPS} SELECT grp, CASE WHEN grp % 3 = 2 THEN n END::BIGINT AS loc, CASE WHEN grp % 3 = 2 THEN n END::BIGINT AS total_lines, CASE WHEN grp % 3 = 2 THEN 0 END::BIGINT AS blank_lines, CASE WHEN grp % 3 = 2 THEN 0 END::BIGINT AS comment_lines FROM g")
def loc_enrich(spark, d):
    return analysis.with_loc(*_groups(spark, d)).select("grp", *[F.col(c).cast("long").alias(c) for c in analysis.LOC])


@query(f"WITH {GROUPS} SELECT count(*) FILTER (grp % 3 = 2) AS processed, count(*) FILTER (grp % 3 <> 2) AS skipped FROM g")
def loc_counts(spark, d):
    return analysis.loc_counts(analysis.with_loc(*_groups(spark, d)))


@query(f"WITH {GROUPS} SELECT 'g' || grp || '.puml' AS file_name, n AS loc, 'events' AS source, (SELECT count(*) FROM g) AS processed FROM g")
def report_round_trip(spark, d):
    """A report with metadata, statistics and results, read back."""
    s = corpora.sequence_diagrams(spark, d)
    rows = s.select(F.concat(F.lit("g"), F.col("grp").cast("string"), F.lit(".puml")).alias("file_name"), metrics.loc_metrics(F.col("content"))["loc"].alias("loc"))
    report = sinks.report_envelope(rows, "file_name", ("loc",), {"source": "events"}, rows.agg(F.count("*").alias("processed")))
    back = report.select(F.from_json("value", "metadata struct<source: string>, statistics struct<processed: long>, results map<string, struct<loc: long>>").alias("r"))
    return back.select("r.metadata.source", "r.statistics.processed", F.explode("r.results").alias("file_name", "x")).select("file_name", "x.loc", "source", "processed")


CLS = """cls AS MATERIALIZED (SELECT o_orderkey, ['sequence', 'class', 'usecase', 'component', 'deployment', 'state', 'activity', 'object', 'timing', 'unclassified'][(o_orderkey % 10 + 1)::BIGINT] AS primary_type, o_orderkey % 10 / 10.0::DOUBLE AS confidence FROM orders),
el AS MATERIALIZED (SELECT l_orderkey AS o_orderkey, ['participant', 'class', 'actor', 'component', 'node', 'state', 'partition', 'object', 'interface', 'usecase'][(l_partkey % 10 + 1)::BIGINT] AS e, count(*) AS n FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY 1, 2),
w AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({k}, '{t}', '{e}', {int(e in p)}, {int(e in a)}, {int(e in f)})" for k, (t, (p, a, f)) in enumerate(consistency.TABLE.items()) for e in dict.fromkeys([*p, *a, *f])
) + """) v(ord, t, e, p, a, f)),
tot AS (SELECT o_orderkey, sum(n) AS tot FROM el GROUP BY 1),
per AS MATERIALIZED (SELECT o_orderkey, ord, t, sum(n * p) AS p, sum(n * a) AS a, sum(n * f) AS f, string_agg(CASE WHEN f = 1 THEN chr(39) || e || chr(39) || ': ' || n END, ', ' ORDER BY e) AS held FROM el JOIN w USING (e) GROUP BY 1, 2, 3),
inf0 AS (SELECT *, greatest(0, p::DOUBLE / tot - 0.5::DOUBLE * (f::DOUBLE / tot)) AS s FROM per JOIN tot USING (o_orderkey)),
inf AS (SELECT o_orderkey, CASE WHEN max(s) > 0 THEN first(t ORDER BY s DESC, ord) ELSE 'unknown' END AS st, CASE WHEN max(s) > 0 THEN max(s) / sum(s) ELSE 0 END AS sc FROM inf0 GROUP BY 1),
val AS MATERIALIZED (SELECT c.*, coalesce(tot, 0) AS tot, coalesce(p, 0) AS p, coalesce(f, 0) AS f, held, coalesce(st, 'unknown') AS suggested_type, coalesce(sc, 0) AS sc,
  CASE WHEN primary_type = 'unclassified' THEN CASE WHEN coalesce(tot, 0) = 0 THEN 1.0 ELSE 0.3 END WHEN coalesce(tot, 0) = 0 THEN CASE primary_type WHEN 'activity' THEN 0.9 WHEN 'state' THEN 0.5 ELSE 0.3 END
    ELSE 0.4::DOUBLE * (coalesce(p, 0) + coalesce(a, 0)) / tot + 0.4::DOUBLE * (1 - least(1, coalesce(f, 0)::DOUBLE / tot)) + 0.2::DOUBLE * CASE WHEN coalesce(p, 0) > 0 THEN 1 ELSE 0.5 END END::DOUBLE AS score
  FROM cls c LEFT JOIN tot USING (o_orderkey) LEFT JOIN per x ON x.o_orderkey = c.o_orderkey AND x.t = c.primary_type LEFT JOIN inf i ON i.o_orderkey = c.o_orderkey),
fl AS (SELECT *, tot > 0 AND f > 0 AS f1, tot > 0 AND primary_type <> 'unclassified' AND p = 0 AS f2, tot > 0 AND suggested_type <> primary_type AND suggested_type <> 'unknown' AND round_even(sc, 4) > 0.5 AS f3,
  tot > 0 AND confidence >= 0.7 AND round_even(score, 4) < 0.5 AS f4, tot > 0 AND confidence < 0.5 AS f5 FROM val),
fx AS (SELECT *, tot > 0 AND round_even(score, 4) < 0.7 AND NOT (f1 OR f3 OR f4) AS f6, tot = 0 AND primary_type NOT IN ('activity', 'unclassified') AS f0 FROM fl)
"""
FIRST_PRIMARY = "CASE primary_type " + " ".join(f"WHEN '{t}' THEN " + sql_list(["[" + ", ".join(f"'{e}'" for e in p[:3]) + "]"])[1:-1] for t, (p, _, _) in consistency.TABLE.items()) + " END"


def validated(spark, d):
    return consistency.validate(corpora.classified(spark, d))


@query(f"WITH {CLS} SELECT o_orderkey, floor(score * 100 + 0.001)::BIGINT AS score_pct FROM val")
def consistency_scores(spark, d):
    return validated(spark, d).select("o_orderkey", F.floor(F.col("consistency_score") * 100 + 0.001).cast("long").alias("score_pct"))


@query(f"WITH {CLS} SELECT o_orderkey, suggested_type, floor(sc * 100 + 0.01)::BIGINT AS confidence_pct FROM val")
def inferred_types(spark, d):
    return validated(spark, d).select("o_orderkey", "suggested_type", F.floor(F.col("suggestion_confidence") * 100 + 0.01).cast("long").alias("confidence_pct"))


@query(
    f"""WITH {CLS} SELECT o_orderkey, array_to_string(list_filter([CASE WHEN f0 THEN 'NO_ELEMENTS' END, CASE WHEN f1 THEN 'FORBIDDEN_ELEMENTS' END, CASE WHEN f2 THEN 'MISSING_PRIMARY_ELEMENTS' END, CASE WHEN f3 THEN 'TYPE_MISMATCH' END,
  CASE WHEN f4 THEN 'HIGH_CONFIDENCE_MISMATCH' END, CASE WHEN f5 THEN 'LOW_CONFIDENCE' END, CASE WHEN f6 THEN 'MULTI_TYPE_AMBIGUOUS' END], lambda x: x IS NOT NULL), ',') AS flags,
  round_even(score, 4) >= 0.5 AND NOT (f1 OR f3 OR f4) AS is_consistent FROM fx"""
)
def consistency_flags(spark, d):
    return validated(spark, d).select("o_orderkey", F.array_join(F.transform("flags", lambda f: f["code"]), ",").alias("flags"), "is_consistent")


@query(f"WITH {CLS} SELECT primary_type AS classified, suggested_type AS suggested, count(*) AS n FROM val GROUP BY ALL")
def confusion_matrix(spark, d):
    return consistency.confusion_matrix(validated(spark, d))


@query(
    f"""WITH {CLS}, v AS (SELECT *, round_even(score, 4) >= 0.5 AND NOT (f1 OR f3 OR f4) AS ok FROM fx)
  SELECT count(*) AS total, count(*) FILTER (ok) AS consistent, count(*) FILTER (NOT ok) AS inconsistent, round_even(avg(ok::INT), 4) AS rate, round_even(avg(round_even(score, 4)), 4) AS avg_score,
    (sum(f5::INT) + sum(f6::INT))::BIGINT AS infos, (sum(f0::INT) + sum(f2::INT))::BIGINT AS warnings, (sum(f1::INT) + sum(f3::INT) + sum(f4::INT))::BIGINT AS errors FROM v"""
)
def validation_stats(spark, d):
    return consistency.validation_stats(validated(spark, d))


@query(
    f"""WITH {CLS}, x AS (SELECT *, round_even(round_even(sc, 4), 2) AS c2, round_even(round_even(score, 4), 2) AS s2 FROM fx)
  SELECT o_orderkey, 'FORBIDDEN_ELEMENTS' AS code, 'Found forbidden elements: {{' || held || '}}' AS details FROM x WHERE f1
  UNION ALL SELECT o_orderkey, 'MISSING_PRIMARY_ELEMENTS', 'No primary elements (' || {FIRST_PRIMARY} || '...) found' FROM x WHERE f2
  UNION ALL SELECT o_orderkey, 'TYPE_MISMATCH', 'Elements suggest ' || suggested_type || ' (conf: ' || printf('%.2f', c2) || ') not ' || primary_type FROM x WHERE f3
  UNION ALL SELECT o_orderkey, 'HIGH_CONFIDENCE_MISMATCH', 'High classification confidence (' || printf('%.2f', confidence) || ') but low consistency (' || printf('%.2f', s2) || ')' FROM x WHERE f4
  UNION ALL SELECT o_orderkey, 'LOW_CONFIDENCE', 'Classification confidence ' || printf('%.2f', confidence) || ' below 0.5 threshold' FROM x WHERE f5
  UNION ALL SELECT o_orderkey, 'MULTI_TYPE_AMBIGUOUS', 'Elements not strongly aligned with any single type' FROM x WHERE f6
  UNION ALL SELECT o_orderkey, 'NO_ELEMENTS', 'No elements detected for ' || primary_type || ' diagram' FROM x WHERE f0"""
)
def flag_details(spark, d):
    return validated(spark, d).select("o_orderkey", F.explode("flags").alias("f")).select("o_orderkey", "f.code", "f.details")


@query(
    f"""WITH {CLS} SELECT code, severity, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN f0 THEN 'NO_ELEMENTS:warning' END, CASE WHEN f1 THEN 'FORBIDDEN_ELEMENTS:error' END, CASE WHEN f2 THEN 'MISSING_PRIMARY_ELEMENTS:warning' END, CASE WHEN f3 THEN 'TYPE_MISMATCH:error' END,
  CASE WHEN f4 THEN 'HIGH_CONFIDENCE_MISMATCH:error' END, CASE WHEN f5 THEN 'LOW_CONFIDENCE:info' END, CASE WHEN f6 THEN 'MULTI_TYPE_AMBIGUOUS:info' END], lambda x: x IS NOT NULL)) AS c FROM fx), LATERAL (SELECT split_part(c, ':', 1) AS code, split_part(c, ':', 2) AS severity) GROUP BY ALL"""
)
def flag_counts(spark, d):
    return consistency.flag_counts(validated(spark, d))


@query(f"WITH {CLS} SELECT o_orderkey FROM fx WHERE f1 OR f3 OR f4 OR f0 OR f2")
def warned(spark, d):
    return consistency.at_least(validated(spark, d), "warning").select("o_orderkey")


@query(f"WITH {CLS} SELECT o_orderkey FROM fx WHERE NOT (round_even(score, 4) >= 0.5 AND NOT (f1 OR f3 OR f4))")
def inconsistent(spark, d):
    return consistency.inconsistent(validated(spark, d)).select("o_orderkey")


@query(f"WITH {CLS} SELECT e AS type, sum(n)::BIGINT AS total, count(*) AS files FROM el GROUP BY 1")
def element_totals(spark, d):
    return stats.map_totals(corpora.classified(spark, d), "elements").withColumn("total", F.col("total").cast("long"))


# ---------------------------------------------------------------- outside classifier


def _responses(spark, d):
    o = corpora.read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).alias("k"))
    body = F.concat(F.lit('{"primary_type": "class", "types": {"class": 0.'), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(', "object": 0.05}, "reasoning": "r"}'))
    said = F.when(F.col("k") == 0, body).when(F.col("k") == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(F.col("k") == 2, F.lit("no json at all")).when(F.col("k") == 3, F.lit("")).when(F.col("k") == 4, F.lit('so {"primary_type": "state", "types": null} then')).otherwise(body)
    return o.select(F.col("o_orderkey").cast("string").alias("custom_id"), F.when(F.col("k") == 5, "errored").otherwise("succeeded").alias("result_type"), said.alias("text"))


@query(
    """SELECT o_orderkey::VARCHAR AS custom_id, CASE o_orderkey % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'class' WHEN 4 THEN 'state' ELSE 'unclassified' END AS primary_type,
  CASE WHEN o_orderkey % 6 IN (0, 1) THEN (o_orderkey % 9 + 1) / 10.0::DOUBLE WHEN o_orderkey % 6 = 4 THEN 0.0::DOUBLE END AS confidence, o_orderkey % 6 = 2 AS parse_error,
  CASE o_orderkey % 6 WHEN 2 THEN 'no json at all' END AS raw_response, CASE o_orderkey % 6 WHEN 3 THEN 'Empty response' WHEN 5 THEN 'API error: errored' END AS error FROM orders"""
)
def classify_parse(spark, d):
    return classify.shape_results(_responses(spark, d)).select("custom_id", "primary_type", "confidence", "parse_error", "raw_response", "error")


@query(
    """SELECT count(*) AS total, count(*) FILTER (o_orderkey % 6 NOT IN (2, 3, 5)) AS successful, count(*) FILTER (o_orderkey % 6 IN (2, 3, 5)) AS errored, count(*) FILTER (o_orderkey % 6 = 2) AS unparsed,
  count(*) FILTER (o_orderkey % 7 = 0) AS truncated, round_even(avg(CASE WHEN o_orderkey % 6 IN (0, 1) THEN (o_orderkey % 9 + 1) / 10.0::DOUBLE WHEN o_orderkey % 6 = 4 THEN 0.0::DOUBLE END), 4) AS avg_confidence FROM orders"""
)
def classify_stats(spark, d):
    shaped = classify.shape_results(_responses(spark, d)).withColumn("truncated", F.col("custom_id").cast("long") % 7 == 0)
    return classify.classification_stats(shaped)


@query("SELECT CASE o_orderkey % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'class' WHEN 4 THEN 'state' ELSE 'unclassified' END AS primary_type, count(*) AS n FROM orders GROUP BY 1")
def type_distribution(spark, d):
    return classify.type_distribution(classify.shape_results(_responses(spark, d)))


@query(
    """WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS w FROM documents)
  SELECT 'd_' || doc_id AS custom_id, len(w) > 5000 AS truncated, md5('Which type is this?' || chr(10) || CASE WHEN len(w) > 5000 THEN array_to_string(w[1:4000], ' ') ELSE text END) AS content_md5 FROM w"""
)
def build_requests(spark, d):
    files = documents(spark, d).select(F.concat(F.lit("d "), F.col("doc_id").cast("string"), F.lit(".puml")).alias("file_name"), F.col("text").alias("content"))
    said = F.from_json("request", "params struct<messages: array<struct<role: string, content: string>>>")["params"]["messages"][0]["content"]
    return classify.build_requests(files, "Which type is this?\n{content}").select("custom_id", "truncated", F.md5(said.cast("binary")).alias("content_md5"))


#: Diagrams with the types that the rule classifier gives them, the surest first.
RULED = {
    "class P{k}\n+ id : int": "class",
    "component [C{k}]": "component",
    "interface I{k}\nclass C{k}": "class",
    "participant A{k}\nswitch x": "activity",
    "artifact A{k}\nnode N\ncomponent C": "deployment,component",
    "state S{k}\n[*] --> S{k}": "state",
    "participant A{k}\nalt x\nA{k} -> B : m": "sequence",
    "no marks {k}": "",
}


@query(f"SELECT p_partkey, {sql_list(RULED.values())}[(p_partkey % {len(RULED)} + 1)::BIGINT] AS labels FROM part")
def rule_classifier(spark, d):
    scored = classify.with_rule_scores(corpora.read(spark, d, "part").select("p_partkey", case("p_partkey", RULED).alias("content")))
    return scored.select("p_partkey", F.array_join(F.map_keys("scores"), ",").alias("labels"))


# ---------------------------------------------------------------- reports

LOC = "loc AS (SELECT o_orderkey, ['sequence', 'class', 'usecase', 'component', 'deployment', 'state', 'activity', 'object', 'timing', 'unclassified'][(o_orderkey % 10 + 1)::BIGINT] AS primary_type, o_orderkey % 97 AS loc FROM orders)"


def _loc(spark, d):
    return corpora.classified(spark, d).select("o_orderkey", "primary_type", (F.col("o_orderkey") % 97).alias("loc"))


@query(f"WITH {LOC}, {RANKED.format(v='loc', t='loc')} {RANKS.replace('avg(v)', 'round_even(avg(v), 2)')}")
def loc_stats(spark, d):
    return stats.rank_stats(_loc(spark, d), "loc", 2)


@query(f"WITH {LOC} SELECT primary_type, count(*) AS n, avg(loc) AS avg_loc, count(*) FILTER (loc < 10) AS simple, count(*) FILTER (loc BETWEEN 10 AND 50) AS medium, count(*) FILTER (loc > 50) AS complex, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM loc GROUP BY 1")
def type_profile(spark, d):
    return stats.type_profile(_loc(spark, d), "primary_type", "loc")


@query(f"WITH {LOC} SELECT primary_type, CASE WHEN loc < 10 THEN 'Simple' WHEN loc <= 50 THEN 'Medium' ELSE 'Complex' END AS complexity, count(*) AS n FROM loc GROUP BY 1, 2")
def complexity_grid(spark, d):
    return stats.type_complexity_grid(_loc(spark, d), "primary_type", "loc")


@query(f"WITH {LOC} SELECT o_orderkey, primary_type, loc FROM (SELECT *, row_number() OVER (PARTITION BY primary_type ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS r FROM loc) WHERE r <= 30")
def stratified_sample(spark, d):
    return stats.stratified_sample(_loc(spark, d), ["primary_type"], "o_orderkey")


@query("SELECT user_id % 50 AS grp, count(*) AS loc, count(DISTINCT user_id) + count(DISTINCT event_type) AS elements, count(*) AS relationships FROM events GROUP BY 1")
def diagram_metadata(spark, d):
    """The unified record of a diagram: lines, elements and relationships from one cleaned text."""
    s = corpora.sequence_diagrams(spark, d).withColumn("clean", preprocess.preprocess(F.col("content"))).withColumn("primary_type", F.lit("sequence"))
    found = elements.total(F.col("elements"))
    return elements.with_elements(s).select("grp", metrics.loc_metrics(F.col("content"))["loc"].cast("long").alias("loc"), found.cast("long").alias("elements"), metrics.arrow_count(F.col("clean")).cast("long").alias("relationships"))


# ---------------------------------------------------------------- stores: written into the shared folder and read again


@query("SELECT 's' || s_suppkey || ';' || s_name || '.puml' AS value FROM supplier UNION ALL SELECT 'c' || c_custkey || ';' || c_name FROM customer")
def gzip_shards(spark, d):
    """Line shards, compressed and plain, read as one table."""
    path = scratch.shared_path(spark, "shards")
    corpora.read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(";"), "s_name", F.lit(".puml"))).write.option("compression", "gzip").text(f"{path}/a")
    corpora.read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(";"), "c_name")).write.text(f"{path}/b")
    return readers.read_lines(spark, f"{path}/a", f"{path}/b").select("value")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS line_no, 'o' || o_orderkey AS value FROM orders")
def line_numbers(spark, d):
    """Lines numbered in the order of their files."""
    path = scratch.shared_path(spark, "ordered")
    corpora.read(spark, d, "orders").orderBy("o_orderkey").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))).write.text(path)
    return shards.numbered_lines(spark, path, overall=True).select(F.col("row_no").alias("line_no"), "value")


@query(
    f"""WITH {BLOBS}, n AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS row_no FROM blobs),
  f AS (SELECT * FROM n WHERE regexp_matches(file_path, '(?i)\\.(puml|pu|plantuml|wsd|iuml|uml)$'))
  SELECT blob_id, min(row_no) AS row_no, arg_min(file_path, row_no) AS file_path FROM f GROUP BY blob_id"""
)
def keep_first_lines(spark, d):
    """The first line of each blob in the order of compressed shards, from their files to the end."""
    path = scratch.shared_path(spark, "blob-shards")
    corpora.blobs(spark, d).orderBy("doc_id").select(F.concat_ws(";", "blob_id", "file_path")).write.option("compression", "gzip").text(path)
    lines = shards.numbered_lines(spark, path, overall=True).where(curate.has_diagram_extension(F.col("value"))).select("value", "row_no")
    return curate.first_by_key(curate.path_records(lines), "blob_id", "row_no")


@query(
    f"""WITH {BLOBS}, l AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'xyz' ELSE blob_id END AS blob_id, content, row_number() OVER (ORDER BY doc_id) AS n FROM blobs)
  SELECT n AS line_no, CASE WHEN doc_id % 7 = 1 THEN 'line ' || n || ': malformed line' WHEN NOT {SHA40} THEN 'line ' || n || ': invalid blob id' WHEN doc_id % 7 = 2 THEN 'line ' || n || ': bad base64'
    WHEN m <> '' THEN 'line ' || n || ': ' || m END AS reason, CASE WHEN doc_id % 7 NOT IN (1, 2) THEN md5(content) END AS content_md5
  FROM (SELECT *, array_to_string(list_filter([CASE WHEN NOT contains(lower(content), '@startuml') THEN 'missing @startuml' END, CASE WHEN NOT contains(lower(content), '@enduml') THEN 'missing @enduml' END], lambda x: x IS NOT NULL), ', ') AS m FROM l)"""
)
def strict_parse_shards(spark, d):
    """Content lines read from compressed shards, checked strictly, with the numbers of the lines that fail."""
    path = scratch.shared_path(spark, "content-shards")
    b = corpora.blobs(spark, d)
    blob = F.when(F.col("doc_id") % 7 == 0, "xyz").otherwise(F.col("blob_id"))
    whole = sinks.content_line(blob, F.col("file_path"), F.col("content"))
    value = F.when(F.col("doc_id") % 7 == 1, F.concat_ws(";", blob, "file_path")).when(F.col("doc_id") % 7 == 2, F.concat_ws(";", blob, "file_path", F.lit("YQ"))).otherwise(whole)
    b.select("doc_id", value.alias("value")).orderBy("doc_id").select("value").write.option("compression", "gzip").text(path)
    lines = shards.numbered_lines(spark, path, overall=True).select(F.col("row_no").alias("line_no"), "value")
    return curate.content_records(lines).select("line_no", "reason", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(
    f"""WITH {BLOBS}, x AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT contains(lower(content), '@startuml') THEN 'missing @startuml' END, CASE WHEN NOT contains(lower(content), '@enduml') THEN 'missing @enduml' END], lambda x: x IS NOT NULL), ', ') AS m FROM blobs)
  SELECT CASE WHEN doc_id % 10 = 9 OR content = '' THEN 'error' WHEN m = '' THEN 'valid' ELSE 'invalid' END AS status, doc_id::VARCHAR AS blob_id, file_path,
    CASE WHEN doc_id % 10 = 9 THEN 'Blob not found' WHEN content = '' THEN 'Empty content' WHEN m = '' THEN md5(content) ELSE m END AS detail FROM x"""
)
def routed_files(spark, d):
    """Outcomes written to three text folders; of the valid ones the content comes back from its line."""
    path = scratch.shared_path(spark, "routed")
    b = corpora.blobs(spark, d).withColumn("blob_id", F.col("doc_id").cast("string"))
    sinks.write_routed(curate.lookup_content(b.select("blob_id", "file_path"), b.where("doc_id % 10 <> 9").select("blob_id", "content")), path)
    f = text.fields(F.col("value"), 3)
    back = F.md5(text.utf8(text.decode_base64(f[2])).cast("binary"))
    return spark.read.text(path).select("status", f[0].alias("blob_id"), f[1].alias("file_path"), F.when(F.col("status") == "valid", back).otherwise(f[2]).alias("detail"))


@query(
    """SELECT printf('batch_%04d', ((k - 1) // 30 + 1)::INTEGER) AS batch, 's' || s_suppkey || '.puml' AS file_name,
    chr(39) || ' Blob ID: s' || s_suppkey || chr(10) || chr(39) || ' File Path: p/' || s_name || chr(10) || chr(39) || ' ' || chr(10) || '@startuml' || chr(10) || 'x é ' || s_nationkey || chr(10) || '@enduml' || chr(10) AS content
  FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier)"""
)
def diagram_files(spark, d):
    """One file a diagram in batch folders, read again by folder; line ends differ, and some files have none at their end."""
    path, key = scratch.shared_path(spark, "diagrams"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    rows = curate.assign_batches(corpora.read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), 30, "s_suppkey")
    end = F.when(F.col("s_suppkey") % 2 == 0, F.lit("\r\n")).otherwise("")
    body = F.concat(F.lit("@startuml\r\nx é "), F.col("s_nationkey").cast("string"), F.lit("\n@enduml"), end)
    whole = sinks.diagram_file(sinks.short_header(key, F.concat(F.lit("p/"), "s_name")), body)
    sinks.write_diagrams(rows.select("directory", F.concat(key, F.lit(".puml")).alias("file_name"), whole.alias("content")), path)
    return readers.read_batches(spark, path).select("batch", "file_name", "content")


@query("SELECT s_suppkey, s_name || 'é!' AS ignored, s_name || 'é' || chr(65533) || '!' AS replaced, s_name AS strict FROM supplier")
def encoding_policies(spark, d):
    raw = F.concat(F.concat("s_name", F.lit("é")).cast("binary"), F.unhex(F.lit("FF")), F.lit("!").cast("binary"))
    policies = [text.utf8(raw, "ignore").alias("ignored"), text.utf8(raw, "replace").alias("replaced"), text.utf8(F.col("s_name").cast("binary"), "strict").alias("strict")]
    return corpora.read(spark, d, "supplier").select("s_suppkey", *policies)


@query("SELECT n_name AS file_name, n_regionkey::BIGINT AS region, n_nationkey::BIGINT AS nation FROM nation")
def report_files(spark, d):
    """A JSON report written as a file and read as a table."""
    path = scratch.shared_path(spark, "report")
    rows = corpora.read(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("long").alias("region"), F.col("n_nationkey").cast("long").alias("nation"))
    sinks.report_envelope(rows, "n_name", ("region", "nation"), {"version": "1"}, rows.agg(F.count("*").alias("n"))).write.text(path)
    return readers.read_report(spark, path, "results", "struct<region: long, nation: long>")


@query("SELECT n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def report_dict(spark, d):
    """A JSON object by name, as a file of one line."""
    path = scratch.shared_path(spark, "dict")
    rows = corpora.read(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("long").alias("region"))
    sinks.report_json(rows, "n_name", "region").write.text(path)
    back = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<region: long>>")).alias("name", "r"))
    return back.select("name", "r.region")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10")
def listing_preview(spark, d):
    return sinks.preview(corpora.read(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


@query(ORACLES["ext_filter"])
def streamed_paths(spark, d):
    """The path filter on a stream of line files, worked off to its end into a table."""
    path = scratch.shared_path(spark, "stream")
    corpora.blobs(spark, d).select(F.concat_ws(";", "blob_id", "file_path")).write.text(f"{path}/in")
    picked = incremental.select_paths(incremental.stream_lines(spark, f"{path}/in"))
    picked.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(picked.schema).parquet(f"{path}/out")


@query(f"WITH {BLOBS} SELECT blob_id, doc_id, file_path FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY doc_id) AS r FROM blobs) WHERE r = 1")
def streamed_firsts(spark, d):
    """The first row of each blob from a stream whose rows arrive last first: earlier ones come late and take back what was given."""
    path = scratch.shared_path(spark, "first-stream")
    rows = corpora.blobs(spark, d).select("blob_id", "doc_id", "file_path")
    rows.orderBy(F.desc("doc_id")).coalesce(6).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    changes = incremental.first_rows_stream(stream, "blob_id", "doc_id", buckets=rows.count() // 1000 + 1)
    changes.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return incremental.settled(spark.read.schema(changes.schema).parquet(f"{path}/out"))


@query(
    """SELECT 'o' || o_orderkey AS custom_id, CASE WHEN o_orderkey % 4 = 0 THEN 'expired' WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 = 0 THEN 'expired' ELSE 'answered' END AS status,
  CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 4 = 1 AND o_orderkey % 3 = 0 THEN NULL ELSE 'a' || o_orderkey END AS payload FROM orders"""
)
def tracked_submissions(spark, d):
    """Requests and answers as files, followed by a stream in two runs from one checkpoint: a quarter is never answered, some answers come
    after the limit."""
    path = scratch.shared_path(spark, "submissions")
    o = corpora.read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("custom_id"))
    sent = o.select("custom_id", F.timestamp_seconds(F.col("o_orderkey") % 600 + 86_400).alias("at"), F.lit("q").alias("payload"))
    wait = F.when((F.col("o_orderkey") % 4 == 1) & (F.col("o_orderkey") % 3 == 0), 700).otherwise(60)
    back = o.where("o_orderkey % 4 <> 0").select("custom_id", F.timestamp_seconds(F.col("o_orderkey") % 600 + 86_400 + wait).alias("at"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("payload"))
    later = spark.range(1).select(F.lit("clock").alias("custom_id"), F.timestamp_seconds(F.lit(1_000_000)).alias("at"), F.lit("").alias("payload"))
    buckets = o.count() // 1000 + 1
    for requests, answers in ((sent, back.where("o_orderkey % 2 = 1")), (later, back.where("o_orderkey % 2 = 0"))):
        submissions.write_events(requests, f"{path}/requests")
        submissions.write_events(answers, f"{path}/answers")
        steps = submissions.track(submissions.events(spark, f"{path}/requests", f"{path}/answers"), "10 minutes", "2 hours", buckets)
        steps.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    done = submissions.outcomes(spark.read.schema(submissions.RESULT).parquet(f"{path}/out"))
    return done.where("custom_id <> 'clock'").select("custom_id", "status", "payload")


@query(
    """WITH l AS (SELECT s_suppkey, 'f' || s_suppkey % 40 || '.puml' AS f FROM supplier WHERE s_suppkey % 3 = 0), n AS (SELECT count(DISTINCT f) AS failed FROM l),
  h AS (SELECT unnest(['PlantUML Image Generation Statistics', '=====================================', '', 'Timestamp: now', 'Input directory: in', 'Output directory: out', '', 'Summary:', '  Total files:       1000',
    '  Valid files:       ' || (1000 - failed), '  Failed files:      ' || failed, '  Images generated:  990', '  Success rate:      ' || ((1000 - failed) * 100 // 1000) || '%', '', 'Processing time: 2m 5s', '', 'Failed files list:', '==================']) AS value,
    unnest(range(0, 18)) AS ord FROM n)
  SELECT ord, value FROM h UNION ALL SELECT 17 + row_number() OVER (ORDER BY f) AS ord, f AS value FROM (SELECT DISTINCT f FROM l)"""
)
def render_report(spark, d):
    s = corpora.read(spark, d, "supplier")
    name = F.concat(F.lit("f"), (F.col("s_suppkey") % 40).cast("string"), F.lit(".puml"))
    log = s.select(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Error line "), F.col("s_suppkey").cast("string"), F.lit(" in file: "), name)).otherwise("fine").alias("value"))
    return images.render_report(log, 1000, 990, "in", "out", "now", 125)


@query(
    """SELECT r.recursive, file_name FROM (SELECT s_suppkey, s_suppkey % 2 = 0 AS nested, 's' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.PUML' WHEN 1 THEN '.puml' ELSE '.puml.txt' END AS file_name FROM supplier) f,
  (VALUES (true), (false)) r(recursive) WHERE s_suppkey % 3 = 1 AND (r.recursive OR NOT nested)"""
)
def listed_files(spark, d):
    """Files found by a pattern in which case matters, right below a folder and at any depth."""
    path, s = scratch.shared_path(spark, "listing"), corpora.read(spark, d, "supplier")
    end = F.when(F.col("s_suppkey") % 3 == 0, ".PUML").when(F.col("s_suppkey") % 3 == 1, ".puml").otherwise(".puml.txt")
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), end)
    sinks.write_diagrams(s.select(F.when(F.col("s_suppkey") % 2 == 0, "inner").alias("directory"), name.alias("file_name"), F.lit("x").alias("content")), path)
    found = [readers.read_diagrams(spark, path, recursive=deep).select(F.lit(deep).alias("recursive"), "file_name") for deep in (True, False)]
    return found[0].unionByName(found[1])


@query(
    f"""WITH {BLOBS}, nl AS (SELECT *, {COUNT.format('content')}::BIGINT AS n_lines FROM blobs WHERE content <> '')
  SELECT doc_id, md5('  ' || blob_id || ';' || file_path || ';' || to_base64(encode(content)) || ' ') AS line_md5 FROM nl WHERE n_lines >= 5"""
)
def kept_lines(spark, d):
    """Lines of diagrams that are long enough, kept byte for byte as they were read."""
    b = corpora.blobs(spark, d).where("content <> ''")
    line = F.concat(F.lit("  "), sinks.content_line(F.col("blob_id"), F.col("file_path"), F.col("content")), F.lit(" "))
    parsed = b.select("doc_id", line.alias("value")).withColumn("text", text.utf8(text.decode_base64(F.get(text.fields(text.strip(F.col("value")), 3), F.lit(2)))))
    return curate.length_filter(parsed, "text").select("doc_id", F.md5(F.col("value").cast("binary")).alias("line_md5"))


@query(
    """SELECT '2' AS version, 'nations' AS made_from, count(*) AS n, max(n_regionkey)::BIGINT AS last_region, to_json(list({'k': n_name, 'v': n_nationkey::BIGINT} ORDER BY n_name))::VARCHAR AS entries FROM nation"""
)
def report_envelope(spark, d):
    """A report's metadata, statistics and entries, written as one document and read again."""
    path = scratch.shared_path(spark, "envelope")
    rows = corpora.read(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("nation"), F.col("n_regionkey").cast("long").alias("region"))
    totals = rows.agg(F.count("*").alias("n"), F.max("region").alias("last_region"))
    sinks.report_envelope(rows, "n_name", ("nation",), {"version": "2", "made_from": "nations"}, totals).write.text(path)
    shape = "struct<metadata: struct<version: string, made_from: string>, statistics: struct<n: long, last_region: long>, results: map<string, struct<nation: long>>>"
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("j")).select("j.metadata.*", "j.statistics.*", F.map_entries("j.results").alias("e"))
    entries = F.transform(F.array_sort("e"), lambda x: F.struct(x["key"].alias("k"), x["value"]["nation"].alias("v")))
    return read.select("version", "made_from", "n", "last_region", F.to_json(entries).alias("entries"))


@query("SELECT p_partkey, 2 AS participants FROM part")
def message_participants(spark, d):
    """Messages by arrows that only the message rule sees."""
    forms = ("A{k} -->> B{k} : m", "A{k} .> B{k} : m", '"A {k}" --->> B{k} : m', "A{k} <-->> B{k} : m")
    found = elements.with_elements(corpora.read(spark, d, "part").select("p_partkey", case("p_partkey", forms).alias("clean"), F.lit("sequence").alias("primary_type")))
    return found.select("p_partkey", F.try_element_at("elements", F.lit("participant")).alias("participants"))
