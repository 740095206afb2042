"""The queries over content-addressed data, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.codecs import BASE32, base32_of_hex, cache_record, data_uri, parse_cache_record, parse_data_uri, percent_decode, percent_encode, percent_encode_bytes, xml_escape
from cairn.functions.formats import IMAGE_NAME, LINK, base32_decode, convert, file_path, file_uri, guess_type, is_absolute, is_hierarchical, is_uri, listing, next_key, parse_date, query_arguments, scaled_size, type_by_name, urn_kinds, xml_unescape
from cairn.functions.ordering import natural_key
from cairn.functions.rdf import NAMESPACE, RDF
from cairn.functions.tiger import bitprint_urn, tiger_urn
from cairn.functions.urn import PURE, equivalent, post_sector_path, sha1_part, sha1_urn, tiger_part
from cairn.functions.values import RS_A, RS_B, append_path, boolean, caption, delta_ms, from_cp437, option_true, repo_ref, rs_hash, strip_subject, thumbnail_name, up_to_root
from cairn.operators import caches, changes, commits, merkle, namespaces, paths, trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def b32(digest: str, n: int = 32) -> str:
    """DuckDB's base32 of a hex digest."""
    return (
        f"array_to_string(list_transform(range(0, {n}), lambda i: substr('{BASE32}', CAST(1 + ((CAST('0x' || substr(rpad({digest}, 50, '0'), 1 + (i // 4) * 5, 5) AS INTEGER)"
        " >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '')"
    )


def urn(text: str) -> str:
    return f"'urn:sha1:' || {b32(f'sha1({text})')}"


def natural(name: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({name}, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(CAST(length(regexp_replace(p, '^0+', '')) AS VARCHAR), 10, '0') || regexp_replace(p, '^0+', '') ELSE p END), '')"


# Blobs and stores


@query(f"SELECT {urn('text')} AS urn, octet_length(encode(text)) AS size, count(*) AS copies, min(doc_id) AS first_doc, substr({b32('sha1(text)')}, 1, 2) || '/' || {b32('sha1(text)')} AS path FROM documents GROUP BY text")
def blob_manifest(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("h"), F.octet_length("text").cast("long").alias("size"))
    found = docs.groupBy("h", "size").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    name = base32_of_hex(F.col("h"), 20)
    return found.select(F.concat(F.lit("urn:sha1:"), name).alias("urn"), "size", "copies", "first_doc", post_sector_path(name).alias("path"))


@query("SELECT source, count(*) AS blobs, count(DISTINCT sha1(text)) AS kept, count(DISTINCT sha1(text)) / count(*) AS ratio FROM documents GROUP BY source")
def blob_dedup_ratio(spark, d):
    docs = read(spark, d, "documents").select("source", F.sha1(F.col("text").cast("binary")).alias("h"))
    return docs.groupBy("source").agg(F.count("*").alias("blobs"), F.count_distinct("h").alias("kept")).withColumn("ratio", F.col("kept") / F.col("blobs"))


@query(f"SELECT doc_id, {urn('text')} AS urn, doc_id % 7 <> 0 AS valid FROM documents")
def blob_verify(spark, d):
    docs = read(spark, d, "documents").withColumn("urn", sha1_urn(F.col("text")))
    read_back = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.select("doc_id", "urn", (sha1_urn(read_back) == F.col("urn")).alias("valid"))


@query(f"SELECT source AS sector, substr({b32('sha1(text)')}, 1, 2) AS prefix, count(DISTINCT sha1(text)) AS blobs FROM documents GROUP BY 1, 2")
def blob_store_sectors(spark, d):
    docs = read(spark, d, "documents").select(F.col("source").alias("sector"), F.sha1(F.col("text").cast("binary")).alias("h")).distinct()
    return docs.groupBy("sector", F.substring(base32_of_hex(F.substring("h", 1, 5), 2), 1, 2).alias("prefix")).agg(F.count("*").alias("blobs"))


@query("""SELECT h AS sha1, source, doc_id FROM (SELECT sha1(text) AS h, source, doc_id, row_number() OVER (PARTITION BY sha1(text) ORDER BY CASE WHEN source IN ('src0', 'src1') THEN 0 ELSE 1 END, source, doc_id) AS k FROM documents) WHERE k = 1""")
def urn_lookup_priority(spark, d):
    docs = read(spark, d, "documents").select(F.sha1(F.col("text").cast("binary")).alias("sha1"), "source", "doc_id")
    rank = F.struct(F.when(F.col("source").isin("src0", "src1"), 0).otherwise(1), "source", "doc_id")
    return docs.groupBy("sha1").agg(F.min_by(F.struct("source", "doc_id"), rank).alias("b")).select("sha1", "b.*")


@query("""SELECT a.doc_id, b.doc_id IS NOT NULL AS hit FROM documents a LEFT JOIN (SELECT doc_id, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 3 <> 0) b ON a.doc_id = b.doc_id AND a.n_chars = b.size""")
def hash_cache_hits(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    cache = docs.where("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("n_chars"), F.lit(True).alias("hit"))
    return docs.join(cache, ["doc_id", "n_chars"], "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("SELECT DISTINCT sha1(text) AS sha1 FROM documents WHERE lang <> 'en' AND sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE lang = 'en')")
def missing_blobs(spark, d):
    docs = read(spark, d, "documents").select("lang", F.sha1(F.col("text").cast("binary")).alias("sha1"))
    return docs.where("lang <> 'en'").select("sha1").distinct().join(docs.where("lang = 'en'"), "sha1", "left_anti")


# Codecs


@query("SELECT c_custkey, lower(hex(c_name)) AS base16, upper(hex(c_name)) AS upper16, c_name AS back FROM customer")
def base16_codec(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.lower(F.hex("c_name")).alias("base16"), F.hex("c_name").alias("upper16"), F.unhex(F.hex("c_name")).cast("string").alias("back"))


@query(f"SELECT p_partkey, {b32('sha1(p_name)')} AS base32 FROM part")
def base32_codec(spark, d):
    return read(spark, d, "part").select("p_partkey", base32_of_hex(F.sha1(F.col("p_name").cast("binary")), 20).alias("base32"))


@query("SELECT p_partkey, base64(encode(p_name)) AS base64, p_name AS back FROM part")
def base64_codec(spark, d):
    coded = F.base64(F.col("p_name").cast("binary"))
    return read(spark, d, "part").select("p_partkey", coded.alias("base64"), F.unbase64(coded).cast("string").alias("back"))


@query("SELECT item_id, url_encode(text) AS encoded, text AS back FROM benchmark")
def percent_codec(spark, d):
    return read(spark, d, "benchmark").select("item_id", percent_encode(F.col("text")).alias("encoded"), percent_decode(percent_encode(F.col("text"))).alias("back"))


@query("SELECT item_id, 'data:,' || url_encode(text) AS uri, octet_length(encode(text)) AS size FROM benchmark")
def data_uri_roundtrip(spark, d):
    made = read(spark, d, "benchmark").select("item_id", data_uri(F.col("text")).alias("uri"))
    return made.select("item_id", "uri", F.octet_length(percent_decode(F.substring_index("uri", ",", -1))).cast("long").alias("size"))


# Addresses


@query(f"SELECT doc_id, u, {b32('sha1(text)')} AS sha1, doc_id % 3 = 1 AS has_tiger, true AS pure FROM (SELECT *, CASE WHEN doc_id % 3 = 1 THEN 'urn:bitprint:' || {b32('sha1(text)')} || '.' || repeat('C', 39) ELSE {urn('text')} END AS u FROM documents)")
def urn_parse(spark, d):
    base = F.substring(sha1_urn(F.col("text")), 10, 32)
    u = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("urn:bitprint:"), base, F.lit("." + "C" * 39))).otherwise(F.concat(F.lit("urn:sha1:"), base))
    docs = read(spark, d, "documents").select("doc_id", u.alias("u"))
    return docs.select("doc_id", "u", sha1_part(F.col("u")).alias("sha1"), tiger_part(F.col("u")).isNotNull().alias("has_tiger"), F.col("u").rlike(PURE).alias("pure"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE NULL END AS same FROM documents""")
def urn_equivalence(spark, d):
    """Against itself, another blob, a bitprint of the same blob, and a tree hash alone."""
    docs = read(spark, d, "documents").select("doc_id", sha1_urn(F.col("text")).alias("a"))
    sha = F.substring("a", 10, 32)
    b = F.when(F.col("doc_id") % 4 == 0, F.col("a")).when(F.col("doc_id") % 4 == 1, F.lit("urn:sha1:" + "A" * 32)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("urn:bitprint:"), sha, F.lit("." + "C" * 39))).otherwise(F.lit("urn:tree:tiger:" + "C" * 39))
    return docs.select("doc_id", equivalent(F.col("a"), b).alias("same"))


@query("""SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AS is_uri, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:/') AS hierarchical, regexp_matches(url, '^/|^[^/:]+:') AS absolute, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_matches(url, '[?]') AS has_query FROM pages""")
def uri_predicates(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", is_uri(u).alias("is_uri"), is_hierarchical(u).alias("hierarchical"), is_absolute(u).alias("absolute"), F.regexp_extract(u, "^[a-z]+://([^/]+)", 1).alias("host"), u.contains("?").alias("has_query"))


@query("""WITH q AS (SELECT page_id, unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) AS arg FROM pages WHERE url LIKE '%?%')
SELECT page_id, string_split(arg, '=')[1] AS name, CASE WHEN arg LIKE '%=%' THEN string_split(arg, '=')[2] ELSE 'flag' END AS value FROM q WHERE arg <> ''""")
def query_args(spark, d):
    pages = read(spark, d, "pages").where(F.col("url").contains("?"))
    args = pages.select("page_id", F.explode(F.split(F.regexp_extract("url", "[?]([^#]*)", 1), "&")).alias("arg")).where("arg <> ''")
    parts = F.split("arg", "=")
    return args.select("page_id", parts[0].alias("name"), F.when(F.col("arg").contains("="), F.get(parts, F.lit(1))).otherwise("flag").alias("value"))


# Order and trees


@query(f"SELECT source, row_number() OVER (ORDER BY {natural('source')}, source) AS rank FROM (SELECT DISTINCT source FROM documents)")
def natural_sort_rank(spark, d):
    sources = read(spark, d, "documents").select("source").distinct()  # as many as there are sources
    return sources.select("source", F.row_number().over(Window.orderBy(natural_key(F.col("source")), "source")).cast("long").alias("rank"))


TREE = "SELECT r_name || '/' || n_name || '/' || replace(c_name, '#', '-') AS path, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def customer_tree(spark, d):
    nation = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    both = read(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select(F.concat_ws("/", "r_name", "n_name", F.replace("c_name", F.lit("#"), F.lit("-"))).alias("path"), "c_custkey", "c_acctbal", "n_name", "r_name")


@query(f"""WITH t AS ({TREE}), e AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS path, string_split(path, '/')[n] AS name, CAST(n AS INTEGER) AS depth, n < 3 AS is_dir FROM t, (VALUES (1), (2), (3)) v(n))
SELECT path, name, depth, is_dir FROM e""")
def tree_walk(spark, d):
    return trees.with_directories(customer_tree(spark, d))


@query(f"""WITH t AS ({TREE}), e AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS path, string_split(path, '/')[n] AS name, n < 3 AS is_dir FROM t, (VALUES (1), (2), (3)) v(n))
SELECT path, row_number() OVER (PARTITION BY CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END ORDER BY is_dir DESC, {natural('name')}, name) AS place FROM e""")
def listing_type_then_name(spark, d):
    up = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    order = Window.partitionBy(up).orderBy(F.desc("is_dir"), natural_key(F.col("name")), "name")
    return trees.with_directories(customer_tree(spark, d)).select("path", F.row_number().over(order).cast("long").alias("place"))


RULES = ["# customers", "*1", "!/ASIA/**/*11", "", "/EUROPE/**", "**/FRANCE/*2"]


@query(f"""SELECT path, CASE WHEN regexp_matches(path, '^(.*/)?FRANCE/[^/]*2$') THEN true WHEN path LIKE 'EUROPE/%' THEN true WHEN regexp_matches(path, '^ASIA/(.*/)?[^/]*11$') THEN false WHEN path LIKE '%1' THEN true ELSE false END AS ignored FROM ({TREE})""")
def ignore_glob(spark, d):
    return customer_tree(spark, d).select("path", trees.ignored(F.col("path"), RULES).alias("ignored"))


@query("SELECT o_custkey, max(l_shipdate) AS newest, count(*) AS blobs, bool_and(l_linestatus = 'F') AS fully_stored FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey")
def subtree_rollup(spark, d):
    """Highest blob time and whether all is stored, of each customer's tree of orders and lines."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("newest"), F.count("*").alias("blobs"), F.bool_and(F.col("l_linestatus") == "F").alias("fully_stored"))
    both = lines.join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("o_custkey").agg(F.max("newest").alias("newest"), F.sum("blobs").alias("blobs"), F.bool_and("fully_stored").alias("fully_stored"))


def directory(level: str, up: str, kind: str, of: str) -> str:
    """DuckDB's documents of the directories `up` of rows of `of`, with their addresses."""
    start = f'<Directory xmlns="{NAMESPACE}" xmlns:rdf="{RDF}">\n\t<entries rdf:parseType="Collection">\n'
    entry = f"""E'\\t\\t<DirectoryEntry>\\n\\t\\t\\t<name>' || name || E'</name>\\n\\t\\t\\t<target>\\n\\t\\t\\t\\t<{kind} rdf:about="' || id || E'"/>\\n\\t\\t\\t</target>\\n\\t\\t</DirectoryEntry>\\n'"""
    start = start.replace("\n", "\\n").replace("\t", "\\t")
    return f"""{level}x AS (SELECT {up} AS path, sha1(E'{start}' || string_agg({entry}, '' ORDER BY name) || E'\\t</entries>\\n</Directory>\\n') AS h FROM {of} GROUP BY 1),
        {level} AS (SELECT path, string_split(path, '/')[-1] AS name, 'x-rdf-subject:urn:sha1:' || {b32('h')} AS id FROM {level}x)"""


@query(f"""WITH t AS ({TREE}), c AS (SELECT path, string_split(path, '/')[3] AS name, 'urn:md5:' || md5(path) AS id FROM t), {directory('n', "regexp_replace(path, '/[^/]*$', '')", 'Blob', 'c')},
{directory('r', "regexp_replace(path, '/[^/]*$', '')", 'Directory', 'n')}, {directory('z', "''", 'Directory', 'r')}
SELECT path, id FROM n UNION ALL SELECT path, id FROM r UNION ALL SELECT path, id FROM z""")
def merkle_ids(spark, d):
    """Addresses of all directories, each by the document of its entries and their addresses."""
    files = customer_tree(spark, d).select("path", F.concat(F.lit("urn:md5:"), F.md5(F.col("path").cast("binary"))).alias("urn"))
    return merkle.directory_ids(changes.entries(files)).select("path", "id")


@query(f"""WITH t AS (SELECT path, CAST(c_custkey AS BIGINT) AS modified, c_custkey % 50 <> 0 AS stored FROM ({TREE}))
SELECT CASE k WHEN 0 THEN '' ELSE array_to_string(string_split(path, '/')[1:k], '/') END AS path, max(modified) AS newest, bool_and(stored) AS fully_stored, count(*) AS blobs FROM t, (VALUES (0), (1), (2)) v(k) GROUP BY 1""")
def tree_rollup(spark, d):
    """The latest time in each subtree, and whether all of it is stored."""
    return merkle.rollup(customer_tree(spark, d).select("path", F.col("c_custkey").cast("long").alias("modified"), (F.col("c_custkey") % 50 != 0).alias("stored")))


OLD, NEW = "SELECT CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) AS path, md5(CAST(o_orderkey % 5 AS VARCHAR)) AS urn FROM orders WHERE o_orderkey % 4 <> 0", "SELECT CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) AS path, md5(CAST(o_orderkey % 5 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS urn FROM orders WHERE o_orderkey % 5 <> 0"
BOTH = f"WITH o AS ({OLD}), n AS ({NEW}), b AS (SELECT coalesce(o.path, n.path) AS path, o.urn AS o, n.urn AS n FROM o FULL JOIN n ON o.path = n.path)"


def snapshots(spark, d):
    orders = read(spark, d, "orders").withColumn("path", F.concat_ws("/", "o_custkey", "o_orderkey"))
    old = orders.where("o_orderkey % 4 <> 0").select("path", F.md5((F.col("o_orderkey") % 5).cast("string").cast("binary")).alias("urn"))
    new = orders.where("o_orderkey % 5 <> 0").select("path", F.md5((F.col("o_orderkey") % 5 + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).cast("string").cast("binary")).alias("urn"))
    return old, new


@query(f"{BOTH} SELECT path, 'D' AS op FROM b WHERE o IS NOT NULL AND o IS DISTINCT FROM n UNION ALL SELECT path, 'A' AS op FROM b WHERE n IS NOT NULL AND o IS DISTINCT FROM n")
def tree_diff(spark, d):
    return trees.diff(*snapshots(spark, d))


@query(NEW)
def changeset_apply(spark, d):
    old, new = snapshots(spark, d)
    return trees.apply_changes(old, trees.diff(old, new), new)


for _policy in ("Ignore", "Replace", "Fail", "Same?Ignore:Fail", "Same?Ignore:Replace"):
    _same, _other = _policy.removeprefix("Same?").split(":") if "?" in _policy else (_policy, _policy)

    def _merge(spark, d, policy=_policy):
        return trees.merge(*snapshots(spark, d), policy)

    _name = "tree_merge_" + _policy.lower().replace("?", "_").replace(":", "_")
    QUERIES[_name] = _merge
    ORACLES[_name] = f"""{BOTH}, m AS (SELECT *, CASE WHEN o IS NULL OR n IS NULL THEN 'Add' WHEN o = n THEN '{_same}' ELSE '{_other}' END AS method FROM b)
        SELECT path, CASE WHEN method = 'Replace' THEN n ELSE coalesce(o, n) END AS urn, method = 'Fail' AS conflict FROM m"""


# Heads and commits


@query("SELECT conv_id, max(turn) AS latest, max(turn) + 1 AS new FROM conversations GROUP BY conv_id")
def heads_latest(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("latest")).withColumn("new", F.col("latest") + 1)


EDGES = """SELECT conv_id * 100 + turn AS child, conv_id * 100 + turn - 1 AS parent FROM conversations WHERE turn > 0
UNION SELECT a.conv_id * 100 + a.turn, b.conv_id * 100 + b.turn FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id - 1 AND b.turn = a.turn - 1"""


def commit_edges(spark, d):
    turns = read(spark, d, "conversations").select("conv_id", "turn")
    own = turns.where("turn > 0").select((F.col("conv_id") * 100 + F.col("turn")).alias("child"), (F.col("conv_id") * 100 + F.col("turn") - 1).alias("parent"))
    other = turns.select((F.col("conv_id") + 1).alias("conv_id"), (F.col("turn") + 1).alias("turn"), (F.col("conv_id") * 100 + F.col("turn")).alias("parent"))
    across = turns.join(other, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("child"), "parent")
    return own.unionByName(across).distinct()


def commit_nodes(spark, d):
    return read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("node")).distinct()


@query(f"WITH e AS ({EDGES}) SELECT child, count(*) AS parents, min(parent) AS first_parent FROM e GROUP BY child")
def commit_parents(spark, d):
    return commit_edges(spark, d).groupBy("child").agg(F.count("*").alias("parents"), F.min("parent").alias("first_parent"))


UP = f"WITH RECURSIVE e AS ({EDGES}), r AS (SELECT DISTINCT conv_id * 100 + turn AS node, conv_id * 100 + turn AS ancestor, 0 AS depth FROM conversations UNION SELECT r.node, e.parent, r.depth + 1 FROM r JOIN e ON r.ancestor = e.child WHERE r.depth < 3), up AS (SELECT node, ancestor, min(depth) AS depth FROM r GROUP BY 1, 2)"


@query(f"{UP} SELECT node, ancestor, depth FROM up")
def commit_ancestors(spark, d):
    return commits.ancestors(commit_edges(spark, d), commit_nodes(spark, d), 3)


@query(f"{UP} SELECT DISTINCT conv_id * 100 + turn AS node FROM conversations WHERE turn >= 1 AND conv_id * 100 + turn NOT IN (SELECT ancestor FROM up WHERE depth > 0 AND node % 100 >= 1)")
def filter_ancestors(spark, d):
    return commits.filter_ancestors(commit_edges(spark, d), commit_nodes(spark, d).where("node % 100 >= 1"), 3)


@query(f"""{UP.replace(' WHERE r.depth < 3', '')}, p AS (SELECT DISTINCT conv_id * 100 + turn AS a, (conv_id + 1) * 100 + turn AS b FROM conversations WHERE turn >= 2)
SELECT a, b, ancestor AS common FROM (SELECT p.a, p.b, x.ancestor, row_number() OVER (PARTITION BY p.a, p.b ORDER BY greatest(x.depth, y.depth), CASE WHEN x.depth > y.depth THEN 0 ELSE 1 END, x.ancestor) AS k FROM p LEFT JOIN (up x JOIN up y ON y.ancestor = x.ancestor) ON x.node = p.a AND y.node = p.b) WHERE k = 1""")
def common_ancestor(spark, d):
    pairs = commit_nodes(spark, d).where("node % 100 >= 2").select(F.col("node").alias("a"), (F.col("node") + 100).alias("b"))
    return commits.common_ancestor(commit_edges(spark, d), pairs)


@query("SELECT event_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stored FROM events")
def commit_unchanged_skip(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, d, "events").select("event_id", (~F.col("event_type").eqNullSafe(before)).alias("stored"))


@query("SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 60000000, false) AS hit FROM events")
def ttl_cache_hits(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)
    return read(spark, d, "events").select("event_id", F.coalesce(gap <= 60_000_000, F.lit(False)).alias("hit"))


# Documents of other formats


@query(r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?:src|href|resource)="([^"\r\n]*)"', 1) AS links FROM pages), l AS (SELECT page_id, i, links[i] AS link FROM (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS i FROM p)),
c AS (SELECT page_id, i, regexp_replace(replace(replace(replace(replace(link, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '^\./', '') AS link FROM l)
SELECT page_id, string_split(link, '/')[1] AS name, arg_max(link LIKE '%/%', i) AS is_dir FROM c WHERE link <> '' AND link NOT LIKE '../%' AND link NOT LIKE '?%' AND link NOT LIKE '/%' AND NOT regexp_matches(link, '^[^/:]+:') GROUP BY 1, 2""")
def html_listing(spark, d):
    """A page as a directory: of links to one name the last counts."""
    found = read(spark, d, "pages").select("page_id", F.posexplode(listing(F.col("html"))).alias("pos", "e"))
    return found.groupBy("page_id", F.col("e.name").alias("name")).agg(F.max_by("e.is_dir", "pos").alias("is_dir"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN CASE WHEN contains(lower(substr(html, 1, 1024)), '<html') THEN 'text/html; charset=utf-8' ELSE 'text/plain; charset=utf-8' END
WHEN 1 THEN 'application/rdf+xml' WHEN 2 THEN 'image/png' WHEN 3 THEN 'text/plain; charset=utf-8' END AS kind FROM pages""")
def content_sniff(spark, d):
    """Pages, RDF, images, text and other bytes."""
    html, k = F.col("html").cast("binary"), F.col("page_id") % 5
    content = F.when(k == 0, html).when(k == 1, F.concat(F.lit(b"<Directory>"), html)).when(k == 2, F.concat(F.unhex(F.lit("89504E470D0A")), html)).when(k == 3, F.lit(b"plain text")).otherwise(F.concat(F.unhex(F.lit("FF00")), html))
    return read(spark, d, "pages").select("page_id", guess_type(content).alias("kind"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'text/plain; charset=utf-8' WHEN 1 THEN 'audio/flac' END AS kind FROM part")
def content_type_by_name(spark, d):
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, (".TXT", ".flac", ".longer", ""))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return read(spark, d, "part").select("p_partkey", type_by_name(name).alias("kind"))


@query("""SELECT event_id, replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xml, json_extract_string(props, '$.k') AS k FROM events""")
def xml_escape_props(spark, d):
    return read(spark, d, "events").select("event_id", xml_escape(F.col("props")).alias("xml"), F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT n_regionkey, '<Directory>' || string_agg('<entry name="' || n_name || '"/>', '' ORDER BY n_name) || '</Directory>' AS xml FROM nation GROUP BY 1""")
def rdf_directory_xml(spark, d):
    entry = F.concat(F.lit('<entry name="'), xml_escape(F.col("n_name")), F.lit('"/>'))
    named = F.array_sort(F.collect_list(F.struct("n_name", entry.alias("x"))))
    return read(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<Directory>"), F.array_join(F.transform(named, lambda e: e["x"]), ""), F.lit("</Directory>")).alias("xml"))


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, o_orderpriority) AS joined, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S GMT') AS stamp, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS days FROM orders")
def concat_and_dates(spark, d):
    return read(spark, d, "orders").select(
        "o_orderkey", F.concat_ws(",", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")), "o_orderpriority").alias("joined"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss 'GMT'").alias("stamp"), F.datediff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date")).cast("long").alias("days"),
    )


@query("SELECT p_partkey, CAST(floor(p_size * 20 * least(128.0 / (p_size * 20), 128.0 / (p_size * 10 + 50), 1.0)) AS BIGINT) AS w, CAST(floor((p_size * 10 + 50) * least(128.0 / (p_size * 20), 128.0 / (p_size * 10 + 50), 1.0)) AS BIGINT) AS h FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part)")
def image_scaled_dims(spark, d):
    w, h = F.col("p_size").cast("double") * 20, F.col("p_size").cast("double") * 10 + 50
    scale = F.least(F.lit(128.0) / w, F.lit(128.0) / h, F.lit(1.0))
    return read(spark, d, "part").select("p_partkey", F.floor(w * scale).cast("long").alias("w"), F.floor(h * scale).cast("long").alias("h"))


@query("SELECT p_partkey, lag(p_name) OVER w AS prev, lead(p_name) OVER w AS next FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_name, p_partkey)")
def album_prev_next(spark, d):
    order = Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")
    return read(spark, d, "part").select("p_partkey", F.lag("p_name").over(order).alias("prev"), F.lead("p_name").over(order).alias("next"))


# Values, names and paths


@query(f"WITH t AS ({TREE}), r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Nowhere/' ELSE '' END || path AS path FROM t) SELECT r.c_custkey, replace(r.path, '/', '//') AS request, CAST(t.c_custkey AS VARCHAR) AS target, t.c_custkey IS NOT NULL AS found FROM r LEFT JOIN t ON t.path = r.path")
def follow_path(spark, d):
    """The entry at each requested path; runs of slashes count as one."""
    tree = customer_tree(spark, d).select("path", F.col("c_custkey").cast("string").alias("target"))
    asked = customer_tree(spark, d).select("c_custkey", F.replace(F.concat(F.when(F.col("c_custkey") % 3 == 0, "Nowhere/").otherwise(""), "path"), F.lit("/"), F.lit("//")).alias("request"))
    return asked.withColumn("path", F.regexp_replace("request", "/+", "/")).join(tree, "path", "left").select("c_custkey", "request", "target", F.col("target").isNotNull().alias("found"))


@query(f"WITH t AS ({TREE}) SELECT path, string_split(path, '/')[3] AS name FROM t")
def tree_walk_blobs(spark, d):
    return trees.with_directories(customer_tree(spark, d)).where("NOT is_dir").select("path", "name")


@query("""WITH n AS (SELECT conv_id, turn, role FROM conversations WHERE conv_id % 3 <> 0 AND turn % 4 <> 3), h AS (SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM n GROUP BY 1)
SELECT DISTINCT c.conv_id, h.turn || '-' || h.role AS highest, CAST(coalesce(h.turn + 1, 0) AS VARCHAR) AS next FROM conversations c LEFT JOIN h ON h.conv_id = c.conv_id""")
def heads_next(spark, d):
    """Of names that begin with digits the highest in natural order, and the key that follows it; 0 where there is none."""
    name = F.when((F.col("conv_id") % 3 != 0) & (F.col("turn") % 4 != 3), F.concat_ws("-", "turn", "role")).otherwise(F.concat(F.lit("draft"), "turn"))
    names = read(spark, d, "conversations").select("conv_id", name.alias("name"))
    numbered = F.when(F.col("name").rlike("^[0-9]"), natural_key(F.col("name")))
    return names.groupBy("conv_id").agg(F.max_by("name", numbered).alias("highest")).withColumn("next", next_key(F.col("highest")))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'repo' || page_id WHEN 1 THEN 'repo' || page_id END AS repo_name, CASE WHEN page_id % 2 = 0 THEN 'heads/' ELSE '' END || 'tree/' || page_id AS sub_path FROM pages")
def repo_ref_parse(spark, d):
    start = F.when(F.col("page_id") % 2 == 0, "x-blob-head:").otherwise("x-blob-repo:")
    uri = F.concat(start, F.when(F.col("page_id") % 4 < 2, F.concat(F.lit("//repo"), "page_id", F.lit("/"))).otherwise("/"), F.lit("tree/"), "page_id")
    return read(spark, d, "pages").select("page_id", repo_ref(uri, False).alias("r")).select("page_id", "r.repo_name", "r.sub_path")


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/style/main.css' AS rooted, regexp_extract(url, '^([^?#]*/)', 1) || 'next.html' AS beside FROM pages""")
def append_path_urls(spark, d):
    url = F.col("url")
    return read(spark, d, "pages").select("page_id", append_path(url, F.lit("/style/main.css")).alias("rooted"), append_path(url, F.lit("gone/./../next.html")).alias("beside"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS word, o_orderkey % 3 <> 0 AS number FROM orders")
def bool_words(spark, d):
    word = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "nein").otherwise("perhaps")
    return read(spark, d, "orders").select("o_orderkey", boolean(word).alias("word"), boolean((F.col("o_orderkey") % 3).cast("string")).alias("number"))


@query("SELECT o_orderkey, epoch_ms(o_orderdate) + (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) * (o_orderkey % 7) * (CASE o_orderkey % 5 WHEN 0 THEN 1000 WHEN 1 THEN 60000 WHEN 2 THEN 86400000 WHEN 3 THEN 604800000 END) AS at FROM orders WHERE o_orderkey % 5 <> 4")
def time_delta(spark, d):
    key = F.col("o_orderkey")
    unit = F.when(key % 5 == 0, "").when(key % 5 == 1, "minutes").when(key % 5 == 2, "days").otherwise("weeks")
    delta = F.concat(F.when(key % 2 == 0, "+").otherwise("-"), (key % 7).cast("string"), unit)
    return read(spark, d, "orders").where(key % 5 != 4).select("o_orderkey", (F.unix_millis(F.col("o_orderdate").cast("timestamp")) + delta_ms(delta)).alias("at"))


@query("SELECT doc_id, octet_length(encode(text)) AS size FROM documents")
def size_of(spark, d):
    return read(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))


@query("""SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN '.jpg' ELSE '' END AS name, 0 AS size FROM part UNION ALL
SELECT p_partkey, p_name || '-' || s.d || CASE WHEN p_partkey % 2 = 0 THEN '.jpg' ELSE '' END, s.w FROM part, (VALUES ('128x128', 128), ('640x480', 640)) s(d, w)""")
def thumbnail_entries(spark, d):
    """Each image's entry and those of its two thumbnails."""
    part = read(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ".jpg").otherwise("")).alias("n"))
    entry = lambda name, size: F.struct(name.alias("name"), F.lit(size).alias("size"))
    each = F.array(entry(F.col("n"), 0), entry(thumbnail_name(F.col("n"), 128, 128), 128), entry(thumbnail_name(F.col("n"), 640, 480), 640))
    return part.select("p_partkey", F.inline(each))


def rs_powers(n: int) -> str:
    """Literals of RS hash's multiplier at each byte."""
    out, a = [], RS_A
    for _ in range(n):
        out.append(f"CAST({a} AS HUGEINT)")
        a = a * RS_B % (1 << 32)
    return ", ".join(out)


@query(f"""WITH k AS (SELECT p_partkey, list_transform(range(1, length(p_name) + 1), lambda i: {{'c': CAST(ascii(substr(p_name, i, 1)) AS HUGEINT), 'a': [{rs_powers(64)}][i]}}) AS x FROM part),
h AS (SELECT p_partkey, list_reduce(list_prepend({{'c': CAST(0 AS HUGEINT), 'a': CAST(0 AS HUGEINT)}}, x), lambda p, q: {{'c': (p.c * q.a + q.c) % 4294967296, 'a': q.a}}).c % 2147483648 AS h FROM k)
SELECT p_partkey, CAST(h AS BIGINT) AS hash, CAST(h % 65536 AS BIGINT) AS bucket FROM h""")
def rs_hash_buckets(spark, d):
    return read(spark, d, "part").select("p_partkey", rs_hash(F.col("p_name")).alias("hash")).withColumn("bucket", F.col("hash") % 65536)


@query("SELECT page_id, i - 1 AS pos, links[i] AS link FROM (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?:src|href|resource)=\"([^\"\r\n]*)\"', 1) AS links FROM pages))")
def html_links(spark, d):
    found = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    return read(spark, d, "pages").select("page_id", F.posexplode(found).alias("pos", "link")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k1, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS json FROM events")
def json_encode_props(spark, d):
    parsed = F.from_json("props", "k long")
    return read(spark, d, "events").select("event_id", (parsed["k"] + 1).alias("k1"), F.to_json(parsed).alias("json"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN sha1(text) WHEN 1 THEN sha1(text) END AS target FROM documents")
def rdf_subject_target(spark, d):
    start = F.when(F.col("doc_id") % 3 == 0, "x-rdf-subject:").when(F.col("doc_id") % 3 == 1, "x-parse-rdf:").otherwise("")
    return read(spark, d, "documents").select("doc_id", strip_subject(F.concat(start, F.sha1(F.col("text").cast("binary")))).alias("target"))


@query("SELECT p_partkey, p_name || 'é' AS text FROM part")
def cp437_text(spark, d):
    return read(spark, d, "part").select("p_partkey", from_cp437(F.concat(F.col("p_name").cast("binary"), F.unhex(F.lit("82")))).alias("text"))


# More of stores, trees and values


@query(None)
def tiger_tree_urn(spark, d):
    """SQL has no Tiger; its digests are held against known ones in the tests."""
    return read(spark, d, "documents").select("doc_id", tiger_urn(F.col("text")).alias("urn"))


@query(None)
def bitprint(spark, d):
    return read(spark, d, "documents").select("doc_id", bitprint_urn(F.col("text")).alias("urn"))


@query("SELECT o_orderkey, lpad(hex(o_orderkey), 16, '0') || lpad(hex(epoch_ms(o_orderdate)), 16, '0') || upper(sha1(o_orderpriority)) AS record, o_orderkey AS size, epoch_ms(o_orderdate) AS mtime_ms, sha1(o_orderpriority) AS digest FROM orders")
def hash_cache_records(spark, d):
    made = cache_record(F.col("o_orderkey"), F.unix_millis(F.col("o_orderdate").cast("timestamp")), F.unhex(F.sha1(F.col("o_orderpriority").cast("binary"))))
    rows = read(spark, d, "orders").select("o_orderkey", made.alias("r")).withColumn("p", parse_cache_record(F.col("r")))
    return rows.select("o_orderkey", F.hex("r").alias("record"), "p.size", "p.mtime_ms", F.lower(F.hex("p.digest")).alias("digest"))


@query("SELECT p_partkey, regexp_replace(hex(encode(p_name)), '(..)', '%\\1', 'g') AS encoded FROM part")
def percent_bytes(spark, d):
    return read(spark, d, "part").select("p_partkey", percent_encode_bytes(F.col("p_name").cast("binary")).alias("encoded"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'text/plain' END AS format, text AS content FROM benchmark")
def data_uri_source(spark, d):
    coded = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.col("text").cast("binary")))
    rows = read(spark, d, "benchmark").select("item_id", parse_data_uri(F.when(F.col("item_id") % 2 == 0, coded).otherwise(data_uri(F.col("text")))).alias("p"))
    return rows.select("item_id", "p.format", F.col("p.content").cast("string").alias("content"))


@query(f"{BOTH}, c AS (SELECT path, 'D' AS op, 0 AS seq FROM b WHERE o IS NOT NULL AND o IS DISTINCT FROM n UNION ALL SELECT path, 'A', 1 FROM b WHERE n IS NOT NULL AND o IS DISTINCT FROM n) SELECT string_split(path, '/')[1] AS top, string_agg(op || ' ' || path, chr(10) ORDER BY path, seq) AS dump FROM c GROUP BY 1")
def changeset_dump(spark, d):
    return trees.changeset_lines(trees.diff(*snapshots(spark, d)))


for _method, _first, _other in (("Replace", "n", "o"), ("Ignore", "o", "n")):

    def _merge_directories(spark, d, method=_method):
        return trees.merge_directories(*snapshots(spark, d), method)

    QUERIES[f"directory_merge_{_method.lower()}"] = _merge_directories
    ORACLES[f"directory_merge_{_method.lower()}"] = f"WITH o AS ({OLD}), n AS ({NEW}) SELECT path, urn FROM {_first} UNION ALL SELECT path, urn FROM {_other} WHERE string_split(path, '/')[1] NOT IN (SELECT string_split(path, '/')[1] FROM {_first})"


@query(f"WITH t AS ({TREE}), h AS (SELECT r_name AS head FROM region UNION ALL SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0) SELECT path, head, substr(path, length(head) + 2) AS rest FROM t JOIN h ON starts_with(path, head || '/') QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(head) DESC) = 1")
def parsed_heads_path(spark, d):
    """The longest known head above each path, and the path that remains."""
    nation = read(spark, d, "nation").where("n_nationkey % 2 = 0").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    heads = read(spark, d, "region").select(F.col("r_name").alias("head")).unionByName(nation.select(F.concat_ws("/", "r_name", "n_name").alias("head")))
    return trees.longest_prefix(customer_tree(spark, d).select("path"), heads)


@query(f"""WITH t AS ({TREE}), e AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS path, string_split(path, '/')[1] AS a, CASE WHEN n > 1 THEN string_split(path, '/')[2] ELSE '' END AS b, CASE WHEN n > 2 THEN string_split(path, '/')[3] ELSE '' END AS c FROM t, (VALUES (1), (2), (3)) v(n))
SELECT path, row_number() OVER (PARTITION BY a ORDER BY {natural('b')}, {natural('c')}) AS place FROM e""")
def tree_walk_preorder(spark, d):
    """Each entry's place in the walk of its directory of the root."""
    order = Window.partitionBy(F.substring_index("path", "/", 1)).orderBy(trees.preorder_key(F.col("path"), F.col("is_dir"), natural_key))
    return trees.with_directories(customer_tree(spark, d)).select("path", F.row_number().over(order).cast("long").alias("place"))


@query(f"WITH t AS ({TREE}) SELECT string_split(path, '/')[1] AS top, arg_min(path, sha1('7:' || path)) AS path FROM t GROUP BY 1")
def random_file(spark, d):
    return trees.pick(customer_tree(spark, d).withColumn("top", F.substring_index("path", "/", 1)), "7", "top")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def key_value_latest(spark, d):
    """Of each key the value that was put last."""
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(last.alias("x")).select("user_id", "event_type", "x.*")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def trees_to_store(spark, d):
    """Trees that are not marked as fully stored."""
    marked = read(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").select("o_custkey").distinct().join(marked, "o_custkey", "left_anti")


@query("SELECT conv_id, turn, role AS author, sha1(text) AS target, concat_ws(',', CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END, CASE WHEN turn > 1 THEN conv_id || '-' || (turn - 2) END) AS parents, CAST(least(turn, 2) AS BIGINT) AS n_parents FROM conversations")
def create_commit(spark, d):
    """Commits with their parents, those that are null left out."""
    parent = lambda back: F.when(F.col("turn") >= back, F.concat_ws("-", "conv_id", F.col("turn") - back))
    rows = read(spark, d, "conversations").withColumn("p", F.array_compact(F.array(parent(1), parent(2))))
    return rows.select("conv_id", "turn", F.col("role").alias("author"), F.sha1(F.col("text").cast("binary")).alias("target"), F.array_join("p", ",").alias("parents"), F.size("p").cast("long").alias("n_parents"))


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ' ' ORDER BY l_returnflag || l_linestatus) AS flags FROM lineitem GROUP BY 1")
def multimap_values(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), " ").alias("flags"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 3 THEN false ELSE true END AS on_by_default FROM orders")
def option_truth(spark, d):
    value = F.element_at(F.array(F.lit(None), *map(F.lit, ("false", "0", "", "yes", "x"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", option_true(value, True).alias("on_by_default"))


@query("SELECT doc_id, CASE WHEN length(text) > 75 THEN '...' || right(text, 73) ELSE text END AS caption FROM documents")
def captions(spark, d):
    return read(spark, d, "documents").select("doc_id", caption(F.col("text")).alias("caption"))


@query("SELECT page_id, repeat('../', CAST(length(p) - length(replace(p, '/', '')) AS BIGINT)) AS up FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '') AS p FROM pages)")
def relative_to_root(spark, d):
    return read(spark, d, "pages").select("page_id", up_to_root(F.regexp_replace("url", "^[a-z]+://[^/]*/", "")).alias("up"))


@query("SELECT p_partkey, p_partkey % 4 IN (1, 2) AS is_image FROM part")
def image_names(spark, d):
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, (".txt", ".JPG", ".png", "jpg"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return read(spark, d, "part").select("p_partkey", name.rlike(IMAGE_NAME).alias("is_image"))


@query("SELECT doc_id, count(*) AS entries, min(x) AS first FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x FROM documents) WHERE x <> '' AND x NOT LIKE '#%' GROUP BY doc_id")
def uri_list_entries(spark, d):
    """Entries of lists, one a line, without blank lines and comments."""
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x")).withColumn("x", F.trim("x"))
    return lines.where("x <> '' AND NOT startswith(x, '#')").groupBy("doc_id").agg(F.count("*").alias("entries"), F.min("x").alias("first"))


@query("SELECT event_id, concat_ws(' ', event_type, user_id, event_id) AS line FROM events")
def event_log_lines(spark, d):
    return read(spark, d, "events").select("event_id", F.concat_ws(" ", "event_type", "user_id", "event_id").alias("line"))


# Formats, file names and conversions


@query("SELECT c_custkey, n AS name, CASE n WHEN 'who' THEN c_name WHEN 'flag' THEN 'flag' ELSE 'a=b+c' END AS value FROM customer, (VALUES ('who'), ('flag'), ('x y')) v(n)")
def query_args_decoded(spark, d):
    uri = F.concat(F.lit("http://host/page?who="), percent_encode(F.col("c_name")), F.lit("&flag&x%20y=a=b+c"))
    return read(spark, d, "customer").select("c_custkey", F.inline(query_arguments(uri)))


@query("SELECT p_partkey, sha1(p_name) AS hash FROM part")
def base32_decoded(spark, d):
    """The hash again, from its base32 in small letters with dashes."""
    coded = F.regexp_replace(F.lower(base32_of_hex(F.sha1(F.col("p_name").cast("binary")), 20)), "(....)", "$1-")
    return read(spark, d, "part").select("p_partkey", F.lower(F.hex(base32_decode(coded))).alias("hash"))


@query("""SELECT p_partkey, lower(hex(encode(p_name))) AS url_hex, regexp_replace(hex(encode(p_name)), '(..)', '%\\1', 'g') AS hex_url, p_name AS base32_none, upper(hex(encode(p_name))) AS none_upper FROM part""")
def convert_codecs(spark, d):
    name = F.col("p_name")
    return read(spark, d, "part").select(
        "p_partkey", convert(convert(name, "none", "url"), "url", "hex").alias("url_hex"), convert(convert(name, "none", "hex"), "hex", "url").alias("hex_url"),
        convert(convert(name, "none", "base32"), "base32", "none").alias("base32_none"), convert(name, "none", "upper-hex").alias("none_upper"),
    )


@query("SELECT o_orderkey, epoch_ms(o_orderdate) AS with_zone, epoch_ms(o_orderdate) AS without, CAST(NULL AS BIGINT) AS bad FROM orders")
def parse_dates(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    at = lambda t: F.unix_millis(parse_date(t))
    return read(spark, d, "orders").select("o_orderkey", at(F.concat(day, F.lit(" GMT"))).alias("with_zone"), at(day).alias("without"), at(F.concat(F.lit("on "), day)).alias("bad"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'file://host/a%20b/' WHEN 1 THEN 'file:///a%20b/' WHEN 2 THEN 'file:///C:/a/' WHEN 3 THEN 'http://h/' ELSE 'file:a/' END || CASE WHEN c_custkey % 5 = 3 THEN c_name ELSE replace(c_name, '#', '%23') END AS uri,
CASE c_custkey % 5 WHEN 0 THEN 'host' WHEN 1 THEN '' WHEN 2 THEN '' END AS host, CASE c_custkey % 5 WHEN 0 THEN '/a b/' WHEN 1 THEN '/a b/' WHEN 2 THEN '/C:/a/' WHEN 3 THEN 'http://h/' ELSE 'a/' END || c_name AS path FROM customer""")
def file_uris(spark, d):
    """Paths of a host, of this machine, with a drive letter, a URI and a relative path; and back."""
    start = F.element_at(F.array(*map(F.lit, ("//host/a b/", "/a b/", "C:\\a\\", "http://h/", "a/"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = read(spark, d, "customer").select("c_custkey", file_uri(F.concat(start, "c_name")).alias("uri"))
    return rows.withColumn("p", file_path(F.col("uri"))).select("c_custkey", "uri", "p.host", "p.path")


@query("SELECT event_id, props || ' A < ü & é;' AS text FROM events")
def xml_unescape_props(spark, d):
    return read(spark, d, "events").select("event_id", xml_unescape(F.concat(xml_escape(F.col("props")), F.lit(" &#65; &lt; &#252; & &#xE9;;"))).alias("text"))


@query("SELECT p_partkey, CAST(p_size * 10 AS BIGINT) AS half_w, CAST(floor(p_size * 5 + 25) AS BIGINT) AS half_h, CAST(60 AS BIGINT) AS wide_w, CAST(floor((p_size * 10 + 50) * 60.0 / (p_size * 20)) AS BIGINT) AS wide_h, CAST(7 AS BIGINT) AS free_w, CAST(p_size * 10 + 50 AS BIGINT) AS free_h FROM part")
def image_scale_options(spark, d):
    w, h = F.col("p_size").cast("double") * 20, F.col("p_size").cast("double") * 10 + 50
    each = {"half": scaled_size(w, h, scale=0.5), "wide": scaled_size(w, h, width=60), "free": scaled_size(w, h, width=7, keep_aspect=False)}
    return read(spark, d, "part").select("p_partkey", *[s[side].alias(f"{name}_{side[0]}") for name, s in each.items() for side in ("width", "height")])


@query("SELECT doc_id, doc_id % 3 <> 1 AS sha1, doc_id % 3 <> 0 AS tiger, doc_id % 3 = 2 AS bitprint FROM documents")
def urn_translatable(spark, d):
    sha = F.substring(sha1_urn(F.col("text")), 10, 32)
    urn_ = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("urn:sha1:"), sha)).when(F.col("doc_id") % 3 == 1, F.lit("urn:tree:tiger:" + "C" * 39)).otherwise(F.concat(F.lit("urn:bitprint:"), sha, F.lit("." + "C" * 39)))
    return read(spark, d, "documents").select("doc_id", urn_kinds(urn_).alias("k")).select("doc_id", "k.*")


# Trees with directories


SIDES = """WITH w AS (SELECT CAST(o_custkey AS VARCHAR) AS c, CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) AS p, o_custkey AS k, o_orderkey AS o, md5(CAST(o_orderkey % 5 AS VARCHAR)) AS u,
    md5(CAST(o_orderkey % 5 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS v FROM orders),
o AS (SELECT p AS path, false AS is_dir, u AS urn FROM w WHERE k % 11 <> 0 AND o % 4 <> 0 UNION SELECT c, true, NULL FROM w WHERE k % 11 <> 0 AND o % 4 <> 0 UNION SELECT c, false, md5('old') FROM w WHERE k % 11 = 0),
n AS (SELECT p AS path, false AS is_dir, v AS urn FROM w WHERE k % 7 <> 0 AND o % 5 <> 0 UNION SELECT c, true, NULL FROM w WHERE k % 7 <> 0 AND o % 5 <> 0 UNION SELECT c, false, md5('new') FROM w WHERE k % 7 = 0),
b AS (SELECT coalesce(o.path, n.path) AS path, o.is_dir AS od, n.is_dir AS nd, coalesce(NOT o.is_dir AND NOT n.is_dir AND o.urn = n.urn, false) AS same FROM o FULL JOIN n ON o.path = n.path),
c AS (SELECT path, 'DD' AS op, 0 AS seq, od AND coalesce(NOT nd, true) AS dd FROM b WHERE od AND coalesce(NOT nd, true) UNION ALL SELECT path, 'D', 1, false FROM b WHERE NOT od AND NOT same
    UNION ALL SELECT path, 'A', 2, coalesce(od, false) FROM b WHERE NOT nd AND NOT same)"""


def mixed_trees(spark, d):
    """Customers' directories of orders before and after; some customers are files on one side."""
    orders = read(spark, d, "orders").withColumn("top", F.col("o_custkey").cast("string"))
    key = F.col("o_orderkey")

    def side(kept, as_file, digit, name):
        files = orders.where(kept).where(~as_file).select(F.concat_ws("/", "top", "o_orderkey").alias("path"), F.md5(digit.cast("string").cast("binary")).alias("urn"))
        return changes.entries(files.unionByName(orders.where(as_file).select(F.col("top").alias("path"), F.md5(F.lit(name).cast("binary")).alias("urn")).distinct()))

    old = side(key % 4 != 0, F.col("o_custkey") % 11 == 0, key % 5, "old")
    return old, side(key % 5 != 0, F.col("o_custkey") % 7 == 0, key % 5 + F.when(key % 3 == 0, 1).otherwise(0), "new")


@query(f"{SIDES} SELECT path, op FROM c")
def tree_changes(spark, d):
    return changes.changes(*mixed_trees(spark, d)).select("path", "op")


@query(f"{SIDES} SELECT string_split(path, '/')[1] AS top, string_agg(rpad(op, 3, ' ') || path, chr(10) ORDER BY CASE WHEN dd THEN path || '/' || chr(1114111) ELSE path END, seq) AS dump FROM c GROUP BY 1")
def tree_changes_dump(spark, d):
    return changes.dump(changes.changes(*mixed_trees(spark, d)))


@query(f"{SIDES} SELECT path, is_dir, urn, CAST(NULL AS VARCHAR) AS conflict FROM n")
def tree_changes_apply(spark, d):
    """The changes made to the old tree give the new one, directories too."""
    old, new = mixed_trees(spark, d)
    return changes.apply_changes(old, changes.changes(old, new), new)


@query(f"""{SIDES}, m AS (SELECT path FROM o JOIN n USING (path) WHERE o.is_dir <> n.is_dir)
SELECT coalesce(o.path, n.path) AS path, coalesce(o.is_dir, n.is_dir) AS is_dir, CASE WHEN o.path IS NOT NULL AND (string_split(o.path, '/')[1] IN (SELECT path FROM m) OR n.path IS NULL) THEN o.urn ELSE n.urn END AS urn,
CASE WHEN string_split(coalesce(o.path, n.path), '/')[1] IN (SELECT path FROM m) THEN 'mixed' END AS conflict
FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NOT NULL OR string_split(n.path, '/')[1] NOT IN (SELECT path FROM m)""")
def tree_merge_replace_files(spark, d):
    return changes.merge(*mixed_trees(spark, d), files="Replace")


# Paths through commits, namespaces, caches

LINKS = """SELECT 'r' || n_regionkey AS node, n_name AS step, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'n' || c_nationkey, c_name, 'c' || c_custkey FROM customer
UNION ALL SELECT 'x' || r_regionkey, 'target', 'r' || r_regionkey FROM region"""
ASKED = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'r' END || n_regionkey AS source,
CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 7 = 0 THEN 'parent//' ELSE 'target//' END ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN 'NOWHERE' ELSE n_name END || '/' || c_name || CASE WHEN c_custkey % 11 = 0 THEN '/more' ELSE '//' END AS path
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@query(f"""WITH RECURSIVE l AS ({LINKS}), walk AS (SELECT c_custkey, source AS place, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts, 'found' AS outcome FROM ({ASKED})
UNION ALL SELECT c_custkey, coalesce(l.target, w.place), w.parts[2:], CASE WHEN l.target IS NOT NULL THEN 'found' WHEN w.place[1] IN ('r', 'n') THEN 'missing' ELSE 'not applicable' END FROM walk w LEFT JOIN l ON l.node = w.place AND l.step = w.parts[1] WHERE w.outcome = 'found' AND len(w.parts) > 0)
SELECT c_custkey, outcome, place FROM walk WHERE outcome <> 'found' OR len(parts) = 0""")
def follow_commit_path(spark, d):
    nation, customer, region = (read(spark, d, x) for x in ("nation", "customer", "region"))
    named = lambda kind, key: F.concat(F.lit(kind), key)
    entries = nation.select(named("r", "n_regionkey").alias("directory"), F.col("n_name").alias("name"), named("n", "n_nationkey").alias("target"))
    entries = entries.unionByName(customer.select(named("n", "c_nationkey").alias("directory"), F.col("c_name").alias("name"), named("c", "c_custkey").alias("target")))
    commits_ = region.select(named("x", "r_regionkey").alias("commit"), named("r", "r_regionkey").alias("target"))
    even = F.col("c_custkey") % 2 == 0
    head = F.when(even & (F.col("c_custkey") % 7 == 0), "parent//").when(even, "target//").otherwise("")
    path = F.concat(head, F.when(F.col("c_custkey") % 5 == 0, "NOWHERE").otherwise(F.col("n_name")), F.lit("/"), "c_name", F.when(F.col("c_custkey") % 11 == 0, "/more").otherwise("//"))
    asked = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    asked = asked.select(F.col("c_custkey").alias("id"), F.concat(F.when(even, "x").otherwise("r"), "n_regionkey").alias("source"), path.alias("path"))
    return paths.follow(asked, entries, commits_).select(F.col("id").alias("c_custkey"), "outcome", F.col("at").alias("place"))


@query("""WITH n AS (SELECT doc_id, doc_id % 50 AS doc, 'http://' || source || '.example/' || lang || CASE WHEN doc_id % 3 = 0 THEN '/terms#' ELSE '/' END || 'n' || doc_id % 17 AS name FROM documents),
k AS (SELECT *, CASE WHEN name LIKE 'http://src0.example/en/_%' THEN NULL ELSE regexp_extract(name, '^(.*[#/])', 1) END AS space FROM n),
f AS (SELECT doc, space, row_number() OVER (PARTITION BY doc ORDER BY min(doc_id)) - 1 AS i FROM k WHERE space IS NOT NULL GROUP BY doc, space)
SELECT doc_id, CASE WHEN name IS NULL THEN NULL WHEN k.space IS NULL THEN 'en:' || substr(name, 24) ELSE 'a' || f.i || ':' || substr(name, length(k.space) + 1) END AS short, name FROM k LEFT JOIN f ON f.doc = k.doc AND f.space = k.space""")
def namespace_names(spark, d):
    """Long names made short and long again."""
    name = F.concat(F.lit("http://"), "source", F.lit(".example/"), "lang", F.when(F.col("doc_id") % 3 == 0, "/terms#").otherwise("/"), F.lit("n"), F.col("doc_id") % 17)
    names = read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 50).alias("doc"), F.col("doc_id").alias("pos"), name.alias("name"))
    short = namespaces.shorten(names, {"en": "http://src0.example/en/"})
    return namespaces.expand(short.select("doc", "doc_id", "short"), short.where("prefix IS NOT NULL").select("doc", "prefix", "namespace")).select("doc_id", "short", "name")


@query("""SELECT user_id || ':' || event_type AS key, CASE WHEN arg_max(event_id, event_id) % 3 <> 0 THEN arg_max(props, event_id) END AS value, CASE WHEN arg_max(event_id, event_id) % 3 = 0 THEN 'urn:e:' || max(event_id) END AS uri FROM events GROUP BY 1""")
def function_results(spark, d):
    """What is cached of each function and argument: the last result, a text or a reference."""
    key = F.concat_ws(":", "user_id", "event_type")
    uri = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("urn:e:"), "event_id"))
    return caches.results(read(spark, d, "events").select(key.alias("key"), caches.stored_result(F.col("props"), uri).alias("stored"), "event_id"), "event_id")


@query(f"""WITH t AS (SELECT doc_id, {urn("text")} AS own, sha1(text) IN (SELECT sha1(text) FROM documents WHERE lang = 'en') AS present FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, own, CASE WHEN doc_id % 4 = 2 THEN 'unverifiable' WHEN doc_id % 7 = 0 THEN 'mismatch' WHEN present THEN 'present' ELSE 'cached' END AS outcome FROM t)
SELECT doc_id, outcome, CASE WHEN outcome = 'cached' THEN own END AS stored_urn FROM o""")
def cache_remote_blobs(spark, d):
    """Blobs that were fetched by address: verified, then stored if they are new."""
    docs = read(spark, d, "documents").where("text IS NOT NULL").withColumn("own", sha1_urn(F.col("text")))
    asked = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("urn:bitprint:"), F.substring("own", 10, 32), F.lit("." + "A" * 39))).when(F.col("doc_id") % 4 == 2, F.lit("urn:tree:tiger:" + "A" * 39)).otherwise(F.col("own"))
    content = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    fetched = docs.select("doc_id", asked.alias("urn"), content.alias("content"))
    return caches.cached(fetched, docs.where("lang = 'en'").select(F.col("own").alias("sha1_urn"))).select("doc_id", "outcome", "stored_urn")
