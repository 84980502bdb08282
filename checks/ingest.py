"""Sources, sinks and ingest transforms."""

from pyspark.sql import functions as F

from annalist import schemas
from annalist.functions import fields, sqlfn, timefn
from annalist.operators import linecount, long_sections, sections, tags
from annalist.plans.load import load, stage
from annalist.sources import logs, manifest as manifests, shared, tables
from checks import views
from checks.registry import LOCAL, OFFSET, TIMEZONE, UNIX, YEAR, check

_COMMIT = ", ".join(schemas.columns(schemas.COMMIT))
_CHANGE = ", ".join(schemas.columns(schemas.CHANGE))


def _staged(spark, sf_dir, damaged=False):
    """The exported log, parsed and staged once; reading it is what every query shares."""
    log = (views.damaged_log_path if damaged else views.log_path)(spark, sf_dir)
    manifest = views.stored_manifest(spark, sf_dir)
    path = views.once(
        spark,
        sf_dir,
        "damaged-parsed" if damaged else "parsed",
        lambda p: stage(spark, p, manifest, log),
    )
    return spark.read.schema(schemas.PARSED).parquet(path)


@check(
    "ingest_log_sections",
    """SELECT repo_name, count(DISTINCT o_orderkey) AS sections, count(l_orderkey) AS change_lines
       FROM (SELECT concat(c_mktsegment, '/', n_name) AS repo_name, o_orderkey
             FROM orders JOIN customer ON o_custkey = c_custkey
                         JOIN nation ON c_nationkey = n_nationkey)
            LEFT JOIN lineitem ON l_orderkey = o_orderkey
       GROUP BY repo_name""",
)
def ingest_log_sections(spark, sf_dir):
    parsed = sections.parse_sections(logs.read_log(spark, views.log_path(spark, sf_dir)))
    return parsed.groupBy("repo_name").agg(
        F.count(F.lit(1)).alias("sections"),
        F.sum(F.size("entries").cast("bigint")).alias("change_lines"),
    )


@check("ingest_commit", f"SELECT {_COMMIT} FROM f_commit")
def ingest_commit(spark, sf_dir):
    return sections.commits(sections.accepted(_staged(spark, sf_dir))).select(
        *schemas.columns(schemas.COMMIT)
    )


@check("ingest_change", f"SELECT {_CHANGE} FROM f_change")
def ingest_change(spark, sf_dir):
    return sections.changes(sections.accepted(_staged(spark, sf_dir))).select(
        *schemas.columns(schemas.CHANGE)
    )


@check(
    "commit_file_count",
    """SELECT repo_name, hash, count(l_orderkey) AS files
       FROM f_commit LEFT JOIN lineitem ON md5(CAST(l_orderkey AS STRING)) = hash
       GROUP BY repo_name, hash""",
)
def commit_file_count(spark, sf_dir):
    return sections.file_counts(sections.accepted(_staged(spark, sf_dir)))


@check(
    "ingest_rejects",
    """SELECT concat(c_mktsegment, '/', n_name) AS repo_name,
              CASE o_orderpriority WHEN '5-LOW' THEN 'header' ELSE 'change' END AS reject,
              count(*) AS sections
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       WHERE o_orderstatus = 'P' GROUP BY ALL""",
)
def ingest_rejects(spark, sf_dir):
    return sections.reject_counts(_staged(spark, sf_dir, damaged=True))


@check(
    "ingest_damaged_change",
    f"""SELECT {_CHANGE} FROM f_change WHERE hash NOT IN (
          SELECT md5(CAST(o_orderkey AS STRING)) FROM orders WHERE o_orderstatus = 'P')""",
)
def ingest_damaged_change(spark, sf_dir):
    """A commit with one bad line loses all its changes; the others keep theirs."""
    return sections.changes(sections.accepted(_staged(spark, sf_dir, damaged=True))).select(
        *schemas.columns(schemas.CHANGE)
    )


@check(
    "ingest_giant_commit",
    f"""SELECT {", ".join("k." + c for c in schemas.columns(schemas.COMMIT))}, l.ext,
               CAST(sum(l.ins) AS BIGINT) AS insertion, CAST(sum(l.del) AS BIGINT) AS deletion
        FROM f_commit k JOIN (
          SELECT md5(CAST(CASE WHEN l_partkey % 3 = 0 THEN (SELECT min(o_orderkey) FROM orders)
                               ELSE l_orderkey END AS STRING)) AS hash,
                 CASE l_partkey % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'go' WHEN 2 THEN 'js'
                                    WHEN 3 THEN 'html' WHEN 4 THEN 'css' ELSE '' END AS ext,
                 CAST(l_quantity AS BIGINT) AS ins, CAST(l_linenumber AS BIGINT) AS del
          FROM lineitem) l ON k.hash = l.hash
        GROUP BY ALL""",
)
def ingest_giant_commit(spark, sf_dir):
    """One commit with a third of all change lines, read in blocks that end inside it."""
    log = views.giant_log_path(spark, sf_dir)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(_BLOCK_BYTES, shared.size(spark, log) // _BLOCKS)))
    try:
        _, changes = long_sections.parse(logs.read_log_lines(spark, log), views.stored_manifest(spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return changes.select(*schemas.columns(schemas.CHANGE))


# Small enough for the giant commit to lie over several blocks at every size of the tables, and few
# enough of them for the tasks not to grow in number with the log.
_BLOCK_BYTES, _BLOCKS = 65_536, 256


@check("ingest_tags", "SELECT repo_name, branch, datetime, tag FROM f_tag")
def ingest_tags(spark, sf_dir):
    commits = sections.commits(sections.accepted(_staged(spark, sf_dir)))
    refs = logs.read_refs(spark, views.refs_path(spark, sf_dir))
    return tags.tags(refs, commits, views.stored_manifest(spark, sf_dir))


@check(
    "ingest_tag_rejects",
    """SELECT repo_name, count(*) AS tags FROM f_commit JOIN orders
         ON hash = md5(CAST(o_orderkey AS STRING))
       WHERE o_orderpriority = '2-HIGH' AND o_orderkey % 5 = 0 GROUP BY repo_name""",
)
def ingest_tag_rejects(spark, sf_dir):
    commits = sections.commits(sections.accepted(_staged(spark, sf_dir)))
    return tags.tag_rejects(logs.read_refs(spark, views.refs_path(spark, sf_dir)), commits)


@check(
    "ingest_tag_ancestors",
    """WITH RECURSIVE line AS (
         SELECT repo_name, hash, datetime, o_orderkey, o_orderpriority,
                row_number() OVER (PARTITION BY repo_name ORDER BY o_orderkey) AS n
         FROM f_commit JOIN orders ON hash = md5(CAST(o_orderkey AS STRING))),
       edges AS (
         SELECT repo_name, n AS child, unnest(CASE WHEN n % 40 IN (0, 17) THEN [n - 1]
                WHEN n % 40 IN (1, 18) THEN [n - 2, n - 5] ELSE [n - 1, n - 5] END) AS parent FROM line),
       real AS (SELECT * FROM edges WHERE parent > 0),
       merges AS (SELECT repo_name, child FROM real GROUP BY ALL HAVING count(*) > 1),
       walk AS (
         SELECT repo_name, o_orderkey, n AS node FROM line WHERE o_orderpriority = '1-URGENT'
         UNION
         SELECT w.repo_name, w.o_orderkey, e.parent
         FROM walk w JOIN merges m ON m.repo_name = w.repo_name AND m.child = w.node
                     JOIN real e ON e.repo_name = w.repo_name AND e.child = w.node),
       ends AS (
         SELECT repo_name, o_orderkey, max(node) AS n
         FROM walk WHERE NOT EXISTS (SELECT 1 FROM merges m WHERE m.repo_name = walk.repo_name AND m.child = node)
         GROUP BY ALL)
       SELECT e.repo_name, 'main' AS branch, datetime, concat('v', CAST(e.o_orderkey AS STRING)) AS tag
       FROM ends e JOIN line USING (repo_name, n)""",
)
def ingest_tag_ancestors(spark, sf_dir):
    """Tags on merges, dated by the newest commit behind them that is none."""
    refs = views.keyed_commits(spark, sf_dir).filter(F.col("o_orderpriority") == "1-URGENT")
    refs = refs.select("repo_name", "hash", F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("tag"))
    commits = sections.commits(sections.accepted(_staged(spark, sf_dir)))
    parents = logs.read_parents(spark, views.parents_path(spark, sf_dir))
    return tags.tags(refs, commits, views.stored_manifest(spark, sf_dir), parents)


@check(
    "head_line",
    """SELECT repo_name, arg_min(datetime, o_orderkey) AS datetime
       FROM f_commit JOIN orders ON hash = md5(CAST(o_orderkey AS STRING)) GROUP BY repo_name""",
)
def head_line(spark, sf_dir):
    """The line for HEAD decides, also where other commits are later."""
    lines = logs.read_heads(spark, views.refs_path(spark, sf_dir))
    return tags.heads(views.commits(spark, sf_dir), lines)


@check(
    "ingest_commit_datetime",
    """SELECT hash, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE datetime END AS datetime
       FROM f_commit JOIN orders ON hash = md5(CAST(o_orderkey AS STRING))""",
)
def ingest_commit_datetime(spark, sf_dir):
    """RFC 2822 dates; those of low priority are in a format that is none."""
    plain = F.concat(
        timefn.weekday("datetime"),
        F.date_format(timefn.local_ts("datetime"), " MMM d HH:mm:ss yyyy +0000"),
    )
    raw = F.when(F.col("o_orderpriority") == "5-LOW", plain).otherwise(views.mail_date("datetime"))
    keyed = views.keyed_commits(spark, sf_dir).select("hash", raw.alias("raw_date"))
    return keyed.select("hash", sections.mail_date_to_rfc3339("raw_date").alias("datetime"))


@check(
    "head_commit",
    f"""SELECT repo_name, datetime FROM (
          SELECT repo_name, datetime,
                 row_number() OVER (PARTITION BY repo_name
                                    ORDER BY {UNIX} DESC, {OFFSET} DESC) AS place
          FROM f_commit) WHERE place = 1""",
)
def head_commit(spark, sf_dir):
    return tags.heads(views.commits(spark, sf_dir))


# Fixed mapping: a rename, a second rule for the same source, a chain, a name with the wrong
# mail address.
_MAPPING = (
    ("user7", "user7@d7.example.com", "seven", "seven@example.org"),
    ("user7", "user7@d7.example.com", "late", "late@example.org"),
    ("user8", "user8@d0.example.com", "user9", "user9@d1.example.com"),
    ("user9", "user9@d1.example.com", "nine", "nine@nine@example.org"),
    ("user10", "user10@d3.example.com", "never", "never@example.org"),
)


@check(
    "author_mapping",
    """SELECT hash,
         CASE author_name WHEN 'user7' THEN 'seven' WHEN 'user8' THEN 'user9'
                          WHEN 'user9' THEN 'nine' ELSE author_name END AS author_name,
         CASE author_name WHEN 'user7' THEN 'seven@example.org'
                          WHEN 'user8' THEN 'user9@d1.example.com'
                          WHEN 'user9' THEN 'nine@nine@example.org' ELSE author_email END
           AS author_email,
         CASE author_name WHEN 'user7' THEN 'example.org' WHEN 'user8' THEN 'd1.example.com'
                          WHEN 'user9' THEN 'nine@example.org' ELSE author_domain END
           AS author_domain
       FROM f_commit""",
)
def author_mapping(spark, sf_dir):
    mapping = sections.author_rules(spark, _MAPPING)
    mapped = sections.map_authors(views.commits(spark, sf_dir), mapping)
    return mapped.select(
        "hash",
        "author_name",
        "author_email",
        sections.email_domain("author_email").alias("author_domain"),
    )


@check(
    "email_domain",
    """SELECT hash, CASE o_orderstatus WHEN 'F' THEN author_domain
                    WHEN 'O' THEN concat('x@', author_domain) ELSE author_name END AS domain
       FROM f_commit JOIN orders ON hash = md5(CAST(o_orderkey AS STRING))""",
)
def email_domain(spark, sf_dir):
    """Ordinary addresses, addresses with two ``@``, and names without one."""
    email = (
        F.when(F.col("o_orderstatus") == "F", F.col("author_email"))
        .when(
            F.col("o_orderstatus") == "O",
            F.concat(F.col("author_name"), F.lit("@x@"), F.col("author_domain")),
        )
        .otherwise(F.col("author_name"))
    )
    keyed = views.keyed_commits(spark, sf_dir).select("hash", email.alias("email"))
    return keyed.select("hash", sections.email_domain("email").alias("domain"))


@check(
    "file_ext",
    """SELECT l_orderkey, l_linenumber,
         CASE l_partkey % 9 WHEN 2 THEN 'gz' WHEN 3 THEN 'rs' WHEN 4 THEN 'py'
              WHEN 7 THEN 'c' WHEN 8 THEN concat('t', CAST(l_suppkey AS STRING)) ELSE '' END AS ext
       FROM lineitem""",
)
def file_ext(spark, sf_dir):
    """Paths of nine shapes, one for each kind of edge."""
    name = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    shapes = (
        (F.lit(""), F.lit("/.gitignore")),
        (F.lit("docs.d/"), F.lit("/LICENSE")),
        (F.lit("a/"), F.lit(".tar.gz")),
        (F.lit("src/{a.c => "), F.lit(".rs}")),
        (F.lit('"x/\\346'), F.lit('.py"')),
        (F.lit("dir.d/"), F.lit("")),
        (F.lit("a/"), F.lit(".")),
        (F.lit("b.go/"), F.lit(".h.c")),
        (F.lit("a b/"), F.concat(F.lit(".t"), F.col("l_suppkey").cast("string"))),
    )
    path = F.lit(None).cast("string")
    for number, (before, after) in enumerate(shapes):
        path = F.when(F.col("l_partkey") % 9 == number, F.concat(before, name, after)).otherwise(path)
    items = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", path.alias("path")
    )
    return items.select("l_orderkey", "l_linenumber", sections.file_ext("path").alias("ext"))


@check(
    "snapshot_lines", "SELECT repo_name, ext, code, comments, blanks FROM f_snapshot"
)
def snapshot_lines(spark, sf_dir):
    return linecount.count_lines(views.sources(spark, sf_dir), (), views.COMMENT_PREFIXES)


@check(
    "snapshot_text_scan",
    """SELECT repo_name, ext, CAST(sum(code) AS BIGINT) AS code,
              CAST(sum(comments) AS BIGINT) AS comments, CAST(sum(blanks) AS BIGINT) AS blanks
       FROM f_code WHERE ext IS NOT NULL GROUP BY repo_name, ext""",
)
def snapshot_text_scan(spark, sf_dir):
    """Files written, scanned and counted with the default languages."""
    return linecount.count_lines(views.code_records(spark, sf_dir))


@check(
    "snapshot_skipped",
    """SELECT repo_name, 'bin' AS ext, count(DISTINCT path) AS files
       FROM f_code WHERE ext IS NULL GROUP BY repo_name""",
)
def snapshot_skipped(spark, sf_dir):
    return linecount.skipped_files(views.code_records(spark, sf_dir))


_BLOCK_FILES = ", ".join(
    f"({n}, '{ext}', {code}, {comments}, {inside})"
    for n, (_, _, _, ext, code, comments, inside) in enumerate(views.BLOCK_FILES)
)


@check(
    "snapshot_block_comments",
    f"""WITH files AS (SELECT * FROM (VALUES {_BLOCK_FILES}) v(k, ext, code, comments, inside)),
        body AS (
          SELECT source, k, trim(unnest(string_split(
                   regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ' || chr(10) || ']', '', 'g'), chr(10)))) AS line
          FROM documents JOIN files ON doc_id % {len(views.BLOCK_FILES)} = k),
        lines AS (
          SELECT source, k, count(*) FILTER (line <> '') AS text, count(*) FILTER (line = '') AS blanks
          FROM body GROUP BY ALL),
        per_file AS (SELECT source, doc_id % {len(views.BLOCK_FILES)} AS k, count(*) AS n FROM documents GROUP BY ALL)
        SELECT source AS repo_name, ext,
               CAST(n * code + CASE WHEN inside THEN 0 ELSE text END AS BIGINT) AS code,
               CAST(n * comments + CASE WHEN inside THEN text ELSE 0 END AS BIGINT) AS comments,
               CAST(blanks AS BIGINT) AS blanks
        FROM per_file JOIN lines USING (source, k) JOIN files USING (k)""",
)
def snapshot_block_comments(spark, sf_dir):
    """Block, nested and quoted comment markers around whole documents, in seven languages."""
    return linecount.count_lines(views.block_sources(spark, sf_dir))


@check(
    "scan_source_records",
    """SELECT repo_name, path, CAST(length(text) AS INTEGER) AS chars, md5(text) AS digest
       FROM f_source""",
)
def scan_source_records(spark, sf_dir):
    """Source files written as records and read again, whole texts compared by digest."""
    path = shared.folder(spark, "sources")
    views.sources(spark, sf_dir).select("repo_name", "path", "text").write.json(path)
    return logs.read_source_records(spark, path).select(
        "repo_name", "path", F.length("text").alias("chars"), F.md5("text").alias("digest")
    )


@check("active_from_manifest", "SELECT repo_name, forks, stars FROM f_active")
def active_from_manifest(spark, sf_dir):
    return manifests.active(views.manifest(spark, sf_dir))


_MANIFEST_SQL = """SELECT repo_name AS name, 'main' AS branch,
       concat('https://example.com/', repo_name, '.git') AS remote,
       concat('/srv/', repo_name) AS path,
       forks AS forks_count, stars AS stargazers_count FROM f_active"""


@check("manifest_union", f"{_MANIFEST_SQL} UNION ALL {_MANIFEST_SQL}")
def manifest_union(spark, sf_dir):
    """An inline list and a list file with the same repositories: all stay, twice."""
    inline = views.manifest(spark, sf_dir)
    path = shared.folder(spark, "manifest")
    inline.write.json(path)
    return manifests.combine(inline, manifests.read_manifests(spark, [path]))


@check("manifest_from_api", _MANIFEST_SQL)
def manifest_from_api(spark, sf_dir):
    """API responses saved as JSON arrays, a page per owner: at most one entry per nation."""
    listed = views.manifest(spark, sf_dir)
    path = shared.folder(spark, "api")
    responses = listed.select(
        F.substring_index("name", "/", 1).alias("page"),
        F.to_json(
            F.struct(
                F.col("name").alias("full_name"),
                F.col("remote").alias("clone_url"),
                F.col("branch").alias("default_branch"),
                "forks_count",
                "stargazers_count",
            )
        ).alias("repository"),
    )
    (
        responses.groupBy("page")
        .agg(F.array_join(F.collect_list("repository"), ",").alias("entries"))
        .select("page", F.concat(F.lit("["), "entries", F.lit("]")).alias("value"))
        .write.partitionBy("page")
        .text(path)
    )
    return manifests.read_api_pages(spark, path, "/srv/").select(
        *schemas.columns(schemas.MANIFEST)
    )


_EXCLUDED = ("AUTO", "BUILDING/NATION_1", "HOUSE", "MACHINERY/NATION_7")


@check(
    "exclude_prefix",
    "SELECT repo_name AS name FROM f_active WHERE NOT ("
    + " OR ".join(f"starts_with(repo_name, '{p}')" for p in _EXCLUDED)
    + ")",
)
def exclude_prefix(spark, sf_dir):
    return manifests.exclude_prefixes(views.manifest(spark, sf_dir), _EXCLUDED).select("name")


_PREFIX_TABLE = """SELECT CASE c_custkey % 3 WHEN 0 THEN concat(c_mktsegment, '/', n_name)
                                WHEN 1 THEN concat(substr(c_mktsegment, 1, 3), '/')
                                ELSE concat(c_mktsegment, '/', substr(n_name, 1, length(n_name) - 1)) END AS prefix
                   FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < -900"""


@check(
    "exclude_prefix_table",
    f"""SELECT repo_name AS name FROM f_active
        WHERE NOT EXISTS (SELECT 1 FROM ({_PREFIX_TABLE}) p WHERE starts_with(repo_name, prefix))""",
)
def exclude_prefix_table(spark, sf_dir):
    """Prefixes in a table as long as the customers', whole names, beginnings and ones that fit nothing."""
    listed = views.table(spark, sf_dir, "customer").join(
        views.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    key, name = F.col("c_custkey"), F.concat("c_mktsegment", F.lit("/"), "n_name")
    prefix = (
        F.when(key % 3 == 0, name)
        .when(key % 3 == 1, F.concat(F.substring("c_mktsegment", 1, 3), F.lit("/")))
        .otherwise(F.expr("left(concat(c_mktsegment, '/', n_name), length(c_mktsegment) + length(n_name))"))
    )
    prefixes = listed.filter("c_acctbal < -900").select(prefix.alias("prefix"))
    return manifests.exclude_prefix_table(views.manifest(spark, sf_dir), prefixes).select("name")


@check("scan_csv_roundtrip", f"SELECT {_CHANGE} FROM f_change")
def scan_csv_roundtrip(spark, sf_dir):
    base = shared.folder(spark, "csv")
    tables.write_csv("change", views.changes(spark, sf_dir), base)
    return tables.read_csv(spark, "change", base)


@check(
    "scan_db_tables",
    """SELECT 'db_csv' AS db, 'active' AS name, count(*) AS n FROM f_active
       UNION ALL SELECT 'db_csv', 'tag', count(*) FROM f_tag
       UNION ALL SELECT 'db_parquet', 'commit', count(*) FROM f_commit
       UNION ALL SELECT 'db_parquet', 'tag', count(*) FROM f_tag""",
)
def scan_db_tables(spark, sf_dir):
    """Two databases, one per format, with different tables missing."""
    csv, parquet = shared.folder(spark, "db-csv"), shared.folder(spark, "db-parquet")
    tables.write_csv("active", views.active(spark, sf_dir), csv)
    tables.write_csv("tag", views.tags(spark, sf_dir), csv)
    tables.write_table("commit", views.commits(spark, sf_dir), parquet)
    tables.write_table("tag", views.tags(spark, sf_dir), parquet)
    found = [("db_csv", n) for n in tables.register_database(spark, "db_csv", csv, "csv")]
    found += [("db_parquet", n) for n in tables.register_database(spark, "db_parquet", parquet)]
    return spark.sql(
        " UNION ALL ".join(
            f"SELECT '{db}' AS db, '{name}' AS name, count(*) AS n FROM {db}.{name}"
            for db, name in found
        )
    )


@check(
    "sink_tables_roundtrip",
    f"""SELECT {_CHANGE}, CAST({LOCAL} AS STRING) AS local_ts, {UNIX} AS unix, {TIMEZONE} AS tz,
               {YEAR} AS commit_year
        FROM f_change""",
)
def sink_tables_roundtrip(spark, sf_dir):
    base = shared.folder(spark, "tables")
    tables.write_table("change", views.changes(spark, sf_dir), base)
    stored = tables.read_table(spark, "change", base)
    return stored.select(
        *schemas.columns(schemas.CHANGE),
        F.col("local_ts").cast("string").alias("local_ts"),
        fields.seconds(stored).alias("unix"),
        "tz",
        "commit_year",
    )


@check(
    "load_all",
    f"""SELECT 'commit' AS name, repo_name, count(*) AS n FROM f_commit GROUP BY 2
        UNION ALL SELECT 'change', repo_name, count(*) FROM f_change GROUP BY 2
        UNION ALL SELECT 'tag', repo_name, count(*) FROM f_tag GROUP BY 2
        UNION ALL SELECT 'active', repo_name, count(*) FROM f_active GROUP BY 2""",
)
def load_all(spark, sf_dir):
    """The whole load, its tables registered, counted per repository through SQL."""
    out = shared.folder(spark, "loaded")
    load(
        spark,
        out,
        views.stored_manifest(spark, sf_dir),
        views.log_path(spark, sf_dir),
        views.refs_path(spark, sf_dir),
    )
    tables.register_database(spark, "history", out)
    sqlfn.register(spark)
    return spark.sql(
        " UNION ALL ".join(
            f"SELECT '{name}' AS name, repo_name, count(*) AS n FROM history.{name} GROUP BY repo_name"
            for name in ("commit", "change", "tag", "active")
        )
    )


@check(
    "load_replace",
    """SELECT 'active' AS name, repo_name, count(*) AS n FROM f_active
       WHERE repo_name < 'B' GROUP BY repo_name
       UNION ALL SELECT 'commit', repo_name, count(*) FROM f_commit
       WHERE repo_name < 'B' GROUP BY repo_name
       UNION ALL SELECT 'change', repo_name, count(*) FROM f_change
       WHERE repo_name < 'B' GROUP BY repo_name""",
)
def load_replace(spark, sf_dir):
    """A second load of fewer repositories, without references, leaves nothing of the first."""
    out = shared.folder(spark, "replaced")
    manifest, log = views.stored_manifest(spark, sf_dir), views.log_path(spark, sf_dir)
    load(spark, out, manifest, log, views.refs_path(spark, sf_dir))
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        load(spark, out, manifest.filter(F.col("name") < "B"), log)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    counts = [
        tables.read_table(spark, name, out)
        .groupBy("repo_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("name"), "repo_name", "n")
        for name in schemas.TABLES
    ]
    both = counts[0]
    for one in counts[1:]:
        both = both.unionByName(one)
    return both


@check(
    "load_snapshot",
    """SELECT c.repo_name, 'main' AS branch, c.datetime, s.ext, s.code, s.comments, s.blanks
       FROM (SELECT repo_name, ext, CAST(sum(code) AS BIGINT) AS code,
                    CAST(sum(comments) AS BIGINT) AS comments, CAST(sum(blanks) AS BIGINT) AS blanks
             FROM f_code WHERE ext IS NOT NULL GROUP BY repo_name, ext) s
       JOIN (SELECT repo_name, arg_min(datetime, o_orderkey) AS datetime
             FROM f_commit JOIN orders ON hash = md5(CAST(o_orderkey AS STRING))
             GROUP BY repo_name) c USING (repo_name)""",
)
def load_snapshot(spark, sf_dir):
    """The dated snapshot of a whole load with sources."""
    stored = tables.read_table(spark, "snapshot", views.loaded(spark, sf_dir))
    return stored.select(*schemas.columns(schemas.SNAPSHOT))
