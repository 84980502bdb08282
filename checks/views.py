"""History tables derived from the given star-schema tables, and their exported text form.

``FIXTURES.md`` defines the views; ``SQL`` below is their SQL form for the twins. The
DataFrame form gives the same rows, but joins on the integer order key instead of its hash
(the order key is the key of ``orders``) and sums the line items per order and extension
before they meet the orders, so that no order, however large, is joined line by line.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist import schemas
from annalist.functions import timefn
from annalist.sources import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _offset(key: Column) -> Column:
    return (
        F.when(key % 4 == 0, "+00:00")
        .when(key % 4 == 1, "+08:00")
        .when(key % 4 == 2, "-05:00")
        .otherwise("+05:30")
    )


def _key_hash(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def _repo() -> Column:
    return F.concat(F.col("c_mktsegment"), F.lit("/"), F.col("n_name"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with the repository of each."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("repo_name", _repo())


def _datetime(key: Column, cust: Column, date: Column) -> Column:
    return F.concat(
        date.cast("date").cast("string"),
        F.lit("T"),
        F.lpad((key % 24).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((key % 60).cast("string"), 2, "0"),
        F.lit(":00"),
        _offset(cust),
    )


def _author(cust: Column) -> tuple[Column, Column, Column]:
    """Name, mail address and its domain."""
    user = F.concat(F.lit("user"), (cust % 40).cast("string"))
    domain = F.concat(F.lit("d"), (cust % 8).cast("string"), F.lit(".example.com"))
    return user, F.concat(user, F.lit("@"), domain), domain


def keyed_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_commit with the order key and priority beside it."""
    cust = F.col("o_custkey")
    name, email, domain = _author(cust)
    return _orders(spark, sf_dir).select(
        "o_orderkey",
        "o_orderpriority",
        "o_orderstatus",
        "repo_name",
        _key_hash("o_orderkey").alias("hash"),
        F.lit("main").alias("branch"),
        _datetime(F.col("o_orderkey"), cust, F.col("o_orderdate")).alias("datetime"),
        name.alias("author_name"),
        email.alias("author_email"),
        domain.alias("author_domain"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_commits(spark, sf_dir).select(*schemas.columns(schemas.COMMIT))


def _line_ext(key: "Column | None" = None) -> Column:
    part = (F.col("l_partkey") if key is None else key) % 6
    return (
        F.when(part == 0, "py")
        .when(part == 1, "go")
        .when(part == 2, "js")
        .when(part == 3, "html")
        .when(part == 4, "css")
        .otherwise("")
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    churn = (
        table(spark, sf_dir, "lineitem")
        .select(
            "l_orderkey",
            _line_ext().alias("ext"),
            F.col("l_quantity").cast("bigint").alias("ins"),
            F.col("l_linenumber").cast("bigint").alias("del"),
        )
        .groupBy("l_orderkey", "ext")
        .agg(F.sum("ins").alias("insertion"), F.sum("del").alias("deletion"))
    )
    joined = keyed_commits(spark, sf_dir).join(churn, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(*schemas.columns(schemas.CHANGE))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        keyed_commits(spark, sf_dir)
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .select(
            "repo_name",
            "branch",
            "datetime",
            F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("tag"),
        )
    )


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(_repo().alias("repo_name"))
        .agg(
            F.count(F.lit(1)).alias("forks"),
            F.sum(F.floor(F.abs("c_acctbal")).cast("bigint")).alias("stars"),
        )
    )


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("string")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias(
            "repo_name"
        ),
        F.concat(
            F.substring(ts, 1, 10), F.lit("T"), F.substring(ts, 12, 8), _offset(F.col("user_id"))
        ).alias("datetime"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_name"),
        F.col("lang").alias("ext"),
        F.concat(
            F.lit("src/f"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")
        ).alias("path"),
        F.concat(F.lit("# header\n\n"), F.col("text"), F.lit("\n    // note")).alias("text"),
    )


# What starts a comment line in every document language.
COMMENT_PREFIXES = ("#", "//")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active(spark, sf_dir).select(
        F.col("repo_name").alias("name"),
        F.lit("main").alias("branch"),
        F.concat(F.lit("https://example.com/"), F.col("repo_name"), F.lit(".git")).alias("remote"),
        F.concat(F.lit("/srv/"), F.col("repo_name")).alias("path"),
        F.col("forks").alias("forks_count"),
        F.col("stars").alias("stargazers_count"),
    )


def mail_date(datetime: "Column | str") -> Column:
    """The RFC 2822 form of an RFC 3339 text."""
    datetime = F.col(datetime) if isinstance(datetime, str) else datetime
    return F.concat(
        timefn.weekday(datetime),
        F.date_format(timefn.local_ts(datetime), ", d MMM yyyy HH:mm:ss "),
        F.replace(F.right(datetime, F.lit(6)), F.lit(":"), F.lit("")),
    )


def _log_header(damaged: bool) -> Column:
    """The header line of an exported commit; damaged, commits of status P and low priority lack their hash."""
    shown_hash = F.concat(F.lit(" <"), F.col("hash"), F.lit(">"))
    if damaged:
        in_p, low = F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "5-LOW"
        shown_hash = F.when(in_p & low, "").otherwise(shown_hash)
    return _header_line(F.col("datetime"), shown_hash, F.col("author_name"), F.col("author_email"))


def _header_line(datetime: Column, shown_hash: Column, name: Column, email: Column) -> Column:
    return F.concat(
        F.lit("<"),
        mail_date(datetime),
        F.lit(">"),
        shown_hash,
        F.lit(" <"),
        name,
        F.lit("> <"),
        email,
        F.lit(">"),
    )


def _log_change(quantity: Column, number: Column, part: Column) -> Column:
    """The change line of a line item."""
    ext = _line_ext(part)
    return F.concat(
        quantity.cast("bigint").cast("string"),
        F.lit("\t"),
        number.cast("string"),
        F.lit("\tsrc/p"),
        part.cast("string"),
        F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)),
    )


def log_lines(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    """``repo_name, hash, line_no, value``: the lines of the exported commit logs.

    With ``damaged``, commits of status P with a low priority get a header without its hash,
    and the other commits of status P a change line without its counters.
    """
    in_p, low = F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "5-LOW"
    commit = keyed_commits(spark, sf_dir)
    line = _log_change(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_partkey"))
    item = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("line_no"), line.alias("value")
    )
    key = ["repo_name", "hash"]
    header = commit.select(*key, F.lit(0).cast("bigint").alias("line_no"), _log_header(damaged).alias("value"))
    lines = header.unionByName(
        commit.join(item, F.col("o_orderkey") == F.col("l_orderkey")).select(*key, "line_no", "value")
    )
    if damaged:
        broken = commit.filter(in_p & ~low).select(
            *key,
            F.lit(1_000_000).cast("bigint").alias("line_no"),
            F.lit("1 file changed").alias("value"),
        )
        lines = lines.unionByName(broken)
    return lines


def log_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo_name, o_orderkey, heads``, and an array a column of the line items, of which ``section_text`` makes the logs.

    Numbers and dates are spread, gathered and stored, which take less than half of the text.
    """
    head = F.struct("repo_name", "o_custkey", "o_orderdate")
    # Spread before they are gathered, so that no task sorts more than its part.
    heads = _orders(spark, sf_dir).select("o_orderkey", head.alias("head")).repartition("o_orderkey")
    heads = heads.groupBy("o_orderkey").agg(F.collect_list("head").alias("heads"))
    items = table(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL")
    items = items.select("l_orderkey", "l_quantity", "l_linenumber", "l_partkey").repartition("l_orderkey")
    item = F.struct(F.col("l_quantity").cast("bigint").alias("l_quantity"), "l_linenumber", "l_partkey")
    items = items.groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    both = heads.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    names = F.array_distinct(F.transform("heads", lambda h: h["repo_name"]))
    named = both.select("o_orderkey", "heads", "items", F.explode(names).alias("repo_name"))
    own = F.filter("heads", lambda h: h["repo_name"].eqNullSafe(F.col("repo_name")))
    own = F.transform(own, lambda h: F.struct(h["o_custkey"].alias("cust"), h["o_orderdate"].alias("date")))
    # An array a column takes half of what one of structs does in memory.
    apart = [F.col("items")[c].alias(c) for c in _ITEM]
    return named.select("repo_name", "o_orderkey", own.alias("heads"), *apart)


_ITEM = ("l_quantity", "l_linenumber", "l_partkey")


def section_text() -> Column:
    """The lines of a commit as one text, of the columns of ``log_parts``.

    Rows that repeat a commit have all their headers in front, as where its lines are sorted.
    """
    # What has no text is an empty line.
    text = lambda x: F.coalesce(x, F.lit(""))
    key = F.col("o_orderkey")
    shown_hash = F.concat(F.lit(" <"), _key_hash("o_orderkey"), F.lit(">"))
    # The date is text before the header is made of it, which looks at it many times.
    dated = F.transform("heads", lambda h: F.struct(h["cust"].alias("cust"), _datetime(key, h["cust"], h["date"]).alias("at")))
    headers = F.transform(dated, lambda h: text(_header_line(h["at"], shown_hash, *_author(h["cust"])[:2])))
    quantity, number, part = _ITEM
    lines = F.transform(quantity, lambda q, i: text(_log_change(q, F.get(number, i), F.get(part, i))))
    # A line of a commit stands there once for each of its rows.
    times = F.when(F.col(quantity).isNotNull(), F.array_repeat(F.array_join(lines, "\n"), F.size("heads")))
    return F.array_join(F.concat(headers, F.coalesce(times, F.array().cast("array<string>"))), "\n")


def log_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo_name, hash, value``: the lines of the logs without damage, those of a commit as one text."""
    parts = log_parts(spark, sf_dir)
    return parts.select("repo_name", _key_hash("o_orderkey").alias("hash"), section_text().alias("value"))


def write_sections(
    found: DataFrame, path: str, hash_: "Column | None" = None, value: "Column | None" = None
) -> None:
    """Write whole sections as text below ``repo_name=...``, in the order of ``write_log``.

    The order matters where a header is missing: such lines belong to the commit before. Ranges
    and sort see one row a commit here, where those of ``write_log`` see one a line. The sections
    are stored first, since finding the ranges reads all of them once more. ``hash_`` and ``value``
    make the hash to sort by and the text of other columns, where ``found`` does not have them.
    The files are compressed to a third; each holds a range, so a large repository has many of them.
    """
    spark = found.sparkSession
    place = shared.folder(spark, "sections")
    found.write.parquet(place)
    whole = spark.read.schema(found.schema).parquet(place)
    by, text = hash_ if hash_ is not None else F.col("hash"), value if value is not None else F.col("value")
    whole.repartitionByRange("repo_name", by).withColumn("__by", by).sortWithinPartitions("repo_name", "__by").select(
        "repo_name", text.alias("value")
    ).write.partitionBy("repo_name").text(path, compression="gzip")
    shared.remove(spark, place)


def write_log(lines: DataFrame, path: str) -> None:
    """Write log lines as text below ``repo_name=...``, the lines of a commit together.

    Ranges of (repository, commit) spread a large repository over many files and keep the
    number of files near the number of tasks; sorting streams and spills, so no commit has
    to fit in memory.
    """
    lines.repartitionByRange("repo_name", "hash").sortWithinPartitions(
        "repo_name", "hash", "line_no"
    ).select("repo_name", "value").write.partitionBy("repo_name").text(path)


_written: dict[tuple, str] = {}


def once(spark: SparkSession, sf_dir: str, label: str, write) -> str:
    """Path of scratch input, written once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _written or not shared.exists(spark, f"{_written[key]}/_SUCCESS"):
        path = shared.folder(spark, label)
        write(path)
        _written[key] = path
    return _written[key]


def stored_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as a stored table, whose size the planner knows."""
    return spark.read.parquet(
        once(spark, sf_dir, "manifest", lambda p: manifest(spark, sf_dir).write.parquet(p))
    )


def log_path(spark: SparkSession, sf_dir: str) -> str:
    # As bytes hashes are in the order of their text.
    by = F.unhex(_key_hash("o_orderkey"))
    return once(spark, sf_dir, "log", lambda p: write_sections(log_parts(spark, sf_dir), p, by, section_text()))


def damaged_log_path(spark: SparkSession, sf_dir: str) -> str:
    return once(
        spark, sf_dir, "damaged-log", lambda p: write_log(log_lines(spark, sf_dir, True), p)
    )


def _header(hash_: Column) -> Column:
    """The header line of a commit, as the log export writes it."""
    fields = (mail_date("datetime"), hash_, F.col("author_name"), F.col("author_email"))
    return F.concat_ws(" ", *[F.concat(F.lit("<"), f, F.lit(">")) for f in fields])


def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least order key of each repository as a stored table, whose size the planner knows."""
    least = keyed_commits(spark, sf_dir).groupBy("repo_name").agg(F.min("o_orderkey").alias("o_orderkey"))
    return spark.read.schema(least.schema).parquet(
        once(spark, sf_dir, "first-orders", lambda p: least.write.parquet(p))
    )


def ref_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo_name, value``: the exported references.

    By the remainder of the order key by four, a tag is a plain line; an annotated tag with its
    second line; a tag on a commit outside the log, dated by its header line; or an annotated
    tag on such a commit. Besides there are tags of high priority that nothing dates, and a
    HEAD line with the commit of the least order key of each repository.
    """
    keyed = keyed_commits(spark, sf_dir)
    key = F.col("o_orderkey")
    outside = F.md5(F.concat(F.lit("outside"), key.cast("string")))
    thing = F.md5(F.concat(F.lit("object"), key.cast("string")))
    name = F.concat(F.lit(" refs/tags/v"), key.cast("string"))
    peeled, dated = F.lit("^{}"), F.concat(F.lit("\t"), _header(outside))
    urgent = keyed.filter(F.col("o_orderpriority") == "1-URGENT")
    forms = (
        [F.concat(F.col("hash"), name)],
        [F.concat(thing, name), F.concat(F.col("hash"), name, peeled)],
        [F.concat(outside, name, dated)],
        [F.concat(thing, name, dated), F.concat(outside, name, peeled, dated)],
    )
    lines = F.when(key % 4 == 0, F.array(*forms[0]))
    for number in (1, 2, 3):
        lines = lines.when(key % 4 == number, F.array(*forms[number]))
    lost = keyed.filter((F.col("o_orderpriority") == "2-HIGH") & (key % 5 == 0)).select(
        "repo_name", F.concat(outside, F.lit(" refs/tags/lost"), key.cast("string")).alias("value")
    )
    head = keyed.join(first_orders(spark, sf_dir), ["repo_name", "o_orderkey"]).select(
        "repo_name",
        F.concat(F.col("hash"), F.lit(" HEAD\t"), _header(F.col("hash"))).alias("value"),
    )
    return urgent.select("repo_name", F.explode(lines).alias("value")).union(lost).union(head)


def refs_path(spark: SparkSession, sf_dir: str) -> str:
    def write(path):
        lines = ref_lines(spark, sf_dir).hint("rebalance", "repo_name")
        lines.write.partitionBy("repo_name").text(path)

    return once(spark, sf_dir, "refs", write)


def loaded(spark: SparkSession, sf_dir: str) -> str:
    """Where the tables lie after one load of everything, shared by the queries on them."""
    from annalist.plans.load import load

    def run(path):
        load(
            spark,
            path,
            stored_manifest(spark, sf_dir),
            log_path(spark, sf_dir),
            refs_path(spark, sf_dir),
            code_records(spark, sf_dir),
        )
        # ``once`` looks for this mark of a finished write.
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place).close()

    return once(spark, sf_dir, "loaded", run)


#: File names by the remainder of the document id, with the language each counts as.
CODE_NAMES = (
    ("pkg/__init__.py", "python"),
    ("Makefile", "makefile"),
    ("src/A.PY", "python"),
    ("web/app.tsx", "tsx"),
    ("src/x.cc", "c++"),
    (".hidden/y.swift", "swift"),
    ("data.bin", None),
)


def code_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files of all kinds of names, each in a repository of the manifest."""
    name = F.lit(None).cast("string")
    for number, (path, _) in enumerate(CODE_NAMES):
        name = F.when(F.col("doc_id") % len(CODE_NAMES) == number, path).otherwise(name)
    repos = manifest(spark, sf_dir).select(F.col("name").alias("repo_name")).distinct()
    first = repos.agg(F.min("repo_name").alias("repo_name"))
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit("/"), name).alias("path"),
        F.concat(F.lit("# header\n\n// note\n"), F.col("text")).alias("text"),
    )
    return docs.join(first).select("repo_name", "path", "text")


def code_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, exported as records and read again."""
    from annalist.sources import logs

    path = once(spark, sf_dir, "code", lambda p: code_sources(spark, sf_dir).write.json(p))
    return logs.read_source_records(spark, path)


def giant_log_path(spark: SparkSession, sf_dir: str) -> str:
    """The logs with a third of all change lines in one commit, that of the least order key."""

    def write(path):
        least = keyed_commits(spark, sf_dir).select(F.min_by(F.struct("repo_name", "hash"), "o_orderkey").alias("to"))
        lines = log_lines(spark, sf_dir).withColumn("to", least.scalar())
        part = F.regexp_extract("value", "src/p(\\d+)", 1).try_cast("bigint")
        moved = (F.col("line_no") > 0) & (part % 3 == 0)
        owner = [F.when(moved, F.col("to")[c]).otherwise(F.col(c)).alias(c) for c in ("repo_name", "hash")]
        write_log(lines.select(*owner, "line_no", "value"), path)

    return once(spark, sf_dir, "giant-log", write)


def parent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo_name, value``: commits with their time and parents, most of them merges.

    The orders of a repository, by key, are its mainline; by their place in it every 40th and the
    17th after it have one parent, all others two: the one before, or the second before where that
    would be such a commit, and the fifth before.
    """
    line = keyed_commits(spark, sf_dir).select("repo_name", "o_orderkey")
    by_key = Window.partitionBy("repo_name").orderBy("o_orderkey")
    key = lambda back: F.lag("o_orderkey", back).over(by_key)
    # Keys and not hashes are shuffled and looked up in the window, which no join needs to follow.
    n = F.col("n")
    line = line.select("*", F.row_number().over(by_key).alias("n"), *[key(x).alias(f"k{x}") for x in (1, 2, 5)])
    parent = lambda back: F.struct((n - back).alias("place"), F.col(f"k{back}").alias("key"))
    wanted = (
        F.when((n % 40).isin(0, 17), F.array(parent(1)))
        .when((n % 40).isin(1, 18), F.array(parent(2), parent(5)))
        .otherwise(F.array(parent(1), parent(5)))
    )
    real = F.transform(
        F.filter(wanted, lambda p: p["place"] > 0),
        lambda p, i: F.struct(i.alias("at"), F.md5(p["key"].cast("string")).alias("p")),
    )
    # Rows that repeat a commit have the parents of all of them; what has no key or no repository has none.
    all_rows = Window.partitionBy("repo_name", "o_orderkey")
    ps = F.array_sort(F.flatten(F.collect_list(real).over(all_rows)))
    line = line.select("repo_name", "n", "o_orderkey", ps.alias("ps"))
    has = F.col("repo_name").isNotNull() & F.col("o_orderkey").isNotNull() & (F.size("ps") > 0)
    parents = F.when(has, F.array_join("ps.p", " "))
    text = F.concat_ws(" ", _key_hash("o_orderkey"), (n * 100).cast("string"), parents)
    return line.select("repo_name", text.alias("value"))


def parents_path(spark: SparkSession, sf_dir: str) -> str:
    def write(path):
        # Not rebalanced: the window leaves whole repositories, whose files are read in parts.
        parent_lines(spark, sf_dir).write.partitionBy("repo_name").text(path)

    return once(spark, sf_dir, "parents", write)


#: Files with block comments: name, what stands before and after the text, then the lines that
#: are code and comments besides the text's own, and whether those are comments.
BLOCK_FILES = (
    ("a.c", "int a; /* open\n", "\n close */ int b;\n/* one line */\nchar *s = \"/* no\";\n"
     "// tail /* none\nint c = '\"'; /* x */\n/* unclosed\n", "c", 4, 3, True),
    ("a.rs", "/* a /* b\n", "\n*/ still\n*/ fn f<'a>() {}\nlet s = \"/* x\n*/\";\n// end\n", "rust", 3, 3, True),
    ("a.go", "x := `/* raw\n", "\n// raw */`\ny := '\"' /* c */\n/* z */\n", "go", 3, 1, False),
    ("a.html", "<p>\n<!-- a\n", "\n--> <b>\n<!-- x -->\n", "html", 2, 2, True),
    ("a.css", "a { }\n/*\n", "\n*/\n.b { content: \"/*\"; }", "css", 2, 2, True),
    ("a.hs", "{- a {- b -}\n", "\n-}\nmain = x -- {- no\n-- l\n", "haskell", 1, 3, True),
    ("a.py", "\"\"\"doc\n", "\n# in string\n\"\"\"\n# c\nx = 'a # b'\n", "python", 4, 1, False),
)


def block_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents inside block comments and strings over many lines, letters and digits alone."""
    key = F.pmod("doc_id", F.lit(len(BLOCK_FILES)))
    pick = lambda n: F.array(*[F.lit(x[n]) for x in BLOCK_FILES])[key.cast("int")]
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 \n]", "")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_name"),
        F.concat(F.col("doc_id").cast("string"), F.lit("/"), pick(0)).alias("path"),
        F.concat(pick(1), body, pick(2)).alias("text"),
    )


# The views as SQL, each as a common table expression; see FIXTURES.md section 3.
SQL = {
    "f_commit": """
SELECT concat(c_mktsegment, '/', n_name) AS repo_name,
       md5(CAST(o_orderkey AS STRING)) AS hash,
       'main' AS branch,
       concat(substr(CAST(o_orderdate AS STRING), 1, 10), 'T',
              lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), ':',
              lpad(CAST(o_orderkey % 60 AS STRING), 2, '0'), ':00',
              CASE o_custkey % 4 WHEN 0 THEN '+00:00' WHEN 1 THEN '+08:00'
                                 WHEN 2 THEN '-05:00' ELSE '+05:30' END) AS datetime,
       concat('user', CAST(o_custkey % 40 AS STRING)) AS author_name,
       concat('user', CAST(o_custkey % 40 AS STRING), '@d', CAST(o_custkey % 8 AS STRING),
              '.example.com') AS author_email,
       concat('d', CAST(o_custkey % 8 AS STRING), '.example.com') AS author_domain
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "f_change": """
SELECT k.repo_name, k.hash, k.branch, k.datetime, k.author_name, k.author_email,
       k.author_domain, l.ext,
       CAST(sum(l.ins) AS BIGINT) AS insertion, CAST(sum(l.del) AS BIGINT) AS deletion
FROM f_commit k JOIN (
  SELECT md5(CAST(l_orderkey AS STRING)) AS hash,
         CASE l_partkey % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'go' WHEN 2 THEN 'js'
                            WHEN 3 THEN 'html' WHEN 4 THEN 'css' ELSE '' END AS ext,
         CAST(l_quantity AS BIGINT) AS ins, CAST(l_linenumber AS BIGINT) AS del
  FROM lineitem) l ON k.hash = l.hash
GROUP BY k.repo_name, k.hash, k.branch, k.datetime, k.author_name, k.author_email,
         k.author_domain, l.ext""",
    "f_tag": """
SELECT k.repo_name, k.branch, k.datetime, concat('v', CAST(o_orderkey AS STRING)) AS tag
FROM f_commit k JOIN orders ON k.hash = md5(CAST(o_orderkey AS STRING))
WHERE o_orderpriority = '1-URGENT'""",
    "f_active": """
SELECT concat(c_mktsegment, '/', n_name) AS repo_name, CAST(count(*) AS BIGINT) AS forks,
       CAST(sum(CAST(floor(abs(c_acctbal)) AS BIGINT)) AS BIGINT) AS stars
FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY concat(c_mktsegment, '/', n_name)""",
    "f_event_commit": """
SELECT concat('u', CAST(user_id AS STRING), '/', event_type) AS repo_name,
       concat(substr(CAST(ts AS STRING), 1, 10), 'T', substr(CAST(ts AS STRING), 12, 8),
              CASE user_id % 4 WHEN 0 THEN '+00:00' WHEN 1 THEN '+08:00'
                               WHEN 2 THEN '-05:00' ELSE '+05:30' END) AS datetime
FROM events""",
    "f_source": """
SELECT source AS repo_name, lang AS ext,
       concat('src/f', CAST(doc_id AS STRING), '.', lang) AS path,
       concat('# header', chr(10), chr(10), text, chr(10), '    // note') AS text
FROM documents""",
    # The documents as source files of the default languages, in one repository.
    "f_code": """
SELECT repo_name, ext, path,
       CAST(count(*) FILTER (line <> '' AND NOT comment) AS BIGINT) AS code,
       CAST(count(*) FILTER (line <> '' AND comment) AS BIGINT) AS comments,
       CAST(count(*) FILTER (line = '') AS BIGINT) AS blanks
FROM (SELECT *, CASE WHEN ext IN ('python', 'makefile') THEN starts_with(line, '#')
                     ELSE starts_with(line, '//') END AS comment
      FROM (SELECT (SELECT min(repo_name) FROM f_active) AS repo_name,
                   CASE doc_id % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'makefile' WHEN 2 THEN 'python'
                                   WHEN 3 THEN 'tsx' WHEN 4 THEN 'c++' WHEN 5 THEN 'swift' END
                     AS ext,
                   CAST(doc_id AS VARCHAR) AS path,
                   trim(unnest(string_split(
                          regexp_replace('# header' || chr(10) || chr(10) || '// note' || chr(10) || text,
                                         chr(10) || '$', ''), chr(10))),
                        ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line
            FROM documents))
GROUP BY ALL""",
    # Line kinds by the trimmed line; see T13.
    "f_snapshot": """
SELECT repo_name, ext,
       CAST(count(*) FILTER (line <> '' AND NOT starts_with(line, '#')
                             AND NOT starts_with(line, '//')) AS BIGINT) AS code,
       CAST(count(*) FILTER (starts_with(line, '#') OR starts_with(line, '//')) AS BIGINT)
         AS comments,
       CAST(count(*) FILTER (line = '') AS BIGINT) AS blanks
FROM (SELECT repo_name, ext,
             trim(unnest(string_split(text, chr(10))),
                  ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line
      FROM f_source)
GROUP BY repo_name, ext""",
}
_NEEDS = {"f_code": ["f_active"], "f_change": ["f_commit"], "f_tag": ["f_commit"], "f_snapshot": ["f_source"]}


def twin(query: str) -> str:
    """Put the views a SQL query names in front of it."""
    wanted: list[str] = []

    def add(name):
        for below in _NEEDS.get(name, []):
            add(below)
        if name not in wanted:
            wanted.append(name)

    for name in SQL:
        if name in query:
            add(name)
    if not wanted:
        return query
    ctes = ",\n".join(f"{name} AS ({SQL[name]}\n)" for name in wanted)
    query = query.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if query.upper().startswith(start):
            return f"{start}{ctes},\n{query[len(start):]}"
    return f"WITH {ctes}\n{query}"
