"""Every query over the test tables, with its SQL form."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import quoted
from .functions.measures import fill, leading_number, leading_unit
from .operators import selectors
from .operators.families import is_text
from .operators.roles import column_roles as roles_of
from .operators.shrink import apply_plan
from .operators.shrink import shrink as narrowed
from .operators.shrink import shrink_plan as plan_of
from .operators.timed import asof_join, interval_totals
from .plans.catalogue import Catalogue, type_name
from .plans.cleaning import Cleaner
from .plans.grouped import grouped_profile
from .plans.incremental import ProfileStore, sketch_error, sketched_counts, sketches
from .plans.profile import profile
from .plans.quantiles import capped, exact_quantiles
from .plans.values import few_values, modes
from .sources.delimited import inferred, read_delimited
from .sources.lattice import read_delimited_files
from .sources.parquet import read_parquet
from .sources.staging import shared_folder
from .streaming.sessions import Sessions, session_files

#: A view of ``events`` with the missing cells that the test tables lack; both engines read the same text.
DIRTY = """
SELECT event_id,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END      AS value,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value - 50 END AS energy_100g,
  CASE WHEN event_id % 3 = 0 THEN user_id END              AS sparse,
  CASE WHEN event_id % 2 = 0 THEN user_id END              AS half,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'n/d' WHEN event_id % 17 = 0 THEN '0 g'
       ELSE concat(CAST(user_id AS VARCHAR(20)), CASE WHEN event_id % 2 = 0 THEN ' g' ELSE ' ml' END) END AS serving_size,
  CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN '1,5 L'
       ELSE concat(CAST(user_id * 2 AS VARCHAR(20)), '.5 kg (pack)') END AS quantity
FROM events
"""
PRODUCT = ("serving_size", "quantity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def scan_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``customer`` written as tab-separated text, read by the rules for such text and typed by its values."""
    path = f"{shared_folder(spark)}/delimited-{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").write.options(sep="\t", header=True, escape='"').csv(path)
    return read_delimited(spark, path)


#: Lines of ``customer`` with what the test tables lack: quoted separators, quotes and line breaks, cells that count as missing,
#: too long lines (every seventh) and short ones; both engines read the same text.
LINES = """
SELECT c_custkey, concat(CAST(c_custkey AS VARCHAR(20)), chr(9), '"', c_name, chr(10), 'a ""quoted""', chr(9), 'cell"', chr(9),
  CASE WHEN c_custkey % 11 = 0 THEN c_mktsegment ELSE concat(
    CASE WHEN c_custkey % 5 = 0 THEN 'n/a' WHEN c_custkey % 13 = 0 THEN '#N/A' ELSE c_mktsegment END, chr(9), CAST(c_nationkey AS VARCHAR(20)),
    CASE WHEN c_custkey % 7 = 0 THEN concat(chr(9), 'too', chr(9), 'long') ELSE '' END) END) AS line
FROM customer
"""


def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pydict({"value": ["key\tname\tsegment\tnation"]})
    yield from batches


def written_lines(spark: SparkSession, sf_dir: str) -> str:
    """The folder with LINES as text files, each with a header, in the order of keys."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines = spark.sql(LINES.replace("FROM customer", "FROM {customer}").replace("VARCHAR(20)", "STRING"), customer=table(spark, sf_dir, "customer"))
    ordered = lines.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
    ordered.select(F.col("line").alias("value")).mapInArrow(with_header, "value string").write.text(path)
    return path


def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines but the too long ones, read by split."""
    return read_delimited(spark, written_lines(spark, sf_dir), bad_lines="skip")


def scan_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1000 lines in file order that aren't too long."""
    return read_delimited(spark, written_lines(spark, sf_dir), bad_lines="skip", limit=1000)


def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").orderBy("c_custkey").limit(5)


def first_n_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy("event_id").limit(1000)


def wide_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalogue(table(spark, sf_dir, "lineitem")).wide_numeric()


def all_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return selectors.chosen(lines, selectors.numeric_columns(lines))


def text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return selectors.chosen(orders, selectors.text_columns(orders))


def pick_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.pick(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderkey"])


def text_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.text_except(table(spark, sf_dir, "orders"), ["o_orderstatus"])


def text_except_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    more = {"order_date_txt": F.col("o_orderdate").cast("string"), "LastUPDATE": F.col("o_orderstatus")}
    return selectors.text_except_dates(orders.withColumns(more), ["o_orderstatus"])


def low_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.low_cardinality(table(spark, sf_dir, "part"), 10)


def n_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = selectors.n_unique(table(spark, sf_dir, "customer"), "c_mktsegment")
    return spark.range(1).select(F.lit("c_mktsegment").alias("column"), F.lit(n).cast("long").alias("n_unique"))


def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles_of(table(spark, sf_dir, "part")).rows().select("column", "role")


def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.drop_columns(table(spark, sf_dir, "customer"), ["c_name", "absent"])


def null_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = profile(dirty(spark, sf_dir), counts_only=True)
    rows = [(c, round(known.null_fraction(c), 4)) for c in known.columns]
    return spark.createDataFrame(rows, "column string, null_fraction double")


def drop_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir)
    model = Cleaner(drop=(), measures=(), non_negative=(), exclude=rows.columns).fit(rows)
    return model.transform(rows)


def column_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalogue(dirty(spark, sf_dir)).info().select("column", "non_null", "n_rows")


def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalogue(table(spark, sf_dir, "orders")).types().select("column", "type")


def fill_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir)
    mean = profile(rows, ["value"]).columns["value"].mean
    return rows.select("event_id", F.round(fill(F.col("value"), mean), 6).alias("value"))


def fill_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir)
    mode = modes(rows, ["event_type"])["event_type"]
    return rows.select("event_id", fill(F.col("event_type"), mode).alias("event_type"))


def mode_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    known = modes(orders, [f.name for f in orders.schema if is_text(f.dataType)])
    return spark.createDataFrame(list(known.items()), "column string, mode string")


def mode_of_many_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent values of columns of few, of many and of single values, and of one where all are about as frequent."""
    documents, events = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    known = modes(documents, ["text", "lang", "source"]) | modes(events.select("props", F.col("ts").cast("string").alias("ts")), ["props", "ts"])
    return spark.createDataFrame(list(known.items()), "column string, mode string")


def few_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values the text columns of two tables have, if they are 60 at most."""
    known = few_values(table(spark, sf_dir, "documents"), ["text", "lang", "source"], 60) | few_values(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], 60)
    return spark.createDataFrame(list(known.items()), "column string, n long")


def cap_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of ``lineitem`` held between their exact quantiles."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return capped(lines, ["l_quantity", "l_extendedprice", "l_discount"], 0.01, 0.99)


def column_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir)
    known = exact_quantiles(rows, ["value", "energy_100g", "half"], [0.01, 0.5, 0.99])
    return spark.createDataFrame([(c, *q) for c, q in known.items()], "column string, low double, middle double, high double")


def profile_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored profile of files of ``events`` after one is added and one removed, from the states of single files."""
    folder = f"{shared_folder(spark)}/refit-{uuid.uuid4().hex}"
    rows = dirty(spark, sf_dir)
    for k in range(4):
        rows.where(F.col("event_id") % 4 == k).write.parquet(f"{folder}/data/{k}")
    store = ProfileStore(spark, f"{folder}/store")
    store.refit(*[f"{folder}/data/{k}" for k in (0, 1, 2)])
    known = store.refit(*[f"{folder}/data/{k}" for k in (1, 2, 3)])
    listed = [(c, known.rows, p.non_null, p.distinct, None if p.mean is None else round(p.mean, 6), p.mode, p.low, p.high) for c, p in known.columns.items()]
    return spark.createDataFrame(listed, "column string, n_rows long, non_null long, n_distinct long, mean double, mode string, low long, high long")


def sketched_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the stored sketches of two batches, merged, tell the numbers of values within four of their standard errors."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    folder = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    for k, batch in enumerate((lines.where("l_linenumber % 2 = 0"), lines.where("l_linenumber % 3 > 0"))):
        sketches(batch, lines.columns).write.parquet(f"{folder}/{k}")
    about = sketched_counts(spark.read.parquet(f"{folder}/0", f"{folder}/1"))
    exact = lines.where("l_linenumber % 2 = 0 OR l_linenumber % 3 > 0").agg(*[F.count_distinct(c).alias(c) for c in lines.columns]).first()
    listed = [(c, exact[c], abs(about[c] - exact[c]) <= 4 * sketch_error() * exact[c]) for c in lines.columns]
    return spark.createDataFrame(listed, "column string, n_distinct long, within_error boolean")


def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view before it; keys of more than 100 rows are split."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    of = lambda kind: events.where(F.col("event_type") == kind).drop("event_type")
    return asof_join(of("purchase"), of("view"), ["user_id"], "ts", "view_", most=100).drop("view_ts")


def interval_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order: the orders of its part of the customers (one in 50) in the 30 days from then on."""
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("part"), day.alias("day"), "o_totalprice")
    spans = orders.select("o_orderkey", "part", F.col("day").alias("start"), (F.col("day") + 30).alias("end"))
    met = interval_totals(orders, spans, ["part"], "day", "start", "end", ["o_totalprice"])
    return met.groupBy("o_orderkey").agg(F.sum("n").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def profile_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of two columns of ``part`` for every subset of two others."""
    found = grouped_profile(table(spark, sf_dir, "part"), ["p_type", "p_size"], ["p_brand", "p_retailprice"])
    return found.withColumn("mean", F.round("mean", 4))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the users of ``events``, which arrive in four files, every tenth twice; a last file closes them."""
    folder = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / 4
    for k in range(4):
        part = events.where((F.col("ts") >= F.lit(first + k * step).cast("timestamp_ntz")) & (F.lit(k == 3) | (F.col("ts") < F.lit(first + (k + 1) * step).cast("timestamp_ntz"))))
        part.union(part.where("event_id % 10 = 0")).write.mode("append").parquet(f"{folder}/in")
    end = spark.range(1).select(F.lit(-1).cast("long"), F.lit(-1).cast("long"), F.lit(last + timedelta(days=30)).cast("timestamp_ntz"), F.lit(0.0)).toDF(*events.columns)
    end.write.mode("append").parquet(f"{folder}/in")
    query = session_files(spark, Sessions("user_id", "ts", "value", ("event_id",), gap="6 hours"), events.schema, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 2).alias("total"))


def cell_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types that the values of ``orders`` have as text; dates stay text."""
    orders = table(spark, sf_dir, "orders")
    typed = inferred(orders.select(*[quoted(c).cast("string").alias(c) for c in orders.columns]))
    return Catalogue(typed).types().select("column", "type")


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds a column of ``part`` has in files that write it differently, with the cell that raises each file's kind."""
    folder = f"{shared_folder(spark)}/kinds-{uuid.uuid4().hex}"
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    for k, written in enumerate((size, F.concat(size, F.lit(".5")), F.concat(F.lit("size "), size))):
        own = part.where(F.col("p_partkey") % 3 == k).select("p_partkey", written.alias("p_size"), "p_name")
        own.write.options(sep="\t", header=True, escape='"').csv(f"{folder}/{k}")
    _, found = read_delimited_files(spark, f"{folder}/*")
    nth = F.regexp_extract("file", r"/kinds-[0-9a-f]+/(\d)/", 1).cast("int").alias("nth")
    return found.groupBy("column", nth, "kind").agg(F.min("value").alias("value"))


def extract_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", leading_number(F.col("p_brand")).alias("number"))


def extract_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", leading_unit(F.col("o_orderpriority")).alias("unit"))


def keep_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dirty(spark, sf_dir).select("event_id", "serving_size", leading_number(F.col("serving_size")).alias("serving_size_value"))
    return found.where(F.col("serving_size_value").isNotNull() & (F.col("serving_size_value") > 0))


def keep_non_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(quoted("c_acctbal") >= 0)


def shrink_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return narrowed(customer)


def shrink_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    narrow = apply_plan(lines, [n for n in plan_of(profile(lines)) if n.column not in ("l_orderkey",)])
    # both engines print a float's digits differently, so cells are compared as rounded doubles
    return narrow.select("l_orderkey", "l_linenumber", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in narrow.columns[2:]])


def shrink_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Catalogue(table(spark, sf_dir, "lineitem")).shrink_plan()
    rows = [(n.column, type_name(n.before), type_name(n.after)) for n in plan]
    return spark.createDataFrame(rows, "column string, before string, after string")


def clean_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir)
    cleaned = Cleaner().fit(rows).transform(rows)
    return cleaned.withColumns({c: F.round(c, 6) for c in ("value", "energy_100g")})


def value_counts(table_name: str, columns: list[str]) -> str:
    """SQL for (column, n_distinct) of text columns."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n FROM {table_name}" for c in columns)


def mode_sql(column: str, source: str) -> str:
    return f"SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"


NUMBER_SQL = "TRY_CAST(nullif(regexp_extract({0}, '([0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE)"
UNIT_SQL = "coalesce(regexp_extract({0}, '([a-zA-Z]+)', 1), '')"
DIRTY_COLUMNS = ("event_id", "event_type", "value", "energy_100g", "sparse", "half", "serving_size", "quantity")


def fits_sql(column: str, source: str) -> str:
    """SQL for the narrowest type of a bigint or double column."""
    return f"""
        SELECT CASE WHEN min({column}) >= -128 AND max({column}) <= 127 THEN 'int8'
                    WHEN min({column}) >= -32768 AND max({column}) <= 32767 THEN 'int16'
                    WHEN min({column}) >= -2147483648 AND max({column}) <= 2147483647 THEN 'int32' ELSE 'int64' END FROM {source}"""


def profile_sql(column: str, source: str) -> str:
    """SQL for a column's row of the profile: text columns have values and a mode, numbers a mean, whole ones a range."""
    text, whole = column in ("event_type", *PRODUCT), column in ("event_id", "sparse", "half")
    return f"""
        SELECT '{column}' AS "column", count(*) AS n_rows, count({column}) AS non_null, {f"count(DISTINCT {column})" if text else "CAST(NULL AS BIGINT)"} AS n_distinct,
               {"CAST(NULL AS DOUBLE)" if text else f"round(CAST(sum({column}) AS DOUBLE) / count({column}), 6)"} AS mean, {f"({mode_sql(column, source)})" if text else "CAST(NULL AS VARCHAR)"} AS mode,
               {f"min({column})" if whole else "CAST(NULL AS BIGINT)"} AS low, {f"max({column})" if whole else "CAST(NULL AS BIGINT)"} AS high FROM {source}"""


def float_sql(column: str, source: str) -> str:
    return f"SELECT CASE WHEN max(abs(CAST(CAST({column} AS FLOAT) AS DOUBLE) - {column})) <= 5e-4 THEN 'float32' ELSE 'float64' END FROM {source}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_table, scan_delimited, scan_lines, scan_first_lines, head_rows, first_n_rows, wide_numeric_columns, all_numeric_columns, text_columns, pick_columns, text_except,
        text_except_dates, low_cardinality, n_unique, column_roles, drop_columns, null_fraction, drop_sparse, column_info,
        column_types, fill_mean, fill_mode, mode_values, mode_of_many_values, few_valued, cap_outliers, column_quantiles, profile_refit, sketched_distinct, as_of_join, interval_sums, profile_sets, stream_sessions, cell_types, file_types, extract_number, extract_unit, keep_positive, keep_non_negative,
        shrink_int, shrink_float, shrink_plan, clean_pipeline,
    )
}

#: What the lines of LINES are read as; a column with missing cells is never a whole number.
LINES_SQL = """
SELECT c_custkey AS key, concat(c_name, chr(10), 'a "quoted"', chr(9), 'cell') AS name,
       CASE WHEN c_custkey % 11 = 0 OR (c_custkey % 5 <> 0 AND c_custkey % 13 <> 0) THEN c_mktsegment END AS segment,
       CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS nation
FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 11 = 0
"""

ORACLE_SQL = {
    "scan_table": "SELECT * FROM orders",
    "scan_delimited": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "scan_lines": LINES_SQL,
    "scan_first_lines": f"{LINES_SQL} ORDER BY key LIMIT 1000",
    "head_rows": "SELECT * FROM customer ORDER BY c_custkey LIMIT 5",
    "first_n_rows": "SELECT * FROM events ORDER BY event_id LIMIT 1000",
    "wide_numeric_columns": "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
    "all_numeric_columns": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
    "text_columns": "SELECT o_orderstatus, o_orderpriority FROM orders",
    "pick_columns": "SELECT o_orderpriority, o_orderkey FROM orders",
    "text_except": "SELECT o_orderpriority FROM orders",
    "text_except_dates": "SELECT o_orderpriority FROM orders",
    "low_cardinality": "SELECT p_type FROM part",
    "n_unique": "SELECT 'c_mktsegment' AS \"column\", count(DISTINCT c_mktsegment) AS n_unique FROM customer",
    "column_roles": f"""
        SELECT "column", CASE WHEN n <= 10 THEN 'ordinal' ELSE 'non_ordinal' END AS role
        FROM ({value_counts("part", ["p_name", "p_brand", "p_type"])})
        UNION ALL SELECT unnest(['p_partkey', 'p_size', 'p_retailprice']), 'numeric'
    """,
    "drop_columns": "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "null_fraction": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(1 - CAST(count({c}) AS DOUBLE) / count(*), 4) AS null_fraction FROM ({DIRTY})" for c in DIRTY_COLUMNS
    ),
    "drop_sparse": f"SELECT event_id, event_type, value, energy_100g, serving_size, quantity FROM ({DIRTY})",
    "column_info": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) AS n_rows FROM ({DIRTY})" for c in DIRTY_COLUMNS),
    "column_types": """
        SELECT * FROM (VALUES ('o_orderkey', 'int64'), ('o_custkey', 'int64'), ('o_orderstatus', 'text'), ('o_totalprice', 'float64'),
                              ('o_orderdate', 'timestamp'), ('o_orderpriority', 'text')) AS t("column", type)
    """,
    "fill_mean": f"WITH d AS ({DIRTY}) SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM d)), 6) AS value FROM d",
    "fill_mode": f"WITH d AS ({DIRTY}) SELECT event_id, coalesce(event_type, ({mode_sql('event_type', 'd')})) AS event_type FROM d",
    "mode_values": f"""
        SELECT 'o_orderstatus' AS "column", ({mode_sql("o_orderstatus", "orders")}) AS mode
        UNION ALL SELECT 'o_orderpriority', ({mode_sql("o_orderpriority", "orders")})
    """,
    "mode_of_many_values": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", ({mode_sql(c, t)}) AS mode"
        for c, t in (("text", "documents"), ("lang", "documents"), ("source", "documents"), ("props", "events"), ("ts", "(SELECT CAST(ts AS VARCHAR) AS ts FROM events)"))
    ),
    "few_valued": f"""
        SELECT "column", CASE WHEN n <= 60 THEN n END AS n
        FROM ({value_counts("documents", ["text", "lang", "source"])} UNION ALL {value_counts("part", ["p_name", "p_brand", "p_type"])})
    """,
    "cap_outliers": "WITH q AS (SELECT "
    + ", ".join(f"quantile_disc({c}, 0.01) AS {c}_a, quantile_disc({c}, 0.99) AS {c}_b" for c in ("l_quantity", "l_extendedprice", "l_discount"))
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"least(greatest({c}, {c}_a), {c}_b) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount"))
    + " FROM lineitem, q",
    "column_quantiles": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(quantile_disc({c}, 0.01) AS DOUBLE) AS low, CAST(quantile_disc({c}, 0.5) AS DOUBLE) AS middle, CAST(quantile_disc({c}, 0.99) AS DOUBLE) AS high FROM ({DIRTY})"
        for c in ("value", "energy_100g", "half")
    ),
    "profile_refit": f"WITH d AS (SELECT * FROM ({DIRTY}) WHERE event_id % 4 > 0)" + " UNION ALL ".join(profile_sql(c, "d") for c in DIRTY_COLUMNS),
    "sketched_distinct": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, TRUE AS within_error FROM lineitem WHERE l_linenumber % 2 = 0 OR l_linenumber % 3 > 0"
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    ),
    "as_of_join": """
        SELECT p.event_id, p.user_id, p.ts, p.value, v.event_id AS view_event_id, v.value AS view_value
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
    """,
    "interval_sums": """
        WITH o AS (SELECT o_orderkey, o_custkey % 50 AS part, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders)
        SELECT s.o_orderkey, count(*) AS n, round(sum(p.o_totalprice), 2) AS total
        FROM o s JOIN o p ON p.part = s.part AND p.day >= s.day AND p.day < s.day + 30 GROUP BY s.o_orderkey
    """,
    "profile_sets": """
        WITH counts AS (
            SELECT p_type, p_size, p_brand, GROUPING_ID(p_type, p_size) AS grouping, count(*) AS n FROM part
            GROUP BY GROUPING SETS ((p_type, p_size, p_brand), (p_type, p_brand), (p_size, p_brand), (p_brand))
        ), modes AS (
            SELECT p_type, p_size, grouping, count(*) AS n_distinct, arg_min(p_brand, (-n, p_brand)) AS mode FROM counts GROUP BY ALL
        ), sums AS (
            SELECT p_type, p_size, GROUPING_ID(p_type, p_size) AS grouping, count(*) AS n_rows, count(p_brand) AS brands, count(p_retailprice) AS prices,
                   round(avg(p_retailprice), 4) AS mean, min(p_retailprice) AS low, max(p_retailprice) AS high
            FROM part GROUP BY GROUPING SETS ((p_type, p_size), (p_type), (p_size), ())
        )
        SELECT s.p_type, s.p_size, CAST(s.grouping AS INTEGER) AS grouping, 'p_brand' AS "column", n_rows, brands AS non_null, n_distinct, NULL::DOUBLE AS mean, mode, NULL::DOUBLE AS low, NULL::DOUBLE AS high
        FROM sums s JOIN modes m ON s.grouping = m.grouping AND s.p_type IS NOT DISTINCT FROM m.p_type AND s.p_size IS NOT DISTINCT FROM m.p_size
        UNION ALL SELECT p_type, p_size, CAST(grouping AS INTEGER), 'p_retailprice', n_rows, prices, NULL, mean, NULL, low, high FROM sums
    """,
    "stream_sessions": """
        WITH gaps AS (
            SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR, TRUE) AS begins FROM events
        ), numbered AS (
            SELECT *, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM gaps
        )
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, round(sum(value), 2) AS total FROM numbered GROUP BY user_id, nth
    """,
    "cell_types": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN bool_and(regexp_full_match(CAST({c} AS VARCHAR), '[+-]?[0-9]+')) THEN 'int64'
            WHEN bool_and(regexp_full_match(CAST({c} AS VARCHAR), '[+-]?[0-9]+[.]?[0-9]*([eE][+-]?[0-9]+)?')) THEN 'float64' ELSE 'text' END AS type FROM orders"""
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
    "file_types": """
        SELECT 'p_size' AS "column", CAST(p_partkey % 3 AS INTEGER) AS nth, CASE p_partkey % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'double' ELSE 'text' END AS kind,
               min(CASE p_partkey % 3 WHEN 1 THEN p_size || '.5' WHEN 2 THEN 'size ' || p_size END) AS value
        FROM part GROUP BY p_partkey % 3
    """,
    "extract_number": f"SELECT p_partkey, {NUMBER_SQL.format('p_brand')} AS number FROM part",
    "extract_unit": f"SELECT o_orderkey, {UNIT_SQL.format('o_orderpriority')} AS unit FROM orders",
    "keep_positive": f"""
        SELECT * FROM (SELECT event_id, serving_size, {NUMBER_SQL.format("serving_size")} AS serving_size_value FROM ({DIRTY}))
        WHERE serving_size_value > 0
    """,
    "keep_non_negative": "SELECT * FROM customer WHERE c_acctbal >= 0",
    "shrink_int": "SELECT CAST(c_custkey AS SMALLINT) AS c_custkey, c_nationkey FROM customer",
    "shrink_float": """
        SELECT l_orderkey, l_linenumber, round(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE), 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice,
               round(CAST(CAST(l_discount AS FLOAT) AS DOUBLE), 4) AS l_discount, round(CAST(CAST(l_tax AS FLOAT) AS DOUBLE), 4) AS l_tax
        FROM lineitem
    """,
    "shrink_plan": " UNION ALL ".join(
        [f"SELECT '{c}' AS \"column\", 'int64' AS before, ({fits_sql(c, 'lineitem')}) AS after" for c in ("l_orderkey", "l_partkey", "l_suppkey")]
        + [f"SELECT '{c}', 'float64', ({float_sql(c, 'lineitem')})" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    ),
    "clean_pipeline": f"""
        WITH d AS ({DIRTY}), filled AS (
            SELECT event_id, coalesce(event_type, ({mode_sql("event_type", "d")})) AS event_type,
                   round(coalesce(value, (SELECT avg(value) FROM d)), 6) AS value,
                   round(coalesce(energy_100g, (SELECT avg(energy_100g) FROM d)), 6) AS energy_100g,
                   coalesce(serving_size, ({mode_sql("serving_size", "d")})) AS serving_size,
                   coalesce(quantity, ({mode_sql("quantity", "d")})) AS quantity
            FROM d
        )
        SELECT * FROM (
            SELECT *, {NUMBER_SQL.format("serving_size")} AS serving_size_value, {UNIT_SQL.format("serving_size")} AS serving_size_unit,
                   {NUMBER_SQL.format("quantity")} AS quantity_value, {UNIT_SQL.format("quantity")} AS quantity_unit
            FROM filled
        ) WHERE serving_size_value > 0 AND quantity_value > 0 AND energy_100g >= 0
    """,
}
