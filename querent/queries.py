"""Registered queries: one or more for each operator, with their SQL oracles.

Relational queries are texts of the subset, compiled through parser and
compiler.  Oracles are independent DuckDB SQL over the same tables; where the
expected rows are traced by hand they are listed as VALUES.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions import text as X
from querent.operators import batches, exact, execution, fingerprints, generation, matching, nouns, prompts, reports, schema, stats
from querent.plans.compiler import Catalog, compile_query
from querent.plans.parser import is_valid, parse, tokenize
from querent.sources import files
from querent.sources.catalogs import entry_of
from querent.streaming.scoring import level_counts

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
KEYS = [("nation.n_regionkey", "region.r_regionkey"), ("customer.c_nationkey", "nation.n_nationkey"), ("supplier.s_nationkey", "nation.n_nationkey"), ("orders.o_custkey", "customer.c_custkey"), ("lineitem.l_orderkey", "orders.o_orderkey"), ("lineitem.l_partkey", "part.p_partkey"), ("lineitem.l_suppkey", "supplier.s_suppkey")]

#: name: (text in the subset, column names, oracle).
RELATIONAL: dict[str, tuple[str, list[str], str]] = {
    "r01_projection": ("SELECT n_name, n_regionkey FROM nation", ["n_name", "n_regionkey"], "SELECT n_name, n_regionkey FROM nation"),
    "r02_star": ("SELECT * FROM region", ["r_regionkey", "r_name"], "SELECT r_regionkey, r_name FROM region"),
    "r03_distinct": ("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer", ["segment", "nation"], "SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer"),
    "r04_arithmetic": ("SELECT l_orderkey, l_linenumber, l_quantity - l_discount, l_quantity + l_tax, l_quantity * l_tax FROM lineitem WHERE l_quantity > 49", ["k", "n", "minus", "plus", "times"], "SELECT l_orderkey AS k, l_linenumber AS n, l_quantity - l_discount AS minus, l_quantity + l_tax AS plus, l_quantity * l_tax AS times FROM lineitem WHERE l_quantity > 49"),
    "r04_integer_division": ("SELECT l_orderkey, l_linenumber, l_orderkey / l_linenumber FROM lineitem", ["k", "n", "d"], "SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_orderkey // nullif(l_linenumber, 0) AS BIGINT) AS d FROM lineitem"),
    "r04_division_by_zero": ("SELECT l_orderkey, l_linenumber, l_extendedprice / l_discount FROM lineitem WHERE l_discount = 0", ["k", "n", "d"], "SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice / nullif(l_discount, 0) AS d FROM lineitem WHERE l_discount = 0"),
    "r05_comparison": ("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_brand != 'Brand#11' AND p_retailprice < 1500.5", ["k"], "SELECT p_partkey AS k FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_brand <> 'Brand#11' AND p_retailprice < 1500.5"),
    "r05_text_beside_number": ("SELECT n_name FROM nation WHERE n_regionkey = '1' AND n_nationkey < 'abc'", ["n_name"], "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "r05_timestamp": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01'", ["k"], "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'"),
    "r06_between": ("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000", ["k"], "SELECT o_orderkey AS k FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000"),
    "r06_not_between": ("SELECT c_custkey FROM customer WHERE c_acctbal NOT BETWEEN 0 AND 5000", ["k"], "SELECT c_custkey AS k FROM customer WHERE c_acctbal NOT BETWEEN 0 AND 5000"),
    "r07_like": ("SELECT p_partkey FROM part WHERE p_type LIKE '%cono%'", ["k"], "SELECT p_partkey AS k FROM part WHERE p_type ILIKE '%cono%'"),
    "r07_not_like": ("SELECT n_name FROM nation WHERE n_name NOT LIKE '%n__1%'", ["n_name"], "SELECT n_name FROM nation WHERE n_name NOT ILIKE '%n__1%'"),
    "r08_in": ("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", ["k"], "SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "r08_not_in": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", ["k"], "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "r09_scalar_subquery": ("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)", ["k"], "SELECT c_custkey AS k FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)"),
    "r10_and_or": ("SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000 AND s_nationkey < 10 OR s_acctbal < 0", ["k"], "SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 5000 AND s_nationkey < 10 OR s_acctbal < 0"),
    "r11_join": ("SELECT T3.r_name, count(*), avg(T1.c_acctbal) FROM customer AS T1 JOIN nation AS T2 ON T1.c_nationkey = T2.n_nationkey JOIN region AS T3 ON T2.n_regionkey = T3.r_regionkey GROUP BY T3.r_name", ["region", "n", "mean"], "SELECT r_name AS region, count(*) AS n, avg(c_acctbal) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "r12_theta_join": ("SELECT count(*) FROM nation JOIN region ON n_regionkey > r_regionkey", ["n"], "SELECT count(*) AS n FROM nation JOIN region ON n_regionkey > r_regionkey"),
    "r12_cross_join": ("SELECT n_name, r_name FROM nation JOIN region", ["n_name", "r_name"], "SELECT n_name, r_name FROM nation CROSS JOIN region"),
    "r13_self_join": ("SELECT A.n_name, B.n_name FROM nation AS A JOIN nation AS B ON A.n_regionkey = B.n_regionkey WHERE A.n_nationkey < B.n_nationkey", ["a", "b"], "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey"),
    "r14_derived_table": ("SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)", ["n"], "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)"),
    "r15_aggregates": ("SELECT max(p_retailprice), min(p_retailprice), count(*), sum(p_size), avg(p_size) FROM part", ["a", "b", "c", "d", "e"], "SELECT max(p_retailprice) AS a, min(p_retailprice) AS b, count(*) AS c, CAST(sum(p_size) AS BIGINT) AS d, avg(p_size) AS e FROM part"),
    "r15_aggregate_of_expression": ("SELECT max(l_quantity - l_linenumber) FROM lineitem", ["m"], "SELECT max(l_quantity - l_linenumber) AS m FROM lineitem"),
    "r16_distinct_aggregate": ("SELECT count(DISTINCT o_custkey), count(DISTINCT o_orderstatus) FROM orders", ["c", "s"], "SELECT count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderstatus) AS s FROM orders"),
    "r17_group_by": ("SELECT l_returnflag, l_linestatus, count(*), sum(l_quantity) FROM lineitem GROUP BY l_returnflag, l_linestatus", ["f", "s", "n", "q"], "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL"),
    "r17_bare_column": ("SELECT c_mktsegment, c_name, max(c_custkey) FROM customer GROUP BY c_mktsegment", ["s", "name", "k"], "SELECT c_mktsegment AS s, arg_max(c_name, c_custkey) AS name, max(c_custkey) AS k FROM customer GROUP BY c_mktsegment"),
    "r18_having": ("SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey HAVING count(*) > 15", ["k", "n"], "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    "r19_order_by": ("SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name ASC", ["r", "n"], "SELECT n_regionkey AS r, n_name AS n FROM nation ORDER BY n_regionkey DESC, n_name NULLS FIRST"),
    "r20_limit": ("SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus ORDER BY count(*) DESC LIMIT 3", ["s", "n"], "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY o_orderstatus ORDER BY n DESC LIMIT 3"),
    "r21_union": ("SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier", ["k"], "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "r22_intersect": ("SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier", ["k"], "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier"),
    "r23_except": ("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000", ["k"], "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000"),
    "r23_chain": ("SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier UNION SELECT r_regionkey FROM region", ["k"], "(SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier) UNION SELECT r_regionkey FROM region"),
    "r24_correlated": ("SELECT T1.c_custkey FROM customer AS T1 WHERE T1.c_acctbal > (SELECT avg(T2.c_acctbal) FROM customer AS T2 WHERE T2.c_nationkey = T1.c_nationkey)", ["k"], "SELECT c_custkey AS k FROM customer a WHERE c_acctbal > (SELECT avg(b.c_acctbal) FROM customer b WHERE b.c_nationkey = a.c_nationkey)"),
    "r24_nested_having": ("SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey HAVING count(*) >= (SELECT min(r_regionkey) FROM region)", ["r", "n"], "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) >= (SELECT min(r_regionkey) FROM region)"),
    "tpch_q1_like": ("SELECT l_returnflag, l_linestatus, sum(l_quantity), sum(l_extendedprice), avg(l_discount), count(*) FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", ["f", "s", "q", "p", "d", "n"], "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS q, sum(l_extendedprice) AS p, avg(l_discount) AS d, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"),
    "tpch_join_agg": ("SELECT T4.n_name, count(*), sum(T1.l_quantity) FROM lineitem AS T1 JOIN orders AS T2 ON T1.l_orderkey = T2.o_orderkey JOIN customer AS T3 ON T2.o_custkey = T3.c_custkey JOIN nation AS T4 ON T3.c_nationkey = T4.n_nationkey WHERE T2.o_orderdate >= '1996-01-01' GROUP BY T4.n_name", ["nation", "n", "q"], "SELECT n_name AS nation, count(*) AS n, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY n_name"),
}


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _relational(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql, columns, _ = RELATIONAL[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(compile_query(spark, sql, Catalog.of_folder(spark, sf_dir, TABLES), columns))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _relational(n) for n in RELATIONAL}

#: Columns that are doubles, for rounding in the oracle.
_DOUBLES = {"r04_arithmetic": ("minus", "plus", "times"), "r04_division_by_zero": ("d",), "r11_join": ("mean",), "r15_aggregates": ("a", "b", "e"), "r15_aggregate_of_expression": ("m",), "r17_group_by": ("q",), "tpch_q1_like": ("q", "p", "d"), "tpch_join_agg": ("q",)}

ORACLES: dict[str, str] = {n: f"WITH _q AS ({o}) SELECT {', '.join(f'round({c}, 4) AS {c}' if c in _DOUBLES.get(n, ()) else c for c in cols)} FROM _q" for n, (_, cols, o) in RELATIONAL.items()}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows: list[tuple], names: list[str]) -> str:
    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


# -- text functions

_WORDS = r"FROM (SELECT unnest(string_split_regex(text, '\s+')) AS w FROM documents) WHERE w <> ''"
_RATIO = r"CASE WHEN length(regexp_replace(w, '[^\p{L}]', '', 'g')) > 0 THEN length(regexp_replace(w, '[^a-zA-Z]', '', 'g')) / length(regexp_replace(w, '[^\p{L}]', '', 'g')) ELSE 0.0 END"
_MARKS = f"[{X.MARKED}{X.MARKED.upper()}]"
#: Names of a schema, some of which occur as words.
NAMES = ("The", "and_that", "Singer_ID", "of")
_NAMED = "'the', 'and_that', 'and that', 'singer_id', 'singer id', 'of'"
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def _reason_sql(w: str, named: str) -> str:
    """Why a noun is filtered, as DuckDB SQL; ``named`` tells whether it is a name."""
    return f"CASE WHEN length({w}) < 2 THEN 'too_short_removed' WHEN length({w}) > 30 THEN 'too_long_removed' WHEN lower({w}) IN ({_STOP}) THEN 'vietnamese_stopwords_removed' WHEN {named} THEN 'schema_name_duplicates_removed' WHEN ({_RATIO.replace('(w,', f'({w},')}) > 0.70 AND NOT regexp_matches({w}, '{_MARKS}') THEN 'english_nouns_removed' ELSE '' END"


_REASON = _reason_sql("w", f"lower(w) IN ({_NAMED}) OR trim(regexp_replace(replace(lower(w), '_', ' '), '\\s+', ' ', 'g')) IN ({_NAMED})")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("w")).filter("w <> ''")


@query(f"SELECT doc_id, round({_RATIO.replace('(w,', '(text,')}, 6) AS ratio, regexp_matches(text, '{_MARKS}') AS marked FROM documents")
def f07_ascii_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """share of ASCII letters and marks of every document."""
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(X.ascii_letter_ratio(F.col("text")), 6).alias("ratio"), X.has_mark(F.col("text")).alias("marked"))


@query(f"SELECT {_REASON} AS reason, count(*) AS n {_WORDS} GROUP BY 1")
def f09_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why words are filtered, counted over all documents; each different word is judged once."""
    words = _words(spark, sf_dir).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*(F.lit(n) for n in NAMES))
    return words.select(X.filter_reason(F.col("w"), names).alias("reason"), "n").groupBy("reason").agg(F.sum("n").alias("n"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(replace(text, '_', ' ')), '\s+', ' ', 'g')) AS name FROM documents")
def f05_schema_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalised names."""
    return _table(spark, sf_dir, "documents").select("doc_id", X.schema_name(F.col("text")).alias("name"))


TAGGED = [
    (0, [("cơ", "N"), ("sở", "N"), ("dữ", "N"), ("liệu", "N"), ("nào", "P")], "cơ|sở|dữ|liệu|cơ sở dữ liệu", "cơ|sở|dữ|liệu"),
    (1, [("ca", "N"), ("sĩ", "Nc"), ("hát", "V"), ("ca", "N")], "ca|sĩ|ca sĩ", "ca|sĩ"),
    (2, [("hát", "V")], "", ""),
    (3, [(" tên ", "N"), ("", "N"), ("bài", "N"), ("hát", "N")], "tên|bài|hát|bài hát", "tên|bài|hát"),
]


@query(_values([(i, p, n) for i, _, p, n in TAGGED], ["id", "candidates", "nouns"]))
def f02_noun_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nouns and noun runs of tagged tokens."""
    df = spark.createDataFrame([(i, t) for i, t, _, _ in TAGGED], "id int, tagged array<struct<token: string, tag: string>>")
    return df.select("id", F.array_join(X.noun_candidates(F.col("tagged")), "|").alias("candidates"), F.array_join(X.nouns(F.col("tagged")), "|").alias("nouns"))


IDENTIFIERS = [("Singer_ID", "singer id"), ("birthYear", "birth year"), ("  Song__Name ", "song name"), ("HTTPServer", "httpserver")]


@query(_values(IDENTIFIERS, ["name", "cleaned"]))
def f12_clean_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(n,) for n, _ in IDENTIFIERS], "name string")
    return df.select("name", X.clean_identifier(F.col("name")).alias("cleaned"))


ANSWERS = [
    (0, "```sql\nSELECT a\nFROM t;\n```", "SELECT a FROM t"),
    (1, "Here you go: select 1; select 2", "select 1"),
    (2, "no statement   at all", "no statement at all"),
    (3, "Answer with care: SELECT x FROM y", "with care: SELECT x FROM y"),
    (4, "WITH q AS (SELECT 1) SELECT * FROM q\n", "WITH q AS (SELECT 1) SELECT * FROM q"),
    (5, "", ""),
]


@query(_values([(i, s) for i, _, s in ANSWERS], ["id", "sql"]))
def f13_extract_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """statements in model answers."""
    df = spark.createDataFrame([(i, a) for i, a, _ in ANSWERS], "id int, answer string")
    return df.select("id", X.prediction(F.col("answer")).alias("sql"))


@query(_values([(0.82, "t082"), (0.9, "t090"), (0.4, "t040")], ["threshold", "tag"]))
def f15_threshold_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(0.82,), (0.9,), (0.4,)], "threshold double")
    return df.select("threshold", X.threshold_tag(F.col("threshold")).alias("tag"))


# -- schemas

CONCERT = {
    "db_id": "concert",
    "table_names_original": ["singer", "concert", "singer_in_concert", "Ref_Template_Types", "sqlite_sequence"],
    "column_names_original": [[-1, "*"], [0, "Singer_ID"], [0, "Name"], [0, "Country"], [1, "Concert_ID"], [1, "Venue"], [2, "Singer_ID"], [2, "Concert_ID"], [3, "Template_Type_ID"], [3, "Template_Type_Description"], [4, "seq"]],
    "column_types": ["text", "number", "text", "text", "number", "text", "number", "number", "number", "text", "text"],
    "primary_keys": [1, 4, 8],
    "foreign_keys": [[6, 1], [7, 4]],
}


@query(_values([("singer", "entity", 0), ("concert", "entity", 0), ("singer_in_concert", "junction", 2), ("Ref_Template_Types", "reference", 0), ("sqlite_sequence", "entity", 0)], ["table_name", "table_type", "n_keys"]))
def g04_table_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification from names, columns and foreign keys."""
    c = schema.classified(schema.from_python(spark, [CONCERT]))
    return c.select(F.col("table").alias("table_name"), "table_type", F.size("fks").alias("n_keys"))


@query(_values([("concert|concert_id|country|name|ref_template_types|singer|singer_id|singer_in_concert|template_type_description|template_type_id|venue",)], ["names"]))
def g06_schema_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.schema_names(schema.from_python(spark, [CONCERT])).select(F.array_join("names", "|").alias("names"))


@query(_values([("singer", "singer: Name, Country"), ("concert", "concert: Venue"), ("singer_in_concert", "singer_in_concert"), ("Ref_Template_Types", "Ref_Template_Types: Template_Type_Description")], ["table_name", "text"]))
def g08_table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.table_texts(schema.from_python(spark, [CONCERT])).select(F.col("table").alias("table_name"), "text")


_TARGETS = [(0, "singer", "entity"), (1, "singer Name", "entity"), (2, "singer Country", "entity"), (3, "concert", "entity"), (4, "concert Venue", "entity"), (5, "singer_in_concert", "junction"), (6, "Ref_Template_Types", "reference"), (7, "Ref_Template_Types Template_Type_Description", "reference")]


@query(_values(_TARGETS, ["target_idx", "text", "table_type"]))
def g09_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.targets(schema.from_python(spark, [CONCERT])).select("target_idx", "text", "table_type")


@query(_values([(0, "singer Artists on stage", "entity"), (1, "singer Name The full name", "entity"), (2, "singer Concert FK. PK. link", "entity")], ["target_idx", "text", "table_type"]))
def g10_rich_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("concert", 0, "singer", "Artists on stage", 0, "Singer_ID", "PK. Key"), ("concert", 0, "singer", "Artists on stage", 1, "Name", "The full name"), ("concert", 0, "singer", "Artists on stage", 2, "Concert", "FK. PK. link")]
    d = spark.createDataFrame(rows, "db_id string, table_pos int, table string, description string, col_pos int, column string, col_description string")
    return schema.rich_targets(d, schema.from_python(spark, [CONCERT])).select("target_idx", "text", "table_type")


# -- the same operators over rows of the given tables

_TAG = "CASE WHEN regexp_matches(w, '^[a-h]') THEN 'N' WHEN regexp_matches(w, '^[A-Z]') THEN 'Np' ELSE 'V' END"


@query(f"""WITH t AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w, unnest(range(len(string_split_regex(text, '\\s+')))) AS pos FROM documents),
n AS (SELECT doc_id, pos, w FROM t WHERE w <> '' AND {_TAG} LIKE 'N%'),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM n),
e AS (SELECT doc_id, pos, w AS candidate, 0 AS phrase FROM n UNION ALL SELECT doc_id, max(pos), string_agg(w, ' ' ORDER BY pos), 1 FROM r GROUP BY doc_id, run HAVING count(*) > 1),
f AS (SELECT doc_id, candidate, min((pos, phrase)) AS at_ FROM e GROUP BY doc_id, candidate)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY at_) - 1 AS INTEGER) AS place, candidate, at_[2] = 1 AS phrase FROM f""")
def f02_noun_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nouns and noun runs of the words of all documents, a row a token."""
    words = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.posexplode(F.split("text", r"\s+")).alias("pos", "token"))
    tag = F.when(F.col("token").rlike("^[a-h]"), "N").when(F.col("token").rlike("^[A-Z]"), "Np").otherwise("V")
    return nouns.candidates(words.withColumn("tag", tag)).withColumnRenamed("text_id", "doc_id")


_DICTIONARY = r"SELECT DISTINCT lang, lower(w) AS w FROM (SELECT DISTINCT lang FROM documents), (SELECT unnest(string_split_regex(text, '\s+')) AS w FROM benchmark WHERE item_id % 2 = 0) WHERE w <> ''"


@query(f"""WITH names AS ({_DICTIONARY}), w AS (SELECT lang, unnest(string_split_regex(text, '\\s+')) AS w FROM documents), c AS (SELECT lang, w, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL)
SELECT lang, reason, CAST(sum(n) AS BIGINT) AS n, count(*) AS different FROM (SELECT c.lang, n, {_reason_sql('c.w', 'k IS NOT NULL')} AS reason
FROM c LEFT JOIN (SELECT lang, w AS k FROM names) d ON c.lang = d.lang AND lower(c.w) = d.k) GROUP BY ALL""")
def f09_dictionary_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents against the names of their language, the words of half the benchmark."""
    d = _table(spark, sf_dir, "documents")
    words = d.select(F.col("lang").alias("db_id"), F.explode(F.split("text", r"\s+")).alias("noun")).filter("noun <> ''").groupBy("db_id", "noun").agg(F.count(F.lit(1)).alias("n"))
    said = _table(spark, sf_dir, "benchmark").filter("item_id % 2 = 0").select(F.explode(F.split("text", r"\s+")).alias("name")).filter("name <> ''").distinct()
    names = d.select(F.col("lang").alias("db_id")).distinct().crossJoin(F.broadcast(said.select(F.concat("name", F.lit("_")).alias("name"))))
    judged = words.join(nouns.reasons(words, names), ["db_id", "noun"])
    return judged.groupBy(F.col("db_id").alias("lang"), "reason").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different"))


@query(r"SELECT name, trim(regexp_replace(lower(regexp_replace(replace(name, '_', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '\s+', ' ', 'g')) AS cleaned FROM (SELECT DISTINCT w || 'Id_' || w || 'KeyOf2' AS name " + _WORDS + ")")
def f12_clean_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identifiers made of the words of all documents."""
    names = _words(spark, sf_dir).select(F.expr("concat(w, 'Id_', w, 'KeyOf2')").alias("name")).distinct()
    return names.select("name", X.clean_identifier(F.col("name")).alias("cleaned"))


_BARE = r"regexp_replace(regexp_replace(answer, '```sql\s*', '', 'g'), '```\s*', '', 'g')"
_FOUND = f"regexp_extract({_BARE}, '((?:WITH|SELECT).*?)(?:;|$)', 1, 'is')"


@query(f"SELECT conv_id, turn, trim(regexp_replace(CASE WHEN {_FOUND} <> '' THEN {_FOUND} ELSE {_BARE} END, '\\s+', ' ', 'g')) AS sql FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '```sql' || chr(10) || 'SELECT ' || text || ';' || chr(10) || '```' ELSE text END AS answer FROM conversations)")
def f13_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """statements in all turns, every other one in a fence."""
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```sql\nSELECT "), "text", F.lit(";\n```"))).otherwise(F.col("text"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", X.prediction(answer).alias("sql"))


@query("SELECT DISTINCT l_discount AS threshold, 't' || replace(format('{:.2f}', l_discount), '.', '') AS tag FROM lineitem")
def f15_discount_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("threshold")).distinct()
    return d.select("threshold", X.threshold_tag(F.col("threshold")).alias("tag"))


#: Schemas from table values: a region is a database, its nations are tables, their suppliers columns.  The same text is Spark and DuckDB SQL.
_TABLE_ROWS = "SELECT concat('db', n_regionkey) AS db_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS table_idx, n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN concat('Ref_', n_name) WHEN 1 THEN concat(n_name, '_Types') WHEN 2 THEN concat('sqlite_', lower(n_name)) ELSE n_name END AS tbl FROM nation"
_COLUMN_ROWS = "SELECT db_id, table_idx, tbl, CAST(row_number() OVER (PARTITION BY db_id ORDER BY s_suppkey) AS INT) AS col_idx, s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN concat('Key', s_suppkey, '_ID') WHEN 1 THEN concat('Code', s_suppkey) WHEN 2 THEN concat('Long', s_suppkey, '_Name') ELSE concat('Col', s_suppkey) END AS col, CASE WHEN s_acctbal > 0 THEN 'number' ELSE 'text' END AS kind, s_suppkey % 10 = 0 AS pk, s_suppkey % 3 = 0 AS fk FROM supplier JOIN t ON s_nationkey = n_nationkey"
_SCHEMA_ROWS = f"WITH t AS ({_TABLE_ROWS}), c AS ({_COLUMN_ROWS})"


def _schemas(spark: SparkSession, sf_dir: str) -> schema.Schemas:
    given = {n: _table(spark, sf_dir, n) for n in ("nation", "supplier")}
    rows = lambda sql: spark.sql(f"{_SCHEMA_ROWS.replace('FROM nation', 'FROM {nation}').replace('FROM supplier', 'FROM {supplier}')} {sql}", **given)
    star = "SELECT DISTINCT db_id, 0 AS col_idx, -1 AS table_idx, '*' AS column, 'text' AS type FROM t"
    return schema.Schemas(
        rows("SELECT db_id, table_idx, tbl AS table FROM t"),
        rows(f"SELECT db_id, col_idx, table_idx, col AS column, kind AS type FROM c UNION ALL {star}"),
        rows("SELECT db_id, CAST(row_number() OVER (PARTITION BY db_id ORDER BY col_idx) - 1 AS INT) AS pos, col_idx AS child, 1 AS parent FROM c WHERE fk"),
        rows("SELECT db_id, col_idx FROM c WHERE pk"),
    )


_ID, _CODE, _SAID = "regexp_matches(lower({}), '^id$|_id$')", "regexp_matches(lower({}), '^id$|_id$|code')", "regexp_matches(lower({}), 'description|_desc$|_name$|^name$')"
_PAIR = " OR ".join(f"({_CODE.format(x)} AND {_SAID.format(y)})" for x, y in (("cols[1]", "cols[2]"), ("cols[2]", "cols[1]")))
_CLASSED = f"""{_SCHEMA_ROWS}, g AS (SELECT t.db_id, t.table_idx, t.tbl, coalesce(list(col ORDER BY col_idx) FILTER (col IS NOT NULL), []) AS cols, count(*) FILTER (fk) AS n_keys, count(*) FILTER (NOT fk) AS others FROM t LEFT JOIN c ON t.db_id = c.db_id AND t.table_idx = c.table_idx GROUP BY ALL),
k AS (SELECT *, CASE WHEN regexp_matches(lower(tbl), '^ref_|_types$|_codes$') OR len(cols) = 2 AND n_keys = 0 AND ({_PAIR}) THEN 'reference' WHEN n_keys >= 2 AND others <= 1 THEN 'junction' ELSE 'entity' END AS table_type FROM g),
v AS (SELECT * FROM k WHERE NOT starts_with(lower(tbl), 'sqlite_'))"""


@query(f"{_CLASSED} SELECT db_id, tbl AS table_name, table_type, CAST(n_keys AS INTEGER) AS n_keys FROM k")
def g04_derived_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of tables made from nations and suppliers."""
    c = schema.classified(_schemas(spark, sf_dir))
    return c.select("db_id", F.col("table").alias("table_name"), "table_type", F.size("fks").alias("n_keys"))


@query(f"{_CLASSED}, x AS (SELECT db_id, lower(tbl) AS n FROM v UNION SELECT db_id, lower(unnest(cols)) FROM v) SELECT db_id, string_agg(n, '|' ORDER BY n) AS names FROM x GROUP BY db_id")
def g06_derived_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.schema_names(_schemas(spark, sf_dir)).select("db_id", F.array_join("names", "|").alias("names"))


_PLAIN = f"list_filter(cols, lambda x: NOT {_ID.format('x')})"


@query(f"{_CLASSED} SELECT db_id, tbl AS table_name, tbl || CASE WHEN len({_PLAIN}) > 0 THEN ': ' || array_to_string({_PLAIN}, ', ') ELSE '' END AS text FROM v")
def g08_derived_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.table_texts(_schemas(spark, sf_dir)).select("db_id", F.col("table").alias("table_name"), "text")


_TARGET_ROWS = f"{_CLASSED}, e AS (SELECT db_id, table_idx, -1 AS col_idx, tbl AS text, table_type FROM v UNION ALL SELECT v.db_id, v.table_idx, col_idx, v.tbl || ' ' || col, table_type FROM v JOIN c ON v.db_id = c.db_id AND v.table_idx = c.table_idx WHERE NOT ({_ID.format('col')} AND (pk OR fk OR col_idx = 1 AND false)))"


@query(f"{_TARGET_ROWS} SELECT db_id, CAST(row_number() OVER (PARTITION BY db_id ORDER BY table_idx, col_idx) - 1 AS INTEGER) AS target_idx, text, table_type FROM e")
def g09_derived_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.targets(_schemas(spark, sf_dir)).select("db_id", "target_idx", "text", "table_type")


@query(f"""{_SCHEMA_ROWS}, v AS (SELECT * FROM t WHERE NOT starts_with(lower(tbl), 'sqlite_')),
b AS (SELECT v.db_id, v.table_idx, 'Table: ' || v.tbl || chr(10) || coalesce(string_agg('  - ' || col || ' (' || kind || ')' || chr(10), '' ORDER BY col_idx), '') AS block FROM v LEFT JOIN c ON v.db_id = c.db_id AND v.table_idx = c.table_idx GROUP BY v.db_id, v.table_idx, v.tbl),
p AS (SELECT db_id, tbl || '.' || col AS parent, starts_with(tbl, 'sqlite_') AS hidden FROM c WHERE col_idx = 1),
f AS (SELECT c.db_id, string_agg('  - ' || tbl || '.' || col || ' -> ' || parent, chr(10) ORDER BY col_idx) AS keys FROM c JOIN p ON c.db_id = p.db_id WHERE fk AND NOT hidden AND NOT starts_with(tbl, 'sqlite_') GROUP BY c.db_id),
d AS (SELECT db_id, string_agg(block, chr(10) ORDER BY table_idx) AS body FROM b GROUP BY db_id)
SELECT DISTINCT t.db_id, 'Database: ' || t.db_id || chr(10) || chr(10) || coalesce(body, '') || CASE WHEN keys IS NOT NULL THEN chr(10) || 'Foreign Keys:' || chr(10) || keys ELSE '' END AS schema_text FROM t LEFT JOIN d ON t.db_id = d.db_id LEFT JOIN f ON t.db_id = f.db_id""")
def k01_derived_schema_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: prompts' schema texts of databases made from nations and suppliers."""
    return schema.schema_texts(_schemas(spark, sf_dir))


@query(f"{_CLASSED} SELECT db_id, tbl AS table_name, table_type, CAST(len(cols) AS INTEGER) AS n_columns FROM k")
def s03_schema_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema file of the same databases, an object a line, written and read by tasks."""
    s, path = _schemas(spark, sf_dir), f"{files.scratch(spark)}/files/tables-{uuid.uuid4().hex}"
    named = lambda rows, place, value: rows.groupBy("db_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(place, value.alias("v")))), lambda x: x["v"]).alias("x"))
    parts = {
        "table_names_original": named(s.tables, "table_idx", F.col("table")),
        "column_names_original": named(s.columns, "col_idx", F.array(F.col("table_idx").cast("string"), "column")),
        "column_types": named(s.columns, "col_idx", F.col("type")),
        "primary_keys": named(s.pks, "col_idx", F.col("col_idx")),
        "foreign_keys": named(s.fks, "pos", F.array("child", "parent")),
    }
    entries = s.tables.select("db_id").distinct()
    for name, rows in parts.items():
        entries = entries.join(rows.withColumnRenamed("x", name), "db_id", "left")
    entries.write.json(path)
    shape = "db_id string, table_names_original array<string>, column_names_original array<array<string>>, column_types array<string>, primary_keys array<int>, foreign_keys array<array<int>>"
    c = schema.classified(schema.from_entries(files.json_rows(spark, path, shape, lines=True)))
    return c.select("db_id", F.col("table").alias("table_name"), "table_type", F.size("columns").alias("n_columns"))


# -- matching: each vector is a noun, each label's mean vector a target; both are made unit vectors

#: Similarity times priority that a match needs; some vectors reach it and some do not.
LEAST = 0.2
_TYPES = "CASE label % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'junction' ELSE 'reference' END"
_MEANS = "SELECT label, list(m ORDER BY i) AS t FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) GROUP BY label"
_COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), t)"
_MATCH = f"WITH means AS ({_MEANS}), pairs AS (SELECT vec_id, e.label AS example_idx, m.label AS target, {_TYPES.replace('label', 'm.label')} AS table_type, {_COSINE} * CASE m.label % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.6 END AS s FROM embeddings e, means m), best AS (SELECT vec_id, example_idx, arg_max(target, s) AS target, arg_max(table_type, s) AS table_type, max(s) AS s FROM pairs GROUP BY vec_id, example_idx), hit AS (SELECT vec_id, example_idx, 't' || target AS tbl, target % 2 = 1 AS named, round(s, 4) AS similarity, table_type FROM best WHERE s >= {LEAST})"


def _unit(c: str) -> Column:
    """A vector column divided by its length."""
    length = F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x))
    return F.transform(c, lambda x: x / F.nullif(length, F.lit(0.0))).alias("embedding")


def _nouns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    dims = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    means = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    kind = F.when(F.col("label") % 3 == 0, "entity").when(F.col("label") % 3 == 1, "junction").otherwise("reference")
    column = F.when(F.col("label") % 2 == 1, F.concat(F.lit("c"), F.col("label").cast("string")))
    targets = means.select(F.lit("db").alias("db_id"), F.col("label").alias("target_idx"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("table"), column.alias("column"), kind.alias("table_type"), _unit("mean"))
    nouns = e.select(F.col("label").alias("example_idx"), F.lit("db").alias("db_id"), F.col("vec_id").alias("noun_pos"), F.col("vec_id").cast("string").alias("vi_noun"), _unit("embedding"))
    return nouns, targets


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_targets(*_nouns(spark, sf_dir), threshold=LEAST)


@query(f"WITH means AS ({_MEANS}), best AS (SELECT vec_id, arg_max(m.label, {_COSINE}) AS target, max({_COSINE}) AS s FROM embeddings e, means m GROUP BY vec_id) SELECT vec_id AS noun_pos, 't' || target AS table_name, round(s, 4) AS similarity FROM best WHERE s >= {LEAST}")
def h04_best_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nouns, targets = _nouns(spark, sf_dir)
    return matching.best_tables(nouns, targets, LEAST).select("noun_pos", F.col("table").alias("table_name"), "similarity")


@query(f"{_MATCH} SELECT vec_id AS noun_pos, tbl AS table_name, similarity, table_type FROM hit")
def h05_best_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5, H6: arg-max of similarity times table priority."""
    return _matches(spark, sf_dir).select("noun_pos", F.col("table").alias("table_name"), "similarity", "table_type")


_HINTS = f"{_MATCH}, per AS (SELECT example_idx, tbl, arg_min(CAST(vec_id AS VARCHAR), (-similarity, vec_id)) AS vi_noun, max(similarity) AS similarity, min((-similarity, vec_id)) AS first, any_value(table_type) AS table_type, any_value(named) AS named FROM hit GROUP BY example_idx, tbl), top AS (SELECT *, row_number() OVER (PARTITION BY example_idx ORDER BY first) AS r FROM per), cut AS (SELECT * FROM top WHERE r <= 3)"


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints of all examples, the labels; nouns are their candidates."""
    nouns, _ = _nouns(spark, sf_dir)
    hints = matching.limit_hints(matching.ranked_matches(_matches(spark, sf_dir)))
    every = nouns.groupBy("example_idx").agg(F.transform(F.array_sort(F.collect_list("noun_pos")), lambda x: x.cast("string")).alias("candidates"))
    return every.join(hints, "example_idx", "left").withColumn("hints", F.coalesce("hints", F.array().cast(f"array<{matching.HINT}>")))


@query(f"{_HINTS} SELECT example_idx, CAST(r AS BIGINT) AS place, vi_noun, tbl AS table_name, similarity FROM cut")
def i01_limited_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best hint of each target, at most three an example."""
    h = _limited(spark, sf_dir).select("example_idx", F.posexplode("hints").alias("p", "h"))
    return h.select("example_idx", (F.col("p") + 1).cast("long").alias("place"), "h.vi_noun", F.col("h.table").alias("table_name"), "h.similarity")


@query(f"{_HINTS} SELECT threshold, l.example_idx, count(c.r) AS n FROM (SELECT DISTINCT label AS example_idx FROM embeddings) l CROSS JOIN (SELECT unnest([0.2::DOUBLE, 0.25, 0.3]) AS threshold) t LEFT JOIN cut c ON c.example_idx = l.example_idx AND c.similarity >= threshold GROUP BY ALL")
def i03_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run, cut at several thresholds."""
    return matching.at_thresholds(_limited(spark, sf_dir), [0.3, 0.2, 0.25]).select("threshold", "example_idx", F.size("hints").cast("long").alias("n"))


@query(f"{_HINTS}, n AS (SELECT l.example_idx, count(c.r) AS n FROM (SELECT DISTINCT label AS example_idx FROM embeddings) l LEFT JOIN cut c USING (example_idx) GROUP BY 1) SELECT count(*) AS total_examples, count(*) FILTER (n > 0) AS examples_with_hints, count(*) FILTER (n = 0) AS examples_without_hints, avg(n) AS avg_hints_per_example, CAST(max(n) AS INT) AS max_hints_in_one_example FROM n")
def j01_hint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hint_counts(_limited(spark, sf_dir))


_EDGES = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(stats.BINS, stats.BINS[1:], strict=False)))


@query(f"{_HINTS} SELECT bin, CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper, count(similarity) AS n FROM (VALUES {_EDGES}) b(bin, lower, upper) LEFT JOIN hit ON similarity >= lower AND (similarity < upper OR bin = 11 AND similarity <= upper) GROUP BY ALL")
def j02_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_matches(spark, sf_dir), "similarity")


@query(f"{_HINTS} SELECT CAST(vec_id AS VARCHAR) AS noun, count(*) AS occurrences FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.example_idx = e.label AND c.vi_noun = CAST(e.vec_id AS VARCHAR)) GROUP BY vec_id, label ORDER BY occurrences DESC, label, vec_id LIMIT 10")
def j03_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.unmatched_nouns(_limited(spark, sf_dir))


@query(f"{_HINTS} SELECT table_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT table_type, count(*) AS n FROM cut GROUP BY 1 UNION ALL VALUES ('entity', 0), ('junction', 0), ('reference', 0)) GROUP BY 1")
def j04_table_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.table_type_distribution(_limited(spark, sf_dir))


@query(f"{_HINTS} SELECT count(*) FILTER (NOT named) AS table_level, count(*) FILTER (named) AS column_level FROM cut")
def j05_match_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.match_levels(_limited(spark, sf_dir))


_COUNTED = ", ".join(f"count(*) FILTER (reason = '{k}') AS {k}" for k in stats.FILTER_KEYS[1:-1])


@query(f"SELECT count(*) AS {stats.FILTER_KEYS[0]}, {_COUNTED}, count(DISTINCT (doc_id, w)) FILTER (reason = '') AS {stats.FILTER_KEYS[-1]} FROM (SELECT doc_id, w, {_REASON} AS reason FROM (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w FROM documents) WHERE w <> '')")
def j06_filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the noun filter removes from the words of all documents."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    raw = _table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("example_idx"), words.alias("raw"), F.array(*(F.lit(n) for n in NAMES)).alias("names"))
    return stats.filter_stats(matching.filter_totals(raw), raw)


_RECORD = f"""{_HINTS}, n AS (SELECT l.example_idx, count(c.r) AS n FROM (SELECT DISTINCT label AS example_idx FROM embeddings) l LEFT JOIN cut c USING (example_idx) GROUP BY 1),
bins AS (SELECT bin, count(similarity) AS n FROM (VALUES {_EDGES}) b(bin, lower, upper) LEFT JOIN cut ON similarity >= lower AND (similarity < upper OR bin = 11 AND similarity <= upper) GROUP BY bin),
un AS (SELECT CAST(vec_id AS VARCHAR) AS noun, count(*) AS o FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.example_idx = e.label AND c.vi_noun = CAST(e.vec_id AS VARCHAR)) GROUP BY vec_id, label ORDER BY o DESC, label, vec_id LIMIT 10),
types AS (SELECT k, count(table_type) AS n FROM (VALUES ('entity'), ('junction'), ('reference')) t(k) LEFT JOIN cut ON table_type = k GROUP BY k)
SELECT 'precomputed' AS model, CAST({LEAST} AS DOUBLE) AS threshold, count(*) AS total_examples, count(*) FILTER (n > 0) AS examples_with_hints, round(avg(n), 6) AS avg_hints_per_example,
(SELECT string_agg(n, ',' ORDER BY bin) FROM bins) AS similarity_counts, (SELECT string_agg(noun || ':' || o, ',' ORDER BY o DESC, noun) FROM un) AS unmatched,
(SELECT string_agg(k || ':' || n, ',' ORDER BY k) FROM types) AS types, (SELECT count(*) FROM embeddings) AS nouns_after_filter, (SELECT count(*) FROM cut WHERE NOT named) AS table_level FROM n"""


def _as_texts(record: DataFrame) -> DataFrame:
    pairs = F.transform("top_unmatched_nouns", lambda e: F.concat(e["noun"], F.lit(":"), e["occurrences"].cast("string")))
    types = F.transform(F.map_entries("table_type_distribution"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return record.select(
        "config.model", "config.threshold", "counts.total_examples", "counts.examples_with_hints", F.round("counts.avg_hints_per_example", 6).alias("avg_hints_per_example"),
        F.array_join(F.transform("similarity_distribution.counts", lambda n: n.cast("string")), ",").alias("similarity_counts"),
        F.array_join(pairs, ",").alias("unmatched"), F.array_join(F.array_sort(types), ",").alias("types"), "filter_stats.nouns_after_filter", "match_level.table_level",
    )


@query(_RECORD)
def j07_augment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole statistics record; its lists as texts."""
    return _as_texts(stats.augment_stats(files.stored(_limited(spark, sf_dir), "hints"), "precomputed", LEAST))


_STEPS = (0.2, 0.25, 0.3, 0.35)


@query(f"""{_HINTS}, t AS (SELECT unnest([{', '.join(map(str, _STEPS))}]::DOUBLE[]) AS threshold), ex AS (SELECT DISTINCT label AS example_idx FROM embeddings), reach AS (SELECT threshold, cut.* FROM cut JOIN t ON similarity >= threshold),
n AS (SELECT threshold, example_idx, count(r) AS n FROM t CROSS JOIN ex LEFT JOIN reach USING (threshold, example_idx) GROUP BY ALL),
counts AS (SELECT threshold, count(*) AS total_examples, count(*) FILTER (n > 0) AS examples_with_hints, round(avg(n), 6) AS avg_hints_per_example FROM n GROUP BY 1),
bins AS (SELECT threshold, string_agg(n, ',' ORDER BY bin) AS similarity_counts FROM (SELECT t.threshold, bin, count(similarity) AS n FROM t CROSS JOIN (VALUES {_EDGES}) b(bin, lower, upper) LEFT JOIN reach ON reach.threshold = t.threshold AND similarity >= lower AND (similarity < upper OR bin = 11 AND similarity <= upper) GROUP BY ALL) GROUP BY 1),
lost AS (SELECT t.threshold, CAST(vec_id AS VARCHAR) AS noun, count(*) AS o, label, vec_id FROM t CROSS JOIN embeddings e WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.threshold = t.threshold AND reach.example_idx = e.label AND reach.vi_noun = CAST(e.vec_id AS VARCHAR)) GROUP BY t.threshold, vec_id, label QUALIFY row_number() OVER (PARTITION BY t.threshold ORDER BY o DESC, label, vec_id) <= 10),
un AS (SELECT threshold, string_agg(noun || ':' || o, ',' ORDER BY o DESC, noun) AS unmatched FROM lost GROUP BY 1),
kinds AS (SELECT threshold, string_agg(k || ':' || n, ',' ORDER BY k) AS types FROM (SELECT t.threshold, k, count(table_type) AS n FROM t CROSS JOIN (VALUES ('entity'), ('junction'), ('reference')) y(k) LEFT JOIN reach ON reach.threshold = t.threshold AND table_type = k GROUP BY ALL) GROUP BY 1),
levels AS (SELECT t.threshold, count(r) FILTER (NOT named) AS table_level FROM t LEFT JOIN reach USING (threshold) GROUP BY 1)
SELECT 'precomputed' AS model, threshold, total_examples, examples_with_hints, avg_hints_per_example, similarity_counts, unmatched, types, (SELECT count(*) FROM embeddings) AS nouns_after_filter, table_level
FROM counts JOIN bins USING (threshold) JOIN un USING (threshold) JOIN kinds USING (threshold) JOIN levels USING (threshold)""")
def j08_records_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record at every threshold, from one pass over the hints of the lowest."""
    return _as_texts(stats.records_at(files.stored(_limited(spark, sf_dir), "hints"), "precomputed", list(_STEPS)))


# -- hints from questions to targets, with an encoder that tells even texts from odd ones

_TURNS = "SELECT conv_id * 1000 + turn AS id, any_value(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) = 1"
_HINTED = 0.65


@query(f"""{_TARGET_ROWS}, targets AS (SELECT db_id, row_number() OVER (PARTITION BY db_id ORDER BY table_idx, col_idx) - 1 AS idx, text, CASE table_type WHEN 'entity' THEN 1.0 WHEN 'junction' THEN 0.7 ELSE 0.6 END AS weight FROM e),
names AS (SELECT DISTINCT db_id, unnest([n, trim(regexp_replace(replace(n, '_', ' '), '\\s+', ' ', 'g'))]) AS name FROM (SELECT db_id, lower(tbl) AS n FROM v UNION SELECT db_id, lower(unnest(cols)) FROM v)),
ex AS ({_TURNS}), w AS (SELECT id, unnest(string_split_regex(text, '\\s+')) AS w, unnest(range(len(string_split_regex(text, '\\s+')))) AS pos FROM ex),
n AS (SELECT id, pos, w FROM w WHERE w <> '' AND {_TAG} LIKE 'N%'), r AS (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS run FROM n),
every AS (SELECT id, pos, w AS noun, 0 AS phrase FROM n UNION ALL SELECT id, max(pos), string_agg(w, ' ' ORDER BY pos), 1 FROM r GROUP BY id, run HAVING count(*) > 1),
found AS (SELECT id, 'db' || id % 5 AS db_id, noun, min((pos, phrase)) AS place FROM every GROUP BY id, noun),
kept AS (SELECT id, f.db_id, noun, row_number() OVER (PARTITION BY id ORDER BY place) AS noun_pos FROM found f WHERE {_reason_sql('noun', "EXISTS (SELECT 1 FROM names WHERE names.db_id = f.db_id AND name IN (lower(noun), trim(regexp_replace(replace(lower(noun), '_', ' '), '\\s+', ' ', 'g'))))")} = ''),
scored AS (SELECT k.id, k.noun, noun_pos, t.text, idx, weight * CASE WHEN (length(noun) + length(t.text)) % 2 = 0 THEN 1.0 ELSE 0.96 END AS s FROM kept k JOIN targets t ON k.db_id = t.db_id),
best AS (SELECT id, noun, noun_pos, arg_max(text, (s, -idx)) AS target, max(s) AS s FROM scored GROUP BY ALL),
per AS (SELECT id, target, min((-s, noun_pos)) AS first, arg_min(noun, (-s, noun_pos)) AS noun, max(s) AS s FROM best WHERE s >= {_HINTED} GROUP BY id, target)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY first) AS place, noun, target, CAST(round(s, 4) AS DOUBLE) AS similarity FROM per QUALIFY place <= 3""")
def i02_augmented_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints of all turns, from tagged words over the filter and the encoder to the best targets."""
    words = F.transform(F.split("text", r"\s+"), lambda w: F.struct(w.alias("token"), F.when((w >= "a") & (w < "i"), "N").when((w >= "A") & (w < "["), "Np").otherwise("V").alias("tag")))
    turns = _table(spark, sf_dir, "conversations").filter("text IS NOT NULL").groupBy((F.col("conv_id") * 1000 + F.col("turn")).alias("example_idx")).agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text")).filter("n = 1")
    examples = turns.select("example_idx", F.concat(F.lit("db"), (F.col("example_idx") % 5).cast("string")).alias("db_id"), words.alias("tagged"))
    s = _schemas(spark, sf_dir)
    targets = files.stored(schema.targets(s), "targets")
    vectors = matching.encode_texts(targets, "by-length", _by_length, matching.document_prefix("by-length"), kind="document").withColumnRenamed("text", "t")
    targets = targets.join(vectors, targets.text == vectors.t).drop("t")
    encode = lambda texts: matching.encode_texts(texts, "by-length", _by_length, matching.query_prefix("by-length"))
    hints = matching.augment(examples, schema.schema_names(s), targets, encode, _HINTED)
    each = hints.select(F.col("example_idx").alias("id"), F.posexplode("hints").alias("p", "h"))
    return each.select("id", (F.col("p") + 1).cast("long").alias("place"), F.col("h.vi_noun").alias("noun"), F.concat_ws(" ", "h.table", "h.column").alias("target"), "h.similarity")


# -- structural scores and execution

PAIRS = [
    ("SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 2", "easy", True),
    ("SELECT count(*) FROM nation", "SELECT count(n_nationkey) FROM nation", "easy", False),
    ("SELECT n_name, n_regionkey FROM nation", "SELECT n_regionkey, n_name FROM nation", "medium", True),
    ("SELECT DISTINCT n_regionkey FROM nation", "SELECT n_regionkey FROM nation", "easy", True),
    ("SELECT n_name FROM nation ORDER BY n_name LIMIT 1", "SELECT n_name FROM nation ORDER BY n_name LIMIT 5", "medium", True),
    ("SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus", "medium", True),
    ("SELECT c_name FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)", "SELECT c_name FROM customer", "hard", False),
    ("SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus ORDER BY count(*) DESC LIMIT 3", "not sql at all", "hard", False),
    ("SELECT o_orderstatus, count(*) FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus ORDER BY count(*) DESC LIMIT 3", "SELECT o_orderstatus FROM orders", "extra", False),
    ("SELECT c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal NOT BETWEEN 1 AND 2 AND n_regionkey NOT BETWEEN 3 AND 4", "SELECT c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey NOT BETWEEN 3 AND 4 AND c_acctbal NOT BETWEEN 1 AND 2", "extra", True),
    ("SELECT T1.c_name FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey GROUP BY T1.c_custkey", "SELECT T1.c_name FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey GROUP BY T2.o_custkey", "medium", True),
    ("SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier", "hard", True),
]


def _pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, "tpch", g, p) for i, (g, p, _, _) in enumerate(PAIRS)], "id long, db_id string, gold_sql string, pred_sql string")


def _databases(spark: SparkSession, sf_dir: str) -> exact.Databases:
    return exact.Databases([entry_of(Catalog.of_folder(spark, sf_dir, TABLES), "tpch", KEYS)])


@query(_values([(i, h, m) for i, (_, _, h, m) in enumerate(PAIRS)], ["id", "hardness", "exact_match"]))
def e10_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised comparison and hardness; expected by hand."""
    return exact.score_pairs(_pairs(spark), _databases(spark, sf_dir)).select(F.col("id").cast("int"), "hardness", "exact_match")


_BY = {h: [m for _, _, k, m in PAIRS if k == h] for h in ("easy", "medium", "hard", "extra")} | {"all": [m for *_, m in PAIRS]}


@query(f"SELECT hardness, CAST(n AS BIGINT) AS count, round(m, 6) AS exact_match FROM ({_values([(h, len(v), sum(v) / len(v)) for h, v in _BY.items()], ['hardness', 'n', 'm'])})")
def e16_level_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and means by level and of all."""
    return rounded(exact.level_scores(exact.score_pairs(_pairs(spark), _databases(spark, sf_dir))), 6)


#: Traced by hand: (pair, part, gold total, prediction total, score) where a total is not 0; all scores of connectors are 1.
_CLAUSES = [
    *((i, part, n, n, s) for i, n, s in ((0, 1, 1), (1, 1, 0), (2, 2, 1), (3, 1, 1), (4, 1, 1), (5, 2, 1), (6, 1, 1), (9, 1, 1), (10, 1, 1), (11, 1, 1)) for part in ("select", "select(no AGG)")),
    *((i, part, 2, n, 0) for i, n in ((7, 0), (8, 1)) for part in ("select", "select(no AGG)")),
    *((i, part, g, p, s) for i, g, p, s in ((0, 1, 1, 1), (6, 1, 0, 0), (8, 1, 0, 0), (9, 2, 2, 1)) for part in ("where", "where(no OP)")),
    *((i, part, 1, p, p) for i, p in ((5, 1), (7, 0), (8, 0), (10, 1)) for part in ("group", "group(no Having)")),
    *((i, "order", 1, p, p) for i, p in ((4, 1), (7, 0), (8, 0))),
    *((i, "and/or", 1, 1, 1) for i in range(len(PAIRS))),
    (11, "IUEN", 1, 1, 1),
    *((i, "keywords", g, p, s) for i, g, p, s in ((0, 1, 1, 1), (4, 3, 3, 1), (5, 1, 1, 1), (6, 1, 0, 0), (7, 4, 0, 0), (8, 5, 0, 0), (9, 2, 2, 1), (10, 1, 1, 1), (11, 1, 1, 1))),
]
_PARTIAL = f"""WITH c AS ({_values(_CLAUSES, ["id", "part", "g", "p", "s"])}), l AS ({_values([(i, h) for i, (_, _, h, _) in enumerate(PAIRS)], ["id", "hardness"])}),
lv AS (SELECT id, hardness FROM l UNION ALL SELECT id, 'all' FROM l),
m AS (SELECT hardness, part, coalesce(avg(s) FILTER (p > 0), 0.0) AS acc, coalesce(avg(s) FILTER (g > 0), 0.0) AS rec
FROM (SELECT DISTINCT hardness FROM lv) CROSS JOIN (SELECT DISTINCT part FROM c) LEFT JOIN (SELECT * FROM lv JOIN c USING (id)) x USING (hardness, part) GROUP BY 1, 2)
SELECT hardness, part, round(acc, 6) AS acc, round(rec, 6) AS rec, round(CASE WHEN acc = 0 AND rec = 0 THEN 1.0 ELSE 2 * acc * rec / (acc + rec) END, 6) AS f1 FROM m"""


@query(_PARTIAL)
def e17_partial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean clause scores by level and of all."""
    return rounded(exact.partial_level_scores(exact.score_pairs(_pairs(spark), _databases(spark, sf_dir))), 6)


ACCEPTED = [
    ("SELECT count(*) FROM orders", True),
    ("SELECT count(DISTINCT o_custkey) FROM orders", True),
    ("SELECT max(o_totalprice - o_orderkey) FROM orders", True),
    ("SELECT max(o_totalprice) - min(o_totalprice) FROM orders", False),
    ("SELECT o_custkey AS k FROM orders", False),
    ("SELECT T1.c_name FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey", True),
    ("SELECT T1.c_name FROM customer T1 JOIN orders T2 ON T1.c_custkey = T2.o_custkey", False),
    ("SELECT c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey", False),
    ("SELECT c_name FROM customer, orders", False),
    ("SELECT c_name FROM customer WHERE c_acctbal IS NULL", False),
    ("SELECT c_name FROM customer WHERE NOT c_acctbal > 1", False),
    ("SELECT c_name FROM customer WHERE c_nationkey IN (1, 2)", False),
    ("SELECT c_name FROM customer WHERE (c_custkey = 1 OR c_custkey = 2) AND c_nationkey = 3", False),
    ("SELECT c_name FROM customer WHERE c_custkey = c_nationkey OR c_acctbal > 0", True),
    ("SELECT c_name FROM customer ORDER BY c_name DESC, c_acctbal ASC", True),
    ("SELECT c_name FROM customer LIMIT 3 OFFSET 2", True),
    ("SELECT n_name FROM nation UNION ALL SELECT r_name FROM region", False),
    ("SELECT n_name FROM nation UNION SELECT r_name FROM region", True),
    ("SELECT n_name FROM nation WHERE n_name = 'a", False),
]


@query(_values([(s, a) for s, a in ACCEPTED], ["sql", "accepted"]))
def p13_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the subset accepts."""
    names = Catalog.of_folder(spark, sf_dir, TABLES).names
    return spark.createDataFrame([(s, is_valid(s, names)) for s, _ in ACCEPTED], "sql string, accepted boolean")


@query(_values([("select|a|,|\"X y\"|from|t|where|b|>=|3",)], ["tokens"]))
def p01_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("|".join(tokenize("SELECT a , 'X y' FROM t WHERE b > = 3")),)], "tokens string")


EXECUTED = [
    ("SELECT count(*) FROM nation", "SELECT count(*) FROM nation", True),
    ("SELECT count(*) FROM nation", "SELECT count(n_nationkey) FROM nation", False),
    ("SELECT n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_name", "SELECT n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_name", False),
    ("SELECT n_name, n_regionkey FROM nation ORDER BY n_name", "SELECT n_regionkey, n_name FROM nation ORDER BY n_name", True),
    ("SELECT count(*) FROM nation", "SELECT missing_column FROM nation", False),
]


@query(_values([(i, m, i == 4) for i, (_, _, m) in enumerate(EXECUTED)], ["id", "exec_match", "failed"]))
def x06_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both queries run under a deadline, results compared by column."""
    catalog = Catalog.of_folder(spark, sf_dir, TABLES)
    _, details = execution.evaluate(spark, [(g, "tpch") for g, _, _ in EXECUTED], [p for _, p, _ in EXECUTED], {"tpch": catalog}, {"tpch": _databases(spark, sf_dir).keys["tpch"]}, timeout_seconds=60.0, parallel=2)
    return spark.createDataFrame([(d["id"], d["exec_match"], d["error"] is not None) for d in details], "id int, exec_match boolean, failed boolean")


@query("SELECT hardness, count(*) AS count, sum(CAST(same AS BIGINT)) AS matches FROM (" + _values([(level, same) for _, _, level, same in PAIRS], ["hardness", "same"]) + ") GROUP BY hardness")
def s16_streamed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level counts of the pairs, with the streaming operator on a batch."""
    return level_counts(exact.score_pairs(_pairs(spark), _databases(spark, sf_dir)))


# -- scores of pairs made from table values: each order is a pair of structures, each customer a pair of results

#: Places of gold bits that a prediction changes, by o_orderkey % 7; 5 and 6 change none.
_BITS = {"i": "o_orderkey % 4", "w": "o_custkey % 4", "g": "(o_orderkey + o_custkey) % 3", "o": "o_custkey % 3", "u": "o_orderkey % 5 % 2"}
_SIZES = {"i": 4, "w": 4, "g": 3, "o": 3, "u": 2}


def _bits(side: str) -> str:
    changed = lambda k, b, n: f"CASE WHEN o_orderkey % 7 = {n} THEN ({b} + 1) % {_SIZES[k]} ELSE {b} END"
    return ", ".join(f"CAST({b if side == 'g' else changed(k, b, n)} AS INT) AS {side}{k}" for n, (k, b) in enumerate(_BITS.items()))


def _chosen(bit: str, *options: str) -> str:
    return f"CASE {bit} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(options)) + " END"


def _structure(side: str) -> str:
    """Spark SQL for the text of one side."""
    p, t = "CAST(o_totalprice AS STRING)", "o_orderstatus"
    return "concat('SELECT ', " + ", ".join([
        _chosen(f"{side}i", "'o_custkey'", "'o_custkey , o_orderstatus'", "'o_orderstatus , o_custkey'", "'count(*) , o_orderstatus'"), "' FROM orders'",
        _chosen(f"{side}w", "''", f"concat(' WHERE o_totalprice > ', {p})", f"concat(' WHERE o_totalprice > ', {p}, ' AND o_orderstatus = \"', {t}, '\"')", f"concat(' WHERE o_orderstatus = \"', {t}, '\" OR o_totalprice < ', {p})"),
        _chosen(f"{side}g", "''", "' GROUP BY o_orderstatus'", "concat(' GROUP BY o_orderstatus HAVING count(*) > ', CAST(o_custkey AS STRING))"),
        _chosen(f"{side}o", "''", "' ORDER BY o_orderstatus DESC LIMIT 3'", "' ORDER BY o_orderstatus'"),
        _chosen(f"{side}u", "''", "' UNION SELECT c_custkey FROM customer'"),
    ]) + ")"


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, db_id, gold_sql, pred_sql): a pair for every order, with its values as literals."""
    o = spark.sql(f"SELECT *, {_bits('g')}, {_bits('p')} FROM {{orders}}", orders=_table(spark, sf_dir, "orders"))
    return o.selectExpr("o_orderkey AS id", "'tpch' AS db_id", f"{_structure('g')} AS gold_sql", f"{_structure('p')} AS pred_sql")


def _lists(side: str) -> str:
    """DuckDB lists of the elements of each part, from the bits."""
    i, w, g, o, u = (f"{side}{k}" for k in "iwgou")
    parts = {
        "select": _chosen(i, "['c']", "['c', 's']", "['c', 's']", "['n', 's']"),
        "select(no AGG)": _chosen(i, "['c']", "['c', 's']", "['c', 's']", "['*', 's']"),
        "where": _chosen(w, "[]", "['p>']", "['p>', 's=']", "['p<', 's=']"),
        "where(no OP)": _chosen(w, "[]", "['p']", "['p', 's']", "['p', 's']"),
        "group(no Having)": _chosen(g, "[]", "['s']", "['s']"),
        "group": _chosen(g, "[]", "['s']", "['s having']"),
        "order": _chosen(o, "[]", "['desc limit']", "['asc']"),
        "and/or": _chosen(w, "[]", "[]", "['and']", "['or']"),
        "IUEN": _chosen(u, "[]", "['union']"),
        "keywords": "list_concat(" + ", ".join([
            _chosen(f"least({w}, 1)", "[]", "['where']"), _chosen(f"({w} = 3)::INT", "[]", "['or']"), _chosen(g, "[]", "['group']", "['group', 'having']"),
            _chosen(o, "[]", "['order', 'desc', 'limit']", "['order', 'asc']"), _chosen(u, "[]", "['union']"),
        ]) + ")",
    }
    return "[" + ", ".join(f"CAST({x} AS VARCHAR[])" for x in parts.values()) + "]"


_STRUCTURES = f"""WITH b AS (SELECT o_orderkey AS id, {_bits('g')}, {_bits('p')} FROM orders),
c AS (SELECT id, (gw > 0)::INT + (gg > 0)::INT + (go > 0)::INT + (go = 1)::INT + (gw = 3)::INT AS used, (gi > 0)::INT + (gw > 1)::INT AS others, gu AS nested, {_lists('g')} AS g, {_lists('p')} AS p FROM b),
h AS (SELECT id, g, p, CASE WHEN nested = 0 AND used <= 1 AND others = 0 THEN 'easy' WHEN nested = 0 AND (used <= 1 AND others <= 2 OR used <= 2 AND others < 2) THEN 'medium'
  WHEN nested = 0 AND (used <= 2 AND others > 2 OR used = 3 AND others <= 2) THEN 'hard' WHEN nested = 1 AND used <= 1 AND others = 0 THEN 'hard' ELSE 'extra' END AS hardness FROM c),
e AS (SELECT id, hardness, unnest(range(1, 11)) AS k, g, p FROM h),
s AS (SELECT id, hardness, [{', '.join(f"'{x}'" for x in exact.PARTS)}][k] AS part, list_sort(g[k]) = list_sort(p[k]) AS same, len(g[k]) AS gn, len(p[k]) AS pn FROM e)"""
_LEVEL = "SELECT id, hardness, bool_and(same) AS exact_match FROM s GROUP BY id, hardness"


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = _structures(spark, sf_dir)
    known = files.stored(fingerprints.statements_of(pairs, _databases(spark, sf_dir)), "structures")
    return fingerprints.matched(pairs, known), known


@query(f"{_STRUCTURES} {_LEVEL}")
def e10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match of a pair for every order, by equal fingerprints."""
    return _scored(spark, sf_dir)[0].select("id", "hardness", "exact_match")


@query(f"{_STRUCTURES}, m AS ({_LEVEL}), a AS (SELECT hardness, exact_match FROM m UNION ALL SELECT 'all', exact_match FROM m) SELECT hardness, count(*) AS count, round(avg(exact_match::INT), 6) AS exact_match FROM a GROUP BY hardness")
def e16_fingerprint_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and means by level and of all, of a pair for every order."""
    return rounded(exact.level_scores(_scored(spark, sf_dir)[0]), 6)


@query(f"""{_STRUCTURES}, t AS (SELECT hardness, part, same::INT AS score, CASE WHEN part = 'and/or' THEN CASE WHEN same THEN 1 ELSE pn END ELSE gn END AS gold, CASE WHEN part = 'and/or' THEN CASE WHEN same THEN 1 ELSE gn END ELSE pn END AS pred FROM s),
a AS (SELECT * FROM t UNION ALL SELECT 'all', part, score, gold, pred FROM t),
m AS (SELECT hardness, part, coalesce(avg(score) FILTER (pred > 0), 0.0) AS acc, coalesce(avg(score) FILTER (gold > 0), 0.0) AS rec FROM a GROUP BY hardness, part)
SELECT hardness, part, round(acc, 6) AS acc, round(rec, 6) AS rec, round(CASE WHEN acc = 0 AND rec = 0 THEN 1.0 ELSE 2 * acc * rec / (acc + rec) END, 6) AS f1 FROM m""")
def e17_fingerprint_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause scores of all levels in one aggregate."""
    return rounded(fingerprints.partial_scores(*_scored(spark, sf_dir)), 6)


@query(f"{_STRUCTURES} SELECT id, CASE WHEN id % 3 = 0 THEN 'x' || id ELSE 'example-' || id END AS example_id, 'tpch' AS db_id, hardness, bool_and(same) AS exact_match FROM s GROUP BY id, hardness")
def k07_derived_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: the pairs of all orders joined with their scores; a missing id is made from the position."""
    named = F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), F.col("id").cast("string")))
    empty = [F.lit(None).cast("string").alias(c) for c in ("question", "raw_output", "hints")]
    examples = _structures(spark, sf_dir).select("id", named.alias("example_id"), "gold_sql", "pred_sql", *empty)
    return reports.match_report(examples, _scored(spark, sf_dir)[0]).select("id", "example_id", "db_id", "hardness", "exact_match")


@query(f"{_STRUCTURES}, m AS ({_LEVEL}) SELECT hardness, count(*) AS count, CAST(sum(exact_match::INT) AS BIGINT) AS matches FROM m GROUP BY hardness")
def s16_derived_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level counts of the pairs of all orders, with the streaming operator on a batch."""
    return level_counts(_scored(spark, sf_dir)[0])


@query("SELECT o_orderkey AS id, [" + ", ".join(str(a).lower() for _, a in ACCEPTED) + f"][o_orderkey % {len(ACCEPTED)} + 1] AS accepted FROM orders")
def p13_accepted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the subset accepts; each order stands for a text, and each different text is parsed once."""
    texts = F.array(*(F.lit(t) for t, _ in ACCEPTED))
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("tpch").alias("db_id"), F.element_at(texts, (F.col("o_orderkey") % len(ACCEPTED) + 1).cast("int")).alias("sql"))
    known = fingerprints.statements(o.select("db_id", "sql").distinct(), _databases(spark, sf_dir))
    return o.join(known, ["db_id", "sql"]).select("id", F.col("error").isNull().alias("accepted"))


@query("SELECT o_orderkey AS id, o_orderkey % 5 < 4 AS same FROM orders")
def p15_semicolons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semicolons after a statement, and after one in brackets, leave its fingerprint; before it they do not."""
    o = _table(spark, sf_dir, "orders").withColumn("bare", F.concat(F.lit("SELECT count(*) FROM orders WHERE o_custkey > "), F.col("o_custkey").cast("string")))
    tail = F.expr("repeat(';', CAST(o_orderkey % 3 AS INT))")
    marked = F.when(F.col("o_orderkey") % 5 == 4, F.concat(F.lit("; "), "bare")).when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit("( "), "bare", F.lit(" ; )"), tail)).otherwise(F.concat("bare", F.lit(" "), tail))
    pairs = o.select(F.col("o_orderkey").alias("id"), F.lit("tpch").alias("db_id"), F.col("bare").alias("gold_sql"), marked.alias("pred_sql"))
    known = files.stored(fingerprints.statements_of(pairs, _databases(spark, sf_dir)), "structures")
    return fingerprints.matched(pairs, known).select("id", F.col("exact_match").alias("same"))


def _executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, db_id, gold_sql, pred_sql): a pair for every customer, of seven kinds."""
    k, n = "CAST(c_custkey AS STRING)", "CAST(c_nationkey AS STRING)"
    gold = _chosen("kind", f"concat('SELECT count(*) FROM orders WHERE o_custkey = ', {k})", f"concat('SELECT o_orderkey , o_totalprice FROM orders WHERE o_custkey = ', {k}, ' ORDER BY o_totalprice DESC LIMIT 3')", f"concat('SELECT o_orderstatus , count(*) FROM orders WHERE o_custkey = ', {k}, ' GROUP BY o_orderstatus')", f"concat('SELECT c_name FROM customer WHERE c_nationkey = ', {n}, ' AND c_acctbal > ', CAST(c_acctbal AS STRING))", "'SELECT count(*) FROM orders'", f"concat('SELECT o_orderkey FROM orders WHERE o_custkey = ', {k}, ' ORDER BY o_orderkey')", "concat('SELECT c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = ', CAST(c_custkey % 3 AS STRING), ')')")
    pred = _chosen("kind", f"concat('SELECT count(*) FROM customer WHERE c_custkey = ', {k})", f"concat('SELECT o_totalprice , o_orderkey FROM orders WHERE o_custkey = ', {k}, ' ORDER BY o_totalprice LIMIT 3')", f"concat('SELECT count(*) , o_orderstatus FROM orders WHERE o_custkey = ', {k}, ' AND o_totalprice > ', CAST(c_acctbal * 10 AS STRING), ' GROUP BY o_orderstatus')", f"concat('SELECT c_name FROM customer WHERE c_acctbal > ', CAST(c_acctbal AS STRING), ' AND c_nationkey BETWEEN ', {n}, ' AND ', {n})", f"concat('SELECT missing FROM orders WHERE o_custkey = ', {k})", f"concat('SELECT o_orderkey FROM orders WHERE o_custkey = ', {k})", "concat('SELECT T1.c_name FROM customer AS T1 JOIN nation AS T2 ON T1.c_nationkey = T2.n_nationkey WHERE T2.n_regionkey = ', CAST(c_custkey % 3 AS STRING))")
    return _table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "'tpch' AS db_id", "c_custkey % 7 AS kind", "*").selectExpr("id", "db_id", f"{gold} AS gold_sql", f"{pred} AS pred_sql")


@query("""WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey, o_totalprice)[:3] AS high, list(o_orderkey ORDER BY o_totalprice, o_orderkey)[:3] AS low, count(*) AS n, min(o_totalprice) AS least FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS id, c_custkey % 7 AS kind, coalesce(n, 0) AS n, high, low, least, c_acctbal FROM customer LEFT JOIN o ON c_custkey = o_custkey)
SELECT id, CASE kind WHEN 0 THEN n = 1 WHEN 1 THEN n = 0 OR high = low WHEN 2 THEN n = 0 OR least > c_acctbal * 10 WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN n <= 1 ELSE true END AS exec_match, kind = 4 AS failed FROM c""")
def x06_batch_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair for every customer; statements of a template run together, results compared as digests."""
    catalog = Catalog.of_folder(spark, sf_dir, TABLES)
    details = batches.evaluate_pairs(spark, _executed(spark, sf_dir), {"tpch": catalog}, {"tpch": _databases(spark, sf_dir).keys["tpch"]}, timeout_seconds=600.0)
    return details.select("id", "exec_match", F.col("error").isNotNull().alias("failed"))


# -- prompts and reports

_SCHEMA_TEXT = "Database: concert\n\nTable: singer\n  - Singer_ID (number)\n  - Name (text)\n  - Country (text)\n\nTable: concert\n  - Concert_ID (number)\n  - Venue (text)\n\nTable: singer_in_concert\n  - Singer_ID (number)\n  - Concert_ID (number)\n\nTable: Ref_Template_Types\n  - Template_Type_ID (number)\n  - Template_Type_Description (text)\n\nForeign Keys:\n  - singer_in_concert.Singer_ID -> singer.Singer_ID\n  - singer_in_concert.Concert_ID -> concert.Concert_ID"


@query(_values([("concert", _SCHEMA_TEXT)], ["db_id", "schema_text"]))
def k01_schema_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.schema_texts(schema.from_python(spark, [CONCERT]))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"SELECT conv_id, turn, {_sql_text(prompts.OPENING + _SCHEMA_TEXT)} || chr(10) || chr(10) || 'Question: ' || text || {_sql_text(prompts.CLOSING)} AS prompt FROM conversations")
def k03_base_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3: every turn as a question."""
    q = _table(spark, sf_dir, "conversations")
    texts = schema.schema_texts(schema.from_python(spark, [CONCERT]))
    return q.crossJoin(F.broadcast(texts)).select("conv_id", "turn", prompts.prompt(F.col("text"), F.col("schema_text")).alias("prompt"))


@query(f"SELECT conv_id, turn, {_sql_text(prompts.OPENING + 'About' + chr(10) + chr(10) + _SCHEMA_TEXT + chr(10) + prompts.HINTS_HEAD)} || '  - \"' || role || '\" → singer.Name' || chr(10) || '  - \"x\" → table: concert' || chr(10) || chr(10) || 'Question: ' || text || {_sql_text(prompts.CLOSING)} AS prompt FROM conversations")
def k04_augmented_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _table(spark, sf_dir, "conversations")
    texts = schema.schema_texts(schema.from_python(spark, [CONCERT]))
    hint = lambda noun, table, column: F.struct(noun.alias("vi_noun"), F.lit(table).alias("table"), F.lit(column).cast("string").alias("column"))
    hints = F.array(hint(F.col("role"), "singer", "Name"), hint(F.lit("x"), "concert", None))
    return q.crossJoin(F.broadcast(texts)).select("conv_id", "turn", prompts.prompt(F.col("text"), F.col("schema_text"), F.lit(" About "), hints).alias("prompt"))


@query(f"SELECT conv_id, turn, 'system' AS first_role, {_sql_text(prompts.SYSTEM)} AS first_content, text AS second_content FROM conversations")
def k06_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.messages(F.col("text")).alias("m"))
    return m.select("conv_id", "turn", F.col("m")[0]["role"].alias("first_role"), F.col("m")[0]["content"].alias("first_content"), F.col("m")[1]["content"].alias("second_content"))


def _by_size(model: str):
    return lambda chats: [f"SELECT {len(chat[-1]['content'])}" for chat in chats]


@query("SELECT conv_id * 1000 + turn AS id, 'SELECT ' || length(any_value(text)) AS answer FROM conversations WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) = 1")
def k06_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: answers to all turns, of a generator that tells their length; in batches of like length."""
    turns = _table(spark, sf_dir, "conversations").filter("text IS NOT NULL").groupBy((F.col("conv_id") * 1000 + F.col("turn")).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text")).filter("n = 1")
    path = f"{files.scratch(spark)}/answers-{uuid.uuid4().hex}"
    return generation.generate(turns.select("id", prompts.messages(F.col("text")).alias("messages")), path, "by-size", _by_size, rounds=2)


_RUNS = "SELECT {k} AS model, count(*) AS n, round(avg(quality), 6) AS em, round(avg(toxic), 6) AS ex FROM labels JOIN documents USING (doc_id) GROUP BY 1"


def _runs(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    j = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return j.groupBy(F.expr(key).alias("model")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("em"), F.round(F.avg("toxic"), 6).alias("ex"))


_EN = "CASE WHEN lang = 'en' THEN source ELSE concat('other-', source) END"


@query(f"SELECT a.model, a.n, a.em, a.ex, round(a.em - b.em, 6) AS d_em, round(a.ex - b.ex, 6) AS d_ex FROM ({_RUNS.format(k='source')}) a LEFT JOIN ({_RUNS.format(k=_EN)}) b USING (model)")
def k09_delta_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.delta_table(_runs(spark, sf_dir, _EN), _runs(spark, sf_dir, "source")), 6)


@query(f"SELECT model, n, em, ex FROM ({_RUNS.format(k='source')}) ORDER BY ex DESC, em DESC, model LIMIT 1")
def k10_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_run(_runs(spark, sf_dir, "source"), "ex", "em")


@query(_values([(i, f"example-{i}" if i % 2 else f"x{i}", "tpch", h, m) for i, (_, _, h, m) in enumerate(PAIRS)], ["id", "example_id", "db_id", "hardness", "exact_match"]))
def k07_match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: examples joined with their scores; a missing id is made from the position."""
    pairs = _pairs(spark)
    named = F.when(F.col("id") % 2 == 0, F.concat(F.lit("x"), F.col("id").cast("string")))
    empty = [F.lit(None).cast("string").alias(c) for c in ("question", "raw_output", "hints")]
    examples = pairs.select("id", named.alias("example_id"), "gold_sql", "pred_sql", *empty)
    report = reports.match_report(examples, exact.score_pairs(pairs, _databases(spark, sf_dir)))
    return report.select(F.col("id").cast("int"), "example_id", "db_id", "hardness", "exact_match")


@query("SELECT count(*) AS count, count(*) FILTER (quality = 1) AS matches, count(*) FILTER (toxic = 1) AS errors, count(*) FILTER (doc_id % 7 = 0) AS timeouts, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS execution_accuracy FROM labels")
def k08_execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: one row of all details; each label stands for one."""
    details = _table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("exec_match"), F.when(F.col("toxic") == 1, "failed").alias("error"), (F.col("doc_id") % 7 == 0).alias("timeout"))
    return rounded(reports.execution_summary(details), 6)


# -- files, written to the shared folder and read again

def _nations(spark: SparkSession, sf_dir: str) -> list:
    return _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()


@query("SELECT n_nationkey AS idx, n_name AS question, n_regionkey AS region FROM nation")
def s01_json_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples as one JSON array, read as rows."""
    path = f"{files.scratch(spark)}/files/examples_dev.json"
    files.write_json(spark, path, [{"idx": r.n_nationkey, "question": r.n_name, "region": r.n_regionkey} for r in _nations(spark, sf_dir)])
    return files.json_rows(spark, path, "idx int, question string, region int")


@query("SELECT n_nationkey AS idx, 'SELECT ' || chr(9) || n_name AS sql, 'db' || n_regionkey AS db_id FROM nation")
def s04_gold_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gold file of a folder of splits; blank lines have no number, and the last tab parts."""
    root = f"{files.scratch(spark)}/files"
    files.write_lines(spark, f"{root}/train_gold.sql", [x for r in _nations(spark, sf_dir) for x in (f"SELECT \t{r.n_name}\tdb{r.n_regionkey}", " ")])
    return files.Datasets.of_folder(spark, root).load_gold("examples", "train").select(F.col("idx").cast("int"), "sql", "db_id")


@query("SELECT n_nationkey AS idx, CASE WHEN n_regionkey = 1 THEN '' ELSE n_name END AS sql FROM nation WHERE n_nationkey < 20")
def s05_predictions_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction a line, blank ones too; the first 20."""
    path = f"{files.scratch(spark)}/files/predicted.txt"
    files.write_lines(spark, path, ["" if r.n_regionkey == 1 else r.n_name for r in _nations(spark, sf_dir)])
    return files.head(files.predictions(spark, path), 20).select(F.col("idx").cast("int"), "sql")


@query("SELECT n_nationkey AS example_idx, n_name AS vi_noun, 't' || n_regionkey AS table_name, n_nationkey / 32 AS similarity FROM nation WHERE n_regionkey > 0")
def s12_hints_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints by position, checked against the examples; an example may have none."""
    path, rows = f"{files.scratch(spark)}/files/hints.json", _nations(spark, sf_dir)
    hint = lambda r: {"vi_noun": r.n_name, "table": f"t{r.n_regionkey}", "column": None, "similarity": r.n_nationkey / 32, "table_type": "entity"}
    files.write_json(spark, path, [{"index": r.n_nationkey, "db_id": "tpch", "question_vi": r.n_name, "hints": [hint(r)] if r.n_regionkey else []} for r in rows])
    read = files.hints(spark, path, _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("example_idx")))
    return read.select(F.col("example_idx").cast("int"), F.explode("hints").alias("h")).select("example_idx", "h.vi_noun", F.col("h.table").alias("table_name"), "h.similarity")


# -- the same for files of many parts, which tasks write and read

def _folder(spark: SparkSession, name: str) -> str:
    return f"{files.scratch(spark)}/files/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey AS idx, o_orderpriority AS question, o_custkey AS region FROM orders")
def s01_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of all orders as JSON objects, one a line, in as many files as tasks."""
    path = _folder(spark, "examples")
    _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("question"), F.col("o_custkey").alias("region")).write.json(path)
    return files.json_rows(spark, path, "idx long, question string, region long", lines=True)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, 'SELECT' || chr(9) || o_orderkey AS sql, 'db' || o_custkey % 5 AS db_id FROM orders WHERE o_orderkey % 3 > 0")
def s04_gold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gold folder of all orders; every third line is blank and has no number, and the last tab parts."""
    path, o = _folder(spark, "gold"), _table(spark, sf_dir, "orders")
    line = F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.concat(F.lit("SELECT\t"), F.col("o_orderkey").cast("string"), F.lit("\tdb"), (F.col("o_custkey") % 5).cast("string")))
    files.write_lines_of(o, path, line, F.col("o_orderkey"))
    return files.Datasets(spark, {}, {("orders", "dev"): path}).load_gold("orders", "dev")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'SELECT ' || o_custkey END AS sql FROM orders QUALIFY idx < 1000")
def s05_predictions_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction a line for all orders, blank ones too; the first 1000 by position."""
    path = _folder(spark, "predicted")
    files.write_lines_of(_table(spark, sf_dir, "orders"), path, F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("SELECT "), F.col("o_custkey").cast("string"))), F.col("o_orderkey"))
    return files.head(files.predictions(spark, path), 1000)


@query("SELECT c_custkey AS example_idx, c_name AS vi_noun, 't' || c_nationkey AS table_name, c_custkey / 32 AS similarity FROM customer WHERE c_nationkey > 3")
def s12_hints_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints of all customers, checked against them; an example may have none."""
    path, c = _folder(spark, "hints"), _table(spark, sf_dir, "customer")
    hint = F.struct(F.col("c_name").alias("vi_noun"), F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("table"), F.lit(None).cast("string").alias("column"), (F.col("c_custkey") / 32).alias("similarity"), F.lit("entity").alias("table_type"))
    own = F.when(F.col("c_nationkey") > 3, F.array(hint)).otherwise(F.array().cast(f"array<{matching.HINT}>"))
    c.select(F.col("c_custkey").alias("index"), F.lit("tpch").alias("db_id"), F.col("c_name").alias("question_vi"), own.alias("hints")).write.json(path)
    read = files.hints(spark, path, c.select(F.col("c_custkey").alias("example_idx")), lines=True)
    return read.select("example_idx", F.explode("hints").alias("h")).select("example_idx", "h.vi_noun", F.col("h.table").alias("table_name"), "h.similarity")


# -- encoding, with an encoder whose vectors tell the length of what it was given

def _by_length(model: str):
    return lambda texts: [[3.0, 4.0] if len(t) % 2 else [4.0, 3.0] for t in texts]


@query("SELECT text, CASE WHEN (length(text) + 9) % 2 = 1 THEN 0.6 ELSE 0.8 END::DOUBLE AS x, CASE WHEN (length(text) + 9) % 2 = 1 THEN 0.8 ELSE 0.6 END::DOUBLE AS y FROM (SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL)")
def h03_encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1-H3, H7: different texts with the documents' prefix, as unit vectors."""
    e = matching.encode_texts(_table(spark, sf_dir, "conversations"), "by-length", _by_length, matching.document_prefix("by-length"), kind="document")
    part = lambda i: F.round(F.col("embedding")[i].cast("double"), 4)
    return e.select("text", part(0).alias("x"), part(1).alias("y"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the pairs by level, after both queries of each were parsed and compared."""
    assert parse("SELECT count(*) FROM orders", Catalog.of_folder(spark, sf_dir, TABLES).names)
    return e16_level_scores(spark, sf_dir)
