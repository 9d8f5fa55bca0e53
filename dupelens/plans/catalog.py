"""The registered queries over the driver's tables, and the same in SQL.

Documents stand for files (``sources.inventory.from_documents``); small stated tables stand for links, bins and
journals. Partial hashes use 16 bytes, so that some files differ only beyond them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import cache as C
from ..operators import dedup as D
from ..operators import diff, filters, select, similar, stats, sweep
from ..session import write_once
from ..sources import inventory as I
from . import actions, journal, report

PARTIAL = 16
TURBO = D.Criteria(partial=PARTIAL)
SHOWN = ("group_key", "block_ord", "group_ord", "member_ord", "path", "size", "modified", "category", "hash")
PATTERNS = ["*.tmp", "src3", "/src5/de", "doc_1?.*", " ", "[!a-z]*.BAK"]
PRIORITIES = ["/src1", "/src2/", "/SRC7/en"]
NOW = 40_000_000.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.from_documents(_table(spark, sf_dir, "documents"))


def _query(sql: str | None = None, name: str | None = None):
    def register(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE_SQL[name or fn.__name__] = sql
        return fn

    return register


# ---- SQL pieces: the inventory and what is built on it ----

_EXTS = ", ".join(f"'{e}'" for e in I.EXTENSIONS)
_CASE = " ".join(f"WHEN substr(ext, 2) IN ({', '.join(repr(e) for e in v.split())}) THEN '{k}'" for k, v in X.CATEGORIES.items())
_INV = rf"""
raw AS (
  SELECT doc_id, text, source, lang, strlen(text)::BIGINT AS size FROM documents
), named AS (
  SELECT *, CASE WHEN doc_id % 5 = 0 THEN upper(plain) ELSE plain END AS name FROM (
    SELECT *, 'doc_' || (CASE WHEN doc_id % 4 = 0 THEN doc_id % 200 ELSE size % 97 END) || [{_EXTS}][(size % 12 + 1)::INT] AS plain FROM raw)
), inv AS (
  SELECT *, CASE {_CASE} ELSE 'other' END AS category FROM (
    SELECT '/' || source || '/' || lang || '/' || doc_id || '/' || name AS path, name, size, doc_id::DOUBLE AS created, (doc_id * 7919 % 86400)::DOUBLE AS modified,
      1::BIGINT AS dev, (CASE WHEN doc_id % 101 = 0 THEN 0 WHEN doc_id % 50 = 49 THEN doc_id ELSE doc_id + 1 END)::BIGINT AS ino, doc_id AS walk_ord, text,
      regexp_extract(lower(name), '(?s)^\.*[^.].*(\.[^.]*)$', 1) AS ext, doc_id FROM named)
)"""
_SCAN = """, scan AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN ino <> 0 THEN dev END, CASE WHEN ino <> 0 THEN ino END, CASE WHEN ino = 0 THEN path END ORDER BY walk_ord) AS rn
    FROM inv WHERE size > 0) WHERE rn = 1
)"""
_QUICK = f"""md5(encode(text)[1:{PARTIAL}] || (CASE WHEN size > {2 * PARTIAL} THEN encode(text)[size - {PARTIAL - 1}:size] ELSE ''::BLOB END) || encode(size::VARCHAR))"""


def _human(size: str) -> str:
    unit = lambda p: f"printf('%.2f', round_even({size} * 100.0::DOUBLE / {1024**p}, 0) / 100)"
    return f"CASE WHEN {size} < 1024 THEN {size} || ' B' WHEN {size} < 1048576 THEN {unit(1)} || ' KB' WHEN {size} < 1073741824 THEN {unit(2)} || ' MB' ELSE {unit(3)} || ' GB' END"


def _members(keys: list[str], key_text: str, name: str = "members", rows: str = "scan", order: str = "modified, walk_ord", hash_: str = "NULL::VARCHAR", block: str = "min(walk_ord) OVER (PARTITION BY size)") -> str:
    by = f"PARTITION BY {', '.join(keys)}"
    return f""", {name} AS (
  SELECT * FROM (SELECT *, {key_text} AS group_key, {hash_} AS hash, {block} AS block_ord, count(*) OVER ({by}) AS n,
    min(walk_ord) OVER ({by}) AS group_ord, row_number() OVER ({by} ORDER BY {order}) - 1 AS member_ord FROM {rows}) WHERE n > 1
)"""


_COLS = ", ".join(SHOWN)
_PROVED = f""", quick AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY size, q) AS nq FROM (SELECT *, {_QUICK} AS q, min(walk_ord) OVER (PARTITION BY size) AS block FROM scan)) WHERE nq > 1
)""" + _members(["size", "sha256(text)"], "size || '|' || sha256(text)", rows="quick", hash_="sha256(text)", block="block")
#: WITH ... members AS (verified duplicates): the base of all queries on groups.
_BASE = "WITH " + _INV + _SCAN + _PROVED


def _turbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.find_duplicates(_inv(spark, sf_dir), TURBO)


def _picked(members: DataFrame) -> DataFrame:
    """A stated selection: documents of certain ids."""
    return members.filter("walk_ord % 3 <> 1").select("path")


_PICKED = ", picked AS (SELECT path FROM members WHERE walk_ord % 3 <> 1)"

# ---- projections and filters ----


@_query(f"""WITH {_INV}, p AS (SELECT *, string_split(trim(path, '/'), '/') AS parts FROM inv)
SELECT path, name, size, ext, category, {_human('size')} AS human,
  CASE WHEN length(path) <= 20 THEN path WHEN len(parts) <= 2 THEN path[1:10] || '...' || path[-10:] ELSE '/' || parts[1] || '/.../' || parts[-1] END AS short FROM p""")
def inventory_projection(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return inv.select("path", "name", "size", "ext", "category", X.human_size(F.col("size")).alias("human"), X.short_path(F.col("path"), 20).alias("short"))


@_query(f"""WITH {_INV}, p AS (SELECT *, list_filter(string_split(lower(path), '/'), lambda x: x <> '') AS parts FROM inv)
SELECT path, size FROM p WHERE NOT (
  len(list_filter(parts, lambda x: regexp_full_match(x, '.*\\.tmp') OR x = 'src3' OR regexp_full_match(x, 'doc_1.\\..*') OR regexp_full_match(x, '[^a-z].*\\.bak'))) > 0
  OR lower(path) = '/src5/de' OR starts_with(lower(path), '/src5/de/'))""")
def exclude_patterns(spark, sf_dir):
    return filters.exclude(_inv(spark, sf_dir), PATTERNS).select("path", "size")


_LARGE = """, spot AS (SELECT path, size, regexp_extract(path, '^/[^/]*') AS f1, regexp_extract(path, '^/[^/]*/[^/]*') AS f2, regexp_extract(path, '^/[^/]*/[^/]*/[^/]*') AS f3 FROM inv),
folders AS (SELECT 1 AS depth, f1 AS prefix, sum(size) AS bytes FROM spot GROUP BY f1 UNION ALL SELECT 2, f2, sum(size) FROM spot GROUP BY f2 UNION ALL SELECT 3, f3, sum(size) FROM spot GROUP BY f3),
large AS (SELECT lower(prefix) AS prefix FROM folders JOIN (SELECT depth, sum(bytes) AS total, count(*) AS n FROM folders WHERE prefix IS NOT NULL GROUP BY depth) USING (depth) WHERE bytes * n > total),
placed AS (SELECT path, size, coalesce(c.prefix, b.prefix, a.prefix) AS prefix FROM spot
  LEFT JOIN large a ON a.prefix = lower(f1) LEFT JOIN large b ON b.prefix = lower(f2) LEFT JOIN large c ON c.prefix = lower(f3))"""


def _large_folders(inv: DataFrame) -> DataFrame:
    """A table of folders that grows with the inventory: those of more bytes than the mean of their depth."""
    above = X.ancestors(F.col("path"))
    folders = inv.select("size", F.posexplode(F.slice(above, F.lit(1), F.size(above) - 1)).alias("depth", "prefix")).filter("depth > 0").groupBy("depth", "prefix").agg(F.sum("size").alias("bytes"))
    folders = write_once(folders, "sizes")
    depths = folders.groupBy("depth").agg(F.sum("bytes").alias("total"), F.count(F.lit(1)).alias("n"))  # a row a depth
    return folders.join(F.broadcast(depths), "depth").filter("bytes * n > total").select("prefix")


@_query(f"WITH {_INV}{_LARGE} SELECT path, prefix FROM placed")
def longest_prefix(spark, sf_dir):
    inv = write_once(_inv(spark, sf_dir).select("path", "size"), "inventory")  # the texts are read once
    return filters.longest_prefix(inv, _large_folders(inv)).select("path", "prefix")


@_query(f"WITH {_INV}{_LARGE} SELECT path, size FROM placed WHERE prefix IS NULL")
def exclude_folder_table(spark, sf_dir):
    inv = write_once(_inv(spark, sf_dir).select("path", "size"), "inventory")
    return filters.exclude_under(inv, _large_folders(inv)).select("path", "size")


@_query(f"WITH {_INV} SELECT path, size FROM inv WHERE size BETWEEN 1024 AND 8192")
def size_range_filter(spark, sf_dir):
    return filters.size_range(_inv(spark, sf_dir), *filters.kb_range(1, 8)).select("path", "size")


_SYS = "'/' || ['Windows', 'home', 'data/System32', 'bootcamp', 'Program Files', 'c:/ProgramData', 'D:/games'][(doc_id % 7 + 1)::INT] || path"


@_query(f"""WITH {_INV}, p AS (SELECT path, ltrim({_SYS}, '/') AS sys FROM inv),
q AS (SELECT path, sys, list_filter(string_split(lower(sys), '/'), lambda x: x <> '' AND NOT regexp_full_match(x, '[a-z]:')) AS c FROM p)
SELECT path, c[1] IN ({', '.join(repr(x) for x in filters.SYSTEM_TOP)}) OR list_has_any(c, {list(filters.SYSTEM_ANYWHERE)!r})
  OR starts_with(lower(sys), 'c:/windows/') OR starts_with(lower(sys), 'c:/program files/') OR starts_with(lower(sys), 'c:/program files (x86)/') OR starts_with(lower(sys), 'c:/programdata/') AS is_system FROM q""")
def system_path_flag(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    tops = F.array(*map(F.lit, ("Windows", "home", "data/System32", "bootcamp", "Program Files", "c:/ProgramData", "D:/games")))
    where = F.concat(F.element_at(tops, (F.col("walk_ord") % 7 + 1).cast("int")), F.col("path"))
    return inv.select("path", filters.is_system_path(where).alias("is_system"))


@_query(f"WITH {_INV}{_SCAN} SELECT path, dev, ino, walk_ord FROM scan")
def physical_dedup(spark, sf_dir):
    return D.scanned(_inv(spark, sf_dir), TURBO).select("path", "dev", "ino", "walk_ord")


@_query(f"""WITH {_INV} SELECT path, size FROM inv WHERE len(list_filter(string_split(lower(path), '/'), lambda x: x IN ('src9', 'src11'))) = 0""")
def pruned_scan(spark, sf_dir):
    """Two sources stand for never-entered folders."""
    inv = _inv(spark, sf_dir)
    path = F.regexp_replace(F.regexp_replace("path", "^/src9/", r"/\$Recycle.Bin/"), "^/src11/", "/System Volume Information/")
    return filters.prune(inv.withColumn("_path", F.col("path")).withColumn("path", path)).select(F.col("_path").alias("path"), "size")


@_query(f"""WITH {_INV} SELECT path, ext, size FROM inv WHERE ext IN {filters.JUNK_EXTENSIONS!r}""")
def junk_files(spark, sf_dir):
    return filters.junk_files(_inv(spark, sf_dir)).select("path", "ext", "size")


@_query(f"""WITH {_INV} SELECT path, size FROM inv WHERE ext IN ('.tmp', '.log', '.old', '.dmp', '.gid', '.chk', '.bak') AND size <= {filters.JUNK_LIMIT} AND ext NOT IN {filters.KEPT_JUNK!r}""")
def junk_preselect(spark, sf_dir):
    return filters.junk_preselected(filters.junk_files(_inv(spark, sf_dir))).select("path", "size")


@_query(f"""WITH {_INV} SELECT path, contains(encode(text)[1:1024]::VARCHAR, 'zz') AS has_zz, length(regexp_extract(path, '^/(src[0-9]+)/', 1)) AS n FROM inv""", "content_probe")
def content_probe(spark, sf_dir):
    """A byte search in the head of a content, as the binary test does it."""
    inv = _inv(spark, sf_dir)
    head = F.contains(F.substring("content", 1, 1024), F.lit(b"zz"))
    return inv.select("path", head.alias("has_zz"), F.length(F.regexp_extract("path", "^/(src[0-9]+)/", 1)).cast("long").alias("n"))


# ---- blocking and duplicates ----


@_query(f"WITH {_INV}{_SCAN} SELECT path, size, min(walk_ord) OVER (PARTITION BY size) AS block_ord FROM scan QUALIFY count(*) OVER (PARTITION BY size) > 1")
def size_candidates(spark, sf_dir):
    return D.size_candidates(D.scanned(_inv(spark, sf_dir), TURBO)).select("path", "size", "block_ord")


@_query(f"WITH {_INV}{_SCAN} SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS files FROM (SELECT count(*) AS n FROM scan GROUP BY size HAVING count(*) > 1)")
def candidate_stats(spark, sf_dir):
    return D.candidate_stats(D.scanned(_inv(spark, sf_dir), TURBO))


@_query(f"WITH {_INV}{_SCAN} SELECT 1::BIGINT AS groups, count(*)::BIGINT AS files FROM scan")
def candidate_stats_unblocked(spark, sf_dir):
    return D.candidate_stats(D.scanned(_inv(spark, sf_dir), TURBO), by_size=False)


@_query(f"WITH {_INV}{_SCAN} SELECT size, {_QUICK} AS hash, count(*) AS files FROM scan GROUP BY ALL HAVING count(*) > 1")
def dup_turbo_candidates(spark, sf_dir):
    return D.turbo_candidates(_inv(spark, sf_dir), TURBO)


def _criteria(name: str, criteria: D.Criteria, members_sql: str) -> None:
    def run(spark, sf_dir, c=criteria):
        return D.find_duplicates(_inv(spark, sf_dir), c).select(*SHOWN)

    _query(f"WITH {_INV}{_SCAN}{members_sql} SELECT {_COLS} FROM members", name)(run)


_FULL = "sha256(text)"
_NONE = "0::BIGINT"
_criteria("dup_turbo_verified", TURBO, _PROVED)
_criteria("dup_size_only", D.Criteria(by_hash=False), _members(["size"], "size::VARCHAR", order="walk_ord"))
_criteria("dup_name_only", D.Criteria(by_name=True, by_size=False, by_hash=False), _members(["lower(name)"], "lower(name)", block=_NONE))
_criteria("dup_name_size", D.Criteria(by_name=True, by_hash=False), _members(["size", "lower(name)"], "size || '|' || lower(name)"))
_criteria("dup_full_hash", D.Criteria(turbo=False), _members(["size", _FULL], f"size || '|' || {_FULL}", hash_=_FULL))
_criteria("dup_hash_unblocked", D.Criteria(by_size=False, turbo=False), _members([_FULL], _FULL, hash_=_FULL, block=_NONE))
_criteria("dup_name_hash_unblocked", D.Criteria(by_name=True, by_size=False, turbo=False), _members(["lower(name)", _FULL], f"lower(name) || '|' || {_FULL}", hash_=_FULL, block=_NONE))
_criteria("dup_name_size_hash", D.Criteria(by_name=True, turbo=False), _members(["size", "lower(name)", _FULL], f"size || '|' || lower(name) || '|' || {_FULL}", hash_=_FULL))
_criteria("dup_name_turbo", D.Criteria(by_name=True, partial=PARTIAL), _members(["size", "lower(name)", _FULL], f"lower(name) || '|' || size || '|' || {_FULL}", hash_=_FULL))
_criteria("dup_paranoid", D.PRESETS["paranoid"], _members(["size", _FULL], f"size || '|' || {_FULL}", hash_=_FULL))


def _split(keys: list[str], key_text: str, block: str = "min(walk_ord) OVER (PARTITION BY size)") -> str:
    part = f"dense_rank() OVER ({'PARTITION BY ' + ', '.join(keys) if keys else ''} ORDER BY group_ord) - 1"
    return _members([*dict.fromkeys([*keys, "size", "text"])], key_text, "parts", block=block) + f""", members AS (SELECT * REPLACE (group_key || '_b' || ({part}) AS group_key) FROM parts)"""


_criteria("dup_byte_only", D.Criteria(by_size=False, by_hash=False, by_byte=True), _split([], "''", _NONE))
_criteria("dup_size_byte", D.Criteria(by_hash=False, by_byte=True), _split(["size"], "size::VARCHAR"))
_criteria("dup_name_byte", D.Criteria(by_name=True, by_size=False, by_hash=False, by_byte=True), _split(["lower(name)"], "lower(name)", _NONE))
_criteria("dup_filtered", D.Criteria(turbo=False, exclude=("src1", "*.jpg"), min_size=300, max_size=20_000), """, kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN ino <> 0 THEN ino END, CASE WHEN ino = 0 THEN path END ORDER BY walk_ord) AS rk FROM inv
    WHERE size BETWEEN 300 AND 20000 AND NOT starts_with(path, '/src1/') AND lower(name) NOT LIKE '%.jpg') WHERE rk = 1)""" + _members(["size", _FULL], f"size || '|' || {_FULL}", hash_=_FULL, rows="kept"))


@_query(f"WITH {_members(['size', 'sha256(html)'], "size || '|' || sha256(html)", rows='(SELECT *, strlen(html)::BIGINT AS size, page_id AS walk_ord, page_id::DOUBLE AS modified FROM pages WHERE strlen(html) > 0)')[2:]} SELECT group_key, member_ord, url AS path FROM members")
def dup_pages(spark, sf_dir):
    """Pages of equal html, whatever their urls."""
    return D.find_duplicates(I.from_pages(_table(spark, sf_dir, "pages")), TURBO).select("group_key", "member_ord", "path")


@_query(_BASE + """ SELECT group_key, count(*) AS files, string_agg(path, chr(10) ORDER BY member_ord) AS paths FROM members GROUP BY group_key""")
def nested_groups(spark, sf_dir):
    g = D.nested(_turbo(spark, sf_dir))
    return g.select("group_key", F.size("files").cast("long").alias("files"), F.array_join("files.path", "\n").alias("paths"))


def _sample(inv: DataFrame) -> DataFrame:
    """The member of least walk position in the largest group of equal contents."""
    big = D.find_duplicates(inv, D.Criteria(turbo=False)).groupBy("group_ord").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "group_ord").limit(1)
    return inv.join(F.broadcast(big.select(F.col("group_ord").alias("walk_ord"))), "walk_ord")  # one row


_SAMPLE = _members(["size", _FULL], "''", hash_=_FULL) + """, s AS (SELECT inv.* FROM inv JOIN (SELECT group_ord FROM members GROUP BY group_ord ORDER BY count(*) DESC, group_ord LIMIT 1) g ON inv.walk_ord = g.group_ord)"""


@_query(f"WITH {_INV}{_SCAN}{_SAMPLE} SELECT i.path, i.size, sha256(i.text) AS hash FROM inv i, s WHERE i.text = s.text AND i.path <> s.path AND (i.ino = 0 OR i.ino <> s.ino)")
def sample_search(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return D.find_copies(inv, _sample(inv)).select("path", "size", "hash")


@_query(f"WITH {_INV}{_SCAN}{_SAMPLE} SELECT i.path, i.size FROM inv i, s WHERE lower(i.name) = lower(s.name) AND i.path <> s.path AND (i.ino = 0 OR i.ino <> s.ino)")
def sample_by_name(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return D.find_copies(inv, _sample(inv), D.Criteria(by_name=True, by_size=False, by_hash=False)).select("path", "size")


# ---- totals ----


@_query(_BASE + " SELECT group_key, count(*) AS n, coalesce(sum(size) FILTER (member_ord > 0), 0)::BIGINT AS wasted FROM members GROUP BY group_key")
def group_wasted(spark, sf_dir):
    return stats.group_wasted(_turbo(spark, sf_dir))


@_query(_BASE + " SELECT count(DISTINCT group_key) AS groups, (count(*) - count(DISTINCT group_key))::BIGINT AS surplus, coalesce(sum(size) FILTER (member_ord > 0), 0)::BIGINT AS wasted FROM members")
def wasted_totals(spark, sf_dir):
    return stats.wasted_totals(_turbo(spark, sf_dir))


_HEADS = ", g AS (SELECT group_key, any_value(category) FILTER (member_ord = 0) AS category, sum(size) FILTER (member_ord > 0) AS wasted FROM members GROUP BY group_key)"


@_query(_BASE + _HEADS + " SELECT coalesce(category, 'all') AS category, count(*) AS groups, sum(wasted)::BIGINT AS wasted FROM g GROUP BY GROUPING SETS ((category), ())")
def category_rollup(spark, sf_dir):
    return stats.category_rollup(_turbo(spark, sf_dir))


@_query(_BASE + _HEADS + " SELECT category, sum(wasted)::BIGINT AS wasted, round(100.0::DOUBLE * sum(wasted) / sum(sum(wasted)) OVER (), 4) AS share FROM g GROUP BY category")
def category_share(spark, sf_dir):
    return stats.category_share(_turbo(spark, sf_dir))


@_query(_BASE + _PICKED + " SELECT count(*) AS files, sum(size)::BIGINT AS bytes FROM members WHERE path IN (FROM picked)")
def selected_kpi(spark, sf_dir):
    m = _turbo(spark, sf_dir)
    return stats.selected_kpi(m, _picked(m))


# ---- keep rules ----


def _rule(name: str, rule: str, removed: str, **options) -> None:
    def run(spark, sf_dir, rule=rule, options=options):
        return select.select_members(_turbo(spark, sf_dir), rule, **options).select("path")

    sql = _BASE + f""", chosen AS (SELECT *, {removed} AS gone FROM members)
SELECT path FROM (SELECT *, bool_and(gone) OVER (PARTITION BY group_key) AS lost FROM chosen) WHERE gone AND NOT (lost AND member_ord = 0)"""
    _query(sql, name)(run)


_nth = lambda order: f"row_number() OVER (PARTITION BY group_key ORDER BY {order}, member_ord) > 1"
_IS_PRI = "(starts_with(lower(path), '/src1/') OR starts_with(lower(path), '/src2/') OR starts_with(lower(path), '/src7/en/'))"
_rule("keep_first", "first", "member_ord > 0")
_rule("keep_last", "last", "member_ord < max(member_ord) OVER (PARTITION BY group_key)")
_rule("keep_newest", "newest", _nth("modified DESC"))
_rule("keep_oldest", "oldest", _nth("modified"))
_rule("keep_shortest", "shortest", _nth("length(path)"))
_rule("keep_priority", "priority", f"CASE WHEN bool_or({_IS_PRI}) OVER (PARTITION BY group_key) THEN NOT {_IS_PRI} ELSE member_ord > 0 END", priorities=PRIORITIES)
_rule("keep_all_protected", "all", "true")
_rule("keep_none", "none", "false")


@_query(_BASE + f""", chosen AS (SELECT *, {_nth('pixels DESC NULLS LAST')} AS gone FROM (SELECT *, CASE WHEN walk_ord % 4 = 0 THEN NULL ELSE walk_ord % 13 * 100 END AS pixels FROM members))
SELECT path FROM chosen WHERE gone""")
def keep_largest_res(spark, sf_dir):
    m = _turbo(spark, sf_dir).withColumn("pixels", F.when(F.col("walk_ord") % 4 != 0, F.col("walk_ord") % 13 * 100))
    return select.select_members(m, "largest_res").select("path")


@_query(_BASE + _PICKED + """, chosen AS (SELECT *, path NOT IN (FROM picked) AS gone FROM members)
SELECT path FROM (SELECT *, bool_and(gone) OVER (PARTITION BY group_key) AS lost FROM chosen) WHERE gone AND NOT (lost AND member_ord = 0)""")
def invert_selection(spark, sf_dir):
    m = _turbo(spark, sf_dir)
    return select.select_members(m, "invert", selection=_picked(m)).select("path")


@_query(_BASE + _PICKED + " SELECT count(*) AS endangered FROM (SELECT 1 FROM members GROUP BY group_key HAVING bool_and(path IN (FROM picked)))")
def endangered_groups(spark, sf_dir):
    m = _turbo(spark, sf_dir)
    return select.endangered_groups(m, _picked(m))


@_query(_BASE + " SELECT path FROM members WHERE member_ord > 0")
def default_selection(spark, sf_dir):
    return select.default_selection(_turbo(spark, sf_dir), content_verified=True)


@_query(_BASE + f""", g AS (SELECT group_key, any_value(category) FILTER (member_ord = 0) AS category, any_value(size) FILTER (member_ord = 0) AS size,
  bool_or(contains(lower(path), '/en/') OR contains(lower(name), '/en/')) AS found, max(modified) AS newest FROM members GROUP BY group_key)
SELECT group_key, path FROM members WHERE group_key IN (SELECT group_key FROM g WHERE found AND size >= 500 AND newest < {NOW} - {select.YEAR})""")
def filtered_groups(spark, sf_dir):
    return select.filter_groups(_turbo(spark, sf_dir), search=" /EN/ ", min_size=500, age="older", now=NOW).select("group_key", "path")


@_query(_BASE + " SELECT group_key, path FROM members WHERE group_key IN (SELECT group_key FROM members WHERE member_ord = 0 AND category = 'images')")
def filtered_by_category(spark, sf_dir):
    return select.filter_groups(_turbo(spark, sf_dir), category="images").select("group_key", "path")


for _by in ("wasted", "count", "size"):

    def _top(spark, sf_dir, by=_by):
        return select.page(select.sort_groups(_turbo(spark, sf_dir), by), 0, 20).select("group_key", "count", "wasted", "size")

    _query(_BASE + f""", g AS (SELECT group_key, block_ord, group_ord, count(*) AS count, sum(size) FILTER (member_ord > 0)::BIGINT AS wasted, any_value(size) FILTER (member_ord = 0) AS size FROM members GROUP BY ALL)
SELECT group_key, count, wasted, size FROM g ORDER BY {_by} DESC, block_ord, group_ord LIMIT 20""", f"top_groups_{_by}")(_top)


@_query(_BASE + _PICKED + """, l AS (SELECT *, count(*) OVER (PARTITION BY group_key) AS n2, row_number() OVER (PARTITION BY group_key ORDER BY member_ord) - 1 AS m2 FROM members WHERE path NOT IN (FROM picked))
SELECT group_key, m2 AS member_ord, path FROM l WHERE n2 > 1""")
def remove_and_regroup(spark, sf_dir):
    m = _turbo(spark, sf_dir)
    return select.remove_members(m, _picked(m)).select("group_key", "member_ord", "path")


# ---- plans ----

_NOW_INV = """, now AS (SELECT path, CASE WHEN doc_id % 11 = 3 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 13 = 5 THEN modified + 1 WHEN doc_id % 13 = 6 THEN modified + 0.0005 ELSE modified END AS modified,
  CASE WHEN doc_id % 19 = 2 THEN 2 ELSE dev END AS dev, ino, CASE WHEN doc_id % 23 = 4 THEN 'x' ELSE sha256(text) END AS hash FROM inv WHERE doc_id % 17 <> 7)"""
_REASON = "CASE WHEN n.path IS NULL THEN 'access' WHEN n.size <> m.size THEN 'size' WHEN abs(n.modified - m.modified) > 0.001 THEN 'mtime' END"


def _later(spark, sf_dir) -> DataFrame:
    """The inventory at a later time: some files gone, grown, touched, moved to another device or changed."""
    inv = _inv(spark, sf_dir)
    i = F.col("walk_ord")
    return inv.filter(i % 17 != 7).select(
        "path", F.when(i % 11 == 3, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(i % 13 == 5, F.col("modified") + 1).when(i % 13 == 6, F.col("modified") + 0.0005).otherwise(F.col("modified")).alias("modified"),
        F.when(i % 19 == 2, 2).otherwise(F.col("dev")).alias("dev"), "ino", F.when(i % 23 == 4, "x").otherwise(X.full_hash(F.col("content"))).alias("hash"),
    )


@_query(_BASE + _PICKED + _NOW_INV + f" SELECT m.path, m.size, {_REASON} IS NULL AS ok, {_REASON} AS reason FROM members m LEFT JOIN now n ON n.path = m.path WHERE m.path IN (FROM picked)")
def snapshot_verify(spark, sf_dir):
    m = _turbo(spark, sf_dir)
    return actions.verify_snapshot(actions.snapshot_of(m, _picked(m)), _later(spark, sf_dir)).select("path", "size", "ok", "reason")


@_query(_BASE + _NOW_INV + f" SELECT m.path, {_REASON} AS reason, (CASE WHEN {_REASON} IS NULL THEN m.size ELSE 0 END)::BIGINT AS freed FROM members m LEFT JOIN now n ON n.path = m.path WHERE m.member_ord > 0")
def delete_plan(spark, sf_dir):
    m = _turbo(spark, sf_dir)
    return actions.delete_plan(m, select.select_members(m, "first"), _later(spark, sf_dir)).select("path", "reason", "freed")


@_query(_BASE + _NOW_INV + f""", r AS (SELECT f.path AS original, m.path AS duplicate, m.size, coalesce({_REASON}, CASE WHEN o.path IS NULL THEN 'missing-original' WHEN o.dev <> n.dev THEN 'cross-volume'
  WHEN o.ino <> 0 AND o.ino = n.ino THEN 'already-linked' WHEN o.size <> n.size THEN 'size-diff' WHEN o.hash <> n.hash THEN 'content-diff' END) AS reason
  FROM members m JOIN members f ON f.group_key = m.group_key AND f.member_ord = 0 LEFT JOIN now n ON n.path = m.path LEFT JOIN now o ON o.path = f.path WHERE m.member_ord > 0)
SELECT original, duplicate, reason, (CASE WHEN reason IS NULL THEN size ELSE 0 END)::BIGINT AS freed FROM r""")
def hardlink_plan(spark, sf_dir):
    m = _turbo(spark, sf_dir)
    return actions.hardlink_plan(m, select.select_members(m, "first"), _later(spark, sf_dir)).select("original", "duplicate", "reason", "freed")


# some names have numbers, and some are taken at the destination: by walk position, as stated here
_SUF = r"regexp_extract({0}, '^\.*[^.].*(\.[^.]*)$', 1)"
_MOVED = r""", moved AS (
  SELECT regexp_extract(path, '^(.*/)[^/]*$', 1) || name[1:length(name) - length(suf)] || CASE WHEN walk_ord % 3 = 0 THEN ' (' || (walk_ord % 4 + 1) || ')' ELSE '' END || suf AS path, walk_ord, member_ord
  FROM (SELECT *, """ + _SUF.format("name") + r""" AS suf FROM members)
), r AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM moved WHERE member_ord > 0
), parts AS (SELECT path, name, lower(name) AS low, name[1:length(name) - length(suf)] AS stem, suf FROM (SELECT *, """ + _SUF.format("name") + r""" AS suf FROM r)
), there AS (SELECT DISTINCT lower(regexp_extract(path, '[^/]*$')) AS low FROM moved WHERE walk_ord % 7 = 0
), asked AS (SELECT low, min(path) AS path FROM parts WHERE low NOT IN (FROM there) GROUP BY low
), others AS (SELECT *, row_number() OVER (PARTITION BY lower(stem), lower(suf) ORDER BY path) AS i FROM parts WHERE path NOT IN (SELECT path FROM asked)
), taken AS (SELECT low, """ + _SUF.format("low") + r""" AS suf FROM (FROM there UNION SELECT low FROM asked)
), used AS (SELECT regexp_replace(s, ' \([1-9][0-9]{0,17}\)$', '') AS stem, suf, regexp_extract(s, ' \(([1-9][0-9]{0,17})\)$', 1)::BIGINT AS u
  FROM (SELECT low[1:length(low) - length(suf)] AS s, suf FROM taken) WHERE regexp_matches(s, ' \([1-9][0-9]{0,17}\)$')
), marks AS (SELECT stem, suf, u - row_number() OVER (PARTITION BY stem, suf ORDER BY u) + 1 AS t FROM used)
SELECT path AS src, '/dest/' || name AS dst FROM parts WHERE path IN (SELECT path FROM asked)
UNION ALL SELECT o.path, '/dest/' || any_value(o.stem) || ' (' || (any_value(o.i) + count(m.t)) || ')' || any_value(o.suf)
FROM others o LEFT JOIN marks m ON m.stem = lower(o.stem) AND m.suf = lower(o.suf) AND m.t <= o.i GROUP BY o.path"""


@_query(_BASE + _MOVED)
def move_plan(spark, sf_dir):
    name, i = F.regexp_extract("path", r"(?s)([^/]*)$", 1), F.col("walk_ord")
    suffix = F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)
    number = F.when(i % 3 == 0, F.concat(F.lit(" ("), (i % 4 + 1).cast("string"), F.lit(")"))).otherwise("")
    path = F.concat(F.substr("path", F.lit(1), F.length("path") - F.length(suffix)), number, suffix)
    m = write_once(_turbo(spark, sf_dir).withColumn("path", path), "members")
    there = m.filter(i % 7 == 0).withColumn("path", F.concat(F.lit("/dest/"), name))
    inv = m.unionByName(there).select("path", "size", "modified")
    return actions.move_plan(m, select.select_members(m, "first"), inv, "/dest").select("src", "dst")


@_query(_BASE + r""", gone AS (SELECT path FROM members WHERE member_ord > 0), p AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path FROM gone)
SELECT p.path FROM p WHERE NOT EXISTS (SELECT 1 FROM inv WHERE starts_with(inv.path, p.path || '/') AND inv.path NOT IN (FROM gone))""")
def emptied_parents(spark, sf_dir):
    m = _turbo(spark, sf_dir)
    return sweep.emptied_parents(select.select_members(m, "first"), _inv(spark, sf_dir)).select("path")


# ---- fingerprint cache ----

_CACHE = """, cache AS (SELECT path, CASE WHEN doc_id % 5 = 2 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 7 = 3 THEN modified + 1 WHEN doc_id % 7 = 4 THEN modified + 0.0005 ELSE modified END AS mtime,
  CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS full_hash, md5(text) AS turbo_hash FROM inv WHERE doc_id % 3 <> 0)"""


def _cache(inv: DataFrame) -> DataFrame:
    i = F.col("walk_ord")
    return inv.filter(i % 3 != 0).select(
        "path", F.when(i % 5 == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(i % 7 == 3, F.col("modified") + 1).when(i % 7 == 4, F.col("modified") + 0.0005).otherwise(F.col("modified")).alias("mtime"),
        F.when(i % 2 == 0, X.full_hash(F.col("content"))).alias("full_hash"), F.md5("content").alias("turbo_hash"),
    )


@_query(f"WITH {_INV}{_CACHE} SELECT i.path, c.full_hash, c.turbo_hash FROM inv i LEFT JOIN cache c ON c.path = i.path AND c.size = i.size AND abs(i.modified - c.mtime) < 0.001")
def cache_lookup(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return C.cache_lookup(inv.drop("content"), _cache(inv)).select("path", "full_hash", "turbo_hash")


@_query(f"""WITH {_INV}{_CACHE}, fresh AS (SELECT path, size, modified AS mtime, CASE WHEN doc_id % 4 = 1 THEN sha256(text) END AS full_hash, CASE WHEN doc_id % 4 = 2 THEN 'new' END AS turbo_hash FROM inv WHERE doc_id % 10 <> 0)
SELECT coalesce(f.path, c.path) AS path, CASE WHEN f.path IS NULL THEN c.size ELSE f.size END AS size, CASE WHEN f.path IS NULL THEN c.mtime ELSE f.mtime END AS mtime,
  CASE WHEN f.path IS NULL THEN c.full_hash ELSE coalesce(f.full_hash, CASE WHEN c.size = f.size AND c.mtime = f.mtime THEN c.full_hash END) END AS full_hash,
  CASE WHEN f.path IS NULL THEN c.turbo_hash ELSE coalesce(f.turbo_hash, CASE WHEN c.size = f.size AND c.mtime = f.mtime THEN c.turbo_hash END) END AS turbo_hash
FROM cache c FULL JOIN fresh f ON f.path = c.path""")
def cache_upsert(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    i = F.col("walk_ord")
    fresh = inv.filter(i % 10 != 0).select("path", "size", F.col("modified").alias("mtime"), F.when(i % 4 == 1, X.full_hash(F.col("content"))).alias("full_hash"), F.when(i % 4 == 2, "new").alias("turbo_hash"))
    return C.cache_upsert(_cache(inv), fresh)


@_query(f"WITH {_INV}{_CACHE} SELECT (SELECT count(*) FROM cache) AS files, (SELECT count(*) FROM inv WHERE ext = '.jpg') AS images")
def cache_stats(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return C.cache_stats(_cache(inv), inv.filter("ext = '.jpg'"))


_criteria_cached = f"WITH {_INV}{_SCAN}" + _members(["size", _FULL], f"size || '|' || {_FULL}", hash_=_FULL) + f" SELECT {_COLS} FROM members"


@_query(_criteria_cached)
def dup_incremental(spark, sf_dir):
    """A second scan, that hashes only what the table of the first doesn't have."""
    inv = _inv(spark, sf_dir)
    return D.find_duplicates(C.incremental(inv, write_once(_cache(inv), "cache")), D.Criteria(turbo=False)).select(*SHOWN)


# ---- trees ----

_TREES = """a AS (SELECT doc_id, text, strlen(text)::BIGINT AS size, (doc_id * 7919 % 86400)::DOUBLE AS modified FROM documents WHERE doc_id % 7 <> 0),
b AS (SELECT doc_id, text, strlen(text)::BIGINT AS size, modified FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || chr(10) || 'extra line' WHEN 1 THEN text ELSE replace(text, ' the ', ' THE ') END AS text,
  (doc_id * 7919 % 86400)::DOUBLE + doc_id % 3 - 1 AS modified FROM documents WHERE doc_id % 11 <> 0)),
d AS (SELECT coalesce(a.doc_id, b.doc_id)::VARCHAR AS rel_key, CASE WHEN b.doc_id IS NULL THEN 'a' WHEN a.doc_id IS NULL THEN 'b' ELSE 'common' END AS side,
  CASE WHEN a.text = b.text THEN 1.0::DOUBLE END AS similarity,
  CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN CASE WHEN a.modified > b.modified THEN 'a' WHEN b.modified > a.modified THEN 'b' ELSE 'same' END END AS newer,
  CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN CASE WHEN a.size > b.size THEN 'a' WHEN b.size > a.size THEN 'b' ELSE 'same' END END AS larger, coalesce(a.size, -1) AS a_size, coalesce(b.size, -1) AS b_size
  FROM a FULL JOIN b ON a.doc_id = b.doc_id)"""


def _trees(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    changed = F.when(i % 3 == 0, F.concat("text", F.lit("\nextra line"))).when(i % 3 == 1, F.col("text")).otherwise(F.replace("text", F.lit(" the "), F.lit(" THE ")))

    def tree(rows, text, shift):
        return rows.select(i.cast("string").alias("rel_path"), i.cast("string").alias("path"), i.cast("string").alias("name"), F.octet_length(text).cast("long").alias("size"),
                           ((i * 7919 % 86400).cast("double") + shift).alias("modified"), F.encode(text, "UTF-8").alias("content"), i.alias("walk_ord"))

    return tree(docs.filter(i % 7 != 0), F.col("text"), F.lit(0)), tree(docs.filter(i % 11 != 0), changed, i % 3 - 1)


@_query(f"WITH {_TREES} SELECT * FROM d")
def tree_diff(spark, sf_dir):
    return diff.diff_trees(*_trees(spark, sf_dir)).select("rel_key", "side", "similarity", "newer", "larger", F.coalesce("a_size", F.lit(-1)).alias("a_size"), F.coalesce("b_size", F.lit(-1)).alias("b_size"))


@_query(f"""WITH {_TREES} SELECT count(*) FILTER (side = 'a') AS unique_a, count(*) FILTER (side = 'b') AS unique_b, count(*) FILTER (side = 'common') AS common, count(*) AS total,
count(*) FILTER (similarity = 1) AS identical, (count(*) FILTER (side = 'common') - count(*) FILTER (similarity = 1))::BIGINT AS modified, round(100.0::DOUBLE * count(*) FILTER (side = 'common') / count(*), 4) AS overlap FROM d""")
def tree_diff_summary(spark, sf_dir):
    return diff.diff_summary(diff.diff_trees(*_trees(spark, sf_dir)))


@_query()
def tree_diff_line_similarity(spark, sf_dir):
    return diff.diff_trees(*_trees(spark, sf_dir), line_similarity=True).select("rel_key", "side", "similarity", "newer", "larger")


# ---- pictures ----

_BITS = ", ".join(f"(embedding[{r * 8 + c + 1}] > embedding[{r * 8 + c + 2}])::INT::BIGINT << {48 - (r * 7 + c)}" for r in range(7) for c in range(7))
_CODES = f"codes AS (SELECT vec_id AS id, list_sum([{_BITS}])::BIGINT AS code FROM embeddings)"
_PAIRS = _CODES + ", pairs AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.code, b.code))::BIGINT AS distance FROM codes a JOIN codes b ON a.id < b.id WHERE bit_count(xor(a.code, b.code)) <= 12)"


def _codes(spark, sf_dir) -> DataFrame:
    return similar.fingerprints(I.grids_from_embeddings(_table(spark, sf_dir, "embeddings")), 7)


@_query(f"WITH {_CODES} SELECT id, code AS fingerprint, printf('%016x', code) AS hash FROM codes")
def dhash_fingerprints(spark, sf_dir):
    return _codes(spark, sf_dir).select("id", "fingerprint", "hash")


@_query(f"WITH {_PAIRS} SELECT a, b, distance, round(100.0::DOUBLE * greatest(0.0, 1 - distance / 64.0::DOUBLE), 6) AS similarity FROM pairs")
def hamming_pairs(spark, sf_dir):
    pairs = similar.with_similarity(similar.hamming_pairs(_codes(spark, sf_dir), X.max_distance(0.80), 49))
    return pairs.withColumn("similarity", F.round("similarity", 6))


@_query(f"WITH {_PAIRS} SELECT a, b, distance FROM pairs")
def hamming_pairs_banded(spark, sf_dir):
    return similar.hamming_pairs(_codes(spark, sf_dir), X.max_distance(0.80), 49, loop_codes=0)


@_query(f"""WITH RECURSIVE {_PAIRS}, both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
walk AS (SELECT a AS id, a AS other FROM both_ways UNION SELECT w.id, e.b FROM walk w JOIN both_ways e ON e.a = w.other)
SELECT id, min(other) AS component FROM walk GROUP BY id""")
def similar_components(spark, sf_dir):
    return similar.code_components(_codes(spark, sf_dir), X.max_distance(0.80), 49)


@_query(f"""WITH RECURSIVE {_CODES}, heads AS (SELECT code, min(id) AS w FROM codes GROUP BY code),
pairs AS (SELECT a.w AS a, b.w AS b FROM heads a JOIN heads b ON a.w <> b.w AND bit_count(xor(a.code, b.code)) <= 12),
walk AS (SELECT w AS id, w AS other FROM heads UNION SELECT walk.id, e.b FROM walk JOIN pairs e ON e.a = walk.other),
items AS (SELECT row_number() OVER (ORDER BY c, w) AS i, c, w, code FROM (SELECT id AS w, min(other) AS c FROM walk GROUP BY id) JOIN heads USING (w)),
linked(i, state) AS (SELECT 0::BIGINT, []::STRUCT(c BIGINT, g BIGINT, w BIGINT, code BIGINT)[] UNION ALL
  SELECT n.i, list_append(list_filter(l.state, lambda s: s.c = n.c), {{'c': n.c, 'g': coalesce(list_min(list_filter(range(0, len(l.state)),
    lambda g: len(list_filter(l.state, lambda s: s.c = n.c AND s.g = g)) > 0 AND len(list_filter(l.state, lambda s: s.c = n.c AND s.g = g AND bit_count(xor(s.code, n.code)) > 12)) = 0)),
    coalesce(list_max(list_transform(list_filter(l.state, lambda s: s.c = n.c), lambda s: s.g)) + 1, 0)), 'w': n.w, 'code': n.code}}) FROM linked l JOIN items n ON n.i = l.i + 1),
placed AS (SELECT state[-1].c AS c, state[-1].g AS g, state[-1].code AS code FROM linked WHERE i > 0),
m AS (SELECT c, g, id, printf('%016x', code) AS hash, count(*) OVER (PARTITION BY c, g) AS n, min(id) OVER (PARTITION BY c, g) AS group_ord,
  row_number() OVER (PARTITION BY c, g ORDER BY id * 7919 % 86400, id) - 1 AS member_ord FROM codes JOIN placed USING (code) QUALIFY n > 1)
SELECT 'Photo Group ' || dense_rank() OVER (ORDER BY group_ord) || ': vec_' || first(id) OVER (PARTITION BY c, g ORDER BY member_ord) AS group_key, group_ord, member_ord, id, hash FROM m""")
def similar_groups(spark, sf_dir):
    return similar.named_groups(similar.find_similar(_codes(spark, sf_dir), 0.80, 49)).select("group_key", "group_ord", "member_ord", "id", "hash")


@_query(f"WITH {_INV} SELECT path, 'images' AS category FROM inv WHERE ext = '.jpg' AND size > 0")
def image_scan(spark, sf_dir):
    return similar.images(_inv(spark, sf_dir)).select("path", "category")


@_query("SELECT DISTINCT ['heic', 'cr2', 'dng', 'raw'][(doc_id % 4 + 1)::INT] AS ext FROM documents WHERE doc_id % 6 < 3")
def unsupported_formats(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    kinds = F.element_at(F.array(*map(F.lit, (".heic", ".cr2", ".dng", ".raw"))), (F.col("walk_ord") % 4 + 1).cast("int"))
    return similar.unsupported_formats(inv.withColumn("ext", F.when(F.col("walk_ord") % 6 < 3, kinds).otherwise(F.lit(".jpg"))))


# ---- sweeping ----

_DIRS = _INV + """, dirs AS (SELECT DISTINCT path FROM (
  SELECT unnest(['/' || source, '/' || source || '/' || lang, '/' || source || '/' || lang || '/' || doc_id]) AS path FROM named
  UNION ALL SELECT unnest(['/empty' || doc_id, '/empty' || doc_id || '/x', '/empty' || doc_id || '/x/y', '/' || source || '/hollow' || doc_id]) FROM named WHERE doc_id % 40 = 0
))"""


def _dirs(inv: DataFrame) -> DataFrame:
    """All folders of the inventory, and chains of empty ones."""
    i = F.col("walk_ord").cast("string")
    top = F.regexp_extract("path", "^(/[^/]+)/", 1)
    hollow = F.array(F.concat(F.lit("/empty"), i), F.concat(F.lit("/empty"), i, F.lit("/x")), F.concat(F.lit("/empty"), i, F.lit("/x/y")), F.concat(top, F.lit("/hollow"), i))
    real = inv.select(F.explode(sweep.ancestors(F.col("path"))).alias("path")).filter("path <> ''")
    return real.union(inv.filter("walk_ord % 40 = 0").select(F.explode(hollow))).distinct()


@_query(f"WITH {_DIRS} SELECT path, (length(path) - length(replace(path, '/', '')))::BIGINT AS depth FROM dirs d WHERE NOT EXISTS (SELECT 1 FROM inv WHERE starts_with(inv.path, d.path || '/'))")
def empty_dirs(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return sweep.empty_dirs(_dirs(inv), inv).select("path", "depth")


@_query(f"""WITH {_INV}, links AS (SELECT '/links/' || doc_id || '.lnk' AS path, CASE WHEN doc_id % 7 = 2 THEN '' WHEN doc_id % 3 = 0 THEN 'C:/gone' || path WHEN doc_id % 5 = 1 THEN 'D:' || path ELSE upper('C:' || path) END AS target FROM inv)
SELECT path, target FROM links l WHERE target <> '' AND starts_with(target, 'C:') AND NOT EXISTS (SELECT 1 FROM inv WHERE lower('C:' || inv.path) = lower(l.target))""")
def broken_links(spark, sf_dir):
    """Links of every document: to it in capitals, to a place where nothing is, to a drive that isn't there, to nothing."""
    inv = _inv(spark, sf_dir).withColumn("path", F.concat(F.lit("C:"), "path"))
    i = F.col("walk_ord")
    target = F.when(i % 7 == 2, "").when(i % 3 == 0, F.regexp_replace("path", "^C:", "C:/gone")).when(i % 5 == 1, F.regexp_replace("path", "^C:", "D:")).otherwise(F.upper("path"))
    links = inv.select(F.concat(F.lit("/links/"), i.cast("string"), F.lit(".lnk")).alias("path"), target.alias("target"))
    return sweep.broken_links(links, inv, spark.createDataFrame([("C:",)], "drive string"))


def _little(c, n: int):
    """``n`` bytes of a number, lowest first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(c.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(n)]))


@_query(f"WITH {_INV} SELECT path, CASE WHEN doc_id % 10 <> 0 AND doc_id % 13 <> 1 THEN 'C:' || path END AS target FROM inv")
def shortcut_targets(spark, sf_dir):
    """Shortcut files with a target made of each path; some are cut short, some have no end mark."""
    from ..functions.python_udfs import link_target

    inv = _inv(spark, sf_dir)
    i = F.col("walk_ord")
    body = F.encode(F.concat(F.lit("C:"), "path"), "UTF-8")
    head = F.concat(F.lit(b"\x4c\0\0\0" + bytes(16)), _little(F.lit(2), 4), F.lit(bytes(0x4C - 24)))
    link = F.concat(head, _little(F.octet_length(body) + 29, 4), *[_little(F.lit(x), 4) for x in (28, 1, 0, 28)], F.lit(bytes(8)), body)
    cut = F.when(i % 10 == 0, F.substring(link, 1, 40)).when(i % 13 == 1, link).otherwise(F.concat(link, F.lit(b"\0")))
    return inv.select("path", cut.alias("content")).select("path", link_target("content").alias("target"))


_BIN = "bins AS (SELECT *, 'C:' || path AS original_path, doc_id % 2 = 0 AS data_exists FROM inv WHERE doc_id % 11 <> 5)"


def _bin_entries(inv: DataFrame) -> DataFrame:
    """Bin records of every path, of both versions; some are cut short, every other one has data."""
    from ..sources.stores import bin_entries

    i, path = F.col("walk_ord"), F.concat(F.lit("C:"), "path")
    head = lambda version: F.concat(_little(F.lit(version), 8), _little(F.col("size"), 8), _little(F.lit(116444736000000000) + i * 10_000_000, 8))
    old = F.concat(head(1), F.substring(F.concat(F.encode(path, "ISO-8859-1"), F.lit(bytes(256))), 1, 256))
    new = F.concat(head(2), _little(F.length(path) + 1, 4), F.encode(path, "UTF-16LE"), F.lit(b"\0\0"))
    record = F.when(i % 3 == 1, old).otherwise(new)
    index = inv.select(F.concat(F.lit("/bin/$I"), i.cast("string")).alias("path"), F.when(i % 11 == 5, F.substring(record, 1, 20)).otherwise(record).alias("content"))
    data = inv.filter("walk_ord % 2 = 0").select(F.concat(F.lit("/BIN/$r"), i.cast("string")).alias("path"), F.lit(b"").alias("content"))
    return bin_entries(index.unionByName(data))


@_query(f"WITH {_INV}, {_BIN} SELECT '/bin/$I' || doc_id AS index_path, CASE WHEN data_exists THEN '/BIN/$r' || doc_id ELSE '' END AS data_path, original_path, size, doc_id::DOUBLE AS deleted_ts, data_exists FROM bins")
def bin_entries(spark, sf_dir):
    return _bin_entries(_inv(spark, sf_dir)).select("index_path", "data_path", "original_path", "size", "deleted_ts", "data_exists")


@_query(f"WITH {_INV}, {_BIN} SELECT 'C:' || path AS path FROM inv WHERE lower('C:' || path) IN (SELECT lower(original_path) FROM bins WHERE data_exists)")
def bin_index_lookup(spark, sf_dir):
    """Paths that the bin can give back."""
    inv = _inv(spark, sf_dir)
    return journal.restorable_paths(inv.select(F.concat(F.lit("C:"), "path").alias("path")), _bin_entries(inv).filter("data_exists"))


@_query(f"WITH {_INV} SELECT path, doc_id % 3 = 0 AND least(doc_id % 2048, size) < 1024 AS is_binary FROM inv")
def binary_test(spark, sf_dir):
    """Every third content gets a zero byte, some beyond the part that is looked at."""
    inv = _inv(spark, sf_dir)
    i = F.col("walk_ord")
    at = F.least(i % 2048, F.col("size")).cast("int")
    content = F.when(i % 3 == 0, F.concat(F.substr("content", F.lit(1), at), F.lit(b"\0"), F.substr("content", at + 1))).otherwise(F.col("content"))
    return inv.select("path", X.is_binary(content).alias("is_binary"))


# ---- reports and journals ----


@_query(_BASE + f""" SELECT group_key AS "group", name AS file_name, path, size AS size_bytes, {_human('size')} AS size_formatted, strftime(make_timestamp((modified * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS modified, category FROM members""")
def export_rows(spark, sf_dir):
    return report.export_rows(_turbo(spark, sf_dir))


@_query(_BASE + """ SELECT group_key, sum(size) FILTER (member_ord > 0)::BIGINT AS wasted, '[' || string_agg('{"name":"' || name || '","path":"' || path || '","size":' || size || ',"modified":' || modified || ',"category":"' || category || '"}', ',' ORDER BY member_ord) || ']' AS files FROM members GROUP BY group_key""")
def export_json(spark, sf_dir):
    return report.json_groups(_turbo(spark, sf_dir)).select("group_key", "wasted", "files")


@_query(_BASE + f""" SELECT group_key, '=== Group: ' || group_key || ' (' || count(*) || ' files, ' || any_value({_human('size')}) FILTER (member_ord = 0) || ' each) ===' || chr(10) || string_agg('  - ' || path || ' (' || ({_human('size')}) || ')', chr(10) ORDER BY member_ord) AS body FROM members GROUP BY group_key""")
def export_text(spark, sf_dir):
    return report.text_groups(_turbo(spark, sf_dir)).select("group_key", "body")


@_query(_BASE + f""" SELECT group_key, '<tr class="group"><th colspan="5">' || group_key || ' &middot; ' || count(*) || ' files &middot; ' || ({_human('(coalesce(sum(size) FILTER (member_ord > 0), 0)::BIGINT)')}) || ' reclaimable</th></tr>' || chr(10)
  || string_agg('<tr><td>' || name || '</td><td>' || path || '</td><td>' || ({_human('size')}) || '</td><td>' || strftime(make_timestamp((modified * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') || '</td><td>' || category || '</td></tr>', chr(10) ORDER BY member_ord) AS body FROM members GROUP BY group_key""")
def export_html(spark, sf_dir):
    return report.html_groups(_turbo(spark, sf_dir)).select("group_key", "body")


def _journal(spark, sf_dir) -> DataFrame:
    """Events as operations."""
    e = _table(spark, sf_dir, "events")
    kinds = F.element_at(F.array(*map(F.lit, ("move", "hardlink", "delete"))), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(
        F.col("event_id").cast("string").alias("id"), kinds.alias("type"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.array(F.concat(F.lit("/u/"), F.col("user_id").cast("string"))).alias("paths"),
        F.col("event_id").alias("freed_bytes"), F.struct((F.col("event_id") % 2 == 0).alias("trash")).alias("details"), (F.col("event_id") % 7 == 0).alias("undone"),
    )


_KIND = "['move', 'hardlink', 'delete'][(event_id % 3 + 1)::INT]"


@_query(f"SELECT event_id::VARCHAR AS id, {_KIND} AS type, epoch_us(ts)::DOUBLE AS ts FROM events ORDER BY ts DESC, id LIMIT 100")
def journal_topk(spark, sf_dir):
    return journal.newest(_journal(spark, sf_dir), k=journal.KEPT_OPERATIONS).select("id", "type", "ts")


@_query("SELECT user_id, epoch_us(ts)::BIGINT AS ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id", "event_type")
    return journal.latest_per_key(e, "user_id", "ts", "event_id")


@_query(f"SELECT event_id::VARCHAR AS id, {_KIND} AS type FROM events WHERE event_id % 7 <> 0 AND (event_id % 3 <> 2 OR event_id % 2 = 0)")
def undo_eligible(spark, sf_dir):
    return journal.undo_eligible(_journal(spark, sf_dir)).select("id", "type")


@_query(f"""WITH o AS (SELECT event_id, {_KIND} AS type, event_id % 5 <> 0 AS ok, event_id AS freed, '/u/' || user_id || '/' || event_id AS path FROM events)
SELECT count(*) FILTER (ok) AS done, count(*) FILTER (NOT ok) AS failed, (sum(freed) FILTER (ok))::BIGINT AS freed_bytes, (SELECT string_agg(e, ',' ORDER BY p) FROM (SELECT path AS p, 'e' || event_id AS e FROM o WHERE NOT ok ORDER BY path LIMIT 5)) AS errors FROM o""")
def action_summary(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    i = F.col("event_id")
    rows = e.select(F.concat_ws("/", F.lit("/u"), F.col("user_id").cast("string"), i.cast("string")).alias("path"), (i % 5 != 0).alias("ok"), i.alias("freed"), F.concat(F.lit("e"), i.cast("string")).alias("error"))
    return stats.action_summary(rows).withColumn("errors", F.array_join("errors", ","))


@_query("SELECT sum(o_orderkey)::BIGINT AS wasted FROM orders")
def history_total(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return journal.history_total(o.select(F.col("o_orderkey").alias("wasted")))


# ---- small operators over whole tables ----


@_query(f"WITH {_INV} SELECT path, CASE WHEN doc_id % 2 = 0 THEN walk_ord ELSE walk_ord + 281474976710656 END AS walk_ord FROM inv")
def roots_in_order(spark, sf_dir):
    inv = _inv(spark, sf_dir).drop("content")
    return I.union(inv.filter("walk_ord % 2 = 0"), inv.filter("walk_ord % 2 = 1")).select("path", "walk_ord")


@_query(f"WITH {_INV} SELECT DISTINCT lower(regexp_extract(path, '^(.*)/[^/]*$', 1)) AS prefix FROM inv WHERE doc_id % 3 > 0")
def priority_folders(spark, sf_dir):
    folder, i = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.col("walk_ord")
    # blanks, doubled and last separators, another case
    shown = F.when(i % 3 == 0, "  ").when(i % 4 == 0, F.concat(F.upper(folder), F.lit("//"))).when(i % 4 == 1, F.concat(F.lit(" "), F.replace(folder, F.lit("/"), F.lit("\\")))).otherwise(folder)
    return filters.normalize_folders(_inv(spark, sf_dir).select(shown.alias("prefix")))


@_query(f"""WITH {_INV}, p AS (SELECT doc_id, ['C:', 'c:', 'D:', ''][doc_id % 4 + 1] || path AS a, ['C:', 'd:', ''][doc_id % 3 + 1] || path AS b FROM inv)
SELECT a, b, a[2] = ':' AND b[2] = ':' AND lower(a[1]) = lower(b[1]) AS same FROM p""")
def volumes(spark, sf_dir):
    i = F.col("walk_ord")
    a = F.concat(F.element_at(F.array(*map(F.lit, ("C:", "c:", "D:", ""))), (i % 4 + 1).cast("int")), "path")
    b = F.concat(F.element_at(F.array(*map(F.lit, ("C:", "d:", ""))), (i % 3 + 1).cast("int")), "path")
    return _inv(spark, sf_dir).select(a.alias("a"), b.alias("b")).withColumn("same", X.same_volume(F.col("a"), F.col("b")))


@_query(f"WITH {_INV} SELECT path, (modified * 10000000 + doc_id % 7)::DOUBLE / 10000000 AS seconds FROM inv")
def filetimes(spark, sf_dir):
    ticks = F.lit(116444736000000000) + (F.col("modified") * 10_000_000).cast("long") + F.col("walk_ord") % 7
    return _inv(spark, sf_dir).select("path", X.filetime_epoch(ticks).alias("seconds"))


@_query(_BASE + _NOW_INV + f""" SELECT f.path AS src, m.path AS dst FROM members m JOIN members f ON f.group_key = m.group_key AND f.member_ord = 0 JOIN now n ON n.path = m.path JOIN now o ON o.path = f.path
WHERE m.member_ord > 0 AND {_REASON} IS NULL AND o.dev = n.dev AND NOT (o.ino <> 0 AND o.ino = n.ino) AND o.size = n.size AND o.hash = n.hash""")
def link_pairs(spark, sf_dir):
    m = _turbo(spark, sf_dir)
    plan = write_once(actions.hardlink_plan(m, select.select_members(m, "first"), _later(spark, sf_dir)), "plan")
    return journal.link_pairs(plan, plan.filter("reason IS NULL").select(F.col("duplicate").alias("path")))


@_query(f"""WITH {_INV} SELECT date, size % 3 AS duplicates, size AS wasted FROM (SELECT *, printf('%012d', doc_id) AS date FROM inv) WHERE size % 3 > 0 ORDER BY date DESC LIMIT 30""")
def history_kept(spark, sf_dir):
    rows = _inv(spark, sf_dir).select(F.format_string("%012d", "walk_ord").alias("date"), F.array("path").alias("folders"), (F.col("size") % 3).alias("duplicates"), F.col("size").alias("wasted"))
    return journal.history_append(rows.filter("duplicates > 0 AND wasted % 2 = 0"), rows.filter("duplicates = 0 OR wasted % 2 = 1")).select("date", "duplicates", "wasted")
