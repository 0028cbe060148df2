"""Queries over findings and tree deliveries: skewed keys, nested records, snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hot_keys, nested, snapshots
from ..session import table

KEYS = ("rule_id", "file_path")
#: Least share of all rows that makes a key heavy.
HEAVY = 0.04
FINDING_KEY = ("rule_id", "file_path", "start_line", "start_column")
LOCATION = ("start_line", "start_column", "end_line", "end_column", "start_offset", "end_offset")


def severity():
    return F.lower(F.trim(F.coalesce(F.col("severity"), F.lit("warning"))))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.heavy(table(spark, d, "findings"), KEYS, "start_line", HEAVY, ()).select("key_column", "key_value")


def p2_heavy_profile(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.heavy(table(spark, d, "findings"), KEYS, "start_line", HEAVY)


def p2_key_profile(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.profile(table(spark, d, "findings"), KEYS, "start_line")


def p2_key_severities(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.category_counts(table(spark, d, "findings"), KEYS, severity()).withColumnRenamed("category", "severity")


def p2_key_locations(spark: SparkSession, d: str) -> DataFrame:
    parts = {c: F.col(c) for c in ("file_path", *LOCATION)}
    return hot_keys.distinct_per_key(table(spark, d, "findings"), KEYS, parts)


def tree_nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return nested.flat_nodes(table(spark, d, "uast_trees"), "tree_id", F.col("delivered_at"), "doc", columns or tuple(nested.FIELDS))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return tree_nodes(spark, d, "node_no", "parent_no", "kind")


def p4_intervals(spark: SparkSession, d: str) -> DataFrame:
    return tree_nodes(spark, d, "node_no", "last_no", "post_no", "depth")


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    return tree_nodes(spark, d, *(c for c in nested.FIELDS if c != "properties"))


def p4_properties(spark: SparkSession, d: str) -> DataFrame:
    return nested.property_table(tree_nodes(spark, d, "node_no", "properties"), "tree_id")


def p4_calls_in_functions(spark: SparkSession, d: str) -> DataFrame:
    nodes = tree_nodes(spark, d, "node_no", "last_no", "kind")
    return nested.within(nested.kind_table(nodes, "CallExpression"), nested.kind_table(nodes, "FunctionDeclaration"), "tree_id")


def finding_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings").where("snapshot_no is not null and rule_id is not null and file_path is not null and start_line is not null and start_column is not null")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    f = finding_rows(spark, d)
    numbers = snapshots.snapshot_numbers(f, "snapshot_no")
    keys = {"rule_id": F.col("rule_id"), "file_path": snapshots.plain_path(F.col("file_path")), "start_line": F.col("start_line"), "start_column": F.col("start_column")}
    message = F.regexp_replace("message", r"\s+$", "")
    digest = snapshots.canonical_hash([severity(), message, *(F.col(c) for c in LOCATION[2:]), F.coalesce(F.col("fix"), F.lit(""))])
    states = snapshots.latest_by_snapshot(f, F.col("snapshot_no"), numbers, keys, F.col("ingested_at"), digest)
    return snapshots.diff_snapshots(states, "snapshot_no", FINDING_KEY, numbers=numbers)


def p6_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("from_no", "to_no", "rule_id", "change").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {q.__name__: q for q in (p2_found, p2_heavy_profile, p2_key_profile, p2_key_severities, p2_key_locations, p4_found, p4_intervals, p4_nodes, p4_properties, p4_calls_in_functions, p6_found, p6_change_counts)}

KEYED = "(select 'rule_id' key_column, rule_id key_value, * from findings union all select 'file_path', file_path, * from findings)"
RANKED = f"""(select key_column, key_value, start_line, count(*) over w n_rows, count(start_line) over w n_valued,
  row_number() over (partition by key_column, key_value order by start_line nulls last) rn from {KEYED} window w as (partition by key_column, key_value))"""
PLAIN = r"list_aggregate(list_filter(string_split(replace(file_path, '\', '/'), '/'), lambda s: s <> '' and s <> '.'), 'string_agg', '/')"
STATES = f"""states as (select * from (select snapshot_no, rule_id, coalesce({PLAIN}, '') file_path, start_line, start_column,
  lower(trim(coalesce(severity, 'warning'))) s, regexp_replace(message, '\\s+$', '') m, end_line, end_column, start_offset, end_offset, coalesce(fix, '') f,
  row_number() over (partition by snapshot_no, rule_id, coalesce({PLAIN}, ''), start_line, start_column order by ingested_at desc) rn
  from findings where rule_id is not null and file_path is not null) where rn = 1),
pairs as (select distinct a.snapshot_no n from states a join states b on b.snapshot_no = a.snapshot_no + 1),
diff as (select coalesce(o.snapshot_no, w.snapshot_no - 1) from_no, coalesce(o.snapshot_no, w.snapshot_no - 1) + 1 to_no, coalesce(o.rule_id, w.rule_id) rule_id,
  coalesce(o.file_path, w.file_path) file_path, coalesce(o.start_line, w.start_line) start_line, coalesce(o.start_column, w.start_column) start_column,
  case when o.rule_id is null then 'added' when w.rule_id is null then 'removed'
    when (o.s, o.m, o.end_line, o.end_column, o.start_offset, o.end_offset, o.f) is distinct from (w.s, w.m, w.end_line, w.end_column, w.start_offset, w.end_offset, w.f) then 'changed' end change
  from states o full join states w on w.snapshot_no = o.snapshot_no + 1 and w.rule_id = o.rule_id and w.file_path = o.file_path and w.start_line = o.start_line and w.start_column = o.start_column)"""

PROFILE = (
    "select key_column, key_value, any_value(n_rows) n_rows, any_value(n_valued) n_valued, "
    + ", ".join(f"max(start_line) filter (rn = greatest(1, ({p} * n_valued + 99) // 100) and n_valued > 0) q{p}" for p in (25, 50, 75))
    + f" from {RANKED} group by key_column, key_value"
)

SQL = {
    "p2_heavy_profile": f"select * from ({PROFILE}) where key_value is not null and n_rows >= 0.04 * (select count(*) from findings)",
    "p2_found": "select * from (select 'rule_id' key_column, rule_id key_value from findings group by rule_id having count(*) >= 0.04 * (select count(*) from findings) union all select 'file_path', file_path from findings group by file_path having count(*) >= 0.04 * (select count(*) from findings)) where key_value is not null",
    "p2_key_profile": f"select key_column, key_value, any_value(n_rows) n_rows, any_value(n_valued) n_valued, "
    + ", ".join(f"max(start_line) filter (rn = greatest(1, ({p} * n_valued + 99) // 100) and n_valued > 0) q{p}" for p in (25, 50, 75))
    + f" from {RANKED} group by key_column, key_value",
    "p2_key_severities": f"select key_column, key_value, lower(trim(coalesce(severity, 'warning'))) severity, count(*) n_rows from {KEYED} group by all",
    "p2_key_locations": f"select key_column, key_value, sum(n)::bigint n_rows, count(*) n_distinct from (select key_column, key_value, file_path, {', '.join(LOCATION)}, count(*) n from {KEYED} group by all) group by all",
    "p6_found": f"with {STATES} select * from diff where change is not null and from_no in (select n from pairs)",
    "p6_change_counts": f"with {STATES} select from_no, to_no, rule_id, change, count(*) n from diff where change is not null and from_no in (select n from pairs) group by all",
}

#: The delivered trees as rows in DuckDB: unwrapped, latest readable, walked by a recursive query. `path` orders nodes.
TREES = """with recursive once as (select tree_id, delivered_at, doc from uast_trees where doc is not null and json_valid(doc)),
un as (select tree_id, delivered_at, doc raw, doc from once union all select tree_id, delivered_at, raw, json_extract_string(doc, '$') from un where json_valid(doc) and json_type(doc) = 'VARCHAR'),
good as (select tree_id, delivered_at, raw, doc from un where json_valid(doc) and json_type(doc) = 'OBJECT' and json_type(doc, '$.root') = 'OBJECT'),
latest as (select tree_id, doc::json doc from good qualify row_number() over (partition by tree_id order by delivered_at desc nulls last, raw desc) = 1),
walk as (select tree_id, []::int[] path, json_extract(doc, '$.root') node from latest
 union all select tree_id, list_append(path, k.i::int), k.c from (select tree_id, path, unnest(list_transform(list_filter(case json_type(node, '$.children') when 'ARRAY' then json_extract(node, '$.children[*]') when 'OBJECT' then [json_extract(node, '$.children')] else []::json[] end, lambda x: json_type(x) = 'OBJECT'), lambda x, i: {{'i': i, 'c': x}})) k from walk)),
numbered as (select tree_id, path, node, (row_number() over (partition by tree_id order by path) - 1)::int node_no, len(path) depth from walk),
t as (select n.tree_id, n.node_no, coalesce(p.node_no, -1) parent_no, n.depth, n.path, n.node, case when json_type(n.node, '$.kind') is null or json_type(n.node, '$.kind') = 'NULL' then 'Unknown' else n.node->>'$.kind' end kind
 from numbered n left join numbered p on p.tree_id = n.tree_id and n.depth > 0 and p.path = n.path[1:n.depth - 1]) """.replace("{{", "{").replace("}}", "}")
BELOW = "d.tree_id = a.tree_id and d.depth > a.depth and d.path[1:a.depth] = a.path"
SQL |= {
    "p4_found": TREES + "select tree_id, node_no, parent_no, kind from t",
    "p4_calls_in_functions": TREES + f"select a.tree_id, a.node_no outer_no, d.node_no inner_no from t a join t d on {BELOW} where a.kind = 'FunctionDeclaration' and d.kind = 'CallExpression'",
    "p4_intervals": TREES + f"select a.tree_id, a.node_no, (a.node_no + count(d.node_no))::int last_no, (a.node_no - a.depth + count(d.node_no))::int post_no, a.depth::int as depth from t a left join t d on {BELOW} group by a.tree_id, a.node_no, a.depth",
}
