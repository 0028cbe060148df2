"""Queries for the engine's own operators, over the delivered node, rule and finding tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from ..operators import fixes, nested, patterns, rules as rl, sexpr, stats, tree
from ..session import cut, table
from ..sources import frontends, rules as rule_source, sinks

KEY = ["file_id", "node_id"]


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return tree.once(table(spark, d, "uast_nodes"))


def findings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings")


def kept_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_scans")
    last = f.groupBy("file_id").agg(F.max(F.struct("scanned_at", "ingested_at", "path", "content")).alias("s"))
    return last.select("file_id", "s.path", schema.language_of_path(F.col("s.path")).alias("language"), "s.content")


QUERIES: dict = {}
SQL: dict[str, str] = {}

N = "with recursive n as (select distinct on (file_id, node_id) * from uast_nodes)"
#: Proper ancestors of every node, by following parents.
UP = N + ", up as (select file_id, node_id, parent_id anc from n where parent_id is not null union all select u.file_id, u.node_id, n.parent_id from up u join n on n.file_id = u.file_id and n.node_id = u.anc where n.parent_id is not null)"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def keys_query(name: str, make, sql: str | None, own: bool = False) -> None:
    """Register a query whose result is the keys of nodes.

    With `own` the node itself decides: the filter goes to the scan, and repeated rows (which are
    equal) fall together only afterwards, as keys.
    """

    def fn(spark: SparkSession, d: str) -> DataFrame:
        if own:
            return make(table(spark, d, "uast_nodes")).select(*KEY).distinct()
        return make(nodes(spark, d)).select(*KEY)

    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = sql


def found(pattern: str, n: DataFrame) -> DataFrame:
    return patterns.find(n, patterns.parse(pattern))


def select(where: str) -> str:
    return f"{N} select file_id, node_id from n where {where}"


def kind(k: str):
    return F.col("kind") == k


# ---------------------------------------------------------------- patterns on the node itself
keys_query("kind_find", partial(found, "CallExpression"), select("kind = 'CallExpression'"), own=True)
keys_query("kind_find_any_case", lambda n: tree.find_kinds(n, "linecomment", "COMMENT"), select("lower(kind) in ('linecomment', 'comment')"), own=True)
keys_query("native_find", lambda n: tree.find_native(n, "binary_expression"), select("native_type = 'binary_expression'"), own=True)
keys_query("native_pattern", partial(found, "call_expression"), select("native_type = 'call_expression' or (native_type is null and kind = 'CallExpression')"), own=True)
keys_query("literal_int", partial(found, "71"), select("regexp_matches(text, '^[+-]?[0-9]+$') and try_cast(text as bigint) = 71"), own=True)
keys_query("literal_float", partial(found, "15.0"), select("regexp_matches(text, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') and abs(try_cast(text as double) - 15.0) < 2.220446049250313e-16"), own=True)
keys_query("literal_string", partial(found, "'probe_view'"), select("text = 'probe_view' or name = 'probe_view'"), own=True)
keys_query("literal_bool", partial(found, "true"), select("lower(text) = 'true'"), own=True)
keys_query("literal_null", partial(found, "null"), select("lower(text) in ('null', 'nil', 'none')"), own=True)
keys_query("wildcard_named", lambda n: found("$_", n.where("is_named")), select("is_named"), own=True)
keys_query("any_pattern", lambda n: patterns.find(n, patterns.AnyOf((patterns.parse("BinaryExpression"), patterns.parse("'scope'")))), select("kind = 'BinaryExpression' or text = 'scope' or name = 'scope'"), own=True)
keys_query("not_pattern", lambda n: patterns.find(n, patterns.Not(patterns.parse("Identifier"))), select("kind is null or kind <> 'Identifier'"), own=True)
keys_query("structure_properties", lambda n: patterns.find(n, patterns.Structure("VariableDeclaration", {"isLet": None})), select("lower(kind) = 'variabledeclaration' and properties['isLet'] is not null"), own=True)
# ---------------------------------------------------------------- relations
rule = lambda **d: (lambda n: rl.matching(n, d, "*"))
FUNCTION = "kind in ('FunctionDeclaration', 'MethodDeclaration')"


def with_last(make):
    return lambda n: make(tree.with_intervals(n))


keys_query("regex_rule", rule(kind="Identifier", regex="^(probe|meter)_"), select("kind = 'Identifier' and regexp_matches(coalesce(text, name), '^(probe|meter)_')"), own=True)
keys_query("inside_kind", with_last(rule(kind="CallExpression", inside={"kind": "FunctionDeclaration"})), UP + " select distinct c.file_id, c.node_id from n c join up u using (file_id, node_id) join n a on a.file_id = u.file_id and a.node_id = u.anc where c.kind = 'CallExpression' and a.kind = 'FunctionDeclaration'")
keys_query("inside_neighbor", rule(kind="CallExpression", inside={"kind": "FunctionDeclaration", "stopBy": "neighbor"}), f"{N} select c.file_id, c.node_id from n c join n a on a.file_id = c.file_id and a.node_id = c.parent_id where c.kind = 'CallExpression' and a.kind = 'FunctionDeclaration'")
keys_query("not_inside", with_last(rule(kind="StringLiteral", notInside={"kind": "CallExpression"})), UP + " select c.file_id, c.node_id from n c where c.kind = 'StringLiteral' and not exists (select 1 from up u join n a on a.file_id = u.file_id and a.node_id = u.anc where u.file_id = c.file_id and u.node_id = c.node_id and a.kind = 'CallExpression')")
keys_query("has_end", with_last(rule(kind="FunctionDeclaration", has={"kind": "BinaryExpression"})), UP + " select distinct a.file_id, a.node_id from n c join up u using (file_id, node_id) join n a on a.file_id = u.file_id and a.node_id = u.anc where c.kind = 'BinaryExpression' and a.kind = 'FunctionDeclaration'")
keys_query("has_neighbor", rule(kind="ArgumentList", has={"kind": "StringLiteral", "stopBy": "neighbor"}), f"{N} select distinct a.file_id, a.node_id from n c join n a on a.file_id = c.file_id and a.node_id = c.parent_id where c.kind = 'StringLiteral' and a.kind = 'ArgumentList'")
keys_query("not_has", with_last(rule(kind="MethodDeclaration", notHas={"kind": "CallExpression"})), UP + " select a.file_id, a.node_id from n a where a.kind = 'MethodDeclaration' and not exists (select 1 from up u join n c on c.file_id = u.file_id and c.node_id = u.node_id where u.file_id = a.file_id and u.anc = a.node_id and c.kind = 'CallExpression')")
SIBLINGS = "{n} select distinct a.file_id, a.node_id from n a join n b on b.file_id = a.file_id and b.parent_id = a.parent_id and {order} where a.kind = 'CallExpression' and b.kind = 'VariableDeclaration'"
for _name, _key, _order in (("precedes", "precedes", "b.sib_idx > a.sib_idx"), ("precedes_immediate", "precedes", "b.sib_idx = a.sib_idx + 1"), ("follows", "follows", "b.sib_idx < a.sib_idx"), ("follows_immediate", "follows", "b.sib_idx = a.sib_idx - 1")):
    keys_query(_name, rule(kind="CallExpression", **{_key: {"kind": "VariableDeclaration", "immediate": _name.endswith("immediate")}}), SIBLINGS.format(n=N, order=_order))
keys_query("any_rule", rule(any=[{"kind": "NumberLiteral"}, {"pattern": "'scope'"}]), select("lower(kind) = 'numberliteral' or native_type = 'NumberLiteral' or text = 'scope' or name = 'scope'"), own=True)
keys_query("all_rule", rule(all=[{"kind": "Identifier"}, {"regex": "_state$"}, {"not": {"regex": "^probe"}}]), select("kind = 'Identifier' and regexp_matches(coalesce(text, name), '_state$') and not regexp_matches(coalesce(text, name), '^probe')"), own=True)
keys_query("not_rule", rule(**{"not": {"any": [{"kind": "Identifier"}, {"kind": "StringLiteral"}]}}), select("kind is null or kind not in ('Identifier', 'StringLiteral')"), own=True)
keys_query("nested_relations", with_last(rule(any=[{"kind": "CallExpression", "inside": {"kind": "MethodDeclaration"}}, {"kind": "Comment", "precedes": {"kind": "CallExpression"}}])), UP + " select distinct c.file_id, c.node_id from n c where (c.kind = 'CallExpression' and exists (select 1 from up u join n a on a.file_id = u.file_id and a.node_id = u.anc where u.file_id = c.file_id and u.node_id = c.node_id and a.kind = 'MethodDeclaration')) or (c.kind = 'Comment' and exists (select 1 from n b where b.file_id = c.file_id and b.parent_id = c.parent_id and b.sib_idx > c.sib_idx and b.kind = 'CallExpression'))")
keys_query("constraint_not_regex", lambda n: n.where(kind("Identifier") & rl.constraint_test({"notRegex": "_(state|view)$", "not": {"regex": "^a"}})), select("kind = 'Identifier' and not coalesce(regexp_matches(coalesce(text, name), '_(state|view)$'), false) and not coalesce(regexp_matches(coalesce(text, name), '^a'), false)"), own=True)


@query(f"{N}, h as (select file_id, node_id, start_offset, end_offset, case when kind = 'VariableDeclaration' then 0 else 1 end alternative from n where kind in ('VariableDeclaration', 'CallExpression')), r as (select *, row_number() over (partition by file_id, start_offset, end_offset order by alternative, node_id) rn from h) select file_id, node_id, alternative from r where rn = 1")
def any_span_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return rl.span_dedupe(nodes(spark, d), [kind("VariableDeclaration"), kind("CallExpression")])


# ---------------------------------------------------------------- sequences
FIRST, LAST = patterns.Structure("ArgumentList", {}, (patterns.Kind("StringLiteral"), patterns.Meta("REST", True, 0))), patterns.Structure("ArgumentList", {}, (patterns.Meta("HEAD", True, 0), patterns.Kind("Identifier")))


@query(f"{N} select p.file_id, p.node_id, 'REST' as name, string_agg(coalesce(c.text, c.name, ''), ', ' order by c.sib_idx) filter (c.sib_idx > 0) as text from n p join n c on c.file_id = p.file_id and c.parent_id = p.node_id where p.kind = 'ArgumentList' group by p.file_id, p.node_id having max(case when c.sib_idx = 0 and c.kind = 'StringLiteral' then 1 else 0 end) = 1".replace("string_agg(coalesce(c.text, c.name, ''), ', ' order by c.sib_idx) filter (c.sib_idx > 0)", "coalesce(string_agg(coalesce(c.text, c.name, ''), ', ' order by c.sib_idx) filter (c.sib_idx > 0), '')"))
def sequence_greedy(spark: SparkSession, d: str) -> DataFrame:
    return patterns.find(nodes(spark, d), FIRST).select(*KEY, F.explode("captures").alias("c")).select(*KEY, "c.name", "c.text")


keys_query("sequence_last", lambda n: patterns.find(n, LAST), f"{N}, l as (select p.file_id, p.node_id, arg_max(c.kind, c.sib_idx) k from n p join n c on c.file_id = p.file_id and c.parent_id = p.node_id where p.kind = 'ArgumentList' group by all) select file_id, node_id from l where k = 'Identifier'")


@query(f"{N}, f as (select a.file_id, a.parent_id, a.text t from n a where a.kind = 'Identifier' and a.sib_idx = 0) select b.file_id, b.parent_id as node_id from n b join n p on p.file_id = b.file_id and p.node_id = b.parent_id join f on f.file_id = b.file_id and f.parent_id = b.parent_id where p.kind = 'ArgumentList' and p.child_count = 2 and b.sib_idx = 1 and b.kind = 'Identifier' and (b.text = f.t)")
def backreference(spark: SparkSession, d: str) -> DataFrame:
    twice = patterns.Structure("ArgumentList", {}, (patterns.AllOf((patterns.Kind("Identifier"), patterns.Meta("X"))), patterns.AllOf((patterns.Kind("Identifier"), patterns.Meta("X")))))
    return patterns.find(nodes(spark, d), twice).select(*KEY)


# ---------------------------------------------------------------- navigation
@query(f"{N} select c.file_id, c.node_id, c.sib_idx from n c join n p on p.file_id = c.file_id and p.node_id = c.parent_id where p.kind = 'FunctionDeclaration'")
def children_of(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return tree.children(n, n.where(kind("FunctionDeclaration"))).select(*KEY, "sib_idx")


@query(f"{N} select distinct p.file_id, p.node_id from n c join n p on p.file_id = c.file_id and p.node_id = c.parent_id where c.kind = 'NumberLiteral'")
def parents_of(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return tree.parents(n, n.where(kind("NumberLiteral"))).select(*KEY)


@query(f"{N}, s as (select file_id, node_id, lead(node_id) over (partition by file_id, parent_id order by sib_idx) sibling_id from n where parent_id is not null) select * from s where sibling_id is not null")
def next_siblings(spark: SparkSession, d: str) -> DataFrame:
    return tree.siblings(nodes(spark, d), 1)


@query(f"{N}, s as (select file_id, node_id, lag(node_id) over (partition by file_id, parent_id order by sib_idx) sibling_id from n where parent_id is not null) select * from s where sibling_id is not null")
def previous_siblings(spark: SparkSession, d: str) -> DataFrame:
    return tree.siblings(nodes(spark, d), -1)


@query(UP + " select u.file_id, u.node_id, max(a.node_id) ancestor_id from up u join n a on a.file_id = u.file_id and a.node_id = u.anc where a.kind in ('FunctionDeclaration', 'MethodDeclaration') group by all")
def nearest_ancestor(spark: SparkSession, d: str) -> DataFrame:
    return tree.nearest_ancestor(nodes(spark, d), kind("FunctionDeclaration") | kind("MethodDeclaration"))


@query(UP + " select n.file_id, n.node_id, coalesce((select max(u.node_id) from up u where u.file_id = n.file_id and u.anc = n.node_id), n.node_id) last_id from n")
def node_intervals(spark: SparkSession, d: str) -> DataFrame:
    return tree.with_intervals(nodes(spark, d)).select(*KEY, "last_id")


@query(UP + " select a.file_id, a.node_id, count(c.node_id) n_below from n a left join up u on u.file_id = a.file_id and u.anc = a.node_id left join n c on c.file_id = u.file_id and c.node_id = u.node_id and c.kind = 'Identifier' group by all")
def count_descendants(spark: SparkSession, d: str) -> DataFrame:
    return tree.count_below(tree.with_intervals(nodes(spark, d)), kind("Identifier"))


@query(UP + " select u.file_id, u.anc above_id, u.node_id from up u join n a on a.file_id = u.file_id and a.node_id = u.anc where a.kind = 'MethodDeclaration'")
def descendants_of(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return tree.descendants(n, n.where(kind("MethodDeclaration")))


@query(f"{N}, r as (select file_id, start_offset s, end_offset e from n where node_id = 1) select n.file_id, min(n.node_id) node_id from n join r on r.file_id = n.file_id and n.start_offset = r.s and n.end_offset = r.e group by all")
def node_by_range(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    r = n.where("node_id = 1").select("file_id", F.col("start_offset").alias("s"), F.col("end_offset").alias("e"))
    return tree.node_at(n.join(r, "file_id"), F.col("s"), F.col("e"))


@query(f"{N} select file_id, node_id, depth from n where is_named and depth <= 2")
def walk_named(spark: SparkSession, d: str) -> DataFrame:
    return stats.filter_nodes(tree.walk(nodes(spark, d), named=True), max_depth=2).select(*KEY, "depth")


@query()
def subtree_digests(spark: SparkSession, d: str) -> DataFrame:
    """Structurally equal calls: digest and how many there are."""
    n = nodes(spark, d)
    calls = tree.subtree_digest(n).join(n.where(kind("CallExpression")).select(*KEY), KEY, "left_semi")
    return calls.groupBy("digest").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"{N} select kind, case when kind in ('FunctionDeclaration', 'MethodDeclaration', 'VariableDeclaration') then 'declaration' when kind in ('BinaryExpression', 'CallExpression', 'Identifier', 'StringLiteral', 'NumberLiteral') then 'expression' end category, count(*) n_nodes, count(*) filter (native_type in ('comment', 'line_comment', 'block_comment', 'doc_comment') or ends_with(native_type, '_comment')) n_comments from n group by all")
def kind_categories(spark: SparkSession, d: str) -> DataFrame:
    c = F.count_if(F.coalesce(tree.is_comment(F.col("native_type")), F.lit(False)))
    return nodes(spark, d).groupBy("kind", schema.kind_category(F.col("kind")).alias("category")).agg(F.count(F.lit(1)).alias("n_nodes"), c.alias("n_comments"))


# ---------------------------------------------------------------- S-expression queries
def query_rows(spark: SparkSession, d: str, text: str) -> DataFrame:
    q = sexpr.run(nodes(spark, d), text)
    return q.select(*KEY, "pattern_index", F.posexplode("captures").alias("at", "c")).select(*KEY, "pattern_index", "at", "c.capture", F.col("c.node_id").alias("capture_id"), tx.preview(F.coalesce("c.text", F.lit(""))).alias("text"))


PREVIEW = "case when length(split_part(coalesce({0}, ''), chr(10), 1)) > 100 then substr(split_part(coalesce({0}, ''), chr(10), 1), 1, 100) || '...' else split_part(coalesce({0}, ''), chr(10), 1) end"


@query(f"{N}, m as (select c.file_id, c.node_id, i.node_id i_id, i.text i_text, a.node_id a_id, a.text a_text from n c join n i on i.file_id = c.file_id and i.parent_id = c.node_id and i.native_type = 'identifier' join n a on a.file_id = c.file_id and a.parent_id = c.node_id and a.native_type = 'arguments' and a.sib_idx > i.sib_idx where c.native_type = 'call_expression') select file_id, node_id, 0 pattern_index, 0 as at, 'f' capture, i_id capture_id, {PREVIEW.format('i_text')} as text from m union all select file_id, node_id, 0, 1, 'a', a_id, {PREVIEW.format('a_text')} from m")
def sexpr_query(spark: SparkSession, d: str) -> DataFrame:
    return query_rows(spark, d, "(call_expression (identifier) @f (arguments) @a)")


@query(f"{N} select v.file_id, v.node_id, 0 pattern_index, 0 as at, 'n' capture, i.node_id capture_id, {PREVIEW.format('i.text')} as text from n v join n i on i.file_id = v.file_id and i.parent_id = v.node_id and i.native_type = 'identifier' where v.native_type = 'variable_declarator' and regexp_matches(coalesce(i.text, i.name, ''), '^(probe|scope)_') and coalesce(i.text, i.name, '') <> 'probe_view'")
def sexpr_predicates(spark: SparkSession, d: str) -> DataFrame:
    return query_rows(spark, d, '((variable_declarator (identifier) @n) (#match? @n "^(probe|scope)_") (#not-eq? @n "probe_view"))')


@query(f"{N} select a.file_id, a.node_id, 0 pattern_index, 0 as at, 'l' capture, c.node_id capture_id, {PREVIEW.format('c.text')} as text from n a join n c on c.file_id = a.file_id and c.parent_id = a.node_id and c.native_type in ('string', 'number') where a.native_type = 'arguments' union all select file_id, node_id, 1, 0, 'b', node_id, {PREVIEW.format('text')} from n where native_type = 'binary_expression'")
def sexpr_alternation(spark: SparkSession, d: str) -> DataFrame:
    return query_rows(spark, d, "(arguments [(string) (number)] @l) (binary_expression) @b")


@query(f"{N} select a.file_id, a.node_id, 0 pattern_index, (row_number() over (partition by a.file_id, a.node_id order by c.sib_idx) - 1)::int as at, 's' capture, c.node_id capture_id, {PREVIEW.format('c.text')} as text from n a join n c on c.file_id = a.file_id and c.parent_id = a.node_id and c.native_type = 'string' where a.native_type = 'arguments'")
def sexpr_quantifier(spark: SparkSession, d: str) -> DataFrame:
    return query_rows(spark, d, "(arguments (string)+ @s)")


ITEMS = "from n a join n x on x.file_id = a.file_id and x.parent_id = a.node_id and x.native_type = 'variable_declarator' where a.native_type = 'function_definition'"


@query(f"{N}, m as (select a.file_id, a.node_id, x.node_id x_id, x.sib_idx x_sib, coalesce(x.text, '') x_text, (select list({{'id': s.node_id, 't': coalesce(s.text, '')}} order by s.sib_idx) from n s where s.file_id = a.file_id and s.parent_id = a.node_id and s.native_type = 'comment' and s.sib_idx < x.sib_idx) ss {ITEMS}), k as (select * from m where len(ss) > 0) select file_id, node_id, 0 pattern_index, 's' capture, v.id capture_id, len(ss) n_before from k, unnest(ss) u(v) union all select file_id, node_id, 0, 'n', x_id, len(ss) from k")
def sexpr_order(spark: SparkSession, d: str) -> DataFrame:
    """Comments before a declaration in a function: repeated children keep their place among the others."""
    q = sexpr.run(nodes(spark, d), "(function_definition (comment)+ @s (variable_declarator) @n)").withColumn("n_before", (F.size("captures") - 1).cast("bigint"))
    return q.select(*KEY, "pattern_index", "n_before", F.explode("captures").alias("c")).select(*KEY, "pattern_index", "c.capture", F.col("c.node_id").alias("capture_id"), "n_before")


@query(f"{N}, k as (select a.file_id, a.node_id, x.node_id x_id from n a join n x on x.file_id = a.file_id and x.parent_id = a.node_id and x.sib_idx = a.child_count - 1 and x.native_type = 'string' where a.native_type = 'arguments') select file_id, node_id, x_id capture_id from k")
def sexpr_anchor(spark: SparkSession, d: str) -> DataFrame:
    return sexpr.run(nodes(spark, d), "(arguments (string) @s .)").select(*KEY, F.explode("captures.node_id").alias("capture_id"))


# ---------------------------------------------------------------- counts, strings, digests, fields
@query(f"{N} select count(*) n_matches from n where kind = 'CallExpression'")
def count_matches(spark: SparkSession, d: str) -> DataFrame:
    return stats.match_count(found("CallExpression", nodes(spark, d)))


@query(f"{N} select exists(select 1 from n where kind = 'CallExpression') any_call, exists(select 1 from n where kind = 'NoSuchKind') any_other")
def any_matches(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return spark.createDataFrame([(stats.any_match(found("CallExpression", n)), stats.any_match(tree.find_kinds(n, "NoSuchKind")))], "any_call boolean, any_other boolean")


keys_query("string_nodes", lambda n: n.where(tree.is_string(F.col("native_type"))), select("native_type in ('string', 'string_literal', 'template_string', 'raw_string_literal') or ends_with(native_type, '_string') or ends_with(native_type, '_string_literal')"), own=True)
keys_query("error_nodes", lambda n: n.where(tree.is_error(F.col("native_type"))), select("native_type = 'ERROR' or starts_with(native_type, 'MISSING')"), own=True)
keys_query("metavariable_named", partial(found, "$X"), select("true"), own=True)


@query(UP + " select u.file_id, u.anc node_id, min(c.node_id) first_id from up u join n a on a.file_id = u.file_id and a.node_id = u.anc join n c on c.file_id = u.file_id and c.node_id = u.node_id where a.kind = 'FunctionDeclaration' and c.kind = 'CallExpression' group by all")
def first_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The first call below each function."""
    n = nodes(spark, d)
    below = tree.descendants(n, n.where(kind("FunctionDeclaration"))).join(n.where(kind("CallExpression")).select(*KEY), KEY, "left_semi")
    return below.groupBy("file_id", F.col("above_id").alias("node_id")).agg(F.min("node_id").alias("first_id"))


@query("select rule_id, min_by(severity, (file_path, start_line, start_column, ordinal)) severity from (select rule_id, coalesce(severity, 'warning') severity, coalesce(file_path, '') file_path, start_line, start_column, message || '|' || end_line || '|' || end_column || '|' || ingested_at::date::varchar || '|' || coalesce(severity, 'warning') ordinal from findings where rule_id is not null) group by rule_id")
def first_severities(spark: SparkSession, d: str) -> DataFrame:
    """The severity at each rule's first place."""
    f = findings(spark, d).withColumn("severity", F.coalesce("severity", F.lit("warning"))).withColumn("file_path", F.coalesce("file_path", F.lit("")))
    ordinal = F.concat_ws("|", "message", "end_line", "end_column", F.to_date("ingested_at").cast("string"), "severity")
    return stats.first_severity(f.withColumn("ordinal", ordinal))


@query("select lower(trim(coalesce(severity, 'warning'))) severity, count(*) n from findings where lower(trim(coalesce(severity, 'warning'))) = 'error' group by all")
def severity_exact(spark: SparkSession, d: str) -> DataFrame:
    f = stats.at_least(findings(spark, d), "error", exact=True)
    return f.groupBy(F.lower(F.trim(F.coalesce("severity", F.lit("warning")))).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("select distinct capture_id, replace(replace(replace(text, chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') as escaped from captures")
def escaped_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captures").select("capture_id", tx.escape(F.col("text")).alias("escaped")).distinct()


@query("select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 as last_line, length(text) - case when contains(text, chr(10)) then length(text) - instr(reverse(text), chr(10)) + 1 else 0 end as last_column from documents where text is not null")
def end_positions(spark: SparkSession, d: str) -> DataFrame:
    """Line and column at the end of every whole text."""
    t, n = F.col("text"), F.length("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.offset_to_line(t, n).alias("last_line"), tx.offset_to_column(t, n).alias("last_column"))


@query(f"{N}, r as (select distinct file_id, start_offset s, end_offset e, node_id asked from n where node_id % 100 = 0) select r.file_id, r.asked, min(n.node_id) node_id from r join n on n.file_id = r.file_id and n.start_offset = r.s and n.end_offset = r.e group by all")
def nodes_by_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The first node with the range of every node whose id is divisible by 100."""
    n = nodes(spark, d)
    asked = n.where("node_id % 100 = 0").select("file_id", "start_offset", "end_offset", F.col("node_id").alias("asked"))
    return n.join(asked, ["file_id", "start_offset", "end_offset"]).groupBy("file_id", "asked").agg(F.min("node_id").alias("node_id"))


# ---------------------------------------------------------------- rules
RULES = f"""r as (select rule_id, case when language = '*' then null else language end lang, lower(coalesce(severity, 'warning')) severity, coalesce(message, rule_id) message, fix,
 regexp_extract(rule_json, '\\$([A-Z]+)', 1) var, contains(rule_json, 'inside') needs from scan_rules where enabled),
 hit as (select n.file_id, n.node_id, r.rule_id, r.severity, r.message, r.fix, r.var, coalesce(n.text, n.name, '') v from n join r on r.lang is null or r.lang = n.language
 where not r.needs or exists (select 1 from up u join n a on a.file_id = u.file_id and a.node_id = u.anc where u.file_id = n.file_id and u.node_id = n.node_id and a.kind = 'FunctionDeclaration'))"""


def table_scan(spark: SparkSession, d: str, **options) -> DataFrame:
    rules = rule_source.from_frame(table(spark, d, "scan_rules"))
    return rl.scan(tree.with_intervals(nodes(spark, d)), rules, **options)


@query(UP + f", {RULES} select rule_id, severity, count(*) n_findings, count(distinct file_id) n_files from hit group by all")
def rule_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return table_scan(spark, d).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("file_id").alias("n_files"))


@query(UP + f", {RULES} select file_id, node_id, rule_id, replace(message, '$' || var, v) message, replace(fix, '$' || var, v) fix from hit where contains(rule_id, 'eval')")
def rule_id_filter(spark: SparkSession, d: str) -> DataFrame:
    return table_scan(spark, d, rule_id="eval").select(*KEY, "rule_id", "message", "fix")


@query(UP + f", {RULES} select severity, count(*) n_findings from hit where severity in ('warning', 'error') group by all")
def severity_minimum(spark: SparkSession, d: str) -> DataFrame:
    return table_scan(spark, d, min_severity="warning").groupBy("severity").agg(F.count(F.lit(1)).alias("n_findings"))


CONFIG = {"disableRules": ["no-eval-call", "NO-BARE-EXCEPT"], "ruleOverrides": {"no-deep-nesting": {"severity": "error"}, "no-string-concat": {"enabled": False}}}


@query("select rule_id, case when rule_id = 'no-deep-nesting' then 'error' else lower(coalesce(severity, 'warning')) end severity, enabled and rule_id not in ('no-eval-call', 'no-bare-except', 'no-string-concat') enabled from scan_rules")
def rule_overrides(spark: SparkSession, d: str) -> DataFrame:
    rules = rule_source.apply_config(rule_source.from_frame(table(spark, d, "scan_rules")), CONFIG)
    return rule_source.to_frame(spark, rules).select("rule_id", "severity", "enabled")


@query("select rule_id, replace(replace('$X in $FN', '$FN', coalesce(captures['FN'], '$FN')), '$X', coalesce(captures['X'], '$X')) message, count(*) n from findings group by all")
def message_interpolation(spark: SparkSession, d: str) -> DataFrame:
    m = tx.interpolate(F.lit("$X in $FN"), F.coalesce("captures", F.create_map().cast("map<string,string>")))
    return findings(spark, d).groupBy("rule_id", m.alias("message")).agg(F.count(F.lit(1)).alias("n"))


@query("select k as name, count(*) n, count(distinct captures[k]) n_values from findings, unnest(map_keys(captures)) t(k) group by all")
def capture_values(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d).select(F.explode("captures").alias("name", "value"))
    # distinct values first, so that a frequent capture name is spread
    once = rows.groupBy("name", "value").agg(F.count(F.lit(1)).alias("c"))
    return once.groupBy("name").agg(F.sum("c").alias("n"), F.count("value").alias("n_values"))


# ---------------------------------------------------------------- findings
@query("select file_path, count(*) n_findings from findings group by all")
def count_by_file(spark: SparkSession, d: str) -> DataFrame:
    return stats.per_file(findings(spark, d))


@query("select lower(trim(coalesce(severity, 'warning'))) severity, count(*) n_findings from findings group by all union all select 'total', count(*) from findings")
def severity_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.severity_summary(findings(spark, d))


@query("select rule_id, severity, count(*) n_findings from (select coalesce(rule_id, '') rule_id, lower(trim(coalesce(severity, 'warning'))) severity from findings) group by rollup (rule_id, severity)")
def rule_severity_rollup(spark: SparkSession, d: str) -> DataFrame:
    return stats.rule_severity_rollup(findings(spark, d))


@query("select lower(trim(coalesce(severity, 'warning'))) severity, count(*) n from findings where lower(trim(coalesce(severity, 'warning'))) in ('warning', 'error') group by all")
def severity_filter(spark: SparkSession, d: str) -> DataFrame:
    f = stats.at_least(findings(spark, d), "warning")
    return f.groupBy(F.lower(F.trim(F.coalesce("severity", F.lit("warning")))).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{N}, c as (select native_type, count(*) n_nodes from n group by all) select native_type, n_nodes, n_nodes / (select sum(n_nodes) from c)::double share from c order by n_nodes desc, native_type nulls first limit 5")
def node_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(nodes(spark, d), top=5)


@query("select distinct rule_id from findings where rule_id is not null")
def distinct_rules(spark: SparkSession, d: str) -> DataFrame:
    return stats.distinct_values(findings(spark, d), "rule_id")


@query("with o as (select distinct snapshot_no, rule_id, file_path, start_line, start_column from findings where file_path is not null), r as (select *, row_number() over (partition by file_path order by start_line, start_column, rule_id nulls first, snapshot_no) rank from o) select file_path, start_line, start_column, rule_id, snapshot_no, rank from r where rank <= 2")
def first_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d).where("file_path is not null").select("snapshot_no", "rule_id", "file_path", "start_line", "start_column").distinct()
    return stats.first_in_group(rows, ["file_path"], ["start_line", "start_column", "rule_id", "snapshot_no"], 2).select("file_path", "start_line", "start_column", "rule_id", "snapshot_no", "rank")


@query("with l as (select *, row_number() over (partition by file_id order by scanned_at desc, ingested_at desc) rn from file_scans), f as (select * from l where rn = 1) select count(*) files_scanned, count(*) filter (content is null) files_skipped, (select count(distinct file_id) from captures c where c.file_id in (select file_id from f)) files_matched, (select count(*) from (select distinct * from captures) c where c.file_id in (select file_id from f)) total_matches, (select count(distinct f.file_id) from f join parse_errors e on e.scan_id = f.scan_id and e.file_path = f.path) parse_errors from f")
def scan_statistics(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_scans").groupBy("file_id").agg(F.max(F.struct("scanned_at", "ingested_at", "scan_id", "path", "content")).alias("s")).select("file_id", "s.scan_id", "s.path", "s.content")
    matches = table(spark, d, "captures").distinct().join(f.select("file_id"), "file_id", "left_semi")
    errors = f.join(table(spark, d, "parse_errors").select("scan_id", F.col("file_path").alias("path")).distinct(), ["scan_id", "path"])
    return stats.scan_stats(f, matches, errors)


# ---------------------------------------------------------------- sources and sinks
@query("select case when regexp_extract(path, '\\.([A-Za-z0-9+]+)$', 1) = 'py' then 'python' when regexp_extract(path, '\\.([A-Za-z0-9+]+)$', 1) = 'js' then 'javascript' when regexp_extract(path, '\\.([A-Za-z0-9+]+)$', 1) = 'ts' then 'typescript' when regexp_extract(path, '\\.([A-Za-z0-9+]+)$', 1) = 'rs' then 'rust' when regexp_extract(path, '\\.([A-Za-z0-9+]+)$', 1) = 'rb' then 'ruby' when regexp_extract(path, '\\.([A-Za-z0-9+]+)$', 1) = 'cs' then 'c-sharp' else regexp_extract(path, '\\.([A-Za-z0-9+]+)$', 1) end as language, count(distinct path) n_files from file_scans group by all")
def languages_by_extension(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "file_scans").select("path").distinct()
    return paths.groupBy(schema.language_of_path(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"))


URI = "replace(coalesce(file_path, 'stdin'), '\\', '/')"


@query(f"select case lower(trim(coalesce(severity, 'warning'))) when 'error' then 'error' when 'warning' then 'warning' else 'note' end as level, rule_id, {URI} as uri, start_line, start_column + 1 start_column, end_column + 1 end_column, start_offset byte_offset, greatest(end_offset - start_offset, 0) byte_length from findings where snapshot_no = 1")
def sarif_results(spark: SparkSession, d: str) -> DataFrame:
    return sinks.sarif_results(findings(spark, d).where("snapshot_no = 1")).select("level", "rule_id", "uri", "start_line", "start_column", "end_column", "byte_offset", "byte_length")


@query(f"select snapshot_no, case lower(trim(coalesce(severity, 'warning'))) when 'error' then 'error' when 'warning' then 'warning' else 'note' end as level, rule_id, {URI} as uri, start_line, start_column + 1 start_column, end_column + 1 end_column, start_offset byte_offset, greatest(end_offset - start_offset, 0) byte_length from findings")
def sarif_results_by_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Results of all snapshots, one log each; sarif_results has the first one's."""
    f = findings(spark, d)
    return sinks.sarif_results(f, "snapshot_no").select("snapshot_no", "level", "rule_id", "uri", "start_line", "start_column", "end_column", "byte_offset", "byte_length")


@query(f"select {URI} as uri, min(start_line) first_line, count(*) n_results from findings group by all")
def sarif_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return sinks.sarif_artifacts(findings(spark, d))


@query("select rule_id id, rule_id as name, case lower(coalesce(severity, 'warning')) when 'error' then 'error' when 'warning' then 'warning' else 'note' end as level, message as text, note as help, url help_uri from scan_rules")
def sarif_rules(spark: SparkSession, d: str) -> DataFrame:
    return sinks.sarif_rules(table(spark, d, "scan_rules")).drop("tags")


@query("select coalesce(file_path, '<stdin>') || ':' || start_line || ':' || (start_column + 1) || ': ' || coalesce(severity, 'null') || ' [' || coalesce(rule_id, '') || ']: ' || message || case when coalesce(fix, '') <> '' then chr(10) || '  fix: ' || fix else '' end line from findings")
def text_report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.text_lines(findings(spark, d)).select("line")


@query()
def json_report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.json_lines(findings(spark, d), detailed=True)


@query("select line from (select file_path, '  ' || start_line || ':' || (start_column + 1) || ' [' || upper(coalesce(severity, 'warning')) || '] ' || coalesce(rule_id, '') || ': ' || message as line from findings where file_path is not null union all select file_path, file_path from findings where file_path is not null group by file_path union all select file_path, count(*) || ' finding(s)' from findings where file_path is not null group by file_path)")
def grouped_report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.grouped_text(findings(spark, d).where("file_path is not null")).select("line")


@query(f"{N} select file_id, node_id, repeat(' ', depth * 2) || coalesce(kind, 'Unknown') line from n")
def tree_dump(spark: SparkSession, d: str) -> DataFrame:
    return sinks.tree_lines(nodes(spark, d), texts=False)


@query()
def parsed_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the nodes that the front ends make of the kept texts."""
    return frontends.parse(kept_files(spark, d)).groupBy("language", "front_end", "kind").agg(F.count(F.lit(1)).alias("n_nodes"))


@query()
def builtin_scan(spark: SparkSession, d: str) -> DataFrame:
    """Findings of all built-in rules in the kept texts."""
    f, rules = kept_files(spark, d), rule_source.ruleset("all")
    return rl.scan(frontends.parse(f, aims=rl.aims_of(rules)), rules).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("file_id").alias("n_files"))


@query()
def builtin_fixes(spark: SparkSession, d: str) -> DataFrame:
    """Weak hash names and open-work words replaced in the kept texts: edits per file and length of the new text."""
    f = kept_files(spark, d)
    n = frontends.parse(f)
    calls = n.where(kind("Identifier") & F.col("text").rlike("^(compute|check|emit)")).select("file_id", "start_offset", "end_offset", F.concat(F.lit("safe_"), "text").alias("fix"))
    out = fixes.apply_fixes(calls, f)
    return out.select("file_id", "n_applied", "n_skipped", F.length("new_content").alias("new_length"))


from .table_queries import BELOW, TREES  # noqa: E402


@query(TREES + f"select distinct a.tree_id file_id, a.node_no node_id from t a join t d on {BELOW} where a.kind = 'FunctionDeclaration' and d.kind = 'CallExpression'")
def delivered_tree_find(spark: SparkSession, d: str) -> DataFrame:
    """Function declarations with calls in the delivered JSON trees."""
    t = nested.flat_nodes(table(spark, d, "uast_trees"), "tree_id", F.col("delivered_at"), "doc", ("node_no", "parent_no", "last_no", "depth", "sib_no", "kind", "language", "native_type", "name", "text"))
    n = t.select(F.col("tree_id").alias("file_id"), F.col("node_no").alias("node_id"), F.when(F.col("parent_no") >= 0, F.col("parent_no")).alias("parent_id"), F.col("sib_no").alias("sib_idx"), F.col("last_no").alias("last_id"), "depth", "kind", "language", "native_type", "name", "text")
    return rl.matching(n, {"kind": "FunctionDeclaration", "has": {"kind": "CallExpression"}}, "*").select(*KEY)


# ---------------------------------------------------------------- scalar functions
@query(f"{N} select distinct kind, lower(regexp_replace(substr(kind, 1, 1) || regexp_replace(substr(kind, 2), '([A-Z])', '_\\1', 'g'), '^_', '')) snake from n")
def snake_case_kinds(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("kind", tx.snake_case(F.col("kind")).alias("snake")).distinct()


@query(f"{N} select file_id, node_id, greatest(end_offset - start_offset, 0) n_bytes, start_line || ':' || start_column || '-' || end_line || ':' || end_column span from n where kind = 'StringLiteral'")
def span_functions(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where(kind("StringLiteral")).select(*KEY, tx.span_length(F.col("start_offset"), F.col("end_offset")).alias("n_bytes"), tx.span_display().alias("span"))


@query(f"{N} select parent_id, file_id, min(start_offset) start_offset, max(end_offset) end_offset from n where parent_id is not null group by all")
def span_merge(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where("parent_id is not null").groupBy("parent_id", "file_id").agg(*tx.merge_spans()).select("parent_id", "file_id", "start_offset", "end_offset")


@query("select doc_id, length(substr(text, 1, 150)) - length(replace(substr(text, 1, 150), chr(10), '')) + 1 as line, length(list_extract(string_split(substr(text, 1, 150), chr(10)), -1)) as col from documents where length(text) >= 150")
def offset_positions(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit(150)
    return table(spark, d, "documents").where("length(text) >= 150").select("doc_id", tx.offset_to_line(F.col("text"), at).alias("line"), tx.offset_to_column(F.col("text"), at).alias("col"))


@query("select doc_id, case when length(split_part(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10), 1)) > 100 then substr(split_part(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10), 1), 1, 100) || '...' else split_part(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10), 1) end preview from documents where text is not null")
def previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query("select distinct path, case when starts_with(replace(path, '\\', '/'), 'meridian-mono/') then substr(replace(path, '\\', '/'), 15) else replace(path, '\\', '/') end relative from file_scans")
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_scans").select("path", tx.relative_path(F.col("path"), "meridian-mono").alias("relative")).distinct()


@query("select capture_id, name, case when length(split_part(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10), 1)) > 100 then substr(split_part(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10), 1), 1, 100) || '...' else split_part(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10), 1) end as text, start_row + 1 as line from (select distinct * from captures)")
def query_report(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captures").distinct().select("capture_id", "name", tx.preview(F.col("text")).alias("text"), (F.col("start_row") + 1).alias("line"))


@query("select date_trunc('day', taken_at) as day, rule_id, count(*) n_findings from findings group by all")
def findings_by_day(spark: SparkSession, d: str) -> DataFrame:
    w = F.window("taken_at", "1 day")
    return findings(spark, d).groupBy(w.alias("w"), "rule_id").agg(F.count(F.lit(1)).alias("n_findings")).select(F.col("w.start").alias("day"), "rule_id", "n_findings")
