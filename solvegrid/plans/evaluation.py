"""The catalogue, second part: scoring of answers, prompts, loaders, retrieval, features and the roster, over the texts and numbers of the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, grading, prompts, scoring
from ..functions import text as X
from ..operators import contest, evolution, features, joins, ranking, relation, scores, splits
from ..sources import datasets, runs
from ..sources.readers import table
from .adaptor import solve
from .registry import over_solve, query

# --- parts with their successor: names to compare -----------------------------------------


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with the name of the next one as other."""
    p = table(spark, sf, "part")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(after, "p_partkey")


_PAIRS = "pairs AS (SELECT a.*, b.p_name AS other, string_split(a.p_name, ' ') AS w, string_split(b.p_name, ' ') AS v FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


def _word(i: int) -> F.Column:
    return F.split("p_name", " ")[i]


def _words() -> F.Column:
    return F.split("p_name", " ")


def over_pairs(sql: str):
    return query(f"WITH {_PAIRS} {sql}")


@over_pairs("SELECT p_partkey, (p_name = CASE WHEN p_size % 2 = 0 THEN p_name ELSE other END)::INT::DOUBLE AS em FROM pairs")
def exact_match(spark, sf):
    """A name against the next one, or itself, written with other case, marks and blanks."""
    said = F.concat(F.lit(" "), F.upper(F.regexp_replace(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("other")), " ", " ,\t")), F.lit("!\n"))
    return _pairs(spark, sf).select("p_partkey", X.exact_match(F.col("p_name"), said).alias("em"))


@over_pairs("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN true ELSE (w[1] = v[1] AND w[2] = v[2]) OR (w[1] = v[2] AND w[2] = v[1]) END AS same FROM pairs")
def set_equality_answer(spark, sf):
    other = F.when(F.col("p_size") % 2 == 0, F.array(_word(1), _word(0), _word(1))).otherwise(F.split("other", " "))
    return _pairs(spark, sf).select("p_partkey", X.same_set(_words(), other).alias("same"))


@over_pairs("SELECT p_partkey, (l_hit + r_hit) / 2.0 AS f1 FROM (SELECT p_partkey, (list_contains(v, w[1]) AND w[1] <> w[2])::INT AS l_hit, list_contains(v, w[2])::INT AS r_hit FROM pairs)")
def name_token_f1(spark, sf):
    """Bag overlap of two names of two words."""
    return _pairs(spark, sf).select("p_partkey", X.token_f1(F.col("p_name"), F.col("other")).alias("f1"))


# --- extraction from texts ----------------------------------------------------------------


@query(r"SELECT conv_id, turn, regexp_replace(regexp_replace(substr(text, length(text) // 2 + 1), '^\s+', ''), '\s+$', '') AS answer FROM conversations")
def strip_thinking(spark, sf):
    """Half of each turn is a thought, which goes."""
    n = F.floor(F.length("text") / 2).cast("int")
    raw = F.concat(F.lit(" <think>"), F.left("text", n), F.lit("</think>\n"), F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)"))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.strip_thinking(raw).alias("answer"))


_CHOICES = "'(A) ' || p_name || ' (B) ' || other || chr(10) || CASE p_size % 4 WHEN 0 THEN 'Final answer: ' || chr(65 + p_size % 8) WHEN 1 THEN 'so' || chr(10) || ' ' || chr((65 + p_partkey % 8)::INT) || '.' WHEN 2 THEN 'my choice is (' || chr((65 + p_partkey % 5)::INT) || ')' ELSE lower(p_type) END"


def _letter(n) -> F.Column:
    return F.char(F.lit(65) + n)


@over_pairs(rf"""SELECT p_partkey, upper(coalesce(regexp_extract_all(t, '(?i)(?:final\s+answer|answer|choice|option)[ \t]*(?:is|:)?[ \t]*\(?[ \t]*([A-H])[ \t]*\)?', 1)[-1], regexp_extract_all(t, '(?m)^\s*\(?\s*([A-H])\s*\)?\s*(?:[.)])?\s*$', 1)[-1], regexp_extract_all(t, '\(([A-H])\)', 1)[-1])) AS letter FROM (SELECT p_partkey, {_CHOICES} AS t FROM pairs)""")
def extract_option_letter(spark, sf):
    k = F.col("p_size") % 4
    tail = F.when(k == 0, F.concat(F.lit("Final answer: "), _letter(F.col("p_size") % 8))).when(k == 1, F.concat(F.lit("so\n "), _letter(F.col("p_partkey") % 8), F.lit("."))).when(k == 2, F.concat(F.lit("my choice is ("), _letter(F.col("p_partkey") % 5), F.lit(")"))).otherwise(F.lower("p_type"))
    raw = F.concat(F.lit("(A) "), F.col("p_name"), F.lit(" (B) "), F.col("other"), F.lit("\n"), tail)
    return _pairs(spark, sf).select("p_partkey", X.option_letter(raw).alias("letter"))


@query("""SELECT c_custkey, c_custkey % 7 = c_nationkey % 7 AS same, '민법제' || c_nationkey || '조,' || lower(c_mktsegment) || '법제' || (c_custkey % 7) || '조' AS found FROM customer""")
def statute_answers(spark, sf):
    law = lambda n: F.concat(F.col("c_mktsegment"), F.lit("법 제"), n.cast("string"), F.lit("조"))
    civil = F.concat(F.lit("민법 제 "), F.col("c_nationkey").cast("string"), F.lit("조"))
    said = F.concat(F.lit("<think>형법 제1조</think>"), law(F.col("c_custkey") % 7), F.lit(", "), civil, F.lit(" 위반"))
    gold = F.array(law(F.col("c_nationkey") % 7), F.regexp_replace(civil, " ", ""))
    found = X.statutes(said, gold)
    # of the two statutes named the civil one first, as the SQL has them
    first = F.array_join(F.concat(F.filter(found, lambda x: x.startswith("민법")), F.filter(found, lambda x: ~x.startswith("민법"))), ",")
    return table(spark, sf, "customer").select("c_custkey", X.statutes_match(said, gold).alias("same"), first.alias("found"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment || ' ' || c_nationkey END AS name FROM customer")
def case_name_answers(spark, sf):
    even = F.concat(F.lit("죄명: "), F.col("c_mktsegment"), F.lit("\n정답 : '"), F.col("c_name"), F.lit("'입니다."))
    odd = F.concat(F.col("c_name"), F.lit("\n답은 "), F.col("c_mktsegment"), F.lit(" "), F.col("c_nationkey").cast("string"), F.lit("이다"))
    return table(spark, sf, "customer").select("c_custkey", X.case_name(F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd)).alias("name"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size * 4 <= 10 THEN p_size * 4 >= 9 WHEN p_size * 4 <= 100 THEN p_size * 4 >= 90 ELSE p_type = 'PROMO' AND p_name LIKE 'hot %' END
  ELSE p_type = 'PROMO' AND p_name LIKE 'hot %' END AS stops FROM part""")
def refine_may_stop(spark, sf):
    """Scores of four times a size; praise where a name is hot and a type is promoted, and a bug where it is cold."""
    word = F.when(_word(0) == "hot", "flawless").when(_word(0) == "cold", "no bugs").otherwise(_word(0))
    said = F.concat_ws(" ", F.when(F.col("p_type") == "PROMO", "Excellent,").otherwise(F.col("p_type")), word, _word(1), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\nScore: "), (F.col("p_size") * 4).cast("string"))))
    return table(spark, sf, "part").select("p_partkey", X.may_stop(said).alias("stops"))


@query("""WITH e AS (SELECT event_type AS t, value AS v, user_id % 2 = 0 AS py2, user_id % 5 = 0 AS java FROM events)
  SELECT CASE t WHEN 'view' THEN 'PASS' WHEN 'error' THEN CASE WHEN v > 20 AND py2 THEN 'py2_syntax' WHEN v > 10 AND v <= 20 THEN 'tab_error' WHEN java THEN 'java_ref' WHEN v > 20 THEN 'syntax_other' ELSE 'runtime_error' END ELSE t END AS kind, count(*) AS n FROM e GROUP BY ALL""")
def failure_census(spark, sf):
    """Events as runs of reference solutions: their type is the status, their value makes the error, their user the language."""
    status = F.when(F.col("event_type") == "view", "accepted").when(F.col("event_type") == "error", "runtime_error").otherwise(F.col("event_type"))
    error = F.concat(F.when(F.col("value") > 20, "SyntaxError at ").when(F.col("value") > 10, "TabError at ").otherwise("KeyError "), F.col("props"))
    code = F.concat(F.when(F.col("user_id") % 2 == 0, "print 1\n").otherwise(""), F.when(F.col("user_id") % 5 == 0, "import java.util").otherwise("x = 1"))
    return table(spark, sf, "events").groupBy(X.failure_kind(status, error, code).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_SEGMENTS = "(VALUES ('AUTOMOBILE', 'LiveCodeBench', 'lcb'), ('BUILDING', 'qasc', 'qasc'), ('FURNITURE', 'ACC', 'acc'), ('HOUSEHOLD', 'lbox', 'lbox'), ('MACHINERY', 'BigMath', 'asserts')) s(c_mktsegment, dataset, kind)"


def _dataset() -> F.Column:
    names = {"AUTOMOBILE": "LiveCodeBench", "BUILDING": "qasc", "FURNITURE": "ACC", "HOUSEHOLD": "lbox", "MACHINERY": "BigMath"}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("c_mktsegment"))


@query(f"SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'lcb' ELSE coalesce(kind, 'asserts') END AS kind FROM customer LEFT JOIN {_SEGMENTS} USING (c_mktsegment)")
def scoring_kind_case(spark, sf):
    """The kind that an item has itself, else that of its dataset."""
    own = F.when(F.col("c_nationkey") < 5, "LCB").otherwise("")
    return table(spark, sf, "customer").select("c_custkey", scoring.kind_of(own, _dataset()).alias("kind"))


@query(f"SELECT c_custkey, CASE WHEN dataset = 'BigMath' OR c_nationkey = 3 THEN 'math' WHEN dataset = 'qasc' THEN 'qasc' WHEN dataset = 'lbox' OR c_nationkey = 4 THEN 'lbox' ELSE 'coding' END AS family FROM customer LEFT JOIN {_SEGMENTS} USING (c_mktsegment)")
def task_family_case(spark, sf):
    domain = F.when(F.col("c_nationkey") == 3, "Math").when(F.col("c_nationkey") == 4, "LEGAL")
    return table(spark, sf, "customer").select("c_custkey", X.task_family(_dataset(), domain).alias("family"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'casename_' || lower(c_mktsegment) ELSE 'statute' END AS task, CASE WHEN c_nationkey % 2 = 1 THEN 'statute' ELSE 'casename' END AS by_id FROM customer")
def task_names(spark, sf):
    kind = F.when(F.col("c_nationkey") % 2 == 0, "casename").otherwise("statute")
    key = F.concat(kind, F.lit("_"), F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", X.task_name(kind, F.lower("c_mktsegment")).alias("task"), X.id_task(key).alias("by_id"))


_STUB = "'def ' || replace(p_name, ' ', '_') || '(' || lower(p_type) || ', n=' || p_size || '):' || chr(10) || chr(9) || '# complete this function' || chr(10) || chr(9)"
_METHOD = "'class Solution:' || chr(10) || chr(9) || 'def ' || replace(p_name, ' ', '_') || '(self, ' || lower(p_type) || '):' || chr(10) || chr(9) || chr(9) || '# complete this function' || chr(10) || chr(9) || chr(9)"


@query(f"SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 3 = 0 THEN {_METHOD} ELSE {_STUB} END AS starter_code FROM part")
def starter_code_stub(spark, sf):
    """Stubs from the definitions of reference solutions, joined by problem or id; of some the solution has another name, so there is none."""
    p = table(spark, sf, "part")
    name = F.translate("p_name", " ", "_")
    defined = F.when(F.col("p_size") % 5 == 0, "other").otherwise(name)
    code = F.concat(F.lit("import os\ndef "), defined, F.lit(" ("), F.lower("p_type"), F.lit(", n="), F.col("p_size").cast("string"), F.lit("):\n    return n"))
    key = F.col("p_partkey").cast("string")
    by_problem = F.col("p_partkey") % 2 == 0
    refs = p.select(F.when(by_problem, key).alias("problem_id"), F.when(~by_problem, key).alias("id"), code.alias("reference_code"))
    mode = F.when((F.col("p_size") % 3 == 0) & (F.col("p_size") % 5 != 0), "gfg_function").otherwise("function_call")
    rows = p.select("p_partkey", F.lit(None).cast("string").alias("problem_id"), key.alias("id"), mode.alias("eval_mode"), name.alias("entry_point"), F.array(F.lower("p_type")).alias("gfg_params"))
    return joins.starter_codes(rows, refs).select("p_partkey", "starter_code")


@query("""SELECT l_orderkey, l_linenumber, abs(l_quantity - (l_quantity + l_tax)) <= greatest(0.05 * greatest(abs(l_quantity), abs(l_quantity + l_tax)), 1e-6) AS close, l_quantity::INT = l_linenumber * 5 AS exact, l_quantity::INT = l_linenumber * 5 AS tokens, l_returnflag = l_linestatus AS folded FROM lineitem""")
def output_comparison(spark, sf):
    q = F.concat(F.lit("ok "), F.col("l_quantity").cast("string"))
    t = F.concat(F.lit("ok  "), (F.col("l_quantity") + F.col("l_tax")).cast("string"), F.lit("\n"))
    whole, other = F.col("l_quantity").cast("int").cast("string"), (F.col("l_linenumber") * 5).cast("string")
    a, b = F.concat(F.lit("Yes "), whole, F.lit(" \r\nno\n")), F.concat(F.lit("Yes "), other, F.lit("\nno"))
    c = F.concat(F.lit("Yes\n "), other, F.lit("   no"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.outputs_match(q, t, "numeric_tolerance", rel=0.05).alias("close"), X.outputs_match(a, b, "exact").alias("exact"), X.outputs_match(a, c).alias("tokens"), X.outputs_match(F.lower("l_returnflag"), F.col("l_linestatus"), "case_insensitive").alias("folded"))


@query(r"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority || '^{' || o_custkey || '}' WHEN 1 THEN o_orderpriority || ' ' || o_custkey ELSE 'just ' || o_orderstatus || o_custkey END AS answer FROM orders")
def math_answers(spark, sf):
    k, c, p = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string"), F.col("o_orderpriority")
    said = F.when(k == 0, F.concat(F.lit("Final Answer: 1\n\\boxed{0} so \\boxed{"), p, F.lit("^{"), c, F.lit("}} \\boxed{"))).when(k == 1, F.concat(F.lit("<think>\\boxed{3}</think>**final answer: "), p, F.lit(" "), c, F.lit("**\nbye"))).otherwise(F.concat(F.lit(" just "), F.col("o_orderstatus"), c))
    return table(spark, sf, "orders").select("o_orderkey", extract.column(extract.math_answer)(said).alias("answer"))


@query("""SELECT n_nationkey::VARCHAR AS id, n_regionkey = n_nationkey % 5 OR n_nationkey % 2 = 0 AS passed, CASE WHEN n_nationkey % 2 = 0 OR n_regionkey = n_nationkey % 5 THEN 'accepted' ELSE 'wrong_answer' END AS status,
  CASE WHEN n_nationkey % 2 = 0 OR n_regionkey = n_nationkey % 5 THEN 2 ELSE 1 END AS n_passed, 2 AS n_total FROM nation""")
def graded_programs(spark, sf):
    """Functions that double a nation's number; those of odd numbers add its region instead, which is right where it is that number's rest by five."""
    n, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    case = lambda x, want: F.concat(F.lit('{"input": {"value": {"args": ["'), x, F.lit('"]}}, "expected_output": {"value": ["'), want, F.lit('"]}}'))
    want = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") * 2).otherwise(F.col("n_nationkey") + F.col("n_nationkey") % 5).cast("string")
    cases = F.concat(F.lit("["), case(n, want), F.lit(", "), case(F.lit("0"), F.when(F.col("n_nationkey") % 2 == 0, "0").otherwise(r)), F.lit("]"))
    code = F.when(F.col("n_nationkey") % 2 == 0, "class Solution:\n    def f(self, x): return 2 * x").otherwise(F.concat(F.lit("def f(x): return x + "), r))
    spec = F.lit('{"eval_mode": "function_call", "entry_point": "f", "timeout_seconds": 20}')
    rows = table(spark, sf, "nation").select("n_nationkey", spec.alias("spec"), code.alias("code"), cases.alias("cases"))
    return grading.graded(rows, "n_nationkey", "spec", "code", "cases")


# --- scores by kind -----------------------------------------------------------------------


@over_pairs("""SELECT 'q' || p_partkey AS id, CASE p_size % 3 WHEN 0 THEN (p_partkey % 3 = p_size % 2) WHEN 1 THEN contains('it must be ' || p_name, CASE p_size % 2 WHEN 0 THEN p_name ELSE other END) ELSE contains(lower(p_type), CASE p_size % 2 WHEN 0 THEN p_name ELSE other END) END::INT * 100.0::DOUBLE AS pass_score FROM pairs
  UNION ALL SELECT 'l' || c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN (c_nationkey % 4 = 0) ELSE (c_custkey % 7 = c_nationkey % 7) END::INT * 100.0::DOUBLE FROM customer""")
def score_one_texts(spark, sf):
    """Science questions whose options are names, answered by letter or by text, and legal questions: through the dispatcher."""
    gold = F.col("p_size") % 2
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("The answer is ("), _letter(F.col("p_partkey") % 3), F.lit(")"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("it must be "), F.upper("p_name"))).otherwise(F.col("p_type"))
    q = _pairs(spark, sf).select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("id"), F.lit("qasc").alias("dataset"), F.concat(F.lit("Which? (A) "), F.col("p_name"), F.lit(" (B) "), F.col("other"), F.lit(" (C) none of these")).alias("instruction"), _letter(gold).alias("ground_truth"), F.lit(None).cast("string").alias("task_type"), said.alias("prediction"))
    law = lambda n: F.concat(F.col("c_mktsegment"), F.lit("법 제"), n.cast("string"), F.lit("조"))
    name = F.col("c_nationkey") % 2 == 0
    truth = F.when(name, F.col("c_name")).otherwise(F.to_json(F.array(law(F.col("c_nationkey") % 7))))
    answer = F.when(name, F.concat(F.lit("죄명: "), F.when(F.col("c_nationkey") % 4 == 0, F.lower("c_name")).otherwise("절도"))).otherwise(law(F.col("c_custkey") % 7))
    legal = table(spark, sf, "customer").select(F.concat(F.lit("l"), F.col("c_custkey").cast("string")).alias("id"), F.lit("lbox").alias("dataset"), F.lit("").alias("instruction"), truth.alias("ground_truth"), F.when(name, "casename").otherwise("statute").alias("task_type"), answer.alias("prediction"))
    return scoring.score_one(q.unionByName(legal)).select("id", "pass_score")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN n_nationkey % 2 = 0 WHEN n_regionkey = 1 THEN true WHEN n_regionkey = 2 THEN n_nationkey > 9 ELSE n_nationkey % 3 = 0 END::INT * 100.0::DOUBLE AS pass_score FROM nation")
def score_one_code(spark, sf):
    """Assertions, a check function, a specification and formulas, one kind for each region; the programs and answers come from the nations' numbers."""
    n, r, text = F.col("n_nationkey"), F.col("n_regionkey"), F.col("n_nationkey").cast("string")
    code = F.when(r == 0, F.concat(F.lit("```python\ndef f(x):\n    return x + "), (n % 2).cast("string"), F.lit("\n```"))).when(r == 1, F.concat(F.lit("def anything(x):\n    return x * "), text)).when(r == 2, F.concat(F.lit("print(int(input()) > 9)\n# "), text)).otherwise(F.concat(F.lit("\\boxed{"), (n - n % 3).cast("string"), F.lit("}")))
    case = F.concat(F.lit('[{"input": {"value": "'), text, F.lit('"}, "expected_output": {"value": "True"}}]'))
    rows = table(spark, sf, "nation").select(
        "n_nationkey",
        F.when(r == 2, "acc").when(r == 1, "humaneval").when(r == 0, "mbpp").otherwise("numina_cot").alias("dataset"),
        F.when(r > 2, "math").otherwise("coding").alias("domain"),
        F.when(r > 2, text).otherwise("").alias("ground_truth"),
        code.alias("prediction"),
        F.when(r == 2, '{"eval_mode": "stdin_stdout", "timeout_seconds": 20}').alias("eval_spec"),
        F.when(r == 2, case).alias("test_cases"),
        F.when(r == 0, F.array(F.lit("assert f(3) == 3"))).alias("test_list"),
        F.when(r == 1, F.concat(F.lit("def check(g):\n    assert g(2) == 2 * "), text)).alias("test_code"),
        F.when(r == 1, "wanted").alias("entry_point"),
    )
    return scoring.score_one(rows, seconds=20.0).select("n_nationkey", "pass_score")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN p_size % 4 = 0 WHEN 2 THEN true WHEN 3 THEN p_size = 7 ELSE false END AS same FROM part")
def formula_equality(spark, sf):
    """Fractions against decimals, floors, sums, roots and words that a size is written in."""
    n, k = F.col("p_size"), F.col("p_partkey") % 5
    text = lambda c: c.cast("string")
    a = F.concat(F.lit("$\\frac{"), text(n), F.lit("}{4}$"))
    floor = text(F.floor(n / 4).cast("int"))
    other = F.when(k == 0, text(n / 4)).when(k == 1, floor).when(k == 2, F.concat(F.lit("x = "), floor, F.lit(" + \\dfrac{"), text(n % 4), F.lit("}{4}"))).when(k == 3, F.lit("\\sqrt{49}/4")).otherwise(F.lower("p_type"))
    same = extract.column(lambda t: str(extract.equivalent(*t.split("\n"))))
    return table(spark, sf, "part").select("p_partkey", (same(F.concat(a, F.lit("\n"), other)) == "True").alias("same"))


@query("SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_regionkey = 0 THEN 'no_ref' WHEN n_regionkey = 1 THEN 'gfg_recovered' WHEN n_regionkey = 2 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'kept' ELSE 'drop_wrong_answer' END WHEN n_regionkey = 3 THEN 'drop_unsupported' ELSE 'gfg_unrecovered' END AS category FROM nation")
def self_consistent_references(spark, sf):
    """Whether reference programs pass the cases that are made of the nations' numbers; those of one region are calls in disguise."""
    n, r, text = F.col("n_nationkey"), F.col("n_regionkey"), F.col("n_nationkey").cast("string")
    case = lambda a, b: F.concat(F.lit('[{"input": {"value": "'), a, F.lit('"}, "expected_output": {"value": "'), b, F.lit('"}}]'))
    calls = case(F.concat(F.lit("k = "), text, F.lit(", arr[] = {1, 2}")), F.concat(text, F.lit(" 2")))
    cases = F.when(r.isin(1, 4), calls).otherwise(case(text, (n - n % 2).cast("string")))
    code = F.when(r == 1, "class Solution:\n    def helper(self): pass\n    def pair(self, k, arr): return [k, len(arr)]").when(r == 4, "def pair(q): return q").otherwise("print(int(input()))")
    refs = F.when(r == 0, "[]").otherwise(F.to_json(F.array(F.struct(F.lit(True).alias("is_known_correct"), F.lit("python").alias("language"), code.alias("code")))))
    spec = F.when(r == 3, '{"eval_mode": "manual"}').otherwise('{"eval_mode": "stdin_stdout", "timeout_seconds": 20}')
    rows = table(spark, sf, "nation").select(text.alias("id"), spec.alias("eval_spec"), cases.alias("test_cases"), refs.alias("reference_solutions"), F.when(r.isin(1, 4), "GeeksForGeeks").otherwise("x").alias("source_platform"))
    return grading.self_consistent(rows).select("id", "category")


@query("SELECT event_id, value > 5.0 AS positive FROM events")
def positive_scores(spark, sf):
    return table(spark, sf, "events").select("event_id", scoring.positive((F.col("value") - 5.0).cast("string")).alias("positive"))


@query("SELECT conv_id, turn, CASE conv_id % 2 WHEN 0 THEN text ELSE trim(substr(text, 1, 40), ' ' || chr(10)) END AS final FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text FROM conversations WHERE text IS NOT NULL)")
def finalized_outputs(spark, sf):
    """Answers in words stay; of code tasks the fenced block is what is left."""
    t = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))
    raw = F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("so\n```python\n"), F.left("text", F.lit(40)), F.lit("\n```\nthat is it")))
    return t.select("conv_id", "turn", scoring.finalize(raw, F.when(F.col("conv_id") % 2 == 0, "qasc").otherwise("mbpp"), F.lit(None).cast("string")).alias("final"))


# --- categories ---------------------------------------------------------------------------

_LEVELS = "(VALUES ('ECONOMY', 'algebra', 'algebra'), ('SMALL', 'statistics_and_probability', 'statistics_and_probability'), ('MEDIUM', 'calculus', 'calculus_and_precalculus'), ('PROMO', 'number_theory', 'number_theory_and_discrete_math')) a(p_type, c, m)"
_COLOURS = "(VALUES ('red', 'precalculus', 'calculus_and_precalculus'), ('blue', 'discrete_mathematics', 'number_theory_and_discrete_math'), ('hot', 'algebra', 'algebra')) b(word, c, m)"


@query(f"""WITH p AS (SELECT p_partkey, a.c AS c1, a.m AS m1, b.c AS c2, b.m AS m2 FROM part LEFT JOIN {_LEVELS} ON a.p_type = part.p_type LEFT JOIN {_COLOURS} ON b.word = string_split(p_name, ' ')[1])
  SELECT p_partkey, concat_ws('|', c1, CASE WHEN c2 IS DISTINCT FROM c1 THEN c2 END) AS seven, concat_ws('|', m1, CASE WHEN m2 IS DISTINCT FROM m1 THEN m2 END) AS five FROM p""")
def category_hierarchy(spark, sf):
    """Two paths of levels for each part, one by its type and one by its colour; some of another root, or of a level that makes no category."""
    types = {"ECONOMY": "Algebra -> Polynomials", "SMALL": "Applied Mathematics -> Statistics", "MEDIUM": "Calculus", "PROMO": "Number Theory -> Primes", "STANDARD": "Applied Mathematics -> Physics", "LARGE": "Topology"}
    words = {"red": "Precalculus", "blue": "Discrete Mathematics -> Graphs", "hot": "Algebra"}
    look = lambda t, k: F.try_element_at(F.create_map(*[F.lit(x) for pair in t.items() for x in pair]), k)
    paths = F.array(F.concat(F.lit("Mathematics -> "), look(types, F.col("p_type"))), F.concat(F.lit(" Mathematics->"), F.coalesce(look(words, _word(0)), F.lit("Alchemy"))), F.concat(F.lit("Science -> Algebra -> "), F.col("p_name")))
    c = X.math_categories(paths)
    return table(spark, sf, "part").select("p_partkey", F.array_join(c, "|").alias("seven"), F.array_join(X.merged_categories(c), "|").alias("five"))


@query("SELECT p_partkey, array_to_string(list_distinct_in_order, '|') AS path FROM (SELECT p_partkey, CASE WHEN p_brand = p_type THEN ['Mathematics', p_brand] ELSE ['Mathematics', p_brand, p_type] END AS list_distinct_in_order FROM part)")
def category_paths(spark, sf):
    path = F.concat(F.lit("Mathematics -> "), F.col("p_brand"), F.lit(" -> "), F.col("p_type"), F.lit(" -> "), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.category_path(path), "|").alias("path"))


@query("""WITH m AS (SELECT doc_id, unnest([lang, source]) AS category, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)), s AS (SELECT category, 'length_score' AS score, n_chars::DOUBLE AS v FROM m UNION ALL SELECT category, 'quality_score', quality FROM m UNION ALL SELECT category, 'clean_score', CASE WHEN toxic = 0 THEN 1 END FROM m)
  SELECT category, score, count(v) AS n, round(avg(v), 9) AS mean FROM s GROUP BY ALL""")
def category_mean_of_all_scores(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    rows = d.select(F.array("lang", "source").alias("c"), F.col("n_chars").alias("length_score"), F.col("quality").alias("quality_score"), F.when(F.col("toxic") == 0, 1).alias("clean_score"))
    return scores.category_means_of_all(rows, "c")


# --- routing replies ----------------------------------------------------------------------


@query("""WITH d AS (SELECT c_custkey, unnest(string_split((c_custkey * 7919)::VARCHAR, '')) AS c, generate_subscripts(string_split((c_custkey * 7919)::VARCHAR, ''), 1) AS i FROM customer),
  k AS (SELECT c_custkey, 'e' || c AS id, i FROM d WHERE c IN ('0', '1', '2', '4') UNION ALL SELECT c_custkey, id, 1000 + o FROM customer, (VALUES ('e0', 0), ('e1', 1), ('e2', 2), ('e4', 3)) v(id, o)),
  f AS (SELECT c_custkey, id, min(i) AS i FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY i) AS n FROM f) SELECT c_custkey, string_agg(id, ',' ORDER BY i) AS ids FROM r WHERE n <= 3 GROUP BY c_custkey""")
def routing_pad_ids(spark, sf):
    """Ranked ids from the digits of a number: unknown and repeated ones go, the roster fills up."""
    parsed = F.transform(F.split((F.col("c_custkey") * 7919).cast("string"), ""), lambda d: F.concat(F.lit("e"), d))
    full = ranking.pad_ranked_ids(parsed, F.array(*[F.lit(f"e{k}") for k in (0, 1, 2, 4)]), 3)
    return table(spark, sf, "customer").select("c_custkey", F.array_join(full, ",").alias("ids"))


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::INT BETWEEN 1 AND 40 THEN json_extract_string(props, '$.k') ELSE '1' END AS picked FROM events")
def routing_reply_ids(spark, sf):
    """The id that a reply names under the new key or the old one."""
    reply = F.regexp_replace("props", '"k": (\\d+)', F.when(F.col("event_id") % 2 == 0, '"selected_expert_id": "$1"').otherwise('"selected_critic_id": "$1"'))
    return table(spark, sf, "events").select("event_id", ranking.chosen_id(reply, F.array(*[F.lit(str(k)) for k in range(1, 41)])).alias("picked"))


# --- joins and filters --------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT -doc_id - 1 FROM labels) OR NOT EXISTS (SELECT 1 FROM documents d JOIN labels l ON d.doc_id = -l.doc_id - 1)")
def holdout_semijoin_fallback(spark, sf):
    return joins.holdout(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select((-F.col("doc_id") - 1).alias("doc_id")), "doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def head_cap(spark, sf):
    return joins.head(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT d.doc_id AS id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 0 AND source IN ('src0', 'src2')")
def tag_filter(spark, sf):
    tags = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("primary_category"), F.when(F.col("toxic") == 1, "invalid").alias("parse_status"))
    return joins.tagged(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), tags, " src0, src2,,")


@query("SELECT n_nationkey AS ordinal, n_name AS id, r_name AS system_prompt FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey > 0 UNION ALL SELECT n_nationkey, n_name, NULL FROM nation WHERE n_regionkey = 0")
def bank_with_mapping(spark, sf):
    """A bank of models, one for each nation, with the prompt of their region; some are generalists without one."""
    bank = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("id"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey").cast("string")).alias("source_expert_id"))
    mapping = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("system_prompt"))
    return joins.bank_with_mapping(bank, mapping).select("ordinal", "id", "system_prompt")


@query("SELECT d.doc_id, sha256(d.text) = sha256(coalesce(CASE WHEN d.doc_id % 3 = 0 THEN d.text ELSE b.text END, '')) AS same FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id WHERE d.text IS NOT NULL")
def digest_compare(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("t"))
    other = d.join(b, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.col("t")), F.lit("")).alias("text"))
    return runs.same_digests(d, other, "doc_id", "text")


# --- loaders ------------------------------------------------------------------------------


@query("SELECT 'casename_plain_train_' || doc_id AS id, 'plain' AS task_config, trim(text) AS facts, lang AS gold FROM documents WHERE doc_id % 5 > 0 AND trim(coalesce(text, '')) <> '' UNION ALL SELECT 'statute_plus_train_' || doc_id, 'plus', trim(text), '[\"' || source || '\"]' FROM documents WHERE doc_id % 4 > 0 AND trim(coalesce(text, '')) <> ''")
def lbox_items(spark, sf):
    """Two parts of a legal collection in one, without the rows that lack a gold answer."""
    kept, _ = datasets.lbox(_legal(spark, sf), "train")
    return kept.select("id", "task_config", "facts", F.col("ground_truth").alias("gold"))


@query("SELECT 'plain' AS task_config, count(*) FILTER (doc_id % 5 > 0 AND trim(coalesce(text, '')) <> '') AS emitted, count(*) FILTER (doc_id % 5 = 0 OR trim(coalesce(text, '')) = '') AS skipped FROM documents UNION ALL SELECT 'plus', count(*) FILTER (doc_id % 4 > 0 AND trim(coalesce(text, '')) <> ''), count(*) FILTER (doc_id % 4 = 0 OR trim(coalesce(text, '')) = '') FROM documents")
def lbox_skip_counts(spark, sf):
    return datasets.lbox(_legal(spark, sf), "train")[1]


def _legal(spark: SparkSession, sf: str) -> list[tuple[str, str, DataFrame]]:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("facts"), "lang", "source")
    names = d.select("id", "facts", F.when(F.col("id") % 5 == 0, " ").otherwise(F.col("lang")).alias("casename"))
    laws = d.select("id", "facts", F.when(F.col("id") % 4 == 0, F.array(F.lit(" "))).otherwise(F.array(F.col("source"), F.lit(""))).alias("statutes"))
    return [("casename", "plain", names), ("statute", "plus", laws)]


@query("SELECT 'math_' || lang || '_' || CASE doc_id % 2 WHEN 0 THEN 'train' ELSE 'test' END || '_' || (row_number() OVER (PARTITION BY lang, doc_id % 2 ORDER BY doc_id) - 1) AS id, lang AS topic, source AS level, doc_id AS instruction FROM documents")
def competition_items(spark, sf):
    """A union over topics and splits, numbered within each."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    parts = {}
    for topic in ("en", "fr", "de", "es"):
        for k, split in enumerate(("train", "test")):
            own = splits.ranked(d.where((F.col("lang") == topic) & (F.col("doc_id") % 2 == k)), F.least(F.col("doc_id"), F.lit(splits.SPACE - 1)), "doc_id")
            parts[topic, split] = own.select((F.col("rn") - 1).alias("ordinal"), F.col("doc_id").alias("problem"), F.lit("").alias("solution"), F.col("source").alias("level"))
    return datasets.competition(parts).select("id", "topic", "level", "instruction")


@query("SELECT 'bigmath_filtered_train_' || doc_id AS id, lang AS categories FROM documents WHERE lang IN ('de', 'es')")
def bigmath_items(spark, sf):
    """Ids by the place before the filter."""
    raw = table(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), F.lit("p").alias("problem"), F.lit("a").alias("answer"), F.col("lang").alias("categories"), "source", F.array("lang").alias("original_domain"), F.lit(0.5).alias("llama8b_solve_rate"))
    return datasets.bigmath(raw, "train", ["de", "es"]).select("id", "categories")


@query("SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'PROMO') AND (p_name LIKE 'red %' OR p_name LIKE '% ring')")
def taco_filter(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("difficulty"), F.concat(F.lit("['"), _word(0), F.lit("', '"), _word(1), F.lit("']")).alias("skill_types"))
    return datasets.taco(raw, ["SMALL", "PROMO"], ["red", "ring"]).select("p_partkey")


@query("SELECT o_orderkey AS question_id, CASE o_orderkey % 2 WHEN 0 THEN 'stdin' ELSE 'functional' END AS testtype, o_custkey::VARCHAR AS input FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate <= TIMESTAMP '1997-03-01'")
def contest_problem_dates(spark, sf):
    """Problems with parsed tests, of an inclusive range of dates."""
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "stdin").otherwise("functional")
    tests = F.concat(F.lit('[{"input": "'), F.col("o_custkey").cast("string"), F.lit('", "output": "x", "testtype": "'), kind, F.lit('"}]'))
    raw = o.select(F.col("o_orderkey").alias("question_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("contest_date"), F.lit("leetcode").alias("platform"), F.lit("easy").alias("difficulty"), tests.alias("public_test_cases"), tests.alias("private_test_cases"))
    got = datasets.contest_problems(raw, "1996-03-01", "1997-03-01")
    return got.select("question_id", F.col("private_test_cases")[0]["testtype"].alias("testtype"), F.col("public_test_cases")[0]["input"].alias("input"))


# --- samples ------------------------------------------------------------------------------


def _key(id_: str, seed: int) -> str:
    return f"(({id_} * 7919 + {seed * 104729 + 12345}) % 1000003)"


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_key('doc_id', 5)}, doc_id) <= 300 THEN 'train' ELSE 'holdout' END AS split FROM documents")
def train_holdout_by_size(spark, sf):
    return splits.train_holdout(table(spark, sf, "documents"), "doc_id", 300, 5).select("doc_id", "split")


@over_solve(f"SELECT problem_id, ordinal FROM solve QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY {_key('(problem_id * 6 + ordinal)', 9)}, ordinal) <= 2")
def random_k_experts(spark, sf):
    s = solve(spark, sf).select("problem_id", "ordinal")
    key = F.pmod((F.col("problem_id") * 6 + F.col("ordinal")) * 7919 + F.lit(9 * 104729 + 12345), F.lit(splits.SPACE))
    return splits.sample(s, "ordinal", 2, 9, ["problem_id"], key)


@query(f"SELECT vec_id FROM embeddings QUALIFY row_number() OVER (ORDER BY {_key('vec_id', 2)}, vec_id) <= 150")
def display_subsample(spark, sf):
    return splits.sample(table(spark, sf, "embeddings"), "vec_id", 150, 2).select("vec_id")


@query()
def few_shot_examples(spark, sf):
    """One past question of each user, then others up to the number of users."""
    c = table(spark, sf, "conversations").where("role = 'user' and text is not null")
    members = c.groupBy((F.col("conv_id") % 12).alias("expert_id")).agg(F.array_sort(F.collect_set(F.left("text", F.lit(500)))).alias("history"))
    return splits.few_shot(members, 3)


# --- prompts ------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN 'You are a helpful math assistant.' WHEN lang = 'fr' THEN 'You are a careful science multiple-choice solver.' ELSE 'You are an expert programmer. Give only one fenced ```python block, without any text outside it.' END AS system,
  CASE WHEN lang = 'en' THEN 'Solve the math problem step by step. Give the final answer in \\boxed{}.' WHEN lang = 'fr' THEN 'Solve the science question. End with the answer letter, from A to H.' ELSE 'Write a Python function that solves the problem. Give the code in one fenced block.' END || chr(10) || chr(10) || text AS user_text FROM documents""")
def prompt_messages(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("lang") == "en", "BigMath").when(F.col("lang") == "fr", "qasc").otherwise("mbpp").alias("dataset"))
    m = prompts.build(F.col("text"), F.col("dataset"), F.lit(None).cast("string"), F.lit("google/gemma"))
    return d.select("doc_id", m.alias("m")).select("doc_id", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("user_text"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE 'red %' THEN 'You are an expert in Euclidean, analytic, and projective geometry.' WHEN p_type = 'SMALL' THEN 'You are an expert in elementary number theory: divisibility, congruences and integer equations.' ELSE 'You are a helpful math assistant.' END AS system FROM part""")
def math_domain_prompts(spark, sf):
    """The first candidate, or level of a path, that is a known domain."""
    names = F.array(F.when(_word(0) == "red", "Mathematics -> Geometry -> x").otherwise(F.col("p_name")), F.when(F.col("p_type") == "SMALL", "Number-Theory"))
    return table(spark, sf, "part").select("p_partkey", prompts.math_system(names).alias("system"))


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS said, count(*) + (arg_min(coalesce(role, ''), turn) <> 'system')::INT AS n FROM conversations GROUP BY conv_id")
def last_user_turn(spark, sf):
    """Conversations as messages, with a system message put before them."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    m = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    full = prompts.with_system(prompts.with_system(m, F.lit("a")), F.lit("b"))
    return c.select("conv_id", prompts.last_user(full).alias("said"), F.size(full).cast("long").alias("n"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name || ', ' || p_brand WHEN 1 THEN '{\"brand\": \"' || p_brand || '\", \"name\": \"' || p_name || '\"}' ELSE p_name END AS completion FROM part")
def completions(spark, sf):
    k = F.col("p_size") % 3
    raw = F.when(k == 0, F.to_json(F.array("p_name", "p_brand"))).when(k == 1, F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", extract.column(extract.json_completion)(raw).alias("completion"))


# --- contest results ----------------------------------------------------------------------


@query("SELECT l_orderkey AS task_id, l_linenumber AS generation, l_quantity > 10 AND l_discount > 0 AS ok FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1")
def instance_grades(spark, sf):
    """Lines as generations with two tests each, regrouped by order and graded."""
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("generation")).agg(first.alias("x"))
    results = lines.select("task_id", "generation", F.array(F.when(F.col("x.l_quantity") > 10, 1).otherwise(-2), F.when(F.col("x.l_discount") > 0, 1).otherwise(-4)).alias("results"))
    grades = contest.grades(contest.regrouped(results))
    numbers = results.groupBy("task_id").agg(F.array_sort(F.collect_list("generation")).alias("g"))
    return grades.join(numbers, "task_id").select("task_id", F.inline(F.arrays_zip(F.col("g").alias("generation"), F.col("graded").alias("ok"))))


@query("SELECT conv_id, turn, conv_id % 3 = 0 AS hit FROM conversations WHERE text IS NOT NULL")
def prompt_cache_hits(spark, sf):
    """Prompts of messages; the cache has two outputs of a third of them and one output of another."""
    p = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.array(F.struct("role", F.concat_ws(" ", F.col("conv_id").cast("string"), "text").alias("content"))).alias("prompt"))
    outputs = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    cache = p.where("conv_id % 3 < 2").select(F.to_json("prompt").alias("prompt_key"), outputs.alias("outputs"))
    return contest.cached(p, cache, 2).select("conv_id", "turn", "hit")


@query("SELECT item_id AS question_id, length(text) AS n FROM benchmark")
def saved_results(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    return contest.with_saved(b.select("question_id"), b.select("question_id", F.length("text").cast("long").alias("n")))


# --- retrieval ----------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda s: length(s) > 2)"
_TF = f"""pool AS (SELECT id, term, count(*) AS tf FROM (SELECT item_id AS id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
  n AS (SELECT count(DISTINCT id) AS n FROM pool), idf AS (SELECT term, count(*) AS df, ln((max(n) + 1) / (count(*) + 1)) + 1 AS idf FROM pool, n GROUP BY term)"""
_SCORES = f"""{_TF}, q AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL),
  pw AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM pool JOIN idf USING (term)),
  qw AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM q JOIN idf USING (term)),
  s AS (SELECT qw.id AS query, pw.id AS id, round(sum(qw.w * pw.w), 9) AS nine, round(sum(qw.w * pw.w), 6) AS score FROM qw JOIN pw USING (term) GROUP BY ALL)"""


@query(f"WITH {_TF} SELECT term, df, round(idf, 9) AS idf FROM idf")
def tfidf_idf(spark, sf):
    return scores.idf(scores.terms(table(spark, sf, "benchmark"), "item_id", "text")).withColumn("idf", F.round("idf", 9))


@query(f"WITH {_SCORES} SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY nine DESC, id) AS rank FROM s QUALIFY rank <= 3")
def tfidf_topk(spark, sf):
    b, d = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    return scores.retrieve(scores.terms(d, "doc_id", "text", hashed=True), scores.terms(b, "item_id", "text"), 3, sizes=(d.count(), b.count()))


@query(f"""WITH {_SCORES}, g AS (SELECT *, id % 5 AS grp FROM s QUALIFY row_number() OVER (PARTITION BY query, id % 5 ORDER BY nine DESC, id) = 1)
  SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY nine DESC, id) AS rank FROM g QUALIFY rank <= 3""")
def retrieval_one_per_expert(spark, sf):
    b, d = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    experts = b.select(F.col("item_id").alias("id"), (F.col("item_id") % 5).alias("grp"))
    return scores.retrieve(scores.terms(d, "doc_id", "text", hashed=True), scores.terms(b, "item_id", "text"), 3, experts, sizes=(d.count(), b.count()))


# --- features -----------------------------------------------------------------------------


@over_solve("SELECT expert_id, problem_id, solved = 1 AS solved FROM solve")
def agent_solve_index(spark, sf):
    return relation.solve_index(solve(spark, sf))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("feature"), "label")


@query("""WITH s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS d FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 5 <> 0) GROUP BY i)
  SELECT vec_id, i - 1 AS dim, round((v - m) / (d + 1e-6), 6) AS z FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) JOIN s USING (i)""")
def standardize_train_fit(spark, sf):
    z = features.standardized(_vectors(spark, sf), F.col("id") % 5 != 0)
    return z.select(F.col("id").alias("vec_id"), F.posexplode("feature").alias("dim", "z")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("z", 6).alias("z"))


@query("""WITH b AS (SELECT vec_id, list_concat(embedding, list_reverse(embedding)) AS f FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)) SELECT vec_id, generate_subscripts(f, 1) - 1 AS dim, round(unnest(f)::DOUBLE, 6) AS v FROM b""")
def feature_align_concat(spark, sf):
    e = _vectors(spark, sf)
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    both = features.concatenated([features.aligned(e, ids), e.select("id", F.reverse("feature").alias("feature"))])
    return both.select(F.col("id").alias("vec_id"), F.posexplode("feature").alias("dim", "v")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("v").cast("double"), 6).alias("v"))


@query("SELECT -vec_id AS ordinal, vec_id AS id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 7 = 0")
def feature_forced_order(spark, sf):
    e = _vectors(spark, sf)
    order = e.where("id % 7 = 0").select((-F.col("id")).alias("ordinal"), "id")
    return features.aligned(e, order.select("id"), order).select("ordinal", "id", F.round(F.col("feature")[0].cast("double"), 6).alias("first"))


@over_solve("SELECT problem_id AS id, 5 - ordinal AS place, conf FROM solve")
def confidence_alignment(spark, sf):
    """Each problem's confidences in an order of the experts."""
    s = solve(spark, sf).select(F.col("problem_id").alias("id"), "expert_id", "conf")
    order = s.select(F.col("id").alias("ordinal"), "id").distinct()
    m = features.confidence_matrix(s, [f"e{k}" for k in (5, 4, 3, 2, 1, 0)], order)
    return m.select("id", F.posexplode("conf").alias("place", "conf")).select("id", F.col("place").cast("long").alias("place"), "conf")


@query()
def linear_router_logits(spark, sf):
    """One logistic regression for each of three classes, and the mean of two of each with other regularisations."""
    e = _vectors(spark, sf)
    train = e.where("id % 5 <> 0").select("*", *[(F.col("label") == k).cast("int").alias(f"t{k}") for k in range(3)])
    both = [features.linear_router(train, e, [f"t{k}" for k in range(3)], reg=reg, iterations=15) for reg in (0.01, 0.1)]
    return features.ensemble(both).select("id", "ordinal", F.round("logit", 4).alias("logit"))


# --- the roster ---------------------------------------------------------------------------

_ROSTERS = "l AS (SELECT event_id // 100 AS step, list_sort(list_distinct(list(user_id))) AS r FROM events GROUP BY ALL), d AS (SELECT step, r, CASE step % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'swap' WHEN 2 THEN 'delete' ELSE 'noop' END AS decision FROM l)"


def _rosters(spark: SparkSession, sf: str) -> DataFrame:
    """A log: the users of a hundred events are the roster after a step."""
    k = F.col("step") % 4
    e = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 100).alias("step")).agg(F.array_sort(F.collect_set("user_id")).alias("roster_after"))
    return e.withColumn("decision", F.when(k == 0, "add").when(k == 1, "swap").when(k == 2, "delete").otherwise("noop"))


@query(f"WITH {_ROSTERS} SELECT round(avg(len(r)), 6) AS mean_size, min(len(r)) AS min_size, max(len(r)) AS max_size, count(*) FILTER (decision IN ('add', 'swap')) AS adds, count(*) FILTER (decision IN ('delete', 'swap')) AS deletes FROM d")
def log_summary(spark, sf):
    return evolution.log_summary(_rosters(spark, sf))


@query(f"WITH {_ROSTERS} SELECT step, generate_subscripts(r, 1) - 1 AS ordinal, unnest(r) AS expert_id FROM d")
def roster_replay(spark, sf):
    return evolution.replay(_rosters(spark, sf)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("""WITH u AS (SELECT conv_id % 12 AS expert_id, substr(text, 1, 200) AS t, min(conv_id * 1000 + turn) AS first FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY ALL),
  k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY expert_id ORDER BY first DESC, t) <= 10) SELECT expert_id, row_number() OVER (PARTITION BY expert_id ORDER BY first, t DESC) - 1 AS place, t AS said FROM k""")
def exclusive_history(spark, sf):
    """The last ten distinct texts of each member, in order."""
    c = table(spark, sf, "conversations").where("role = 'user' and text is not null")
    h = evolution.history(c.select((F.col("conv_id") % 12).alias("expert_id"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("at")), "expert_id", "text", "at", 200)
    return h.select("expert_id", F.posexplode("history").alias("place", "said")).withColumn("place", F.col("place").cast("long"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 10 = 9 THEN 0 WHEN p_size % 10 IN (6, 7) THEN 1 WHEN p_size % 10 IN (3, 4) THEN 2 ELSE 3 END AS rounds FROM part")
def self_refine(spark, sf):
    """A critic that scores three higher in each round; what scores nine or ten stops, what scores more never does."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).cast("string").alias("answer"))
    critic = lambda d: d.withColumn("feedback", F.concat(F.lit("Grade: "), F.col("answer")))
    reviser = lambda d: d.withColumn("answer", (F.col("answer").cast("int") + 3).cast("string"))
    return evolution.refine(p, critic, reviser, 3).select("id", "rounds")
