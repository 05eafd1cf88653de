import pytest
from pyspark.sql import functions as F

from solvegrid.functions import extract, grading, sandbox
from solvegrid.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "want"), [("0.64", "64%", 1), ("64.22%", "64%", 0), ("1.4242", "1.4241", 1), ("64.2%", "64.22%", 1), ("1,234", "$1234", 1), ("nope", "1", 0)])
def test_numbers(spark, a, b, want):
    assert one(spark, X.numerical_match(F.lit(a), F.lit(b))) == want


def test_letters(spark):
    for text, want in [("The answer is (B) local", "B"), ("A) x\nB) y\nFinal answer: C", "C"), ("so\nD\n", "D"), ("none", None), ("each option:\n(A) x (H) y\n B )", "B"), ("(A) x (D) y", "D")]:
        assert one(spark, X.option_letter(F.lit(text))) == want


def test_text(spark):
    assert one(spark, X.normalize(F.lit(" A b,  C. "))) == "a b c"
    assert one(spark, X.token_f1(F.lit("a b"), F.lit("a c"))) == pytest.approx(0.5)
    assert one(spark, X.middle_truncate(F.lit("x" * 90 + "y" * 30), 40, "|")) == "x" * 30 + "|" + "y" * 10


def test_extract():
    assert extract.boxed(r"a \boxed{1} b \boxed{\frac{1}{2}}") == r"\frac{1}{2}"
    assert extract.math_answer("x\nFinal Answer: 7") == "7"
    assert extract.json_object('say {"a": 1} ok') == '{"a": 1}'
    assert extract.code_block("t\n```python\nx=1\n```") == "x=1"
    assert extract.pseudo_input("n = 3, a = {1,2}") == {"n": 3, "a": [1, 2]}
    assert extract.multiple_choice("A) one\nB) two\nC) three", "B", "B") == 1.0


def test_sandbox():
    assert sandbox.passes("def f(x):\n    return x + 1", "assert f(1) == 2") == 100.0
    assert sandbox.passes("def f(x):\n    return x", "assert f(1) == 2") == 0.0
    assert sandbox.run("while True: pass", seconds=1)["status"] in ("timeout", "failed")
    assert sandbox.stdin_cases("print(int(input()) * 2)", '[{"input": "2", "output": "4"}, {"input": "3", "output": "5"}]') == (1, 2)


def test_math_and_code_answers():
    for text, want in [(r"\boxed{a \boxed{b}} \boxed{", "b"), ("<think>\\boxed{1}</think>x", "x"), ("**Final Answer: 7**\nok", "7"), ("final answer: 1\nFinal Answer: 2", "2"), (r"\boxed{} Final Answer: 3", ""), ("", "")]:
        assert extract.math_answer(text) == want
    for text, want in [("[BEGIN]\n<code>z</code>\n[DONE]", "z"), ("```\ny\n```", "y"), ("a ```python\nx", "x"), ("``` only", "only"), ("long part```b", "long part"), ("ab```cd", "cd"), ("", "")]:
        assert extract.code_block(text) == want
    assert extract.clean_code("```python\nx\xa0= 1\n### END\nmore```") == "x = 1"
    assert extract.json_object('{"a": {"b": 1}} ok') == '{"b": 1}' and extract.json_object('{"b": {"c": }} {') is None


def test_contest_answers():
    assert extract.last_code_block("```\na\n```\nx\n```python\nb\n```") == "b" and extract.last_code_block("```") == ""
    assert extract.last_assertion("assert a\nassert b\nc") == "assert b"
    assert extract.last_assertion("```\na\n```\n```python\nb\n```") == "b"
    assert extract.execution_answer("[ANSWER] f(1) == 3 [/ANSWER]", True) == "3" and extract.execution_answer("4\nno") == "4"
    assert extract.asserted_equals("# x\nassert f(1) == [1, 2]\n", "[1, 2]") and not extract.asserted_equals("assert f(1) == __import__('os')", "1")
    assert not extract.asserted_equals("assert f(1) > 2", "2") and extract.asserted_equals("'a'", '"a"')
    assert extract.helper_code("import a\nclass B:\n  x = 1\n\ny = 2\nfrom c import d") == "import a\nclass B:\n  x = 1\n\nfrom c import d"


def test_options():
    q = r"pick \textbf{(A)}\ 1\qquad\textbf{(B)}\ 2 \qquad\textbf{(C)}\ \pi"
    assert list(extract.marked_options(q).items()) == [("A", "1"), ("B", "2"), ("C", "pi")]
    for prediction, gold, want in [("B", "2", 1.0), ("(B)", "B", 1.0), ("2", "B", 1.0), ("A", "B", 0.0), ("B: 2", "B", 1.0), ("B: 1", "B", 0.0), ("π", "C", 1.0), ("", "B", 0.0)]:
        assert extract.multiple_choice(q, prediction, gold) == want
    assert extract.multiple_choice("A) one B) two", "A", "A") == 0.0
    assert extract.options("(A) one (B) two\nA) three") == {"A": "one", "B": "two"}


def test_arguments():
    known = extract.pseudo_input("N = 5, arr[] = {1, 2}\r\ns = abc, x = 007.")
    assert known == {"n": 5, "arr": [1, 2], "s": "abc", "x": 7}
    assert extract.arguments(["Arr", "n"], known) == [[1, 2], 5] and extract.arguments(["arr", "m"], extract.pseudo_input("arr={1,2}")) == [[1, 2], 2]
    assert extract.arguments(["arr", "k"], known) is None


def test_judge():
    assert extract.verdict('ok {"score": 2, "verdict": "maybe"}') == '{"score": 0, "verdict": "incorrect", "reason": ""}'
    assert '"score": null' in extract.verdict("nothing") and '"score": null' in extract.verdict("[1]")
    assert [extract.known_tag(x, {"tax": "tax law", "civil": "civil law"}) for x in ("TAX", "civil law", "", "sea")] == ["tax", "civil", "tax", None]


def test_legal(spark):
    gold = F.array(F.lit("도로교통법 제44조"), F.lit(" "))
    assert one(spark, X.statutes_match(F.lit("답: 도로교통법 제 44조."), gold)) is True
    assert one(spark, X.statutes_match(F.lit("도로교통법 제44조, 형법 제1조"), gold)) is False
    assert one(spark, X.statutes_match(F.lit("x"), F.array().cast("array<string>"))) is False
    assert one(spark, X.case_name(F.lit("죄명: a\n죄명： '절도'입니다."))) == "절도" and one(spark, X.case_name(F.lit("a\n답은 사기이다"))) == "사기"


def test_feedback(spark):
    for text, want in [("Score: 9", True), ("grade: 8", False), ("Rating: 95 a bug", True), ("score: 500 perfect, no issues", True), ("Perfect, excellent", True), ("perfect, excellent, not a BUG", False), ("no bugs, perfect", False), ("", False), (None, False)]:
        assert one(spark, X.may_stop(F.lit(text).cast("string"))) is want


def test_outputs(spark):
    for a, b, how, want in [("1 2\n", "1  2", {}, True), ("1 2\n", "1  2", {"type": "exact"}, False), ("A\r\nb", "a \nB", {"type": "case_insensitive"}, True), ("1.0000001 x", "1 x", {"type": "numeric_tolerance"}, True), ("inf", "1", {"type": "numeric_tolerance"}, False), ("nan", "nan", {"type": "numeric_tolerance"}, False), ("1", "1 2", {"type": "numeric_tolerance"}, False), ("", "", {}, True), ("1", "1", {"type": "special_judge_unresolved"}, False)]:
        assert grading.outputs_match(a, b, how) is want
        assert one(spark, X.outputs_match(F.lit(a), F.lit(b), how.get("type", "exact_or_token_match"))) is want


def test_grading():
    case = lambda a, b: {"input": {"value": a}, "expected_output": {"value": b}}
    double = [case("2", "4"), case("x", "4"), case("3", "7")]
    assert grading.grade({"eval_mode": "stdin_stdout"}, "print(int(input()) * 2)", double) == {"passed": False, "status": "runtime_error", "n_passed": 1, "n_total": 3}
    named = {"eval_mode": "gfg_function", "entry_point": "f", "gfg_params": ["arr", "n"]}
    assert grading.grade(named, "class Solution:\n    def f(self, a, n): return [n, *a]", [case("arr[] = {5, 6}", "2 5 6")])["passed"] is True
    assert grading.grade(named, "def f(a, n): return sum(a) > n", [case("arr[] = {5, 6}", "1"), case("k = 1", "1")]) == {"passed": False, "status": "runtime_error", "n_passed": 1, "n_total": 2}
    assert grading.grade({"eval_mode": "stdin_stdout"}, "", []) == {"passed": False, "status": "accepted", "n_passed": 0, "n_total": 0}
    assert grading.grade({"eval_mode": "manual"}, "", double)["status"] == "unsupported"


def test_contest_codes():
    assert grading.contest_codes("n = int(input())\nif __name__ == '__main__':\n    print(n / 2)\n    exit()", ["2", "5", "5"], ["1", "2.50", "2"]) == [1, 1, grading.WRONG]
    assert grading.contest_codes("class Solution:\n    def f(self, a: List[int], b): return (len(a), b)", ["[1, 2]\n3"], ["[2, 3]"], "f") == [1]
    assert grading.contest_codes("print(1", ["1"], ["1"]) == [grading.FAILED] and grading.contest_codes("while True: pass", ["1"], ["1"], seconds=1) == [grading.LATE]
    assert grading.same_lines("50000000000000001", "50000000000000001.0") and not grading.same_lines("50000000000000000", "50000000000000001")


def test_starter_code(spark):
    names = F.array(F.lit("a"))
    assert one(spark, X.starter_code(F.lit("function_call"), F.lit("f"), names, F.lit("class Solution:\n  def f(self, x): pass"))) == "class Solution:\n\tdef f(self, x):\n\t\t# complete this function\n\t\t"
    assert one(spark, X.starter_code(F.lit("function_call"), F.lit("f"), names, F.lit("def g(x): pass"))) is None


def test_failures(spark):
    kind = lambda *x: one(spark, X.failure_kind(*map(F.lit, x)))
    assert [kind("runtime_error", "SyntaxError", "raw_input()"), kind("runtime_error", "x", "public class A"), kind("timeout", "", ""), kind("accepted", "", ""), kind("", "", "")] == ["py2_syntax", "java_ref", "timeout", "PASS", "fail"]
