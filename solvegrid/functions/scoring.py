"""Scores of predictions, 0 or 100, by the kind of each item.

Text kinds are column expressions. Code and formulas go through one Arrow function, which
skips the rows of other kinds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract, grading, sandbox
from . import text as X

#: An option of a question and its text up to the next one.
OPTION = r"(?s)(?:^|\n|\s)\(?([A-H])[\):.]\s*(.+?)(?=(?:\n|\s)\(?[A-H][\):.]|\z)"
#: Columns that an item may have; those that are missing count as null.
ITEM = ("scoring_kind", "dataset", "domain", "instruction", "ground_truth", "task_type", "eval_spec", "test_cases", "test_code", "test_list", "entry_point", "prediction")


def points(passed: Column) -> Column:
    return F.when(F.coalesce(passed, F.lit(False)), 100.0).otherwise(0.0)


def positive(score: Column) -> Column:
    """Another threshold than a full pass: anything above 0."""
    return F.coalesce(score.try_cast("double") > 0, F.lit(False))


def option_text(question: Column, letter: Column, most: int = 160) -> Column:
    """The squeezed text of the first option of that letter."""
    texts = F.filter(F.arrays_zip(F.regexp_extract_all(question, F.lit(OPTION), F.lit(1)).alias("k"), F.regexp_extract_all(question, F.lit(OPTION), F.lit(2)).alias("v")), lambda x: x["k"] == letter)
    return F.substring(X.squeeze(F.try_element_at(texts, F.lit(1)).getField("v")), 1, most)


def qasc_score(question: Column, gold: Column, prediction: Column) -> Column:
    """The letter that a prediction gives is right; without any letter, it is or holds the right option's text."""
    letter = F.upper(F.trim(gold))
    said = X.strip_thinking(F.coalesce(prediction, F.lit("")))
    picked, right = X.option_letter(said), F.nullif(option_text(question, letter), F.lit(""))
    passed = F.when(picked.isNotNull(), picked == letter).otherwise(F.contains(X.squeeze(said), right))
    return points(letter.rlike("^[A-H]$") & passed)


def gold_list(gold: Column) -> Column:
    """A gold answer as a list: a JSON list's texts, else the answer alone; blank ones go."""
    listed = F.coalesce(F.from_json(F.when(F.ltrim(gold).startswith("["), gold), "array<string>"), F.array(gold_text(gold)))
    return F.filter(listed, lambda x: F.trim(x) != "")


def gold_text(gold: Column) -> Column:
    """A gold answer that may be written as a JSON text."""
    quoted = F.from_json(F.when(gold.rlike(r'(?s)^\s*".*"\s*$'), F.concat(F.lit("["), gold, F.lit("]"))), "array<string>")
    return F.coalesce(F.try_element_at(quoted, F.lit(1)), gold)


def lbox_score(task: Column, gold: Column, prediction: Column) -> Column:
    """Case names by their plain form, statutes as sets, anything else by the plain form of the whole answer."""
    said, kind, want = F.coalesce(prediction, F.lit("")), F.lower(F.coalesce(task, F.lit(""))), X.legal_plain(gold_text(gold))
    whole = (want != "") & (X.legal_plain(X.strip_thinking(said)) == want)
    return points(F.when(kind == "casename", X.legal_plain(X.case_name(said)) == want).when(kind == "statute", X.statutes_match(said, gold_list(gold))).otherwise(whole))


def kind_of(kind: Column, dataset: Column) -> Column:
    return F.coalesce(F.lower(F.nullif(kind, F.lit(""))), X.scoring_kind(F.lower(F.coalesce(F.nullif(dataset, F.lit("")), F.lit("mbpp")))))


def math_passes(prediction: str, gold: str, question: str) -> bool:
    answer = extract.math_answer(prediction)
    return extract.equivalent(answer, extract.math_answer(gold)) or extract.equivalent(answer, gold) or extract.letter_value_match(answer, gold, question)


def code_passes(row: dict, seconds: float) -> bool:
    """Whether a program passes an item's own tests, behind the imports and classes of its question and reference."""
    helper = ""
    if (row["domain"] or "coding") == "coding":
        parts = [extract.helper_code(row[c] or "") for c in ("instruction", "ground_truth")]
        helper = "\n".join(p for p in parts if p)
    tests = "\n".join(row["test_list"]) if row["test_list"] is not None else row["test_code"] or ""
    return sandbox.checked(extract.clean_code(row["prediction"] or ""), tests, row["entry_point"], helper, seconds) == 100.0


def contest_passes(row: dict, seconds: float) -> bool:
    """Whether a contest program passes all of a JSON list of {"input", "output"}; none isn't passing."""
    cases = grading.loads(row["test_cases"])
    if not isinstance(cases, list) or not cases or not all(isinstance(c, dict) and isinstance(c.get("input"), str) and isinstance(c.get("output"), str) for c in cases):
        return False
    said = row["prediction"] or ""
    codes = grading.contest_codes(extract.code_block(said) or said, [c["input"] for c in cases], [c["output"] for c in cases], row["entry_point"], seconds)
    return len(codes) == len(cases) and all(c > 0 for c in codes)


def _run(row: dict, seconds: float, contest_seconds: float) -> float:
    route = row["route"]
    if route == "math":
        return 100.0 * math_passes(row["prediction"] or "", row["ground_truth"] or "", row["instruction"] or "")
    if route == "lcb":
        return 100.0 * contest_passes(row, contest_seconds)
    if route == "acc":
        return 100.0 * bool(grading.grade(grading.loads(row["eval_spec"] or "{}"), row["prediction"] or "", grading.loads(row["test_cases"] or "[]"))["passed"])
    return 100.0 * code_passes(row, seconds)


def score_one(items: DataFrame, *, seconds: float = 3.0, contest_seconds: float = 10.0, into: str = "pass_score") -> DataFrame:
    """items with a score of 0 or 100.

    The order of decision: contest items; items with an evaluation specification; science
    questions; legal ones; formulas, by their domain; all others by running their tests. Columns
    are those of ITEM; test_list is an array of texts, the others are texts.
    """
    have = {c: F.col(c) if c in items.columns else F.lit(None).cast("array<string>" if c == "test_list" else "string") for c in ITEM}
    kind = kind_of(have["scoring_kind"], have["dataset"])
    route = F.when(kind == "lcb", "lcb").when((kind == "acc") | (F.coalesce(have["eval_spec"], F.lit("")) != ""), "acc").when(kind.isin("qasc", "lbox"), kind).when(have["domain"] == "math", "math").otherwise("code")

    @F.arrow_udf("double")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else _run(r, seconds, contest_seconds) for r in rows.to_pylist()], pa.float64())

    needs = ("domain", "instruction", "ground_truth", "eval_spec", "test_cases", "test_code", "test_list", "entry_point", "prediction")
    row = F.when(route.isin("lcb", "acc", "math", "code"), F.struct(route.alias("route"), *[have[c].alias(c) for c in needs]))
    native = F.when(route == "qasc", qasc_score(have["instruction"], have["ground_truth"], have["prediction"])).when(route == "lbox", lbox_score(have["task_type"], have["ground_truth"], have["prediction"]))
    return items.withColumn(into, F.coalesce(native, run(row)))


def finalize(text: Column, dataset: Column, domain: Column) -> Column:
    """What a generation gives: text for questions of words and formulas, else its code block, or all of it."""
    said = X.strip_thinking(F.coalesce(text, F.lit("")))
    return F.when(X.task_family(dataset, domain) == "coding", F.coalesce(F.nullif(extract.column(extract.code_block)(said), F.lit("")), said)).otherwise(said)


def lbox_gold(raw: Column) -> Column:
    """A legal gold answer in JSON as struct of text, items and the JSON itself."""
    items = F.transform(gold_list(raw), lambda x: F.trim(x))
    return F.struct(F.array_join(items, ", ").alias("text"), items.alias("items"), raw.alias("raw_json"))
