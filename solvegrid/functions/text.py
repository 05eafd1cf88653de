"""Text functions as column expressions: truncation, normalisation, extraction, comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Scoring kind by dataset; anything else is checked by assertions.
SCORING_KIND = {"livecodebench": "lcb", "humaneval": "humaneval_check", "acc": "acc", "qasc": "qasc", "lbox": "lbox"}


def scoring_kind(dataset: Column) -> Column:
    out = None
    for name, kind in SCORING_KIND.items():
        out = F.when(dataset == name, kind) if out is None else out.when(dataset == name, kind)
    return out.otherwise("asserts")


def first_nonempty(*columns: Column) -> Column:
    """Empty counts as missing."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def middle_truncate(text: Column, most: int, mark: str = "\n...[truncated]...\n") -> Column:
    """Texts over most keep three quarters of it at the head and a quarter at the tail."""
    head = most * 3 // 4
    tail = most - head
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(tail)))).otherwise(text)


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("[TRUNCATED: "), (F.length(text) - most).cast("string"), F.lit(" chars omitted]"))).otherwise(text)


def normalize(text: Column, keep_point: bool = False) -> Column:
    """Lower case, no ASCII punctuation, single blanks."""
    drop = PUNCTUATION.replace(".", "") if keep_point else PUNCTUATION
    return F.trim(F.regexp_replace(F.translate(F.lower(text), drop, ""), r"(?U)\s+", " "))


def squeeze(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def exact_match(a: Column, b: Column) -> Column:
    return (normalize(a) == normalize(b)).cast("double")


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda x: x != "")


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, also where lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def numbered_tokens(listed: Column) -> Column:
    """The tokens of an array, each with its number among its equals, so that sets of them are bags; in linear time once sorted."""

    def of_sorted(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        runs = lambda at: F.transform(at, lambda i, j: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(at, j + 1), F.size(s)) - i - 1), lambda k: F.concat(F.get(s, i), F.lit(" "), k.cast("string"))))
        return F.flatten(bound(starts, runs))

    return bound(F.array_sort(listed), of_sorted)


def token_f1(a: Column, b: Column) -> Column:
    """Bag overlap of normalised tokens: 1 if both are empty, 0 if one is; null if either text is."""

    def score(x: Column, y: Column) -> Column:
        same = F.size(F.array_intersect(x, y))
        p, r = same / F.size(x), same / F.size(y)
        return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0) | (same == 0), 0.0).otherwise(2 * p * r / (p + r))

    both = bound(numbered_tokens(tokens(a)), lambda x: bound(numbered_tokens(tokens(b)), lambda y: score(x, y)))
    return F.when(a.isNotNull() & b.isNotNull(), both)


_NUMBER = r"^[+-]?([0-9]+([0-9_]*[0-9])?\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(text: Column) -> Column:
    """A number without thousands commas, currency and percent signs; else null."""
    bare = F.trim(F.regexp_replace(text, r"[,$%]", ""))
    return F.when(bare.rlike(_NUMBER), F.regexp_replace(bare, "_", "").try_cast("double"))


def numerical_match(a: Column, b: Column, tolerance: float = 1e-3) -> Column:
    """Relative error below the tolerance; a bare side of at most 2 is rescaled against a percentage."""
    x, y, px, py = number(a), number(b), F.contains(a, F.lit("%")), F.contains(b, F.lit("%"))
    x2 = F.when(py & ~px & (F.abs(x) <= 2.0), x * 100).otherwise(x)
    y2 = F.when(px & ~py & (F.abs(y) <= 2.0), y * 100).otherwise(y)
    error = F.when(F.abs(y2) < 1e-9, F.abs(x2 - y2)).otherwise(F.abs(x2 - y2) / F.abs(y2))
    return F.coalesce((error < tolerance).cast("double"), F.lit(0.0))


def strip_thinking(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?s)<\|channel>thought.*?<channel\|>", "")
    out = F.regexp_replace(out, r"(?s)^thought\n.*?\n\n", "")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


#: Patterns of an option letter, in order of priority.
OPTION_PATTERNS = (
    r"(?i)(?:final\s+answer|answer|choice|option)[ \t]*(?:is|:)?[ \t]*\(?[ \t]*([A-H])[ \t]*\)?",
    r"(?mdU)^\s*\(?\s*([A-H])\s*\)?\s*(?:[.)])?\s*$",
    r"\(([A-H])\)",
)


def option_letter(text: Column) -> Column:
    """The last match of the first pattern that matches at all, in upper case."""
    return F.upper(F.coalesce(*[F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(-1)) for p in OPTION_PATTERNS]))


#: Characters that the comparison of statutes and case names leaves out.
LEGAL_DROP = ("[\"'`“”‘’]", r"(?U)[\s·ㆍ・\-()\[\]{}.,:;，。]")
#: A statute with its article, and what announces and ends a case name.
STATUTE = r"([가-힣A-Za-z0-9·ㆍ()]+법)\s*제\s*\d+(?:조|항|호)(?:의\s*\d+)?(?:\s*제\s*\d+(?:항|호))*"
CASE_SAID, CASE_HEAD, CASE_TAIL, CASE_EDGE = r"(?:죄명|범죄명|정답|답)\s*[:：]\s*([^\n]+)", r"^(?:정답은|답은)\s*", r"(?:입니다|이다)[.。]?$", " \t\r\n\"'`.,:;"


def legal_plain(text: Column) -> Column:
    """Without quotes, blanks, punctuation and brackets, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, LEGAL_DROP[0], ""), LEGAL_DROP[1], ""))


def case_name(text: Column) -> Column:
    """What follows the last announcement, else the last line, without copula and edges."""
    bare = strip_thinking(text)
    said = F.coalesce(F.try_element_at(F.regexp_extract_all(bare, F.lit(CASE_SAID), F.lit(1)), F.lit(-1)), F.element_at(F.split(bare, r"\r\n|\n|\r"), -1))
    cut = F.regexp_replace(F.trim(F.regexp_replace(F.trim(said), CASE_HEAD, "")), CASE_TAIL, "")
    return F.btrim(F.trim(cut), F.lit(CASE_EDGE))


def statutes(text: Column, gold: Column) -> Column:
    """The plain statutes that a text names, and those of gold that its plain form holds."""
    bare = strip_thinking(text)
    plain = legal_plain(bare)
    named = F.transform(F.regexp_extract_all(bare, F.lit(STATUTE), F.lit(0)), legal_plain)
    held = F.filter(F.transform(gold, legal_plain), lambda g: (g != "") & F.contains(plain, g))
    return F.array_sort(F.array_distinct(F.array_union(F.filter(named, lambda x: x != ""), held)))


def statutes_match(text: Column, gold: Column) -> Column:
    want = F.array_sort(F.array_distinct(F.filter(F.transform(gold, legal_plain), lambda g: g != "")))
    return (F.size(want) > 0) & (statutes(text, gold) == want)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def router_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: F.length(x) > 2)


def category_path(path: Column) -> Column:
    """The levels of a path written with arrows, trimmed, in order, once each."""
    return F.array_distinct(F.transform(F.split(path, "->"), lambda x: F.trim(x)))


#: Categories by the second level of a path of mathematics, the third levels of applied mathematics that make one, and what seven categories merge to.
LEVEL2 = {"Algebra": "algebra", "Geometry": "geometry", "Calculus": "calculus", "Number Theory": "number_theory", "Discrete Mathematics": "discrete_mathematics", "Precalculus": "precalculus"}
APPLIED = {"Statistics": "statistics_and_probability", "Probability": "statistics_and_probability"}
MERGED = {
    "algebra": "algebra",
    "geometry": "geometry",
    "statistics_and_probability": "statistics_and_probability",
    "calculus": "calculus_and_precalculus",
    "precalculus": "calculus_and_precalculus",
    "number_theory": "number_theory_and_discrete_math",
    "discrete_mathematics": "number_theory_and_discrete_math",
}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def math_categories(paths: Column) -> Column:
    """The categories of an array of paths, in order, once each; other paths give none."""

    def one(path: Column) -> Column:
        level = lambda n: F.trim(F.try_element_at(F.split(path, "->"), F.lit(n)))
        return F.when(level(1) == "Mathematics", F.when(level(2) == "Applied Mathematics", _looked_up(APPLIED, level(3))).otherwise(_looked_up(LEVEL2, level(2))))

    return F.array_distinct(F.filter(F.transform(paths, one), lambda c: c.isNotNull()))


def merged_categories(categories: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(categories, lambda c: _looked_up(MERGED, c)), lambda c: c.isNotNull()))


def task_name(kind: Column, case: Column) -> Column:
    """Case names by the type of their case, other tasks by their type."""
    return F.when(kind == "casename", F.concat(F.lit("casename_"), F.coalesce(case, F.lit("None")))).otherwise(F.coalesce(kind, F.lit("None")))


def id_task(id_: Column) -> Column:
    return F.when(id_.startswith("statute_"), "statute").otherwise("casename")


def failure_kind(status: Column, error: Column, code: Column) -> Column:
    """Why a reference solution fails: runtime errors by the first mark that holds, else the status."""
    syntax = error.contains("SyntaxError")
    kind = (
        F.when(syntax & (code.contains("print ") | code.contains("raw_input")), "py2_syntax")
        .when(error.contains("TabError"), "tab_error")
        .when(code.contains("import java") | code.contains("public class"), "java_ref")
        .when(syntax, "syntax_other")
        .otherwise("runtime_error")
    )
    return F.when(status == "accepted", "PASS").when(status == "runtime_error", kind).otherwise(first_nonempty(status, F.lit("fail")))


#: Families by domain and by dataset, in order of priority; anything else is coding.
FAMILIES = {"math": (("math",), ("bigmath", "math", "numina_cot")), "qasc": (("qasc", "science_mc", "mc"), ("qasc",)), "lbox": (("lbox", "legal"), ("lbox",))}


def task_family(dataset: Column, domain: Column) -> Column:
    low = [F.coalesce(F.lower(c), F.lit("")) for c in (domain, dataset)]
    return F.coalesce(*[F.when(low[0].isin(*a) | low[1].isin(*b), name) for name, (a, b) in FAMILIES.items()], F.lit("coding"))


#: Praise, two of which stop the refining of an answer, and words that never let it stop.
PRAISE = ("perfect", "no issues", "no bugs", "excellent", "flawless", "no errors", "completely correct", "works correctly")
BLAME = ("incorrect", "not correct", "bug")


def may_stop(feedback: Column) -> Column:
    """A score of 9 of 10 or 90 of 100; without a score up to 100, two kinds of praise and no blame."""
    low = F.lower(feedback)
    score = F.nullif(F.regexp_extract(feedback, r"(?i)(?:Score|Grade|Rating):\s*(\d+)", 1), F.lit("")).try_cast("decimal(38,0)")
    praised = F.size(F.filter(F.array(*map(F.lit, PRAISE)), lambda x: F.contains(low, x))) >= 2
    blamed = F.exists(F.array(*map(F.lit, BLAME)), lambda x: F.contains(low, x))
    return F.coalesce(F.when(score <= 10, score >= 9).when(score <= 100, score >= 90).otherwise(praised & ~blamed), F.lit(False))


def starter_code(mode: Column, entry: Column, parameters: Column, reference: Column) -> Column:
    """A stub with the signature of the entry point: from the parameters, or from the reference's definition; null without one."""
    stub = "):\n\t\t# complete this function\n\t\t"
    method = lambda names: F.concat(F.lit("class Solution:\n\tdef "), entry, F.lit("("), names, F.lit(stub))
    definition = F.concat(F.lit(r"def\s+\Q"), entry, F.lit(r"\E\s*\(([^)]*)\)"))
    signature = F.try_element_at(F.regexp_extract_all(reference, definition, F.lit(1)), F.lit(1))
    plain = F.concat(F.lit("def "), entry, F.lit("("), signature, F.lit("):\n\t# complete this function\n\t"))
    listed = F.array_join(F.concat(F.array(F.lit("self")), F.coalesce(parameters, F.array().cast("array<string>"))), ", ")
    return F.when(mode == "gfg_function", method(listed)).when(mode == "function_call", F.when(reference.contains("class Solution"), method(signature)).otherwise(plain))


def output_text(text: Column, strip: bool = True) -> Column:
    """Line ends as \n; white space at line ends and at both ends of the text goes, if strip."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"(?mdU)\s+$", ""), r"(?U)^\s+|\s+$", "") if strip else out


def output_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def is_close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 0.0) -> Column:
    """Equal, or finite and within either tolerance; NaN is close to nothing."""
    number = ~F.isnan(a) & ~F.isnan(b)
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return number & ((a == b) | (finite & (F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute)))))


def outputs_match(actual: Column, expected: Column, kind: str = "exact_or_token_match", case_sensitive: bool = True, strip: bool = True, rel: float = 1e-6, absolute: float = 1e-6) -> Column:
    """A program's output against the expected one. Kinds: special_judge_unresolved (never), numeric_tolerance (token by token), case_insensitive, exact, and token by token for any other."""
    if kind == "special_judge_unresolved":
        return F.lit(False)
    if kind == "numeric_tolerance":
        x, y = output_tokens(actual), output_tokens(expected)
        close = lambda a, b: F.coalesce(is_close(a.try_cast("double"), b.try_cast("double"), rel, absolute), a == b)
        return F.when(F.size(x) == F.size(y), F.forall(F.zip_with(x, y, close), lambda z: z)).otherwise(False)
    a, b = output_text(actual, strip), output_text(expected, strip)
    if kind == "case_insensitive" or not case_sensitive:
        a, b = F.lower(a), F.lower(b)
    return a == b if kind in ("exact", "case_insensitive") else (a == b) | (output_tokens(a) == output_tokens(b))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
