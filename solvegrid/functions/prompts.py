"""Prompts as column expressions: templates by task family, personas, rosters, repairs.

A prompt is an array of messages (role, content). The wording of the templates is a
parameter of every builder; the families, keys, marks and limits are not.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

MESSAGES = "array<struct<role: string, content: string>>"


@dataclass(frozen=True)
class Templates:
    """System texts and user texts; {instruction} stands for the question."""

    system: dict[str, str] = field(
        default_factory=lambda: {
            "math": "You are a helpful math assistant.",
            "qasc": "You are a careful science multiple-choice solver.",
            "lbox": "You are a precise Korean legal classification assistant.",
            "coding": "You are an expert programmer.",
            "contest": "You are a helpful assistant.",
        }
    )
    user: dict[str, str] = field(
        default_factory=lambda: {
            "math": "Solve the math problem step by step. Give the final answer in \\boxed{}.\n\n{instruction}",
            "qasc": "Solve the science question. End with the answer letter, from A to H.\n\n{instruction}",
            "lbox": "Do the Korean legal classification task in exactly the format that it asks for.\n\n{instruction}",
            "coding": "Write a Python function that solves the problem. Give the code in one fenced block.\n\n{instruction}",
            "contest": "Solve the contest problem in Python 3. Read the input and print the output as described.\n\n{instruction}",
        }
    )
    #: of formulas, by the key of a domain
    domains: dict[str, str] = field(
        default_factory=lambda: {
            "algebra": "You are an expert in algebra: equations, inequalities, polynomials and functions.",
            "geometry": "You are an expert in Euclidean, analytic, and projective geometry.",
            "number_theory": "You are an expert in elementary number theory: divisibility, congruences and integer equations.",
            "combinatorics": "You are an expert in counting, probability and combinatorial proofs.",
            "calculus": "You are an expert in calculus: limits, derivatives, integrals and series.",
        }
    )
    code_hint: str = " Give only one fenced ```python block, without any text outside it."


DEFAULT = Templates()


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def filled(template: str, instruction: Column) -> Column:
    head, _, tail = template.partition("{instruction}")
    return F.concat(F.lit(head), instruction, F.lit(tail))


def model_family(model: Column) -> Column:
    low = F.lower(F.coalesce(model, F.lit("")))
    return F.when(low.contains("qwen3"), "qwen3").when(low.contains("llama") | low.contains("gemma"), "llama31").otherwise("generic")


def domain_key(value: Column) -> Column:
    """A domain's name as a key: lower case, blanks and hyphens as underscores."""
    return F.nullif(F.translate(F.lower(F.trim(value)), "- ", "__"), F.lit(""))


def math_system(candidates: Column, templates: Templates = DEFAULT) -> Column:
    """The system text of the first of an array of names, or of a path's levels, that is a known domain; else the general one."""
    known = F.create_map(*[F.lit(x) for pair in templates.domains.items() for x in pair])
    names = F.flatten(F.transform(F.filter(candidates, lambda c: c.isNotNull()), lambda c: F.concat(F.array(c), F.split(c, "->"))))
    found = F.filter(F.transform(names, lambda n: F.try_element_at(known, domain_key(n))), lambda s: s.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(templates.system["math"]))


def _by(family: Column, texts: dict[str, Column]) -> Column:
    out = None
    for name, value in texts.items():
        out = F.when(family == name, value) if out is None else out.when(family == name, value)
    return out


def build(instruction: Column, dataset: Column, domain: Column, model: Column, *, system: Column | None = None, starter: Column | None = None, approach: Column | None = None, templates: Templates = DEFAULT) -> Column:
    """The messages of a generation.

    system, where it isn't empty, is a persona in place of the template's; approach goes before
    the user text of questions of words and formulas; starter code is shown with coding tasks.
    """
    family = X.task_family(dataset, domain)
    family = F.when((family == "coding") & (F.lower(dataset) == "livecodebench"), "contest").otherwise(family)
    code = family.isin("coding", "contest")
    if starter is not None:
        shown = F.concat(instruction, F.lit("\n\nStarter Code:\n```python\n"), starter, F.lit("\n```"))
        instruction = F.when(code & (F.coalesce(starter, F.lit("")) != ""), shown).otherwise(instruction)
    own = _by(family, {k: F.lit(v) for k, v in templates.system.items()})
    if system is not None:
        own = F.coalesce(F.nullif(system, F.lit("")), F.when(code, F.lit(templates.system["coding"])).otherwise(own))
    own = F.when(code & (model_family(model) == "llama31"), F.concat(own, F.lit(templates.code_hint))).otherwise(own)
    user = _by(family, {k: filled(v, instruction) for k, v in templates.user.items()})
    if approach is not None:
        user = F.when(~code & (F.coalesce(approach, F.lit("")) != ""), F.concat(approach, F.lit("\n\n"), user)).otherwise(user)
    return F.array(message("system", own), message("user", user))


def chatml(messages: Column, opening: str = "```python\n") -> Column:
    """Messages in chat markup, with an opening of the answer."""
    said = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("\n<|im_end|>\n")))
    return F.concat(F.array_join(said, ""), F.lit("<|im_start|>assistant\n" + opening))


def with_system(messages: Column, system: Column) -> Column:
    """The messages with that system text, in place of theirs or before them."""
    has = F.coalesce(F.try_element_at(messages, F.lit(1)).getField("role") == "system", F.lit(False))
    rest = F.when(has, F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    return F.concat(F.array(message("system", system)), rest)


def last_user(messages: Column) -> Column:
    """What the user said last."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1)).getField("content")


def sft_row(messages: Column, answer: Column) -> Column:
    """Prompt and completion of a training row."""
    return F.struct(messages.alias("prompt"), F.array(message("assistant", answer)).alias("completion"))


def _cell(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "|", "/")


def roster_table(members: Column) -> Column:
    """Markdown of an array of members (name, strengths, system_prompt, approach): by approach if any has one, else by strengths."""
    by_approach = F.exists(members, lambda m: F.coalesce(m["approach"], F.lit("")) != "")
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    name = lambda m: F.coalesce(m["name"], F.lit(""))
    wide = F.concat(F.array(F.lit("| name | identity | approach |"), F.lit("|------|----------|----------|")), F.transform(members, lambda m: row(name(m), _cell(m["system_prompt"]), _cell(m["approach"]))))
    plain = F.concat(F.array(F.lit("| name | strengths |"), F.lit("|------|-----------|")), F.transform(members, lambda m: row(name(m), _cell(m["strengths"]))))
    return F.array_join(F.when(by_approach, wide).otherwise(plain), "\n")


def exclusive_list(members: Column, last: int = 3, most: int = 150) -> Column:
    """Of an array of members (name, solves) the last solves of each, clipped."""
    shown = lambda m: F.transform(F.slice(m["solves"], -F.least(F.size(m["solves"]), F.lit(last)), F.lit(last)), lambda s: F.concat(F.lit("  • "), F.substring(s, 1, most)))
    one = lambda m: F.concat(m["name"], F.lit(":\n"), F.when(F.coalesce(F.size(m["solves"]), F.lit(0)) > 0, F.array_join(shown(m), "\n")).otherwise("  • (none yet)"))
    return F.when(F.size(members) == 0, "(none yet — early stage)").otherwise(F.array_join(F.transform(members, one), "\n\n"))


def capped(text: Column, failures: bool = False) -> Column:
    """What a scout sees of hard errors: more where whole failed attempts are shown."""
    return F.substring(text, 1, 40_000 if failures else 4_000)


def repair(metadata: Column) -> Column:
    """What to tell about a failed contest run, from its metadata in JSON; empty without an error code."""
    known = lambda k: F.coalesce(F.get_json_object(metadata, f"$.{k}"), F.lit(""))
    line = lambda name, k: F.concat(F.lit(f"\n{name}: "), known(k))
    said = {
        -1: F.concat(F.lit("The above code is incorrect and got the following compilation error.\n"), known("error")),
        -2: F.concat(F.lit("The above code is incorrect and got a wrong answer."), line("Input", "inputs"), line("Generated Output", "output"), line("Expected", "expected")),
        -3: F.concat(F.lit("The above code is incorrect and got time limit exceeded.\n"), known("error"), line("Input", "inputs"), line("Expected", "expected")),
        -4: F.concat(F.lit("The above code is incorrect and got a runtime error."), line("Input", "inputs"), line("Expected", "expected"), F.lit("\n"), known("error")),
    }
    code = F.get_json_object(metadata, "$.error_code").try_cast("int")
    unknown = F.raise_error(F.concat(F.lit("unknown error code "), code.cast("string"))).cast("string")
    return F.when(code.isNull(), "").otherwise(F.coalesce(_by(code, said), unknown))
