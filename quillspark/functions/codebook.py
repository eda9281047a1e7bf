"""Variables of a codebook: values as text, what an answer may be, and what says nothing."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values -----------------------------------------------------------

CHOICE, CHOICES, YES_NO, TEXT = "choice", "choices", "yes_no", "text"
#: Categories and texts that say that a text does not tell.
NO_ANSWER = ["nao_informado", "nao_se_aplica"]
NO_ANSWER_TEXTS = ["", "não informado", "nao informado", "não se aplica", "nao se aplica"]
#: A category's name where a text is asked for, written out.
WRITTEN_OUT = {"nao_informado": "não informado", "nao_se_aplica": "não se aplica"}

# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Variable:
    id: str
    kind: str
    categories: tuple[str, ...] = ()


@dataclass
class Answer:
    values: dict[str, Any] = field(default_factory=dict)
    quotes: dict[str, str] = field(default_factory=dict)
    problems: list[str] = field(default_factory=list)


def as_text(value: Any) -> str:
    """A value as it is stored: ``true`` and ``false``, lists as JSON, texts as they are."""
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (bool, list)) else str(value)


def from_text(text: str, kind: str) -> Any:
    return text == "true" if kind == YES_NO else json.loads(text) if kind == CHOICES else text


def check_value(v: Variable, value: Any) -> tuple[Any, str | None]:
    """The value in its normal form and what is wrong with it, if anything."""
    problem = None
    if v.kind == CHOICE and value not in v.categories:
        problem = f"{value!r} is not one of the categories"
    elif v.kind == CHOICES:
        good = isinstance(value, list) and all(isinstance(x, str) and x in v.categories for x in value)
        value, problem = (list(dict.fromkeys(value)), None) if good else (value, "the value has to be a list of categories")
    elif v.kind == YES_NO and not isinstance(value, bool):
        problem = "the value has to be true or false"
    elif v.kind == TEXT:
        if isinstance(value, str):
            value = " ".join(value.split())
            value = WRITTEN_OUT.get(value.lower().rstrip("."), value)
        else:
            problem = "the value has to be a text"
    return value, problem


def check_answer(answer: Any, variables: list[Variable]) -> Answer:
    """Values and quotes of an answer ``{variable: {value, quote}}``, and a problem for each variable that has one."""
    out = Answer()
    if not isinstance(answer, dict):
        out.problems.append("the answer is no JSON object")
        return out
    for v in variables:
        own = answer.get(v.id)
        if not isinstance(own, dict) or "value" not in own:
            out.problems.append(f"{v.id}: missing")
        elif not isinstance(own.get("quote"), str):
            out.problems.append(f"{v.id}: the quote has to be a text")
        else:
            value, problem = check_value(v, own["value"])
            if problem:
                out.problems.append(f"{v.id}: {problem}")
            else:
                out.values[v.id], out.quotes[v.id] = value, own["quote"]
    return out


def best_of(answers: list[Answer]) -> Answer:
    """The answer with the fewest problems, the earliest of equal ones: a second try need not be better."""
    return min(answers, key=lambda a: len(a.problems))


def answer_schema(variables: list[Variable], longest_quote: int = 200) -> dict[str, Any]:
    """JSON Schema of an answer, the quote before the value."""
    kinds = {
        CHOICE: lambda v: {"type": "string", "enum": list(v.categories)},
        CHOICES: lambda v: {"type": "array", "items": {"type": "string", "enum": list(v.categories)}, "uniqueItems": True},
        YES_NO: lambda v: {"type": "boolean"},
        TEXT: lambda v: {"type": "string"},
    }
    closed = lambda properties: {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}
    return closed({v.id: closed({"quote": {"type": "string", "maxLength": longest_quote}, "value": kinds[v.kind](v)}) for v in variables})


def states_nothing(v: Variable, value: Any) -> bool:
    """``says_nothing`` of a value as it is."""
    if v.kind == YES_NO:
        return value is False
    if v.kind == TEXT:
        return str(value).strip().lower().rstrip(".").replace("_", " ") in NO_ANSWER_TEXTS
    return set([value] if v.kind == CHOICE else value) <= set(NO_ANSWER)


def says_nothing(value: Column, kind: Column) -> Column:
    """Whether a stored answer says that the text does not tell."""
    chosen = F.from_json(value, "array<string>")
    text = F.replace(F.rtrim(F.trim(F.lower(value)), F.lit(".")), F.lit("_"), F.lit(" "))
    return (
        F.when(kind == YES_NO, value == "false")
        .when(kind == CHOICE, value.isin(*NO_ANSWER))
        .when(kind == CHOICES, F.coalesce(F.forall(chosen, lambda x: x.isin(*NO_ANSWER)), F.lit(True)))
        .otherwise(text.isin(*NO_ANSWER_TEXTS))
    )


def classification_summary(answers: DataFrame) -> DataFrame:
    """(variable, n, no_answer, status, share): per variable its answers, the share without an answer, and of each quote status.

    ``answers`` has (doc, variable, kind, value, status); ``waived`` quotes do not
    count for the shares, which have four places.
    """
    from .rounding import half_even

    per = answers.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.count_if(says_nothing(F.col("value"), F.col("kind"))).alias("k"), F.count_if(F.col("status") != "waived").alias("quoted"))
    status = answers.where("status <> 'waived'").groupBy("variable", "status").agg(F.count(F.lit(1)).alias("c"))
    return per.join(status, "variable", "left").select("variable", "n", half_even(F.col("k") / F.col("n"), 4).alias("no_answer"), "status", half_even(F.try_divide("c", F.col("quoted")), 4).alias("share"))


def value_counts(answers: DataFrame) -> DataFrame:
    """(variable, value, n): how often each value is given; each choice of several counts, texts do not."""
    each = F.when(F.col("kind") == CHOICES, F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return answers.where(F.col("kind") != TEXT).select("variable", F.explode(each).alias("value")).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))


#: The cell of documents without an answer.
UNCLASSIFIED = "unclassified"


def cross_tab(docs: DataFrame, answers: DataFrame, variable: str, group: str) -> DataFrame:
    """(group, value, n): documents by a group and the value of one variable, those without an answer in a cell of their own."""
    own = answers.where(F.col("variable") == variable)
    each = F.when(F.col("kind") == CHOICES, F.from_json("value", "array<string>")).otherwise(F.array("value"))
    values = own.select("doc", F.explode(each).alias("value"))
    return docs.select("doc", group).join(values, "doc", "left").groupBy(group, F.coalesce("value", F.lit(UNCLASSIFIED)).alias("value")).agg(F.countDistinct("doc").alias("n"))


def cell_documents(docs: DataFrame, answers: DataFrame, variable: str, group: str, at: object, value: str) -> DataFrame:
    """(doc): the documents of one cell of the cross-tab."""
    own = answers.where(F.col("variable") == variable)
    each = F.when(F.col("kind") == CHOICES, F.from_json("value", "array<string>")).otherwise(F.array("value"))
    values = own.select("doc", F.explode(each).alias("value"))
    there = docs.where(F.col(group).eqNullSafe(F.lit(at))).select("doc")
    return there.join(values, "doc", "left_anti") if value == UNCLASSIFIED else there.join(values.where(F.col("value") == value), "doc", "left_semi")


def classification_texts(titles: Column, abstracts: Column, languages: list[str]) -> Column:
    """Struct (title, abstract, language), null without an abstract: the title's language follows the abstract's."""
    from .text import preferred_text

    abstract = preferred_text(abstracts, languages)
    same = F.try_element_at(F.filter(titles, lambda t: t["language"] == abstract["language"]), F.lit(1))
    title = F.coalesce(same, preferred_text(titles, languages))
    return F.when(F.length(F.trim(abstract["text"])) > 0, F.struct(title["text"].alias("title"), abstract["text"].alias("abstract"), abstract["language"].alias("language")))


def agreement_by_stage(decisions: DataFrame, reference: DataFrame) -> DataFrame:
    """(stage, n, right): decisions (doc, variable, value, stage) that a reference (doc, variable, value) answers too."""
    ref = reference.select("doc", "variable", F.col("value").alias("_r"))
    return decisions.where("value IS NOT NULL").join(ref, ["doc", "variable"]).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == F.col("_r")).alias("right"))


def votes_moved(votes: DataFrame, reference: DataFrame) -> DataFrame:
    """(member, votes, changed, towards, against): what members' second votes did, against a reference.

    ``votes`` has (doc, variable, member, round, value, revised).
    """
    first = votes.where("round = 1").select("doc", "variable", "member", F.col("value").alias("_first"))
    ref = reference.select("doc", "variable", F.col("value").alias("_r"))
    j = votes.where("round = 2").join(first, ["doc", "variable", "member"], "left").join(ref, ["doc", "variable"], "left")
    was, now = F.col("_first") == F.col("_r"), F.col("value") == F.col("_r")
    return j.groupBy("member").agg(F.count(F.lit(1)).alias("votes"), F.count_if("revised").alias("changed"), F.count_if(F.col("revised") & ~was & now).alias("towards"), F.count_if(F.col("revised") & was & ~now).alias("against"))
