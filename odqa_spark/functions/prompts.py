"""Prompt texts as column expressions.

Tags, line breaks and branches are fixed; the wording of the instructions is this
package's own, and every builder takes the user's wording instead.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags and separators of the prompt formats.
INSTRUCTION_TAG = "###Instruction###"
QUESTION_TAG = "###Question###"
CONTEXT_TAG = "###Context###"
PASSAGES_TAG = "###Passages###"
SPECIAL_SEPARATOR = "<sep>"
PLAIN_SEPARATOR = "\n"

# Per instruction version, the wanted share of the source length, the least number
# of words (0 = not stated), whether bullet points are asked for, and the points that it stresses.
INSTRUCTION_VERSIONS = {
    "v2": ("half", 200, False, "noise", "evidence"),
    "v6": ("a third", 100, True),
    "v7": ("a third", 150, True),
    "v8": ("a third", 200, False),
    "v9": ("half", 150, False, "intent"),
    "v10": ("half", 200, False, "clarity", "noise"),
    "v11": ("half", 150, False, "intent", "structure"),
    "v12": ("half", 150, False, "intent", "structure", "exactness"),
    "v13": ("", 0, False, "rough"),
    "v14": ("a third", 0, False, "traps"),
}

POINTS = {
    "noise": "Leave out whatever has no bearing on the question.",
    "evidence": "Keep the statements that back the answer.",
    "clarity": "Put precision before style.",
    "intent": "Work out what the asker wants to know, and write towards that.",
    "structure": "Another model reads your text to answer a short question: give it a clear order.",
    "exactness": "Names, numbers and dates must stay exact.",
    "rough": "The passages are chance cuts and may be flawed.",
    "traps": "Drop wording that could pass for the answer but is not.",
}

READER_INSTRUCTION = (
    f"{INSTRUCTION_TAG}\n"
    "Answer with the shortest noun phrase of the context that answers the question, at most five words, "
    "copied as it stands and without any lead-in.\n"
)

REWRITE_TEMPLATE = (
    "Rewrite the document, one part of a longer article, so that a reader can answer the question from it.\n"
    "{requirement}\n"
    "Add no facts, do not answer the question, and write 400 words or more.\n"
    "\n"
    "<<Document>>\n{document}\n"
    "<<Question>>\n{question}\n"
    "<<Answer>>\n{answer}\n"
    "\n"
    "<<REMEMBER>>\n"
    "Keep the encyclopedic style of the document.\n"
)
ANSWER_PRESENT = "This part contains the answer: make it easy to find."
ANSWER_ABSENT = "The answer is in another part: rewrite this one all the same."


def instruction_text(length: str, min_words: int, bullets: bool, *points: str) -> str:
    lines = [INSTRUCTION_TAG, "Rewrite the passages so that they answer the question clearly."]
    if length:
        lines.append(f"Use about {length} of their length.")
    if min_words:
        lines.append(f"Write {min_words} words or more.")
    if bullets:
        lines.append("Use one bullet point per key element.")
    lines += [POINTS[p] for p in points]
    lines.append("Keep the exact words of the answer, and use only what the passages say.")
    return "\n".join(lines) + "\n"


def default_instructions() -> dict[str, str]:
    """Instruction text of every known version."""
    return {version: instruction_text(*spec) for version, spec in INSTRUCTION_VERSIONS.items()}


def model_input(question: Column, text: Column, special_token: bool = False) -> Column:
    return F.concat(question, F.lit(SPECIAL_SEPARATOR if special_token else PLAIN_SEPARATOR), text)


def reader_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(f"{QUESTION_TAG}\n"), question, F.lit(f"\n\n{CONTEXT_TAG}\n"), context)


def summarizer_prompt(question: Column, passages: Column) -> Column:
    """No line break follows the first tag."""
    return F.concat(F.lit(QUESTION_TAG), question, F.lit(f"\n\n{PASSAGES_TAG}\n"), passages)


def with_instruction(
    rows: DataFrame, instructions: Mapping[str, str] | None = None, model_col: str = "summarizer"
) -> DataFrame:
    """Split ``model.version``, look the version up: adds ``model, system_prompt, error``.

    An unknown version gives a row with ``error`` and no prompt. The instructions
    are a map literal in the plan, so the lookup moves no rows.
    """
    known_texts = instructions or default_instructions()
    table = F.create_map(*[F.lit(x) for pair in known_texts.items() for x in pair])
    version = F.substring_index(F.col(model_col), ".", -1)
    name = F.col(model_col).substr(F.lit(1), F.greatest(F.length(model_col) - F.length(version) - 1, F.lit(0)))
    known = version.isin(list(known_texts))
    return rows.withColumns({
        "model": F.when(known, name).otherwise(F.col(model_col)),
        "system_prompt": F.try_element_at(table, version),
        "error": F.when(~known, F.concat(F.lit("unknown instruction version: "), version)),
    })


def rewrite_prompt(document: Column, question: Column, answer: Column, template: str = REWRITE_TEMPLATE,
                   present: str = ANSWER_PRESENT, absent: str = ANSWER_ABSENT) -> Column:
    """Fill the template; the requirement depends on whether the answer occurs in the document."""
    fields = {
        "requirement": F.when(F.contains(document, answer), F.lit(present)).otherwise(F.lit(absent)),
        "document": document,
        "question": question,
        "answer": answer,
    }
    parts: list[Column] = []
    rest = template
    while rest:
        opening = rest.find("{")
        if opening < 0:
            parts.append(F.lit(rest))
            break
        if opening:
            parts.append(F.lit(rest[:opening]))
        closing = rest.index("}", opening)
        parts.append(fields[rest[opening + 1 : closing]])
        rest = rest[closing + 1 :]
    return F.concat(*parts)
