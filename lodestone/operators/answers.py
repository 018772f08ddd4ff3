"""Messages for an answer, and the event stream of an answer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = {
    "default": "Answer in one to three paragraphs. Cite the sections you use.",
    "fast": "Answer in a few sentences. Cite the sections you use.",
}


def answer_prompt(query: Column, language: Column, mode: Column, calculation: Column, rule: Column, context: Column) -> Column:
    """User message: a calculation's result first, else a rule's evidence, else the context."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    source = F.when(some(calculation), F.concat(F.lit("Calculation:\n"), calculation)).when(some(rule), F.concat(F.lit("Rule:\n"), rule)).otherwise(F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit(""))))
    name = F.when(language == "id", "Bahasa Indonesia").when(language == "en", "English").otherwise("the language of the question")
    style = F.when(mode == "fast", STYLES["fast"]).otherwise(STYLES["default"])
    return F.concat_ws("\n\n", source, F.concat(F.lit("Question: "), query), F.concat(F.lit("Answer in "), name, F.lit(".")), style)


#: What every answer is told; a document's own rules are added by the caller.
SYSTEM = (
    "You answer questions about one document. Use the given context, rule or calculation only; if it does not hold the answer, say so. "
    "Name the section, paragraph and page of everything you state, as the context's tags give them, and no other. Copy numbers and units as they stand; do not calculate."
)


def answer_messages(user: Column, history: Column | None = None, system: str = SYSTEM, keep: int = 6) -> Column:
    """array(struct(role, content)): the system message, the last ``keep`` turns of the history, then the user message.

    history: array(struct(turn, role, text)) in any order; turns without text, or of other roles than user and assistant, are left out.
    """
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    first, last = F.array(message(F.lit("system"), F.lit(system))), F.array(message(F.lit("user"), F.coalesce(user, F.lit(""))))
    if history is None:
        return F.concat(first, last)
    said = F.filter(F.array_sort(F.coalesce(history, F.array().cast("array<struct<turn:bigint,role:string,text:string>>"))), lambda t: t["role"].isin("user", "assistant") & (F.coalesce(F.trim(t["text"]), F.lit("")) != ""))
    window = F.slice(said, F.greatest(F.size(said) - F.lit(keep - 1), F.lit(1)), F.lit(keep))
    return F.concat(first, F.transform(window, lambda t: message(t["role"], t["text"])), last)


def answer_events(messages: list[dict], chat, fallback: str = "No answer could be made.") -> Iterator[tuple[str, object]]:
    """(kind, payload): ``status`` events, then ``token`` events, then one ``done`` with the answer.

    A blank stream is asked for once more without streaming; if that is blank too, the fallback is the answer.
    """
    yield "status", "retrieving"
    yield "status", "generating"
    parts: list[str] = []
    try:
        for token in chat.stream(messages):
            parts.append(token)
            yield "token", token
    except Exception as e:  # the consumer sees the error as an event and the answer is asked for again
        yield "status", f"stream error: {e}"
    answer = "".join(parts)
    if not answer.strip():
        answer = chat.answer(messages)
        answer = answer if answer.strip() else fallback
        yield "token", answer
    yield "done", answer
