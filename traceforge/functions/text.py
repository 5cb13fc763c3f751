"""Column expressions on prompts, traces and responses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from traceforge.constants import (
    ANSWER_FORCE_STRING,
    QWEN_TURN_END,
    R1_SENTENCE_END,
    RESPONSE_MARKERS,
    SYSTEM_PROMPT,
    THINK_END,
)


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends, line ends included."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


@dataclass(frozen=True)
class ChatTemplate:
    """How one message is written: before the role, before the content, after it."""

    role_open: str
    role_close: str
    turn_close: str
    prefix: str = ""

    def message(self, role: Column, content: Column) -> Column:
        return F.concat(
            F.lit(self.role_open), role, F.lit(self.role_close), content, F.lit(self.turn_close)
        )

    def generation_prompt(self, role: str = "assistant") -> str:
        return self.role_open + role + self.role_close


CHATML = ChatTemplate("<|im_start|>", "\n", "<|im_end|>\n")


def render_messages(
    messages: Column, template: ChatTemplate = CHATML, add_generation_prompt: bool = False
) -> Column:
    """One chat string from an ordered ``ARRAY<STRUCT<role, content>>``."""
    turns = F.array_join(
        F.transform(messages, lambda m: template.message(m["role"], m["content"])), ""
    )
    ending = template.generation_prompt() if add_generation_prompt else ""
    return F.concat(F.lit(template.prefix), turns, F.lit(ending))


def _messages(**contents: Column) -> Column:
    return F.array(
        *[
            F.struct(F.lit(role).alias("role"), content.alias("content"))
            for role, content in contents.items()
        ]
    )


def render_prompt(problem: Column, template: ChatTemplate = CHATML) -> Column:
    """System and user message, open for the assistant. One newline ends the problem."""
    messages = _messages(
        system=F.lit(SYSTEM_PROMPT), user=F.concat(strip(problem), F.lit("\n"))
    )
    return render_messages(messages, template, add_generation_prompt=True)


def training_messages(problem: Column, response: Column) -> Column:
    """The message triple of one training row. No newline is added here."""
    return _messages(system=F.lit(SYSTEM_PROMPT), user=strip(problem), assistant=strip(response))


def render_chat(problem: Column, response: Column, template: ChatTemplate = CHATML) -> Column:
    """Closed system/user/assistant chat string for training."""
    return render_messages(training_messages(problem, response), template)


def format_mcq(question: Column, choices: Column) -> Column:
    """Question, then one lettered line per choice."""
    lines = F.transform(
        choices, lambda choice, i: F.concat(F.char(i + F.lit(65)), F.lit(". "), choice)
    )
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"))


def mcq_solution(answer: Column) -> Column:
    """Boxed letter of a zero-based answer index."""
    return F.concat(F.lit("\\boxed{"), F.char(answer.cast("int") + F.lit(65)), F.lit("}"))


def remove_all(text: Column, token: str) -> Column:
    return F.replace(text, F.lit(token), F.lit("")) if token else text


def remove_first(text: Column, token: str) -> Column:
    if not token:
        return text
    at = F.locate(token, text)
    return F.when(
        at > 0,
        F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(token), F.length(text))),
    ).otherwise(text)


def close_with(text: Column, token: str) -> Column:
    if not token:
        return text
    return F.when(F.endswith(text, F.lit(token)), text).otherwise(F.concat(text, F.lit(token)))


def clean_trace(text: Column, pad: str = "", bos: str = "", eos: str = "") -> Column:
    """Drop every pad, the first bos and every eos, then end with one eos."""
    return close_with(remove_all(remove_first(remove_all(text, pad), bos), eos), eos)


def response_family(trace: Column) -> Column:
    """Name of the first marker of ``RESPONSE_MARKERS`` in the trace, null when none."""
    found = [F.when(F.contains(trace, F.lit(m)), F.lit(name)) for name, m in RESPONSE_MARKERS.items()]
    return F.coalesce(*found)


def _after_first(text: Column, marker: str) -> Column:
    return F.substring(text, F.locate(marker, text) + len(marker), F.length(text))


def extract_response(trace: Column, eos: str = QWEN_TURN_END) -> Column:
    """The assistant's words in a trace; null when no known marker occurs."""
    qwen, r1 = RESPONSE_MARKERS["qwen"], RESPONSE_MARKERS["r1"]
    return F.when(
        F.contains(trace, F.lit(qwen)),
        F.substring_index(_after_first(trace, qwen), QWEN_TURN_END, 1),
    ).when(
        F.contains(trace, F.lit(r1)),
        F.replace(_after_first(trace, r1), F.lit(R1_SENTENCE_END), F.lit(eos)),
    )


def force_answer(trace: Column, marker: str = RESPONSE_MARKERS["qwen"]) -> Column:
    """Open the final answer, closing the thinking part of the last response if needed."""
    last = F.substring_index(trace, marker, -1)
    closing = F.when(F.contains(last, F.lit(THINK_END)), F.lit("")).otherwise(F.lit("\n" + THINK_END))
    return F.concat(trace, closing, F.lit(ANSWER_FORCE_STRING))


def force_answer_by_family(trace: Column) -> Column:
    """``force_answer`` with each trace's own marker; null when it has none."""
    family = response_family(trace)
    return F.coalesce(
        *[F.when(family == name, force_answer(trace, m)) for name, m in RESPONSE_MARKERS.items()]
    )
