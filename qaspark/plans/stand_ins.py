"""Stand-ins for models and judges, which workers import."""

from __future__ import annotations

from qaspark.sources import responder


def echo(row: dict) -> dict:
    """A stand-in for a model: answers with the prompt, thinks about its length, fails where that is divisible by 5."""
    if len(row["prompt"]) % 5 == 0:
        raise responder.CallError("INTERNAL")
    content, reasoning = responder.divided(f"<think>{len(row['prompt'])}</think> {row['prompt']}")
    return {"content": content, "reasoning": reasoning, "prompt_tokens": len(row["prompt"]), "completion_tokens": 1}


def yes_judge(row: dict) -> dict:
    """A stand-in: says yes to responses on views, nothing usable on clicks, fails on errors."""
    response = row["prompt"].split("Response: ")[1]
    if "error" in response:
        raise responder.CallError("INTERNAL")
    return {"content": "no idea" if "click" in response else '```json\n{"is_correct": %s}\n```' % ("true" if "view" in response else "false")}


def score_judge(row: dict) -> dict:
    """A stand-in that scores by the length of the answer and the rubric's own mark."""
    head, rest = row["prompt"].split("\n\nQuestion: ", 1)
    answer = rest.split("\n\nAnswer:\n")[1].split("\n\nReply")[0]
    if head == "none":
        return {"content": '{"score": "high", "reason": "x"}'}
    return {"content": '{"score": %s, "reason": "%s"}' % (min(10, len(answer) % 11 + (head == "mild")), head)}


def repeat_prompt(row: dict) -> dict:
    """A stand-in that says what it is told."""
    return {"content": row["prompt"]}
