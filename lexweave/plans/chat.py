"""A conversation on the command line: commands, bounded memory, and plain-text rendering of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Row

from .. import constants as C

HELP = "/help  /clear  /stats  /quit"


@dataclass
class Session:
    """The last turns of one conversation; older ones are forgotten."""

    limit: int = C.SETTINGS.history_turns
    turns: list[tuple[str, str, float]] = field(default_factory=list)

    def add(self, question: str, answer: str, confidence: float) -> None:
        self.turns = [*self.turns, (question, answer, confidence)][-self.limit :]

    def clear(self) -> None:
        self.turns = []

    def history(self, chars: int = C.SETTINGS.history_answer_chars) -> str:
        """What a model is told of the turns so far; empty without any."""
        if not self.turns:
            return ""
        lines = [C.HISTORY_TITLE]
        for i, (question, answer, _) in enumerate(self.turns, 1):
            lines += [f"В{i}: {question}", f"О{i}: {answer[:chars]}{'…' if len(answer) > chars else ''}"]
        return "\n".join(lines)


def answer_panel(reply: Row) -> str:
    """The answer, its confidence, and whether it needed a second try."""
    again = " (retried)" if reply["retried"] else ""
    return f"{reply['answer']['answer']}\n[confidence {reply['answer']['confidence']:.0%}{again}]"


def citation_lines(reply: Row) -> list[str]:
    """One numbered line per cited article, each article once; codexes by their Russian names."""
    names = {slug: ru for slug, ru, _ in C.CODEXES}
    seen: dict[tuple[str, str], str] = {}
    for c in reply["answer"]["citations"] or []:
        seen.setdefault((c["codex_prefix"], c["number"]), c["name_ru"])
    return [f"{i}. {names.get(codex, codex)}, {C.ARTICLE_LABEL} {number} {name}".rstrip() for i, ((codex, number), name) in enumerate(seen.items(), 1)]


def statistics_line(session: Session) -> str:
    n = len(session.turns)
    mean = sum(t[2] for t in session.turns) / n if n else 0.0
    return f"{n} turns, mean confidence {mean:.0%}"


def talk(lines: Iterable[str], reply: Callable[[str, str], Row], session: Session | None = None) -> Iterator[str]:
    """What is shown for each line of input, until /quit.

    ``reply`` gets a question and the history and returns a row of ``answer.answer``;
    an error of its is shown, and the conversation goes on.
    """
    session = Session() if session is None else session
    for line in lines:
        text = line.strip()
        if not text:
            continue
        if text == "/quit":
            return
        if text == "/help":
            yield HELP
        elif text == "/clear":
            session.clear()
            yield "cleared"
        elif text == "/stats":
            yield statistics_line(session)
        else:
            yield ask_once(text, reply, session)


def ask_once(question: str, reply: Callable[[str, str], Row], session: Session) -> str:
    """One question answered, remembered and rendered."""
    try:
        row = reply(question, session.history())
    except Exception as error:
        return f"error: {error}"
    session.add(question, row["answer"]["answer"], row["answer"]["confidence"])
    return "\n".join([answer_panel(row), *citation_lines(row)])
