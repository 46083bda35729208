"""Reading what language models answer: JSON in prose, or lines that name a field. Plain functions for Arrow batches."""

from __future__ import annotations

import json

BACKSLASH, QUOTE = "\\", '"'
CLOSES = {"{": "}", "[": "]"}


def string_end(text: str, at: int) -> int:
    """The place after the string that opens at ``at``; -1 if it never ends."""
    at += 1
    while at < len(text):
        if text[at] == BACKSLASH:
            at += 1
        elif text[at] == QUOTE:
            return at + 1
        at += 1
    return -1


def span_end(text: str, at: int) -> int:
    """The place after the bracketed value that opens at ``at``, brackets in strings aside; -1 if it never closes."""
    open_ = []
    while at < len(text):
        c = text[at]
        if c == QUOTE:
            if (at := string_end(text, at)) < 0:
                return -1
            continue
        if c in CLOSES:
            open_.append(CLOSES[c])
        elif c in "}]":
            if c != open_.pop():
                return -1
            if not open_:
                return at + 1
        at += 1
    return -1


def parsed(text: str):
    """The value of JSON text, None if it is none."""
    try:
        return json.loads(text)
    except ValueError:
        return None


def last_value(text: str, opening: str, fits):
    """The value that opens last in ``text`` among those that ``fits`` accepts, sought from the end."""
    at = text.rfind(opening)
    while at >= 0:
        end = span_end(text, at)
        if end > 0 and (value := parsed(text[at:end])) is not None and fits(value):
            return value
        at = text.rfind(opening, 0, at)
    return None


def unfenced(answer: str | None) -> str:
    """An answer without the marks of a code block."""
    return (answer or "").replace("```json", "").replace("```", "").strip()


def phrases(value) -> list[str]:
    """Members of a list as texts, blank ones aside."""
    return [s for x in value if (s := str(x).strip())] if isinstance(value, list) else []


def keywords_of(answer: str | None, most: int = 12) -> list[str]:
    """The first ``most`` keywords: of the answer as a JSON array, else of the last array in it that is not blank."""
    text = unfenced(answer)
    return (phrases(parsed(text)) or phrases(last_value(text, "[", phrases)))[:most]


def skip(text: str, at: int, chars: str) -> int:
    while at < len(text) and text[at] in chars:
        at += 1
    return at


def after_name(text: str, at: int, name: str) -> int:
    """The place of the value if ``name`` (in any case, in quotes or not) and : or = stand at ``at``; else -1."""
    if at < len(text) and text[at] in "\"'":
        at += 1
    if text[at : at + len(name)].lower() != name:
        return -1
    at += len(name)
    if at < len(text) and text[at] in "\"'":
        at += 1
    at = skip(text, at, " \t\r\n")
    return skip(text, at + 1, " \t\r\n") if at < len(text) and text[at] in ":=" else -1


def unescaped(inner: str) -> str:
    """The text that a quoted value stands for; as it is where its escapes are none of JSON's."""
    value = None
    try:
        value = json.loads(f'"{inner}"', strict=False)
    except ValueError:
        pass
    return (inner if value is None else value).strip()


def told(text: str, name: str) -> str:
    """The last value that prose gives a field: the last quoted one anywhere, else the rest of the last line that begins with the field."""
    low, at, quoted = text.lower(), 0, None
    while (at := low.find(name, at)) >= 0:
        value = after_name(text, at, name)
        end = string_end(text, value) if 0 <= value < len(text) and text[value] == QUOTE else -1
        if end > 0:
            quoted = text[value + 1 : end - 1]
        at = end if end > 0 else at + len(name)
    if quoted is not None:
        return unescaped(quoted)
    said, start = "", 0
    while start <= len(text):
        value = after_name(text, skip(text, start, " \t>*#-"), name)
        stop = text.find("\n", max(start, value))
        stop = len(text) if stop < 0 else stop
        if value >= 0 and value < stop:
            said = text[value:stop]
        start = stop + 1
    return said.strip().strip("\"'").strip()


def summary_of(answer: str | None) -> tuple[str, str]:
    """(title, summary): of the answer as a JSON object, else of its last object with either field, else of its prose. Both may be ''."""
    text = unfenced(answer)
    whole = parsed(text)
    if whole is None:
        whole = last_value(text, "{", lambda x: isinstance(x, dict) and ("title" in x or "summary" in x))
    if isinstance(whole, dict):
        title, summary = (str(whole.get(k, "")).strip() for k in ("title", "summary"))
        if summary:
            return title, summary
    return told(text, "title"), told(text, "summary")


def label_of(answer: str | None) -> tuple[str | None, str | None, str | None]:
    """(main, second, parse_error) of an answer that has to be a JSON object with main_archetype and perhaps second_tier_archetype."""
    value = parsed(answer or "")
    if not isinstance(value, dict):
        return None, None, "not a JSON object"
    main, second = value.get("main_archetype"), value.get("second_tier_archetype")
    if not isinstance(main, str):
        return None, None, "main_archetype is missing or no text"
    if second is not None and not isinstance(second, str):
        return None, None, "second_tier_archetype is no text"
    return main, second, None
