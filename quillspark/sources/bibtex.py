"""BibTeX texts to entries, by a small tokenizer. It never raises; what it cannot read it steps over."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from quillspark.schemas import BIB_ENTRY

BLANK = " \t\r\n"


def word_end(text: str, at: int) -> int:
    while at < len(text) and (text[at].isalnum() or text[at] == "_"):
        at += 1
    return at


def blank_end(text: str, at: int) -> int:
    while at < len(text) and text[at] in BLANK:
        at += 1
    return at


def entry_at(text: str, at: int) -> tuple[str, int] | None:
    """(kind, place after the brace) if an entry opens at ``at``."""
    end = word_end(text, at + 1)
    brace = blank_end(text, end)
    if text[at] == "@" and end > at + 1 and brace < len(text) and text[brace] == "{":
        return text[at + 1 : end].lower(), brace + 1
    return None


def value_at(text: str, at: int, stop: int) -> tuple[str, int]:
    """(value, place after it) of a field: braced with inner braces in pairs, quoted, or bare to the next comma, line end or closing brace."""
    if at < stop and text[at] in '{"':
        depth, end = 0, at
        while end < stop:
            c = text[end]
            depth += (c == "{") - (c == "}")
            if end > at and (depth == 0 and (c == '"' if text[at] == '"' else c == "}")):
                return text[at + 1 : end], end + 1
            end += 1
        return text[at + 1 : stop], stop
    end = at
    while end < stop and text[end] not in ",\n}":
        end += 1
    return text[at:end], end


def fields_in(text: str, at: int, stop: int) -> dict[str, str]:
    """Fields by name in lower case, the last of a name; braces go, blanks become one space."""
    out = {}
    while at < stop:
        end = word_end(text, at)
        sign = blank_end(text, end)
        if end > at and sign < stop and text[sign] == "=":
            name = text[at:end].lower()
            value, at = value_at(text, blank_end(text, sign + 1), stop)
            out[name] = " ".join(value.replace("{", "").replace("}", "").split())
        else:
            at = max(end, at + 1)
    return out


def entries(text: str | None) -> list[tuple[str, dict[str, str]]]:
    """(kind, fields) of each entry; a body ends where the next entry opens."""
    text, opened, at = text or "", [], -1
    while (at := text.find("@", at + 1)) >= 0:
        if found := entry_at(text, at):
            opened.append((at, *found))
    ends = [x[0] for x in opened[1:]] + [len(text)]
    return [(kind, fields_in(text, begin, stop)) for (_, kind, begin), stop in zip(opened, ends, strict=False)]


def keywords_in(value: str) -> list[str]:
    return [w for part in value.replace(";", ",").split(",") if (w := part.strip())]


def parse_bibtex(texts: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(id, ord, entry...) of each entry of each BibTeX text, in Arrow batches. Titles with inner braces are read whole."""

    def parse(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = [
                (i, n, kind, *[f.get(k) or None for k in ("title", "abstract", "author", "year")], keywords_in(f.get("keywords", "")))
                for i, text in zip(b["id"], b["text"], strict=True) for n, (kind, f) in enumerate(entries(text))
            ]
            yield pd.DataFrame(rows, columns=["id", "ord", "entry_type", "title", "abstract", "author", "year", "keywords"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(parse, f"id {kind}, ord long, {BIB_ENTRY}")


def bib_keywords(entries: DataFrame) -> DataFrame:
    """(id, keywords): distinct keywords of all entries of an id in order, the first spelling of each."""
    each = entries.select("id", "ord", F.posexplode("keywords").alias("pos", "kw"))
    once = each.groupBy("id", F.lower("kw").alias("low")).agg(F.min(F.struct("ord", "pos", "kw")).alias("k"))
    return once.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: k["kw"]).alias("keywords"))
