"""Chat formatting: conversations to marked text with a loss mask, by Spark expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Strings that steer a model, in whatever template: none of them stands unescaped inside a turn.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TURN]", "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|endoftext|>")
OPENING = r"[<\[]"


def _after_opening() -> str:
    """A pattern of what follows the first character of any control string."""
    return "(?:" + "|".join("".join(c if c.isalnum() or c in "<>/_" else "\\" + c for c in mark[1:]) for mark in CONTROL) + ")"


def escaped(text: Column) -> Column:
    """``text`` with a backslash behind the first character of each control string; strings that are one but for backslashes there get one more, so that ``unescaped`` can tell them apart."""
    return F.regexp_replace(text, rf"({OPENING})(?=\\*{_after_opening()})", r"$1\\")


def unescaped(text: Column) -> Column:
    """What ``escaped`` made ``text`` of."""
    return F.regexp_replace(text, rf"({OPENING})\\(?=\\*{_after_opening()})", "$1")


@dataclass(frozen=True)
class Template:
    """Marks around the turns of each role. ``roles``: role, opening, closing mark; any other role is named between ``other`` and ``named``, and closed by ``closed``.

    Every mark holds a control string. ``joint`` stands between the texts of adjacent turns of one role.
    """

    roles: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>\n", "\n<</SYS>>\n"), ("user", "<s>[INST] ", " [/INST]"), ("assistant", "", "</s>"))
    other: str = "[ROLE]"
    named: str = "[TURN]"
    closed: str = "[/ROLE]"
    joint: str = "[TURN]"
    learned: tuple[str, ...] = ("assistant",)


INSTRUCT = Template()
CHATML = Template(tuple((r, f"<|im_start|>{r}\n", "<|im_end|>\n") for r in ("system", "user", "assistant")), "<|im_start|>[ROLE]", "[TURN]", "<|im_end|>\n", "<|im_sep|>")


def formatted(turns: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, segments): each conversation as marked text; segments (text, loss) are its parts in order, loss true where a model learns from them.

    A conversation's turns are collected as structs and sorted by turn, role and text, adjacent turns of one role are merged by array
    aggregation in one pair of marks, with ``template.joint`` between their texts, and all is concatenated. The loss mask covers the texts of
    ``template.learned`` roles, without marks. Control strings inside texts and role names are escaped (``escaped``), so
    ``turns_of`` and ``learned_of`` read back what went in.

    Null texts and roles count as empty, null turns come first, rows of a null id form one conversation. Equal turn
    numbers go by role and text; repeated rows stay. Empty texts leave an empty segment. Other columns are
    ignored, whatever their names; an empty table gives no rows. A conversation is one row of the result, so its text is
    bounded by a row of Spark (2 GB); conversations lie on as many tasks as there are partitions.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("one"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    at = lambda i: F.get("turns", i)["role"]
    heads = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    blocks = sorted_.withColumn("heads", heads)
    until = lambda k: F.coalesce(F.get("heads", k + 1), F.size("turns"))
    merged = F.transform("heads", lambda h, k: F.struct(at(h).alias("role"), F.transform(F.slice("turns", h + 1, until(k) - h), lambda t: escaped(t["text"])).alias("texts")))
    blocks = blocks.select("conv_id", merged.alias("blocks"))

    def chosen(role: Column, column: int, otherwise: Column) -> Column:
        for marks in reversed(template.roles):
            otherwise = F.when(role == marks[0], F.lit(marks[column])).otherwise(otherwise)
        return otherwise

    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def parts(block: Column) -> Column:
        role = block["role"]
        learned = role.isin(*template.learned) if template.learned else no
        opening = chosen(role, 1, F.concat(F.lit(template.other), escaped(role), F.lit(template.named)))
        body = F.flatten(F.transform(block["texts"], lambda t, i: F.array(segment(F.when(i == 0, opening).otherwise(F.lit(template.joint)), no), segment(t, learned))))
        return F.concat(body, F.array(segment(chosen(role, 2, F.lit(template.closed)), no)))

    parted = blocks.select("conv_id", F.flatten(F.transform("blocks", parts)).alias("segments"))
    return parted.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E" if mark else ""


def turns_of(text: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) that a text by ``formatted`` holds, in order, told by its marks alone. An opening mark that is empty counts where no other stands."""
    openings = [_quoted(opening) for _, opening, _ in template.roles]
    openings.append(f"{_quoted(template.other)}.*?{_quoted(template.named)}")
    openings.sort(key=lambda mark: not mark)
    closings = dict.fromkeys([*(_quoted(closing) for _, _, closing in template.roles), _quoted(template.closed)])
    pattern = f"(?s)({'|'.join(openings)})(.*?)(?:{'|'.join(closings)})"
    named = lambda mark: unescaped(F.substring(mark, F.lit(len(template.other) + 1), F.char_length(mark) - len(template.other) - len(template.named)))

    def block(mark: Column, body: Column) -> Column:
        role = named(mark)
        for name, opening, _ in template.roles:
            role = F.when(mark == opening, F.lit(name)).otherwise(role)
        return F.transform(F.split(body, _quoted(template.joint)), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), block))


def learned_of(segments: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between its parts."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def digests(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), one row for each row of ``formatted``, read back from it."""
    read = chats.select("conv_id", turns_of(F.col("formatted"), template).alias("turns"), learned_of(F.col("segments")).alias("learned"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


#: A conversation whose texts spell control strings.
TRAP = "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"

OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, r)
), e AS (
  SELECT *, length(text) + len(regexp_extract_all(text,
      '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|\[\\*ROLE\]|\[\\*/ROLE\]|\[\\*TURN\]|<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*\|im_sep\|>|<\\*\|endoftext\|>')) AS chars,
    role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + CASE WHEN NOT opens THEN length('[TURN]') WHEN role = 'user' THEN length('<s>[INST]  [/INST]') WHEN role = 'assistant' THEN length('</s>')
           WHEN role = 'system' THEN length('<<SYS>><</SYS>>') + 3 ELSE length('[ROLE][TURN][/ROLE]') + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
